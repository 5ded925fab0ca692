import random
import re

import pytest
from pyspark.sql import types as T

#: columns of documents and others whose names the operators use themselves
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()), T.StructField("size", T.StringType()),
                       T.StructField("score", T.StringType()), T.StructField("th", T.StringType()),
                       T.StructField("fp", T.StringType()), T.StructField("h", T.StringType()),
                       T.StructField("shard", T.StringType()), T.StructField("slot", T.StringType())])
VOCABULARY = [a + b for a in ("ba", "ce", "di", "fo", "gu", "ha", "né", "ol") for b in ("ren", "sil", "tok", "ula", "vor")]


def words_of(text):
    """Words of the decontamination contract."""
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def prose(rng, n):
    out = []
    for i in range(n):
        w = rng.choice(VOCABULARY)
        out.append((w.capitalize() if i % 9 == 0 else w) + (". " if i % 9 == 8 else " "))
    return "".join(out).strip()


def texts(rng):
    """(doc_id, text, source): prose, near and exact copies, empty, null, very long, repeated and null ids."""
    rows = []
    for i in range(60):
        rows.append((i, prose(rng, rng.randint(1, 80)), rng.choice(["a", "b", "é", None])))
    base = prose(rng, 120)
    for i in range(60, 75):
        w = base.split(" ")
        w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
        rows.append((i, " ".join(w), "a"))
    rows += [(i, base, "b") for i in range(75, 80)]
    rows += [(80, "", "a"), (81, None, None), (82, " \n\t ", "b"), (83, prose(rng, 20_000), "c"), (84, "x", "d"),
             (7, rows[7][1], rows[7][2]), (8, "another text of id eight", "a"), (None, "no id here", "b"),
             (None, None, None), (85, "nul \x00 byte and   separators\x0bhere", "c"), (86, "ÀÉ ÜBER ABC", "c")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return texts(random.Random(5))


@pytest.fixture(scope="session")
def docs(spark, rows):
    data = [(i, t, "en", s, len(t or ""), "x", None, "y", "z", "q", "r", "s") for i, t, s in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
