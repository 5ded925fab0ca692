from pyspark.sql import functions as F

from fuzzyspark.functions.porter import stem
from fuzzyspark.functions.text import (block_normalize, preprocess, split_by_space, three_gram)


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_three_gram_padding(spark):
    assert _one(spark, three_gram, "ab") == ["$$a", "$ab", "ab$", "b$$"]
    assert _one(spark, three_gram, "") == ["$$$", "$$$"]
    assert _one(spark, three_gram, "  a   b ") == ["$$a", "$a ", "a b", " b$", "b$$"]


def test_split_by_space_edge_rows(spark):
    assert _one(spark, split_by_space, "") == []
    assert _one(spark, split_by_space, "   ") == []
    assert _one(spark, split_by_space, "a\tb\nc  d") == ["a", "b", "c", "d"]
    assert _one(spark, split_by_space, "x y　z") == ["x", "y", "z"]
    assert _one(spark, split_by_space, "a a") == ["a", "a"]


def test_remove_punctuation_keeps_unicode_letters(spark):
    f = lambda c: preprocess(c, "lowerRemovePunctuation")
    assert _one(spark, f, "Ü-ß, é!") == "üß é"
    assert _one(spark, f, "!!!") == ""
    assert _one(spark, f, "Москва_1") == "москва_1"


def test_block_normalize(spark):
    f = lambda c: block_normalize([c], stem=False)
    assert _one(spark, f, "The Galleria (Houston)") == "the galleria houston"
    g = lambda c: block_normalize([c], stem=True)
    assert _one(spark, g, "Running   Players!") == "run player"


def test_porter_examples():
    cases = {"caresses": "caress", "ponies": "poni", "motoring": "motor", "hopping": "hop",
             "filing": "file", "happy": "happi", "relational": "relat", "generalizations": "gener",
             "as": "as", "is": "is", "oscillators": "oscil", "controll": "control"}
    for w, s in cases.items():
        assert stem(w) == s, w


def test_stem_udf(spark):
    f = lambda c: preprocess(c, "lowerStem")
    assert _one(spark, f, "Connected Connections") == "connect connect"
    assert _one(spark, f, None) is None
