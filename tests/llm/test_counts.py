"""Operators that count over all documents, against plain versions."""

import hashlib
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from fuzzyspark.llm import collocations, common, filter_audit, fingerprints

from .conftest import prose

SPACE = r"[^\x20\x09-\x0D]+"


def low(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


# --- collocations --------------------------------------------------------------------------------

def brute_phrases(rows, min_count, top=2000, cover=80, scale=2_000_000):
    f, n, out = {}, Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        c = f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            c.update(tuple(w[i:i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    for lang, c in f.items():
        often = {p: a for p, a in c.items() if a >= min_count and len(p) > 1}
        mine = []
        for p, a in often.items():
            score, _, l, r = min((scale * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= cover * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                         for q, b in often.items())
            if not inside:
                mine.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(mine)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def phrase_docs(spark, rows):
    import random

    rng = random.Random(3)
    data = [(i, t, rng.choice(["en", "fr", None])) for i, t, _ in rows]
    data += [(None, "né. né,né né\tné  né\x0bné né", "x"), (1, "to be or not TO BE or not to be; " * 40, "en"),
             (1, "to be or not TO BE or not to be; " * 40, "en"), (2, "nul \x00 and \x01 nul \x00 and " * 40, "und"), (3, " \t ", "und"),
             (4, "é" * 3000 + " a " + "é" * 3000, "x"), (5, "one " * 700, "y"), (6, "😀 😀! 😀 😀" * 50, "z")]
    return data


@pytest.mark.parametrize("joined", [False, True])
def test_collocations_match_brute_force(spark, phrase_docs, monkeypatch, joined):
    if joined:  # frequent groups beyond every bound of broadcasts, and many stretches
        for where, name, value in ((collocations, "GROUP_BYTES", 0), (common, "BROADCAST_ROWS", 0), (collocations, "STRETCH", 8),
                                   (collocations, "TEXT_BYTES", 2000), (collocations, "PAIRS", 50), (collocations, "OCCURRENCES_AT_ONCE", 100)):
            monkeypatch.setattr(where, name, value)
    df = spark.createDataFrame([(*r, "x", 1) for r in phrase_docs], "doc_id long, text string, lang string, word string, end int").repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(df, min_count=6).collect())
    want = brute_phrases([(r[2], r[1]) for r in phrase_docs], 6)
    assert len(want) > 20 and got == want


def test_collocations_keep_the_first_of_ties(spark):
    words = [f"w{i:02d}" for i in range(12)]
    df = spark.createDataFrame([(1, " . ".join(f"{a} {b}" for a, b in zip(words[::2], words[1::2])), "en")] * 30, "doc_id long, text string, lang string")
    got = collocations.collocations(df, top=4).orderBy("rank").collect()
    assert [(r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got] == [
        (k + 1, f"{words[2 * k]} {words[2 * k + 1]}", 30, 30, 30, 30 * 12, 1_000_000) for k in range(4)]
    assert collocations.collocations(df.limit(29)).collect() == []
    assert collocations.collocations(df.limit(0)).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, None, None), (2, "", "")], df.schema)).collect() == []


def test_phrases_are_joined_without_the_driver(spark, phrase_docs, monkeypatch):
    """Spark broadcast tables of phrases that it had sized before they were repeated or exploded."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame([(*r, "x", 1) for r in phrase_docs], "doc_id long, text string, lang string, word string, end int")
    groups, _ = collocations.mine(df, 3, 6)
    for found in collocations._scored(groups, 100):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_sent_as_numbers(spark):
    """Groups went to the tasks as rows of the driver, up to 1.4 million; phrases of a large table were then all shuffled."""
    assert 5_000_000 * collocations.PAIR_BYTES <= collocations.GROUP_BYTES
    rows = [(7, 2, 10), (1 << 40, 2, 11), (7, 1 << 35, 12), (3, 5, 13)]
    firsts, seconds, key, ids = collocations._sent_pairs(spark.createDataFrame(rows, "a long, b long, id long"))
    assert (firsts.tolist(), seconds.tolist()) == ([3, 7, 1 << 40], [2, 5, 1 << 35])
    assert sorted(zip(key.tolist(), ids.tolist())) == list(zip(key.tolist(), ids.tolist())) == [(1, 13), (3, 10), (5, 12), (6, 11)]
    none = collocations._sent_pairs(spark.createDataFrame([], "a long, b long, id long"))
    assert [len(x) for x in none] == [0, 0, 0, 0]


# --- filter audit --------------------------------------------------------------------------------

def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = []
    for i, text, source in rows:
        t = text or ""
        w = re.findall(SPACE, t)
        fails = {f for f, x in zip("ABCD", (len(w) < 200, 100 * len(set(w)) < 50 * len(w),
                                            100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search(r"[#$%&*|]", t))) if x}
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows):
            fails.add("E")
        docs.append((source or "", fails, i in good, i in toxic))
    out = []
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        lost = Counter()
        table = []
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                lost[f] += len(gone)
                table.append([part, "".join(order), step, len(left), len(gone), sum(f in d[1] for d in mine) - len(gone),
                              sum(d[1] == {f} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone), f])
        out += [(*r[:-1], lost[r[-1]]) for r in table]
    return sorted(out)


def test_audit_matches_brute_force(spark, rows, monkeypatch):
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 80, 3)] + [(3, None, 1), (None, 1, 1), (6, 1, None), (500, 1, 1)]
    ls = spark.createDataFrame([(*x, "n") for x in labels], "doc_id long, quality int, toxic int, mask string")
    extra = [(200, "A$B" * 300, "a"), (201, "word " * 250, "a"), (202, "word " * 250, "é"), (202, "word " * 250, "é"), (203, "word " * 250, None)]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows + extra], "doc_id long, text string, source string, n int, part string").repartition(3)
    want = brute_audit(rows + extra, labels)
    for bound in (common.BROADCAST_ROWS, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", bound)
        got = sorted(tuple(r[c] for c in ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
                     for r in filter_audit.audit(df, ls).collect())
        assert got == want
    assert filter_audit.audit(df.limit(0), ls).collect() == []
    assert filter_audit.audit(df.limit(1), ls.limit(0)).count() == 600


@pytest.mark.parametrize("n_df", [None, 3, 1000])
def test_a_repeated_lookup_is_not_broadcast(spark, monkeypatch, n_df):
    """Spark sized the table of an audit's copies before it was repeated and sent 16 copies to the driver."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame([(i % 3, i) for i in range(9)] + [(None, 9)], "k long, x long")
    small = spark.createDataFrame([(0, "a"), (1, "b"), (None, "n")], "k long, v string")
    got = common.lookup(df, small, ["k"], df["x"], 3, n_df=n_df)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["x"], r["v"]) for r in got.collect()) == [(i, ("a", "b", None)[i % 3]) for i in range(9)] + [(9, "n")]


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_intervals_remove_each_mask_once_in_every_order(n):
    orders = list(permutations(range(n)))
    assert [filter_audit.lehmer_rank(o, n) for o in orders] == list(range(len(orders)))
    for mask in range(1, 1 << n):
        for rank, order in enumerate(orders):
            steps = [s for m, s, a, b in filter_audit.removal_intervals(n) if m == mask and a <= rank < b]
            assert steps == [1 + next(i for i, f in enumerate(order) if mask >> f & 1)]


# --- fingerprints --------------------------------------------------------------------------------

def bag(t):
    return Counter(re.findall(SPACE, t.lower()))


def jaccard(a, b):
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / max(1, sum(max(a[k], b[k]) for k in keys)) if keys else 1.0


def test_samples_collide_as_generalised_jaccard(spark):
    rng = np.random.default_rng(4)
    base = {int(k): int(w) for k, w in enumerate(rng.integers(0, 9, 60))}
    other = {k: (w if k % 2 else int(rng.integers(0, 9))) for k, w in base.items()}
    n = 4000
    terms = spark.createDataFrame([(0, k * 7919, base[k], other[k], 0) for k in base], "key int, term long, a long, b long, c long")
    r = fingerprints.samples(terms, ["key"], ["a", "b", "c"], n).first()
    assert len(r.a) == n and set(r.c) == {0}
    assert abs(np.mean(np.array(r.a) == np.array(r.b)) - jaccard(Counter(base), Counter(other))) < 4 * (0.25 / n) ** 0.5


def test_fingerprints_of_edited_texts(spark, rows):
    data = [(*r, "f", 1) for r in rows] + [(200, "Ünï " * 40 + "😀" * 9, "a", "f", 1)] * 3 + [(201, "Ünï " * 41, "a", "f", 1), (202, "ünï " * 41, "a", "f", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, own string, k1 int").repartition(4)
    got = fingerprints.fingerprints(df, 64).collect()
    assert len(got) == len(data)
    order, groups = [], sorted({(r[0], r[1] or "") for r in data}, key=lambda x: (x[0] is None, -(x[0] or 0)))
    seen = {}
    for r in got:
        seen.setdefault((r.doc_id, r.n_chars), []).append(r)
    one = [g for g in groups if sum(h[0] == g[0] for h in groups) == 1]  # texts of one id follow in an order of their own
    assert len(one) > 80
    for k, g in enumerate(groups):
        nxt = groups[(k + 1) % len(groups)]
        mine = seen[g[0], len(g[1])]
        order.append((mine[0].fingerprint, tuple(sorted(bag(g[1]).items()))))
        if g not in one or nxt not in one:
            continue
        half = len(g[1]) // 2
        copies = sum((r[0], r[1] or "") == g for r in data)
        edits = [g[1][:len(g[1]) - half] + x[:half] for x in [g[1]] * (copies - 1) + [nxt[1]]]
        assert sorted(r.edited_sha256 for r in mine) == sorted(hashlib.sha256(e.encode()).hexdigest() for e in edits)
        for e in edits:
            r = next(r for r in mine if r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest())
            assert abs(r.near_edited - jaccard(bag(g[1]), bag(e))) < 0.3
            assert bag(e) != bag(g[1]) or r.edited_fingerprint == r.fingerprint
            same = [a == b for a, b in zip(re.findall(".{8}", r.fingerprint), re.findall(".{8}", r.edited_fingerprint))]
            assert len(same) == 64 and r.near_edited == np.mean(same)
        assert sorted(r.near_next for r in mine)[copies - 1:] and [r.near_next for r in mine].count(1.0) >= copies - 1
    prints = {}
    for f, words in order:
        prints.setdefault(words, set()).add(f)
    assert all(len(x) == 1 for x in prints.values()) and len({f for f, _ in order}) > len(prints) - 15  # near copies may share theirs


def test_fingerprints_of_few_rows(spark, empty, monkeypatch):
    assert fingerprints.fingerprints(empty).collect() == []
    schema = "doc_id long, text string"
    one = fingerprints.fingerprints(spark.createDataFrame([(3, "abc def")], schema)).collect()
    assert [(r.n_chars, r.near_next, r.edited_sha256) for r in one] == [(7, 1.0, hashlib.sha256(b"abc abc").hexdigest())]
    blank = fingerprints.fingerprints(spark.createDataFrame([(1, None), (2, "")], schema)).collect()
    assert {(r.n_chars, r.near_edited, r.near_next, set(r.fingerprint) == {"0"}) for r in blank} == {(0, 1.0, 1.0, True)}
    monkeypatch.setattr(fingerprints, "COPIES", 3)
    import random

    same = [(5, prose(random.Random(1), 30))] * 11
    got = fingerprints.fingerprints(spark.createDataFrame(same, schema).repartition(3)).collect()
    assert len(got) == 11 and len({r.fingerprint for r in got}) == 1 and all(r.near_next == 1.0 for r in got)
