"""Operators that learn, search or mine: held-out accuracy, recall, and plain versions on small inputs."""

import re
import tracemalloc
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from fuzzyspark.llm import hnsw, quality, toxicity, urls
from fuzzyspark.llm.common import table

SF = "/root/testdata/sf0.1"


# --- toxicity ------------------------------------------------------------------------------------

def test_grammar_marks_negation_report_and_target():
    read = lambda symbols: toxicity.read_clause(symbols, [2.0] * len(symbols), out := np.zeros(toxicity.N_FEATURES)) or out
    t = toxicity
    assert read([t.OTHER, t.INSULT])[0] == 2.0                         # plain
    assert read([t.TARGET, t.OTHER, t.INSULT])[1] == 2.0               # targeted, target first
    assert read([t.INSULT, t.TARGET])[1] == 2.0                        # or last
    assert read([t.NEGATION, t.OTHER, t.INSULT])[4] == 2.0             # negated within reach
    assert read([t.NEGATION, *[t.OTHER] * 3, t.INSULT])[0] == 2.0      # out of reach
    assert read([t.REPORT, *[t.OTHER] * 9, t.INSULT])[2] == 2.0        # reported
    assert read([t.TARGET, t.REPORT, t.NEGATION, t.THREAT])[15] == 2.0  # a threat, all at once


def test_toxicity_on_held_out_documents(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").select("held_out", "toxic", "predicted", "score").toPandas()
    test = got[got.held_out]
    assert got.score.between(0, 1).all()
    assert (test.toxic == test.predicted).mean() > 0.96
    hit = test[test.toxic == 1].predicted.mean()
    false = test[test.toxic == 0].predicted.mean()
    assert hit > 0.8 and false < 0.02


def test_toxicity_edge_cases(spark, docs, rows, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, none).collect()
    assert len(got) == len(rows) and {r.score for r in got} == {0.5}
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)] + [(1, 1, None), (None, 0, 1)], none.schema)
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    same = {}
    for r in got:
        same.setdefault(r.doc_id, set()).add(r.held_out)
    assert all(len(v) == 1 for v in same.values())
    assert toxicity.toxicity(empty, labels).collect() == []


# --- quality -------------------------------------------------------------------------------------

def test_expectation_maximisation_finds_the_worse_labeller():
    rng = np.random.default_rng(0)
    k = len(quality.LABELLERS)
    bad = rng.random(4000) < 0.2
    right = np.array([0.998, 0.98, 0.998, 0.998, 0.998, 0.998, 0.6, 0.6])
    counts = {}
    for b in bad:
        votes = np.full(k, quality.ABSTAIN)
        for j, (vote, _, _) in enumerate(quality.LABELLERS.values()):
            if rng.random() < 0.6 and ((vote == quality.BAD) == b) == (rng.random() < right[j]):
                votes[j] = vote
        p = int(quality._pattern(votes[None])[0])
        counts[p] = counts.get(p, 0) + 1
    accuracy, posterior = quality.expectation_maximisation(counts)
    found = sum(n for p, n in counts.items() if posterior[p] > 0.5) / 4000
    assert abs(found - 0.2) < 0.05 and posterior[3 ** k - 1] == pytest.approx(quality.BALANCE)
    assert accuracy[1] <= accuracy[[0, 2, 3, 4, 5]].max() and accuracy[:6].min() >= 0.9
    assert all(0 <= p <= 1 for p in posterior.values())
    assert quality.expectation_maximisation({})[1] == {}


def drawn(rng, bad, right, also=()):
    """Counts of vote patterns, and the patterns of the documents; also: labellers that vote on clean documents together."""
    counts, of = {}, []
    for b, code in zip(bad, also if len(also) else np.zeros(len(bad), bool)):
        votes = np.full(len(quality.LABELLERS), quality.ABSTAIN)
        for j, (name, (vote, _, _)) in enumerate(quality.LABELLERS.items()):
            fires = rng.random() < 0.6 and ((vote == quality.BAD) == b) == (rng.random() < right[j])
            if code and vote == quality.BAD:
                fires = name in ("symbols", "endings")
            if fires:
                votes[j] = vote
        of.append(int(quality._pattern(votes[None])[0]))
        counts[of[-1]] = counts.get(of[-1], 0) + 1
    return counts, np.array(of)


def test_a_labeller_that_misfires_is_found_out():
    rng = np.random.default_rng(4)
    bad = rng.random(6000) < 0.15
    right = np.array([0.99, 0.6, 0.99, 0.99, 0.99, 0.99, 0.8, 0.8])
    counts, of = drawn(rng, bad, right)
    accuracy, posterior = quality.expectation_maximisation(counts)
    assert abs(accuracy[1] - 0.6) < 0.1 and accuracy[[0, 2, 3, 4, 5]].min() > 0.9
    assert (np.array([posterior[p] > 0.5 for p in of]) == bad).mean() > 0.95


def test_clean_documents_with_many_symbols_stay_good():
    """A third of all rows, on which two labellers of bad text vote together."""
    rng = np.random.default_rng(5)
    bad = rng.random(6000) < 0.1
    code = ~bad & (rng.random(6000) < 0.37)
    counts, of = drawn(rng, bad, np.array([0.99] * 6 + [0.8] * 2), code)
    accuracy, posterior = quality.expectation_maximisation(counts)
    found = np.array([posterior[p] > 0.5 for p in of])
    assert found[code].mean() < 0.1 and found[bad].mean() > 0.8 and accuracy[[1, 4]].max() < 0.8


def test_quality_agrees_with_labels_it_never_saw(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = quality.quality(docs).join(labels, "doc_id").select("quality", "keep").toPandas()
    assert got[got.quality == 1].keep.mean() > 0.995
    assert (~got[got.quality == 0].keep).mean() > 0.9


def test_quality_edge_cases(docs, rows, empty):
    got = quality.judged(docs)
    assert got.columns == ["row", "judged"] and got.select("row.*").columns == docs.columns
    out = got.select("row.doc_id", "row.text", "judged").collect()
    assert len(out) == len(rows) and all(0 <= r.judged.score <= 1 for r in out)
    blank = {r.judged.score for r in out if not (r.text or "").strip()}
    assert len(blank) == 1 and {r.judged.votes for r in out if not (r.text or "").strip()} == {"-" * len(quality.LABELLERS)}
    assert quality.quality(empty).collect() == []


def test_repeated_lines_of_plain_words_are_dropped(spark, monkeypatch):
    """Texts that cycle through a few words or repeat a line, whose words look like prose, with a posterior of bad."""
    bad = [j for j, (vote, _, _) in enumerate(quality.LABELLERS.values()) if vote == quality.BAD]
    posterior = lambda counts: {p: 0.95 if any(p // 3 ** j % 3 == quality.BAD for j in bad) else 0.05 for p in counts}
    monkeypatch.setattr(quality, "expectation_maximisation", lambda counts: (None, posterior(counts)))
    rng = np.random.default_rng(6)
    words = np.array(["".join(rng.choice(list("aeioulnrst"), rng.integers(2, 9))) for _ in range(400)])
    prose = [" ".join(rng.choice(words, rng.integers(60, 200))) for _ in range(900)]
    cycle = [" ".join(np.tile(rng.choice(words, 6, replace=False), 20)) for _ in range(40)]
    line = ["\n".join([" ".join(rng.choice(words, 7, replace=False))] * 200) for _ in range(40)]
    loud = [" ".join(w + "!!" for w in rng.choice(words, 60)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(prose + cycle + line + loud)), "doc_id long, text string")
    keep = {r.doc_id: r.keep for r in quality.quality(docs).collect()}
    keep = np.array([keep[i] for i in range(1020)])
    assert keep[:900].mean() > 0.99 and not keep[900:940].any() and not keep[940:980].any() and not keep[980:].any()


# --- URL rules -----------------------------------------------------------------------------------

URLS = ([f"http://blog.x{i % 3}.example.{t}/{lang}/{i}{end}" for i in range(40) for t, lang, end in
         [("com", "de", ""), ("com", "fr", "?a=1&b=2"), ("org", "en", "#f"), ("net", "de", "/"), ("net", "es", ""), ("org", "es", "?a=1")]]
        + [None, "", "no scheme", "HTTP://A.EXAMPLE.ORG/en/1x?q", "x://org", "x://org/", "x://notorg/", "://example.org/es/", "a://b?c://d/e",
           "http://EXAMPLE.com/DE/", "http://example.com/de/\nline", "http://sub.example.org/en/1"])


def plain_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
        host = host.translate(str.maketrans(urls.UPPER, urls.LOWER))
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_verdicts_match_plain_mining(spark):
    df = spark.createDataFrame([(i, u, "a", "b") for i, u in enumerate(URLS)] + [(0, URLS[0], "a", "b"), (None, None, "a", "b")],
                               "page_id long, url string, host string, toks string")
    got = urls.judge(df).collect()
    assert len(got) == len(URLS) + 2
    fixed = {u: plain_rule(u) for u in URLS}
    # itemsets by enumeration
    rows = df.select("url", urls.tokens(df.url, *urls.host_path(df.url)).alias("t")).collect()
    sets = [(frozenset(r.t), fixed[r.url][3]) for r in rows if fixed[r.url][3]]
    count = {}
    for s, v in sets:
        for k in range(1, len(s) + 1):
            for c in combinations(sorted(s), k):
                count.setdefault(c, {"allow": 0, "block": 0})[v] += 1
    rules = {}
    for c, n in count.items():
        for v in n:
            if n[v] >= urls.SUPPORT * len(sets) and n[v] / sum(n.values()) >= urls.CONFIDENCE:
                rules[c] = (round(n[v] / sum(n.values()), 9), round(n[v] / len(sets), 9), len(c), v)
    kept = {c: r for c, r in rules.items()
            if not any(c[:i] + c[i + 1:] in rules and rules[c[:i] + c[i + 1:]][3] == r[3] and rules[c[:i] + c[i + 1:]][0] >= r[0] for i in range(len(c)))}
    toks = {r.url: frozenset(r.t) for r in rows}
    url_of = {i: u for i, u in enumerate(URLS)}
    for r in got:
        u = url_of.get(r.page_id)
        host, path, rule, verdict = fixed[u]
        hits = [v for c, v in kept.items() if set(c) <= toks[u]]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or (max(hits)[3] if hits else urls.DEFAULT))
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}


def test_urls_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in urls.judge(df).collect()} == {"allow"}
    assert urls.judge(df.limit(0)).collect() == []


# --- nearest neighbours --------------------------------------------------------------------------

def exact(ids, x, q, top=20):
    s = x @ x[q]
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:top]
    return [(int(ids[i]), float(s[i])) for i in order]


@pytest.mark.parametrize("n", [30, 3000])
def test_neighbours(spark, monkeypatch, n):
    monkeypatch.setattr(hnsw, "SHARDS", 2)  # 3000: graphs of several layers
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 16)).astype(np.float32) * rng.uniform(0.2, 3, (n, 1)).astype(np.float32)
    x[n // 2:n // 2 + n // 3] = x[0]  # a third are copies
    ids = rng.permutation(3 * n)[:n]
    bad = [(900_000, None), (900_020, [0.0] * 16), (900_040, [float("nan")] * 16), (900_060, [None] + [1.0] * 15),
           (900_080, [float("inf")] * 16), (900_100, [1.0] * 3), (None, [1.0] * 16), (900_120, [])]
    data = [(int(i), v.tolist(), 1, "a") for i, v in zip(ids, x)] + [(i, v, 1, "a") for i, v in bad]
    data += [data[0], data[n // 2]]  # repeated rows
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, score string")
    got = {}
    for r in hnsw.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    queries = [k for k in range(n) if ids[k] % 20 == 0]
    assert set(got) == {int(ids[k]) for k in queries}
    recall = []
    for k in queries:
        mine, want = got[int(ids[k])], exact(ids, x.astype(np.float64), k)
        assert [m[0] for m in mine] == list(range(1, len(want) + 1))
        assert mine == sorted(mine, key=lambda m: (-m[2], m[1]))
        score = dict(zip(ids.tolist(), (x.astype(np.float64) @ x[k].astype(np.float64)).tolist()))
        assert all(abs(score[v] - s) < 1e-9 for _, v, s in mine)
        least = want[-1][1] - 1e-9
        recall.append(sum(s >= least for _, _, s in mine) / len(want))
        if n == 30:
            assert [m[1] for m in mine] == [w[0] for w in want]
    assert np.mean(recall) >= 0.95
    assert hnsw.nearest(df.limit(0)).collect() == []


def test_layers_above_the_brute_size(monkeypatch):
    """Upper layers with more nodes than the layer below holds while it is built."""
    monkeypatch.setattr(hnsw, "SMALL", 16)
    x = np.random.default_rng(1).normal(size=(4000, 12))
    v = hnsw._lift(x, float(np.linalg.norm(x, axis=1).max()))
    g = hnsw.build(v, 1)
    assert len(g.sizes) > 2 and g.sizes[1] > 16
    for size, nbr in zip(g.sizes, g.layers):
        assert nbr.max() < size and all(len(set(r[r >= 0])) == (r >= 0).sum() for r in nbr)
    q = np.hstack((x[:200], np.zeros((200, 1)))).astype(np.float32)
    found = g.search(v, q, 96)
    recall = [len(set(f.tolist()) & set(np.argsort(-(x @ x[i]))[:20].tolist())) / 20 for i, f in enumerate(found)]
    assert np.mean(recall) > 0.95


def recall_of(spark, ids, x):
    """Recall of all queries against brute force; x: float64, products within range."""
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = {}
    for r in hnsw.nearest(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    queries = [k for k in range(len(ids)) if ids[k] % 20 == 0]
    want = [{w[0] for w in exact(ids, x, k)} for k in queries]
    return np.mean([len(got[int(ids[k])] & w) / len(w) for k, w in zip(queries, want)])


@pytest.mark.parametrize("kind", ["long", "close", "spread"])
def test_neighbours_of_uneven_vectors(spark, monkeypatch, kind):
    """A few vectors of 1000 and 10000 times the usual length, close clusters, lengths over many powers."""
    monkeypatch.setattr(hnsw, "SHARDS", 2)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "long":
        x[5:8] *= 1000
        x[100:103] *= 10000
    elif kind == "close":
        x = x[rng.integers(0, 4, 4000)] + 1e-4 * rng.normal(size=x.shape)
    else:
        x *= 10.0 ** rng.uniform(-40, 40, (4000, 1))
    assert recall_of(spark, np.arange(4000), x) > 0.95


def test_products_beyond_doubles(spark):
    data = [(0, [1e200, 0.0]), (1, [2e200, 1.0]), (2, [3e200, -1e200]), (3, [-1e200, 1e200]), (4, [1e-200, 0.0]), (5, [4e200, 1e308])]
    got = hnsw.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(5, np.inf), (2, np.inf), (1, np.inf), (4, 1.0), (3, -np.inf)]


def test_recall_of_a_full_shard():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(hnsw.SHARD, 64))
    v = hnsw._lifted(x)
    found = hnsw.build(v, 1).search(v, np.hstack((x[:200], np.zeros((200, 1)))), hnsw.SEARCH_BEAM)
    recall = [len(set(f.tolist()) & set(np.argsort(-(x @ q))[:20].tolist())) / 20 for f, q in zip(found, x)]
    assert np.mean(recall) > 0.9


# --- pipeline ------------------------------------------------------------------------------------

def test_pipeline_stages(spark, sf):
    """Each stage on all that the one before kept, against plain versions of its decision."""
    import corpus_pipeline as p

    from .conftest import words_of
    from .test_rows import brute_fingerprint, brute_groups

    docs = table(spark, sf, "documents")
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    out = {}
    for name, stage in p.STAGES:
        prev, docs = docs, p.written(stage(spark, docs, sf), name)
        out[name] = (prev.collect(), docs.collect())
        if name != "token_output":
            assert docs.columns == prev.columns
    judged = {r.doc_id: r.keep for r in quality.quality(table(spark, sf, "documents")).collect()}
    before, after = out["quality_classifier"]
    assert sorted(r.doc_id for r in after) == sorted(k for k, v in judged.items() if v) and len(after) < len(before)
    before, after = out["simhash_near_dedup"]
    groups = brute_groups([brute_fingerprint(r.text) for r in before])
    least = {}
    for r, g in zip(before, groups):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(least.values())
    before, after = out["benchmark_decontamination"]
    windows = {tuple(w[i:i + 10]) for _, t in items for w in [words_of(t)] for i in range(max(1, len(w) - 9)) if w}
    hit = lambda w: any(tuple(w[i:i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if not hit(words_of(r.text)))
    before, after = out["source_mixing"]
    text = {r.doc_id: r for r in before}
    assert all(text[r.doc_id] == r for r in after)
    count = {}
    for r in after:
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert max(count.values()) <= 3
    before, after = out["token_output"]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before)
    at = 0
    for r in sorted(after, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_quality_pieces_are_small(rows):
    """The arrays of a piece of 4 MB took 200 MB of a Python worker, of which an executor has one a core."""
    texts = pa.array([t for _, t, _ in rows if t] * 60)
    tracemalloc.start()
    try:
        votes = [s.votes() for s in quality._pieces(texts) if s.features().size]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert texts.nbytes > 8 << 20 and sum(map(len, votes)) == len(texts)
    assert peak < 80 << 20


def test_a_walk_looks_products_up(monkeypatch):
    """Every step of a walk gathered the vectors it met and multiplied them again."""
    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((300, 8)), rng.standard_normal((5, 8))
    near = np.argsort(-(x @ x.T), axis=1)[:, 1:13]
    monkeypatch.setattr(hnsw.np, "einsum", None)
    ids, sims = hnsw.beam_search(x, near, q, np.tile(np.arange(0, 300, 10), (5, 1)), 64)
    assert (np.diff(sims, axis=1) <= 0).all()
    for i in range(5):
        assert np.allclose(sims[i], x[ids[i]] @ q[i]) and len(set(ids[i].tolist())) == 64
    want = np.argsort(-(q @ x.T), axis=1)[:, :10]
    assert sum(len(set(a) & set(b)) for a, b in zip(want.tolist(), ids[:, :10].tolist())) >= 45
