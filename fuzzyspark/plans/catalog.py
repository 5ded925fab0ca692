"""Registered queries: Spark callables and their DuckDB oracle SQL.

Every query reads the driver tables (``pages`` for the fuzzy-join inputs,
the other tables for the data-preparation operators).  Queries with a SQL
twin use the unstemmed text methods (stemming is not SQL-expressible); the
stemmed ones are checked by pytest instead.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fuzzyspark.functions import distances as D
from fuzzyspark.functions.text import (block_tokens, preprocess, split_by_space, three_gram)
from fuzzyspark.operators import blocking as B
from fuzzyspark.operators import datasets as DS
from fuzzyspark.operators import entities as EN
from fuzzyspark.operators import evaluate as E
from fuzzyspark.operators import greedy as G
from fuzzyspark.operators import model as M
from fuzzyspark.operators import precision as P
from fuzzyspark.operators import prep as PR
from fuzzyspark.operators import rules as NR
from fuzzyspark.operators import validate as VA
from fuzzyspark.operators.pairs import PairSpace, to_long
from fuzzyspark.operators.reference import HeldReference
from fuzzyspark.operators.space import from_name, resolve
from fuzzyspark.plans import sqlparts as S
from fuzzyspark.session import checkpoint_dir
from fuzzyspark.sources import views as V

R6 = 6
# The literal join (UOC) used by the predict-family queries.
UOC = [("lower_threeGram_idfWeight_jaccardDistance", 0.35),
       ("lower_splitBySpace_idfWeight_maxincDistance", 0.25)]
DIST_QUERIES = {
    "dist_jaccard": "lower_threeGram_idfWeight_jaccardDistance",
    "dist_cosine": "lower_threeGram_idfWeight_cosineDistance",
    "dist_dice": "lower_splitBySpace_uniformWeight_diceDistance",
    "dist_maxinc": "lower_splitBySpace_idfWeight_maxincDistance",
    "dist_intersect": "lowerRemovePunctuation_threeGram_uniformWeight_intersectDistance",
    "dist_contain_jaccard": "lower_splitBySpace_idfWeight_containJaccardDistance",
    "dist_contain_cosine": "lower_threeGram_uniformWeight_containCosineDistance",
    "dist_contain_dice": "lowerRemovePunctuation_splitBySpace_idfWeight_containDiceDistance",
    "empty_fill": "lowerRemovePunctuation_splitBySpace_uniformWeight_jaccardDistance",
}
PRECISION_JFS = [j for j, _ in UOC]
# Rules given beforehand to the query on pre-trained rules.
PRETRAINED = [("red", "blue"), ("blue", "red"), ("small", "hot"), ("hot", "small")]
# The kinds of events, one column each.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def _lr(spark, d):
    return V.fj_left(spark, d), V.fj_right(spark, d)


def _blocked(spark, d, stem=False):
    L, R = _lr(spark, d)
    ll, lr, lnorm, rnorm = B.block_pairs(B.TokenBlocker(stem=stem), L, R, "id", ["title"])
    return L, R, ll, lr, lnorm, rnorm


def _r(c, n=R6):
    return F.round(F.col(c), n).alias(c)


# ---------------------------------------------------------------- blocking
def q_block_normalize(spark, d):
    t = V.page_titles(spark, d)
    return B.normalize_records(t, "id", ["title"], stem=False)


def _lnorm(spark, d):
    L, _ = _lr(spark, d)
    return B.normalize_records(L, "id", ["title"], stem=False), L.count()


def q_block_tokens(spark, d):
    ln, _ = _lnorm(spark, d)
    return (ln.where(F.length("value") > 0).select("id", F.explode(block_tokens("value")).alias("token"))
            .groupBy("id", "token").agg(F.count(F.lit(1)).alias("cnt")))


def q_token_tf(spark, d):
    ln, _ = _lnorm(spark, d)
    toks = (ln.where(F.length("value") > 0).select(F.col("id").alias("id_l"), F.explode(block_tokens("value")).alias("token"))
            .groupBy("id_l", "token").agg(F.count(F.lit(1)).alias("cnt")))
    tot = toks.groupBy("id_l").agg(F.sum("cnt").alias("len"))
    return toks.join(tot, "id_l").select("id_l", "token", F.round(F.col("cnt") / F.col("len"), 9).alias("tf"))


def q_token_idf(spark, d):
    ln, n = _lnorm(spark, d)
    post = B.left_postings(ln, n)
    return post.select("token", "df").distinct().select(
        "token", "df", F.round(F.log(F.lit(float(n)) / (F.col("df") + 1)), 9).alias("idf"))


def q_bm25_stats(spark, d):
    ln, n = _lnorm(spark, d)
    post = B.left_postings(ln, n, "bm25")
    nq = F.col("df") + 1
    return post.select("token", "df").distinct().select(
        "token", "df", F.round(F.log((F.lit(float(n)) - nq + 0.5) / (nq + 0.5) + 1), 9).alias("idf"))


def q_token_join(spark, d):
    L, R = _lr(spark, d)
    ln = B.normalize_records(L, "id", ["title"], stem=False)
    rn = B.normalize_records(R, "id", ["title"], stem=False)
    post = B.left_postings(ln, L.count())
    return B.token_join(B.right_tokens(rn), post, by_pair=True).select("id_l", "id_r", F.col("n").alias("n_shared"))


def q_block_score(spark, d):
    L, R = _lr(spark, d)
    ln = B.normalize_records(L, "id", ["title"], stem=False)
    rn = B.normalize_records(R, "id", ["title"], stem=False)
    return B.block_scores(ln, rn, L.count()).select("id_l", "id_r", _r("score"))


def _block(spark, d, weighting="tfidf", self_block=False):
    L, R = _lr(spark, d)
    ln = B.normalize_records(L, "id", ["title"], stem=False).persist()
    rn = ln if self_block else B.normalize_records(R, "id", ["title"], stem=False).persist()
    out = B.block_normalized(ln, rn, ln.count(), weighting=weighting, keep_score=True)
    if self_block:
        out = out.where(F.col("id_l") != F.col("id_r"))
    return out.select("id_l", "id_r", _r("score"))


def q_block_tfidf(spark, d):
    return _block(spark, d)


def q_block_self(spark, d):
    return _block(spark, d, self_block=True)


def q_block_bm25(spark, d):
    return _block(spark, d, "bm25")


def q_block_bm25_compat(spark, d):
    return _block(spark, d, "bm25_compat")


def q_block_lookup(spark, d):
    L, R = _lr(spark, d)
    lookup = B.normalize_records(L, "id", ["title"], stem=False).select(
        F.col("value").alias("key"), F.col("id").alias("id_l"),
        F.row_number().over(Window.partitionBy("value").orderBy("id")).alias("ordinal"))
    return B.LookupBlocker(lookup, B.default_k(L.count())).block(L, R, "id", ["title"])


def q_block_custom(spark, d):
    L, R = _lr(spark, d)
    return B.WordSetBlocker().block(L, R, "id", ["title"])


def q_block_minhash(spark, d):
    L, R = _lr(spark, d)
    return B.MinHashBlocker(0.6, stem=False).block(L, R, "id", ["title"], keep_score=True).select("id_l", "id_r", _r("jaccard"))


# ------------------------------------------------------------ text / tokens
def q_prep_lower(spark, d):
    t = V.page_titles(spark, d)
    return t.select("id", preprocess(F.coalesce("title", F.lit("nan")), "lower").alias("value"))


def q_prep_lower_nopunct(spark, d):
    t = V.page_titles(spark, d)
    return t.select("id", preprocess(F.coalesce("title", F.lit("nan")), "lowerRemovePunctuation").alias("value"))


def q_prep_lower_stem(spark, d):
    t = V.page_titles(spark, d)
    return t.select("id", preprocess(F.coalesce("title", F.lit("nan")), "lowerStem").alias("value"))


def q_prep_full(spark, d):
    t = V.page_titles(spark, d)
    return t.select("id", preprocess(F.coalesce("title", F.lit("nan")), "lowerRemovePunctuationStem").alias("value"))


def q_stem_tokens(spark, d):
    t = V.page_titles(spark, d)
    words = t.select(F.explode(split_by_space(F.lower("title"))).alias("token")).distinct()
    return words.select("token", preprocess(F.col("token"), "lowerStem").alias("stem"))


def _tok_counts(spark, d, fn):
    t = V.page_titles(spark, d)
    return (t.select("id", F.explode(fn(F.lower("title"))).alias("token"))
            .groupBy("id", "token").agg(F.count(F.lit(1)).alias("cnt")))


def q_tok_words(spark, d):
    return _tok_counts(spark, d, split_by_space)


def q_tok_trigram(spark, d):
    return _tok_counts(spark, d, three_gram)


def q_idf_weight(spark, d):
    L, _ = _lr(spark, d)
    n = L.count()
    toks = L.select("id", F.explode(three_gram(F.lower("title"))).alias("token")).distinct()
    return toks.groupBy("token").agg(F.count(F.lit(1)).alias("df")).select(
        "token", F.round(F.log(F.lit(float(n)) / (F.col("df") + 1)), 9).alias("w"))


def q_token_set_ops(spark, d):
    L, R, ll, lr, _, _ = _blocked(spark, d)
    ls = L.select(F.col("id").alias("id_l"), F.array_distinct(split_by_space(F.lower("title"))).alias("x"))
    rs = R.select(F.col("id").alias("id_r"), F.array_distinct(split_by_space(F.lower("title"))).alias("y"))
    j = lr.join(ls, "id_l").join(rs, "id_r")
    return j.select("id_l", "id_r", F.size(F.array_intersect("x", "y")).cast("long").alias("n_inter"),
                    F.size(F.array_union("x", "y")).cast("long").alias("n_union"),
                    F.size(F.array_except("x", "y")).cast("long").alias("n_l_only"),
                    F.size(F.array_except("y", "x")).cast("long").alias("n_r_only"))


def q_contain_join(spark, d):
    L, R = _lr(spark, d)
    words = lambda df: df.select("id", F.array_distinct(split_by_space(F.lower("title"))).alias("toks"))
    return B.containment_pairs(words(L), words(R))


# ------------------------------------------------- whole texts of documents
def _doc_text(spark, d, name="documents", id_col="doc_id"):
    return V.table(spark, d, name).select(F.col(id_col).alias("id"), F.coalesce("text", F.lit("nan")).alias("text"))


def q_doc_prep_lower_nopunct(spark, d):
    return _doc_text(spark, d).select("id", preprocess(F.col("text"), "lowerRemovePunctuation").alias("value"))


def q_doc_block_normalize(spark, d):
    return B.normalize_records(_doc_text(spark, d), "id", ["text"], stem=False)


def q_doc_words(spark, d):
    return (_doc_text(spark, d).select("id", F.explode(split_by_space(F.lower("text"))).alias("token"))
            .groupBy("id", "token").agg(F.count(F.lit(1)).alias("cnt")))


def q_doc_idf(spark, d):
    docs = _doc_text(spark, d)
    n = F.lit(float(docs.count()))
    words = docs.select("id", F.explode(F.array_distinct(split_by_space(F.lower("text")))).alias("token"))
    return words.groupBy("token").agg(F.round(F.log(n / (F.count(F.lit(1)) + 1)), 9).alias("w"))


def q_doc_benchmark_words(spark, d):
    """Words that documents and benchmark items share, with both frequencies."""
    freq = lambda df, name: (df.select(F.explode(F.array_distinct(split_by_space(F.lower("text")))).alias("token"))
                             .groupBy("token").agg(F.count(F.lit(1)).alias(name)))
    return freq(_doc_text(spark, d), "n_docs").join(freq(_doc_text(spark, d, "benchmark", "item_id"), "n_items"), "token")


# ---------------------------------------------------------------- distances
def _one_distance(spark, d, jf_name):
    L, R, ll, lr, _, _ = _blocked(spark, d)
    ps = PairSpace(L, R, "id", ["title"], [from_name(jf_name)], stem=False)
    wide = ps.pair_distances(None, lr)
    return wide.select("id_l", "id_r", F.round("d0_0", R6).alias("d"))


def _make_dist(jf_name):
    return lambda spark, d: _one_distance(spark, d, jf_name)


def q_pair_distance(spark, d):
    L, R, ll, lr, _, _ = _blocked(spark, d)
    jfs = [from_name(n) for n in PRECISION_JFS + ["lower_threeGram_idfWeight_cosineDistance"]]
    ps = PairSpace(L, R, "id", ["title"], jfs, stem=False)
    wide = ps.pair_distances(ll, lr)
    return wide.select("side", "id_l", "id_r", F.round("d0_0", R6).alias("d_jaccard"),
                       F.round("d1_0", R6).alias("d_maxinc"), F.round("d2_0", R6).alias("d_cosine"))


def q_dist_edit(spark, d):
    return _one_distance(spark, d, "lower_None_None_editDistance")


def q_dist_jaro(spark, d):
    return _one_distance(spark, d, "lower_None_None_jaroDistance")


def q_weighted_distance(spark, d):
    L, R = V.fj_left(spark, d, True), V.fj_right(spark, d, True)
    ll, lr, _, _ = B.block_pairs(B.TokenBlocker(stem=False), L, R, "id", ["title", "lang"])
    ps = PairSpace(L, R, "id", ["title", "lang"], [from_name(PRECISION_JFS[0])], stem=False)
    wide = ps.pair_distances(None, lr)
    w = D.weighted_distance({"title": F.col("d0_0"), "lang": F.col("d0_1")}, {"title": 0.7, "lang": 0.3})
    return wide.select("id_l", "id_r", F.round(w, R6).alias("d"))


def _vec_pairs(spark, d):
    e = V.table(spark, d, "embeddings")
    w = Window.partitionBy("label").orderBy("vec_id")
    e = e.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("a"),
                 F.lead("vec_id").over(w).alias("vec_id_2"),
                 F.lead(F.transform("embedding", lambda x: x.cast("double"))).over(w).alias("b"))
    return e.where(F.col("b").isNotNull())


def q_dist_embed_cosine(spark, d):
    p = _vec_pairs(spark, d)
    return p.select("vec_id", "vec_id_2", F.round(D.embed_cosine_distance(F.col("a"), F.col("b")), R6).alias("d"))


def q_dist_embed_l2(spark, d):
    p = _vec_pairs(spark, d)
    return p.select("vec_id", "vec_id_2", F.round(D.embed_l2_distance(F.col("a"), F.col("b")), R6).alias("d"))


def q_dist_typed(spark, d):
    e = V.table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.select("event_id", F.col("ts").cast("string").alias("x"), F.col("event_type").alias("u"),
                 F.lead("event_id").over(w).alias("event_id_2"),
                 F.lead(F.col("ts").cast("string")).over(w).alias("y"),
                 F.lead("event_type").over(w).alias("v")).where(F.col("event_id_2").isNotNull())
    return e.select("event_id", "event_id_2", F.round(D.typed_distance(F.col("x"), F.col("y")), R6).alias("d_ts"),
                    F.round(D.typed_distance(F.col("u"), F.col("v")), R6).alias("d_type"))


# ------------------------------------------------------- rules & precision
def q_negative_rule_learn(spark, d):
    L, R, ll, lr, lnorm, rnorm = _blocked(spark, d)
    return NR.learn(ll, NR.token_sets(L, "id", ["title"], stem=False))


def q_negative_rule_apply(spark, d):
    L, R, ll, lr, lnorm, rnorm = _blocked(spark, d)
    ls = NR.token_sets(L, "id", ["title"], stem=False)
    rs = NR.token_sets(R, "id", ["title"], stem=False)
    return NR.apply(lr, ls, rs, NR.learn(ll, ls))


def _part_rules(spark, d):
    """Parts by name and brand, which differ by single words; even keys are L."""
    p = V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("title"))
    L, R = p.where("id % 2 = 0"), p.where("id % 2 = 1")
    ll, lr, _, _ = B.block_pairs(B.TokenBlocker(stem=False), L, R, "id", ["title"])
    ls, rs = (NR.token_sets(x, "id", ["title"], stem=False) for x in (L, R))
    return ll, lr, ls, rs


def q_negative_rule_parts_learn(spark, d):
    ll, _, ls, _ = _part_rules(spark, d)
    return NR.learn(ll, ls)


def q_negative_rule_parts(spark, d):
    ll, lr, ls, rs = _part_rules(spark, d)
    return NR.apply(lr, ls, rs, NR.learn(ll, ls))


def q_negative_rule_pretrained(spark, d):
    ll, lr, ls, rs = _part_rules(spark, d)
    given = spark.createDataFrame(PRETRAINED, "a string, b string")
    return NR.apply(lr, ls, rs, NR.merge(given, NR.learn(ll, ls)))


def _prepared(spark, d, jf_names, pretrained=None):
    L, R = _lr(spark, d)
    return M.prepare(L, R, "id", ["title"], [from_name(n) for n in jf_names], None, pretrained,
                     stem=False)


def _precision_parts(spark, d, fixed=None):
    prep = _prepared(spark, d, PRECISION_JFS)
    dist = P.weighted(prep.long, 1, [1.0])
    near = P.nearest(dist)
    ts = fixed or P.threshold_grid(near, P.linspace(50))
    thr = P.threshold_table(spark, ts)
    balls = P.ball_counts(dist, near, thr)
    return dist, near, thr, balls


def q_nearest_left(spark, d):
    _, near, _, _ = _precision_parts(spark, d)
    return near.select("jf", "id_r", "id_l", _r("d"))


def q_threshold_grid(spark, d):
    _, _, thr, _ = _precision_parts(spark, d)
    return thr.select("jf", F.posexplode("ts").alias("ti", "t")).select("jf", "ti", _r("t"))


def q_ball_count(spark, d):
    _, _, thr, balls = _precision_parts(spark, d)
    return (balls.select("jf", "proxy", F.posexplode("cum").alias("ti", "cnt"))
            .where(F.col("cnt") > 0).select("jf", "proxy", "ti", (F.col("cnt") + 1).alias("n_ball")))


def q_local_precision(spark, d):
    _, near, thr, balls = _precision_parts(spark, d)
    m = P.local_precision(near, balls, thr)
    return (m.select("jf", "id_r", "id_l", F.posexplode("ps").alias("ti", "p"))
            .where(F.col("p").isNotNull()).select("jf", "ti", "id_r", "id_l", _r("p")))


def _ts_of(thr):
    return {r["jf"]: r["ts"] for r in thr.collect()}


def q_config_profit(spark, d):
    _, near, thr, balls = _precision_parts(spark, d)
    nt = max(len(v) for v in ts.values()) if (ts := _ts_of(thr)) else 1
    g = G.materialize_G(P.per_r(P.local_precision(near, balls, thr)), False, len(ts), nt)
    rows = G.config_gains(g, [], nt)
    out = [(j, t, float(tp), int(n), float(tp / (n - tp + 1e-9)), float(tp / (n + 1e-9))) for j, t, tp, n in rows]
    df = spark.createDataFrame(out, "j int, ti int, tp double, n long, profit double, prec double")
    names = thr.select("j", "jf")
    return df.join(names, "j").select("jf", "ti", _r("tp"), "n", _r("profit"), _r("prec"))


def q_threshold_join(spark, d):
    _, near, _, _ = _precision_parts(spark, d)
    jf, t = UOC[0]
    return near.where((F.col("jf") == jf) & (F.col("d") <= t)).select("id_l", "id_r", _r("d"))


def q_threshold_join_full(spark, d):
    """Every pair within the threshold: the Jaccard similarity of two records
    is at most the shared part of r's weight, so candidates share 1 - t of it."""
    L, R = _lr(spark, d)
    jf, t = UOC[0]
    n = F.lit(float(L.count()))
    grams = lambda df: df.select("id", F.explode(F.array_distinct(three_gram(
        preprocess(F.coalesce("title", F.lit("nan")), "lower")))).alias("token"))
    idf = grams(L).groupBy("token").agg(F.log(n / (F.count(F.lit(1)) + 1)).alias("idf"))
    weigh = lambda df: grams(df).join(idf, "token", "left").select(
        "id", "token", F.greatest(F.coalesce("idf", F.log(n)), F.lit(0.0)).alias("w"))
    # tokens of every L record weigh less than nothing in the distance: their weight can make up for as much of the share
    below = idf.agg(F.sum(F.least("idf", F.lit(0.0)))).first()[0] or 0.0
    pairs = B.overlap_pairs(weigh(L), weigh(R), 1 - t, -below)
    wide = PairSpace(L, R, "id", ["title"], [from_name(jf)], stem=False).pair_distances(None, pairs)
    return wide.where(F.col("d0_0") <= t).select("id_l", "id_r", F.round("d0_0", R6).alias("d"))


def _uoc_model(spark):
    return M.FuzzyJoinModel(UOC, {"title": 1.0}, None, None, {"on": ["title"], "stem": False})


def _predict_pairs(spark, d):
    L, R = _lr(spark, d)
    return M.predict_matches(_uoc_model(spark), L, R, "id")


def q_predict(spark, d):
    L, R = _lr(spark, d)
    m = _predict_pairs(spark, d)
    return M.materialize(m, L, R, "id", distinct=True)


def q_predict_held(spark, d):
    """The join of ``predict`` against a kept state of L, read back from its tables."""
    L, R = _lr(spark, d)
    model = _uoc_model(spark)
    held = M.hold(model, L, "id")
    return M.predict(model, HeldReference.load(spark, held.path), R, "id")


def q_evaluate(spark, d):
    c = E.counts(V.fj_gt(spark, d), _predict_pairs(spark, d))
    p = F.col("n_tp") / F.col("n_pred")
    r = F.col("n_tp") / F.col("n_gt")
    return c.select("n_pred", "n_gt", "n_tp", F.round(p, R6).alias("precision"), F.round(r, R6).alias("recall"),
                    F.round(2 * p * r / (p + r), R6).alias("f1"))


def q_tp_fp_fn(spark, d):
    tp, fp, fn = E.tp_fp_fn(V.fj_gt(spark, d), _predict_pairs(spark, d))
    return (tp.withColumn("kind", F.lit("tp")).unionByName(fp.withColumn("kind", F.lit("fp")))
            .unionByName(fn.withColumn("kind", F.lit("fn"))))


def q_error_report(spark, d):
    L, R = _lr(spark, d)
    tpfpfn = q_tp_fp_fn(spark, d)
    return PR.enrich_pairs(tpfpfn, L, R, "id")


# ----------------------------------------------------------- fit (rows only)
def q_fuzzy_join(spark, d):
    L, R = _lr(spark, d)
    return M.fit(L, R, "id")[1]


def q_greedy_select(spark, d):
    L, R = _lr(spark, d)
    model, _ = M.fit(L, R, "id")
    rows = [(k, jf, float(t)) for k, (jf, t) in enumerate(model.configs or [])]
    return spark.createDataFrame(rows, "k int, jf string, threshold double")


def q_multi_column_join(spark, d):
    L, R = V.fj_left(spark, d, True), V.fj_right(spark, d, True)
    return M.fit(L, R, "id", on=["title", "lang"])[1]


def q_model_roundtrip(spark, d):
    import uuid
    from fuzzyspark.session import checkpoint_dir
    L, R = _lr(spark, d)
    model, _ = M.fit(L, R, "id")
    path = f"{checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    model.save(spark, path)
    return M.predict(M.FuzzyJoinModel.load(spark, path), L, R, "id")


def q_featurize(spark, d):
    L, R = _lr(spark, d)
    prep = M.prepare(L, R, "id", ["title"], resolve("sm"))
    return prep.long.select("side", "id_l", "id_r", "jf", F.round("d_0", R6).alias("d"))


def q_cross_validate(spark, d):
    L, R = _lr(spark, d)
    return VA.cross_validate(L, R, V.fj_gt(spark, d), "id", n_splits=5)


def q_learning_curve(spark, d):
    L, R = _lr(spark, d)
    return VA.learning_curve(L, R, V.fj_gt(spark, d), "id")


# ------------------------------------------------------ splits and data prep
def q_train_test_split(spark, d):
    L, R = _lr(spark, d)
    return VA.split_assignment(L, R, "id", train_size=0.75, seed=0)


def q_kfold(spark, d):
    L, R = _lr(spark, d)
    return VA.fold_assignment(L, R, "id", n_splits=5, seed=0)


def q_gt_semijoin(spark, d):
    L, R = _lr(spark, d)
    a = VA.split_assignment(L, R, "id", train_size=0.75, seed=0)
    ltr = a.where((F.col("side") == "L") & (F.col("part") == "train")).select("id")
    rtr = a.where((F.col("side") == "R") & (F.col("part") == "train")).select("id")
    return VA.restrict_gt(V.fj_gt(spark, d), ltr, rtr, "id")


def q_augment_left(spark, d):
    L, R = _lr(spark, d)
    return M.augment(L, R.select("id", "title"))


def q_augment_fraction(spark, d):
    _, R = _lr(spark, d)
    return VA.head_fraction(R, "id", 0.7, seed=0)


def q_distinct_rows(spark, d):
    return V.page_titles(spark, d).select("title", "lang").distinct()


def q_dropna_all(spark, d):
    return PR.dropna(PR.nullable_titles(spark, d), "all", ["title", "lang"])


def q_dropna_any(spark, d):
    return PR.dropna(PR.nullable_titles(spark, d), "any", ["title", "lang"])


def q_label_filter(spark, d):
    return PR.label_filter(V.table(spark, d, "labels"), "quality", [1])


def q_collapse_values(spark, d):
    return PR.collapse_values(V.table(spark, d, "conversations"), ["conv_id", "role"], "text", " | ")


def q_uri_tail(spark, d):
    return PR.uri_tail(V.table(spark, d, "pages"), "page_id", "url")


def q_pivot_props(spark, d):
    return PR.pivot_props(V.table(spark, d, "events"), "user_id", "event_type", "value", EVENT_TYPES)


def q_variant_project(spark, d):
    return PR.variant_project(V.page_titles(spark, d), "id", ["title", "lang"], "2col")


def _variant(spark, d, variant):
    return PR.variant_project(PR.nullable_titles(spark, d).withColumn("lang", F.nullif("lang", F.lit("en"))),
                              "id", ["title", "lang"], variant)


def q_variant_1col(spark, d):
    return _variant(spark, d, "1col")


def q_variant_full(spark, d):
    return _variant(spark, d, "full")


def q_variant_pairs(spark, d):
    return _variant(spark, d, "2col")


def q_scores(spark, d):
    return E.metrics(V.fj_gt(spark, d), _predict_pairs(spark, d)).select(
        "n_pred", "n_gt", "n_tp", _r("precision"), _r("recall"), _r("fscore"))


def q_grid_search(spark, d):
    L, R = _lr(spark, d)
    return VA.grid_search(L, R, V.fj_gt(spark, d), "id", {"precision_target": [0.8, 0.9]}, n_splits=2, stable_left=True)[0]


def q_label_lookup(spark, d):
    return PR.label_lookup(V.table(spark, d, "nation"), V.table(spark, d, "region"))


def q_gt_enrich(spark, d):
    L, R = V.fj_left(spark, d, True), V.fj_right(spark, d, True)
    return PR.gt_enrich(V.fj_gt(spark, d).select("id_l", "id_r"), L, R, "id")


def q_table_fingerprint(spark, d):
    L, R = _lr(spark, d)
    return PR.fingerprint(L.unionByName(R))


IRI = "http://example.org"


def _claims(spark, d):
    """Events as claims of every shape, by event_id mod 7."""
    e = V.table(spark, d, "events")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    i, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    shapes = [text('"', kind, '"'), text('{"entity-type": "item", "id": "Q', u % 30, '"}'),
              text('{"time": "+', F.col("ts"), '"}'), text('{"latitude": ', i % 90, ', "longitude": ', u % 180, "}"),
              text('{"text": "', kind, '", "language": "en"}'),
              text('{"amount": "+', i, '", "unit": "', f"{IRI}/entity/Q", u % 30, '"}'),
              text('{"mainsnak": {"datavalue": {"value": "', kind, '"}}}')]
    claim = shapes[-1]
    for n, shape in enumerate(shapes[:-1]):
        claim = F.when(i % 7 == n, shape).otherwise(claim)
    return e.select("event_id", claim.alias("claim"))


def q_claim_text(spark, d):
    labels = V.table(spark, d, "nation").select(F.format_string("Q%d", "n_nationkey").alias("id"), F.col("n_name").alias("label"))
    return EN.claim_text(_claims(spark, d), "claim", labels, "text").select("event_id", "text")


def _triples(spark, d):
    """Customers and their orders as triples of IRIs and literals."""
    c, o = V.table(spark, d, "customer"), V.table(spark, d, "orders")
    iri = lambda tail, *cols: F.concat(F.lit(f"{IRI}/{tail}"), *[x.cast("string") for x in cols])
    row = lambda df, who, prop, value, kind, lang, order: df.select(
        iri("entity/Q", F.col(who)).alias("entity"), F.lit(prop).alias("property"), value.alias("value"),
        F.lit(kind).alias("kind"), lang.cast("string").alias("lang"), F.col(order).cast("long").alias("ord"))
    lang = F.when(F.col("o_orderkey") % 3 == 0, "en").when(F.col("o_orderkey") % 3 == 1, "de")
    none = F.lit(None)
    return (row(c, "c_custkey", "http://www.w3.org/2000/01/rdf-schema#label", F.col("c_name"), "literal", F.lit("en"), "c_custkey")
            .unionByName(row(c, "c_custkey", f"{IRI}/prop/P17", iri("entity/Q", F.col("c_nationkey")), "uri", none, "c_custkey"))
            .unionByName(row(c, "c_custkey", f"{IRI}/prop/P18", iri("entity/statement/", F.col("c_custkey")), "uri", none, "c_custkey"))
            .unionByName(row(o, "o_custkey", f"{IRI}/prop/P31", F.col("o_orderpriority"), "literal", lang, "o_orderkey"))
            .unionByName(row(o, "o_custkey", f"{IRI}/prop/homepage", iri("home/", F.col("o_orderkey")), "uri", none, "o_orderkey")))


def q_entity_rows(spark, d):
    n = V.table(spark, d, "nation")
    labels = (n.where(F.col("n_regionkey") != 0).select(F.format_string("Q%d", "n_nationkey").alias("id"), F.col("n_name").alias("label"))
              .unionByName(spark.createDataFrame([("P17", "country")], "id string, label string")))
    props = EN.entity_properties(_triples(spark, d), labels)
    return EN.property_columns(props, ["label", "country", "P18", "P31", "homepage"])


def _property_labels(spark, **names):
    return spark.createDataFrame(list(names.items()), "id string, label string")


def q_make_dataset(spark, d):
    """Orders as judged descriptions of their customers, whose claims are their segment, an id and the states of their orders."""
    c, o = V.table(spark, d, "customer"), V.table(spark, d, "orders")
    who = lambda k: F.format_string("Q%d", k)
    pages = c.where("c_custkey % 10 <> 9").select(F.col("c_name").alias("title"), who("c_custkey").alias("entity"))
    claim = lambda df, k, prop, json, order: df.select(
        who(k).alias("entity"), F.lit(prop).alias("property"), json.alias("claim"), F.col(order).cast("long").alias("ord"))
    quoted = lambda col: F.concat(F.lit('"'), col, F.lit('"'))
    state = F.concat(F.lit('{"language": "en", "text": "'), F.col("o_orderstatus"), F.lit('"}'))
    claims = (claim(c, "c_custkey", "P1", quoted("c_mktsegment"), "c_custkey")
              .unionByName(claim(c, "c_custkey", "P2", quoted(F.col("c_custkey").cast("string")), "c_custkey"))
              .unionByName(claim(o, "o_custkey", "P3", state, "o_orderkey")))
    labels = c.select(who("c_custkey").alias("id"), F.col("c_name").alias("label")).unionByName(
        _property_labels(spark, P1="segment", P2="VIAF ID", P3="state"))
    bare = F.col("o_orderkey") % 7 == 0
    judged = o.select(
        F.format_string("s%d", "o_orderkey").alias("subject_id"),
        F.format_string("https://example.org/wiki/Customer#%09d", "o_custkey").alias("page"),
        F.when(bare, "name").otherwise("name`status`status`order ID").alias("predicates"),
        F.when(bare, F.col("o_orderpriority")).otherwise(F.concat_ws("`", "o_orderpriority", "o_orderstatus", F.when(
            F.col("o_orderkey") % 2 == 0, "A").otherwise(F.col("o_orderstatus")), F.col("o_orderkey").cast("string"))).alias("objects"),
        F.element_at(F.array(*map(F.lit, ("yes", "no", "insufficient_info", "yes"))), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("match"))
    left, right, gt = DS.make_dataset(judged, pages, claims, labels, {"title": "title", "state": "status"}, "2col")
    side = lambda df, part, s: df.select(F.lit(part).alias("part"), *[F.col(x).alias(x + s) for x in df.columns])
    return (side(left, "left", "_l").unionByName(side(right, "right", "_r"), allowMissingColumns=True)
            .unionByName(gt.select(F.lit("gt").alias("part"), "*")))


def q_make_augmentation(spark, d):
    n, c = V.table(spark, d, "nation"), V.table(spark, d, "customer")
    named = lambda df, k, name: df.select(F.format_string("Q%d", k).alias("id"), F.col(name).alias("label"))
    labels = (named(n.where("n_regionkey <> 0"), "n_nationkey", "n_name")
              .unionByName(named(c.where("c_custkey > 24 AND c_custkey % 5 <> 0"), "c_custkey", "c_name"))
              .unionByName(_property_labels(spark, P17="country")))
    return DS.make_augmentation(_triples(spark, d), labels, {"id": "id", "title (en)": "title", "country": "nation", "P31": "priority"})


def q_normalize_claims(spark, d):
    return PR.normalize_props(V.table(spark, d, "events"))


def q_rename_project(spark, d):
    c = V.table(spark, d, "customer")
    return PR.rename(c, {"c_custkey": "id", "c_name": "title", "c_mktsegment": "segment"})


def q_drop_by_regex(spark, d):
    return PR.drop_by_regex(V.table(spark, d, "orders"), "key")


def q_packed_split(spark, d):
    p = V.table(spark, d, "pages")
    packed = p.select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("host"),
                      F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"))
    packed = packed.select("page_id", F.regexp_replace("host", r"\.", "/").alias("hosts"), "path")
    return PR.packed_split(packed, "page_id", "hosts", "path", "/")


def q_json_props(spark, d):
    e = V.table(spark, d, "events")
    return e.select("event_id", F.from_json("props", "k INT").alias("p")).select("event_id", "p.k")


def q_train_score(spark, d):
    L, R = _lr(spark, d)
    return VA.train_score(L, R, V.fj_gt(spark, d), "id", f"{checkpoint_dir(spark).rstrip('/')}/train-score-{uuid.uuid4().hex}",
                          checkpoint=True)


def q_blocker_compare(spark, d):
    L, R = _lr(spark, d)
    blockers = {"minhash": B.MinHashBlocker(), "tfidf": B.TokenBlocker(), "bm25": B.TokenBlocker(weighting="bm25"),
                "bm25_compat": B.TokenBlocker(weighting="bm25_compat")}
    return VA.blocker_compare(L, R, V.fj_gt(spark, d), "id", blockers)


def q_augment_curve(spark, d):
    L, R = _lr(spark, d)
    extra = V.page_titles(spark, d).where(F.col("id") % 2 == 1).select("id", "title")
    return VA.augment_curve(L, R, V.fj_gt(spark, d), extra, "id")


QUERIES = {k[2:]: v for k, v in dict(globals()).items() if k.startswith("q_") and callable(v)}
for _name, _jf in DIST_QUERIES.items():
    QUERIES[_name] = _make_dist(_jf)
