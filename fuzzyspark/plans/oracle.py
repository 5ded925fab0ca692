"""DuckDB oracle SQL for the registered queries that SQL can express."""

from __future__ import annotations

from fuzzyspark.operators.prep import HOST_RE, URI_TAIL_RE, YEAR_RE
from fuzzyspark.plans import sqlparts as S
from fuzzyspark.plans.catalog import DIST_QUERIES, EVENT_TYPES, PRECISION_JFS, PRETRAINED, UOC

W = S.with_ctes
VLR = S.views("fj_left", "fj_right")
BLK = S.blocking("fj_left", "fj_right", ["title"], "b")
SELF = S.blocking("fj_left", "fj_left", ["title"], "s")
LL = ("ll", "SELECT id_l, id_r FROM s_blk WHERE id_l <> id_r")
RULES = S.rule_ctes("r", "ll", "b_blk", "fj_left", "fj_right", ["title"])
LR_PAIRS = ("lrpairs", "SELECT 'LR' AS side, id_l, id_r FROM b_blk")


def _prepared(fixed=None, grid=50):
    ctes = VLR + BLK + SELF + [LL] + RULES
    ctes.append(("pairs", "SELECT 'LL' AS side, id_l, id_r FROM ll UNION ALL "
                          "SELECT 'LR' AS side, id_l, id_r FROM r_kept"))
    names = []
    for i, jf in enumerate(PRECISION_JFS):
        ctes += S.pair_distance(f"p{i}", "pairs", jf, "fj_left", "fj_right")
        names.append(f"SELECT * FROM p{i}_d")
    ctes.append(("dist", " UNION ALL ".join(names)))
    ctes += S.precision_ctes("q", "dist", grid, fixed)
    return ctes


def _predict_ctes():
    fixed = {}
    for jf, t in UOC:
        fixed.setdefault(jf, []).append(t)
    ctes = _prepared(fixed)
    vals = ", ".join(f"({k}, '{jf}', '{round(float(t), 9)!r}'::DOUBLE)" for k, (jf, t) in enumerate(UOC))
    ctes.append(("cfg", f"SELECT * FROM (VALUES {vals}) v(k, jf, t)"))
    ctes.append(("win", "SELECT id_l, id_r FROM (SELECT lp.id_l, lp.id_r, row_number() OVER (PARTITION BY lp.id_r "
                        "ORDER BY lp.p DESC, c.k) AS rn FROM q_lp lp JOIN cfg c ON c.jf = lp.jf AND c.t = lp.t) "
                        "WHERE rn = 1"))
    ctes += S.views("fj_gt")
    ctes.append(("pp", "SELECT DISTINCT CAST(id_l AS VARCHAR) AS id_l, CAST(id_r AS VARCHAR) AS id_r FROM win"))
    ctes.append(("gg", "SELECT DISTINCT CAST(id_l AS VARCHAR) AS id_l, CAST(id_r AS VARCHAR) AS id_r FROM fj_gt"))
    ctes.append(("tpfpfn", "SELECT id_l, id_r, 'tp' AS kind FROM (SELECT * FROM pp INTERSECT SELECT * FROM gg) "
                           "UNION ALL SELECT id_l, id_r, 'fp' AS kind FROM (SELECT * FROM pp EXCEPT SELECT * FROM gg) "
                           "UNION ALL SELECT id_l, id_r, 'fn' AS kind FROM (SELECT * FROM gg EXCEPT SELECT * FROM pp)"))
    return ctes


def _dist_sql(jf):
    ctes = VLR + BLK + [LR_PAIRS] + S.pair_distance("p", "lrpairs", jf, "fj_left", "fj_right")
    return W(ctes, "SELECT id_l, id_r, round(d, 6) AS d FROM p_d")


def _split_sql(kind: str, size=0.75, k=5):
    def side(name, src):
        n = f"(SELECT count(*) FROM {src})"
        idx = (f"row_number() OVER (ORDER BY md5('0:' || CAST(id AS VARCHAR)), id) - 1")
        if kind == "split":
            val = f"CASE WHEN idx < CAST(floor({size} * {n}) AS BIGINT) THEN 'train' ELSE 'test' END AS part"
        else:
            q, r = f"({n} // {k})", f"({n} % {k})"
            big = f"({r} * ({q} + 1))"
            val = (f"CAST(CASE WHEN idx < {big} THEN idx // ({q} + 1) ELSE {r} + (idx - {big}) // greatest({q}, 1) "
                   f"END AS INTEGER) AS fold")
        return f"SELECT '{name}' AS side, id, {val} FROM (SELECT id, {idx} AS idx FROM {src})"
    return f"{side('L', 'fj_left')} UNION ALL {side('R', 'fj_right')}"


def _typed_sql():
    ev = ("ev", "SELECT event_id, CAST(ts AS VARCHAR) AS x, event_type AS u, "
                "lead(event_id) OVER w AS event_id_2, lead(CAST(ts AS VARCHAR)) OVER w AS y, "
                "lead(event_type) OVER w AS v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
    def parts(c):
        t = f"try_cast({c} AS TIMESTAMP)"
        return (f"list_distinct([year({t}), month({t}), day({t}), hour({t}), minute({t}), "
                f"CAST(floor(second({t})) AS BIGINT), isodow({t}) - 1, dayofyear({t}), -1])")
    ctes = [ev, ("ev2", f"SELECT *, {parts('x')} AS px, {parts('y')} AS py FROM ev WHERE event_id_2 IS NOT NULL"),
            ("cu", "SELECT event_id, c, count(*) AS n FROM (SELECT event_id, unnest(string_split(u, '')) AS c "
                   "FROM ev2) WHERE c <> '' GROUP BY ALL"),
            ("cv", "SELECT event_id, c, count(*) AS n FROM (SELECT event_id, unnest(string_split(v, '')) AS c "
                   "FROM ev2) WHERE c <> '' GROUP BY ALL"),
            ("cos", "SELECT e.event_id, 1 - coalesce((SELECT sum(a.n * b.n) FROM cu a JOIN cv b ON a.c = b.c "
                    "WHERE a.event_id = e.event_id AND b.event_id = e.event_id), 0) / "
                    "(sqrt((SELECT sum(n * n) FROM cu WHERE cu.event_id = e.event_id)) * "
                    "sqrt((SELECT sum(n * n) FROM cv WHERE cv.event_id = e.event_id)) + 1e-9) AS d FROM ev2 e")]
    jac = ("1 - len(list_filter(px, lambda z: list_contains(py, z))) / "
           "(len(px) + len(py) - len(list_filter(px, lambda z: list_contains(py, z))) + 1e-9)")
    return W(ctes, f"SELECT e.event_id, e.event_id_2, round({jac}, 6) AS d_ts, round(c.d, 6) AS d_type "
                   f"FROM ev2 e JOIN cos c USING (event_id)")


def _vec_sql(expr):
    return (f"SELECT vec_id, vec_id_2, round({expr}, 6) AS d FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a, "
            f"lead(vec_id) OVER w AS vec_id_2, lead(CAST(embedding AS DOUBLE[])) OVER w AS b FROM embeddings "
            f"WINDOW w AS (PARTITION BY label ORDER BY vec_id)) WHERE b IS NOT NULL")


def oracle() -> dict[str, str]:
    o = {}
    t = S.views("fj_titles")
    norm = S.block_normalize(["title"])
    o["block_normalize"] = W(t, f"SELECT id, {norm} AS value FROM fj_titles")
    o["block_tokens"] = W(VLR + BLK, "SELECT id_l AS id, token, count(*) AS cnt FROM b_ltok GROUP BY id_l, token")
    o["token_tf"] = W(VLR + BLK, "SELECT id_l, token, round(cnt / len, 9) AS tf FROM b_tf")
    o["token_idf"] = W(VLR + BLK, "SELECT token, df, round(ln((SELECT count(*) FROM b_lnorm) / (df + 1)), 9) AS idf FROM b_df")
    o["bm25_stats"] = W(VLR + BLK, "SELECT token, df, round(ln(((SELECT count(*) FROM b_lnorm) - (df + 1) + 0.5) / "
                                   "(df + 1 + 0.5) + 1), 9) AS idf FROM b_df")
    o["token_join"] = W(VLR + BLK, "SELECT id_l, id_r, count(*) AS n_shared FROM b_rtok JOIN b_post USING (token) "
                                   "GROUP BY id_l, id_r")
    o["block_score"] = W(VLR + BLK, "SELECT id_l, id_r, round(score, 6) AS score FROM b_score")
    o["block_tfidf"] = W(VLR + BLK, "SELECT id_l, id_r, round(score, 6) AS score FROM b_blk")
    o["block_self"] = W(VLR + SELF, "SELECT id_l, id_r, round(score, 6) AS score FROM s_blk WHERE id_l <> id_r")
    o["block_bm25"] = W(VLR + S.blocking("fj_left", "fj_right", ["title"], "b", "bm25"),
                        "SELECT id_l, id_r, round(score, 6) AS score FROM b_blk")
    o["block_bm25_compat"] = W(VLR + S.blocking("fj_left", "fj_right", ["title"], "b", "bm25_compat"),
                               "SELECT id_l, id_r, round(score, 6) AS score FROM b_blk")
    o["block_lookup"] = W(VLR + BLK, "SELECT l.id AS id_l, r.id AS id_r FROM (SELECT id, value, row_number() OVER "
                                     "(PARTITION BY value ORDER BY id) AS rn FROM b_lnorm) l JOIN b_rnorm r "
                                     "ON r.value = l.value WHERE l.rn <= least(CAST(floor(sqrt((SELECT count(*) "
                                     "FROM b_lnorm))) AS BIGINT), 50)")
    o["block_custom"] = W(VLR + BLK, f"SELECT l.id AS id_l, r.id AS id_r FROM b_lnorm l JOIN b_rnorm r ON "
                                     f"list_sort(list_distinct({S.split_space('l.value')})) = "
                                     f"list_sort(list_distinct({S.split_space('r.value')}))")
    o["prep_lower"] = W(t, "SELECT id, lower(coalesce(title, 'nan')) AS value FROM fj_titles")
    o["prep_lower_nopunct"] = W(t, f"SELECT id, {S.remove_punct('lower(coalesce(title, ' + chr(39) + 'nan' + chr(39) + '))')} AS value FROM fj_titles")
    o["tok_words"] = W(t, f"SELECT id, token, count(*) AS cnt FROM (SELECT id, unnest({S.split_space('lower(title)')}) "
                          f"AS token FROM fj_titles) GROUP BY id, token")
    o["tok_trigram"] = W(t, f"SELECT id, token, count(*) AS cnt FROM (SELECT id, unnest({S.three_gram('lower(title)')}) "
                            f"AS token FROM fj_titles) GROUP BY id, token")
    dt = [("dt", "SELECT doc_id AS id, coalesce(text, 'nan') AS text FROM documents")]
    dw = dt + [("dw", f"SELECT id, unnest({S.split_space('lower(text)')}) AS token FROM dt")]
    o["doc_prep_lower_nopunct"] = W(dt, f"SELECT id, {S.remove_punct('lower(text)')} AS value FROM dt")
    o["doc_block_normalize"] = W(dt, f"SELECT id, {S.block_normalize(['text'])} AS value FROM dt")
    o["doc_words"] = W(dw, "SELECT id, token, count(*) AS cnt FROM dw GROUP BY id, token")
    o["doc_idf"] = W(dw, "SELECT token, round(ln((SELECT count(*) FROM dt) / (count(DISTINCT id) + 1)), 9) AS w "
                         "FROM dw GROUP BY token")
    o["doc_benchmark_words"] = W(dw + [
        ("bw", f"SELECT item_id, unnest({S.split_space('lower(text)')}) AS token FROM benchmark"),
        ("dn", "SELECT token, count(DISTINCT id) AS n_docs FROM dw GROUP BY token"),
        ("bn", "SELECT token, count(DISTINCT item_id) AS n_items FROM bw GROUP BY token")],
        "SELECT token, n_docs, n_items FROM dn JOIN bn USING (token)")
    o["idf_weight"] = W(VLR, f"SELECT token, round(ln((SELECT count(*) FROM fj_left) / (count(*) + 1)), 9) AS w FROM "
                             f"(SELECT DISTINCT id, unnest({S.three_gram('lower(title)')}) AS token FROM fj_left) GROUP BY token")
    sets = (f"SELECT b.id_l, b.id_r, list_distinct({S.split_space('lower(l.title)')}) AS x, "
            f"list_distinct({S.split_space('lower(r.title)')}) AS y FROM b_blk b JOIN fj_left l ON l.id = b.id_l "
            f"JOIN fj_right r ON r.id = b.id_r")
    inter = "len(list_filter(x, lambda z: list_contains(y, z)))"
    o["token_set_ops"] = W(VLR + BLK + [("st", sets)],
                           f"SELECT id_l, id_r, {inter} AS n_inter, len(x) + len(y) - {inter} AS n_union, "
                           f"len(x) - {inter} AS n_l_only, len(y) - {inter} AS n_r_only FROM st")
    everyone = (f"SELECT l.id AS id_l, r.id AS id_r, list_distinct({S.split_space('lower(l.title)')}) AS x, "
                f"list_distinct({S.split_space('lower(r.title)')}) AS y FROM fj_left l, fj_right r")
    o["contain_join"] = W(VLR + [("st", everyone)], f"SELECT id_l, id_r FROM st WHERE {inter} = least(len(x), len(y)) "
                                                    f"AND least(len(x), len(y)) > 0")
    for name, jf in DIST_QUERIES.items():
        o[name] = _dist_sql(jf)
    ctes = VLR + BLK + SELF + [LL, ("pairs", "SELECT 'LL' AS side, id_l, id_r FROM ll UNION ALL "
                                             "SELECT 'LR' AS side, id_l, id_r FROM b_blk")]
    jfs3 = PRECISION_JFS + ["lower_threeGram_idfWeight_cosineDistance"]
    for i, jf in enumerate(jfs3):
        ctes += S.pair_distance(f"p{i}", "pairs", jf, "fj_left", "fj_right")
    o["pair_distance"] = W(ctes, "SELECT a.side, a.id_l, a.id_r, round(a.d, 6) AS d_jaccard, round(b.d, 6) AS d_maxinc, "
                                 "round(c.d, 6) AS d_cosine FROM p0_d a JOIN p1_d b USING (side, id_l, id_r) "
                                 "JOIN p2_d c USING (side, id_l, id_r)")
    v2 = S.views("fj_left2", "fj_right2")
    b2 = S.blocking("fj_left2", "fj_right2", ["title", "lang"], "b")
    ctes = v2 + b2 + [LR_PAIRS] + S.pair_distance("pt", "lrpairs", PRECISION_JFS[0], "fj_left2", "fj_right2", "title") \
        + S.pair_distance("pg", "lrpairs", PRECISION_JFS[0], "fj_left2", "fj_right2", "lang")
    o["weighted_distance"] = W(ctes, "SELECT a.id_l, a.id_r, round(0.0 + 0.7 * a.d + 0.3 * b.d, 6) AS d FROM pt_d a "
                                     "JOIN pg_d b USING (side, id_l, id_r)")
    o["dist_embed_cosine"] = _vec_sql("1 - list_inner_product(a, b) / (sqrt(list_inner_product(a, a)) * "
                                      "sqrt(list_inner_product(b, b)))")
    o["dist_embed_l2"] = _vec_sql("list_distance(a, b)")
    o["dist_typed"] = _typed_sql()
    o["negative_rule_learn"] = W(VLR + BLK + SELF + [LL] + RULES, "SELECT a, b FROM r_rules")
    o["negative_rule_apply"] = W(VLR + BLK + SELF + [LL] + RULES, "SELECT id_l, id_r FROM r_kept")
    named = "SELECT p_partkey AS id, concat_ws(' ', p_name, p_brand) AS title FROM part WHERE p_partkey % 2 = "
    parts = ([("fj_left", named + "0"), ("fj_right", named + "1")] + BLK + SELF + [LL])
    o["negative_rule_parts_learn"] = W(parts + RULES, "SELECT a, b FROM r_rules")
    o["negative_rule_parts"] = W(parts + RULES, "SELECT id_l, id_r FROM r_kept")
    both = S.rule_ctes("r", "ll", "b_blk", "fj_left", "fj_right", ["title"], PRETRAINED)
    o["negative_rule_pretrained"] = W(parts + both, "SELECT id_l, id_r FROM r_kept")
    pc = _prepared()
    o["nearest_left"] = W(pc, "SELECT jf, id_r, id_l, round(d, 6) AS d FROM q_near")
    o["threshold_grid"] = W(pc, "SELECT jf, ti, round(t, 6) AS t FROM q_thr")
    o["ball_count"] = W(pc, "SELECT jf, proxy, ti, cnt + 1 AS n_ball FROM q_ball")
    o["local_precision"] = W(pc, "SELECT jf, ti, id_r, id_l, round(p, 6) AS p FROM q_lp")
    o["config_profit"] = W(pc, "SELECT jf, ti, round(sum(p), 6) AS tp, count(*) AS n, "
                               "round(sum(p) / (count(*) - sum(p) + 1e-9), 6) AS profit, "
                               "round(sum(p) / (count(*) + 1e-9), 6) AS prec FROM q_lp GROUP BY jf, ti")
    jf0, t0 = UOC[0]
    o["threshold_join"] = W(pc, f"SELECT id_l, id_r, round(d, 6) AS d FROM q_near WHERE jf = '{jf0}' AND d <= {t0}")
    every = ("every", "SELECT 'LR' AS side, l.id AS id_l, r.id AS id_r FROM fj_left l, fj_right r")
    o["threshold_join_full"] = W(VLR + [every] + S.pair_distance("p", "every", jf0, "fj_left", "fj_right"),
                                 f"SELECT id_l, id_r, round(d, 6) AS d FROM p_d WHERE d <= {t0}")
    pr = _predict_ctes()
    o["predict"] = W(pr, "SELECT DISTINCT w.id_l, l.title AS title_l, w.id_r, r.title AS title_r FROM win w "
                         "JOIN fj_left l ON l.id = w.id_l JOIN fj_right r ON r.id = w.id_r")
    o["predict_held"] = o["predict"]
    o["evaluate"] = W(pr, "SELECT n_pred, n_gt, n_tp, round(n_tp / n_pred, 6) AS precision, round(n_tp / n_gt, 6) AS recall, "
                          "round(2 * (n_tp / n_pred) * (n_tp / n_gt) / (n_tp / n_pred + n_tp / n_gt), 6) AS f1 FROM "
                          "(SELECT (SELECT count(*) FROM pp) AS n_pred, (SELECT count(*) FROM gg) AS n_gt, "
                          "(SELECT count(*) FROM (SELECT * FROM pp INTERSECT SELECT * FROM gg)) AS n_tp)")
    o["scores"] = o["evaluate"].replace(" AS f1 FROM", " AS fscore FROM")
    o["tp_fp_fn"] = W(pr, "SELECT id_l, id_r, kind FROM tpfpfn")
    o["error_report"] = W(pr, "SELECT t.id_l, t.id_r, t.kind, l.title AS title_l, r.title AS title_r FROM tpfpfn t "
                              "LEFT JOIN fj_left l ON CAST(l.id AS VARCHAR) = t.id_l "
                              "LEFT JOIN fj_right r ON CAST(r.id AS VARCHAR) = t.id_r")
    o["train_test_split"] = W(VLR, _split_sql("split"))
    o["kfold"] = W(VLR, _split_sql("kfold"))
    o["gt_semijoin"] = W(VLR + S.views("fj_gt") + [("a", _split_sql("split"))],
                         "SELECT * FROM fj_gt WHERE id_l IN (SELECT id FROM a WHERE side = 'L' AND part = 'train') "
                         "AND id_r IN (SELECT id FROM a WHERE side = 'R' AND part = 'train')")
    o["augment_left"] = W(VLR, "SELECT id, title FROM fj_left UNION SELECT id, title FROM fj_right")
    o["augment_fraction"] = W(VLR, "SELECT id, title FROM (SELECT id, title, row_number() OVER (ORDER BY "
                                   "md5('0:' || CAST(id AS VARCHAR)), id) - 1 AS idx FROM fj_right) WHERE idx < "
                                   "CAST(floor(0.7 * (SELECT count(*) FROM fj_right)) AS BIGINT)")
    o["distinct_rows"] = W(t, "SELECT DISTINCT title, lang FROM fj_titles")
    nt = "SELECT id, nullif(title, '') AS title, nullif(lang, '') AS lang FROM fj_titles"
    o["dropna_all"] = W(t, f"SELECT * FROM ({nt}) WHERE title IS NOT NULL OR lang IS NOT NULL")
    o["dropna_any"] = W(t, f"SELECT * FROM ({nt}) WHERE title IS NOT NULL AND lang IS NOT NULL")
    o["label_filter"] = "SELECT doc_id, toxic FROM labels WHERE quality IN (1)"
    o["collapse_values"] = ("SELECT conv_id, role, array_to_string(list_sort(list_distinct(list(text))), ' | ') AS text "
                            "FROM conversations GROUP BY conv_id, role")
    o["uri_tail"] = (f"SELECT page_id, regexp_extract(url, '{HOST_RE}', 1) AS host, "
                     f"regexp_extract(url, '{URI_TAIL_RE}', 1) AS tail FROM pages")
    o["pivot_props"] = "SELECT user_id, " + ", ".join(
        f'max(CASE WHEN event_type = \'{n}\' THEN value END) AS "{n}"' for n in EVENT_TYPES) + " FROM events GROUP BY user_id"
    thin = "SELECT id, nullif(title, '') AS title, nullif(nullif(lang, ''), 'en') AS lang FROM fj_titles"
    o["variant_1col"] = W(t, f"SELECT DISTINCT id, title FROM ({thin}) WHERE title IS NOT NULL")
    o["variant_pairs"] = W(t, f"SELECT DISTINCT id, title, lang FROM ({thin}) WHERE title IS NOT NULL AND lang IS NOT NULL")
    o["variant_full"] = W(t, f"SELECT DISTINCT id, title, lang FROM ({thin}) WHERE title IS NOT NULL OR lang IS NOT NULL")
    o["variant_project"] = W(t, "SELECT DISTINCT id, title, lang FROM fj_titles WHERE title IS NOT NULL AND lang IS NOT NULL")
    o["label_lookup"] = ("SELECT n_nationkey, n_name, coalesce(r_name, n_name || ' (' || CAST(n_regionkey AS VARCHAR) || ')') "
                         "AS region_label FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
    o["gt_enrich"] = W(VLR + S.views("fj_left2", "fj_right2", "fj_gt"),
                       "SELECT g.id_l, g.id_r, l.title AS title_l, l.lang AS lang_l, r.title AS title_r, r.lang AS lang_r "
                       "FROM fj_gt g JOIN fj_left2 l ON l.id = g.id_l JOIN fj_right2 r ON r.id = g.id_r")
    o["normalize_claims"] = (f"SELECT event_id, regexp_extract(CAST(ts AS VARCHAR), '{YEAR_RE}', 1) AS year, "
                             f"CAST(value AS VARCHAR) || ' ' || event_type AS quantity, "
                             f"json_extract_string(props, '$.k') AS k FROM events")
    lab = "coalesce(n_name, 'Q' || (user_id % 30))"
    o["claim_text"] = (f"SELECT event_id, CASE event_id % 7 WHEN 0 THEN event_type WHEN 1 THEN {lab} "
                       "WHEN 2 THEN strftime(ts, '%Y') WHEN 3 THEN '(' || (event_id % 90) || ', ' || (user_id % 180) || ')' "
                       f"WHEN 4 THEN event_type WHEN 5 THEN '+' || event_id || ' ' || {lab} ELSE event_type END AS text "
                       "FROM events LEFT JOIN nation ON n_nationkey = user_id % 30")
    o["entity_rows"] = (
        "SELECT 'Q' || k AS entity, c_name AS label, n_name AS country, CAST(NULL AS VARCHAR) AS \"P18\", p AS \"P31\", "
        "'http://example.org/home/' || last AS homepage FROM (SELECT o_custkey AS k, max(o_orderkey) AS last, "
        "coalesce(arg_min(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END), "
        "arg_max(o_orderpriority, o_orderkey)) AS p FROM orders GROUP BY o_custkey) o "
        "FULL JOIN (SELECT c_custkey AS k, c_name, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey "
        "AND n_regionkey <> 0) c USING (k)")
    o["make_dataset"] = (
        "WITH ord AS (SELECT *, o_orderkey % 7 <> 0 AS full_row FROM orders), "
        "l AS (SELECT 'Q' || o_custkey AS id_l, min(c_name) AS title_l, string_agg(o_orderstatus, '|' ORDER BY o_orderkey) AS status_l "
        "FROM ord JOIN customer ON c_custkey = o_custkey WHERE o_custkey % 10 <> 9 GROUP BY o_custkey), "
        "r AS (SELECT 's' || o_orderkey AS id_r, o_orderpriority AS title_r, CASE WHEN o_orderkey % 2 <> 0 OR o_orderstatus = 'A' "
        "THEN o_orderstatus WHEN o_orderstatus < 'A' THEN o_orderstatus || ' A' ELSE 'A ' || o_orderstatus END AS status_r, "
        "'Q' || o_custkey AS id_l, o_orderkey FROM ord WHERE full_row) "
        "SELECT 'left' AS part, id_l, title_l, status_l, CAST(NULL AS VARCHAR) AS id_r, CAST(NULL AS VARCHAR) AS title_r, "
        "CAST(NULL AS VARCHAR) AS status_r FROM l UNION ALL SELECT 'right', NULL, NULL, NULL, id_r, title_r, status_r FROM r "
        "UNION ALL SELECT 'gt', id_l, title_l, status_l, id_r, title_r, status_r FROM l JOIN r USING (id_l) WHERE o_orderkey % 4 <> 1")
    o["make_augmentation"] = (
        "SELECT entity AS id, title, nation, priority FROM (SELECT 'Q' || k AS entity, coalesce(own.n_name, CASE WHEN k > 24 AND k % 5 <> 0 "
        "THEN c_name END) AS title, home.n_name AS nation, p AS priority FROM (SELECT o_custkey AS k, "
        "coalesce(arg_min(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END), "
        "arg_max(o_orderpriority, o_orderkey)) AS p FROM orders GROUP BY o_custkey) FULL JOIN (SELECT c_custkey AS k, * FROM customer) USING (k) "
        "LEFT JOIN nation own ON own.n_nationkey = k AND own.n_regionkey <> 0 "
        "LEFT JOIN nation home ON home.n_nationkey = c_nationkey AND home.n_regionkey <> 0) WHERE title IS NOT NULL")
    o["rename_project"] = "SELECT c_custkey AS id, c_name AS title, c_mktsegment AS segment FROM customer"
    o["drop_by_regex"] = "SELECT * EXCLUDE (o_orderkey, o_custkey) FROM orders"
    o["packed_split"] = (
        "SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, hs[i] AS hosts, ps[i] AS path FROM ("
        "SELECT page_id, string_split(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '\\.', '/', 'g'), '/') AS hs, "
        "string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') AS ps FROM pages), "
        "LATERAL (SELECT unnest(range(1, greatest(len(hs), len(ps)) + 1)) AS i)")
    o["json_props"] = "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events"
    return o
