"""DuckDB SQL twins of the Spark operators, used only by the oracle queries.

Each helper returns SQL text; ``with_ctes`` assembles a ``WITH`` query.
The text rules mirror :mod:`fuzzyspark.functions.text` (same regexes).
"""

from __future__ import annotations

from fuzzyspark.functions.text import PUNCT, WS
from fuzzyspark.sources.views import SQL_VIEWS


def with_ctes(ctes: list[tuple[str, str]], final: str) -> str:
    seen, parts = set(), []
    for name, body in ctes:
        if name in seen:
            continue
        seen.add(name)
        kept = " MATERIALIZED" if name.endswith(("_blk", "_score", "_post", "_lld", "_r1", "_rules", "_lrd")) else ""
        parts.append(f"{name} AS{kept} ({body})")
    return "WITH " + ",\n".join(parts) + "\n" + final


def views(*names: str) -> list[tuple[str, str]]:
    deps = {"fj_left": ["fj_titles"], "fj_right": ["fj_titles"], "fj_left2": ["fj_titles"],
            "fj_right2": ["fj_titles"], "fj_gt": ["fj_titles", "fj_left", "fj_right"]}
    out = []
    for n in names:
        for d in deps.get(n, []):
            out.append((d, SQL_VIEWS[d]))
        out.append((n, SQL_VIEWS[n]))
    return out


def split_space(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{WS}]+'), lambda t: t <> '')"


def collapse(x: str) -> str:
    return f"array_to_string({split_space(x)}, ' ')"


def grams(s: str) -> str:
    return f"list_transform(range(1, length({s}) + 3), lambda i: substr('$$' || {s} || '$$', i, 3))"


def three_gram(x: str) -> str:
    return grams(collapse(x))


def remove_punct(x: str, repl: str = "") -> str:
    return f"regexp_replace({x}, '{PUNCT}', '{repl}', 'g')"


def as_text(c: str) -> str:
    return f"coalesce(CAST({c} AS VARCHAR), 'nan')"


def preprocess(x: str, method: str) -> str:
    """Unstemmed preprocessing (``lower`` / ``lowerRemovePunctuation``)."""
    y = f"lower({x})"
    if "RemovePunctuation" in method:
        y = remove_punct(y)
    return y


def block_normalize(cols: list[str]) -> str:
    cat = " || ' ' || ".join(as_text(c) for c in cols)
    return collapse(remove_punct(f"lower({cat})", " "))


def block_tokens(v: str) -> str:
    return f"list_concat({grams(v)}, {split_space(v)})"


def blocking(lsrc: str, rsrc: str, cols: list[str], prefix: str = "b",
             weighting: str = "tfidf", k: int | str | None = None) -> list[tuple[str, str]]:
    """CTEs ``{p}_lnorm, {p}_rnorm, …, {p}_blk(id_l, id_r)`` for one blocker call."""
    p = prefix
    norm = block_normalize(cols)
    n = f"(SELECT count(*) FROM {p}_lnorm)"
    kk = f"least(CAST(floor(sqrt({n})) AS BIGINT), 50)" if k is None else str(k)
    if weighting == "tfidf":
        w = f"cnt / len * ln({n} / (df + 1))"
    else:
        idf = f"ln(({n} - (df + 1) + 0.5) / (df + 1 + 0.5) + 1)"
        avg = f"(SELECT avg(len) FROM (SELECT DISTINCT id_l, len FROM {p}_tf))"
        nrm = f"1.2 * (1 - 0.75 + 0.75 * len / {avg})"
        w = (f"{idf} * cnt * 2.2 / (cnt + {nrm})" if weighting == "bm25"
             else f"{idf} * (2.2 + {nrm})")
    return [
        (f"{p}_lnorm", f"SELECT id, {norm} AS value FROM {lsrc}"),
        (f"{p}_rnorm", f"SELECT id, {norm} AS value FROM {rsrc}"),
        (f"{p}_ltok", f"SELECT id AS id_l, len(toks) AS len, unnest(toks) AS token FROM "
                      f"(SELECT id, {block_tokens('value')} AS toks FROM {p}_lnorm WHERE length(value) > 0)"),
        (f"{p}_tf", f"SELECT id_l, token, len, count(*) AS cnt FROM {p}_ltok GROUP BY id_l, token, len"),
        (f"{p}_df", f"SELECT token, count(*) AS df FROM {p}_tf GROUP BY token"),
        (f"{p}_post", f"SELECT token, id_l, {w} AS w FROM {p}_tf JOIN {p}_df USING (token)"),
        (f"{p}_rtok", f"SELECT DISTINCT id AS id_r, unnest({block_tokens('value')}) AS token FROM {p}_rnorm"),
        (f"{p}_score", f"SELECT id_l, id_r, round(sum(w), 10) AS score FROM {p}_rtok JOIN {p}_post "
                       f"USING (token) GROUP BY id_l, id_r"),
        (f"{p}_blk", f"SELECT id_l, id_r, score FROM (SELECT *, rank() OVER (PARTITION BY id_r "
                     f"ORDER BY score DESC) AS rk FROM {p}_score) WHERE rk <= {kk}"),
    ]


def u_grid(n: int) -> str:
    import numpy as np
    return "[" + ", ".join(f"'{float(u)!r}'::DOUBLE" for u in np.linspace(0, 1, n)) + "]"


def token_table(p: str, lsrc: str, rsrc: str, col: str, pre: str, tok: str, weight: str,
                nl: str) -> list[tuple[str, str]]:
    """``{p}_tw(side, id, token, c, w)`` and ``{p}_rec(side, id, n, s, nrm)``."""
    tk = three_gram if tok == "threeGram" else split_space
    w = (f"coalesce(w.w, ln({nl}))" if weight == "idfWeight" else "1.0")
    return [
        (f"{p}_pre", f"SELECT 'L' AS side, id, {preprocess(as_text(col), pre)} AS s FROM {lsrc} "
                     f"UNION ALL SELECT 'R' AS side, id, {preprocess(as_text(col), pre)} AS s FROM {rsrc}"),
        (f"{p}_tok", f"SELECT side, id, token, count(*) AS c FROM (SELECT side, id, unnest({tk('s')}) AS token "
                     f"FROM {p}_pre) GROUP BY side, id, token"),
        (f"{p}_idf", f"SELECT token, ln({nl} / (count(*) + 1)) AS w FROM {p}_tok WHERE side = 'L' GROUP BY token"),
        (f"{p}_tw", f"SELECT t.side, t.id, t.token, t.c, {w} AS w FROM {p}_tok t LEFT JOIN {p}_idf w USING (token)"),
        (f"{p}_rec", f"SELECT side, id, count(*) AS n, sum(w) AS s, sqrt(sum((w * c) * (w * c))) AS nrm "
                     f"FROM {p}_tw GROUP BY side, id"),
    ]


def set_formula(dist: str) -> str:
    i, dot, u = "coalesce(ps.I, 0)", "coalesce(ps.dot, 0)", "(rl.s + rr.s - coalesce(ps.I, 0))"
    jac = f"1 - {i} / ({u} + 1e-9)"
    cos = f"1 - {dot} / (rl.nrm * rr.nrm + 1e-9)"
    dice = f"1 - 2 * {i} / ({i} + {u} + 1e-9)"
    contain = "coalesce(ps.ni, 0) = least(rl.n, rr.n)"
    table = {
        "jaccardDistance": jac, "cosineDistance": cos, "diceDistance": dice,
        "maxincDistance": f"1 - {i} / (least(rl.s, rr.s) + 1e-9)",
        "intersectDistance": f"1 - {i} / ({i} + {u} + 1e-9)",
        "containJaccardDistance": f"CASE WHEN {contain} THEN {jac} ELSE 1.0 END",
        "containCosineDistance": f"CASE WHEN {contain} THEN {cos} ELSE 1.0 END",
        "containDiceDistance": f"CASE WHEN {contain} THEN {dice} ELSE 1.0 END",
    }
    return table[dist]


def pair_distance(p: str, pairs: str, jf_name: str, lsrc: str, rsrc: str, col: str = "title",
                  nl: str | None = None, fill: bool = True) -> list[tuple[str, str]]:
    """``{p}_d(side, id_l, id_r, jf, d)`` for pairs ``(side, id_l, id_r)``."""
    pre, tok, weight, dist = jf_name.split("_")
    nl = nl or f"(SELECT count(*) FROM {lsrc})"
    ctes = token_table(p, lsrc, rsrc, col, pre, tok, weight, nl)
    ctes += [
        (f"{p}_ps", f"SELECT x.side, x.id_l, x.id_r, count(*) AS ni, sum(a.w) AS I, "
                    f"sum(a.w * a.w * a.c * b.c) AS dot FROM {pairs} x "
                    f"JOIN {p}_tw a ON a.side = 'L' AND a.id = x.id_l "
                    f"JOIN {p}_tw b ON b.side = CASE WHEN x.side = 'LL' THEN 'L' ELSE 'R' END "
                    f"AND b.id = x.id_r AND b.token = a.token GROUP BY x.side, x.id_l, x.id_r"),
        (f"{p}_raw", f"SELECT x.side, x.id_l, x.id_r, CASE WHEN rl.id IS NULL OR rr.id IS NULL THEN NULL "
                     f"ELSE round({set_formula(dist)}, 9) END AS d FROM {pairs} x "
                     f"LEFT JOIN {p}_rec rl ON rl.side = 'L' AND rl.id = x.id_l "
                     f"LEFT JOIN {p}_rec rr ON rr.side = CASE WHEN x.side = 'LL' THEN 'L' ELSE 'R' END "
                     f"AND rr.id = x.id_r "
                     f"LEFT JOIN {p}_ps ps ON ps.side = x.side AND ps.id_l = x.id_l AND ps.id_r = x.id_r"),
        (f"{p}_d", f"SELECT side, id_l, id_r, '{jf_name}' AS jf, "
                   + ("coalesce(d, max(d) OVER (PARTITION BY side), 1.0)" if fill else "d")
                   + f" AS d FROM {p}_raw"),
    ]
    return ctes


def precision_ctes(p: str, dist: str, grid_n: int = 50, fixed: dict | None = None) -> list[tuple[str, str]]:
    """From ``dist(side, id_l, id_r, jf, d)``: ``{p}_near``, ``{p}_thr(jf, ti, t)``,
    ``{p}_ball(jf, proxy, ti, cnt)``, ``{p}_lp(jf, ti, t, id_r, id_l, d, p)``.

    ``fixed``: {jf: [thresholds]} instead of the scaled grid (predict)."""
    if fixed is None:
        thr = (f"SELECT jf, t, CAST(dense_rank() OVER (PARTITION BY jf ORDER BY t) - 1 AS INTEGER) AS ti FROM "
               f"(SELECT DISTINCT jf, round(u * (mx - mn) + mn, 9) AS t FROM "
               f"(SELECT jf, min(d) AS mn, max(d) AS mx FROM {p}_near GROUP BY jf), "
               f"(SELECT unnest({u_grid(grid_n)}) AS u))")
    else:
        vals = ", ".join(f"('{jf}', '{round(float(t), 9)!r}'::DOUBLE)" for jf, ts in fixed.items() for t in ts)
        thr = (f"SELECT jf, t, CAST(dense_rank() OVER (PARTITION BY jf ORDER BY t) - 1 AS INTEGER) AS ti FROM "
               f"(SELECT DISTINCT * FROM (VALUES {vals}) v(jf, t))")
    return [
        (f"{p}_near", f"SELECT jf, id_r, id_l, d FROM (SELECT jf, id_r, id_l, d, row_number() OVER "
                      f"(PARTITION BY jf, id_r ORDER BY d, id_l) AS rn FROM {dist} WHERE side = 'LR') WHERE rn = 1"),
        (f"{p}_thr", thr),
        (f"{p}_ball", f"SELECT ll.jf, ll.id_r AS proxy, th.ti, count(*) AS cnt FROM {dist} ll "
                      f"JOIN {p}_thr th ON th.jf = ll.jf AND ll.d <= round(2 * th.t, 9) "
                      f"SEMI JOIN (SELECT DISTINCT jf, id_l FROM {p}_near) px ON px.jf = ll.jf AND px.id_l = ll.id_r "
                      f"WHERE ll.side = 'LL' "
                      f"GROUP BY ll.jf, ll.id_r, th.ti"),
        (f"{p}_lp", f"SELECT n.jf, th.ti, th.t, n.id_r, n.id_l, n.d, 1.0 / (1 + coalesce(b.cnt, 0)) AS p "
                    f"FROM {p}_near n JOIN {p}_thr th ON th.jf = n.jf AND n.d <= th.t "
                    f"LEFT JOIN {p}_ball b ON b.jf = n.jf AND b.proxy = n.id_l AND b.ti = th.ti"),
    ]


def rule_ctes(p: str, ll: str, lr: str, lsrc: str, rsrc: str, cols: list[str],
              given: list[tuple[str, str]] = ()) -> list[tuple[str, str]]:
    """``{p}_rules(a, b)``, learned on ``ll`` and ``given``, and ``{p}_kept(id_l, id_r)`` = ``lr`` pruned."""
    more = f" UNION SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in given)}) v(a, b)" if given else ""
    norm = block_normalize(cols)
    sets = lambda src: f"SELECT id, list_distinct({split_space(norm)}) AS toks FROM {src}"
    diff = lambda a, b: f"list_distinct(list_filter({a}, lambda x: NOT list_contains({b}, x)))"
    return [
        (f"{p}_ls", sets(lsrc)),
        (f"{p}_rs", sets(rsrc)),
        (f"{p}_lld", f"SELECT l.toks AS tl, {diff('l.toks', 'r.toks')} AS dl, {diff('r.toks', 'l.toks')} AS dr "
                     f"FROM {ll} x JOIN {p}_ls l ON l.id = x.id_l JOIN {p}_ls r ON r.id = x.id_r"),
        (f"{p}_r1", f"SELECT dl[1] AS a, dr[1] AS b FROM {p}_lld WHERE len(dl) = 1 AND len(dr) = 1 AND len(tl) <> 1"),
        (f"{p}_rules", f"SELECT a, b FROM {p}_r1 UNION SELECT b AS a, a AS b FROM {p}_r1{more}"),
        (f"{p}_lrd", f"SELECT x.id_l, x.id_r, unnest({diff('l.toks', 'r.toks')}) AS a, {diff('r.toks', 'l.toks')} AS dr "
                     f"FROM {lr} x JOIN {p}_ls l ON l.id = x.id_l JOIN {p}_rs r ON r.id = x.id_r"),
        (f"{p}_bad", f"SELECT DISTINCT id_l, id_r FROM {p}_lrd d JOIN {p}_rules u ON u.a = d.a "
                     f"WHERE list_contains(d.dr, u.b)"),
        (f"{p}_kept", f"SELECT x.id_l, x.id_r FROM {lr} x ANTI JOIN {p}_bad y ON x.id_l = y.id_l AND x.id_r = y.id_r"),
    ]
