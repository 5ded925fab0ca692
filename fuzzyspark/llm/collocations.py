"""Phrase collocations by set-oriented relational mining (SETM).

The occurrences of frequent phrases of one length are a relation (lang, doc,
position, phrase), kept as Parquet and sorted by document and position.  A row
of the table holds the occurrences of a stretch of a document as two arrays:
those that begin before its end, which are its own, and those within a
phrase's length behind it, which the next stretch owns.  Positions count words
and the marks between pieces, so two words stand side by side in one piece
exactly where their positions follow each other.  A level is

* a merge-join of the relation with itself on adjacent positions: two phrases
  of k words that overlap in k - 1 make one of k + 1,
* a group-count of the pairs, partial in the tasks, and the frequent ones kept
  in a table of groups with ids,
* a semi-join of the occurrences with the frequent groups, written as the
  relation of the next length.

Groups are compared by their words and by ids of groups, never by hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fuzzyspark.llm.common import lookup, numbered, remove, text_of, written
from fuzzyspark.llm.words import flat, word_bounds

MAX_WORDS, MIN_COUNT, TOP, SCALE, COVER = 4, 30, 2000, 2_000_000, 80
#: frequent groups are sent to the tasks up to this many bytes; beyond it occurrences are joined to them
GROUP_BYTES = 96 << 20
#: bytes of a sent group of two words and more: its key and its id
PAIR_BYTES = 16
#: positions of a stretch
STRETCH = 128
#: bytes of text, occurrences joined, and pairs counted at a time in a task
TEXT_BYTES, OCCURRENCES_AT_ONCE, PAIRS = 2 << 20, 1 << 19, 1 << 20
SPACE, MARKS = [0x20, 0x09], [ord(c) for c in ".,;:!?\n\x0b\x0c\r"]
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] = np.arange(97, 123)
IN_WORD = np.ones(256, np.uint8)
IN_WORD[SPACE + MARKS] = 0
IS_MARK = np.zeros(256, bool)
IS_MARK[MARKS] = True
OCCURRENCES = "lang string, doc long, end int, pos array<int>, id array<long>"


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, positions, first word of each text); positions skip one number for every mark."""
    data, offsets = flat(texts)
    w, starts, ends, first = word_bounds(data, offsets, IN_WORD)
    lens = ends - starts
    to = np.concatenate(([0], np.cumsum(lens)))
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [
        None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(FOLD[data[w != 0]])])
    marks = np.searchsorted(np.flatnonzero(IS_MARK[data]), starts)
    pos = np.arange(len(starts)) + marks
    base = np.repeat(pos[np.minimum(first[:-1], max(len(pos) - 1, 0))] if len(pos) else first[:-1], np.diff(first))
    return words, (pos - base).astype(np.int32), first


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows of about ``size`` bytes of text."""
    for batch in batches:
        offsets = np.concatenate(([0], np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))))
        cuts = np.searchsorted(offsets, np.arange(0, int(offsets[-1]) + size, size), "left")
        cuts = np.unique(np.concatenate((cuts[cuts <= batch.num_rows], [0, batch.num_rows])))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield batch.slice(i, j - i)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows of a relation with about ``OCCURRENCES_AT_ONCE`` occurrences."""
    for batch in batches:
        ends = batch.column("pos").offsets.to_numpy()
        ends = ends - ends[0]
        cuts = np.searchsorted(ends, np.arange(0, int(ends[-1]) + OCCURRENCES_AT_ONCE, OCCURRENCES_AT_ONCE), "left")
        cuts = np.unique(np.concatenate((cuts[cuts <= batch.num_rows], [0, batch.num_rows])))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield batch.slice(i, j - i)


def _langs(batch: pa.RecordBatch, counts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(distinct langs, number of the lang of every word or occurrence)."""
    coded = batch.column("lang").dictionary_encode()
    return coded.dictionary, np.repeat(coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), counts)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _pieces(batches, TEXT_BYTES):
        words, _, first = tokens(batch.column("text"))
        if not len(words):
            continue
        names, lang = _langs(batch, np.diff(first))
        coded = words.dictionary_encode()
        size = len(coded.dictionary)
        key, n = np.unique(lang.astype(np.int64) * size + coded.indices.to_numpy(), return_counts=True)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(key // size)), coded.dictionary.take(pa.array(key % size)).cast(pa.string()),
                                          pa.array(n)], ["lang", "word", "n"])


def _stretches(whose: np.ndarray, pos: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences, sorted by document and position, dealt to stretches: (occurrence, document, end of its stretch)
    sorted by stretch; the first of a stretch stand in the one before too."""
    nth = pos // STRETCH
    also = np.flatnonzero((nth > 0) & (pos % STRETCH < longest - 1))
    at = np.concatenate((np.arange(len(pos)), also))
    nth = np.concatenate((nth, nth[also] - 1))
    order = np.lexsort((at, nth, whose[at]))
    return at[order], whose[at[order]], ((nth[order] + 1) * STRETCH).astype(np.int32)


def _table(batch: pa.RecordBatch, whose: np.ndarray, end: np.ndarray, pos: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """A row of the relation for each stretch that has occurrences."""
    new = np.flatnonzero(np.concatenate(([True], (whose[1:] != whose[:-1]) | (end[1:] != end[:-1])))[:len(end)])
    cuts = pa.array(np.concatenate((new, [len(end)])).astype(np.int32))
    row = pa.array(whose[new])
    return pa.RecordBatch.from_arrays([
        batch.column("lang").take(row), batch.column("doc").take(row), pa.array(end[new]),
        pa.ListArray.from_arrays(cuts, pa.array(pos)), pa.ListArray.from_arrays(cuts, pa.array(ids))], ["lang", "doc", "end", "pos", "id"])


def _sent_words(groups: DataFrame) -> tuple:
    """What ``_first_relation`` needs of the groups: (langs, words, keys, ids), the keys sorted; made once for all tasks."""
    known = groups.select("lang", "word", "id").toArrow().combine_chunks()
    lang, word = (known.column(c).combine_chunks().dictionary_encode() for c in ("lang", "word"))
    size = np.int64(max(len(word.dictionary), 1))
    key = lang.indices.to_numpy().astype(np.int64) * size + word.indices.to_numpy()
    order = np.argsort(key)
    return lang.dictionary.cast(pa.string()), word.dictionary.cast(pa.large_string()), key[order], known.column("id").to_numpy()[order]


def _first_relation(sent, longest: int):
    """Occurrences of the words in the sent groups, those of ``_sent_words``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, vocabulary, key, ids = sent.value
        size = np.int64(max(len(vocabulary), 1))
        for batch in _pieces(batches, TEXT_BYTES):
            words, pos, first = tokens(batch.column("text"))
            names, lang = _langs(batch, np.diff(first))
            coded = words.dictionary_encode()
            # the few words of the batch are hashed and the vocabulary looked up in them
            found = pc.index_in(vocabulary, coded.dictionary)
            place = np.full(len(coded.dictionary), -1, np.int64)
            held = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
            place[found.drop_null().to_numpy()] = held
            at_lang = pc.fill_null(pc.index_in(names, langs), -1).to_numpy().astype(np.int64)
            word, lang = place[coded.indices.to_numpy()], at_lang[lang]
            known = np.flatnonzero((word >= 0) & (lang >= 0))
            mine = lang[known] * size + word[known]
            at = np.minimum(np.searchsorted(key, mine), max(len(key) - 1, 0))
            ok = key[at] == mine if len(key) else np.zeros(len(mine), bool)
            keep = known[ok]
            whose = np.repeat(np.arange(batch.num_rows), np.diff(first))[keep]
            to, whose, end = _stretches(whose, pos[keep], longest)
            yield _table(batch, whose, end, pos[keep][to], ids[at[ok]][to])
    return run


def _all_words(longest: int):
    """Every word's occurrence as a row for each stretch that holds it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, TEXT_BYTES):
            words, pos, first = tokens(batch.column("text"))
            to, whose, end = _stretches(np.repeat(np.arange(batch.num_rows), np.diff(first)), pos, longest)
            row = pa.array(whose)
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang").take(row), batch.column("doc").take(row), pa.array(end), pa.array(pos[to]), words.take(pa.array(to)).cast(pa.string())],
                ["lang", "doc", "end", "pos", "word"])
    return run


def _adjacent(batch: pa.RecordBatch):
    """Merge-join of the occurrences with themselves: (row, position, a, b) of every two side by side."""
    lists = batch.column("pos")
    counts = np.diff(lists.offsets.to_numpy())
    pos = lists.flatten().to_numpy(zero_copy_only=False)
    ids = batch.column("id").flatten().to_numpy(zero_copy_only=False)
    whose = np.repeat(np.arange(batch.num_rows), counts)
    at = np.flatnonzero((pos[1:] == pos[:-1] + 1) & (whose[1:] == whose[:-1])) if len(pos) else np.zeros(0, np.int64)
    return whose[at], pos[at], ids[at], ids[at + 1]


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def counted(held) -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.array(np.diff(np.concatenate((new, [len(a)]))))], ["a", "b", "n"])

    held, size = [], 0
    for batch in _runs(batches):
        whose, pos, a, b = _adjacent(batch)
        own = pos < batch.column("end").to_numpy()[whose]
        held.append((a[own], b[own]))
        size += len(held[-1][0])
        if size >= PAIRS:
            yield counted(held)
            held, size = [], 0
    if size:
        yield counted(held)


def _sent_pairs(groups: DataFrame) -> tuple:
    """What ``_next_relation`` needs of the groups: (firsts, seconds, keys, ids), all but the ids sorted; made once for all tasks."""
    known = groups.select("a", "b", "id").toArrow()

    def numbers(name):
        coded = known.column(name).combine_chunks().dictionary_encode()
        values = coded.dictionary.to_numpy()
        order = np.argsort(values)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return values[order], rank[coded.indices.to_numpy()]

    firsts, key = numbers("a")
    seconds, b = numbers("b")
    key *= max(len(seconds), 1)
    key += b
    order = np.argsort(key)
    return firsts, seconds, key[order], known.column("id").to_numpy()[order]


def _next_relation(sent):
    """Occurrences of the sent groups, those of ``_sent_pairs``, among the pairs side by side."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, seconds, key, g_id = sent.value
        for batch in _runs(batches):
            whose, pos, a, b = _adjacent(batch)
            keep, ids = np.zeros(0, np.int64), np.zeros(len(a), np.int64)
            if len(key):
                i = np.minimum(np.searchsorted(firsts, a), len(firsts) - 1)
                j = np.minimum(np.searchsorted(seconds, b), len(seconds) - 1)
                mine = i * np.int64(len(seconds)) + j
                at = np.minimum(np.searchsorted(key, mine), len(key) - 1)
                keep = np.flatnonzero((firsts[i] == a) & (seconds[j] == b) & (key[at] == mine))
                ids[keep] = g_id[at[keep]]
            whose = whose[keep]
            yield _table(batch, whose, batch.column("end").to_numpy()[whose], pos[keep], ids[keep])
    return run


def _all_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every two occurrences side by side as a row."""
    for batch in _runs(batches):
        whose, pos, a, b = _adjacent(batch)
        row = pa.array(whose)
        yield pa.RecordBatch.from_arrays([batch.column("lang").take(row), batch.column("doc").take(row), batch.column("end").take(row),
                                          pa.array(pos), pa.array(a), pa.array(b)], ["lang", "doc", "end", "pos", "a", "b"])


def _regrouped(flat_rows: DataFrame, groups: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The semi-join as a join: rows with a frequent group, put together by stretch again."""
    met = lookup(flat_rows, groups.select(*keys, "id"), keys, F.struct("doc", "pos"), n, "inner")
    sides = F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("o")
    return met.groupBy("lang", "doc", "end").agg(sides).select("lang", "doc", "end", F.col("o.pos").alias("pos"), F.col("o.id").alias("id"))


def _frequent(counts: DataFrame, keys: list[str], min_count: int, name: str) -> DataFrame:
    """Groups with ``min_count`` occurrences or more, each with an id of its own."""
    return written(counts.groupBy(*keys).agg(F.sum("n").alias("f")).filter(F.col("f") >= min_count)
                   .withColumn("id", F.monotonically_increasing_id()), name)


def mine(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> tuple[list[DataFrame], DataFrame]:
    """(groups, sizes): the frequent phrases of 1 to ``max_words`` words, a table for each length, and
    lang, n: the words of each lang.

    Tables have id and f (occurrences); that of single words has lang and word,
    the others a and b, the ids of the phrases without the last and the first
    word, which are of one lang."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text"))
    counted = written(rows.mapInArrow(_count_words, "lang string, word string, n long")
                      .groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    sizes = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    groups = [written(counted.filter(F.col("n") >= min_count).select("lang", "word", F.col("n").alias("f"),
                                                                     F.monotonically_increasing_id().alias("id")), "groups")]
    n, size = groups[0].agg(F.count(F.lit(1)), F.sum(F.octet_length("word") + F.octet_length("lang") + 8)).first()
    keyed = rows.withColumn("doc", F.monotonically_increasing_id())
    if (size or 0) <= GROUP_BYTES:
        sent = spark.sparkContext.broadcast(_sent_words(groups[0]))
        relation = written(keyed.mapInArrow(_first_relation(sent, max_words), OCCURRENCES), "occurrences")
    else:
        flat_rows = written(keyed.mapInArrow(_all_words(max_words), "lang string, doc long, end int, pos int, word string"), "positions")
        relation = written(_regrouped(flat_rows, groups[0], ["lang", "word"], n), "occurrences")
        remove(flat_rows)
    for k in range(2, max_words + 1):
        pairs = relation.mapInArrow(_count_pairs, "a long, b long, n long")
        groups.append(_frequent(pairs, ["a", "b"], min_count, "groups"))
        n = groups[-1].count()
        if k == max_words:
            break
        if n * PAIR_BYTES <= GROUP_BYTES:
            sent = spark.sparkContext.broadcast(_sent_pairs(groups[-1]))
            after = written(relation.mapInArrow(_next_relation(sent), OCCURRENCES), "occurrences")
        else:
            flat_rows = relation.mapInArrow(_all_pairs, "lang string, doc long, end int, pos int, a long, b long")
            after = written(_regrouped(flat_rows, groups[-1], ["a", "b"], n), "occurrences")
        remove(relation)
        relation = after
    remove(relation)
    return groups, sizes


def _exact(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def _scored(groups: list[DataFrame], scale: int) -> list[DataFrame]:
    """The phrases of two words and more: lang, id, phrase, a, l, r, score, and subs, the (length, id)
    of the phrases of two words and more inside.

    left holds f of the first 1, 2, ... words of a phrase and right f of its last words."""
    known = [groups[0].select("lang", "id", F.col("word").alias("phrase"), F.col("word").alias("last"), F.col("f").alias("a"),
                              F.array().cast("array<long>").alias("left"), F.array().cast("array<long>").alias("right"),
                              F.array().cast("array<struct<len:int,id:long>>").alias("subs"))]
    out = []
    for k in range(2, len(groups) + 1):
        part, n, n_new = written(known[-1], "phrases"), groups[k - 2].count(), groups[k - 1].count()
        side = lambda s: part.select(F.col("id").alias(s), F.struct("lang", "phrase", "last", "a", "left", "right", "subs").alias(f"{s}_"))
        met = lookup(groups[k - 1], side("a"), ["a"], F.col("b"), n, "inner", n_new)
        met = lookup(met, side("b").withColumn("b_", F.col("b_").dropFields("lang", "phrase", "left")), ["b"], F.col("a"), n, "inner", n_new)
        # f of the first 1..k-1 words, and of the last 1..k-1
        left = F.concat("a_.left", F.array("a_.a"))
        right = F.concat("b_.right", F.array("b_.a"))
        inside = F.array_union("a_.subs", "b_.subs")
        if k > 2:
            inside = F.array_union(inside, F.array(F.struct(F.lit(k - 1).alias("len"), F.col("a").alias("id")),
                                                   F.struct(F.lit(k - 1).alias("len"), F.col("b").alias("id"))))
        new = met.select("a_.lang", "id", F.concat_ws(" ", "a_.phrase", "b_.last").alias("phrase"), F.col("b_.last").alias("last"),
                         F.col("f").alias("a"), left.alias("left"), right.alias("right"), inside.alias("subs"))
        known.append(new)
        cuts = []
        for c in range(1, k):
            l, r = F.element_at("left", c), F.element_at("right", k - c)
            top = _exact(F.col("a")) * F.lit(scale).cast("decimal(10,0)")
            cuts.append(F.struct(F.floor(top / (_exact(l) + _exact(r))).cast("long").alias("score"),
                                 F.lit(c).alias("k"), l.alias("l"), r.alias("r")))
        best = F.array_min(F.array(*cuts))
        out.append(new.withColumn("cut", best).select("lang", "id", F.lit(k).alias("len"), "phrase", "a", F.col("cut.l").alias("l"),
                                                      F.col("cut.r").alias("r"), F.col("cut.score").alias("score"), "subs"))
    return out


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, top: int = TOP,
                 scale: int = SCALE, cover: int = COVER) -> DataFrame:
    """The first ``top`` phrases of every lang by score: lang, rank, phrase, a, l, r, n, score.

    a counts the phrase, l and r the parts of its lowest-scoring cut, n all
    words of the lang.  A phrase inside a longer frequent one that holds
    ``cover`` percent of its occurrences is left out.  A null lang is ``und``;
    null, empty and unbroken texts have no phrases; repeated rows count each;
    equal scores go by a (larger first), then phrase in byte order; a lang
    without phrases and an empty table give no rows; further columns are
    ignored."""
    groups, sizes = mine(docs, max_words, min_count)
    found = _scored(groups, scale)
    every = written(found[0] if len(found) == 1 else _union(found), "candidates")
    longer = (every.select(F.col("a").alias("more"), F.explode("subs").alias("s"))
              .groupBy(F.col("s.len").alias("len"), F.col("s.id").alias("id")).agg(F.max("more").alias("more")))
    covered = F.coalesce(_exact(F.col("more")) * 100 >= _exact(F.col("a")) * cover, F.lit(False))
    kept = every.join(longer.hint("merge"), ["len", "id"], "left").filter(~covered).select("lang", "phrase", "a", "l", "r", "score")
    first = numbered(kept, ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()], "ranks").filter(F.col("slot") < top)
    sizes = written(sizes, "sizes")
    return lookup(first, sizes, ["lang"], F.col("phrase"), sizes.count()).select(
        "lang", (F.col("slot") + 1).cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def oracle(min_count: int = MIN_COUNT, top: int = TOP, scale: int = SCALE, cover: int = COVER) -> str:
    """DuckDB SQL for ``collocations``: every phrase of 1 to 4 words, counted as text."""
    grams = " UNION ALL ".join(
        f"SELECT lang, {k} AS k, unnest(list_transform(range(1, greatest(len(w) - {k - 2}, 1)), lambda i: w[i:i + {k - 1}])) AS p FROM words" for k in (1, 2, 3, 4))
    return f"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM texts),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS ({grams}),
f AS MATERIALIZED (SELECT lang, k, p, count(*) AS a FROM grams GROUP BY lang, k, p HAVING count(*) >= {min_count}),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
cuts AS (SELECT lang, k, p, a, unnest(range(1, k)) AS c FROM f WHERE k > 1),
scores AS (SELECT x.lang, x.p, x.a, x.c, l.a AS l, r.a AS r, (CAST({scale} AS HUGEINT) * x.a) // (l.a + r.a) AS score
  FROM cuts x JOIN f l ON l.lang = x.lang AND l.p = x.p[1:x.c] JOIN f r ON r.lang = x.lang AND r.p = x.p[x.c + 1:x.k]),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, c) = 1),
parts AS (SELECT lang, a, p, unnest(range(1, k + 1)) AS i, k FROM f WHERE k > 2),
subs AS (SELECT lang, a, p, i, unnest(range(i + 1, k + 1)) AS j, k FROM parts),
inside AS (SELECT lang, p[i:j] AS p, max(a) AS more FROM subs WHERE j - i + 1 < k GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inside s ON s.lang = b.lang AND s.p = b.p WHERE s.more IS NULL OR s.more * 100 < b.a * {cover}),
named AS (SELECT *, array_to_string(p, ' ') AS phrase FROM kept)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM named) JOIN sizes USING (lang)
WHERE rank <= {top}"""
