"""SimHash near-duplicates by multi-index hashing.

Fingerprints are majority votes over the hashes of word shingles.  Distinct
fingerprints are cut into segments; within ``max_bits`` differing bits, some
segment differs by no more than its radius (radii + segments > max_bits), so a
fingerprint looks up the Hamming ball of that radius around each of its
segments in the table of that segment, and complete distances are verified.
Of two different keys the larger looks up the smaller, so each match is met
once.  A bucket of the table that is crowded is cut into blocks, and every
pair of blocks is a group of its own; a task keeps a spanning star of the
links it has found, not the links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fuzzyspark.llm.common import lookup, packed, text_of, unpacked, written
from fuzzyspark.llm.components import components, star
from fuzzyspark.llm.words import flat, word_bounds

SHINGLE, MAX_BITS, SEED = 4, 4, 42
#: fingerprints of a block of a crowded bucket, look-ups met with one block, rows of a task, pairs at a time
BLOCK, PROBES, TASK_ROWS, PAIRS = 4096, 65_536, 400_000, 1 << 21
PIECE_BYTES = 4 << 20
#: a fingerprint with more than 1/HEAVY of all rows is joined by broadcast: at most HEAVY such
HEAVY = 1000
#: from this many distinct fingerprints on, two segments of 32 bits in place of three
WIDE_FROM = 1 << 27
#: bytes other than white space [\x20\x09-\x0D], A-Z folded
VISIBLE = np.arange(256, dtype=np.uint8)
VISIBLE[65:91] = np.arange(97, 123)
VISIBLE[[32, 9, 10, 11, 12, 13]] = 0


def _fold(data: np.ndarray) -> np.ndarray:
    """A NUL is a visible character; it is kept apart from the mark of white space."""
    return np.where(data == 0, np.uint8(1), data)


def majority(h: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprint of each group of hashes: bits set in over half of them."""
    chunks = -(-counts // 255)  # sums of up to 255 ones fit a byte
    of = np.repeat(np.arange(len(counts)), chunks)
    nth = np.arange(int(chunks.sum())) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    at = starts[of] + nth * 255
    first = np.cumsum(chunks) - chunks
    out = np.zeros(len(counts), np.uint64)
    ones = np.uint64(0x0101010101010101)
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & ones, at)
        votes = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        over = (2 * votes > counts[:, None]).astype(np.uint64)
        for lane in range(8):
            out |= over[:, lane] << np.uint64(8 * lane + bit)
    return out


def fingerprints_of(texts: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    data, offsets = flat(texts)
    out = np.zeros(len(texts), np.uint64)
    cuts = np.searchsorted(offsets, np.arange(0, int(offsets[-1]) + PIECE_BYTES, PIECE_BYTES), "left")
    cuts = np.unique(np.concatenate((cuts[cuts <= len(texts)], [0, len(texts)])))
    digest = xxhash.xxh64_intdigest
    for i, j in zip(cuts[:-1], cuts[1:]):
        raw = data[offsets[i]:offsets[j]]
        w, starts, ends, first = word_bounds(_fold(raw), offsets[i:j + 1] - offsets[i], VISIBLE)
        n = np.diff(first)
        if not len(starts):
            continue
        # the words joined by single spaces
        lens = ends - starts
        to = np.cumsum(lens + 1) - (lens + 1)
        joined = np.full(int(lens.sum()) + len(lens), 32, np.uint8)
        on = w != 0
        place = np.arange(int(lens.sum())) + np.repeat(np.arange(len(lens)), lens)
        folded = w[on]
        joined[place] = np.where(raw[on] == 0, np.uint8(0), folded)
        count = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
        some = np.flatnonzero(count)
        at = np.repeat(first[:-1][some] - (np.cumsum(count[some]) - count[some]), count[some]) + np.arange(int(count.sum()))
        stop = np.minimum(at + shingle, np.repeat(first[1:][some], count[some])) - 1
        buf = joined.tobytes()
        h = np.fromiter((digest(buf[a:b], seed) for a, b in zip(to[at].tolist(), (to[stop] + lens[stop]).tolist())),
                        np.uint64, len(at))
        out[some + i] = majority(h, np.cumsum(count[some]) - count[some], count[some])
    return out


def fingerprints(docs: DataFrame, keep: list[str], shingle: int = SHINGLE) -> DataFrame:
    """The columns ``keep`` of every document and fp, its fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array(fingerprints_of(batch.column("__text"), shingle).view(np.int64))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], fp], [*keep, "fp"])

    rows = docs.select(*keep, text_of().alias("__text"))
    return rows.mapInArrow(run, T.StructType([*docs.select(*keep).schema.fields, T.StructField("fp", T.LongType())]))


def segments(n: int, max_bits: int = MAX_BITS) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment: three, or two for very many fingerprints."""
    m = 3 if n < WIDE_FROM else 2
    widths = [64 // m + (i < 64 % m) for i in range(m)]
    spare = max(0, max_bits + 1 - m)  # radii that add up to max_bits + 1 - m
    radii = [spare // m + (i >= m - spare % m) for i in range(m)]
    return [(sum(widths[:i]), widths[i], radii[i]) for i in range(m)]


def _groups(fps: DataFrame, n: int, max_bits: int) -> DataFrame:
    """seg, key, fp, own: every fingerprint at its own key and at the smaller keys of its balls."""
    def cells(s: int, shift: int, width: int, radius: int):
        masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]
        key = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        ball = F.filter(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: key.bitwiseXOR(m)),
                        lambda x: x <= key)
        return F.transform(ball, lambda x: F.struct(
            F.lit(s).cast("byte").alias("seg"), x.alias("key"), (x == key).alias("own")))

    all_cells = F.concat(*[cells(s, *x) for s, x in enumerate(segments(n, max_bits))])
    return fps.select("fp", F.explode(all_cells).alias("c")).select("c.seg", "c.key", "fp", "c.own")


def _blocked(rows: DataFrame) -> DataFrame:
    """Add block: rows of a crowded bucket go to all pairs of its blocks of owners and of look-ups."""
    crowded = (rows.groupBy("seg", "key").agg(F.sum(F.col("own").cast("long")).alias("t"), F.count(F.lit(1)).alias("n"))
               .filter((F.col("t") > 0) & (F.col("n") > PROBES) | (F.col("t") > BLOCK)))
    crowded = written(crowded.select("seg", "key", F.ceil(F.col("t") / BLOCK).cast("int").alias("nt"),
                                     F.ceil(F.col("n") / PROBES).cast("int").alias("np")), "crowded")
    met = lookup(rows, crowded, ["seg", "key"], F.col("fp"), crowded.count())
    nt, np_ = F.coalesce("nt", F.lit(1)), F.coalesce("np", F.lit(1))
    own_block = F.pmod(F.xxhash64("fp"), nt).cast("int")
    slot = F.pmod(F.xxhash64("fp", F.lit(1)), np_).cast("int")
    # an owner stands in its block once for every slot of look-ups; it looks up earlier blocks like a look-up
    cell = lambda b, s, own: F.struct(b.alias("block"), s.alias("slot"), F.lit(own).alias("own"))
    held = F.transform(F.sequence(F.lit(0), np_ - 1), lambda s: cell(own_block, s, True))
    earlier = F.transform(F.filter(F.sequence(F.lit(0), nt - 1), lambda b: b < own_block), lambda b: cell(b, slot, False))
    probing = F.transform(F.sequence(F.lit(0), nt - 1), lambda b: cell(b, slot, False))
    return met.withColumn("c", F.explode(F.when(F.col("own"), F.concat(held, earlier)).otherwise(probing))).select(
        "seg", "key", F.col("c.block").alias("block"), F.col("c.slot").alias("slot"), "fp", F.col("c.own").alias("own"))


def _links_within(max_bits: int):
    """Links among the groups of a task, as stars; pairs are formed some at a time and only in memory."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list[np.ndarray]] = [[], [], []]
        for b in batches:
            for c, name in zip(cols, ("g", "fp", "own")):
                c.append(b.column(name).to_numpy(zero_copy_only=False))
        if not cols[0] or not sum(map(len, cols[0])):
            return
        g, fp, own = (np.concatenate(c) for c in cols)
        order = np.lexsort((fp, ~own, g))  # owners stand first in their group
        g, fp, own = g[order], fp[order].view(np.uint64), own[order]
        first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        size = np.diff(np.concatenate((first, [len(g)])))
        owners = np.add.reduceat(own.astype(np.int64), first)
        at, nth = np.repeat(first, size), np.arange(len(g))
        end = at + np.repeat(owners, size)
        start = np.where(own, nth + 1, at)  # an owner meets the owners behind it, a look-up all owners
        n = np.maximum(end - start, 0)
        some = np.flatnonzero(n)
        total = np.cumsum(n[some])
        a = b = np.zeros(0, np.uint64)
        done = 0
        while done < len(some):
            stop = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + PAIRS, "right")))
            rows, k = some[done:stop], n[some[done:stop]]
            other = np.repeat(start[rows] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            x, y = np.repeat(fp[rows], k), fp[other]
            near = np.bitwise_count(x ^ y) <= max_bits
            near &= x != y
            if near.any():
                a, b = star(np.concatenate((a, x[near])), np.concatenate((b, y[near])))
            done = stop
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
    return run


def links(fps: DataFrame, n: int, max_bits: int = MAX_BITS) -> DataFrame:
    """a, b: links that connect the fingerprints within max_bits of each other.  fps: distinct fp, n of them."""
    rows = _blocked(_groups(fps, n, max_bits))
    per = sum(1 + sum(1 for _ in combinations(range(w), 1)) * (r > 0) * (w // 2 if r > 1 else 1) for _, w, r in segments(n, max_bits))
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * per // TASK_ROWS))
    grouped = rows.select(F.xxhash64("seg", "key", "block", "slot").alias("g"), "fp", "own").repartition(parts, "g")
    return grouped.mapInArrow(_links_within(max_bits), "a long, b long")


def grouped(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS):
    """(rows, groups): rows has doc_id, th, fp by document; groups has fp, n, root, rep and member by
    distinct fingerprint: rep the least (null, doc_id, th) of the component, component_id its doc_id."""
    keyed = docs.select("doc_id", "text").withColumn("th", F.xxhash64(text_of()))
    rows = written(fingerprints(keyed, ["doc_id", "th"], shingle), "fingerprints")
    rep = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("th").alias("th"))
    fps = written(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min(rep).alias("rep")), "distinct")
    n = fps.count()
    roots = components(links(fps.select("fp"), n, max_bits))
    whole = (fps.join(roots, fps.fp == roots.node, "left").select("fp", "n", "rep", F.coalesce("root", "fp").alias("root")))
    least = whole.groupBy("root").agg(F.min("rep").alias("least"))
    return rows, written(whole.join(least, "root").select("fp", "n", "root", "least"), "groups")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    component_id is the least doc_id reachable over links, null only where a
    component has null ids alone.  A null or empty text has no words and the
    fingerprint zero, linked like any other; fewer words than a shingle make
    one.  Repeated rows share their fingerprint and keep a result each; an
    empty table gives no rows; further columns are ignored."""
    rows, groups = grouped(docs, shingle, max_bits)
    total = groups.agg(F.sum("n")).first()[0] or 0
    ids = groups.select("fp", "n", F.col("least.doc_id").alias("component_id"))
    hot = F.col("n") * HEAVY > total
    heavy = ids.filter(hot).select("fp", F.col("component_id").alias("hot_id"), F.lit(True).alias("hot"))
    split = rows.join(F.broadcast(heavy), "fp", "left")
    name = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    rest = split.filter("hot IS NULL").join(ids.filter(~hot).select("fp", "component_id"), "fp")
    return split.filter("hot").select("doc_id", name, F.col("hot_id").alias("component_id")).unionByName(
        rest.select("doc_id", name, "component_id"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The document with the least doc_id of each component, with the columns it had.

    Of rows that repeat its doc_id and text one stays; a component of null ids
    alone keeps its row of the least text hash; null and empty texts are one
    component with all that is near zero.  An empty table gives no rows;
    columns may have any names."""
    rows, groups = grouped(docs, shingle, max_bits)
    chosen = groups.select("least.*").distinct()
    same = (F.col("x.doc_id").eqNullSafe(F.col("c.doc_id"))) & (F.col("x.th") == F.col("c.th"))
    copies = rows.alias("x").join(chosen.alias("c"), same, "left_semi").groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n"))
    copies = written(copies, "chosen")
    keyed = packed(docs).withColumn("t", F.xxhash64(text_of("row.text")))
    met = keyed.join(copies, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("th")))
    once = met.filter("n = 1")
    if not copies.filter("n > 1").isEmpty():  # repeated rows are reduced before they are dealt
        again = met.filter("n > 1").groupBy("doc_id", "th").agg(F.first("row").alias("row"))
        return unpacked(once.select("row").unionByName(again.select("row")))
    return unpacked(once)
