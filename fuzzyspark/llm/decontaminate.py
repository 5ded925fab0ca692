"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents read by one task.  Its words become symbols: a
word of the benchmark its number, any other word a break, as no window can
reach over one; stretches too short for the shortest window are left out.  The
index is the shard's Burrows-Wheeler transform in a wavelet matrix with
sampled suffix positions.  All test phrases are searched backward at once,
their occurrences located by walking to the nearest sample, and the covered
words merged to removal spans.

Test phrases are sent to the tasks in blocks of bounded size; further blocks
take further passes that add to the spans of the earlier ones.  No pass
shuffles anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fuzzyspark.llm.common import packed, text_of, unpacked
from fuzzyspark.llm.words import flat, word_array, word_bounds, word_hashes

WINDOW = 10
#: bytes of text in a shard, in a tokenised piece of it, and of benchmark text in a block
SHARD_BYTES, PIECE_BYTES, BLOCK_BYTES = 48 << 20, 4 << 20, 16 << 20
#: every so many text positions keep their suffix position
SAMPLE = 8
FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType()))])
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes in order by prefix doubling; breaks (0) are distinct, in text order, before all symbols."""
    n = len(s)
    breaks = np.flatnonzero(s == 0)
    rank = s.astype(np.int64) + len(breaks)
    rank[breaks] = np.arange(len(breaks))
    k = 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[:-k] = rank[k:] + 1
        key = rank * np.int64(max(int(rank.max()), n) + 2) + nxt
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank[order] = new
        if new[-1] == n - 1 or k >= n:
            return order
        k *= 2


class FMIndex:
    """The index of a sequence of symbols; 0 is a break, and the last symbol must be one."""

    def __init__(self, s: np.ndarray, n_symbols: int, sample: int = SAMPLE):
        sa = suffix_array(s)
        bwt = s[sa - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=n_symbols + 1))))
        self.bits = max(1, int(n_symbols).bit_length())
        self.ones, self.zeros = [], []
        seq = bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (seq >> b) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int64))))
            self.zeros.append(len(seq) - int(bit.sum()))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))
        keep = (sa % sample == 0) | (bwt == 0)  # a walk ends at the latest where a stretch begins
        self.kept = keep
        self.kept_rank = np.cumsum(keep) - 1
        self.kept_at = sa[keep]
        self.n = len(s)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol c among the first i of the transform."""
        lo, hi = np.zeros_like(i), i
        for level in range(self.bits):
            ones, zeros = self.ones[level], self.zeros[level]
            one = ((c >> (self.bits - 1 - level)) & 1).astype(bool)
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo

    def symbol(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for level in range(self.bits):
            ones, zeros = self.ones[level], self.zeros[level]
            a = ones[i]
            one = ones[i + 1] > a
            out = out * 2 + one
            i = np.where(one, zeros + a, i - a)
        return out

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of each phrase; phrases are right-aligned in the matrix."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.n, np.int64)
        for step in range(phrases.shape[1]):
            on = np.flatnonzero((lengths > step) & (hi > lo))
            c = phrases[on, phrases.shape[1] - 1 - step]
            lo[on] = self.first[c] + self.rank(c, lo[on])
            hi[on] = self.first[c] + self.rank(c, hi[on])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        at = np.zeros(len(rows), np.int64)
        left, row, steps = np.arange(len(rows)), rows.copy(), 0
        while len(left):
            done = self.kept[row]
            at[left[done]] = self.kept_at[self.kept_rank[row[done]]] + steps
            left, row = left[~done], row[~done]
            c = self.symbol(row)
            row = self.first[c] + self.rank(c, row)
            steps += 1
        return at


class Phrases:
    """The windows of a block of benchmark items, over the symbols of the block's words."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        data, offsets = flat(pa.array(texts, pa.string()))
        w, starts, ends, first = word_bounds(data, offsets)
        coded = word_array(w, starts, ends).dictionary_encode()
        self.vocabulary = coded.dictionary
        symbol = coded.indices.to_numpy().astype(np.int64) + 1
        rows: dict[tuple, set] = {}
        for k, name in enumerate(ids):
            own = symbol[first[k]:first[k + 1]].tolist()
            for i in range(max(1, len(own) - window + 1) if own else 0):
                rows.setdefault(tuple(own[i:i + window]), set()).add(name)
        self.items = [sorted(x) for x in rows.values()]
        self.lengths = np.array([len(x) for x in rows], np.int64)
        self.shortest = int(self.lengths.min()) if rows else 1
        self.matrix = np.zeros((len(rows), window), np.int64)
        for k, x in enumerate(rows):
            self.matrix[k, window - len(x):] = x
        self.hashes = np.unique(word_hashes(w, starts, ends))
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def symbols(self, w: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The symbol of each word: hashes rule out most others, the words themselves decide."""
        h = word_hashes(w, starts, ends)
        out = np.zeros(len(h), np.int64)
        maybe = np.flatnonzero(self.filter[(h & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
        maybe = maybe[self.hashes[at] == h[maybe]]
        words = word_array(w, starts, ends).take(pa.array(maybe))
        out[maybe] = pc.fill_null(pc.index_in(words, self.vocabulary), -1).to_numpy() + 1
        return out


def _stretches(sym: np.ndarray, first: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of symbols within a text that can hold a window."""
    on = sym > 0
    begin, stop = on.copy(), on.copy()
    begin[1:] &= ~on[:-1]
    stop[:-1] &= ~on[1:]
    cut = first[1:-1]
    cut = cut[(cut > 0) & (cut < len(on))]
    begin[cut] = on[cut]
    stop[cut - 1] = on[cut - 1]
    a, b = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    long = b - a >= shortest
    return a[long], b[long]


def search_shard(texts: list[pa.Array], p: Phrases):
    """Texts of a shard -> words of each text, merged spans (text, start, end), pairs (text, phrase)."""
    n_words, syms, where, whose, base = [], [], [], [], 0
    for arr in texts:
        data, offsets = flat(arr)
        # whole texts, several at a time
        pieces = np.unique(np.searchsorted(offsets, np.arange(0, int(offsets[-1]) + PIECE_BYTES, PIECE_BYTES), "left"))
        pieces = np.unique(np.concatenate((pieces[pieces <= len(arr)], [0, len(arr)])))
        for i, j in zip(pieces[:-1], pieces[1:]):
            w, starts, ends, first = word_bounds(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            n_words.append(np.diff(first))
            if not len(starts) or not len(p.lengths):
                continue
            sym = p.symbols(w, starts, ends)
            a, b = _stretches(sym, first, p.shortest)
            if len(a):
                n = b - a + 1  # each stretch with a break behind it
                at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                end = np.cumsum(n) - 1
                s = sym[np.minimum(at, len(sym) - 1)]
                s[end] = 0
                text = np.searchsorted(first, a, "right") - 1
                syms.append(s)
                where.append(at - np.repeat(first[text], n))
                whose.append(np.repeat(text + base + i, n))
        base += len(arr)
    n_words = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
    none = np.zeros(0, np.int64)
    if not syms:
        return n_words, (none, none, none), (none, none)
    s, where, whose = np.concatenate(syms), np.concatenate(where), np.concatenate(whose)
    fm = FMIndex(s, len(p.vocabulary))
    lo, hi = fm.search(p.matrix, p.lengths)
    n = np.maximum(hi - lo, 0)
    phrase = np.repeat(np.arange(len(n)), n)
    rows = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    at = fm.locate(rows)
    cover = np.zeros(len(s) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + p.lengths[phrase], -1)
    hit = np.cumsum(cover[:-1]) > 0  # breaks are never hit, so a span stays in its stretch
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    pair = np.unique(whose[at] * np.int64(len(n)) + phrase)
    return n_words, (whose[a], where[a], where[b - 1] + 1), (pair // len(n), pair % len(n))


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _text(batch: pa.RecordBatch) -> pa.Array:
    """The texts of the packed rows; nulls read as empty."""
    return pc.struct_field(batch.column("row"), "text")


def _search_pass(column: str, sent) -> callable:
    """A function of record batches that adds the finds of a block to those of earlier blocks."""

    def flush(held: list[pa.RecordBatch], p: Phrases) -> Iterator[pa.RecordBatch]:
        n_words, (text, a, b), (pair_text, pair_phrase) = search_shard([_text(x) for x in held], p)
        spans: dict[int, list] = {}
        for t, x, y in zip(text.tolist(), a.tolist(), b.tolist()):
            spans.setdefault(t, []).append((x, y))
        items: dict[int, set] = {}
        for t, k in zip(pair_text.tolist(), pair_phrase.tolist()):
            items.setdefault(t, set()).update(p.items[k])
        base = 0
        for batch in held:
            n = batch.num_rows
            old = batch.column(column) if column in batch.schema.names else None
            found = []
            for i in range(n):
                was = old[i].as_py() if old is not None else {"spans": [], "items": []}
                both = [(s["start"], s["end"]) for s in was["spans"]] + spans.get(base + i, [])
                found.append({"n_words": int(n_words[base + i]),
                              "spans": [{"start": x, "end": y} for x, y in _merge(both)],
                              "items": sorted({*was["items"], *items.get(base + i, ())})})
            base += n
            kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(_SPAN)), ("items", pa.list_(pa.string()))])
            names = [x for x in batch.schema.names if x != column]
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in names], pa.array(found, kind)], [*names, column])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, held, size = sent.value, [], 0
        for batch in batches:
            held.append(batch)
            size += _text(batch).nbytes
            if size >= SHARD_BYTES:
                yield from flush(held, p)
                held, size = [], 0
        if held:
            yield from flush(held, p)

    return run


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """row, a struct of every document's columns, and ``found``: n_words, the merged spans of hit words
    (numbers from 0, end exclusive) and the ids of the items that hit, as strings, sorted.

    A null text has no words; an item without words has no windows; items of
    one id count as one, a null id as the empty string.  Words are equal if
    their folded bytes are.  Repeated rows get a result each; without items
    nothing is hit; an empty table gives no rows; columns of docs may have any
    names."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), text_of().alias("text")).dropDuplicates(["id", "text"])
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    out = packed(docs)
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).collect()
        sent = spark.sparkContext.broadcast(Phrases([r.id for r in rows], [r.text for r in rows], window))
        schema = T.StructType([f for f in out.schema.fields if f.name != "found"] + [T.StructField("found", FOUND)])
        out = out.mapInArrow(_search_pass("found", sent), schema)
    return out


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document; see ``find``."""
    f = find(docs.select("doc_id", "text"), benchmark, window)
    hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return f.select("row.doc_id", F.col("found.n_words").alias("n_words"), hit.alias("n_hit"),
                    F.size("found.items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a hit word, with the columns they had; see ``find`` for nulls, empty texts,
    repeated rows, empty tables and names of columns.  Documents without words stay."""
    return unpacked(find(docs, benchmark, window).filter(F.size("found.spans") == 0))
