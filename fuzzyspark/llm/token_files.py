"""Token-id files: documents as ids of a public tokenizer, range-coded in checksummed blocks.

A set of files is a Parquet table of segments.  A segment holds whole
documents in ascending order: their ids and token counts, and the ids of all
of them cut into blocks, each coded on its own by ``range_coder`` with the
CRC-32 of its ids.  part and segment number the segments in document order.
Spark writes and reads the files, so any store of the cluster will do, and a
task that is lost is done again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fuzzyspark.llm.common import lookup, scratch_path, text_of
from fuzzyspark.llm.range_coder import BLOCK, decode, encode

TOKENIZER, END_ID = "word_bpe_49k.json", 2
#: ids of a segment (a longer document makes one alone), blocks coded in step, words kept with their ids
SEGMENT, LANES, WORDS = 1 << 19, 2048, 800_000
#: marks that are tokens of their own behind letters
MARKS = ".,:;!?"
SEGMENTS = ("part int, segment int, doc_ids array<long>, doc_tokens array<long>, n_ids long, "
            "block_ids array<int>, blocks array<binary>, checks array<long>")
DIGEST = "part int, segment int, doc_id long, before long, n_tokens long, ids_crc32 long"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokens:
    """Ids of texts by way of their words, which are tokenized once each.

    Texts are cut at spaces and line feeds only, over which no token reaches:
    the tokenizer drops white space and composes no character across it.  A
    word of ASCII letters with one mark behind it is cut before the mark, as
    the tokenizer cuts it, and its letters are looked up in lower case.  Up to
    ``WORDS`` words are kept; once so many are known, others are tokenized for
    the texts at hand only."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.place: dict[str, int] = {}
        self.flat, self.start = np.zeros(0, np.uint16), np.zeros(1, np.int64)

    def _encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _new(self, words: list[str]) -> list[list[int]]:
        """Ids of words: those of stem and mark where a word has that form."""
        stems = [w[:-1] if w[-1:] in MARKS and w[:-1].isascii() and w[:-1].isalpha() else w for w in words]
        stems = [s.lower() if s.isascii() and s.isalpha() else s for s in stems]
        known, marks = self.place, {m: i for m, i in zip(MARKS, self._encode(list(MARKS)))}
        todo = list({s for s in stems if s not in known})
        made = dict(zip(todo, self._encode(todo)))
        flat, start = self.flat, self.start
        out = []
        for w, s in zip(words, stems):
            ids = made.get(s)
            if ids is None:
                k = known[s]
                ids = flat[start[k]:start[k + 1]].tolist()
            out.append(ids + marks[w[-1]] if len(s) < len(w) else ids)
        return out

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has)."""
        words, per = [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            w = t.replace("\n", " ").split(" ")
            words += w
            per[i] = len(w)
        place, flat, start = self.place, self.flat, self.start
        new = list({w for w in words if w not in place})
        if new:
            found = self._new(new)
            n = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.concatenate((flat, np.fromiter((i for x in found for i in x), np.uint16, int(n.sum()))))
            start = np.concatenate((start, start[-1] + np.cumsum(n)))
            added = dict(zip(new, range(len(place), len(place) + len(new))))
            if len(place) + len(new) <= WORDS:
                place.update(added)
                self.flat, self.start, added = flat, start, {}
            at = np.fromiter((place[w] if w in place else added[w] for w in words), np.int64, len(words))
        else:
            at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        a, n = start[at], start[at + 1] - start[at]
        ids = flat[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        total = np.concatenate(([0], np.cumsum(n)))
        cut = np.concatenate(([0], np.cumsum(per)))
        return ids, total[cut[1:]] - total[cut[:-1]]


_KNOWN: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """The word store of this Python worker, which its tasks share."""
    if path not in _KNOWN:
        _KNOWN[path] = WordTokens(path)
    return _KNOWN[path]


def _with_end(ids: np.ndarray, n: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, np.cumsum(n), end_id), n + 1


def _checks(blocks: list[np.ndarray]) -> list[int]:
    return [zlib.crc32(b.astype("<u4").tobytes()) for b in blocks]


def _segments(path: str, end_id: int):
    """Documents in order -> the rows of the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens(path)
        part, segment, n_blocks = 0, 0, 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []  # closed segments: doc ids, counts, ids
        docs, counts, ids, size = [], [], [], 0

        def close() -> None:
            nonlocal docs, counts, ids, size, n_blocks
            flat = np.concatenate(ids)
            held.append((docs, np.array(counts, np.int64), flat))
            n_blocks += -(-len(flat) // BLOCK)
            docs, counts, ids, size = [], [], [], 0

        def write() -> pa.RecordBatch:
            nonlocal held, n_blocks, segment
            cut = [[flat[i:i + BLOCK] for i in range(0, len(flat), BLOCK)] for _, _, flat in held]
            codes = encode([b for c in cut for b in c])
            rows, at = [], 0
            for (d, c, flat), blocks in zip(held, cut):
                rows.append({"part": part, "segment": segment, "doc_ids": d, "doc_tokens": c.tolist(), "n_ids": len(flat),
                             "block_ids": [len(b) for b in blocks], "blocks": codes[at:at + len(blocks)], "checks": _checks(blocks)})
                at += len(blocks)
                segment += 1
            held, n_blocks = [], 0
            return pa.RecordBatch.from_pylist(rows, _SEGMENT)

        for batch in batches:
            part = batch.column("part")[0].as_py()
            text, doc_id = batch.column("text"), batch.column("doc_id").to_pylist()
            for i in range(0, batch.num_rows, 512):  # some texts at a time
                flat, n = _with_end(*words.ids(pc.fill_null(text.slice(i, 512), "").to_pylist()), end_id)
                stop = np.cumsum(n)
                for k, (a, b) in enumerate(zip((stop - n).tolist(), stop.tolist())):
                    if size and size + b - a > SEGMENT:
                        close()
                    docs.append(doc_id[i + k])
                    counts.append(b - a)
                    ids.append(flat[a:b])
                    size += b - a
                if n_blocks >= LANES:
                    yield write()
        if size:
            close()
        if held:
            yield write()

    return run


_SEGMENT = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
                      ("doc_tokens", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("block_ids", pa.list_(pa.int32())),
                      ("blocks", pa.list_(pa.binary())), ("checks", pa.list_(pa.int64()))])


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Write the ids of every document, in ascending doc_id order (nulls first, then by a hash of the text).

    tokenizer: path of a tokenizer file on the workers.  A null text counts as
    empty: its end id alone.  Repeated rows are written each; an empty table
    makes files without segments; further columns are ignored."""
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
               .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc())
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()))
    rows = ordered.withColumn("part", F.spark_partition_id())
    rows.mapInArrow(_segments(tokenizer or tokenizer_path(), end_id), SEGMENTS).write.parquet(path)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray]]:
    """Segments and their ids; a block whose checksum differs raises an error."""
    def flush(rows: list[dict]) -> Iterator[tuple[dict, np.ndarray]]:
        n = [k for r in rows for k in r["block_ids"]]
        blocks = decode([b for r in rows for b in r["blocks"]], np.array(n, np.int64))
        at = 0
        for r in rows:
            own = blocks[at:at + len(r["blocks"])]
            at += len(own)
            for k, (got, want) in enumerate(zip(_checks(own), r["checks"])):
                if got != want:
                    raise ValueError(f"part {r['part']}, segment {r['segment']}, block {k}: checksum {got}, not {want}")
            yield r, np.concatenate(own).astype(np.int64)

    held, n = [], 0
    for batch in batches:
        for r in batch.to_pylist():
            held.append(r)
            n += len(r["blocks"])
            if n >= LANES:
                yield from flush(held)
                held, n = [], 0
    if held:
        yield from flush(held)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """part, segment, doc_id, ids of every document in the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, ids in _decoded(batches):
            cut = np.concatenate(([0], np.cumsum(r["doc_tokens"])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["part"]] * len(r["doc_ids"]), pa.int32()), pa.array([r["segment"]] * len(r["doc_ids"]), pa.int32()),
                 pa.array(r["doc_ids"], pa.int64()), pa.LargeListArray.from_arrays(pa.array(cut, pa.int64()), pa.array(ids)).cast(pa.list_(pa.int64()))],
                ["part", "segment", "doc_id", "ids"])

    return spark.read.schema(SEGMENTS).parquet(path).mapInArrow(run, "part int, segment int, doc_id long, ids array<long>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files.

    start counts the ids of all documents before: those before in its segment,
    in earlier segments of its part and in earlier parts, summed up by part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, ids in _decoded(batches):
            raw = ids.astype("<u4").tobytes()
            n = np.array(r["doc_tokens"], np.int64)
            end = np.cumsum(n)
            crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip((end - n).tolist(), end.tolist())]
            k = len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["part"]] * k, pa.int32()), pa.array([r["segment"]] * k, pa.int32()), pa.array(r["doc_ids"], pa.int64()),
                 pa.array(end - n), pa.array(n), pa.array(crc, pa.int64())], ["part", "segment", "doc_id", "before", "n_tokens", "ids_crc32"])

    files = spark.read.schema(SEGMENTS).parquet(path)
    sizes = files.select("part", "segment", "n_ids")
    own = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))  # as many rows as tasks wrote
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    begin = sizes.join(parts, "part").select(
        "part", "segment", (F.col("base") + F.coalesce(F.sum("n_ids").over(own), F.lit(0))).alias("begin"))
    docs = files.mapInArrow(run, DIGEST)
    return lookup(docs, begin, ["part", "segment"], F.col("doc_id"), sizes.count()).select(
        "doc_id", (F.col("begin") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the files (into the shared folder where no path is given) and read their digests back."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-files")
    write_token_files(docs, path, tokenizer, end_id)
    return read_digests(spark, path)
