"""Toxicity by a weighted finite-state pattern grammar.

Words are read clause by clause.  A lexical transducer turns each word into a
symbol: insult (with a weight learnt from labels for the word or its stem),
threat, target, negation, reported speech, or other.  Machines for negation,
reported speech and target run over the symbols in step (their composition is
one machine over the product of their states) and mark every insult or threat
with the state it was read in.  The marked weights of the matched clauses are
a document's features; a logistic scorer over them is fitted to labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fuzzyspark.llm.common import text_of, written
from fuzzyspark.llm.words import ALNUM, _mix, flat, word_bounds, word_hashes

#: labelled rows the lexicon and the scorer are fitted on, at most
TRAIN_ROWS = 20_000
#: texts in which a lexical entry must occur, entries at most, and standard errors taken off a weight
LEAST, ENTRIES, CAUTION = 8, 5000, 3.0
#: bytes of the stems that stand for a word beside the word itself
STEMS = (4, 5, 6)
#: words over which a negation reaches
REACH = 3
PIECE_BYTES = 4 << 20
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

# fixed values: closed word classes of the grammar
CLASSES = {
    TARGET: "you your yours yourself he she they him her them du dich dir ihr euch sie er tu te toi vous il elle ils usted ustedes tú él ella ellos".split(),
    NEGATION: "not no never neither nor isn aren wasn nicht kein keine keinen nie niemals ne pas jamais aucun nunca jamás tampoco".split(),
    REPORT: "said says told claimed reported quoted wrote sagte sagt schrieb behauptete dit disait écrit affirmé dijo dice escribió afirmó".split(),
    THREAT: "kill hurt destroy beat burn punish die töten umbringen verletzen sterben tuer frapper détruire mourir matar golpear destruir morir".split(),
}
CLAUSE_END = np.zeros(256, bool)
CLAUSE_END[[10, 33, 46, 58, 59, 63]] = True  # newline ! . : ; ?


class Machine:
    """A finite-state machine: step[state][symbol] is the next state; state 0 starts a clause."""

    def __init__(self, step: list[list[int]]):
        self.step = step

    def beside(self, other: Machine) -> Machine:
        """The product machine: state = own * len(other) + other's."""
        m = len(other.step)
        return Machine([[self.step[a][s] * m + other.step[b][s] for s in range(6)]
                        for a in range(len(self.step)) for b in range(m)])


def _counting(symbol: int, reach: int) -> Machine:
    """State k > 0: the symbol was read reach - k words ago at most."""
    return Machine([[reach if s == symbol else max(k - 1, 0) for s in range(6)] for k in range(reach + 1)])


def _seen(symbol: int) -> Machine:
    return Machine([[1 if s == symbol else 0 for s in range(6)], [1] * 6])


GRAMMAR = _counting(NEGATION, REACH).beside(_seen(REPORT)).beside(_seen(TARGET))
N_FEATURES = 18


def read_clause(symbols: list[int], weights: list[float], out: np.ndarray) -> None:
    """Run the grammar over a clause and add its marked weights to a document's features."""
    state, marked = 0, []
    for s, w in zip(symbols, weights):
        state = GRAMMAR.step[state][s]
        if s == INSULT or s == THREAT:
            marked.append((s, state >> 2 > 0, (state >> 1) & 1, w))
    target = state & 1  # a target may stand before or behind
    for s, negated, reported, w in marked:
        out[(s == THREAT) * 8 + negated * 4 + reported * 2 + target] += w
        if s == INSULT:
            out[16] = max(out[16], w)
            out[17] += 1


def _hashes(words: list[str]) -> np.ndarray:
    data, offsets = flat(pa.array(words, pa.string()))
    w, starts, ends, _ = word_bounds(data, offsets)
    return word_hashes(w, starts, ends)


_CLASS_OF = {int(h): c for c, words in CLASSES.items() for h in _hashes(words)}


class Table:
    """Look-up of 64-bit keys with a filter before the search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def get(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, values) of the keys found."""
        if not len(self.keys):
            return np.zeros(0, np.int64), self.values[:0]
        maybe = np.flatnonzero(self.filter[(h & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        ok = self.keys[at] == h[maybe]
        return maybe[ok], self.values[at[ok]]


_CLASSES = Table(np.array(list(_CLASS_OF), np.uint64), np.array(list(_CLASS_OF.values()), np.int64))


def _keys(w: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
    """The word's own key and those of its stems; a word no longer than a stem has no such stem (0)."""
    lens, acc, out = ends - starts, np.zeros(len(starts), np.uint64), [h]
    for j in range(max(STEMS)):
        byte = w[np.minimum(starts + j, len(w) - 1)].astype(np.uint64) if len(w) else acc
        acc = acc * np.uint64(0x100000001B3) + byte + np.uint64(1)
        if j + 1 in STEMS:
            out.append(np.where(lens > j + 1, _mix(acc + np.uint64(j)), np.uint64(0)))
    return out


def pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole texts, some at a time: (first, behind the last, bytes, offsets)."""
    data, offsets = flat(texts)
    cuts = np.searchsorted(offsets, np.arange(0, int(offsets[-1]) + PIECE_BYTES, PIECE_BYTES), "left")
    cuts = np.unique(np.concatenate((cuts[cuts <= len(texts)], [0, len(texts)])))
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield i, j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]


def document_features(texts: pa.Array, lexicon: Table) -> np.ndarray:
    """One row of N_FEATURES per text."""
    out = np.zeros((len(texts), N_FEATURES))
    for i, j, data, offsets in pieces(texts):
        w, starts, ends, first = word_bounds(data, offsets, ALNUM)
        if not len(starts):
            continue
        h = word_hashes(w, starts, ends)
        weight = np.zeros(len(starts))
        for keys in _keys(w, starts, ends, h):
            at, v = lexicon.get(keys)
            np.maximum.at(weight, at, v)
        symbol = np.zeros(len(starts), np.int64)
        at, v = _CLASSES.get(h)
        symbol[at] = v
        symbol[weight > 0] = INSULT
        weight[symbol == THREAT] = 1.0
        marked = np.flatnonzero((symbol == INSULT) | (symbol == THREAT))
        if not len(marked):
            continue
        breaks = np.cumsum(CLAUSE_END[data])
        text = np.searchsorted(first, marked, "right") - 1
        clause = breaks[starts]  # words of one text and one number are a clause
        seen = set()
        for m, t in zip(marked.tolist(), text.tolist()):
            if (t, clause[m]) in seen:
                continue
            seen.add((t, clause[m]))
            a = max(int(first[t]), int(np.searchsorted(clause, clause[m], "left")))
            b = min(int(first[t + 1]), int(np.searchsorted(clause, clause[m], "right")))
            read_clause(symbol[a:b].tolist(), weight[a:b].tolist(), out[i + t])
    return out


def _inputs(x: np.ndarray) -> np.ndarray:
    return np.hstack((np.ones((len(x), 1)), np.log1p(x)))


def score(x: np.ndarray, coef: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(_inputs(x) @ coef, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the intercept is not shrunk."""
    z = _inputs(x)
    coef = np.zeros(z.shape[1])
    if not len(y) or y.min() == y.max():  # one class only: its smoothed rate
        coef[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        return coef
    pen = np.full(len(coef), ridge)
    pen[0] = 1e-6
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ coef, -40, 40)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag(pen)
        step = np.linalg.solve(hess, z.T @ (y - p) - pen * coef)
        coef += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return coef


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """y and text of up to ``bound`` labelled documents that are not held out, chosen by a hash of the id.

    A doc_id labelled more than once counts with its highest label; null ids
    and labels other than 0 and 1 do not count."""
    chosen = (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).filter(~held_out())
              .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound))
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").select("y", "text")
    return written(rows, "training")


def _weight(t: Column, c: Column, ratio: Column) -> Column:
    """Log-odds of an entry, less CAUTION standard errors."""
    return (F.log((t + 0.5) / (c + 0.5) * ratio) - F.lit(CAUTION) * F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5)))


def _texts_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, y, n: texts of a batch that hold the key."""
    for batch in batches:
        y = batch.column("y").to_numpy(zero_copy_only=False)
        for i, j, data, offsets in pieces(batch.column("text")):
            w, starts, ends, first = word_bounds(data, offsets)
            text = np.repeat(np.arange(j - i), np.diff(first))
            for keys in _keys(w, starts, ends, word_hashes(w, starts, ends)):
                on = keys != 0
                k, t = keys[on], text[on]
                order = np.lexsort((t, k))
                k, t = k[order], t[order]
                once = np.concatenate(([True], (k[1:] != k[:-1]) | (t[1:] != t[:-1]))) if len(k) else np.zeros(0, bool)
                k, t = k[once], t[once]
                both, n = np.unique(np.stack((k, y[i:j][t].astype(np.uint64))), axis=1, return_counts=True) if len(k) else (np.zeros((2, 0), np.uint64), np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(both[0].view(np.int64)), pa.array(both[1].astype(np.int32)), pa.array(n)], ["key", "y", "n"])


def _contexts_of(candidates) -> callable:
    """key, y, ctx: occurrences of candidate keys, told apart by the words beside them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(candidates.value, candidates.value)
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False)
            for i, j, data, offsets in pieces(batch.column("text")):
                w, starts, ends, first = word_bounds(data, offsets)
                h = word_hashes(w, starts, ends)
                pad = np.concatenate((np.zeros(1, np.uint64), h, np.zeros(1, np.uint64)))
                ctx = _mix(pad[:-2] + _mix(pad[2:]))
                label = np.repeat(y[i:j], np.diff(first))
                for keys in _keys(w, starts, ends, h):
                    at, k = table.get(keys)
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(label[at].astype(np.int32)), pa.array(ctx[at].view(np.int64))], ["key", "y", "ctx"])
    return run


def learn_lexicon(train: DataFrame) -> Table:
    """Words and stems with their insult weights.

    Candidates are picked by the texts that hold them; their weights are then
    taken from distinct contexts, so that copies of a text count once."""
    n = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    ratio = F.lit((n.get(0, 0) + 1.0) / (n.get(1, 0) + 1.0))
    tally = lambda rows, what: rows.groupBy("key").agg(
        F.sum(F.when(F.col("y") == 1, what).otherwise(0)).alias("t"), F.sum(F.when(F.col("y") == 0, what).otherwise(0)).alias("c"))
    found = tally(train.mapInArrow(_texts_with, "key long, y int, n long"), F.col("n"))
    best = found.withColumn("w", _weight(F.col("t"), F.col("c"), ratio)).filter((F.col("t") >= LEAST) & (F.col("w") > 0))
    first = [r["key"] for r in best.orderBy(F.desc("w"), "key").limit(ENTRIES).select("key").collect()]
    sc = train.sparkSession.sparkContext
    sent = sc.broadcast(np.array(first, np.int64).view(np.uint64))
    ctx = train.mapInArrow(_contexts_of(sent), "key long, y int, ctx long").distinct()
    rows = (tally(ctx, F.lit(1)).withColumn("w", _weight(F.col("t"), F.col("c"), ratio))
            .filter((F.col("t") >= LEAST) & (F.col("w") > 0)).select("key", "w").collect())
    return Table(np.array([r["key"] for r in rows], np.int64).view(np.uint64), np.array([r["w"] for r in rows], float))


def _features(sent) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = document_features(batch.column("text"), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])
    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = TRAIN_ROWS) -> tuple[Table, np.ndarray]:
    """The lexicon and the scorer's coefficients, from at most ``bound`` labelled rows."""
    train = training_rows(docs, labels, label, bound)
    lexicon = learn_lexicon(train)
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)
    rows = train.mapInArrow(_features(sent), "y int, x array<double>").collect()
    x = np.array([r["x"] for r in rows], float).reshape(-1, N_FEATURES)
    return lexicon, fit_logistic(x, np.array([r["y"] for r in rows], float))


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, from its whole text alone.

    A null or empty text has no clauses and scores as the intercept says.
    Repeated rows score alike; a null doc_id is scored too (its remainder is
    that of the empty text, 0).  Without usable labels the score is 0.5 for
    all; an empty table gives no rows; further columns are ignored."""
    lexicon, coef = fit(docs, labels, label, bound)
    sent = docs.sparkSession.sparkContext.broadcast((lexicon, coef))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, c = sent.value
        for batch in batches:
            s = score(document_features(batch.column("text"), table), c)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s)], ["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", held_out().alias("held_out"), text_of().alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
