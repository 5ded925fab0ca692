"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or abstain on every document.  An
expectation-maximisation over the counts of vote patterns estimates the
accuracy of each labeller, and with that the posterior of every pattern.  The posteriors are the soft labels of a linear scorer over
hashed shapes of words and word pairs, which judges every document, also
those on which the labellers abstain.
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
from fuzzyspark.llm.words import _mix, flat, word_bounds, word_hashes

#: documents the scorer is trained on at most (the vote counts cover all), and hashed dimensions
TRAIN_DOCS, DIM = 8000, 1024
#: bytes of texts worked on at once: the arrays of a piece are some fifty times as large
PIECE_BYTES = 1 << 19
GOOD, BAD, ABSTAIN = 0, 1, 2
#: a labeller's vote, the share from which it casts it, and the least words; it abstains otherwise
LABELLERS = {
    "capitals": (BAD, 0.5, 3),        # capitals among letters
    "symbols": (BAD, 0.08, 3),        # characters neither letters, digits, spaces nor common marks
    "stutter": (BAD, 0.3, 5),         # words equal to the word before
    "loose": (BAD, 0.2, 5),           # words without letter or digit
    "endings": (BAD, 0.4, 5),         # words that end in a symbol or an exclamation
    "few": (BAD, 0.8, 30),            # words that are one of the text's eight most frequent
    "plain": (GOOD, 0.9, 3),          # words that start and end in a letter, digit or common mark
    "function": (GOOD, 0.15, 12),     # words of up to three characters, as prose has them
}
#: accuracy of a labeller before any vote is counted, the votes that this weighs as (a share of all documents,
#: so that a labeller is judged by its counts where it votes often), and the bounds of the estimates: marks of
#: bad text are specific, marks of prose are also met in bad text
ACCURACY, PRIOR, BOUNDS = {BAD: 0.95, GOOD: 0.6}, 0.05, (0.5, 0.999)
#: share of bad documents taken for granted before any vote; it is not estimated, as documents without
#: votes say nothing on it
BALANCE = 0.15
#: byte classes: space, lower case (all beyond ASCII too), capital, digit, common mark, and each symbol its own
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[39, 34, 44, 45, 46, 58, 59, 63, 40, 41]] = 4
_CLASS[0:9] = 5
_VISIBLE = np.where(_CLASS == 0, 0, np.maximum(np.arange(256), 1)).astype(np.uint8)


class Shapes:
    """The words of some whole texts: bounds, hashes and shapes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.cls = _CLASS[data]
        w, self.starts, self.ends, self.first = word_bounds(data, offsets, _VISIBLE)
        self.n = np.diff(self.first)
        self.text = np.repeat(np.arange(len(self.n)), self.n)
        self.hash = word_hashes(w, self.starts, self.ends)
        self.line = np.cumsum(data == 10, dtype=np.int32)[self.starts]
        self.again = np.zeros(len(self.starts), bool)
        if len(self.starts):
            self.again[1:] = (self.hash[1:] == self.hash[:-1]) & (self.text[1:] == self.text[:-1])

    def per_text(self, words: np.ndarray) -> np.ndarray:
        return np.bincount(self.text, words, len(self.n)) / np.maximum(self.n, 1)

    def bytes_of(self, on: np.ndarray) -> np.ndarray:
        """How many bytes of each text hold a mark."""
        total = np.concatenate(([0], np.cumsum(on)))
        return np.bincount(self.text, total[self.ends] - total[self.starts], len(self.n))

    def top_share(self) -> np.ndarray:
        """Share of the eight most frequent words of each text."""
        if not len(self.starts):
            return np.zeros(len(self.n))
        key = np.lexsort((self.hash, self.text))
        new = np.concatenate(([True], (self.hash[key][1:] != self.hash[key][:-1]) | (self.text[key][1:] != self.text[key][:-1])))
        at = np.flatnonzero(new)
        size, owner = np.diff(np.concatenate((at, [len(key)]))), self.text[key][at]
        rank = np.lexsort((-size, owner))
        size, owner = size[rank], owner[rank]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner, "left")
        return np.bincount(owner[place < 8], size[place < 8], len(self.n)) / np.maximum(self.n, 1)

    def repeated_lines(self) -> np.ndarray:
        """Share of the words of each text that stand in a line met before in it."""
        if not len(self.starts):
            return np.zeros(len(self.n))
        first = np.concatenate(([True], (self.line[1:] != self.line[:-1]) | (self.text[1:] != self.text[:-1])))
        at = np.flatnonzero(first)
        size = np.diff(np.concatenate((at, [len(first)])))
        nth = (np.arange(len(first)) - np.repeat(at, size)).astype(np.uint64)
        line, owner = np.add.reduceat(_mix(self.hash.astype(np.uint64) + _mix(nth + np.uint64(1))), at), self.text[at]
        key = np.lexsort((line, owner))
        again = np.zeros(len(key), bool)
        again[key[1:]] = (line[key][1:] == line[key][:-1]) & (owner[key][1:] == owner[key][:-1])
        return np.bincount(owner[again], size[again], len(self.n)) / np.maximum(self.n, 1)

    def votes(self) -> np.ndarray:
        """A row per text, a column per labeller."""
        out = np.full((len(self.n), len(LABELLERS)), ABSTAIN, np.int64)
        if not len(self.starts):
            return out
        cls = self.cls
        letters = self.bytes_of((cls == 1) | (cls == 2))
        own = np.concatenate(([0], np.cumsum((cls >= 1) & (cls <= 3))))
        last = cls[self.ends - 1]
        head = cls[self.starts]
        share = {
            "capitals": self.bytes_of(cls == 2) / np.maximum(letters, 1),
            "symbols": self.bytes_of(cls > 4) / np.maximum(self.bytes_of(cls > 0), 1),
            "stutter": self.per_text(self.again),
            "loose": self.per_text(own[self.ends] == own[self.starts]),
            "endings": self.per_text(last > 4),
            "few": self.top_share(),
            "plain": self.per_text((head <= 4) & (last <= 4)),
            "function": self.per_text(self.ends - self.starts <= 3),
        }
        for j, (name, (vote, bound, least)) in enumerate(LABELLERS.items()):
            out[(self.n >= least) & (share[name] >= bound), j] = vote
        return out

    def features(self) -> np.ndarray:
        """Five hashed features of each word: its shape, its shape after the last one, a repeat, and of its
        whole text the shares of the most frequent words (where ``few`` votes) and of repeated lines, in steps."""
        if not len(self.starts):
            return np.zeros((0, 5), np.int64)
        cls = self.cls
        turn = np.concatenate(([True], cls[1:] != cls[:-1]))
        turn[self.starts] = True
        at = np.flatnonzero(turn & (cls > 0))
        first = np.searchsorted(at, self.starts)
        nth = np.arange(len(at)) - np.repeat(first, np.diff(np.concatenate((first, [len(at)]))))
        parts = _mix(cls[at].astype(np.uint64) * np.uint64(64) + np.minimum(nth, 6).astype(np.uint64) + np.uint64(1))
        shape = np.add.reduceat(parts, first)
        before = np.concatenate((np.zeros(1, np.uint64), shape[:-1]))
        before[self.first[:-1][self.n > 0]] = 0
        dim = np.uint64(DIM)
        again = np.where(self.again, _mix(np.uint64(11)[None]), _mix(np.uint64(12)[None]))
        few = np.where(self.n >= LABELLERS["few"][2], np.minimum(self.top_share() * 10, 9).astype(np.uint64), np.uint64(10))
        lines = np.minimum(np.ceil(self.repeated_lines() * 5), 5).astype(np.uint64)
        few, lines = (_mix(x + np.uint64(at))[self.text] for x, at in ((few, 100), (lines, 200)))
        return np.stack([(_mix(shape) % dim), (_mix(shape + _mix(before)) % dim), again % dim, few % dim, lines % dim], axis=1).astype(np.int64)


def _pieces(texts: pa.Array) -> Iterator[Shapes]:
    data, offsets = flat(texts)
    cuts = np.searchsorted(offsets, np.arange(0, int(offsets[-1]) + PIECE_BYTES, PIECE_BYTES), "left")
    cuts = np.unique(np.concatenate((cuts[cuts <= len(texts)], [0, len(texts)])))
    for i, j in zip(cuts[:-1], cuts[1:]):
        yield Shapes(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])


def _pattern(votes: np.ndarray) -> np.ndarray:
    return votes @ (3 ** np.arange(votes.shape[1]))


def vote_counts(docs: DataFrame) -> dict[int, int]:
    """How many documents, of all, have each pattern of votes: at most 3 ** labellers patterns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in _pieces(batch.column("text")):
                p, n = np.unique(_pattern(s.votes()), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(n)], ["pattern", "n"])

    rows = docs.select(text_of().alias("text")).mapInArrow(run, "pattern long, n long")
    return {r["pattern"]: r["n"] for r in rows.groupBy("pattern").agg(F.sum("n").alias("n")).collect()}


def _together(voted: np.ndarray, groups: list[np.ndarray]) -> np.ndarray:
    """How far two labellers vote together beyond what the groups (weights of the patterns) explain, 0 to 1."""
    cov = np.zeros((voted.shape[1], voted.shape[1]))
    for n in groups:
        if n.sum() > 0:
            off = voted - n @ voted / n.sum()
            cov += off.T @ (off * n[:, None])
    spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    out = np.clip(cov / np.outer(spread, spread), 0, 1)
    np.fill_diagonal(out, 1)
    return out


def expectation_maximisation(counts: dict[int, int], rounds: int = 200, tol: float = 1e-9):
    """(accuracy of each labeller, posterior of bad by pattern).

    An accuracy is the rate of votes among documents of the kind voted for, as
    a share of that rate and the rate among the others, so it does not depend
    on how many are bad; to abstain says nothing.  Labellers of one kind that
    vote together gain the root of their number only.  A labeller that finds more than
    ``BALANCE`` of all documents bad misfires on the rest at least, and starts
    with the accuracy that this leaves it.  ``PRIOR``
    and ``BOUNDS`` keep the estimates off 0 and 1, also where nothing is
    counted."""
    k = len(LABELLERS)
    casts = np.array([vote for vote, _, _ in LABELLERS.values()])
    first = np.array([ACCURACY[v] for v in casts])
    patterns = np.array(sorted(counts), np.int64)
    n = np.array([counts[p] for p in patterns.tolist()], float)
    voted = ((patterns[:, None] // 3 ** np.arange(k)) % 3 != ABSTAIN).astype(float)
    sign, bad = np.where(casts == BAD, 1.0, -1.0), casts == BAD
    alike = casts[:, None] == casts[None]
    total, post, share = n @ voted, np.zeros(len(n)), voted
    misfires = np.maximum(total / max(n.sum(), 1.0) - BALANCE, 0) / (1 - BALANCE)
    accuracy = np.where(bad, np.minimum(first, 1 / (1 + misfires)), first)
    prior = 1 + PRIOR * n.sum()
    for _ in range(rounds):
        odds = np.log(BALANCE / (1 - BALANCE)) + share @ (sign * np.log(accuracy / (1 - accuracy)))
        new = 1.0 / (1.0 + np.exp(-np.clip(odds, -500, 500)))
        moved = np.abs(new - post).max(initial=0.0)
        post, groups = new, [n * new, n * (1 - new)]
        share = voted / np.sqrt(np.maximum(voted @ (_together(voted, groups) * alike), 1.0))
        rate = np.array([(g @ voted + 1e-9) / (g.sum() + 2e-9) for g in groups])
        right = np.where(bad, rate[0], rate[1]) / (rate[0] + rate[1])
        accuracy = np.clip((right * total + first * prior) / (total + prior), *BOUNDS)
        if moved < tol:
            break
    return accuracy, dict(zip(patterns.tolist(), post.tolist()))


def _sample(docs: DataFrame, total: int, bound: int) -> list:
    """(pattern, features, shares) of up to ``bound`` documents, chosen by a hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in _pieces(batch.column("text")):
                f = s.features()
                cell = (s.text[:, None] * DIM + f).ravel()
                cells, n = np.unique(cell, return_counts=True)
                cut = np.searchsorted(cells, np.arange(1, len(s.n)) * DIM)
                share = n / np.maximum(s.n[cells // DIM], 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_pattern(s.votes())), pa.array(np.split(cells % DIM, cut), pa.list_(pa.int64())),
                     pa.array(np.split(share, cut), pa.list_(pa.float64()))], ["pattern", "f", "v"])

    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_of()), F.lit(1 << 30))
    rows = docs.filter(draw < int(min(1.0, bound / max(total, 1)) * (1 << 30))).select(text_of().alias("text"))
    return rows.mapInArrow(run, "pattern long, f array<long>, v array<double>").limit(bound).collect()


def fit_scorer(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 400) -> np.ndarray:
    """Logistic weights for soft labels by gradient steps with momentum and a step per feature; the last is the intercept."""
    z = np.hstack((x, np.ones((len(x), 1))))
    coef = np.zeros(z.shape[1])
    if not len(y):
        return coef
    coef[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    m, v = np.zeros_like(coef), np.zeros_like(coef)
    for t in range(1, rounds + 1):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ coef, -40, 40)))
        g = z.T @ (p - y) / len(y)
        g[:-1] += ridge * coef[:-1] / 10
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        coef -= 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return coef


class Model:
    """The labellers' accuracies, the posterior of each pattern, and the scorer's weights."""

    def __init__(self, accuracy: np.ndarray, posterior: dict[int, float], coef: np.ndarray):
        self.accuracy, self.posterior, self.coef = accuracy, posterior, coef


def fit(docs: DataFrame, bound: int = TRAIN_DOCS) -> Model:
    counts = vote_counts(docs)
    accuracy, posterior = expectation_maximisation(counts)
    rows = _sample(docs, sum(counts.values()), bound)
    x = np.zeros((len(rows), DIM))
    for i, r in enumerate(rows):
        x[i, r["f"]] = r["v"]
    return Model(accuracy, posterior, fit_scorer(x, np.array([posterior.get(r["pattern"], BALANCE) for r in rows])))


def judged(docs: DataFrame, bound: int = TRAIN_DOCS, threshold: float = 0.5) -> DataFrame:
    """row, a struct of every document's columns, and ``judged``: votes of the labellers (g, b or -), the
    posterior of good after the votes, the scorer's probability of good, and whether it is kept.

    A null or empty text gets no votes and the score of the intercept.
    Repeated rows are judged alike; an empty table gives no rows; columns may
    have any names."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, bound))
    kind = pa.struct([("votes", pa.string()), ("posterior", pa.float64()), ("score", pa.float64()), ("keep", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        names = np.array(["g", "b", "-"])
        for batch in batches:
            found = []
            for s in _pieces(pc.struct_field(batch.column("row"), "text")):
                votes = s.votes()
                weight = model.coef[s.features()].sum(axis=1)
                logit = s.per_text(weight) + model.coef[-1]
                good = 1.0 / (1.0 + np.exp(np.clip(logit, -40, 40)))
                for v, p, g in zip(names[votes], _pattern(votes).tolist(), good.tolist()):
                    found.append({"votes": "".join(v), "posterior": 1 - model.posterior.get(p, BALANCE), "score": g, "keep": g >= threshold})
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, kind)], ["row", "judged"])

    rows = packed(docs)  # a null text reads as empty
    out = T.StructType([rows.schema["row"], T.StructField("judged", T.StructType([
        T.StructField("votes", T.StringType()), T.StructField("posterior", T.DoubleType()),
        T.StructField("score", T.DoubleType()), T.StructField("keep", T.BooleanType())]))])
    return rows.mapInArrow(run, out)


def quality(docs: DataFrame, bound: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, votes, posterior, score and keep of every document; see ``judged``."""
    return judged(docs.select("doc_id", "text"), bound).select("row.doc_id", "judged.*")


def good_documents(docs: DataFrame, bound: int = TRAIN_DOCS) -> DataFrame:
    """The documents that the scorer keeps, with the columns they had; see ``judged`` for nulls, empty
    texts, repeated rows, empty tables and names of columns."""
    return unpacked(judged(docs, bound).filter("judged.keep"))
