"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other texts, toxic or not, are just unlabelled. With the share of toxic texts in
the corpus, the class prior, the risk of a classifier g is

    prior * E_positive[loss(g, +1)] + max(0, E_unlabelled[loss(g, -1)] - prior * E_positive[loss(g, -1)]),

where the second term stands for the clean texts that nobody has labelled. It can't be negative for any real population, so where a
batch makes it negative the classifier has learned its positives by heart, and the step goes back up that term instead.
Linear classifiers with logistic loss are trained in numpy, with several seeds, and the mean of their probabilities is the score.

Texts are read as words of letters, in lower case. A word counts under itself and under its first 4 to 8 bytes, so that endings
and compounds share what their stem has taught. An entry is the share of a text's words that have the mark, in
percent; SMOOTH words are added to the text's length, so a single word in a short text weighs less. The classifiers use the
MARKS marks whose share of texts differs most between the positives and the unlabelled texts of the fitting sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, span_hashes, text_blocks

#: Most texts of either kind that the model is fitted on, about: a hash of the id picks that share of more.
FIT_TOXIC, FIT_UNLABELLED = 10_000, 20_000
SLOTS = 1 << 20
MARKS = 2048
STEMS = (4, 5, 6, 7, 8)
SMOOTH = 40.0

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True


def marks(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot) of every mark of every word of the texts, in lower case, and the words of each text."""
    inside = _LETTER[text]
    before = np.r_[False, inside[:-1]]
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    before[full] = False
    starts = np.flatnonzero(inside & ~before)
    borders = np.zeros(len(text) + 1, bool)
    borders[full] = True
    borders[:-1] |= ~inside
    borders[-1] = True
    stops = np.flatnonzero(borders)
    ends = stops[np.searchsorted(stops, starts, "right")] if len(starts) else starts
    rows = np.searchsorted(offsets, starts, "right") - 1
    found, where = [span_hashes(text, starts, ends)], [rows]
    for k in STEMS:
        longer = ends - starts > k
        found.append(span_hashes(text, starts[longer], starts[longer] + k) ^ np.uint64(0x9E3779B97F4A7C15))
        where.append(rows[longer])
    slots = (np.concatenate(found) >> np.uint64(44)).astype(np.int64) % SLOTS
    return np.concatenate(where), slots, np.bincount(rows, minlength=len(offsets) - 1)


def lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()))


def frequencies(texts: DataFrame) -> DataFrame:
    """texts: text, toxic (boolean). slot, and in how many texts of either kind it comes: toxic, rest. Partial counts leave each batch."""

    def each(batches):
        for batch in batches:
            kind = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, b, text, offsets in text_blocks(lower(batch.column(0)), 1 << 20):
                rows, slots, _ = marks(text, offsets)
                pairs = np.unique(rows * SLOTS + slots)
                slot, positive = pairs % SLOTS, kind[a:b][pairs // SLOTS]
                names, at = np.unique(slot, return_inverse=True)
                hits = np.bincount(at, positive, len(names)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(hits), pa.array(np.bincount(at, minlength=len(names)) - hits)], ["slot", "toxic", "rest"])

    return small_batches(texts).mapInArrow(each, "slot long, toxic long, rest long").groupBy("slot").agg(F.sum("toxic").alias("toxic"), F.sum("rest").alias("rest"))


def telling(counts: DataFrame, n_toxic: int, n_rest: int, most: int = MARKS) -> np.ndarray:
    """The slots whose share of texts differs most between the kinds, in standard errors; ties by slot."""
    p, q = F.col("toxic") / F.lit(max(1, n_toxic)), F.col("rest") / F.lit(max(1, n_rest))
    both = (F.col("toxic") + F.col("rest") + 1) / F.lit(n_toxic + n_rest + 2)
    error = F.sqrt(both * (1 - both) * F.lit(1 / max(1, n_toxic) + 1 / max(1, n_rest)))
    best = counts.select("slot", (F.abs(p - q) / error).alias("d")).orderBy(F.desc("d"), "slot").limit(most)
    return np.array(sorted(r["slot"] for r in best.collect()), np.int64)


def entries(texts: DataFrame, slots: np.ndarray) -> DataFrame:
    """texts: doc_id, text. doc_id and the marks it has, at (places in slots) and v (their shares of its words)."""
    wanted = slots.tolist()

    def each(batches):
        place = np.full(SLOTS, -1, np.int32)
        place[np.array(wanted, np.int64)] = np.arange(len(wanted))
        for batch in batches:
            ids = batch.column(0)
            for a, b, text, offsets in text_blocks(lower(batch.column(1)), 1 << 20):
                rows, found, words = marks(text, offsets)
                at = place[found]
                pairs, times = np.unique(rows[at >= 0] * len(wanted) + at[at >= 0], return_counts=True)
                row = pairs // max(1, len(wanted))
                cut = pa.array(np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32))
                share = 100.0 * times / (words[row] + SMOOTH)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.ListArray.from_arrays(cut, pa.array((pairs % max(1, len(wanted))).astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(share.astype(np.float32)))], ["doc_id", "at", "v"])

    return small_batches(texts).mapInArrow(each, "doc_id long, at array<int>, v array<float>")


@dataclass
class Sparse:
    """Rows of (places, values), one behind the other; cut has n + 1 offsets."""

    cut: np.ndarray
    at: np.ndarray
    v: np.ndarray

    @classmethod
    def of(cls, at: list, v: list) -> Sparse:
        sizes = [len(x) for x in at]
        flat = lambda parts, kind: np.concatenate([np.zeros(0, kind), *[np.asarray(p, kind) for p in parts]])
        return cls(np.r_[0, np.cumsum(sizes, dtype=np.int64)].astype(np.int64), flat(at, np.int64), flat(v, np.float64))

    def take(self, rows: np.ndarray) -> Sparse:
        size = self.cut[rows + 1] - self.cut[rows]
        cut = np.r_[0, np.cumsum(size)]
        which = np.repeat(self.cut[rows] - cut[:-1], size) + np.arange(cut[-1])
        return Sparse(cut, self.at[which], self.v[which])

    def dot(self, w: np.ndarray) -> np.ndarray:
        total = np.r_[0.0, np.cumsum(w[self.at] * self.v)]
        return total[self.cut[1:]] - total[self.cut[:-1]]

    def gradient(self, slopes: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.at, np.repeat(slopes, np.diff(self.cut)) * self.v, width)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(toxic: Sparse, rest: Sparse, prior: float, width: int, seed: int, epochs: int = 60, batches: int = 8, rate: float = 0.05, decay: float = 1e-3) -> np.ndarray:
    """Weights, the last one the intercept, of a linear classifier that minimises the non-negative risk with Adam."""
    rng = np.random.default_rng(seed)
    n, m = len(toxic.cut) - 1, len(rest.cut) - 1
    w = np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))
    first, second, step = np.zeros_like(w), np.zeros_like(w), 0
    for epoch in range(epochs):
        shares = [np.array_split(rng.permutation(k), min(batches, n, m)) for k in (n, m)]
        for rows_p, rows_u in zip(*shares, strict=True):
            p, u = toxic.take(rows_p), rest.take(rows_u)
            gp, gu = p.dot(w) + w[-1], u.dot(w) + w[-1]
            clean = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            # slopes of the loss as a clean text, softplus(g), and as a toxic one, softplus(-g)
            as_clean_u, as_clean_p, as_toxic_p = sigmoid(gu) / len(gu), -prior * sigmoid(gp) / len(gp), -prior * sigmoid(-gp) / len(gp)
            back = clean < 0
            on_p, on_u = (-as_clean_p, -as_clean_u) if back else (as_clean_p + as_toxic_p, as_clean_u)
            g = np.r_[p.gradient(on_p, width) + u.gradient(on_u, width), on_p.sum() + on_u.sum()]
            g[:-1] += decay * w[:-1]
            step += 1
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            w -= rate * (1 - epoch / epochs) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w


@dataclass
class Classifiers:
    slots: np.ndarray
    weights: np.ndarray  # classifiers x (marks + 1)
    prior: float

    def score(self, x: Sparse) -> np.ndarray:
        return np.mean([sigmoid(x.dot(w) + w[-1]) for w in self.weights], axis=0) if len(self.weights) else np.full(len(x.cut) - 1, self.prior)


def sampled(rows: DataFrame, most: int, seed: int, id_col: str = "doc_id") -> DataFrame:
    n = rows.count()
    return rows if n <= most else rows.filter(F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None, seeds: tuple[int, ...] = (1, 2, 3), most_toxic: int = FIT_TOXIC, most_rest: int = FIT_UNLABELLED, most_marks: int = MARKS) -> Classifiers:
    """docs: doc_id and text, which the unlabelled texts are drawn from. labels: doc_id and toxic, of which only the rows with 1
    teach a class; all rows that are not null give the prior, unless it is stated. Without a toxic text scores are the prior."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg("toxic").alias("p")).first()["p"]
    prior = float(np.clip(prior if prior is not None else share if share is not None else 0.5, 1e-3, 1 - 1e-3))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # about most_toxic ids at most, so they are sent to all tasks and texts stay where they are
    positive = texts.join(F.broadcast(sampled(known.filter("toxic = 1").select("doc_id"), most_toxic, 12)), "doc_id", "left_semi").withColumn("toxic", F.lit(True))
    rest = sampled(texts, most_rest, 13).withColumn("toxic", F.lit(False))
    chosen = materialize(positive.unionByName(rest), "fitted")
    n = {r["toxic"]: r["n"] for r in chosen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(True) or not n.get(False):
        return Classifiers(np.zeros(0, np.int64), np.zeros((0, 1)), prior)
    slots = telling(frequencies(chosen.select("text", "toxic")), n[True], n[False], most_marks)
    sides = []
    for kind in ("toxic", "NOT toxic"):
        own = entries(chosen.filter(kind).select("doc_id", "text"), slots).orderBy("doc_id", "at", "v").toPandas()
        sides.append(Sparse.of(list(own["at"]), list(own["v"])))
    return Classifiers(slots, np.stack([train(*sides, prior, len(slots), seed) for seed in seeds]), prior)


def score(docs: DataFrame, model: Classifiers) -> DataFrame:
    """doc_id, score, predicted for every row of docs."""
    rows = entries(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), model.slots)

    def each(batches):
        for batch in batches:
            at, v = batch.column(1), batch.column(2)
            x = Sparse(at.offsets.to_numpy().astype(np.int64) - at.offsets[0].as_py(), at.flatten().to_numpy().astype(np.int64), v.flatten().to_numpy().astype(np.float64))
            found = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return rows.mapInArrow(each, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, unlabelled: DataFrame | None = None, **options) -> DataFrame:
    """One row per row of docs: doc_id, score (0 to 1, higher is likelier toxic), predicted (1 from 0.5 on).

    labels has doc_id and toxic; unlabelled is where unlabelled texts come from, docs if not given. Null and empty texts have no marks
    and get the score of such a text, far below 0.5 where toxic texts are rare. Rows that repeat an id are scored each by its text, and an id with several
    labels is toxic if one of them says so. Without a confirmed toxic text every score is the prior. No rows give
    no rows; other columns of the tables are ignored.
    """
    return score(docs, fit(docs if unlabelled is None else unlabelled, labels, **options))
