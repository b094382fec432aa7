"""Quality classifier: a generalised additive model with pairwise interactions.

Features are counts and shares of a text's bytes, words and lines, how often words, pairs of words and lines repeat, the
entropy and compressibility of the bytes, and the shares of words by buckets of their hashes. Boosting goes round the features in a cycle; each
step fits a shallow tree to the gradient on one feature's bins and adds it, shrunk, to that feature's lookup table.
Then the feature pairs with the most gain left get tables of their own in the same way. A score is the logistic of the
sum of the table entries of a text's bins.

Features are computed once for every document, in one pass over whole texts; labels are joined with them, not with
texts. The tables are fitted on at most about FIT_ROWS labelled rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, materialize, per_text, small_batches, span_hashes, text_blocks, word_starts

#: Most labelled rows that the model is fitted on, about: a hash of the id picks that share of more.
FIT_ROWS = 20_000
#: Words are dealt by a hash to so many buckets; the share of each is a feature, so common words of one kind of text count.
BUCKETS = 16

FEATURES = ("bytes", "words", "lines", "word_len", "longest_word", "line_len", "upper", "digit", "stop", "symbol", "exclaim", "pipe", "wide", "control", "capital_words", "marked_words", "same_words", "same_lines", "short_words", "same_pairs", "top_word", "entropy", "packed", *(f"words_{k}" for k in range(BUCKETS)))

_UPPER, _LOWER, _DIGIT, _STOP, _SYMBOL, _EXCLAIM, _PIPE, _WIDE, _CONTROL, _SPACE = range(10)
_CLASS = np.full(256, _SYMBOL, np.int64)
_CLASS[ord("A") : ord("Z") + 1] = _UPPER
_CLASS[ord("a") : ord("z") + 1] = _LOWER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[list(b".,;:'\"-?()")] = _STOP
_CLASS[ord("!")] = _EXCLAIM
_CLASS[ord("|")] = _PIPE
_CLASS[128:] = _WIDE
_CLASS[:32] = _CONTROL
_CLASS[127] = _CONTROL
_CLASS[IS_SPACE] = _SPACE


def _repeats(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n texts, how many of its items repeat an earlier one, and how often the most frequent one comes."""
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (h[1:] != h[:-1])]) if len(r) else np.zeros(0, np.int64)
    times, top = np.diff(np.r_[first, len(r)]), np.zeros(n, np.int64)
    np.maximum.at(top, r[first], times)
    return np.bincount(r[first], times - 1, n), top


def features(text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES per text; all zero for an empty one."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    rows = np.repeat(np.arange(n), size)
    kinds = np.bincount(rows * 10 + _CLASS[text], minlength=n * 10).reshape(n, 10).astype(np.float64)
    starts, ends = (np.flatnonzero(x) for x in word_starts(text, offsets))
    ends = ends + 1
    word_row = rows[starts]
    words = np.bincount(word_row, minlength=n)
    length = ends - starts
    hashes = span_hashes(text, starts, ends)
    marked = per_text(np.isin(_CLASS[text], (_SYMBOL, _EXCLAIM, _PIPE, _DIGIT)), np.r_[starts, len(text)])[: len(starts)] > 0 if len(starts) else np.zeros(0, bool)
    breaks = text == 10
    line_starts = np.flatnonzero(np.r_[True, breaks[:-1]]) if len(text) else np.zeros(0, np.int64)
    line_starts = np.union1d(line_starts, offsets[:-1][size > 0])
    line_ends = np.r_[line_starts[1:], len(text)] if len(line_starts) else line_starts
    line_row = rows[line_starts]
    lines = np.bincount(line_row, minlength=n)
    pair = word_row[1:] == word_row[:-1]
    pairs = (hashes[:-1] * np.uint64(3) + hashes[1:])[pair]
    longest = np.zeros(n)
    np.maximum.at(longest, word_row, length)
    share = lambda x, of: np.divide(x, of, out=np.zeros(n), where=of > 0)
    letters = kinds[:, _UPPER] + kinds[:, _LOWER]
    shown = size - kinds[:, _SPACE]
    bytes_ = np.bincount(rows * 256 + text, minlength=n * 256).reshape(n, 256) / np.maximum(size, 1)[:, None]
    entropy = -(bytes_ * np.log2(np.where(bytes_ > 0, bytes_, 1))).sum(1)
    raw, cut = text.tobytes(), offsets.tolist()
    packed = np.array([len(zlib.compress(raw[a:b], 1)) for a, b in zip(cut, cut[1:], strict=False)], np.float64)
    same_words, top_word = _repeats(word_row, hashes, n)
    buckets = np.bincount(word_row * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS)
    return np.column_stack([
        np.log1p(size), np.log1p(words), np.log1p(lines), share(shown, words), np.log1p(longest), np.log1p(share(size, lines)),
        share(kinds[:, _UPPER], letters), *(share(kinds[:, k], shown) for k in (_DIGIT, _STOP, _SYMBOL, _EXCLAIM, _PIPE, _WIDE, _CONTROL)),
        share(np.bincount(word_row, _CLASS[text[starts]] == _UPPER, n), words), share(np.bincount(word_row, marked, n), words),
        share(same_words, words), share(_repeats(line_row, span_hashes(text, line_starts, line_ends), n)[0], lines),
        share(np.bincount(word_row, length <= 2, n), words), share(_repeats(word_row[1:][pair], pairs, n)[0], words - 1.0),
        share(top_word, words), entropy, share(packed, size), *(share(buckets[:, k], words) for k in range(BUCKETS)),
    ])


def feature_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x, an array with the FEATURES of the whole text. Null text counts as empty."""

    def each(batches):
        for batch in batches:
            found = [features(text, offsets) for _, _, text, offsets in text_blocks(batch.column(1))]
            x = np.concatenate(found) if found else np.zeros((0, len(FEATURES)))
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "x"])

    return small_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))).mapInArrow(each, "doc_id long, x array<float>")


def _tree(gain_of, g: np.ndarray, h: np.ndarray, least: float) -> np.ndarray:
    """Leaf values per bin of a tree with up to four leaves over ordered bins with gradients g and hessians h."""

    def cut(a: int, b: int) -> tuple[float, int]:
        cg, ch = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
        if not len(cg):
            return 0.0, b
        rest_g, rest_h = g[a:b].sum() - cg, h[a:b].sum() - ch
        gains = np.where((ch >= least) & (rest_h >= least), gain_of(cg, ch) + gain_of(rest_g, rest_h) - gain_of(cg + rest_g, ch + rest_h), -1.0)
        at = int(gains.argmax())
        return (float(gains[at]), a + at + 1) if gains[at] > 1e-9 else (0.0, b)

    edges = {0, len(g)}
    for _ in range(2):
        for a, b in list(zip(sorted(edges), sorted(edges)[1:], strict=False)):
            edges.add(cut(a, b)[1])
    out = np.zeros(len(g))
    for a, b in zip(sorted(edges), sorted(edges)[1:], strict=False):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


@dataclass
class AdditiveModel:
    """intercept + tables[f][bin of f] + pair_tables[f, g][coarse bin of f, coarse bin of g]."""

    intercept: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[f], x[:, f], "right")]
        rough = {f: np.searchsorted(self.coarse[f], x[:, f], "right") for f in {k for p in self.pairs for k in p}}
        for (f, g), table in self.pairs.items():
            total += table[rough[f], rough[g]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 60, pair_rounds: int = 20, n_pairs: int = 8, rate: float = 0.1) -> AdditiveModel:
    """Cyclic boosting of shallow trees on logistic loss. With no rows, or one class only, the tables stay zero."""
    n, width = x.shape if len(x) else (0, len(FEATURES))
    share = (y.sum() + 0.5) / (n + 1.0)
    inner = np.linspace(0, 1, bins + 1)[1:-1]
    cuts = [np.unique(np.quantile(x[:, f], inner)) if n else np.zeros(0) for f in range(width)]
    coarse = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 9)[1:-1])) if n else np.zeros(0) for f in range(width)]
    model = AdditiveModel(float(np.log(share / (1 - share))), cuts, [np.zeros(len(c) + 1) for c in cuts], coarse, {})
    if n == 0 or y.min() == y.max():
        return model
    at = [np.searchsorted(cuts[f], x[:, f], "right") for f in range(width)]
    rough = [np.searchsorted(coarse[f], x[:, f], "right") for f in range(width)]
    total = np.full(n, model.intercept)
    gain_of = lambda g, h: g * g / (h + 1.0)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(width):
            g, h = slopes()
            size = len(model.tables[f])
            step = rate * _tree(gain_of, np.bincount(at[f], g, size), np.bincount(at[f], h, size), 1.0)
            model.tables[f] += step
            total += step[at[f]]

    def grid(f: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        shape = (len(coarse[f]) + 1, len(coarse[k]) + 1)
        flat = rough[f] * shape[1] + rough[k]
        return tuple(np.bincount(flat, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))

    def gain(f: int, k: int) -> float:
        g, h = grid(f, k)
        return float(gain_of(g, h).sum() - gain_of(g.sum(1), h.sum(1)).sum() - gain_of(g.sum(0), h.sum(0)).sum())

    for f, k in sorted(combinations(range(width), 2), key=lambda p: -gain(*p))[:n_pairs]:
        model.pairs[f, k] = np.zeros((len(coarse[f]) + 1, len(coarse[k]) + 1))
    for _ in range(pair_rounds):
        for (f, k), table in model.pairs.items():
            g, h = grid(f, k)
            step = np.zeros_like(table)
            rows = _tree(gain_of, g.sum(1), h.sum(1), 1.0)
            for part in [np.flatnonzero(rows == v) for v in np.unique(rows)]:  # the rows of a leaf are split along the other feature
                step[part] = rate * _tree(gain_of, g[part].sum(0), h[part].sum(0), 1.0)
            table += step
            total += step[rough[f], rough[k]]
    return model


def fit_on(rows: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> AdditiveModel:
    """rows: of feature_rows. labels: doc_id and quality; null and repeated ones are left out."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = known.count()
    if n > most:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    sample = rows.join(known, "doc_id").orderBy("doc_id").toPandas()
    return fit(np.stack(sample["x"].to_numpy()) if len(sample) else np.zeros((0, len(FEATURES))), sample["quality"].to_numpy(np.float64))


def score(rows: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id, score, predicted for every row of feature_rows."""

    def each(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            found = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return rows.mapInArrow(each, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """Features of all docs, a model fitted on the labelled ones, and the score of every document.

    One row per row of docs: doc_id, score, predicted. Null and empty texts are scored like others, from zero features. Without labels
    every score is 0.5. Rows that repeat an id are scored each by its text, and each teaches the id's label, the greatest of several.
    No rows give no rows; other columns of both tables are ignored.
    """
    rows = materialize(feature_rows(docs), "features")
    return score(rows, fit_on(rows, labels, most))
