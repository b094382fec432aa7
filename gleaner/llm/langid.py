"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point. An n-gram is bound by multiplying the
vectors of its letters, each rotated by its place in the n-gram; a text is the sum of its n-gram vectors. A language
prototype is the sum of the directions of its training texts. The language of a text is the prototype with the largest
cosine.

Bundling is linear, so a block of texts is bundled as (counts of n-grams) x (n-gram vectors), one matrix product. Only
prototypes travel: a partition sums its own texts, and the partial sums, one row per language and partition, meet in a
grouped sum.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, small_batches, text_key, without

DIMENSIONS = 1024
N = 3
#: Most training documents that the prototypes are fitted on, about: a hash of doc_id picks that share.
FIT_DOCUMENTS = 50_000
#: Cosines of a text that has nothing of a language vary by 1 / sqrt(dimensions) around 0, whatever its length. The pipeline's stage rejects a text whose
#: best cosine is not more than so many times that.
SIGNIFICANT = 3.5
LEAST_SCORE = SIGNIFICANT / DIMENSIONS**0.5
#: Cosines of clean texts grow with the square root of their number of different n-grams until there are some FULL of them. Texts with fewer are
#: judged with WIDE dimensions, where the noise is small enough to tell even a word's n-grams from it.
FULL = 128
WIDE = 8192
#: Most training documents of each language for the wide prototypes, about.
FIT_WIDE = 1_000


@lru_cache(1 << 13)
def letter(code: int, dimensions: int) -> np.ndarray:
    """The vector of a letter, as bytes of signs; the word border is code 0."""
    with np.errstate(over="ignore"):
        bits = mix64(np.arange(dimensions // 64, dtype=np.uint64) + mix64(np.array([code + 1], np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
    return np.unpackbits(bits.astype("<u8").view(np.uint8)).astype(np.int8) * np.int8(2) - np.int8(1)


def bound(code: int, dimensions: int) -> np.ndarray:
    """The bound vector of N letters packed in 21 bits each, as bytes of signs."""
    out = np.ones(dimensions, np.int8)
    for place in range(N):
        out = out * np.roll(letter((code >> (21 * place)) & 0x1FFFFF, dimensions), place)
    return out


@lru_cache(1 << 15)
def gram(code: int) -> np.ndarray:
    return bound(code, DIMENSIONS)


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point to itself if it is a letter, else 0."""
    return np.fromiter((c if unicodedata.category(chr(c))[0] == "L" else 0 for c in range(0x110000)), np.uint32, 0x110000)


def grams(text: str) -> np.ndarray:
    """The n-grams of the letters of a text in lower case, each word between single borders; none without a letter."""
    codes = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not codes.any():
        return np.zeros(0, np.int64)
    codes = np.r_[np.uint32(0), codes, np.uint32(0)]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    codes = codes[keep].astype(np.int64)
    if len(codes) < N:
        codes = np.r_[codes, np.zeros(N - len(codes), np.int64)]
    return sum(codes[i : len(codes) - N + 1 + i] << (21 * i) for i in range(N))


def bundles(texts: list[str], dimensions: int = DIMENSIONS, most: int = 1 << 17, different: np.ndarray | None = None) -> np.ndarray:
    """A row per text: the sum of its n-gram vectors, zero without a letter. Works on runs of texts with about `most` n-grams.

    The number of different n-grams of each text is written to `different`, if given.
    """
    out = np.zeros((len(texts), dimensions), np.float32)
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    total = 0

    def flush() -> None:
        nonlocal held, total
        if held:
            codes, where = np.unique(np.concatenate([c for _, c, _ in held]), return_inverse=True)
            rows = np.repeat(np.arange(len(held)), [len(c) for _, c, _ in held])
            counts = np.concatenate([n for _, _, n in held]).astype(np.float32)
            for at in range(0, len(codes), 4096):  # bounds the matrices when a script has many letters
                part = (where >= at) & (where < at + 4096)
                table = np.zeros((len(held), min(4096, len(codes) - at)), np.float32)
                table[rows[part], where[part] - at] = counts[part]
                for k in range(0, table.shape[1], 512):
                    vectors = np.stack([gram(c) if dimensions == DIMENSIONS else bound(c, dimensions) for c in codes[at + k : at + k + 512].tolist()]).astype(np.float32)
                    out[[i for i, _, _ in held]] += table[:, k : k + 512] @ vectors
        held, total = [], 0

    for i, text in enumerate(texts):
        found = grams(text)
        if len(found):
            codes, counts = np.unique(found, return_counts=True)
            held.append((i, codes, counts))
            if different is not None:
                different[i] = len(codes)
            total += len(codes)
            if total >= most or len(held) >= 256:
                flush()
    flush()
    return out


def directions(vectors: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 0)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", most: int = FIT_DOCUMENTS) -> dict[str, np.ndarray]:
    """Language to prototype, from the rows of docs with a language and a text.

    Above `most` such rows, a share of most / rows of them, picked by a hash of the id, is used. The result has one
    vector of DIMENSIONS doubles per language. Rows without a letter teach nothing.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = known.count()
    if n > most:
        known = known.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit(10)), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    return _prototypes(known, text_col, lang_col, DIMENSIONS)


def fit_wide(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", most: int = FIT_WIDE) -> dict[str, np.ndarray]:
    """Prototypes with WIDE dimensions, from about `most` rows of each language, picked by a hash of the id."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count("*").alias("n")).collect()}  # a row a language
    share = F.lit(1 << 30)
    for lang, n in counts.items():
        share = F.when(F.col(lang_col).cast("string") == lang, int(min(1.0, most / n) * (1 << 30))).otherwise(share)
    return _prototypes(known.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1 << 30)) < share), text_col, lang_col, WIDE)


def _prototypes(known: DataFrame, text_col: str, lang_col: str, dimensions: int) -> dict[str, np.ndarray]:
    def each(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(1).to_pylist(), np.array(batch.column(0).to_pylist(), dtype=object)
            for at in range(0, len(texts), 128):
                vectors, own = directions(bundles(texts[at : at + 128], dimensions)), langs[at : at + 128]
                for lang in set(own):
                    sums[lang] = sums.get(lang, 0) + vectors[own == lang].sum(0, dtype=np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "v"])

    partial = small_batches(known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))).mapInArrow(each, "lang string, v array<double>")
    summed = partial.select("lang", F.posexplode("v").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    rows = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v")).select("lang", "v.x").orderBy("lang").collect()
    found = {r["lang"]: np.array(r["x"], np.float64) for r in rows}
    return {k: v / np.linalg.norm(v) for k, v in found.items() if np.linalg.norm(v) > 0}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row of docs; the other columns are ignored.

    score is the cosine with the best prototype, 0 at least and 1 at most, to 6 places, so that it does not hang on what else is in a batch. Null texts and texts without a letter are
    `und` with score 0, as is everything if there are no prototypes. On a tie the language that sorts first wins. Rows that repeat an id
    or a text each have a row with the same result; no rows give no rows.
    """
    return _scored(docs, prototypes, None, id_col, text_col).drop("key", "above")


def _scored(docs: DataFrame, prototypes: dict[str, np.ndarray], wide: dict[str, np.ndarray] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """predict(), and key (see text_key) and above: the best cosine as a multiple of its noise, of texts with fewer than FULL different n-grams
    by the wide prototypes if there are any."""
    broad = np.stack([wide[k] for k in sorted(wide)]).astype(np.float32) if wide else None
    names = sorted(prototypes)
    matrix = np.stack([prototypes[k] for k in names]).astype(np.float32) if names else np.zeros((0, DIMENSIONS), np.float32)

    def each(batches):
        for batch in batches:
            different = np.zeros(len(batch), np.int64)
            vectors = directions(bundles([x or "" for x in batch.column(1).to_pylist()], different=different))
            if names:
                cosines = vectors @ matrix.T
                best = cosines.argmax(1)
                langs = np.array(names, dtype=object)[best]
                langs[~vectors.any(1)] = "und"
                scores = np.round(np.clip(cosines[np.arange(len(best)), best].astype(np.float64), 0, 1), 6)
            else:
                langs, scores = np.full(len(vectors), "und", dtype=object), np.zeros(len(vectors))
            above = scores * DIMENSIONS**0.5
            short = np.flatnonzero((different > 0) & (different < FULL)) if broad is not None else []
            for at in range(0, len(short), 128):
                some = short[at : at + 128]
                above[some] = (directions(bundles(batch.column(1).take(pa.array(some)).to_pylist(), WIDE)) @ broad.T).max(1) * WIDE**0.5
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores), batch.column(2), pa.array(above)], ["doc_id", "lang_pred", "score", "key", "above"])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), text_key(text_col))
    return small_batches(rows).mapInArrow(each, "doc_id long, lang_pred string, score double, key long, above double")


def fold(id_col: str, folds: int) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def keep_languages(docs: DataFrame, prototypes: dict[str, np.ndarray], wide: dict[str, np.ndarray] | None = None, significant: float = SIGNIFICANT) -> DataFrame:
    """The rows of docs whose language is found with a cosine of more than `significant` times its noise, with all their columns.

    The noise has one standard deviation for texts of all lengths, so one multiple holds for all; with wide prototypes (fit_wide) texts with fewer
    than FULL different n-grams, whose cosines are small even if clean, are judged where the noise is a third. Each row is decided by its own text, so rows that
    repeat an id with other texts stay or go on their own, and a row that is stored twice stays twice. No rows give no rows.
    The rejected ids, few, are what the texts are joined with.
    """
    out = _scored(docs, prototypes, wide).filter((F.col("lang_pred") == "und") | (F.col("above") <= significant))
    return without(docs, "doc_id", "text", out.select(F.col("doc_id").alias("id"), "key", F.lit(False).alias("once")).distinct(), "rejected")
