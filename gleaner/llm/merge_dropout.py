"""SentencePiece BPE encoding with seeded merge-dropout, and its decoding.

Adjacent symbols whose concatenation is a piece are candidate merges. An agenda takes the candidate with the best score,
the leftmost of equals. Each candidate is skipped, for good, if the keyed hash of its place in the segment falls below
the dropout rate; so rate 0 gives the plain segmentation, and higher rates other segmentations made of merges. A piece
never has a space mark after other characters nor a line feed, so a text is cut there into segments that are encoded on
their own. The key of a segment is its content and a number of VARIANTS, drawn for each place of each document (and copy
of it) from the seed: every occurrence has a segmentation of its own, and reruns agree.

Workers remember the plain segmentation of segments with the candidates it met. An occurrence that skips none of these has
just that; all others are encoded anew, in batches, one merge in each per step; long segments go through a heap.
Decoding joins pieces and bytes and is lossless for every text: characters without a piece, and literal space marks, are
written as their UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, small_batches, unit

RATE = 0.1
SEED = 6
#: So many that each place of each document has a key of its own.
VARIANTS = 1 << 62
#: Characters up to which segments are encoded in batches.
SHORT = 48
#: Segments whose plain ids a worker remembers.
REMEMBERED = 300_000
MARK = "▁"

_SEGMENT = re.compile(r" *[^ \n]+|\n| +")
_OTHER = 1 << 21  # symbols from here on are characters without a piece


_SLOTS = 1 << 20


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


def _placed(keys: np.ndarray, merges: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The merges in a hash table of _SLOTS places, the next free place on a collision."""
    if len(keys) > _SLOTS // 2:
        raise ValueError("the vocabulary has too many merges")
    table, merged = np.full(_SLOTS, -1, np.int64), np.full(_SLOTS, -1, np.int32)
    for key, at in zip(keys.tolist(), _slot(keys).tolist(), strict=True):
        while table[at] >= 0:
            at = (at + 1) & (_SLOTS - 1)
        table[at], merged[at] = key, merges[key]
    return table, merged


class Vocabulary:
    """Pieces of a SentencePiece BPE model with byte fallback, and the table of its merges."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if any(MARK in self.pieces[i].lstrip(MARK) or "\n" in self.pieces[i] for i in plain):
            raise ValueError("pieces reach over a space or a line feed")
        self.bytes = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        known = {self.pieces[i]: i for i in plain}
        self.char = np.arange(0x110000, dtype=np.int64) + _OTHER
        for piece, i in known.items():
            if len(piece) == 1:
                self.char[ord(piece)] = i
        self.char[ord(" ")], self.char[ord(MARK)] = known[MARK], _OTHER + ord(MARK)

        def symbol(text: str) -> int | None:
            if text == MARK:
                return known[MARK]
            return int(self.char[ord(text)]) if len(text) == 1 else known.get(text)

        merges = {}
        for piece, i in known.items():
            for cut in range(1, len(piece)):
                left, right = symbol(piece[:cut]), symbol(piece[cut:])
                if left is not None and right is not None:
                    merges[left << 22 | right] = i
        self.table, self.merged = _placed(np.array(sorted(merges), np.int64), merges)
        self.merges = merges
        self.score = np.array([model.get_score(i) for i in range(n)])
        self.raw = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece of each pair, or -1."""
        wanted = left << 22 | right
        at = _slot(wanted)
        out = np.where(self.table[at] == wanted, self.merged[at], -1)
        ask = np.flatnonzero((out < 0) & (self.table[at] >= 0))
        at = at[ask]
        while len(ask):
            at = (at + 1) & (_SLOTS - 1)
            here = self.table[at]
            hit = here == wanted[ask]
            out[ask[hit]] = self.merged[at[hit]]
            on = ~hit & (here >= 0)
            ask, at = ask[on], at[on]
        return out

    def spell(self, symbols) -> list[int]:
        out: list[int] = []
        for s in symbols:
            if s < _OTHER:
                out.append(s)
            else:
                out.extend(self.bytes[list(chr(s - _OTHER).encode("utf-8", "surrogatepass"))].tolist())
        return out

    def decode(self, ids) -> bytes:
        text = b"".join(map(self.raw.__getitem__, ids))
        return text[1:] if text[:1] == b" " else text


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def codes_of(segments: list[str]) -> np.ndarray:
    return np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)


def contents(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each segment's characters with their places."""
    first = np.cumsum(sizes) - sizes
    place = (np.arange(len(codes)) - np.repeat(first, sizes)).astype(np.uint64)
    return np.add.reduceat(mix64(codes.astype(np.uint64) + ((place + np.uint64(1)) << np.uint64(32))), first)


def keyed(content: np.ndarray, variants: np.ndarray, seed: int) -> np.ndarray:
    return mix64(content ^ mix64(variants.astype(np.uint64) + np.uint64(seed << 8)))


def segment_keys(codes: np.ndarray, sizes: np.ndarray, variants: np.ndarray, seed: int) -> np.ndarray:
    """A key for each segment, from its characters with their places, its variant and the seed."""
    return keyed(contents(codes, sizes), variants, seed)


def spans(start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the merge of [start, middle) and [middle, end)."""
    return mix64(start.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + middle.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + end.astype(np.uint64) * np.uint64(0x165667B19E3779F9))


def skipped(key: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, rate: float) -> np.ndarray:
    """Whether the merge of [start, middle) and [middle, end) of the segment with the key is skipped."""
    return unit(mix64(key ^ spans(start, middle, end))) < rate


def encode_long(v: Vocabulary, segment: str, key: int, rate: float) -> list[int]:
    """One segment through a heap of candidates over a linked list of symbols."""
    symbols = v.char[codes_of([segment])].tolist()
    n = len(symbols)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    agenda: list[tuple] = []

    def push(starts: list[int]) -> None:
        pairs = [(i, end[i]) for i in starts if i >= 0 and end[i] < n]
        found = [(i, j, v.merges.get(symbols[i] << 22 | symbols[j])) for i, j in pairs]
        found = [x for x in found if x[2] is not None]
        if found:
            a, b = np.array([x[0] for x in found]), np.array([x[1] for x in found])
            drop = skipped(np.full(len(found), key, np.uint64), a, b, np.array([end[x[1]] for x in found]), rate)
            for (i, j, m), d in zip(found, drop.tolist(), strict=True):
                if not d:
                    heapq.heappush(agenda, (-v.score[m], i, j, end[j], m))

    push(list(range(n)))
    while agenda:
        _, i, j, e, m = heapq.heappop(agenda)
        if alive[i] and end[i] == j and j < n and alive[j] and end[j] == e:
            symbols[i], end[i], alive[j] = m, e, False
            if e < n:
                before[e] = i
            push([before[i], i])
    return v.spell(s for s, a in zip(symbols, alive, strict=True) if a)


def encode_short(v: Vocabulary, codes: np.ndarray, sizes: np.ndarray, keys: np.ndarray | None, rate: float, met: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Many segments at once: (all ids, ids of each segment). Every step merges the best candidate of each segment that has one.

    The segments and hashes of all candidates are appended to `met`, if given. Rate 0 needs no keys.
    """
    symbols = v.char[codes]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    end = start + 1
    done: list[tuple[np.ndarray, np.ndarray]] = []

    def candidates(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to, value = np.full(len(at), -1, np.int64), np.full(len(at), -np.inf)
        fit = np.flatnonzero(at + 1 < len(symbols))
        fit = fit[owner[at[fit]] == owner[at[fit] + 1]]
        i = at[fit]
        found = v.merge(symbols[i], symbols[i + 1])
        ok = found >= 0
        if met is not None:
            met.append((owner[i[ok]], spans(start[i[ok]], start[i[ok] + 1], end[i[ok] + 1])))
        if rate > 0:
            ok &= ~skipped(keys[owner[i]], start[i], start[i + 1], end[i + 1], rate)
        to[fit[ok]], value[fit[ok]] = found[ok], v.score[found[ok]]
        return to, value

    to, value = candidates(np.arange(len(symbols)))
    while len(symbols):
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        best = np.maximum.reduceat(value, first)
        count = np.diff(np.r_[first, len(symbols)])
        ended = np.isneginf(best)
        if ended.any():
            keep = ~np.repeat(ended, count)
            done.append((owner[~keep], symbols[~keep]))
            symbols, owner, start, end, to, value = (x[keep] for x in (symbols, owner, start, end, to, value))
            continue
        tops = np.flatnonzero(value == np.repeat(best, count))
        tops = tops[np.r_[True, owner[tops[1:]] != owner[tops[:-1]]]]
        symbols[tops], end[tops] = to[tops], end[tops + 1]
        keep = np.ones(len(symbols), bool)
        keep[tops + 1] = False
        symbols, owner, start, end, to, value = (x[keep] for x in (symbols, owner, start, end, to, value))
        moved = tops - np.arange(len(tops))
        again = np.r_[moved, moved[moved > 0] - 1]
        to[again], value[again] = candidates(again)
    owner, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(owner, kind="stable")
    owner, symbols = owner[order], symbols[order]
    odd = np.flatnonzero(symbols >= _OTHER)
    if len(odd):  # their UTF-8 bytes
        spelled = [v.spell([s]) for s in symbols[odd].tolist()]
        times = np.ones(len(symbols), np.int64)
        times[odd] = [len(x) for x in spelled]
        owner, symbols, at = np.repeat(owner, times), np.repeat(symbols, times), np.cumsum(times) - times
        for i, x in zip(at[odd].tolist(), spelled, strict=True):
            symbols[i : i + len(x)] = x
    return symbols, np.bincount(owner, minlength=len(sizes))


class Encoder:
    """Encodes documents. Segments are numbered as they come; the plain ids of each, and the hashes of the candidates that lead
    to them, are kept in one array each, until more than `remembered` segments are known."""

    def __init__(self, path: str, rate: float = RATE, seed: int = SEED, remembered: int = REMEMBERED):
        self.v, self.rate, self.seed, self.remembered = vocabulary(path), rate, seed, remembered
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.segments: list[str] = []
        self.size, self.content = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.first, self.many = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.store, self.used = np.zeros(1 << 16, np.uint32), 0
        self.met, self.held = np.zeros(1 << 16, np.uint64), 0

    @staticmethod
    def put(store: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
        """store with the values from `at` on, made larger if need be."""
        while at + len(values) > len(store):
            store = np.concatenate([store, np.zeros_like(store)])
        store[at : at + len(values)] = values
        return store

    def learn(self, new: list[str]) -> None:
        """Numbers segments that are not known yet. With dropout, long ones are not worth remembering."""
        base, n = len(self.segments), len(new)
        self.number.update(zip(new, range(base, base + n), strict=True))
        self.segments += new
        sizes = np.fromiter(map(len, new), np.int64, n)
        self.size, self.content = np.r_[self.size, sizes], np.r_[self.content, contents(codes_of(new), sizes)]
        self.start, self.count, self.first, self.many = (np.r_[x, np.zeros(n, np.int64)] for x in (self.start, self.count, self.first, self.many))
        short = np.flatnonzero(sizes <= SHORT)
        for a in range(0, len(short), 20_000):
            part = short[a : a + 20_000]
            met: list | None = [] if self.rate > 0 else None
            ids, counts = encode_short(self.v, codes_of([new[i] for i in part.tolist()]), sizes[part], None, 0.0, met)
            self.store = self.put(self.store, self.used, ids)
            self.start[base + part], self.count[base + part] = self.used + np.cumsum(counts) - counts, counts
            self.used += len(ids)
            if met:
                owner, hashes = (np.concatenate(x) for x in zip(*met, strict=True))
                many = np.bincount(owner, minlength=len(part))
                self.met = self.put(self.met, self.held, hashes[np.argsort(owner, kind="stable")])
                self.first[base + part], self.many[base + part] = self.held + np.cumsum(many) - many, many
                self.held += len(hashes)
        for i in np.flatnonzero(sizes > SHORT).tolist() if self.rate <= 0 else ():
            ids = np.array(encode_long(self.v, new[i], 0, 0.0), np.uint32)
            self.store = self.put(self.store, self.used, ids)
            self.start[base + i], self.count[base + i] = self.used, len(ids)
            self.used += len(ids)

    def known(self, segments: list[str]) -> np.ndarray:
        """The number of each segment."""
        if len(self.number) > self.remembered:
            self.forget()
        new = list(set(segments).difference(self.number))
        if new:
            self.learn(new)
        return np.fromiter(map(self.number.__getitem__, segments), np.int64, len(segments))

    def other(self, numbers: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Which occurrences may differ from the plain segmentation: those that skip a candidate of it, and long ones."""
        out = self.size[numbers] > SHORT
        for a in range(0, len(numbers), 1 << 16):
            at = numbers[a : a + (1 << 16)]
            many = self.many[at]
            ends = np.cumsum(many)
            hashes = self.met[np.repeat(self.first[at] - ends + many, many) + np.arange(ends[-1])]
            skips = np.r_[0, np.cumsum(unit(mix64(np.repeat(keys[a : a + (1 << 16)], many) ^ hashes)) < self.rate)]
            out[a : a + (1 << 16)] |= skips[ends] > skips[ends - many]
        return np.flatnonzero(out)

    def dropped(self, segments: list[str], numbers: np.ndarray, keys: np.ndarray, start: np.ndarray, count: np.ndarray) -> None:
        """Encodes these occurrences anew. Their ids lie behind those that are remembered, until the next segments come."""
        end = self.used
        sizes = self.size[numbers]
        short = np.flatnonzero(sizes <= SHORT)
        for a in range(0, len(short), 20_000):
            part = short[a : a + 20_000]
            ids, counts = encode_short(self.v, codes_of([segments[i] for i in part.tolist()]), sizes[part], keys[part], self.rate)
            self.store = self.put(self.store, end, ids)
            start[part], count[part] = end + np.cumsum(counts) - counts, counts
            end += len(ids)
        for i in np.flatnonzero(sizes > SHORT).tolist():
            ids = np.array(encode_long(self.v, segments[i], int(keys[i]), self.rate), np.uint32)
            self.store = self.put(self.store, end, ids)
            start[i], count[i] = end, len(ids)
            end += len(ids)

    def encode(self, texts: list[str], keys: list[int | None], most: int = 1 << 20, copies: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) one after another, and the number of ids of each text. keys: ids of the documents; copies: which copy of
        its document, from 0 on, each text is. Both pick the variants."""
        ids, counts = [], []
        row = 0
        while row < len(texts):
            segments: list[str] = []
            sizes: list[int] = []
            first, size = row, 0
            while row < len(texts) and (row == first or size < most):
                found = _SEGMENT.findall(" " + texts[row]) if texts[row] else []
                segments += found
                sizes.append(len(found))
                size += len(texts[row])
                row += 1
            n = np.array(sizes, np.int64)
            place = np.arange(len(segments)) - np.repeat(np.cumsum(n) - n, n)
            own = mix64(np.array([(k or 0) & (2**64 - 1) for k in keys[first:row]], np.uint64) + np.uint64(self.seed))
            if copies is not None:
                copy = np.array(copies[first:row], np.uint64)
                own = np.where(copy > 0, mix64(own ^ mix64(copy)), own)
            at = self.known(segments)
            start, each = self.start[at], self.count[at]
            if self.rate > 0 and len(at):
                pick = (mix64((place + 1).astype(np.uint64) + np.repeat(own, n)) % np.uint64(VARIANTS)).astype(np.int64)
                key = keyed(self.content[at], pick, self.seed)
                other = self.other(at, key)
                s, c = start[other], each[other]
                self.dropped([segments[i] for i in other.tolist()], at[other], key[other], s, c)
                start[other], each[other] = s, c
            ends = np.cumsum(each)
            ids.append(self.store[np.repeat(start - ends + each, each) + np.arange(ends[-1] if len(ends) else 0)])
            upto = np.r_[0, ends][np.r_[0, np.cumsum(n)]]
            counts.append(np.diff(upto))
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.concatenate(counts) if counts else np.zeros(0, np.int64)


@lru_cache(1)
def worker_encoder(path: str, rate: float, seed: int) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path, rate, seed)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE, seed: int = SEED) -> DataFrame:
    """doc_id, ids (array of int), text_sha256 of every row of docs; each worker has to find the model at the path.

    Null text counts as empty and has no ids. A null id picks the variants of id 0. Rows that repeat an id and a text are alike; rows with
    one id and different texts are encoded each on its own. Of candidates with equal scores the leftmost is merged. Other columns are
    ignored; no rows give no rows.
    """
    return _encoded(docs, model_path, id_col, text_col, rate, seed, check=False)


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE, seed: int = SEED, copy_col: str | None = None) -> DataFrame:
    """doc_id, ids, n_tokens, ids_crc32, decoded_sha256, lossless: encode() and decode() in one pass over the texts.

    The ids of each document are decoded again and the digest of the outcome is compared with that of the text. Nulls, ties, repeated rows and empty tables as in encode().
    copy_col numbers the copies of a document from 0 on, so that each has segmentations of its own; without it all are alike.
    """
    return _encoded(docs, model_path, id_col, text_col, rate, seed, check=True, copy_col=copy_col)


def _encoded(docs: DataFrame, model_path: str, id_col: str, text_col: str, rate: float, seed: int, check: bool, copy_col: str | None = None) -> DataFrame:
    def each(batches):
        encoder = worker_encoder(model_path, rate, seed)
        for batch in batches:
            for a in range(0, len(batch), 512):
                keys = batch.column(0).slice(a, 512)
                texts = [x or "" for x in batch.column(1).slice(a, 512).to_pylist()]
                found, counts = encoder.encode(texts, keys.to_pylist(), copies=batch.column(2).slice(a, 512).to_pylist())
                lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(counts)].astype(np.int32), pa.array(found.view(np.int32)))
                shas = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts]
                if check:
                    _, crc, decoded = _decoded(encoder.v, lists)
                    same = [x == y for x, y in zip(decoded, shas, strict=True)]
                    yield pa.RecordBatch.from_arrays([keys, lists, pa.array(counts), pa.array(crc, pa.int64()), pa.array(decoded, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_tokens", "ids_crc32", "decoded_sha256", "lossless"])
                else:
                    yield pa.RecordBatch.from_arrays([keys, lists, pa.array(shas, pa.string())], ["doc_id", "ids", "text_sha256"])

    schema = "doc_id long, ids array<int>, n_tokens long, ids_crc32 long, decoded_sha256 string, lossless boolean" if check else "doc_id long, ids array<int>, text_sha256 string"
    copy = F.col(copy_col).cast("long") if copy_col else F.lit(0).cast("long")
    return small_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), copy)).mapInArrow(each, schema)


def _decoded(v: Vocabulary, lists: pa.Array) -> tuple[list[bytes], list[int], list[str]]:
    """The UTF-8 text, the crc32 of the ids as little-endian uint32, and the SHA-256 of the text, of each list; null is empty."""
    texts, crc = [], []
    for x in lists:
        ids = x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int32)
        texts.append(v.decode(ids.tolist()))
        crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
    return texts, crc, [hashlib.sha256(t).hexdigest() for t in texts]


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, text, n_tokens, ids_crc32, decoded_sha256, lossless of rows with doc_id, ids, text_sha256."""

    def each(batches):
        v = vocabulary(model_path)
        for batch in batches:
            for a in range(0, len(batch), 512):
                keys, lists, shas = (batch.column(k).slice(a, 512) for k in range(3))
                texts, crc, decoded = _decoded(v, lists)
                sizes = [len(x) if x.is_valid else 0 for x in lists]
                same = [x == y for x, y in zip(decoded, shas.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([keys, lists, pa.array([t.decode("utf-8", "replace") for t in texts], pa.string()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64()), pa.array(decoded, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "ids", "text", "n_tokens", "ids_crc32", "decoded_sha256", "lossless"])

    schema = "doc_id long, ids array<int>, text string, n_tokens long, ids_crc32 long, decoded_sha256 string, lossless boolean"
    return encoded.select("doc_id", "ids", "text_sha256").mapInArrow(each, schema)
