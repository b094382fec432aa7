"""Suffix-array dedup of repeated byte strings.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else. Every string of LENGTH bytes contains an
anchor: its window of ANCHOR-byte strings has one with the least hash, whose place depends on the window's content
alone, so equal strings have equal anchors at equal places. The work follows the anchors:

1. Each document gives its anchors (about one in 69 bytes) with the hash of their whole context, the bytes that strings of
   LENGTH around the anchor can reach. Anchors are counted by hash; single ones are done.
2. If all contexts of a repeated anchor are equal, each is covered from end to end.
3. Otherwise the distinct contexts of an anchor, one occurrence each, are compared as bytes. The contexts to the left
   and to the right of the anchor are two compact tries; a context is the string of the trie edges on its way, left
   leaf to right leaf. Two contexts share exactly the edges that their common bytes make up, so the repeated
   strings are the common substrings of these strings of edges, measured in bytes. They are found with a suffix array:
   for each suffix the longest common prefix with its neighbours in the array.
4. More than GROUP distinct contexts of an anchor are too many for a task. They are split by what they share: a string of LENGTH
   bytes begins x bytes before the anchor, and for x from a to b it holds the a bytes before the anchor and the LENGTH - b bytes from
   there on. Contexts that share these are a cell of their own, in which they are cut to what such strings reach; equal ones
   of these are found by grouping, the others go through step 3 again. x is split in STEPS ranges at a time, down to a
   single x, where contexts are the strings themselves and grouping is all there is to do.

The suffix array is built by linear grouping: suffixes are grouped by their longest Lyndon prefixes, from the
greatest group down, each group sending the suffixes at its previous smaller places to new groups; then a pass over
the array emits each group's order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, small_batches, span_hashes, text_blocks, text_key, utf8

LENGTH = 200
ANCHOR = 64
GROUP = 4096
#: Ranges that the places of a frequent anchor in its strings are split in at a time.
STEPS = 12
#: Parts that the members of very frequent anchors are dealt to when results are handed back to them.
SALTS = 32
#: Trie edges that one suffix array is built over, about.
ARRAY = 20_000

# Polynomial hashes of windows: with sums[i] the sum of value(byte j) * BASE ** j over j < i, the window [a, b) has the hash
# (sums[b] - sums[a]) * BASE ** -a, all modulo 2 ** 64. They choose anchors and bring them together, no more: contexts are
# told apart by span_hashes and by their bytes, so windows that collide cost time only.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    found = _powers.get(base)
    if found is None or len(found) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length() if n > 1 else 1)
        found = np.full(size, base, np.uint64)
        found[0] = 1
        found = np.cumprod(found, dtype=np.uint64)
        if size <= 1 << 23:
            _powers[base] = found
    return found[:n]


def window_hashes(text: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window of `width` bytes."""
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_VALUES[text] * _power(_BASE, len(text)), out=sums[1:])
    return mix64((sums[width:] - sums[:-width]) * _power(_INVERSE, len(text) - width + 1))


def suffix_array(text: list[int]) -> list[int]:
    """The suffix array of a list of ints by linear grouping; the end of the list counts as smaller than all."""
    n = len(text)
    # A group is a range of `order`, named by its start; `group` has the group of each suffix, `last` the end of each group.
    order = sorted(range(n), key=text.__getitem__)
    at, group, last = [0] * n, [0] * n, [0] * n
    start = 0
    for k, i in enumerate(order):
        if text[i] != text[order[start]]:
            start = k
        at[i], group[i], last[start] = k, start, k
    before = [-1] * n  # the nearest place before in a smaller group
    end = n - 1
    while end >= 0:  # the greatest group that is left; its suffixes now share their whole Lyndon prefix
        here = group[order[end]]
        asked: dict[int, int] = {}
        for i in sorted(order[here : end + 1]):
            p = i - 1
            while p >= 0 and group[p] >= here:
                p = before[p]
            before[i] = p
            if p >= 0:
                asked[p] = asked.get(p, 0) + 1
        # Places that the same number of these suffixes follow leave their group together and become the group above
        # it; the more follow, the higher. What left earlier, before greater suffixes, is above that already.
        by_times: dict[int, list[int]] = {}
        for p, times in asked.items():
            by_times.setdefault(times, []).append(p)
        for times in sorted(by_times, reverse=True):
            tops: dict[int, int] = {}
            for p in by_times[times]:
                old = group[p]
                top = last[old]
                tops.setdefault(old, top)
                other, k = order[top], at[p]
                order[k], order[top], at[other], at[p] = other, p, k, top
                last[old] = top - 1
            starts = {old: last[old] + 1 for old in tops}
            for p in by_times[times]:
                group[p] = starts[group[p]]
            for old, new in starts.items():  # new is old if the whole group moved
                last[new] = tops[old]
        end = here - 1
    array, placed, front = [0] * n, [False] * n, list(range(n))

    def emit(j: int) -> None:
        while j >= 0 and not placed[j]:
            placed[j] = True
            array[front[group[j]]] = j
            front[group[j]] += 1
            j = before[j]

    emit(n - 1)  # suffixes that only the end of the text is smaller than
    for k in range(n):
        emit(array[k] - 1)
    return array


def common_prefixes(text: list[int], array: list[int]) -> list[int]:
    """For each suffix, the length of the prefix it has in common with the one before it in the array."""
    n = len(text)
    previous = [-1] * n
    for a, b in zip(array, array[1:], strict=False):
        previous[b] = a
    out, k = [0] * n, 0
    for i in range(n):
        j = previous[i]
        if j < 0:
            k = 0
            continue
        while i + k < n and j + k < n and text[i + k] == text[j + k]:
            k += 1
        out[i] = k
        k = max(0, k - 1)
    return out


def anchors(text: np.ndarray, offsets: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the block, hash) of the anchors of each text; a text shorter than length has none."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    width = length - anchor + 1
    if len(text) < length:
        return none
    starts = np.arange(len(text) - anchor + 1)
    hashes = window_hashes(text, anchor)
    # The least of hash and place, the leftmost of equal hashes, over `width` starts: from prefix and suffix minima of blocks.
    keyed = (hashes & np.uint64(0xFFFFFFFF00000000)) | starts.astype(np.uint64)
    n = len(keyed) - width + 1
    filled = np.full(-(-len(keyed) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    filled[: len(keyed)] = keyed
    ahead = np.minimum.accumulate(filled.reshape(-1, width), axis=1).ravel()
    behind = np.minimum.accumulate(filled.reshape(-1, width)[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
    inside = np.zeros(n + 1, np.int64)  # windows that lie in one text
    sizes = np.diff(offsets)
    long = np.flatnonzero(sizes >= length)
    np.add.at(inside, offsets[long], 1)
    np.add.at(inside, offsets[long] + sizes[long] - length + 1, -1)
    chosen = np.zeros(len(keyed), bool)
    chosen[(least[np.cumsum(inside[:-1]) > 0] & np.uint64(0xFFFFFFFF)).astype(np.int64)] = True
    at = np.flatnonzero(chosen)
    return np.searchsorted(offsets, at, "right") - 1, at, hashes[at]


def anchor_rows(texts: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """doc, key, place, left and right (the bytes of its context before its start and from there on), hash, context hash."""

    def each(batches):
        for batch in batches:
            for first, _, text, offsets in text_blocks(batch.column(2)):
                rows, at, hashes = anchors(text, offsets, length, anchor)
                start = np.maximum(offsets[rows], at - (length - anchor))
                end = np.minimum(offsets[rows + 1], at + length)
                whole = span_hashes(text, start, end) + (at - start).astype(np.uint64)
                ids, keys = (batch.column(k).take(pa.array(rows + first)) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([ids, keys, pa.array(at - offsets[rows]), pa.array((at - start).astype(np.int32)), pa.array((end - at).astype(np.int32)), pa.array(hashes.view(np.int64)), pa.array(whole.view(np.int64))], ["doc", "key", "place", "left", "right", "hash", "context"])

    return small_batches(texts).mapInArrow(each, "doc long, key long, place long, left int, right int, hash long, context long")


class Tries:
    """Numbers the edges of the compact tries of the contexts of many anchors and writes contexts as strings of edges."""

    def __init__(self):
        self.width: list[int] = []  # bytes of each edge

    def paths(self, strings: list[bytes]) -> list[list[int]]:
        """The edges from the root that each string shares with others, its own last edge left out."""
        order = sorted(range(len(strings)), key=strings.__getitem__)
        out: list[list[int]] = [[] for _ in strings]
        lengths = [0] * (len(order) + 1)  # common bytes of each string with the one before it in order
        for k in range(1, len(order)):
            a, b = strings[order[k - 1]], strings[order[k]]
            m = min(len(a), len(b))
            lengths[k] = m if a[:m] == b[:m] else _common(a, b, m)
        # A node is open while all strings since share its depth. Closing it, its edge is given to all of them.
        stack: list[tuple[int, int]] = [(0, 0)]  # depth, first string
        for k in range(1, len(order) + 1):
            depth, first = lengths[k] if k < len(order) else 0, k - 1
            while stack[-1][0] > depth:
                top, first = stack.pop()
                edge = len(self.width)
                self.width.append(top - max(stack[-1][0], depth))
                for i in range(first, k):
                    out[order[i]].append(edge)
            if stack[-1][0] < depth:
                stack.append((depth, first))
        return [x[::-1] for x in out]


def _common(a: bytes, b: bytes, most: int) -> int:
    low, high = 0, most
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def shared(groups: list[list[tuple[bytes, bytes]]], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each group of distinct contexts (bytes before the anchor, bytes from its start on), and each context of it: how
    far before and after the anchor's start strings of `length` bytes reach that another context has; (0, 0) if none."""
    tries, text, owner, depth = Tries(), [], [], []
    ends: list[int] = []
    for g, group in enumerate(groups):
        left = tries.paths([a[::-1] for a, _ in group])
        right = tries.paths([b for _, b in group])
        for c, (before, after) in enumerate(zip(left, right, strict=True)):
            text += [*before[::-1], *after, -1]
            owner += [(g, c)] * (len(before) + len(after) + 1)
            reach = sum(tries.width[e] for e in before)
            for e in before[::-1]:
                depth.append(reach)
                reach -= tries.width[e]
            depth += [0] + [-1] * len(after)  # only suffixes from the anchor or before it can be long enough
            ends.append(len(text) - 1)
    for k, end in enumerate(ends):  # an end that no other context has
        text[end] = len(tries.width) + k
    array = suffix_array(text)
    common = common_prefixes(text, array)
    longest = common[:]
    for a, b in zip(array, array[1:], strict=False):
        longest[a] = max(longest[a], common[b])
    bytes_to = [0]
    for s in text:
        bytes_to.append(bytes_to[-1] + (tries.width[s] if s < len(tries.width) else 0))
    out = [[(0, 0)] * len(group) for group in groups]
    for i, k in enumerate(longest):
        if k and depth[i] >= 0:
            size = bytes_to[i + k] - bytes_to[i]
            if size >= length:
                g, c = owner[i]
                low, high = out[g][c]
                out[g][c] = max(low, depth[i]), max(high, size - depth[i])
    return out


def _same_text(doc: str = "_doc", key: str = "_key") -> Column:
    return F.col("doc").eqNullSafe(F.col(doc)) & (F.col("key") == F.col(key))


def _contexts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """hash, context, large, before, after: the bytes of one occurrence of each wanted context (doc, key, place, left, right)."""
    listed = wanted.groupBy(F.col("doc").alias("_doc"), F.col("key").alias("_key")).agg(F.collect_list(F.struct("hash", "context", "large", "place", "left", "right")).alias("w"))
    names = ["hash", "context", "large", "before", "after"]

    def each(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            raw, cut = data.tobytes(), offsets.tolist()
            out: list[tuple] = []
            for start, items in zip(cut, batch.column(1).to_pylist(), strict=False):
                for x in items:
                    at = start + x["place"]
                    out.append((x["hash"], x["context"], x["large"], raw[at - x["left"] : at], raw[at : at + x["right"]]))
                    if len(out) > 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)

    joined = texts.join(listed.hint("shuffle_hash"), _same_text()).select("text", "w")
    return joined.mapInArrow(each, "hash long, context long, large boolean, before binary, after binary")


def _by_suffix_arrays(contexts: DataFrame, length: int, group: str = "hash", name: str = "context") -> DataFrame:
    """group, name, low, high of the contexts of which another one of the same group has a string of length bytes."""
    kinds = [contexts.schema[c].dataType for c in (group, name)]
    types = [pa.binary() if k.simpleString() == "binary" else pa.int64() for k in kinds]

    def each(batches):
        keys: list[tuple] = []
        groups: list[list[tuple[bytes, bytes]]] = []
        size = 0

        def flush():
            out = [(h, c, low, high) for (h, names), found in zip(keys, shared(groups, length), strict=True) for c, (low, high) in zip(names, found, strict=True) if high]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate([*types, pa.int64(), pa.int64()])], [group, name, "low", "high"])

        for batch in batches:
            for h, c, a, b in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if not keys or keys[-1][0] != h:
                    if size >= ARRAY // 8:
                        yield flush()
                        keys, groups, size = [], [], 0
                    keys.append((h, []))
                    groups.append([])
                keys[-1][1].append(c)
                groups[-1].append((a, b))
                size += 1
        if keys:
            yield flush()

    placed = contexts.select(group, name, "before", "after").repartition(group).sortWithinPartitions(group, name)
    return placed.mapInArrow(each, f"{group} {kinds[0].simpleString()}, {name} {kinds[1].simpleString()}, low long, high long")


def _cells(contexts: DataFrame, length: int, width: int) -> DataFrame:
    """hash, context, cell, part, low, high, before, after: the contexts of frequent anchors in the cells of the ranges, of `width` places each,
    between their low and high. before and after are what strings of a range can reach, and part names that."""

    def each(batches):
        for batch in batches:
            out: list[tuple] = []
            for h, c, low, high, before, after in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                for a in range(low, min(high, len(before)) + 1, width):
                    b = min(a + width - 1, high)
                    shown, rest = before[max(0, len(before) - b) :], after[: length - a]
                    if len(shown) + len(rest) < length:
                        continue
                    cell = hashlib.blake2b(b"%d,%d,%d," % (h, a, b), digest_size=16)
                    part = cell.copy()
                    cell.update(before[len(before) - a :] + after[: length - b])
                    part.update(b"%d," % len(shown) + shown + rest)
                    out.append((h, c, cell.digest(), part.digest(), a, b, shown, rest))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

    names = ["hash", "context", "cell", "part", "low", "high", "before", "after"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    rows = contexts.select("hash", "context", "low", "high", "before", "after")
    return rows.mapInArrow(each, "hash long, context long, cell binary, part binary, low int, high int, before binary, after binary")


def _large(rows: DataFrame, name: str, group: int) -> DataFrame:
    """The values of `name` that more than `group` rows have, with every number below SALTS as `salt`."""
    found = rows.groupBy(name).agg(F.count("*").alias("m")).filter(F.col("m") > group)
    return found.select(F.col(name).alias("_large"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))


def _marked(rows: DataFrame, name: str, by: str, group: int) -> DataFrame:
    """rows with `large`: whether more than `group` of them have their value of `name`. A very frequent value is dealt to SALTS parts."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return salted.join(_large(rows, name, group), (F.col(name) == F.col("_large")) & (F.col("salt") == F.col("_salt")), "left").withColumn("large", F.col("_large").isNotNull()).drop("salt", "_salt", "_large")


def _by_cells(contexts: DataFrame, length: int, anchor: int, group: int) -> DataFrame:
    """hash, context, low, high (as _by_suffix_arrays) of the contexts of very frequent anchors, by cells that share ever more bytes."""
    found, open_, width = None, contexts.select("hash", "context", F.lit(0).alias("low"), F.lit(length - anchor).alias("high"), "before", "after"), length - anchor + 1
    while width > 1:
        width = -(-width // STEPS)
        rows = materialize(_cells(open_, length, width), "cells")
        parts = materialize(rows.groupBy("cell", "part").agg(F.count("*").alias("n"), F.first("before").alias("before"), F.first("after").alias("after")), "parts")
        whole = parts.filter("n > 1").select("part", F.length("before").cast("long").alias("low"), F.length("after").cast("long").alias("high"))
        reach = whole
        if width > 1:  # else equal strings are all there is to find
            marked = materialize(_marked(parts, "cell", "part", group), "marked")
            arrays = _by_suffix_arrays(marked.filter("NOT large"), length, "cell", "part").select("part", "low", "high")
            deeper = marked.filter("large")
            open_ = rows.join(_salted(deeper.select("part")), _part_of("hash", "context")).select("hash", "context", "low", "high", "before", "after")
            open_ = materialize(open_, "open")
            reach = reach.unionByName(arrays)
        reach = _salted(materialize(reach.groupBy("part").agg(F.max("low").alias("low"), F.max("high").alias("high")), "reach"))
        out = rows.select("hash", "context", "part").join(reach, _part_of("hash", "context")).select("hash", "context", "low", "high")
        found = out if found is None else found.unionByName(out)
        if width > 1 and open_.isEmpty():
            break
    return found


def _salted(parts: DataFrame) -> DataFrame:
    """parts (part, ...) for every salt, to be joined with rows of which very many may have one part."""
    return parts.withColumnRenamed("part", "_part").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _part_of(*by: str) -> Column:
    return (F.col("part") == F.col("_part")) & (F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int") == F.col("_salt"))


def repeated_spans(texts: DataFrame, length: int = LENGTH, group: int = GROUP, anchor: int = ANCHOR) -> DataFrame:
    """doc, key, start, end of spans that together are all bytes of repeated strings. texts: doc, key, text; a text is named by
    both, so an id may be null or have several texts."""
    rows = anchor_rows(texts, length, anchor)
    counts = rows.groupBy("hash").agg(F.count("*").alias("k"), F.min("context").alias("lo"), F.max("context").alias("hi")).filter("k > 1")
    counts = materialize(counts.select("hash", (F.col("lo") == F.col("hi")).alias("same")), "anchors")
    hits = materialize(rows.join(counts, "hash"), "hits")
    spans = hits.filter("same").select("doc", "key", (F.col("place") - F.col("left")).alias("start"), (F.col("place") + F.col("right")).alias("end"))
    mixed = hits.filter("NOT same")
    one = F.min(F.struct("doc", "key", "place", "left", "right")).alias("one")
    classes = materialize(mixed.groupBy("hash", "context").agg(F.count("*").alias("n"), one), "contexts")
    wanted = _marked(classes, "hash", "context", group).select("hash", "context", "large", "one.*")
    contexts = materialize(_contexts(texts, wanted), "bytes")
    reach, large = _by_suffix_arrays(contexts.filter("NOT large"), length), contexts.filter("large")
    if not large.isEmpty():
        reach = reach.unionByName(_by_cells(large, length, anchor, group))
    whole = classes.filter("n > 1").select("hash", "context", F.col("one.left").cast("long").alias("low"), F.col("one.right").cast("long").alias("high"))
    reach = materialize(reach.unionByName(whole).groupBy("hash", "context").agg(F.max("low").alias("low"), F.max("high").alias("high")), "reach")
    part = mixed.join(reach, ["hash", "context"]).select("doc", "key", (F.col("place") - F.col("low")).alias("start"), (F.col("place") + F.col("high")).alias("end"))
    return spans.unionByName(part)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group: int = GROUP, keep_bytes: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes; null unless keep_bytes).

    Texts are their UTF-8 bytes; null counts as empty. Repeats are judged on the input, within and across documents.
    Every row is a document of its own, also where the id is null or another row has it: rows that repeat an id and a text are copies
    of each other. Texts of fewer than length bytes stay whole. Other columns are ignored; no rows give no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), text_key(text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    spans = repeated_spans(texts.filter(F.octet_length("text") >= length), length, group)
    listed = spans.groupBy(F.col("doc").alias("_doc"), F.col("key").alias("_key")).agg(F.collect_set(F.struct("start", "end")).alias("cut"))

    def each(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            raw, at = data.tobytes(), offsets.tolist()
            removed, runs, kept, shas = [], [], [], []
            for a, b, cut in zip(at, at[1:], batch.column(2).to_pylist(), strict=False):
                parts, done, gone, n = [], a, 0, 0
                top = None
                for start, end in sorted((a + x["start"], a + x["end"]) for x in cut or ()):
                    if top is None or start > top:
                        if top is not None:
                            done = top
                        parts.append(raw[done:start])
                        n, gone, top = n + 1, gone + end - start, end
                    elif end > top:
                        gone, top = gone + end - top, end
                parts.append(raw[a if top is None else top : b])
                removed.append(gone)
                runs.append(n)
                left = b"".join(parts)
                shas.append(hashlib.sha256(left).hexdigest())
                kept.append(left if keep_bytes else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = texts.join(listed.hint("shuffle_hash"), _same_text(), "left").select("doc", "text", "cut")
    return joined.mapInArrow(each, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
