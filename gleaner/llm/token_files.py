"""Token-id files with a minimal perfect hash index.

A shard file holds the documents of one range of keys in ascending order:

    "<8sQQQQQ"  magic, documents, tokens, distinct keys, bytes of the hash function, bytes of an id
    documents x (int64 key, uint8 key is null), (documents + 1) x uint64 token offsets
    the minimal perfect hash function of the distinct keys
    distinct keys x (uint32 fingerprint, uint32 document number of the key's first document)
    the ids, raw, little-endian

A lookup reads the head, hashes the key to a block of the function that tells its slot, compares the stored fingerprint
and the key, and seeks to the ids: a few small reads, whatever the size of the shard. The manifest has the least and the
greatest key of each shard, so lookup() opens only the shards that its keys are in.

Documents are encoded where they are read; only ids are shuffled, to the shard of their key range. A shard is one
task's work, of about SHARD_BYTES of text: ranges are cut by the bytes in finer ranges of keys. Files are written under a
name of the attempt and then renamed, so a task that runs again replaces equal content. They go to the shared folder by
its URI.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, mix64, scratch_path, small_batches, utf8

MAGIC = b"GTOKENS2"
HEAD = "<8sQQQQQ"
INDEX = [("f", "<u4"), ("d", "<u4")]
END_ID = 1
SHARD_BYTES = 256 << 20
#: Ranges of keys whose bytes are counted, for each shard.
FINER = 4
#: Most shards whose key bounds, 16 bytes each, a lookup sends to its tasks: those of 256 TB of text.
MOST_SHARDS = 1 << 20
#: Words whose ids a worker remembers, in each of two generations.
REMEMBERED = 400_000
#: A word that is one token and stands between words that are encoded in one go.
DELIMITER = "|"
#: A word with one of these behind a letter is encoded without it.
MARKS = ".,;:!?"
LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyz")


class PerfectHash:
    """Maps n distinct uint64 keys to 0..n-1 with a few bits a key.

    On each level the keys that are left are hashed into a bit array of GAMMA times their number; those that are alone
    at their bit are placed there, the others go to the next level. The slot of a key is the number of set bits before
    its own, over all levels. Stored are the number of levels and their sizes, then blocks of BLOCK bits with the number
    of set bits before them, so one block tells whether a bit is set and its slot.
    """

    GAMMA = 2
    BLOCK = 512
    WIDTH = 8 + BLOCK // 8

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        flat = np.concatenate(levels) if levels else np.zeros(0, bool)
        self.starts = np.cumsum([0, *(len(x) for x in levels)])
        self.rank = np.zeros(len(flat) + 1, np.int64)
        np.cumsum(flat, out=self.rank[1:])

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(keys ^ mix64(np.full(1, level + 1, np.uint64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            size = -(-cls.GAMMA * len(keys) // cls.BLOCK) * cls.BLOCK
            at = cls.place(keys, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key that was not built in, some slot or -1."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = self.place(keys[left], k, len(bits))
            hit = bits[at]
            out[left[hit]] = self.rank[self.starts[k] + at[hit]]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        sizes = [len(x) for x in self.levels]
        bits = np.packbits(np.concatenate(self.levels) if sizes else np.zeros(0, bool), bitorder="little").reshape(-1, self.BLOCK // 8)
        blocks = np.zeros((len(bits), self.WIDTH), np.uint8)
        blocks[:, :8] = self.rank[:-1][:: self.BLOCK].astype("<u8").reshape(-1, 1).view(np.uint8)
        blocks[:, 8:] = bits
        return struct.pack(f"<{len(sizes) + 1}Q", len(sizes), *sizes) + blocks.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        sizes = struct.unpack_from(f"<{struct.unpack_from('<Q', data)[0]}Q", data, 8)
        blocks = np.frombuffer(data, np.uint8, offset=8 + 8 * len(sizes)).reshape(-1, cls.WIDTH)
        flat = np.unpackbits(blocks[:, 8:].ravel(), bitorder="little").astype(bool)
        return cls([flat[end - n : end] for n, end in zip(sizes, np.cumsum(sizes).tolist(), strict=True)])

    @classmethod
    def slot(cls, key: np.ndarray, sizes: tuple[int, ...], block) -> int:
        """slots() of an array of one key, with block(k) to read the k-th block and nothing else."""
        start = 0
        for level, size in enumerate(sizes):
            at = start + int(cls.place(key, level, size)[0])
            data = block(at // cls.BLOCK)
            inside = at % cls.BLOCK
            bits = int.from_bytes(data[8:], "little")
            if bits >> inside & 1:
                return struct.unpack_from("<Q", data)[0] + (bits & ((1 << inside) - 1)).bit_count()
            start += size
        return -1


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


def shard_bytes(keys: np.ndarray, null: np.ndarray, ids: list[bytes], width: int) -> bytes:
    """A shard file. keys: int64, equal ones together; null: uint8; ids: the little-endian ids of each document."""
    ends = np.zeros(len(ids) + 1, "<u8")
    np.cumsum([len(x) // width for x in ids], out=ends[1:])
    distinct, first = np.unique(keys[null == 0], return_index=True)
    first = np.flatnonzero(null == 0)[first]
    distinct = distinct.view(np.uint64)
    function = PerfectHash.build(distinct)
    slots = function.slots(distinct)
    index = np.zeros(len(distinct), INDEX)
    index["f"][slots], index["d"][slots] = fingerprints(distinct), first
    packed = function.to_bytes()
    head = struct.pack(HEAD, MAGIC, len(ids), int(ends[-1]), len(distinct), len(packed), width)
    return b"".join([head, keys.astype("<i8").tobytes(), null.astype(np.uint8).tobytes(), ends.tobytes(), packed, index.tobytes(), *ids])


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if "://" in uri else "file:///" + uri.split(":", 1)[-1].lstrip("/"))


class ShardFile:
    """Reads one shard file. Opening reads its head and the sizes of the function's levels; all else is read when asked for."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.file = fs.open_input_file(path)
        size = struct.calcsize(HEAD)
        magic, self.n, self.n_tokens, self.m, packed, self.width = struct.unpack(HEAD, self.file.read(size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        self.at = {"keys": size, "null": size + 8 * self.n, "ends": size + 9 * self.n, "function": size + 17 * self.n + 8}
        self.at["index"] = self.at["function"] + packed
        self.at["ids"] = self.at["index"] + 8 * self.m
        (levels,) = struct.unpack("<Q", self.read("function", 0, 8))
        self.sizes = struct.unpack(f"<{levels}Q", self.read("function", 8, 8 * levels))

    def read(self, part: str, start: int, size: int) -> bytes:
        self.file.seek(self.at[part] + start)
        return self.file.read(size)

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The keys, null flags and token offsets of all documents."""
        return (
            np.frombuffer(self.read("keys", 0, 8 * self.n), "<i8"), np.frombuffer(self.read("null", 0, self.n), np.uint8),
            np.frombuffer(self.read("ends", 0, 8 * (self.n + 1)), "<u8").astype(np.int64),
        )

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of the first document of each int64 key, or -1 (for nearly all keys that are not there); reads the whole index."""
        wanted = keys.astype(np.int64).view(np.uint64)
        if not self.m:
            return np.full(len(keys), -1, np.int64)
        index = np.frombuffer(self.read("index", 0, 8 * self.m), INDEX)
        slots = PerfectHash.from_bytes(self.read("function", 0, self.at["index"] - self.at["function"])).slots(wanted)
        known = (slots >= 0) & (index["f"][slots] == fingerprints(wanted))
        return np.where(known, index["d"][slots].astype(np.int64), -1)

    def number(self, key: int) -> int:
        """The number of the first document of a key, or -1; a constant number of bytes is read."""
        wanted = np.array([key], np.int64).view(np.uint64)
        blocks = 8 + 8 * len(self.sizes)
        slot = PerfectHash.slot(wanted, self.sizes, lambda k: self.read("function", blocks + k * PerfectHash.WIDTH, PerfectHash.WIDTH))
        if slot < 0:
            return -1
        fingerprint, document = struct.unpack("<II", self.read("index", 8 * slot, 8))
        if fingerprint != int(fingerprints(wanted)[0]) or struct.unpack("<q", self.read("keys", 8 * document, 8))[0] != key:
            return -1
        return document

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from token start to token end."""
        return np.frombuffer(self.read("ids", start * self.width, (end - start) * self.width), f"<u{self.width}")

    def get(self, key: int) -> np.ndarray | None:
        """The ids of the first document of a key."""
        found = self.number(key)
        return None if found < 0 else self.ids(*struct.unpack("<QQ", self.read("ends", 8 * found, 16)))


@lru_cache(2)
def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordEncoder:
    """Encodes texts with a tokenizer that drops [\\x20\\x09-\\x0D] and never joins across it: word by word, remembered.

    Unseen words are encoded many at a time, with a delimiter between them where the ids are cut again; a
    mark behind a letter is put to the ids of the word before it if the tokenizer splits it off. If the tokenizer folds
    case, words that differ in ASCII case only are one.
    """

    def __init__(self, path: str, width: int, remembered: int = REMEMBERED):
        self.tokenizer, self.type, self.remembered = _tokenizer(path), f"<u{width}", remembered
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.folds = '"type":"Lowercase"' in self.tokenizer.to_str()
        ids = self.tokenizer.encode(DELIMITER, add_special_tokens=False).ids
        self.delimiter = ids[0] if len(ids) == 1 else None
        self.marks = {ord(m): self.packed(self.encoded([m])[0]) for m in MARKS if self.splits(m)}

    def splits(self, mark: str) -> bool:
        """Whether a mark behind a letter is a piece of its own."""
        pieces = self.tokenizer.pre_tokenizer and [x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(f"ab{mark}")]
        return pieces == ["ab", mark]

    def learn(self, words: set[bytes]) -> None:
        if len(self.young) > self.remembered:
            self.old, self.young = self.young, {}
        new = []
        for w in words.difference(self.young):
            if w in self.old:
                self.young[w] = self.old[w]
            else:
                new.append(w)
        marked = [w for w in new if w[-1] in self.marks and len(w) > 1 and w[-2] in LETTERS and b"<" not in w]
        new = [*set(new).difference(marked), *{w[:-1] for w in marked}.difference(self.young, new)]
        alone = [w for w in new if self.delimiter is None or DELIMITER.encode() in w or b"<" in w]
        self.young.update((w, self.packed(e)) for w, e in zip(alone, self.encoded([w.decode() for w in alone]), strict=True))
        mark = f" {DELIMITER} "
        rest = [w for w in new if w not in self.young]
        blocks = [rest[a : a + 10_000] for a in range(0, len(rest), 10_000)]
        for block, e in zip(blocks, self.encoded([mark.join(w.decode() for w in b) for b in blocks]), strict=True):
            ids = np.array(e.ids, self.type)
            cut = np.flatnonzero(ids == self.delimiter)
            if len(cut) != len(block) - 1:
                raise ValueError("the tokenizer joins words or splits them by their neighbours")
            raw, size = ids.tobytes(), ids.itemsize
            starts, ends = [0, *((cut + 1) * size).tolist()], [*(cut * size).tolist(), len(raw)]
            self.young.update((w, raw[a:b]) for w, a, b in zip(block, starts, ends, strict=True))
        self.young.update((w, self.young[w[:-1]] + self.marks[w[-1]]) for w in marked)

    def encoded(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []

    def packed(self, encoding) -> bytes:
        return np.array(encoding.ids, self.type).tobytes()

    def encode(self, data: bytes, offsets: list[int], end: bytes, most: int = 1 << 22) -> list[bytes]:
        out: list[bytes] = []
        row = 0
        if self.folds and b"<|" not in data:  # control strings are told apart by their case
            data = data.lower()
        while row < len(offsets) - 1:
            docs, size = [], 0
            while row < len(offsets) - 1 and (not docs or size < most):
                docs.append(data[offsets[row] : offsets[row + 1]].split())
                size += offsets[row + 1] - offsets[row]
                row += 1
            self.learn(set().union(*docs))
            known = self.young.__getitem__
            out += [b"".join(map(known, words)) + end for words in docs]
        return out


@lru_cache(1)
def worker_encoder(path: str, width: int) -> WordEncoder:
    """One for all tasks of a worker."""
    return WordEncoder(path, width)


def _cuts(lengths: DataFrame, shards: int, shard_size: int) -> np.ndarray:
    """lengths: key, size (bytes of the text). The first keys of all shards but the first: about `shards` of equal bytes, none of much more than shard_size where keys allow it."""
    finer = shards * FINER
    edges = sorted({int(x) for x in lengths.select("key").dropna().approxQuantile("key", [i / finer for i in range(1, finer)], 0.25 / shards)})
    if not edges:
        return np.zeros(0, np.int64)
    bounds = np.array(edges, np.int64)

    def each(batches):
        total = np.zeros(len(bounds) + 1, np.int64)
        for batch in batches:
            at = np.searchsorted(bounds, batch.column(0).to_numpy(zero_copy_only=False), "right")
            total += np.bincount(at, batch.column(1).to_numpy(zero_copy_only=False), len(total)).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "size"])

    sized = lengths.filter("key IS NOT NULL").select("key", F.col("size") + 1)
    size = dict(map(tuple, sized.mapInArrow(each, "cell long, size long").groupBy("cell").agg(F.sum("size")).collect()))  # a number for each finer range
    share, now, out = min(shard_size, sum(size.values()) / shards), 0, []
    for cell in range(len(edges)):
        now += size.get(cell, 0)
        if now + size.get(cell + 1, 0) / 2 >= share:
            out.append(edges[cell])
            now = 0
    return np.array(out, np.int64)


def write_token_files(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_size: int = SHARD_BYTES) -> DataFrame:
    """Writes the ids of every whole text in shard files and returns the manifest: shard, uri, n_docs, n_tokens, first_key, last_key, base.

    The shards' key ranges ascend with their number; base is the number of tokens in all shards before. The tokenizer
    has to drop [\\x20\\x09-\\x0D] and not to join across it, and each worker has to find its file at the path. Null text is empty;
    each document ends with end_id. Null keys are stored after all others, in shards of their own, and are not indexed; of documents
    with equal keys, which are neighbours in the order of their ids, the first is. An empty table gives an empty manifest. There are at
    least as many shards as shuffle partitions, where there are as many keys. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    width = 2 if max(_tokenizer(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    lengths = materialize(rows.select("key", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")), "lengths")
    total = lengths.agg(F.sum("size").alias("all"), F.sum(F.when(F.col("key").isNull(), F.col("size"))).alias("null")).first()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total["all"] or 0) // shard_size))
    nulls = 1 + (total["null"] or 0) // shard_size
    cuts = _cuts(lengths, shards, shard_size)
    end = np.array([end_id], f"<u{width}").tobytes()

    def encode(batches):
        encoder = worker_encoder(tokenizer_path, width)
        for batch in batches:
            keys = batch.column(0)
            data, offsets = utf8(batch.column(1))
            ids = encoder.encode(data.tobytes(), offsets.tolist(), end)
            at = np.searchsorted(cuts, keys.fill_null(0).to_numpy(zero_copy_only=False), "right").astype(np.int32)
            for i in np.flatnonzero(keys.is_null().to_numpy(zero_copy_only=False)).tolist():
                at[i] = len(cuts) + 1 + zlib.crc32(ids[i]) % nulls
            for a in range(0, len(ids), 1024):
                yield pa.RecordBatch.from_arrays([pa.array(at[a : a + 1024]), keys.slice(a, 1024), pa.array(ids[a : a + 1024], pa.binary())], ["shard", "key", "ids"])

    encoded = small_batches(rows).mapInArrow(encode, "shard int, key long, ids binary")
    placed = encoded.repartitionById(len(cuts) + 1 + nulls, F.col("shard")).sortWithinPartitions("shard", F.col("key").asc_nulls_last(), "ids")
    folder = scratch_path(spark, "tokens")

    def write(batches):
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        keys, null, ids, shard = [], [], [], None

        def flush():
            content = shard_bytes(np.array(keys, np.int64), np.array(null, np.uint8), ids, width)
            name = f"{path}/shard-{shard:06d}"
            draft = f"{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(draft) as out:
                out.write(content)
            fs.move(draft, f"{name}.ids")
            first, last = (None, None) if null[0] else (keys[0], keys[-1])
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "uri": [f"{folder}/shard-{shard:06d}.ids"], "n_docs": [len(ids)], "n_tokens": [sum(map(len, ids)) // width], "first_key": pa.array([first], pa.int64()), "last_key": pa.array([last], pa.int64())})

        for batch in batches:
            for s, k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if s != shard and ids:
                    yield flush()
                    keys, null, ids = [], [], []
                shard = s
                keys.append(k or 0)
                null.append(k is None)
                ids.append(x)
        if ids:
            yield flush()

    manifest = materialize(placed.mapInArrow(write, "shard int, uri string, n_docs long, n_tokens long, first_key long, last_key long"), "manifest")
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each 256 MB of text
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, block: int = 4096) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files through their index: a key is hashed to the number of its
    document, whose offsets say where its ids are. An index that leads to no or to a wrong document raises, or shows in the result.

    start counts the ids of all documents before; ids_crc32 is the unsigned crc32 of the ids as little-endian uint32.
    """

    def each(batches):
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = ShardFile(uri)
                keys, null, offsets = shard.documents()
                known = keys[null == 0]
                first = shard.find(known)
                if (first < 0).any():
                    raise ValueError(f"the index of {uri} does not lead to its documents")
                # documents of one key follow the one that the index gives; those without a key are not indexed and follow each other
                numbers = np.r_[first + np.arange(len(known)) - np.searchsorted(known, known), np.arange(len(known), len(keys))]
                for a in range(0, len(keys), block):
                    at = numbers[a : a + block]
                    starts, ends = offsets[at], offsets[at + 1]
                    low = int(starts.min())
                    ids = shard.ids(low, int(ends.max())).astype("<u4")
                    crc = [zlib.crc32(ids[i:j]) for i, j in zip((starts - low).tolist(), (ends - low).tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + block].astype(np.int64), mask=null[a : a + block] > 0), pa.array(base + starts), pa.array(ends - starts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = manifest.select("uri", "base", "shard").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard")
    return spread.select("uri", "base").mapInArrow(each, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, keys: DataFrame, key_col: str = "key") -> DataFrame:
    """key, ids of the first document of each key that is there; keys that are null or not there, and repeated ones, give nothing more.

    Each key goes to the one shard whose bounds it lies in. A shard is opened once and answers each of its keys with a few small reads,
    so the work is that of the keys, not of the files. The bounds, two numbers a shard, go to all tasks; there are MOST_SHARDS at most.
    """
    bounds = manifest.filter("first_key IS NOT NULL").orderBy("first_key").select("first_key", "last_key", "uri").limit(MOST_SHARDS + 1).collect()
    if len(bounds) > MOST_SHARDS:
        raise ValueError("too many shards for one lookup; ask for ranges of them")
    first, last = (np.array([r[k] for r in bounds], np.int64) for k in (0, 1))

    def place(batches):
        for batch in batches:
            wanted = batch.column(0).to_numpy(zero_copy_only=False)
            at = np.searchsorted(first, wanted, "right") - 1
            ok = np.flatnonzero((at >= 0) & (wanted <= last[at])) if len(first) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(wanted[ok]), pa.array(first[at[ok]])], ["key", "first_key"])

    def read(batches):
        shard, opened = None, None
        for batch in batches:
            found: list[tuple[int, np.ndarray]] = []
            for uri, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if uri != opened:
                    shard, opened = ShardFile(uri), uri
                if (ids := shard.get(key)) is not None:
                    found.append((key, ids.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int64()))], ["key", "ids"])

    asked = keys.select(F.col(key_col).cast("long").alias("key")).dropna().distinct().mapInArrow(place, "key long, first_key long")
    dealt = asked.join(manifest.select("first_key", "uri"), "first_key").select("uri", "key").repartition("uri").sortWithinPartitions("uri", "key")
    return dealt.mapInArrow(read, "key long, ids array<long>")
