from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gleaner.llm import queries, token_files

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def brute(tokenizer, rows):
    start, out = 0, []
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_same_rows_as_brute_force(spark, tokenizer, middle_dir):
    docs = spark.read.parquet(f"{middle_dir}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, queries.op3_token_files(spark, middle_dir).collect()))
    assert got == brute(tokenizer, docs)


def test_edge_cases(edge_docs, tokenizer):
    got = sorted(map(tuple, token_files.read_token_files(token_files.write_token_files(edge_docs, PATH)).collect()))
    assert got == brute(tokenizer, [(r.doc_id, r.text) for r in edge_docs.collect()])


def test_null_and_repeated_keys(spark, tokenizer):
    rows = [(2, "same"), (2, "same"), (None, "x"), (1, None), (None, "x")]
    manifest = token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), PATH)
    got = sorted(map(tuple, token_files.read_token_files(manifest).collect()), key=lambda r: r[1])
    assert got == brute(tokenizer, rows)


def test_no_rows(no_docs):
    assert token_files.read_token_files(token_files.write_token_files(no_docs, PATH)).count() == 0


def test_lookup_by_key(spark, tokenizer, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    shards = [token_files.ShardFile(r.uri) for r in token_files.write_token_files(docs, PATH, shard_size=50_000).orderBy("shard").collect()]
    assert len(shards) > 1
    text = {r.doc_id: r.text for r in docs.collect()}
    for key in list(text)[::17]:
        found = [x for s in shards if (x := s.get(key)) is not None]
        assert len(found) == 1 and found[0].tolist() == [*tokenizer.encode(text[key], add_special_tokens=False).ids, 1]
    assert all(s.get(10**12) is None for s in shards)


def test_lookup_over_all_shards(spark, tokenizer):
    rows = [(i * 7 - 300, f"text number {i} " * (1 + i % 9 * 40)) for i in range(200)] + [(8, "again"), (None, "none"), (8, "a")] + [(None, f"x{k} " * 3000) for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = token_files.write_token_files(docs, PATH, shard_size=20_000).persist()
    shards = manifest.orderBy("shard").collect()
    known = [r for r in shards if r.first_key is not None]
    assert len(known) > 4 and len(shards) - len(known) > 4  # null keys are in several shards, too
    assert all(a.last_key < b.first_key for a, b in zip(known, known[1:], strict=False))
    wanted = [rows[0][0], 8, 8, 9, 1093, -300, None, 10**15, -(10**15), rows[150][0]]
    got = {r.key: r.ids for r in token_files.lookup(manifest, spark.createDataFrame([(k,) for k in wanted], "key long")).collect()}
    encode = lambda t: [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
    texts = {}
    for key, text in rows:
        texts.setdefault(key, []).append(encode(text))
    assert set(got) == {k for k in wanted if k in texts and k is not None}
    assert all(got[k] in texts[k] for k in got)
    whole = sorted(map(tuple, token_files.read_token_files(manifest).collect()), key=lambda r: r[1])
    assert [r[2] for r in whole[:1]] == [len(encode(rows[0][1]))] and len(whole) == len(rows)
    assert all(a[1] + a[2] == b[1] for a, b in zip(whole, whole[1:], strict=False)) and [r[0] for r in whole[-10:]] == [None] * 10


def test_the_result_comes_through_the_index(spark):
    """Two documents whose numbers are exchanged in the index exchange their ids in the result; a wrong fingerprint raises."""
    docs = spark.createDataFrame([(k, f"number {k} " * (k + 1)) for k in range(6)], "doc_id long, text string")
    manifest = token_files.write_token_files(docs, PATH).filter("n_docs > 0").persist()
    good = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(manifest).collect()}
    at = max(manifest.collect(), key=lambda r: r.n_docs)
    path, shard = at.uri.removeprefix("file://"), token_files.ShardFile(at.uri)
    assert shard.m >= 2
    keys = shard.documents()[0].tolist()
    with open(path, "rb") as f:
        content = bytearray(f.read())
    place = shard.at["index"] + 4
    wrong = bytearray(content)
    wrong[place : place + 4], wrong[place + 8 : place + 12] = content[place + 8 : place + 12], content[place : place + 4]
    one, two = (keys[int.from_bytes(content[p : p + 4], "little")] for p in (place, place + 8))
    with open(path, "wb") as f:
        f.write(wrong)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(manifest).collect()}
    assert got == good | {one: good[two], two: good[one]}
    wrong = bytearray(content)
    wrong[place - 4] ^= 1
    with open(path, "wb") as f:
        f.write(wrong)
    with pytest.raises(Exception, match="does not lead to its documents"):
        token_files.read_token_files(manifest).collect()


def test_lookup_reads_little(spark, tmp_path):
    """The bytes that a lookup reads do not grow with the shard."""
    sizes = []
    for n in (300, 30_000):
        keys = np.arange(n) * 3
        path = tmp_path / f"{n}.ids"
        path.write_bytes(token_files.shard_bytes(keys, np.zeros(n), [np.array([k % 50_000, 1], "<u2").tobytes() for k in keys], 2))
        shard = token_files.ShardFile(f"file://{path}")
        read, total = shard.read, []
        shard.read = lambda *a, read=read, total=total: total.append(a[2]) or read(*a)
        for k in range(0, n, 37):
            assert shard.get(int(keys[k])).tolist() == [keys[k] % 50_000, 1]
            assert shard.get(int(keys[k]) + 1) is None
        sizes.append(sum(total) / (2 * len(range(0, n, 37))))
    assert max(sizes) < 300 and abs(sizes[1] - sizes[0]) < 60


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_perfect_hash_is_minimal(keys):
    array = np.array(sorted(keys), np.uint64)
    data = token_files.PerfectHash.build(array).to_bytes()
    function = token_files.PerfectHash.from_bytes(data)
    assert sorted(function.slots(array).tolist()) == list(range(len(keys)))
    sizes = tuple(len(x) for x in function.levels)
    at = 8 + 8 * len(sizes)
    block = lambda k: data[at + k * function.WIDTH : at + (k + 1) * function.WIDTH]
    assert [token_files.PerfectHash.slot(array[k : k + 1], sizes, block) for k in range(len(array))] == function.slots(array).tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=8))
def test_word_encoder_is_the_tokenizer(texts):
    from gleaner.llm.common import utf8
    import pyarrow as pa

    texts = [t.encode("utf-8", "ignore").decode() for t in texts] + ["a.b, <|endoftext|> c|d it's IT'S w.. x. Y!"]
    data, offsets = utf8(pa.array(texts, pa.string()))
    got = token_files.WordEncoder(PATH, 4).encode(data.tobytes(), offsets.tolist(), b"")
    want = [e.ids for e in token_files._tokenizer(PATH).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
