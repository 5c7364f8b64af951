import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from graphloom.llm import bpe, tokens

from .data import awkward, documents


@pytest.fixture(scope="module")
def encoding():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op9_equals_library_and_round_trips(spark, encoding):
    texts = awkward() + [t * 3 for t in awkward() if t]
    got = {r["doc_id"]: r for r in bpe.round_trip(documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = encoding.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids), (i, t)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_op9_random_bytes_of_every_width(encoding):
    b = bpe.load(*bpe.default_vocabulary())
    rng = np.random.default_rng(1)
    for _ in range(200):
        s = "".join(rng.choice(list("abtheinr éß漢"), size=rng.integers(1, 70)))
        ids, at = b.encode([s])
        assert ids.tolist() == encoding.encode_ordinary(s)
        assert b.decode(ids) == s.encode()


def test_op9_columns_kept_and_empty(spark):
    d = documents(spark, ["a b", None])
    r = bpe.decode(bpe.encode(d)).orderBy("doc_id").collect()
    assert [bytes(x["decoded"]) for x in r] == [b"a b", b""] and r[0]["count"] == "x"
    assert bpe.round_trip(d.where("false")).collect() == []


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))  # as the library gives it


def test_op7_equals_library(spark, library):
    e = "<|endoftext|>"
    special = [f"{e} x", f"a {e} b", f"a{e}b", f" {e}", f"{e}  {e}", f"x {e}{e} y {e[:-1]} é{e} 日 {e}.", f"same words {e} same words"]
    texts = awkward() + special + [f"{e} x", "tail"]
    ids = [*range(len(texts) - 3), 90, 90, None]
    docs = documents(spark, texts, ids=ids)
    got = tokens.store_and_read(docs, shard_tokens=500).collect()
    assert len(got) == len(texts)
    order = sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    want, at = [], 0
    for i, t in order:
        x = library.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())))
        at += len(x)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert tokens.store_and_read(docs.where("false")).collect() == []


def test_op7_wavelet_answers():
    rng = np.random.default_rng(3)
    for n, top in ((1, 1), (7, 3), (1000, 50), (4097, 60000), (300, 70000)):
        ids = rng.integers(0, top + 1, n)
        w, docs, lengths = tokens.from_file(tokens.to_file(ids, [5], [n]))
        assert docs == [5] and lengths == [n] and (w.decode() == ids).all()
        for i in rng.integers(0, n, 20):
            assert w.access(int(i)) == ids[i]
            s = int(ids[i])
            where = np.flatnonzero(ids == s)
            assert w.count(s) == len(where) and w.rank(s, int(i)) == (ids[:i] == s).sum()
            assert w.places(s)[:5] == where.tolist()[:5] and w.select(s, len(where) - 1) == where[-1]
        assert w.count(1 << 20) == 0
        with pytest.raises(IndexError):
            w.access(n)


def test_op7_reads_few_blocks_of_a_file():
    rng = np.random.default_rng(4)
    ids = rng.integers(0, 50_000, 700_000)
    w, _, _ = tokens.from_file(tokens.to_file(ids, [1], [len(ids)]))
    i = 333_333
    assert w.access(i) == ids[i] and w.block.cache_info().currsize <= 2 * w.bits
    where = np.flatnonzero(ids == ids[i])
    assert w.count(int(ids[i])) == len(where) and w.places(int(ids[i])) == where.tolist()
    assert (w.decode() == ids).all()


def test_op7_string_ids(spark):
    d = documents(spark, ["b text", "a text", None, "c"]).selectExpr("concat('doc-', doc_id % 3) AS doc_id", "text")
    got = sorted(map(tuple, tokens.store_and_read(d).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == ["doc-0", "doc-0", "doc-1", "doc-2"] and [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got[:-1]]]).tolist()


def test_dealers_part_all_buckets(spark):
    from graphloom.llm.common import dealers

    for n in (1, 7, 51):
        d = spark.createDataFrame([(x,) for x in dealers(n)], "x int").repartition(n, "x").selectExpr("spark_partition_id() AS p")
        assert d.distinct().count() == n


def test_op9_replaces_a_column_of_its_name(spark):
    d = documents(spark, ["a b"]).selectExpr("*", "'mine' AS token_ids")
    r = bpe.encode(d).first()
    assert r.asDict().keys() == set(d.columns) and list(r["token_ids"]) == bpe.load(*bpe.default_vocabulary()).encode(["a b"])[0].tolist()


def test_op7_lines_and_spaces_of_all_kinds(library):
    rng = np.random.default_rng(7)
    coder = tokens._coder(P.path("byte_bpe_50k.json"))
    bits = ["a", "the", "'s", "x1", ".", ",\n", "\n", "\n\n", " ", "  ", "\t", "\r\n", "\xa0", " ", "é", "漢", "<|endoftext|>", "!", "\x1c", "😀"]
    for _ in range(400):
        texts = ["".join(rng.choice(bits, size=rng.integers(0, 14))) for _ in range(30)]
        ids, at = coder.encode(texts)
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t
