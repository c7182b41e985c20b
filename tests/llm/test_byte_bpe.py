import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from newsloom.llm import byte_bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(PATH), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    ranks = byte_bpe.ranks_of(PATH)
    return byte_bpe.Encoder(byte_bpe.PerfectHash(list(ranks), list(ranks.values())), ranks, known=50)


def odd_texts() -> list:
    draw = random.Random(3)
    parts = [
        "'", "s", "t", "re", "ll", " ", "  ", "\n", "\t", "\xa0", "　", "a", "é", "中", "1", "²", "٣", "!", "...", "\U0001f600", "́",
        "\x1c", "'ve", "'d", " ", "՘", "꟎", "word", " The", "<|endoftext|>", "ſ", "'S"
    ]
    return ["".join(draw.choice(parts) for _ in range(draw.randrange(14))) for _ in range(8000)] + [
        "", None, " ", "'s", "a's's'", "x" * 3000, " " * 500, "ab " * 400, "\n" * 40 + "x", "中文" * 600, "naïve cafés don't we'll"
    ]


def numbers(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()


def test_ids_equal_the_librarys(encoder, library):
    assert byte_bpe.SPLIT == public_tokenizers.PATTERN
    texts = odd_texts()
    for window in (64, 1 << 20):
        encoder.window = window
        found = [ids for part in encoder.encode(pa.array(texts)) for ids in part]
        assert [numbers(ids) for ids in found] == library.encode_ordinary_batch([t or "" for t in texts])


def test_perfect_hash_is_minimal_and_exact():
    keys = [f"key {i}".encode() for i in range(5000)]
    hashed = byte_bpe.PerfectHash(keys, list(range(5000)))
    assert sorted(hashed.value.tolist()) == list(range(5000))  # every slot is taken once
    asked = [*keys, b"", b"key 5000", b"kex 1", b"ke"]
    data = np.frombuffer(b"".join(asked), np.uint8)
    ends = np.cumsum([len(k) for k in asked])
    starts = ends - np.array([len(k) for k in asked])
    # a wrong key with a right one's hash is not taken for it
    hashes = byte_bpe.word_hashes(data, starts, ends)
    hashes[5002] = hashes[1]
    found, value = hashed.find(data, starts, ends, hashes)
    assert found.tolist() == [True] * 5000 + [False] * 4
    assert value[:5000].tolist() == list(range(5000))
    with pytest.raises(ValueError):
        byte_bpe.PerfectHash([b"a", b"a"], [0, 1])
    assert not byte_bpe.PerfectHash([], []).find(data, starts, ends, hashes)[0].any()


def test_merges_take_the_leftmost_of_equal_ranks(tmp_path):
    ranks = {bytes([i]): i for i in range(256)} | {b"aa": 256, b"aaa": 257, b"ab": 300}
    assert byte_bpe.merged(b"aaaaa", ranks) == [256, 257]
    assert byte_bpe.merged(b"aab", ranks) == [256, ord("b")]
    library = tiktoken.Encoding("own", pat_str=byte_bpe.SPLIT, mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(1)
    for _ in range(500):
        text = "".join(draw.choice("ab") for _ in range(draw.randrange(1, 30)))
        assert byte_bpe.merged(text.encode(), ranks) == library.encode_ordinary(text)


def test_windows_end_before_white_space():
    data = np.frombuffer(b"ab cd  ef" * 50, np.uint8)
    cuts = byte_bpe.windows(data, 20)
    assert cuts[0] == 0 and cuts[-1] == data.size and len(cuts) > 10
    assert all(data[c] == 0x20 and data[c - 1] != 0x20 for c in cuts[1:-1])
    assert byte_bpe.windows(np.frombuffer(b"x" * 90, np.uint8), 20) == [0, 90]


def test_query_columns_on_the_corpus(spark, docs, rows, library):
    encoded = byte_bpe.encode(docs.withColumn("ids", docs.lang).withColumn("n_tokens", docs.lang), PATH)
    assert encoded.columns == ["doc_id", "n_tokens", "ids"]
    found = sorted(
        ((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in byte_bpe.decode(encoded, PATH).collect()),
        key=lambda r: (r[0] is None, r[0] or 0, r[2])
    )
    wanted = []
    for doc_id, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        wanted.append((doc_id, len(ids), np.array(ids, "<u4").tobytes(), (text or "").encode()))
    assert found == sorted(wanted, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    assert [numbers(bytes(r.ids)) == list(r.x) for r in encoded.select("ids", byte_bpe.unpacked().alias("x")).limit(5).collect()] == [True] * 5


def test_empty_table_and_null_ids(spark, none):
    assert byte_bpe.decode(byte_bpe.encode(none, PATH), PATH).count() == 0
    given = spark.createDataFrame([(None, "old"), (bytearray(b""), "old")], "ids binary, decoded string")
    assert [r.decoded for r in byte_bpe.decode(given, PATH).collect()] == [None, bytearray(b"")]


def test_registered_query(spark, library):
    from newsloom.llm.queries import queries

    found = queries()["op13_byte_bpe"](spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_rank_file_lines(tmp_path):
    path = tmp_path / "own.tiktoken"
    path.write_bytes(base64.b64encode(b"ab") + b" 7\n\n" + base64.b64encode(b" ") + b" 8\n")
    assert byte_bpe.ranks_of(str(path)) == {b"ab": 7, b" ": 8}
