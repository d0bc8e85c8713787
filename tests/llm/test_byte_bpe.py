import base64
import random

import pytest
import public_tokenizers
import tiktoken

from tokentally.llm import byte_bpe as B

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", None, " ", "\n\n", "a", " lead", "trail ", "a  b\tc", "x y 　z", "it's we'LL they'll\nNow then", "end\r\nline",
         "é" * 300 + " ßü", "\x1c a\x85b", "norw" * 3000, "日本語のテキスト 123456 ½", "🙂🙂 🇩🇪 á", "<|endoftext|> x", "^a ^b\n^c", "1234567890" * 50,
         "word,\nWord. (x) \"y\" end"]


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n, seed=1):
    rng = random.Random(seed)
    bits = ["a", "bc", " ", "\n", "'s", ".", "9", "é", "  ", "\t", "The", " und", "zażółć", " ", "ing", "!!", " ", "ñ"]
    return TEXTS + ["".join(rng.choice(bits) for _ in range(60)) for _ in range(n)]


def test_perfect_hash_is_minimal_and_rejects_other_keys():
    keys = [str(i).encode() for i in range(5000)]
    h = B.PerfectHash(keys)
    assert sorted(h.find(k) for k in keys) == list(range(5000))
    assert all(h.find(str(i).encode()) == -1 for i in range(5000, 9000))
    assert B.PerfectHash([]).find(b"x") == -1 and B.PerfectHash([b"x"]).find(b"x") == 0


def test_ids_equal_the_library_with_and_without_memo(reference):
    bpe = B.ByteBpe(PATH, public_tokenizers.PATTERN)
    xs = texts(500)
    for _ in range(2):
        for x, blob in zip(xs, bpe.blobs(xs)):
            ids = memoryview(blob).cast("I").tolist()
            assert ids == reference.encode_ordinary(x or ""), x
    assert all(memoryview(bpe.text(x or "")).cast("I").tolist() == reference.encode_ordinary(x or "") for x in xs)


def test_round_trip_in_spark(spark, reference):
    xs = texts(60, seed=4)
    rows = [(i, x, [1], b"clash") for i, x in enumerate(xs)] + [(3, xs[3], None, None), (None, "no id", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, decoded binary").repartition(3)
    got = B.decode(B.encode(docs, PATH)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "no id" if r.doc_id is None else xs[r.doc_id] or ""
        assert bytes(r.decoded) == text.encode() and r.ids == reference.encode_ordinary(text)


def test_empty_table_and_null_ids(spark):
    assert B.decode(B.encode(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    got = B.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).collect()
    assert [bytes(r.decoded) for r in got] == [b"", b""]
