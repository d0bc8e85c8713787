import bisect
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tokentally.llm import packing as P
from tokentally.llm.byte_tokens import ChunkTokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, " ", "\n", "a", " lead", "trail ", "a  b\tc", "a\n\nb", "x y 　z", "it's we'll\nNow then", "tab\there",
       "a <|endoftext|> b", "<|endoftext|>", "end\r\nline", "é" * 30 + " ß", "\x1c a\x85b", "no break" * 400, "z" * 9000, "^a ^b\n^c"]


def best_fit_decreasing(counts, size):
    gaps, bins = [], 0
    for x in sorted(counts, reverse=True):
        for _ in range(counts[x]):
            i = bisect.bisect_left(gaps, x)
            if i < len(gaps):
                gap = gaps.pop(i)
            else:
                gap, bins = size, bins + 1
            bisect.insort(gaps, gap - x)
    return bins


def test_chunked_ids_equal_whole_text_ids():
    tok, ref = ChunkTokenizer(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(["a", "bc", " ", "\n", "'s", ".", "9", "é", "  ", "\t", "The"]) for _ in range(40)) for _ in range(400)]
    want = [ref.encode(t, add_special_tokens=False).ids if t else [] for t in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in tok.blobs(texts)] == want
    assert [np.frombuffer(b, "<u4").tolist() for b in tok.blobs(texts)] == want  # from the memo


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once_and_comes_near_best_fit(seed):
    rng = random.Random(seed)
    size = 64
    counts = {x: rng.choice([0, 1, 2, 7, 500 * (seed % 2)]) for x in range(1, size + 1)}
    counts = {x: c for x, c in counts.items() if c}
    plan = P.plan_sequences(counts, size)
    used = defaultdict(int)
    for runs, bins in plan:
        assert bins > 0 and sum(x * t for x, t in runs) <= size
        for x, t in runs:
            used[x] += t * bins
    assert dict(used) == counts
    assert sum(b for _, b in plan) <= 1.04 * best_fit_decreasing(counts, size) + 1


def test_plan_finds_exact_triples_and_hot_lengths():
    assert P.plan_sequences({10: 3, 3: 3, 2: 3, 1: 3}, 16)[0][0] == [(10, 1), (3, 2)]
    assert sum(b for _, b in P.plan_sequences({10: 3, 3: 3, 2: 3, 1: 3}, 16)) == 3
    assert P.plan_sequences({11: 9, 3: 9, 2: 9}, 16) == [([(11, 1), (3, 1), (2, 1)], 9)]
    assert sum(b for _, b in P.plan_sequences({5: 1_000_000}, 1024)) == -(-1_000_000 // 204)
    assert P.plan_sequences({}, 1024) == []


def test_pack_round_trip(spark):
    rng = random.Random(2)
    rows = [(i, t, 9, 9) for i, t in enumerate(ODD)]
    rows += [(100 + i, " ".join(rng.choice(["alpha", "Beta.", "gamma,", "x9"]) for _ in range(rng.randint(0, 900))), None, None) for i in range(150)]
    rows += [rows[30], rows[30], (None, "no id", 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int, offset int").repartition(6)
    got = P.pack(docs, PATH, derive={"crc": F.crc32("ids")}).collect()
    ref = Tokenizer.from_file(PATH)
    want = sorted((d if d is not None else -1, tuple(ref.encode(t, add_special_tokens=False).ids if t else ()) + (2,)) for d, t, _, _ in rows)
    sequences, docs_ids = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length <= 1024 and r.crc == zlib.crc32(r.ids)
        sequences[r.sequence_id].append((r.offset, r.length))
        docs_ids[r.doc_id].append((r.piece, r.start, tuple(ids.tolist())))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    n_tokens = sum(len(t) for _, t in want)
    assert len(sequences) <= 1.05 * (-(-n_tokens // 1024)) + 2
    for d, ids in want:
        if sum(x == d for x, _ in want) == 1 and d != -1:
            parts = sorted(docs_ids[d])
            assert [p for p, _, _ in parts] == list(range(len(parts)))
            assert [s for _, s, _ in parts] == np.cumsum([0, *[len(x) for _, _, x in parts][:-1]]).tolist()
            assert all(len(x) == 1024 for _, _, x in parts[1:]) and tuple(i for _, _, x in parts for i in x) == ids
    assert sum(r.length for r in got) == n_tokens
    slim = P.pack(docs, PATH, keep_ids=False)
    assert slim.columns == ["doc_id", "piece", "start", "length", "sequence_id", "offset"]


def test_pack_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_memo_is_bounded_in_bytes(monkeypatch):
    import random
    import sys

    from tokentally.llm import byte_tokens as B
    monkeypatch.setattr(B, "_MEMO_BYTES", 2_000_000)  # of what one call adds beyond it, 20 texts
    tok = ChunkTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    lines = ["".join(rng.choice("中文字符测试语料东西南北") for _ in range(300)) for _ in range(3_000)]  # no spaces at all
    words = ["".join(rng.choice("abcdefghij") for _ in range(9)) + rng.choice([",", "...", "!" * rng.randint(1, 20)]) for _ in range(40_000)]
    for texts in ([" ".join(words[i:i + 100]) for i in range(0, len(words), 100)], ["\n".join(lines[i:i + 10]) for i in range(0, len(lines), 10)]):
        for i in range(0, len(texts), 20):
            part = texts[i:i + 20]
            assert [np.frombuffer(b, "<u4").tolist() for b in tok.blobs(part)] == [e.ids for e in tok.tok.encode_batch_fast(part, add_special_tokens=False)]
    held = sum(sys.getsizeof(k) + sys.getsizeof(v) for m in (tok.memo, tok.old) for k, v in m.items())
    assert held < 4_500_000 and max(map(len, [*tok.memo, *tok.old])) <= B._WORD_CHARS


class Watched:
    """A tokenizer that notes what its library is given."""

    def __init__(self, tok):
        self.tok, self.calls = tok, []

    def encode_batch_fast(self, texts, **options):
        self.calls.append(list(texts))
        return self.tok.encode_batch_fast(texts, **options)


def test_new_words_reach_the_library_as_lines_of_few_texts():
    tok, ref = ChunkTokenizer(PATH), Tokenizer.from_file(PATH)
    tok.tok = Watched(tok.tok)
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéß文9'.,-(") for _ in range(rng.randint(1, 12))) for _ in range(5_000)]
    texts = ["".join(w + rng.choice([" ", " ", "\n"]) for w in words[i:i + 50]).strip() for i in range(0, len(words), 50)]
    got = tok.blobs(texts)
    given = [t for call in tok.tok.calls for t in call]
    assert len(given) <= len(words) / 50 and max(map(len, given)) < 20_000
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [ref.encode(t, add_special_tokens=False).ids for t in texts]


def test_joined_lines_part_as_strings_encoded_alone():
    tok, ref = ChunkTokenizer(PATH), Tokenizer.from_file(PATH)
    for strings in (["\nA", " b", "\nc", "'s", ",", " d"], ["a\nb", "\nc", "d"], ["a", "\n", "b"], ["a\n", " b"], ["a ", "b"], ["", "a", ""], ["a", "", "", "b"],
                    ["x" * 30_000, " b", "\n" + "z" * 900], [" a"] * 401, ["one"], []):
        want = [ref.encode(s, add_special_tokens=False).ids for s in strings]
        assert [np.frombuffer(b, "<u4").tolist() for b in tok._encode(strings)] == want


def test_library_is_given_one_short_text_at_a_time():
    tok = ChunkTokenizer(PATH)
    tok.tok = Watched(tok.tok)
    rng = random.Random(6)
    tok.blobs([" ".join("".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(200)) for _ in range(50)])
    assert all(len(call) == 1 and len(call[0]) < 20_000 for call in tok.tok.calls)
