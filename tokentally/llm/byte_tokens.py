"""Whole-text token ids by the ``tokenizers`` library, with a bounded per-worker memo.

Byte-level BPE never joins bytes across a single space or newline between two other
characters, nor across the end of a run of letters. So a text in which white space is such
single spaces and newlines is the concatenation of its chunks (" word,", "\\nWord"), and most
chunks are a word and its punctuation. Both repeat: a worker encodes each word once and remembers
it within a bound of bytes. New words go to the library many at a time, as the lines of a short text. Texts with other white space or special-token strings are encoded whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tokentally.llm.common import gathered

_MEMO_BYTES = 80_000_000  # of a generation of the memo; a worker keeps two
_ENTRY_BYTES = 240        # of an entry besides its characters and ids
_WORD_CHARS = 64          # longer chunks (lines without spaces) are encoded, not remembered
_LINES = 200              # strings that the library encodes at once, as lines of one text
# Behind a letter, which below U+0250 is one in every Unicode version, punctuation up to the chunk's end is a piece of its own.
_TAIL = r"""([A-Za-zÀ-ÖØ-öø-ɏ])([.,!?*$%&#|;:)"-]+)( |$)"""


def regular(text: str) -> bool:
    """White space only as single spaces and newlines between other characters."""
    return " ".join(text.split()) == text.replace("\n", " ")


def spelled(key: str) -> str:
    """The string that a chunk key stands for: without its leading space; "\\r" marks a text's first chunk, "\\x01" punctuation."""
    return key[1:] if key[:1] in "\r\x01" else key if key[:1] == "\n" else " " + key


class ChunkMemo:
    """Ids of texts as little-endian unsigned 32-bit blobs, chunk by chunk with a memo bounded in bytes.

    Subclasses encode strings (``_encode``) and say which texts must be encoded whole (``_whole``).
    """

    def __init__(self):
        self.memo: dict[str, bytes] = {}  # chunks without the punctuation behind them, and that punctuation
        self.old: dict[str, bytes] = {}   # the generation before
        self.size = 0                     # bytes of the memo

    def _encode(self, strings: list[str]) -> list[bytes]:
        raise NotImplementedError

    def _whole(self, text: str) -> bool:
        return not regular(text)

    def _assemble(self, values: list, codes: np.ndarray, ends: np.ndarray) -> list:
        """One blob per text from its chunks' ``values``; text i has the chunks ``codes[ends[i]:ends[i + 1]]``."""
        ids = np.frombuffer(b"".join(values), np.uint32)
        n = np.fromiter(map(len, values), np.int64, len(values)) // 4
        length = n[codes]
        flat = gathered(ids, (np.cumsum(n) - n)[codes], length)
        at = np.concatenate([[0], np.cumsum(length)])[ends].tolist()
        return [flat[a:b].tobytes() for a, b in zip(at, at[1:])]

    def _values(self, keys: list[str]) -> list:
        """What distinct chunks stand for; new ones are encoded and, if short, remembered."""
        if self.size > _MEMO_BYTES:
            self.memo, self.old, self.size = {}, self.memo, 0
        out = list(map(self.memo.get, keys))
        at = [i for i, v in enumerate(out) if v is None]
        if self.old:
            for i in at:
                out[i] = self.old.get(keys[i])
        fresh = [i for i in at if out[i] is None]
        for i, v in zip(fresh, self._encode([spelled(keys[i]) for i in fresh])):
            out[i] = v
        kept = {k: out[i] for i in at if len(k := keys[i]) <= _WORD_CHARS}
        self.memo |= kept
        self.size += _ENTRY_BYTES * len(kept) + 5 * sum(map(len, kept))
        return out

    def blobs(self, texts: list) -> list:
        """One blob (or what ``_encode`` gives) per text; null counts as empty."""
        whole = [bool(t) and ("\x01" in t or self._whole(t)) for t in texts]
        some = [i for i, t in enumerate(texts) if t and not whole[i]]
        out = [None] * len(texts)
        if some:
            apart = pc.replace_substring_regex(pa.array(["\r" + texts[i].replace("\n", " \n") for i in some], pa.large_string()), _TAIL, "\\1 \x01\\2\\3")
            split = pc.split_pattern(apart, " ")
            coded = split.flatten().dictionary_encode()
            values = self._values(coded.dictionary.to_pylist())
            for i, blob in zip(some, self._assemble(values, coded.indices.to_numpy(), split.offsets.to_numpy())):
                out[i] = blob
        for i, t in enumerate(texts):
            if out[i] is None:
                out[i] = self._encode([t])[0] if whole[i] else self._assemble([], np.zeros(0, np.int64), np.zeros(2, np.int64))[0]
        return out


class ChunkTokenizer(ChunkMemo):
    """The ``tokenizers`` library on a tokenizer file."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.newline = self._ids("\n")

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _encode(self, strings: list[str]) -> list[bytes]:
        out = []
        for lo in range(0, len(strings), _LINES):
            lines = strings[lo:lo + _LINES]
            joined = len(lines) > 1 and sum(map(len, lines)) <= _LINES * _WORD_CHARS
            out += self._encode_lines(lines) if joined else [self._ids(s).tobytes() for s in lines]
        return out

    def _encode_lines(self, lines: list[str]) -> list[bytes]:
        """Joined by newlines; if every newline in the text is a token of its own, these part the ids."""
        ids = self._ids("\n".join(lines))
        newlines = np.flatnonzero(ids == self.newline) if len(self.newline) == 1 else ids
        last = np.cumsum([1 + s.count("\n") for s in lines]) - 1  # of the newlines up to each line's end; the last line has none
        if len(newlines) != last[-1]:
            return [self._ids(s).tobytes() for s in lines]
        ends = [*(4 * newlines[last[:-1]]).tolist(), 4 * len(ids)]
        blob = ids.tobytes()
        return [blob[a:b] for a, b in zip([0, *(e + 4 for e in ends)], ends)]

    def _whole(self, text: str) -> bool:
        return not regular(text) or any(s in text for s in self.special)


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    """The worker's tokenizer for a file, made once per process."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]
