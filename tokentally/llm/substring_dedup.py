"""Removal of repeated passages, exact to the word, by super-k-mer partitioning.

A window is ``window`` consecutive words. Its minimiser is the smallest hash of the ``GRAM``-word
grams in it; consecutive windows that share it travel as one packed string (a super-k-mer) to
the bucket of that minimiser, so equal windows always meet and a word is sent about three
times instead of thirteen. Packed strings hold two bytes a word: a code for each of the 65,535 commonest
words (the table's own, counted over all texts); other words are spelled out behind them. In a bucket the
windows are sorted, equal ones compared word by word, and each is told the smallest id that has it.

A minimiser that a third of the passages share (a license line) would fill one task. A first pass
counts super-k-mers per minimiser cell; windows of cells that hold much more than the mean go,
one by one, to a grouping by the window itself, which collapses before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokentally.llm.common import gathered, join_skewed, shared_table, small_batches
from tokentally.llm.xxh import xxh64_ranges

WINDOW = 13
GRAM = 3
RUN = 64                # windows in a packed string: as many as its marks have bits
CODES = 65_535          # words with a two-byte code
RARE = 65_535           # the code of all others, which are spelled out
CELLS = 1 << 18
HOT_STRINGS = 20_000    # a cell is hot beyond this and beyond HOT_MEANS times the mean
HOT_MEANS = 4
BUCKET_STRINGS = 100_000
_HELD_WORDS = 500_000   # distinct words that a task counts before it passes on the commonest
_BLOCK = 1 << 12        # cells whose counts travel as one row
_CHUNK_BYTES = 16_000_000

_U = np.uint64


class Words:
    """The words of a batch of texts: flat ids into the batch's distinct words, and where each text's begin."""

    def __init__(self, texts: pa.Array):
        split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
        ends = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        flat = split.flatten()
        # An empty text splits into one empty word.
        full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        if not full.all():
            ends = np.concatenate([[0], np.cumsum(full)])[ends]
            flat = flat.filter(pa.array(full))
        coded = flat.dictionary_encode()
        self.ids = coded.indices.to_numpy().astype(np.int64)
        self.distinct = coded.dictionary
        self.ends = ends  # text i has the words ends[i] to ends[i + 1]

    def __len__(self) -> int:
        return len(self.ids)

    def hashes(self) -> np.ndarray:
        """XXH64 of every distinct word."""
        spelled = self.distinct.cast(pa.binary())
        at = np.frombuffer(spelled.buffers()[1], np.int32)[spelled.offset:][:len(spelled) + 1].astype(np.int64)
        return xxh64_ranges((spelled.buffers()[2] or b"").to_pybytes() if len(spelled) else b"", at[:-1], np.diff(at), 42)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> _U(31)) * _U(0x9E3779B97F4A7C15)
    h = (h ^ h >> _U(29)) * _U(0xBF58476D1CE4E5B9)
    return h ^ h >> _U(32)


def super_kmers(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, windows, minimiser) of every run of windows that share a minimiser; word places are flat."""
    n = len(words)
    empty = np.zeros(0, np.int64)
    if n < window:
        return empty, empty, empty, empty.view(_U)
    h = words.hashes()[words.ids]
    grams = np.zeros(n - gram + 1, _U)
    for i in range(gram):
        grams = grams * _U(0xD6E8FEB86659FD93) + h[i:i + len(grams)]
    grams = _mixed(grams)
    low, width, span = grams, 1, window - gram + 1
    while width < span:  # minimum over ever wider spans
        step = min(width, span - width)
        low = np.minimum(low[:len(low) - step], low[step:])
        width += step
    sizes = np.diff(words.ends)
    text = np.repeat(np.arange(len(sizes)), np.maximum(sizes - window + 1, 0))
    if not len(text):
        return empty, empty, empty, empty.view(_U)
    firsts = np.concatenate([[True], text[1:] != text[:-1]])
    begin = np.flatnonzero(firsts)
    at = np.arange(len(text)) + np.repeat(words.ends[text[begin]] - begin, np.diff(np.append(begin, len(text))))
    low = low[at]
    new = firsts | np.concatenate([[True], low[1:] != low[:-1]])
    run = np.arange(len(text)) - np.maximum.accumulate(np.where(new, np.arange(len(text)), 0))
    starts = np.flatnonzero(run % RUN == 0)
    return text[starts], at[starts], np.diff(np.append(starts, len(text))), low[starts]


def _survey(rows: DataFrame, window: int, gram: int, cells: int) -> tuple[list[str], list[int], int]:
    """The commonest words of all texts, the cells that hold too many super-k-mers, and how many there are.

    Words seen once in a batch of texts are not counted: which words get a code changes sizes, not results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        strings = np.zeros(cells, np.int64)
        for b in batches:
            words = Words(b.column("text"))
            seen = np.bincount(words.ids, minlength=len(words.distinct))
            some = np.flatnonzero(seen > 1)
            counts.update({w: c for w, c in zip(words.distinct.take(pa.array(some)).to_pylist(), seen[some].tolist()) if len(w) < 64})
            if len(counts) > _HELD_WORDS:
                yield from commonest(counts)
                counts = Counter()
            strings += np.bincount((super_kmers(words, window, gram)[3] % _U(cells)).astype(np.int64), minlength=cells)
        yield from commonest(counts)
        for i in range(0, cells, _BLOCK):
            if strings[i:i + _BLOCK].any():
                yield _row([None], [i], [strings[i:i + _BLOCK].tobytes()])

    def commonest(counts: Counter) -> Iterator[pa.RecordBatch]:
        top = counts.most_common(CODES)
        yield _row([w for w, _ in top], [n for _, n in top], [None] * len(top))

    def _row(word: list, n: list, counts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(n, pa.int64()), pa.array(counts, pa.binary())], ["word", "n", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, c in zip(b.column("n").to_pylist(), b.column("counts").to_pylist()):
                held[i] = held.get(i, 0) + np.frombuffer(c, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([i + k for i, c in held.items() for k in np.flatnonzero(c).tolist()], pa.int64()),
                                          pa.array([x for c in held.values() for x in c[c > 0].tolist()], pa.int64())], ["cell", "n"])

    found = shared_table(rows.mapInArrow(run, "word string, n long, counts binary"), "passages-survey")
    words = found.where("word is not null").groupBy("word").agg(F.sum("n").alias("n"))
    common = words.orderBy(F.desc("n"), "word").limit(CODES).collect()  # words of under 64 characters
    cell = shared_table(found.where("counts is not null").select("n", "counts").repartition("n").mapInArrow(total, "cell long, n long"), "passages-cells")
    strings = cell.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = cell.where(F.col("n") > max(HOT_STRINGS, HOT_MEANS * strings / cells)).collect()  # at most cells / HOT_MEANS
    return [r["word"] for r in common], [r["cell"] for r in hot], strings


def _packed(rows: DataFrame, common: list[str], hot: list[int], window: int, gram: int, cells: int, buckets: int) -> DataFrame:
    """(bucket, hot, strings): the super-k-mers of all texts, those of hot cells window by window, as ``_Strings`` a bucket."""
    is_hot = np.zeros(cells, bool)
    is_hot[hot] = True
    codes = {w: i for i, w in enumerate(common)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = Words(b.column("text"))
            text, at, n, low = super_kmers(words, window, gram)
            split = is_hot[(low % _U(cells)).astype(np.int64)]
            bucket = (low // _U(cells) % _U(buckets)).astype(np.int64)
            if split.any():
                each = np.repeat(np.arange(len(n)), np.where(split, n, 1))
                first = np.flatnonzero(np.concatenate([[True], each[1:] != each[:-1]]))
                nth = np.arange(len(each)) - np.repeat(first, np.diff(np.append(first, len(each))))
                text, at, split = text[each], at[each] + nth, split[each]
                n = np.where(split, 1, n[each])
                bucket = np.where(split, buckets + np.arange(len(each)) % buckets, bucket[each])
            if not len(at):
                continue
            order = np.argsort(bucket, kind="stable")
            text, at, n, bucket = text[order], at[order], n[order] + window - 1, bucket[order]
            spelled = words.distinct.to_pylist()
            code = np.array([codes.get(w, RARE) for w in spelled], np.uint16)[words.ids]
            rare = np.flatnonzero(code == RARE)
            letters = pc.binary_join_element_wise(words.distinct.cast(pa.binary()).take(pa.array(words.ids[rare])), b"", b" ").to_pylist()  # a space behind each
            ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, letters), np.int64, len(letters)))])
            r0, r1 = ends[np.searchsorted(rare, at)], ends[np.searchsorted(rare, at + n)]
            columns = [b.column("doc_id").to_numpy()[text], b.column("text_key").to_numpy()[text], (at - words.ends[text]).astype(np.int32), n.astype(np.int32),
                       (r1 - r0).astype(np.int32)]
            packed = gathered(code, at, n)
            behind = gathered(np.frombuffer(b"".join(letters), np.uint8), r0, r1 - r0)
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist()
            word_end, rare_end = np.concatenate([[0], np.cumsum(n)]).tolist(), np.concatenate([[0], np.cumsum(r1 - r0)]).tolist()
            blobs = [b"".join([int(y - x).to_bytes(4, "little"), *(c[x:y].tobytes() for c in columns),
                               packed[word_end[x]:word_end[y]].tobytes(), behind[rare_end[x]:rare_end[y]].tobytes()])
                     for x, y in zip(cut, [*cut[1:], len(at)])]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cut] % buckets), pa.array(bucket[cut] >= buckets), pa.array(blobs, pa.binary())], ["bucket", "hot", "strings"])

    return rows.mapInArrow(run, "bucket long, hot boolean, strings binary")


class _Strings:
    """Packed strings of some rows: doc_id, text_key, start (first word), n (words), spelled (bytes of rare words), codes and rare words."""

    def __init__(self, blobs: list[bytes]):
        parts: list[list] = [[], [], [], [], [], [], []]
        for blob in blobs:
            k, at = int.from_bytes(blob[:4], "little"), 4
            for part, kind in zip(parts, (np.int64, np.int64, np.int32, np.int32, np.int32)):
                part.append(np.frombuffer(blob, kind, k, at))
                at += part[-1].nbytes
            words = int(parts[3][-1].sum())
            parts[5].append(np.frombuffer(blob, np.uint16, words, at))
            parts[6].append(blob[at + 2 * words:])
        self.doc_id, self.text_key, self.start, n, spelled, self.codes = map(np.concatenate, parts[:6])
        self.n, self.spelled = n.astype(np.int64), spelled.astype(np.int64)
        self.rare = b"".join(parts[6])


def first_of_equal(words: np.ndarray, at: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """For each window (the ``window`` word ids from ``at``): the smallest doc that has an equal one.

    Windows are sorted by a hash and neighbours compared word by word; if a hash ever stands for two windows, by their words.
    """
    h = np.zeros(len(at), _U)
    for i in range(window):
        h = _mixed(h + words[at + i].astype(_U) + _U(1))
    order = np.argsort(h, kind="stable")
    for _ in range(2):
        a, b = at[order[:-1]], at[order[1:]]
        meet = np.flatnonzero(h[order[1:]] == h[order[:-1]])
        same = np.ones(len(meet), bool)
        for i in range(window):
            same &= words[a[meet] + i] == words[b[meet] + i]
        if same.all():
            break
        order = np.lexsort([*(words[at + i] for i in range(window)), h])
    new = np.ones(len(order), bool)
    new[1 + meet[same]] = False
    first = np.minimum.reduceat(doc[order], np.flatnonzero(new))
    out = np.empty(len(order), np.int64)
    out[order] = first[np.cumsum(new) - 1]
    return out


_FOUND = "doc_id long, text_key long, start int, marks long, codes binary, rare binary"


def _marks_of_chunk(blobs: list[bytes], window: int) -> pa.RecordBatch:
    """The packed strings with a window that a smaller id has too, and which of their windows."""
    s = _Strings(blobs)
    words = s.codes.astype(np.int64)
    spelled = pc.split_pattern(pa.array([s.rare], pa.binary()), b" ").flatten()
    words[words == RARE] = RARE + spelled[:len(spelled) - 1].dictionary_encode().indices.to_numpy().astype(np.int64)
    count = s.n - window + 1
    row = np.repeat(np.arange(len(count)), count)
    begin = np.cumsum(count) - count
    nth = np.arange(len(row)) - begin[row]
    at = (np.cumsum(s.n) - s.n)[row] + nth
    doc = s.doc_id[row]
    late = first_of_equal(words, at, doc, window) < doc
    marks = np.add.reduceat(late.astype(_U) << nth.astype(_U), begin)
    keep = np.flatnonzero(marks)
    none = pa.nulls(len(keep), pa.binary())
    return pa.RecordBatch.from_arrays([*(pa.array(c[keep]) for c in (s.doc_id, s.text_key, s.start, marks.view(np.int64))), none, none], _FOUND_NAMES)


def _passed_on(blobs: list[bytes]) -> pa.RecordBatch:
    """Single windows of hot cells, as rows without marks."""
    s = _Strings(blobs)
    a, b = (np.concatenate([[0], np.cumsum(n)]).tolist() for n in (2 * s.n, s.spelled))
    flat = s.codes.tobytes()
    return pa.RecordBatch.from_arrays([*map(pa.array, (s.doc_id, s.text_key, s.start)), pa.nulls(len(s.n), pa.int64()),
                                       pa.array([flat[x:y] for x, y in zip(a, a[1:])], pa.binary()),
                                       pa.array([s.rare[x:y] for x, y in zip(b, b[1:])], pa.binary())], _FOUND_NAMES)


_FOUND_NAMES = [f.split()[0] for f in _FOUND.split(", ")]


def _marks_of_buckets(packed: DataFrame, window: int) -> DataFrame:
    """Every bucket's marks: a task takes its sorted buckets in chunks that never split one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size, last = 0, None
        for b in batches:
            for bucket, hot, blob in zip(*(b.column(c).to_pylist() for c in ("bucket", "hot", "strings"))):
                if hot:
                    yield _passed_on([blob])
                    continue
                if size > _CHUNK_BYTES and bucket != last:
                    yield _marks_of_chunk(held, window)
                    held, size = [], 0
                held.append(blob)
                size += len(blob)
                last = bucket
        if held:
            yield _marks_of_chunk(held, window)

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _FOUND)


def _marks_of_hot(windows: DataFrame) -> DataFrame:
    """Marks of single windows: grouped by the window, with partial sums before the shuffle."""
    first = windows.groupBy("codes", "rare").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    first = shared_table(first.where("last > first").select(F.struct("codes", "rare").alias("window"), "first", "n"), "passages-first")
    rows = windows.select(F.struct("codes", "rare").alias("window"), "doc_id", "text_key", "start")
    return join_skewed(rows, first, "window", "n", windows.count(), "inner").where("doc_id > first") \
        .select("doc_id", "text_key", "start", F.lit(1).cast("long").alias("marks"))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, cells: int = CELLS) -> DataFrame:
    """(doc_id, text_key, start, marks): bit i of ``marks`` says that the window at word ``start`` + i also starts in a text of a smaller id.

    ``text_key`` is the text's hash: marks depend on id and text alone, so repeated rows share them. Rows without an id have none.
    """
    rows = _rows(docs, id_col, text_col).where("doc_id is not null")
    common, hot, strings = _survey(rows, window, gram, cells)
    buckets = max(strings // BUCKET_STRINGS, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = shared_table(_marks_of_buckets(_packed(rows, common, hot, window, gram, cells, buckets), window), "passages-found")
    marks = found.where("marks is not null").select("doc_id", "text_key", "start", "marks")
    return marks.unionByName(_marks_of_hot(found.where("marks is null"))) if hot else marks


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def kept_words(words: list[bytes], marks: list | None, window: int) -> list[bytes]:
    """The words that no marked window covers."""
    if not marks:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for m in marks:
        bits = m["marks"]
        for i in range(RUN):
            if bits >> i & 1:
                change[m["start"] + i] += 1
                change[m["start"] + i + window] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, cells: int = CELLS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256) of every row: its words not covered by a window that a smaller id has too.

    Words are runs of anything but space and \\x09 to \\x0D; ``kept`` joins them by one space. Null and
    empty texts have no words. Rows of one id count as one document; repeated rows get the same result each. Rows without an id keep
    all words and remove none. An empty table gives an empty result; other columns are ignored. Ids are integers.
    """
    marks = repeated_windows(docs, id_col, text_col, window, gram, cells)
    per_text = marks.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "marks")).alias("marks"))  # bounded by the text
    schema = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, kept, digest = [], [], [], []
            for text, own in zip(b.column("text"), b.column("marks")):
                words = (text.as_py() or "").encode().split()
                left = kept_words(words, own.as_py(), window)
                n.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left))
                digest.append(hashlib.sha256(kept[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                                              pa.array(kept, pa.binary()).cast(pa.string()), pa.array(digest, pa.string())],
                                             ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    rows = _rows(docs, id_col, text_col)
    named = rows.where("doc_id is not null").join(per_text, ["doc_id", "text_key"], "left").select("doc_id", "text", "marks")
    nameless = rows.where("doc_id is null").select("doc_id", "text", F.lit(None).cast(named.schema["marks"].dataType).alias("marks"))
    return named.unionByName(nameless).mapInArrow(run, schema)
