"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints at most ``radius`` bits apart share at least one variant within
``radius // 2`` bits of each. Every distinct fingerprint emits all such variants (2,081 at
64 bits and radius 4); fingerprints that meet on a variant are linked.

The shuffle is on variants, but a variant does not travel: the 64 bits are dealt into
``m`` groups, and a variant's key (cell) is the parity of each group. A fingerprint's variants
fall into few cells (37 for m = 8), so only the 8-byte fingerprint is sent, once per cell, and
the cell's task makes the variants that belong there. Each variant is made in exactly one
task. ``m`` grows with the number of distinct fingerprints, so a cell's work stays bounded;
the result does not depend on it. Copies collapse before the shuffle, and the parities spread
one ball of near copies over all its cells. A cell with more variants than fit in memory is
worked off in rounds by a hash of the variant.

All fingerprints that meet on one variant are within ``radius`` of each other, so a star per
variant keeps every link's component; no group is expanded into all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokentally.llm.common import checkpointed, small_batches
from tokentally.llm.graph import components
from tokentally.llm.xxh import xxh64_ranges

BITS = 64
SEED = 42
SHINGLE = 4
RADIUS = 4
ROUND_VARIANTS = 4_000_000  # variants one task holds at once
_GROUP_BYTES = 4_000_000    # text hashed at once in a task


def fingerprints(texts: list, shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of each text (null: empty) as unsigned 64-bit integers.

    A-Z is lower-cased, words are runs of bytes other than space and \\t-\\r, shingles are
    ``shingle`` words joined by spaces, repeats included; fewer words make one shingle, none
    give fingerprint zero. A bit is set if it is set in over half the shingles' XXH64.
    """
    out = np.zeros(len(texts), np.uint64)
    group, size = [], 0
    for i, t in enumerate(texts):
        if not t:
            continue
        words = b" ".join(t.encode("utf-8", "surrogatepass").lower().split())
        if words:
            group.append((i, words))
            size += len(words)
        if size >= _GROUP_BYTES:
            _hash_group(group, shingle, out)
            group, size = [], 0
    _hash_group(group, shingle, out)
    return out


def _hash_group(group, shingle, out):
    if not group:
        return
    buf = b"\n".join(w for _, w in group)
    u8 = np.frombuffer(buf, np.uint8)
    gaps = np.flatnonzero((u8 == 0x20) | (u8 == 0x0A))
    start = np.r_[0, gaps + 1]
    end = np.r_[gaps, len(u8)]
    doc = np.r_[0, np.cumsum(u8[gaps] == 0x0A)]
    counts = np.bincount(doc, minlength=len(group))
    first = np.r_[0, np.cumsum(counts)[:-1]]
    k = np.arange(len(start))
    head = k - first[doc]
    n_sh = np.maximum(counts - shingle + 1, 1)  # short documents: one shingle
    is_start = head < n_sh[doc]
    s = k[is_start]
    last = np.minimum(s + shingle - 1, first[doc[s]] + counts[doc[s]] - 1)
    h = xxh64_ranges(buf, start[s], end[last] - start[s], SEED)
    edges = np.r_[0, np.cumsum(n_sh)]
    step = 1 << 17  # hashes whose bits are unpacked at once
    ones = np.zeros((len(group), BITS), np.int64)
    for lo in range(0, len(h), step):
        hi = min(lo + step, len(h))
        bits = np.unpackbits(h[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        a = np.searchsorted(edges, lo, "right") - 1
        b = np.searchsorted(edges, hi, "left")
        cuts = np.maximum(edges[a:b], lo) - lo
        ones[a:b] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
    set_bits = (2 * ones > n_sh[:, None]).astype(np.uint8)
    fp = np.packbits(set_bits, axis=1, bitorder="little").view("<u8").ravel()
    out[[i for i, _ in group]] = fp


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                     text_hash: bool = False) -> DataFrame:
    """(id, fingerprint long) for each row, with ``text_hash`` that too, in input order; null texts count as empty."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fingerprint", T.LongType())])
    hashes = [_text_hash(text_col).alias("text_hash")] if text_hash else []
    if text_hash:
        schema = schema.add("text_hash", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints(b.column(1).to_pylist(), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *b.columns[2:]], schema.names)

    return small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *hashes).mapInArrow(run, schema)


def _masks(radius: int, m: int) -> dict[int, np.ndarray]:
    """Flip masks of up to ``radius`` bits by the parity pattern they cause."""
    by: dict[int, list] = {}
    for r in range(radius + 1):
        for bits in combinations(range(BITS), r):
            pat = 0
            for x in bits:
                pat ^= 1 << (x % m)
            by.setdefault(pat, []).append(sum(1 << x for x in bits))
    return {p: np.array(v, np.uint64) for p, v in by.items()}


def _parity(fp, m: int):
    """Cell of a fingerprint: bit g is the parity of the bits dealt to group g (a column)."""
    cell = F.lit(0).cast("long")
    for g in range(m):
        mask = sum(1 << x for x in range(g, BITS, m))
        mask = mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask
        cell = cell.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseAND(F.lit(mask))) % 2, g).cast("long"))
    return cell


def _parity_np(fp: np.ndarray, m: int) -> np.ndarray:
    cell = np.zeros(len(fp), np.int64)
    for g in range(m):
        mask = np.uint64(sum(1 << x for x in range(g, BITS, m)))
        cell |= (np.bitwise_count(fp & mask) & 1).astype(np.int64) << g
    return cell


def cell_links(fp: np.ndarray, cell: int, m: int, half: int, masks: dict, limit: int = ROUND_VARIANTS) -> list[tuple[int, int]]:
    """Links between the fingerprints that meet on a variant of this cell (a spanning forest)."""
    fp = np.unique(fp)
    pattern = _parity_np(fp, m) ^ cell
    total = sum(int((pattern == p).sum()) * len(v) for p, v in masks.items())
    rounds = max(1, math.ceil(total / limit))
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    links = []
    mix = np.uint64(0x9E3779B97F4A7C15)
    for r in range(rounds):
        variants, owners = [], []
        for p, v in masks.items():
            own = np.flatnonzero(pattern == p)
            block = max(1, limit // len(v))
            for lo in range(0, len(own), block):
                o = own[lo:lo + block]
                x = (fp[o, None] ^ v[None, :]).ravel()
                o = np.repeat(o.astype(np.int32), len(v))
                if rounds > 1:
                    with np.errstate(over="ignore"):
                        mine = ((x * mix) >> np.uint64(33)) % np.uint64(rounds) == r
                    x, o = x[mine], o[mine]
                variants.append(x)
                owners.append(o)
        if not variants:
            continue
        x, o = np.concatenate(variants), np.concatenate(owners)
        ordered = np.sort(x)
        met = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(met):
            continue
        with np.errstate(over="ignore"):
            bitmap = np.zeros(1 << 20, bool)
            bitmap[((met * mix) >> np.uint64(44)).astype(np.int64)] = True
            maybe = bitmap[((x * mix) >> np.uint64(44)).astype(np.int64)]
        x, o = x[maybe], o[maybe]
        hit = met[np.minimum(np.searchsorted(met, x), len(met) - 1)] == x
        x, o = x[hit], o[hit]
        order = np.lexsort((o, x))
        x, o = x[order], o[order]
        head = np.r_[True, x[1:] != x[:-1]]
        lead = o[np.flatnonzero(head)[np.cumsum(head) - 1]]
        pairs = np.unique(np.stack([lead, o], 1)[lead != o], axis=0)
        for a, b in pairs.tolist():
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                links.append((a, b))
    signed = fp.view(np.int64)
    return [(int(signed[a]), int(signed[b])) for a, b in links]


def near_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct ``fingerprint`` rows -> links (a, b), verified to be within ``radius`` bits.

    The links connect exactly the fingerprints that all pairs within ``radius`` would connect.
    """
    if radius < 0 or radius % 2:
        raise ValueError("radius must be even: variants reach half of it")
    half = radius // 2
    n = nodes.count()
    per = sum(math.comb(BITS, r) for r in range(half + 1))
    m = 8
    while m < 24 and n * per / 2 ** m > ROUND_VARIANTS:
        m += 2
    masks = _masks(half, m)
    cells = nodes.select("fingerprint", F.explode(F.transform(
        F.array(*[F.lit(p).cast("long") for p in sorted(masks)]),
        lambda p: p.bitwiseXOR(_parity(F.col("fingerprint"), m)))).alias("cell"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fingerprint"].to_numpy(np.int64).view(np.uint64)
        return pd.DataFrame(cell_links(fp, int(key[0]), m, half, masks), columns=["a", "b"], dtype="int64")

    links = cells.groupBy("cell").applyInPandas(run, "a long, b long")
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct() \
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Every row's (doc_id, fingerprint long, component_id).

    ``component_id`` is the smallest id reachable over links of at most ``radius`` bits,
    itself included. Null texts count as empty (fingerprint zero, linked like any other).
    Rows without an id get their component's smallest id, null if it has none. Repeated rows
    are kept. An empty table gives an empty result; other columns are ignored.
    """
    rows, named = _labelled(docs, id_col, text_col, shingle, radius)
    return rows.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def _labelled(docs, id_col, text_col, shingle, radius):
    """Rows (doc_id, fingerprint, text_hash), and each fingerprint's component_id and group, a number that no other component has."""
    rows = checkpointed(with_fingerprint(docs, id_col, text_col, shingle, text_hash=True))
    nodes = checkpointed(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("low")))
    labels = components(near_links(nodes.select("fingerprint"), radius))
    member = nodes.join(labels.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    lows = member.where("root is not null").groupBy("root").agg(F.min("low").alias("component"))
    named = checkpointed(member.join(lows, "root", "left")
                         .select("fingerprint", F.when(F.col("root").isNull(), F.col("low")).otherwise(F.col("component")).alias("component_id"),
                                 F.coalesce("root", "fingerprint").alias("group")))
    return rows, named


def keep_one_per_group(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each component: of those with its smallest id, the smallest (fingerprint, text hash), then by the other columns.

    A repeated id names no text: its rows count by their own components. Rows without an id cannot be named
    as copies of one with an id; one of each component stays beside it. Columns are unchanged.
    """
    rows, named = _labelled(docs, "doc_id", "text", shingle, radius)
    first = rows.join(named, "fingerprint").groupBy("group", F.col("doc_id").isNull().alias("no_id")) \
        .agg(F.min(F.struct("doc_id", "fingerprint", "text_hash")).alias("f"))
    free = "_" * max([1, *map(len, docs.columns)])  # longer than any name in the table
    keep_id, keep_hash, place = free + "id", free + "hash", free + "nth"
    keep = first.select(F.col("f.doc_id").alias(keep_id), F.col("f.text_hash").alias(keep_hash)).distinct()
    hashed = _text_hash("text")
    kept = docs.join(keep, F.col("doc_id").eqNullSafe(F.col(keep_id)) & (hashed == F.col(keep_hash)), "left_semi")
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(*others)) if others else F.lit(0)
    nth = F.row_number().over(Window.partitionBy("doc_id", hashed).orderBy(order))
    return kept.withColumn(place, nth).where(F.col(place) == 1).select(*docs.columns)


def _text_hash(text_col):
    """Of the text, null as empty: equal texts have equal fingerprints."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
