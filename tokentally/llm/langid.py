"""Language identification by compression with per-language zstandard dictionaries.

Each language's dictionary is raw content: an equal share of every normalised text of a bounded sample of
its labelled documents; what short texts leave of theirs goes to the others. A text is normalised (lower case, ASCII characters that are no letters to single
spaces), cut into blocks, and every block is compressed with every dictionary; the language with
the smallest total wins, ties go to the language with more labelled documents. When the
runner-up is nearly as small, the prediction stands but the document is marked rejected. How near
that is comes from labelled documents that the dictionaries did not learn from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokentally.llm.common import crc_fold, small_batches

SAMPLE_DOCS = 400     # distinct labelled texts a language's dictionary is made of at most
SAMPLE_CHARS = 2_000  # of each sampled document, from a place that its hash chooses
DICT_BYTES = 120_000  # of all of them, dealt out evenly
MAX_LANGUAGES = 1_000  # distinct labels; the dictionaries of more would not fit a worker
BLOCK = 1_024         # bytes compressed at once
LEVEL = 6
# The runner-up's extra size, as a share of the winner's, below which a document is rejected: MARGIN_SHARE of
# the MARGIN_QUANTILE quantile that rightly named labelled documents have, kept in MARGIN_RANGE.
MARGIN_QUANTILE, MARGIN_SHARE, MARGIN_RANGE = 0.02, 0.25, (0.01, 0.05)
LEFT_OUT = 5          # one in so many sampled documents, by hash, measures margins
MARGIN_DOCS = 2_000   # documents measured at most, over all languages
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
COLUMNS = ("lang_pred", "lang_score", "lang_rejected")

_SPACED = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def normalised(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_SPACED).split())


class Dictionaries(dict):
    """Language -> dictionary, with the margin at or under which a prediction is rejected."""

    margin: float = MARGIN_RANGE[0]


def learned_margin(parts: dict[str, list[tuple[int, bytes]]]) -> float:
    """The margin from (hash, normalised text) of each language: dictionaries of the other texts measure one in ``LEFT_OUT``."""
    coders = Compressors({lang: _content(t for h, t in own if h % LEFT_OUT) for lang, own in parts.items()})
    left_out = sorted((h, lang, t) for lang, own in parts.items() for h, t in own if h % LEFT_OUT == 0)[:MARGIN_DOCS]
    found = [(lang, *coders.sizes(t)) for _, lang, t in left_out if t]
    margins = [margin for lang, best, _, margin in found if coders.languages[best] == lang and margin < np.inf]
    return float(np.clip(MARGIN_SHARE * np.quantile(margins, MARGIN_QUANTILE), *MARGIN_RANGE)) if margins else MARGIN_RANGE[0]


def _content(texts) -> bytes:
    """The texts, joined, each cut to the largest equal share with which all fit into ``DICT_BYTES``."""
    texts = list(texts)
    left, share = DICT_BYTES - len(texts), DICT_BYTES
    for i, size in enumerate(sorted(map(len, texts))):
        if size * (len(texts) - i) > left:
            share = left // (len(texts) - i)
            break
        left -= size
    return b" ".join(t[:share] for t in texts)


def fit_languages(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, sample_docs: int = SAMPLE_DOCS) -> Dictionaries:
    """Language -> dictionary, most frequent language first, learned outside the held-out fold.

    One count over the labels, one pass that picks each language's ``sample_docs`` smallest hashes of
    distinct texts, and one that fetches those texts; copies weigh nothing in the choice. Rows without text
    or language are not learned from. More than ``MAX_LANGUAGES`` labels raise ValueError.
    """
    learn = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")) \
        .where(crc_fold("doc_id", folds) != held_out).where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} distinct language labels")
    if not counts:
        return Dictionaries()
    places = F.greatest(F.length("text") - F.lit(SAMPLE_CHARS - 1), F.lit(1)).cast("long")
    block = F.substring("text", (F.pmod(F.xxhash64("text", F.lit(1)), places) + 1).cast("int"), F.lit(SAMPLE_CHARS))
    hashed = learn.select("lang", F.xxhash64("text").alias("h"), block.alias("t"))
    picked = hashed.select("lang", "h").distinct()
    for groups in (512, 64, 8, 1):  # a hot language is cut down group by group, each to sample_docs
        nth = F.row_number().over(Window.partitionBy("lang", F.pmod("h", F.lit(groups))).orderBy("h"))
        picked = picked.withColumn("nth", nth).where(F.col("nth") <= sample_docs).select("lang", "h")
    sample = hashed.join(F.broadcast(picked), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.min("t").alias("t"))
    parts: dict[str, list[tuple[int, bytes]]] = {lang: [] for lang in sorted(counts, key=lambda x: (-counts[x], x))}
    for r in sample.orderBy("lang", "h").collect():
        parts[r["lang"]].append((r["h"], normalised(r["t"])))
    model = Dictionaries({lang: _content(t for _, t in own) for lang, own in parts.items()})
    model.margin = learned_margin(parts)
    return model


class Compressors:
    """A worker's compressors, one per language."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.languages = list(dictionaries)
        self.margin = getattr(dictionaries, "margin", MARGIN_RANGE[0])
        self.coders = []
        for content in dictionaries.values():
            options = dict(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
            if len(content) >= 8:
                own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                own.precompute_compress(level=LEVEL)
                options["dict_data"] = own
            self.coders.append(zstandard.ZstdCompressor(**options))

    def sizes(self, norm: bytes) -> tuple[int, np.ndarray, float]:
        """(winner, compressed sizes, margin) of a normalised text; the margin is infinite with one language."""
        sizes = np.zeros(len(self.coders))
        for lo in range(0, len(norm), BLOCK):
            block = norm[lo:lo + BLOCK]
            sizes += [len(c.compress(block)) for c in self.coders]
        best = int(sizes.argmin())
        rest = np.delete(sizes, best)
        return best, sizes, float((rest.min() - sizes[best]) / sizes[best]) if len(rest) else np.inf

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score 0 to 1, rejected); no text, no letters or nothing learned: ``und``, 0, rejected."""
        if not text or not self.coders or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        best, sizes, margin = self.sizes(normalised(text))
        score = 1 / float(np.exp2(np.maximum((sizes[best] - sizes) / 2, -60)).sum())
        return self.languages[best], score, margin <= self.margin


def predict_languages(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, lang_score and lang_rejected (replacing such columns); whole texts.

    Null and empty texts and texts without a letter get ``und``, score 0, rejected; so does every text if nothing was
    learned. Rows, repeated ones too, and other columns are kept; an empty table gives an empty result.
    """
    added = {"lang_pred": T.StringType(), "lang_score": T.DoubleType(), "lang_rejected": T.BooleanType()}
    kept = [f for f in docs.schema if f.name not in added]
    schema = T.StructType(kept + [T.StructField(n, t) for n, t in added.items()])
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # DICT_BYTES a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = Compressors(shared.value)
        for b in batches:
            found = [coders.classify(t) for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(f.name) for f in kept], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()),
                 pa.array([x[2] for x in found], pa.bool_())], [f.name for f in schema])

    return small_batches(docs).select(*[F.col(f.name) for f in kept]).mapInArrow(run, schema)
