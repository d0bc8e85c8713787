"""URL filter: host and path rules, and a character language-model ratio for the rest.

Two smoothed variable-order Markov models over characters, one of the urls that the rules accept and
one of those they reject, are plain DataFrame aggregates (no Python runs on the executors). With
interpolated smoothing, P(c|h) = (n(hc) + L P(c|h')) / (n(h) + L), a url's log-likelihood is a
sum over its character n-grams: each n-gram of the model contributes its gain over the next
shorter one, and each context the log of its back-off mass. So the difference of both models is one weight per n-gram,
and scoring is one join and one sum. Rare n-grams are pruned; what is kept is closed under suffixes. The
difference per character is calibrated on labelled urls that the models have not seen: the
threshold is the bin edge with the best balanced accuracy.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokentally.llm.common import checkpointed

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
LONGEST = 4          # characters of an n-gram: contexts of up to three
SMOOTHING = 2.0      # L
MIN_COUNT = 2        # n-grams seen less often in a class are pruned from its model
BIN = 0.02           # width of a calibration bin, in nats per character
BIN_MAX = 1_000      # scores beyond are counted in the end bins
HELD_OUT = "012"     # first hex digits of a url's md5 that are kept for calibration
BROADCAST_ROWS = 300_000  # n-grams of the model; more are joined by shuffle
_FIRST, _LAST = "\u0002", "\u0003"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)([^?#]*)", 2)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits (its host or a subdomain, its path's beginning), else null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for verdict, r in rules:
        out = F.when(rule == r, F.lit(verdict)).otherwise(out)
    return out


def _grams(urls: DataFrame, longest: int) -> DataFrame:
    """(url's columns, g): every n-gram of each url, with one first and one last symbol around it."""
    t = F.concat(F.lit(_FIRST), F.col("url"), F.lit(_LAST))
    starts = F.sequence(F.lit(1), F.length(t))

    def of_length(k: int) -> Column:
        return F.transform(F.slice(starts, 1, F.greatest(F.length(t) - (k - 1), F.lit(0))), lambda i: F.substring(t, i, F.lit(k)))

    return urls.select(*urls.columns, F.explode(F.concat(*map(of_length, range(1, longest + 1)))).alias("g"))


def fit_urls(urls: DataFrame, longest: int = LONGEST, smoothing: float = SMOOTHING, min_count: int = MIN_COUNT) -> tuple[DataFrame, float]:
    """(url, n, verdict) of labelled urls -> ((g, w) weights accepted minus rejected, weight of any character)."""
    kinds = ("allow", "block")
    counts = checkpointed(_grams(urls, longest).groupBy("g").agg(
        *[F.sum(F.when(F.col("verdict") == k, F.col("n")).otherwise(0)).alias(f"n_{k}") for k in kinds])
        .where(" OR ".join(f"n_{k} >= {min_count}" for k in kinds)))
    single = F.length("g") == 1
    totals = urls.agg(*[F.coalesce(F.sum(F.when(F.col("verdict") == k, F.col("n") * (F.length("url") + 2))), F.lit(0)).alias(k) for k in kinds]).first()
    back = {k: F.log(F.lit(smoothing) / (F.col(f"n_{k}") + smoothing)) for k in kinds}
    level = counts.where(single)
    for k in kinds:
        total = float(totals[k])
        level = level.withColumn(f"lp_{k}", F.log((F.col(f"n_{k}") + smoothing / 256) / (total + smoothing))) \
            .withColumn(f"gain_{k}", F.col(f"lp_{k}") - F.log(F.lit(smoothing / 256 / (total + smoothing))))
    weights = []
    for size in range(1, longest + 1):
        if size > 1:
            heads = counts.where(F.length("g") == size - 1).select(F.col("g").alias("head"), *[F.col(f"n_{k}").alias(f"h_{k}") for k in kinds])
            tails = level.select(F.col("g").alias("tail"), *[F.col(f"lp_{k}").alias(f"t_{k}") for k in kinds])
            level = counts.where(F.length("g") == size) \
                .withColumns({"head": F.substring("g", 1, size - 1), "tail": F.substring("g", 2, size - 1)}).join(heads, "head").join(tails, "tail")
            for k in kinds:
                mass = F.col(f"h_{k}") + smoothing
                level = level.withColumn(f"lp_{k}", F.log((F.col(f"n_{k}") + smoothing * F.exp(f"t_{k}")) / mass)) \
                    .withColumn(f"gain_{k}", F.col(f"lp_{k}") - F.col(f"t_{k}") - F.log(smoothing / mass))
            level = level.select("g", *[f"{c}_{k}" for k in kinds for c in ("n", "lp", "gain")])
        level = checkpointed(level)
        goes_on = ~F.col("g").endswith(_LAST) & F.lit(size < longest)
        each = {k: F.when(F.col(f"n_{k}") >= min_count, F.col(f"gain_{k}") + F.when(goes_on, back[k]).otherwise(0.0)).otherwise(0.0) for k in kinds}
        weights.append(level.select("g", (each["allow"] - each["block"]).alias("w")))
    model = weights[0]
    for w in weights[1:]:
        model = model.unionByName(w)
    any_char = F.log(F.lit((float(totals["block"]) + smoothing) / (float(totals["allow"]) + smoothing)))
    return checkpointed(model), float(urls.sparkSession.range(1).select(any_char).first()[0])


def score_urls(urls: DataFrame, model: DataFrame, any_char: float, longest: int = LONGEST) -> DataFrame:
    """``urls`` (id, url, ...) with their score: log-likelihood accepted minus rejected, per character. N-grams travel with ids, not urls."""
    if model.count() <= BROADCAST_ROWS:
        model = F.broadcast(model)
    sums = _grams(urls.select("id", "url"), longest).select("id", "g").join(model, "g").groupBy("id").agg(F.sum("w").alias("w"))
    return urls.join(sums, "id", "left") \
        .withColumn("score", F.coalesce("w", F.lit(0.0)) / (F.length("url") + 2) + any_char).drop("w")


def calibrate(scored: DataFrame) -> float:
    """Threshold with the best balanced accuracy on (score, n, verdict): the edge of a bin; 0 without labels."""
    at = F.greatest(F.lit(-BIN_MAX), F.least(F.lit(BIN_MAX), F.floor(F.col("score") / BIN)))
    bins = scored.groupBy(at.cast("int").alias("bin")).agg(*[F.sum(F.when(F.col("verdict") == k, F.col("n")).otherwise(0)).alias(k) for k in ("allow", "block")])
    every, down = Window.partitionBy(), Window.orderBy(F.desc("bin"))  # at most 2 * BIN_MAX + 1 rows
    share = lambda k: F.sum(k).over(down) / F.greatest(F.sum(k).over(every), F.lit(1))
    best = bins.select("bin", (share("allow") - share("block")).alias("gain")).orderBy(F.desc(F.round("gain", 9)), F.abs("bin"), "bin").first()
    return best["bin"] * BIN if best else 0.0


def filter_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row.

    The verdict is that of the longest rule that fits, else the method's; ``score`` is null where a rule decides. Null urls
    count as empty (host and path empty). Repeated rows and rows without an id are kept; an empty table gives an
    empty result; without labelled urls the method allows. Other columns are ignored.
    """
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"))
    distinct = checkpointed(
        rows.groupBy("url").agg(F.count(F.lit(1)).alias("n"))
        .withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
        .withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("verdict", verdict_of(F.col("rule"), rules))
        # few bytes make many n-grams: dealt out again, one partition of urls a task
        .repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))).withColumn("id", F.monotonically_increasing_id()))
    held_out = F.md5(F.col("url").cast("binary")).substr(1, 1).isin(*HELD_OUT)
    model, any_char = fit_urls(distinct.where(F.col("rule").isNotNull() & ~held_out).select("url", "n", "verdict"))
    scored = checkpointed(score_urls(distinct.where(F.col("rule").isNull() | held_out).select("id", "url", "n", "verdict"), model, any_char))
    threshold = calibrate(scored.where("verdict is not null"))
    judged = scored.where("verdict is null").select(
        F.col("url"), "score", F.when(F.col("score") >= threshold, "allow").otherwise("block").alias("model_verdict"))
    return rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}) \
        .withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).join(judged, "url", "left") \
        .select("page_id", "host", "path", "rule", F.coalesce(verdict_of(F.col("rule"), rules), "model_verdict").alias("verdict"), "score")
