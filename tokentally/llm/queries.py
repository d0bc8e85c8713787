"""The registered queries of this subpackage: ``opN_<name>`` -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentally.llm import (ann, byte_bpe, exact_topk, filter_audit, langid, packing, quality, secret_scan, simhash, spelling,
                            substring_dedup, token_counts, url_filter)
from tokentally.llm.common import crc_fold, read_table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(read_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(read_table(spark, sf_dir, "documents"), derive={"ids_crc32": F.crc32("ids")}, keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(read_table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def _joined(spans):
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = secret_scan.scan_secrets(docs, secret_scan.fit_secrets(docs))
    spans = F.col("secret_spans")
    of_kind = lambda k: F.filter(spans, lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in secret_scan.BASE_KINDS]
    base = _joined(F.filter(spans, lambda s: s["kind"] != secret_scan.ADDED_KIND))
    return scanned.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), _joined(spans).alias("spans"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.exact_topk(read_table(spark, sf_dir, "embeddings"))


def op6_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.decode(byte_bpe.encode(read_table(spark, sf_dir, "documents")))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_approximate_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    named = langid.predict_languages(docs.select("doc_id", "text"), langid.fit_languages(docs))
    return named.select("doc_id", (crc_fold("doc_id", langid.FOLDS) == langid.HELD_OUT).alias("held_out"), "lang_pred",
                        F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, read_table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (crc_fold("doc_id", quality.FOLDS) == quality.HELD_OUT).alias("held_out"),
                         F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents"))


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated(read_table(spark, sf_dir, "documents")).drop("kept")


LLM_QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_best_fit_packing, op3_url_filter, op4_secret_scan, op5_exact_topk, op6_byte_level_bpe,
                                       op7_approximate_nearest, op8_token_counts, op9_language_id, op10_quality_classifier,
                                       op11_spelling_variants, op12_filter_interaction_audit, op13_substring_dedup)}
EXACT_TOPK_SQL = """
WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

# The models of op3 in SQL: n-gram counts, interpolated log-probabilities level by level, weights, calibration.
_LEVEL = """l{k} AS (SELECT c.g, c.na, c.nb,
  ln((c.na + 2.0 * exp(t.la)) / (h.na + 2.0)) AS la, ln((c.nb + 2.0 * exp(t.lb)) / (h.nb + 2.0)) AS lb,
  ln((c.na + 2.0 * exp(t.la)) / (h.na + 2.0)) - t.la - ln(2.0 / (h.na + 2.0)) AS ga,
  ln((c.nb + 2.0 * exp(t.lb)) / (h.nb + 2.0)) - t.lb - ln(2.0 / (h.nb + 2.0)) AS gb
  FROM c JOIN c h ON h.g = substring(c.g, 1, {k} - 1) JOIN l{j} t ON t.g = substring(c.g, 2, {k} - 1) WHERE length(c.g) = {k})"""
URL_FILTER_SQL = """
WITH r AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id, url, translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(url, '://([^/?#]*)([^?#]*)', 2) AS path FROM r),
f AS (SELECT *, CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                     WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                     WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                     WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p),
u AS (SELECT url, count(*) AS n, any_value(rule) AS rule, any_value(rule) IN ('example.net/en/', 'org/fr/') AS ok,
             substring(md5(url), 1, 1) IN ('0', '1', '2') AS held FROM f GROUP BY url),
e AS (SELECT url, n, ok, chr(2) || url || chr(3) AS t, unnest(range(1, length(url) + 3)) AS i FROM u WHERE rule IS NOT NULL AND NOT held),
ek AS (SELECT *, unnest([1, 2, 3, 4]) AS k FROM e),
c AS (SELECT substring(t, i, k) AS g, coalesce(sum(n) FILTER (ok), 0)::DOUBLE AS na, coalesce(sum(n) FILTER (NOT ok), 0)::DOUBLE AS nb
      FROM ek WHERE i + k <= length(t) + 1 GROUP BY 1 HAVING na >= 2 OR nb >= 2),
tot AS (SELECT coalesce(sum(n * (length(url) + 2)) FILTER (ok), 0)::DOUBLE AS a, coalesce(sum(n * (length(url) + 2)) FILTER (NOT ok), 0)::DOUBLE AS b
        FROM u WHERE rule IS NOT NULL AND NOT held),
l1 AS (SELECT g, na, nb, ln((na + 2.0 / 256) / (a + 2.0)) AS la, ln((nb + 2.0 / 256) / (b + 2.0)) AS lb,
              ln((na + 2.0 / 256) / (a + 2.0)) - ln(2.0 / 256 / (a + 2.0)) AS ga, ln((nb + 2.0 / 256) / (b + 2.0)) - ln(2.0 / 256 / (b + 2.0)) AS gb
       FROM c, tot WHERE length(g) = 1),
""" + ",\n".join(_LEVEL.format(k=k, j=k - 1) for k in (2, 3, 4)) + """,
l AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3 UNION ALL SELECT * FROM l4),
w AS (SELECT g, CASE WHEN na >= 2 THEN ga + CASE WHEN length(g) < 4 AND NOT ends_with(g, chr(3)) THEN ln(2.0 / (na + 2.0)) ELSE 0 END ELSE 0 END
              - CASE WHEN nb >= 2 THEN gb + CASE WHEN length(g) < 4 AND NOT ends_with(g, chr(3)) THEN ln(2.0 / (nb + 2.0)) ELSE 0 END ELSE 0 END AS w FROM l),
x AS (SELECT url, chr(2) || url || chr(3) AS t, unnest(range(1, length(url) + 3)) AS i FROM u WHERE rule IS NULL OR held),
xk AS (SELECT *, unnest([1, 2, 3, 4]) AS k FROM x),
sums AS (SELECT xk.url, sum(w.w) AS w FROM xk JOIN w ON w.g = substring(xk.t, xk.i, xk.k) WHERE xk.i + xk.k <= length(xk.t) + 1 GROUP BY 1),
s AS (SELECT u.*, coalesce(sums.w, 0) / (length(u.url) + 2) + ln((tot.b + 2.0) / (tot.a + 2.0)) AS score
      FROM u LEFT JOIN sums USING (url), tot WHERE rule IS NULL OR held),
b AS (SELECT greatest(-1000, least(1000, floor(score / 0.02)))::INT AS bin, coalesce(sum(n) FILTER (ok), 0) AS na, coalesce(sum(n) FILTER (NOT ok), 0) AS nb
      FROM s WHERE rule IS NOT NULL GROUP BY 1),
g AS (SELECT bin, sum(na) OVER (ORDER BY bin DESC) / greatest(sum(na) OVER (), 1) - sum(nb) OVER (ORDER BY bin DESC) / greatest(sum(nb) OVER (), 1) AS gain FROM b),
th AS (SELECT coalesce((SELECT bin * 0.02 FROM g ORDER BY round(gain, 9) DESC, abs(bin), bin LIMIT 1), 0.0) AS th)
SELECT f.page_id, f.host, f.path, f.rule,
       CASE WHEN f.rule IS NOT NULL THEN CASE WHEN f.rule IN ('example.net/en/', 'org/fr/') THEN 'allow' ELSE 'block' END
            WHEN s.score >= th.th THEN 'allow' ELSE 'block' END AS verdict
FROM f LEFT JOIN s ON s.url = f.url AND s.rule IS NULL, th
"""

_WORDS = r"[x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> '']"

# Every document is taken through every order of the filters; no subset counts.
FILTER_AUDIT_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, """ + _WORDS + r""" AS w FROM documents),
f AS (SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
                            100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'),
                            coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails FROM t),
b AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN b USING (doc_id)),
one AS (SELECT unnest([1, 2, 3, 4, 5]) AS x),
o AS (SELECT [p.x, q.x, r.x, s.x, t.x] AS ord FROM one p, one q, one r, one s, one t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
k AS (SELECT ord, unnest([1, 2, 3, 4, 5]) AS step FROM o),
v AS (SELECT part, ord, step, ord[step] AS own, fails[ord[step]] AS bad, good, toxic,
             len([i FOR i IN ord[1:step - 1] IF fails[i]]) > 0 AS gone, len([i FOR i IN fails IF i]) = 1 AS alone FROM d, k),
s AS (SELECT part, ord, step, own, count(*) FILTER (NOT gone AND NOT bad) AS kept, count(*) FILTER (NOT gone AND bad) AS removed,
             count(*) FILTER (gone AND bad) AS redundant, count(*) FILTER (bad AND alone) AS unique_fails,
             count(*) FILTER (NOT gone AND bad AND good) AS good_lost, count(*) FILTER (NOT gone AND bad AND toxic) AS toxic_lost FROM v GROUP BY ALL)
SELECT part, array_to_string([substring('ABCDE', i, 1) FOR i IN ord], '') AS filter_order, step, substring('ABCDE', own, 1) AS "filter",
       kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM s
"""

SUBSTRING_DEDUP_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, """ + _WORDS + r""" AS w FROM documents),
x AS (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
y AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM x),
m AS (SELECT s, min(doc_id) AS first FROM y GROUP BY s),
gone AS (SELECT DISTINCT r, i + k AS i FROM (SELECT r, i, unnest(range(13)) AS k FROM y JOIN m USING (s) WHERE doc_id > first)),
p AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
q AS (SELECT p.r, string_agg(x, ' ' ORDER BY p.i) FILTER (gone.i IS NULL) AS kept, count(gone.i) AS n FROM p LEFT JOIN gone USING (r, i) GROUP BY p.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN q USING (r)
"""

LLM_SQL: dict[str, str] = {"op3_url_filter": URL_FILTER_SQL, "op5_exact_topk": EXACT_TOPK_SQL,
                           "op12_filter_interaction_audit": FILTER_AUDIT_SQL, "op13_substring_dedup": SUBSTRING_DEDUP_SQL}
