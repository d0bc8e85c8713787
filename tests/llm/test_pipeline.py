import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline as C
from tokentally.llm import langid, packing, quality, secret_scan, simhash
from tokentally.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.001"


def test_every_stage_does_what_its_operator_says(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9_001, None, None, None, 0), (9_002, "", "en", "s", 0), (None, "Of the words and the on no id in here.", "en", "s", 3),
                                   (9_003, "12 34", None, None, 5)], docs.schema)
    docs = docs.unionByName(extra).unionByName(docs.where("doc_id = 3")).withColumn("lang_pred", F.lit(7)).withColumn("secret_spans", F.lit("x"))
    kept = docs
    want = {r.doc_id: r for r in docs.collect()}
    for name, stage in C.STAGES[:-1]:
        before = {r.doc_id: r for r in kept.collect()}
        kept = C.shared_table(stage(spark, kept, SF), "test-stage")
        assert kept.columns == docs.columns
        after = {r.doc_id: r for r in kept.collect()}
        assert set(after) <= set(before)
        if name == "language_id":
            coders = langid.Compressors(langid.fit_languages(docs))
            want = {d: r for d, r in before.items() if not coders.classify(r.text)[2]}
            assert not {9_001, 9_002, 9_003} & set(after)
        elif name == "quality_classifier":
            model = quality.fit_quality(spark.createDataFrame(list(before.values()), docs.schema), spark.read.parquet(f"{SF}/labels.parquet"))
            want = {d: r for d, r in before.items() if model.scores(np.array([quality.statistics(r.text)]))[0] >= 0.7}
            assert len(after) > 0.7 * len(before)
        elif name == "simhash_near_dedup":
            ids = sorted(d for d in before if d is not None)
            fp = dict(zip(ids, map(int, simhash.fingerprints([before[d].text for d in ids]))))
            group = {d: d for d in ids}
            for _ in ids:
                new = {d: min(group[e] for e in ids if (fp[d] ^ fp[e]).bit_count() <= 4) for d in ids}
                if new == group:
                    break
                group = new
            want = {d: r for d, r in before.items() if d is None or group[d] == d}
            assert kept.count() == len(after)
        elif name == "secret_scan":
            model = secret_scan.fit_secrets(spark.createDataFrame(list(before.values()), docs.schema))
            assert set(after) == set(before)
            for d, r in after.items():
                spans = secret_scan.spans_of(before[d].text, model)
                assert r.text == secret_scan.redacted(before[d].text, spans, C.SECRET_MARK)
                assert not re.search("[0-9a-f]{32}|AKIA[A-Z0-9]{12}", r.text)
                assert r.n_chars == (len(r.text) if spans else before[d].n_chars)
            continue
        assert after == want, name


def test_run_packs_what_the_stages_kept(spark):
    packed = C.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        docs = C.shared_table(stage(spark, docs, SF), "test-run")
    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = {r.doc_id: tok.encode(r.text, add_special_tokens=False).ids + [2] for r in docs.collect()}
    got = defaultdict(list)
    for r in sorted(packed, key=lambda r: (r.doc_id, r.piece)):
        got[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert dict(got) == want


def test_entry_registers_every_query_and_they_run(spark):
    names = E.queries()
    assert set(LLM_QUERIES) <= set(names) and "pipeline" in names
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in LLM_QUERIES] == list(range(1, 14))
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name, query in LLM_QUERIES.items():
        n = query(spark, SF).count()
        assert n == docs if name.split("_")[0] in ("op1", "op4", "op6", "op8", "op9", "op10", "op13") else n > 0


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
