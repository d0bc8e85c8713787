import zlib

import numpy as np
import pytest
import zstandard

from tokentally.llm import langid as L
from tokentally.llm import quality as Q

SF = "/root/testdata/sf0.01"
EXTRA = "doc_id long, text string, lang string, source string, lang_pred int, stats string, y string"


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.fit_languages(docs)
    assert set(model) == {"en", "fr", "de", "es"} and list(model)[0] == "en"
    rows = L.predict_languages(docs, model).collect()
    held = [r for r in rows if fold(r.doc_id, 3) == 1]
    assert len(rows) == docs.count() and len(held) > 250
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.96
    assert np.mean([r.lang_rejected for r in rows]) < 0.02
    assert all(0 <= r.lang_score <= 1 for r in rows)


def brute_language(dictionaries, text):
    """The definition, with fresh compressors for every block."""
    norm = " ".join("".join(c if ord(c) > 127 or c.isalpha() else " " for c in text.lower()).split(" ")).encode()
    norm = b" ".join(norm.split())
    total = {}
    for lang, content in dictionaries.items():
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        c = zstandard.ZstdCompressor(level=L.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        total[lang] = sum(len(c.compress(norm[i:i + L.BLOCK])) for i in range(0, len(norm), L.BLOCK))
    return min(total, key=total.get)


def test_languages_equal_the_definition_and_odd_rows(spark):
    en, fr = "the quick brown fox and the lazy dog were there", "le petit chat est dans la maison avec une souris"
    rows = [(i, (en if i % 2 else fr) + f" {'x' * (i % 7)}", "en" if i % 2 else "fr", "s", 1, "a", "b") for i in range(80)]
    rows += [(100, None, "en", None, 1, "a", "b"), (101, "", "en", None, 1, "a", "b"), (102, "123 !!", None, None, 1, "a", "b"), (None, en, None, None, 1, "a", "b"),
             rows[3], (103, "The dog " * 40_000, "en", "s", 1, "a", "b")]
    docs = spark.createDataFrame(rows, EXTRA).repartition(3)
    model = L.fit_languages(docs)
    got = L.predict_languages(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.text and any(map(str.isalpha, r.text)):
            assert r.lang_pred == brute_language(model, r.text)
        else:
            assert (r.lang_pred, r.lang_score, r.lang_rejected) == ("und", 0.0, True)
    empty = docs.limit(0)
    assert L.fit_languages(empty) == {} and L.predict_languages(empty, {}).count() == 0
    assert L.predict_languages(docs.where("doc_id = 1"), {}).first().lang_pred == "und"


def test_quality_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = Q.fit_quality(docs, labels)
    assert (np.diff(model.calibrated) >= 0).all()
    scored = {r.doc_id: r for r in Q.score_quality(docs, model).collect()}
    held = [(r.quality, scored[r.doc_id]) for r in labels.collect() if fold(r.doc_id, 4) == 2]
    assert np.mean([y == s.quality_predicted for y, s in held]) > 0.9
    pos, neg = [s.quality_score for y, s in held if y], [s.quality_score for y, s in held if not y]
    assert np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]) > 0.93


def test_normal_equations_equal_one_matrix(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, Q.N_STATS))
    rows = [([float(v) for v in s], float(i % 2), i % 5) for i, s in enumerate(x)]
    train = spark.createDataFrame(rows, "stats array<double>, y double, inner int").repartition(7)
    model = Q.QualityModel(np.zeros(Q.N_STATS), np.ones(Q.N_STATS), *[np.zeros(0)] * 3)
    a, b = Q._normal_equations(train, model)
    z, y = model.features(x), np.arange(400) % 2
    assert np.allclose(a.sum(0), z.T @ z) and np.allclose(b.sum(0), z.T @ y)
    assert np.allclose(a[3], z[3::5].T @ z[3::5])


def test_random_features_approximate_the_kernel():
    model = Q.QualityModel(np.zeros(Q.N_STATS), np.ones(Q.N_STATS), *[np.zeros(0)] * 3)
    x = np.random.default_rng(2).normal(size=(40, Q.N_STATS))
    z = model.features(x)[:, 1 + Q.N_STATS:]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * Q.BANDWIDTH ** 2))
    assert np.abs(z @ z.T - want).mean() < 0.06


def test_pool_adjacent_is_the_isotonic_fit():
    total, positive = np.array([2.0, 0, 4, 1, 3]), np.array([1.0, 0, 1, 1, 3])
    got = Q.pool_adjacent(total, positive)
    assert got[0] == got[2] == pytest.approx(2 / 6) and got[3] == got[4] == 1.0 and (np.diff(got) >= 0).all()


def test_quality_odd_rows(spark):
    rows = [(i, "word and more text here. " * (1 + i % 5) if i % 3 else "X!! Y!! " * 9, None, None, 1, "a", "b") for i in range(90)]
    rows += [(200, None, None, None, 1, "a", "b"), (201, "", None, None, 1, "a", "b"), (None, "no id", None, None, 1, "a", "b"), rows[4], (202, "w " * 200_000, None, None, 1, "a", "b")]
    docs = spark.createDataFrame(rows, EXTRA).repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)] + [(1, 1), (5, None), (None, 0)], "doc_id long, quality int")
    model = Q.fit_quality(docs, labels)
    got = Q.score_quality(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.quality_score <= 1 and r.quality_predicted == int(r.quality_score >= 0.7) for r in got)
    assert np.mean([r.quality_predicted == int(r.doc_id % 3 > 0) for r in got if r.doc_id is not None and r.doc_id < 90]) > 0.97
    assert Q.fit_quality(docs, labels.limit(0)) is None
    assert Q.score_quality(docs.where("doc_id = 4"), None).first().quality_score == 1.0
    assert Q.score_quality(docs.limit(0), model).count() == 0


ITALIAN = """il la che di e un una per non sono con questo quando anche come dalla nella gatto casa giorno tempo vita strada notte acqua uomo donna bambino
lavoro parola cuore mondo mangiare vedere andare bello grande piccolo sempre mai oggi domani dove allora cosa molto poco tutti niente ancora dopo prima""".split()


def test_unlearned_languages_are_rejected_and_labelled_ones_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.fit_languages(docs)
    assert L.MARGIN_RANGE[0] <= model.margin <= L.MARGIN_RANGE[1]
    rng = np.random.default_rng(5)
    other = [" ".join(rng.choice(ITALIAN, 120)) for _ in range(60)]
    other += [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(120)) for _ in range(60)]
    rows = spark.createDataFrame([(i, t, None, None, 1, "a", "b") for i, t in enumerate(other)], EXTRA)
    assert np.mean([r.lang_rejected for r in L.predict_languages(rows, model).collect()]) > 0.9
    long = [r for r in L.predict_languages(docs.where("length(text) > 200"), model).collect() if fold(r.doc_id, 3) == 1]
    assert np.mean([r.lang_rejected for r in long]) < 0.005


def test_copies_do_not_shrink_the_sample(spark):
    ids = [i for i in range(6_000) if fold(i, 3) != 1]
    rows = [(d, "one text copied very often" if k < 3_000 else f"text number {k} of its own", "en", "s", 1, "a", "b") for k, d in enumerate(ids)]
    docs = spark.createDataFrame(rows, EXTRA).repartition(3)
    distinct = len({r[1] for r in rows})
    assert 500 < distinct < 1_100
    model = L.fit_languages(docs, sample_docs=400)
    assert model["en"].count(b"of its own") + model["en"].count(b"copied") == 400
    whole = L.fit_languages(docs, sample_docs=distinct + 5)
    assert whole["en"].count(b"of its own") == distinct - 1 and whole["en"].count(b"copied") == 1


def test_long_texts_teach_more_than_their_beginning(spark):
    rows = [(i, "start " * 3_000 + f"Finale{i} " * 3_000, "en", "s", 1, "a", "b") for i in range(60)]
    rows += [(100 + i, f"short text {i}", "en", "s", 1, "a", "b") for i in range(20)]
    model = L.fit_languages(spark.createDataFrame(rows, EXTRA))
    assert b"finale" in model["en"] and b"start start" in model["en"]
    assert all(f"short text {i}".rsplit(" ", 1)[0].encode() in model["en"] for i in range(20) if fold(100 + i, 3) != 1)


def test_every_sampled_text_gets_an_equal_share_of_a_dictionary(monkeypatch):
    assert L._content([]) == b"" and L._content([b"", b"ab"]) == b" ab"
    monkeypatch.setattr(L, "DICT_BYTES", 100)
    assert L._content([b"a" * 30, b"b" * 40]) == b"a" * 30 + b" " + b"b" * 40
    got = L._content([b"a" * 5_000, b"b" * 10, b"c" * 5_000]).split(b" ")
    assert [len(t) for t in got] == [43, 10, 43]


def test_too_many_languages_raise(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "some text", f"l{i}") for i in range(20)], "doc_id long, text string, lang string")
    monkeypatch.setattr(L, "MAX_LANGUAGES", 5)
    with pytest.raises(ValueError, match="5 distinct"):
        L.fit_languages(docs)
