"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkwhy.llm import bpe_chunks, embeddings, html_text, language, minhash, packing, quality_model, quality_rules, url_filter, warc

LONG = " ".join(f"word{k % 977}" for k in range(30_000))
SAME = "one two three four five six seven eight nine ten eleven twelve"
TEXTS = [(1, SAME), (2, SAME), (2, SAME), (None, SAME), (3, None), (4, ""), (5, " \n\t "), (6, LONG), (7, "x" * 50_000), (8, "日本語 😀 \x00 é"), (None, None)]
LABELS = [(1, 1, 0), (6, 0, 0), (None, 1, None), (3, None, 1), (6, 0, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with nulls in every column, and columns whose names clash with each other and with the operators' own."""
    rows = [(i, t, None if k % 2 else "en", None if k % 3 else "a", None, 7, "n", "i", "k") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, DOC_ID int, node string, id string, key string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def model():
    return quality_model.Model([SAME, LONG, *["plain words here now"] * 20, *["!! ## !!"] * 20], [1, 0, *[1] * 20, *[0] * 20])


LANGUAGES = language.fit(["the cat sat on the mat"] * 12 + ["le chat est sur la table"] * 12, ["en"] * 12 + ["fr"] * 12)
OPERATORS = {
    "rules": quality_rules.quality_rules,
    "bpe": bpe_chunks.bpe_encode,
    "packing": packing.pack_documents,
    "minhash": lambda d: minhash.near_duplicates(d, width=3, percent=85),
    "language": lambda d: language.identify(d, LANGUAGES),
    "quality": lambda d: quality_model.score_quality(d, model()),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_for_each_row_and_none_for_none(docs, name):
    found = OPERATORS[name](docs)
    rows = found.collect()
    if name == "packing":
        assert sum(r["piece"] == 0 for r in rows) == len(TEXTS)
    else:
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _ in TEXTS)
    empty = OPERATORS[name](docs.limit(0))
    assert empty.columns == found.columns and empty.collect() == []
    only_null = OPERATORS[name](docs.where("text is null"))
    assert len(only_null.collect()) == 2


def test_rules_on_odd_rows(docs):
    rows = [r for r in quality_rules.quality_rules(docs).collect()]
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    for k in (3, 4, 5):
        assert (by[k]["n_words"], by[k]["word_chars"], by[k]["base_failed"], by[k]["kept"]) == (0, 0, True, False)
    assert by[1]["n_words"] == 12 and by[1]["kept"] and by[8]["word_chars"] == 6
    assert len({tuple(r) for r in rows if r["doc_id"] == 2}) == 1


def test_minhash_on_odd_rows(docs):
    rows = minhash.near_duplicates(docs, width=3, percent=85).collect()
    assert sorted((r["component_id"], r["kept"]) for r in rows if r["n_shingles"] == 10) == [(1, False), (1, False), (1, False), (1, True)]
    assert all(r["component_id"] == r["doc_id"] and r["kept"] for r in rows if r["n_shingles"] == 0)
    assert {r["doc_id"]: r["n_shingles"] for r in rows}[7] == 1


def test_packing_places_everything_once(docs):
    rows = packing.pack_documents(docs, with_ids=True).collect()
    seen = {}
    for r in rows:
        assert len(bytes(r["ids"])) == 4 * r["length"]
        seen.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in seen.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024


def test_language_and_quality_without_text(docs):
    found = {r["doc_id"]: r for r in language.identify(docs, LANGUAGES).collect()}
    for k in (3, 4, 5):
        assert (found[k]["lang_pred"], found[k]["score"], found[k]["ambiguous"]) == ("und", 0.0, True)
    scores = {r["doc_id"]: r for r in quality_model.score_quality(docs, model()).collect()}
    assert scores[3]["score"] == scores[4]["score"] == scores[5]["score"] and 0 <= scores[3]["score"] <= 1


def test_training_on_odd_labels(spark, docs, labels):
    m = quality_model.train(docs, labels, modulus=1000, held=999)
    assert 0 <= m.constant <= 1 and quality_model.score_quality(docs, m).count() == len(TEXTS)
    none = quality_model.train(docs, labels.limit(0))
    assert none.network is None and quality_model.score_quality(docs, none).first()["score"] == 1.0
    assert language.identify(docs, language.train(docs.limit(0))).where("lang_pred <> 'und'").count() == 0
    one = language.train(docs.where("lang = 'en'"))
    assert {r["lang_pred"] for r in language.identify(docs, one).collect()} == {"en", "und"}


@pytest.fixture(scope="module")
def pages(spark):
    html = "<html><body><nav>menu</nav><article><p>Text, one.</p></article></body></html>"
    rows = [(1, "http://a.com/en/1", html), (2, None, html), (2, None, html), (None, "nothing", html), (3, "", None), (4, "https://B.org", ""), (5, "http://c.net/?q", "<p>" + "long, " * 40_000), (None, None, None)]
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "page_id long, url string, html string, Page_Id string, host string, digest int")


def test_page_operators(spark, pages):
    rules = [("com/en/", "block")]
    small = url_filter.train(url_filter.made_labels(spark, 200), rounds=2, depth=2)
    for run in (lambda p: url_filter.judge(p, small, rules), html_text.extract_text, warc.archived):
        found = run(pages)
        assert found.count() == 8 and run(pages.limit(0)).count() == 0
    texts = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract_text(pages).collect() if r["page_id"] in (1, 3, 4)}
    assert texts == {1: ("Text, one.", 10), 3: ("", 0), 4: ("", 0)}
    verdicts = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in url_filter.judge(pages, small, rules).collect()}
    assert verdicts[1] == ("a.com", "/en/1", "com/en/") and verdicts[3] == ("", "", None) and verdicts[4] == ("b.org", "", None)
    kinds = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.archived(pages).collect()}
    assert {(1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "revisit", 3), (None, "revisit", 1), (None, "revisit", 3)} <= kinds


def test_archives_and_records_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archive(none, str(tmp_path / "none"))
    assert warc.read_archive(spark, str(tmp_path / "none")).count() == 0
    record = warc.header(None, None, warc.sha1_base32(b"x"), b"", 1, True, None, "2024-01-01T00:00:00Z") + b"x\r\n\r\n"
    odd = spark.createDataFrame([(None, 1), (b"", 2), (record, 3), (record, 3), (record * 2, 4)], "record binary, RECORD int")
    found = warc.parse_records(odd).collect()
    assert len(found) == 4 and all((r["page_id"], r["url"], bytes(r["payload"])) == (None, None, b"x") for r in found)
    assert warc.parse_records(odd.limit(0)).count() == 0
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "empty.warc").write_bytes(b"")
    assert warc.read_warc_files(spark, str(tmp_path / "files")).count() == 0


def test_models_of_urls_without_two_labels(spark):
    none = spark.createDataFrame([], "url string, label int")
    assert url_filter.train(none).constant == 0.0
    only = url_filter.train(spark.createDataFrame([("http://a.b/c", 1), (None, 0)], "url string, label int"))
    page = spark.createDataFrame([(1, "http://x.y")], "page_id long, url string")
    assert url_filter.judge(page, only).first()["verdict"] == "block"


def test_decoding_odd_rows(spark):
    rows = [(1, b""), (2, None), (None, b"\x00\x00\x00\x00"), (2, None)]
    table = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, ids binary, IDS int")
    found = bpe_chunks.bpe_decode(table)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, ""), (2, None), (None, "!"), (2, None)], key=str)
    assert bpe_chunks.bpe_decode(table.limit(0)).count() == 0


def test_fitting_languages_on_odd_rows():
    none = language.fit([], [])
    assert none.predict("text") == ("und", 0.0, True)
    one = language.fit(["some text", "", None, "12 ½"], ["en", "de", "fr", "es"])
    assert one.predict("text")[0] == "en" and one.predict("½ ² ①") == ("und", 0.0, True)
    few = language.fit(["the cat", "le chat", "the dog", None], ["en", "fr", "en", None])
    assert {few.predict(x)[0] for x in ("the cat", "le chat")} == {"en", "fr"}


def test_letters():
    assert all(map(language.has_letter, ("a", "1 é", "日", "٣ب", "ª"))) and not any(map(language.has_letter, (None, "", "12 ½ ² ① ٣ _ -", "😀")))


def test_few_labels_make_a_network():
    few = quality_model.Model(["plain words here now", "!! ## !!"], [1, 0])
    assert few.network is not None and few.score(["plain words here now"])[0] > few.score(["!! ## !!"])[0]


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (None, [1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (9, [0.0, 1.0]), (10, [1.0]), (11, [float("inf"), 0.0])]
    table = spark.createDataFrame([(*r, None, 5) for r in rows], "vec_id long, embedding array<double>, label int, VEC_ID int")
    found = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(table).collect())
    expected = [(1, 4, 1, True), (2, 4, 1, False), (3, 4, 1, False), (3, 4, 1, False), (None, 4, 1, False)] + [(k, 0, k, True) for k in (4, 5, 6, 7, 8, 9, 10, 11)]
    assert found == sorted((str(a), *b) for a, *b in expected)
    assert embeddings.near_vectors(table.limit(0)).count() == 0
    assert embeddings.near_vectors(table.where("embedding is null or size(embedding) = 0")).count() == 2


def test_near_vectors_of_float_columns_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base + 0.15 * rng.normal(size=base.shape) for _ in range(8)] + [rng.normal(size=(200, 16))]).astype(np.float32)
    table = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "vec_id long, embedding array<float>")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    found = {r["vec_id"]: r for r in embeddings.near_vectors(table, per_cell=20, chunk=16).collect()}
    got = np.array([found[k]["n_links"] for k in range(len(x))])
    assert (got <= linked.sum(1) - 1).all() and got.sum() >= 0.9 * (linked.sum() - len(x))


GOOD, OTHER = " ".join(f"good{k}" for k in range(40)), " ".join(f"other{k}" for k in range(41))


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_rules_stage_judges_rows_not_ids(spark):
    rows = [(1, GOOD, "a"), (1, "bad one", "a"), (None, OTHER, "a"), (None, "too short", "a"), (2, None, GOOD), (2, GOOD, None), (3, GOOD, "a"), (3, GOOD, "a")]
    found = corpus_pipeline.rules(spark, rows_of(spark, rows), "").collect()
    kept = sorted(((r["doc_id"], r["text"], r["source"]) for r in found), key=str)
    assert kept == sorted([(1, GOOD, "a"), (None, OTHER, "a"), (2, GOOD, None), (3, GOOD, "a"), (3, GOOD, "a")], key=str)


def test_near_dedup_stage_leaves_one_row_of_a_group(spark):
    rows = [(None, GOOD, "a"), (None, GOOD, "b"), (7, GOOD + " x", "a"), (5, GOOD, "a"), (5, GOOD, "a"), (5, OTHER, "a"), (None, OTHER + " y", "a"), (8, "", "a"), (8, "", "a"), (9, None, "a")]
    found = corpus_pipeline.near_dedup(spark, rows_of(spark, rows), "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in found if r["text"]) == sorted([(5, GOOD), (5, OTHER)])
    assert sum(not r["text"] for r in found) == 3
    nulls = corpus_pipeline.near_dedup(spark, rows_of(spark, [(None, GOOD, "a"), (None, GOOD, "b"), (None, GOOD + " x", "c"), (None, OTHER, "a")]), "").collect()
    assert len(nulls) == 2 and {r["text"][:4] for r in nulls} == {"good", "othe"}


def test_classifier_and_packing_stages_on_odd_rows(spark, docs, labels, tmp_path):
    labels.limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.classifier(spark, docs, str(tmp_path)).count() == len(TEXTS)  # no label, no reason to reject
    packed = corpus_pipeline.pack(spark, docs, "").collect()
    assert sum(r["piece"] == 0 for r in packed) == len(TEXTS) and sum(r["doc_id"] is None for r in packed) == 2


@pytest.mark.parametrize("stage", range(4))
def test_pipeline_stages(spark, docs, labels, tmp_path, stage):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    name, run = corpus_pipeline.STAGES[stage]
    for table in (docs, docs.limit(0), docs.where("text is null")):
        found = run(spark, table, str(tmp_path))
        rows = found.collect()
        if stage < 3:
            assert found.columns == corpus_pipeline.COLUMNS
        if table.isEmpty():
            assert rows == []
