import numpy as np

import __spark_entry__
import corpus_pipeline
from sparkwhy.llm import quality_model
from sparkwhy.llm.queries import ORACLE_SQL
from tests.duck import connect
from tests.llm.test_minhash import plain_components, plain_sets
from tests.llm.test_text_operators import exact


def test_stages_equal_a_plain_version(spark, sf):
    """Each stage on what the stage before kept; the classifier's scores are its own, its effect is not."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "MinHash near-dedup", "best-fit packing"]
    con = connect(sf)
    rules = {r[0] for r in con.execute(f"SELECT doc_id FROM ({ORACLE_SQL['op10_quality_rules']}) WHERE kept").fetchall()}
    first = corpus_pipeline.rules(spark, docs, sf).cache()
    assert first.columns == corpus_pipeline.COLUMNS and {r["doc_id"] for r in first.collect()} == rules

    second = corpus_pipeline.classifier(spark, first, sf).cache()
    model = quality_model.train(first, spark.read.parquet(f"{sf}/labels.parquet"))
    ids = sorted(rules)
    good = {i for i, s in zip(ids, model.score([texts[i] for i in ids]), strict=True) if s >= 0.5}
    assert {r["doc_id"] for r in second.collect()} == good
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert np.mean([(i in good) == bool(labels[i]) for i in ids if i in labels]) >= 0.9

    third = corpus_pipeline.near_dedup(spark, second, sf).cache()
    ids = sorted(good)
    component = plain_components(ids, plain_sets([texts[i] for i in ids], 5), 80)
    kept = {i for i in ids if component[i] == i}
    assert {r["doc_id"] for r in third.collect()} == kept

    places = {}
    for r in corpus_pipeline.pack(spark, third, sf).collect():
        places.setdefault(r["doc_id"], 0)
        places[r["doc_id"]] += r["length"]
    assert places == {i: len(exact(texts[i])) + 1 for i in kept}


def test_run_gives_the_last_stage(spark, sf):
    found = __spark_entry__.queries()["pipeline"](spark, sf)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and found.count() > 0
