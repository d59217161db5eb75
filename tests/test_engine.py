import json

import pytest
from pyspark.sql import functions as F

from sparkwhy import cli
from sparkwhy.engine import Engine, Explanation, Settings
from sparkwhy.operators import evaluate, sampling
from sparkwhy.operators.apt import build
from sparkwhy.operators.patterns import Pattern
from sparkwhy.operators.score import sampling_error
from sparkwhy.plans.join_graph import valid_graphs
from sparkwhy.plans.question import Question
from sparkwhy.queries import SEGMENT_QUERY, SEGMENTS
from sparkwhy.sources import sinks, written
from sparkwhy.sources.catalog import Catalog, star_catalog
from sparkwhy.streaming import progress
from sparkwhy.workloads import WORKLOADS

QUICK = Settings(max_edges=0, candidate_recall=0.05, trees=5, max_bounds=1)


@pytest.fixture(scope="module")
def engine(spark, sf):
    return Engine(spark, star_catalog(spark, sf))


@pytest.mark.parametrize("settings", [QUICK, Settings(**{**QUICK.__dict__, "score_mode": "e", "sample_type": "uniform"}), Settings(**{**QUICK.__dict__, "optimised": False, "exact": True})])
def test_explain(spark, engine, settings):
    found = engine.explain(SEGMENTS, settings)
    assert found.patterns and found.sizes["yes"] > 0
    assert [d.pattern.f1 for d in found.patterns] == sorted((d.pattern.f1 for d in found.patterns), reverse=True)
    assert len(found.diversified) <= 10 and len(found.best) <= 25
    assert all(0 <= d.pattern.recall <= 1 and 0 <= d.pattern.precision <= 1 for d in found.patterns)
    if settings.score_mode == "e":
        assert sampling_error([d.pattern for d in found.patterns])["evaluated"] == len(found.patterns)


@pytest.mark.parametrize("name", sorted(WORKLOADS))
def test_workloads(engine, name):
    found = engine.explain(WORKLOADS[name], Settings(**{**QUICK.__dict__, "sample_type": "spread"}))
    assert found.sizes["yes"] > 0 and found.sizes["no"] > 0


def test_studies(spark, engine):
    graph = valid_graphs(engine.catalog, ["customer", "orders"], 0)[0]
    pt, roles = engine.provenance(SEGMENTS)
    apt = build(engine.catalog, SEGMENT_QUERY, pt, roles, graph)
    rows = {r["exp_desc"]: r for r in evaluate.lca_study(apt.rows, ["a_10", "a_13"], [10, 40, 80]).collect()}
    assert rows["sample_80"]["num_match"] == rows["sample_80"]["num_result_p"] > 0 and rows["sample_10"]["num_match"] <= 10
    study = evaluate.ndcg_study(engine, SEGMENTS, [0], [0.5], QUICK).collect()
    assert [(r["edges"], r["sample_rate"]) for r in study] == [(0, 0.5)] and 0 < study[0]["ndcg_score"] <= 1


def test_samples_are_weighted_only_beyond_the_provenance_table(spark, engine, monkeypatch):
    asked = []
    monkeypatch.setattr(sampling, "weighted_by_count", lambda rows, *a, **k: asked.append("weighted") or sampling.uniform(rows, 50))
    t = spark.createDataFrame([("yes", k, "x" if k % 2 else "y") for k in range(400)], "is_user string, pnumber long, a_1 string")
    for pt_rows, expected in ((400, []), (500, []), (399, ["weighted"])):
        asked.clear()
        assert engine._sample(t, 400, ["a_1"], [], Settings(score_rate=0.25), pt_rows).count() > 0 and asked == expected


def test_runs_leave_nothing_behind(spark, engine):
    before = set(written._paths)
    found = engine.explain(SEGMENTS, QUICK)
    assert found.patterns and set(written._paths) == before
    pt, _ = engine.provenance(SEGMENTS)
    assert len(set(written._paths) - before) == 1 and pt.count() > 0
    written.discard(pt)
    assert set(written._paths) == before


def test_one_saved_pattern(spark, engine, tmp_path):
    found = engine.explain(SEGMENTS, QUICK)
    found.save(spark, str(tmp_path))
    table = spark.read.parquet(str(tmp_path / "patterns"))
    best = found.patterns[0]
    row = engine.pattern(table, best.text)
    assert row["p_desc"] == best.text and row["fscore"] == best.pattern.f1
    assert engine.pattern(table, "no such pattern") is None


def test_steps_are_logged(engine, caplog):
    with caplog.at_level("INFO", logger="sparkwhy"):
        engine.explain(SEGMENTS, QUICK)
    assert any("join graphs" in m for m in caplog.messages) and any("patterns in" in m for m in caplog.messages)


def test_catalogs_from_csv_and_jdbc(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a_id,a_x,a_note\n1,2.5,one\n2,,\n")
    keys, foreign = {"a": ("a_id",)}, ()
    made = Catalog.from_csv(spark, str(tmp_path), ["a"], keys, foreign)
    assert made.tables["a"].kind("a_x") == "ordinal" and made.tables["a"].kind("a_note") == "nominal" and made.tables["a"].primary_key == ("a_id",)
    assert sorted(map(tuple, made.frame("a").collect())) == [(1, 2.5, "one"), (2, None, None)]
    assert made.preview("a").count() == 1
    with pytest.raises(Exception, match="(?i)jdbc|driver|sqlite"):  # no driver is installed: Spark's own source is asked for one
        Catalog.from_jdbc(spark, "jdbc:nothing:x", ["a"], keys, foreign)


def test_only_candidates(engine):
    found = engine.explain(SEGMENTS, Settings(max_edges=0, candidate_recall=0.05, only_candidates=True))
    assert found.patterns and all(not d.pattern.ordinal for d in found.patterns)


def test_saved_tables_and_stream(spark, engine, tmp_path):
    found = progress.publish(engine, SEGMENTS, str(tmp_path), QUICK)
    found.save(spark, str(tmp_path / "final"), "mine")
    assert spark.read.parquet(str(tmp_path / "final" / "patterns")).count() == len(found.patterns)
    assert spark.read.parquet(str(tmp_path / "final" / "jgs_time_dist")).count() == 1
    seen = []
    stream = progress.deliver(progress.follow(spark, str(tmp_path)), lambda batch: seen.extend(batch.collect()), str(tmp_path / "checkpoint"))
    stream.awaitTermination()
    assert len(seen) == spark.read.parquet(str(tmp_path / "patterns")).count() > 0
    counts = progress.progress(spark.read.schema(sinks.PATTERN_SCHEMA).parquet(str(tmp_path / "patterns")))
    assert counts.first()["patterns"] == len(seen)


def test_chart_and_graphs(engine):
    graph = valid_graphs(engine.catalog, ["customer", "orders"], 0)[0]
    counts = engine.chart(SEGMENTS, graph, Pattern(nominal=(("a_10", "F"),)), "a_10").collect()
    assert {r["side"] for r in counts} == {"BUILDING", "MACHINERY"}
    assert engine.chart(SEGMENTS, graph, Pattern(ordinal=(("a_11", ">", 0.0),)), "a_11").count() > 0
    assert len(engine.graphs(SEGMENT_QUERY, Settings(max_edges=2))) == 2
    assert {n["name"] for n in engine.schema_graph()["nodes"]} >= {"nation", "orders"} and engine.tables().count() > 30


def test_command_line(spark, sf, tmp_path, capsys):
    spec = {
        "tables": {"customer": "customer", "orders": "orders"}, "joins": [["customer.c_custkey", "orders.o_custkey"]], "group_by": ["customer.c_mktsegment"],
        "aggregates": [{"name": "n", "kind": "count"}], "first": {"c_mktsegment": "BUILDING"}, "second": None,
    }
    path = tmp_path / "question.json"
    path.write_text(json.dumps(spec))
    cli.main([sf, str(path), str(tmp_path / "out"), "-M", "0", "-m", "0.05", "-k", "1", "-t", "o"])
    assert "total:" in capsys.readouterr().out and spark.read.parquet(str(tmp_path / "out" / "global_results")).count() > 0


def test_command_line_runs_named_questions(spark, sf, tmp_path, capsys):
    cli.main([sf, "segments,status", str(tmp_path), "-W", "-M", "0", "-m", "0.05", "-k", "1", "--trees", "5", "--bound-rate", "1", "-D", "why_cli", "--description", "d"])
    assert {r[0] for r in spark.read.parquet(str(tmp_path / "patterns")).select("exp_desc").distinct().collect()} <= {"d segments", "d status"}
    assert spark.table("why_cli.patterns").count() == spark.read.parquet(str(tmp_path / "patterns")).count() > 0
    assert "segments" in capsys.readouterr().out


def test_ndcg_is_one_for_equal_runs_and_less_for_reversed(spark):
    t = spark.createDataFrame([("a", 0.9), ("b", 0.5), ("c", 0.1)], "p_desc string, fscore double")
    reverse = t.withColumn("fscore", 1 - F.col("fscore"))
    assert evaluate.ndcg(t, t, ["p_desc"]).first()[0] == pytest.approx(1.0)
    assert evaluate.ndcg(t, reverse, ["p_desc"]).first()[0] < 0.9
    assert evaluate.paired(t, t.where("p_desc <> 'a'"), ["p_desc"]).where("s_score is null").count() == 1


def test_run_difference_is_not_hidden_by_nulls(spark):
    a = spark.createDataFrame([("x",), ("y",), (None,)], "p string")
    b = spark.createDataFrame([("x",), (None,)], "p string")
    assert {r["p"] for r in evaluate.only_in(a, b, ["p"]).collect()} == {"y", None}


def test_views_are_dropped_by_prefix(spark):
    spark.range(1).createOrReplaceTempView("jg_7")
    assert sinks.drop_views(spark, "jg_") == ["jg_7"]


def test_catalog_tables_and_save(spark):
    sinks.save(spark.range(3), "why_results", "t")
    assert spark.table("why_results.t").count() == 3


def test_question_about_groups_that_are_not_there(spark, engine):
    found = engine.explain(Question(SEGMENT_QUERY, {"c_mktsegment": "NOWHERE"}, {"c_mktsegment": "BUILDING"}), QUICK)
    assert found.sizes["yes"] == 0 and all(d.pattern.is_user == "no" for d in found.patterns)
    nothing = engine.explain(Question(SEGMENT_QUERY, {"c_mktsegment": "NOWHERE"}, {"c_mktsegment": "NEITHER"}), QUICK)
    assert nothing.patterns == [] and nothing.best == []


def test_explanation_without_patterns(spark):
    assert Explanation(SEGMENTS).tables(spark)["patterns"].count() == 0
