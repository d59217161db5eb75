"""Command line: explain a question about the tables of a directory.

A question is a JSON file with tables, joins, filters, group_by, aggregates, first and, if
two groups are compared, second.
"""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import SparkSession

from .engine import Engine, Settings
from .plans.question import Aggregate, Filter, Query, Question
from .sources import sinks
from .sources.catalog import TPCH_FOREIGN_KEYS, TPCH_KEYS, Catalog, ForeignKey, star_catalog
from .workloads import WORKLOADS


def read_question(spec: dict) -> Question:
    query = Query(
        dict(spec["tables"]), tuple(spec["group_by"]), tuple(Aggregate(**a) for a in spec["aggregates"]),
        tuple((a, b) for a, b in spec.get("joins", ())), tuple(Filter(**f) for f in spec.get("filters", ())),
    )
    return Question(query, spec["first"], spec.get("second"), tuple(spec.get("labels", ("first", "second"))))


def read_catalog(spark: SparkSession, directory: str, spec: dict) -> Catalog:
    """Keys from the question file, or those of the star schema."""
    keys = {k: tuple(v) for k, v in spec["primary_keys"].items()} if "primary_keys" in spec else TPCH_KEYS
    foreign = tuple(ForeignKey(c, tuple(x), p, tuple(y)) for c, x, p, y in spec["foreign_keys"]) if "foreign_keys" in spec else TPCH_FOREIGN_KEYS
    names = spec.get("catalog") or sorted({f.child for f in foreign} | {f.parent for f in foreign} | set(spec["tables"].values()))
    return Catalog.from_parquet(spark, directory, names, keys, foreign)


def parser() -> argparse.ArgumentParser:
    p, d = argparse.ArgumentParser(description=__doc__), Settings()
    yes = lambda text: text.lower() in ("y", "yes", "true", "1")
    p.add_argument("directory", help="folder of <table>.parquet")
    p.add_argument("question", help="JSON file of the question, or the name of a workload")
    p.add_argument("output", help="folder for the result tables")
    p.add_argument("-M", "--max-edges", type=int, default=d.max_edges)
    p.add_argument("-F", "--score-rate", type=float, default=d.score_rate)
    p.add_argument("-w", "--sample-type", choices=("weighted", "spread", "uniform"), default=d.sample_type)
    p.add_argument("-z", "--score-least", type=int, default=d.score_least)
    p.add_argument("-o", "--optimised", type=yes, default=d.optimised)
    p.add_argument("-i", "--skip-expensive", type=yes, default=d.skip_expensive)
    p.add_argument("-m", "--candidate-recall", type=float, default=d.candidate_recall)
    p.add_argument("-p", "--pattern-recall", type=float, default=d.pattern_recall)
    p.add_argument("-r", "--lca-rate", type=float, default=d.lca_rate)
    p.add_argument("-s", "--lca-least", type=int, default=d.lca_least)
    p.add_argument("-S", "--lca-most", type=int, default=d.lca_most)
    p.add_argument("-t", "--score-mode", choices=("o", "s", "e"), default=d.score_mode)
    p.add_argument("-k", "--max-bounds", type=int, default=d.max_bounds)
    p.add_argument("--bound-rate", type=float, default=d.bound_rate, help="numeric attributes tried for each allowed bound")
    p.add_argument("--trees", type=int, default=d.trees, help="trees of the forest that ranks numeric attributes")
    p.add_argument("--lca-limit", type=int, default=d.lca_limit)
    p.add_argument("--lca-kept", type=int, default=d.lca_kept)
    p.add_argument("--equal-keys", type=yes, default=d.equal_keys)
    p.add_argument("-W", "--workloads", action="store_true", help="run all named questions; QUESTION is then a name, a list with commas, or 'all'")
    p.add_argument("-D", "--database", help="append the result tables to this database of the session's catalog too")
    p.add_argument("-v", "--verbose", action="store_true", help="log each step")
    p.add_argument("-L", "--only-candidates", action="store_true")
    p.add_argument("--strict-keys", type=yes, default=d.strict_keys)
    p.add_argument("--threads", type=int, default=d.threads)
    p.add_argument("--exact", action="store_true")
    p.add_argument("--seed", type=int, default=d.seed)
    p.add_argument("--description", default="run")
    return p


def main(argv: list[str] | None = None) -> None:
    args = vars(parser().parse_args(argv))
    directory, path, output, description = (args.pop(k) for k in ("directory", "question", "output", "description"))
    workloads, database, verbose = (args.pop(k) for k in ("workloads", "database", "verbose"))
    if verbose:
        logging.basicConfig(format="%(levelname)s %(asctime)s [%(filename)s:%(funcName)s:%(lineno)d] %(message)s")
        logging.getLogger("sparkwhy").setLevel(logging.INFO)
    spark = SparkSession.builder.appName("sparkwhy").getOrCreate()
    if workloads or path in WORKLOADS:
        names = sorted(WORKLOADS) if path == "all" else path.split(",")
        todo = [(n if len(names) > 1 else "", WORKLOADS[n], star_catalog(spark, directory)) for n in names]
    else:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        todo = [("", read_question(spec), read_catalog(spark, directory, spec))]
    for name, question, catalog in todo:
        found = Engine(spark, catalog).explain(question, Settings(**args))
        about = f"{description} {name}".strip()
        found.save(spark, output, about)
        if database:
            for table, rows in found.tables(spark, about).items():
                sinks.save(rows, database, table)
        print(*([name] if name else []), found.stats.report(), sep="\n")
        for d in found.best:
            print(f"{d.pattern.f1:.5f}  {d.pattern.is_user}  {d.text}  [{d.graph_text}]")


if __name__ == "__main__":
    main()
