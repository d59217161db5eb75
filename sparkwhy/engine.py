"""Explaining why two groups of a query's answer differ."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .operators import apt as apts
from .operators import charts, features, lca, provenance, rank, refine, sampling, score
from .operators.apt import Apt
from .operators.patterns import Described, Pattern, describe
from .operators.run_stats import RunStats
from .plans.equivalence import keep_non_redundant
from .plans.join_graph import JoinGraph, enumerate_graphs, is_valid
from .plans.question import Question, Query, Roles
from .sources import sinks
from .sources.catalog import Catalog
from .sources.written import discard, written

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Settings:
    """How to search. Names of the command line's flags stand beside them."""

    max_edges: int = 3  # -M
    strict_keys: bool = True  # all key columns of a joined table have to be used
    equal_keys: bool = False  # also drop graphs that join a table with itself on its key
    skip_expensive: bool = True  # -i
    candidate_recall: float = 0.3  # -m, of nominal candidates
    pattern_recall: float = 0.0  # of every pattern
    lca_rate: float = 0.05  # -r
    lca_least: int = 100  # -s
    lca_most: int = 1000  # -S
    lca_limit: int = 30
    lca_kept: int = 10
    score_mode: str = "s"  # -t: o whole table, s sample, e both
    score_rate: float = 0.3  # -F
    score_least: int = 100  # -z
    sample_type: str = "weighted"  # -w: weighted by frequency, spread (also by variation), or uniform
    optimised: bool = True  # -o: choose attributes first; else try all combinations
    max_bounds: int = 2
    bound_rate: float = 1.5
    trees: int = 500
    only_candidates: bool = False  # -L
    seed: int = 1
    exact: bool = False  # no samples at all
    threads: int = 4  # joined tables worked on at a time


@dataclass
class Explanation:
    question: Question
    patterns: list[Described] = field(default_factory=list)
    diversified: list[Described] = field(default_factory=list)
    best: list[Described] = field(default_factory=list)
    graphs: list[JoinGraph] = field(default_factory=list)
    sizes: dict[str, int] = field(default_factory=dict)
    stats: RunStats = field(default_factory=RunStats)

    def tables(self, spark: SparkSession, description: str = "run") -> dict[str, DataFrame]:
        """All patterns by score, the diversified ones of each graph, and the best of the best graphs."""
        labels = self.question.labels
        made = dict(zip(sinks.RESULT_TABLES, (self.patterns, self.diversified, self.best), strict=True))
        return {name: sinks.pattern_rows(spark, found, description, labels) for name, found in made.items()}

    def save(self, spark: SparkSession, directory: str, description: str = "run") -> None:
        for name, table in self.tables(spark, description).items():
            sinks.append(table, directory, name)
        sinks.append(self.stats.rows(spark, description), directory, "time_and_params")
        sinks.append(self.stats.graph_rows(spark, description), directory, "jgs_time_dist")


class Engine:
    def __init__(self, spark: SparkSession, catalog: Catalog):
        self.spark, self.catalog = spark, catalog

    # What there is

    def tables(self) -> DataFrame:
        return self.catalog.schema_rows(self.spark)

    def schema_graph(self) -> dict:
        return self.catalog.graph_json()

    def answer(self, query: Query) -> DataFrame:
        return query.result(self.catalog)

    # From a question to joined tables

    def provenance(self, question: Question) -> tuple[DataFrame, Roles]:
        """The provenance table, which reads its written and numbered rows, and its columns' roles."""
        return provenance.provenance_table(self.catalog, question), provenance.roles(self.catalog, question.query)

    def graphs(self, query: Query, settings: Settings = Settings()) -> list[JoinGraph]:
        relations = set(query.tables.values())
        found = enumerate_graphs(self.catalog, relations, settings.max_edges)
        found = [g for g in found if not g.intermediate and is_valid(self.catalog, g, relations, settings.strict_keys)]
        return keep_non_redundant(self.catalog, query, found, settings.equal_keys)

    def joined(self, query: Query, pt: DataFrame, roles: Roles, graphs: Sequence[JoinGraph], settings: Settings = Settings()) -> list[Apt]:
        made = [apts.build(self.catalog, query, pt, roles, g) for g in graphs]
        return apts.cheap(made) if settings.skip_expensive else made

    # Patterns of one joined table

    def mine(self, apt: Apt, settings: Settings = Settings(), stats: RunStats | None = None, pt_rows: int = 0) -> list[Pattern]:
        """Scored patterns of a joined table, which is written once and deleted afterwards.

        Samples are weighted only if the table has more rows than the provenance table, ``pt_rows``.
        """
        stats = stats or RunStats()
        nominal, ordinal = apt.nominal(), apt.ordinal()
        with stats.timed("joined_table"):
            rows = written(apt.rows.select("pnumber", "is_user", *nominal, *ordinal), "apt")
            sizes, n = score.sizes_and_rows(rows)
            single = n == sum(sizes.values())
        with stats.timed("candidates"):
            take = sampling.lca_size(n, settings.lca_rate, settings.lca_least, settings.lca_most)
            left = sampling.uniform(rows, take, settings.seed)
            right = sampling.uniform(rows, take, settings.seed + 1)
            found = lca.candidates(left, right, nominal, settings.lca_limit, take)
            likely = [f for f, _ in lca.by_recall(rows, found, settings.candidate_recall, settings.lca_kept, sizes, single)]
            stats.add("candidates_kept", len(likely))
            log.info("%s: %d rows, %d candidates, %d kept", apt.graph.text(False), n, len(found), len(likely))
        if settings.only_candidates:
            discard(rows)
            return [Pattern(nominal=f, is_user=s) for f in likely for s in ("yes", "no")]
        sample = sample_sizes = None
        if settings.score_mode != "o" and not settings.exact:
            with stats.timed("sample"):
                sample = self._sample(rows, n, nominal, ordinal, settings, pt_rows)
                sample_sizes = score.side_sizes(sample) if sample is not None else None

        def scored(tried: list[Pattern]) -> list[Pattern]:
            with stats.timed("scoring"):
                stats.add("scored", len(tried))
                return score.score(rows, tried, sizes, "o" if settings.exact else settings.score_mode, sample, sample_sizes, single)

        if settings.optimised:
            with stats.timed("features"):
                chosen = features.choose(rows, features.varying(rows, ordinal), apt.special(), seed=settings.seed, trees=settings.trees)
            with stats.timed("bounds"):
                bounds = refine.quartiles(rows, likely, [a for a, _ in chosen.ranked])
            out = refine.search(likely, bounds, chosen, apt.special(), scored, settings.max_bounds, settings.bound_rate, settings.pattern_recall)
        else:
            with stats.timed("bounds"):
                bounds = refine.quartiles(rows, likely, ordinal)
            out = refine.search_all(likely, bounds, ordinal, apt.special(), scored, settings.max_bounds, settings.pattern_recall)
        if sample is not None:
            discard(sample)
        discard(rows)
        return out

    def _sample(self, rows: DataFrame, n: int, nominal: list[str], ordinal: list[str], settings: Settings, pt_rows: int) -> DataFrame | None:
        size = sampling.score_size(n, settings.score_rate, settings.score_least)
        if size is None:
            return None
        if settings.sample_type != "uniform" and nominal and n > pt_rows:
            column = sampling.widest(rows, nominal)
            measure = sampling.most_varying(rows, ordinal) if settings.sample_type == "spread" and ordinal else None
            if measure:
                return written(sampling.weighted_by_spread(rows, column, measure, size, settings.seed), "sample")
            return written(sampling.weighted_by_count(rows, column, size, settings.seed), "sample")
        return written(sampling.uniform(rows, size, settings.seed), "sample")

    # All of it

    def explain_steps(self, question: Question, settings: Settings = Settings(), explanation: Explanation | None = None) -> Iterator[tuple[JoinGraph, list[Described]]]:
        """The diversified patterns of each join graph as soon as it is done."""
        out = explanation if explanation is not None else Explanation(question)
        out.stats.params.update(settings.__dict__)
        with out.stats.timed("provenance"):
            pt, out.sizes = provenance.sized_table(self.catalog, question)
            roles, pt_rows = provenance.roles(self.catalog, question.query), sum(out.sizes.values())
        log.info("provenance: %s tuples", out.sizes)
        with out.stats.timed("graphs"):
            found = self.joined(question.query, pt, roles, self.graphs(question.query, settings), settings)
            out.graphs = [a.graph for a in found]
            out.stats.add("join_graphs", len(found))
        log.info("%d join graphs", len(found))

        def one(numbered: tuple[int, Apt]) -> tuple[Apt, list[Described]]:
            k, apt = numbered
            start = time.perf_counter()
            mined = [describe(apt, p, f"jg_{k}") for p in self.mine(apt, settings, out.stats, pt_rows)]
            taken = out.stats.graph_times[f"jg_{k}: {apt.graph.text(False)}"] = time.perf_counter() - start
            log.info("jg_%d: %d patterns in %.1f s", k, len(mined), taken)
            return apt, mined

        with ThreadPoolExecutor(max(1, settings.threads)) as pool:
            for apt, mined in pool.map(one, enumerate(found, 1)):
                out.patterns += mined
                with out.stats.timed("ranking"):
                    top = rank.diversified(mined)
                yield apt.graph, top
        discard(pt)

    def explain(self, question: Question, settings: Settings = Settings()) -> Explanation:
        """Patterns over the query's tables and those that can be joined, for either side of a question."""
        out = Explanation(question)
        tops = [d for _, top in self.explain_steps(question, settings, out) for d in top]
        with out.stats.timed("ranking"):
            out.patterns = rank.globally(out.patterns)
            out.diversified = rank.globally(tops)
            out.best = rank.best_of_best(out.patterns)
        return out

    # About one pattern

    def pattern(self, patterns: DataFrame, text: str) -> Row | None:
        """One row of a saved table of patterns, the best of those with this text; None if there is none."""
        return patterns.where(F.col("p_desc") == text).orderBy(F.col("fscore").desc(), "exp_time", "id").limit(1).first()

    def chart(self, question: Question, graph: JoinGraph, pattern: Pattern, column: str) -> DataFrame:
        """Counts of a predicate's column under the pattern's other predicates, on both sides."""
        pt, roles = self.provenance(question)
        apt = apts.build(self.catalog, question.query, pt, roles, graph)
        make = charts.histogram if apt.named(column).kind == "ordinal" else charts.nominal_counts
        made = written(make(apt.rows, pattern, column, question.labels), "chart")
        discard(pt)
        return made

    def rerank(self, patterns: DataFrame, liked: Sequence[str] = (), disliked: Sequence[str] = (), most: int = 20) -> DataFrame:
        return rank.rerank(patterns, liked, disliked, most)
