"""The facade: one object over an edge table that answers batches of questions in any mode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators import diagnostics, evidence, graph, literature, routing
from causeway.sources import kg
from causeway.sources.records import LiteratureSource

MODES = ("baseline", "naive", "core", "search", "full")
DIRECTIONS = ("forward", "inverse")
MESSAGE = "No graph loaded"


class Engine:
    """``edges`` is a normalised edge table (``kg.read``). ``papers(ord, title, citations, abstract)`` or a ``source``
    (``LiteratureSource``) serve the modes search and full; ``responder`` answers prompts. All are optional, with offline
    defaults; without papers and source the literature is empty."""

    def __init__(self, edges: DataFrame | None, mode: str = "core", responder: routing.Responder | None = None, papers: DataFrame | None = None, threshold: float = 0.5,
                 source: LiteratureSource | None = None, pause: Callable[[int], None] = routing.backoff):
        if mode not in MODES:
            raise ValueError(f"the mode must be one of {MODES}")
        if edges is None and mode != "baseline":
            raise ValueError(f"mode {mode} needs edges")
        self.edges, self.mode, self.responder, self.papers, self.threshold, self.source, self.pause = edges, mode, responder, papers, threshold, source, pause

    @classmethod
    def from_file(cls, spark: SparkSession, path: str | None, **options) -> Engine:
        """An engine over a graph file; the mode baseline needs none."""
        if path is None:
            return cls(None, **options)
        return cls(kg.read(spark, path), **options)

    def decisions(self, questions: DataFrame, direction: str) -> DataFrame:
        """Routing decisions; the baseline knows no evidence, and the naive mode takes every path of the words."""
        if direction not in DIRECTIONS:
            raise ValueError(f"the direction must be one of {DIRECTIONS}")
        if self.mode == "baseline":
            return questions.select(
                "query_id", F.lit(3).alias("tier"), F.lit(None).cast("string").alias("similar_node"), F.lit(0.0).alias("similarity"), F.expr("cast(array() as array<array<string>>)").alias("paths")
            )
        if self.mode == "naive":
            return graph.kept(routing.naive(questions, self.edges, direction))
        return routing.route(questions, self.edges, direction=direction, threshold=self.threshold)

    def literature(self, questions: DataFrame, decided: DataFrame, direction: str) -> DataFrame:
        """(query_id, ord, title, citations, abstract, ...) found for each question."""
        return literature.enrich(questions, decided, direction, self.source, self.papers)

    def answer(self, questions: DataFrame, direction: str = "forward") -> DataFrame:
        """(query_id, tier, confidence, reasoning_type, kg_paths_used, paths, response, demoted, latency_ms) for
        ``questions(query_id, params)``; in the modes search and full also ``literature``, in full also ``steps``."""
        decided = self.decisions(questions, direction)
        if self.mode in ("baseline", "naive"):
            found = decided.select("query_id", F.lit(None).cast("array<string>").alias("mechanisms"))
        else:
            found = routing.mechanisms_of(decided, self.edges, direction)
        style = self.mode if self.mode in ("baseline", "naive") else "tiers"
        prompted = routing.prompts(questions, decided, found, direction, style)
        papers = None
        if self.mode in ("search", "full") and (self.papers is not None or self.source is not None):
            papers = graph.kept(self.literature(questions, decided, direction))
            context = literature.contexts(papers)
            said = lambda c: F.concat_ws("\nLiterature:\n", c, "context").alias(c)
            prompted = prompted.join(context, "query_id", "left").select("query_id", "tier", said("prompt"), said("fallback"))
        answered = graph.kept(routing.respond(prompted, self.responder, pause=self.pause))
        out = routing.results(answered, decided)
        if papers is not None:
            out = literature.attached(out, papers)
        if self.mode == "full":
            none = papers if papers is not None else decided.select("query_id").limit(0)
            steps = routing.cot_steps(decided, none, out.where("reasoning_type <> 'error'"))
            listed = steps.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("step_id", "name", "confidence"))).alias("steps"))  # three each
            out = out.join(listed, "query_id", "left")
        return out

    def explain(self, questions: DataFrame, direction: str = "forward") -> DataFrame:
        """Sources of each answer: nodes and mechanisms of its paths; none without a graph."""
        decided = self.decisions(questions, direction)
        if self.edges is None:
            return decided.select("query_id", *[F.lit(None).cast(k).alias(n) for n, k in (("source_id", "string"), ("kind", "string"), ("content", "string"), ("confidence", "double"))]).limit(0)
        return routing.kg_sources(decided, self.edges, direction=direction)

    def ranked(self, start_words: list[str], end_words: list[str]) -> DataFrame:
        return evidence.rank_paths(graph.find_psp_paths(self.edges, start_words, end_words), self.edges)

    def diagnose(self, spark: SparkSession | None = None) -> DataFrame:
        """One row with the text report of the graph, or the word that there is none."""
        if self.edges is None:
            return (spark or SparkSession.active()).createDataFrame([(MESSAGE,)], "report string")
        summary = diagnostics.coverage_summary(diagnostics.coverage(self.edges, diagnostics.questions(self.edges.sparkSession)))
        return diagnostics.report(graph.stats(self.edges), diagnostics.content(self.edges), summary)
