"""Benchmark runs: every task with every model and mode, answers with their latency, and their metrics.

Answers are parsed in Spark. What the metrics take from evidence, counts of verified edges and claims and of grounded
steps, is worked out here from the graph and the literature; similarities come from an embedder of labels and texts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.engine import Engine
from causeway.functions import text as tx
from causeway.functions import vectors
from causeway.operators import diagnostics, evaluation, graph
from causeway.operators.routing import Responder, backoff

ANSWER = (
    "predicted_properties map<string,string>, suggested_synthesis_conditions map<string,string>, processing string, structure string, properties string, "
    "mechanistic_explanation struct<primary_mechanism:string,alternatives:string,chain_of_thought:array<string>>, quantities map<string,string>"
)
NONE = "cast(array() as array<string>)"


def evidence_counts(answers: DataFrame, edges: DataFrame | None) -> DataFrame:
    """``answers(answer_id, primary_mechanism, steps)`` with n_edges, n_edges_verified, n_claims, n_verified and
    n_grounded_steps.

    A causal edge of a step is verified if the graph leads from a node that holds its source to one that holds its target.
    A claim of the mechanism, or a step, is verified if one of its key terms (``key_terms``, in place of named entities)
    so leads to another. Without a graph nothing is. Equal claims of all answers are looked up once."""
    steps, primary = F.coalesce("steps", F.expr(NONE)), F.coalesce("primary_mechanism", F.lit(""))
    unit = lambda kind, text, ends: F.struct(F.lit(kind).alias("kind"), text.alias("unit"), ends.alias("ends"))
    said = answers.select(
        "answer_id",
        F.explode(F.concat(
            F.flatten(F.transform(steps, lambda s: F.transform(tx.causal_edges(s), lambda e: unit("edge", F.concat_ws("|", e["source"], e["target"]), F.array(e["source"], e["target"]))))),
            F.transform(tx.atomic_claims(primary), lambda c: unit("claim", c, tx.key_terms(c))),
            F.transform(steps, lambda s: unit("step", s, tx.key_terms(s))),
        )).alias("u"),
    ).select("answer_id", "u.*").withColumn("unit_id", F.xxhash64(F.col("kind") == "edge", "unit"))
    said = graph.kept(said)
    distinct = said.select("unit_id", "kind", "ends").dropDuplicates(["unit_id"])
    if edges is None:
        fine = distinct.select("unit_id").limit(0)
    else:
        claims = distinct.where("kind = 'edge'").select(F.col("unit_id").alias("claim_id"), F.col("ends")[0].alias("source"), F.col("ends")[1].alias("target"))
        led = graph.reachable_pairs(edges, claims).where("verified").select(F.col("claim_id").alias("unit_id"))
        fine = led.union(graph.connected(edges, distinct.where("kind <> 'edge'").select("unit_id", F.explode("ends").alias("term"))))
    marked = said.join(fine.withColumn("ok", F.lit(1)), "unit_id", "left").withColumn("ok", F.coalesce("ok", F.lit(0)))
    of = lambda kind: F.count_if(F.col("kind") == kind).cast("int")
    ok = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("ok"))), F.lit(0)).cast("int")
    counts = marked.groupBy("answer_id").agg(of("edge").alias("n_edges"), ok("edge").alias("n_edges_verified"), of("claim").alias("n_claims"), ok("claim").alias("n_verified"), ok("step").alias("n_grounded_steps"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_edges", "n_edges_verified", "n_claims", "n_verified", "n_grounded_steps")]
    return answers.join(counts, "answer_id", "left").select(*answers.columns, *zero)


def literature_entailment(answers: DataFrame, entails: Callable[[Column, Column], Column], most: int = 5) -> DataFrame:
    """``answers`` with ``entailment``: the mean of ``entails(evidence, mechanism)`` over the first pieces of evidence."""
    first = F.slice(F.coalesce("evidence", F.expr(NONE)), 1, most)
    values = F.transform(first, lambda e: entails(e, F.coalesce("primary_mechanism", F.lit(""))))
    return answers.withColumn("entailment", F.when(F.size(first) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(first)).otherwise(0.0))


def overlap_entailment(evidence: Column, mechanism: Column) -> Column:
    """The offline default: 1 where the evidence holds enough of the mechanism's words, else 0."""
    return F.when(tx.overlap_entails(mechanism, evidence), 1.0).otherwise(0.0)


def evidence_diversity(answers: DataFrame, embed: Callable[[Column], Column], most: int = 5) -> DataFrame:
    """``answers(answer_id, evidence, ...)`` with ``source_diversity`` of the first pieces of evidence; 0 with fewer than two."""
    first = answers.select("answer_id", F.explode(F.slice("evidence", 1, most)).alias("e")).select("answer_id", embed(F.col("e")).alias("vec"))
    return answers.join(diagnostics.source_diversity(first, ["answer_id"]), "answer_id", "left").withColumn("source_diversity", F.coalesce("source_diversity", F.lit(0.0)))


def parsed(results: DataFrame, embed: Callable[[Column], Column] = vectors.hashed_embedding) -> DataFrame:
    """Answers as ``evaluation.answer_metrics`` takes them, but for the counts of evidence, from ``results(answer_id,
    response, kg_paths_used, literature)``."""
    p = F.from_json("response", ANSWER)
    rows = results.withColumn("p", p).withColumn("steps", F.coalesce("p.mechanistic_explanation.chain_of_thought", F.expr(NONE)))
    primary = F.coalesce("p.mechanistic_explanation.primary_mechanism", F.lit(""))
    predictions = F.coalesce("p.predicted_properties", "p.suggested_synthesis_conditions")
    evidence = F.transform(F.coalesce("literature", F.expr("cast(array() as array<struct<title:string>>)")), lambda x: x["title"])
    rows = rows.withColumn("primary_mechanism", primary).withColumn("alternatives", F.coalesce("p.mechanistic_explanation.alternatives", F.lit("")))
    rows = rows.withColumn("predictions", predictions).withColumn("evidence", evidence)
    near = lambda a, b: vectors.cosine(embed(a), embed(b))
    named = F.array_join(F.coalesce(F.map_keys("predictions"), F.expr(NONE)), " ")
    there = lambda c: F.coalesce(F.length(F.col(c)) > 0, F.lit(False))
    return rows.select(
        "answer_id", there("p.processing").alias("has_processing"), there("p.structure").alias("has_structure"),
        (there("p.properties") | F.coalesce(F.size("predictions") > 0, F.lit(False))).alias("has_properties"), "primary_mechanism", "alternatives", "steps", F.col("p.quantities").alias("quantities"), "predictions", "evidence",
        near(F.col("primary_mechanism"), F.col("alternatives")).alias("alt_cosine"), near(F.col("primary_mechanism"), named).alias("prediction_cosine"),
        F.transform("steps", lambda s: F.coalesce(near(s, F.col("primary_mechanism")), F.lit(0.0))).alias("step_cosines"), F.size("evidence").alias("n_papers"), "kg_paths_used",
    )


def metrics(results: DataFrame, edges: DataFrame | None, embed: Callable[[Column], Column] = vectors.hashed_embedding, entails: Callable[[Column, Column], Column] | None = overlap_entailment) -> DataFrame:
    """All sub-scores of ``results(answer_id, response, kg_paths_used, literature)``. Claims count only for answers that
    used paths; ``entails`` says how far a piece of evidence bears a mechanism out, and without it entailment is 0."""
    answers = evidence_diversity(graph.kept(parsed(results, embed)), embed)
    answers = literature_entailment(answers, entails) if entails else answers.withColumn("entailment", F.lit(0.0))
    counted = evidence_counts(answers, edges).withColumn("n_verified", F.when(F.col("kg_paths_used") > 0, F.col("n_verified")).otherwise(0))
    return evaluation.answer_metrics(graph.kept(counted))  # the scores name their inputs many times over


def run(tasks: DataFrame, edges: DataFrame | None, models: dict[str, Responder | None], modes: list[str], papers: DataFrame | None = None, threshold: float = 0.5, pause: Callable[[int], None] = backoff, embed: Callable[[Column], Column] = vectors.hashed_embedding, entails: Callable[[Column, Column], Column] | None = overlap_entailment) -> DataFrame:
    """One row for each of ``tasks(task_id, direction, params)``, model and mode: tier, confidence, latency and metrics.

    ``models`` and ``modes`` are stated, short lists; the tasks of a model and mode are answered together."""
    parts = []
    for model, responder in models.items():
        for mode in modes:
            engine = Engine(None if mode == "baseline" else edges, mode, responder, papers, threshold, pause=pause)
            for direction in ("forward", "inverse"):
                asked = tasks.where(F.col("direction") == direction).select(F.col("task_id").alias("query_id"), "params")
                if asked.isEmpty():
                    continue
                out = engine.answer(asked, direction)
                lit = F.transform("literature", lambda x: F.struct(x["title"].alias("title"))) if "literature" in out.columns else F.expr("cast(array() as array<struct<title:string>>)")
                parts.append(out.select(F.col("query_id").alias("task_id"), F.lit(model).alias("model"), F.lit(mode).alias("mode"), "tier", "confidence", "reasoning_type", "demoted", "latency_ms", "kg_paths_used", "response", lit.alias("literature")))
    every = graph.kept(reduce(DataFrame.union, parts).withColumn("answer_id", F.concat_ws("|", "task_id", "model", "mode")))
    scores = metrics(every.select("answer_id", "response", "kg_paths_used", "literature"), edges, embed, entails)
    return every.drop("response", "literature").join(scores, "answer_id").drop("answer_id")
