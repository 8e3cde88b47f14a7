"""Diagnosis of a graph: content, coverage by question, diversity, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.functions import lexicons as lx
from causeway.functions import pairs, vectors
from causeway.operators import graph


def content(edges: DataFrame) -> DataFrame:
    """One row: coverage and mean length of mechanisms, property coverage, mean confidence, distinct properties."""
    blank = F.length(F.trim(F.coalesce("mechanism", F.lit("")))) == 0
    named = F.coalesce("affected_property", F.lit("")) != ""
    return edges.agg(
        F.count("*").alias("n_edges"),
        F.round(F.avg(F.when(blank, 0.0).otherwise(1.0)), 6).alias("mechanism_coverage"),
        F.round(F.coalesce(F.avg(F.when(~blank, F.length("mechanism"))), F.lit(0.0)), 6).alias("avg_mechanism_length"),
        F.round(F.avg(F.when(named, 1.0).otherwise(0.0)), 6).alias("property_coverage"),
        F.round(F.avg("confidence"), 6).alias("avg_confidence"),
        F.count_distinct(F.when(named, F.col("affected_property"))).alias("n_properties"),
    )


def first_properties(edges: DataFrame, most: int = 20) -> DataFrame:
    return edges.where("affected_property <> ''").select("affected_property").distinct().orderBy("affected_property").limit(most)


def questions(spark: SparkSession, rows: list[tuple[str, list[str], list[str]]] | None = None) -> DataFrame:
    """(query_id, type, keywords, target); the default questions if none are given."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows or lx.COVERAGE_QUESTIONS)], "query_id int, type string, keywords array<string>, target array<string>")


def coverage(edges: DataFrame, asked: DataFrame, max_hops: int = 4) -> DataFrame:
    """(query_id, type, n_paths, has_match) per question; questions without paths stay, with 0; an empty word matches
    every node."""
    labels = graph.nodes(edges)
    match = lambda c: graph.keyword_match_join(labels, asked.select("query_id", F.explode(c).alias("word")), empty_matches=True)
    paths = graph.simple_paths(edges, match("keywords"), match("target"), max_hops, ["query_id"])
    counts = paths.groupBy("query_id").agg(F.count("*").alias("n"))
    out = asked.select("query_id", "type").join(counts, "query_id", "left").withColumn("n_paths", F.coalesce("n", F.lit(0)))
    return out.select("query_id", "type", "n_paths", (F.col("n_paths") > 0).alias("has_match"))


def coverage_summary(covered: DataFrame) -> DataFrame:
    return covered.agg(
        F.count("*").alias("total_queries"), F.sum(F.col("has_match").cast("int")).alias("queries_with_match"), F.round(F.avg("n_paths"), 6).alias("avg_paths_per_query"),
        F.round(F.avg(F.col("has_match").cast("double")), 6).alias("coverage_rate"),
    )


#: Recommendations by number of edges and coverage.
RECOMMENDATIONS = [
    ("edges", 50, "CRITICAL: KG too small (<50 edges). Need 100-500 edges for meaningful evaluation."),
    ("edges", 100, "LOW: KG small (50-100 edges). Recommend enrichment to 200+ edges."),
    ("rate", 0.3, "MODERATE: Decent size but low coverage. Focus on improving coverage of common queries."),
    ("rate", 0.5, "GOOD: Good size and coverage. Can proceed with testing. Enrichment will improve results."),
]
ELSE = "EXCELLENT: High coverage. Proceed with testing confidently."


def gaps(n_edges: DataFrame, rate: DataFrame) -> DataFrame:
    """Edges and papers needed for 50, 70 and 90 per cent; null where nothing is covered yet.

    ``n_edges(edges)`` and ``rate(rate)`` are one row each."""
    rows = n_edges.join(rate).select("*", F.explode(F.array(F.lit(50), F.lit(70), F.lit(90))).alias("target_pct"))
    # the quotient first, as the counts are defined: truncation sees the same number
    needed = F.when(F.col("rate") > 0, (F.col("edges") * ((F.col("target_pct") / 100) / F.col("rate"))).cast("long"))
    rows = rows.withColumn("target_edges", needed).withColumn("additional_edges", F.greatest(F.lit(0), F.col("target_edges") - F.col("edges")))
    rows = rows.withColumn("additional_edges", F.when(F.col("target_edges").isNotNull(), F.col("additional_edges")))
    advice = F.lit(ELSE)
    for what, most, said in reversed(RECOMMENDATIONS):
        advice = F.when(F.col(what) < most, F.lit(said)).otherwise(advice)
    return rows.select(
        "target_pct", "target_edges", "additional_edges", F.expr("additional_edges div 5").alias("min_papers"), F.expr("additional_edges div 2").alias("max_papers"), advice.alias("recommendation")
    )


def diversity(vecs: DataFrame) -> DataFrame:
    """One row for ``vecs(label, vec)``: one minus the mean of the cosine matrix with a zero diagonal, over n squared.

    The sum over all ordered pairs of cosines is the squared length of the sum of the unit vectors, so no pair is
    made: one aggregation over (position, value) gives it at any size."""
    unit = vecs.select(vectors.normalised(F.col("vec")).alias("u"))
    sums = unit.select(F.posexplode("u").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s"))
    length = sums.agg(F.sum(F.col("s") * F.col("s")).alias("all_pairs"))
    own = unit.agg(F.count("*").alias("n"), F.sum(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x)).alias("self"))
    mean = F.when(F.col("n") > 1, (F.col("all_pairs") - F.col("self")) / (F.col("n") * F.col("n")))
    return length.join(own).select(F.col("n").alias("n_nodes"), F.round(F.coalesce(mean, F.lit(0.0)), 6).alias("avg_similarity"), F.round(F.when(F.col("n") > 1, 1 - mean).otherwise(0.0), 6).alias("diversity_score"))


def source_diversity(vecs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row for each group of ``keys`` (or one in all): as ``diversity`` over n (n - 1) ordered pairs, for the texts
    of one answer. Groups are summed position by position, so none is collected."""
    keys = keys or []
    unit = vecs.select(*keys, vectors.normalised(F.col("vec")).alias("u"))
    sums = unit.select(*keys, F.posexplode("u").alias("i", "x")).groupBy(*keys, "i").agg(F.sum("x").alias("s"))
    length = sums.groupBy(*keys).agg(F.sum(F.col("s") * F.col("s")).alias("all_pairs"))
    own = unit.groupBy(*keys).agg(F.count("*").alias("n"))
    mean = (F.col("all_pairs") - F.col("n")) / (F.col("n") * (F.col("n") - 1) + 1e-9)
    both = length.join(own, keys) if keys else length.join(own)
    return both.select(*keys, F.round(F.when(F.col("n") > 1, 1 - F.least(mean, F.lit(1.0))).otherwise(0.0), 6).alias("source_diversity"))


def pair_extremes(vecs: DataFrame, of: DataFrame, most: int = 5) -> DataFrame:
    """The most and the least similar pairs between a stated query set ``of(label, vec)`` and all other rows of ``vecs``;
    a pair of two queries counts once, from the smaller one."""
    marked = vecs.select("label", "vec").join(of.select("label", F.lit(True).alias("asked")).distinct(), "label", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    few = vectors._small(of.withColumnRenamed("label", "query_id"))
    kind = of.schema["label"].dataType.simpleString()
    scored = pairs.crossed(of.select("label", "vec"), marked, few, pairs.extremes(most), f"a {kind}, b {vecs.schema['label'].dataType.simpleString()}, score double, side string")
    highest = F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(-F.col("score"))  # as Spark orders it
    by = [F.when(F.col("side") == "most", highest).otherwise(F.col("score")).asc_nulls_last(), "a", "b"]
    return scored.withColumn("n", F.row_number().over(Window.partitionBy("side").orderBy(*by))).where(F.col("n") <= most).drop("n")


def type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("psp_type").agg(F.count("*").alias("n"))


def report(stats: DataFrame, content_: DataFrame, summary: DataFrame) -> DataFrame:
    """One text row of the main figures."""
    line = lambda label, c: F.concat(F.lit(label + ": "), c.cast("string"))
    return stats.join(content_.drop("n_edges")).join(summary).select(
        F.concat_ws("\n", F.lit("Graph report"), line("nodes", F.col("n_nodes")), line("edges", F.col("n_edges")), line("acyclic", F.col("is_dag")), line("mechanism coverage", F.col("mechanism_coverage")), line("coverage rate", F.col("coverage_rate"))).alias("report")
    )
