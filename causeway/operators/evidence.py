"""Evidence along paths: mechanisms, layer coverage, completeness and ranking. ``paths`` hold ``path`` arrays and
any key columns; attributes of edges are joined in only here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions import lexicons as lx
from causeway.functions.text import layers_covered, literals, path_layers


def path_edges(paths: DataFrame) -> DataFrame:
    """One row per edge of each path: (columns of paths, step, src, dst)."""
    steps = F.transform(F.slice("path", 1, F.size("path") - 1), lambda x, i: F.struct(x.alias("src"), F.col("path")[i + 1].alias("dst")))
    return paths.select("*", F.posexplode(steps).alias("step", "e")).select("*", "e.src", "e.dst").drop("e")


def mechanisms(paths: DataFrame, edges: DataFrame, nonblank: bool = False, flipped: bool = False) -> DataFrame:
    """Edge evidence in path order, repeats kept; edges that are not there are skipped. ``flipped``: paths run against
    the edges, as those of a search on the reversed graph do."""
    here = path_edges(paths)
    attributes = edges.select("src", "dst", "mechanism", "affected_property", "confidence")
    if flipped:
        attributes = attributes.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "mechanism", "affected_property", "confidence")
    out = here.join(attributes, ["src", "dst"])
    return out.where(F.length(F.trim("mechanism")) > 0) if nonblank else out


def with_layers(paths: DataFrame, lexicon: dict[str, list[str]] = lx.NODE_KEYWORDS) -> DataFrame:
    return paths.withColumn("layers", path_layers(F.col("path"), lexicon))


def with_edge_layers(paths: DataFrame, edges: DataFrame, lexicon: dict[str, list[str]] = lx.NODE_KEYWORDS) -> DataFrame:
    """(path, covered): layers of the nodes, and Structure or Property where an edge's type names it."""
    typed = path_edges(paths.select("path").distinct()).join(edges.select("src", "dst", "psp_type"), ["src", "dst"], "left")
    named = typed.groupBy("path").agg(F.max(F.col("psp_type").contains("Structure")).alias("s"), F.max(F.col("psp_type").contains("Property")).alias("p"))
    more = F.filter(F.array(F.when(F.col("s"), F.lit("Structure")), F.when(F.col("p"), F.lit("Property"))), lambda x: x.isNotNull())
    covered = F.array_intersect(literals(lx.LAYERS), F.array_union(layers_covered(F.col("path"), lexicon), more))
    return named.select("path", covered.alias("covered"))


def completeness_of(covered: Column, required: Column) -> Column:
    return F.size(F.array_intersect(covered, required)) / F.size(required)


def completeness(queries: DataFrame, paths: DataFrame, lexicon: dict[str, list[str]] = lx.NODE_KEYWORDS) -> DataFrame:
    """Per query of (query_id, required): the share of required layers that its paths cover together, and the missing
    layers. Queries without paths have 0."""
    seen = paths.select("query_id", F.explode(layers_covered(F.col("path"), lexicon)).alias("layer")).distinct()
    covered = seen.groupBy("query_id").agg(F.collect_set("layer").alias("c"))  # three layers at most
    full = F.array_intersect(literals(lx.LAYERS), F.coalesce("c", F.expr("cast(array() as array<string>)")))
    out = queries.join(covered, "query_id", "left").withColumn("covered", full)
    return out.select(*queries.columns, "covered", completeness_of(F.col("covered"), F.col("required")).alias("completeness"), F.array_except("required", "covered").alias("missing"))


def per_path_completeness(paths: DataFrame, required: Column, lexicon: dict[str, list[str]] = lx.NODE_KEYWORDS) -> DataFrame:
    return paths.withColumn("completeness", completeness_of(layers_covered(F.col("path"), lexicon), required))


def path_scores(paths: DataFrame, edges: DataFrame, lexicon: dict[str, list[str]] = lx.NODE_KEYWORDS) -> DataFrame:
    """(keys, path, confidence, richness, coverage): mean confidence of the edges (1 where an edge or its confidence is
    missing), share of edges with a mechanism, share of layers covered. A path of one node has 0, 0 and its layer."""
    keys = [c for c in paths.columns if c != "path"]
    attributes = edges.select("src", "dst", F.col("confidence").alias("__c"), F.col("mechanism").alias("__m"))
    steps = path_edges(paths).join(attributes, ["src", "dst"], "left")
    rated = steps.groupBy(*keys, "path").agg(
        F.avg(F.coalesce("__c", F.lit(1.0))).alias("confidence"), F.avg(F.when(F.length(F.trim("__m")) > 0, 1.0).otherwise(0.0)).alias("richness")
    )
    single = paths.where(F.size("path") < 2).select(*keys, "path", F.lit(0.0).alias("confidence"), F.lit(0.0).alias("richness"))
    return rated.unionByName(single).withColumn("coverage", F.size(layers_covered(F.col("path"), lexicon)) / 3)


def rank_paths(paths: DataFrame, edges: DataFrame, weights: dict[str, float] | None = None, lexicon: dict[str, list[str]] = lx.NODE_KEYWORDS) -> DataFrame:
    """``path_scores`` with the weighted score; order by it descending, ties by the path's text."""
    w = weights or lx.PATH_WEIGHTS
    return path_scores(paths, edges, lexicon).withColumn("score", sum((F.lit(w[k]) * F.col(k) for k in ("confidence", "richness", "coverage")), F.lit(0.0)))


def text_of(path: str = "path") -> Column:
    return F.array_join(path, " -> ")
