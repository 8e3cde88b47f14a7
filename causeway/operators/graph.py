"""Graph operators over an edge table ``edges(src, dst, ...)``.

Paths (``paths``) and components (``components``) are joins over (src, dst) only; whatever else an edge carries is fetched
once they are known.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions import lexicons as lx
from causeway.functions.text import contains_any, node_layer
from causeway.operators.components import levels, strong_components, weak_components
from causeway.operators.paths import best_paths, pairs, simple_paths
from causeway.operators.storage import free, kept


def last_wins(edges: DataFrame, order: str = "ord") -> DataFrame:
    """One row per (src, dst): the one that comes last by ``order``."""
    by = Window.partitionBy("src", "dst").orderBy(F.desc(order))
    return edges.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("label")).union(edges.select(F.col("dst").alias("label"))).distinct()


def reverse(edges: DataFrame) -> DataFrame:
    others = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *others)


def keyword_match(labels: DataFrame, words: list[str], skip_empty: bool = False) -> DataFrame:
    """Labels that hold one of ``words`` anywhere, in any case. No word matches nothing; an empty word matches
    everything, unless ``skip_empty``."""
    own = [w for w in words if w] if skip_empty else list(words)
    return labels.where(contains_any(F.col("label"), own))


MOST_SHORT = 10_000


def keyword_match_join(labels: DataFrame, words: DataFrame, empty_matches: bool = False) -> DataFrame:
    """(query_id, label) for ``words(query_id, word)``: the batch form of ``keyword_match``. Null words match
    nothing, and nor do empty ones, unless ``empty_matches``: then they match all labels.

    Words meet labels through an index of three-letter pieces: a word is looked up under that piece of it which the
    fewest labels hold, and the match is then verified, so no word meets all labels. Words of one or two letters, which
    have no piece, are few by their nature; they are sent to the labels, in their number checked."""
    low = labels.select("label", F.lower("label").alias("low")).distinct()
    asked = words.where("word is not null and word <> ''").select("query_id", F.lower("word").alias("word")).distinct()
    pieces = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3))))
    index = low.where(F.length("low") >= 3).select("label", "low", F.explode(pieces(F.col("low"))).alias("piece"))
    sizes = index.groupBy("piece").agg(F.count("*").alias("n"))
    distinct = asked.select("word").distinct()
    own = distinct.where(F.length("word") >= 3).select("word", F.explode(pieces(F.col("word"))).alias("piece"))
    rarest = own.join(sizes, "piece").groupBy("word").agg(F.min(F.struct("n", "piece")).alias("r")).select("word", F.col("r.piece").alias("piece"))
    met = index.join(rarest, "piece").where(F.contains("low", "word")).select("word", "label")
    short = distinct.where(F.length("word") < 3)
    few = short.limit(MOST_SHORT + 1).count()
    if few:
        met = met.union(low.join(F.broadcast(short) if few <= MOST_SHORT else short, F.contains("low", "word")).select("word", "label"))
    found = asked.join(met, "word").select("query_id", "label")
    if empty_matches:
        every = words.where("word = ''").select("query_id").distinct()
        found = found.union(every.crossJoin(labels.select("label")))  # that product is what is asked for
    return found.distinct()


def roots(edges: DataFrame) -> DataFrame:
    return nodes(edges).join(edges.select(F.col("dst").alias("label")).distinct(), "label", "left_anti")


def leaves(edges: DataFrame) -> DataFrame:
    return nodes(edges).join(edges.select(F.col("src").alias("label")).distinct(), "label", "left_anti")


def intermediates(edges: DataFrame) -> DataFrame:
    starts, ends = edges.select(F.col("src").alias("label")).distinct(), edges.select(F.col("dst").alias("label")).distinct()
    return starts.join(ends, "label", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """(label, n_in, n_out, degree) per node, from one pass over the edges."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("src").alias("label"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("label"), F.lit(1).alias("i"), F.lit(0).alias("o")))))
    return ends.groupBy("label").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"), F.count("*").alias("degree"))


def paths_recursive(edges: DataFrame, max_hops: int = 4) -> DataFrame:
    """All simple paths by a recursive query: the SQL form, for deep hops on small graphs (Spark bounds the rows of a
    recursion by ``spark.sql.cteRecursionRowLimit``, and fails beyond)."""
    view = f"steps_{uuid.uuid4().hex}"
    pairs(edges).createOrReplaceTempView(view)
    out = edges.sparkSession.sql(
        f"""WITH RECURSIVE w AS (
              SELECT array(src, dst) AS path, dst AS last, 1 AS hops FROM {view}
              UNION ALL
              SELECT array_append(path, s.dst), s.dst, hops + 1 FROM w JOIN {view} s ON s.src = w.last
              WHERE hops < {int(max_hops)} AND NOT array_contains(path, s.dst))
            SELECT path FROM w"""
    )
    edges.sparkSession.catalog.dropTempView(view)  # the plan holds what it needs
    return out


def find_psp_paths(edges: DataFrame, start_words: list[str], end_words: list[str], max_hops: int = 4, reversed_: bool = False, most: int | None = None) -> DataFrame:
    """Simple paths between nodes that match start and end words; on the reversed edges if asked. With ``most`` only the
    first ones, as ``best_paths`` orders them."""
    graph = reverse(edges) if reversed_ else edges
    labels = nodes(graph)
    starts, ends = keyword_match(labels, start_words), keyword_match(labels, end_words)
    return simple_paths(graph, starts, ends, max_hops) if most is None else best_paths(graph, starts, ends, most, max_hops)


def first_paths(paths: DataFrame, most: int = 10, keys: list[str] | None = None) -> DataFrame:
    """The ``most`` shortest of some ``paths`` (per key), ties by their text: a fixed choice where any would do."""
    text = F.array_join("path", " -> ")
    if not keys:
        return paths.orderBy(F.size("path"), text).limit(most)
    by = Window.partitionBy(*keys).orderBy(F.size("path"), text)
    return paths.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)


def label_words(labels: DataFrame) -> DataFrame:
    return labels.select(F.explode(F.split("label", r"\s+")).alias("word")).where("word <> ''").distinct()


def paths_for_query(edges: DataFrame, words: list[str], direction: str = "forward", max_hops: int = 4) -> DataFrame:
    """Paths between nodes that match ``words`` and nodes that match a word of any leaf (forward) or root (inverse).

    Inverse paths run on the reversed edges, from the matches to the root words."""
    graph = edges if direction == "forward" else reverse(edges)
    labels = nodes(graph)
    targets = label_words(leaves(graph)).withColumn("query_id", F.lit(0))
    ends = keyword_match_join(labels, targets).select("label")
    return simple_paths(graph, keyword_match(labels, words), ends, max_hops)


def closure(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(src, dst) for every dst that can be reached from src by one or more edges; from ``starts(label)`` only if
    given. A frontier loop: each round joins only the pairs found in the last one."""
    steps = kept(edges.select("src", "dst").distinct())
    known = frontier = kept(steps if starts is None else steps.join(starts.select(F.col("label").alias("src")).distinct(), "src", "left_semi"))
    while not frontier.isEmpty():
        onward = frontier.select("src", F.col("dst").alias("via")).join(steps.withColumnRenamed("src", "via"), "via").select("src", "dst").distinct()
        frontier = kept(onward.join(known, ["src", "dst"], "left_anti"))
        known = known.unionByName(frontier)
    free(steps)
    return known


def peel(edges: DataFrame) -> DataFrame:
    """(label, level) of the nodes that Kahn's peeling removes: the longest path to a node from a root, in edges.
    Nodes on or behind a cycle stay out."""
    return levels(edges)


def is_dag(edges: DataFrame, peeled: DataFrame | None = None) -> DataFrame:
    """One row: whether no cycle is left after peeling."""
    peeled = peel(edges) if peeled is None else peeled
    return nodes(edges).agg(F.count("*").alias("n")).join(peeled.agg(F.count("*").alias("m"))).select((F.col("n") == F.col("m")).alias("is_dag"))


def longest_path(edges: DataFrame, peeled: DataFrame | None = None) -> DataFrame:
    """One row: nodes on the longest path; 0 for a graph with a cycle."""
    levels = (peel(edges) if peeled is None else peeled).agg(F.count("*").alias("m"), F.max("level").alias("top"))
    return nodes(edges).agg(F.count("*").alias("n")).join(levels).select(F.when(F.col("n") == F.col("m"), F.coalesce("top", F.lit(-1)) + 1).otherwise(0).cast("long").alias("longest_path"))


def density(edges: DataFrame) -> DataFrame:
    n = nodes(edges).agg(F.count("*").alias("n_nodes"))
    m = edges.select("src", "dst").distinct().agg(F.count("*").alias("n_edges"))
    value = F.when(F.col("n_nodes") > 1, F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))).otherwise(0.0)
    return n.join(m).select("n_nodes", "n_edges", F.round(value, 9).alias("density"))


def cycles(edges: DataFrame, max_hops: int = 4) -> DataFrame:
    """Simple cycles of up to ``max_hops`` edges, each once, from its smallest node on and back to it."""
    steps = edges.select("src", "dst").distinct()
    now = steps.select(F.array("src").alias("path"), F.col("dst").alias("last"))
    found = []
    for hop in range(max_hops):
        found.append(now.where(F.col("last") == F.col("path")[0]).select(F.array_append("path", F.col("last")).alias("path")))
        if hop + 1 < max_hops:
            # the first node stays the smallest, so each cycle is walked once
            now = now.where((F.col("last") > F.col("path")[0]) & ~F.array_contains("path", F.col("last"))).join(steps.where("true").toDF("src", "next"), F.col("last") == F.col("src")).select(F.array_append("path", F.col("last")).alias("path"), F.col("next").alias("last"))
    return reduce(DataFrame.union, found)


def top_nodes(edges: DataFrame, most: int = 10) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "label").limit(most)


def induced(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges with both ends among ``labels``."""
    return edges.join(labels.select(F.col("label").alias("src")), "src", "left_semi").join(labels.select(F.col("label").alias("dst")), "dst", "left_semi")


def neighbours(edges: DataFrame, label: Column | str) -> DataFrame:
    at = F.lit(label) if isinstance(label, str) else label
    out = edges.where(F.col("src") == at).select(F.col("dst").alias("label"), F.lit("out").alias("side"))
    return out.union(edges.where(F.col("dst") == at).select(F.col("src").alias("label"), F.lit("in").alias("side"))).distinct()


def complete_chains(edges: DataFrame) -> DataFrame:
    """(processing, structure, property) of every P-to-S edge that an S-to-P edge goes on from."""
    ps = edges.where("psp_type = 'Processing_to_Structure'").select(F.col("src").alias("processing"), F.col("dst").alias("structure"))
    sp = edges.where("psp_type = 'Structure_to_Property'").select(F.col("src").alias("structure"), F.col("dst").alias("property"))
    return ps.join(sp, "structure").select("processing", "structure", "property")


def shortcuts(edges: DataFrame) -> DataFrame:
    return edges.where("psp_type = 'Processing_to_Property'")


def edges_through(edges: DataFrame) -> DataFrame:
    """Incoming and outgoing edges of each node by type."""
    return edges.select(F.inline(F.array(F.struct(F.col("src").alias("label"), F.lit("out").alias("side"), "psp_type"), F.struct(F.col("dst").alias("label"), F.lit("in").alias("side"), "psp_type")))).groupBy("label", "side", "psp_type").agg(F.count("*").alias("n"))


def without_share(edges: DataFrame, percent: int) -> DataFrame:
    """The edges left after about ``percent`` per cent are deleted, by a hash of their ends: the same ones each time,
    and those deleted at a smaller share are deleted at a larger one."""
    bucket = F.conv(F.substring(F.md5(F.concat_ws("|", "src", "dst")), 1, 8), 16, 10).cast("long") % 100
    return edges.where(bucket >= percent)


def filtered(edges: DataFrame, material: str | None = None, types: list[str] | None = None, least_confidence: float = 0.0) -> DataFrame:
    """Edges that an explorer shows: of one material or all, of some types, from a confidence on."""
    out = edges.where(F.col("confidence") >= least_confidence)
    if material is not None:
        out = out.where(F.col("material") == material)
    return out if types is None else out.where(F.col("psp_type").isin(types))


def active(edges: DataFrame, layers: list[str] | None = None, lexicon: dict[str, list[str]] = lx.NODE_KEYWORDS) -> DataFrame:
    """(label, layer, degree) of the nodes that shown edges touch, of some layers or all: the nodes of an explorer."""
    out = degrees(edges).select("label", node_layer(F.col("label"), lexicon).alias("layer"), "degree")
    return out if layers is None else out.where(F.col("layer").isin(layers))


def reachable_pairs(edges: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims (claim_id, source, target) with whether any node matching the source reaches any matching the target, or
    is one itself. Null and empty names match nothing.

    The walk starts from the claims' nodes and goes on for a claim until it is verified or has nowhere to go."""
    labels = nodes(edges)
    match = lambda c: keyword_match_join(labels, claims.select(F.col("claim_id").alias("query_id"), F.col(c).alias("word"))).withColumnRenamed("query_id", "claim_id")
    verified = _met(edges, kept(match("source")), kept(match("target")), "claim_id", lambda front, ends: front.join(ends, ["claim_id", "label"], "left_semi"))
    return claims.join(verified.withColumn("verified", F.lit(True)), "claim_id", "left").withColumn("verified", F.coalesce("verified", F.lit(False)))


def connected(edges: DataFrame, terms: DataFrame) -> DataFrame:
    """(unit_id) of the units among ``terms(unit_id, term)`` of which one term leads to another: a node that holds the one
    reaches a node that holds the other, or is it. No pair of terms is made: each unit walks from its terms' nodes until
    it meets a node of another term."""
    distinct = kept(terms.where("term is not null and term <> ''").select("unit_id", "term").distinct())
    met = keyword_match_join(nodes(edges), distinct.select(F.col("term").alias("query_id"), F.col("term").alias("word"))).withColumnRenamed("query_id", "term")
    at = kept(distinct.join(met, "term").select("unit_id", "term", "label"))
    free(distinct)
    return _met(edges, at, at, "unit_id", lambda front, ends: front.join(ends.withColumnRenamed("term", "other"), ["unit_id", "label"]).where("term <> other"))


def _met(edges: DataFrame, front: DataFrame, ends: DataFrame, key: str, meet: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """The distinct ``key`` of which a walk along the edges from ``front`` (the key, label, and what else tells walks
    apart) meets ``ends``. A key that has met walks no further; each round is two tables."""
    steps, own = kept(pairs(edges)), [c for c in front.columns if c != "label"]
    seen, rounds, found = front, [front], []
    while True:
        new = kept(meet(front, ends).select(key).distinct())
        found.append(new)
        onward = front.join(new, key, "left_anti").withColumnRenamed("label", "src").join(steps, "src").select(*own, F.col("dst").alias("label")).distinct()
        front = kept(onward.join(seen, [*own, "label"], "left_anti"))
        if front.isEmpty():
            break
        rounds.append(front)
        seen = seen.unionByName(front)
    out = kept(reduce(DataFrame.unionByName, found).distinct())
    free(front, steps, ends, *rounds, *found)
    return out


def stats(edges: DataFrame) -> DataFrame:
    """One row of counts, degrees, density, components and acyclicity."""
    peeled, d = peel(edges), kept(degrees(edges))
    base = d.agg(
        F.count("*").alias("n_nodes"), F.round(F.avg("degree"), 9).alias("avg_degree"), F.max("n_in").alias("max_in"), F.max("n_out").alias("max_out"),
        F.sum(F.when((F.col("n_in") == 0), 1).otherwise(0)).alias("n_roots"), F.sum(F.when(F.col("n_out") == 0, 1).otherwise(0)).alias("n_leaves"),
        F.sum(F.when((F.col("n_in") > 0) & (F.col("n_out") > 0), 1).otherwise(0)).alias("n_intermediate"),
    )
    count_of = lambda c, name: c.agg(F.count_distinct("component").alias(name))
    acyclic = peeled.count() == d.count()  # then each node is a strong component of its own
    strong = d.select(F.col("label").alias("component")) if acyclic else strong_components(edges)
    return base.join(density(edges).drop("n_nodes")).join(is_dag(edges, peeled)).join(count_of(weak_components(edges), "n_weak")).join(count_of(strong, "n_strong")).join(longest_path(edges, peeled))


def samples(edges: DataFrame, most: int = 10) -> DataFrame:
    """(side, label): the first ``most`` roots, leaves and nodes in between, by label: what a report shows of each."""
    parts = [f(edges).orderBy("label").limit(most).select(F.lit(name).alias("side"), "label") for name, f in (("root", roots), ("leaf", leaves), ("between", intermediates))]
    return reduce(DataFrame.union, parts)
