"""Which of two nodes leads to the other, for pairs that are asked, without the closure of all pairs.

The graph's strong components form a graph without cycles. Each component has numbers by several hashes: the smallest
hash among the components that it leads to, and among those that lead to it, itself included in both. Where a leads to b,
everything that b leads to is led to by a, so a's first number is at most b's, and b's second at most a's, by every hash;
and a's level is below b's. One number that says otherwise settles a pair. The other pairs are searched, along components
only that the same numbers allow.

Nodes inside a run that lies together (``runs``) are not indexed: what they lead to is the rest of their run and what its
end leads to. Pairs within a run are told by their places, others asked of the runs' ends.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.operators.components import doubled, ends_of, in_and_out, levels, strong_components
from causeway.operators.runs import contracted
from causeway.operators.storage import free, kept


def least_ahead(edges: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """(label, columns) for ``values(label, columns)`` over a graph without cycles: the smallest value among a node and all
    that it leads to. Nodes without an edge keep theirs.

    By rounds, like ``levels``: runs become edges whose values go to the node before them, nodes without a way out give
    theirs to those before them, nodes without a way in wait for those behind them."""
    least = lambda rows: rows.groupBy("label").agg(*[F.min(c).alias(c) for c in columns])
    left, own = kept(edges.where("src <> dst").select("src", "dst").distinct(), "left"), kept(values.select("label", *columns), "own")
    done: list[tuple[str, DataFrame]] = [("own", kept(own.join(ends_of(left), "label", "left_anti"), "own"))]
    while True:
        degrees = kept(in_and_out(left), "degrees")
        n, n_sinks, n_inner = degrees.agg(F.count("*"), F.count_if(F.expr("n_out = 0")), F.count_if(F.expr("n_in = 1 and n_out = 1"))).first()
        if not n:
            break
        if not n_sinks:
            raise ValueError("the graph has a cycle")
        outer, gains = left, [own.join(degrees.where("n_in <> 1 or n_out <> 1").select("label"), "label", "left_semi")]
        if n_inner:
            outer, more = _values_of_runs(left, degrees, own, columns, done)
            gains.append(more)
        outer = kept(outer.select("src", "dst").distinct(), "outer")
        sinks, roots = degrees.where("n_out = 0").select("label"), degrees.where("n_in = 0 and n_out > 0").select("label")
        before = outer.join(own.withColumnRenamed("label", "dst").join(sinks.withColumnRenamed("label", "dst"), "dst", "left_semi"), "dst")
        gains.append(before.select(F.col("src").alias("label"), *columns))
        after_own = kept(least(reduce(DataFrame.unionByName, gains)), "own")
        done.append(("own", kept(after_own.join(sinks, "label", "left_semi"), "own")))
        rest = outer.join(sinks.withColumnRenamed("label", "dst"), "dst", "left_anti")
        ways = rest.join(roots.withColumnRenamed("label", "src"), "src", "left_semi").select(F.col("src").alias("label"), "dst")
        done.append(("wait", kept(after_own.join(roots, "label", "left_semi").join(ways, "label", "left"), "wait")))
        after = kept(rest.join(roots.withColumnRenamed("label", "src"), "src", "left_anti").select("src", "dst"), "left")
        bare = degrees.where("n_in > 0 and n_out > 0 and (n_in > 1 or n_out > 1)").select("label").join(ends_of(after), "label", "left_anti")
        done.append(("own", kept(after_own.join(bare, "label", "left_semi"), "own")))
        free(outer, left, degrees, own)
        left, own = after, after_own
    free(degrees, left, own)
    known: list[DataFrame] = []
    for kind, table in reversed(done):
        if kind == "own":
            known.append(table)
            continue
        found = reduce(DataFrame.unionByName, known).select(F.col("label").alias("dst"), *[F.col(c).alias(f"{c}_of") for c in columns])
        known.append(kept(table.join(found, "dst", "left").groupBy("label").agg(*[F.least(F.min(c), F.min(f"{c}_of")).alias(c) for c in columns]), "own"))
    out = kept(reduce(DataFrame.unionByName, known), "least")
    free(*(t for _, t in done), *known)
    return out


def _values_of_runs(left: DataFrame, degrees: DataFrame, own: DataFrame, columns: list[str], done: list[tuple[str, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """``left`` with an edge in place of each run, and the values that a run gives to the node before it."""
    inner = degrees.where("n_in = 1 and n_out = 1").select("label")
    named = lambda c: inner.select(F.col("label").alias(c))
    steps = left.join(named("src"), "src", "left_semi").select(F.col("src").alias("label"), F.col("dst").alias("next")).join(own, "label")
    steps = steps.join(named("next").withColumn("inner", F.lit(True)), "next", "left")
    inside = F.coalesce("inner", F.lit(False))
    first = steps.select("label", F.when(inside, F.col("next")).otherwise(F.col("label")).alias("last"), (~inside).alias("over"), *columns)
    walked = doubled(first, {f"{c}_of": F.col(c) for c in columns}, {c: F.least(c, f"{c}_of") for c in columns})
    ends = steps.where(~inside).select(F.col("label").alias("last"), F.col("next").alias("dst"))
    # of a node inside: the least of the run from it on, and what the run leads to
    runs = kept(walked.join(ends, "last").select("label", "dst", *columns), "runs")
    free(walked)
    done.append(("wait", runs))
    into = left.join(named("dst"), "dst", "left_semi").join(named("src"), "src", "left_anti").select(F.col("src").alias("a"), F.col("dst").alias("label"))
    heads = runs.join(into, "label")
    outer = left.join(named("src"), "src", "left_anti").join(named("dst"), "dst", "left_anti").select("src", "dst")
    return outer.unionByName(heads.select(F.col("a").alias("src"), "dst")), heads.select(F.col("a").alias("label"), *columns)


class ReachIndex:
    """``inside(label, a, b, run, w)`` of the nodes inside runs; ``nodes(label, component, many, ...)`` of all others, with
    their component's level and ``hashes`` pairs of numbers, which ``labels`` has by component."""

    def __init__(self, edges: DataFrame, hashes: int = 3):
        self.ahead, self.behind = [f"f{i}" for i in range(hashes)], [f"g{i}" for i in range(hashes)]
        self.inside, edges, self.table = contracted(edges)
        found = strong_components(edges)
        sizes = found.groupBy("component").agg(F.count("*").alias("n"))
        loops = edges.where("src = dst").select(F.col("src").alias("label"), F.lit(True).alias("loop")).distinct()
        members = found.join(sizes, "component").join(loops, "label", "left").select("label", "component", ((F.col("n") > 1) | F.coalesce("loop", F.lit(False))).alias("many"))
        of = lambda c: found.select(F.col("label").alias(c), F.col("component").alias(f"{c}_of"))
        self.steps = kept(edges.join(of("src"), "src").join(of("dst"), "dst").where("src_of <> dst_of").select(F.col("src_of").alias("src"), F.col("dst_of").alias("dst")).distinct(), "steps")
        names = found.select(F.col("component").alias("label")).distinct()
        hashed = lambda columns: names.select("label", *[F.xxhash64("label", F.lit(i)).alias(c) for i, c in enumerate(columns)])
        ahead = least_ahead(self.steps, hashed(self.ahead), self.ahead)
        behind = least_ahead(self.steps.select(F.col("dst").alias("src"), F.col("src").alias("dst")), hashed(self.behind), self.behind)
        level = levels(self.steps)
        self.labels = kept(names.join(ahead, "label").join(behind, "label").join(level, "label", "left").withColumn("level", F.coalesce("level", F.lit(0))), "labels")
        self.nodes = kept(members.join(self.labels.withColumnRenamed("label", "component"), "component"), "nodes")
        free(found, ahead, behind, level)

    def _of(self, at: str, mark: str) -> DataFrame:
        return self.labels.select(F.col("label").alias(at), *[F.col(c).alias(f"{mark}{c}") for c in (*self.ahead, *self.behind, "level")])

    def _may(self, a: str, b: str) -> Column:
        """Whether the numbers marked ``a`` allow a way to those marked ``b``."""
        tests = [F.col(f"{a}level") < F.col(f"{b}level"), *[F.col(f"{a}{c}") <= F.col(f"{b}{c}") for c in self.ahead], *[F.col(f"{b}{c}") <= F.col(f"{a}{c}") for c in self.behind]]
        return reduce(lambda x, y: x & y, tests)

    def reaches(self, asked: DataFrame) -> DataFrame:
        """(a, b, reaches, by) per distinct row of ``asked(a, b)``: whether one or more edges lead from a to b, and what told:
        ``run`` (their places in a run), ``component`` (one component, or a node that is not in the graph), ``labels`` or
        ``search``; where ends of runs were asked, what told of these."""
        of = lambda c, port: self.inside.select(F.col("label").alias(c), F.col(port).alias(f"{c}_port"), F.col("run").alias(f"{c}_run"), F.col("w").alias(f"{c}_w"))
        rows = asked.select("a", "b").distinct().join(of("a", "b"), "a", "left").join(of("b", "a"), "b", "left")
        inside = F.col("a_run").isNotNull() | F.col("b_run").isNotNull()
        ports = [F.coalesce("a_port", "a").alias("from"), F.coalesce("b_port", "b").alias("to")]
        on = F.when((F.col("a_run") == F.col("b_run")) & (F.col("a_w") < F.col("b_w")), True).when(inside & (ports[0] == ports[1]), True)
        rows = kept(rows.select("a", "b", *ports, on.alias("on")), "asked")
        told, tables = self._told(rows.where("on is null").select(F.col("from").alias("a"), F.col("to").alias("b")).distinct())
        told = told.select(F.col("a").alias("c"), F.col("b").alias("d"), "reaches", "by")
        same = F.col("from").eqNullSafe(F.col("c")) & F.col("to").eqNullSafe(F.col("d"))
        open_ = rows.where("on is null").join(told, same).select("a", "b", "reaches", "by")
        out = kept(rows.where("on").select("a", "b", F.col("on").alias("reaches"), F.lit("run").alias("by")).unionByName(open_), "reaches")
        free(rows, *tables)
        return out

    def _told(self, asked: DataFrame) -> tuple[DataFrame, tuple[DataFrame, ...]]:
        """``reaches`` for nodes that are inside no run, or not in the graph, and the tables that it reads."""
        numbers = [*self.ahead, *self.behind, "level"]
        of = lambda c: self.nodes.select(F.col("label").alias(c), F.col("component").alias(f"{c}_of"), F.col("many").alias(f"{c}_many"), *[F.col(n).alias(f"{c}_{n}") for n in numbers])
        rows = asked.join(of("a"), "a", "left").join(of("b"), "b", "left")
        alike = F.col("a_of") == F.col("b_of")
        told = F.when(F.col("a_of").isNull() | F.col("b_of").isNull(), F.lit(False)).when(alike, F.col("a_many")).when(~self._may("a_", "b_"), F.lit(False))
        rows = kept(rows.select("a", "b", "a_of", "b_of", told.alias("reaches"), F.coalesce(alike, F.lit(True)).alias("alike")), "told")
        open_ = rows.where("reaches is null").select(F.col("a_of").alias("from"), F.col("b_of").alias("to")).distinct()
        front = kept(open_.select("from", "to", F.col("from").alias("at")), "front")
        seen, found = [front], []
        while not front.isEmpty():
            onward = front.join(self.steps.withColumnRenamed("src", "at"), "at").select("from", "to", F.col("dst").alias("at")).distinct()
            hit = kept(onward.where("at = to").select("from", "to").distinct(), "hit")
            found.append(hit)
            near = onward.join(hit, ["from", "to"], "left_anti").join(self._of("at", "x_"), "at").join(self._of("to", "y_"), "to").where(self._may("x_", "y_")).select("from", "to", "at")
            front = kept(near.join(reduce(DataFrame.unionByName, seen), ["from", "to", "at"], "left_anti"), "front")
            seen.append(front)
        none = open_.where("false").select("from", "to")
        met = kept(reduce(DataFrame.unionByName, found, none).select(F.col("from").alias("a_of"), F.col("to").alias("b_of"), F.lit(True).alias("met")), "met")
        free(*seen, *found)
        by = F.when(F.col("reaches").isNull(), "search").when(F.col("alike"), "component").otherwise("labels")
        out = rows.join(met, ["a_of", "b_of"], "left").select("a", "b", F.coalesce("reaches", "met", F.lit(False)).alias("reaches"), by.alias("by"))
        return out, (rows, met)

    def free(self) -> None:
        free(self.table, self.steps, self.labels, self.nodes)
