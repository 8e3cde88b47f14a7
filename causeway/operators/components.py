"""Components and levels of graphs of any depth.

A walk along a chain takes a round a node. Here each round first makes a graph smaller without changing what is asked:

* a run of nodes with one way in and one way out becomes a single edge, its ends found by pointer doubling (a pointer to
  the next node, to the second next, to the fourth next, ...), so a run of n nodes takes log2(n) rounds;
* nodes without a way in, or out, are taken off;
* nodes that lead to each other directly become one.

Runs are looked for within stretches of edges first (``runs``), which takes no round where a chain's edges lie together.
What was contracted is written down with its round, and answers are carried back through the rounds in reverse. Trees,
chains, rings and what is made of them so take a logarithmic number of rounds. What is left, where every node has
several ways in or out, is coloured; colours take a round a hop.

Joins are on labels that are unique on one side; a hub's rows on the other are Spark's skew join's to split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.operators.runs import contracted, near_roots
from causeway.operators.storage import free, kept


def ends_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("label")).unionByName(edges.select(F.col("dst").alias("label"))).distinct()


def in_and_out(edges: DataFrame) -> DataFrame:
    """(label, n_in, n_out) over distinct edges."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("src").alias("label"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("label"), F.lit(1).alias("i"), F.lit(0).alias("o")))))
    return ends.groupBy("label").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def weak_components(edges: DataFrame) -> DataFrame:
    """(label, component): the smallest label that is connected to each, whatever the edges' direction.

    First within stretches of edges; only nodes that several stretches have are joined further, by stars: a node's larger
    neighbours are hung under its smallest one, then its smaller neighbours and itself, in turns, until each component is
    a star. A long chain halves with each turn. Self-loops only name their node."""
    near = kept(near_roots(edges), "near")
    names = kept(near.groupBy("label").agg(F.min("root").alias("root"), F.max("root").alias("other")), "names")
    links = near.join(names.where("root <> other").select("label"), "label", "left_semi").where("label <> root")
    now = kept(links.select(F.col("label").alias("u"), F.col("root").alias("v")).distinct(), "star")
    before = None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v")))
        older, now = now, kept(small.distinct(), "star")
        free(older)
    out = kept(names.join(now.select(F.col("u").alias("root"), "v"), "root", "left").select("label", F.coalesce("v", "root").alias("component")), "weak")
    free(now, near, names)
    return out


def doubled(first: DataFrame, far: dict[str, Column], combine: dict[str, Column]) -> DataFrame:
    """Pointer doubling over ``first(label, last, over, ...)``: ``last`` is a label that ``label`` leads to, itself at the
    end of a run, and ``over`` tells whether it is the end. ``far`` names columns of the label pointed at, ``combine`` says
    what they make of a row's own. Where ``over`` is false in the result, a label is on a ring without an end, and all of
    the ring has been seen."""

    def once(now: DataFrame) -> DataFrame:
        other = now.select(F.col("label").alias("last"), F.col("last").alias("to"), F.col("over").alias("ends"), *[c.alias(n) for n, c in far.items()])
        return now.join(other, "last").select("label", F.col("to").alias("last"), F.col("ends").alias("over"), *[c.alias(n) for n, c in combine.items()])

    now, before, span = kept(first, "run"), None, 1
    while True:
        left = now.where("not over").count()
        # labels of runs that are not over get fewer with each doubling; only rings stay as they are
        if not left or left == before and span >= left:
            return now
        older, now = now, kept(once(once(now)), "run")
        free(older)
        before, span = left, span * 4


def run_ends(links: DataFrame) -> DataFrame:
    """(label, last, over, least) for ``links(label, next)``, where a label comes once and next need not be one: the last
    label of each run, or the smallest of each ring."""
    heads = links.select(F.col("label").alias("next"), F.lit(True).alias("inner"))
    first = links.join(heads, "next", "left").select("label", F.when(F.col("inner"), F.col("next")).otherwise(F.col("label")).alias("last"), F.col("inner").isNull().alias("over"), F.col("label").alias("least"))
    return doubled(first, {"other": F.col("least")}, {"least": F.least("least", "other")})


class Steps:
    """Contractions, in order; answers go back through them in reverse."""

    def __init__(self, everyone: DataFrame):
        self.everyone, self.done = everyone, []

    def merged(self, table: DataFrame) -> None:
        """(label, into): the label has what ``into`` has."""
        self.done.append(("merged", table))

    def run(self, table: DataFrame) -> None:
        """(label, a, b): the label was inside an edge from a to b."""
        self.done.append(("run", table))

    def roots(self) -> DataFrame:
        """(label, root): the same root for the nodes of a component."""
        known: list[DataFrame] = []  # (label, root); a label that none of them has is its own root
        for kind, table in reversed(self.done):
            root = lambda c, name: reduce(DataFrame.unionByName, known).select(F.col("label").alias(c), F.col("root").alias(name))
            if kind == "merged":
                out = table.join(root("into", "of"), "into", "left").select("label", F.coalesce("of", "into").alias("root")) if known else table.toDF("label", "root")
            else:
                both = table.join(root("a", "of_a"), "a", "left").join(root("b", "of_b"), "b", "left") if known else table.withColumn("of_a", F.col("a")).withColumn("of_b", F.col("b"))
                a, b = F.coalesce("of_a", "a"), F.coalesce("of_b", "b")
                out = both.where(a == b).select("label", a.alias("root"))
            known.append(kept(out, "roots"))
        if not known:
            return kept(self.everyone.select("label", F.col("label").alias("root")), "rooted")
        rooted = self.everyone.join(reduce(DataFrame.unionByName, known), "label", "left").select("label", F.coalesce("root", "label").alias("root"))
        rooted = kept(rooted, "rooted")
        free(*known, *(t for _, t in self.done))
        return rooted


def strong_components(edges: DataFrame) -> DataFrame:
    """(label, component): the smallest label among those that reach a node and are reached from it.

    Each round contracts runs, takes nodes without a way in or out off, and makes one of nodes that lead to each other
    directly. Where nothing of this is left to do the rest is coloured: each node takes the smallest label that reaches
    it, the nodes of a colour that reach its owner are the owner's component, and these go. Self-loops do not matter."""
    inside, rest, found = contracted(edges)
    everyone = kept(ends_of(rest), "everyone")
    left = kept(rest.where("src <> dst").select("src", "dst").distinct(), "left")
    steps = Steps(everyone)
    while True:
        degrees = kept(in_and_out(left), "degrees")
        n, n_off, n_inner = degrees.agg(F.count("*"), F.count_if(F.expr("n_in = 0 or n_out = 0")), F.count_if(F.expr("n_in = 1 and n_out = 1"))).first()
        if not n:
            free(degrees, left)
            break
        after, ends = left, None
        if n_inner:
            after, ends = _without_runs(after, degrees, steps)
        if n_off:
            stay = degrees.where("n_in > 0 and n_out > 0").select("label")
            after = after.join(stay.select(F.col("label").alias("src")), "src", "left_semi").join(stay.select(F.col("label").alias("dst")), "dst", "left_semi")
        if after is not left:
            after = kept(after.distinct(), "left")
        free(degrees, ends)
        mutual = kept(after.join(after.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi").where("src < dst"), "mutual")
        if not mutual.isEmpty():
            groups = kept(weak_components(mutual).where("label <> component").select("label", F.col("component").alias("into")), "merged")
            steps.merged(groups)
            older, after = after, kept(_renamed(after, groups), "left")
            free(older if older is not left else None)
        elif not n_off and not n_inner:
            coloured, after = _coloured(left)
            steps.merged(coloured)
        free(mutual, left)
        left = after
    rooted = steps.roots()
    of = lambda c: rooted.select(F.col("label").alias(c), F.col("root").alias(f"of_{c}"))
    inside = inside.join(of("a"), "a", "left").join(of("b"), "b", "left").select("label", F.when(F.col("of_a") == F.col("of_b"), F.col("of_a")).otherwise(F.col("label")).alias("root"))
    inside = kept(inside, "inside")  # a node inside is the root of none but itself
    many = rooted.unionByName(inside.where("label <> root"))
    names = many.groupBy("root").agg(F.min("label").alias("component"))
    alone = inside.where("label = root").select("label", F.col("root").alias("component"))
    out = kept(alone.unionByName(many.join(names, "root").select("label", "component")), "components")
    free(rooted, inside, found, everyone)
    return out


def _renamed(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges between what their ends have become, without those that have become loops."""
    for end in ("src", "dst"):
        new = groups.select(F.col("label").alias(end), F.col("into").alias("new"))
        edges = edges.join(new, end, "left").withColumn(end, F.coalesce("new", end)).drop("new")
    return edges.where("src <> dst").select("src", "dst").distinct()


def _without_runs(left: DataFrame, degrees: DataFrame, steps: Steps) -> tuple[DataFrame, DataFrame]:
    """``left`` with an edge in place of each run of nodes with one way in and one way out, and the table that holds these
    edges; rings of such nodes are gone."""
    inner = degrees.where("n_in = 1 and n_out = 1").select("label")
    links = left.join(inner.select(F.col("label").alias("src")), "src", "left_semi").select(F.col("src").alias("label"), F.col("dst").alias("next"))
    into = left.join(inner.select(F.col("label").alias("dst")), "dst", "left_semi").join(inner.select(F.col("label").alias("src")), "src", "left_anti").select(F.col("src").alias("a"), F.col("dst").alias("label"))
    ended = run_ends(links)
    out = ended.where("last = label and over").join(links, "label").select("last", F.col("next").alias("b"))
    ends = kept(into.join(ended.where("over"), "label").join(out, "last").select("last", "a", "b"), "ends")
    steps.run(kept(ended.where("over").join(ends, "last").select("label", "a", "b"), "inside"))
    steps.merged(kept(ended.where("not over and label <> least").select("label", F.col("least").alias("into")), "rings"))
    free(ended)
    outer = left.join(inner.select(F.col("label").alias("src")), "src", "left_anti").join(inner.select(F.col("label").alias("dst")), "dst", "left_anti")
    return outer.unionByName(ends.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))), ends


def _coloured(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(label, into) of the components that the colours' owners are in, and the edges without them. Two hops a table."""
    colours = kept(ends_of(left).select("label", F.col("label").alias("colour")), "colours")

    def spread(now: DataFrame) -> DataFrame:
        near = left.join(now.withColumnRenamed("label", "src"), "src").groupBy("dst").agg(F.min("colour").alias("near"))
        return now.join(near.withColumnRenamed("dst", "label"), "label", "left").select("label", F.least("colour", F.coalesce("near", "colour")).alias("colour"))

    before = None
    while True:
        state = colours.agg(F.sum(F.xxhash64("label", "colour").cast("decimal(38,0)"))).first()[0]
        if state == before:
            break
        older, colours, before = colours, kept(spread(spread(colours)), "colours"), state
        free(older)
    ends = colours.withColumnRenamed("label", "dst").withColumnRenamed("colour", "to")
    inside = kept(left.join(colours.withColumnRenamed("label", "src"), "src").join(ends, "dst").where("colour = to").select("src", "dst"), "inside")
    seen = kept(colours.where("label = colour").select("label", "colour"), "back")
    n, before = seen.count(), None
    while n != before:
        back = lambda now: now.unionByName(inside.join(now.withColumnRenamed("label", "dst"), "dst").select(F.col("src").alias("label"), "colour")).distinct()
        older, seen, before = seen, kept(back(back(seen)), "back"), n
        n = seen.count()
        free(older)
    gone = seen.select("label")
    after = kept(left.join(gone.withColumnRenamed("label", "src"), "src", "left_anti").join(gone.withColumnRenamed("label", "dst"), "dst", "left_anti"), "left")
    out = kept(seen.where("label <> colour").select("label", F.col("colour").alias("into")), "coloured")
    free(colours, inside, seen)
    return out, after


def levels(edges: DataFrame) -> DataFrame:
    """(label, level): edges on the longest way to a node from one without a way in. Nodes on or behind a cycle, a
    self-loop included, are left out.

    Each round makes one edge of each run of nodes with one way in and out, levels the nodes without a way in, and puts
    the nodes without a way out off until their sources are levelled. An edge has a length; what a node is known to have
    at least, from sources that are gone, is its floor."""
    inside, rest, stretches = contracted(edges)
    left = kept(rest.groupBy("src", "dst").agg(F.max("w").alias("w")), "left")
    floors = kept(left.select(F.col("src").alias("label"), F.col("w").alias("floor")).where("false"), "floors")
    done: list[tuple[str, DataFrame]] = [("runs", inside.select("label", "a", F.lit(0).cast("long").alias("floor"), "w"))]
    while True:
        degrees = kept(in_and_out(left).join(floors, "label", "left").select("label", "n_in", "n_out", F.coalesce("floor", F.lit(0)).alias("floor")), "degrees")
        n_roots, n_inner = degrees.agg(F.count_if(F.expr("n_in = 0")), F.count_if(F.expr("n_in = 1 and n_out = 1"))).first()
        if not n_roots:  # each node that is left has a way in from another one that is
            free(degrees, left, floors)
            break
        outer, gains = left, []
        if n_inner:
            outer, found = _without_weighted_runs(left, degrees, done)
            gains.append(found)
        outer = kept(outer, "outer")
        roots, sinks = degrees.where("n_in = 0").select("label", F.col("floor").alias("level")), degrees.where("n_out = 0 and n_in > 0").select("label")
        done.append(("levels", kept(roots, "levels")))
        gains.append(outer.join(roots.withColumnRenamed("label", "src"), "src").select(F.col("dst").alias("label"), (F.col("level") + F.col("w")).alias("floor")))
        gains.append(degrees.where("n_in <> 1 or n_out <> 1").select("label", "floor"))
        raised = kept(reduce(DataFrame.unionByName, gains).groupBy("label").agg(F.max("floor").alias("floor")), "floors")
        rest = outer.join(roots.select(F.col("label").alias("src")), "src", "left_anti")
        ways = rest.join(sinks.withColumnRenamed("label", "dst"), "dst", "left_semi").select(F.col("dst").alias("label"), "src", "w")
        done.append(("sinks", kept(raised.join(sinks, "label", "left_semi").join(ways, "label", "left").select("label", "floor", "src", "w"), "sinks")))
        after = kept(rest.join(sinks.withColumnRenamed("label", "dst"), "dst", "left_anti").groupBy("src", "dst").agg(F.max("w").alias("w")), "left")
        # all ways into these came from roots, all ways out led to sinks
        bare = degrees.where("n_in > 0 and n_out > 0 and (n_in > 1 or n_out > 1)").select("label").join(ends_of(after), "label", "left_anti")
        done.append(("levels", kept(raised.join(bare, "label", "left_semi").select("label", F.col("floor").alias("level")), "levels")))
        free(outer, left, degrees, floors)
        left, floors = after, raised
    out = _levelled(rest, done)
    free(stretches)
    return out


def _without_weighted_runs(left: DataFrame, degrees: DataFrame, done: list[tuple[str, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """``left`` with an edge in place of each run, and the floors that runs give to what they lead to. Of a node inside
    the run from a, the level is max(floor, level of a + w), and such functions are closed under composition."""
    inner = degrees.where("n_in = 1 and n_out = 1").select("label", "floor")
    named = lambda c: inner.select(F.col("label").alias(c))
    steps = left.join(inner.withColumnRenamed("label", "dst"), "dst").select(F.col("dst").alias("label"), F.col("src").alias("before"), "w", "floor")
    steps = steps.join(named("before").withColumn("inner", F.lit(True)), "before", "left")
    inside = F.coalesce("inner", F.lit(False))
    first = steps.select(
        "label", F.when(inside, F.col("before")).otherwise(F.col("label")).alias("last"), (~inside).alias("over"), F.when(inside, F.col("floor")).otherwise(F.lit(0)).alias("floor"), F.when(inside, F.col("w")).otherwise(F.lit(0)).alias("w")
    )
    far = {"floor_of": F.col("floor"), "w_of": F.col("w")}
    walked = doubled(first, far, {"floor": F.greatest("floor", F.col("floor_of") + F.col("w")), "w": F.col("w") + F.col("w_of")})
    heads = steps.where(~inside).select(F.col("label").alias("last"), F.col("before").alias("a"), F.col("floor").alias("floor_of"), F.col("w").alias("w_of"))
    runs = walked.where("over").join(heads, "last").select("label", "a", F.greatest("floor", F.col("floor_of") + F.col("w")).alias("floor"), (F.col("w") + F.col("w_of")).alias("w"))
    runs = kept(runs, "runs")
    free(walked)
    done.append(("runs", runs))
    out = left.join(named("src"), "src", "left_semi").join(named("dst"), "dst", "left_anti").select(F.col("src").alias("label"), F.col("dst").alias("b"), F.col("w").alias("last_w"))
    ends = runs.join(out, "label")
    outer = left.join(named("src"), "src", "left_anti").join(named("dst"), "dst", "left_anti")
    joined = outer.unionByName(ends.select(F.col("a").alias("src"), F.col("b").alias("dst"), (F.col("w") + F.col("last_w")).alias("w")))
    return joined, ends.select(F.col("b").alias("label"), (F.col("floor") + F.col("last_w")).alias("floor"))


def _levelled(edges: DataFrame, done: list[tuple[str, DataFrame]]) -> DataFrame:
    none = ends_of(edges).where("false").select("label", F.lit(0).cast("long").alias("level"))
    known: list[DataFrame] = []
    for kind, table in reversed(done):
        found = reduce(DataFrame.unionByName, known, none) if len(known) != 1 else known[0]
        if kind == "levels":
            known.append(table)
        elif kind == "runs":
            run = table.join(found.withColumnRenamed("label", "a"), "a").select("label", F.greatest("floor", F.col("level") + F.col("w")).alias("level"))
            known.append(run if table is done[0][1] else kept(run, "levels"))  # the first runs are read once
        else:  # a sink behind a node without a level has none
            of = table.join(found.withColumnRenamed("label", "src"), "src", "left").groupBy("label").agg(F.max("floor").alias("floor"), F.max(F.col("level") + F.col("w")).alias("level"), F.count_if(F.expr("src is not null and level is null")).alias("n"))
            known.append(kept(of.where("n = 0").select("label", F.greatest("floor", F.coalesce("level", F.lit(0))).alias("level")), "levels"))
    out = kept(reduce(DataFrame.unionByName, known, none), "levels")
    free(*(t for _, t in done), *known)
    return out
