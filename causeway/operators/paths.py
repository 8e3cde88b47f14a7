"""Simple paths between starts and ends: all of them from both sides at once, or the first few of each question.

All paths: half of the hops are walked from the starts, half backwards from the ends, and halves are joined at the node
where they meet, if they share no other. A path of n hops is found once, as ceil(n / 2) hops on from a start and the rest
back from an end, so what is walked grows with the square root of what one-sided walks would.

The first few: a walk takes only steps from which an end can still be reached in exactly the hops that are left, in the
order of the paths' texts, and of each question and length keeps the first ``width`` prefixes, and of these only as many
as surely go on to enough others. What it finds is the head of the ordered list. A question that has too few while
prefixes were left aside is walked again with a larger width.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.operators.storage import free, kept


def pairs(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) without self-loops."""
    return edges.select("src", "dst").where("src <> dst").distinct()


def _within(now: DataFrame, steps: DataFrame, hops: int, own: list[str], at: str, to: str) -> DataFrame:
    """(own, label) at most ``hops`` steps away from ``now(own, label)``, from ``at`` of a step to its ``to``."""
    known = kept(now, "near")
    for _ in range(hops):
        more = known.join(steps, F.col("label") == F.col(at)).select(*own, F.col(to).alias("label"))
        older, known = known, kept(known.unionByName(more).distinct(), "near")
        free(older)
    return known


def simple_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, max_hops: int = 4, keys: list[str] | None = None) -> DataFrame:
    """(keys, path) of all simple paths of one to ``max_hops`` edges from a start to another end.

    ``starts`` hold ``label`` and the ``keys`` (say a query id); a path belongs to one key. ``ends`` hold ``label`` and
    the keys, or ``label`` alone where all keys share them. An end may also lie inside a path to another end. Repeated
    edges, starts and ends count once; null labels lead nowhere."""
    keys = keys or []
    shared = [k for k in keys if k in ends.columns]
    steps = kept(pairs(edges), "steps")
    back = [kept(ends.select(*shared, F.array("label").alias("tail"), F.col("label").alias("first")).distinct(), "back")]
    fore = [kept(starts.select(*keys, F.array("label").alias("path"), F.col("label").alias("last")).distinct(), "fore")]
    n_back = max_hops // 2
    n_fore = max_hops - n_back
    # where halves can meet at all: as far from a start as the fore half goes
    near = _within(fore[0].select(*keys, F.col("last").alias("label")), steps, n_fore, keys, "src", "dst")
    met = near.select(*shared, F.col("label").alias("first")).distinct()
    for hop in range(n_back):
        more = back[-1].join(steps, F.col("first") == F.col("dst")).where(~F.array_contains("tail", F.col("src"))).select(*shared, F.concat(F.array("src"), "tail").alias("tail"), F.col("src").alias("first"))
        back.append(kept(more.join(met, [*shared, "first"], "left_semi") if hop + 1 == n_back else more, "back"))
    for hop in range(n_fore):
        more = fore[-1].join(steps, F.col("last") == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(*keys, F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("last"))
        if hop + 1 == n_fore:  # walked no further: only those that meet a back half are wanted
            waiting = reduce(DataFrame.unionByName, [b.select(*shared, F.col("first").alias("last")) for b in back[max(0, n_fore - 1) :]]).distinct()
            more = more.join(waiting, [*shared, "last"], "left_semi")
        fore.append(kept(more, "fore"))
    found = []
    for hops in range(1, max_hops + 1):
        on, rest = fore[hops - hops // 2], back[hops // 2].withColumnRenamed("first", "last")
        joined = on.join(rest, [*shared, "last"])
        if hops > 1:
            joined = joined.where(F.size(F.array_intersect("path", "tail")) == 1)
        found.append(joined.select(*keys, F.concat("path", F.slice("tail", 2, F.greatest(F.size("tail") - 1, F.lit(0)))).alias("path")))
    out = kept(reduce(DataFrame.unionByName, found), "paths")
    free(steps, near, *back, *fore)
    return out


#: What stands between the labels of a path's text.
ARROW = " -> "
#: Rows that a task sorts or counts. Up to 200 parts Spark's map tasks write each part to a file of its own and hold no rows.
TASK_ROWS, MOST_PARTS = 1 << 18, 200


def _hubs(steps: DataFrame, rows: int) -> list[str]:
    """Nodes whose steps alone would be several tasks' rows, told by a sample: they are dealt otherwise, nothing else."""
    if rows <= 4 * TASK_ROWS:
        return []
    share = min(1.0, (1 << 20) / rows)
    counts = steps.sample(share, seed=0).groupBy("src").count()
    return [x.src for x in counts.where(F.col("count") > 4 * TASK_ROWS * share).select("src").collect()]


def best_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, most: int = 10, max_hops: int = 4, keys: list[str] | None = None, width: int | None = None) -> DataFrame:
    """(keys, path, rank) of the first ``most`` simple paths of each key, as ``simple_paths`` finds them: shorter ones
    first, then by their text (labels that hold an arrow themselves are ordered by their parts).

    A node's steps are cut to the first that a key's ``width`` prefixes can need before any path is made, so that a
    node of many ways out gives few rows. Keys that may have lost a path by that are walked again, 16 times as wide.
    Rows are dealt into as many parts as they need, so what a task holds does not grow with them until there are 200."""
    own = keys or ["__one"]
    shared = [k for k in own if k in ends.columns and k in (keys or [])]
    origins = (starts if keys else starts.withColumn("__one", F.lit(0))).select(*own, "label").distinct()
    origins = kept(origins, "origins")
    if origins.isEmpty():  # as where all questions have been answered before
        return origins.select(*(keys or []), F.array("label").alias("path"), F.lit(1).alias("rank"))
    rows = edges.count()
    width, done = max(width or 4 * most, most), []
    n_parts = max(1, min(MOST_PARTS, (rows + origins.count() * max_hops * width) // TASK_ROWS))
    steps = kept(pairs(edges.repartition(n_parts, "src", "dst")), "steps")
    hubs = _hubs(steps, rows)
    # [r]: from which an end is exactly r steps away, and by how many first steps
    exact = [kept(ends.select(*shared, "label").distinct().withColumn("more", F.lit(1).cast("long")), "exact")]
    for _ in range(max_hops - 1):
        exact.append(kept(steps.join(exact[-1].select(*shared, F.col("label").alias("dst")), "dst").groupBy(*shared, F.col("src").alias("label")).agg(F.count("*").alias("more")), "exact"))
    ways = reduce(DataFrame.unionByName, [steps.join(x.withColumnRenamed("label", "dst"), "dst").select(*shared, "src", "dst", F.lit(r).alias("r"), "more") for r, x in enumerate(exact)])
    while True:
        found, full, tables = _beam(ways, origins, own, shared, most, max_hops, width, n_parts, hubs)
        # a key is wanting if at some length it has too few while prefixes of that length were left aside
        so_far = F.sum("n").over(Window.partitionBy(*own).orderBy("length"))
        both = full.select(*own, "length", F.lit(0).alias("n"), F.lit(True).alias("cut")).unionByName(found.select(*own, "length", F.lit(1).alias("n"), F.lit(False).alias("cut")))
        every = both.repartition(n_parts, *own).groupBy(*own, "length").agg(F.sum("n").alias("n"), F.max("cut").alias("cut"))
        wanting = kept(every.withColumn("so_far", so_far).where(F.col("cut") & (F.col("so_far") < most)).select(*own).distinct(), "wanting")
        again = not wanting.isEmpty()
        fine = found.join(wanting, own, "left_anti") if again else found
        ranked = fine.repartition(n_parts, *own).withColumn("rank", F.row_number().over(Window.partitionBy(*own).orderBy("length", "text"))).where(F.col("rank") <= most)
        done.append(kept(ranked.select(*(keys or []), "path", "rank"), "best"))
        if not again:
            free(*tables, wanting, origins, steps, *exact)
            break
        older, origins = origins, kept(origins.join(wanting, own, "left_semi"), "origins")
        free(older, wanting, *tables)
        width *= 16
    return reduce(DataFrame.unionByName, done)


def _beam(ways: DataFrame, origins: DataFrame, own: list[str], shared: list[str], most: int, max_hops: int, width: int, n_parts: int, hubs: list[str]) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(own, path, length, text) of the first paths of each length, (own, length) of those that left prefixes aside, and
    the tables that both read."""
    sign = F.concat("dst", F.when(F.col("r") > 0, ARROW).otherwise(""))

    def head(ways: DataFrame, *by: str) -> DataFrame:
        # of a prefix at most max_hops nodes are ways that it cannot take
        order = Window.partitionBy(*shared, "src", *by, "r").orderBy(sign)
        placed = ways.repartition(n_parts, *shared, "src", *by).withColumn("place", F.row_number().over(order))
        return placed.where((F.col("place") <= width + max_hops) & ((F.col("r") > 0) | (F.col("place") <= most + max_hops))).drop("place", *by)

    if hubs:  # their ways are cut in many tasks first
        ways = head(ways.withColumn("__share", F.when(F.col("src").isin(hubs), F.pmod(F.xxhash64("dst"), F.lit(n_parts)))), "__share")
    first = kept(head(ways), "ways")
    now, tables, found, full = origins.withColumnRenamed("label", "last"), [first], [], []
    order = Window.partitionBy(*own, "length").orderBy("text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for hop in range(1, max_hops + 1):
        if hop == 1:  # a start is one row until its ways tell the lengths
            onward = now.join(first.withColumnRenamed("src", "last"), [*shared, "last"]).withColumns({"length": F.col("r") + 1, "path": F.array("last"), "text": F.concat("last", F.lit(ARROW))})
        else:
            onward = now.withColumn("r", F.col("length") - hop).join(first.withColumnRenamed("src", "last"), [*shared, "last", "r"])
        onward = onward.where(~F.array_contains("path", F.col("dst"))).select(*own, F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("last"), F.concat("text", "dst", F.when(F.col("r") > 0, ARROW).otherwise("")).alias("text"), "length", "more")
        # paths that each prefix surely gives at the next hop: what comes after enough of them is not walked. Where a
        # label holds an arrow, its prefix may go on to texts that come before those of an earlier one
        need = F.when(F.col("length") == hop + 1, most).otherwise(width)
        sure = F.greatest(F.least("more", need + max_hops) - hop, F.lit(0))
        arrows = (F.length("text") - F.length(F.replace("text", F.lit(ARROW), F.lit("")))) > len(ARROW) * (hop + 1)
        placed = onward.repartition(n_parts, *own, "length").withColumn("place", F.row_number().over(order)).withColumn("before", F.sum(sure).over(order) - sure)
        wanted = (F.col("length") == hop) | (F.col("before") < need) | arrows
        now = kept(placed.where((F.col("place") <= width) & wanted).drop("more", "before"), "beam")
        tables.append(now)
        found.append(now.where((F.col("length") == hop) & (F.col("place") <= most)).select(*own, "path", "length", "text"))
        full.append(now.where((F.col("length") > hop) & (F.col("place") == width)).select(*own, "length"))
        now = now.where(F.col("length") > hop).drop("place")
        if hop < max_hops:  # keys that have enough need no longer paths
            enough = reduce(DataFrame.unionByName, found).select(*own).repartition(n_parts, *own).groupBy(*own).agg(F.count("*").alias("n")).where(F.col("n") >= most).select(*own)
            now = now.join(enough, own, "left_anti")
    return reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, full), tables
