"""Paths from both sides and the first paths, against walks in plain Python."""

import random

from pyspark.sql import functions as F

from causeway.operators import graph, paths


def walks(edges, starts, ends, hops):
    """All simple paths of up to ``hops`` edges from a start to another end, depth first."""
    follow, out = {}, []
    for a, b in edges:
        follow.setdefault(a, set()).add(b)

    def go(path):
        if len(path) > 1 and path[-1] in ends:
            out.append(tuple(path))
        if len(path) <= hops:
            for b in follow.get(path[-1], ()):
                if b not in path:
                    go([*path, b])

    for s in starts:
        go([s])
    return out


def first(found, most):
    return sorted(found, key=lambda p: (len(p), " -> ".join(p)))[:most]


def frame(spark, edges):
    return spark.createDataFrame(sorted(edges), "src string, dst string")


def question(spark, rows, kind):
    return spark.createDataFrame(rows, kind)


def test_both_sides_give_all_walks(spark):
    rng = random.Random(6)
    names = [f"n{i}" for i in range(14)] + ["a!", "a", "a b"]
    edges = {(rng.choice(names), rng.choice(names)) for _ in range(45)}
    df = frame(spark, edges).union(frame(spark, edges))
    starts = [(k, rng.choice(names)) for k in (0, 0, 1, 2)]
    ends = [rng.choice(names) for _ in range(5)]
    asked, shared = question(spark, starts, "query_id int, label string"), question(spark, [(e,) for e in ends], "label string")
    for hops in (1, 2, 3, 4, 6):
        got = sorted((r.query_id, tuple(r.path)) for r in graph.simple_paths(df, asked, shared, hops, ["query_id"]).collect())
        assert got == sorted((k, p) for k, s in set(starts) for p in walks(edges, [s], set(ends), hops)), hops
    own = [(k, rng.choice(names)) for k in (0, 1, 1, 3)]
    got = sorted((r.query_id, tuple(r.path)) for r in graph.simple_paths(df, asked, question(spark, own, "query_id int, label string"), 4, ["query_id"]).collect())
    assert got == sorted((k, p) for k, s in set(starts) for p in walks(edges, [s], {e for j, e in own if j == k}, 4))


def test_first_paths_are_the_first_of_all(spark):
    rng = random.Random(9)
    names = [f"n{i}" for i in range(12)] + ["a!", "a", "a b", "a\tb"]
    edges = {(rng.choice(names), rng.choice(names)) for _ in range(60)}
    starts, ends = [(k, rng.choice(names)) for k in (0, 0, 1, 2, 3)], {rng.choice(names) for _ in range(4)}
    asked, shared = question(spark, starts, "query_id int, label string"), question(spark, [(e,) for e in ends], "label string")
    for most, width in ((1, 1), (3, 3), (10, None), (1000, 1000)):
        got = sorted((r.query_id, r["rank"], tuple(r.path)) for r in graph.best_paths(frame(spark, edges), asked, shared, most, 4, ["query_id"], width).collect())
        want = [(k, i + 1, p) for k in range(4) for i, p in enumerate(first([p for j, s in set(starts) if j == k for p in walks(edges, [s], ends, 4)], most))]
        assert got == want, most


def test_dead_ends_that_come_first(spark):
    """Prefixes that sort first but only lead back: the width grows until the paths behind them are found."""
    edges = {("s", "m")} | {("m", f"a{i:02}") for i in range(60)} | {(f"a{i:02}", "m") for i in range(60)} | {("m", "z"), ("z", "y"), ("y", "end"), ("m", "e0"), ("e0", "x1"), ("x1", "end"), ("s", "end2")}
    asked, ends = question(spark, [("s",)], "label string"), question(spark, [("end",)], "label string")
    edges |= {("m", "end")}
    got = [tuple(r.path) for r in graph.best_paths(frame(spark, edges), asked, ends, 3, 4, width=3).orderBy("rank").collect()]
    assert got == first(walks(edges, ["s"], {"end"}, 4), 3)


def test_hub_gives_few_rows(spark, monkeypatch):
    """A node of degree 10,000 gives ten paths without making 10,000."""
    made = []
    real = paths.kept

    def counting(df, name="kept"):
        out = real(df, name)
        if name in ("beam", "ways"):
            made.append((name, out.count()))
        return out

    monkeypatch.setattr(paths, "kept", counting)
    hub = spark.range(10_000).select(F.lit("hub").alias("src"), F.format_string("x%05d", "id").alias("dst"))
    out = spark.range(10_000).select(F.format_string("x%05d", "id").alias("src"), F.format_string("end%d", F.col("id") % 3).alias("dst"))
    edges = hub.union(out).union(spark.createDataFrame([("start", "hub")], "src string, dst string"))
    ends = spark.createDataFrame([(f"end{i}",) for i in range(3)], "label string")
    got = [tuple(r.path) for r in graph.best_paths(edges, spark.createDataFrame([("start",)], "label string"), ends, 10, 4).orderBy("rank").collect()]
    assert got == [("start", "hub", f"x{i:05}", f"end{i % 3}") for i in range(10)]
    assert max(n for name, n in made if name == "beam") <= 4 * 40


def test_halves_are_smaller_than_walks(spark, monkeypatch):
    """Layers that are wide in the middle: what is walked stays below the number of paths."""
    made = []
    real = paths.kept

    def counting(df, name="kept"):
        out = real(df, name)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(paths, "kept", counting)
    edges = [(f"{a}{i}", f"{b}{j}") for a, b in zip("abcd", "bcde") for i in range(8) for j in range(8)]
    starts, ends = [(f"a{i}",) for i in range(8)], [(f"e{i}",) for i in range(8)]
    got = graph.simple_paths(frame(spark, edges), question(spark, starts, "label string"), question(spark, ends, "label string"), 4)
    assert got.count() == 8**5
    assert max(n for name, n in made if name in ("fore", "back", "near")) <= 8**3


def test_no_starts(spark):
    edges, none = frame(spark, {("a", "b")}), spark.createDataFrame([], "query_id int, label string")
    ends = question(spark, [("b",)], "label string")
    got = graph.best_paths(edges, none, ends, 3, 4, ["query_id"])
    assert got.columns == ["query_id", "path", "rank"] and got.count() == 0 and graph.simple_paths(edges, none, ends, 4, ["query_id"]).count() == 0


def test_prefixes_that_are_not_needed_are_not_walked(spark, monkeypatch):
    """Twenty middle nodes that all lead to ten ends: the first alone gives the paths that are asked for."""
    made = []
    real = paths.kept

    def counting(df, name="kept"):
        out = real(df, name)
        if name == "beam":
            made.append(out.count())
        return out

    monkeypatch.setattr(paths, "kept", counting)
    edges = {(f"s{i}", f"m{j:02}") for i in range(5) for j in range(20)} | {(f"m{j:02}", f"e{k}") for j in range(20) for k in range(10)}
    asked, ends = question(spark, [(i, f"s{i}") for i in range(5)], "query_id int, label string"), question(spark, [(f"e{k}",) for k in range(10)], "label string")
    got = sorted((r.query_id, r["rank"], tuple(r.path)) for r in graph.best_paths(frame(spark, edges), asked, ends, 3, 3, ["query_id"]).collect())
    assert got == [(i, k + 1, (f"s{i}", "m00", f"e{k}")) for i in range(5) for k in range(3)]
    assert made[0] == 5


def test_prefixes_are_needed_where_ways_lead_back(spark):
    """Ways to nodes that are on the path already count for nothing."""
    edges = {("s", f"m{i}") for i in range(6)} | {(f"m{i}", "s") for i in range(6)} | {(f"m{i}", f"m{j}") for i in range(6) for j in range(6) if i != j} | {("m5", "end"), ("m4", "other"), ("s", "end")}
    asked, ends = question(spark, [("s",)], "label string"), question(spark, [("end",), ("other",), ("s",), ("m0",), ("m1",)], "label string")
    for most, width in ((2, 2), (5, None), (40, 40)):
        got = [tuple(r.path) for r in graph.best_paths(frame(spark, edges), asked, ends, most, 4, width=width).orderBy("rank").collect()]
        assert got == first(walks(edges, ["s"], {"end", "other", "s", "m0", "m1"}, 4), most), most


def test_labels_that_hold_an_arrow(spark):
    """A longer label's texts may come before those of the label that it begins with."""
    edges = {("s", "a"), ("s", "a -> b"), ("a -> b", "end")} | {("a", f"z{i}") for i in range(9)}
    asked, ends = question(spark, [("s",)], "label string"), question(spark, [("end",), *[(f"z{i}",) for i in range(9)]], "label string")
    got = [tuple(r.path) for r in graph.best_paths(frame(spark, edges), asked, ends, 3, 4).orderBy("rank").collect()]
    assert got == [("s", "a -> b", "end"), ("s", "a", "z0"), ("s", "a", "z1")]


def test_hubs_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(paths, "TASK_ROWS", 64)
    rng = random.Random(3)
    names = [f"n{i}" for i in range(12)]
    edges = {(rng.choice(names), rng.choice(names)) for _ in range(50)} | {("n1", f"x{i:03}") for i in range(400)} | {(f"x{i:03}", rng.choice(names)) for i in range(400)}
    df = frame(spark, edges)
    assert paths._hubs(paths.pairs(df), len(edges)) == ["n1"]
    starts, ends = [(k, f"n{k}") for k in range(4)], {"n2", "n5", "x399", "x007"}
    asked, shared = question(spark, starts, "query_id int, label string"), question(spark, [(e,) for e in ends], "label string")
    got = sorted((r.query_id, r["rank"], tuple(r.path)) for r in graph.best_paths(df.union(df), asked, shared, 5, 3, ["query_id"]).collect())
    assert got == [(k, i + 1, p) for k in range(4) for i, p in enumerate(first(walks(edges, [f"n{k}"], ends, 3), 5))]
