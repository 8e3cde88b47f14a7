"""The reachability index against the closure."""

import random

import pytest
from pyspark.sql import functions as F

from causeway.operators import reach


def closure(edges):
    on = {}
    for a, b in edges:
        on.setdefault(a, set()).add(b)
    out = set()
    for a in {x for e in edges for x in e}:
        seen, front = set(), [a]
        while front:
            for w in on.get(front.pop(), ()):
                if w not in seen:
                    seen.add(w)
                    front.append(w)
        out |= {(a, b) for b in seen}
    return out


def test_asked_pairs_equal_the_closure(spark):
    rng = random.Random(3)
    names = [f"n{i:02}" for i in range(60)]
    edges = {tuple(sorted(rng.sample(names, 2))) for _ in range(75)} | {(f"c{i}", f"c{i + 1}") for i in range(30)} | {("n05", "c0"), ("c30", "n50"), ("n20", "n03"), ("n07", "n07")}
    want = closure(edges)
    everyone = sorted({x for e in edges for x in e})
    asked = [(a, b) for a in everyone for b in everyone] + [("absent", "n01"), ("n01", None), ("n01", "n02"), ("n01", "n02")]
    index = reach.ReachIndex(spark.createDataFrame(sorted(edges), "src string, dst string"))
    rows = index.reaches(spark.createDataFrame(asked, "a string, b string")).collect()
    assert {(r.a, r.b): r.reaches for r in rows} == {p: p in want for p in asked} and len(rows) == len(set(asked))
    by = {}
    for r in rows:
        by[r.by] = by.get(r.by, 0) + 1
    assert by["labels"] > 0.5 * len(rows)  # most are told by labels alone
    index.free()


def test_least_value_ahead(spark):
    rng = random.Random(4)
    edges = {(f"n{a:02}", f"n{b:02}") for a, b in (sorted(rng.sample(range(40), 2)) for _ in range(45))} | {(f"r{i}", f"r{i + 1}") for i in range(20)}
    names = sorted({x for e in edges for x in e} | {"alone"})
    value = {n: rng.randrange(1000) for n in names}
    want = closure(edges)
    df = spark.createDataFrame(sorted(edges), "src string, dst string")
    got = {r.label: r.v for r in reach.least_ahead(df, spark.createDataFrame(sorted(value.items()), "label string, v long"), ["v"]).collect()}
    assert got == {n: min([value[n], *(value[b] for a, b in want if a == n)]) for n in names}
    with pytest.raises(ValueError):
        reach.least_ahead(spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string"), spark.createDataFrame([("a", 1), ("b", 2)], "label string, v long"), ["v"])


def test_no_edges(spark):
    index = reach.ReachIndex(spark.createDataFrame([], "src string, dst string"))
    got = index.reaches(spark.createDataFrame([("a", "b")], "a string, b string")).withColumn("x", F.lit(1)).collect()
    assert [(r.reaches, r.by) for r in got] == [(False, "component")]
