"""Runs and components within stretches of edges."""

import random

import pytest
from test_components import levels, strong, weak

from causeway.operators import components, reach, runs


def chains(n, length):
    return [(f"{c}-{i}", f"{c}-{i + 1}") for c in range(n) for i in range(length)]


def test_chains_that_lie_together_take_no_doubling(spark, monkeypatch):
    def fail(*_):
        raise AssertionError("walked through the whole graph")

    monkeypatch.setattr(components, "doubled", fail)
    monkeypatch.setattr(reach, "doubled", fail)
    edges = chains(3, 40)
    df = spark.createDataFrame(edges, "src string, dst string").coalesce(1)
    assert {r.label: r.level for r in components.levels(df).collect()} == levels(edges)
    asked = [("0-1", "0-30"), ("0-30", "0-1"), ("0-0", "0-40"), ("0-40", "0-0"), ("0-0", "0-7"), ("0-7", "0-40"), ("1-3", "2-9"), ("2-5", "2-5"), ("2-5", "none")]
    got = {(r.a, r.b): r.reaches for r in reach.ReachIndex(df).reaches(spark.createDataFrame(asked, "a string, b string")).collect()}
    assert got == {p: p in {asked[0], asked[2], asked[4], asked[5]} for p in asked}


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_runs_are_parted_where_stretches_share_nodes(spark, most):
    rng = random.Random(most)
    edges = chains(4, 20) + [("0-5", "1-7"), ("2-20", "2-0"), ("3-9", "x"), ("x", "x")]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "src string, dst string").repartition(3)
    inside, rest, _ = runs.contracted(df, most)
    inside, rest = inside.collect(), rest.collect()
    whole = {}
    for r in inside:
        whole.setdefault((r.a, r.b, r.run), {})[r.w] = r.label
    back = {(r.src, r.dst) for r in rest if r.w == 1}
    for (a, b, _), at in whole.items():
        nodes = [a, *(at[w] for w in sorted(at)), b]
        assert sorted(at) == list(range(1, len(at) + 1)) and (a, b, len(at) + 1) in {tuple(r) for r in rest}
        back |= set(zip(nodes, nodes[1:]))
    assert back == set(edges) and len({r.label for r in inside}) == len(inside)
    ways = [(sum(x == n for x, _ in edges), sum(y == n for _, y in edges)) for n in {r.label for r in inside}]
    assert set(ways) <= {(1, 1)}
    roots = {(r.label, r.root) for r in runs.near_roots(df, most).collect()}
    assert {n for n, _ in roots} == {n for e in edges for n in e} and weak(edges) == weak(set(edges) | roots)


def test_small_stretches_give_the_same_components(spark, monkeypatch):
    edges = chains(2, 12) + [("0-12", "0-0"), ("0-3", "1-5")]
    df = spark.createDataFrame(edges, "src string, dst string").repartition(4)
    assert {r.label: r.component for r in components.strong_components(df).collect()} == strong(edges)
    assert {r.label: r.component for r in components.weak_components(df).collect()} == weak(edges)
