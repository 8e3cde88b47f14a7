"""Components and levels of deep graphs, against plain Python."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from causeway.operators import components, storage


def strong(edges):
    """Two passes over the graph and its reverse, without recursion."""
    on, back = {}, {}
    for a, b in edges:
        on.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
    names, seen, order, out = {x for e in edges for x in e}, set(), [], {}
    for n in names:
        stack = [(n, iter(on.get(n, ())))] if n not in seen else []
        seen.add(n)
        while stack:
            v, rest = stack[-1]
            w = next((x for x in rest if x not in seen), None)
            if w is None:
                order.append(v)
                stack.pop()
            else:
                seen.add(w)
                stack.append((w, iter(on.get(w, ()))))
    for n in reversed(order):
        if n not in out:
            own, out[n] = [n], n
            for v in own:
                for w in back.get(v, ()):
                    if w not in out:
                        out[w] = n
                        own.append(w)
            out.update(dict.fromkeys(own, min(own)))
    return out


def weak(edges):
    return strong(set(edges) | {(b, a) for a, b in edges})


def levels(edges):
    n_in, on, out = {}, {}, {}
    for a, b in edges:
        n_in[b] = n_in.get(b, 0) + 1
        on.setdefault(a, []).append(b)
    least = {x: 0 for e in edges for x in e if x not in n_in}
    front = list(least)
    while front:
        v = front.pop()
        out[v] = least[v]
        for w in on.get(v, ()):
            least[w] = max(least.get(w, 0), out[v] + 1)
            n_in[w] -= 1
            if not n_in[w]:
                front.append(w)
    return out


def frame(spark, edges):
    return spark.createDataFrame(sorted(edges), "src string, dst string")


def same(spark, edges, which=("strong", "weak", "levels")):
    df = frame(spark, edges)
    calls = {"strong": (components.strong_components, strong, "component"), "weak": (components.weak_components, weak, "component"), "levels": (components.levels, levels, "level")}
    for name in which:
        made, want, column = calls[name]
        assert {r.label: r[column] for r in made(df).collect()} == want(set(edges)), (name, sorted(edges)[:30])


@pytest.mark.parametrize("seed, n, m", [(1, 6, 9), (2, 9, 14), (4, 40, 90)])
def test_random_graphs(spark, seed, n, m):
    rng = random.Random(seed)
    names = [f"n{i:03}" for i in range(n)]
    rng.shuffle(names)
    same(spark, {(rng.choice(names), rng.choice(names)) for _ in range(m)})


def test_graphs_made_of_runs(spark):
    """Rings with tails, rings that share a node, runs between them, trees with long branches, self-loops, two-node cycles."""
    rng = random.Random(5)
    edges, at = set(), 0

    def run(n):
        nonlocal at
        names = [f"{rng.randrange(10**6):06}-{at + i}" for i in range(n)]
        at += n
        edges.update(zip(names, names[1:]))
        return names

    parts = [run(rng.randrange(2, 40)) for _ in range(16)]
    for p in parts[:8]:
        edges.add((p[-1], p[0]))
    for _ in range(12):
        a, b = sorted(rng.sample(range(16), 2))
        edges.add((rng.choice(parts[a]), rng.choice(parts[b])))
    edges |= {(parts[9][0], parts[9][0]), (parts[10][1], parts[10][0]), (parts[11][0], parts[12][0]), (parts[12][0], parts[11][0]), ("alone", "alone")}
    same(spark, edges)
    same(spark, {(a, b) for a, b in edges if a < b}, ("levels",))


def test_no_edges(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert components.strong_components(none).count() == components.weak_components(none).count() == components.levels(none).count() == 0
    loop = frame(spark, {("a", "a")})
    assert [tuple(r) for r in components.strong_components(loop).collect()] == [("a", "a")] and components.levels(loop).count() == 0


@pytest.mark.parametrize("shape", ["chain", "ring"])
def test_a_hundred_thousand_deep(spark, shape):
    ids = list(range(100_000))
    random.Random(7).shuffle(ids)
    names = [f"{i:06}" for i in ids]
    edges = set(zip(names, names[1:])) | ({(names[-1], names[0])} if shape == "ring" else set())
    df = frame(spark, edges)
    strong_of, level_of = components.strong_components(df), components.levels(df)
    if shape == "ring":
        assert strong_of.count() == 100_000 and strong_of.where("component <> '000000'").isEmpty() and level_of.isEmpty()
    else:
        assert strong_of.where("component = label").count() == 100_000
        assert {r.label: r.level for r in level_of.collect()} == {n: i for i, n in enumerate(names)}


def test_only_results_stay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_dir", lambda s: f"file://{tmp_path}")
    same(spark, {("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f")}, ("strong",))
    left = [p.name.rsplit("-", 1)[0] for p in Path(tmp_path, "causeway").iterdir()]
    assert left == ["components"]
    out = storage.kept(spark.range(3).withColumn("x", F.lit("y")))
    assert len(list(Path(tmp_path, "causeway").iterdir())) == 2
    storage.free(out, spark.range(1), None)
    assert len(list(Path(tmp_path, "causeway").iterdir())) == 1
