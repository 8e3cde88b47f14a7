"""Runs and components found where edges lie, before any round over the whole graph.

Tables often hold the edges of a chain side by side. Each task takes stretches of at most ``STRETCH`` edges and looks at
each by itself: a run goes through nodes with one way in and one way out, and holds good unless another stretch has a node
inside it too, which one aggregation tells; there it is parted. What comes out is right wherever edges lie. Where
neighbours lie apart little is found, and the rounds over the whole graph do the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.operators.storage import free, kept

STRETCH = 1 << 18


def _stretches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.DictionaryArray, int]]:
    """(number, ends, n): the sources and then the targets of ``n`` edges at most ``most``, coded."""
    waiting, n, number = [], 0, TaskContext.get().partitionId() << 32

    def coded() -> pa.DictionaryArray:
        ends = pa.concat_arrays([b.column(c) for c in (0, 1) for b in waiting])
        return ends.dictionary_encode(null_encoding="encode")

    for batch in batches:
        for start in range(0, batch.num_rows, most):
            part = batch.slice(start, most)
            if n and n + part.num_rows > most:
                yield number, coded(), n
                waiting, n, number = [], 0, number + 1
            waiting.append(part)
            n += part.num_rows
    if n:
        yield number, coded(), n


def walked(s: np.ndarray, d: np.ndarray, fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges s -> d in the order of runs, and the length of each run. ``fixed`` nodes are inside none."""
    inner = (np.bincount(s, minlength=len(fixed)) == 1) & (np.bincount(d, minlength=len(fixed)) == 1) & ~fixed
    inner[s[s == d]] = False
    out = np.zeros(len(fixed), np.int64)
    out[s] = np.arange(len(s))
    heads, inside, out, to = np.flatnonzero(~inner[s]).tolist(), inner.tolist(), out.tolist(), d.tolist()
    order, lengths, seen = [], [], bytearray(len(s))

    def walk(e: int) -> None:
        began = len(order)
        while not seen[e]:  # a ring ends where it began
            seen[e] = 1
            order.append(e)
            if inside[to[e]]:
                e = out[to[e]]
        lengths.append(len(order) - began)

    for e in heads:
        walk(e)
    if len(order) < len(s):
        for e in range(len(s)):
            if not seen[e]:
                walk(e)
    return np.array(order, np.int64), np.array(lengths, np.int64)


def contracted(edges: DataFrame, most: int = STRETCH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(inside, rest, table): ``inside(label, a, b, run, w)`` are nodes of one way in and one out, ``w`` edges behind the
    start ``a`` of a run that leads to ``b``; ``rest(src, dst, w)`` has an edge of length ``w`` for each run and each edge
    that is in none, some perhaps repeated. Of a ring without another way in one node stays, with a loop. Both read
    ``table``, which is to be freed."""
    kind = edges.schema["src"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ends, n in _stretches(batches, most):
            names, codes = ends.dictionary, ends.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            pairs = np.unique(codes[:n] * len(names) + codes[n:])
            s, d = pairs // len(names), pairs % len(names)
            order, lengths = walked(s, d, names.is_null().to_numpy(zero_copy_only=False))
            first = np.cumsum(lengths) - lengths
            s, d, of = s[order], d[order], np.repeat(np.arange(len(lengths)), lengths)
            label = lambda at: names.take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [label(s), label(d), label(s[first][of]), label(d[first + lengths - 1][of]), pa.array(np.full(len(s), number)), pa.array(of), pa.array(np.zeros(len(s), np.int64)), pa.array(np.arange(len(s)) - first[of]), pa.array(lengths[of])],
                names=["src", "dst", "a", "b", "stretch", "nth", "part", "pos", "n"],
            )

    schema = f"src {kind}, dst {kind}, a {kind}, b {kind}, stretch long, nth long, part long, pos long, n long"
    found = kept(edges.select("src", "dst").mapInArrow(run, schema), "stretches")
    ends = found.select(F.inline(F.array(F.struct(F.col("src").alias("label"), "stretch"), F.struct(F.col("dst").alias("label"), "stretch"))))
    shared = kept(ends.groupBy("label").agg(F.min("stretch").alias("low"), F.max("stretch").alias("high")).where("low <> high").select("label"), "shared")
    cuts = kept(found.where("pos < n - 1").select("stretch", "nth", "pos", F.col("dst").alias("label")).join(shared, "label", "left_semi").select("stretch", "nth", (F.col("pos") + 1).alias("pos")), "cuts")
    if not cuts.isEmpty():
        older, found = found, kept(_parted(found, cuts), "stretches")
        free(older)
    free(shared, cuts)
    inside = found.where("pos < n - 1").select(F.col("dst").alias("label"), "a", "b", F.struct("stretch", "nth", "part").alias("run"), (F.col("pos") + 1).alias("w"))
    return inside, found.where("pos = n - 1").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("n").alias("w")), found


def _parted(found: DataFrame, cuts: DataFrame) -> DataFrame:
    """``found`` with runs parted before the edges at ``cuts(stretch, nth, pos)``."""
    run = ["stretch", "nth"]
    hurt = cuts.select(*run).distinct()
    before = Window.partitionBy(*run).orderBy("pos")
    rows = found.join(hurt, run, "left_semi").join(cuts.withColumn("cut", F.lit(1).cast("long")), [*run, "pos"], "left")
    rows = rows.withColumn("part", F.sum(F.coalesce("cut", F.lit(0))).over(before))
    own = Window.partitionBy(*run, "part")  # at most a stretch
    ends = {"a": F.min_by("src", "pos").over(own), "b": F.max_by("dst", "pos").over(own), "n": F.count("*").over(own), "pos": F.col("pos") - F.min("pos").over(own)}
    rows = rows.select("src", "dst", *run, "part", *[c.alias(n) for n, c in ends.items()])
    return found.join(hurt, run, "left_anti").unionByName(rows.select(*found.columns))


def near_roots(edges: DataFrame, most: int = STRETCH) -> DataFrame:
    """(label, root): of each node of a stretch, the smallest label that it is connected to there. A node of several
    stretches comes once for each."""
    kind = edges.schema["src"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ends, n in _stretches(batches, most):
            names, codes = ends.dictionary, ends.indices.to_numpy(zero_copy_only=False)
            names, rank = names.take(order := pc.sort_indices(names)), np.empty(len(names), np.int64)  # a null comes last
            rank[order.to_numpy()] = np.arange(len(names))
            s, d = rank[codes[:n]], rank[codes[n:]]
            if names.null_count:
                joined = (s < len(names) - 1) & (d < len(names) - 1)
                s, d = s[joined], d[joined]
            root = np.arange(len(names))
            while True:
                a, b = root[s], root[d]
                apart = a != b
                if not apart.any():
                    break
                np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
                while (root[root] != root).any():
                    root = root[root]
            yield pa.RecordBatch.from_arrays([names, names.take(pa.array(root))], names=["label", "root"])

    return edges.select("src", "dst").mapInArrow(run, f"label {kind}, root {kind}")
