"""Product codes of vectors by Lloyd's algorithm with filtering over kd-trees.

Components are quantised to integers, floor(``scale`` * x), and everything after that is exact. Vectors are cut into
``parts`` equal consecutive parts, each with a codebook of its own that starts as that part of the vectors with the
smallest ids.

Vectors are dealt into blocks of at most ``block_rows``, and each block builds one kd-tree a part, once: a node is a
range of the block's vectors (cut at the median of its widest dimension) with its bounding box, and the number and
component sums of its vectors. A round sends every tree the codebook, a fixed number of integers, and walks it from the
root with the entries that may still be nearest. Of these the one nearest to the middle of the box is the favourite; an
entry goes if at no corner of the box, and so at no point in it, it is nearer than the favourite. If one entry is left,
the whole subtree is its own by the cached sums; at a leaf with several the vectors are compared with those only. All
nodes of a level are walked at once in numpy. Blocks hand over (part, entry, count, sums), added up by Spark before they
meet: the driver sees as many rows as the codebooks have entries.

A tie goes to the entry with the lower index: one with a higher index than the favourite's goes on equality too, one with a
lower index stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import bounded, free, quoted, written

#: Quantised components are held to this many in size, so that squared distances and their sums are exact longs.
MOST = 1 << 24


class Tree:
    """A kd-tree over the rows of ``points``. Nodes lie in level order, node i's children at 2 i + 1 and 2 i + 2; all
    leaves are on the last level, and node ranges halve, so that shape and ranges follow from the number of rows."""

    def __init__(self, points: np.ndarray, order: np.ndarray, leaf: int):
        self.points, self.order = points[order], order
        self.depth = depth_of(len(points), leaf)
        edges = [edges_of(len(points), d) for d in range(self.depth + 1)]
        self.starts = np.concatenate([e[:-1] for e in edges])
        self.ends = np.concatenate([e[1:] for e in edges])
        at, full = edges[-1][:-1], np.diff(edges[-1]) > 0
        low, high, total = (f.reduceat(self.points, at[full]) for f in (np.minimum, np.maximum, np.add))
        empty = np.iinfo(np.int64).max
        spread = lambda x, fill: _spread(x, full, fill)
        levels = [(spread(low, empty), spread(high, -empty), spread(total, 0))]
        for _ in range(self.depth):
            a, b, s = levels[-1]
            levels.append((np.minimum(a[::2], a[1::2]), np.maximum(b[::2], b[1::2]), s[::2] + s[1::2]))
        self.low, self.high, self.sums = (np.concatenate([x[i] for x in reversed(levels)]) for i in range(3))
        self.counts = self.ends - self.starts

    def walk(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Count and component sums of each entry's vectors, the entry of each row, and how many distances to vectors
        were made."""
        k = len(book)
        counts, sums = np.zeros(k, np.int64), np.zeros(book.shape, np.int64)
        codes, made = np.zeros(len(self.points), np.int16), 0
        nodes, live = np.array([0]), np.ones((1, k), bool)
        above = np.arange(k)[:, None] > np.arange(k)[None, :]  # [entry, favourite]
        for level in range(self.depth + 1):
            keep = self.counts[nodes] > 0
            nodes, live = nodes[keep], live[keep]
            if not len(nodes):
                break
            low, high = self.low[nodes], self.high[nodes]
            middle = distances(low + high, 2 * book)
            middle[~live] = np.iinfo(np.int64).max
            best = middle.argmin(1)
            star = book[best]
            # nearest to an entry, as against the favourite, is the corner towards the entry
            for e in range(k):
                ask = np.flatnonzero(live[:, e] & (best != e))
                if len(ask):
                    corner = np.where(book[e] > star[ask], high[ask], low[ask])
                    gap = ((corner - book[e]) ** 2).sum(1) - ((corner - star[ask]) ** 2).sum(1)
                    live[ask[(gap > 0) | ((gap == 0) & above[e, best[ask]])], e] = False
            sole = live.sum(1) == 1
            own, entry = nodes[sole], best[sole]
            np.add.at(counts, entry, self.counts[own])
            np.add.at(sums, entry, self.sums[own])
            codes[ranges(self.starts[own], self.ends[own])] = np.repeat(entry, self.counts[own])
            nodes, live = nodes[~sole], live[~sole]
            if level < self.depth:
                nodes, live = np.concatenate([2 * nodes + 1, 2 * nodes + 2]), np.concatenate([live, live])
        if len(nodes):
            rows = ranges(self.starts[nodes], self.ends[nodes])
            allowed = np.repeat(live, self.counts[nodes], axis=0)
            away = distances(self.points[rows], book)
            away[~allowed] = np.iinfo(np.int64).max
            made = int(allowed.sum())
            entry = away.argmin(1)  # the first of several
            counts += np.bincount(entry, minlength=k)
            np.add.at(sums, entry, self.points[rows])
            codes[rows] = entry
        out = np.empty_like(codes)
        out[self.order] = codes
        return counts, sums, out, made


def _spread(rows: np.ndarray, full: np.ndarray, fill: int) -> np.ndarray:
    out = np.full((len(full), rows.shape[1]), fill, np.int64)
    out[full] = rows
    return out


def depth_of(n: int, leaf: int) -> int:
    """Levels below the root so that no leaf holds more than ``leaf`` rows."""
    depth = 0
    while n > leaf << depth:
        depth += 1
    return depth


def edges_of(n: int, depth: int) -> np.ndarray:
    """Where the 2 ** depth ranges of a level start, and n."""
    return np.arange((1 << depth) + 1, dtype=np.int64) * n >> depth


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of all ranges, one range after the other."""
    n = ends - starts
    return np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)


def distances(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of each point to each entry, in whole numbers."""
    out = np.zeros((len(points), len(book)), np.int64)
    for d in range(book.shape[1]):
        out += (points[:, d, None] - book[None, :, d]) ** 2
    return out


def ordered(points: np.ndarray, leaf: int) -> np.ndarray:
    """The rows in the order of a kd-tree's leaves: each range of a level is sorted along its widest dimension and halved."""
    order = np.arange(len(points))
    for d in range(depth_of(len(points), leaf)):
        edges = edges_of(len(points), d)
        full = np.diff(edges) > 0
        at = edges[:-1][full]
        held = points[order]
        widest = (np.maximum.reduceat(held, at) - np.minimum.reduceat(held, at)).argmax(1)
        node = np.repeat(np.arange(len(at)), np.diff(edges)[full])
        order = order[np.lexsort((held[np.arange(len(order)), widest[node]], node))]
    return order


def quantised(flat: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(flat.astype(np.float64) * scale), -MOST, MOST).astype(np.int64)


def _kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, vec, label) of the rows whose vectors hold finite numbers only, as doubles; at least one."""
    vec = quoted(vector_col).cast("array<double>")
    whole = vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = quoted(label_col).alias("label") if label_col in vectors.columns else F.lit(None).cast("int").alias("label")
    return vectors.select(quoted(id_col).cast("long").alias("id"), vec.alias("vec"), label).where(F.coalesce(whole, F.lit(False)))


def _blocks(kept: DataFrame, width: int, parts: int, scale: int, block_rows: int, leaf: int, label_type: str) -> DataFrame:
    """The vectors in blocks, each with its kd-trees: ids, labels, quantised components and each tree's order."""
    inner = width // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def block(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            data = quantised(table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False), scale).reshape(-1, width)
            orders = np.stack([ordered(data[:, p * inner : (p + 1) * inner], leaf) for p in range(parts)]).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array([len(data)], pa.int32()), pa.array([table.column("id").to_pylist()], pa.list_(pa.int64())), _one_list(table.column("label")), pa.array([data.astype(np.int32).tobytes()]), pa.array([orders.tobytes()])],
                names=["n", "ids", "labels", "data", "orders"],
            )

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, block_rows - size)
                held.append(piece)
                size, at = size + piece.num_rows, at + piece.num_rows
                if size == block_rows:
                    yield block(pa.Table.from_batches(held))
                    held, size = [], 0
        if held:
            yield block(pa.Table.from_batches(held))

    return written(bounded(kept).mapInArrow(run, f"n int, ids array<long>, labels array<{label_type}>, data binary, orders binary"), "vector-blocks")


def _one_list(column: pa.ChunkedArray) -> pa.ListArray:
    whole = column.combine_chunks()
    return pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole)


def _trees(n: int, data: bytes, orders: bytes, width: int, parts: int, leaf: int) -> Iterator[tuple[int, Tree]]:
    points, places, inner = np.frombuffer(data, np.int32).reshape(n, width), np.frombuffer(orders, np.int32).reshape(parts, n), width // parts
    for p in range(parts):
        yield p, Tree(points[:, p * inner : (p + 1) * inner].astype(np.int64), places[p], leaf)


def _round(blocks: DataFrame, books: np.ndarray, leaf: int) -> list:
    """(part, entry, n, sums, made) of all blocks: as many rows as the codebooks have entries."""
    parts, _, inner = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, data, orders in zip(*(batch.column(c).to_pylist() for c in ("n", "data", "orders"))):
                rows = []
                for p, tree in _trees(n, data, orders, parts * inner, parts, leaf):
                    counts, sums, _, made = tree.walk(books[p])
                    rows += [(p, e, int(counts[e]), sums[e].tolist(), made if e == 0 else 0) for e in range(len(counts))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64()))], names=["part", "entry", "n", "sums", "made"])

    found = blocks.select("n", "data", "orders").mapInArrow(run, "part int, entry int, n long, sums array<long>, made long")
    sums = [F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(inner)]
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.sum("made").alias("made"), *sums).collect()


def fit(blocks: DataFrame, books: np.ndarray, rounds: int = 6, leaf: int = 16) -> tuple[np.ndarray, list[int]]:
    """The codebooks (parts, entries, components) after ``rounds``, and the distances to vectors that each round made."""
    books, made = books.copy(), []
    for _ in range(rounds):
        rows = _round(blocks, books, leaf)
        for r in rows:
            if r.n:
                books[r.part, r.entry] = [int(r[f"s{d}"]) // r.n for d in range(books.shape[2])]  # Python's division rounds down
        made.append(sum(r.made for r in rows))
    return books, made


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, block_rows: int = 8192, leaf: int = 16
) -> DataFrame:
    """(id, label, code, error, codebooks_sha256) per vector that is kept; code has two hex digits a part.

    Rows whose vector is null or empty, holds a null or a component that is not finite are left out, and so are those that
    have another length than the kept row with the smallest id (a null id comes last, of equal ids the smallest vector
    comes first) does; that length must be a multiple of ``parts``. With fewer vectors than ``entries`` the codebooks have fewer
    entries. Quantised components beyond 2^24 in size are held to that. Repeated rows each count and each get a code; an
    empty table gives an empty result; a table without ``label_col`` has null labels; other columns are not read."""
    spark, kept = vectors.sparkSession, _kept(vectors, id_col, vector_col, label_col)
    label_type = kept.schema["label"].dataType.simpleString()
    schema = f"id long, label {label_type}, code string, error long"
    rank = [F.col("id").asc_nulls_last(), "vec"]
    head = kept.select("id", "vec").orderBy(*rank).limit(1).collect()
    if not head:
        return spark.createDataFrame([], schema + ", codebooks_sha256 string")
    width = len(head[0].vec)
    if width % parts:
        raise ValueError(f"vectors of {width} components cannot be cut into {parts} equal parts")
    kept = kept.where(F.size("vec") == width)
    first = kept.select("id", "vec").orderBy(*rank).limit(entries).collect()  # the entries that the codebooks start from
    books = quantised(np.array([r.vec for r in first]), scale).reshape(len(first), parts, width // parts).transpose(1, 0, 2)
    blocks = _blocks(kept, width, parts, scale, block_rows, leaf, label_type)
    books, _ = fit(blocks, books, rounds, leaf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (n, data, orders) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n", "data", "orders")))):
                codes, errors = np.empty((n, parts), np.uint8), np.zeros(n, np.int64)
                points = np.frombuffer(data, np.int32).reshape(n, parts, -1).astype(np.int64)
                for p, tree in _trees(n, data, orders, width, parts, leaf):
                    codes[:, p] = tree.walk(books[p])[2]
                    errors += ((points[:, p] - books[p][codes[:, p]]) ** 2).sum(1)
                said = codes.tobytes().hex()
                said = [said[2 * parts * j : 2 * parts * (j + 1)] for j in range(n)]
                yield pa.RecordBatch.from_arrays([batch.column("ids").slice(i, 1).flatten().cast(pa.int64()), batch.column("labels").slice(i, 1).flatten(), pa.array(said, pa.string()), pa.array(errors)], names=["id", "label", "code", "error"])

    coded = written(blocks.select("n", "ids", "labels", "data", "orders").mapInArrow(run, schema), "vector-codes")
    free(blocks)
    return coded.withColumn("codebooks_sha256", F.lit(digest(books)))


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with the errors added up over equal labels, null ones together: sums a label are made before anything
    is shuffled, and joined back, so that no label's rows meet in one task."""
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
