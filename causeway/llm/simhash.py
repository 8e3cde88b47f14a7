"""SimHash near-duplicates: pigeonhole blocks, then Hamming verification, then components.

A pair of fingerprints that differ in at most ``distance`` bits agrees on at least ``blocks - distance`` of
``blocks`` bit blocks, so each fingerprint is filed under every choice of that many blocks and only fingerprints
under the same key meet. Equal fingerprints are merged before, so copies never meet as pairs.

A key under which more than ``bucket`` distinct fingerprints lie is not expanded into pairs. Its fingerprints go
to an exact, linear search instead: two fingerprints differ in at most two bits if and only if some 64-bit centre
differs from each in at most one bit, so each is filed under its 65 centres and all that share a centre (65 at
most) are linked to the smallest. Either way no link between different texts is lost.
"""

from __future__ import annotations

import uuid
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import free, map_batches, quoted, written

BITS = 64
SEED = 42


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = SEED, chunk: int = 1 << 16) -> int:
    """The fingerprint of one text as an unsigned integer; zero if the text has no word."""
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n < shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), chunk):
        hashes = [digest(joined[i:j], seed) for i, j in zip(starts[at : at + chunk], ends[at : at + chunk])]
        rows = np.array(hashes, np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.flatnonzero(2 * total > len(starts))
    return int(sum(1 << int(b) for b in set_bits))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) per row of ``docs``; fp holds the 64 bits as a signed long. Null and empty texts have fp 0."""

    def batch_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["id", "fp"])

    slim = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("binary").alias("text"))
    return map_batches(slim, "id long, fp long", batch_of)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def block_masks(blocks: int, distance: int) -> list[int]:
    """The masks of every choice of ``blocks - distance`` out of ``blocks`` bit blocks of near-equal width."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [_signed(sum(chosen)) for chosen in combinations(part, blocks - distance)]


def links(distinct: DataFrame, blocks: int = 5, distance: int = 2, bucket: int = 128) -> DataFrame:
    """Edges (a, b) over the distinct fingerprints ``distinct(fp)`` whose components are those of "at most
    ``distance`` bits differ". Pairs within small buckets are all there; in large buckets, stars stand for them."""
    if not 0 <= distance <= 2:
        raise ValueError("the exact search of large buckets holds for a distance of 0 to 2")
    masks = block_masks(blocks, distance)
    filed = distinct.select(
        "fp",
        F.inline(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])),
    )
    sizes = filed.groupBy("c", "k").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(filed.join(sizes, ["c", "k"]), "simhash-blocks")  # hot blocks are split by Spark's skew join: equal rows have met before

    near = f"bit_count(x ^ y) <= {distance}"
    pairs = (
        shared.where(F.col("n") <= bucket)
        .groupBy("c", "k")
        .agg(F.sort_array(F.collect_list("fp")).alias("l"))
        .select(
            F.inline(
                F.expr(
                    "flatten(transform(l, (x, i) -> transform(filter(slice(l, i + 2, size(l)), y -> "
                    f"{near}), y -> struct(x as a, y as b))))"
                )
            )
        )
    )
    hot = shared.where(F.col("n") > bucket).select("fp").distinct()
    centres = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(BITS)])
    stars = (
        hot.select("fp", F.explode(centres).alias("centre"))
        .groupBy("centre")
        .agg(F.collect_set("fp").alias("l"))  # 65 fingerprints at most
        .where("size(l) > 1")
        .select(F.array_min("l").alias("a"), F.explode("l").alias("b"))
        .where("a <> b")
    )
    if distance < 2:
        stars = stars.where(f"bit_count(a ^ b) <= {distance}") if distance == 0 else _exact_one(hot)
    return pairs.unionByName(stars).distinct()


def _exact_one(hot: DataFrame) -> DataFrame:
    """Links at one differing bit: each fingerprint's 64 neighbours that are there."""
    flips = F.array(*[F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(BITS)])
    return hot.select(F.col("fp").alias("a"), F.explode(flips).alias("b")).join(hot.select(F.col("fp").alias("b")), "b").where("a < b").select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges(a, b)``; root is the smallest node of its component.

    Alternating large-star and small-star steps until the edges are a star forest. Each step is two joins and
    aggregations with partial sums, written to the shared folder; the driver sees only a count and a checksum.
    """
    now, before = written(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct(), "star"), None
    while True:
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
        if not state[0]:
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lower, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", F.col("m").alias("v")))
        older, now = now, written(small.distinct(), "star")
        free(older)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, blocks: int = 5, distance: int = 2, bucket: int = 128
) -> DataFrame:
    """(id, fp, component_id) per row of ``docs``.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows and repeated ids each
    keep a row. A null id never names a component, unless all ids of a component are null. An empty table gives
    an empty result. Other columns of ``docs`` are not read.
    """
    marked = written(fingerprints(docs, id_col, text_col, shingle), "simhash")
    return marked.join(_labels(marked, blocks, distance, bucket), "fp").select("id", "fp", "component_id")


def _labels(marked: DataFrame, blocks: int, distance: int, bucket: int) -> DataFrame:
    """(fp, root, component_id) per distinct fingerprint of ``marked(id, fp)``."""
    least = written(marked.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    rooted = written(components(links(least.select("fp"), blocks, distance, bucket)), "simhash-roots")
    known = least.join(rooted, least.fp == rooted.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    known = written(known, "simhash-known")
    free(least, rooted)
    names = known.groupBy("root").agg(F.min("least").alias("component_id"))
    return known.join(names, "root").select("fp", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id (of several such rows, any one).

    Components are found as in ``near_duplicates``, so null and empty texts are one component; a null id is kept only
    where a component has no other. The kept row carries all its columns, whatever their names; an empty table stays empty.
    """
    shingle = options.get("shingle", 3)
    columns = docs.columns
    wide = docs.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(columns)])
    text_at, id_at = f"c{columns.index(text_col)}", f"c{columns.index(id_col)}"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wide.schema.fields)

    def batch_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.schema.get_field_index(text_at)).cast(pa.binary()).to_pylist()
        values = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
        part = uuid.uuid4().hex
        rows = [f"{part}{i}" for i in range(batch.num_rows)]  # a name of its own for each row
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(values), pa.array(rows)], names=[*batch.schema.names, "fp", "row"])

    marked = written(map_batches(wide, schema + ", fp long, row string", batch_of), "simhash-rows")
    slim = marked.select(F.col(id_at).cast("long").alias("id"), "fp", "row")
    label = _labels(slim, options.get("blocks", 5), options.get("distance", 2), options.get("bucket", 128))
    first = slim.join(label, "fp").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("w")).select(F.col("w.row").alias("row"))
    kept = marked.join(written(first, "simhash-kept"), "row", "left_semi")  # by row, so that no key is hot
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
