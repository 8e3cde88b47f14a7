"""What a chain of filters removes, in every order, from one pass over the corpus.

Each document has a mask, a bit for each filter that it fails. Over the masks of a part (say a language) and of a label
class (all documents, good ones, toxic ones), 2^F signed parity sums are aggregated: for a set S of filters, the sum of
+1 or -1 by whether a document fails an even or odd number of S. These sums are the Walsh-Hadamard transform of the
counts of documents by mask, so the same transform, divided by 2^F, gives the counts back exactly. They add up, so they
are summed within each task before anything is shuffled, and a row a part and class is all that leaves the corpus.

From the counts every order of the filters is worked out: what each step removes, finds removed already, alone fails,
and what it costs in good and toxic documents. Over all F! orders a document that fails k filters is removed by each of
these in F!/k of them, which gives each filter's Shapley value without walking the orders.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import free, map_batches, quoted, written

CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes that go on with a character.
INNER = bytes(range(0x80, 0xC0))
CLASSES = ("all", "good", "toxic")


@dataclass(frozen=True)
class Filter:
    letter: str
    #: Whether a text (UTF-8, null is empty) with these words fails; None: a copy of an earlier document does.
    fails: Callable[[bytes, list[bytes]], bool] | None


def without(text: bytes, some: bytes) -> int:
    """The bytes of a text that are none of ``some``."""
    return len(text.translate(None, some))


FILTERS = (
    Filter("A", lambda text, words: len(words) < 100),
    Filter("B", lambda text, words: 100 * len(set(words)) < 80 * len(words)),
    Filter("C", lambda text, words: 100 * (len(text) - without(text, CAPITALS)) > 10 * without(text, INNER)),
    Filter("D", lambda text, words: without(text, b"#$%&*|") < len(text)),
    Filter("E", None),
)


def masks(docs: DataFrame, filters: tuple[Filter, ...] = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, mask) per row of ``docs``; bit i of the mask tells whether the row fails filter i.

    A null text is empty, a null part the empty string. A copy fails the filter without a test if a row with a smaller
    id has its text: rows of one id and rows without an id are never smaller than each other, and a row without an id
    fails no such filter. Texts are compared by their SHA-256. Only digests that come again are joined."""
    tests = [(1 << i, f.fails) for i, f in enumerate(filters) if f.fails]

    def of(text: bytes) -> int:
        words = text.split()  # at ASCII white space
        return sum(bit for bit, fails in tests if fails(text, words))

    def batch_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or b"" for t in batch.column(2).to_pylist()]
        made = [pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array([of(t) for t in texts], pa.int32())]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["id", "part", "digest", "own"])

    rows = docs.select(quoted(id_col).cast("long").alias("id"), F.coalesce(quoted(part_col).cast("string"), F.lit("")).alias("part"), quoted(text_col).cast("binary").alias("text"))
    slim = written(map_batches(rows, "id long, part string, digest binary, own int", batch_of), "audit-rows")
    copies = sum(1 << i for i, f in enumerate(filters) if not f.fails)
    again = slim.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").drop("most")
    copy = F.coalesce(F.col("id") > F.col("least"), F.lit(False))
    out = slim.join(again, "digest", "left").select("id", "part", (F.col("own") + F.when(copy, copies).otherwise(0)).cast("int").alias("mask"))
    out._folder = slim._folder
    return out


def _parity(mask: Column, chosen: Column) -> Column:
    return F.bit_count(mask.bitwiseAND(chosen)) % 2


def cells(marked: DataFrame, labels: DataFrame, n_filters: int = len(FILTERS)) -> DataFrame:
    """(part, all, good, toxic) per part of ``marked(id, part, mask)``: arrays of the documents with each mask, of all of
    them and of those that ``labels(id, good, toxic)`` calls so.

    Of several labels of an id one is enough; null labels and ids do not count. Each row of ``marked`` counts."""
    size = 1 << n_filters
    known = labels.where("id is not null").groupBy("id").agg(F.max(F.coalesce(F.col("good"), F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic"), F.lit(False))).alias("toxic"))
    known = known.where("good or toxic")
    # a row without an id has no label; left in the join, such rows would all meet in one task
    named = marked.where("id is not null").join(known, "id", "left").select("part", "mask", "good", "toxic")
    every = named.unionByName(marked.where("id is null").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic")))
    classes = F.array(F.lit("all"), F.when(F.col("good"), F.lit("good")), F.when(F.col("toxic"), F.lit("toxic")))
    rows = every.select("part", "mask", F.explode(F.filter(classes, lambda c: c.isNotNull())).alias("class"))
    signed = [F.sum(1 - 2 * _parity(F.col("mask"), F.lit(s))).cast("long").alias(f"w{s}") for s in range(size)]
    sums = rows.groupBy("part", "class").agg(*signed).select("part", "class", F.array(*[f"w{s}" for s in range(size)]).alias("w"))
    counts = sums.select("part", "class", inverted(F.col("w"), size).alias("n"))
    none = F.array_repeat(F.lit(0).cast("long"), size)
    return counts.groupBy("part").agg(*[F.coalesce(F.max(F.when(F.col("class") == c, F.col("n"))), none).alias(c) for c in CLASSES])


def inverted(sums: Column, size: int) -> Column:
    """The counts by mask of which ``sums`` are the signed parity sums: all are whole, so the division is exact."""
    one = lambda m: F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), F.lit(0).cast("long"), lambda a, s: a + F.element_at(sums, s + 1) * (1 - 2 * _parity(m, s)))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda m: F.shiftright(one(m), size.bit_length() - 1))


def audit(counted: DataFrame, filters: tuple[Filter, ...] = FILTERS) -> DataFrame:
    """One row per part of ``cells``, order of the filters and step of it, zeros included: filter_order, step, kept,
    removed, redundant, unique_fails, good_lost, toxic_lost, shapley. An empty table gives no rows."""
    letters, size, whole = [f.letter for f in filters], 1 << len(filters), factorial(len(filters))
    steps = []  # a fixed list: F! * F
    for order in permutations(range(len(filters))):
        for step, at in enumerate(order):
            steps.append(("".join(letters[i] for i in order), step + 1, 1 << at, sum(1 << i for i in order[:step])))
    known = counted.sparkSession.createDataFrame(steps, "filter_order string, step int, own int, before int")
    # the numbers depend on the filter and on the set of those before it only: 2^(F-1) * F pairs a part, looked up by each order
    pairs = sorted({s[2:] for s in steps})

    every = F.sequence(F.lit(0), F.lit(size - 1))
    hit = lambda m, bits: m.bitwiseAND(F.col(bits)) != 0

    def over(counts: str, test: Callable[[Column], Column], times: Callable[[Column], Column] = lambda m: F.lit(1)) -> Column:
        return F.aggregate(F.filter(every, test), F.lit(0).cast("long"), lambda a, m: a + F.element_at(F.col(counts), m + 1) * times(m))

    removed = lambda m: hit(m, "own") & ~hit(m, "before")
    wide = counted.select("part", *CLASSES, F.inline(F.array(*[F.struct(F.lit(own).alias("own"), F.lit(before).alias("before")) for own, before in pairs])))
    wide = wide.select(
        "part", "own", "before",
        over("all", lambda m: ~hit(m, "own") & ~hit(m, "before")).alias("kept"), over("all", removed).alias("removed"), over("all", lambda m: hit(m, "own") & hit(m, "before")).alias("redundant"),
        F.element_at("all", F.col("own") + 1).alias("unique_fails"), over("good", removed).alias("good_lost"), over("toxic", removed).alias("toxic_lost"),
        over("all", lambda m: hit(m, "own"), lambda m: F.element_at(F.array(*[F.lit(whole // k) for k in range(1, len(filters) + 1)]), F.bit_count(m))).alias("shapley"),
    )
    return wide.join(F.broadcast(known), ["own", "before"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def run(docs: DataFrame, labels: DataFrame, filters: tuple[Filter, ...] = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``audit`` of ``docs`` under ``labels(id, good, toxic)``.

    Null texts are empty and null parts the empty string; repeated rows each count; a null id has no label and is no
    copy; very long texts are read whole; an empty table gives no rows; other columns, whatever their names, are not read."""
    marked = masks(docs, filters, id_col, text_col, part_col)
    counted = written(cells(marked, labels, len(filters)), "audit-cells")
    free(marked)
    return audit(counted, filters)
