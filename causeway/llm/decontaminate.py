"""Benchmark decontamination by winnowing.

A text is lower-cased in A-Z and cut into words of ASCII letters, digits and non-ASCII characters. Its shingles of
``gram`` words are hashed, and of each run of ``window`` words only the shingle of least hash (of equals the last) is
kept: about two of every seven are. Which one that is depends on the run alone, so a run that a document shares with a
benchmark item leaves the same fingerprint on both sides, and every shared span of ``window`` words or more is met.
An item of fewer words is one run of its own length, with itself as its only shingle.

Both sides' fingerprints are joined by Spark. Each carries the words around it that a run through it may hold; a met
pair is extended word by word to both sides, and where the common words make up a run, all of them are hit. What a
document's fingerprint carries is its own, so no text is read twice, whatever the benchmark's size.

Documents are read once. A Bloom filter of the benchmark's fingerprints, of ``most_bits`` bits at most, goes to the
workers; only fingerprints that pass it leave them. A larger benchmark makes the filter pass more, never less, and the
join is Spark's to choose: it sends the benchmark's table to the workers only where its size is below Spark's own
threshold. Rows without a fingerprint that passes take part in no shuffle.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import annotate, mix, quoted, restored, written

#: Letters A-Z become small, digits, a-z and bytes of non-ASCII characters stay, all else parts words.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
#: A fingerprint: its hash, the length of the runs it stands for, where its shingle starts, the shingle, and the words
#: before (nearest first) and after it.
PRINT = "struct<fp:long,span:int,pos:int,gram:binary,before:array<binary>,after:array<binary>>"
PROBES = 4
BITS_PER_PRINT = 64


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


def shingle_hashes(words: np.ndarray, n: int, span: int) -> np.ndarray:
    """A 64-bit hash of each run of n word hashes, another for each ``span``."""
    h = np.full(max(0, len(words) - n + 1), span, np.uint64)
    for j in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + len(h)]
    return mix(h)


def selected(hashes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Of each run of ``width`` hashes from one of ``starts`` on, where the least is, of equals the last; each once."""
    if not len(starts):
        return starts
    least, at = hashes[starts], starts.copy()
    for j in range(1, width):
        here = hashes[starts + j]
        better = here <= least
        least = np.where(better, here, least)
        at[better] = starts[better] + j
    return at[np.concatenate([[True], at[1:] != at[:-1]])]  # they never go back within a text


class Bloom:
    """Membership of 64-bit hashes: never a wrong no."""

    def __init__(self, table: np.ndarray):
        self.table, self.bits = table, np.uint64(len(table) * 64)

    def has(self, h: np.ndarray) -> np.ndarray:
        """Which of ``h`` may be members."""
        live = np.arange(len(h))
        for j in range(PROBES if len(self.table) else 0):
            own = h[live]
            at = ((own & np.uint64(0xFFFFFFFF)) + np.uint64(j) * (own >> np.uint64(32))) % self.bits
            live = live[(self.table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
        return live if len(self.table) else live[:0]


def bloom_of(prints: DataFrame, most_bits: int) -> Bloom:
    """The filter of ``prints(fp)``; the driver gets one row per 64 bits of it, ``most_bits`` / 64 at most."""
    n = prints.agg(F.count("*")).first()[0]
    if not n:
        return Bloom(np.zeros(0, np.uint64))
    bits = 64
    while bits < min(n * BITS_PER_PRINT, most_bits):
        bits *= 2
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    at = prints.select(F.explode(F.array(*[F.pmod(low + j * high, F.lit(bits)) for j in range(PROBES)])).alias("at"))
    words = at.groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("w")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[words.column("word").to_numpy()] = words.column("w").to_numpy().view(np.uint64)
    return Bloom(table)


def prints_of(texts: list[bytes | None], window: int, gram: int, spans: list[int] | None, bloom: Bloom | None) -> tuple[list[int], list[list[dict]]]:
    """Numbers of words and fingerprints of each text. ``spans``: the run lengths to look for (``window``, and those of
    short items); None for a benchmark, whose texts each have the one that fits."""
    words: list[bytes] = []
    counts = []
    for text in texts:
        own = words_of(text)
        counts.append(len(own))
        words += own
    n = np.array(counts, np.int64)
    ends = np.cumsum(n)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    left = np.repeat(ends, n) - np.arange(len(words))  # words from each on to the end of its text
    length = np.repeat(n, n)
    found: list[list[dict]] = [[] for _ in texts]
    for span in sorted(set(np.minimum(n[n > 0], window).tolist())) if spans is None else spans:
        k = gram if span == window else span
        h = shingle_hashes(hashes, k, span)
        fits = left >= span if spans is not None else (left >= span) & (np.minimum(length, window) == span)
        at = selected(h, np.flatnonzero(fits), span - k + 1)
        if bloom is not None:
            at = at[bloom.has(h[at])]
        reach = span - k
        for p, d in zip(at.tolist(), np.searchsorted(ends, at, "right").tolist()):
            first, end = int(ends[d] - n[d]), int(ends[d])
            found[d].append({
                "fp": int(h[p].view(np.int64)), "span": span, "pos": p - first, "gram": b" ".join(words[p : p + k]),
                "before": words[max(first, p - reach) : p][::-1], "after": words[p + k : min(end, p + k + reach)],
            })
    return counts, found


_KIND = pa.list_(pa.struct([("fp", pa.int64()), ("span", pa.int32()), ("pos", pa.int32()), ("gram", pa.binary()), ("before", pa.list_(pa.binary())), ("after", pa.list_(pa.binary()))]))
#: How many words two lists have in common from their start on.
_COMMON = "coalesce(nullif(array_position(zip_with({a}, {b}, (x, y) -> coalesce(x = y, false)), false), 0) - 1, least(size({a}), size({b})))"


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str],
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    gram: int = 5,
    most_bits: int = 1 << 28,
) -> DataFrame:
    """The columns ``keep`` of ``docs`` as c0, c1, ... with n_words, spans (hit word ranges, end exclusive, merged)
    and items (ids of items with occurring runs, as strings).

    Null and empty texts have no words, on either side. Repeated rows are each looked at; repeated items count once; an
    item without an id marks hits but is not listed. An empty benchmark hits nothing; an empty table gives an empty
    result. Columns of ``docs`` may have any names.
    """
    if not 1 <= gram <= window:
        raise ValueError("a shingle must fit into the window")
    if most_bits < 64:
        raise ValueError("the filter needs 64 bits")
    spark = docs.sparkSession

    def of_items(texts):
        return [pa.array(prints_of(texts, window, gram, None, None)[1], _KIND)]

    items = benchmark.select(quoted(item_col).cast("string").alias("item"), quoted(item_text_col).alias("text"))
    known = annotate(items, "text", ["item"], f"prints array<{PRINT}>", of_items).select(F.col("c0").alias("item"), F.inline("prints")).drop("pos").distinct()
    known = written(known, "benchmark-prints")
    spans = sorted(r.span for r in known.select("span").distinct().collect())  # ``window`` of them at most
    bloom = bloom_of(known.select("fp").distinct(), most_bits)
    sent = spark.sparkContext.broadcast(bloom.table)

    def of_docs(texts):
        counts, found = prints_of(texts, window, gram, spans, Bloom(sent.value))
        return [pa.array(counts, pa.int64()), pa.array(found, _KIND), pa.array([uuid.uuid4().hex if f else None for f in found], pa.string())]

    marked = written(annotate(docs, text_col, keep, f"n_words long, prints array<{PRINT}>, row string", of_docs), "document-prints")
    own = [f"c{i}" for i in range(len(keep))]
    plain = marked.where("row is null").select(*own, "n_words", F.expr("cast(array() as array<struct<s:bigint,e:bigint>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    some = marked.where("row is not null")
    ours = some.select("row", F.inline("prints"))
    theirs = known.select("fp", "item", F.col("gram").alias("their_gram"), F.col("before").alias("their_before"), F.col("after").alias("their_after"))
    met = ours.join(theirs, "fp").where("gram = their_gram").select(
        "row", "item", "span", "pos",
        F.expr(_COMMON.format(a="before", b="their_before")).alias("back"), F.expr(_COMMON.format(a="after", b="their_after")).alias("on"), F.when(F.col("span") == window, gram).otherwise(F.col("span")).alias("k"),
    )
    hits = met.where("back + k + on >= span").select("row", "item", (F.col("pos") - F.col("back")).cast("long").alias("s"), (F.col("pos") + F.col("k") + F.col("on")).cast("long").alias("e"))
    # of a document, at most its words and the benchmark's items
    by_row = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("found"), F.collect_set("item").alias("items"))
    merged = F.aggregate(
        F.col("found"),
        F.expr("cast(array() as array<struct<s:bigint,e:bigint>>)"),
        lambda done, x: F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["e"] >= x["s"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.try_element_at(done, F.lit(-1))["s"].alias("s"), F.greatest(F.try_element_at(done, F.lit(-1))["e"], x["e"]).alias("e"))))
        ).otherwise(F.concat(done, F.array(x))),
    )
    by_row = by_row.select("row", merged.alias("spans"), F.array_sort("items").alias("items"))
    none = lambda c, kind: F.coalesce(c, F.expr(f"cast(array() as array<{kind}>)")).alias(c)
    looked = some.drop("prints").join(by_row, "row", "left").select(*own, "n_words", none("spans", "struct<s:bigint,e:bigint>"), none("items", "string"))
    return plain.unionByName(looked)


def report(hits: DataFrame, id_col: str = "c0") -> DataFrame:
    """Counts per document of what ``find_hits`` found: one row for each of ``hits``, zeros where nothing was."""
    return hits.select(
        F.col(id_col).alias("doc_id"),
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated rows. Null and empty texts stay, repeated rows stay or go together, all
    columns keep their names and values; an empty table stays empty."""
    hits = find_hits(docs, benchmark, docs.columns, **options)
    return restored(hits.where(F.size("spans") == 0), docs.columns)
