"""Line dedup against plain Python, by both ways of probing, and the perfect hash by itself."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.llm import line_dedup

ROWS = "doc_id long, text string"


def brute(rows):
    """(doc_id, n_lines, n_dropped, kept) per row."""
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            own = holders[key(line)]
            first = min((x for x in own if x is not None), default=None)
            if len(key(line)) < 10 or len(own) < 2 or i == first:
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)
    pool = [f"a line of its own {k}" for k in range(60)] + ["ten chars!", "nine char", "ÄÖÜ äöü éé", "漢字漢字漢字漢字漢字", "short", "", "  ", "x" * 70_000]
    vary = lambda s: rng.choice(["", " ", "\t", "\x0b\x0c"]) + rng.choice([s, s.upper(), s.title()]) + rng.choice(["", "\r", "  "])
    rows = [(rng.choice([i, i, i, None]) if i % 17 == 0 else i * 3 - 50, "\n".join(vary(rng.choice(pool)) for _ in range(rng.randrange(0, 12)))) for i in range(n)]
    rows += [rows[5], rows[5], (7000, None), (7001, ""), (7002, "\n\n\n"), (None, "only a nameless one holds this\nand once more this"), (None, "only a nameless one holds this"), (7003, "and once more this"), (7004, "twice in here only\ntwice in here only")]
    rows += [(8000 + i, "one very common line of many documents\n" + f"and a rare one, number {i}") for i in range(200)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"keys_per_shard": 7}, {"most_resident": 0}, {"most_resident": 0, "keys_per_shard": 5, "chunk_bytes": 2000}])
def test_lines_equal_plain_python(spark, options):
    rows = corpus(3)
    docs = spark.createDataFrame(rows, ROWS).repartition(5).withColumn("id", F.lit("clash")).withColumn("kept", F.lit(1)).withColumn("c0", F.lit(2))
    got = line_dedup.dedupe(docs, ["doc_id", "kept"], **options).collect()
    assert sorted((r.c0 is None, r.c0, r.n_lines, r.n_dropped, r.kept) for r in got) == sorted((i is None, i, n, d, k) for i, n, d, k in brute(rows))
    assert all(r.c1 == 1 for r in got)


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_no_rows_and_no_repeats(spark, most):
    assert line_dedup.dedupe(spark.createDataFrame([], ROWS), ["doc_id"], most_resident=most).count() == 0
    alone = spark.createDataFrame([(1, "nothing here comes again"), (2, None)], ROWS)
    assert [(r.n_dropped, r.kept) for r in line_dedup.dedupe(alone, ["doc_id"], most_resident=most).orderBy("c0").collect()] == [(0, "nothing here comes again"), (0, "")]
    with pytest.raises(ValueError):
        line_dedup.dedupe(alone, ["doc_id"], least_docs=1)


def test_lines_of_three_documents(spark):
    rows = [(i, "held by three or more\nheld by two only" if i < 2 else "held by three or more") for i in range(4)]
    got = line_dedup.dedupe(spark.createDataFrame(rows, ROWS), ["doc_id"], least_docs=3).orderBy("c0").collect()
    assert [r.kept for r in got] == ["held by three or more\nheld by two only", "held by two only", "", ""]


def test_perfect_hash():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 63, 5000, 60_000):
        keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        found = line_dedup.PerfectHash.of(keys)
        assert sorted(found(keys).tolist()) == list(range(len(keys)))
        assert n < 5000 or found.sizes.sum() < 4 * len(keys)  # bits
    near = np.arange(4000, dtype=np.uint64)
    assert sorted(line_dedup.PerfectHash.of(near)(near).tolist()) == list(range(4000))
    with pytest.raises(ValueError):
        line_dedup.PerfectHash.of(np.array([7, 7], np.uint64))


def test_shard_tells_strangers_and_equal_halves():
    rng = np.random.default_rng(6)
    keys = rng.integers(0, 1 << 62, 1000).astype(np.uint64)
    keys[10:15] = keys[10]  # hashes that share their first half
    prints = rng.integers(0, 1 << 62, 1000).astype(np.uint64)
    shard = line_dedup.Shard.of(keys, prints, np.arange(2, 1002), np.arange(1000) * -7)
    counts, first = shard.look_up(np.stack([keys, prints], 1))
    assert counts.tolist() == list(range(2, 1002)) and first.tolist() == [-7 * i for i in range(1000)]
    strangers = np.stack([keys, prints + np.uint64(1)], 1)
    assert not shard.look_up(strangers)[0].any()
    assert not shard.look_up(rng.integers(0, 1 << 62, (5000, 2)).astype(np.uint64))[0].any()


def test_query_equals_its_sql(spark, tmp_path):
    import duckdb
    from oracle import difference

    from causeway.llm.oracles import ORACLE_SQL
    from causeway.llm.queries import op11_line_dedup

    rows = [r for r in corpus(4) if r[0] is not None]
    spark.createDataFrame(rows, ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert difference(op11_line_dedup(spark, str(tmp_path)), con, ORACLE_SQL["op11_line_dedup"]) == ""
