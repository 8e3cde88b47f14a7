import random

import xxhash

from causeway.llm import simhash
from pyspark.sql import functions as F


def brute(rows):
    """(id, fp, component) by comparing all pairs."""
    def fp(t):
        w = (t or "").translate({c: c + 32 for c in range(65, 91)})
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", w) if x]
        if not w:
            return 0
        sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    f = [fp(t) for _, t in rows]
    comp = list(range(len(rows)))
    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if bin(f[i] ^ f[j]).count("1") <= 2:
                comp[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, f[i], min(ids) if ids else None))
    return sorted(out, key=str)


def sample(n=150):
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "délta", "eps", "zeta", "eta", "theta"]
    rows = [(None, "no id here at all"), (7000, None), (7001, ""), (7002, " \t\n"), (7003, "One"), (7004, "one"), (7005, "a b c"), (7005, "a b c")]
    base = " ".join(rng.choice(words) for _ in range(400))
    for i in range(n):
        kind = rng.randrange(3)
        if kind == 0:
            w = base.split()
            w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((i, " ".join(w)))
        else:
            rows.append((i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 30])))))
    return rows


def check(spark, **options):
    rows = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = [(r.id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs, **options).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_brute_force(spark):
    check(spark)


def test_hot_buckets_are_exact(spark):
    check(spark, bucket=2)


def test_other_blocks(spark):
    check(spark, blocks=3)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_one(docs).count() == 0


def test_keep_one(spark):
    rows = sample(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    want = {str(c) for _, _, c in brute(rows)}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(want)
    assert all(r.text == dict(rows)[r.doc_id] for r in kept.collect())


def test_long_texts_repeats_and_clashing_names(spark):
    long = " ".join(f"w{i % 977}" for i in range(150_000))
    rows = [(3, long), (4, long.upper()), (4, long.upper()), (1, "other words here"), (2, None), (7, ""), (None, "x y z"), (None, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("fp", "row", "c0", "a`b", "component_id"):
        docs = docs.withColumn(name, F.lit("own"))
    found = simhash.near_duplicates(docs).collect()
    want = {(i, c) for i, _, c in [(3, 0, 3), (4, 0, 3), (None, 0, 3), (1, 0, 1), (2, 0, 2), (7, 0, 2)]} | {(None, None)}
    assert {(r.id, r.component_id) for r in found} == want and len(found) == len(rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "3", "None"] and all(r["a`b"] == r.row == r.fp == "own" for r in got)
