"""Vector codes against Lloyd's algorithm in plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.llm import vector_codes


def brute(rows, parts=8, entries=16, rounds=6):
    """rows of (id, vector, label) -> [(id, code, error, label_error)], digest"""
    kept = [(i, v, lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    inner = len(kept[0][1]) // parts
    cut = [[[math.floor(4096 * x) for x in v[p * inner : (p + 1) * inner]] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda c: [min(range(len(books[p])), key=lambda e: (far(c[p], books[p][e]), e)) for p in range(parts)]
    for _ in range(rounds):
        codes = [near(c) for c in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, code in zip(cut, codes) if code[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    codes = [near(c) for c in cut]
    errors = [sum(far(c[p], books[p][code[p]]) for p in range(parts)) for c, code in zip(cut, codes)]
    by = {}
    for (_, _, lab), e in zip(kept, errors):
        by[lab] = by.get(lab, 0) + e
    said = ",".join(str(x) for b in books for e in b for x in e)
    return sorted(((str(i), "".join(f"{x:02x}" for x in code), e, by[lab]) for (i, _, lab), code, e in zip(kept, codes, errors)), key=str), hashlib.sha256(said.encode()).hexdigest()


def vectors(seed, n, width=16, step=0.25):
    """Coarse components, so that ties of distances and repeated vectors are common."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(5)]
    rows = [(i * 2 - 30, [round((c + rng.gauss(0, 0.6)) / step) * step for c in rng.choice(centres)], rng.choice([None, 0, 1, 2])) for i in range(n)]
    rows += [(5000 + i, rows[3][1], 1) for i in range(n // 3)]  # a third are equal
    rows += [rows[4], rows[4], (None, rows[2][1], 0), (9000, None, 1), (9001, [], 1), (9002, [1.0] * (width - 1) + [None], 1), (9003, [float("nan")] * width, 2), (9004, [float("inf")] + [0.0] * (width - 1), 2), (9005, [1.0] * (width + 8), 0)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n, options", [(400, {}), (300, {"block_rows": 37, "leaf": 2}), (90, {"leaf": 1}), (5, {})])
def test_codes_equal_plain_python(spark, n, options):
    rows = vectors(n, n)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).withColumn("id", F.lit("clash")).withColumn("vec", F.lit(0))
    got = vector_codes.with_label_errors(vector_codes.compress(df, **options)).collect()
    want, digest = brute(rows)
    assert sorted(((str(r.id), r.code, r.error, r.label_error) for r in got), key=str) == want
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_nothing_to_code(spark):
    kind = "vec_id long, embedding array<float>, label string"
    for rows in ([], [(1, None, "a"), (2, [float("nan")] * 8, None)]):
        assert vector_codes.with_label_errors(vector_codes.compress(spark.createDataFrame(rows, kind))).count() == 0
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [1.0] * 9, "a")], kind))
    large = vector_codes.compress(spark.createDataFrame([(1, [1e30] * 8, "a"), (2, [-1e30] * 8, "a"), (3, [0.0] * 8, None)], kind)).orderBy("id").collect()
    assert [(r.code, r.error) for r in large] == [("00" * 8, 0), ("01" * 8, 0), ("02" * 8, 0)]
    bare = vector_codes.compress(spark.createDataFrame([(1, [0.5] * 8)], "vec_id long, embedding array<double>"))
    assert [(r.label, r.code) for r in bare.collect()] == [(None, "00" * 8)]


def test_walk_equals_all_distances_and_saves_most():
    rng = np.random.default_rng(2)
    points = (rng.integers(0, 8, (6000, 1, 4)) * 3000 + rng.integers(0, 60, (6000, 1, 4))).reshape(6000, 4)
    book = points[:16].copy()
    book[7] = book[3]  # equal entries: the lower index wins
    tree = vector_codes.Tree(points, vector_codes.ordered(points, 16), 16)
    counts, sums, codes, made = tree.walk(book)
    want = vector_codes.distances(points, book).argmin(1)
    assert (codes == want).all() and (counts == np.bincount(want, minlength=16)).all() and counts[7] == 0
    assert all((sums[e] == points[want == e].sum(0)).all() for e in range(16))
    assert made < 0.5 * 6000 * 16


def test_trees_of_any_size():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 16, 17, 33, 100):
        points = rng.integers(-5, 5, (n, 2))
        tree = vector_codes.Tree(points, vector_codes.ordered(points, 1), 1)
        assert tree.counts[0] == n and (tree.sums[0] == points.sum(0)).all()
        book = rng.integers(-5, 5, (4, 2))
        assert (tree.walk(book)[2] == vector_codes.distances(points, book).argmin(1)).all()


def test_query_equals_its_sql(spark, tmp_path):
    import duckdb
    from oracle import difference

    from causeway.llm.oracles import ORACLE_SQL
    from causeway.llm.queries import op12_vector_codes

    seen, rows = set(), []
    for r in vectors(11, 500, 16):
        if r[0] is not None and r[0] not in seen and not (r[1] and len(r[1]) != 16) and r[1] != []:
            seen.add(r[0])
            rows.append(r)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert difference(op12_vector_codes(spark, str(tmp_path)), con, ORACLE_SQL["op12_vector_codes"]) == ""
