"""The filter audit against filters applied one after the other."""

import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from causeway.llm import filter_audit

ROWS = "doc_id long, text string, lang string"


def fails(rows):
    """Of each row the letters that it fails."""
    out = []
    for i, text, _ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        said = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        out.append(said + "E" * any(j is not None and i is not None and j < i and (u or "") == t for j, u, _ in rows))
    return out


def brute(rows, labels):
    found, out = fails(rows), []
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    for part in {lang or "" for *_, lang in rows}:
        own = [(r[0], f) for r, f in zip(rows, found) if (r[2] or "") == part]
        total, steps = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = list(own)
            for step, x in enumerate(order):
                gone = [d for d in left if x in d[1]]
                failing = [d for d in own if x in d[1]]
                left = [d for d in left if x not in d[1]]
                total[x] += len(gone)
                steps.append((part, "".join(order), step + 1, len(left), len(gone), len(failing) - len(gone), sum(d[1] == x for d in own), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)))
        out += [(*s, total[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def corpus(seed, n=150):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(["word", "WORD", "Wörd", "漢字"]) + str(rng.randrange(rng.choice([20, 4000]))) for _ in range(rng.choice([3, 99, 100, 140]))]
        text = rng.choice([" ", "\n", "\x0b\t"]).join(words) + rng.choice(["", "", " #", " 50%"])
        rows.append((i * 2, text, rng.choice(["en", "de", None, ""])))
    rows += [(1000 - i, rows[0][1], "en") for i in range(40)]  # copies, in falling order
    rows += [rows[3], rows[3], (None, rows[4][1], "de"), (None, None, None), (501, None, "fr"), (503, "", "fr"), (505, "x" * 100_000, "fr"), (507, "AB cd", "en")]
    rng.shuffle(rows)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 1000, 3)] + [(6, 0, 1), (6, 1, 0), (None, 1, 1), (99_999, 1, 1)]
    return rows, labels


def asked(spark, labels):
    return spark.createDataFrame([(i, None if q is None else q == 1, None if x is None else x == 1) for i, q, x in labels], "id long, good boolean, toxic boolean")


def test_audit_equals_the_filters_one_by_one(spark):
    rows, labels = corpus(2)
    docs = spark.createDataFrame(rows, ROWS).repartition(4).withColumn("part", F.lit("clash")).withColumn("id", F.lit("clash")).withColumn("mask", F.lit(9))
    got = sorted(tuple(r) for r in filter_audit.run(docs, asked(spark, labels)).collect())
    assert got == brute(rows, labels)
    assert len({f for f in fails(rows)}) > 8


def test_parity_sums_give_the_counts_back(spark):
    rng = random.Random(1)
    marked = [(i, rng.choice("xy"), rng.randrange(32)) for i in range(500)]
    got = {r.part: r for r in filter_audit.cells(spark.createDataFrame(marked, "id long, part string, mask int"), asked(spark, [(i, i % 2, i % 3) for i in range(500)])).collect()}
    for part in "xy":
        count = lambda test: [sum(p == part and m == k and test(i) for i, p, m in marked) for k in range(32)]
        assert (list(got[part]["all"]), list(got[part].good), list(got[part].toxic)) == (count(lambda i: True), count(lambda i: i % 2 == 1), count(lambda i: i % 3 == 1))


def test_no_rows_no_labels_and_other_filters(spark):
    none = asked(spark, [])
    assert filter_audit.run(spark.createDataFrame([], ROWS), none).count() == 0
    two = (filter_audit.Filter("x", lambda text, words: len(words) > 1), filter_audit.Filter("y", None))
    docs = spark.createDataFrame([(1, "a b", "en"), (2, "a b", "en"), (3, "c", "en")], ROWS)
    got = sorted(tuple(r) for r in filter_audit.run(docs, none, two).collect())
    assert got == [("en", "xy", 1, 1, 2, 0, 1, 0, 0, 3), ("en", "xy", 2, 1, 0, 1, 0, 0, 0, 1), ("en", "yx", 1, 2, 1, 0, 0, 0, 0, 1), ("en", "yx", 2, 1, 1, 1, 1, 0, 0, 3)]


def test_query_equals_its_sql(spark, tmp_path):
    import duckdb
    from oracle import difference

    from causeway.llm.oracles import ORACLE_SQL
    from causeway.llm.queries import op13_filter_audit

    rows, labels = corpus(5)
    spark.createDataFrame(rows, ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert difference(op13_filter_audit(spark, str(tmp_path)), con, ORACLE_SQL["op13_filter_audit"]) == ""
