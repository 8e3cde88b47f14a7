"""Word bigram scores against plain Python counts of words and pairs."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from causeway.llm import lm_scoring
from causeway.llm.queries import op10_lm_scoring


def by_hand(rows, wanted, beta=0.1, kappa=20.0):
    """Each document under models counted anew from all documents but itself."""
    words = [t.encode().split() if t else [] for _, t in rows]
    mine = [i in wanted for i, _ in rows]
    vocabulary = len({w for own in words for w in own})

    def counted(chosen):
        one, two, before = Counter(), Counter(), Counter()
        for own in chosen:
            for v, w in zip([None, *own], own):
                one[w] += 1
                two[v, w] += 1
                before[v] += 1
        return one, two, before, sum(one.values())

    def loss(own, counts, scale):
        one, two, before, total = counts
        out = 0.0
        for v, w in zip([None, *own], own):
            alone = (one[w] * scale + beta) / (total * scale + beta * vocabulary)
            out -= math.log((two[v, w] * scale + kappa * alone) / (before[v] * scale + kappa))
        return out / len(own)

    out = []
    for k, own in enumerate(words):
        others = [n for n in range(len(words)) if n != k]
        everything, target = counted([words[n] for n in others]), counted([words[n] for n in others if mine[n]])
        out.append((len(own), loss(own, target, 1.0), loss(own, everything, target[3] / max(1, everything[3]))) if own else (0, None, None))
    return out


@pytest.mark.parametrize("chunk_bytes", [1, 200, 8 << 20])
@pytest.mark.parametrize("wanted", [[0, 1, 1, None, 77, 9, 12], []])
def test_scores_by_hand(spark, chunk_bytes, wanted):
    rng = random.Random(4)
    texts = ["a b a b c", "a b", None, "", "x y z " * 500, "a b", " \n ", "é 漢字 é", "a"]
    texts += [" ".join(f"w{int(rng.expovariate(0.05))}" for _ in range(rng.randrange(1, 60))) for _ in range(30)]
    rows = list(enumerate(texts)) + [(1, "a b"), (None, "a c")]
    docs = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n long, doc_id long, text string").withColumn("target", F.lit("clash")).withColumn("id", F.lit("clash"))
    found = lm_scoring.score(docs, spark.createDataFrame([(i,) for i in wanted], "id long"), ["n", "target"], chunk_bytes=chunk_bytes)
    got = {r.c0: r for r in found.collect()}
    assert len(got) == len(rows)
    for n, want in enumerate(by_hand(rows, {i for i in wanted if i is not None})):
        r = got[n]
        assert r.c1 == "clash" and r.n_tokens == want[0] and r.in_target == (rows[n][0] in [i for i in wanted if i is not None])
        if want[0]:
            assert abs(r.target_loss - want[1]) < 1e-9 and abs(r.background_loss - want[2]) < 1e-9 and abs(r.score - (want[1] - want[2])) < 1e-9
        else:
            assert (r.target_loss, r.background_loss, r.score) == (None, None, None)


def test_query_tells_all_words_apart(spark, tmp_path):
    """With more words than 2^17 some shared a count before; now a word that only wanted documents hold is always theirs."""
    rows = [(i, " ".join(f"{'good' if i % 2 else 'bad'}{i // 4 * 400 + k}" for k in range(400))) for i in range(800)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in op10_lm_scoring(spark, str(tmp_path)).collect()}
    assert all(got[i].score < 0 for i in range(1, 800, 2)) and all(got[i].score > 0 for i in range(0, 800, 2))
    # each word stands in two documents of its kind, so one other count of it is left
    alone = (1 + 0.1) / (399 * 400 + 0.1 * 400 * 400)
    want = -(math.log((1 + 20 * alone) / (399 + 20)) + 399 * math.log((1 + 20 * alone) / (1 + 20))) / 400
    assert abs(got[1].target_loss - want) < 1e-9


def test_wanted_documents_are_not_favoured(spark):
    """Named or not, a document of the wanted kind scores alike."""
    rng = random.Random(1)
    pools = ([f"a{i}" for i in range(3000)], [f"b{i}" for i in range(3000)])
    rows = [(i, " ".join(rng.choice(pools[i % 2]) if rng.random() < 0.5 else f"u{rng.randrange(10**6)}" for _ in range(120))) for i in range(400)]
    wanted = spark.createDataFrame([(i,) for i in range(0, 400, 4)], "id long")
    got = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), wanted, ["doc_id"]).collect()
    mean = lambda test: (lambda v: sum(v) / len(v))([r.score for r in got if test(r.c0)])
    named, like, other = mean(lambda i: i % 4 == 0), mean(lambda i: i % 4 == 2), mean(lambda i: i % 2 == 1)
    assert abs(named - like) < 0.05 and other - like > 0.3


def test_copies_do_count(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))) for i in range(60)]
    rows += [(100, rows[7][1]), (7, rows[7][1])]
    got = {}
    for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1,)], "id long"), ["doc_id"]).collect():
        got.setdefault(r.c0, []).append(r.score)
    assert len(got[7]) == 2 and min(*got[7], *got[100]) > max(s for i, own in got.items() if i not in (7, 100) for s in own) + 1


def test_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm_scoring.score(empty, spark.createDataFrame([], "id long"), ["doc_id"]).count() == 0


def test_rows_grow_with_the_chunks(spark, monkeypatch):
    """By levels, with the scores of one level; no node is larger than a few chunks though one word is in all of them."""
    made, largest = [], []
    real, size_of = lm_scoring.written, lm_scoring.merged

    def counting(df, name):
        out = real(df, name)
        if name in ("lm-up", "lm-totals"):
            made.append((name, out.count(), 0 if name == "lm-totals" else out.groupBy("block", "prefix").count().agg(F.max("count")).first()[0]))
        return out

    monkeypatch.setattr(lm_scoring, "written", counting)
    rng = random.Random(8)
    rows = [(i, " ".join(["common", *(f"w{rng.randrange(5000)}" for _ in range(40))])) for i in range(240)]
    found, totals = {}, {}
    for n in (30, 240):
        docs = spark.createDataFrame(rows[:n], "doc_id long, text string").repartition(2)
        for bits in (2, 8):
            made.clear()
            got = lm_scoring.score(docs, spark.createDataFrame([(i,) for i in range(0, n, 3)], "id long"), ["doc_id"], chunk_bytes=1000, bits=bits).collect()
            found[n, bits] = {r.c0: r.score for r in got}
            totals[n, bits] = [m for name, m, _ in made if name == "lm-totals"]
            largest += [x for name, _, x in made if name == "lm-up"]
        assert all(abs(found[n, 2][i] - found[n, 8][i]) < 1e-12 for i in found[n, 8])
    assert len(totals[30, 2]) >= 2 and len(totals[240, 2]) > len(totals[30, 2])
    assert max(totals[240, 2]) <= 8 * 2 * max(totals[30, 2]) and max(totals[240, 8]) <= 8.5 * max(totals[30, 8])
    assert max(largest) <= 4 * 4 + 12  # about as many as a level cuts into, whatever the corpus


def test_only_the_scores_stay(spark, tmp_path, monkeypatch):
    from pathlib import Path

    from causeway.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda s: f"file://{tmp_path}")
    rows = [(i, f"some words of {i}") for i in range(30)]
    for bits in (1, 8):
        lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1,)], "id long"), ["doc_id"], chunk_bytes=50, bits=bits).count()
    assert sorted(p.name.rsplit("-", 1)[0] for p in Path(tmp_path, "causeway").iterdir()) == ["lm-scores", "lm-scores"]
