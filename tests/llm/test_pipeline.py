"""The stages of the pipeline against plain Python, on a small corpus of its own."""

import brute
import pytest
from test_operators import toxic_case
from test_simhash import brute as components

import corpus_pipeline
from causeway.llm.common import written
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = toxic_case(160)
    passage = " ".join(f"bench{i}" for i in range(20))
    rows += [(500, rows[1][1]), (501, rows[1][1].upper()), (502, rows[2][1] + " " + passage), (503, rows[3][1] + " mail me@x.org or 10.1.1.1"), (504, None), (505, ""), (506, "é漢 plain words here")]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t) if t is not None else None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, dict(labels), passage


def test_stages(spark, corpus):
    folder, rows, labels, passage = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    now, left = docs, dict(rows)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = written(stage(spark, now, folder), "test")
        got = now.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == docs.columns
        if name == "toxicity":
            left = {i: t for i, t in left.items() if not labels.get(i)}
        elif name == "simhash":
            keep = {c for _, _, c in components(list(left.items()))}
            left = {i: t for i, t in left.items() if i in keep}
        elif name == "decontaminate":
            hit = {d[0] for d in brute.contaminated(left.items(), [(1, passage)]) if d[5]}
            assert 502 in hit
            left = {i: t for i, t in left.items() if i not in hit}
        elif name == "pii":
            assert "me@x.org" in left[503]
            left[503] = left[503].replace("me@x.org", "[EMAIL]").replace("10.1.1.1", "[IP]")
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert {r.doc_id: r.text for r in got} == left, name
        else:
            assert {r.doc_id for r in got} == set(left) and all(r.round_trip for r in got)
    assert corpus_pipeline.run(spark, folder).count() == len(left)


def test_stages_on_nothing(spark, corpus):
    folder = corpus[0]
    now = spark.read.parquet(f"{folder}/documents.parquet").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        now = written(stage(spark, now, folder), "test")
        assert now.count() == 0
