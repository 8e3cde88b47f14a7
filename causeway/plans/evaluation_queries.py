"""Vector, diagnosis, evaluation and literature queries."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from causeway.functions import lexicons as lx
from causeway.functions import text as tx
from causeway.functions import vectors
from causeway.operators import benchmark, diagnostics, evaluation, graph, judge
from causeway.plans import views as v
from causeway.sources import kg, records

QUERIES, ORACLE_SQL = {}, {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


_E = "em AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"
_COS = "list_cosine_similarity(q.vec, c.vec)"


def _vectors(spark, sf):
    return v.vec_nodes(spark, sf)


def _asked(vecs):
    return vecs.where("label % 50 = 0").select(F.col("label").alias("query_id"), F.col("vec").alias("qvec"))


@register("cosine_topk", v.with_sql(_E, f"SELECT query_id, label, score, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS rn FROM (SELECT q.vec_id AS query_id, c.vec_id AS label, round({_COS}, 6) AS score FROM em q, em c WHERE q.vec_id % 50 = 0)) WHERE rn <= 5"))
def cosine_topk(spark, sf):
    vecs = _vectors(spark, sf)
    return vectors.top_k(_asked(vecs), vecs, 5)


@register("nearest_node", v.with_sql(_E, f"SELECT q.vec_id AS query_id, n.label, coalesce(n.score, 0.0) AS score FROM em q LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS rn FROM (SELECT q.vec_id AS query_id, c.vec_id AS label, round({_COS}, 6) AS score FROM em q, em c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)) WHERE rn = 1) n ON n.query_id = q.vec_id WHERE q.vec_id % 50 = 0"))
def nearest_node(spark, sf):
    """The nearest other row of each query."""
    vecs = _vectors(spark, sf)
    asked = _asked(vecs)
    best = vectors.top_k(asked, vecs, 1, others=True)
    return asked.select("query_id").join(best, "query_id", "left").select("query_id", "label", F.coalesce("score", F.lit(0.0)).alias("score"))


@register("embedding_distance", v.with_sql(_E, "SELECT q.vec_id AS query_id, c.vec_id, round(1 - list_cosine_similarity(c.vec, q.vec), 6) AS distance FROM em c, em q WHERE q.vec_id % 50 = 0"))
def embedding_distance(spark, sf):
    """The distance of every row from each of the stated queries."""
    vecs = _vectors(spark, sf)
    return vectors.distances(_asked(vecs), vecs).withColumnRenamed("label", "vec_id")


@register("l2_normalize", v.with_sql(_E, "SELECT vec_id, round(list_sum(list_transform(vec, lambda x: x / sqrt(list_sum(list_transform(vec, lambda y: y * y))))), 6) AS total, len(vec) AS size FROM em"))
def l2_normalize(spark, sf):
    unit = _vectors(spark, sf).select("label", vectors.normalised(F.col("vec")).alias("u"))
    return unit.select(F.col("label").alias("vec_id"), F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.size("u").cast("long").alias("size"))


@register("diversity", v.with_sql(_E, "u AS (SELECT vec_id, unnest(vec) AS x, unnest(range(len(vec))) AS i, sqrt(list_sum(list_transform(vec, lambda y: y * y))) AS n FROM em)", "t AS (SELECT sum(s * s) AS a FROM (SELECT sum(x / n) AS s FROM u GROUP BY i))", "SELECT c AS n_nodes, round((a - c) / (c * c), 6) AS avg_similarity, round(1 - (a - c) / (c * c), 6) AS diversity_score FROM t, (SELECT CAST(count(*) AS BIGINT) AS c FROM em)"))
def diversity(spark, sf):
    return diagnostics.diversity(_vectors(spark, sf))


@register("source_diversity", v.with_sql(
    "em AS (SELECT label AS grp, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)",
    f"SELECT q.grp, round(1 - least((sum({_COS}) - sqrt(count(*))) / (count(*) - sqrt(count(*)) + 1e-9), 1.0), 6) AS source_diversity FROM em q JOIN em c USING (grp) GROUP BY q.grp"))
def source_diversity(spark, sf):
    """Of each group of vectors."""
    vecs = v.table(spark, sf, "embeddings").select(F.col("label").alias("grp"), F.col("embedding").alias("vec"))
    return diagnostics.source_diversity(vecs, ["grp"])


_PAIRS = f"pr AS (SELECT q.vec_id AS a, c.vec_id AS b, round({_COS}, 6) AS score FROM em q, em c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND (c.vec_id % 50 <> 0 OR q.vec_id < c.vec_id))"


@register("pair_extremes", v.with_sql(_E, _PAIRS, "SELECT * FROM (SELECT *, 'most' AS side FROM pr ORDER BY score DESC, a, b LIMIT 5) UNION ALL SELECT * FROM (SELECT *, 'least' AS side FROM pr ORDER BY score, a, b LIMIT 5)"))
def pair_extremes(spark, sf):
    vecs = _vectors(spark, sf)
    return diagnostics.pair_extremes(vecs, vecs.where("label % 50 = 0"))


@register("content_quality", v.with_sql(
    v.PSP, """SELECT count(*) AS n_edges, round(avg(CASE WHEN length(trim(mechanism)) = 0 THEN 0.0 ELSE 1.0 END), 6) AS mechanism_coverage,
  round(coalesce(avg(CASE WHEN length(trim(mechanism)) > 0 THEN length(mechanism) END), 0), 6) AS avg_mechanism_length, CAST(1.0 AS DOUBLE) AS property_coverage, round(avg(confidence), 6) AS avg_confidence, count(DISTINCT affected_property) AS n_properties FROM psp"""))
def content_quality(spark, sf):
    return diagnostics.content(v.psp_edges(spark, sf))


@register("first_properties", v.with_sql(v.PSP, "SELECT DISTINCT affected_property FROM psp ORDER BY 1 LIMIT 20"))
def first_properties(spark, sf):
    return diagnostics.first_properties(v.psp_edges(spark, sf))


_COVER = [("forward", ["nation_1", "nation_2"], ["urgent", "high"]), ("forward", ["brand#2"], ["low"]), ("inverse", ["urgent"], ["nation"]), ("inverse", ["zzz"], ["brand"]), ("forward", [""], ["medium"])]
_COVER_SQL = "cq(query_id, type, s, t) AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', [{', '.join(repr(x) for x in a)}], [{', '.join(repr(x) for x in b)}])" for i, (k, a, b) in enumerate(_COVER)) + "))"
_COVERED = "cov AS (SELECT query_id, type, (SELECT count(*) FROM w WHERE len(list_filter(s, lambda x: contains(lower(path[1]), x))) > 0 AND len(list_filter(t, lambda x: contains(lower(last), x))) > 0) AS n_paths FROM cq)"


def _cover(spark, sf):
    return diagnostics.coverage(v.psp_edges(spark, sf), diagnostics.questions(spark, _COVER))


@register("coverage", v.with_sql(v.PSP, v.walks_sql("psp"), _COVER_SQL, _COVERED, "SELECT query_id, type, n_paths, n_paths > 0 AS has_match FROM cov"))
def coverage(spark, sf):
    return _cover(spark, sf)


_SUMMARY = "SELECT count(*) AS total_queries, CAST(sum(CASE WHEN n_paths > 0 THEN 1 ELSE 0 END) AS BIGINT) AS queries_with_match, round(avg(n_paths), 6) AS avg_paths_per_query, round(avg(CASE WHEN n_paths > 0 THEN 1.0 ELSE 0.0 END), 6) AS coverage_rate FROM cov"


@register("coverage_summary", v.with_sql(v.PSP, v.walks_sql("psp"), _COVER_SQL, _COVERED, _SUMMARY))
def coverage_summary(spark, sf):
    return diagnostics.coverage_summary(_cover(spark, sf))


_ADVICE = "CASE " + " ".join(f"WHEN {a} < {b} THEN '{c}'" for a, b, c in diagnostics.RECOMMENDATIONS) + f" ELSE '{diagnostics.ELSE}' END"


@register("gaps", v.with_sql(
    v.PSP, v.walks_sql("psp"), _COVER_SQL, _COVERED, f"s AS ({_SUMMARY})", "g AS (SELECT (SELECT count(*) FROM psp) AS edges, coverage_rate AS rate, unnest([50, 70, 90]) AS target_pct FROM s)",
    "n AS (SELECT *, CASE WHEN rate > 0 THEN CAST(trunc(edges * ((CAST(target_pct AS DOUBLE) / 100) / rate)) AS BIGINT) END AS target_edges FROM g)", "m AS (SELECT *, CASE WHEN target_edges IS NOT NULL THEN greatest(0, target_edges - edges) END AS additional_edges FROM n)",
    f"SELECT target_pct, target_edges, additional_edges, additional_edges // 5 AS min_papers, additional_edges // 2 AS max_papers, {_ADVICE} AS recommendation FROM m"))
def gaps(spark, sf):
    edges = v.psp_edges(spark, sf)
    rate = diagnostics.coverage_summary(_cover(spark, sf)).select(F.col("coverage_rate").alias("rate"))
    return diagnostics.gaps(edges.agg(F.count("*").alias("edges")), rate)


@register("type_counts", v.with_sql(v.PSP, "SELECT psp_type, count(*) AS n FROM psp GROUP BY psp_type"))
def type_counts(spark, sf):
    return diagnostics.type_counts(v.psp_edges(spark, sf))


@register("top_materials", v.with_sql(v.KG, "SELECT material, count(*) AS n FROM kg WHERE material IS NOT NULL GROUP BY material ORDER BY n DESC, material LIMIT 3"))
def top_materials(spark, sf):
    return kg.counts(v.kg_rows(spark, sf).where("material is not null"), "material", 3)


@register("type_rollup", v.with_sql(v.PSP, "SELECT psp_type, material, count(*) AS n FROM psp GROUP BY ROLLUP (psp_type, material)"))
def type_rollup(spark, sf):
    return v.psp_edges(spark, sf).rollup("psp_type", "material").agg(F.count("*").alias("n"))


@register("graph_report", v.with_sql(v.PSP, v.nodes_sql("psp"), v.walks_sql("psp"), _COVER_SQL, _COVERED, f"s AS ({_SUMMARY})", "SELECT 'Graph report' || chr(10) || 'nodes: ' || (SELECT count(*) FROM nodes) || chr(10) || 'edges: ' || (SELECT count(*) FROM psp) || chr(10) || 'acyclic: ' || (SELECT count(*) = 0 FROM w JOIN steps ON steps.src = last AND steps.dst = path[1]) || chr(10) || 'mechanism coverage: ' || (SELECT round(avg(CASE WHEN length(trim(mechanism)) = 0 THEN 0.0 ELSE 1.0 END), 6) FROM psp) || chr(10) || 'coverage rate: ' || coverage_rate AS report FROM s"))
def graph_report(spark, sf):
    edges = v.psp_edges(spark, sf)
    return diagnostics.report(graph.stats(edges), diagnostics.content(edges), diagnostics.coverage_summary(_cover(spark, sf)))


@register("compare", v.with_sql(v.RESULTS, "SELECT model, mode, round(avg(score), 4) AS score_mean, round(stddev_samp(score), 4) AS score_std FROM res GROUP BY model, mode"))
def compare(spark, sf):
    out = evaluation.compare(v.task_results(spark, sf), ["score"])
    return out.select("model", "mode", F.round("score_mean", 4).alias("score_mean"), F.round("score_std", 4).alias("score_std"))


def _truth(spark, sf):
    return v.table(spark, sf, "labels").select(F.col("doc_id").alias("task_id"), "quality", F.lit(0).alias("ord"))


@register("eval_join", v.with_sql(v.RESULTS, "SELECT count(*) AS n, count(quality) AS n_with_truth, CAST(sum(quality) AS BIGINT) AS good, round(sum(CASE WHEN quality IS NOT NULL THEN score END), 2) AS total FROM res LEFT JOIN (SELECT doc_id AS task_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (task_id)"))
def eval_join(spark, sf):
    both = evaluation.with_truth(v.task_results(spark, sf), _truth(spark, sf))
    return both.agg(F.count("*").alias("n"), F.count("quality").alias("n_with_truth"), F.sum("quality").alias("good"), F.round(F.sum(F.when(F.col("quality").isNotNull(), F.col("score"))), 2).alias("total"))


@register("eval_missing", v.with_sql(v.RESULTS, "SELECT task_id, model FROM res WHERE task_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)"))
def eval_missing(spark, sf):
    return evaluation.without_truth(v.task_results(spark, sf), _truth(spark, sf)).select("task_id", "model")


@register("metric_summary", "SELECT metric, round(avg(value), 4) AS mean, count(value) AS n FROM (SELECT 'score' AS metric, o_totalprice AS value FROM orders UNION ALL SELECT 'high_only', CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice END FROM orders) GROUP BY metric")
def metric_summary(spark, sf):
    rows = v.task_results(spark, sf).withColumn("high_only", F.when(F.col("model") == "2-HIGH", F.col("score")))
    return evaluation.metric_summary(rows, ["score", "high_only"]).withColumn("mean", F.round("mean", 4))


_SCORES = {k: ("pmod(task_id, %d) - 5" % m) for k, m in zip(lx.RUBRIC, (60, 45, 30, 20))}
_SCORES_SQL = ", ".join(f"greatest(0.0, least(CAST({t} AS DOUBLE), CAST((task_id % {m}) - 5 AS DOUBLE))) AS {k}" for (k, t), m in zip(lx.RUBRIC.items(), (60, 45, 30, 20)))


def _judged(spark, sf):
    return v.task_results(spark, sf).select("task_id", F.create_map(*[x for k, e in _SCORES.items() for x in (F.lit(k), F.expr(e).cast("double"))]).alias("scores"))


@register("judge_summary", v.with_sql(v.RESULTS, f"j AS (SELECT {_SCORES_SQL} FROM res)", "\nUNION ALL ".join(f"SELECT '{k}' AS metric, round(avg({k}), 6) AS mean, {t} AS max_score, round(avg({k}) / {t} * 100, 6) AS percent FROM j" for k, t in lx.RUBRIC.items())))
def judge_summary(spark, sf):
    out = evaluation.judge_summary(_judged(spark, sf))
    return out.select("metric", F.round("mean", 6).alias("mean"), "max_score", F.round("percent", 6).alias("percent"))


@register("judge_totals", v.with_sql(v.RESULTS, f"j AS (SELECT task_id, {_SCORES_SQL} FROM res)", f"SELECT task_id, round({' + '.join(lx.RUBRIC)}, 6) AS total FROM j"))
def judge_totals(spark, sf):
    return _judged(spark, sf).select("task_id", F.round(evaluation.rubric_total(F.col("scores")), 6).alias("total"))


@register("lit_dedupe", v.with_sql(v.PAPERS, "SELECT ord, title, citations FROM (SELECT *, row_number() OVER (PARTITION BY lower(title) ORDER BY ord) AS rn FROM pap WHERE coalesce(title, '') <> '') WHERE rn = 1"))
def lit_dedupe(spark, sf):
    return evaluation.distinct_papers(v.papers(spark, sf)).select("ord", "title", "citations")


@register("lit_top", v.with_sql(v.PAPERS, "u AS (SELECT ord, title, citations FROM (SELECT *, row_number() OVER (PARTITION BY lower(title) ORDER BY ord) AS rn FROM pap WHERE coalesce(title, '') <> '') WHERE rn = 1)", "SELECT ord, title, citations, round(least(1.0, 0.5 + CAST(citations AS DOUBLE) / 1000), 6) AS confidence FROM (SELECT * FROM u ORDER BY ord LIMIT 10)"))
def lit_top(spark, sf):
    """The first ten papers, then by citations: a top list."""
    top = evaluation.distinct_papers(v.papers(spark, sf), 10)
    return top.select("ord", "title", "citations", F.round(evaluation.paper_confidence(F.col("citations")), 6).alias("confidence"))


@register("lit_context", v.with_sql(v.PAPERS, "SELECT string_agg('- ' || title || ' (' || citations || ' citations): ' || CASE WHEN length(abstract) > 300 THEN left(abstract, 300) || '...' ELSE abstract END, chr(10) ORDER BY ord) AS context FROM (SELECT * FROM pap ORDER BY ord LIMIT 10)"))
def lit_context(spark, sf):
    return evaluation.literature_context(v.papers(spark, sf))


_LIT = ["the heat of", "and with"]


@register("lit_search", v.with_sql(
    v.PAPERS, "words(query, word) AS (VALUES ('the heat of', 'the'), ('the heat of', 'heat'), ('and with', 'and'), ('and with', 'with'))",
    "tok AS (SELECT title, citations, ord, unnest(list_distinct(regexp_split_to_array(lower(abstract), '\\s+'))) AS word FROM pap)",
    "met AS (SELECT DISTINCT query, title, citations, ord FROM tok JOIN words USING (word))", "SELECT query, ord, citations, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY citations DESC, title, ord) AS rn FROM met) WHERE rn <= 3"))
def lit_search(spark, sf):
    """The three most cited papers of each query: a top list."""
    asked = spark.createDataFrame([(q,) for q in _LIT], "query string")
    return records.LiteratureSource.from_table(v.papers(spark, sf), asked).select("query", "ord", "citations", "rank")


_M = v.METHODS


def _methods(spark, sf):
    return v.methods(spark, sf)


@register("leaderboard", v.with_sql(_M, "SELECT method, CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, method) AS INTEGER) AS rank, 'down' AS side FROM mt UNION ALL SELECT method, CAST(row_number() OVER (ORDER BY latency ASC NULLS LAST, method) AS INTEGER), 'up' FROM mt WHERE category IN ('kg', 'full')"))
def leaderboard(spark, sf):
    down = evaluation.leaderboard(_methods(spark, sf), "score").select("method", "rank", F.lit("down").alias("side"))
    return down.union(evaluation.leaderboard(_methods(spark, sf), "latency", False, ["kg", "full"]).select("method", "rank", F.lit("up")))


@register("best_in_column", v.with_sql(_M, "SELECT CAST(max(score) AS DOUBLE) AS score, CAST(min(latency) AS DOUBLE) AS latency FROM mt"))
def best_in_column(spark, sf):
    return evaluation.best_in_column(_methods(spark, sf), {"score": False, "latency": True})


_POINTS = "pt AS (SELECT n_nationkey * 10.0::DOUBLE AS px, (n_regionkey * 3 + n_nationkey % 4) / 7.0::DOUBLE AS py FROM nation), seg AS (SELECT px, py, lead(px) OVER (ORDER BY px) AS qx, lead(py) OVER (ORDER BY px) AS qy, row_number() OVER (ORDER BY px) AS n FROM pt)"


@register("interpolate", v.with_sql(
    _POINTS, "asked AS (SELECT DISTINCT p_partkey % 530 / 2.0::DOUBLE - 9 AS x FROM part)",
    "SELECT x, round(CASE WHEN x >= px AND x < qx THEN py + (qy - py) * (x - px) / (qx - px) ELSE py END, 6) AS y FROM asked JOIN seg ON (x >= px AND x < qx) OR (n = 1 AND x < px) OR (qx IS NULL AND x >= px)"))
def interpolate(spark, sf):
    """Values between the nations' points, and beyond both ends."""
    points = v.table(spark, sf, "nation").select((F.col("n_nationkey") * 10.0).alias("px"), ((F.col("n_regionkey") * 3 + F.col("n_nationkey") % 4) / 7.0).alias("py"))
    asked = v.table(spark, sf, "part").select((F.col("p_partkey") % 530 / 2.0 - 9).alias("x")).distinct()
    return evaluation.interpolate(points, asked).select("x", F.round("y", 6).alias("y"))


@register("scaled_cells", v.with_sql(_M, "SELECT method, round(greatest(0.0, least(100.0, (CAST(score AS DOUBLE) - 3000) / (6000 - 3000) * 100)), 6) AS percent FROM mt WHERE score IS NOT NULL"))
def scaled_cells(spark, sf):
    return _methods(spark, sf).where("score is not null").select("method", F.round(tx.scaled(F.col("score"), 3000.0, 6000.0), 6).alias("percent"))


@register("task_grid", "SELECT r_name AS task, m AS model, d AS mode FROM region, (SELECT unnest(['a', 'b']) AS m), (SELECT unnest(['core', 'full']) AS d)")
def task_grid(spark, sf):
    models, modes = spark.createDataFrame([("a",), ("b",)], "model string"), spark.createDataFrame([("core",), ("full",)], "mode string")
    return evaluation.task_grid(v.table(spark, sf, "region").select(F.col("r_name").alias("task")), models, modes)


_PRIMARY = ["the mechanism is electron doping that changes mobility", "grain growth", "", None, "Mechanism of phonon band_gap"]
_OTHER = ["a different path instead of this one", "short", "another long text without such words", None]
_SAID = [
    "processing sets structure and causes order", "structure leads to mobility and concentration", "order enables mobility", "not one of these", "despite heat the grain results in strain", "Structure produces conductivity",
    "temperature causes growth", "phase order and size", "however, thickness sets order",
]
_BACKING = ["processing sets structure and order", "structure leads to mobility", "order enables heat", "temperature growth"]
_QUANTITIES, _PREDICTIONS = [{"shift": "5 cm"}, {}, {"count": "7"}], [{"mobility": "high"}, {"band_gap": "low", "zz": ""}, {}, None]


def _map(values, key):
    return F.element_at(F.array(*[F.lit(None).cast("map<string,string>") if v is None else F.create_map(*[F.lit(x) for kv in v.items() for x in kv]).cast("map<string,string>") for v in values]), (key % len(values) + 1).cast("int"))


def _lists(values, part, key):
    """Keys or values of the maps, as SQL lists."""
    own = ", ".join("NULL" if x is None else "[" + ", ".join(f"'{y}'" for y in getattr(x, part)()) + "]::VARCHAR[]" for x in values)
    return f"coalesce([{own}][CAST(({key}) % {len(values)} + 1 AS BIGINT)], []::VARCHAR[])"


def _answers(spark, sf):
    """One answer of each part, with every kind of gap."""
    k, n = F.col("p_partkey"), F.col("p_size")
    four = F.array(v.picked(_SAID, k), v.picked(_SAID, k * 3 + n), v.picked(_SAID, n), v.picked(_SAID, k + 5))
    backing = F.array(v.picked(_BACKING, k), v.picked(_BACKING, n), v.picked(_BACKING, k + n))
    part_of = lambda x, m: (x % m).cast("double") / m
    return v.table(spark, sf, "part").select(
        k.alias("answer_id"), (k % 3 > 0).alias("has_processing"), F.when(k % 13 > 0, k % 4 > 0).alias("has_structure"), (n % 2 == 0).alias("has_properties"), v.picked(_PRIMARY, k).alias("primary_mechanism"), v.picked(_OTHER, n).alias("alternatives"),
        F.when(k % 11 > 0, F.slice(four, F.lit(1), (k % 5).cast("int"))).alias("steps"), _map(_QUANTITIES, k).alias("quantities"), _map(_PREDICTIONS, k + n).alias("predictions"), F.slice(backing, F.lit(1), (n % 4).cast("int")).alias("evidence"),
        (k % 4).cast("int").alias("n_claims"), (k % 3).cast("int").alias("n_verified"), (n % 3).cast("int").alias("n_edges"), (n % 2).cast("int").alias("n_edges_verified"), (k % 3).cast("int").alias("n_grounded_steps"), part_of(k, 10).alias("alt_cosine"),
        part_of(n, 10).alias("prediction_cosine"), part_of(k, 7).alias("entailment"), part_of(n, 5).alias("source_diversity"), (k % 15).cast("int").alias("n_papers"), F.array(*[part_of(k + i, 10) for i in range(4)]).alias("step_cosines"),
    )


def _any_of(text, words):
    return f"(len(list_filter([{', '.join(repr(w.lower()) for w in words)}], lambda w: contains(lower({text}), w))) > 0)"


def _metrics_sql():
    pick = v.picked_sql
    said = lambda k: pick(_SAID, k)
    a = f"""a AS (SELECT p_partkey AS answer_id, p_partkey % 3 > 0 AS hp, CASE WHEN p_partkey % 13 > 0 THEN p_partkey % 4 > 0 END AS hs, p_size % 2 = 0 AS hr, coalesce({pick(_PRIMARY, 'p_partkey')}, '') AS m, coalesce({pick(_OTHER, 'p_size')}, '') AS o,
  CASE WHEN p_partkey % 11 > 0 THEN list_slice([{said('p_partkey')}, {said('p_partkey * 3 + p_size')}, {said('p_size')}, {said('p_partkey + 5')}], 1, p_partkey % 5) ELSE []::VARCHAR[] END AS s,
  {_lists(_QUANTITIES, 'values', 'p_partkey')} AS q, {_lists(_PREDICTIONS, 'keys', 'p_partkey + p_size')} AS pk,
  list_slice([{pick(_BACKING, 'p_partkey')}, {pick(_BACKING, 'p_size')}, {pick(_BACKING, 'p_partkey + p_size')}], 1, p_size % 4) AS e,
  p_partkey % 4 AS nc, p_partkey % 3 AS nv, p_size % 3 AS ne, p_size % 2 AS nev, p_partkey % 3 AS ng, (p_partkey % 10) / 10.0::DOUBLE AS ac, (p_size % 10) / 10.0::DOUBLE AS pc, (p_partkey % 7) / 7.0::DOUBLE AS en, (p_size % 5) / 5.0::DOUBLE AS sd, p_partkey % 15 AS np,
  [((p_partkey + 0) % 10) / 10.0::DOUBLE, ((p_partkey + 1) % 10) / 10.0::DOUBLE, ((p_partkey + 2) % 10) / 10.0::DOUBLE, ((p_partkey + 3) % 10) / 10.0::DOUBLE] AS sc FROM part)"""
    words = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: w <> ''))"
    terms = f"list_filter(list_distinct(regexp_extract_all(lower({{0}}), '[a-z][a-z0-9_-]{{{{2,}}}}')), lambda w: NOT list_contains([{', '.join(repr(w) for w in tx.STOPWORDS)}], w))"
    n = "len(s)"
    all3 = "coalesce(hp AND hs AND hr, false)"
    ps = "(len(list_filter(s, lambda x: contains(lower(x), 'processing') AND contains(lower(x), 'structure'))) > 0)"
    sp = f"(len(list_filter(s, lambda x: contains(lower(x), 'structure') AND {_any_of('x', lx.PROPERTY_WORDS)})) > 0)"
    bit = lambda c, x: f"(CASE WHEN {c} THEN {x}::DOUBLE ELSE 0.0 END)"
    share = lambda x, y: f"(CASE WHEN {y} = 0 THEN 0.0 ELSE {x}::DOUBLE / {y} END)"
    backed = f"len(list_filter(s, lambda x: len(list_filter(e[1:5], lambda y: len(list_intersect({words.format('x')}, {words.format('y')}))::DOUBLE / greatest(len({words.format('x')}), 1) > 0.4)) > 0))"
    joined = f"len(list_filter(range(1, len(s)), lambda i: list_has_any({terms.format('s[i]')}, {terms.format('s[i + 1]')})))"
    contrary = f"len(list_filter(range(1, len(s) + 1), lambda i: {_any_of('s[i]', lx.NEGATIONS)} AND sc[i] > 0.6))"
    middle = f"len(list_filter(s[2:len(s) - 1], lambda x: {_any_of('x', lx.TESTABLE_WORDS)}))::DOUBLE"
    parts = {
        "intervention_consistency": share("nev", "ne"),
        "counterfactual_reasoning": f"CASE WHEN length(o) > 20 AND ac > 0.3 AND ac < 0.7 THEN CASE WHEN {_any_of('o', ['different', 'instead'])} THEN 1.0 ELSE 0.8 END ELSE 0.0 END",
        "mechanistic_modularity": f"CASE WHEN {n} > 0 THEN least(1.0, {bit(f'len(list_filter(s, lambda x: {_any_of(chr(120), lx.CAUSAL_MARKERS)})) = {n}', 0.5)} + {bit('len(q) > 0', 0.3)} + {bit(_any_of('m', ['mechanism']), 0.2)}) ELSE 0.0 END",
        "psp_chain_validity": f"CASE WHEN {all3} THEN 0.4 + {bit(ps, 0.3)} + {bit(sp, 0.3)} ELSE 0.0 END",
        "kg_verification": share("nv", "nc"),
        "literature_entailment": "CASE WHEN np > 0 AND len(e) > 0 THEN greatest(0.0, en - CASE WHEN np > 10 THEN least(0.2, (np - 10) * 0.02::DOUBLE) ELSE 0.0 END) ELSE 0.0 END",
        "multihop_grounding": f"CASE WHEN {n} >= 2 THEN greatest({backed}, ng)::DOUBLE / {n} ELSE 0.0 END",
        "source_diversity": "CASE WHEN len(e) > 1 THEN sd ELSE 0.0 END",
        "sufficiency": f"CASE WHEN m <> '' AND len(pk) > 0 THEN least(1.0, {bit('pc > 0.5', 0.7)} + {bit('len(list_filter(pk, lambda x: contains(lower(m), x))) > 0', 0.3)}) ELSE 0.0 END",
        "comprehensiveness": f"CASE WHEN {n} >= 2 THEN {joined}::DOUBLE / ({n} - 1) ELSE 0.0 END",
        "logical_consistency": f"greatest(0.0, 1 - {contrary} * 0.3::DOUBLE)",
        "mechanistic_precision": f"least(1.0, {bit('len(q) > 0', 0.4)} + {bit(f'len(list_filter(q, lambda x: {_any_of(chr(120), lx.UNIT_MARKS)})) > 0', 0.3)} + {bit(_any_of('m', lx.MECHANISM_TERMS), 0.3)})",
        "forward_simulation": f"CASE WHEN {n} >= 3 THEN {middle} / ({n} - 2) ELSE 0.0 END",
        "psp_consistency_score": f"least(1.0, CASE WHEN {all3} THEN 0.4::DOUBLE WHEN hp AND hr THEN 0.2 ELSE 0.0 END + {bit(ps, 0.3)} + {bit(sp, 0.3)})",
    }
    b = "b AS (SELECT answer_id, " + ", ".join(f"CAST({x} AS DOUBLE) AS {k}" for k, x in parts.items()) + " FROM a)"
    mixed = {name: "greatest(0.0, least(1.0, " + " + ".join(f"{w}::DOUBLE * {k}" for k, w in weights.items()) + "))" for name, weights in (("causal_coherence_score", lx.COHERENCE_WEIGHTS), ("source_grounding_score", lx.GROUNDING_WEIGHTS), ("internal_validity_score", lx.VALIDITY_WEIGHTS))}
    c = "c AS (SELECT *, " + ", ".join(f"{x} AS {k}" for k, x in mixed.items()) + " FROM b)"
    columns = ", ".join(f"round({k}, 6) AS {k}" for k in [*parts, *mixed])
    return v.with_sql(a, b, c, f"SELECT answer_id, {columns}, round(({' + '.join(mixed)} + psp_consistency_score) / 4, 6) AS overall_score FROM c")


@register("answer_metrics", _metrics_sql())
def answer_metrics(spark, sf):
    out = evaluation.answer_metrics(_answers(spark, sf))
    return out.select("answer_id", *[F.round(c, 6).alias(c) for c in out.columns if c != "answer_id"])


@register("composite_metrics", "SELECT doc_id, round(greatest(0.0, least(1.0, 0.5 * quality + 0.5 * toxic)), 6) AS composite FROM labels")
def composite_metrics(spark, sf):
    parts = {"quality": F.col("quality"), "toxic": F.col("toxic")}
    return v.table(spark, sf, "labels").select("doc_id", F.round(evaluation._weighted({"quality": 0.5, "toxic": 0.5}, parts), 6).alias("composite"))


@register("result_json", v.with_sql(_M, "SELECT to_json({'method': method, 'category': category}) AS value FROM mt"))
def result_json(spark, sf):
    return records.to_json(_methods(spark, sf).select("method", "category"))


class Rater:
    """A judge that takes an answer's number less five as its score, and has nothing to say to others."""

    def __call__(self, prompts):
        said = [p.split("\nAnswer: ")[1].split("\n")[0] for p in prompts]
        return [json.dumps({"score": int(x) - 5, "strengths": ["s"] * (int(x) % 3)}) if x.isdigit() else "no opinion" for x in said]


_CASES = "cases_ AS (SELECT CAST(c_custkey AS VARCHAR) AS case_id, c_mktsegment AS query, CASE WHEN c_custkey % 7 = 0 THEN 'none' ELSE CAST(c_custkey % 60 AS VARCHAR) END AS prediction, coalesce(CAST(q AS VARCHAR), '') AS truth FROM customer LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) ON doc_id = c_custkey)"
_JUDGED = f"judged AS (SELECT case_id, metric, most, CASE WHEN prediction = 'none' THEN 0.0::DOUBLE ELSE greatest(0.0, least(most, CAST(prediction AS INTEGER) - 5))::DOUBLE END AS score, prediction = 'none' AS error, CAST(CASE WHEN prediction = 'none' THEN 0 ELSE CAST(prediction AS INTEGER) % 3 END AS INTEGER) AS n_strengths FROM cases_, (VALUES {', '.join(f'({chr(39)}{k}{chr(39)}, {x})' for k, x in lx.RUBRIC.items())}) AS r(metric, most))"


def _cases(spark, sf):
    """Customers as results to judge, labels as the truth of some."""
    key = F.col("c_custkey")
    results = v.table(spark, sf, "customer").select(key.alias("task_id"), F.col("c_mktsegment").alias("query"), F.when(key % 7 == 0, "none").otherwise((key % 60).cast("string")).alias("prediction"))
    labels = v.table(spark, sf, "labels").select(F.col("doc_id").alias("task_id"), F.col("quality").alias("truth"), F.col("quality").alias("ord"))
    return judge.cases(results, labels)


@register("judge_cases", v.with_sql(_CASES, "SELECT * FROM cases_"))
def judge_cases(spark, sf):
    return _cases(spark, sf)


@register("judge_records", v.with_sql(_CASES, _JUDGED, "SELECT case_id, metric, score, error, n_strengths FROM judged"))
def judge_records(spark, sf):
    return judge.judge(_cases(spark, sf), Rater(), attempts=1).select("case_id", "metric", "score", "error", F.size("strengths").alias("n_strengths"))


@register("judge_case_totals", v.with_sql(_CASES, _JUDGED, "SELECT case_id, sum(score) AS overall, round(sum(score) / sum(most) * 100, 6) AS percent, count(*) FILTER (error) AS n_errors FROM judged GROUP BY case_id"))
def judge_case_totals(spark, sf):
    out = judge.totals(judge.judge(_cases(spark, sf), Rater(), attempts=1))
    return out.withColumn("percent", F.round("percent", 6))


@register("counts_by_name", "SELECT n AS task, count(*) FILTER (contains(p_name, n)) AS n FROM part, (SELECT unnest(['red', 'o', 'zzz']) AS n) GROUP BY n")
def counts_by_name(spark, sf):
    return records.counts_by_name(v.table(spark, sf, "part"), ["red", "o", "zzz"], "p_name")


@register("benchmark_run")
def benchmark_run(spark, sf):
    """Every nation as a task, with two modes: answers of the offline responder and their scores."""
    tasks = v.table(spark, sf, "nation").select(F.col("n_name").alias("task_id"), F.lit("forward").alias("direction"), F.create_map(F.lit("place"), F.col("n_name")).alias("params"))
    out = benchmark.run(tasks, v.psp_edges(spark, sf), {"echo": None}, ["baseline", "naive"])
    return out.select("task_id", "model", "mode", "tier", "confidence", "reasoning_type", "kg_paths_used", F.round("overall_score", 6).alias("overall_score"))
