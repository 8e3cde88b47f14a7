"""Evaluation: joins to ground truth, answer metrics, rubric scores, comparison tables, leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions import lexicons as lx
from causeway.functions.text import contains_any, key_terms, overlap_entails


def task_grid(tasks: DataFrame, models: DataFrame, modes: DataFrame) -> DataFrame:
    """Every task with every model and mode; models and modes are stated lists."""
    return tasks.join(F.broadcast(models)).join(F.broadcast(modes)) if models.isLocal() and modes.isLocal() else tasks.crossJoin(models).crossJoin(modes)


def with_truth(results: DataFrame, truth: DataFrame, key: str = "task_id") -> DataFrame:
    """Results with their ground truth; those without keep nulls. Of repeated truths the last by ``ord`` counts."""
    last = truth.groupBy(key).agg(F.max_by(F.struct(*[c for c in truth.columns if c not in (key, "ord")]), "ord").alias("t")).select(key, "t.*")
    return results.join(last, key, "left")


def without_truth(results: DataFrame, truth: DataFrame, key: str = "task_id") -> DataFrame:
    return results.join(truth, key, "left_anti")


def compare(results: DataFrame, values: list[str], by: tuple[str, ...] = ("model", "mode")) -> DataFrame:
    """Mean and sample deviation of each value per group, as <value>_mean and <value>_std; one row has no deviation."""
    return results.groupBy(*by).agg(*[f(v).alias(f"{v}_{n}") for v in values for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))])


def metric_summary(scored: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, mean, n) over present values, from one pass."""
    long = scored.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


def rubric_clip(scores: Column, rubric: dict[str, int] = lx.RUBRIC) -> Column:
    """A map of scores, each between 0 and its metric's largest; missing ones are 0."""
    return F.create_map(*[x for k, top in rubric.items() for x in (F.lit(k), F.greatest(F.lit(0.0), F.least(F.coalesce(F.try_element_at(scores, F.lit(k)).cast("double"), F.lit(0.0)), F.lit(float(top)))))])


def rubric_total(scores: Column, rubric: dict[str, int] = lx.RUBRIC) -> Column:
    return F.aggregate(F.map_values(rubric_clip(scores, rubric)), F.lit(0.0), lambda a, x: a + x) * 100.0 / sum(rubric.values())


def judge_summary(judged: DataFrame, rubric: dict[str, int] = lx.RUBRIC) -> DataFrame:
    """(metric, mean, max_score, percent) of ``judged(scores map)``; an empty input gives an empty result."""
    long = judged.select(F.explode(rubric_clip(F.col("scores"), rubric)).alias("metric", "score"))
    tops = F.create_map(*[x for k, v in rubric.items() for x in (F.lit(k), F.lit(v))])
    return long.groupBy("metric").agg(F.avg("score").alias("mean")).withColumn("max_score", F.element_at(tops, F.col("metric"))).withColumn("percent", F.col("mean") / F.col("max_score") * 100)


def tier_distribution(decisions: DataFrame) -> DataFrame:
    """(direction, tier, n, share)."""
    counts = decisions.groupBy("direction", "tier").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("direction")))


def leaderboard(rows: DataFrame, column: str, descending: bool = True, visible: list[str] | None = None, category: str = "category") -> DataFrame:
    """Rows with a rank by one column, nulls last either way, ties by method; only visible categories if given."""
    shown = rows if visible is None else rows.where(F.col(category).isin(visible))
    order = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    return shown.withColumn("rank", F.row_number().over(Window.orderBy(order, "method")))


def best_in_column(rows: DataFrame, columns: dict[str, bool]) -> DataFrame:
    """The best present value of each column: the largest, or the smallest where marked so."""
    return rows.agg(*[(F.min(c) if low else F.max(c)).alias(c) for c, low in columns.items()])


def interpolate(points: DataFrame, asked: DataFrame) -> DataFrame:
    """(x, y) at each ``asked(x)`` on the line through ``points(px, py)``; beyond the ends, the end's value.

    Each point becomes the segment to the next one; the question is a range join on the segments."""
    by = Window.orderBy("px")
    seg = points.select(F.col("px").alias("x0"), F.col("py").alias("y0"), F.lead("px").over(by).alias("x1"), F.lead("py").over(by).alias("y1"), F.row_number().over(by).alias("n"))
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1"))
    first, last = (F.col("n") == 1) & (F.col("x") < F.col("x0")), F.col("x1").isNull() & (F.col("x") >= F.col("x0"))
    y = F.when(inside, F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("x") - F.col("x0")) / (F.col("x1") - F.col("x0"))).otherwise(F.col("y0"))
    return asked.join(seg, inside | first | last).select("x", y.alias("y"))


def _any(steps: Column, test) -> Column:
    return F.exists(steps, lambda s: test(F.lower(s)))


def chain_links(steps: Column) -> tuple[Column, Column]:
    """Whether a step ties processing to structure, and one structure to a property."""
    p_to_s = _any(steps, lambda s: s.contains("processing") & s.contains("structure"))
    s_to_p = _any(steps, lambda s: s.contains("structure") & contains_any(s, lx.PROPERTY_WORDS))
    return p_to_s, s_to_p


def _weighted(weights: dict[str, float], parts: dict[str, Column]) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum((F.lit(w) * parts[k] for k, w in weights.items()), F.lit(0.0))))


def answer_metrics(answers: DataFrame) -> DataFrame:
    """Sub-scores, composites and the overall score of each answer.

    Columns: answer_id, has_processing, has_structure, has_properties (boolean), primary_mechanism, alternatives
    (string), steps (array of strings), quantities (map of strings), predictions (map of strings), evidence (array of
    strings), n_claims, n_verified, n_edges, n_edges_verified, n_grounded_steps (from ``reachable_pairs``), similarities
    alt_cosine, prediction_cosine, entailment, source_diversity (double) and n_papers. Nulls count as absent.
    """
    none = F.expr("cast(array() as array<string>)")
    steps, evidence = F.coalesce("steps", none), F.coalesce("evidence", none)
    primary, other = F.coalesce("primary_mechanism", F.lit("")), F.coalesce("alternatives", F.lit(""))
    quantities = F.coalesce(F.map_values("quantities"), none)
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    share = lambda a, b: F.coalesce(F.try_divide(zero(a), zero(b)), F.lit(0.0))
    whole = lambda c: F.coalesce(c, F.lit(False))
    bit = lambda c, v: F.when(whole(c), v).otherwise(0.0)
    n = F.size(steps)
    p_to_s, s_to_p = chain_links(steps)
    all_three = F.col("has_processing") & F.col("has_structure") & F.col("has_properties")

    counterfactual = F.when((F.length(other) > 20) & (F.col("alt_cosine") > 0.3) & (F.col("alt_cosine") < 0.7), F.when(contains_any(other, ["different", "instead"]), 1.0).otherwise(0.8)).otherwise(0.0)
    clear = F.forall(steps, lambda s: contains_any(s, lx.CAUSAL_MARKERS))
    modularity = F.when(n > 0, F.least(F.lit(1.0), bit(clear, 0.5) + bit(F.size(quantities) > 0, 0.3) + bit(F.lower(primary).contains("mechanism"), 0.2))).otherwise(0.0)
    chain = F.when(whole(all_three), 0.4 + bit(p_to_s, 0.3) + bit(s_to_p, 0.3)).otherwise(0.0)
    coherence = {"intervention_consistency": share("n_edges_verified", "n_edges"), "counterfactual_reasoning": counterfactual, "mechanistic_modularity": modularity, "psp_chain_validity": chain}

    papers = zero("n_papers")
    literature = F.when((papers > 0) & (F.size(evidence) > 0), F.greatest(F.lit(0.0), zero("entailment") - F.when(papers > 10, F.least(F.lit(0.2), (papers - 10) * 0.02)).otherwise(0.0))).otherwise(0.0)
    backed = F.size(F.filter(steps, lambda s: F.exists(F.slice(evidence, 1, 5), lambda e: overlap_entails(s, e))))
    multihop = F.when(n >= 2, F.greatest(backed, F.coalesce(F.col("n_grounded_steps").cast("int"), F.lit(0))) / n).otherwise(0.0)
    grounding = {"kg_verification": share("n_verified", "n_claims"), "literature_entailment": literature, "multihop_grounding": multihop, "source_diversity": F.when(F.size(evidence) > 1, zero("source_diversity")).otherwise(0.0)}

    predicted = F.coalesce(F.map_keys("predictions"), none)
    named = F.exists(predicted, lambda k: F.lower(primary).contains(k))
    sufficiency = F.when((primary != "") & (F.size(predicted) > 0), F.least(F.lit(1.0), bit(F.col("prediction_cosine") > 0.5, 0.7) + bit(named, 0.3))).otherwise(0.0)
    terms = F.transform(steps, key_terms)
    joined = F.size(F.filter(F.transform(F.slice(terms, 1, F.greatest(n - 1, F.lit(0))), lambda t, i: F.arrays_overlap(t, F.get(terms, i + 1))), lambda x: whole(x)))
    comprehensive = F.when(n >= 2, joined / (n - 1)).otherwise(0.0)
    contrary = F.size(F.filter(F.zip_with(steps, F.coalesce("step_cosines", F.expr("cast(array() as array<double>)")), lambda s, c: contains_any(s, lx.NEGATIONS) & (c > 0.6)), lambda x: whole(x)))
    consistency = F.greatest(F.lit(0.0), 1 - contrary * 0.3)
    units = F.exists(quantities, lambda v: contains_any(v, lx.UNIT_MARKS))
    precision = F.least(F.lit(1.0), bit(F.size(quantities) > 0, 0.4) + bit(units, 0.3) + bit(contains_any(primary, lx.MECHANISM_TERMS), 0.3))
    middle = F.slice(steps, 2, F.greatest(n - 2, F.lit(0)))
    simulation = F.when(n >= 3, F.size(F.filter(middle, lambda s: contains_any(s, lx.TESTABLE_WORDS))) / F.size(middle)).otherwise(0.0)
    validity = {"sufficiency": sufficiency, "comprehensiveness": comprehensive, "logical_consistency": consistency, "mechanistic_precision": precision, "forward_simulation": simulation}
    pair = F.col("has_processing") & F.col("has_properties")
    psp = F.least(F.lit(1.0), F.when(whole(all_three), 0.4).when(whole(pair), 0.2).otherwise(0.0) + bit(p_to_s, 0.3) + bit(s_to_p, 0.3))

    parts = {**coherence, **grounding, **validity}
    out = answers.select("answer_id", *[v.alias(k) for k, v in parts.items()], psp.alias("psp_consistency_score"))
    columns = {k: F.col(k) for k in parts}
    out = out.select(
        "*", _weighted(lx.COHERENCE_WEIGHTS, columns).alias("causal_coherence_score"), _weighted(lx.GROUNDING_WEIGHTS, columns).alias("source_grounding_score"),
        _weighted(lx.VALIDITY_WEIGHTS, columns).alias("internal_validity_score"),
    )
    four = ["causal_coherence_score", "source_grounding_score", "internal_validity_score", "psp_consistency_score"]
    return out.withColumn("overall_score", sum((F.col(c) for c in four), F.lit(0.0)) / 4)


def distinct_papers(papers: DataFrame, most: int | None = None) -> DataFrame:
    """The first paper (by ``ord``) of each title in lower case, untitled ones left out; cut to the first ``most``
    before they are ordered by citations."""
    first = papers.where(F.coalesce("title", F.lit("")) != "").groupBy(F.lower("title").alias("key")).agg(F.min_by(F.struct("*"), "ord").alias("p")).select("p.*")
    cut = first if most is None else first.orderBy("ord").limit(most)
    return cut.orderBy(F.desc("citations"), "ord")


def literature_context(papers: DataFrame, most: int = 10, length: int = 300) -> DataFrame:
    """One text row of the first ``most`` papers by ``ord``, abstracts cut at ``length`` characters."""
    from causeway.functions.text import shortened

    top = papers.orderBy("ord").limit(most)
    line = F.concat(F.lit("- "), "title", F.lit(" ("), F.col("citations").cast("string"), F.lit(" citations): "), shortened(F.col("abstract"), length))
    return top.agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("ls")).select(F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("context"))


def paper_confidence(citations: Column) -> Column:
    return F.least(F.lit(1.0), 0.5 + citations / 1000)
