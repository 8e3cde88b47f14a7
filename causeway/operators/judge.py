"""Answers judged by a rubric: prompts, parsed and clipped scores, totals, and a text report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions import lexicons as lx
from causeway.operators.evaluation import with_truth
from causeway.operators.routing import TEMPLATES, Responder, backoff, respond

REPLY = "metric string, score double, justification string, failure_modes array<string>, strengths array<string>, key_evidence string"
FAILED = "Evaluation failed: no answer in JSON"


def cases(results: DataFrame, truth: DataFrame, key: str = "task_id") -> DataFrame:
    """(case_id, query, prediction, truth) for ``results(key, query, prediction)`` and ``truth(key, truth)``: results
    without a truth stay, what is missing is empty text; a result without an id takes its place in the order of the
    others' text. Of repeated truths the last by ``ord`` counts."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    nameless = results.where(F.col(key).isNull())
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("query").cast("string"), F.col("prediction").cast("string"))) - 1  # over those without an id only
    named = with_truth(results.where(F.col(key).isNotNull()), truth, key).select(F.col(key).cast("string").alias("case_id"), text("query"), text("prediction"), text("truth"))
    return named.union(nameless.select(place.cast("string"), text("query"), text("prediction"), F.lit("")))


def first_of_task(results: DataFrame, task: str, model: str, modes: list[str]) -> DataFrame:
    """The row to judge of one task and model: that of the first of ``modes`` that is there."""
    rows = results.where((F.col("task_id") == task) & (F.col("model") == model) & F.col("mode").isin(modes))
    return rows.orderBy(F.array_position(F.array(*[F.lit(m) for m in modes]), F.col("mode"))).limit(1)


def prompts(judged: DataFrame, rubric: dict[str, int] = lx.RUBRIC) -> DataFrame:
    """(case_id, metric, most, prompt): each case by each metric."""
    rows = judged.select("*", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(top).alias("most")) for m, top in rubric.items()])))
    return rows.select("case_id", "metric", "most", F.format_string(TEMPLATES["judge"], F.col("most").cast("string"), "metric", "query", "prediction", "truth").alias("prompt"))


def scored(answered: DataFrame) -> DataFrame:
    """(case_id, metric, most, score, justification, failure_modes, strengths, key_evidence, error) from ``response``.

    Missing fields are filled with empty ones, scores are cut to 0 and the metric's largest; without JSON the record is an
    error with score 0."""
    p = F.from_json("response", REPLY)
    rows = answered.withColumn("p", p).withColumn("bad", F.col("response").isNull() | F.try_parse_json("response").isNull())
    text = lambda c: F.coalesce(F.col(f"p.{c}"), F.lit(""))
    items = lambda c: F.coalesce(F.col(f"p.{c}"), F.expr("cast(array() as array<string>)"))
    return rows.select(
        "case_id", "metric", "most", F.when(F.col("bad"), 0.0).otherwise(clipped(F.coalesce("p.score", F.lit(0.0)), F.col("most"))).alias("score"),
        F.when(F.col("bad"), FAILED).otherwise(text("justification")).alias("justification"), F.when(F.col("bad"), F.array(F.lit("Judge evaluation error"))).otherwise(items("failure_modes")).alias("failure_modes"),
        F.when(F.col("bad"), F.expr("cast(array() as array<string>)")).otherwise(items("strengths")).alias("strengths"), text("key_evidence").alias("key_evidence"), F.col("bad").alias("error"),
    )


def clipped(score: Column, most: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(score, most.cast("double")))


def judge(judged: DataFrame, responder: Responder | None = None, rubric: dict[str, int] = lx.RUBRIC, attempts: int = 3, pause: Callable[[int], None] = backoff) -> DataFrame:
    """``scored`` records of all cases by all metrics; responses come in batches."""
    return scored(respond(prompts(judged, rubric), responder, attempts, pause))


def totals(records: DataFrame) -> DataFrame:
    """(case_id, overall, percent, n_errors) per case."""
    sums = records.groupBy("case_id").agg(F.sum("score").alias("overall"), F.sum("most").alias("most"), F.count_if("error").alias("n_errors"))
    return sums.select("case_id", "overall", (F.col("overall") / F.col("most") * 100).alias("percent"), "n_errors")


def summary(records: DataFrame) -> DataFrame:
    """(metric, mean, most, percent) over all cases; nothing for no case."""
    means = records.groupBy("metric", "most").agg(F.avg("score").alias("mean"))
    return means.select("metric", "mean", "most", (F.col("mean") / F.col("most") * 100).alias("percent"))


def report(records: DataFrame) -> DataFrame:
    """(part, case_id, text): a text for each case, and one with the means (part 1). A case's text has its metrics' lines."""
    number = lambda c: F.format_string("%.1f", c)
    listed = lambda c, head, mark: F.when(F.size(c) > 0, F.concat(F.lit(f"\n{head}:"), F.array_join(F.transform(c, lambda x: F.concat(F.lit(f"\n  {mark} "), x)), ""))).otherwise("")
    block = F.concat(
        F.lit("\n--- "), "metric", F.lit(" ---\nScore: "), number(F.col("score")), F.lit("/"), F.col("most").cast("string"), F.lit("\nJustification: "), "justification",
        listed(F.col("strengths"), "Strengths", "+"), listed(F.col("failure_modes"), "Failure modes", "-"),
    )
    order = F.array_position(F.array(*[F.lit(m) for m in lx.RUBRIC]), F.col("metric"))
    of_case = records.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("k"), block.alias("b")))).alias("bs"))  # as many as metrics
    cases_ = of_case.join(totals(records), "case_id").select(
        F.lit(0).alias("part"), "case_id", F.concat(F.lit("Case "), "case_id", F.lit(": "), number(F.col("overall")), F.lit(" ("), number(F.col("percent")), F.lit("%)"), F.array_join(F.transform("bs", lambda x: x["b"]), "")).alias("text"),
    )
    line = F.concat("metric", F.lit(": "), number(F.col("mean")), F.lit("/"), F.col("most").cast("string"), F.lit(" ("), number(F.col("percent")), F.lit("%)"))
    means = summary(records).agg(F.array_sort(F.collect_list(F.struct(order.alias("k"), line.alias("l")))).alias("ls"))
    whole = totals(records).agg(F.avg("overall").alias("mean"))
    head = F.concat(F.lit("Mean overall score: "), F.coalesce(number(F.col("mean")), F.lit("none")))
    return cases_.union(means.join(whole).select(F.lit(1), F.lit(None).cast("string"), F.concat_ws("\n", head, F.array_join(F.transform("ls", lambda x: x["l"]), "\n"))))


def write_report(records: DataFrame, path: str) -> None:
    """The report as text files in the order of its parts."""
    report(records).repartitionByRange("part", "case_id").sortWithinPartitions("part", "case_id").select("text").write.mode("overwrite").text(path)
