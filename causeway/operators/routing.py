"""Three-tier routing of many questions at once, evidence prompts, and results.

Tier 1: a question's words reach an end node. Tier 2: its vector is near a start node from which an end is reached.
Tier 3: neither. Questions that tier 1 answers never enter tier 2. All choices are fixed: shorter paths first, then
by text.
"""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions import lexicons as lx
from causeway.functions import vectors
from causeway.operators import evidence, graph


def question_words(questions: DataFrame) -> DataFrame:
    """(query_id, word) for ``questions(query_id, params)``: the non-null values of the parameter maps."""
    return questions.select("query_id", F.explode(F.filter(F.map_values("params"), lambda v: v.isNotNull() & (v != ""))).alias("word"))


def question_text(questions: DataFrame) -> DataFrame:
    return questions.select("query_id", F.array_join(F.filter(F.map_values("params"), lambda v: v.isNotNull()), " and ").alias("text"))


def _ends(edges: DataFrame, direction: str) -> DataFrame:
    """(label): nodes that hold the label of a leaf (forward) or of a root (inverse), the same for all questions."""
    far = graph.leaves(edges) if direction == "forward" else graph.roots(edges)
    words = far.select(F.lit(0).alias("query_id"), F.col("label").alias("word"))
    return graph.keyword_match_join(graph.nodes(edges), words).select("label").distinct()


def route(questions: DataFrame, edges: DataFrame, vectors_of: DataFrame | None = None, question_vectors: DataFrame | None = None, direction: str = "forward",
          threshold: float = 0.5, max_paths: int = 10, max_hops: int = 4) -> DataFrame:
    """(query_id, tier, similar_node, similarity, paths) for ``questions(query_id, params)``; a path is an array of labels.

    ``vectors_of(label, vec)`` and ``question_vectors(query_id, qvec)`` come from any embedder; without them, the
    hashed default is used. Inverse routing walks the reversed edges from property words to roots."""
    walked = edges if direction == "forward" else graph.reverse(edges)
    labels = graph.nodes(edges)
    ends = graph.kept(_ends(edges, direction))
    starts = graph.keyword_match_join(labels, question_words(questions))
    direct = graph.best_paths(walked, starts, ends, max_paths, max_hops, ["query_id"])
    open_ = questions.join(direct.select("query_id").distinct(), "query_id", "left_anti")

    near_side = graph.roots(edges) if direction == "forward" else graph.leaves(edges)
    if vectors_of is None:
        vectors_of = labels.select("label", vectors.hashed_embedding(F.col("label")).alias("vec"))
    if question_vectors is None:
        question_vectors = question_text(questions).select("query_id", vectors.hashed_embedding(F.col("text")).alias("qvec"))
    candidates = vectors_of.join(near_side, "label", "left_semi")
    nearest = vectors.top_k(question_vectors.join(open_.select("query_id"), "query_id", "left_semi"), candidates, 1).where(F.col("score") > threshold)
    similar = graph.kept(nearest.select("query_id", F.col("label").alias("similar_node"), F.col("score").alias("similarity")))
    analogous = graph.best_paths(walked, similar.select("query_id", F.col("similar_node").alias("label")), ends, max_paths, max_hops, ["query_id"])
    gather = lambda p, tier: p.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("path").alias("p")))).alias("ps")).select("query_id", F.lit(tier).alias("tier"), F.transform("ps", lambda x: x["p"]).alias("paths"))
    two = gather(analogous, 2).join(similar, "query_id", "left")
    one = gather(direct, 1).select("query_id", "tier", "paths", F.lit(None).cast("string").alias("similar_node"), F.lit(None).cast("double").alias("similarity"))
    decided = one.unionByName(two)
    out = questions.select("query_id").join(decided, "query_id", "left").select(
        "query_id", F.coalesce("tier", F.lit(3)).alias("tier"), "similar_node", F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
        F.coalesce("paths", F.expr("cast(array() as array<array<string>>)")).alias("paths"),
    )
    return graph.kept(out)


def mechanisms_of(decisions: DataFrame, edges: DataFrame, direction: str = "forward") -> DataFrame:
    """(query_id, mechanisms) of a decision's paths, blank ones left out."""
    paths = decisions.select("query_id", F.posexplode("paths").alias("n", "path"))
    found = evidence.mechanisms(paths, edges, nonblank=True, flipped=direction == "inverse")
    return found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "step", "mechanism"))), lambda x: x["mechanism"]).alias("mechanisms"))


TEMPLATES = {
    ("forward", 1): "Predict properties from these conditions.\nConditions: %s\nCausal paths:\n%s\nMechanisms:\n%s\nAnswer in JSON.",
    ("forward", 2): "Predict properties by analogy.\nConditions: %s\nClosest known case: %s (similarity %s)\nPath:\n%s\nMechanisms:\n%s\nAnswer in JSON.",
    ("forward", 3): "Predict properties from general knowledge; no evidence was found.\nConditions: %s\nAnswer in JSON.",
    ("inverse", 1): "Propose conditions that give these properties.\nProperties: %s\nCausal paths:\n%s\nMechanisms:\n%s\nAnswer in JSON.",
    ("inverse", 2): "Propose conditions by analogy.\nProperties: %s\nClosest known case: %s (similarity %s, embedding distance %s)\nPath:\n%s\nMechanisms:\n%s\nAnswer in JSON.",
    ("inverse", 3): "Propose conditions from general knowledge; no evidence was found.\nProperties: %s\nAnswer in JSON.",
    ("forward", "baseline"): "You know materials science. Predict properties from these conditions alone, and give a mechanism, a chain of thought and a confidence between 0 and 1.\nConditions: %s\nAnswer in JSON.",
    ("inverse", "baseline"): "You know materials science. Propose conditions for these properties, and give a mechanism, a chain of thought and a confidence between 0 and 1.\nProperties: %s\nAnswer in JSON.",
    ("forward", "naive"): "Predict properties from these conditions and these paths of a knowledge graph.\nConditions: %s\nPaths:\n%s\nAnswer in JSON.",
    ("inverse", "naive"): "Propose conditions for these properties from these paths of a knowledge graph.\nProperties: %s\nPaths:\n%s\nAnswer in JSON.",
    "judge": "Score an answer by one metric, from 0 to %s.\nMetric: %s\nQuestion: %s\nAnswer: %s\nTruth: %s\nReply in JSON with metric, score, justification, failure_modes, strengths, key_evidence.",
}


def said(params: str = "params") -> Column:
    """A parameter map as text, its keys in order."""
    return F.array_join(F.transform(F.array_sort(F.map_keys(params)), lambda k: F.concat(k, F.lit("="), F.coalesce(F.try_element_at(params, k), F.lit("")))), ", ")


def paths_text(paths: str = "paths", between: str = "\n") -> Column:
    return F.array_join(F.transform(paths, lambda p: F.array_join(p, " -> ")), between)


def prompts(questions: DataFrame, decisions: DataFrame, mechanisms: DataFrame, direction: str = "forward", style: str = "tiers") -> DataFrame:
    """(query_id, tier, prompt, fallback): tier 1 shows all paths, tier 2 the first, tier 3 none; the fallback is tier 3's.
    Styles ``baseline`` and ``naive`` have templates of their own."""
    rows = questions.join(decisions, "query_id").join(mechanisms, "query_id", "left").withColumn("said", said())
    lines = lambda c: F.array_join(F.coalesce(c, F.expr("cast(array() as array<string>)")), "\n")
    third = F.format_string(TEMPLATES[direction, 3], "said")
    if style == "baseline":
        text = F.format_string(TEMPLATES[direction, "baseline"], "said")
    elif style == "naive":
        numbered = F.array_join(F.transform("paths", lambda p, i: F.concat(F.lit("Path "), i + 1, F.lit(": "), F.array_join(p, " -> "))), "\n")
        text = F.format_string(TEMPLATES[direction, "naive"], "said", numbered)
    else:
        closest, similarity = F.coalesce("similar_node", F.lit("")), F.col("similarity").cast("string")
        second = [F.col("said"), closest, similarity, *([(1 - F.col("similarity")).cast("string")] if direction == "inverse" else []), F.array_join(F.get("paths", F.lit(0)), " -> "), lines(F.col("mechanisms"))]
        text = (
            F.when(F.col("tier") == 1, F.format_string(TEMPLATES[direction, 1], "said", paths_text(), lines(F.col("mechanisms"))))
            .when(F.col("tier") == 2, F.format_string(TEMPLATES[direction, 2], *second)).otherwise(third)
        )
    return rows.select("query_id", "tier", text.alias("prompt"), third.alias("fallback"))


class Responder(Protocol):
    """What answers prompts: any callable object that can be sent to the workers."""

    def __call__(self, prompts: list[str]) -> list[str]: ...


class EchoResponder:
    """The offline default: a JSON answer made from the prompt alone."""

    def __call__(self, prompts: list[str]) -> list[str]:
        return [json.dumps({"predicted_properties": {}, "confidence": 0.5, "reasoning": p.split("\n", 1)[0]}) for p in prompts]


def json_of(text: str | None) -> str | None:
    """The JSON object of a free text, or None: a marked block, any block, the outermost braces."""
    for pattern in (r"(?s)```json\s*(.*?)\s*```", r"(?s)```\s*(.*?)\s*```", r"(?s)(\{.*\})"):
        found = re.search(pattern, text or "")
        if found:
            try:
                if isinstance(json.loads(found[1]), dict):
                    return found[1]
            except ValueError:
                continue
    return None


def ask(answer: Responder, prompts: list[str], attempts: int, pause: Callable[[int], None]) -> list[str | None]:
    """JSON answers; None where a prompt has failed ``attempts`` times. All prompts go at once, or one by one where the
    batch as a whole fails; those without JSON are asked again after a pause that grows."""
    out: list[str | None] = [None] * len(prompts)
    left = list(range(len(prompts)))

    def try_all(own: list[int]) -> bool:
        try:
            for i, text in zip(own, answer([prompts[i] for i in own])):
                out[i] = json_of(text)
            return True
        except Exception:  # noqa: BLE001 - a backend's failure is a result here
            return False

    for attempt in range(attempts):
        if not try_all(left) and len(left) > 1:
            for i in left:
                try_all([i])
        left = [i for i in left if out[i] is None]
        if not left:
            break
        if attempt + 1 < attempts:
            pause(attempt)
    return out


def backoff(attempt: int) -> None:
    """Waits 2^attempt seconds and up to one more."""
    time.sleep(2**attempt + random.random())


def at_once(attempt: int) -> None:
    """No pause."""


def respond(prompted: DataFrame, responder: Responder | None = None, attempts: int = 3, pause: Callable[[int], None] = backoff) -> DataFrame:
    """``prompted`` with ``response`` (JSON or null), ``answered_tier`` and ``latency_ms`` per row.

    A prompt of tier 1 or 2 that gets no JSON is asked again in the words of tier 3 (``fallback``, if there); without an
    answer to that the response is null, not a failed job. Prompts of an Arrow batch go to the responder together."""
    answer = responder or EchoResponder()
    demote = "fallback" in prompted.columns and "tier" in prompted.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            began = time.perf_counter()
            found = ask(answer, frame["prompt"].tolist(), attempts, pause)
            tiers = frame["tier"].tolist() if "tier" in frame else [0] * len(found)
            again = [i for i, x in enumerate(found) if x is None and tiers[i] in (1, 2)] if demote else []
            for i, text in zip(again, ask(answer, frame["fallback"].iloc[again].tolist(), attempts, pause) if again else []):
                found[i], tiers[i] = text, 3
            took = (time.perf_counter() - began) * 1000 / max(1, len(found))
            yield frame.assign(response=pd.Series(found, dtype=object, index=frame.index), answered_tier=pd.Series(tiers, dtype="int32", index=frame.index), latency_ms=took)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompted.schema.fields) + ", response string, answered_tier int, latency_ms double"
    return prompted.mapInPandas(run, schema)


def results(answered: DataFrame, decisions: DataFrame) -> DataFrame:
    """The unified record per question: those without an answer become error rows of confidence 0."""
    parsed = F.from_json("response", "confidence double, reasoning string, reasoning_type string")
    out = answered.join(decisions.select("query_id", "paths"), "query_id").withColumn("p", parsed)
    fine = F.col("p.confidence").isNotNull()
    tier = F.coalesce("answered_tier", "tier") if "answered_tier" in answered.columns else F.col("tier")
    demoted = (F.col("answered_tier") != F.col("tier")) if "answered_tier" in answered.columns else F.lit(False)
    return out.select(
        "query_id", tier.alias("tier"), F.when(fine, F.col("p.confidence")).otherwise(0.0).alias("confidence"),
        F.when(fine, F.coalesce("p.reasoning_type", F.concat(F.lit("tier_"), tier))).otherwise(F.lit("error")).alias("reasoning_type"),
        F.size("paths").alias("kg_paths_used"), "paths", "response", F.coalesce(demoted, F.lit(False)).alias("demoted"),
        *(["latency_ms"] if "latency_ms" in answered.columns else []),
    )


def naive_paths(questions: DataFrame, edges: DataFrame, direction: str = "forward", properties: list[str] | None = None, conditions: list[str] | None = None) -> DataFrame:
    """(query_id, path, part) without tiers, all of them: from the questions' words to property words; inverse from the
    words to condition words, and from condition words to the words (part 1). Paths found both ways stay twice."""
    labels = graph.nodes(edges)
    words = graph.keyword_match_join(labels, question_words(questions))
    fixed = lambda own: graph.keyword_match(labels, own)
    properties, conditions = properties or lx.NAIVE_PROPERTIES, conditions or lx.NAIVE_CONDITIONS
    if direction == "forward":
        return graph.simple_paths(edges, words, fixed(properties), keys=["query_id"]).withColumn("part", F.lit(0))
    out = graph.simple_paths(edges, words, fixed(conditions), keys=["query_id"]).withColumn("part", F.lit(0))
    # ways from the conditions to the words are those from the words on the reversed edges, read backwards
    back = graph.simple_paths(graph.reverse(edges), words, fixed(conditions), keys=["query_id"])
    return out.union(back.select("query_id", F.reverse("path"), F.lit(1)))


def naive(questions: DataFrame, edges: DataFrame, direction: str = "forward", properties: list[str] | None = None, conditions: list[str] | None = None) -> DataFrame:
    """Decisions without tiers for ``questions(query_id, params)``: all paths, in a fixed order; questions without any
    have none. A question's paths are what its answer is shown, so they come as one list."""
    found = naive_paths(questions, edges, direction, properties, conditions)
    ordered = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("part", evidence.text_of().alias("text"), "path"))).alias("ps"))
    return questions.select("query_id").join(ordered, "query_id", "left").select(
        "query_id", F.lit(1).alias("tier"), F.lit(None).cast("string").alias("similar_node"), F.lit(0.0).alias("similarity"),
        F.coalesce(F.transform("ps", lambda x: x["path"]), F.expr("cast(array() as array<array<string>>)")).alias("paths"),
    )


def kg_sources(decisions: DataFrame, edges: DataFrame, most_paths: int = 5, direction: str = "forward") -> DataFrame:
    """(query_id, source_id, kind, content, confidence): the nodes of the first paths, and their edges' mechanisms.
    Inverse paths run against the edges."""
    paths = decisions.select("query_id", F.posexplode(F.slice("paths", 1, most_paths)).alias("n", "path"))
    of_nodes = paths.select("query_id", F.explode("path").alias("content")).distinct().select("query_id", F.lit("node").alias("kind"), "content", F.lit(1.0).alias("confidence"))
    found = evidence.mechanisms(paths, edges, nonblank=True, flipped=direction == "inverse")
    of_edges = found.select("query_id", F.lit("edge").alias("kind"), F.col("mechanism").alias("content"), F.lit(0.95).alias("confidence")).distinct()
    return of_nodes.union(of_edges).select("query_id", F.md5(F.concat_ws("|", "kind", "content")).alias("source_id"), "kind", "content", "confidence")


def cot_steps(decisions: DataFrame, papers: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Three reasoning steps per question with their confidences: 1 or 0 by paths, 0.8 or 0.3 by papers, the answer's
    own confidence (``answers(query_id, confidence)``) or 0.5."""
    n = papers.groupBy("query_id").agg(F.count("*").alias("n"))
    rows = decisions.join(n, "query_id", "left")
    if answers is not None:
        rows = rows.join(answers.select("query_id", F.col("confidence").alias("own")), "query_id", "left")
    else:
        rows = rows.withColumn("own", F.lit(None).cast("double"))
    step = lambda i, name, c: F.struct(F.lit(i).alias("step_id"), F.lit(name).alias("name"), c.alias("confidence"))
    steps = F.array(
        step(1, "graph evidence", F.when(F.size("paths") > 0, 1.0).otherwise(0.0)), step(2, "literature", F.when(F.coalesce("n", F.lit(0)) > 0, 0.8).otherwise(0.3)), step(3, "synthesis", F.coalesce("own", F.lit(0.5)))
    )
    return rows.select("query_id", F.inline(steps))
