"""Quality rules whose cutoffs carry a risk guarantee.

Each rule rejects a document whose feature lies beyond a cutoff. Labelled documents are dealt by a hash of their ids
into a learning part and a holdout. On the learning part a rule's grid steps are given levels of badness, by stratum:
the log-odds of bad to good documents at or beyond a step, made monotone, in tenths. A document's level is the largest
that any rule gives it, so one number a stratum, the level allowed, sets the cutoffs of all rules together.

That number is selected on the holdout, with a guarantee for the rules taken together: with k of n good holdout
documents above a level, the exact binomial test of "more than a share ``total_risk`` of the good ones are rejected"
must be significant, which is the same as an exact (Clopper-Pearson) upper bound below it. Levels are tested from
lenient to strict, each rejecting all that the one before rejects, and testing stops at the first failure, so neither
the grid nor the number of rules costs a correction; over strata the error ``delta`` is split evenly. So no stratum
loses more than ``total_risk`` of its good documents, with confidence 1 - ``delta`` for all strata at once.

Of the levels so certified, the one that best parts bad from good holdout documents is taken (of equals the most
lenient); a stratum where it gains less than ``least_gain``, or with too few labels for any certificate, has no rules.
With a risk of 2 % and four strata that takes 217 good holdout documents.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import map_batches, quoted, written

SPACES = b" \t\n\x0b\x0c\r"
NOT_WORD = SPACES + bytes(range(0x80, 0xC0))  # white space, and continuation bytes of UTF-8
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(0x41, 0x5B))
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long"
FEATURE_NAMES = [x.split()[0] for x in FEATURES.split(", ")]
#: rule: numerator, denominator, and whether small values are the bad ones
RULES = {
    "symbol_share": ("n_symbols", "n_words", False),
    "dup_line_share": ("n_dup_lines", "n_lines", False),
    "repeat_share": ("n_repeat_words", "n_words", False),
    "upper_share": ("n_upper", "word_chars", False),
    "long_words": ("word_chars", "n_words", False),
    "short_words": ("word_chars", "n_words", True),
}
#: Width of a grid step and number of steps; values beyond the grid count in its last step.
GRID = {rule: (0.25, 160) if rule.endswith("_words") else (0.01, 100) for rule in RULES}
#: Highest level; tenths of the labelled documents that are learnt from; most strata that are sent to the workers.
TOP = 60
LEARN_TENTHS = 3
MOST_STRATA = 1000


def features(text: bytes | None) -> tuple[int, ...]:
    """FEATURES of one text; a null text has none of anything."""
    if not text:
        return (0,) * len(FEATURE_NAMES)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = len(text.translate(None, NOT_WORD))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    upper = len(text) - len(text.translate(None, UPPER))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines), upper


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that the text has twice or more."""
    n = len(words)
    known: dict[bytes, int] = {}
    ids = [known.setdefault(w, len(known)) for w in words]
    if n < 4 or len(known) == n:
        return 0
    a = np.array(ids, np.int64)
    if len(known) >= 1 << 21:  # three ids do not fit into 63 bits: number the pairs first
        pairs = np.unique((a[:-1] << 31) | a[1:], return_inverse=True)[1].ravel()
        windows = (pairs[:-1].astype(np.int64) << 31) | a[2:]
    else:
        windows = (a[:-2] << 42) | (a[1:-1] << 21) | a[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = twice.copy()
    covered[1:] |= twice[:-1]
    covered[2:] |= twice[:-2]
    return int(covered.sum())


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(id, stratum, FEATURES) per row of ``docs``."""

    def batch_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([features(t) for t in batch.column(2).to_pylist()], np.int64)
        made = [pa.array(rows[:, i]) for i in range(rows.shape[1])]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["id", "stratum", *FEATURE_NAMES])

    slim = docs.select(
        quoted(id_col).cast("long").alias("id"),
        F.coalesce(quoted(stratum_col).cast("string"), F.lit("null")).alias("stratum"),
        quoted(text_col).cast("binary").alias("text"),
    )
    return map_batches(slim, f"id long, stratum string, {FEATURES}", batch_of)


def step_of(rule: str) -> Column:
    """The grid step of a document's value; strict cutoffs are small steps (large for ``short_words``)."""
    over, under, _ = RULES[rule]
    width, steps = GRID[rule]
    value = F.try_divide(F.col(over), F.col(under))
    return F.least(F.floor(F.coalesce(value, F.lit(0.0)) / width + 1e-9), F.lit(steps)).cast("int")


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k)."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    log_choose = math.lgamma(n + 1) - np.array([math.lgamma(x + 1) + math.lgamma(n - x + 1) for x in i])
    return float(min(1.0, np.exp(log_choose + i * math.log(p) + (n - i) * math.log1p(-p)).sum()))


def levels(steps: np.ndarray, good: np.ndarray, bad: np.ndarray, low_is_bad: bool, size: int) -> np.ndarray:
    """The level of each step 0 .. ``size`` of one rule, from ``good`` and ``bad`` learning documents at ``steps``.

    A step that no learning document has takes the level of the nearest more lenient one that has; beyond those, 0."""
    order = np.argsort(-steps if low_is_bad else steps, kind="stable")  # lenient first
    steps, good, bad = steps[order], good[order], bad[order]
    beyond = lambda n: np.cumsum(n[::-1])[::-1]
    odds = np.log((beyond(bad) + 0.5) / (bad.sum() + 1)) - np.log((beyond(good) + 0.5) / (good.sum() + 1))
    own = np.clip(np.floor(10 * np.maximum.accumulate(odds) + 1e-9), 0, TOP).astype(np.int64)
    out = np.zeros(size + 1, np.int64)
    for step, level in zip(steps.tolist(), own.tolist()):
        if low_is_bad:
            out[: step + 1] = level
        else:
            out[step:] = level
    return out


def choose(at: np.ndarray, good: np.ndarray, bad: np.ndarray, risk: float, error: float, least_gain: float) -> int | None:
    """The level allowed in one stratum (documents above it are rejected), or None, from holdout documents at levels ``at``."""
    n, m = int(good.sum()), int(bad.sum())
    if not n or not m:
        return None
    best, taken = least_gain, None
    for level in range(TOP, -1, -1):
        k = int(good[at > level].sum())
        if binomial_cdf(k, n, risk) > error:
            break
        gain = float(bad[at > level].sum()) / m - k / n
        if gain > best + 1e-12:
            best, taken = gain, level
    return taken


def learning(column: str) -> Column:
    """Whether a labelled document is one to learn from: by a hash of its id that any engine computes alike."""
    return F.conv(F.substring(F.md5(F.col(column).cast("string")), 1, 4), 16, 10).cast("int") % 10 < LEARN_TENTHS


def level_of(rule: str) -> Column:
    """A document's level by one rule, from the array column of its stratum."""
    return F.coalesce(F.get(F.col(f"lev_{rule}"), F.col(f"step_{rule}")), F.lit(0))


def _joined(rows: DataFrame, strata: DataFrame) -> DataFrame:
    """``rows`` with what ``strata`` holds of their strata: sent to the workers where these are few, which keeps a hot
    stratum from meeting in one task; more of them, and so smaller ones, are joined by shuffle."""
    few = strata.limit(MOST_STRATA + 1).count() <= MOST_STRATA
    return rows.join(F.broadcast(strata) if few else strata, "stratum", "left")


def cutoffs(measured: DataFrame, labels: DataFrame, total_risk: float = 0.02, delta: float = 0.05, least_gain: float = 0.01) -> DataFrame:
    """(stratum, lev_<rule> array of levels by step, allowed level or null) from ``labels(id, good)``. Labels of ids that
    are not there, null ids and null labels do not count; of several labels of an id the largest does. A stratum without
    labels is not there."""
    one = labels.where("good is not null and id is not null").groupBy("id").agg((F.max("good") == 1).cast("long").alias("good"))
    found = measured.select("id", "stratum", *[step_of(r).alias(f"step_{r}") for r in RULES]).join(one, "id").withColumn("learn", learning("id"))
    found = written(found, "quality-labelled")
    strata = max(1, found.select("stratum").distinct().count())
    by_step = (
        found.where("learn").select("stratum", "good", F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"step_{r}").alias("step")) for r in RULES])))
        .groupBy("stratum", "rule", "step").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    )

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        out: dict = {"stratum": [group["stratum"].iloc[0]]}
        for rule, (_, _, low) in RULES.items():
            own = group[group["rule"] == rule]
            out[f"lev_{rule}"] = [levels(own["step"].to_numpy(), own["good"].to_numpy(), own["bad"].to_numpy(), low, GRID[rule][1])]
        return pd.DataFrame(out)

    # a stratum's rows are no more than the grid's steps
    learnt = written(by_step.groupBy("stratum").applyInPandas(learn, "stratum string, " + ", ".join(f"lev_{r} array<int>" for r in RULES)), "quality-levels")
    held = _joined(found.where("not learn"), learnt).select("stratum", "good", F.greatest(*[level_of(r) for r in RULES]).alias("level"))
    by_level = held.groupBy("stratum", "level").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))

    def select(group: pd.DataFrame) -> pd.DataFrame:
        taken = choose(group["level"].to_numpy(), group["good"].to_numpy(), group["bad"].to_numpy(), total_risk, delta / strata, least_gain)
        return pd.DataFrame({"stratum": [group["stratum"].iloc[0]], "allowed": pd.array([taken], dtype="Int32")})

    allowed = by_level.groupBy("stratum").applyInPandas(select, "stratum string, allowed int")
    return learnt.join(allowed, "stratum", "left")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
          least_words: int = 50, most_repeat_percent: int = 50, **risk: float) -> DataFrame:
    """Features and verdict per row of ``docs``: id, stratum, FEATURES, base_failed, failed_rules, kept.

    ``labels`` holds (id, good: 1 or 0). Null and empty texts have no words and fail the base; a null stratum is a
    stratum of its own; a stratum without labels has only the base rule. Repeated rows each get a verdict; an empty table
    gives an empty result; other columns are not read, whatever their names.
    """
    measured = written(measure(docs, id_col, text_col, stratum_col), "quality-features")
    chosen = written(cutoffs(measured, labels, **risk), "quality-cutoffs")
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words"))
    steps = measured.select("*", *[step_of(r).alias(f"step_{r}") for r in RULES])
    failed = F.filter(F.array(*[F.when(level_of(r) > F.col("allowed"), F.lit(r)) for r in RULES]), lambda x: x.isNotNull())
    out = _joined(steps, chosen).select("id", "stratum", *FEATURE_NAMES, base.alias("base_failed"), F.array_join(failed, ",").alias("failed_rules"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))
