"""Toxic passages by maximum-scoring segments.

Every token has a log-odds between toxic and clean labelled documents under an informative Dirichlet prior (the
sample's own word shares, with a mass of ``prior`` times the toxic documents on either side; a document counts once
for each of its words, and equal texts once). Estimates are shrunken by how uncertain they are, tau2 / (tau2 +
variance), and they are hierarchical: a word's own log-odds is shrunken towards that of its longest prefix, and so on
down to four bytes, so that a word which the sample lacks is scored by its family. Log-odds under ``least`` in size
are noise and count as 0. A positive score is divided by the square root of k at the word's k-th occurrence in a
text, since words repeat themselves. From each token's score ``drift`` is taken, the price of making a passage longer.

A linear scan (Ruzzo and Tompa) finds all maximal scoring segments of a document. Scores of maximal segments of clean
text follow an extreme-value law: of n tokens, K n exp(-lambda S) segments of score S or more are expected by chance.
Both constants come from clean documents that the scoring model has not seen: the sample is dealt into ``FOLDS``,
each scored by the counts of the others. lambda is that of the exceedances over a high score, at most the positive
root of E[exp(lambda s)] = 1 over the tokens; K is the number of such segments a token, brought to that score. A
segment is a passage if its expected number by chance is below ``expected``; a document's evidence adds up the
passages' lambda S - ln(K n), and a logistic curve, fitted on the same unseen documents, turns it into a score.

``drift``, ``tau2``, ``least`` and ``expected`` are chosen by cross-fitting within the documents to learn from: of all
choices in ``DRIFTS``, ``TAU2``, ``LEASTS`` and ``EXPECTED`` the one with the least log loss of a logistic curve that is
fitted on two folds' evidence and tried on the third's. Labels that are held out are never read.

Fitting reads at most ``toxic_docs`` and ``clean_docs`` labelled documents, those with the smallest id hashes, and uses
all their words and prefixes. Their counts are a table in the shared folder, by the words' 64-bit hashes, that workers
read; the driver sees numbers of the sampled documents and of fixed bins only. The scan reads every text whole.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - used as pa.compute
import pyarrow.dataset as pads
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import annotate, bounded, for_workers, free, open_store, quoted, restored, written

#: ASCII letters in lower case, digits, apostrophes and bytes of non-ASCII characters make words.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 or b == 0x27 else 0x20 for b in range(256)
)
PASSAGES = "evidence double, passages array<struct<first:int,last:int,score:double>>"
FLUSH = 1 << 19
#: Bytes of a word's prefixes; one that ends within a character is a feature like any other.
PREFIXES = (4, 5, 6, 7, 8)
FOLDS = 3
CACHE = 100_000
#: Bins of token scores, a twentieth wide, from -20 on, and of segment scores, from 0 on.
BINS, FOUND_BINS = 801, 8001
#: What ``fit`` chooses from.
DRIFTS, TAU2, LEASTS, EXPECTED = (0.5, 1.0, 1.5, 2.0), (1.0, 3.0, 10.0), (0.0, 0.5), (0.01, 0.05, 0.25)

SIDES = [(fold, y) for fold in range(FOLDS) for y in (0, 1)]
COUNTS = [f"n{fold}{y}" for fold, y in SIDES]


def tokens(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


def family(word: bytes) -> list[bytes]:
    """A word's prefixes, the shortest first, and the word."""
    return [*(word[:n] for n in PREFIXES if len(word) > n), word]


class Table:
    """The counts of a sample's words and prefixes, by their hashes, in order."""

    held: dict[str, Table] = {}

    def __init__(self, uri: str):
        files, path = open_store(uri)
        rows = pads.dataset(path, filesystem=files, format="parquet").to_table(columns=["h", *COUNTS])
        hashes = rows.column("h").to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], np.stack([rows.column(c).to_numpy().astype(np.int32)[order] for c in COUNTS], 1)

    @classmethod
    def of(cls, uri: str) -> Table:
        """The table as this worker keeps it; an older one goes."""
        if uri not in cls.held:
            cls.held.clear()
            cls.held[uri] = cls(uri)
        return cls.held[uri]


@dataclass
class Model:
    uri: str | None = None
    #: texts of each of SIDES, and the fold whose counts are left out
    sizes: tuple[int, ...] = ()
    without: int | None = None
    prior: float = 0.2
    tau2: float = 3.0
    drift: float = 1.5
    least: float = 0.5
    rate: float = 1.0  # lambda
    k: float = 1.0
    expected: float = 0.05
    intercept: float = -20.0
    slope: float = 0.0

    def estimates(self, features: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each feature its log-odds and how much of it to keep, which is nothing where the sample lacks it."""
        delta, weight = np.zeros(len(features)), np.zeros(len(features))
        use = [fold != self.without for fold, _ in SIDES]
        n1, n0 = (sum(n for n, on, (_, y) in zip(self.sizes, use, SIDES) if on and y == own) for own in (1, 0))
        if not (self.uri and features and n1 and n0):
            return delta, weight
        table = Table.of(self.uri)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, features), np.uint64, len(features))
        at = np.minimum(np.searchsorted(table.hashes, hashes), max(0, len(table.hashes) - 1))
        there = np.flatnonzero(table.hashes[at] == hashes) if len(table.hashes) else np.zeros(0, np.int64)
        rows = table.counts[at[there]]
        y1, y0 = (rows[:, [i for i, (on, (_, y)) in enumerate(zip(use, SIDES)) if on and y == own]].sum(1) for own in (1, 0))
        live = (y1 + y0) > 0
        delta[there[live]], weight[there[live]] = estimates(y1[live], y0[live], n1, n0, self.prior, self.tau2)
        return delta, weight

    def log_odds(self, words: list[bytes]) -> np.ndarray:
        """Of each word, each prefix's estimate shrunken towards that of the shorter one, and its own towards those."""
        found = np.zeros(len(words))
        for n in (*PREFIXES, None):
            own = [i for i, w in enumerate(words) if n is None or len(w) > n]
            delta, weight = self.estimates([words[i][:n] for i in own])
            found[own] += weight * (delta - found[own])
        return np.where(np.abs(found) >= self.least, found, 0.0)

    def token_scores(self, odds: np.ndarray, places: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Scores of the tokens of some texts, one text after the other: ``places`` are the tokens' words among those of
        ``odds``, and texts start at ``first``."""
        scores = odds[places]
        for a, b in zip(first, first[1:]):
            times: Counter = Counter()
            for p in (a + np.flatnonzero(scores[a:b] > self.drift)).tolist():
                times[places[p]] += 1
                scores[p] /= math.sqrt(times[places[p]])
        return scores - self.drift

    def passages(self, found: list[tuple[int, int, float]], n: int) -> tuple[float, list[dict]]:
        """Evidence and passages of a text of n tokens with these maximal segments; without any there is no evidence, and
        less in a long text, which chance alone would have given some."""
        floor = math.log(self.k * max(n, 1))
        rated = sorted(((self.rate * s - floor, a, b, s) for a, b, s in found), reverse=True)
        passed = [x for x in rated if x[0] > -math.log(self.expected)]
        evidence = (rated[0][0] if rated else -max(0.0, floor)) + sum(x[0] for x in passed[1:])
        return evidence, [{"first": a, "last": b, "score": s} for a, b, s in sorted(x[1:] for x in passed)]

    def scan(self, texts: list[bytes | None], cache: dict[bytes, float]) -> list[tuple[float, list[dict]]]:
        """Evidence and passages of each text. ``cache`` holds words' log-odds from call to call."""
        words, places, first = indexed(texts)
        if len(cache) > CACHE:
            cache.clear()
        new = [w for w in words if w not in cache]
        cache.update(zip(new, self.log_odds(new).tolist()))
        scores = self.token_scores(np.array([cache[w] for w in words]), places, first)
        return [self.passages(segments(scores[a:b]), int(b - a)) for a, b in zip(first, first[1:])]


def indexed(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of some texts, the place of each token's word among them, and where each text's tokens start."""
    own = [tokens(t) for t in texts]
    place: dict[bytes, int] = {}
    first = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
    places = np.fromiter((place.setdefault(w, len(place)) for x in own for w in x), np.int64, int(first[-1]))
    return list(place), places, first


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a sequence of token scores. Linear: running totals stand for
    the tokens between positive ones.

    The candidates are kept on a stack with the running total left and right of each; a new one that reaches a new
    high over an earlier one's left total swallows everything from there on.
    """
    stack: list[list] = []  # first, last, total before, total after, index of the nearest earlier one with a smaller left total
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    totals = np.concatenate([[0.0], np.cumsum(scores)])
    for p, left, right in zip(at.tolist(), totals[at].tolist(), totals[at + 1].tolist()):
        start = p
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append([start, p, left, right, j])
                break
            start, left, back = stack[j][0], stack[j][2], stack[j][4]
            del stack[j:]
            j = back
    return [(a, b, right - left) for a, b, left, right, _ in stack]


def one_label(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, y) with the largest of an id's labels; null ids and labels are left out."""
    return labels.select(quoted(id_col).cast("long").alias("id"), quoted(label_col).cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))


def _sample(labels: DataFrame, toxic_docs: int, clean_docs: int) -> DataFrame:
    pick = lambda rows, n: rows.orderBy(F.xxhash64("id"), "id").limit(n)
    return pick(labels.where("y = 1"), toxic_docs).unionByName(pick(labels.where("y <> 1"), clean_docs))


def _root(scores: list[tuple[float, float]]) -> float:
    """The positive root of E[exp(x s)] = 1 for (score, share) pairs of mean below zero."""
    value = lambda x: sum(p * math.exp(min(700.0, x * s)) for s, p in scores) - 1
    low, high = 0.0, 1e-3
    while value(high) < 0 and high < 100:
        low, high = high, high * 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.01) -> tuple[float, float]:
    """Intercept and slope by Newton steps, each halved until the loss falls, with a small ridge on the slope."""
    mean, spread = x.mean(), max(float(x.std()), 1e-9)
    design, beta = np.stack([np.ones_like(x), (x - mean) / spread], 1), np.zeros(2)
    keep = np.array([1e-9, ridge])
    loss = lambda b: float((w * np.logaddexp(0, np.where(y > 0, -1, 1) * (design @ b))).sum() + (keep * b * b).sum() / 2)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
        down = design.T @ (w * (y - p)) - keep * beta
        curve = (design * (w * p * (1 - p))[:, None]).T @ design + np.diag(keep + 1e-9)
        step, now = np.linalg.solve(curve, down), loss(beta)
        while loss(beta + step) > now and np.abs(step).max() > 1e-9:
            step /= 2
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] - beta[1] * mean / spread), float(beta[1] / spread)


def squashed(evidence: float | np.ndarray) -> float | np.ndarray:
    """Evidence on a scale on which documents without any hit are not told apart by their length much."""
    return np.sign(evidence) * np.log1p(np.abs(evidence))


def _counts(rows: DataFrame) -> DataFrame:
    """(h, COUNTS) over ``rows(text, y, fold)``: the texts of each fold and label that hold a word or a prefix, by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {side: Counter() for side in SIDES}

        def flush() -> pa.RecordBatch:
            words = list(set().union(*held.values()))
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)
            columns = [pa.array(hashes), *(pa.array([held[side][w] for w in words], pa.int64()) for side in SIDES)]
            for c in held.values():
                c.clear()
            return pa.RecordBatch.from_arrays(columns, names=["h", *COUNTS])

        for batch in batches:
            for text, y, fold in zip(*(batch.column(i).to_pylist() for i in range(3))):
                held[fold, int(y == 1)].update({f for w in set(tokens(text)) for f in family(w)})
                if sum(map(len, held.values())) > FLUSH:
                    yield flush()
        if any(held.values()):
            yield flush()

    made = bounded(rows).select("text", "y", "fold").mapInArrow(run, "h long, " + ", ".join(f"{c} long" for c in COUNTS))
    return made.groupBy("h").agg(*[F.sum(c).alias(c) for c in COUNTS])


def estimates(y1: np.ndarray, y0: np.ndarray, n1: int, n0: int, prior: float, tau2: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of features that ``y1`` of ``n1`` toxic and ``y0`` of ``n0`` clean texts hold, and how much of it to keep."""
    mass = prior * n1
    share = (y1 + y0) * (mass / (n1 + n0))
    delta = np.log((y1 + share) / (n1 + mass)) - np.log((y0 + share) / (n0 + mass))
    return delta, tau2 / (tau2 + 1 / (y1 + share) + 1 / (y0 + share))


def tail(found: np.ndarray, n_tokens: int, bins: np.ndarray, times: np.ndarray | None = None) -> tuple[float, float]:
    """lambda and K of clean texts' maximal segments ``found``, each ``times`` over; ``bins`` counts their tokens by score.
    Without any segment lambda is 1, that of plain log-odds, and K is one segment in all of the text."""
    times = np.ones(len(found), np.int64) if times is None else times
    if not times.sum():
        return 1.0, 1 / max(1, n_tokens)
    levels, live = (np.arange(BINS) / 20 - 20), bins > 0
    shares = list(zip(levels[live].tolist(), (bins[live] / bins.sum()).tolist()))
    rate = _root(shares) if shares and sum(s * p for s, p in shares) < 0 else 1.0
    order = np.argsort(found)[::-1]
    ordered, upto = found[order], np.cumsum(times[order])
    least = float(ordered[np.searchsorted(upto, min(upto[-1], max(10, upto[-1] // 200) + 1))])
    beyond, weight = found[found >= least], times[found >= least]
    over = float(((beyond - least) * weight).sum() / weight.sum())
    rate = min(rate, 1 / over) if over > 0 else rate
    return rate, int(weight.sum()) / n_tokens * math.exp(min(700.0, rate * least))


_CACHES: dict[str, dict] = {}


def _cache(key: str) -> dict[bytes, float]:
    """A worker's cache of the model called ``key``; an older model's goes."""
    if key not in _CACHES:
        if len(_CACHES) >= FOLDS:
            _CACHES.clear()
        _CACHES[key] = {}
    return _CACHES[key]


def log_loss(x: np.ndarray, y: np.ndarray, w: np.ndarray, folds: np.ndarray) -> float:
    """Weighted log loss of each fold under the logistic curve of the others; folds that lack a class are not tried."""
    total = 0.0
    for k in range(FOLDS):
        own, rest = folds == k, folds != k
        if own.any() and len(set(y[rest].tolist())) == 2:
            a, b = _logistic(x[rest], y[rest], w[rest])
            total += float((w[own] * np.logaddexp(0, np.where(y[own] > 0, -1, 1) * (a + b * x[own]))).sum())
    return total


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    toxic_docs: int = 10_000,
    clean_docs: int = 20_000,
    prior: float = 0.2,
    drifts: tuple[float, ...] = DRIFTS,
    tau2: tuple[float, ...] = TAU2,
    leasts: tuple[float, ...] = LEASTS,
    expected: tuple[float, ...] = EXPECTED,
) -> Model:
    """The model of ``labels`` (rows to learn from only). Without toxic or without clean labelled texts nothing can
    be learnt: all scores are then 0. Null ids and labels do not count, and of several labels of an id the largest does;
    null and empty texts have no words; repeated texts count once a label; documents with equal hashes of their ids are
    taken by id; other columns are not read. Of several choices with the same loss the first counts."""
    known = one_label(labels, id_col, label_col)
    picked = _sample(known, toxic_docs, clean_docs)  # bounded by toxic_docs + clean_docs rows of 12 bytes
    rows = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("binary").alias("text")).join(F.broadcast(picked), "id")
    rows = rows.withColumn("h", F.xxhash64("text")).dropDuplicates(["h", "y"])  # copies would make their rare words look typical
    rows = written(rows.select("text", (F.col("y") == 1).cast("int").alias("y"), F.pmod("h", F.lit(FOLDS)).cast("int").alias("fold")), "toxicity-sample")
    sizes = {(r.fold, r.y): r["count"] for r in rows.groupBy("fold", "y").count().collect()}
    n = tuple(sizes.get(side, 0) for side in SIDES)
    if not all(sum(m for m, (_, y) in zip(n, SIDES) if y == own) for own in (0, 1)):
        free(rows)
        return Model()

    counts = written(_counts(rows), "toxicity-counts")  # the model's own: it stays
    base = Model(for_workers(docs.sparkSession, counts._folder), n, prior=prior)
    choices = [replace(base, drift=d, tau2=t, least=c) for t, c, d in product(tau2, leasts, drifts)]

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's tokens and the segments that each choice finds, by the counts of the other folds; of clean
        documents (choice, kind, bin, times) of the tokens' and segments' scores."""
        for batch in batches:
            for k in range(FOLDS):
                part = batch.filter(pa.compute.equal(batch.column(2), k))
                if not part.num_rows:
                    continue
                words, places, first = indexed(part.column(0).to_pylist())
                clean = part.column(1).to_numpy() == 0
                of_clean = np.repeat(clean, np.diff(first))
                found: list[list[list[float]]] = [[] for _ in range(part.num_rows)]
                bins: list[list[list[int]]] = [[] for _ in range(part.num_rows)]
                odds: dict = {}
                for c, choice in enumerate(choices):
                    unseen = replace(choice, without=k)
                    if (choice.tau2, choice.least) not in odds:
                        odds = {(choice.tau2, choice.least): unseen.log_odds(words)}
                    scores = unseen.token_scores(odds[choice.tau2, choice.least], places, first)
                    for i, (a, b) in enumerate(zip(first, first[1:])):
                        found[i].append([s for *_, s in segments(scores[a:b])])
                    at = np.clip(np.round((scores[of_clean] + 20) * 20), 0, BINS - 1).astype(np.int64)
                    over = np.array([s for x, own in zip(found, clean) if own for s in x[c]])
                    over = np.clip(np.round(over * 20), 0, FOUND_BINS - 1).astype(np.int64)
                    for kind, values in ((0, at), (1, over)):
                        level, times = np.unique(values, return_counts=True)
                        bins[0] += [[c, kind, x, m] for x, m in zip(level.tolist(), times.tolist())]
                made = [pa.array(np.diff(first), pa.int64()), pa.array(found, pa.list_(pa.list_(pa.float64()))), pa.array(bins, pa.list_(pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), *made], names=["y", "fold", "n", "found", "bins"])

    seen = written(bounded(rows).mapInArrow(of_batches, "y int, fold int, n long, found array<array<double>>, bins array<array<long>>"), "toxicity-found")
    binned = seen.select(F.explode("bins").alias("b")).groupBy(*[F.col("b")[i].alias(c) for i, c in enumerate(("choice", "kind", "bin"))]).agg(F.sum(F.col("b")[3]).alias("times")).toPandas()
    n_clean = seen.where("y = 0").agg(F.sum("n")).first()[0]
    for c, choice in enumerate(choices):
        held = [np.zeros(size, np.int64) for size in (BINS, FOUND_BINS)]
        for kind, own in binned[binned["choice"] == c].groupby("kind"):
            held[kind][own["bin"]] = own["times"]
        choice.rate, choice.k = tail(np.flatnonzero(held[1]) / 20, n_clean, held[0], held[1][held[1] > 0])
    every = [(c, replace(choice, expected=x)) for c, choice in enumerate(choices) for x in expected]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            evidence = [[m.passages([(0, 0, s) for s in found[c]], n)[0] for c, m in every] for n, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(evidence, pa.list_(pa.float64()))], names=["y", "fold", "evidence"])

    table = bounded(seen).select("y", "fold", "n", "found").mapInArrow(judged, "y int, fold int, evidence array<double>").toPandas()  # numbers of the sampled documents only
    free(rows, seen)
    totals = {r.y: r.n for r in known.groupBy((F.col("y") == 1).alias("y")).agg(F.count("*").alias("n")).collect()}
    y, folds = table["y"].to_numpy(), table["fold"].to_numpy()
    weight = np.where(y == 1, totals.get(True, 0) / max(1, (y == 1).sum()), totals.get(False, 0) / max(1, (y == 0).sum()))
    weight, y = weight / weight.mean(), y.astype(float)
    x = squashed(np.stack(table["evidence"].to_list()))
    best = min(range(len(every)), key=lambda i: round(log_loss(x[:, i], y, weight, folds), 9))
    model = every[best][1]
    model.intercept, model.slope = _logistic(x[:, best], y, weight)
    return model


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` as c0, c1, ... with evidence, passages (token ranges) and score.

    Null and empty texts have no tokens and score as texts without evidence; repeated rows are each scored; an empty
    table gives an empty result; columns of ``docs`` may have any names."""
    key = uuid.uuid4().hex

    def compute(texts):
        found = model.scan(texts, _cache(key))
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))
        return [pa.array([e for e, _ in found], pa.float64()), pa.array([p for _, p in found], kind)]

    out = annotate(docs, text_col, keep, PASSAGES, compute)
    raw = F.signum("evidence") * F.log1p(F.abs("evidence"))
    return out.withColumn("score", 1 / (1 + F.exp(-(F.lit(model.intercept) + F.lit(model.slope) * raw))))


def keep_clean(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more. Null and empty texts stay, repeated rows stay or go
    together, all columns keep their names and values; an empty table stays empty."""
    model = fit(docs, labels, text_col=text_col, **options)
    return restored(score(docs, model, docs.columns, text_col).where(F.col("score") < threshold), docs.columns)
