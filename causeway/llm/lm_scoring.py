"""Cross-entropy difference between two word bigram models whose counts grow with the corpus.

Words are runs without ASCII white space, as written. Both models share one vocabulary, the words of all documents:

    p(w) = (c(w) + beta) / (N + beta * V)        p(w | v) = (c(v, w) + kappa * p(w)) / (c(v, .) + kappa)

and both sum to one exactly. The target's counts come from the documents named as wanted, the background's from all
documents, scaled to the target's size so that smoothing weighs the same in both. No word, pair or document is dropped.

A document never scores itself: what it has put into either model is taken out again before it is scored, so a wanted
document is measured by the other wanted ones, like one that was never named. Copies of it do count.

Documents are written in chunks of about ``chunk_bytes``. Counts are summed within a chunk, then over blocks of chunks,
then over blocks of blocks: a chunk sorts the keys of its words and of its pairs of neighbours and cuts them by their
upper bits into at most ``FAN`` packed rows; a block of about as many chunks adds up the rows of each cut, and what comes
of a cut is cut again by the next bits for the next block, until one block is left. A node so takes about as many rows as
it hands on and is about the size of a chunk, and a key that every chunk has is one entry of each. Rows grow with the
chunks, times the levels, of which a corpus of 64 TB has three. The totals go back the way the counts came, each node
answering those below it in the order of their keys, and in the chunks the documents are scored. Nothing is broadcast.

Keys are 64-bit hashes of words and of pairs, one bit of which tells the two apart. Among 10^9 distinct keys 0.1 pairs
are expected to be equal by chance.

A document's score is the mean over its tokens of target loss minus background loss, in nats: the lower, the more
like the target.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import Folder, bounded, for_workers, free, mix, new_folder, open_store, quoted, slices, written

SCORES = "n_tokens long, in_target boolean, target_loss double, background_loss double, score double"

START = np.uint64(0x9E3779B97F4A7C15)  # what a text's first word follows
ODD = np.uint64(0xD6E8FEB86659FD93)
ONE = np.uint64(1)
CHUNKS_PER_TASK = 4
CODEC = pa.Codec("zstd", 1)
#: Bits of a key by which a level cuts, and so into how many rows at most.
BITS = 8
FAN = 1 << BITS
#: To the node (block, prefix) from the one below it, or from a chunk, which has the prefix 0.
PACKED = "block long, prefix long, from_block long, from_prefix long, size int, data binary"
ANSWER = "from_block long, from_prefix long, prefix long, size int, data binary, words long"
COUNTS = 4  # of a key: in all documents, in the target, and how often it ends a text of either


def words_of(text: bytes | None) -> np.ndarray:
    """The hashes of a text's words."""
    words = text.split() if text else []
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def keys_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word, its own key (odd) and the key of it after the word before (even)."""
    before = np.concatenate([[START], words[:-1]])
    return mix(words) | ONE, mix(before * ODD + words) & ~ONE


def _write_chunks(docs: DataFrame, keep: list[str], id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """(file, chunk, pos, id, n) per row of ``docs``; the files hold the columns ``keep`` as c0, c1, ... and the text."""
    place = new_folder(docs.sparkSession, "lm-chunks")
    folder = for_workers(docs.sparkSession, place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_store(folder)
        files.create_dir(base, recursive=True)
        part, made = TaskContext.get().partitionId(), 0

        def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal made
            whole = pa.Table.from_batches(held)
            name = f"{uuid.uuid4().hex}.arrow"
            with files.open_output_stream(f"{base}/{name}") as sink:
                with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(whole)
            n = [len(t.split()) if t else 0 for t in whole.column("text").to_pylist()]
            rows = whole.num_rows
            columns = [pa.array([f"{folder}/{name}"] * rows), pa.array(np.full(rows, (part << 24) + made)), pa.array(np.arange(rows, dtype=np.int32)), whole.column("id").combine_chunks(), pa.array(n, pa.int64())]
            made += 1
            return pa.RecordBatch.from_arrays(columns, names=["file", "chunk", "pos", "id", "n"])

        held, size = [], 0
        for batch in batches:
            for part_of in slices(batch, chunk_bytes // 8):
                held.append(part_of)
                size += part_of.nbytes
                if size >= chunk_bytes:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    numbered = [quoted(c).alias(f"c{i}") for i, c in enumerate(keep)]
    wide = docs.select(*numbered, quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("binary").alias("text"))
    out = written(bounded(wide).mapInArrow(run, "file string, chunk long, pos int, id long, n long"), "lm-rows")
    out.files = Folder(docs.sparkSession, place)
    return out


def pack(rows: np.ndarray) -> bytes:
    """A matrix of 64-bit integers, its bytes ordered by significance so that small numbers take little room."""
    planes = np.ascontiguousarray(np.ascontiguousarray(rows).view(np.uint8).reshape(*rows.shape, 8).transpose(0, 2, 1))
    return CODEC.compress(planes, asbytes=True)


def unpack(data: bytes, rows: int, size: int) -> np.ndarray:
    planes = np.frombuffer(CODEC.decompress(data, rows * size * 8, asbytes=True), np.uint8).reshape(rows, 8, size)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.int64).reshape(rows, size)


class Chunk:
    """The documents of one file and the counts of its keys, within the chunk as long as no totals are put in."""

    def __init__(self, file: str, wanted: list[int]):
        files, path = open_store(file)
        with files.open_input_stream(path) as source:
            self.table = pa.ipc.open_stream(source).read_all()
        words = [words_of(t) for t in self.table.column("text").to_pylist()]
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.wanted = np.zeros(len(words), bool)
        self.wanted[wanted] = True
        own, pair = zip(*map(keys_of, words))
        own, pair = np.concatenate(own), np.concatenate(pair)
        self.keys, inverse = np.unique(np.concatenate([own, pair]), return_inverse=True)
        self.own, self.pair = inverse[: len(own)], inverse[len(own) :]
        mine = np.repeat(self.wanted, self.lengths)
        in_target = np.flatnonzero(mine)
        size = len(self.keys)
        self.last = np.cumsum(self.lengths)[self.lengths > 0] - 1
        count = lambda at: np.bincount(at, minlength=size).astype(np.int64)
        self.all, self.target = count(inverse), count(np.concatenate([self.own[in_target], self.pair[in_target]]))
        self.all_ends, self.target_ends = count(self.own[self.last]), count(self.own[self.last[mine[self.last]]])

    @property
    def counts(self) -> np.ndarray:
        return np.stack([self.all, self.target, self.all_ends, self.target_ends])

    def put(self, totals: np.ndarray) -> None:
        self.all, self.target, self.all_ends, self.target_ends = totals

    def within(self, at: np.ndarray) -> np.ndarray:
        """Of each token, how often its document has the key ``at`` of it."""
        document = np.repeat(np.arange(len(self.lengths)), self.lengths)
        _, inverse, n = np.unique(document * len(self.keys) + at, return_inverse=True, return_counts=True)
        return n[inverse]

    def own_counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token in its document: how often its word is there, its pair, and its word with another behind it."""
        words = self.within(self.own)
        last = np.repeat(self.own[self.last], self.lengths[self.lengths > 0])  # the document's last word
        return words, self.within(self.pair), words - (self.own == last)

    def losses(self, n: np.ndarray, ends: np.ndarray, own: tuple, out: np.ndarray, starts: int, tokens: int, vocabulary: int, scale: np.ndarray, beta: float, kappa: float) -> np.ndarray:
        """Per token, under the model whose counts are ``scale`` times ``n``, without what the documents ``out`` have of
        their ``own_counts`` in it."""
        words, pairs, followed = own
        less = np.repeat(out, self.lengths)
        follows = (n - ends)[self.own] - followed * less
        context = np.concatenate([[starts], follows[:-1]])
        first = (np.cumsum(self.lengths) - self.lengths)[self.lengths > 0]
        context[first] = starts - out[self.lengths > 0]
        left = np.repeat(tokens - self.lengths * out, self.lengths)
        scale = np.repeat(scale, self.lengths)
        alone = ((n[self.own] - words * less) * scale + beta) / (left * scale + beta * vocabulary)
        return -np.log(((n[self.pair] - pairs * less) * scale + kappa * alone) / (context * scale + kappa))


def score(
    docs: DataFrame, wanted: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", beta: float = 0.1, kappa: float = 20.0, chunk_bytes: int = 4 << 20, bits: int = BITS
) -> DataFrame:
    """The columns ``keep`` of ``docs`` as c0, c1, ... with SCORES. ``wanted(id)`` names the target documents; null and
    repeated ids there do not matter, and a document without an id is never one of them. Null texts and texts without a
    word have no tokens, and losses and score are null; repeated rows are each counted and scored, as copies of each
    other. Without any target text the target model is smoothing alone. An empty table gives an empty result."""
    ids = wanted.where("id is not null").select(F.col("id").cast("long").alias("id")).distinct().withColumn("target", F.lit(True))
    rows = _write_chunks(docs, keep, id_col, text_col, chunk_bytes)
    named = rows.where("id is not null").join(ids, "id", "left").withColumn("target", F.coalesce("target", F.lit(False)))
    flagged = named.unionByName(rows.where("id is null").withColumn("target", F.lit(False)))  # null ids would all meet in one task
    mine = F.col("target").cast("long")
    chunks = flagged.groupBy("chunk", "file").agg(
        F.collect_list(F.when(F.col("target"), F.col("pos"))).alias("wanted"),
        F.sum("n").alias("tokens"),
        F.sum(F.col("n") * mine).alias("target_tokens"),
        F.count_if(F.col("n") > 0).alias("starts"),
        F.sum((F.col("n") > 0).cast("long") * mine).alias("target_starts"),
    )
    chunks = written(chunks, "lm-index")
    sizes = chunks.agg(F.count("*"), *[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "target_tokens", "starts", "target_starts")]).first()
    n_chunks, tokens, target_tokens, starts, target_starts = sizes
    free(rows)
    totals, vocabulary = _totals(chunks, n_chunks, bits)

    wide = docs.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(keep)])
    kept = [f.name for f in wide.schema.fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in wide.schema.fields), SCORES])

    def compute(left: pa.Table, right: pa.Table) -> pa.Table:
        (file,), (places,) = left.column("file").to_pylist(), left.column("wanted").to_pylist()
        chunk = Chunk(file, places)
        answers = sorted(zip(*(right.column(c).to_pylist() for c in ("prefix", "size", "data"))))
        chunk.put(np.concatenate([np.empty((COUNTS, 0), np.int64), *[unpack(data, COUNTS, size) for _, size, data in answers]], axis=1))
        n, none, own = chunk.lengths, chunk.lengths == 0, chunk.own_counts()
        mine, everyone = chunk.wanted.astype(np.int64), np.ones(len(chunk.lengths), np.int64)
        scale = (target_tokens - n * mine) / np.maximum(1, tokens - n)
        target = chunk.losses(chunk.target, chunk.target_ends, own, mine, target_starts, target_tokens, vocabulary, np.ones(len(n)), beta, kappa)
        background = chunk.losses(chunk.all, chunk.all_ends, own, everyone, starts, tokens, vocabulary, scale, beta, kappa)
        text = np.repeat(np.arange(len(n)), n)
        means = [np.bincount(text, x, len(n)) / np.maximum(n, 1) for x in (target, background, target - background)]
        made = [pa.array(n), pa.array(chunk.wanted), *[pa.array(x, pa.float64(), mask=none) for x in means]]
        names = [x.split()[0] for x in SCORES.split(", ")]
        return pa.Table.from_arrays([*[chunk.table.column(c) for c in kept], *made], names=[*kept, *names])

    out = written(chunks.select("chunk", "file", "wanted").groupBy("chunk").cogroup(totals.withColumnRenamed("from_block", "chunk").groupBy("chunk")).applyInArrow(compute, schema), "lm-scores")
    free(chunks, totals, rows.files)
    return out


def packed_rows(keys: np.ndarray, counts: np.ndarray, shift: int) -> list[tuple[int, int, bytes]]:
    """(prefix, size, data) of sorted keys cut by their bits from ``shift`` on, no more rows than keys."""
    at = keys >> np.uint64(shift) if shift < 64 else np.zeros(len(keys), np.uint64)
    cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
    return [(int(at[a]), b - a, pack(np.concatenate([np.diff(keys[a:b], prepend=np.uint64(0)).view(np.int64)[None], counts[:, a:b]]))) for a, b in zip(cuts, cuts[1:]) if b > a]


def merged(group: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct keys of a node's rows, their summed counts, and where each row's keys are among them."""
    parts = [unpack(data, 1 + COUNTS, size) for data, size in zip(group.column("data").to_pylist(), group.column("size").to_pylist())]
    keys = [np.cumsum(p[0].view(np.uint64)) for p in parts]
    distinct = np.unique(np.concatenate(keys))
    totals, places = np.zeros((COUNTS, len(distinct)), np.int64), []
    for p, own in zip(parts, keys):
        places.append(np.searchsorted(distinct, own))
        totals[:, places[-1]] += p[1:]  # a row names a key once
    return distinct, totals, places


def _frame(rows: list[tuple], ddl: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in ddl.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], kinds[kind]) for i, (name, kind) in enumerate(fields)})


def _totals(chunks: DataFrame, n_chunks: int, bits: int) -> tuple[DataFrame, int]:
    """ANSWER rows for each chunk (as ``from_block``): the counts of all chunks for its keys; and how many distinct words
    there are."""
    blocks = [max(1, -(-n_chunks >> bits))]
    while blocks[-1] > 1:
        blocks.append(max(1, -(-blocks[-1] >> bits)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, file, places in zip(*(batch.column(c).to_pylist() for c in ("chunk", "file", "wanted"))):
                chunk = Chunk(file, places)
                block = xxhash.xxh64_intdigest(str(number)) % blocks[0]
                rows = [(block, prefix, number, 0, size, data) for prefix, size, data in packed_rows(chunk.keys, chunk.counts, 64 - bits)]
                yield from _frame(rows, PACKED).to_batches()

    def up(level: int):
        def add(group: pa.Table) -> pa.Table:
            block, prefix = group.column("block")[0].as_py(), group.column("prefix")[0].as_py()
            keys, counts, _ = merged(group)
            return _frame([(block % blocks[level + 1], p, block, prefix, size, data) for p, size, data in packed_rows(keys, counts, 64 - bits * (level + 2))], PACKED)

        return add

    def answers(group: pa.Table, totals: np.ndarray, places: list[np.ndarray], words: int) -> pa.Table:
        prefix = group.column("prefix")[0].as_py()
        rows = [(b, p, prefix, len(at), pack(totals[:, at]), words if i == 0 else 0) for i, (b, p, at) in enumerate(zip(group.column("from_block").to_pylist(), group.column("from_prefix").to_pylist(), places))]
        return _frame(rows, ANSWER)

    def top(group: pa.Table) -> pa.Table:
        keys, counts, places = merged(group)
        return answers(group, counts, places, int((keys & ONE).sum()))

    def down(group: pa.Table, above: pa.Table) -> pa.Table:
        told = sorted(zip(*(above.column(c).to_pylist() for c in ("above", "size", "data"))))
        totals = np.concatenate([unpack(data, COUNTS, size) for _, size, data in told], axis=1)
        return answers(group, totals, merged(group)[2], 0)

    sent = chunks.select("chunk", "file", "wanted").repartition(max(1, -(-n_chunks // CHUNKS_PER_TASK))).mapInArrow(send, PACKED)
    if len(blocks) == 1:
        told = written(sent.groupBy("block", "prefix").applyInArrow(top, ANSWER), "lm-totals")
        return told, told.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    levels = [written(sent, "lm-up")]
    for level in range(len(blocks) - 1):
        levels.append(written(levels[-1].groupBy("block", "prefix").applyInArrow(up(level), PACKED), "lm-up"))
    told = written(levels[-1].groupBy("block", "prefix").applyInArrow(top, ANSWER), "lm-totals")
    vocabulary = told.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    free(levels.pop())
    while levels:
        below, above = levels.pop(), told
        from_above = above.select(F.col("from_block").alias("block"), F.col("from_prefix").alias("prefix"), F.col("prefix").alias("above"), "size", "data")
        told = written(below.groupBy("block", "prefix").cogroup(from_above.groupBy("block", "prefix")).applyInArrow(down, ANSWER), "lm-totals")
        free(below, above)
    return told, vocabulary
