"""Lines that several documents hold, by a sharded minimal perfect hash that documents probe.

A line's key is the line without white space at its ends, in lower case (A to Z). Keys are known by 128-bit hashes. One
pass hands over each document's distinct hashes, and Spark adds up, within tasks before anything is shuffled, how many
documents hold each and the smallest and largest id among these. The hashes that more than one document holds are dealt
into shards by their upper bits, and each shard becomes one file: a minimal perfect hash over the first half of its
hashes, and three arrays in its order: the second half as a fingerprint, the number of documents, and the first one's id.
A key that the index lacks is told by its fingerprint, so lines of a single document need no entry.

The perfect hash is a cascade of bit arrays: a key that meets no other in an array of twice as many bits as there are
keys owns its bit, the others go on to the next array; a key's place is the number of bits set before its own.

A second pass probes: no line is joined. Where the files hold at most ``most_resident`` bytes in all, each worker opens
those it needs and keeps them. Beyond that bound documents are written in chunks, a chunk sends each shard one packed row of
the hashes that it has there, workers stream such rows past one open shard at a time, and one bit a hash comes back to
the chunk. Both ways give the same rows.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import bounded, for_workers, free, mix, new_folder, open_store, quoted, slices, written

WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
ODD = np.uint64(0x9E3779B97F4A7C15)
LOW = np.uint64(0xFFFFFFFF)
HALF = np.uint64(32)
#: Bits of a level for each key that reaches it.
GAMMA = 2
#: Two fifths of a level's keys reach the next one, so distinct keys end long before.
MOST_LEVELS = 400


def keys_of(text: bytes | None, least_chars: int) -> tuple[list[bytes], list[int], list[bytes]]:
    """The lines of a text, and of those whose key has ``least_chars`` code points or more, where they are and their keys."""
    lines = (text or b"").split(b"\n")
    at, keys = [], []
    for i, line in enumerate(lines):
        key = line.strip(WHITE).lower()  # of bytes: A to Z only
        if len(key) >= least_chars and (len(key) >= 4 * least_chars or key.isascii() or len(key.decode(errors="replace")) >= least_chars):
            at.append(i)
            keys.append(key)
    return lines, at, keys


def hashes_of(keys: list[bytes]) -> np.ndarray:
    """The two halves of each key's 128-bit hash."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").astype(np.uint64).reshape(-1, 2)


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((mix(keys + ODD * np.uint64(level + 1)) >> HALF) * np.uint64(size) >> HALF).astype(np.int64)


@dataclass
class PerfectHash:
    """Distinct 64-bit keys to the numbers from 0 to their count less 1."""

    sizes: np.ndarray  # bits of each level, multiples of 64
    words: np.ndarray
    before: np.ndarray  # bits set before each word

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], keys
        while len(left):
            if len(sizes) == MOST_LEVELS:
                raise ValueError("keys of a perfect hash must differ")
            size = -(-GAMMA * len(left) // 64) * 64
            at = _places(left, len(sizes), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, np.uint8)
            bits[at[alone]] = 1
            sizes.append(size)
            levels.append(np.packbits(bits, bitorder="little").view("<u8"))
            left = left[~alone]
        words = np.concatenate(levels) if levels else np.zeros(0, np.uint64)
        ones = np.bitwise_count(words).astype(np.uint32)
        return cls(np.array(sizes, np.int64), words, (np.cumsum(ones) - ones).astype(np.uint32))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; of one that was not among them any number, or -1."""
        out, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            at = _places(keys[left], level, size) + base
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            own = (word >> bit & np.uint64(1)).astype(bool)
            below = word[own] & ((np.uint64(1) << bit[own]) - np.uint64(1))
            out[left[own]] = self.before[at[own] >> 6] + np.bitwise_count(below)
            left, base = left[~own], base + size
        return out


@dataclass
class Shard:
    hash: PerfectHash
    fingerprints: np.ndarray
    counts: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, fingerprints: np.ndarray, counts: np.ndarray, first: np.ndarray) -> Shard:
        """Keys may repeat, though 64-bit halves of distinct hashes hardly ever do: of several rows with one key all but the
        first get keys of their own fingerprints' making, and are looked up there."""
        order = np.argsort(keys, kind="stable")
        again = np.zeros(len(keys), bool)
        again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
        keys = np.where(again, second_key(keys, fingerprints), keys)
        made = PerfectHash.of(keys)
        at = made(keys)
        put = lambda x, kind: _put(x, at, kind)
        return cls(made, put(fingerprints, np.uint64), put(np.minimum(counts, 0xFFFFFFFF), np.uint32), put(first, np.int64))

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each hash the number of documents that hold it, 0 if it is not here, and the first one's id."""
        counts, first = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        left = np.arange(len(hashes))
        for keys in (lambda h: h[:, 0], lambda h: second_key(h[:, 0], h[:, 1])):
            at = self.hash(keys(hashes[left]))
            own = np.flatnonzero(at >= 0)
            own = own[self.fingerprints[at[own]] == hashes[left[own], 1]]
            counts[left[own]], first[left[own]] = self.counts[at[own]], self.first[at[own]]
            left = np.delete(left, own)
        return counts, first

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, sizes=self.hash.sizes, words=self.hash.words, before=self.hash.before, fingerprints=self.fingerprints, counts=self.counts, first=self.first)
        return out.getvalue()

    @classmethod
    def load(cls, uri: str) -> Shard:
        files, path = open_store(uri)
        with files.open_input_stream(path) as source:
            held = np.load(io.BytesIO(source.read()))
        return cls(PerfectHash(held["sizes"], held["words"], held["before"]), held["fingerprints"], held["counts"], held["first"])


def _put(values: np.ndarray, at: np.ndarray, kind: type) -> np.ndarray:
    out = np.zeros(len(at), kind)
    out[at] = values
    return out


def second_key(keys: np.ndarray, fingerprints: np.ndarray) -> np.ndarray:
    return mix(keys ^ mix(fingerprints + ODD))


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes[:, 0] >> HALF) * np.uint64(shards) >> HALF).astype(np.int64)


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 10) -> DataFrame:
    """(hi, lo, n, first) of the keys that two documents or more hold: the halves of the hash, the number of rows with it,
    and the smallest id. Rows of one id are one document, and so are all rows without an id, which come after all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            ids, keys = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = set(keys_of(text, least_chars)[2])
                ids += [i] * len(own)
                keys += own
            halves = hashes_of(keys).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(ids, pa.int64())], names=["hi", "lo", "id"])

    slim = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("binary").alias("text"))
    rows = bounded(slim).mapInArrow(run, "hi long, lo long, id long")
    sums = rows.groupBy("hi", "lo").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"), F.count("id").alias("named"))
    return sums.where("first < last or (first is not null and named < n)").select("hi", "lo", "n", "first")


def build(shared: DataFrame, keys_per_shard: int = 1 << 20) -> tuple[DataFrame, int]:
    """The index of ``counted`` rows: (shard, file, bytes) for each shard that has keys, and the number of shards.

    Hashes are even, so a shard has about ``keys_per_shard`` keys whatever the corpus repeats. Files have names of their
    own for each attempt; a lost attempt's are never read."""
    spark = shared.sparkSession
    shared = written(shared, "lines-shared")
    shards = max(1, -(-shared.count() // keys_per_shard))
    folder = for_workers(spark, new_folder(spark, "lines-index"))

    def pack(group: pa.Table) -> pa.Table:
        columns = [group.column(c).to_numpy() for c in ("hi", "lo", "n", "first")]
        data = Shard.of(columns[0].view(np.uint64), columns[1].view(np.uint64), *columns[2:]).dump()
        files, base = open_store(folder)
        files.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.npz"
        with files.open_output_stream(f"{base}/{name}", compression=None) as sink:
            sink.write(data)
        return pa.table({"shard": group.column("shard").slice(0, 1), "file": [f"{folder}/{name}"], "bytes": pa.array([len(data)], pa.int64())})

    shard = F.shiftright(F.shiftrightunsigned("hi", 32) * shards, 32)
    index = written(shared.withColumn("shard", shard).groupBy("shard").applyInArrow(pack, "shard long, file string, bytes long"), "lines-files")
    free(shared)
    return index, shards


_HELD: dict[str, Shard] = {}


def held(uri: str, most: int) -> Shard:
    """The shard in a file, as this worker keeps it: at most ``most`` of them."""
    if uri not in _HELD:
        while len(_HELD) >= max(1, most):
            _HELD.pop(next(iter(_HELD)))
        _HELD[uri] = Shard.load(uri)
    return _HELD[uri]


class Lines:
    """The lines of some documents, their hashes, and which of them go once the index has been asked."""

    def __init__(self, ids: pa.Array, texts: list[bytes | None], least_chars: int, shards: int):
        self.ids, cut = ids, [keys_of(t, least_chars) for t in texts]
        self.lines, self.at = [x[0] for x in cut], [x[1] for x in cut]
        self.hashes = hashes_of([k for x in cut for k in x[2]])
        self.document = np.repeat(np.arange(len(cut)), [len(x[1]) for x in cut])
        self.order = np.argsort(shard_of(self.hashes, shards), kind="stable")
        self.shards, starts = np.unique(shard_of(self.hashes, shards)[self.order], return_index=True)
        self.cuts = [*starts.tolist(), len(self.order)]
        own = ids.fill_null(0).to_numpy(zero_copy_only=False)[self.document]
        self.own, self.nameless = own, ids.is_null().to_numpy(zero_copy_only=False)[self.document]

    def pieces(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each shard that is asked, and which hashes belong there."""
        for shard, a, b in zip(self.shards.tolist(), self.cuts, self.cuts[1:]):
            yield shard, self.order[a:b]

    def without(self, gone: np.ndarray) -> list[pa.Array]:
        """n_lines, n_dropped and the texts that are left."""
        dropped, kept, start = np.bincount(self.document, gone, len(self.lines)).astype(np.int64), [], 0
        for lines, at, n in zip(self.lines, self.at, dropped.tolist()):
            if n:
                out = {at[i] for i in np.flatnonzero(gone[start : start + len(at)]).tolist()}
                lines = [x for i, x in enumerate(lines) if i not in out]
            kept.append(b"\n".join(lines))
            start += len(at)
        return [pa.array([len(x) for x in self.lines], pa.int64()), pa.array(dropped), pa.array(kept, pa.binary())]


def gone(shard: Shard, hashes: np.ndarray, own: np.ndarray, nameless: np.ndarray, least_docs: int) -> np.ndarray:
    """Whether lines of these hashes go from the documents ``own``: enough hold them, and another one is the first."""
    counts, first = shard.look_up(hashes)
    return (counts >= max(1, least_docs)) & ((first != own) | nameless)


MADE = "n_lines long, n_dropped long, kept binary"


def _in_place(docs: DataFrame, files: dict[int, str], shards: int, least_chars: int, least_docs: int) -> DataFrame:
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text"), MADE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            lines = Lines(batch.column("id"), batch.column("text").to_pylist(), least_chars, shards)
            out = np.zeros(len(lines.hashes), bool)
            for shard, at in lines.pieces():
                if shard in files:
                    out[at] = gone(held(files[shard], len(files)), lines.hashes[at], lines.own[at], lines.nameless[at], least_docs)
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *lines.without(out)], names=[*names, "n_lines", "n_dropped", "kept"])

    return bounded(docs).mapInArrow(run, schema)


def _by_chunks(docs: DataFrame, index: DataFrame, shards: int, least_chars: int, least_docs: int, chunk_bytes: int) -> DataFrame:
    spark = docs.sparkSession
    folder = for_workers(spark, new_folder(spark, "lines-chunks"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text"), MADE])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_store(folder)
        files.create_dir(base, recursive=True)

        def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.arrow"
            with files.open_output_stream(f"{base}/{name}") as sink, pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for part in rows:
                    out.write_batch(part)
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], names=["chunk"])

        rows, size = [], 0
        for part in (part for whole in batches for part in slices(whole)):
            rows.append(part)
            size += part.nbytes
            if size >= chunk_bytes:
                yield flush(rows)
                rows, size = [], 0
        if rows:
            yield flush(rows)

    def opened(chunk: str) -> tuple[pa.Table, Lines]:
        files, path = open_store(chunk)
        with files.open_input_stream(path) as source:
            whole = pa.ipc.open_stream(source).read_all().combine_chunks()
        return whole, Lines(whole.column("id").combine_chunks(), whole.column("text").to_pylist(), least_chars, shards)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in (c for batch in batches for c in batch.column("chunk").to_pylist()):
            lines = opened(chunk)[1]
            for shard, at in lines.pieces():
                row = [[chunk], [shard], [lines.hashes[at].tobytes()], [lines.own[at].tobytes()], [lines.nameless[at].tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in row], names=["chunk", "shard", "hashes", "own", "nameless"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, shard, hashes, own, nameless, file in zip(*(batch.column(c).to_pylist() for c in ("chunk", "shard", "hashes", "own", "nameless", "file"))):
                found = gone(held(file, 1), np.frombuffer(hashes, np.uint64).reshape(-1, 2), np.frombuffer(own, np.int64), np.frombuffer(nameless, bool), least_docs)
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([shard]), pa.array([np.packbits(found).tobytes()])], names=["chunk", "shard", "bits"])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        whole, lines = opened(left.column("chunk")[0].as_py())
        out = np.zeros(len(lines.hashes), bool)
        bits = dict(zip(right.column("shard").to_pylist(), right.column("bits").to_pylist()))
        for shard, at in lines.pieces():
            if shard in bits:
                out[at] = np.unpackbits(np.frombuffer(bits[shard], np.uint8), count=len(at)).astype(bool)
        names = [n for n in whole.schema.names if n != "text"]
        return pa.Table.from_arrays([*(whole.column(n) for n in names), *lines.without(out)], names=[*names, "n_lines", "n_dropped", "kept"])

    chunks = written(bounded(docs).mapInArrow(store, "chunk string"), "lines-chunks")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = chunks.repartition(parts).mapInArrow(send, "chunk string, shard long, hashes binary, own binary, nameless binary")
    # rows of a shard go to neighbouring tasks, by chunk, so that a task opens few shards and no shard is one task's alone
    dealt = sent.join(index.select("shard", "file"), "shard").repartitionByRange(parts, "shard", "chunk").sortWithinPartitions("shard", "chunk")
    answers = written(bounded(dealt).mapInArrow(probe, "chunk string, shard long, bits binary"), "lines-answers")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(answer, schema)


def dedupe(
    docs: DataFrame,
    keep: list[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    least_chars: int = 10,
    least_docs: int = 2,
    keys_per_shard: int = 1 << 20,
    most_resident: int = 128 << 20,
    chunk_bytes: int = 32 << 20,
) -> DataFrame:
    """The columns ``keep`` of ``docs`` as c0, c1, ... with n_lines (before), n_dropped and kept, the text that is left.

    A null text is an empty one, which is one empty line. A line stays if its key is short, if fewer than ``least_docs``
    rows hold it, or if its document is the one with the smallest id that holds it, where each time it comes stays.
    Rows of one id are one document; rows without an id come after all others, so they lose what any other document
    holds, and keep what only they do. Repeated rows each give one; an empty table gives an empty result; columns may have
    any names. ``least_docs`` beyond 2 counts rows."""
    if least_docs < 2:
        raise ValueError("a line is repeated if two documents hold it")
    wide = docs.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(keep)], quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("binary").alias("text"))
    index, shards = build(counted(docs, id_col, text_col, least_chars), keys_per_shard)
    resident = index.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0] <= most_resident
    if resident:
        out = _in_place(wide, {r.shard: r.file for r in index.collect()}, shards, least_chars, least_docs)  # at most as many as fit
    else:
        out = _by_chunks(wide, index, shards, least_chars, least_docs, chunk_bytes)
    return out.select(*[f"c{i}" for i in range(len(keep))], "n_lines", "n_dropped", F.col("kept").cast("string").alias("kept"))
