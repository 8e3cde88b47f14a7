"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Four machines are compiled from a model file:

* the normaliser: one state whose arcs rewrite the model's character map (the longest key first; none in an identity
  model) and spaces to the escape mark, with white space squeezed and a leading mark if the model asks for it;
* the pieces: a trie whose final states emit a piece with its weight;
* byte fallback: an arc for each character that no piece covers, emitting its UTF-8 bytes;
* for BPE models the acceptor of neighbours. A BPE model's merge order is not a sum of scores; it is a constraint: a
  sequence of pieces is the model's encoding if and only if each two neighbours, joined and encoded alone, give those
  two pieces back. The acceptor's state is the last piece; its arcs are worked out when they are first met.

They are composed with an input, and the shortest path in the tropical semiring (costs add along a path, the least
wins) is the encoding. Weights are the negated scores of a unigram model, and one for each piece of a BPE model. As
each prefix of a text has one encoding, the composition with the acceptor reaches one state (position, last piece) at
each position; so of either kind of model a position keeps its least cost, the piece that reached it and from where.

Where no piece holds two neighbours, an input can be cut between them and composed part by part (``cuts``, worked
out when a model is compiled). The distinct parts of a batch are relaxed together, position by position, over the
machines' tables (``Tables``); what these do not cover (long parts, byte fallback) goes through ``least_path``.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from causeway.llm.common import annotate

#: The public model; where it lies is a parameter.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Fixed values of the model file's format.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, USER_DEFINED, BYTE = 1, 2, 4, 6
UNKNOWN_PENALTY = 10.0
ENCODED = "n_tokens long, n_byte_tokens long, ids array<int>, round_trip boolean"
#: Parts that are kept from batch to batch; parts up to this length go through the tables; most cells of a table,
#: and most pairs of neighbours that are kept.
CACHE = 100_000
SHORT = 48
MOST_CELLS = 1 << 25
MOST_PAIRS = 1 << 19
#: Text whose parts a task holds at once.
SLICE = 2 << 20


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """The fields of one protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else 4 if kind == 5 else 8
        yield key >> 3, data[at : at + size]
        at += size


def character_map(data: bytes) -> dict[str, str]:
    """The arcs of a compiled character map: a double-array trie of UTF-8 keys, and the texts that its values point to."""
    if not data:
        return {}
    size = struct.unpack("<I", data[:4])[0]
    units = np.frombuffer(data[4 : 4 + size], "<u4").tolist()
    texts, found = data[4 + size :], {}
    offset = lambda unit: (unit >> 10) << ((unit & (1 << 9)) >> 6)
    stack = [(offset(units[0]), b"")]
    while stack:
        at, key = stack.pop()
        for label in range(1, 256):
            child = at ^ label
            if child < len(units) and units[child] & 0x800000FF == label:
                unit, own = units[child], key + bytes([label])
                below = child ^ offset(unit)
                if unit >> 8 & 1:
                    start = units[below] & 0x7FFFFFFF
                    found[own.decode()] = texts[start : texts.index(b"\0", start)].decode()
                stack.append((below, own))
    return found


class Normaliser:
    """Rewrites by the longest of its arcs' keys at each position, from left to right."""

    def __init__(self, arcs: dict[str, str], prefix: bool, squeeze: bool):
        self.arcs, self.prefix, self.squeeze = arcs, prefix, squeeze
        self.longest = max(map(len, arcs), default=0)
        self.starts = re.compile("[" + re.escape("".join(sorted({k[0] for k in arcs}))) + "]") if arcs else None

    def rewritten(self, text: str) -> str:
        if self.starts is None:
            return text
        out, done = [], 0
        for m in self.starts.finditer(text):
            at = m.start()
            if at >= done:
                for n in range(min(self.longest, len(text) - at), 0, -1):
                    new = self.arcs.get(text[at : at + n])
                    if new is not None:
                        out += (text[done:at], new)
                        done = at + n
                        break
        return "".join([*out, text[done:]])

    def __call__(self, text: str) -> str:
        text = self.rewritten(text)
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if self.prefix and text:
            text = " " + text
        return text.replace(" ", MARK)


class Tables:
    """The piece trie as arrays: ``alone[c]`` is the piece that a character is by itself; ``onward[node, class]`` the node
    behind it, for characters that stand in pieces of several; ``piece[node]`` the piece that ends there."""

    def __init__(self, ids: dict[str, int]):
        chars = sorted({c for p in ids if len(p) > 1 for c in p})
        self.classes = np.zeros(0x110000, np.int32)
        self.classes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.alone = np.full(0x110000, -1, np.int32)
        number: dict[str, int] = {"": 0}
        for p in ids:
            if len(p) == 1:
                self.alone[ord(p)] = ids[p]
            else:
                for n in range(1, len(p) + 1):
                    number.setdefault(p[:n], len(number))
        inner = {p[:-1] for p in number if p}
        row = {p: i for i, p in enumerate(sorted(inner, key=number.__getitem__))}  # the root is row 0
        self.fits = (len(row) + 1) * (len(chars) + 1) <= MOST_CELLS
        self.depth = max(map(len, number))
        if not self.fits:
            return
        self.piece = np.array([ids.get(p, -1) if len(p) > 1 else -1 for p in number], np.int32)
        self.row = np.array([row.get(p, len(row)) for p in number], np.int32)
        self.onward = np.zeros((len(row) + 1, len(chars) + 1), np.uint16 if len(number) < 1 << 16 else np.int32)  # 0: nowhere, as no arc leads to the root
        for p, i in number.items():
            if p:
                self.onward[row[p[:-1]], self.classes[ord(p[-1])]] = i


class Transducer:
    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.scores: list[float] = []
        self.model, prefix, squeeze, escape, arcs = UNIGRAM, True, True, True, {}
        for field, value in _fields(model):
            if field == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kinds.append(own.get(3, NORMAL))
            elif field == 2:
                self.model = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                own = dict(_fields(value))
                prefix, squeeze, escape = (bool(own.get(i, 1)) for i in (3, 4, 5))
                arcs = character_map(own.get(2, b""))
        if self.model not in (UNIGRAM, BPE) or not escape:
            raise ValueError("unigram and BPE models with escaped white space are supported")
        self.normalise = Normaliser(arcs, prefix, squeeze)
        self.bytes = [0] * 256
        self.ids: dict[str, int] = {}
        self.table: list[bytes] = []
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        whole = {}
        for i, (piece, kind) in enumerate(zip(self.pieces, self.kinds)):
            if kind == BYTE:
                self.bytes[int(piece[3:5], 16)] = i
            elif kind == NORMAL:
                self.ids[piece] = i
            elif kind == USER_DEFINED:
                whole[piece] = i
            self.table.append(bytes([int(piece[3:5], 16)]) if kind == BYTE else piece.replace(MARK, " ").encode() if kind in (NORMAL, USER_DEFINED) else b"")
        if whole and (self.model != BPE or arcs):
            raise ValueError("user-defined pieces are supported in BPE models without a character map")
        self.is_byte = np.array([k == BYTE for k in self.kinds], bool)
        self.fallback = int(self.is_byte.sum()) == 256
        self.trie: list = [{}, None]  # children, and the piece that ends here
        for piece, i in self.ids.items():
            node = self.trie
            for c in piece:
                node = node[0].setdefault(c, [{}, None])
            node[1] = i
        self.weights = np.array([1.0 if self.model == BPE else -x for x in self.scores])
        self.unknown_cost = UNKNOWN_PENALTY - min((self.scores[i] for i in self.ids.values()), default=0.0)
        # user-defined pieces are arcs of their own that nothing joins: the text is cut at them, the longest first
        apart = "|".join(re.escape(p) for p in sorted(whole, key=len, reverse=True))
        self.apart = re.compile(f"({apart})") if whole else None
        self.whole = {p: np.array([i], "<i4").tobytes() for p, i in whole.items()}
        self.parts = re.compile(self.cuts())
        self.tables = Tables(self.ids)
        self.pairs: dict[int, bool] = {}
        self.known_pairs = np.zeros(1, np.int64), np.ones(1, bool)  # nothing follows the start: an entry so that none is empty
        self.cache: dict[str, bytes] = {}

    def cuts(self) -> str:
        """A pattern of the parts that can be composed on their own: a text is cut where no piece holds the two
        neighbours, which are a mark after another character, a line end, and a letter beside an ASCII sign."""
        if any(re.search(f"[^{MARK}]{MARK}", p) or "\n" in p for p in self.ids):
            return "(?s).+"
        beside = {c for p in self.ids for a, b in zip(p, p[1:]) for c, other in ((a, b), (b, a)) if other.isalpha()}
        signs = re.escape("".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in beside))
        whole = f"{MARK}*[^{MARK}\n]+|{MARK}+|\n"
        return f"{MARK}*[^\\W\\d_]++(?=[{signs}{MARK}\n]|\\Z)|{MARK}*[{signs}]++(?=[^\\W\\d_]|[{MARK}\n]|\\Z)|{whole}" if signs else whole

    # the acceptor of neighbours of BPE models

    def merged(self, text: str) -> list[str]:
        """The merge procedure itself on a short text: of the neighbours that join to a piece, the best first."""
        parts = list(text)
        while len(parts) > 1:
            best, where = None, -1
            for i in range(len(parts) - 1):
                piece = self.ids.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or self.scores[piece] > best):
                    best, where = self.scores[piece], i
            if where < 0:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def follows(self, last: int, piece: int) -> bool:
        """Whether the acceptor lets ``piece`` follow ``last``; -1 is the start or a character that no piece covers."""
        if self.model == UNIGRAM:
            return True
        key = (last + 1) << 32 | piece + 1
        found = self.pairs.get(key)
        if found is None:
            own = [self.pieces[p] for p in (last, piece) if p >= 0]  # a character without piece joins nothing
            found = self.pairs[key] = self.merged("".join(own)) == own
            if len(self.pairs) > MOST_PAIRS:
                self.pairs = {key: found}
        return found

    def follow(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """``follows`` for many pairs: those of earlier batches are looked up in a sorted table."""
        keys = (last.astype(np.int64) + 1) << 32 | piece.astype(np.int64) + 1
        known, verdict = self.known_pairs
        at = np.searchsorted(known, keys)
        at[at == len(known)] = 0
        out, fresh = verdict[at], np.flatnonzero(known[at] != keys)
        if len(fresh):
            new, which = np.unique(keys[fresh], return_inverse=True)
            out[fresh] = np.array([self.follows((k >> 32) - 1, (k & 0xFFFFFFFF) - 1) for k in new.tolist()], bool)[which]
        return out

    def keep_pairs(self) -> None:
        """Brings the table of pairs up to date, once it differs from them by a tenth."""
        if self.pairs and not 0.5 < len(self.pairs) / len(self.known_pairs[0]) < 1.1:
            keys, said = np.fromiter(self.pairs, np.int64, len(self.pairs)), np.fromiter(self.pairs.values(), bool, len(self.pairs))
            order = np.argsort(keys)
            self.known_pairs = keys[order], said[order]

    # composition and shortest path

    def arcs(self, text: str, at: int) -> list[tuple[int, int, float]]:
        """(end, piece, cost) of the arcs that leave a position; piece -1 is byte fallback of one character."""
        found, node, single = [], self.trie, False
        for end in range(at, len(text)):
            node = node[0].get(text[end])
            if node is None:
                break
            if node[1] is not None:
                found.append((end + 1, node[1], self.weights[node[1]]))
                single |= end == at
        if not single:
            found.insert(0, (at + 1, -1, self.unknown_cost))
        return found

    def least_path(self, text: str) -> list[int]:
        """Ids of the shortest path through the composition with one normalised part."""
        best: list[tuple[float, int, int] | None] = [(0.0, 0, -1), *[None] * len(text)]  # cost, start and piece of the last arc
        for at in range(len(text)):
            if best[at] is not None:
                cost, _, last = best[at]
                for end, piece, more in self.arcs(text, at):
                    if (best[end] is None or cost + more < best[end][0]) and (piece < 0 or self.follows(last, piece)):
                        best[end] = (cost + more, at, piece)
        steps, at = [], len(text)
        while at:
            _, start, piece = best[at]
            steps.append((start, piece))
            at = start
        out: list[int] = []
        for at, piece in reversed(steps):
            out += [piece] if piece >= 0 else [self.bytes[b] for b in text[at].encode()] if self.fallback else [self.unknown]
        return out

    def least_paths(self, parts: list[str]) -> list[bytes]:
        """The ids of the shortest paths of short parts, as little-endian 32-bit integers. All parts take the same step
        at once: the arcs that leave position 0 are relaxed, then those of position 1, and so on."""
        order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
        own = [parts[i] for i in order]
        sizes = np.array([len(p) for p in own])
        most, n = int(sizes[0]), len(own)
        codes = np.zeros((n, most + self.tables.depth), np.uint32)
        codes[np.repeat(np.arange(n), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.frombuffer("".join(own).encode("utf-32-le"), "<u4")
        t = self.tables
        classes, alone = t.classes[codes], t.alone[codes]
        inside = np.arange(codes.shape[1])[None] < sizes[:, None]
        classes[~inside] = 0
        cost = np.full((n, most + 1), np.inf)
        last, back = np.full((n, most + 1), -1, np.int32), np.zeros((n, most + 1), np.int16)
        cost[:, 0] = 0.0
        for at in range(most):
            rows = np.arange(int(np.searchsorted(-sizes, -at, "left")))  # parts that go on beyond here

            def relax(r: np.ndarray, end: int, piece: np.ndarray, more: np.ndarray | float) -> None:
                new = cost[r, at] + more
                better = new < cost[r, end]
                if self.model == BPE:
                    some = np.flatnonzero(better & (piece >= 0))
                    better[some] = self.follow(last[r[some], at], piece[some])
                r = r[better]
                cost[r, end], last[r, end], back[r, end] = new[better], piece[better], at

            first = alone[rows, at]
            relax(rows, at + 1, first, np.where(first >= 0, self.weights[first], self.unknown_cost))
            node = t.onward[0, classes[rows, at]]
            for d in range(1, min(t.depth, most - at)):
                live = node > 0
                rows, node = rows[live], node[live]
                if not len(rows):
                    break
                node = t.onward[t.row[node], classes[rows, at + d]]
                piece = t.piece[node]
                ends = np.flatnonzero((node > 0) & (piece >= 0))
                relax(rows[ends], at + d + 1, piece[ends], self.weights[piece[ends]])
        steps = np.zeros((n, most), np.int32)
        at, count = sizes.copy(), np.zeros(n, np.int64)
        rows = np.arange(n)
        while len(rows):  # from the ends back to the starts
            steps[rows, most - 1 - count[rows]] = last[rows, at[rows]]
            at[rows] = back[rows, at[rows]]
            count[rows] += 1
            rows = rows[at[rows] > 0]
        used = np.arange(most)[None] >= most - count[:, None]
        flat, ends = steps[used].astype("<i4").tobytes(), (np.cumsum(count) * 4).tolist()
        bare = (np.where(used, steps, 0) < 0).any(axis=1).tolist()
        found = [b""] * n
        start = 0
        for i, end, bytewise in zip(order, ends, bare):
            found[i] = np.array(self.least_path(parts[i]), "<i4").tobytes() if bytewise else flat[start:end]
            start = end
        self.keep_pairs()
        return found

    def learn(self, new: set[str], batch: int = 20_000) -> None:
        """Puts the paths of all parts ``new`` into the cache."""
        if len(self.cache) + len(new) > CACHE:
            self.cache = {p: self.cache[p] for p in new & self.cache.keys()}
        new = new.difference(self.cache)
        short = sorted((p for p in new if len(p) <= SHORT), key=len) if self.tables.fits else []
        for i in range(0, len(short), batch):
            own = short[i : i + batch]
            self.cache.update(zip(own, self.least_paths(own)))
        for p in new.difference(short):
            self.cache[p] = np.array(self.least_path(p), "<i4").tobytes()

    def cut(self, text: str) -> list[str]:
        """The parts of a normalised text."""
        if self.apart is None:
            return self.parts.findall(text)
        return [p for i, piece in enumerate(self.apart.split(text)) for p in ([piece] if i % 2 else self.parts.findall(piece))]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.cut(self.normalise(t)) for t in texts]
        distinct = set().union(*cut)
        self.learn(distinct.difference(self.whole))
        of = {**self.cache, **self.whole}.__getitem__ if self.whole else self.cache.__getitem__
        return [np.frombuffer(b"".join(map(of, own)), "<i4") for own in cut]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids; the leading mark of the normaliser goes."""
        text = b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.normalise.prefix and text.startswith(" ") else text

    def cleaned(self, text: str) -> str:
        """What a round trip must give back: the text as normalised, marks read as spaces."""
        norm = self.normalise(text).replace(MARK, " ")
        return norm[1:] if self.normalise.prefix and norm.startswith(" ") else norm


_BUILT: dict[bytes, Transducer] = {}


def encode(docs: DataFrame, keep: list[str], text_col: str = "text", model: str = MODEL) -> DataFrame:
    """The columns ``keep`` of ``docs`` as c0, c1, ... with n_tokens, n_byte_tokens, ids and round_trip (whether
    decoding gives the normalised text back).

    Null and empty texts have no ids and count as a round trip; repeated rows are each encoded; an empty table gives an
    empty result; columns of ``docs`` may have any names. The model file is read on the driver and sent to the workers
    (below 64 MB).
    """
    data = Path(model).read_bytes()
    if len(data) > 64 << 20:
        raise ValueError("a model of over 64 MB is not sent to the workers")
    sent = docs.sparkSession.sparkContext.broadcast(data)

    def compute(raw):
        data = sent.value
        key = hashlib.sha256(data).digest()
        if key not in _BUILT:
            _BUILT[key] = Transducer(data)
        machine = _BUILT[key]
        texts = [t.decode("utf-8", "replace") if t else "" for t in raw]
        ids = machine.encode_all(texts)
        counts = [len(own) for own in ids]
        of_bytes = [int(machine.is_byte[own].sum()) for own in ids]
        back = [machine.decode(own) == machine.cleaned(text) for own, text in zip(ids, texts)]
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
        return [pa.array(counts, pa.int64()), pa.array(of_bytes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat), pa.array(back, pa.bool_())]

    return annotate(docs, text_col, keep, ENCODED, compute, SLICE)
