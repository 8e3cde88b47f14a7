"""Token counts of sections by offset-mapped attribution.

A document is encoded once, as a whole. Byte lengths of its tokens give their spans, sections have spans of their
own, and the two interval lists are joined by binary search. A token that crosses a boundary goes to one section by
rule: ``most`` (the section with most of its bytes, of equals the earlier), ``first`` (the section of its first
byte) or ``last``. Sections cover the text, so that their counts add up to the document's.
"""

from __future__ import annotations

import base64
import hashlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import annotate

#: The public byte-level BPE vocabulary; where it lies is a parameter.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern that belongs to this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("most", "first", "last")
SECTIONS = "n_tokens long, sections array<struct<start:long,end:long,n_tokens:long,n_crossing:long>>"
#: Text that is encoded at once; a longer one is cut before a space or line end that follows a letter, where no
#: token can cross.
PIECE = 1 << 18


class Encoder:
    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.lengths = np.zeros(max(table.values()) + 1, np.int64)
        for token, i in table.items():
            self.lengths[i] = len(token)

    def token_ends(self, text: str) -> np.ndarray:
        """Byte offsets at which the tokens end."""
        ids = [i for part in pieces(text) for i in self.encoding.encode_ordinary(part)]
        return np.cumsum(self.lengths[np.array(ids, np.int64)])


def pieces(text: str, most: int = PIECE) -> list[str]:
    """``text`` in parts of about ``most`` characters that no token crosses: each later part starts with a space that
    has a letter before and after it. Text without such a place stays whole."""
    out, start = [], 0
    while len(text) - start > most:
        at = start + most
        while True:
            at = text.find(" ", at)
            if at < 0 or at + 1 >= len(text):
                at = -1
                break
            if text[at - 1].isalpha() and text[at + 1].isalpha():
                break
            at += 1
        if at < 0:
            break
        out.append(text[start:at])
        start = at
    return [*out, text[start:]]


def line_ends(text: str) -> list[int]:
    """Ends of sections in code points: each line with its line end is one."""
    ends, at = [], -1
    while (at := text.find("\n", at + 1)) >= 0:
        ends.append(at + 1)
    return ends if ends and ends[-1] == len(text) or not text else [*ends, len(text)]


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """Tokens and boundary-crossing tokens of each section; both lists are byte offsets, and both end together."""
    if rule not in RULES:
        raise ValueError(f"the rule must be one of {RULES}")
    n = len(section_ends)
    starts = np.concatenate([[0], token_ends[:-1]]) if len(token_ends) else token_ends
    first, last = np.searchsorted(section_ends, starts, "right"), np.searchsorted(section_ends, token_ends - 1, "right")
    chosen = {"first": first, "last": last, "most": first.copy()}[rule]
    crossing = np.flatnonzero(first != last)
    if rule == "most":
        lower = np.concatenate([[0], section_ends[:-1]])
        for t in crossing.tolist():
            own = np.arange(first[t], last[t] + 1)
            share = np.minimum(section_ends[own], token_ends[t]) - np.maximum(lower[own], starts[t])
            chosen[t] = own[share.argmax()]
    return np.bincount(chosen, minlength=n), np.bincount(chosen[crossing], minlength=n)


def count_sections(text: bytes | None, encoder: Encoder, rule: str = "most") -> tuple[int, list[dict]]:
    if not text:
        return 0, []
    whole = text.decode("utf-8", "replace")
    if "�" in whole:
        text = whole.encode()
    ends = line_ends(whole)
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    token_ends = encoder.token_ends(whole)
    in_bytes = np.searchsorted(chars, np.array(ends), "right") - 1 if len(chars) != len(whole) + 1 else np.array(ends)
    counts, crossing = attribute(token_ends, in_bytes, rule)
    starts = [0, *ends[:-1]]
    return len(token_ends), [{"start": a, "end": b, "n_tokens": c, "n_crossing": x} for a, b, c, x in zip(starts, ends, counts.tolist(), crossing.tolist())]


_ENCODERS: dict[tuple[str, bytes], Encoder] = {}


def count(docs: DataFrame, keep: list[str], text_col: str = "text", ranks: str = RANKS, pattern: str = PATTERN, rule: str = "most") -> DataFrame:
    """The columns ``keep`` of ``docs`` as c0, c1, ... with n_tokens and the sections (lines) of each text.

    Null and empty texts have no tokens and no sections; an empty line is a section of its line end; repeated rows
    are each counted; an empty table gives an empty result; columns of ``docs`` may have any names. The vocabulary file is read on the driver and sent to the workers (1 MB).
    """
    sent = docs.sparkSession.sparkContext.broadcast(Path(ranks).read_bytes())
    if len(sent.value) > 64 << 20:
        raise ValueError("a vocabulary of over 64 MB is not one for this encoder")

    def compute(texts):
        key = (pattern, hashlib.sha256(sent.value).digest())
        if key not in _ENCODERS:
            _ENCODERS[key] = Encoder(sent.value, pattern)
        made = [count_sections(t, _ENCODERS[key], rule) for t in texts]
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "end", "n_tokens", "n_crossing")]))
        return [pa.array([n for n, _ in made], pa.int64()), pa.array([s for _, s in made], kind)]

    return annotate(docs, text_col, keep, SECTIONS, compute)


def by_section(counted: DataFrame) -> DataFrame:
    """One row per section, numbered from 0; a text without sections has no row."""
    return counted.select("c0", "n_tokens", F.posexplode("sections").alias("section", "s")).select(
        F.col("c0").alias("doc_id"), "section", F.col("s.start"), F.col("s.end"), F.col("s.n_tokens").alias("n_tokens"), F.col("s.n_crossing").alias("n_crossing"), F.col("n_tokens").alias("n_doc_tokens")
    )
