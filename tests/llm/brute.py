"""Plain Python versions of the operators, row by row, to hold results against."""

import base64
import hashlib
import re
import zlib
from collections import Counter

WS = r"[^\x20\x09-\x0D]+"


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"""
    text = text or ""
    words = re.findall(WS, text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WS, line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def warc(rows):
    """rows of (page_id, html) -> (page_id, payload_bytes, payload_digest, record_type, refers_to)"""
    data = [(p, (h or "").encode()) for p, h in rows]
    largest = {}
    for p, b in data:
        largest[b] = max((x for x in (largest.get(b), p) if x is not None), default=None)
    out = []
    for p, b in data:
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        own = p == largest[b]
        out.append((p, len(b), digest, "response" if own else "revisit", None if own else largest[b]))
    return out


SMALL = {c: c + 32 for c in range(65, 91)}


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(SMALL))


def contaminated(docs, items):
    """docs and items of (id, text) -> (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)"""
    windows = {}
    for i, text in items:
        w = bench_words(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    lengths = {len(w) for w in windows}
    out = []
    for d, text in docs:
        w = bench_words(text)
        hit, found = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= own
        names = sorted(str(x) for x in found if x is not None)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def personal(text):
    """n_email, n_ip, n_card, n_phone, base_sha256, and the spans of the base kinds"""
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    spans = []
    for rank, (kind, (pattern, valid)) in enumerate(kinds.items()):
        spans += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if valid(m[0])]
    spans.sort()
    said = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
    return (*(sum(s[2] == k for s in spans) for k in kinds), hashlib.sha256(said.encode()).hexdigest(), said)


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n
