"""DuckDB SQL of the rows of the queries that SQL can express."""

from causeway.llm.pii import IBAN_LENGTHS

_BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"

WARC = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, payload_bytes, h,
    array_to_string(list_transform(range(0, 32), lambda i:
      substr({_BASE32}, 1 + ((('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER) & 31)::BIGINT, 1)), '') AS payload_digest
  FROM p),
g AS (SELECT h, max(page_id) AS largest FROM p GROUP BY h)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM largest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM largest THEN NULL ELSE largest END AS refers_to
FROM d JOIN g USING (h)
"""

_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""
WITH i AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, k, k + least(10, len(w)) - 1), ' ') AS run
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM iw),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
dw AS (
  SELECT r, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS run
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT dw.r, dw.n, dw.k, iw.item_id FROM dw JOIN iw USING (n, run)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(k, k + n)) AS p FROM hits) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS said
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(said, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

#: The operator's defaults: (rule, numerator, denominator, small values are bad, grid width, grid steps).
_RULES = [
    ("symbol_share", "n_symbols", "n_words", False, 0.01, 100),
    ("dup_line_share", "n_dup_lines", "n_lines", False, 0.01, 100),
    ("repeat_share", "n_repeat_words", "n_words", False, 0.01, 100),
    ("upper_share", "n_upper", "word_chars", False, 0.01, 100),
    ("long_words", "word_chars", "n_words", False, 0.25, 160),
    ("short_words", "word_chars", "n_words", True, 0.25, 160),
]
_STEP = "CAST(least(floor(coalesce(CASE WHEN {1} = 0 THEN NULL ELSE CAST({0} AS DOUBLE) / {1} END, 0) / CAST({2} AS DOUBLE) + 1e-9), {3}) AS INTEGER)"
_STEPS = "\nUNION ALL ".join(
    f"SELECT r, stratum, {i} AS rule, {str(low).lower()} AS low, {_STEP.format(over, under, width, steps)} AS step FROM m" for i, (_, over, under, low, width, steps) in enumerate(_RULES)
)
_NAMES = "[" + ", ".join(f"'{r[0]}'" for r in _RULES) + "]"

#: A level counts as certified while all more lenient ones are; -step turns "small is bad" into "large is bad".
QUALITY = rf"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, 'null') AS stratum, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (SELECT r, k, [w[k], w[k + 1], w[k + 2]] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS k FROM t WHERE len(w) >= 3)),
twice AS (SELECT r, g FROM win GROUP BY r, g HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(k, k + 3)) AS p FROM win JOIN twice USING (r, g)) GROUP BY r),
m AS (
  SELECT t.r, doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, len(lines) AS n_lines,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper
  FROM t LEFT JOIN rep USING (r)),
s AS ({_STEPS}),
good AS (SELECT doc_id, max(quality) AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
sd AS (SELECT r, stratum, rule, CASE WHEN low THEN -step ELSE step END AS step FROM s),
lab AS (
  SELECT sd.*, g.good = 1 AS good, ('0x' || substr(md5(CAST(m.doc_id AS VARCHAR)), 1, 4))::INTEGER % 10 < 3 AS learn
  FROM sd JOIN m USING (r) JOIN good g ON g.doc_id = m.doc_id),
tot AS (SELECT stratum, rule, count(*) FILTER (good) AS n, count(*) FILTER (NOT good) AS b FROM lab WHERE learn GROUP BY stratum, rule),
at_step AS (SELECT stratum, rule, step, count(*) FILTER (good) AS g, count(*) FILTER (NOT good) AS b FROM lab WHERE learn GROUP BY stratum, rule, step),
odds AS (
  SELECT a.stratum, a.rule, a.step, ln((sum(a.b) OVER w + 0.5::DOUBLE) / (t.b + 1)) - ln((sum(a.g) OVER w + 0.5::DOUBLE) / (t.n + 1)) AS odds
  FROM at_step a JOIN tot t USING (stratum, rule) WINDOW w AS (PARTITION BY a.stratum, a.rule ORDER BY a.step DESC)),
lv AS (
  SELECT stratum, rule, step, CAST(least(60, greatest(0, floor(10 * max(odds) OVER (PARTITION BY stratum, rule ORDER BY step) + 1e-9))) AS INTEGER) AS level FROM odds),
dl AS (SELECT sd.r, sd.stratum, sd.rule, coalesce(max(lv.level), 0) AS level FROM sd LEFT JOIN lv ON lv.stratum = sd.stratum AND lv.rule = sd.rule AND lv.step <= sd.step GROUP BY ALL),
held AS (SELECT r, stratum, good FROM lab WHERE NOT learn AND rule = 0 AND stratum IN (SELECT stratum FROM tot)),
top AS (SELECT h.stratum, h.r, h.good, max(dl.level) AS level FROM held h JOIN dl USING (r) GROUP BY ALL),
lev AS (SELECT 0.05::DOUBLE / count(DISTINCT stratum) AS level, 0.02::DOUBLE AS risk FROM lab),
cut AS (SELECT stratum, count(*) FILTER (good) AS n, count(*) FILTER (NOT good) AS b, unnest(range(0, 61)) AS c FROM top GROUP BY stratum),
k AS (
  SELECT c.stratum, c.c, c.n, c.b, count(*) FILTER (t.good) AS k, count(t.r) FILTER (NOT t.good) AS kb
  FROM cut c LEFT JOIN top t ON t.stratum = c.stratum AND t.level > c.c WHERE c.n > 0 AND c.b > 0 GROUP BY ALL),
p AS (
  SELECT stratum, c, n, b, k, kb, CASE WHEN k >= n THEN 1.0 ELSE
    list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma((n + 1)::DOUBLE) - lgamma((i + 1)::DOUBLE) - lgamma((n - i + 1)::DOUBLE) + i * ln(risk) + (n - i) * ln(1 - risk)))) END <= level AS fine
  FROM k, lev),
ok AS (SELECT *, bool_and(fine) OVER (PARTITION BY stratum ORDER BY c DESC) AS certified, kb::DOUBLE / b - k::DOUBLE / n AS gain FROM p),
best AS (SELECT stratum, arg_max(c, [round(gain, 11), c]) AS c FROM ok WHERE certified AND gain > 0.01 + 1e-12 GROUP BY stratum),
failed AS (
  SELECT r, string_agg({_NAMES}[dl.rule + 1], ',' ORDER BY dl.rule) AS said
  FROM dl JOIN best USING (stratum) WHERE dl.level > best.c GROUP BY r),
o AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(said, '') AS failed_rules
  FROM m LEFT JOIN failed USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM o
"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"(list_sum(list_transform(range(0, length({_DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN substr(reverse({_DIGITS}), CAST(i + 1 AS BIGINT), 1)::INTEGER ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][1 + substr(reverse({_DIGITS}), CAST(i + 1 AS BIGINT), 1)::INTEGER] END)) % 10 = 0)"
_KEYS = (
    "AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{10,}\\.eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}"
    "|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[^-]+(?:-{1,4}[^-]+){0,200}-----END [A-Z ]{0,20}PRIVATE KEY-----"
    "|\\b(?:[spr]k_(?:live|test)_[A-Za-z0-9]{10,}|sk-[A-Za-z0-9_-]{20,}|glpat-[A-Za-z0-9_-]{20,}|hf_[A-Za-z0-9]{30,}|npm_[A-Za-z0-9]{36,})"
)
_AUTH = "(?i)\\b(?:authorization[\"'']?[\\x20\\t]{0,4}[:=][\\x20\\t]{0,4}[\"'']?(?:bearer|basic|token|digest)[\\x20\\t]{1,4}[A-Za-z0-9._~+/=-]{6,}|bearer[\\x20\\t]{1,4}[A-Za-z0-9._~+/=-]{20,})"
_SECRET = (
    "(?i)\\b(?:[A-Za-z0-9]{1,20}[_-]){0,3}(?:(?:password|passwd|pwd|passphrase)[\"'']?(?:=>|:=|=)(?:\"[^\"\\n]{3,}\"|''[^''\\n]{3,}''|[^\\x20\\x09-\\x0D\"''=][^\\x20\\x09-\\x0D\"'']{2,})"
    "|(?:password|passwd|pwd|passphrase|api[_-]?key|access[_-]?key|secret|token)[\"'']?[\\x20\\t]{0,4}(?:=>|:=|[=:])[\\x20\\t]{0,4}"
    "(?:\"[^\"\\n]{6,}\"|''[^''\\n]{6,}''|[^\\x20\\x09-\\x0D]{6,}))"
)
_SECRET_VALID = (
    r"(regexp_matches(m, '^[^=:]*(?:=>|:=|[=:])(?:[^\x20\t>=]|[\x20\t]+[\"'']|[\x20\t]+.*[0-9]|[\x20\t]+[^\x20\x09-\x0D]{20})')"
    r" OR regexp_matches(m, '^[^=:]*(?:=>|:=|[=:])[\x20\t]+[^\x20\x09-\x0D]{12}') AND regexp_matches(m, '^[^=:]*(?:=>|:=|[=:])[\x20\t]+.*[a-z][A-Z]'))"
)


def _near(words: str) -> str:
    return rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{words})(?:$|[^\p{{L}}\p{{N}}_])"


_NUMBERS = _near("isbn|order|invoice|serial|part")
#: (kind, pattern, test of a match m, score, words nearby that raise it, by how much, words that lower it, by how much, least score)
_KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", 0.8, _near("e-?mail|mail|contact|write|reply"), 0.1, "^$", 0.0, 0.0),
    ("ip", r"[0-9]+(?:\.[0-9]+){3}", "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST(right('000' || x, 3) AS INTEGER) > 255)) = 0", 0.6,
     _near("ip|host|server|address|ping|client"), 0.2, _near("version|release|section|chapter|build"), 0.3, 0.0),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}", 0.7, _near("card|credit|visa|mastercard|amex|payment"), 0.2, _NUMBERS, 0.3, 0.0),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15", 0.6, _near("phone|call|tel|mobile|fax"), 0.2, "^$", 0.0, 0.0),
    ("iban", "", "", 0.7, _near("iban|bank|account|konto|compte|cuenta"), 0.2, "^$", 0.0, 0.5),
    # a run of digits and hyphens that is an id as a whole
    ("national_id", r"[0-9-]+", r"regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND m[1:3] NOT IN ('000', '666') AND m[1:1] <> '9' AND m[5:6] <> '00' AND right(m, 4) <> '0000'", 0.4,
     _near("ssn|social|security|national id|ausweis|identit[ée]"), 0.4, _NUMBERS, 0.3, 0.5),
    ("secret", _SECRET, _SECRET_VALID, 0.6, _near("login|user|key|access|auth"), 0.2, "^$", 0.0, 0.5),
    ("key", _KEYS, "true", 0.9, "^$", 0.0, "^$", 0.0, 0.5),
    ("auth", _AUTH, "true", 0.8, "^$", 0.0, "^$", 0.0, 0.5),
]
#: Matches and the pieces between them alternate, so sums of their lengths are the positions.
_MATCHES = "\nUNION ALL ".join(
    f"SELECT r, {k} AS rank, pos, pos + length(m) AS till FROM (SELECT r, m[i] AS m, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS pos "
    f"FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS g FROM d))) WHERE {valid}"
    for k, (name, pattern, valid, *_) in enumerate(_KINDS) if pattern
)
_IBAN_NUMBER = "list_reduce(list_transform(string_split(substr(bare, 5) || substr(bare, 1, 4), ''), lambda c: CAST(CASE WHEN ascii(c) < 65 THEN ascii(c) - 48 ELSE ascii(c) - 55 END AS BIGINT)), lambda a, x: ((CASE WHEN x > 9 THEN 100 ELSE 10 END) * a + x) % 97)"
_SCORED = "\nUNION ALL ".join(
    f"SELECT r, rank, pos, till, '{name}' AS kind, round({score} + CASE WHEN regexp_matches(near, '{words}') THEN {more} ELSE 0 END - CASE WHEN regexp_matches(near, '{against}') THEN {less} ELSE 0 END, 3) AS score, {least} AS least FROM n WHERE rank = {k}"
    for k, (name, _, _, score, words, more, against, less, least) in enumerate(_KINDS)
)
#: An IBAN starts wherever its pattern does and ends at its country's length, else at the last end that has a right
#: checksum; of overlapping ones the first counts.
PII = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
cand AS (
  SELECT r, pos, regexp_extract(substr(t || ' ', pos + 1), '^[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}') AS p, t FROM (
    SELECT r, t, unnest(range(0, length(t) - 14)) AS pos FROM d WHERE regexp_matches(t, '[A-Z]{{2}}[0-9]{{2}}\x20?[A-Z0-9]'))
  WHERE NOT regexp_matches(substr(t, pos, CASE WHEN pos > 0 THEN 1 ELSE 0 END), '[A-Za-z0-9]') AND regexp_matches(substr(t, pos + 1, 4), '^[A-Z]{{2}}[0-9]{{2}}$')),
cut AS (SELECT r, pos, e, substr(p, 1, e) AS piece, replace(substr(p, 1, e), ' ', '') AS bare, substr(t || ' ', pos + e + 1, 1) AS after FROM (SELECT *, unnest(range(15, length(p) + 1)) AS e FROM cand WHERE p <> '')),
fit AS (
  SELECT r, pos, max(CASE WHEN contains('@LENGTHS@', bare[1:2] || length(bare)) THEN 1000 ELSE 0 END + e) % 1000 AS e FROM cut
  WHERE right(piece, 1) <> ' ' AND NOT regexp_matches(after, '^[A-Za-z0-9]$') AND {_IBAN_NUMBER} = 1 GROUP BY r, pos),
numbered AS (SELECT r, pos, pos + e AS till, row_number() OVER (PARTITION BY r ORDER BY pos) AS k FROM fit),
walk(r, k, pos, till, good) AS (
  SELECT r, k, pos, till, true FROM numbered WHERE k = 1
  UNION ALL SELECT n.r, n.k, n.pos, CASE WHEN n.pos >= w.till THEN n.till ELSE w.till END, n.pos >= w.till FROM walk w JOIN numbered n ON n.r = w.r AND n.k = w.k + 1),
m AS (SELECT r, 4 AS rank, pos, till FROM walk WHERE good UNION ALL {_MATCHES}),
n AS (SELECT m.*, substr(t, greatest(1, pos + 1 - 40)::BIGINT, (pos - greatest(0, pos - 40))::BIGINT) || ' ' || substr(t, (till + 1)::BIGINT, 40) AS near FROM m JOIN d USING (r)),
s AS (SELECT *, kind || ':' || pos::BIGINT || ':' || till::BIGINT AS said FROM ({_SCORED}) WHERE score >= least),
o AS (
  SELECT r, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
    coalesce(string_agg(said, ',' ORDER BY pos, rank) FILTER (rank < 4), '') AS base, string_agg(said, ',' ORDER BY pos, rank) AS spans, string_agg(CAST(CAST(score AS DECIMAL(4, 2)) AS VARCHAR), ',' ORDER BY pos, rank) AS scores FROM s GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN o USING (r)
""".replace("@LENGTHS@", IBAN_LENGTHS)

#: White space of a line's ends, less the line end itself.
_ENDS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT r, doc_id, i, lines[i] AS line, translate(trim(lines[i], {_ENDS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM d)),
k AS (SELECT key, min(doc_id) AS least FROM l WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
o AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS kept
  FROM (SELECT l.*, coalesce(l.doc_id > k.least, false) AS gone FROM l LEFT JOIN k USING (key)) GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d JOIN o USING (r)
"""


def _lloyd(rounds: int = 6, parts: int = 8, entries: int = 16, scale: int = 4096) -> str:
    """The rounds one after the other, each entry's distance to each part worked out."""
    near = """n{0} AS MATERIALIZED (
  SELECT r, part, entry, err FROM (
    SELECT r, x.part, entry, sum((x.v - b.c) * (x.v - b.c)) AS err, row_number() OVER (PARTITION BY r, x.part ORDER BY sum((x.v - b.c) * (x.v - b.c)), entry) AS place
    FROM x JOIN b{0} b ON b.part = x.part AND b.pos = x.pos GROUP BY r, x.part, entry) WHERE place = 1)"""
    book = """b{1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.pos, coalesce((s - ((s % m) + m) % m) // m, b.c) AS c
  FROM b{0} b LEFT JOIN (SELECT x.part, n.entry, x.pos, sum(x.v) AS s, count(*) AS m FROM x JOIN n{0} n USING (r, part) GROUP BY ALL) t USING (part, entry, pos))"""
    steps = [near.format(0)]
    for i in range(rounds):
        steps += [book.format(i, i + 1), near.format(i + 1)]
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, embedding AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (
  SELECT r, CAST((i - 1) // (len(e) // {parts}) AS INTEGER) AS part, CAST((i - 1) % (len(e) // {parts}) AS INTEGER) AS pos, CAST(floor({scale} * CAST(e[i] AS DOUBLE)) AS BIGINT) AS v
  FROM (SELECT r, e, unnest(range(1, len(e) + 1)) AS i FROM kept)),
b0 AS MATERIALIZED (SELECT part, CAST(r AS INTEGER) AS entry, pos, CAST(v AS HUGEINT) AS c FROM x WHERE r < {entries}),
{(","+chr(10)).join(steps)},
coded AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(err) AS BIGINT) AS error FROM n{rounds} GROUP BY r),
said AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), said
"""


VECTORS = _lloyd()

#: Every order and step, each worked out from the masks of its part.
AUDIT = r"""
WITH f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
lab AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN d.doc_id > g.least THEN 16 ELSE 0 END AS mask
  FROM d JOIN g USING (t) LEFT JOIN lab ON lab.doc_id = d.doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask),
o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order FROM f a, f b, f c, f d, f e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (
  SELECT filter_order, step, bit, letter, coalesce((SELECT sum(q.bit) FROM f q WHERE contains(substr(filter_order, 1, step - 1), q.letter)), 0)::INTEGER AS before
  FROM (SELECT filter_order, unnest(range(1, 6))::INTEGER AS step FROM o) JOIN f ON letter = substr(filter_order, step, 1)),
a AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (mask & (bit | before) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM a
"""

ORACLE_SQL = {"op11_line_dedup": LINES, "op12_vector_codes": VECTORS, "op13_filter_audit": AUDIT, "op2_quality_rules": QUALITY, "op3_warc": WARC, "op7_decontaminate": DECONTAMINATE, "op8_pii": PII}
