"""Personal data by regular expressions, checksums and context words, in Catalyst expressions only.

Each kind has a pattern that proposes spans, leftmost and without overlap, and a validator: digit counts, octet
ranges, Luhn, mod 97, the look of a key. A proposal that fails is dropped. Each kind has a score to start from, higher
where a checksum confirms it; words nearby that speak for a kind raise it, words against it lower it. Added kinds are
reported from ``threshold`` on; base kinds are reported whatever their score, which comes along with each span.
Spans are counted in code points, end exclusive.

Positions come from splitting a text by the pattern: the pieces between matches and the matches themselves
alternate, so running sums of their lengths are the offsets. Patterns use possessive quantifiers and start only
where a run of their first class starts, or where the last match ended, which leaves the matches as they are and
keeps the search linear and without recursion on very long texts. Where the end of a span cannot be told by a pattern
(an IBAN and the capitals after it), the pattern is a look-ahead that proposes starts, and every end is tried.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import quoted


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: SQL over the matched string ``m``
    valid: str
    #: Score of a valid match without context; words nearby that raise it by ``bonus``, and that lower it by ``malus``.
    score: float = 1.0
    context: str = ""
    bonus: float = 0.0
    against: str = ""
    malus: float = 0.0
    #: Whether it is reported whatever its score.
    base: bool = False
    #: SQL over the text ``t`` that is false only where the pattern cannot match.
    hint: str = "true"
    #: SQL over a proposal ``m`` that gives the length of its span, null if none. The pattern is then empty but for a
    #: look-ahead whose first group is the proposal and one character more; a space ends the text.
    ends: str = ""


def _start(chars: str) -> str:
    """Start at the end of the last match or where a run of ``chars`` starts: from within a run, a match could only
    be a shorter form of the one that the run's start gives or refuses."""
    return rf"(?:\G|(?<![{chars}]))"


def _words(alternatives: str) -> str:
    """One of some words, in any case, between characters that are no letters, digits or underscores."""
    return rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{alternatives})(?:$|[^\p{{L}}\p{{N}}_])"


DIGITS = "regexp_replace(m, '[^0-9]', '')"
#: Letters count 10 to 35; the first four characters go to the end.
MOD97 = (
    "aggregate(filter(split(concat(substr(regexp_replace({0}, '[^0-9A-Z]', ''), 5), substr({0}, 1, 4)), ''), c -> c <> ''), 0, "
    "(r, c) -> cast(if(ascii(c) < 65, r * 10 + ascii(c) - 48, r * 100 + ascii(c) - 55) % 97 as int)) = 1"
)
#: Characters of an IBAN by country, as registered.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 "
    "GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 "
    "NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
)
#: Of all ends at which a proposal is a whole number with a right checksum, that of the country's length, else the last.
IBAN_END = (
    "array_max(transform(filter(sequence(15, length(m) - 1), e -> substr(m, e, 1) <> ' ' and not substr(m, e + 1, 1) rlike '[A-Za-z0-9]' and "
    + MOD97.format("substr(m, 1, e)")
    + f"), e -> named_struct('known', contains('{IBAN_LENGTHS}', concat(substr(m, 1, 2), cast(length(replace(substr(m, 1, e), ' ', '')) as string))), 'e', e))).e"
)
LOCAL = "A-Za-z0-9._%+-"
VERSIONS = _words("version|release|section|chapter|build")
NUMBERS = _words("isbn|order|invoice|serial|part")
BASE = (
    Kind("email", _start(LOCAL) + rf"[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true", 0.8, _words("e-?mail|mail|contact|write|reply"), 0.1, hint="contains(t, '@')", base=True),
    Kind("ip", _start("0-9") + r"[0-9]++(?:\.[0-9]++){3}", "forall(split(m, '[.]'), x -> length(ltrim('0', x)) <= 3 and cast(right(concat('000', x), 3) as int) <= 255)", 0.6, _words("ip|host|server|address|ping|client"), 0.2, VERSIONS, 0.3, base=True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", f"length({DIGITS}) between 12 and 19 and luhn_check({DIGITS})", 0.7, _words("card|credit|visa|mastercard|amex|payment"), 0.2, NUMBERS, 0.3, base=True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({DIGITS}) between 9 and 15", 0.6, _words("phone|call|tel|mobile|fax"), 0.2, hint="contains(t, '+')", base=True),
)
#: Names of settings that hold a secret, and what may stand between a name and its value.
SECRET_NAMES = "password|passwd|pwd|passphrase|api[_-]?key|access[_-]?key|secret|token"
#: A short value counts only where it stands right behind the name of a password.
PASSWORD = r"(?:password|passwd|pwd|passphrase)[\"']?(?:=>|:=|=)(?:\"[^\"\n]{3,}+\"|'[^'\n]{3,}+'|[^\x20\x09-\x0D\"'=][^\x20\x09-\x0D\"']{2,}+)"
SECRET = (
    rf"(?i)(?<![A-Za-z0-9_])(?:[A-Za-z0-9]{{1,20}}[_-]){{0,3}}(?:{PASSWORD}|(?:{SECRET_NAMES})[\"']?[\x20\t]{{0,4}}(?:=>|:=|[=:])[\x20\t]{{0,4}}"
    r"(?:\"[^\"\n]{6,}+\"|'[^'\n]{6,}+'|[^\x20\x09-\x0D]{6,}+))"
)
#: A value set off by spaces and without quotes may be prose: it must hold a digit, be longer than words are, or be of some
#: length with a capital behind a small letter.
SECRET_VALID = (
    r"""m rlike '^[^=:]*(=>|:=|[=:])([^\\x20\\t>=]|[\\x20\\t]+["\\x27]|[\\x20\\t]+.*[0-9]|[\\x20\\t]+[^\\x20\\x09-\\x0D]{20})' """
    r"""or (m rlike '^[^=:]*(=>|:=|[=:])[\\x20\\t]+[^\\x20\\x09-\\x0D]{12}' and m rlike '^[^=:]*(=>|:=|[=:])[\\x20\\t]+.*[a-z][A-Z]')"""
)
#: The public formats of keys that need no name beside them.
KEY = (
    r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"
    r"|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[^-]++(?:-{1,4}+[^-]++){0,200}+-----END [A-Z ]{0,20}PRIVATE KEY-----"
    r"|(?<![A-Za-z0-9_])(?:[spr]k_(?:live|test)_[A-Za-z0-9]{10,}+|sk-[A-Za-z0-9_-]{20,}+|glpat-[A-Za-z0-9_-]{20,}+|hf_[A-Za-z0-9]{30,}+|npm_[A-Za-z0-9]{36,}+)"
)
#: What a request is signed with.
AUTH = (
    r"(?i)(?<![A-Za-z0-9_])(?:authorization[\"']?[\x20\t]{0,4}[:=][\x20\t]{0,4}[\"']?(?:bearer|basic|token|digest)[\x20\t]{1,4}[A-Za-z0-9._~+/=-]{6,}+|bearer[\x20\t]{1,4}[A-Za-z0-9._~+/=-]{20,}+)"
)
ADDED = (
    Kind("iban", r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?s:.)))", "true", 0.7, _words("iban|bank|account|konto|compte|cuenta"), 0.2, ends=IBAN_END),
    Kind(
        "national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "substr(m, 1, 3) not in ('000', '666') and substr(m, 1, 1) <> '9' and substr(m, 5, 2) <> '00' and right(m, 4) <> '0000'",
        0.4, _words("ssn|social|security|national id|ausweis|identit[ée]"), 0.4, NUMBERS, 0.3,
    ),
    Kind("secret", SECRET, SECRET_VALID, 0.6, _words("login|user|key|access|auth"), 0.2, hint=r"""t rlike '(?i)(pass|pwd|key|secret|token)[a-z]{0,6}["\\x27]?[\\x20\\t]{0,4}[=:]'"""),
    Kind("key", KEY, "true", 0.9, hint="t rlike 'AKIA|gh[pousr]_|xox[abprs]-|AIza|eyJ|PRIVATE KEY|[spr]k_(live|test)_|sk-|glpat-|hf_|npm_'"),
    Kind("auth", AUTH, "true", 0.8, hint="t rlike '(?i)authorization|bearer'"),
)
KINDS = BASE + ADDED


def _quoted_sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _found(now: DataFrame, text: str, kinds: tuple[Kind, ...], threshold: float, near: int) -> DataFrame:
    """``now``, whose columns are c0, c1, ..., with its spans as ``__spans``; ``text`` is one of them."""
    own = now.columns
    now = now.withColumn("__t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    none = "cast(array() as array<struct<start:bigint,end:bigint,m:string>>)"
    made = []
    for rank, kind in enumerate(kinds):
        pattern, hint = _quoted_sql(kind.pattern), kind.hint.replace("(t,", "(__t,").replace("t rlike", "__t rlike")
        found, gaps, spans = f"__m{rank}", f"__g{rank}", f"__s{rank}"
        # an empty match at the very start would leave no gap before it
        within, group = ("concat(' ', __t, ' ')", 1) if kind.ends else ("__t", 0)
        now = now.withColumn(found, F.expr(f"if({hint}, regexp_extract_all({within}, {pattern}, {group}), cast(array() as array<string>))"))
        now = now.withColumn(gaps, F.expr(f"if(size({found}) > 0, split({within}, {pattern}, -1), cast(array() as array<string>))"))
        # running offset over gap, match, gap, match ...; only matches that pass are kept
        step = (
            f"aggregate({found}, named_struct('at', 0L, 'i', 0, 'got', {none}), (s, m) -> "
            f"named_struct('at', s.at + length({gaps}[s.i]) + length(m), 'i', s.i + 1, 'got', if({kind.valid}, "
            f"array_append(s.got, named_struct('start', s.at + length({gaps}[s.i]), 'end', s.at + length({gaps}[s.i]) + length(m), 'm', m)), s.got)), s -> s.got)"
        )
        if kind.ends:  # proposals may overlap: the first that holds counts
            step = (
                f"aggregate(transform({found}, m -> named_struct('m', m, 'n', {kind.ends})), "
                f"named_struct('at', -1L, 'i', 0, 'till', 0L, 'got', {none}), (s, x) -> "
                f"named_struct('at', s.at + length({gaps}[s.i]), 'i', s.i + 1, "
                f"'till', if(x.n is not null and s.at + length({gaps}[s.i]) >= s.till, s.at + length({gaps}[s.i]) + x.n, s.till), "
                f"'got', if(x.n is not null and s.at + length({gaps}[s.i]) >= s.till, array_append(s.got, named_struct('start', s.at + length({gaps}[s.i]), "
                f"'end', s.at + length({gaps}[s.i]) + x.n, 'm', substr(x.m, 1, x.n))), s.got)), s -> s.got)"
            )
        now = now.withColumn(spans, F.expr(f"if(size({found}) > 0, {step}, {none})"))
        around = f"concat(substr(__t, cast(greatest(1, x.start + 1 - {near}) as int), cast(x.start - greatest(0, x.start - {near}) as int)), ' ', substr(__t, cast(x.end + 1 as int), {near}))"
        score = f"{kind.score}D"
        for words, weight in ((kind.context, kind.bonus), (kind.against, -kind.malus)):
            score += f" + if({around} rlike {_quoted_sql(words)}, {weight}D, 0D)" if words else ""
        rated = f"transform({spans}, x -> named_struct('start', x.start, 'rank', {rank}, 'kind', '{kind.name}', 'end', x.end, 'score', round({score}, 3)))"
        made.append(rated if kind.base else f"filter({rated}, x -> x.score >= {threshold}D)")
    return now.select(*own, F.expr(f"array_sort(concat({', '.join(made)}))").alias("__spans"))


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns as c0, c1, ...: nothing made on the way can clash with them."""
    return docs.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])


def find(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS, threshold: float = 0.5, near: int = 40, out: str = "spans") -> DataFrame:
    """``docs`` with an array column ``out`` of (start, rank, kind, end, score), ordered by start and then kind.

    Null and empty texts have no spans; an empty table gives an empty one; repeated rows each keep theirs. A column that
    is already called ``out`` is replaced; any other name, whatever it is, stays as it was."""
    found = _found(_numbered(docs), f"c{docs.columns.index(text_col)}", kinds, threshold, near)
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c != out]
    return found.select(*kept, F.col("__spans").alias(out))


def as_text(spans: str, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """kind:start:end, comma-joined."""
    names = ", ".join(f"'{k.name}'" for k in kinds)
    return F.expr(f"array_join(transform(filter({spans}, x -> x.kind in ({names})), x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def report(found: DataFrame, id_col: str = "doc_id", spans: str = "spans") -> DataFrame:
    """Counts of the base kinds, the digest of their spans, all spans and their scores, one row for each of ``found``.

    No spans: counts of 0, the digest of the empty string, empty strings."""
    counts = [F.expr(f"cast(size(filter({spans}, x -> x.kind = '{k.name}')) as long)").alias(f"n_{k.name}") for k in BASE]
    scores = F.expr(f"array_join(transform({spans}, x -> cast(cast(x.score as decimal(4,2)) as string)), ',')")
    return found.select(quoted(id_col).alias("doc_id"), *counts, F.sha2(as_text(spans, BASE).cast("binary"), 256).alias("base_sha256"), as_text(spans).alias("spans"), scores.alias("scores"))


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", kinds: tuple[Kind, ...] = KINDS, threshold: float = 0.5, near: int = 40) -> DataFrame:
    """``docs`` with each span of its texts replaced by its kind in square brackets; overlapping spans are replaced
    at once, under the name of the first. ``length_col``, if there, becomes the new length of changed texts.

    Null texts stay null and empty ones empty; repeated rows are each redacted; an empty table stays empty; other
    columns, whatever their names, stay as they were."""
    text = f"c{docs.columns.index(text_col)}"
    found = _found(_numbered(docs), text, kinds, threshold, near)
    merged = F.expr(
        "aggregate(__spans, cast(array() as array<struct<start:bigint,end:bigint,kind:string>>), (d, x) -> if(size(d) > 0 and d[size(d) - 1].end > x.start, "
        "concat(slice(d, 1, size(d) - 1), array(named_struct('start', d[size(d) - 1].start, 'end', greatest(d[size(d) - 1].end, x.end), 'kind', d[size(d) - 1].kind))), "
        "array_append(d, named_struct('start', x.start, 'end', x.end, 'kind', x.kind))))"
    )
    found = found.withColumn("__merged", merged)
    pieces = (
        f"aggregate(__merged, named_struct('at', 0L, 'out', cast(array() as array<string>)), (s, x) -> named_struct('at', x.end, 'out', "
        f"concat(s.out, array(substr({text}, cast(s.at + 1 as int), cast(x.start - s.at as int)), concat('[', upper(x.kind), ']')))), "
        f"s -> concat(array_join(s.out, ''), substr({text}, cast(s.at + 1 as int))))"
    )
    found = found.withColumn("__new", F.expr(f"if(size(__merged) > 0, {pieces}, {text})"))
    columns = []
    for i, c in enumerate(docs.columns):
        if c == text_col:
            columns.append(F.col("__new").alias(c))
        elif c == length_col:
            columns.append(F.when(F.size("__merged") > 0, F.length("__new").cast(docs.schema[c].dataType)).otherwise(F.col(f"c{i}")).alias(c))
        else:
            columns.append(F.col(f"c{i}").alias(c))
    return found.select(*columns)
