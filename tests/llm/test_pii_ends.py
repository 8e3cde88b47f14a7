"""Spans whose end depends on what follows: IBANs before capitals, secrets of any length."""

from causeway.llm import pii

BARE, SPACED = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"
GB, NO = "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"


def test_ibans_before_anything(spark):
    texts, want = [], []
    for iban in (BARE, SPACED, GB, NO):
        for before in ("", "IBAN ", "é😀 "):
            for after in ("", " ", ".", " Bank", " Please pay", " BIC", " BIC COBADEFF", " and", "\nX", " 7", " A"):
                texts.append(before + iban + after)
                want.append([(len(before), len(before) + len(iban))])
    for a in (BARE, SPACED, GB):
        texts.append(f"{a} {NO} {BARE}")
        want.append([(0, len(a)), (len(a) + 1, len(a) + 1 + len(NO)), (len(a) + len(NO) + 2, len(a) + len(NO) + 2 + len(BARE))])
    for none in (BARE + "x", "x" + BARE, BARE[:-1] + "1", "AB12 " * 5000, "A" * 50_000, ""):
        texts.append(none)
        want.append([])
    other = next(x for x in (f"ZZ{c:02}123456789012345" for c in range(2, 99)) if mod97(x))  # no registered country
    texts.append(other + " BIC")
    want.append([(0, len(other))])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if pii.KINDS[s.rank].name == "iban"] for r in pii.find(docs).collect()}
    for i, text in enumerate(texts):
        if not text.startswith("AB12"):
            assert got[i] == want[i], text[:80]


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def test_secrets_are_taken_whole(spark):
    rows = [(n, f"api_key={'k' * n} next") for n in (5, 6, 200, 201, 400, 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(docs, length_col=None).collect()}
    assert got == {n: t if n < 6 else "[SECRET] next" for n, t in rows}
