"""Secrets of shapes that once went through, and prose that must stay."""

import random

import duckdb
import pytest

from causeway.llm import oracles, pii
from oracle import difference

PEM = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,A1B2C3\n\n" + "MIIEpAIBAAKCAQEA+/x\n" * 30 + "-----END RSA PRIVATE KEY-----"
LEAKS = [
    PEM, "token: abcdefghijklmnopqrstuvwx", "token: " + "q" * 500, "Authorization: Bearer abcdefgh", 'authorization="Basic dXNlcjpwYXNz', "curl -H 'bearer abcdefghijklmnopqrstuvwxyz'", "sk_live_abcdefghij1234", "pk_test_ABCDEFGHIJKL",
    "sk-proj-abcdefghijklmnopqrstuv", "password=abc", "db_password='xyz'", 'pwd:="q w"', "secret: quietRiverStone", "glpat-abcdefghijklmnopqrst",
]
PROSE = ["the secret: nobody knows", "token of love", "password: inc", "api_key=abc", "a bearer of news", "bearer securities", "risk-management-framework-of-two", "password==", "-----BEGIN PRIVATE KEY----- and no end - at all"]


@pytest.mark.parametrize("at", range(len(LEAKS)))
def test_leaks_are_gone(spark, at):
    text = LEAKS[at]
    value = max(text.replace("\n", " ").replace("'", " ").replace('"', " ").replace("=", " ").split(), key=len) if at else "MIIEpAIBAAKCAQEA"
    docs = spark.createDataFrame([(1, f"before {text} after")], "doc_id long, text string")
    assert value not in pii.redact(docs, length_col=None).first().text


def test_prose_stays(spark):
    docs = spark.createDataFrame(list(enumerate(PROSE)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.redact(docs, length_col=None).collect()} == dict(enumerate(PROSE))


def test_many_keys_that_never_end(spark):
    docs = spark.createDataFrame([(1, "-----BEGIN PRIVATE KEY-----\n" * 2000), (2, "-----BEGIN PRIVATE KEY-----" + " - x" * 50_000)], "doc_id long, text string")
    assert sorted(len(r.spans) for r in pii.find(docs).collect()) == [0, 0]


def test_report_equals_its_sql(spark, tmp_path):
    rng = random.Random(7)
    texts = LEAKS + PROSE + ["".join(rng.choice([*LEAKS, *PROSE, " ", "\n", "x", '"', "é", "_"]) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    assert difference(pii.report(pii.find(spark.read.parquet(f"{tmp_path}/documents"))), con, oracles.PII) == ""
