"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import decontaminate, filter_audit, langid, line_dedup, lm_scoring, pii, quality_rules, sentencepiece_fst, simhash, token_counts, toxicity, vector_codes, warc
from causeway.llm.common import remainder_of_id, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, one row a line. Null and empty texts have no line and so no row; repeated
    rows and ids each give theirs; empty tables give no rows; other columns are not read."""
    return token_counts.by_section(token_counts.count(table(spark, sf_dir, "documents"), ["doc_id"]))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, base verdict and certified verdict of every document. Null and empty texts have no words and fail the
    base; a null language is a stratum of its own; repeated rows each get a verdict; null ids get one and are never
    labelled; contradicting labels of an id count as good; without labels only the base decides."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("good"))
    found = quality_rules.judge(table(spark, sf_dir, "documents"), labels)
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back. A null html is an empty payload; of repeated rows with a
    payload's largest id each is a response; pages without an id are revisits where an equal payload has one, else
    responses; an empty table gives no rows."""
    index = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(index, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by a network that has not seen the held-out third. Null texts and texts without a
    letter are ``und`` with score 0; rows without a language or id are not learnt from, and a null id is not held out;
    repeated rows are each predicted; without anything to learn all are ``und``."""
    docs = table(spark, sf_dir, "documents")
    fold = remainder_of_id("doc_id", 3)
    network = langid.fit(docs.where(fold != 1))
    out = langid.predict(docs, network, ["doc_id"])
    return out.select(F.col("c0").alias("doc_id"), F.coalesce(remainder_of_id("c0", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by labels outside the held-out fifth. Null and empty texts have no evidence; labels
    that are null or of null ids do not count, of several the largest does; a null id is not held out; repeated rows are
    each scored; without toxic or clean labels all scores are near 0."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(remainder_of_id("doc_id", 5) != 0))
    out = toxicity.score(docs, model, ["doc_id"])
    return out.select(
        F.col("c0").alias("doc_id"), F.coalesce(remainder_of_id("c0", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages")
    )


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether decoding gives the text back. Null and empty texts have no ids and count
    as a round trip; repeated rows are each encoded; an empty table gives no rows."""
    out = sentencepiece_fst.encode(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select(F.col("c0").alias("doc_id"), "n_tokens", "n_byte_tokens", "ids", "round_trip")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a benchmark window, and the items these are of. Null and empty texts have no
    words; repeated rows each give theirs; an item without an id marks words but is not listed, a repeated one counts
    once; an empty benchmark marks nothing."""
    return decontaminate.report(decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"]))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts of the base kinds, all spans and their scores. A null text is empty and
    has no spans; repeated rows each give theirs; an empty table gives no rows."""
    return pii.report(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document. Null and empty texts have fingerprint zero and are linked like any
    other; repeated rows each keep a row; a null id names a component only where all its ids are null."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document between the documents labelled good and all documents, its own counts
    left out of both. Texts without a word have null scores; null ids are never good; repeated rows are copies of each
    other; without good documents the target is smoothing alone."""
    docs = table(spark, sf_dir, "documents")
    wanted = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return lm_scoring.score(docs, wanted, ["doc_id"]).select(F.col("c0").alias("doc_id"), "n_tokens", "in_target", "target_loss", "background_loss", "score")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document before and after those that a document with a smaller id holds too are dropped. Null and
    empty texts are one empty line; rows of one id are one document and each give a row; rows without an id lose what
    any other holds; empty tables give no rows; other columns are not read."""
    found = line_dedup.dedupe(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select(F.col("c0").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of every vector of finite numbers, and the codebooks' digest. Null and empty vectors and those of
    another length are left out; repeated rows and ids each count and give a row; null ids come last among those that
    the codebooks start from; null labels are one label; empty tables give no rows."""
    coded = vector_codes.with_label_errors(vector_codes.compress(table(spark, sf_dir, "embeddings")))
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in each of their orders, by language. Null texts are empty, null languages the empty
    string; repeated rows each count; rows without an id are no copies and have no label; of several labels of an id one
    is enough; empty tables give no rows."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    return filter_audit.run(table(spark, sf_dir, "documents"), labels)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_token_counts, op2_quality_rules, op3_warc, op4_language_id, op5_toxicity, op6_sentencepiece, op7_decontaminate, op8_pii, op9_simhash, op10_lm_scoring, op11_line_dedup, op12_vector_codes, op13_filter_audit)
}

