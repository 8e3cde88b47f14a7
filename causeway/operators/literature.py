"""Literature for questions: queries from their words and paths, papers found, contexts for prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.text import search_queries, shortened
from causeway.operators.routing import question_words
from causeway.sources.records import LiteratureSource

MOST_QUERIES = 5
PER_QUERY = 3
MOST_PAPERS = 10


def queries(questions: DataFrame, decisions: DataFrame, direction: str = "forward", most: int = MOST_QUERIES) -> DataFrame:
    """(query_id, n, query): the first ``most`` literature queries of each question."""
    terms = question_words(questions).groupBy("query_id").agg(F.array_sort(F.collect_set("word")).alias("terms"))  # a question's own parameters
    rows = questions.select("query_id").join(decisions.select("query_id", "paths"), "query_id").join(terms, "query_id", "left")
    texts = F.transform("paths", lambda p: F.array_join(p, " -> "))
    made = search_queries(F.coalesce("terms", F.expr("cast(array() as array<string>)")), texts, F.lit(direction))
    return rows.select("query_id", F.posexplode(F.slice(made, 1, most)).alias("n", "query"))


def enrich(questions: DataFrame, decisions: DataFrame, direction: str = "forward", source: LiteratureSource | None = None, papers: DataFrame | None = None,
           most_queries: int = MOST_QUERIES, per_query: int = PER_QUERY, most_papers: int = MOST_PAPERS) -> DataFrame:
    """(query_id, ord, title, abstract, citations) of each question: ``per_query`` papers for each of its queries, from
    ``source`` or else from the table ``papers``; one of each title (in any case, the first found), the first
    ``most_papers``, ordered by citations."""
    asked = queries(questions, decisions, direction, most_queries)
    distinct = asked.select("query").distinct()  # a query that many questions share is searched once
    found = source.find(distinct, per_query) if source is not None else LiteratureSource.from_table(papers, distinct, per_query)
    rows = asked.join(found.select("query", "rank", "title", "abstract", "citations"), "query").where(F.coalesce("title", F.lit("")) != "")
    first = rows.groupBy("query_id", F.lower("title").alias("key")).agg(F.min(F.struct("n", "rank", "title", "abstract", "citations")).alias("p")).select("query_id", "p.*")
    early = Window.partitionBy("query_id").orderBy("n", "rank", "title")  # most_queries * per_query rows at most
    cited = Window.partitionBy("query_id").orderBy(F.desc("citations"), "n", "rank", "title")
    cut = first.withColumn("k", F.row_number().over(early)).where(F.col("k") <= most_papers)
    return cut.select("query_id", F.row_number().over(cited).alias("ord"), "title", "abstract", "citations")


def contexts(papers: DataFrame, length: int = 300) -> DataFrame:
    """(query_id, context): a question's papers as text, abstracts cut at ``length`` characters."""
    line = F.concat(F.lit("- "), "title", F.lit(" ("), F.coalesce("citations", F.lit(0)).cast("string"), F.lit(" citations): "), F.coalesce(shortened(F.col("abstract"), length), F.lit("")))
    listed = papers.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("ls"))  # ten at most
    return listed.select("query_id", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("context"))


def attached(results: DataFrame, papers: DataFrame) -> DataFrame:
    """``results`` with ``literature``: each question's papers as an array."""
    listed = papers.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ord", "title", "citations"))).alias("literature"))
    return results.join(listed, "query_id", "left")
