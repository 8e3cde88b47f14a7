"""Task and result files, literature tables, and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators.storage import kept

TASK = (
    "id string, task string, input struct<material:string,processing_conditions:map<string,string>>, query map<string,string>, target_property string, target_material string, "
    "constraints map<string,string>, expected_outcome string, expected_synthesis string, accepted_ranges map<string,string>, domain string"
)


def read_tasks(spark: SparkSession, path: str, default_id: bool = True) -> DataFrame:
    """One task per line; blank and malformed lines are left out, missing ids become ``task_<line>``.

    Line numbers come from reading each file whole, which task lists allow."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value")).where(F.trim("value") != "")
    rows = lines.where(F.try_parse_json("value").isNotNull()).select("line", F.from_json("value", TASK).alias("t")).select("line", "t.*")
    name = F.coalesce("id", F.concat(F.lit("task_"), F.col("line") + 1)) if default_id else F.col("id")
    return rows.withColumn("id", name)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Results of a file that is a list, an object with a list under ``results``, or one object."""
    text = spark.read.text(path, wholetext=True)
    wrapped = F.from_json("value", f"results array<struct<{_struct(schema)}>>")["results"]
    rows = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<struct<{_struct(schema)}>>")).otherwise(F.coalesce(wrapped, F.array(F.from_json("value", schema))))
    return text.select(F.posexplode(rows).alias("ord", "r")).select("ord", "r.*")


def _struct(schema: str) -> str:
    return ",".join(f"{n}:{t}" for n, t in (x.strip().split(" ", 1) for x in schema.split(",")))


def to_json(df: DataFrame, keep_nulls: bool = False) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": str(not keep_nulls).lower()}).alias("value"))


def write_results(df: DataFrame, path: str, by: str | None = None) -> None:
    """CSV and JSON beside each other, by a column's values if given. Columns that CSV has no form for go as JSON text."""
    plain = df.select(*[F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f"`{f.name}`") for f in df.schema.fields])
    for kind, rows in (("csv", plain), ("json", df)):
        writer = rows.write.mode("overwrite").option("header", True)
        (writer.partitionBy(by) if by else writer).format(kind).save(f"{path}/{kind}")


def write_by_task(df: DataFrame, path: str, task: str = "task_name") -> None:
    """Results of each task in a folder of its own, and all of them together."""
    write_results(df, f"{path}/by_task", task)
    write_results(df, f"{path}/combined")


def counts_by_name(df: DataFrame, names: list[str], id_col: str = "task_id") -> DataFrame:
    """(task, n): how many ids hold each name, in one pass; a name that none holds has 0."""
    sums = df.agg(*[F.count_if(F.col(id_col).cast("string").contains(n)).alias(f"n{i}") for i, n in enumerate(names)])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(n).alias("task"), F.col(f"n{i}").alias("n")) for i, n in enumerate(names)])))


class LiteratureSource:
    """Papers by a search function (query, n) -> list of dicts, run on the workers with one call per query.

    A failed search gives no papers. Offline, ``from_table`` searches a table instead."""

    FIELDS = "title string, abstract string, url string, year int, citations long, authors array<string>, source string"

    def __init__(self, search: Callable[[str, int], list[dict]]):
        self.search = search

    def find(self, queries: DataFrame, most: int = 3) -> DataFrame:
        """(query, rank, FIELDS) for ``queries(query)``."""
        search, names = self.search, [x.split()[0] for x in self.FIELDS.split(", ")]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = []
                for query in frame["query"]:
                    try:
                        found = search(query, most)[:most]
                    except Exception:  # noqa: BLE001 - a failed search is an empty one
                        found = []
                    rows += [(query, i, *(p.get(n) for n in names)) for i, p in enumerate(found)]
                yield pd.DataFrame(rows, columns=["query", "rank", *names])

        return queries.select("query").mapInPandas(run, f"query string, rank int, {self.FIELDS}")

    @staticmethod
    def from_table(papers: DataFrame, queries: DataFrame, most: int = 3) -> DataFrame:
        """(query, rank, ord, title, citations, abstract) of the ``papers(ord, title, citations, abstract)`` whose abstract
        holds a word of the query of three letters or more, most cited first, ties by title and ord. Papers of equal title
        and citations are papers of their own."""
        from pyspark.sql import Window

        words = queries.select("query", F.explode(F.split(F.lower("query"), r"\s+")).alias("word")).where(F.length("word") > 2).distinct()
        words = kept(words, "words")
        papers = papers.select("ord", "title", "citations", "abstract").withColumn("key", F.xxhash64("ord", "title", "citations", "abstract"))
        tokens = papers.select("key", "citations", F.explode(F.array_distinct(F.split(F.lower("abstract"), r"\s+"))).alias("word"))
        # those that the most cited can be among, told without titles and texts; a task keeps few of them
        likely = F.dense_rank().over(Window.partitionBy("query").orderBy(F.desc("citations")))
        met = tokens.join(words, "word").select("query", "key", "citations").withColumn("place", likely).where(F.col("place") <= most).select("query", "key").distinct()
        met = kept(met, "likely")  # its size is then known, so that papers need not move
        by = Window.partitionBy("query").orderBy(F.desc("citations"), "title", "ord")
        found = papers.join(met, "key").drop("key").dropDuplicates(["query", "ord", "title", "citations"])
        top = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)
        return top.select("query", "rank", "ord", "title", "citations", "abstract")
