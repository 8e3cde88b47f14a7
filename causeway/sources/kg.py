"""Graph files: reading, normalising, validating, merging, migrating and writing."""

from __future__ import annotations

import json
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.functions import lexicons as lx
from causeway.functions import text as tx
from causeway.operators.graph import last_wins

_STRINGS = (
    "cause_parameter effect_on_doping affected_property mechanism_quote source_file source_doi confidence_level relationship_id source relation target "
    "psp_type material evidence_text paper_doi"
).split()
RAW = T.StructType([*(T.StructField(n, T.StringType()) for n in _STRINGS), T.StructField("confidence", T.DoubleType()), T.StructField("curation", T.StringType())])
FILE = T.StructType([T.StructField("causal_relationships", T.ArrayType(RAW))])


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw rows with their position ``ord``: from a file with a list under ``causal_relationships``, or a bare list."""
    text = spark.read.text(path, wholetext=True)
    bare = F.ltrim("value").startswith("[")
    rows = F.when(bare, F.from_json("value", T.ArrayType(RAW))).otherwise(F.from_json("value", FILE)["causal_relationships"])
    return text.select(F.posexplode(rows).alias("ord", "r")).select("ord", "r.*")


def normalise(raw: DataFrame, legacy: bool = False, unique: bool = True) -> DataFrame:
    """Edges from raw rows: placeholders out, ends trimmed, missing attributes inferred, last row of a pair wins.

    Stored types and relations are kept if valid; ``legacy`` infers them from text whatever is stored."""
    has = set(raw.columns)
    col = lambda n, kind="string": F.col(n) if n in has else F.lit(None).cast(kind)
    blank = lambda c: F.when(F.trim(c) != "", c)
    src = F.trim(F.coalesce(blank(col("cause_parameter")), col("source"), F.lit("")))
    dst = F.trim(F.coalesce(blank(col("effect_on_doping")), col("target"), F.lit("")))
    rows = raw.withColumn("src", src).withColumn("dst", dst).where(~tx.is_placeholder(F.col("src")) & ~tx.is_placeholder(F.col("dst")))
    about = F.coalesce(blank(col("affected_property")), F.col("dst"))
    kind, relation = tx.infer_psp_type(F.col("src"), about), tx.infer_relation(F.col("dst"))
    if not legacy:
        kind = F.coalesce(F.when(col("psp_type").isin(lx.EDGE_TYPES), col("psp_type")), kind)
        relation = F.coalesce(blank(col("relation")), relation)
    out = rows.select(
        "src", "dst", kind.alias("psp_type"), relation.alias("relation"), F.coalesce(blank(col("material")), tx.infer_material_extended(F.coalesce(col("source_file"), F.lit("")))).alias("material"),
        F.coalesce(col("mechanism_quote"), col("evidence_text"), F.lit("")).alias("mechanism"), about.alias("affected_property"), F.coalesce(col("source_file"), F.lit("")).alias("source_file"),
        F.coalesce(col("source_doi"), col("paper_doi"), F.lit("")).alias("source_doi"), F.coalesce(col("confidence", "double"), tx.parse_confidence(col("confidence_level"))).alias("confidence"),
        F.coalesce(col("curation"), F.lit("extracted")).alias("curation"), col("relationship_id").alias("relationship_id"), F.col("ord").cast("long").alias("ord"),
    )
    return last_wins(out) if unique else out


def read(spark: SparkSession, path: str, legacy: bool = False) -> DataFrame:
    edges = normalise(read_raw(spark, path), legacy)
    if edges.isEmpty():
        raise ValueError(f"no valid relationship in {path}")
    return edges


def write(edges: DataFrame, path: str) -> None:
    """One JSON object per edge, under names that ``read_records`` and ``normalise`` take back."""
    _records(edges).write.mode("overwrite").json(path)


def _records(edges: DataFrame) -> DataFrame:
    return edges.select(
        F.col("src").alias("cause_parameter"), F.col("dst").alias("effect_on_doping"), F.col("src").alias("source"), F.col("dst").alias("target"), "psp_type", "relation", "material", "affected_property",
        F.col("mechanism").alias("mechanism_quote"), F.col("mechanism").alias("evidence_text"), "source_file", "source_doi", "confidence", F.col("confidence").cast("string").alias("confidence_level"), "curation", "relationship_id", "ord",
    )


def write_file(edges: DataFrame, path: str, **header: str) -> None:
    """One JSON document as ``read_raw`` takes it: a header with the counts, and the relationships by position. It is
    written line by line from one sorted partition, since it is one document; large graphs are for ``write``."""
    n = edges.count()
    head = json.dumps({**header, "total_relationships": n}, ensure_ascii=False)[:-1] + ', "causal_relationships": ['
    lines = _records(edges).select("ord", F.to_json(F.struct("*")).alias("value"))
    last = Window.partitionBy(F.lit(0)).orderBy("ord", "value")  # the one document's order
    body = lines.select("ord", F.concat("value", F.when(F.row_number().over(last) < n, F.lit(",")).otherwise("")).alias("value"))
    ends = edges.sparkSession.createDataFrame([(-1, 0, head), (1, 0, "]}")], "part int, ord long, value string")
    whole = ends.union(body.select(F.lit(0), "ord", "value"))
    whole.coalesce(1).sortWithinPartitions("part", "ord").select("value").write.mode("overwrite").text(path)


def read_records(spark: SparkSession, path: str, legacy: bool = False) -> DataFrame:
    """What ``write`` has written: JSON lines, read in parallel."""
    return normalise(spark.read.schema(T.StructType([*RAW.fields, T.StructField("ord", T.LongType())])).json(path), legacy)


def problems(raw: DataFrame) -> DataFrame:
    """Per row of raw relationships: missing required fields (errors), a type or a confidence out of range (warnings)."""
    missing = F.filter(F.array(*[F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(c)) for c in ("source", "relation", "target", "psp_type")]), lambda x: x.isNotNull())
    return raw.select(
        "ord", F.array_join(missing, ",").alias("missing"), F.size(missing).alias("n_errors"),
        F.coalesce(~F.col("psp_type").isin(lx.VALID_EDGE_TYPES), F.lit(False)).alias("bad_type"), F.coalesce(~F.col("confidence").between(0, 1), F.lit(False)).alias("bad_confidence"),
    )


def is_valid(raw: DataFrame) -> bool:
    row = problems(raw).agg(F.count("*"), F.sum("n_errors")).first()
    return bool(row[0]) and not row[1]


def validate(spark: SparkSession, path: str) -> tuple[bool, dict[str, int | str]]:
    """Whether a graph file is sound, and its counts: a missing file, text that is no JSON, no relationships and missing
    required fields are errors; types and confidences out of range are warnings."""
    try:
        text = spark.read.text(path, wholetext=True)
        broken = text.where(F.try_parse_json("value").isNull()).count()
    except Exception as e:  # noqa: BLE001 - what cannot be read is a finding
        return False, {"error": f"not readable: {type(e).__name__}"}
    if broken:
        return False, {"error": "not JSON"}
    row = problems(read_raw(spark, path)).agg(F.count("*").alias("n"), F.coalesce(F.sum("n_errors"), F.lit(0)).alias("errors"), F.count_if("bad_type").alias("types"), F.count_if("bad_confidence").alias("confidences")).first()
    if not row.n:
        return False, {"error": "no relationships"}
    return not row.errors, {"relationships": row.n, "errors": row.errors, "warnings": row.types + row.confidences}


def resolve(path: str | None, default: str) -> str:
    """The graph file that is meant: the given one, or ``default``."""
    return path or default


MERGE_KEYS = ("source", "relation", "target", "material")


def merge(primary: DataFrame, secondary: DataFrame, deduplicate: bool = True, keys: tuple[str, ...] = MERGE_KEYS) -> DataFrame:
    """All rows of both, the primary's first; of equal keys (null as empty) only the first row."""
    both = primary.withColumn("part", F.lit(0)).unionByName(secondary.withColumn("part", F.lit(1)), allowMissingColumns=True)
    if not deduplicate:
        return both
    by = Window.partitionBy(*[F.coalesce(k, F.lit("")) for k in keys]).orderBy("part", "ord")
    return both.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def migrate(raw: DataFrame) -> DataFrame:
    """Raw rows as typed edges with provenance: ids that are missing come from the position, old fields stay beside."""
    old = raw.select("ord", F.col("cause_parameter").alias("legacy_cause_parameter"), F.col("effect_on_doping").alias("legacy_effect_on_doping"), F.col("confidence_level").alias("legacy_confidence_level"))
    edges = normalise(raw, legacy=True, unique=False).withColumn("relationship_id", F.coalesce("relationship_id", F.concat(F.lit("migrated_"), "ord")))
    return edges.join(old, "ord")


def pick(edges: DataFrame, material: str = "", source_contains: str = "", evidence: bool = False) -> DataFrame:
    """The first row by a list of wishes that is given up from the end: evidence, then material, then source."""
    m, s = (F.col("material") == material) if material else F.lit(True), F.lower("src").contains(source_contains.lower())
    e = (F.length(F.trim("mechanism")) > 0) if evidence else F.lit(True)
    wish = F.when(m & s & e, 0).when(m & s, 1).when(s, 2).otherwise(3)
    return edges.withColumn("wish", wish).orderBy("wish", "ord").limit(1)


def merge_files(spark: SparkSession, primary: str, secondary: str, out: str, deduplicate: bool = True) -> int:
    """Two graph files as one, with a header; how many relationships it has."""
    parts = [read_raw(spark, p) for p in (primary, secondary)]
    rows = merge(*parts, deduplicate=deduplicate)
    ordered = rows.withColumn("ord", F.col("part") * F.lit(1 << 40) + F.col("ord")).drop("part")
    edges = normalise(ordered, unique=False)
    write_file(edges, out, description="merged")
    return edges.count()


def pick_each_type(edges: DataFrame, most: int = 2, material: str = "", source_contains: str = "") -> DataFrame:
    """The first rows of each type, those that meet the wishes of ``pick`` before others; one of each id."""
    m, s = (F.col("material") == material) if material else F.lit(True), F.lower("src").contains(source_contains.lower())
    wish = F.when(m & s & (F.length(F.trim("mechanism")) > 0), 0).when(m & s, 1).when(s, 2).otherwise(3)
    by = Window.partitionBy("psp_type").orderBy(wish, "ord")
    one = Window.partitionBy("relationship_id").orderBy("ord")
    distinct = edges.withColumn("k", F.when(F.col("relationship_id").isNull(), 1).otherwise(F.row_number().over(one))).where("k = 1").drop("k")
    return distinct.withColumn("n", F.row_number().over(by)).where(F.col("n") <= most)


def migrate_file(spark: SparkSession, path: str, full: str, tiny: str) -> dict[str, DataFrame]:
    """A legacy file as a typed one and a small sample of each type; what they hold by type, material and confidence."""
    edges = last_wins(migrate(read_raw(spark, path)))
    write_file(edges, full, description="migrated")
    write_file(pick_each_type(edges), tiny, description="sample")
    return {c: counts(edges, c) for c in ("psp_type", "material", "confidence")}


def counts(edges: DataFrame, column: str, most: int | None = None) -> DataFrame:
    out = edges.groupBy(column).agg(F.count("*").alias("n"))
    return out if most is None else out.orderBy(F.desc("n"), column).limit(most)


def to_graphml(edges: DataFrame, path: str) -> None:
    """A GraphML file on the driver, row by row: for graphs that a viewer can show."""
    with open(path, "w", encoding="utf-8") as out:
        out.write('<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">\n')
        for r in edges.select(F.explode(F.array("src", "dst")).alias("n")).distinct().toLocalIterator():
            out.write(f"<node id={quoteattr(r.n)}/>\n")
        for r in edges.select("src", "dst").toLocalIterator():
            out.write(f"<edge source={quoteattr(r.src)} target={quoteattr(r.dst)}/>\n")
        out.write("</graph></graphml>\n")
