"""Graphs, vectors, tasks and papers derived from the tables: as DataFrames, and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.operators.storage import kept, scratch  # noqa: F401 - scratch is for the queries

#: Words by which the layers of the derived graphs are told.
LEXICON = {"Processing": ["nation"], "Structure": ["brand"], "Property": ["urgent", "high", "medium", "low", "specified"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def psp_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supply graph: nation to brand to order priority, and nation to priority as a shortcut. Confidence is the share
    of returned lines.

    One scan of the lines; the three groupings are one aggregation over grouping sets."""
    t = lambda n: table(spark, sf_dir, n)
    lines = (
        t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("r"))
        .join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
        .join(t("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("n")), "s_nationkey")
        .join(t("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("b")), "l_partkey")
        .join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("o")), "l_orderkey")
    )
    n, b, o = F.col("n"), F.col("b"), F.col("o")
    sums = lines.groupingSets([[n, b], [b, o], [n, o]], n, b, o).agg(F.count("*").alias("c"), F.sum("r").alias("k"))
    kind = F.when(o.isNull(), "Processing_to_Structure").when(n.isNull(), "Structure_to_Property").otherwise("Processing_to_Property")
    edges = sums.select(
        F.when(n.isNull(), b).otherwise(n).alias("src"), F.when(o.isNull(), b).otherwise(o).alias("dst"), kind.alias("psp_type"), (F.col("k") / F.col("c")).alias("confidence"),
        F.when(F.col("c") % 2 == 0, F.concat(F.lit("returned share of "), F.col("c"))).otherwise("").alias("mechanism"),
    )
    out = edges.withColumn("affected_property", F.col("dst")).withColumn("material", F.lit("supply"))
    return kept(out)  # a graph is walked many times; it is built once


PSP = """
psp_raw AS (
  SELECT n_name AS n, p_brand AS b, o_orderpriority AS o, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS r
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
psp_all AS (
  SELECT n AS src, b AS dst, 'Processing_to_Structure' AS psp_type, count(*) AS c, sum(r) AS k FROM psp_raw GROUP BY n, b
  UNION ALL SELECT b, o, 'Structure_to_Property', count(*), sum(r) FROM psp_raw GROUP BY b, o
  UNION ALL SELECT n, o, 'Processing_to_Property', count(*), sum(r) FROM psp_raw GROUP BY n, o),
psp AS (
  SELECT src, dst, psp_type, CAST(k AS DOUBLE) / c AS confidence, CASE WHEN c % 2 = 0 THEN 'returned share of ' || c ELSE '' END AS mechanism, dst AS affected_property, 'supply' AS material FROM psp_all)
"""


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transition graph of users' states, cyclic: each state and the next ones, with their number."""
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    state = F.concat("event_type", F.lit("_"), F.col("event_id") % 4)
    moves = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", state.alias("src")).withColumn("dst", F.lead("src").over(by_user))
    counts = moves.where("dst is not null and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    return kept(counts)


EVENTS = """
ev_moves AS (
  SELECT src, lead(src) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst
  FROM (SELECT user_id, ts, event_id, event_type || '_' || (event_id % 4) AS src FROM events)),
ev AS (SELECT src, dst, count(*) AS n FROM ev_moves WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst)
"""


def session_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event to its user's next one: a chain a user, as deep as a user has events, and as large as the table."""
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    name = lambda c: F.concat(F.lit("e"), c.cast("string"))
    moves = table(spark, sf_dir, "events").select(name(F.col("event_id")).alias("src"), name(F.lead("event_id").over(by_user)).alias("dst"))
    return kept(moves.where("dst is not null"))


SESSIONS = """
se_at AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS many FROM events),
se AS (SELECT 'e' || a.event_id AS src, 'e' || b.event_id AS dst FROM se_at a JOIN se_at b ON a.user_id = b.user_id AND b.n = a.n + 1)
"""


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part to supplier to customer, by the lines of orders: hubs in the middle, and as large as the tables. Repeats stay."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    ends = F.array(F.struct(name("part ", "l_partkey").alias("src"), name("supplier ", "l_suppkey").alias("dst")), F.struct(name("supplier ", "l_suppkey").alias("src"), name("customer ", "o_custkey").alias("dst")))
    return kept(lines.select(F.inline(ends)))


TRADE = """
tr_lines AS (SELECT DISTINCT 'part ' || l_partkey AS p, 'supplier ' || l_suppkey AS s, 'customer ' || o_custkey AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
tr_ps AS (SELECT DISTINCT p, s FROM tr_lines), tr_sc AS (SELECT DISTINCT s, c FROM tr_lines)
"""


def cooccur_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide and shallow: part type to brand to the first word of the part's name."""
    parts = table(spark, sf_dir, "part").select("p_type", "p_brand", F.substring_index("p_name", " ", 1).alias("word"))
    return kept(parts.select(F.inline(F.array(F.struct(F.col("p_type").alias("src"), F.col("p_brand").alias("dst")), F.struct(F.col("p_brand").alias("src"), F.col("word").alias("dst"))))).distinct())


COOCCUR = """
co AS (SELECT DISTINCT p_type AS src, p_brand AS dst FROM part UNION SELECT DISTINCT p_brand, split_part(p_name, ' ', 1) FROM part)
"""

_NAMES = ["ord", "cause_parameter", "effect_on_doping", "affected_property", "mechanism_quote", "source_file", "confidence_level", "confidence", "psp_type", "relation", "material"]
#: Hand-made rows: placeholders, nulls, repeats, a self-loop, a cycle of two, labels with wildcards, keyword ties.
ROWS = [
    (0, "CVD temperature 700C", "grain size", "grain", "heat increases grain size", "run_MoS2_a.pdf", "high", 0.9, "Processing_to_Structure", "increases", "MoS2"),
    (1, "grain size", "carrier mobility", "mobility", "fewer boundaries", "run_MoS2_a.pdf", "moderate", 0.8, "Structure_to_Property", "increases", "MoS2"),
    (2, "CVD temperature 700C", "defect density", "defect", "", "run_ws2.pdf", "low", None, "Processing_to_Structure", "decreases", "WS2"),
    (3, "defect density", "carrier mobility", "mobility", "scattering reduces mobility", "run_ws2.pdf", "experimentally verified", 0.7, "Structure_to_Property", "decreases", "WS2"),
    (4, "unknown", "carrier mobility", "mobility", "no cause", "x.pdf", "high", 0.9, None, None, None),
    (5, "annealing time", "N/A", "phase", "no effect", "x.pdf", "high", 0.9, None, None, None),
    (6, "  ", "phase", "phase", "blank cause", "x.pdf", None, 0.5, None, None, None),
    (7, "annealing time", "phase stability", None, "long anneals", "graphene_run.pdf", None, None, None, None, None),
    (8, "phase stability", "conductivity", "conductivity", "   ", "graphene_run.pdf", "theoretical", None, "Structure_to_Property", "affects", None),
    (9, "grain size", "carrier mobility", "hall mobility", "newer evidence", "run_MoSe2.pdf", "proven", 0.95, "Structure_to_Property", "improves", "MoSe2"),
    (10, "doping concentration", "doping_level", "doping_level", "dopants enter", "hbn_doc.pdf", "strong", 0.85, "Processing_to_Structure", "increases", "hBN"),
    (11, "doping_level", "on/off ratio", "on/off", "leads to switching", "hbn_doc.pdf", "weak", 0.5, "Structure_to_Property", "induces", "hBN"),
    (12, "doping concentration", "conductivity", "conductivity", "direct", "hbn_doc.pdf", "medium", 0.7, "Processing_to_Property", "increases", "hBN"),
    (13, "strain", "strain", "strain", "self", "silicene.pdf", "low", 0.4, "Structure_to_Structure", "affects", "silicene"),
    (14, "layer count", "band_gap", "band_gap", "confinement", "cri3_x.pdf", "predicted", None, "Structure_to_Property", "decreases", None),
    (15, "band_gap", "layer count", "layer", "feedback", "cri3_x.pdf", "low", 0.3, "Bad_type", "affects", None),
    (16, "flux 100%", "layer_count_2", "layer", "wild % and _ marks", "bp_file.pdf", "high", 1.2, "Processing_to_Structure", "increases", "BP"),
    (17, "flux 100_", "layer count", "layer", "another mark", "bp_file.pdf", "high", 0.6, "Processing_to_Structure", "inhibits", "BP"),
    (18, "substrate", "crystallinity", "crystallinity", "sapphire promotes order", "wte2.pdf", "high", 0.85, "Processing_to_Structure", None, "WTe2"),
    (19, "crystallinity", "photoluminescence", "emission", "order enhances emission", "wte2.pdf", "high", 0.8, "Structure_to_Property", "enhances", "WTe2"),
    (20, "substrate", "crystallinity", "crystallinity", "repeat, later wins", "wte2.pdf", "low", 0.55, "Processing_to_Structure", "affects", "WTe2"),
    (21, "pressure", "thermal drift", "thermal", "prevents drift", "li_intercalated.pdf", "moderate", None, None, None, None),
    (22, "vacuum level", "surface", "surface", "causes cleaning", "other.pdf", "moderate", 0.65, None, None, None),
    (23, "n/a value", "surface", "surface", "placeholder", "other.pdf", "moderate", 0.65, None, None, None),
]
_SCHEMA = "ord long, cause_parameter string, effect_on_doping string, affected_property string, mechanism_quote string, source_file string, confidence_level string, confidence double, psp_type string, relation string, material string"


def kg_raw(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROWS, _SCHEMA)


def _literal(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def picked(values: list, key: Column) -> Column:
    """One of ``values`` by a number."""
    kind = "double" if any(isinstance(v, float) for v in values) else "string"
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (key % len(values) + 1).cast("int"))


def picked_sql(values: list, key: str) -> str:
    return "[" + ", ".join(_literal(v) for v in values) + f"][CAST(({key}) % {len(values)} + 1 AS BIGINT)]"


CAUSES = [
    "CVD temperature", "growth pressure", "annealing time", "doping concentration", "grain boundary", "crystal phase", "layer strain", "vacancy defect", "substrate choice", "Unknown", "laser power", "  N/A ", "carrier gas", "rate of flow",
]
EFFECTS = ["grain size", "carrier mobility", "defect density", "band_gap shift", "hall voltage", "layer thickness", "thermal drift", "n/a", "optical absorption", "phase stability", "on/off ratio", "surface", "crystal orientation"]
MECHANISMS = ["heat increases order", "reduces traps", "", "  ", "leads to switching", "prevents drift", "no verb", "improves and lowers", None, "blocks diffusion", "raises emission"]
FILES = ["run_MoS2_{}.pdf", "WS2-{}.pdf", "graphene {}.txt", "boron_nitride_{}.pdf", "cri3_{}.pdf", "other_{}.pdf", "lithium_{}", "wte2-mote2-{}"]
LEVELS = ["high", "moderate", "low", "experimentally verified", "predicted", "weak but proven", "strong", None, "medium-high"]
TYPES = ["Processing_to_Structure", "Structure_to_Property", "Bad_type", None, "Processing_to_Property", "", "Processing_to_Processing"]
RELATIONS = ["increases", None, "affects", " ", "inhibits"]
NAMED = ["MoS2", None, "", "hBN", "WS2", None]
CONFIDENCES = [0.9, None, 0.55, 1.2, -0.1, 0.7, None]


def kg_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw relationships: the hand-made rows, and one of each part and each of several keys of it."""
    key, n = F.col("p_partkey"), F.col("p_size")
    of = lambda values, k: picked(values, k)
    name = lambda c: F.when(c.rlike("(?i)unknown|n/a"), c).otherwise(F.concat(c, F.lit(" "), F.col("p_brand")))
    made = table(spark, sf_dir, "part").select(
        (F.lit(1000) + key).cast("long").alias("ord"), name(of(CAUSES, key)).alias("cause_parameter"), name(of(EFFECTS, key * 7 + n)).alias("effect_on_doping"), of([*EFFECTS, None], key * 3 + n).alias("affected_property"),
        of(MECHANISMS, key + n).alias("mechanism_quote"), F.replace(of(FILES, key * 5 + n), F.lit("{}"), F.col("p_type")).alias("source_file"), of(LEVELS, key).alias("confidence_level"), of(CONFIDENCES, key + n).alias("confidence"),
        of(TYPES, key * 2 + n).alias("psp_type"), of(RELATIONS, key).alias("relation"), of(NAMED, key + n).alias("material"),
    )
    return kg_raw(spark).union(made)


def _named_sql(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '(?i)unknown|n/a') THEN {c} ELSE {c} || ' ' || p_brand END"


_MADE = (
    f"SELECT 1000 + p_partkey, {_named_sql(picked_sql(CAUSES, 'p_partkey'))}, {_named_sql(picked_sql(EFFECTS, 'p_partkey * 7 + p_size'))}, {picked_sql([*EFFECTS, None], 'p_partkey * 3 + p_size')}, {picked_sql(MECHANISMS, 'p_partkey + p_size')}, "
    f"replace({picked_sql(FILES, 'p_partkey * 5 + p_size')}, '{{}}', p_type), {picked_sql(LEVELS, 'p_partkey')}, CAST({picked_sql(CONFIDENCES, 'p_partkey + p_size')} AS DOUBLE), {picked_sql(TYPES, 'p_partkey * 2 + p_size')}, "
    f"{picked_sql(RELATIONS, 'p_partkey')}, {picked_sql(NAMED, 'p_partkey + p_size')} FROM part"
)
KG = "kg(" + ", ".join(_NAMES) + ") AS (SELECT CAST(c0 AS BIGINT), c1, c2, c3, c4, c5, c6, CAST(c7 AS DOUBLE), c8, c9, c10 FROM (VALUES " + ", ".join(
    "(" + ", ".join(_literal(v) for v in row) + ")" for row in ROWS
) + f") AS t(c0, c1, c2, c3, c4, c5, c6, c7, c8, c9, c10) UNION ALL {_MADE})"


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as methods of a comparison: category, a score and a latency that a fifth lacks."""
    supplied = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.round(F.avg("s_acctbal"), 3).alias("score"), F.max("s_acctbal").alias("top"))
    rows = table(spark, sf_dir, "nation").join(supplied, "n_nationkey", "left")
    return rows.select(F.col("n_name").alias("method"), picked(["llm", "kg", "full"], F.col("n_regionkey")).alias("category"), "score", F.when(F.col("n_nationkey") % 5 != 0, F.col("top")).alias("latency"))


METHODS = f"mt AS (SELECT n_name AS method, {picked_sql(['llm', 'kg', 'full'], 'n_regionkey')} AS category, score, CASE WHEN n_nationkey % 5 <> 0 THEN top END AS latency FROM nation LEFT JOIN (SELECT s_nationkey AS n_nationkey, round(avg(s_acctbal), 3) AS score, max(s_acctbal) AS top FROM supplier GROUP BY s_nationkey) USING (n_nationkey))"


def vec_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("label"), F.col("embedding").alias("vec"))


def task_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as results: task, model, mode, score."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("mode"), F.col("o_totalprice").alias("score"))


RESULTS = "res AS (SELECT o_orderkey AS task_id, o_orderpriority AS model, o_orderstatus AS mode, o_totalprice AS score FROM orders)"


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as literature; the first line is the title, the whole text the abstract."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.substring_index("text", "\n", 1).alias("title"), F.col("n_chars").alias("citations"), "source", F.col("text").alias("abstract"))


PAPERS = "pap AS (SELECT doc_id AS ord, split_part(text, chr(10), 1) AS title, n_chars AS citations, source, text AS abstract FROM documents)"


def label_vector(label: Column) -> Column:
    """A small vector of a label that any engine computes alike."""
    return F.array(F.length(label).cast("double"), F.ascii(F.right(label, F.lit(1))).cast("double"), F.ascii(label).cast("double"))


def layer_sql(label: str) -> str:
    tests = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({label}), '{w}')" for w in words) + f" THEN '{layer}'" for layer, words in LEXICON.items()
    )
    return f"CASE {tests} END"


def nodes_sql(edges: str) -> str:
    return f"nodes AS (SELECT src AS label FROM {edges} UNION SELECT dst FROM {edges})"


def walks_sql(edges: str, hops: int = 4, name: str = "w") -> str:
    """All simple paths of up to ``hops`` edges; needs WITH RECURSIVE."""
    return f"""steps AS (SELECT DISTINCT src, dst FROM {edges} WHERE src <> dst),
{name}(path, last, hops) AS (
  SELECT [src, dst], dst, 1 FROM steps
  UNION ALL
  SELECT list_append(path, s.dst), s.dst, hops + 1 FROM {name} JOIN steps s ON s.src = {name}.last WHERE hops < {hops} AND NOT list_contains(path, s.dst))"""


def closure_sql(edges: str) -> str:
    return f"reach(src, dst) AS (SELECT src, dst FROM {edges} UNION SELECT r.src, e.dst FROM reach r JOIN {edges} e ON e.src = r.dst)"


def with_sql(*parts: str) -> str:
    """A query of common table expressions and a body, the last part."""
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in parts[:-1]) + "\n" + parts[-1]
