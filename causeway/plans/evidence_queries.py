"""Evidence, routing and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.functions import lexicons as lx
from causeway.functions import rules
from causeway.functions import text as tx
from causeway.operators import evidence, graph, routing
from causeway.plans import views as v
from causeway.sources import kg, records

QUERIES, ORACLE_SQL = {}, {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def quoted(words):
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def any_sql(text, words):
    return f"(len(list_filter({quoted([w.lower() for w in words])}, lambda x: contains(lower({text}), x))) > 0)"


def hits_sql(text, words):
    return f"len(list_filter({quoted([w.lower() for w in dict.fromkeys(words)])}, lambda x: contains(lower({text}), x)))"


_WALK = v.walks_sql("psp")
_PATHS = f"{_WALK},\npaths AS (SELECT path, array_to_string(path, ' -> ') AS text FROM w WHERE contains(lower(path[1]), 'nation_1') AND contains(lower(last), 'urgent'))"
_STEPS = "pe AS (SELECT path, text, step, path[step + 1] AS src, path[step + 2] AS dst FROM (SELECT *, unnest(range(0, len(path) - 1)) AS step FROM paths))"
_COVERED = f"list_distinct(list_filter(list_transform(path, lambda x: {v.layer_sql('x')}), lambda x: x IS NOT NULL))"


def _paths(spark, sf):
    edges = v.psp_edges(spark, sf)
    return edges, graph.find_psp_paths(edges, ["nation_1"], ["urgent"])


_SCORES = f"""scored AS (
  SELECT pe.path, pe.text, avg(coalesce(e.confidence, 1.0)) AS confidence, avg(CASE WHEN length(trim(e.mechanism)) > 0 THEN 1.0 ELSE 0.0 END) AS richness,
    CAST(len({_COVERED.replace('path,', 'any_value(pe.path),')}) AS DOUBLE) / 3 AS coverage
  FROM pe LEFT JOIN psp e ON e.src = pe.src AND e.dst = pe.dst GROUP BY pe.path, pe.text)"""


@register("rank_paths", v.with_sql(v.PSP, _PATHS, _STEPS, _SCORES, "SELECT text AS path, round(0.35 * confidence + 0.30 * richness + 0.35 * coverage, 6) AS score FROM scored"))
def rank_paths(spark, sf):
    edges, paths = _paths(spark, sf)
    ranked = evidence.rank_paths(paths, edges, lexicon=v.LEXICON)
    return ranked.select(evidence.text_of().alias("path"), F.round("score", 6).alias("score")).orderBy(F.desc("score"), "path")


@register("path_score_details", v.with_sql(v.PSP, _PATHS, _STEPS, _SCORES, "SELECT text AS path, round(confidence, 6) AS confidence, round(richness, 6) AS richness, round(coverage, 6) AS coverage FROM scored"))
def path_score_details(spark, sf):
    edges, paths = _paths(spark, sf)
    return evidence.path_scores(paths, edges, v.LEXICON).select(evidence.text_of().alias("path"), *[F.round(c, 6).alias(c) for c in ("confidence", "richness", "coverage")])


@register("mechanisms", v.with_sql(v.PSP, _PATHS, _STEPS, "SELECT text AS path, step, src, dst, mechanism, affected_property, round(confidence, 6) AS confidence FROM pe JOIN psp USING (src, dst)"))
def mechanisms(spark, sf):
    edges, paths = _paths(spark, sf)
    out = evidence.mechanisms(paths, edges)
    return out.select(evidence.text_of().alias("path"), F.col("step").cast("long").alias("step"), "src", "dst", "mechanism", "affected_property", F.round("confidence", 6).alias("confidence"))


@register("mechanisms_nonblank", v.with_sql(v.PSP, _PATHS, _STEPS, "SELECT text AS path, mechanism FROM pe JOIN psp USING (src, dst) WHERE length(trim(mechanism)) > 0"))
def mechanisms_nonblank(spark, sf):
    edges, paths = _paths(spark, sf)
    return evidence.mechanisms(paths, edges, nonblank=True).select(evidence.text_of().alias("path"), "mechanism")


@register("mechanisms_inverse", v.with_sql(
    v.PSP, "back AS (SELECT dst AS src, src AS dst FROM psp)", v.walks_sql("back"), "paths AS (SELECT path, array_to_string(path, ' -> ') AS text FROM w WHERE contains(lower(path[1]), 'high') AND contains(lower(last), 'nation_2'))", _STEPS,
    "SELECT text AS path, e.mechanism FROM pe JOIN psp e ON e.src = pe.dst AND e.dst = pe.src WHERE length(trim(e.mechanism)) > 0"))
def mechanisms_inverse(spark, sf):
    edges = v.psp_edges(spark, sf)
    paths = graph.find_psp_paths(edges, ["high"], ["nation_2"], reversed_=True)
    return evidence.mechanisms(paths, edges, nonblank=True, flipped=True).select(evidence.text_of().alias("path"), "mechanism")


def _of_layer(name):
    test = f"coalesce({v.layer_sql('x')}, 'Unknown') = '{name}'"
    return f"array_to_string(list_filter(path, lambda x: {test}), ',') AS {name.lower()}"


@register("path_layers", v.with_sql(v.PSP, _PATHS, f"SELECT text AS path, {', '.join(_of_layer(n) for n in [*lx.LAYERS, 'Unknown'])} FROM paths"))
def path_layers(spark, sf):
    _, paths = _paths(spark, sf)
    return evidence.with_layers(paths, v.LEXICON).select(evidence.text_of().alias("path"), *[F.array_join(f"layers.{n}", ",").alias(n.lower()) for n in [*lx.LAYERS, "Unknown"]])


@register("path_layers_by_edges", v.with_sql(
    v.PSP, _PATHS, _STEPS,
    f"SELECT text AS path, len(list_distinct(list_concat({_COVERED.replace('path,', 'any_value(path),')}, list_filter([CASE WHEN bool_or(contains(psp_type, 'Structure')) THEN 'Structure' END, CASE WHEN bool_or(contains(psp_type, 'Property')) THEN 'Property' END], lambda x: x IS NOT NULL)))) AS n_layers FROM pe LEFT JOIN psp USING (src, dst) GROUP BY text"))
def path_layers_by_edges(spark, sf):
    edges, paths = _paths(spark, sf)
    return evidence.with_edge_layers(paths, edges, v.LEXICON).select(evidence.text_of().alias("path"), F.size("covered").cast("long").alias("n_layers"))


_QUESTIONS = [
    (0, "How does CVD temperature change carrier mobility?"), (1, "Predict the optical property"), (2, "grain structure of a layer"), (3, "synthesis and growth"), (4, "Which phase, and why"),
    (5, "nothing in particular"), (6, ""), (7, "time in sentiment"), (8, "grow crystal by process"), (9, "doping"),
]
_Q = v.KG + ",\nq(query_id, question) AS (VALUES " + ", ".join(f"({i}, '{s}')" for i, s in _QUESTIONS) + " UNION ALL SELECT ord, 'How does ' || cause_parameter || ' bear on ' || effect_on_doping || '?' FROM kg WHERE ord >= 1000)"


def _questions(spark, sf):
    """Some by hand, and one of each relationship."""
    made = v.kg_rows(spark, sf).where("ord >= 1000").select("ord", F.concat(F.lit("How does "), "cause_parameter", F.lit(" bear on "), "effect_on_doping", F.lit("?")))
    return spark.createDataFrame(_QUESTIONS, "query_id long, question string").union(made)


_FOUND = "list_filter([" + ", ".join(f"CASE WHEN {any_sql('question', lx.QUESTION_SIGNALS[x])} THEN '{x}' END" for x in lx.LAYERS) + "], lambda x: x IS NOT NULL)"
_FULL = quoted(lx.LAYERS)


@register("required_layers", v.with_sql(
    _Q, f"f AS (SELECT query_id, {_FOUND} AS f FROM q)",
    f"SELECT query_id, array_to_string(list_filter({_FULL}, lambda x: list_contains(CASE WHEN len(f) = 0 THEN {_FULL} WHEN len(f) = 1 THEN list_append(f, 'Structure') ELSE f END, x)), ',') AS layers FROM f"))
def required_layers(spark, sf):
    return _questions(spark, sf).select("query_id", F.array_join(tx.required_layers(F.col("question")), ",").alias("layers"))


_WORDS = "list_concat(" + ", ".join(f"CASE WHEN regexp_matches(question, '(?i)\\b({'|'.join(ws)})\\b') THEN {quoted(ls)} ELSE [] END" for ws, ls in lx.QUESTION_WORDS) + ")"


@register("required_layers_regex", v.with_sql(
    _Q, f"f AS (SELECT query_id, {_WORDS} AS f FROM q)", f"SELECT query_id, array_to_string(list_filter({_FULL}, lambda x: len(f) = 0 OR list_contains(f, x)), ',') AS layers FROM f"))
def required_layers_regex(spark, sf):
    return _questions(spark, sf).select("query_id", F.array_join(tx.required_layers_by_words(F.col("question")), ",").alias("layers"))


_ASKED = [(0, "nation_1", "brand", "Processing,Structure,Property"), (1, "nation_1", "urgent", "Processing,Property"), (2, "brand#1", "high", "Structure,Property"), (3, "zzz", "high", "Processing,Structure")]
_A = "asked(query_id, a, b, required) AS (SELECT q, a, b, string_split(r, ',') FROM (VALUES " + ", ".join(f"({i}, '{a}', '{b}', '{r}')" for i, a, b, r in _ASKED) + ") t(q, a, b, r))"
_COMPLETE = v.with_sql(
    v.PSP, _WALK, _A,
    "hit AS (SELECT query_id, unnest(path) AS node FROM asked JOIN w ON contains(lower(path[1]), a) AND contains(lower(last), b))",
    f"cov AS (SELECT query_id, list(DISTINCT {v.layer_sql('node')}) AS c FROM hit WHERE {v.layer_sql('node')} IS NOT NULL GROUP BY query_id)",
    f"""SELECT query_id, array_to_string(list_filter({_FULL}, lambda x: list_contains(coalesce(c, []), x)), ',') AS covered,
  round(CAST(len(list_filter(required, lambda x: list_contains(coalesce(c, []), x))) AS DOUBLE) / len(required), 6) AS completeness,
  array_to_string(list_filter(required, lambda x: NOT list_contains(coalesce(c, []), x)), ',') AS missing FROM asked LEFT JOIN cov USING (query_id)""",
)


@register("completeness", _COMPLETE)
def completeness(spark, sf):
    edges = v.psp_edges(spark, sf)
    labels = graph.nodes(edges)
    asked = spark.createDataFrame(_ASKED, "query_id int, a string, b string, required string").withColumn("required", F.split("required", ","))
    ends = [graph.keyword_match_join(labels, asked.select("query_id", F.col(c).alias("word"))) for c in "ab"]
    paths = graph.simple_paths(edges, *ends, keys=["query_id"])
    out = evidence.completeness(asked.select("query_id", "required"), paths, v.LEXICON)
    return out.select("query_id", F.array_join("covered", ",").alias("covered"), F.round("completeness", 6).alias("completeness"), F.array_join("missing", ",").alias("missing"))


@register("per_path_completeness", v.with_sql(v.PSP, _PATHS, f"SELECT text AS path, round(CAST(len(list_filter({quoted(['Structure', 'Property'])}, lambda x: list_contains({_COVERED}, x))) AS DOUBLE) / 2, 6) AS completeness FROM paths"))
def per_path_completeness(spark, sf):
    _, paths = _paths(spark, sf)
    out = evidence.per_path_completeness(paths, tx.literals(["Structure", "Property"]), v.LEXICON)
    return out.select(evidence.text_of().alias("path"), F.round("completeness", 6).alias("completeness"))


# text functions over the hand-made rows

def _case(pairs, default):
    return "CASE " + " ".join(f"WHEN {c} THEN {r}" for c, r in pairs) + f" ELSE {default} END"


def relation_sql(text):
    return _case([(any_sql(text, ws), f"'{n}'") for n, ws in lx.RELATION_VERBS], "'affects'")


def type_sql(a, b, lexicon=lx.EDGE_KEYWORDS):
    fp, fs, ts, tp = any_sql(a, lexicon["Processing"]), any_sql(a, lexicon["Structure"]), any_sql(b, lexicon["Structure"]), any_sql(b, lexicon["Property"])
    return _case(
        [(f"{fp} AND {ts}", "'Processing_to_Structure'"), (f"{fs} AND {tp}", "'Structure_to_Property'"), (f"{fp} AND {tp}", "'Processing_to_Property'"), (f"{fs} AND {ts}", "'Structure_to_Structure'"), (f"{fp} AND NOT {ts} AND NOT {tp}", "'Processing_to_Structure'")],
        "'Processing_to_Property'",
    )


def material_sql(text):
    return _case([(f"contains(lower({text}), '{m}')", f"'{m.upper() if len(m) <= 4 else m}'") for m in lx.MATERIALS], "''")


def more_material_sql(text):
    return f"CASE WHEN {material_sql(text)} <> '' THEN {material_sql(text)} ELSE {_case([(f'contains(lower({text}), {chr(39)}{k}{chr(39)})', f'{chr(39)}{x}{chr(39)}') for k, x in lx.MORE_MATERIALS], chr(39) * 2)} END"


def confidence_sql(text):
    return _case([(any_sql(text, ws), f"CAST({x} AS DOUBLE)") for ws, x in lx.CONFIDENCE_WORDS], f"CAST({lx.DEFAULT_CONFIDENCE} AS DOUBLE)")


def layer_of_sql(text, lexicon, order, none):
    s = {x: hits_sql(text, lexicon[x]) for x in lx.LAYERS}
    top = f"greatest({', '.join(s.values())})"
    return f"CASE WHEN {top} = 0 THEN {none} " + " ".join(f"WHEN {s[x]} = {top} THEN '{x}'" for x in order) + " END"


@register("infer_relation", v.with_sql(v.KG, f"SELECT ord, {relation_sql('mechanism_quote')} AS relation FROM kg"))
def infer_relation(spark, sf):
    return v.kg_rows(spark, sf).select("ord", tx.infer_relation(F.col("mechanism_quote")).alias("relation"))


@register("infer_psp_type", v.with_sql(v.KG, f"SELECT ord, {type_sql('cause_parameter', 'effect_on_doping')} AS psp_type FROM kg"))
def infer_psp_type(spark, sf):
    return v.kg_rows(spark, sf).select("ord", tx.infer_psp_type(F.col("cause_parameter"), F.col("effect_on_doping")).alias("psp_type"))


@register("infer_material", v.with_sql(v.KG, f"SELECT ord, {material_sql('source_file')} AS material, {more_material_sql('source_file')} AS extended FROM kg"))
def infer_material(spark, sf):
    return v.kg_rows(spark, sf).select("ord", tx.infer_material(F.col("source_file")).alias("material"), tx.infer_material_extended(F.col("source_file")).alias("extended"))


@register("parse_confidence", v.with_sql(v.KG, f"SELECT ord, {confidence_sql('coalesce(confidence_level, chr(32))')} AS confidence FROM kg"))
def parse_confidence(spark, sf):
    return v.kg_rows(spark, sf).select("ord", tx.parse_confidence(F.col("confidence_level")).alias("confidence"))


_LABELS = "labels_(label) AS (SELECT trim(cause_parameter) FROM kg UNION SELECT trim(effect_on_doping) FROM kg)"


@register("node_layer", v.with_sql(v.KG, _LABELS, f"SELECT label, {layer_of_sql('label', lx.NODE_KEYWORDS, lx.LAYERS, 'NULL')} AS layer FROM labels_"))
def node_layer(spark, sf):
    return _labels(spark, sf).select("label", tx.node_layer(F.col("label")).alias("layer"))


@register("node_layer_alt", v.with_sql(v.KG, _LABELS, f"SELECT label, {layer_of_sql('label', lx.NAME_KEYWORDS, lx.LAYERS[::-1], chr(39) + 'Processing' + chr(39))} AS layer FROM labels_"))
def node_layer_alt(spark, sf):
    return _labels(spark, sf).select("label", tx.name_layer(F.col("label")).alias("layer"))


def _labels(spark, sf):
    raw = v.kg_rows(spark, sf)
    return raw.select(F.trim("cause_parameter").alias("label")).union(raw.select(F.trim("effect_on_doping"))).distinct()


_PLACEHOLDER = "(trim(coalesce({0}, '')) = '' OR contains(lower({0}), 'unknown') OR contains(lower({0}), 'n/a'))"
_VALID = ", ".join(f"'{t}'" for t in lx.EDGE_TYPES)
_ABOUT = "coalesce(CASE WHEN trim(affected_property) <> '' THEN affected_property END, trim(effect_on_doping))"


def _load(legacy):
    kind, rel = type_sql("trim(cause_parameter)", _ABOUT), relation_sql("trim(effect_on_doping)")
    if not legacy:
        kind = f"coalesce(CASE WHEN psp_type IN ({_VALID}) THEN psp_type END, {kind})"
        rel = f"coalesce(CASE WHEN trim(relation) <> '' THEN relation END, {rel})"
    return v.with_sql(
        v.KG,
        f"""fine AS (SELECT *, row_number() OVER (PARTITION BY trim(cause_parameter), trim(effect_on_doping) ORDER BY ord DESC) AS rn FROM kg
  WHERE NOT {_PLACEHOLDER.format('cause_parameter')} AND NOT {_PLACEHOLDER.format('effect_on_doping')})""",
        f"""SELECT trim(cause_parameter) AS src, trim(effect_on_doping) AS dst, {kind} AS psp_type, {rel} AS relation, coalesce(CASE WHEN trim(material) <> '' THEN material END, {more_material_sql("coalesce(source_file, '')")}) AS material,
  coalesce(mechanism_quote, '') AS mechanism, {_ABOUT} AS affected_property, coalesce(confidence, {confidence_sql("coalesce(confidence_level, ' ')")}) AS confidence, ord FROM fine WHERE rn = 1""",
    )


_EDGE = ["src", "dst", "psp_type", "relation", "material", "mechanism", "affected_property", "confidence", "ord"]


@register("load_edges", _load(False))
def load_edges(spark, sf):
    return kg.normalise(v.kg_rows(spark, sf)).select(*_EDGE)


@register("from_legacy", _load(True))
def from_legacy(spark, sf):
    return kg.normalise(v.kg_rows(spark, sf), legacy=True).select(*_EDGE)


@register("graph_file", _load(False).replace("confidence, ord FROM fine", "confidence FROM fine"))
def graph_file(spark, sf):
    """Edges written as one document and read again."""
    path = v.scratch(spark, "graph")
    kg.write_file(kg.normalise(v.kg_rows(spark, sf)), path, version="1")
    return kg.read(spark, path).select(*[c for c in _EDGE if c != "ord"])


@register("graph_records", _load(False))
def graph_records(spark, sf):
    """Edges written as lines and read again in parallel."""
    path = v.scratch(spark, "graph-records")
    kg.write(kg.normalise(v.kg_rows(spark, sf)), path)
    return kg.read_records(spark, path).select(*_EDGE)


_REQUIRED = ", ".join(f"CASE WHEN trim(coalesce({c}, '')) = '' THEN '{n}' END" for c, n in (("cause_parameter", "source"), ("relation", "relation"), ("effect_on_doping", "target"), ("psp_type", "psp_type")))


@register("validate_edges", v.with_sql(
    v.KG, f"m AS (SELECT *, list_filter([{_REQUIRED}], lambda x: x IS NOT NULL) AS missing_ FROM kg)",
    f"SELECT ord, array_to_string(missing_, ',') AS missing, CAST(len(missing_) AS INTEGER) AS n_errors, coalesce(psp_type NOT IN ({', '.join(repr(t) for t in lx.VALID_EDGE_TYPES)}), false) AS bad_type, coalesce(confidence NOT BETWEEN 0 AND 1, false) AS bad_confidence FROM m"))
def validate_edges(spark, sf):
    return kg.problems(v.kg_rows(spark, sf).withColumnsRenamed({"cause_parameter": "source", "effect_on_doping": "target"}))


@register("merge_edges", v.with_sql(
    v.KG, "parts AS (SELECT 0 AS part, * FROM kg WHERE ord % 3 < 2 UNION ALL SELECT 1, * FROM kg WHERE ord % 3 > 0)",
    "SELECT ord, part, cause_parameter FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(cause_parameter, ''), coalesce(relation, ''), coalesce(effect_on_doping, ''), coalesce(material, '') ORDER BY part, ord) AS rn FROM parts) WHERE rn = 1"))
def merge_edges(spark, sf):
    raw = v.kg_rows(spark, sf)
    return kg.merge(raw.where("ord % 3 < 2"), raw.where("ord % 3 > 0"), keys=("cause_parameter", "relation", "effect_on_doping", "material")).select("ord", "part", "cause_parameter")


@register("migrate_edges", v.with_sql(
    v.KG, f"SELECT ord, 'migrated_' || ord AS relationship_id, cause_parameter AS legacy_cause_parameter FROM kg WHERE NOT {_PLACEHOLDER.format('cause_parameter')} AND NOT {_PLACEHOLDER.format('effect_on_doping')}"))
def migrate_edges(spark, sf):
    return kg.migrate(v.kg_rows(spark, sf)).select("ord", "relationship_id", "legacy_cause_parameter")


@register("pick_relaxed", v.with_sql(
    v.KG, f"fine AS (SELECT * FROM kg WHERE NOT {_PLACEHOLDER.format('cause_parameter')} AND NOT {_PLACEHOLDER.format('effect_on_doping')})",
    "SELECT ord FROM (SELECT ord, row_number() OVER (ORDER BY CASE WHEN material = 'WTe2' AND contains(lower(cause_parameter), 'grain') AND length(trim(mechanism_quote)) > 0 THEN 0 WHEN material = 'WTe2' AND contains(lower(cause_parameter), 'grain') THEN 1 WHEN contains(lower(cause_parameter), 'grain') THEN 2 ELSE 3 END, ord) AS rn FROM fine) WHERE rn = 1"))
def pick_relaxed(spark, sf):
    return kg.pick(kg.normalise(v.kg_rows(spark, sf), unique=False), "WTe2", "grain", True).select("ord")


@register("edge_driven_layer", v.with_sql(
    v.PSP, v.nodes_sql("psp"),
    """SELECT label, CASE WHEN EXISTS (SELECT 1 FROM psp WHERE dst = label AND psp_type = 'Processing_to_Structure') THEN 'Structure'
  WHEN EXISTS (SELECT 1 FROM psp WHERE src = label AND psp_type IN ('Processing_to_Structure', 'Processing_to_Property')) THEN 'Processing'
  WHEN EXISTS (SELECT 1 FROM psp WHERE dst = label AND psp_type = 'Structure_to_Property') THEN 'Property' ELSE 'Structure' END AS layer FROM nodes"""))
def edge_driven_layer(spark, sf):
    edges = v.psp_edges(spark, sf)
    ends = edges.select(F.inline(F.array(F.struct(F.col("src").alias("label"), F.lit("s").alias("side"), "psp_type"), F.struct(F.col("dst").alias("label"), F.lit("d").alias("side"), "psp_type"))))
    is_ = lambda side, *kinds: F.max((F.col("side") == side) & F.col("psp_type").isin(*kinds))
    flags = ends.groupBy("label").agg(
        is_("s", "Processing_to_Structure", "Processing_to_Property").alias("p"), is_("d", "Processing_to_Structure").alias("s"), is_("d", "Structure_to_Property").alias("r")
    )
    return flags.select("label", tx.edge_driven_layer(F.col("p"), F.col("s"), F.col("r"), F.col("label")).alias("layer"))


_UNITS = [(0, 373.15, "K", "atm", "h"), (1, 212.0, " f ", "kpa", "MIN"), (2, 20.0, "Celsius", "KPA", "us"), (3, 1.5, "degC", "TORR", "hours"), (4, 2.0, "x", "mmhg", "fortnight"), (5, None, "K", "Pa", "s")]
_T, _P, _S = ["C", "kelvin", "F ", "degC", "R", None, "fahrenheit"], [*lx.PRESSURE_UNITS, "PASCAL", "inHg", None], [*lx.TIME_UNITS, "Hours", "week"]
_U = "u(id, x, t, p, s) AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {'NULL' if x is None else f'{x}::DOUBLE'}, '{t}', '{p}', '{s}')" for i, x, t, p, s in _UNITS) + f") UNION ALL SELECT 100 + p_partkey, p_retailprice, {v.picked_sql(_T, 'p_partkey')}, {v.picked_sql(_P, 'p_partkey')}, {v.picked_sql(_S, 'p_partkey')} FROM part)"
_PA = "CASE " + " ".join(f"WHEN trim(p) = '{k}' THEN {f}" for k, f in lx.PRESSURE_UNITS.items()) + " " + " ".join(f"WHEN lower(trim(p)) = '{k.lower()}' THEN {f}" for k, f in lx.PRESSURE_UNITS.items()) + " END"
_SEC = "CASE " + " ".join(f"WHEN lower(trim(s)) = '{k}' THEN {f}" for k, f in lx.TIME_UNITS.items()) + " END"


@register("normalize_units", v.with_sql(
    _U, f"""SELECT id, round(CASE WHEN upper(trim(t)) IN ('C', 'CELSIUS', 'DEGC') THEN CAST(x AS DOUBLE) WHEN upper(trim(t)) IN ('K', 'KELVIN') THEN CAST(x AS DOUBLE) - 273.15 WHEN upper(trim(t)) IN ('F', 'FAHRENHEIT') THEN (CAST(x AS DOUBLE) - 32) * 5 / 9 END, 6) AS celsius,
  round(CAST(x AS DOUBLE) * {_PA}, 6) AS pascal, round(CAST(x AS DOUBLE) * {_SEC}, 9) AS seconds FROM u"""))
def normalize_units(spark, sf):
    key = F.col("p_partkey")
    made = v.table(spark, sf, "part").select(key + 100, "p_retailprice", v.picked(_T, key), v.picked(_P, key), v.picked(_S, key))
    rows = spark.createDataFrame(_UNITS, "id long, x double, t string, p string, s string").union(made)
    return rows.select("id", F.round(rules.celsius(F.col("x"), F.col("t")), 6).alias("celsius"), F.round(rules.pascal(F.col("x"), F.col("p")), 6).alias("pascal"), F.round(rules.seconds(F.col("x"), F.col("s")), 9).alias("seconds"))


_CONDITIONS = [
    (0, "MoS2", 750.0, "SiO2", "Ar", "Nb", "MoO3"), (1, "MoS2", 100.0, "glass", "N2", "Nb", "MoCl5"), (2, "other", 2000.0, "glass", "N2", "N", "MoO3"), (3, "graphene", 1500.0, "sapphire", "H2", "Zz", "WCl6"),
    (4, "hBN", None, "", "", "", ""), (5, "BP", 400.0, None, None, None, "S"), (6, "WS2", 900.0, "glass", "vacuum", "Fe", "Xx"), (7, "WTe2", 851.0, "mica", "H2/Ar", "Ta", "S"),
]
_LISTS = {
    "material": [*lx.MATERIAL_RANGES, "other", None], "substrate": [*lx.SUBSTRATE_LIMITS, "", None, "steel"], "atmosphere": [*lx.ATMOSPHERE_DOPANTS, None], "dopant": ["Nb", "Re", "Fe", "N", "Zz", None, "W"],
    "precursor": [*lx.PRECURSOR_SUBSTRATES, "Xx", None],
}
_C = "c(id, material, temperature_c, substrate, atmosphere, dopant, precursor) AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"{x}::DOUBLE" if isinstance(x, float) else v._literal(x) for x in r) + ")" for r in _CONDITIONS) + ") UNION ALL SELECT 100 + p_partkey, " + ", ".join(
    ("CASE WHEN p_size % 9 > 0 THEN p_retailprice - 700 END, " if k == "substrate" else "") + v.picked_sql(own, f"p_partkey * {i + 1} + p_size") for i, (k, own) in enumerate(_LISTS.items())) + " FROM part)"


def _conditions(spark, sf):
    """Some by hand, and one of each part."""
    key, n = F.col("p_partkey"), F.col("p_size")
    of = {k: v.picked(own, key * (i + 1) + n) for i, (k, own) in enumerate(_LISTS.items())}
    made = v.table(spark, sf, "part").select(key + 100, of["material"], F.when(n % 9 > 0, F.col("p_retailprice") - 700), of["substrate"], of["atmosphere"], of["dopant"], of["precursor"])
    return spark.createDataFrame(_CONDITIONS, "id long, material string, temperature_c double, substrate string, atmosphere string, dopant string, precursor string").union(made)


_RANGE = "CASE " + " ".join(f"WHEN material = '{k}' THEN t BETWEEN {a} AND {b}" for k, (a, b) in lx.MATERIAL_RANGES.items()) + " ELSE true END"
_LIMIT = "CASE " + " ".join(f"WHEN substrate = '{k}' THEN t <= {x}" for k, x in lx.SUBSTRATE_LIMITS.items()) + " ELSE true END"
_DOPANT = "CASE " + " ".join(f"WHEN atmosphere = '{a}' AND dopant = '{d}' THEN {str(ok).lower()}" for a, own in lx.ATMOSPHERE_DOPANTS.items() for d, ok in own.items()) + " ELSE true END"
_PRECURSOR = "CASE WHEN coalesce(substrate, '') = '' THEN true " + " ".join(f"WHEN precursor = '{k}' THEN substrate IN ({', '.join(repr(s) for s in own)})" for k, own in lx.PRECURSOR_SUBSTRATES.items()) + " ELSE true END"


@register("constraints", v.with_sql(
    _C, f"k AS (SELECT id, a, b, d, p FROM (SELECT id, {_RANGE} AS a, {_LIMIT} AS b, {_DOPANT} AS d, {_PRECURSOR} AS p FROM (SELECT *, coalesce(temperature_c, 0) AS t FROM c)))",
    "SELECT id, a AS temperature_in_range, b AS substrate_temperature_ok, d AS atmosphere_dopant_compatible, p AS precursor_substrate_compatible, a AND b AND d AND p AS overall_valid FROM k"))
def constraints(spark, sf):
    rows = _conditions(spark, sf)
    return rules.validate_conditions(rows).select("id", "temperature_in_range", "substrate_temperature_ok", "atmosphere_dopant_compatible", "precursor_substrate_compatible", "overall_valid")


@register("thermal_stability", v.with_sql(_C, f"SELECT id, {_RANGE.replace(' t ', ' coalesce(temperature_c, 0) ')} AS stable, CASE " + " ".join(f"WHEN precursor = '{k}' THEN coalesce(substrate IN ({', '.join(repr(s) for s in own)}), true)" for k, own in lx.PRECURSOR_SUBSTRATES.items()) + " ELSE true END AS compatible FROM c"))
def thermal_stability(spark, sf):
    rows = _conditions(spark, sf)
    return rows.select("id", rules.thermally_stable(F.col("material"), F.coalesce("temperature_c", F.lit(0.0))).alias("stable"), rules.composition_compatible(F.col("precursor"), F.col("substrate")).alias("compatible"))


_FENCE = "chr(96) || chr(96) || chr(96)"
_SAYS = f"""x AS (SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN 'Sure: ' || {_FENCE} || 'json' || chr(10) || props || chr(10) || {_FENCE} || ' done' WHEN 1 THEN 'text ' || {_FENCE} || ' ' || props || ' ' || {_FENCE} || ' more'
  WHEN 2 THEN 'plain ' || props || ' tail' WHEN 3 THEN 'nothing here' WHEN 4 THEN {_FENCE} || 'json' || chr(10) || '{{broken' || chr(10) || {_FENCE} WHEN 5 THEN {_FENCE} || 'json {{x' || {_FENCE} || ' but ' || props END AS t FROM events)"""


def _first_json(*found):
    return "coalesce(" + ", ".join(f"CASE WHEN {f} <> '' AND json_valid({f}) THEN {f} END" for f in found) + ")"


@register("extract_json", v.with_sql(_SAYS, "SELECT id, " + _first_json(*[f"regexp_extract(t, '{p}', 1)" for p in (r"(?s)```json\s*(.*?)\s*```", r"(?s)```\s*(.*?)\s*```", r"(?s)(\{.*\})")]) + " AS found FROM x"))
def extract_json(spark, sf):
    """The JSON of answers of six shapes made of the events' properties."""
    events, fence = v.table(spark, sf, "events").where("event_id is not null"), F.lit("`" * 3)
    shape, props, nl = F.col("event_id") % 6, F.col("props"), F.lit("\n")
    text = (
        F.when(shape == 0, F.concat(F.lit("Sure: "), fence, F.lit("json\n"), props, nl, fence, F.lit(" done"))).when(shape == 1, F.concat(F.lit("text "), fence, F.lit(" "), props, F.lit(" "), fence, F.lit(" more")))
        .when(shape == 2, F.concat(F.lit("plain "), props, F.lit(" tail"))).when(shape == 3, F.lit("nothing here")).when(shape == 4, F.concat(fence, F.lit("json\n{broken\n"), fence))
        .otherwise(F.concat(fence, F.lit("json {x"), fence, F.lit(" but "), props))
    )
    return events.select(F.col("event_id").alias("id"), tx.extract_json(text).alias("found"))


_PARAMS = "['brand=' || p_brand, ' type = ' || p_type || ' ', 'size=', 'brand = a=b', CASE WHEN p_size % 2 = 0 THEN 'x=y=' || p_size ELSE 'type=last' END]"


@register("kv_pairs", f"""WITH p AS (SELECT p_partkey AS id, unnest({_PARAMS}) AS p, unnest(range(5)) AS n FROM part), k AS (SELECT id, n, trim(split_part(p, '=', 1)) AS key, trim(substr(p, strpos(p, '=') + 1)) AS value FROM p)
SELECT id, key, value FROM (SELECT *, row_number() OVER (PARTITION BY id, key ORDER BY n DESC) AS rn FROM k) WHERE rn = 1""")
def kv_pairs(spark, sf):
    """Parameters of each part; of repeated keys the last counts."""
    pairs = F.array(
        F.concat(F.lit("brand="), "p_brand"), F.concat(F.lit(" type = "), "p_type", F.lit(" ")), F.lit("size="), F.lit("brand = a=b"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("x=y="), F.col("p_size").cast("string"))).otherwise("type=last")
    )
    return v.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.explode(tx.parse_pairs(pairs)).alias("key", "value"))


_WORDLIST = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda x: x <> ''))"


@register("entailment_overlap", v.with_sql(v.PAPERS, f"t AS (SELECT ord, {_WORDLIST.format('title')} AS c, {_WORDLIST.format('substr(abstract, length(title) + 1)')} AS e FROM pap)", "SELECT ord, CAST(len(list_intersect(c, e)) AS DOUBLE) / greatest(len(c), 1) > 0.4 AS entailed FROM t"))
def entailment_overlap(spark, sf):
    """Whether the rest of a paper has the words of its title."""
    rest = F.expr("substr(abstract, length(title) + 1)")
    return v.papers(spark, sf).select("ord", tx.overlap_entails(F.col("title"), rest).alias("entailed"))


@register("atomic_claims", v.with_sql(
    v.PAPERS, "s AS (SELECT ord, unnest(string_split(regexp_replace(abstract, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM pap)",
    "c AS (SELECT ord, trim(unnest(regexp_split_to_array(s, ',\\s*(?:which|that|and)\\s+'))) AS claim FROM s)", "SELECT ord, count(*) AS n_claims, CAST(sum(length(claim)) AS BIGINT) AS n_chars FROM c WHERE length(claim) > 10 GROUP BY ord"))
def atomic_claims(spark, sf):
    claims = v.papers(spark, sf).select("ord", F.explode(tx.atomic_claims(F.col("abstract"))).alias("claim"))
    return claims.groupBy("ord").agg(F.count("*").alias("n_claims"), F.sum(F.length("claim")).alias("n_chars"))


@register("key_terms", v.with_sql(v.PAPERS, f"SELECT ord, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(abstract), '[a-z][a-z0-9_-]{{2,}}')), lambda x: NOT list_contains({quoted(tx.STOPWORDS)}, x))), ',') AS terms FROM pap"))
def key_terms(spark, sf):
    return v.papers(spark, sf).select("ord", F.array_join(tx.key_terms(F.col("abstract")), ",").alias("terms"))


_STEP = f"split_part(p_name, ' ', 1) || ' ' || {v.picked_sql([*lx.CAUSAL_VERBS, 'meets'], 'p_partkey')} || '  ' || split_part(p_name, ' ', 2) || ', and ' || p_type || ' ' || {v.picked_sql([*lx.CAUSAL_VERBS, 'leaves'], 'p_size')} || ' ' || p_brand"
_EDGE_PATTERN = r"(\w+)\s+(" + "|".join(lx.CAUSAL_VERBS) + r")\s+(\w+)"


@register("causal_edges", f"WITH s AS (SELECT p_partkey AS id, {_STEP} AS s FROM part) SELECT id, " + ", ".join(f"unnest(regexp_extract_all(s, '{_EDGE_PATTERN}', {i})) AS {n}" for i, n in enumerate(("source", "verb", "target"), 1)) + " FROM s")
def causal_edges(spark, sf):
    """The edges of a step made of each part's words."""
    key, n, word = F.col("p_partkey"), F.col("p_size"), lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    step = F.concat(word(1), F.lit(" "), v.picked([*lx.CAUSAL_VERBS, "meets"], key), F.lit("  "), word(2), F.lit(", and "), "p_type", F.lit(" "), v.picked([*lx.CAUSAL_VERBS, "leaves"], n), F.lit(" "), "p_brand")
    return v.table(spark, sf, "part").select(key.alias("id"), F.inline(tx.causal_edges(step)))


@register("search_queries", v.with_sql(
    v.PSP, _PATHS, "p3 AS (SELECT text, row_number() OVER (ORDER BY text) AS rn FROM paths)",
    "SELECT q FROM (SELECT 'experimental validation ' || replace(replace(text, ' -> ', ' '), '_', ' ') AS q FROM p3 WHERE rn <= 3 UNION ALL SELECT 'mechanism ' || replace(replace(text, ' -> ', ' '), '_', ' ') || ' materials science' FROM p3 WHERE rn <= 3 UNION ALL SELECT 'quantitative data MoS2 CVD experimental' UNION ALL SELECT 'recent advances MoS2 CVD')"))
def search_queries(spark, sf):
    _, paths = _paths(spark, sf)
    texts = paths.orderBy(evidence.text_of()).limit(3).agg(F.array_sort(F.collect_list(evidence.text_of())).alias("ps"))
    return texts.select(F.explode(tx.search_queries(tx.literals(["MoS2", "CVD"]), F.col("ps"), F.lit("forward"))).alias("q"))


# routing

_R = [(0, {"a": "NATION_3"}), (1, {"a": "zzzz"}), (2, {"a": "", "b": None}), (3, {"m": "Brand#1", "x": "nation_2"})]
_RSQL = "rq(query_id, word) AS (VALUES (0, 'NATION_3'), (1, 'zzzz'), (3, 'Brand#1'), (3, 'nation_2'))"
_RTEXT = "rt(query_id, said) AS (VALUES (0, 'NATION_3'), (1, 'zzzz'), (2, ''), (3, 'Brand#1 and nation_2'))"
_VEC = "[CAST(length({0}) AS DOUBLE), CAST(coalesce(ascii(right({0}, 1)), 0) AS DOUBLE), CAST(coalesce(ascii({0}), 0) AS DOUBLE)]"


def _route_sql(direction, body):
    walked = "psp" if direction == "forward" else "back"
    far, near = ("src", "dst") if direction == "forward" else ("dst", "src")
    return v.with_sql(
        v.PSP, "back AS (SELECT dst AS src, src AS dst FROM psp)", v.nodes_sql("psp"), v.walks_sql(walked), _RSQL, _RTEXT,
        f"far AS (SELECT label AS word FROM nodes WHERE label NOT IN (SELECT {far} FROM psp))",
        "ends AS (SELECT DISTINCT label FROM nodes JOIN far ON contains(lower(label), lower(word)))",
        "starts AS (SELECT DISTINCT query_id, label FROM nodes JOIN rq ON contains(lower(label), lower(word)))",
        "one AS (SELECT query_id, text, row_number() OVER (PARTITION BY query_id ORDER BY hops, text) AS rn FROM (SELECT query_id, hops, array_to_string(path, ' -> ') AS text FROM starts JOIN w ON path[1] = label WHERE last IN (SELECT label FROM ends)))",
        "open_q AS (SELECT * FROM rt WHERE query_id NOT IN (SELECT query_id FROM one))",
        f"""near AS (SELECT query_id, label, score FROM (SELECT query_id, label, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS rn FROM (
    SELECT query_id, label, round(list_cosine_similarity({_VEC.format('said')}, {_VEC.format('label')}), 6) AS score FROM open_q, nodes WHERE label NOT IN (SELECT {near} FROM psp))) WHERE rn = 1 AND score > 0.9 AND NOT isnan(score))""",
        "two AS (SELECT query_id, text, row_number() OVER (PARTITION BY query_id ORDER BY hops, text) AS rn FROM (SELECT query_id, hops, array_to_string(path, ' -> ') AS text FROM near JOIN w ON path[1] = label WHERE last IN (SELECT label FROM ends)))",
        """decided AS (SELECT rt.query_id, CASE WHEN o.query_id IS NOT NULL THEN 1 WHEN t.query_id IS NOT NULL THEN 2 ELSE 3 END AS tier, CASE WHEN t.query_id IS NOT NULL THEN near.label END AS similar_node, coalesce(CASE WHEN t.query_id IS NOT NULL THEN near.score END, 0.0) AS similarity, coalesce(o.ps, t.ps, []) AS paths
  FROM rt LEFT JOIN (SELECT query_id, list(text ORDER BY rn) AS ps FROM one WHERE rn <= 10 GROUP BY query_id) o USING (query_id) LEFT JOIN (SELECT query_id, list(text ORDER BY rn) AS ps FROM two WHERE rn <= 10 GROUP BY query_id) t USING (query_id) LEFT JOIN near USING (query_id))""",
        body,
    )


def _route(spark, sf, direction):
    edges = v.psp_edges(spark, sf)
    questions = spark.createDataFrame(_R, "query_id int, params map<string,string>")
    said = routing.question_text(questions).select("query_id", v.label_vector(F.col("text")).alias("qvec"))
    vecs = graph.nodes(edges).select("label", v.label_vector(F.col("label")).alias("vec"))
    return edges, questions, routing.route(questions, edges, vecs, said, direction, threshold=0.9)


_DECIDED = "SELECT query_id, tier, similar_node, similarity, array_to_string(paths, '; ') AS paths FROM decided"


@register("route_forward", _route_sql("forward", _DECIDED))
def route_forward(spark, sf):
    return _route(spark, sf, "forward")[2].withColumn("paths", routing.paths_text("paths", "; "))


@register("route_inverse", _route_sql("inverse", _DECIDED))
def route_inverse(spark, sf):
    return _route(spark, sf, "inverse")[2].withColumn("paths", routing.paths_text("paths", "; "))


@register("tier_distribution", _route_sql("forward", "SELECT 'forward' AS direction, tier, count(*) AS n, round(CAST(count(*) AS DOUBLE) / 4, 6) AS share FROM decided GROUP BY tier"))
def tier_distribution(spark, sf):
    from causeway.operators.evaluation import tier_distribution as distribution

    return distribution(_route(spark, sf, "forward")[2].withColumn("direction", F.lit("forward"))).withColumn("share", F.round("share", 6))


@register("kg_sources", _route_sql(
    "forward", """SELECT query_id, md5(kind || '|' || content) AS source_id, kind, content, confidence FROM (
  SELECT DISTINCT query_id, 'node' AS kind, unnest(string_split(p, ' -> ')) AS content, CAST(1.0 AS DOUBLE) AS confidence FROM (SELECT query_id, unnest(paths[1:5]) AS p FROM decided)
  UNION SELECT DISTINCT query_id, 'edge', mechanism, CAST(0.95 AS DOUBLE) FROM (SELECT query_id, p[i] AS src, p[i + 1] AS dst FROM (SELECT query_id, p, unnest(range(1, len(p))) AS i FROM (SELECT query_id, string_split(unnest(paths[1:5]), ' -> ') AS p FROM decided))) JOIN psp USING (src, dst) WHERE length(trim(mechanism)) > 0)"""))
def kg_sources(spark, sf):
    edges, _, decided = _route(spark, sf, "forward")
    return routing.kg_sources(decided, edges)


@register("cot_confidence", _route_sql("forward", "SELECT query_id, step_id, name, confidence FROM decided, LATERAL (SELECT 1 AS step_id, 'graph evidence' AS name, CASE WHEN len(paths) > 0 THEN CAST(1.0 AS DOUBLE) ELSE 0.0 END AS confidence UNION ALL SELECT 2, 'literature', CASE WHEN query_id = 0 THEN CAST(0.8 AS DOUBLE) ELSE 0.3 END UNION ALL SELECT 3, 'synthesis', CAST(0.5 AS DOUBLE))"))
def cot_confidence(spark, sf):
    papers = spark.createDataFrame([(0,), (0,)], "query_id int")
    return routing.cot_steps(_route(spark, sf, "forward")[2], papers)


@register("naive_paths", v.with_sql(
    v.PSP, v.nodes_sql("psp"), _WALK, _RTEXT, _RSQL,
    "p AS (SELECT DISTINCT query_id, array_to_string(path, ' -> ') AS text FROM rq JOIN w ON contains(lower(path[1]), lower(word)) WHERE contains(lower(last), 'medium') OR contains(lower(last), 'high'))",
    "SELECT query_id, count(text) AS n_paths, coalesce(string_agg(text, chr(10) ORDER BY text), '') AS context FROM rt LEFT JOIN p USING (query_id) GROUP BY query_id"))
def naive_paths(spark, sf):
    questions = spark.createDataFrame(_R, "query_id int, params map<string,string>")
    found = routing.naive(questions, v.psp_edges(spark, sf), properties=["medium", "high"])
    return found.select("query_id", F.size("paths").cast("long").alias("n_paths"), routing.paths_text().alias("context"))


@register("naive_inverse", v.with_sql(
    v.PSP, _WALK, "iq(query_id, word) AS (VALUES (0, 'urgent'), (1, 'brand#2'))",
    "a AS (SELECT DISTINCT query_id, 0 AS part, path FROM iq JOIN w ON contains(lower(path[1]), word) WHERE contains(lower(last), 'nation_1') OR contains(lower(last), 'high') UNION ALL SELECT DISTINCT query_id, 1, path FROM iq JOIN w ON contains(lower(last), word) WHERE contains(lower(path[1]), 'nation_1') OR contains(lower(path[1]), 'high'))",
    "SELECT query_id, CAST(part AS INTEGER) AS part, array_to_string(path, ' -> ') AS path FROM a"))
def naive_inverse(spark, sf):
    """Both ways between the questions' words and condition words, repeats kept."""
    questions = spark.createDataFrame([(0, {"p": "urgent"}), (1, {"p": "Brand#2"}), (2, {"p": "zzz"})], "query_id int, params map<string,string>")
    return routing.naive_paths(questions, v.psp_edges(spark, sf), "inverse", conditions=["nation_1", "high"]).select("query_id", "part", evidence.text_of().alias("path"))


_MECHANISMS = """ms AS (
  SELECT query_id, string_agg(mechanism, chr(10) ORDER BY n, step) AS said FROM (
    SELECT query_id, n, step, src, dst FROM (SELECT query_id, n, p[i] AS src, p[i + 1] AS dst, i AS step FROM (SELECT query_id, n, p, unnest(range(1, len(p))) AS i FROM (SELECT query_id, n, string_split(paths[n], ' -> ') AS p FROM (SELECT query_id, paths, unnest(range(1, len(paths) + 1)) AS n FROM decided)))))
  JOIN psp USING (src, dst) WHERE length(trim(mechanism)) > 0 GROUP BY query_id)"""
_SAID = "sd(query_id, said) AS (VALUES (0, 'a=NATION_3'), (1, 'a=zzzz'), (2, 'a=, b='), (3, 'm=Brand#1, x=nation_2'))"


def _prompt_sql(direction):
    quote = lambda t: "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '").replace("%s", "' || {} || '") + "'"
    texts = {k: quote(routing.TEMPLATES[direction, k]) for k in (1, 2, 3)}
    one = texts[1].format("s.said", "array_to_string(paths, chr(10))", "coalesce(ms.said, '')")
    two = texts[2].format("s.said", "similar_node", "similarity", "paths[1]", "coalesce(ms.said, '')") if direction == "forward" else "''"
    three = texts[3].format("s.said")
    return f"CASE tier WHEN 1 THEN {one} WHEN 2 THEN {two} ELSE {three} END AS prompt, {three} AS fallback"


_PROMPTS = _route_sql("forward", "@").replace("\n@", f",\n{_MECHANISMS},\n{_SAID},\npr AS (SELECT d.query_id, d.tier, {_prompt_sql('forward')}, d.paths FROM decided d JOIN sd s USING (query_id) LEFT JOIN ms USING (query_id))\n@")


@register("prompts", _PROMPTS.replace("@", "SELECT query_id, tier, prompt, fallback FROM pr"))
def prompts(spark, sf):
    edges, questions, decided = _route(spark, sf, "forward")
    return routing.prompts(questions, decided, routing.mechanisms_of(decided, edges))


class Fussy:
    """Answers in JSON with a fence around; has nothing to say to prompts with evidence but for those of NATION_3, and to
    empty parameters fails altogether."""

    def __call__(self, prompts):
        out = []
        for p in prompts:
            if "a=, b=" in p:
                raise RuntimeError("down")
            fine = "NATION_3" in p or "Causal paths" not in p and "Closest" not in p
            out.append('Sure: ```json\n{"confidence": 0.75, "reasoning": "because"}\n```' if fine else "I would rather not say")
        return out


@register("responses", _PROMPTS.replace(
    "@", """SELECT query_id, CASE WHEN query_id = 2 OR contains(prompt, 'NATION_3') THEN tier ELSE 3 END AS tier, CASE WHEN query_id = 2 THEN 0.0::DOUBLE ELSE 0.75::DOUBLE END AS confidence,
  CASE WHEN query_id = 2 THEN 'error' WHEN contains(prompt, 'NATION_3') THEN 'tier_' || tier ELSE 'tier_3' END AS reasoning_type, CAST(len(paths) AS INTEGER) AS kg_paths_used, array_to_string(paths, '; ') AS paths,
  CASE WHEN query_id <> 2 THEN '{"confidence": 0.75, "reasoning": "because"}' END AS response, query_id <> 2 AND NOT contains(prompt, 'NATION_3') AND tier < 3 AS demoted FROM pr"""))
def responses(spark, sf):
    """Answers by a backend that fails at times: demoted to tier 3, or error rows."""
    edges, questions, decided = _route(spark, sf, "forward")
    prompted = routing.prompts(questions, decided, routing.mechanisms_of(decided, edges))
    out = routing.results(routing.respond(prompted, Fussy(), 2, routing.at_once), decided)
    return out.drop("latency_ms").withColumn("paths", routing.paths_text("paths", "; "))


@register("task_file", """WITH t AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS line FROM part)
SELECT coalesce(CASE WHEN p_partkey % 5 > 0 THEN 'part-' || p_partkey END, 'task_' || (line + 1)) AS id, CASE WHEN p_size % 2 = 0 THEN 'forward' ELSE 'inverse' END AS task, p_type AS target_property FROM t WHERE p_partkey % 7 > 1""")
def task_file(spark, sf):
    """Parts as a file of tasks with blank and broken lines, read again."""
    key, path = F.col("p_partkey"), v.scratch(spark, "tasks")
    line = F.to_json(F.struct(F.when(key % 5 > 0, F.concat(F.lit("part-"), key.cast("string"))).alias("id"), F.when(F.col("p_size") % 2 == 0, "forward").otherwise("inverse").alias("task"), F.col("p_type").alias("target_property")))
    lines = v.table(spark, sf, "part").select(key.alias("k"), F.when(key % 7 == 0, "").when(key % 7 == 1, '{"id": broken').otherwise(line).alias("value"))
    lines.coalesce(1).sortWithinPartitions("k").select("value").write.text(path)
    return records.read_tasks(spark, path).select("id", "task", "target_property")


@register("result_file", v.with_sql(v.METHODS, "SELECT method, score FROM mt"))
def result_file(spark, sf):
    """Results as one document with a list in it, read again."""
    path = v.scratch(spark, "results")
    rows = v.methods(spark, sf).agg(F.to_json(F.struct(F.collect_list(F.struct("method", "score")).alias("results"))).alias("value"))  # one row a nation
    rows.write.text(path)
    return records.read_results(spark, path, "method string, score double").select("method", "score")


@register("confidence_counts", v.with_sql(v.KG, "SELECT confidence, count(*) AS n FROM kg GROUP BY confidence"))
def confidence_counts(spark, sf):
    return kg.counts(v.kg_rows(spark, sf), "confidence")


@register("pick_each_type", v.with_sql(
    v.KG, f"fine AS (SELECT *, row_number() OVER (PARTITION BY coalesce(CASE WHEN psp_type IN ({_VALID}) THEN psp_type END, {type_sql('trim(cause_parameter)', _ABOUT)}) ORDER BY CASE WHEN length(trim(coalesce(mechanism_quote, ''))) > 0 THEN 0 ELSE 1 END, ord) AS rn FROM kg WHERE NOT {_PLACEHOLDER.format('cause_parameter')} AND NOT {_PLACEHOLDER.format('effect_on_doping')})",
    "SELECT ord FROM fine WHERE rn <= 2"))
def pick_each_type(spark, sf):
    """The first two rows of each type, those with evidence before others."""
    return kg.pick_each_type(kg.normalise(v.kg_rows(spark, sf), unique=False)).select("ord")
