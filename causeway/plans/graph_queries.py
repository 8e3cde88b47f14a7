"""Graph queries over the derived graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.operators import components, graph, reach
from causeway.operators.evidence import text_of
from causeway.plans import views as v

QUERIES, ORACLE_SQL = {}, {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


_TEXT = "array_to_string(path, ' -> ') AS path"


@register("keyword_match", v.with_sql(v.PSP, v.nodes_sql("psp"), "SELECT label FROM nodes WHERE contains(lower(label), 'nation_1') OR contains(lower(label), 'high')"))
def keyword_match(spark, sf):
    return graph.keyword_match(graph.nodes(v.psp_edges(spark, sf)), ["NATION_1", "high"])


@register("keyword_match_cooccur", v.with_sql(v.COOCCUR, v.nodes_sql("co"), "SELECT label FROM nodes WHERE contains(lower(label), 'brand#1') OR contains(lower(label), 'e')"))
def keyword_match_cooccur(spark, sf):
    return graph.keyword_match(graph.nodes(v.cooccur_edges(spark, sf)), ["brand#1", "", "E"], skip_empty=True)


@register("root_nodes", v.with_sql(v.PSP, v.nodes_sql("psp"), "SELECT label FROM nodes WHERE label NOT IN (SELECT dst FROM psp)"))
def root_nodes(spark, sf):
    return graph.roots(v.psp_edges(spark, sf))


@register("leaf_nodes", v.with_sql(v.PSP, v.nodes_sql("psp"), "SELECT label FROM nodes WHERE label NOT IN (SELECT src FROM psp)"))
def leaf_nodes(spark, sf):
    return graph.leaves(v.psp_edges(spark, sf))


@register("intermediate_nodes", v.with_sql(v.PSP, "SELECT DISTINCT src AS label FROM psp WHERE src IN (SELECT dst FROM psp)"))
def intermediate_nodes(spark, sf):
    return graph.intermediates(v.psp_edges(spark, sf))


_DEGREES = "deg AS (SELECT label, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out, count(*) AS degree FROM (SELECT src AS label, 0 AS i, 1 AS o FROM {0} UNION ALL SELECT dst, 1, 0 FROM {0}) GROUP BY label)"


@register("degree_stats", v.with_sql(v.EVENTS, _DEGREES.format("ev"), "SELECT * FROM deg"))
def degree_stats(spark, sf):
    return graph.degrees(v.event_edges(spark, sf))


@register("graph_density", v.with_sql(v.PSP, v.nodes_sql("psp"), "SELECT n AS n_nodes, m AS n_edges, round(CAST(m AS DOUBLE) / (n * (n - 1)), 9) AS density FROM (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM psp) AS m)"))
def graph_density(spark, sf):
    return graph.density(v.psp_edges(spark, sf))


_WALK = v.walks_sql("psp")
_ENDS = "contains(lower(path[1]), 'nation_1') AND contains(lower(last), 'urgent')"


@register("paths_forward", v.with_sql(v.PSP, _WALK, f"SELECT {_TEXT} FROM w WHERE {_ENDS}"))
def paths_forward(spark, sf):
    return graph.find_psp_paths(v.psp_edges(spark, sf), ["nation_1"], ["urgent"]).select(text_of().alias("path"))


@register("paths_reverse", v.with_sql(v.PSP, "back AS (SELECT dst AS src, src AS dst FROM psp)", v.walks_sql("back"), f"SELECT {_TEXT} FROM w WHERE contains(lower(path[1]), 'urgent') AND contains(lower(last), 'nation_1')"))
def paths_reverse(spark, sf):
    return graph.find_psp_paths(v.psp_edges(spark, sf), ["urgent"], ["nation_1"], reversed_=True).select(text_of().alias("path"))


@register("paths_limited", v.with_sql(v.PSP, _WALK, f"SELECT {_TEXT} FROM w WHERE {_ENDS} ORDER BY hops, array_to_string(path, ' -> ') LIMIT 10"))
def paths_limited(spark, sf):
    return graph.find_psp_paths(v.psp_edges(spark, sf), ["nation_1"], ["urgent"], most=10).select(text_of().alias("path"))


@register("paths_cyclic", v.with_sql(v.EVENTS, v.walks_sql("ev", 3), f"SELECT {_TEXT} FROM w"))
def paths_cyclic(spark, sf):
    """All simple paths of up to three hops between any two states."""
    edges = v.event_edges(spark, sf)
    labels = graph.nodes(edges)
    return graph.simple_paths(edges, labels, labels, 3).select(text_of().alias("path"))


@register("paths_recursive", v.with_sql(v.EVENTS, v.walks_sql("ev", 3), f"SELECT {_TEXT} FROM w"))
def paths_recursive(spark, sf):
    return graph.paths_recursive(v.event_edges(spark, sf), 3).select(text_of().alias("path"))


_FOR_QUERY = v.with_sql(
    v.PSP, v.nodes_sql("psp"), _WALK,
    "words AS (SELECT DISTINCT unnest(string_split(label, ' ')) AS word FROM nodes WHERE label NOT IN (SELECT src FROM psp))",
    f"SELECT {_TEXT} FROM w WHERE contains(lower(path[1]), 'nation_2') AND EXISTS (SELECT 1 FROM words WHERE contains(lower(last), lower(word)))",
)


@register("paths_for_query", _FOR_QUERY)
def paths_for_query(spark, sf):
    return graph.paths_for_query(v.psp_edges(spark, sf), ["nation_2"]).select(text_of().alias("path"))


@register("reachability", v.with_sql(v.EVENTS, v.closure_sql("ev"), "SELECT src, dst FROM reach"))
def reachability(spark, sf):
    return graph.closure(v.event_edges(spark, sf))


@register("wcc_count", v.with_sql(v.COOCCUR, "both_ways AS (SELECT src, dst FROM co UNION SELECT dst, src FROM co)", v.closure_sql("both_ways"), "SELECT count(DISTINCT c) AS n_components FROM (SELECT src, min(dst) AS c FROM reach GROUP BY src)"))
def wcc_count(spark, sf):
    return graph.weak_components(v.cooccur_edges(spark, sf)).agg(F.count_distinct("component").alias("n_components"))


@register("scc_count", v.with_sql(v.EVENTS, v.nodes_sql("ev"), v.closure_sql("ev"), "SELECT count(DISTINCT c) AS n_components FROM (SELECT label, least(label, coalesce((SELECT min(a.dst) FROM reach a JOIN reach b ON a.dst = b.src AND a.src = b.dst WHERE a.src = label), label)) AS c FROM nodes)"))
def scc_count(spark, sf):
    return graph.strong_components(v.event_edges(spark, sf)).agg(F.count_distinct("component").alias("n_components"))


def _dag(view):
    return v.with_sql(v.PSP, v.EVENTS, v.closure_sql(view), "SELECT count(*) = 0 AS is_dag FROM reach WHERE src = dst")


@register("is_dag", _dag("psp"))
def is_dag(spark, sf):
    return graph.is_dag(v.psp_edges(spark, sf))


@register("is_dag_cyclic", _dag("ev"))
def is_dag_cyclic(spark, sf):
    return graph.is_dag(v.event_edges(spark, sf))


@register("longest_path", v.with_sql(v.PSP, _WALK, "SELECT CAST(max(len(path)) AS BIGINT) AS longest_path FROM w"))
def longest_path(spark, sf):
    return graph.longest_path(v.psp_edges(spark, sf))


_CHAINS = "FROM psp a JOIN psp b ON a.dst = b.src AND a.psp_type = 'Processing_to_Structure' AND b.psp_type = 'Structure_to_Property'"


@register("complete_chains", v.with_sql(v.PSP, f"SELECT a.src AS processing, a.dst AS structure, b.dst AS property {_CHAINS}"))
def complete_chains(spark, sf):
    return graph.complete_chains(v.psp_edges(spark, sf))


@register("shortcuts", v.with_sql(v.PSP, "SELECT src, dst, round(confidence, 6) AS confidence FROM psp WHERE psp_type = 'Processing_to_Property'"))
def shortcuts(spark, sf):
    return graph.shortcuts(v.psp_edges(spark, sf)).select("src", "dst", F.round("confidence", 6).alias("confidence"))


@register("top_degree", v.with_sql(v.PSP, _DEGREES.format("psp"), "SELECT * FROM deg ORDER BY degree DESC, label LIMIT 10"))
def top_degree(spark, sf):
    return graph.top_nodes(v.psp_edges(spark, sf))


@register("induced_subgraph", v.with_sql(v.PSP, _DEGREES.format("psp"), "top AS (SELECT label FROM deg ORDER BY degree DESC, label LIMIT 20)", "SELECT src, dst FROM psp WHERE src IN (SELECT label FROM top) AND dst IN (SELECT label FROM top)"))
def induced_subgraph(spark, sf):
    edges = v.psp_edges(spark, sf)
    return graph.induced(edges, graph.top_nodes(edges, 20)).select("src", "dst")


@register("neighbours", v.with_sql(v.PSP, "SELECT DISTINCT dst AS label, 'out' AS side FROM psp WHERE src = 'Brand#1' UNION SELECT DISTINCT src, 'in' FROM psp WHERE dst = 'Brand#1'"))
def neighbours(spark, sf):
    return graph.neighbours(v.psp_edges(spark, sf), "Brand#1")


@register("edges_through", v.with_sql(v.PSP, "SELECT label, side, psp_type, count(*) AS n FROM (SELECT src AS label, 'out' AS side, psp_type FROM psp UNION ALL SELECT dst, 'in', psp_type FROM psp) GROUP BY ALL"))
def edges_through(spark, sf):
    return graph.edges_through(v.psp_edges(spark, sf))


_KEPT = "CAST(CAST(('0x' || substr(md5(src || '|' || dst), 1, 8)) AS BIGINT) % 100 AS INTEGER)"
_DELETION = "\nUNION ALL ".join(f"SELECT {p} AS percent, (SELECT count(*) FROM psp WHERE {_KEPT} >= {p}) AS n_edges, (SELECT count(*) FROM psp a JOIN psp b ON a.dst = b.src WHERE {_KEPT.replace('src', 'a.src').replace('dst', 'a.dst')} >= {p} AND {_KEPT.replace('src', 'b.src').replace('dst', 'b.dst')} >= {p}) AS n_two_hop" for p in (0, 30, 60, 90))


@register("edge_deletion", v.with_sql(v.PSP, _DELETION))
def edge_deletion(spark, sf):
    edges = v.psp_edges(spark, sf)
    parts = []
    for p in (0, 30, 60, 90):
        left = graph.without_share(edges, p)
        two = left.select("src", F.col("dst").alias("via")).join(left.select(F.col("src").alias("via"), "dst"), "via")
        parts.append(left.agg(F.count("*").alias("n_edges")).join(two.agg(F.count("*").alias("n_two_hop"))).select(F.lit(p).alias("percent"), "n_edges", "n_two_hop"))
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@register("cycles", v.with_sql(v.EVENTS, v.walks_sql("ev", 3), "SELECT array_to_string(list_append(path, path[1]), ' -> ') AS path FROM w JOIN steps s ON s.src = last AND s.dst = path[1] WHERE path[1] = list_min(path)"))
def cycles(spark, sf):
    return graph.cycles(v.event_edges(spark, sf), 4).select(text_of().alias("path"))


def _stats_sql(view, *more):
    """Everything worked out: acyclicity and strong components from reachability, the longest path from walks."""
    return v.with_sql(
        *more, v.nodes_sql(view), _DEGREES.format(view), v.walks_sql(view), v.closure_sql(view), f"both_ways AS (SELECT src, dst FROM {view} UNION SELECT dst, src FROM {view})", v.closure_sql("both_ways").replace("reach", "near"),
        "mutual AS (SELECT a.src, min(a.dst) AS least FROM reach a JOIN reach b ON a.dst = b.src AND a.src = b.dst GROUP BY a.src)",
        f"""SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT round(avg(degree), 9) FROM deg) AS avg_degree, (SELECT max(n_in) FROM deg) AS max_in, (SELECT max(n_out) FROM deg) AS max_out,
  (SELECT count(*) FROM deg WHERE n_in = 0) AS n_roots, (SELECT count(*) FROM deg WHERE n_out = 0) AS n_leaves, (SELECT count(*) FROM deg WHERE n_in > 0 AND n_out > 0) AS n_intermediate,
  (SELECT count(*) FROM {view}) AS n_edges, (SELECT round(CAST((SELECT count(*) FROM {view}) AS DOUBLE) / (count(*) * (count(*) - 1)), 9) FROM nodes) AS density,
  (SELECT count(*) = 0 FROM reach WHERE src = dst) AS is_dag, (SELECT count(DISTINCT c) FROM (SELECT src, min(dst) AS c FROM near GROUP BY src)) AS n_weak,
  (SELECT count(DISTINCT least(label, coalesce(least, label))) FROM nodes LEFT JOIN mutual ON label = src) AS n_strong,
  CASE WHEN (SELECT count(*) = 0 FROM reach WHERE src = dst) THEN (SELECT CAST(max(len(path)) AS BIGINT) FROM w) ELSE 0 END AS longest_path""",
    )


@register("graph_stats", _stats_sql("psp", v.PSP))
def graph_stats(spark, sf):
    return graph.stats(v.psp_edges(spark, sf))


#: Three cycles joined by one-way edges, tails at both ends, and two nodes that only meet each other's ends.
_RINGS = "rings AS (SELECT DISTINCT 'r' || (n_regionkey) || '_' || (n_nationkey // 5) AS src, 'r' || n_regionkey || '_' || ((n_nationkey // 5 + 1) % 5) AS dst FROM nation UNION SELECT DISTINCT 'r' || r_regionkey || '_0', 'r' || (r_regionkey + 1) || '_0' FROM region WHERE r_regionkey < 3 UNION SELECT r_name, 'r0_0' FROM region)"


def _rings(spark, sf):
    nation, region = v.table(spark, sf, "nation"), v.table(spark, sf, "region")
    name = lambda a, b: F.concat(F.lit("r"), a.cast("string"), F.lit("_"), b.cast("string"))
    key, k = F.col("n_regionkey"), F.col("r_regionkey")
    ring = nation.select(name(key, F.expr("n_nationkey div 5")).alias("src"), name(key, F.expr("(n_nationkey div 5 + 1) % 5")).alias("dst"))
    bridge = region.where("r_regionkey < 3").select(name(k, F.lit(0)), name(k + 1, F.lit(0)))
    return ring.union(bridge).union(region.select("r_name", F.lit("r0_0"))).distinct()


@register("graph_stats_cyclic", _stats_sql("rings", _RINGS).replace(v.walks_sql("rings"), v.walks_sql("rings", 1)))
def graph_stats_cyclic(spark, sf):
    """A graph with cycles, bridges between them and tails: components differ from nodes and from one."""
    return graph.stats(_rings(spark, sf))


@register("scc_members", v.with_sql(_RINGS, v.nodes_sql("rings"), v.closure_sql("rings"), "SELECT label, least(label, coalesce((SELECT min(a.dst) FROM reach a JOIN reach b ON a.dst = b.src AND a.src = b.dst WHERE a.src = label), label)) AS component FROM nodes"))
def scc_members(spark, sf):
    return graph.strong_components(_rings(spark, sf))


@register("active_nodes", v.with_sql(v.PSP, "shown AS (SELECT * FROM psp WHERE confidence >= 0.32)", _DEGREES.format("shown"), f"SELECT label, {v.layer_sql('label')} AS layer, degree FROM deg WHERE {v.layer_sql('label')} IN ('Processing', 'Structure')"))
def active_nodes(spark, sf):
    return graph.active(graph.filtered(v.psp_edges(spark, sf), least_confidence=0.32), ["Processing", "Structure"], v.LEXICON)


@register("node_samples", v.with_sql(
    v.PSP, v.nodes_sql("psp"), "sides AS (SELECT 'root' AS side, label FROM nodes WHERE label NOT IN (SELECT dst FROM psp) UNION ALL SELECT 'leaf', label FROM nodes WHERE label NOT IN (SELECT src FROM psp) UNION ALL SELECT 'between', label FROM nodes WHERE label IN (SELECT src FROM psp) AND label IN (SELECT dst FROM psp))",
    "SELECT side, label FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY label) AS rn FROM sides) WHERE rn <= 10"))
def node_samples(spark, sf):
    """Ten of each side: what the report shows."""
    return graph.samples(v.psp_edges(spark, sf))


@register("edge_filter", v.with_sql(v.PSP, "SELECT src, dst, round(confidence, 6) AS confidence FROM psp WHERE confidence >= 0.35 AND material = 'supply' AND psp_type IN ('Processing_to_Structure', 'Structure_to_Property')"))
def edge_filter(spark, sf):
    return graph.filtered(v.psp_edges(spark, sf), "supply", ["Processing_to_Structure", "Structure_to_Property"], 0.35).select("src", "dst", F.round("confidence", 6).alias("confidence"))


_CLAIMS = [(0, "nation_1", "urgent"), (1, "urgent", "nation_1"), (2, "brand", "brand"), (3, "zzz", "urgent")]
_CLAIMS_SQL = "claims(claim_id, source, target) AS (VALUES " + ", ".join(f"({i}, '{a}', '{b}')" for i, a, b in _CLAIMS) + ")"


@register("claim_reachability", v.with_sql(
    v.PSP, v.nodes_sql("psp"), v.closure_sql("psp"), _CLAIMS_SQL,
    "SELECT claim_id, source, target, EXISTS (SELECT 1 FROM nodes a, nodes b WHERE contains(lower(a.label), source) AND contains(lower(b.label), target) AND (a.label = b.label OR EXISTS (SELECT 1 FROM reach WHERE src = a.label AND dst = b.label))) AS verified FROM claims"))
def claim_reachability(spark, sf):
    return graph.reachable_pairs(v.psp_edges(spark, sf), spark.createDataFrame(_CLAIMS, "claim_id int, source string, target string"))


@register("session_levels", v.with_sql(v.SESSIONS, "SELECT 'e' || event_id AS label, n - 1 AS level FROM se_at WHERE many > 1"))
def session_levels(spark, sf):
    """How many events of its user come before each: the levels of deep chains."""
    return components.levels(v.session_edges(spark, sf))


@register("session_components", v.with_sql(v.SESSIONS, "SELECT 'e' || event_id AS label, min('e' || event_id) OVER (PARTITION BY user_id) AS component FROM se_at WHERE many > 1"))
def session_components(spark, sf):
    return components.weak_components(v.session_edges(spark, sf))


#: Back along a chain, where the last edge of each closes a ring: one strong component a user.
@register("session_rings", v.with_sql(v.SESSIONS, "SELECT 'e' || event_id AS label, min('e' || event_id) OVER (PARTITION BY user_id) AS component FROM se_at WHERE many > 1"))
def session_rings(spark, sf):
    """Sessions whose last event leads to the first again: rings as long as a user has events."""
    edges = v.session_edges(spark, sf)
    user = components.weak_components(edges)
    ends = graph.leaves(edges).join(user, "label").select(F.col("label").alias("src"), "component")
    firsts = graph.roots(edges).join(user, "label").select(F.col("label").alias("dst"), "component")
    return components.strong_components(edges.unionByName(ends.join(firsts, "component").select("src", "dst")))


@register("session_reach", v.with_sql(
    v.SESSIONS, "asked AS (SELECT a.event_id AS a, b.event_id AS b FROM se_at a JOIN se_at b ON a.user_id = b.user_id AND b.n = a.n + 3 UNION SELECT b.event_id, a.event_id FROM se_at a JOIN se_at b ON a.user_id = b.user_id AND b.n = a.n + 3 UNION SELECT event_id, event_id + 7 FROM events)",
    "SELECT 'e' || a AS a, 'e' || b AS b, coalesce(x.user_id = y.user_id AND x.n < y.n, false) AS reaches FROM asked JOIN se_at x ON x.event_id = a LEFT JOIN se_at y ON y.event_id = b"))
def session_reach(spark, sf):
    """Whether an event comes before another: three pairs an event, forth, back and to a neighbour in the table."""
    by_user = F.lead("event_id", 3).over(v.Window.partitionBy("user_id").orderBy("ts", "event_id"))
    name = lambda c: F.concat(F.lit("e"), F.col(c).cast("string"))
    third = v.table(spark, sf, "events").select(F.col("event_id").alias("a"), by_user.alias("b")).where("b is not null")
    asked = third.union(third.select("b", "a")).union(v.table(spark, sf, "events").select("event_id", F.col("event_id") + 7))
    return reach.ReachIndex(v.session_edges(spark, sf)).reaches(asked.select(name("a").alias("a"), name("b").alias("b"))).select("a", "b", "reaches")


@register("trade_paths", v.with_sql(
    v.TRADE, "found AS (SELECT p, p || ' -> ' || s || ' -> ' || c AS path FROM tr_ps JOIN tr_sc USING (s) WHERE c IN (SELECT 'customer ' || c_custkey FROM customer WHERE c_nationkey = 0))",
    "SELECT p AS part, CAST(rank AS INTEGER) AS rank, path FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY path) AS rank FROM found) WHERE rank <= 3"))
def trade_paths(spark, sf):
    """The first three ways of each part, over its suppliers, to a customer of one nation: a question a part."""
    edges, name = v.trade_edges(spark, sf), lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    starts = v.table(spark, sf, "part").select(name("part ", "p_partkey").alias("label")).withColumn("part", F.col("label"))
    ends = v.table(spark, sf, "customer").where("c_nationkey = 0").select(name("customer ", "c_custkey").alias("label"))
    return graph.best_paths(edges, starts, ends, 3, 3, ["part"]).select("part", "rank", text_of().alias("path"))
