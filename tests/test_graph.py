"""Graph operators against plain Python on random graphs."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from causeway.functions import text as tx
from causeway.functions import vectors
from causeway.operators import evidence, graph, routing
from causeway.plans import views
from causeway.sources import kg, records
from causeway.streaming import edges as streaming

GRAPHS = st.sets(st.tuples(st.sampled_from("abcdef"), st.sampled_from("abcdef")), max_size=14)


def walks(edges, hops):
    """All simple paths of up to ``hops`` edges, depth first."""
    out = []

    def go(path):
        if len(path) > 1:
            out.append(tuple(path))
        if len(path) <= hops:
            for a, b in edges:
                if a == path[-1] and b not in path:
                    go([*path, b])

    for n in {x for e in edges for x in e}:
        go([n])
    return out


def frame(spark, edges):
    return spark.createDataFrame(sorted(edges), "src string, dst string")


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(GRAPHS)
def test_random_graphs(spark, edges):
    df = frame(spark, edges)
    labels = graph.nodes(df)
    got = [tuple(r.path) for r in graph.simple_paths(df, labels, labels, 3).collect()]
    assert sorted(got) == sorted(walks(edges, 3))
    reach = set(edges)
    while True:
        more = reach | {(a, d) for a, b in reach for c, d in edges if b == c}
        if more == reach:
            break
        reach = more
    assert {tuple(r) for r in graph.closure(df).collect()} == reach
    names = {x for e in edges for x in e}
    strong = {n: min([n, *(m for m in names if (n, m) in reach and (m, n) in reach)]) for n in names}
    assert {r.label: r.component for r in graph.strong_components(df).collect()} == strong
    acyclic = not any(a == b for a, b in reach)
    assert graph.is_dag(df).first()[0] == acyclic
    longest = max([len(p) for p in walks(edges, 6)], default=1 if names else 0) if acyclic else 0
    assert graph.longest_path(df).first()[0] == longest


def test_words_match_as_text(spark):
    labels = spark.createDataFrame([("flux 100%",), ("flux 100_",), ("Ratio",), ("concentration",)], "label string")
    match = lambda *w, **k: sorted(r.label for r in graph.keyword_match(labels, list(w), **k).collect())
    assert match("%") == ["flux 100%"] and match("ratio") == ["Ratio", "concentration"]
    assert match() == [] and len(match("")) == 4 and match("", skip_empty=True) == []


def test_files_round_trip(spark, tmp_path):
    rows = [dict(zip(views._NAMES, r)) for r in views.ROWS]
    path = tmp_path / "kg.json"
    path.write_text(json.dumps({"version": "1", "causal_relationships": rows}))
    edges = kg.read(spark, str(path))
    bare = tmp_path / "bare.json"
    bare.write_text(json.dumps(rows))
    key = lambda df: sorted(map(str, df.drop("relationship_id").collect()))
    assert key(edges) == key(kg.read(spark, str(bare))) == key(kg.normalise(views.kg_raw(spark)))
    kg.write(edges, str(tmp_path / "out"))
    assert key(kg.read_records(spark, str(tmp_path / "out"))) == key(edges)
    short = [{"source": "a", "relation": "determines", "target": "b", "psp_type": "Processing_to_Structure", "material": "M/N", "evidence_text": "e", "paper_doi": None, "confidence": 0.5}]
    path.write_text(json.dumps({"causal_relationships": short}))
    one = kg.read(spark, str(path)).first()
    assert (one.src, one.dst, one.relation, one.mechanism) == ("a", "b", "determines", "e")
    assert kg.is_valid(kg.read_raw(spark, str(path)))
    path.write_text(json.dumps({"causal_relationships": [{"source": "unknown", "target": "b"}]}))
    with pytest.raises(ValueError):
        kg.read(spark, str(path))
    kg.to_graphml(edges, str(tmp_path / "g.graphml"))
    assert (tmp_path / "g.graphml").read_text().count("<edge ") == edges.count()


def test_task_and_result_files(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"id": "x", "task": "forward", "target_property": "p"}\n\nnot json\n{"task": "inverse", "odd": 1}')
    got = [(r.id, r.task) for r in records.read_tasks(spark, str(tmp_path / "t.jsonl")).orderBy("line").collect()]
    assert got == [("x", "forward"), ("task_4", "inverse")]
    for i, text in enumerate(('[{"a": 1}, {"a": 2}]', '{"results": [{"a": 1}, {"a": 2}]}')):
        (tmp_path / f"r{i}.json").write_text(text)
        assert [r.a for r in records.read_results(spark, str(tmp_path / f"r{i}.json"), "a int").orderBy("ord").collect()] == [1, 2]
    (tmp_path / "one.json").write_text('{"a": 7}')
    assert [r.a for r in records.read_results(spark, str(tmp_path / "one.json"), "a int").collect()] == [7]


def test_literature_failures_are_empty(spark):
    def search(query, n):
        if query == "bad":
            raise OSError("no network")
        return [{"title": query, "citations": 3}] * 5

    found = records.LiteratureSource(search).find(spark.createDataFrame([("ok",), ("bad",)], "query string"), 2)
    assert [(r.query, r.title) for r in found.collect()] == [("ok", "ok"), ("ok", "ok")]


def test_responses_that_fail_become_error_rows(spark):
    prompted = spark.createDataFrame([(1, 1, "p"), (2, 3, "q")], "query_id int, tier int, prompt string")
    decided = spark.createDataFrame([(1, [["a", "b"]]), (2, [])], "query_id int, paths array<array<string>>")

    class Broken:
        def __call__(self, prompts):
            if "q" in prompts:
                raise RuntimeError("down")
            return ['{"confidence": 0.9}'] * len(prompts)

    got = {r.query_id: (r.confidence, r.reasoning_type, r.kg_paths_used) for r in routing.results(routing.respond(prompted, Broken(), pause=routing.at_once), decided).collect()}
    assert got == {1: (0.9, "tier_1", 1), 2: (0.0, "error", 0)}


def test_pairs_and_vectors(spark):
    df = spark.createDataFrame([(["novalue"],)], "p array<string>")
    with pytest.raises(Exception, match="not key=value"):
        df.select(tx.parse_pairs(F.col("p"))).collect()
    v = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0], "", "x")], "a array<double>, b array<double>, s string, t string")
    row = v.select(vectors.cosine(F.col("a"), F.col("b")), vectors.normalised(F.col("a")), vectors.distance(F.col("b"), F.col("b"), F.col("s"), F.col("t")), vectors.distance(F.col("b"), F.col("b")), F.size(vectors.hashed_embedding(F.col("s")))).first()
    assert tuple(row) == (None, [0.0, 0.0], 1.0, 0.0, 64)


def test_chain_and_small_functions(spark):
    row = spark.createDataFrame([("heat", "grain", "mobility", {"a": "1"}, {"a": "2", "b": "3"}, '{"chain_of_thought": ["x", "y"]}')], "p string, s string, r string, m map<string,string>, n map<string,string>, e string")
    got = row.select(tx.psp_chain(F.col("p"), F.col("s"), F.col("r")).alias("c"), tx.merged_params(F.col("m"), F.col("n")).alias("m"), tx.trace_steps(F.col("e")).alias("t")).first()
    assert [(x.src, x.dst) for x in got.c] == [("heat", "grain"), ("grain", "mobility")]
    assert got.m == {"a": "2", "b": "3"} and [x.evidence_text for x in got.t] == ["x", "y"]


def test_single_node_paths_and_custom_weights(spark):
    edges = spark.createDataFrame([("grain", "mobility", 0.5, " ")], "src string, dst string, confidence double, mechanism string")
    paths = spark.createDataFrame([(["grain"],), (["grain", "mobility"],), (["mobility", "grain"],)], "path array<string>")
    got = {tuple(r.path): (r.confidence, r.richness, round(r.coverage, 3), round(r.score, 3)) for r in evidence.rank_paths(paths, edges, {"confidence": 1.0, "richness": 0.0, "coverage": 0.0}).collect()}
    assert got == {("grain",): (0.0, 0.0, 0.333, 0.0), ("grain", "mobility"): (0.5, 0.0, 0.667, 0.5), ("mobility", "grain"): (1.0, 0.0, 0.667, 1.0)}


def test_stream_gives_the_batch_table(spark, tmp_path):
    raw = views.kg_raw(spark)
    for i, part in enumerate((raw.where("ord < 12"), raw.where("ord >= 12"))):
        part.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        query = streaming.merge_into(streaming.read_stream(spark, str(tmp_path / "in")), str(tmp_path / "table"), str(tmp_path / "cp"))
        query.processAllAvailable()
        query.stop()
    got = streaming.latest(spark, str(tmp_path / "table"))
    assert sorted(map(str, got.collect())) == sorted(map(str, kg.normalise(raw).select(*got.columns).collect()))


def test_words_meet_labels_through_the_index(spark):
    import random

    rng = random.Random(3)
    names = ["".join(rng.choice("abcé% ") for _ in range(rng.randrange(0, 9))) for _ in range(150)]
    words = ["".join(rng.choice("ABCé% ") for _ in range(rng.randrange(0, 6))) for _ in range(80)] + [None, "", "a", "abcabcabcabc"]
    labels = spark.createDataFrame([(n,) for n in names], "label string")
    got = {(r.query_id, r.label) for r in graph.keyword_match_join(labels, spark.createDataFrame([(i % 20, w) for i, w in enumerate(words)], "query_id int, word string")).collect()}
    assert got == {(i % 20, n) for i, w in enumerate(words) if w for n in names if w.lower() in n.lower()}


def test_components_of_a_larger_graph(spark):
    """Against Tarjan's algorithm: cycles of many sizes, bridges, tails, self-loops."""
    import random

    rng = random.Random(8)
    edges, at = set(), 0
    for _ in range(60):
        n = rng.randrange(1, 12)
        ring = [f"n{at + i:05}" for i in range(n)]
        edges |= {(ring[i], ring[(i + 1) % n]) for i in range(n)}
        at += n
    names = [f"n{i:05}" for i in range(at)]
    for _ in range(80):
        a, b = sorted(rng.sample(names, 2))
        edges.add((a, b))
    index, low, stack, on, out, count = {}, {}, [], set(), {}, 0
    follow = {}
    for a, b in edges:
        follow.setdefault(a, []).append(b)

    def go(v):
        nonlocal count
        index[v] = low[v] = count
        count += 1
        stack.append(v)
        on.add(v)
        for w in follow.get(v, []):
            if w not in index:
                go(w)
                low[v] = min(low[v], low[w])
            elif w in on:
                low[v] = min(low[v], index[w])
        if low[v] == index[v]:
            own = []
            while True:
                w = stack.pop()
                on.discard(w)
                own.append(w)
                if w == v:
                    break
            out.update({w: min(own) for w in own})

    for v in names:
        if v not in index:
            go(v)
    got = {r.label: r.component for r in graph.strong_components(frame(spark, edges)).collect()}
    assert got == {v: c for v, c in out.items() if v in got} and len(got) == len({x for e in edges for x in e})


def test_claims_walk_from_their_own_nodes(spark):
    df = frame(spark, [("heat", "grain size"), ("grain size", "mobility"), ("x", "y"), ("y", "x")])
    claims = spark.createDataFrame([(0, "HEAT", "mobil"), (1, "mobility", "heat"), (2, "grain", "size"), (3, "x", "x"), (4, "y", "z"), (5, None, "x"), (6, "", "x")], "claim_id int, source string, target string")
    got = {r.claim_id: r.verified for r in graph.reachable_pairs(df, claims).collect()}
    assert got == {0: True, 1: False, 2: True, 3: True, 4: False, 5: False, 6: False}


def test_pairs_with_smaller_ids_count(spark):
    from causeway.operators import diagnostics

    rows = [(49, [1.0, 0.0]), (50, [1.0, 0.0]), (100, [0.0, 1.0]), (3, [-1.0, 0.1])]
    vecs = spark.createDataFrame(rows, "label int, vec array<double>")
    got = [(r.a, r.b, r.score) for r in diagnostics.pair_extremes(vecs, vecs.where("label % 50 = 0"), 1).orderBy("side").collect()]
    assert got[1] == (50, 49, 1.0) and got[0][:2] == (50, 3)


def test_cells_find_nearly_all(spark):
    import random

    rng = random.Random(2)
    rows = [(i, [rng.gauss(i % 7, 2.0) for _ in range(16)]) for i in range(2000)]
    vecs = spark.createDataFrame(rows, "label int, vec array<double>")
    asked = vecs.where("label % 50 = 0").select(F.col("label").alias("query_id"), F.col("vec").alias("qvec"))
    found = lambda df: {(r.query_id, r.label) for r in df.collect()}
    exact, near = found(vectors.top_k(asked, vecs, 10)), found(vectors.top_k_in_cells(asked, vecs, 10))
    assert len(exact & near) / len(exact) >= 0.9
    assert vectors.dimension(vecs) == 16 and vectors.dimension(vecs.limit(0)) == 0


def test_graph_documents(spark, tmp_path):
    edges = kg.normalise(views.kg_raw(spark))
    kg.write_file(edges, str(tmp_path / "one"), version="2")
    import json as j
    whole = j.loads("".join(open(p).read() for p in sorted((tmp_path / "one").glob("part-*"))))
    assert whole["version"] == "2" and whole["total_relationships"] == edges.count() == len(whole["causal_relationships"])
    key = lambda df: sorted(map(str, df.drop("ord").collect()))
    assert key(kg.read(spark, str(tmp_path / "one"))) == key(edges)
    assert kg.validate(spark, str(tmp_path / "one"))[0]
    for name, text, said in (("bad", "{", "not JSON"), ("none", "{}", "no relationships"), ("empty", '{"causal_relationships": []}', "no relationships")):
        (tmp_path / name).write_text(text)
        assert kg.validate(spark, str(tmp_path / name)) == (False, {"error": said})
    assert kg.validate(spark, str(tmp_path / "absent"))[0] is False
    (tmp_path / "odd").write_text(j.dumps({"causal_relationships": [{"source": "a", "relation": "r", "target": "b", "psp_type": "Odd", "confidence": 2}, {"source": "a"}]}))
    assert kg.validate(spark, str(tmp_path / "odd")) == (False, {"relationships": 2, "errors": 3, "warnings": 2})
    n = kg.merge_files(spark, str(tmp_path / "one"), str(tmp_path / "one"), str(tmp_path / "merged"))
    assert n == edges.dropDuplicates(["src", "relation", "dst", "material"]).count() and kg.read(spark, str(tmp_path / "merged")).count() == edges.count()
    (tmp_path / "old").write_text(j.dumps([dict(zip(views._NAMES, r)) for r in views.ROWS]))
    found = kg.migrate_file(spark, str(tmp_path / "old"), str(tmp_path / "full"), str(tmp_path / "tiny"))
    assert kg.read(spark, str(tmp_path / "full")).count() == edges.count() and 0 < kg.read(spark, str(tmp_path / "tiny")).count() <= 10
    assert sum(r.n for r in found["psp_type"].collect()) == edges.count()
    assert kg.resolve(None, "d") == "d" and kg.resolve("x", "d") == "x"


def test_stream_goes_on_with_another_checkpoint(spark, tmp_path):
    raw = views.kg_raw(spark)
    for i in range(4):
        raw.where(F.col("ord") % 4 == i).coalesce(1).write.json(str(tmp_path / f"in{i}"))
        query = streaming.merge_into(streaming.read_stream(spark, str(tmp_path / f"in{i}")), str(tmp_path / "table"), str(tmp_path / f"cp{i // 2 + i}"))
        query.processAllAvailable()
        query.stop()
    assert len(list((tmp_path / "table").glob("v*"))) == 2  # older versions are gone
    got = streaming.latest(spark, str(tmp_path / "table"))
    assert sorted(map(str, got.collect())) == sorted(map(str, kg.normalise(raw).select(*got.columns).collect()))
    assert streaming.latest(spark, str(tmp_path / "none")) is None


def test_events_are_counted_by_window(spark, tmp_path):
    rows = [("2024-01-01 00:01:00", "a", 1.0), ("2024-01-01 00:04:00", "a", 2.0), ("2024-01-01 00:06:00", "b", 5.0), ("2024-01-01 02:00:00", "a", 1.0)]
    late = [("2024-01-01 00:02:00", "a", 9.0), ("2024-01-01 04:00:00", "a", 0.0)]
    for i, part in enumerate((rows, late, [("2024-01-01 06:00:00", "a", 0.0)])):
        spark.createDataFrame(part, "ts string, event_type string, value double").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema("ts string, event_type string, value double").json(str(tmp_path / "in"))
        query = streaming.event_counts(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
        query.processAllAvailable()
        query.stop()
    got = sorted((str(r.window.start), r.event_type, r.n, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got[:2] == [("2024-01-01 00:00:00", "a", 2, 3.0), ("2024-01-01 00:05:00", "b", 1, 5.0)]  # the late row is dropped


def test_terms_that_lead_to_each_other(spark):
    df = frame(spark, [("heat", "grain size"), ("grain size", "mobility"), ("x", "y")])
    units = {0: ["mobility", "heat"], 1: ["heat", "x"], 2: ["grain", "size"], 3: ["heat"], 4: ["y", "x", "zzz"], 5: [None, "", "heat"], 6: ["zzz", "q"]}
    terms = spark.createDataFrame([(i, t) for i, own in units.items() for t in own], "unit_id int, term string")
    assert {r.unit_id for r in graph.connected(df, terms).collect()} == {0, 2, 4}
