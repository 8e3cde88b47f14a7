import json

import pytest

from causeway import cli
from causeway.engine import MODES, Engine
from causeway.functions import lexicons as lx
from causeway.operators import benchmark, judge, literature, routing
from causeway.plans import views
from causeway.sources import kg, libraries, models, records
from pyspark.sql import functions as F


@pytest.mark.parametrize("mode", ["baseline", "core", "full"])
def test_modes_answer(spark, mode):
    edges = kg.normalise(views.kg_raw(spark))
    papers = spark.createDataFrame([(1, "title", 5, "abstract")], "ord int, title string, citations int, abstract string")
    asked = spark.createDataFrame([(0, {"method": "CVD temperature"}), (1, {"x": "zzz"})], "query_id int, params map<string,string>")
    got = {r.query_id: r for r in Engine(None if mode == "baseline" else edges, mode, papers=papers).answer(asked).collect()}
    assert got[0].tier == (3 if mode == "baseline" else 1) and got[0].confidence == 0.5
    assert (got[0].kg_paths_used > 0) == (mode != "baseline")


def test_refusals(spark):
    with pytest.raises(ValueError):
        Engine(None, "other")
    with pytest.raises(ValueError):
        Engine(None, "core")
    assert len(MODES) == 5


def test_command_line(spark, tmp_path):
    path = tmp_path / "kg.json"
    path.write_text(json.dumps([dict(zip(views._NAMES, r)) for r in views.ROWS]))
    rows = cli.main(["design", "--kg", str(path), "--param", "target=mobility", "--json"])
    assert rows[0]["tier"] == 1 and any(p[:2] == ["carrier mobility", "grain size"] for p in rows[0]["paths"])
    assert "nodes: " in cli.main(["diagnose", "--kg", str(path)])[0]["report"]
    with pytest.raises(ValueError):
        cli.parameters(["novalue"])
    assert cli.main(["validate", "--kg", str(path)])[0]["valid"] is False  # the hand-made rows lack fields
    assert cli.main(["predict", "--mode", "baseline", "--param", "a=b"])[0]["tier"] == 3
    assert {r["kind"] for r in cli.main(["explain", "--kg", str(path), "--param", "p=carrier mobility", "--direction", "inverse"])} == {"node", "edge"}
    assert "error" in cli.tool(["predict", "--param", "a=b"]) and "rows" in cli.tool(["predict", "--mode", "baseline", "--param", "a=b"])
    text = cli.readable({"tier": 1, "paths": [["a", "b"]], "response": '{"x": 1}', "confidence": 0.5, "none": None, "steps": [{"n": 1}]})
    assert text == 'tier: 1\npaths:\n  1. a -> b\nanswer:\n  {\n    "x": 1\n  }\nconfidence: 0.500\nsteps:\n  - {"n": 1}'


def edges_of(spark):
    return kg.normalise(views.kg_raw(spark))


def asked_of(spark, *params):
    return spark.createDataFrame(list(enumerate(params)), "query_id int, params map<string,string>")


def test_explanations_both_ways(spark):
    edges = edges_of(spark)
    for direction, word in (("forward", "CVD temperature"), ("inverse", "carrier mobility")):
        got = Engine(edges).explain(asked_of(spark, {"p": word}), direction).collect()
        assert {r.kind for r in got} == {"node", "edge"}
        assert {"newer evidence", "heat increases grain size"} <= {r.content for r in got if r.kind == "edge"}
    assert Engine(None, "baseline").explain(asked_of(spark, {"p": "x"})).count() == 0
    assert Engine(None, "baseline").diagnose(spark).first().report == "No graph loaded"


def test_naive_mode_takes_all_paths_to_fixed_words(spark):
    rows = [("heat", f"m{i}") for i in range(30)] + [(f"m{i}", "mobility") for i in range(30)] + [("heat", "hardness")]
    edges = kg.normalise(spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "ord long, source string, target string"))
    engine = Engine(edges, "naive")
    got = engine.answer(asked_of(spark, {"a": "heat"}, {"a": "nothing"})).orderBy("query_id").collect()
    assert got[0].kg_paths_used == 30 and all(p[-1] == "mobility" for p in got[0].paths) and got[1].kg_paths_used == 0
    assert engine.decisions(asked_of(spark, {"a": "mobility"}), "inverse").first().paths == []  # no condition word is there
    with pytest.raises(ValueError):
        engine.answer(asked_of(spark, {"a": "heat"}), "sideways")


def test_labels_with_arrows(spark):
    edges = kg.normalise(spark.createDataFrame([(0, "a -> b", "mobility", "quote")], "ord long, source string, target string, evidence_text string"))
    got = Engine(edges).answer(asked_of(spark, {"x": "a -> b"})).first()
    assert got.paths == [["a -> b", "mobility"]]
    assert {r.content for r in Engine(edges).explain(asked_of(spark, {"x": "a -> b"})).collect()} == {"a -> b", "mobility", "quote"}


class NoEvidence:
    """Answers prompts without evidence only."""

    def __call__(self, prompts):
        return ["words only" if "Causal paths" in p else '{"confidence": 0.4}' for p in prompts]


class Never:
    def __call__(self, prompts):
        raise RuntimeError("down")


class Batches:
    """Confidence by the size of the batch."""

    def __call__(self, prompts):
        return [json.dumps({"confidence": len(prompts) / 10})] * len(prompts)


def test_failures_go_down_a_tier(spark):
    asked = asked_of(spark, {"method": "CVD temperature"}, {"x": "zzz"})
    got = {r.query_id: r for r in Engine(edges_of(spark), responder=NoEvidence(), pause=routing.at_once).answer(asked).collect()}
    assert (got[0].tier, got[0].demoted, got[0].confidence, got[0].reasoning_type) == (3, True, 0.4, "tier_3")
    assert (got[1].tier, got[1].demoted) == (3, False)
    got = Engine(edges_of(spark), responder=Never(), pause=routing.at_once).answer(asked).collect()
    assert all((r.reasoning_type, r.confidence, r.response) == ("error", 0.0, None) for r in got)
    prompts = spark.range(6).coalesce(1).select(F.col("id").alias("query_id"), F.lit("p").alias("prompt"))
    assert {json.loads(r.response)["confidence"] for r in routing.respond(prompts, Batches()).collect()} == {0.6}


def test_pauses_grow(spark):
    waited = []

    def answer(prompts):
        raise OSError

    assert routing.ask(answer, ["a", "b"], 3, waited.append) == [None, None] and waited == [0, 1]
    said = iter([["no"], ['```json\n{"a": 1}\n```']])
    assert routing.ask(lambda p: next(said), ["a"], 3, waited.append) == ['{"a": 1}']


def test_literature_is_of_each_question(spark):
    papers = spark.createDataFrame([(1, "Heat", 5, "about cvd"), (2, "heat", 9, "about cvd"), (3, "Other", 7, "on zinc"), (4, "Same", 3, "zinc a"), (5, "Same", 3, "zinc b")], "ord int, title string, citations int, abstract string")
    asked = asked_of(spark, {"m": "CVD"}, {"m": "zinc"}, {"m": "none"})
    out = {r.query_id: r for r in Engine(edges_of(spark), "full", papers=papers).answer(asked).collect()}
    assert [p.title for p in out[0].literature] == ["heat"] and [p.title for p in out[1].literature] == ["Other", "Same"] and out[2].literature is None
    assert [s.confidence for s in out[0].steps] == [1.0, 0.8, 0.5] and [s.confidence for s in out[2].steps] == [0.0, 0.3, 0.5]
    found = records.LiteratureSource.from_table(papers, spark.createDataFrame([("zinc",)], "query string"), 9)
    assert sorted(r.ord for r in found.collect()) == [3, 4, 5]  # equal titles and citations are papers of their own
    source = records.LiteratureSource(lambda q, n: [{"title": f"{q} {i}", "citations": i} for i in range(5)])
    decided = Engine(edges_of(spark)).decisions(asked, "forward")
    rows = literature.enrich(asked, decided, "forward", source).collect()
    assert max(r.ord for r in rows) <= 10 and len({r.query_id for r in rows}) == 3


def test_paper_indexes():
    def fetch(url):
        if "openalex" in url:
            return {"results": [{"title": "A", "cited_by_count": 3, "authorships": [{"author": {"display_name": n}} for n in "wxyz"]}, {"title": None}]}
        if "bad" in url:
            raise OSError
        return {"data": [{"title": "a", "citationCount": 9}, {"title": "B", "citationCount": 5, "authors": [{"name": "n"}]}]}

    got = libraries.Search(fetch=fetch, least_seconds=0)("q", 4)
    assert [(p["title"], p["citations"]) for p in got] == [("B", 5), ("A", 3), ("Untitled", 0)] and got[1]["authors"] == ["w", "x", "y"]
    assert [p["title"] for p in libraries.Search(fetch=fetch, least_seconds=0)("bad", 4)] == ["A", "Untitled"]
    assert len(libraries.Search(both=False, fetch=fetch, least_seconds=0)("q", 1)) == 1


def test_backends():
    assert models.CommandResponder(["cat"], json_mode=False, system="s")(["p"]) == ["<system>\ns\n</system>\np"]
    with pytest.raises(RuntimeError):
        models.CommandResponder(["false"])(["p"])
    calls = []

    def fetch(url, body, headers, timeout):
        calls.append((url, body and body["messages"][-1]["content"][:1], headers))
        return {"choices": [{"message": {"content": "{}"}}]}

    http = models.responder("http", url="http://x", key="k", fetch=fetch)
    assert http(["p", "q"]) == ["{}", "{}"] and http.ping() and calls[0] == ("http://x/chat/completions", "p", {"Authorization": "Bearer k"})
    assert not models.HttpResponder("http://127.0.0.1:1").ping() and not models.CommandResponder(["no-such-program"]).ping()
    with pytest.raises(ValueError):
        models.responder("other")


class Judge:
    def __call__(self, prompts):
        out = []
        for p in prompts:
            most = int(p.split("from 0 to ")[1].split(".")[0])
            if "Answer: bad" in p:
                raise RuntimeError("down")
            out.append(json.dumps({"score": most * 2} if "Answer: over" in p else {"score": most / 2, "justification": "fine", "strengths": ["s"]}))
        return out


def test_judging(spark):
    results = spark.createDataFrame([("t1", "q", "half"), ("t2", "q", "over"), ("t3", "q", "bad"), (None, "q", "half")], "task_id string, query string, prediction string")
    truth = spark.createDataFrame([("t1", "x", 0), ("t1", "y", 1)], "task_id string, truth string, ord int")
    cases = judge.cases(results, truth)
    assert {(r.case_id, r.truth) for r in cases.collect()} == {("t1", "y"), ("t2", ""), ("t3", ""), ("0", "")}
    records = judge.judge(cases, Judge(), attempts=1, pause=routing.at_once).cache()
    rows = records.collect()
    assert len(rows) == 4 * len(lx.RUBRIC) and all(r.error == (r.case_id == "t3") for r in rows)
    got = {r.case_id: (r.overall, r.percent) for r in judge.totals(records).collect()}
    assert got == {"t1": (50.0, 50.0), "t2": (100.0, 100.0), "t3": (0.0, 0.0), "0": (50.0, 50.0)}
    assert {r.metric: r.percent for r in judge.summary(records).collect()} == {m: 50.0 for m in lx.RUBRIC}
    texts = {r.case_id: r.text for r in judge.report(records).collect()}
    assert texts["t1"].startswith("Case t1: 50.0 (50.0%)\n--- processing_feasibility ---\nScore: 20.0/40\nJustification: fine\nStrengths:\n  + s") and texts[None].startswith("Mean overall score: 50.0\nprocessing_feasibility: 20.0/40 (50.0%)")
    rows = spark.createDataFrame([("t", "m", "full", 1), ("t", "m", "core", 2), ("t", "n", "core", 3)], "task_id string, model string, mode string, x int")
    assert [r.x for r in judge.first_of_task(rows, "t", "m", ["core", "full"]).collect()] == [2]


class Answers:
    def __call__(self, prompts):
        return [json.dumps({
            "confidence": 0.8, "predicted_properties": {"carrier mobility": "high"}, "processing": "heat", "structure": "grain",
            "mechanistic_explanation": {"primary_mechanism": "grain size sets carrier mobility", "chain_of_thought": ["temperature causes grain", "grain leads to mobility", "zzz causes qqq"]},
        })] * len(prompts)


def test_benchmark_runs(spark, tmp_path):
    tasks = spark.createDataFrame([("f1", "forward", {"m": "CVD temperature"}), ("f2", "forward", {"m": "zzz"}), ("i1", "inverse", {"p": "carrier mobility"})], "task_id string, direction string, params map<string,string>")
    got = benchmark.run(tasks, edges_of(spark), {"good": Answers(), "echo": None}, ["baseline", "core"], pause=routing.at_once).cache()
    rows = {(r.task_id, r.model, r.mode): r for r in got.collect()}
    assert len(rows) == 12 and all(r.latency_ms >= 0 and 0 <= r.overall_score <= 1 for r in rows.values())
    one = rows["f1", "good", "core"]
    assert one.tier == 1 and abs(one.intervention_consistency - 2 / 3) < 1e-9 and one.kg_verification == 1.0 and one.psp_chain_validity == 0.4
    assert rows["f1", "good", "baseline"].intervention_consistency == rows["f1", "good", "core"].intervention_consistency  # claims are held against the same graph
    assert rows["f1", "good", "baseline"].kg_verification == 0.0 and rows["f1", "echo", "core"].intervention_consistency == 0.0
    records.write_by_task(got.withColumn("task_name", F.substring("task_id", 1, 1)), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/combined/json")).count() == 12
    assert spark.read.option("header", True).csv(str(tmp_path / "out/by_task/csv/task_name=f")).count() == 8
    assert {r.task: r.n for r in records.counts_by_name(got, ["f", "i1", "none"]).collect()} == {"f": 8, "i1": 4, "none": 0}


def test_pictures(spark, tmp_path):
    from xml.etree import ElementTree

    from causeway.operators import evaluation
    from causeway.sources import pictures

    edges = edges_of(spark)
    for layout in ("columns", "shell", "spring"):
        pictures.plot_graph(edges, str(tmp_path / "g.svg"), layout, most=12)
        root = ElementTree.parse(tmp_path / "g.svg").getroot()
        count = lambda tag: len(root.findall(f".//{{http://www.w3.org/2000/svg}}{tag}"))
        assert count("circle") == 12 and count("line") > 0
        assert all(0 <= float(c.get("cx")) <= pictures.WIDTH and 0 <= float(c.get("cy")) <= pictures.HEIGHT for c in root.iter("{http://www.w3.org/2000/svg}circle"))
    pictures.plot_trace(["a & b", "c" * 40], str(tmp_path / "t.svg"))
    assert "a &amp; b" in (tmp_path / "t.svg").read_text() and pictures.short("c" * 40).endswith("…")
    tiers = spark.createDataFrame([("forward", 1), ("forward", 3), ("forward", 3), ("inverse", 2)], "direction string, tier int")
    pictures.plot_tiers(evaluation.tier_distribution(tiers), str(tmp_path / "b.svg"))
    assert (tmp_path / "b.svg").read_text().count("<rect") == 3
    assert pictures.spring([], []) == {} and set(pictures.MODE_NAMES) == set(MODES)
