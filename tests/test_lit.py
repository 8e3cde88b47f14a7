"""The papers of each query, from a table, against plain Python."""

from causeway.sources.records import LiteratureSource


def test_search_moves_no_texts_of_papers_that_are_not_found(spark):
    papers = [(i, f"t{i % 4}", [5, None, 9, 9, 3][i % 5], f"heat {'and with ' * (i % 3)} x{i}") for i in range(40)] + [(7, "t3", 9, "heat again"), (90, "a", 9, None), (91, "a", 99, "none")]
    df = spark.createDataFrame(papers, "ord long, title string, citations long, abstract string")
    queries = ["the heat of", "and with", "zzz"]
    found = LiteratureSource.from_table(df, spark.createDataFrame([(q,) for q in queries], "query string"), 6)
    got = {q: [(r.citations, r.title, r.ord) for r in found.where(f"query = '{q}'").orderBy("rank").collect()] for q in queries}
    want = {q: sorted({(c, t, o) for o, t, c, a in papers if a and set(a.split()) & {w for w in q.split() if len(w) > 2}}, key=lambda r: (r[0] is None, -(r[0] or 0), r[1], r[2]))[:6] for q in queries}
    assert got == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "likely" not in plan and "Generate" not in plan  # the words were met before; papers are joined with few keys
