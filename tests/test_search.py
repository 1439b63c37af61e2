"""Phrase index, strategies of the hybrid search, sparse search by blocks and rank counts against brute force."""

import re
from collections import defaultdict
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperlake.functions import query_text as Q
from paperlake.operators import phrases as P
from paperlake.plans import hybrid
from paperlake.sources.graph import star_graph
from paperlake.sources.queries import questions
from paperlake.sources.scratch import kept


def plan_of(df):
    return df._jdf.queryExecution().toString()


def found(texts, words):
    return {(w, i) for i, t in texts for w in words if t is not None and w.strip(" \t\n") and w.lower() in t}


@pytest.mark.parametrize("seed", range(2))
def test_phrases_are_found_as_by_contains(spark, seed):
    r = np.random.default_rng(seed)
    letters, blanks = list("abé"), [" ", " ", " ", "\n", "  ", "\t"]
    token = lambda: "".join(r.choice(letters, int(r.integers(1, 5))))
    text = lambda n: "".join(token() + blanks[int(r.integers(6))] for _ in range(n))
    texts = [(i, text(int(r.integers(0, 12)))) for i in range(80)] + [(80, None), (81, ""), (82, " "), (83, " ab ab"), (84, "graph search\nof graphs"), (85, "a " * 5000 + "b")]
    words = [text(int(r.integers(1, 5))).strip() for _ in range(60)] + [token() for _ in range(20)]
    # Pieces of the texts themselves, cut inside tokens and blanks.
    for _, t in [x for x in texts if x[1] and len(x[1]) < 200]:
        at = sorted(int(x) for x in r.integers(0, len(t) + 1, 2))
        words.append(t[at[0] : at[1]])
    words += ["", " ", "\n", "GRAPH search", "h search\nof gr", "search of", "a b", " ab", "ab ", " a ", "ABÉ", "zz zz zz"]
    index = P.phrase_index(spark.createDataFrame(texts, "id int, t string").withColumn("cited", F.col("id") % 5))
    rows = P.holding(index, spark.createDataFrame([(w,) for w in words], "w string"))
    got = rows.collect()
    want = found(texts, words)
    assert len(got) == len({(x.w, x.id) for x in got}) and {(x.w, x.id) for x in got} == want and len(want) > 500
    assert "NestedLoop" not in plan_of(rows) and "Cartesian" not in plan_of(rows)
    best = P.holding(index, spark.createDataFrame([(w,) for w in words], "w string"), [F.desc("cited"), F.col("id")], 2)
    held = defaultdict(list)
    for w, i in want:
        held[w].append(i)
    assert {(x.w, x.id) for x in best.collect()} == {(w, i) for w, v in held.items() for i in sorted(v, key=lambda i: (-(i % 5), i))[:2]}


def test_phrases_leave_no_plan_of_the_index_behind(spark):
    index = P.phrase_index(spark.createDataFrame([(1, "graph search of graphs"), (2, "a graph")], "id int, t string"))
    for words, want in ((["graph", "rap"], {("graph", 1), ("graph", 2), ("rap", 1), ("rap", 2)}), (["a graph", "search of gr", "graph"], {("a graph", 2), ("search of gr", 1), ("graph", 1), ("graph", 2)}), ([" "], set())):
        rows = P.holding(index, spark.createDataFrame([(w,) for w in words], "w string"))
        assert {(x.w, x.id) for x in rows.collect()} == want
        assert "Exchange" not in plan_of(rows) and "Join" not in plan_of(rows)


def test_hybrid_search_broadcasts_nothing_that_grows(spark, sf_dir, monkeypatch):
    """However small files look, phrases, nodes and papers meet by shuffles; questions are analysed from a written table by one plan."""
    plans = []

    def seen(df):
        plans.append(plan_of(df).split("== Physical Plan ==")[1])
        return kept(df)

    for m in (P, hybrid):
        monkeypatch.setattr(m, "kept", seen)
    g = star_graph(spark, sf_dir)
    asked = questions(spark, sf_dir)
    rows = hybrid.hybrid(g, asked, 5, index=hybrid.text_index(g))
    assert rows.count() > 50 and sum("SortMergeJoin" in p for p in plans) > 15
    # What is left are joins with the given tables' own keys, and each question's two extremes.
    joins = {re.sub(r"#\d+L?", "", x) for p in plans if "_lo" not in p for x in re.findall(r"BroadcastHashJoin (\[.*?\], \[.*?\])", p)}
    assert joins <= {"[l_partkey], [p_partkey]", "[o_custkey], [c_custkey]", "[author_id], [id]", "[venue_id], [id]"}
    first = next(p for p in plans if "specific" in p)
    assert "LocalTableScan" not in first and "Union" not in first


def test_all_registered_questions_meet_the_papers_without_a_nested_loop(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    asked = kept(Q.analyzed(questions(spark, sf_dir)).where("status = 'ok'").select("query_id", "entities"))
    papers = [(p.id, "\n".join(x for x in (p.title, p.abstract) if x is not None).lower()) for p in g.papers.collect()]
    words = {r.w for r in asked.select(F.explode("entities.keywords").alias("w")).distinct().collect()}
    assert any(" " in w for w in words)
    every = P.holding(hybrid.graph_index(g).papers, spark.createDataFrame([(w,) for w in words], "w string"))
    assert {(r.w, r.id) for r in every.collect()} == found(papers, words)
    pairs = hybrid.graph_candidates(g, asked)
    # What is left of nested loops are the few hundred years of the dates against the spans.
    loops = [line for line in plan_of(pairs).split("== Physical Plan ==")[1].splitlines() if "NestedLoop" in line]
    assert all("yr" in line for line in loops) and "Cartesian" not in plan_of(pairs)


def test_years_of_spans(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    spans = [("1996", None, None), (None, "1995", "1997"), (None, "1900", "1993"), ("1996-03", None, None), (None, "1995-06-01", "1996-02"), ("199", None, None), ("2050", None, None)]
    asked = spark.createDataFrame([(s,) for s in spans], "years struct<y:string,lo:string,hi:string>")
    papers = [(p.id, p.publication_date, p.cited_by_count) for p in g.papers.collect()]
    fits = lambda d, y, lo, hi: d is not None and (bool(y) and d.startswith(y) or bool(lo) and lo <= d < hi)
    for k in (None, 4):
        got = defaultdict(list)
        for r in hybrid.in_years(g, asked, k).collect():
            got[tuple(r.years)].append(r.id)
        for s in spans:
            want = sorted(((-c, i) for i, d, c in papers if fits(d, *s)))[:k]
            assert sorted(got[s]) == sorted(i for _, i in want), s


@pytest.fixture(scope="module")
def searched(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    return g, {"index": hybrid.text_index(g), "phrases": hybrid.graph_index(g)}


def ranked(rows):
    by = defaultdict(list)
    for r in sorted(rows.collect(), key=lambda r: r["rank"]):
        by[r.query_id].append(r)
    return by


def test_candidates_of_the_hybrid_search(spark, searched):
    """Relevance ranks the template's k most cited papers, a given number, or all that fit."""
    g, built = searched
    q = spark.createDataFrame([(1, "papers about urgent delivery in 1996"), (2, "W7 W33 in 1995")], "query_id int, query string")
    fit = defaultdict(set)
    for r in hybrid.graph_candidates(g, kept(Q.analyzed(q).select("query_id", "entities")), index=built["phrases"]).collect():
        fit[r.query_id].add(r.id)
    cited = {r.id: r.cited_by_count for r in g.papers.collect()}
    few, every = (ranked(hybrid.hybrid(g, q, 6, candidates=n, **built)) for n in ("template", None))
    assert len(fit[1]) > 60
    for k in (1, 2):
        assert {r.paper_id for r in few[k]} == set(sorted(fit[k], key=lambda i: (-cited[i], i))[:6])
        assert {r.paper_id for r in every[k]} <= fit[k] and len(every[k]) == 6
    assert [r.paper_id for r in every[1]] != [r.paper_id for r in few[1]]
    assert {r.paper_id for r in every[2][:2]} == {"W33", "W7"}


def test_overrides_of_the_hybrid_search(spark, searched):
    g, built = searched
    some = [(2, "status orders", "graph_only", "top_cited_papers"), (3, "status orders", "nonsense", "nonsense"), (4, "status for customer 5 in 2049", "vector_first", "search_papers")]
    q = spark.createDataFrame(some, "query_id int, query string, s string, t string")
    by = ranked(hybrid.hybrid(g, q, 5, strategy=F.col("s"), template=F.col("t"), **built))
    want = {2: ("graph_only", "top_cited_papers"), 3: ("vector_first", "search_papers"), 4: ("vector_first", "search_papers")}
    assert {k: {(r.strategy, r.template) for r in v} for k, v in by.items()} == {k: {v} for k, v in want.items()}
    assert {r.origin for r in by[2]} == {"graph"} and {r.origin for r in by[3]} == {"vector"}
    # Papers that the vector search finds join the requested ids of a question that names more than topics.
    assert {r.origin for r in by[4]} == {"graph"} and len(by[4]) == 5
    one = kept(Q.analyzed(q.where("query_id = 4")).select("query_id", "clean", "entities"))
    topical = sorted(r.id for r in hybrid.keyword_search(one, *built["index"], 5).collect())
    asked = one.select("query_id", F.col("entities").withField("paper_ids", F.lit(topical)).alias("entities"))
    assert {r.paper_id for r in by[4]} == {r.id for r in hybrid.graph_candidates(g, asked, 5, built["phrases"]).collect()}


def test_hybrid_search_takes_author_names_by_parts(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    g = replace(g, authors=g.authors.withColumn("name", F.translate("name", "#", " ")))
    names = spark.createDataFrame([("lier 00000000",), ("SUPPLIER",), ("r 0",), ("x",), ("0",)], "wanted string")
    nodes = [(r.id, r.name.lower()) for r in g.authors.collect()]
    assert {(r.wanted, r.id) for r in hybrid.named_nodes(hybrid.graph_index(g).authors, names).collect()} == found(nodes, [r.wanted for r in names.collect()])
