"""Graph templates, conditions and node or edge tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources.graph import star_graph
from . import query
from .sql import COLS, ENRICHED, WIDE, graph

TOP = " ORDER BY cited_by_count DESC NULLS FIRST, paper_id, venue NULLS FIRST"
ENTITIES = {"paper_ids": ["W7", "W33"], "author_names": ["#000000003"], "keywords": ["urgent"], "venue": "nation_1", "year": "1997"}
OR_SQL = """
hits AS (
  SELECT * FROM papers WHERE id IN ('W7', 'W33') OR contains(lower(title), 'urgent') OR coalesce(contains(lower(abstract), 'urgent'), false) OR starts_with(publication_date, '1997')
    OR EXISTS (SELECT 1 FROM authored JOIN authors a ON author_id = a.id WHERE paper_id = papers.id AND contains(lower(name), '#000000003'))
    OR EXISTS (SELECT 1 FROM published_in JOIN venues v ON venue_id = v.id WHERE paper_id = papers.id AND contains(lower(name), 'nation_1')))
"""


@query("g_search_papers", graph(WIDE.format(papers="hits") + TOP + ", institution NULLS FIRST LIMIT 100", OR_SQL))
def g_search_papers(spark, sf_dir):
    return G.search_papers(star_graph(spark, sf_dir), ENTITIES, 100)


@query("g_search_papers_all", graph(WIDE.format(papers="papers")))
def g_search_papers_all(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    return G.enrich(g, G.matching_papers(g, {}), institution=True)


@query("g_and_conditions", graph(f"SELECT {COLS} FROM papers p WHERE (contains(lower(title), 'urgent') OR coalesce(contains(lower(abstract), 'urgent'), false)) AND publication_date >= '1995' AND publication_date < '1997' AND id IN (SELECT paper_id FROM authored JOIN authors a ON author_id = a.id WHERE contains(lower(name), '1'))"))
def g_and_conditions(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    return G.matching_papers(g, {"keywords": ["Urgent"], "year_from": 1995, "year_to": 1997, "author_names": ["1"]}, any_of=False).withColumnRenamed("id", "paper_id")


@query("g_search_citations", graph(ENRICHED.format(papers="ends") + TOP + " LIMIT 20", "ids AS (SELECT src_id AS id FROM cites WHERE src_id IN ('W7', 'W33', 'W100') OR dst_id IN ('W7', 'W33', 'W100') UNION SELECT dst_id FROM cites WHERE src_id IN ('W7', 'W33', 'W100') OR dst_id IN ('W7', 'W33', 'W100')), ends AS (SELECT * FROM papers WHERE id IN (SELECT id FROM ids))"))
def g_search_citations(spark, sf_dir):
    return G.search_citations(star_graph(spark, sf_dir), ["W7", "W33", "W100"], 20)


@query("g_top_cited", graph(ENRICHED.format(papers="papers") + TOP + " LIMIT 10"))
def g_top_cited(spark, sf_dir):
    return G.top_cited_papers(star_graph(spark, sf_dir), 10)


@query("g_coauthor_network", graph("SELECT a1.name AS author, a2.name AS coauthor, count(*) AS shared_papers, list_slice(list_sort(list(DISTINCT title)), 1, 5) AS sample_titles FROM authored x JOIN authors a1 ON x.author_id = a1.id JOIN authored y ON x.paper_id = y.paper_id JOIN authors a2 ON y.author_id = a2.id JOIN papers p ON p.id = x.paper_id WHERE x.author_id <> y.author_id AND contains(lower(a1.name), '00000002') GROUP BY 1, 2 ORDER BY shared_papers DESC, author, coauthor LIMIT 25"))
def g_coauthor_network(spark, sf_dir):
    return G.coauthor_network(star_graph(spark, sf_dir), ["00000002"], 25)


@query("g_author_venue_stats", graph("SELECT a.name AS author, v.name AS venue, count(*) AS paper_count, list_slice(list_sort(list(DISTINCT title)), 1, 3) AS sample_titles FROM authored x JOIN authors a ON x.author_id = a.id JOIN papers p ON p.id = x.paper_id JOIN published_in pi ON pi.paper_id = p.id JOIN venues v ON v.id = pi.venue_id WHERE contains(lower(a.name), '00000002') OR contains(lower(a.name), '00000007') GROUP BY 1, 2 ORDER BY paper_count DESC, author, venue LIMIT 25"))
def g_author_venue_stats(spark, sf_dir):
    return G.author_venue_stats(star_graph(spark, sf_dir), ["00000002", "00000007"], 25)


@query("g_enrich_by_ids", graph(ENRICHED.format(papers="(SELECT * FROM papers WHERE cited_by_count > 200000)")))
def g_enrich_by_ids(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    return G.enrich_by_ids(g, g.papers.where("cited_by_count > 200000").select("id"))


@query("g_saved_demo", graph("SELECT p.id AS paper_id, title, coalesce(authors, []) AS authors, venue FROM papers p LEFT JOIN paper_authors a ON a.paper_id = p.id LEFT JOIN paper_venue v ON v.paper_id = p.id ORDER BY p.id LIMIT 10"))
def g_saved_demo(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    return G.enrich(g, g.papers.orderBy("id").limit(10), few=True).select("paper_id", "title", "authors", "venue")


@query("g_database_stats", graph("SELECT 'papers' AS what, count(*) AS n FROM papers UNION ALL SELECT 'authors', count(*) FROM authors UNION ALL SELECT 'venues', count(*) FROM venues UNION ALL SELECT 'institutions', count(*) FROM institutions UNION ALL SELECT 'authored', count(*) FROM authored UNION ALL SELECT 'published_in', count(*) FROM published_in UNION ALL SELECT 'associated_with', count(*) FROM associated_with UNION ALL SELECT 'cites', count(*) FROM cites"))
def g_database_stats(spark, sf_dir):
    return G.database_stats(star_graph(spark, sf_dir))


@query("g_raw_sql", graph("SELECT v.name AS venue, count(*) AS n FROM papers p JOIN published_in x ON x.paper_id = p.id JOIN venues v ON v.id = x.venue_id WHERE p.publication_date >= '1996' GROUP BY 1 ORDER BY n DESC, venue LIMIT 15"))
def g_raw_sql(spark, sf_dir):
    from ..plans.graph_sql import graph_sql

    return graph_sql(star_graph(spark, sf_dir), "SELECT v.name AS venue, count(*) AS n FROM papers p JOIN published_in x ON x.paper_id = p.id JOIN venues v ON v.id = x.venue_id WHERE p.publication_date >= :since GROUP BY 1 ORDER BY n DESC, venue", {"since": "1996"}, 15)


@query("g_stub_papers", graph("SELECT DISTINCT dst_id AS id FROM (SELECT replace(dst_id, 'W1', 'X1') AS dst_id FROM cites) WHERE dst_id NOT IN (SELECT id FROM papers)"))
def g_stub_papers(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    cited = g.cites.select(F.replace("dst_id", F.lit("W1"), F.lit("X1")).alias("dst_id"))
    return G.stub_papers(cited, g.papers).select("id")


@query("g_cites_in_set", graph("SELECT src_id, dst_id FROM cites WHERE dst_id IN (SELECT id FROM papers WHERE cited_by_count > 100000)"))
def g_cites_in_set(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    return g.cites.join(g.papers.where("cited_by_count > 100000").select(F.col("id").alias("dst_id")), "dst_id", "left_semi").select("src_id", "dst_id")


@query("g_venue_or_institution_filter", graph("SELECT id AS paper_id FROM papers WHERE EXISTS (SELECT 1 FROM published_in JOIN venues v ON venue_id = v.id WHERE paper_id = papers.id AND contains(lower(name), 'nation_2')) OR EXISTS (SELECT 1 FROM associated_with JOIN institutions i ON inst_id = i.id WHERE paper_id = papers.id AND contains(lower(name), '#12'))"))
def g_venue_or_institution_filter(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    return G.matching_papers(g, {"venue": "NATION_2", "institution": "#12"}).select(F.col("id").alias("paper_id"))
