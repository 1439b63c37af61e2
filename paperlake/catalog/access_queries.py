"""Edited raw SQL and stored templates, paged and batched readers, ontologies, the result cache, field analyses and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as S
from ..operators import extract as X
from ..operators import vector as V
from ..plans import graph_sql as Q
from ..plans import ingest
from ..sources import files, lookup
from ..sources.graph import star_graph, table
from ..sources.scratch import folder
from ..streaming import cache
from . import query
from .analytics_queries import PAPERS_SQL, paper_frame
from .ingest_queries import works
from .sql import graph
from .vector_queries import STOP, TFIDF, corpus

RAW = "SELECT p.id, p.title FROM papers p WHERE p.cited_by_count > 400000 OR p.title = 'a LIMIT 3' ORDER BY p.id LIMIT 3"
_OWN = "(cited_by_count > 400000 OR title = 'a LIMIT 3')"
_BY = "id IN (SELECT paper_id FROM authored JOIN authors a ON author_id = a.id WHERE contains(lower(name), '00000003'))"
_IN = "id IN (SELECT paper_id FROM published_in JOIN venues v ON venue_id = v.id WHERE contains(lower(name), 'nation_1'))"
ENTITIES = {"author_names": ["00000003"], "keywords": ["urgent"], "year_from": "1995", "year_to": "1997", "venue": "Nation_1"}


def refined(spark, sf_dir, entities, any_of, limit):
    text, params = Q.refine(RAW, entities, any_of, limit)
    return Q.graph_sql(star_graph(spark, sf_dir), text, params)


@query("g_refined_sql", graph(f"SELECT id, title FROM papers WHERE {_OWN} AND {_BY} AND publication_date >= '1995' AND publication_date < '1997' AND {_IN} ORDER BY id LIMIT 50"))
def g_refined_sql(spark, sf_dir):
    return refined(spark, sf_dir, ENTITIES, False, 50)


@query("g_refined_by_keywords", graph(f"SELECT id, title FROM papers WHERE {_OWN} AND (contains(lower(title), 'urgent') OR coalesce(contains(lower(abstract), 'urgent'), false)) AND starts_with(publication_date, '1996') ORDER BY id LIMIT 40"))
def g_refined_by_keywords(spark, sf_dir):
    return refined(spark, sf_dir, {"keywords": ["Urgent"], "year": "1996"}, False, 40)


@query("g_broadened_sql", graph(f"SELECT id, title FROM papers WHERE {_OWN} OR id IN ('W7', 'W33') OR {_IN} ORDER BY id LIMIT 200"))
def g_broadened_sql(spark, sf_dir):
    return refined(spark, sf_dir, {"paper_ids": ["W7", "W33"], "keywords": ["urgent"], "venue": "nation_1"}, True, 200)


@query("g_replaced_limit", graph(f"SELECT id, title FROM papers WHERE {_OWN} ORDER BY id LIMIT 17"))
def g_replaced_limit(spark, sf_dir):
    return Q.graph_sql(star_graph(spark, sf_dir), Q.with_limit(RAW, ":k"), {"k": 17})


@query("g_stored_template", graph("SELECT v.name AS venue, count(*) AS n FROM papers p JOIN published_in x ON x.paper_id = p.id JOIN venues v ON v.id = x.venue_id WHERE starts_with(p.publication_date, '1996') GROUP BY 1 ORDER BY n DESC, venue LIMIT 12"))
def g_stored_template(spark, sf_dir):
    rows = [("venues_of_year", "SELECT v.name AS venue, count(*) AS n FROM papers p JOIN published_in x ON x.paper_id = p.id JOIN venues v ON v.id = x.venue_id WHERE startswith(p.publication_date, :year) GROUP BY 1 ORDER BY n DESC, venue", ["year"]), ("by_ids", "SELECT id FROM papers WHERE array_contains(:paper_ids, id)", ["paper_ids"])]
    path = f"{folder(spark)}/templates"
    files.write_records(spark.createDataFrame(rows, "name string, text string, needs array<string>"), path)
    stored = Q.StoredTemplates(star_graph(spark, sf_dir), path)
    (name,) = stored.viable({"year": "1996"})
    return stored.run(name, {"year": "1996"}, 12)


WORK = "id string, title string, cited_by_count long"


@query("fl_offset_pages", "SELECT 'W' || i AS id, 'Work number ' || i AS title, i % 7 AS cited_by_count FROM range(130) r(i)")
def fl_offset_pages(spark, sf_dir):
    return lookup.pages(spark, lambda offset, limit: [lookup.made_up(n) for n in range(offset, offset + limit)], 130, 25, WORK)


@query("fl_numbered_pages", "SELECT 'W' || i AS id, 'Work number ' || i AS title, i % 7 AS cited_by_count FROM range(97) r(i)")
def fl_numbered_pages(spark, sf_dir):
    return lookup.pages(spark, lambda page, size: [lookup.made_up(n) for n in range((page - 1) * size, min(page * size, 97))], 120, 20, WORK, numbered=True)


@query("fl_batches_of_ids", "SELECT 'W' || o_orderkey AS id, 'Work number ' || o_orderkey AS title, o_orderkey % 7 AS cited_by_count FROM orders WHERE o_orderkey % 10 <> 0")
def fl_batches_of_ids(spark, sf_dir):
    """Every tenth id is unknown to the service."""
    ids = table(spark, sf_dir, "orders").select(F.concat(F.lit("W"), F.col("o_orderkey").cast("string")).alias("id"))

    def fetch(asked):
        assert len(asked) <= lookup.BATCH
        return [lookup.made_up(int(i[1:])) for i in asked if int(i[1:]) % 10]

    return lookup.by_ids(ids, fetch, WORK)


@query("fl_title_lookup", "SELECT DISTINCT 'Work number ' || n_nationkey AS title, 'W' || n_nationkey AS id, n_nationkey % 7 AS cited_by_count FROM nation WHERE n_nationkey % 2 = 0")
def fl_title_lookup(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.concat(F.when(F.col("n_nationkey") % 2 == 0, "Work number ").otherwise("No "), F.col("n_nationkey").cast("string")).alias("title"))
    return lookup.by_title(n, lambda title: [lookup.made_up(int(title.split(" ")[-1])), lookup.made_up(0)], "id string, cited_by_count long")


def classes(spark, sf_dir):
    """Regions as classes above the nations."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = n.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("@id"), F.col("n_name").alias("prefLabel"), F.array(F.concat(F.lit("land of "), "n_name")).alias("synonym"), F.array(F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))).alias("parents"), (F.col("n_nationkey") % 5 == 0).alias("obsolete"))
    rows = rows.unionByName(r.select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("@id"), F.col("r_name").alias("prefLabel")), allowMissingColumns=True)
    return lookup.ontology_classes(rows.select(F.to_json(F.struct("*")).alias("raw")))


@query("on_hierarchy", "SELECT 'N' || n_nationkey AS id, n_name AS label, [r_name] AS parents, CAST([] AS VARCHAR[]) AS children FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'R' || r_regionkey, r_name, [], (SELECT list_sort(coalesce(list(DISTINCT n_name), [])) FROM nation WHERE n_regionkey = r_regionkey) FROM region")
def on_hierarchy(spark, sf_dir):
    return lookup.hierarchy(classes(spark, sf_dir))


@query("on_search", "SELECT 'N' || n_nationkey AS id, n_name AS label, lower(n_name) = 'nation_1' AS exact FROM nation WHERE contains(lower(n_name), 'nation_1') AND n_nationkey % 5 <> 0")
def on_search(spark, sf_dir):
    return lookup.search_classes(classes(spark, sf_dir), "Nation_1").select("id", "label", "exact")


@query("sm_cache")
def sm_cache(spark, sf_dir):
    """A sequence of states, so without an oracle; tests hold it against a plain cache."""
    e = table(spark, sf_dir, "events").select("ts", F.col("event_id").alias("request_id"), F.concat_ws("|", "event_type", (F.col("user_id") % 300).cast("string")).alias("key"))
    return cache.cache_answers(e, entries=50, ttl=86_400.0)


@query("sm_cache_statistics")
def sm_cache_statistics(spark, sf_dir):
    return cache.cache_statistics(sm_cache(spark, sf_dir))


@query("an_describe", f"WITH {PAPERS_SQL}, x AS (SELECT 'citation_count' AS \"column\", CAST(citation_count AS DOUBLE) AS v FROM pf UNION ALL SELECT 'year', CAST(year AS DOUBLE) FROM pf) SELECT \"column\", count(v) AS count, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, min(v) AS min, round(quantile_cont(v, 0.25), 4) AS q25, round(median(v), 4) AS median, round(quantile_cont(v, 0.75), 4) AS q75, max(v) AS max FROM x GROUP BY 1")
def an_describe(spark, sf_dir):
    d = S.describe(paper_frame(spark, sf_dir), ["citation_count", "year"])
    return d.select("column", "count", *[F.round(c, 4).alias(c) if c not in ("min", "max") else F.col(c) for c in ("mean", "std", "min", "q25", "median", "q75", "max")])


@query("an_top_concepts", f"WITH {PAPERS_SQL} SELECT name, count(*) AS papers, sum(citation_count)::BIGINT AS citations FROM (SELECT citation_count, unnest(fields_of_study) AS name FROM pf) GROUP BY name ORDER BY papers DESC, name LIMIT 3")
def an_top_concepts(spark, sf_dir):
    return S.top_of_lists(paper_frame(spark, sf_dir), "fields_of_study", 3)


@query("an_prolific_authors", f"WITH {PAPERS_SQL}, a AS (SELECT DISTINCT l_orderkey, 'A' || l_suppkey AS name FROM lineitem) SELECT name, count(*) AS papers, sum(citation_count)::BIGINT AS citations FROM pf JOIN a ON l_orderkey = paper_id GROUP BY name ORDER BY papers DESC, name LIMIT 10")
def an_prolific_authors(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("paper_id")).agg(F.collect_set(F.concat(F.lit("A"), F.col("l_suppkey").cast("string"))).alias("names"))
    return S.top_of_lists(paper_frame(spark, sf_dir).join(lines, "paper_id"), "names", 10)


@query("an_open_access_means", f"WITH {PAPERS_SQL} SELECT coalesce(venue <> '' AND paper_id % 6 <> 1, false) AS flag, count(*) AS papers, round(avg(citation_count), 4) AS avg_citations FROM pf GROUP BY 1")
def an_open_access_means(spark, sf_dir):
    return S.mean_by_flag(paper_frame(spark, sf_dir), (F.col("venue") != "") & (F.col("paper_id") % 6 != 1)).withColumn("avg_citations", F.round("avg_citations", 4))


@query("an_topic_top5", f"WITH {PAPERS_SQL} SELECT paper_id, citation_count FROM pf WHERE year >= 2016 AND (contains(lower(title), 'about data') OR coalesce(contains(lower(abstract), 'about data'), false)) ORDER BY citation_count DESC, paper_id LIMIT 5")
def an_topic_top5(spark, sf_dir):
    return S.topic_top(paper_frame(spark, sf_dir), "About Data", 2016).select("paper_id", "citation_count")


def items(spark, sf_dir):
    c = corpus(spark, sf_dir)
    v = F.col("vector")
    return c.select("id", F.col("label").alias("paper_id"), F.repeat(F.lit("ab "), (F.col("id") % 4 * 1000).cast("int")).alias("description"), F.when(F.col("id") % 3 > 0, v).alias("image"), F.when(F.col("id") % 5 > 0, v).alias("text"))


@query("in_visual_rows", "SELECT 'figure' AS kind, vec_id AS id, CAST(least(2000, vec_id % 4 * 3000) AS INTEGER) AS chars FROM embeddings WHERE vec_id % 3 > 0 OR vec_id % 5 > 0 UNION ALL SELECT 'table', vec_id, CAST(least(8000, vec_id % 4 * 3000) AS INTEGER) FROM embeddings WHERE vec_id % 5 > 0")
def in_visual_rows(spark, sf_dir):
    i = items(spark, sf_dir)
    both = [X.visual_rows(i, kind).select(F.lit(kind).alias("kind"), "id", F.length("description").alias("chars")) for kind in ("figure", "table")]
    return both[0].unionByName(both[1])


@query("in_rejects", "SELECT 'https://openalex.org/W' || o_orderkey AS id, 'no title' AS reason FROM orders WHERE o_orderkey % 11 = 0")
def in_rejects(spark, sf_dir):
    return ingest.rejects(works(spark, sf_dir))


@query("fl_export_manifest", "SELECT * FROM (VALUES ('csv', true), ('json', true)) v(format, written)")
def fl_export_manifest(spark, sf_dir):
    done = files.export(table(spark, sf_dir, "nation"), f"{folder(spark)}/export")
    return done.select("format", ((F.col("files") > 0) & (F.col("bytes") > 0)).alias("written"))


@query("tk_sparse_dropped", f"WITH {TFIDF}, cut AS (SELECT *, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id ORDER BY abs(w), term DESC) AS nth FROM d) SELECT id, count(*) AS terms FROM cut WHERE nth > floor(n * 0.2::DOUBLE) GROUP BY id")
def tk_sparse_dropped(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    weights, _ = V.text_index(docs, STOP, drop=0.2)
    return weights.groupBy("id").agg(F.count("*").alias("terms"))

