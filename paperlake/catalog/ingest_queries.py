"""Works to nodes, edges and texts; upserts, uploads and record linkage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract as X
from ..operators import graph as G
from ..sources.graph import star_graph, table
from . import query
from .sql import ENRICHED, graph

P = "https://openalex.org/"


def works(spark, sf_dir):
    """Raw works from the star schema: an order with its suppliers as authors, of whom every fifth has no id but an institution."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    who = li.select("l_orderkey", "l_suppkey").distinct()
    inst = F.struct(F.when(F.col("l_suppkey") % 10 > 0, F.concat(F.lit(P + "I"), (F.col("l_suppkey") % 4).cast("string"))).alias("id"), F.concat(F.lit("Inst "), (F.col("l_suppkey") % 4).cast("string")).alias("display_name"), F.element_at(F.array(*[F.lit(c) for c in ("JP", "US", "XX", "FR")]), (F.col("l_suppkey") % 4 + 1).cast("int")).alias("country_code"), F.lit("education").alias("type"))
    author = F.struct(F.struct(F.when(F.col("l_suppkey") % 5 > 0, F.concat(F.lit(P + "A"), F.col("l_suppkey").cast("string"))).alias("id"), F.when(F.col("l_suppkey") % 7 > 0, F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string"))).alias("display_name"), F.concat(F.lit("https://orcid.org/0-"), F.col("l_suppkey").cast("string")).alias("orcid")).alias("author"), (F.col("l_suppkey") % 2 == 0).alias("is_corresponding"), F.array(inst).alias("institutions"))
    authors = who.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_suppkey", author.alias("a")))), lambda x: x["a"]).alias("authorships"))
    k = F.col("o_orderkey")
    at = lambda kind, name, pdf: F.struct(pdf.alias("pdf_url"), F.struct(F.concat(F.lit(P + "S"), (k % 9).cast("string")).alias("id"), name.alias("display_name"), F.lit(kind).alias("type"), F.when(k % 2 == 0, "1234-5678").alias("issn_l"), F.array(F.lit("8765-4321")).alias("issn"), F.lit("Publisher").alias("host_organization_name")).alias("source"))
    none = F.lit(None)
    concepts = F.array(F.struct(F.lit("Low").alias("display_name"), F.lit(0.1).alias("score")), F.struct(F.concat(F.lit("C"), (k % 3).cast("string")).alias("display_name"), F.lit(0.9).alias("score")), F.struct(F.lit("Mid").alias("display_name"), F.lit(0.5).alias("score")), F.struct(F.lit("Least").alias("display_name"), F.lit(0.01).alias("score")))
    return o.join(authors, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.concat(F.lit(P + "W"), k.cast("string")).alias("id"), F.when(k % 11 == 0, "  ").otherwise(F.concat(F.lit(" Order "), k.cast("string"), F.lit(" "))).alias("title"), F.when(k % 4 == 0, "N/A").when(k % 4 == 1, none).otherwise(F.concat(F.lit("About "), "o_orderpriority")).alias("abstract"),
        F.when(k % 3 > 0, F.concat(F.lit("https://doi.org/10.5/"), k.cast("string"))).alias("doi"), F.year("o_orderdate").alias("publication_year"), F.when(k % 6 > 0, F.floor("o_totalprice").cast("bigint")).alias("cited_by_count"),
        F.struct(F.when(k % 5 == 0, F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), k.cast("string"))).alias("pmid")).alias("ids"), "authorships",
        F.array(F.when(k > 1, F.concat(F.lit(P + "W"), (k - 1).cast("string"))), F.lit("")).alias("referenced_works"),
        F.when(k % 4 == 0, at("journal", F.lit("Journal"), F.lit(""))).when(k % 4 == 1, at("book series", F.lit("Books"), F.lit("http://p/1"))).alias("primary_location"), F.when(k % 4 == 2, at("repository", F.lit("arXiv (x)"), F.lit("http://p/2"))).alias("best_oa_location"),
        F.array(at("conference proceedings", F.lit("Conf"), none.cast("string"))).alias("locations"), F.struct(F.lit("http://c").alias("pdf")).alias("content_urls"), concepts.alias("concepts"),
    )


@query("in_papers", "SELECT 'W' || o_orderkey AS id, 'Order ' || o_orderkey AS title, CASE WHEN o_orderkey % 4 = 0 THEN 'N/A' WHEN o_orderkey % 4 = 1 THEN NULL ELSE 'About ' || o_orderpriority END AS abstract, CASE WHEN o_orderkey % 3 > 0 THEN '10.5/' || o_orderkey END AS doi, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey AS VARCHAR) END AS pmid, year(o_orderdate) || '-01-01T00:00:00' AS publication_date, CASE o_orderkey % 4 WHEN 1 THEN 'http://p/1' WHEN 2 THEN 'http://p/2' ELSE 'http://c' END AS pdf_url, CASE WHEN o_orderkey % 6 > 0 THEN CAST(floor(o_totalprice) AS BIGINT) ELSE 0 END AS cited_by_count FROM orders WHERE o_orderkey % 11 > 0")
def in_papers(spark, sf_dir):
    return X.papers_of(works(spark, sf_dir))


@query("in_authors", "SELECT 'W' || l_orderkey AS paper_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) - 1 AS INTEGER) AS position, l_suppkey AS s FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)".join(["SELECT paper_id, position, 'A' || s AS author_id, 'Supplier ' || s AS name, '0-' || s AS orcid FROM (", ") WHERE s % 5 > 0 AND s % 7 > 0"]))
def in_authors(spark, sf_dir):
    return X.authors_of(works(spark, sf_dir))


@query("in_citations", "SELECT 'W' || o_orderkey AS src_id, 'W' || (o_orderkey - 1) AS dst_id FROM orders WHERE o_orderkey > 1")
def in_citations(spark, sf_dir):
    return X.citations_of(works(spark, sf_dir))


@query("in_venues", "SELECT 'W' || o_orderkey AS paper_id, 'S' || (o_orderkey % 9) AS venue_id, CASE o_orderkey % 4 WHEN 0 THEN 'Journal' WHEN 1 THEN 'Books' WHEN 2 THEN 'arXiv (x)' ELSE 'Conf' END AS name, CASE o_orderkey % 4 WHEN 0 THEN 'journal' WHEN 1 THEN 'book' WHEN 2 THEN 'arxiv' ELSE 'conference' END AS type, CASE WHEN o_orderkey % 2 = 0 THEN '1234-5678' ELSE '8765-4321' END AS issn, 'Publisher' AS publisher FROM orders")
def in_venues(spark, sf_dir):
    return X.venues_of(works(spark, sf_dir))


@query("in_institutions", "SELECT DISTINCT 'W' || l_orderkey AS paper_id, 'I' || (l_suppkey % 4) AS inst_id, 'Inst ' || (l_suppkey % 4) AS name, CASE l_suppkey % 4 WHEN 0 THEN 'Japan' WHEN 1 THEN 'United States' WHEN 2 THEN 'XX' ELSE 'France' END AS country, 'education' AS type FROM lineitem WHERE l_suppkey % 5 = 0 AND l_suppkey % 10 > 0")
def in_institutions(spark, sf_dir):
    return X.institutions_of(works(spark, sf_dir))


@query("in_flat_works", "WITH a AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_suppkey % 2 = 0) AS c, count(DISTINCT CASE WHEN l_suppkey % 10 > 0 THEN l_suppkey % 4 END) AS i, list(CASE WHEN l_suppkey % 7 > 0 THEN 'Supplier ' || l_suppkey END ORDER BY l_suppkey) AS names FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) GROUP BY 1) SELECT 'W' || o_orderkey AS work_id, CAST(coalesce(n, 0) AS INTEGER) AS author_count, CAST(coalesce(c, 0) AS INTEGER) AS corresponding_author_count, CAST(coalesce(i, 0) AS INTEGER) AS institution_count, names AS author_names, 'C' || (o_orderkey % 3) AS primary_concept, ['C' || (o_orderkey % 3), 'Mid', 'Low'] AS top_concepts, CASE o_orderkey % 4 WHEN 0 THEN 'Journal' WHEN 1 THEN 'Books' END AS journal_name, o_orderkey % 4 <> 1 AS has_abstract FROM orders LEFT JOIN a ON l_orderkey = o_orderkey")
def in_flat_works(spark, sf_dir):
    return X.flat_works(works(spark, sf_dir)).select("work_id", "author_count", "corresponding_author_count", "institution_count", "author_names", "primary_concept", "top_concepts", "journal_name", "has_abstract")


@query("in_embedding_text", "SELECT 'W' || o_orderkey AS id, CASE WHEN o_orderkey % 11 > 0 AND o_orderkey % 4 > 1 THEN 'TITLE: Order ' || o_orderkey || ' [SEP] ABSTRACT: About ' || o_orderpriority WHEN o_orderkey % 11 > 0 THEN 'TITLE: Order ' || o_orderkey WHEN o_orderkey % 4 > 1 THEN 'ABSTRACT: About ' || o_orderpriority END AS text, CASE WHEN o_orderkey % 4 > 1 THEN 'abstract' WHEN o_orderkey % 11 > 0 THEN 'title' END AS source FROM orders")
def in_embedding_text(spark, sf_dir):
    return works(spark, sf_dir).select(X.bare(F.col("id")).alias("id"), X.embedding_text(F.col("title"), F.col("abstract")).alias("e")).select("id", "e.*")


_NAMES = lambda n: f"array_to_string(list_slice(authors, 1, {n}), ', ') || CASE WHEN len(authors) > {n} THEN ' et al.' ELSE '' END"


@query("in_prompt_texts", graph(f"SELECT paper_id, '[1] ' || title || CASE WHEN len(authors) > 0 THEN ' | ' || {_NAMES(3)} ELSE '' END || CASE WHEN cited_by_count > 0 THEN ' | Cited: ' || cited_by_count ELSE '' END || CASE WHEN abstract IS NOT NULL THEN ' | ' || abstract[1:800] ELSE '' END AS prompt, 'Title: ' || title || CASE WHEN len(authors) > 0 THEN ' | Authors: ' || {_NAMES(5)} ELSE '' END || CASE WHEN venue IS NOT NULL THEN ' | Venue: ' || venue ELSE '' END || CASE WHEN abstract IS NOT NULL THEN ' | Abstract: ' || abstract[1:10] || CASE WHEN length(abstract) > 10 THEN '...' ELSE '' END ELSE '' END AS rerank FROM e", f"e AS ({ENRICHED.format(papers='papers')})"))
def in_prompt_texts(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    p, c = G.enrich(g, g.papers), F.col
    return p.select("paper_id", X.prompt_line(F.lit(1), c("title"), c("authors"), c("cited_by_count"), c("abstract")).alias("prompt"), X.rerank_text(c("title"), c("authors"), c("venue"), c("abstract"), 10).alias("rerank"))


@query("in_upsert", graph("SELECT id, CASE WHEN n % 4 = 0 THEN 'new ' || id ELSE title END AS title, CASE WHEN n % 4 = 0 AND n % 8 > 0 THEN n ELSE cited_by_count END AS cited_by_count FROM (SELECT *, CAST(substr(id, 2) AS BIGINT) AS n FROM papers) UNION ALL SELECT 'N' || id, 'new N' || id, CASE WHEN n % 8 > 0 THEN n END FROM (SELECT *, CAST(substr(id, 2) AS BIGINT) AS n FROM papers) WHERE n % 4 = 0 AND n % 3 = 0"))
def in_upsert(spark, sf_dir):
    old = star_graph(spark, sf_dir).papers.select("id", "title", "cited_by_count")
    n = F.substring("id", 2, 20).cast("long")
    new = old.where(n % 4 == 0).select("id", F.concat(F.lit("new "), "id").alias("title"), F.when(n % 8 > 0, n).alias("cited_by_count"), F.lit(2).alias("seq"))
    stale = new.withColumn("title", F.lit("stale")).withColumn("seq", F.lit(1)).withColumn("cited_by_count", F.lit(None).cast("bigint"))
    added = old.where((n % 4 == 0) & (n % 3 == 0)).select(F.concat(F.lit("N"), "id").alias("id"), F.concat(F.lit("new N"), "id").alias("title"), F.when(n % 8 > 0, n).alias("cited_by_count"), F.lit(1).alias("seq"))
    return G.upsert(old, new.unionByName(stale).unionByName(added), "id", "seq")


@query("in_upsert_edges", graph("SELECT src_id, dst_id FROM cites UNION SELECT dst_id, src_id FROM cites"))
def in_upsert_edges(spark, sf_dir):
    c = star_graph(spark, sf_dir).cites
    return G.upsert_edges(c, c.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id")).unionByName(c))


@query("in_upload_rows", "SELECT 'W' || vec_id AS id, CASE WHEN doc_id IS NULL THEN '' ELSE 'T' || doc_id END AS title, coalesce(text, '')[1:8000] AS abstract, CASE WHEN vec_id % 10 = 0 THEN 0.0::DOUBLE ELSE round(embedding[1]::DOUBLE, 6) END AS first, CAST(64 AS INTEGER) AS dim FROM embeddings LEFT JOIN documents ON doc_id = vec_id")
def in_upload_rows(spark, sf_dir):
    name = lambda c: F.concat(F.lit("W"), F.col(c).cast("string"))
    e = table(spark, sf_dir, "embeddings").select(name("vec_id").alias("paper_id"), F.when(F.col("vec_id") % 10 > 0, F.col("embedding")).alias("embedding"))
    p = table(spark, sf_dir, "documents").select(name("doc_id").alias("id"), F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("abstract"))
    return X.upload_rows(e, p, 64).select("id", "title", "abstract", F.round(F.col("dense")[0].cast("double"), 6).alias("first"), F.size("dense").alias("dim"))


@query("in_enrich_abstracts", graph("SELECT id, CASE WHEN abstract IS NOT NULL THEN abstract WHEN n % 2 = 1 THEN 'found' END AS abstract, greatest(cited_by_count, CASE WHEN n % 2 = 1 THEN 200000 ELSE 0 END) AS cited_by_count, CAST(CASE WHEN n % 2 = 1 THEN 2 ELSE 1 END AS INTEGER) AS keys FROM (SELECT *, CAST(substr(id, 2) AS BIGINT) AS n FROM papers)"))
def in_enrich_abstracts(spark, sf_dir):
    n = F.substring("id", 2, 20).cast("long")
    p = star_graph(spark, sf_dir).papers.select("id", "abstract", "cited_by_count", F.create_map(F.lit("a"), F.lit("1")).alias("metadata"))
    found = p.where(n % 2 == 1).select("id", F.lit("found").alias("abstract"), F.lit(200000).cast("bigint").alias("cited_by_count"), F.create_map(F.lit("a"), F.lit("2"), F.lit("b"), F.lit("3")).alias("metadata"))
    return X.enrich_abstracts(p, found).select("id", "abstract", "cited_by_count", F.size("metadata").alias("keys"))


@query("in_normalize_text", r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS norm FROM documents")
def in_normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.normalize_text(F.col("text")).alias("norm"))


@query("in_link_confidence", graph("SELECT id, CASE WHEN n % 3 > 0 AND n % 2 = 0 THEN 0.98::DOUBLE WHEN n % 5 = 0 THEN 0.97::DOUBLE WHEN n % 7 > 0 THEN 0.95::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM (SELECT *, CAST(substr(id, 2) AS BIGINT) AS n FROM papers)"))
def in_link_confidence(spark, sf_dir):
    n = F.substring("id", 2, 20).cast("long")
    p = star_graph(spark, sf_dir).papers.select("id", "title", "doi", n.alias("n"), F.when(n % 5 == 0, n.cast("string")).alias("pmid"), F.lit(2000).alias("year"), F.array(F.lit("Ann Lee"), F.lit("Bo"), F.lit("C. D")).alias("authors"))
    pairs = p.withColumns({"doi_2": F.when(F.col("n") % 2 == 0, F.upper("doi")), "pmid_2": F.col("pmid"), "title_2": F.upper("title"), "year_2": F.when(F.col("n") % 7 == 0, 1999).otherwise(2000), "authors_2": F.array(F.lit("ann lee!"), F.lit("bo"))})
    return X.link_confidence(pairs).select("id", "confidence")


@query("in_link_records", graph("SELECT id, 'S' || id AS id_2, 0.98::DOUBLE AS confidence FROM papers WHERE doi IS NOT NULL"))
def in_link_records(spark, sf_dir):
    p = star_graph(spark, sf_dir).papers.where("doi is not null").select("id", "title", "doi", F.lit(None).cast("string").alias("pmid"), F.lit(2000).alias("year"), F.array(F.lit("Ann Lee")).alias("authors"))
    return X.link_records(p, p.withColumn("id", F.concat(F.lit("S"), "id")).withColumn("doi", F.upper("doi")))


@query("in_properties", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN ['o_orderdate', 'o_orderkey', 'tags'] ELSE ['o_orderdate', 'o_orderkey', 'tags', 'status'] END AS keys, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS day, '[\"a\",\"b\"]' AS tags FROM orders")
def in_properties(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey", F.array(F.lit("a"), F.lit("b")).alias("tags"), F.when(F.col("o_orderkey") % 2 == 1, F.col("o_orderstatus")).alias("status"))
    p = o.withColumn("p", X.clean_properties(o))
    return p.select("o_orderkey", F.map_keys("p").alias("keys"), F.col("p")["o_orderdate"].alias("day"), F.col("p")["tags"].alias("tags"))


@query("in_totals", graph("SELECT (SELECT count(*) FROM papers) AS papers, (SELECT count(DISTINCT author_id) FROM authored) AS authors, (SELECT count(*) FROM cites) AS citations, round((SELECT count(*) FROM cites) / (SELECT count(*) FROM papers), 6) AS avg_citations"))
def in_totals(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    one = lambda d, c, n: d.agg(c.alias(n))
    t = one(g.papers, F.count("*"), "papers").crossJoin(one(g.authored, F.count_distinct("author_id"), "authors")).crossJoin(one(g.cites, F.count("*"), "citations"))
    return t.withColumn("avg_citations", F.round(F.col("citations") / F.col("papers"), 6))
