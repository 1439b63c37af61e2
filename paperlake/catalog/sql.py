"""Common table expressions for the DuckDB side: the derived graph tables."""

GRAPH = """
papers AS (
  SELECT 'W' || o_orderkey AS id, 'Order ' || o_orderkey || ' ' || o_orderpriority AS title,
         CASE WHEN o_orderkey % 5 <> 0 THEN 'Status ' || o_orderstatus || ' for customer ' || o_custkey END AS abstract,
         CASE WHEN o_orderkey % 3 <> 0 THEN '10.5555/' || o_orderkey END AS doi,
         strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS publication_date,
         CAST(floor(o_totalprice) AS BIGINT) AS cited_by_count, CAST(NULL AS VARCHAR) AS pdf_url FROM orders),
authors AS (SELECT 'A' || s_suppkey AS id, s_name AS name FROM supplier),
venues AS (SELECT 'V' || n_nationkey AS id, n_name AS name FROM nation),
institutions AS (SELECT DISTINCT p_brand AS id, p_brand AS name FROM part),
authored AS (SELECT DISTINCT 'A' || l_suppkey AS author_id, 'W' || l_orderkey AS paper_id FROM lineitem),
published_in AS (SELECT 'W' || o_orderkey AS paper_id, 'V' || c_nationkey AS venue_id FROM orders JOIN customer ON o_custkey = c_custkey),
associated_with AS (SELECT DISTINCT 'W' || l_orderkey AS paper_id, p_brand AS inst_id FROM lineitem JOIN part ON l_partkey = p_partkey),
cites AS (SELECT * FROM (SELECT 'W' || o_orderkey AS src_id, 'W' || lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst_id FROM orders) WHERE dst_id IS NOT NULL),
paper_authors AS (SELECT paper_id, list_sort(list(DISTINCT name)) AS authors FROM authored JOIN authors ON author_id = id GROUP BY paper_id),
paper_venue AS (SELECT DISTINCT paper_id, name AS venue FROM published_in JOIN venues ON venue_id = id),
paper_inst AS (SELECT DISTINCT paper_id, name AS institution FROM associated_with JOIN institutions ON inst_id = id)
"""
COLS = "p.id AS paper_id, title, abstract, doi, publication_date, cited_by_count, pdf_url"
ENRICHED = f"SELECT {COLS}, coalesce(authors, []) AS authors, venue FROM {{papers}} p LEFT JOIN paper_authors a ON a.paper_id = p.id LEFT JOIN paper_venue v ON v.paper_id = p.id"
WIDE = f"SELECT {COLS}, coalesce(authors, []) AS authors, venue, institution FROM {{papers}} p LEFT JOIN paper_authors a ON a.paper_id = p.id LEFT JOIN paper_venue v ON v.paper_id = p.id LEFT JOIN paper_inst i ON i.paper_id = p.id"


def graph(body: str, more: str = "") -> str:
    return f"WITH {GRAPH}{', ' + more if more else ''} {body}"
