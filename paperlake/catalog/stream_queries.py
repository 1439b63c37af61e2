"""Sessions, metric windows and alerts, as batch twins with SQL and as streams; text kernels; the hybrid plan; files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import page_text as T
from ..plans import hybrid as H
from ..sources import files
from ..sources.graph import star_graph, table
from ..sources.queries import questions
from ..streaming import metrics as M
from ..streaming import sessions as S
from ..streaming.run import events_stream, run_to_end
from . import query


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumnRenamed("event_type", "metric")


_BUCKET = "time_bucket(INTERVAL '{w}', ts, TIMESTAMP '1970-01-01 00:00:00')"


@query("sm_rate", f"SELECT event_type AS metric, {_BUCKET.format(w='6 hours')} AS start, {_BUCKET.format(w='6 hours')} + INTERVAL '6 hours' AS \"end\", count(*)::DOUBLE AS increase, count(*) / 21600 AS rate FROM events GROUP BY 1, 2, 3")
def sm_rate(spark, sf_dir):
    return M.rate(events(spark, sf_dir), "6 hours")


@query("sm_sliding_rate", f"SELECT event_type AS metric, s AS start, s + INTERVAL '6 hours' AS \"end\", round(sum(value), 4) AS increase, round(sum(value) / 21600, 8) AS rate FROM (SELECT *, unnest([{_BUCKET.format(w='3 hours')}, {_BUCKET.format(w='3 hours')} - INTERVAL '3 hours']) AS s FROM events) GROUP BY 1, 2, 3")
def sm_sliding_rate(spark, sf_dir):
    r = M.rate(events(spark, sf_dir), "6 hours", "3 hours", F.col("value"))
    return r.withColumns({"increase": F.round("increase", 4), "rate": F.round("rate", 8)})


@query("sm_gauge", f"SELECT event_type AS metric, {_BUCKET.format(w='1 day')} AS start, arg_max(value, (ts, value)) AS value FROM events GROUP BY 1, 2")
def sm_gauge(spark, sf_dir):
    return M.gauge(events(spark, sf_dir), "1 day")


_EDGES = [0.0, *M.BUCKETS]
_QUANTILE = "CASE " + " ".join(f"WHEN c{i} >= n * 0.95::DOUBLE THEN {_EDGES[i]} + {_EDGES[i + 1] - _EDGES[i]} * CASE WHEN c{i} > {f'c{i - 1}' if i else 0} THEN (n * 0.95::DOUBLE - {f'c{i - 1}' if i else 0}) / (c{i} - {f'c{i - 1}' if i else 0}) ELSE 1 END" for i in range(len(M.BUCKETS))) + f" ELSE {M.BUCKETS[-1]} END"


@query("sm_histogram_quantile", f"WITH h AS (SELECT event_type AS metric, {_BUCKET.format(w='1 day')} AS start, count(*) AS n, {', '.join(f'count(*) FILTER (WHERE value <= {e}) AS c{i}' for i, e in enumerate(M.BUCKETS))} FROM events GROUP BY 1, 2) SELECT metric, start, n, round(CAST({_QUANTILE} AS DOUBLE), 6) AS quantile FROM h")
def sm_histogram_quantile(spark, sf_dir):
    return M.histogram_quantile(events(spark, sf_dir), "1 day", 0.95).withColumn("quantile", F.round("quantile", 6))


@query("sm_hit_rate", f"SELECT event_type AS metric, {_BUCKET.format(w='1 day')} AS start, round(count(*) FILTER (WHERE value < 50) / greatest(1, count(*)) * 100, 6) AS hit_rate FROM events GROUP BY 1, 2")
def sm_hit_rate(spark, sf_dir):
    return M.hit_rate(events(spark, sf_dir), "1 day", F.col("value") < 50).withColumn("hit_rate", F.round("hit_rate", 6))


_ALERT = f"WITH w AS (SELECT event_type AS metric, {_BUCKET.format(w='1 day')} AS start, avg(value) AS value FROM events GROUP BY 1, 2), r AS (SELECT *, value > 50 AS bad, row_number() OVER (PARTITION BY metric ORDER BY start) AS n FROM w), g AS (SELECT *, n - row_number() OVER (PARTITION BY metric ORDER BY start) AS run FROM r WHERE bad)"


@query("sm_alerts", _ALERT + " SELECT metric, min(start) AS begins, (list(start ORDER BY start))[2] AS fires, max(start) AS ends, count(*) AS windows FROM g GROUP BY metric, run HAVING count(*) >= 2")
def sm_alerts(spark, sf_dir):
    w = events(spark, sf_dir).groupBy("metric", F.window("ts", "1 day").alias("w")).agg(F.avg("value").alias("value")).select("metric", F.col("w.start").alias("start"), "value")
    return M.alerts(w, F.col("value") > 50, 2, 86_400)


@query("sm_slow_log", "SELECT event_id, value FROM events WHERE value > 5")
def sm_slow_log(spark, sf_dir):
    return events(spark, sf_dir).where("value > 5").select("event_id", "value")


@query("sm_exposition", "SELECT event_type AS metric, '# TYPE ' || event_type || ' summary' || chr(10) || event_type || '_count ' || count(*) || chr(10) AS text, round(sum(value), 3) AS total FROM events GROUP BY event_type")
def sm_exposition(spark, sf_dir):
    return M.exposition(events(spark, sf_dir))


@query("sm_sessions", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '4 hours' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id AS session_id, min(ts) AS start, max(ts) + INTERVAL '4 hours' AS \"end\", count(*) AS turns FROM s GROUP BY user_id, k")
def sm_sessions(spark, sf_dir):
    return S.sessions(events(spark, sf_dir).select(F.col("user_id").alias("session_id"), "ts"), "4 hours")


def turns(spark, sf_dir):
    ids = F.array(F.concat(F.lit("W"), (F.col("turn") % 3).cast("string")), F.concat(F.lit("W"), (F.col("conv_id") % 5).cast("string")))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.col("role").alias("query"), F.array_distinct(ids).alias("paper_ids"))


_TURNS = "t AS (SELECT conv_id AS session_id, turn AS seq, role AS query, CASE WHEN turn % 3 = conv_id % 5 THEN ['W' || (turn % 3)] ELSE ['W' || (turn % 3), 'W' || (conv_id % 5)] END AS paper_ids, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)"


@query("sm_memory", f"WITH {_TURNS} SELECT session_id, seq, CAST(max(n) OVER (PARTITION BY session_id) - n + 1 AS INTEGER) AS number FROM t WHERE n <= 3")
def sm_memory(spark, sf_dir):
    return S.memory(turns(spark, sf_dir), 3).select("session_id", "seq", "number")


@query("sm_prior_ids", f"WITH {_TURNS}, f AS (SELECT session_id, flatten(list(paper_ids ORDER BY seq DESC)) AS x FROM t WHERE n <= 10 GROUP BY 1) SELECT session_id, list_filter(x, lambda v, i: list_position(x, v) = i) AS paper_ids FROM f")
def sm_prior_ids(spark, sf_dir):
    return S.prior_ids(turns(spark, sf_dir))


@query("sm_context", f"WITH {_TURNS}, k AS (SELECT *, max(n) OVER (PARTITION BY session_id) - n + 1 AS number FROM t WHERE n <= 3) SELECT session_id, string_agg('Turn ' || number || ': ' || query || ' [' || array_to_string(list_slice(paper_ids, 1, 5), ', ') || ']', chr(10) ORDER BY number) AS context FROM k GROUP BY 1")
def sm_context(spark, sf_dir):
    return S.context(turns(spark, sf_dir))


@query("sm_turn_records", "SELECT conv_id, turn, coalesce(text, '')[1:300] AS summary FROM conversations")
def sm_turn_records(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", S.turn_of(F.col("role"), F.coalesce("text", F.lit("")), F.array(F.lit("W1"))).alias("r")).select("conv_id", "turn", F.col("r.ai_response_summary").alias("summary"))


@query("st_rate", f"SELECT event_type AS metric, {_BUCKET.format(w='6 hours')} AS start, {_BUCKET.format(w='6 hours')} + INTERVAL '6 hours' AS \"end\", count(*)::DOUBLE AS increase, count(*) / 21600 AS rate FROM events GROUP BY 1, 2, 3 HAVING {_BUCKET.format(w='6 hours')} + INTERVAL '6 hours' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)")
def st_rate(spark, sf_dir):
    """The same plan on a stream, in append mode: windows come out once the watermark has passed them."""
    return run_to_end(M.rate(events_stream(spark, sf_dir), "6 hours"))


@query("st_distinct_events", "SELECT count(*) AS n FROM events")
def st_distinct_events(spark, sf_dir):
    s = events_stream(spark, sf_dir)
    return run_to_end(s.unionByName(events_stream(spark, sf_dir)).dropDuplicatesWithinWatermark(["event_id"]).select("event_id")).agg(F.count("*").alias("n"))


@query("st_memory")
def st_memory(spark, sf_dir):
    s = events_stream(spark, sf_dir).select(F.col("user_id").alias("session_id"), "ts")
    return run_to_end(S.memory_stream(s, 240))


#: Page texts; {} is the order's number.
MARKDOWN = (
    "Intro {}\n\nTable {}: Scores of models.\n| Model {} | Acc |\n|---|:---:|\n| A | 0.{} |\n| B | 0.8 |\nEnd\n\nFigure {}. A plot of things {}.\nSecond line\n\nMore",
    "**Table {}.** Bold one\n\n| a | b{} | c |\n| --- | --- | --- |\n| 1 | 2 |\n| {} |\n| 4 | 5 | 6 |\n",
    "| only | header {} |\n| x | y |\n| no | rule |", "| one {} |\n|---|\n| 1 |", "| h | i{} |\n|---|---|\n|---|---|\n| | |\n| v | w |", "no table, no caption {}", "fig. S{}a: short {}",
)


def pages(spark, sf_dir):
    """Each order as a page: one of the texts, in turn, with its number."""
    o = table(spark, sf_dir, "orders")
    text = F.element_at(F.array(*[F.lit(m) for m in MARKDOWN]), (F.col("o_orderkey") % len(MARKDOWN) + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("page"), F.replace(text, F.lit("{}"), F.col("o_orderkey").cast("string")).alias("text"))


def of_pages(columns: str, rows: str, keys: str) -> str:
    """SQL of what is found on the pages of each text, with the order's number for {}."""
    return f"SELECT o_orderkey AS page, {columns} FROM orders JOIN (VALUES {rows}) v({keys}) ON o_orderkey % {len(MARKDOWN)} = nth"


_N = "CAST(o_orderkey AS VARCHAR)"
_TABLES = of_pages(
    f"replace(block, '{{}}', {_N}) AS block, valid, list_transform(headers, lambda h: replace(h, '{{}}', {_N})) AS headers, rows",
    "(0, '| Model {} | Acc |' || chr(10) || '|---|:---:|' || chr(10) || '| A | 0.{} |' || chr(10) || '| B | 0.8 |', true, ['Model {}', 'Acc'], 2), (1, '| a | b{} | c |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| 1 | 2 |' || chr(10) || '| {} |' || chr(10) || '| 4 | 5 | 6 |', true, ['a', 'b{}', 'c'], 3), (2, '| only | header {} |' || chr(10) || '| x | y |' || chr(10) || '| no | rule |', false, ['only', 'header {}'], 1), (3, '| one {} |' || chr(10) || '|---|' || chr(10) || '| 1 |', false, ['one {}'], 1), (4, '| h | i{} |' || chr(10) || '|---|---|' || chr(10) || '|---|---|' || chr(10) || '| | |' || chr(10) || '| v | w |', true, ['h', 'i{}'], 1)",
    "nth, block, valid, headers, rows",
)


@query("tx_tables", _TABLES)
def tx_tables(spark, sf_dir):
    b = pages(spark, sf_dir).select("page", F.explode(T.table_blocks(F.col("text"))).alias("block"))
    t = b.withColumn("t", T.parse_table(F.col("block")))
    return t.select("page", "block", T.valid_table(F.col("block")).alias("valid"), F.col("t.headers").alias("headers"), F.size("t.rows").alias("rows"))


@query("tx_captions", of_pages(f"replace(caption, '{{}}', {_N}) AS caption", "(0, 'Figure {}. A plot of things {}.' || chr(10) || 'Second line'), (1, NULL), (2, NULL), (3, NULL), (4, NULL), (5, NULL), (6, 'fig. S{}a: short {}')", "nth, caption"))
def tx_captions(spark, sf_dir):
    at = F.greatest(F.position(F.lit("Figure"), F.col("text")) - 1, F.lit(0))
    return pages(spark, sf_dir).select("page", T.caption_near_image(F.col("text"), at).alias("caption"))


@query("tx_table_captions", of_pages(f"replace(caption, '{{}}', {_N}) AS caption", "(0, 'Table {}: Scores of models.'), (1, 'Table {}.** Bold one'), (2, NULL), (3, NULL), (4, NULL)", "nth, caption"))
def tx_table_captions(spark, sf_dir):
    b = pages(spark, sf_dir).withColumn("block", F.explode(T.table_blocks(F.col("text"))))
    return b.select("page", T.caption_near_table(F.col("text"), F.col("block")).alias("caption"))


_has = lambda ws: "(" + " OR ".join(f"contains(low, '{w}')" for w in ws) + ")"


@query("tx_category_domain", f"WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS low, CASE doc_id % 5 WHEN 0 THEN 'fig_pipeline' WHEN 1 THEN 'fig_other' WHEN 2 THEN 'tab_other' WHEN 3 THEN 'tab_config' ELSE 'config' END AS label FROM documents) SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'figure_architecture' WHEN 3 THEN 'table_parameter' WHEN 1 THEN CASE WHEN {_has(T.RESULT_WORDS)} THEN 'figure_result' WHEN {_has(T.ARCHITECTURE_WORDS)} THEN 'figure_architecture' ELSE 'figure_illustration' END WHEN 2 THEN CASE WHEN {_has(T.PARAMETER_WORDS)} THEN 'table_parameter' ELSE 'table_result' END ELSE 'figure_result' END AS category, CASE WHEN {_has(T.DOMAINS[0][1])} THEN 'biomedical' WHEN {_has(T.DOMAINS[1][1])} THEN 'cs' WHEN {_has(T.DOMAINS[2][1])} THEN 'physics' ELSE 'general' END AS domain FROM d")
def tx_category_domain(spark, sf_dir):
    k = F.col("doc_id") % 5
    label = F.when(k == 0, "fig_pipeline").when(k == 1, "fig_other").when(k == 2, "tab_other").when(k == 3, "tab_config").otherwise("config")
    d = table(spark, sf_dir, "documents").withColumn("label", label)
    return d.select("doc_id", T.category(F.col("label"), F.col("text")).alias("category"), T.domain(F.col("text")).alias("domain"))


@query("tx_cache_keys", "SELECT conv_id, turn, md5(lower(trim(coalesce(text, ''))) || '|k:10|role:' || role) AS key FROM conversations")
def tx_cache_keys(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", T.cache_key(F.coalesce("text", F.lit("")), F.create_map(F.lit("role"), F.col("role"), F.lit("k"), F.lit("10"))).alias("key"))


@query("tx_image_hashes")
def tx_image_hashes(spark, sf_dir):
    px = F.expr("unhex(repeat(substring(md5(text), 1, 32), 64))")
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", px.alias("pixels")).withColumn("hash", T.hash_bits(F.col("pixels")))
    return d.select("doc_id", "hash", T.hash_distance(F.col("hash"), F.array_repeat(F.lit(0).cast("long"), 16)).alias("ones"))


@query("tx_page_parts")
def tx_page_parts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("paper_id"), (F.col("doc_id") % 3).alias("page"), F.col("doc_id").alias("image_id"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("area"), F.array(F.xxhash64("source")).alias("hash"))
    return T.drop_parts(d)


@query("tx_first_images", "SELECT paper_id, image_id FROM (SELECT source AS paper_id, doc_id AS image_id, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) AS n FROM documents WHERE strlen(text) >= 2048 AND n_chars % 500 >= 100) WHERE n = 1")
def tx_first_images(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("paper_id"), F.col("doc_id").alias("image_id"), F.encode("text", "UTF-8").alias("data"), (F.col("n_chars") % 500).alias("width"), F.lit(100).alias("height"))
    return T.first_images(d).select("paper_id", "image_id")


@query("tx_cap_per_paper", "WITH k AS (SELECT o_custkey AS paper_id, o_orderkey AS id, year(o_orderdate) AS page, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) SELECT paper_id, id, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY page, id) AS INTEGER) AS number FROM k WHERE n <= 10")
def tx_cap_per_paper(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("paper_id"), F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("page"), F.lit(1).alias("number"), F.col("o_totalprice").alias("area"))
    return T.cap_per_paper(o).select("paper_id", "id", "number")


@query("fl_report", "SELECT doc_id, '| ' || doc_id || ' | ' || replace(regexp_replace(coalesce(text, '')[1:100], '\\s*\\n\\s*', ' ', 'g'), '|', '\\|') || ' |' AS line FROM documents")
def fl_report(spark, sf_dir):
    r = files.report_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), {"doc_id": 20, "text": 100})
    return r.select(F.col("doc_id").cast("long").alias("doc_id"), files.markdown_row(["doc_id", "text"]).alias("line"))


@query("fl_templates", "SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'new' ELSE 'old' END AS text FROM nation WHERE n_name <> (SELECT min(n_name) FROM nation)")
def fl_templates(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    old = n.select(F.col("n_name").alias("name"), F.lit("old").alias("text"), F.col("n_nationkey").alias("created_at"))
    saved = files.save_templates(old, old.where("created_at % 2 = 0").withColumn("text", F.lit("new")))
    first = n.agg(F.min("n_name")).first()[0]
    return files.delete_template(saved, first).select("name", "text")


@query("fl_mock_samples", "SELECT 'mock_' || i AS sample_id, ['fig_result', 'fig_architecture', 'tab_result', 'tab_parameter'][i % 4 + 1] AS class_label, 'Sample text ' || i AS text FROM range(50) r(i)")
def fl_mock_samples(spark, sf_dir):
    return files.mock_samples(spark, 50)


@query("fl_cursor_batch", "SELECT 'W' || i AS id, 'Work ' || i AS title, i % 7 AS cited_by_count FROM range(55) r(i)")
def fl_cursor_batch(spark, sf_dir):
    from ..sources.cursor import CursorSource

    spark.dataSource.register(CursorSource)
    return spark.read.format("paged").option("count", "55").load().select("id", "title", "cited_by_count")


@query("fl_cursor_stream", "SELECT 'W' || i AS id, i % 7 AS cited_by_count FROM range(60) r(i)")
def fl_cursor_stream(spark, sf_dir):
    from ..sources.cursor import CursorSource

    spark.dataSource.register(CursorSource)
    return run_to_end(spark.readStream.format("paged").load().select("id", "cited_by_count"), paged=True)


@query("cp_hybrid_search")
def cp_hybrid_search(spark, sf_dir):
    return H.hybrid(star_graph(spark, sf_dir), questions(spark, sf_dir), 10)


@query("cp_graph_candidates", """WITH RECURSIVE dummy AS (SELECT 1), p AS (SELECT 'W' || o_orderkey AS id, lower('Order ' || o_orderkey || ' ' || o_orderpriority || CASE WHEN o_orderkey % 5 <> 0 THEN chr(10) || 'Status ' || o_orderstatus || ' for customer ' || o_custkey ELSE '' END) AS t, year(o_orderdate) AS y, o_orderkey, o_custkey FROM orders)
SELECT 1 AS query_id, id FROM p WHERE id IN ('W7', 'W33') OR contains(t, 'urgent') UNION SELECT 2, id FROM p WHERE y >= 1995 AND y < 1997 OR o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE contains(lower(n_name), 'nation_1')) UNION SELECT 3, 'W' || l_orderkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE contains(lower(s_name), '00000003') UNION SELECT 3, 'W' || l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE contains(lower(p_brand), '#12')""")
def cp_graph_candidates(spark, sf_dir):
    rows = [(1, (["W7", "W33"], [], ["Urgent"], None, None, None, None, None)), (2, ([], [], [], None, "1995", "1997", "NATION_1", None)), (3, ([], ["00000003"], [], None, None, None, None, "#12"))]
    e = spark.createDataFrame(rows, "query_id int, entities struct<paper_ids:array<string>,author_names:array<string>,keywords:array<string>,year:string,year_from:string,year_to:string,venue:string,institution:string>")
    return H.graph_candidates(star_graph(spark, sf_dir), e)
