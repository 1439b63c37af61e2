"""Trends, features, label statistics, significance tests, evaluation summaries and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as S
from ..sources.graph import star_graph, table
from . import query
from .sql import graph

#: Orders as a bibliographic frame: the year moves the order dates into 2011 to 2024, lines are the influential citations.
PAPERS_SQL = """
pf AS (SELECT o_orderkey AS paper_id, o_orderpriority AS title, CASE WHEN o_orderkey % 4 <> 0 THEN repeat(o_orderstatus || ' about data ', CAST(o_orderkey % 6 AS INTEGER)) END AS abstract, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(year(o_orderdate) + o_orderkey % 7 + 19 AS INTEGER) END AS year,
  CAST(floor(o_totalprice) AS BIGINT) AS citation_count, coalesce(n, 0) AS influential_citation_count, CASE WHEN a > 0 THEN CAST(a AS INTEGER) ELSE 0 END AS author_count, list_slice(['a', 'b', 'c', 'd'], 1, CAST(o_orderkey % 5 AS INTEGER)) AS fields_of_study, CASE WHEN o_custkey % 9 > 0 THEN 'venue' || (o_custkey % 9) ELSE '' END AS venue
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_suppkey) AS a FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)
"""


def paper_frame(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("a"))
    k = F.col("o_orderkey")
    return o.join(lines, "o_orderkey", "left").select(
        k.alias("paper_id"), F.col("o_orderpriority").alias("title"), F.when(k % 4 != 0, F.expr("repeat(o_orderstatus || ' about data ', cast(o_orderkey % 6 as int))")).alias("abstract"),
        F.when(k % 50 != 0, F.year("o_orderdate") + k % 7 + 19).cast("int").alias("year"), F.floor("o_totalprice").cast("bigint").alias("citation_count"), F.coalesce("n", F.lit(0)).cast("bigint").alias("influential_citation_count"),
        F.coalesce("a", F.lit(0)).cast("int").alias("author_count"), F.expr("slice(array('a', 'b', 'c', 'd'), 1, cast(o_orderkey % 5 as int))").alias("fields_of_study"), F.when(F.col("o_custkey") % 9 > 0, F.concat(F.lit("venue"), (F.col("o_custkey") % 9).cast("string"))).otherwise("").alias("venue"),
    )


_FEATURES = """SELECT paper_id, round(CASE WHEN citation_count > 0 THEN influential_citation_count / citation_count ELSE 0 END, 6) AS influence_ratio, coalesce(year BETWEEN 1950 AND 2024, false) AS year_valid,
  round(CASE WHEN year BETWEEN 1950 AND 2024 THEN (year - 1950) / 74.0::DOUBLE ELSE 0 END, 6) AS recency_score, round(citation_count / max(citation_count) OVER (), 6) AS normalized_citations,
  round(0.7::DOUBLE * (citation_count / max(citation_count) OVER ()) + 0.3::DOUBLE * CASE WHEN year BETWEEN 1950 AND 2024 THEN (year - 1950) / 74.0::DOUBLE ELSE 0 END, 6) AS impact_score, CAST(length(trim(title)) AS INTEGER) AS title_length,
  length(coalesce(abstract, '')) > 50 AS has_abstract, CAST(length(coalesce(abstract, '')) AS INTEGER) AS abstract_length, author_count = 1 AS is_single_author, author_count > 3 AS is_collaboration, CAST(len(fields_of_study) AS INTEGER) AS field_count, len(fields_of_study) > 2 AS is_interdisciplinary, venue <> '' AS has_venue FROM pf"""


@query("an_paper_features", f"WITH {PAPERS_SQL} {_FEATURES}")
def an_paper_features(spark, sf_dir):
    f = S.paper_features(paper_frame(spark, sf_dir))
    r = [F.round(c, 6).alias(c) for c in ("influence_ratio", "recency_score", "normalized_citations", "impact_score")]
    return f.select("paper_id", *r, "year_valid", "title_length", "has_abstract", "abstract_length", "is_single_author", "is_collaboration", "field_count", "is_interdisciplinary", "has_venue")


@query("an_trends", f"WITH {PAPERS_SQL} SELECT count(*) AS total_papers, count(*) FILTER (WHERE year >= 2019) AS recent_papers, round(avg(citation_count), 4) AS avg_citations_all, round(coalesce(avg(citation_count) FILTER (WHERE year >= 2019), 0), 4) AS avg_citations_recent FROM pf WHERE year > 1950")
def an_trends(spark, sf_dir):
    return S.trends(paper_frame(spark, sf_dir)).select("total_papers", "recent_papers", F.round("avg_citations_all", 4).alias("avg_citations_all"), F.round("avg_citations_recent", 4).alias("avg_citations_recent"))


@query("an_yearly_counts", f"WITH {PAPERS_SQL} SELECT year, count(*) AS n FROM pf WHERE year IS NOT NULL GROUP BY 1")
def an_yearly_counts(spark, sf_dir):
    return S.counts(paper_frame(spark, sf_dir), "year")


@query("an_top_venues", f"WITH {PAPERS_SQL} SELECT venue, count(*) AS n FROM pf GROUP BY 1 ORDER BY n DESC, venue LIMIT 5")
def an_top_venues(spark, sf_dir):
    return S.counts(paper_frame(spark, sf_dir), "venue", 5)


@query("an_top_cited", f"WITH {PAPERS_SQL} SELECT paper_id, year, citation_count FROM pf WHERE year >= 2019 ORDER BY citation_count DESC, paper_id LIMIT 5")
def an_top_cited(spark, sf_dir):
    return paper_frame(spark, sf_dir).where("year >= 2019").orderBy(F.desc("citation_count"), "paper_id").limit(5).select("paper_id", "year", "citation_count")


@query("an_influential", f"WITH {PAPERS_SQL} SELECT paper_id, influential_citation_count FROM pf WHERE influential_citation_count >= 5 AND year >= 2018")
def an_influential(spark, sf_dir):
    return paper_frame(spark, sf_dir).where("influential_citation_count >= 5 and year >= 2018").select("paper_id", "influential_citation_count")


@query("an_research_summary", f"WITH {PAPERS_SQL}, pk AS (SELECT year FROM pf WHERE year IS NOT NULL GROUP BY year ORDER BY count(*) DESC, year LIMIT 1) SELECT count(*) AS total_papers, min(year) AS first_year, max(year) AS last_year, CAST(sum(citation_count) AS BIGINT) AS total_citations, round(avg(citation_count), 4) AS avg_citations, median(citation_count) AS median_citations, max(citation_count) AS max_citations, count(*) FILTER (WHERE citation_count > 0) AS papers_with_citations, count(*) FILTER (WHERE influential_citation_count >= 10) AS highly_influential_papers, count(*) FILTER (WHERE year >= 2020) AS recent_papers_count, round(avg(author_count), 4) AS avg_authors_per_paper, count(*) FILTER (WHERE author_count = 1) AS single_author_papers, count(*) FILTER (WHERE author_count >= 5) AS large_collaborations, round(count(*) FILTER (WHERE author_count > 1) / count(*), 6) AS collaboration_rate, (SELECT year FROM pk) AS peak_year FROM pf")
def an_research_summary(spark, sf_dir):
    s = S.summary(paper_frame(spark, sf_dir))
    return s.withColumns({"avg_citations": F.round("avg_citations", 4), "avg_authors_per_paper": F.round("avg_authors_per_paper", 4), "collaboration_rate": F.round("collaboration_rate", 6)})


@query("an_collaborations", graph("SELECT a.name AS author1, b.name AS author2, count(*) AS collaboration_count, CAST(sum(cited_by_count) AS BIGINT) AS total_citations, round(avg(cited_by_count), 2) AS avg_citations FROM (SELECT paper_id, name FROM authored JOIN authors ON author_id = id) a JOIN (SELECT paper_id, name FROM authored JOIN authors ON author_id = id) b ON a.paper_id = b.paper_id AND a.name < b.name JOIN papers p ON p.id = a.paper_id GROUP BY 1, 2"))
def an_collaborations(spark, sf_dir):
    from ..operators.graph import author_names

    g = star_graph(spark, sf_dir)
    rows = author_names(g).join(g.papers.select(F.col("id").alias("paper_id"), F.col("cited_by_count").alias("citation_count")), "paper_id")
    return S.collaborations(rows.withColumnRenamed("authors", "author_names"))


_STOPS = ", ".join(f"'{w}'" for w in S.ABSTRACT_STOP_WORDS)


@query("an_keywords", rf"SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_matches(w, '^[a-z]{{4,}}$'))) AS word FROM documents WHERE length(text) > 50) WHERE NOT list_contains([{_STOPS}], word) GROUP BY 1 ORDER BY n DESC, word LIMIT 50")
def an_keywords(spark, sf_dir):
    return S.word_counts(table(spark, sf_dir, "documents"), "text")


@query("an_citation_context_words", r"SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: regexp_matches(w, '^[a-z]{4,}$'))) AS word FROM conversations WHERE length(text) > 10) GROUP BY 1")
def an_citation_context_words(spark, sf_dir):
    return S.word_counts(table(spark, sf_dir, "conversations"), "text", 10, ["-"], k=None)


_LABEL_TEXT = "CASE doc_id % 5 WHEN 0 THEN 'No verification' WHEN 1 THEN 'SUPPORTED:' || (doc_id % 4) || ', NO_EVIDENCE:' || (doc_id % 3) WHEN 2 THEN 'CONTRADICTED:' || (doc_id % 3) || ', NO_EVIDENCE:2' WHEN 3 THEN 'SUPPORTED:' || (doc_id % 7) || ', CONTRADICTED:1, NO_EVIDENCE:' || (doc_id % 2) END"
LABELLED_SQL = f"""lt AS (SELECT doc_id, source, lang, n_chars, {_LABEL_TEXT} AS txt FROM documents),
lc AS (SELECT *, coalesce(CAST(nullif(regexp_extract(txt, 'SUPPORTED:(\\d+)', 1), '') AS INTEGER), 0) AS s, coalesce(CAST(nullif(regexp_extract(txt, 'CONTRADICTED:(\\d+)', 1), '') AS INTEGER), 0) AS c, coalesce(CAST(nullif(regexp_extract(txt, 'NO_EVIDENCE:(\\d+)', 1), '') AS INTEGER), 0) AS n FROM lt),
lp AS (SELECT *, s + c + n AS total, CASE WHEN s + c + n > 0 THEN s * 100.0::DOUBLE / (s + c + n) ELSE 0 END AS sp, CASE WHEN s + c + n > 0 THEN c * 100.0::DOUBLE / (s + c + n) ELSE 0 END AS cp, CASE WHEN s + c + n > 0 THEN n * 100.0::DOUBLE / (s + c + n) ELSE 0 END AS np, CASE WHEN s >= c AND s >= n THEN 'SUPPORTED' WHEN c >= n THEN 'CONTRADICTED' ELSE 'NO_EVIDENCE' END AS dom FROM lc)"""


def labelled(spark, sf_dir):
    d, r = table(spark, sf_dir, "documents"), F.col("doc_id")
    text = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    txt = F.when(r % 5 == 0, "No verification").when(r % 5 == 1, text("SUPPORTED:", r % 4, ", NO_EVIDENCE:", r % 3)).when(r % 5 == 2, text("CONTRADICTED:", r % 3, ", NO_EVIDENCE:2")).when(r % 5 == 3, text("SUPPORTED:", r % 7, ", CONTRADICTED:1, NO_EVIDENCE:", r % 2))
    return d.select("doc_id", "source", "lang", "n_chars", S.label_counts(txt).alias("l")).select("doc_id", "source", "lang", "n_chars", "l.*")


@query("an_label_counts", f"WITH {LABELLED_SQL} SELECT doc_id, s AS supported, c AS contradicted, n AS no_evidence, total AS total_claims, round(sp, 6) AS supported_pct, round(cp, 6) AS contradicted_pct, round(np, 6) AS no_evidence_pct, dom AS dominant_label, round(CASE WHEN CAST(s > 0 AS INTEGER) + CAST(c > 0 AS INTEGER) + CAST(n > 0 AS INTEGER) > 1 THEN -(CASE WHEN s > 0 THEN s / total * log2(s / total) ELSE 0 END + CASE WHEN c > 0 THEN c / total * log2(c / total) ELSE 0 END + CASE WHEN n > 0 THEN n / total * log2(n / total) ELSE 0 END) ELSE 0 END, 6) AS label_diversity FROM lp")
def an_label_counts(spark, sf_dir):
    r = labelled(spark, sf_dir)
    return r.select("doc_id", "supported", "contradicted", "no_evidence", "total_claims", *[F.round(c, 6).alias(c) for c in ("supported_pct", "contradicted_pct", "no_evidence_pct")], "dominant_label", F.round("label_diversity", 6).alias("label_diversity"))


@query("an_label_format", "SELECT conv_id, CASE WHEN s + c + n = 0 THEN 'No verification' ELSE array_to_string(list_filter([CASE WHEN s > 0 THEN 'SUPPORTED:' || s END, CASE WHEN c > 0 THEN 'CONTRADICTED:' || c END, CASE WHEN n > 0 THEN 'NO_EVIDENCE:' || n END], lambda x: x IS NOT NULL), ', ') END AS labels FROM (SELECT conv_id, count(*) FILTER (WHERE turn % 4 = 0) AS s, count(*) FILTER (WHERE turn % 4 = 1) AS c, count(*) FILTER (WHERE turn % 4 = 2) AS n FROM conversations GROUP BY 1)")
def an_label_format(spark, sf_dir):
    label = F.when(F.col("turn") % 4 == 0, "supported").when(F.col("turn") % 4 == 1, "CONTRADICTED").when(F.col("turn") % 4 == 2, "NO_EVIDENCE").otherwise("?")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(label).alias("l")).select("conv_id", S.format_labels(F.col("l")).alias("labels"))


@query("an_crosstab", f"WITH {LABELLED_SQL} SELECT lang, count(*) FILTER (WHERE dom = 'SUPPORTED') AS SUPPORTED, count(*) FILTER (WHERE dom = 'CONTRADICTED') AS CONTRADICTED, count(*) FILTER (WHERE dom = 'NO_EVIDENCE') AS NO_EVIDENCE FROM lp GROUP BY 1")
def an_crosstab(spark, sf_dir):
    return S.crosstab(labelled(spark, sf_dir), "lang", "dominant_label", S.LABELS)


@query("an_equal_bins", "WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT bin, count(*) AS n FROM (SELECT CAST(least(greatest(ceil((o_totalprice - lo) / ((hi - lo) / 5)) - 1, 0), 4) AS INTEGER) AS bin FROM orders, e) GROUP BY 1")
def an_equal_bins(spark, sf_dir):
    return S.equal_bins(table(spark, sf_dir, "orders"), "o_totalprice").groupBy("bin").agg(F.count("*").alias("n"))


@query("an_correlations", "SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem")
def an_correlations(spark, sf_dir):
    return S.correlations(table(spark, sf_dir, "lineitem"), ("l_quantity", "l_extendedprice", "l_discount")).withColumn("r", F.round("r", 6))


_RANKS = "SELECT *, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {r} FROM {t}"


@query("an_spearman", f"WITH a AS ({_RANKS.format(c='l_quantity', r='ra', t='lineitem')}), b AS ({_RANKS.format(c='l_extendedprice', r='rb', t='a')}) SELECT round(corr(ra, rb), 6) AS rho FROM b")
def an_spearman(spark, sf_dir):
    return S.spearman(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice").withColumn("rho", F.round("rho", 6))


@query("an_chi_square", f"WITH {LABELLED_SQL}, x AS (SELECT lang, dom, count(*) AS n FROM lp GROUP BY 1, 2), g AS (SELECT r.lang, k.dom, nr * nc / (SELECT count(*) FROM lp) AS e, coalesce(n, 0) AS n FROM (SELECT lang, sum(n) AS nr FROM x GROUP BY 1) r CROSS JOIN (SELECT dom, sum(n) AS nc FROM x GROUP BY 1) k LEFT JOIN x ON x.lang = r.lang AND x.dom = k.dom) SELECT round(sum((n - e) * (n - e) / e), 4) AS chi2, CAST((count(DISTINCT lang) - 1) * (count(DISTINCT dom) - 1) AS BIGINT) AS dof FROM g")
def an_chi_square(spark, sf_dir):
    return S.chi_square(labelled(spark, sf_dir), "lang", "dominant_label").select(F.round("chi2", 4).alias("chi2"), "dof")


@query("an_mann_whitney", f"WITH r AS ({_RANKS.format(c='o_totalprice', r='rk', t='orders')}) SELECT round(sum(rk) FILTER (WHERE o_orderstatus = 'F') - count(*) FILTER (WHERE o_orderstatus = 'F') * (count(*) FILTER (WHERE o_orderstatus = 'F') + 1) / 2, 1) AS u FROM r")
def an_mann_whitney(spark, sf_dir):
    return S.mann_whitney(table(spark, sf_dir, "orders"), "o_totalprice", F.col("o_orderstatus") == "F").select(F.round("u", 1).alias("u"))


@query("an_anova", "WITH g AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1), t AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) / sum(n) AS mean, sum((n - 1) * v) AS w FROM g) SELECT round((SELECT sum(g.n * (g.m - t.mean) * (g.m - t.mean)) FROM g) / (k - 1) / (w / (n - k)), 4) AS f, k - 1 AS df1, CAST(n - k AS BIGINT) AS df2 FROM t")
def an_anova(spark, sf_dir):
    return S.anova(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority").select(F.round("f", 4).alias("f"), "df1", "df2")


@query("an_cohens_d", "SELECT round((avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') - avg(o_totalprice) FILTER (WHERE o_orderstatus <> 'F')) / sqrt(((count(*) FILTER (WHERE o_orderstatus = 'F') - 1) * var_samp(o_totalprice) FILTER (WHERE o_orderstatus = 'F') + (count(*) FILTER (WHERE o_orderstatus <> 'F') - 1) * var_samp(o_totalprice) FILTER (WHERE o_orderstatus <> 'F')) / (count(*) - 2)), 6) AS d FROM orders")
def an_cohens_d(spark, sf_dir):
    return S.cohens_d(table(spark, sf_dir, "orders"), "o_totalprice", F.col("o_orderstatus") == "F").withColumn("d", F.round("d", 6))


@query("an_median_split", "WITH m AS (SELECT median(o_totalprice) AS m FROM orders) SELECT o_totalprice >= m AS high, count(*) AS n FROM orders, m GROUP BY 1")
def an_median_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    middle = S.quantiles(o, "o_totalprice", [0.5]).select(F.get("q", F.lit(0)).alias("m"))
    return o.crossJoin(F.broadcast(middle)).groupBy((F.col("o_totalprice") >= F.col("m")).alias("high")).agg(F.count("*").alias("n"))


@query("an_trend_line", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem")
def an_trend_line(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 3).alias("intercept"))


@query("an_boxplot", "SELECT o_orderpriority, min(o_totalprice) AS lo, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS q2, round(quantile_cont(o_totalprice, 0.75), 4) AS q3, max(o_totalprice) AS hi FROM orders GROUP BY 1")
def an_boxplot(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ends = o.groupBy("o_orderpriority").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    quarters = S.quantiles(o, "o_totalprice", [0.25, 0.5, 0.75], ["o_orderpriority"]).select("o_orderpriority", *[F.round(F.get("q", F.lit(i)), 4).alias(f"q{i + 1}") for i in range(3)])
    return ends.join(quarters, "o_orderpriority")


@query("an_log_histogram", f"WITH {PAPERS_SQL}, l AS (SELECT ln(1 + citation_count) AS x FROM pf), e AS (SELECT min(x) AS lo, max(x) AS hi FROM l) SELECT CAST(least(floor((x - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin, count(*) AS n FROM l, e GROUP BY 1")
def an_log_histogram(spark, sf_dir):
    x = paper_frame(spark, sf_dir).select(F.log1p(F.col("citation_count").cast("double")).alias("x"))
    edges = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = F.least(F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 30)), F.lit(29)).cast("int")
    return x.crossJoin(F.broadcast(edges)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


@query("an_shares", f"WITH {PAPERS_SQL} SELECT round(avg(CASE WHEN citation_count >= 100000 THEN 1.0::DOUBLE ELSE 0 END), 6) AS highly_cited, round(avg(CASE WHEN venue = '' THEN 1.0::DOUBLE ELSE 0 END), 6) AS without_venue FROM pf")
def an_shares(spark, sf_dir):
    return paper_frame(spark, sf_dir).agg(F.round(F.avg((F.col("citation_count") >= 100000).cast("double")), 6).alias("highly_cited"), F.round(F.avg((F.col("venue") == "").cast("double")), 6).alias("without_venue"))


@query("an_author_count_distribution", f"WITH {PAPERS_SQL} SELECT author_count, count(*) AS n FROM pf GROUP BY 1")
def an_author_count_distribution(spark, sf_dir):
    return S.counts(paper_frame(spark, sf_dir), "author_count")


@query("an_group_means", f"WITH {PAPERS_SQL} SELECT venue <> '' AS has_venue, round(avg(citation_count), 4) AS mean_citations FROM pf GROUP BY 1")
def an_group_means(spark, sf_dir):
    return paper_frame(spark, sf_dir).groupBy((F.col("venue") != "").alias("has_venue")).agg(F.round(F.avg("citation_count"), 4).alias("mean_citations"))


@query("an_id_frequency", graph("SELECT dst_id, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM cites), 6) AS pct FROM cites GROUP BY 1 ORDER BY n DESC, dst_id LIMIT 15"))
def an_id_frequency(spark, sf_dir):
    c = star_graph(spark, sf_dir).cites
    top = c.groupBy("dst_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst_id").limit(15)
    return top.crossJoin(F.broadcast(c.agg(F.count("*").alias("t")))).select("dst_id", "n", F.round(F.col("n") * 100.0 / F.col("t"), 6).alias("pct"))


RESULTS_SQL = """rs AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'neo4j' WHEN 1 THEN 'semantic' ELSE 'other' END AS question_type, o_orderpriority AS category, o_orderkey % 4 > 0 AS success, (o_orderkey % 100) / 10 AS response_time, (o_orderkey % 11) / 10 AS precision, (o_orderkey % 6) / 5 AS recall, CASE WHEN o_orderkey % 8 > 0 THEN (o_orderkey % 5) / 4 END AS dcg FROM orders)"""


def evaluation_rows(spark, sf_dir):
    k = F.col("o_orderkey")
    d = F.when(k % 8 > 0, (k % 5) / 4)
    return table(spark, sf_dir, "orders").select(
        F.when(k % 3 == 0, "neo4j").when(k % 3 == 1, "semantic").otherwise("other").alias("question_type"), F.col("o_orderpriority").alias("category"), (k % 4 > 0).alias("success"), ((k % 100) / 10).alias("response_time"), ((k % 11) / 10).alias("precision"), ((k % 6) / 5).alias("recall"), ((k % 6) / 5).alias("f1_score"),
        *[d.alias(c) for c in ("dcg_at_5", "dcg_at_10", "ndcg_at_5", "ndcg_at_10")],
    )


_EVAL = "count(*) AS total, count(*) FILTER (WHERE success) AS successful, round(count(*) FILTER (WHERE success) / count(*), 6) AS success_rate, round(avg(response_time), 6) AS avg_response_time, round(coalesce(avg(precision) FILTER (WHERE success), 0), 6) AS precision, round(coalesce(avg(recall) FILTER (WHERE success), 0), 6) AS recall, round(coalesce(avg(dcg) FILTER (WHERE success), 0), 6) AS ndcg_at_5 FROM rs"


@query("ev_summary", f"WITH {RESULTS_SQL} SELECT 'overall' AS level, 'all' AS name, {_EVAL} UNION ALL SELECT 'type', question_type, {_EVAL} WHERE question_type <> 'other' GROUP BY question_type UNION ALL SELECT 'category', category, {_EVAL} GROUP BY category")
def ev_summary(spark, sf_dir):
    s = S.evaluation_summary(evaluation_rows(spark, sf_dir))
    return s.select("level", "name", "total", "successful", *[F.round(c, 6).alias(c) for c in ("success_rate", "avg_response_time", "precision", "recall", "ndcg_at_5")])


@query("an_profile", "SELECT 'doc_id' AS column, 'bigint' AS type, count(*) FILTER (WHERE doc_id IS NULL) AS nulls, round(count(*) FILTER (WHERE doc_id IS NULL) * 100.0::DOUBLE / count(*), 6) AS pct FROM documents UNION ALL SELECT 'text', 'string', count(*) FILTER (WHERE text IS NULL), round(count(*) FILTER (WHERE text IS NULL) * 100.0::DOUBLE / count(*), 6) FROM documents UNION ALL SELECT 'lang', 'string', count(*) FILTER (WHERE lang IS NULL), round(count(*) FILTER (WHERE lang IS NULL) * 100.0::DOUBLE / count(*), 6) FROM documents UNION ALL SELECT 'source', 'string', count(*) FILTER (WHERE source IS NULL), round(count(*) FILTER (WHERE source IS NULL) * 100.0::DOUBLE / count(*), 6) FROM documents UNION ALL SELECT 'n_chars', 'bigint', count(*) FILTER (WHERE n_chars IS NULL), round(count(*) FILTER (WHERE n_chars IS NULL) * 100.0::DOUBLE / count(*), 6) FROM documents")
def an_profile(spark, sf_dir):
    return S.profile(table(spark, sf_dir, "documents")).withColumn("pct", F.round("pct", 6))


@query("an_duplicates", "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey)")
def an_duplicates(spark, sf_dir):
    return S.duplicates(table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey"))


@query("an_llm_usage", "SELECT event_type AS purpose, count(*) AS calls, round(sum(value), 4) AS total_seconds, count(*) FILTER (WHERE value >= 90) AS errors, round(avg(value), 6) AS avg_seconds FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000) GROUP BY 1")
def an_llm_usage(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("ts", F.col("event_id").alias("call_id"), F.col("event_type").alias("purpose"), F.col("value").alias("seconds"), (F.col("value") < 90).alias("ok"))
    return S.usage(e).select("purpose", "calls", F.round("total_seconds", 4).alias("total_seconds"), "errors", F.round("avg_seconds", 6).alias("avg_seconds"))


@query("an_model_rank", "WITH b AS (SELECT avg(o_totalprice) AS s FROM orders GROUP BY o_custkey) SELECT 1 + count(*) FILTER (WHERE s > 150000) AS rank, count(*) + 1 AS of, round((count(*) + 1 - (1 + count(*) FILTER (WHERE s > 150000)) + 1) / (count(*) + 1) * 100, 6) AS percentile FROM b")
def an_model_rank(spark, sf_dir):
    b = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("score"))
    return S.rank_among(150000.0, b).withColumn("percentile", F.round("percentile", 6))


@query("an_cache_hit_rate", "SELECT event_type, round(count(*) FILTER (WHERE value < 50) / greatest(1, count(*)) * 100, 6) AS hit_rate FROM events GROUP BY 1")
def an_cache_hit_rate(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.count_if(F.col("value") < 50) / F.greatest(F.lit(1), F.count("*")) * 100, 6).alias("hit_rate"))
