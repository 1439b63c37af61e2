"""Guardrails, entity extraction and routing of natural-language questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import query_text as Q
from ..sources.queries import questions, questions_sql
from ..sources.graph import table
from . import query

WITH = "WITH " + questions_sql()
_lit = lambda p: "'" + p.replace("'", "''") + "'"
_hit = lambda c, ps: "(" + " OR ".join(f"regexp_matches({c}, {_lit(p)}, 'i')" for p in ps) + ")"
BLANK = "(query IS NULL OR regexp_replace(query, '\\s+', '', 'g') = '')"


def _sanitize_sql() -> str:
    steps = [f"s0 AS (SELECT query_id, query, length(query) > 1000 AS w1, substr(query, 1, 1000) AS short, regexp_replace(substr(query, 1, 1000), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g') AS q0 FROM questions)"]
    for k, p in enumerate(Q.FILTERED):
        steps.append(f"s{k + 1} AS (SELECT *, regexp_matches(q{k}, {_lit(p)}, 'i') AS f{k}, regexp_replace(q{k}, {_lit(p)}, '[FILTERED]', 'gi') AS q{k + 1} FROM s{k})")
    n = len(Q.FILTERED)
    warn = ", ".join([f"CASE WHEN w1 THEN '{Q.TRUNCATED}' END", f"CASE WHEN q0 <> short THEN '{Q.CONTROLS}' END", *[f"CASE WHEN f{k} THEN '{Q.INJECTION}' END" for k in range(n)]])
    status = f"CASE WHEN {BLANK} THEN 'empty' WHEN {_hit('q0', Q.REJECTED)} THEN 'rejected' ELSE 'ok' END"
    return f"{WITH}, {', '.join(steps)}, t AS (SELECT *, {status} AS status FROM s{n}) SELECT query_id, status, CASE WHEN status = 'ok' THEN regexp_replace(q{n}, '^\\s+|\\s+$', '', 'g') END AS query, CASE WHEN status = 'ok' THEN list_filter([{warn}], lambda x: x IS NOT NULL) END AS warnings FROM t"


@query("nlq_sanitize", _sanitize_sql())
def nlq_sanitize(spark, sf_dir):
    return questions(spark, sf_dir).select("query_id", Q.sanitize(F.col("query")).alias("s")).select("query_id", "s.*")


@query("nlq_paper_ids", WITH + r" SELECT query_id, regexp_extract_all(query, '\b(W\d+)\b', 1) AS paper_ids FROM questions")
def nlq_paper_ids(spark, sf_dir):
    return questions(spark, sf_dir).select("query_id", Q.paper_ids(F.col("query")).alias("paper_ids"))


@query("nlq_author_names")
def nlq_author_names(spark, sf_dir):
    return questions(spark, sf_dir).select("query_id", Q.author_names(F.col("query")).alias("author_names"))


_STOP = ", ".join(f"'{w}'" for w in Q.STOP_WORDS)


@query("nlq_keywords", WITH + rf""", w AS (
  SELECT query_id, query, list_filter(regexp_split_to_array(regexp_replace(lower(query), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 2 AND NOT list_contains([{_STOP}], w) AND NOT regexp_matches(w, '^\d+$') AND NOT regexp_matches(w, '^w\d+$'))
    || CASE WHEN {BLANK} THEN [] ELSE [regexp_replace(query, '^\s+|\s+$', '', 'g')] END AS k FROM questions)
SELECT query_id, list_filter(k, lambda x, i: list_position(k, x) = i) AS keywords FROM w""")
def nlq_keywords(spark, sf_dir):
    return questions(spark, sf_dir).select("query_id", Q.keywords(F.col("query")).alias("keywords"))


_YEARS = r"""y AS (SELECT *, nullif(regexp_extract(query, '\b(since|after|from)\s+(\d{4})\b', 2, 'i'), '') AS since, nullif(regexp_extract(query, '\b(before|until|up\s+to)\s+(\d{4})\b', 2, 'i'), '') AS upto,
  nullif(regexp_extract(query, '\b(\d{4})\s*[-–to]+\s*(\d{4})\b', 1), '') AS lo, nullif(regexp_extract(query, '\b(\d{4})\s*[-–to]+\s*(\d{4})\b', 2), '') AS hi,
  coalesce(nullif(regexp_extract(query, '\b(in|year)\s+(\d{4})\b', 2, 'i'), ''), nullif(regexp_extract(query, '\b(20\d{2})\b', 1), '')) AS one FROM questions)"""
_YEAR_COLS = "CASE WHEN coalesce(since, upto, lo) IS NULL THEN one END AS year, CASE WHEN since IS NOT NULL THEN since WHEN upto IS NOT NULL THEN '1900' ELSE lo END AS year_from, CASE WHEN since IS NOT NULL THEN '2099' WHEN upto IS NOT NULL THEN upto ELSE hi END AS year_to"


@query("nlq_years", f"{WITH}, {_YEARS} SELECT query_id, {_YEAR_COLS} FROM y")
def nlq_years(spark, sf_dir):
    return questions(spark, sf_dir).select("query_id", Q.years(F.col("query")).alias("y")).select("query_id", "y.*")


_VENUE = f"nullif(trim(regexp_extract(query, {_lit(Q.VENUE)}, 1)), '')"
_INST = f"CASE WHEN {_VENUE} IS NULL THEN nullif(trim(regexp_extract(query, {_lit(Q.INSTITUTION)}, 1)), '') END"


@query("nlq_venue_institution", f"{WITH} SELECT query_id, {_VENUE} AS venue, {_INST} AS institution FROM questions")
def nlq_venue_institution(spark, sf_dir):
    return questions(spark, sf_dir).select("query_id", Q.venue(F.col("query")).alias("venue"), Q.institution(F.col("query")).alias("institution"))


_INTENTS = r"coalesce(regexp_matches(lower(query), '\bcit(?:e|ed|ation|ing)\b'), false) AS wants_citations, coalesce(regexp_matches(lower(query), '\bco-?author|collaborat'), false) AS wants_coauthors, coalesce(regexp_matches(lower(query), '\b(?:most|top|highest)\s+cited\b|\btop\s+papers?\b|\bmost\s+influential\b'), false) AS wants_top_cited"


@query("nlq_intents", f"{WITH} SELECT query_id, {_INTENTS} FROM questions")
def nlq_intents(spark, sf_dir):
    return questions(spark, sf_dir).select("query_id", Q.intents(F.col("query")).alias("i")).select("query_id", "i.*")


@query("nlq_entities")
def nlq_entities(spark, sf_dir):
    return questions(spark, sf_dir).select("query_id", Q.normalized(Q.entities(F.col("query"))).alias("e")).select("query_id", "e.*")


@query("nlq_merge_entities", WITH + " SELECT query_id, CASE WHEN query_id % 2 = 0 THEN 'given' ELSE " + _VENUE + " END AS venue, CASE WHEN query_id % 3 = 0 THEN ['W1'] ELSE regexp_extract_all(query, '\\b(W\\d+)\\b', 1) END AS paper_ids FROM questions")
def nlq_merge_entities(spark, sf_dir):
    model = F.struct(F.when(F.col("query_id") % 2 == 0, "given").otherwise("").alias("venue"), F.when(F.col("query_id") % 3 == 0, F.array(F.lit("W1"))).otherwise(F.array().cast("array<string>")).alias("paper_ids"))
    found = F.struct(Q.venue(F.col("query")).alias("venue"), Q.paper_ids(F.col("query")).alias("paper_ids"))
    return questions(spark, sf_dir).select("query_id", Q.merged(model, found, {"venue": False, "paper_ids": True}).alias("m")).select("query_id", "m.*")


@query("nlq_template_strategy", f"""{WITH}, {_YEARS}, e AS (SELECT query_id, {_YEAR_COLS}, len(regexp_extract_all(query, '\\b(W\\d+)\\b', 1)) > 0 AS ids, {_VENUE} AS venue, {_INST} AS institution, {_INTENTS} FROM y)
SELECT query_id, CASE WHEN ids AND wants_citations THEN 'search_citations' WHEN wants_top_cited THEN 'top_cited_papers' ELSE 'search_papers' END AS template,
  CASE WHEN ids OR venue IS NOT NULL OR institution IS NOT NULL OR year IS NOT NULL OR year_from IS NOT NULL OR wants_citations OR wants_coauthors OR wants_top_cited THEN 'graph_only' ELSE 'vector_first' END AS strategy FROM e""")
def nlq_template_strategy(spark, sf_dir):
    """Without author names, whose patterns need back-references."""
    e = Q.entities(F.col("query")).withField("author_names", F.array().cast("array<string>"))
    return questions(spark, sf_dir).withColumn("e", e).select("query_id", Q.template(F.col("e")).alias("template"), Q.strategy(F.col("e")).alias("strategy"))


_count = lambda ws: "(" + " + ".join(f"CAST(contains(low, '{w}') AS INTEGER)" for w in ws) + ")"


@query("nlq_classify", f"""{WITH}, l AS (SELECT *, lower(query) AS low, {_hit('query', Q.AUTHOR_QUESTIONS)} AS author, regexp_matches(query, '\\b(W\\d+|DOI:|doi:|pmid:|arxiv:)', 'i') AS ident FROM questions),
s AS (SELECT *, CAST({_count(Q.SEMANTIC)} AS DOUBLE) + CASE WHEN len(list_filter(regexp_split_to_array(query, '\\s+'), lambda w: w <> '')) > 5 THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS sem,
  CAST({_count(Q.STRUCTURAL)} AS DOUBLE) + CASE WHEN contains(low, 'and') OR contains(low, 'or') OR contains(low, 'not') THEN 0.3::DOUBLE ELSE 0::DOUBLE END AS str,
  CAST({_count(Q.FACTUAL)} AS DOUBLE) + CASE WHEN {' OR '.join(f"starts_with(low, '{w}')" for w in Q.FACTUAL)} THEN 0.4::DOUBLE ELSE 0::DOUBLE END AS fac FROM l),
b AS (SELECT *, greatest(sem, str, fac) AS best FROM s)
SELECT query_id, CASE WHEN ident OR author THEN 'structural' WHEN best < 1 OR sem + str + fac > 1.5::DOUBLE THEN 'hybrid' WHEN sem = best THEN 'semantic' WHEN str = best THEN 'structural' ELSE 'factual' END AS type,
  CASE WHEN ident AND author THEN 0.95::DOUBLE WHEN author THEN 0.85::DOUBLE WHEN ident THEN 0.8::DOUBLE WHEN best < 1 OR sem + str + fac > 1.5::DOUBLE THEN 0.6::DOUBLE ELSE least(best / 2, 1::DOUBLE) END AS confidence FROM b""")
def nlq_classify(spark, sf_dir):
    return questions(spark, sf_dir).select("query_id", Q.classify(F.col("query")).alias("c")).select("query_id", "c.*")


@query("nlq_ai_entities", "SELECT c_custkey AS n, CASE c_custkey % 3 WHEN 0 THEN ['W' || c_custkey] WHEN 2 THEN ['W1', 'W' || c_custkey] END AS paper_ids, CASE c_custkey % 3 WHEN 0 THEN CAST(1990 + c_nationkey AS VARCHAR) END AS year, CASE c_custkey % 3 WHEN 2 THEN c_name END AS venue, CASE c_custkey % 3 WHEN 0 THEN c_nationkey % 2 = 0 END AS wants_citations FROM customer")
def nlq_ai_entities(spark, sf_dir):
    """A model's answers about each customer: fenced JSON, prose without JSON, and JSON inside prose."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey").cast("string")
    fenced = F.concat(F.lit('```json\n{"paper_ids": ["W'), key, F.lit('"], "year": '), (1990 + F.col("c_nationkey")).cast("string"), F.lit(', "wants_citations": '), (F.col("c_nationkey") % 2 == 0).cast("string"), F.lit("}\n```"))
    inside = F.concat(F.lit('Sure: {"paper_ids": ["W1", "W'), key, F.lit('"], "venue": "'), "c_name", F.lit('"} as asked'))
    raw = F.when(F.col("c_custkey") % 3 == 0, fenced).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("I cannot tell for "), "c_name")).otherwise(inside)
    return c.select(F.col("c_custkey").alias("n"), Q.ai_entities(raw).alias("e")).select("n", "e.paper_ids", "e.year", "e.venue", "e.wants_citations")


@query("nlq_analyzed")
def nlq_analyzed(spark, sf_dir):
    return Q.analyzed(questions(spark, sf_dir)).select("query_id", "status", "clean", "template", "strategy")
