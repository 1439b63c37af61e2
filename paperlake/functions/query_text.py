"""Natural-language questions: guardrails, entities, template and strategy, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LENGTH = 1000

# Fixed values, down to INSTITUTION: what is rejected, what is filtered, the words that carry no topic, the words and patterns by
# which questions are classified, and the patterns of authors, venues and institutions.
REJECTED = (
    r"ignore\s+(all\s+)?previous\s+instructions",
    r"ignore\s+the\s+above",
    r"disregard\s+(all\s+)?(prior|previous|above)",
    r"you\s+are\s+now\s+",
    r"act\s+as\s+(if\s+you\s+are|a)\s+",
    r"pretend\s+(to\s+be|you\s+are)",
    r"system\s*:\s*",
    r"<\s*system\s*>",
    r"\bDAN\b.*\bjailbreak\b",
    r"forget\s+(everything|all|your)\s+(previous|instructions|rules)",
    r"override\s+(your\s+)?(system|instructions|rules)",
    r"new\s+instruction[s]?\s*:",
)
FILTERED = (
    r"\b(DELETE|DETACH|DROP|CREATE|SET|REMOVE|MERGE)\b",
    r"\bCALL\s*\{",
    r"\bCALL\s+db\b",
    r"\bCALL\s+apoc\b",
    r"//.*\n.*MATCH",
)
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "about", "papers", "paper", "research", "study",
    "studies", "find", "search", "what", "where", "when", "who", "how", "why", "which", "is", "are", "was", "were", "have", "has", "had", "do",
    "does", "did", "will", "would", "could", "should", "related", "concerning", "regarding", "involving",
)
SEMANTIC = ("similar", "related", "about", "concerning", "regarding")
STRUCTURAL = ("cited", "authored", "collaborated", "published", "references", "author", "co-author", "collaborator")
FACTUAL = ("who", "what", "when", "where", "which", "how many")
AUTHOR_QUESTIONS = (r"who\s+is\s+the\s+author", r"authors?\s+of\s+paper", r"who\s+wrote", r"who\s+authored")
AUTHOR_PHRASES = (
    r"papers?\s+by\s+([\"']?)([^\"']+?)\1(?:\s|$)",
    r"authored?\s+by\s+([\"']?)([^\"']+?)\1(?:\s|$)",
    r"written\s+by\s+([\"']?)([^\"']+?)\1(?:\s|$)",
    r"authors?\s+([\"']?)([^\"']+?)\1(?:\s|and\s+)",
    r"co-?authored?\s+by\s+([\"']?)([^\"']+?)\1(?:\s|$)",
)
AUTHOR_PAIR = r"([A-Z][a-z]+\s+[A-Z][a-z]+)(?:\s+and\s+([A-Z][a-z]+\s+[A-Z][a-z]+))*"
VENUE = r"(?i)(?:in|from|published\s+in|venue|journal|conference)\s+[\"']?([A-Z][^\"',]{2,40})[\"']?"
INSTITUTION = r"(?i)(?:from|at|institution|university|org(?:anization)?)\s+[\"']?([A-Z][^\"',]{2,50})[\"']?"

EMPTY, TRUNCATED, CONTROLS, INJECTION = "empty", "Query truncated to 1000 characters", "Control characters removed from query", "Query contains potential Cypher injection pattern — sanitized"


def any_of(text: Column, patterns) -> Column:
    return reduce(Column.__or__, [text.rlike(f"(?i){p}") for p in patterns])


def blank(text: Column) -> Column:
    """Null or nothing but white space."""
    return text.isNull() | (F.regexp_replace(text, r"\s+", "") == "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sanitize(text: Column) -> Column:
    """struct(status: ok, empty or rejected; query; warnings). Rejection is judged after truncation and clean-up."""
    short = F.substring(text, 1, MAX_LENGTH)
    clean = F.regexp_replace(short, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    warnings = [F.when(F.length(text) > MAX_LENGTH, TRUNCATED), F.when(clean != short, CONTROLS)]
    out = clean
    for p in FILTERED:
        hit = out.rlike(f"(?i){p}")
        warnings.append(F.when(hit, INJECTION))
        out = F.regexp_replace(out, f"(?i){p}", r"[FILTERED]")
    status = F.when(blank(text), EMPTY).when(any_of(clean, REJECTED), "rejected").otherwise("ok")
    ok = status == "ok"
    return F.struct(status.alias("status"), F.when(ok, strip(out)).alias("query"), F.when(ok, F.array_compact(F.array(*warnings))).alias("warnings"))


def paper_ids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\b(W\d+)\b"), F.lit(1))


def distinct_by(array: Column, key) -> Column:
    """The elements whose key occurs first."""
    keys = F.transform(array, key)
    return F.filter(array, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def author_names(text: Column) -> Column:
    """Names of two words or more after 'by' and the like, then pairs of capitalised words; the first of equal ones."""
    words = lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))
    said = [F.transform(F.regexp_extract_all(text, F.lit(f"(?i){p}"), F.lit(2)), lambda x: F.trim(x)) for p in AUTHOR_PHRASES]
    pair = F.arrays_zip(F.regexp_extract_all(text, F.lit(AUTHOR_PAIR), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(AUTHOR_PAIR), F.lit(2)).alias("b"))
    pairs = F.flatten(F.transform(pair, lambda p: F.array(F.trim(p["a"]), F.trim(p["b"]))))
    return distinct_by(F.filter(F.concat(*said, pairs), lambda x: words(x) >= 2), lambda x: F.lower(F.trim(x)))


def keywords(text: Column) -> Column:
    """Topic words in order of first occurrence, and the whole trimmed question behind them."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "), r"\s+")
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    topic = F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w) & ~w.rlike(r"^\d+$") & ~w.rlike(r"^w\d+$"))
    whole = F.when(~blank(text), F.array(strip(text))).otherwise(F.array().cast("array<string>"))
    return F.coalesce(F.array_distinct(F.concat(topic, whole)), F.array().cast("array<string>"))


def years(text: Column) -> Column:
    """struct(year, year_from, year_to): since, before, range, in, or a year 20dd that stands alone; the first that fits."""
    got = lambda p, k: F.nullif(F.regexp_extract(text, p, k), F.lit(""))
    since = got(r"(?i)\b(since|after|from)\s+(\d{4})\b", 2)
    before = got(r"(?i)\b(before|until|up\s+to)\s+(\d{4})\b", 2)
    between = r"\b(\d{4})\s*[-–to]+\s*(\d{4})\b"
    lo, hi = got(between, 1), got(between, 2)
    single = F.coalesce(got(r"(?i)\b(in|year)\s+(\d{4})\b", 2), got(r"\b(20\d{2})\b", 1))
    ranged = F.coalesce(since, before, lo).isNotNull()
    return F.struct(
        F.when(~ranged, single).alias("year"),
        F.when(since.isNotNull(), since).when(before.isNotNull(), F.lit("1900")).otherwise(lo).alias("year_from"),
        F.when(since.isNotNull(), F.lit("2099")).when(before.isNotNull(), before).otherwise(hi).alias("year_to"),
    )


def venue(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, VENUE, 1)), F.lit(""))


def institution(text: Column) -> Column:
    return F.when(venue(text).isNull(), F.nullif(F.trim(F.regexp_extract(text, INSTITUTION, 1)), F.lit("")))


def intents(text: Column) -> Column:
    low = F.lower(text)
    hit = lambda p: F.coalesce(low.rlike(p), F.lit(False))
    return F.struct(
        hit(r"\bcit(?:e|ed|ation|ing)\b").alias("wants_citations"),
        hit(r"\bco-?author|collaborat").alias("wants_coauthors"),
        hit(r"\b(?:most|top|highest)\s+cited\b|\btop\s+papers?\b|\bmost\s+influential\b").alias("wants_top_cited"),
    )


def entities(text: Column) -> Column:
    """Everything that a question names, one struct; absent parts are null or empty."""
    y, i = years(text), intents(text)
    return F.struct(
        paper_ids(text).alias("paper_ids"), author_names(text).alias("author_names"), keywords(text).alias("keywords"), y["year"].alias("year"), y["year_from"].alias("year_from"), y["year_to"].alias("year_to"),
        venue(text).alias("venue"), institution(text).alias("institution"), i["wants_citations"].alias("wants_citations"), i["wants_coauthors"].alias("wants_coauthors"), i["wants_top_cited"].alias("wants_top_cited"),
    )


def without_end(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[.,:;!?]+$", ""))


def title_case(text: Column) -> Column:
    """Every run of letters starts with a capital, whatever stands before it."""
    letters = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(letters, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))), "")


def normalized(e: Column) -> Column:
    """Entities cleaned: trimmed, empty ones dropped, names in title case without end marks, keywords in lower case, no repeats."""
    full = lambda a: F.filter(F.transform(a, lambda x: strip(x)), lambda x: x.isNotNull() & (x != ""))
    names = distinct_by(F.transform(full(e["author_names"]), lambda n: title_case(without_end(n))), lambda x: F.lower(x))
    words = F.array_distinct(F.filter(F.transform(full(e["keywords"]), lambda k: F.lower(k)), lambda k: F.length(k) > 2))
    field = lambda c: F.nullif(without_end(strip(e[c])), F.lit(""))
    ready = {"paper_ids": full(e["paper_ids"]), "author_names": names, "keywords": words, "venue": field("venue"), "institution": field("institution")}
    order = ("paper_ids", "author_names", "keywords", "year", "year_from", "year_to", "venue", "institution", "wants_citations", "wants_coauthors", "wants_top_cited")
    return F.struct(*[ready.get(c, e[c]).alias(c) for c in order])


def merged(first: Column, second: Column, fields: dict[str, bool]) -> Column:
    """Field by field the first entity set where it says something, else the second. fields: name -> is it a list."""
    pick = lambda c, many: F.when(F.size(first[c]) > 0, first[c]).otherwise(second[c]) if many else F.coalesce(F.nullif(first[c], F.lit("")), second[c])
    return F.struct(*[pick(c, many).alias(c) for c, many in fields.items()])


def viable(e: Column) -> Column:
    """Templates whose entities are all there, most specific first."""
    some = lambda c: F.size(e[c]) > 0
    return F.array_compact(
        F.array(
            F.when(some("paper_ids") & e["wants_citations"], "search_citations"),
            F.when(some("author_names") & e["wants_coauthors"], "coauthor_network"),
            F.when(some("author_names"), "author_venue_stats"),
            F.when(e["wants_top_cited"], "top_cited_papers"),
            F.lit("search_papers"),
        )
    )


def template(e: Column) -> Column:
    return F.try_element_at(viable(e), F.lit(1))


def strategy(e: Column, override: Column | None = None) -> Column:
    """graph_only if anything but a topic is named, else vector_first; a valid override wins."""
    named = (F.size(e["paper_ids"]) > 0) | (F.size(e["author_names"]) > 0) | e["venue"].isNotNull() | e["institution"].isNotNull() | e["year"].isNotNull() | e["year_from"].isNotNull()
    own = F.when(named | e["wants_citations"] | e["wants_coauthors"] | e["wants_top_cited"], "graph_only").otherwise("vector_first")
    return own if override is None else F.when(override.isin("graph_only", "vector_first"), override).otherwise(own)


def classify(text: Column) -> Column:
    """struct(type, confidence) from id and author patterns, else from counts of tell-tale words."""
    low = F.lower(text)
    author, ident = any_of(text, AUTHOR_QUESTIONS), text.rlike(r"(?i)\b(W\d+|DOI:|doi:|pmid:|arxiv:)")
    count = lambda words: reduce(Column.__add__, [F.contains(low, F.lit(w)).cast("int") for w in words]).cast("double")
    n_words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    semantic = count(SEMANTIC) + F.when(n_words > 5, 0.5).otherwise(0.0)
    structural = count(STRUCTURAL) + F.when(reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in ("and", "or", "not")]), 0.3).otherwise(0.0)
    factual = count(FACTUAL) + F.when(reduce(Column.__or__, [F.startswith(low, F.lit(w)) for w in FACTUAL]), 0.4).otherwise(0.0)
    best = F.greatest(semantic, structural, factual)
    kind = F.when(semantic == best, "semantic").when(structural == best, "structural").otherwise("factual")
    mixed = (best < 1.0) | (semantic + structural + factual > 1.5)
    return (
        F.when(ident & author, F.struct(F.lit("structural").alias("type"), F.lit(0.95).alias("confidence")))
        .when(author, F.struct(F.lit("structural").alias("type"), F.lit(0.85).alias("confidence")))
        .when(ident, F.struct(F.lit("structural").alias("type"), F.lit(0.80).alias("confidence")))
        .when(mixed, F.struct(F.lit("hybrid").alias("type"), F.lit(0.6).alias("confidence")))
        .otherwise(F.struct(kind.alias("type"), F.least(best / 2.0, F.lit(1.0)).alias("confidence")))
    )


AI_SCHEMA = "paper_ids array<string>, author_names array<string>, keywords array<string>, venue string, institution string, year string, year_from string, year_to string, wants_citations boolean, wants_coauthors boolean, wants_top_cited boolean"


def ai_entities(raw: Column) -> Column:
    """A model's JSON answer as an entity struct: code fences dropped, from the first { to the last }; null if it isn't JSON."""
    bare = F.regexp_replace(raw, r"```(?:json)?", "")
    return F.from_json(F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit("")), AI_SCHEMA, {"mode": "PERMISSIVE"})


def analyzed(queries: DataFrame, column: str = "query") -> DataFrame:
    """queries with status, entities, template and strategy; a lazy plan for any number of questions."""
    s = queries.withColumn("_s", sanitize(F.col(column))).withColumn("status", F.col("_s.status")).withColumn("clean", F.col("_s.query"))
    s = s.withColumn("entities", normalized(entities(F.col("clean"))))
    return s.withColumn("template", template(F.col("entities"))).withColumn("strategy", strategy(F.col("entities"))).drop("_s")
