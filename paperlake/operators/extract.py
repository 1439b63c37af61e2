"""Raw works as nested records to node, edge and text rows, and the links between records of two catalogues."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCATION = "struct<pdf_url:string,source:struct<id:string,display_name:string,type:string,issn_l:string,issn:array<string>,host_organization_name:string>>"
WORK = (
    "id string, title string, abstract string, doi string, publication_year int, cited_by_count bigint, ids struct<pmid:string>, "
    "authorships array<struct<author:struct<id:string,display_name:string,orcid:string>,is_corresponding:boolean,institutions:array<struct<id:string,display_name:string,country_code:string,type:string>>>>, "
    f"referenced_works array<string>, primary_location {LOCATION}, best_oa_location {LOCATION}, locations array<{LOCATION}>, content_urls struct<pdf:string>, concepts array<struct<display_name:string,score:double>>"
)
# Country codes with a name.
COUNTRIES = {
    "JP": "Japan", "US": "United States", "GB": "United Kingdom", "DE": "Germany", "FR": "France", "CN": "China", "CA": "Canada", "AU": "Australia",
    "IT": "Italy", "ES": "Spain", "NL": "Netherlands", "SE": "Sweden", "CH": "Switzerland", "KR": "South Korea", "IN": "India", "BR": "Brazil",
}
NO_ABSTRACT = ("no abstract", "n/a", "null", "none", "")
PREFIXES = r"^https://openalex\.org/"


def bare(c: Column) -> Column:
    return F.regexp_replace(c, PREFIXES, "")


def full(c: Column | str) -> Column:
    """Null if empty."""
    return F.nullif(F.trim(F.col(c) if isinstance(c, str) else c), F.lit(""))


def papers_of(works: DataFrame) -> DataFrame:
    """Works with a title; dates are the first of January of the year."""
    return works.where(full("title").isNotNull()).select(
        bare(F.col("id")).alias("id"), F.trim("title").alias("title"), F.col("abstract"), F.regexp_replace("doi", "^https://doi.org/", "").alias("doi"),
        F.regexp_replace("ids.pmid", "^https://pubmed.ncbi.nlm.nih.gov/", "").alias("pmid"),
        F.when(F.col("publication_year").isNotNull(), F.concat(F.lpad(F.col("publication_year").cast("string"), 4, "0"), F.lit("-01-01T00:00:00"))).alias("publication_date"),
        F.coalesce(full("primary_location.pdf_url"), full("best_oa_location.pdf_url"), full("content_urls.pdf")).alias("pdf_url"), F.coalesce("cited_by_count", F.lit(0)).cast("bigint").alias("cited_by_count"),
    )


def authors_of(works: DataFrame) -> DataFrame:
    a = works.select(bare(F.col("id")).alias("paper_id"), F.posexplode("authorships").alias("position", "x"))
    return a.where(full("x.author.id").isNotNull() & full("x.author.display_name").isNotNull()).select("paper_id", "position", bare(F.col("x.author.id")).alias("author_id"), F.col("x.author.display_name").alias("name"), F.regexp_replace("x.author.orcid", "^https://orcid.org/", "").alias("orcid"))


def citations_of(works: DataFrame) -> DataFrame:
    return works.select(bare(F.col("id")).alias("src_id"), F.explode("referenced_works").alias("w")).where(full("w").isNotNull()).select("src_id", bare(F.col("w")).alias("dst_id"))


def venues_of(works: DataFrame) -> DataFrame:
    """The venue of the primary, else the best open, else the first location; its type by what the source's type says."""
    at = F.coalesce("primary_location", "best_oa_location", F.try_element_at("locations", F.lit(1)))
    v = works.select(bare(F.col("id")).alias("paper_id"), at.getField("source").alias("s")).where(full("s.display_name").isNotNull())
    kind = F.lower(F.coalesce("s.type", F.lit("")))
    has = lambda k: F.contains(kind, F.lit(k))
    arxiv = has("repository") & F.contains(F.lower("s.display_name"), F.lit("arxiv"))
    named = F.when(has("conference") | has("proceedings"), "conference").when(has("journal"), "journal").when(arxiv, "arxiv").when(has("book"), "book").otherwise("journal")
    return v.select("paper_id", bare(F.col("s.id")).alias("venue_id"), F.trim("s.display_name").alias("name"), named.alias("type"), F.coalesce(full("s.issn_l"), F.try_element_at("s.issn", F.lit(1))).alias("issn"), F.col("s.host_organization_name").alias("publisher"))


def institutions_of(works: DataFrame) -> DataFrame:
    """Institutions of authors without an id, each once a work."""
    i = works.select(bare(F.col("id")).alias("paper_id"), F.explode("authorships").alias("x")).where("x.author.id is null").select("paper_id", F.explode("x.institutions").alias("i"))
    names = F.create_map(*[F.lit(x) for pair in COUNTRIES.items() for x in pair])
    code = F.col("i.country_code")
    rows = i.where(full("i.id").isNotNull()).select("paper_id", bare(F.col("i.id")).alias("inst_id"), F.col("i.display_name").alias("name"), F.coalesce(F.try_element_at(names, code), full("i.country_code")).alias("country"), F.coalesce("i.type", F.lit("unknown")).alias("type"))
    return rows.groupBy("paper_id", "inst_id").agg(F.min("name").alias("name"), F.min("country").alias("country"), F.min("type").alias("type"))


def flat_works(works: DataFrame) -> DataFrame:
    top = F.slice(F.array_sort("concepts", lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(0)), 1, 3)
    insts = F.array_distinct(F.filter(F.flatten(F.transform("authorships", lambda a: F.transform(F.coalesce(a["institutions"], F.array().cast("array<struct<id:string,display_name:string,country_code:string,type:string>>")), lambda i: i["id"]))), lambda x: x.isNotNull()))
    n = lambda c: F.coalesce(F.when(c.isNotNull(), F.size(c)), F.lit(0))
    return works.select(
        bare(F.col("id")).alias("work_id"), "doi", "title", "publication_year", F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"), F.col("primary_location.source.display_name").alias("journal_name"),
        n(F.col("authorships")).alias("author_count"), F.transform("authorships", lambda a: a["author"]["display_name"]).alias("author_names"), n(F.filter("authorships", lambda a: F.coalesce(a["is_corresponding"], F.lit(False)))).alias("corresponding_author_count"),
        n(insts).alias("institution_count"), F.try_element_at(top, F.lit(1)).getField("display_name").alias("primary_concept"), F.transform(top, lambda c: c["display_name"]).alias("top_concepts"),
        full("abstract").isNotNull().alias("has_abstract"), F.coalesce(F.length("abstract"), F.lit(0)).alias("abstract_length"),
    )


def embedding_text(title: Column, abstract: Column) -> Column:
    """struct(text, source): what a text model reads; placeholders for a missing abstract count as missing."""
    t = full(title)
    a = F.when(~F.lower(F.trim(abstract)).isin(*NO_ABSTRACT), F.trim(abstract))
    text = F.when(t.isNotNull() & a.isNotNull(), F.concat(F.lit("TITLE: "), t, F.lit(" [SEP] ABSTRACT: "), a)).when(t.isNotNull(), F.concat(F.lit("TITLE: "), t)).when(a.isNotNull(), F.concat(F.lit("ABSTRACT: "), a))
    return F.struct(text.alias("text"), F.when(a.isNotNull(), "abstract").when(t.isNotNull(), "title").alias("source"))


def _authors(authors: Column, n: int) -> Column:
    return F.concat(F.array_join(F.slice(authors, 1, n), ", "), F.when(F.size(authors) > n, " et al.").otherwise(""))


def prompt_line(number: Column, title: Column, authors: Column, cited: Column, abstract: Column) -> Column:
    some = F.coalesce(F.size(authors), F.lit(0)) > 0
    return F.concat(
        F.lit("["), number.cast("string"), F.lit("] "), F.coalesce(title, F.lit("Unknown")), F.when(some, F.concat(F.lit(" | "), _authors(authors, 3))).otherwise(""),
        F.when(F.coalesce(cited, F.lit(0)) > 0, F.concat(F.lit(" | Cited: "), cited.cast("string"))).otherwise(""), F.when(full(abstract).isNotNull(), F.concat(F.lit(" | "), F.substring(abstract, 1, 800))).otherwise(""),
    )


def rerank_text(title: Column, authors: Column, venue: Column, abstract: Column, most: int = 1648) -> Column:
    body = F.concat(F.lit("Abstract: "), F.substring(abstract, 1, most), F.when(F.length(abstract) > most, "...").otherwise(""))
    parts = [F.when(full(title).isNotNull(), F.concat(F.lit("Title: "), title)), F.when(F.size(authors) > 0, F.concat(F.lit("Authors: "), _authors(authors, 5))), F.when(full(venue).isNotNull(), F.concat(F.lit("Venue: "), venue)), F.when(full(abstract).isNotNull(), body)]
    return F.concat_ws(" | ", *parts)


def upload_rows(embeddings: DataFrame, papers: DataFrame, dim: int) -> DataFrame:
    """Vector rows joined with their papers: texts cut at 1000 and 8000 characters, missing vectors as zeros."""
    e = embeddings.join(papers.select(F.col("id").alias("paper_id"), "title", "abstract"), "paper_id", "left")
    return e.select(F.col("paper_id").alias("id"), F.substring(F.coalesce("title", F.lit("")), 1, 1000).alias("title"), F.substring(F.coalesce("abstract", F.lit("")), 1, 8000).alias("abstract"), F.coalesce("embedding", F.array_repeat(F.lit(0.0).cast("float"), dim)).alias("dense"))


def visual_rows(items: DataFrame, kind: str, most: int | None = None) -> DataFrame:
    """Vector rows of figures or tables (id, paper_id, description, image, text): a figure needs either vector, a table that of its description.

    Descriptions are cut at the length that the kind's collection holds, 2000 for figures and 8000 for tables.
    """
    needed = F.col("text").isNotNull() if kind == "table" else F.col("image").isNotNull() | F.col("text").isNotNull()
    cut = most or {"figure": 2000, "table": 8000}[kind]
    return items.where(needed).withColumn("description", F.substring(F.coalesce("description", F.lit("")), 1, cut))


def enrich_abstracts(papers: DataFrame, found: DataFrame) -> DataFrame:
    """Only empty abstracts are filled; metadata maps merge, citation counts take the larger."""
    f = found.select("id", F.col("abstract").alias("_a"), F.col("metadata").alias("_m"), F.col("cited_by_count").alias("_c"))
    empty = F.create_map().cast("map<string,string>")
    j = papers.join(f, "id", "left")
    kept = F.map_filter(F.coalesce("metadata", empty), lambda k, v: ~F.map_contains_key(F.coalesce("_m", empty), k))
    return j.withColumns({"abstract": F.coalesce(full("abstract"), full("_a")), "metadata": F.map_concat(kept, F.coalesce("_m", empty)), "cited_by_count": F.greatest(F.coalesce("cited_by_count", F.lit(0)), F.coalesce("_c", F.lit(0)))}).drop("_a", "_m", "_c")


def normalize_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", ""), r"\s+", " "))


def title_similarity(a: Column, b: Column) -> Column:
    """Ratio of matching blocks of two normalised titles; 0 if one is missing."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])

    return ratio(a, b)


def author_overlap(a: Column, b: Column, least: float = 0.5) -> Column:
    names = lambda x: F.array_distinct(F.transform(F.slice(x, 1, 3), normalize_text))
    return F.coalesce((F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.array_intersect(names(a), names(b))) / F.greatest(F.size(names(a)), F.lit(1)) >= least), F.lit(False))


def link_confidence(pairs: DataFrame) -> DataFrame:
    """pairs (doi, pmid, title, year, authors and the same with the suffix _2) with confidence: DOI, PMID, title with year and authors, title."""
    t = F.col("_t")
    doi = (full("doi").isNotNull() & (F.lower("doi") == F.lower("doi_2"))).cast("boolean")
    pmid = full("pmid").isNotNull() & (F.col("pmid") == F.col("pmid_2"))
    strong = (t >= 0.95) & (F.col("year") == F.col("year_2")) & author_overlap(F.col("authors"), F.col("authors_2"))
    rows = pairs.withColumn("_t", title_similarity(normalize_text(F.col("title")), normalize_text(F.col("title_2"))))
    score = F.when(F.coalesce(doi, F.lit(False)), 0.98).when(F.coalesce(pmid, F.lit(False)), 0.97).when(F.coalesce(strong, F.lit(False)), F.bround(0.85 + 0.1 * t, 3)).otherwise(F.bround(t * 0.5, 3))
    return rows.withColumn("confidence", score).drop("_t")


def link_records(left: DataFrame, right: DataFrame) -> DataFrame:
    """Candidates block on DOI, PMID or equal normalised titles, never all pairs; the best match of each left record, ties by id."""
    keys = lambda d: F.array_compact(F.array(F.when(full("doi").isNotNull(), F.concat(F.lit("d"), F.lower("doi"))), F.when(full("pmid").isNotNull(), F.concat(F.lit("p"), "pmid")), F.when(normalize_text(F.col("title")) != "", F.concat(F.lit("t"), normalize_text(F.col("title"))))))
    a = left.withColumn("key", F.explode(keys(left)))
    b = right.select(*[F.col(c).alias(f"{c}_2") for c in right.columns], F.explode(keys(right)).alias("key"))
    scored = link_confidence(a.join(b, "key").drop("key").dropDuplicates(["id", "id_2"]))
    return scored.groupBy("id").agg(F.max(F.struct("confidence", F.struct((-F.xxhash64("id_2")).alias("h")), "id_2")).alias("b")).select("id", F.col("b.id_2").alias("id_2"), F.col("b.confidence").alias("confidence"))


def clean_properties(record: DataFrame) -> Column:
    """A row as graph properties: nulls dropped, times as ISO strings, nested values as JSON strings."""
    out = []
    for f in record.schema:
        kind, c = f.dataType.typeName(), F.col(f.name)
        text = F.to_json(c) if kind in ("array", "map", "struct") else F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") if kind in ("timestamp", "timestamp_ntz", "date") else c.cast("string")
        out.append(F.struct(F.lit(f.name).alias("key"), text.alias("value")))
    return F.map_from_entries(F.filter(F.array(*out), lambda e: e["value"].isNotNull()))
