"""Graph queries as relational plans: enrichment, the five templates, conditions and counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.graph import Graph

PAPER_COLS = ("id", "title", "abstract", "doi", "publication_date", "cited_by_count", "pdf_url")


def contains_any(column: Column, names: Sequence[str]) -> Column:
    """Whether the text holds any of the names, ignoring case; no names hold for nothing, null holds none."""
    if not names:
        return F.lit(False)
    return F.coalesce(reduce(Column.__or__, [F.contains(F.lower(column), F.lit(n.lower())) for n in names]), F.lit(False))


def author_names(g: Graph, edges: DataFrame | None = None) -> DataFrame:
    """paper_id with the sorted distinct names of its authors, gathered before any join fans out."""
    e = g.authored if edges is None else edges
    return e.join(g.authors, e.author_id == g.authors.id).groupBy("paper_id").agg(F.array_sort(F.collect_set("name")).alias("authors"))


def enrich(g: Graph, papers: DataFrame, institution: bool = False, few: bool = False) -> DataFrame:
    """Papers with authors, venue and, with one row for each, institution; missing ones are null or empty.

    few: the papers are a small part of the graph, so that the relations are cut down to them before anything is gathered.
    """
    ids = papers.select(F.col("id").alias("paper_id"))
    of = lambda edges: edges.join(ids, "paper_id", "left_semi") if few else edges
    out = papers.select(*PAPER_COLS).withColumnRenamed("id", "paper_id").join(author_names(g, of(g.authored)), "paper_id", "left")
    published = of(g.published_in)
    venue = published.join(g.venues, published.venue_id == g.venues.id).select("paper_id", F.col("name").alias("venue")).distinct()
    out = out.join(venue, "paper_id", "left").withColumn("authors", F.coalesce("authors", F.array().cast("array<string>")))
    if institution:
        at = of(g.associated_with)
        inst = at.join(g.institutions, at.inst_id == g.institutions.id).select("paper_id", F.col("name").alias("institution")).distinct()
        out = out.join(inst, "paper_id", "left")
    return out


def most_cited(papers: DataFrame, k: int) -> DataFrame:
    """The k papers that can have the first k rows: enriching a paper never drops it."""
    return papers.orderBy(F.desc_nulls_first("cited_by_count"), "id").limit(k)


def top(df: DataFrame, k: int | None, *more: str) -> DataFrame:
    """Most cited first, unknown counts before known ones, ties by id."""
    out = df.orderBy(F.desc_nulls_first("cited_by_count"), "paper_id", *[F.asc_nulls_first(c) for c in more])
    return out if k is None else out.limit(k)


def linked_papers(g: Graph, kind: str, condition: Column) -> DataFrame:
    """EXISTS over a relation: the ids of papers with an author, venue or institution that satisfies the condition on name."""
    edge, node, key = {"author": (g.authored, g.authors, "author_id"), "venue": (g.published_in, g.venues, "venue_id"), "institution": (g.associated_with, g.institutions, "inst_id")}[kind]
    return edge.join(node.where(condition).select(F.col("id").alias(key)), key, "left_semi").select(F.col("paper_id").alias("id")).distinct()


def matching_papers(g: Graph, entities: dict, any_of: bool = True) -> DataFrame:
    """Papers that satisfy any (or all) of the conditions that the entities give; without a condition, all papers."""
    p, flags, tests = g.papers, [], []
    if ids := entities.get("paper_ids"):
        tests.append(F.col("id").isin(list(ids)))
    if words := entities.get("keywords"):
        tests.append(contains_any(F.col("title"), words) | contains_any(F.col("abstract"), words))
    if year := entities.get("year"):
        tests.append(F.coalesce(F.startswith("publication_date", F.lit(str(year))), F.lit(False)))
    if entities.get("year_from") or entities.get("year_to"):
        lo, hi = str(entities.get("year_from") or 1900), str(entities.get("year_to") or 2099)
        tests.append(F.coalesce((F.col("publication_date") >= lo) & (F.col("publication_date") < hi), F.lit(False)))
    for kind, key in (("author", "author_names"), ("venue", "venue"), ("institution", "institution")):
        if wanted := entities.get(key):
            names = [wanted] if isinstance(wanted, str) else list(wanted)
            flag = f"has_{kind}"
            flags.append((flag, linked_papers(g, kind, contains_any(F.col("name"), names))))
            tests.append(F.coalesce(F.col(flag), F.lit(False)))
    if not tests:
        return p
    if not any_of:
        for _, ids in flags:
            p = p.join(ids, "id", "left_semi")
        plain = tests[: len(tests) - len(flags)]
        return p.where(reduce(Column.__and__, plain)) if plain else p
    for flag, ids in flags:
        p = p.join(ids.withColumn(flag, F.lit(True)), "id", "left")
    return p.where(reduce(Column.__or__, tests)).select(*PAPER_COLS)


def search_papers(g: Graph, entities: dict, k: int = 10) -> DataFrame:
    best = most_cited(matching_papers(g, entities), k)
    return top(enrich(g, best, institution=True, few=True), k, "venue", "institution")


def search_citations(g: Graph, ids: Sequence[str], k: int = 10) -> DataFrame:
    """Both ends of every citation that touches one of the ids."""
    hit = g.cites.where(F.col("src_id").isin(list(ids)) | F.col("dst_id").isin(list(ids))) if ids else g.cites.limit(0)
    ends = hit.select(F.explode(F.array("src_id", "dst_id")).alias("id")).distinct()
    return top(enrich(g, most_cited(g.papers.join(ends, "id", "left_semi"), k), few=True), k, "venue")


def top_cited_papers(g: Graph, k: int = 10) -> DataFrame:
    return top(enrich(g, most_cited(g.papers, k), few=True), k, "venue")


def coauthor_network(g: Graph, names: Sequence[str], k: int = 10, titles: int = 5) -> DataFrame:
    """Pairs by name: papers shared by different authors of whom the first one's name holds one of the names."""
    a1 = g.authored.join(g.authors.where(contains_any(F.col("name"), names)), g.authored.author_id == g.authors.id).select("paper_id", F.col("author_id").alias("a1"), F.col("name").alias("author"))
    a2 = g.authored.join(g.authors, g.authored.author_id == g.authors.id).select("paper_id", F.col("author_id").alias("a2"), F.col("name").alias("coauthor"))
    pairs = a1.join(a2, "paper_id").where("a1 <> a2").join(g.papers.select(F.col("id").alias("paper_id"), "title"), "paper_id")
    out = pairs.groupBy("author", "coauthor").agg(F.count("*").alias("shared_papers"), F.slice(F.array_sort(F.collect_set("title")), 1, titles).alias("sample_titles"))
    return out.orderBy(F.desc("shared_papers"), "author", "coauthor").limit(k)


def author_venue_stats(g: Graph, names: Sequence[str], k: int = 10, titles: int = 3) -> DataFrame:
    who = g.authored.join(g.authors.where(contains_any(F.col("name"), names)), g.authored.author_id == g.authors.id).select("paper_id", F.col("name").alias("author"))
    where = g.published_in.join(g.venues, g.published_in.venue_id == g.venues.id).select("paper_id", F.col("name").alias("venue"))
    rows = who.join(where, "paper_id").join(g.papers.select(F.col("id").alias("paper_id"), "title"), "paper_id")
    out = rows.groupBy("author", "venue").agg(F.count("*").alias("paper_count"), F.slice(F.array_sort(F.collect_set("title")), 1, titles).alias("sample_titles"))
    return out.orderBy(F.desc("paper_count"), "author", "venue").limit(k)


def enrich_by_ids(g: Graph, ids: DataFrame) -> DataFrame:
    """ids: one column id."""
    return top(enrich(g, g.papers.join(ids, "id", "left_semi"), few=True), None, "venue")


def database_stats(g: Graph) -> DataFrame:
    """The number of nodes of each label and of edges of each relation."""
    counts = [getattr(g, n).agg(F.lit(n).alias("what"), F.count("*").alias("n")) for n in g.__dataclass_fields__]
    return reduce(DataFrame.unionByName, counts)


def stub_papers(cited: DataFrame, papers: DataFrame) -> DataFrame:
    """Rows with nothing but an id for cited papers that are not there."""
    ids = cited.select(F.col("dst_id").alias("id")).distinct().join(papers.select("id"), "id", "left_anti")
    return ids.select("id", *[F.lit(None).cast(papers.schema[c].dataType).alias(c) for c in papers.columns if c != "id"])


def upsert(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Merge by key: of each property the latest supplied non-null value stays; new rows beat existing ones, later ones earlier.

    new carries ``order``; existing rows count as before all of them.
    """
    cols = [c for c in existing.columns if c != key]
    both = existing.select(key, *cols, F.lit(None).cast(new.schema[order].dataType).alias("_seq")).unionByName(new.select(key, *cols, F.col(order).alias("_seq")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.col("_seq").isNotNull(), "_seq"))).alias(c)
    return both.groupBy(key).agg(*[last(c) for c in cols]).select(existing.columns)


def upsert_edges(existing: DataFrame, new: DataFrame) -> DataFrame:
    return existing.unionByName(new.select(existing.columns)).distinct()
