"""From raw works to the graph's tables, as one plan for each table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import extract as X
from ..operators import graph as G
from ..sources.graph import Graph


@dataclass
class Batch:
    """Node and edge rows of a batch of works; works without a title are left out with all that hangs on them."""

    papers: DataFrame
    authors: DataFrame
    authored: DataFrame
    venues: DataFrame
    published_in: DataFrame
    institutions: DataFrame
    associated_with: DataFrame
    cites: DataFrame


def split(works: DataFrame, within: bool = True) -> Batch:
    """within keeps only citations of works of the batch; otherwise unknown works become stubs on upsert."""
    good = works.where(X.full("title").isNotNull())
    papers, who, where, inst, cites = X.papers_of(good), X.authors_of(good), X.venues_of(good), X.institutions_of(good), X.citations_of(good)
    if within:
        cites = cites.join(papers.select(F.col("id").alias("dst_id")), "dst_id", "left_semi")
    node = lambda d, key: d.select(F.col(key).alias("id"), "name").groupBy("id").agg(F.min("name").alias("name"))
    return Batch(
        papers, node(who, "author_id"), who.select("author_id", "paper_id").distinct(), node(where, "venue_id"), where.select("paper_id", "venue_id").distinct(),
        node(inst, "inst_id"), inst.select("paper_id", "inst_id").distinct(), cites.select("src_id", "dst_id").distinct(),
    )


def rejects(works: DataFrame) -> DataFrame:
    """(id, reason): the works that split leaves out, each for itself; all others are loaded whatever happens to these."""
    reason = F.when(F.col("id").isNull(), "no id").when(X.full("title").isNull(), "no title")
    return works.select("id", reason.alias("reason")).where("reason is not null")


def upsert(g: Graph, b: Batch, seq: int = 1) -> Graph:
    """The graph with the batch merged in: supplied values win, missing ones stay, edges are sets, unknown cited papers are stubs."""
    new = lambda d, old: d.select(*[c if c in d.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns], F.lit(seq).alias("seq"))
    merge = lambda name: G.upsert(getattr(g, name), new(getattr(b, name), getattr(g, name)), "id", "seq")
    edges = lambda name: G.upsert_edges(getattr(g, name), getattr(b, name))
    papers = merge("papers")
    papers = papers.unionByName(G.stub_papers(b.cites, papers))
    return Graph(papers, merge("authors"), merge("venues"), merge("institutions"), edges("authored"), edges("published_in"), edges("associated_with"), edges("cites"))


def citation_network(g: Graph) -> DataFrame:
    """Edges with the titles of both ends, 'Unknown' without one, and a weight of 1 plus the edge's further mentions."""
    titles = g.papers.select("id", "title")
    e = g.cites.groupBy("src_id", "dst_id").agg(F.count("*").alias("weight"))
    e = e.join(titles.select(F.col("id").alias("src_id"), F.col("title").alias("src_title")), "src_id", "left").join(titles.select(F.col("id").alias("dst_id"), F.col("title").alias("dst_title")), "dst_id", "left")
    return e.select("src_id", "dst_id", "weight", F.coalesce("src_title", F.lit("Unknown")).alias("src_title"), F.coalesce("dst_title", F.lit("Unknown")).alias("dst_title"))


def totals(g: Graph) -> DataFrame:
    return G.database_stats(g)
