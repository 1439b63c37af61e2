"""Visual evidence for papers, and discovery by text and visual scores together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ranking as R
from ..operators import vector as V

OVER_FETCH = 3


def visual_search(image_queries: DataFrame, text_queries: DataFrame, figures: DataFrame, tables: DataFrame, allowed: DataFrame, k: int) -> dict[str, DataFrame]:
    """figures and tables hits of each query, k of each, and the best score of each paper.

    Queries are (query_id, vector); items (id, paper_id, image, text) are searched by their image and by their
    description vectors; allowed (query_id, paper_id) scopes both lists if it meets either, and queries without allowed papers
    get nothing. Without any description hit, image scores stay unweighted.
    """
    hits = []
    for kind, items in (("figure", figures), ("table", tables)):
        of = items.select("id", "paper_id")
        image = V.dense_topk(image_queries, items.select("id", F.col("image").alias("vector")).where("vector is not null"), OVER_FETCH * k).join(of, "id")
        text = V.dense_topk(text_queries, items.select("id", F.col("text").alias("vector")).where("vector is not null"), OVER_FETCH * k).join(of, "id")
        merged = R.merge_visual(image, text)
        some = text.select("query_id").distinct()
        alone = image.join(some, "query_id", "left_anti").select("query_id", "id", "paper_id", "similarity_score", F.lit("image").alias("search_type"))
        hits.append(merged.join(some, "query_id", "left_semi").unionByName(alone).withColumn("collection", F.lit(kind)))
    both = hits[0].unionByName(hits[1]).join(allowed.select("query_id").distinct(), "query_id", "left_semi")
    scoped = R.scope_or_all(both, allowed)
    parts = {kind: V.best(scoped.where(F.col("collection") == kind), k) for kind in ("figure", "table")}
    shown = parts["figure"].unionByName(parts["table"])
    return parts | {"papers": R.best_per(shown, ["query_id", "paper_id"], "similarity_score").withColumnRenamed("similarity_score", "visual")}


def discover(text_hits: DataFrame, visual: DataFrame, k: int, legacy_distance: bool = False) -> DataFrame:
    """text_hits (query_id, sub, paper_id, score) of several keywords: the best of each paper, with visual scores, the k best."""
    how = "min" if legacy_distance else "max"
    best = R.best_per(text_hits, ["query_id", "paper_id"], "score", how)
    both = R.combine_visual(best, visual, legacy_distance)
    return V.best(both.withColumnRenamed("paper_id", "id"), k, score="score").withColumnRenamed("id", "paper_id")
