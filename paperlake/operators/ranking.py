"""Scores of a result set: metadata relevance, vector and visual scores, fusion, boosts and their normalisation.

Every input carries query_id, so that a batch of queries is one plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.let import let
from ..sources.scratch import kept


def by_query():
    return Window.partitionBy("query_id")


def empty(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(""))


def min_max(score: str) -> Column:
    """To [0, 1] within a query; equal positive scores are 1, zeros 0."""
    lo, hi = F.min(score).over(by_query()), F.max(score).over(by_query())
    return F.when(hi > lo, (F.col(score) - lo) / (hi - lo)).when(hi > 0, F.lit(1.0)).otherwise(F.lit(0.0))


def relevance(results: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """results (query_id, paper_id, title, abstract, authors, venue, publication_date, cited_by_count, entities) with raw and relevance.

    keep: the columns that the answer needs, all by default. The points that depend on a row alone are counted once and written with these
    columns. A query's extremes come from aggregates that are joined back, not from windows, so that no task gathers a query's rows.
    """
    e = F.col("entities")
    last = lambda s: F.try_element_at(F.split(s, r"\s+"), F.lit(-1))
    with_last = lambda s: F.struct(s.alias("all"), last(s).alias("last"))
    names = F.transform(F.filter(F.transform(e["author_names"], lambda n: F.lower(F.trim(n))), lambda n: F.length(n) > 2), with_last)

    def author_points(author: Column, asked: Column) -> Column:
        full = lambda a, q: F.contains(a["all"], q["all"]) | F.contains(q["all"], a["all"])
        tail = lambda a, q: (q["last"] == a["last"]) & (F.length(q["last"]) > 2)
        points = lambda a, q: F.coalesce(F.when(full(a, q), 20.0).when(tail(a, q), 10.0), F.lit(0.0))
        first = lambda a: F.get(F.filter(asked, lambda q: full(a, q) | tail(a, q)), F.lit(0))
        return F.when(empty(author) == "", 0.0).otherwise(let(with_last(F.lower(author)), lambda a: let(first(a), lambda q: points(a, q))))

    authors = F.coalesce("authors", F.array().cast("array<string>"))
    by_authors = let(names, lambda asked: F.when(F.size(asked) > 0, F.aggregate(authors, F.lit(0.0), lambda acc, a: acc + author_points(a, asked))).otherwise(0.0))
    keys = F.filter(F.transform(e["keywords"], lambda k: F.lower(k)), lambda k: k != "")
    hits = lambda c: let(F.lower(empty(c)), lambda text: F.size(F.filter(keys, lambda k: F.contains(text, k))))
    venue, wanted = F.lower(empty("venue")), F.lower(F.trim(empty(e["venue"])))
    year, day = F.substring(empty("publication_date"), 1, 4), empty("publication_date")
    said, lo, hi = empty(e["year"]), empty(e["year_from"]), empty(e["year_to"])
    in_years = F.when((said != "") & (year == said), True).when((lo != "") & (hi != ""), (lo <= year) & (year < hi)).otherwise((lo != "") & (year >= lo))
    points = (
        F.when(F.exists(e["paper_ids"], lambda p: F.lower(p) == F.lower("paper_id")), 100.0).otherwise(0.0)
        + by_authors
        + F.when((venue != "") & (wanted != "") & (F.contains(venue, wanted) | F.contains(wanted, venue)), 15.0).otherwise(0.0)
        + hits("title") * 10.0
        + F.when((day != "") & in_years, 5.0).otherwise(0.0)
        + hits("abstract") * 2.0
    )
    rows = kept(results.select(*(results.columns if keep is None else keep), points.alias("_points"), F.coalesce("cited_by_count", F.lit(0)).alias("_cited")))
    most = kept(rows.groupBy("query_id").agg(F.max("_cited").alias("_most")))
    raw = F.col("_points") + F.lit(5.0) * (F.col("_cited") / F.when(F.col("_most") == 0, 1).otherwise(F.col("_most")))
    scored = rows.join(most, "query_id").withColumn("raw", raw).drop("_most", "_points", "_cited")
    edges = kept(scored.groupBy("query_id").agg(F.min("raw").alias("_lo"), F.max("raw").alias("_hi")))
    lo, hi = F.col("_lo"), F.col("_hi")
    scaled = F.when(hi > lo, (F.col("raw") - lo) / (hi - lo)).when(hi > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return scored.join(edges, "query_id").withColumn("relevance", scaled).drop("_lo", "_hi")


def combine_visual(vector: DataFrame, visual: DataFrame, legacy_distance: bool = False, weights: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """vector (query_id, paper_id, score) and visual (query_id, paper_id, visual): weighted sum of the min-max score and the visual one.

    legacy_distance reads the score as a distance, lower first.
    """
    lo, hi = F.min("score").over(by_query()), F.max("score").over(by_query())
    span = F.when(hi > lo, hi - lo).otherwise(1.0)
    similar = 1 - (F.col("score") - lo) / span if legacy_distance else 1 - (hi - F.col("score")) / span
    both = vector.join(visual, ["query_id", "paper_id"], "left").withColumn("similar", similar)
    return both.select("query_id", "paper_id", (weights[0] * F.col("similar") + weights[1] * F.coalesce("visual", F.lit(0.0))).alias("score"))


def merge_visual(image: DataFrame, text: DataFrame, weights: tuple[float, float] = (0.6, 0.4)) -> DataFrame:
    """Image and text hits (query_id, id, paper_id, similarity_score) as one list with search_type; missing scores are 0."""
    i = image.select("query_id", "id", F.col("paper_id").alias("ip"), F.col("similarity_score").alias("i"))
    t = text.select("query_id", "id", F.col("paper_id").alias("tp"), F.col("similarity_score").alias("t"))
    both = i.join(t, ["query_id", "id"], "full_outer")
    kind = F.when(F.col("t").isNull(), "image").when(F.col("i").isNull(), "text").otherwise("hybrid_visual")
    score = F.coalesce("i", F.lit(0.0)) * weights[0] + F.coalesce("t", F.lit(0.0)) * weights[1]
    return both.select("query_id", "id", F.coalesce("ip", "tp").alias("paper_id"), score.alias("similarity_score"), kind.alias("search_type"))


def scope_or_all(hits: DataFrame, allowed: DataFrame) -> DataFrame:
    """hits of allowed papers (query_id, paper_id); if a query has no such hit in any collection, all its hits."""
    flagged = hits.join(allowed.select("query_id", "paper_id").distinct().withColumn("ok", F.lit(True)), ["query_id", "paper_id"], "left")
    some = F.max(F.coalesce("ok", F.lit(False))).over(by_query())
    return flagged.withColumn("some", some).where(F.coalesce("ok", F.lit(False)) | ~F.col("some")).drop("ok", "some")


def best_per(df: DataFrame, keys: list[str], score: str, how: str = "max") -> DataFrame:
    return df.groupBy(*keys).agg(getattr(F, how)(score).alias(score))


def first_seen(df: DataFrame, key: str, order: str, keep_null: bool = True) -> DataFrame:
    """The first row of every key; rows without a key all stay, or all go."""
    w = Window.partitionBy("query_id", key).orderBy(order)
    rows = df.withColumn("_n", F.row_number().over(w))
    return rows.where((F.col("_n") == 1) & F.col(key).isNotNull() | (F.col(key).isNull() if keep_null else F.lit(False))).drop("_n")


def boost(df: DataFrame, requested: Column, score: str, extra: float) -> DataFrame:
    """Requested rows get the query's best score plus extra on top."""
    return df.withColumn(score, F.when(requested, F.col(score) + F.coalesce(F.max(score).over(by_query()), F.lit(1.0)) + extra).otherwise(F.col(score)))


def graph_confidence() -> Column:
    full = lambda c, w: F.when(empty(c) != "", w).otherwise(0.0)
    cited = F.coalesce("cited_by_count", F.lit(0))
    total = (
        full("title", 0.15) + full("abstract", 0.15) + F.least(F.lit(0.20), 0.05 * F.coalesce(F.size("authors"), F.lit(0))) + full("venue", 0.15)
        + full("doi", 0.10) + full("publication_date", 0.05) + F.when(cited > 0, F.least(F.lit(0.20), 0.05 * F.log10(1 + cited))).otherwise(0.0)
    )
    return F.least(total, F.lit(1.0))


def evidence(figures: DataFrame, tables: DataFrame) -> DataFrame:
    """Per query and paper: counts of figures and tables, and the first six, figures before tables, descriptions cut at 200 characters."""
    cols = ["query_id", "paper_id", "id", "description", "similarity_score", "seq"]
    rows = figures.select(*cols, F.lit(0).alias("kind")).unionByName(tables.select(*cols, F.lit(1).alias("kind"))).where("paper_id is not null")
    item = F.struct("kind", "seq", "id", F.substring(empty("description"), 1, 200).alias("description"), "similarity_score")
    return rows.groupBy("query_id", "paper_id").agg(
        F.count_if(F.col("kind") == 0).alias("matched_figures"), F.count_if(F.col("kind") == 1).alias("matched_tables"),
        F.transform(F.slice(F.array_sort(F.collect_list(item)), 1, 6), lambda x: F.struct(x["id"].alias("id"), x["description"].alias("description"), x["similarity_score"].alias("similarity_score"))).alias("visual_evidence"),
    )


def fuse(results: DataFrame, multimodal: DataFrame, visual: DataFrame, proof: DataFrame, requested: DataFrame) -> DataFrame:
    """Typed results: confidences, source path, evidence; requested papers on top; in order of relevance, then of seq."""
    r = results.where("paper_id is not null").join(multimodal, ["query_id", "paper_id"], "left").join(visual, ["query_id", "paper_id"], "left").join(proof, ["query_id", "paper_id"], "left")
    r = r.join(requested.select("query_id", "paper_id").distinct().withColumn("asked", F.lit(True)), ["query_id", "paper_id"], "left")
    vector = F.least(F.greatest(F.coalesce("multimodal", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    r = r.withColumns({"vector_score": vector, "visual_score": F.coalesce("visual", F.lit(0.0)), "graph_score": graph_confidence(), "relevance_score": F.least(F.coalesce("similarity_score", F.lit(0.0)), F.lit(1.0))})
    r = r.withColumns({
        "title": F.coalesce(F.nullif("title", F.lit("")), F.lit("Unknown Title")),
        "source_path": F.array_compact(F.array(F.lit("hybrid_search"), F.when(F.col("vector_score") > 0, "multimodal_search"), F.when(F.col("visual_score") > 0, "visual_search"))),
        "hybrid_confidence": F.round("relevance_score", 4), "multimodal_confidence": F.round("vector_score", 4), "graph_confidence": F.round("graph_score", 4), "visual_confidence": F.round("visual_score", 4),
        "matched_figures": F.coalesce("matched_figures", F.lit(0)), "matched_tables": F.coalesce("matched_tables", F.lit(0)),
    })
    r = kept(r.drop("multimodal", "visual"))
    # The best score comes from an aggregate, so that no task gathers a query's rows.
    tops = kept(r.groupBy("query_id").agg(F.max("relevance_score").alias("_top")))
    more = F.when(F.coalesce("asked", F.lit(False)), F.coalesce("_top", F.lit(1.0)) + 1.0).otherwise(0.0)
    r = r.join(tops, "query_id").withColumn("relevance_score", F.col("relevance_score") + more)
    return numbered(r.drop("asked", "_top"), [F.desc("relevance_score"), F.col("seq")])


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with rank, each row's place in its query by this order; a query's rows are cut into ranges, which are sorted by themselves."""
    rows = kept(rows.repartitionByRange("query_id", *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy("query_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = kept(rows.groupBy("query_id", "_part").agg(F.count("*").alias("n"))).withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("query_id", "_part").orderBy(*order))
    return rows.withColumn("rank", place).join(sizes, ["query_id", "_part"]).withColumn("rank", (F.col("rank") + F.col("_before")).cast("int")).drop("_part", "_before")


def rerank_skip(results: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, skip): three results or fewer, a mean of the first five over 0.9, a structural word, or two words or fewer."""
    words = ("paper id", "author", "cited by", "published in", "journal", "conference", "doi:", "pmid:")
    top5 = Window.partitionBy("query_id").orderBy("seq")
    stats = results.withColumn("n", F.row_number().over(top5)).groupBy("query_id").agg(F.count("*").alias("n"), F.avg(F.when(F.col("n") <= 5, F.col("relevance_score"))).alias("mean5"))
    low = F.lower("query")
    structural = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    short = F.size(F.filter(F.split("query", r"\s+"), lambda w: w != "")) <= 2
    return queries.join(stats, "query_id", "left").select("query_id", ((F.coalesce("n", F.lit(0)) <= 3) | (F.col("mean5") > 0.9) | structural | short).alias("skip"))
