"""The property graph as DataFrames: one table per node label, one two-column table per relation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass
class Graph:
    """papers(id, title, abstract, doi, publication_date, cited_by_count, pdf_url); authors, venues, institutions (id, name);
    authored(author_id, paper_id), published_in(paper_id, venue_id), associated_with(paper_id, inst_id), cites(src_id, dst_id)."""

    papers: DataFrame
    authors: DataFrame
    venues: DataFrame
    institutions: DataFrame
    authored: DataFrame
    published_in: DataFrame
    associated_with: DataFrame
    cites: DataFrame

    def register(self) -> None:
        """Name the tables in the session catalog, for raw SQL over the graph."""
        for name in self.__dataclass_fields__:
            getattr(self, name).createOrReplaceTempView(name)


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of the order star schema: orders are papers, suppliers authors, nations venues, brands institutions, and an
    order cites the same customer's previous one."""
    t = lambda name: table(spark, sf_dir, name)
    orders, lines = t("orders"), t("lineitem")
    paper = lambda c: F.concat(F.lit("W"), F.col(c).cast("string"))
    papers = orders.select(
        paper("o_orderkey").alias("id"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" "), F.col("o_orderpriority")).alias("title"),
        F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("Status "), "o_orderstatus", F.lit(" for customer "), F.col("o_custkey").cast("string"))).alias("abstract"),
        F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("10.5555/"), F.col("o_orderkey").cast("string"))).alias("doi"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("publication_date"),
        F.floor("o_totalprice").cast("bigint").alias("cited_by_count"),
        F.lit(None).cast("string").alias("pdf_url"),
    )
    earlier = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return Graph(
        papers,
        t("supplier").select(F.concat(F.lit("A"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name")),
        t("nation").select(F.concat(F.lit("V"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name")),
        t("part").select(F.col("p_brand").alias("id"), F.col("p_brand").alias("name")).distinct(),
        lines.select(F.concat(F.lit("A"), F.col("l_suppkey").cast("string")).alias("author_id"), paper("l_orderkey").alias("paper_id")).distinct(),
        orders.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(paper("o_orderkey").alias("paper_id"), F.concat(F.lit("V"), F.col("c_nationkey").cast("string")).alias("venue_id")),
        lines.join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select(paper("l_orderkey").alias("paper_id"), F.col("p_brand").alias("inst_id")).distinct(),
        orders.select(paper("o_orderkey").alias("src_id"), F.concat(F.lit("W"), earlier.cast("string")).alias("dst_id")).where("dst_id is not null"),
    )
