"""File sources and sinks: JSON of several shapes, the latest file, ordered limits, saved templates, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_records(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Records of a JSON file that is a list, {"papers": [...]}, {"data": [...]} or one object; record is its DDL."""
    one = T.StructType.fromDDL(record)
    wrapped = T.StructType([*one, *[T.StructField(n, T.ArrayType(one)) for n in ("papers", "data") if n not in one.names]])
    rows = spark.read.schema(wrapped).option("multiLine", True).json(path)
    own = F.struct(*[F.col(c) for c in one.names])
    inner = [F.when(F.col(n).isNotNull(), F.col(n)) for n in ("papers", "data") if n not in one.names]
    return rows.select(F.explode(F.coalesce(*inner, F.array(own))).alias("r")).select("r.*")


def latest_file(spark: SparkSession, folder: str, pattern: str) -> str | None:
    """The path of the newest file that fits the pattern, ties by path; only the listing is read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime")
    row = found.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).first()
    return row["path"] if row else None


def read_limited(spark: SparkSession, paths: Sequence[str], limit: int) -> DataFrame:
    """The first rows of parquet files in sorted order of their paths."""
    df = spark.read.parquet(*sorted(paths))
    return df.withColumn("_file", F.col("_metadata.file_path")).withColumn("_row", F.monotonically_increasing_id()).orderBy("_file", "_row").limit(limit).drop("_file", "_row")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_records(df: DataFrame, path: str) -> None:
    """JSON lines; times as ISO strings, nulls left out."""
    df.write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss").json(path)


def export(df: DataFrame, path: str, formats: Sequence[str] = ("csv", "json")) -> DataFrame:
    """Write df in several formats below path; (format, files, bytes) of what was written."""
    spark = df.sparkSession
    for kind in formats:
        out = df.write.mode("overwrite")
        (out.option("header", True).option("escape", '"') if kind == "csv" else out).format(kind).save(f"{path}/{kind}")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load([f"{path}/{kind}" for kind in formats]).select("path", "length")
    kind = F.element_at(F.split(F.regexp_replace("path", r"/[^/]*$", ""), "/"), -1)
    return found.groupBy(kind.alias("format")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def report_rows(results: DataFrame, cuts: dict[str, int]) -> DataFrame:
    """Columns cut for a report table, bars escaped and line breaks as spaces."""
    return results.select(*[F.replace(F.regexp_replace(F.substring(F.coalesce(F.col(c).cast("string"), F.lit("")), 1, n), r"\s*\n\s*", " "), F.lit("|"), F.lit("\\|")).alias(c) for c, n in cuts.items()])


def markdown_row(columns: Sequence[str]):
    return F.concat(F.lit("| "), F.array_join(F.array(*columns), " | "), F.lit(" |"))


def save_templates(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Templates (name, text, created_at) by name: new ones replace old ones."""
    return new.select(existing.columns).unionByName(existing.join(new.select("name"), "name", "left_anti")).orderBy("created_at", "name")


def delete_template(existing: DataFrame, name: str) -> DataFrame:
    return existing.where(~F.col("name").eqNullSafe(F.lit(name)))


def mock_samples(spark: SparkSession, n: int, kinds: Sequence[str] = ("fig_result", "fig_architecture", "tab_result", "tab_parameter")) -> DataFrame:
    """Made-up samples; kinds in turn."""
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("id") % len(kinds) + 1).cast("int"))
    return spark.range(n).select(F.concat(F.lit("mock_"), F.col("id").cast("string")).alias("sample_id"), kind.alias("class_label"), F.concat(F.lit("Sample text "), F.col("id").cast("string")).alias("text"))
