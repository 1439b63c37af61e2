"""Readers that ask a service: pages by cursor, offset or number, ids in batches and titles one by one, with retries.

All of them take a function ``fetch`` that does the request, so that services, files and tests look alike. Work is spread
over the tasks of the frame that holds what is asked for; a task asks for one batch at a time.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids in one request, letters of a title worth asking for, attempts, longest wait between them.
BATCH, SHORTEST_TITLE, ATTEMPTS, LONGEST_WAIT = 500, 10, 3, 10


class TooManyRequests(Exception):
    """The service asks to slow down: the request is made again after a growing wait."""


def patiently(ask: Callable, attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep):
    """The answer of ask(); after a refusal it waits 1, 2, 4, ... seconds (LONGEST_WAIT at most) and asks again; None if it never answers."""
    for n in range(attempts):
        try:
            return ask()
        except TooManyRequests:
            wait(min(2**n, LONGEST_WAIT))
        except (OSError, ValueError):
            continue
    return None


def by_ids(ids: DataFrame, fetch: Callable[[list], list[dict]], schema: str, size: int = BATCH) -> DataFrame:
    """The records of ids (id), at most ``size`` of them in one request; ids without a record have no row."""
    names = [f.name for f in ids.sparkSession.createDataFrame([], schema).schema]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []

        def flush(n: int) -> pd.DataFrame:
            got = patiently(lambda: fetch(held[:n])) or []
            del held[:n]
            return pd.DataFrame([{c: r.get(c) for c in names} for r in got if r], columns=names)

        for b in batches:
            held += b["id"].tolist()
            while len(held) >= size:
                yield flush(size)
        if held:
            yield flush(len(held))

    return ids.select("id").where("id is not null").distinct().mapInPandas(run, schema)


def by_title(titles: DataFrame, fetch: Callable[[str], list[dict]], schema: str, shortest: int = SHORTEST_TITLE) -> DataFrame:
    """titles (title) of some length with the first record that the service has for each, as JSON-like columns of schema."""
    names = [f.name for f in titles.sparkSession.createDataFrame([], schema).schema]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for title in b["title"]:
                got = patiently(lambda title=title: fetch(title)) or []
                if got:
                    rows.append({"title": title} | {c: got[0].get(c) for c in names})
            yield pd.DataFrame(rows, columns=["title", *names])

    asked = titles.where(F.length(F.trim("title")) >= shortest).select("title").distinct()
    return asked.mapInPandas(run, f"title string, {schema}")


def pages(spark: SparkSession, fetch: Callable[[int, int], list[dict]], total: int, per_page: int, schema: str, numbered: bool = False, tasks: int = 8) -> DataFrame:
    """The first ``total`` records of a list that is read by offset and limit, or with numbered by page number (from 1) and size.

    Pages are independent of each other, so they are asked for by several tasks; a page that is short or missing gives what it has.
    """
    names = [f.name for f in spark.createDataFrame([], schema).schema]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for page in b["id"].tolist():
                limit = min(per_page, total - page * per_page)
                got = patiently(lambda page=page, limit=limit: fetch(page + 1 if numbered else page * per_page, per_page if numbered else limit)) or []
                yield pd.DataFrame([{c: r.get(c) for c in names} for r in got[:limit]], columns=names)

    return spark.range(0, -(-total // per_page), 1, tasks).mapInPandas(run, schema)


def made_up(n: int) -> dict:
    """A made-up work, for tests and demonstrations."""
    return {"id": f"W{n}", "title": f"Work number {n}", "cited_by_count": n % 7}


def ontology_classes(records: DataFrame) -> DataFrame:
    """records (raw JSON of a class) as id, label, synonyms, definition, parents; classes without an id are left out."""
    kind = "`@id` string, prefLabel string, synonym array<string>, definition array<string>, parents array<string>, obsolete boolean"
    r = records.select(F.from_json("raw", kind).alias("r"))
    some = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    return r.where(F.col("r")["@id"].isNotNull()).select(
        F.col("r")["@id"].alias("id"), F.col("r.prefLabel").alias("label"), some(F.col("r.synonym")).alias("synonyms"), F.get("r.definition", F.lit(0)).alias("definition"),
        some(F.col("r.parents")).alias("parents"), F.coalesce("r.obsolete", F.lit(False)).alias("obsolete"),
    )


def hierarchy(classes: DataFrame) -> DataFrame:
    """(id, label, parents, children): the labels of the classes above and below each class, sorted."""
    edges = classes.select(F.col("id").alias("child"), F.explode("parents").alias("parent")).distinct()
    names = classes.select("id", "label")
    up = edges.join(names, edges.parent == names.id).groupBy("child").agg(F.array_sort(F.collect_set("label")).alias("above"))
    down = edges.join(names, edges.child == names.id).groupBy("parent").agg(F.array_sort(F.collect_set("label")).alias("children"))
    none = F.array().cast("array<string>")
    out = names.join(up.withColumnRenamed("child", "id"), "id", "left").join(down.withColumnRenamed("parent", "id"), "id", "left")
    return out.select("id", "label", F.coalesce("above", none).alias("parents"), F.coalesce("children", none).alias("children"))


def search_classes(classes: DataFrame, words: str) -> DataFrame:
    """The classes whose label or a synonym holds the words, ignoring case; equal labels first, obsolete ones never."""
    w = words.lower()
    holds = F.contains(F.lower("label"), F.lit(w)) | F.exists("synonyms", lambda s: F.contains(F.lower(s), F.lit(w)))
    return classes.where(~F.col("obsolete") & F.coalesce(holds, F.lit(False))).withColumn("exact", F.lower("label") == w).orderBy(F.desc("exact"), "label", "id")
