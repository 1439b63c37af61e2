"""Exact de-duplication by recipes of content-defined chunks.

Each text is normalised (runs of blanks become one space) and cut where its own content says so: after at least
``MIN_CHUNK`` characters, at the next sentence mark followed by a space, at ``MAX_CHUNK`` at the latest. A chunk's
identifier is a 128-bit hash that is verified: all chunks of the corpus are de-duplicated once, by identifier and
text, and no identifier may stand for two texts. A text is then its recipe, the ordered list of its chunks'
identifiers, some 3 % of its length; only recipes are grouped and joined, so long texts move once. Should one
identifier ever stand for two chunks, all recipes carry their whole texts as well, so that results stay exact.

Defined cases: null text equals the empty text; a null id never wins over another id and is kept only in a group
that has no other id; rows that repeat an id share its decision; very long texts have long recipes and are compared whole; an empty table gives an empty result; columns
other than the id and the text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, named, text_of

MIN_CHUNK, MAX_CHUNK = 256, 2048


def chunks_of(text: Column) -> Column:
    pattern = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?[.!?] |.{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _first(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def _second(chunk: Column) -> Column:
    return F.xxhash64(F.lit("recipe"), chunk)


def collisions(texts: DataFrame) -> DataFrame:
    """(a, b) of every identifier that stands for more than one chunk of texts.norm; empty unless hashes collide."""
    chunk = texts.select(F.explode(chunks_of(F.col("norm"))).alias("chunk"))
    known = chunk.groupBy(_first(F.col("chunk")).alias("a"), _second(F.col("chunk")).alias("b"), "chunk").agg(F.lit(1).alias("one"))
    return known.groupBy("a", "b").agg(F.sum("one").alias("texts")).where("texts > 1").select("a", "b")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256, n_chunks."""
    texts = docs.select(named(id_col).alias("id"), F.regexp_replace(text_of(text_col), SPACE, " ").alias("norm"))
    twice = collisions(texts).limit(1).count() > 0
    body = F.transform(chunks_of(F.col("norm")), lambda c: F.array(_first(c), _second(c)))
    recipe = F.struct(F.flatten(body).alias("ids"), (F.col("norm") if twice else F.lit("")).alias("spelled"))
    recipes = cut(texts.select("id", F.sha2("norm", 256).alias("text_sha256"), recipe.alias("recipe")))
    groups = recipes.groupBy("recipe").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    # Written first, so that the join reads two plain exchanges and a group of very many copies can be split.
    known = recipes.join(cut(groups), "recipe", "left").withColumn("keep_id", F.when(F.col("copies").isNull(), F.col("id")).otherwise(F.col("first")))
    return known.select(
        F.col("id").alias(id_col),
        "keep_id",
        F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        (F.size("recipe.ids") / 2).cast("long").alias("n_chunks"),
    )
