"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

Targets: the sources, in code-point order with null last, get weights in turn; together they share ``epochs`` times
all words. No target exceeds ``repeat`` times its source; what is cut off is shared again by weight, which is solved
in closed form by one sort of the sources (one row each) by the level at which they fill up.

Positions: a source's documents lie on a tape in the order of a hash of their ids, laid end to end ``repeat`` times.
The copies whose middle lies before the source's target are taken. A source's weight follows a schedule over training
time, piecewise linear between knots; its integral, scaled to the target, is the demand for its words up to a time.
Inverting the demand at a copy's middle gives its training position in [0, 1], and rows are range-sorted by it.

The tape's prefix sums have two steps, over ``16 ** HEX`` hash buckets of each source and inside each bucket, so that
no source is gathered in one task however large it is.

Defined cases: null text has no words and null ids share one place on the tape; documents without words are taken by
their place like others and add nothing; rows that repeat an id are rows of their own; ties on the tape go by size; a very long text is one document like others, never cut;
an empty table gives an empty result, a source without words the target 0; other columns are carried unchanged.
The targets come from one row a source in one task, which suits up to some millions of sources, not one a document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, named, text_of

HEX = 3
WEIGHTS = (3.0, 1.0, 2.0)
#: Knots (time, factor), dealt to the sources in turn as weights are: early, even and late sources.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))


def word_count(column: str) -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: float = 1.5, repeat: int = 2) -> DataFrame:
    """sizes: one row per source (src, words); adds nth (from 0) and target."""
    order, fill = Window.orderBy("src"), Window.orderBy("ratio", "src")
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    turn = F.element_at(F.lit([float(w) for w in weights]).cast("array<double>"), (F.col("nth") % len(weights) + 1).cast("int"))
    return (
        sizes.withColumn("nth", F.row_number().over(order) - 1)
        .withColumns({"weight": turn, "room": (F.col("words") * repeat).cast("double")})
        .withColumns({"ratio": F.col("room") / F.col("weight"), "share": F.sum("words").over(everything) * F.lit(epochs)})
        .withColumn("level", (F.col("share") - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("level", F.coalesce(F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "src", "level"))).over(everything)["level"], F.max("ratio").over(everything)))
        .select("src", "words", "nth", F.least(F.col("weight") * F.col("level"), "room").alias("target"))
    )


def schedule_time(done: Column, nth: Column, schedules: Sequence = SCHEDULES) -> Column:
    """The time at which a source has had the share ``done`` of its target."""
    out = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False)]
        total, so_far, here = sum(areas), 0.0, F.lit(1.0)
        pieces = []
        for ((t0, w0), (t1, w1)), area in zip(zip(knots, knots[1:], strict=False), areas, strict=True):
            rest, slope = done * F.lit(total) - F.lit(so_far), (w1 - w0) / (t1 - t0)
            at = rest / w0 if slope == 0 else (F.sqrt(F.greatest(F.lit(w0 * w0) + rest * (2 * slope), F.lit(0.0))) - w0) / slope
            so_far += area
            pieces.append((so_far / total, F.lit(t0) + at))
        for upto, at in reversed(pieces):
            here = F.when(done <= upto, at).otherwise(here)
        out = F.when(nth % len(schedules) == k, F.least(F.greatest(here, F.lit(0.0)), F.lit(1.0))).otherwise(out)
    return out


def plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", carry: Sequence[str] = (), weights: Sequence[float] = WEIGHTS, epochs: float = 1.5, repeat: int = 2) -> DataFrame:
    """One row per document: the carried columns in struct ``row``, id, size, source_size, target, copies, positions."""
    source = named(source_col).cast("string")
    sized = docs.select(
        named(id_col).alias("id"),
        word_count(text_col).alias("size"),
        F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source)).alias("src"),
        F.md5(text_of(id_col)).alias("place"),
        F.struct(*([named(c) for c in carry] or [F.lit(0).alias("none")])).alias("row"),
    ).withColumn("bucket", F.substring("place", 1, HEX))
    if not carry:
        sized = cut(sized)
    buckets = cut(sized.groupBy("src", "bucket").agg(F.sum("size").alias("words")))
    goals = targets(buckets.groupBy("src").agg(F.sum("words").alias("words")), weights, epochs, repeat)
    earlier = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select("src", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start")).join(goals, "src")
    inside = Window.partitionBy("src", "bucket").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = sized.join(starts, ["src", "bucket"]).withColumn("middle", F.col("start") + F.sum("size").over(inside) - F.col("size") / 2)
    rounds = F.filter(F.lit(list(range(repeat))).cast("array<int>"), lambda k: F.col("middle") + k * F.col("words") < F.col("target"))
    return laid.withColumn("rounds", rounds).select(
        "row",
        F.col("id").alias(id_col),
        "size",
        F.col("words").alias("source_size"),
        "target",
        F.size("rounds").cast("long").alias("copies"),
        F.transform("rounds", lambda k: schedule_time((F.col("middle") + k * F.col("words")) / F.col("target"), F.col("nth"))).alias("positions"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, once for each copy, range-sorted by training position; columns as in docs."""
    taken = plan(docs, carry=docs.columns, **options).select("row", F.explode("positions").alias("position"))
    spread = F.xxhash64(F.col("row")[options.get("id_col", "doc_id")])
    return taken.orderBy("position", spread).select("row.*")
