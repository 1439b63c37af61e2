"""Perceptual near-copies over a whole corpus by multi-index hashing.

Two hashes that differ in at most ``bound`` bits agree in one of ``bound + 1`` bands, whatever the bits are, so hashes meet by a
hash join on (place, band) and only those that meet are compared. Equal hashes are one with a count, so a very common
image costs no more than another. Bands are runs of hexadecimal digits: the longer a hash for its bound, the fewer
meet by chance; 1,024 bits with a bound of 5 have bands of 168 bits.

Null hashes are near nothing; hashes of different lengths never meet; equal rows are copies of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept


def near_pairs(hashes: DataFrame, bound: int) -> DataFrame:
    """(a, b) of all ordered pairs of different hashes (hash: array of longs, distinct) within ``bound`` bits."""
    digits = F.array_join(F.transform("hash", lambda w: F.lpad(F.hex(w), 16, "0")), "")
    width = F.floor(F.length("digits") / (bound + 1)).cast("int")
    # The last band has what is left over.
    band = lambda i: F.substring(F.col("digits"), F.lit(i) * width + 1, width if i < bound else F.length("digits"))
    keys = F.array(*[F.struct(F.lit(i).alias("place"), band(i).alias("band")) for i in range(bound + 1)])
    rows = kept(hashes.withColumn("digits", digits).where(F.length("digits") > bound).select("hash", F.length("digits").alias("size"), F.inline(keys)))
    other = rows.withColumnRenamed("hash", "b")
    bits = F.aggregate(F.zip_with("a", "b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    met = rows.withColumnRenamed("hash", "a").join(other, ["size", "place", "band"]).where("a <> b").select("a", "b").where(bits <= bound)
    return met.distinct()


def near_copies(items: DataFrame, bound: int = 5) -> DataFrame:
    """items (id, hash) with n_near, the other items within ``bound`` bits, first, the smallest id among them and itself, and unseen, whether that is itself."""
    groups = kept(items.where("hash is not null").groupBy("hash").agg(F.count("*").alias("n"), F.min("id").alias("least")))
    around = near_pairs(groups.select("hash"), bound).join(groups.withColumnsRenamed({"hash": "b", "n": "more", "least": "other"}), "b")
    sums = around.groupBy(F.col("a").alias("hash")).agg(F.sum("more").alias("more"), F.min("other").alias("other"))
    known = kept(groups.join(sums, "hash", "left").select("hash", (F.col("n") + F.coalesce("more", F.lit(0))).alias("all"), F.least("least", "other").alias("first")))
    out = items.join(known, "hash", "left")
    return out.select("id", F.coalesce(F.col("all") - 1, F.lit(0)).alias("n_near"), F.coalesce("first", "id").alias("first"), F.coalesce(F.col("first").eqNullSafe(F.col("id")) | F.col("first").isNull(), F.lit(True)).alias("unseen"))
