"""Cross-modal retrieval benchmark: ranks of matching pairs in both directions, over all pairs and by subset.

Ranks count what beats a pair among all others, so every two pairs meet once. They do so in blocks: a hash of the pair deals
the pairs into blocks of bounded size, each one row of packed vectors, written once. Two blocks meet in a task of
their own, which multiplies texts by images both ways and returns a count for each pair; an aggregate adds the counts up. No
vector passes the driver, nothing is broadcast, and a task holds two blocks and a slice of their products.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import unit
from ..sources.scratch import kept

#: Bytes of one block's vectors, texts and images.
BLOCK_BYTES = 8 << 20
#: Texts whose products with a block's images are held at once.
SLICE = 512
#: Scores this close count as ties, so that the order of summation does not decide.
TIE = 1e-9


def packed(pairs: DataFrame) -> tuple[DataFrame, int]:
    """(block, pairs, subsets, texts, images) with unit vectors as bytes, and the number of blocks."""
    size = pairs.agg(F.sum(8 * (F.size("text") + F.size("image")).cast("long"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    kind = pairs.schema["pair"].dataType.simpleString()
    rows = pairs.select("pair", F.col("subset").cast("string").alias("subset"), unit(F.col("text")).alias("text"), unit(F.col("image")).alias("image"), F.pmod(F.xxhash64("pair"), F.lit(blocks)).cast("int").alias("block"))

    def pack(held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("pair")
        vectors = [[np.stack(held[c].to_numpy()).astype(np.float64).tobytes()] for c in ("text", "image")]
        names = [[held[c].tolist()] for c in ("pair", "subset")]
        return pd.DataFrame(dict(zip(("block", "pairs", "subsets", "texts", "images"), ([held["block"].iloc[0]], *names, *vectors), strict=True)))

    return kept(rows.groupBy("block").applyInPandas(pack, f"block int, pairs array<{kind}>, subsets array<string>, texts binary, images binary")), blocks


def ranks(pairs: DataFrame, within: bool = False) -> DataFrame:
    """pairs (pair, subset, text, image) with t2i and i2t, 1 + the number of strictly better others, of the same subset if within."""
    kind = pairs.schema["pair"].dataType.simpleString()
    rows, blocks = packed(pairs)
    last = F.lit(blocks - 1)
    # Every two blocks i <= j: the first one goes to all later ones, the second one to all earlier ones.
    first = rows.select(F.col("block").alias("i"), F.explode(F.sequence("block", last)).alias("j"), F.lit(0).alias("side"), *rows.columns[1:])
    second = rows.select(F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), *rows.columns[1:])

    def meet(two: pd.DataFrame) -> pd.DataFrame:
        def load(side: int) -> tuple:
            r = two[two["side"] == side].iloc[0]
            n = len(r["pairs"])
            text, image = (np.frombuffer(r[c], np.float64).reshape(n, -1) for c in ("texts", "images"))
            return list(r["pairs"]), np.array([str(x) for x in r["subsets"]]), text, image, (text * image).sum(1) + TIE

        (na, sa, ta, ia, oa), (nb, sb, tb, ib, ob) = load(0), load(1)
        t2i, i2t = np.zeros(len(na) + len(nb), np.int64), np.zeros(len(na) + len(nb), np.int64)
        alone = two["i"].iloc[0] == two["j"].iloc[0]

        def count(x: int, texts, own_texts, of_texts, y: int, images, own_images, of_images) -> None:
            """Texts at place x on meet images at place y on."""
            for s in range(0, len(texts), SLICE):
                e = min(s + SLICE, len(texts))
                products = texts[s:e] @ images.T
                among = of_texts[s:e, None] == of_images[None, :] if within else True
                t2i[x + s : x + e] += ((products > own_texts[s:e, None]) & among).sum(1)
                i2t[y : y + len(images)] += ((products > own_images[None, :]) & among).sum(0)

        count(0, ta, oa, sa, len(na), ib, ob, sb)
        if alone:
            # Texts and images of one block: the images' counts stand at the second copy's places.
            i2t[: len(na)], i2t[len(na) :] = i2t[len(na) :].copy(), 0
        else:
            count(len(na), tb, ob, sb, 0, ia, oa, sa)
        return pd.DataFrame({"pair": na + nb, "t2i": t2i, "i2t": i2t})

    counts = first.unionByName(second).groupBy("i", "j").applyInPandas(meet, f"pair {kind}, t2i long, i2t long")
    sums = counts.groupBy("pair").agg((1 + F.sum("t2i")).alias("t2i"), (1 + F.sum("i2t")).alias("i2t"))
    return pairs.select("pair", "subset").join(sums, "pair")


def benchmark(pairs: DataFrame, within: bool = False) -> DataFrame:
    """MRR and Recall@1, 5, 10 of both directions for all pairs and each subset; within ranks a subset in its own pool."""
    r = ranks(pairs, within)
    metrics = []
    for d in ("t2i", "i2t"):
        metrics += [F.avg(1 / F.col(d)).alias(f"{d}_mrr"), *[F.avg((F.col(d) <= k).cast("double")).alias(f"{d}_r{k}") for k in (1, 5, 10)]]
    return r.groupingSets([[], [F.col("subset")]], F.col("subset")).agg(F.count("*").alias("n"), *metrics).withColumn("subset", F.coalesce("subset", F.lit("all")))
