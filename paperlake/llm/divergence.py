"""Source divergence audit: how far the word distributions of a language's sources lie apart, by a heavy-light split.

Terms are runs of letters A-Z and of characters past ASCII, with A-Z lower-cased. A language keeps the terms that at least
``LEAST_DOCS`` of its documents hold. A group is a source within a language; with n occurrences of a term, N of all
kept terms and V kept terms, its smoothed probability in parts of a billion is p = 1 + floor(10^9 (n + 5) / (N + 5V)),
and the distance of two groups is the sum of |p - q| over the V kept terms. All arithmetic is on integers.

A term that does not occur in a group has the group's base probability there, so the distance starts from
V |base_a - base_b| and every occurring term only corrects it:

* heavy terms, in more than ``HEAVY`` groups, fill dense tiles of ``TILE_GROUPS`` groups by some ``TILE_TERMS`` terms, one
  for each pair of blocks of groups, and numpy takes the differences of whole rows;
* light terms stay postings. Two groups of one posting list, at most ``HEAVY`` long, correct their own pair. What a
  posting does to the pairs with groups that lack the term depends on the other group only through its base, so it is
  read off sorted probabilities and their prefix sums, for all other groups at once.

Both kinds of corrections are partial sums of integers that one aggregate adds up.

On Spark: a task counts its documents' terms for each group and hands on a row for each distinct one, so a hot source or
word is aggregated before the shuffle; counts, kept terms and groups are written once. Lists of a language's sources are as
long as a row of the answer, which has a row for each pair of them.

Defined cases: null texts, languages and sources count as empty strings; a document without terms still makes its
group occur; a language without kept terms has pairs of distance 0 and no terms; repeated rows are documents of their own; equal
values rank by item in UTF-8; a language of one source has no pairs; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, text_of

LEAST_DOCS, TOP_TERMS = 30, 50
HEAVY, TILE_GROUPS, TILE_TERMS = 8, 64, 4096
#: Distinct terms that a task holds before it hands them on.
HELD = 400_000
#: What becomes of each byte: letters are lower-cased, bytes past ASCII stay, all others part the terms.
FOLD = bytes(b if b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def counted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of every term in every group and the documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in every.items():
                if n:
                    terms = pa.array(list(n), pa.binary()).cast(pa.string())
                    named = [pa.array([x] * len(n), pa.string()) for x in (lang, source)]
                    yield pa.RecordBatch.from_arrays([*named, terms, pa.array(list(n.values()), pa.int64()), pa.array([d[t] for t in n], pa.int64())], names=["lang", "source", "term", "n", "docs"])
            every.clear()

        held = 0
        for b in batches:
            langs, sources = b.column("lang").to_pylist(), b.column("source").to_pylist()
            for k, group in enumerate(zip(langs, sources, strict=True)):
                terms = terms_of(b.column("text")[k].as_py())
                if group not in every:
                    every[group] = Counter(), Counter()
                n, d = every[group]
                held -= len(n)
                n.update(terms)
                d.update(set(terms))
                held += len(n)
                if held > HELD:
                    yield from flush()
                    held = 0
        yield from flush()

    rows = docs.select(text_of(text_col).cast("binary").alias("text"), text_of(lang_col).alias("lang"), text_of(source_col).alias("source"))
    partial = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def smoothed(n: str, size: str, kept: str) -> Column:
    """p of a count n among size occurrences of ``kept`` terms; the products need more than 64 bits."""
    return F.expr(f"1 + (CAST({n} AS DECIMAL(20, 0)) + 5) * 1000000000 DIV (CAST({size} AS DECIMAL(20, 0)) + 5 * {kept})")


def _tiles(posts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, v): corrections by heavy terms, in dense tiles. posts: lang, term, nth, p, chunks, blocks; groups: lang, nth, base, chunks, blocks."""

    def tile(rows: pd.DataFrame) -> pd.DataFrame:
        known = rows[rows["term"].isna()].drop_duplicates("nth").sort_values("nth")
        at, base = known["nth"].to_numpy(), known["p"].to_numpy()
        found = rows[rows["term"].notna()]
        if found.empty:
            return pd.DataFrame({"lang": [], "a": [], "b": [], "v": []})
        term = pd.factorize(found["term"])[0]
        dense = np.repeat(base[:, None], term.max() + 1, axis=1)
        dense[np.searchsorted(at, found["nth"].to_numpy()), term] = found["p"].to_numpy()
        i, j = rows["i"].iloc[0], rows["j"].iloc[0]
        left, right = np.flatnonzero(at // TILE_GROUPS == i), np.flatnonzero(at // TILE_GROUPS == j)
        a, b, v = [], [], []
        for x in left:
            others = right[right > x]
            a.append(np.full(len(others), at[x]))
            b.append(at[others])
            v.append(np.abs(dense[others] - dense[x]).sum(1) - dense.shape[1] * np.abs(base[others] - base[x]))
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "a": np.concatenate(a), "b": np.concatenate(b), "v": np.concatenate(v)})

    own = F.floor(F.col("nth") / TILE_GROUPS).cast("int")
    every = posts.select("lang", "term", "nth", "p", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int").alias("chunk"), "blocks").unionByName(
        groups.where("chunks > 0").select("lang", F.lit(None).cast("string").alias("term"), "nth", F.col("base").alias("p"), F.explode(F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int"))).alias("chunk"), "blocks")
    )
    met = every.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    met = met.select("lang", "chunk", F.least(own, "other").alias("i"), F.greatest(own, "other").alias("j"), "term", "nth", "p")
    return met.groupBy("lang", "chunk", "i", "j").applyInPandas(tile, "lang string, a int, b int, v long")


def _shared(posts: DataFrame) -> DataFrame:
    """(lang, a, b, v): what light terms add for two groups that both hold them. posts: lang, term, nth, p, base."""
    lists = posts.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("nth", "p", "base"))).alias("held")).where("size(held) > 1")
    alone = lambda x, y: F.when(y["base"] <= x["base"], x["p"] - x["base"]).when(y["base"] >= x["p"], x["base"] - x["p"]).otherwise(x["p"] + x["base"] - 2 * y["base"])
    value = lambda x, y: F.abs(x["p"] - y["p"]) - F.abs(x["base"] - y["base"]) - alone(x, y) - alone(y, x)
    pair = lambda x, y: F.struct(x["nth"].alias("a"), y["nth"].alias("b"), value(x, y).alias("v"))
    pairs = F.flatten(F.transform("held", lambda x, i: F.transform(F.slice("held", i + 2, HEAVY), lambda y: pair(x, y))))
    return lists.select("lang", F.inline(pairs)).groupBy("lang", "a", "b").agg(F.sum("v").alias("v"))


def _lacking(posts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, v) of all pairs: V times the distance of the bases, and the corrections by light terms as if the other group lacked them."""
    many = posts.groupBy("lang", "nth", "p").agg(F.count("*").alias("m")).groupBy("lang", "nth").agg(F.collect_list(F.struct("p", "m")).alias("held"))
    others = groups.groupBy("lang").agg(F.collect_list(F.struct("nth", "base")).alias("groups"))
    rows = groups.select("lang", "nth", "base", "kept").join(many, ["lang", "nth"], "left").join(others, "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                at, base = (np.array([g[k] for g in r["groups"]], np.int64) for k in ("nth", "base"))
                held = sorted((h["p"], h["m"]) for h in r["held"] or ())
                p, m = (np.array([h[k] for h in held], np.int64) for k in (0, 1))
                # Sums over the terms up to each one, of how many there are and of their probabilities.
                n, s = (np.concatenate([[0], np.cumsum(x)]) for x in (m, m * p))
                k, mine = np.searchsorted(p, base, side="right"), r["base"]
                near = n[k] * mine - s[k]
                far = (s[-1] - s[k]) + (n[-1] - n[k]) * (mine - 2 * base)
                v = np.where(base <= mine, s[-1] - n[-1] * mine, near + far)
                v += np.where(at > r["nth"], r["kept"] * np.abs(base - mine), 0)
                other = at != r["nth"]
                at, v = at[other], v[other]
                ends = [pa.array(f(at, r["nth"]).astype(np.int32)) for f in (np.minimum, np.maximum)]
                yield pa.RecordBatch.from_arrays([pa.array([r["lang"]] * len(at), pa.string()), *ends, pa.array(v)], names=["lang", "a", "b", "v"])

    return rows.mapInArrow(run, "lang string, a int, b int, v long")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair``, all other sources of the language by distance; part
    ``term``, the ``top`` terms that the source uses more than its language does, by how much."""
    counts = cut(counted(docs, text_col, lang_col, source_col))
    in_lang = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.count("*").alias("groups"))
    kept = cut(in_lang.where(F.col("docs") >= least_docs).select("lang", "term", "lang_n", "groups"))
    posts = cut(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]))
    drop_cut(counts)
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_size"), F.count_if(F.col("groups") > HEAVY).alias("heavy"))
    sizes = posts.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    occurring = docs.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source")).distinct()
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("size", "kept", "lang_size", "heavy")}
    groups = occurring.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").withColumns(zero)
    groups = groups.withColumns(
        {
            "base": F.when(F.col("kept") > 0, smoothed("0", "size", "kept")).otherwise(0),
            "nth": F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1,
            "blocks": F.ceil(F.count("*").over(Window.partitionBy("lang")) / TILE_GROUPS),
            "chunks": F.ceil(F.col("heavy") / TILE_TERMS),
        }
    )
    groups = cut(groups)
    placed = cut(posts.join(groups, ["lang", "source"]).withColumn("p", smoothed("n", "size", "kept")))
    light, heavy = placed.where(F.col("groups") <= HEAVY), placed.where(F.col("groups") > HEAVY)
    parts = _lacking(light, groups).unionByName(_shared(light)).unionByName(_tiles(heavy, groups))
    sums = cut(parts.groupBy("lang", "a", "b").agg(F.sum("v").alias("value")))
    names = groups.select("lang", "nth", "source")
    spelled = sums.join(names.withColumnsRenamed({"nth": "a", "source": "one"}), ["lang", "a"]).join(names.withColumnsRenamed({"nth": "b", "source": "two"}), ["lang", "b"])
    ends = F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item")))
    pairs = spelled.select("lang", "value", F.inline(ends)).select("lang", "source", "item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = placed.withColumn("value", F.col("p") - smoothed("lang_n", "lang_size", "kept")).where("value > 0")
    terms = over.select("lang", "source", F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", "rank")
