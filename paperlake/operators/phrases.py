"""Which of many phrases occur in which of many texts: a token index with neighbours in place of texts times phrases.

A text's tokens are its runs of non-blanks. The index has a row for each text and distinct token with the tokens before and after
it, and the vocabulary of all tokens with their counts. A phrase that occurs in a text has its inner tokens whole, its first
token at the end of one and its last token at the start of one, side by side. So a phrase

* of one token lies inside a token: distinct tokens meet phrases by a join on the phrase's first three letters;
* of three tokens or more meets the neighbourhoods of its rarest inner token by a join, and the neighbours are
  checked, whole or in part; one with an inner token that no text has is dropped before;
* of two tokens meets the tokens that end with its first or start with its last one, whichever is longer, and then the neighbours.

Both sides of these joins grow, so neither is broadcast.

Neighbourhoods are distinct over the corpus, so a common one is checked once. Only texts that hold one that fits are
compared with the phrase itself, which settles longer phrases and the blanks between tokens.

Phrases without anything but blanks are in no text; null texts hold nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept, shuffled

BLANK = r"\s+"
#: Letters of the longest gram by which phrases of one token meet tokens.
GRAM = 3


@dataclass
class PhraseIndex:
    """texts: id, t and what else they carry; posts: id, token, before, after and the same; tokens: token, n."""

    texts: DataFrame
    posts: DataFrame
    tokens: DataFrame

    @property
    def carried(self) -> list[str]:
        return [c for c in self.texts.columns if c not in ("id", "t")]


def phrase_index(texts: DataFrame) -> PhraseIndex:
    """texts: id, t (in the case in which phrases are asked) and columns to carry; written once for any number of batches of phrases."""
    rest = [c for c in texts.columns if c not in ("id", "t")]
    words = F.filter(F.split("t", BLANK), lambda x: x != "")
    near = lambda w, i: F.coalesce(F.get("words", i), F.lit(""))
    around = F.array_distinct(F.transform("words", lambda w, i: F.struct(w.alias("token"), F.when(i > 0, near(w, i - 1)).otherwise("").alias("before"), near(w, i + 1).alias("after"))))
    posts = kept(texts.select("id", *rest, words.alias("words")).select("id", *rest, F.inline(around)))
    return PhraseIndex(texts, posts, kept(posts.groupBy("token").agg(F.count("*").alias("n"))))


def first_rows(rows: DataFrame, by: str, order: list[Column] | None, k: int | None) -> DataFrame:
    """The first k rows of each value of ``by``; all without k. Spark cuts every task's rows to k a value before they move."""
    if k is None or order is None:
        return rows
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def holding(index: PhraseIndex, phrases: DataFrame, order: list[Column] | None = None, k: int | None = None) -> DataFrame:
    """(w, id, carried columns): the texts that hold each phrase (w) as ``contains`` finds them, ignoring the phrase's case; with k, a phrase's first ones in this order.

    Each kind of phrase is found by plans of its own, which write what they find, and kinds that no phrase has are not planned:
    what the driver holds of plans does not add up.
    """
    rest = index.carried
    parts = F.split("low", BLANK)
    asked = kept(phrases.select("w").distinct().withColumn("low", F.lower("w")).withColumn("parts", parts).where(r"low rlike '\\S'"))
    n = F.size("parts")
    ones, twos, more = asked.agg(F.count_if(n == 1), F.count_if(n == 2), F.count_if(n > 2)).first()
    found = [kept(_inside(index, asked.where("size(parts) = 1"), order, k))] if ones else []
    fits = [kept(f(index, asked.where(kind))) for f, kind, any_of in ((_inner, "size(parts) > 2", more), (_two, "size(parts) = 2", twos)) if any_of]
    for fit in fits:
        met = kept(index.posts.join(shuffled(fit), ["token", "before", "after"]).select("w", "low", "id").distinct())
        found.append(kept(index.texts.join(shuffled(met), "id").where(F.contains("t", "low")).select("w", "id", *rest)))
    if not found:
        return index.texts.limit(0).select(F.lit("").alias("w"), "id", *rest)
    out = found[0]
    for d in found[1:]:
        out = out.unionByName(d)
    return first_rows(out, "w", order, k)


def _inside(index: PhraseIndex, asked: DataFrame, order: list[Column] | None, k: int | None) -> DataFrame:
    gram = lambda i, n: F.substring(F.col("token"), i, F.lit(n))
    of_length = lambda n: F.when(F.length("token") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length("token") - (n - 1), F.lit(1))), lambda i: gram(i, n)))
    every_gram = F.array_distinct(F.flatten(F.array_compact(F.array(*[of_length(n) for n in range(1, GRAM + 1)]))))
    grams = index.tokens.select("token", F.explode(every_gram).alias("gram"))
    found = kept(grams.join(shuffled(asked.withColumn("gram", F.substring("low", 1, GRAM))), "gram").where(F.contains("token", "low")).select("token", "w"))
    every = index.posts.join(shuffled(found.select("token").distinct()), "token", "left_semi").select("token", "id", *index.carried).distinct()
    # Of a phrase's first k texts each is so among those of the token that holds the phrase.
    return first_rows(every, "token", order, k).join(shuffled(found), "token").select("w", "id", *index.carried).distinct()


def _contexts(index: PhraseIndex) -> DataFrame:
    return index.posts.select("token", "before", "after").distinct()


def _inner(index: PhraseIndex, asked: DataFrame) -> DataFrame:
    """(w, low, token, before, after): neighbourhoods of the rarest inner token that fit phrases of three tokens or more."""
    n = F.size("parts")
    inner = asked.select("w", "low", "parts", F.posexplode(F.slice("parts", F.lit(2), n - 2)).alias("i", "token")).where("token <> ''")
    known = inner.join(shuffled(index.tokens), "token").groupBy("w", "low", "parts").agg(F.min(F.struct("n", "i", "token")).alias("rare"), F.count("*").alias("found"))
    # parts[i] stands before the inner token i and parts[i + 2] behind it, counted from 0.
    wanted = F.size(F.filter(F.slice("parts", F.lit(2), n - 2), lambda x: x != ""))
    rare = known.where(F.col("found") == wanted).select("w", "low", "parts", F.col("rare.i").alias("i"), F.col("rare.token").alias("token"))
    before, after = F.get("parts", F.col("i")), F.get("parts", F.col("i") + 2)
    left = F.when(F.col("i") == 0, F.endswith("before", before)).otherwise(F.col("before") == before)
    right = F.when(F.col("i") + 3 == n, F.startswith("after", after)).otherwise(F.col("after") == after)
    return _contexts(index).join(shuffled(rare), "token").where(left & right).select("w", "low", "token", "before", "after")


def _two(index: PhraseIndex, asked: DataFrame) -> DataFrame:
    """(w, low, token, before, after): neighbourhoods that fit phrases of two tokens."""
    a, b = F.get("parts", F.lit(0)), F.get("parts", F.lit(1))
    ends = F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.struct(F.lit(True).alias("first"), F.substring(F.col("token"), i, F.length("token")).alias("key")))
    starts = F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.struct(F.lit(False).alias("first"), F.substring(F.col("token"), F.lit(1), i).alias("key")))
    keyed = index.tokens.select("token", F.inline(F.concat(ends, starts)))
    first = F.length(a) >= F.length(b)
    rare = asked.select("w", "low", first.alias("first"), F.when(first, a).otherwise(b).alias("key"), F.when(first, b).otherwise(a).alias("other"))
    tokens = keyed.join(shuffled(rare), ["first", "key"]).select("w", "low", "first", "other", "token")
    fit = F.when(F.col("first"), F.startswith("after", F.col("other"))).otherwise(F.endswith("before", F.col("other")))
    return _contexts(index).join(shuffled(tokens), "token").where(fit).select("w", "low", "token", "before", "after")
