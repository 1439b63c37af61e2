"""The corpus pipeline: toxic documents go, repeated lines go, one document of each near-duplicate group stays, sources
are mixed to their target weights, and what is left is encoded, and decoded from the ids.

Each stage takes (spark, docs, sf_dir) and returns the rows of the next one's docs; all but the last keep the columns
of documents. A text that line de-duplication shortens gets its own ``n_chars``; a document that it empties stays as
an empty one. Mixing gives a row for each copy that the mix takes, range-sorted by training position.

Defined cases, for each stage: an operator sees the columns that it works on, and all others travel beside them in a
struct, so columns named like an operator's own (score, threshold, rejected, n_lines, n_removed) keep their
values; the last stage alone adds columns, and ids, decoded and n_tokens of documents give way to its own. Null texts are
empty to every stage and stay null up to the last one; rows without an id stay until mixing and share one place there;
rows that repeat an id and a text share each decision; ties are broken as the operators say; an empty table stays empty, with
the same columns, and so does one without labels: then nothing is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.llm import bpe, line_dedup, minhash_dedup, mixing, toxicity
from paperlake.llm.common import cut, named, read
from paperlake.llm.queries import vocabulary


def packed(docs: DataFrame, *seen: str) -> DataFrame:
    """The columns that an operator sees, and all others in the struct ``row``."""
    rest = [named(c) for c in docs.columns if c not in seen] or [F.lit(None).cast("int").alias("none")]
    return docs.select(*[named(c) for c in seen], F.struct(*rest).alias("row"))


def unpacked(done: DataFrame, columns: list[str], *seen: str) -> DataFrame:
    """The columns as they were, those that the operator saw from its result."""
    return done.select(*[named(c) if c in seen else F.col("row")[c].alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    seen = [c for c in ("doc_id", "text", "lang") if c in docs.columns]
    lang = "lang" if "lang" in seen else None
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), lang_col=lang)
    return unpacked(toxicity.score(packed(docs, *seen), model, lang_col=lang).where(~F.col("rejected")), docs.columns, *seen)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = line_dedup.line_dedup(packed(docs, "doc_id", "text"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("row.n_chars"))
        done = done.withColumn("row", F.col("row").withField("n_chars", n_chars))
    return unpacked(done, docs.columns, "doc_id", "text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.keep_representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = bpe.encode(docs, vocabulary(), carry=[c for c in docs.columns if c not in ("text", "n_tokens")], decoded=True)
    return done.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can express neither the classifier nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
