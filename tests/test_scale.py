"""Work that has to grow with the input and no faster."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from paperlake import catalog
from paperlake.operators import attribution as A
from paperlake.operators import ranking as R
from paperlake.operators import vector as V

catalog.load()


def test_relevance_counts_each_row_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def title(k):
        seen.add(1)
        return f"graph {k}"

    e = F.struct(F.array().cast("array<string>").alias("paper_ids"), F.array(F.lit("Ada Lovelace")).alias("author_names"), F.array(F.lit("graph")).alias("keywords"), *[F.lit(None).cast("string").alias(c) for c in ("venue", "year", "year_from", "year_to")])
    rows = spark.range(50).select(F.lit(1).alias("query_id"), F.col("id").cast("string").alias("paper_id"), title("id").alias("title"), F.lit("no").alias("abstract"), F.array(F.lit("A. Lovelace"), F.lit("ada lovelace"), F.lit(None).cast("string")).alias("authors"), F.lit(None).cast("string").alias("venue"), F.lit("1999").alias("publication_date"), F.col("id").alias("cited_by_count"), e.alias("entities"))
    got = {r.paper_id: r for r in R.relevance(rows).collect()}
    assert seen.value == 50
    assert {k: r.raw for k, r in got.items()} == {str(k): 10.0 + 20.0 + 10.0 + 5.0 * (k / 49) for k in range(50)}
    assert got["0"].relevance == 0 and got["49"].relevance == 1


def test_spans_evaluate_the_answer_in_few_places():
    c = F.col
    assert str(A.spans(c("the_answer"), c("t"), c("a"), c("b"), c("n"))).count("the_answer") <= 4


def test_products_of_a_task_are_bounded_and_equal_vectors_tie(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(3000, 7)).astype(np.float32)
    x[40:2900:7] = x[5]
    q = V.Block(list(range(1200)), x[:1200].astype(float), np.full(1200, 7), np.sqrt(V.ordered(x[:1200].astype(float), x[:1200].astype(float))), None, {})
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(list(x))], names=["id", "vector"])
    assert max(s.size for *_, s in V.tiles(batch, q)) <= V.ROWS * V.QUERIES and sum(s.size for *_, s in V.tiles(batch, q)) == 3000 * 1200
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x[:400])] + [(400, None, 0), (401, [1.0, None] + [0.0] * 5, 1), (402, [1.0, 2.0], 2), (403, [0.0] * 7, None), (404, [math.nan] * 7, 0)]
    corpus = spark.createDataFrame(rows, "id long, vector array<float>, label int").repartition(3)
    queries = corpus.where("id % 40 = 5 or id > 399").withColumnRenamed("id", "query_id")
    score = V.cosine(F.col("vector"), F.col("v")).alias("similarity_score")
    pairs = queries.withColumnRenamed("label", "asked").crossJoin(corpus.select("id", "label", F.col("vector").alias("v"))).select("query_id", "asked", "id", "label", score)
    key = lambda rows: sorted((a.query_id, a["rank"], a.id, str(a.similarity_score)) for a in rows)
    assert key(V.dense_topk(queries, corpus, 9).collect()) == key(V.best(pairs, 9).collect())
    assert key(V.dense_topk(queries, corpus, 9, by="label").collect()) == key(V.best(pairs.where("label = asked"), 9).collect())
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity_score"), "id"))
    want = {(a.query_id, a.id): a.n - 1 for a in pairs.where("id <> query_id").withColumn("n", place).collect()}
    some = pairs.where("id % 5 = 1 and id <> query_id").join(queries.select("query_id", "vector"), "query_id")
    assert {(a.query_id, a.id): a.above for a in V.rows_above(some, corpus, own=False).collect()} == {k: v for k, v in want.items() if k[1] % 5 == 1}
    rounded = pairs.withColumn("similarity_score", F.round("similarity_score", 2))
    place = F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("similarity_score")))
    want = {(a.query_id, a.id): a.n - 1 for a in rounded.withColumn("n", place).collect()}
    some = rounded.where("id % 5 = 1").join(queries.select("query_id", "vector"), "query_id")
    assert {(a.query_id, a.id): a.above for a in V.rows_above(some, corpus, digits=2).collect()} == {k: v for k, v in want.items() if k[1] % 5 == 1}


def test_weights_of_terms_need_no_shuffle(spark):
    texts = spark.createDataFrame([((1, 0), "graph search of graph search"), ((1, 1), "a"), ((2, 0), None), ((3, 0), "Graph ranks")], "id struct<query_id:int,sub:int>, text string")
    weights, vocabulary = V.text_index(texts, ("of",))
    idf = {r.term: r.idf for r in vocabulary.collect()}
    assert idf == {t: math.log(5 / (1 + n)) + 1 for t, n in {"graph": 2, "search": 1, "graph search": 1, "search graph": 1, "ranks": 1, "graph ranks": 1}.items()}
    tf = {"graph": 2, "search": 2, "graph search": 2, "search graph": 1}
    size = math.sqrt(sum((n * idf[t]) ** 2 for t, n in tf.items()))
    got = {(r.id.query_id, r.term): r.w for r in weights.collect()}
    assert {t: w for (q, t), w in got.items() if q == 1} == {t: n * idf[t] / size for t, n in tf.items()} and {q for q, _ in got} == {1, 3}
    rows = V.tfidf(texts, vocabulary, ("of",), drop=0.25)
    assert "Exchange" not in rows._jdf.queryExecution().toString()
    assert {r.term for r in rows.collect() if r.id.query_id == 1} == set(tf) - {"search graph"}


def test_ranks_of_one_query_come_from_ranges(spark):
    rows = spark.range(500).select((F.col("id") % 2).alias("query_id"), (F.col("id") % 13 / 10).alias("score"), F.col("id").alias("seq"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        done = R.numbered(rows, [F.desc("score"), F.col("seq")])
        got = {(r.query_id, r.seq): r["rank"] for r in done.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "seq"))).collect()
    assert got == {(r.query_id, r.seq): r.n for r in want}


def test_tasks_of_collaborations_grow_with_the_pairs(spark, monkeypatch):
    from paperlake.operators import analytics as S

    monkeypatch.setattr(S, "PAIRS", 10, raising=False)
    lists = [[f"a{j}" for j in range(i % 5)] for i in range(40)]
    out = S.collaborations(spark.createDataFrame([(i, names, i) for i, names in enumerate(lists)], "paper_id int, author_names array<string>, citation_count int"))
    want = {}
    for i, names in enumerate(lists):
        for x in range(len(names)):
            for y in names[x + 1 :]:
                want.setdefault((names[x], y), []).append(i)
    got = {(r.author1, r.author2): (r.collaboration_count, r.total_citations) for r in out.collect()}
    assert got == {p: (len(v), sum(v)) for p, v in want.items()}
    assert out.rdd.getNumPartitions() == -(-sum(map(len, want.values())) // 10)
