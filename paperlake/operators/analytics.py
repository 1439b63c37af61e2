"""Bibliometric features, trends, label statistics, significance tests, evaluation summaries and data profiles."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept

FIRST_YEAR, CURRENT_YEAR = 1950, 2024
# Words that carry no topic in abstracts.
ABSTRACT_STOP_WORDS = (
    "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "this", "that", "these", "those", "we", "our", "they",
    "paper", "study", "research", "method", "approach", "results", "conclusion", "analysis", "data", "using", "based", "show", "shows", "present",
    "propose",
)


def paper_features(papers: DataFrame) -> DataFrame:
    """papers (paper_id, title, abstract, year, citation_count, influential_citation_count, author_count, fields_of_study, venue) with derived features."""
    cited, key = F.coalesce("citation_count", F.lit(0)), F.coalesce("influential_citation_count", F.lit(0))
    valid = F.coalesce((F.col("year") >= FIRST_YEAR) & (F.col("year") <= CURRENT_YEAR), F.lit(False))
    most = papers.agg(F.max(F.coalesce("citation_count", F.lit(0))).alias("_most"))
    p = papers.crossJoin(F.broadcast(most))
    scaled, recent = F.when(F.col("_most") > 0, cited / F.col("_most")).otherwise(0.0), F.when(valid, (F.col("year") - FIRST_YEAR) / (CURRENT_YEAR - FIRST_YEAR)).otherwise(0.0)
    title, abstract = F.trim(F.coalesce("title", F.lit(""))), F.coalesce("abstract", F.lit(""))
    n, fields = F.coalesce("author_count", F.lit(0)), F.greatest(F.coalesce(F.size("fields_of_study"), F.lit(0)), F.lit(0))
    return p.withColumns({
        "influence_ratio": F.when(cited > 0, key / cited).otherwise(0.0), "year_valid": valid, "recency_score": recent, "normalized_citations": scaled, "impact_score": 0.7 * scaled + 0.3 * recent,
        "title_length": F.length(title), "has_abstract": F.length(abstract) > 50, "abstract_length": F.length(abstract), "is_single_author": n == 1, "is_collaboration": n > 3,
        "field_count": fields, "is_interdisciplinary": fields > 2, "has_venue": F.coalesce(F.col("venue") != "", F.lit(False)),
    }).drop("_most")


def trends(papers: DataFrame, window: int = 5, now: int = CURRENT_YEAR) -> DataFrame:
    """One row: papers after 1950, recent ones, and their mean citations."""
    recent = F.col("year") >= now - window
    return papers.where(f"year > {FIRST_YEAR}").agg(F.count("*").alias("total_papers"), F.count_if(recent).alias("recent_papers"), F.avg("citation_count").alias("avg_citations_all"), F.coalesce(F.avg(F.when(recent, F.col("citation_count"))), F.lit(0.0)).alias("avg_citations_recent"))


def counts(df: DataFrame, key: str, k: int | None = None) -> DataFrame:
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key)
    return out if k is None else out.limit(k)


def summary(papers: DataFrame) -> DataFrame:
    """One row of a field's overview; the peak year is the most frequent one, the earliest of ties."""
    n = F.count("*")
    peak = papers.where("year is not null").groupBy("year").count().agg(F.min_by("year", F.struct(-F.col("count"), "year")).alias("peak_year"))
    c, a = F.col("citation_count"), F.col("author_count")
    rows = papers.agg(
        n.alias("total_papers"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.sum(c).alias("total_citations"), F.avg(c).alias("avg_citations"), F.max(c).alias("max_citations"),
        F.count_if(c > 0).alias("papers_with_citations"), F.count_if(F.col("influential_citation_count") >= 10).alias("highly_influential_papers"), F.count_if(F.col("year") >= 2020).alias("recent_papers_count"),
        F.avg(a).alias("avg_authors_per_paper"), F.count_if(a == 1).alias("single_author_papers"), F.count_if(a >= 5).alias("large_collaborations"), F.coalesce(F.try_divide(F.count_if(a > 1), n), F.lit(0.0)).alias("collaboration_rate"),
    )
    middle = quantiles(papers, "citation_count", [0.5]).select(F.get("q", F.lit(0)).alias("median_citations"))
    return rows.crossJoin(F.broadcast(peak)).crossJoin(F.broadcast(middle))


#: Pairs that one task of ``collaborations`` gathers on average.
PAIRS = 200_000


def collaborations(papers: DataFrame) -> DataFrame:
    """papers (paper_id, author_names, citation_count): statistics of each pair in the order of the author list.

    The lists are written and their pairs counted first, so that the number of tasks, not the size of one, grows with the pairs.
    """
    papers = kept(papers.where("size(author_names) > 1").select("author_names", "citation_count"))
    n = F.size("author_names").cast("long")
    pairs = papers.agg(F.sum(F.floor(n * (n - 1) / 2))).first()[0] or 0
    # Pairs are made inside a row, from its own list, in tasks of bounded size too: a shuffle's writer buffers what its task sends.
    papers = papers.repartition(max(1, -(-pairs // (4 * PAIRS))))
    pair = lambda a, i: F.transform(F.slice(F.col("author_names"), i + 2, F.greatest(F.size("author_names") - i - 1, F.lit(0))), lambda b: F.struct(a.alias("author1"), b.alias("author2")))
    rows = papers.select("citation_count", F.explode(F.flatten(F.transform("author_names", pair))).alias("p")).select("p.*", "citation_count")
    rows = rows.repartition(max(1, -(-pairs // PAIRS)), "author1", "author2")
    c = F.coalesce("citation_count", F.lit(0))
    return rows.groupBy("author1", "author2").agg(F.count("*").alias("collaboration_count"), F.sum(c).alias("total_citations"), F.round(F.avg(c), 2).alias("avg_citations"))


def word_counts(texts: DataFrame, column: str, longer_than: int = 50, stop: Sequence[str] = ABSTRACT_STOP_WORDS, least: int = 4, k: int | None = 50) -> DataFrame:
    words = F.regexp_extract_all(F.lower(column), F.lit(rf"(?<![\p{{L}}\p{{N}}_])[a-z]{{{least},}}(?![\p{{L}}\p{{N}}_])"), F.lit(0))
    rows = texts.where(F.length(column) > longer_than).select(F.explode(words).alias("word"))
    out = rows.where(~F.col("word").isin(list(stop))).groupBy("word").agg(F.count("*").alias("n"))
    return out if k is None else out.orderBy(F.desc("n"), "word").limit(k)


LABELS = ("SUPPORTED", "CONTRADICTED", "NO_EVIDENCE")


def label_counts(text: Column) -> Column:
    """'SUPPORTED:3, NO_EVIDENCE:1' as counts, total, percentages, the dominant label (the first of ties) and the entropy."""
    got = {x: F.coalesce(F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), rf"{x}:(\d+)", 1), F.lit("")).cast("int"), F.lit(0)) for x in LABELS}
    s, c, n = (got[x] for x in LABELS)
    total = s + c + n
    part = lambda x: F.coalesce(F.try_divide(x * F.lit(100.0), total), F.lit(0.0))
    shares = F.filter(F.array(*[F.try_divide(x.cast("double"), total) for x in (s, c, n)]), lambda p: p > 0)
    entropy = F.when(F.size(shares) > 1, -F.aggregate(shares, F.lit(0.0), lambda acc, p: acc + p * F.log2(p))).otherwise(0.0)
    top = F.when((s >= c) & (s >= n), LABELS[0]).when(c >= n, LABELS[1]).otherwise(LABELS[2])
    return F.struct(s.alias("supported"), c.alias("contradicted"), n.alias("no_evidence"), total.alias("total_claims"), part(s).alias("supported_pct"), part(c).alias("contradicted_pct"), part(n).alias("no_evidence_pct"), top.alias("dominant_label"), entropy.alias("label_diversity"))


def format_labels(labels: Column) -> Column:
    """Labels of a response counted as 'SUPPORTED:n, CONTRADICTED:n, NO_EVIDENCE:n', by substring, only those that occur."""
    up = F.transform(labels, lambda x: F.upper(x))
    kind = F.transform(up, lambda x: reduce(lambda acc, k: acc.when(F.contains(x, F.lit(k)), k), LABELS[1:], F.when(F.contains(x, F.lit(LABELS[0])), LABELS[0])))

    def part(k: str) -> Column:
        n = F.size(F.filter(kind, lambda x: x == k))
        return F.when(n > 0, F.concat(F.lit(f"{k}:"), n.cast("string")))

    parts = [part(k) for k in LABELS]
    return F.coalesce(F.nullif(F.array_join(F.array_compact(F.array(*parts)), ", "), F.lit("")), F.lit("No verification"))


def crosstab(df: DataFrame, row: str, col: str, values: Sequence) -> DataFrame:
    return df.groupBy(row).pivot(col, list(values)).agg(F.count(F.lit(1))).fillna(0)


def equal_bins(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """bin from 0: n right-closed intervals of equal width over the column's range."""
    edges = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / n
    at = F.when(F.col("_hi") > F.col("_lo"), F.ceil((F.col(column) - F.col("_lo")) / width) - 1).otherwise(0)
    return df.crossJoin(F.broadcast(edges)).withColumn("bin", F.least(F.greatest(at, F.lit(0)), F.lit(n - 1)).cast("int")).drop("_lo", "_hi")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r): Pearson's r of every pair of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs]).alias("x"))
    return row.select(F.explode("x").alias("x")).select("x.*")


def average_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """Ranks with ties at their mean, from counts of distinct values, so that rows are never gathered in one task.

    The running total over distinct values has two steps: within ranges of values, and over the ranges' totals.
    """
    values = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    ranged = values.repartitionByRange(column).withColumn("_part", F.spark_partition_id())
    w = Window.partitionBy("_part").orderBy(column)
    inside = ranged.withColumn("_upto", F.sum("_n").over(w))
    # One row for each range; ranges are as many as there are shuffle partitions.
    starts = inside.groupBy("_part").agg(F.max("_upto").alias("_all")).withColumn("_start", F.coalesce(F.sum("_all").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranks = inside.join(F.broadcast(starts.select("_part", "_start")), "_part").select(column, (F.col("_start") + F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2).alias(out))
    return df.join(ranks, column, "left")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    both = average_ranks(average_ranks(df.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, "_ra"), b, "_rb")
    return both.agg(F.corr("_ra", "_rb").alias("rho"))


def gammainc_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def _tail(f, *columns: Column) -> Column:
    """A p-value of one-row frames; null where an argument is missing."""
    return F.udf(lambda *x: None if None in x or not all(x[1:]) else float(f(*x)), "double")(*columns)


def chi2_tail(statistic: Column, dof: Column) -> Column:
    return _tail(lambda x, k: gammainc_upper(k / 2, x / 2), statistic, dof)


def normal_tails(z: Column) -> Column:
    return _tail(lambda x: math.erfc(abs(x) / math.sqrt(2)), z)


def f_tail(f: Column, d1: Column, d2: Column) -> Column:
    return _tail(lambda x, a, b: betainc(b / 2, a / 2, b / (b + a * x)), f, d1, d2)


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Independence of two columns: statistic (with Yates' correction at one degree of freedom), dof and p; one row."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    rows, cols, total = cells.groupBy(a).agg(F.sum("n").alias("nr")), cells.groupBy(b).agg(F.sum("n").alias("nc")), cells.agg(F.sum("n").alias("t"))
    # The table of expected counts has one row for each pair of categories.
    grid = rows.crossJoin(cols).join(cells, [a, b], "left").crossJoin(F.broadcast(total)).withColumn("e", F.col("nr") * F.col("nc") / F.col("t"))
    dof = (F.count_distinct(a) - 1) * (F.count_distinct(b) - 1)
    gap = F.abs(F.coalesce("n", F.lit(0)) - F.col("e"))
    sums = grid.agg(dof.alias("dof"), F.sum(gap * gap / F.col("e")).alias("plain"), F.sum(F.pow(gap - F.least(F.lit(0.5), gap), F.lit(2)) / F.col("e")).alias("yates"))
    stat = F.when(F.col("dof") == 1, F.col("yates")).otherwise(F.col("plain"))
    return sums.select(stat.alias("chi2"), "dof", chi2_tail(stat, F.col("dof")).alias("p"))


def mann_whitney(df: DataFrame, value: str, group: Column) -> DataFrame:
    """U of the rows where group is true, and the two-sided p by the normal approximation with ties and continuity."""
    rows = average_ranks(df.select(value, group.alias("_g")).where(F.col(value).isNotNull() & F.col("_g").isNotNull()), value, "_r")
    ties = rows.groupBy(value).agg(F.count("*").alias("t")).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    s = rows.agg(F.count_if("_g").alias("n1"), F.count_if(~F.col("_g")).alias("n2"), F.sum(F.when(F.col("_g"), F.col("_r"))).alias("r1")).crossJoin(F.broadcast(ties))
    n, u = F.col("n1") + F.col("n2"), F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    mean = F.col("n1") * F.col("n2") / 2
    sd = F.sqrt(F.col("n1") * F.col("n2") / F.lit(12.0) * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = F.try_divide(F.greatest(F.abs(u - mean) - 0.5, F.lit(0.0)), sd)
    return s.select(u.alias("u"), z.alias("z"), normal_tails(z).alias("p"))


def anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """One-way F statistic and p."""
    g = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"))
    t = g.agg(F.count("*").alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("sq"), F.sum((F.col("n") - 1) * F.col("v")).alias("within"))
    between = F.col("sq") - F.col("n") * F.col("mean") * F.col("mean")
    f = (between / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))
    return t.select(f.alias("f"), (F.col("k") - 1).alias("df1"), (F.col("n") - F.col("k")).alias("df2"), f_tail(f, F.col("k") - 1, F.col("n") - F.col("k")).alias("p"))


def cohens_d(df: DataFrame, value: str, group: Column) -> DataFrame:
    a, b = (F.when(group, F.col(value)), F.when(~group, F.col(value)))
    t = df.agg(*[f(x).alias(f"{n}{k}") for k, x in ((1, a), (2, b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2))
    return t.select(((F.col("m1") - F.col("m2")) / pooled).alias("d"))


METRICS = ("precision", "recall", "f1_score", "dcg_at_5", "dcg_at_10", "ndcg_at_5", "ndcg_at_10")


def evaluation_summary(results: DataFrame) -> DataFrame:
    """Overall, by question type and by category: means over successful rows, success rates and times over all."""
    ok = F.col("success")
    means = [F.coalesce(F.avg(F.when(ok, F.col(c))), F.lit(0.0)).alias(c) for c in METRICS]
    grouped = results.groupingSets([[], [F.col("question_type")], [F.col("category")]], F.col("question_type"), F.col("category"))
    level = F.when(F.grouping("question_type") == 0, "type").when(F.grouping("category") == 0, "category").otherwise("overall")
    out = grouped.agg(level.alias("level"), F.count("*").alias("total"), F.count_if(ok).alias("successful"), (F.count_if(ok) / F.count("*")).alias("success_rate"), F.avg("response_time").alias("avg_response_time"), *means)
    # Only the two known kinds of question have a section of their own, and only where one was answered.
    out = out.where((F.col("level") == "overall") | (F.col("successful") > 0)).where((F.col("level") != "type") | F.col("question_type").isin("neo4j", "semantic"))
    return out.withColumn("name", F.coalesce("question_type", "category", F.lit("all"))).drop("question_type", "category")


def profile(df: DataFrame) -> DataFrame:
    """(column, type, nulls, pct): completeness of each column, in one pass."""
    cols = [(f.name, f.dataType.simpleString()) for f in df.schema]
    one = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c, _ in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(c).alias("nulls"), F.coalesce(F.try_divide(F.col(c) * F.lit(100.0), F.col("_n")), F.lit(0.0)).alias("pct")) for c, t in cols])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def duplicates(df: DataFrame) -> DataFrame:
    """How many rows repeat an earlier one."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


#: Accuracy of the sketch that brackets a wanted rank, and the bracket's half width in parts of it.
ACCURACY, BRACKET = 10_000, 5


def quantiles(df: DataFrame, column: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by and q, the exact quantiles of the column's values, interpolated between neighbours; null without values.

    Selection in two passes: a sketch of bounded size gives each wanted rank a bracket of values, a thousandth of the rows
    wide; then rows below a bracket are counted, and only the distinct values inside it, with their counts, are sorted. No
    buffer holds the values of a group. Groups of few rows (8,000), where neighbouring ranks lie farther apart than that, are
    a bracket as a whole. A bracket that should miss its rank is an error, never a wrong result.
    """
    few = 4 * ACCURACY // abs(BRACKET)
    keys, m, eps = list(by), len(probs), BRACKET / ACCURACY
    x = df.select(*keys, F.col(column).cast("double").alias("_v")).where("_v is not null")
    edges = [max(0.0, p - eps) for p in probs] + [min(1.0, p + eps) for p in probs]
    stats = kept(x.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_v", edges, ACCURACY).alias("_e")))
    named = stats.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_n", "_e")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.lit(True))
    both = x.join(named, same) if keys else x.crossJoin(F.broadcast(named))
    edge = lambda i, end: F.when(F.col("_n") < few, F.lit(end)).otherwise(F.get("_e", F.lit(i)))
    lo, hi = (lambda i: edge(i, float("-inf"))), (lambda i: edge(m + i, float("inf")))
    held = F.array_compact(F.array(*[F.when((F.col("_v") >= lo(i)) & (F.col("_v") <= hi(i)), F.lit(i)) for i in range(m)]))
    inside = both.select(*keys, "_v", F.explode(held).alias("_i")).groupBy(*keys, "_i", "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_i").orderBy("_v"))
    wanted = F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(float(p)).alias("_p"), F.count_if(F.col("_v") < lo(i)).alias("_below"), F.max("_n").alias("_n")) for i, p in enumerate(probs)])
    below = both.groupBy(*keys).agg(wanted.alias("w")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.inline("w")).withColumnRenamed("_i", "_j")
    at = (F.col("_n") - 1) * F.col("_p")
    reached = below.join(inside.withColumn("_upto", upto), same & (F.col("_i") == F.col("_j")), "left").withColumn("_upto", F.col("_upto") + F.col("_below"))
    first = lambda r: F.min(F.when((F.col("_upto") > r) & (F.col("_below") <= r), F.col("_v")))
    lower, groups = F.floor(at), [f"_k{i}" for i in range(len(keys))]
    found = reached.groupBy(*groups, "_j").agg(first(lower).alias("a"), first(F.least(lower + 1, F.col("_n") - 1)).alias("b"), F.max(at - lower).alias("part"))
    missed = F.raise_error(F.lit("the sketch's bracket misses the rank"))
    # Without any values there is no rank to find.
    value = F.when(F.col("part").isNull(), F.lit(None)).when(F.col("a").isNull() | F.col("b").isNull(), missed).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("part"))
    q = found.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("_j", value.alias("v")))).alias("q"))
    return q.select(*[F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)], F.when(F.exists("q", lambda s: s["v"].isNotNull()), F.transform("q", lambda s: s["v"])).alias("q"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, count, mean, std, min, q25, median, q75, max) of numeric columns; quartiles interpolate and are exact."""
    stats = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    one = df.agg(*[F.struct(F.lit(c).alias("column"), *[f(F.col(c)).cast("bigint" if n == "count" else "double").alias(n) for n, f in stats.items()]).alias(c) for c in columns])
    rows = one.select(F.explode(F.array(*columns)).alias("x")).select("x.*")
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])))
    quarters = quantiles(long, "value", [0.25, 0.5, 0.75], ["column"]).select("column", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q25", "median", "q75"))])
    return rows.join(quarters, "column", "left").select("column", "count", "mean", "std", "min", "q25", "median", "q75", "max")


def top_of_lists(papers: DataFrame, column: str, k: int) -> DataFrame:
    """(name, papers, citations): the names in a list column, such as concepts or authors, with most papers, ties by name; a paper counts once a name."""
    rows = papers.select(F.coalesce("citation_count", F.lit(0)).alias("c"), F.explode(F.array_distinct(column)).alias("name")).where("name is not null")
    return rows.groupBy("name").agg(F.count("*").alias("papers"), F.sum("c").alias("citations")).orderBy(F.desc("papers"), "name").limit(k)


def mean_by_flag(papers: DataFrame, flag: Column) -> DataFrame:
    """(flag, papers, avg_citations): such as papers with and without open access; unknown counts as false."""
    return papers.groupBy(F.coalesce(flag, F.lit(False)).alias("flag")).agg(F.count("*").alias("papers"), F.avg(F.coalesce("citation_count", F.lit(0))).alias("avg_citations"))


def topic_top(papers: DataFrame, words: str, since: int, k: int = 5) -> DataFrame:
    """The most cited papers since a year that hold the words in title or abstract, ties by id."""
    text = F.lower(F.concat_ws("\n", "title", "abstract"))
    return papers.where((F.col("year") >= since) & F.contains(text, F.lit(words.lower()))).orderBy(F.desc_nulls_last("citation_count"), "paper_id").limit(k)


def usage(calls: DataFrame, last: int = 1000) -> DataFrame:
    """calls (ts, call_id, purpose, seconds, tokens, ok): the latest ones by purpose."""
    recent = calls.orderBy(F.desc("ts"), F.desc("call_id")).limit(last)
    return recent.groupBy("purpose").agg(F.count("*").alias("calls"), F.sum("seconds").alias("total_seconds"), F.count_if(~F.col("ok")).alias("errors"), F.avg("seconds").alias("avg_seconds"))


def rank_among(own: float, baselines: DataFrame, name: str = "model", score: str = "score") -> DataFrame:
    """The place of an own score among baselines, ties in its favour, and its percentile (n - rank + 1) / n * 100."""
    t = baselines.agg((1 + F.count_if(F.col(score) > own)).alias("rank"), (F.count("*") + 1).alias("of"))
    return t.select("rank", "of", ((F.col("of") - F.col("rank") + 1) / F.col("of") * 100).alias("percentile"))
