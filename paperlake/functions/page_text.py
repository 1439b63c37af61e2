"""Text of extracted pages: captions, markdown tables, categories, cache keys and image hashes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How labels of figures and tables look; the caption patterns below are built on them.
FIGURE, TABLE = r"fig(?:ure|\.)?\s*\.?\s*S?\d+[a-z]?", r"tab(?:le|\.)?\s*\.?\s*S?\d+[a-z]?"
MOST = 1000
# Categories by label, and the words that tell the others apart.
CATEGORIES = {
    "fig_result": "figure_result", "fig_chart": "figure_result", "fig_plot": "figure_result", "fig_graph": "figure_result", "fig_diagram": "figure_illustration", "fig_drawing": "figure_illustration", "fig_illustration": "figure_illustration", "fig_schema": "figure_illustration",
    "fig_architecture": "figure_architecture", "fig_flowchart": "figure_architecture", "fig_pipeline": "figure_architecture", "tab_result": "table_result", "tab_comparison": "table_result", "tab_data": "table_result", "tab_parameter": "table_parameter", "tab_config": "table_parameter", "tab_hyperparameter": "table_parameter",
}
RESULT_WORDS = ("result", "performance", "accuracy", "comparison", "evaluations")
ARCHITECTURE_WORDS = ("architecture", "model", "network", "pipeline", "workflow")
PARAMETER_WORDS = ("parameter", "hyperparameter", "config", "setting")
DOMAINS = (
    ("biomedical", ("medical", "clinical", "disease", "drug", "gene", "protein", "cell")),
    ("cs", ("neural", "algorithm", "computing", "data", "machine", "deep learning")),
    ("physics", ("physics", "quantum", "electromagnetic", "particle", "energy")),
)


def trimmed_caption(c: Column) -> Column:
    """At most 1000 characters, cut at the last full stop."""
    short = F.substring(c, 1, MOST)
    return F.when(F.length(c) > MOST, F.concat(F.regexp_replace(short, r"(?s)\.[^.]*$", ""), F.lit("."))).otherwise(c)


def caption(text: Column, prefix: str, bold: str, stop: str = r"\n(?=#{1,3}\s)|\n(?=(?:fig(?:ure|\.)?|tab(?:le|\.)?|\|)\s*\.?\s*\d)") -> Column:
    """The first caption in a text: a line that starts with the prefix, else one whose label is set bold or italic; null without one."""
    plain = F.regexp_extract(text, rf"(?is)({prefix}[.:\-—]?\s*.+?)(?:\n\n|{stop}|$)", 1)
    marked = F.regexp_extract(text, rf"(?is)(\*{{1,2}}(?:{bold})\*{{1,2}}[.:\-—]?\s*.+?)(?:\n\n|\n(?=#{{1,3}}\s)|$)", 1)
    first = F.nullif(F.trim(plain), F.lit(""))
    return trimmed_caption(F.coalesce(first, F.nullif(F.regexp_replace(F.trim(marked), r"^\*+|\*+$", ""), F.lit(""))))


def around(text: Column, at: Column, length: Column, window: int) -> Column:
    """The neighbourhood of a place, counted from 0."""
    start = F.greatest(F.lit(0), at - window)
    return F.substring(text, start + 1, at + length + window - start)


def caption_near_image(text: Column, at: Column) -> Column:
    return caption(around(text, at, F.lit(0), 800), FIGURE, FIGURE)


def caption_near_table(text: Column, block: Column) -> Column:
    at = F.position(block, text) - 1
    return F.when(at >= 0, caption(around(text, at, F.length(block), 600), TABLE, TABLE, r"\n(?=\|)|\n(?=#{1,3}\s)|\n(?=(?:fig(?:ure|\.)?|tab(?:le|\.)?)\.?\s*\d)"))


def table_blocks(text: Column) -> Column:
    """Runs of lines that start and end with a bar, each line trimmed."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    bar = lambda x: x.startswith("|") & x.endswith("|")
    marked = F.array_join(F.transform(lines, lambda x: F.when(bar(x), x).otherwise(F.lit(""))), "\n")
    return F.filter(F.transform(F.split(marked, r"\n{2,}|^\n+|\n+$"), lambda b: F.regexp_replace(b, r"^\n+|\n+$", "")), lambda b: b != "")


def cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|", -1), lambda c: F.trim(c))


def valid_table(block: Column) -> Column:
    """Three lines or more, a rule of two or more cells below the header, mostly as many cells in each row, some text, no essays."""
    lines = F.split(block, "\n")
    rule = cells(F.get(lines, F.lit(1)))
    n = F.size(rule)
    rows = F.transform(F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(1))), cells)
    ragged = F.size(F.filter(rows, lambda r: F.abs(F.size(r) - n) > 1))
    every = F.flatten(rows)
    length = F.aggregate(every, F.lit(0), lambda acc, c: acc + F.length(c))
    bars = F.length(F.get(lines, F.lit(0))) - F.length(F.replace(F.get(lines, F.lit(0)), F.lit("|"), F.lit(""))) - 1
    header = F.when(bars < 1, F.size(cells(F.get(lines, F.lit(0))))).otherwise(bars)
    ok = F.forall(rule, lambda c: c.rlike(r"^:?\s*-{3,}\s*:?$")) & (n >= 2) & (F.abs(header - n) <= 1) & (ragged <= F.size(rows) * 0.5) & F.exists(every, lambda c: c != "") & (length <= F.size(every) * 120)
    return F.coalesce((F.size(lines) >= 3) & ok, F.lit(False))


def parse_table(block: Column) -> Column:
    """struct(headers, rows); null for fewer than three lines; further rules are skipped, no rows are null."""
    lines = F.filter(F.transform(F.split(F.trim(block), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    body = F.filter(F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(1))), lambda x: ~x.rlike(r"^[\s|:-]+$"))
    rows = F.transform(body, cells)
    return F.when(F.size(lines) >= 3, F.struct(cells(F.get(lines, F.lit(0))).alias("headers"), F.when(F.size(rows) > 0, rows).alias("rows")))


def _any(text: Column, words: Sequence[str]) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words])


def category(label: Column, text: Column) -> Column:
    known = F.try_element_at(F.create_map(*[F.lit(x) for p in CATEGORIES.items() for x in p]), label)
    low = F.lower(F.coalesce(text, F.lit("")))
    figure = F.when(_any(low, RESULT_WORDS), "figure_result").when(_any(low, ARCHITECTURE_WORDS), "figure_architecture").otherwise("figure_illustration")
    tab = F.when(_any(low, PARAMETER_WORDS), "table_parameter").otherwise("table_result")
    return F.coalesce(known, F.when(label.startswith("fig"), figure).when(label.startswith("tab"), tab).when(F.contains(label, F.lit("fig")), "figure_result").otherwise("table_result"))


def domain(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*[F.when(_any(low, words), name) for name, words in DOMAINS], F.lit("general"))


def cache_key(query: Column, params: Column) -> Column:
    """md5 of the normalised question and its sorted parameters (a map)."""
    pairs = F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return F.md5(F.concat_ws("|", F.lower(F.trim(query)), F.array_join(pairs, "|")))


def hash_bits(pixels: Column) -> Column:
    """A 32 x 32 grey image as 16 words of 64 bits: 1 where a pixel is brighter than the mean."""

    @F.pandas_udf("array<long>")
    def of(images: pd.Series) -> pd.Series:
        import numpy as np

        out = []
        for raw in images:
            if raw is None or len(raw) != 1024:
                out.append(None)
                continue
            x = np.frombuffer(raw, np.uint8)
            out.append(np.packbits(x > x.mean()).view(">i8").astype(np.int64).tolist())
        return pd.Series(out)

    return of(pixels)


def hash_distance(a: Column, b: Column) -> Column:
    """Differing bits; 999 for hashes of different lengths."""
    bits = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), bits).otherwise(999)


def drop_parts(images: DataFrame, dup: int = 5, part: int = 20, share: float = 0.35) -> DataFrame:
    """images (paper_id, page, image_id, area, hash): of each page, largest first, those that are no copy (distance <= dup) or
    part (distance <= part and under share of the area) of one kept before. A page's images are few, so a page is a group."""

    def keep(page: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        for r in page.sort_values(["area", "image_id"], ascending=[False, True]).itertuples():
            d = lambda k, r=r: sum(((int(x) ^ int(y)) & (1 << 64) - 1).bit_count() for x, y in zip(r.hash, k.hash, strict=True))
            if not any(d(k) <= dup or (d(k) <= part and r.area < share * k.area) for k in kept):
                kept.append(r)
        return page[page["image_id"].isin([k.image_id for k in kept])]

    return images.groupBy("paper_id", "page").applyInPandas(keep, images.schema)


def first_images(images: DataFrame, least_bytes: int = 2048, least_side: int = 100) -> DataFrame:
    """images (paper_id, image_id, data, width, height): large enough, and the first of equal bytes in a paper."""
    fit = images.where((F.length("data") >= least_bytes) & (F.col("width") >= least_side) & (F.col("height") >= least_side)).withColumn("_md5", F.md5("data"))
    w = Window.partitionBy("paper_id", "_md5").orderBy("image_id")
    return fit.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_md5")


def cap_per_paper(items: DataFrame, most: int = 10) -> DataFrame:
    """items (paper_id, id, page, number, area): the largest ones of a paper, numbered anew by page and number."""
    by_area, by_place = Window.partitionBy("paper_id").orderBy(F.desc("area"), "id"), Window.partitionBy("paper_id").orderBy("page", "number", "id")
    kept = items.withColumn("_n", F.row_number().over(by_area)).where(F.col("_n") <= most)
    return kept.withColumn("number", F.row_number().over(by_place)).drop("_n")
