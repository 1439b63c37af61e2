"""Attribution of an answer's text to its sources, claims and their verification against metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.let import let

SPAN = "array<struct<kind:string,text:string,confidence:double,char_start:int,char_end:int>>"
# Words that mark a factual statement, and the label ladder's keywords.
FACT_WORDS = ("author", "wrote", "written by", "published in", "published by", "titled", "entitled", "paper id", "doi", "citation", "journal", "conference", "venue")
LABELS = ("SUPPORTED", "CONTRADICTED", "NO_EVIDENCE")
SUPPORT = ("SUPPORT", "CONFIRM", "VERIFIED", "MATCHES", "CONSISTENT")
CONTRADICT = ("CONTRADICT", "REFUTE", "CONFLICT", "INCORRECT", "WRONG")
NOTHING = ("NOT SUPPORTED", "INSUFFICIENT", "CANNOT VERIFY", "UNRELATED")

empty = lambda c: F.coalesce(c, F.lit(""))
words = lambda t: F.filter(F.split(t, r"\s+"), lambda w: w != "")
any_in = lambda text, keys: reduce(Column.__or__, [F.contains(text, F.lit(k)) for k in keys])


def find(text: Column, piece: Column) -> Column:
    """The first place of piece in text from 0, or -1."""
    return F.position(piece, text) - 1


def _span(kind: str, answer: Column, at: Column, length: Column, confidence: float) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.substring(answer, at + 1, length).alias("text"), F.lit(confidence).alias("confidence"), at.cast("int").alias("char_start"), (at + length).cast("int").alias("char_end"))


def spans(answer: Column, title: Column, authors: Column, abstract: Column, number: Column) -> Column:
    """Where an answer refers to a source: its title or most of it, one author, [n], and one four-word phrase of the abstract.

    Of spans that start at the same place the first stays. Offsets count characters from 0.
    """
    none = F.array().cast(SPAN)
    said = F.struct(answer.alias("text"), F.lower(answer).alias("low"), F.trim(empty(title)).alias("name"), F.trim(empty(abstract)).alias("body"), F.concat(F.lit("["), number.cast("string"), F.lit("]")).alias("mark"))

    def by_title(a: Column) -> Column:
        name = a["name"]

        def partial(heads: Column) -> Column:
            some = lambda found: F.when((F.size(heads) >= 3) & (F.size(found) >= F.size(heads) * 0.6), F.array(F.struct(F.lit("partial").alias("kind"), F.concat(F.lit("Partial title match: "), F.array_join(F.slice(found, 1, 5), ", ")).alias("text"), F.lit(0.6).alias("confidence"), F.lit(0).alias("char_start"), F.lit(0).alias("char_end")))).otherwise(none)
            return let(F.filter(heads, lambda w: F.contains(a["low"], w)), some)

        heads = F.filter(words(F.lower(name)), lambda w: F.length(w) > 3)
        whole = lambda at: F.when(at >= 0, F.array(_span("title", a["text"], at, F.length(name), 0.95))).otherwise(let(heads, partial))
        return F.when(F.length(name) > 10, let(find(a["low"], F.lower(name)), whole)).otherwise(none)

    def by_author(a: Column) -> Column:
        named = F.filter(F.coalesce(authors, F.array().cast("array<string>")), lambda x: (F.length(empty(x)) >= 3) & F.contains(a["low"], F.lower(x)))
        return let(F.try_element_at(named, F.lit(1)), lambda x: F.when(x.isNotNull(), F.array(_span("author", a["text"], find(a["low"], F.lower(x)), F.length(x), 0.85))).otherwise(none))

    def by_mark(a: Column) -> Column:
        size = F.length(a["mark"])
        at = lambda parts, k: F.length(F.array_join(F.slice(parts, F.lit(1), k), "")) + (k - 1) * size
        every = lambda parts: F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: let(at(parts, k), lambda place: _span("citation", a["text"], place, size, 0.9)))
        return let(F.split(a["text"], F.concat(F.lit("\\Q"), a["mark"], F.lit("\\E")), -1), lambda parts: F.when(F.size(parts) > 1, every(parts)).otherwise(none))

    def by_phrase(a: Column) -> Column:
        four = lambda body, i: F.array_join(F.slice(body, i, 4), " ")
        phrases = lambda body: F.when(F.size(body) >= 4, F.transform(F.sequence(F.lit(1), F.greatest(F.size(body) - 3, F.lit(1))), lambda i: four(body, i)))
        fit = F.filter(let(words(F.lower(a["body"])), phrases), lambda p: (F.length(p) > 15) & F.contains(a["low"], p))
        found = lambda p: F.when(p.isNotNull(), F.array(_span("abstract", a["text"], find(a["low"], p), F.length(p), 0.75))).otherwise(none)
        return F.when(F.length(a["body"]) > 50, let(F.try_element_at(fit, F.lit(1)), found)).otherwise(none)

    def first_of_places(every: Column) -> Column:
        return let(F.transform(every, lambda s: s["char_start"]), lambda starts: F.filter(every, lambda s, i: F.array_position(starts, s["char_start"]) == i + 1))

    every = let(said, lambda a: F.concat(by_title(a), by_author(a), by_mark(a), by_phrase(a)))
    return F.when(F.length(empty(answer)) > 0, let(every, first_of_places)).otherwise(none)


def claims(text: Column) -> Column:
    """An answer's lines of more than ten characters, without list marks."""
    lines = F.filter(F.transform(F.split(empty(text), "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 10)
    return F.transform(lines, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^[- ]+", ""), r"^[* ]+", "")))


def claim_matches(claim: Column, evidence: Column) -> Column:
    """How many kinds of metadata of the evidence papers a claim names: id, author, title, venue, DOI, date."""
    low = F.lower(F.trim(claim))
    named = lambda field: F.exists(evidence, lambda p: (F.trim(empty(p[field])) != "") & F.contains(low, F.lower(F.trim(p[field]))))
    surname = lambda a: F.try_element_at(words(F.lower(a)), F.lit(-1))

    def by(p: Column) -> Column:
        who = F.filter(F.coalesce(p["authors"], F.array().cast("array<string>")), lambda a: F.trim(empty(a)) != "")
        whole = lambda a: (F.length(F.trim(a)) > 2) & F.contains(low, F.lower(F.trim(a)))
        last = lambda a: (F.size(words(a)) > 1) & (F.length(surname(a)) > 2) & F.contains(low, surname(a))
        return F.exists(who, lambda a: whole(a) | last(a))

    def titled(p: Column) -> Column:
        heads = F.filter(words(F.lower(F.trim(empty(p["title"])))), lambda w: F.length(w) > 3)
        n = F.size(F.filter(heads, lambda w: F.contains(low, w)))
        return (F.size(heads) > 0) & ((n >= F.size(heads) * 0.5) | (n >= 3))

    def dated(p: Column) -> Column:
        d = F.lower(F.trim(empty(p["publication_date"])))
        return (d != "") & (F.contains(low, d) | ((F.length(d) >= 4) & F.contains(low, F.substring(d, 1, 4))))

    kinds = [named("paper_id"), F.exists(evidence, by), F.exists(evidence, titled), named("venue"), named("doi"), F.exists(evidence, dated)]
    return reduce(Column.__add__, [F.coalesce(k, F.lit(False)).cast("int") for k in kinds])


def claim_label(claim: Column, evidence: Column) -> Column:
    """SUPPORTED if two kinds match, or one and the claim states such a fact; else null, for a model to judge."""
    n = claim_matches(claim, evidence)
    return F.when((n >= 2) | ((n >= 1) & any_in(F.lower(claim), FACT_WORDS)), "SUPPORTED")


def parse_label(raw: Column, strict_negation: bool = True) -> Column:
    """A model's answer as a label: exact, first line, first word, anywhere, then by keyword.

    strict_negation reads "not supported" and "unsupported" as NO_EVIDENCE; without it the keyword SUPPORT wins.
    """
    text = F.upper(F.regexp_replace(empty(raw), r"^\s+|\s+$", ""))
    bare = lambda t, marks: F.regexp_replace(t, rf"^[{marks}]+|[{marks}]+$", "")
    line = bare(F.trim(F.try_element_at(F.split(text, "\n"), F.lit(1))), r".*\- ")
    word = bare(F.coalesce(F.try_element_at(words(text), F.lit(1)), F.lit("")), r".:,*\- ")
    has = lambda k: F.contains(text, F.lit(k))
    out = F.when(text == "", "NO_EVIDENCE").when(text.isin(*LABELS), text)
    for label in LABELS:
        out = out.when(F.startswith(line, F.lit(label)), label)
    for label in LABELS:
        out = out.when(word == label, label)
    if strict_negation:
        out = out.when(text.rlike(r"NOT SUPPORT|UNSUPPORT"), F.when(has("CONTRADICTED"), "CONTRADICTED").otherwise("NO_EVIDENCE"))
    out = out.when(has("SUPPORTED") & ~has("NO_EVIDENCE") & ~has("NOT SUPPORTED"), "SUPPORTED").when(has("CONTRADICTED"), "CONTRADICTED").when(has("NO_EVIDENCE") | has("NO EVIDENCE"), "NO_EVIDENCE")
    return out.when(any_in(text, SUPPORT), "SUPPORTED").when(any_in(text, CONTRADICT), "CONTRADICTED").otherwise("NO_EVIDENCE")


def verdicts(labelled: DataFrame, by: str = "answer_id") -> DataFrame:
    """Counts of labels and the verdict of each answer; answers without a claim come with a null label."""
    n = lambda label: F.count_if(F.coalesce(F.col("label"), F.lit("")) == label)
    t = labelled.groupBy(by).agg(F.count("label").alias("total"), n("SUPPORTED").alias("supported"), n("CONTRADICTED").alias("contradicted"), n("NO_EVIDENCE").alias("no_evidence"))
    verdict = F.when(F.col("total") == 0, "NO_CLAIMS").when(F.col("contradicted") > 0, "CONTRADICTED").when(F.col("supported") == F.col("total"), "FULLY_SUPPORTED").when(F.col("supported") > 0, "PARTIALLY_SUPPORTED").otherwise("NO_EVIDENCE")
    return t.withColumn("verdict", verdict)


def named_papers(answers: DataFrame, papers: DataFrame) -> DataFrame:
    """(answer_id, id) of the papers (id, doi) whose id or DOI a claim of the answer names, ignoring case."""
    said = answers.select("answer_id", F.explode(claims(F.col("answer"))).alias("claim")).select("answer_id", F.lower("claim").alias("claim"))
    ids = F.regexp_extract_all("claim", F.lit(r"\bw\d+\b"), F.lit(0))
    dois = F.regexp_extract_all("claim", F.lit(r"\b10\.[\d.]+/[^\s\"<>]+"), F.lit(0))
    # Any of the marks that end a DOI may be the sentence's.
    bare = lambda d: F.length(F.regexp_replace(d, r"[^\p{L}\p{N}]+$", ""))
    cuts = F.flatten(F.transform(dois, lambda d: F.transform(F.sequence(bare(d), F.length(d)), lambda n: F.substring(d, F.lit(1), n))))
    names = said.select("answer_id", F.explode(F.array_distinct(F.concat(ids, cuts))).alias("name")).distinct()
    by = lambda field: names.join(papers.select("id", F.lower(field).alias("name")), "name").select("answer_id", "id")
    return by("id").unionByName(by("doi")).distinct()


def verify(answers: DataFrame, evidence: DataFrame, judge=None) -> DataFrame:
    """(answer_id, claim, label, raw_label) of every claim; judge(claim column) gives a model's raw answer, else NO_EVIDENCE.

    answers (answer_id, answer), evidence (answer_id, papers: array of struct).
    """
    rows = answers.join(evidence, "answer_id", "left").select("answer_id", F.posexplode(claims(F.col("answer"))).alias("n", "claim"), F.coalesce("papers", F.lit(None)).alias("papers"))
    own = claim_label(F.col("claim"), F.col("papers"))
    raw = judge(F.col("claim")) if judge else F.lit("NO_EVIDENCE")
    return rows.select("answer_id", "n", "claim", F.coalesce(own, parse_label(raw)).alias("label"), F.when(own.isNotNull(), own).otherwise(F.substring(raw, 1, 100)).alias("raw_label"))
