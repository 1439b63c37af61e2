"""Hybrid search for a batch of questions as one lazy plan: graph conditions, sparse vectors, relevance, fallback, boost."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import query_text as Q
from ..operators import graph as G
from ..operators import phrases as P
from ..operators import ranking as R
from ..operators import vector as V
from ..sources.graph import Graph
from ..sources.scratch import kept, shuffled

TEMPLATES = ("search_papers", "search_citations", "top_cited_papers", "coauthor_network", "author_venue_stats")
STOP = ("the", "and", "of", "to", "in", "is", "it", "for", "on", "by", "about")


def has_specific(e: Column) -> Column:
    return (F.size(e["paper_ids"]) > 0) | (F.size(e["author_names"]) > 0) | e["venue"].isNotNull() | e["institution"].isNotNull() | e["year"].isNotNull() | e["year_from"].isNotNull()


def most_cited(rows: DataFrame, by: str, k: int | None) -> DataFrame:
    """The k most cited papers of each value of ``by``, in the templates' order; rows have id and cited. k = None keeps all."""
    return P.first_rows(rows, by, [F.desc_nulls_first("cited"), F.col("id")], k)


@dataclass
class GraphIndex:
    """Phrase indexes of the papers' titles and abstracts and of the nodes' names; build them once for many batches of questions."""

    papers: P.PhraseIndex
    authors: P.PhraseIndex
    venues: P.PhraseIndex
    institutions: P.PhraseIndex


def graph_index(g: Graph) -> GraphIndex:
    text = F.lower(F.concat_ws("\n", "title", "abstract"))
    papers = P.phrase_index(g.papers.select("id", text.alias("t"), F.col("cited_by_count").alias("cited")))
    return GraphIndex(papers, *[P.phrase_index(nodes.select("id", F.lower("name").alias("t"))) for nodes in (g.authors, g.venues, g.institutions)])


def named_nodes(index: P.PhraseIndex, names: DataFrame) -> DataFrame:
    """(wanted, id): the nodes whose names hold each of the names (wanted), ignoring case."""
    return P.holding(index, names.select(F.col("wanted").alias("w"))).withColumnRenamed("w", "wanted")


def in_years(g: Graph, spans: DataFrame, k: int | None) -> DataFrame:
    """(years, id, cited): the papers of each span, a struct (y, lo, hi); with k, its most cited ones.

    The years of the dates, 10,000 at most, meet the spans; papers are found by their year. Where a span's ends are years, the
    most cited papers of each of its years hold its own. A date that does not start with four digits is in no span.
    """
    dated = g.papers.select("id", "publication_date", F.col("cited_by_count").alias("cited"), F.substring("publication_date", 1, 4).alias("yr"))
    y, lo, hi = (F.col(f"years.{c}") for c in ("y", "lo", "hi"))
    first = lambda c: F.substring(c, 1, 4)
    may = F.startswith("yr", first(y)) | ((F.col("yr") >= first(lo)) & (F.col("yr") <= hi))
    whole = F.coalesce(F.length(y) == 4, F.lit(True)) & F.coalesce((F.length(lo) == 4) & (F.length(hi) == 4), F.lit(True))
    date = F.col("publication_date")
    fit = F.startswith(date, y) | ((date >= lo) & (date < hi))
    known = kept(dated.select("yr").distinct().where(r"yr rlike '^[0-9]{4}$'"))
    near = spans.distinct().withColumn("whole", whole)
    out = None
    for papers, part in ((most_cited(dated, "yr", k), near.where("whole")), (dated, near.where("not whole"))):
        found = papers.join(shuffled(F.broadcast(known).join(part, may).select("yr", "years")), "yr").where(fit).select("years", "id", "cited")
        out = found if out is None else out.unionByName(found)
    return most_cited(out, "years", k)


def graph_candidates(g: Graph, asked: DataFrame, k: int | None = None, index: GraphIndex | None = None) -> DataFrame:
    """(query_id, id): papers that fit any entity of each question (query_id, entities); with k, its k most cited ones.

    Names and keywords meet the nodes and the papers through phrase indexes, years through the years of the dates.
    A paper among the k most cited of a question is so among those of the entity, node and token that it was found by. Each
    is therefore cut to k first, and the pairs grow with the distinct entities, not with questions times papers.
    """
    e, index = F.col("entities"), index or graph_index(g)
    part = lambda field, name: asked.select("query_id", F.explode(e[field]).alias(name)).distinct()
    one = lambda field, name: asked.where(e[field].isNotNull()).select("query_id", e[field].alias(name))
    papers = g.papers.select("id", F.col("cited_by_count").alias("cited"))
    by = [part("paper_ids", "id").join(shuffled(papers), "id").select("query_id", "id", "cited")]
    for names, node, edge, key in ((part("author_names", "wanted"), index.authors, g.authored, "author_id"), (one("venue", "wanted"), index.venues, g.published_in, "venue_id"), (one("institution", "wanted"), index.institutions, g.associated_with, "inst_id")):
        nodes = kept(named_nodes(node, names).withColumnRenamed("id", key))
        of_node = edge.join(shuffled(nodes.select(key).distinct()), key, "left_semi").select(key, F.col("paper_id").alias("id")).join(shuffled(papers), "id")
        hits = nodes.join(shuffled(most_cited(of_node, key, k)), key).select("wanted", "id", "cited").distinct()
        by.append(names.join(shuffled(most_cited(hits, "wanted", k)), "wanted").select("query_id", "id", "cited"))
    words = part("keywords", "w")
    held = kept(P.holding(index.papers, words.select("w"), [F.desc_nulls_first("cited"), F.col("id")], k))
    by.append(held.join(shuffled(words), "w").select("query_id", "id", "cited"))
    years = asked.where(e["year"].isNotNull() | e["year_from"].isNotNull()).select("query_id", F.struct(e["year"].alias("y"), e["year_from"].alias("lo"), e["year_to"].alias("hi")).alias("years"))
    of_span = kept(in_years(g, years.select("years"), k))
    # Compared as text, since the parts may be null and nulls are not equal.
    by.append(years.withColumn("key", F.to_json("years")).join(shuffled(of_span.withColumn("key", F.to_json("years")).drop("years")), "key").select("query_id", "id", "cited"))
    # Each way of its own is written, so that the driver plans one at a time.
    by = [kept(d) for d in by]
    out = by[0]
    for d in by[1:]:
        out = out.unionByName(d)
    return most_cited(out.distinct(), "query_id", k).select("query_id", "id")


def citation_ends(g: Graph, asked: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, id): the papers at both ends of every citation that touches an id of each question (query_id, entities); with k, its most cited."""
    wanted = asked.select("query_id", F.explode("entities.paper_ids").alias("wanted")).distinct()
    hits = [g.cites.join(shuffled(wanted), F.col(end) == F.col("wanted")).select("query_id", F.explode(F.array("src_id", "dst_id")).alias("id")) for end in ("src_id", "dst_id")]
    ends = hits[0].unionByName(hits[1]).distinct().join(shuffled(g.papers.select("id", F.col("cited_by_count").alias("cited"))), "id")
    return most_cited(ends, "query_id", k).select("query_id", "id")


def named_authors(g: Graph, asked: DataFrame, index: P.PhraseIndex) -> DataFrame:
    """(query_id, paper_id, author_id, author): the papers of the authors whose names hold a name of each question."""
    names = asked.select("query_id", F.explode("entities.author_names").alias("wanted"))
    who = names.join(shuffled(named_nodes(index, names)), "wanted").join(shuffled(g.authors), "id").select("query_id", F.col("id").alias("author_id"), F.col("name").alias("author")).distinct()
    return who.join(shuffled(g.authored), "author_id").select("query_id", "paper_id", "author_id", "author")


def counted(rows: DataFrame, other: str, count: str, titles: int, k: int) -> DataFrame:
    """(query_id, rank, author, other, count, sample_titles): the k pairs of each question with most papers, ties by name."""
    out = rows.groupBy("query_id", "author", other).agg(F.count("*").alias(count), F.slice(F.array_sort(F.collect_set("title")), 1, titles).alias("sample_titles"))
    w = Window.partitionBy("query_id").orderBy(F.desc(count), "author", other)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def coauthors(g: Graph, named: DataFrame, k: int, titles: int = 5) -> DataFrame:
    """``graph.coauthor_network`` for the named authors of each question."""
    others = g.authored.join(shuffled(g.authors), g.authored.author_id == g.authors.id).select("paper_id", F.col("author_id").alias("other_id"), F.col("name").alias("coauthor"))
    pairs = named.join(shuffled(others), "paper_id").where("author_id <> other_id").join(shuffled(g.papers.select(F.col("id").alias("paper_id"), "title")), "paper_id")
    return counted(pairs, "coauthor", "shared_papers", titles, k)


def author_venues(g: Graph, named: DataFrame, k: int, titles: int = 3) -> DataFrame:
    """``graph.author_venue_stats`` for the named authors of each question."""
    where = g.published_in.join(shuffled(g.venues), g.published_in.venue_id == g.venues.id).select("paper_id", F.col("name").alias("venue"))
    rows = named.join(shuffled(where), "paper_id").join(shuffled(g.papers.select(F.col("id").alias("paper_id"), "title")), "paper_id")
    return counted(rows, "venue", "paper_count", titles, k)


def text_index(g: Graph) -> tuple[DataFrame, DataFrame]:
    """(term weights (id, term, w), vocabulary) of the papers' titles and abstracts; build it once for many batches of questions."""
    return V.text_index(g.papers.select("id", F.concat_ws(" ", "title", "abstract").alias("text")), STOP)


def keyword_search(asked: DataFrame, index: DataFrame, vocabulary: DataFrame, k: int) -> DataFrame:
    """(query_id, id, similarity_score): the whole question and each keyword searched apart, the best score of each paper, k a question."""
    subs = asked.select("query_id", F.posexplode(F.array_distinct(F.concat(F.array("clean"), F.col("entities.keywords")))).alias("sub", "text"))
    subs = subs.select(F.struct("query_id", "sub").alias("id"), "text")
    weights = V.tfidf(subs, vocabulary, STOP)
    hits = V.sparse_topk(weights.withColumnRenamed("id", "query_id"), shuffled(index), k).select(F.col("query_id.query_id").alias("query_id"), "id", "similarity_score")
    return V.best(R.best_per(hits, ["query_id", "id"], "similarity_score"), k).drop("rank")


def of_strategy(value: str | Column | None) -> Column | None:
    return F.lit(value) if isinstance(value, str) else value


def hybrid(
    g: Graph,
    questions: DataFrame,
    k: int = 10,
    index: tuple[DataFrame, DataFrame] | None = None,
    phrases: GraphIndex | None = None,
    candidates: int | str | None = "template",
    strategy: str | Column | None = None,
    template: str | Column | None = None,
) -> DataFrame:
    """(query_id, rank, paper_id, ..., score, strategy): the ranked rows of each question that passes the guardrails.

    graph_only questions run their template: both ends of the citations of the requested ids, the co-authors or the venues
    of the named authors, or the papers of any entity, with the most cited ones if those are asked for. ``candidates`` says how many of
    a question's papers, most cited first, relevance ranks: as many as the templates' own limit, k; a number; or with
    None all. Co-authors and venues have no paper_id and score and are ranked by their counts. Questions without a row fall
    back to the vector search. vector_first questions take the vector search's papers; if they name more than topics, these
    papers join the requested ids, the template runs, and its rows are ranked by relevance. Requested ids come first.

    strategy, template: overrides for all questions, or a column of questions; values that are none of the known ones change nothing.
    """
    # Written before they are analysed: the planner would evaluate questions of a local table, and plan those of a union once for each part.
    asked = Q.analyzed(kept(questions)).where("status = 'ok'")
    if template is not None:
        given = of_strategy(template)
        asked = asked.withColumn("template", F.when(given.isin(*TEMPLATES), given).otherwise(F.col("template")))
    asked = asked.withColumn("strategy", Q.strategy(F.col("entities"), of_strategy(strategy)))
    asked = kept(asked.select("query_id", "clean", "entities", "template", "strategy", has_specific(F.col("entities")).alias("specific")))
    most = k if candidates == "template" else candidates
    # Relations that several plans read are derived once.
    g = replace(g, papers=kept(g.papers), authored=kept(g.authored), published_in=kept(g.published_in))
    weights, vocabulary = index or text_index(g)
    phrases = phrases or graph_index(g)
    by_topic = kept(keyword_search(asked.where("strategy = 'vector_first'"), weights, vocabulary, k))
    # What the vector search has found for a question that names more than topics joins its requested ids.
    more = by_topic.groupBy("query_id").agg(F.collect_list("id").alias("more"))
    both_ways = asked.where("strategy = 'vector_first' AND specific").join(shuffled(more), "query_id", "left")
    known = F.array_distinct(F.concat(F.col("entities.paper_ids"), F.coalesce("more", F.array().cast("array<string>"))))
    both_ways = both_ways.withColumn("entities", F.col("entities").withField("paper_ids", known)).drop("more")
    structured = kept(asked.where("strategy = 'graph_only'").unionByName(both_ways))
    of = lambda name: structured.where(F.col("template") == name)
    pairs = graph_candidates(g, structured.where("template in ('search_papers', 'top_cited_papers')"), most, phrases).unionByName(citation_ends(g, of("search_citations"), most))
    # The most cited papers answer the question for them, which names nothing to match.
    top = g.papers.orderBy(F.desc_nulls_first("cited_by_count"), "id").limit(k).select("id")
    pairs = pairs.unionByName(of("top_cited_papers").select("query_id").crossJoin(F.broadcast(top))).distinct()
    pairs = kept(pairs)
    rows = pairs.join(shuffled(G.enrich(g, shuffled(g.papers.join(shuffled(pairs.select("id").distinct()), "id", "left_semi")), few=True).withColumnRenamed("paper_id", "id")), "id").withColumnRenamed("id", "paper_id")
    rows = kept(rows)
    scored = R.relevance(rows.join(shuffled(asked.select("query_id", "entities")), "query_id"), keep=("query_id", "paper_id")).withColumn("score", F.col("relevance"))
    found = kept(scored.select("query_id", "paper_id", "score", F.lit("graph").alias("origin")))
    by_author = kept(named_authors(g, structured.where("template in ('coauthor_network', 'author_venue_stats')"), phrases.authors).join(shuffled(structured.select("query_id", "template")), "query_id"))
    who = lambda name: by_author.where(F.col("template") == name).drop("template")
    stats = kept(coauthors(g, who("coauthor_network"), k).unionByName(author_venues(g, who("author_venue_stats"), k), allowMissingColumns=True).withColumn("origin", F.lit("graph")))
    # A question without a graph result is answered by the vector search.
    answered = kept(found.select("query_id").unionByName(stats.select("query_id")).distinct())
    rest = asked.where("strategy = 'graph_only'").join(shuffled(answered), "query_id", "left_anti")
    vector = kept(by_topic.join(shuffled(answered), "query_id", "left_anti").unionByName(keyword_search(rest, weights, vocabulary, k)))
    both = found.unionByName(vector.select("query_id", F.col("id").alias("paper_id"), F.col("similarity_score").alias("score"), F.lit("vector").alias("origin")))
    wanted = asked.select("query_id", F.explode("entities.paper_ids").alias("paper_id")).distinct().withColumn("asked", F.lit(True))
    both = R.boost(both.join(shuffled(wanted), ["query_id", "paper_id"], "left"), F.coalesce("asked", F.lit(False)), "score", 1000.0)
    both = kept(both)
    best = V.best(both.select("query_id", F.col("paper_id").alias("id"), "score", "origin"), k, score="score").withColumnRenamed("id", "paper_id")
    best = best.unionByName(stats, allowMissingColumns=True)
    return best.join(shuffled(asked.select("query_id", "template", "strategy")), "query_id")
