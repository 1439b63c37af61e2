"""Raw parameterised SQL over the graph tables, and saved query templates."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators import graph as G
from ..sources.graph import Graph

MAX_LIMIT = 1000
#: Parameters a query may name without a value.
DEFAULTS = {"paper_ids": [], "author_names": [], "keywords": [], "venue": "", "institution": "", "year": "", "year_from": "1900", "year_to": "2099"}


_QUIET = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.DOTALL)
_CLAUSES = re.compile(r"\b(where|group\s+by|having|window|order\s+by|sort\s+by|limit|offset|union|except|intersect)\b", re.IGNORECASE)
#: Keywords that refine a query at most.
MOST_WORDS = 5


def unquoted(text: str) -> str:
    """The text with literals, quoted names and comments blanked, place by place."""
    return _QUIET.sub(lambda m: " " * len(m[0]), text)


def outline(text: str) -> str:
    """The text with all that is quoted or in parentheses blanked, place by place: what is left belongs to the outermost query."""
    out, depth = [], 0
    for c in unquoted(text):
        depth -= c == ")"
        out.append(c if depth == 0 and c != ")" and c != "(" else " ")
        depth += c == "("
    return "".join(out)


def clauses(text: str) -> list[tuple[str, int, int]]:
    """(name, begin, end of the keyword) of the outermost query's clauses behind FROM, in their order."""
    return [(" ".join(m[1].lower().split()), m.start(), m.end()) for m in _CLAUSES.finditer(outline(text))]


def with_limit(text: str, limit: int | str) -> str:
    """The query with its outermost LIMIT, a number or a parameter, replaced, or with one where it has none."""
    text = text.rstrip().rstrip(";").rstrip()
    found = clauses(text)
    for k, (name, _, end) in enumerate(found):
        if name == "limit":
            rest = found[k + 1][1] if k + 1 < len(found) else len(text)
            return f"{text[:end]} {limit} {text[rest:]}".rstrip()
    for name, begin, _ in found:
        if name == "offset":
            return f"{text[:begin]}LIMIT {limit} {text[begin:]}"
    return f"{text}\nLIMIT {limit}"


def with_conditions(text: str, conditions: Sequence[str], any_of: bool = False) -> str:
    """The query whose rows also satisfy all conditions, or with any_of also the rows that satisfy one of them.

    The query's own condition counts as a whole, whatever it holds; without one the conditions stand alone.
    """
    if not conditions:
        return text
    text, word = text.rstrip().rstrip(";").rstrip(), " OR " if any_of else " AND "
    found = clauses(text)
    if any(name in ("union", "except", "intersect") for name, _, _ in found):
        raise ValueError("conditions go into a single SELECT, not into a set operation")
    more = word.join(f"({c})" for c in conditions)
    behind = [x for x in found if x[0] != "where"]
    end = behind[0][1] if behind else len(text)
    for name, _, start in found:
        if name == "where":
            return f"{text[:start]} ({text[start:end].strip()}){word}{more} {text[end:]}".rstrip()
    return f"{text[:end].rstrip()} WHERE {more} {text[end:]}".rstrip()


def alias_of(text: str, name: str = "papers") -> str | None:
    """What the outermost query calls a table: its alias or its own name; None if it does not read it."""
    m = re.search(rf"\b{name}\b(?:\s+(?:as\s+)?(?!(?:where|group|having|window|order|sort|limit|offset|join|inner|left|right|full|cross|on|union|except|intersect)\b)([A-Za-z_]\w*))?", outline(text), re.IGNORECASE)
    return (m[1] or name) if m else None


def entity_conditions(p: str, entities: dict) -> list[str]:
    """Conditions on the papers called p, with named parameters: ids, authors, year or years, venue; keywords only without ids and authors."""
    holds = "exists(:{0}, x -> contains(lower({1}), lower(x)))"
    linked = lambda edge, node, key, test: f"EXISTS (SELECT 1 FROM {edge} e JOIN {node} n ON e.{key} = n.id WHERE e.paper_id = {p}.id AND {test})"
    out = []
    if entities.get("paper_ids"):
        out.append(f"array_contains(:paper_ids, {p}.id)")
    if entities.get("author_names"):
        out.append(linked("authored", "authors", "author_id", holds.format("author_names", "n.name")))
    if entities.get("year"):
        out.append(f"startswith({p}.publication_date, :year)")
    elif entities.get("year_from") or entities.get("year_to"):
        out.append(f"{p}.publication_date >= :year_from AND {p}.publication_date < :year_to")
    if entities.get("keywords") and not entities.get("paper_ids") and not entities.get("author_names"):
        out.append(" OR ".join(holds.format("keywords", f"coalesce({p}.{c}, '')") for c in ("title", "abstract")))
    if entities.get("venue"):
        out.append(linked("published_in", "venues", "venue_id", "contains(lower(n.name), lower(:venue))"))
    return out


def refine(text: str, entities: dict, any_of: bool = False, limit: int | str | None = None) -> tuple[str, dict]:
    """A raw query over papers narrowed (or with any_of broadened) by the entities of a question, and its parameters."""
    p = alias_of(text)
    if p is not None:
        text = with_conditions(text, entity_conditions(p, entities), any_of)
    given = {k: v for k, v in entities.items() if k in DEFAULTS and v}
    params = {**DEFAULTS, **given, "keywords": list(given.get("keywords", []))[:MOST_WORDS]}
    return (text if limit is None else with_limit(text, limit)), params


def graph_sql(g: Graph, text: str, params: dict | None = None, limit: int = 100) -> DataFrame:
    """Run SQL over papers, authors, venues, ...; missing parameters get their defaults and a query without LIMIT gets one."""
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit is between 1 and {MAX_LIMIT}")
    g.register()
    named = set(re.findall(r":([A-Za-z_]\w*)", unquoted(text)))
    args = {k: v for k, v in {**DEFAULTS, **(params or {})}.items() if k in named}
    limited = any(name in ("limit", "offset") for name, _, _ in clauses(text))
    return g.papers.sparkSession.sql(text if limited else with_limit(text, limit), args=args)


class StoredTemplates:
    """Query templates of a JSON folder, {name, text, needs}: loaded once, again on reload(), run with the entities as parameters."""

    def __init__(self, g: Graph, path: str):
        self.g, self.path = g, path
        self.reload()

    def reload(self) -> int:
        rows = self.g.papers.sparkSession.read.schema("name string, text string, needs array<string>").json(self.path)
        self.known = {r["name"]: r for r in rows.where("name is not null and text is not null").collect()}
        return len(self.known)

    def viable(self, entities: dict) -> list[str]:
        return sorted(n for n, r in self.known.items() if all(entities.get(x) for x in r["needs"] or ()))

    def run(self, name: str, entities: dict, k: int = 10) -> DataFrame:
        return graph_sql(self.g, self.known[name]["text"], entities, k)


#: Query templates: what they are for, the entities that trigger them, and the plan they build.
TEMPLATES = {
    "search_papers": ("papers by any of the entities found", (), lambda g, e, k: G.search_papers(g, e, k)),
    "search_citations": ("papers that cite or are cited by given ones", ("paper_ids", "wants_citations"), lambda g, e, k: G.search_citations(g, e.get("paper_ids") or [], k)),
    "top_cited_papers": ("the most cited papers", ("wants_top_cited",), lambda g, e, k: G.top_cited_papers(g, k)),
    "coauthor_network": ("who publishes with given authors", ("author_names", "wants_coauthors"), lambda g, e, k: G.coauthor_network(g, e.get("author_names") or [], k)),
    "author_venue_stats": ("where given authors publish", ("author_names",), lambda g, e, k: G.author_venue_stats(g, e.get("author_names") or [], k)),
}
#: From the most to the least specific.
PRIORITY = ("search_citations", "coauthor_network", "author_venue_stats", "top_cited_papers", "search_papers")


def viable_templates(entities: dict) -> list[str]:
    return [k for k in PRIORITY if all(entities.get(x) for x in TEMPLATES[k][1])]


def run_template(g: Graph, key: str, entities: dict, k: int = 10) -> DataFrame:
    return TEMPLATES[key][2](g, entities, k)
