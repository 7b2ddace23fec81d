"""URL filters with redirect equivalence.

Redirects and canonical links are edges between URLs; URLs in one connected component are aliases. A
URL's own rule decides where one fits. Else it is blocked if some alias is blocked by a rule and none is
allowed by one: an explicit allow takes precedence over blocks that come from aliases.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftframe.llm.common import cut
from driftframe.llm.components import connected_components


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host(url: str) -> F.Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _UPPER.lower())


def path(url: str) -> F.Column:
    """What follows the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def judged(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """``df`` (host, path) with rule and own_verdict of the longest rule that fits (null if none).

    A rule fits its host and all subdomains if the path starts with the rule's. Rules of one length that
    fit the same URL can only be equal texts; allow wins then. Rules are a short driver-side list.
    """
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.verdict, r.text))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(ordered):
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit(f".{r.host}"))) & F.startswith("path", F.lit(r.path))
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return df.withColumns({"rule": rule, "own_verdict": verdict})


def node(url: F.Column) -> F.Column:
    """The URL as a node of the alias graph: without its fragment, scheme and host lower-cased, default port and bare root dropped."""
    bare = F.trim(F.regexp_replace(url, "#(?s:.*)$", ""))
    start = F.lower(F.regexp_replace(F.regexp_extract(bare, r"(?i)^([a-z][a-z0-9+.-]*://[^/?]*)", 1), r"(?i)^(http://[^:]*):80$|^(https://[^:]*):443$", "$1$2"))
    rest = F.regexp_replace(F.regexp_extract(bare, r"(?is)^[a-z][a-z0-9+.-]*://[^/?]*(.*)$", 1), "^/$", "")
    return F.nullif(F.concat(start, rest), F.lit(""))


def resolved(base: F.Column, target: F.Column) -> F.Column:
    """The full URL that ``target`` means in a page at ``base``; null if it is of a kind without host, such as mailto:."""
    parts = lambda k: F.regexp_extract(base, r"(?s)^([a-zA-Z][a-zA-Z0-9+.-]*:)(//[^/?#]*)([^?#]*)(\?[^#]*)?", k)
    full, kind = target.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), target.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")
    path, rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.when(parts(3) == "", F.lit("/")).otherwise(F.regexp_replace(parts(3), "[^/]*$", ""))
    names = F.split(F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(folder, path)), "/", -1)

    def step(acc, name):
        up = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))
        return F.when(name == ".", acc).when(name == "..", up).otherwise(F.concat(acc, F.array(name)))

    walked = F.aggregate(F.slice(names, F.lit(2), F.size(names)), F.array(F.lit("")), step)
    end = F.when(F.element_at(names, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    return (
        F.when(full, target).when(kind | (parts(1) == ""), F.lit(None))
        .when(F.startswith(target, F.lit("//")), F.concat(parts(1), target))
        .when(path == "", F.concat(parts(1), parts(2), parts(3), F.when(F.startswith(rest, F.lit("?")), F.lit("")).otherwise(parts(4)), rest))
        .otherwise(F.concat(parts(1), parts(2), F.array_join(walked, "/"), end, rest))
    )


_BASE = r"""(?is)<base\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
_LINK = r"""(?is)<link\b[^>]*?\brel\s*=\s*["']?canonical\b[^>]*>"""
_META = r"""(?is)<meta\b[^>]*?\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
_HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
_TO = r"""(?is)\burl\s*=\s*["']?([^"'\s>;]+)"""


def _computed(df: DataFrame, **columns: F.Column | str) -> DataFrame:
    """``df.select`` of these columns, each computed once a row: what follows gets values and not a copy of the expression for each use."""
    row = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()])
    return df.select(F.explode(F.array(row)).alias("s")).select("s.*")


def page_links(pages: DataFrame) -> DataFrame:
    """(a, b): nodes of a page's url and of its canonical link or refresh target, where html declares one.

    Targets may be relative to the page's url or to its <base href>; those that name no host add nothing.
    """
    holds = lambda words: F.col("html").rlike(f"(?i){words}")
    canonical = F.when(holds("canonical"), F.regexp_extract(F.regexp_extract("html", _LINK, 0), _HREF, 1))
    refresh = F.when(holds("refresh"), F.regexp_extract(F.regexp_extract("html", _META, 0), _TO, 1))
    base = F.when(holds("<base"), F.nullif(F.regexp_extract("html", _BASE, 1), F.lit("")))
    links = pages.where(holds("canonical|refresh")).select("url", base.alias("base"), F.explode(F.array(canonical, refresh)).alias("to")).where("url is not null and to is not null and to <> ''")
    plain = lambda c: F.trim(F.replace(c, F.lit("&amp;"), F.lit("&")))
    links = _computed(links, url="url", to=plain("to"), base=plain("base"))
    links = _computed(links, url="url", to="to", base=F.coalesce(resolved(F.col("url"), F.col("base")), F.col("url")))
    links = _computed(links, url="url", to=resolved(F.col("base"), F.col("to")))
    return _computed(links, a=node(F.col("url")), b=node(F.col("to"))).where("a <> b")


def filter_urls(pages: DataFrame, rules: list[Rule], links: DataFrame | None = None) -> DataFrame:
    """``pages`` (url) with host, path, rule and verdict.

    ``links`` (a, b) are nodes of more redirects, such as crawl logs hold. Null urls and those without
    ``://`` have no host and no aliases, hence no rule, and are allowed. Repeated rows stay. Columns of
    these four names are replaced.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "own_verdict", "__node")
    own = judged(pages.withColumns({"host": host("url"), "path": path("url"), "__node": node(F.col("url"))}), rules)
    edges = page_links(pages) if "html" in pages.columns else None
    if links is not None:
        links = links.select(node(F.col("a")).alias("a"), node(F.col("b")).alias("b"))
        edges = links if edges is None else edges.union(links)
    verdict = F.col("own_verdict")
    if edges is not None and (edges := cut(edges.distinct(), "alias-links")).take(1):
        labels = connected_components(edges, "aliases")
        nodes = judged(labels.withColumns({"host": host("node"), "path": F.coalesce(F.nullif(path("node"), F.lit("")), F.lit("/"))}), rules)  # a node has no bare root
        tainted = nodes.groupBy("component").agg(F.max(F.col("own_verdict") == "block").alias("blocks"), F.max(F.col("own_verdict") == "allow").alias("allows"))
        tainted = tainted.where("blocks and not allows").select("component")
        blocked = cut(labels.join(tainted, "component", "left_semi").select(F.col("node").alias("__node"), F.lit("block").alias("__alias")), "blocked-aliases")
        own = own.join(blocked, "__node", "left")
        verdict = F.coalesce(verdict, "__alias")
    return own.select(*[F.col(f"`{c}`") for c in pages.columns], "host", "path", "rule", F.coalesce(verdict, F.lit("allow")).alias("verdict"))
