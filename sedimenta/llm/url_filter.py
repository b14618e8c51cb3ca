"""URL filters with redirect equivalence.

A rule names a host, with its subdomains, and the beginning of a path; the longest rule that
fits a URL decides. URLs that redirect to one another or name one another as canonical are
aliases: connected components over those links carry a block to aliases without a rule of
their own. An explicit allow comes first: it holds for its own URL, and a component that holds
one hands no block on.

Cases: a null URL, or one without ``://``, has an empty host and path and fits no rule. Pages
with the same address are one node. Rows repeat as they come in; an empty table gives no rows.
Relative links start from the address of their page; a ``base`` element is not read. An
ampersand written as an entity counts as one. Links of other schemes (``mailto:``) and mere
fragments tie nothing. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.components import components
from sedimenta.llm.line_dedup import LOWER, UPPER
from sedimenta.llm.storage import stash

ALLOW, BLOCK = "allow", "block"
# A tag that may name another address of its page, and the address in it.
CANONICAL = r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?i)\bhref\s*=\s*[\"']?([^\s\"'>]+)"
AMPERSAND = r"(?i)&(?:amp|#0*38|#x0*26);"
REFRESH_URL = r"(?i)\burl\s*=\s*[\"']?([^\s\"'>;]+)"


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, F.lit("://"))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """What names a page: host, path and query, without scheme and fragment; null without ``://``."""
    rest = F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^#]*)", 1)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(F.instr(url, F.lit("://")) > 0, F.concat(host_of(url), rest))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)


def decide(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and action of the longest rule that fits; null without one. Equally long: allow first."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.action != ALLOW, r.text))
    text = action = F.lit(None).cast("string")
    for rule in reversed(ordered):
        text = F.when(fits(rule, host, path), F.lit(rule.text)).otherwise(text)
        action = F.when(fits(rule, host, path), F.lit(rule.action)).otherwise(action)
    return text, action


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Rows ``a, b``: addresses that a page's canonical link or redirect ties together."""
    own = pages.where(F.col(url).isNotNull() & F.col(html).isNotNull()).select(
        F.col(url).alias("url"), F.col(html).alias("html"), F.lower(html).alias("low")
    )
    own = own.where(F.col("low").contains("canonical") | F.col("low").contains("refresh"))
    plain = lambda t: F.regexp_replace(t, AMPERSAND, "&")
    tags = F.concat(
        F.transform(F.regexp_extract_all("html", F.lit(CANONICAL), F.lit(0)), lambda t: F.regexp_extract(plain(t), HREF, 1)),
        F.transform(F.regexp_extract_all("html", F.lit(REFRESH), F.lit(0)), lambda t: F.regexp_extract(plain(t), REFRESH_URL, 1)),
    )
    found = own.select("url", F.explode(tags).alias("to"))
    return _absolute(found)


def redirect_links(redirects: DataFrame, source: str = "url", target: str = "to") -> DataFrame:
    """The same rows from a table of redirects."""
    return _absolute(redirects.select(F.col(source).alias("url"), F.col(target).alias("to")))


def _without_dots(path: Column) -> Column:
    """A path from the root with its ``.`` and ``..`` steps taken."""
    steps = F.split(path, "/", -1)
    step = lambda done, x: (
        F.when(x == "..", F.slice(done, 1, F.greatest(F.lit(0), F.size(done) - 1))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    )
    taken = F.aggregate(F.slice(steps, 2, F.size(steps)), F.array().cast("array<string>"), step)
    taken = F.when(F.element_at(steps, -1).isin(".", ".."), F.concat(taken, F.array(F.lit("")))).otherwise(taken)
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(taken, "/"))).otherwise(path)


def _absolute(found: DataFrame) -> DataFrame:
    to, url = F.col("to"), F.col("url")
    path = F.regexp_extract(to, r"^[^?#]*", 0)
    own = F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url))
    resolved = (
        F.when(path == "", own)
        .when(to.startswith("/"), _without_dots(path))
        .otherwise(_without_dots(F.concat(F.regexp_extract(own, r"^.*/", 0), path)))
    )
    full = (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.startswith("//"), F.concat(F.lit("x:"), to))
        .when((to != "") & ~to.startswith("#") & ~to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"),
              F.concat(F.lit("x://"), host_of(url), resolved, F.regexp_extract(to, r"\?[^#]*", 0)))
    )
    ends = found.select(address(url).alias("a"), address(full).alias("b"))
    return ends.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")


def judge(
    pages: DataFrame, rules: Sequence[Rule], links: DataFrame | None = None, url: str = "url", html: str = "html"
) -> DataFrame:
    """Columns of the pages without their html, with ``host, path, rule, verdict, component``.

    ``component`` is the smallest address of a page's aliases, null without links. Input columns
    with one of these five names are replaced; all others pass, whatever their names.
    """
    tied = page_links(pages, url, html)
    if links is not None:
        tied = tied.unionByName(links.select("a", "b"))
    aliases = components(tied).withColumnRenamed("node", "_node").withColumnRenamed("component", "_component")
    names = [c for c in pages.columns if c not in (html, "host", "path", "rule", "verdict", "component")]
    text, action = decide(rules, F.col("_d.host"), F.col("_d.path"))
    judged = (
        pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(url).alias("_url"))
        .withColumn("_d", F.struct(host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path")))
        .withColumns({"_rule": text, "_action": action, "_address": address(F.col("_url"))})
    )
    # What a component holds: its own nodes' rules, whether or not a page of that address was read.
    node = F.concat(F.lit("x://"), F.col("_node"))
    by_node = aliases.withColumn("_action", decide(rules, host_of(node), path_of(node))[1])
    held = by_node.groupBy("_component").agg(
        F.bool_or(F.col("_action").eqNullSafe(BLOCK)).alias("_blocked"),
        F.bool_or(F.col("_action").eqNullSafe(ALLOW)).alias("_allowed"),
    )
    settled = stash(
        aliases.join(held, "_component").select("_node", "_component", (F.col("_blocked") & ~F.col("_allowed")).alias("_passed_on")),
        "aliases",
    )
    out = judged.join(settled, F.col("_address") == F.col("_node"), "left")
    verdict = F.coalesce("_action", F.when(F.col("_passed_on"), F.lit(BLOCK)), F.lit(ALLOW))
    return out.select(
        *[F.col("_row").getField(c).alias(c) for c in names],
        F.col("_d.host").alias("host"), F.col("_d.path").alias("path"), F.col("_rule").alias("rule"),
        verdict.alias("verdict"), F.col("_component").alias("component"),
    )
