"""Operator 7, URL filters with redirect equivalence.

Rules name a host (with its subdomains) and the start of a path; the longest that fits decides. Pages that redirect
to each other or name the same canonical address are one class: the connected components over those edges, found
in distributed rounds. A page without a rule of its own takes its class's decision: allow where any member is
explicitly allowed, else block where any is blocked, else allow. Targets that aren't pages count as members.

Edges: link rel=canonical, meta og:url, meta http-equiv=refresh and assignments to location in scripts. Addresses
are compared without scheme and fragment, the host in lower case.

Results for odd input: a null url or one without "://" has empty host and path, no rule and verdict allow; null
html has no edges; repeated rows get equal rows; a target that can't be resolved is left out; self-links change
nothing. Other columns are ignored.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lontar.llm import scratch
from lontar.llm.components import components


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    action: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the registered query.
RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))
BROADCAST_ROWS = 20_000
_PARTS = r"^(?s:.*?)://([^/?#]*)([^?#]*)(\?[^#]*)?"
_TAG = r"(?is)<(?:link|meta)\b[^>]*>"
_SCRIPT = r"""(?i)\blocation(?:\.href)?\s*=\s*["']([^"']+)["']|\blocation\.(?:replace|assign)\(\s*["']([^"']+)["']"""


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def key_of(url: Column) -> Column:
    """An address without scheme and fragment (null if it isn't one)."""
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    return F.when(host_of(url) != "", F.concat(host_of(url), path, F.regexp_extract(url, _PARTS, 3)))


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """(size, name, action) of the longest rule that fits; null if none does. Meant for lists of rules that fit a plan."""
    fits = [
        F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.struct(F.lit(len(r.name)).alias("size"), F.lit(r.name).alias("name"), F.lit(r.action).alias("action")))
        for r in rules
    ]
    return fits[0] if len(fits) == 1 else F.greatest(*fits)


def _attribute(tag: Column, name: str) -> Column:
    quoted = F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 1)
    single = F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 2)
    bare = F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 3)
    return F.trim(F.concat(quoted, single, bare))


def _target(tag: Column) -> Column:
    """Where a link or meta tag sends to; empty if nowhere."""
    return (
        F.when(tag.rlike(r"(?is)^<link\b.*\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"), _attribute(tag, "href"))
        .when(tag.rlike(r"(?is)^<meta\b.*\b(?:property|name)\s*=\s*[\"']?og:url\b"), _attribute(tag, "content"))
        .when(tag.rlike(r"(?is)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?refresh\b"), F.regexp_extract(_attribute(tag, "content"), r"""(?is)url\s*=\s*['"]?\s*([^'"\s]+)""", 1))
        .otherwise("")
    )


def _resolved(target: Column, url: Column) -> Column:
    """target as an absolute address, seen from url."""
    here = F.concat(F.lit("http://"), host_of(url))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(here, target))
        .when(target.startswith("?"), F.concat(here, path_of(url), target))
        .when((target == "") | target.startswith("#") | target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .otherwise(F.concat(here, F.regexp_replace(path_of(url), r"[^/]*$", ""), F.regexp_replace(target, r"^\./", "")))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """url and target of every redirect or canonical link between two different addresses."""
    html = F.col("html").cast("string")
    some = pages.select(F.col("url").cast("string").alias("url"), html.alias("html")).filter(html.rlike(r"(?i)canonical|og:url|refresh|location"))
    tags = F.transform(F.regexp_extract_all("html", F.lit(_TAG), F.lit(0)), _target)
    moves = F.concat(F.regexp_extract_all("html", F.lit(_SCRIPT), F.lit(1)), F.regexp_extract_all("html", F.lit(_SCRIPT), F.lit(2)))
    found = some.select("url", F.explode(F.array_distinct(F.concat(tags, moves))).alias("t")).filter("t <> ''")
    found = found.select("url", _resolved(F.regexp_replace("t", "&amp;", "&"), F.col("url")).alias("target"))
    return found.filter(key_of(F.col("target")).isNotNull() & (key_of(F.col("target")) != key_of(F.col("url"))))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    edges = scratch.table(alias_edges(pages), "edges")
    url = F.col("url").cast("string")
    seen = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.xxhash64(key_of(url)).alias("node"))
    seen = seen.withColumn("own", longest_rule(F.col("host"), F.col("path"), rules))
    if edges.isEmpty():
        decided = seen.withColumn("theirs", F.lit(None).cast("string"))
    else:
        decisions = scratch.checkpoint(_class_decisions(edges, rules))
        side = F.broadcast(decisions) if decisions.count() <= BROADCAST_ROWS else decisions
        decided = seen.join(side, "node", "left")
    return decided.select("page_id", "host", "path", F.col("own.name").alias("rule"), F.coalesce("own.action", "theirs", F.lit("allow")).alias("verdict"))


def _class_decisions(edges: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """node and its class's decision, for every address at an end of an edge whose class has a rule."""
    ends = edges.select(F.explode(F.array("url", "target")).alias("u"))
    ends = ends.select(F.xxhash64(key_of(F.col("u"))).alias("node"), longest_rule(host_of(F.col("u")), path_of(F.col("u")), rules)["action"].alias("action"))
    ends = ends.groupBy("node").agg(F.max(F.col("action") == "allow").alias("allowed"), F.max(F.col("action") == "block").alias("blocked"))
    roots = components(edges.select(F.xxhash64(key_of(F.col("url"))).alias("a"), F.xxhash64(key_of(F.col("target"))).alias("b")))
    placed = scratch.checkpoint(ends.join(roots, "node"))
    classes = scratch.checkpoint(placed.groupBy("root").agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked")))
    decided = classes.select("root", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("theirs"))
    return placed.select("node", "root").join(decided, "root").filter("theirs is not null").select("node", "theirs")
