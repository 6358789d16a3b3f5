"""URL filter with redirect equivalence.

A rule is a host and a path prefix with a verdict; it fits the host and its subdomains, and the longest that
fits wins. URLs without a rule get their verdict from their aliases: URLs that redirect to each other or
name the same canonical URL are one component, and a block of one member holds for all others, unless a
member is explicitly allowed. A URL's own rule is never overruled.

Edges are: URL to the target of its page's ``<link rel="canonical">``, URL to the target of its ``<meta
http-equiv="refresh">``, and URL to its canonical form (scheme, default port, fragment, tracking parameters, and a final
slash or ``.html`` don't count). Only undecided pages need them; components are found by distributed star contraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import local_frame, materialize
from .components import components

#: Query parameters that don't name another page (published conventions; fixed values).
TRACKING = ["utm_[a-z]+", "gclid", "fbclid", "msclkid", "ref"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; empty without."""
    return F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or end; empty without a host part."""
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host, path and remaining query of a URL; null if it has no host."""
    host = F.regexp_replace(host_of(url), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"(\.html|/)$", "")
    query = F.split(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_join(F.filter(query, lambda q: (q != "") & ~q.rlike(f"^({'|'.join(TRACKING)})(=|$)")), "&")
    return F.when(host != "", F.concat(host, path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept))))


def without_dots(path: Column) -> Column:
    """A path from the root without its ``.`` and ``..`` segments."""
    parts = F.split(path, "/", -1)
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), lambda a, s: (
        F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(s == ".", a).otherwise(F.concat(a, F.array(s)))))
    final = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), final)


def absolute(target: Column, url: Column) -> Column:
    """A link's target as an absolute URL; null for other schemes (``mailto:``) and for pages without ``://``.

    Relative targets are resolved against the page's URL: from the root, from its path up to the last ``/``, or, if they
    are only a query, a fragment or empty, from the page itself. A ``<base>`` of the page isn't read.
    """
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    root = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1), F.lit("")), F.lit("/"))
    target = F.regexp_replace(F.trim(target), "&amp;", "&")
    path, rest = (F.regexp_extract(target, r"(?s)^([^?#]*)(.*)$", k) for k in (1, 2))
    same = F.when(rest.startswith("?"), F.regexp_extract(url, r"(?s)^([^?#]*)", 1)).otherwise(F.regexp_extract(url, r"(?s)^([^#]*)", 1))
    return (F.when(target.rlike(r"^[^/?#]*://"), target)
            .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
            .when((root == "") | target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
            .when(path == "", F.concat(same, rest))
            .when(path.startswith("/"), F.concat(root, without_dots(path), rest))
            .otherwise(F.concat(root, without_dots(F.concat(folder, path)), rest)))


def links(pages: DataFrame) -> DataFrame:
    """``url, target`` for canonical links and redirects in the pages' HTML."""
    html, tag = F.coalesce(F.col("html"), F.lit("")), r"(?is)<(?:link|meta)\b[^>]*>"
    tags = pages.where(F.col("url").isNotNull()).select("url", F.explode(F.regexp_extract_all(html, F.lit(tag), 0)).alias("tag"))
    quoted = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""

    def attribute(name: str) -> Column:
        pattern = rf"(?is)\s{name}{quoted}"
        return F.concat(*[F.regexp_extract("tag", pattern, k) for k in (1, 2, 3)])

    link = F.when(F.lower(attribute("rel")).rlike(r"(^|\s)canonical(\s|$)"), attribute("href"))
    refresh = F.when(F.lower(attribute("http-equiv")) == "refresh", F.regexp_extract(attribute("content"), r"""(?is)url\s*=\s*['"]?([^'"\s]+)""", 1))
    target = absolute(F.coalesce(link, refresh), F.col("url"))
    return tags.select("url", target.alias("target")).where("target is not null")


def with_rules(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``pages`` with ``host, path, rule, rule_verdict``; rules are (verdict, host, path).

    The longest host and path together win; of equally long ones the longer host, then allow.
    """
    parts = pages.withColumns({"host": F.coalesce(host_of(F.col("url")), F.lit("")), "path": F.coalesce(path_of(F.col("url")), F.lit(""))})
    table = local_frame(pages.sparkSession, [(h, p, v, len(h) + len(p), len(h), v == "allow") for v, h, p in rules],
                        "rule_host string, rule_path string, rule_verdict string, length int, host_length int, allowed boolean")
    # rules are found once per distinct host, by its suffixes
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    hosts = parts.select("host").distinct().withColumn("rule_host", F.explode(suffixes)).join(table, "rule_host")
    by_host = hosts.groupBy("host").agg(F.collect_list(F.struct("length", "host_length", "allowed", "rule_host", "rule_path", "rule_verdict")).alias("_rules"))
    best = F.array_max(F.filter("_rules", lambda r: F.col("path").startswith(r["rule_path"])))
    judged = parts.join(by_host, "host", "left").withColumn("_best", best)
    return judged.withColumns({"rule": F.concat("_best.rule_host", "_best.rule_path"), "rule_verdict": F.col("_best.rule_verdict")}).drop("_best", "_rules")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of each row of ``pages`` (page_id, url, html).

    ``rule`` is host and path of the rule that fits, else null; ``verdict`` is its verdict, else that of the
    component: block if a member is blocked and none is allowed explicitly, allow otherwise. URLs that are null or have no
    ``://`` have an empty host and path, fit no rule but one for the empty host, and are allowed. Rows that repeat a
    page_id or URL are judged each. Null HTML has no links. Other columns are ignored.
    """
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    judged = materialize(with_rules(narrow.drop("html"), rules).withColumn("node", canonical(F.col("url"))), "judged")
    found = materialize(links(narrow).select(canonical(F.col("url")).alias("a"), canonical(F.col("target")).alias("b"), "target").where(
        "a is not null and b is not null"), "links")
    joined = components(found.select("a", "b").distinct(), "a", "b")
    # a target without a page still has a verdict by the rules
    known = with_rules(found.select(F.col("target").alias("url"), F.col("b").alias("node")).distinct(), rules)
    members = judged.select("node", "rule_verdict").union(known.select("node", "rule_verdict")).where("node is not null and rule_verdict is not null").distinct()
    rooted = members.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    verdicts = rooted.groupBy("root").agg(
        F.when(F.max(F.col("rule_verdict") == "allow"), "allow").otherwise("block").alias("component_verdict"))
    open_nodes = judged.where("rule is null").select("node").distinct().join(joined, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    named = open_nodes.join(verdicts, "root").select(F.col("node").alias("_node"), "component_verdict")
    result = judged.join(named, F.col("node") == F.col("_node"), "left")
    return result.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "component_verdict", F.lit("allow")).alias("verdict"))
