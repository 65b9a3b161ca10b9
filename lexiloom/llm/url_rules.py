"""URL filters with redirect equivalence.

Rules name hosts with their subdomains and path prefixes; the longest that fits decides. A
page no rule fits is decided by its aliases: URLs joined by redirects and canonical links
(declared in the page, or implied by spelling the same address in another way) are one class,
found as connected components; a class with an allowed member is allowed, else one with a
blocked member is blocked, else it is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexiloom.llm.components import connected_components
from lexiloom.llm.tables import query, table
from lexiloom.session import cut_lineage

#: (host, path prefix, verdict); the longest rule that fits a URL decides.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host_of(url: Column) -> Column:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """Path: from the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """``rule, verdict`` of the longest rule that fits, or null. Equally long rules: allow first.

    The rules are a list of the caller's, tried as one expression per row.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    ranked = sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[2] == "allow"))
    for name, prefix, verdict in ranked:
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def canonical_spelling(url: Column) -> Column:
    """One spelling of an address: no scheme, fragment, ``www.``, tracking query, index page, suffix ``.html`` or last slash.

    ``www.`` is cut only from a host that has a dot without it, so that no host becomes a name
    of its own or another one's.
    """
    host = F.regexp_replace(host_of(url), r"^www\.(?=[^.]+\.[^.])", "")
    bare = F.regexp_replace(path_of(url), r"/index\.(?:html?|php)$", "/")
    path = F.regexp_replace(F.regexp_replace(bare, r"\.html?$", ""), r"/+$", "")
    asked = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    kept = F.array_sort(F.filter(asked, lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def _without_dots(path: Column) -> Column:
    """A path with ``.`` and ``..`` carried out."""
    def step(held: Column, part: Column) -> Column:
        up = F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(1)))
        return F.when(part == "..", up).when(part == ".", held).otherwise(F.concat(held, F.array(part)))

    parts = F.split(path, "/")
    walked = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array(F.lit("")), step)
    ends_inside = F.element_at(parts, -1).isin(".", "..")
    return F.concat(F.array_join(walked, "/"), F.when(ends_inside | (F.size(walked) == 1), F.lit("/")).otherwise(F.lit("")))


def resolved(target: Column, url: Column) -> Column:
    """The address a link on a page means, whatever form it has; null for one that is no page's.

    Whole addresses, ``//host/path``, ``/path``, ``path``, ``../path`` and ``?query``; a fragment
    alone is the page itself, and another scheme (``mailto:``) no page.
    """
    link = F.regexp_replace(F.trim(F.regexp_replace(target, r"[\t\r\n]", "")), "#.*$", "")
    scheme, host, path = F.regexp_extract(url, r"^([^:/?#]+)://", 1), host_of(url), path_of(url)
    root = F.concat(scheme, F.lit("://"), host)
    asked = F.regexp_extract(link, r"(\?.*)$", 1)
    own = F.regexp_replace(link, r"\?.*$", "")
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    within = F.when(own.startswith("/"), own).otherwise(F.concat(folder, own))
    return (
        F.when(link.rlike(r"(?i)^https?://[^/?#]"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None).cast("string"))
        .when(link == "", url)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("?"), F.concat(root, path, link))
        .otherwise(F.concat(root, _without_dots(within), asked))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """``url, target``: canonical links and redirects that pages declare, relative ones resolved."""
    tag = lambda pattern: F.regexp_extract_all("html", F.lit(pattern), 1)
    declared = F.concat(
        tag(r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical["']?[^>]*\bhref\s*=\s*["']([^"'>]+)"""),
        tag(r"""(?is)<link\b[^>]*\bhref\s*=\s*["']([^"'>]+)["'][^>]*\brel\s*=\s*["']?canonical"""),
        tag(r"""(?is)<meta\b[^>]*\bproperty\s*=\s*["']og:url["'][^>]*\bcontent\s*=\s*["']([^"'>]+)"""),
        tag(r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh["']?[^>]*\bcontent\s*=\s*["'][^"'>]*url=([^"'>]+)"""),
    )
    found = pages.where("html is not null and url is not null").select("url", F.explode(declared).alias("target"))
    return found.select("url", resolved(F.col("target"), F.col("url")).alias("target")).where("target is not null")


def judged(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, alias_class`` of every page.

    ``redirects`` (``url, target``) adds redirects observed elsewhere. A null URL, or one without
    ``://``, has an empty host and path, no alias and is allowed. Repeated rows are judged
    alike; an allowed member of a class takes precedence over any number of blocked ones.
    Classes are components of hashed spellings; nothing of them reaches the driver.
    """
    node = lambda c: F.xxhash64(canonical_spelling(F.col(c)))
    url = F.col("url")
    known = cut_lineage(pages.select(
        "page_id", host_of(url).alias("host"), path_of(url).alias("path"), rule_of(host_of(url), path_of(url), rules).alias("found"),
        F.when(url.contains("://"), node("url")).alias("node"),
    ))
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("url", "target"))
    edges = links.where("target like '%://%'").select(node("url").alias("a"), node("target").alias("b"))
    classes = connected_components(edges)
    # Pages without an address have no class and take no part in the joins, where they would meet in one task.
    aliased = known.where("node is not null").join(classes, "node", "left").withColumn("alias_class", F.coalesce("component", "node"))
    ruled = aliased.where("found is not null").groupBy("alias_class").agg(
        F.max(F.col("found.verdict") == "allow").alias("allowed")
    )
    spread = F.when(F.col("allowed"), F.lit("allow")).otherwise(F.when(F.col("allowed").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    shown = ["page_id", "host", "path", F.col("found.rule").alias("rule")]
    lone = known.where("node is null").select(*shown, F.coalesce("found.verdict", F.lit("allow")).alias("verdict"), F.col("node").alias("alias_class"))
    return aliased.join(ruled, "alias_class", "left").select(
        *shown, F.coalesce("found.verdict", spread).alias("verdict"), "alias_class"
    ).unionByName(lone)


@query("op5_url_filters")
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", "html"))
