"""Breadth-first crawl of a page snapshot, level by level, as joins.

The frontier is a table. Each level joins it with the snapshot, drops what the
rules exclude, and anti-joins the links with all keys seen so far. A page's
place in the breadth-first order is a path of link positions, so that "first
seen wins" doesn't depend on how rows lie in partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import urls as u
from tessella.functions.robots import allowed
from tessella.session import written
from tessella.sources.web import read_web_pages

MAX_PAGES, MAX_DEPTH, MAX_BYTES = 150, 3, 5 * 1024 * 1024


def crawl_sites(
    pages: DataFrame, starts: DataFrame, max_pages: int = MAX_PAGES, max_depth: int = MAX_DEPTH,
    sections: tuple[str, ...] = u.SKIPPED_SECTIONS, disallowed: tuple[str, ...] = (), languages: bool = True,
    robots: DataFrame | None = None,
) -> DataFrame:
    """Pages reached from ``starts`` (``site``, ``url``; a row for each site) in a snapshot ``page_id, url, html``: ``site, key, url, title, text, depth, path, state``.

    ``state`` is ``indexed``, or why a page was fetched but not indexed: copy of
    another text, ``noindex``, empty, an excluded section, too large. ``disallowed`` are path
    prefixes for all hosts, ``robots`` rules of each (``functions.robots.rules_for``, ``site`` being the host). Pages of a site beyond ``max_pages`` fetched, in
    breadth-first order, are left out after each level, so that no level is followed further than
    its site has room; at most ``max_depth`` levels are joined.
    All sites go on together; parsed pages and levels are tables, so that no
    level plans or runs the ones before again.
    """
    usable = pages.where(F.col("html").isNotNull() & (F.octet_length("html") <= MAX_BYTES))
    parsed = written(read_web_pages(usable).withColumn("key", u.url_key(F.col("url"))).where("key IS NOT NULL").dropDuplicates(["key"]))
    roots = starts.select("site", F.col("url").alias("start")).withColumn("key", u.url_key(F.col("start")))
    own = roots.select("site", F.col("start").alias("at"))
    if languages:
        own = own.unionByName(roots.join(parsed.select("key", "variants"), "key").select("site", F.explode("variants").alias("at")))
    hosts = written(own.select("site", u.authority(u.clean_url(F.col("at"))).alias("host")).distinct())
    frontier = roots.select("site", "key", F.lit("").alias("path"), F.lit(0).alias("depth"))
    seen, levels = frontier.select("site", "key"), []
    by_path = Window.partitionBy("site").orderBy("path")
    blocked = F.lit(False)
    for prefix in disallowed:
        blocked = blocked | u.path(F.col("url")).startswith(prefix)
    for depth in range(max_depth + 1):
        level = frontier.join(parsed, "key").where(~blocked)
        if robots is not None:
            level = _permitted(level, robots)
        if levels:
            before = reduce(DataFrame.unionByName, (x.groupBy("site").agg(F.count("*").alias("fetched")) for x in levels)).groupBy("site").agg(F.sum("fetched").alias("fetched"))
            level = level.join(before, "site", "left")
        else:
            level = level.withColumn("fetched", F.lit(0))
        level = level.withColumn("place", F.row_number().over(by_path)).where(F.col("place") <= max_pages - F.coalesce("fetched", F.lit(0))).drop("place", "fetched")
        level = written(level.withColumn("skipped", u.is_skipped(F.col("url"), sections) if depth and sections else F.lit(False)))
        levels.append(level)
        if depth == max_depth:
            break
        links = level.where("NOT nofollow AND NOT skipped").select("site", "path", F.posexplode("links").alias("at", "link"))
        links = links.where(~u.is_asset(F.col("link")) & ~u.is_skipped(F.col("link"), sections)).withColumn("host", u.authority(u.clean_url(F.col("link"))))
        links = links.join(hosts, ["site", "host"], "left_semi")
        found = links.select("site", u.url_key(F.col("link")).alias("key"), F.concat("path", F.lpad(F.col("at").cast("string"), 6, "0"), F.lit("/")).alias("path"))
        fresh = found.groupBy("site", "key").agg(F.min("path").alias("path")).join(seen, ["site", "key"], "left_anti")
        frontier = written(fresh.withColumn("depth", F.lit(depth + 1)))
        seen = seen.unionByName(frontier.select("site", "key"))
    fetched = reduce(DataFrame.unionByName, levels)
    state = F.when(F.col("skipped"), "section").when(F.col("noindex"), "noindex").when(F.col("text") == "", "empty").otherwise("indexed")
    judged = fetched.withColumns({"state": state, "digest": F.sha1("text")})
    firsts = judged.where("state = 'indexed'").groupBy("site", "digest").agg(F.min(F.struct("depth", "path")).alias("first"))
    judged = judged.join(firsts, ["site", "digest"], "left")
    copy = (F.col("state") == "indexed") & ((F.col("first.path") != F.col("path")) | (F.col("first.depth") != F.col("depth")))
    title = F.when(F.col("title") == "", u.title_from_url(F.col("url"))).otherwise(F.col("title"))
    return judged.select("site", "key", "url", title.alias("title"), "text", "depth", "path", F.when(copy, "copy").otherwise(F.col("state")).alias("state"))


def _permitted(level: DataFrame, robots: DataFrame) -> DataFrame:
    """Pages of a level that the rules of their host allow."""
    url = u.clean_url(F.col("url"))
    path = F.regexp_replace(F.regexp_extract(url, r"^[^:]*://[^/?#]*([^#]*)", 1), r"^(?!/)", "/")
    asked = level.select("site", "key", u.authority(url).alias("host"), path.alias("at")).distinct()
    judged = allowed(asked.select(F.col("site").alias("of"), "key", F.col("host").alias("site"), F.col("at").alias("path")), robots)
    return level.join(judged.where("allowed").select(F.col("of").alias("site"), "key"), ["site", "key"], "left_semi")


def crawl_snapshot(pages: DataFrame, start: str, **rules) -> DataFrame:
    """``crawl_sites`` from one start."""
    return crawl_sites(pages, pages.sparkSession.range(1).select(F.lit(start).alias("site"), F.lit(start).alias("url")), **rules).drop("site")


def crawl_stats(crawled: DataFrame) -> DataFrame:
    """Counters of a crawl in one row; ``script_site`` warns where much markup holds hardly any text."""
    return crawled.agg(
        F.count("*").alias("fetched"), F.count_if(F.col("state") == "indexed").alias("indexed"), F.count_if(F.col("state") == "copy").alias("copies"),
        F.count_if(F.col("state") == "noindex").alias("noindex"), F.max("depth").alias("max_depth"), F.sum(F.length("text")).alias("text_chars"),
    )


def synthetic_site(spark: SparkSession, total: int, branching: int = 6, host: str = "https://site.example") -> DataFrame:
    """A tree of pages with URL variants, for testing crawls: page i links to its children, spelled in several ways, and to itself."""
    i = F.col("id")
    child = F.transform(F.sequence(F.lit(1), F.lit(branching)), lambda k: i * branching + k)
    links = F.transform(
        F.filter(child, lambda c: c < total), lambda c: F.concat(F.lit('<a href="'), F.lit(host), F.lit("/p/"), c.cast("string"), F.when(c % 3 == 0, "/?utm_source=x").when(c % 3 == 1, "#top").otherwise(""), F.lit('">x</a>'))
    )
    url = F.concat(F.lit(host), F.when(i == 0, "/").otherwise(F.concat(F.lit("/p/"), i.cast("string"))))
    text = F.concat(F.lit("<p>Text of page "), F.when((i > 0) & (i % 10 == 0), i - 1).otherwise(i).cast("string"), F.lit("</p>"))
    html = F.concat(F.lit("<html><head><title>T"), i.cast("string"), F.lit("</title></head><body>"), text, F.lit("<nav>"), F.array_join(links, ""), F.lit("</nav></body></html>"))
    return spark.range(total).select(F.col("id").alias("page_id"), url.alias("url"), html.alias("html"))
