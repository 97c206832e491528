"""Queries of ingest: pages, office files, chunks, crawls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import robots as rb
from tessella.functions import text as x
from tessella.functions import urls as u
from tessella.operators import chunking, crawl
from tessella.operators import reindex as ri
from tessella.plans.registry import query
from tessella.session import shared_folder
from tessella.sources import standin as t
from tessella.sources.web import read_web_pages


@query("s06_html_pages")
def html_pages(spark: SparkSession, d: str) -> DataFrame:
    """Also S22, F23, X34 and X35: parsed once, used for text, directives and links."""
    parsed = read_web_pages(t.table(spark, d, "pages"))
    return parsed.select("page_id", "title", "text", "noindex", "nofollow", F.size("links").alias("n_links"), F.size("variants").alias("n_variants"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    page = F.struct(F.lit(1).alias("page"), F.col("text"))
    return t.table(spark, d, "documents").select("doc_id", F.col("source").alias("title"), F.array(page).alias("pages"))


@query("c01_chunks")
def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Also W04 and S25."""
    return chunking.chunk_documents(_documents(spark, d))


@query("s19_chunk_terms")
def chunk_terms(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with their terms, as the chunk sink writes them."""
    found = chunking.chunk_documents(_documents(spark, d)).select("doc_id", "ord", x.terms(F.col("text")).alias("terms"))
    return found.select("doc_id", "ord", F.size("terms").alias("n_terms"), F.size(F.array_distinct("terms")).alias("distinct_terms"))


def _crawled(spark: SparkSession, d: str) -> DataFrame:
    """All hosts of the pages table, each from its page of least ID, and beside them a generated site of 300 pages whose links lead somewhere."""
    pages = t.table(spark, d, "pages").select("page_id", "url", "html")
    host = u.authority(u.clean_url(F.col("url")))
    starts = pages.where(F.col("url").isNotNull()).groupBy(host.alias("site")).agg(F.min_by("url", "page_id").alias("url")).where("site IS NOT NULL")
    site = "https://site.example/"
    starts = starts.unionByName(spark.range(1).select(F.lit(site).alias("site"), F.lit(site).alias("url")))
    return crawl.crawl_sites(pages.unionByName(crawl.synthetic_site(spark, 300)), starts)


@query("s08_crawl")
def crawled(spark: SparkSession, d: str) -> DataFrame:
    """Also S09, S26, U04."""
    return _crawled(spark, d).select("site", "key", "title", "depth", "state")


#: robots.txt of a host, by the length of its name.
ROBOTS = (None, "User-agent: *\nDisallow: /\nAllow: /en/\nDisallow: /en/*?\nCrawl-delay: 2", "User-agent: nobody\nDisallow: /\n\nUser-agent: *\nDisallow: /*.html$\nDisallow: /fr")


@query("s09_robots", r"""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)) AS site, regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^#]*)', 1) AS path FROM pages WHERE url IS NOT NULL)
SELECT page_id, CASE length(site) % 3 WHEN 0 THEN true WHEN 1 THEN starts_with(path, '/en/') AND NOT contains(path, '?') ELSE NOT ends_with(path, '.html') AND NOT starts_with(path, '/fr') END AS allowed,
  (row_number() OVER (PARTITION BY site ORDER BY page_id) - 1) * CASE length(site) % 3 WHEN 1 THEN 2 ELSE 0.5::DOUBLE END AS starts_at FROM p""")
def robots_rules(spark: SparkSession, d: str) -> DataFrame:
    """Which pages robots.txt of their hosts allows, and when each could be fetched: groups, wildcards, ends, the longest match, delays."""
    url = F.col("url")
    urls = t.table(spark, d, "pages").where(url.isNotNull()).select("page_id", F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]+)", 1)).alias("site"), F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+([^#]*)", 1).alias("path"))
    files = urls.select("site").distinct().withColumn("robots", F.element_at(F.array(*map(F.lit, ROBOTS)), (F.length("site") % 3 + 1).cast("int")))
    rules = rb.rules_for(files, "reader")
    return rb.fetch_times(rb.allowed(urls, rules), rules, "page_id", pause=0.5).select("page_id", "allowed", "starts_at")


@query("a23_crawl_stats")
def crawl_stats(spark: SparkSession, d: str) -> DataFrame:
    return crawl.crawl_stats(_crawled(spark, d))


@query("u31_replace_titles", "SELECT doc_id, replace(text, 'the', 'THE') AS text FROM documents WHERE contains(text, 'the')")
def replace_titles(spark: SparkSession, d: str) -> DataFrame:
    """Also R15: a string replaced in the chunks that have it."""
    docs = t.table(spark, d, "documents").where(F.col("text").contains("the"))
    return docs.select("doc_id", F.replace("text", F.lit("the"), F.lit("THE")).alias("text"))


@query("r15_reindex", """
WITH first AS (SELECT doc_id, 'https://kb.test/' || doc_id AS url, sha1(coalesce(source, '') || chr(10) || coalesce(text, '')) AS hash FROM documents WHERE doc_id % 11 <> 0),
second AS (SELECT doc_id, 'https://kb.test/' || doc_id AS url, sha1(coalesce(source, '') || chr(10) || coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN ' v2' ELSE '' END) AS hash FROM documents WHERE doc_id % 7 <> 0)
SELECT coalesce(s.url, f.url) AS url, coalesce(s.doc_id, f.doc_id) AS document_id, coalesce(s.hash, f.hash) AS hash, CASE WHEN s.hash = f.hash THEN 1 ELSE 2 END AS version, s.hash IS NOT NULL AS live
FROM first f FULL OUTER JOIN second s USING (url)""")
def reindexed(spark: SparkSession, d: str) -> DataFrame:
    """Also S22: a site in three snapshots, of which the second has documents changed, new and gone, and the third is the second; what the index says of each document."""
    docs = t.table(spark, d, "documents").select(
        F.concat(F.lit("https://kb.test/"), F.col("doc_id").cast("string")).alias("url"), F.col("source").alias("title"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").alias("document_id")
    )
    i = F.col("document_id")
    second = docs.where(i % 7 != 0).withColumn("text", F.concat("text", F.when(i % 5 == 0, " v2").otherwise("")))
    index = ri.document_index(spark, shared_folder(spark), buckets=8)
    for version, snapshot in ((1, docs.where(i % 11 != 0)), (2, second), (3, second)):
        ri.reindex(index, snapshot, version)
    return index.read().select("url", "document_id", "hash", "version", "live")


@query("s07_dispatch", "SELECT page_id, CASE WHEN regexp_matches(lower(url), '\\.html?($|[?#])') THEN 'html' WHEN regexp_matches(lower(url), '\\.(docx|xlsx|pdf)($|[?#])') THEN 'file' ELSE 'web' END AS kind FROM pages")
def dispatch(spark: SparkSession, d: str) -> DataFrame:
    c = F.lower("url")
    return t.table(spark, d, "pages").select("page_id", F.when(c.rlike(r"\.html?($|[?#])"), "html").when(c.rlike(r"\.(docx|xlsx|pdf)($|[?#])"), "file").otherwise("web").alias("kind"))
