"""Rules of robots.txt as tables: groups by agent, longest match with wildcards, Crawl-delay, and the times at which pages may be fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A file beyond this is read up to here, as crawlers do.
MAX_BYTES = 512_000
#: A longer delay counts as this many seconds.
LONGEST_DELAY = 3600.0


def _lines(files: DataFrame) -> DataFrame:
    """``site, n, field, value`` of the lines that say something, in order."""
    line = F.regexp_replace("line", r"#.*$", "")
    rows = files.select("site", F.posexplode(F.split(F.substring("robots", 1, MAX_BYTES), r"\r\n|\r|\n")).alias("n", "line"))
    field = F.lower(F.trim(F.regexp_extract(line, r"^[\s\x{FEFF}]*([A-Za-z-]+)\s*:", 1)))
    value = F.trim(F.regexp_replace(F.regexp_extract(line, r"^[^:]*:(.*)$", 1), r"\s+", " "))
    return rows.select("site", "n", field.alias("field"), value.alias("value")).where(F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay"))


def rules_for(files: DataFrame, agent: str) -> DataFrame:
    """``site, allow, pattern, delay`` for ``agent`` out of ``files`` (``site``, ``robots``): rules, and a row with the delay alone where there is one.

    Agents that follow each other share the rules after them. Of the groups
    those count whose agent is the longest that the name of ours begins with,
    in any case; else those of ``*``. An empty ``Disallow`` says nothing. A site without a
    file, with a null or one that can't be read has no rules, and so allows all.
    """
    order = Window.partitionBy("site").orderBy("n")  # the lines of one file
    lines = _lines(files).withColumn("names", F.col("field") == "user-agent")
    opens = F.col("names") & ~F.coalesce(F.lag("names").over(order), F.lit(False))
    lines = lines.withColumn("part", F.sum(opens.cast("int")).over(order)).where("part > 0")
    named = F.lower(F.regexp_replace("value", r"[/ ].*$", ""))
    fits = F.when(F.col("value") == "*", 0).when((named != "") & F.startswith(F.lit(agent.lower()), named), F.length(named))
    groups = lines.where("names").select("site", "part", fits.alias("fit")).where("fit IS NOT NULL")
    best = groups.groupBy("site").agg(F.max("fit").alias("fit"))
    chosen = groups.join(best, ["site", "fit"]).select("site", "part").distinct()
    said = lines.where("NOT names AND value <> ''").join(chosen, ["site", "part"])
    delay = F.when(F.col("field") == "crawl-delay", F.least(F.greatest(F.expr("try_cast(value AS double)"), F.lit(0.0)), F.lit(LONGEST_DELAY)))
    rule = F.col("field") != "crawl-delay"
    return said.select("site", F.when(rule, F.col("field") == "allow").alias("allow"), F.when(rule, F.col("value")).alias("pattern"), delay.alias("delay")).where("pattern IS NOT NULL OR delay IS NOT NULL")


def _literal(pattern: Column) -> Column:
    """What a pattern begins with before its first wildcard."""
    return F.regexp_extract(pattern, r"^([^*$]*)", 1)


def _as_regex(pattern: Column) -> Column:
    """``*`` is anything, ``$`` at the end is the end, all else stands for itself."""
    body = F.regexp_replace(F.regexp_replace(pattern, r"\$$", ""), r"([\\.\[\]{}()+?^$|])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.regexp_replace(body, r"\*+", ".*"), F.when(F.endswith(pattern, F.lit("$")), "$").otherwise(""))


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (``site``, ``path`` with the query, and others) with ``allowed``: the longest pattern that matches decides, allowing ones win ties, no match allows.

    Patterns are found by an equality of what they begin with: each path meets only
    the lengths of its site's literal beginnings, so that neither a site's rules meet all of its
    paths nor a path all rules. A null path is allowed.
    """
    patterns = rules.where("pattern IS NOT NULL").select("site", "allow", "pattern", _literal(F.col("pattern")).alias("literal")).distinct()
    lengths = patterns.groupBy("site").agg(F.collect_set(F.length("literal")).alias("lengths"))  # of one file's rules
    asked = urls.select("site", "path").distinct().where("path IS NOT NULL")
    tried = asked.join(lengths, "site").select("site", "path", F.explode("lengths").alias("n")).where(F.col("n") <= F.length("path"))
    met = tried.select("site", "path", F.left("path", F.col("n")).alias("literal")).join(patterns, ["site", "literal"])
    met = met.where(F.regexp_like("path", _as_regex(F.col("pattern"))))
    verdict = met.groupBy("site", "path").agg(F.max(F.struct(F.length("pattern").alias("n"), "allow")).alias("best"))
    found = verdict.select("site", "path", F.col("best.allow").alias("rule_allows"))
    return urls.join(found, ["site", "path"], "left").withColumn("allowed", F.coalesce("rule_allows", F.lit(True))).drop("rule_allows")


def fetch_times(urls: DataFrame, rules: DataFrame, order: str, pause: float = 0.0) -> DataFrame:
    """``urls`` with ``starts_at``: seconds after the first fetch of their site, so that two fetches of a site are its delay (or ``pause`` if that is more) apart, in ``order``."""
    delays = rules.where("delay IS NOT NULL").groupBy("site").agg(F.max("delay").alias("delay"))
    mine = Window.partitionBy("site").orderBy(order)
    timed = urls.join(delays, "site", "left").withColumn("gap", F.greatest(F.coalesce("delay", F.lit(0.0)), F.lit(pause)))
    before = F.coalesce(F.sum("gap").over(mine.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return timed.withColumn("starts_at", F.round(before, 3)).drop("delay", "gap")
