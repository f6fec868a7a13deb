"""URL rules as a sort-merge range join.

A host turned around label by label (``example.net`` -> ``net.example.``) makes
"this host and its subdomains" one interval of keys: from the reversed host up
to the same text with its last ``.`` replaced by the next character, ``/``.  In
the same way a path and all that it is a prefix of is the interval of bytes
from the path up to the path and a byte 255, which UTF-8 doesn't use.  Such
intervals nest or are disjoint.

Two sweeps follow.  In the first, hosts of rules and of URLs are sorted together
by key; what is carried along is the stack of the rules' hosts whose interval is
open, and every URL takes the stack that it meets.  In the second, a URL is
sorted by path among the rules of each of these hosts; what is carried along is
the top of the stack of open paths, the longest that fits.  The longest of all
wins.

Everything is DataFrame operations.  Keys are parted into ranges, and the URLs
of a range or host evenly into as many lanes as their number asks for, each with
the rules' boundaries of that range or host alone, so a hot host costs no lane
more than any other and rules meet only where there are URLs for them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import parallelism

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Boundaries of rules' hosts in a range of keys, and the most ranges.
RANGE_ROWS, RANGES = 5_000, 200

#: (verdict, host, path) of the rules that the registered query applies.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    after = url.substr(F.length(rest) + 4, F.length(url))
    return F.coalesce(F.translate(F.regexp_extract(after, r"\A([^/?#]*)", 1), _UPPER, _UPPER.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    after = url.substr(F.length(rest) + 4, F.length(url))
    return F.coalesce(F.regexp_extract(after, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """The host's labels from last to first, each followed by ``.``."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Rules as a DataFrame ``verdict, host, path``."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def clean_rules(rules: DataFrame) -> DataFrame:
    """Whole rules, once each, hosts in lower case; of a block and an allow for the same host and path the block."""
    whole = rules.where("host is not null and path is not null and verdict is not null")
    return whole.groupBy(F.translate("host", _UPPER, _UPPER.lower()).alias("host"), "path").agg(F.max("verdict").alias("verdict"))


def host_boundaries(rules: DataFrame) -> DataFrame:
    """``key, stack``: where the set of open host intervals changes, and the rules' hosts that are open from there on.

    The stack at a host's start is the host and those parent domains that have
    rules; at its end the parents alone.  Parents are found by an equi-join on
    the host's suffixes, so the cost is hosts times labels.
    """
    hosts = rules.select("host").distinct()
    labels = F.split(F.col("host"), r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    up = hosts.select("host", F.explode(suffix).alias("parent")).join(hosts.select(F.col("host").alias("parent")), "parent")
    stacks = up.groupBy("host").agg(F.collect_list("parent").alias("inside"))
    key = host_key(F.col("host"))
    starts = stacks.select(key.alias("key"), F.col("inside").alias("stack"))
    ends = stacks.select(F.concat(F.regexp_replace(key, r"\.\z", ""), F.lit("/")).alias("key"), F.array_remove("inside", F.col("host")).alias("stack"))
    return starts.unionByName(ends)


def path_boundaries(rules: DataFrame) -> DataFrame:
    """``rule_host, key, top``: where the longest open path of a host's rules changes, and that path with its verdict from there on.

    At a path's end it is the longest shorter rule path that the path begins
    with, found by an equi-join on the prefixes of lengths that the host has.
    """
    paths = rules.select(F.col("host").alias("rule_host"), "path", "verdict")
    lengths = paths.groupBy("rule_host").agg(F.collect_set(F.length("path")).alias("lengths"))
    shorter = paths.join(lengths, "rule_host").select("rule_host", "path", F.explode(F.filter("lengths", lambda n: n < F.length("path"))).alias("n"))
    shorter = shorter.select("rule_host", "path", F.expr("substring(path, 1, n)").alias("outer"))
    outer = paths.select("rule_host", F.col("path").alias("outer"), F.struct(F.length("path").alias("n"), F.col("path").alias("path"), F.col("verdict").alias("verdict")).alias("found"))
    parents = shorter.join(outer, ["rule_host", "outer"]).groupBy("rule_host", "path").agg(F.max("found").alias("up"))
    raw = F.col("path").cast("binary")
    starts = paths.select("rule_host", raw.alias("key"), F.struct("path", "verdict").alias("top"))
    ends = paths.join(parents, ["rule_host", "path"], "left").select("rule_host", F.concat(raw, F.unhex(F.lit("FF"))).alias("key"), F.struct(F.col("up.path").alias("path"), F.col("up.verdict").alias("verdict")).alias("top"))
    return starts.unionByName(ends)


def _met_hosts(urls: DataFrame, rules: DataFrame, lanes: int) -> tuple[DataFrame, int]:
    """``urls`` (with a column ``key``) with the ``stack`` of rules' hosts that each one's host lies in, and the URLs that a lane should have."""
    spark = urls.sparkSession
    marks = host_boundaries(rules)
    ranges = min(RANGES, marks.count() // RANGE_ROWS)
    # bounds from the keys of the smallest hashes; they decide about balance alone
    some = sorted(r["key"] for r in marks.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(20 * ranges).collect()) if ranges else []
    bounds = some[19::20]
    place = (lambda key: F.size(F.filter(F.lit(bounds), lambda b: b <= key))) if bounds else (lambda key: F.lit(0))
    urls, marks = urls.withColumn("range", place(F.col("key"))), marks.withColumn("range", place(F.col("key")))
    counts = {r["range"]: r["n"] for r in urls.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()}
    each = max(1, sum(counts.values()) // lanes)
    salts = F.lit([-(-counts.get(k, 0) // each) for k in range(len(bounds) + 1)])
    share = F.element_at(salts, F.col("range") + 1)
    # the stack with which a range begins is the last one before it
    last = {r["range"]: r["stack"] for r in marks.groupBy("range").agg(F.max_by("stack", "key").alias("stack")).collect()}
    begin, open_ = [], []
    for k in range(len(bounds) + 1):
        begin.append((k, open_))
        open_ = last.get(k, open_)
    first = spark.createDataFrame(begin, "range int, stack array<string>").select("range", F.lit("").alias("key"), "stack")
    marks = first.unionByName(marks.select("range", "key", "stack")).select("range", F.explode(F.sequence(F.lit(0), share - 1)).alias("lane"), "key", F.lit(0).alias("kind"), "stack") if counts else first.select("range", F.lit(0).alias("lane"), "key", F.lit(0).alias("kind"), "stack")
    dealt = urls.withColumn("lane", F.pmod(F.xxhash64("row"), F.greatest(share, F.lit(1))).cast("int")).withColumn("kind", F.lit(1))
    sweep = Window.partitionBy("range", "lane").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.unionByName(marks, allowMissingColumns=True).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1").drop("kind", "lane", "range", "key"), each


def judge_urls(pages: DataFrame, rules: DataFrame, *, key: str = "page_id", url: str = "url", otherwise: str = "allow", lanes: int | None = None) -> DataFrame:
    """Host, path, winning rule and verdict of every row of ``pages``.

    The longest rule (host and path together) wins; of equally long ones the
    longer host, then ``block``.  Rows that no rule fits get ``otherwise`` and a
    null rule; so do null URLs and URLs without ``://``, whose host and path are
    empty.  Repeated rows are judged separately, null keys are kept, further
    columns of ``pages`` are ignored.
    """
    lanes = lanes or parallelism(pages.sparkSession)
    link = F.col(f"`{url}`")
    urls = pages.select(F.col(f"`{key}`").alias("id"), url_host(link).alias("host"), url_path(link).alias("path")).withColumn("row", F.monotonically_increasing_id())
    one = clean_rules(rules)
    met, each = _met_hosts(urls.withColumn("key", host_key(F.col("host"))), one, lanes)
    asked = met.withColumn("rule_host", F.explode_outer("stack")).drop("stack")
    # a host's URLs go to as many lanes as their number asks for, its rules to each of them
    counts = asked.groupBy("rule_host").agg(F.count(F.lit(1)).alias("n"))
    lanes_of = counts.select("rule_host", F.ceil(F.col("n") / each).cast("int").alias("lanes"))
    marks = path_boundaries(one).join(lanes_of, "rule_host").select("rule_host", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"), "key", F.lit(0).alias("kind"), "top")
    dealt = asked.join(lanes_of, "rule_host", "left").withColumn("lane", F.pmod(F.xxhash64("row"), F.coalesce("lanes", F.lit(lanes))).cast("int"))
    dealt = dealt.withColumn("key", F.col("path").cast("binary")).withColumn("kind", F.lit(1)).drop("lanes")
    sweep = Window.partitionBy("rule_host", "lane").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = dealt.unionByName(marks, allowMissingColumns=True).withColumn("top", F.last("top", ignorenulls=True).over(sweep)).where("kind = 1")
    rule = F.concat("rule_host", F.col("top.path"))
    fit = F.when(rule.isNotNull(), F.struct(F.length(rule).alias("size"), F.length("rule_host").alias("depth"), F.col("top.verdict").alias("verdict"), rule.alias("rule")))
    best = swept.groupBy("row", "id", "host", "path").agg(F.max(fit).alias("best"))
    return best.select(F.col("id").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))


SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), named AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), judged AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM named
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
"""
