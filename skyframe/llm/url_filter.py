"""URL filters by a sort-merge range join of urls with nested host and path rules; DataFrame functions only.

A host is written label by label from its end (`a.example.net` -> `net.example.a.`), so a host and all its subdomains
are the keys with one prefix, an interval of the sorted keys; a rule's path is such a prefix too. Intervals of prefixes
are nested or apart. The sweep sorts urls and starts of intervals together. Each start carries the stack of intervals
that are open there, outermost first, and the url takes the stack of the last start before it and pops what does not
reach as far as its own key. Starts need no ends: every interval that holds a key was open at the last start before it.

Two sweeps: hosts first, which gives the rule hosts of a url; then the path in the interval of each of them. Keys are
dealt by range with the row's number as the last part of the key, so a hot host is spread over tasks; a range begins
with the stack at the last start of the ranges before it, one row for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyframe.llm.common import staged

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to `?`, `#` or the end.
    Null or without `://`: both empty."""
    text = url.cast("string")
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _CAPITALS, _SMALL), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """`a.example.net` -> `net.example.a.`: a host and its subdomains are the keys that begin with the host's key."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _with_stacks(prefixes: DataFrame) -> DataFrame:
    """(site, key, about), one row a key -> (key, stack of (key, about)): the prefixes of the same site that hold the key, itself last.

    A key's holders are among its cuts at the lengths that keys of its site have; there are no more of these than the
    longest key has characters.
    """
    lengths = prefixes.groupBy("site").agg(F.collect_set(F.length("key")).alias("lengths")).withColumnRenamed("site", "site_of")
    of_site = prefixes.join(lengths.hint("merge"), F.col("site") == F.col("site_of")).select("site", "key", "lengths")
    fit = F.filter("lengths", lambda n: n <= F.length("key"))
    cuts = of_site.select("site", F.col("key").alias("inner"), F.explode(F.transform(fit, lambda n: F.substring(F.col("key"), F.lit(1), n))).alias("cut"))
    held = prefixes.select(F.col("site").alias("site_of"), "key", "about").hint("merge")
    met = cuts.join(held, (F.col("site") == F.col("site_of")) & (F.col("cut") == F.col("key")))
    return met.groupBy("inner").agg(F.sort_array(F.collect_list(F.struct("key", "about"))).alias("stack")).withColumnRenamed("inner", "key")


def _swept(points: DataFrame, prefixes: DataFrame, label: str) -> DataFrame:
    """points (uid, key) with `stack`: the prefixes (key, stack) that begin their key, outermost first; none: an empty stack."""
    starts = prefixes.select(F.lit(None).cast("long").alias("uid"), "key", F.lit(0).alias("is_point"), "stack")
    kind = starts.schema["stack"].dataType
    rows = points.select("uid", "key", F.lit(1).alias("is_point"), F.lit(None).cast(kind).alias("stack")).unionByName(starts)
    ranges = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(rows.repartitionByRange(ranges, "key", "is_point", "uid").withColumn("part", F.spark_partition_id()), label)
    ends = dealt.groupBy("part").agg(F.max(F.when(F.col("is_point") == 0, F.struct("key", "stack"))).alias("end"))
    before = F.last("end", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select(F.col("part").alias("part_of"), before["stack"].alias("carried"))
    sweep = Window.partitionBy("part").orderBy("key", "is_point", "uid").rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).filter("is_point = 1")
    swept = swept.join(F.broadcast(carried), F.col("part") == F.col("part_of"), "left")
    stack = F.filter(F.coalesce("open", "carried", F.array().cast(kind)), lambda x: F.startswith(F.col("key"), x["key"]))
    return swept.select("uid", "key", stack.alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id_col, host, path, rule, verdict), one row for each row of pages.

    rules: (host, path, verdict). A rule fits urls of its host and all subdomains whose path starts with the rule's; of
    those that fit, the one with the longest text (host + path) decides, then the one with the longer host. A url that
    no rule fits gets a null rule and `default`. A rule named twice with two verdicts blocks. A null path of a rule
    reads as empty (it fits every path), rules with a null host or verdict take no part. Null urls and urls without
    `://` have an empty host and path. Null and repeated ids keep a row each, other columns of pages are not read.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).withColumn("uid", F.monotonically_increasing_id())
    rows = staged(rows.withColumn("key", host_key(F.col("host"))), "urls")
    known = rules.filter(F.col("host").isNotNull() & F.col("verdict").isNotNull())
    known = known.select(F.translate("host", _CAPITALS, _SMALL).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict")
    known = known.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict")).withColumn("site", host_key(F.col("rule_host")))

    # the hosts that hold another share its last label, so that label is the site of the first sweep
    hosts = known.select(F.substring_index("site", ".", 1).alias("site"), F.col("site").alias("key")).distinct().withColumn("about", F.lit(None).cast("string"))
    in_hosts = _swept(rows, _with_stacks(hosts), "hosts").filter(F.size("stack") > 0).select("uid", F.explode("stack.key").alias("site"))

    # `#` is in no host, so the prefixes of two sites never hold each other
    inside = lambda path: F.concat("site", F.lit("#"), path)
    length = F.length("rule_host") + F.length("rule_path")
    about = F.struct(length.alias("n"), F.length("rule_host").alias("n_host"), F.concat("rule_host", "rule_path").alias("rule"), "verdict")
    paths = known.select("site", inside("rule_path").alias("key"), about.alias("about"))
    points = in_hosts.join(rows.select(F.col("uid").alias("uid_of"), "path").hint("merge"), F.col("uid") == F.col("uid_of"))
    in_paths = _swept(points.select("uid", inside("path").alias("key")), _with_stacks(paths), "paths").filter(F.size("stack") > 0)
    best = in_paths.groupBy("uid").agg(F.max(F.element_at("stack", -1)["about"]).alias("best")).withColumnRenamed("uid", "uid_of")
    judged = rows.join(best.hint("merge"), F.col("uid") == F.col("uid_of"), "left")
    return judged.select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
