"""URL rules by two sort-merge range joins, over reversed hosts and over paths.

A host is written with its labels reversed (``com.example.blog.``), so a rule's
host and all its subdomains are one interval of keys, and intervals are nested
or apart. Rule hosts give sorted marks: where an interval begins, the stack of
rule hosts open from there on; where it ends, the stack of the interval around
it. Pages and marks are sorted together and every page takes the stack of the
last mark at or before it: the rule hosts around it, at most one per label.

Under each of those hosts the page's path is swept in the same way. A rule's
path and all paths that it starts are one interval, so the innermost open rule
is the host's longest that fits: a mark carries that one rule, not a list, and
a host may have any number of rules. The longest over a page's hosts wins.

At scale: a sweep runs per (registered domain, salt), or per (rule host, salt)
for paths. Marks are copied to each salt, of which there is one per
``ROWS_PER_SWEEP`` pages (counted beforehand), so a host with a third of all
pages is swept by many tasks; rules on a bare top level open at the first mark
of each sweep. Only page ids and urls are read, and pages under no rule host
are not swept twice. Plain DataFrame operations.

Defined results: null urls and urls without ``://`` have empty host and path
and fit no rule; without a rule the verdict is ``default``; rules with null or
empty hosts fit nothing, a null rule path counts as empty; of rules with the
same host and path ``block`` wins; repeated pages stay, with null ids too; empty
tables are fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqwise.llm.common import ascii_lower, materialize, write_once

# Host, path and action of the production rules.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DEFAULT_VERDICT = "allow"
ROWS_PER_SWEEP = 1_000_000  # pages of one domain swept by one task

_URL = "(?s)^.*?://([^/?#]*)(/[^?#]*)?"
_END = "\U0010FFFF"  # above every label


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, action string")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def url_path(url: Column) -> Column:
    """From the ``/`` after the host up to ``? #`` or the end."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def reversed_host(host: Column) -> Column:
    """``blog.example.com`` -> ``com.example.blog.`` (closed by a dot, so a
    host's key is a prefix of exactly its subdomains' keys)."""
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def _domain(key: Column) -> Column:
    """First two labels of a reversed host: the unit that is swept."""
    return F.substring_index(key, ".", 2)


def _clean(rules: DataFrame) -> DataFrame:
    """One row per (host, path): key (reversed host) and the rule as the struct
    by which rules are compared."""
    r = (rules.where("host is not null and host <> ''")
         .select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action"))
    r = r.groupBy("host", "path").agg(F.max("action").alias("action"))  # 'block' > 'allow'
    return r.select(reversed_host(F.col("host")).alias("key"), "path", F.struct(
        (F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"),
        F.concat("host", "path").alias("rule"), "action").alias("best"))


def host_stacks(hosts: DataFrame) -> DataFrame:
    """(key, stack): a rule host and the rule hosts around it and itself, at
    most one per label (an equi-join of each host with its suffixes)."""
    labels = F.size(F.split("key", "\\.")) - 1
    around = hosts.select("key", F.explode(F.sequence(F.lit(1), labels)).alias("_n")).select(
        "key", F.expr("substring_index(key, '.', _n) || '.'").alias("_at"))
    return around.join(hosts.select(F.col("key").alias("_at")), "_at").groupBy("key").agg(
        F.collect_list("_at").alias("stack"))


def host_marks(stacks: DataFrame) -> DataFrame:
    """Sorted marks (key, edge, stack): an interval opens with its own stack
    and, at its end, leaves the stack of the nearest interval around it."""
    opens = stacks.select("key", F.lit(0).alias("edge"), "stack")
    empty = F.array().cast("array<string>")
    labels = F.size(F.split("key", "\\.")) - 1
    outer = stacks.select("key", F.explode(F.sequence(F.lit(0), labels - 1)).alias("_n")).select(
        "key", "_n", F.expr("substring_index(key, '.', _n) || '.'").alias("_at"))
    left = (outer.join(stacks.select(F.col("key").alias("_at"), F.col("stack").alias("_outer")), "_at", "left")
            .groupBy("key").agg(F.max_by("_outer", F.when(F.col("_outer").isNotNull(), F.col("_n"))).alias("_outer")))
    ends = left.select(F.concat("key", F.lit(_END)).alias("key"), F.lit(1).alias("edge"),
                       F.coalesce("_outer", empty).alias("stack"))
    return opens.unionByName(ends)


def path_marks(clean: DataFrame) -> DataFrame:
    """Sorted marks (rule host, path key, best): a rule's interval of paths
    opens with the rule and leaves the longest rule around it, if there is one
    (an equi-join of each path with the beginnings of it that are rules)."""
    opens = clean.select("key", _path_key(F.col("path")).alias("at"), F.lit(0).alias("edge"), "best")
    starts = clean.where(F.length("path") > 0).select("key", "path", F.explode(
        F.sequence(F.lit(0), F.length("path") - 1)).alias("_n"))
    starts = starts.select("key", "path", "_n", F.expr("substring(path, 1, _n)").alias("_start"))
    around = (starts.join(clean.select("key", F.col("path").alias("_start"), F.col("best").alias("_outer")),
                          ["key", "_start"])
              .groupBy("key", "path").agg(F.max_by("_outer", "_n").alias("_outer")))
    ends = clean.join(around, ["key", "path"], "left").select(
        "key", F.concat(_path_key(F.col("path")), F.unhex(F.lit("FF"))).alias("at"), F.lit(1).alias("edge"),
        F.col("_outer").alias("best"))
    return opens.unionByName(ends)


def _path_key(path: Column) -> Column:
    """UTF-8 bytes, which compare unsigned; 0xFF is above every one of them."""
    return F.encode(path, "UTF-8")


def _salts(count: Column, rows_per_sweep: int) -> Column:
    return F.ceil(count / F.lit(rows_per_sweep)).cast("int")


def _each_salt(marks: DataFrame) -> DataFrame:
    return marks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")


def _salt_of_page() -> Column:
    # A page's salt needs no lookup: it is spread over as many salts as the
    # narrow count table says.
    return F.pmod(F.xxhash64("page_id", "path"), F.col("_salts")).cast("int")


def _hosts_of_pages(p: DataFrame, hosts: DataFrame, rows_per_sweep: int) -> DataFrame:
    """``p`` with ``_hosts``, the rule hosts around each page's host."""
    sweeps = materialize(p.groupBy("_domain").count().select(
        "_domain", _salts(F.col("count"), rows_per_sweep).alias("_salts")))
    stacks = materialize(host_stacks(hosts))
    empty = F.array().cast("array<string>")
    single = stacks.where(F.size(F.split("key", "\\.")) == 2).select(
        F.regexp_replace("key", "\\.$", "").alias("_top"), "stack")
    first = (sweeps.withColumn("_top", F.substring_index("_domain", ".", 1)).join(single, "_top", "left")
             .select("_domain", "_salts", F.lit("").alias("key"), F.lit(0).alias("edge"),
                     F.coalesce("stack", empty).alias("stack")))
    inside = (host_marks(stacks).where(F.size(F.split("key", "\\.")) > 2)
              .withColumn("_domain", _domain(F.col("key"))).join(sweeps, "_domain")
              .select("_domain", "_salts", "key", "edge", "stack"))
    marks = _each_salt(first.unionByName(inside)).withColumn("_mark", F.lit(True))
    rows = (p.join(sweeps, "_domain").withColumn("_salt", _salt_of_page()).drop("_salts")
            .withColumn("edge", F.lit(2)).withColumn("_mark", F.lit(False)))
    sweep = (Window.partitionBy("_domain", "_salt").orderBy("key", "edge")
             .rowsBetween(Window.unboundedPreceding, 0))
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn(
        "_hosts", F.last("stack", ignorenulls=True).over(sweep))
    return both.where("not _mark").select("page_id", "host", "path", "_hosts")


def _rules_of_pages(under: DataFrame, marks: DataFrame, rows_per_sweep: int) -> DataFrame:
    """Per row of ``under`` (a page under one rule host, ``key``): the host's
    longest rule that fits its path, as ``best``."""
    sweeps = materialize(under.groupBy("key").count().select(
        "key", _salts(F.col("count"), rows_per_sweep).alias("_salts")))
    marks = _each_salt(marks.join(sweeps, "key")).withColumn("_mark", F.lit(True))
    rows = (under.join(sweeps, "key").withColumn("_salt", _salt_of_page()).drop("_salts")
            .withColumn("at", _path_key(F.col("path"))).withColumn("edge", F.lit(2)).withColumn("_mark", F.lit(False)))
    sweep = (Window.partitionBy("key", "_salt").orderBy("at", "edge")
             .rowsBetween(Window.unboundedPreceding, 0))
    # a mark without a rule closes the last one, so nulls of marks count: they
    # are wrapped, and only pages are skipped
    wrapped = F.when(F.col("_mark"), F.struct(F.col("best").alias("best")))
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn(
        "_last", F.last(wrapped, ignorenulls=True).over(sweep))
    return both.where("not _mark").select("_row", F.col("_last.best").alias("best"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = DEFAULT_VERDICT, rows_per_sweep: int = ROWS_PER_SWEEP) -> DataFrame:
    """Per page: page_id, host, path, rule (host + path of the rule that fits,
    else null) and verdict (the rule's, else ``default``)."""
    p = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"),
                     url_path(F.col(url_col)).alias("path"))
    p = p.withColumn("key", reversed_host(F.col("host"))).withColumn("_domain", _domain(F.col("key")))
    clean = materialize(_clean(rules))
    met = _hosts_of_pages(p, clean.select("key").distinct(), rows_per_sweep)
    # written once: rows are told apart by a number that has to stay the same
    met = write_once(met.withColumn("_row", F.monotonically_increasing_id()), "hosts-of-pages")
    under = met.where(F.size("_hosts") > 0).select("_row", "page_id", "path", F.explode("_hosts").alias("key"))
    found = _rules_of_pages(under, path_marks(clean), rows_per_sweep)
    best = found.where("best is not null").groupBy("_row").agg(F.max("best").alias("best"))
    return met.join(best, "_row", "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"))
