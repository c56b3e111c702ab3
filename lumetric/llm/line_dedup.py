"""Line dedup by site-relative frequency.

Pages are grouped by host. The share of a host's pages that contain a line is
its relative frequency there; lines above a boilerplate ratio (and on a least
number of pages) are dropped from all pages of that host, wherever they stand.

Scale: a line travels as 16 bytes of hash, counted map-side first, so the
shuffle holds one small row for each distinct line of a host, not the text.
A page's own repeats go through a hash set, so one page of very many lines costs
time in proportion to them. A host has at most (mean lines of its pages) / ratio
such lines; its drop list is sorted and searched by halving. The lists are broadcast if their counted number is
within BROADCAST_LINES; beyond it they are joined by host, as two stored tables
whose large partitions adaptive execution splits, so a hot host isn't one task.

Everything on the main path is DataFrame functions.

least_pages guards small hosts: on a host of one page every line is on all of
its pages. 1 switches it off, and leaves the ratio alone.

Defined results
    null text          stays null, no lines
    empty text         stays empty (one line, without a word: never dropped)
    null host          its own group
    repeated rows      each is a page of its own
    lines without a word are never dropped
    a text of dropped lines only becomes empty; the row stays
    ties               a line at exactly the ratio stays
    empty table        empty result
    other columns      ignored, or carried along by clean()
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, read, shared_table, take
from .quality_rules import without

#: A line on more than this share of a host's pages is boilerplate, if on LEAST_PAGES.
RATIO, LEAST_PAGES = 0.08, 5
#: Dropped (host, line) pairs up to which the lists are broadcast: 40 bytes each, so some 16 MB.
BROADCAST_LINES = 400_000
#: Length of a drop list up to which its lines are compared one by one.
SHORT_LIST = 16


def key(line: Column) -> Column:
    """128 bits that stand for a line, as 32 characters."""
    return F.md5(line)


def worded(line: Column) -> Column:
    return F.length(without(line, ASCII_SPACE)) > 0


def among(ordered: Column, x: Column) -> Column:
    """Whether x is in a sorted array, by halving."""

    def half(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        above = F.get(ordered, middle) < x
        return F.struct(F.when(above, middle + 1).otherwise(s["low"]).alias("low"), F.when(above, s["high"]).otherwise(middle).alias("high"))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(ordered) + 1)).cast("int"))
    place = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(ordered).alias("high")), lambda s, i: F.when(s["low"] < s["high"], half(s, i)).otherwise(s), lambda s: s["low"])
    return F.when(F.size(ordered) <= SHORT_LIST, F.array_contains(ordered, x)).otherwise(F.coalesce(F.get(ordered, place) == x, F.lit(False)))


def boilerplate(docs: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES, text: str = "text", host: str = "source") -> DataFrame:
    """host, k, n_pages, n_host: the lines (by their key) above the ratio on their host."""
    pages = take(docs, text, host).toDF("text", "host")
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n_host"))
    keys = F.array_distinct(F.transform(F.filter(F.split("text", "\n", -1), worded), key))
    counts = (
        pages.select("host", F.explode(keys).alias("k"))
        .groupBy("host", F.unhex("k").alias("k"))
        .agg(F.count(F.lit(1)).alias("n_pages"))
        .where(F.col("n_pages") >= least_pages)
    )
    same = F.col("host").eqNullSafe(F.col("host_"))
    return (
        counts.join(totals.withColumnRenamed("host", "host_"), same)
        .where(F.col("n_pages") > ratio * F.col("n_host"))
        .select("host", F.lower(F.hex("k")).alias("k"), "n_pages", "n_host")
    )


def clean(docs: DataFrame, columns: Sequence[str], ratio: float = RATIO, least_pages: int = LEAST_PAGES, broadcast_lines: int = BROADCAST_LINES, owner: str = "line_dedup") -> DataFrame:
    """The given columns with text cleaned, and n_lines and n_dropped."""
    found = shared_table(boilerplate(docs, ratio, least_pages), owner, "boilerplate")
    lists = found.groupBy("host").agg(F.sort_array(F.collect_list("k")).alias("drop_"))
    small = found.count() <= broadcast_lines
    lists = F.broadcast(lists) if small else shared_table(lists, owner, "lists")
    rows = take(docs, *columns).select(F.struct(*columns).alias("row"), F.col("source").alias("host_"), F.col("text").alias("text_"))
    joined = rows.join(lists, rows["host_"].eqNullSafe(lists["host"]), "left")
    whole = F.split("text_", "\n", -1)
    kept = F.when(F.col("drop_").isNull(), whole).otherwise(F.filter(whole, lambda x: ~(worded(x) & among(F.col("drop_"), key(x)))))
    out = joined.select("row", whole.alias("whole_"), kept.alias("kept_"))
    return out.select(
        *[F.array_join("kept_", "\n").alias("text") if c == "text" else F.col(f"row.{c}").alias(c) for c in columns],
        F.coalesce(F.size("whole_"), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("whole_") - F.size("kept_"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(read(spark, sf_dir, "documents"), ["doc_id", "source", "text"])


OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
l AS (SELECT r, source, u.i, u.line FROM (
        SELECT r, source, unnest(list_zip(range(1, len(string_split(text, chr(10))) + 1), string_split(text, chr(10)))) AS z FROM d) t,
        LATERAL (SELECT z[1] AS i, z[2] AS line) u),
n AS (SELECT source, count(*) AS n_host FROM d GROUP BY source),
c AS (SELECT source, line, count(DISTINCT r) AS n_pages FROM l
      WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY source, line),
bad AS (SELECT c.source, line FROM c JOIN n ON c.source IS NOT DISTINCT FROM n.source
        WHERE n_pages >= {LEAST_PAGES} AND n_pages > {RATIO}::DOUBLE * n_host),
k AS (SELECT l.r, l.i, l.line, bad.line IS NOT NULL AS dropped
      FROM l LEFT JOIN bad ON l.line = bad.line AND l.source IS NOT DISTINCT FROM bad.source),
g AS (SELECT r, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '') AS text,
             count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped FROM k GROUP BY r)
SELECT doc_id, source, g.text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped
FROM d LEFT JOIN g USING (r)
"""
