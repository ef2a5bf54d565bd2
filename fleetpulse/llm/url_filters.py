"""Dated URL lists joined to captures as of the time of each capture, with DataFrame functions only.

A list entry says that from `listed` on a pattern is on (`action` "add") or off ("remove") a list. Entries become
validity intervals per (list, pattern): equal entries count once, on one day "remove" wins over "add", and each state
holds until the next entry. A pattern is a host ("example.org", which covers its subdomains) or a host and the first
path segment ("example.org/shop").

A capture's URL gives the patterns that cover it, from the most specific one: host with first segment, host, and each
of the host's parents down to its last label. Each capture
meets the intervals of its patterns that contain its time. The most specific pattern decides; on one pattern
"block" beats "allow". Intervals of one pattern never overlap within a list, so a level matches once per list.

Plan: the parents of a host are tried once for each host and day, however many captures it has, by an equality join on
the pattern, in which the interval is a further condition; the longest hit stays. Captures then meet the hits of their
host and day, and the intervals of host with segment, by one equality join each. Lists are
small beside captures, and adaptive execution measures them: it sends them to all tasks or splits the captures of a
frequent host. Captures without a host or segment get a key that spreads them.

Rows: a null or unreadable URL and a null time match nothing (decision "none"); equal captures give equal rows; entries
with a null pattern, list, date or an unknown action are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.session import pinned

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)"


def host_of(url: Column) -> Column:
    """The URL's host in lower case, null if it has none."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and its parents, the longest first; null without a host."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def with_segment(url: Column) -> Column:
    """The URL's host and first segment, null if it lacks one."""
    return F.concat(host_of(url), F.lit("/"), F.nullif(F.regexp_extract(url, SEGMENT, 1), F.lit("")))


def intervals(entries: DataFrame) -> DataFrame:
    """list, kind, pattern, since, until (exclusive; null: open) of the times when a pattern is listed."""
    clean = entries.where(
        F.col("list").isNotNull() & F.col("pattern").isNotNull() & F.col("listed").isNotNull() & F.col("action").isin("add", "remove")
    )
    days = clean.groupBy("list", "kind", "pattern", F.col("listed").cast("date").alias("since")).agg(F.max("action").alias("action"))
    after = Window.partitionBy("list", "kind", "pattern").orderBy("since")
    return (
        days.withColumn("until", F.lead("since").over(after)).where("action = 'add'").select("list", "kind", "pattern", "since", "until")
    )


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """`captures` (with `url`, `fetched`) with `decision` (allow, block, none), `pattern` and `lists` that decided."""
    made = intervals(entries)
    # One row per pattern and span of days with a constant set of lists, so that each level matches at most once.
    edges = made.select("pattern", F.col("since").alias("day")).unionByName(
        made.where("until is not null").select("pattern", F.col("until").alias("day"))
    ).distinct()
    spans = edges.withColumn("next", F.lead("day").over(Window.partitionBy("pattern").orderBy("day")))
    inside = (F.col("s.day") >= F.col("i.since")) & (F.col("i.until").isNull() | (F.col("s.day") < F.col("i.until")))
    states = pinned(
        spans.alias("s").join(made.alias("i"), (F.col("s.pattern") == F.col("i.pattern")) & inside)
        .groupBy(F.col("s.pattern").alias("p"), F.col("s.day").alias("d0"), F.col("s.next").alias("d1"))
        .agg(
            F.when(F.max(F.col("i.kind") == "block"), "block").otherwise("allow").alias("k"),
            F.array_join(F.array_sort(F.collect_set("i.list")), ",").alias("l"),
        )
    )
    names = captures.columns
    day = F.to_date("fetched")
    out = captures.withColumn("__host", host_of(F.col("url"))).withColumn("__page", with_segment(F.col("url"))).withColumn("__day", day)
    asked = out.where("__host is not null and __day is not null").select("__host", "__day").distinct()
    tried = asked.select("__host", "__day", F.posexplode(suffixes(F.col("__host"))).alias("far", "q"))
    holds = (F.col("__day") >= F.col("d0")) & (F.col("d1").isNull() | (F.col("__day") < F.col("d1")))
    hits = pinned(
        tried.join(states, (F.col("q") == F.col("p")) & holds)
        .groupBy("__host", "__day").agg(F.min(F.struct("far", "k", "l", "p")).alias("m"))
        .select(F.col("__host").alias("__h"), F.col("__day").alias("__d"), *[F.col(f"m.{c}").alias(f"__{c}1") for c in "klp"])
    )
    spread = lambda c: F.coalesce(c, F.concat(F.lit("\x00"), F.xxhash64(*names).cast("string")))
    out = out.withColumn("__j0", spread(F.col("__page"))).withColumn("__j1", spread(F.col("__host")))
    lists = states.select(*[F.col(c).alias(f"__{c}0") for c in ("p", "d0", "d1", "k", "l")])
    inside = (F.col("__day") >= F.col("__d00")) & (F.col("__d10").isNull() | (F.col("__day") < F.col("__d10")))
    out = out.join(lists, (F.col("__j0") == F.col("__p0")) & inside, "left")
    out = out.join(hits, (F.col("__j1") == F.col("__h")) & (F.col("__day") == F.col("__d")), "left")
    first = lambda c: F.coalesce(F.col(f"__{c}0"), F.col(f"__{c}1"))
    return out.select(
        *[F.col(f"`{c}`") for c in names if c not in ("decision", "pattern", "lists")],
        F.coalesce(first("k"), F.lit("none")).alias("decision"), first("p").alias("pattern"), first("l").alias("lists"),
    )
