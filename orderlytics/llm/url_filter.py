"""URL rules as a sort-merge range join over reversed hosts.

A host is keyed by its labels in reverse, each with a dot: `com.example.www.`.
The hosts under a rule's host are then one interval of keys, from `com.example.`
up to `com.example/` (the character after the dot), and intervals nest. Starts
and ends of all intervals are boundaries; between two boundaries the stack of
open rules does not change. Boundaries are numbered in sorted slices, no task
holding them all. Boundaries and addresses are sorted together, in
slices that no single host can fill, and every address takes the stack of the
last boundary before it. Of the rules on the stack whose path its own path
starts with, the longest decides.

Host and path of a NULL address, or of one without `://`, are empty. Addresses
without a rule get `default`. Of rules with the same host and path, and of
rules of the same length, the first by text decides. Rules with a NULL host, path
or verdict are left out. Repeated rows are judged each. Only DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlytics.llm.common import ROW, ascii_lower, wrapped
from orderlytics.operators.running import SLICE, numbered, running, sliced
from orderlytics.session import cut_lineage

BROADCAST_STACKS = 50_000


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case, and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _stacks(rules: DataFrame) -> DataFrame:
    """(key, stack) of every boundary; a stack holds the open rules, longest first."""
    known = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
    known = known.select("path", "verdict", F.concat("host", "path").alias("rule"), host_key(F.col("host")).alias("open"))
    hosts = known.select("open").distinct()
    labels = F.split(F.regexp_replace("open", r"\.$", ""), r"\.", -1)
    outer = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit("."))
    )
    start = F.struct(F.col("open").alias("key"), outer.alias("inside"))
    end = F.struct(
        F.regexp_replace("open", r"\.$", "/").alias("key"), F.slice(outer, 1, F.size(outer) - 1).alias("inside")
    )
    bounds = hosts.select(F.explode(F.array(start, end)).alias("b")).select("b.*")
    opened = bounds.select("key", F.explode("inside").alias("open")).join(known, "open")
    entry = F.struct((-F.length("rule")).alias("order"), "rule", "path", "verdict")
    stacks = opened.groupBy("key").agg(F.array_sort(F.collect_set(entry)).alias("stack"))
    return bounds.select("key").join(stacks, "key", "left").distinct()


def judged(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Rows (wrapped) with host, path, rule (NULL if none fits) and verdict."""
    stacks = cut_lineage(numbered(_stacks(rules), ["key"], "place", "bounds"), "stacks")
    host, path = parts(F.col(url))
    rows = pages.select(wrapped(pages), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("key", host_key(F.col("host"))).withColumn("spread", F.xxhash64(f"{ROW}", "path"))
    bounds = stacks.select("key", "place")
    both = rows.unionByName(bounds, allowMissingColumns=True)
    order = ["key", F.col("place").asc_nulls_last(), "spread"]
    swept = running(sliced(both, [], order, "sweep"), [], order, last=("max", "place")).where("place IS NULL")
    few = stacks.count() <= BROADCAST_STACKS
    stack = stacks.select(F.col("place").alias("last"), "stack")
    swept = swept.join(F.broadcast(stack) if few else stack, "last", "left")
    fits = F.get(F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    rule = F.col("fits")["rule"]
    out = swept.drop(SLICE).withColumn("fits", fits)
    return out.select(ROW, "host", "path", rule.alias("rule"), F.coalesce(F.col("fits")["verdict"], F.lit(default)).alias("verdict"))
