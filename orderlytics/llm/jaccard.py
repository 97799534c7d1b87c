"""Exact Jaccard similarity join of word-shingle sets in the metric space of sets.

Jaccard distance is a metric, and documents link at distance `r` at most. Sets
that are equal are one point. Points are dealt to regions, each region has a
pivot, and distances to pivots are exact:

1. Regions. Shingles are ordered by how common their hash bucket is in the whole
   corpus. Two sets that are similar enough share one of the first
   `size - ceil(similar * size) + 1` shingles of either, so every such shingle
   is a region and boundary points are members of several. (Nearest-pivot regions
   over sampled documents put every document into every region: unrelated texts
   are all at a distance near 1, and the window of 2r then covers everything.)
2. The pivot of a region is its densest member: the one whose regions have most
   members. Every member's distance to its pivots is computed; those within `r`
   are linked, and links join components.
   Windows replicate boundary members: sizes that differ too much are at a distance
   above `r`, so a region is cut into bands of sizes and each point is also
   a member of the next band. Of regions with the same members one is kept.
3. A region whose members are all in one component is done. Else, if it is large,
   its next pivot comes from outside its largest component, for `ROUNDS` rounds.
4. In regions that are still mixed, all members outside the largest component
   meet all members in blocks of bounded size. What travels is an outline of each
   set: its shingles counted in 256 bins. Outlines are a metric space of their
   own, in which no two points are farther apart than their sets differ. The first
   document of a block is the pivot, and by the triangle inequality only members
   whose distance to the pivot is close to a document's own are compared with
   it. Pairs whose outlines may link are then compared as sets.

No pair is left out that could still join two components, so components are
those of the full link graph; pairs within a component need not be compared.

Texts are only read again for points that meet a pivot of compatible size. NULL
and empty texts have no shingles and link with nothing; a text with fewer words
than a shingle is one shingle. Repeated rows link. A NULL doc_id comes after all
others when the smallest of a component is taken.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlytics.llm.common import portions, text_of
from orderlytics.llm.components import components
from orderlytics.llm.wordhash import mixed, windows, words
from orderlytics.session import cut_lineage, read_back, scratch_path, write_counted

SKETCH = 1 << 16
ROUNDS = 2
SMALL = 64  # regions that are joined whole, in one block
BLOCK = 512
PER_PIVOT = 1000  # pairs of one pivot in one task
SALTS = 8
BROADCAST_POINTS = 500_000  # longs

NAME = ["name_a", "name_b"]


def _name(id: str, text: str) -> list[Column]:
    """128 bits of a row's id and text."""
    return [F.xxhash64(id, text).alias("name_a"), F.xxhash64(F.lit("row"), id, text).alias("name_b")]


def _shingles(data: np.ndarray, texts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the texts one after another (not yet distinct), and where each text begins."""
    found = words(data, texts, lower=True)
    hashes, inside = windows(found, size)
    n = np.diff(found.first)
    counts = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    starts = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(starts[-1], np.uint64)
    whole = np.repeat(n >= size, counts)
    out[whole] = hashes[inside]
    for length in range(1, size):  # texts too short for a shingle: all their words
        short = np.flatnonzero(n == length)
        if len(short):
            h = found.hashes[found.first[short]].copy()
            with np.errstate(over="ignore"):
                for k in range(1, length):
                    h = mixed(h * np.uint64(3) + found.hashes[found.first[short] + k])
                out[starts[short]] = mixed(h + np.uint64(length))
    return out, starts


def _ordered(hashes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Shingles renamed so that they sort by how common they are; the renaming is one to one."""
    low = hashes & np.uint64(SKETCH - 1)
    return (rank[low] << np.uint64(48)) | (hashes >> np.uint64(16))


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _count(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SKETCH, np.int64)
    for batch in batches:
        for _, _, data, texts in portions(batch.column("body")):
            hashes, _ = _shingles(data, texts, size)
            counts += np.bincount((hashes & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], ["bucket", "n"])


def _sets(
    batches: Iterator[pa.RecordBatch], size: int, similar: int, rank: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """Per row: size of the set, a 128-bit key of the set, and the shingles that are its regions."""
    for batch in batches:
        sizes, keys, regions, outlines = [], [], [], []
        for _, _, data, texts in portions(batch.column("body")):
            sets = _split(data, texts, size, rank)
            outlines += [_outline(x) for x in sets]
            sizes += map(len, sets)
            keys += _keys(sets)
            regions += [x[: len(x) - -(-similar * len(x) // 100) + 1 if len(x) else 0] for x in sets]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in regions])]).astype(np.int32)
        flat_regions = np.concatenate(regions).view(np.int64) if regions else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in ("doc_id", *NAME)),
                pa.array(sizes, pa.int64()),
                pa.array(keys, pa.binary()),
                pa.array(outlines, pa.binary()),
                pa.ListArray.from_arrays(pa.array(starts), pa.array(flat_regions)),
            ],
            ["doc_id", *NAME, "n_shingles", "key", "outline", "regions"],
        )


def _split(data: np.ndarray, texts: np.ndarray, size: int, rank: np.ndarray) -> list[np.ndarray]:
    """The set of each text, most unusual shingles first."""
    hashes, starts = _shingles(data, texts, size)
    hashes = _ordered(hashes, rank)
    return [_distinct(hashes[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]


def _outline(own: np.ndarray) -> bytes:
    """How many shingles fall in each of 256 bins. The outlines of two sets differ no more than
    the sets do, and what the bins have in common is at least what the sets have."""
    bins = np.bincount((own & np.uint64(255)).astype(np.int64), minlength=256)
    return bins.astype(np.uint8 if bins.max() < 256 else np.uint32).tobytes()


def _bins(outline: bytes) -> np.ndarray:
    return np.frombuffer(outline, np.uint8 if len(outline) == 256 else np.uint32).astype(np.int64)


def _keys(sets: list[np.ndarray]) -> list[bytes | None]:
    """128 bits of each set; none for the empty ones."""
    full = [x for x in sets if len(x)]
    if not full:
        return [None] * len(sets)
    starts = np.cumsum([0, *(len(x) for x in full[:-1])])
    a = mixed(np.concatenate(full))
    b = mixed(a ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    with np.errstate(over="ignore"):
        both = np.stack([np.add.reduceat(a, starts), np.add.reduceat(b, starts)], axis=1)
    keys = iter(both)
    return [next(keys).tobytes() if len(x) else None for x in sets]


def _arrays(batches: Iterator[pa.RecordBatch], size: int, rank: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, sets = [], []
        for _, _, data, texts in portions(batch.column("body")):
            own = _split(data, texts, size, rank)
            keys += _keys(own)
            sets += [x.tobytes() for x in own]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["key", "shingles"])


def _close(batches: Iterator[pa.RecordBatch], similar: int) -> Iterator[pa.RecordBatch]:
    """The pairs that link."""
    for batch in batches:
        a, b = batch.column("left"), batch.column("right")
        keep = []
        for i in range(batch.num_rows):
            x, y = (np.frombuffer(s[i].as_py(), np.uint64) for s in (a, b))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= similar * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("pivot")], ["a", "b"]).filter(pa.array(keep))


def _possible(batches: Iterator[pa.RecordBatch], similar: int) -> Iterator[pa.RecordBatch]:
    """The pairs that may link by their outlines."""
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
            x, y = _bins(a), _bins(b)
            both = int(np.minimum(x, y).sum())
            keep.append(100 * both >= similar * (int(x.sum()) + int(y.sum()) - both))
        yield batch.select(["rid", "pivot"]).filter(pa.array(keep, pa.bool_()))


def _block(table: pa.Table, similar: int) -> pa.Table:
    """Pairs of an outsider and a member of another component that may link by their outlines.

    The distance between outlines (sum of differences) is a metric too and never
    more than that of the sets; linked sets of sizes a and b differ in at most
    (a + b)(1 - s) / (1 + s) shingles.
    """
    outside = np.array(table["outside"].to_pylist(), bool)
    rid, comp = table["rid"].to_numpy(), table["comp"].to_numpy()
    bins = np.stack([_bins(x) for x in table["outline"].to_pylist()])
    members, asked = np.flatnonzero(~outside), np.flatnonzero(outside)
    pairs: tuple[list, list] = ([], [])
    if len(members) and len(asked):
        sizes = bins.sum(axis=1)
        pivot = bins[asked[0]]
        to_pivot = np.abs(bins - pivot).sum(axis=1)
        for o in asked:
            most = (sizes[members] + sizes[o]) * (100 - similar) / (100 + similar)
            near = members[(np.abs(to_pivot[members] - to_pivot[o]) <= most) & (comp[members] != comp[o])]
            both = np.minimum(bins[near], bins[o]).sum(axis=1)
            found = near[100 * both >= similar * (sizes[near] + sizes[o] - both)]
            pairs[0].extend(rid[np.full(len(found), o)].tolist())
            pairs[1].extend(rid[found].tolist())
    return pa.table({"rid": pa.array(pairs[0], pa.int64()), "pivot": pa.array(pairs[1], pa.int64())})


class _Points:
    """The distinct sets of a corpus, and what is known of them."""

    def __init__(self, docs: DataFrame, size: int, similar: int, text: str, id: str) -> None:
        self.size, self.similar = size, similar
        self.texts = docs.select(F.col(id).alias("doc_id"), *_name(id, text), text_of(text).alias("body"))
        seen = self.texts.select("body").mapInArrow(lambda it: _count(it, size), "bucket int, n bigint")
        counts = np.zeros(SKETCH, np.int64)
        for row in seen.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow().to_pylist():  # SKETCH rows at most
            counts[row["bucket"]] = row["n"]
        self.rank = rank = np.argsort(np.argsort(counts, kind="stable"), kind="stable").astype(np.uint64)
        id_type = self.texts.schema["doc_id"].dataType.simpleString()
        schema = f"doc_id {id_type}, name_a bigint, name_b bigint, n_shingles bigint, key binary, outline binary, regions array<bigint>"
        self.rows = cut_lineage(self.texts.mapInArrow(lambda it: _sets(it, size, similar, rank), schema), "sets")
        first = F.struct(F.isnull("doc_id").alias("none"), "doc_id", *NAME)
        same = self.rows.where("key IS NOT NULL").groupBy("key")
        points = same.agg(
            F.min(first).alias("first"),
            F.count(F.lit(1)).alias("n_rows"),
            F.first("n_shingles").alias("n"),
            F.first("outline").alias("outline"),
            F.first("regions").alias("regions"),
        )
        self.points = cut_lineage(points.withColumn("rid", F.monotonically_increasing_id()), "points")

    def members(self) -> DataFrame:
        """(region, rid, n, density) of all regions with two points or more."""
        each = self.points.select(F.explode("regions").alias("region"), "rid")
        several = each.groupBy("region").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        kept = cut_lineage(each.join(several.hint("shuffle_hash"), "region"), "regions")
        density = kept.groupBy("rid").agg(F.sum("m").alias("density"))
        known = self.points.select("rid", "n").join(density, "rid")
        sized = kept.select("region", "rid").join(known, "rid")
        # Distance is at least 1 - smaller / larger size, so linked sets are in one band or in two that touch.
        band = F.floor(F.log(F.col("n")) / F.lit(-math.log(self.similar / 100) + 1e-9))
        sized = sized.withColumn("band", F.explode(F.array(band, band + 1)))
        own = ["region", "band"]
        # Near-duplicates share many regions; of regions with the same members one is enough.
        full = sized.groupBy(*own).agg(
            F.count(F.lit(1)).alias("m"),
            F.bit_xor(F.xxhash64("rid")).alias("a"),
            F.bit_xor(F.xxhash64(F.lit("member"), "rid")).alias("b"),
        )
        one = full.where("m > 1").groupBy("m", "a", "b").agg(F.min(F.struct(*own)).alias("own")).select("own.*")
        one = one.withColumn("id", F.monotonically_increasing_id())
        kept = sized.join(cut_lineage(one, "regions"), own).select(F.col("id").alias("region"), "rid", "n", "density")
        return cut_lineage(kept, "members")

    def shingles_of(self, rids: DataFrame) -> DataFrame:
        """(rid, shingles) of some points, from their texts."""
        wanted = self.points.join(rids.distinct(), "rid", "left_semi")
        wanted = wanted.select("rid", "key", F.col("first.name_a").alias("name_a"), F.col("first.name_b").alias("name_b"))
        path = scratch_path(wanted.sparkSession, "wanted")
        n = write_counted(wanted, path)
        wanted = read_back(wanted, path)
        names = wanted.select(*NAME)
        names = F.broadcast(names) if n <= BROADCAST_POINTS else names.hint("shuffle_hash")
        size, rank = self.size, self.rank
        found = self.texts.join(names, NAME, "left_semi").select("body")
        sets = found.mapInArrow(lambda it: _arrays(it, size, rank), "key binary, shingles binary")
        # Rows repeated in full come more than once here.
        return cut_lineage(sets.join(wanted.select("rid", "key"), "key").dropDuplicates(["rid"]).drop("key"), "shingles")

    def fits(self, a: str, b: str) -> Column:
        return 100 * F.least(a, b) >= self.similar * F.greatest(a, b)

    def links(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (rid, pivot), those that link. A pivot with many pairs is dealt over several tasks.

        Outlines, some 256 bytes each, leave out most pairs before any text is read again.
        """
        similar = self.similar
        outlines = self.points.select("rid", "outline")
        outlined = pairs.join(outlines.withColumnRenamed("outline", "left"), "rid").join(
            outlines.select(F.col("rid").alias("pivot"), F.col("outline").alias("right")), "pivot"
        )
        pairs = outlined.select("rid", "pivot", "left", "right").mapInArrow(
            lambda it: _possible(it, similar), "rid bigint, pivot bigint"
        )
        pairs = cut_lineage(pairs, "pairs")
        rids = pairs.select("rid").unionByName(pairs.select(F.col("pivot").alias("rid")))
        sets = self.shingles_of(rids)
        parts = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / F.lit(PER_PIVOT)).alias("parts"))
        pivots = (
            sets.withColumnRenamed("shingles", "right")
            .join(parts, F.col("rid") == F.col("pivot"))
            .select("pivot", "right", "parts", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
        )
        dealt = pairs.join(parts, "pivot").withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts"))).drop("parts")
        both = dealt.join(sets.withColumnRenamed("shingles", "left"), "rid").join(pivots.drop("parts"), ["pivot", "part"])
        ready = both.select("rid", "pivot", "left", "right")
        return cut_lineage(ready.mapInArrow(lambda it: _close(it, similar), "a bigint, b bigint"), "links")

    def components(self) -> DataFrame:
        """(rid, comp) of the points that link with others."""
        members = self.members()
        spark = members.sparkSession
        nothing = spark.createDataFrame([], "a bigint, b bigint")
        links, led = nothing, spark.createDataFrame([], "region bigint, rid bigint")
        comps = spark.createDataFrame([], "rid bigint, comp bigint")
        for n in range(ROUNDS + 1):
            mixed_members = members.join(comps, "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
            if n:
                mixed_members = self._mixed(mixed_members)
                if mixed_members.isEmpty():
                    break
                large = mixed_members.where(F.col("m") > SMALL)
                if n < ROUNDS and large.isEmpty():
                    continue
            if n == ROUNDS:
                found = self._in_blocks(mixed_members)
            else:
                mixed_members = large if n else mixed_members
                found, lead = self._by_pivots(mixed_members, led, first=n == 0)
                led = cut_lineage(led.unionByName(lead), "led")
            if not found.isEmpty():
                links = cut_lineage(links.unionByName(found), "all-links")
                comps = components(links).select(F.col("node").alias("rid"), F.col("component").alias("comp"))
                comps = cut_lineage(comps, "components")
        return comps

    @staticmethod
    def _mixed(members: DataFrame) -> DataFrame:
        """Members of regions with several components; `outside`: not in the region's largest."""
        sizes = members.groupBy("region", "comp").agg(F.count(F.lit(1)).alias("k"))
        regions = sizes.groupBy("region").agg(
            F.max(F.struct("k", "comp")).alias("main"), F.sum("k").alias("m"), F.count(F.lit(1)).alias("comps")
        )
        regions = regions.where("comps > 1").select(
            "region", F.col("main.comp").alias("main"), "m", (F.col("m") - F.col("main.k")).alias("outsiders")
        )
        joined = members.join(regions, "region").withColumn("outside", F.col("comp") != F.col("main"))
        return cut_lineage(joined, "mixed")

    def _by_pivots(self, members: DataFrame, led: DataFrame, first: bool) -> tuple[DataFrame, DataFrame]:
        able = members if first else members.where("outside").join(led, ["region", "rid"], "left_anti")
        best = able.groupBy("region").agg(F.max(F.struct("density", "rid", "n", "comp")).alias("best"))
        lead = best.select(
            "region", F.col("best.rid").alias("pivot"), F.col("best.n").alias("pivot_n"), F.col("best.comp").alias("pivot_comp")
        )
        lead = cut_lineage(lead, "pivots")
        pairs = members.join(lead, "region").where((F.col("comp") != F.col("pivot_comp")) & self.fits("n", "pivot_n"))
        found = self.links(pairs.select("rid", "pivot").distinct())
        return found, lead.select("region", F.col("pivot").alias("rid"))

    def _in_blocks(self, members: DataFrame) -> DataFrame:
        outlines = self.points.select("rid", "outline")
        blocks = lambda n: F.ceil(F.col(n) / F.lit(BLOCK)).cast("bigint")
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), blocks(n) - 1))
        mine = F.xxhash64("rid")
        rest = ["region", "rid", "comp", "outside"]
        asked = members.where("outside").select(*rest, F.pmod(mine, blocks("outsiders")).alias("i"), upto("m").alias("j"))
        others = members.withColumn("outside", F.lit(False)).select(
            *rest, upto("outsiders").alias("i"), F.pmod(mine, blocks("m")).alias("j")
        )
        similar = self.similar
        possible = (
            asked.unionByName(others)
            .join(outlines, "rid")
            .groupBy("region", "i", "j")
            .applyInArrow(lambda t: _block(t, similar), "rid bigint, pivot bigint")
        )
        return self.links(possible.select(F.least("rid", "pivot").alias("rid"), F.greatest("rid", "pivot").alias("pivot")).distinct())


def joined(docs: DataFrame, size: int, similar: int, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, its name (name_a, name_b), n_shingles, and `first`, the first row of its component."""
    points = _Points(docs, size, similar, text, id)
    comps = points.components()
    placed = points.points.join(comps, "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    leading = placed.groupBy("comp").agg(F.min("first").alias("leader"))
    several = placed.join(leading, "comp").where("n_rows > 1 OR first <> leader").select("key", "leader")
    # A set with many rows is dealt over several keys.
    salts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))
    rows = points.rows.drop("regions", "outline").withColumn("salt", F.pmod(F.xxhash64(*NAME), F.lit(SALTS)))
    result = rows.join(several.withColumn("salt", salts), ["key", "salt"], "left")
    own = F.struct(F.isnull("doc_id").alias("none"), "doc_id", *NAME)
    return result.select("doc_id", *NAME, "n_shingles", F.coalesce("leader", own).alias("first"))


def without_duplicates(docs: DataFrame, size: int, similar: int, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The documents that are the first of their component; of rows repeated in full, one."""
    found = cut_lineage(joined(docs, size, similar, text, id), "near-duplicates")
    first = (F.col("first.name_a") == F.col("name_a")) & (F.col("first.name_b") == F.col("name_b"))
    gone = found.where(~first).select(*NAME)
    named = docs.select(*_name(id, text), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    stay = named.join(gone.hint("shuffle_hash"), NAME, "left_anti")
    again = cut_lineage(found.where(first).groupBy(*NAME).count().where("count > 1").select(*NAME), "repeated")
    if not again.isEmpty():
        once = stay.join(again, NAME, "left_semi").dropDuplicates(NAME)
        stay = stay.join(again, NAME, "left_anti").unionByName(once)
    return stay.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
