"""Prefix trie of conversations: every distinct sequence of first turns is one node.

A prefix is named by the sum of one hash per (position, turn), two 64-bit hashes
wide. A sum is a running total, so a conversation of any length is named by the
slices of `operators.running` and never stands in one task.

A count-min sketch of the names screens the prefixes. An estimate of one proves
that a prefix belongs to a single conversation: all that follows it is a chain
of nodes with one member, and the task that holds them emits them. Only prefixes
whose parent may be shared are shuffled and grouped exactly. The sketch has at
most `MAX_CELLS` bytes; beyond some millions of turns it proves less and more
names (not texts) are shuffled, with the same result.

Subtree sums need no walk along the depth: each node is booked once, with its
smallest member. That member's nodes are the end of its path, so a node's
subtree is the sum over its members of what is booked with each, less what its
own smallest member has booked above it.

Turns sort by `turn`, NULL first, and where that is equal by a digest of role
and text. A NULL role or text is empty. Rows without conv_id belong to no
conversation. Repeated rows are turns of their own. Other columns, whatever
their names, are not read. No conversations: no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlytics.operators.running import running, sliced
from orderlytics.session import cut_lineage, read_back, scratch_path, write_counted

#: Names are sums modulo this prime.
MODULUS = 2**61 - 1
ROWS = 4
CELLS_PER_PREFIX = 8
MAX_CELLS = 1 << 25
PART = 1 << 16
CHUNK = 1 << 16

KEY = ["key_a", "key_b"]
ABOVE = ["above_a", "above_b"]
NO_IDS = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """Numbered turns as a written table: conv, nth (from 1), digest, n_bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv"),
        F.col("turn"),
        digest.alias("digest"),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
        F.lit(1).cast("bigint").alias("one"),
    ).where("conv IS NOT NULL")
    order = ["turn", "digest"]
    placed = running(sliced(rows, ["conv"], order, "turns"), ["conv"], order, nth=("sum", "one"))
    return cut_lineage(placed.drop("turn", "one"), "numbered-turns")


def _hash(seed: int, position: Column) -> Column:
    return F.xxhash64(F.lit(seed), position, F.col("digest")).cast("decimal(38,0)")


def _name(total: Column) -> Column:
    return F.pmod(total, F.lit(MODULUS).cast("decimal(38,0)")).cast("bigint")


def spliced(numbered: DataFrame, family: int = 1, heads: int = 1) -> tuple[DataFrame, DataFrame]:
    """(prefixes, conversations) after heads of conversations were exchanged.

    Conversation c begins with the first h turns of conversation c - c mod
    `family`, as far as there are any, and goes on with its own after the first
    h; h is crc32(c) mod `heads`. The defaults leave all as it is.
    """
    member = F.crc32(F.col("conv").cast("string").cast("binary"))
    counts = numbered.groupBy("conv").agg(F.max("nth").alias("n"))
    counts = cut_lineage(counts, "conversations")
    base = F.col("conv") - F.pmod(F.col("conv"), F.lit(family))
    bases = counts.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    convs = (
        counts.select("conv", "n", base.alias("base"), (member % heads).alias("h"))
        .join(bases, "base", "left")
        .withColumn("head", F.least("h", F.coalesce("n_base", F.lit(0))))
        .select("conv", "base", "h", "head", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    )
    convs = cut_lineage(convs, "spliced-conversations")

    # At most heads - 1 turns of a base for each of its family.
    givers = numbered.where((F.col("nth") < heads) & (F.pmod(F.col("conv"), F.lit(family)) == 0))
    head = (
        givers.select(F.col("conv").alias("base"), F.col("nth").alias("depth"), "digest", "n_bytes")
        .join(convs.where("head > 0"), "base")
        .where("depth <= head")
        .select("conv", "depth", "n_bytes", "length", *[_hash(s, F.col("depth")).alias(f"v{s}") for s in (1, 2)])
    )
    given = head.groupBy("conv").agg(F.sum("v1").alias("h1"), F.sum("v2").alias("h2"))
    own = (
        numbered.join(convs.join(given, "conv", "left"), "conv")
        .where("nth > h")
        .withColumn("depth", F.col("nth") - F.col("h") + F.col("head"))
    )
    own = own.withColumns({f"v{s}": _hash(s, F.col("depth")) for s in (1, 2)})
    own = running(own, ["conv"], ["depth"], s1=("sum", "v1"), s2=("sum", "v2"))
    zero = F.lit(0).cast("decimal(38,0)")
    own = own.withColumns({f"s{s}": F.col(f"s{s}") + F.coalesce(f"h{s}", zero) for s in (1, 2)})
    # A head has fewer than `heads` rows.
    upto = "conv ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    head = head.selectExpr("*", *[f"sum(v{s}) OVER (PARTITION BY {upto}) AS s{s}" for s in (1, 2)])

    columns = ["conv", "depth", "n_bytes", "length", "v1", "v2", "s1", "s2"]
    both = head.select(*columns).unionByName(own.select(*columns))
    named = both.select(
        "conv",
        F.col("depth").cast("bigint").alias("depth"),
        "n_bytes",
        (F.col("depth") == F.col("length")).alias("last"),
        *[_name(F.col(f"s{s}")).alias(k) for s, k in zip((1, 2), KEY)],
        *[_name(F.col(f"s{s}") - F.col(f"v{s}")).alias(k) for s, k in zip((1, 2), ABOVE)],
    )
    return named, convs.select("conv", "length")


# --- the sketch


def _cells(a: np.ndarray, b: np.ndarray, cells: int) -> Iterator[np.ndarray]:
    each = cells // ROWS
    shift = np.uint64(64 - each.bit_length() + 1)
    a, b = a.astype(np.uint64), b.astype(np.uint64)
    for row in range(ROWS):
        odd = np.uint64((0x9E3779B97F4A7C15 * (2 * row + 1)) % 2**64 | 1)
        mixed = (a ^ (b >> np.uint64(29 + row))) * odd + b
        mixed ^= mixed >> np.uint64(32)
        yield row * each + ((mixed * odd) >> shift).astype(np.int64)


def _sketched(batches: Iterable[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """This task's counts up to two, in parts; parts without counts are left out."""
    counts = np.zeros(cells, np.uint8)
    for batch in batches:
        for at in _cells(batch.column(0).to_numpy(), batch.column(1).to_numpy(), cells):
            found, n = np.unique(at, return_counts=True)
            counts[found] = np.minimum(counts[found] + np.minimum(n, 2), 2)
    for first in range(0, cells, PART):
        if counts[first : first + PART].any():
            part = counts[first : first + PART].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([first // PART]), pa.array([part], pa.binary())], ["part", "counts"])


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per part of a sorted partition: the sum over tasks, up to two."""
    part, total = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([total.tobytes()], pa.binary())], ["part", "counts"])

    for batch in batches:
        for number, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            more = np.frombuffer(counts.as_buffer(), np.uint8)
            if number == part:
                total = np.minimum(total + more, 2)
            else:
                if part is not None:
                    yield done()
                part, total = number, more.copy()
    if part is not None:
        yield done()


def sketch(prefixes: DataFrame, n: int, max_cells: int = MAX_CELLS) -> np.ndarray:
    """Count-min sketch of the names of `n` prefixes; at most `max_cells` bytes."""
    cells = PART
    while cells < min(CELLS_PER_PREFIX * n, max_cells):
        cells *= 2
    schema = "part bigint, counts binary"
    parts = prefixes.select(*KEY).mapInArrow(lambda it: _sketched(it, cells), schema)
    parts = parts.repartition("part").sortWithinPartitions("part").mapInArrow(_merged, schema)
    counts = np.zeros(cells, np.uint8)
    for row in parts.collect():
        counts[row.part * PART : (row.part + 1) * PART] = np.frombuffer(row.counts, np.uint8)
    return counts


def _screened(batches: Iterable[pa.RecordBatch], counts) -> Iterator[pa.RecordBatch]:
    """Adds `lone` and `tail`: the prefix, its parent, is proven to have one member."""
    for batch in batches:
        table = counts.value

        def proven(names: list[str]) -> np.ndarray:
            least = np.full(batch.num_rows, 2, np.uint8)
            for at in _cells(*(batch.column(c).to_numpy() for c in names), len(table)):
                least = np.minimum(least, table[at])
            return least == 1

        tail = proven(ABOVE) & (batch.column("depth").to_numpy() > 1)
        lone = proven(KEY) | tail
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(lone), pa.array(tail)], [*batch.schema.names, "lone", "tail"]
        )


# --- members that end at a node


def _joined_ids(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of a sorted partition joined by commas, in chunks of one node and bounded length."""
    key, ids, size, rows = None, [], 0, []

    def close() -> None:
        if ids:
            rows.append((*key, ids[0], ",".join(map(str, ids))))

    def batch_of(rows: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [*KEY, "first", "ids"])

    for batch in batches:
        for a, b, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if (a, b) != key or size >= CHUNK // 16:
                close()
                key, ids, size = (a, b), [], 0
            ids.append(conv)
            size += 1
            if len(rows) >= 256:
                yield batch_of(rows)
                rows.clear()
    close()
    if rows:
        yield batch_of(rows)


def _digested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the chunks of each node, in order, holding one chunk at a time."""
    key, state = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]]), pa.array([key[1]]), pa.array([state.hexdigest()])], [*KEY, "ends"]
        )

    for batch in batches:
        for a, b, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if (a, b) == key:
                state.update(b"," + ids.encode())
                continue
            if key is not None:
                yield done()
            key, state = (a, b), hashlib.sha256(ids.encode())
    if key is not None:
        yield done()


def _ends(rows: DataFrame) -> DataFrame:
    """Digest of the ids by node. Slices of a node become text chunks before they meet."""
    kind = "key_a bigint, key_b bigint"
    chunks = (
        rows.select(*KEY, "conv")
        .repartitionByRange(*KEY, "conv")
        .sortWithinPartitions(*KEY, "conv")
        .mapInArrow(_joined_ids, f"{kind}, first bigint, ids string")
    )
    return (
        chunks.repartition(*KEY)
        .sortWithinPartitions(*KEY, "first")
        .mapInArrow(_digested, f"{kind}, ends string")
    )


# --- the trie

NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NODE_SCHEMA = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def trie(prefixes: DataFrame, conversations: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """One row per node.

    conv_id: smallest member. parent_conv_id: the parent's. n_convs: members.
    n_children, n_leaves (childless nodes in the subtree), saved_tokens (over
    the subtree, members but one times bytes of the last text), ends_sha256
    (ids of the members that end here, ascending, comma-joined).
    """
    spark: SparkSession = prefixes.sparkSession
    whole = conversations.agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("least")).head()
    if not whole.n:
        return spark.createDataFrame([], NODE_SCHEMA)
    path = scratch_path(spark, "prefixes")
    n = write_counted(prefixes, path)
    prefixes = read_back(prefixes, path)
    counts = spark.sparkContext.broadcast(sketch(prefixes, n, max_cells))
    flags = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prefixes.schema.fields)
    screened = prefixes.mapInArrow(lambda it: _screened(it, counts), f"{flags}, lone boolean, tail boolean")

    one = F.lit(1).cast("bigint")
    own_end = F.when(F.col("last"), F.sha2(F.col("conv").cast("string"), 256)).otherwise(F.lit(NO_IDS))

    def chain(rows: DataFrame) -> DataFrame:
        return rows.select(
            F.col("conv").alias("conv_id"),
            "depth",
            F.col("conv").alias("parent_conv_id"),
            one.alias("n_convs"),
            F.when(F.col("last"), 0).otherwise(1).cast("bigint").alias("n_children"),
            one.alias("n_leaves"),
            F.lit(0).cast("bigint").alias("saved_tokens"),
            own_end.alias("ends_sha256"),
        )

    # The screen sees a row and its parent only. A row further down whose own
    # parent's cells collide comes along; it lies below its member's first proof.
    maybe = cut_lineage(screened.where("NOT tail").drop("tail"), "maybe-shared")
    proofs = maybe.where("lone").groupBy("conv").agg(F.min("depth").alias("proof"))
    marked = maybe.join(proofs, "conv", "left")
    marked = cut_lineage(marked.withColumn("stray", F.coalesce(F.col("depth") > F.col("proof"), F.lit(False))), "shared")
    tails = chain(screened.where("tail")).unionByName(chain(marked.where("stray")))
    shared = marked.where("NOT stray")
    groups = cut_lineage(
        shared.groupBy(*KEY).agg(
            *[F.min(c).alias(c) for c in (*ABOVE, "depth", "n_bytes")],
            F.min("conv").alias("conv"),
            F.count(F.lit(1)).alias("n"),
            F.bool_or("lone").alias("lone"),
            F.bool_or("last").alias("last"),
        ),
        "groups",
    )
    children = groups.where("depth > 1").groupBy(*ABOVE).agg(F.count(F.lit(1)).alias("n_children"))
    children = children.select(*[F.col(p).alias(k) for k, p in zip(KEY, ABOVE)], "n_children")
    nodes = groups.join(children, KEY, "left")
    below = F.when(F.col("lone"), F.when(F.col("last"), 0).otherwise(1)).otherwise(F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("n_children", below.cast("bigint")).withColumns(
        {
            "leaf": F.when(F.col("lone") | (F.col("n_children") == 0), 1).otherwise(0).cast("bigint"),
            "saved": (F.col("n") - 1) * F.col("n_bytes"),
        }
    )
    nodes = sliced(nodes, ["conv"], ["depth"], "booked")
    booked = nodes.groupBy("conv").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saves"))
    nodes = running(nodes, ["conv"], ["depth"], leaves_upto=("sum", "leaf"), saves_upto=("sum", "saved"))
    # Prefixes with one proven member need no sums over members: theirs are one leaf and nothing saved.
    sums = shared.where("NOT lone").select(*KEY, "conv").join(booked, "conv")
    sums = sums.groupBy(*KEY).agg(F.sum("leaves").alias("leaves"), F.sum("saves").alias("saves"))
    parents = groups.where("NOT lone").select(
        *[F.col(k).alias(a) for k, a in zip(KEY, ABOVE)], F.col("conv").alias("parent")
    )
    turnless = conversations.where("length = 0").select(*[F.lit(0).cast("bigint").alias(k) for k in KEY], "conv")
    ends = _ends(shared.where("last AND NOT lone").select(*KEY, "conv").unionByName(turnless))
    ends = cut_lineage(ends, "ends")

    root_end = ends.where("key_a = 0 AND key_b = 0").head()
    tops = groups.where("depth = 1").count()
    total = nodes.agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saves")).head()
    root = [(whole.least, 0, None, whole.n, tops, total.leaves or 1, total.saves or 0, root_end.ends if root_end else NO_IDS)]

    full = (
        nodes.join(parents, ABOVE, "left").join(sums, KEY, "left").join(ends, KEY, "left")
        .select(
            F.col("conv").alias("conv_id"),
            "depth",
            F.when(F.col("depth") == 1, F.lit(whole.least)).otherwise(F.col("parent")).alias("parent_conv_id"),
            F.col("n").alias("n_convs"),
            "n_children",
            F.when(F.col("lone"), one)
            .otherwise(F.col("leaves") - F.col("leaves_upto") + F.col("leaf"))
            .cast("bigint")
            .alias("n_leaves"),
            F.when(F.col("lone"), F.lit(0))
            .otherwise(F.col("saves") - F.col("saves_upto") + F.col("saved"))
            .cast("bigint")
            .alias("saved_tokens"),
            F.when(F.col("lone"), own_end).otherwise(F.coalesce("ends", F.lit(NO_IDS))).alias("ends_sha256"),
        )
    )
    return spark.createDataFrame(root, NODE_SCHEMA).unionByName(full.select(*NODE)).unionByName(tails.select(*NODE))


def with_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes of a trie without splicing, each with role and text of its last turn: every
    shared turn once, ready to be trained on with its descendants."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    by_digest = turns(conversations).select(F.col("conv").alias("conv_id"), F.col("nth").alias("depth"), "digest")
    texts = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), role.alias("role"), text.alias("text"), digest.alias("digest"))
    texts = texts.dropDuplicates(["conv_id", "digest"])
    return nodes.join(by_digest, ["conv_id", "depth"], "left").join(texts, ["conv_id", "digest"], "left").drop("digest")
