"""Batches whose rows arrive between patches that switch categories, against a serial replay."""

from __future__ import annotations

import random

import pytest
from helpers import tuples
from pyspark.sql import functions as F

from orderlytics.operators import changes

PATCH = "seq bigint, id bigint, parent_id bigint, is_active boolean"
PRODUCT = "seq bigint, name string, price int, category_id bigint"


def replay(stored, patches, products):
    """One request after the other: refused patches and products, and the flags afterwards."""
    active, refused = dict(stored), {}
    requests = sorted([(p[0], "patch", p) for p in patches] + [(p[0], "product", p) for p in products])
    for seq, kind, row in requests:
        link = row[2] if kind == "patch" else row[3]
        if kind == "patch" and row[1] not in active:
            refused[seq] = "unknown_id"
        elif kind == "product" and link is None:
            refused[seq] = "invalid_fields"
        elif link is not None and not active.get(link, False):
            refused[seq] = "parent_not_found" if kind == "patch" else "category_not_found"
        elif kind == "patch" and row[2] is None and row[3] is None:
            refused[seq] = "nothing_to_change"
        elif kind == "patch" and row[3] is not None:
            active[row[1]] = row[3]
    return refused, active


def applied(spark, t, patches, products):
    batch = spark.createDataFrame(patches, PATCH)
    switches = changes.category_switches(t, batch)
    patched = changes.patch_apply("categories", t, batch, switches=switches)
    arriving = spark.createDataFrame(products, PRODUCT).withColumn("price", F.col("price").cast("decimal(12,2)"))
    added = changes.insert_batch("nomenclature", t, arriving, switches=switches)
    refused = dict(tuples(patched.rejected, "seq", "reason")) | dict(tuples(added.rejected, "seq", "reason"))
    return refused, dict(tuples(patched.table, "id", "is_active"))


def flags(t):
    return dict(tuples(t.categories, "id", "is_active"))


def test_a_category_switched_off_takes_no_child(shop, spark):
    patches = [(1, 5, None, False), (3, 6, 5, None), (5, 5, None, True), (7, 6, 5, None)]
    products = [(2, "A", 1, 5), (4, "B", 1, 6), (6, "C", 1, 5), (8, "D", 1, None)]
    refused, after = applied(spark, shop, patches, products)
    assert refused == {2: "category_not_found", 3: "parent_not_found", 8: "invalid_fields"}
    assert after == flags(shop)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_a_serial_replay(shop, spark, seed):
    draw = random.Random(seed)
    ids = [*sorted(flags(shop))[:6], 999]

    # Patches that move and switch at once depend on each other; a third of all names category 1.
    def some():
        return ids[0] if draw.random() < 0.33 else draw.choice(ids)

    order = draw.sample(range(1000), 90)
    patches = [
        (n, some(), draw.choice([None, some(), some()]), draw.choice([None, True, False, False])) for n in order[:60]
    ]
    products = [(n, f"P{n}", 1, draw.choice([None, some(), some()])) for n in order[60:]]
    refused, after = replay(flags(shop), patches, products)
    ours, table = applied(spark, shop, patches, products)
    assert ours == refused
    assert {"parent_not_found", "category_not_found"} <= set(refused.values())
    # Patches of one row merge: the last accepted flag of a category stays.
    assert table == after


def test_a_chain_of_switches(shop, spark):
    """Each patch moves its category below the one that the patch before switched."""
    ids = sorted(flags(shop))[:5]
    patches = [(0, ids[0], None, False)] + [(n, ids[n], ids[n - 1], n % 2 == 1) for n in range(1, 5)]
    refused, after = replay(flags(shop), patches, [])
    ours = changes.category_switches(shop, spark.createDataFrame(patches, PATCH))
    assert sorted(seq for (seq,) in tuples(ours, "seq")) == sorted({p[0] for p in patches} - set(refused))


def test_no_patch_and_no_switch(shop, spark):
    none = spark.createDataFrame([], PATCH)
    assert changes.category_switches(shop, none).count() == 0
    assert changes.category_switches(shop, none.select("seq", "id")).count() == 0
    refused, after = applied(spark, shop, [(1, 5, None, None)], [(2, "A", 1, 5), (3, "B", 1, 999)])
    assert refused == {1: "nothing_to_change", 3: "category_not_found"}
    assert after == flags(shop)
