"""Batch changes: an old table and a change set give a new table and the rejects.

A batch is checked against the table as it was before the batch, plus what
earlier rows of the same batch claim (unique values) and, on request, how earlier
patches switched categories on and off. Rows are processed as if
they arrived in the order of their `seq` column, which is unique.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlytics.functions.numbers import number_value, order_number
from orderlytics.operators.hierarchy import below
from orderlytics.operators.integrity import VIOLATIONS, record_rules
from orderlytics.operators.reports import item_totals
from orderlytics.operators.running import numbered, running, sliced
from orderlytics.operators.subtrees import SubtreeIndex
from orderlytics.schemas import LOCKED_STATUSES, SCHEMAS, TOTAL
from orderlytics.session import cut_lineage
from orderlytics.sources.tables import Tables, with_defaults

ACTOR = "api_user"

# The fields a patch may change.
PATCH_FIELDS = {
    "categories": ("name", "parent_id", "is_active"),
    "clients": ("name", "email", "phone", "address", "is_active"),
    "nomenclature": ("name", "description", "sku", "quantity", "price", "cost", "category_id", "is_active"),
    "orders": ("status", "payment_status", "notes"),
}

# The fields a new record may bring.
INSERT_FIELDS = {
    "categories": ("name", "parent_id"),
    "clients": ("name", "email", "phone", "address"),
    "nomenclature": ("name", "description", "sku", "quantity", "price", "cost", "category_id"),
}

# Column that must point to an active category, and column nobody else may hold.
_CATEGORY_LINK = {"categories": "parent_id", "nomenclature": "category_id"}
_UNIQUE = {"clients": "email", "nomenclature": "sku"}


@dataclass(frozen=True)
class Applied:
    """The new table and the change rows that were refused, with a reason.

    `changed` (whole new rows) and `gone` (ids) are what differs from the old table:
    a `VersionedTable` that commits them rewrites only the files they lie in.
    """

    table: DataFrame
    rejected: DataFrame
    changed: DataFrame | None = None
    gone: DataFrame | None = None


def first_reason(*checks: tuple[Column, str]) -> Column:
    """Code of the first check that holds; NULL when none does."""
    return F.coalesce(*[F.when(failed, F.lit(code)) for failed, code in checks])


# --- stock -----------------------------------------------------------------


def apply_stock(products: DataFrame, deltas: DataFrame, actor: str = ACTOR, now: Column | None = None) -> Applied:
    """Add signed quantities per product; a stock that would turn negative is refused."""
    change = deltas.groupBy(F.col("nomenclature_id").alias("id")).agg(F.sum("delta").alias("_delta"))
    joined = products.join(change, "id", "left")
    after = F.col("quantity") + F.coalesce(F.col("_delta"), F.lit(0))
    changed = F.col("_delta").isNotNull() & (after >= 0)
    table = _stamped(joined, products.columns, {"quantity": after.cast("int")}, changed, actor, now)
    rejected = joined.where(after < 0).select(
        "id", "quantity", F.col("_delta").alias("delta"), F.lit("stock_negative").alias("reason")
    )
    moved = products.join(change, "id").where(after >= 0)
    return Applied(table, rejected, _stamped(moved, products.columns, {"quantity": after.cast("int")}, F.lit(True), actor, now))


def order_stock_deltas(order_items: DataFrame, order_ids: DataFrame | None, sign: int) -> DataFrame:
    """Stock taken (`sign=-1`) or given back (`sign=1`) by whole orders; without ids, by all that have items."""
    if order_ids is not None:
        order_items = order_items.join(order_ids.select(F.col("id").alias("order_id")), "order_id", "left_semi")
    return order_items.groupBy("nomenclature_id").agg((F.sum("quantity") * sign).alias("delta"))


def _stamped(
    df: DataFrame, columns: list[str], values: dict[str, Column], changed: Column, actor: str, now: Column | None
) -> DataFrame:
    """Take new values, author and time in changed rows, the old ones elsewhere."""
    values = dict(values)
    stamps = {"updated_by": F.lit(actor), "updated_at": F.current_timestamp() if now is None else now}
    values |= {name: value for name, value in stamps.items() if name in columns}
    merged = {c: F.when(changed, value).otherwise(F.col(c)) for c, value in values.items()}
    return df.select(*[merged.get(c, F.col(c)).alias(c) for c in columns])


# --- order numbers and totals -----------------------------------------------


def assign_order_numbers(existing: DataFrame, new: DataFrame, arrival: list[str]) -> DataFrame:
    """Number the new orders that have none, as if they arrived one by one.

    Every order continues from the highest number so far, which an explicit
    number earlier in the batch may raise. With c(i) the count of unnumbered
    orders up to i, the number of i is c(i) + max(highest existing,
    max over earlier explicit e(j) of e(j) - c(j)): two running totals.
    """
    highest = existing.agg(F.max(number_value(F.col("order_number")))).first()[0] or 0
    missing = F.coalesce(F.col("order_number"), F.lit("")) == ""
    rows = sliced(new.withColumn("_missing", missing.cast("bigint")), [], arrival, "order-numbers")
    counted = running(rows, [], arrival, _nth=("sum", "_missing"))
    lead = counted.withColumn("_lead", number_value(F.col("order_number")) - F.col("_nth"))
    led = running(lead, [], arrival, _base=("max", "_lead"))
    assigned = order_number(F.col("_nth") + F.greatest(F.lit(highest), F.col("_base")))
    return led.withColumn("order_number", F.when(missing, assigned).otherwise(F.col("order_number"))).select(*new.columns)


def order_totals(orders: DataFrame, order_items: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Set stored totals to the sum of the items.

    `changed` holds the ids of orders whose items were touched, so one that
    lost its last item goes to 0. Without it, every order with items counts as
    touched, and one that never had any keeps its total.
    """
    joined, total = _with_new_total(orders, order_items, changed)
    return joined.withColumn("total_amount", total).select(*orders.columns)


def total_changes(orders: DataFrame, order_items: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """The rows of `order_totals` whose stored total was another; a `VersionedTable` rewrites only their files."""
    joined, total = _with_new_total(orders, order_items, changed)
    other = joined.where(~total.eqNullSafe(F.col("total_amount").cast(TOTAL)))
    return other.withColumn("total_amount", total).select(*orders.columns)


def _with_new_total(orders: DataFrame, order_items: DataFrame, changed: DataFrame | None) -> tuple[DataFrame, Column]:
    totals = item_totals(order_items).select("id", "amount")
    if changed is None:
        joined = orders.join(totals, "id", "left")
        total = F.coalesce(F.col("amount"), F.col("total_amount"))
    else:
        touched = changed.select("id").distinct().withColumn("_touched", F.lit(True))
        joined = orders.join(touched, "id", "left").join(totals, "id", "left")
        total = F.when(F.col("_touched"), F.coalesce(F.col("amount"), F.lit(0))).otherwise(F.col("total_amount"))
    return joined, total.cast(TOTAL)


# --- checks shared by inserts and patches ------------------------------------


def _known_by(rows: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Left join on a column that most rows leave out: rows without it are not shuffled to meet in one task."""
    given = F.col(column).isNotNull()
    found = rows.where(given).join(known, column, "left")
    return found.unionByName(rows.where(~given), allowMissingColumns=True)


def _with_link(batch: DataFrame, table: str, t: Tables, switches: DataFrame | None = None) -> DataFrame:
    """Add `_link_ok`: the category a row points to exists and is active when the row arrives."""
    column = _CATEGORY_LINK.get(table)
    if column is None or column not in batch.columns:
        return batch.withColumn("_link_ok", F.lit(True))
    states = t.categories.select(F.col("id").alias(column), F.col("is_active").alias("_stored"))
    known = _known_by(batch, states, column)
    state = F.col("_stored")
    if switches is not None:
        known = _with_last_switch(known, column, switches)
        state = F.coalesce(F.col("_switch") == ON, state)
    found = F.col(column).isNull() | F.coalesce(state, F.lit(False))
    return known.withColumn("_link_ok", found).select(*batch.columns, "_link_ok")


# What a patch makes of the flag of its category; WAITING while it is not known whether it is taken.
OFF, ON, WAITING = 0, 1, 2


def _with_last_switch(rows: DataFrame, column: str, switches: DataFrame) -> DataFrame:
    """Add `_switch`: what the last switch (id, seq, switch) before a row's `seq` did to the category it names.

    An as-of join: rows and switches are sorted together by category and `seq`, in slices that no
    single category can fill, and a row takes the largest switch so far. NULL without one.
    """
    event = F.col("seq") * 4 + F.col("switch")
    events = switches.select(F.col("id").alias(column), F.col("seq").alias("_at"), event.alias("_event"))
    given = F.col(column).isNotNull()
    # A row comes before the switch of its own `seq`: NULLs are first.
    both = rows.where(given).withColumn("_at", F.col("seq")).unionByName(events, allowMissingColumns=True)
    order = ["_at", "_event"]
    swept = running(sliced(both, [column], order, "switches"), [column], order, _last=("max", "_event"))
    found = swept.where("_event IS NULL").withColumn("_switch", F.pmod("_last", F.lit(4)))
    return found.select(*rows.columns, "_switch").unionByName(rows.where(~given), allowMissingColumns=True)


def category_switches(t: Tables, patches: DataFrame) -> DataFrame:
    """The switches (id, seq, switch) that category patches make, if taken in the order of their `seq`.

    A patch that also moves its category is taken only if the new parent is active just then, which
    an earlier switch of the parent decides. Patches whose answer is known settle, round by round: there
    are as many rounds as the longest chain of patches that move and switch, each below the
    category of the one before.
    """
    fields = [c for c in PATCH_FIELDS["categories"] if c in patches.columns]
    if "is_active" not in fields:
        return patches.limit(0).select("id", "seq", F.lit(OFF).alias("switch"))
    sent = record_rules(patches.where("is_active IS NOT NULL").select("seq", "id", *fields), "categories", "patch")
    sound = sent.where(F.size(VIOLATIONS) == 0).join(t.categories.select("id"), "id", "left_semi")
    parent = F.col("parent_id") if "parent_id" in fields else F.lit(None).cast("bigint")
    states = t.categories.select(F.col("id").alias("parent_id"), F.col("is_active").alias("_stored"))
    sound = _known_by(sound.select("id", "seq", parent.alias("parent_id"), F.col("is_active").cast("int").alias("switch")), states, "parent_id")
    sound = cut_lineage(sound, "switching-patches")
    columns = ["id", "seq", "switch"]
    taken = sound.where("parent_id IS NULL").select(*columns)
    waiting = sound.where("parent_id IS NOT NULL")
    while not waiting.isEmpty():
        events = taken.unionByName(waiting.select("id", "seq", F.lit(WAITING).alias("switch")))
        seen = cut_lineage(_with_last_switch(waiting, "parent_id", events), "switch-round")
        settled = seen.where(F.coalesce(F.col("_switch"), F.lit(OFF)) != WAITING)
        active = F.coalesce(F.col("_switch") == ON, F.col("_stored"))
        taken = cut_lineage(taken.unionByName(settled.where(active).select(*columns)), "switches-taken")
        waiting = seen.where(F.col("_switch") == WAITING).select(*waiting.columns)
    return taken


def _with_holders(batch: DataFrame, table: str, t: Tables) -> DataFrame:
    """Add lowest and highest id of the stored rows that hold a row's unique value."""
    column = _UNIQUE.get(table)
    none = F.lit(None).cast("bigint")
    if column is None or column not in batch.columns:
        return batch.withColumn("_low", none).withColumn("_high", none)
    holders = t.unique.get(table, getattr(t, table)).groupBy(column).agg(F.min("id").alias("_low"), F.max("id").alias("_high"))
    wanted = F.when(F.col(column) != "", F.col(column))
    holders = holders.withColumnRenamed(column, "_wanted")
    return _known_by(batch.withColumn("_wanted", wanted), holders, "_wanted").drop("_wanted")


def _with_place(rows: DataFrame, categories: DataFrame, parent: str) -> DataFrame:
    """Add `_path` and `_level`, as far as categories store them, from the parent before the batch."""
    stored = [c for c in ("path", "level") if c in categories.columns]
    above = categories.select(F.col("id").alias("_above"), *[F.col(c).alias(f"_above_{c}") for c in stored])
    root, own = F.col(parent).isNull(), F.col("id").cast("string")
    place = {
        "path": F.when(root, own).otherwise(F.concat("_above_path", F.lit("."), own)),
        "level": F.when(root, 0).otherwise(F.col("_above_level") + 1),
    }
    joined = rows.join(above, F.col(parent) == F.col("_above"), "left")
    return joined.select(*rows.columns, *[place[c].alias(f"_{c}") for c in stored])


# --- patches -----------------------------------------------------------------


def patch_apply(
    table: str,
    t: Tables,
    patches: DataFrame,
    actor: str = ACTOR,
    now: Column | None = None,
    switches: DataFrame | None = None,
) -> Applied:
    """Apply partial updates: given fields replace, missing ones stay.

    `patches` has `seq`, `id` and any of the table's patch fields. Several
    patches of one row merge, the later value of a field winning. A field
    cannot be set to NULL. A changed category takes path and level from its
    parent as that was before the batch; nodes below it keep theirs.

    `switches`, from `category_switches`, share the count of `seq` with the patches:
    a category is then active or not as the switches before a patch left it.
    """
    old = getattr(t, table)
    fields = [c for c in PATCH_FIELDS[table] if c in patches.columns and c in old.columns]
    known = old.select("id", F.lit(True).alias("_known"))
    batch = record_rules(patches.select("seq", "id", *fields), table, "patch").join(known, "id", "left")
    batch = _with_holders(_with_link(batch, table, t, switches), table, t)
    unique = _UNIQUE.get(table)
    unique_broken = "sku_taken" if table == "nomenclature" else "email_taken"
    link_broken = "parent_not_found" if table == "categories" else "category_not_found"
    empty = F.coalesce(*[F.col(c).cast("string") for c in fields]).isNull()
    reason = first_reason(
        (F.size(VIOLATIONS) > 0, "invalid_fields"),
        (F.col("_known").isNull(), "unknown_id"),
        (~F.col("_link_ok"), link_broken),
        ((F.col("_low") != F.col("id")) | (F.col("_high") != F.col("id")), unique_broken),
        (empty, "nothing_to_change"),
    )
    reviewed = batch.withColumn("reason", reason).select("seq", "id", *fields, VIOLATIONS, "reason")
    reviewed = cut_lineage(reviewed, "patches")
    if unique in fields:
        reviewed = _first_claim_wins(reviewed, unique, "id", unique_broken)
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}") for c in fields]
    merged = reviewed.where("reason IS NULL").groupBy("id").agg(*latest, F.lit(True).alias("_changed"))
    values = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in fields}
    if table == "categories":
        sent = [F.col("_parent_id")] if "parent_id" in fields else []
        parents = old.select("id", F.col("parent_id").alias("_old_parent"))
        at = merged.join(parents, "id").withColumn("_at", F.coalesce(*sent, "_old_parent"))
        merged = _with_place(at, old, "_at").drop("_at", "_old_parent")
        values |= {c: F.col(f"_{c}") for c in ("path", "level") if c in old.columns}
    changed = F.col("_changed").isNotNull()
    patched = _stamped(old.join(merged, "id", "left"), old.columns, values, changed, actor, now)
    differing = _stamped(old.join(merged, "id"), old.columns, values, F.lit(True), actor, now)
    return Applied(patched, reviewed.where("reason IS NOT NULL"), differing)


def _first_claim_wins(batch: DataFrame, column: str, owner: str, code: str) -> DataFrame:
    """Refuse rows whose unique value an earlier accepted row of another owner claims."""
    claims = (
        batch.where(F.col("reason").isNull() & (F.col(column) != ""))
        .groupBy(column)
        .agg(F.min_by(owner, "seq").alias("_first"))
    )
    late = F.col("_first") != F.col(owner)
    return (
        _known_by(batch, claims, column)
        .withColumn("reason", F.coalesce("reason", F.when(late, F.lit(code))))
        .select(*batch.columns)
    )


# --- inserts -----------------------------------------------------------------


def insert_batch(
    table: str,
    t: Tables,
    batch: DataFrame,
    actor: str = ACTOR,
    now: Column | None = None,
    null_parents_equal: bool = True,
    switches: DataFrame | None = None,
) -> Applied:
    """Validate new categories, clients or products, give them ids and append them.

    Ids continue from the highest one in order of arrival. A sent active flag
    is ignored: new rows start active. `switches` are those of `patch_apply`.
    """
    old = getattr(t, table)
    fields = [c for c in INSERT_FIELDS[table] if c in batch.columns]
    linked = _with_link(record_rules(batch.select("seq", *fields), table), table, t, switches)
    checked = _with_holders(linked, table, t)
    link_broken = "parent_not_found" if table == "categories" else "category_not_found"
    unique_broken = {"categories": "name_taken", "clients": "email_taken", "nomenclature": "sku_taken"}[table]
    if table == "categories":
        checked = _with_sibling(checked, t, null_parents_equal)
        taken = F.col("_sibling").isNotNull()
    else:
        taken = F.col("_low").isNotNull()
    reason = first_reason(
        (F.size(VIOLATIONS) > 0, "invalid_fields"), (~F.col("_link_ok"), link_broken), (taken, unique_broken)
    )
    reviewed = checked.withColumn("reason", reason).select("seq", *fields, VIOLATIONS, "reason")
    reviewed = cut_lineage(reviewed, "inserts")
    if table == "categories":
        claimed = F.struct("parent_id", "name")
        if not null_parents_equal:
            claimed = F.when(F.col("parent_id").isNotNull(), claimed)
        reviewed = _first_row_wins(reviewed, claimed, unique_broken)
    elif _UNIQUE[table] in fields:
        value = F.col(_UNIQUE[table])
        reviewed = _first_row_wins(reviewed, F.when(value != "", value), unique_broken)
    highest = old.agg(F.max("id")).first()[0] or 0
    accepted = numbered(reviewed.where("reason IS NULL").drop("reason", VIOLATIONS), ["seq"], "_nth", "inserts")
    filled = with_defaults(accepted.withColumn("id", F.col("_nth") + highest), table, now, actor)
    if table == "categories":
        filled = _with_place(filled, old, "parent_id")
        filled = filled.withColumns({c: F.col(f"_{c}") for c in ("path", "level") if c in old.columns})
    types = {f.name: f.dataType for f in SCHEMAS[table].fields}
    # Kept as a table: generated keys and times must not change from one read to the next.
    new = filled.select(*[F.col(c).cast(types.get(c, old.schema[c].dataType)) for c in old.columns])
    new = cut_lineage(new, "inserted")
    return Applied(old.unionByName(new), reviewed.where("reason IS NOT NULL"), new)


def _with_sibling(batch: DataFrame, t: Tables, null_parents_equal: bool) -> DataFrame:
    """Add `_sibling`: an active category of that name under the same parent exists."""
    names = t.categories.where("is_active").select(F.col("parent_id").alias("_parent"), F.col("name").alias("_name"))
    names = names.distinct().withColumn("_sibling", F.lit(True))
    parent = F.col("parent_id")
    same_parent = parent.eqNullSafe(F.col("_parent")) if null_parents_equal else parent == F.col("_parent")
    return batch.join(names, (F.col("name") == F.col("_name")) & same_parent, "left").drop("_parent", "_name")


def _first_row_wins(batch: DataFrame, value: Column, code: str) -> DataFrame:
    """Refuse accepted rows whose value an earlier accepted row of the batch has."""
    claimed = batch.withColumn("_value", value)
    first = claimed.where("reason IS NULL AND _value IS NOT NULL").groupBy("_value").agg(F.min("seq").alias("_first"))
    late = F.col("seq") > F.col("_first")
    return (
        _known_by(claimed, first, "_value")
        .withColumn("reason", F.coalesce("reason", F.when(late, F.lit(code))))
        .select(*batch.columns)
    )


# --- deletes -----------------------------------------------------------------


def guarded_delete(table: str, t: Tables, ids: DataFrame) -> Applied:
    """Delete rows nothing refers to; `rejected` says why the others stay."""
    old = getattr(t, table)
    wanted = ids.select("id").distinct()

    def used(rows: DataFrame, column: str, flag: str) -> DataFrame:
        return rows.select(F.col(column).alias("id")).distinct().withColumn(flag, F.lit(True))

    state = ["id", "status"] if table == "orders" else ["id"]
    found = wanted.join(old.select(*state, F.lit(True).alias("_known")), "id", "left")
    checks: list[tuple[Column, str]] = [(F.col("_known").isNull(), "unknown_id")]
    guards = {
        "categories": [(t.categories, "parent_id", "has_children"), (t.nomenclature, "category_id", "has_products")],
        "clients": [(t.orders, "client_id", "has_orders")],
        "nomenclature": [(t.order_items, "nomenclature_id", "in_orders")],
        "orders": [],
    }
    for rows, column, code in guards[table]:
        found = found.join(used(rows, column, f"_{code}"), "id", "left")
        checks.append((F.col(f"_{code}").isNotNull(), code))
    if table == "orders":
        checks.append((F.col("status").isin(*LOCKED_STATUSES), "locked_status"))
    outcome = cut_lineage(found.select("id", first_reason(*checks).alias("reason")), "deletes")
    gone = outcome.where("reason IS NULL")
    return Applied(old.join(gone, "id", "left_anti"), outcome.where("reason IS NOT NULL"), gone=gone.select("id"))


@dataclass(frozen=True)
class OrdersDeleted:
    """What is left, the stock to give back, and the ids of the orders (`gone`) for `VersionedTable`s of orders and items."""

    orders: DataFrame
    order_items: DataFrame
    stock_deltas: DataFrame
    gone: DataFrame


def cascade_delete(t: Tables, order_ids: DataFrame) -> OrdersDeleted:
    """Remove orders with their items and hand their quantities back to stock."""
    gone = order_ids.select("id").distinct()
    items_gone = gone.select(F.col("id").alias("order_id"))
    return OrdersDeleted(
        orders=t.orders.join(gone, "id", "left_anti"),
        order_items=t.order_items.join(items_gone, "order_id", "left_anti"),
        stock_deltas=order_stock_deltas(t.order_items, gone, 1),
        gone=gone,
    )


def delete_subtree(t: Tables, ids: DataFrame, index: SubtreeIndex | None = None) -> Applied:
    """Remove categories together with everything below them.

    A category stays, with its whole subtree, when a product belongs to any node
    of it. Each id is judged on the tables as they were before the batch. With an
    `index` of these categories subtrees are a range join, else a walk.
    """
    wanted = ids.select("id").distinct()
    nodes = index.below(wanted) if index else below(t.categories, wanted)
    used = t.nomenclature.select(F.col("category_id").alias("descendant_id")).distinct()
    blocked = nodes.join(used, "descendant_id", "left_semi").select(F.col("ancestor_id").alias("id")).distinct()
    known = t.categories.select("id", F.lit(True).alias("_known"))
    found = wanted.join(known, "id", "left").join(blocked.withColumn("_used", F.lit(True)), "id", "left")
    reason = first_reason((F.col("_known").isNull(), "unknown_id"), (F.col("_used").isNotNull(), "has_products"))
    outcome = cut_lineage(found.select("id", reason.alias("reason")), "deletes")
    allowed = outcome.where("reason IS NULL").select(F.col("id").alias("ancestor_id"))
    gone = nodes.join(allowed, "ancestor_id", "left_semi").select(F.col("descendant_id").alias("id"))
    return Applied(t.categories.join(gone, "id", "left_anti"), outcome.where("reason IS NOT NULL"), gone=gone)
