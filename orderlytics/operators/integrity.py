"""Batch validation: field rules, foreign keys, unique keys, stored totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlytics.functions.measures import as_double, count_or_zero
from orderlytics.operators.reports import item_totals
from orderlytics.schemas import ORDER_STATUSES, PAYMENT_STATUSES, SCHEMAS, TOTAL
from orderlytics.sources.tables import Tables

# A practical e-mail shape: dotted words, one @, a domain with a dot.
EMAIL = r"^[^\s@.]+(\.[^\s@.]+)*@[^\s@.]+(\.[^\s@.]+)+$"

VIOLATIONS = "violations"

# Child table, column and parent table of every foreign key.
FOREIGN_KEYS = (
    ("categories", "parent_id", "categories"),
    ("nomenclature", "category_id", "categories"),
    ("orders", "client_id", "clients"),
    ("order_items", "order_id", "orders"),
    ("order_items", "nomenclature_id", "nomenclature"),
)

# Table and columns of every unique key.
UNIQUE_KEYS = (
    ("nomenclature", ("sku",)),
    ("clients", ("email",)),
    ("orders", ("order_number",)),
    ("order_items", ("order_id", "nomenclature_id")),
)

# Active categories with both equal are one and the same to a user.
SIBLINGS = ("parent_id", "name")

Rules = dict[str, Column]


def _given(column: str) -> Rules:
    return {f"{column}_missing": F.col(column).isNotNull()}


def _length(column: str, low: int, high: int | None) -> Rules:
    size = F.char_length(F.col(column))
    rules = {}
    if low:
        rules[f"{column}_too_short"] = size >= low
    if high:
        rules[f"{column}_too_long"] = size <= high
    return rules


def _at_least_zero(column: str) -> Rules:
    return {f"{column}_negative": F.col(column) >= 0}


def _above_zero(column: str) -> Rules:
    return {f"{column}_not_positive": F.col(column) > 0}


def _one_of(column: str, values: tuple[str, ...]) -> Rules:
    return {f"{column}_unknown": F.col(column).isin(*values)}


def _storage_rules(table: str) -> Rules:
    """What the stored table guarantees. An unknown check passes, as in SQL."""
    match table:
        case "categories":
            return _given("name") | _length("name", 0, 255)
        case "nomenclature":
            return (
                _given("name") | _length("name", 0, 255) | _length("sku", 0, 100)
                | _given("quantity") | _at_least_zero("quantity")
                | _given("price") | _at_least_zero("price")
                | _at_least_zero("cost") | _given("category_id")
            )
        case "clients":
            return (
                _given("name") | _length("name", 0, 255) | _length("email", 0, 255)
                | _length("phone", 0, 20) | _given("address")
            )
        case "orders":
            return (
                _given("client_id") | _given("order_number") | _length("order_number", 0, 50)
                | _at_least_zero("total_amount")
                | _one_of("status", ORDER_STATUSES) | _one_of("payment_status", PAYMENT_STATUSES)
            )
        case "order_items":
            return (
                _given("order_id") | _given("nomenclature_id")
                | _given("quantity") | _above_zero("quantity")
                | _given("price") | _at_least_zero("price")
                | _given("total_price") | _at_least_zero("total_price")
            )


def _patch_rules(table: str) -> Rules:
    """Rules for the fields a patch may carry; a field left out passes."""
    match table:
        case "categories":
            return _length("name", 1, 255)
        case "nomenclature":
            return (
                _length("name", 1, 255) | _length("sku", 0, 100) | _at_least_zero("quantity")
                | _above_zero("price") | _at_least_zero("cost")
            )
        case "clients":
            return (
                _length("name", 1, 255) | {"email_malformed": F.col("email").rlike(EMAIL)}
                | _length("phone", 0, 20) | _length("address", 1, None)
            )
        case "orders":
            return _one_of("status", ORDER_STATUSES) | _one_of("payment_status", PAYMENT_STATUSES)
        case "order_items":
            return _above_zero("quantity") | _above_zero("price") | _above_zero("total_price")


def _input_rules(table: str) -> Rules:
    """Rules for new records: the patch rules and the fields that must be there."""
    required = {
        "categories": ("name",),
        "nomenclature": ("name", "price", "category_id"),
        "clients": ("name", "address"),
        "orders": ("client_id",),
        "order_items": ("nomenclature_id", "quantity", "price", "total_price"),
    }
    return reduce(lambda rules, column: rules | _given(column), required[table], {}) | _patch_rules(table)


RULE_SETS = {"storage": _storage_rules, "input": _input_rules, "patch": _patch_rules}


def _known_rules(df: DataFrame, table: str, rule_set: str) -> Rules:
    """The rules of a table whose columns are there."""
    if table not in SCHEMAS:
        raise ValueError(f"unknown table {table!r}")
    rules = RULE_SETS[rule_set](table)
    return {code: ok for code, ok in rules.items() if any(code.startswith(f"{c}_") for c in df.columns)}


def record_rules(df: DataFrame, table: str, rule_set: str = "input") -> DataFrame:
    """Add the array of violated rule codes; rules on absent columns are skipped."""
    broken = [F.when(~ok, F.lit(code)) for code, ok in _known_rules(df, table, rule_set).items()]
    codes = F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")
    return df.withColumn(VIOLATIONS, codes)


def order_rules(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Field rules of new orders and their items: one bad item rejects its order.

    Items are read once and reduced to one row of flags per order.
    """
    rules = _known_rules(items, "order_items", "input")
    flags = {f"_{code}": F.max(F.coalesce(~ok, F.lit(False))) for code, ok in rules.items()}
    per_order = items.groupBy(F.col("order_id").alias("id")).agg(
        F.count(F.lit(1)).alias("items_count"), *[flag.alias(name) for name, flag in flags.items()]
    )
    checked = record_rules(orders, "orders").join(per_order, "id", "left")
    empty = F.when(F.col("items_count").isNull(), F.lit("items_missing"))
    item_codes = F.array_compact(F.array(empty, *[F.when(F.col(f"_{code}"), F.lit(code)) for code in rules]))
    return checked.select(
        *orders.columns,
        count_or_zero(F.col("items_count")).alias("items_count"),
        F.concat(VIOLATIONS, item_codes).alias(VIOLATIONS),
    )


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.size(VIOLATIONS) == 0).drop(VIOLATIONS)


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where(F.size(VIOLATIONS) > 0)


def _parents(t: Tables, table: str, require_active: bool) -> DataFrame:
    rows = getattr(t, table)
    if require_active and "is_active" in rows.columns:
        rows = rows.where("is_active")
    return rows.select("id")


def fk_rejected(t: Tables, table: str, require_active: bool = False) -> DataFrame:
    """Rows with a key that points to a missing (or inactive) parent, and the `reason`; once for each such key."""
    rows = getattr(t, table)
    found = [
        # Rows without the key point nowhere and must not meet in one task.
        rows.where(F.col(column).isNotNull())
        .join(_parents(t, parent, require_active).withColumnRenamed("id", column), column, "left_anti")
        .select(*rows.columns, F.lit(f"{column}_not_found").alias("reason"))
        for child, column, parent in FOREIGN_KEYS
        if child == table
    ]
    return reduce(DataFrame.unionByName, found, rows.where("false").withColumn("reason", F.lit("")))


def unique_rejected(t: Tables, table: str, sibling_nulls_equal: bool = True) -> DataFrame:
    """All rows that share a unique key with another, and the `reason`; once for each such key.

    Active siblings with one name share a key too; roots count as siblings unless
    `sibling_nulls_equal` is off.
    """
    rows = getattr(t, table)

    def sharing(held: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        many = held.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        same = [held[c].eqNullSafe(many[c]) for c in columns]
        reason = F.lit(f"{'+'.join(columns)}_repeated").alias("reason")
        return held.join(many, same, "left_semi").select(*rows.columns, reason)

    found = [
        sharing(rows.dropna(subset=list(columns)), columns) for child, columns in UNIQUE_KEYS if child == table
    ]
    if table == "categories":
        siblings = rows.where("is_active AND name IS NOT NULL")
        found.append(sharing(siblings if sibling_nulls_equal else siblings.where("parent_id IS NOT NULL"), SIBLINGS))
    return reduce(DataFrame.unionByName, found, rows.where("false").withColumn("reason", F.lit("")))


def fk_violations(t: Tables, require_active: bool = False) -> DataFrame:
    """Keys that point to a missing (or, on input, inactive) parent, with their row counts.

    Child rows are counted per key before the join, so a key that a third of
    the rows share is one row by then.
    """

    def broken(child: str, column: str, parent: str) -> DataFrame:
        parents = _parents(t, parent, require_active)
        used = getattr(t, child).where(F.col(column).isNotNull()).groupBy(F.col(column).alias("id"))
        missing = used.agg(F.count(F.lit(1)).alias("row_count")).join(parents, "id", "left_anti")
        name = F.lit(f"{child}.{column}").alias("foreign_key")
        return missing.select(name, F.col("id").alias("missing_id"), "row_count")

    return reduce(DataFrame.unionByName, (broken(*key) for key in FOREIGN_KEYS))


def unique_violations(t: Tables, sibling_nulls_equal: bool = True) -> DataFrame:
    """Key values held by more than one row. A NULL in a key never collides.

    Active siblings with one name collide too; roots count as siblings unless
    `sibling_nulls_equal` is off, when their missing parents compare as unknown.
    """

    def repeated(name: str, rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        key = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
        many = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("row_count")).where("row_count > 1")
        return many.select(F.lit(name).alias("unique_key"), key.alias("value"), "row_count")

    found = [
        repeated(f"{table}.{'+'.join(columns)}", getattr(t, table).dropna(subset=list(columns)), columns)
        for table, columns in UNIQUE_KEYS
    ]
    siblings = t.categories.where("is_active")
    if not sibling_nulls_equal:
        siblings = siblings.where("parent_id IS NOT NULL")
    found.append(repeated("categories.parent_id+name", siblings, SIBLINGS))
    return reduce(DataFrame.unionByName, found)


def order_total_mismatch(t: Tables) -> DataFrame:
    """Orders whose stored amount is not the sum of their items."""
    computed = F.coalesce(F.col("amount"), F.lit(0).cast(TOTAL))
    return (
        t.orders.join(item_totals(t.order_items), "id", "left")
        .where(~F.col("total_amount").eqNullSafe(computed))
        .select(
            "id",
            as_double(F.col("total_amount")).alias("stored_amount"),
            as_double(computed).alias("items_amount"),
        )
    )


def item_total_mismatch(t: Tables) -> DataFrame:
    """Items whose total is not quantity times price."""
    expected = F.col("quantity") * F.col("price")
    return t.order_items.where(F.col("total_price") != expected).select(
        "order_id",
        *[c for c in t.item_key if c != "total_price"],
        as_double(F.col("total_price")).alias("total_price"),
        as_double(expected).alias("expected_price"),
    )
