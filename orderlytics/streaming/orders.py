"""Order and client totals kept up to date from change feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlytics.functions.measures import as_double, count_or_zero, or_zero
from orderlytics.functions.predicates import not_cancelled

ORDER_TOTALS_SCHEMA = "order_id bigint, amount decimal(22,2), items bigint"
ORDER_STATE_SCHEMA = "order_id bigint, client_id bigint, status string, order_date timestamp, amount decimal(22,2)"


def signed_changes(feed: DataFrame) -> DataFrame:
    """Amount and count each change adds to its order.

    A feed row has `op` (insert, update, delete), `order_id`, and the item total
    before (`old_total`) and after (`new_total`): an update carries both.
    """
    none = F.lit(0).cast("decimal(12,2)")
    old = F.when(F.col("op") != "insert", F.col("old_total")).otherwise(none)
    new = F.when(F.col("op") != "delete", F.col("new_total")).otherwise(none)
    items = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0)
    return feed.select("order_id", (new - old).cast("decimal(12,2)").alias("change"), items.alias("items"))


def order_total_changes(feed: DataFrame) -> DataFrame:
    """Running total and item count per order; a stream in update mode."""
    return (
        signed_changes(feed)
        .groupBy("order_id")
        .agg(F.sum("change").alias("amount"), F.sum("items").alias("items"))
    )


def unique_changes(
    feed: DataFrame, lateness: str, seen: DataFrame | None = None, latest: int | None = None
) -> DataFrame:
    """Drop repeated deliveries of one `change_id` that arrive within `lateness` of `ts`.

    A stream looks up every row in its state store, which suits many small batches.
    With `seen`, `feed` is one micro-batch: `seen` has `change_id` and `ts` of what
    earlier ones kept, `latest` is the microsecond the watermark follows. Rows and ids
    meet in one sorted aggregate, so a batch costs a shuffle of both and no lookups.
    A change without `ts` is never late, and its id is not forgotten.
    """
    if seen is None:
        return feed.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["change_id"])
    if latest is not None:
        # Rows behind the watermark are late; an id expires when the watermark is `lateness` beyond its time.
        watermark = F.timestamp_micros(F.lit(latest)) - _delay(lateness)
        feed = feed.where(F.col("ts").isNull() | (F.col("ts") > watermark))
        seen = seen.where(F.col("ts").isNull() | (F.col("ts") > watermark - _delay(lateness)))
    rows = feed.select("change_id", F.struct(*feed.columns).alias("row"), F.lit(False).alias("known"))
    ids = seen.select("change_id", F.lit(None).cast(rows.schema["row"].dataType).alias("row"), F.lit(True).alias("known"))
    first, known = F.first("row", ignorenulls=True).alias("row"), F.bool_or("known").alias("known")
    found = rows.unionByName(ids).groupBy("change_id").agg(first, known)
    return found.where(~F.col("known")).select("row.*")


def _delay(lateness: str) -> Column:
    """The delay of a watermark, whose months have 31 days."""
    year, month, day, hour, minute, second = (
        F.expr(f"extract({unit} FROM CAST('{lateness}' AS INTERVAL))")
        for unit in ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND")
    )
    return F.make_dt_interval(31 * (12 * year + month) + day, hour.cast("int"), minute.cast("int"), second)


def order_states(orders: DataFrame, items: DataFrame) -> DataFrame:
    """One row per order from two feeds that may arrive in any order; a stream in update mode.

    `orders` tells what an order is at `seq`: id, client_id, status, order_date.
    It may tell an order again, cancelled, revived or under another client; the
    highest `seq` holds, whenever it arrives. `items` are changes as
    `signed_changes` takes them. Amounts whose order has not been told yet wait
    in the same state, under a NULL client.
    """
    told = orders.select(
        F.col("id").alias("order_id"),
        F.struct("seq", "client_id", "status", F.col("order_date").cast("timestamp").alias("order_date")).alias("told"),
        F.lit(0).cast("decimal(12,2)").alias("change"),
    )
    changes = signed_changes(items).select("order_id", F.lit(None).cast(told.schema["told"].dataType).alias("told"), "change")
    states = told.unionByName(changes).groupBy("order_id").agg(F.max("told").alias("told"), F.sum("change").alias("amount"))
    return states.select("order_id", "told.client_id", "told.status", "told.order_date", "amount")


def client_sides(states: DataFrame) -> DataFrame:
    """Live orders, last order and ordered amount per client, from the latest state of each order.

    A cancelled order is one row that no longer counts, so nothing has to be
    taken back from a client's totals.
    """
    live = states.where(F.col("client_id").isNotNull() & not_cancelled())
    return live.groupBy("client_id").agg(
        F.count(F.lit(1)).alias("orders"), F.max("order_date").alias("last_order"), F.sum("amount").alias("amount")
    )


def client_summary(clients: DataFrame, states: DataFrame) -> DataFrame:
    """Active clients with what the feeds told of their orders: the client order summary."""
    last: Column = F.col("last_order").cast("timestamp_ntz")
    return (
        clients.where("is_active")
        .select(F.col("id").alias("client_id"), F.col("name").alias("client_name"))
        .join(client_sides(states), "client_id", "left")
        .select(
            "client_id",
            "client_name",
            or_zero(as_double(F.col("amount"))).alias("total_amount"),
            count_or_zero(F.col("orders")).alias("orders_count"),
            last.alias("last_order"),
        )
    )
