"""Order intake: accept or refuse a batch of orders against the stock.

The result is that of taking the orders one by one in order of arrival. An
order is refused for an unknown or inactive client; for the first of its items
whose product is unknown or inactive, whose stock, after all orders accepted
before, is too small, or whose price is no longer current; and finally for
listing a product twice. Refused orders take no stock.

Whether an order fits depends on earlier decisions. While more lines are open
than one task should walk, decisions are found in rounds: per product, in order
of arrival, two running totals bound what the earlier orders take, the accepted
ones alone, and the accepted and undecided ones together. An order whose every
line fits under the larger total is accepted, one with a line that does not fit
under the smaller is refused, the others stay open. Long chains of orders that
wait for each other gain little from a round, so a round that leaves more than
half of the open orders open is the last.

What is open then is walked in order of arrival, at most `SERIAL_LINES` lines in
a task, one such stretch after the other; what a stretch takes is taken off the
stock of the next. With n open orders and m lines there are at most log2(n) + 1
rounds and 2 m / SERIAL_LINES + 1 stretches, however the orders depend on each
other. All ways give the serial result.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlytics.operators.changes import first_reason
from orderlytics.operators.running import SLICE, running, sliced
from orderlytics.session import cut_lineage, read_back, scratch_path, write_counted

log = logging.getLogger(__name__)

# Lines that one task walks in order of arrival; it holds the stock of their products.
SERIAL_LINES = 4_000_000
# After this many rounds the contested lines are rewritten without the orders
# refused and the products settled so far.
ROUNDS_PER_REWRITE = 4


def order_intake(
    orders: DataFrame,
    items: DataFrame,
    clients: DataFrame,
    products: DataFrame,
    arrival: Sequence[str],
    item_key: Sequence[str] = ("id",),
    serial_lines: int = SERIAL_LINES,
) -> DataFrame:
    """Decide every order: `id, accepted, reason, nomenclature_id` (the product at fault).

    `arrival` names order columns whose values give the unique order of
    arrival; `item_key` orders the items of one order.
    """
    # Own names, since orders and items may both call their key `id`; what a line has anyway is not held twice.
    arrived = ["order_id" if c == "id" else f"_arrival{n}" for n, c in enumerate(arrival)]
    places = [c if c in _LINE else f"_place{n}" for n, c in enumerate(item_key)]
    offers = orders.withColumns({"order_id": F.col("id"), **{a: F.col(c) for a, c in zip(arrived, arrival)}})
    wanted = _wanted(items.withColumns({p: F.col(c) for p, c in zip(places, item_key)}), products, places)
    judged = _review_orders(offers, clients, wanted, arrived)
    lines = _lines(judged, wanted, arrived, places)
    # An order is told of once for every active client row that has its client's id.
    reviewed = judged.withColumn("_told", F.explode(F.sequence(F.lit(1), F.greatest("_active", F.lit(1))))).drop("_told")
    taken_by = _accepted_orders(reviewed, lines, arrived, serial_lines)
    faults = _line_faults(lines, taken_by, places)
    return (
        reviewed.join(taken_by.withColumn("_accepted", F.lit(True)), "id", "left")
        .join(faults, "id", "left")
        .select(
            "id",
            F.col("_accepted").isNotNull().alias("accepted"),
            F.when(
                F.col("_accepted").isNull(),
                first_reason(
                    (F.col("lines").isNull(), "items_missing"),
                    (F.col("invalid"), "invalid_fields"),
                    (~F.col("client_ok"), "client_not_found"),
                    (F.col("fault") == 1, "product_not_found"),
                    (F.col("fault") == 2, "stock_too_small"),
                    (F.col("fault") == 3, "price_changed"),
                    (F.col("repeated"), "product_repeated"),
                ),
            ).alias("reason"),
            F.when(
                F.col("_accepted").isNull() & F.col("lines").isNotNull() & ~F.col("invalid") & F.col("client_ok"),
                F.col("fault_product"),
            ).alias("nomenclature_id"),
        )
    )


# What every line keeps of its item, and the number of its place among those of its product.
_LINE = ("order_id", "nomenclature_id", "quantity")
_AT = "_at"


def _besides(columns: Sequence[str]) -> list[str]:
    """Columns that a line does not keep anyway."""
    return [c for c in columns if c not in _LINE]


def _wanted(items: DataFrame, products: DataFrame, item_key: Sequence[str]) -> DataFrame:
    """Items with the stock of their product and what is wrong with them whatever the stock."""
    offered = products.where("is_active").select(
        F.col("id").alias("nomenclature_id"), F.col("quantity").alias("stock"), F.col("price").alias("current_price")
    )
    found = items.select(*_LINE, "price", *_besides(item_key)).join(offered, "nomenclature_id", "left")
    # Stock only ever shrinks, so quantities must be positive; what is missing is not valid either.
    valid = F.coalesce((F.col("quantity") > 0) & (F.col("price") >= 0), F.lit(False))
    return found.withColumns(
        {"invalid": ~valid, "price_changed": ~F.col("price").eqNullSafe(F.col("current_price"))}
    ).drop("price", "current_price")


def _lines(judged: DataFrame, wanted: DataFrame, arrival: Sequence[str], item_key: Sequence[str]) -> DataFrame:
    """Order lines with arrival and whether their order is possible, sliced by product and arrival."""
    offers = judged.select(F.col("id").alias("order_id"), *_besides(arrival), "possible")
    lines = wanted.drop("invalid").join(offers, "order_id")
    order = [c for c in dict.fromkeys([*arrival, *item_key]) if c != "nomenclature_id"]
    return sliced(lines, ["nomenclature_id"], order, "intake-lines", at=_AT)


def _review_orders(orders: DataFrame, clients: DataFrame, wanted: DataFrame, arrival: Sequence[str]) -> DataFrame:
    """What is wrong with an order whatever the stock: one row per order with its arrival, kept as a table.

    Each of several orders with one id has the items of all of them, so it repeats every product.
    """
    per_product = wanted.groupBy("order_id", "nomenclature_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.max(F.col("invalid")).alias("invalid"),
        F.max(F.col("stock").isNull() | F.col("price_changed") | F.col("invalid")).alias("broken"),
    )
    per_order = per_product.groupBy(F.col("order_id").alias("id")).agg(
        F.sum("lines").alias("lines"),
        F.max("broken").alias("broken"),
        F.max("invalid").alias("invalid"),
        F.max(F.col("lines") > 1).alias("repeated"),
    )
    shared = orders.groupBy("id").agg(F.count(F.lit(1)).alias("_orders")).where("_orders > 1")
    active = clients.where("is_active").select(F.col("id").alias("client_id"), F.lit(True).alias("_one"))
    active = active.groupBy("client_id").agg(F.count("_one").cast("int").alias("_active"))
    reviewed = orders.select("id", "client_id", *_besides(arrival)).join(per_order, "id", "left").join(shared, "id", "left")
    reviewed = reviewed.withColumn("repeated", F.col("repeated") | (F.col("lines").isNotNull() & F.col("_orders").isNotNull()))
    reviewed = reviewed.withColumn("lines", F.col("lines") * F.coalesce("_orders", F.lit(1))).join(active, "client_id", "left")
    client_ok = F.col("_active").isNotNull()
    possible = client_ok & F.col("lines").isNotNull() & ~F.col("broken") & ~F.col("repeated")
    return cut_lineage(
        reviewed.select(
            "id",
            *_besides(arrival),
            "lines",
            "repeated",
            F.coalesce("invalid", F.lit(False)).alias("invalid"),
            client_ok.alias("client_ok"),
            F.coalesce(possible, F.lit(False)).alias("possible"),
            "_active",
        ),
        "intake-orders",
    )


_DECIDED = "order_id bigint, fits boolean"


def _accepted_orders(
    reviewed: DataFrame, lines: DataFrame, arrival: Sequence[str], serial_lines: int = SERIAL_LINES
) -> DataFrame:
    """Ids of the accepted orders. A possible order has one line per product."""
    possible = reviewed.where("possible").select("id")
    candidates = lines.where("possible")
    # A product whose whole demand is in stock refuses nobody.
    scarce = (
        candidates.groupBy("nomenclature_id")
        .agg(F.sum("quantity").alias("demand"), F.max("stock").alias("stock"))
        .where("demand > stock")
        .select("nomenclature_id")
    )
    contested = candidates.join(scarce, "nomenclature_id", "left_semi").select(
        *_LINE, "stock", SLICE, *_besides(arrival), F.lit(False).alias("held")
    )
    spark = reviewed.sparkSession
    contested, n_lines = _counted(contested, "intake-contested")
    waiting, open_orders = _counted(contested.select("order_id").distinct(), "intake-waiting")
    base = scratch_path(spark, "intake-decisions")
    paths: list[str] = []
    fresh: list[str] = []
    worth = True
    while open_orders and worth and n_lines > serial_lines:
        if len(fresh) == ROUNDS_PER_REWRITE:
            contested, n_lines = _still_contested(contested, spark.read.schema(_DECIDED).parquet(*fresh))
            fresh = []
            continue
        lines_now = contested
        if fresh:
            lines_now = _with_decisions(contested, spark.read.schema(_DECIDED).parquet(*fresh))
        path = f"{base}/{len(paths)}"
        decided = write_counted(_decide(lines_now, arrival), path)
        if decided == 0:
            raise RuntimeError("a round decided no order: arrival is not a unique order")
        paths.append(path)
        fresh.append(path)
        worth = 2 * decided >= open_orders
        open_orders -= decided
        log.info("intake round %d: %d decided, %d open", len(paths), decided, open_orders)
    if open_orders:
        if fresh:
            contested, n_lines = _still_contested(contested, spark.read.schema(_DECIDED).parquet(*fresh))
        paths += _walked(contested, n_lines, arrival, serial_lines, base)

    undisputed = possible.join(waiting.select(F.col("order_id").alias("id")), "id", "left_anti")
    if not paths:
        return undisputed
    won = spark.read.schema(_DECIDED).parquet(*paths).where("fits").select(F.col("order_id").alias("id"))
    return undisputed.unionByName(won)


def _counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    path = scratch_path(df.sparkSession, label)
    rows = write_counted(df, path)
    return read_back(df, path), rows


def _still_contested(contested: DataFrame, decided: DataFrame) -> tuple[DataFrame, int]:
    """Without the lines of refused orders and the products that no open order wants."""
    known = _with_decisions(contested, decided)
    still_open = known.where("NOT held").select("nomenclature_id").distinct()
    return _counted(known.join(still_open, "nomenclature_id", "left_semi"), "intake-contested")


def _walked(lines: DataFrame, n_lines: int, arrival: Sequence[str], serial_lines: int, base: str) -> list[str]:
    """Decide the open orders in order of arrival, stretch after stretch; the folders with the verdicts."""
    spark: SparkSession = lines.sparkSession
    if n_lines <= serial_lines:
        write_counted(_walk(lines, arrival), f"{base}/walk-0")
        return [f"{base}/walk-0"]
    orders = lines.groupBy("order_id", *_besides(arrival)).agg(F.count(F.lit(1)).alias("lines"))
    upto = running(sliced(orders, [], arrival, "intake-stretches"), [], arrival, upto=("sum", "lines"))
    # An order belongs to the stretch its last line falls in.
    stretch = F.floor((F.col("upto") - 1) / serial_lines).cast("int").alias("stretch")
    placed = cut_lineage(lines.join(upto.select("order_id", stretch), "order_id"), "intake-stretched")
    paths: list[str] = []
    for number in range(-(-n_lines // serial_lines)):
        now = placed.where(F.col("stretch") == number)
        if number:
            won = spark.read.schema(_DECIDED).parquet(*paths).where("fits").select("order_id", F.lit(True).alias("won"))
            before = placed.where(F.col("stretch") < number).join(won, "order_id", "left").where("held OR won")
            taken = before.groupBy("nomenclature_id").agg(F.sum("quantity").alias("taken"))
            now = now.join(taken, "nomenclature_id", "left").withColumn(
                "stock", F.col("stock") - F.coalesce("taken", F.lit(0))
            )
        paths.append(f"{base}/walk-{number}")
        write_counted(_walk(now, arrival), paths[-1])
    return paths


def _walk(lines: DataFrame, arrival: Sequence[str]) -> DataFrame:
    rows = lines.select(
        F.col("order_id").cast("bigint").alias("order_id"), "nomenclature_id", "quantity", "stock", "held", *_besides(arrival)
    )
    rows = rows.repartition(1).sortWithinPartitions(*arrival, "order_id")
    return rows.select("order_id", "nomenclature_id", "quantity", "stock", "held").mapInArrow(_one_by_one, _DECIDED)


def _one_by_one(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verdicts on the open orders among lines in order of arrival; held orders take their quantities."""
    left: dict = {}
    order, wanted, held = None, [], False

    def settle() -> bool:
        fits = held or all(left[p] >= n for p, n in wanted)
        if fits:
            for p, n in wanted:
                left[p] -= n
        return fits

    for batch in batches:
        verdicts = []
        for own, product, quantity, stock, taken in zip(*(c.to_pylist() for c in batch.columns)):
            if own != order:
                if wanted and not held:
                    verdicts.append((order, settle()))
                elif wanted:
                    settle()
                order, wanted, held = own, [], taken
            left.setdefault(product, stock)
            wanted.append((product, quantity))
        yield _verdicts(verdicts)
    if wanted and not held:
        yield _verdicts([(order, settle())])


def _verdicts(rows: list[tuple[int, bool]]) -> pa.RecordBatch:
    ids, fits = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fits, pa.bool_())], ["order_id", "fits"])


def _with_decisions(contested: DataFrame, decided: DataFrame) -> DataFrame:
    """Drop lines of refused orders and mark those of accepted ones as held."""
    joined = contested.join(decided, "order_id", "left").where("fits IS NULL OR fits")
    return joined.withColumn("held", F.col("held") | F.col("fits").isNotNull()).drop("fits")


def _decide(lines: DataFrame, arrival: Sequence[str]) -> DataFrame:
    """Orders this round settles, with the verdict."""
    amounts = lines.withColumns(
        {
            "_wanted": F.col("quantity").cast("bigint"),
            "_held": F.when(F.col("held"), F.col("quantity")).otherwise(0).cast("bigint"),
        }
    )
    totals = running(amounts, ["nomenclature_id"], arrival, most=("sum", "_wanted"), least=("sum", "_held"))
    return (
        totals.where(~F.col("held"))
        .groupBy("order_id")
        .agg(
            F.min(F.col("most") <= F.col("stock")).alias("fits"),
            F.max(F.col("least") + F.col("_wanted") > F.col("stock")).alias("fails"),
        )
        .where("fits OR fails")
        .select("order_id", "fits")
    )


def _line_faults(lines: DataFrame, accepted: DataFrame, item_key: Sequence[str]) -> DataFrame:
    """The first fault of every refused order: its kind and product."""
    own = ["order_id", "quantity", "stock", "price_changed", *_besides(item_key)]
    needed = lines.select("nomenclature_id", SLICE, _AT, "possible", *own)
    held = accepted.select(F.col("id").alias("order_id"), F.lit(True).alias("held"))
    # Only lines of possible orders need to meet the accepted ones.
    asked = needed.where("possible").join(held, "order_id", "left")
    marked = asked.unionByName(needed.where("NOT possible").withColumn("held", F.lit(None).cast("boolean")))
    # An accepted line is no more than what it takes.
    told = [F.when(F.col("held").isNull(), F.col(c)).alias(c) for c in own]
    taken = F.when(F.col("held"), F.col("quantity")).otherwise(0).cast("bigint").alias("_held")
    marked = marked.select("nomenclature_id", SLICE, _AT, *told, "held", taken)
    before = running(marked, ["nomenclature_id"], [_AT], taken=("sum", "_held"))
    fault = (
        F.when(F.col("stock").isNull(), 1)
        .when(F.col("stock") - F.col("taken") < F.col("quantity"), 2)
        .when(F.col("price_changed"), 3)
    )
    return (
        before.where("held IS NULL")
        .withColumn("fault", fault)
        .where("fault IS NOT NULL")
        .groupBy(F.col("order_id").alias("id"))
        .agg(F.min_by(F.struct("fault", "nomenclature_id"), F.struct(*item_key)).alias("_first"))
        .select("id", F.col("_first.fault").alias("fault"), F.col("_first.nomenclature_id").alias("fault_product"))
    )
