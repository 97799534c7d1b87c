"""The named queries as SQL over the star-schema tables, for a second engine.

Written from the definitions, row by row and without the pre-aggregations of
the Spark jobs, so that agreement means something.
"""

from __future__ import annotations

ITEM_KEY = "nomenclature_id, l_suppkey, l_linenumber, quantity, total_price"

# The five logical tables. `orders` is also a source table, hence app_orders.
STAR = """
WITH RECURSIVE
clients AS (
  SELECT c_custkey AS id, c_name AS name,
         CASE WHEN c_custkey % 10 = 0 THEN NULL
              ELSE concat('c', CAST(c_custkey AS VARCHAR), '@example.com') END AS email,
         CAST(NULL AS VARCHAR) AS phone, c_mktsegment AS address, c_acctbal >= 0 AS is_active
  FROM customer),
app_orders AS (
  SELECT o_orderkey AS id, o_custkey AS client_id,
         concat('ORD-', CASE WHEN o_orderkey < 999999
                             THEN lpad(CAST(o_orderkey + 1 AS VARCHAR), 6, '0')
                             ELSE CAST(o_orderkey + 1 AS VARCHAR) END) AS order_number,
         o_orderdate AS order_date, CAST(o_totalprice AS DECIMAL(12,2)) AS total_amount,
         CASE WHEN o_orderstatus = 'F' THEN 'completed'
              WHEN o_orderstatus = 'O' AND o_orderpriority = '5-LOW' THEN 'refunded'
              WHEN o_orderstatus = 'O' THEN 'pending'
              WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'processing'
              ELSE 'cancelled' END AS status,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'paid' WHEN '2-HIGH' THEN 'partial'
              WHEN '5-LOW' THEN 'refunded' ELSE 'unpaid' END AS payment_status
  FROM orders),
order_items AS (
  SELECT l_orderkey AS order_id, l_partkey AS nomenclature_id, l_suppkey, l_linenumber,
         CAST(l_quantity AS INT) AS quantity,
         CAST(CAST(floor(l_extendedprice * 100 / l_quantity) AS DECIMAL(12,0))
              * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(12,2)) AS price,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS total_price, l_returnflag
  FROM lineitem),
nomenclature AS (
  SELECT p_partkey AS id, p_name AS name, p_type AS description,
         concat('SKU-', CAST(p_partkey AS VARCHAR)) AS sku, p_size AS quantity,
         CAST(p_retailprice AS DECIMAL(12,2)) AS price,
         100 + p_partkey % 25 AS category_id, p_size <= 45 AS is_active
  FROM part),
categories AS (
  SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name,
         CAST(NULL AS BIGINT) AS parent_id, 0 AS level, TRUE AS is_active FROM region
  UNION ALL
  SELECT CAST(100 + n_nationkey AS BIGINT), n_name, CAST(n_regionkey AS BIGINT), 1,
         n_nationkey % 10 <> 7 FROM nation
  UNION ALL
  SELECT CAST(1000 + s_suppkey AS BIGINT), s_name, CAST(100 + s_nationkey AS BIGINT), 2,
         TRUE FROM supplier)
"""

ORACLES: dict[str, str] = {}


def define(name: str, select: str, *ctes: str) -> None:
    ORACLES[name] = STAR + "".join(f", {cte.strip()}\n" for cte in ctes) + select.strip()


def money(expression: str) -> str:
    return f"CAST({expression} AS DOUBLE)"


def per(total: str, count: str) -> str:
    return f"{money(total)} / nullif({count}, 0)"


# --- sources -----------------------------------------------------------------

define(
    "table_scan",
    " UNION ALL ".join(
        f"SELECT '{label}' AS table_name, count(*) AS row_count, CAST(sum({key}) AS BIGINT) AS key_sum FROM {table}"
        for label, table, key in (
            ("categories", "categories", "id"),
            ("nomenclature", "nomenclature", "id"),
            ("clients", "clients", "id"),
            ("orders", "app_orders", "id"),
            ("order_items", "order_items", "order_id"),
        )
    ),
)
define(
    "partitioned_write",
    f"""
SELECT strftime(order_date, '%Y-%m') AS order_month, count(*) AS row_count, {money('sum(total_amount)')} AS amount
FROM app_orders GROUP BY 1""",
)
define(
    "insert_defaults",
    """
SELECT id, client_id, CAST(0 AS DOUBLE) AS total_amount, status, payment_status,
       'api_user' AS created_by, TRUE AS stamped
FROM app_orders""",
)

# --- reports -----------------------------------------------------------------

# One row per live order and item, or per live order without items.
LIVE = """live AS (
  SELECT o.id AS order_id, o.client_id, o.order_date, i.total_price, i.order_id AS item_of
  FROM app_orders o LEFT JOIN order_items i ON i.order_id = o.id
  WHERE o.status <> 'cancelled')"""


def _clients(extra: str) -> str:
    return f"""
SELECT c.id AS client_id, c.name AS client_name, {extra}
FROM clients c LEFT JOIN live l ON l.client_id = c.id
WHERE c.is_active GROUP BY c.id, c.name"""


AMOUNT = money("coalesce(sum(l.total_price), 0)") + " AS total_amount"
ORDERS = "count(DISTINCT l.order_id) AS orders_count"
LAST = "max(l.order_date) AS last_order"
define("client_order_summary", _clients(f"{AMOUNT}, {ORDERS}, {LAST}"), LIVE)
define(
    "client_stats",
    _clients(f"{AMOUNT}, {ORDERS}, coalesce({per('sum(l.total_price)', 'count(l.item_of)')}, 0) AS avg_order, {LAST}"),
    LIVE,
)
define(
    "client_point_stats",
    f"""
SELECT client_id, count(DISTINCT order_id) AS orders_count, {money('coalesce(sum(total_price), 0)')} AS total_spent
FROM live GROUP BY client_id""",
    LIVE,
)
for name, guard in (("top_clients", "AND c.is_active"), ("top_clients_any", "")):
    define(
        name,
        f"""
SELECT c.id AS client_id, c.name AS client_name, {money('sum(l.total_price)')} AS total_amount, {ORDERS},
       {per('sum(l.total_price)', 'count(*)')} AS avg_order, {LAST}
FROM live l, clients c
WHERE l.client_id = c.id AND l.item_of IS NOT NULL {guard}
GROUP BY c.id, c.name ORDER BY total_amount DESC, c.id LIMIT 5""",
        LIVE,
    )
define(
    "category_children_count",
    """
SELECT p.id AS category_id, p.name AS category_name,
       (SELECT count(*) FROM tree k WHERE k.parent_id = p.id AND k.depth = 1) AS children_count,
       p.level, p.full_path
FROM tree p WHERE p.depth = 0""",
    """
tree AS (
  SELECT id, name, parent_id, level, 0 AS depth, name AS full_path
  FROM categories WHERE parent_id IS NULL AND is_active
  UNION ALL
  SELECT k.id, k.name, k.parent_id, k.level, up.depth + 1, up.full_path || ' -> ' || k.name
  FROM tree up JOIN categories k ON k.parent_id = up.id AND k.is_active)""",
)
for name, fill, kind in (("category_stats", "coalesce({}, 0)", "BIGINT"), ("category_stats_nulls", "{}", "DOUBLE")):
    define(
        name,
        f"""
SELECT g.id AS category_id, g.name AS category_name, count(p.id) AS products_count,
       CAST({fill.format('sum(p.quantity)')} AS {kind}) AS total_quantity,
       {fill.format(per('sum(p.price)', 'count(p.id)'))} AS avg_price,
       {fill.format(money('min(p.price)'))} AS min_price,
       {fill.format(money('max(p.price)'))} AS max_price,
       {fill.format(money('sum(p.price * p.quantity)'))} AS total_value
FROM categories g LEFT JOIN (SELECT * FROM nomenclature WHERE is_active) p ON p.category_id = g.id
WHERE g.is_active GROUP BY g.id, g.name""",
    )
define(
    "sales_by_month",
    f"""
SELECT CAST(date_trunc('month', order_date) AS TIMESTAMP) AS month, count(DISTINCT order_id) AS orders_count,
       count(*) AS items_count, {money('sum(total_price)')} AS total_amount,
       {per('sum(total_price)', 'count(*)')} AS avg_order
FROM live WHERE item_of IS NOT NULL GROUP BY 1""",
    LIVE,
)
for name, guard in (("top_products", "AND p.is_active"), ("top_products_any", "")):
    define(
        name,
        f"""
SELECT p.id AS nomenclature_id, p.name AS product_name, p.sku, g.name AS category_name,
       CAST(sum(i.quantity) AS BIGINT) AS total_sold, {money('sum(i.total_price)')} AS total_revenue,
       count(DISTINCT o.id) AS orders_count
FROM order_items i, app_orders o, nomenclature p, categories g
WHERE o.id = i.order_id AND o.status <> 'cancelled' AND p.id = i.nomenclature_id AND g.id = p.category_id {guard}
GROUP BY p.id, p.name, p.sku, g.name ORDER BY total_revenue DESC, p.id LIMIT 10""",
    )
for name, items in (
    ("product_stats", "order_items"),
    ("product_stats_live", "(SELECT * FROM order_items WHERE order_id IN (SELECT order_id FROM live))"),
):
    define(
        name,
        f"""
SELECT p.id AS nomenclature_id, p.name, p.sku, g.name AS category_name,
       CAST(coalesce(sum(i.quantity), 0) AS BIGINT) AS total_sold,
       {money('coalesce(sum(i.total_price), 0)')} AS total_revenue,
       count(DISTINCT l.order_id) AS orders_count,
       coalesce({per('sum(i.price)', 'count(i.price)')}, 0) AS avg_price
FROM nomenclature p JOIN categories g ON g.id = p.category_id
     LEFT JOIN {items} i ON i.nomenclature_id = p.id
     LEFT JOIN (SELECT DISTINCT order_id FROM live) l ON l.order_id = i.order_id
WHERE p.is_active GROUP BY p.id, p.name, p.sku, g.name""",
        LIVE,
    )
_EFFECT = """
SELECT g.id AS category_id, g.name AS category, g.level,
       {products} AS products_in_category, count(i.order_id) AS items_in_orders,
       CAST(coalesce(sum(i.total_price), 0) AS DOUBLE) AS sales,
       CASE WHEN {products} = 0 THEN 0.0
            ELSE floor(CAST(count(i.order_id) AS DOUBLE) * 100 / {products} + 0.5) / 100 END AS ratio
FROM categories g
     LEFT JOIN nomenclature p ON p.category_id = g.id AND p.is_active
     LEFT JOIN {items} i ON i.nomenclature_id = p.id
WHERE g.is_active GROUP BY g.id, g.name, g.level"""
define("category_effectiveness", _EFFECT.format(products="count(p.id)", items="order_items"))
define(
    "category_effectiveness_strict",
    _EFFECT.format(
        products="count(DISTINCT p.id)", items="(SELECT * FROM order_items WHERE order_id IN (SELECT order_id FROM live))"
    ),
    LIVE,
)
define(
    "order_details",
    f"""
SELECT o.id AS order_id, o.order_number, c.name AS client_name, o.order_date, {money('o.total_amount')} AS total_amount,
       o.status, o.payment_status, count(*) AS items_count,
       string_agg(p.name, ', ' ORDER BY {', '.join(f'i.{k}' for k in ITEM_KEY.split(', '))}) AS products
FROM order_items i, app_orders o, clients c, nomenclature p
WHERE o.id = i.order_id AND c.id = o.client_id AND p.id = i.nomenclature_id
GROUP BY o.id, o.order_number, c.name, o.order_date, o.total_amount, o.status, o.payment_status""",
)
define(
    "order_lines",
    f"""
SELECT o.id AS order_id, o.order_number, c.name AS client_name,
       row_number() OVER (PARTITION BY o.id ORDER BY {', '.join(f'i.{k}' for k in ITEM_KEY.split(', '))}) - 1 AS position,
       i.nomenclature_id, p.name AS product_name
FROM order_items i, app_orders o, clients c, nomenclature p
WHERE o.id = i.order_id AND c.id = o.client_id AND p.id = i.nomenclature_id""",
)
define(
    "status_stats",
    f"""
SELECT status, count(*) AS orders_count, {money('sum(total_amount)')} AS total_amount,
       {per('sum(total_amount)', 'count(total_amount)')} AS avg_amount,
       min(order_date) AS first_order, max(order_date) AS last_order
FROM app_orders GROUP BY status""",
)
define(
    "seasonality",
    f"""
SELECT CAST(month(order_date) AS INT) AS month, CAST(quarter(order_date) AS INT) AS quarter, count(*) AS orders_count,
       {money('sum(total_amount)')} AS total_amount, {per('sum(total_amount)', 'count(total_amount)')} AS avg_order
FROM app_orders WHERE status <> 'cancelled' GROUP BY 1, 2""",
)
define(
    "order_stats",
    f"""
SELECT count(*) AS total_orders, {money('coalesce(sum(total_amount), 0)')} AS total_amount,
       coalesce({per('sum(total_amount)', 'count(total_amount)')}, 0) AS avg_order,
       count(*) FILTER (status = 'pending') AS pending_orders,
       count(*) FILTER (status = 'completed') AS completed_orders
FROM app_orders WHERE status <> 'cancelled'""",
)
define(
    "order_summary",
    f"""
SELECT o.id, o.order_number, o.order_date, c.name AS client_name, {money('o.total_amount')} AS total_amount, o.status,
       o.payment_status, (SELECT count(*) FROM order_items i WHERE i.order_id = o.id) AS items_count
FROM app_orders o JOIN clients c ON c.id = o.client_id""",
)

# --- hierarchy ---------------------------------------------------------------


def walk(name: str, source: str, active_only: bool) -> str:
    root, child = ("AND is_active", "AND k.is_active") if active_only else ("", "")
    return f"""
{name} AS (
  SELECT id, name, parent_id, level, 0 AS depth, name AS full_path, [id] AS ids
  FROM {source} WHERE parent_id IS NULL {root}
  UNION ALL
  SELECT k.id, k.name, k.parent_id, k.level, up.depth + 1, up.full_path || ' -> ' || k.name, list_append(up.ids, k.id)
  FROM {name} up JOIN {source} k ON k.parent_id = up.id {child})"""


ALL_NODES = walk("nodes", "categories", False)
ACTIVE_NODES = walk("nodes", "categories", True)
DOTTED = "array_to_string(ids, '.')"
PARENT = "CAST(parent_id AS DOUBLE) AS parent_id"
define(
    "category_closure", f"SELECT id, name, {PARENT}, level, depth, full_path, {DOTTED} AS path_array FROM nodes", ACTIVE_NODES
)
define("category_path", f"SELECT id, {DOTTED} AS path, CAST(len(ids) - 1 AS INT) AS level FROM nodes", ALL_NODES)
define(
    "category_hierarchy", f"SELECT id, name, {PARENT}, {DOTTED} AS path, level, depth, full_path FROM nodes", ALL_NODES
)
define(
    "category_display",
    f"SELECT id, name, level, {DOTTED} AS path, repeat('  ', level) || name AS tree_display FROM nodes",
    ALL_NODES,
)
define(
    "category_tree",
    f"""
SELECT n.id, n.name, CAST(n.parent_id AS DOUBLE) AS parent_id, n.level, array_to_string(n.ids, '.') AS path,
       CASE WHEN k.id IS NOT NULL
            THEN CAST(row_number() OVER (PARTITION BY n.id ORDER BY CAST(k.id AS VARCHAR)) - 1 AS DOUBLE) END AS position,
       CAST(k.id AS DOUBLE) AS child_id
FROM nodes n LEFT JOIN nodes k ON k.parent_id = n.id""",
    ACTIVE_NODES,
)
define(
    "three_level_names",
    """
SELECT r.name AS root, k.name AS child, g.name AS grandchild
FROM categories r LEFT JOIN categories k ON k.parent_id = r.id LEFT JOIN categories g ON g.parent_id = k.id
WHERE r.is_active AND r.parent_id IS NULL""",
)
define(
    "descendants",
    "SELECT ancestor_id, descendant_id, distance FROM pairs",
    """
pairs AS (
  SELECT parent_id AS ancestor_id, id AS descendant_id, 1 AS distance FROM categories WHERE parent_id IS NOT NULL
  UNION ALL
  SELECT c.parent_id, p.descendant_id, p.distance + 1
  FROM pairs p JOIN categories c ON c.id = p.ancestor_id AND c.parent_id IS NOT NULL)""",
)
define(
    "unreachable_nodes",
    f"SELECT id, name, {PARENT}, level FROM broken WHERE id NOT IN (SELECT id FROM nodes)",
    """
broken AS (
  SELECT id, name, level, CAST(CASE id WHEN 1 THEN (SELECT min(n_nationkey) + 100 FROM nation WHERE n_regionkey = 1)
                                       WHEN 4 THEN 999 ELSE parent_id END AS BIGINT) AS parent_id
  FROM categories)""",
    walk("nodes", "broken", False),
)

# --- search ------------------------------------------------------------------

_SPEND = f"""
SELECT c.id, c.name, c.email, c.phone, c.address, c.is_active, count(DISTINCT l.order_id) AS orders_count,
       {money('coalesce(sum(l.total_price), 0)')} AS total_spent
FROM clients c LEFT JOIN live l ON l.client_id = c.id
WHERE {{condition}} GROUP BY ALL"""
_TEXT = "(c.name ILIKE '{0}' OR c.email ILIKE '{0}' OR c.phone ILIKE '{0}')"
define("client_search", _SPEND.format(condition="c.is_active AND " + _TEXT.format("%R#%1_9%")), LIVE)
define(
    "client_search_page",
    _SPEND.format(condition="c.is_active AND " + _TEXT.format("%C1%")) + " ORDER BY c.name, c.id LIMIT 25 OFFSET 25",
    LIVE,
)
define("client_by_ids", _SPEND.format(condition="c.id IN (SELECT client_id FROM app_orders)"), LIVE)
_PRODUCT = f"""
SELECT p.id, p.name, p.description, p.sku, p.quantity, {money('p.price')} AS price, p.category_id, p.is_active,
       g.name AS category_name
FROM nomenclature p JOIN categories g ON g.id = p.category_id WHERE {{condition}}"""
define(
    "product_search",
    _PRODUCT.format(
        condition="p.is_active AND p.quantity > 0 AND p.price BETWEEN 910 AND 1050 AND "
        "(p.name ILIKE '%Ring%' OR p.sku ILIKE '%Ring%' OR p.description ILIKE '%Ring%')"
    ),
)
define("product_by_ids", _PRODUCT.format(condition="p.id IN (SELECT nomenclature_id FROM order_items)"))
_ORDER = f"""
SELECT o.id, o.client_id, o.order_number, o.order_date, {money('o.total_amount')} AS total_amount, o.status,
       o.payment_status, c.name AS client_name, count(i.order_id) AS items_count
FROM app_orders o JOIN clients c ON c.id = o.client_id LEFT JOIN order_items i ON i.order_id = o.id
WHERE {{condition}} GROUP BY ALL"""
define(
    "order_search",
    _ORDER.format(
        condition="o.status = 'completed' AND o.order_date BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31' "
        "AND o.total_amount BETWEEN 1000 AND 250000"
    ),
)
define(
    "order_search_page",
    _ORDER.format(condition="o.payment_status = 'unpaid'") + " ORDER BY o.order_date DESC, o.id LIMIT 50 OFFSET 100",
)
_CATEGORY = """
SELECT g.id, g.name, CAST(g.parent_id AS DOUBLE) AS parent_id, g.level, g.is_active,
       (SELECT count(*) FROM categories k WHERE k.parent_id = g.id AND k.is_active) AS children_count
FROM categories g WHERE """
define("category_list", _CATEGORY + "g.is_active")
define("category_by_ids", _CATEGORY + "g.id IN (SELECT parent_id FROM categories)")
define(
    "order_items_count",
    """
SELECT o.id, c.name AS client_name, count(*) AS items_count
FROM app_orders o, clients c, order_items i WHERE c.id = o.client_id AND i.order_id = o.id GROUP BY o.id, c.name""",
)
define(
    "order_with_items",
    f"""
SELECT o.id, o.client_id, o.order_number, o.status, c.name AS client_name, count(i.order_id) OVER same AS items_count,
       CASE WHEN i.order_id IS NOT NULL
            THEN CAST(row_number() OVER (same ORDER BY {', '.join(f'i.{k}' for k in ITEM_KEY.split(', '))}) - 1 AS DOUBLE)
            END AS position,
       CAST(i.nomenclature_id AS DOUBLE) AS nomenclature_id, CAST(i.quantity AS DOUBLE) AS quantity, {money('i.price')} AS price, {money('i.total_price')} AS total_price,
       p.name AS nomenclature_name, p.sku AS nomenclature_sku
FROM app_orders o JOIN clients c ON c.id = o.client_id
     LEFT JOIN order_items i ON i.order_id = o.id LEFT JOIN nomenclature p ON p.id = i.nomenclature_id
WINDOW same AS (PARTITION BY o.id)""",
)
_HEADER = f"SELECT id, client_id, order_number, order_date, {money('total_amount')} AS total_amount, status, payment_status FROM app_orders"
define("page", _HEADER + " ORDER BY order_date DESC, id LIMIT 100 OFFSET 600")
define("page_deep", _HEADER + " ORDER BY order_date DESC, id LIMIT 100 OFFSET 800")
define("page_after", _HEADER + " WHERE id > 777 ORDER BY id LIMIT 100")
define("page_index", "SELECT name, id, address FROM clients ORDER BY name, id LIMIT 80 OFFSET 40")
define("page_totals", "SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM app_orders")

# --- integrity ---------------------------------------------------------------

EMAIL = r"^[^\s@.]+(\.[^\s@.]+)*@[^\s@.]+(\.[^\s@.]+)+$"
RAW = f"""
raw_clients AS (
  SELECT c_custkey AS id, CASE c_mktsegment WHEN 'MACHINERY' THEN '' ELSE c_name END AS name,
         lower(c_mktsegment) || CASE WHEN c_acctbal < 0 THEN 'at' ELSE '@' END
           || CASE WHEN c_nationkey < 5 THEN 'localhost' ELSE 'example.com' END AS email,
         '+' || repeat('7', c_nationkey) AS phone, nullif(c_mktsegment, 'BUILDING') AS address
  FROM customer),
raw_products AS (
  SELECT p_partkey AS id, p_name AS name, p_brand AS sku, p_size - 5 AS quantity,
         CASE WHEN p_type <> 'ECONOMY' THEN CAST(p_retailprice - 950 AS DECIMAL(12,2)) END AS price,
         CAST(p_size - 3 AS DECIMAL(12,2)) AS cost,
         CASE WHEN p_brand <> 'Brand#1' THEN 100 END AS category_id
  FROM part),
raw_categories AS (
  SELECT s_suppkey + 1000 AS id,
         CASE s_nationkey % 6 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN repeat('x', 256) WHEN 3 THEN repeat('é', 255)
                              ELSE s_name END AS name
  FROM supplier),
raw_items AS (
  SELECT order_id, nomenclature_id, quantity - 3 AS quantity,
         price - CASE WHEN l_returnflag = 'R' THEN 2000 ELSE 0 END AS price, total_price
  FROM order_items),
raw_orders AS (
  SELECT id, client_id, replace(status, 'refunded', 'returned') AS status, payment_status FROM app_orders)"""


def violations(table: str, rows: str, key: str, **rules: str) -> str:
    """One row per broken rule; each rule is the condition that breaks it."""
    parts = [f"SELECT '{table}' AS table_name, {key} AS id, '{code}' AS code FROM {rows} WHERE {broken}" for code, broken in rules.items()]
    return " UNION ALL ".join(parts)


define(
    "record_rules",
    " UNION ALL ".join(
        (
            violations(
                "clients",
                "raw_clients",
                "id",
                name_too_short="length(name) < 1",
                name_too_long="length(name) > 255",
                email_malformed=f"NOT regexp_matches(email, '{EMAIL}')",
                phone_too_long="length(phone) > 20",
                address_missing="address IS NULL",
            ),
            violations(
                "nomenclature",
                "raw_products",
                "id",
                name_too_short="length(name) < 1",
                quantity_negative="quantity < 0",
                price_missing="price IS NULL",
                price_not_positive="price <= 0",
                cost_negative="cost < 0",
                category_id_missing="category_id IS NULL",
            ),
            violations(
                "categories",
                "raw_categories",
                "id",
                name_missing="name IS NULL",
                name_too_short="length(name) < 1",
                name_too_long="length(name) > 255",
            ),
            violations("orders", "raw_orders", "id", status_unknown="status = 'returned'"),
            violations(
                "orders", "raw_orders", "id", items_missing="id NOT IN (SELECT order_id FROM raw_items)"
            ),
            violations(
                "orders",
                "(SELECT order_id, min(quantity) AS quantity, min(price) AS price FROM raw_items GROUP BY order_id)",
                "order_id",
                quantity_not_positive="quantity <= 0",
                price_not_positive="price <= 0",
            ),
        )
    ),
    RAW,
)
define(
    "storage_rules",
    "SELECT code, count(*) AS row_count, table_name FROM broken GROUP BY ALL",
    RAW,
    "broken AS ("
    + " UNION ALL ".join(
        (
            violations("clients", "raw_clients", "id", phone_too_long="length(phone) > 20", address_missing="address IS NULL"),
            violations(
                "nomenclature",
                "raw_products",
                "id",
                quantity_negative="quantity < 0",
                price_missing="price IS NULL",
                price_negative="price < 0",
                cost_negative="cost < 0",
                category_id_missing="category_id IS NULL",
            ),
            violations(
                "categories", "raw_categories", "id", name_missing="name IS NULL", name_too_long="length(name) > 255"
            ),
            violations("orders", "raw_orders", "id", status_unknown="status = 'returned'"),
            violations(
                "order_items", "raw_items", "order_id", quantity_not_positive="quantity <= 0", price_negative="price < 0"
            ),
        )
    )
    + ")",
)


def _dangling(child: str, rows: str, column: str, parents: str) -> str:
    return f"""
SELECT '{child}.{column}' AS foreign_key, {column} AS missing_id, count(*) AS row_count
FROM {rows} WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT id FROM {parents}) GROUP BY {column}"""


define(
    "fk_violations",
    " UNION ALL ".join(
        (
            _dangling("categories", "categories", "parent_id", "categories WHERE is_active"),
            _dangling("nomenclature", "nomenclature", "category_id", "categories WHERE is_active"),
            _dangling("orders", "app_orders", "client_id", "clients WHERE is_active"),
            _dangling("order_items", "order_items", "order_id", "app_orders"),
            _dangling("order_items", "order_items", "nomenclature_id", "nomenclature WHERE is_active"),
        )
    ),
)


def _orphans(child: str, rows: str, id: str, column: str, parents: str) -> str:
    return f"""
SELECT '{child}' AS table_name, {id} AS id, '{column}_not_found' AS reason
FROM {rows} WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT id FROM {parents})"""


define(
    "fk_rejected",
    " UNION ALL ".join(
        (
            _orphans("categories", "categories", "id", "parent_id", "categories WHERE is_active"),
            _orphans("nomenclature", "nomenclature", "id", "category_id", "categories WHERE is_active"),
            _orphans("orders", "app_orders", "id", "client_id", "clients WHERE is_active"),
            _orphans("order_items", "order_items", "order_id", "order_id", "app_orders"),
            _orphans("order_items", "order_items", "order_id", "nomenclature_id", "nomenclature WHERE is_active"),
        )
    ),
)


def _sharing(table: str, rows: str, id: str, columns: str, label: str) -> str:
    return f"""
SELECT '{table}' AS table_name, {id} AS id, '{label}_repeated' AS reason
FROM (SELECT *, count(*) OVER (PARTITION BY {columns}) AS held FROM {rows} WHERE ({columns}) IS NOT NULL) WHERE held > 1"""


define(
    "unique_rejected",
    " UNION ALL ".join(
        (
            _sharing("nomenclature", "nomenclature", "id", "sku", "sku"),
            _sharing("clients", "clients", "id", "email", "email"),
            _sharing("orders", "app_orders", "id", "order_number", "order_number"),
            _sharing(
                "order_items", "order_items", "order_id", "order_id, nomenclature_id", "order_id+nomenclature_id"
            ),
            _sharing(
                "categories",
                """(SELECT id, coalesce(parent_id, -1) AS parent, name FROM categories WHERE is_active
      UNION ALL SELECT id + 1000000000, coalesce(parent_id, -1), name FROM categories WHERE is_active AND id % 5 = 0)""",
                "id",
                "parent, name",
                "parent_id+name",
            ),
        )
    ),
)


def _repeated(label: str, rows: str, value: str) -> str:
    return f"""
SELECT '{label}' AS unique_key, {value} AS value, count(*) AS row_count FROM {rows}
GROUP BY {value} HAVING count(*) > 1 AND {value} IS NOT NULL"""


define(
    "unique_violations",
    " UNION ALL ".join(
        (
            _repeated("nomenclature.sku", "nomenclature", "sku"),
            _repeated("clients.email", "clients", "email"),
            _repeated("orders.order_number", "app_orders", "order_number"),
            _repeated("order_items.order_id+nomenclature_id", "order_items", "order_id || '/' || nomenclature_id"),
            _repeated(
                "categories.parent_id+name",
                "(SELECT * FROM categories WHERE is_active)",
                "coalesce(CAST(parent_id AS VARCHAR), '') || '/' || name",
            ),
        )
    ),
)
define(
    "total_mismatch",
    f"""
SELECT * FROM (
  SELECT o.id, {money('o.total_amount')} AS stored_amount,
         {money('coalesce((SELECT sum(i.total_price) FROM order_items i WHERE i.order_id = o.id), 0)')} AS items_amount
  FROM app_orders o)
WHERE stored_amount IS DISTINCT FROM items_amount""",
)
define(
    "total_mismatch_items",
    f"""
SELECT order_id, nomenclature_id, l_suppkey, l_linenumber, quantity, {money('total_price')} AS total_price,
       {money('quantity * price')} AS expected_price
FROM order_items WHERE total_price <> quantity * price""",
)

# --- changes -----------------------------------------------------------------

INTAKE = (
    """
SELECT o.id, NOT o.refused AS accepted,
       CASE WHEN NOT o.refused THEN NULL WHEN o.lines = 0 THEN 'items_missing' WHEN NOT o.client_ok THEN 'client_not_found'
            WHEN f.fault = 1 THEN 'product_not_found' WHEN f.fault = 2 THEN 'stock_too_small'
            WHEN f.fault = 3 THEN 'price_changed' ELSE 'product_repeated' END AS reason,
       CASE WHEN o.refused AND o.lines > 0 AND o.client_ok THEN CAST(f.nomenclature_id AS DOUBLE) END AS nomenclature_id
FROM (SELECT *, id NOT IN (SELECT order_id FROM accepted_orders) AS refused FROM reviewed) o
     LEFT JOIN first_faults f ON f.order_id = o.id""",
    """
arrivals AS (SELECT *, row_number() OVER (ORDER BY order_date, id) AS arrival FROM app_orders)""",
    f"""
offers AS (
  SELECT o.id AS order_id, o.arrival, {ITEM_KEY}, l.stock, l.stale,
         row_number() OVER (PARTITION BY o.id ORDER BY {ITEM_KEY}) AS position
  FROM arrivals o JOIN (
    SELECT i.*, CASE WHEN p.is_active THEN p.quantity * 10 END AS stock,
           i.l_returnflag = 'R' AND i.l_linenumber = 7 AS stale
    FROM order_items i JOIN (SELECT id, quantity, is_active FROM nomenclature) AS p(pid, quantity, is_active)
         ON p.pid = i.nomenclature_id) l(order_id, nomenclature_id, l_suppkey, l_linenumber, quantity, price, total_price,
                                         l_returnflag, stock, stale) ON l.order_id = o.id)""",
    """
reviewed AS (
  SELECT o.id, coalesce(bool_or(c.is_active), FALSE) AS client_ok, count(f.order_id) AS lines,
         coalesce(bool_or(f.stock IS NULL OR f.stale), FALSE) AS broken,
         count(f.order_id) > count(DISTINCT f.nomenclature_id) AS repeated
  FROM arrivals o LEFT JOIN clients c ON c.id = o.client_id LEFT JOIN offers f ON f.order_id = o.id
  GROUP BY o.id)""",
    """
rounds AS (
  SELECT 0 AS round, f.order_id, f.nomenclature_id, f.arrival, f.quantity, f.stock, 'open' AS state
  FROM offers f JOIN reviewed r ON r.id = f.order_id
  WHERE r.client_ok AND NOT r.broken AND NOT r.repeated
  UNION ALL
  SELECT round + 1, order_id, nomenclature_id, arrival, quantity, stock,
         CASE WHEN state <> 'open' THEN state
              WHEN bool_and(most <= stock) OVER (PARTITION BY order_id) THEN 'in'
              WHEN bool_or(least + quantity > stock) OVER (PARTITION BY order_id) THEN 'out'
              ELSE 'open' END
  FROM (SELECT *, count(*) FILTER (state = 'open') OVER () AS still_open,
               coalesce(sum(quantity) FILTER (state <> 'out') OVER earlier, 0) AS most,
               coalesce(sum(quantity) FILTER (state = 'in') OVER earlier, 0) AS least
        FROM rounds
        WINDOW earlier AS (PARTITION BY nomenclature_id ORDER BY arrival ROWS UNBOUNDED PRECEDING))
  WHERE still_open > 0)""",
    """
accepted_orders AS (
  SELECT DISTINCT order_id FROM rounds WHERE state = 'in' AND round = (SELECT max(round) FROM rounds))""",
    """
first_faults AS (
  SELECT order_id, arg_min(fault, position) AS fault, arg_min(nomenclature_id, position) AS nomenclature_id
  FROM (SELECT f.order_id, f.nomenclature_id, f.position,
               CASE WHEN f.stock IS NULL THEN 1
                    WHEN f.quantity > f.stock - coalesce(sum(CASE WHEN a.order_id IS NOT NULL THEN f.quantity END) OVER (
                           PARTITION BY f.nomenclature_id ORDER BY f.arrival, f.position ROWS UNBOUNDED PRECEDING), 0) THEN 2
                    WHEN f.stale THEN 3 END AS fault,
               a.order_id IS NOT NULL AS taken
        FROM offers f LEFT JOIN accepted_orders a ON a.order_id = f.order_id)
  WHERE fault IS NOT NULL AND NOT taken GROUP BY order_id)""",
)
define("order_intake", *INTAKE)
define(
    "create_orders",
    f"""
SELECT 'order' AS kind, id + 1000000000 AS id, {money("total_amount")} AS value, order_number AS label FROM app_orders
UNION ALL
SELECT 'order', o.id, t.total,
       coalesce(o.given, 'ORD-' || lpad(CAST(highest + count(*) FILTER (o.given IS NULL) OVER (
         ORDER BY o.order_date, o.id ROWS UNBOUNDED PRECEDING) AS VARCHAR), 6, '0'))
FROM offered o JOIN order_sums t ON t.order_id = o.id,
     (SELECT max(CAST(substr(order_number, 5) AS BIGINT)) AS highest FROM app_orders)
UNION ALL
SELECT 'items', order_id, total, NULL FROM order_sums
UNION ALL
SELECT 'stock', n.id, {money("n.quantity * 10 - coalesce(s.sold, 0)")}, NULL
FROM nomenclature n LEFT JOIN (
  SELECT nomenclature_id, sum(quantity) AS sold FROM offers
  WHERE order_id IN (SELECT order_id FROM accepted_orders) GROUP BY nomenclature_id) s ON s.nomenclature_id = n.id
UNION ALL
SELECT 'refused', id, NULL, reason FROM decided WHERE NOT accepted
UNION ALL
SELECT 'refused', id, NULL, unfit FROM offered WHERE unfit IS NOT NULL
UNION ALL
SELECT 'refused', id, NULL, 'id_taken' FROM app_orders WHERE id % 11 = 0
UNION ALL
SELECT 'refused', id + 1000000000, NULL, 'id_taken' FROM app_orders WHERE id % 13 = 0""",
    """
offered AS (
  SELECT *, CASE WHEN id % 17 = 0 THEN 'number_taken'
                 WHEN id % 19 = 0 AND row_number() OVER (PARTITION BY given ORDER BY order_date, id) > 1 THEN 'number_taken'
                 WHEN id % 19 <> 0 AND id % 23 = 0 THEN 'number_reserved' END AS unfit
  FROM (SELECT *, CASE WHEN id % 17 = 0 THEN order_number
                       WHEN id % 19 = 0 THEN 'WEB-' || CAST(id // 38 AS VARCHAR)
                       WHEN id % 23 = 0 THEN 'ORD-' || CAST(id + 5000000 AS VARCHAR) END AS given FROM app_orders))""",
    INTAKE[1].replace("FROM app_orders", "FROM offered WHERE unfit IS NULL"),
    *INTAKE[2:],
    f"""
decided AS ({INTAKE[0]})""",
    f"""
order_sums AS (
  SELECT f.order_id, {money("sum(f.quantity * n.price)")} AS total
  FROM offers f JOIN nomenclature n ON n.id = f.nomenclature_id
  WHERE f.order_id IN (SELECT order_id FROM accepted_orders) GROUP BY f.order_id)""",
)
define(
    "apply_stock",
    """
SELECT p.id, CAST(CASE WHEN p.quantity + delta < 0 THEN p.quantity ELSE p.quantity + delta END AS INT) AS quantity,
       CASE WHEN p.quantity + delta < 0 THEN 'stock_negative' END AS reason
FROM (SELECT n.id, n.quantity,
             coalesce((SELECT sum(CASE WHEN o.status = 'processing' THEN -i.quantity ELSE i.quantity END)
                       FROM order_items i JOIN app_orders o ON o.id = i.order_id
                       WHERE i.nomenclature_id = n.id AND o.status IN ('processing', 'cancelled', 'refunded')), 0) AS delta
      FROM nomenclature n) p""",
)
define(
    "assign_order_numbers",
    """
SELECT id, CASE WHEN needs = 0 THEN given
                ELSE 'ORD-' || CASE WHEN value < 1000000 THEN lpad(CAST(value AS VARCHAR), 6, '0')
                                    ELSE CAST(value AS VARCHAR) END END AS order_number
FROM (SELECT *, nth + greatest((SELECT max(CAST(substr(order_number, 5) AS BIGINT)) FROM app_orders),
                               max(TRY_CAST(nullif(regexp_extract(given, '^ORD-([0-9]+)$', 1), '') AS BIGINT) - nth)
                                 OVER arrived) AS value
      FROM counted WINDOW arrived AS (ORDER BY order_date, id ROWS UNBOUNDED PRECEDING))""",
    """
given AS (
  SELECT id, order_date,
         CASE payment_status
           WHEN 'unpaid' THEN NULL WHEN 'refunded' THEN '' WHEN 'partial' THEN 'WEB-' || id
           ELSE 'ORD-' || CASE WHEN id * 3 + 200000 < 1000000 THEN lpad(CAST(id * 3 + 200000 AS VARCHAR), 6, '0')
                               ELSE CAST(id * 3 + 200000 AS VARCHAR) END END AS given
  FROM app_orders)""",
    """
counted AS (
  SELECT *, CASE WHEN coalesce(given, '') = '' THEN 1 ELSE 0 END AS needs,
         sum(CASE WHEN coalesce(given, '') = '' THEN 1 ELSE 0 END)
           OVER (ORDER BY order_date, id ROWS UNBOUNDED PRECEDING) AS nth
  FROM given)""",
)
define(
    "order_totals",
    f"""
SELECT o.id, {money('coalesce((SELECT sum(i.total_price) FROM order_items i WHERE i.order_id = o.id), o.total_amount)')}
         AS total_amount
FROM app_orders o""",
)
define(
    "order_totals_changed",
    f"""
SELECT o.id, CASE WHEN o.status = 'pending'
                  THEN {money('coalesce((SELECT sum(i.total_price) FROM order_items i WHERE i.order_id = o.id), 0)')}
                  ELSE {money('o.total_amount')} END AS total_amount
FROM app_orders o""",
)
PATCHES = """
patches AS (
  SELECT o_orderkey AS seq,
         o_custkey + CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 1000000000 ELSE 0 END AS id,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'Client ' || o_orderkey END AS name,
         CASE WHEN o_orderpriority = '2-HIGH' THEN 'c' || (o_orderkey % 3000) || '@example.com'
              WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'O' THEN 'nobody' END AS email,
         CASE WHEN o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN 'Street ' || o_orderstatus END AS address
  FROM orders),
checked AS (
  SELECT p.*, CASE WHEN email = 'nobody' THEN 'invalid_fields'
                   WHEN p.id NOT IN (SELECT id FROM clients) THEN 'unknown_id'
                   WHEN EXISTS (SELECT 1 FROM clients c WHERE c.email = p.email AND c.id <> p.id) THEN 'email_taken'
                   WHEN coalesce(name, email, address) IS NULL THEN 'nothing_to_change' END AS fault
  FROM patches p),
reviewed AS (
  SELECT c.*, CASE WHEN fault IS NULL AND f.owner <> c.id THEN 'email_taken' ELSE fault END AS reason
  FROM checked c LEFT JOIN (SELECT email, arg_min(id, seq) AS owner FROM checked
                            WHERE fault IS NULL AND email IS NOT NULL GROUP BY email) f ON f.email = c.email)"""
PATCHED_CLIENTS = """
SELECT c.id, coalesce(m.name, c.name) AS name, coalesce(m.email, c.email) AS email, c.phone,
       coalesce(m.address, c.address) AS address, c.is_active
FROM clients c LEFT JOIN (
  SELECT id, arg_max(name, seq) FILTER (name IS NOT NULL) AS name,
         arg_max(email, seq) FILTER (email IS NOT NULL) AS email,
         arg_max(address, seq) FILTER (address IS NOT NULL) AS address
  FROM reviewed WHERE reason IS NULL GROUP BY id) m ON m.id = c.id"""
define("patch_apply_clients", PATCHED_CLIENTS, PATCHES)
define("versioned_changes", PATCHED_CLIENTS + " WHERE c.is_active", PATCHES)
define("patch_apply_clients_rejected", "SELECT seq, id, reason FROM reviewed WHERE reason IS NOT NULL", PATCHES)

PRODUCT_PATCHES = """
patches AS (
  SELECT p_partkey AS id,
         CASE WHEN p_size < 20 THEN 'SKU-' || (p_partkey // 2) WHEN p_size < 30 THEN 'NEW-' || (p_partkey // 4) END AS sku,
         CASE WHEN p_size > 40 THEN p_partkey % 30 + 100 END AS category_id,
         CASE p_type WHEN 'ECONOMY' THEN CAST(p_retailprice - 910 AS DECIMAL(12,2)) END AS price
  FROM part),
checked AS (
  SELECT *, CASE WHEN price <= 0 THEN 'invalid_fields'
                 WHEN category_id NOT IN (SELECT id FROM categories WHERE is_active) THEN 'category_not_found'
                 WHEN sku LIKE 'SKU-%' AND sku <> 'SKU-' || id THEN 'sku_taken'
                 WHEN sku IS NULL AND category_id IS NULL AND price IS NULL THEN 'nothing_to_change' END AS fault
  FROM patches),
reviewed AS (
  SELECT *, CASE WHEN fault IS NOT NULL THEN fault
                 WHEN sku IS NOT NULL AND row_number() OVER (PARTITION BY sku, fault ORDER BY id) > 1 THEN 'sku_taken'
                 END AS reason
  FROM checked)"""
define(
    "patch_apply_nomenclature",
    f"""
SELECT p.id, p.name, p.description, coalesce(r.sku, p.sku) AS sku, p.quantity,
       {money('coalesce(r.price, p.price)')} AS price, coalesce(r.category_id, p.category_id) AS category_id, p.is_active
FROM nomenclature p LEFT JOIN reviewed r ON r.id = p.id AND r.reason IS NULL""",
    PRODUCT_PATCHES,
)
define(
    "patch_apply_nomenclature_rejected",
    "SELECT id AS seq, id, reason FROM reviewed WHERE reason IS NOT NULL",
    PRODUCT_PATCHES,
)
STORED_PATHS = """
stored AS (
  SELECT c.*, concat_ws('.', p.parent_id, c.parent_id, c.id) AS path
  FROM categories c LEFT JOIN categories p ON p.id = c.parent_id)"""
CATEGORY_PATCHES = """
patches AS (
  SELECT s_suppkey AS seq, s_suppkey + 1000 AS id, CASE WHEN s_nationkey < 10 THEN 'Line ' || s_suppkey END AS name,
         CASE WHEN s_nationkey BETWEEN 5 AND 19 THEN s_nationkey * 2 + 100 WHEN s_nationkey = 21 THEN 3 END AS parent_id,
         CASE WHEN s_nationkey = 20 THEN FALSE END AS is_active
  FROM supplier),
reviewed AS (
  SELECT *, CASE WHEN parent_id NOT IN (SELECT id FROM categories WHERE is_active) THEN 'parent_not_found'
                 WHEN name IS NULL AND parent_id IS NULL AND is_active IS NULL THEN 'nothing_to_change' END AS reason
  FROM patches)"""
define(
    "patch_apply_categories",
    """
SELECT c.id, coalesce(r.name, c.name) AS name, CAST(coalesce(r.parent_id, c.parent_id) AS DOUBLE) AS parent_id,
       CASE WHEN r.id IS NULL THEN c.level ELSE p.level + 1 END AS level,
       coalesce(r.is_active, c.is_active) AS is_active,
       CASE WHEN r.id IS NULL THEN c.path ELSE p.path || '.' || c.id END AS path
FROM stored c LEFT JOIN reviewed r ON r.id = c.id AND r.reason IS NULL
     LEFT JOIN stored p ON p.id = coalesce(r.parent_id, c.parent_id)""",
    STORED_PATHS,
    CATEGORY_PATCHES,
)
define(
    "patch_apply_categories_rejected", "SELECT seq, id, reason FROM reviewed WHERE reason IS NOT NULL", CATEGORY_PATCHES
)
ORDER_PATCHES = """
reviewed AS (
  SELECT *, CASE WHEN status = 'lost' THEN 'invalid_fields'
                 WHEN id >= 1000000000 THEN 'unknown_id'
                 WHEN coalesce(status, payment_status) IS NULL THEN 'nothing_to_change' END AS reason
  FROM (SELECT o_orderkey AS seq, o_orderkey + CASE WHEN o_totalprice < 10000 THEN 1000000000 ELSE 0 END AS id,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'completed' WHEN '2-HIGH' THEN 'lost' END AS status,
               CASE WHEN o_orderstatus = 'P' THEN 'paid' WHEN o_orderpriority = '3-MEDIUM' THEN 'partial' END
                 AS payment_status
        FROM orders))"""
define(
    "patch_apply_orders",
    f"""
SELECT o.id, o.client_id, o.order_number, o.order_date, {money('o.total_amount')} AS total_amount,
       coalesce(r.status, o.status) AS status, coalesce(r.payment_status, o.payment_status) AS payment_status
FROM app_orders o LEFT JOIN reviewed r ON r.id = o.id AND r.reason IS NULL""",
    ORDER_PATCHES,
)
define("patch_apply_orders_rejected", "SELECT seq, id, reason FROM reviewed WHERE reason IS NOT NULL", ORDER_PATCHES)


def _deletion(label: str, rows: str, fault: str) -> str:
    return f"""
SELECT '{label}' AS table_name, id, reason FROM (SELECT id, {fault} AS reason FROM {rows} x) WHERE reason IS NOT NULL
UNION ALL SELECT '{label}', id, 'remains' FROM (SELECT id, {fault} AS reason FROM {rows} x) WHERE reason IS NOT NULL
UNION ALL SELECT '{label}', id + 1000000000, 'unknown_id' FROM {rows}"""


define(
    "guarded_delete",
    " UNION ALL ".join(
        (
            _deletion(
                "categories",
                "categories",
                "CASE WHEN id IN (SELECT parent_id FROM categories WHERE parent_id IS NOT NULL) THEN 'has_children' "
                "WHEN id IN (SELECT category_id FROM nomenclature) THEN 'has_products' END",
            ),
            _deletion("clients", "clients", "CASE WHEN id IN (SELECT client_id FROM app_orders) THEN 'has_orders' END"),
            _deletion(
                "nomenclature", "nomenclature", "CASE WHEN id IN (SELECT nomenclature_id FROM order_items) THEN 'in_orders' END"
            ),
            _deletion("orders", "app_orders", "CASE WHEN status IN ('completed', 'processing') THEN 'locked_status' END"),
        )
    ),
)
define(
    "cascade_delete",
    """
SELECT 'order' AS kind, id, CAST(1 AS BIGINT) AS value FROM app_orders WHERE status IN ('completed', 'processing')
UNION ALL
SELECT 'items', order_id, count(*) FROM order_items JOIN app_orders o ON o.id = order_id
WHERE status IN ('completed', 'processing') GROUP BY order_id
UNION ALL
SELECT 'stock', nomenclature_id, CAST(sum(quantity) AS BIGINT) FROM order_items JOIN app_orders o ON o.id = order_id
WHERE status NOT IN ('completed', 'processing') GROUP BY nomenclature_id""",
)
define(
    "versioned_order_delete",
    f"""
SELECT o.id, o.status, {money('coalesce(i.amount, o.total_amount)')} AS total_amount, coalesce(i.n, 0) AS items_count
FROM app_orders o
LEFT JOIN (SELECT order_id, sum(total_price) AS amount, count(*) AS n FROM order_items GROUP BY order_id) i
  ON i.order_id = o.id
WHERE o.status <> 'refunded'""",
)
define(
    "delete_orders",
    f"""
SELECT 'order' AS kind, id, {money("total_amount")} AS value, order_number AS label FROM app_orders
WHERE status IN ('completed', 'processing')
UNION ALL
SELECT 'items', order_id, {money("sum(total_price)")}, NULL FROM order_items
WHERE order_id IN (SELECT id FROM app_orders WHERE status IN ('completed', 'processing')) GROUP BY order_id
UNION ALL
SELECT 'stock', n.id, {money("n.quantity + coalesce(s.returned, 0)")}, NULL
FROM nomenclature n LEFT JOIN (
  SELECT nomenclature_id, sum(quantity) AS returned FROM order_items
  WHERE order_id IN (SELECT id FROM app_orders WHERE status NOT IN ('completed', 'processing'))
  GROUP BY nomenclature_id) s ON s.nomenclature_id = n.id
UNION ALL
SELECT 'refused', id, NULL, 'locked_status' FROM app_orders WHERE status IN ('completed', 'processing')
UNION ALL
SELECT 'refused', id + 1000000000, NULL, 'unknown_id' FROM app_orders""",
)
BROKEN = """
broken AS (
  SELECT id, name, level, is_active,
         CASE id WHEN 1 THEN (SELECT min(n_nationkey) + 100 FROM nation WHERE n_regionkey = 1)
                 WHEN 4 THEN 999 ELSE parent_id END AS parent_id
  FROM categories)"""


def _subtrees(tree: str, wanted: str, spared: str) -> tuple[str, str]:
    """Remaining categories and refused ids; products of the `spared` categories do not count."""
    reached = f"""
reached AS (
  SELECT id AS top, id FROM {tree} WHERE {wanted}
  UNION
  SELECT r.top, c.id FROM {tree} c JOIN reached r ON c.parent_id = r.id),
refused AS (
  SELECT DISTINCT top FROM reached
  WHERE id IN (SELECT category_id FROM nomenclature WHERE category_id NOT IN ({spared})))"""
    select = f"""
SELECT id, name, 'remains' AS reason FROM {tree}
WHERE id NOT IN (SELECT id FROM reached WHERE top NOT IN (SELECT top FROM refused))
UNION ALL
SELECT top, '', 'has_products' FROM refused"""
    return select, reached


define("delete_subtree", *_subtrees("categories", "NOT is_active", "107"))
define("delete_subtree_indexed", *_subtrees("categories", "NOT is_active", "107"))
_select, _reached = _subtrees("broken", "level < 2", "SELECT id FROM categories WHERE parent_id = 1")
define("delete_subtree_broken", _select, BROKEN, _reached)
define(
    "descendants_broken",
    """
SELECT top AS ancestor_id, id AS descendant_id, CAST(min(distance) AS INT) AS distance
FROM steps WHERE id <> top GROUP BY top, id""",
    BROKEN,
    """
steps AS (
  SELECT id AS top, id, 0 AS distance FROM broken WHERE level < 2
  UNION
  SELECT s.top, c.id, s.distance + 1 FROM broken c JOIN steps s ON c.parent_id = s.id WHERE s.distance < 4)""",
)
define(
    "subtree_index",
    """
SELECT top AS ancestor_id, id AS descendant_id, CAST(min(distance) AS INT) AS distance
FROM steps WHERE id <> top GROUP BY top, id""",
    BROKEN,
    """
steps AS (
  SELECT id AS top, id, 0 AS distance FROM broken
  UNION
  SELECT s.top, c.id, s.distance + 1 FROM broken c JOIN steps s ON c.parent_id = s.id WHERE s.distance < 6)""",
)


def _inserted(existing: str, value: str = "shown") -> str:
    """Added rows with ids in order of arrival, and the refused ones."""
    return f"""
SELECT 'added' AS outcome, key, {value} AS value, TRUE AS is_active
FROM (SELECT *, (SELECT max(id) FROM {existing}) + row_number() OVER (ORDER BY seq) AS key
      FROM decided WHERE reason IS NULL)
UNION ALL
SELECT 'rejected', seq, reason, FALSE FROM decided WHERE reason IS NOT NULL"""


def _first_wins(code: str) -> str:
    return f"""
decided AS (
  SELECT *, CASE WHEN fault IS NOT NULL THEN fault
                 WHEN row_number() OVER (PARTITION BY claim, fault ORDER BY seq) > 1 THEN '{code}' END AS reason
  FROM tested)"""


define(
    "insert_batch_clients",
    _inserted("clients"),
    """
tested AS (
  SELECT s_suppkey AS seq, email AS claim, email AS shown,
         CASE WHEN s_acctbal < 0 THEN 'invalid_fields'
              WHEN email IN (SELECT email FROM clients) THEN 'email_taken' END AS fault
  FROM (SELECT *, 'c' || (s_suppkey % 40 * 50) || '@example.com' AS email FROM supplier))""",
    _first_wins("email_taken"),
)
define(
    "insert_batch_products",
    _inserted("nomenclature"),
    """
tested AS (
  SELECT p_partkey AS seq, sku AS claim, sku AS shown,
         CASE WHEN CAST(p_retailprice - 910 AS DECIMAL(12,2)) <= 0 THEN 'invalid_fields'
              WHEN p_partkey % 30 + 100 NOT IN (SELECT id FROM categories WHERE is_active) THEN 'category_not_found'
              WHEN sku IN (SELECT sku FROM nomenclature) THEN 'sku_taken' END AS fault
  FROM (SELECT *, 'SKU-' || (p_partkey * 3 // 2) AS sku FROM part))""",
    _first_wins("sku_taken"),
)
define(
    "inserts_in_order",
    "SELECT seq, reason FROM decided WHERE reason IS NOT NULL",
    """
switches AS (
  SELECT s_suppkey * 40 + 1 AS seq, s_nationkey + 100 AS id, s_acctbal >= 0 AS is_active
  FROM supplier WHERE s_suppkey % 4 <> 0),
states AS (
  SELECT p_partkey, arg_max(w.is_active, w.seq) AS is_active
  FROM part JOIN switches w ON w.id = p_partkey % 30 + 100 AND w.seq < p_partkey * 2 GROUP BY p_partkey),
tested AS (
  SELECT p_partkey * 2 AS seq, sku AS claim,
         CASE WHEN CAST(p_retailprice - 910 AS DECIMAL(12,2)) <= 0 THEN 'invalid_fields'
              WHEN NOT coalesce(s.is_active, c.is_active, FALSE) THEN 'category_not_found'
              WHEN sku IN (SELECT sku FROM nomenclature) THEN 'sku_taken' END AS fault
  FROM (SELECT *, 'SKU-' || (p_partkey * 3 // 2) AS sku FROM part)
  LEFT JOIN states s USING (p_partkey) LEFT JOIN categories c ON c.id = p_partkey % 30 + 100)""",
    _first_wins("sku_taken"),
)
define(
    "insert_batch_categories",
    _inserted(
        "categories",
        "coalesce((SELECT c.parent_id || '.' || c.id || '.' || key || ' ' || (c.level + 1) FROM categories c"
        " WHERE CAST(c.id AS VARCHAR) = shown), key || ' 0')",
    ),
    """
tested AS (
  SELECT s_suppkey AS seq, coalesce(parent, -1) || '/' || name AS claim, CAST(parent AS VARCHAR) AS shown,
         CASE WHEN parent IS NOT NULL AND parent NOT IN (SELECT id FROM categories WHERE is_active) THEN 'parent_not_found'
              WHEN EXISTS (SELECT 1 FROM categories c WHERE c.is_active AND c.name = s.name
                           AND c.parent_id IS NOT DISTINCT FROM s.parent) THEN 'name_taken' END AS fault
  FROM (SELECT s_suppkey, 'Range ' || s_nationkey AS name,
               CASE WHEN s_acctbal >= 0 THEN s_nationkey + 100 END AS parent FROM supplier) s)""",
    _first_wins("name_taken"),
)

# --- metrics and streams -------------------------------------------------------

define("event_counters", "SELECT event_type, count(*) AS total FROM events GROUP BY event_type")
define(
    "event_counters_stream",
    """
SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS total
FROM events GROUP BY 1, 2""",
)


def _histogram(bounds: str, window: str) -> str:
    lead = f"{window} AS window_start, " if window else ""
    return f"""
SELECT {lead}event_type, le, count(*) FILTER (value <= le) AS bucket_count,
       CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS sum, count(value) AS count
FROM events, (SELECT unnest([{bounds}, 'inf'::DOUBLE]) AS le) GROUP BY ALL"""


define(
    "latency_histogram",
    _histogram("0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0", ""),
)
define("latency_histogram_stream", _histogram("1.0, 10.0, 100.0", "CAST(date_trunc('day', ts) AS TIMESTAMP)"))
_RATE = """
SELECT {lead}requests, errors, micros / 1e6 AS uptime_seconds,
       CAST(errors AS DOUBLE) / greatest(CAST(requests AS DOUBLE), 1.0) AS error_rate,
       CAST(requests AS DOUBLE) / greatest(micros / 1e6, 1.0) AS requests_per_second
FROM (SELECT {window}count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors,
             coalesce(epoch_us(max(ts)) - epoch_us(min(ts)), 0) AS micros
      FROM events {group})"""
define("error_and_request_rate", _RATE.format(lead="", window="", group=""))
define(
    "error_and_request_rate_stream",
    _RATE.format(
        lead="window_start, ", window="CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, ", group="GROUP BY 1"
    ),
)
define(
    "stream_order_totals",
    """
SELECT order_id, CAST(sum(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN CAST(quantity AS DECIMAL(12,2))
                                             ELSE total_price END) AS DOUBLE) AS amount,
       count(*) FILTER (l_returnflag <> 'R') AS items
FROM order_items GROUP BY order_id""",
)
ORACLES["event_counters_late"] = ORACLES["event_counters_stream"]
ORACLES["stream_order_totals_repeated"] = ORACLES["stream_order_totals"]
ORACLES["stream_client_summary"] = ORACLES["client_order_summary"]
ORACLES["bucketed_order_summary"] = ORACLES["order_summary"]
ORACLES["insert_batch_indexed"] = ORACLES["insert_batch_products"]
