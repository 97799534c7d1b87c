"""A small demonstration data set."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlytics.schemas import SCHEMAS
from orderlytics.sources.tables import Tables, with_defaults

# The demonstration rows.
# id, name, parent
CATEGORIES = [
    (1, "Бытовая техника", None),
    (2, "Компьютеры", None),
    (3, "Стиральные машины", 1),
    (4, "Холодильники", 1),
    (5, "Телевизоры", 1),
    (6, "Ноутбуки", 2),
    (7, "Моноблоки", 2),
    (8, "однокамерные", 4),
    (9, "двухкамерные", 4),
    (10, '17"', 6),
    (11, '19"', 6),
]
# name, description, sku, stock, price, cost, category
PRODUCTS = [
    ("Стиральная машина Samsung WW90T4540AE", "Автоматическая стиральная машина Samsung с загрузкой 9 кг", "SMS-WW90T4540AE", 5, 25000, 20000, 3),
    ("Стиральная машина LG F2J5TN2W", "Стиральная машина LG с инверторным двигателем", "SML-F2J5TN2W", 3, 30000, 24000, 3),
    ("Холодильник однокамерный Bosch KGN39VLEA", "Однокамерный холодильник Bosch с системой NoFrost", "HBO-KGN39VLEA", 2, 35000, 28000, 8),
    ("Холодильник двухкамерный Samsung RB33J3420SA", "Двухкамерный холодильник Samsung с технологией Digital Inverter", "HBS-RB33J3420SA", 4, 45000, 36000, 9),
    ("Телевизор Samsung UE55TU8000", 'Smart TV Samsung 55" с разрешением 4K UHD', "TVS-UE55TU8000", 6, 55000, 44000, 5),
    ('Ноутбук ASUS VivoBook 17"', 'Ноутбук ASUS 17" с процессором Intel Core i5', "NBA-VB17I5", 3, 45000, 36000, 10),
    ('Ноутбук HP Pavilion 19"', 'Ноутбук HP 19" с процессором AMD Ryzen 5', "NBH-PV19R5", 2, 50000, 40000, 11),
    ('Моноблок Apple iMac 24"', 'Моноблок Apple iMac 24" с чипом M1', "MBA-IM24M1", 1, 120000, 96000, 7),
]
# name, email, phone, address
CLIENTS = [
    ("Иванов Иван Иванович", "ivanov@example.com", "+7 (495) 123-45-67", "г. Москва, ул. Ленина, д. 1, кв. 10"),
    ("Петров Петр Петрович", "petrov@example.com", "+7 (812) 234-56-78", "г. Санкт-Петербург, ул. Невский проспект, д. 5, кв. 20"),
    ("Сидоров Сидор Сидорович", "sidorov@example.com", "+7 (343) 345-67-89", "г. Екатеринбург, ул. Мира, д. 15, кв. 30"),
    ("Козлова Анна Сергеевна", "kozlov@example.com", "+7 (495) 456-78-90", "г. Москва, ул. Тверская, д. 10, кв. 5"),
    ("Смирнов Алексей Владимирович", "smirnov@example.com", "+7 (812) 567-89-01", "г. Санкт-Петербург, ул. Садовая, д. 20, кв. 15"),
]
# number, client, date (UTC), stored total, status, payment, notes
ORDERS = [
    ("ORD-000001", 1, "2024-01-15 07:30", 105000, "completed", "paid", "Заказ выполнен в срок"),
    ("ORD-000002", 2, "2024-01-16 11:20", 130000, "processing", "partial", "Ожидается поступление товара"),
    ("ORD-000003", 3, "2024-01-17 06:15", 120000, "pending", "unpaid", "Новый заказ"),
    ("ORD-000004", 4, "2024-01-18 08:45", 80000, "completed", "paid", "Быстрая доставка"),
    ("ORD-000005", 5, "2024-01-19 13:30", 95000, "processing", "paid", "В обработке"),
]
# order, product, quantity, unit price, total
ITEMS = [
    (1, 1, 1, 25000, 25000),
    (1, 3, 1, 35000, 35000),
    (1, 4, 1, 45000, 45000),
    (2, 2, 1, 30000, 30000),
    (2, 5, 1, 55000, 55000),
    (2, 6, 1, 45000, 45000),
    (3, 8, 1, 120000, 120000),
    (4, 1, 1, 25000, 25000),
    (4, 3, 1, 35000, 35000),
    (4, 5, 1, 55000, 55000),
    (5, 2, 1, 30000, 30000),
    (5, 4, 1, 45000, 45000),
    (5, 7, 1, 50000, 50000),
]


def rows_of(spark: SparkSession, table: str, columns: list[str], rows: list[tuple]) -> DataFrame:
    """Rows with the table's own types and defaults; missing ids count up from 1."""
    types = {f.name: f.dataType for f in SCHEMAS[table].fields}
    if "id" not in columns:
        columns = ["id", *columns]
        rows = [(n, *row) for n, row in enumerate(rows, start=1)]
    schema = ", ".join(f"{c} {types[c].simpleString()}" for c in columns)
    exact = [tuple(_exact(v, types[c].typeName()) for c, v in zip(columns, row, strict=True)) for row in rows]
    df = spark.createDataFrame(exact, schema)
    return with_defaults(df, table, F.lit("2024-01-01 00:00:00").cast("timestamp"), "system")


def _exact(value: object, kind: str) -> object:
    if value is None:
        return None
    if kind == "decimal":
        return Decimal(str(value))
    if kind == "timestamp" and isinstance(value, str):
        return datetime.fromisoformat(f"{value}+00:00")
    return value


def seed(spark: SparkSession) -> Tables:
    depth = {cid: 0 for cid, _, parent in CATEGORIES if parent is None}
    for cid, _, parent in CATEGORIES:
        depth.setdefault(cid, depth.get(parent, 0) + 1)
    nodes = [(cid, name, parent, depth[cid]) for cid, name, parent in CATEGORIES]
    product_columns = ["name", "description", "sku", "quantity", "price", "cost", "category_id"]
    order_columns = ["order_number", "client_id", "order_date", "total_amount", "status", "payment_status", "notes"]
    item_columns = ["order_id", "nomenclature_id", "quantity", "price", "total_price"]
    return Tables(
        categories=rows_of(spark, "categories", ["id", "name", "parent_id", "level"], nodes),
        nomenclature=rows_of(spark, "nomenclature", product_columns, PRODUCTS),
        clients=rows_of(spark, "clients", ["name", "email", "phone", "address"], CLIENTS),
        orders=rows_of(spark, "orders", order_columns, ORDERS),
        order_items=rows_of(spark, "order_items", item_columns, ITEMS),
    )
