"""Order, product, client and category-tree analytics as Spark DataFrame jobs."""
