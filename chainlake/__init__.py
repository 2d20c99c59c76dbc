"""Analytics over append-only, hash-chained event journals, as Spark tables."""
