"""Analytics on collections of items, as lazy Spark plans."""
