"""Analytics on developer logs, usage ledgers and code graphs, as Spark DataFrame operators."""
