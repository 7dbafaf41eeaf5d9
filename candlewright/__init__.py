"""Spark-first equity screening: bars, indicators, setups, scans and expectancy backtests."""
