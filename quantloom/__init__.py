"""Investment analytics on PySpark: price windows, scoring, portfolios, backtests."""
