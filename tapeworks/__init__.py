"""Point-in-time market-data analytics as Spark DataFrame operators.

Every public operator takes and returns DataFrames, so plans stay lazy and Catalyst sees the whole query.
The unit of layout is the session ``(ticker, date)``: at most one row per five-minute bar, so a session
partition is bounded however large the universe grows.
"""
