"""Operators for large-scale training-data pipelines over a ``documents`` table.

Each module holds one operator: a general function on DataFrames, and the thin
``opN_`` query that applies it to the whole table with production parameters.
``entries`` gathers queries and DuckDB oracles for the driver contract.
"""
