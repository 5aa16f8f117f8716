"""Security-log analytics as PySpark DataFrame transformations.

Every operator takes DataFrames and returns a DataFrame; nothing is computed
until an action runs, except where a docstring says a table is materialised.
"""
