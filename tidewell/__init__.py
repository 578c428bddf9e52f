"""An analytics engine for signed, tagged event logs, on PySpark DataFrames.

An event is a row, a *note*; see :mod:`tidewell.schema`. Filters compile to
columns, queries to plans that Catalyst optimises, and derived tables (tokens,
tags, counters, profiles) are plain DataFrames.
"""
