"""City-scoped content analytics as Spark DataFrame jobs.

Every operator is ``f(*dataframes, as_of=..., **params) -> DataFrame``: lazy,
set-based and free of the wall clock.
"""
