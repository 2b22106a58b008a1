"""Independent SQL oracle (DuckDB dialect) for every registered query.

The prelude rebuilds the star schema from the driver's tables with plain
SQL; helpers in ``sqlfn`` reproduce exact decimal semantics (HALF_UP
averages and quotients) with 128-bit integer arithmetic, so results can be
compared value for value with the Spark plans.
"""
