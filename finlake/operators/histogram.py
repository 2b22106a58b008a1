"""NTILE over row-level data from a value histogram, without ordering the rows.

What NTILE(k) OVER (ORDER BY value) groups depends, for the counts and sums of
functions of the value, only on how often each value occurs.  The rows are
counted by value (combined before the shuffle, so a value that a third of all
rows share is one row per task), the values are counted in bins, and the bins
are laid in order.  A bin is a value's binary order of magnitude in `bins`
steps, so long tails need no range beforehand and a bin spans a fixed share of
its values.  A bin that lies within one tile is taken whole.  The at most k - 1
bins that a cut goes through are refined to their values, and the rows of a
value that a cut goes through are split by number; which of them go where is
the same for every sum.

One lazy plan: nothing runs before the caller's action.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 256


def _tile(rank: str, k: int) -> str:
    """NTILE(k) of a 1-based rank among _rows rows: the first _rows % k tiles
    hold one row more than the others."""
    size, more = f"(_rows div {k})", f"(_rows % {k})"
    return (f"CASE WHEN {rank} <= {more} * ({size} + 1) THEN ({rank} + {size}) div ({size} + 1) "
            f"ELSE {more} + ({rank} - {more} * ({size} + 1) + greatest({size}, 1L) - 1) div greatest({size}, 1L) END")


def tile_sums(df: DataFrame, value: str, k: int, sums: dict[str, str], bins: int = BINS) -> DataFrame:
    """tile (1..k, largest values first, NULLs last), n (rows) and, per entry of
    `sums`, the sum over the tile's rows of a SQL expression in v, the value,
    and total, the sum of all values.  Tiles without rows are left out."""
    place = f"coalesce(cast(sign(v) * floor(log2(1 + abs(cast(v AS double))) * {bins}) AS bigint), -9223372036854775808)"
    by_value = df.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n")).selectExpr("v", "n", f"{place} AS _bin")
    whole = by_value.selectExpr("sum(n) AS _rows", "sum(v * cast(n AS decimal(20,0))) AS total")  # one row
    values = by_value.crossJoin(F.broadcast(whole)).selectExpr(
        "v", "n", "_bin", "_rows", *[f"({e}) * cast(n AS decimal(20,0)) AS {name}" for name, e in sums.items()])
    totals = [f"sum({name}) AS {name}" for name in sums]
    first, last = _tile("(_before + 1)", k), _tile("(_before + n)", k)
    # one row per bin, at most some `bins` times the digits of the values
    laid = (values.groupBy("_bin").agg(*map(F.expr, ["sum(n) AS n", "max(_rows) AS _rows", *totals]))
            .selectExpr("*", "coalesce(sum(n) OVER (ORDER BY _bin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS _before")
            .selectExpr("*", f"{first} AS _first", f"{last} AS _last"))
    inside = laid.where("_first = _last").selectExpr("_first AS tile", "n", *sums)
    cut = laid.where("_first <> _last").selectExpr("_bin", "_before AS _start")  # at most k - 1 rows
    # rows of a tile among those of a value: from the later start to the earlier end
    end = f"({{}} * (_rows div {k}) + least({{}}, _rows % {k}))"
    share = f"least(_before + n, {end.format('tile', 'tile')}) - greatest(_before, {end.format('(tile - 1)', '(tile - 1)')})"
    split = (by_value.join(F.broadcast(cut), "_bin").crossJoin(F.broadcast(whole))
             .selectExpr("v", "n", "total", "_rows", "_start + coalesce(sum(n) OVER (PARTITION BY _bin ORDER BY v DESC "
                         "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS _before")
             .selectExpr("*", f"explode(sequence({first}, {last})) AS tile")
             .selectExpr("tile", f"{share} AS n", "v", "total")
             .selectExpr("tile", "n", *[f"({e}) * cast(n AS decimal(20,0)) AS {name}" for name, e in sums.items()]))
    return (inside.unionByName(split).groupBy(F.expr("cast(tile AS int) AS tile"))
            .agg(*map(F.expr, ["sum(n) AS n", *totals])))
