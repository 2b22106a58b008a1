"""Top-k through a join without joining the whole fact.

For a report like "the 10 largest transactions with customer and product
names", the join to the dimensions only drops fact rows (no match) or repeats
them (duplicate dimension keys), and the order starts with a fact column.
Then every joined row built from a fact row with a smaller sort value ranks
after every joined row built from the largest fact rows.  One lazy plan:

1. the k largest fact rows and a margin for those that the join drops, from
   one distributed top-k; of them those above the smallest (whose equals may
   have been cut off) are sure to be all there;
2. these joined and cut, if they give k rows;
3. otherwise the whole fact, joined and cut.  A one-row frame says which; where
   it is empty, Spark's adaptive execution drops this branch unread.

Nothing runs before the caller's action.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARGIN = 1000


def top_k_through_join(fact: DataFrame, sort_col: str, k: int,
                       join: Callable[[DataFrame], DataFrame], order: list[Column], margin: int = MARGIN) -> DataFrame:
    """Exact ``join(fact).orderBy(*order).limit(k)`` when ``join`` only drops
    or repeats fact rows and ``order`` begins with ``sort_col`` descending,
    NULLs last."""
    # one exchange of at most k + margin rows, shared by both uses
    head = fact.orderBy(F.col(sort_col).desc_nulls_last()).limit(k + margin).repartition(1)
    one = Window.partitionBy()
    sized = head.select("*", F.count(F.lit(1)).over(one).alias("__n"), F.min(sort_col).over(one).alias("__lo"),
                        F.count_if(F.col(sort_col).isNull()).over(one).alias("__null"))
    # with fewer rows than asked for the fact is all there; a NULL among them: all values are
    sure = sized.where((F.col("__n") < k + margin) | (F.col("__null") > 0) & F.col(sort_col).isNotNull()
                       | (F.col(sort_col) > F.col("__lo"))).drop("__n", "__lo", "__null")
    best = join(sure).orderBy(*order).limit(k)
    all_there = head.agg((F.count(F.lit(1)) < k + margin).alias("__all"))
    enough = join(sure).limit(k).agg((F.count(F.lit(1)) >= k).alias("__enough"))
    short = enough.crossJoin(all_there).where("NOT __enough AND NOT __all").select(F.lit(1).alias("__one"))
    rest = join(fact.crossJoin(F.broadcast(short)).drop("__one")).orderBy(*order).limit(k)
    both = best.crossJoin(F.broadcast(short.agg(F.count(F.lit(1)).alias("__short")))).where("__short = 0").drop("__short")
    return both.unionByName(rest).orderBy(*order).limit(k)
