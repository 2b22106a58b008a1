"""Reusable DataFrame operators."""
from finlake.operators.windows import (lag_growth_pct, moving_avg, running_total,
                                       with_share)
from finlake.operators.ranking import global_row_number, ntile_of_rank, with_ntile
from finlake.operators.keys import with_surrogate_key
from finlake.operators.topk import top_k_through_join

__all__ = ["lag_growth_pct", "moving_avg", "running_total", "with_share",
           "global_row_number", "ntile_of_rank", "with_ntile", "with_surrogate_key",
           "top_k_through_join"]
