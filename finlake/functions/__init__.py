"""Column-expression helpers (all JVM-side built-ins, no UDFs)."""
from finlake.functions.exact import (avg_dec, col_, dec, money_round, out_double,
                                     pct, quotient, round_avg, round_sum)
from finlake.functions.dates import (calendar_columns, date_key, parse_date)
from finlake.functions.parse import (parse_decimal, parse_flag, parse_int, clean_text)
from finlake.functions.enums import canonical_enum, enum_rank, order_by_enum

__all__ = ["avg_dec", "col_", "dec", "money_round", "out_double", "pct", "quotient",
           "round_avg", "round_sum", "calendar_columns", "date_key", "parse_date",
           "parse_decimal", "parse_flag", "parse_int", "clean_text", "enum_rank",
           "order_by_enum", "canonical_enum"]
