"""SQL text builders for exact decimal arithmetic in DuckDB.

DuckDB turns DECIMAL division and AVG into DOUBLE; the reference semantics
(and the Spark plans) are exact decimals rounded HALF_UP.  These helpers
compute in HUGEINT "units" (value * 10^scale) instead.
"""
from __future__ import annotations


def hu(n: str, d: int) -> str:
    """HALF_UP(n / d) for an integer expression n and a positive literal d."""
    if d == 1:
        return f"({n})"
    return f"(SIGN({n}) * ((2 * ABS({n}) + {d}) // {2 * d}))"


def hu2(n: str, d: str) -> str:
    """HALF_UP(n / d) for integer expressions; NULL when d is 0."""
    return (f"(SIGN({n}) * SIGN({d}) * ((2 * ABS({n}) + ABS({d})) "
            f"// NULLIF(2 * ABS({d}), 0)))")


def units(x: str, s: int) -> str:
    """DECIMAL x with scale <= s as HUGEINT count of 10^-s."""
    return f"CAST(({x}) * {10 ** s} AS HUGEINT)"


def as_double(u: str, s: int) -> str:
    """Units of 10^-s -> DOUBLE (correctly rounded, as a DECIMAL cast would be)."""
    if s == 0:
        return f"CAST({u} AS DOUBLE)"
    return f"(CAST({u} AS DOUBLE) / {10 ** s})"


def as_decimal(u: str, s: int) -> str:
    """Units of 10^-s -> exact DECIMAL with scale s."""
    if s == 0:
        return f"CAST({u} AS DECIMAL(30,0))"
    return f"(CAST({u} AS DECIMAL(30,0)) * CAST({1 / 10 ** s:.{s}f} AS DECIMAL({s + 1},{s})))"


def avg_units(x: str, s: int) -> str:
    """AVG(x) of a DECIMAL with scale s: units of 10^-(s+4), HALF_UP."""
    return hu2(f"SUM({units(x, s)}) * 10000", f"COUNT({x})")


def avg_r(x: str, s: int, d: int) -> str:
    """ROUND(AVG(x), d) as DOUBLE, x DECIMAL with scale s (integers: s=0)."""
    return as_double(hu(avg_units(x, s), 10 ** (s + 4 - d)), d)


def sum_r(x: str, d: int = 0) -> str:
    """ROUND(SUM(x), d) as DOUBLE (DuckDB sums decimals exactly)."""
    return f"CAST(ROUND(SUM({x}), {d}) AS DOUBLE)"


def q6(num_units: str, den_units: str) -> str:
    """num/den at 6 decimals (units of 1e-6), HALF_UP; operands in equal units."""
    return hu2(f"({num_units}) * 1000000", den_units)


def pct_units(num_units: str, den_units: str, d: int = 2) -> str:
    """ROUND(num/den*100, d) in units of 10^-d."""
    return hu(f"{q6(num_units, den_units)} * 100", 10 ** (6 - d))


def pct_r(num_units: str, den_units: str, d: int = 2) -> str:
    """ROUND(num/den*100, d) as DOUBLE."""
    return as_double(pct_units(num_units, den_units, d), d)


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def i32(x: str) -> str:
    return f"CAST({x} AS INTEGER)"
