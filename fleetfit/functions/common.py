"""Small shared column helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def nan_to_null(col: Column) -> Column:
    """Missing measurements are NULL in every plan; NaN would poison max and avg."""
    return F.nanvl(col, F.lit(None).cast("double"))


def r6(col: Column | str) -> Column:
    """Six digits, with negative zero folded into zero."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col, 6) + F.lit(0.0)


def fixed(x: Column, digits: int) -> Column:
    """Text with a fixed number of digits, rounded from the exact binary value, halves to even.

    Formatting functions round the shortest decimal form of a double, so 97.25 and 0.35 would end
    in another digit than where the binary value is rounded. A double times a power of two is exact
    and, at the magnitudes of the model, a whole number; the rest is integer arithmetic.
    """
    size = F.abs(x)

    def rounded(bits: int) -> Column:
        unit = F.lit(2**bits).cast("decimal(19,0)")
        scaled = (size * F.lit(float(2**bits))).cast("long").cast("decimal(19,0)") * F.lit(10**digits).cast("decimal(4,0)")
        whole, rest = F.call_function("div", scaled, unit), (scaled % unit) * 2
        up = (rest > unit) | ((rest == unit) & (whole % 2 == 1))
        return whole + F.when(up, 1).otherwise(0)

    # 2**50 is exact from 4 up, 2**39 from 8192 up.
    n = F.when(size < 8192, rounded(50)).when(size < 1.6e7, rounded(39))
    fraction = F.lpad((n % 10**digits).cast("string"), digits, "0")
    sign = F.when(x < 0, "-").otherwise("")
    text = F.concat(sign, F.call_function("div", n, F.lit(10**digits)).cast("string"), F.lit("."), fraction)
    return F.when(n.isNotNull(), text).when(x.isNotNull(), F.format_string(f"%.{digits}f", x))


def text_list(col: Column) -> Column:
    return F.concat_ws("|", col)
