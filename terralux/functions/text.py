"""Number formatting that Spark's own formatter does not offer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _trimmed(number: Column, decimals: int) -> Column:
    text = number.cast(f"decimal(38, {decimals})").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def general(value: Column, digits: int) -> Column:
    """Shortest of fixed and scientific with ``digits`` significant digits, zeros trimmed."""
    magnitude = F.floor(F.log10(F.nullif(F.abs(value), F.lit(0.0)))).cast("int")
    # Rounding may carry into the next power of ten.
    lead = F.rint(value / F.pow(F.lit(10.0), magnitude) * 10.0 ** (digits - 1)) / 10.0 ** (digits - 1)
    carried = F.abs(lead) >= 10.0
    exponent = F.when(carried, magnitude + 1).otherwise(magnitude)
    lead = F.when(carried, lead / 10.0).otherwise(lead)
    fixed = _trimmed(lead * F.pow(F.lit(10.0), exponent), 12)
    sign = F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+"))
    scientific = F.concat(_trimmed(lead, 12), sign, F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(value == 0.0, F.lit("0"))
        .when((exponent < -4) | (exponent >= digits), scientific)
        .otherwise(fixed)
    )
