"""Text helpers that follow the number, white-space and CSV rules of the tables that binning tools write."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space that a trim removes: Unicode spaces, line ends and the byte-order mark.
TRIMMED = r"[\s   -     　﻿]+"


def full_trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{TRIMMED}|{TRIMMED}$", "")


def is_blank(c: Column) -> Column:
    """Whether a trim leaves nothing."""
    return ~c.rlike(f"[^{TRIMMED[1:-2]}]")


#: What ``to_number`` reads of a trimmed cell.
NUMBER = r"^([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|0[xX][0-9a-fA-F]+)$|^([+-]?Infinity)?\z"


def is_number(c: Column) -> Column:
    """Whether ``to_number`` gives a number, blank cells included; one pattern, without the value."""
    return full_trim(c).rlike(NUMBER)


def to_number(c: Column) -> Column:
    """A cell as a double: blank is 0, hexadecimal and Infinity are read, what is no number is NaN."""
    t = full_trim(c)
    hexadecimal = F.conv(F.substr(t, F.lit(3)), 16, 10).try_cast("double")
    plain = t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return (
        F.when(t == "", F.lit(0.0))
        .when(t.rlike("^0[xX][0-9a-fA-F]+$"), hexadecimal)
        .when(t.isin("Infinity", "+Infinity"), F.lit(float("inf")))
        .when(t == "-Infinity", F.lit(float("-inf")))
        .when(plain, t.try_cast("double"))
        .otherwise(F.lit(float("nan")))
    )


def csv_field(c: Column) -> Column:
    """Quoted only if it holds a quote, a comma or a line end; null is empty."""
    t = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(t.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


@F.pandas_udf(StringType())
def to_fixed(values, digits):
    """A double with a set number of decimals, rounding its exact binary value half away from zero."""
    from decimal import ROUND_HALF_UP, Decimal

    import pandas as pd

    def one(x, d):
        if x is None or pd.isna(x):
            return "NaN"
        q = Decimal(float(x)).quantize(Decimal(1).scaleb(-int(d)), rounding=ROUND_HALF_UP)
        return f"{q:f}"

    return pd.Series([one(x, d) for x, d in zip(values, digits, strict=True)])


def file_label(path: Column) -> Column:
    """A file's name without folders and last extension; names that start with a dot stay whole."""
    name = F.element_at(F.split(path, r"[/\\]"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
