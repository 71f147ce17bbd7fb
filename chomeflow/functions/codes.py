"""Prefecture and local government codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def check_digit(base: Column) -> Column:
    """The modulus-11 check digit of a 5-digit base code; null for anything else."""
    total = sum(F.substring(base, i + 1, 1).try_cast("int") * (6 - i) for i in range(5))
    rest = total % 11
    digit = F.when(rest <= 1, (11 - rest) % 10).otherwise(11 - rest).cast("string")
    return F.when(base.rlike("^[0-9]{5}$"), digit)


def checked_digit(base: Column) -> Column:
    """The check digit; a code that isn't 5 digits fails the query."""
    return F.coalesce(check_digit(base), F.raise_error(F.concat(F.lit("a base code has 5 digits, not "), base)).cast("string"))


def prefecture_code(lg_code: Column) -> Column:
    return F.substring(lg_code, 1, 2)


def base_code(lg_code: Column) -> Column:
    return F.substring(lg_code, 1, 5)


def last_digit(lg_code: Column) -> Column:
    return F.substring(lg_code, 6, 1)


def is_valid_code(lg_code: Column) -> Column:
    """Whether a code has 6 digits and its last one is right."""
    return F.coalesce(lg_code.rlike("^[0-9]{6}$") & (check_digit(base_code(lg_code)) == last_digit(lg_code)), F.lit(False))


def is_prefecture_code(code: Column) -> Column:
    return F.coalesce(code.rlike("^(0[1-9]|[1-3][0-9]|4[0-7])$"), F.lit(False))
