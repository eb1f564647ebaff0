"""Amounts stay text: currencies differ and nothing is summed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import let, text, trimmed


def format_amount(c: Column) -> Column:
    """Rounded, thousands apart by blanks; "" unless it is a number over zero."""
    number = F.regexp_replace(text(c), r"(?U)[\s,]", "").try_cast("double")
    return let(number, lambda n: F.when((n > 0) & (n < 1e15), F.replace(F.format_number(F.floor(n + 0.5), 0), F.lit(","), F.lit(" "))).otherwise(""))


def budget_single(amount: Column, currency: Column) -> Column:
    """The amount with its currency, which is in capitals."""
    return let(format_amount(amount), lambda shown: F.when(shown == "", "").otherwise(trimmed(F.concat_ws(" ", shown, F.upper(trimmed(text(currency)))))))


def budget_range(low: Column, high: Column, currency: Column) -> Column:
    """"a - b CUR"; one amount if they are equal, "jusqu'a" or "a partir de" if one is missing."""
    def said(x: Column) -> Column:
        a, b = x["a"], x["b"]
        return F.when((a != "") & (b != ""), F.when(a == b, a).otherwise(F.concat_ws(" - ", a, b))).when(b != "", F.concat(F.lit("jusqu'a "), b)).when(a != "", F.concat(F.lit("a partir de "), a)).otherwise("")

    both = F.struct(format_amount(low).alias("a"), format_amount(high).alias("b"))
    return let(let(both, said), lambda s: F.when(s == "", "").otherwise(trimmed(F.concat_ws(" ", s, F.upper(trimmed(text(currency)))))))
