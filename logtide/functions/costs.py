"""Prices and money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# US dollars.
PRICES = {"STANDARD_IA": 0.0125, "GLACIER_IR": 0.004}
STANDARD, LOG_STORAGE, LOG_INGEST, LOG_RATIO = 0.023, 0.03, 0.50, 4.0
SIZE_FACTOR, BYPASS, DAYS_PER_MONTH = 0.65, 0.9, 30.0


def gib(n: Column) -> Column:
    return n / 1073741824.0


def price_per_gib_month(storage_class: Column) -> Column:
    out = F.lit(STANDARD)
    for name, price in PRICES.items():
        out = F.when(storage_class == name, F.lit(price)).otherwise(out)
    return out


def ratio(raw: Column, compressed: Column, missing: Column) -> Column:
    return F.when((missing == 0) & (raw > 0) & (compressed > 0), raw / compressed)


def retention_label(days: Column) -> Column:
    return F.coalesce(F.concat(days.cast("string"), F.lit("d")), F.lit("never!"))


def money(amount: Column) -> Column:
    return F.format_string("%.2f", amount)
