"""Column expressions that several jobs share."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

SKIP_REASONS = ("fwdbtn",)


def fold(c: Column) -> Column:
    """Lower-case A-Z only: names that differ in ASCII case are one."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def js_round(c: Column, digits: int = 0) -> Column:
    """Halves go up, also below zero."""
    return F.floor(c * 10**digits + 0.5) / 10**digits


def is_skip(reason: Column, reasons=SKIP_REASONS) -> Column:
    return F.coalesce(reason.isin(*reasons), F.lit(False))


def local_time(ts: Column) -> Column:
    """History's fixed local time, five hours behind UTC."""
    return ts - F.expr("INTERVAL 5 HOURS")
