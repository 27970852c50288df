"""Pages of any depth by distributed selection, without sorting the rows before them.

A total order is given as a list of ``Key``s: raw columns with a direction, each
of which can be read as an ascending whole number and turned back into a filter
on the raw column.  A page of ``size`` rows after ``skip`` others is found by
refining one range of the order:

1. while the rows to skip inside the range are more than ``TAKE``, count the
   range's rows by the next digit (at most ``DIGITS`` equal-width digits of the
   current key between its least and largest value; a partial aggregate, a few
   numbers a task), move the lower bound to the digit that holds the page's
   first row and the upper bound to the one that holds its last;
2. a digit that is still too large is refined by the next digit of the same
   key, and when the key is one value there, by the next key: rows of one
   instant are told apart by the tie-break;
3. the page is the first rows of what is left: a top-k with a bounded heap in
   each task, over a scan with the range as literal filters, which reach the
   parquet statistics where a key is a stored column.

A first page needs no counting: it is step 3 over all rows.  No bucket is ever
sorted or gathered in one task, however large it is.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiccases.functions.expr import ts_lit

#: rows that a task's heap may skip; digits counted in one round
TAKE, DIGITS = 1_000, 1_024
LOW, HIGH = -(2 ** 63), 2 ** 63 - 1
EPOCH = datetime(1970, 1, 1)


@dataclass(frozen=True)
class Key:
    """One column of the order.  kind: 'long' or 'time' (timestamp_ntz)."""
    column: Column
    kind: str = "long"
    descending: bool = False
    nulls_first: bool = False

    @property
    def sort(self) -> Column:
        c = self.column
        if self.descending:
            return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()

    @property
    def null_number(self) -> int:
        return LOW if self.nulls_first else HIGH

    @property
    def number(self) -> Column:
        """Ascending along the order; NULL is the least or largest long."""
        c = self.column
        n = F.timestamp_diff("MICROSECOND", ts_lit(EPOCH), c) if self.kind == "time" else c.cast("long")
        return F.coalesce(-n if self.descending else n, F.lit(self.null_number))

    def _literal(self, number: int) -> Column:
        number = -number if self.descending else number
        return ts_lit(EPOCH + timedelta(microseconds=number)) if self.kind == "time" else F.lit(number)

    def between(self, low: int, high: int) -> Column:
        """Rows whose number is in [low, high], as a filter on the column itself."""
        null = self.column.isNull()
        if low == high == self.null_number:
            return null
        holds_null = low <= self.null_number <= high
        # values next to a null's number are the null's; others bound the column from both sides
        low, high = (low + 1 if low == LOW else low), (high - 1 if high == HIGH else high)
        inside = F.lit(True)
        first, last = (high, low) if self.descending else (low, high)
        if abs(first) < HIGH - 1:
            inside = inside & (self.column >= self._literal(first))
        if abs(last) < HIGH - 1:
            inside = inside & (self.column <= self._literal(last))
        return null | inside if holds_null else self.column.isNotNull() & inside


def _histogram(df: DataFrame, key: Key) -> list[tuple[int, int, int]]:
    """(least number, largest number, rows) of the non-empty digits, ascending; NULL is a digit of its own."""
    numbers = df.select(key.number.alias("x"))
    real = F.when((F.col("x") != LOW) & (F.col("x") != HIGH), F.col("x"))
    low, high = numbers.agg(F.min(real), F.max(real)).first()
    width = 1 if low is None else (high - low) // DIGITS + 1
    digit = F.when(real.isNull(), F.when(F.col("x") == LOW, -1).otherwise(DIGITS)).otherwise(
        F.expr(f"(x - {low or 0}L) div {width}L"))
    rows = numbers.groupBy(digit.alias("d")).agg(
        F.min("x").alias("low"), F.max("x").alias("high"), F.count(F.lit(1)).alias("n")).collect()
    return sorted((r["low"], r["high"], r["n"]) for r in rows)


def page(df: DataFrame, keys: list[Key], page_no: int, page_size: int, take: int | None = None) -> DataFrame:
    """LIMIT page_size OFFSET (page_no - 1) * page_size in the total order of ``keys``.

    Deep pages run the counting rounds when this is called, over the sort
    columns only; the returned frame is one scan.
    """
    if page_no < 1:
        raise ValueError("page must be >= 1")
    take = TAKE if take is None else take
    skip = (page_no - 1) * page_size
    # the page's first row is row ``skip`` of ``inside``; ``behind`` holds what may follow the rows of ``inside``
    inside, behind, k = F.lit(True), None, 0
    while skip > take and k < len(keys):
        key = keys[k]
        digits = _histogram(df.where(inside), key)
        at = 0
        while at < len(digits) and digits[at][2] <= skip:
            skip -= digits[at][2]
            at += 1
        if at == len(digits):
            return df.where(F.lit(False))  # less rows than are skipped; only the first round can find that
        low, high, n = digits[at]
        missing, end = skip + page_size - n, high
        for _, top, more in digits[at + 1:]:
            if missing <= 0:
                break
            end, missing = top, missing - more
        if missing <= 0:
            behind = None
        if end > high:
            rest = inside & key.between(high + 1, end)
            behind = rest if behind is None else rest | behind
        inside = inside & key.between(low, high)
        k += low == high
    return _taken(df.where(inside if behind is None else inside | behind), keys, skip, page_size)


def _taken(df: DataFrame, keys: list[Key], skip: int, size: int) -> DataFrame:
    return df.orderBy(*[key.sort for key in keys]).offset(skip).limit(size)
