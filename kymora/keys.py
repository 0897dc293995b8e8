"""Binding of an operator to a table: which columns are the subject, the time and the order of rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Microseconds in a second, minute, hour and day.
SECOND, MINUTE, HOUR, DAY = 1_000_000, 60_000_000, 3_600_000_000, 86_400_000_000


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    c = F.col(ts)
    second = (F.extract(F.lit("SECOND"), c).cast("decimal(10,6)") * 1_000_000).cast("bigint")
    days = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * DAY + F.hour(c).cast("bigint") * HOUR + F.minute(c).cast("bigint") * MINUTE + second


@dataclass(frozen=True)
class Stream:
    """A keyed, ordered table: ``subject`` columns, a bigint time in microseconds and a column that breaks ties."""

    subject: tuple[str, ...] = ("user_id",)
    us: str = "us"
    tie: str | None = "event_id"

    @property
    def order(self) -> list[str]:
        return [self.us, self.tie] if self.tie else [self.us]

    def rows(self, first: int | None = None, last: int = 0):
        """Rows from ``first`` (None: all before) to ``last`` about the current one."""
        w = Window.partitionBy(*self.subject).orderBy(*self.order)
        return w.rowsBetween(Window.unboundedPreceding if first is None else first, last)

    def plain(self):
        return Window.partitionBy(*self.subject).orderBy(*self.order)

    def range(self, first: int, last: int = 0):
        """Rows whose time lies within [now + first, now + last] microseconds, both ends included."""
        return Window.partitionBy(*self.subject).orderBy(self.us).rangeBetween(first, last)

    def whole(self):
        return Window.partitionBy(*self.subject)

    def seconds(self) -> Column:
        """Seconds since the row before; null at a subject's first."""
        return (F.col(self.us) - F.lag(self.us).over(self.plain())) / float(SECOND)


def frames(events: DataFrame) -> DataFrame:
    """The events table as a frame stream: user_id, event_id, us, x (value), kind (event_type), k (props.k)."""
    return events.select(
        "user_id", "event_id", micros("ts").alias("us"), F.col("value").alias("x"), F.col("event_type").alias("kind"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
