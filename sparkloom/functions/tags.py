"""Tagged records in SQL: registered tables of tags, read by a table function."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.packets import tlv_items

ITEMS = "place int, tag int, name string, number double, text string, octets binary"


@dataclass(frozen=True)
class Tag:
    """A tag's name and what its value is: a text, or an integer of width octets, as it is or mapped onto low to high."""

    name: str
    width: int | None = None
    low: float | None = None
    high: float | None = None
    signed: bool = False

    def number(self, value: bytes) -> float | None:
        """Null for another width; the lowest signed value of a mapped tag stands for none."""
        if self.width is None or len(value) != self.width:
            return None
        raw, top = int.from_bytes(value, "big", signed=self.signed), 2 ** (8 * self.width) - 1
        if self.low is None:
            return float(raw)
        if not self.signed:
            return raw * (self.high - self.low) / top + self.low
        return None if raw == -(top // 2) - 1 else raw * (self.high - self.low) / (top - 1) + (self.high + self.low) / 2


def register(spark: SparkSession, function: str, tags: dict[int, Tag]) -> None:
    """Makes a table function of SQL: ``FROM t, LATERAL function(t.record)`` gives ITEMS of each item in a record.

    Tags that the table has not got come with their octets alone; a null record has no items.
    Several tables of tags are several functions. Rows go to Python in batches of many: with
    Arrow, Spark makes a batch of each single record's items.
    """

    class Items:
        def eval(self, record: bytes) -> Iterator[tuple]:
            for place, (tag, value) in enumerate(tlv_items(record)):
                known = tags.get(tag)
                text = value.decode("utf-8", "replace") if known and known.width is None else None
                yield place, tag, known and known.name, known.number(value) if known else None, text, value

    spark.udtf.register(function, F.udtf(Items, returnType=ITEMS, useArrow=False))
