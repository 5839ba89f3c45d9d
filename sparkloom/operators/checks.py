"""Row checks with reasons, and schemas: what two have in common, and both as one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def with_reasons(df: DataFrame, rules: dict[str, Column], name: str = "reasons") -> DataFrame:
    """df with the names of the rules that a row breaks; a rule that gives null is broken."""
    broken = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(label)) for label, rule in rules.items()]
    return df.withColumn(name, F.array_compact(F.array(*broken)))


def accepted(df: DataFrame, name: str = "reasons") -> DataFrame:
    return df.where(F.size(name) == 0).drop(name)


def rejected(df: DataFrame, name: str = "reasons") -> DataFrame:
    return df.where(F.size(name) > 0)


def valid_position(lat: Column, lon: Column) -> Column:
    """Whether numbers are a place on Earth; (0, 0) stands for none. Null if either is."""
    return lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))


def in_range(x: Column, y: Column, limit: float) -> Column:
    """Whether a place on a plane is no further from its origin than limit; null if either number is."""
    return F.hypot(x, y) <= limit


def merged_schema(a: StructType, b: StructType) -> StructType:
    """a with what only b has, in structs within structs too; where types differ a's stays."""
    fields = {f.name: f for f in a}
    for f in b:
        own = fields.get(f.name)
        if own is None:
            fields[f.name] = StructField(f.name, f.dataType, True, f.metadata)
        elif isinstance(own.dataType, StructType) and isinstance(f.dataType, StructType):
            fields[f.name] = StructField(f.name, merged_schema(own.dataType, f.dataType), own.nullable, own.metadata)
    return StructType(list(fields.values()))


def schema_differences(a: StructType, b: StructType, path: str = "") -> list[tuple[str, str]]:
    """(path, 'left', 'right' or 'type') of every field that isn't in both with one type."""
    left, right, out = {f.name: f.dataType for f in a}, {f.name: f.dataType for f in b}, []
    for name in [*left, *(n for n in right if n not in left)]:
        at = f"{path}{name}"
        if name not in right:
            out.append((at, "left"))
        elif name not in left:
            out.append((at, "right"))
        elif isinstance(left[name], StructType) and isinstance(right[name], StructType):
            out += schema_differences(left[name], right[name], f"{at}.")
        elif left[name] != right[name]:
            out.append((at, "type"))
    return out
