"""Column functions for text, markup and small encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def printable(text: Column) -> Column:
    """Runs of control characters become one space."""
    return F.regexp_replace(text, r"[\x00-\x1F\x7F]+", " ")


def one_line(*values: Column, separator: str = "|") -> Column:
    """Values in one line of a delimited file: separators and control characters inside them become spaces, nulls are empty."""
    clean = [F.translate(printable(F.coalesce(v.cast("string"), F.lit(""))), separator, " ") for v in values]
    return F.concat_ws(separator, *clean)


def wildcard_key(key: Column, separator: str = "-") -> Column:
    """A key whose second segment is replaced by a dot."""
    return F.regexp_replace(key, f"^([^{separator}]*){separator}[^{separator}]*", f"$1{separator}.")


def iso_millis(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def without_prolog(xml: Column) -> Column:
    return F.regexp_replace(xml, r"^\s*(<\?xml[^>]*\?>|<!DOCTYPE[^>]*>|<!--.*?-->|\s)*", "")


def vertices(points: Column) -> Column:
    """'x,y x,y ...' as an array of structs; pairs that aren't numbers are left out."""
    parsed = F.transform(F.split(F.trim(points), r"\s+"), lambda p: F.struct(F.get(F.split(p, ","), F.lit(0)).try_cast("double").alias("x"), F.get(F.split(p, ","), F.lit(1)).try_cast("double").alias("y")))
    return F.filter(parsed, lambda v: v["x"].isNotNull() & v["y"].isNotNull())


def centroid(points: Column) -> Column:
    """The mean of an array of (x, y), null of an empty one."""
    mean = lambda axis: F.aggregate(points, F.lit(0.0), lambda acc, v: acc + v[axis]) / F.nullif(F.size(points), F.lit(0))
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def shape(xml: Column, root: str = "/shape") -> Column:
    """vertices (array of x, y) and closed of a shape in markup, in either of two forms.

    Elements <vertex x="" y=""/> below <line closed="">, or, if there are none, elements
    <link point="x,y"/>. Without a statement a shape is closed if it ends where it began.
    """
    xs, ys = (F.xpath(xml, F.lit(f"{root}/line/vertex/@{a}")) for a in "xy")
    pairs = F.zip_with(xs, ys, lambda x, y: F.struct(x.try_cast("double").alias("x"), y.try_cast("double").alias("y")))
    links = F.transform(F.xpath(xml, F.lit(f"{root}/link/@point")), lambda p: F.struct(F.get(F.split(p, ","), F.lit(0)).try_cast("double").alias("x"), F.get(F.split(p, ","), F.lit(1)).try_cast("double").alias("y")))
    known = lambda points: F.filter(points, lambda v: v["x"].isNotNull() & v["y"].isNotNull())
    points = F.when(F.size(known(pairs)) > 0, known(pairs)).otherwise(known(links))
    said = F.lower(F.trim(F.get(F.xpath(xml, F.lit(f"{root}/line/@closed")), F.lit(0))))
    return F.struct(points.alias("vertices"), F.when(said.isNotNull(), said == "true").otherwise((F.size(points) > 2) & (F.get(points, F.lit(0)) == F.get(points, F.size(points) - 1))).alias("closed"))


def ring(points: Column) -> Column:
    """Vertices that end where they begin."""
    return F.when((F.size(points) > 0) & (F.get(points, F.lit(0)) != F.get(points, F.size(points) - 1)), F.concat(points, F.slice(points, 1, 1))).otherwise(points)


def weighted_labels(mix: Column) -> Column:
    """'f=4,h=2' as an array of labels, each as often as it weighs."""
    one = F.transform(F.split(mix, ","), lambda p: F.array_repeat(F.trim(F.get(F.split(p, "="), F.lit(0))), F.get(F.split(p, "="), F.lit(1)).try_cast("int")))
    return F.flatten(F.filter(one, lambda a: a.isNotNull()))


def payload_kind(payload: Column) -> Column:
    """What a binary payload looks like, by its first bytes: the first rule that fits."""
    head = F.hex(F.substring(payload, 1, 8))
    return (
        F.when(F.octet_length(payload) == 0, "empty")
        .when(head.startswith("3C"), "xml")
        .when(head.startswith("7B") | head.startswith("5B"), "json")
        .when(head.startswith("1F8B"), "gzip")
        .when(head.startswith("060E2B34"), "klv")
        .when(head.startswith("47"), "ts")
        .when(F.is_valid_utf8(payload.cast("string")) & ~payload.cast("string").rlike(r"[\x00-\x08\x0E-\x1F]"), "text")
        .otherwise("binary")
    )


def big_endian(data: Column, start: int, width: int, signed: bool = False) -> Column:
    """The integer of width (up to 7) bytes at a 1-based place of a binary column."""
    value = F.conv(F.hex(F.substring(data, start, width)), 16, 10).cast("bigint")
    return F.when(value >= 1 << (8 * width - 1), value - (1 << 8 * width)).otherwise(value) if signed else value


def fixed_angle(data: Column, start: int, width: int = 4, full: float = 360.0, signed: bool = False) -> Column:
    """A fixed-point angle: an unsigned fraction of full, or a signed one of half of it."""
    return big_endian(data, start, width, signed) * F.lit(full / 2 ** (8 * width))


#: Sequences of four, three and two octets in UTF-8, a character standing for an octet. None is a part of another.
_SEQUENCES = (
    r"\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2}",
    r"\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]",
    r"[\xC2-\xDF][\x80-\xBF]",
)
# What Windows-1252 has at 80 to 9F; five of these places are empty.
_AT_80 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"


def utf8_faults(data: Column) -> Column:
    """offset (from 0), octet (hex) and meant of each octet of a binary that no UTF-8 sequence covers; meant is what it is in Windows-1252."""
    masked = F.decode(data, "ISO-8859-1")
    for n, sequences in zip((4, 3, 2), _SEQUENCES):
        masked = F.regexp_replace(masked, sequences, "." * n)
    parts = F.split(masked, r"[\x80-\xFF]", -1)
    bad = F.regexp_extract_all(masked, F.lit(r"[\x80-\xFF]"), F.lit(0))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("places"))
    places = F.aggregate(parts, begin, lambda acc, p: F.struct((acc["at"] + F.length(p) + 1).alias("at"), F.concat(acc["places"], F.array(acc["at"] + F.length(p))).alias("places")), lambda acc: acc["places"])
    octet = lambda c: F.hex(F.encode(c, "ISO-8859-1"))
    meant = lambda c: F.translate(c, "".join(map(chr, range(0x80, 0xA0))), _AT_80)
    return F.zip_with(F.slice(places, 1, F.size(bad)), bad, lambda p, c: F.struct(p.alias("offset"), octet(c).alias("octet"), meant(c).alias("meant")))


def encoding_of(data: Column) -> Column:
    """'ascii', 'utf-8' or, of bytes that are neither, 'other'; null of null."""
    read = data.cast("string")
    return F.when(~F.is_valid_utf8(read), "other").when(F.octet_length(read) == F.length(read), "ascii").when(data.isNotNull(), "utf-8")
