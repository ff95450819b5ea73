"""Records of loose shape as Columns: coerced feed values, packed rows, preferences, pictures and display classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
TEXT_KEYS = ["_", "#text", "text", "value"]
IMAGE_AREA, IMAGE_SIDE, IMAGE_ASPECT, IMAGE_BYTES = 90_000, 120, 5.0, 1024
SIGNATURES = {"png": "89504E47", "gif": "47494638", "jpeg": "FFD8FF"}
STYLES = [("reddit", "reddit"), ("(x)", "x"), ("twitter", "x"), ("telegram", "telegram"), ("gnews", "gnews")]
CATEGORY_COLOURS = {"conflict": "red", "disaster": "orange", "politics": "blue", "health": "green"}
TIER_LABELS = {1: "established", 2: "regional", 3: "unverified"}


def coerced_text(json: Column) -> Column:
    """The text of a loose JSON value: scalars as they are, lists joined by spaces, objects by their first text key."""
    v = F.try_parse_json(json)
    items = F.try_variant_get(v, "$", "array<string>")
    keyed = F.coalesce(*[F.nullif(F.try_variant_get(v, f"$['{k}']", "string"), F.lit("")) for k in TEXT_KEYS])
    kind = F.schema_of_variant(v)
    scalar = F.try_variant_get(v, "$", "string")
    return F.coalesce(F.when(kind.startswith("ARRAY"), F.array_join(F.filter(items, lambda x: x != ""), " ")).when(kind.startswith("OBJECT"), keyed).otherwise(scalar), F.lit(""))


def wrong_type(json: Column, path: str, wanted: str) -> Column:
    """Whether a field of a JSON record is there but not of the wanted kind (BIGINT, STRING, ..)."""
    field = F.try_variant_get(F.try_parse_json(json), path, "variant")
    return F.coalesce(field.isNotNull() & (F.schema_of_variant(field) != wanted), F.lit(False))


def packed_rows(text: Column) -> Column:
    """Rows packed as "a,b|c,d" with the second number in base 36, as array<struct<name, number>>."""
    one = lambda r: F.struct(F.get(F.split(r, ","), F.lit(0)).alias("name"), F.conv(F.get(F.split(r, ","), F.lit(1)), 36, 10).cast("bigint").alias("number"))
    return F.transform(F.filter(F.split(text, r"\|"), lambda r: r != ""), one)


def chosen_of(values: Column, allowed: list[str]) -> Column:
    """Distinct values that are allowed, in their order."""
    return F.array_distinct(F.filter(values, lambda v: v.isin(allowed)))


def clamped(value: Column, low: int, high: int) -> Column:
    """A whole number within bounds; what is missing or not a number is the lower one."""
    whole = F.floor(value.try_cast("double") + 0.5)
    return F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(whole, F.lit(low)))).cast("int")


def image_kind(head: Column) -> Column:
    """png, gif, jpeg or webp by a file's first bytes, else null."""
    text = F.hex(head)
    out = reduce(lambda w, p: w.when(text.startswith(p[1]), p[0]), SIGNATURES.items(), F)
    return out.when(text.startswith("52494646") & (F.substring(text, 17, 8) == "57454250"), "webp")


def image_size(head: Column) -> Column:
    """struct<width, height> of a PNG, GIF or extended WebP file by its first thirty bytes; null of others."""
    text = F.hex(head)
    big = lambda at, n: F.conv(F.substring(text, 2 * at + 1, 2 * n), 16, 10).cast("int")
    little = lambda at, n: F.conv(F.concat(*[F.substring(text, 2 * (at + i) + 1, 2) for i in reversed(range(n))]), 16, 10).cast("int")
    size = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    kind = image_kind(head)
    extended = (kind == "webp") & (F.substring(text, 25, 8) == "56503858") & (F.length(text) >= 60)
    return (
        F.when((kind == "png") & (F.length(text) >= 48), size(big(16, 4), big(20, 4)))
        .when((kind == "gif") & (F.length(text) >= 20), size(little(6, 2), little(8, 2)))
        .when(extended, size(little(24, 3) + 1, little(27, 3) + 1))
    )


def good_image(width: Column, height: Column, size: Column) -> Column:
    """Large and square enough; of unknown dimensions, long enough."""
    known = width.isNotNull() & height.isNotNull()
    short, long = F.least(width, height), F.greatest(width, height)
    return F.when(known, (width * height >= IMAGE_AREA) & (short >= IMAGE_SIDE) & (long <= short * IMAGE_ASPECT)).otherwise(F.coalesce(size >= IMAGE_BYTES, F.lit(False)))


def source_style(name: Column) -> Column:
    """The display class of a source, by what its name holds."""
    low = F.lower(name)
    return F.coalesce(*[F.when(low.contains(part), F.lit(style)) for part, style in STYLES], F.lit("feed"))


def lookup(key: Column, values: dict, default: str) -> Column:
    """A value of a small fixed table."""
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def tessellated(x0: Column, y0: Column, x1: Column, y1: Column, step: float) -> Column:
    """Points along a segment at most ``step`` apart, both ends included, as array<struct<x, y>>."""
    n = F.greatest(F.lit(1), F.ceil(F.sqrt(F.pow(x1 - x0, 2) + F.pow(y1 - y0, 2)) / step)).cast("int")
    at = lambda i: F.struct((x0 + (x1 - x0) * i / n).alias("x"), (y0 + (y1 - y0) * i / n).alias("y"))
    return F.transform(F.sequence(F.lit(0), n), at)


def since_ms(now_ms: int, range_ms: int) -> int:
    """The start of a range that ends now, now cut to the minute so that requests of one minute agree."""
    return now_ms // 60_000 * 60_000 - range_ms
