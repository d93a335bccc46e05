"""UTF-16 lengths and offsets, XML escaping, and checks of names and JSON texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf16_length(text: Column) -> Column:
    """UTF-16 code units: the unit of lengths and positions in texts. One a character, and one more beyond the basic plane."""
    return (F.char_length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))).cast("long")


def utf16_slice(text: Column, start: Column | int, length: Column | int) -> Column:
    """The text of ``length`` code units from ``start`` (0-based) on; half of a surrogate pair becomes U+FFFD."""
    start, length = (x if isinstance(x, Column) else F.lit(x) for x in (start, length))

    def ends(units: Column) -> Column:
        # Each half of a pair would fail to decode, so it is replaced first, at either end.
        low, high = (F.hex(F.substring(units, at, 2)).rlike(kind) for at, kind in ((1, "^D[C-F]"), (-2, "^D[89AB]")))
        return F.struct(units.alias("units"), low.alias("low"), (high & ((F.octet_length(units) > 2) | ~low)).alias("high"))

    def mended(x: Column) -> Column:
        units, mark = x["units"], F.lit("�")
        kept = F.substring(units, F.when(x["low"], 3).otherwise(1), (F.octet_length(units) - F.when(x["low"], 2).otherwise(0) - F.when(x["high"], 2).otherwise(0)).cast("int"))
        return F.concat(F.when(x["low"], mark).otherwise(""), F.decode(kept, "UTF-16BE"), F.when(x["high"], mark).otherwise(""))

    units = F.substring(F.encode(text, "UTF-16BE"), (start * 2 + 1).cast("int"), (length * 2).cast("int"))
    # Bound once, so that slices of slices stay short expressions.
    return F.transform(F.transform(F.array(units), ends), mended)[0]


def xml_escape_text(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def xml_escape_attribute(text: Column) -> Column:
    """Escapes & < and the double quote; > may stand in an attribute."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


def room_name_valid(name: Column) -> Column:
    """1 to 255 bytes, neither . nor .., no control characters."""
    return F.coalesce((F.octet_length(name) >= 1) & (F.octet_length(name) <= 255) & ~name.isin(".", "..") & ~name.rlike(r"[\x00-\x1F\x7F]"), F.lit(False))


def json_depth(text: Column) -> Column:
    """Deepest nesting of brackets outside strings; null for a text that ends within a string."""
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', "")
    steps = F.transform(F.regexp_extract_all(bare, F.lit(r"[\[\]{}]"), F.lit(0)), lambda c: F.when(c.isin("[", "{"), 1).otherwise(-1))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    deepest = F.aggregate(steps, start, lambda a, s: F.struct((a["now"] + s).alias("now"), F.greatest(a["most"], a["now"] + s).alias("most")), lambda a: a["most"])
    return F.when(~bare.contains('"'), deepest)


def attribute_changes(now: Column, before: Column) -> Column:
    """What turns the attribute map ``before`` into ``now``: changed and new values, null for those removed."""
    fresh = F.map_filter(now, lambda k, v: ~F.coalesce(before[k].eqNullSafe(v), F.lit(False)) | ~F.map_contains_key(before, k))
    gone = F.map_filter(before, lambda k, v: ~F.map_contains_key(now, k))
    return F.map_concat(fresh, F.transform_values(gone, lambda k, v: F.lit(None).cast("string")))


