"""Scalar functions of operations data as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is masked to make messages of one kind equal, in this order.
MASKS = (
    ("[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<guid>"),
    ("0x[0-9a-fA-F]+", "<hex>"),
    ("\\b[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\b", "<ip>"),
    ("[0-9]+", "<n>"),
)


def signature(message: Column) -> Column:
    """The message with identifiers, addresses and numbers masked: equal for messages that differ in these only."""
    return reduce(lambda text, mask: F.regexp_replace(text, *mask), MASKS, message)


def quote_name(name: Column) -> Column:
    """``[name]`` with closing brackets doubled."""
    return F.concat(F.lit("["), F.replace(name, F.lit("]"), F.lit("]]")), F.lit("]"))


def excerpt(text: Column, size: int = 100) -> Column:
    """White space collapsed, trimmed, back ticks as quotes, cut to ``size`` characters."""
    return F.substring(F.replace(F.trim(F.regexp_replace(text, "[ \\t\\r\\n]+", " ")), F.lit("`"), F.lit("'")), 1, size)


def int_date(number: Column) -> Column:
    """A ``yyyymmdd`` integer as a date; null for 0 and for what is no date."""
    return F.try_to_date(F.lpad(F.nullif(number, F.lit(0)).cast("string"), 8, "0"), "yyyyMMdd")


def int_time_seconds(number: Column) -> Column:
    """An ``hhmmss`` integer as seconds; hours may have more digits."""
    n = number.cast("long")
    return F.floor(n / 10000) * 3600 + F.floor(n / 100) % 100 * 60 + n % 100


def seconds_between(start: Column, end: Column) -> Column:
    """Second boundaries crossed between two timestamps."""
    return F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))


def ratio(x: Column, y: Column) -> Column:
    """x / y, null where y is 0."""
    return x / F.nullif(y, F.lit(0))


def pages_to_mb(pages: Column) -> Column:
    """8 KB pages as megabytes, two decimals."""
    return F.round(pages * 8 / 1024, 2)


def estimated_pages(rows: Column, row_bytes: Column) -> Column:
    """Pages that an index of so many rows takes, at least 1."""
    return F.greatest(F.ceil(rows * (row_bytes + 10) / 8096), F.lit(1))


def nearly_equal(a: Column, b: Column, gap: float = 1e-6) -> Column:
    """Equal up to ``gap`` of the larger."""
    return (a == b) | (F.abs(a - b) < gap * F.greatest(F.abs(a), F.abs(b)))


def reasons(*conditions: tuple[Column, str]) -> Column:
    """The texts of the conditions that hold, joined by ``; ``; null if none does."""
    return F.nullif(F.concat_ws("; ", *[F.when(c, text) for c, text in conditions]), F.lit(""))


def first_reason(*conditions: tuple[Column, str]) -> Column:
    """The text of the first condition that holds; null if none does."""
    out = F.lit(None).cast("string")
    for c, text in reversed(conditions):
        out = F.when(c, text).otherwise(out)
    return out


def short_hash(text: Column, size: int = 12) -> Column:
    return F.substring(F.sha2(text, 256), 1, size)


def glob_match(name: Column, pattern: str) -> Column:
    """Shell glob on the lower-cased name; ``*`` and ``?`` do not match a slash."""
    parts = {"*": "[^/]*", "?": "[^/]"}
    return F.lower(name).rlike("^" + "".join(parts.get(c, "\\" + c if c in ".^$+{}()|\\[]" else c) for c in pattern.lower()) + "$")


def literal_like(text: Column, part: Column) -> Column:
    """Whether ``text`` holds ``part`` literally, any case."""
    return F.contains(F.lower(text), F.lower(part))


def stuff(text: Column, start: int, size: int, new: str) -> Column:
    """``size`` characters from ``start`` replaced by ``new``; null where ``start`` lies outside the text."""
    inside = (F.lit(start) >= 1) & (F.lit(start) <= F.char_length(text)) & (F.lit(size) >= 0)
    return F.when(inside, F.overlay(text, F.lit(new), start, size))


# The layouts of dates that are read, the most exact first; a fraction of a second is left out.
LAYOUTS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")


def parsed_time(text: Column) -> Column:
    """A date, with minutes or seconds or without, with ``T`` or a blank between; null for anything else."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), "^(\\d{4}-\\d\\d-\\d\\d)T", "$1 "), "(:\\d\\d:\\d\\d)\\.\\d+$", "$1")
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(layout)) for layout in LAYOUTS])


# Whole-number types with their ranges, and the words of a bit.
RANGES = {"tinyint": (0, 255), "smallint": (-32768, 32767), "int": (-2147483648, 2147483647), "bigint": (-9223372036854775808, 9223372036854775807)}
BITS = {"1": "1", "0": "0", "true": "1", "false": "0"}


def typed_text(value: Column, kind: str, size: int | None = None) -> Column:
    """The text of ``value`` as a parameter of type ``kind`` has it; null where it is no such value.

    Numbers keep within their range, ``varchar`` is ASCII, and ``size`` counts UTF-16 units, as the server does.
    """
    if kind in RANGES:
        low, high = RANGES[kind]
        n = value.try_cast("bigint")
        return F.when(F.trim(value).rlike("^[+-]?[0-9]+$") & n.between(low, high), n.cast("string"))
    if kind == "bit":
        out = F.lit(None).cast("string")
        for word, bit in BITS.items():
            out = F.when(F.lower(F.trim(value)) == word, bit).otherwise(out)
        return out
    if kind == "datetime":
        return F.when(~value.rlike("\\.\\d"), F.date_format(parsed_time(value), "yyyy-MM-dd HH:mm:ss"))
    units = F.octet_length(F.encode(value, "UTF-16BE")) / 2
    ok = F.lit(True) if size is None else units <= size
    return F.when(ok & (F.lit(kind == "nvarchar") | ~value.rlike("[^\\x00-\\x7F]")), value)


def safe_name(name: Column) -> Column:
    """A file name of letters, digits, dots, dashes and underscores; what had to change gets a hash, so that no two names meet."""
    plain = F.substring(F.regexp_replace(name, "[^A-Za-z0-9._-]", "_"), 1, 80)
    same = (plain == name) & ~name.rlike("^\\.|~")
    return F.when(same, plain).otherwise(F.concat(plain, F.lit("~"), F.substring(F.sha2(name, 256), 1, 8)))


def effective(own: Column, instance: Column, cpus: Column) -> Column:
    """A degree of parallelism: the database's own value, else the instance's, else all processors (0 is none); never more than these."""
    return F.least(F.coalesce(F.nullif(own, F.lit(0)), F.nullif(instance, F.lit(0)), cpus), cpus)


def plan_format(text: Column) -> Column:
    """What kind of plan a text holds by its beginning, or why it is none."""
    bare = F.ltrim(F.regexp_replace(text, "^\ufeff", ""))
    return (
        F.when(F.coalesce(bare, F.lit("")) == "", "error: empty")
        .when(bare.rlike("^<") & bare.contains("<ShowPlanXML"), "showplan xml")
        .when(bare.startswith("<"), "error: xml without a plan")
        .when(bare.rlike("^\\[\\s*\\{\\s*\"Plan\""), "explain json array")
        .when(bare.rlike("^\\{\\s*\"Plan\""), "explain json object")
        .when(bare.rlike("^[\\[{]"), "tool json")
        .when(bare.rlike("\\(cost=[0-9.]+\\.\\.[0-9.]+ rows=[0-9]+"), "explain text")
        .otherwise("error: unknown")
    )


def resolution(object_id: Column, is_system: Column) -> Column:
    """What an outer join found of an object: nothing, one of the system's, one of the users'."""
    return F.when(object_id.isNull(), "unresolved").when(is_system, "system").otherwise("user")
