"""Log digest: classify entries by rules, roll repeats up by signature, count, advise, redact."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.functions.scalar import signature


@dataclass(frozen=True)
class Rule:
    """``kind`` is severity (the pattern's first group is a number), signal or noise."""

    category: str
    kind: str
    pattern: str


def load_rules(lines: Iterable[str], name: str = "rules") -> list[Rule]:
    """Rules of tab-separated lines (category, kind, pattern); blank lines and # comments are skipped."""
    out = []
    for n, line in enumerate(lines, 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        parts = line.rstrip("\n").split("\t")
        if len(parts) != 3 or parts[1] not in ("severity", "signal", "noise"):
            raise ValueError(f"{name}:{n}: not a rule")
        try:
            re.compile(parts[2])
        except re.error as e:
            raise ValueError(f"{name}:{n}: {e}") from e
        out.append(Rule(*parts))
    return out


def _java(pattern: str) -> str:
    return pattern.replace("(?i)", "(?iu)")


def verdict(text: Column, rules: list[Rule], least_severity: int = 16) -> Column:
    """Null to keep an entry, else the category of the first noise rule that drops it.

    Severity at or above the threshold keeps, then any signal rule, then noise drops; what no rule knows is kept.
    """
    out = F.lit(None).cast("string")
    for r in reversed([r for r in rules if r.kind == "noise"]):
        out = F.when(text.rlike(_java(r.pattern)), r.category).otherwise(out)
    keep = F.lit(False)
    for r in rules:
        if r.kind == "signal":
            keep = keep | text.rlike(_java(r.pattern))
        elif r.kind == "severity":
            level = F.regexp_extract(text, _java(r.pattern), 1)
            keep = keep | F.when(level.rlike("^[0-9]{1,9}$"), level.try_cast("int") >= least_severity).otherwise(False)
    return F.when(keep, F.lit(None).cast("string")).otherwise(out)


def in_window(time: Column, start: str | None, end: str | None) -> Column:
    """Both ends inclusive and open when None; entries without a time always pass."""
    ok = F.lit(True)
    if start is not None:
        ok = ok & (time >= F.lit(start).cast("timestamp"))
    if end is not None:
        ok = ok & (time <= F.lit(end).cast("timestamp"))
    return time.isNull() | ok


def roll_up(entries: DataFrame, text: str = "text", time: str = "time", source: str = "source", seq: str | tuple[str, ...] = "seq") -> DataFrame:
    """One row for each signature, in order of first occurrence: n, first and last time, and the first text.

    Of texts that occur once all lines are kept, of others the first line. ``seq`` as in ``redact``.
    """
    at = F.col(seq) if isinstance(seq, str) else F.struct(*seq)
    kind = F.regexp_replace(F.coalesce(F.col(source), F.lit("")), "[0-9]", "")
    keyed = entries.withColumn("sig", F.concat_ws("|", kind, signature(F.col(text))))
    out = keyed.groupBy("sig").agg(
        F.count("*").alias("n"), F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.min_by(F.col(text), at).alias("text"), F.min(at).alias("first_seq")
    )
    return out.withColumn("text", F.when(F.col("n") > 1, F.substring_index("text", "\n", 1)).otherwise(F.col("text")))


def counters(entries: DataFrame, dropped: str = "dropped", inside: Column | None = None) -> DataFrame:
    """total, kept and dropped entries: one row, for an empty table too.

    ``inside`` tells which entries are in the time window; those outside it count as dropped, in no category.
    """
    keep = F.col(dropped).isNull() & (F.lit(True) if inside is None else inside)
    return entries.agg(F.count("*").alias("total"), F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped"))


def unaggregated(entries: DataFrame, text: str = "text", time: str = "time", seq: str = "seq") -> DataFrame:
    """Each entry as an event of its own, with the columns of ``roll_up``."""
    return entries.select(F.lit(1).cast("long").alias("n"), F.col(time).alias("first_time"), F.col(time).alias("last_time"), text, F.col(seq).alias("first_seq"))


#: Lines of a log's beginning that facts about the start are looked for in.
BOOT_LINES = 400


def boot_text(lines: DataFrame, file: str = "file", seq: str = "seq", text: str = "text", most: int = BOOT_LINES) -> DataFrame:
    """Per file its first ``most`` lines as one text (file, boot); Spark prunes each task's lines before it shuffles."""
    first = lines.withColumn("nth", F.row_number().over(Window.partitionBy(file).orderBy(seq))).where(F.col("nth") <= most)
    return first.groupBy(file).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.col(text).alias("t")))), lambda x: x["t"]), "\n").alias("boot"))


def facts(boots: DataFrame, patterns: dict[str, str], several: dict[str, str]) -> DataFrame:
    """Per file the first match of each of ``patterns`` (null without one), and the distinct matches of ``several`` in order."""
    one = [F.nullif(F.trim(F.regexp_extract("boot", p, 1)), F.lit("")).alias(n) for n, p in patterns.items()]
    all_ = [F.filter(F.array_distinct(F.transform(F.regexp_extract_all("boot", F.lit(p), F.lit(1)), lambda x: F.trim(x))), lambda x: x != "").alias(n) for n, p in several.items()]
    return boots.select(*[c for c in boots.columns if c != "boot"], *one, *all_)


def checks(boots: DataFrame, rules: list[tuple[str, str]], file: str = "file") -> DataFrame:
    """(file, message) of the rules (pattern, message) whose pattern the boot text has, in the rules' order."""
    hits = F.array(*[F.when(F.col("boot").rlike(p), F.lit(m)) for p, m in rules])
    return boots.select(file, F.posexplode(hits).alias("nth", "message")).where("message is not null")


# What is redacted of a server's messages, in this order within a text.
ENTITIES = (
    ("DB", "(?i)(?:Database|base de donn\u00e9es)[\\s\u00a0]+'([^']+)'"),
    ("DB", "(?i)(?:Database|base de donn\u00e9es)[\\s\u00a0]*:[\\s\u00a0]*([A-Za-z0-9_]+)"),
    ("LOGIN", "(?i)(?:user|utilisateur|login)[\\s\u00a0]+'([^']+)'"),
    ("IP", "\\b([0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3})\\b"),
)


def advisories(dropped_by_category: DataFrame, advice: DataFrame) -> DataFrame:
    """Messages of the categories that occur often enough; ``{n}`` in a template is their number.

    ``advice`` has (category, min_count, template), a row for each piece of advice.
    """
    hit = dropped_by_category.join(advice, "category").where(F.col("n") >= F.col("min_count"))
    return hit.select("category", F.replace("template", F.lit("{n}"), F.col("n").cast("string")).alias("message"))


def redact(entries: DataFrame, patterns: dict[str, str] | tuple[tuple[str, str], ...] = ENTITIES, text: str = "text", seq: str | tuple[str, ...] = "seq") -> DataFrame:
    """``entries`` with the values of each pattern's first group replaced by ``<TYPE_n>``, numbered by first occurrence.

    The values of a text are replaced longest first, each in one pass, where no word character adjoins them; of two
    equal values with a single character between them, that pass takes the first. What is joined back by text
    row is that row's own values only; the numbering is one window over the distinct values of a type. ``seq`` names
    what orders and tells apart the entries: of several files both the file and the number in it.
    """
    by = [seq] if isinstance(seq, str) else list(seq)
    found = None
    for nth, (kind, pattern) in enumerate(patterns.items() if isinstance(patterns, dict) else patterns):
        part = entries.select(*by, F.lit(nth).alias("rule"), F.lit(kind).alias("kind"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))).alias("pos", "value"))
        found = part if found is None else found.union(part)
    found = found.where("value <> ''")
    first = found.groupBy("kind", "value").agg(F.min(F.struct(*by, "rule", "pos")).alias("at"))
    named = first.withColumn("token", F.concat(F.lit("<"), F.col("kind"), F.lit("_"), F.row_number().over(Window.partitionBy("kind").orderBy("at", "value")), F.lit(">")))
    per_row = found.select(*by, "kind", "value").distinct().join(named.select("kind", "value", "token"), ["kind", "value"])
    lists = per_row.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.length("value").alias("size"), "value", "token")), asc=False).alias("__values"))
    edge = "(^|[^A-Za-z0-9_])"
    replaced = F.aggregate(
        F.coalesce("__values", F.array().cast("array<struct<size:int,value:string,token:string>>")),
        F.col(text),
        lambda t, v: F.regexp_replace(t, F.concat(F.lit(edge + "\\Q"), F.replace(v["value"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E($|[^A-Za-z0-9_])")), F.concat(F.lit("$1"), v["token"], F.lit("$2"))),
    )
    return entries.join(lists, by, "left").withColumn(text, replaced).drop("__values")
