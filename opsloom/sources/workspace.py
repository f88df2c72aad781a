"""JSON workspaces and journals, and the envelopes in which results go out."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

JOURNAL = "seq long, time string, run_id string, server string, database string, kind string, name string, state string"
CORRUPT = "_corrupt"


def read_workspace(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON documents under ``path``/server=.../database=..., one a file; what does not fit the schema raises."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_journal(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A journal's entries, and the lines that are no entry (a last line cut short, say)."""
    schema = StructType.fromDDL(f"{JOURNAL}, {CORRUPT} string")
    lines = spark.read.text(path).where("trim(value) <> ''")
    rows = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("row")).select("row.*")
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT), rows.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def append_journal(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def strict_rows(text: str, required: Iterable[str], optional: Iterable[str] = ()) -> tuple[list[dict], list[tuple[dict, str]]]:
    """Rows of a suggestions file {"rows": [...]}: accepted ones and rejected ones with reasons; unknown fields or trailing data raise."""
    data = json.loads(text)
    if not isinstance(data, dict) or set(data) != {"rows"} or not isinstance(data["rows"], list):
        raise ValueError("a suggestions file has the one field rows")
    required, known = set(required), {*required, *optional}
    good, bad = [], []
    for row in data["rows"]:
        if extra := set(row) - known:
            raise ValueError(f"unknown field {sorted(extra)[0]}")
        lacks = sorted(f for f in required if row.get(f) in (None, "", []))
        if lacks:
            bad.append((row, f"{lacks[0]} is missing"))
        else:
            good.append(row)
    return good, bad


def envelope(df: DataFrame, max_rows: int = 50) -> str:
    """One JSON document of a result: columns, ``max_rows`` rows at most, the count of all, and whether some are missing."""
    n = df.count()
    rows = [json.loads(r) for r in df.limit(max_rows).toJSON().collect()] if max_rows > 0 else [json.loads(r) for r in df.toJSON().toLocalIterator()]
    return json.dumps({"ok": True, "columns": [{"name": c, "type": t} for c, t in df.dtypes], "rows": rows, "rowcount": n, "truncated": 0 < max_rows < n})


def error_envelope(error: Exception) -> str:
    """The same shape for a failure, with its category."""
    condition = getattr(error, "getCondition", lambda: None)()
    return json.dumps({"ok": False, "columns": [], "rows": [], "rowcount": 0, "truncated": False, "error": {"category": condition or type(error).__name__, "message": str(error).split("\n")[0]}})


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated text: ``\\N`` for null; tab, line feed, carriage return and backslash escaped."""
    def escaped(c: str):
        out = F.col(f"`{c}`").cast("string")
        for plain, to in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
            out = F.replace(out, F.lit(plain), F.lit(to))
        return F.coalesce(out, F.lit("\\N"))

    df.select(F.concat_ws("\t", *[escaped(c) for c in df.columns]).alias("value")).write.text(path)


def text_digest(rolled: DataFrame, counted: dict[str, int]) -> str:
    """A report of rolled-up events, in order of first occurrence; its size follows the number of signatures."""
    out = [f"entries {counted['total']}, kept {counted['kept']}, dropped {counted['dropped']}", ""]
    for r in rolled.orderBy("first_seq").toLocalIterator():
        head = f"[x{r['n']}] {r['first_time']} - {r['last_time']}  " if r["n"] > 1 else ""
        out.append(head + str(r["text"]).replace("\n", "\n  "))
    return "\n".join(out) + "\n"
