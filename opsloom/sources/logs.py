"""Server logs: plain, gzip or zip files in any of the usual encodings, to lines and to entries."""

from __future__ import annotations

import gzip
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A line that opens an entry: time stamp, source, message.
ENTRY = "^(\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2}\\.\\d{2})\\s+(\\S+)\\s+(.*)$"
STAMP = "yyyy-MM-dd HH:mm:ss.SS"


def decode(data: bytes) -> str:
    """Text of a log file by its byte order mark, UTF-8 without one; line ends become ``\\n``."""
    for mark, encoding in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\xef\xbb\xbf", "utf-8")):
        if data.startswith(mark):
            data = data[len(mark) :]
            text = (data[: len(data) // 2 * 2] if "16" in encoding else data).decode(encoding, "replace")
            break
    else:
        text = data.decode("utf-8", "replace")
    return text.replace("\r\n", "\n").replace("\r", "\n")


def members(path: str, data: bytes, wanted: str = "ERRORLOG") -> list[tuple[str, bytes]]:
    """The logs in a file: the named ones of a zip (all if none is), a gzip's content, or the file itself."""
    if data.startswith(b"PK\x03\x04"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = sorted(n for n in z.namelist() if not n.endswith("/"))
            named = [n for n in names if wanted.lower() in n.rsplit("/", 1)[-1].lower()]
            return [(f"{path}!{n}", z.read(n)) for n in named or names]
    if data.startswith(b"\x1f\x8b"):
        return [(path, gzip.decompress(data))]
    return [(path, data)]


def read_lines(spark: SparkSession, path: str, glob: str = "ERRORLOG*") -> DataFrame:
    """Lines of all logs under ``path``: (file, line_no from 1, line). A file is decoded as a whole, by one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                for member, data in members(name, bytes(content)):
                    lines = decode(data).split("\n")
                    lines = lines[:-1] if lines[-1] == "" else lines
                    for at in range(0, len(lines), 10_000):
                        part = lines[at : at + 10_000]
                        yield pd.DataFrame({"file": member, "line_no": range(at + 1, at + 1 + len(part)), "line": part})

    return files.mapInPandas(unpack, "file string, line_no long, line string")


def assemble(lines: DataFrame) -> DataFrame:
    """Entries of lines: (file, seq, time, raw_time, source, text, n_lines); lines before the first stamp are one entry.

    Stamps that are no time are kept in ``raw_time`` with a null ``time``.
    """
    opens = F.col("line").rlike(ENTRY).cast("int")
    by_file = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    parts = lines.withColumn("seq", F.sum(opens).over(by_file))
    parts = parts.withColumn("text", F.when(opens == 1, F.regexp_extract("line", ENTRY, 3)).otherwise(F.col("line")))
    out = parts.groupBy("file", "seq").agg(
        F.min_by("line", "line_no").alias("head"),
        F.count("*").alias("n_lines"),
        F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("parts"),
    )
    stamp = F.nullif(F.regexp_extract("head", ENTRY, 1), F.lit(""))
    return out.select(
        "file", "seq", F.try_to_timestamp(stamp, F.lit(STAMP)).alias("time"), stamp.alias("raw_time"),
        F.nullif(F.regexp_extract("head", ENTRY, 2), F.lit("")).alias("source"),
        F.array_join("parts.text", "\n").alias("text"), "n_lines",
    )
