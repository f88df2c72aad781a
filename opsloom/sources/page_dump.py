"""Text dumps of data pages: lines to records to typed values, with a status for each record.

Lines are classified by patterns; window functions over a file's lines carry the state (record, column, dump) that each
line belongs to. Only the bytes of single values are decoded in Python, by batches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The forms of the lines of a dump.
SLOT = "^Slot (\\d+) Offset 0x([0-9a-fA-F]+) Length (\\d+)\\s*$"
RECORD_TYPE = "^Record Type = (\\S+)"
DUMP_HEAD = "^Memory Dump @"
DUMP = "^[0-9A-Fa-f]{8,16}:\\s+((?:[0-9A-Fa-f]{2,8} ?)+)"
COLUMN = "^(?:(.*) = \\[BLOB Inline Data\\] )?Slot (\\d+) Column (\\d+) Offset 0x([0-9a-fA-F]+) Length (\\d+)"
VALUE = "^(\\S.*?) = (.*)$"
TEXTS = {"varchar": "code page", "char": "code page", "nvarchar": "utf-16-le", "nchar": "utf-16-le"}


def _part(line: str, pattern: str, group: int):
    return F.when(F.col(line).rlike(pattern), F.regexp_extract(line, pattern, group))


def records(lines: DataFrame) -> DataFrame:
    """Records of dumps (file, line_no, line): (file, rec, slot, length, record_type, hex, columns).

    ``columns`` is an array of (column_no, name, offset, length, display, blob). A slot header that repeats the open
    record's slot belongs to that record. Lines before the first header belong to none.
    """
    by_file = Window.partitionBy("file").orderBy("line_no")
    so_far = by_file.rowsBetween(Window.unboundedPreceding, 0)
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    x = lines.withColumn("slot", _part("line", SLOT, 1).cast("int"))
    x = x.withColumn("opens", F.col("slot").isNotNull() & ~F.col("slot").eqNullSafe(F.last("slot", True).over(before)))
    x = x.withColumn("rec", F.sum(F.col("opens").cast("int")).over(so_far)).where("rec > 0")
    x = x.withColumn("column_no", _part("line", COLUMN, 3).cast("int"))
    x = x.withColumn("dump", F.when(F.col("line").rlike(DUMP_HEAD), True).when(F.col("slot").isNotNull() | F.col("column_no").isNotNull(), False))
    in_record = Window.partitionBy("file", "rec").orderBy("line_no")
    open_ = in_record.rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({"dumping": F.last("dump", True).over(open_), "of_column": F.last("column_no", True).over(open_)})
    is_value = F.col("line").rlike(VALUE) & F.col("column_no").isNull() & ~F.col("line").rlike("^Record ") & F.col("of_column").isNotNull()
    x = x.withColumn("value_at", F.when(is_value, F.col("line_no")))
    blob = _part("line", COLUMN, 1)
    bytes_ = F.when(F.col("dumping") & F.col("line").rlike(DUMP), F.replace(F.regexp_extract("line", DUMP, 1), F.lit(" "), F.lit("")))
    rec = x.groupBy("file", "rec").agg(
        F.max(F.when(F.col("opens"), F.col("slot"))).alias("slot"),
        F.max(F.when(F.col("opens"), _part("line", SLOT, 3).cast("int"))).alias("length"),
        F.min_by(_part("line", RECORD_TYPE, 1), F.when(F.col("line").rlike(RECORD_TYPE), F.col("line_no"))).alias("record_type"),
        F.array_join(F.sort_array(F.collect_list(F.when(bytes_.isNotNull(), F.struct("line_no", bytes_.alias("b")))))["b"], "").alias("hex"),
    )
    col = x.where("of_column is not null").groupBy("file", "rec", F.col("of_column").alias("column_no")).agg(
        F.max(F.when(blob != "", blob)).alias("blob_name"),
        F.max(_part("line", COLUMN, 4)).alias("offset"),
        F.max(_part("line", COLUMN, 5).cast("int")).alias("size"),
        F.min_by(F.struct(F.regexp_extract("line", VALUE, 1).alias("name"), F.rtrim(F.regexp_extract("line", VALUE, 2)).alias("display")), "value_at").alias("v"),
    )
    is_blob = F.col("blob_name").isNotNull()
    one = F.struct(
        "column_no", F.when(is_blob, F.col("blob_name")).otherwise(F.col("v.name")).alias("name"), F.conv("offset", 16, 10).cast("int").alias("offset"), F.col("size").alias("length"),
        F.when(~is_blob, F.col("v.display")).alias("display"), is_blob.alias("blob"),
    )
    cols = col.where(is_blob | F.col("v").isNotNull()).groupBy("file", "rec").agg(F.sort_array(F.collect_list(one)).alias("columns"))
    return rec.join(cols, ["file", "rec"], "left")


def values(recs: DataFrame, types: dict[str, str], code_page: str = "cp1252") -> DataFrame:
    """Values of records: (file, rec, column_no, name, value, problem); ``types`` gives the declared types by name.

    Texts are decoded from the record's bytes by their type, binaries told as ``0x`` hex, others as displayed. A value
    that is off the row, invalid, cut short, assumed to be varchar or not decodable has its problem's name.
    """
    each = recs.select("file", "rec", "hex", F.explode("columns").alias("c")).select("file", "rec", "hex", "c.*")
    each = each.withColumn("type", F.element_at(F.create_map(*[F.lit(x) for p in [*types.items(), ("", "")] for x in p]), F.col("name")))
    off_row = F.col("display").startswith("[") & ~F.col("blob")
    fate = (
        F.when(F.col("display") == "[NULL]", "null").when(off_row, "offrow").when(F.col("display") == "INVALID COLUMN VALUE", "invalid")
        .when(F.col("type").isin("binary", "varbinary"), "binary").when(F.col("type").isin(*TEXTS), "text").when(F.col("blob"), "assumed-varchar").otherwise("shown")
    )
    raw = F.substring("hex", F.col("offset") * 2 + 1, F.col("length") * 2)
    each = each.withColumns({"fate": fate, "raw": raw})

    @F.pandas_udf("value string, bad boolean")
    def decode(raw: pd.Series, kind: pd.Series) -> pd.DataFrame:
        out = []
        for h, k in zip(raw, kind):
            data = bytes.fromhex(h[: len(h) // 2 * 2])
            encoding = code_page if TEXTS.get(k, "code page") == "code page" else "utf-16-le"
            try:
                out.append((data.decode(encoding), False))
            except UnicodeDecodeError:
                out.append((data.decode(encoding, "replace"), True))
        return pd.DataFrame(out, columns=["value", "bad"])

    each = each.withColumn("d", F.when(F.col("fate").isin("text", "assumed-varchar"), decode(F.coalesce("raw", F.lit("")), F.coalesce("type", F.lit("")))))
    value = F.when(F.col("fate") == "binary", F.concat(F.lit("0x"), F.upper("raw"))).when(F.col("d").isNotNull(), F.col("d.value")).when(F.col("fate") == "shown", F.col("display"))
    short = F.col("fate").isin("binary", "text", "assumed-varchar") & (F.length("raw") < F.col("length") * 2)
    problem = F.when(F.col("fate").isin("offrow", "invalid"), F.col("fate")).when(F.col("d.bad"), "undecodable").when(short, "short").when(F.col("fate") == "assumed-varchar", F.col("fate"))
    return each.select("file", "rec", "column_no", "name", value.alias("value"), problem.alias("problem"))


def statuses(recs: DataFrame, vals: DataFrame) -> DataFrame:
    """Per record (file, rec, slot, status): ``ok``, or its problems in column order; other record types are one too."""
    told = vals.where("problem is not null").groupBy("file", "rec").agg(F.array_join(F.sort_array(F.collect_list(F.struct("column_no", F.concat_ws(":", "problem", "name").alias("t"))))["t"], ",").alias("p"))
    kind = F.when(~F.col("record_type").eqNullSafe("PRIMARY_RECORD"), "record-type")
    status = F.coalesce(F.nullif(F.concat_ws(",", kind, "p"), F.lit("")), F.lit("ok"))
    return recs.join(told, ["file", "rec"], "left").select("file", "rec", "slot", status.alias("status"))
