"""Execution plans as XML: operators, accesses and missing-index groups as rows.

A plan is small and recursive, which no schema of Spark's XML reader can express; each document is walked by itself, in
batches, where it lies. What is asked of the rows afterwards is DataFrame work.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NODES = "plan_id long, statement int, node int, parent int, depth int, op string, table_name string, index_name string, cost double, est_rows double, columns array<string>"


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _own(element: ET.Element, wanted: str) -> list[ET.Element]:
    """Descendants of a name that lie in this operator, not in one below it."""
    out, todo = [], list(element)
    while todo:
        e = todo.pop(0)
        if _name(e.tag) == wanted:
            out.append(e)
        if _name(e.tag) != "RelOp":
            todo = list(e) + todo
    return out


def _walk(plan_id: int, xml: str) -> Iterator[tuple]:
    for s, statement in enumerate(e for e in ET.fromstring(xml).iter() if _name(e.tag).startswith("Stmt")):
        nodes, todo = 0, [(e, -1, 0) for e in statement.iter() if _name(e.tag) == "RelOp"][:1]
        while todo:
            op, parent, depth = todo.pop(0)
            me, nodes = nodes, nodes + 1
            below = _own(op, "RelOp")
            objects = _own(op, "Object")
            first = objects[0].attrib if objects else {}
            columns = [c.attrib.get("Column", "") for o in _own(op, "OutputList") for c in o]
            cost = float(op.attrib.get("EstimatedTotalSubtreeCost", 0)) - sum(float(b.attrib.get("EstimatedTotalSubtreeCost", 0)) for b in below)
            yield plan_id, s, me, parent, depth, op.attrib.get("PhysicalOp"), first.get("Table", "").strip("[]") or None, first.get("Index", "").strip("[]") or None, cost, float(op.attrib.get("EstimateRows", 0)), columns
            todo = [(b, me, depth + 1) for b in below] + todo


def read_plans(plans: DataFrame, key: str = "plan_id", xml: str = "xml") -> DataFrame:
    """Operators of plans in pre-order, see NODES; ``cost`` is the operator's own. Texts that are no XML give no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, x in zip(batch["k"], batch["x"]):
                try:
                    rows += _walk(k, x) if x else []
                except ET.ParseError:
                    continue
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in NODES.split(", ")])

    return plans.select(F.col(key).cast("long").alias("k"), F.col(xml).alias("x")).mapInPandas(run, NODES)


def shapes(nodes: DataFrame) -> DataFrame:
    """A text for each statement's shape: operators in pre-order with table and index."""
    at = F.concat_ws(".", "table_name", "index_name")
    one = F.concat("op", F.when(at != "", F.concat(F.lit("("), at, F.lit(")"))).otherwise(""))
    return nodes.groupBy("plan_id", "statement").agg(F.array_join(F.sort_array(F.collect_list(F.struct("node", one.alias("t"))))["t"], "|").alias("shape"))


def lookups(nodes: DataFrame) -> DataFrame:
    """Key lookups with the read beside them: the other child of their parent."""
    a, b = nodes.alias("a"), nodes.alias("b")
    same = (F.col("a.plan_id") == F.col("b.plan_id")) & (F.col("a.statement") == F.col("b.statement")) & (F.col("a.parent") == F.col("b.parent")) & (F.col("a.node") != F.col("b.node"))
    return a.where(F.col("a.op").contains("Lookup")).join(b, same).select("a.plan_id", "a.statement", F.col("a.node").alias("lookup"), F.col("b.node").alias("read"), F.col("b.index_name").alias("index_name"))


def first_plans(index: DataFrame) -> DataFrame:
    """Of plans listed by several runs (run, pos, plan_hash, ...), the first listing of each."""
    return index.withColumn("nth", F.row_number().over(Window.partitionBy("plan_hash").orderBy("run", "pos"))).where("nth = 1").drop("nth")
