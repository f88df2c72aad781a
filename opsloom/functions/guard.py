"""Read-only guard for query text: Spark's own parser tells what a statement is."""

from __future__ import annotations

import re

from py4j.protocol import Py4JError
from pyspark.errors import ParseException
from pyspark.sql import SparkSession

#: Roots of plans that only read.
_WRITES = re.compile(r"Command|Insert|Create|Drop|Alter|Replace|Delete|Update|Merge|Truncate|Set|Use|Load|Refresh|Cache|Analyze|Add|Grant")

#: Functions that call into the machine: a query that names one does not only read.
_CALLS = {"reflect", "java_method", "try_reflect"}


class Refused(ValueError):
    """The text is not one read-only statement."""


def check_read_only(spark: SparkSession, text: str) -> None:
    """Raise ``Refused`` unless ``text`` is one statement that only reads."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except ParseException as e:
        raise Refused(f"not a statement: {e.getCondition()}") from e
    kinds, todo = [], [plan]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedFunction" and (name := node.nameParts().last().lower()) in _CALLS:
            raise Refused(f"calls {name}")
        for part in ("children", "expressions", "innerChildren", "plan"):  # sub-queries and named queries too
            try:
                found = getattr(node, part)()
            except Py4JError:  # plans have expressions, expressions may have a plan
                continue
            if part == "expressions":
                kinds.append(kind)
            todo += [found] if part == "plan" else [found.apply(i) for i in range(found.size())]
    bad = [k for k in kinds if _WRITES.match(k) or k.endswith("Command")]
    if bad:
        raise Refused(f"writes or changes the session: {bad[0]}")


def run_guarded(spark: SparkSession, text: str, **parameters: object):
    """The DataFrame of a read-only statement with named parameters (``:name``)."""
    check_read_only(spark, text)
    return spark.sql(text, args=parameters or None)


def parameters_of(text: str) -> list[str]:
    """Named parameters of a text in order of first use, folded to lower case; literals and comments do not count."""
    bare = re.sub(r"'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/", " ", text, flags=re.S)
    return list(dict.fromkeys(m.lower() for m in re.findall(r"(?<![:\w]):([A-Za-z_]\w*)", bare)))
