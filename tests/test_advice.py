"""The advisor's decisions, guard, redaction and values on small authored cases."""

import pytest

from opsloom.functions import guard
from opsloom.functions import scalar as S
from opsloom.operators import advisor, digest
from pyspark.sql import functions as F


def _decide(spark, keys, eq, ikeys, iincludes=(), includes=(), constraint=False, replaceable=True):
    cands = spark.createDataFrame([("c", 1, list(keys), list(includes), eq)], "candidate_id string, table_id int, keys array<string>, includes array<string>, eq_count int")
    indexes = spark.createDataFrame([(1, 5, constraint, replaceable, list(ikeys), list(iincludes))], "table_id int, index_id int, is_constraint boolean, replaceable boolean, keys array<string>, includes array<string>")
    return advisor.confront(cands, indexes).collect()[0]["decision"]


@pytest.mark.parametrize(
    "keys, eq, ikeys, more, decision",
    [
        (["a", "b"], 2, ["b", "a"], {}, "covered"), (["a", "b"], 0, ["b", "a"], {}, "new"), (["a", "b"], 1, ["a", "b desc"], {}, "covered"),
        (["a", "b", "c"], 1, ["a", "b desc", "c"], {}, "new"), (["a", "b", "c"], 1, ["a", "b desc", "c desc"], {}, "covered"), (["a", "b", "c desc"], 1, ["a", "b desc", "c"], {}, "covered"),
        (["a"], 1, ["a", "z"], {"includes": ["q"]}, "widen"), (["a"], 1, ["a"], {"includes": ["q"], "constraint": True}, "discuss"), (["a"], 1, ["a"], {"includes": ["q"], "iincludes": ["q"]}, "covered"),
        (["a", "b"], 2, ["b"], {}, "new"), (["a", "b"], 1, ["a"], {}, "replace"), (["a", "b"], 1, ["a"], {"constraint": True}, "new"), (["a", "b"], 1, ["a"], {"replaceable": False}, "new"),
    ],
)
def test_confront(spark, keys, eq, ikeys, more, decision):
    assert _decide(spark, keys, eq, ikeys, **more) == decision


def test_guard_refuses_calls_into_the_machine(spark):
    for text in ("select reflect('java.lang.System', 'getProperty', 'x')", "select * from (select java_method('a', 'b') x) t", "with q as (select try_reflect('a', 'b') x) select * from q", "select 1 where exists (select reflect('a', 'b'))"):
        with pytest.raises(guard.Refused):
            guard.check_read_only(spark, text)
    guard.check_read_only(spark, "select 'reflect(1)' as x, count(*) from range(3) where id in (select 1)")


def test_redaction_over_several_files_and_names_with_e(spark):
    rows = [("f1", 1, "Login failed for user 'DOM\\Eric'."), ("f2", 1, "bob and Database 'bob' here"), ("f2", 2, "user 'DOM\\Eric' at 10.0.0.1, not 1234.10.0.0.1x")]
    out = {(r["file"], r["seq"]): r["text"] for r in digest.redact(spark.createDataFrame(rows, "file string, seq int, text string"), seq=("file", "seq")).collect()}
    assert out == {("f1", 1): "Login failed for user '<LOGIN_1>'.", ("f2", 1): "<DB_1> and Database '<DB_1>' here", ("f2", 2): "user '<LOGIN_1>' at <IP_1>, not 1234.<IP_1>x".replace("<IP_1>x", "10.0.0.1x")}


def test_values(spark):
    rows = spark.createDataFrame([("2024-01-02T03:04:05.7",), ("2024-13-01",), ("",), (None,)], "t string")
    got = [r[0] for r in rows.select(F.date_format(S.parsed_time(F.col("t")), "yyyy-MM-dd HH:mm:ss")).collect()]
    assert got == ["2024-01-02 03:04:05", None, None, None]
    plans = ["<ShowPlanXML x>", "<a/>", '[{"Plan": 1}]', '{"Plan": 1}', '{"x": 1}', "Seq Scan  (cost=0.00..1.10 rows=10 width=4)", "  ", "select"]
    kinds = [r[0] for r in spark.createDataFrame([(p,) for p in plans], "t string").select(S.plan_format(F.col("t"))).collect()]
    assert kinds == ["showplan xml", "error: xml without a plan", "explain json array", "explain json object", "tool json", "explain text", "error: empty", "error: unknown"]
    typed = spark.createDataFrame([("256", "é"), ("-5", "ab"), ("7 ", None)], "n string, s string").select(S.typed_text(F.col("n"), "tinyint"), S.typed_text(F.col("s"), "varchar"), S.typed_text(F.col("s"), "nvarchar", 1)).collect()
    assert [tuple(r) for r in typed] == [(None, None, "é"), (None, "ab", None), ("7", None, None)]


def test_stale_runs_and_boot_lines(spark):
    rows = spark.createDataFrame([("a", "r1", 1)], "collect_id string, run_id string, x int")
    assert advisor.require_run(rows, "a", "r1") is rows
    with pytest.raises(advisor.Stale):
        advisor.require_run(rows, "a", "r2")
    lines = spark.createDataFrame([("f", i, f"port {i % 3} up") for i in range(500)] + [("f", 500, "port 9 up")], "file string, seq int, text string")
    boots = digest.boot_text(lines)
    got = digest.facts(boots, {"first": "port ([0-9])", "none": "x(y)"}, {"ports": "port ([0-9])"}).collect()[0]
    assert (got["first"], got["none"], got["ports"]) == ("0", None, ["0", "1", "2"])
    assert [r["message"] for r in digest.checks(boots, [("port 9", "late"), ("port 2", "early")]).collect()] == ["early"]
