import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from opsloom.functions import guard
from opsloom.functions import scalar as S
from opsloom.operators import advisor, bounded, digest, matching, union
from opsloom.sources import logs

LOG = "noise before\r\n2024-01-02 03:04:05.06 spid7      Error: 823, Severity: 24\r\n  second line\r\n2024-01-02 03:04:06.00 Logon      Login failed for user 'sa'. 10.0.0.1\r\n"


@pytest.mark.parametrize("encoding,mark", [("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff"), ("utf-8", b"\xef\xbb\xbf"), ("utf-8", b"")])
def test_decode(encoding, mark):
    assert logs.decode(mark + LOG.encode(encoding)) == LOG.replace("\r\n", "\n")


def test_decode_odd_byte_and_bad_bytes():
    assert logs.decode(b"\xff\xfea\x00b") == "a"
    assert logs.decode(b"a\xffb\rc") == "a�b\nc"


def test_logs_from_plain_gzip_and_zip(spark, tmp_path):
    (tmp_path / "ERRORLOG").write_bytes(b"\xff\xfe" + LOG.encode("utf-16-le"))
    (tmp_path / "ERRORLOG.1.gz").write_bytes(gzip.compress(LOG.encode()))
    with zipfile.ZipFile(tmp_path / "ERRORLOG.zip", "w") as z:
        z.writestr("a/errorlog.2", LOG)
        z.writestr("readme.txt", "no log")
    (tmp_path / "other.txt").write_text("not read")
    entries = logs.assemble(logs.read_lines(spark, str(tmp_path))).orderBy("file", "seq").collect()
    assert len(entries) == 9
    for at in (0, 3, 6):
        head, error, login = entries[at : at + 3]
        assert (head["text"], head["time"], head["source"]) == ("noise before", None, None)
        assert (error["source"], error["n_lines"], error["text"]) == ("spid7", 2, "Error: 823, Severity: 24\n  second line")
        assert error["time"].microsecond == 60000
        assert login["raw_time"] == "2024-01-02 03:04:06.00"


def test_rules_and_roll_up(spark):
    rules = digest.load_rules(["# comment", "", "sev\tseverity\tSeverity: ([0-9]+)", "login\tsignal\t(?i)login failed", "backup\tnoise\t^Backup", "other\tnoise\tBackup"])
    rows = [(1, "Backup of 10 pages", "spid1"), (2, "Backup of 22 pages", "spid2"), (3, "Severity: 24 in Backup", "spid3"), (4, "LOGIN FAILED", "x"), (5, "unknown", "x"), (6, "a Backup", "x"), (7, "Severity: 3", "x")]
    df = spark.createDataFrame(rows, "seq long, text string, source string").withColumn("time", F.lit(None).cast("timestamp"))
    out = df.withColumn("dropped", digest.verdict(F.col("text"), rules))
    assert [r["dropped"] for r in out.orderBy("seq").collect()] == ["backup", "backup", None, None, None, "other", None]
    assert digest.counters(out).first().asDict() == {"total": 7, "kept": 4, "dropped": 3}
    rolled = {r["text"]: r["n"] for r in digest.roll_up(df).collect()}
    assert rolled["Backup of 10 pages"] == 2 and len(rolled) == 6
    with pytest.raises(ValueError, match="rules:1"):
        digest.load_rules(["bad line"])
    with pytest.raises(ValueError, match="rules:1"):
        digest.load_rules(["a\tnoise\t("])


def test_redaction_keeps_inner_matches(spark):
    df = spark.createDataFrame([(1, "login 'sa' as sa_x, sa"), (2, "login 'bob'"), (3, "none")], "seq long, text string")
    out = [r["text"] for r in digest.redact(df, {"login": "login '([^']+)'"}).orderBy("seq").collect()]
    assert out == ["login '<login_1>' as sa_x, <login_1>", "login '<login_2>'", "none"]


def test_majority_union(spark):
    a = lambda n: lambda: spark.range(n).withColumn("v", F.lit("x"))
    found = union.unite({"b": a(2), "a": a(1), "odd": lambda: spark.range(3), "bad": lambda: spark.read.parquet("/nowhere")})
    assert found.status == {"a": "ok", "b": "ok", "bad": "failed: AnalysisException", "odd": "deviates"}
    assert found.rows.count() == 3 and found.apart["odd"].count() == 3
    assert union.free_name("source", {"Source", "_source"}) == "__source"
    assert union.majority({"a": (("x", "int"),), "b": (("y", "int"),)}) == (("x", "int"),)


def test_bounded_counts_all(spark):
    out = bounded.bounded(spark.range(30), [F.asc("id")], 20)
    assert (out.rows.count(), out.row_count, out.truncated) == (20, 30, True)
    assert bounded.bounded(spark.range(30), [F.asc("id")], 0).rows.count() == 30
    assert bounded.or_sentinel(spark.range(2)).count() == 2


def test_matching_and_drift(spark):
    r = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 1)], "k int, x string, y int")
    c = spark.createDataFrame([(7, "a", None), (8, "b", 1), (9, "b", 1), (10, "d", 1)], "k int, x string, y int")
    assert [x[2] for x in sorted(matching.null_safe_match(r, c, "k", ["x", "y"]).collect())] == ["exact_once", "exact_many", "no_match"]
    assert {tuple(x) for x in matching.partial_match(r, c, "k", ["x", "y"], ["y"], "k").collect()} == {(3, 8), (3, 9), (3, 10)}
    assert matching.missing_rows(r.select("x", "y"), c.select("x", "y")) == 1


def test_advisor_decisions(spark):
    idx = spark.createDataFrame(
        [(1, 1, True, [1], [2, 3, 4]), (1, 2, False, [5], []), (2, 1, False, [1, 2], [3])], "table_id int, index_id int, is_constraint boolean, keys array<int>, includes array<int>"
    )
    cand = spark.createDataFrame([("covered", 2, [1], [2]), ("widen", 2, [1, 2], [9]), ("replace", 1, [5, 6], []), ("new", 1, [7], []), ("discuss", 1, [1], [9])], "candidate_id string, table_id int, keys array<int>, includes array<int>")
    assert all(r["candidate_id"] == r["decision"] for r in advisor.confront(cand, idx).collect())
    needs = spark.createDataFrame([(1, 2, [2, 1, 7])], "need_id int, table_id int, eq array<int>")
    assert advisor.order_equality(needs, idx).first()["eq"] == [1, 2, 7]
    pairs = spark.createDataFrame([(1, 1, False, [1], []), (1, 2, False, [1, 2], []), (1, 3, False, [1, 2], [])], idx.schema)
    assert {(r[1], r[2], r[3]) for r in advisor.redundant(pairs).collect()} == {(3, 2, "same keys"), (1, 2, "key prefix"), (1, 3, "key prefix")}


def test_catalogue_collisions(spark):
    e = spark.createDataFrame([("q", "bundled"), ("Q", "mine"), ("r", "mine"), ("r", "other"), ("s", "mine")], "name string, source string")
    out = {(r["name"], r["source"]): r["rejected"] for r in advisor.collisions(e).collect()}
    assert [k for k, v in out.items() if v is None] and out[("q", "bundled")] is None and out[("s", "mine")] is None
    assert sum(v is not None for v in out.values()) == 3


def test_guard(spark):
    for text in ("select 1", "with a as (select 1 as x) select * from a where x = :p"):
        guard.check_read_only(spark, text)
    for text in ("drop table t", "insert into t values (1)", "create table t as select 1", "set x = 1", "use d", "select", "with a as (select 1) insert into t select * from a"):
        with pytest.raises(guard.Refused):
            guard.check_read_only(spark, text)
    assert guard.run_guarded(spark, "select :a + 1 as x", a=2).first()["x"] == 3
    assert guard.parameters_of("select ':no', :B, a::int -- :c\n, :a, :b") == ["b", "a"]


def test_scalars(spark):
    row = spark.range(1).select(
        S.int_time_seconds(F.lit(1234567)).alias("t"), S.int_date(F.lit(0)).alias("none"), S.int_date(F.lit(20240229)).cast("string").alias("day"),
        S.nearly_equal(F.lit(1.0), F.lit(1.0000001)).alias("eq"), S.pages_to_mb(F.lit(130)).alias("mb"), S.glob_match(F.lit("A.b/c"), "a.*").alias("glob"), S.excerpt(F.lit(" a \n `b` ")).alias("x"),
        S.signature(F.lit("id 5 at 10.1.2.3 0xAF 01234567-89ab-cdef-0123-456789abcdef")).alias("sig"),
    ).first()
    assert row.asDict() == {"t": 123 * 3600 + 45 * 60 + 67, "none": None, "day": "2024-02-29", "eq": True, "mb": 1.02, "glob": False, "x": "a 'b'", "sig": "id <n> at <ip> <hex> <guid>"}


def test_stream_of_signatures(spark, sf_dir, tmp_path):
    from opsloom.streaming import tail

    spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = tail.signature_counts(tail.read_events(spark, str(tmp_path / "in"), 1).withColumn("text", F.concat("event_type", F.lit(" "), "user_id")), time="ts", late="40 days")
    q = stream.writeStream.format("memory").queryName("sigs").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from sigs").first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count()
