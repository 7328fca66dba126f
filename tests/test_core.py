"""Text functions against plain Python, and the stream against a batch count."""

import hashlib
import hmac
import re

from pyspark.sql import functions as F

from opsloom.functions import text
from opsloom.sources import formats
from opsloom.streaming.rollup_stream import minute_rollup, run_available


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_template_is_one_pass(spark):
    parts = [m for m, _ in text.MASKS]
    names = [n for _, n in text.MASKS]
    rx = re.compile("|".join(f"(?P<m{i}>{p})" for i, p in enumerate(parts)), re.I)

    def plain(s):
        def sub(m):
            i = int(m.lastgroup[1:])
            return names[i] + (re.search(r"[a-z%]+$", m[0], re.I)[0] if i == 6 else "")

        return re.sub(r"\s+", " ", rx.sub(sub, s.strip())).lower()[:200]

    for s in ("took 12 ms at 10.0.0.1:80", "GET /a/b-1/550e8400-e29b-41d4-a716-446655440000 ok", "id 550e8400-e29b-41d4-a716-446655440000", "at 2024-01-02T03:04:05Z deadbeefdeadbeef01 5%", "https://x.y/z?1 n=7", "", "no numbers"):
        assert one(spark, text.template, s) == plain(s)


def test_pseudonym_is_hmac(spark):
    want = "u_" + hmac.new(b"key", b"ada", hashlib.sha256).hexdigest()[:16]
    assert one(spark, lambda x: text.pseudonym(x, b"key"), " Ada ") == want
    assert one(spark, lambda x: text.pseudonym(x, b"key"), "-") == ""
    assert one(spark, lambda x: text.pseudonym(x, b"key"), None) == ""


def test_scrub(spark):
    assert one(spark, text.scrub, "password=abc mail a@b.org card 4111 1111 1111 1111 n 1234567890123") == "password=*** mail [E-POSTA] card [KART] n 1234567890123"
    assert one(spark, text.scrub, None) == ""


def test_severity_environment_and_pool(spark):
    assert one(spark, text.severity_from_text, "x WARN y") == "WARN"
    assert one(spark, text.severity_from_text, "connection refused") == "WARN"
    assert one(spark, text.severity_from_text, "ORA-00600 failure") == "ERROR"
    assert one(spark, text.environment_of, "prd-app-1") == "prod"
    assert one(spark, text.pool, "prd-sap-app-01.local") == "prd-sap-app"
    assert one(spark, text.pool, "10.0.0.1") == "-"


def test_windows_event_and_w3c(spark):
    xml = "<Event><System><Provider Name='p'/><EventID>7</EventID><Level>2</Level><Computer>h</Computer></System><EventData><Data>m</Data></EventData></Event>"
    row = formats.windows_event(spark.createDataFrame([(xml,)], "value string")).first()
    assert (row.host, row.service, row.event_id, row.severity, row.message) == ("h", "p", "7", "ERROR", "m")
    row = formats.w3c(spark.createDataFrame([("GET -",)], "value string"), "#Fields: method user").first()
    assert row.attributes == {"method": "GET", "user": None}


def test_continuations_fold(spark):
    lines = spark.createDataFrame([("f", 1, "2024 a"), ("f", 2, " at b"), ("f", 3, "2024 c")], "source string, line_no int, value string")
    out = formats.fold_continuations(lines, F.col("value").startswith("2024")).orderBy("line_no").collect()
    assert [r.value for r in out] == ["2024 a\n at b", "2024 c"]


def test_stream_counts_closed_windows(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:10", "a"), (1, "2024-01-01 00:00:10", "a"), (2, "2024-01-01 00:00:50", "a"), (3, "2024-01-01 03:00:00", "b")], "event_id long, ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    run_available(minute_rollup(stream, ["event_type"]), f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out/rows").collect()
    assert [(r.event_type, r.lines) for r in got] == [("a", 2)]
