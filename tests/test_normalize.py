import pytest
from pyspark.sql import functions as F

from tests.events import at
from tidelog.functions.sql_text import query_context, query_summary, utf8_prefix
from tidelog.operators.normalize import affected_rows, normalize
from tidelog.schemas import EVENT, RAW_EVENT


def raw(spark, *rows):
    return spark.createDataFrame([{n: r.get(n) for n in RAW_EVENT.names} | {"seq": k, "ts": at(k)} for k, r in enumerate(rows)], RAW_EVENT)


def one(spark, **r):
    out = normalize(raw(spark, r)).collect()
    return out[0] if out else None


@pytest.mark.parametrize("kind,operation", [("WRITE_ROWS_EVENTv2", "INSERT"), ("WriteRowsEventV1", "INSERT"), ("UPDATE_ROWS_EVENTv2", "UPDATE"), ("UpdateRowsEventV2", "UPDATE"), ("DELETE_ROWS_EVENTv0", "DELETE"), ("DeleteRowsEventV2", "DELETE")])
def test_row_events(spark, kind, operation):
    got = one(spark, event_type=kind, schema="shop", table="orders", row_count=5)
    assert (got["event_type"], got["operation"], got["schema"], got["table"], got["row_count"]) == ("ROWS", operation, "shop", "orders", 5)


@pytest.mark.parametrize("kind", ["QUERY_EVENT", "QueryEvent"])
@pytest.mark.parametrize("query,want", [("BEGIN", "BEGIN"), (" commit\n", "COMMIT"), (" begin ", "BEGIN"), ("ROLLBACK", None), ("CREATE TABLE t (a int)", None), ("", None), (None, None)])
def test_queries(spark, kind, query, want):
    got = one(spark, event_type=kind, query=query, schema="shop")
    assert (got and got["event_type"]) == want


def test_others(spark):
    assert one(spark, event_type="XID_EVENT")["event_type"] == one(spark, event_type="XIDEvent")["event_type"] == "XID"
    got = one(spark, event_type="TableMapEvent", schema="shop", table="orders")
    assert (got["event_type"], got["schema"], got["table"]) == ("TABLE_MAP", "shop", "orders")
    assert one(spark, event_type="FORMAT_DESCRIPTION_EVENT") is None
    assert one(spark, event_type="write_rows_event") is None  # names are told by case


def test_schema(spark):
    assert [(f.name, f.dataType) for f in normalize(raw(spark)).schema] == [(f.name, f.dataType) for f in EVENT]


def test_sql(spark):
    got = one(spark, event_type="RowsQueryEvent", query_sql="INSERT INTO t VALUES (1)")
    assert (got["event_type"], got["query_sql"], got["query_truncated"], got["query_original_bytes"]) == ("ROWS_QUERY", "INSERT INTO t VALUES (1)", False, 24)
    got = one(spark, event_type="ROWS_QUERY_EVENT", query_sql="")
    assert (got["query_sql"], got["query_truncated"], got["query_original_bytes"]) == ("", False, 0)
    got = one(spark, event_type="ROWS_QUERY_EVENT", query_sql="x" * 5000)
    assert (len(got["query_sql"]), got["query_truncated"], got["query_original_bytes"]) == (4096, True, 5000)


@pytest.mark.parametrize("lead", range(4))
@pytest.mark.parametrize("char", ["é", "日", "👩"])
def test_prefixes_keep_whole_characters(spark, lead, char):
    text = "a" * lead + char * 3000
    got = spark.createDataFrame([(text,)], "t string").select(utf8_prefix(F.col("t"))).first()[0]
    raw_bytes = text.encode()[:4096]
    assert got == raw_bytes.decode("utf-8", "ignore")


def test_summaries(spark):
    cases = {"SELECT   id\n\tFROM   users  WHERE  id  =  1": "SELECT id FROM users WHERE id = 1", "": "", " \n ": "", "x" * 160: "x" * 160, "é" * 161: "é" * 157 + "...", " a ": "a"}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", query_summary(F.col("t"))).collect()
    assert dict(map(tuple, got)) == cases


def test_contexts(spark):
    got = spark.createDataFrame([("",), ("ab",), ("x" * 4097,)], "t string").select(query_context(F.col("t")).alias("c")).collect()
    assert got[0]["c"] is None and tuple(got[1]["c"]) == ("ab", False, 2) and got[2]["c"]["truncated"] and got[2]["c"]["original_bytes"] == 4097


def test_affected_rows(spark):
    rows = [("UPDATE_ROWS_EVENTv2", 7, 3), ("UpdateRowsEventV2", 4, 2), ("WRITE_ROWS_EVENTv2", 7, 7)]
    got = spark.createDataFrame(rows, "k string, n long, want long").select(affected_rows(F.col("k"), F.col("n")), "want").collect()
    assert all(a == b for a, b in got)


def test_window_reaches_the_scan(spark):
    from tidelog.operators.window import in_window

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = in_window(events, at(), at(60))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThanOrEqual(ts" in plan
