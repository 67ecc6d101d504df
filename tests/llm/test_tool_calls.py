"""Linking, ordering, validation and canonical JSON of tool calls."""

import json

from compare import assert_same

from wavemill.llm import registry, tool_calls

SCHEMA = {"search": {"limit": ("bigint", False, 1, 10), "query": ("string", True, 1, 20)}, "stop": {}}


def link(spark, calls, results):
    c = spark.createDataFrame([(*r, "extra") for r in calls], "call_id string, after string, name string, arguments string, step string")
    r = spark.createDataFrame(results, "call_id string, content string")
    return {x["call_id"]: x for x in tool_calls.link_calls(c, r, SCHEMA).collect()}


def test_errors_and_order(spark):
    calls = [
        ("a", None, "search", '{"query": "x", "limit": 3}'), ("b", "a", "search", '{"limit":0,"query":"y","zoo":1}'), ("c", "b", "search", '{"query": 5}'),
        ("d", "zz", "stop", "{}"), ("e", "f", "stop", "{}"), ("f", "e", "stop", "{}"), ("g", "e", "stop", "{}"), ("h", None, "stop", "[1]"), ("i", None, "fly", "{}"),
        ("j", None, "search", None), ("j", None, "search", None), (None, None, "stop", "{}"), ("k", "k", "stop", "{}"),
    ]
    out = link(spark, calls, [("a", "r1"), ("b", "r2"), ("b", "r0"), (None, "lost"), ("x", "orphan")])
    assert sorted(out) == list("abcdefghijk")
    assert [out[x]["step"] for x in "abcd"] == [0, 1, 2, 0]
    assert all(out[x]["step"] is None and "cycle" in out[x]["errors"] for x in "efgk")
    assert out["a"]["valid"] and out["a"]["errors"] == ""
    assert out["b"]["errors"] == "2 results; limit: below 1; zoo: unknown"
    assert out["c"]["errors"] == "no result; query: not string"
    assert out["d"]["errors"] == "no result; unknown predecessor"
    assert out["h"]["errors"] == "no result; arguments are no object"
    assert out["i"]["errors"] == "no result; unknown tool"
    assert out["j"]["errors"] == "no result; 2 calls; arguments are no object" and out["j"]["calls"] == 2
    assert out["a"]["record"] == '{"arguments":{"limit":3,"query":"x"},"call_id":"a","errors":[],"name":"search","result":"r1","step":0}'
    assert json.loads(out["b"]["record"])["result"] == "r0"


def test_long_chain_and_empty_tables(spark):
    n = 300
    calls = [(f"{k:04d}", f"{k - 1:04d}" if k else None, "stop", "{}") for k in range(n)]
    out = link(spark, calls, [])
    assert [out[f"{k:04d}"]["step"] for k in range(n)] == list(range(n))
    assert link(spark, [], []) == {}


def test_query_matches_sql(spark, sf):
    assert_same(spark, sf, registry.QUERIES["op1_tool_calls"], registry.ORACLE_SQL["op1_tool_calls"])


def test_mixing_query_matches_sql(spark, sf):
    assert_same(spark, sf, registry.QUERIES["op4_mixing"], registry.ORACLE_SQL["op4_mixing"])


def test_plan_has_no_python(spark, sf):
    calls, results = tool_calls.chat_calls(spark.read.parquet(f"{sf}/conversations.parquet"))
    plan = tool_calls.link_calls(calls, results, tool_calls.CHAT_SCHEMA)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
