import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from oracle import assert_same  # noqa: E402

from millrace.llm import chat_format as cf

SEARCH = cf.Tool(
    "search",
    {
        "query": cf.Property("string", True, min_length=1),
        "limit": cf.Property("integer", minimum=1, maximum=50),
        "exact": cf.Property("boolean"),
    },
)
CALL = "conv_id long, call_id string, turn long, tool string, arguments string, cites array<string>, status string"
RESULT = "conv_id long, call_id string, turn long, content string, status string"
MESSAGE = "conv_id long, turn long, role string, text string, json string"


@pytest.fixture(scope="module")
def lines(spark):
    calls = [
        (1, "c", 5, "search", '{"query":"x","limit":5}', ["b", "gone"], ""),
        (1, "b", 7, "search", '{ "limit" : 2, "query" : "é\\"q" }', ["a"], ""),
        (1, "a", 9, "search", '{"query":""}', [], ""),
        (2, "a", 1, "search", '{"query":7,"limit":99}', None, ""),
        (2, "x", 2, "search", '{"query":"q","limit":"5"}', ["y"], ""),
        (2, "y", 3, "search", "[1]", ["x"], ""),
        (2, "z", 4, "search", "not json", ["y"], ""),
        (3, "a", 1, "draw", None, [], ""),
        (3, "a", 1, "draw", None, [], ""),
        (3, None, 2, "search", '{"query":"q","exact":1}', [], ""),
    ]
    results = [
        (1, "a", 2, "late", ""), (1, "b", 8, None, ""), (3, "a", 4, "second", ""), (3, "a", 3, "first", ""),
        (3, "lost", 5, "no one", ""), (3, None, 6, "nothing", ""),
    ]
    messages = [(1, 0, "system", 'say "hi"\n ', ""), (1, 1, None, None, "")]
    frames = (
        spark.createDataFrame(messages, MESSAGE),
        spark.createDataFrame(calls, CALL).drop("status"),
        spark.createDataFrame(results, RESULT).drop("status"),
    )
    return cf.records(*frames, [SEARCH]).collect()


def of(lines, conv, call, kind="call"):
    return [r for r in lines if (r.conv_id, r.call_id, r.kind) == (conv, call, kind)]


def test_every_line_is_canonical_json(lines):
    for r in lines:
        assert json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.json
    assert len(lines) == 2 + 10 + 2


def test_order_follows_citations(lines):
    (a,), (b,), (c,) = (of(lines, 1, x) for x in "abc")
    assert (a.level, b.level, c.level) == (0, 1, 2)
    assert all(of(lines, 2, x)[0].status == "circular" and of(lines, 2, x)[0].level is None for x in "xyz")


def test_links(lines):
    assert json.loads(of(lines, 1, "a")[0].json)["result"] == "late"
    assert [json.loads(r.json)["result"] for r in of(lines, 3, "a")] == ["first", "first"]
    assert of(lines, 1, "b")[0].status == "answered" and of(lines, 1, "c")[0].status == "unanswered"
    assert of(lines, 3, "lost", "result")[0].status == "no call" and of(lines, 3, None, "result")[0].turn == 6


def test_faults(lines):
    assert of(lines, 1, "b")[0].faults == [] and json.loads(of(lines, 1, "b")[0].json)["arguments"]["query"] == 'é"q'
    assert of(lines, 1, "a")[0].faults == ["query is too short"]
    assert of(lines, 2, "a")[0].faults == ["limit is too large", "query is no string"]
    assert of(lines, 2, "x")[0].faults == ["limit is no integer"]
    assert of(lines, 2, "y")[0].faults == ["not an object"] == of(lines, 2, "z")[0].faults
    assert of(lines, 3, "a")[0].faults == ["unknown tool"]
    assert of(lines, 3, None)[0].faults == ["exact is no boolean"]


def test_empty_and_odd_conversations(spark):
    schema = "conv_id long, turn long, role string, text string, level int"
    empty = spark.createDataFrame([], schema).select("conv_id", "turn", "role", "text")
    assert cf.records(*cf.as_calls(empty), [cf.REPLY], cited=False).count() == 0
    rows = [(1, 0, "user", None, 1), (1, 1, "assistant", "x" * 300_000, 1), (None, None, None, "", 1), (1, 3, "user", "", 1)]
    table = spark.createDataFrame(rows, schema)
    got = cf.records(*cf.as_calls(table), [cf.REPLY], cited=False).collect()
    assert sorted(r.kind for r in got) == ["call", "call", "message"]
    assert {tuple(r.faults) for r in got if r.faults} == {("prompt is missing",), ("prompt is too short",)}


def test_every_row_of_a_conversation_comes_out(spark, tmp_path):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a")]
    rows += [(1, 1, "assistant", None), (1, 5, "assistant", "y"), (1, 5, "assistant", "x"), (2, 0, "user", "q")]
    rows += [(None, 1, "assistant", f"n{i % 3}") for i in range(5)] + [(2, None, "assistant", f"t{i}") for i in range(3)]
    rows += [(None, 0, "user", "q"), (2, None, "user", "q"), (2, None, "system", "s"), (None, None, None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    got = cf.op3_tool_calls(spark, str(tmp_path)).collect()
    contents = [json.loads(r.json).get("result") for r in got if r.kind == "result" or r.status == "answered"]
    assert sorted(map(str, contents)) == sorted(str(t) for _, _, role, t in rows if role == "assistant")
    calls = [r for r in got if r.kind == "call"]
    assert len(calls) == sum(role == "user" for _, _, role, _ in rows)
    assert [r.status for r in calls].count("answered") == 1
    assert len(got) == len(rows) - 1  # the answered call's record holds two rows
    assert all(r.status == "no call" and r.call_id is None for r in got if r.kind == "result" and None in (r.conv_id, r.turn))
    again = [r for r in got if r.status == "repeated result"]
    assert sorted((r.turn, json.loads(r.json)["result"]) for r in again) == [(1, "a"), (1, "a"), (1, "b"), (5, "y")]


def test_levels_follow_answered_calls(spark, tmp_path):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", "x") for t in range(100) if t != 41]
    rows += [(1, 4, "user", "twice"), (1, 7, "assistant", "y"), (1, 300, "assistant", "z"), (2, 0, "user", "q"), (2, 2, "user", "q")]
    rows += [(None, 2, "user", "q"), (2, None, "user", None), (None, 3, "assistant", "n"), (2, None, "assistant", "n")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    frame = cf.op3_tool_calls(spark, str(tmp_path))
    level = {(r.conv_id, r.turn): r.level for r in frame.where("kind = 'call'").collect()}
    assert [level[1, t] for t in range(0, 100, 2)] == [t // 2 - (t > 40) for t in range(0, 100, 2)]
    assert level[2, 0] == level[2, 2] == level[None, 2] == level[2, None] == 0
    assert_same(frame, cf.ORACLE, str(tmp_path))


def test_chains_are_levelled_in_few_rounds(spark, monkeypatch):
    names = [f"c{i}" for i in range(300)]
    calls = [(1, b, [a]) for a, b in zip(names, names[1:])] + [(1, "c0", []), (1, "side", ["c9"])]
    calls += [(2, f"r{i}", [f"r{(i + 1) % 5}"]) for i in range(5)] + [(2, "in", ["r0"]), (2, "in2", ["in"]), (2, "self", ["self"])]
    rounds = []
    kept = cf.stored
    monkeypatch.setattr(cf, "stored", lambda df, what: (rounds.append(what), kept(df, what))[1])
    got = {r.call_id: r.level for r in cf.call_levels(spark.createDataFrame(calls, "conv_id long, call_id string, cites array<string>")).collect()}
    assert all(got[n] == i for i, n in enumerate(names) if i) and got["side"] == 10 and "c0" not in got
    assert all(got[n] is None for n in ("r0", "r4", "in", "in2", "self"))
    assert len(rounds) < 16


def test_rows_by_their_number(spark):
    frame = spark.createDataFrame([(1, 0), (2, 1), (3, 3), (4, 7)], "k int, n bigint")
    got = [r.k for r in cf._times(frame, "n", 3).collect()]
    assert sorted(got) == [2, 3, 3, 3, *[4] * 7]
