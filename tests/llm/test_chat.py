import json

from pyspark.sql import functions as F

from trawl.llm import chat as C

SCHEMA = "conv_id long, seq long, kind string, role string, id string, name string, arguments string, content string, depends_on array<string>"
SCHEMAS = {"add": {"a": ("number", True), "b": ("number", True), "note": ("string", False)}, "list": {"items": ("array", True), "deep": ("boolean", False), "o": ("object", False), "n": ("integer", False)}}


def linked(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("level", F.lit("clash")).withColumn("status", F.lit(1))
    return sorted((r.asDict() for r in C.link(df, SCHEMAS).collect()), key=lambda r: (str(r["conv_id"]), r["level"] if r["level"] is not None else 99, r["seq"]))


def call(seq, id, arguments, name="add", on=(), conv=1):
    return (conv, seq, "call", "assistant", id, name, arguments, None, list(on))


def result(seq, id, content, conv=1):
    return (conv, seq, "result", "tool", id, None, None, content, [])


def test_linking_and_order(spark):
    rows = [result(0, "c2", "seven"), call(1, "c2", '{"b":2,"a":1}', on=["c1"]), call(2, "c1", '{"a":1,"b":1.5}'), result(3, "c1", "two"), call(4, "c3", '{"a":1,"b":1}', on=["c1", "c2", "gone"]), result(5, "none", "x"), (1, 6, "message", "user", None, None, None, "hi \"there\"\n", [])]
    rows += [call(7, "x", "{}", on=["y"]), call(8, "y", "{}", on=["x"]), call(9, None, '{"a":1,"b":2}'), result(10, "c1", "again"), result(11, None, "y"), (None, 1, "call", "assistant", "c1", "add", '{"a":1,"b":2}', None, []), result(2, "c1", "r", None)]
    got = linked(spark, rows)
    status = {(r["conv_id"], r["seq"]): (r["level"], r["status"]) for r in got}
    assert status == {
        (1, 0): (2, "linked"), (1, 1): (1, "answered"), (1, 2): (0, "answered"), (1, 3): (1, "linked"), (1, 4): (2, "unanswered"), (1, 5): (0, "orphan"), (1, 6): (0, "message"),
        (1, 7): (None, "circular"), (1, 8): (None, "circular"), (1, 9): (0, "unanswered"), (1, 10): (1, "repeated"), (1, 11): (0, "orphan"), (None, 1): (0, "answered"), (None, 2): (1, "linked"),
    }
    for r in got:
        parsed = json.loads(r["json"])
        assert r["json"] == json.dumps(parsed, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert next(json.loads(r["json"])["content"] for r in got if r["seq"] == 6) == 'hi "there"\n'


def test_arguments(spark):
    cases = [
        ('{"a":1,"b":2}', "add", None), ('{"a":1}', "add", "b: missing"), ('{"a":"1","b":2}', "add", "a: not number"), ('{"a":1,"b":2,"z":1}', "add", "z: not a parameter"),
        ("[1]", "add", "not a JSON object"), ("nonsense", "add", "not a JSON object"), (None, "add", "not a JSON object"), ("{}", "other", "unknown function"), ("{}", None, "unknown function"),
        ('{"items":[1,{"b":1,"a":[]}],"deep":true,"o":{"z":1,"a":2},"n":3}', "list", None), ('{"items":{},"n":1.5}', "list", "items: not array"), ('{"items":[],"n":1.5}', "list", "n: not integer"), ('{"a":null,"b":1}', "add", "a: not number"), ('{"a":1,"a":2,"b":3}', "add", "not a JSON object"),
    ]
    got = linked(spark, [call(i, f"c{i}", a, n) for i, (a, n, _) in enumerate(cases)])
    assert [r["problem"] for r in sorted(got, key=lambda r: r["seq"])] == [p for _, _, p in cases]
    assert '"arguments":{"deep":true,"items":[1,{"a":[],"b":1}],"n":3,"o":{"a":2,"z":1}}' in next(r["json"] for r in got if r["seq"] == 9)


def brute_levels(turns):
    """Level of each (conv, turn): one above that of the last user's turn before it; 0 without one."""
    out = {}
    for conv in {c for c, _, _ in turns}:
        own = sorted((t, r) for c, t, r in turns if c == conv)
        for t, _ in own:
            calls = [u for u, r in own if u < t and r == "user"]
            out[conv, t] = out[conv, max(calls)] + 1 if calls else 0
    return out


def test_turns(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = turns.collect()
    found = C.format_turns(turns).collect()
    got = {(r.conv_id, r.seq): r for r in found}
    at = {(r.conv_id, r.turn): r for r in rows}
    level = brute_levels([(r.conv_id, r.turn, r.role) for r in rows])
    assert len(got) == len(rows)
    for (conv, turn), r in at.items():
        g = got[conv, turn]
        if r.role == "user":
            answered = (conv, turn + 1) in at and at[conv, turn + 1].role == "assistant"
            assert (g.level, g.status, g.problem) == (level[conv, turn], "answered" if answered else "unanswered", None)
            assert json.loads(g.json)["arguments"] == {"prompt": r.text, "turn": turn}
        elif r.role == "assistant":
            linked_to = (conv, turn - 1) in at and at[conv, turn - 1].role == "user"
            assert (g.level, g.status) == (level[conv, turn], "linked" if linked_to else "orphan")
            assert json.loads(g.json)["content"] == r.text
        else:
            assert (g.level, g.status) == (level[conv, turn], "message")
    for conv in {r.conv_id for r in found}:
        read = [r.seq for r in sorted((r for r in found if r.conv_id == conv), key=lambda r: (r.level, r.seq))]
        assert read == sorted(read)


def test_empty_and_long(spark):
    assert linked(spark, []) == []
    rows = [(1, 0, "user", "x\\\"" * 100_000), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, None, "user", ""), (None, 3, None, "t")]
    got = C.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 5 and {r.status for r in got} == {"answered", "linked", "unanswered", "message"}


def test_dependencies_in_null_conversations(spark):
    rows = [call(1, "a", "{}", conv=None), call(2, "b", "{}", on=["a"], conv=None), call(3, "c", "{}", on=["b", "a"], conv=None), result(4, "c", "x", None), call(5, "x", "{}", on=["y"], conv=None), call(6, "y", "{}", on=["x"], conv=None), call(7, "d", "{}", on=["a"])]
    got = {(r["conv_id"], r["seq"]): (r["level"], r["status"]) for r in linked(spark, rows)}
    assert got == {
        (None, 1): (0, "unanswered"), (None, 2): (1, "unanswered"), (None, 3): (2, "answered"), (None, 4): (3, "linked"),
        (None, 5): (None, "circular"), (None, 6): (None, "circular"), (1, 7): (0, "unanswered"),
    }


def test_long_conversation_takes_few_rounds(spark, monkeypatch):
    """A chain of 400 calls: as many rounds as its logarithm, and the order of the turns."""
    cuts = []
    plain = C.cut
    monkeypatch.setattr(C, "cut", lambda df: cuts.append(1) or plain(df))
    rows = [(5, t, ["user", "assistant", "user", "system"][t % 4], "x") for t in range(800)] + [(None, 3, "user", "y"), (None, 9, "user", "z"), (None, 10, "assistant", "z")]
    got = C.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    level = brute_levels([(c, t, r) for c, t, r, _ in rows])
    assert {(r.conv_id, r.seq): r.level for r in got} == level
    assert len(cuts) < 40


def test_chains_that_meet(spark):
    """Chains under calls of several dependencies, a circle, and what hangs on it."""
    on = {f"c{i}": [f"c{i - 1}"] for i in range(1, 30)} | {"c0": [], "d0": [], "d1": ["d0"], "m": ["c29", "d1"], "n": ["m"], "o": ["n", "c3", "gone"], "x": ["z"], "y": ["x"], "z": ["y"], "w": ["x"], "v": ["w", "c0"], "u": ["v"], "s": ["s"]}
    calls = spark.createDataFrame([(1, k, v) for k, v in on.items()] + [(1, "d1", ["d0"]), (2, "c5", ["c4"])], "conv_id long, id string, depends_on array<string>")
    got = {(r.conv_id, r.id): r.level for r in C.levels(calls).collect()}
    expected = {(1, f"c{i}"): i for i in range(30)} | {(1, "d0"): 0, (1, "d1"): 1, (1, "m"): 30, (1, "n"): 31, (1, "o"): 32, (2, "c5"): 0} | {(1, k): None for k in "xyzwvus"}
    assert got == expected


def test_plan_is_native_and_joins_by_hashes(spark, sf):
    df = C.format_turns(spark.read.parquet(f"{sf}/conversations.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "Python" not in plan and "Arrow" not in plan
