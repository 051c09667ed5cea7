import json
import random

import pytest
from pyspark.sql import functions as F

from rarevar_spark.llm import chat_format as C

COLUMNS = "conv_id long, turn long, kind string, role string, call_id string, name string, arguments string, content string, after array<string>"
SCHEMAS = [("f", "x", "integer", True), ("f", "y", "string", False), ("f", "z", "number", False), ("f", "o", "object", False), ("f", "l", "array", False), ("f", "b", "boolean", False)]


def call(conv, turn, ident, args='{"x":1}', after=None, name="f"):
    return (conv, turn, "call", "assistant", ident, name, args, None, after)


def result(conv, turn, ident):
    return (conv, turn, "result", "tool", ident, None, None, "done", None)


def chats(spark, rows):
    schemas = spark.createDataFrame(SCHEMAS, "tool string, param string, type string, required boolean")
    df = spark.createDataFrame([(*r, 1) for r in rows], COLUMNS + ", spec_ int").repartition(3)
    return {(r.conv_id, r.turn): r for r in C.format_chats(df, schemas).collect()}


def test_links_and_problems(spark):
    got = chats(spark, [
        (1, 0, "text", "user", None, None, None, "hi \"é\"\n", None), call(1, 1, "a"), result(1, 2, "a"), result(1, 3, "a"), call(1, 4, "b"), result(1, 5, "zz"), call(1, 6, "a"),
        call(2, 0, "a", None), call(2, 1, "c", "[1]"), call(2, 2, "d", '{"x":1.5,"y":2,"q":0}'), call(2, 3, "e", "{", name="g"), call(2, 4, None), result(2, 5, None), call(2, 6, "h", after=["nope"]),
    ])
    p = {k: r.problems for k, r in got.items()}
    assert got[1, 1].linked and got[1, 2].linked and got[1, 3].linked and p[1, 1] == [] and got[1, 0].linked is None
    assert p[1, 4] == ["no result"] and p[1, 5] == ["no call"] and p[1, 6] == ["no result", "call_id used before"] and not got[1, 6].linked
    assert p[2, 0] == ["not an object", "no result"] and p[2, 1] == ["not an object", "no result"] and p[2, 2] == ["type x", "type y", "unexpected q", "no result"]
    assert p[2, 3] == ["unknown tool", "no result"] and p[2, 4] == ["no result"] and p[2, 5] == ["no call"] and p[2, 6] == ["no result", "waits for unknown call"]
    assert got[1, 0].json == '{"content":"hi \\"é\\"\\n","conv_id":1,"kind":"text","role":"user","turn":0}'


def test_canonical_json(spark):
    args = '{ "x": 1, "o": {"b": [1, 2.50, null], "a": {"d": true, "c": 1e2}}, "y": "\\u00e9" }'
    got = chats(spark, [call(1, 0, "a", args)])[1, 0]
    assert got.problems == ["no result"]
    assert got.json == '{"arguments":{"o":{"a":{"c":100,"d":true},"b":[1,2.5,null]},"x":1,"y":"é"},"call_id":"a","conv_id":1,"kind":"call","name":"f","role":"assistant","turn":0}'
    assert json.loads(got.json)["arguments"] == json.loads(args)


def test_numbers_have_one_form(spark):
    """100, 100.0 and 1e2 are one text; the forms are those that JavaScript prints."""
    forms = {
        "100": ["100", "100.0", "1e2", "1E+2", "1000e-1"], "0": ["0", "0.0", "-0", "-0.0", "0e5"], "-2.5": ["-2.5", "-2.50", "-25e-1"], "123456789012345680000": ["1.2345678901234568e20"], "1e+21": ["1e21"], "1.5e+300": ["15e299"],
        "0.000001": ["1e-6", "0.000001"], "1e-7": ["1e-7", "0.0000001"], "-1.25e-9": ["-1.25e-9"], "12345678901234567890": ["12345678901234567890"], "10000000": ["1e7", "10000000"], "0.1": ["0.1", "1e-1"],
    }
    rows = [(want, f'{{"b":{x},"a":["1e2 \\" 1.0",{x}]}}') for want, xs in forms.items() for x in xs]
    got = spark.createDataFrame(rows, "want string, text string").select("want", "text", C.canonical_json(F.col("text")).alias("json")).collect()
    for r in got:
        assert r.json == f'{{"a":["1e2 \\" 1.0",{r.want}],"b":{r.want}}}', r.text
        assert json.loads(r.json)["b"] == pytest.approx(json.loads(r.text)["b"], rel=1e-15)
    assert spark.range(1).select(C.canonical_json(F.lit("{x"))).first()[0] is None


def test_odd_rows(spark):
    """Malformed arguments stay as text; repeated rows are repeated; a very long content; null everywhere."""
    rows = [call(1, 0, "a", "{x"), result(1, 1, "a"), result(1, 1, "a"), (1, 2, "text", "user", None, None, None, "long " * 100_000, None), (2, 0, None, None, None, None, None, None, None), call(3, 1, "b", None), call(3, 0, "b")]
    schemas = spark.createDataFrame(SCHEMAS, "tool string, param string, type string, required boolean")
    got = C.format_chats(spark.createDataFrame(rows, COLUMNS), schemas).collect()
    assert len(got) == 7
    by = {(r.conv_id, r.turn): r for r in got}
    assert json.loads(by[1, 0].json)["arguments"] == "{x" and by[1, 0].problems == ["not an object"] and by[1, 0].linked
    assert sum(r.turn == 1 and r.linked for r in got if r.conv_id == 1) == 2 and len(json.loads(by[1, 2].json)["content"]) == 500_000
    assert json.loads(by[2, 0].json) == {"conv_id": 2, "turn": 0} and by[3, 1].problems == ["not an object", "no result", "call_id used before"]


def test_types(spark):
    good = '{"x":1,"y":"s","z":1.5,"o":{},"l":[1],"b":false}'
    bad = '{"x":"1","y":1,"z":"1","o":[],"l":{},"b":0}'
    got = chats(spark, [call(1, 0, "a", good), call(1, 1, "b", bad), call(1, 2, "c", "{}"), call(1, 3, "d", '{"x":null}')])
    assert got[1, 0].problems == ["no result"]
    assert got[1, 1].problems == ["type b", "type l", "type o", "type x", "type y", "type z", "no result"]
    assert got[1, 2].problems == ["missing x", "no result"] and got[1, 3].problems == ["type x", "no result"]


def ordered(rows):
    return [r.turn for r in sorted(rows, key=lambda r: (r.pos, r.level, r.turn))]


def test_order(spark):
    got = chats(spark, [
        # a result before its call; a call before those it waits for, in a chain; what follows a moved call moves too
        result(1, 0, "c"), call(1, 1, "a", after=["b"]), result(1, 2, "a"), call(1, 3, "b", after=["c"]), call(1, 4, "c"), (1, 5, "text", "user", None, None, None, "x", None),
        # a circle stays where it is, and so does what is in order
        call(2, 0, "p", after=["q"]), call(2, 1, "q", after=["p"]), call(2, 2, "r"), call(2, 3, "s", after=["s", "r"]),
    ])
    assert ordered([r for (c, _), r in got.items() if c == 1]) == [4, 0, 3, 1, 2, 5]
    assert ordered([r for (c, _), r in got.items() if c == 2]) == [0, 1, 2, 3]
    assert "circle" in got[2, 0].problems and "circle" in got[2, 1].problems and "circle" not in got[2, 3].problems


def keys_by_hand(edges):
    """turn: (pos, level, cyclic) by searches from every message."""
    deps, out = {}, {}
    for t, d in edges:
        deps.setdefault(t, set()).add(d)

    def reach(t):
        seen, todo = set(), [t]
        while todo:
            for d in deps.get(todo.pop(), ()):
                if d not in seen:
                    seen.add(d), todo.append(d)
        return seen

    top = {t: max({t} | reach(t)) for t in {x for e in edges for x in e}}
    tight = {t: {d for d in deps.get(t, ()) if top[d] == top[t]} for t in top}
    on_circle = {t for t in top if t in reach(t)}
    longest = lambda t: max((longest(d) + 1 for d in tight[t]), default=0)
    for t in deps:
        stuck = bool(on_circle & {x for x in {t} | reach(t) if top[x] == top[t]})
        if stuck or top[t] != t:
            out[t] = (t, 0, True) if stuck else (top[t], longest(t), False)
    return out


@pytest.mark.parametrize("together", [2000, 6, 0])
def test_order_keys(spark, together):
    """Random graphs, with chains, circles and messages that wait for these, in arrays and in rounds."""
    rng, graphs = random.Random(3), {}
    for c in range(60):
        n = rng.choice([2, 4, 8, 12])
        graphs[c] = {(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([1, n // 2, n]))) if a != b}
    df = spark.createDataFrame([(c, a, b) for c, g in graphs.items() for a, b in g for _ in "xy"], "conv_id long, turn long, dep_turn long")
    got = {(r.conv_id, r.turn): (r.pos, r.level, r.cyclic) for r in C.order_keys(df, together).collect()}
    assert got == {(c, t): k for c, g in graphs.items() for t, k in keys_by_hand(g).items()}


def test_a_chain_of_500_takes_no_round_of_joins(spark, monkeypatch):
    written, real = [], C.keep
    monkeypatch.setattr(C, "keep", lambda df, name: written.append(name) or real(df, name))
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(500)], "conv_id long, turn long, dep_turn long")
    assert {(r.turn, r.pos, r.level, r.cyclic) for r in C.order_keys(edges).collect()} == {(i, 500, 500 - i, False) for i in range(500)}
    assert written == ["order-edges"]
    ring = edges.unionByName(spark.createDataFrame([(1, 500, 0)], edges.schema))
    assert {(r.turn, r.pos, r.level, r.cyclic) for r in C.order_keys(ring).collect()} == {(i, i, 0, True) for i in range(501)}


def test_long_chain_and_empty(spark):
    n = 12
    rows = [call(1, i, f"c{i}", after=[f"c{i + 1}"] if i < n - 1 else None) for i in range(n)]
    assert ordered(chats(spark, rows).values()) == list(range(n))[::-1]
    assert chats(spark, [r for r in rows if False]) == {}
