import json
import random
import re
from collections import defaultdict

from trailmill.llm import chat_format as C
from trailmill.plans.shared_store import Store

CALL = '<tool_call>{"name": "search", "id": "c1", "arguments": {"query": "x", "limit": 3}}</tool_call>'
ROWS = [
    (1, 0, "user", 'Hi "you"\n é'), (1, 1, "assistant", f"Looking. {CALL}"), (1, 2, "tool", '<tool_result>{"id": "c1", "content": {"b": 1, "a": [2]}}</tool_result>'), (1, 3, "assistant", CALL),
    (2, 0, "tool", '<tool_result>{"id": "late", "content": 1}</tool_result>'), (2, 4, "assistant", '<tool_call>{"id": "late", "name": "calculate", "arguments": {"expression": "1"}}</tool_call>'),
    (3, 0, "assistant", '<tool_call>{"id": "a", "name": "search", "arguments": {"limit": "many"}}</tool_call><tool_call>{"id": "b", "name": "fly", "arguments": {}}</tool_call><tool_call>not json</tool_call>'),
    (3, 1, "assistant", '<tool_call>{"id": "d", "name": "fetch", "arguments": {"url": "u"}}</tool_call>'), (3, 2, "tool", '<tool_result>{"id": "zz", "content": 0}</tool_result>'),
    (None, 0, "user", None), (4, 0, None, ""), (4, 0, None, ""), (5, 0, "user", "w " * 40_000),
]


def test_links_order_validation_and_canonical_json(spark):
    out = C.formatted(spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string"), Store(spark, "t")).collect()
    status = {(r.conv_id, r.kind, r.call_id, r.turn): r.status for r in out if r.kind != "message"}
    assert status[1, "call", "c1", 1] == "ok" and status[1, "call", "c1", 3] == "duplicate" and status[1, "result", "c1", 2] == "ok"
    assert status[2, "call", "late", 4] == "ok" and status[2, "result", "late", 0] == "ok"
    assert status[3, "call", "a", 0] == "bad_arguments" and status[3, "call", "b", 0] == "unknown_tool" and status[3, "call", None, 0] == "malformed" and status[3, "call", "d", 1] == "unanswered" and status[3, "result", "zz", 2] == "orphan"
    place = {(r.kind, r.conv_id): (r.order_turn, r.rank) for r in out if r.call_id == "late"}
    assert place["call", 2] < place["result", 2]
    texts = {(r.conv_id, r.kind, r.turn): r.json for r in out}
    assert texts[1, "result", 2] == '{"content":{"a":[2],"b":1},"id":"c1"}'
    assert json.loads(texts[1, "message", 0]) == {"content": 'Hi "you"\n é', "role": "user"}
    assert json.loads(texts[1, "message", 1])["content"] == "Looking."
    assert texts[None, "message", 0] == '{"content":"","role":"user"}'
    assert sum(r.kind == "message" for r in out) == len(ROWS)


SCHEMA = {"search": {"query": (str, True), "limit": (int, False)}, "calculate": {"expression": (str, True)}, "fetch": {"url": (str, True)}}


def slow(rows):
    """A plain linker: (conv, turn, part, kind) -> (order_turn, step, call_id, status, json), rows in order of arrival."""
    out, calls, results = [], defaultdict(list), defaultdict(list)
    for conv, turn, _, text in rows:
        for kind, held in (("call", calls), ("result", results)):
            for part, raw in enumerate(re.findall(rf"(?s)<tool_{kind}>(.*?)</tool_{kind}>", text or ""), 1):
                try:
                    v = json.loads(raw)
                    body = json.dumps(v, sort_keys=True, separators=(",", ":"))
                except ValueError:
                    v, body = {}, json.dumps({"raw": raw}, separators=(",", ":"))
                held[conv].append({"turn": turn, "part": part, "id": v.get("id"), "name": v.get("name"), "args": v.get("arguments"), "json": body})
    for conv in {*calls, *results}:
        first, answer = {}, {}
        for held, mine in ((calls, first), (results, answer)):
            for x in sorted(held[conv], key=lambda x: (x["turn"], x["part"])):
                if x["id"] is not None and (held is results or x["name"] is not None):
                    mine.setdefault(x["id"], x)
        needs = {i: set(re.findall(r'"\$([A-Za-z0-9_-]+)"', json.dumps(x["args"]))) for i, x in first.items()}
        lost = {i for i, n in needs.items() if n - set(first)}
        place = {}
        while True:
            done = lambda d: max(place[d][0], answer[d]["turn"]) if d in answer else place[d][0]  # noqa: B023, E731
            new = {i: (max([first[i]["turn"], *(done(d) for d in needs[i] if i not in lost)]), 1 + max((place[d][1] for d in needs[i] if i not in lost), default=-1)) for i in first if i not in place and (i in lost or needs[i] <= set(place))}
            if not new:
                break
            place |= new
        for x in calls[conv]:
            i, tool = x["id"], SCHEMA.get(x["name"])
            args = x["args"] if isinstance(x["args"], dict) else {}
            linked = lambda v: isinstance(v, str) and re.fullmatch(r"\$[A-Za-z0-9_-]+", v)
            wrong = tool and (set(args) - set(tool) or any((a not in args and must) or (a in args and type(args[a]) is not t and not linked(args[a])) for a, (t, must) in tool.items()))
            status = "malformed" if i is None or x["name"] is None else "duplicate" if first[i] is not x else "unknown_tool" if not tool else "bad_arguments" if wrong else "bad_reference" if i in lost else "cyclic" if i not in place else "unanswered" if i not in answer else "ok"
            at = place.get(i, (x["turn"], 0)) if status not in ("malformed", "duplicate") else (x["turn"], 0)
            out.append((conv, x["turn"], x["part"], "call", *at, i, status, x["json"]))
        for x in results[conv]:
            i = x["id"]
            status = "malformed" if i is None else "orphan" if i not in first else "ok" if answer[i] is x else "duplicate"
            at = place.get(i, (first[i]["turn"], 0)) if i in first else (x["turn"], 0)
            out.append((conv, x["turn"], x["part"], "result", max(x["turn"], at[0]), at[1], i, status, x["json"]))
    return sorted(out, key=str)


def test_matches_a_plain_linker(spark):
    rng = random.Random(6)
    rows = []
    for conv in [*range(12), None]:
        for turn in range(rng.randrange(1, 9)):
            text = "say "
            for _ in range(rng.randrange(4)):
                i = f"c{rng.randrange(6)}"
                link = f"$c{rng.randrange(7)}"
                args = rng.choice([{"query": "x"}, {"query": "x", "limit": 3}, {"limit": "many"}, {"query": link}, {"query": link, "limit": f"$c{rng.randrange(6)}"}, {"query": "x", "more": 1}, {"query": 5}, [1], None])
                call = rng.choice([{"id": i, "name": "search", "arguments": args}] * 6 + [{"id": i, "name": "fly", "arguments": {}}, {"name": "search"}, {"id": i}, {"id": i, "name": "fetch", "arguments": {"url": link}}])
                text += rng.choice([f"<tool_call>{json.dumps(call)}</tool_call>"] * 8 + ['<tool_call>{"id": "broken", "x</tool_call>', "<tool_call>never closed"])
                if rng.random() < 0.6:
                    text += rng.choice([f'<tool_result>{json.dumps({"id": f"c{rng.randrange(7)}", "content": {"b": 1, "a": "é"}})}</tool_result>'] * 5 + ["<tool_result>oops</tool_result>"])
            rows.append((conv, turn, "assistant", text))
    out = C.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), Store(spark, "t")).where("kind <> 'message'").collect()
    got = sorted(((r.conv_id, r.turn, r.part, r.kind, r.order_turn, r.step, r.call_id, r.status, json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"))) for r in out), key=str)
    assert got == slow(rows)
    assert {x[7] for x in got} >= {"ok", "malformed", "duplicate", "unknown_tool", "bad_arguments", "bad_reference", "cyclic", "unanswered", "orphan"}


def test_order_is_topological(spark):
    call = lambda i, q: f'<tool_call>{json.dumps({"id": i, "name": "search", "arguments": {"query": q}})}</tool_call>'
    result = lambda i: f'<tool_result>{json.dumps({"id": i, "content": 0})}</tool_result>'
    rows = [(1, 0, "a", call("z", "$y")), (1, 1, "a", call("y", "$x") + result("z")), (1, 2, "a", call("x", "q")), (1, 3, "t", result("x")), (1, 4, "t", result("y"))]
    out = C.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), Store(spark, "t")).where("kind <> 'message'").collect()
    order = [(r.kind, r.call_id) for r in sorted(out, key=lambda r: (r.order_turn, r.step, r.rank, r.turn, r.part))]
    assert order == [("call", "x"), ("result", "x"), ("call", "y"), ("result", "y"), ("call", "z"), ("result", "z")]
    assert {r.status for r in out} == {"ok"}


def test_what_cannot_be_parsed_is_kept(spark):
    out = C.formatted(spark.createDataFrame([(1, 0, "a", 'x <tool_call>{"id": 1,</tool_call>')], "conv_id long, turn long, role string, text string"), Store(spark, "t")).where("kind = 'call'").collect()
    assert [(r.status, json.loads(r.json)) for r in out] == [("malformed", {"raw": '{"id": 1,'})]


def test_empty_table(spark):
    assert C.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string, rank int"), Store(spark, "t")).count() == 0
