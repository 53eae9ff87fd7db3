"""The chat query over a whole table against plain Python."""

import json

from foldspark.llm import chat_calls, chat_format
from foldspark.llm.queries import op8_chat_format

SF = "/root/testdata/sf0.001"


def kind_of(value):
    kinds = {bool: "boolean", int: "integer", float: "number", str: "string", dict: "object", list: "array"}
    return kinds.get(type(value))


def argument_errors(name, arguments):
    schema = chat_format.SCHEMAS.get(name)
    if schema is None:
        return ["unknown tool"]
    if not isinstance(arguments, dict):
        return ["arguments: not an object"]
    out = []
    for arg, (kind, required) in sorted(schema.items()):
        if arguments.get(arg) is None:
            out += [f"{arg}: missing"] * required
        elif kind_of(arguments[arg]) != kind and not (kind == "number" and kind_of(arguments[arg]) == "integer"):
            out.append(f"{arg}: not a {kind}")
    return out + [f"{k}: unknown" for k in arguments if k not in schema]


def levels_of(first):
    """Highest number of calls before each call; those in or behind a cycle have none."""
    level = {}
    while True:
        new = {}
        for c, after in first.items():
            known = [a for a in set(after) if a in first]
            if c not in level and all(a in level for a in known):
                new[c] = max((level[a] + 1 for a in known), default=0)
        if not new:
            return level
        level |= new


def by_hand(rows):
    chats = {}
    for conv, turn, role, text in rows:
        chats.setdefault(conv, []).append((turn, role, text, json.loads(text) if role in ("assistant", "tool") and text.startswith("{") else {}))
    out = []
    canonical = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    for conv, messages in chats.items():
        calls, results = {}, {}
        for turn, _, _, data in sorted(messages, key=lambda m: m[0]):
            for c in data.get("tool_calls", []):
                calls.setdefault(c["id"], []).append((turn, c["after"]))
            if "tool_call_id" in data:
                results[data["tool_call_id"]] = results.get(data["tool_call_id"], 0) + 1
        level = levels_of({c: found[0][1] for c, found in calls.items()})
        for turn, role, text, data in messages:
            if "tool_calls" in data:
                (c,) = data["tool_calls"]
                told = [f"{c['id']}: {e}" for e in argument_errors(c["name"], c["arguments"])]
                told += [f"{c['id']}: repeated identifier"] * (len(calls[c["id"]]) > 1) + [f"{c['id']}: no result"] * (c["id"] not in results) + [f"{c['id']}: cycle"] * (c["id"] not in level)
                message = {"content": None, "role": role, "tool_calls": data["tool_calls"]}
                out.append((conv, turn, turn, level.get(c["id"], chat_format.NO_LEVEL), 1, role, 1, c["id"] in results, sorted(told), canonical(message)))
            elif "tool_call_id" in data:
                of = data["tool_call_id"]
                at = calls[of][0][0] if of in calls else None
                place = (turn, 0) if at is None or at < turn else (at, level.get(of, 0))
                out.append((conv, turn, *place, 2, role, 0, at is not None, [] if at is not None else [f"{of}: no call"], canonical({"content": data["content"], "role": role, "tool_call_id": of})))
            else:
                out.append((conv, turn, turn, 0, 0, role, 0, None, [], canonical({"content": text, "role": role})))
    return out


def test_chat_query_equals_plain_python(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    derived = [tuple(r) for r in chat_calls.with_calls(table).collect()]
    assert len(derived) == table.count() + table.where("role in ('user', 'assistant')").count()
    got = [tuple(r) for r in op8_chat_format(spark, SF).collect()]
    want = by_hand(derived)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    errors = " ".join(e for r in got for e in r[8])
    for kind in ("unknown tool", "missing", "not a integer", ": unknown", "not an object", "repeated identifier", "no result", "no call"):
        assert kind in errors, kind
    assert sum(r[7] is True for r in got) > 20


def test_levels_of_long_chains_cycles_and_diamonds(spark):
    calls = [(1, f"c{k}", [f"c{k - 1}"]) for k in range(1, 200)] + [(1, "c0", [])]
    calls += [(1, "join", ["c150", "c7", "none"]), (1, "tail", ["join"]), (1, "again", ["tail", "c199"])]
    calls += [(2, "a", ["b"]), (2, "b", ["a"]), (2, "d", ["b", "e"]), (2, "e", []), (2, "f", ["d"]), (2, "self", ["self"]), (2, "g", ["e", "e"])]
    calls += [(3, "p", ["q", "r"]), (3, "q", ["p", "r"]), (3, "r", []), (3, "s", ["p"])]
    got = {}
    for r in chat_format._levels(spark.createDataFrame(calls, "conv_id long, call_id string, after array<string>")).collect():
        assert (r.conv_id, r.call_id) not in got
        got[r.conv_id, r.call_id] = r.level
    want = {(conv, c): level for conv in (1, 2, 3) for c, level in levels_of({c: a for k, c, a in calls if k == conv}).items()}
    assert got == want and got[1, "again"] == 200
