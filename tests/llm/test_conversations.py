import datetime as dt
import random
import re

import pytest

from sillar.llm.conversations import dropped_chats, rebuild_conversations

SCHEMA = "message_id long, chat_id string, role string, content string, sources string, images string, search_query string, created_at timestamp, run string, who string"
CHATS = "chat_id string, title string, created_at timestamp, updated_at timestamp, summary string, summary_upto long"
T = dt.datetime(2025, 1, 1)


def row(i, chat, role, content, second):
    return (i, chat, role, content, None, None, None, None if second is None else T + dt.timedelta(seconds=second), "clash", "clash")


def run(spark, rows, chats=()):
    m = spark.createDataFrame(rows, SCHEMA)
    c = spark.createDataFrame([(x, None, None, None, None, None) for x in chats], CHATS)
    return sorted(r.chat_id for r in dropped_chats(m, c).collect())


@pytest.mark.parametrize(
    ("rows", "kept"),
    [
        ([("user", "q", 1), ("assistant", "a", 2)], True),
        ([(" Usuario", "q", 1), ("BOT", "a", 2), ("System", "aviso", 3), ("tool", None, None)], True),
        ([("user", "q", 1)], False),
        ([("assistant", "a", 1), ("user", "q", 2)], False),
        ([("user", "q", 1), ("user", "q2", 2), ("assistant", "a", 3)], False),
        ([("user", "q", 1), ("assistant", "[1] …", 2)], False),
        ([("user", "q", 1), ("assistant", None, 2)], False),
        ([("user", "q", 1), ("?", "a", 2)], False),
        ([("user", "q", 1), (None, "a", 2)], False),
        ([("user", "q", None), ("assistant", "a", 2)], False),
        ([("assistant", "a", 2), ("user", "q", 1)], True),
        ([("user", "q", 1), ("assistant", "a", 1)], True),
        ([("user", "q", 1), ("user", "q", 1), ("assistant", "a", 2)], True),
        ([("user", "q", 1), ("User", "q", 1), ("assistant", "a", 2)], False),
        ([("sistema", "aviso", 1)], False),
        ([("user", "[[x]] 1", 1), ("assistant", "a", 2)], True),
    ],
)
def test_rules(spark, rows, kept):
    made = [row(i, "c", *r) for i, r in enumerate(rows)]
    assert run(spark, made) == ([] if kept else ["c"])


def test_chats_without_messages_and_null_ids(spark):
    assert run(spark, [row(1, None, "user", "q", 1)], ["a", None]) == ["a"]
    assert run(spark, [], []) == []


def _brute(rows):
    keep, seen = {}, {}
    for r in sorted(rows, key=lambda r: r[0]):
        if r[1] is not None:
            seen.setdefault((r[1], r[2], r[3], r[7]), r)
    for chat in {k[0] for k in seen}:
        mine = [r for k, r in seen.items() if k[0] == chat and (k[1] or "") not in ("system",)]
        ok = bool(mine) and all(r[7] is not None and r[2] in ("user", "assistant") and any(c.isalnum() for c in re.sub(r"\[[^\[\]]*\]", "", r[3] or "")) for r in mine)
        if ok:
            mine.sort(key=lambda r: (r[7], r[0]))
            keep[chat] = len(mine) % 2 == 0 and all(r[2] == ("user", "assistant")[i % 2] for i, r in enumerate(mine))
        else:
            keep[chat] = False
    return keep


def test_against_brute_force_with_a_hot_chat(spark):
    rng = random.Random(5)
    rows, n = [], 0
    for chat, size in [("hot", 240), *((f"c{i}", rng.randrange(1, 12)) for i in range(60))]:
        for i in range(size):
            n += 1
            role = ("user", "assistant")[i % 2] if chat == "hot" or rng.random() > 0.05 else rng.choice(["user", "system", None])
            rows.append(row(n, chat, role, f"m{i}", i // 2 * 2 if rng.random() > 0.2 else i))
    rng.shuffle(rows)
    want = _brute(rows)
    assert run(spark, rows) == sorted(c for c, k in want.items() if not k)
    out = rebuild_conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.chat_id for r in out} == {c for c, k in want.items() if k}
    for chat in {r.chat_id for r in out}:
        mine = sorted((r for r in out if r.chat_id == chat), key=lambda r: r.turn)
        assert [r.turn for r in mine] == list(range(len(mine)))
        assert [(r.created_at, r.message_id) for r in mine] == sorted((r.created_at, r.message_id) for r in mine)


def test_sessions_split_at_gaps(spark):
    rows = []
    for i in range(300):
        rows.append(row(i, "c", ("user", "assistant")[i % 2], f"m{i}", i * 10))
    rows += [row(1000 + i, "c", ("user", "assistant")[i % 2], f"n{i}", 900_000 + i * 10) for i in range(3)]
    out = rebuild_conversations(spark.createDataFrame(rows, SCHEMA), split_at_gaps=True).collect()
    assert len(out) == 300 and {r.session for r in out} == {0}
    assert rebuild_conversations(spark.createDataFrame(rows, SCHEMA)).count() == 0
