"""Role repair against plain search, and rendering."""

import random
import re
from collections import defaultdict
from functools import cache

from pyspark.sql import functions as F

from quillon.llm import chat
from quillon.llm.scratch import table

ROLES = ["user", "assistant", "system", "tool", None, "Human "]


def cheapest(roles):
    """The least cost by memoised search over whole conversations."""
    s, names = chat.Settings(), dict(chat.Settings().aliases)
    legal = {"start": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]}
    rs = [names.get(r, r) for r in ((r or "").strip().lower() for r in roles)]

    @cache
    def go(i, state, inserted):
        if inserted > 3:
            return float("inf")
        best = 0.0 if i == len(rs) and state == "assistant" else float("inf")
        for r in legal[state]:
            best = min(best, s.insert + go(i, r, inserted + 1))
        if i < len(rs):
            for r in ("system", "user", "assistant"):
                label = 0 if rs[i] == r else s.relabel if rs[i] in ("system", "user", "assistant") else s.relabel_other
                if r in legal[state]:
                    best = min(best, label + go(i + 1, r, 0))
                if r == state:
                    best = min(best, label + s.merge + go(i + 1, state, 0))
        return best

    return go(0, "start", 0)


def cost(rows):
    s, total = chat.Settings(), 0.0
    for r in rows:
        known = (r.role or "").strip().lower() in ("system", "user", "assistant", "human")
        total += s.insert * r.inserted + s.merge * ("merge" in r.action) + ("relabel" in r.action) * (s.relabel if known else s.relabel_other)
    return total


def test_least_cost_in_any_blocks(spark):
    rng = random.Random(5)
    data = [(c, t, rng.choice(ROLES), f"c{c}t{t}") for c in range(25) for t in range(rng.randrange(1, 6))]
    data += [(77, t, rng.choice(ROLES), f"hot{t}") for t in range(90)] + [(None, None, rng.choice(ROLES), None) for _ in range(3)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("clash")).withColumn("at", F.lit("clash"))
    roles = defaultdict(list)
    for c, _, r, _ in sorted(data, key=lambda x: (x[0] is None, x[0] or 0, x[1] or 0)):
        roles[c].append(r)
    for settings, parts in ((chat.Settings(block=4), 7), (chat.Settings(), 1)):
        got = defaultdict(list)
        for r in chat.format_chats(df, settings=settings, parts=parts).collect():
            got[r.conv_id].append(r)
        assert sum(map(len, got.values())) == len(data)
        for c, rows in got.items():
            rows.sort(key=lambda r: r["at"])
            if c is not None:
                assert cost(rows) == cheapest(tuple(roles[c])) and [r.turn for r in rows] == [*range(len(rows))]
            text = "".join(r.rendered for r in rows)
            order = re.findall(r"<\|im_start\|>(\w+)\n", text)
            assert text.count("<|im_end|>") == len(order) and re.fullmatch("s?(ua)+", "".join(x[0] for x in order))


def test_clean_conversations_stay(spark):
    df = spark.createDataFrame([(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 3, "user", "bye"), (1, 4, "assistant", "ciao")], "conv_id int, turn int, role string, text string")
    got = sorted(chat.format_chats(df).collect(), key=lambda r: r.turn)
    assert {r.action for r in got} == {"keep"} and not any(r.inserted for r in got)
    assert "".join(r.rendered for r in got) == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\nbye<|im_end|>\n<|im_start|>assistant\nciao<|im_end|>\n"
    assert dict(chat.format_chats(df).dtypes)["conv_id"] == "int"


def test_table_and_empty(spark):
    df = table(spark, "/root/testdata/sf0.001", "conversations")
    assert chat.format_chats(df).count() == df.count()
    assert chat.format_chats(df.limit(0)).count() == 0
    twice = df.union(df)
    assert chat.format_chats(twice).count() == twice.count()  # repeated rows are turns of their own
