"""Chat formatting: minimum-cost repair of the roles of a conversation, then rendering.

Legal conversations are an optional system turn, then user and assistant in turn, ending with the
assistant. A turn may keep its role, take another one, or be merged into the turn before it, and empty
turns may be inserted; each costs something, and dynamic programming over the automaton of legal turns
finds the cheapest repair. Nothing is dropped.

Costs of a stretch of turns are a states x states matrix, and stretches join by the (min, +) product. So
rows are sorted by range into blocks of bounded size whatever conversations they belong to: each block
gives the matrix of its first and last conversation, states at block borders come from products over
blocks (in levels, so that no task gets more than a block of them), and each block is then solved and
rendered alone. A conversation with a third of all rows is spread over as many tasks as its rows need.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.scratch import cut

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = (None, "system", "user", "assistant")
#: state -> states that a new turn may lead to
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
OTHER = 0  # the class of a role that is none of ROLES


@dataclass(frozen=True)
class Settings:
    relabel: float = 2.0  # another role than the turn's own
    relabel_other: float = 1.0  # a role for a turn that has none of the known ones
    merge: float = 1.0
    insert: float = 3.0
    block: int = 4096  # rows that one group holds at most
    block_bytes: int = 16 << 20  # of text, from which on a group takes no further row
    aliases: tuple[tuple[str, str], ...] = (("human", "user"), ("prompter", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))


class Automaton:
    """Costs and choices of each step, for each class of role."""

    def __init__(self, s: Settings):
        self.s = s
        self.fill: dict[tuple[int, int], tuple[int, ...]] = {}  # inserted turns that lead from a state to another
        for a in range(4):
            ways = {a: ()}
            edge = [a]
            while edge:
                edge = [b for x in edge for b in LEGAL[x] if b not in ways and not ways.update({b: (*ways[x], b)})]
            self.fill |= {(a, b): w for b, w in ways.items()}
        self.cost = np.full((4, 4, 4), np.inf)  # [class, before, after]
        self.choice: dict[tuple[int, int, int], tuple[tuple[int, ...], int, bool]] = {}  # -> inserted, role, merged
        for role in range(4):
            for a in range(4):
                for b in (SYSTEM, USER, ASSISTANT):
                    label = 0.0 if role == b else s.relabel_other if role == OTHER else s.relabel
                    ways = [(label + s.merge, (), True)] if a == b else []
                    ways += [(label + s.insert * len(w), w, False) for c in range(4) if b in LEGAL[c] and (w := self.fill.get((a, c))) is not None]
                    if ways:
                        best = min(ways, key=lambda x: (x[0], len(x[1]), x[2]))
                        self.cost[role, a, b], self.choice[role, a, b] = best[0], (best[1], b, best[2])
        self.end = np.array([s.insert * len(self.fill[a, ASSISTANT]) for a in range(4)])

    def classes(self, roles: pd.Series) -> np.ndarray:
        names = dict(self.s.aliases)
        known = {r: i for i, r in enumerate(ROLES) if r}
        return np.array([known.get(names.get(r, r), OTHER) for r in ("" if r is None or r != r else str(r).strip().lower() for r in roles)], np.int8)

    def product(self, steps: list[np.ndarray]) -> np.ndarray:
        out = np.where(np.eye(4, dtype=bool), 0.0, np.inf)
        for m in steps:
            out = (out[:, :, None] + m[None]).min(1)
        return out

    def path(self, steps: list[np.ndarray], start: int, end: int | None) -> list[int]:
        """The states after each step of the cheapest way from start to end (None: to any, with what ending there costs)."""
        worth, back = np.where(np.arange(4) == start, 0.0, np.inf), []
        for m in steps:
            ways = worth[:, None] + m
            back.append(ways.argmin(0))
            worth = ways.min(0)
        at = int((worth + self.end).argmin()) if end is None else end
        out = []
        for b in back[::-1]:
            out.append(at)
            at = int(b[at])
        return out[::-1]


def opened(state: int) -> str:
    return f"<|im_start|>{ROLES[state]}\n"


CLOSED = "<|im_end|>\n"


def runs(ids: pd.Series) -> list[tuple[int, int]]:
    """Bounds of the stretches of equal ids (nulls are equal)."""
    same = (ids.eq(ids.shift()) | (ids.isna() & ids.shift().isna())).to_numpy(bool, na_value=False)
    same[0] = False
    at = [*np.flatnonzero(~same), len(ids)]
    return [*zip(at[:-1], at[1:])]


def border_states(segments: DataFrame, s: Settings, shift: int, given: bool) -> DataFrame:
    """start and end of each segment (conv_id, seq, matrix), from those of its conversation.

    given: segments has the columns start and end of the first and last segment of the group that seq >> shift names;
    else they are solved for whole conversations."""
    auto = Automaton(s)
    key = ["conv_id"] + (["up"] if given else [])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        steps = [np.array(m).reshape(4, 4) for m in pdf["matrix"]]
        first = int(pdf["start"].iloc[0]) if given else START
        states = auto.path(steps, first, int(pdf["end"].iloc[0]) if given else None)
        more = [True] * (len(states) - 1) + [bool(pdf["more"].iloc[0]) if given else False]
        return pd.DataFrame({"conv_id": pdf["conv_id"], "seq": pdf["seq"], "start": [first, *states[:-1]], "end": states, "more": more})

    rows = segments.withColumn("up", F.shiftright("seq", shift)) if given else segments
    return rows.groupBy(*key).applyInPandas(solve, "conv_id string, seq long, start int, end int, more boolean")


def levels(segments: DataFrame, s: Settings, bits: int) -> DataFrame:
    """start, end and more of each segment; groups of at most 2**bits segments are joined first, while a conversation has more."""
    most = segments.groupBy("conv_id").count().agg(F.max("count").alias("n")).first().n or 0
    if most <= 1 << bits:
        return border_states(segments, s, 0, False)
    auto = Automaton(s)

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        m = auto.product([np.array(x).reshape(4, 4) for x in pdf["matrix"]])
        return pd.DataFrame({"conv_id": pdf["conv_id"][:1], "seq": pdf["seq"][:1].to_numpy() >> bits, "matrix": [m.ravel().tolist()]})

    upper = segments.withColumn("up", F.shiftright("seq", bits)).groupBy("conv_id", "up").applyInPandas(joined, "conv_id string, seq long, matrix array<double>")
    above = levels(cut(upper, "chat-level"), s, bits).select(F.col("conv_id").alias("c"), F.col("seq").alias("u"), "start", "end", "more")
    each = segments.join(above, F.col("conv_id").eqNullSafe(F.col("c")) & (F.shiftright("seq", bits) == F.col("u"))).drop("c", "u")
    return border_states(each, s, bits, True)


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", settings: Settings = Settings(), parts: int | None = None) -> DataFrame:
    """One row per row of turns: conv_id, turn, role, role_out, action, inserted, rendered and at.

    at: ascends along each conversation.
    Turns of a conversation are ordered by turn (nulls last), ties by role and text; repeated rows are
    turns of their own. action: keep, relabel, merge or relabel+merge. inserted: the empty turns inserted
    before this one, and at the conversation's end after it. rendered: this turn's part of the rendered
    conversation; the parts in order are the whole. Null ids are one conversation; null and unknown roles
    get the role that fits; null text is empty. An empty table gives no rows. parts: of the range
    partitioning (else Spark's setting). Columns not named do not matter."""
    s, auto = settings, Automaton(settings)
    bits = max(1, s.block.bit_length() - 1)
    plain = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.xxhash64("text"), F.col("tie")]
    n = parts or int(plain.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = plain.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    kind, turn_kind = (plain.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    place = ranged.select(F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text").withColumn("at", F.monotonically_increasing_id())  # as strings: pandas has no null integers

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, n, size = TaskContext.get().partitionId() << 33, 0, 0  # no partition holds 2**33 rows, so seq never spans two
        for b in batches:
            told = []
            for more in pc.binary_length(b.column("text")).to_pylist():
                if n == s.block or size >= s.block_bytes:
                    seq, n, size = seq + 1, 0, 0
                told.append(seq)
                n, size = n + 1, size + more
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(told, pa.int64())], names=[*b.schema.names, "seq"])

    rows = cut(place.mapInArrow(grouped, "conv_id string, turn string, role string, text string, at long, seq long"), "turns")

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        found = runs(pdf["conv_id"])
        out = []
        for a, b in dict.fromkeys((found[0], found[-1])):
            m = auto.product([auto.cost[c] for c in auto.classes(pdf["role"][a:b])])
            out.append((pdf["conv_id"].iloc[a], pdf["seq"].iloc[a], m.ravel().tolist()))
        return pd.DataFrame(out, columns=["conv_id", "seq", "matrix"])

    segments = cut(rows.select("conv_id", "role", "at", "seq").groupBy("seq").applyInPandas(ends, "conv_id string, seq long, matrix array<double>"), "chat-ends")
    states = cut(levels(segments, s, bits), "chat-states")

    def render(pdf: pd.DataFrame, border: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at").reset_index(drop=True)
        known = {None if c != c else c: (int(a), int(e), bool(more)) for c, a, e, more in zip(border["conv_id"], border["start"], border["end"], border["more"])}
        classes = auto.classes(pdf["role"])
        role_out, action, inserted, rendered = [], [], [], []
        for a, b in runs(pdf["conv_id"]):
            c = pdf["conv_id"].iloc[a]
            start, end, more = known.get(None if c != c else c, (START, None, False))
            before = start
            for role, text, after in zip(classes[a:b], pdf["text"][a:b], auto.path([auto.cost[c] for c in classes[a:b]], start, end)):
                fill, _, merged = auto.choice[int(role), before, after]
                action.append("+".join(["relabel"] * int(role != after) + ["merge"] * merged) or "keep")
                part = "\n" if merged else CLOSED * (before != START) + "".join(opened(x) + CLOSED for x in fill) + opened(after)
                role_out.append(ROLES[after])
                inserted.append(len(fill))
                rendered.append(part + text)
                before = after
            if not more:
                tail = auto.fill[before, ASSISTANT]
                inserted[-1] += len(tail)
                rendered[-1] += CLOSED + "".join(opened(x) + CLOSED for x in tail)
        return pd.DataFrame({"conv_id": pdf["conv_id"], "turn": pdf["turn"], "role": pdf["role"], "role_out": role_out, "action": action, "inserted": inserted, "rendered": rendered, "at": pdf["at"]})

    schema = "conv_id string, turn string, role string, role_out string, action string, inserted int, rendered string, at long"
    done = rows.groupBy("seq").cogroup(states.groupBy("seq")).applyInPandas(render, schema)
    return done.withColumn("conv_id", F.col("conv_id").cast(kind)).withColumn("turn", F.col("turn").cast(turn_kind))
