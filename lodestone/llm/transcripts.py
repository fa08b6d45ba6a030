"""Chat formatting: roles of transcript turns by a hidden Markov model, and canonical rendering.

States are roles.  A unit is what a speaker says: a row, cut at lines that
begin with a speaker marker.  A unit is observed by its marker, its length,
its number of lines and whether it asks.  Starts, transitions and
observations are counted over all labelled rows; Viterbi finds the roles.

A long conversation is cut into segments of turns.  A segment's best path for
each pair of entering and leaving role is a small matrix; the matrices of a
conversation are chained, and each segment is then decoded between the roles
found at its ends, which gives the path of the whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._spark import materialize

ROLES = ("system", "user", "assistant")
MARKERS = {
    "system": ("system", "instructions"),
    "user": ("user", "human", "customer", "question", "q", "me"),
    "assistant": ("assistant", "ai", "bot", "agent", "answer", "a", "model"),
}
_OF = {word: role for role, words in MARKERS.items() for word in words}
_MARKER = re.compile(r"^[ \t]*(?:#+[ \t]*|\*\*|<\|?|\[)?(" + "|".join(sorted(_OF, key=len, reverse=True)) + r")(?:\|?>|\])?(?:\*\*)?[ \t]*[:>][ \t]*(?:\*\*[ \t]*)?", re.IGNORECASE | re.MULTILINE)
SEGMENT = 256
#: Counts added to what is learned; a marker's own role gets the larger one.
PRIOR, MARKER_PRIOR = 0.5, 2000.0


def units(text: str) -> list[tuple[str, str]]:
    """(marker role or "", words) of each unit of a row; a row without words is one empty unit."""
    cuts = list(_MARKER.finditer(text))
    out = []
    head = text[: cuts[0].start()] if cuts else text
    if not cuts or head.strip():
        out.append(("", head.strip()))
    stops = [*(c.start() for c in cuts), len(text)][1:]
    for m, stop in zip(cuts, stops, strict=True) if cuts else ():
        out.append((_OF[m[1].lower()], text[m.end() : stop].strip()))
    return out


def features(marker: str, words: str) -> tuple[str, ...]:
    """The observation of a unit, as names; each is independent of the others given the role."""
    lines = words.count("\n") + 1
    return (f"marker={marker}", f"chars={min(int(2 * math.log2(len(words) + 1)), 40)}", f"lines={min(lines, 8)}", f"asks={words.rstrip().endswith('?')}")


@dataclass
class Model:
    start: np.ndarray
    step: np.ndarray
    seen: dict[str, np.ndarray]
    unseen: np.ndarray

    def observe(self, marker: str, words: str) -> np.ndarray:
        return sum(self.seen.get(f, self.unseen) for f in features(marker, words))


def viterbi(model: Model, seen: np.ndarray, enter: int | None = None, leave: int | None = None) -> list[int]:
    """The best roles for the observations, after role ``enter`` and with ``leave`` as the last; ties to the earlier role."""
    best = (model.start if enter is None else model.step[enter]) + seen[0]
    back = []
    for row in seen[1:]:
        way = best[:, None] + model.step
        back.append(way.argmax(0))
        best = way.max(0) + row
    path = [int(best.argmax()) if leave is None else leave]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _matrix(model: Model, seen: np.ndarray, first: bool) -> np.ndarray:
    """Best log probability by entering and leaving role; a first segment has the same row for each entering role."""
    best = (np.tile(model.start, (len(ROLES), 1)) if first else model.step) + seen[0]
    for row in seen[1:]:
        best = (best[:, :, None] + model.step[None]).max(1) + row
    return best


def train(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str = "role") -> Model:
    """A model counted over all rows with one of the ROLES; others, and rows without text, are not learned from."""
    rows = turns.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).cast("long").alias("t"), F.col(text_col).cast("string").alias("text"), F.col(role_col).cast("string").alias("r"))
    rows = rows.filter(F.col("r").isin(*ROLES) & F.col("text").isNotNull())

    def observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            role, name = [], []
            for r, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for unit in units(text.as_py()):
                    for f in features(*unit):
                        role.append(r), name.append(f)
            yield pa.RecordBatch.from_arrays([pa.array(role, pa.string()), pa.array(name, pa.string())], names=["r", "f"])

    number = {r: i for i, r in enumerate(ROLES)}
    seen: dict[str, np.ndarray] = {}
    for x in rows.select("r", "text").mapInArrow(observed, "r string, f string").groupBy("r", "f").count().collect():  # a few features
        seen.setdefault(x["f"], np.zeros(len(ROLES)))[number[x["r"]]] = x["count"]
    for r in ROLES:
        seen.setdefault(f"marker={r}", np.zeros(len(ROLES)))[number[r]] += MARKER_PRIOR
    totals: dict[str, np.ndarray] = {}
    for f, n in seen.items():
        totals[f.split("=")[0]] = totals.get(f.split("=")[0], 0) + n + PRIOR
    logs = {f: np.log((n + PRIOR) / totals[f.split("=")[0]]) for f, n in seen.items()}
    # a marker counts by the roles it was seen with, however rare it is with each; its absence says nothing
    for r in ROLES:
        n = seen[f"marker={r}"] + PRIOR
        logs[f"marker={r}"] = np.log(n / n.sum())
    logs["marker="] = np.zeros(len(ROLES))

    said = rows.groupBy("c", "t").agg(F.min("r").alias("r"))
    steps = said.alias("x").join(said.select("c", (F.col("t") + 1).alias("t"), F.col("r").alias("before")), ["c", "t"], "left")
    start, step = np.full(len(ROLES), PRIOR), np.full((len(ROLES), len(ROLES)), PRIOR)
    for x in steps.groupBy("before", "r").count().collect():  # at most 12 rows
        if x["before"] is None:
            start[number[x["r"]]] += x["count"]
        else:
            step[number[x["before"]], number[x["r"]]] += x["count"]
    return Model(np.log(start / start.sum()), np.log(step / step.sum(1, keepdims=True)), logs, np.full(len(ROLES), np.log(PRIOR / 100)))


def render(role: str, words: str) -> str:
    """One turn in canonical form."""
    return f"<|{role}|>\n{words}\n<|end|>\n"


def parse_transcript(text: str, model: Model) -> list[tuple[str, str]]:
    """(role, words) of the units of one raw transcript."""
    found = units(text)
    return [(ROLES[r], words) for r, (_, words) in zip(viterbi(model, np.array([model.observe(*u) for u in found])), found, strict=True)]


def format_chats(turns: DataFrame, model: Model, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """One row per input row: conv_id, turn, roles (array, one for each unit), rendered.

    Rows of a conversation are in order of turn, then text; null turns come
    first.  A null text is an empty unit.  Rows with a null conv_id form one
    conversation.  Equal rows are decoded once and given back as often as they
    occur.  Roles in the input are not read.
    """
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.groupBy("conv_id", "turn", "text").count().withColumn("segment", F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(-1 << 40)))
    rows = materialize(rows, "turns")

    def ordered(group: pa.Table) -> tuple[list[dict], np.ndarray, list[int]]:
        got = sorted(group.to_pylist(), key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["text"]))
        parts = [units(r["text"]) for r in got]
        return got, np.array([model.observe(*u) for p in parts for u in p]), [len(p) for p in parts]

    def matrices(group: pa.Table) -> pa.Table:
        _, seen, _ = ordered(group)
        both = [_matrix(model, seen, first).ravel().tolist() for first in (True, False)]
        return pa.table({"conv_id": group.column("conv_id")[:1], "segment": group.column("segment")[:1], "first": pa.array([both[0]], pa.list_(pa.float64())), "later": pa.array([both[1]], pa.list_(pa.float64()))})

    def chain(group: pa.Table) -> pa.Table:
        got = sorted(group.to_pylist(), key=lambda r: r["segment"])
        best, back = np.array(got[0]["first"]).reshape(len(ROLES), -1)[0], []
        for r in got[1:]:
            way = best[:, None] + np.array(r["later"]).reshape(len(ROLES), -1)
            back.append(way.argmax(0))
            best = way.max(0)
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path.reverse()
        return pa.table({"conv_id": pa.array([r["conv_id"] for r in got], pa.int64()), "segment": pa.array([r["segment"] for r in got], pa.int64()), "enter": pa.array([None, *path[:-1]], pa.int32()), "leave": pa.array(path, pa.int32())})

    def decode(group: pa.Table, ends: pa.Table) -> pa.Table:
        got, seen, sizes = ordered(group)
        path = viterbi(model, seen, ends.column("enter")[0].as_py(), ends.column("leave")[0].as_py())
        roles, text, at = [], [], 0
        for r, n in zip(got, sizes, strict=True):
            own = [ROLES[i] for i in path[at : at + n]]
            roles.append(own)
            text.append("".join(render(role, words) for role, (_, words) in zip(own, units(r["text"]), strict=True)))
            at += n
        return pa.table({"conv_id": pa.array([r["conv_id"] for r in got], pa.int64()), "turn": pa.array([r["turn"] for r in got], pa.int64()), "roles": pa.array(roles, pa.list_(pa.string())), "rendered": pa.array(text, pa.string()), "copies": pa.array([r["count"] for r in got], pa.int64())})

    by = rows.groupBy("conv_id", "segment")
    maps = by.applyInArrow(matrices, "conv_id long, segment long, first array<double>, later array<double>")
    ends = materialize(maps.groupBy("conv_id").applyInArrow(chain, "conv_id long, segment long, enter int, leave int"), "ends")
    out = by.cogroup(ends.groupBy("conv_id", "segment")).applyInArrow(decode, "conv_id long, turn long, roles array<string>, rendered string, copies long")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copy", "copies")
