"""Budgets and admission of tool calls (turn_id, seq, name, class, signature)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Calls of each class in a turn, and in all of a turn (fixed values).
CLASS_BUDGETS = {"orient": 5, "explore": 10, "write": 2, "maintenance": 3}
HARD_CAP = sum(CLASS_BUDGETS.values()) + 4


#: The class of each tool (fixed values).
TOOL_CLASSES = {
    "list_knowledge": "orient", "folder_tree": "orient", "graph_stats": "orient", "read_knowledge": "explore", "read_knowledge_section": "explore", "search_knowledge": "explore", "graph_neighbors": "explore",
    "graph_traverse": "explore", "graph_search": "explore", "describe_node": "explore", "search_conversations": "explore", "read_conversation": "explore", "save_knowledge": "write", "compile_knowledge": "write", "lint_knowledge": "maintenance",
}


@dataclass
class Budget:
    """The budget of one answer: loads, room and the model's window."""

    loads: int = 0
    available: int = 999_999
    window: int = 32_000
    used: int = 0
    most_loads: int = 15
    share: float = 0.5

    def reset(self) -> None:
        self.loads, self.available, self.used = 0, 999_999, 0

    def set_available(self, tokens: int) -> None:
        self.available = max(0, int(tokens))

    def set_window(self, tokens: int) -> None:
        self.window = max(1024, int(tokens))

    def charge(self, tokens: int) -> None:
        self.loads, self.used, self.available = self.loads + 1, self.used + tokens, max(0, self.available - tokens)

    def state(self) -> dict:
        return {"kb_loads": self.loads, "kb_loads_max": self.most_loads, "available_tokens": self.available, "context_window": self.window, "tool_tokens_used": self.used, "tool_token_cap": int(self.window * self.share)}


def class_counts(calls: DataFrame, budgets: dict[str, int] | None = None) -> DataFrame:
    """turn_id, class, n, exceeded: calls of each class in a turn, and whether they are more than its budget."""
    budget = F.create_map(*[F.lit(x) for kv in (budgets or CLASS_BUDGETS).items() for x in kv])
    return calls.groupBy("turn_id", "class").agg(F.count("*").alias("n")).withColumn("exceeded", F.col("n") > F.coalesce(F.try_element_at(budget, F.col("class")), F.lit(0)))


def class_of(name, classes: dict[str, str]):
    """A tool's class; unknown tools explore."""
    known = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])
    return F.coalesce(F.try_element_at(known, name), F.lit("explore"))


def duplicate_calls(calls: DataFrame) -> DataFrame:
    """Calls with whether an equal one came before in the turn."""
    w = Window.partitionBy("turn_id", "signature").orderBy("seq")
    return calls.withColumn("duplicate", F.row_number().over(w) > 1)


class Admission:
    """One turn's state; ``decide`` takes its calls in order."""

    def __init__(self, budgets: dict[str, int], hard_cap: int):
        self.budgets, self.hard_cap = budgets, hard_cap
        self.used: dict[str, int] = {}
        self.seen: set[str] = set()
        self.total = 0

    def decide(self, cls: str, signature: str) -> str:
        if self.total >= self.hard_cap:
            return "STOPPED"
        if self.used.get(cls, 0) >= self.budgets.get(cls, self.budgets.get("explore", 0)):
            return "REFUSED"
        if signature in self.seen:
            return "SKIPPED"
        self.seen.add(signature)
        self.used[cls] = self.used.get(cls, 0) + 1
        self.total += 1
        return "EXECUTED"


def admit(calls: DataFrame, budgets: dict[str, int] | None = None, hard_cap: int = HARD_CAP) -> DataFrame:
    """Every call's decision, in order within its turn: stopped beyond the hard cap, refused beyond its class's
    budget, skipped if an equal one was executed; only executed calls are charged.

    Calls are streamed in order, so a task holds the state of one turn (bounded by the hard cap), not its calls."""
    budgets = budgets or CLASS_BUDGETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, state = None, None
        for batch in batches:
            turns, seqs, classes, signatures = (c.to_pylist() for c in batch.columns)
            out = []
            for t, c, s in zip(turns, classes, signatures):
                if state is None or t != turn:
                    turn, state = t, Admission(budgets, hard_cap)
                out.append(state.decide(c, s))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], ["turn_id", "seq", "class", "signature", "decision"])

    own = calls.select(F.col("turn_id").cast("string"), F.col("seq").cast("long"), F.col("class").cast("string"), F.col("signature").cast("string"))
    return own.repartition("turn_id").sortWithinPartitions("turn_id", "seq").mapInArrow(run, "turn_id string, seq long, class string, signature string, decision string")


def load_gate(loads: DataFrame, most: int = 15, least_available: int = 8000, window: int = 32_000, share: float = 0.5) -> DataFrame:
    """Loads (turn_id, seq, tokens, available) with the first gate they fail, if any."""
    w = Window.partitionBy("turn_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before, used = F.count("*").over(w), F.coalesce(F.sum("tokens").over(w), F.lit(0))
    gate = F.when(before >= most, "too many loads").when(F.col("available") < least_available, "too little room").when(used >= share * window, "half the window is used").otherwise("ok")
    return loads.withColumn("gate", gate)


def frame_results(results: DataFrame, caps: dict[str, int], default: int = 8000) -> DataFrame:
    """Results (tool, text, executed) as COMPLETE, TRUNCATED at the tool's cap, or NOT_EXECUTED."""
    own = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]) if caps else None
    cap = F.coalesce(F.try_element_at(own, F.col("tool")), F.lit(default)) if caps else F.lit(default)
    state = F.when(~F.col("executed"), "NOT_EXECUTED").when(F.length("text") > cap, "TRUNCATED").otherwise("COMPLETE")
    return results.withColumn("frame", state).withColumn("delivered", F.when(F.col("frame") == "NOT_EXECUTED", "").otherwise(F.left("text", cap)))


def context_window(model, windows: dict[str, int], default: int = 32_000):
    """A model's context window: by its name, else by what stands before its first colon or hyphen, else the default."""
    known = F.create_map(*[F.lit(x) for kv in windows.items() for x in kv])
    family = F.regexp_extract(model, "^[^:-]*", 0)
    return F.coalesce(F.try_element_at(known, model), F.try_element_at(known, family), F.lit(default))
