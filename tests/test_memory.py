"""The memory of conversations on a stream."""

import random

import pandas as pd

from lamplight.operators.store import turns_in_memory
from lamplight.streaming import ingest, memory

KIND = "conv_id long, turn long, role string, text string"


def run(spark, tmp_path, n=3, **how):
    stream = ingest.chat_stream(spark, f"{tmp_path}/in")
    memory.remember(stream, n, f"{tmp_path}/out", f"{tmp_path}/ck", parts=4, **how).awaitTermination(120)
    return sorted(map(tuple, memory.memory(spark, f"{tmp_path}/out").collect()))


def test_state_equals_the_window_also_after_restarts(spark, tmp_path):
    """Turns come in any order over several runs of the query; its table is the window over all that came."""
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "model"]), f"text {c} {t}") for c in range(12) for t in range(rng.randint(1, 9))] + [(None, 1, "user", "x"), (3, None, "user", "y"), (20, 5, None, "z")]
    rng.shuffle(rows)
    came = []
    for k in range(3):
        part = rows[k::3]
        came += part
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        want = turns_in_memory(spark.createDataFrame(came, KIND).where("conv_id is not null and turn is not null"), 3)
        assert run(spark, tmp_path) == sorted(map(tuple, want.select("conv_id", "turn", "role", "text").collect()))
    before = run(spark, tmp_path)
    assert run(spark, tmp_path) == before


def test_late_and_repeated_turns(spark, tmp_path):
    put = lambda rows: spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put([(1, 5, "user", "five"), (1, 9, "user", "nine"), (1, 7, "user", "seven")])
    assert run(spark, tmp_path, 2) == [(1, 7, "user", "seven"), (1, 9, "user", "nine")]
    put([(1, 6, "user", "too late"), (1, 8, "model", "late"), (1, 9, "user", "again"), (1, 9, "user", "again and")])
    assert run(spark, tmp_path, 2) == [(1, 8, "model", "late"), (1, 9, "user", "again and")]


class State:
    """A conversation's state as Spark hands it to the update."""

    def __init__(self):
        self.held, self.hasTimedOut, self.waits = None, False, None

    exists = property(lambda self: self.held is not None)
    get = property(lambda self: self.held)

    def update(self, held):
        self.held = held

    def remove(self):
        self.held = None

    def setTimeoutDuration(self, ms):
        self.waits = ms


def test_forgetting():
    """A conversation that timed out is told as empty, and begins anew."""
    update, state = memory.updater(2, memory._milliseconds("90 seconds")), State()
    batch = lambda *turns: iter([pd.DataFrame({"turn": turns, "role": "user", "text": [f"t{t}" for t in turns]})])
    (row,) = update((4,), batch(1, 3, 2), state)
    assert row["turns"].tolist() == [[2, 3]] and row["texts"].tolist() == [["t2", "t3"]] and state.waits == 90_000
    state.hasTimedOut = True
    (row,) = update((4,), iter([]), state)
    assert row["turns"].tolist() == [[]] and row["seen"].tolist() == [2] and not state.exists
    state.hasTimedOut = False
    (row,) = update((4,), batch(1), state)
    assert row["turns"].tolist() == [[1]] and memory._milliseconds(None) == 0
