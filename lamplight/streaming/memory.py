"""The memory of conversations on a stream: the last turns of each, kept as state and upserted into a table in parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lamplight.streaming.parts import PARTS, read_parts, upsert_parts

#: A conversation's memory: its turns in order, and how many changes it has seen.
MEMORY = "conv_id long, seen long, turns array<long>, roles array<string>, texts array<string>"


def remembered(turns: DataFrame, n: int, forget_after: str | None = None) -> DataFrame:
    """A stream of turns (conv_id, turn, role, text) to a row (MEMORY) for each conversation that a batch changes: its last ``n`` turns.

    A turn that comes late takes its place by its number if that is among the last ``n``, else it changes nothing. A turn that comes again replaces what was
    there; of several in one batch the one with the greatest text stays. Turns without a conversation or a number are left out.
    A conversation without a turn for ``forget_after`` (a duration such as "1 hour", of processing time) is
    forgotten: one row with empty lists tells so, and later turns begin anew. Only ``n`` turns of a conversation are ever held.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if forget_after else GroupStateTimeout.NoTimeout
    rows = turns.where("conv_id is not null and turn is not null").select("conv_id", "turn", "role", "text")
    return rows.groupBy("conv_id").applyInPandasWithState(updater(n, _milliseconds(forget_after)), MEMORY, MEMORY.replace("conv_id long, ", ""), "update", timeout)


def updater(n: int, wait: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The update of a conversation's state by a batch; ``wait`` is the time in ms after which it is forgotten, 0 for never."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, *kept = state.get if state.exists else (0, [], [], [])
        if state.hasTimedOut:
            state.remove()
            yield _row(key[0], seen + 1, [])
            return
        held = {t: (r, x) for t, r, x in zip(*kept, strict=True)}
        came: dict[int, tuple] = {}
        for part in batches:
            for turn, role, text in zip(part["turn"].tolist(), part["role"].tolist(), part["text"].tolist()):
                now = (role, text)
                if turn not in came or (text or "") > (came[turn][1] or ""):
                    came[turn] = now
            # never more than n of a batch, however many turns it has
            came = {t: came[t] for t in sorted(came)[-n:]} if n else {}
        held |= came
        last = [(t, *held[t]) for t in sorted(held)[-n:]] if n else []
        state.update((seen + 1, *([x[k] for x in last] for k in range(3))))
        if wait:
            state.setTimeoutDuration(wait)
        yield _row(key[0], seen + 1, last)

    return update


def _row(conv_id: int, seen: int, last: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({"conv_id": [conv_id], "seen": [seen], "turns": [[x[0] for x in last]], "roles": [[x[1] for x in last]], "texts": [[x[2] for x in last]]})


def _milliseconds(duration: str | None) -> int:
    return int(pd.Timedelta(duration).total_seconds() * 1000) if duration else 0


def remember(turns: DataFrame, n: int, path: str, checkpoint: str, forget_after: str | None = None, parts: int = PARTS) -> StreamingQuery:
    """Start the query: the table at ``path`` follows the state. A batch that is run again after a restart changes nothing."""

    def put(batch: DataFrame, batch_id: int) -> None:
        upsert_parts(batch.sparkSession, path, batch, ["conv_id"], [F.col("seen")], f"memory-{batch_id}", parts)

    return remembered(turns, n, forget_after).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def memory(spark: SparkSession, path: str) -> DataFrame:
    """The remembered turns (conv_id, turn, role, text) of a table that ``remember`` keeps."""
    held = read_parts(spark, path)
    if held is None:
        return spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    return held.select("conv_id", F.explode(F.arrays_zip("turns", "roles", "texts")).alias("x")).select("conv_id", F.col("x.turns").alias("turn"), F.col("x.roles").alias("role"), F.col("x.texts").alias("text"))
