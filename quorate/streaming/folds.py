"""Folding the event stream into per-case state.

Stage state and drafts are mergeable aggregates and stay native streaming
aggregations (combined on the map side, state in the JVM). Only the panel
barrier, which must speak exactly once, and the timeout watch, which needs
timers, are custom stateful processors.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quorate import fixed_values as fixed
from quorate.functions.confidence import clamp, number_from_text
from quorate.functions.scale import computed_once
from quorate.operators.agreement import agreement_level, score_moments
from quorate.operators.events import (
    DRAFT_PART, draft_parts, latest_registers, register_writes, rounded_scores,
)
from quorate.schemas import EVENT_PAYLOAD
from quorate.streaming.sources import on_batch


def _versioned_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch under its own id; a replayed batch replaces itself."""
    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


def fold_registers(events: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Keep the registers of every case up to date below ``path``."""
    return on_batch(latest_registers(register_writes(events)), _versioned_writer(path),
                    checkpoint, "update", once)


def stored_registers(spark: SparkSession, path: str) -> DataFrame:
    """The registers written so far: the last write over all batches."""
    return latest_registers(spark.read.parquet(path).drop("batch"))


def fold_drafts(tokens: DataFrame, path: str, checkpoint: str, part: int = DRAFT_PART,
                once: bool = True):
    """Keep draft parts up to date below ``path``; a part's state is bounded."""
    return on_batch(draft_parts(tokens, part), _versioned_writer(path), checkpoint,
                    "update", once)


def stored_drafts(spark: SparkSession, path: str) -> DataFrame:
    """Drafts from the newest version of each part."""
    newest = (
        spark.read.parquet(path)
        .groupBy("case_id", "agent_name", "part")
        .agg(F.max_by(F.struct("draft", "tokens"), "batch").alias("v"))
        .select("case_id", "agent_name", "part", "v.draft", "v.tokens")
    )
    ordered = F.sort_array(F.collect_list(F.struct("part", "draft")))
    return newest.groupBy("case_id", "agent_name").agg(
        F.array_join(F.transform(ordered, lambda p: p["draft"]), "").alias("draft"),
        F.sum("tokens").alias("tokens"),
    )


# --- panel barrier -------------------------------------------------------------

_BARRIER_ROW = "case_id BIGINT, seq BIGINT, expected INT, confidence DOUBLE"
_BARRIER_OUT = (
    "case_id BIGINT, expected INT, participating BIGINT, abstained BIGINT, "
    "s1 BIGINT, s2_high BIGINT, s2_low BIGINT"
)


def _thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per input batch and case: the first spawn, and all answers.

    How many answers a panel takes is known to the case's state only.
    """
    for rows in batches:
        rows = rows.sort_values("seq", kind="stable")
        spawn = rows["expected"].notna()
        yield pd.concat([rows[spawn].groupby("case_id").head(1), rows[~spawn]])


class PanelBarrier(StatefulProcessor):
    """Emits a case's panel moments once, when its first spawn is complete.

    State per case: the first spawn, the answers it may need, a flag. Answers that
    come before their spawn wait in the state, then as many as it announced. With
    ``keep_ms`` all of it is forgotten once the watermark is that far beyond the
    case's last event (column ``us``): a panel that is not complete by then never
    speaks, and an event that comes later still is the first of a new case.
    """

    def __init__(self, keep_ms: int | None = None) -> None:
        self._keep = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._spawn = handle.getValueState("spawn", "seq BIGINT, expected INT")
        self._answers = handle.getMapState("answers", "seq BIGINT", "confidence DOUBLE")
        self._closed = handle.getValueState("closed", "closed BOOLEAN")
        if self._keep is not None:
            self._until = handle.getValueState("until", "ms BIGINT")

    def _prolong(self, chunk: pd.DataFrame) -> None:
        """Move the case's one timer behind the latest of its events."""
        if self._keep is None:
            return
        until = int(chunk["us"].max()) // 1000 + self._keep
        was = self._until.get()[0] if self._until.exists() else None
        if was is None or until > was:
            if was is not None:
                self._handle.deleteTimer(was)
            self._handle.registerTimer(until)
            self._until.update((until,))

    def handleExpiredTimer(self, key: Any, timerValues: Any,
                           expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        for state in (self._spawn, self._answers, self._closed, self._until):
            state.clear()
        return iter(())

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame],
                        timerValues: Any) -> Iterator[pd.DataFrame]:
        if self._closed.exists():
            for chunk in rows:
                self._prolong(chunk)
            return
        spawn = self._spawn.get() if self._spawn.exists() else None
        answers = {k[0]: v[0] for k, v in self._answers.iterator()}
        known = set(answers)
        for chunk in rows:
            self._prolong(chunk)
            for row in chunk.sort_values("seq").itertuples():
                if not pd.isna(row.expected):
                    if spawn is None or row.seq < spawn[0]:
                        spawn = (int(row.seq), int(row.expected))
                else:
                    answers[int(row.seq)] = float(row.confidence)
        if spawn is not None:
            answers = dict(sorted(answers.items())[:spawn[1]])
        if spawn is not None and len(answers) >= spawn[1] > 0:
            panel = [answers[seq] for seq in sorted(answers)][:spawn[1]]
            self._closed.update((True,))
            self._answers.clear()
            self._spawn.clear()
            yield self._moments(key[0], spawn[1], panel)
            return
        if spawn is not None:
            self._spawn.update(spawn)
        for seq in known - set(answers):
            self._answers.removeKey((seq,))
        for seq in set(answers) - known:
            self._answers.updateValue((seq,), (answers[seq],))

    @staticmethod
    def _moments(case_id: int, expected: int, panel: list[float]) -> pd.DataFrame:
        units = [int(c * 1e6 + 0.5) for c in panel if c > 0]
        squares = [u * u for u in units]
        return pd.DataFrame({
            "case_id": [case_id], "expected": [expected],
            "participating": [len(units)], "abstained": [len(panel) - len(units)],
            "s1": [sum(units)],
            "s2_high": [sum(s // 1_000_000 for s in squares)],
            "s2_low": [sum(s % 1_000_000 for s in squares)],
        })

    def close(self) -> None:
        pass


def stream_panel_agreement(events: DataFrame, keep_ms: int | None = None,
                           delay: str = "10 minutes") -> DataFrame:
    """A stream with one agreement row per case, when its panel is complete.

    Without ``keep_ms`` a case is remembered for ever, so it speaks once however
    late its events come. With it, a case's state goes that much event time after
    its last event, and ``delay`` bounds late arrival.
    """
    if keep_ms is not None:
        events = events.withWatermark("ts", delay)
    payload = F.from_json("data", EVENT_PAYLOAD)
    spawn = F.col("type") == "specialists_spawned"
    rows = events.where(F.col("type").isin("specialists_spawned", "specialist_done")).select(
        "case_id", "seq",
        F.when(spawn, F.coalesce(payload["count"], F.lit(0))).alias("expected"),
        F.when(~spawn, clamp(number_from_text(payload["confidence"]))).alias("confidence"),
        "ts", F.unix_micros("ts").alias("us"),
    )
    if keep_ms is None:
        rows, mode = rows.drop("ts", "us").mapInPandas(_thin, _BARRIER_ROW), "none"
    else:
        # A Python map would lose the watermark of ``ts``.
        mode = "eventTime"
    moments = rows.groupBy("case_id").transformWithStateInPandas(
        PanelBarrier(keep_ms), _BARRIER_OUT, "append", mode)
    return rounded_scores(agreement_level(score_moments(moments)))


# --- timeout watch -------------------------------------------------------------

# Agents are dealt out to so many groups, each with a state of its own.
SHARDS = 1024
_STALLED = "case_id STRING, stage STRING, agent_name STRING, seq BIGINT, ts TIMESTAMP"
_KEPT = "case_id STRING, stage STRING, agent_name STRING, seq BIGINT, us BIGINT, is_done BOOLEAN"


def still_waiting(waiting: dict[int, int], ended: dict[int, int], within: int) -> dict[int, int]:
    """The ``waiting`` events (seq to time) that no later-numbered done ended in time.

    One merge from the highest ``seq`` down: the earliest done seen so far is the
    only one that can matter, so the step is linear after sorting.
    """
    ends = sorted(ended.items(), reverse=True)
    left, at, earliest = {}, 0, None
    for seq, us in sorted(waiting.items(), reverse=True):
        while at < len(ends) and ends[at][0] > seq:
            earliest = ends[at][1] if earliest is None else min(earliest, ends[at][1])
            at += 1
        if earliest is None or earliest - us > within:
            left[seq] = us
    return left


class TimeoutWatch(StatefulProcessor):
    """Emits thinking events that saw no done in time, once their time is up.

    A verdict falls only when the watermark passes the deadline: by then every
    done that could still be in time has arrived, in whatever order. A call handles all
    agents of a shard: its state is one list, read and written at most once in a call, and
    it has one timer, set to its next deadline.
    """

    def __init__(self, timeout_ms: int) -> None:
        self._timeout = timeout_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._kept = handle.getListState("kept", _KEPT)
        self._alarm = handle.getValueState("alarm", "ms BIGINT")

    def _read(self) -> tuple[dict[tuple, dict[int, int]], dict[tuple, dict[int, int]]]:
        """The open and the done events of every agent, seq to time."""
        waiting, ended = defaultdict(dict), defaultdict(dict)
        if self._kept.exists():
            for *agent, seq, us, is_done in self._kept.get():
                (ended if is_done else waiting)[tuple(agent)][seq] = us
        return waiting, ended

    def _write(self, waiting: dict[tuple, dict[int, int]],
               ended: dict[tuple, dict[int, int]]) -> None:
        rows = [(*agent, seq, us, is_done) for is_done, events in ((False, waiting), (True, ended))
                for agent, times in events.items() for seq, us in times.items()]
        if rows:
            self._kept.put(rows)
        else:
            self._kept.clear()
        self._set_alarm(min((us for times in waiting.values() for us in times.values()),
                            default=None))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame],
                        timerValues: Any) -> Iterator[pd.DataFrame]:
        waiting, ended = self._read()
        touched = set()
        for chunk in rows:
            for case_id, stage, name, seq, us, is_done in zip(
                    *(chunk[c] for c in ("case_id", "stage", "agent_name", "seq", "us", "is_done")),
                    strict=True):
                agent = (_text(case_id), stage, _text(name))
                touched.add(agent)
                (ended if is_done else waiting)[agent][int(seq)] = int(us)
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        for agent in touched:
            waiting[agent] = still_waiting(waiting[agent], ended[agent], self._timeout)
        self._write(waiting, {
            agent: {seq: us for seq, us in times.items() if us >= watermark}
            for agent, times in ended.items()})
        return iter(())

    def _deadline(self, us: int) -> int:
        return -(-(us + self._timeout) // 1000)

    def _set_alarm(self, first: int | None) -> None:
        """Keep the shard's one timer at the deadline of its first open event."""
        was = self._alarm.get()[0] if self._alarm.exists() else None
        due = None if first is None else self._deadline(first)
        if due == was:
            return
        if was is not None:
            self._handle.deleteTimer(was)
        if due is None:
            self._alarm.clear()
        else:
            self._handle.registerTimer(due)
            self._alarm.update((due,))

    def handleExpiredTimer(self, key: Any, timerValues: Any,
                           expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        up = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        waiting, ended = self._read()
        late = [(*agent, seq, us) for agent, times in waiting.items()
                for seq, us in times.items() if self._deadline(us) <= up]
        for *agent, seq, _ in late:
            del waiting[tuple(agent)][seq]
        # The timer that fired is gone already.
        self._alarm.clear()
        self._write(waiting, ended)
        if late:
            found = pd.DataFrame(late, columns=["case_id", "stage", "agent_name", "seq", "ts"])
            yield found.assign(ts=pd.to_datetime(found["ts"], unit="us"))

    def close(self) -> None:
        pass


def _text(value: Any) -> str | None:
    """A text as pandas gives it, with every kind of null as None."""
    return value if isinstance(value, str) else None


def stream_stalled_agents(events: DataFrame,
                          timeout: int = fixed.REQUEST_TIMEOUT_SECONDS,
                          delay: str = "10 minutes") -> DataFrame:
    """A stream of stalled thinking events; ``delay`` bounds late arrival.

    The time of an event is up when the watermark, in whole milliseconds, reaches its
    deadline: ``delay`` behind the latest event of the stream, of whatever type. Agents
    share a state by hash, because a call for each of them costs far more than its events.
    """
    # Every event moves the watermark. Spark would push plain filters below it.
    staged = (
        computed_once(
            events.withWatermark("ts", delay),
            stage=F.substring_index("type", "_", 1), step=F.substring_index("type", "_", -1),
        )
        .where(F.col("stage").isin("triage", "specialist", "judge", "safety"))
        .where(F.col("step").isin("thinking", "done"))
        .select(F.pmod(F.xxhash64("case_id", "stage", "agent_name"), F.lit(SHARDS)).alias("shard"),
                # As a text, as pandas would round large ids that stand beside nulls.
                F.col("case_id").cast("string"), "stage", "agent_name", "seq", "ts",
                F.unix_micros("ts").alias("us"), (F.col("step") == "done").alias("is_done"))
    )
    return staged.groupBy("shard").transformWithStateInPandas(
        TimeoutWatch(timeout * 1000), _STALLED, "append", "eventTime"
    ).withColumn("case_id", F.col("case_id").cast("bigint"))
