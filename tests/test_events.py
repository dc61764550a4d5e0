from __future__ import annotations

import json
import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quorate.functions.scale import carry, exact_quantiles
from quorate.operators import events as ev
from quorate.schemas import EVENTS
from quorate.streaming import folds
from quorate.streaming.sources import on_batch, stream_events

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def log(spark, *events, case_id=1):
    rows = [
        (case_id, i, START + timedelta(seconds=10 * i), kind, agent,
         None if data is None else json.dumps(data))
        for i, (kind, agent, data) in enumerate(events)
    ]
    return spark.createDataFrame(rows, EVENTS)


def spawn(*names, lead="", count=None):
    return ("specialists_spawned", "orchestrator",
            {"specialties": list(names), "lead_specialist": lead,
             "count": len(names) if count is None else count})


def stages(df):
    return {r.stage: (r.status, r.summary, r.data) for r in ev.stage_status(df).collect()}


def test_trace_of_one_case(spark):
    state = stages(log(
        spark,
        ("triage_thinking", "supervisor_agent", {"message": "look"}),
        ("triage_done", "supervisor_agent", {"lead_specialist": "A B"}),
        spawn("A B", "C", lead="A B"),
        ("specialist_thinking", "specialist_a_b", {"message": "m1"}),
        ("specialist_done", "specialist_a_b", {"confidence": 1}),
        ("specialist_thinking", "specialist_a_b", {}),
        ("judge_done", "judge_agent", {"final_summary": "s"}),
        ("judge_thinking", "judge_agent", {}),
        ("specialist_done", "specialist_unknown", {"x": 1}),
    ))
    assert state == {
        "triage": ("done", "", '{"lead_specialist": "A B"}'),
        # Thinking after done goes back, but keeps the answer that was there.
        "specialist_a_b": ("thinking", "Analyzing...", '{"confidence": 1}'),
        "specialist_c": ("idle", "", None),
        # The judge's thinking resets its answer.
        "judge": ("thinking", "Synthesizing...", None),
    }


def test_a_new_spawn_replaces_all_cards(spark):
    state = stages(log(
        spark, spawn("A", "B"), ("specialist_done", "specialist_a", {"n": 1}), spawn("A", "C"),
        ("specialist_thinking", "specialist_c", {"message": "go"}),
    ))
    assert state == {"specialist_a": ("idle", "", None), "specialist_c": ("thinking", "go", None)}


def test_case_state(spark):
    df = log(
        spark, ("triage_done", "s", {"lead_specialist": "A"}), spawn("A", lead=""),
        ("consensus_done", "o", {"level": "weak"}), ("safety_done", "s", {"is_safe": False}),
        ("error", "", {}),
        ("pipeline_complete", "", {"consensus": {"level": "strong"}}),
    )
    r = ev.case_status(df).first()
    assert (r.lead_specialist, r.spawned, r.complete) == ("A", True, True)
    assert json.loads(r.consensus) == {"level": "strong"}
    assert json.loads(r.safety_report) == {"is_safe": False}
    assert r.error == "The pipeline stopped unexpectedly."


def test_a_later_triage_without_lead_clears_it(spark):
    df = log(spark, spawn("A", lead="A"), ("triage_done", "s", {}))
    assert ev.case_status(df).first().lead_specialist is None


def test_orphans(spark):
    df = log(
        spark, ("specialist_done", "specialist_a", {}), spawn("A", "Tab\tbed"),
        ("specialist_thinking", "specialist_a", {}),
        ("specialist_done", "specialist_tab\tbed", {}),
        ("specialist_done", "specialist_tab_bed", {}), spawn("B"),
        ("specialist_done", "specialist_a", {}),
    )
    for block in (1, 2, 3, 1000):
        assert [r.seq for r in ev.orphan_events(df, block).orderBy("seq").collect()] == [0, 3, 6]


@pytest.mark.parametrize("forward", [True, False])
def test_carry_equals_one_window(spark, forward):
    rng = random.Random(5)
    rows = [(k, s, rng.choice([None, None, str(s)])) for k in range(4)
            for s in rng.sample(range(500), 150)]
    df = spark.createDataFrame(rows, "k INT, seq BIGINT, v STRING")
    order = F.col("seq") if forward else F.col("seq").desc()
    whole = Window.partitionBy("k").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    expected = df.withColumn("out", F.last("v", ignorenulls=True).over(whole))
    for block in (1, 7, 64, 10_000):
        got = carry(df, ["k"], "seq", F.col("v"), "out", block, forward)
        assert sorted(got.select("k", "seq", "out").collect()) == sorted(
            expected.select("k", "seq", "out").collect())


def test_exact_quantiles(spark):
    rng = random.Random(6)
    values = {g: sorted(rng.randrange(0, 5000) for _ in range(n)) for g, n in (("a", 1), ("b", 333))}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g STRING, v BIGINT")
    rows = exact_quantiles(df, ["g"], "v", (0.5, 0.95), width=100).collect()
    for r in rows:
        vs = values[r.g]
        assert r.quantile == vs[max(0, -(-int(r.q * 100) * len(vs) // 100) - 1)] and r.n == len(vs)
    assert len(rows) == 4


def test_latency_and_stalls(spark):
    df = log(
        spark,
        ("specialist_thinking", "a", {}), ("specialist_thinking", "b", {}),
        ("specialist_done", "a", {}), ("judge_thinking", "j", {}), ("judge_done", "j", {}),
        ("specialist_thinking", "a", {}), ("error", "", {}), ("error", "", {}),
    )
    took = {(r.stage, r.agent_name): r.latency_ms for r in ev.stage_latencies(df, 2).collect()}
    assert took == {("specialist", "a"): 20_000, ("judge", "j"): 10_000}
    stalled = ev.stalled_agents(df, timeout=15, block=2).orderBy("seq").collect()
    assert [(r.seq, r.agent_name) for r in stalled] == [(0, "a"), (1, "b"), (5, "a")]


def test_failures(spark):
    texts = [("AuthenticationError", "x"), ("E", "Invalid API key: connection"),
             ("RateLimitError", ""), ("E", "Rate limit; timeout"), ("E", "Connection error."),
             ("APITimeoutError", None), ("ValueError", "boom")]
    df = spark.createDataFrame(texts, "name STRING, message STRING")
    got = dict(ev.classify_failures(df).collect())
    assert got == {"auth": 2, "rate_limit": 2, "connectivity": 2, "other": 1}


def test_drafts_are_the_tokens_in_order(spark):
    rows = [(1, "a", i, str(i % 10)) for i in range(2500)] + [(1, "b", 9, "x")]
    random.Random(1).shuffle(rows)
    tokens = spark.createDataFrame(rows, "case_id BIGINT, agent_name STRING, seq BIGINT, token STRING")
    got = {r.agent_name: r.draft for r in ev.assemble_drafts(tokens.repartition(5), part=100).collect()}
    assert got == {"a": "".join(str(i % 10) for i in range(2500)), "b": "x"}


def test_barrier_waits_for_the_announced_count(spark):
    done = lambda a, c: ("specialist_done", a, {"confidence": c})
    early = log(spark, done("a", 0.9), spawn("A", "B", "C", count=2), done("b", 0.85),
                done("c", 0.1), case_id=1)
    open_ = log(spark, spawn("A", "B"), done("a", 0.9), case_id=2)
    rows = ev.barrier_agreement(early.unionByName(open_)).collect()
    assert [(r.case_id, r.expected, r.mean_confidence) for r in rows] == [(1, 2, 0.875)]


def test_barrier_of_a_panel_larger_than_ten(spark):
    done = [("specialist_done", f"a{i}", {"confidence": 0.5}) for i in range(13)]
    rows = ev.barrier_agreement(
        log(spark, spawn("A", count=12), *done, case_id=1)).collect()
    assert [(r.expected, r.participating) for r in rows] == [(12, 12)]


def test_events_without_an_agent_are_waited_for_like_others(spark):
    events = log(spark, ("judge_thinking", None, {}), ("judge_thinking", "judge_agent", {}),
                 ("error", "", {}), case_id=1)
    later = events.withColumn("ts", F.expr("ts + make_interval(0, 0, 0, 0, 1)")).withColumn(
        "seq", F.col("seq") + 1000).where("type = 'error'")
    stalled = ev.stalled_agents(events.unionByName(later), 60).collect()
    assert {r.agent_name for r in stalled} == {None, "judge_agent"}


def test_tokens_are_left_out_before_their_payload_is_looked_at(spark):
    events = log(spark, ("agent_stream", "a", {"token": "x"}), ("judge_thinking", "j", {}),
                 spawn("A"), case_id=1).unionByName(
        log(spark, ("judge_thinking", "j", {}), case_id=2)).unionByName(
        log(spark, ("agent_stream", "a", {"token": "x"}), case_id=3))
    plan = ev.register_writes(events)._jdf.queryExecution().optimizedPlan().toString()
    below = plan.split("Generate explode", 1)[1]
    assert "Filter" in below and "pipeline_complete" in below.split("Filter", 1)[1]
    # A case without a register of its own is a case all the same.
    got = {r.case_id: (r.spawned, r.complete) for r in ev.case_status(events).collect()}
    assert got == {1: (True, False), 2: (False, False)}
    assert {(r.case_id, r.stage) for r in ev.stage_status(events).collect()} == {
        (1, "judge"), (1, "specialist_a"), (2, "judge")}


# --- streams: what comes out equals the batch, also after a restart -------------

def random_log(spark, cases=6, per_case=40):
    rng = random.Random(11)
    rows = []
    for case in range(cases):
        for i in range(per_case):
            seq = case + cases * i
            kind = rng.choice(["specialists_spawned", "specialist_thinking", "specialist_done",
                               "judge_thinking", "judge_done", "error"])
            agent = f"specialist_a{rng.randrange(4)}" if kind.startswith("specialist_") else ""
            data = {"specialties": [f"A{k}" for k in range(rng.randrange(1, 4))],
                    "count": rng.randrange(1, 4), "confidence": rng.randrange(0, 11) / 10,
                    "message": f"m{i}"}
            rows.append((case, seq, START + timedelta(seconds=seq * 7), kind, agent,
                         json.dumps(data)))
    return spark.createDataFrame(rows, EVENTS)


def arriving(df, path, drain, cuts=(0, 60, 130, 10_000)):
    for low, high in zip(cuts, cuts[1:]):
        df.where((F.col("seq") >= low) & (F.col("seq") < high)).repartition(3).write.mode(
            "append").parquet(path)
        drain(path)


def test_streamed_stages_equal_batch(spark, tmp_path):
    df = random_log(spark)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    arriving(df, str(tmp_path / "in"), lambda path: folds.fold_registers(
        stream_events(spark, path, "parquet")[0], out, mark).awaitTermination())
    registers = folds.stored_registers(spark, out)
    assert sorted(map(str, ev.stages_from_registers(registers).collect())) == sorted(
        map(str, ev.stage_status(df).collect()))
    assert sorted(map(str, ev.cases_from_registers(registers).collect())) == sorted(
        map(str, ev.case_status(df).collect()))


def drained(spark, df, tmp_path, stream_of):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def drain(path):
        stream_of(path).writeStream.format("parquet").option(
            "checkpointLocation", mark).trigger(availableNow=True).start(out).awaitTermination()

    arriving(df, str(tmp_path / "in"), drain)
    return spark.read.parquet(out)


def test_streamed_barrier_speaks_once_and_equals_batch(spark, tmp_path):
    df = random_log(spark)
    got = drained(spark, df, tmp_path, lambda path: folds.stream_panel_agreement(
        stream_events(spark, path, "parquet")[0]))
    assert sorted(map(str, got.collect())) == sorted(
        map(str, ev.barrier_agreement(df).select(*got.columns).collect()))


def test_streamed_stalls_equal_batch(spark, tmp_path):
    df = random_log(spark)
    got = drained(spark, df, tmp_path, lambda path: folds.stream_stalled_agents(
        stream_events(spark, path, "parquet")[0], 200, "0 seconds"))
    pick = ("case_id", "stage", "agent_name", "seq")
    expected = ev.stalled_agents(df, 200, 10).select(*pick)
    assert sorted(got.select(*pick).collect()) == sorted(expected.collect())


@pytest.mark.parametrize("after, stalled", [(59_999, []), (60_000, [0]), (60_500, [0])])
def test_every_event_moves_the_watermark_of_the_stalls(spark, tmp_path, after, stalled):
    """An error, no event of an agent, is the last of the log: the time is up with it."""
    rows = [(1, 0, START, "judge_thinking", "j", "{}"),
            (1, 1, START + timedelta(seconds=10), "judge_thinking", "j", "{}"),
            (2, 2, START + timedelta(milliseconds=after), "error", "", "{}")]
    df = spark.createDataFrame(rows, EVENTS)
    got = drained(spark, df, tmp_path, lambda path: folds.stream_stalled_agents(
        stream_events(spark, path, "parquet")[0], 60, "0 seconds"))
    assert [r.seq for r in got.collect()] == stalled
    assert [r.seq for r in ev.stalled_agents(df, 60, 10).collect()] == stalled


def test_waiting_events_equal_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        waiting = {rng.randrange(40): rng.randrange(60) for _ in range(rng.randrange(12))}
        ended = {rng.randrange(40): rng.randrange(60) for _ in range(rng.randrange(12))}
        expected = {seq: us for seq, us in waiting.items()
                    if not any(s > seq and end - us <= 9 for s, end in ended.items())}
        assert folds.still_waiting(waiting, ended, 9) == expected


def test_waiting_events_of_one_hot_key_are_merged_in_one_pass():
    n = 100_000
    waiting = {2 * i: 10 * i for i in range(n)}
    ended = {2 * i + 1: 10 * i + 1_000_000 for i in range(n)}
    start = time.perf_counter()
    assert folds.still_waiting(waiting, ended, 999_999) == waiting
    assert folds.still_waiting(waiting, ended, 1_000_000) == {}
    assert time.perf_counter() - start < 5


def test_one_key_with_many_open_events_in_a_stream(spark, tmp_path):
    rows = [(1, i, START + timedelta(seconds=i), "judge_thinking", "j", "{}")
            for i in range(3000)]
    rows += [(1, 2 * i + 10_000, START + timedelta(seconds=2 * i + 1), "judge_done", "j", "{}")
             for i in range(1400)]
    rows += [(1, 20_000, START + timedelta(seconds=9000), "error", "", "{}")]
    df = spark.createDataFrame(rows, EVENTS)
    arrive = tmp_path / "in"
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for part in (df.where("seq < 20000"), df.where("seq >= 20000"), df.where("seq < 0")):
        part.write.mode("append").parquet(str(arrive))
        folds.stream_stalled_agents(
            stream_events(spark, str(arrive), "parquet")[0], 60, "0 seconds",
        ).writeStream.format("parquet").option("checkpointLocation", mark).trigger(
            availableNow=True).start(out).awaitTermination()
    got = sorted(r.seq for r in spark.read.parquet(out).select("seq").collect())
    done = [2 * i + 1 for i in range(1400)]
    assert got == [i for i in range(3000) if not any(d - i <= 60 for d in done)]


def test_barrier_forgets_a_case_after_its_time(spark, tmp_path):
    """Case 1 has its answer before, case 2 after a long silence: 1 is forgotten."""
    early = log(spark, ("specialist_done", "a", {"confidence": 0.9}), case_id=1)
    silence = log(spark, ("specialist_done", "z", {"confidence": 0.1}), case_id=3).withColumn(
        "ts", F.expr("ts + make_interval(0, 0, 0, 1)"))
    late = [log(spark, spawn("A", count=1), ("specialist_done", "a", {"confidence": 0.9}),
                case_id=2),
            log(spark, spawn("A", count=1), case_id=1)]
    late = late[0].unionByName(late[1]).withColumn("seq", F.col("seq") + 50).withColumn(
        "ts", F.expr("ts + make_interval(0, 0, 0, 2)"))
    said = {}
    for keep in (3_600_000, None):
        arrive, out, mark = (str(tmp_path / f"{name}{keep}") for name in ("in", "out", "mark"))
        for part in (early, silence, late):
            part.write.mode("append").parquet(arrive)
            folds.stream_panel_agreement(
                stream_events(spark, arrive, "parquet")[0], keep,
            ).writeStream.format("parquet").option("checkpointLocation", mark).trigger(
                availableNow=True).start(out).awaitTermination()
        said[keep] = {r.case_id for r in spark.read.parquet(out).collect()}
    assert said == {3_600_000: {2}, None: {1, 2}}


def test_unknown_types_are_set_aside(spark, tmp_path):
    df = log(spark, ("judge_done", "j", {}), ("made_up", "x", {}), (None, "x", {}))
    df.write.json(str(tmp_path / "in"))
    known, rejected = stream_events(spark, str(tmp_path / "in"))
    seen: dict[str, list] = {"known": [], "rejected": []}
    for label, stream in (("known", known), ("rejected", rejected)):
        on_batch(stream, lambda rows, i, at=label: seen[at].extend(rows.collect()),
                 str(tmp_path / label)).awaitTermination()
    assert [r.type for r in seen["known"]] == ["judge_done"]
    assert sorted(str(r.type) for r in seen["rejected"]) == ["None", "made_up"]


def test_trace_fields_are_read_from_each_payload_once(spark):
    from quorate.plans.queries import _trace_fields
    rows = [(1, 0, "triage_done", "a", '{"lead_specialist": "S", "message": "m", "x": [1]}'),
            (1, 1, "specialists_spawned", "b", '{"count": 3, "lead_specialist": ""}'),
            (1, 2, "specialist_done", "c", '{"findings": "f \\"q\\" ü", "message": null}'),
            (1, 3, "pipeline_complete", "", '{"consensus": {"message": "no"}}')]
    log = spark.createDataFrame(
        rows, "case_id BIGINT, seq BIGINT, type STRING, agent_name STRING, data STRING")
    told = _trace_fields(log)
    assert [tuple(r)[4:] for r in told.orderBy("seq").collect()] == [
        ("S", "m", None, None), ("", None, "3", None), (None, None, None, 'f "q" ü'),
        (None, None, None, None)]
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan and plan.count("from_json") == 1


def test_stalls_of_many_agents_share_few_states(spark, tmp_path, monkeypatch):
    """Agents of one shard, some of them without a case or a name, do not mix."""
    monkeypatch.setattr(folds, "SHARDS", 2)
    big = 2**60 + 1
    rows = [(case, 10 * k, START + timedelta(seconds=k % 7), "judge_thinking", name, "{}")
            for k, (case, name) in enumerate([(1, "a"), (1, "b"), (1, None), (None, "a"), (big, "a"),
                                              (big + 1, "a")])]
    rows += [(1, 1000, START + timedelta(seconds=9), "judge_done", "b", "{}"),
             (big, 1001, START + timedelta(seconds=9), "judge_done", "a", "{}"),
             (9, 2000, START + timedelta(seconds=500), "error", "", "{}")]
    df = spark.createDataFrame(rows, EVENTS)
    stream = []
    got = drained(spark, df, tmp_path, lambda path: stream.append(folds.stream_stalled_agents(
        stream_events(spark, path, "parquet")[0], 60, "0 seconds")) or stream[-1])
    assert sorted(map(str, got.select("case_id", "agent_name", "seq").collect())) == sorted(
        map(str, ev.stalled_agents(df, 60, 10).select("case_id", "agent_name", "seq").collect()))
    plan = stream[0]._jdf.queryExecution().analyzed().toString()
    assert [line for line in plan.splitlines() if "TransformWithState" in line and "shard" in line]
