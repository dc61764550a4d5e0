"""The event log of finished and running cases.

Events are rows ``case_id, seq, ts, type, agent_name, data`` with ``seq``
unique within the case and ``data`` the open JSON payload. Folds are written
as last-writer-wins registers, one mergeable aggregate, so the same code runs
as a batch and as a stream, and a hot case is combined on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate import fixed_values as fixed
from quorate.functions.scale import carry, computed_once, exact_quantiles
from quorate.functions.text import agent_key, card_key
from quorate.operators.agreement import (
    agreement_level, cap_panel, panel_moments, score_moments,
)
from quorate.operators.contracts import clean_confidence
from quorate.schemas import EVENT_PAYLOAD

# Width of a block of `seq` in the ordered look-ups, if the caller knows no better.
BLOCK = 100_000
DRAFT_PART = 10_000
# The event types that set a register.
SETTING = (
    "triage_thinking", "triage_done", "judge_thinking", "judge_done", "safety_thinking",
    "safety_done", "specialists_spawned", "specialist_thinking", "specialist_done",
    "consensus_done", "discussion_summary", "pipeline_complete", "error",
)
# Those that set nothing a stage or card is read from.
CASE_ONLY = ("consensus_done", "discussion_summary", "pipeline_complete", "error")
# The registers each state is read from.
STAGE_SLOTS = ("triage", "judge", "safety", "spawn", "agent_thinking", "agent_done")
CASE_SLOTS = ("lead", "spawn", "consensus", "discussion", "safety_report", "complete", "error")


def known_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of a declared type, and the rest."""
    known = F.coalesce(F.col("type").isin(*fixed.EVENT_TYPES), F.lit(False))
    return events.where(known), events.where(~known)


def _payload() -> Column:
    return F.from_json("data", EVENT_PAYLOAD)


def _set(slot: str, value: Column, agent: Column | None = None) -> Column:
    return F.struct(
        F.lit(slot).alias("slot"),
        (F.lit("") if agent is None else agent).alias("agent"),
        value.alias("value"),
    )


def register_writes(events: DataFrame) -> DataFrame:
    """What each event sets: rows ``case_id, slot, agent, seq, type, value``.

    Row-local. ``lead`` is overwritten by every triage answer, even by one
    that names nobody, but by a spawn only if that names somebody. A final
    event overrides consensus and safety report where it carries them. Types that
    set nothing, the tokens of a streamed log above all, are left out by a plain
    filter before any payload is looked at.
    """
    final = F.col("type") == "pipeline_complete"
    events = computed_once(
        events.where(F.col("type").isin(*SETTING)),
        _consensus=F.when(final, F.get_json_object("data", "$.consensus")),
        _safety=F.when(final, F.get_json_object("data", "$.safety_report")),
    )
    kind, data = F.col("type"), F.col("data")
    named = F.get_json_object(data, "$.lead_specialist")
    agent = F.col("agent_name")
    consensus, safety = F.col("_consensus"), F.col("_safety")
    own = F.substring_index(kind, "_", 1)
    writes = F.array(
        F.when(kind.isin("triage_thinking", "triage_done", "judge_thinking", "judge_done",
                         "safety_thinking", "safety_done"),
               F.struct(own.alias("slot"), F.lit("").alias("agent"), data.alias("value"))),
        F.when((kind == "triage_done")
               | ((kind == "specialists_spawned") & (F.coalesce(named, F.lit("")) != "")),
               _set("lead", named)),
        F.when(kind == "specialists_spawned", _set("spawn", data)),
        F.when(kind == "specialist_thinking", _set("agent_thinking", data, agent)),
        F.when(kind == "specialist_done", _set("agent_done", data, agent)),
        F.when(kind == "consensus_done", _set("consensus", data)),
        F.when(consensus.isNotNull(), _set("consensus", consensus)),
        F.when(kind == "discussion_summary", _set("discussion", data)),
        F.when(kind == "safety_done", _set("safety_report", data)),
        F.when(safety.isNotNull(), _set("safety_report", safety)),
        # That it came is all that is kept: its parts are registers of their own.
        F.when(kind == "pipeline_complete", _set("complete", F.lit(None).cast("string"))),
        F.when(kind == "error", _set("error", data)),
    )
    # Filtered behind the generator: a lambda inside it would keep it from being compiled.
    return events.select("case_id", "seq", "type", F.explode(writes).alias("w")).where(
        F.col("w").isNotNull()
    ).select("case_id", "w.slot", "w.agent", "seq", "type", "w.value")


def latest_registers(writes: DataFrame) -> DataFrame:
    """The last write of every register; merges partial results of any split."""
    return (
        writes.groupBy("case_id", "slot", "agent")
        .agg(F.max_by(F.struct("seq", "type", "value"), "seq").alias("w"))
        .select("case_id", "slot", "agent", "w.seq", "w.type", "w.value")
    )


def _message(value: Column, stage: str) -> Column:
    text = F.get_json_object(value, "$.message")
    return F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(
        fixed.DEFAULT_MESSAGES[stage]
    )


def stages_from_registers(registers: DataFrame) -> DataFrame:
    """Current state of every stage and specialist card of a case.

    A spawn replaces all cards. A card then keeps its last summary when done
    and its last data when thinking again; the other stages reset both.

    Registers are read once: each says what it knows of one stage or card, the last
    spawn of every card it lists, and one mergeable aggregate puts that together.
    Events of agents that the spawn does not list, or without a name, make no card.
    """
    spawns, value = F.col("slot") == "spawn", F.col("value")
    listed = F.when(spawns, F.from_json("value", EVENT_PAYLOAD)["specialties"])
    about = F.when(
        spawns, F.transform(listed, lambda name, pos: F.struct(
            F.lit(False).alias("own"), card_key(name).alias("stage"),
            name.alias("specialty"), pos.alias("pos")))
    ).when(
        F.col("slot").isin("triage", "judge", "safety"), F.array(_about(True, F.col("slot")))
    ).when(
        F.col("slot").isin("agent_thinking", "agent_done") & F.col("agent").isNotNull(),
        F.array(_about(False, F.col("agent"))),
    )
    known = registers.select(
        "case_id", "slot", "seq", "type",
        F.when(~spawns, value).alias("value"), F.explode(about).alias("a"),
    ).select("case_id", "a.*", "slot", "seq", "type", "value")

    def of(slot: str, field: Column | str) -> Column:
        return F.max(F.when(F.col("slot") == slot, field))

    folded = known.groupBy("case_id", "own", "stage").agg(
        F.max_by("specialty", "pos").alias("specialty"),
        of("spawn", F.col("seq")).alias("spawned"),
        *[of(f"agent_{kind}", F.col(field)).alias(f"{kind}_{field}")
          for kind in ("thinking", "done") for field in ("seq", "value")],
        F.max(F.when(F.col("own"), F.struct("type", "value"))).alias("last"),
    )
    began = F.coalesce(F.col("thinking_seq") > F.col("spawned"), F.lit(False))
    ended = F.coalesce(F.col("done_seq") > F.col("spawned"), F.lit(False))
    done_last = ended & (~began | (F.col("done_seq") > F.col("thinking_seq")))
    # Of a stage the last event alone counts.
    own, thinking = F.col("own"), F.col("last.type").endswith("_thinking")
    default = F.when(F.col("stage") == "triage", _message(F.col("last.value"), "triage")).when(
        F.col("stage") == "judge", _message(F.col("last.value"), "judge")
    ).otherwise(_message(F.col("last.value"), "safety"))
    return folded.where(own | F.col("spawned").isNotNull()).select(
        "case_id", "stage", "specialty",
        F.when(own, F.when(thinking, "thinking").otherwise("done"))
        .when(done_last, "done").when(began, "thinking").otherwise("idle").alias("status"),
        F.when(own & thinking, default)
        .when(~own & began, _message(F.col("thinking_value"), "specialist"))
        .otherwise("").alias("summary"),
        F.when(own, F.when(~thinking, F.col("last.value")))
        .when(ended, F.col("done_value")).alias("data"),
    )


def _about(own: bool, stage: Column) -> Column:
    """What a register that is no spawn is about: a stage of its own, or a card."""
    return F.struct(
        F.lit(own).alias("own"), stage.alias("stage"),
        F.lit(None).cast("string").alias("specialty"), F.lit(None).cast("int").alias("pos"),
    )


def cases_from_registers(registers: DataFrame) -> DataFrame:
    """Case-level state: lead, consensus, discussion, safety report, end, error."""
    def value(slot: str) -> Column:
        return F.max(F.when(F.col("slot") == slot, F.col("value")))

    def present(slot: str) -> Column:
        return F.bool_or(F.col("slot") == slot)

    error = F.max(F.when(F.col("slot") == "error", _message(F.col("value"), "error")))
    return registers.groupBy("case_id").agg(
        value("lead").alias("lead_specialist"),
        present("spawn").alias("spawned"),
        value("consensus").alias("consensus"),
        value("discussion").alias("discussion"),
        value("safety_report").alias("safety_report"),
        present("complete").alias("complete"),
        error.alias("error"),
    )


def stage_status(events: DataFrame) -> DataFrame:
    """Latest state per case and stage or specialist."""
    staged = events.where(~F.col("type").isin(*CASE_ONLY))
    writes = register_writes(staged).where(F.col("slot").isin(*STAGE_SLOTS))
    return stages_from_registers(latest_registers(writes))


def case_status(events: DataFrame) -> DataFrame:
    """Latest case-level state.

    The other registers only tell that there is a case: one of them stands for all.
    """
    own = F.col("slot").isin(*CASE_SLOTS)
    writes = register_writes(events).withColumns({
        "slot": F.when(own, F.col("slot")).otherwise(""), "agent": F.lit(""),
        "value": F.when(own, F.col("value")),
    })
    return cases_from_registers(latest_registers(writes))


def draft_tokens(events: DataFrame) -> DataFrame:
    """The token events as ``case_id, agent_name, seq, token``."""
    return events.where(F.col("type") == "agent_stream").select(
        "case_id", "agent_name", "seq",
        F.get_json_object("data", "$.token").alias("token"),
    )


def draft_parts(tokens: DataFrame, part: int = DRAFT_PART) -> DataFrame:
    """Drafts in pieces of at most ``part`` consecutive positions.

    ``seq`` is a unique integer, so no task ever sorts more than ``part``
    tokens, however long one agent's draft is.
    """
    ordered = F.sort_array(F.collect_list(F.struct("seq", "token")))
    return tokens.groupBy("case_id", "agent_name", F.floor(F.col("seq") / part).alias("part")).agg(
        F.array_join(F.transform(ordered, lambda t: t["token"]), "").alias("draft"),
        F.count(F.lit(1)).alias("tokens"),
    )


def assemble_drafts(tokens: DataFrame, part: int = DRAFT_PART) -> DataFrame:
    """Each agent's tokens put together in order; only whole parts meet."""
    ordered = F.sort_array(F.collect_list(F.struct("part", "draft")))
    return draft_parts(tokens, part).groupBy("case_id", "agent_name").agg(
        F.array_join(F.transform(ordered, lambda p: p["draft"]), "").alias("draft"),
        F.sum("tokens").alias("tokens"),
    )


def orphan_events(events: DataFrame, block: int = BLOCK) -> DataFrame:
    """Specialist events whose agent the latest preceding spawn did not list."""
    used = events.where(
        F.col("type").isin("specialists_spawned", "specialist_thinking", "specialist_done")
    )
    listed = F.transform(
        F.coalesce(_payload()["specialties"], F.array().cast("array<string>")), card_key
    )
    spawned = F.when(F.col("type") == "specialists_spawned", listed)
    known = carry(used, ["case_id"], "seq", spawned, "_cards", block)
    return (
        known.where(F.col("type") != "specialists_spawned")
        .where(~F.coalesce(F.array_contains("_cards", F.col("agent_name")), F.lit(False)))
        .drop("_cards")
    )


def _next_done(events: DataFrame, block: int) -> DataFrame:
    """Thinking events with the time the same agent's next done arrives."""
    staged = (
        events.where(F.col("type").endswith("_thinking") | F.col("type").endswith("_done"))
        .withColumn("stage", F.substring_index("type", "_", 1))
        .where(F.col("stage").isin("triage", "specialist", "judge", "safety"))
        .select("case_id", "stage", "agent_name", "seq", "ts", "type")
    )
    done = F.when(F.col("type").endswith("_done"), F.col("ts"))
    return carry(staged, ["case_id", "stage", "agent_name"], "seq", done, "done_ts", block,
                 forward=False).where(F.col("type").endswith("_thinking")).drop("type")


def stage_latencies(events: DataFrame, block: int = BLOCK) -> DataFrame:
    """Milliseconds from each thinking event to the same agent's next done."""
    took = F.unix_micros("done_ts") - F.unix_micros("ts")
    return (
        _next_done(events, block).where(F.col("done_ts").isNotNull())
        .withColumn("latency_ms", F.floor(took / 1000))
    )


def stage_latency(events: DataFrame, fractions: tuple[float, ...] = (0.5, 0.95),
                  block: int = BLOCK) -> DataFrame:
    """Exact latency quantiles per stage (the smallest value reaching the rank)."""
    return exact_quantiles(
        stage_latencies(events, block), ["stage"], "latency_ms", fractions
    ).withColumnRenamed("quantile", "latency_ms")


def stalled_agents(events: DataFrame, timeout: int = fixed.REQUEST_TIMEOUT_SECONDS,
                   block: int = BLOCK) -> DataFrame:
    """Thinking events without a done of the same agent within ``timeout`` seconds.

    An event whose time is not yet up at the end of the log is not stalled.
    """
    limit = timeout * 1_000_000
    now = events.agg(F.max(F.unix_micros("ts"))).scalar()
    start, done = F.unix_micros("ts"), F.unix_micros("done_ts")
    late = F.coalesce(done - start > limit, F.lit(True))
    return (
        _next_done(events, block)
        .where(late & (start + limit <= now))
        .select("case_id", "stage", "agent_name", "seq", "ts", "done_ts")
    )


def failure_class(text: Column, name: Column | None = None) -> Column:
    """auth / rate_limit / connectivity / other; the first match wins."""
    low = F.lower(F.coalesce(text, F.lit("")))
    chain = None
    for label, needles, names in fixed.FAILURE_CLASSES:
        test = F.lit(False)
        for needle in needles:
            test = test | F.contains(low, F.lit(needle))
        if name is not None:
            test = test | F.coalesce(name.isin(*names), F.lit(False))
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    return chain.otherwise("other")


def classify_failures(errors: DataFrame) -> DataFrame:
    """Failure counts per class from ``name`` (exception) and ``message``."""
    return (
        errors.withColumn("class", failure_class(F.col("message"), F.col("name")))
        .groupBy("class").agg(F.count(F.lit(1)).alias("failures"))
    )


def barrier_panels(events: DataFrame) -> DataFrame:
    """The specialist answers that complete each case's first spawned panel.

    A case is complete once as many specialists are done as its first spawn
    announced (``count``); its panel is those first answers in ``seq`` order,
    whether they came before or after the spawn. The largest announced count
    bounds what a map task sends of a case.
    """
    payload = _payload()
    spawns = (
        events.where(F.col("type") == "specialists_spawned")
        .groupBy("case_id")
        .agg(F.min_by(payload["count"], "seq").alias("expected"))
    )
    largest = spawns.agg(F.coalesce(F.max("expected"), F.lit(0)).alias("n")).first().n
    done = cap_panel(
        events.where(F.col("type") == "specialist_done").select(
            "case_id", F.col("seq").alias("pos"), "agent_name",
            payload["confidence"].alias("confidence"),
        ),
        largest,
    )
    return clean_confidence(
        done.join(spawns, "case_id").where(F.col("pos") < F.col("expected"))
    )


def barrier_agreement(events: DataFrame) -> DataFrame:
    """Agreement of every case whose spawned panel is complete."""
    panels = barrier_panels(events)
    sizes = panels.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("_n"), F.max("expected").alias("expected")
    ).where(F.col("_n") == F.col("expected"))
    scored = agreement_level(score_moments(panel_moments(panels)))
    return rounded_scores(scored.join(sizes, "case_id"))


def rounded_scores(scored: DataFrame) -> DataFrame:
    return scored.select(
        "case_id", "expected", "participating", "abstained",
        F.bround("mean", 3).alias("mean_confidence"),
        F.bround("spread", 3).alias("confidence_spread"),
        F.bround("score", 3).alias("agreement_score"),
        "level",
    )


def tokens_of(text: Column) -> Column:
    """A text cut into words, each with the white space behind it; joined, the same text."""
    return F.coalesce(
        F.regexp_extract_all(text, F.lit(r"\S+\s*|^\s+"), F.lit(0)),
        F.array().cast("array<string>"))


def emit_trace(assessments: DataFrame, streamed: bool = False,
               tokens: bool = True) -> DataFrame:
    """The ordered events of finished cases, built inside each assessment row.

    Every assessment explodes into its own event list: no shuffle, no numbering
    window. Everyone asked is announced and starts; an answer that could not be
    used is missing among the done ones, which keep their seats' names. Run it on
    stored assessments, or where the log is read once. ``streamed`` puts the answer's
    text, token by token, as ``agent_stream`` events in front of each done event;
    ``assemble_drafts`` puts it together again. ``tokens=False`` is the filter of a reader that leaves those events
    out, as far down as it goes: they are counted, so that all others keep their numbers,
    but not built.
    """
    def event(kind: str, agent: Column | str, data: Column,
              skipped: Column = F.lit(0)) -> Column:
        name = F.lit(agent) if isinstance(agent, str) else agent
        return F.struct(F.lit(kind).alias("type"), name.alias("agent_name"), data.alias("data"),
                        skipped.alias("skipped"))

    def message(stage: str, filled: Column | None = None) -> Column:
        before, _, after = fixed.TRACE_MESSAGES[stage].partition("{}")
        text = F.lit(before) if filled is None else F.concat(F.lit(before), filled, F.lit(after))
        return text.alias("message")

    # Each answer's JSON is spoken and sent, but written once.
    assessments = assessments.withColumns({
        "_said": F.transform("specialist_opinions", lambda opinion: F.to_json(opinion)),
        "_triage": F.to_json("supervisor"), "_judge": F.to_json("judge_report"),
        "_safety": F.to_json("safety_report"),
    })
    agent = fixed.AGENT_NAMES
    lead = F.coalesce(F.col("lead_specialist"), F.lit(""))
    opinions = F.col("specialist_opinions")
    spawned = F.to_json(F.struct(
        F.col("asked").alias("specialties"), lead.alias("lead_specialist"),
        F.size("asked").alias("count"),
    ))

    def thinking(asked: Column) -> Column:
        is_lead = asked == lead
        label = F.when(is_lead, F.concat(asked, F.lit(fixed.LEAD_SUFFIX))).otherwise(asked)
        return event("specialist_thinking", agent_key(asked), F.to_json(F.struct(
            asked.alias("specialty"), is_lead.alias("is_lead"), message("specialist", label))))

    def done(said: Column, i: Column) -> Column:
        asked = F.get("asked", F.get("seats", i))
        return answered("specialist_done", agent_key(asked), said)

    def answered(kind: str, name: Column | str, text: Column) -> Column:
        """The done event of an answer, behind its tokens."""
        if streamed and not tokens:
            return F.array(event(kind, name, text, F.size(tokens_of(text))))
        end = F.array(event(kind, name, text))
        if not streamed:
            return end
        spoken = F.transform(
            tokens_of(text), lambda token: event("agent_stream", name, token))
        return F.concat(spoken, end)

    def stage(name: str) -> Column:
        return F.concat(
            F.array(event(f"{name}_thinking", agent[name], F.to_json(F.struct(message(name))))),
            answered(f"{name}_done", agent[name], F.col(f"_{name}")),
        )

    summary = F.to_json(F.struct(
        message("discussion", lead), F.size(opinions).alias("total_specialists")))
    whole = F.to_json(F.struct(
        "supervisor", "specialist_opinions", "consensus", "judge_report", "safety_report"
    ))
    log = F.concat(
        stage("triage"),
        F.array(event("specialists_spawned", agent["panel"], spawned)),
        F.transform("asked", thinking),
        F.flatten(F.transform("_said", done)),
        F.array(
            event("consensus_done", agent["panel"], F.to_json("consensus")),
            event("discussion_summary", agent["panel"], summary),
        ),
        stage("judge"), stage("safety"),
        F.array(event("pipeline_complete", "", whole)),
    )
    data, seq = F.col("e.data"), F.col("pos")
    if streamed and tokens:
        # Tokens, most of the log, get their JSON outside the list: as compiled code, and
        # only where a reader does not filter them out.
        data = F.when(F.col("e.type") == "agent_stream", F.to_json(
            F.struct(data.alias("token")))).otherwise(data)
    else:
        # The list is a projection of its own: a generator would not compile it, and would
        # work out its type anew for every case.
        assessments, log = assessments.withColumn("_log", log), F.col("_log")
    if streamed and not tokens:
        assessments = assessments.withColumn("_before", F.aggregate(
            log, F.array(F.lit(0)), lambda before, e: F.concat(before, F.array(
                F.element_at(before, -1) + e["skipped"]))))
        seq = seq + F.get("_before", F.col("pos") + 1)
    return assessments.select("*", F.posexplode(log).alias("pos", "e")).select(
        "case_id", seq.cast("bigint").alias("seq"), "e.type", "e.agent_name",
        data.alias("data"),
    )
