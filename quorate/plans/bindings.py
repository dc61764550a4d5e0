"""How the given tables stand in for cases, opinions, answers and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.fixed_values import UNKNOWN_SPECIALTY
from quorate.functions.scale import spread
from quorate.operators.agreement import cap_panel, numbered
from quorate.operators.prepare import nest_documents

DOCS_PER_CASE = 5

# Words standing in for clinical indicators, in the languages of the documents.
ROLE_WORDS = """\
| Specialty | Key Indicators | Lead Potential |
| :--- | :--- | :--- |
| **Cardiologist** | that, was, of the, erin. | High |
| **Neurologist** | with, este, from the, thor. | High |
| **Nephrologist** | this, que (les), for, und. | Medium |
| **Endocrinologist** | from, der, avec, un la. | Medium |
| **Radiologist** | thble, para, thing, eron, dans. | Low |
| **Pharmacist** | thea, mit, pour, erer, los. | Low |
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt out evenly where they come in few files."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


# --- panels over order lines ---------------------------------------------------

def opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as opinions of an order's panel, in a unique panel order."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("case_id"),
        F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice").alias("pos"),
        F.concat(F.lit("S"), F.col("l_linenumber")).alias("specialty"),
        (F.col("l_discount") * 10).alias("confidence"),
    )


def panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, capped and numbered as a review would send them out."""
    return cap_panel(opinions(spark, sf_dir))


def order_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"))


def panel_team(panel: DataFrame) -> DataFrame:
    """The team of a panel: its members in order, the first one leading."""
    return panel.select(
        "case_id", "pos", F.coalesce("specialty", F.lit(UNKNOWN_SPECIALTY)).alias("specialty"),
        F.concat(F.lit("listed at "), F.col("pos").cast("string")).alias("reason"),
        (F.col("pos") == 0).alias("is_lead"),
    )


def seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every answer with its seat and the specialty that was asked there.

    The lines are numbered before their answers are written out, so no text is shuffled.
    """
    seated = numbered(_answer_lines(spark, sf_dir))
    return _written(seated, F.concat(F.lit("S"), F.col("l_linenumber")).alias("asked"))


def asked_team(seated: DataFrame) -> DataFrame:
    """The team that was asked, whether its answers could be used or not."""
    return panel_team(seated.select("case_id", "pos", F.col("asked").alias("specialty")))


def panel_leads(panel: DataFrame) -> DataFrame:
    return panel_team(panel).where("is_lead")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as raw answers, broken in ways chosen by the supplier key."""
    return _written(_answer_lines(spark, sf_dir))


def _answer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spread(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice",
        "l_discount", "l_returnflag", "l_linestatus"))
    return line.select(
        F.col("l_orderkey").alias("case_id"),
        F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice").alias("pos"),
        "l_linenumber", "l_suppkey", "l_partkey", "l_discount", "l_returnflag", "l_linestatus")


def _written(line: DataFrame, *others: Column) -> DataFrame:
    """The raw answer of every line, by its case and position."""
    confidence = F.round(F.col("l_discount") * 10, 1).cast("decimal(3,1)")
    number = confidence.cast("string")
    name = F.concat(F.lit("S"), F.col("l_linenumber"))
    kind = F.col("l_suppkey") % 10

    def pair(key: str, value: Column | str) -> Column:
        return F.concat(F.lit(f'"{key}": '), F.lit(value) if isinstance(value, str) else value)

    def quoted(value: Column) -> Column:
        return F.concat(F.lit('"'), value, F.lit('"'))

    specialty = F.when(kind == 7, pair("specialty", "null")).when(
        kind != 5, pair("specialty", quoted(name)))
    findings = pair("findings", quoted(F.concat(
        F.lit("Item "), F.col("l_linenumber"), F.lit(" is "), "l_returnflag", F.lit(" "),
        "l_linestatus")))
    recommendation = pair("recommendation", quoted(
        F.when(F.col("l_partkey") % 2 == 0,
               F.concat(F.lit("Keep  "), "l_returnflag", "l_linestatus", F.lit(".")))
        .otherwise(F.concat(F.lit("keep "), F.lower(F.concat("l_returnflag", "l_linestatus"))))))
    # Kind 9 quotes a part that is not on the line.
    part = F.col("l_partkey") + (kind == 9).cast("bigint")
    quotes = F.when(kind == 8, pair("evidence_quotes", "[null]")).otherwise(
        pair("evidence_quotes", F.concat(F.lit('["part '), part, F.lit('"]'))))
    value = (
        F.when(kind == 1, pair("confidence", '"high"'))
        .when(kind == 2, pair("confidence", (confidence + 1).cast("string")))
        .when(kind == 4, pair("confidence", quoted(number)))
        .when(kind == 8, pair("confidence", "true"))
        .when(kind != 3, pair("confidence", number))
    )
    body = F.concat(
        F.lit("{"), F.concat_ws(", ", specialty, findings, recommendation, quotes, value),
        F.lit("}"),
    )
    raw = (
        F.when(kind == 0, F.concat(F.lit("No JSON from "), name))
        .when(kind == 6, F.concat(F.lit("["), body, F.lit("]")))
        .otherwise(body)
    )
    return line.select("case_id", "pos", raw.alias("raw"), *others)


def triage_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raw triage answers; the customer key chooses what is wrong."""
    order = table(spark, sf_dir, "orders")
    kind = F.col("o_custkey") % 6
    first = F.concat(F.lit('{"name": "'), F.col("o_orderpriority"), F.lit('", "reason": "due"}'))
    second = F.when(kind == 2, F.lit('{"name": "Second"}')).otherwise(
        F.lit('{"name": "Second", "reason": "more"}'))
    lead = F.when(kind == 1, F.lit('"lead_specialist": null, ')).when(
        kind.isin(0, 4), F.lit('"lead_specialist": "Second", ')).otherwise("")
    body = F.concat(
        F.lit('{"specialties": ['),
        F.when(kind == 4, "").otherwise(F.concat(first, F.lit(", "), second)),
        F.lit("], "), lead, F.lit('"rationale": "status '), F.col("o_orderstatus"), F.lit('"}'),
    )
    raw = F.when(kind == 5, F.concat(body, F.lit(" and more"))).otherwise(body)
    return order.select(F.col("o_orderkey").alias("case_id"), raw.alias("raw"))


def judge_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raw answers of a judge; the customer key chooses what is wrong."""
    kind = F.col("o_custkey") % 9
    status = F.col("o_orderstatus")
    summary = F.when(kind == 4, "null").otherwise(
        F.concat(F.lit('"status '), status, F.lit('"')))
    listed = (
        F.when(kind == 2, '"Keep"').when(kind == 5, "[null]")
        .when(kind == 6, F.concat(F.lit('["Keep '), status, F.lit('", 7]')))
        .otherwise(F.concat(F.lit('["Keep '), status, F.lit('", "Watch"]'))))
    found = F.when(kind == 7, "[null]").otherwise(
        F.concat(F.lit('["status '), status, F.lit('", "due"]')))
    findings = F.when(kind != 3, F.concat(
        F.lit('"key_findings_by_specialty": {"'), "o_orderpriority", F.lit('": '), found,
        F.lit(', "none": []}')))
    body = F.concat(F.lit("{"), F.concat_ws(
        ", ", F.concat(F.lit('"final_summary": '), summary), findings,
        F.concat(F.lit('"consolidated_recommendations": '), listed)), F.lit("}"))
    raw = F.when(kind == 0, "No ruling").when(
        kind == 1, F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("case_id"), raw.alias("raw"))


def safety_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as raw safety reports, broken in ways chosen by the supplier key."""
    line = spread(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_discount"))
    kind = F.col("l_suppkey") % 11
    number = F.round(F.col("l_discount") * 10, 1).cast("decimal(3,1)").cast("string")
    part = F.concat(F.lit("part "), "l_partkey")
    verified = F.when(kind != 9, F.concat(
        F.lit('"verified_findings": ["'), part, F.lit('", "counted"]')))
    issue = F.when(kind == 7, "").otherwise(', "issue": "not found"')
    flagged = F.when(kind == 8, '"none"').otherwise(F.concat(
        F.lit('[{"specialist": "S'), "l_linenumber", F.lit('", "claim": "'), part, F.lit('"'),
        issue, F.lit("}]")))
    confidence = F.when(kind == 5, F.concat(F.lit('"'), number, F.lit('"'))).when(
        kind == 6, '"high"').otherwise(number)
    safe = F.when(kind == 2, '"yes"').when(kind == 3, "0").when(kind == 4, '"maybe"').otherwise(
        "true")
    body = F.concat(F.lit("{"), F.concat_ws(
        ", ", verified, F.concat(F.lit('"flagged_issues": '), flagged),
        F.concat(F.lit('"final_summary": "line '), "l_linenumber", F.lit('"')),
        F.concat(F.lit('"overall_confidence": '), confidence),
        F.concat(F.lit('"is_safe": '), safe)), F.lit("}"))
    raw = F.when(kind == 0, "No report").when(
        kind == 1, F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    return line.select(
        F.col("l_orderkey").alias("case_id"),
        F.struct("l_linenumber", "l_suppkey", "l_partkey").alias("pos"), raw.alias("raw"))


def map_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as lines of a specialist map: a brand's indicators, one with a synonym."""
    lead = F.when(F.col("p_size") > 30, "High").when(F.col("p_size") > 15, "Medium").otherwise(
        "Low")
    line = F.concat(
        F.lit("| **"), "p_brand", F.lit("** | "), "p_name", F.lit(", item "), "p_partkey",
        F.lit(" (no "), "p_partkey", F.lit("), "), F.lower("p_type"), F.lit(". | "), lead,
        F.lit(" |"))
    heading = spark.range(1).select(F.explode(F.array(
        F.lit("| Specialty | Key Indicators | Lead Potential |"),
        F.lit("| :--- | :--- | :--- |"))).alias("value"))
    return heading.unionByName(table(spark, sf_dir, "part").select(line.alias("value")))


def panel_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as facts: the status each line gives for its return flag."""
    rows = spread(table(spark, sf_dir, "lineitem")).select(
        F.col("l_orderkey").alias("case_id"),
        F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice").alias("pos"),
        F.concat(F.lit("S"), F.col("l_linenumber")).alias("specialty"),
        F.col("l_returnflag").alias("attribute"), F.col("l_linestatus").alias("value"),
    )
    return numbered(rows)


# --- cases over documents ------------------------------------------------------

def case_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every five neighbouring documents are one case."""
    return texts(spark, sf_dir).select(
        F.floor(F.col("doc_id") / DOCS_PER_CASE).alias("case_id"),
        (F.col("doc_id") % DOCS_PER_CASE).cast("int").alias("pos"),
        "text",
    )


def questions(case_documents: DataFrame) -> DataFrame:
    """The first line of a case's first document is its question."""
    return case_documents.where(F.col("pos") == 0).select(
        "case_id", F.substring_index("text", "\n", 1).alias("question")
    )


def document_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with their documents nested; five each, by the way ids are cut."""
    docs = case_docs(spark, sf_dir)
    return nest_documents(docs).join(questions(docs), "case_id").select(
        "case_id", "question", "documents"
    )


def single_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a case of its own."""
    return texts(spark, sf_dir).select(
        F.col("doc_id").alias("case_id"), F.array("text").alias("documents")
    )


def line_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opinions quoting every line: each case's own, and the next case's."""
    docs = texts(spark, sf_dir).select(
        "doc_id",
        F.filter(F.split("text", "\n"), lambda line: F.trim(line) != "").alias("lines"),
    )

    def opinion(case_id: Column, pos: int, specialty: str) -> DataFrame:
        return docs.select(
            case_id.alias("case_id"), F.lit(pos).alias("pos"),
            F.lit(specialty).alias("specialty"), F.col("lines").alias("evidence_quotes"),
        )

    return opinion(F.col("doc_id"), 0, "Own").unionByName(
        opinion(F.col("doc_id") - 1, 1, "Next").where(F.col("case_id") >= 0)
    )


def line_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = line_quotes(spark, sf_dir).select(
        "case_id", "pos", F.col("specialty").alias("specialist"),
        F.posexplode("evidence_quotes").alias("quote_no", "claim"),
    )
    return quoted.select(
        "case_id", (F.col("quote_no") * 2 + F.col("pos")).alias("claim_no"), "specialist", "claim"
    )


# --- event log -----------------------------------------------------------------

def events(spark: SparkSession, sf_dir: str, largest_panel: int = 3) -> DataFrame:
    """User events as the event log of a case per user; spawns announce 1 to N."""
    raw = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    names = F.array_join(F.transform(
        F.sequence(F.lit(0), F.col("k") % 5),
        lambda i: F.concat(F.lit('"A'), i.cast("string"), F.lit('"'))), ", ")
    lead = F.when(F.col("k") % 4 == 0, "").otherwise(
        F.concat(F.lit("A"), (F.col("k") % 5).cast("string")))
    data = (
        F.when(kind == "signup", F.concat(
            F.lit('{"specialties": ['), names, F.lit('], "lead_specialist": "'), lead,
            F.lit('", "count": '), (F.col("k") % largest_panel + 1).cast("string"), F.lit("}")))
        .when(kind == "view", F.when(F.col("k") % 7 == 0, "{}").otherwise(
            F.concat(F.lit('{"message": "step '), F.col("k").cast("string"), F.lit('"}'))))
        .when(kind == "click", F.concat(
            F.lit('{"confidence": '), (F.col("k") % 11 / 10).cast("decimal(3,1)").cast("string"),
            F.lit("}")))
        .when(kind == "purchase", F.concat(
            F.lit('{"final_summary": "sum '), F.col("k").cast("string"), F.lit('"}')))
        .when(F.col("k") % 3 == 0, "{}")
        .otherwise(F.concat(F.lit('{"message": "failed at '), F.col("k").cast("string"),
                            F.lit('"}')))
    )
    return raw.withColumn("k", k).select(
        F.col("user_id").alias("case_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind == "signup", "specialists_spawned").when(kind == "view", "specialist_thinking")
        .when(kind == "click", "specialist_done").when(kind == "purchase", "judge_done")
        .when(kind == "error", "error").otherwise(kind).alias("type"),
        F.when(kind.isin("view", "click"),
               F.concat(F.lit("specialist_a"), (F.col("k") % 5).cast("string")))
        .when(kind == "purchase", "judge_agent").otherwise("").alias("agent_name"),
        data.alias("data"),
    )


# `seq` of the log is in microseconds; blocks of a minute spread a hot case.
EVENT_BLOCK = 60_000_000


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as draft tokens of the speaking role."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("case_id"), F.col("role").alias("agent_name"),
        F.col("turn").alias("seq"), F.col("text").alias("token"),
    )


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events as exceptions with a name and a message."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("k") % 8
    number = F.col("k").cast("string")
    return (
        table(spark, sf_dir, "events").where(F.col("event_type") == "error")
        .withColumn("k", k)
        .select(
            F.when(kind == 0, "AuthenticationError").when(kind == 1, "RateLimitError")
            .when(kind == 2, "APITimeoutError").otherwise("RuntimeError").alias("name"),
            F.when(kind == 3, F.concat(F.lit("Missing credentials for "), number))
            .when(kind == 4, F.concat(F.lit("Rate limit reached, connection "), number))
            .when(kind == 5, "Connection error.")
            .when(kind == 6, F.concat(F.lit("bad API key at connection "), number))
            .otherwise(F.concat(F.lit("step "), number)).alias("message"),
        )
    )
