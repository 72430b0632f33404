"""Event traces as process models.

A trace is one user's events in one ISO week.  Every event is a task whose
label is its event type, consecutive events (by ``ts, event_id``) form a
sequence flow, and the first / last event are linked to a start / end event.
A pair is a trace and the same user's next active week, so the number of
pairs is linear in the number of traces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowmatch.operators.sequence import with_successor

# The labels a trace's start and end events carry.
START_NAME, END_NAME = "start", "end"
START_TYPE, END_TYPE = "StartNoneEvent", "EndNoneEvent"
TASK_TYPE = "User"


def trace_events(events: DataFrame) -> DataFrame:
    """(user_id, week DATE, ts, event_id, event_type) -- only the needed columns."""
    return events.select(
        "user_id",
        F.to_date(F.date_trunc("week", F.col("ts"))).alias("week"),
        "ts", "event_id", "event_type")


def trace_steps(events: DataFrame, bucket_unit: str = "hour") -> tuple[DataFrame, DataFrame]:
    """Events with the next event type of their trace, plus bucket heads."""
    ev = trace_events(events)
    return with_successor(ev, ["user_id", "week"], ["ts", "event_id"], ["event_type"],
                          bucket=F.date_trunc(bucket_unit, F.col("ts")))


def model_key(week_col: str = "week") -> F.Column:
    return F.struct(F.col("user_id"), F.col(week_col).alias("week"))


def trace_labels(events: DataFrame, bucket_unit: str = "hour") -> DataFrame:
    """Long label table (model_id, category, label) of every trace (M2)."""
    steps, heads = trace_steps(events, bucket_unit)
    flow = F.concat(F.col("event_type"), F.lit("  "),
                    F.coalesce(F.col("next_event_type"), F.lit(END_NAME)))
    per_event = steps.select(
        model_key().alias("model_id"),
        F.inline(F.array(
            F.struct(F.lit("task_names").alias("category"), F.col("event_type").alias("label")),
            F.struct(F.lit("task_types").alias("category"), F.lit(TASK_TYPE).alias("label")),
            F.struct(F.lit("seq_flows").alias("category"), flow.alias("label")))))
    per_trace = heads.where("is_first_bucket").select(
        model_key().alias("model_id"),
        F.inline(F.array(
            F.struct(F.lit("seq_flows").alias("category"),
                     F.concat(F.lit(START_NAME + "  "), F.col("event_type")).alias("label")),
            F.struct(F.lit("event_names").alias("category"), F.lit(START_NAME).alias("label")),
            F.struct(F.lit("event_names").alias("category"), F.lit(END_NAME).alias("label")),
            F.struct(F.lit("event_types").alias("category"), F.lit(START_TYPE).alias("label")),
            F.struct(F.lit("event_types").alias("category"), F.lit(END_TYPE).alias("label")))))
    return per_event.unionByName(per_trace)


def traces(events: DataFrame) -> DataFrame:
    """Distinct (user_id, week) traces (partial aggregate, skew-safe)."""
    return trace_events(events).select("user_id", "week").distinct()


def next_week_pairs(events: DataFrame) -> DataFrame:
    """(user_id, week, next_week, m1, m2): a trace and the user's next active week.

    The window runs over traces, not events: at most one row per user-week.
    """
    w = Window.partitionBy("user_id").orderBy("week")
    p = (traces(events).withColumn("next_week", F.lead("week").over(w))
         .where(F.col("next_week").isNotNull()))
    return p.select("user_id", "week", "next_week",
                    model_key("week").alias("m1"), model_key("next_week").alias("m2"))


# Ids of the synthetic start and end nodes of a trace text.
START_ID, END_ID = "-1", "-2"


def trace_lines(events: DataFrame, bucket_unit: str = "hour") -> DataFrame:
    """A trace written in the model-text grammar, one row per line:
    (model_id, line_no, line).  No trace is gathered into one string: each
    event writes the line of its outgoing flow, the first event also the
    start line.  ``line_no`` is (0,,) for the start line, (1, ts, event_id)
    for event lines, so it sorts in trace order."""
    ev = trace_events(events)
    steps, heads = with_successor(ev, ["user_id", "week"], ["ts", "event_id"],
                                  ["event_id", "event_type"],
                                  bucket=F.date_trunc(bucket_unit, F.col("ts")))
    node = lambda i, t: F.concat(i.cast("string"), F.lit(":task:("), t, F.lit(")"))
    nxt = F.when(F.col("next_event_id").isNull(), F.lit(END_ID + ":endevent:((endevent))")) \
           .otherwise(node(F.col("next_event_id"), F.col("next_event_type")))
    body = steps.select(
        model_key().alias("model_id"),
        F.struct(F.lit(1).alias("r"), F.col("ts"), F.col("event_id")).alias("line_no"),
        F.concat(node(F.col("event_id"), F.col("event_type")), F.lit("-->"), nxt).alias("line"))
    start = heads.where("is_first_bucket").select(
        model_key().alias("model_id"),
        F.struct(F.lit(0).alias("r"), F.lit(None).cast(ev.schema["ts"].dataType).alias("ts"),
                 F.lit(None).cast("long").alias("event_id")).alias("line_no"),
        F.concat(F.lit(START_ID + ":startevent:((startevent))-->"),
                 node(F.col("event_id"), F.col("event_type"))).alias("line"))
    return body.unionByName(start)
