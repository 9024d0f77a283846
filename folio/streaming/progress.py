"""Progress and status from append-only events, in batch and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

#: How far a page is, in percent, at each stage.
STAGE_PERCENT = {
    "Thinking": 2, "Using tool": 4, "Resuming": 4, "Resuming saved page": 5, "Reading complete page": 6, "Agent surveying page": 6, "Preprocessing": 9,
    "Preprocessing complete": 13, "Discovering articles and headings": 10, "Building article columns": 18, "Detected reading regions": 24, "Layout complete": 96,
    "Terra checking article inventory": 52, "Sol inspecting Terra findings": 58, "Independent Sol verification": 64, "Independent reads agree": 80,
    "Sol resolving text disagreements": 82, "Possible truncation detected": 83, "Verifying proposed text edits": 87, "Text disagreement resolved": 91,
    "Reconstructing document": 92, "Saved Markdown": 95, "Agentic layout complete": 96, "Agentic page complete": 96,
}
#: Stages with a fraction in their detail, and the percents between which it counts.
FRACTION_STAGES = {s: (30.0, 72.0) for s in ("Transcribing regions", "Terra adjudicating regions", "Sol resolving regions", "Recovered region", "Resolved line crop")} | {"Independent article read": (64.0, 79.0)}
#: The most before the end, a job's first stage if it is none of these, the start of a page, and saved articles: the first, each further one, the most.
MOST, UNKNOWN, PAGE, SAVED = 96.0, 6.0, 2.0, (10.0, 4.0, 49.0)
_FRACTION = r"\b(\d+)\s*/\s*(\d+)\b"

STATE = "page_index double, page_total double, page_percent double, percent double"
OUTPUT = "job_id string, seq bigint, stage string, detail string, percent double, estimated boolean"


def progress_batch(events: DataFrame) -> DataFrame:
    """(job_id, seq, stage, detail, percent, estimated) of (job_id, seq, stage, detail): the progress after each event, which never falls.

    Each event has a percent of its page: by its stage, or by the fraction or number in its detail. A page is as far as its furthest event; an event
    named Page with n/m starts page n of m anew if n is greater than the last. A job is as far as its pages before this one and the part of this one, MOST percent at
    most, until an event Complete without detail ends it. All of it is window functions over a job's events; stages come from a joined table.
    """
    known = [(s, float(p), None, None) for s, p in STAGE_PERCENT.items()] + [(s, None, low, high) for s, (low, high) in FRACTION_STAGES.items()] + [("Page", PAGE, None, None), ("Complete", MOST, None, None)]
    stages = events.sparkSession.createDataFrame(known, "stage string, fixed double, low double, high double")
    detail = F.coalesce("detail", F.lit(""))
    part = [F.regexp_extract(detail, _FRACTION, i).try_cast("double") for i in (1, 2)]
    saved = F.coalesce(F.regexp_extract(detail, r"^\s*(\d+)", 1).try_cast("double"), F.lit(1.0))
    rows = events.join(F.broadcast(stages), "stage", "left").select("job_id", "seq", "stage", "detail", "fixed", "low", "high", part[0].alias("a"), part[1].alias("b"), saved.alias("saved"))
    order = Window.partitionBy("job_id").orderBy("seq")
    ended = (F.col("stage") == "Complete") & (detail == "")
    paged = (F.col("stage") == "Page") & F.col("a").isNotNull()
    index = F.coalesce(F.last(F.when(paged, F.greatest(F.lit(1.0), "a")), True).over(order), F.lit(1.0))
    total = F.coalesce(F.last(F.when(paged, F.greatest(F.lit(1.0), "a", "b")), True).over(order), F.lit(1.0))
    rows = rows.withColumns({"ended": F.coalesce(ended, F.lit(False)), "index": index, "total": total})
    rows = rows.withColumns({"anew": (paged & (F.col("index") > F.lag("index", 1, 1.0).over(order))).cast("int"), "begun": F.count_if(~F.col("ended")).over(order)})
    share = F.least(F.lit(1.0), F.when(F.col("b") > 0, F.col("a") / F.col("b")).otherwise(F.lit(0.0)))
    now = F.when(F.col("stage") == "Article saved", F.least(F.lit(SAVED[2]), SAVED[0] + SAVED[1] * F.col("saved"))).when(F.col("low").isNotNull(), F.col("low") + (F.col("high") - F.col("low")) * F.coalesce(share, F.lit(0.0))).when(F.col("fixed").isNotNull(), F.col("fixed"))
    now = F.when(~F.col("ended"), F.coalesce(now, F.when(F.col("begun") == 1, F.lit(UNKNOWN))))
    rows = rows.withColumn("page_no", F.sum(F.coalesce("anew", F.lit(0))).over(order)).withColumn("now", now)
    page = F.coalesce(F.max("now").over(Window.partitionBy("job_id", "page_no").orderBy("seq")), F.lit(0.0))
    reached = F.when(F.col("ended"), F.lit(100.0)).otherwise(F.bround(F.least(F.lit(MOST), MOST * (F.col("index") - 1 + page / 100.0) / F.col("total")), 1))
    return rows.withColumn("reached", reached).select("job_id", "seq", "stage", "detail", F.max("reached").over(order).alias("percent"), (~F.col("ended")).alias("estimated"))


def continued(rows: pd.DataFrame, index: float, total: float, page: float | None, percent: float) -> tuple[pd.DataFrame, tuple]:
    """The same for further events of one job, in order, from where it was; and where it is then. Columns at a time, as in the batch."""
    stage, detail = rows["stage"], rows["detail"].fillna("")
    part = detail.str.extract(_FRACTION).astype("float64")
    ended = (stage == "Complete") & (detail == "")
    paged = (stage == "Page") & part[0].notna()
    at = part[0].clip(lower=1.0).where(paged).ffill().fillna(index)
    of = part.max(axis=1).clip(lower=1.0).where(paged).ffill().fillna(total)
    anew = (paged & (at > at.shift(fill_value=index))).cumsum()
    saved = (SAVED[0] + SAVED[1] * detail.str.extract(r"^\s*(\d+)")[0].astype("float64").fillna(1.0)).clip(upper=SAVED[2])
    low, high = (stage.map({s: x[k] for s, x in FRACTION_STAGES.items()}).astype("float64") for k in (0, 1))
    share = (part[0] / part[1].where(part[1] > 0)).clip(upper=1.0).fillna(0.0)
    now = stage.map({**STAGE_PERCENT, "Page": PAGE, "Complete": MOST}).astype("float64").fillna(low + (high - low) * share)
    now = now.where(stage != "Article saved", saved).where(~ended)
    first = (~ended).cumsum() == 1
    if page is None:
        now = now.where(now.notna() | ended | ~first, UNKNOWN)
    so_far = now.groupby(anew).cummax().groupby(anew).ffill()
    so_far = so_far.where(anew > 0, so_far.fillna(0.0).clip(lower=page or 0.0)).fillna(0.0)
    reached = (MOST * (at - 1 + so_far / 100.0) / of).clip(upper=MOST).round(1).where(~ended, 100.0).cummax().clip(lower=percent)
    out = pd.DataFrame({"seq": rows["seq"], "stage": stage, "detail": rows["detail"], "percent": reached, "estimated": ~ended})
    none_yet = page is None and bool(ended.all())
    return out, (float(at.iloc[-1]), float(of.iloc[-1]), None if none_yet else float(so_far.iloc[-1]), float(reached.iloc[-1]))


def _fold(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
    state = tuple(group.get) if group.exists else (1.0, 1.0, None, 0.0)
    out, state = continued(pd.concat(list(batches)).sort_values("seq").reset_index(drop=True), *state)
    group.update(state)
    yield out.assign(job_id=key[0])[["job_id", "seq", "stage", "detail", "percent", "estimated"]]


def progress_stream(events: DataFrame) -> DataFrame:
    """A stream of (job_id, seq, stage, detail) with the progress after each event; the state of a job is four numbers."""
    return events.groupBy("job_id").applyInPandasWithState(_fold, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def instant(text: Column) -> Column:
    """A time given as ISO text with or without zone, with T or a blank, or as seconds or milliseconds; null for others. Without a zone it is UTC."""
    number = F.when(text.rlike(r"^\d{9,10}(\.\d+)?$"), F.timestamp_micros((text.cast("double") * 1_000_000).cast("bigint"))).when(text.rlike(r"^\d{12,13}$"), F.timestamp_millis(F.try_to_number(text, F.lit("9999999999999")).cast("bigint")))
    return F.coalesce(number, F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("dd.MM.yyyy HH:mm:ss")), F.try_to_timestamp(text, F.lit("dd.MM.yyyy HH:mm")))


def current_status(events: DataFrame) -> DataFrame:
    """(scan_id, status, event_id): the stage of each scan's last event if that is complete, else stage_status. Works as a stream too, in complete mode."""
    state = F.lower(F.trim(F.coalesce("status", F.lit("unknown"))))
    named = F.when(state == "complete", F.col("stage")).otherwise(F.concat_ws("_", F.col("stage"), state))
    return events.groupBy("scan_id").agg(F.max_by(named, F.col("event_id")).alias("status"), F.max("event_id").alias("event_id"))


def running_steps(events: DataFrame) -> DataFrame:
    """(scan_id, event_id, done): how many different stages were complete up to each event; it never falls."""
    order = Window.partitionBy("scan_id").orderBy("event_id")
    complete = F.lower(F.trim("status")) == "complete"
    first = F.row_number().over(Window.partitionBy("scan_id", "stage", F.coalesce(complete, F.lit(False))).orderBy("event_id")) == 1
    once = events.select("scan_id", "event_id", "stage", "status").distinct()
    marked = once.withColumn("__new", F.when(complete & first, 1).otherwise(0))
    return marked.select("scan_id", "event_id", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("done"))


def windowed_counts(events: DataFrame, time: str, length: str, late: str | None = None) -> DataFrame:
    """(window_start, stage, n) in tumbling windows; with `late`, a stream's windows close that long after their end."""
    df = events.withWatermark(time, late) if late else events
    return df.groupBy(F.window(time, length).alias("w"), "stage").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "stage", "n")
