"""Progress and answer streams with state by key.

Events of an answer may come in any order, and those of progress with lateness; without it they come in any order
within a micro-batch and in order between them. The state of a key is small: a number, or the answer so far. With idle_ms, keys idle for that long are
forgotten; such a stream runs batches without data too, so it never ends by itself (no availableNow).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.operators.catalog import progress_latest, progress_percent

#: Stands for a null seq or time: before all others.
_NO_SEQ = -(1 << 63)


def _timeout(idle_ms: int | None) -> str:
    return GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def _micros(events: DataFrame) -> Column:
    """Microseconds of ts; a number as it is. A timestamp without time zone is read by its fields, whatever the session's zone."""
    kind, ts = dict(events.dtypes)["ts"], F.col("ts")
    if kind == "timestamp":
        return F.unix_micros(ts)
    if kind != "timestamp_ntz":
        return ts.cast("long")
    day = F.datediff(ts, F.lit("1970-01-01").cast("date")).cast("long")
    return ((day * 24 + F.hour(ts)) * 60 + F.minute(ts)) * 60_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def latest_stream(events: DataFrame) -> DataFrame:
    """progress_latest of a stream, for update mode."""
    return progress_latest(events)


def throttle_stream(events: DataFrame, step: int = 5, idle_ms: int | None = None, lateness: str | None = None) -> DataFrame:
    """progress_throttle of a stream, for append mode: doc_id, event_id, percent of the updates to forward.

    What is forwarded depends on what was before. Without lateness, the events of a key come in order between
    micro-batches. With it (such as "10 minutes", ts being a timestamp) they come in any order: each is held until
    the watermark has passed it and taken in the order of (ts, event_id); events later than that are left out. The
    state then holds the events of that span, and keys stay (idle_ms goes without lateness only).
    """
    if idle_ms is not None and lateness is not None:
        raise ValueError("idle_ms is for streams without lateness")

    def forward(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut and lateness is None:
            state.remove()
            return
        last, *held = state.get if state.exists else (None, [], [], [], [])
        rows = list(zip(*held, strict=True))
        if not state.hasTimedOut:
            for f in frames:
                rows += zip(f["at"].tolist(), f["event_id"].tolist(), f["percent"].tolist(), f["final"].tolist(), strict=True)
        rows.sort()
        ready = len(rows) if lateness is None else bisect_right([r[0] for r in rows], state.getCurrentWatermarkMs() * 1000)
        keep = []
        for _, event, percent, final in rows[:ready]:
            if last is None or percent - last >= step or final:
                last = percent
                keep.append((key[0], event, percent))
        rest = rows[ready:]
        if last is not None or rest:
            state.update((last, *([r[i] for r in rest] for i in range(4))))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
            if rest:
                state.setTimeoutTimestamp(-(-rest[0][0] // 1000))
        yield pd.DataFrame(keep, columns=["doc_id", "event_id", "percent"])

    at = _micros(events)
    final = F.coalesce(F.col("processed") >= F.col("total"), F.lit(False))
    rows = progress_percent(events).select("doc_id", "event_id", F.col("percent").cast("int").alias("percent"), final.alias("final"), F.coalesce(at, F.lit(_NO_SEQ)).alias("at"), "ts")
    rows = rows if lateness is None else rows.withWatermark("ts", lateness)
    timeout = _timeout(idle_ms) if lateness is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("doc_id").applyInPandasWithState(forward, "doc_id long, event_id long, percent int", "last int, at array<long>, events array<long>, percents array<int>, finals array<boolean>", "append", timeout)


def assemble_stream(events: DataFrame, error_note: str = " [interrupted]", idle_ms: int | None = None) -> DataFrame:
    """answer_assembly of a stream (key, seq, type, data), for update mode: key, content, citations, finish_reason as they stand after each micro-batch.

    Events of a key may come in any order, also between micro-batches: the state holds its tokens by seq, the last
    citations with their seq, whether it failed and its finish reason, as much as the answer that is given each time.
    A key without content and citations gives no row. Answers stay after they are done, so that late tokens
    find their places; with idle_ms they are forgotten when nothing has come for that long, without it never.
    """

    def text(v: Any) -> str | None:
        return None if v is None or v != v else v

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seqs, tokens, cited, citations, failed, reason = state.get if state.exists else ([], [], None, None, False, None)
        parts = list(zip(seqs, tokens, strict=True))
        for rows in frames:
            for seq, kind, data in zip(rows["seq"].tolist(), rows["type"].tolist(), map(text, rows["data"].tolist()), strict=True):
                if kind == "token":
                    parts.append((seq, data or ""))
                elif kind == "citation" and seq != _NO_SEQ and (cited is None or (seq, data or "") > (cited, citations or "")):
                    cited, citations = seq, data
                elif kind == "error":
                    failed = True
                elif kind == "done" and data is not None:
                    reason = data if reason is None else max(reason, data)
        # Tokens of one seq are ordered by themselves, as in answer_assembly.
        parts.sort()
        state.update(([p[0] for p in parts], [p[1] for p in parts], cited, citations, failed, reason))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        content = "".join(p[1] for p in parts) + (error_note if failed else "")
        if content or citations is not None:
            yield pd.DataFrame({"key": [key[0]], "content": [content], "citations": [citations], "finish_reason": [reason]})

    rows = events.select("key", F.coalesce(F.col("seq").cast("long"), F.lit(_NO_SEQ)).alias("seq"), "type", "data")
    kind = dict(rows.dtypes)["key"]
    return rows.groupBy("key").applyInPandasWithState(fold, f"key {kind}, content string, citations string, finish_reason string", "seqs array<long>, tokens array<string>, cited long, citations string, failed boolean, reason string", "update", _timeout(idle_ms))
