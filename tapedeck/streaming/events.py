"""Classified plays from a stream of polls: what `derive_play_events` gives for a table, with one listener's state at a time."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tapedeck.operators.events import JITTER_MS, LEAST_MS

OUT = "user_id long, track_id string, started_at timestamp, ended_at timestamp, duration_listened_ms long, track_duration_ms long, classification string"
#: Places of a poll's values in the state.
AT, ID, ON, TRACK, PROGRESS, DURATION = range(6)


def _fell(last: list, poll: list) -> bool:
    return last[TRACK] == poll[TRACK] and last[PROGRESS] is not None and poll[PROGRESS] is not None and poll[PROGRESS] < last[PROGRESS] - JITTER_MS


def _event(start: list, last: list, poll: list) -> list | None:
    """track, start, end, listened, duration and class of the run from start to last that poll ends."""
    listened, duration = (poll[AT] - start[AT]) // 1000, last[DURATION] or 0
    if listened < LEAST_MS:
        return None
    done = (last[PROGRESS] or 0) / duration >= 0.8 if duration > 0 else listened > 60_000
    kind = "replayed" if _fell(last, poll) else "completed" if done else "abandoned"
    return [start[TRACK], start[AT], poll[AT], listened, duration or None, kind]


def _advance(s: dict, polls: list[list]) -> list[list]:
    """Events that polls, in order, settle; s holds the open run (start, last) and an abandoned event that may yet go."""
    out = []
    for p in polls:
        on = p[ON] and p[TRACK] is not None
        if s["run"]:
            start, last = s["run"]
            if on and p[TRACK] == last[TRACK] and not _fell(last, p):
                s["run"] = [start, p]
                continue
            if e := _event(start, last, p):
                if s["pending"] and s["pending"][0] != e[0]:
                    out.append(s["pending"])
                s["pending"] = e if e[5] == "abandoned" else None
                if not s["pending"]:
                    out.append(e)
        s["run"] = [p, p] if on else None
    return out


def _value(v):
    return None if pd.isna(v) else v


def stream_play_events(polls: DataFrame, *, watermark: str = "10 minutes", settle_hours: int = 24) -> DataFrame:
    """Events of each user_id. A poll counts once the watermark has passed it, so that polls may come out of order by that
    much; an abandoned event is held until the next event, or settle_hours, without polls, tells whether its track went on."""
    settle = settle_hours * 3_600_000_000

    def run(key, frames, state):
        s = json.loads(state.get[0]) if state.exists else {"run": None, "pending": None, "wait": []}
        for f in frames:
            at = f["observed_at"].astype("datetime64[us]").astype("int64")
            rows = zip(at, f["poll_id"], f["is_playing"], f["track_id"], f["progress_ms"], f["duration_ms"], strict=True)
            s["wait"] += [[int(a), int(i), bool(on), _value(t), *(None if pd.isna(x) else int(x) for x in (p, d))] for a, i, on, t, p, d in rows]
        now = state.getCurrentWatermarkMs() * 1000
        s["wait"].sort(key=lambda p: (p[AT], p[ID]))
        ready = [p for p in s["wait"] if p[AT] <= now]
        s["wait"] = s["wait"][len(ready) :]
        out = _advance(s, ready)
        quiet = max([s["pending"][2] if s["pending"] else 0] + ([s["run"][1][AT]] if s["run"] else [])) + settle
        if s["pending"] and quiet <= now:
            out.append(s["pending"])
            s["pending"] = None
        if s["run"] or s["pending"] or s["wait"]:
            state.update((json.dumps(s),))
            times = [p[AT] for p in s["wait"][:1]] + ([quiet] if s["pending"] else [])
            if times:
                state.setTimeoutTimestamp(max(min(times), now) // 1000 + 1)
        elif state.exists:
            state.remove()
        if out:
            df = pd.DataFrame(out, columns=["track_id", "started_at", "ended_at", "duration_listened_ms", "track_duration_ms", "classification"])
            for c in ("started_at", "ended_at"):
                df[c] = pd.to_datetime(df[c], unit="us")
            df["track_duration_ms"] = df["track_duration_ms"].astype("Int64")
            df.insert(0, "user_id", key[0])
            yield df

    p = polls.select(F.col("user_id").cast("long").alias("user_id"), "observed_at", "poll_id", "is_playing", "track_id", "progress_ms", "duration_ms")
    return p.withWatermark("observed_at", watermark).groupBy("user_id").applyInPandasWithState(run, OUT, "json string", "append", GroupStateTimeout.EventTimeTimeout)
