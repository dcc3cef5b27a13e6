"""Stateful stream operators: flood baselines and finding deduplication.

Both are stateful processors whose state lives in the state store (RocksDB, so it may outgrow
memory) and is dropped by timers in event time: a key that falls silent is forgotten when the
watermark has passed its last sight by ``forget_days``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wiretally.config import FloodConfig
from wiretally.functions.formats import SEVERITY_LADDER
from wiretally.operators.floods import judge

_SCORED = (
    "dst string, window_start timestamp, baseline_size int, pkt_z double, byte_z double, "
    "entropy_z double, flagged boolean"
)
_CHANGED = "fingerprint string, ts timestamp, score double, severity string, change_status string"
_DAY_MS = 24 * 3600 * 1000


def _milliseconds(ts: pd.Timestamp) -> int:
    return int(ts.timestamp() * 1000)


class _Forgetful(StatefulProcessor):
    """One timer per key, moved on by every sight; what ``states`` names is cleared when it fires."""

    states: tuple[str, ...] = ()

    def __init__(self, forget_days: float):
        self.forget_ms = int(forget_days * _DAY_MS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def seen(self, newest: pd.Timestamp, watermark_ms: int) -> None:
        """Put the timer ``forget_ms`` after the newest sight; it never moves back."""
        due = max(_milliseconds(newest), watermark_ms) + self.forget_ms
        pending = list(self.handle.listTimers())
        if pending and max(pending) >= due:
            return
        for timer in pending:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for name in self.states:
            getattr(self, name).clear()
        yield from ()

    def close(self) -> None:
        pass


class FloodBaselines(_Forgetful):
    """Clean history of a destination as a list state: at most ``baseline_windows`` windows."""

    states = ("history",)

    def __init__(self, cfg: FloodConfig, forget_days: float):
        super().__init__(forget_days)
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.history = handle.getListState("history", "pkt double, byte double, entropy double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = list(self.history.get()) if self.history.exists() else []
        history = [deque(values, maxlen=self.cfg.baseline_windows) for values in zip(*kept)] or [
            deque(maxlen=self.cfg.baseline_windows) for _ in range(3)
        ]
        pdf = pd.concat(list(rows)).sort_values("window_start", kind="stable")
        scored = [
            judge(history, (p, b, e), f, self.cfg)
            for p, b, e, f in zip(pdf.pkt_rate, pdf.byte_rate, pdf.src_ip_entropy, pdf.flow_count)
        ]
        learned = [tuple(map(float, window)) for window in zip(*history)]
        if learned:
            self.history.put(learned)
        self.seen(pdf.window_start.max(), timerValues.getCurrentWatermarkInMs())
        out = pd.DataFrame(scored, columns=["baseline_size", "pkt_z", "byte_z", "entropy_z", "flagged"])
        out.insert(0, "window_start", pdf.window_start.to_numpy())
        out.insert(0, "dst", key[0])
        yield out


def stream_flood_scores(
    windows: DataFrame, cfg: FloodConfig = FloodConfig(), lateness: str = "1 hour", forget_days: float = 30
) -> DataFrame:
    """Score finished flow windows as they arrive.

    State per destination is its clean history. Windows must arrive in time order between
    batches, as windows closed by a watermark do; inside a batch they are sorted. A window
    later than the watermark is dropped.
    """
    return (
        windows.select("dst", "window_start", "flow_count", "pkt_rate", "byte_rate", "src_ip_entropy")
        .withWatermark("window_start", lateness)
        .groupBy("dst")
        .transformWithStateInPandas(FloodBaselines(cfg, forget_days), _SCORED, "Append", "EventTime")
    )


class ChangedFindings(_Forgetful):
    """Last emitted score and severity of a finding as a value state."""

    states = ("last",)

    def __init__(self, delta: float, forget_days: float):
        super().__init__(forget_days)
        self.delta = delta
        self.rank = {name: i for i, name in enumerate(SEVERITY_LADDER)}

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "score double, severity string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = tuple(self.last.get()) if self.last.exists() else None
        found = [row for pdf in rows for row in zip(pdf.ts, pdf.score, pdf.severity)]
        emitted = []
        for ts, score, severity in sorted(found):
            escalated = last is not None and self.rank.get(severity, -1) > self.rank.get(last[1], -1)
            raised = last is not None and round(score - last[0], 9) >= self.delta
            if last is None or escalated or raised:
                status = "new_finding" if last is None else "materially_changed"
                emitted.append((key[0], ts, float(score), severity, status))
                last = (float(score), severity)
        self.last.update(last)
        self.seen(max(row[0] for row in found), timerValues.getCurrentWatermarkInMs())
        if emitted:
            yield pd.DataFrame(emitted, columns=["fingerprint", "ts", "score", "severity", "change_status"])


def stream_dedup(
    found: DataFrame, delta: float = 0.15, forget_days: float = 14, lateness: str = "1 hour"
) -> DataFrame:
    """Emit a finding when new or materially changed (columns fingerprint, ts, score,
    severity). A fingerprint not seen for ``forget_days`` of event time is forgotten and
    new again when it returns."""
    return (
        found.withWatermark("ts", lateness)
        .groupBy("fingerprint")
        .transformWithStateInPandas(ChangedFindings(delta, forget_days), _CHANGED, "Append", "EventTime")
    )
