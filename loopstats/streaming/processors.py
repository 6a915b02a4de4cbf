"""Stateful processors: a counter and a cooldown per model, a running spend and the item states per task."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def _in_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    rows = pd.concat(list(frames), ignore_index=True)
    return rows.sort_values(["created_at", "id"], ignore_index=True)


class ModelHealth(StatefulProcessor):
    """Failures since the last success, per model, and the end of its cooldown.

    The state is the number of failures and the cooldown at work. A timer stands at its end; a later call moves it
    (another failure) or takes it away (a success). A call that comes after the end says so before its own row.
    """

    def __init__(self, threshold: int, cooldown_seconds: int):
        self.threshold, self.cooldown = threshold, pd.Timedelta(seconds=cooldown_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("health", "failures bigint, until bigint")  # until: microseconds, 0 for none

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        calls = _in_order(rows)
        carried, until = self.state.get() if self.state.exists() else (0, 0)
        ok = calls["success"].astype(bool)
        run = (~ok).astype("int64").groupby(ok.cumsum()).cumsum()
        run = run + carried * (ok.cumsum() == 0)
        sick = run >= self.threshold
        cooldown = (calls["created_at"] + self.cooldown).where(sick)
        health = pd.Series("degraded", index=run.index).mask(run == 0, "healthy").mask(sick, "unhealthy")
        # the cooldown that each call finds at work, and whether it has run out by then
        found = cooldown.shift(1)
        failed = run.shift(1)
        if until:
            found.iloc[0], failed.iloc[0] = _instant(until), carried
            self.handle.deleteTimer(_timer(until))
        over = (found <= calls["created_at"]).fillna(False)
        last = cooldown.iloc[-1]
        until = 0 if pd.isna(last) else int(last.value // 1000)
        self.state.update((int(run.iloc[-1]), until))
        if until:
            self.handle.registerTimer(_timer(until))
        if over.any():
            yield _eligible(key[0], found[over], failed[over])
        yield pd.DataFrame(
            {
                "id": calls["id"],
                "model": key[0],
                "success": ok,
                "created_at": calls["created_at"],
                "failure_count": run,
                "health_status": health,
                "cooldown_until": cooldown,
            }
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        failures, until = self.state.get() if self.state.exists() else (0, 0)
        if until and _timer(until) <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.update((failures, 0))
            yield _eligible(key[0], pd.Series([_instant(until)]), pd.Series([failures]))

    def close(self) -> None:
        pass


def _instant(micros: int) -> pd.Timestamp:
    return pd.Timestamp(micros * 1000)


def _timer(micros: int) -> int:
    """Timers are in milliseconds; the first not before the instant."""
    return -(-micros // 1000)


def _eligible(model, at: pd.Series, failures: pd.Series) -> pd.DataFrame:
    """Rows without a call: the model may be called again from `created_at` on."""
    n = len(at)
    return pd.DataFrame(
        {
            "id": pd.array([None] * n, "Int64"),
            "model": model,
            "success": pd.array([None] * n, "boolean"),
            "created_at": at.astype("datetime64[ns]").to_numpy(),
            "failure_count": failures.astype("int64").to_numpy(),
            "health_status": "eligible",
            "cooldown_until": at.astype("datetime64[ns]").to_numpy(),
        }
    )


class BudgetAlert(StatefulProcessor):
    """First call at which a task's spend reaches the budget of that call; a budget of 0 is none.

    A task's state ends `ttl_ms` after its last call; None: never.
    """

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spent = handle.getValueState("spent", "spent double, alerted boolean", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        calls = _in_order(rows)
        before, alerted = self.spent.get() if self.spent.exists() else (0.0, False)
        total = before + calls["cost"].fillna(0.0).cumsum()
        reached = (calls["budget"] > 0) & (total.round(6) >= calls["budget"])
        over = total[reached].round(6)
        self.spent.update((float(total.iloc[-1]), bool(alerted or len(over))))
        if len(over) and not alerted:
            at = over.index[0]
            yield pd.DataFrame(
                {
                    "task_id": [key[0]],
                    "id": [calls["id"][at]],
                    "spent": [over[at]],
                    "created_at": [calls["created_at"][at]],
                }
            )

    def close(self) -> None:
        pass


class TaskProgress(StatefulProcessor):
    """Latest status per item of a task, and the number of items in each status.

    State ends `ttl_ms` after its last change, so that must outlast the longest task; None: never.
    """

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    COUNTED = ("succeeded", "failed", "awaiting_review", "cancelled")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getMapState("items", "item_index int", "status string, at timestamp", self.ttl_ms)
        counts = ", ".join(f"{s} bigint" for s in ("total", *self.COUNTED))
        self.counts = handle.getValueState("counts", counts, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = ("total", *self.COUNTED)
        counts = dict(zip(names, self.counts.get() if self.counts.exists() else [0] * len(names)))
        moves = pd.concat(list(rows), ignore_index=True).sort_values("updated_at")
        newest = moves.drop_duplicates("item_index", keep="last")
        for index, status, at in zip(newest["item_index"], newest["status"], newest["updated_at"]):
            item = (int(index),)
            was, since = self.items.getValue(item) if self.items.containsKey(item) else (None, None)
            if since is not None and pd.Timestamp(since).tz_localize(None) > at:
                continue
            counts["total"] += since is None
            if was in counts:
                counts[was] -= 1
            if status in counts:
                counts[status] += 1
            self.items.updateValue(item, (status, at.to_pydatetime()))
        self.counts.update(tuple(int(counts[n]) for n in names))
        yield pd.DataFrame({"task_id": [key[0]], **{n: [counts[n]] for n in names}})

    def close(self) -> None:
        pass
