"""A ledger of paid calls that holds across tasks, runs and processes.

Reservations are files in a folder that driver and executors share as a mounted
path (JSON, one a reservation, put in place by a rename), so the ledger survives
restarts and Spark reads it as a table. Calls are reserved before they are made
and stay charged if they fail. The driver reserves for all partitions of a
read before they are planned, under a lock, so two processes can't both pass
the check; a partition then claims each of its calls by creating a file, so a
task that Spark runs again, or a plan that is run twice, makes no second call.
Over-counting is the safe direction: a plan that is never run has been charged.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

from .providers import BudgetExceeded

#: Seconds after which a lock is taken for one that its owner left behind.
STALE = 60.0


@dataclass(frozen=True)
class Limits:
    daily: int
    monthly: int
    cost_per_call: float = 0.0


@dataclass(frozen=True)
class Usage:
    daily_calls: int
    monthly_calls: int
    monthly_cost: float


def _utc() -> datetime:
    return datetime.now(timezone.utc)


class Ledger:
    """Calls of providers by UTC day, in a folder."""

    def __init__(self, folder: str, clock: Callable[[], datetime] = _utc):
        self.folder, self.clock = Path(folder.removeprefix("file://")), clock

    @contextmanager
    def _locked(self, patience: float = 30.0):
        self.folder.mkdir(parents=True, exist_ok=True)
        lock, until = self.folder / "lock", time.monotonic() + patience
        while True:
            try:
                os.close(os.open(lock, os.O_CREAT | os.O_EXCL))
                break
            except FileExistsError:
                try:
                    if time.time() - lock.stat().st_mtime > STALE:
                        lock.rename(self.folder / f"stale-{uuid.uuid4().hex}")
                        continue
                except FileNotFoundError:
                    continue
                if time.monotonic() > until:
                    raise TimeoutError(f"{lock} is held by another process") from None
                time.sleep(0.02)
        try:
            yield
        finally:
            lock.unlink(missing_ok=True)

    def usage(self, provider: str) -> Usage:
        """What is spent today and this month, reservations included."""
        day = self.clock().strftime("%Y-%m-%d")
        today = month = 0
        cost = 0.0
        for f in (self.folder / "reservations" / day[:7]).glob("*.json"):
            r = json.loads(f.read_text())
            if r["provider"] == provider:
                month += r["calls"]
                cost += r["cost"]
                today += r["calls"] * (r["day"] == day)
        return Usage(today, month, cost)

    def reserve(self, provider: str, calls: Sequence[int], limits: Limits, whole: bool = False) -> list[bool]:
        """Which of some requests, in order, fit into what is left; what fits is charged at once. whole: all or none, and none raises."""
        if any(c < 0 or c != int(c) for c in calls):
            raise ValueError(f"{provider}: calls must be whole numbers from 0 on")
        with self._locked():
            used, now = self.usage(provider), self.clock()
            left = min(limits.daily - used.daily_calls, limits.monthly - used.monthly_calls)
            fits, total = [], 0
            for c in calls:
                fits.append(c <= left - total)
                total += c if fits[-1] else 0
            if whole and not all(fits):
                raise BudgetExceeded(f"{provider}: {sum(calls)} calls pass the limit of {limits.daily} a day or {limits.monthly} a month")
            if total:
                day = now.strftime("%Y-%m-%d")
                place = self.folder / "reservations" / day[:7]
                place.mkdir(parents=True, exist_ok=True)
                name = uuid.uuid4().hex
                made = place / f".{name}"
                made.write_text(json.dumps({"provider": provider, "day": day, "calls": total, "cost": total * limits.cost_per_call}))
                made.rename(place / f"{name}.json")
        return fits

    def claim(self, run: str, request: int) -> bool:
        """Whether a reserved call may be made now: once only, by whoever comes first."""
        place = self.folder / "claims" / run
        place.mkdir(parents=True, exist_ok=True)
        try:
            os.close(os.open(place / str(request), os.O_CREAT | os.O_EXCL))
            return True
        except FileExistsError:
            return False


def reservations(spark, folder: str):
    """The ledger as a table (provider, day, calls, cost), one row a provider and day."""
    from pyspark.sql import functions as F

    rows = spark.read.schema("provider string, day string, calls long, cost double").json(f"{folder}/reservations", recursiveFileLookup=True)
    return rows.groupBy("provider", "day").agg(F.sum("calls").alias("calls"), F.sum("cost").alias("cost"))
