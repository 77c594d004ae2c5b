"""Search providers behind a call budget, and settings from the environment."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Mapping, MutableMapping
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path


class BudgetExceeded(RuntimeError):
    """A call that would pass the day's or the month's limit."""


@dataclass
class CallBudget:
    """Calls of providers by day and month, in UTC; reserve() counts before a call is made."""

    daily: int
    monthly: int
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc)
    used: dict[tuple[str, str], int] = field(default_factory=dict)

    def reserve(self, provider: str, calls: int) -> None:
        """Counts calls or refuses them all; none at all only checks that nothing is spent."""
        now = self.clock()
        day, month = (provider, now.strftime("%Y-%m-%d")), (provider, now.strftime("%Y-%m"))
        if calls < 0 or self.used.get(day, 0) + calls > self.daily or self.used.get(month, 0) + calls > self.monthly:
            raise BudgetExceeded(f"{provider}: {calls} calls pass the limit of {self.daily} a day or {self.monthly} a month")
        if calls:
            self.used[day] = self.used.get(day, 0) + calls
            self.used[month] = self.used.get(month, 0) + calls


@dataclass
class Provider:
    """name, what it supports, a search function, and how many calls a request takes."""

    name: str
    supports: Callable[[Mapping], bool]
    search: Callable[[Mapping], Iterable[Mapping]]
    estimate: Callable[[Mapping], int] = lambda request: 1


def budgeted(provider: Provider, budget: CallBudget, aborted: Callable[[], bool] = lambda: False) -> Provider:
    """The provider with its calls reserved before each search.

    A search that fails has spent its calls all the same; one that is aborted
    or not supported spends none.
    """

    def search(request: Mapping) -> Iterable[Mapping]:
        if aborted():
            raise InterruptedError(f"{provider.name}: aborted")
        if not provider.supports(request):
            return []
        budget.reserve(provider.name, provider.estimate(request))
        return provider.search(request)

    return Provider(provider.name, provider.supports, search, provider.estimate)


def build_providers(factories: Mapping[str, Callable[[], Provider]], enabled: Iterable[str], budget: CallBudget) -> list[Provider]:
    """Budgeted providers of the enabled names that there are factories for, in order."""
    return [budgeted(factories[n](), budget) for n in enabled if n in factories]


def load_env(path: str, environ: MutableMapping[str, str] | None = None) -> dict[str, str]:
    """KEY=VALUE lines of a file put into the environment; what is set there stays. Blank lines, comments and lines without a key are skipped."""
    environ = os.environ if environ is None else environ
    added: dict[str, str] = {}
    file = Path(path)
    if not file.is_file():
        return added
    for line in file.read_text("utf-8").splitlines():
        line = line.strip().removeprefix("export ")
        key, found, value = line.partition("=")
        key, value = key.strip(), value.strip()
        if not found or not key or key.startswith("#"):
            continue
        if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        if key not in environ:
            environ[key] = added[key] = value
    return added


@dataclass(frozen=True)
class ModelSettings:
    enabled: bool
    url: str
    name: str
    timeout: float


def model_settings(environ: Mapping[str, str], url: str = "http://127.0.0.1:11434", name: str = "local", timeout: float = 90.0) -> ModelSettings:
    """Whether and how a model is called: MODEL_ENABLED, MODEL_URL, MODEL_NAME, MODEL_TIMEOUT (a second at least; what is no number leaves the default)."""
    on = environ.get("MODEL_ENABLED", "").strip().lower() in ("1", "true", "yes", "on")
    try:
        seconds = max(1.0, float(environ.get("MODEL_TIMEOUT", "") or timeout))
    except ValueError:
        seconds = timeout
    return ModelSettings(on, (environ.get("MODEL_URL") or url).rstrip("/"), environ.get("MODEL_NAME") or name, seconds)


def newest_report(folder: str, prefix: str = "seeds_") -> Path | None:
    """The report whose file name comes last, as names carry their date; null without any."""
    return max(Path(folder).glob(f"{prefix}*.json"), key=lambda p: p.name, default=None)
