"""Paid calls through the data source: no run passes the limit, whatever its partitions, restarts and repeats."""

import json
import sys
import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

import pytest

from waymark.sources.ledger import Ledger, Limits, reservations
from waymark.sources.providers import BudgetExceeded
from waymark.sources.search import SearchSource


@pytest.fixture
def read(spark, tmp_path, monkeypatch):
    """A read of eight queries with a client that leaves a file for each call."""
    module = f"paid_{uuid.uuid4().hex}"
    calls = tmp_path / "calls"
    calls.mkdir()
    (tmp_path / f"{module}.py").write_text(
        f"import uuid\ndef search(q, n):\n    open(r'{calls}/' + uuid.uuid4().hex, 'w').write(q)\n    if q == 'q1':\n        raise ValueError('down')\n    return [{{'title': q, 'url': 'https://x.in/' + q}}]\n"
    )
    monkeypatch.setattr(sys, "path", [str(tmp_path), *sys.path])
    spark.sparkContext.addPyFile(str(tmp_path / f"{module}.py"))
    spark.dataSource.register(SearchSource)

    def run(daily, monthly=100, calls_each=1):
        options = {"queries": "\n".join(f"q{i}" for i in range(8)), "client": f"{module}:search", "ledger": str(tmp_path / "ledger"), "provider": "p", "daily": str(daily), "monthly": str(monthly), "calls": str(calls_each), "cost": "0.5"}
        return spark.read.format("waymark_search").options(**options).load()

    run.made = lambda: sorted(f.read_text() for f in calls.iterdir())
    run.ledger = str(tmp_path / "ledger")
    return run


def test_a_run_keeps_the_limit(read, spark):
    df = read(5)
    got = {r.query: r.error for r in df.collect()}
    assert len(read.made()) == 5 and sorted(got.values(), key=str).count("budget") == 3
    assert "down" in got["q1"] and got["q0"] is None and got["q7"] == "budget"  # a failed call is charged
    assert [(r.provider, r.calls, r.cost) for r in reservations(spark, read.ledger).collect()] == [("p", 5, 2.5)]
    df.collect()  # the same plan again makes no call
    assert len(read.made()) <= 5
    assert {r.error for r in read(5).collect()} == {"budget"} and len(read.made()) == 5  # nor does a restart


def test_calls_a_query_and_the_month(read):
    assert sum(r.error != "budget" for r in read(100, monthly=7, calls_each=3).collect()) == 2
    assert Ledger(read.ledger).usage("p").monthly_calls == 6 and Ledger(read.ledger).usage("other").monthly_calls == 0


def test_days_and_months(tmp_path):
    now = [datetime(2024, 1, 31, 23, 59, tzinfo=timezone.utc)]
    book = Ledger(str(tmp_path / "l"), lambda: now[0])
    limits = Limits(3, 5)
    assert book.reserve("p", [2, 2, 1], limits) == [True, False, True]
    now[0] = datetime(2024, 2, 1, tzinfo=timezone.utc)
    assert book.reserve("p", [3], limits) == [True] and book.reserve("p", [0], limits) == [True] and book.reserve("p", [1], limits) == [False]
    now[0] = datetime(2024, 2, 2, tzinfo=timezone.utc)
    assert book.reserve("p", [3], limits) == [False] and book.reserve("p", [2], limits) == [True]
    with pytest.raises(BudgetExceeded):
        book.reserve("p", [1], limits, whole=True)
    with pytest.raises(ValueError):
        book.reserve("p", [-1], limits)
    assert (book.usage("p").daily_calls, book.usage("p").monthly_calls) == (2, 5)


def test_processes_at_once(tmp_path):
    with ThreadPoolExecutor(8) as pool:
        fits = list(pool.map(lambda _: Ledger(str(tmp_path / "l")).reserve("p", [1] * 3, Limits(20, 20)), range(16)))
    assert sum(map(sum, fits)) == 20 == Ledger(str(tmp_path / "l")).usage("p").daily_calls
    claims = Ledger(str(tmp_path / "l"))
    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(lambda _: claims.claim("run", 7), range(16))) == 1


def test_export_command(spark, tmp_path, monkeypatch, capsys):
    """Records that share a site are one lead of the command's output."""
    from waymark import cli

    rows = [
        {"business_name": "Rose", "city": "Goa", "website": "https://rose.in", "stockist_lead": "YES", "relationship": "SELF", "geography": "YES", "business_type": "multi designer", "confidence": "HIGH"},
        {"business_name": "Rose", "city": "Goa", "website": "https://www.rose.in/x", "phone": "+91 98765 43210", "relationship": "SELF", "geography": "YES"},
        {"business_name": "List", "website": "https://list.in", "relationship": "ARTICLE", "geography": "YES"},
    ]
    (tmp_path / "r.json").write_text(json.dumps({"business_candidates_llm": rows}, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)))
    for name in ("r", "lines"):
        assert cli.main(["export", str(tmp_path / f"{name}.json"), str(tmp_path / name)]) == 0
        assert "3 records, 2 businesses" in capsys.readouterr().out
        leads = [r for f in (tmp_path / name / "stockist_leads_only.csv").glob("part*") for r in f.read_text("utf-8-sig").splitlines()[1:]]
        assert len(leads) == 1 and "98765" in leads[0]
    (tmp_path / "bad.json").write_text('[{"x": 1}]')
    assert cli.main(["export", str(tmp_path / "bad.json"), str(tmp_path / "bad")]) == 1
