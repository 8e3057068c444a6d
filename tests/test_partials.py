"""Reports from panes against scans of the records."""

import pytest
from pyspark.sql import functions as F

from lexloom.operators import audit as A
from lexloom.operators import partials as P


@pytest.fixture(scope="module")
def records(spark):
    """5000 records over some ten days, some without numbers, kinds or times."""
    n = F.col("id")
    return spark.range(5000).select(
        F.when(n % 97 > 0, F.expr("timestamp_ntz '2024-03-01 00:10:00' + make_dt_interval(0, 0, 0, id * 171)")).alias("ts"),
        F.when(n % 11 > 0, F.concat(F.lit("i"), (n % 4).cast("string"))).alias("intent"),
        (n % 7 == 0).alias("failed"),
        F.when(n % 5 > 0, (n % 1000).cast("double")).alias("total_time_ms"),
        F.round(n / 1000, 3).alias("cost_usd"),
        (n % 13).alias("total_tokens"),
        F.when(n % 3 > 0, n % 6).alias("chunk_count"),
        (n % 700).alias("user_id"),
    )


def test_summary_equals_scan(spark, records):
    panes = P.audit_panes(records)
    assert panes.where("start is null").count() > 0
    assert P.summary_from_panes(panes).first().asDict() == A.audit_summary(records).first().asDict()
    # panes of panes are panes
    assert P.summary_from_panes(P.merged(panes, "intent")).first() == P.summary_from_panes(panes).first()
    none = P.summary_from_panes(P.audit_panes(records.limit(0))).first()
    assert none["total"] == 0 and none["avg_time_ms"] is None and none["total_tokens"] == 0


@pytest.mark.parametrize("now", ["2024-03-08 00:00:00", "2024-03-08 12:34:56", "2024-02-01 00:00:00", "2025-01-01 00:00:00"])
def test_dashboard_equals_scan(records, now):
    got, want = P.dashboard_from_panes(P.audit_panes(records), records, now, 30, 3).first(), A.dashboard(records, now, 30, 3).first()
    assert got["total"] == want["total"] and got["last_ts"] == want["last_ts"] and got["total_tokens"] == (want["total_tokens"] if want["total"] else got["total_tokens"])
    if want["total"]:
        assert got.asDict() == want.asDict()


def test_edge_is_read_by_a_pushed_filter(spark, records, tmp_path):
    records.write.parquet(str(tmp_path / "r"))
    stored = spark.read.parquet(str(tmp_path / "r"))
    P.audit_panes(stored).write.parquet(str(tmp_path / "p"))
    plan = P.dashboard_from_panes(spark.read.parquet(str(tmp_path / "p")), stored, "2024-03-08 12:34:56")._jdf.queryExecution().toString()
    assert plan.count("GreaterThan(ts,") and plan.count("LessThan(ts,") and plan.count("GreaterThanOrEqual(start,")


def test_estimates_merge(records):
    panes = P.audit_panes(records, users="user_id")
    got = {r["intent"]: r for r in P.estimates(panes, "intent").collect()}
    rows = records.collect()
    for intent in {r["intent"] for r in rows}:
        mine = [r for r in rows if r["intent"] == intent]
        times = sorted(t for t in (r["total_time_ms"] for r in mine) if t)
        users = len({r["user_id"] for r in mine})
        for q, name in ((0.5, "times_p50"), (0.95, "times_p95")):
            at = sum(t <= got[intent][name] for t in times) / len(times)
            assert abs(at - q) < 0.03
        assert got[intent]["n"] == len(mine) and abs(got[intent]["users"] - users) <= 0.05 * users
    assert P.estimates(P.audit_panes(records.where("total_time_ms is null"))).first()["times_p50"] is None


def test_refresh_replaces_days_only(spark, records, tmp_path):
    path = str(tmp_path / "panes")
    days = [str(r[0]) for r in records.select(F.to_date("ts")).distinct().collect() if r[0]]
    P.refresh_panes(records, path, days)
    timed = records.where("ts is not null")
    assert P.summary_from_panes(P.read_panes(spark, path)).first() == P.summary_from_panes(P.audit_panes(timed)).first()
    late = timed.unionByName(timed.where("to_date(ts) = date '2024-03-03'"))
    for _ in range(2):  # running again changes nothing
        P.refresh_panes(late, path, ["2024-03-03"])
        assert P.summary_from_panes(P.read_panes(spark, path)).first() == P.summary_from_panes(P.audit_panes(late)).first()


def test_wide_rows_are_not_broadcast(spark, monkeypatch):
    from lexloom import session

    wide = spark.range(20).select("id", F.repeat(F.lit("x"), 1000).alias("body"))
    hinted = lambda: "ResolvedHint" in session.small(wide)._jdf.queryExecution().analyzed().toString()
    assert hinted()
    monkeypatch.setattr(session, "BROADCAST_BYTES", 10_000)
    assert not hinted()
    monkeypatch.setattr(session, "BROADCAST_BYTES", 1 << 20)
    monkeypatch.setattr(session, "BROADCAST_ROWS", 19)
    assert not hinted()
    assert session.small(wide.limit(0)).count() == 0
