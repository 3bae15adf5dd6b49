"""Reservations under an allowance: many writers, one state."""

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

from lodestone.operators.reservations import CommitLog, ReservationLedger

ASK = "reservation_id string, at timestamp"
JAN = datetime(2024, 1, 5)


def asked(spark, names, at=JAN):
    return spark.createDataFrame([(n, at + timedelta(seconds=i)) for i, n in enumerate(names)], ASK)


def states(df):
    return {r.reservation_id: r.state for r in df.collect()}


def test_one_entry_for_a_number(spark, tmp_path):
    logs = [CommitLog(spark, str(tmp_path / "log")) for _ in range(2)]
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: logs[i % 2].put(0, {"writer": i}), range(24)))
    assert sum(won) == 1 and logs[0].entries() == [{"writer": won.index(True)}]
    assert not logs[1].put(0, {}) and logs[1].put(1, {"writer": -1}) and len(logs[0].entries()) == 2


def test_two_writers_cannot_take_the_last_credit(spark, tmp_path):
    ledgers = [ReservationLedger(spark, str(tmp_path / "r"), 10) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(lambda i: states(ledgers[i].reserve(asked(spark, [f"w{i}-{k}" for k in range(4)]), 1)), range(4)))
    reserved = [n for f in found for n, s in f.items() if s == "reserved"]
    assert len(reserved) == 10
    again = ReservationLedger(spark, str(tmp_path / "r"), 10)
    assert sorted(r.reservation_id for r in again.ledger().collect()) == sorted(reserved)
    assert again.usage().first().remaining == 0 and len(again.log.entries()) == 4


def test_spent_credits_count(spark, tmp_path):
    ledger = ReservationLedger(spark, str(tmp_path / "r"), 6)
    assert states(ledger.reserve(asked(spark, ["a", "b", "c", "d"]), 2)) == {"a": "reserved", "b": "reserved", "c": "reserved", "d": "refused"}
    assert states(ledger.reserve(asked(spark, ["a", "e"]), 2)) == {"a": "reserved", "e": "refused"}
    outcomes = "reservation_id string, credits int, succeeded boolean"
    ledger.settle(spark.createDataFrame([("a", 1, True), ("b", 2, False), ("d", 5, True), ("nobody", 1, True)], outcomes))
    ledger.settle(spark.createDataFrame([("a", 9, False)], outcomes))
    assert {r.reservation_id: (r.state, r.credits) for r in ledger.ledger().collect()} == {"a": ("success", 1), "b": ("failed", 2), "c": ("reserved", 2)}
    assert states(ledger.reserve(asked(spark, ["f", "g"]), 2)) == {"f": "reserved", "g": "refused"}
    assert states(ledger.reserve(asked(spark, ["h"], datetime(2024, 2, 1)), 2)) == {"h": "reserved"}
    assert {r.period: r.remaining for r in ledger.usage().collect()} == {"2024-01": 1, "2024-02": 4}
