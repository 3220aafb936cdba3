"""Set forms against small sequential models, on random data."""

import random

from pyspark.sql import Row

from annalist.functions import ordering
from annalist.operators import delivery as D
from annalist.operators import ledger as L


def model(observations):
    state, out, version = {}, [], {}
    for record, o, ms, present, rev, root in sorted(observations, key=lambda x: x[1]):
        was = state.get(record)
        found = []
        if not present:
            if was and was[0]:
                found.append(("record_tombstoned", was[1], was[2]))
                state[record] = (False, was[1], was[2])
        else:
            if was is None:
                found.append(("revision_committed", rev, root))
            else:
                if not was[0]:
                    found.append(("record_restored", was[1], root))
                if was[1] != rev:
                    found.append(("revision_committed", rev, root))
                elif was[0] and was[2] != root:
                    found.append(("location_changed", rev, root))
            state[record] = (True, rev, root)
        for kind, r, t in found:
            version[record] = version.get(record, 0) + 1
            out.append((len(out) + 1, record, version[record], kind, r, t, ms))
    return out


def test_ledger_equals_state_machine(spark):
    rng = random.Random(5)
    obs = [(rng.randrange(6), o, o * 10, rng.random() < 0.7, rng.randrange(3), rng.choice("ab")) for o in range(400)]
    ordering.RUN, old = 16, ordering.RUN
    try:
        got = L.ledger(spark.createDataFrame(obs, "record long, o long, ms long, present boolean, rev long, root string")).collect()
    finally:
        ordering.RUN = old
    assert sorted(map(tuple, got)) == model(obs)


def test_greedy_budget_skips_and_goes_on(spark):
    rows = [Row(g="a", p=n, size=s) for n, s in enumerate([70, 50, 20, 10, 30])] + [Row(g="b", p=0, size=500)]
    got = ordering.greedy_budget(spark.createDataFrame(rows), "g", ["p"], "size", 100).collect()
    assert sorted((r.g, r.p) for r in got if r.admitted) == [("a", 0), ("a", 2), ("a", 3), ("b", 0)]


def test_prefix_budget_stops(spark):
    rows = [Row(g="a", p=n, size=s) for n, s in enumerate([70, 20, 50, 1])]
    got = ordering.prefix_budget(spark.createDataFrame(rows), "g", ["p"], "size", 100).collect()
    assert sorted(r.p for r in got if r.admitted) == [0, 1]


def test_barriers_agree_and_hold(spark):
    rng = random.Random(3)
    states = ["queued", "leased", "acknowledged", "superseded", "blocked", "dead_lettered", "ignored_by_policy"]
    rows = [(1, n, n % 5, n // 5 + 1, rng.choice(states)) for n in range(60)]
    d = spark.createDataFrame(rows, "sub int, sequence long, record long, record_version long, state string")
    a, b = (sorted(r.sequence for r in f(d).collect()) for f in (D.barrier_anti, D.barrier_window))
    free = {"acknowledged", "superseded", "ignored_by_policy"}
    want = [n for _, n, r, v, _ in rows if all(s in free for _, _, r2, v2, s in rows if r2 == r and v2 < v)]
    assert a == b == sorted(want)


def test_owned_by_source_has_no_last_record(spark, monkeypatch):
    from annalist.plans import queries as q

    rows = [(2,), (3,), (7,), (7,), (1_000_002,), (5_000_000_001,), (5_000_000_002,)]
    monkeypatch.setattr(q.X, "observations", lambda s, d: spark.createDataFrame(rows, "record long"))
    got = sorted(r.record for r in q.QUERIES["owned_by_source"](spark, "").collect())
    assert got == [2, 7, 1_000_002, 5_000_000_002]


def test_settlement_columns(spark):
    """Expiry, settling, retrying and blocking, row by row: state, token, expiry, time of settlement and reason."""
    now, rows = 1000, []
    for n in range(60):
        state = ["leased", "leased", "queued", "acknowledged"][n % 4]
        leased = state == "leased"
        rows.append((n, n % 7, 1, "k", 0, "a", 1, state, n % 5 + 1, 900 + 7 * n if leased else None, None, f"t{n}" if leased else None, 5, 50 if state == "acknowledged" else None, None))
    columns = "sequence long, record long, record_version long, kind string, rev long, root string, sub int, state string, attempts int, expires_ms long, not_before_ms long, token string, created_ms long, settled_ms long, reason string"
    d = spark.createDataFrame(rows, columns)
    subs = spark.createDataFrame([(1, 50, True, 3, 10, 40)], "sub int, max_leases int, enabled boolean, max_attempts int, first_ms int, most_ms int")
    asked = spark.createDataFrame([(1, n, f"t{n}" if n % 3 else "old", ["acknowledged", "dead_letter"][n % 2], f"r{n}") for n in range(60)], "sub int, sequence long, token string, outcome string, reason string")
    wait = lambda attempts: now + min(40, 10 * 2 ** (attempts - 1))
    got = {name: {r.sequence: r for r in df.collect()} for name, df in (("expire", D.expire(d, subs, now)), ("settle", D.settle(d, asked, now)), ("retry", D.retry(d, asked, subs, now)), ("block", D.block(d, asked, now)))}
    for x in rows:
        n, state, attempts, expires, token, settled = x[0], x[7], x[8], x[9], x[11], x[13]
        same = (state, token, expires, None, settled, None)
        over, ok, dead = state == "leased" and expires <= now, state == "leased" and n % 3 > 0 and expires > now, attempts >= 3
        again = ("dead_lettered", None, None, None, now) if dead else ("queued", None, None, wait(attempts), None)
        want = {
            "expire": (*again, "retry policy exhausted after lease expiry" if dead else None) if over else same,
            "settle": (["acknowledged", "dead_lettered"][n % 2], None, None, None, now, f"r{n}") if ok else same,
            "retry": (*again, "retry policy exhausted" if dead else None) if ok else same,
            "block": ("blocked", None, None, None, None, f"r{n}") if ok else same,
        }
        for name, w in want.items():
            r = got[name][n]
            assert (r.state, r.token, r.expires_ms, r.not_before_ms, r.settled_ms, r.reason) == w, (name, n)


def test_fold_refuses_and_goes_on(spark):
    rows = [("a", n, s) for n, s in enumerate([50, 70, 30, 20, 1, 1])] + [("b", 0, 200), ("b", 1, 100), (None, 0, 5)]
    d = spark.createDataFrame(rows, "g string, p long, size long")
    got = ordering.folded(d, "g", ["p"], "size", 100, 4).where("admitted").collect()
    assert sorted((r.g or "", r.p) for r in got) == [("", 0), ("a", 0), ("a", 2), ("a", 3), ("b", 1)]
