import hashlib
import random
from datetime import datetime, timedelta

import pytest

from arcweave.llm import sessions

SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, cell long, pos int"
EPOCH = datetime(1970, 1, 1)
MINUTE = 60_000_000


def us(t):
    return (t - EPOCH) // timedelta(microseconds=1)


def reference(rows):
    """One client after the other, click by click."""
    by_id = {}
    for i, t, a, c, k, v, *_ in rows:
        if i is None or t is None or c is None:
            continue
        fin = v is not None and (v >= 60 or v != v) and k in ("purchase", "signup")
        cents = int((100 * v + 0.5) // 1) if v is not None and abs(v) < float("inf") else 0
        x = (us(t), c, a is not None and us(a) - us(t) > 15 * MINUTE, fin, cents)
        by_id[i] = min(by_id.get(i, x), x)
    out = []
    for client in {x[1] for x in by_id.values()}:
        own = sorted((x[0], i, x[3], x[4]) for i, x in by_id.items() if x[1] == client and not x[2])
        late = [x[0] for x in by_id.values() if x[1] == client and x[2]]
        found = []
        for t, i, fin, cents in own:
            if found:
                s = found[-1]
                why = "end" if s["clicks"][-1][2] else "gap" if t - s["clicks"][-1][0] >= 15 * MINUTE else "length" if t - s["clicks"][0][0] > 60 * MINUTE else None
                if why is None:
                    s["clicks"].append((t, i, fin, cents))
                    continue
                s["closed"] = why
            found.append({"clicks": [(t, i, fin, cents)], "closed": None})
        for s, after in zip(found, [*found[1:], None]):
            x = s["clicks"]
            n_late = sum(x[0][0] <= t and (after is None or t < after["clicks"][0][0]) for t in late)
            path = hashlib.sha256(",".join(str(y[1]) for y in x).encode()).hexdigest()
            out.append((client, x[0][1], x[0][0], x[-1][0], len(x), n_late, sum(y[3] for y in x), s["closed"] or ("end" if x[-1][2] else "none"), path))
    return sorted(out)


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, "{}", 1, 2) for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, sessions.sessions(df, **how).collect()))


def clicks(seed, clients=12, n=1500, step=9 * 60, final=0.1):
    """Clicks over some days: bursts, ties in time, late and repeated rows, nulls; client 0 rarely pauses."""
    rng, out, at = random.Random(seed), [], {}
    for i in range(n):
        c = 0 if rng.random() < 0.3 else rng.randrange(clients)
        pause = rng.choice([0, 1, 60, 300, step, 14 * 60 + 59, 15 * 60]) if c == 0 or rng.random() < 0.9 else rng.randrange(40 * 3600)
        at[c] = t = at.get(c, datetime(2024, 1, 1, 2)) + timedelta(seconds=pause, microseconds=rng.choice([0, 0, 1, 999_999]) if c else 0)
        arrived = None if rng.random() < 0.05 else t + timedelta(minutes=rng.choice([0, 1, 15, 16, 300]) if rng.random() < 0.3 else 0)
        kind = rng.choice(["purchase", "signup"]) if rng.random() < 2 * final else rng.choice(["view", "click", None])
        out.append((i, t, arrived, c, kind, rng.choice([None, 10.005, 59.995, 60.0, 99.9, -3.0, float("nan"), float("inf")] if rng.random() < 0.3 else [12.34, 75.0])))
    out += [(n + 1, None, None, 1, "view", 1.0), (n + 2, out[5][1], None, None, "view", 1.0), (None, out[6][1], None, 1, "view", 1.0), (3, *out[9][1:]), *out[20:40]]
    return out


@pytest.mark.parametrize("seed,final", [(1, 0.1), (2, 0.0), (3, 0.4)])
def test_against_reference(spark, seed, final):
    rows = clicks(seed, final=final)
    want = reference(rows)
    assert run(spark, rows) == want == run(spark, rows, cell_hours=2)
    assert {r[7] for r in want} >= ({"gap", "length", "none"} if final < 0.2 else {"end", "gap"})


def test_runs_without_a_break(spark):
    """One client clicks for days without a hard break: every cut depends on all before it."""
    rng, t, rows = random.Random(4), datetime(2024, 3, 1), []
    for i in range(2500):
        t += timedelta(seconds=rng.choice([30, 200, 700, 899]))
        rows.append((i, t, t + timedelta(minutes=20) if i % 11 == 5 else None, 7, "view", 1.0))
    rows += [(5000 + i, datetime(2024, 3, 1) + timedelta(minutes=i), None, 8, "view", 1.0) for i in range(3000)]
    want = reference(rows)
    assert run(spark, rows, cell_hours=2) == want == run(spark, rows)


def test_odd_cases(spark):
    t = datetime(1969, 12, 31, 23, 50)
    rows = [(1, t, t + timedelta(hours=1), 1, "view", 1.0), (2, t + timedelta(hours=30), t + timedelta(hours=40), 2, "view", 1.0), (3, t, t, 2, "signup", 60.0), (4, t, t, 2, "view", 1.0), (5, t, t + timedelta(days=1), 2, "view", 1.0)]
    assert run(spark, rows) == reference(rows)  # late only; late a day after; two sessions of one start
    assert run(spark, []) == []
    with pytest.raises(ValueError):
        run(spark, rows, cell_hours=1)
