import hashlib
import random
import zlib
from functools import lru_cache

from arcweave.llm import repair

EMPTY = hashlib.sha256(b"").hexdigest()
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def exhaustive(initials, faults):
    """Least (cost, audit, roles) of all edits with at most n + 2 insertions."""

    @lru_cache(None)
    def best(i, last, left):
        out = [(0, "", ())] if i == len(initials) and last in ("", "a") else []
        add = lambda c, e, keep, rest: out.extend((c + x, e + y, keep + z) for x, y, z in rest)
        for r in "ua":
            if left and r in NEXT[last]:
                add(2, "I", (r,), best(i, r, left - 1))
        if i < len(initials):
            add(3, "D", ("",), best(i + 1, last, left))
            if faults[i] not in "bd":
                more = faults[i] == "t"
                for r in "ua":
                    if r in NEXT[last]:
                        add(2 + more, "R", (r,), best(i + 1, r, left))
                if initials[i] in NEXT[last]:
                    add(0 + more, "K", (initials[i],), best(i + 1, initials[i], left))
        # only the cheapest can win, but all their audits are kept
        low = min((x[0] for x in out), default=0)
        return tuple(x for x in out if x[0] == low)

    return min(best(0, "", len(initials) + 2))


def test_search_against_exhaustion():
    rng = random.Random(5)
    for _ in range(400):
        n = rng.randint(0, 7)
        r, f = "".join(rng.choices("suax ", k=n)), "".join(rng.choices("--btd", k=n))
        assert repair.cheapest(r, f) == exhaustive(r, f)[:2], (r, f)


def test_audits_compare_as_strings():
    rng, all_ = random.Random(2), [repair.Audit()]
    for _ in range(300):
        p = rng.choice(all_[-20:])
        kids = {x.letter for x in all_ if x.parent is p}
        if free := sorted(set("DIKR") - kids):
            all_.append(repair.Audit(rng.choice(free), p))
    for _ in range(3000):
        a, b = rng.choice(all_), rng.choice(all_)
        assert (a < b) == (str(a) < str(b))


def test_long_conversation():
    cost, audit = repair.cheapest("ua" * 20000 + "uu" + "ua" * 20000, "-" * 80002)
    assert (cost, audit) == (2, "K" * 40001 + "R" + "K" * 40000)


def reference(rows):
    """The contract, one conversation after the other, over the undamaged rows."""
    out, convs = [], {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t, r if r is not None else " ", x if x is not None else " "))
    for c, source in convs.items():
        kept = []
        for t, r, x in source:
            k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            x = "" if k == 1 else "".join(y for y in x if y not in ".!?") if k == 2 else x
            kept += [(t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
        kept.sort(key=lambda y: (y[0] is not None, y[0] or 0, hashlib.md5(f"{len(y[1].encode())}:{y[1]}{y[2]}".encode()).digest()))
        faults, seen = "", set()
        for _, r, x in kept:
            bare = x.strip(repair.SPACE)
            faults += "b" if not bare else "d" if (r, x) in seen else "t" if bare[-1] not in ".!?" else "-"
            seen.add((r, x))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, roles = exhaustive("".join(i or " " for i in initials), faults)
        lines, at = [], 0
        for e, role in zip(audit, roles):
            name = {"u": "user", "a": "assistant"}.get(role)
            if e == "I":
                lines.append(f"{name}:")
                continue
            if e != "D":
                lines.append(f"{kept[at][1] if e == 'K' else name}:{kept[at][2]}")
            at += 1
        out.append((c, gaps, *[faults.count(y) for y in "bdt"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, phase int, digest string").repartition(parts)
    return sorted(map(tuple, repair.repair(repair.damaged(df)).collect()), key=str)


def test_against_reference(spark):
    rng, rows = random.Random(8), []
    for c in [*range(60), None]:
        for t in range(rng.randint(1, 7)):
            role = rng.choices(["user", "assistant", "system", "tool", "", None], [8, 8, 2, 1, 1, 1])[0] if rng.random() < 0.4 else ("user", "assistant")[t % 2]
            text = rng.choice([None, "", " \n\t", "Yes.", "No", "Why?\n", "Été!", "a. b. c", "long " * 50 + "."])
            rows.append((c, None if rng.random() < 0.05 else t + 3 * (rng.random() < 0.1), role, text))
    rows += rows[:9]  # repeated rows
    assert run(spark, rows) == reference(rows)


def test_all_rows_dropped_and_empty_table(spark):
    gone = next(c for c in range(999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert run(spark, [(gone, 0, "user", "x.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", EMPTY)]
    assert run(spark, []) == []
