"""Conversation repair: dynamic programming, every small case, long conversations in segments, odd input."""

import hashlib
import itertools
import random
import re
import zlib

from logspark.llm import conversation_repair as cr

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, cost string, audit long"


def damage(conv_id, turn, role, text):
    word = lambda v: " " if v is None else v
    role, text = word(role), word(text)
    kind = zlib.crc32(f"{word(conv_id)}:{word(turn)}".encode()) % 20
    if kind == 0:
        return []
    row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
    return [row] * (2 if kind == 3 else 1)


def cheapest(rows):
    """Cost, audit and lines by dynamic programming; ``rows`` are (role, text, fault)."""
    follow = lambda s: 3 if s == 2 else 2
    names = {2: "user", 3: "assistant"}

    def inserted(best):
        out = dict(best)
        for s, (cost, audit, lines) in best.items():
            for k in (1, 2):
                s = follow(s)
                cost, audit, lines = cost + 3, audit + "I", [*lines, names[s] + ":"]
                out[s] = min(out.get(s, (cost, audit, lines)), (cost, audit, lines))
        return out

    best = {0: (0, "", [])}
    for role, text, fault in rows:
        after = {}
        for s, (cost, audit, lines) in inserted(best).items():
            ways = [(s, 4, "D", [])]
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                initial = {"s": 1, "u": 2, "a": 3}.get(role[:1])
                if initial == follow(s) or (initial == 1 and s == 0):
                    ways.append((initial, extra, "K", [f"{role}:{text}"]))
                ways.append((follow(s), 3 + extra, "R", [f"{names[follow(s)]}:{text}"]))
            for t, price, letter, new in ways:
                found = (cost + price, audit + letter, lines + new)
                after[t] = min(after.get(t, found), found)
        best = after
    ends = inserted(best)
    return min(ends[s] for s in (0, 3) if s in ends)


def brute(rows):
    every = {}
    for r in rows:
        every.setdefault(r[0], []).extend(damage(*r[:4]))
    for conv_id, own in every.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            tail = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            faults.append("blank" if not tail else "duplicate" if (role, text) in seen else "" if tail[0] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, lines = cheapest([(r[1], r[2], f) for r, f in zip(own, faults, strict=True)]) if own else (0, "", [])
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        yield conv_id, gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest


def check(df, **how):
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r) for r in cr.repaired(df, **how).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_small_cases_by_search():
    kinds = [("s", "S."), ("user", "U."), ("assistant", "A."), ("user", "cut"), ("assistant", ""), ("x", "odd."), ("", "none.")]
    for n in range(5):
        for rows in itertools.product(kinds, repeat=n):
            faults = ["blank" if not t else "truncated" if t == "cut" else "" for _, t in rows]
            want = cheapest([(r, t, f) for (r, t), f in zip(rows, faults, strict=True)])
            coded = [(cr.INITIALS.get(r[:1], 0), f == "blank", f == "truncated") for (r, _), f in zip(rows, faults, strict=True)]
            cost, audit = cr.repair(coded)
            assert (cost, audit) == want[:2]
            assert list(cr.repaired_lines([r for r, _ in rows], [t for _, t in rows], audit)) == want[2]
            assert cr.estimate(coded)[0] <= cost


def test_long_search_and_segments():
    rng = random.Random(5)
    for n in (60, 300):
        rows = [(rng.choice("ua"), "t", rng.choice(["", "", "", "truncated", "blank"])) for _ in range(n)]
        coded = [(cr.INITIALS[r], f == "blank", f == "truncated") for r, _, f in rows]
        want = cheapest(rows)
        assert cr.repair(coded) == want[:2]
        for size in (1, 7, 64):
            parts = [coded[k : k + size] for k in range(0, n, size)]
            found = [cr.segment_costs(p, p is parts[-1]) for p in parts]
            cost, ways = cr.choose([f["cost"] for f in found], [f["place"] for f in found])
            assert (cost, "".join(f["audit"][4 * a + b] for f, (a, b) in zip(found, ways, strict=True))) == want[:2]


def test_query_brute_force(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    check(df.repartition(3))
    check(df, segment=3)  # most conversations in segments


def test_odd(spark):
    rows = [(None, k % 5 if k % 4 else None, ("user", None, "", "assistant", "system")[k % 5], ("Hi.", None, "", " \n", "no end", "Hi.")[k % 6]) for k in range(40)]
    rows += [(7, 1, "user", "x" * 200_000)] * 3 + [(8, None, None, None)] + [(9, 0, "tool", "Odd!")] + [(c, t, "user", "Same?") for c in range(20, 60) for t in (0, 0, 5)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    for size in (512, 2):
        check(df.repartition(4), segment=size)
    assert cr.repaired(df.limit(0)).count() == 0
