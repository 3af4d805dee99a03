"""Operator 11 against all edits of every conversation, tried one by one."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from siltworks.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, code string, kind int"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def brute(rows):
    one = lambda x: " " if x is None else str(x)
    convs = {}
    for conv, turn, role, text in rows:
        role, text, kind = one(role), one(text), zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        text = "" if kind <= 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        convs.setdefault(conv, []).extend([(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    out = []
    for conv, some in convs.items():
        key = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
        some.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], key(r)))
        faults, seen = [], set()
        for _, role, text in some:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))

        @cache
        def best(i, said, inserted):
            """Least (cost, audit) of rows i on, after the initials ``said`` so far, cut to what the pattern needs to know."""
            tries = []
            if i == len(some) and re.fullmatch("(s?(ua)+)?", said):
                tries.append((0, "", ()))
            fits = lambda x: re.fullmatch("s?(ua)*u?", x)
            short = lambda x: x[:1] * (x[:1] == "s") + (x.lstrip("s")[-2:] if len(x.lstrip("s")) % 2 == 0 else (x.lstrip("s")[-3:]))
            if inserted < 3:
                for role in ("user", "assistant"):
                    if fits(said + role[0]):
                        c, a, t = best(i, short(said + role[0]), inserted + 1)
                        tries.append((c + 5, "I" + a, ((role, ""), *t)))
            if i < len(some):
                _, role, text = some[i]
                c, a, t = best(i + 1, said, 0)
                tries.append((c + 2, "D" + a, t))
                if faults[i] not in ("blank", "duplicate"):
                    more = 5 * (faults[i] == "truncated")
                    for letter, name, cost in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                        if name and fits(said + name[0]):
                            c, a, t = best(i + 1, short(said + name[0]), 0)
                            tries.append((c + cost + more, letter + a, ((name, text), *t)))
            return min(tries, default=(1 << 40, "", ()))

        cost, audit, lines = best(0, "", 0) if some else (0, "", ())
        turns = [r[0] for r in some if r[0] is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(some, some[1:])]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                    hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()))
    return out


def table(seed, convs=60, most=9, long=()):
    rng, rows = random.Random(seed), []
    texts = ["Fine.", "Is it so?", "cut off", "  \t\n", "", "Yes! \n", "a.b", "É.", None, "other text.", "more of it.", "and on."]
    for conv in [*range(convs), None]:
        for turn in range(long[conv] if conv is not None and conv < len(long) else rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u2"]) if rng.random() < 0.6 else "user" if turn % 2 == 0 else "assistant"
            text = rng.choice(texts) if rng.random() < 0.3 else f"turn {rng.randint(0, 3 * most)} of it."
            rows.append((conv, None if rng.random() < 0.05 else turn + rng.choice([0, 0, 0, 2]), role, text))
    return rows + rng.sample(rows, 5)


def run(spark, rows, **kw):
    got = repair.repair(spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA), **kw)
    assert got.columns == COLUMNS
    return sorted(map(tuple, got.collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def expected(rows):
    return sorted(brute(rows), key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("seed", range(3))
def test_against_all_edits(spark, seed):
    rows = table(seed)
    assert run(spark, rows) == expected(rows)


@pytest.mark.parametrize("block", [1, 3, 7])
def test_conversations_of_many_blocks_and_partitions(spark, block):
    """One conversation has over half of all rows, and its rows come from several sorted partitions."""
    rows = table(block, convs=12, long=(150, 40))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert run(spark, rows, block=block) == expected(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_same_row_many_times(spark):
    rows = [(1, 7, "user", "Fine."), (1, 8, "assistant", "Yes.")] * 60
    assert run(spark, rows, block=10) == run(spark, rows) == expected(rows)


def test_empty_and_all_dropped(spark):
    assert run(spark, []) == []
    rows = [(c, t, "user", "Fine.") for c in range(40) for t in range(30) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    nothing = hashlib.sha256(b"").hexdigest()
    assert run(spark, rows) == [(c, 0, 0, 0, 0, 0, 0, "", nothing) for c in sorted({r[0] for r in rows})]
