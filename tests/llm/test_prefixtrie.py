"""The conversation trie against a trie built turn by turn."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from wrenfold.llm import prefixtrie
from wrenfold.llm.ranks import running

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth string, pos string, `a.b` string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows: list[tuple]) -> list[tuple]:
    convs: dict[int, list] = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs[c].append((turn is not None, turn or 0, key, (role, text)))
    own = {c: [t[-1] for t in sorted(v)] for c, v in convs.items()}
    made = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - c % 5
        made[c] = turns if base == c else own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    for path, ms in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids[path]
            saved[path[:d]] += (len(ms) - 1) * len(path[-1][1].encode()) if path else 0
    out = []
    for path, ms in members.items():
        ends = ",".join(map(str, sorted(c for c in ms if len(made[c]) == len(path))))
        out.append((min(ms), len(path), min(members[path[:-1]]) if path else None, len(ms), kids[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows: list[tuple]) -> list[tuple]:  # noqa: ANN001
    df = spark.createDataFrame([(*r, "q", "q", "q", "q") for r in rows], SCHEMA)
    return sorted(map(tuple, prefixtrie.trie(df).select(COLUMNS).collect()), key=repr)


def corpus() -> list[tuple]:
    rng = random.Random(11)
    turn = lambda: (rng.choice(["user", "assistant", None]), rng.choice(["", None, "hi", "hé", "what now?"]))
    rows = []
    for c in [*range(0, 60), 77, 103, 5 * 10**12 + 2]:
        for k in range(rng.choice([1, 2, 3, 5, 9, 12])):
            rows.append((c, k, *((("user", "hi")) if k == 0 and c % 3 else turn())))
    rows += [(200, k, "user", f"t{k % 3}") for k in range(70)] + [(201, k, "user", f"t{k % 3}") for k in range(70)]  # long ones
    rows += [(300, None, "b", "x"), (300, None, "a", "y"), (300, 0, "user", "z"), (300, 0, "user", "z"), (None, 0, "user", "lost")]  # null and equal numbers, a repeated row, no id
    rows += [(400 + k, 0, "user", "copy") for k in range(0, 30)] + [(400 + k, 1, "bot", "same") for k in range(0, 30)]  # equal conversations
    return rows


def test_trie(spark):  # noqa: ANN001, ANN201
    rows = corpus()
    want = brute(rows)
    assert len(want) > 200
    assert next(r for r in want if r[1] == 0)[-1] != hashlib.sha256().hexdigest(), "some conversation ends at the root"
    assert got(spark, rows) == want


@pytest.mark.parametrize("rows", [[], [(None, 0, "user", "x")], [(7, 0, "user", "x")], [(0, 0, None, None)]])
def test_small(spark, rows):  # noqa: ANN001, ANN201
    assert got(spark, rows) == brute(rows)


def test_hot_turns(spark):  # noqa: ANN001, ANN201
    """A first turn of all, and one conversation with a third of all rows."""
    rows = [(5 * c, k, "user", "hello" if k == 0 else f"t{(c * k) % 7}") for c in range(700) for k in range(3)] + [(9999, k, "user", f"w{k % 50}") for k in range(1000)]
    assert got(spark, rows) == brute(rows)


def test_running_totals(spark):  # noqa: ANN001, ANN201
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 9]), k, rng.randrange(5)) for k in range(3000)]
    df = spark.createDataFrame(rows, "grp long, k long, v long").repartition(7)
    total, want = defaultdict(int), []
    for g, k, v in rows:
        total[g] += v
        want.append((g, k, total[g]))
    assert sorted(map(tuple, running(df, "grp", ["k"], ["v"]).collect())) == sorted(want)
