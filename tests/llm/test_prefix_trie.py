import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from rarevar_spark.llm import prefix_trie, queries
from rarevar_spark.llm.slot_table import SlotTable

TURNS = "conv_id long, turn long, role string, text string"


def brute(rows, borrow=0, among=100):
    given = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            given[c].append((t is not None, t or 0, r or "", x or ""))
    conv = {c: [v[2:] for v in sorted(x)] for c, x in given.items()}
    members = defaultdict(list)
    for c, x in sorted(conv.items()):
        h = zlib.crc32(str(c).encode()) % borrow if borrow else 0
        y = tuple(conv.get(c - (abs(c) % among) * (1 if c >= 0 else -1), [])[:h] + x[h:])
        for d in range(len(y) + 1):
            members[y[:d]].append((c, d == len(y)))
    kids = defaultdict(list)
    for y in members:
        if y:
            kids[y[:-1]].append(y)
    leaves, saved = {}, {}
    for y in sorted(members, key=len, reverse=True):
        leaves[y] = sum(leaves[k] for k in kids[y]) or 1
        saved[y] = sum(saved[k] for k in kids[y]) + ((len(members[y]) - 1) * len(y[-1][1]) if y else 0)
    digest = lambda m: hashlib.sha256(",".join(str(c) for c, e in m if e).encode()).hexdigest()
    return sorted(((m[0][0], len(y), members[y[:-1]][0][0] if y else None, len(m), len(kids[y]), leaves[y], saved[y], digest(m)) for y, m in members.items()), key=str)


@pytest.fixture(scope="module")
def turns():
    """Many short conversations of few texts (null and repeated turns, negative ids), some long ones that part late, rows without a conversation."""
    rng = random.Random(1)
    rows = [
        (c, rng.choice([t, t, t, None]), rng.choice(["u", "a", None]), rng.choice(["x", "y", None, "zé"]))
        for c in [*range(330), -5, -100, -230] for t in range(rng.choice([0, 1, 3, 6, 9]))
    ]
    rows += [(c, t, "u", "other" if c == 702 and t >= 57 else f"long{t % 3}") for c in (400, 401, 700, 702) for t in range(60)]
    rows += [(None, 0, "u", "x"), *rows[:20]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("kw", [{"borrow": 6}, {"borrow": 6, "stretch": 7, "rows_per_shard": 40}, {"stretch": 5, "rows_per_shard": 30}])
def test_nodes(spark, turns, kw):
    got = prefix_trie.prefix_nodes(spark.createDataFrame(turns, TURNS), **kw).collect()
    assert sorted(map(tuple, got), key=str) == brute(turns, kw.get("borrow", 0))


def test_edges(spark):
    many = [(c, 0, "u", "same") for c in range(3000)] + [(9, 1, "u", "x" * 3_000_000)]
    df = spark.createDataFrame([(*r, "1", 2) for r in many], TURNS + ", d1 string, n int")
    got = sorted(map(tuple, prefix_trie.prefix_nodes(df, rows_per_shard=200).collect()), key=str)
    assert got == brute(many)
    assert prefix_trie.prefix_nodes(spark.createDataFrame([], TURNS), borrow=6).collect() == []
    alone = [(7, None, None, None)]
    assert list(map(tuple, prefix_trie.prefix_nodes(spark.createDataFrame(alone, TURNS), borrow=6).collect())) != []
    assert sorted(map(tuple, prefix_trie.prefix_nodes(spark.createDataFrame(alone, TURNS), borrow=6).collect()), key=str) == brute(alone, 6)
    with pytest.raises(ValueError):
        prefix_trie.prefix_nodes(df, borrow=6, stretch=3)


def test_query(spark):
    path = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, queries.op13_conversation_prefix_trie(spark, path).collect()), key=str) == brute(rows, 6)


def test_slots():
    rng = np.random.default_rng(0)
    d1, d2 = rng.integers(0, 1 << 40, 5000, dtype=np.uint64), rng.integers(0, 9, 5000, dtype=np.uint64)
    d1[:2000] = d1[2000:4000]  # equal first digests, mostly with other second ones
    t = SlotTable(d1, d2)
    pairs = sorted(set(zip(d1.tolist(), d2.tolist())))
    assert t.size == len(pairs) and sorted(zip(t.d1.tolist(), t.d2.tolist())) == pairs
    assert sorted({*t.slots.tolist()}) == [*range(t.size)] and np.array_equal(t.find(d1, d2), t.slots)
    assert (t.find(d1, d2 + np.uint64(9)) == -1).all()
    assert SlotTable(d1[:0], d2[:0]).size == 0


def test_slots_fold_anew_when_two_pairs_meet(monkeypatch):
    fold = SlotTable._fold
    monkeypatch.setattr(SlotTable, "_fold", lambda self, a, b: a if self.seed == 0 else fold(self, a, b))
    t = SlotTable(np.array([5, 5, 6], np.uint64), np.array([1, 2, 1], np.uint64))
    assert t.seed == 1 and t.size == 3
