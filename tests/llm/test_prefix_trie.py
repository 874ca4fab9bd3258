import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from trackloom.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append(((t is not None, t or 0), role or "", text or ""))
    turns = {c: [r[1:] for r in sorted(v)] for c, v in turns.items()}
    again = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        again[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    nodes = defaultdict(list)
    for c, seq in again.items():
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
    kids = defaultdict(list)
    for key in nodes:
        if key:
            kids[key[:-1]].append(key)
    out = {}

    for key in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[key]) - 1) * (len(key[-1][1].encode()) if key else 0)
        below = [out[k] for k in kids[key]]
        ends = ",".join(str(c) for c in sorted(c for c in nodes[key] if len(again[c]) == len(key)))
        out[key] = (min(nodes[key]), len(key), min(nodes[key[:-1]]) if key else None, len(nodes[key]), len(below), sum(b[5] for b in below) or 1, own + sum(b[6] for b in below), hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def made(seed, n=60):
    rng, rows = random.Random(seed), []
    texts = ["hello", "höw are you", "", None, "fine\x00thanks", "hello you"]
    for c in range(n):
        shape = rng.random()
        for t in range(rng.choice((1, 2, 3, 6, 12, 20))):
            same = t % 4 if shape < 0.6 else rng.randrange(6)
            rows.append((c, rng.choice((t, t, t, None)) if shape > 0.8 else t, rng.choice(("user", "user", None)) if shape > 0.7 else "user", texts[same]))
    rng.shuffle(rows)
    return rows


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    out = trie.prefix_trie(df.repartition(5) if rows else df, **options)
    assert out.columns == COLUMNS
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("room", [1, 12, None])
def test_equals_brute_force(spark, room):
    """With room for one turn all nodes are above the shards, by default all but the root are in them."""
    rows = made(room or 3) + [(None, 1, "user", "lost"), (200, 0, "a", "b"), (200, 0, "a", "b"), (777, None, None, None)]
    assert run(spark, rows, room=room, held=3) == brute(rows)


def test_long_conversation_and_many_copies(spark):
    """One conversation holds a third of all rows, copies of another a third."""
    rows = [(1, t, "user", f"t{t % 7}") for t in range(3000)]
    rows += [(1000 + c, t, "user", f"same{t}") for c in range(300) for t in range(10)]
    rows += [(5000 + c, t, "user", f"own{c}" if t else "open") for c in range(900) for t in range(3)]
    assert run(spark, rows, room=200, held=50) == brute(rows)


def test_all_turnless(spark):
    absent = [c for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9][:6]
    rows = [(c, 0, "user", "gone") for c in absent]
    got = run(spark, rows)
    assert got == brute(rows) and len(got) == 1 and got[0][3] == 6


def test_edges(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 0, "user", "x")]) == []
    assert run(spark, [(0, None, None, None)]) == brute([(0, None, None, None)])


def test_given_conversations_and_sql(spark):
    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{at}/conversations.parquet'")
    rows = con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    cur = con.execute(trie.SQL)
    assert [c[0] for c in cur.description] == COLUMNS
    got = sorted(map(tuple, trie.op12_conversation_prefix_trie(spark, at).collect()), key=str)
    assert got == brute(rows) == sorted(cur.fetchall(), key=str)


def test_queue_spills_and_keeps_order():
    rng, queue = random.Random(1), trie.SpillingQueue(7)
    waiting, got, want = [], [], []
    for _ in range(500):
        if waiting and rng.random() < 0.4:
            waiting.sort()
            want.append(waiting.pop(0))
            assert queue.first() == want[-1]
            got.append(queue.pop())
        else:
            item = (rng.randrange(100), rng.randrange(10))
            waiting.append(item)
            queue.push(item)
    while queue.first() is not None:
        got.append(queue.pop())
    assert got == want + sorted(waiting) and queue.spilled > 10
