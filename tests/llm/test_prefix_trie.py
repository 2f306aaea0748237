"""The conversation trie against a plain version with dictionaries, over many small shards."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb

import llm.prefix_trie as pt
from llm.prefix_trie import OP11_SQL, TernaryTree, branched, median_order, prefix_trie, sequences

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    out = {}
    for c, path in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + path[h:]
    return out


def plain(paths):
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, m in members.items():
        ids = ",".join(str(c) for c in sorted(m) if len(paths[c]) == len(p))
        up = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), up, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=lambda x: x[:2])


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda x: x[:2])


def some_turns(seed, n, words=3):
    random.seed(seed)
    rows = []
    for c in random.sample(range(4 * n), n):
        for t in range(random.choice([0, 1, 2, 3, 5, 12])):
            text = random.choice(["é" * k for k in range(1, words + 1)])
            rows.append((c, random.choice([t, t, t, None, 0]), random.choice(["user", "bot"]), text))
    return rows


def test_tree_and_medians():
    random.seed(1)
    paths = sorted({tuple(random.choices(range(6), k=random.randint(0, 5))) for _ in range(200)})
    tree = TernaryTree()
    last = {paths[i]: tree.insert(paths[i]) for i in median_order(len(paths))}
    assert sorted(median_order(9)) == list(range(9))
    order, parent = tree.walk()
    assert len(order) == len(set(order)) == len({p[:d] for p in paths for d in range(1, len(p) + 1)})
    for path, node in last.items():
        back = []
        while node >= 0:
            back.append(tree.turn[node])
            node = parent[node]
        assert tuple(back[::-1]) == path
    assert all(order.index(parent[x]) < order.index(x) for x in order[::17] if parent[x] >= 0)


def test_equals_a_plain_version_over_many_shards(spark, monkeypatch):
    odd = [(5, 1, None, None), (5, 1, None, None), (6, None, "user", "a"), (None, 0, "user", "lost"), (-7, 0, "user", "é"), (-5, 0, "bot", "éé")]
    for seed, shard_turns in ((2, 4), (3, 25), (4, 100_000)):
        monkeypatch.setattr(pt, "SHARD_TURNS", shard_turns)
        rows = some_turns(seed, 120) + odd
        turns = spark.createDataFrame(rows, SCHEMA).repartition(3)
        assert found(prefix_trie(branched(sequences(turns)))) == plain(rebuilt(rows))


def test_many_copies_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(pt, "SHARD_TURNS", 30)
    monkeypatch.setattr(pt, "PIECE", 4)
    paths = {c: [("user", "same"), ("bot", "answer")] for c in range(0, 300, 2)}
    paths |= {c: [("user", "same"), ("bot", "answer"), ("user", f"more {c % 4}")] for c in range(1, 60, 2)}
    paths |= {1000: [], 1001: [("user", "other")], 1002: [("x", str(i)) for i in range(100)]}
    number = {x: i for i, x in enumerate(sorted({t for p in paths.values() for t in p}))}
    rows = [(c, [number[t] for t in p], [len(t[1]) for t in p]) for c, p in paths.items()]
    df = spark.createDataFrame(rows, "conv_id long, path array<long>, sizes array<int>")
    assert found(prefix_trie(df)) == plain(paths)


def test_sql_counts_the_same():
    rows = some_turns(9, 60)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    names = "conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256"
    got = con.execute(f"SELECT {names} FROM ({OP11_SQL})").fetchall()
    assert sorted(got, key=lambda x: x[:2]) == plain(rebuilt(rows))


def test_no_conversations_and_other_columns(spark):
    assert prefix_trie(branched(sequences(spark.createDataFrame([], SCHEMA)))).count() == 0
    df = spark.createDataFrame([(1, 0, "user", "x", 9, 9)], SCHEMA + ", path int, number int")
    assert prefix_trie(sequences(df)).count() == 2
