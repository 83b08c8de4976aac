"""The prefix trie against a plain one, with many shards, bands of levels and spilling queues."""

import hashlib
import random
import zlib

import pytest

from factloom.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string, node string, depth string, Parent string"


def digest(role, text):
    role, text = (role or "").encode(), (text or "").encode()
    return hashlib.sha256(str(len(role)).encode() + b":" + role + text).digest()


def rebuilt(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append(((turn is not None, turn or 0), digest(role, text), role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        family = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = turns.get(family, [])[:h] + own[h:]
    return out


def trie(rows):
    convs, nodes = rebuilt(rows), {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = {}
    for path in sorted(nodes, key=len, reverse=True):
        children = [out[p] for p in nodes if len(p) == len(path) + 1 and p[:-1] == path] if len(nodes) < 4000 else None
        members = sorted(nodes[path])
        saved = (len(members) - 1) * len(path[-1][1].encode()) if path else 0
        ends = ",".join(str(c) for c in members if len(convs[c]) == len(path))
        out[path] = [members[0], len(path), min(nodes[path[:-1]]) if path else None, len(members), len(children), sum(x[5] for x in children) or 1, saved + sum(x[6] for x in children),
                     hashlib.sha256(ends.encode()).hexdigest()]
    return sorted((tuple(x) for x in out.values()), key=repr)


def conversations(seed, n=60, most=9):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, most)):
            rows.append((c * 3 - 20, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "é", "longer text"])))
    rows += [(5, None, None, None), (5, 1, "user", None), (5, 1, "user", None), (None, 0, "user", "x"), (1000, 0, "system", "s"), (1001, 0, "user", "u"), (1004, 3, "user", "u"),
             (7777, 2, "user", "alone")]
    rows += [(3000, t, "user", f"step {t % 7}") for t in range(70)] + [(3001, t, "user", f"step {t % 7}") for t in range(70)]
    rng.shuffle(rows)
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "n", "d", "p") for r in rows], TURNS)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"shard_rows": 4, "band": 3, "queued": 2}, {"shard_rows": 0, "band": 2, "queued": 1 << 17}])
def test_against_a_plain_trie(spark, options):
    rows = conversations(1)
    assert found(prefix_trie.prefix_trie(table(spark, rows), **options)) == trie(rows)


def test_long_conversations_are_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "TURNS_IN_BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 2)
    rows = conversations(2, 40, 14) + [(4000, 0, "user", "again")] * 600 + [(c, 0, "user", "same") for c in range(10_000, 10_040)]
    assert found(prefix_trie.prefix_trie(table(spark, rows))) == trie(rows)


def test_no_conversations(spark):
    assert prefix_trie.prefix_trie(table(spark, [])).collect() == []
    assert prefix_trie.prefix_trie(table(spark, [(None, 1, "user", "x")])).collect() == []


def test_turnless_conversations(spark):
    # the family's first conversation is missing and all own turns are dropped
    lost = next(c for c in range(100_001, 200_000, 5) if zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(lost, 0, "user", "x"), (lost, 1, "user", "y")]
    assert found(prefix_trie.prefix_trie(table(spark, rows))) == [(lost, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lost).encode()).hexdigest())]


def test_queue_spills_in_order(tmp_path):
    rng = random.Random(3)
    messages = [(-rng.randint(1, 20), bytes([rng.randint(0, 5)]) * 16, rng.randint(0, 9), rng.randint(0, 9)) for _ in range(2000)]
    queue = prefix_trie.SpillingQueue(f"file://{tmp_path}/queue", 50)
    for m in messages:
        queue.push(m)
    assert len(queue.files) > 10
    for level, node in sorted({m[:2] for m in messages}):
        mine = [m for m in messages if m[:2] == (level, node)]
        assert queue.take(level, node) == (sum(m[2] for m in mine), sum(m[3] for m in mine))
    queue.close()
    assert not any(tmp_path.joinpath("queue").iterdir())
    queue.push((-1, b"x" * 16, 1, 1))
    with pytest.raises(ValueError):
        queue.close()
