"""The prefix trie beside a plain one of nested dictionaries."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.llm import queries, trie

SCHEMA = "conv_id long, turn int, role string, text string"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def digest(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def sequences(rows):
    """conv_id -> [(role, text)] in order."""
    out = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            out.setdefault(conv, []).append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    return {c: [t[-1] for t in sorted(turns)] for c, turns in out.items()}


def again(convs):
    """The conversations of the query: each begins with turns of another one."""
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def plain(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0
        leaves[p] = sum(leaves[x] for x in children.get(p, [])) or 1
        saved[p] = own + sum(saved[x] for x in children.get(p, []))
    rows = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(p))
        parent = min(nodes[p[:-1]]) if p else None
        said = hashlib.sha256(ends.encode()).hexdigest()
        rows.append((min(members), len(p), parent, len(members), len(children.get(p, [])), leaves[p], saved[p], said))
    return sorted(rows, key=str)


def got(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=str)


def dialogues(seed, n):
    """Conversations with common first turns, copies, beginnings of others, one long one with a copy, odd rows."""
    rng, rows = random.Random(seed), []
    for c in range(n):
        conv = c * 2 if c % 3 else c + 1000
        size = rng.randrange(0, 12)
        rows += [(conv, t, rng.choice(["user", "bot", None]), rng.choice(["a", "b", "é漢", "", None])) for t in range(size)]
    rows += [(c, t, "u", f"x{t % 7}") for c in (5000, 5001, 5005) for t in range(300)]
    rows += [(6000, None, "u", "x"), (6000, None, None, None), (6000, 3, "u", "y"), (6000, 3, "u", "y"), (6000, 3, "u", "z"), (None, 1, "u", "lost"), (7000, -5, "u", "q")]
    rng.shuffle(rows)
    return rows


@pytest.fixture
def small(monkeypatch):
    """Units, blocks and chunks so small that every mechanism is used."""

    def set_to(unit, block, chunk):
        monkeypatch.setattr(trie, "UNIT", unit)
        monkeypatch.setattr(trie, "BLOCK", block)
        monkeypatch.setattr(trie, "CHUNK", chunk)

    return set_to


@pytest.mark.parametrize("unit,block,chunk", [(1 << 18, 1 << 12, 1 << 16), (40, 16, 3), (7, 4096, 1 << 16)])
def test_equals_the_plain_trie(spark, small, unit, block, chunk):
    small(unit, block, chunk)
    rows = dialogues(1, 60)
    turns = spark.createDataFrame(rows, SCHEMA).withColumn("len", F.lit("mine")).withColumn("p", F.lit(3)).repartition(4)
    assert got(trie.of_conversations(turns)) == plain(sequences(rows))


@pytest.mark.parametrize("unit,block,chunk", [(1 << 18, 1 << 12, 1 << 16), (40, 8, 5)])
def test_rebuilt_conversations(spark, small, unit, block, chunk):
    small(unit, block, chunk)
    rows = dialogues(2, 50)
    c = F.col("conv_id")
    heads = F.crc32(c.cast("string").cast("binary")) % 9
    found = trie.trie(*trie.rebuilt(spark.createDataFrame(rows, SCHEMA), c - c % 5, heads))
    assert got(found) == plain(again(sequences(rows)))


def test_empty_and_turnless(spark):
    assert got(trie.of_conversations(spark.createDataFrame([], SCHEMA))) == []
    # 1 takes none of the absent 0, and all its own turns give way.
    rows = [(1, 0, "u", "x")]
    assert zlib.crc32(b"1") % 9 >= 1
    c = F.col("conv_id")
    found = trie.trie(*trie.rebuilt(spark.createDataFrame(rows, SCHEMA), c - c % 5, F.crc32(c.cast("string").cast("binary")) % 9))
    assert got(found) == plain({1: []})


def test_slots_are_minimal_and_verified():
    keys = np.random.default_rng(1).integers(0, 2**64, (5000, 2), dtype=np.uint64)
    slots = trie.Slots(keys)
    assert sorted(slots.find(keys).tolist()) == list(range(5000))
    assert (slots.find(keys ^ np.uint64(1)) == -1).all()
    with pytest.raises(ValueError):
        trie.Slots(np.concatenate([keys, keys[:1]]))


def test_a_collision_stops(spark):
    rows = [(b"p" * 16, None, 0, "", 0, c, 1, True) for c in (1, 2)]
    rows[1] = rows[1][:3] + ("other",) + rows[1][4:]
    schema = "p binary, q binary, depth long, t string, bytes long, conv_id long, rest long, ends boolean"
    with pytest.raises(Exception, match="one digest"):
        trie.members(spark.createDataFrame(rows, schema)).collect()


def test_query(spark, sf):
    rows = [tuple(r) for r in queries.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.QUERIES["op11_prefix_trie"](spark, sf)) == plain(again(sequences(rows)))
