"""The conversation trie against brute force, in one piece and in blocks."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from pathflow.llm import conversation_trie as trie
from pathflow.llm import queries

MIDDLE = "/root/testdata/sf0.01"
TURNS = "conv_id long, turn long, role string, text string"
SMALL_BLOCKS = trie.Settings(long_turns=7, buffer=11, fan=1, chunk=2)


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def by_hand(turns, graft=trie.Graft()):
    """Node rows of turns (conv, turn, role, text)."""
    own = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            role, text = role or "", text or ""
            key = digest(role, text)[:16]
            halves = [int.from_bytes(key[i : i + 8], "big", signed=True) for i in (0, 8)]
            own[conv].append(((turn is not None, turn or 0, *halves), (role, text)))
    own = {c: [x for _, x in sorted(v, key=lambda r: r[0])] for c, v in own.items()}
    built = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % graft.most
        donor = c - (abs(c) % graft.every) * (1 if c > 0 else -1)
        built[c] = tuple(own.get(donor, [])[:h] + mine[h:])
    nodes = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            nodes[built[c][:d]].append(c)
    kids = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for k in nodes:
        if k:
            kids[k[:-1]] += 1
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(members) - 1) * (len(k[-1][1]) if k else 0)
            leaves[k[:d]] += k not in kids
    out = []
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in members if built[c] == k)
        out.append((members[0], len(k), nodes[k[:-1]][0] if k else None, len(members), kids[k] if k in kids else 0, leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def by_spark(spark, turns, **more):
    df = spark.createDataFrame(turns, TURNS)
    found = trie.prefix_trie(df, **more).nodes
    return sorted(tuple(r) for r in found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def some_turns(seed, convs, longest=9, words=2):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        for t in range(rng.randint(1, longest)):
            rows.append((c, None if rng.random() < 0.03 else rng.choice((t, t, t, 0)), rng.choice(("user", "user", None)), rng.choice(("", None, "a" * rng.randint(1, words), "é漢"))))
    rng.shuffle(rows)
    return rows + rows[:3]  # repeated rows


@pytest.mark.parametrize("settings", [trie.Settings(), SMALL_BLOCKS])
def test_many_short_conversations(spark, settings):
    turns = some_turns(1, [*range(0, 60), *range(101, 130), *range(-40, -1), 10**12, 10**12 + 5])
    assert by_spark(spark, turns, settings=settings) == by_hand(turns)


def test_long_conversations_in_blocks(spark):
    rng = random.Random(3)
    turns = some_turns(2, [5, 6, 7, 150, 203])
    for c, n in ((100, 40), (101, 33), (102, 8), (205, 60), (300, 25), (301, 3), (5, 20)):
        turns += [(c, t // 2, "user", "same" if rng.random() < 0.9 else "other") for t in range(n)]
    turns += [(401 + k, t, "user", "same") for k in range(6) for t in range(16)]  # copies, without a donor
    expected = by_hand(turns)
    assert by_spark(spark, turns, settings=SMALL_BLOCKS) == expected
    assert by_spark(spark, turns) == expected


def test_chains_of_chains(spark):
    # every conversation leaves the one before a turn later
    turns = [(c, t, "user", f"t{t}" if t < c else f"end {c}") for c in range(1, 8) for t in range(c + 1)]
    none = trie.Graft(most=1)
    assert by_spark(spark, turns, graft=none) == by_hand(turns, none)
    assert by_spark(spark, turns, graft=none, settings=SMALL_BLOCKS) == by_hand(turns, none)


def test_conversations_without_turns(spark):
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1)
    turns = [(c, 0, "user", "gone"), (c + 1000, 1, None, None)]
    rows = by_spark(spark, turns)
    assert rows == by_hand(turns)
    assert rows[0][:6] == (c, 0, None, 2, rows[0][4], 1)


def test_query_and_its_sql(spark):
    rows = sorted(tuple(r) for r in queries.op12_conversation_trie(spark, MIDDLE).collect())
    turns = [tuple(r) for r in spark.read.parquet(f"{MIDDLE}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows == by_hand(turns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{MIDDLE}/conversations.parquet'")
    assert sorted(con.execute(queries.ORACLE_SQL["op12_conversation_trie"]).fetchall()) == rows


def test_odd_tables(spark):
    odd = [(None, 0, "user", "no conversation"), (7, None, None, None), (7, None, None, None), (8, 3, "", ""), (0, 0, "user", "x" * 200_000)]
    assert by_spark(spark, odd) == by_hand(odd)
    assert by_spark(spark, []) == []
    clashing = spark.createDataFrame(odd, TURNS).selectExpr("*", "conv_id AS family", "turn AS a", "text AS rep", "role AS conv")
    assert sorted(tuple(r)[2:] for r in trie.prefix_trie(clashing).nodes.collect()) == by_hand(odd)


def test_end_lists_hold_all_members(spark):
    turns = [(c, 0, "user", "same") for c in range(3_000)]
    found = trie.prefix_trie(spark.createDataFrame(turns, TURNS), graft=trie.Graft(most=1)).ends.collect()
    assert sorted(i for r in found for i in r["conv_ids"]) == list(range(3_000))
    assert max(len(r["conv_ids"]) for r in found) <= 1_000 and all(r["first"] == r["conv_ids"][0] for r in found)
