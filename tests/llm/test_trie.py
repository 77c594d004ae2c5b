"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from waymark.llm import trie

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "conv_id long, turn long, role string, text string, keys string, depth int"


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[c].append(((turn is not None, turn or 0, role, key), role, text))
    own = {c: [(r, t) for _, r, t in sorted(x)] for c, x in turns.items()}
    made = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - c % 20, [])[:h] + x[h:]
    members, ends = defaultdict(set), defaultdict(list)
    for c, x in made.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].add(c)
        ends[tuple(x)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for n in members:
        if n:
            children[n[:-1]] += 1
    for n in members:
        words = len(WORD.findall(n[-1][1])) if n else 0
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(members[n]) - 1) * words
    sha = lambda n: hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], sha(n)) for n, m in members.items()
    )


def rows_of(seed):
    r = random.Random(seed)
    texts = ["", None, "hello there", " \t\n", "a b c", "x" * 3000, "é 漢 \x85 w", "## x"]
    rows = []
    for c in [*range(0, 70), 121, 122, 140, 141, 2**40]:
        kind = r.random()
        n = 0 if kind < 0.1 else r.choice((1, 1, 2, 3, 4, 5))
        for i in range(n):
            rows.append((c, r.choice((i, i, i, None)), r.choice(("user", "user", None)), r.choice(texts), "clash", 1))
    rows += rows[:7]  # repeated rows are repeated turns
    for c in range(1000, 1040):  # copies of one conversation
        rows += [(c, i, "user", f"turn {i} of many", "clash", 1) for i in range(6)]
    rows += [(2001, i, "user" if i % 2 else "assistant", f"long {i}", None, None) for i in range(900)]
    rows += [(None, 0, "user", "no conversation", None, None)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_query(spark, tmp_path, seed):
    rows = rows_of(seed)
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = trie.op13_conversation_trie(spark, str(tmp_path))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=lambda x: x[:2]) == brute(rows)


def test_intervals_nest(spark):
    """A child's interval lies inside its parent's, siblings' don't meet, and all together are 1 to n."""
    nodes = {bytes(n.id): n for n in trie.prefix_trie(trie.turn_lists(spark.createDataFrame(rows_of(4), SCHEMA))).collect()}
    assert sorted(n.start for n in nodes.values()) == list(range(1, len(nodes) + 1))
    below = defaultdict(list)
    for n in nodes.values():
        if n.parent is not None:
            up = nodes[bytes(n.parent)]
            assert up.start < n.start and n.end <= up.end and n.depth == up.depth + 1
            below[bytes(n.parent)].append((n.start, n.end))
    for up, spans in below.items():
        spans.sort()
        assert spans[0][0] == nodes[up].start + 1 and spans[-1][1] == nodes[up].end
        assert all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:]))


def test_pieces_of_many_ends(spark):
    """A node at which very many conversations end, its list longer than a piece and a batch."""
    rows = [(c, 0, "user", "hi") for c in range(30_000)]
    lists = trie.turn_lists(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    end = trie.prefix_trie(lists).where("depth = 1").collect()
    assert [e.ends_sha256 for e in end] == [hashlib.sha256(",".join(map(str, range(30_000))).encode()).hexdigest()]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert trie.op13_conversation_trie(spark, str(tmp_path)).count() == 0


def test_turnless_conversation_ends_at_the_root(spark):
    lists = spark.createDataFrame([(1, [], []), (2, [], [])], "c long, keys array<string>, words array<long>")
    root = trie.prefix_trie(lists).collect()
    assert [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_leaves, r.ends_sha256) for r in root] == [(1, 0, None, 2, 1, hashlib.sha256(b"1,2").hexdigest())]
