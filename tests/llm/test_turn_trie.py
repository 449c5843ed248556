"""The prefix trie against a plain version, and the radix tree's layouts."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from dockspan.llm.radix_tree import Direct, Indexed, RadixTree, Sorted, shared
from dockspan.llm.turn_trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, node int, parent int"


def digest(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def plain(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0), digest(role, text), (role, text)))
    own = {c: [t[2] for t in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        lead = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(own.get(lead, [])[:h] + turns[h:])
    members = collections.defaultdict(set)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].add(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if rebuilt[c] == p)
        parent = min(members[p[:-1]]) if p else None
        key = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(m), len(p), parent, len(m), children[p], leaves[p], saved[p], key))
    return order(out)


def order(rows):
    return sorted(rows, key=lambda r: (r[0], r[1], r[3], r[2] is not None, r[2], *r[4:]))


def found(frame):
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return order([tuple(r[n] for n in names) for r in frame.collect()])


def conversations(seed, count):
    rng = random.Random(seed)
    rows = []
    for c in range(count):
        conv = rng.choice([c, c, c + 100 * rng.randint(0, 3)])
        if any(r[0] == conv for r in rows):
            continue
        first = 0 if rng.random() < 0.5 else rng.randint(0, 3)
        for turn in range(rng.choice([1, 2, 3, 5, 8])):
            word = first if turn == 0 else rng.randint(0, 2)
            rows.append((conv, turn, rng.choice(["user", "bot", None]), rng.choice([f"w{word}" * (word + 1), "", None, "é日"])))
    rows += [(5000 + i, t, "u", "same") for i in range(40) for t in range(3)]
    rows += [(7000, t, "u", f"long {t % 7}") for t in range(60)] + [(7001, t, "u", f"long {t % 7}") for t in range(55)]
    return rows


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("part_turns", [100_000, 60, 3])
def test_nodes(spark, part_turns):
    rows = conversations(1, 60)
    assert found(prefix_trie(frame_of(spark, rows), part_turns=part_turns)) == plain(rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [
        (None, 0, "u", "lost"), (0, None, "u", "b"), (0, 0, "u", "a"), (0, 0, "u", "a"), (0, 1, None, None), (0, 1, "", ""),
        (7, 3, "u", "c"), (7, None, "u", "d"), (-5, 0, "u", "neg"), (-5, 2, "u", "neg"), (205, 0, "u", "no lead"),
    ]
    for part_turns in (100_000, 2):
        assert found(prefix_trie(frame_of(spark, rows), part_turns=part_turns)) == plain(rows)


def test_ids_over_several_lists(spark):
    rows = [(100 * c, 0, "u", "same") for c in range(60)]
    assert found(prefix_trie(frame_of(spark, rows), part_turns=10)) == plain(rows)


def test_turnless_and_empty(spark):
    short = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(short, 0, "u", "only")]
    assert found(prefix_trie(frame_of(spark, rows))) == plain(rows) and len(plain(rows)) == 1
    assert prefix_trie(frame_of(spark, rows).where(F.lit(False))).collect() == []
    assert prefix_trie(frame_of(spark, [(None, 1, "u", "x")])).collect() == []


def test_long_conversation(spark):
    rows = [(1, t, "u", str(t)) for t in range(240)] + [(2, t, "u", str(t)) for t in range(233)]
    assert found(prefix_trie(frame_of(spark, rows), part_turns=50)) == plain(rows)


def test_layouts_grow():
    tree = RadixTree()
    kinds = []
    keys = [bytes([7, 7, b]) + bytes([b % 3]) * 5 for b in range(256)]
    random.Random(2).shuffle(keys)
    for count, key in enumerate(keys, 1):
        tree.insert(key, count)
        if count > 1:
            top = next(tree.root.below())
            assert top.path == b"\7" and len(top.children) == count
            kinds.append((type(top.children), getattr(top.children, "limit", None)))
    assert kinds[0] == (Sorted, 4) and kinds[6] == (Sorted, 16) and kinds[30][0] is Indexed and kinds[-1][0] is Direct
    tree.insert(b"\7\7", "whole")
    tree.insert(b"\7", "part")
    part = next(tree.root.below())
    whole = next(part.below())
    assert (part.path, part.held, whole.path, whole.held) == (b"", "part", b"", "whole")
    assert [n.path[0] for n in whole.below()] == [b % 3 for b in range(256)]


@pytest.mark.parametrize("a, b, n", [(b"", b"x", 0), (b"ab", b"abc", 2), (b"abd", b"abc", 2), (b"x", b"y", 0), (b"abc", b"abc", 3)])
def test_shared(a, b, n):
    assert shared(a, b) == n
