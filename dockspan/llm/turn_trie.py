"""The trie of conversation prefixes, from adaptive radix trees over turn ids.

A turn's id is the 128-bit digest of its role and text, so a conversation is a byte
string of 16 bytes a turn. Equal strings are grouped first, then all different ones
are dealt by range into sorted parts of bounded turns, whatever prefixes they share.
Every part builds one radix tree; only byte depths at whole turns give nodes, those
inside compressed paths included. The nodes that a part shares with its neighbours
lie on the paths of its first and last string; their counts add up over the parts.
All other nodes are complete in their part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from dockspan.llm.radix_tree import Node, RadixTree, shared
from dockspan.llm.tables import stored
from dockspan.operators.durable import durable
from dockspan.operators.sizing import attach

ID_BYTES = 16
# Turns of one part, and neighbouring conversation ids listed together before the lists of a string are joined.
PART_TURNS, LIST_IDS = 100_000, 1024
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    """Digest of role and text; the role's length keeps the two apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))


def original_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): every conversation's turns in order, as ids and lengths of texts.

    Null turn numbers come first and equal ones in order of their ids.
    """
    size = F.coalesce(F.char_length("text"), F.lit(0)).alias("size")
    placed = F.struct("turn", turn_id(F.col("role"), F.col("text")).alias("id"), size).alias("placed")
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", placed)
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("placed")).alias("turns"))


def rebuilt_turns(own: DataFrame, family: int, kinds: int) -> DataFrame:
    """(conv_id, key, sizes) with the first turns of every ``family``-th conversation before the own later ones.

    How many, below ``kinds``, is decided by a checksum of the id.
    """
    lead = F.col("conv_id") - F.col("conv_id") % family
    most = max(kinds - 1, 1)
    leads = own.where(F.col("conv_id") == lead).select(F.col("conv_id").alias("lead"), F.slice("turns", 1, most).alias("first"))
    joined = own.withColumn("lead", lead).join(leads, "lead", "left")
    taken = (F.crc32(F.col("conv_id").cast("string")) % kinds).cast("int")
    first = F.when(taken > 0, F.slice(F.coalesce("first", F.slice("turns", 1, 0)), 1, taken)).otherwise(F.slice("turns", 1, 0))
    whole = joined.select("conv_id", F.concat(first, F.slice("turns", taken + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), ""))
    return whole.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes"))


def different_strings(conversations: DataFrame) -> DataFrame:
    """(key, sizes, n, least, ends): every different string once, with how many conversations have it,
    the least id and the digest of all ids in order.

    Ids are listed by ranges of bounded length first, so a string that very many
    conversations share meets one task as few rows, which passes them on to the digest one by one.
    """
    listed = (
        conversations.withColumn("range", F.floor(F.col("conv_id") / LIST_IDS))
        .groupBy(F.sha2("key", 256).alias("digest"), "range")
        .agg(
            F.any_value("key").alias("key"),
            F.any_value("sizes").alias("sizes"),
            F.count(F.lit(1)).alias("n"),
            F.min("conv_id").alias("least"),
            F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"),
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if current is None or row["digest"] != current["digest"]:
                    if current:
                        done.append(current)
                    current = {**row, "state": hashlib.sha256(row["ids"].encode())}
                else:
                    current["n"] += row["n"]
                    current["least"] = min(current["least"], row["least"])
                    current["state"].update(b"," + row["ids"].encode())
            if done:
                yield batch_of(done)
        if current:
            yield batch_of([current])

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        for row in rows:
            row["ends"] = row.pop("state").hexdigest()
        return pa.RecordBatch.from_pylist([{name: row[name] for name in schema.names} for row in rows], schema)

    schema = pa.schema(
        [("key", pa.binary()), ("sizes", pa.list_(pa.int32())), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.string())]
    )
    ordered = listed.repartition("digest").sortWithinPartitions("digest", "range")
    return ordered.mapInArrow(run, "key binary, sizes array<int>, n long, least long, ends string")


class PartTrie:
    """Trie nodes of the sorted strings of one part.

    ``before`` turns of its first string are nodes of the part before too, and ``after``
    turns of its last string are nodes of the part after; -1 where there is no such part.
    """

    def __init__(self, rows: list[dict], before: int, after: int):
        self.tree = RadixTree()
        for row in rows:
            self.tree.insert(row["key"], row)
        self.before, self.after = before, after
        self.first, self.last = rows[0]["key"], rows[-1]["key"]
        self.first_ids, self.last_ids = _prefix_ids(self.first, before), _prefix_ids(self.last, after)

    def _shared_depths(self, key: bytes, least: int) -> tuple[int, int]:
        """Down to which depth, from ``least`` on, the nodes of ``key`` are shared with the part before and the part after."""
        before = min(self.before, shared(key, self.first) // ID_BYTES) if least <= self.before else -1
        after = min(self.after, shared(key, self.last) // ID_BYTES) if least <= self.after else -1
        return before, after

    def rows(self) -> Iterator[dict]:
        """All nodes: shared ones with ``node``, those below a shared one with its id as ``parent``."""
        order: list[tuple[Node, int, int, int]] = []
        stack = [(self.tree.root, -1, -1)]
        while stack:
            node, above, parent_end = stack.pop()
            end = parent_end + 1 + len(node.path)
            stack += [(child, len(order), end) for child in node.below()]
            order.append((node, above, parent_end, end))
        found = [self._nodes(node, parent_end, end) for node, _, parent_end, end in reversed(order)][::-1]
        deepest: list[dict | None] = []
        for nodes, (_, above, _, _) in zip(found, order, strict=True):
            parent = deepest[above] if above >= 0 else None
            for own in nodes:
                own["parent"] = parent and parent["node"]
                own["parent_conv_id"] = parent["conv_id"] if parent and parent["node"] is None else None
                yield own
                parent = own
            deepest.append(parent)

    def _nodes(self, node: Node, parent_end: int, end: int) -> list[dict]:
        """Nodes at whole turns between the parent's end and ``end``, uppermost first; the node gets its sums."""
        held, below = node.held, [child.sums for child in node.below()]
        row = held or below[0][5]
        n = sum(s[0] for s in below) + (held["n"] if held else 0)
        least = min([s[1] for s in below] + ([held["least"]] if held else []))
        leaves, saved, tops = (sum(s[i] for s in below) for i in (2, 3, 4))
        depths = range(parent_end // ID_BYTES + 1, end // ID_BYTES + 1)
        before, after = self._shared_depths(row["key"], depths.start) if depths else (-1, -1)
        nodes = []
        for depth in reversed(depths):
            whole = depth * ID_BYTES == end
            opened = depth > before
            # The part after holds a longer string with this prefix.
            leaves += whole and not below and depth > after
            # A node counts (members - 1) times its last text; only the part that opens it takes the 1 away.
            saved += (n - opened) * (row["sizes"][depth - 1] if depth else 0)
            nodes.append(
                {
                    "node": self.first_ids[depth] if not opened else self.last_ids[depth] if depth <= after else None,
                    "depth": depth,
                    "conv_id": least,
                    "n_convs": n,
                    "n_children": tops,
                    "n_leaves": leaves,
                    "saved_tokens": saved,
                    "ends_sha256": held["ends"] if whole and held else None,
                }
            )
            tops = int(opened)
        node.sums = (n, least, leaves, saved, tops, row)
        return nodes[::-1]


def _prefix_ids(key: bytes, depth: int) -> list[bytes]:
    """Digests of the first 0, 1, ... ``depth`` turns of ``key``."""
    state, found = hashlib.md5(), []
    for at in range(depth + 1):
        state.update(key[(at - 1) * ID_BYTES : at * ID_BYTES] if at else b"")
        found.append(state.copy().digest())
    return found


FIELDS = pa.schema(
    [
        ("node", pa.binary()),
        ("parent", pa.binary()),
        ("depth", pa.int64()),
        ("conv_id", pa.int64()),
        ("parent_conv_id", pa.int64()),
        ("n_convs", pa.int64()),
        ("n_children", pa.int64()),
        ("n_leaves", pa.int64()),
        ("saved_tokens", pa.int64()),
        ("ends_sha256", pa.string()),
    ]
)
COLUMNS = (
    "node binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
)


def shared_depths(strings: DataFrame) -> dict[int, tuple[int, int]]:
    """By part: turns of its first string shared with the part before, and of its last one with the part after.

    Two strings a part meet in one task; two small numbers a part come to the driver.
    """
    ends = strings.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    order = Window.orderBy("part")
    beside = ends.select("*", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r["part"] for r in rows], pa.int32()),
                    pa.array([_turns_shared(r["first"], r["before"]) for r in rows], pa.int32()),
                    pa.array([_turns_shared(r["last"], r["after"]) for r in rows], pa.int32()),
                ],
                names=["part", "before", "after"],
            )

    found = beside.mapInArrow(run, "part int, before int, after int").collect()
    return {r["part"]: (r["before"], r["after"]) for r in found}


def _turns_shared(one: bytes, other: bytes | None) -> int:
    return -1 if other is None else shared(one, other) // ID_BYTES


def part_nodes(strings: DataFrame) -> DataFrame:
    """The nodes of every part of ``strings`` by its own tree."""
    known = strings.sparkSession.sparkContext.broadcast(shared_depths(strings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in batch.to_pylist()]
        if not rows:
            return
        held = []
        for node in PartTrie(rows, *known.value[rows[0]["part"]]).rows():
            held.append(node)
            if len(held) == 8192:
                yield pa.RecordBatch.from_pylist(held, FIELDS)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, FIELDS)

    return strings.mapInArrow(run, COLUMNS)


def prefix_trie(turns: DataFrame, family: int = 100, kinds: int = 6, part_turns: int = PART_TURNS) -> DataFrame:
    """All nodes of the trie of rebuilt conversations.

    A conversation is rebuilt from the first turns of the conversation at the
    start of its ``family`` and its own later turns; how many, below ``kinds``,
    follows from a checksum of its id. Null turns come first, equal turns in
    order of their ids, null roles and texts are empty, rows with a null conv_id
    belong to no conversation, repeated rows are turns of their own. Without
    conversations there is no node. Extra columns are left out. One conversation
    is one row of 20 bytes a turn; a part holds about ``part_turns`` turns.
    """
    conversations = rebuilt_turns(durable(original_turns(turns)), family, kinds)
    strings = stored(different_strings(conversations), "strings")
    total = strings.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    parts = max(1, -(-total // part_turns))
    dealt = durable(strings.repartitionByRange(parts, "key").sortWithinPartitions("key"))
    nodes = stored(part_nodes(dealt.withColumn("part", F.spark_partition_id())), "nodes")
    top = nodes.where("node IS NOT NULL").groupBy("node").agg(
        F.any_value("parent").alias("parent"),
        F.any_value("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"),
        F.lit(None).cast("long").alias("parent_conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("ends_sha256").alias("ends_sha256"),
    )
    top = durable(top)
    whole = nodes.where("node IS NULL").union(top.select(nodes.columns))
    parents = top.select(F.col("node").alias("parent"), F.col("conv_id").alias("top_conv_id"))
    below = attach(whole.where("parent IS NOT NULL"), parents, ["parent"]).withColumn("parent_conv_id", F.col("top_conv_id"))
    rows = whole.where("parent IS NULL").union(below.select(nodes.columns))
    ends = F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256")
    return rows.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends
    )
