"""Prefix trie of conversations, packed into double arrays.

A conversation is a sequence of turns, told apart by a digest of role and text.  Equal sequences
are counted once.  What remains is dealt by ranges of its first turns, so a shard holds neighbouring
prefixes; a task cuts its range into blocks, and each block becomes one double array: a state ``s``
reaches the turn with dense id ``c`` at ``BASE[s] + c`` if ``CHECK`` names ``s`` there.  Walking all
sequences of the block through the arrays gives its nodes.

A node all of whose members lie in one block is finished there, with its whole subtree.  The few
upper nodes that blocks share come out in parts, under a digest of their path; the parts are added
up over all blocks and their subtrees summed by doubling the distance to the ancestor in each round.
Sequences above ``SEGMENT`` turns are cut at its multiples; each segment hangs below the last node
of the one before it, which is shared in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import CHUNK, chunked
from .common import map_batches, store

SEGMENT = 256
BLOCK_TURNS = 200_000
HOT_TURNS = 1_000_000
# The ranges of the shards look at this many turns; beyond them a hash of the sequence decides.
KEY_TURNS = 8
IDS_AT_ONCE = 4096
RECORD = 20
FREE = -1
TRIES = 32


# --------------------------------------------------------------------------- rebuilt conversations
def turns(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``case_id, ts, seq, rec``: the conversation, the order within it, and digest and length of the turn in hexadecimals.

    Rows without an id belong to no conversation.  A missing turn number comes first; turns with the
    same number follow their role and digest.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turn = F.col(turn_col).cast("long")
    return conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("case_id"),
        F.struct(turn.isNotNull().alias("known"), turn.alias("turn")).alias("ts"),
        F.struct(role.alias("role"), digest.alias("digest")).alias("seq"),
        F.concat(digest, F.lpad(F.hex(F.length(text)), 8, "0")).alias("rec"),
    )


def _positions(rows: DataFrame, sizes: DataFrame, hot_turns: int) -> DataFrame:
    """Add ``pos`` from 1 on; a hot conversation is numbered in ranges of its order."""
    data, cut = chunked(rows, hot_turns, sizes)
    order = Window.partitionBy("case_id", CHUNK).orderBy("ts", "seq")
    data = data.withColumn("pos", F.row_number().over(order).cast("long"))
    if cut:
        totals = data.groupBy("case_id", CHUNK).agg(F.count(F.lit(1)).alias("c"))
        earlier = Window.partitionBy("case_id").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        data = data.join(totals.select("case_id", CHUNK, F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("off")), ["case_id", CHUNK])
        data = data.withColumn("pos", F.col("pos") + F.col("off"))
    return data


def _gathered(start: Column, recs: Column) -> Column:
    return F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(start.alias("start"), recs.alias("recs")))), lambda x: x["recs"]))


def rebuilt(rows: DataFrame, *, group: int = 100, heads: int = 6, segment: int = SEGMENT, hot_turns: int = HOT_TURNS) -> DataFrame:
    """``conv_id, n_turns, seg, recs``: every conversation in segments, its head replaced by that of its group's first.

    Conversation ``c`` starts with the first ``crc32(c) % heads`` turns of conversation ``c - c % group``
    (none if there is no such conversation) and goes on with its own turns after as many.  A
    conversation without any turn left has one empty segment.
    """
    sizes = store(rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_events")))
    placed = _positions(rows, sizes, hot_turns)
    drawn = F.crc32(F.col("case_id").cast("string").cast("binary")) % heads
    first = placed.where((F.col("case_id") % group == 0) & (F.col("pos") < heads)).groupBy(F.col("case_id").alias("base")).agg(_gathered(F.col("pos"), F.array("rec")).alias("head"))
    convs = sizes.withColumn("h", drawn).withColumn("base", F.col("case_id") - F.col("case_id") % group).join(first, "base", "left")
    head = F.slice(F.coalesce(F.col("head"), F.array().cast("array<string>")), F.lit(1), F.col("h").cast("int"))
    convs = convs.withColumn("head", head).withColumn("n_head", F.size("head").cast("long"))
    convs = store(convs.select("case_id", "h", "head", "n_head", (F.col("n_head") + F.greatest(F.col("n_events") - F.col("h"), F.lit(0))).alias("n_turns")))
    own = placed.where(F.col("pos") > drawn).withColumn("piece", F.floor((F.col("pos") - 1) / segment))
    pieces = own.groupBy("case_id", CHUNK, "piece").agg(F.min("pos").alias("start"), _gathered(F.col("pos"), F.array("rec")).alias("recs"))
    tails = pieces.join(convs.drop("head"), "case_id").select("case_id", "n_turns", (F.col("start") + F.col("n_head") - F.col("h")).alias("start"), "recs")
    parts = convs.select("case_id", "n_turns", F.lit(1).cast("long").alias("start"), F.col("head").alias("recs")).unionByName(tails)
    at = F.floor((F.col("start") - 1) / segment)
    to = F.greatest(at, F.floor((F.col("start") + F.size("recs") - 2) / segment))
    parts = parts.withColumn("seg", F.explode(F.sequence(at, to)))
    skip = F.greatest(F.col("seg") * segment + 1 - F.col("start"), F.lit(0))
    taken = F.slice("recs", (skip + 1).cast("int"), (F.least((F.col("seg") + 1) * segment - F.col("start") + 1, F.size("recs")) - skip).cast("int"))
    parts = parts.select("case_id", "n_turns", "seg", (F.col("start") + skip).alias("start"), taken.alias("recs"))
    return parts.groupBy(F.col("case_id").alias("conv_id"), "n_turns", "seg").agg(_gathered(F.col("start"), F.col("recs")).alias("recs"))


# --------------------------------------------------------------------------- distinct sequences
def _path_hash(seed: int, segment: int) -> Column:
    """Exclusive-or of a hash of every turn with its place: hashes of the segments of a path add up in any order."""
    each = F.transform("recs", lambda r, i: F.xxhash64(F.lit(seed), r, F.col("seg") * segment + i))
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def _distinct(segments: DataFrame, segment: int) -> DataFrame:
    """The segments of one conversation of each distinct sequence, with the number of its members.

    ``in1, in2, out1, out2`` stand for the paths up to the segment's start and end; the last segment
    has ``ends``, the digest of its members' ids.
    """
    rows = store(segments.withColumn("x1", _path_hash(1, segment)).withColumn("x2", _path_hash(2, segment)))
    several = F.col("n_turns") > segment
    zero = F.lit(0).cast("long")
    light = rows.where(several).select("conv_id", "seg", "x1", "x2")
    upto = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chain = light.select("conv_id", "seg", *[F.bit_xor(f"x{k}").over(upto).alias(f"out{k}") for k in (1, 2)])
    one = rows.where(~several).withColumns({"in1": zero, "in2": zero, "out1": F.col("x1"), "out2": F.col("x2")})
    long_ = rows.where(several).join(chain, ["conv_id", "seg"]).withColumns({f"in{k}": F.col(f"out{k}").bitwiseXOR(F.col(f"x{k}")) for k in (1, 2)})
    rows = store(one.unionByName(long_).drop("x1", "x2").withColumn("is_last", (F.col("seg") + 1) * segment >= F.col("n_turns")))
    # A segment that the turns fill exactly is the last one, and so is an empty first one.
    ends = rows.where("is_last").select("out1", "out2", "n_turns", "conv_id")
    classes = store(member_digests(ends))
    return rows.join(classes.drop("out1", "out2", "n_turns"), "conv_id").withColumn("ends", F.when(F.col("is_last"), F.col("ends")))


CLASS = "out1 long, out2 long, n_turns long, conv_id long"


def member_digests(ends: DataFrame) -> DataFrame:
    """``out1, out2, n_turns, conv_id, members, ends`` per distinct sequence: smallest member, count, digest of the sorted ids.

    Ids are sorted by ranges, so a class of any size spreads over many tasks; each writes its ids
    into short texts, and only these texts run through the digest of the class, in order.
    """
    key = ["out1", "out2", "n_turns"]
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ids = ends.select(*key, "conv_id").repartitionByRange(parts, *key, "conv_id").sortWithinPartitions(*key, "conv_id")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [b.column(c).to_numpy() for c in key]
            ids = b.column("conv_id").to_numpy()
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            bounds = sorted({0, len(ids), *change.tolist(), *range(0, len(ids), IDS_AT_ONCE)})
            rows = [(int(keys[0][i]), int(keys[1][i]), int(keys[2][i]), int(ids[i]), j - i, ",".join(map(str, ids[i:j].tolist()))) for i, j in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_pylist([dict(zip([*key, "conv_id", "members", "ids"], r, strict=True)) for r in rows], SCHEMA_WRITTEN)

    texts = map_batches(sorted_ids, written, CLASS + ", members long, ids string")
    texts = texts.repartition(*key).sortWithinPartitions(*key, "conv_id")

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        for b in batches:
            done = []
            for *k, conv, members, ids in zip(*(b.column(c).to_pylist() for c in [*key, "conv_id", "members", "ids"]), strict=True):
                if now is not None and now[0] == k:
                    now[2] += members
                    now[3].update(b"," + ids.encode())
                else:
                    if now is not None:
                        done.append(now)
                    now = [k, conv, members, hashlib.sha256(ids.encode())]
            yield classes(done)
        if now is not None:
            yield classes([now])

    def classes(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(key, k, strict=True)) | {"conv_id": c, "members": m, "ends": h.hexdigest()} for k, c, m, h in done], SCHEMA_CLASS)

    return map_batches(texts, digested, CLASS + ", members long, ends string")


SCHEMA_WRITTEN = pa.schema([(c, pa.int64()) for c in ("out1", "out2", "n_turns", "conv_id", "members")] + [("ids", pa.string())])
SCHEMA_CLASS = pa.schema([(c, pa.int64()) for c in ("out1", "out2", "n_turns", "conv_id", "members")] + [("ends", pa.string())])


# --------------------------------------------------------------------------- double arrays
class DoubleArray:
    """``BASE`` and ``CHECK`` over dense ids: state ``s`` goes by ``c`` to ``t = BASE[s] + c`` if ``CHECK[t] == s``.

    State 0 is the root.  Children of a branching state are placed together at the first place that
    fits; single children then fill what is free.
    """

    def __init__(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.base = np.zeros(1, np.int64)
        self.check = np.full(1, -2, np.int64)
        self.top = 1
        many = int(codes.max()) + 1 if len(codes) else 1
        state = np.zeros(len(starts), np.int64)
        for depth in range(int(lengths.max()) if len(lengths) else 0):
            active = np.flatnonzero(lengths > depth)
            reached, back = np.unique(state[active] * many + codes[starts[active] + depth], return_inverse=True)
            state[active] = self._place(reached // many, reached % many)[back]
        self.base, self.check = self.base[: self.top], self.check[: self.top]

    def _place(self, parents: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Slots for the children of one level, given by parent and code in ascending order."""
        first = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]])
        count = np.diff(np.r_[first, len(parents)])
        slots = np.empty(len(parents), np.int64)
        for i, n in zip(first[count > 1].tolist(), count[count > 1].tolist(), strict=True):
            wanted = codes[i : i + n] - codes[i]
            free = np.flatnonzero(self.check[1 : self.top] == FREE)[:TRIES] + 1
            spot = next((int(f) for f in free if self._fits(f + wanted)), self.top)
            self._take(parents[i : i + n], spot + wanted)
            slots[i : i + n] = spot + wanted
        alone = first[count == 1]
        free = np.flatnonzero(self.check[1 : self.top] == FREE)[: len(alone)] + 1
        slots[alone] = np.r_[free, self.top + np.arange(len(alone) - len(free))]
        self._take(parents[alone], slots[alone])
        self.base[parents] = slots - codes
        return slots

    def _fits(self, slots: np.ndarray) -> bool:
        inside = slots[slots < self.top]
        return bool((self.check[inside] == FREE).all())

    def _take(self, parents: np.ndarray, slots: np.ndarray) -> None:
        need = int(slots.max()) + 1 if len(slots) else 0
        if need > len(self.check):
            more = max(need, 2 * len(self.check)) - len(self.check)
            self.check = np.r_[self.check, np.full(more, FREE, np.int64)]
            self.base = np.r_[self.base, np.zeros(more, np.int64)]
        self.top = max(self.top, need)
        self.check[slots] = parents

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The states reached, -1 where there is no such child."""
        to = self.base[states] + codes
        inside = (to > 0) & (to < len(self.check))
        return np.where(inside & (self.check[np.where(inside, to, 0)] == states), to, -1)


def _dense(digests: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Dense ids of the digests, numbered as they first appear level by level: siblings mostly stand together."""
    _, first, ids = np.unique(digests.view("V16").ravel(), return_index=True, return_inverse=True)
    appears = np.full(len(first), len(digests), np.int64)
    np.minimum.at(appears, ids, np.argsort(np.argsort(level, kind="stable"), kind="stable"))
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(appears)] = np.arange(len(first))
    return rank[ids]


NODES = (
    "conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, parent_conv_id long, "
    "path binary, parent_path binary, length long, shared boolean"
)
NODE_SCHEMA = pa.schema(
    [(c, pa.int64()) for c in ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends", pa.string()), ("parent_conv_id", pa.int64()), ("path", pa.binary()), ("parent_path", pa.binary()), ("length", pa.int64()), ("shared", pa.bool_())]
)


def _path(a: int, b: int) -> bytes:
    return int(a).to_bytes(8, "little", signed=True) + int(b).to_bytes(8, "little", signed=True)


def block_nodes(rows: list[dict], segment: int) -> pa.RecordBatch:
    """All nodes of the sorted sequences of a block: finished ones, and the parts of shared ones."""
    blobs = [r["turns"] for r in rows]
    lengths = np.array([len(x) // RECORD for x in blobs], np.int64)
    records = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, RECORD)
    entries = [_path(r["in1"], r["in2"]) for r in rows]
    number = {e: i for i, e in enumerate(dict.fromkeys(entries))}
    starts = np.cumsum(lengths) - lengths
    depth_of = np.arange(len(records)) - np.repeat(starts, lengths)
    digests = np.ascontiguousarray(records[:, :16])
    codes = _dense(digests, depth_of) + len(number) if len(records) else np.empty(0, np.int64)
    # A path starts with the place where its segment hangs; the first step below the root tells these apart.
    whole = np.insert(codes, starts, [number[e] for e in entries])
    starts = starts + np.arange(len(rows))
    tree = DoubleArray(whole, starts, lengths + 1)

    convs = np.array([r["conv_id"] for r in rows], np.int64)
    members = np.array([r["members"] for r in rows], np.int64)
    goes_on = np.array([not r["is_last"] for r in rows])
    from_root = np.array([r["seg"] == 0 for r in rows])
    size = len(tree.check)
    n, conv = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max)
    depth, length, sample = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    shared, own, end = np.zeros(size, bool), np.zeros(size, np.int64), np.full(size, -1, np.int64)
    common = np.maximum(_common(rows, rows[0]), _common(rows, rows[-1]))
    text_length = np.ascontiguousarray(records[:, 16:]).view(">u4").ravel().astype(np.int64)

    levels = []
    state = np.zeros(len(rows), np.int64)
    for d in range(int(lengths.max()) + 1):
        active = np.flatnonzero(lengths >= d)
        state[active] = at = tree.step(state[active], whole[starts[active] + d])
        levels.append(np.unique(at))
        depth[at], sample[at] = d, active
        if d:
            length[at] = text_length[starts[active] - active + d - 1]
        counted = np.where(from_root[active] | (d > 0), members[active], 0)
        np.add.at(n, at, counted)
        np.minimum.at(conv, at[counted > 0], convs[active][counted > 0])
        reaches = common[active]
        np.logical_or.at(shared, at, (d <= reaches) | ((d > KEY_TURNS) & (reaches >= KEY_TURNS)) | goes_on[active] | (d == 0))
        closing = active[(lengths[active] == d) & ~goes_on[active]]
        end[state[closing]] = closing
    children, leaves, saved = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    own = np.where(depth > 0, (n - 1) * length, 0)
    for at in reversed(levels):
        done = at[~shared[at]]
        leaves[done] += children[done] == 0
        saved[done] += own[done]
        up = tree.check[done]
        np.add.at(children, up, 1)
        np.add.at(leaves, up, leaves[done])
        np.add.at(saved, up, saved[done])

    nodes = np.concatenate(levels)
    paths = {int(s): _node_path(rows[sample[s]], digests, int(starts[sample[s]] - sample[s]), int(depth[s]), segment) for s in nodes[shared[nodes]]}
    above = np.array([rows[i]["seg"] * segment for i in sample[nodes]], np.int64)
    ups = tree.check[nodes].tolist()
    parent_open = [paths.get(u) for u in ups]
    none = np.iinfo(np.int64).max
    arrays = [
        pa.array([None if c == none else c for c in conv[nodes].tolist()], pa.int64()),
        *(pa.array(x, pa.int64()) for x in (depth[nodes] + above, n[nodes], children[nodes], leaves[nodes], saved[nodes])),
        pa.array([rows[i]["ends"] if i >= 0 else None for i in end[nodes].tolist()], pa.string()),
        pa.array([None if d == 0 or p is not None else int(conv[u]) for d, p, u in zip(depth[nodes].tolist(), parent_open, ups, strict=True)], pa.int64()),
        pa.array([paths.get(s) for s in nodes.tolist()], pa.binary()),
        pa.array(parent_open, pa.binary()),
        pa.array(length[nodes], pa.int64()),
        pa.array(shared[nodes]),
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=NODE_SCHEMA)


def _common(rows: list[dict], other: dict) -> np.ndarray:
    """Leading turns (at most ``KEY_TURNS``) that each row shares with another; -1 below another place."""
    width = 16
    key, out = other["key"], []
    for r in rows:
        if (r["in1"], r["in2"]) != (other["in1"], other["in2"]):
            out.append(-1)
            continue
        mine, k = r["key"], 0
        while k < min(len(mine), len(key)) and mine[k : k + width] == key[k : k + width]:
            k += width
        out.append(k // width)
    return np.array(out, np.int64)


def _node_path(row: dict, digests: np.ndarray, start: int, depth: int, segment: int) -> bytes:
    """The name of a node that blocks share; the last node of a segment has the name of the place below it."""
    if depth == 0:
        return _path(row["in1"], row["in2"])
    if depth == segment:
        return _path(row["out1"], row["out2"])
    return hashlib.md5(_path(row["in1"], row["in2"]) + digests[start : start + depth].tobytes()).digest()


def nodes(distinct: DataFrame, *, segment: int = SEGMENT, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Nodes and parts of nodes (``NODES``) of distinct sequences, by one double array per block of a shard."""
    key = F.array_join(F.transform(F.slice("recs", 1, KEY_TURNS), lambda r: F.substring(r, 1, 16)), "")
    blob = F.unhex(F.array_join("recs", ""))
    rows = distinct.select("in1", "in2", "out1", "out2", "seg", "conv_id", "members", "is_last", "ends", key.alias("key"), blob.alias("turns"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "in1", "in2", "key", F.xxhash64("turns")).sortWithinPartitions("in1", "in2", "key", "turns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[dict] = []
        held = 0
        for b in batches:
            for row in b.to_pylist():
                block.append(row)
                held += len(row["turns"]) // RECORD + 1
                if held >= block_turns:
                    yield block_nodes(block, segment)
                    block, held = [], 0
        if block:
            yield block_nodes(block, segment)

    return map_batches(ranged, run, NODES)


# --------------------------------------------------------------------------- shared nodes
def _merged(parts: DataFrame) -> DataFrame:
    """Shared nodes with the sums of their parts and of their whole subtrees."""
    sums = parts.groupBy("path").agg(
        F.min("conv_id").alias("conv_id"),
        F.max("depth").alias("depth"),
        F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_tokens"),
        F.max("ends").alias("ends"),
        F.max("parent_path").alias("parent_path"),
        F.max("length").alias("length"),
    )
    sums = store(sums)
    below = sums.where("parent_path is not null").groupBy(F.col("parent_path").alias("path")).agg(F.count(F.lit(1)).alias("more"))
    sums = sums.join(below, "path", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    own = F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * F.col("length")).otherwise(0)
    sums = store(sums.withColumn("n_leaves", F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).withColumn("saved_tokens", F.col("saved_tokens") + own))
    # After k rounds a node has the sums of all nodes less than 2 ** k below it, and ``up`` is 2 ** k above.
    state = sums.select("path", F.col("parent_path").alias("up"), F.col("n_leaves").alias("l"), F.col("saved_tokens").alias("s"))
    deepest = sums.agg(F.max("depth")).first()[0] or 0
    reach = 1
    while reach <= deepest:
        added = state.where("up is not null").groupBy(F.col("up").alias("path")).agg(F.sum("l").alias("dl"), F.sum("s").alias("ds"))
        higher = state.where("up is not null").select(F.col("path").alias("at"), F.col("up").alias("next"))
        state = state.join(added, "path", "left").join(higher, F.col("up") == F.col("at"), "left")
        zero = F.lit(0)
        state = store(state.select("path", F.col("next").alias("up"), (F.col("l") + F.coalesce("dl", zero)).alias("l"), (F.col("s") + F.coalesce("ds", zero)).alias("s")))
        reach *= 2
    return sums.drop("n_leaves", "saved_tokens").join(state.select("path", F.col("l").alias("n_leaves"), F.col("s").alias("saved_tokens")), "path")


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(
    conversations: DataFrame, *, group: int = 100, heads: int = 6, segment: int = SEGMENT, block_turns: int = BLOCK_TURNS, hot_turns: int = HOT_TURNS, **columns: str
) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations (``rebuilt``); the columns are ``RESULT``.

    A missing role or text counts as empty, so such turns are equal to empty ones; repeated rows are
    turns of their own; rows without an id are left out.  A table without conversations has no node.
    """
    rows = store(turns(conversations, **columns))
    distinct = _distinct(rebuilt(rows, group=group, heads=heads, segment=segment, hot_turns=hot_turns), segment)
    found = store(nodes(distinct, segment=segment, block_turns=block_turns))
    shared = store(_merged(found.where("shared").drop("shared", "parent_conv_id")))
    parents = shared.select(F.col("path").alias("parent_path"), F.col("conv_id").alias("parent"))
    inner = found.where(~F.col("shared"))
    finished = inner.where("parent_path is null").drop("path", "parent_path", "shared")
    fringe = inner.where("parent_path is not null").join(parents, "parent_path").withColumn("parent_conv_id", F.col("parent"))
    upper = shared.join(parents, "parent_path", "left").withColumn("parent_conv_id", F.col("parent"))
    names = [c for c in RESULT if c != "ends_sha256"] + ["ends"]
    every = finished.select(names).unionByName(fringe.select(names)).unionByName(upper.select(names))
    nobody = hashlib.sha256(b"").hexdigest()
    return every.withColumn("ends_sha256", F.coalesce("ends", F.lit(nobody))).select(RESULT)
