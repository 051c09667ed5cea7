"""The trie of conversation prefixes, in node tables by minimal perfect hashing.

A prefix is known by a digest, the sum of a digest of each turn with its depth, so that prefixes of a very long
conversation are made in stretches that need only the sums before them. Conversations are cut into shards by ranges of
their ids. A shard enumerates its distinct prefixes, gives them slots, scatters its counts into arrays over the slots,
and sums subtrees through the slots of parents, deepest first. A prefix that several shards have gets its own value in one
of them alone, so that the shards' sums add up; nothing is done once for each level of the whole trie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import numbered
from .shared import keep
from .slot_table import SlotTable

#: A slot of a shard; or, where ``stretch`` is set and ``slot`` is not, a turn of a conversation of several stretches.
SLOTS = (
    "shard int, slot int, parent int, depth long, d1 long, d2 long, chars long, n long, conv long, has_child boolean, ends string,"
    " stub_conv long, stretch long"
)
SUMS = "d1 long, d2 long, depth long, conv long, parent_conv long, n long, kids long, leaves long, saved long, stub_conv long, stretch long"
DIGEST = ["d1", "d2"]


def _numbers(batches: Iterator[pa.RecordBatch], names: list[str]) -> dict[str, np.ndarray]:
    got = [{c: b.column(c).to_numpy(zero_copy_only=False) for c in names} for b in batches if b.num_rows]
    return {c: np.concatenate([g[c] for g in got]) for c in names} if got else {}


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (from 0), turn_digest, chars of every turn, in order of turn (null first), then role and text, written once."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    t = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    return numbered(t, "conv_id", ["turn", "role", "text"], ["conv_id", digest.alias("turn_digest"), F.length("text").cast("long").alias("chars")], "at")


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slots of one shard, and the turns of its conversations of several stretches. Rows come in the order of conv_id, stretch, depth."""
    names = ["conv_id", "stretch", "depth", "f1", "f2", "chars", "kind", "ends", "several"]
    v = _numbers(batches, names)
    if not v:
        return
    shard = TaskContext.get().partitionId()
    conv, depth, kind = v["conv_id"], v["depth"], v["kind"]
    start = np.flatnonzero(kind != 2)  # a root or a stub opens each stretch with the digest that the stretch begins with
    lengths = np.diff(np.append(start, len(conv)))

    def prefix(f: np.ndarray) -> np.ndarray:
        total = np.cumsum(f.view(np.uint64))
        return total - np.repeat(total[start] - f.view(np.uint64)[start], lengths)

    d1, d2 = prefix(np.ascontiguousarray(v["f1"])), prefix(np.ascontiguousarray(v["f2"]))
    table = SlotTable(d1, d2)
    slot, size = table.slots, table.size
    turn = np.flatnonzero(kind == 2)
    real = np.flatnonzero(kind != 1)
    stub = np.flatnonzero(kind == 1)
    parent = np.full(size, -1, np.int64)
    parent[slot[turn]] = slot[turn - 1]
    has_child = np.zeros(size, bool)
    has_child[slot[turn - 1]] = True
    at_depth, chars = np.zeros(size, np.int64), np.zeros(size, np.int64)
    at_depth[slot] = depth
    chars[slot[turn]] = v["chars"][turn]
    least, stub_conv, stretch = (np.full(size, np.iinfo(np.int64).min) for _ in range(3))
    least[slot[real[::-1]]] = conv[real[::-1]]  # rows come by ascending conversation, and the last value written stays
    stub_conv[slot[stub]], stretch[slot[stub]] = conv[stub], v["stretch"][stub]
    n = np.bincount(slot[real], minlength=size)
    pieces = np.full(size, None, dtype=object)
    end = np.flatnonzero(v["ends"])
    end = end[np.argsort(slot[end], kind="stable")]
    cut = np.flatnonzero(np.diff(slot[end])) + 1
    for group in np.split(end, cut) if len(end) else []:
        pieces[slot[group[0]]] = ",".join(map(str, conv[group].tolist()))
    lone = (parent < 0) & (n == 0)  # stubs alone: what is above stands in another shard
    cols = [
        pa.array(np.full(size, shard, np.int32)), pa.array(np.arange(size, dtype=np.int32)), pa.array(parent.astype(np.int32)), pa.array(at_depth), pa.array(table.d1.view(np.int64)), pa.array(table.d2.view(np.int64)),
        pa.array(chars), pa.array(n), pa.array(least, mask=n == 0), pa.array(has_child), pa.array(pieces, type=pa.string()), pa.array(stub_conv, mask=~lone), pa.array(stretch, mask=~lone),
    ]
    fields = [f.split()[0] for f in SLOTS.split(", ") for f in f.split(",") if f]
    yield pa.RecordBatch.from_arrays(cols, fields)
    long = np.flatnonzero(v["several"] & (kind != 1))
    if len(long):
        none = lambda kind: pa.nulls(len(long), kind)
        cols = [pa.array(np.full(len(long), shard, np.int32)), none(pa.int32()), none(pa.int32()), none(pa.int64()), pa.array(d1[long].view(np.int64)), pa.array(d2[long].view(np.int64))]
        cols += [none(pa.int64()), none(pa.int64()), pa.array(conv[long]), none(pa.bool_()), none(pa.string()), none(pa.int64()), pa.array(v["stretch"][long])]
        yield pa.RecordBatch.from_arrays(cols, fields)


def _accumulate(table: pa.Table) -> pa.Table:
    """Subtree sums of one shard's slots, the deepest first, each slot into that of its parent."""
    table = table.sort_by("slot")
    col = lambda c, kind=np.int64: table.column(c).to_numpy().astype(kind)
    size = table.num_rows
    parent, depth, own = col("parent"), col("depth"), table.column("own").to_numpy(zero_copy_only=False).astype(bool)
    total = table.column("total").to_numpy()
    saved = np.where(own, (total - 1) * col("chars"), 0)
    leaves = (own & ~table.column("inner").to_numpy(zero_copy_only=False).astype(bool)).astype(np.int64)
    kids = np.zeros(size, np.int64)
    below = own & (parent >= 0)
    np.add.at(kids, parent[below], 1)
    order = np.argsort(-depth, kind="stable")
    order = order[parent[order] >= 0]
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []:
        np.add.at(saved, parent[level], saved[level])
        np.add.at(leaves, parent[level], leaves[level])
    least = table.column("least").combine_chunks()
    up = pa.array(np.maximum(parent, 0), mask=(parent < 0) | ~own)
    only = pa.array(~own)
    held = lambda c: pa.compute.if_else(only, pa.scalar(None, pa.int64()), table.column(c).combine_chunks())
    cols = [table.column("d1"), table.column("d2"), held("depth"), held("least"), least.take(up), held("total"), pa.array(kids), pa.array(leaves), pa.array(saved), table.column("stub_conv"), table.column("stretch")]
    return pa.table(dict(zip([f.split()[0] for f in SUMS.split(", ")], cols)))


def _ends(pieces: DataFrame) -> DataFrame:
    """d1, d2, ends_sha256: the digest of all ids that end at a node, fed piece by piece in the order of shards.

    A digest of one string can't be made in parts, so the ids of one node pass through one task, but never stand in it at once.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for b in batches:
            out = []
            for d1, d2, ends in zip(*(b.column(c).to_pylist() for c in ("d1", "d2", "ends"))):
                if (d1, d2) != now:
                    if now is not None:
                        out.append((*now, sha.hexdigest()))
                    now, sha = (d1, d2), hashlib.sha256(ends.encode())
                else:
                    sha.update(b"," + ends.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(("d1", "d2", "ends_sha256"), r)) for r in out], kind)
        if now is not None:
            yield pa.RecordBatch.from_pylist([{"d1": now[0], "d2": now[1], "ends_sha256": sha.hexdigest()}], kind)

    kind = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("ends_sha256", pa.string())])
    return pieces.repartition(*DIGEST).sortWithinPartitions(*DIGEST, "shard").mapInArrow(digests, "d1 long, d2 long, ends_sha256 string")


def prefix_nodes(conversations: DataFrame, borrow: int = 0, among: int = 100, rows_per_shard: int = 100_000, stretch: int = 4096) -> DataFrame:
    """A row for each distinct sequence of first turns (role, text) of the conversations: the nodes of their trie.

    Returns conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens (summed over
    the subtree: members less one times the code points of the node's last text) and ends_sha256 (of the ids that end
    there, ascending and comma-joined). With ``borrow``, each conversation c first takes over the first h = crc32(c) mod borrow turns of
    conversation c - c mod ``among``, as far as that has them, in the place of its own first h.

    Turns are ordered by turn (null first), equal ones by role, then text; repeated rows are turns of their own. Null roles and texts are empty
    texts. Rows without conv_id belong to no conversation. Other columns are ignored; texts of any length count
    whole; an empty table has no nodes, a conversation that borrowing leaves without turns ends at the root.
    ``rows_per_shard`` bounds what a task holds, ``stretch`` (at least ``borrow``) the turns of a conversation that stay together.
    """
    if stretch < max(borrow, 1):
        raise ValueError("stretch must be at least borrow")
    turns = ordered_turns(conversations)
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own"))
    h = F.expr(f"crc32(cast(conv_id as string)) % {borrow}") if borrow else F.lit(0)
    convs = sizes.select("conv_id", "n_own", h.cast("int").alias("h"), F.expr(f"conv_id - conv_id % {among}").alias("donor"))
    if borrow:
        heads = turns.where(f"conv_id % {among} = 0 and at < {borrow - 1}").groupBy(F.col("conv_id").alias("donor")).agg(F.array_sort(F.collect_list(F.struct("at", "turn_digest", "chars"))).alias("head"))
        convs = convs.join(heads, "donor", "left")
        head = F.coalesce(F.expr("slice(head, 1, h)"), F.expr("array()"))
    else:
        head = F.expr("cast(array() as array<struct<at: long, turn_digest: binary, chars: long>>)")
    convs = convs.select("conv_id", "n_own", "h", head.alias("head"), (F.size(head) - F.col("h")).alias("shift"), (F.size(head) + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("last"))
    convs = keep(convs.withColumn("several", F.col("n_own") > stretch), "conversations")

    key = ["conv_id", "stretch"]
    stretches = convs.select("conv_id", "h", "shift", "last", "several", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_own - 1) div {stretch}"))).alias("stretch"))
    depth = (F.col("at") + 1 + F.col("shift")).alias("depth")
    own = turns.withColumn("stretch", F.expr(f"at div {stretch}")).join(stretches, key).where("at >= h").select(*key, depth, "turn_digest", "chars", F.lit(2).alias("kind"), "last", "several")
    first = F.expr("concat(array(struct(-1L as at, cast(null as binary) as turn_digest, 0L as chars)), head)")
    top = convs.select("conv_id", F.lit(0).cast("long").alias("stretch"), F.explode(first).alias("r"), "last", "several")
    top = top.select(*key, (F.col("r.at") + 1).alias("depth"), F.col("r.turn_digest"), F.col("r.chars"), F.when(F.col("r.at") < 0, 0).otherwise(2).alias("kind"), "last", "several")
    zero = F.lit(0).cast("long")
    f1 = F.when(F.col("kind") == 0, zero).otherwise(F.xxhash64("depth", "turn_digest"))
    f2 = F.when(F.col("kind") == 0, zero).otherwise(F.xxhash64(F.lit(1), "turn_digest", "depth"))
    rows = own.unionByName(top).select(*key, "depth", f1.alias("f1"), f2.alias("f2"), "chars", "kind", (F.col("depth") == F.col("last")).alias("ends"), "several")
    several = bool(convs.where("several").limit(1).count())
    if several:
        rows = rows.unionByName(_stubs(rows.where("several"), key))
    shards = max(1, -(-(turns.count() + convs.count()) // rows_per_shard))
    slots = keep(rows.repartitionByRange(shards, *key).sortWithinPartitions(*key, "depth").mapInArrow(_shard, SLOTS), "slots")

    w = Window.partitionBy(*DIGEST)
    nodes = slots.where("slot is not null").select(
        "*", F.sum("n").over(w).alias("total"), F.min("conv").over(w).alias("least"), F.max("has_child").over(w).alias("inner"),
        (F.min(F.when(F.col("n") > 0, F.col("shard"))).over(w) == F.col("shard")).alias("own_shard"),
    )
    nodes = nodes.withColumn("own", F.col("own_shard") & (F.col("n") > 0)).select("shard", "slot", "parent", "depth", "chars", *DIGEST, "total", "least", "inner", "own", "stub_conv", "stretch")
    sums = nodes.groupBy("shard").applyInArrow(_accumulate, SUMS)
    if several:
        sums = keep(sums, "sums")
        sums = sums.withColumns({c: F.when(F.col("stub_conv").isNull(), F.col(c)).otherwise(0) for c in ("leaves", "saved")}).unionByName(_carried(sums, slots, stretches))
    out = sums.groupBy(*DIGEST).agg(*(F.max(c).alias(c) for c in ("depth", "conv", "parent_conv", "n")), *(F.sum(c).alias(c) for c in ("kids", "leaves", "saved")))
    out = out.join(_ends(slots.where("ends is not null").select("shard", *DIGEST, "ends")), DIGEST, "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def _stubs(rows: DataFrame, key: list[str]) -> DataFrame:
    """For each later stretch of a conversation, the node that it goes on from: its depth, and its digest by sums of halves that can't overflow."""
    half = lambda c: (F.sum(F.shiftrightunsigned(c, 32)).alias(f"{c}h"), F.sum(F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"{c}l"))
    per = rows.groupBy(*key).agg(F.max("depth").alias("depth"), *half("f1"), *half("f2"))
    w = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    got = per.select(*key, *(F.sum(c).over(w).alias(c) for c in ("f1h", "f1l", "f2h", "f2l")), F.max("depth").over(w).alias("depth")).where("stretch > 0")
    whole = lambda c: F.shiftleft(F.col(f"{c}h") + F.shiftrightunsigned(f"{c}l", 32), 32).bitwiseOR(F.col(f"{c}l").bitwiseAND(F.lit(0xFFFFFFFF))).alias(c)
    return got.select(*key, "depth", whole("f1"), whole("f2"), F.lit(0).cast("long").alias("chars"), F.lit(1).alias("kind"), F.lit(False).alias("ends"), F.lit(True).alias("several"))


def _carried(sums: DataFrame, slots: DataFrame, stretches: DataFrame) -> DataFrame:
    """What later stretches of a conversation add to each node of its earlier ones."""
    found = sums.where("stub_conv is not null").groupBy(F.col("stub_conv").alias("conv_id"), "stretch").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    w = Window.partitionBy("conv_id").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    later = stretches.where("several").select("conv_id", "stretch").join(found, ["conv_id", "stretch"], "left")
    later = later.select("conv_id", "stretch", F.sum("leaves").over(w).alias("leaves"), F.sum("saved").over(w).alias("saved")).where("leaves is not null")
    path = slots.where("slot is null").select(F.col("conv").alias("conv_id"), "stretch", *DIGEST)
    none = {c: F.lit(None).cast("long") for c in ("depth", "conv", "parent_conv", "n", "stub_conv")}
    return path.join(later, ["conv_id", "stretch"]).withColumns(none | {"kids": F.lit(0).cast("long")}).select(*[f.split()[0] for f in SUMS.split(", ")])
