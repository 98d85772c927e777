"""Prefix trie of conversations over padded turn-id matrices.

1. A turn's id is the first 16 bytes of the SHA-256 of its role and text, so
   texts are hashed where they are read and never shuffled. A conversation is
   its turns' ids and text lengths in the order of turns; ``rebuilt`` puts the
   first turns of each block's head conversation in front.
2. Range shards: conversations are dealt out by their ids' bytes, then conv_id.
   Conversations with a common prefix are next to each other, so a node is a run
   of conversations, mostly inside one shard; a sequence that very many
   conversations share is split by conv_id.
3. In a shard, ids become ranks and conversations rows of matrices padded with
   -1, a few columns at a time so that one long conversation doesn't widen the
   others' rows: ``numpy.lexsort`` within the runs that the columns before left
   together. Columns that differ from the row above, OR-accumulated from the
   left, mark the rows at which nodes start; a row's first mark is all that is
   kept of them (``first_change``).
4. At each depth ``reduceat`` over the node starts gives every node its members,
   smallest conv_id, children, leaves and sums (``shard_nodes``).
   Sums over a subtree need no tree: of the texts below a node each member has a
   suffix, and each distinct text belongs to the first row that has it, which
   owns all of its turns from its first mark on. A leaf is the last row of its
   sequence, unless the next row goes on from it.
5. Nodes on the path of a shard's first or last row may go on in the next shard
   (``boundary``). They carry a digest of their prefix. The longest common prefix
   of the last row before a shard and its first row, found from one row a shard,
   tells which child, leaf and owned texts both sides counted; then the parts
   are summed by digest. Children of such nodes look their parent up there.

Memory in a task: the ids, ranks and lengths of a shard, about ``shard_turns``
turns of under 100 bytes. A conversation is one row: it has to fit a task, as a
text does. The conversations that end at a boundary node are hashed in a
stream, as SHA-256 goes through them in order anyway.

Defined results: null role and text count as empty; rows without conv_id take
no part. Turns are ordered by turn, nulls first, then by their ids; repeated
rows are turns of their own. No conversations: no nodes, no root either. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release_shuffles, small, written

_ID = 16  # bytes of a turn's id
_BAND = 8  # columns of a matrix
_ENDS = 1024  # conv_ids in one row of those that end at a boundary node
_ROWS = 8192  # nodes in a batch
EMPTY = hashlib.sha256(b"").hexdigest()


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id, turns (array of id, chars in the order of turns): one row a conversation of ``rows`` (conv_id, turn, role, text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    turns = rows.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.unhex(F.substring(digest, 1, 2 * _ID)).alias("id"), F.length(text).alias("chars")).alias("t"))
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return own.select("conv_id", F.transform("ts", lambda t: F.struct(t["id"].alias("id"), t["chars"].alias("chars"))).alias("turns"))


def rebuilt(convs: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """``convs`` with the first h turns of its block's head, the conversation ``conv_id - conv_id % block``, in place of its own first h.

    h is the CRC-32 of the decimal conv_id, modulo ``most``; an absent head has
    no turns. Only the first turns of the heads are joined, and a head meets
    ``block`` rows.
    """
    head = F.col("conv_id") - F.col("conv_id") % block
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    heads = convs.where(F.col("conv_id") == head).select(F.col("conv_id").alias("head"), F.slice("turns", 1, most).alias("first"))
    j = convs.select("conv_id", "turns", head.alias("head"), h.alias("h")).join(heads, "head", "left")
    given = F.coalesce(F.slice("first", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return j.select("conv_id", F.concat(given, rest).alias("turns"))


def first_change(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the order of the rows by their ids, ties as they are; for each place in it the depth of the row's first node that the row above hasn't).

    ``ids``: the ranks of all rows' turns, one after the other; row r has
    ``size[r]`` of them from ``start[r]`` on. The depth is one more than the
    number of turns shared with the row above; the first row's is 1.
    """
    n = len(size)
    order, change = np.arange(n), np.zeros(n, np.int64)
    change[:1] = 1
    group, active = np.zeros(n, np.int64), np.arange(n)  # alike in all columns so far; places where that isn't all there is
    for begin in range(0, int(size.max(initial=0)), _BAND):
        rows, depth = order[active], begin + np.arange(_BAND)
        real = depth < size[rows][:, None]
        matrix = np.where(real, ids[np.where(real, start[rows][:, None] + depth, 0)], -1)
        sort = np.lexsort((*matrix.T[::-1], group[active]))
        matrix, order[active] = matrix[sort], rows[sort]
        mask = np.logical_or.accumulate(matrix[1:] != matrix[:-1], axis=1)
        new = (group[active][1:] == group[active][:-1]) & mask[:, -1]
        change[active[1:][new]] = begin + mask[new].argmax(axis=1) + 1
        group = np.cumsum(change > 0) - 1
        first = np.flatnonzero(change)
        longest, alike = np.maximum.reduceat(size[order], first), np.diff(np.append(first, n))
        active = np.flatnonzero(((longest > begin + _BAND) & (alike > 1))[group])
        if not len(active):
            break
    same = change == 0
    change[same] = size[order[same]] + 1
    return order, change


def _ranks(blob: np.ndarray) -> np.ndarray:
    """16-byte ids to ranks in the order of their bytes."""
    hi, lo = blob.view(">u8").reshape(-1, 2).T.astype(np.uint64)
    by = np.lexsort((lo, hi))
    out = np.zeros(len(by), np.int64)
    out[by[1:]] = np.cumsum((hi[by][1:] != hi[by][:-1]) | (lo[by][1:] != lo[by][:-1]))
    return out


def _path(seq: bytes) -> list[bytes]:
    """The digests of a sequence's prefixes, from none of its turns to all."""
    h = hashlib.sha256()
    out = [h.digest()[:_ID]]
    for i in range(0, len(seq), _ID):
        h.update(seq[i:i + _ID])
        out.append(h.digest()[:_ID])
    return out


_NODE = {
    "kind": pa.string(), "shard": pa.int32(), "depth": pa.int64(), "conv_id": pa.int64(), "parent_conv_id": pa.int64(), "parent_key": pa.binary(),
    "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "all_chars": pa.int64(), "own_chars": pa.int64(), "ends_sha256": pa.string(),
    # of boundary nodes: their prefix, whether the shard's first and last rows are below them, the chars of the first row's turns above them
    "key": pa.binary(), "on_first": pa.bool_(), "on_last": pa.bool_(), "chars_above": pa.int64(),
    "part": pa.int32(), "ends": pa.list_(pa.int64()),
    "first_seq": pa.binary(), "first_chars": pa.list_(pa.int32()), "last_seq": pa.binary()}
_NODE_SQL = ("kind string, shard int, depth long, conv_id long, parent_conv_id long, parent_key binary, n_convs long, n_children long, n_leaves long, "
             "all_chars long, own_chars long, ends_sha256 string, key binary, on_first boolean, on_last boolean, chars_above long, "
             "part int, ends array<long>, first_seq binary, first_chars array<int>, last_seq binary")


def _batch(columns: dict[str, list]) -> pa.RecordBatch:
    n = len(columns["kind"])
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in _NODE.items()], schema=pa.schema(list(_NODE.items())))


def shard_nodes(shard: int, conv: np.ndarray, seqs: list[bytes], chars: list[list[int]]) -> Iterator[pa.RecordBatch]:
    """The nodes of a shard's conversations (at least one) as rows of ``_NODE``, by kind: node, boundary, ends (of boundary nodes), edge (one row)."""
    given = np.argsort(conv, kind="stable")
    conv, seqs = conv[given], [seqs[i] for i in given]
    size = np.array([len(s) // _ID for s in seqs], np.int64)
    flat = np.concatenate([np.asarray(chars[i], np.int64) for i in given])
    start = np.cumsum(size) - size
    order, change = first_change(_ranks(np.frombuffer(b"".join(seqs), np.uint8)), start, size)
    conv, size, start, seqs, chars = conv[order], size[order], start[order], [seqs[i] for i in order], [chars[given[i]] for i in order]
    total = np.concatenate([[0], np.cumsum(flat)])
    end, n = total[start + size], len(conv)
    leaf = np.append(change[1:] <= size[:-1], True)  # the last row of a sequence, and the next row doesn't go on from it
    first_path, last_path = _path(seqs[0]), _path(seqs[-1])
    yield _batch({"kind": ["edge"], "shard": [shard], "first_seq": [seqs[0]], "first_chars": [chars[0]], "last_seq": [seqs[-1]]})
    out: dict[str, list] = {c: [] for c in [*_NODE][:16]}
    above, conv_above, key_above = np.zeros(n, np.int64), np.zeros(1, np.int64), np.array([None], object)
    live = np.arange(n)
    for d in range(int(size.max()) + 1):
        live = live[size[live] >= d]
        starts = np.flatnonzero(change[live] <= d) if d else np.zeros(1, np.int64)
        first, members = live[starts], np.diff(np.append(starts, len(live)))
        suffix = end[live] - total[start[live] + max(d - 1, 0)]
        own = end[live] - total[start[live] + np.maximum(d, change[live]) - 1]
        child = (size[live] > d) & (change[live] <= d + 1)
        n_ends = np.add.reduceat((size[live] == d).astype(np.int64), starts)
        smallest = np.minimum.reduceat(conv[live], starts)
        on_first, on_last = first == 0, live[starts + members - 1] == n - 1
        key = np.array([first_path[d] if a else last_path[d] if b else None for a, b in zip(on_first.tolist(), on_last.tolist())], object)
        parent = above[first]
        out["kind"] += ["node" if k is None else "boundary" for k in key]
        out["shard"] += [shard] * len(first)
        out["depth"] += [d] * len(first)
        out["conv_id"] += smallest.tolist()
        out["parent_conv_id"] += conv_above[parent].tolist() if d else [None]
        out["parent_key"] += key_above[parent].tolist()
        out["n_convs"] += members.tolist()
        for c, v in (("n_children", child), ("n_leaves", leaf[live]), ("all_chars", suffix), ("own_chars", own)):
            out[c] += np.add.reduceat(v.astype(np.int64), starts).tolist()
        # those that end here are the node's first rows, by conv_id
        out["ends_sha256"] += [EMPTY if not m else None if k is not None else hashlib.sha256(",".join(map(str, conv[f:f + m].tolist())).encode()).hexdigest()
                               for f, m, k in zip(first.tolist(), n_ends.tolist(), key)]
        out["key"] += key.tolist()
        out["on_first"] += on_first.tolist()
        out["on_last"] += on_last.tolist()
        out["chars_above"] += [int(total[start[0] + max(d - 1, 0)] - total[start[0]]) if a else None for a in on_first.tolist()]
        for i in np.flatnonzero((on_first | on_last) & (n_ends > 0)).tolist():
            ids = conv[first[i]:first[i] + n_ends[i]]
            parts = [ids[j:j + _ENDS].tolist() for j in range(0, len(ids), _ENDS)]
            yield _batch({"kind": ["ends"] * len(parts), "shard": [shard] * len(parts), "depth": [d] * len(parts), "key": [key[i]] * len(parts),
                          "part": list(range(len(parts))), "ends": parts})
        above[live] = np.repeat(np.arange(len(first)), members)
        conv_above, key_above = smallest, key
        if len(out["kind"]) >= _ROWS:
            yield _batch(out)
            out = {c: [] for c in out}
    if out["kind"]:
        yield _batch(out)


def _shared(edges: DataFrame) -> DataFrame:
    """shard, shared (turns common to its first row and the last row before it), shared_chars, goes_on (the next shard's first row goes on from its last).

    One row a shard goes through the windows.
    """
    w = Window.orderBy("shard")
    pairs = edges.select("shard", F.lag("last_seq").over(w).alias("before"), "first_seq", "first_chars", (F.octet_length("last_seq") / _ID).cast("int").alias("last_turns"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            turns, sums = [], []
            for x, y, c in zip(b.column("before").to_pylist(), b.column("first_seq").to_pylist(), b.column("first_chars").to_pylist(), strict=True):
                k = min(len(x or b""), len(y))
                same = np.frombuffer(x or b"", np.uint8, k) == np.frombuffer(y, np.uint8, k)
                k = (k if same.all() else int(same.argmin())) // _ID
                turns.append(k)
                sums.append(sum(c[:k]))
            yield pa.RecordBatch.from_arrays([b.column("shard"), pa.array(turns, pa.int32()), pa.array(sums, pa.int64()), b.column("last_turns")],
                                             names=["shard", "shared", "shared_chars", "last_turns"])

    got = pairs.mapInArrow(compare, "shard int, shared int, shared_chars long, last_turns int")
    return got.select("shard", "shared", "shared_chars", F.coalesce(F.lead("shared").over(w) == F.col("last_turns"), F.lit(False)).alias("goes_on"))


def _ends(parts: DataFrame) -> DataFrame:
    """depth, key, ends_sha256 of the boundary nodes at which conversations end, hashed as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, lead = None, None, b""
        for b in batches:
            done: list[tuple] = []
            for depth, key, ids in zip(b.column("depth").to_pylist(), b.column("key").to_pylist(), b.column("ends").to_pylist(), strict=True):
                if (depth, key) != now:
                    if now:
                        done.append((*now, digest.hexdigest()))
                    now, digest, lead = (depth, key), hashlib.sha256(), b""
                digest.update(lead + ",".join(map(str, ids)).encode())
                lead = b","
            yield _rows(done)
        if now:
            yield _rows([(*now, digest.hexdigest())])

    def _rows(done):
        cols = list(zip(*done)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.string()))], names=["depth", "key", "ends_sha256"])

    return (parts.select("depth", "key", "shard", "part", "ends").repartition("depth", "key")
            .sortWithinPartitions("depth", "key", "shard", "part").mapInArrow(run, "depth long, key binary, ends_sha256 string"))


def trie_nodes(convs: DataFrame, shard_turns: int = 1 << 18) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row a node of ``convs`` (conv_id, turns)."""
    spark = convs.sparkSession
    seqs = written(convs.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), "")).alias("seq"),
                                F.transform("turns", lambda t: t["chars"]).alias("chars")), "sequences")
    total = seqs.agg(F.sum(F.size("chars") + 1)).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / shard_turns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held) if (held := [b for b in batches if b.num_rows]) else None
        if t is not None:
            yield from shard_nodes(TaskContext.get().partitionId(), t.column("conv_id").to_numpy(), t.column("seq").to_pylist(), t.column("chars").to_pylist())

    out = written(seqs.repartitionByRange(shards, "seq", "conv_id").mapInArrow(run, _NODE_SQL), "nodes")
    release_shuffles(spark)
    edges = written(_shared(out.where("kind = 'edge'").select("shard", "first_seq", "first_chars", "last_seq")), "edges")
    b = out.where("kind = 'boundary'").join(small(edges), "shard")
    shared = F.col("on_first") & (F.col("depth") <= F.col("shared"))
    parts = b.select(
        "depth", "key", "parent_key", "conv_id", "n_convs",
        (F.col("n_children") - F.when(F.col("on_first") & (F.col("depth") < F.col("shared")), 1).otherwise(0)).alias("n_children"),
        (F.col("n_leaves") - F.when(F.col("on_last") & F.col("goes_on"), 1).otherwise(0)).alias("n_leaves"),
        (F.col("all_chars") - F.col("own_chars") + F.when(shared, F.col("shared_chars") - F.col("chars_above")).otherwise(0)).alias("saved"))
    whole = parts.groupBy("depth", "key").agg(
        F.first("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")])
    ends = _ends(out.where("kind = 'ends'"))
    combined = written(whole.join(ends, ["depth", "key"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))), "combined")
    parents = small(combined.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")))
    nodes = out.where("kind = 'node'").withColumn("saved", F.col("all_chars") - F.col("own_chars"))
    columns = ["conv_id", "depth", F.col("parent_conv_id").cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256"]
    inner = nodes.where(F.col("parent_key").isNull())
    below = nodes.where(F.col("parent_key").isNotNull()).drop("parent_conv_id").join(parents, "parent_key")
    root = combined.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    rest = combined.where("depth > 0").join(parents, "parent_key")
    return inner.select(*columns).unionByName(below.select(*columns)).unionByName(root.select(*columns)).unionByName(rest.select(*columns))
