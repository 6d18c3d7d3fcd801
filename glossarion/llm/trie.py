"""A trie of conversations' turns, built as burst tries.

Conversations lie in containers, sets of suffixes below a head, the sequence of turns that they begin with.
A container of more than LIMIT turns bursts: its head becomes a node of the trie's upper part, and its
suffixes go on in containers by their next turn. What a head holds is summed over rows, a turn of a
conversation each, so that neither long nor frequent conversations meet in one task. The containers that
are left are bounded; each is sorted and swept into nodes by one task.

A sequence of turns is known by 128 bits: the exclusive or of hashes of each turn and its depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .text import shared_dir

#: Turns of a container that doesn't burst.
LIMIT = 1 << 12
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def _stored(df: DataFrame) -> DataFrame:
    folder = shared_dir(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def running(rows: DataFrame, order: Sequence[Column | str], xors: Sequence[str] = (), sums: Sequence[str] = ()) -> DataFrame:
    """rows (c, ...) with `at`, the place among those of a c by `order`, and x_<name>, running values up to each row.

    Rows are put in order in ranges, so that tasks share a c of many rows: each sums its range, and what the
    ranges before hold of the same c is added afterwards.
    """
    names = [*xors, *sums]
    add = [np.bitwise_xor] * len(xors) + [np.add] * len(sums)
    schema = StructType([*rows.schema.fields, *StructType.fromDDL(", ".join(["part int", "at bigint", *(f"x_{n} bigint" for n in names)])).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            c = batch.column("c").to_numpy()
            starts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            sizes = np.diff(np.r_[starts, len(c)])
            out = []
            for f, x in zip([np.add, *add], [np.ones(len(c), np.int64), *(batch.column(n).to_numpy() for n in names)], strict=True):
                total = f.accumulate(x)
                before = np.r_[0, total[starts[1:] - 1]]
                out.append(total ^ np.repeat(before, sizes) if f is np.bitwise_xor else total - np.repeat(before, sizes))
            if c[0] == last:
                for f, x, y in zip([np.add, *add], out, held, strict=True):
                    x[: sizes[0]] = f(x[: sizes[0]], y)
            last, held = c[-1], [x[-1] for x in out]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(c), part, np.int32)), *map(pa.array, out)], names=schema.names)

    cut = _stored(rows.repartitionByRange("c", *order).sortWithinPartitions("c", *order).mapInArrow(run, schema))
    of = {"at": ("sum", F.count("*")), **{f"x_{n}": ("bit_xor", F.bit_xor(n)) for n in xors}, **{f"x_{n}": ("sum", F.sum(n)) for n in sums}}
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("c", "part").agg(*[f.alias(n) for n, (_, f) in of.items()])
    carried = totals.select("c", "part", *[getattr(F, how)(n).over(before).alias(f"_{n}") for n, (how, _) in of.items()]).filter("_at > 0")
    cut = cut.join(_stored(carried), ["c", "part"], "left")  # a row for each c that goes over a range's edge
    both = {n: F.coalesce(F.col(f"_{n}"), F.lit(0)) for n in of}
    return cut.select(*rows.columns, *[(F.col(n).bitwiseXOR(both[n]) if how == "bit_xor" else F.col(n) + both[n]).alias(n) for n, (how, _) in of.items()])


def numbered(conversations: DataFrame) -> DataFrame:
    """(c, at, a, b, size) of each turn of each conversation: its place by turn (null first), role and text, its hashes and its text's length."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("c"), F.col("turn").alias("t"), role.alias("role"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(7), text, role).alias("b"), F.length(text).cast("bigint").alias("size"))
    return running(rows, ["t", "role", "a", "b"]).select("c", "at", "a", "b", "size")


def branched(turns: DataFrame, block: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with those of others: (c, d, a, b, size, len), and (c, len), of turns (c, at, a, b, size).

    The first h turns of c are those of conversation c - c % block, h being crc32 of c's decimals modulo
    most + 1; its own turns after its first h follow. len: the number of all.
    """
    h = F.crc32(F.col("c").cast("string")) % (most + 1)
    convs = turns.groupBy("c").agg(F.count("*").alias("own")).withColumns({"h": h, "base": F.col("c") - F.col("c") % block})
    bases = convs.filter("c = base").select("base", F.col("own").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = convs.join(bases, "base", "left").select("c", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len"))
    convs = _stored(convs)
    first = turns.filter(f"at <= {most} and c % {block} = 0").select(F.col("c").alias("base"), F.col("at").alias("d"), "a", "b", "size")
    lent = convs.join(first, "base").filter("d <= h").select("c", "d", "a", "b", "size", "len")
    own = turns.join(convs, "c").filter("at > h").select("c", (F.col("at") - F.col("h") + F.col("taken")).alias("d"), "a", "b", "size", "len")
    return lent.unionByName(own), convs.select("c", "len")


def _sha(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


def sweep(paths: list[list], convs: list[int], sizes: list[list[int]], depth: int) -> list[list]:
    """Nodes of one container, its head first: [conv_id, depth, parent's index, n_convs, n_children, n_leaves, saved, sha].

    paths: a key for each turn of each suffix, the head's first. Sorted suffixes are met one by one; what a
    suffix shares with the one before is on the stack.
    """
    nodes, ends, stack, path = [], [], [], []
    for i in sorted(range(len(paths)), key=lambda i: paths[i]):
        own, c = paths[i], convs[i]
        same = 0
        while same < min(len(path), len(own)) and path[same] == own[same]:
            same += 1
        del stack[same:]
        for j in range(same, len(own)):
            nodes.append([c, depth + j, stack[-1] if stack else -1, 0, 0, 0, sizes[i][j]])
            ends.append([])
            stack.append(len(nodes) - 1)
        for at in stack:
            nodes[at][3] += 1
            nodes[at][0] = min(nodes[at][0], c)
        ends[stack[-1]].append(c)
        path = own
    for node, ids in zip(reversed(nodes), reversed(ends), strict=True):  # children come after their parents
        node[5] = node[5] or 1
        node[6] *= node[3] - 1
        node[6] += node[7] if len(node) > 7 else 0
        if node[2] >= 0:
            parent = nodes[node[2]]
            parent[4] += 1
            parent[5] += node[5]
            if len(parent) == 7:
                parent.append(0)
            parent[7] += node[6]
        node[7:] = [_sha(ids)]
    return nodes


def _sweeps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (hp, hr, c, d, p, r, q, s, size) sorted by container, conversation and depth, to nodes; (q, s) is left for heads only."""
    names = ["q", "s", *(x.split()[0] for x in NODE.split(", "))]
    kinds = [pa.int64()] * 9 + [pa.string()]

    def nodes_of(rows: list[np.ndarray]) -> Iterator[list]:
        hp, hr, c, d, p, r, q, s, size = rows
        new = np.r_[True, (hp[1:] != hp[:-1]) | (hr[1:] != hr[:-1])]
        heads = np.flatnonzero(new).tolist()
        convs = np.flatnonzero(new | np.r_[True, c[1:] != c[:-1]])
        keys, size, ends = list(zip(p.tolist(), r.tolist(), strict=True)), size.tolist(), np.r_[convs[1:], len(c)]
        which = np.searchsorted(convs, [*heads, len(c)])
        for at, a, b in zip(heads, which[:-1].tolist(), which[1:].tolist(), strict=True):
            spans = list(zip(convs[a:b].tolist(), ends[a:b].tolist(), strict=True))
            found = sweep([keys[x:y] for x, y in spans], c[convs[a:b]].tolist(), [size[x:y] for x, y in spans], int(d[at]))
            for i, (conv, depth, up, *rest) in enumerate(found):
                yield [int(q[at]), int(s[at]), conv, depth, None, *rest] if not i else [None, None, conv, depth, found[up][0], *rest]

    held = None
    for batch in batches:
        rows = [x.to_numpy() for x in batch.columns]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        if not len(rows[0]):
            continue
        same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        held = [x[cut:] for x in rows]
        if cut:
            out = list(nodes_of([x[:cut] for x in rows]))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
    if held is not None:
        out = list(nodes_of(held))
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _end_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (p, r, c) in order to (p, r, ends_sha256); one hash's state is held, however many conversations end there."""
    node = state = None
    for batch in batches:
        done = []
        for p, r, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if (p, r) != node:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = (p, r), hashlib.sha256(str(c).encode())
            else:
                state.update(f",{c}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["p", "r", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*node, state.hexdigest()), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["p", "r", "ends_sha256"])


def nodes(turns: DataFrame, convs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """A row (NODE) for each node of the trie of rebuilt conversations: turns (c, d, a, b, size, len), d from 1, convs (c, len).

    conv_id is the least member; the root has depth 0 and no parent. Conversations without turns are members
    of the root only. No conversations give no nodes. The conversations that end in one node are hashed in
    order by one task, which holds no more than the hash: SHA-256 can't be shared.
    """
    rows = turns.withColumns({"u": F.xxhash64("a", "d"), "v": F.xxhash64("b", "d")}).select("c", "d", "u", "v", "size", (F.col("len") - F.col("d") + 1).alias("left"))
    rows = running(rows, ["d"], xors=["u", "v"])
    path = {"p": F.col("x_u"), "r": F.col("x_v"), "q": F.col("x_u").bitwiseXOR(F.col("u")), "s": F.col("x_v").bitwiseXOR(F.col("v"))}
    rows = _stored(rows.select("c", "d", "size", "left", *[x.alias(n) for n, x in path.items()]))
    # the sequences below which more than `limit` turns lie
    crowded = _stored(rows.groupBy("p", "r").agg(F.sum("left").alias("n")).filter(F.col("n") > limit).select("p", "r", F.lit(True).alias("burst")))
    above = crowded.select(F.col("p").alias("q"), F.col("r").alias("s"), F.lit(True).alias("below"))
    rows = rows.join(crowded, ["p", "r"], "left").join(above, ["q", "s"], "left")
    upper = rows.filter("burst").select("c", "d", "size", "left", "p", "r", "q", "s")
    none = F.lit(None).cast("bigint")
    root = convs.select("c", F.lit(0).cast("bigint").alias("d"), F.lit(0).cast("bigint").alias("size"), (F.col("len") + 1).alias("left"), F.lit(0).cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("r"), none.alias("q"), none.alias("s"))
    upper = _stored(upper.unionByName(root))
    lower = _stored(rows.filter("burst is null").withColumn("head", F.expr("below or d = 1")).select("c", "d", "size", "p", "r", "q", "s", "head"))
    heads = lower.filter("head").select("c", F.col("p").alias("hp"), F.col("r").alias("hr"))
    kept = lower.join(heads, "c").select("hp", "hr", "c", "d", "p", "r", "q", "s", "size")
    swept = _stored(kept.repartition("hp", "hr").sortWithinPartitions("hp", "hr", "c", "d").mapInArrow(_sweeps, f"q bigint, s bigint, {NODE}"))
    tops = swept.filter("q is not null")

    # the upper part: counts of rows, and sums that each conversation brings to all nodes above
    counted = upper.groupBy("p", "r").agg(F.min("c").alias("conv_id"), F.max("d").alias("depth"), F.count("*").alias("n_convs"), F.max("size").alias("size"), F.max("q").alias("q"), F.max("s").alias("s"))
    counted = _stored(counted)
    children = counted.filter("q is not null").select("q", "s").unionByName(tops.select("q", "s")).groupBy(F.col("q").alias("p"), F.col("s").alias("r")).agg(F.count("*").alias("n_children"))
    counted = _stored(counted.join(children, ["p", "r"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    own = counted.select(F.col("conv_id").alias("c"), F.col("depth").alias("d"), (F.col("n_children") == 0).cast("bigint").alias("leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    brought = own.unionByName(tops.select(F.col("conv_id").alias("c"), (F.col("depth") - 1).alias("d"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
    brought = _stored(brought.groupBy("c", "d").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
    ways = upper.select("c", "d", "p", "r").join(brought.select("c").distinct(), "c", "left_semi").join(brought, ["c", "d"], "left")
    ways = ways.select("c", "d", "p", "r", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("leaves", "saved")])
    sums = running(ways, [F.desc("d")], sums=["leaves", "saved"]).groupBy("p", "r").agg(F.sum("x_leaves").alias("n_leaves"), F.sum("x_saved").alias("saved_tokens"))
    ends = upper.filter("left = 1").select("p", "r", "c").repartition("p", "r").sortWithinPartitions("p", "r", "c").mapInArrow(_end_hashes, "p bigint, r bigint, ends_sha256 string")
    parents = counted.select(F.col("p").alias("q"), F.col("r").alias("s"), F.col("conv_id").alias("parent_conv_id"))
    top = counted.join(sums, ["p", "r"]).join(ends, ["p", "r"], "left").join(parents, ["q", "s"], "left")
    names = [x.split()[0] for x in NODE.split(", ")]
    top = top.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_sha([])))).select(names)
    joined = tops.drop("parent_conv_id").join(parents, ["q", "s"]).select(names)
    return top.unionByName(joined).unionByName(swept.filter("q is null").select(names))


def prefix_trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """nodes() of conversations (conv_id, turn, role, text), each of which begins with turns of another (branched).

    A null role or text is an empty one. Turns of one number are in the order of their roles, then of hashes
    of their texts; repeated rows are turns of their own. Rows whose conv_id is null are left out. Other
    columns don't matter. An empty table gives no nodes.
    """
    return nodes(*branched(_stored(numbered(conversations))), limit)
