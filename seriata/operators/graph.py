"""Graphs as edge tables: components, spanning trees, consensus, bounded paths."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; one is made only where all runs in one process and none is set."""
    there, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext._jsc.sc()
    if not there and context.getCheckpointDir().isDefined():
        there = context.getCheckpointDir().get()
    if not there and not context.isLocal():
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return there or tempfile.mkdtemp(prefix="seriata-")


def durable(df: DataFrame) -> DataFrame:
    """Rows in the session's checkpoint folder, with their lineage cut."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable over undirected edges (src, dst).

    Each round takes the smallest label of the neighbours, then the label of
    that label, so paths halve; it ends when no label changes.
    """
    both = durable(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct())
    labels = durable(nodes.select("node").distinct().withColumn("component", F.col("node")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("component"))
        root = step.select(F.col("node").alias("component"), F.col("component").alias("root"))
        new = durable(step.join(root, "component").select("node", "was", F.least("component", "root").alias("component")))
        labels = new.select("node", "component")
        if new.where("was <> component").isEmpty():
            return labels


#: Edges that one task may take to finish a forest; beyond them rounds over the cluster do.
ONE_TASK = 1 << 20


def _forests() -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """What takes a partition's edges (src, dst, w) to their minimum spanning forest, ties by the nodes.

    Besides the forest it holds only as many edges at a time, or 200,000.
    """

    def forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def thin(some: list[pd.DataFrame]) -> pd.DataFrame:
            e = pd.concat(some, ignore_index=True)
            names, at = np.unique(np.concatenate([e.src.to_numpy(), e.dst.to_numpy()]), return_inverse=True)
            a, b = at[: len(e)], at[len(e) :]
            root, keep = list(range(len(names))), []
            order = np.lexsort((b, a, e.w.to_numpy()))
            for k, i, j in zip(order.tolist(), a[order].tolist(), b[order].tolist(), strict=True):
                while root[i] != i:
                    root[i] = i = root[root[i]]
                while root[j] != j:
                    root[j] = j = root[root[j]]
                if i != j:
                    root[j] = i
                    keep.append(k)
            return e.iloc[keep]

        held, rows, forest = [], 0, 0
        for batch in batches:
            held, rows = [*held, batch], rows + len(batch)
            if rows - forest > max(200_000, forest):
                held = [thin(held)]
                rows = forest = len(held[0])
        if rows:
            yield thin(held)

    return forests


def spanning_tree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (src, dst, w) of the minimum spanning forest.

    An edge that is not in the forest of some of the edges is in no forest of
    all, so partitions keep their forests, fewer and fewer of them, and one task
    finishes if few edges are left. Else every component takes its lightest
    outgoing edge, round by round.

    As ties go by the nodes, components point at each other in trees whose roots
    are pairs that point at one another; doubling finds the roots, and edges
    inside a component go. nodes without an edge are in no tree.
    """
    low, high = F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    some = edges.select(low, high, "w").groupBy("src", "dst").agg(F.min("w").alias("w")).where("src <> dst")
    parts = 64
    some = durable(some.repartition(parts, "src", "dst").mapInPandas(_forests(), some.schema))
    while (n := some.count()) > ONE_TASK and parts > 1:
        parts //= 8
        some = durable(some.repartition(parts, "src", "dst").mapInPandas(_forests(), some.schema))
    if n <= ONE_TASK:
        return durable(some.repartition(1).mapInPandas(_forests(), some.schema))
    left = durable(some.withColumn("a", F.col("src")).withColumn("b", F.col("dst")))
    chosen = left.select("src", "dst", "w").limit(0)
    while True:
        ends = F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("to")), F.struct(F.col("b").alias("c"), F.col("a").alias("to"))))
        best = left.select(ends.alias("e"), "w", "src", "dst").groupBy("e.c").agg(F.min(F.struct("w", "src", "dst", "e.to")).alias("e"))
        light = durable(best.select("c", "e.to", "e.w", "e.src", "e.dst"))
        if light.isEmpty():
            return chosen
        chosen = chosen.unionByName(light.select("src", "dst", "w").distinct())
        there = light.select(F.col("c").alias("to"), F.col("to").alias("back"))
        up = durable(light.select("c", "to").join(there, "to").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("to")))
        while True:
            on = up.select(F.col("c").alias("to"), F.col("to").alias("next"))
            new = durable(up.join(on, "to").select("c", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
            up = new.drop("moved")
            if new.where("moved").isEmpty():
                break
        at = lambda side: up.select(F.col("c").alias(side), F.col("to").alias(f"{side}_root"))
        left = durable(left.join(at("a"), "a").join(at("b"), "b").where("a_root <> b_root").select("src", "dst", "w", F.col("a_root").alias("a"), F.col("b_root").alias("b")))


def spanning_rounds(nodes: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """src, dst, w, round of disjoint spanning forests, each over what the earlier ones left."""
    left, out = edges, None
    for k in range(rounds):
        tree = spanning_tree(nodes, left)
        told = tree.withColumn("round", F.lit(k))
        out = told if out is None else out.unionByName(told)
        left = left.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w").join(tree.select("src", "dst"), ["src", "dst"], "left_anti")
    return out


def consensus(sequences: DataFrame, keys: list[str], order: str, node: str) -> DataFrame:
    """a, b, share: in how many sequences two nodes follow each other, over the largest such number."""
    after = F.lead(node).over(Window.partitionBy(*keys).orderBy(order))
    pairs = sequences.select(F.col(node).alias("x"), after.alias("y")).where("y is not null and x <> y")
    n = pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.max("n").alias("top")))).select("a", "b", (F.col("n") / F.col("top")).alias("share"))  # one row


#: Nodes of a block of the adjacency matrix (a power of two), and into how many groups the left blocks that meet at one are dealt.
NODES, DEALT = 1 << 10, 8


def _packed(cells: np.ndarray) -> bytes:
    """Cells (row * NODES + column) of a block as numbers or, where that is shorter, as bits."""
    if 32 * len(cells) < NODES * NODES:
        return b"n" + cells.astype(np.uint32).tobytes()
    bits = np.zeros(NODES * NODES, bool)
    bits[cells] = True
    return b"b" + np.packbits(bits).tobytes()


def _cells(packed: bytes) -> np.ndarray:
    """The cells of a packed block, ascending."""
    if packed[:1] == b"n":
        return np.sort(np.frombuffer(packed, np.uint32, offset=1)).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8, offset=1)))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cells that an edge of block a and one of block b lead to: by pairs of edges if these are few, else as matrices."""
    row, middle = a // NODES, a % NODES
    starts = np.searchsorted(b, np.arange(NODES + 1) * NODES)
    counts = np.diff(starts)[middle]
    ends = np.cumsum(counts)
    if not len(ends) or ends[-1] <= NODES * NODES:
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[middle] - (ends - counts), counts)
        return np.unique(np.repeat(row, counts) * NODES + b[at] % NODES)
    x, y = (np.zeros(NODES * NODES, np.float32) for _ in "ab")
    x[a], y[b] = 1, 1
    return np.flatnonzero(x.reshape(NODES, NODES) @ y.reshape(NODES, NODES))


def _step(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Products of the blocks that meet at one block of nodes; a side without any has no columns either."""
    if left.empty or right.empty:
        return pd.DataFrame([], columns=["i", "j", "cells"])
    blocks = [(j, _cells(p)) for j, p in zip(right["to"], right["block"], strict=True)]
    out = [(i, j, _packed(found)) for i, p in zip(left["i"], left["cells"], strict=True) for a in [_cells(p)] for j, b in blocks if len(found := _product(a, b))]
    return pd.DataFrame(out, columns=["i", "j", "cells"])


def _unseen(block: pd.DataFrame) -> pd.DataFrame:
    """Of one block's rows, the cells of those that are new and of none that is known; a node is no neighbour of itself."""
    i, j = block["i"].iloc[0], block["j"].iloc[0]
    seen, known = np.zeros(NODES * NODES, bool), np.zeros(NODES * NODES, bool)
    known[:: NODES + 1] = i == j
    for new, packed in zip(block["new"], block["cells"], strict=True):
        (seen if new else known)[_cells(packed)] = True
    left = np.flatnonzero(seen & ~known)
    return pd.DataFrame([(i, j, _packed(left))] if len(left) else [], columns=["i", "j", "cells"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (i, j, cells, hops) as rows, a block at a time."""
    for batch in batches:
        for i, j, packed, hops in zip(*(batch.column(k) for k in range(4)), strict=True):
            cells = _cells(packed.as_py())
            columns = [i.as_py() * NODES + cells // NODES, j.as_py() * NODES + cells % NODES, np.full(len(cells), hops.as_py(), np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["src", "dst", "hops"])


def hops(edges: DataFrame, most: int) -> DataFrame:
    """src, dst, hops: shortest unweighted paths of at most most edges, breadth first.

    The adjacency matrix is cut into blocks of NODES by NODES, and a step is a
    product of blocks, so neither the paths nor the pairs are rows before the
    result: a block takes 128 KB at most, however many edges and paths it holds.
    """
    shift, local = NODES.bit_length() - 1, lambda c: F.col(c).bitwiseAND(F.lit(NODES - 1))
    both = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    both = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst")
    cells = both.select(F.shiftright("src", shift).alias("i"), F.shiftright("dst", shift).alias("j"), (local("src") * NODES + local("dst")).cast("int").alias("cell"))
    pack = lambda block: pd.DataFrame([(block["i"].iloc[0], block["j"].iloc[0], _packed(np.unique(block["cell"].to_numpy())))], columns=["i", "j", "cells"])
    schema = "i long, j long, cells binary"
    adjacent = durable(cells.distinct().groupBy("i", "j").applyInPandas(pack, schema))
    dealt = adjacent.withColumn("k", F.col("i")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1)))).select("k", "part", F.col("j").alias("to"), F.col("cells").alias("block"))  # names of their own: both sides of a cogroup may come from one table
    front, known = adjacent, adjacent.withColumn("hops", F.lit(1))
    for n in range(2, most + 1):
        left = front.select(F.col("j").alias("k"), F.pmod("i", F.lit(DEALT)).cast("int").alias("part"), "i", "cells")
        reached = left.groupBy("k", "part").cogroup(dealt.groupBy("k", "part")).applyInPandas(_step, schema)
        rows = reached.withColumn("new", F.lit(True)).unionByName(known.drop("hops").withColumn("new", F.lit(False)))
        front = durable(rows.groupBy("i", "j").applyInPandas(_unseen, schema))
        known = known.unionByName(front.withColumn("hops", F.lit(n)))
    return known.select("i", "j", "cells", "hops").mapInArrow(_pairs, "src long, dst long, hops int")
