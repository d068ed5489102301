"""Graphs and trees as tables of edges: components, directed reachability, depth-first order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.ranking import ordered_rank
from docloom.operators.revisions import bounds
from docloom.scratch import discard, stage

#: Where a tour ends.
END = -1
#: Steps of a tour that a task sums at once.
AT_ONCE = 1 << 18


def connected(edges: DataFrame) -> DataFrame:
    """``node component`` of undirected ``edges(a, b)``: the smallest node that each is linked to, itself included.

    A round takes the smallest label around and then follows labels once, so a path of n nodes takes about
    log n rounds. Labels are a table throughout.
    """
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "graph-edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "graph-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        low = stage(labels.join(near, "node").select("node", F.least("component", "m").alias("component"), F.col("component").alias("was")), "graph-step")
        up = low.select(F.col("node").alias("component"), F.col("component").alias("root"))
        now = stage(low.join(up, "component").select("node", F.col("root").alias("component"), "was"), "graph-labels")
        done = now.filter("component <> was").isEmpty()
        discard(low, labels)
        labels = now.select("node", "component")
        labels._staged_at = now._staged_at
        if done:
            return labels


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``node hops`` of what directed ``edges(a, b)`` reach from ``seeds(node)``, with the fewest steps to it.

    Semi-naive: a round follows the edges of what the last one found and leaves out, by an anti join, what is
    known. Cycles, repeated edges and seeds without edges do no harm; nulls reach nothing and are not reached.
    """
    steps = stage(edges.filter("a is not null and b is not null").select("a", "b").distinct(), "reach-edges")
    new = stage(seeds.filter("node is not null").select("node").distinct().withColumn("hops", F.lit(0).cast("long")), "reach-new")
    parts, hops = [new], 0
    while not new.isEmpty():
        hops += 1
        known = parts[0].select("node")
        for p in parts[1:]:
            known = known.unionByName(p.select("node"))
        found = steps.join(new.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct()
        new = stage(found.join(known, "node", "left_anti").withColumn("hops", F.lit(hops).cast("long")), "reach-new")
        parts.append(new)
        if len(parts) > 16:  # few files to read for each later round
            whole = parts[0]
            for p in parts[1:]:
                whole = whole.unionByName(p)
            parts = [stage(whole, "reach-known")]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def renumbered(reached: DataFrame, edges: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes with ``new_number`` from 1 in ``order``, and the edges between them in these numbers."""
    nodes = stage(ordered_rank(reached, [], order, "new_number"), "renumbered")
    number = lambda c: nodes.select(F.col("node").alias(c), F.col("new_number").alias(f"new_{c}"))
    return nodes, edges.select("a", "b").distinct().join(number("a"), "a").join(number("b"), "b").select("new_a", "new_b")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``at downs rise`` from each of a bounded number of steps to the end; those that never come there are left out."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    at, to, downs, rise = (table.column(c).to_numpy() for c in ("at", "to", "downs", "rise"))
    n, order = len(at), np.argsort(at)
    where = np.minimum(np.searchsorted(at, to, sorter=order), n - 1)
    # Two places behind the steps: the end, and nowhere.
    link = np.append(np.where(to == END, n, np.where(at[order[where]] == to, order[where], n + 1)), [n, n + 1])
    sums = [np.append(x, [0, 0]) for x in (downs, rise)]
    for _ in range(n.bit_length() + 1):
        sums = [x + x[link] for x in sums]
        link = link[link]
    ends = np.flatnonzero(link[:n] == n)
    for lo in range(0, len(ends), 1 << 16):
        some = ends[lo : lo + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at[some], sums[0][some], sums[1][some])], ["at", "downs", "rise"])


def _sums_to_end(steps: DataFrame, at_once: int) -> DataFrame:
    """``at downs rise`` of ``steps(at, to, downs, rise)`` summed from each to END; at most one step leads to another.

    A round takes out the steps whose hash is below that of both neighbours, about a third of them, so that all rounds
    together read some three times the steps. ``at_once`` steps or fewer are summed in a task. Then each
    round's steps are put back, the last round's first. Steps that go round and round are left out.
    """
    rounds, salt = [], 0
    while steps.count() > at_once:
        salt += 1
        hashed = lambda c: F.when(F.col(c) == END, F.lit((1 << 63) - 1)).otherwise(F.xxhash64(c, F.lit(salt)))  # noqa: B023, E731
        here, there = hashed("at"), hashed("to")
        low = steps.filter(here < there).select(*[F.col(c).alias(f"v_{c}") for c in ("at", "to", "downs", "rise")])
        met = steps.filter(here >= there).join(low, F.col("to") == F.col("v_at"), "full_outer")
        gone = F.col("at").isNotNull() & F.col("v_at").isNotNull()
        now = stage(
            met.select(
                F.coalesce("at", "v_at").alias("at"), F.coalesce("v_to", "to").alias("to"),
                *[(F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"v_{c}"), F.lit(0))).alias(c) for c in ("downs", "rise")],
                *[F.when(gone, F.col(f"v_{c}")).alias(f"v_{c}") for c in ("at", "to", "downs", "rise")],
            ), "tree-round",
        )
        rounds.append(now)
        steps = now.filter("at <> to").select("at", "to", "downs", "rise")
    summed = stage(steps.repartition(1).mapInArrow(_summed, "at long, downs long, rise long"), "tree-sums")
    known = summed.unionByName(steps.sparkSession.range(1).select(F.lit(END).alias("at"), F.lit(0).cast("long").alias("downs"), F.lit(0).cast("long").alias("rise")))
    for r in reversed(rounds):
        ahead = known.select(F.col("at").alias("v_to"), F.col("downs").alias("downs2"), F.col("rise").alias("rise2"))
        back = r.filter("v_at is not null").select("v_at", "v_to", "v_downs", "v_rise").join(ahead, "v_to")
        known = known.unionByName(stage(back.select(F.col("v_at").alias("at"), (F.col("v_downs") + F.col("downs2")).alias("downs"), (F.col("v_rise") + F.col("rise2")).alias("rise")), "tree-sums"))
    discard(*rounds)
    return known.filter(F.col("at") != END)


def tree_order(nodes: DataFrame, node: str, parent: str, order: list[str], at_once: int = AT_ONCE) -> DataFrame:
    """Depth-first numbers of a forest: ``node place depth size last`` (``place`` from 1, roots and siblings in ``order``).

    ``size`` counts the nodes of a subtree with its root, ``last`` is the place of the last of them, so that a subtree is a
    range of places. An Euler tour has two steps a node, down to it and up from it, and each points to the next; places and
    depths are sums from a step to the end of the tour, which shrinks by a third a round (``_sums_to_end``).
    ``order`` has to be total among siblings. A null parent makes a root; nodes on a cycle, below one or below a parent that
    is no node are left out; of rows that repeat a node any one counts.
    """
    kids = nodes.select(F.col(node).alias("node"), F.col(parent).alias("parent"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]).filter("node is not null").dropDuplicates(["node"])
    named = stage(kids.withColumn("id", F.monotonically_increasing_id()), "tree-nodes")
    above = named.select(F.col("node").alias("parent"), F.col("id").alias("above"))
    # Nodes below a parent that is no node are roots behind the true ones, so that the tour is one; their places are cut off.
    placed = named.join(above, "parent", "left").withColumn("lost", F.col("parent").isNotNull() & F.col("above").isNull()).drop("node", "parent")
    by = [f"_o{i}" for i in range(len(order))]
    # Siblings by ranges, as one parent may hold any share of the nodes.
    ranked = stage(bounds(placed, ["above"], ["lost", *by, "id"], "id", "before").select("id", "above", "lost", "before"), "tree-siblings")
    next_of = ranked.filter("before is not null").select(F.col("before").alias("id"), F.col("id").alias("next"))
    eldest = ranked.filter("before is null and above is not null").select(F.col("above").alias("id"), F.col("id").alias("eldest"))
    links = ranked.join(next_of, "id", "left").join(eldest, "id", "left")
    # The step down to a node is twice its number, the step up from it one more.
    number = lambda x: F.lit(x).cast("long")
    down = F.struct((F.col("id") * 2).alias("at"), F.coalesce(F.col("eldest") * 2, F.col("id") * 2 + 1).alias("to"), number(1).alias("downs"), number(1).alias("rise"))
    upward = F.struct((F.col("id") * 2 + 1).alias("at"), F.coalesce(F.col("next") * 2, F.col("above") * 2 + 1, number(END)).alias("to"), number(0).alias("downs"), number(-1).alias("rise"))
    tour = stage(links.select(F.explode(F.array(down, upward)).alias("s")).select("s.*"), "tree-tour")
    whole = _sums_to_end(tour, at_once)
    up = F.col("at") % 2 == 1
    sums = whole.groupBy(F.shiftright("at", 1).alias("id")).agg(F.max(F.when(~up, F.col("downs"))).alias("d"), F.max(F.when(up, F.col("downs"))).alias("u"), F.max(F.when(~up, F.col("rise"))).alias("r"))
    # Sums run from a step to the end: nodes before it are the others, and what rises after it has to fall.
    total = whole.agg(F.max("downs")).first()[0] or 0
    astray = ranked.filter("lost").select("id")
    most = None if astray.isEmpty() else sums.join(astray, "id").agg(F.max("d")).first()[0]
    if most is not None:
        sums = sums.filter(F.col("d") > most)
    place = F.lit(total) - F.col("d") + 1
    out = sums.join(named.select("id", "node"), "id")
    return out.select("node", place.cast("long").alias("place"), (-F.col("r")).alias("depth"), (F.col("d") - F.col("u")).alias("size"), (place + F.col("d") - F.col("u") - 1).cast("long").alias("last"))
