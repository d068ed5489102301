"""Trees given as child-to-parent edges: paths, full names, depths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.scratch import stage


def _climbed(walk: DataFrame, joined: list[Column], rounds: int) -> DataFrame:
    """``_start _at ...`` after each row took the place of the row it points to, as often as it points on.

    Every round doubles the levels of a row. ``joined``: the other columns from those of both rows.
    """
    walk = stage(walk, "tree-walk")
    for _ in range(rounds):
        more = walk.filter("_at is not null")
        if more.isEmpty():
            break
        up = walk.select(*[F.col(c).alias({"_start": "_at", "_at": "_next"}.get(c, f"{c}_above")) for c in walk.columns])
        walk = stage(walk.filter("_at is null").unionByName(more.join(up, "_at").select("_start", F.col("_next").alias("_at"), *joined)), "tree-walk")
    return walk.filter("_at is null")


def full_names(nodes: DataFrame, node: str, parent: str, name: str, separator: str = ".") -> DataFrame:
    """Adds ``full_name`` and ``depth`` by pointer doubling, at any depth.

    Nodes that reach no root are left out: those on a cycle, below one, or below a parent that is no node.
    """
    base = stage(nodes.select(F.col(node).alias("_start"), F.col(parent).alias("_at"), F.array(F.col(name)).alias("_path")), "tree-nodes")
    rounds = base.count().bit_length()
    # Paths on a cycle would double without end, so that roots are reached without names first.
    rooted = _climbed(base.select("_start", "_at"), [], rounds).select("_start").distinct()
    whole = _climbed(base.join(rooted, "_start", "left_semi"), [F.concat("_path", "_path_above").alias("_path")], rounds)
    full = F.aggregate(F.slice("_path", 2, F.size("_path")), F.col("_path")[0], lambda below, above: F.concat_ws(separator, above, below))
    out = whole.select("_start", full.alias("full_name"), (F.size("_path") - 1).cast("long").alias("depth"))
    return nodes.join(out, nodes[node] == out["_start"]).drop("_start")
