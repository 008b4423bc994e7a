"""Trees kept as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from opswell import session
from opswell.session import shared_dir


def closure(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """All (ancestor, descendant, depth) pairs of an edge table, the shortest way counting.

    Ways double: a round finds all pairs up to twice as far apart as the rounds
    before, by going on from the pairs that are exactly as far apart as those reach.
    So d levels take log2(d) rounds, and a pair further apart is made from its own
    halves only. Rounds are cut from each other by a checkpoint in the shared folder,
    so a lost executor does not send the work back to the first round. Pairs are
    finite, so the rounds end by themselves, also where edges form a ring: its nodes
    are above themselves.
    """
    shared_dir(edges.sparkSession)
    step = edges.select(F.col(parent).alias("ancestor"), F.col(child).alias("descendant"), F.lit(1).alias("depth"))
    found, reach = step.distinct().checkpoint(), 1
    while True:
        half = found.where(F.col("depth") == reach).select("ancestor", F.col("descendant").alias("_from"))
        rest = found.select(F.col("ancestor").alias("_of"), "descendant", F.col("depth").alias("_more"))
        longer = (
            half.join(rest, F.col("_from") == F.col("_of"))
            .groupBy("ancestor", "descendant")
            .agg((F.min("_more") + reach).alias("depth"))
            .join(found, ["ancestor", "descendant"], "left_anti")
            .checkpoint()
        )
        if longer.isEmpty():
            return found
        found, reach = found.unionByName(longer), 2 * reach


def members(groups: DataFrame, direct: DataFrame, parent: str, child: str, group: str, member: str) -> DataFrame:
    """Members of every group, those of the groups inside it included, each once."""
    own = direct.select(F.col(group).alias("group"), F.col(member).alias("member"))
    inside = (
        closure(groups, parent, child)
        .join(own, F.col("descendant") == F.col("group"))
        .select(F.col("ancestor").alias("group"), "member")
    )
    return own.unionByName(inside).distinct()


def _chains(rows: DataFrame) -> DataFrame:
    """_id and _path (array, from the root) of rows _id, _parent; the path is null on a ring and below one.

    Every row holds the path to itself from the highest ancestor it knows. Each
    round puts that ancestor's own path before it, so paths double and d levels take
    log2(d) rounds. A parent that is not among the rows is a root.
    """
    rows = session.settle(
        rows.select(
            "_id",
            F.when(F.col("_parent").isNull(), F.array("_id")).otherwise(F.array("_parent", "_id")).alias("_path"),
            F.col("_parent").isNull().alias("_done"),
            F.lit(False).alias("_ring"),
        )
    )
    while not rows.where("NOT _done").isEmpty():
        up = rows.select(F.col("_id").alias("_up"), F.col("_path").alias("_above"), F.col("_done").alias("_up_done"), F.col("_ring").alias("_up_ring"))
        own = F.slice("_path", F.lit(2), F.size("_path") - 1)
        ring = F.array_contains(own, F.col("_path")[0]) | F.coalesce("_up_ring", F.lit(False))
        open_ = rows.where("NOT _done").join(up, F.col("_path")[0] == F.col("_up"), "left")
        longer = open_.select(
            "_id",
            F.when(ring | F.col("_up").isNull(), F.col("_path")).otherwise(F.concat("_above", own)).alias("_path"),
            (ring | F.coalesce("_up_done", F.lit(True))).alias("_done"),
            ring.alias("_ring"),
        )
        rows = session.settle(rows.where("_done").unionByName(longer))
    return rows.select("_id", F.when(~F.col("_ring"), F.col("_path")).alias("_path"))


def _peeled(rows: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Layers of rows that no row left is below of, the lowest first, and the rows left, if any.

    rows: _id, _parent and _leaf. A layer is a quarter of the rows at least, so what
    is moved for all layers is a few times the rows, and a long chain is no layers.
    """
    layers = []
    while True:
        n, bare = rows.agg(F.count(F.lit(1)), F.count_if("_leaf")).first()
        if 4 * bare < n:
            return layers, rows
        layers.append(rows.where("_leaf"))
        if bare == n:
            return layers, None
        inner = rows.where("NOT _leaf")
        above = inner.where("_parent IS NOT NULL").groupBy(F.col("_parent").alias("_of")).agg(F.lit(False).alias("_bare"))
        rows = session.settle(inner.drop("_leaf").join(above, F.col("_id") == F.col("_of"), "left").select(*inner.drop("_leaf").columns, F.coalesce("_bare", F.lit(True)).alias("_leaf")), "zstd")


def levels(spans: DataFrame, span: str = "span_id", parent: str = "parent_id") -> DataFrame:
    """Adds level (root = 1), path from the root, root and number of children, for trees of any depth.

    A parent that is not among the spans is a root. A span on a ring, or below one,
    has no root: its level, path and root are null. Spans without an id are left out.
    Of an id that repeats, each span stands once for each way to the root.

    Spans without children need no round: layers of them are peeled off, what is left
    finds its paths by doubling, and each layer then takes its parents' paths, so a
    span's path is moved once as a parent's.
    """
    children = spans.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("_of")).agg(F.count(F.lit(1)).alias("_children"))
    own = [F.col(c) for c in spans.columns]
    rows = session.settle(
        spans.where(F.col(span).isNotNull())
        .join(children, F.col(span) == F.col("_of"), "left")
        .select(*own, F.coalesce("_children", F.lit(0)).cast("long").alias("_children"), F.count(F.lit(1)).over(Window.partitionBy(span)).alias("_same")),
        "zstd",
    )
    rows, again = rows.drop("_same"), not rows.where("_same > 1").isEmpty()
    kept = [] if again else [*(c for c in spans.columns if c not in (span, parent)), "_parent", "_children"]
    moved = rows.withColumnRenamed(span, "_id").withColumnRenamed(parent, "_parent")
    layers, rest = _peeled(moved.select("_id", "_parent", *(c for c in kept if c != "_parent"), (F.col("_children") == 0).alias("_leaf")))
    found = []
    if rest is not None:
        chains = _chains(rest)
        placed = chains.select("_id", F.array_join("_path", "/").alias("_path"), F.col("_path")[0].alias("_root"), F.when(F.col("_path").isNotNull(), F.size("_path")).alias("_level"))
        found.append(placed if again else rest.select("_id", *kept).join(placed, "_id"))
    for i, layer in enumerate(reversed(layers)):
        top = layer.where("_parent IS NULL").select("_id", *kept, F.col("_id").alias("_path"), F.col("_id").alias("_root"), F.lit(1).alias("_level"))
        below = layer.where("_parent IS NOT NULL")
        gone = [F.concat("_parent", F.lit("/"), "_id"), F.col("_parent"), F.lit(2)]
        if found:
            up = found[0]
            for more in found[1:]:
                up = up.unionByName(more)
            up = up.select(F.col("_id").alias("_up"), F.col("_path").alias("_above"), F.col("_root").alias("_top"), F.col("_level").alias("_depth"))
            below = below.join(up, F.col("_parent") == F.col("_up"), "left")
            known = [F.concat("_above", F.lit("/"), "_id"), F.col("_top"), F.col("_depth") + 1]
            gone = [F.when(F.col("_up").isNull(), g).otherwise(k) for g, k in zip(gone, known)]
        both = top.unionByName(below.select("_id", *kept, gone[0].alias("_path"), gone[1].alias("_root"), gone[2].alias("_level")))
        found.append(both if i == len(layers) - 1 and not again else session.settle(both, "zstd"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = rows.join(out, F.col(span) == F.col("_id")) if again else out.withColumnsRenamed({"_id": span, "_parent": parent})
    return out.select(*own, F.col("_level").alias("level"), F.col("_path").alias("path"), F.col("_root").alias("root"), F.col("_children").alias("children"))
