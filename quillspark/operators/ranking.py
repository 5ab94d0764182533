"""Order of trees by list ranking: every node's depth and its place in depth-first order, as numbers, at any depth and width.

A forest is walked as one linked list (Euler tour): each node has a way down to it and a way up from it, and each way knows the
next. Sums of weights along the list from a way to the end give depths and places. Lists are ranked by contraction: in each round, ways
whose coin says so are taken out behind neighbours whose coin says not, about a quarter of all, until few are left; these are
ranked by pointer doubling, and what was taken out gets its sums back, round by round. Work is in proportion to the list,
and no row grows with the depth.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.state import materialise, scoped

COL = F.col
#: Lists of so many rows are ranked by doubling.
SMALL = 1 << 16


@scoped
def list_sums(links: DataFrame, weights: Sequence[str], small: int = SMALL) -> DataFrame:
    """(id, weights): the sums of the weights from each id to the end of its list. links: id, to (null at an end), weights; no cycles."""
    names = list(weights)
    behind = {f"b_{c}": COL(c) for c in names}
    left = materialise(links.select("id", "to", *names), "list")
    taken: list[DataFrame] = []
    while left.count() > small:
        coin = lambda c, turn=len(taken): F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(2)) == 1
        keeps = F.coalesce(~coin(COL("to")), F.lit(True)) | COL("to").isNull()
        joins = left.filter(~coin("id") & ~keeps).select(COL("id").alias("by"), COL("to").alias("b_to"), *(c.alias(n) for n, c in behind.items()))
        rows = materialise(left.filter(coin("id")).join(joins, COL("id") == COL("b_to"), "left").select("id", "to", *names, "by", *behind), "round")
        out, stay = rows.filter("by is not null"), rows.filter("by is null").select("id", "to", *names)
        merged = out.select(COL("by").alias("id"), "to", *((COL(c) + COL(f"b_{c}")).alias(c) for c in names))
        taken.append(out.select("id", "to", *names))
        left = materialise(left.filter(~coin("id") & keeps).unionByName(stay).unionByName(merged), "list")
    while left.filter("to is not null").count():
        ahead = left.select(COL("id").alias("to"), COL("to").alias("b_to"), *(c.alias(n) for n, c in behind.items()))
        rows = left.join(ahead, "to", "left")
        left = materialise(rows.select("id", COL("b_to").alias("to"), *((COL(c) + F.coalesce(f"b_{c}", F.lit(0))).alias(c) for c in names)), "list")
    sums = left.select("id", *names)
    for out in reversed(taken):
        ahead = sums.select(COL("id").alias("to"), *(c.alias(n) for n, c in behind.items()))
        back = out.join(ahead, "to", "left").select("id", *((COL(c) + F.coalesce(f"b_{c}", F.lit(0))).alias(c) for c in names))
        sums = materialise(sums.unionByName(back), "sums")
    return sums


def with_next(rows: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """rows with the value of the row behind in the order of all rows: led within ranges, and over their borders by the ranges' first rows."""
    ranged = materialise(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranged")
    firsts = ranged.groupBy("__part").agg(F.min_by(value, F.struct(*order)).alias("__first"))
    firsts = firsts.select((F.lag("__part").over(Window.orderBy("__part"))).alias("__part"), "__first")  # a row a range
    within = F.lead(value).over(Window.partitionBy("__part").orderBy(*order))
    joined = ranged.withColumn(name, within).join(F.broadcast(firsts), "__part", "left")
    last = F.row_number().over(Window.partitionBy("__part").orderBy(*(F.desc(c) for c in order))) == 1
    return joined.withColumn(name, F.when(last, COL("__first")).otherwise(COL(name))).drop("__part", "__first")


@scoped
def forest_order(nodes: DataFrame, node: str, parent: str, order: str | None = None, small: int = SMALL) -> DataFrame:
    """(node, depth, place): places count all nodes from 0 in depth-first order, siblings and roots by order, then by node.

    nodes: each node once, its parent null at a root; parents are nodes, and there are no cycles (see relational.forest()).
    """
    by = COL(order) if order else COL(node)
    rows = nodes.select(COL(node).alias("node"), COL(parent).alias("up"), by.alias("by"))
    # roots come first: where null parents end, the next parent's children begin
    keys = ["__root", "up", "by", "node"]
    rows = rows.withColumn("__root", COL("up").isNotNull())
    led = with_next(rows.withColumn("__it", F.struct("up", "node")), keys, "__it", "__next")
    sibling = F.when(COL("__next.up").eqNullSafe(COL("up")), COL("__next.node"))
    first = rows.filter("up is not null").groupBy("up").agg(F.min_by("node", F.struct("by", "node")).alias("child")).withColumnRenamed("up", "of")
    rows = led.select("node", "up", sibling.alias("sibling")).join(first, COL("node") == COL("of"), "left")
    way = lambda c, up: F.struct(c.alias("node"), F.lit(up).alias("up"))
    down_to = F.when(COL("child").isNotNull(), way(COL("child"), False)).otherwise(way(COL("node"), True))
    up_to = F.when(COL("sibling").isNotNull(), way(COL("sibling"), False)).when(COL("up").isNotNull(), way(COL("up"), True))
    weight = lambda step, place: (F.lit(step).cast("long").alias("step"), F.lit(place).cast("long").alias("place"))
    down = rows.select(way(COL("node"), False).alias("id"), down_to.alias("to"), *weight(1, 1))
    links = down.unionByName(rows.select(way(COL("node"), True).alias("id"), up_to.alias("to"), *weight(-1, 0)))
    sums = list_sums(links, ["step", "place"], small)
    total = nodes.count()
    return sums.filter(~COL("id.up")).select(COL("id.node").alias(node), (-COL("step")).alias("depth"), (F.lit(total) - COL("place")).alias("place"))
