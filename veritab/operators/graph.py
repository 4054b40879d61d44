"""Walks over the lineage graph, one Spark job per level.

Every level is written to the scratch folder and read back, so plans stay
small, a lost executor costs one level, and Catalyst sees the real size of the
frontier: it broadcasts a small one and shuffles a large one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.operators.adjacent import one_row
from veritab.session import materialize, materialize_counted, materialize_observed, scratch_path

UP, DOWN, CENTER = "up", "down", "center"


@dataclass
class Walk:
    """nodes: <id, side, level, layer>; layer is negative upstream. Edges keep all columns."""

    nodes: DataFrame
    upstream_edges: DataFrame
    downstream_edges: DataFrame


def _start(edges: DataFrame, center) -> DataFrame:
    spark = edges.sparkSession
    kind = edges.schema["upstream_id"].dataType
    row = spark.range(1).select(
        F.lit(center).cast(kind).alias("id"), F.lit(CENTER).alias("side"), F.lit(0).alias("level")
    )
    return materialize(row, "walk-0")


def _neighbours(edges: DataFrame, frontier: DataFrame, side: str) -> DataFrame:
    near, far = ("downstream_id", "upstream_id") if side == UP else ("upstream_id", "downstream_id")
    ids = frontier.select(F.col("id").alias(near))
    return edges.select(near, far).join(ids, near, "left_semi").select(F.col(far).alias("id"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _touched(edges: DataFrame, nodes: DataFrame, side: str, depth: int) -> DataFrame:
    """Edges at the nodes that were a frontier of this side."""
    near = "downstream_id" if side == UP else "upstream_id"
    frontier = nodes.filter(F.col("side").isin(CENTER, side) & (F.col("level") < depth))
    return edges.join(frontier.select(F.col("id").alias(near)), near, "left_semi")


def _finish(edges: DataFrame, levels: list[DataFrame], depth: int, sides: tuple[str, ...]) -> Walk:
    nodes = _union(levels)
    nodes = nodes.withColumn("layer", F.when(F.col("side") == UP, -F.col("level")).otherwise(F.col("level")))
    nothing = edges.limit(0)
    return Walk(
        nodes,
        _touched(edges, nodes, UP, depth) if UP in sides else nothing,
        _touched(edges, nodes, DOWN, depth) if DOWN in sides else nothing,
    )


def neighbourhood(edges: DataFrame, center, depth: int = 3) -> Walk:
    """Both directions level by level with one shared visited set.

    In each level the upstream step goes first, so a table reachable both ways
    in the same level counts as upstream. Edges to visited tables are reported.
    """
    levels = [_start(edges, center)]
    for level in range(1, depth + 1):
        last = levels[-1]
        reached = _union(
            [
                _neighbours(edges, last.filter(F.col("side").isin(CENTER, side)), side).withColumn("o", F.lit(order))
                for order, side in ((0, UP), (1, DOWN))
            ]
        )
        fresh = (
            reached.groupBy("id").agg(F.min("o").alias("o"))
            .join(_union(levels).select("id"), "id", "left_anti")
            .select("id", F.when(F.col("o") == 0, UP).otherwise(DOWN).alias("side"), F.lit(level).alias("level"))
        )
        new, count = materialize_counted(fresh, f"walk-{level}")
        if not count:
            break
        levels.append(new)
    return _finish(edges, levels, depth, (UP, DOWN))


def impact(edges: DataFrame, center, direction: str = "both", depth: int = 3) -> Walk:
    """Upstream to full depth first, then downstream, with one shared visited set."""
    if direction not in ("upstream", "downstream", "both"):
        raise ValueError(f"unknown direction: {direction}")
    levels = [_start(edges, center)]
    start = levels[0]
    sides = {"upstream": (UP,), "downstream": (DOWN,), "both": (UP, DOWN)}[direction]
    for side in sides:
        frontier = start
        for level in range(1, depth + 1):
            fresh = (
                _neighbours(edges, frontier, side).distinct()
                .join(_union(levels).select("id"), "id", "left_anti")
                .select("id", F.lit(side).alias("side"), F.lit(level).alias("level"))
            )
            frontier, count = materialize_counted(fresh, f"impact-{side}-{level}")
            if not count:
                break
            levels.append(frontier)
    return _finish(edges, levels, depth, sides)


def impact_paths(walk: Walk, assets: DataFrame) -> DataFrame:
    """Edges of an impact walk with the names of both ends."""
    names = assets.select("id", "fqn")
    edges = walk.upstream_edges.withColumn("direction", F.lit("upstream")).unionByName(
        walk.downstream_edges.withColumn("direction", F.lit("downstream"))
    )
    return (
        edges.select("direction", "upstream_id", "downstream_id", F.col("transform_type").alias("via"), "source")
        .join(names.select(F.col("id").alias("upstream_id"), F.col("fqn").alias("from_fqn")), "upstream_id", "left")
        .join(names.select(F.col("id").alias("downstream_id"), F.col("fqn").alias("to_fqn")), "downstream_id", "left")
    )


def affected_owners(walk: Walk, owners: DataFrame) -> DataFrame:
    """Distinct verified owners of the reached tables, sorted."""
    ids = walk.nodes.filter(F.col("side") != CENTER).select(F.col("id").alias("table_id"))
    return owners.filter("is_verified").join(ids, "table_id", "left_semi").select("user_email").distinct().orderBy("user_email")


def affected_terms(walk: Walk, asset_terms: DataFrame, terms: DataFrame) -> DataFrame:
    """Distinct glossary terms of the reached tables, sorted."""
    ids = walk.nodes.filter(F.col("side") != CENTER).select(F.col("id").alias("table_id"))
    used = asset_terms.join(ids, "table_id", "left_semi").select(F.col("term_id").alias("id")).distinct()
    return terms.join(used, "id", "left_semi").select("name").distinct().orderBy("name")


def impact_summary(walk: Walk, owners: DataFrame, asset_terms: DataFrame, terms: DataFrame) -> DataFrame:
    """One row of counts."""
    sides = walk.nodes.agg(
        F.count_if(F.col("side") == UP).alias("upstream_count"), F.count_if(F.col("side") == DOWN).alias("downstream_count")
    )
    return one_row(
        sides,
        affected_owners(walk, owners).agg(F.count("*").alias("owners")),
        affected_terms(walk, asset_terms, terms).agg(F.count("*").alias("terms")),
        walk.upstream_edges.agg(F.count("*").alias("upstream_edges")),
        walk.downstream_edges.agg(F.count("*").alias("downstream_edges")),
    )


def first_edges(walk: Walk, n: int = 50) -> DataFrame:
    """The bounded form: the first n edges each way, in id order."""
    order = ["upstream_id", "downstream_id"]
    up = walk.upstream_edges.orderBy(*order).limit(n).withColumn("direction", F.lit("upstream"))
    down = walk.downstream_edges.orderBy(*order).limit(n).withColumn("direction", F.lit("downstream"))
    return up.unionByName(down)


def _both_ways(edges: DataFrame) -> DataFrame:
    """Distinct links <a, b> of edges taken both ways; a table's link to itself leads nowhere."""
    pair = edges.select(F.col("upstream_id").alias("a"), F.col("downstream_id").alias("b")).where("a <> b")
    return pair.union(pair.select("b", "a")).distinct()


#: Folders of an index; a level tells its folders as the bits of a number.
BUCKETS = 60


@dataclass
class Adjacency:
    """Links <a, b> by the hash of ``a``, sorted by it: a hop reads the folders of its frontier, and in these the
    row groups that its ids can be in. The links of one table may fill several files."""

    links: DataFrame

    @staticmethod
    def bucket(column: str):
        return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")

    @staticmethod
    def of(links: DataFrame) -> "Adjacency":
        path = scratch_path(links.sparkSession, "adjacency")
        rows = links.select("a", "b", Adjacency.bucket("a").alias("bucket"))
        # A rebalance keeps the links of one folder together and splits folders that are far larger than others.
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "a").write.partitionBy("bucket").parquet(path)
        kind = links.schema["a"].dataType.simpleString()
        return Adjacency(links.sparkSession.read.schema(f"a {kind}, b {kind}, bucket int").parquet(path))

    @staticmethod
    def seen(column: str) -> dict:
        """What ``near`` has to know of a frontier, as aggregates of its ids."""
        folder = F.call_function("shiftleft", F.lit(1).cast("long"), Adjacency.bucket(column))
        return {"n": F.count(F.lit(1)), "folders": F.bit_or(folder), "least": F.min(column), "most": F.max(column)}

    def near(self, frontier: DataFrame, seen: dict) -> DataFrame:
        """Distinct neighbours <id> of a frontier <id>."""
        folders = [i for i in range(BUCKETS) if (seen["folders"] or 0) >> i & 1]
        links = self.links.where(F.col("bucket").isin(folders) & F.col("a").between(seen["least"], seen["most"]))
        return links.join(frontier.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()


def hop_distance(edges: DataFrame, center) -> DataFrame:
    """Undirected hops from a table to every table that can be reached: <id, distance>.

    A neighbour of a table n hops away is n - 1, n or n + 1 hops away, so only the last two levels
    tell what is new, and a hop costs no more for the hops before it. It reads the links of its frontier only.
    """
    index = Adjacency.of(_both_ways(edges))
    start = _start(edges, center).select("id", F.col("level").alias("distance"))
    first, seen = materialize_observed(start, "hops-0", **Adjacency.seen("id"))
    levels = [first]
    while True:
        fresh = (
            index.near(levels[-1], seen)
            .join(_union(levels[-2:]).select("id"), "id", "left_anti")
            .select("id", F.lit(len(levels)).alias("distance"))
        )
        new, seen = materialize_observed(fresh, f"hops-{len(levels)}", **Adjacency.seen("id"))
        if not seen["n"]:
            return _union(levels)
        levels.append(new)


def component_labels(edges: DataFrame) -> tuple[DataFrame, int]:
    """Least id of every table's component when edges go both ways: <id, label>; and the number of rounds.

    Each round a table, and what it points to, point to the least that its neighbours' targets point to, and every pointer is
    followed one step: distances halve, so that a chain of n tables takes about log n rounds. All steps are
    minima of partial aggregates; a hub's links are joined by rows.
    """
    links = materialize(_both_ways(edges), "links")
    labels = materialize(links.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")), "labels-0")
    rounds = 0
    while True:
        rounds += 1
        ahead = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
        jumped = materialize(labels.join(ahead, "label").select("id", "label", "next"), f"jumps-{rounds}")
        found = (links.join(jumped.select(F.col("id").alias("b"), "next"), "b").groupBy(F.col("a").alias("id")).agg(F.min("next").alias("found")))
        both = jumped.join(found, "id").select("id", "label", F.least("next", "found").alias("to"))
        offers = both.select("id", "to").union(both.select(F.col("label").alias("id"), "to"))
        told = offers.groupBy("id").agg(F.min("to").alias("to")).join(labels, "id").select("id", F.least("to", "label").alias("label"), (F.col("to") < F.col("label")).alias("moved"))
        told, seen = materialize_observed(told, f"labels-{rounds}", moved=F.count_if("moved"))
        labels = told.select("id", "label")
        if not seen["moved"]:
            return labels, rounds


def reaches(edges: DataFrame, assets: DataFrame, center) -> DataFrame:
    """Per table: can it reach the center when edges go both ways? The center itself does not count."""
    labels, _ = component_labels(edges)
    kind = edges.schema["upstream_id"].dataType
    own = labels.where(F.col("id") == F.lit(center).cast(kind)).select("label")
    near = labels.join(own, "label", "left_semi").where(F.col("id") != F.lit(center).cast(kind)).select("id", F.lit(True).alias("hit"))
    return assets.select("id").join(near, "id", "left").select("id", F.col("hit").isNotNull().alias("reaches"))
