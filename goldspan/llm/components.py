"""One group for all records that pairwise matches link, directly or through others.

Random contraction: in each round every vertex hooks to the neighbour, or itself,
that comes first in an order of hashes drawn afresh; edges are relabelled with
the representatives, loops and repeats dropped. A round leaves a fixed share of
the vertices at most, whatever the graph's shape, so chains and stars of any
size end in logarithmically many rounds. What is left when at most FEW edges
are is contracted in one task, whatever the number of vertices was at first.
The rounds' mappings are then composed backwards. No group ever meets in one
task: every step is an aggregate whose partial results are formed before the
shuffle, or an equi-join whose hot keys are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldspan.runtime import Workspace, join_one

#: Edges that one task may hold.
FEW = 20_000


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """v and rep of the vertices of all edges of the task, which are few."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            p, q = find(parent.setdefault(u, u)), find(parent.setdefault(v, v))
            parent[max(p, q)] = min(p, q)
    yield pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array([find(v) for v in parent], pa.int64())], ["v", "rep"])


def contract(edges: DataFrame, space: Workspace, few: int | None = None) -> DataFrame:
    """``v, rep`` (bigint) of every vertex of ``edges`` (u, v bigint): rep is equal within a component and only there. ``few`` stands for FEW."""
    few = FEW if few is None else few
    edges = space.save(edges.where("u <> v").select("u", "v").distinct(), "edges")
    mappings: list[DataFrame] = []
    while (left := edges.count()) > 0:
        if left <= few:
            mappings.append(space.save(edges.coalesce(1).mapInArrow(_finish, "v bigint, rep bigint"), "hooks"))
            break
        salt = len(mappings) + 1

        def order(c: str, salt: int = salt) -> Column:
            return F.struct(F.xxhash64(F.lit(salt), c).alias("h"), F.col(c).alias("id"))

        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = (
            both.groupBy("u")
            .agg(F.min(order("v")).alias("best"), F.count(F.lit(1)).alias("degree"))
            .select(F.col("u").alias("v"), F.least(F.col("best"), order("u"))["id"].alias("rep"), "degree")
        )
        hooks = space.save(hooks, "hooks")
        mappings.append(hooks)
        a = hooks.select(F.col("v").alias("u"), F.col("rep").alias("ru"), "degree")
        b = hooks.select("v", F.col("rep").alias("rv"), "degree")
        moved = join_one(join_one(edges, a, ["u"], "degree"), b, ["v"], "degree").where("ru <> rv")
        fewer = space.save(moved.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "edges")
        space.drop(edges)
        edges = fewer
    if not mappings:
        return edges.select("v", F.col("u").alias("rep"))
    # Expand backwards: later rounds map the representatives of earlier ones.
    whole = mappings[-1].select("v", "rep")
    for earlier in reversed(mappings[:-1]):
        # Of a vertex that many hook to, the mapping is broadcast; most that nothing hooks to stay as they are.
        hooked = space.save(earlier.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).join(whole.select(F.col("v").alias("rep"), F.col("rep").alias("further")), "rep", "left").select("rep", F.coalesce("further", "rep").alias("further"), "n"), "hooked")
        joined = join_one(earlier.select("v", "rep"), hooked, ["rep"], "n").select("v", F.col("further").alias("rep"))
        expanded = space.save(joined, "expanded")
        space.drop(earlier)
        space.drop(whole)
        space.drop(hooked)
        whole = expanded
    return whole


def groups(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """scope, rec and group_id (the smallest rec of the group) of every record.

    ``nodes`` has scope and rec, ``links`` has scope, a and b. Records without
    any link are groups of their own. Links whose ends are equal or null link
    nothing; a link's end that nodes lacks is added. Repeated rows count once.
    Null recs are left out; empty tables give an empty result.
    """
    space = Workspace(nodes.sparkSession, "components")
    links = links.where("a is not null and b is not null").select("scope", "a", "b")
    recs = (
        nodes.select("scope", "rec")
        .unionAll(links.select("scope", F.col("a").alias("rec")))
        .unionAll(links.select("scope", F.col("b").alias("rec")))
        .where("rec is not null")
        .distinct()
    )
    # Numbers are given once and written: a task that runs again finds the same ones.
    recs = space.save(recs.withColumn("id", F.monotonically_increasing_id()), "records")
    ids = recs.select(F.col("scope").alias("s"), F.col("rec").alias("r"), "id")
    left = ids.select(F.col("s").alias("s1"), F.col("r").alias("r1"), F.col("id").alias("u"))
    right = ids.select(F.col("s").alias("s2"), F.col("r").alias("r2"), F.col("id").alias("v"))
    ends = (
        links.where("a <> b")
        .join(left, F.expr("scope <=> s1 and a = r1"))
        .join(right, F.expr("scope <=> s2 and b = r2"))
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    )
    reps = contract(ends, space)
    member = recs.join(reps.select(F.col("v").alias("id"), "rep"), "id", "left").withColumn("rep", F.coalesce("rep", "id"))
    member = space.save(member, "members")
    names = space.save(member.groupBy("rep").agg(F.min("rec").alias("group_id"), F.count(F.lit(1)).alias("n")), "names")
    return join_one(member, names, ["rep"], "n").select("scope", "rec", "group_id")


def linked(pairs: DataFrame, threshold: float = 90.0) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of scored pairs: of a pair's rows in either order the one scored last decides.

    Rows scored at one moment are decided by the higher rule_version, then the
    higher score; a null moment is the earliest, a null score doesn't link.
    """
    rec = lambda side: F.when(
        F.col(f"{side}_system").isNotNull() & F.col(f"{side}_key").isNotNull(), F.concat_ws(":", f"{side}_system", f"{side}_key")
    )
    rows = pairs.select(F.col("entity").alias("scope"), rec("left").alias("l"), rec("right").alias("r"), "score", "scored_at", "rule_version")
    nodes = rows.select("scope", F.explode(F.array("l", "r")).alias("rec")).where("rec is not null")
    last = (
        rows.where("l is not null and r is not null and l <> r")
        .groupBy("scope", F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b"))
        .agg(F.max(F.struct("scored_at", "rule_version", F.nanvl(F.col("score"), F.lit(None).cast("double")).alias("score"))).alias("last"))
    )
    return nodes, last.where(F.col("last.score") >= threshold).select("scope", "a", "b")
