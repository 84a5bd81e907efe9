"""Golden records: survivorship, references, retired identifiers, clusters, evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldspan.runtime import Workspace, join_one

#: Trust of a source that no table names.
UNTRUSTED = 1_000_000


# --- survivorship ---------------------------------------------------------------------


def unpivot(members: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    """One row for each member and attribute that has a value."""
    cells = F.array(*(F.struct(F.lit(a).alias("attr_name"), F.col(a).cast("string").alias("value")) for a in attributes))
    return members.select(*keys, F.explode(cells).alias("x")).select(*keys, "x.*").where("value is not null and trim(value) <> ''")


def ranked(values: DataFrame, strategy: str, group: list[str], tie: list[str]) -> DataFrame:
    """Values with their rank in the group by one strategy (source_trust, recency, completeness, frequency), then ``tie``."""
    if strategy == "frequency":
        values = values.withColumn("folded", F.lower(F.trim("value"))).withColumn("freq", F.count(F.lit(1)).over(Window.partitionBy(*group, "folded")))
    order = {
        "source_trust": [F.coalesce("trust", F.lit(UNTRUSTED))], "recency": [F.desc_nulls_last("occurred_at"), F.desc_nulls_last("landing_seq")],
        "completeness": [F.desc(F.length("value"))], "frequency": [F.desc("freq")] if strategy == "frequency" else [],
    }[strategy]
    return values.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order, *tie)))


def provenance(values: DataFrame, group: list[str], tie: list[str], runners: int = 5) -> DataFrame:
    """The winner by trust then recency, what decided between the first two, and up to five runners-up."""
    order = [F.coalesce("trust", F.lit(UNTRUSTED)), F.desc_nulls_last("occurred_at"), F.desc_nulls_last("landing_seq"), *map(F.col, tie)]
    w = Window.partitionBy(*group).orderBy(*order)
    r = values.withColumn("rank", F.row_number().over(w)).withColumn("next", F.lead(F.struct("trust", "occurred_at", "landing_seq")).over(w))
    decided = (
        F.when(F.col("next").isNull(), "only").when(~F.col("trust").eqNullSafe(F.col("next.trust")), "source_trust")
        .when(~F.col("occurred_at").eqNullSafe(F.col("next.occurred_at")) | ~F.col("landing_seq").eqNullSafe(F.col("next.landing_seq")), "recency").otherwise("tie_break")
    )
    r = r.withColumn("decided_by", decided).where(F.col("rank") <= runners + 1)
    return r.groupBy(*group).agg(
        F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("value"), F.max(F.when(F.col("rank") == 1, F.col("decided_by"))).alias("decided_by"), F.sum((F.col("rank") > 1).cast("int")).alias("runners_up")
    )


def keyed_union(entries: DataFrame, group: list[str], key: str, order: list[Column]) -> DataFrame:
    """Of a repeating group's entries, the first by ``order`` for each folded key."""
    w = Window.partitionBy(*group, F.lower(F.trim(key))).orderBy(*order)
    return entries.where(F.col(key).isNotNull()).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


# --- references and identifiers ---------------------------------------------------------


def resolve_references(rows: DataFrame, ref: str, targets: DataFrame, key: str, master: str) -> DataFrame:
    """rows with the target's master; null where the reference names nothing that exists."""
    return rows.join(targets.select(F.col(key).alias("_k"), F.col(master).alias("resolved")), F.col(ref) == F.col("_k"), "left").drop("_k")


def collapse_chains(merges: DataFrame, retired: str = "retired", survivor: str = "survivor") -> DataFrame:
    """The last survivor of every retired identifier: pointers are doubled until none moves, in logarithmically many joins.

    Of several rows of one retired id the smallest survivor counts. Ids whose
    chain runs into a circle have no survivor; they are left out, as are nulls.
    """
    space = Workspace(merges.sparkSession, "chains")
    rows = merges.where(F.col(retired).isNotNull() & F.col(survivor).isNotNull()).groupBy(F.col(retired).alias("r")).agg(F.min(survivor).alias("s"))
    now = space.save(rows.where("r <> s"), "chain")
    reach, ids = 1, now.count()  # a pointer reaches so many steps; a chain has fewer steps than there are ids
    while True:
        step = now.join(now.select(F.col("r").alias("s"), F.col("s").alias("t")), "s", "left").select("r", F.coalesce("t", "s").alias("s"), F.col("t").isNotNull().alias("moved"))
        step = space.save(step, "chain")
        space.drop(now)
        now, reach = step, 2 * reach
        if step.where("moved").isEmpty() or reach > 2 * ids:  # what still moves then goes round
            return now.where("not moved").select(F.col("r").alias(retired), F.col("s").alias(survivor))


def best_member(pairs: DataFrame, xref: DataFrame) -> DataFrame:
    """record, master_id, the best score with a member and how many members scored; pairs are (record, member, score)."""
    met = pairs.join(xref.select(F.col("rec").alias("member"), "master_id"), "member")
    return met.groupBy("record", "master_id").agg(F.max(F.struct("score", F.col("member"))).alias("b"), F.count(F.lit(1)).alias("members")).select(
        "record", "master_id", F.col("b.score").alias("score"), F.col("b.member").alias("member"), "members"
    )


def conflicting(pairs: DataFrame, records: DataFrame, masters: DataFrame) -> DataFrame:
    """Of pairs (record, master_id) those in which a scheme's identifiers of both sides have nothing in common.

    ``records`` has record, scheme, ids; ``masters`` master_id, scheme, master_ids; ids are arrays of valid identifiers.
    """
    return pairs.join(records, "record").join(masters, ["master_id", "scheme"]).where(~F.arrays_overlap("ids", "master_ids")).select("record", "master_id", "scheme")


# --- clusters ---------------------------------------------------------------------------


#: Edges that one task may hold.
FEW = 20_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """x and rep (the smallest node) of the nodes of all edges of the task, which are few."""
    parent: dict = {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            p, q = find(parent.setdefault(x, x)), find(parent.setdefault(y, y))
            parent[max(p, q)] = min(p, q)
    if kind is not None:
        yield pa.RecordBatch.from_arrays([pa.array(list(parent), kind), pa.array([find(x) for x in parent], kind)], ["x", "rep"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (its smallest node) of every node that an edge names.

    In each round every node hooks to the one that comes first, among itself and
    its neighbours, in an order of hashes drawn afresh, and edges are relabelled:
    a fixed share of the nodes is left at most, whatever the graph's shape, so a
    chain of any length ends in logarithmically many rounds. The last FEW edges
    are joined in one task, and the rounds' mappings composed backwards.
    """
    space = Workspace(edges.sparkSession, "labels")
    now = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    now = space.save(now.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while (left := now.count()) > 0:
        if left <= FEW:
            kind = now.schema["x"].dataType.simpleString()
            rounds.append(space.save(now.coalesce(1).mapInArrow(_joined, f"x {kind}, rep {kind}"), "hooks"))
            break
        order = lambda c, salt=len(rounds) + 1: F.struct(F.xxhash64(F.lit(salt), c).alias("h"), F.col(c).alias("id"))
        both = now.select("x", "y").unionAll(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        best = both.groupBy("x").agg(F.min(order("y")).alias("best"), F.count(F.lit(1)).alias("degree"))
        hooks = space.save(best.select("x", F.least("best", order("x"))["id"].alias("rep"), "degree"), "hooks")
        rounds.append(hooks)
        at = lambda end, name, hooks=hooks: hooks.select(F.col("x").alias(end), F.col("rep").alias(name), "degree")
        moved = join_one(join_one(now, at("x", "p"), ["x"], "degree"), at("y", "q"), ["y"], "degree").where("p <> q")
        fewer = space.save(moved.select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).distinct(), "edges")
        space.drop(now)
        now = fewer
    if not rounds:
        return now.select(F.col("x").alias("node"), F.col("y").alias("component"))
    whole = rounds[-1].select("x", "rep")
    for earlier in reversed(rounds[:-1]):
        further = earlier.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).join(whole.select(F.col("x").alias("rep"), F.col("rep").alias("further")), "rep", "left")
        further = space.save(further.select("rep", F.coalesce("further", "rep").alias("further"), "n"), "further")
        whole = space.save(join_one(earlier.select("x", "rep"), further, ["rep"], "n").select("x", F.col("further").alias("rep")), "whole")
    if len(rounds) == 1 and left > 0:  # the task has named them by their smallest
        return whole.select(F.col("x").alias("node"), F.col("rep").alias("component"))
    names = space.save(whole.groupBy("rep").agg(F.min("x").alias("component"), F.count(F.lit(1)).alias("n")), "names")
    return join_one(whole, names, ["rep"], "n").select(F.col("x").alias("node"), "component")


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes of components that hold a seed: the fixpoint of waiting for whoever waits."""
    named = components(edges)
    marked = named.join(seeds.select("node").distinct(), "node", "left_semi").select("component").distinct()
    return named.join(marked, "component", "left_semi").select("node")


# --- evaluation -------------------------------------------------------------------------


def pairwise_evaluation(assigned: DataFrame) -> DataFrame:
    """Pairs in common, found and true of (cluster, truth) rows, with precision, recall and F1; counts of groups, no pair is formed."""
    pairs = F.sum(F.expr("cast(n * (n - 1) / 2 as bigint)"))
    joint = assigned.groupBy("cluster", "truth").agg(F.count(F.lit(1)).alias("n")).agg(pairs.alias("both"))
    found = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).agg(pairs.alias("found"))
    true = assigned.groupBy("truth").agg(F.count(F.lit(1)).alias("n")).agg(pairs.alias("true_pairs"))
    out = joint.crossJoin(found).crossJoin(true)  # three single rows
    p, r = F.col("both") / F.col("found"), F.col("both") / F.col("true_pairs")
    return out.select("both", "found", "true_pairs", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * p * r / (p + r), 6).alias("f1"))
