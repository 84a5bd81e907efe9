"""New records against golden records and against each other: what each becomes, and what a steward must see.

Records are texts ``rec``; a pair has a, b, score and band (auto, review or
else). Ties go to the higher score, then the smaller text. Nulls in rec, a or b
drop the row; repeated pairs count once, by the highest score; empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldspan.operators.golden import collapse_chains, components
from goldspan.runtime import Workspace

RESOLUTION = "rec string, kind string, reason string, master_ids array<string>, score double, review_with array<string>"


def _mirrored(pairs: DataFrame) -> DataFrame:
    """Each pair from both its ends: rec, other, score, band."""
    one = unique_pairs(pairs)
    return one.select(F.col("a").alias("rec"), F.col("b").alias("other"), "score", "band").unionAll(one.select(F.col("b").alias("rec"), F.col("a").alias("other"), "score", "band"))


def unique_pairs(pairs: DataFrame) -> DataFrame:
    """Each pair once, a smaller than b, by its highest score."""
    ends = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score", "band")
    return ends.groupBy("a", "b").agg(F.max(F.struct("score", "band")).alias("p")).select("a", "b", "p.score", "p.band")


def declined(candidates: DataFrame, labels: DataFrame, retired: DataFrame | None = None) -> DataFrame:
    """candidates (rec, master_id, ...) without those a label (rec, master_id) says the record is not.

    A label on a master that was merged away holds for the survivor, given ``retired`` (retired, survivor).
    """
    said = labels.select("rec", "master_id")
    if retired is not None:
        ends = collapse_chains(retired).select(F.col("retired").alias("master_id"), F.col("survivor"))
        said = said.unionAll(said.join(ends, "master_id").select("rec", F.col("survivor").alias("master_id")))
    return candidates.join(said.distinct(), ["rec", "master_id"], "left_anti")


def golden_candidates(pairs: DataFrame, xref: DataFrame, rec_ids: DataFrame, member_ids: DataFrame) -> DataFrame:
    """rec, master_id, score, band, member, members and blocked of each record and each master that one of its pairs leads to.

    pairs has rec, member, score and band; xref rec and master_id; the ids rec (or
    master_id), scheme and value, valid ones only. A master is blocked where in
    some scheme both sides have values and none in common.
    """
    met = pairs.join(xref.select(F.col("rec").alias("member"), "master_id"), "member")
    best = met.groupBy("rec", "master_id").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "member", "band")).alias("b"), F.count(F.lit(1)).alias("members")
    ).select("rec", "master_id", (-F.col("b.s")).alias("score"), "b.band", "b.member", "members")
    mine = rec_ids.groupBy("rec", "scheme").agg(F.collect_set("value").alias("mine"))
    theirs = member_ids.groupBy("master_id", "scheme").agg(F.collect_set("value").alias("theirs"))
    clash = best.select("rec", "master_id").join(mine, "rec").join(theirs, ["master_id", "scheme"]).where(~F.arrays_overlap("mine", "theirs"))
    blocked = clash.groupBy("rec", "master_id").agg(F.concat(F.lit("cannot_link:"), F.min("scheme")).alias("blocked"))
    return best.join(blocked, ["rec", "master_id"], "left")


def default_candidate(candidates: DataFrame, close: float = 10.0) -> DataFrame:
    """rec, default_id and close_call: the best open candidate, none where the best two are within ``close`` points; blocked ones don't count."""
    both = F.when(F.col("blocked").isNull(), F.struct((-F.col("score")).alias("s"), "master_id"))
    per = candidates.groupBy("rec").agg(F.slice(F.array_sort(F.collect_list(both)), 1, 2).alias("top"))  # as many as a record has masters: the candidate cap bounds them
    first, second = F.get("top", F.lit(0)), F.get("top", F.lit(1))
    call = F.coalesce(second["s"] - first["s"] <= close, F.lit(False))
    return per.select("rec", F.when(~call, first["master_id"]).alias("default_id"), call.alias("close_call"))


def resolve_golden(candidates: DataFrame, outside: DataFrame, demoted: bool = False) -> DataFrame:
    """What records become by their golden candidates and by pairs (rec, other, score, band) with unlinked records outside the batch.

    One open auto candidate: link. Several: ambiguous, never merged on their own.
    Else a blocked auto candidate, a review candidate or an outside pair: review,
    for the first of these reasons that holds. Records with none of them don't appear.
    With ``demoted`` nothing links automatically: a would-be link is a review.
    """
    auto, review = F.col("band") == "auto", F.col("band") == "review"
    open_ = auto & F.col("blocked").isNull()
    ranked = lambda when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct((-F.col("score")).alias("s"), "master_id")))), lambda x: x["master_id"])
    best = lambda when: F.max(F.when(when, F.col("score")))
    g = candidates.groupBy("rec").agg(
        F.count_if(open_).alias("open"), F.count_if(auto & ~open_).alias("shut"), F.count_if(review).alias("maybe"), ranked(open_).alias("linkable"),
        ranked((auto & ~open_) | review).alias("held"), ranked(auto | review).alias("every"), best(open_).alias("open_score"), best((auto & ~open_) | review).alias("held_score"),
    )
    near = outside.where("band in ('auto', 'review') and rec <> other").groupBy("rec").agg(
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.least("rec", "other").alias("l"), F.greatest("rec", "other").alias("r"), "other"))), lambda x: x["other"])).alias("others"),
        F.max("score").alias("out_score"), F.bool_or(auto).alias("out_auto"),
    )
    r = g.join(near, "rec", "full").fillna(0, ["open", "shut", "maybe"])
    is_out = F.col("out_score").isNotNull()
    one = F.col("open") == 1
    kind = F.when(one & F.lit(not demoted), "link").when(one, "review").when(F.col("open") > 1, "ambiguous").when((F.col("shut") > 0) | (F.col("maybe") > 0) | is_out, "review")
    reason = (
        F.when(one, F.lit("breaker_demoted" if demoted else "auto_band")).when(F.col("open") > 1, "ambiguous_auto").when(F.col("shut") > 0, "cannot_link_conflict")
        .when(F.col("maybe") > 0, "review_band").when(F.lit(demoted) & F.coalesce("out_auto", F.lit(False)), "breaker_demoted").otherwise("unlinked_candidate")
    )
    none = F.array().cast("array<string>")
    ids = F.when(F.col("open") > 1, F.col("linkable")).when(one & F.lit(not demoted), F.col("linkable")).when(one, F.col("every")).otherwise(F.coalesce("held", none))
    score = F.when(F.col("open") > 0, F.col("open_score")).otherwise(F.coalesce("held_score", "out_score"))
    waits = F.when(kind == "review", F.coalesce("others", none)).otherwise(none)
    return r.select("rec", kind.alias("kind"), reason.alias("reason"), ids.alias("master_ids"), score.alias("score"), waits.alias("review_with")).where("kind is not null")


def waiting(records: DataFrame, pairs: DataFrame, resolved: DataFrame) -> DataFrame:
    """Reviews of records that must wait: unresolved ones that a chain of auto or review pairs joins to a resolved record.

    Waiting for whoever waits is reachability, so a whole component of unresolved
    records waits when any of it touches a resolved one.
    """
    space = Workspace(records.sparkSession, "waiting")
    live = pairs.where("band in ('auto', 'review')")
    done = resolved.select("rec").distinct()
    rest = space.save(records.select("rec").where("rec is not null").distinct().join(done, "rec", "left_anti"), "rest")
    ends = space.save(_mirrored(live), "ends")
    own = rest.withColumn("side", F.lit("rest")).unionAll(done.withColumn("side", F.lit("done")))
    touch = ends.join(rest, "rec").join(own.select(F.col("rec").alias("other"), "side"), "other")
    touch = space.save(touch, "touch")
    named = components(touch.where("side = 'rest'").select(F.col("rec").alias("a"), F.col("other").alias("b")))
    seeds = touch.where("side = 'done'").select("rec").distinct()
    placed = rest.join(named.select(F.col("node").alias("rec"), "component"), "rec", "left").withColumn("component", F.coalesce("component", "rec"))
    hot = placed.join(seeds, "rec", "left_semi").select("component").distinct()
    waits = space.save(placed.join(hot, "component", "left_semi").select("rec"), "waits")
    seen = touch.join(waits, "rec").join(done.unionAll(waits).select(F.col("rec").alias("other")), "other", "left_semi")
    order = F.struct((-F.col("score")).alias("s"), F.least("rec", "other").alias("l"), F.greatest("rec", "other").alias("r"), "other")
    per = seen.groupBy("rec").agg(F.array_sort(F.collect_set(order)).alias("t"))
    return per.select("rec", F.lit("review").alias("kind"), F.lit("batch_candidate").alias("reason"), F.array().cast("array<string>").alias("master_ids"), (-F.element_at("t", 1)["s"]).alias("score"), F.array_distinct(F.transform("t", lambda x: x["other"])).alias("review_with"))


#: Edges of a component, or of what is left of all components, that one task may hold where no union is refused.
FEW = 20_000

WALKED = "component string, x string, y string, score double, refused boolean"


def _walk(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """WALKED: each node, its cluster and the cluster's weakest union, and each refused union.

    Rows have component, a, b, score and the ends' ids ia and ib, a component's
    together and the strongest first; one component is held at a time.
    """
    at = None
    parent: dict[str, str] = {}
    known: dict[str, dict[str, set[str]]] = {}
    least: dict[str, float] = {}

    def find(x: str) -> str:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def ended() -> list[tuple]:
        return [(at, n, root, least.get(root), None) for n in parent for root in (find(n),)]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["component", "x", "y", "score", "refused"]).astype({"score": float})

    for pdf in pdfs:
        out = []
        for component, a, b, score, ia, ib in zip(pdf.component, pdf.a, pdf.b, pdf.score, pdf.ia, pdf.ib):
            if component != at:
                out += ended()
                at, parent, known, least = component, {}, {}, {}
            for node, values in ((a, ia), (b, ib)):
                if node not in parent:
                    parent[node], known[node] = node, {}
                    for text in values if values is not None else ():
                        scheme, _, value = text.partition("\x1f")
                        known[node].setdefault(scheme, set()).add(value)
            p, q = sorted((find(a), find(b)))
            if p == q:
                continue
            if any(s in known[q] and not known[q][s] & v for s, v in known[p].items()):
                out.append((component, a, b, score, True))
                continue
            parent[q] = p
            for s, v in known.pop(q).items():
                known[p].setdefault(s, set()).update(v)
            least[p] = min(least.pop(q, score), least.get(p, score), score)
        yield frame(out)
    yield frame(ended())


def _walked(edges: DataFrame) -> DataFrame:
    width = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = edges.select("component", "a", "b", "score", "ia", "ib").repartition(width, "component")
    return rows.sortWithinPartitions("component", F.desc("score"), "a", "b").mapInPandas(_walk, WALKED)


def cluster(records: DataFrame, pairs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters of records (rec, cluster, weakest) and the refused unions (a, b, score).

    Auto pairs join, the strongest first; a union that would put together a
    scheme with no value in common is refused. Components are walked edge by edge,
    each in one task, which holds one component's nodes at a time. One in which no
    scheme has two values can't refuse anything and is a cluster however large;
    those of more than FEW edges don't meet in a task. A conflicting component is
    as large as a chain of auto pairs that holds two identities, and is walked
    whole, since there every step depends on the ones before.
    ids has rec, scheme and value. A cluster is named by its smallest record.
    """
    space = Workspace(records.sparkSession, "clusters")
    links = space.save(unique_pairs(pairs.where("band = 'auto'")).select("a", "b", "score"), "links")
    held = ids.where("value is not null").select("rec", "scheme", "value").distinct()
    named = space.save(components(links), "named")
    every = space.save(records.select("rec").where("rec is not null").distinct().join(named.select(F.col("node").alias("rec"), "component"), "rec", "left").withColumn("component", F.coalesce("component", "rec")), "every")
    several = held.join(every, "rec").groupBy("component", "scheme").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo <> hi").select("component").distinct()
    torn = space.save(several, "torn")
    edges = space.save(links.join(named.select(F.col("node").alias("a"), "component"), "a"), "edges")
    many = edges.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FEW)
    large = space.save(many.join(torn, "component", "left_anti").select("component"), "large")
    lists = space.save(held.groupBy("rec").agg(F.collect_list(F.concat_ws("\x1f", "scheme", "value")).alias("ids")), "ids")
    side = lambda end, name: lists.select(F.col("rec").alias(end), F.col("ids").alias(name))
    small = edges.join(large, "component", "left_anti").join(side("a", "ia"), "a", "left").join(side("b", "ib"), "b", "left")
    out = space.save(_walked(small), "walked")
    placed = out.where("refused is null").select("component", F.col("x").alias("rec"), F.col("y").alias("cluster"), F.nanvl("score", F.lit(None).cast("double")).alias("weakest"))
    # A torn component's members without any edge inside it don't exist: each has an edge.
    whole = every.join(torn, "component", "left_anti").join(large, "component", "left_anti").join(placed.select("rec", "weakest"), "rec", "left").select("rec", F.col("component").alias("cluster"), "weakest")
    clusters = whole.unionAll(placed.join(torn, "component", "left_semi").select("rec", "cluster", "weakest"))
    if not large.isEmpty():
        # The weakest union of a cluster is the weakest edge of its strongest spanning tree; without refusals, the largest score s at which edges of at least s join it all.
        tree = space.save(_bottleneck(edges.join(large, "component", "left_semi"), space), "weakest")
        clusters = clusters.unionAll(every.join(tree, "component").select("rec", F.col("component").alias("cluster"), "weakest"))
    return clusters, out.where("refused").select(F.col("x").alias("a"), F.col("y").alias("b"), "score")


def _bottleneck(edges: DataFrame, space: Workspace) -> DataFrame:
    """component and weakest: the smallest score of the strongest spanning tree of each component, by rounds of each cluster's strongest edge (Boruvka) until FEW edges are left, which are walked."""
    e = space.save(edges.select("component", "score", "a", "b", F.col("a").alias("p"), F.col("b").alias("q")), "tree")
    lows = []
    while e.count() > FEW:
        order = F.struct((-F.col("score")).alias("s"), "a", "b")
        ends = e.select("component", "p", "q", order.alias("o")).unionAll(e.select("component", F.col("q").alias("p"), F.col("p").alias("q"), order.alias("o")))
        best = space.save(ends.groupBy("component", "p").agg(F.min(F.struct("o", "q")).alias("m")).select("component", "p", "m.q", (-F.col("m.o.s")).alias("s")), "best")
        lows.append(best.groupBy("component").agg(F.min("s").alias("weakest")))
        label = space.save(components(best.select(F.col("p").alias("a"), F.col("q").alias("b"))), "label")
        at = lambda end, new: label.select(F.col("node").alias(end), F.col("component").alias(new))
        moved = e.join(at("p", "np"), "p").join(at("q", "nq"), "q").where("np <> nq")
        e = space.save(moved.select("component", "score", "a", "b", F.col("np").alias("p"), F.col("nq").alias("q")), "tree")
    none = F.lit(None).cast("array<string>")
    rest = _walked(e.select("component", F.col("p").alias("a"), F.col("q").alias("b"), "score", none.alias("ia"), none.alias("ib")))
    least = rest.select("component", F.col("score").alias("weakest"))
    for low in lows:
        least = least.unionAll(low)
    return least.groupBy("component").agg(F.min("weakest").alias("weakest"))


def cluster_reviews(clusters: DataFrame, pairs: DataFrame, refused: DataFrame) -> DataFrame:
    """One review for each pair of clusters that a refused union or a review pair connects: one, two, a, b, score, reason; a refusal comes first, then the higher score."""
    odd = refused.select("a", "b", "score", F.lit("cannot_link_conflict").alias("reason")).unionAll(
        unique_pairs(pairs).where("band = 'review'").select("a", "b", "score", F.lit("possible_duplicate").alias("reason"))
    )
    of = lambda end, name: clusters.select(F.col("rec").alias(end), F.col("cluster").alias(name))
    met = odd.join(of("a", "ca"), "a").join(of("b", "cb"), "b").where("ca <> cb")
    flip = F.col("ca") > F.col("cb")
    either = lambda x, y: F.when(flip, F.col(y)).otherwise(F.col(x))
    first = F.struct((F.col("reason") != "cannot_link_conflict").alias("late"), (-F.col("score")).alias("s"), F.least("a", "b").alias("l"), F.greatest("a", "b").alias("g"), either("a", "b").alias("a"), either("b", "a").alias("b"), "reason")
    per = met.groupBy(F.least("ca", "cb").alias("one"), F.greatest("ca", "cb").alias("two")).agg(F.min(first).alias("f"))
    return per.select("one", "two", F.col("f.a").alias("a"), F.col("f.b").alias("b"), (-F.col("f.s")).alias("score"), F.col("f.reason").alias("reason"))


def union_edges(clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """rec, partner and score of the strongest auto pair that joins each record to its own cluster."""
    of = lambda end, name: clusters.select(F.col("rec").alias(end), F.col("cluster").alias(name))
    ends = _mirrored(pairs.where("band = 'auto'")).join(of("rec", "c"), "rec").join(of("other", "d"), "other").where("c = d")
    order = F.struct((-F.col("score")).alias("s"), F.least("rec", "other").alias("l"), F.greatest("rec", "other").alias("g"), "other")
    return ends.groupBy("rec").agg(F.min(order).alias("m")).select("rec", F.col("m.other").alias("partner"), (-F.col("m.s")).alias("score"))


def joiners_blocked(joins: DataFrame, held: DataFrame) -> DataFrame:
    """rec, target and scheme of each joiner that may not join its target when its turn comes.

    joins has target, rec, place (the order of joining) and ids (array of scheme
    and value structs); held the targets' own ids (target, scheme, value). A
    joiner is blocked where in a scheme it and what the target holds by then have
    values but none in common; one that isn't adds its own. A target's joiners
    pass one task in order, which keeps the target's values only.
    """
    own = held.groupBy("target").agg(F.collect_set(F.struct("scheme", "value")).alias("held"))
    rows = joins.where("target is not null and rec is not null").join(own, "target", "left").select("target", "place", "rec", "ids", "held")
    width = int(joins.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def fold(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, known = None, {}
        for pdf in pdfs:
            out = []
            for target, rec, ids, own in zip(pdf.target, pdf.rec, pdf.ids, pdf.held):
                if target != at:
                    at, known = target, {}
                    for i in own if own is not None else ():
                        known.setdefault(i["scheme"], set()).add(i["value"])
                mine: dict[str, set[str]] = {}
                for i in ids if ids is not None else ():
                    mine.setdefault(i["scheme"], set()).add(i["value"])
                clash = min((s for s, v in mine.items() if s in known and not known[s] & v), default=None)
                if clash is not None:
                    out.append((rec, target, clash))
                    continue
                for s, v in mine.items():
                    known.setdefault(s, set()).update(v)
            yield pd.DataFrame(out, columns=["rec", "target", "scheme"])

    return rows.repartition(width, "target").sortWithinPartitions("target", "place", "rec").mapInPandas(fold, "rec string, target string, scheme string")


def batch_resolution(records: DataFrame, candidates: DataFrame, outside: DataFrame, pairs: DataFrame, ids: DataFrame, demoted: bool = False) -> tuple[DataFrame, DataFrame]:
    """What every record of a batch becomes, and the reviews between its new clusters.

    Golden candidates come first, then records that wait for resolved ones, then
    the clusters of the rest. Resolutions: rec, kind, reason, master_ids, score,
    review_with and cluster (of new ones).
    """
    space = Workspace(records.sparkSession, "resolution")
    batch = records.select("rec").where("rec is not null").distinct()
    inside = pairs.join(batch.select(F.col("rec").alias("a")), "a", "left_semi").join(batch.select(F.col("rec").alias("b")), "b", "left_semi")
    inside = space.save(unique_pairs(inside), "pairs")
    first = space.save(resolve_golden(candidates, outside, demoted).join(batch, "rec", "left_semi"), "golden")
    if demoted:  # nothing joins a new cluster automatically: a record with an auto pair waits
        order = F.struct((-F.col("score")).alias("s"), F.least("rec", "other").alias("l"), F.greatest("rec", "other").alias("g"), "other")
        held = _mirrored(inside.where("band = 'auto'")).join(first, "rec", "left_anti").groupBy("rec").agg(F.array_sort(F.collect_set(order)).alias("t"))
        held = held.select("rec", F.lit("review").alias("kind"), F.lit("breaker_demoted").alias("reason"), F.array().cast("array<string>").alias("master_ids"), (-F.element_at("t", 1)["s"]).alias("score"), F.transform("t", lambda x: x["other"]).alias("review_with"))
        first = space.save(first.unionByName(held), "golden")
    waits = space.save(waiting(batch, inside, first), "waits")
    done = first.unionByName(waits)
    rest = space.save(batch.join(done, "rec", "left_anti"), "rest")
    among = inside.join(rest.select(F.col("rec").alias("a")), "a", "left_semi").join(rest.select(F.col("rec").alias("b")), "b", "left_semi")
    among = space.save(among, "among")
    clusters, refused = cluster(rest, among, ids)
    clusters = space.save(clusters, "clusters")
    none = F.array().cast("array<string>")
    new = clusters.select("rec", F.lit("new_cluster").alias("kind"), F.lit("new_cluster").alias("reason"), none.alias("master_ids"), F.col("weakest").alias("score"), none.alias("review_with"), F.concat(F.lit("new:"), "cluster").alias("cluster"))
    return done.withColumn("cluster", F.lit(None).cast("string")).unionByName(new), cluster_reviews(clusters, among, refused)
