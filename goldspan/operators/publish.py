"""Publishing golden records: identifiers, change rows, the ordered feed, merges and their undoing, references, views of a record.

Golden rows have master_id, status (active, merged or retired), survivor_id and
row_version; cross-references rec and master_id; retired ids retired_id,
merged_into (the direct edge), survivor_id (the end of the chain) and active.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldspan.operators.golden import collapse_chains, components
from goldspan.runtime import Workspace, numbered

#: Kinds of change, the one that tells most first, and parts of a record in their order.
KINDS = ("merged", "unmerged", "retired", "reinstated", "created", "remapped", "updated")
PARTS = ("values", "xref", "relationship", "status", "survivor")


def new_ids(items: DataFrame, code: str, order: list[str], last: int = 0) -> DataFrame:
    """items with master_id ``CODE-000001`` and so on in their order, behind the last number given before."""
    return numbered(items, order).withColumn("master_id", F.concat(F.lit(code + "-"), F.lpad((F.col("n") + last).cast("string"), 6, "0"))).drop("n")


def next_version(commits: DataFrame) -> DataFrame:
    """commit_version of the next commit: one more than the largest, without gaps."""
    return commits.agg((F.coalesce(F.max("commit_version"), F.lit(0)) + 1).alias("commit_version"))


def conflicts(golden: DataFrame, expected: DataFrame) -> DataFrame:
    """master_id and reason of planned changes (master_id, row_version) whose golden row is gone, has another version or isn't active."""
    now = golden.select("master_id", F.col("row_version").alias("_now"), "status")
    reason = F.when(F.col("_now").isNull(), "unknown").when(F.col("_now") != F.col("row_version"), "stale").when(F.col("status") != "active", "not_active")
    return expected.join(now, "master_id", "left").select("master_id", reason.alias("reason")).where("reason is not null")


def change_rows(marks: DataFrame, version: int) -> DataFrame:
    """commit_version, change_seq, entity, master_id, change_kind, survivor_id and parts of all marks (entity, master_id, kind, part, survivor_id).

    Of a record's kinds the one that tells most stands; its parts come in their
    own order; rows are counted by entity and master.
    """
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    per = marks.groupBy("entity", "master_id").agg(F.min(rank).alias("k"), F.collect_set("part").alias("p"), F.max("survivor_id").alias("survivor_id"))
    kind = F.array(*map(F.lit, KINDS))[F.col("k").cast("int") - 1]
    parts = F.filter(F.array(*map(F.lit, PARTS)), lambda x: F.array_contains("p", x))
    rows = per.select("entity", "master_id", kind.alias("change_kind"), F.when(kind.isin("merged", "remapped"), F.col("survivor_id")).alias("survivor_id"), parts.alias("parts"))
    return numbered(rows, ["entity", "master_id"], "change_seq").withColumn("commit_version", F.lit(version).cast("bigint"))


def before_after(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, op (insert, update or delete), changed, and before and after as JSON, of every row that differs, null being equal to null."""
    old = before.select(*keys, F.struct(*values).alias("_b"))
    new = after.select(*keys, F.struct(*values).alias("_a"))
    both = old.join(new, keys, "full")
    names = F.array_compact(F.array(*(F.when(~F.col(f"_b.{v}").eqNullSafe(F.col(f"_a.{v}")), F.lit(v)) for v in values)))
    op = F.when(F.col("_b").isNull(), "insert").when(F.col("_a").isNull(), "delete").when(F.size(names) > 0, "update")
    return both.select(*keys, op.alias("op"), names.alias("changed"), F.to_json("_b").alias("before"), F.to_json("_a").alias("after")).where("op is not null")


def feed_page(changes: DataFrame, rows: DataFrame, since: int, cursor: tuple[int, int] | None, entity: str | None, limit: int, upto: int) -> DataFrame:
    """The next ``limit`` change rows after version ``since``, or behind a cursor inside a commit, not beyond version ``upto``, each with the current row of its master.

    rows has entity, master_id and the columns to give; a master without a row keeps its change.
    """
    place = F.struct(F.col("commit_version").cast("bigint"), F.col("change_seq").cast("bigint"))
    after = F.struct(F.lit(cursor[0]).cast("bigint"), F.lit(cursor[1]).cast("bigint")) if cursor else F.struct(F.lit(since).cast("bigint"), F.lit((1 << 62)).cast("bigint"))
    page = changes.where((place > after) & (F.col("commit_version") <= upto))
    if entity is not None:
        page = page.where(F.col("entity") == entity)
    page = page.orderBy("commit_version", "change_seq").limit(limit)  # the feature: one page
    return page.join(rows, ["entity", "master_id"], "left")


# --- merges ------------------------------------------------------------------------------


def merge(golden: DataFrame, xref: DataFrame, retired: DataFrame, merges: DataFrame) -> dict[str, DataFrame]:
    """golden, xref, retired and marks (for change_rows) after merges (retired_id, survivor_id), and refused ones with their reason.

    A merge is refused into itself, of or into a record that isn't active, twice
    for one record, and around a circle. Chains end at their last survivor, also
    those of earlier merges, whose records are remapped; members follow their master.
    """
    space = Workspace(golden.sparkSession, "merge")
    status = golden.select("master_id", "status")
    of = lambda end, name: status.select(F.col("master_id").alias(end), F.col("status").alias(name))
    twice = merges.groupBy("retired_id").agg(F.count(F.lit(1)).alias("n"))
    ends = collapse_chains(merges, "retired_id", "survivor_id").select("retired_id", F.col("survivor_id").alias("end"))
    seen = merges.join(of("retired_id", "rs"), "retired_id", "left").join(of("survivor_id", "ss"), "survivor_id", "left").join(twice, "retired_id").join(ends, "retired_id", "left")
    reason = (
        F.when(F.col("retired_id") == F.col("survivor_id"), "merge_into_itself").when(F.coalesce(F.col("rs") != "active", F.lit(True)) | F.coalesce(F.col("ss") != "active", F.lit(True)), "not_active")
        .when(F.col("n") > 1, "already_merged").when(F.col("end").isNull(), "circle")
    )
    judged = space.save(seen.select("retired_id", "survivor_id", reason.alias("reason")), "judged")
    good = judged.where("reason is null").select("retired_id", "survivor_id")
    direct = retired.where("active").select("retired_id", F.col("merged_into").alias("survivor_id")).unionAll(good)
    last = space.save(collapse_chains(direct, "retired_id", "survivor_id"), "last")
    new = good.select("retired_id", F.col("survivor_id").alias("merged_into")).join(last, "retired_id").withColumn("active", F.lit(True))
    kept = retired.join(good.select("retired_id"), "retired_id", "left_anti").select("retired_id", "merged_into", F.col("survivor_id").alias("_old"), "active").join(last, "retired_id", "left")
    moved = space.save(kept.select("retired_id", "merged_into", F.when(F.col("active"), F.coalesce("survivor_id", "_old")).otherwise(F.col("_old")).alias("survivor_id"), "active", "_old"), "moved")
    after = moved.drop("_old").unionByName(new.select("retired_id", "merged_into", "survivor_id", "active"))
    to = last.select(F.col("retired_id").alias("master_id"), F.col("survivor_id").alias("_to"))
    links = xref.join(to, "master_id", "left").select("rec", F.coalesce("_to", "master_id").alias("master_id"))
    rest = [c for c in golden.columns if c not in ("master_id", "status", "survivor_id")]
    rows = golden.join(to, "master_id", "left").select("master_id", F.when(F.col("_to").isNotNull(), "merged").otherwise(F.col("status")).alias("status"), F.coalesce("_to", "survivor_id").alias("survivor_id"), *rest)
    with_members = xref.select(F.col("master_id").alias("retired_id")).distinct().withColumn("_has", F.lit(True))
    gone = new.select("retired_id", "survivor_id").join(with_members, "retired_id", "left")
    parts = F.when(F.col("_has"), F.array(*map(F.lit, ("status", "survivor", "xref")))).otherwise(F.array(F.lit("status"), F.lit("survivor")))
    marks = gone.select(F.col("retired_id").alias("master_id"), F.lit("merged").alias("kind"), F.explode(parts).alias("part"), "survivor_id")
    marks = marks.unionAll(new.select(F.col("survivor_id").alias("master_id"), F.lit("updated").alias("kind"), F.lit("xref").alias("part"), F.lit(None).cast("string").alias("survivor_id")).distinct())
    remapped = moved.where("active and survivor_id <> _old").select(F.col("retired_id").alias("master_id"), F.lit("remapped").alias("kind"), F.lit("survivor").alias("part"), "survivor_id")
    return {"golden": rows, "xref": links, "retired": after, "marks": marks.unionAll(remapped), "refused": judged.where("reason is not null")}


def unmerge(golden: DataFrame, xref: DataFrame, retired: DataFrame, undone: DataFrame, members_back: DataFrame) -> dict[str, DataFrame]:
    """golden, xref, retired and marks after merges are undone (undone: retired_id; members_back: retired_id, rec).

    Chains that passed through an undone id end there again. Members go back only
    from where the record was merged into. Undoing what isn't merged changes nothing.
    """
    space = Workspace(golden.sparkSession, "unmerge")
    known = space.save(retired.where("active").join(undone.select("retired_id").distinct(), "retired_id", "left_semi"), "undone")
    left = retired.where("active").join(known.select("retired_id"), "retired_id", "left_anti")
    last = space.save(collapse_chains(left.select("retired_id", F.col("merged_into").alias("survivor_id")), "retired_id", "survivor_id"), "last")
    moved = space.save(left.select("retired_id", "merged_into", F.col("survivor_id").alias("_old"), "active").join(last, "retired_id"), "moved")
    dead = retired.where("not active").unionByName(known.withColumn("active", F.lit(False)))
    after = moved.select("retired_id", "merged_into", "survivor_id", "active").unionByName(dead.select("retired_id", "merged_into", "survivor_id", "active"))
    back = members_back.join(known.select("retired_id", F.col("survivor_id").alias("_from")), "retired_id").select("rec", "retired_id", "_from")
    links = xref.join(back, "rec", "left").select("rec", F.when(F.col("master_id") == F.col("_from"), F.col("retired_id")).otherwise(F.col("master_id")).alias("master_id"))
    rest = [c for c in golden.columns if c not in ("master_id", "status", "survivor_id")]
    to = last.select(F.col("retired_id").alias("master_id"), F.col("survivor_id").alias("_to"))
    free = known.select(F.col("retired_id").alias("master_id"), F.lit(True).alias("_free"))
    status = F.when(F.col("_free"), "active").otherwise(F.col("status"))
    rows = golden.join(to, "master_id", "left").join(free, "master_id", "left").select("master_id", status.alias("status"), F.when(~F.coalesce("_free", F.lit(False)), F.coalesce("_to", "survivor_id")).alias("survivor_id"), *rest)
    has = back.select("retired_id").distinct().withColumn("_has", F.lit(True))
    parts = F.when(F.col("_has"), F.array(*map(F.lit, ("status", "survivor", "values", "xref")))).otherwise(F.array(*map(F.lit, ("status", "survivor", "values"))))
    marks = known.join(has, "retired_id", "left").select(F.col("retired_id").alias("master_id"), F.lit("unmerged").alias("kind"), F.explode(parts).alias("part"), F.lit(None).cast("string").alias("survivor_id"))
    marks = marks.unionAll(back.select(F.col("_from").alias("master_id"), F.lit("updated").alias("kind"), F.lit("xref").alias("part"), F.lit(None).cast("string").alias("survivor_id")).distinct())
    remapped = moved.where("survivor_id <> _old").select(F.col("retired_id").alias("master_id"), F.lit("remapped").alias("kind"), F.lit("survivor").alias("part"), "survivor_id")
    return {"golden": rows, "xref": links, "retired": after, "marks": marks.unionAll(remapped)}


def link(xref: DataFrame, links: DataFrame, golden: DataFrame, retired: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cross-references after links (rec, master_id), the marks of masters that gain or lose a member, and refused links with their reason.

    A link to a merged master goes to its survivor; one to an unknown or retired
    master, or a second one of the same record, is refused.
    """
    end = retired.where("active").select(F.col("retired_id").alias("master_id"), F.col("survivor_id").alias("_to"))
    asked = links.join(end, "master_id", "left").select("rec", F.coalesce("_to", "master_id").alias("master_id")).distinct()
    many = asked.groupBy("rec").agg(F.count(F.lit(1)).alias("_n"))
    judged = asked.join(golden.select("master_id", "status"), "master_id", "left").join(many, "rec")
    judged = judged.withColumn("reason", F.when(F.col("status").isNull(), "unknown").when(F.col("status") != "active", "not_active").when(F.col("_n") > 1, "ambiguous"))
    good = judged.where("reason is null").select("rec", F.col("master_id").alias("_new"))
    both = xref.join(good, "rec", "full")
    after = both.select("rec", F.coalesce("_new", "master_id").alias("master_id"))
    moved = both.where(F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("master_id")))
    touched = moved.select(F.explode(F.array_compact(F.array("master_id", "_new"))).alias("master_id")).distinct()
    return after, touched.select("master_id", F.lit("updated").alias("kind"), F.lit("xref").alias("part"), F.lit(None).cast("string").alias("survivor_id")), judged.where("reason is not null").select("rec", "master_id", "reason")


def set_status(golden: DataFrame, masters: DataFrame, retire: bool) -> tuple[DataFrame, DataFrame]:
    """golden with masters (master_id) retired, or reinstated, and their marks; only active records retire and only retired ones come back."""
    start, end, kind = ("active", "retired", "retired") if retire else ("retired", "active", "reinstated")
    hit = golden.where(F.col("status") == start).join(masters.select("master_id").distinct(), "master_id", "left_semi").select("master_id", F.lit(True).alias("_hit"))
    rest = [c for c in golden.columns if c not in ("master_id", "status")]
    after = golden.join(hit, "master_id", "left").select("master_id", F.when(F.col("_hit"), end).otherwise(F.col("status")).alias("status"), *rest)
    return after, hit.select("master_id", F.lit(kind).alias("kind"), F.lit("status").alias("part"), F.lit(None).cast("string").alias("survivor_id"))


def detach(xref: DataFrame, recs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cross-references without those of recs (rec, master_id) that still hold, and the marks of the masters that lose a member."""
    keys = ["rec", "master_id"]
    gone = xref.join(recs.select(*keys).distinct(), keys, "left_semi")
    marks = gone.select("master_id", F.lit("updated").alias("kind"), F.lit("xref").alias("part"), F.lit(None).cast("string").alias("survivor_id")).distinct()
    return xref.join(recs.select(*keys).distinct(), keys, "left_anti"), marks


def repoint(relationships: DataFrame, xref: DataFrame, retired: DataFrame) -> DataFrame:
    """Relationships (rel_id, origin, type, to_id) with from_id, the master that their origin record belongs to now, and to_id, the last survivor of the one named.

    Merging and unmerging re-point both ends by this alone. A relationship whose
    origin has no master, or whose ends became one record, has ended.
    """
    of = xref.select(F.col("rec").alias("origin"), F.col("master_id").alias("from_id"))
    end = retired.where("active").select(F.col("retired_id").alias("to_id"), F.col("survivor_id").alias("_to"))
    out = relationships.drop("from_id").join(of, "origin", "left").join(end, "to_id", "left").withColumn("to_id", F.coalesce("_to", "to_id")).drop("_to")
    return out.withColumn("ended", F.col("from_id").isNull() | (F.col("from_id") == F.col("to_id")))


def relationship_id(entity: Column, origin: Column, type_: Column) -> Column:
    """The same for one origin and type in every run."""
    return F.concat(F.lit("REL-"), F.substring(F.sha2(F.concat_ws("|", entity, origin, type_), 256), 1, 16))


def commit_units(anchors: DataFrame) -> DataFrame:
    """item and unit of items that must commit together: those joined by shared anchors (item, anchor), directly or through others. A unit is named by its first item."""
    rows = anchors.where("item is not null").select(F.col("item").cast("bigint").alias("item"), "anchor").distinct()
    first = rows.where("anchor is not null").groupBy("anchor").agg(F.min("item").alias("first"))
    edges = rows.join(first, "anchor").where("item <> first").select(F.col("first").alias("a"), F.col("item").alias("b"))
    named = components(edges).select(F.col("node").alias("item"), F.col("component").alias("unit"))
    return rows.select("item").distinct().join(named, "item", "left").select("item", F.coalesce("unit", "item").alias("unit"))


def pack_units(units: DataFrame, limit: int) -> DataFrame:
    """unit and chunk of units (unit, items) in their order: a chunk holds ``limit`` items at most, and a unit is never split; one larger than that is a chunk of its own.

    The order decides, so units pass one task, which keeps a running number only.
    """
    def fold(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, held = 0, 0
        for pdf in pdfs:
            out = []
            for n in pdf["items"]:
                if held and held + n > limit:
                    chunk, held = chunk + 1, 0
                held += n
                out.append(chunk)
            yield pd.DataFrame({"unit": pdf["unit"], "chunk": out})

    return units.select("unit", "items").coalesce(1).sortWithinPartitions("unit").mapInPandas(fold, f"unit {dict(units.dtypes)['unit']}, chunk int")


# --- views --------------------------------------------------------------------------------


def resolve_refs(refs: DataFrame, golden: DataFrame, retired: DataFrame, xref: DataFrame, states: DataFrame) -> DataFrame:
    """ref, kind (golden, source or unknown), master_id and notice (merged, retired or none) of what each reference names: a master, or a record ``system:key``."""
    r = refs.select(F.trim("ref").alias("ref")).distinct()
    g = golden.select(F.col("master_id").alias("ref"), "status")
    t = retired.where("active").select(F.col("retired_id").alias("ref"), F.col("survivor_id").alias("_to"))
    x = states.select(F.col("rec").alias("ref"), F.lit(True).alias("_state")).distinct().join(xref.select(F.col("rec").alias("ref"), F.col("master_id").alias("_master")), "ref", "left")
    out = r.join(g, "ref", "left").join(t, "ref", "left").join(x, "ref", "left")
    is_rec = F.col("ref").contains(":")
    kind = F.when(is_rec & F.col("_state"), "source").when(~is_rec & F.col("status").isNotNull(), "golden").otherwise("unknown")
    master = F.when(kind == "source", F.col("_master")).when((kind == "golden") & (F.col("status") == "merged"), F.coalesce("_to", "ref")).when(kind == "golden", F.col("ref"))
    notice = F.when((kind == "golden") & F.col("status").isin("merged", "retired"), F.col("status"))
    return out.select("ref", kind.alias("kind"), master.alias("master_id"), notice.alias("notice"))


def timeline(changes: DataFrame, commits: DataFrame, decisions: DataFrame) -> DataFrame:
    """master_id, at, what and who of every change (with its commit's moment and actor) and every decision about a record; ``place`` counts from the newest."""
    made = changes.join(commits.select("commit_version", F.col("committed_at").alias("at"), F.col("actor").alias("who")), "commit_version").select("master_id", "at", F.col("change_kind").alias("what"), "who", F.col("commit_version").alias("_v"))
    said = decisions.select("master_id", F.col("decided_at").alias("at"), F.col("decision").alias("what"), F.col("decided_by").alias("who"), F.lit(None).cast("bigint").alias("_v"))
    w = Window.partitionBy("master_id").orderBy(F.desc_nulls_last("at"), F.desc_nulls_last("_v"), "what", "who")
    return made.unionByName(said).withColumn("place", F.row_number().over(w)).drop("_v")


def source_record(states: DataFrame, history: DataFrame, failures: DataFrame, xref: DataFrame) -> DataFrame:
    """rec, its state's op and event, master_id, how many events it had, the latest of them, and the codes its values failed."""
    past = history.groupBy("rec").agg(F.count(F.lit(1)).alias("events"), F.max("occurred_at").alias("latest"))
    bad = failures.groupBy("rec").agg(F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("failed"))
    return states.select("rec", "op", "event_id").join(xref.select("rec", "master_id"), "rec", "left").join(past, "rec", "left").join(bad, "rec", "left")


def latest_labels(labels: DataFrame) -> DataFrame:
    """Of each pair's labels (a, b in either order, label, decided_at, entry) the one decided last; ties go to the larger entry."""
    pair = labels.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "label", "decided_at", "entry")
    best = pair.groupBy("a", "b").agg(F.max(F.struct("decided_at", "entry", "label")).alias("m"))
    return best.select("a", "b", "m.label", "m.decided_at", "m.entry")


def withdraw_labels(latest: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """Labels left when entries (a, b, entry) are withdrawn; one that a later entry has replaced stays."""
    return latest.join(withdrawn.select("a", "b", "entry").distinct(), ["a", "b", "entry"], "left_anti")


def key_difference(have: DataFrame, want: DataFrame) -> DataFrame:
    """rows of key tables to add and to remove: op and the common columns; what both hold isn't touched."""
    cols = want.columns
    add = want.select(*cols).distinct().join(have.select(*cols).distinct(), cols, "left_anti").withColumn("op", F.lit("add"))
    return add.unionByName(have.select(*cols).distinct().join(want.select(*cols).distinct(), cols, "left_anti").withColumn("op", F.lit("remove")))


def capped_count(rows: DataFrame, cap: int) -> DataFrame:
    """How many rows there are, counted up to ``cap`` only, and whether there are more."""
    n = rows.limit(cap + 1).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.least("n", F.lit(cap)).alias("n"), (F.col("n") > cap).alias("more"))


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name and n_rows of each table."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = part if out is None else out.unionAll(part)
    return out


def entity_order(references: dict[str, tuple[str, ...]]) -> list[str]:
    """Entities so that each comes after those it refers to, by name among equals; a circle is broken at its smallest name."""
    done: list[str] = []
    left = dict(references)
    while left:
        ready = sorted(e for e, to in left.items() if all(t not in left or t == e for t in to)) or [min(left)]
        done.append(ready[0])
        left.pop(ready[0])
    return done


def breaker(states: DataFrame, windows: DataFrame, floor: float = 0.95, restore: float = 0.98) -> DataFrame:
    """entity, band, tripped and move (trip, restore or null) after the latest windows (entity, band, n, upper).

    A closed breaker trips when the upper bound falls under ``floor``; a tripped one
    is restored when it reaches ``restore``. Without a window a state stays; without
    a state a breaker is closed.
    """
    out = windows.join(states.select("entity", "band", F.col("tripped").alias("_was")), ["entity", "band"], "full").withColumn("_was", F.coalesce("_was", F.lit(False)))
    now = F.when(~F.col("_was"), F.coalesce(F.col("upper") < floor, F.lit(False))).otherwise(F.coalesce(F.col("upper") < restore, F.lit(True)))
    move = F.when(now & ~F.col("_was"), "trip").when(~now & F.col("_was"), "restore")
    return out.select("entity", "band", now.alias("tripped"), move.alias("move"))
