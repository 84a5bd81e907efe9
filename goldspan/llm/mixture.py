"""A mix of sources in which each has its target share of all tokens.

Weights go down a tree of domain, language and source; a leaf is the documents
of one source in one language. A leaf that cannot use its budget, having too few
tokens even at its most repeats, passes the shortage to its siblings by their
weights, and what they cannot take goes up to the siblings of its ancestors. A
leaf fills its budget from seeded epochs: whole passes over its documents, then
the start of one more pass in an order of its own. Single uses are then added to
or taken from a source as long as that brings it nearer to its tokens.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from goldspan.llm import tokens
from goldspan.runtime import Workspace

#: Ranges of hash values in which a pass is cut; a leaf's running sum is made in each range on its own.
RANGES = 1024


def budgets(
    weights: dict[tuple[str, ...], float], capacity: dict[tuple[str, ...], float], total: float
) -> dict[tuple[str, ...], float]:
    """Tokens for each leaf of a tree of paths: by weight, shortages to siblings before ancestors' siblings."""

    def fill(paths: list[tuple[str, ...]], depth: int, amount: float) -> dict[tuple[str, ...], float]:
        if len(paths) == 1 and len(paths[0]) == depth:
            return {paths[0]: min(amount, capacity[paths[0]])}
        children: dict[str, list[tuple[str, ...]]] = defaultdict(list)
        for p in paths:
            children[p[depth]].append(p)
        weight = {c: sum(weights[p] for p in ps) for c, ps in children.items()}
        room = {c: sum(capacity[p] for p in ps) for c, ps in children.items()}
        given, open_ = dict.fromkeys(children, 0.0), {c for c in children if weight[c] > 0}
        left = amount
        while open_ and left > 1e-9:
            base = sum(weight[c] for c in open_)
            want = {c: given[c] + left * weight[c] / base for c in open_}
            full = {c for c in open_ if want[c] >= room[c]}
            for c in full or open_:
                given[c] = room[c] if full else want[c]
            left = amount - sum(given.values())
            open_ -= full
            if not full:
                break
        out: dict[tuple[str, ...], float] = {}
        for c, ps in children.items():
            out |= fill(ps, depth + 1, given[c])
        return out

    return fill(sorted(weights), 0, total) if weights else {}


def largest_exact(weights: dict[tuple[str, ...], float], capacity: dict[tuple[str, ...], float]) -> float:
    """The largest total at which no leaf that has documents runs short."""
    endless = {p: (float("inf") if c > 0 else 0.0) for p, c in capacity.items()}
    shares = budgets_inf(weights, endless)
    return min((capacity[p] / s for p, s in shares.items() if s > 0), default=0.0)


def budgets_inf(weights: dict[tuple[str, ...], float], capacity: dict[tuple[str, ...], float]) -> dict[tuple[str, ...], float]:
    return budgets(weights, capacity, 1.0)


def _settled(uses: DataFrame, wanted: dict[str, float], goal: dict[str, tuple[float, int]], space: Workspace) -> DataFrame:
    """uses, changed until no single use more or less of any one document brings its source nearer to its tokens.

    Each round takes the best document of every source, so a source's miss
    shrinks in every round that changes it; a few rounds settle it.
    """
    spark = uses.sparkSession
    while True:
        have = {r.source: r.t or 0 for r in uses.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("t")).collect()}
        rows = [(s, int(goal[s][1]), float(wanted[s] - t)) for s, t in sorted(have.items())]
        lack = spark.createDataFrame(rows, "source string, most int, lack double")  # a row for each source of the targets
        one = uses.join(F.broadcast(lack), "source").withColumn("step", F.when((F.col("lack") > 0) & (F.col("uses") < F.col("most")), 1).when((F.col("lack") < 0) & (F.col("uses") > 0), -1))
        left = F.abs(F.col("lack") - F.col("step") * F.col("n_tokens"))
        best = one.where(F.col("step").isNotNull() & (left < F.abs("lack") - 1e-6)).groupBy("source").agg(F.min(F.struct(left.alias("left"), "doc_id", "step")).alias("b")).collect()
        if not best:
            return uses
        steps = spark.createDataFrame([(r.b.doc_id, r.b.step) for r in best], "doc_id bigint, step int")
        moved = uses.join(F.broadcast(steps), "doc_id", "left").withColumn("uses", (F.col("uses") + F.coalesce("step", F.lit(0))).cast("int")).drop("step")
        further = space.save(moved, "uses")
        space.drop(uses)
        uses = further


def mix(
    documents: DataFrame,
    targets: DataFrame,
    total_tokens: int | None = None,
    domains: dict[str, str] | None = None,
    seed: int = 0,
    vocabulary: str = tokens.VOCABULARY,
) -> tuple[DataFrame, DataFrame]:
    """The uses of each document, and the target and actual share of each source.

    Uses: doc_id, source, lang, n_tokens, uses, for every document of a source
    in ``targets`` that has tokens; uses is 0 for those the mix leaves out.
    Shares: source, target_share, actual_share, tokens, docs, uses, max_repeats,
    one row for each source of ``targets``, also for one that has no documents.

    ``total_tokens`` is the size of the mix; without it, the mix is as large as
    it can be with no source short that has documents, which brings every share
    as near to its target as the documents allow. Null and unlisted sources stay
    out, as do documents without tokens. A document repeated under one doc_id is
    one document. A null target counts 0, a null max_repeats 1. ``domains`` names
    the domain of a source; without it all are siblings.
    """
    spark = documents.sparkSession
    space = Workspace(spark, "mix")
    goal = {r.source: (r.target_share or 0.0, 1 if r.max_repeats is None else r.max_repeats) for r in targets.select("source", "target_share", "max_repeats").where("source is not null").collect()}
    plain = F.lower(F.trim("lang"))
    rows = documents.select("doc_id", "text", "source", F.when(plain.rlike("^[a-z]{2,3}$"), plain).otherwise("und").alias("lang"))
    rows = rows.where(F.col("source").isin(*goal) if goal else F.lit(False))
    sized = tokens.token_counts(rows, vocabulary, keep=("source", "lang")).where("n_tokens > 0 and doc_id is not null")
    sized = sized.groupBy("doc_id").agg(F.min(F.struct("source", "lang", "n_tokens")).alias("d")).select("doc_id", "d.*")
    sized = space.save(sized, "sizes")

    # Leaves: at most the sources of the targets times the three-letter codes of languages.
    leaves = {(r.source, r.lang): r.t for r in sized.groupBy("source", "lang").agg(F.sum("n_tokens").alias("t")).collect()}
    of_source: dict[str, float] = defaultdict(float)
    for (s, _), t in leaves.items():
        of_source[s] += t
    of_lang: dict[str, float] = defaultdict(float)
    for (s, lang), t in leaves.items():
        of_lang[lang] += goal[s][0] * t / of_source[s]
    domain = lambda s: (domains or {}).get(s, "all")
    weights, capacity = {}, {}
    for s, (share, repeats) in goal.items():
        if of_source[s]:
            parts = {lang: t / of_source[s] for (x, lang), t in leaves.items() if x == s}
        else:  # a source without documents would be written in the languages of the rest
            parts = {lang: w / sum(of_lang.values()) for lang, w in of_lang.items()} if sum(of_lang.values()) else {"und": 1.0}
        for lang, part in parts.items():
            weights[domain(s), lang, s] = share * part
            capacity[domain(s), lang, s] = float(leaves.get((s, lang), 0) * repeats)
    total = largest_exact(weights, capacity) if total_tokens is None else float(total_tokens)
    budget = budgets(weights, capacity, total)

    plan = []
    for (_, lang, s), b in sorted(budget.items()):
        size = leaves.get((s, lang), 0)
        if size:
            whole = min(int((b + 1e-6) // size), goal[s][1])
            plan.append((s, lang, whole, float(b - whole * size) if whole < goal[s][1] else 0.0))
    plans = spark.createDataFrame(plan, "source string, lang string, passes int, rest double")

    # The start of one more pass. Sums by range of the hash come first, so a leaf of any size is summed in parallel.
    hashed = sized.join(plans, ["source", "lang"]).withColumn("h", F.xxhash64(F.lit(seed), "passes", "doc_id"))
    hashed = hashed.withColumn("span", F.shiftrightunsigned("h", 54).cast("int"))
    spans = hashed.groupBy("source", "lang", "span").agg(F.sum("n_tokens").alias("t"))
    ahead = F.sum("t").over(Window.partitionBy("source", "lang").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select("source", "lang", "span", F.coalesce(ahead, F.lit(0)).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("source", "lang", "span").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    placed = hashed.join(spans, ["source", "lang", "span"]).withColumn("upto", F.col("before") + within)
    placed = space.save(placed.select("doc_id", "source", "lang", "n_tokens", "passes", "rest", "upto"), "placed")

    # Each leaf may end its pass before or after the document that crosses its budget; the choice keeps the source's total nearest.
    ends = placed.groupBy("source", "lang").agg(
        F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))).alias("below"), F.min(F.when(F.col("upto") > F.col("rest"), F.col("upto"))).alias("above"), F.first("rest").alias("rest")
    )
    cuts, off = [], defaultdict(float)
    for r in sorted(ends.collect(), key=lambda r: (r.source, r.lang)):
        below, above = float(r.below or 0), r.above
        cut = below
        if r.rest > 1e-6 and above is not None and abs(off[r.source] + above - r.rest) < abs(off[r.source] + below - r.rest):
            cut = float(above)
        off[r.source] += cut - r.rest
        cuts.append((r.source, r.lang, cut))
    cut = spark.createDataFrame(cuts, "source string, lang string, cut double")
    uses = placed.join(F.broadcast(cut), ["source", "lang"]).select(
        "doc_id", "source", "lang", "n_tokens", (F.col("passes") + (F.col("upto") <= F.col("cut")).cast("int")).alias("uses")
    )
    wanted: dict[str, float] = defaultdict(float)
    for (_, _, s), b in budget.items():
        wanted[s] += b
    uses = _settled(space.save(uses, "uses"), wanted, goal, space)

    got = {r.source: r for r in uses.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("t"), F.sum((F.col("uses") > 0).cast("bigint")).alias("d"), F.sum("uses").alias("u")).collect()}
    all_tokens = sum(r.t for r in got.values())
    shares = [
        (s, float(share), (got[s].t / all_tokens if all_tokens else 0.0) if s in got else 0.0, *((got[s].t, got[s].d, got[s].u) if s in got else (0, 0, 0)), int(repeats))
        for s, (share, repeats) in sorted(goal.items())
    ]
    report = "source string, target_share double, actual_share double, tokens bigint, docs bigint, uses bigint, max_repeats int"
    return uses, spark.createDataFrame(shares, report)
