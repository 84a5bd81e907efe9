"""Estimates of a matcher's weights from records and pairs: frequencies, levels of random pairs, matches by identifier, passes, prior.

Every estimate is an aggregate over records or pairs; only level patterns and
levels by comparison, a few thousand rows at most, come to the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from goldspan.operators.pairs import M_DEFAULT, expectation_maximisation

FLOOR = 1e-9


def value_frequencies(records: DataFrame, forms: dict[str, str]) -> DataFrame:
    """comparison and u0, the chance that two records agree in the exact form: the sum of squared shares of its values among records that have one."""
    cells = F.array(*(F.struct(F.lit(c).alias("comparison"), F.col(form).cast("string").alias("value")) for c, form in forms.items()))
    counts = records.select(F.explode(cells).alias("x")).select("x.*").where("value is not null and value <> ''").groupBy("comparison", "value").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("comparison").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("sq"), F.sum("n").alias("all"))
    return per.select("comparison", (F.col("sq") / (F.col("all").cast("double") * F.col("all"))).alias("u0"))


def u_pairs(records: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Up to n random pairs: of the first 2n records by ``order`` (a hash, then the key) the i-th with the one half the number further on.

    The first 2n are a sampling operator's bounded draw; they are numbered in one task.
    """
    first = records.orderBy(*order).limit(2 * max(n, 0))
    placed = first.withColumn("_rn", F.row_number().over(Window.orderBy(*order)) - 1)
    half = F.floor(F.lit(placed.count()) / 2).cast("int")
    left = placed.where(F.col("_rn") < half).select("_rn", F.struct(*records.columns).alias("l"))
    right = placed.where((F.col("_rn") >= half) & (F.col("_rn") < 2 * half)).select((F.col("_rn") - half).alias("_rn"), F.struct(*records.columns).alias("r"))
    return left.join(right, "_rn").select("l", "r")


def first_pass(pairs: DataFrame) -> DataFrame:
    """Each pair of left_rec and right_rec once, from the pass that comes first by name."""
    rest = [c for c in pairs.columns if c not in ("left_rec", "right_rec", "pass")]
    best = pairs.groupBy("left_rec", "right_rec").agg(F.min(F.struct("pass", *rest)).alias("b"))
    return best.select("left_rec", "right_rec", *(F.col(f"b.{c}").alias(c) for c in ("pass", *rest)))


def sampled_pairs(pairs: DataFrame, cap: int) -> DataFrame:
    """left_rec, right_rec, pass and weight: each pass keeps its ``cap`` pairs lowest by hash; a pair's weight is 1 over the largest share kept by the passes that found it.

    The hash is uniform in [0, 1) and the same in every pass, so a pair's chance
    of being kept is the share of its most generous pass.
    """
    text = F.concat_ws("\x1e", "left_rec", "right_rec")
    place = F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    rows = pairs.select("left_rec", "right_rec", "pass").distinct().withColumn("h", place)
    w = Window.partitionBy("pass").orderBy("h", "left_rec", "right_rec")
    kept = rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap)  # cut to a pass's first rows before the exchange
    sizes = rows.groupBy("pass").agg(F.count(F.lit(1)).alias("n"))
    share = kept.groupBy("pass").agg(F.max("h").alias("last")).join(sizes, "pass").select("pass", F.when(F.col("n") > cap, F.col("last")).otherwise(F.lit(1.0)).alias("share"))
    rates = rows.join(F.broadcast(share), "pass").groupBy("left_rec", "right_rec").agg(F.max("share").alias("rate"))  # a row for each pass
    return kept.join(rates, ["left_rec", "right_rec"]).select("left_rec", "right_rec", "pass", (1 / F.greatest("rate", F.lit(1e-12))).alias("weight"))


def level_counts(levels: DataFrame, comparisons: list[str], by: list[str] | None = None) -> DataFrame:
    """comparison, level and n over pairs (and by columns); a missing side doesn't count."""
    cells = F.array(*(F.struct(F.lit(c).alias("comparison"), F.col(c).cast("int").alias("level")) for c in comparisons))
    return levels.select(*(by or []), F.explode(cells).alias("x")).select(*(by or []), "x.*").where("level >= 0").groupBy(*(by or []), "comparison", "level").agg(F.count(F.lit(1)).alias("n"))


def estimate_u(levels: DataFrame, sizes: dict[str, int], u0: dict[str, float]) -> dict[str, tuple[float, ...]]:
    """Chances of each level among random pairs: level 0 from value frequencies, the rest with one added to each count, scaled to what level 0 leaves."""
    counts: dict[str, dict[int, int]] = {}
    for r in level_counts(levels, list(sizes)).collect():
        counts.setdefault(r.comparison, {})[r.level] = r.n
    out = {}
    for c, k in sizes.items():
        own = [counts.get(c, {}).get(j, 0) for j in range(k)]
        n = sum(own)
        first = u0.get(c) or (own[0] + 1) / (n + k)
        first = min(max(first, FLOOR), 1 - FLOOR * k)
        rest = [(x + 1) / (n + k - 1) for x in own[1:]]
        out[c] = (first, *(x * (1 - first) / sum(rest) for x in rest))
    return out


def m_from_identifier(levels: DataFrame, sizes: dict[str, int], strong: str, equal: str = "strong_equal") -> DataFrame:
    """comparison, level and m among pairs with equal valid identifiers, one added to each count; the identifier's own comparison is left out."""
    names = [c for c in sizes if c != strong]
    counted = level_counts(levels.where(equal), names)
    grid = levels.sparkSession.createDataFrame([(c, k, sizes[c]) for c in names for k in range(sizes[c])], "comparison string, level int, size int")
    all_ = counted.groupBy("comparison").agg(F.sum("n").alias("all"))
    full = grid.join(F.broadcast(counted), ["comparison", "level"], "left").join(F.broadcast(all_), "comparison", "left")  # a row for each level
    return full.select("comparison", "level", ((F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("all", F.lit(0)) + F.col("size"))).alias("m"))


def fixed_comparisons(passes: dict[str, list[str]], comparisons: dict[str, str]) -> dict[str, set[str]]:
    """For each pass the comparisons on attributes its keys read; passes have key expressions, comparisons their attribute."""
    from goldspan.operators.standardise import parse_key

    read = {p: {parse_key(k).form.split(".")[0] for k in keys} for p, keys in passes.items()}
    return {p: {c for c, a in comparisons.items() if a in attributes} for p, attributes in read.items()}


def posterior(levels: DataFrame, m: dict[str, tuple[float, ...]], u: dict[str, tuple[float, ...]], prior: float, fixed: set[str] = frozenset()) -> DataFrame:
    """levels with p, each pair's chance of being a match; missing sides and fixed comparisons say nothing."""
    weight = F.lit(math.log2(max(prior, FLOOR)) - math.log2(max(1 - prior, FLOOR)))
    for c in m:
        if c not in fixed:
            own = F.lit(0.0)
            for k, (a, b) in enumerate(zip(m[c], u[c])):
                own = F.when(F.col(c) == k, F.lit(math.log2(max(a, FLOOR)) - math.log2(max(min(b, 1 - FLOOR), FLOOR)))).otherwise(own)
            weight = weight + own
    return levels.withColumn("p", 1 / (1 + F.pow(F.lit(2.0), F.greatest(F.lit(-60.0), F.least(F.lit(60.0), -weight)))))


def union_expected(judged: DataFrame) -> float:
    """Expected matches over all passes' pairs (left_rec, right_rec, p, weight): a pair found by several counts once, with the mean of its chances."""
    per = judged.groupBy("left_rec", "right_rec").agg(F.avg("p").alias("p"), F.max("weight").alias("weight"))
    return per.agg(F.coalesce(F.sum(F.col("p") * F.col("weight")), F.lit(0.0)).alias("e")).first().e


def combine_passes(results: dict[str, tuple[dict[str, tuple[float, ...]], dict[str, float]]], fixed: dict[str, set[str]]) -> dict[str, tuple[float, ...]]:
    """Each comparison's m averaged over the passes that estimated it, by the matches it was seen in; results hold m and that mass for each pass."""
    out = {}
    for c in sorted({c for m, _ in results.values() for c in m}):
        told = [(np.array(m[c]), seen.get(c, 0.0)) for p, (m, seen) in sorted(results.items()) if c in m and c not in fixed.get(p, ()) and seen.get(c, 0.0) > 0]
        if told:
            mean = sum(v * w for v, w in told) / sum(w for _, w in told)
            out[c] = tuple(float(x) for x in mean / mean.sum())
    return out


def scale_to_population(expected: float, seeds: int, records: int) -> float:
    """A true pair is found when either end is a seed: with chance 2s - s² for a share s of seeds."""
    s = min(seeds / records, 1.0) if records > 0 else 0.0
    return expected / (2 * s - s * s) if s > 0 else 0.0


def global_prior(expected: float, records: int) -> float:
    pairs = records * (records - 1) / 2
    return min(max(expected / pairs, 1e-9), 0.5) if pairs > 0 else 1e-9


def estimate(passes: dict[str, DataFrame], random: DataFrame, sizes: dict[str, int], u0: dict[str, float], fixed: dict[str, set[str]], records: int, seeds: int | None = None, strong: str | None = None, enough: int = 200) -> dict:
    """New m, u and prior from the level patterns of each pass's pairs.

    passes have left_rec, right_rec, weight, strong_equal and a column for each
    comparison. With ``enough`` pairs of equal identifiers, m comes from them for
    all but the identifier's comparison; the rest, or all, comes from
    expectation-maximisation on the distinct patterns of each pass, with the
    comparisons its keys decide held fixed. A pass that doesn't converge raises.
    """
    names = list(sizes)
    u = estimate_u(random, sizes, u0)
    known: dict[str, tuple[float, ...]] = {}
    if strong is not None:
        same = None
        for df in passes.values():
            part = df.where("strong_equal").select("left_rec", "right_rec", "strong_equal", *names)
            same = part if same is None else same.unionByName(part)
        same = same.dropDuplicates(["left_rec", "right_rec"])
        if same.count() >= enough:
            for r in m_from_identifier(same, sizes, strong).orderBy("comparison", "level").collect():
                known[r.comparison] = (*known.get(r.comparison, ()), r.m)
    results, priors, judged = {}, {}, None
    for p, df in sorted(passes.items()):
        live = [c for c in names if c not in fixed.get(p, ())]
        counted = [(tuple(r[c] for c in live), r.n) for r in df.groupBy(*live).agg(F.count(F.lit(1)).alias("n")).collect()]  # distinct patterns
        if not counted or not live:
            continue
        held = {k: np.array(known[c]) for k, c in enumerate(live) if c in known}
        m, share, done = expectation_maximisation(counted, [sizes[c] for c in live], [np.array(u[c]) for c in live], rounds=500, fixed=held)
        if not done:
            raise ArithmeticError(f"the estimate of pass {p} didn't converge")
        own = {c: tuple(map(float, m[k])) for k, c in enumerate(live)}
        chances = posterior(df, own, u, share)
        mass = chances.agg(*(F.sum(F.when(F.col(c) >= 0, F.col("p"))).alias(c) for c in live)).first()
        results[p], priors[p] = (own, {c: mass[c] or 0.0 for c in live}), share
        part = chances.select("left_rec", "right_rec", "p", "weight")
        judged = part if judged is None else judged.unionByName(part)
    m = {c: M_DEFAULT[sizes[c]] for c in names} | combine_passes(results, fixed) | known
    expected = union_expected(judged) if judged is not None else 0.0
    return {"m": m, "u": u, "prior": global_prior(scale_to_population(expected, seeds or records, records), records), "expected": expected}
