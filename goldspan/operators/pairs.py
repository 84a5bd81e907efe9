"""Candidate pairs of records: blocking keys, candidates, weights, bands, hard rules, counterfactuals, estimates."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Chances of each level among matches and among others, by number of levels.
M_DEFAULT = {2: (0.9, 0.1), 3: (0.85, 0.10, 0.05), 4: (0.80, 0.10, 0.06, 0.04)}
U_DEFAULT = {2: (0.01, 0.99), 3: (0.01, 0.04, 0.95), 4: (0.01, 0.03, 0.06, 0.90)}
STOP_KEY, CANDIDATES = 1_000, 200


# --- blocking -----------------------------------------------------------------------


def blocking_keys(records: DataFrame, rec: str, passes: dict[str, list[Column]]) -> DataFrame:
    """rec, pass and key: a pass's parts joined by |, in lower case; a record with a missing part has no key in that pass."""
    made = []
    for name, parts in passes.items():
        whole = F.lit(True)
        for p in parts:
            whole = whole & p.isNotNull() & (p.cast("string") != "")
        made.append(F.struct(F.lit(name).alias("pass"), F.when(whole, F.lower(F.concat_ws("|", *parts))).alias("key")))
    return records.select(rec, F.explode(F.array(*made)).alias("k")).select(rec, "k.pass", "k.key").where("key is not null").distinct()


def block_sizes(keys: DataFrame) -> DataFrame:
    return keys.groupBy("pass", "key").agg(F.count(F.lit(1)).alias("n"))


def stop_keys(keys: DataFrame, limit: int = STOP_KEY) -> DataFrame:
    return block_sizes(keys).where(F.col("n") > limit)


def candidate_pairs(keys: DataFrame, rec: str, limit: int = STOP_KEY) -> DataFrame:
    """left_rec < right_rec and how many passes they share; keys held by more than ``limit`` records make no pairs."""
    kept = keys.join(block_sizes(keys).where((F.col("n") <= limit) & (F.col("n") > 1)).select("pass", "key"), ["pass", "key"], "left_semi")
    a, b = kept.select("pass", "key", F.col(rec).alias("left_rec")), kept.select("pass", "key", F.col(rec).alias("right_rec"))
    return a.join(b, ["pass", "key"]).where("left_rec < right_rec").groupBy("left_rec", "right_rec").agg(F.count_distinct("pass").alias("passes"))


def dropped_candidates(pairs: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """rec and how many of its candidates lie beyond its first k."""
    both = pairs.select(F.col("left_rec").alias("rec")).unionAll(pairs.select(F.col("right_rec").alias("rec")))
    return both.groupBy("rec").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k).select("rec", (F.col("n") - k).alias("dropped"))


def top_candidates(pairs: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """Pairs that either end keeps among its k with the most shared passes, then the smaller other record."""
    both = pairs.select(F.col("left_rec").alias("me"), F.col("right_rec").alias("other"), "passes").unionAll(
        pairs.select(F.col("right_rec").alias("me"), F.col("left_rec").alias("other"), "passes")
    )
    w = Window.partitionBy("me").orderBy(F.desc("passes"), "other")
    kept = both.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    return kept.select(F.least("me", "other").alias("left_rec"), F.greatest("me", "other").alias("right_rec"), "passes").distinct()


# --- scoring ------------------------------------------------------------------------


@dataclass(frozen=True)
class Rules:
    """Comparisons by name with their weights by level, the prior and the bands' edges."""

    weights: dict[str, tuple[float, ...]]
    prior: float
    auto: float = 90.0
    review: float = 60.0

    @staticmethod
    def of(m: dict[str, tuple[float, ...]], u: dict[str, tuple[float, ...]], prior: float, auto: float = 90.0, review: float = 60.0) -> Rules:
        clip = lambda p: min(1 - 1e-9, max(1e-9, p))
        return Rules({c: tuple(math.log2(clip(a) / clip(b)) for a, b in zip(m[c], u[c])) for c in m}, math.log2(prior / (1 - prior)), auto, review)

    @staticmethod
    def defaults(levels: dict[str, int], prior: float) -> Rules:
        return Rules.of({c: M_DEFAULT[n] for c, n in levels.items()}, {c: U_DEFAULT[n] for c, n in levels.items()}, prior)

    def edge(self, score: float) -> float:
        return math.log2(score / (100 - score))

    def part(self, comparison: str, level: Column) -> Column:
        out = F.lit(0.0)
        for k, w in reversed(list(enumerate(self.weights[comparison]))):
            out = F.when(level == k, F.lit(w)).otherwise(out)
        return out

    def weight(self) -> Column:
        """The prior and the comparisons' weights in rule order; a missing side adds nothing. Levels are in columns of the comparisons' names."""
        out = F.lit(self.prior)
        for c in self.weights:
            out = out + self.part(c, F.col(c))
        return out

    def band(self, weight: Column) -> Column:
        return F.when(weight >= self.edge(self.auto), "auto").when(weight >= self.edge(self.review), "review").otherwise("none")


def probability(weight: Column) -> Column:
    return F.when(weight < -60, 100 * F.pow(F.lit(2.0), weight)).otherwise(100 / (1 + F.pow(F.lit(2.0), -weight)))


def hard_rule(left: Column, right: Column) -> Column:
    """must_link or cannot_link by the valid identifiers of one scheme on both sides (arrays), else null."""
    told = (F.size(F.coalesce(left, F.array())) > 0) & (F.size(F.coalesce(right, F.array())) > 0)
    return F.when(told & ~F.arrays_overlap(left, right), "cannot_link").when(told, "must_link")


def hard_rules(sides: dict[str, tuple[Column, Column]], must: tuple[str, ...], cannot: tuple[str, ...]) -> Column:
    """cannot_link:scheme of the first scheme with valid identifiers on both sides and none in common, else must_link:scheme of the first with one in common, else null."""
    out = F.lit(None).cast("string")
    fired = {s: hard_rule(*pair) for s, pair in sides.items()}
    for kind, schemes in (("must_link", must), ("cannot_link", cannot)):  # what is tried last stands first
        for s in reversed(schemes):
            out = F.when(fired[s] == kind, F.lit(f"{kind}:{s}")).otherwise(out)
    return out


def signature(rules: Rules) -> Column:
    """name= for equality, name≈ for likeness, name≠ for difference, name∅ for a missing side, in rule order."""
    parts = []
    for c, weights in rules.weights.items():
        sign = F.when(F.col(c) < 0, "∅").when(F.col(c) == 0, "=").when(F.col(c) == len(weights) - 1, "≠").otherwise("≈")
        parts.append(F.concat(F.lit(c), sign))
    return F.concat_ws(" · ", *parts)


def band_under(rule: Column, band: Column) -> Column:
    """The band as a hard rule has it: cannot_link gives none, must_link auto."""
    return F.when(rule.startswith("cannot_link"), "none").when(rule.startswith("must_link"), "auto").otherwise(band)


def counterfactuals(rules: Rules, up: bool, hard: dict[str, tuple[str, ...]] | None = None, rule: Column | None = None) -> Column:
    """The change of one comparison's level that moves the band up or down with the least change of weight: struct of comparison and level, or null.

    ``hard`` names the hard rules of comparisons on identifiers: moved to its last
    level a comparison with cannot_link gives the band none, moved to level 0 one
    with must_link gives auto. A pair that a hard rule decides has none. Ties go
    to the earlier comparison, then the earlier level.
    """
    weight = rules.weight()
    rank = lambda w: F.when(w >= rules.edge(rules.auto), 2).when(w >= rules.edge(rules.review), 1).otherwise(0)
    options = []
    for i, (c, weights) in enumerate(rules.weights.items()):
        own = rules.part(c, F.col(c))
        kinds = (hard or {}).get(c, ())
        for level, w in enumerate(weights):
            moved = rank(weight - own + F.lit(w))
            if "cannot_link" in kinds and level == len(weights) - 1:
                moved = F.lit(0)
            elif "must_link" in kinds and level == 0:
                moved = F.lit(2)
            better = moved > rank(weight) if up else moved < rank(weight)
            far = F.abs(F.lit(w) - own)
            options.append(F.when((F.col(c) != level) & better, F.struct(F.round(far, 9).alias("far"), F.lit(i).alias("i"), F.lit(level).alias("level"), F.lit(c).alias("comparison"))))
    best = F.array_min(F.array_compact(F.array(*options)))
    free = F.lit(True) if rule is None else rule.isNull()
    return F.when(best.isNotNull() & free, F.concat_ws(":", best["comparison"], best["level"].cast("string")))


def explain(pairs: DataFrame, rules: Rules, hard: dict[str, tuple[str, ...]] | None = None, rule: str | None = None) -> DataFrame:
    """pairs with prior, contributions (comparison, level, weight), weight, score, band, signature, raise_by and lower_by.

    prior and contributions add up to weight. ``rule`` names the column of the hard rule that decides a pair, if any.
    """
    weight = rules.weight()
    decided = F.col(rule) if rule else F.lit(None).cast("string")
    parts = F.array(*(F.struct(F.lit(c).alias("comparison"), F.col(c).cast("int").alias("level"), rules.part(c, F.col(c)).alias("weight")) for c in rules.weights))
    return pairs.select(
        "*", F.lit(rules.prior).alias("prior"), parts.alias("contributions"), weight.alias("weight"), probability(weight).alias("score"), band_under(decided, rules.band(weight)).alias("band"),
        signature(rules).alias("signature"), counterfactuals(rules, True, hard, decided).alias("raise_by"), counterfactuals(rules, False, hard, decided).alias("lower_by"),
    )


def probe_candidates(probe: DataFrame, records: DataFrame, rec: str, most: int = 100) -> DataFrame:
    """rec of the stored records that share a pass and key with the probe (pass, key), with how many passes, the ``most`` with the most first: read only, the keys drive the scan."""
    keys = probe.select("pass", "key").where("key is not null").distinct()
    met = records.join(F.broadcast(keys), ["pass", "key"])  # a payload has one key for each pass
    return met.groupBy(rec).agg(F.count_distinct("pass").alias("passes")).orderBy(F.desc("passes"), rec).limit(most)


# --- estimates ------------------------------------------------------------------------


def level_shares(levels: DataFrame, comparisons: list[str]) -> DataFrame:
    """comparison, level and n over pairs; missing sides don't count."""
    cells = F.array(*(F.struct(F.lit(c).alias("comparison"), F.col(c).cast("int").alias("level")) for c in comparisons))
    return levels.select(F.explode(cells).alias("x")).select("x.*").where("level >= 0").groupBy("comparison", "level").agg(F.count(F.lit(1)).alias("n"))


def patterns(levels: DataFrame, comparisons: list[str]) -> DataFrame:
    """Distinct combinations of levels with counts."""
    return levels.groupBy(*comparisons).agg(F.count(F.lit(1)).alias("n"))


def expectation_maximisation(counts: list[tuple[tuple[int, ...], int]], sizes: list[int], u: list[np.ndarray], start: float = 0.1, rounds: int = 50, fixed: dict[int, np.ndarray] | None = None) -> tuple[list[np.ndarray], float, bool]:
    """m of each comparison, the share of matches, and whether it converged; ``counts`` are distinct patterns, -1 a missing side.

    The patterns of a few comparisons are some thousands at most, whatever the number of pairs.
    """
    fixed = fixed or {}
    m = [np.array(fixed.get(k, M_DEFAULT[n]), float) for k, n in enumerate(sizes)]
    lam = start
    pats, n = np.array([c[0] for c in counts]), np.array([c[1] for c in counts], float)
    for _ in range(rounds):
        w = np.full(len(n), math.log2(lam / (1 - lam)))
        for k in range(len(sizes)):
            told = pats[:, k] >= 0
            w[told] += np.log2(np.clip(m[k], 1e-9, 1)[pats[told, k]] / np.clip(u[k], 1e-9, 1)[pats[told, k]])
        g = 1 / (1 + np.exp2(-np.clip(w, -60, 60)))
        lam2 = float((g * n).sum() / n.sum())
        moved = abs(lam2 - lam)
        change = 0.0
        for k, size in enumerate(sizes):
            if k in fixed:
                continue
            told = pats[:, k] >= 0
            mass = np.bincount(pats[told, k], weights=(g * n)[told], minlength=size) + 1e-3
            new = mass / mass.sum()
            change = max(change, float(np.abs(new - m[k]).max()))
            m[k] = new
        lam = min(1 - 1e-9, max(1e-9, lam2))
        if change < 1e-5 and moved < 1e-6:
            return m, lam, True
    return m, lam, False
