"""Quality profile of every column, load by load, and the loads in which a column changes.

Values of each load shrink to distinct values with counts, and those to shapes
(runs of digits, capitals, small letters, and other characters as they are).
For each column of a source, regular expressions are induced from the shapes of
all its distinct values by minimum description length: of several degrees of
generality, the one that describes expressions and values in the fewest bits.
How far each load's rows spread over expressions, values, ranges, first and last
characters is compared with the source's other loads, by medians over arrays of
one entry for each load; no column of a source ever meets in one task.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldspan.runtime import Workspace

ATTRIBUTES = ("given_name", "birth_date", "email", "phone", "postcode", "country", "person_ref", "source_version", "occurred_at")
#: A share, net of chance, by which a load must depart to be named, and how far beyond the departures of the other loads.
DEPARTURE, BEYOND = 0.2, 3.0


def columns_of(loads: DataFrame) -> tuple[str, ...]:
    """Every column but the two that a profile goes by."""
    return tuple(c for c in loads.columns if c not in ("load_no", "source_system"))


def values_of(loads: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """load_no, source_system, attr_name, value (text, null kept) and bucket of every cell.

    A moment counts as the days before its load, a date by its decade, a whole
    number by sign, number of digits and first digit; other values have no bucket.
    """
    kinds = dict(loads.dtypes)
    cells = []
    for a in attributes:
        c, bucket = F.col(a), F.lit(None).cast("string")
        if kinds[a].startswith("timestamp"):
            day = F.floor((F.unix_micros("loaded_at") - F.unix_micros(a)) / 86_400_000_000)
            bucket = F.greatest(F.lit(-2), F.least(F.lit(15), day)).cast("string")
            value = F.unix_micros(a).cast("string")
        elif kinds[a] == "date" or a.endswith("_date"):
            value = c.cast("string")
            bucket = F.when(value.rlike(r"\d{4}"), F.substring(F.regexp_extract(value, r"(\d{4})", 1), 1, 3))
        elif kinds[a] in ("bigint", "int", "smallint", "tinyint"):
            value = c.cast("string")
            bucket = F.concat(F.when(c < 0, "-").otherwise("+"), F.length(F.abs(c).cast("string")).cast("string"), F.lit("."), F.substring(F.abs(c).cast("string"), 1, 1))
        else:
            value = c.cast("string")
        cells.append(F.struct(F.lit(a).alias("attr_name"), value.alias("value"), bucket.alias("bucket")))
    return loads.select("load_no", "source_system", F.explode_outer(F.array(*cells)).alias("c")).select("load_no", "source_system", "c.*")


def is_blank(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " ")) == ""


def shape_of(c: Column) -> Column:
    """A, a and 9 for capital, small letter and digit; the rest as it is. Letters without case count as small."""
    c = F.regexp_replace(c, r"\p{Lu}", "A")
    c = F.regexp_replace(c, r"[\p{L}\p{M}&&[^A]]", "a")
    return F.regexp_replace(c, r"\p{N}", "9")


def counted_values(cells: DataFrame) -> DataFrame:
    """Distinct values of each load and column, with how many rows carry them."""
    return cells.groupBy("load_no", "source_system", "attr_name", "value", "bucket").agg(F.count(F.lit(1)).alias("n"))


def profile(loads: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """rows, filled, distincts, least and largest value and the commonest value of each load and column.

    A blank value isn't filled. Of equally common values the smallest is named.
    A column without a filled value has distincts 0 and nulls elsewhere. Null
    loads and sources are loads and sources of their own.
    """
    counted = counted_values(values_of(loads, attributes))
    full = F.col("value").isNotNull() & ~is_blank(F.col("value"))
    per = counted.groupBy("load_no", "source_system", "attr_name").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(full, F.col("n"))), F.lit(0)).alias("filled"),
        F.sum(full.cast("bigint")).alias("distincts"),
        F.min(F.when(full, F.col("value"))).alias("least"),
        F.max(F.when(full, F.col("value"))).alias("largest"),
        F.min(F.when(full, F.struct((-F.col("n")).alias("n"), "value"))).alias("top"),
    )
    return per.select("load_no", "source_system", "attr_name", "n_rows", "filled", "distincts", "least", "largest", F.col("top.value").alias("top_value"), (-F.col("top.n")).alias("top_rows"))


# --- minimum description length -------------------------------------------------

_CLASS_BITS = {"A": math.log2(26), "a": math.log2(26), "9": math.log2(10), "x": math.log2(36), "w": math.log2(62)}


def runs(shape: str) -> tuple[tuple[str, int], ...]:
    """All runs of the whole shape."""
    return tuple((ch, len(list(same))) for ch, same in groupby(shape))


def generalise(parts: tuple[tuple[str, int], ...], degree: int) -> tuple[tuple[str, int], ...]:
    """0 exact lengths, 1 any lengths of letters and digits, 2 small letters and digits as one, 3 all letters and digits as one. Length 0 is any."""
    if degree == 0:
        return parts
    out: list[tuple[str, int]] = []
    for cls, length in parts:
        if cls in "Aa9":
            new = cls if degree == 1 else ("x" if cls in "a9" else "A") if degree == 2 else "w"
            if out and out[-1][0] == new:
                continue
            out.append((new, 0))
        else:
            out.append((cls, length))
    return tuple(out)


def expression(parts: tuple[tuple[str, int], ...]) -> str:
    """The regular expression of generalised runs."""
    names = {"A": r"\p{Lu}", "a": r"\p{Ll}", "9": r"\d", "x": r"[\p{Ll}\d]", "w": r"[\p{L}\d]"}
    out = []
    for cls, length in parts:
        text = names.get(cls, re.escape(cls))
        size = "" if length == 1 else "+" if length == 0 else f"{{{length}}}"
        out.append(text + size)
    return "^" + "".join(out) + "$"


def _bits(parts: tuple[tuple[str, int], ...], as_: tuple[tuple[str, int], ...]) -> float:
    """Bits that tell a value of the runs ``parts`` by the expression ``as_``."""
    letters = sum(n for c, n in parts if c in "Aa9")
    classes = [c for c, _ in as_ if c in _CLASS_BITS]
    if not letters or not classes:
        return 0.0
    if len(as_) == len(parts):
        return sum(_CLASS_BITS.get(a[0], 0.0) * p[1] + (2 * math.log2(p[1] + 1) if a[1] == 0 and a[0] in _CLASS_BITS else 0.0) for p, a in zip(parts, as_))
    widest = max(_CLASS_BITS[c] for c in classes)
    return widest * letters + 2 * math.log2(letters + 1) * len(classes)


def induce(shapes: dict[str, int]) -> dict[str, str]:
    """The expression of each shape: for shapes alike in the most general degree, the degree that takes the fewest bits.

    ``shapes`` has how many distinct values show each shape.
    """
    families: dict[tuple, list[tuple[str, tuple, int]]] = defaultdict(list)
    for shape, n in shapes.items():
        parts = runs(shape)
        families[generalise(parts, 3)].append((shape, parts, n))
    total = sum(shapes.values()) or 1
    out: dict[str, str] = {}
    for members in families.values():
        best: tuple[float, dict[str, str]] | None = None
        for degree in (1, 0, 2, 3):
            of = {shape: generalise(parts, degree) for shape, parts, _ in members}
            counts: dict[tuple, int] = defaultdict(int)
            for shape, _, n in members:
                counts[of[shape]] += n
            cost = sum(8.0 + 7.0 * len(e) + 3.0 * sum(1 for _, k in e if k > 1) for e in counts)
            cost += sum(n * math.log2(total / counts[of[shape]]) + n * _bits(parts, of[shape]) for shape, parts, n in members)
            if best is None or cost < best[0]:
                best = cost, {shape: expression(e) for shape, e in of.items()}
        out |= best[1]
    return out


_DEGREES = (1, 0, 2, 3)


def _toll(e: tuple[tuple[str, int], ...]) -> float:
    """Bits that an expression itself takes."""
    return 8.0 + 7.0 * len(e) + 3.0 * sum(1 for _, k in e if k > 1)


def induced(shapes: DataFrame, space: Workspace) -> DataFrame:
    """source_system, attr_name, shape and expression, as ``induce`` has them, of rows with n distinct values of each shape.

    Only sums by expression meet, never the shapes of a column, so their number needs no bound.
    """
    at = ["source_system", "attr_name"]

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for source, attr, shape, n in zip(*(c.to_pylist() for c in batch.columns)):
                parts = runs(shape)
                family = expression(generalise(parts, 3))
                for rank, degree in enumerate(_DEGREES):
                    e = generalise(parts, degree)
                    out.append((source, attr, shape, n, family, rank, expression(e), _toll(e), _bits(parts, e)))
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.float64())
            names = [*at, "shape", "n", "family", "rank", "expression", "toll", "bits"]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names)

    per = shapes.groupBy(*at, "shape").agg(F.sum("n").cast("bigint").alias("n"))
    offers = space.save(per.mapInArrow(offer, "source_system string, attr_name string, shape string, n bigint, family string, rank int, expression string, toll double, bits double"), "offers")
    total = offers.where("rank = 0").groupBy(*at).agg(F.sum("n").alias("total"))
    # Bits in millionths: sums of whole numbers don't depend on their order.
    by = offers.groupBy(*at, "family", "rank", "expression").agg(F.sum("n").alias("n"), F.max("toll").alias("toll"), F.sum(F.round(F.col("bits") * 1_000_000).cast("bigint") * F.col("n")).alias("bits"))
    cost = F.round((F.col("toll") + F.col("n") * F.log2(F.col("total") / F.col("n"))) * 1_000_000).cast("bigint") + F.col("bits")
    costs = by.join(F.broadcast(total), at).groupBy(*at, "family", "rank").agg(F.sum(cost).alias("cost"))
    best = costs.groupBy(*at, "family").agg(F.min(F.struct("cost", "rank")).alias("best")).select(*at, "family", F.col("best.rank").alias("rank"))
    return offers.join(best, [*at, "family", "rank"]).select(*at, "shape", "expression")


# --- comparison of loads ------------------------------------------------------------

def statistics(loads: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES, shapeless: tuple[str, ...] = ("occurred_at",)) -> DataFrame:
    """Counts by load and column of what is compared: rows, empty cells, distincts, expressions, values, buckets, first and last characters.

    Values are told apart where at least a hundredth of a load's rows carry
    them; the rest of the load counts together.
    """
    space = Workspace(loads.sparkSession, "loads")
    counted = space.save(counted_values(values_of(loads, attributes)), "values")
    at = ["load_no", "source_system", "attr_name"]
    full = F.col("value").isNotNull() & ~is_blank(F.col("value"))
    filled = counted.where(full)

    def part(df: DataFrame, feature: str, item: Column, n: Column) -> DataFrame:
        return df.groupBy(*at, item.alias("item")).agg(n.alias("n")).select(*at, F.lit(feature).alias("feature"), "item", "n")

    # All that needs no other table is counted by one pass over the distinct values.
    told = F.lit(True) if not shapeless else ~F.col("attr_name").isin(*shapeless)
    each = lambda feature, item, n: F.struct(F.lit(feature).alias("feature"), item.alias("item"), n.alias("n"))
    edge = lambda feature, at_: F.when(full & told, each(feature, F.upper(F.substring("value", at_, 1)), F.col("n")))
    features = F.array_compact(F.array(
        each("rows", F.lit(""), F.col("n")), each("empty", F.lit(""), F.when(full, F.lit(0).cast("bigint")).otherwise(F.col("n"))),
        F.when(full & F.col("bucket").isNotNull(), each("bucket", F.col("bucket"), F.col("n"))), edge("begin", 1), edge("end", -1),
    ))
    simple = counted.select(*at, F.explode_outer(features).alias("f")).groupBy(*at, "f.feature", "f.item").agg(F.sum("f.n").alias("n"))
    simple = space.save(simple.select(*at, "feature", "item", "n"), "simple")
    rows = simple.where("feature = 'rows'")
    distinct = part(filled, "distinct", F.lit(""), F.count_distinct("value"))
    shaped = filled.where(~F.col("attr_name").isin(*shapeless) & F.col("load_no").isNotNull() & F.col("source_system").isNotNull()).withColumn("shape", shape_of(F.col("value")))
    shaped = space.save(shaped.groupBy(*at, "shape").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("values")), "shapes")
    of = induced(shaped.select("source_system", "attr_name", "shape", F.col("values").alias("n")), space)
    shapes = part(shaped.join(of, ["source_system", "attr_name", "shape"]), "shape", F.col("expression"), F.sum("n"))
    size = rows.select(*at, F.col("n").alias("all"))
    common = filled.join(size, at).where("n * 100 >= all")
    values = part(common, "value", F.col("value"), F.sum("n"))
    return simple.unionAll(distinct).unionAll(shapes).unionAll(values)


def _rest(entries: Column, zeros: Column, own: Column, at: Column) -> Column:
    """The ``at``-th smallest of all loads' numbers but the one at place ``own``: as many zeros as loads without an entry come first, then the sorted entries."""
    place = at + (at >= own).cast("int")
    return F.when(place < zeros, F.lit(0.0)).otherwise(F.get(entries, (place - zeros).cast("int"))["x"])


def _quantile(entries: Column, zeros: Column, own: Column, loads_: Column, q: float) -> Column:
    """The q-quantile of all loads but one, between the two nearest; null where there is no other load."""
    last = (loads_ - 2).cast("double")
    low = F.floor(last * q).cast("int")
    share = last * q - low
    high = F.least(low + 1, (loads_ - 2).cast("int"))
    return F.when(loads_ > 1, _rest(entries, zeros, own, low) * (1 - share) + _rest(entries, zeros, own, high) * share)


COLUMN = ["source_system", "attr_name"]


def departures(loads: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """load_no, source_system, attr_name, feature, departure and usual.

    ``departure`` is the share of a load's rows by which the feature differs from
    the source's other loads, net of chance: half the sum, over all items, of how
    far the load's share of the item is from the median of the others. ``usual`` is
    the third quartile of the other loads' departures. An item's numbers form an
    array with one entry for each load that shows it, and sums over items are
    aggregates. A source with a single load departs from nothing.
    """
    space = Workspace(loads.sparkSession, "departures")
    stats = space.save(statistics(loads, attributes).where("load_no is not null and source_system is not null"), "statistics")
    one = lambda f: stats.where(F.col("feature") == f).groupBy(*COLUMN, "load_no").agg(F.sum("n").alias(f))
    sizes = one("rows").join(one("empty"), [*COLUMN, "load_no"], "left").withColumn("filled", F.col("rows") - F.coalesce("empty", F.lit(0)))
    sizes = space.save(sizes, "sizes")  # a row for each load and column
    number = sizes.groupBy(*COLUMN).agg(F.count(F.lit(1)).cast("int").alias("loads"))

    def against(items: DataFrame, keys: list[str]) -> DataFrame:
        """Each entry x of a load beside the median of the other loads' (u), and what a load without an entry would have (u0)."""
        per = items.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x", "load_no"))).alias("s")).join(F.broadcast(number), COLUMN)  # a row for each column
        zeros = F.col("loads") - F.size("s")
        absent = F.when(zeros > 0, _quantile(F.col("s"), zeros, F.lit(0), F.col("loads"), 0.5)).otherwise(F.lit(0.0))
        mine = F.transform("s", lambda e, i: F.struct(e["load_no"].alias("load_no"), e["x"].alias("x"), F.coalesce(_quantile(F.col("s"), zeros, zeros + i, F.col("loads"), 0.5), e["x"]).alias("u")))
        return per.select(*keys, F.coalesce(absent, F.lit(0.0)).alias("u0"), F.explode(mine).alias("e")).select(*keys, "u0", "e.*")

    # Shares of items, and of what no item tells.
    spread = stats.where(F.col("feature").isin("shape", "value", "bucket", "begin", "end")).groupBy(*COLUMN, "feature", "item", "load_no").agg(F.sum("n").alias("n"))
    shares = spread.join(sizes.select(*COLUMN, "load_no", "filled"), [*COLUMN, "load_no"]).withColumn("x", F.col("n") / F.greatest("filled", F.lit(1)))
    shares = space.save(shares.select(*COLUMN, "feature", "item", "load_no", "x"), "shares")
    told = shares.groupBy(*COLUMN, "feature", "load_no").agg(F.sum("x").alias("told"))
    every = sizes.select(*COLUMN, "load_no").join(shares.select(*COLUMN, "feature").distinct(), COLUMN)
    rest = every.join(told, [*COLUMN, "feature", "load_no"], "left").withColumn("x", F.greatest(F.lit(0.0), 1 - F.coalesce("told", F.lit(0.0)))).drop("told")
    beside = against(shares.unionByName(rest.withColumn("item", F.lit(None).cast("string"))), [*COLUMN, "feature", "item"])
    wave = lambda u: F.sqrt(F.greatest(F.lit(0.0), u * (1 - u)))
    beside = space.save(beside.select("*", F.abs(F.col("x") - F.col("u")).alias("off"), wave(F.col("u")).alias("w"), wave(F.col("u0")).alias("w0")), "beside")
    base = beside.groupBy(*COLUMN, "feature", "item").agg(F.max("u0").alias("u0"), F.max("w0").alias("w0")).groupBy(*COLUMN, "feature").agg(F.sum("u0").alias("u0"), F.sum("w0").alias("w0"))
    own = beside.groupBy(*COLUMN, "feature", "load_no").agg(F.sum(F.col("off") - F.col("u0")).alias("off"), F.sum(F.col("w") - F.col("w0")).alias("w"))
    whole = own.join(base, [*COLUMN, "feature"]).join(sizes, [*COLUMN, "load_no"])
    chance = 0.5 * F.sqrt(2 / (math.pi * F.greatest("filled", F.lit(1)))) * (F.col("w") + F.col("w0"))
    weight = F.col("filled") / F.col("rows")  # a change in few filled cells is no change of a large share of the column
    by_items = whole.select(*COLUMN, "feature", "load_no", (F.greatest(F.lit(0.0), 0.5 * (F.col("off") + F.col("u0")) - chance) * weight).alias("departure"))

    # Shares of empty cells, and distinct values to filled cells.
    distinct = sizes.join(one("distinct"), [*COLUMN, "load_no"], "left").where("filled > 0").select(*COLUMN, F.lit("distinct").alias("feature"), "load_no", (F.coalesce("distinct", F.lit(0)) / F.col("filled")).alias("x"))
    empty = sizes.select(*COLUMN, F.lit("empty").alias("feature"), "load_no", (F.coalesce("empty", F.lit(0)) / F.col("rows")).alias("x"))
    plain = empty.unionAll(distinct).groupBy(*COLUMN, "feature").agg(F.array_sort(F.collect_list(F.struct("x", "load_no"))).alias("s"))
    alone = F.transform("s", lambda e, i: F.struct(e["load_no"].alias("load_no"), F.abs(e["x"] - F.coalesce(_quantile(F.col("s"), F.lit(0), i, F.size("s"), 0.5), e["x"])).alias("departure")))
    by_share = plain.select(*COLUMN, "feature", F.explode(alone).alias("e")).select(*COLUMN, "feature", "e.*")

    all_ = by_items.unionByName(by_share).groupBy(*COLUMN, "feature").agg(F.array_sort(F.collect_list(F.struct(F.col("departure").alias("x"), "load_no"))).alias("s"))
    usual = F.transform("s", lambda e, i: F.struct(e["load_no"].cast("int").alias("load_no"), e["x"].alias("departure"), F.coalesce(_quantile(F.col("s"), F.lit(0), i, F.size("s"), 0.75), F.lit(0.0)).alias("usual")))
    return all_.select(*COLUMN, "feature", F.explode(usual).alias("e")).select("e.load_no", *COLUMN, "feature", "e.departure", "e.usual")


def changed(loads: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES, departure: float = DEPARTURE, beyond: float = BEYOND) -> DataFrame:
    """load_no and attr_name where a large share of the values departs from the source's other loads; empty for no loads."""
    return explained(loads, attributes, departure, beyond).select("load_no", "attr_name").distinct()


def explained(loads: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES, departure: float = DEPARTURE, beyond: float = BEYOND) -> DataFrame:
    """load_no, source_system, attr_name and the features, with their departures, that tell each change."""
    found = departures(loads, attributes).where((F.col("departure") > departure) & (F.col("departure") > beyond * F.col("usual")))
    return found.groupBy("load_no", *COLUMN).agg(F.array_sort(F.collect_list(F.struct("feature", F.round("departure", 6).alias("departure")))).alias("features"))


def expressions(loads: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """load_no, source_system, attr_name, expression, n_rows and nonconforming (the filled rows outside the source's main expressions).

    The main expressions of a column are the commonest ones that together cover
    nine tenths of the source's filled rows.
    """
    stats = statistics(loads, attributes, ()).where("feature = 'shape' and load_no is not null and source_system is not null")

    per = stats.groupBy("load_no", *COLUMN, F.col("item").alias("expression")).agg(F.sum("n").alias("n_rows"))
    sums = per.groupBy(*COLUMN, "expression").agg(F.sum("n_rows").alias("n"))
    order = Window.partitionBy(*COLUMN).orderBy(F.desc("n"), "expression")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    main = sums.select(*COLUMN, "expression", (before < 0.9 * F.sum("n").over(Window.partitionBy(*COLUMN))).alias("main"))
    out = per.join(main, [*COLUMN, "expression"])
    return out.select("load_no", *COLUMN, "expression", "n_rows", F.when(F.col("main"), F.lit(0)).otherwise(F.col("n_rows")).cast("bigint").alias("nonconforming"))
