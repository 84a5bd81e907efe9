"""Records of several sources that describe one person or firm, without a key they share.

Sorted neighbourhood: every record gets several composite sort keys; the records
are sorted by each, and a window slides over the order, so only neighbours are
compared and a key that a third of all records carry costs no more than any
other. Compared fields give levels of agreement, the levels a confidence. Within
a source, confident links join copies of one record; between two sources each
record is assigned to one record at most, so that the total confidence is largest.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldspan.llm import levels, traits
from goldspan.llm.addresses import expand
from goldspan.llm.components import contract
from goldspan.runtime import Workspace, spread

WINDOW = 10
#: Links of at least this confidence are kept.
LINK = 0.5
#: Edges of a graph of links that one task may hold, when the rest of a contraction is finished in it.
FEW = 200_000


def _person_keys(t: dict) -> list[str]:
    born, given, family = t["born"], t["given"].replace(" ", ""), t["family"].replace(" ", "")
    day = born[:4] + "".join(sorted((born[4:6], born[6:]))) if len(born) == 8 else ""
    out = []
    if family and given:
        out.append(f"n|{family}|{given}|{born}")
        out.append(f"w|{'|'.join(sorted((family, given)))}|{born}")
    if day and (family or given):
        out.append(f"b|{day}|{family[:4]}|{given}")
        out.append(f"g|{given[:3]}|{day}|{family}")
        out.append(f"m|{day[4:]}|{family}|{given}|{day}")
    if t["email"]:
        out.append(f"e|{t['email']}")
    if t["phone"]:
        out.append(f"p|{t['phone']}|{given}|{family}")
    if t["ident"]:
        out.append(f"i|{t['ident']}|{family}")
    for house in t["houses"]:
        _, kind, street = house.split("|")
        out.append(f"h|{street}|{kind}|{house}|{t['town'][:4]}|{given}|{family}")
    for code in t["codes"]:
        out.append(f"c|{code}|{given}|{family}|{born}")
        out.append(f"f|{code}|{family}|{born}|{given}")
    return out


def _firm_keys(t: dict) -> list[str]:
    words = sorted(t["family"].split())
    name, out = " ".join(words), []
    if words:
        out.append(f"n|{name}|{t['town']}")
        out.append(f"l|{max(words, key=len)}|{t['town']}|{name}")
        out.append(f"s|{words[-1]}|{t['town']}|{name}")
    if t["email"]:
        out.append(f"e|{t['email']}|{name}")
    if t["phone"]:
        out.append(f"p|{t['phone']}|{name}")
    if t["ident"]:
        out.append(f"i|{t['ident']}|{name}")
    for house in t["houses"]:
        _, kind, street = house.split("|")
        out.append(f"h|{street}|{kind}|{house}|{t['town'][:4]}|{name}")
    for code in t["codes"]:
        out.append(f"c|{code}|{name}")
    return out


@dataclass(frozen=True)
class Kind:
    """How one kind of entity is read, sorted, compared and weighed."""

    entity: str
    columns: tuple[str, ...]
    read: Callable[[dict], dict]
    keys: Callable[[dict], list[str]]
    #: Levels of agreement of many pairs of records at once.
    compare: Callable[[levels.Records, np.ndarray, np.ndarray], list[np.ndarray]]
    #: Weight of each level of each field before any evidence, in nats.
    weights: dict[str, dict[int, float]]
    bias: float
    #: Pairs whose weight before any evidence is less, and whose identifiers label nothing, aren't carried on; once the weights are fitted it is proved that none of them could have become a link.
    hopeless: float


PERSON = Kind(
    "person",
    ("given_name", "family_name", "birth_date", "email", "phone", "postcode", "city", "person_ref", "addresses", "employer"),
    traits.person, _person_keys, levels.Records.persons,
    {
        "given": {0: 0, 1: 2, 2: 1.2, 3: 1, 4: -1.5, 5: -5},
        "family": {0: 0, 1: 2.5, 2: 1, 3: 1.5, 4: -1, 5: -4},
        "born": {0: 0, 1: 4, 2: 2.5, 3: 1.5, 4: -0.5, 5: -3, 6: -5},
        "email": {0: 0, 1: 5, 2: 3, 3: 2, 4: -1.5},
        "phone": {0: 0, 1: 2, 2: 1, 3: -1},
        "place": {0: 0, 1: 2, 2: 0.5, 3: 0, 4: -1},
        "work": {0: 0, 1: 1, 2: -0.3},
    },
    -6.0, -14.0,
)
FIRM = Kind(
    "organisation",
    ("name", "registered_id", "phone", "email", "website", "postcode", "city", "addresses", "parent"),
    traits.firm, _firm_keys, levels.Records.firms,
    {
        "family": {0: 0, 1: 2.5, 2: 1.5, 3: 1.5, 4: -2.5, 5: -5},
        "email": {0: 0, 1: 3, 2: 1, 4: -3},
        "phone": {0: 0, 1: 3, 2: 2, 3: -1.5},
        "place": {0: 0, 1: 3, 2: 0, 3: -0.5, 4: -2},
    },
    -4.0, -7.0,
)
#: Weight of identifiers; their agreement labels the pairs that the other weights are fitted on, so it isn't fitted itself.
IDENT = {0: 0.0, 1: 9.0, 2: 4.0, 3: -0.5, 4: -7.0}

FIELDS = ("given", "family", "born", "email", "phone", "ident", "houses", "codes", "town", "employer")
#: Besides the traits, bits of the houses' numbers and of the codes that tell at once when two records share none.
TRAITS = "given string, family string, born string, email string, phone string, ident string, houses array<string>, codes array<string>, town string, employer string, spots bigint, areas bigint"
_TYPES = [pa.list_(pa.string()) if f in ("houses", "codes") else pa.string() for f in FIELDS]
NAMES = (*FIELDS, "spots", "areas")


def _read(records: DataFrame, kind: Kind) -> DataFrame:
    """rec, system, the traits and sort keys of every record with both parts of its key; of rows of one record the smallest counts."""
    rows = spread(records.where("source_system is not null and source_key is not null").select("source_system", "source_key", *kind.columns))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            recs, systems, told = [], [], []
            for r in batch.to_pylist():
                recs.append(f"{r['source_system']}:{r['source_key']}")
                systems.append(r["source_system"])
                told.append(kind.read(r))
            columns = [pa.array(recs, pa.string()), pa.array(systems, pa.string())]
            columns += [pa.array([t[f] for t in told], ty) for f, ty in zip(FIELDS, _TYPES)]
            columns.append(pa.array([levels.bloom([h.rpartition("|")[0] for h in t["houses"]]) for t in told], pa.int64()))
            columns.append(pa.array([levels.bloom(t["codes"]) for t in told], pa.int64()))
            columns.append(pa.array([kind.keys(t) for t in told], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(columns, ["rec", "system", *NAMES, "keys"])

    told = rows.mapInArrow(read, f"rec string, system string, {TRAITS}, keys array<string>")
    return told.groupBy("rec").agg(F.min(F.struct("system", *NAMES, "keys")).alias("r")).select("rec", "r.*")


def neighbours(
    keyed: DataFrame, space: Workspace, window: int = WINDOW, compare: Callable[[levels.Records, np.ndarray, np.ndarray], list[np.ndarray]] | None = None,
    keep: Callable[[list[np.ndarray]], np.ndarray] | None = None,
) -> DataFrame:
    """a, b of all rows of ``keyed`` (id, pass, key) less than ``window`` apart in the order of a pass.

    With ``compare``, keyed has the traits as well, and every pair its levels:
    pairs are compared where the window meets them, so traits travel once for
    each key and not once for each pair. ``keep`` may leave out pairs by their levels.

    The order is cut into ranges that are windowed apart from each other; pairs
    that reach over a cut come from the ends of the ranges, by their place in the
    whole order, so no pair of the window is lost however small a range is.
    """
    spark = keyed.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    told = NAMES if compare else ()
    order = keyed.repartitionByRange(width, "pass", "key", "id").sortWithinPartitions("pass", "key", "id").select("id", "pass", *told)
    out = pa.schema([("what", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("levels", pa.int32()), ("part", pa.int32()), ("pos", pa.int64()), ("pass", pa.string())])

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, headed = TaskContext.get().partitionId(), 0, 0
        held: pa.Table | None = None

        def rows(what: int, a, b=None, level=None, pos=None, ps=None) -> pa.RecordBatch:
            k = len(a)
            told = (np.full(k, what, np.int32), a, b, level, np.full(k, part, np.int32), pos, ps)
            return pa.RecordBatch.from_arrays([pa.nulls(k, f.type) if x is None else pa.array(x, f.type) for x, f in zip(told, out)], schema=out)

        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            old = 0 if held is None else held.num_rows
            held = new if held is None else pa.concat_tables([held, new]).combine_chunks()
            ids = held.column(0).to_numpy()
            passes = held.column(1).combine_chunks().dictionary_encode()
            code = passes.indices.to_numpy(zero_copy_only=False)
            names = np.array(passes.dictionary.to_pylist(), dtype=object)
            if headed < window - 1:
                k = min(window - 1 - headed, new.num_rows)
                head = slice(old, old + k)
                yield rows(1, ids[head], pos=np.arange(headed, headed + k), ps=list(names[code[head]]))
                headed += k
            first = np.concatenate([np.arange(max(old - d, 0), max(len(ids) - d, 0)) for d in range(1, window)])  # the later row of each pair is new
            far = np.concatenate([np.full(max(max(len(ids) - d, 0) - max(old - d, 0), 0), d) for d in range(1, window)]).astype(np.int64)
            fits = (code[first] == code[first + far]) & (ids[first] != ids[first + far])
            x, y = first[fits], (first + far)[fits]
            if len(x):
                i, j = np.where(ids[x] < ids[y], x, y), np.where(ids[x] < ids[y], y, x)
                level = compare(levels.Records(held), i, j) if compare else [np.zeros(len(i), np.int32)]
                if keep:
                    kept = np.flatnonzero(keep(level))
                    i, j, level = i[kept], j[kept], [x[kept] for x in level]
                yield rows(0, ids[i], ids[j], levels.packed(level))
            n += new.num_rows
            held = held.slice(max(held.num_rows - window + 1, 0))
        if n:
            ids, passes = held.column(0).to_numpy(), held.column(1).to_pylist()
            tail = [k for k in range(len(ids)) if n - len(ids) + k >= headed]
            if tail:
                yield rows(1, ids[tail], pos=[n - len(ids) + k for k in tail], ps=[passes[k] for k in tail])
            yield rows(2, [0], pos=[n])

    found = space.save(order.mapInArrow(slide, "what int, a bigint, b bigint, levels int, part int, pos bigint, pass string"), "windows")
    sizes = {r.part: r.pos for r in found.where("what = 2").select("part", "pos").collect()}  # a row for each range
    offsets, total = [], 0
    for part in sorted(sizes):
        offsets.append((part, total))
        total += sizes[part]
    at = spark.createDataFrame(offsets, "part int, first bigint")
    ends = found.where("what = 1").join(F.broadcast(at), "part").select(F.col("a").alias("id"), "pass", "part", (F.col("first") + F.col("pos")).alias("place"))
    later = ends.select(F.col("id").alias("id2"), F.col("pass").alias("pass2"), F.col("part").alias("part2"), F.col("place").alias("place2"))
    reach = ends.withColumn("place2", F.explode(F.sequence(F.col("place") + 1, F.col("place") + window - 1)))
    over = reach.join(later, "place2").where("part <> part2 and pass = pass2 and id <> id2")
    over = space.save(over.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct(), "over")
    inside = found.where("what = 0")
    if compare is None:
        return inside.select("a", "b").unionAll(over).distinct()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.num_rows
            sides = [pa.table({n: batch.column(at).field(m) for m, n in enumerate(NAMES)}) for at in (2, 3)]
            both = pa.concat_tables(sides).combine_chunks()
            level = levels.packed(compare(levels.Records(both), np.arange(k), np.arange(k, 2 * k))) if k else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(level, pa.int32())], ["a", "b", "levels"])

    # Few: less than window * window for each cut. A record tells the same under all its keys.
    reached = over.select(F.col("a").alias("id")).unionAll(over.select(F.col("b").alias("id"))).distinct()
    met = space.save(keyed.select("id", F.struct(*NAMES).alias("told")).join(F.broadcast(reached), "id", "left_semi").dropDuplicates(["id"]), "met")
    of = lambda end, name: met.select(F.col("id").alias(end), F.col("told").alias(name))
    joined = over.join(of("a", "l"), "a").join(of("b", "r"), "b").select("a", "b", "l", "r")
    return inside.select("a", "b", "levels").unionAll(joined.mapInArrow(finish, "a bigint, b bigint, levels int")).distinct()


def _crosses(kind: Kind) -> tuple[tuple[str, str], ...]:
    """Fields whose levels mean more together; ``name`` is whether given and family name are both alike."""
    if kind.entity == "person":
        return ("given", "born"), ("born", "place"), ("email", "phone"), ("name", "place")
    return ("family", "place"), ("family", "email"), ("email", "phone")


def _terms(kind: Kind, level: tuple[int, ...]) -> list[str]:
    """The terms of a pair in the model: each field's level, and levels that mean more together."""
    at = dict(zip(traits.PERSON_FIELDS, level))
    at["name"] = int(at["given"] in (1, 2, 3) and at["family"] in (1, 2, 3))
    return [f"{f}={at[f]}" for f in kind.weights] + [f"{f}={at[f]}&{g}={at[g]}" for f, g in _crosses(kind)]


def _before_evidence(kind: Kind, level: list[np.ndarray]) -> np.ndarray:
    """The weight of pairs, by the weights that hold before any evidence."""
    out = np.full(len(level[0]), kind.bias)
    for f, by in (*kind.weights.items(), ("ident", IDENT)):
        out += np.array([by.get(k, 0.0) for k in range(8)])[level[traits.PERSON_FIELDS.index(f)]]
    return out


def carried_on(kind: Kind) -> Callable[[list[np.ndarray]], np.ndarray]:
    """Whether pairs of such levels may become links, or have identifiers that label them."""
    at = traits.PERSON_FIELDS.index("ident")

    def keep(level: list[np.ndarray]) -> np.ndarray:
        return (_before_evidence(kind, level) >= kind.hopeless) | (level[at] == 1) | (level[at] == 4)

    return keep


def none_was_missed(kind: Kind, weights: dict[str, float]) -> bool:
    """Whether, by the fitted weights, no combination of levels that isn't carried on reaches LINK: all of them are tried."""
    own = {**kind.weights, "ident": IDENT}
    sizes = [max(own[f]) + 1 if f in own else 1 for f in traits.PERSON_FIELDS]
    keep, best = carried_on(kind), -np.inf
    rest = [np.asarray(x, np.int8).ravel() for x in np.meshgrid(*(np.arange(n, dtype=np.int8) for n in sizes[2:]), indexing="ij")]
    for given in range(sizes[0]):
        for family in range(sizes[1]):  # one slice of the combinations at a time: the driver holds few of them at once
            level = [np.full(len(rest[0]), given, np.int8), np.full(len(rest[0]), family, np.int8), *rest]
            dropped = np.flatnonzero(~keep(level))
            if not len(dropped):
                continue
            at = {f: x[dropped] for f, x in zip(traits.PERSON_FIELDS, level)}
            at["name"] = np.full(len(dropped), int(given in (1, 2, 3) and family in (1, 2, 3)), np.int8)
            z = np.full(len(dropped), weights["bias"]) + np.array([IDENT[k] for k in range(5)])[at["ident"]]
            for f in kind.weights:
                z += np.array([weights.get(f"{f}={k}", 0.0) for k in range(8)])[at[f]]
            for f, g in _crosses(kind):
                z += np.array([[weights.get(f"{f}={j}&{g}={k}", 0.0) for k in range(8)] for j in range(8)])[at[f], at[g]]
            best = max(best, float(z.max()))
    return best == -np.inf or 1 / (1 + np.exp(-np.clip(best, -30, 30))) < LINK


def fit(kind: Kind, patterns: list[tuple[tuple[int, ...], int, int]], strength: float = 2.0, rounds: int = 25) -> dict[str, float]:
    """Weights of terms by penalised logistic regression on labelled patterns (levels, negatives, positives).

    The penalty draws each weight to its value before any evidence, so that few
    labels change little and none change nothing. Patterns are distinct
    combinations of levels: their number doesn't grow with the data.
    """
    prior = {f"{f}={lv}": float(w) for f, by in kind.weights.items() for lv, w in by.items()} | {"bias": kind.bias}
    names = sorted({t for level, _, _ in patterns for t in _terms(kind, level)} | set(prior))
    index = {t: k for k, t in enumerate(names)}
    w0 = np.array([prior.get(t, 0.0) for t in names])
    if not patterns:
        return dict(zip(names, w0))
    x = np.zeros((len(patterns), len(names)))
    for i, (level, _, _) in enumerate(patterns):
        x[i, [index[t] for t in _terms(kind, level)]] = 1
        x[i, index["bias"]] = 1
    neg, pos = (np.array([p[k] for p in patterns], float) for k in (1, 2))
    n, w = neg + pos, w0.copy()
    for _ in range(rounds):
        z = np.clip(x @ w, -30, 30)
        p = 1 / (1 + np.exp(-z))
        gradient = x.T @ (pos - n * p) - strength * (w - w0)
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return dict(zip(names, w))


def confidence(kind: Kind, weights: dict[str, float], level: tuple[int, ...]) -> float:
    at = dict(zip(traits.PERSON_FIELDS, level))
    z = weights["bias"] + sum(weights.get(t, 0.0) for t in _terms(kind, level)) + IDENT[at["ident"]]
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def rated(pairs: DataFrame, read: DataFrame, kind: Kind, weights: dict[str, float]) -> DataFrame:
    """pairs (ix, iy) with the confidence that the model gives them."""
    side = lambda end, name: read.select(F.col("id").alias(end), F.struct(*NAMES).alias(name))
    met = pairs.select("ix", "iy").join(side("ix", "l"), "ix").join(side("iy", "r"), "iy").select("ix", "iy", "l", "r")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, float] = {}
        for batch in batches:
            k = batch.num_rows
            sides = [pa.table({n: batch.column(at).field(m) for m, n in enumerate(NAMES)}) for at in (2, 3)]
            both = levels.Records(pa.concat_tables(sides).combine_chunks())
            codes = levels.packed(kind.compare(both, np.arange(k), np.arange(k, 2 * k))).tolist() if k else []
            for code in set(codes) - set(known):
                known[code] = confidence(kind, weights, levels.unpacked(code))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([known[c] for c in codes], pa.float64())], ["ix", "iy", "rated"])

    return met.mapInArrow(rate, "ix bigint, iy bigint, rated double")


def scored(read: DataFrame, pairs: DataFrame, kind: Kind, space: Workspace, whole: bool = True) -> tuple[DataFrame, dict[str, float]] | None:
    """a, b, confidence, sa and sb (the sources) of every pair (a, b, levels) of at least LINK, and the weights, fitted on all labelled pairs.

    Nothing, unless ``whole``, where pairs that weren't carried on could have been links.
    """
    spark = read.sparkSession
    compared = space.save(pairs, "compared")
    # Distinct combinations of levels: 6 * 6 * 7 * 5 * 4 * 5 * 5 * 3 at most.
    patterns = {r.levels: r.n for r in compared.groupBy("levels").agg(F.count(F.lit(1)).alias("n")).collect()}
    at = traits.PERSON_FIELDS.index("ident")
    labelled: dict[tuple[int, ...], list[int]] = {}
    for code, n in patterns.items():
        level = levels.unpacked(code)
        if level[at] in (1, 4):
            labelled.setdefault(level[:at] + (0,) + level[at + 1 :], [0, 0])[int(level[at] == 1)] += n
    weights = fit(kind, [(lv, *n) for lv, n in sorted(labelled.items())])
    if not whole and not none_was_missed(kind, weights):
        return None
    sure = [(code, c) for code in patterns if (c := confidence(kind, weights, levels.unpacked(code))) >= LINK]
    links = compared.join(F.broadcast(spark.createDataFrame(sure, "levels int, confidence double")), "levels")
    of = lambda end: read.select(F.col("id").alias(end), F.col("system").alias(f"s{end}"))
    return links.join(of("a"), "a").join(of("b"), "b").select("a", "b", "sa", "sb", "confidence"), weights


def assign(edges: list[tuple[int, int, float]]) -> set[tuple[int, int]]:
    """The one-to-one choice of edges (left, right, weight) with the largest total weight: successive shortest augmenting paths.

    Paths are searched along edges only, by reduced costs, and end at the nearest
    free right or at a left that is better left alone, so time and memory follow
    the edges and not the square of the ends.
    """
    of: dict[int, dict[int, float]] = {}
    for a, b, w in edges:
        if w > of.setdefault(a, {}).get(b, 0.0):
            of[a][b] = w
    worth = {a: max(to.values(), default=0.0) for a, to in of.items()}  # what a left yet has to gain; 0 once it is left alone
    price: dict[int, float] = {}  # of a right; only taken ones have one
    mate: dict[int, int | None] = {}
    taken: dict[int, int] = {}
    for start in of:
        near, reached, via = {}, {}, {}
        queue: list[tuple[float, int]] = [(0.0, start)]
        best, end = np.inf, (start, None)
        while queue:
            d, a = heapq.heappop(queue)
            if a in near:
                continue
            if d >= best:
                break
            near[a] = d
            if d + worth[a] < best:
                best, end = d + worth[a], (a, None)
            for b, w in of[a].items():
                if mate.get(a) == b:
                    continue
                further = d + max(worth[a] + price.get(b, 0.0) - w, 0.0)
                if further >= best:
                    continue
                if b not in taken:
                    best, end = further, (a, b)
                elif further < reached.get(b, np.inf):
                    reached[b], via[b] = further, a
                    heapq.heappush(queue, (further, taken[b]))
        for a, d in near.items():
            if d < best:
                worth[a] -= best - d
        for b, d in reached.items():
            if d < best:
                price[b] = price.get(b, 0.0) + best - d
        a, b = end
        while True:
            before, mate[a] = mate.get(a), b
            if b is not None:
                taken[b] = a
            if a == start:
                break
            a, b = via[before], before
    return {(a, b) for a, b in mate.items() if b is not None}


def one_to_one(edges: DataFrame, space: Workspace) -> DataFrame:
    """The edges (p, u, v, w) chosen so that in each p no u and no v is in two, with the largest sum of w.

    Edges without a rival are chosen at once. Contested edges fall into connected
    sets; each is assigned exactly, whatever its size, in one task that holds it.
    """
    has = lambda col: edges.groupBy("p", col).count().where("count > 1").select("p", col, F.lit(True).alias(f"r_{col}"))
    marked = edges.join(has("u"), ["p", "u"], "left").join(has("v"), ["p", "v"], "left")
    marked = space.save(marked.select("p", "u", "v", "w", (F.col("r_u").isNotNull() | F.col("r_v").isNotNull()).alias("contested")), "marked")
    free = marked.where("not contested").select("p", "u", "v", "w")
    rest = marked.where("contested").select("p", "u", "v", "w")
    if rest.isEmpty():
        return free
    ends = rest.select("p", F.col("u").alias("x"), F.lit(0).alias("side")).unionAll(rest.select("p", F.col("v").alias("x"), F.lit(1).alias("side"))).distinct()
    numbered = space.save(ends.withColumn("n", F.monotonically_increasing_id()), "ends")
    lu = numbered.where("side = 0").select("p", F.col("x").alias("u"), F.col("n").alias("nu"))
    lv = numbered.where("side = 1").select("p", F.col("x").alias("v"), F.col("n").alias("nv"))
    known = space.save(rest.join(lu, ["p", "u"]).join(lv, ["p", "v"]), "contested")
    sets = contract(known.select(F.col("nu").alias("u"), F.col("nv").alias("v")), space, FEW)
    known = known.join(sets.select(F.col("v").alias("nu"), F.col("rep").alias("set")), "nu")
    known = space.save(known, "sets")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["p", "u", "v"])  # of equally good choices the same one, in whatever order the edges come
        chosen = assign(list(zip(pdf.u, pdf.v, pdf.w)))
        return pdf[[(a, b) in chosen for a, b in zip(pdf.u, pdf.v)]][["p", "u", "v", "w"]]

    return free.unionAll(known.groupBy("set").applyInPandas(solve, "p string, u bigint, v bigint, w double"))


def same_entities(records: DataFrame, kind: Kind, window: int = WINDOW) -> DataFrame:
    """left_rec, right_rec (left_rec smaller) and confidence of every pair of records that describe one entity.

    Pairs within a source and across sources. A pair that only the group tells,
    both being linked to a third record, has the confidence that the model gives
    it by itself, which may be less than LINK. A record with a null part in its key matches nothing; one that tells
    nothing neither; repeated rows count once. Where the links of a group would
    join two records of one source that weren't found to be copies, only pairs
    linked themselves are given.

    Each step is written before the next one is planned: the driver holds a plan,
    its stages' threads and their generated code for as much as one query spans.
    """
    space = Workspace(records.sparkSession, f"match-{kind.entity}")
    read = space.save(_read(records, kind).withColumn("id", F.monotonically_increasing_id()), "traits")
    keyed = read.select("id", *NAMES, F.explode(F.array_distinct("keys")).alias("k"))
    keyed = keyed.select("id", F.substring("k", 1, 1).alias("pass"), F.expr("substring(k, 3)").alias("key"), *NAMES)
    found = scored(read, neighbours(keyed, space, window, kind.compare, carried_on(kind)), kind, space, whole=False)
    if found is None:  # the evidence moved the weights so far that every pair must be weighed
        space.clear("windows", "over", "met", "compared")
        found = scored(read, neighbours(keyed, space, window, kind.compare), kind, space)
    found, weights = found
    links = space.save(found, "links")
    space.clear("windows", "over", "met", "compared")

    # Copies within a source become one class, named by its representative.
    inner = links.where("sa = sb")
    reps = contract(inner.select(F.col("a").alias("u"), F.col("b").alias("v")), space, FEW).select(F.col("v").alias("id"), "rep")
    classes = space.save(read.select("id", "rec", "system").join(reps, "id", "left").withColumn("class", F.coalesce("rep", "id")).drop("rep"), "classes")
    of = classes.select("id", "class")
    cross = links.where("sa <> sb").join(of.select(F.col("id").alias("a"), F.col("class").alias("ca")), "a").join(of.select(F.col("id").alias("b"), F.col("class").alias("cb")), "b")
    flip = F.col("sa") < F.col("sb")
    edges = cross.groupBy(
        F.concat_ws("|", F.least("sa", "sb"), F.greatest("sa", "sb")).alias("p"),
        F.when(flip, F.col("ca")).otherwise(F.col("cb")).alias("u"), F.when(flip, F.col("cb")).otherwise(F.col("ca")).alias("v"),
    ).agg(F.max("confidence").alias("w"))
    chosen = space.save(one_to_one(space.save(edges, "cross"), space), "chosen")
    space.clear("cross", "marked", "ends", "contested", "sets")

    groups = contract(chosen.select("u", "v"), space, FEW).select(F.col("v").alias("class"), "rep")
    grouped = space.save(classes.join(groups, "class", "left").withColumn("group", F.coalesce("rep", "class")).drop("rep"), "grouped")
    clash = grouped.select("group", "system", "class").distinct().groupBy("group", "system").count().where("count > 1").select("group").distinct()
    clash = space.save(clash, "clash")
    clean = space.save(grouped.join(clash, "group", "left_anti"), "clean")
    members = clean.select(F.col("group").alias("form"), F.struct("id", "rec").alias("address_id"))
    several = clean.groupBy("group").count().where("count > 1").select(F.col("group").alias("fa"), F.col("group").alias("fb"))
    whole = expand(members, several).select("fa", F.col("a.id").alias("ix"), F.col("b.id").alias("iy"), F.col("a.rec").alias("x"), F.col("b.rec").alias("y"))
    direct = links.select(F.col("a").alias("ix"), F.col("b").alias("iy"), "confidence")
    whole = space.save(whole.join(direct, ["ix", "iy"], "left").select("ix", "iy", "x", "y", "confidence"), "whole")
    told = space.save(rated(whole.where("confidence is null"), read, kind, weights), "rated")
    whole = whole.join(told, ["ix", "iy"], "left").select("x", "y", F.coalesce("confidence", "rated").alias("confidence"))

    torn = space.save(grouped.join(clash, "group", "left_semi").select("id", "rec", "class"), "torn")
    kept = chosen.select(F.least("u", "v").alias("c1"), F.greatest("u", "v").alias("c2")).distinct()
    some = links.join(torn.select(F.col("id").alias("a"), F.col("rec").alias("x"), F.col("class").alias("cx")), "a").join(torn.select(F.col("id").alias("b"), F.col("rec").alias("y"), F.col("class").alias("cy")), "b")
    some = some.withColumns({"c1": F.least("cx", "cy"), "c2": F.greatest("cx", "cy")}).join(kept.withColumn("kept", F.lit(True)), ["c1", "c2"], "left")
    some = space.save(some.where("kept or cx = cy").select("x", "y", "confidence"), "some")
    space.clear("traits", "links", "classes", "chosen", "grouped", "clash", "clean", "torn")
    return whole.unionAll(some).select(F.least("x", "y").alias("left_rec"), F.greatest("x", "y").alias("right_rec"), F.round("confidence", 6).alias("confidence")).distinct()


def all_matches(persons: DataFrame, firms: DataFrame) -> DataFrame:
    """entity, left_rec, right_rec and confidence of all matching pairs of persons and of firms."""
    parts = [same_entities(df, kind).select(F.lit(kind.entity).alias("entity"), "left_rec", "right_rec", "confidence") for df, kind in ((persons, PERSON), (firms, FIRM))]
    return parts[0].unionAll(parts[1])
