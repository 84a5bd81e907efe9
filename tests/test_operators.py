"""The core's operators against brute force and by their edge cases."""

import datetime
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from goldspan.functions import keys as K
from goldspan.functions import likeness as L
from goldspan.functions import standard as S
from goldspan.operators import changelog, codelists, deliveries, estimate, gaps, golden, landing, loads, pairs, publish, resolve, sampling, standardise, survive
from goldspan.runtime import Manifest, Workspace


def at(n):
    return datetime.datetime(2025, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(seconds=n)


# --- deliveries


def test_ledger_admits_each_id_once_over_batches(spark):
    rng = random.Random(1)
    rows = [("t", f"e{rng.randrange(300)}", rng.randrange(10_000)) for _ in range(900)]
    ledger, seen = deliveries.DeliveryLedger(spark, shards=7), set()
    for k in range(3):
        batch = rows[k::3]
        got = ledger.admit(spark.createDataFrame(batch, "scope string, event_id string, landing_seq long")).collect()
        want = {}
        for _, e, s in batch:
            if e not in seen:
                want.setdefault(e, []).append(s)
        assert {(r.event_id, r.landing_seq, r.copies) for r in got} == {(e, min(s), len(s)) for e, s in want.items()}
        seen |= set(want)


def test_ledger_repeats_a_batch_and_touches_only_its_shards(spark):
    ledger = deliveries.DeliveryLedger(spark, shards=5, fanout=3)
    batch = lambda *ids: spark.createDataFrame([("t", i, n) for n, i in enumerate(ids)], "scope string, event_id string, landing_seq long")
    first = {tuple(r) for r in ledger.admit(batch("a", "b", "b"), "one").collect()}
    again = deliveries.DeliveryLedger(spark, ledger.space.root, fanout=3)  # a consumer that crashed before it stored the rows asks once more
    assert {tuple(r) for r in again.admit(batch("a", "b", "b"), "one").collect()} == first == {("t", "a", 0, 1), ("t", "b", 1, 2)}
    again.release("one")
    for k in range(4):
        assert {r.event_id for r in again.admit(batch("a", f"n{k}"), f"k{k}").collect()} == {f"n{k}"}
    _, held = again.manifest.latest()
    assert len(held["bitmaps"]) < 3 and len(held["dictionary"]) < 3  # compacted
    touched = spark.read.parquet(held["bitmaps"][-1]).select("shard").distinct().count()
    assert touched <= 5
    assert {(r.event_id, r.fresh) for r in again.judge(batch("a", "z"), "last").collect()} == {("a", False), ("z", True)}


def test_ledger_keeps_hot_ids_nulls_and_case_apart(spark):
    rows = [("t", "hot", k) for k in range(500)] + [("t", "HOT", 1), ("t", " hot", 2), ("t", None, 3), ("u", "hot", None), ("t", "", 9)]
    df = spark.createDataFrame(rows, "scope string, event_id string, landing_seq long").withColumn("code", F.lit("x")).withColumn("shard", F.lit(1))
    got = {(r.scope, r.event_id): (r.landing_seq, r.copies) for r in deliveries.DeliveryLedger(spark).admit(df).collect()}
    assert got == {("t", "hot"): (0, 500), ("t", "HOT"): (1, 1), ("t", " hot"): (2, 1), ("u", "hot"): (None, 1), ("t", ""): (9, 1)}


def test_ledger_takes_an_empty_batch(spark):
    ledger = deliveries.DeliveryLedger(spark)
    empty = spark.createDataFrame([], "scope string, event_id string, landing_seq long")
    assert ledger.admit(empty).count() == 0
    assert ledger.admit(empty).count() == 0
    assert ledger.admit(spark.createDataFrame([("t", "a", 1)], empty.schema)).count() == 1
    assert ledger.admit(spark.createDataFrame([("t", "a", 1)], empty.schema)).count() == 0


def test_manifest_refuses_a_second_writer(spark):
    manifest = Manifest(spark, Workspace(spark, "m").root)
    assert manifest.commit(0, {"a": 1}) == 1
    with pytest.raises(RuntimeError):
        manifest.commit(0, {"a": 2})
    assert manifest.latest() == (1, {"a": 1})


# --- changes

CHANGES = "entity string, source_system string, source_key string, version long, occurred_at timestamp, landing_seq long, event_id string, op string"


def test_changes_in_any_order_give_one_state(spark):
    rng = random.Random(2)
    rows = [("p", rng.choice(["hr", "crm"]), f"k{rng.randrange(40)}", rng.choice([None, 1, 2, 3]), at(rng.randrange(20)), n, f"e{n}", rng.choice(["upsert", "upsert", "delete"])) for n in range(400)]
    rows += [("p", "crm", "hot", 0, at(n), n, f"h{n}", "upsert") for n in range(200)]
    order = lambda r: ((r[3] is not None, r[3] or 0), r[4], r[5], r[6])
    last = {}
    for r in rows:
        k = r[:3]
        if k not in last or order(r) > order(last[k]):
            last[k] = r
    want = {(*k, r[6]) for k, r in last.items() if r[7] != "delete"}
    rng.shuffle(rows)
    store = changelog.ChangeStore(spark, buckets=3, fanout=3)
    state = lambda: {tuple(r) for r in store.state().select("entity", "source_system", "source_key", "event_id").collect()}
    for k in range(5):
        store.append(spark.createDataFrame(rows[k::5], CHANGES).withColumn("last", F.lit(1)))
    assert [r["level"] for r in store.runs()] == [1, 0, 0] and state() == want
    plan = store.merged()._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange" not in plan  # sorted runs are merged where they lie
    assert {tuple(r) for r in changelog.ChangeStore(spark, store.space.root).state().select("entity", "source_system", "source_key", "event_id").collect()} == want
    store.compact()
    assert len(store.runs()) == 1 and state() == want
    store.append(spark.createDataFrame([("p", "crm", "hot", 0, at(-5), 999, "late", "upsert")], CHANGES))
    assert state() == want  # an older change that lands late moves nothing


def test_tombstone_outlives_compaction(spark):
    store = changelog.ChangeStore(spark)
    store.append(spark.createDataFrame([("p", "crm", "a", 0, at(9), 1, "d", "delete")], CHANGES))
    store.append(spark.createDataFrame([], CHANGES))
    store.compact()
    store.append(spark.createDataFrame([("p", "crm", "a", 0, at(1), 2, "u", "upsert"), ("p", None, None, 0, at(1), 3, "n", None)], CHANGES))
    assert [r.event_id for r in store.state().collect()] == ["n"]


def test_queued_changes_apply_each_event_once(spark):
    queue = spark.createDataFrame([("p", "hr", "a", "e1", 5), ("p", "hr", "a", "e1", 3), ("p", "hr", "a", None, 1)], "entity string, source_system string, source_key string, event_id string, landing_seq long")
    landed = spark.createDataFrame([("e1", "upsert", at(1), 7, 3), ("e1", "upsert", at(1), 7, 5), ("e2", "delete", at(2), 8, 6)], "event_id string, op string, occurred_at timestamp, source_version long, landing_seq long")
    got = changelog.queued_changes(queue, landed).collect()
    assert [(r.event_id, r.landing_seq, r.version) for r in got] == [("e1", 3, 7)]


# --- loads


def _load_rows(spoil=None, n=200, loads_=8):
    rng = random.Random(3)
    rows = []
    for k in range(1, loads_ + 1):
        for i in range(n):
            r = {
                "load_no": k, "loaded_at": at(86400 * k), "source_system": "crm", "given_name": rng.choice(["Anna", "Ben", "Cleo", "Dora"]), "birth_date": f"{rng.randrange(1950, 2000)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}",
                "email": f"u{rng.randrange(10**6)}@a.example", "phone": f"0{rng.randrange(10**8):08d}", "postcode": None if rng.random() < 0.1 else f"AA{rng.randrange(10)} {rng.randrange(10)}AB", "country": rng.choice(["QM", "QN", "QM"]),
                "person_ref": f"{rng.randrange(10**9):09d}", "source_version": rng.randrange(1, 5), "occurred_at": at(86400 * k - rng.randrange(86400 * 6)),
            }
            if spoil and k == 5:
                spoil(r, i)
            rows.append(r)
    return rows


SPOILS = {
    "country": lambda r, i: r.update(country=None if i % 2 else r["country"]), "given_name": lambda r, i: r.update(given_name=r["given_name"].upper() if i % 2 else r["given_name"]),
    "phone": lambda r, i: r.update(phone="011112222" if i % 2 else r["phone"]), "birth_date": lambda r, i: r.update(birth_date="/".join(reversed(r["birth_date"].split("-")))),
    "source_version": lambda r, i: r.update(source_version=r["source_version"] * -1000), "occurred_at": lambda r, i: r.update(occurred_at=r["occurred_at"] - datetime.timedelta(days=400)),
}
LOADS = "load_no int, loaded_at timestamp, source_system string, given_name string, birth_date string, email string, phone string, postcode string, country string, person_ref string, source_version long, occurred_at timestamp"


@pytest.mark.parametrize("attr", sorted(SPOILS))
def test_a_spoilt_load_is_named_and_no_other(spark, attr):
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in LOADS.split(", ")) for r in _load_rows(SPOILS[attr])], LOADS)
    assert {tuple(r) for r in loads.changed(df.withColumn("n", F.lit(1))).collect()} == {(5, attr)}


def test_loads_without_change_empty_and_single(spark):
    rows = [tuple(r[c.split()[0]] for c in LOADS.split(", ")) for r in _load_rows(n=60)]
    assert loads.changed(spark.createDataFrame(rows, LOADS)).count() == 0
    assert loads.changed(spark.createDataFrame([], LOADS)).count() == 0
    assert loads.changed(spark.createDataFrame(rows[:40] + [(None,) * 12], LOADS)).count() == 0
    assert loads.profile(spark.createDataFrame([], LOADS)).count() == 0


def test_description_length_keeps_cases_apart_and_joins_rare_lengths():
    of = loads.induce({"Aaaa": 1, "Aaaaa": 1, "Aaaaaaa": 1, "9999-99-99": 500})
    assert of["Aaaa"] == of["Aaaaa"] == of["Aaaaaaa"]
    assert of["9999-99-99"] == r"^\d{4}\-\d{2}\-\d{2}$"
    many = loads.induce({"Aaaa": 300, "AAAA": 150})
    assert many["Aaaa"] != many["AAAA"]
    assert loads.induce({}) == {}


def test_expressions_tell_whole_values(spark):
    long = ["-".join(["a1"] * 10) + end for end in ("/x", "#9")] + ["A" * 20, "A" * 70 + "9"]
    rows = [tuple({"load_no": 1, "source_system": "crm", "email": v}.get(c.split()[0]) for c in LOADS.split(", ")) for v in long]
    got = [r.expression for r in loads.expressions(spark.createDataFrame(rows, LOADS), ("email",)).collect()]
    assert len(got) == 4
    java = spark._jvm.java.util.regex.Pattern
    assert all(sum(java.matches(e, v) for e in got) == 1 for v in long)


def test_distributed_induction_equals_induce(spark):
    rng = random.Random(4)
    shapes = {"".join(c * rng.randrange(1, 5) for c in rng.choices("Aa9-@", k=rng.randrange(1, 7))): rng.randrange(1, 300) for _ in range(150)}
    df = spark.createDataFrame([("crm", "email", k, n) for k, n in shapes.items()], "source_system string, attr_name string, shape string, n long")
    assert {r["shape"]: r.expression for r in loads.induced(df, Workspace(spark, "t")).collect()} == loads.induce(shapes)


# --- landing


@settings(max_examples=15, deadline=None)
@given(st.sets(st.integers(0, 60), min_size=1), st.integers(1, 20))
def test_gaps(spark, seqs, bucket):
    got = {tuple(r) for r in landing.gaps(spark.createDataFrame([(s,) for s in seqs], "s long"), "s", bucket).collect()}
    order = sorted(seqs)
    assert got == {(a + 1, b - 1) for a, b in zip(order, order[1:]) if b - a > 1}


def test_split_gap_and_probe(spark):
    gap = spark.createDataFrame([(10, 20), (30, 30)], "lo long, hi long")
    late = spark.createDataFrame([(10,), (15,), (25,)], "s long")
    assert {tuple(r) for r in landing.split_gaps(gap, late, "s").collect()} == {(11, 14), (16, 20), (30, 30)}
    assert {r.s for r in landing.range_probe(late, gap, "s").collect()} == {10, 15}


# --- functions


@pytest.mark.parametrize(
    "raw, first, want",
    [("2001-02-03", False, "2001-02-03"), ("20010203", False, "2001-02-03"), ("03/02/2001", True, "2001-02-03"), ("02/03/2001", False, "2001-02-03"), ("3.2.2001", False, "2001-02-03"), ("2001-02-30", False, None), ("2001", False, None), (None, False, None), ("2001-02-03T10:00", False, "2001-02-03")],
)
def test_dates(spark, raw, first, want):
    df = spark.createDataFrame([(raw, first)], "c string, f boolean")
    assert df.select(S.iso_date("c", F.col("f")).alias("o")).first().o == want


def test_fold_phone_and_firms(spark):
    df = spark.createDataFrame([("Łódź-Straße", "+999 (0)448-153712", "The Børn & Co. Ltd."), ("  ", "0448153712", "Limited"), ("É", "00999448153712", None), ("Ελλάδα", "12", "A.B.C. Inc")], "a string, b string, c string")
    got = [tuple(r) for r in df.select(S.fold("a"), S.phone_e164("b"), S.org_core("c")).collect()]
    assert got == [("lodz strasse", "+999448153712", "born"), (None, "+999448153712", "limited"), ("e", "+999448153712", None), ("ελλαδα", None, "abc")]


def test_checksums_and_hashes(spark):
    import hashlib
    import hmac

    df = spark.createDataFrame([("79927398713", "x")], "a string, b string")
    r = df.select(K.luhn_valid("a").alias("l"), K.hash63("a", "b").alias("h"), K.hmac63(b"key", F.col("a")).alias("m")).first()
    assert r.l is True
    assert r.h == int.from_bytes(hashlib.sha256(b"79927398713|x").digest()[:8], "big") >> 1
    assert r.m == int.from_bytes(hmac.new(b"key", b"79927398713", "sha256").digest()[:8], "big") >> 1


def test_likeness():
    assert round(L.jaro_winkler("martha", "marhta"), 4) == 0.9611
    assert L.token_set("brindel holding", "brindel") == 1.0
    assert L.nysiis("knight") == L.nysiis("night")
    assert L.metaphone("phone") == L.metaphone("fone")


# --- pairs


def test_rules_and_counterfactuals(spark):
    rules = pairs.Rules.defaults({"a": 4, "b": 2}, 0.01)
    grid = [(a, b) for a in (-1, 0, 1, 2, 3) for b in (-1, 0, 1)]
    df = spark.createDataFrame(grid, "a int, b int").withColumn("w", rules.weight())
    rank = lambda w: 2 if w >= rules.edge(90) else 1 if w >= rules.edge(60) else 0
    for r in df.withColumn("up", pairs.counterfactuals(rules, True)).collect():
        levels = {"a": r.a, "b": r.b}
        own = lambda c: rules.weights[c][levels[c]] if levels[c] >= 0 else 0.0
        assert abs(r.w - (rules.prior + own("a") + own("b"))) < 1e-9
        options = [(round(abs(w - own(c)), 9), i, k, f"{c}:{k}") for i, (c, ws) in enumerate(rules.weights.items()) for k, w in enumerate(ws) if k != levels[c] and rank(r.w - own(c) + w) > rank(r.w)]
        assert r.up == (min(options)[3] if options else None)


def test_expectation_maximisation_recovers_known_chances():
    rng = np.random.default_rng(3)
    m, u, lam = [np.array([0.9, 0.1]), np.array([0.8, 0.15, 0.05]), np.array([0.85, 0.15])], [np.array([0.05, 0.95]), np.array([0.1, 0.2, 0.7]), np.array([0.1, 0.9])], 0.3
    match = rng.random(20_000) < lam
    rows = np.array([[rng.choice(len(m[k]), p=m[k] if y else u[k]) for k in range(3)] for y in match])
    pats, n = np.unique(rows, axis=0, return_counts=True)
    got, share, done = pairs.expectation_maximisation([(tuple(p), int(c)) for p, c in zip(pats, n)], [2, 3, 2], u, rounds=300)
    assert done and abs(share - lam) < 0.03 and all(np.abs(a - b).max() < 0.05 for a, b in zip(got, m))


def test_candidates_drop_stop_keys(spark):
    keys = spark.createDataFrame([(f"r{k}", "p", "hot") for k in range(30)] + [("r1", "q", "x"), ("r2", "q", "x")], "rec string, pass string, key string")
    assert [tuple(r) for r in pairs.candidate_pairs(keys, "rec", 10).collect()] == [("r1", "r2", 1)]


# --- golden


def test_components_and_chains(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 50)]
    got = {r.node: r.component for r in golden.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(50)}
    assert golden.components(spark.createDataFrame([], "a long, b long")).count() == 0
    chain = golden.collapse_chains(spark.createDataFrame([(k, k - 1) for k in range(1, 33)], "retired long, survivor long"))
    assert {r.survivor for r in chain.collect()} == {0}


def test_wilson_and_allocation(spark):
    df = spark.createDataFrame([(17, 20), (18, 20), (44, 50), (45, 50), (91, 100), (92, 100)], "a int, n int").select((sampling.wilson_upper(F.col("a"), F.col("n")) < 0.95).alias("t"))
    assert [r.t for r in df.collect()] == [True, False, True, False, True, False]
    got = {r.stratum: r.take for r in sampling.allocation(spark.createDataFrame([("a", 97), ("b", 2), ("c", 1)], "stratum string, n long"), 10).collect()}
    assert got == {"a": 10, "b": 1, "c": 1}


# --- loads against brute force


def test_departures_equal_a_plain_computation(spark):
    rng = random.Random(31)
    rows = []
    for k in (1, 2, 3, 5, 8):
        for i in range(60):
            rows.append({"load_no": k, "loaded_at": at(0), "source_system": "crm", "country": rng.choice(["QM", "QN", "QO", None, " "]) if k != 5 else rng.choice(["QM", None, None])})
    df = spark.createDataFrame([tuple(r.get(c) for c in ("load_no", "loaded_at", "source_system", "country")) for r in rows], "load_no int, loaded_at timestamp, source_system string, country string")
    got = {(r.load_no, r.feature): (r.departure, r.usual) for r in loads.departures(df, ("country",)).collect()}
    cells = {k: [r["country"] for r in rows if r["load_no"] == k] for k in (1, 2, 3, 5, 8)}
    full = {k: [v for v in vs if v and v.strip()] for k, vs in cells.items()}
    names = sorted(cells)
    items = sorted({v for vs in full.values() for v in vs})
    share = np.array([[full[k].count(v) / len(full[k]) if full[k].count(v) * 100 >= len(cells[k]) else 0.0 for v in items] for k in names])
    share = np.hstack([share, np.clip(1 - share.sum(axis=1, keepdims=True), 0, 1)])
    empty = np.array([1 - len(full[k]) / len(cells[k]) for k in names])
    value, gone = [], []
    for k in range(len(names)):
        usual = np.median(np.delete(share, k, axis=0), axis=0)
        chance = 0.5 * np.sqrt(2 * usual * (1 - usual) / (np.pi * len(full[names[k]]))).sum()
        value.append(max(0.0, 0.5 * np.abs(share[k] - usual).sum() - chance) * (1 - empty[k]))
        gone.append(abs(empty[k] - np.median(np.delete(empty, k))))
    for k, name in enumerate(names):
        for feature, want in (("value", value), ("empty", gone)):
            assert got[name, feature] == pytest.approx((want[k], np.quantile(np.delete(want, k), 0.75)), abs=1e-9)


def test_a_whole_number_counts_by_its_magnitude(spark):
    rows = [tuple(r[c.split()[0]] for c in LOADS.split(", ")) for r in _load_rows(lambda r, i: r.update(source_version=r["source_version"] + 10 * (i + 1)))]
    df = spark.createDataFrame(rows, LOADS)
    assert ("bucket" in {f.feature for r in loads.explained(df, ("source_version",)).collect() for f in r.features})


# --- resolution


PAIR = "a string, b string, score double, band string"


def test_clusters_keep_all_schemes_apart_and_tell_what_they_refused(spark):
    pair_rows = [("a", "b", 99.0, "auto"), ("b", "c", 95.0, "auto"), ("c", "d", 97.0, "auto"), ("d", "a", 91.0, "auto"), ("x", "y", 92.0, "auto"), ("y", "z", 93.0, "auto"), ("z", "a", 70.0, "review"), ("p", "p", 99.0, "auto")]
    df = spark.createDataFrame(pair_rows, PAIR)
    recs = spark.createDataFrame([(r,) for r in "abcdxyzq"] + [(None,)], "rec string")
    ids = spark.createDataFrame([("a", "S", "1"), ("a", "S", "2"), ("d", "S", "3"), ("b", "T", "9"), ("x", "S", "5"), ("z", "T", "6")], "rec string, scheme string, value string")
    clusters, refused = resolve.cluster(recs, df, ids)
    got = {r.rec: (r.cluster, r.weakest) for r in clusters.collect()}
    assert got == {"a": ("a", 99.0), "b": ("a", 99.0), "c": ("c", 97.0), "d": ("c", 97.0), "x": ("x", 92.0), "y": ("x", 92.0), "z": ("x", 92.0), "q": ("q", None)}
    assert {tuple(r) for r in refused.collect()} == {("b", "c", 95.0), ("a", "d", 91.0)}
    reviews = {tuple(r) for r in resolve.cluster_reviews(clusters, df, refused).collect()}
    assert reviews == {("a", "c", "b", "c", 95.0, "cannot_link_conflict"), ("a", "x", "a", "z", 70.0, "possible_duplicate")}


def test_a_second_value_of_a_scheme_lets_records_join(spark):
    df = spark.createDataFrame([("a", "b", 99.0, "auto"), ("b", "c", 98.0, "auto")], PAIR)
    recs = spark.createDataFrame([("a",), ("b",), ("c",)], "rec string")
    ids = spark.createDataFrame([("a", "S", "1"), ("b", "S", "1"), ("b", "S", "2"), ("c", "S", "2")], "rec string, scheme string, value string")
    clusters, refused = resolve.cluster(recs, df, ids)
    assert {r.cluster for r in clusters.collect()} == {"a"} and refused.count() == 0


@pytest.mark.parametrize("few", [0, 20_000])
def test_components_end_in_few_rounds_on_a_long_chain(spark, monkeypatch, few):
    monkeypatch.setattr(golden, "FEW", few)
    saved, save = [], golden.Workspace.save
    monkeypatch.setattr(golden.Workspace, "save", lambda self, df, name, *more: (saved.append(name), save(self, df, name, *more))[1])
    names = [f"c{k:04d}" for k in range(1200)]
    random.Random(34).shuffle(names)
    rows = [*zip(names, names[1:]), *((f"s{k}", "hub") for k in range(300)), ("self", "self"), ("a", None), (None, "b")]
    got = {r.node: r.component for r in golden.components(spark.createDataFrame(rows, "a string, b string")).collect()}
    assert got == {n: "c0000" for n in names} | {f"s{k}": "hub" for k in range(300)} | {"hub": "hub", "self": "self"}
    assert len(saved) < 60  # a round saves two tables


def test_weakest_union_equals_a_spanning_tree(spark):
    rng = random.Random(32)
    edges = {}
    for _ in range(120):
        a, b = sorted(rng.sample(range(40), 2))
        edges[f"n{a:02d}", f"n{b:02d}"] = round(rng.uniform(90, 100), 3)
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    least = {}
    for (a, b), s in sorted(edges.items(), key=lambda e: (-e[1], e[0])):
        p, q = sorted((find(a), find(b)))
        if p != q:
            parent[q] = p
            least[p] = min(least.get(p, s), least.pop(q, s), s)
    df = spark.createDataFrame([(a, b, s, "auto") for (a, b), s in edges.items()], PAIR)
    recs = spark.createDataFrame([(n,) for n in sorted(parent)], "rec string")
    none = spark.createDataFrame([], "rec string, scheme string, value string")
    got = {r.rec: (r.cluster, r.weakest) for r in resolve.cluster(recs, df, none)[0].collect()}
    assert got == {n: (find(n), least[find(n)]) for n in parent}


@pytest.mark.parametrize("few", [7, 20_000])
def test_large_clusters_equal_small_ones(spark, monkeypatch, few):
    monkeypatch.setattr(golden, "FEW", few)
    monkeypatch.setattr(resolve, "FEW", few)
    rng = random.Random(33)
    edges = {}
    for k in range(8):
        for _ in range(20):
            a, b = sorted(rng.sample(range(12), 2))
            edges[f"{k}n{a:02d}", f"{k}n{b:02d}"] = rng.choice([91.0, 92.0, 95.0, round(rng.uniform(90, 100), 3)])
    held = {f"{k}n{a:02d}": str(a % 3) for k in range(3) for a in range(0, 12, 2)} | {"4n00": "1", "4n01": "1"}
    parent, known, least, no = {}, {}, {}, set()
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for (a, b), s in sorted(edges.items(), key=lambda e: (-e[1], e[0])):
        p, q = sorted((find(a), find(b)))
        if p == q:
            continue
        mine, theirs = (known.get(n, {held[n]} if n in held else set()) for n in (p, q))
        if mine and theirs and not mine & theirs:
            no.add((a, b, s))
            continue
        parent[q], known[p] = p, mine | theirs
        least[p] = min(least.get(p, s), least.pop(q, s), s)
    df = spark.createDataFrame([(a, b, s, "auto") for (a, b), s in edges.items()], PAIR)
    recs = spark.createDataFrame([(n,) for n in [*sorted(parent), "alone"]], "rec string")
    ids = spark.createDataFrame([(r, "S", v) for r, v in held.items()], "rec string, scheme string, value string")
    clusters, refused = resolve.cluster(recs, df, ids)
    got = [tuple(r) for r in clusters.collect()]
    assert sorted(got, key=str) == sorted([(n, find(n), least.get(find(n))) for n in parent] + [("alone", "alone", None)], key=str)
    assert no and sorted(tuple(r) for r in refused.collect()) == sorted(no)


def test_a_batch_is_resolved_in_order(spark):
    candidates = spark.createDataFrame([("a", "M1", 95.0, "auto", None), ("b", "M1", 95.0, "auto", None), ("b", "M2", 92.0, "auto", None), ("c", "M3", 96.0, "auto", "cannot_link:S"), ("c", "M4", 70.0, "review", None)], "rec string, master_id string, score double, band string, blocked string")
    outside = spark.createDataFrame([("d", "old", 80.0, "review")], "rec string, other string, score double, band string")
    among = spark.createDataFrame([("a", "e", 70.0, "review"), ("e", "f", 95.0, "auto"), ("g", "h", 95.0, "auto"), ("h", "i", 65.0, "review")], PAIR)
    recs = spark.createDataFrame([(r,) for r in "abcdefghi"], "rec string")
    none = spark.createDataFrame([], "rec string, scheme string, value string")
    got, reviews = resolve.batch_resolution(recs, candidates, outside, among, none)
    by = {r.rec: (r.kind, r.reason, r.master_ids, r.review_with, r.cluster) for r in got.collect()}
    assert by == {
        "a": ("link", "auto_band", ["M1"], [], None), "b": ("ambiguous", "ambiguous_auto", ["M1", "M2"], [], None), "c": ("review", "cannot_link_conflict", ["M3", "M4"], [], None), "d": ("review", "unlinked_candidate", [], ["old"], None),
        "e": ("review", "batch_candidate", [], ["f", "a"], None), "f": ("review", "batch_candidate", [], ["e"], None), "g": ("new_cluster", "new_cluster", [], [], "new:g"), "h": ("new_cluster", "new_cluster", [], [], "new:g"), "i": ("new_cluster", "new_cluster", [], [], "new:i"),
    }
    assert [tuple(r) for r in reviews.collect()] == [("g", "i", "h", "i", 65.0, "possible_duplicate")]
    demoted = {r.rec: (r.kind, r.reason) for r in resolve.batch_resolution(recs, candidates, outside, among, none, True)[0].collect()}
    assert demoted["a"] == ("review", "breaker_demoted") and demoted["g"] == demoted["h"] == ("review", "breaker_demoted") and demoted["i"] == ("review", "batch_candidate")


def test_joiners_are_checked_against_those_before_them(spark):
    rows = [("m", "a", 1, [("S", "1")]), ("m", "b", 2, [("S", "2")]), ("m", "c", 3, [("T", "7")]), ("m", "d", 4, [("T", "8"), ("S", "1")]), ("n", "e", 1, [("S", "9")]), ("n", "f", 2, None), (None, "g", 1, [("S", "1")])]
    joins = spark.createDataFrame(rows, "target string, rec string, place int, ids array<struct<scheme:string,value:string>>")
    held = spark.createDataFrame([("n", "S", "8")], "target string, scheme string, value string")
    assert {tuple(r) for r in resolve.joiners_blocked(joins, held).collect()} == {("b", "m", "S"), ("d", "m", "T"), ("e", "n", "S")}


def test_merges_in_a_circle_end(spark):
    got = {tuple(r) for r in golden.collapse_chains(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("d", "e"), ("e", "f"), ("d", "z"), (None, "x")], "retired string, survivor string")).collect()}
    assert got == {("d", "f"), ("e", "f")}


def test_merge_and_unmerge_give_back_what_was(spark):
    gold = spark.createDataFrame([(m, "active", None, 1) for m in "ABCD"] + [("E", "retired", None, 1)], "master_id string, status string, survivor_id string, row_version int")
    xref = spark.createDataFrame([("r1", "A"), ("r2", "B"), ("r3", "C")], "rec string, master_id string")
    none = spark.createDataFrame([], "retired_id string, merged_into string, survivor_id string, active boolean")
    want = spark.createDataFrame([("A", "B"), ("B", "C"), ("D", "D"), ("E", "A")], "retired_id string, survivor_id string")
    out = publish.merge(gold, xref, none, want)
    assert {tuple(r) for r in out["xref"].collect()} == {("r1", "C"), ("r2", "C"), ("r3", "C")}
    assert {(r.retired_id, r.merged_into, r.survivor_id) for r in out["retired"].collect()} == {("A", "B", "C"), ("B", "C", "C")}
    assert {(r.retired_id, r.reason) for r in out["refused"].collect()} == {("D", "merge_into_itself"), ("E", "not_active")}
    undone = spark.createDataFrame([("B",), ("D",)], "retired_id string")
    back = publish.unmerge(out["golden"], out["xref"], out["retired"], undone, spark.createDataFrame([("B", "r1"), ("B", "r2")], "retired_id string, rec string"))
    assert {tuple(r) for r in back["xref"].collect()} == {("r1", "B"), ("r2", "B"), ("r3", "C")}
    assert {(r.retired_id, r.survivor_id, r.active) for r in back["retired"].collect()} == {("A", "B", True), ("B", "C", False)}
    assert {(r.master_id, r.status, r.survivor_id) for r in back["golden"].collect()} == {("A", "merged", "B"), ("B", "active", None), ("C", "active", None), ("D", "active", None), ("E", "retired", None)}
    marks = publish.change_rows(back["marks"].withColumn("entity", F.lit("p")), 7).orderBy("change_seq").collect()
    assert [(r.master_id, r.change_kind, r.parts, r.change_seq) for r in marks] == [("A", "remapped", ["survivor"], 1), ("B", "unmerged", ["values", "xref", "status", "survivor"], 2), ("C", "updated", ["xref"], 3)]
    assert publish.conflicts(gold, spark.createDataFrame([("A", 1), ("B", 2), ("E", 1), ("X", 1)], "master_id string, row_version int")).orderBy("master_id").collect() == [("B", "stale"), ("E", "not_active"), ("X", "unknown")]


def test_units_hold_together_what_shares_anchors(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (3, "y"), (4, None), (5, "z"), (6, "z"), (None, "z")], "item long, anchor string")
    assert {tuple(r) for r in publish.commit_units(df).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5)}
    assert publish.entity_order({"person": ("organisation",), "organisation": ("organisation",), "site": ("person", "organisation")}) == ["organisation", "person", "site"]
    assert publish.entity_order({"a": ("b",), "b": ("a",)}) == ["a", "b"]


# --- reading without loss


def test_gap_reader_loses_nothing_and_repeats_nothing(spark):
    hour = lambda n: at(3600 * n)
    feed = lambda *seqs: spark.createDataFrame([(s, f"p{s}") for s in seqs] + [(None, "none")], "seq long, p string")
    reader = gaps.GapReader(spark, "seq", timeout=2 * 3600, retention_days=1)
    take = lambda rows: sorted(r.seq for r in rows.collect())
    assert take(reader.next_batch(feed(1, 2, 5, 9), "one", hour(0))) == [1, 2, 5, 9]
    assert {(r.lo, r.hi) for r in reader.ranges().collect()} == {(3, 4), (6, 8)} and reader.marks() == (9, 2)
    again = gaps.GapReader(spark, "seq", reader.space.root, timeout=2 * 3600, retention_days=1)  # after a crash
    assert take(again.next_batch(feed(1, 2, 5, 9, 7), "one", hour(1))) == [1, 2, 5, 9]
    assert take(again.next_batch(feed(1, 2, 5, 9, 7, 12), "two", hour(1))) == [7, 12]
    assert {(r.lo, r.hi, r.state) for r in again.ranges().collect()} == {(3, 4, "open"), (6, 6, "open"), (8, 8, "open"), (10, 11, "open")}
    assert take(again.next_batch(feed(1, 2, 5, 9, 7, 12), "three", hour(3))) == []
    assert {r.lo: r.state for r in again.ranges().collect()} == {3: "lost", 6: "lost", 8: "lost", 10: "lost"}
    assert take(again.reconcile(feed(1, 2, 4, 5, 9, 7, 12), "four", hour(4))) == [4]
    assert {r.lo for r in again.ranges().where("state = 'lost'").collect()} >= {3, 6, 8}
    assert take(again.reconcile(feed(1, 2, 4, 5, 9, 7, 12), "five", hour(40))) == [] and again.ranges().where("state = 'lost'").count() == 0
    again.release("one")
    empty = gaps.GapReader(spark, "seq")
    assert take(empty.next_batch(feed(), "x", hour(0))) == [] and empty.marks() == (0, 0)


# --- standardising and rules


def test_key_grammar():
    assert standardise.parse_key("first(name,4)") == standardise.Key("first", "name", 4) and standardise.parse_key(" a.b ") == standardise.Key(None, "a.b")
    for bad in ("first(name)", "id(x,2)", "nope(x)", "first(x,0)", "A", "a|b", ""):
        with pytest.raises(ValueError):
            standardise.parse_key(bad)


def test_records_are_standardised_by_a_model(spark):
    A = standardise.Attribute
    model = standardise.Model(
        "p", (A("name", standardise="person_name"), A("born", "date", "date", placeholders=(("1900-01-01", ()), ("*-01-01", ("sr",)))), A("ref", standardise="registered_id", scheme="R", checksum="luhn"), A("firm", standardise="org_name"), A("n", "integer"), A("flag", "boolean"), A("boss", "reference"), A("homes", "group", fields=("kind", "line")), A("absent")),
        day_first=("sr",), passes={"k": ["sorted_tokens(name,2)", "born.year"], "i": ["id(ref)"], "s": ["soundex(name)"], "l": ["last(name,3)"]},
    )
    rows = [("sr", "1", "Ｍaria  LÓPEZ", "03/02/1980", "79927398713", "The Børn & Co. Ltd.", "5.0", "Yes", " f1 ", [(None, " "), ("home", "1 x")]), ("hr", "2", "  ", "1900-01-01", "12", "", "x", "maybe", "", None), ("sr", "3", "!!", "1/1/1990", None, None, "7", "0", None, [])]
    got = {r.source_key: r for r in standardise.standardise(spark.createDataFrame(rows, "source_system string, source_key string, name string, born string, ref string, firm string, n string, flag string, boss string, homes array<struct<kind:string,line:string>>"), model).collect()}
    one, two, three = got["1"], got["2"], got["3"]
    assert (one.name, one.m_name, one.born, one.m_born__year, one.n, one.flag, one.references) == ("Maria LÓPEZ", "maria lopez", "1980-02-03", "1980", "5", "true", {"boss": "f1"})
    assert one["keys"] == {"k": "lopez maria|1980", "i": "r:79927398713", "s": "m641", "l": "pez"} and one.ids[0].valid and one.invalid == [] and [tuple(h) for h in one.homes] == [("home", "1 x")]
    assert one.m_firm == "born" and one.m_firm__legal == "ltd"
    assert two.name is None and two.placeholders == ["born"] and two.born is None and two.ids[0].valid is False and set(two.invalid) == {"n", "flag"} and two["keys"] == {}
    assert three.invalid == ["name"] and three.placeholders == ["born"] and three.homes is None and three.absent is None


def test_soundex_is_american(spark):
    words = {"Robert": "R163", "Rupert": "R163", "Ashcraft": "A261", "Tymczak": "T522", "Pfister": "P236", "Honeyman": "H555", "Lee": "L000"}
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.soundex("w").alias("s"))
    assert {r.w: r.s for r in df.collect()} == words


def test_contract_names_the_attributes_at_fault(spark):
    attrs = {"p": {"name": "text", "n": "integer", "homes": "group", "boss": "reference"}}
    cases = {
        '{"name":"x","n":1}': (None, []), '{"name":{"a":1}}': ("bad_type", ["name"]), '{"n":true,"boss":[1]}': ("bad_type", ["boss", "n"]), '{"homes":[1]}': ("bad_type", ["homes"]), '{"homes":{"a":1}}': ("bad_type", ["homes"]), '{"fax":1,"abc":2}': ("bad_payload", ["abc", "fax"]),
        '{"name":"' + "x" * 4001 + '"}': ("too_large", ["name"]), '{"homes":[' + ",".join(['{"kind":"k"}'] * 101) + "]}": ("too_large", ["homes"]), '{"homes":[{"kind":"' + "y" * 4001 + '"}]}': ("too_large", ["homes"]), '{"master_id":5}': ("bad_type", ["master_id"]), "[]": ("bad_payload", []), '{"homes":null,"n":null}': (None, []), "not json": ("bad_payload", []),
    }
    rows = [("p", "hr", "k", "upsert", None, p) for p in cases] + [(None, "hr", "k", "upsert", None, "{}"), ("p", None, "k", "upsert", None, "{}"), ("p", "hr", " ", "upsert", None, "{}")]
    df = spark.createDataFrame(rows, "entity string, source_system string, source_key string, op string, source_version long, payload string")
    got = landing.contract(df, attrs, {"p": ("hr",)}, (), ("kind",)).collect()
    assert {r.payload: (r.reason, r.attributes) for r in got if r.entity and r.source_system and r.source_key.strip()} == cases
    assert sorted(r.reason for r in got[len(cases):]) == ["missing_key", "unknown_entity", "unknown_source"]


def test_pins_and_repeating_groups(spark):
    offers = spark.createDataFrame([("m", "city", "hr", "1", "Rome", 1, at(1), 1), ("m", "city", "crm", "2", "Oslo", None, at(9), 2), ("m", "city", "crm", "3", " ", 1, at(9), 2), ("m", "mail", "crm", "2", "x", 2, None, None)], "master_id string, attr_name string, source_system string, source_key string, value string, trust int, occurred_at timestamp, landing_seq long")
    stewards = spark.createDataFrame([("m", "city", "Bonn", at(5), at(100)), ("m", "mail", "old", at(5), at(10)), ("n", "city", "Kiel", at(5), None)], "master_id string, attr_name string, value string, set_at timestamp, pinned_until timestamp")
    got = {(r.master_id, r.attr_name): (r.value, r.source, r.decided_by, len(r.runners_up), r.pinned) for r in survive.survive(offers, {}, ["source_trust", "recency"], stewards, 0, at(50)).collect()}
    assert got == {("m", "city"): ("Bonn", "steward:city", "pin", 2, True), ("m", "mail"): ("x", "crm:2", "only", 0, False), ("n", "city"): ("Kiel", "steward:city", "only", 0, False)}
    assert survive.survive(offers, {}, ["recency"], style="registry").count() == 0
    members = spark.createDataFrame([("m", "a", {"v": "now"}, {"v": "old"}), ("m", "b", {"v": "now"}, None)], "master_id string, rec string, current_values map<string,string>, approved_values map<string,string>")
    assert {r.rec: r["values"] for r in survive.approved(members, spark.createDataFrame([("a",)], "rec string")).collect()} == {"a": {"v": "now"}, "b": None}


def test_canonical_maps_and_the_vault(spark):
    df = spark.createDataFrame([({"b": 'x"]', "a": None},), ({"a": None, "b": 'x"]'},), (None,)], "m map<string,string>")
    assert [r[0] for r in df.select(standardise.canonical_map(F.col("m"))).collect()] == ['{"a":null,"b":"x\\"]"}'] * 2 + [None]


def test_estimates_recover_a_planted_world(spark):
    rng = np.random.default_rng(5)
    m, u = {"x": [0.9, 0.06, 0.04], "y": [0.8, 0.2], "id": [0.95, 0.05]}, {"x": [0.05, 0.15, 0.8], "y": [0.1, 0.9], "id": [0.001, 0.999]}
    draw = lambda same, n: [tuple(int(rng.choice(len(p[c]), p=p[c])) for c in ("x", "y", "id")) for p in [m if same else u] for _ in range(n)]
    rows = [(f"l{k}", f"r{k}", 1.0, bool(y and lv[2] == 0), *lv) for k, (y, lv) in enumerate([(1, v) for v in draw(True, 1500)] + [(0, v) for v in draw(False, 4500)])]
    df = spark.createDataFrame(rows, "left_rec string, right_rec string, weight double, strong_equal boolean, x int, y int, id int")
    random_ = spark.createDataFrame([(*lv,) for lv in draw(False, 4000)], "x int, y int, id int")
    got = estimate.estimate({"p": df}, random_, {"x": 3, "y": 2, "id": 2}, {}, {"p": set()}, 20_000, strong="id")
    assert np.allclose(got["m"]["x"], m["x"], atol=0.04) and np.allclose(got["m"]["y"], m["y"], atol=0.04) and np.allclose(got["u"]["x"], u["x"], atol=0.03)
    assert abs(got["expected"] - 1500) < 150 and 0 < got["prior"] < 1e-3


def test_combined_passes_and_priors():
    got = estimate.combine_passes({"p": ({"x": (0.9, 0.1), "y": (0.5, 0.5)}, {"x": 30.0, "y": 1.0}), "q": ({"x": (0.6, 0.4)}, {"x": 10.0})}, {"p": {"y"}})
    assert got == {"x": pytest.approx((0.825, 0.175))}
    assert estimate.scale_to_population(10, 50, 100) == pytest.approx(10 / 0.75) and estimate.global_prior(5, 0) == 1e-9


def test_hard_rules_decide_counterfactuals(spark):
    rules = pairs.Rules.defaults({"a": 4, "id": 3}, 0.01)
    df = spark.createDataFrame([(0, 0, None), (3, 1, None), (0, 0, "must_link")], "a int, id int, rule string")
    got = [(r.lower_by, r.raise_by) for r in pairs.explain(df, rules, {"id": ("cannot_link", "must_link")}, "rule").collect()]
    assert got[0][0].startswith(("id:2", "a:")) and got[1][1] is not None and got[2] == (None, None)


def test_code_lists_keep_their_versions(spark):
    lists = codelists.CodeLists(spark)
    lists.load(spark.createDataFrame([("c", "A", "x"), ("c", "A", "w"), ("d", "B", None), (None, "Z", "z")], "list_name string, code string, label string"), 1)
    lists.load(spark.createDataFrame([("c", "C", "y")], "list_name string, code string, label string"), 2)
    assert {tuple(r) for r in lists.snapshot().collect()} == {("c", 2, "C", "y"), ("d", 1, "B", None)}
    assert {tuple(r) for r in lists.snapshot(["c"], 1).collect()} == {("c", 1, "A", "w")} and codelists.CodeLists(spark).snapshot().count() == 0
