"""Queries of the operators for resolving, standardising, checking, estimating, surviving and publishing, and their SQL."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldspan.functions import keys as K
from goldspan.functions import standard as S
from goldspan.operators import codelists, estimate, gaps, pairs, publish, quality, resolve, sampling, standardise, survive
from goldspan.operators import landing as land
from goldspan.plans import catalogue as cat
from goldspan.runtime import Workspace, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- resolution ---------------------------------------------------------------------------

_P = """SELECT left_system || ':' || left_key AS a, right_system || ':' || right_key AS b, score, CASE WHEN score >= 90 THEN 'auto' WHEN score >= 60 THEN 'review' ELSE 'none' END AS band
    FROM pair_scores WHERE score IS NOT NULL AND NOT isnan(score) AND left_key IS NOT NULL AND right_key IS NOT NULL"""
_U = f"SELECT least(a, b) AS a, greatest(a, b) AS b, max(score) AS score, CASE WHEN max(score) >= 90 THEN 'auto' WHEN max(score) >= 60 THEN 'review' ELSE 'none' END AS band FROM ({_P}) WHERE a <> b GROUP BY ALL"
_ENDS = f"SELECT a AS rec, b AS other, score, band, a AS l, b AS g FROM ({_U}) UNION ALL SELECT b, a, score, band, a, b FROM ({_U})"


def _pairs(spark, d):
    rec = lambda s: F.concat_ws(":", f"{s}_system", f"{s}_key")
    rows = table(spark, d, "pair_scores").where("score is not null and not isnan(score) and left_key is not null and right_key is not null and left_system is not null and right_system is not null")
    band = F.when(F.col("score") >= 90, "auto").when(F.col("score") >= 60, "review").otherwise("none")
    return rows.select(rec("left").alias("a"), rec("right").alias("b"), "score", band.alias("band"))


_MET = f"SELECT a AS rec, b AS member, score, band, 'M' || right(b, 2) AS master_id FROM ({_P})"
_CAND = f"""SELECT c.rec, c.master_id, c.score, c.band, c.member, c.members, x.blocked FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rec, master_id ORDER BY score DESC, member) AS rn, count(*) OVER (PARTITION BY rec, master_id) AS members FROM ({_MET})) WHERE rn = 1) c
    LEFT JOIN (SELECT m.rec, m.master_id, 'cannot_link:LAST' AS blocked FROM (SELECT DISTINCT rec, master_id, right(rec, 1) AS v FROM ({_MET}) WHERE rec LIKE 'hr:%') m
        JOIN (SELECT master_id, list(DISTINCT right(member, 1)) AS vs FROM ({_MET}) WHERE member LIKE 'hr:%' GROUP BY 1) t ON t.master_id = m.master_id WHERE NOT list_contains(t.vs, m.v)) x ON x.rec = c.rec AND x.master_id = c.master_id"""


def _candidates(spark, d):
    p = _pairs(spark, d).select(F.col("a").alias("rec"), F.col("b").alias("member"), "score", "band")
    xref = p.select(F.col("member").alias("rec")).distinct().withColumn("master_id", F.concat(F.lit("M"), F.right("rec", F.lit(2))))
    ids = p.where("rec like 'hr:%'").select("rec", F.lit("LAST").alias("scheme"), F.right("rec", F.lit(1)).alias("value")).distinct()
    theirs = xref.where("rec like 'hr:%'").select("master_id", F.lit("LAST").alias("scheme"), F.right("rec", F.lit(1)).alias("value"))
    return resolve.golden_candidates(p, xref, ids, theirs)


@query(_CAND)
def golden_candidates(spark, d):
    return _candidates(spark, d)


_LABELS = "SELECT DISTINCT left_system || ':' || left_key AS rec, 'M' || right(right_key, 2) AS master_id FROM pair_scores WHERE score < 40 AND left_key IS NOT NULL AND right_key IS NOT NULL"


@query(f"SELECT c.rec, c.master_id, c.score FROM ({_CAND}) c WHERE NOT EXISTS (SELECT 1 FROM ({_LABELS}) l WHERE l.rec = c.rec AND l.master_id IN (c.master_id, 'M0' || right(c.master_id, 1)) AND (l.master_id = c.master_id OR (l.master_id <> c.master_id AND right(c.master_id, 2) = '1' || right(c.master_id, 1))))")
def declined_candidates(spark, d):
    """A label on a master holds for the one it was merged into: here M0x into M1x."""
    labels = _pairs(spark, d).where("score < 40").select(F.col("a").alias("rec"), F.concat(F.lit("M"), F.right("b", F.lit(2))).alias("master_id"))
    merged = spark.range(10).select(F.concat(F.lit("M0"), F.col("id").cast("string")).alias("retired"), F.concat(F.lit("M1"), F.col("id").cast("string")).alias("survivor"))
    return resolve.declined(_candidates(spark, d), labels, merged).select("rec", "master_id", "score")


@query(f"""WITH c AS ({_CAND}), r AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY score DESC, master_id) AS rn, lead(score) OVER (PARTITION BY rec ORDER BY score DESC, master_id) AS second FROM c WHERE blocked IS NULL),
t AS (SELECT rec, master_id, coalesce(score - second <= 10, false) AS close_call FROM r WHERE rn = 1)
SELECT a.rec, CASE WHEN NOT t.close_call THEN t.master_id END AS default_id, coalesce(t.close_call, false) AS close_call FROM (SELECT DISTINCT rec FROM c) a LEFT JOIN t USING (rec)""")
def default_candidates(spark, d):
    return resolve.default_candidate(_candidates(spark, d))


def _resolution_sql(demoted: bool) -> str:
    return f"""WITH c AS ({_CAND}), g AS (SELECT rec, count(*) FILTER (WHERE band = 'auto' AND blocked IS NULL) AS open, count(*) FILTER (WHERE band = 'auto' AND blocked IS NOT NULL) AS shut, count(*) FILTER (WHERE band = 'review') AS maybe,
    string_agg(master_id, ',' ORDER BY score DESC, master_id) FILTER (WHERE band = 'auto' AND blocked IS NULL) AS linkable, string_agg(master_id, ',' ORDER BY score DESC, master_id) FILTER (WHERE (band = 'auto' AND blocked IS NOT NULL) OR band = 'review') AS held,
    string_agg(master_id, ',' ORDER BY score DESC, master_id) FILTER (WHERE band IN ('auto', 'review')) AS every_, max(score) FILTER (WHERE band = 'auto' AND blocked IS NULL) AS s1, max(score) FILTER (WHERE (band = 'auto' AND blocked IS NOT NULL) OR band = 'review') AS s2 FROM c GROUP BY rec),
o AS (SELECT rec, max(score) AS so, bool_or(band = 'auto') AS oa FROM (SELECT a AS rec, b AS other, score, band FROM ({_P}) WHERE b LIKE 'crm:%' AND a <> b AND score >= 60) GROUP BY rec),
j AS (SELECT coalesce(g.rec, o.rec) AS rec, coalesce(open, 0) AS open, coalesce(shut, 0) AS shut, coalesce(maybe, 0) AS maybe, linkable, held, every_, s1, s2, so, oa FROM g FULL JOIN o ON g.rec = o.rec)
SELECT rec, CASE WHEN open = 1 THEN '{"review" if demoted else "link"}' WHEN open > 1 THEN 'ambiguous' ELSE 'review' END AS kind,
    CASE WHEN open = 1 THEN '{"breaker_demoted" if demoted else "auto_band"}' WHEN open > 1 THEN 'ambiguous_auto' WHEN shut > 0 THEN 'cannot_link_conflict' WHEN maybe > 0 THEN 'review_band' WHEN {str(demoted).lower()} AND oa THEN 'breaker_demoted' ELSE 'unlinked_candidate' END AS reason,
    coalesce(CASE WHEN open > 1 THEN linkable WHEN open = 1 THEN {"every_" if demoted else "linkable"} ELSE held END, '') AS masters, CASE WHEN open > 0 THEN s1 ELSE coalesce(s2, so) END AS score
FROM j WHERE open > 0 OR shut > 0 OR maybe > 0 OR so IS NOT NULL"""


def _resolution(spark, d, demoted):
    outside = _pairs(spark, d).where("b like 'crm:%' and score >= 60").select(F.col("a").alias("rec"), F.col("b").alias("other"), "score", "band")
    got = resolve.resolve_golden(_candidates(spark, d), outside, demoted)
    return got.select("rec", "kind", "reason", F.array_join("master_ids", ",").alias("masters"), "score")


@query(_resolution_sql(False))
def batch_resolution(spark, d):
    return _resolution(spark, d, False)


@query(_resolution_sql(True))
def batch_resolution_demoted(spark, d):
    return _resolution(spark, d, True)


@query(f"""WITH RECURSIVE e AS (SELECT * FROM ({_ENDS}) WHERE band <> 'none'), w(rec) AS (SELECT DISTINCT rec FROM e WHERE rec NOT LIKE 'finance:%' AND other LIKE 'finance:%'
    UNION SELECT e.rec FROM w JOIN e ON e.other = w.rec WHERE e.rec NOT LIKE 'finance:%')
SELECT w.rec, max(e.score) AS score, count(DISTINCT e.other) AS partners FROM w JOIN e ON e.rec = w.rec WHERE e.other LIKE 'finance:%' OR e.other IN (SELECT rec FROM w) GROUP BY w.rec""")
def batch_waiting(spark, d):
    p = _pairs(spark, d)
    records = p.select(F.col("a").alias("rec")).unionAll(p.select(F.col("b").alias("rec"))).distinct()
    got = resolve.waiting(records, p, records.where("rec like 'finance:%'"))
    return got.select("rec", "score", F.size("review_with").cast("bigint").alias("partners"))


def _clusters(spark, d):
    p = _pairs(spark, d)
    records = p.select(F.col("a").alias("rec")).unionAll(p.select(F.col("b").alias("rec"))).distinct()
    ids = records.where("rec like 'hr:%'").select("rec", F.lit("LAST").alias("scheme"), F.right("rec", F.lit(1)).alias("value"))
    return p, *resolve.cluster(records, p, ids)


@query()
def constrained_clusters(spark, d):
    return _clusters(spark, d)[1]


@query()
def cluster_reviews(spark, d):
    p, clusters, refused = _clusters(spark, d)
    return resolve.cluster_reviews(clusters, p, refused)


@query(f"SELECT rec, other AS partner, score FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY score DESC, l, g) AS rn FROM ({_ENDS}) WHERE band = 'auto') WHERE rn = 1")
def union_edges(spark, d):
    p = _pairs(spark, d)
    named = resolve.components(p.where("band = 'auto' and a <> b")).select(F.col("node").alias("rec"), F.col("component").alias("cluster"))
    return resolve.union_edges(named, p)


_JOIN = "SELECT master_id AS target, source_system || ':' || source_key AS rec, min(landing_seq) AS place, min(lower(trim(member_values['email']))) AS v FROM group_members WHERE source_system IS NOT NULL AND source_key IS NOT NULL GROUP BY 1, 2"


@query(f"SELECT rec, target, 'EMAIL' AS scheme FROM (SELECT *, first_value(v) OVER (PARTITION BY target ORDER BY place NULLS FIRST, rec) AS held FROM ({_JOIN}) WHERE v <> '') WHERE v <> held")
def sequential_joiner_block(spark, d):
    """Joiners of a group in landing order, each with its address: the first one's decides."""
    rows = table(spark, d, "group_members").where("source_system is not null and source_key is not null")
    rows = rows.groupBy(F.col("master_id").alias("target"), F.concat_ws(":", "source_system", "source_key").alias("rec")).agg(F.min("landing_seq").alias("place"), F.min(F.lower(F.trim(F.col("member_values")["email"]))).alias("v"))
    ids = F.when(F.col("v") != "", F.array(F.struct(F.lit("EMAIL").alias("scheme"), F.col("v").alias("value")))).otherwise(F.array().cast("array<struct<scheme:string,value:string>>"))
    none = spark.createDataFrame([], "target string, scheme string, value string")
    return resolve.joiners_blocked(rows.select("target", "rec", "place", ids.alias("ids")), none)


# --- reading without loss --------------------------------------------------------------------

_CUTS = "WITH c AS (SELECT epoch_us(min(landed_at)) AS a, epoch_us(max(landed_at)) AS b FROM landing_rows), k AS (SELECT unnest([1, 2, 3, 4]) AS run), t AS (SELECT run, a + (b - a) * run // 4 AS cut FROM c, k)"


@query(f"{_CUTS}, v AS (SELECT landing_seq, (SELECT min(run) FROM t WHERE t.cut >= epoch_us(landed_at)) AS run FROM landing_rows) SELECT v.landing_seq, v.run, coalesce(v.landing_seq < (SELECT max(w.landing_seq) FROM v w WHERE w.run < v.run), false) AS late FROM v")
def gap_reader_runs(spark, d):
    """The feed read four times while rows go on being committed, late ones under numbers already passed: each row comes once."""
    feed = table(spark, d, "landing_rows").select("landing_seq", F.unix_micros("landed_at").alias("us"))
    ends = feed.agg(F.min("us").alias("a"), F.max("us").alias("b")).first()
    reader, out, high = gaps.GapReader(spark, "landing_seq", timeout=10**9), None, 0
    for run in range(1, 5):
        cut = ends.a + (ends.b - ends.a) * run // 4
        rows = reader.next_batch(feed.where(F.col("us") <= cut), f"run-{run}", datetime.datetime.fromtimestamp(cut / 1e6, datetime.timezone.utc))
        part = rows.select("landing_seq", F.lit(run).cast("int").alias("run"), (F.col("landing_seq") < high).alias("late"))
        out, high = part if out is None else out.unionAll(part), reader.marks()[0]
    return out


# --- standardising by a model ------------------------------------------------------------------

A = standardise.Attribute
PERSON = standardise.Model(
    "person",
    (
        A("given_name", standardise="person_name"), A("family_name", standardise="person_name"), A("birth_date", "date", "date", placeholders=(("1900-01-01", ()), ("*-01-01", ("student_records",)))),
        A("email", standardise="email"), A("phone", standardise="phone"), A("postcode", standardise="postcode"), A("city", standardise="text"), A("country", standardise="code"),
        A("person_ref", standardise="registered_id", scheme="PERSON_REF", checksum="luhn"), A("addresses", "group", fields=("kind", "line1", "city", "postcode", "country")), A("employer", "reference"), A("left_on", "date", "date"),
    ),
    day_first=S.DAY_FIRST_SOURCES,
    passes={"family_year": ["family_name.metaphone", "birth_date.year"], "email": ["email"], "ref": ["id(person_ref)"], "area": ["first(given_name,2)", "postcode.prefix"], "tail": ["last(phone,4)", "country"], "tokens": ["sorted_tokens(given_name,2)", "city"], "sound": ["soundex(family_name)"]},
    display="{given_name} {family_name}",
)


def _std(spark, d):
    return standardise.standardise(table(spark, d, "person_records"), PERSON)


_FIRST = "source_system = 'student_records'"
_BORN = cat._date_sql("birth_date", _FIRST)
_PHONE = cat._phone_sql("person_records", "source_system, source_key")
_REF = "nullif(regexp_replace(upper(person_ref), '[\\s.;\\-]', '', 'g'), '')"
_LUHN = "list_sum(list_transform(list_reverse(list_transform(string_split({c}, ''), lambda x: try_cast(x AS INT))), lambda x, i: CASE WHEN i % 2 = 1 THEN x WHEN x * 2 > 9 THEN x * 2 - 9 ELSE x * 2 END)) % 10 = 0"
_EMAIL = "CASE WHEN regexp_matches(lower(trim(email)), '^[^@\\s]+@[^@\\s.]+(\\.[^@\\s.]+)+$') THEN lower(trim(email)) END"
_POST = "nullif(regexp_replace(upper(postcode), '[\\s\\-]', '', 'g'), '')"
_BLANK = lambda c: f"({c} IS NULL OR trim({c}) = '')"
_STD = f"""SELECT r.source_system, r.source_key, {cat._fold_sql('given_name')} AS given, {_EMAIL} AS email, q.phone AS phone, {_POST} AS postcode, {_BORN} AS iso, {_REF} AS ref, upper(trim(country)) AS country,
    r.given_name, r.family_name, r.email AS raw_email, r.phone AS raw_phone, r.birth_date, r.left_on FROM person_records r JOIN ({_PHONE}) q USING (source_system, source_key)"""
_HOLD = "(iso = '1900-01-01' OR (source_system = 'student_records' AND iso LIKE '%-01-01'))"


@query(f"""SELECT source_system, source_key, given, split_part(email, '@', 1) AS email_local, split_part(email, '@', 2) AS email_domain, right(phone, 7) AS phone_last7, substr(postcode, 1, 3) AS prefix,
    CASE WHEN NOT coalesce({_HOLD}, false) THEN substr(iso, 1, 4) END AS born_year, CASE WHEN coalesce({_HOLD}, false) THEN 'birth_date' ELSE '' END AS placeholders,
    CASE WHEN ref IS NULL THEN NULL WHEN regexp_matches(ref, '^\\d+$') THEN {_LUHN.format(c='ref')} ELSE false END AS ref_valid,
    array_to_string(list_filter([CASE WHEN NOT {_BLANK('given_name')} AND given IS NULL THEN 'given_name' END, CASE WHEN NOT {_BLANK('birth_date')} AND iso IS NULL THEN 'birth_date' END,
        CASE WHEN NOT {_BLANK('raw_email')} AND email IS NULL THEN 'email' END, CASE WHEN NOT {_BLANK('raw_phone')} AND phone IS NULL THEN 'phone' END], lambda x: x IS NOT NULL), ',') AS invalid FROM ({_STD})""")
def std_record(spark, d):
    s = _std(spark, d)
    told = F.filter("invalid", lambda x: x.isin("given_name", "birth_date", "email", "phone"))
    return s.select(
        "source_system", "source_key", F.col("m_given_name").alias("given"), F.col("m_email__local").alias("email_local"), F.col("m_email__domain").alias("email_domain"), F.col("m_phone__last7").alias("phone_last7"), F.col("m_postcode__prefix").alias("prefix"),
        F.col("m_birth_date__year").alias("born_year"), F.array_join("placeholders", ",").alias("placeholders"), F.get("ids", F.lit(0))["valid"].alias("ref_valid"), F.array_join(told, ",").alias("invalid"),
    )


@query(f"""SELECT source_system, source_key, pass, lower(key) AS key FROM (SELECT source_system, source_key, 'email' AS pass, email AS key FROM ({_STD})
    UNION ALL SELECT source_system, source_key, 'area', substr(given, 1, 2) || '|' || substr(postcode, 1, 3) FROM ({_STD})
    UNION ALL SELECT source_system, source_key, 'tail', right(phone, 4) || '|' || nullif(country, '') FROM ({_STD})
    UNION ALL SELECT source_system, source_key, 'ref', CASE WHEN regexp_matches(ref, '^\\d+$') AND {_LUHN.format(c='ref')} THEN 'PERSON_REF:' || ref END FROM ({_STD})) WHERE key IS NOT NULL""")
def record_keys(spark, d):
    return standardise.key_rows(_std(spark, d)).where(F.col("pass").isin("email", "area", "tail", "ref"))


@query()
def soundex_blocks(spark, d):
    rows = _std(spark, d).select(F.col("keys")["sound"].alias("code")).where("code is not null")
    return rows.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


_RAW = "CASE o_orderkey % 5 WHEN 0 THEN ' ' || CAST(o_orderkey AS VARCHAR) WHEN 1 THEN CAST(o_orderkey AS VARCHAR) || '.0' WHEN 2 THEN CAST(o_totalprice AS VARCHAR) WHEN 3 THEN o_orderstatus ELSE CASE WHEN o_orderpriority LIKE '1%' THEN 'No' ELSE '1' END END"


@query(f"""SELECT o_orderkey, CASE WHEN regexp_matches(trim(v), '^[+-]?\\d+$') THEN CAST(trim(v) AS BIGINT) WHEN regexp_matches(trim(v), '^[+-]?\\d+\\.0+$') THEN CAST(regexp_replace(trim(v), '\\.0+$', '') AS BIGINT) END AS i,
    try_cast(CASE WHEN regexp_matches(trim(v), '^[+-]?\\d+(\\.\\d+)?$') THEN trim(v) END AS DOUBLE) AS n, CASE WHEN lower(trim(v)) IN ('true', 'yes', 'y', '1') THEN true WHEN lower(trim(v)) IN ('false', 'no', 'n', '0') THEN false END AS b FROM (SELECT o_orderkey, {_RAW} AS v FROM orders)""")
def coerced_values(spark, d):
    v = F.expr(_RAW.replace("VARCHAR", "STRING"))
    return table(spark, d, "orders").select("o_orderkey", standardise.as_int(v).alias("i"), standardise.as_number(v).alias("n"), standardise.as_bool(v).alias("b"))


@query("""SELECT source_system, source_key, len(list_filter(addresses, lambda a: a IS NOT NULL AND coalesce(nullif(trim(a.kind), ''), nullif(trim(a.line1), ''), nullif(trim(a.city), ''), nullif(trim(a.postcode), ''), nullif(trim(a.country), '')) IS NOT NULL)) AS entries FROM person_records WHERE addresses IS NOT NULL""")
def group_entries(spark, d):
    rows = table(spark, d, "person_records").where("addresses is not null")
    return rows.select("source_system", "source_key", F.coalesce(F.size(standardise.clean_entries(F.col("addresses"), ("kind", "line1", "city", "postcode", "country"))), F.lit(0)).cast("bigint").alias("entries"))


@query("SELECT source_system, source_key, coalesce(nullif(trim(regexp_replace(coalesce(given_name, '') || ' ' || coalesce(substr(family_name, 1, 1) || '***', ''), '\\s+', ' ', 'g')), ''), source_key) AS shown FROM person_records")
def display_names(spark, d):
    return table(spark, d, "person_records").select("source_system", "source_key", standardise.display_name(PERSON.display, ("family_name",)).alias("shown"))


_CANON = "'{' || array_to_string(list_transform(list_sort(map_keys(member_values)), lambda k: CAST(to_json(k) AS VARCHAR) || ':' || coalesce(CAST(to_json(member_values[k]) AS VARCHAR), 'null')), ',') || '}'"


@query(f"SELECT source_system, source_key, landing_seq, j AS canonical, sha256(j) AS fingerprint FROM (SELECT *, {_CANON} AS j FROM group_members)")
def canonical_members(spark, d):
    j = standardise.canonical_map(F.col("member_values"))
    return table(spark, d, "group_members").select("source_system", "source_key", "landing_seq", j.alias("canonical"), standardise.fingerprint(j).alias("fingerprint"))


@query("SELECT source_system, source_key, email, CASE WHEN source_system <> 'crm' THEN phone END AS phone FROM person_records")
def vault_round_trip(spark, d):
    """Personal values go to the vault and come back; those of crm's telephones were erased there."""
    rows = table(spark, d, "person_records").select("source_system", "source_key", "email", "phone")
    space = Workspace(spark, "vault")
    swapped, vault = standardise.to_vault(rows, ["email", "phone"], ["source_system", "source_key"])
    erased = rows.where("source_system = 'crm'").select(K.derived_id("V", F.lit("phone"), "source_system", "source_key", "phone").alias("value_id")).distinct()
    return standardise.from_vault(space.save(swapped, "swapped"), space.save(vault.join(erased, "value_id", "left_anti"), "vault"), ["email", "phone"])


@query("SELECT subject_ref, CASE WHEN regexp_matches(subject_ref, '^[A-Za-z0-9_.:-]{1,64}$') THEN subject_ref ELSE 'h-' || substr(sha256(subject_ref), 1, 16) END AS token, CASE WHEN regexp_matches(source, '^[A-Za-z0-9_.:-]{1,64}$') THEN source ELSE 'h-' || substr(sha256(source), 1, 16) END AS said, count(*) AS n FROM documents GROUP BY ALL")
def safe_tokens(spark, d):
    rows = table(spark, d, "documents").select("subject_ref", K.safe_token("subject_ref").alias("token"), K.safe_token("source").alias("said"))
    return rows.groupBy("subject_ref", "token", "said").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source_system, source_key, substr(given_name, 1, 1) || '***' AS given_name, substr(birth_date, 1, 1) || '***' AS birth_date, NULL::INTEGER AS n_addresses, country FROM person_records")
def masked_types(spark, d):
    """A personal value that isn't text is hidden whole."""
    rows = table(spark, d, "person_records").withColumn("n_addresses", F.size("addresses"))
    return rows.select("source_system", "source_key", *(K.masked(F.col(c), rows.schema[c].dataType).alias(c) for c in ("given_name", "birth_date", "n_addresses")), "country")


@query("SELECT 'xref' AS view, rec AS id, master_id AS value FROM (SELECT source_system || ':' || source_key AS rec, master_id FROM group_members WHERE master_id IS NOT NULL) UNION ALL SELECT 'relationship', source_system || ':' || source_key, employer FROM person_records WHERE employer IS NOT NULL")
def passthrough_views(spark, d):
    """Views that show their tables as they are: cross-references and relationships carry no personal values."""
    rec = F.concat_ws(":", "source_system", "source_key")
    xref = table(spark, d, "group_members").where("master_id is not null").select(F.lit("xref").alias("view"), rec.alias("id"), F.col("master_id").alias("value"))
    return xref.unionAll(table(spark, d, "person_records").where("employer is not null").select(F.lit("relationship"), rec, "employer"))


@query("""SELECT source_key, CASE WHEN len(addresses) > 0 THEN array_to_string(list_transform(addresses, lambda a: a.kind || ': ' || array_to_string(list_filter([a.line1, a.city, a.postcode, a.country], lambda x: x IS NOT NULL AND x <> ''), ', ')), '; ') END AS shown FROM person_records
    WHERE len(list_filter(addresses, lambda a: a IS NULL OR a.kind IS NULL OR a.kind = '' OR coalesce(nullif(a.line1, ''), nullif(a.city, ''), nullif(a.postcode, ''), nullif(a.country, '')) IS NULL)) = 0""")
def group_texts(spark, d):
    """Repeating groups as they are shown."""
    rows = table(spark, d, "person_records")
    whole = ~F.exists("addresses", lambda a: a.isNull() | F.coalesce(a["kind"] == "", F.lit(True)) | F.coalesce(*(F.nullif(a[f], F.lit("")) for f in ("line1", "city", "postcode", "country"))).isNull())
    return rows.where(whole).select("source_key", standardise.entries_text(F.col("addresses"), ("kind", "line1", "city", "postcode", "country")).alias("shown"))


@query("""SELECT left_key, 'TASK-' || substr(sha256('review|' || entity || '|' || left_system || ':' || left_key), 1, 16) AS task, 'SMP-' || substr(sha256(entity || '|' || left_system || ':' || left_key || '|' || coalesce(band, 'unset')), 1, 16) AS sample, substr(sha256(coalesce(band, 'unset') || '|' || entity), 1, 32) AS signature_key
    FROM (SELECT DISTINCT entity, left_system, left_key, band FROM pair_scores WHERE left_key IS NOT NULL AND left_system IS NOT NULL)""")
def derived_keys(spark, d):
    rows = table(spark, d, "pair_scores").where("left_key is not null and left_system is not null").select("entity", "left_system", "left_key", "band").distinct()
    rec, band = F.concat_ws(":", "left_system", "left_key"), F.coalesce("band", F.lit("unset"))
    return rows.select("left_key", K.derived_id("TASK", F.lit("review"), "entity", rec).alias("task"), K.derived_id("SMP", "entity", rec, band).alias("sample"), K.group_key(band, "entity").alias("signature_key"))


# --- contract and rules -------------------------------------------------------------------------

_ATTRS = {
    "person": {"given_name": "text", "family_name": "text", "birth_date": "date", "email": "text", "phone": "text", "postcode": "text", "city": "text", "country": "text", "person_ref": "text", "addresses": "group", "employer": "reference", "left_on": "date"},
    "organisation": {"name": "text", "registered_id": "text", "phone": "text", "email": "text", "website": "text", "postcode": "text", "city": "text", "country": "text", "addresses": "group", "parent": "reference", "closed_on": "date"},
}


def _kinds_sql(e: str) -> str:
    wrong = lambda a, t: f"(json_type(payload, '$.{a}') NOT IN ('ARRAY', 'NULL') OR len(list_filter(CAST(CASE WHEN json_type(payload, '$.{a}') = 'ARRAY' THEN json_extract(payload, '$.{a}[*]') ELSE [] END AS JSON[]), lambda x: json_type(x) <> 'OBJECT')) > 0)" if t == "group" else f"json_type(payload, '$.{a}') IN ({repr(('OBJECT', 'ARRAY', 'BOOLEAN') if t == 'reference' else ('OBJECT', 'ARRAY'))[1:-1]})"
    return "list_filter([" + ", ".join(f"CASE WHEN {wrong(a, t)} THEN '{a}' END" for a, t in _ATTRS[e].items()) + "], lambda x: x IS NOT NULL)"


_KNOWN = {e: "[" + ", ".join(f"'{a}'" for a in (*attrs, "master_id")) + "]" for e, attrs in _ATTRS.items()}
_FIRST_BREACH = cat.SQL["payload_contract_rejects"].split("SELECT source_system, ", 1)[1].split(" AS reason FROM", 1)[0]
_LONG = "len(list_filter(json_keys(payload), lambda k: length(json_extract_string(payload, k)) > 4000 AND json_type(payload, k) = 'VARCHAR')) > 0"


@query(f"""WITH p AS (SELECT landing_seq, entity, op, CASE WHEN json_valid(payload) THEN payload END AS payload, {_FIRST_BREACH} AS first_ FROM landing_rows),
q AS (SELECT *, CASE WHEN first_ IS NULL THEN coalesce(CASE entity WHEN 'person' THEN list_filter(json_keys(payload), lambda k: NOT list_contains({_KNOWN['person']}, k)) ELSE list_filter(json_keys(payload), lambda k: NOT list_contains({_KNOWN['organisation']}, k)) END, []) ELSE [] END AS unknown_,
    CASE WHEN first_ IS NULL AND op = 'upsert' THEN CASE entity WHEN 'person' THEN {_kinds_sql('person')} ELSE {_kinds_sql('organisation')} END ELSE [] END AS wrong FROM p)
SELECT landing_seq, CASE WHEN first_ IS NOT NULL THEN first_ WHEN {_LONG} THEN 'too_large' WHEN len(unknown_) > 0 THEN 'bad_payload' WHEN len(wrong) > 0 THEN 'bad_type' END AS reason,
    array_to_string(list_sort(CASE WHEN first_ IS NOT NULL OR {_LONG} THEN [] WHEN len(unknown_) > 0 THEN unknown_ ELSE wrong END), ',') AS attributes FROM q""")
def landing_contract(spark, d):
    """Every landed row against the contract and its entity's model."""
    rows = table(spark, d, "landing_rows")
    got = land.contract(rows, _ATTRS, cat.SOURCES, cat.S_VERSIONED, ("kind", "line1", "city", "postcode", "country"))
    return got.select("landing_seq", "reason", F.array_join("attributes", ",").alias("attributes"))


TODAY = "2025-06-01"
RULES = [
    quality.Rule("PER-V1", "family_name", "required", "completeness", "hold"), quality.Rule("PER-V3", "birth_date", "range", "validity", low="1950-01-02", high="today"), quality.Rule("PER-V4", "birth_date", "placeholder", "accuracy"),
    quality.Rule("PER-V5", "person_ref", "checksum", "validity", scheme="PERSON_REF"), quality.Rule("PER-V6", "country", "code_list", "validity", codes=("QM", "QN", "QO", "QP")), quality.Rule("PER-V7", "email", "pattern", "validity", "hold", pattern="email"),
]
_RULED = f"""WITH s AS (SELECT *, CASE WHEN {_BLANK('family_name')} OR {cat._fold_sql('family_name')} IS NULL THEN NULL ELSE family_name END AS fam, CASE WHEN NOT coalesce({_HOLD}, false) THEN iso END AS born FROM ({_STD}))
    SELECT source_system, source_key, 'PER-V1' AS rule_id, CASE WHEN fam IS NULL THEN 'missing' ELSE 'ok' END AS code FROM s
    UNION ALL SELECT source_system, source_key, 'PER-V3', CASE WHEN born < '1950-01-02' OR born > '{TODAY}' THEN 'out_of_range' ELSE 'ok' END FROM s
    UNION ALL SELECT source_system, source_key, 'PER-V4', CASE WHEN {_HOLD} THEN 'placeholder' ELSE 'ok' END FROM s
    UNION ALL SELECT source_system, source_key, 'PER-V5', CASE WHEN ref IS NOT NULL AND NOT coalesce(CASE WHEN regexp_matches(ref, '^\\d+$') THEN {_LUHN.format(c='ref')} ELSE false END, false) THEN 'bad_checksum' ELSE 'ok' END FROM s
    UNION ALL SELECT source_system, source_key, 'PER-V6', CASE WHEN {_BLANK('country')} OR country IN ('QM', 'QN', 'QO', 'QP') THEN 'ok' ELSE 'not_in_code_list' END FROM s
    UNION ALL SELECT source_system, source_key, 'PER-V7', CASE WHEN {_BLANK('raw_email')} OR email IS NOT NULL THEN 'ok' ELSE 'bad_pattern' END FROM s"""


def _checked(spark, d):
    return quality.check(_std(spark, d), RULES, TODAY, {"email": "m_email", "country": "m_country"})


@query(f"SELECT rule_id, code, source_system, count(*) AS n FROM ({_RULED}) GROUP BY ALL")
def quality_rules(spark, d):
    return _checked(spark, d).groupBy("rule_id", "code", "source_system").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT source_system, source_key, string_agg(rule_id, ',' ORDER BY rule_id) AS rules FROM ({_RULED}) WHERE code <> 'ok' AND rule_id IN ('PER-V1', 'PER-V7') GROUP BY ALL")
def held_records(spark, d):
    return quality.held(quality.failures(_checked(spark, d))).select("source_system", "source_key", F.array_join("rules", ",").alias("rules"))


@query(f"""SELECT source_system, source_key, rule_id, code FROM ({_RULED}) WHERE code <> 'ok' AND (source_system <> 'crm' OR rule_id <> 'PER-V7')
    UNION ALL SELECT source_system, source_key, 'OLD', 'old' FROM person_records WHERE source_system = 'hr'""")
def replaced_failures(spark, d):
    """Of failures stored before, those of student_records and crm give way; crm's addresses have been mended meanwhile."""
    found = quality.failures(_checked(spark, d)).select("source_system", "source_key", "rule_id", "code")
    stored = table(spark, d, "person_records").select("source_system", "source_key", F.lit("OLD").alias("rule_id"), F.lit("old").alias("code"))
    people = table(spark, d, "person_records").select("source_system", "source_key")
    after = quality.replace_failures(stored, people.where("source_system in ('student_records', 'crm')"), found.where("source_system <> 'hr' and (source_system <> 'crm' or rule_id <> 'PER-V7')"))
    return after.unionByName(found.where("source_system = 'hr'"))


@query("""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderstatus IS DISTINCT FROM s THEN 'o_orderstatus' END, CASE WHEN o_orderpriority IS DISTINCT FROM c THEN 'o_orderpriority' END], lambda x: x IS NOT NULL), ',') AS changed, o_orderstatus IS DISTINCT FROM s AS critical, o_orderpriority IS DISTINCT FROM c AND o_orderpriority IS NOT NULL AS ended
    FROM (SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN 'O' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderpriority END AS c FROM orders) WHERE o_orderstatus IS DISTINCT FROM s OR o_orderpriority IS DISTINCT FROM c""")
def record_changes(spark, d):
    now = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    before = now.select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, "O").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    return quality.changes(before, now, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"], ("o_orderstatus",), "o_orderpriority").withColumn("changed", F.array_join("changed", ","))


# --- scores and estimates ------------------------------------------------------------------------

_VALID = cat._VALID
_RULE = f"CASE WHEN {_VALID.format(c='l_ident')} AND {_VALID.format(c='r_ident')} THEN CASE WHEN l_ident = r_ident THEN 'must_link' ELSE 'cannot_link' END END"
_W = f"SELECT *, {cat._weight_sql()} AS w, {_RULE} AS rule FROM ({cat._SCORED})"


def _ruled(spark, d):
    ids = lambda c: F.when(F.coalesce(K.mod97_valid(c), F.lit(False)), F.array(c))
    return cat._scored(spark, d).withColumn("rule", pairs.hard_rule(ids("l_ident"), ids("r_ident")))


@query(f"SELECT left_rec, right_rec, CASE rule WHEN 'cannot_link' THEN 'none' WHEN 'must_link' THEN 'auto' ELSE {cat._BAND} END AS band, round(w, 6) AS weight, 0.0::DOUBLE AS residual, rule FROM ({_W})")
def pair_explanations(spark, d):
    e = pairs.explain(_ruled(spark, d), cat.RULES, {"identifier": ("cannot_link", "must_link")}, "rule")
    total = F.col("prior") + F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x["weight"])
    return e.select("left_rec", "right_rec", "band", F.round("weight", 6).alias("weight"), F.round(F.abs(total - F.col("weight")), 9).alias("residual"), "rule")


def _lower_sql() -> str:
    rank = lambda w: f"CASE WHEN {w} >= {cat.RULES.edge(90.0)!r} THEN 2 WHEN {w} >= {cat.RULES.edge(60.0)!r} THEN 1 ELSE 0 END"
    parts = []
    for i, (c, ws) in enumerate(cat.RULES.weights.items()):
        own = f"(CASE {c} " + " ".join(f"WHEN {k} THEN CAST({w!r} AS DOUBLE)" for k, w in enumerate(ws)) + " ELSE 0 END)"
        for k, w in enumerate(ws):
            to = "0" if c == "identifier" and k == len(ws) - 1 else "2" if c == "identifier" and k == 0 else rank(f"(w - {own} + ({w!r}))")
            parts.append(f"SELECT left_rec, right_rec, round(abs({w!r} - {own}), 9) AS far, {i} AS i, {k} AS level, '{c}' AS comparison FROM s WHERE rule IS NULL AND {c} <> {k} AND {to} < {rank('w')}")
    return " UNION ALL ".join(parts)


@query(f"WITH s AS ({_W}), o AS ({_lower_sql()}), r AS (SELECT *, row_number() OVER (PARTITION BY left_rec, right_rec ORDER BY far, i, level) AS rn FROM o) SELECT s.left_rec, s.right_rec, r.comparison || ':' || r.level AS lower_by FROM s LEFT JOIN r ON r.rn = 1 AND r.left_rec = s.left_rec AND r.right_rec = s.right_rec")
def pair_lowering(spark, d):
    e = pairs.explain(_ruled(spark, d), cat.RULES, {"identifier": ("cannot_link", "must_link")}, "rule")
    return e.select("left_rec", "right_rec", "lower_by")


@query(f"SELECT left_rec, right_rec, rule FROM ({_W}) WHERE w >= {cat.RULES.edge(60.0)!r} OR rule IS NOT NULL")
def worth_explaining(spark, d):
    return quality.worth_explaining(_ruled(spark, d).withColumn("weight", cat.RULES.weight()), cat.RULES.edge(60.0)).select("left_rec", "right_rec", "rule")


_PROBE = f"WITH k AS ({cat._KEYS}), f AS (SELECT min(rec) AS rec FROM k), one AS (SELECT pass, key FROM k WHERE rec = (SELECT rec FROM f)), c AS (SELECT rec, count(DISTINCT pass) AS passes FROM k JOIN one USING (pass, key) GROUP BY rec ORDER BY passes DESC, rec LIMIT 200)"
_TESTED = f"SELECT c.rec, c.passes, {', '.join(f'l.{x} AS l_{x}, r.{x} AS r_{x}' for x in cat._COMPARED)} FROM c JOIN ({cat._ORG}) r ON r.rec = c.rec JOIN ({cat._ORG}) l ON l.rec = (SELECT rec FROM f)"


@query(f"{_PROBE}, t AS ({_TESTED}), v AS (SELECT rec, passes, {', '.join(f'{cat.LEVELS_SQL[c]} AS {c}' for c in cat.RULES.weights)} FROM t), w AS (SELECT *, {cat._weight_sql()} AS w FROM v) SELECT rec, passes, round(w, 6) AS weight, {cat._BAND} AS band, {cat._signature_sql()} AS signature FROM w ORDER BY w DESC, rec LIMIT 100")
def match_test(spark, d):
    """One payload, here the first record's, against what is stored: candidates by its keys, scored and explained, the best hundred."""
    keys, orgs = cat._keys(spark, d), cat._orgs(spark, d)
    first = keys.agg(F.min("rec").alias("rec"))
    found = pairs.probe_candidates(keys.join(F.broadcast(first), "rec", "left_semi"), keys, "rec", 200)
    probe = orgs.join(F.broadcast(first), "rec", "left_semi").select(*(F.col(c).alias(f"l_{c}") for c in cat._COMPARED))
    sides = found.join(orgs.select("rec", *(F.col(c).alias(f"r_{c}") for c in cat._COMPARED)), "rec").join(F.broadcast(probe))  # a single row
    told = pairs.explain(sides.select("rec", "passes", *(cat._level(c).alias(c) for c in cat.RULES.weights)), cat.RULES)
    best = told.orderBy(F.desc("weight"), "rec").limit(100)
    return best.select("rec", "passes", F.round("weight", 6).alias("weight"), "band", "signature")


@query(f"WITH b AS (SELECT left_rec AS rec FROM ({cat._PAIRS}) UNION ALL SELECT right_rec FROM ({cat._PAIRS})) SELECT rec, count(*) - 2 AS dropped FROM b GROUP BY rec HAVING count(*) > 2")
def candidates_dropped(spark, d):
    return pairs.dropped_candidates(cat._candidates(spark, d), 2)


_FORMS = {"name": "name", "city": "city", "postcode": "postcode"}


@query(" UNION ALL ".join(f"SELECT '{c}' AS comparison, round(sum(n * n) / (sum(n) * sum(n)), 9) AS u0 FROM (SELECT {c} AS v, count(*)::DOUBLE AS n FROM ({cat._ORG}) WHERE {c} IS NOT NULL AND {c} <> '' GROUP BY 1)" for c in _FORMS))
def value_frequency_squares(spark, d):
    return estimate.value_frequencies(cat._orgs(spark, d), _FORMS).withColumn("u0", F.round("u0", 9))


_HASHED = "SELECT source_system || ':' || source_key AS rec, CAST(('0x' || substr(sha256('person|' || source_system || '|' || source_key), 1, 16))::UBIGINT >> 1 AS BIGINT) AS h FROM person_records"


@query(f"WITH s AS (SELECT rec, row_number() OVER (ORDER BY h, rec) - 1 AS rn FROM ({_HASHED}) ORDER BY h, rec LIMIT 400), k AS (SELECT count(*) // 2 AS half FROM s) SELECT a.rec AS left_rec, b.rec AS right_rec FROM s a, k JOIN s b ON b.rn = a.rn + k.half WHERE a.rn < k.half")
def u_pairs(spark, d):
    rows = table(spark, d, "person_records").select(F.concat_ws(":", "source_system", "source_key").alias("rec"), K.hash63(F.lit("person"), "source_system", "source_key").alias("h"))
    return estimate.u_pairs(rows, 200, ["h", "rec"]).select(F.col("l.rec").alias("left_rec"), F.col("r.rec").alias("right_rec"))


_BYPASS = f"SELECT DISTINCT a.rec AS left_rec, b.rec AS right_rec, a.pass FROM ({cat._KEYS}) a JOIN ({cat._KEYS}) b ON a.pass = b.pass AND a.key = b.key AND a.rec < b.rec"


def _by_pass(spark, d):
    k = cat._keys(spark, d)
    a, b = k.select("pass", "key", F.col("rec").alias("left_rec")), k.select("pass", "key", F.col("rec").alias("right_rec"))
    return a.join(b, ["pass", "key"]).where("left_rec < right_rec").select("left_rec", "right_rec", "pass").distinct()


@query(f"SELECT left_rec, right_rec, min(pass) AS pass FROM ({_BYPASS}) GROUP BY ALL")
def pairs_first_pass(spark, d):
    return estimate.first_pass(_by_pass(spark, d))


@query(f"""WITH p AS ({_BYPASS}), h AS (SELECT *, ('0x' || substr(sha256(left_rec || chr(30) || right_rec), 1, 13))::UBIGINT::DOUBLE / 4503599627370496 AS h FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY pass ORDER BY h, left_rec, right_rec) AS rn, count(*) OVER (PARTITION BY pass) AS n FROM h),
s AS (SELECT pass, CASE WHEN max(n) > 100 THEN max(h) FILTER (WHERE rn <= 100) ELSE 1.0 END AS share FROM r GROUP BY pass), w AS (SELECT left_rec, right_rec, max(share) AS rate FROM r JOIN s USING (pass) GROUP BY ALL)
SELECT left_rec, right_rec, pass, round(1 / greatest(rate, 1e-12), 6) AS weight FROM r JOIN w USING (left_rec, right_rec) WHERE rn <= 100""")
def pairs_sampled(spark, d):
    return estimate.sampled_pairs(_by_pass(spark, d), 100).withColumn("weight", F.round("weight", 6))


_SIZES = {c: len(w) for c, w in cat.RULES.weights.items()}
_EQUAL = f"(l_ident = r_ident AND {_VALID.format(c='l_ident')})"


def _levels(spark, d):
    equal = (F.col("l_ident") == F.col("r_ident")) & F.coalesce(K.mod97_valid("l_ident"), F.lit(False))
    return cat._scored(spark, d).withColumn("strong_equal", F.coalesce(equal, F.lit(False)))


@query(" UNION ALL ".join(f"SELECT '{c}' AS comparison, k AS level, round((count(*) FILTER (WHERE {c} = k) + 1) / (count(*) FILTER (WHERE {c} >= 0) + {n}), 9) AS m FROM (SELECT unnest(range({n}))::INT AS k) LEFT JOIN (SELECT {c} FROM ({cat._SCORED}) WHERE {_EQUAL}) ON true GROUP BY k" for c, n in _SIZES.items() if c != "identifier"))
def m_from_identifier(spark, d):
    return estimate.m_from_identifier(_levels(spark, d), _SIZES, "identifier").withColumn("m", F.round("m", 9))


@query()
def estimate_weights(spark, d):
    """New chances of every level, and the prior, from passes and random pairs of the organisations."""
    space = Workspace(spark, "estimate")
    by = estimate.sampled_pairs(_by_pass(spark, d), 20_000)
    levels = space.save(by.join(_levels(spark, d), ["left_rec", "right_rec"]), "levels")
    passes = {p: levels.where(F.col("pass") == p) for p in ("ident", "name_post", "phone7")}
    fixed = estimate.fixed_comparisons({"ident": ["id(ident)"], "name_post": ["postcode", "first(name,4)"], "phone7": ["last(phone,7)"]}, {"identifier": "ident", "levenshtein": "name", "postcode": "postcode", "phone": "phone", "exact": "city"})
    orgs = cat._orgs(spark, d)
    hashed = orgs.withColumn("h", F.xxhash64("rec"))
    drawn = estimate.u_pairs(hashed, 5_000, ["h", "rec"])
    sides = drawn.select(*(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "lr" for c in cat._COMPARED))
    random = sides.select(*(cat._level(c).alias(c) for c in cat.RULES.weights))
    u0 = {r.comparison: r.u0 for r in estimate.value_frequencies(orgs, {"identifier": "ident", "levenshtein": "name", "postcode": "postcode", "phone": "phone", "exact": "city"}).collect()}
    got = estimate.estimate(passes, random, _SIZES, u0, fixed, orgs.count(), strong="identifier")
    rows = [(c, k, round(float(m), 6), round(float(got["u"][c][k]), 9), round(got["prior"], 9)) for c, ms in got["m"].items() for k, m in enumerate(ms)]
    return spark.createDataFrame(rows, "comparison string, level int, m double, u double, prior double")


# --- surviving values ----------------------------------------------------------------------------

PLAN, DEFAULT = {"email": ["recency", "source_trust"], "phone": ["frequency", "source_trust"], "birth_date": ["source_trust", "completeness"]}, ["source_trust", "recency"]
_ORDER = {"source_trust": ["coalesce(trust, 1000000)"], "recency": ["occurred_at DESC NULLS LAST", "landing_seq DESC NULLS LAST"], "completeness": ["length(value) DESC"], "frequency": ["freq DESC"]}
_SAME = {"source_trust": "coalesce(trust, 1000000) IS DISTINCT FROM coalesce(lead(trust) OVER w, 1000000)", "recency": "occurred_at IS DISTINCT FROM lead(occurred_at) OVER w OR landing_seq IS DISTINCT FROM lead(landing_seq) OVER w",
         "completeness": "length(value) <> length(lead(value) OVER w)", "frequency": "freq <> lead(freq) OVER w"}


def _survive_sql() -> str:
    source = f"SELECT *, count(*) OVER (PARTITION BY master_id, attr_name, lower(trim(value))) AS freq FROM ({cat._TRUSTED})"
    parts = []
    for names, plan in [(f"attr_name = '{a}'", p) for a, p in PLAN.items()] + [(f"attr_name NOT IN ({', '.join(map(repr, PLAN))})", DEFAULT)]:
        order = ", ".join(o for s in plan for o in _ORDER[s])
        told = " ".join(f"WHEN {_SAME[s]} THEN '{s}'" for s in plan)
        parts.append(f"""SELECT master_id, attr_name, value, source_system || ':' || source_key AS source, CASE WHEN n = 1 THEN 'only' ELSE told END AS decided_by, least(n - 1, 5) AS runners FROM (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY master_id, attr_name) AS n, CASE {told} ELSE 'tie_break' END AS told
            FROM ({source}) WHERE {names} WINDOW w AS (PARTITION BY master_id, attr_name ORDER BY {order}, source_system, source_key, value)) WHERE rn = 1""")
    return " UNION ALL ".join(parts)


def _survived(spark, d, stewards=None, now=None):
    return survive.survive(cat._offers(spark, d), PLAN, DEFAULT, stewards, 0, now)


@query(_survive_sql())
def survive_by_model(spark, d):
    return _survived(spark, d).select("master_id", "attr_name", "value", "source", "decided_by", F.size("runners_up").cast("bigint").alias("runners"))


_PINNED = "SELECT DISTINCT master_id, 'city' AS attr_name, 'Pinned ' || right(master_id, 1) AS value FROM group_members WHERE right(master_id, 1) IN ('3', '7')"


@query(f"SELECT coalesce(p.master_id, s.master_id) AS master_id, coalesce(p.attr_name, s.attr_name) AS attr_name, coalesce(p.value, s.value) AS value, CASE WHEN p.value IS NOT NULL THEN 'pin' ELSE s.decided_by END AS decided_by FROM ({_survive_sql()}) s FULL JOIN ({_PINNED}) p ON p.master_id = s.master_id AND p.attr_name = s.attr_name")
def survive_pinned(spark, d):
    """A steward's pin on the city of some masters holds; one that has run out is ignored with its value."""
    now = datetime.datetime(2025, 6, 1, tzinfo=datetime.timezone.utc)
    m = table(spark, d, "group_members").select("master_id").distinct()
    until = F.when(F.right("master_id", F.lit(1)).isin("3", "7"), F.lit(now + datetime.timedelta(days=1))).otherwise(F.lit(now - datetime.timedelta(days=1)))
    stewards = m.where("right(master_id, 1) in ('3', '7', '9')").select("master_id", F.lit("city").alias("attr_name"), F.concat(F.lit("Pinned "), F.right("master_id", F.lit(1))).alias("value"), F.lit(now).alias("set_at"), until.alias("pinned_until"))
    return _survived(spark, d, stewards, now).select("master_id", "attr_name", "value", "decided_by")


@query(f"""SELECT master_id, attr_name, CASE decided_by WHEN 'only' THEN source || ' is the only source with a value.' WHEN 'tie_break' THEN source || ' comes first by name among equals.'
    ELSE source || CASE decided_by WHEN 'source_trust' THEN ' is the most trusted source' WHEN 'recency' THEN ' has the latest value' WHEN 'completeness' THEN ' has the most complete value' ELSE ' has the commonest value' END
        || '; it stands before ' || runners || CASE WHEN runners = 1 THEN ' other value.' ELSE ' other values.' END END AS why FROM ({_survive_sql()})""")
def survive_why(spark, d):
    return survive.why(_survived(spark, d))


_ENTRY = "SELECT employer AS master_id, source_system, source_key, a.kind AS kind, a.line1 AS value FROM (SELECT employer, source_system, source_key, unnest(addresses) AS a FROM person_records WHERE employer IS NOT NULL) WHERE a.kind IS NOT NULL AND trim(a.kind) <> '' AND a.line1 IS NOT NULL AND trim(a.line1) <> ''"


@query(f"""WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY master_id, lower(trim(kind)) ORDER BY length(value) DESC, source_system, source_key, value) AS rn FROM ({_ENTRY})) WHERE rn = 1),
w AS (SELECT master_id, source_system, source_key, count(*) AS n FROM b GROUP BY ALL) SELECT master_id, source_system || ':' || source_key AS source, n AS entries FROM (SELECT *, row_number() OVER (PARTITION BY master_id ORDER BY n DESC, source_system, source_key) AS rn FROM w) WHERE rn = 1""")
def survive_group_winner(spark, d):
    """Of a repeating group united by its key, the source that won most entries."""
    rows = table(spark, d, "person_records").where("employer is not null").select(F.col("employer").alias("master_id"), "source_system", "source_key", F.explode("addresses").alias("a"))
    entries = rows.select("master_id", "source_system", "source_key", "a.kind", F.col("a.line1").alias("value"))
    return survive.keyed_union(entries, ["completeness"], "kind")[1]


@query("""SELECT master_id, source_system, source_key, filled FROM (SELECT *, row_number() OVER (PARTITION BY master_id ORDER BY filled DESC, source_system, source_key) AS rn FROM (SELECT employer AS master_id, source_system, source_key,
    list_sum(list_transform(addresses, lambda a: (a.kind IS NOT NULL)::INT + (a.line1 IS NOT NULL)::INT + (a.city IS NOT NULL)::INT + (a.postcode IS NOT NULL)::INT + (a.country IS NOT NULL)::INT))::BIGINT AS filled FROM person_records WHERE employer IS NOT NULL AND len(addresses) > 0)) WHERE rn = 1""")
def survive_whole_group(spark, d):
    count = lambda a: sum((a[f].isNotNull().cast("bigint") for f in ("line1", "city", "postcode", "country")), a["kind"].isNotNull().cast("bigint"))
    rows = table(spark, d, "person_records").where("employer is not null and size(addresses) > 0").select(F.col("employer").alias("master_id"), "source_system", "source_key", F.to_json("addresses").alias("value"), F.aggregate("addresses", F.lit(0).cast("bigint"), lambda s, a: s + F.coalesce(count(a), F.lit(0))).alias("filled"))
    return survive.whole_group(rows, ["completeness"]).select("master_id", "source_system", "source_key", "filled")


# --- publishing --------------------------------------------------------------------------------------

_EDGES = "SELECT c_custkey AS r, c_custkey // 3 AS s FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 17 <> 0 AND (c_custkey // 3) % 17 <> 0 AND c_custkey // 3 > 0"
_ENDSQL = "WITH RECURSIVE e AS ({e}), w(r, s, n) AS (SELECT r, s, 1 FROM e UNION ALL SELECT w.r, e.s, n + 1 FROM w JOIN e ON e.r = w.s), t AS (SELECT r, min_by(s, -n) AS s FROM w GROUP BY r)"


def _golden(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("master_id"))
    return c.select("master_id", F.when(F.col("c_custkey") % 17 == 0, "retired").otherwise("active").alias("status"), F.lit(None).cast("string").alias("survivor_id"), F.lit(1).alias("row_version"))


def _merged(spark, d):
    wanted = table(spark, d, "customer").where("c_custkey % 5 <> 0").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("retired_id"), F.concat(F.lit("C"), F.expr("c_custkey div 3").cast("string")).alias("survivor_id"))
    xref = table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("rec"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("master_id"))
    none = spark.createDataFrame([], "retired_id string, merged_into string, survivor_id string, active boolean")
    return xref, publish.merge(_golden(spark, d), xref, none, wanted)


@query(f"{_ENDSQL.format(e=_EDGES)} SELECT 'C' || c_custkey AS retired_id, 'C' || t.s AS survivor_id, CASE WHEN t.s IS NULL THEN 'not_active' END AS reason FROM customer LEFT JOIN t ON t.r = c_custkey WHERE c_custkey % 5 <> 0")
def merge_masters(spark, d):
    out = _merged(spark, d)[1]
    return out["retired"].select("retired_id", "survivor_id", F.lit(None).cast("string").alias("reason")).unionAll(out["refused"].select("retired_id", F.lit(None).cast("string"), "reason"))


_MARKS = f"""{_ENDSQL.format(e=_EDGES)}, has AS (SELECT DISTINCT o_custkey AS r FROM orders), m AS (SELECT 'C' || t.r AS master_id, 'merged' AS kind, 'C' || t.s AS survivor_id, CASE WHEN has.r IS NULL THEN 'status,survivor' ELSE 'xref,status,survivor' END AS parts FROM t LEFT JOIN has ON has.r = t.r
    UNION ALL SELECT DISTINCT 'C' || s, 'updated', NULL, 'xref' FROM t) SELECT master_id, kind AS change_kind, survivor_id, parts, row_number() OVER (ORDER BY master_id) AS change_seq FROM m"""


@query(_MARKS)
def merge_change_rows(spark, d):
    marks = _merged(spark, d)[1]["marks"].withColumn("entity", F.lit("customer"))
    return publish.change_rows(marks, 1).select("master_id", "change_kind", "survivor_id", F.array_join("parts", ",").alias("parts"), "change_seq")


@query(f"{_ENDSQL.format(e=_EDGES)} SELECT 'C' || coalesce(t.s, o_custkey) AS master_id, count(*) AS members FROM orders LEFT JOIN t ON t.r = o_custkey GROUP BY 1")
def merge_moves_members(spark, d):
    return _merged(spark, d)[1]["xref"].groupBy("master_id").agg(F.count(F.lit(1)).alias("members"))


@query(f"{_ENDSQL.format(e=_EDGES + ' AND c_custkey % 7 <> 0')} SELECT 'C' || r AS retired_id, 'C' || s AS survivor_id FROM t")
def unmerge_masters(spark, d):
    xref, after = _merged(spark, d)
    undone = table(spark, d, "customer").where("c_custkey % 7 = 0").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("retired_id"))
    back = xref.join(undone, F.col("master_id") == F.col("retired_id")).select("retired_id", "rec")
    out = publish.unmerge(after["golden"], after["xref"], after["retired"], undone, back)
    return out["retired"].where("active").select("retired_id", "survivor_id")


@query(f"{_ENDSQL.format(e=_EDGES)} SELECT 'C' || coalesce(a.s, o_custkey) AS from_id, 'C' || coalesce(b.s, o_custkey // 3 + 1) AS to_id, coalesce(a.s, o_custkey) = coalesce(b.s, o_custkey // 3 + 1) AS ended, count(*) AS n FROM orders LEFT JOIN t a ON a.r = o_custkey LEFT JOIN t b ON b.r = o_custkey // 3 + 1 GROUP BY ALL")
def repointed_relationships(spark, d):
    xref, after = _merged(spark, d)
    rel = table(spark, d, "orders").select(F.concat(F.lit("R"), F.col("o_orderkey").cast("string")).alias("rel_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("origin"), F.lit("near").alias("type"), F.concat(F.lit("C"), (F.expr("o_custkey div 3") + 1).cast("string")).alias("to_id"))
    return publish.repoint(rel, after["xref"], after["retired"]).groupBy("from_id", "to_id", "ended").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_ENDSQL.format(e=_EDGES)}, refs AS (SELECT 'C' || c_custkey AS ref, c_custkey AS k, false AS rec FROM customer UNION SELECT 'C-1', NULL, false UNION SELECT 'order:' || o_orderkey, o_custkey, true FROM orders UNION SELECT 'order:-1', NULL, true)
SELECT ref, CASE WHEN k IS NULL THEN 'unknown' WHEN rec THEN 'source' ELSE 'golden' END AS kind, 'C' || coalesce(t.s, k) AS master_id, CASE WHEN NOT rec AND k IS NOT NULL THEN CASE WHEN t.s IS NOT NULL THEN 'merged' WHEN k % 17 = 0 THEN 'retired' END END AS notice FROM refs LEFT JOIN t ON t.r = k""")
def resolved_references(spark, d):
    _, after = _merged(spark, d)
    rec = lambda df: df.withColumn("rec", F.concat(F.lit("order:"), F.expr("substring(rec, 2)")))
    refs = _golden(spark, d).select(F.col("master_id").alias("ref")).unionAll(rec(after["xref"]).select(F.col("rec").alias("ref"))).unionAll(spark.createDataFrame([("C-1",), ("order:-1",)], "ref string"))
    return publish.resolve_refs(refs, after["golden"], after["retired"], rec(after["xref"]), rec(after["xref"]).select("rec"))


@query("SELECT source_system, source_key, 'ORG-' || lpad(CAST(row_number() OVER (ORDER BY source_system, source_key) AS VARCHAR), 6, '0') AS master_id FROM organisation_records")
def allocated_ids(spark, d):
    return publish.new_ids(table(spark, d, "organisation_records").select("source_system", "source_key"), "ORG", ["source_system", "source_key"]).select("source_system", "source_key", "master_id")


@query("SELECT max(batch_no) + 1 AS commit_version FROM landing_rows")
def next_commit(spark, d):
    return publish.next_version(table(spark, d, "landing_rows").select(F.col("batch_no").alias("commit_version")))


_FEED = "SELECT batch_no AS commit_version, landing_seq AS change_seq, entity, source_system || ':' || source_key AS master_id FROM landing_rows WHERE source_key IS NOT NULL"


@query(f"SELECT f.commit_version, f.change_seq, f.master_id, p.city FROM (SELECT * FROM ({_FEED}) WHERE (commit_version, change_seq) > (40, 600) AND commit_version <= 400 AND entity = 'person' ORDER BY commit_version, change_seq LIMIT 300) f LEFT JOIN (SELECT source_system || ':' || source_key AS master_id, city FROM person_records) p USING (master_id)")
def feed_page(spark, d):
    rec = F.concat_ws(":", "source_system", "source_key")
    changes = table(spark, d, "landing_rows").where("source_key is not null").select(F.col("batch_no").alias("commit_version"), F.col("landing_seq").alias("change_seq"), "entity", rec.alias("master_id"))
    rows = table(spark, d, "person_records").select(F.lit("person").alias("entity"), rec.alias("master_id"), "city")
    return publish.feed_page(changes, rows, 0, (40, 600), "person", 300, 400).select("commit_version", "change_seq", "master_id", "city")


@query("""SELECT o_orderkey, CASE WHEN s IS NULL THEN 'insert' WHEN o_orderkey % 19 = 0 THEN 'delete' ELSE 'update' END AS op, CASE WHEN s IS NULL OR o_orderkey % 19 = 0 THEN 2 ELSE 1 END AS n FROM (SELECT *, CASE WHEN o_orderkey % 23 <> 0 THEN 'x' END AS s FROM orders) WHERE NOT (s IS NULL AND o_orderkey % 19 = 0) AND (s IS NULL OR o_orderkey % 19 = 0 OR o_orderkey % 13 = 0)""")
def before_after(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    before = rows.where("o_orderkey % 23 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 13 == 0, F.col("o_totalprice") - 1).otherwise(F.col("o_totalprice")))
    got = publish.before_after(before, rows.where("o_orderkey % 19 <> 0"), ["o_orderkey"], ["o_orderstatus", "o_totalprice"])
    return got.select("o_orderkey", "op", F.size("changed").alias("n"))


@query("SELECT landing_seq AS item, min(landing_seq) OVER (PARTITION BY coalesce(entity, '?'), coalesce(source_system, '?'), coalesce(source_key, '#' || landing_seq)) AS unit FROM landing_rows")
def commit_units(spark, d):
    """Changes of one record commit together."""
    key = F.when(F.col("source_key").isNotNull(), F.concat_ws("|", F.coalesce("entity", F.lit("?")), F.coalesce("source_system", F.lit("?")), "source_key"))
    return publish.commit_units(table(spark, d, "landing_rows").select(F.col("landing_seq").alias("item"), key.alias("anchor")))


@query(f"""WITH c AS (SELECT batch_no AS v, max(landed_at) AS moment FROM landing_rows GROUP BY 1), e AS (SELECT source_system || ':' || source_key AS master_id, c.moment, op AS what, 'batch' AS who, batch_no AS v FROM landing_rows JOIN c ON c.v = batch_no WHERE source_key IS NOT NULL
    UNION ALL SELECT left_system || ':' || left_key, scored_at, coalesce(band, 'unset'), 'rule ' || rule_version, NULL FROM pair_scores WHERE left_key IS NOT NULL)
SELECT master_id, epoch_us(moment) AS moment, what, who, row_number() OVER (PARTITION BY master_id ORDER BY moment DESC NULLS LAST, v DESC NULLS LAST, what NULLS FIRST, who NULLS FIRST) AS place FROM e""")
def record_timeline(spark, d):
    rec = lambda s: F.concat_ws(":", f"{s}_system", f"{s}_key")
    rows = table(spark, d, "landing_rows")
    commits = rows.groupBy(F.col("batch_no").alias("commit_version")).agg(F.max("landed_at").alias("committed_at"), F.lit("batch").alias("actor"))
    changes = rows.where("source_key is not null").select("batch_no", rec("source").alias("master_id"), F.col("op").alias("change_kind")).withColumnRenamed("batch_no", "commit_version")
    said = table(spark, d, "pair_scores").where("left_key is not null").select(rec("left").alias("master_id"), F.col("scored_at").alias("decided_at"), F.coalesce("band", F.lit("unset")).alias("decision"), F.concat(F.lit("rule "), F.col("rule_version").cast("string")).alias("decided_by"))
    return publish.timeline(changes, commits, said).select("master_id", F.unix_micros("at").alias("moment"), "what", "who", "place")


@query(f"""WITH h AS (SELECT source_system || ':' || source_key AS rec, op, event_id, occurred_at, landing_seq FROM landing_rows WHERE source_key IS NOT NULL AND source_system IS NOT NULL), s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY landing_seq DESC) AS rn FROM h) WHERE rn = 1),
p AS (SELECT rec, count(*) AS events, max(occurred_at) AS latest FROM h GROUP BY rec), f AS (SELECT source_system || ':' || source_key AS rec, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS failed FROM ({cat._FAILURES_SQL}) GROUP BY 1)
SELECT s.rec, s.op, s.event_id, CASE WHEN q.rec IS NOT NULL THEN 'M' || right(s.rec, 4) END AS master_id, p.events, epoch_us(p.latest) AS latest, f.failed FROM s JOIN p USING (rec) LEFT JOIN f USING (rec) LEFT JOIN (SELECT source_system || ':' || source_key AS rec FROM person_records) q USING (rec)""")
def source_record_view(spark, d):
    rec = F.concat_ws(":", "source_system", "source_key").alias("rec")
    history = table(spark, d, "landing_rows").where("source_key is not null and source_system is not null").select(rec, "op", "event_id", "occurred_at", "landing_seq")
    states = land.latest_by(history.select("rec", "landing_seq", "op", "event_id"), ["rec"], ["landing_seq"])
    xref = table(spark, d, "person_records").select(rec).withColumn("master_id", F.concat(F.lit("M"), F.right("rec", F.lit(4))))
    bad = cat._failures(spark, d).select(rec, "rule_id")
    return publish.source_record(states, history, bad, xref).withColumn("latest", F.unix_micros("latest"))


_LABEL = f"SELECT least(a, b) AS a, greatest(a, b) AS b, CASE WHEN score >= 90 THEN 'match' ELSE 'not_a_match' END AS label, moment, score AS entry FROM (SELECT left_system || ':' || left_key AS a, right_system || ':' || right_key AS b, score, scored_at AS moment FROM pair_scores WHERE score IS NOT NULL AND NOT isnan(score) AND left_key IS NOT NULL AND right_key IS NOT NULL)"


@query(f"SELECT a, b, label, entry FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY moment DESC NULLS LAST, entry DESC) AS rn FROM ({_LABEL})) WHERE rn = 1 AND entry >= 50")
def labels_latest(spark, d):
    """The last label of each pair; entries under 50 have been withdrawn since."""
    rec = lambda s: F.concat_ws(":", f"{s}_system", f"{s}_key")
    rows = table(spark, d, "pair_scores").where("score is not null and not isnan(score) and left_key is not null and right_key is not null and left_system is not null and right_system is not null")
    labels = rows.select(rec("left").alias("a"), rec("right").alias("b"), F.when(F.col("score") >= 90, "match").otherwise("not_a_match").alias("label"), F.col("scored_at").alias("decided_at"), F.col("score").alias("entry"))
    gone = labels.where("entry < 50").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "entry")
    return publish.withdraw_labels(publish.latest_labels(labels), gone).select("a", "b", "label", "entry")


@query(f"WITH k AS ({cat._KEYS}), h AS (SELECT rec, pass, CASE WHEN pass = 'phone7' THEN left(key, 5) ELSE key END AS key FROM k WHERE pass <> 'ident') SELECT *, 'add' AS op FROM (SELECT * FROM k EXCEPT SELECT * FROM h) UNION ALL SELECT *, 'remove' FROM (SELECT * FROM h EXCEPT SELECT * FROM k)")
def key_differences(spark, d):
    want = cat._keys(spark, d)
    have = want.where("pass <> 'ident'").withColumn("key", F.when(F.col("pass") == "phone7", F.substring("key", 1, 5)).otherwise(F.col("key")))
    return publish.key_difference(have, want)


@query("SELECT least(count(*), 1000) AS n, count(*) > 1000 AS more FROM orders WHERE o_orderstatus = 'O'")
def capped_count(spark, d):
    return publish.capped_count(table(spark, d, "orders").where("o_orderstatus = 'O'"), 1000)


@query("SELECT entity, coalesce(band, 'unset') AS state, count(*) AS n, max(rule_version) AS version FROM pair_scores GROUP BY ALL")
def state_counts(spark, d):
    return table(spark, d, "pair_scores").groupBy("entity", F.coalesce("band", F.lit("unset")).alias("state")).agg(F.count(F.lit(1)).alias("n"), F.max("rule_version").alias("version"))


_TABLES = ("arrival_queue", "landing_reject", "landing_rows", "person_records", "organisation_records")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in _TABLES))
def table_sizes(spark, d):
    return publish.table_sizes({t: table(spark, d, t) for t in _TABLES})


@query("SELECT row_number() OVER (ORDER BY landing_seq, source_system, source_key, event_id) AS place, landing_seq, event_id FROM (SELECT DISTINCT landing_seq, source_system, source_key, event_id FROM arrival_queue WHERE event_id IS NOT NULL)")
def queue_order(spark, d):
    rows = table(spark, d, "arrival_queue").where("event_id is not null").select("landing_seq", "source_system", "source_key", "event_id").distinct()
    return publish.numbered(rows, ["landing_seq", "source_system", "source_key", "event_id"], "place").select("place", "landing_seq", "event_id")


_REVIEWS = f"SELECT *, CASE WHEN agreed THEN 'automated' ELSE 'steward' END AS origin, band || CASE WHEN agreed THEN '=' ELSE '≠' END AS signature FROM ({cat._REVIEW})"


@query(f"SELECT entity, origin, band, signature, count(*) AS n, CAST(sum(agreed::INT) AS BIGINT) AS agreed FROM ({_REVIEWS}) GROUP BY ALL")
def agreement_counts(spark, d):
    rows = cat._reviews(spark, d).select("*", F.when(F.col("agreed"), "automated").otherwise("steward").alias("origin"), F.concat("band", F.when(F.col("agreed"), "=").otherwise("≠")).alias("signature"))
    return sampling.agreement(rows, ["entity", "origin", "band", "signature"], "agreed").drop("upper")


@query(f"SELECT entity, band, CASE WHEN entity = 'person' THEN upper < 0.98 ELSE upper < 0.9 END AS tripped, CASE WHEN entity = 'person' THEN CASE WHEN upper >= 0.98 THEN 'restore' END ELSE CASE WHEN upper < 0.9 THEN 'trip' END END AS move FROM ({cat.SQL['agreement_wilson']})")
def breaker_moves(spark, d):
    windows = sampling.agreement(cat._reviews(spark, d), ["entity", "band"], "agreed").select("entity", "band", "n", "upper")
    states = windows.where("entity = 'person'").select("entity", "band", F.lit(True).alias("tripped"))
    return publish.breaker(states, windows, 0.9, 0.98)


@query("SELECT list_name, version, code, label FROM (SELECT r_name AS list_name, n_nationkey // 10 AS version, n_name AS code, n_name AS label, max(n_nationkey // 10) OVER (PARTITION BY r_name) AS last FROM nation JOIN region ON n_regionkey = r_regionkey) WHERE version = last")
def code_list_snapshot(spark, d):
    """Lists are loaded in versions; a snapshot has each list's last one."""
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("list_name"), F.expr("n_nationkey div 10").alias("version"), F.col("n_name").alias("code"), F.col("n_name").alias("label"))
    lists = codelists.CodeLists(spark)
    for version in range(3):
        lists.load(rows.where(F.col("version") == version).select("list_name", "code", "label"), version)
    return lists.snapshot()
