"""Queries of the operators for landing, standardising, pairing and golden records, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from goldspan.functions import keys as K
from goldspan.functions import likeness as L
from goldspan.functions import standard as S
from goldspan.operators import golden, landing, pairs, profile, sampling
from goldspan.runtime import Workspace, table
from goldspan.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def day_first():
    return F.col("source_system").isin(*S.DAY_FIRST_SOURCES)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- landing -----------------------------------------------------------------------------


@query("""SELECT user_id, event_id, ts, event_type, value FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def landing_latest_state(spark, d):
    return landing.latest_by(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"])


_GAPS = """SELECT p + 1 AS lo, s - 1 AS hi FROM (SELECT landing_seq AS s, lag(landing_seq) OVER (ORDER BY landing_seq) AS p
    FROM (SELECT DISTINCT landing_seq FROM landing_rows)) WHERE s - p > 1"""


@query(_GAPS)
def landing_gaps(spark, d):
    return landing.gaps(table(spark, d, "landing_rows"), "landing_seq")


_OPEN = "SELECT p + 1 AS lo, s - 1 AS hi FROM (SELECT landing_seq AS s, lag(landing_seq) OVER (ORDER BY landing_seq) AS p FROM (SELECT DISTINCT landing_seq FROM landing_reject)) WHERE s - p > 1"


def _open_gaps(spark, d):
    """What the refused rows leave open: long, adjacent and uneven ranges."""
    return landing.gaps(table(spark, d, "landing_reject"), "landing_seq")


@query(f"""WITH g AS ({_OPEN}), a AS (SELECT DISTINCT landing_seq AS s FROM arrival_queue),
marks AS (SELECT lo, hi, s AS x FROM g JOIN a ON s BETWEEN lo AND hi UNION SELECT lo, hi, lo - 1 FROM g UNION SELECT lo, hi, hi + 1 FROM g),
cut AS (SELECT x, lead(x) OVER (PARTITION BY lo, hi ORDER BY x) AS nx FROM marks)
SELECT x + 1 AS lo, nx - 1 AS hi FROM cut WHERE nx - x > 1""")
def landing_gap_split(spark, d):
    return landing.split_gaps(_open_gaps(spark, d), table(spark, d, "arrival_queue"), "landing_seq")


@query(f"WITH g AS ({_OPEN}) SELECT landing_seq, event_id, lo, hi FROM landing_rows JOIN g ON landing_seq BETWEEN lo AND hi")
def landing_range_probe(spark, d):
    return landing.range_probe(table(spark, d, "landing_rows").select("landing_seq", "event_id"), _open_gaps(spark, d), "landing_seq")


@query("SELECT source_system, epoch_us(landed_at) // 3600000000 AS hour, count(*) AS n FROM landing_rows GROUP BY ALL")
def hourly_arrivals(spark, d):
    counts = landing.hourly_counts(table(spark, d, "landing_rows"), "landed_at", "source_system")
    return counts.select("source_system", F.expr("unix_seconds(hour) div 3600").alias("hour"), "n")


@query("""WITH c AS (SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL),
m AS (SELECT c.event_type, c.hour, coalesce(sum(p.n), 0) / 7.0 AS usual FROM c LEFT JOIN c p ON p.event_type = c.event_type
    AND p.hour IN (SELECT c.hour - to_days(CAST(i AS INT)) FROM range(1, 8) t(i)) GROUP BY ALL)
SELECT c.event_type, c.hour, c.n, CAST(m.usual AS DOUBLE) AS usual, c.n >= 5 AND c.n >= 2 * m.usual AS spike FROM c JOIN m USING (event_type, hour)""")
def arrival_spike(spark, d):
    return landing.spikes(landing.hourly_counts(table(spark, d, "events"), "ts", "event_type"), "event_type", factor=2.0, least=5)


@query("""SELECT event_id, min(landing_seq) AS landing_seq FROM landing_rows WHERE event_id IS NOT NULL
    AND event_id NOT IN (SELECT event_id FROM landing_reject WHERE event_id IS NOT NULL) GROUP BY event_id""")
def event_dedup_idempotent(spark, d):
    rows = table(spark, d, "landing_rows").where("event_id is not null").select("event_id", "landing_seq")
    return landing.insert_new(table(spark, d, "landing_reject"), rows, "event_id", ["landing_seq"])


@query("""SELECT ts, event_id, user_id, event_type FROM events WHERE (ts, event_id) > (TIMESTAMP '2024-01-10 00:00:00', 0)
    ORDER BY ts, event_id LIMIT 500""")
def feed_page_cursor(spark, d):
    import datetime

    rows = table(spark, d, "events").select("ts", "event_id", "user_id", "event_type")
    after = datetime.datetime(2024, 1, 10) if dict(rows.dtypes)["ts"] == "timestamp_ntz" else datetime.datetime(2024, 1, 10, tzinfo=datetime.timezone.utc)
    return landing.page_after(rows, ["ts", "event_id"], (after, 0), 500)


SOURCES = {"person": ("hr", "student_records", "crm"), "organisation": ("finance", "crm")}


@query("""SELECT reason, source_system, count(*) AS n FROM (SELECT source_system, CASE
    WHEN entity IS NULL OR entity NOT IN ('person', 'organisation') THEN 'unknown_entity'
    WHEN NOT coalesce((entity = 'person' AND source_system IN ('hr', 'student_records', 'crm')) OR (entity = 'organisation' AND source_system IN ('finance', 'crm')), false) THEN 'unknown_source'
    WHEN source_key IS NULL OR trim(source_key) = '' THEN 'missing_key'
    WHEN NOT coalesce(op IN ('upsert', 'delete'), false) THEN 'bad_op'
    WHEN source_system IN ('hr', 'finance') AND source_version IS NULL THEN 'missing_version'
    WHEN op = 'upsert' AND NOT (coalesce(json_valid(payload), false) AND coalesce(regexp_matches(payload, '^\\s*\\{'), false)) THEN 'bad_payload'
    WHEN strlen(payload) > 65536 THEN 'too_large' END AS reason FROM landing_rows) GROUP BY ALL""")
def payload_contract_rejects(spark, d):
    rows = table(spark, d, "landing_rows")
    return rows.select("source_system", landing.reject_reason(SOURCES, S_VERSIONED).alias("reason")).groupBy("reason", "source_system").agg(F.count(F.lit(1)).alias("n"))


S_VERSIONED = ("hr", "finance")


@query("SELECT max(landing_seq) + 1 AS next_seq, count(*) AS n_rows FROM landing_rows")
def landing_next_seq(spark, d):
    return table(spark, d, "landing_rows").agg((F.coalesce(F.max("landing_seq"), F.lit(0)) + 1).alias("next_seq"), F.count(F.lit(1)).alias("n_rows"))


# --- standardising -------------------------------------------------------------------------

_TRANSLATE = "ø:o,æ:ae,œ:oe,ł:l,đ:d,ð:d,þ:th,ı:i,ß:ss".split(",")


def _fold_sql(c: str) -> str:
    out = f"lower({c})"
    for pair in _TRANSLATE:
        a, b = pair.split(":")
        out = f"replace({out}, '{a}', '{b}')"
    return f"nullif(trim(regexp_replace(regexp_replace(strip_accents({out}), '\\p{{M}}+', '', 'g'), '[\\p{{P}}\\p{{S}}\\p{{Z}}\\p{{C}}]+', ' ', 'g')), '')"


@query(f"SELECT source_system, source_key, {_fold_sql('given_name')} AS given, {_fold_sql('family_name')} AS family FROM person_records")
def std_text_fold(spark, d):
    return table(spark, d, "person_records").select("source_system", "source_key", S.fold("given_name").alias("given"), S.fold("family_name").alias("family"))


_FORMS = "|".join(S.LEGAL_FORMS)


@query(f"""WITH t AS (SELECT source_system, source_key, {_fold_sql("replace(replace(name, '&', ' and '), '.', '')")} AS f FROM organisation_records),
b AS (SELECT *, regexp_replace(f, '^(\\S.*?)( (?:{_FORMS}))+$', '\\1') AS bare FROM t)
SELECT source_system, source_key, CASE WHEN len(list_filter(string_split(bare, ' '), lambda w: w NOT IN ('the', 'and', 'of'))) > 0
    THEN array_to_string(list_filter(string_split(bare, ' '), lambda w: w NOT IN ('the', 'and', 'of')), ' ') ELSE bare END AS core,
    nullif(CASE regexp_extract(f, ' ({_FORMS})$', 1) {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in S.LEGAL_FORMS.items())} ELSE '' END, '') AS legal FROM b""")
def std_org_name(spark, d):
    return table(spark, d, "organisation_records").select("source_system", "source_key", S.org_core("name").alias("core"), S.org_legal("name").alias("legal"))


_PHONE = """CASE WHEN digits <> '' AND length(full_) BETWEEN 8 AND 15 THEN '+' || full_ END"""


def _phone_sql(rel: str, keep: str) -> str:
    return f"""SELECT {keep}, {_PHONE} AS phone FROM (SELECT *, CASE WHEN o LIKE '+%' THEN digits WHEN digits LIKE '00%' THEN substr(digits, 3) WHEN digits LIKE '0%' THEN '999' || substr(digits, 2) ELSE '999' || digits END AS full_
    FROM (SELECT *, regexp_replace(o, '\\D', '', 'g') AS digits FROM (SELECT {keep}, CASE WHEN trim(phone) LIKE '+%' THEN replace(trim(phone), '(0)', '') ELSE trim(phone) END AS o FROM {rel})))"""


@query(_phone_sql("person_records", "source_system, source_key"))
def std_phone(spark, d):
    return table(spark, d, "person_records").select("source_system", "source_key", S.phone_e164("phone").alias("phone"))


@query("SELECT source_system, source_key, CASE WHEN regexp_matches(lower(trim(email)), '^[^@\\s]+@[^@\\s.]+(\\.[^@\\s.]+)+$') THEN lower(trim(email)) END AS email FROM person_records")
def std_email(spark, d):
    return table(spark, d, "person_records").select("source_system", "source_key", S.email("email").alias("email"))


@query("SELECT address_id, nullif(regexp_replace(upper(postcode), '[\\s\\-]', '', 'g'), '') AS postcode, substr(nullif(regexp_replace(upper(postcode), '[\\s\\-]', '', 'g'), ''), 1, 3) AS prefix FROM postal_addresses")
def std_postcode(spark, d):
    p = S.postcode("postcode")
    return table(spark, d, "postal_addresses").select("address_id", p.alias("postcode"), F.substring(p, 1, 3).alias("prefix"))


@query("""SELECT source_system, source_key, nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(website)),
    '^[a-z][a-z0-9+.\\-]*://', ''), '[/?#].*$', ''), '^.*@', ''), ':\\d*$', ''), '^\\.+|\\.+$', '', 'g'), '^www\\.', ''), '') AS domain FROM organisation_records""")
def std_url(spark, d):
    return table(spark, d, "organisation_records").select("source_system", "source_key", S.url_domain("website").alias("domain"))


def _date_sql(c: str, first: str) -> str:
    t = f"trim({c})"
    lp = lambda rx, k: f"lpad(regexp_extract({t}, '{rx}', {k}), 2, '0')"
    ymd, packed = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[T ].*)?$", r"^(\d{4})(\d{2})(\d{2})$"
    dmy, dots = r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})$", r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$"
    j = lambda rx, y, m, d: f"regexp_extract({t}, '{rx}', {y}) || '-' || {lp(rx, m)} || '-' || {lp(rx, d)}"
    text = f"CASE WHEN regexp_matches({t}, '{ymd}') THEN {j(ymd, 1, 2, 3)} WHEN regexp_matches({t}, '{packed}') THEN {j(packed, 1, 2, 3)} WHEN regexp_matches({t}, '{dots}') THEN {j(dots, 3, 2, 1)} WHEN regexp_matches({t}, '{dmy}') AND {first} THEN {j(dmy, 3, 2, 1)} WHEN regexp_matches({t}, '{dmy}') THEN {j(dmy, 3, 1, 2)} END"
    return f"CAST(try_cast({text} AS DATE) AS VARCHAR)"


@query(f"SELECT source_system, source_key, {_date_sql('birth_date', 'source_system = ' + chr(39) + 'student_records' + chr(39))} AS born FROM person_records")
def std_date_orders(spark, d):
    return table(spark, d, "person_records").select("source_system", "source_key", S.iso_date("birth_date", day_first()).alias("born"))


@query(f"""SELECT source_system, count(*) AS n FROM (SELECT source_system, {_date_sql('birth_date', 'source_system = ' + chr(39) + 'student_records' + chr(39))} AS b FROM person_records)
    WHERE b = '1900-01-01' OR (source_system = 'student_records' AND b LIKE '%-01-01') GROUP BY 1""")
def placeholder_dates(spark, d):
    iso = S.iso_date("birth_date", day_first())
    rows = table(spark, d, "person_records").select("source_system", iso.alias("b"))
    return rows.where(S.is_placeholder_date(F.col("b"), F.col("source_system"))).groupBy("source_system").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT source_key, nullif(regexp_replace(upper(person_ref), '[\\s.;\\-]', '', 'g'), '') AS id FROM person_records),
d AS (SELECT *, list_reverse(list_transform(string_split(id, ''), lambda x: try_cast(x AS INT))) AS ds FROM t WHERE regexp_matches(id, '^\\d+$'))
SELECT source_key, list_sum(list_transform(ds, lambda x, i: CASE WHEN i % 2 = 1 THEN x WHEN x * 2 > 9 THEN x * 2 - 9 ELSE x * 2 END)) % 10 = 0 AS valid FROM d""")
def id_luhn(spark, d):
    rows = table(spark, d, "person_records").select("source_key", K.registered_id("person_ref").alias("id"))
    return rows.select("source_key", K.luhn_valid("id").alias("valid")).where("valid is not null")


@query("""WITH t AS (SELECT source_key, nullif(regexp_replace(upper(registered_id), '[\\s.;\\-]', '', 'g'), '') AS id FROM organisation_records)
SELECT source_key, CAST(id AS HUGEINT) % 97 = 1 AS valid FROM t WHERE regexp_matches(id, '^\\d+$')""")
def id_mod97(spark, d):
    rows = table(spark, d, "organisation_records").select("source_key", K.registered_id("registered_id").alias("id")).where("id rlike '^[0-9]+$'")
    return rows.select("source_key", K.mod97_valid("id").alias("valid"))


@query("""WITH t AS (SELECT c_custkey, CAST(c_custkey * 1000003 + 17 AS VARCHAR) AS id FROM customer),
d AS (SELECT *, list_reverse(list_transform(string_split(id, ''), lambda x: CAST(x AS INT))) AS ds FROM t),
s AS (SELECT *, (11 - list_sum(list_transform(ds[2:], lambda x, i: x * ((i - 1) % 6 + 2))) % 11) % 11 AS chk FROM d)
SELECT c_custkey, chk <> 10 AND chk = ds[1] AS valid FROM s""")
def id_mod11(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") * 1000003 + 17).cast("string").alias("id"))
    return rows.select("c_custkey", K.mod11_valid("id").alias("valid"))


@query("""SELECT source_system, source_key, CAST(('0x' || substr(sha256('person|' || source_system || '|' || source_key), 1, 16))::UBIGINT >> 1 AS BIGINT) AS h FROM person_records""")
def sample_hash63(spark, d):
    return table(spark, d, "person_records").select("source_system", "source_key", K.hash63(F.lit("person"), "source_system", "source_key").alias("h"))


@query()
def keyed_sample_draw(spark, d):
    rows = table(spark, d, "orders").where(K.drawn(b"goldspan", 0.02, F.lit("order"), "o_orderkey"))
    return rows.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source_key, 'REL-' || substr(sha256(entity || '|' || source_system || '|' || source_key), 1, 16) AS rel FROM (SELECT DISTINCT entity, source_system, source_key FROM group_members)")
def derived_ids(spark, d):
    rows = table(spark, d, "group_members").select("entity", "source_system", "source_key").distinct()
    return rows.select("source_key", K.derived_id("REL", "entity", "source_system", "source_key").alias("rel"))


@query("SELECT source_system, source_key, substr(given_name, 1, 1) || '***' AS given_name, substr(family_name, 1, 1) || '***' AS family_name, country FROM person_records")
def masked_view(spark, d):
    return table(spark, d, "person_records").select("source_system", "source_key", K.mask("given_name").alias("given_name"), K.mask("family_name").alias("family_name"), "country")


# --- quality -----------------------------------------------------------------------------------

_FAILURES_SQL = """SELECT source_system, source_key, rule_id, dimension, code FROM (
    SELECT source_system, source_key, 'email_required' AS rule_id, 'completeness' AS dimension, CASE WHEN email IS NULL OR trim(email) = '' THEN 'missing' ELSE 'ok' END AS code FROM person_records
    UNION ALL SELECT source_system, source_key, 'email_pattern', 'validity', CASE WHEN email IS NULL OR trim(email) = '' OR regexp_matches(lower(trim(email)), '^[^@\\s]+@[^@\\s.]+(\\.[^@\\s.]+)+$') THEN 'ok' ELSE 'pattern' END FROM person_records
    UNION ALL SELECT p.source_system, p.source_key, 'country_known', 'consistency', CASE WHEN p.country IS NULL OR trim(p.country) = '' OR c.code IS NOT NULL THEN 'ok' ELSE 'code_list' END FROM person_records p LEFT JOIN country_codes c ON c.code = upper(trim(p.country))
    UNION ALL SELECT source_system, source_key, 'postcode_pattern', 'validity', CASE WHEN postcode IS NULL OR trim(postcode) = '' OR regexp_matches(upper(trim(postcode)), '^([A-Z]{2}[0-9]{1,2} ?[0-9][A-Z]{2}|[0-9]{5})$') THEN 'ok' ELSE 'pattern' END FROM person_records
) WHERE code <> 'ok'"""


def _failures(spark, d):
    rows = table(spark, d, "person_records").select("source_system", "source_key", "email", "postcode", F.upper(F.trim("country")).alias("cc"))
    codes = table(spark, d, "country_codes").select(F.col("code").alias("cc"), F.lit(True).alias("known"))
    rows = rows.join(codes, "cc", "left")
    absent = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    rule = lambda i, dim, ok, code: F.struct(F.lit(i).alias("rule_id"), F.lit(dim).alias("dimension"), F.when(ok, "ok").otherwise(code).alias("code"))
    rules = F.array(
        rule("email_required", "completeness", ~absent("email"), "missing"),
        rule("email_pattern", "validity", absent("email") | S.email("email").isNotNull(), "pattern"),
        rule("country_known", "consistency", absent("cc") | F.col("known").isNotNull(), "code_list"),
        rule("postcode_pattern", "validity", absent("postcode") | F.upper(F.trim("postcode")).rlike("^([A-Z]{2}[0-9]{1,2} ?[0-9][A-Z]{2}|[0-9]{5})$"), "pattern"),
    )
    return rows.select("source_system", "source_key", F.explode(F.filter(rules, lambda r: r["code"] != "ok")).alias("r")).select("source_system", "source_key", "r.*")


@query(_FAILURES_SQL)
def quality_rule_failures(spark, d):
    return _failures(spark, d)


@query(f"SELECT dimension, source_system, count(*) AS failures, count(DISTINCT source_key) AS records FROM ({_FAILURES_SQL}) GROUP BY ALL")
def quality_by_dimension(spark, d):
    return _failures(spark, d).groupBy("dimension", "source_system").agg(F.count(F.lit(1)).alias("failures"), F.count_distinct("source_key").alias("records"))


_OLDER = "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'O' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS p, o_custkey FROM orders"


@query(f"""SELECT o.o_orderkey, array_to_string(list_filter([CASE WHEN o.o_orderstatus IS DISTINCT FROM b.s THEN 'o_orderstatus' END, CASE WHEN o.o_orderpriority IS DISTINCT FROM b.p THEN 'o_orderpriority' END], lambda x: x IS NOT NULL), ',') AS changed
    FROM orders o JOIN ({_OLDER}) b USING (o_orderkey) WHERE o.o_orderstatus IS DISTINCT FROM b.s OR o.o_orderpriority IS DISTINCT FROM b.p""")
def change_detection(spark, d):
    now = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    before = now.select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, "O").otherwise(F.col("o_orderstatus")).alias("b_o_orderstatus"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderpriority")).alias("b_o_orderpriority"))
    moved = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in ("o_orderstatus", "o_orderpriority"))))
    return now.join(before, "o_orderkey").select("o_orderkey", F.array_join(moved, ",").alias("changed")).where("changed <> ''")


# --- pairs ---------------------------------------------------------------------------------------

_ORG = f"""SELECT source_system || ':' || source_key AS rec, {_fold_sql('name')} AS name, nullif(regexp_replace(upper(registered_id), '[\\s.;\\-]', '', 'g'), '') AS ident,
    nullif(regexp_replace(upper(postcode), '[\\s\\-]', '', 'g'), '') AS postcode, lower(trim(city)) AS city, nullif(regexp_replace(phone, '\\D', '', 'g'), '') AS phone,
    CASE WHEN regexp_matches(lower(trim(email)), '^[^@\\s]+@[^@\\s.]+(\\.[^@\\s.]+)+$') THEN lower(trim(email)) END AS email FROM organisation_records"""
_KEYS = f"""SELECT DISTINCT rec, pass, lower(key) AS key FROM (WITH o AS ({_ORG})
    SELECT rec, 'ident' AS pass, ident AS key FROM o UNION ALL SELECT rec, 'phone7', CASE WHEN right(phone, 7) <> '' THEN right(phone, 7) END FROM o
    UNION ALL SELECT rec, 'name_post', CASE WHEN name <> '' THEN postcode || '|' || substr(name, 1, 4) END FROM o) WHERE key IS NOT NULL AND key <> ''"""
_PAIRS = f"""SELECT a.rec AS left_rec, b.rec AS right_rec, count(DISTINCT a.pass) AS passes FROM (SELECT k.* FROM ({_KEYS}) k JOIN (SELECT pass, key FROM ({_KEYS}) GROUP BY ALL HAVING count(*) <= 1000) USING (pass, key)) a
    JOIN ({_KEYS}) b ON a.pass = b.pass AND a.key = b.key AND a.rec < b.rec GROUP BY ALL"""


def _orgs(spark, d):
    return table(spark, d, "organisation_records").select(
        F.concat_ws(":", "source_system", "source_key").alias("rec"), S.fold("name").alias("name"), K.registered_id("registered_id").alias("ident"),
        S.postcode("postcode").alias("postcode"), F.lower(F.trim("city")).alias("city"), S.empty_to_null(F.regexp_replace("phone", r"\D", "")).alias("phone"), S.email("email").alias("email"),
    )


def _keys(spark, d):
    passes = {"ident": [F.col("ident")], "phone7": [F.right("phone", F.lit(7))], "name_post": [F.col("postcode"), F.substring("name", 1, 4)]}
    return pairs.blocking_keys(_orgs(spark, d), "rec", passes)


def _candidates(spark, d):
    return pairs.candidate_pairs(_keys(spark, d), "rec")


@query(_KEYS)
def blocking_keys(spark, d):
    return _keys(spark, d)


@query(f"SELECT pass, key, count(*) AS n FROM ({_KEYS}) GROUP BY ALL")
def block_sizes(spark, d):
    return pairs.block_sizes(_keys(spark, d))


@query(f"SELECT pass, key, count(*) AS n FROM ({_KEYS}) GROUP BY ALL HAVING count(*) > 3")
def stop_keys(spark, d):
    return pairs.stop_keys(_keys(spark, d), 3)


@query(_PAIRS)
def candidate_pairs(spark, d):
    return _candidates(spark, d)


@query(f"""WITH p AS ({_PAIRS}), b AS (SELECT left_rec AS me, right_rec AS other, passes FROM p UNION ALL SELECT right_rec, left_rec, passes FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY me ORDER BY passes DESC, other) AS rn FROM b)
SELECT DISTINCT least(me, other) AS left_rec, greatest(me, other) AS right_rec, passes FROM r WHERE rn <= 2""")
def candidate_topk(spark, d):
    return pairs.top_candidates(_candidates(spark, d), 2)


_COMPARED = ("name", "ident", "postcode", "city", "phone", "email")


def _sides(spark, d):
    o = _orgs(spark, d)
    left = o.select(F.col("rec").alias("left_rec"), *(F.col(c).alias(f"l_{c}") for c in _COMPARED))
    right = o.select(F.col("rec").alias("right_rec"), *(F.col(c).alias(f"r_{c}") for c in _COMPARED))
    return _candidates(spark, d).join(left, "left_rec").join(right, "right_rec")


_SIDES = f"""SELECT p.left_rec, p.right_rec, {", ".join(f"l.{c} AS l_{c}, r.{c} AS r_{c}" for c in _COMPARED)} FROM ({_PAIRS}) p JOIN ({_ORG}) l ON l.rec = p.left_rec JOIN ({_ORG}) r ON r.rec = p.right_rec"""


def _level_sql(c: str, *steps: str) -> str:
    a, b = f"l_{c}", f"r_{c}"
    mid = " ".join(f"WHEN {s} THEN {k}" for k, s in enumerate(steps, 1))
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL OR {a} = '' OR {b} = '' THEN -1 WHEN {a} = {b} THEN 0 {mid} ELSE {len(steps) + 1} END"


_JW = "jaro_winkler_similarity(l_name, r_name)"
LEVELS_SQL = {
    "exact": _level_sql("city"), "levenshtein": _level_sql("name", "levenshtein(l_name, r_name) <= 1", "levenshtein(l_name, r_name) <= 2"),
    "name": _level_sql("name", f"{_JW} >= 0.95", f"{_JW} >= 0.88"), "phone": _level_sql("phone", "right(l_phone, 7) = right(r_phone, 7)"), "postcode": _level_sql("postcode", "substr(l_postcode, 1, 3) = substr(r_postcode, 1, 3)"),
    "email": _level_sql("email", "split_part(l_email, '@', 1) = split_part(r_email, '@', 1) OR (split_part(l_email, '@', 2) = split_part(r_email, '@', 2) AND jaro_winkler_similarity(split_part(l_email, '@', 1), split_part(r_email, '@', 1)) >= 0.92)"),
    "identifier": "CASE WHEN l_ident IS NULL OR r_ident IS NULL THEN -1 WHEN l_ident = r_ident AND coalesce(try_cast(l_ident AS HUGEINT) % 97 = 1, false) THEN 0 WHEN l_ident = r_ident THEN 1 ELSE 2 END",
}


def _level(name: str):
    c = lambda x: (F.col(f"l_{x}"), F.col(f"r_{x}"))
    return {
        "exact": lambda: L.exact_level(*c("city")), "levenshtein": lambda: L.levenshtein_level(*c("name")), "name": lambda: L.name_level(*c("name")), "phone": lambda: L.phone_level(*c("phone")),
        "postcode": lambda: L.postcode_level(*c("postcode")), "email": lambda: L.email_level(*c("email")),
        "identifier": lambda: L.identifier_level(*c("ident"), F.coalesce(K.mod97_valid("l_ident"), F.lit(False)), F.coalesce(K.mod97_valid("r_ident"), F.lit(False))),
    }[name]()


def _compare(name: str):
    def run(spark, d):
        return _sides(spark, d).select("left_rec", "right_rec", _level(name).alias("level"))

    return run


for _name in LEVELS_SQL:
    QUERIES[f"cmp_{_name}"] = _compare(_name)
    SQL[f"cmp_{_name}"] = f"SELECT left_rec, right_rec, {LEVELS_SQL[_name]} AS level FROM ({_SIDES})"


@query()
def cmp_token_set(spark, d):
    return _sides(spark, d).select("left_rec", "right_rec", L.token_set_level(F.col("l_name"), F.col("r_name")).alias("level"))


@query()
def cmp_phonetic(spark, d):
    return _sides(spark, d).select("left_rec", "right_rec", L.phonetic_level(F.col("l_name"), F.col("r_name")).alias("level"))


_BORN = _date_sql("birth_date", "source_system = 'student_records'")
_PEOPLE = f"SELECT source_system || ':' || source_key AS rec, {_BORN} AS born, nullif(regexp_replace(phone, '\\D', '', 'g'), '') AS phone FROM person_records"


@query(f"""WITH p AS ({_PEOPLE}), k AS (SELECT *, right(phone, 8) AS key FROM p WHERE length(phone) >= 8), g AS (SELECT key FROM k GROUP BY key HAVING count(*) <= 1000)
SELECT left_rec, right_rec, {_level_sql("born", "(substr(l_born, 1, 4) = substr(r_born, 1, 4) AND substr(l_born, 6, 2) = substr(r_born, 9, 2) AND substr(l_born, 9, 2) = substr(r_born, 6, 2)) OR levenshtein(l_born, r_born) = 1", "substr(l_born, 1, 4) = substr(r_born, 1, 4)")} AS level
FROM (SELECT a.rec AS left_rec, b.rec AS right_rec, a.born AS l_born, b.born AS r_born FROM k a JOIN g USING (key) JOIN k b ON a.key = b.key AND a.rec < b.rec)""")
def cmp_date(spark, d):
    p = table(spark, d, "person_records").select(F.concat_ws(":", "source_system", "source_key").alias("rec"), S.iso_date("birth_date", day_first()).alias("born"), F.regexp_replace("phone", r"\D", "").alias("phone"))
    k = pairs.blocking_keys(p.where("length(phone) >= 8"), "rec", {"phone": [F.right("phone", F.lit(8))]})
    met = pairs.candidate_pairs(k, "rec").select("left_rec", "right_rec")
    met = met.join(p.select(F.col("rec").alias("left_rec"), F.col("born").alias("l_born")), "left_rec").join(p.select(F.col("rec").alias("right_rec"), F.col("born").alias("r_born")), "right_rec")
    return met.select("left_rec", "right_rec", L.date_level(F.col("l_born"), F.col("r_born")).alias("level"))


RULES = pairs.Rules.defaults({"identifier": 3, "levenshtein": 4, "postcode": 3, "phone": 3, "exact": 2}, 0.002)


def _scored(spark, d):
    return _sides(spark, d).select("left_rec", "right_rec", "l_ident", "r_ident", *(_level(c).alias(c) for c in RULES.weights))


def _weight_sql() -> str:
    out = repr(RULES.prior)
    for c, ws in RULES.weights.items():
        out += f" + CASE {c} " + " ".join(f"WHEN {k} THEN CAST({w!r} AS DOUBLE)" for k, w in enumerate(ws)) + " ELSE 0 END"
    return out


_SCORED = f"SELECT left_rec, right_rec, l_ident, r_ident, {', '.join(f'{LEVELS_SQL[c]} AS {c}' for c in RULES.weights)} FROM ({_SIDES})"
_BAND = f"CASE WHEN w >= {RULES.edge(90.0)!r} THEN 'auto' WHEN w >= {RULES.edge(60.0)!r} THEN 'review' ELSE 'none' END"


@query(f"SELECT left_rec, right_rec, round(w, 6) AS weight, round(CASE WHEN w < -60 THEN 100 * pow(2, w) ELSE 100 / (1 + pow(2, -w)) END, 6) AS score, {_BAND} AS band FROM (SELECT *, {_weight_sql()} AS w FROM ({_SCORED}))")
def pair_weights_bands(spark, d):
    s = _scored(spark, d).withColumn("w", RULES.weight())
    return s.select("left_rec", "right_rec", F.round("w", 6).alias("weight"), F.round(pairs.probability(F.col("w")), 6).alias("score"), RULES.band(F.col("w")).alias("band"))


def _signature_sql() -> str:
    part = lambda c, n: f"'{c}' || CASE WHEN {c} < 0 THEN '∅' WHEN {c} = 0 THEN '=' WHEN {c} = {n - 1} THEN '≠' ELSE '≈' END"
    return " || ' · ' || ".join(part(c, len(ws)) for c, ws in RULES.weights.items())


@query(f"SELECT {_signature_sql()} AS signature, count(*) AS n FROM ({_SCORED}) GROUP BY 1")
def pair_signature(spark, d):
    return _scored(spark, d).groupBy(pairs.signature(RULES).alias("signature")).agg(F.count(F.lit(1)).alias("n"))


_VALID = "coalesce(try_cast({c} AS HUGEINT) % 97 = 1, false)"


@query(f"SELECT left_rec, right_rec, CASE WHEN {_VALID.format(c='l_ident')} AND {_VALID.format(c='r_ident')} THEN CASE WHEN l_ident = r_ident THEN 'must_link' ELSE 'cannot_link' END END AS rule FROM ({_SCORED})")
def pair_hard_rules(spark, d):
    ids = lambda c: F.when(F.coalesce(K.mod97_valid(c), F.lit(False)), F.array(c))
    return _scored(spark, d).select("left_rec", "right_rec", pairs.hard_rule(ids("l_ident"), ids("r_ident")).alias("rule"))


def _counter_sql(up: bool) -> str:
    rank = lambda w: f"CASE WHEN {w} >= {RULES.edge(90.0)!r} THEN 2 WHEN {w} >= {RULES.edge(60.0)!r} THEN 1 ELSE 0 END"
    parts = []
    for i, (c, ws) in enumerate(RULES.weights.items()):
        own = f"(CASE {c} " + " ".join(f"WHEN {k} THEN CAST({w!r} AS DOUBLE)" for k, w in enumerate(ws)) + " ELSE 0 END)"
        for k, w in enumerate(ws):
            moved = f"(w - {own} + ({w!r}))"
            parts.append(f"SELECT left_rec, right_rec, round(abs({w!r} - {own}), 9) AS far, {i} AS i, {k} AS level, '{c}' AS comparison FROM s WHERE {c} <> {k} AND {rank(moved)} {'>' if up else '<'} {rank('w')}")
    return " UNION ALL ".join(parts)


@query(f"""WITH s AS (SELECT *, {_weight_sql()} AS w FROM ({_SCORED})), o AS ({_counter_sql(True)}), r AS (SELECT *, row_number() OVER (PARTITION BY left_rec, right_rec ORDER BY far, i, level) AS rn FROM o)
SELECT s.left_rec, s.right_rec, r.comparison || ':' || r.level AS raise_by FROM s LEFT JOIN r ON r.rn = 1 AND r.left_rec = s.left_rec AND r.right_rec = s.right_rec""")
def pair_counterfactuals(spark, d):
    return _scored(spark, d).select("left_rec", "right_rec", pairs.counterfactuals(RULES, True).alias("raise_by"))


# --- estimates -------------------------------------------------------------------------------------


@query("SELECT city, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM organisation_records WHERE city IS NOT NULL GROUP BY city")
def value_frequency_u0(spark, d):
    counts = table(spark, d, "organisation_records").where("city is not null").groupBy("city").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(counts.agg(F.sum("n").alias("all")), how="cross").select("city", "n", F.round(F.col("n") / F.col("all"), 9).alias("share"))


@query(f"SELECT comparison, level, count(*) AS n FROM (UNPIVOT (SELECT {', '.join(RULES.weights)} FROM ({_SCORED})) ON {', '.join(RULES.weights)} INTO NAME comparison VALUE level) WHERE level >= 0 GROUP BY ALL")
def u_levels(spark, d):
    return pairs.level_shares(_scored(spark, d), list(RULES.weights))


@query(f"SELECT {', '.join(RULES.weights)}, count(*) AS n FROM ({_SCORED}) GROUP BY ALL")
def em_patterns(spark, d):
    return pairs.patterns(_scored(spark, d), list(RULES.weights))


@query()
def em_weights(spark, d):
    """m of each comparison's levels by expectation-maximisation on distinct patterns."""
    import numpy as np

    names = list(RULES.weights)
    counted = [(tuple(r[c] for c in names), r.n) for r in pairs.patterns(_scored(spark, d), names).collect()]
    sizes = [len(w) for w in RULES.weights.values()]
    m, share, done = pairs.expectation_maximisation(counted, sizes, [np.array(pairs.U_DEFAULT[n]) for n in sizes]) if counted else ([], 0.0, True)
    rows = [(c, k, round(float(p), 6), round(share, 6), done) for c, ps in zip(names, m) for k, p in enumerate(ps)]
    return spark.createDataFrame(rows, "comparison string, level int, m double, share double, converged boolean")


# --- golden records ----------------------------------------------------------------------------------

_SCORES = "SELECT left_system || ':' || left_key AS record, right_system || ':' || right_key AS member, score FROM pair_scores WHERE score IS NOT NULL AND NOT isnan(score) AND right_key IS NOT NULL"


@query(f"""WITH p AS ({_SCORES}), x AS (SELECT p.*, 'M' || right(member, 2) AS master_id FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY record, master_id ORDER BY score DESC, member DESC) AS rn, count(*) OVER (PARTITION BY record, master_id) AS members FROM x)
SELECT record, master_id, score, member, members FROM r WHERE rn = 1""")
def golden_best_member(spark, d):
    rec = lambda s: F.concat_ws(":", f"{s}_system", f"{s}_key")
    p = table(spark, d, "pair_scores").where("score is not null and not isnan(score) and right_key is not null").select(rec("left").alias("record"), rec("right").alias("member"), "score")
    xref = p.select(F.col("member").alias("rec")).distinct().withColumn("master_id", F.concat(F.lit("M"), F.right("rec", F.lit(2))))
    return golden.best_member(p, xref)


_VALID_ORG = f"SELECT rec, ident, 'M' || city AS master_id FROM ({_ORG}) WHERE ident IS NOT NULL AND city IS NOT NULL AND {_VALID.format(c='ident')}"


@query(f"""WITH o AS ({_VALID_ORG}), m AS (SELECT master_id, list(DISTINCT ident) AS ids FROM o GROUP BY 1), p AS (SELECT DISTINCT s.left_rec AS record, r.master_id FROM ({_SCORED}) s JOIN ({_ORG}) x ON x.rec = s.right_rec JOIN m r ON r.master_id = 'M' || x.city)
SELECT p.record, p.master_id, 'ORG_REG' AS scheme FROM p JOIN o ON o.rec = p.record JOIN m ON m.master_id = p.master_id WHERE NOT list_contains(m.ids, o.ident)""")
def blocked_by_cannot_link(spark, d):
    """Candidates of a town's firms, taken as one master each with all their valid ids: blocked where the record's valid id is none of them."""
    orgs = _orgs(spark, d).select("rec", "ident", F.concat(F.lit("M"), "city").alias("master_id")).where("ident is not null and master_id is not null")
    valid = orgs.where(F.coalesce(K.mod97_valid("ident"), F.lit(False)))
    records = valid.groupBy(F.col("rec").alias("record")).agg(F.collect_set("ident").alias("ids")).withColumn("scheme", F.lit("ORG_REG"))
    masters = valid.groupBy("master_id").agg(F.collect_set("ident").alias("master_ids")).withColumn("scheme", F.lit("ORG_REG"))
    towns = _orgs(spark, d).select(F.col("rec").alias("right_rec"), F.concat(F.lit("M"), "city").alias("master_id"))
    met = _candidates(spark, d).join(towns, "right_rec").select(F.col("left_rec").alias("record"), "master_id").distinct()
    return golden.conflicting(met, records, masters)


_MEMBER = """SELECT master_id, entity, source_system, source_key, occurred_at, landing_seq, e.key AS attr_name, e.value AS value
    FROM (SELECT *, unnest(map_entries(member_values)) AS e FROM group_members) WHERE e.value IS NOT NULL AND trim(e.value) <> ''"""
_TRUSTED = f"SELECT m.*, t.trust FROM ({_MEMBER}) m LEFT JOIN source_trust t USING (entity, source_system, attr_name)"


def _offers(spark, d):
    m = table(spark, d, "group_members").select("master_id", "entity", "source_system", "source_key", "occurred_at", "landing_seq", F.explode(F.map_entries("member_values")).alias("e"))
    m = m.select("*", F.col("e.key").alias("attr_name"), F.col("e.value").alias("value")).drop("e").where("value is not null and trim(value) <> ''")
    return m.join(table(spark, d, "source_trust").select("entity", "source_system", "attr_name", "trust"), ["entity", "source_system", "attr_name"], "left")


_TIE = "source_system, source_key"
for _name, _order in {
    "source_trust": "coalesce(trust, 1000000)", "recency": "occurred_at DESC NULLS LAST, landing_seq DESC NULLS LAST", "completeness": "length(value) DESC",
    "frequency": "freq DESC",
}.items():
    _src = _TRUSTED if _name != "frequency" else f"SELECT *, count(*) OVER (PARTITION BY master_id, attr_name, lower(trim(value))) AS freq FROM ({_TRUSTED})"
    SQL[f"survive_{_name.removeprefix('source_')}"] = f"SELECT master_id, attr_name, source_system, source_key, value FROM (SELECT *, row_number() OVER (PARTITION BY master_id, attr_name ORDER BY {_order}, {_TIE}) AS rn FROM ({_src})) WHERE rn = 1"
    QUERIES[f"survive_{_name.removeprefix('source_')}"] = lambda spark, d, s=_name: (
        golden.ranked(_offers(spark, d), s, ["master_id", "attr_name"], ["source_system", "source_key"]).where("rank = 1").select("master_id", "attr_name", "source_system", "source_key", "value")
    )


@query(f"""WITH r AS (SELECT *, row_number() OVER w AS rn, lead(coalesce(trust, -1)) OVER w AS nt, lead(occurred_at) OVER w AS no, lead(landing_seq) OVER w AS ns, lead(source_key) OVER w AS nk FROM ({_TRUSTED})
    WINDOW w AS (PARTITION BY master_id, attr_name ORDER BY coalesce(trust, 1000000), occurred_at DESC NULLS LAST, landing_seq DESC NULLS LAST, {_TIE}))
SELECT master_id, attr_name, max(value) FILTER (WHERE rn = 1) AS value, max(CASE WHEN nk IS NULL THEN 'only' WHEN coalesce(trust, -1) <> nt THEN 'source_trust' WHEN occurred_at IS DISTINCT FROM no OR landing_seq IS DISTINCT FROM ns THEN 'recency' ELSE 'tie_break' END) FILTER (WHERE rn = 1) AS decided_by,
    CAST(count(*) FILTER (WHERE rn BETWEEN 2 AND 6) AS BIGINT) AS runners_up FROM r GROUP BY ALL""")
def survive_provenance(spark, d):
    return golden.provenance(_offers(spark, d), ["master_id", "attr_name"], ["source_system", "source_key"])


@query("""SELECT employer, kind, line1 FROM (SELECT *, row_number() OVER (PARTITION BY employer, lower(trim(kind)) ORDER BY source_system, source_key, line1) AS rn
    FROM (SELECT employer, source_system, source_key, a.kind AS kind, a.line1 AS line1 FROM (SELECT employer, source_system, source_key, unnest(addresses) AS a FROM person_records WHERE employer IS NOT NULL)) WHERE kind IS NOT NULL) WHERE rn = 1""")
def survive_keyed_union(spark, d):
    rows = table(spark, d, "person_records").where("employer is not null").select("employer", "source_system", "source_key", F.explode("addresses").alias("a")).select("employer", "source_system", "source_key", "a.kind", "a.line1")
    return golden.keyed_union(rows, ["employer"], "kind", [F.col("source_system"), F.col("source_key"), F.col("line1")]).select("employer", "kind", "line1")


_FIN = "SELECT source_key, 'ORG-' || right(source_key, 6) AS master FROM organisation_records WHERE source_system = 'finance'"


@query(f"SELECT p.source_system, p.source_key, p.employer, f.master AS resolved FROM person_records p LEFT JOIN ({_FIN}) f ON f.source_key = p.employer WHERE p.employer IS NOT NULL")
def reference_resolution(spark, d):
    return _resolved(spark, d)


def _resolved(spark, d):
    people = table(spark, d, "person_records").where("employer is not null").select("source_system", "source_key", "employer")
    firms = table(spark, d, "organisation_records").where("source_system = 'finance'").select(F.col("source_key").alias("fk"), F.concat(F.lit("ORG-"), F.right("source_key", F.lit(6))).alias("master"))
    return golden.resolve_references(people, "employer", firms, "fk", "master")


@query(f"SELECT employer, count(*) AS waiting FROM person_records p WHERE employer IS NOT NULL AND employer NOT IN (SELECT source_key FROM ({_FIN})) GROUP BY employer")
def pending_references(spark, d):
    return _resolved(spark, d).where("resolved is null").groupBy("employer").agg(F.count(F.lit(1)).alias("waiting"))


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS retired, c_custkey // 3 AS survivor FROM customer WHERE c_custkey % 5 <> 0),
w(retired, s) AS (SELECT retired, survivor FROM e UNION ALL SELECT w.retired, e.survivor FROM w JOIN e ON e.retired = w.s)
SELECT retired, min(s) AS survivor FROM w GROUP BY retired""")
def retired_chain_collapse(spark, d):
    e = table(spark, d, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("retired"), F.expr("c_custkey div 3").alias("survivor"))
    return golden.collapse_chains(e)


@query("SELECT o_custkey, o_orderpriority, count(*) AS n, count(DISTINCT o_orderstatus) AS kinds, min(o_orderdate) AS since, max(o_orderdate) AS until FROM orders GROUP BY ALL")
def relationships_grouped(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderstatus").alias("kinds"), F.min("o_orderdate").alias("since"), F.max("o_orderdate").alias("until"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE rn <= 3")
def members_capped(spark, d):
    w = Window.partitionBy("l_orderkey")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = rows.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("rn", F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")))
    return rows.where("rn <= 3").select("l_orderkey", "l_linenumber", "l_partkey", "n")


@query("SELECT nation.n_name, region.r_name, count(c_custkey) AS customers, round(sum(c_acctbal), 2) AS balance FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def code_list_join(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("c_custkey").alias("customers"), F.sum("c_acctbal").alias("balance"))
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).join(c, "n_nationkey", "left").select("n_name", "r_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.round("balance", 2).alias("balance"))


# --- clusters and evaluation ---------------------------------------------------------------------------

_EDGES = "SELECT DISTINCT left_system || ':' || left_key AS a, right_system || ':' || right_key AS b FROM pair_scores WHERE band = 'auto' AND left_key IS NOT NULL AND right_key IS NOT NULL"
_REACH = f"""WITH RECURSIVE e AS ({_EDGES}), both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, other) AS (SELECT a, a FROM both_ UNION SELECT r.node, x.b FROM r JOIN both_ x ON x.a = r.other)"""


def _edges(spark, d):
    rec = lambda s: F.when(F.col(f"{s}_key").isNotNull(), F.concat_ws(":", f"{s}_system", f"{s}_key"))
    return table(spark, d, "pair_scores").where("band = 'auto'").select(rec("left").alias("a"), rec("right").alias("b"), "score").where("a is not null and b is not null")


@query(f"{_REACH} SELECT node, min(other) AS component FROM r GROUP BY node")
def components(spark, d):
    return golden.components(_edges(spark, d))


@query(f"{_REACH} SELECT DISTINCT node FROM r WHERE other LIKE 'finance:%'")
def reachability_fixpoint(spark, d):
    e = _edges(spark, d)
    nodes = e.select(F.col("a").alias("node")).unionAll(e.select(F.col("b").alias("node")))
    return golden.reachable(e, nodes.where("node like 'finance:%'"))


_TRUTH = "SELECT source_system || ':' || source_key AS rec, postcode AS cluster, city AS truth FROM person_records WHERE postcode IS NOT NULL AND city IS NOT NULL"


@query(f"""WITH t AS ({_TRUTH}), j AS (SELECT sum(n * (n - 1) // 2) AS v FROM (SELECT count(*) AS n FROM t GROUP BY cluster, truth)), f AS (SELECT sum(n * (n - 1) // 2) AS v FROM (SELECT count(*) AS n FROM t GROUP BY cluster)), g AS (SELECT sum(n * (n - 1) // 2) AS v FROM (SELECT count(*) AS n FROM t GROUP BY truth))
SELECT CAST(j.v AS BIGINT) AS both, CAST(f.v AS BIGINT) AS found, CAST(g.v AS BIGINT) AS true_pairs, round(j.v / f.v, 6) AS precision, round(j.v / g.v, 6) AS recall, round(2 * (j.v / f.v) * (j.v / g.v) / (j.v / f.v + j.v / g.v), 6) AS f1 FROM j, f, g""")
def pairwise_evaluation(spark, d):
    t = table(spark, d, "person_records").where("postcode is not null and city is not null").select(F.col("postcode").alias("cluster"), F.col("city").alias("truth"))
    return golden.pairwise_evaluation(t)


# --- samples and breakers ---------------------------------------------------------------------------------

_REVIEW = "SELECT entity, coalesce(band, 'unset') AS band, scored_at, left_key || '|' || coalesce(right_key, '') AS k, coalesce(score >= 80 AND NOT isnan(score), false) AS agreed FROM pair_scores"
_WILSON = "round((a / n + 1.645 * 1.645 / (2 * n) + 1.645 * sqrt((a / n * (1 - a / n) + 1.645 * 1.645 / (4 * n)) / n)) / (1 + 1.645 * 1.645 / n), 6)"


def _reviews(spark, d):
    return table(spark, d, "pair_scores").select("entity", F.coalesce("band", F.lit("unset")).alias("band"), "scored_at", F.concat_ws("|", "left_key", F.coalesce("right_key", F.lit(""))).alias("k"), F.coalesce((F.col("score") >= 80) & ~F.isnan("score"), F.lit(False)).alias("agreed"))


@query(f"SELECT entity, band, n, a AS agreed, {_WILSON} AS upper FROM (SELECT entity, band, count(*) AS n, CAST(sum(agreed::INT) AS BIGINT) AS a FROM ({_REVIEW}) GROUP BY ALL)")
def agreement_wilson(spark, d):
    return sampling.agreement(_reviews(spark, d), ["entity", "band"], "agreed")


@query(f"SELECT entity, band, n, a AS agreed, {_WILSON} AS upper, n >= 20 AND {_WILSON} < 0.95 AS tripped FROM (SELECT entity, band, count(*) AS n, CAST(sum(agreed::INT) AS BIGINT) AS a FROM (SELECT *, row_number() OVER (PARTITION BY entity, band ORDER BY scored_at DESC, k, agreed) AS rn FROM ({_REVIEW})) WHERE rn <= 100 GROUP BY ALL)")
def breaker_window(spark, d):
    return sampling.breaker(_reviews(spark, d), ["entity", "band"], [F.desc("scored_at"), F.col("k"), F.col("agreed")], "agreed")


_STRATA = "SELECT o_orderpriority AS stratum, count(*) AS n FROM orders GROUP BY 1"
_ALLOC = f"""SELECT stratum, n, CAST(least(n, greatest(1, base + CASE WHEN rn <= 101 - total THEN 1 ELSE 0 END)) AS BIGINT) AS take FROM (SELECT *, sum(base) OVER () AS total, row_number() OVER (ORDER BY exact - base DESC, stratum) AS rn
    FROM (SELECT *, floor(exact) AS base FROM (SELECT *, n * 101.0::DOUBLE / sum(n) OVER () AS exact FROM ({_STRATA}))))"""


def _strata(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


@query(_ALLOC)
def stratified_allocation(spark, d):
    return sampling.allocation(_strata(spark, d), 101)


@query(f"SELECT o_orderkey, stratum FROM (SELECT o_orderkey, o_orderpriority AS stratum, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS rn FROM orders) o JOIN ({_ALLOC}) a USING (stratum) WHERE rn <= take")
def stratified_draw(spark, d):
    items = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("stratum"))
    return sampling.draw(items, sampling.allocation(_strata(spark, d), 101), [F.sha2(F.col("o_orderkey").cast("string"), 256), F.col("o_orderkey")])


@query("SELECT o_orderkey, o_orderstatus FROM (SELECT *, count(*) OVER (PARTITION BY o_orderstatus) AS n, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS rn FROM orders) WHERE rn <= greatest(1, ceil(round(n * 0.02, 9)))")
def review_draw(spark, d):
    return sampling.review_draw(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), ["o_orderstatus"], ["o_totalprice", "o_orderkey"], 0.02).select("o_orderkey", "o_orderstatus")


@query(f"SELECT signature, count(*) AS n FROM (SELECT {_signature_sql()} AS signature FROM ({_SCORED}) ORDER BY left_rec, right_rec LIMIT 500) GROUP BY 1")
def signature_groups_capped(spark, d):
    """The top window of pairs, then the groups: the limit lies below the aggregate."""
    top = _scored(spark, d).select("left_rec", "right_rec", pairs.signature(RULES).alias("signature")).orderBy("left_rec", "right_rec").limit(500)
    return top.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))


@query()
def batch_pack(spark, d):
    items = table(spark, d, "orders").where("o_orderpriority is not null").select(F.col("o_custkey").alias("batch"), "o_orderkey", F.col("o_orderstatus").alias("target"))
    return sampling.pack(items, "batch", "o_orderkey", "target", 5, 2)


# --- profiles ------------------------------------------------------------------------------------------------

_PCOLS = ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
_PCELLS = " UNION ALL ".join(f"SELECT '{c}' AS attr, CAST({c} AS VARCHAR) AS v FROM part" for c in _PCOLS)


def _profiled(spark, d):
    rows = table(spark, d, "part")
    return profile.cells(rows, rows.columns)


@query(f"SELECT attr, CAST(count(v) FILTER (WHERE trim(v) <> '') AS BIGINT) AS filled, CAST(count(*) - count(v) FILTER (WHERE trim(v) <> '') AS BIGINT) AS empty, count(DISTINCT v) FILTER (WHERE trim(v) <> '') AS distincts, min(length(v)) FILTER (WHERE trim(v) <> '') AS shortest, max(length(v)) FILTER (WHERE trim(v) <> '') AS longest FROM ({_PCELLS}) GROUP BY attr")
def profile_attributes(spark, d):
    return profile.attributes(_profiled(spark, d))


@query(f"SELECT attr, v, n FROM (SELECT *, row_number() OVER (PARTITION BY attr ORDER BY n DESC, v) AS rn FROM (SELECT attr, v, count(*) AS n FROM ({_PCELLS}) WHERE trim(v) <> '' GROUP BY ALL)) WHERE rn <= 10")
def profile_top_values(spark, d):
    return profile.top_values(_profiled(spark, d))


_PATTERN = "regexp_replace(regexp_replace(regexp_replace(v, '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '9', 'g')"


@query(f"SELECT attr, pattern, n FROM (SELECT *, row_number() OVER (PARTITION BY attr ORDER BY n DESC, pattern) AS rn FROM (SELECT attr, CASE WHEN length(p) > 40 THEN substr(p, 1, 40) || '…' ELSE p END AS pattern, count(*) AS n FROM (SELECT attr, {_PATTERN} AS p FROM ({_PCELLS}) WHERE trim(v) <> '') GROUP BY ALL)) WHERE rn <= 10")
def profile_patterns(spark, d):
    return profile.top_patterns(_profiled(spark, d))


# --- streams ---------------------------------------------------------------------------------------------------


_EVENTS = ("event_id", "user_id", "ts", "event_type", "value")


def _event_files(spark, d, space, late: int) -> str:
    """events in six files as they might land: by number, but every seventh row up to ``late`` files later."""
    rows = table(spark, d, "events").select(*_EVENTS)
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    ends = rows.agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi")).first()
    width = ((ends.hi or 0) - (ends.lo or 0)) // 6 + 1
    file = F.least(F.lit(5), F.expr(f"int((event_id - {ends.lo or 0}) div {width})") + F.when(F.col("event_id") % 7 == 0, late).otherwise(0))
    return streams.as_files(rows, file, 6, space)


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL")
def stream_hourly_counts(spark, d):
    """Six micro-batches, rows coming up to two files late; the watermark leaves their hours open."""
    space = Workspace(spark, "stream")
    source = streams.stream_of(spark, _event_files(spark, d, space, 2))
    out = streams.Upserts(space, ["event_type", "hour"])
    streams.run_to_end(streams.hourly_counts(source, "ts", "event_type", "400 days"), out.sink, space, "update")
    return out.read(spark).select("event_type", "hour", "n")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def stream_latest_state(spark, d):
    space = Workspace(spark, "stream")
    source = streams.stream_of(spark, _event_files(spark, d, space, 3)).select("user_id", "event_id", "value")
    out = streams.Upserts(space, ["user_id"])
    streams.run_to_end(streams.latest_state(source, ["user_id"], ["event_id"]), out.sink, space, "update")
    return out.read(spark).select("user_id", "event_id", "value")


@query("SELECT event_id, min(landing_seq) AS landing_seq FROM arrival_queue WHERE event_id IS NOT NULL GROUP BY 1")
def stream_exactly_once(spark, d):
    """The queue in four files, each delivered twice, the sink restarted between: every event is stored once."""
    space = Workspace(spark, "stream")
    rows = table(spark, d, "arrival_queue").select(F.lit("queue").alias("scope"), "event_id", "landing_seq")
    ends = rows.agg(F.min("landing_seq").alias("lo"), F.max("landing_seq").alias("hi")).first()
    width = ((ends.hi or 0) - (ends.lo or 0)) // 4 + 1
    folder = streams.as_files(rows, F.coalesce(F.expr(f"int((landing_seq - {ends.lo or 0}) div {width})"), F.lit(0)), 4, space)
    schema = rows.schema
    for n in range(4):
        once = streams.ExactlyOnce(spark, f"{space.root}/once")  # a sink that has just been restarted
        part = spark.read.schema(schema).parquet(f"{folder}/file-{n:03d}")
        once.sink(part, 2 * n)
        once.sink(part, 2 * n)  # replayed after a crash
        once.sink(part, 2 * n + 1)  # delivered once more
    return once.read().select("event_id", "landing_seq")
