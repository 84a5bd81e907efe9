"""SQL that gives the same rows as the queries of this subpackage, where SQL can."""

FILLED = """regexp_matches(lower(trim(regexp_replace(v, '[\\s\\x{00a0}]+', ' ', 'g'))), '[\\p{L}\\p{N}]')
    AND NOT regexp_matches(lower(trim(v)), '^x+$')
    AND lower(trim(regexp_replace(v, '[\\s\\x{00a0}]+', ' ', 'g'))) NOT IN
        ('n/a', 'na', 'nil', 'none', 'null', 'unknown', 'not known', 'not available', 'tbc', 'tba', 'xxx', 'no email', 'no phone', 'none@none')"""

P4_FOUND = f"""
WITH entries AS (
    SELECT master_id, entity, source_system, source_key, occurred_at, landing_seq, unnest(map_entries(member_values)) AS e
    FROM group_members WHERE master_id IS NOT NULL),
offered AS (SELECT * EXCLUDE (e), e.key AS attr_name, e.value AS v FROM entries),
filled AS (
    SELECT *, trim(v) AS t FROM offered WHERE v IS NOT NULL AND {FILLED}),
dated AS (
    SELECT *, CASE WHEN attr_name <> 'birth_date' THEN NULL
        WHEN regexp_matches(t, '^\\d{{4}}[-/]\\d{{1,2}}[-/]\\d{{1,2}}') THEN
            regexp_extract(t, '^(\\d{{4}})', 1) || lpad(regexp_extract(t, '^\\d{{4}}[-/](\\d{{1,2}})', 1), 2, '0') || lpad(regexp_extract(t, '^\\d{{4}}[-/]\\d{{1,2}}[-/](\\d{{1,2}})', 1), 2, '0')
        WHEN regexp_matches(t, '^\\d{{8}}$') THEN t
        WHEN regexp_matches(t, '^\\d{{1,2}}[-/.]\\d{{1,2}}[-/.]\\d{{4}}$') THEN
            regexp_extract(t, '(\\d{{4}})$', 1) || lpad(regexp_extract(t, '^\\d{{1,2}}[-/.](\\d{{1,2}})', 1), 2, '0') || lpad(regexp_extract(t, '^(\\d{{1,2}})', 1), 2, '0')
        END AS ymd FROM filled),
speaking AS (
    SELECT * FROM dated WHERE NOT coalesce(ymd = '19000101' OR (source_system = 'student_records' AND ymd LIKE '____0101'), false)),
ruled AS (
    SELECT s.*, coalesce(t.trust, 1000000) AS trust, r.strategies FROM speaking s
    JOIN (SELECT entity, attr_name, min(strategies) AS strategies FROM source_trust GROUP BY ALL) r USING (entity, attr_name)
    LEFT JOIN source_trust t USING (entity, source_system, attr_name)),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY master_id, attr_name ORDER BY
        CASE split_part(strategies, ',', 1) WHEN 'source_trust' THEN trust WHEN 'recency' THEN -coalesce(epoch_us(occurred_at), -9223372036854775807)
            WHEN 'completeness' THEN CAST(regexp_matches(t, '^\\d{{4}}$') AS INT) ELSE 0 END,
        CASE split_part(strategies, ',', 1) WHEN 'recency' THEN -coalesce(landing_seq, -9223372036854775807) ELSE 0 END,
        CASE split_part(strategies, ',', 2) WHEN 'source_trust' THEN trust WHEN 'recency' THEN -coalesce(epoch_us(occurred_at), -9223372036854775807)
            WHEN 'completeness' THEN CAST(regexp_matches(t, '^\\d{{4}}$') AS INT) ELSE 0 END,
        CASE split_part(strategies, ',', 2) WHEN 'recency' THEN -coalesce(landing_seq, -9223372036854775807) ELSE 0 END,
        source_system, source_key) AS rn FROM ruled)
SELECT master_id, attr_name, source_system, source_key FROM ranked WHERE rn = 1
"""

P7_FOUND = """
WITH RECURSIVE rows_ AS (
    SELECT entity, left_system || ':' || left_key AS l, right_system || ':' || right_key AS r, score, scored_at, rule_version FROM pair_scores),
nodes AS (SELECT DISTINCT entity, rec FROM (SELECT entity, l AS rec FROM rows_ UNION ALL SELECT entity, r FROM rows_) WHERE rec IS NOT NULL),
ranked AS (
    SELECT entity, least(l, r) AS a, greatest(l, r) AS b, score,
        row_number() OVER (PARTITION BY entity, least(l, r), greatest(l, r) ORDER BY scored_at DESC NULLS LAST, rule_version DESC NULLS LAST, score DESC NULLS LAST) AS rn
    FROM rows_ WHERE l IS NOT NULL AND r IS NOT NULL AND l <> r),
links AS (SELECT entity, a, b FROM ranked WHERE rn = 1 AND score >= 90 AND NOT isnan(score)),
both_ AS (SELECT entity, a, b FROM links UNION ALL SELECT entity, b, a FROM links),
reach(entity, rec, other) AS (
    SELECT entity, rec, rec FROM nodes
    UNION
    SELECT r.entity, r.rec, b.b FROM reach r JOIN both_ b ON b.entity = r.entity AND b.a = r.other)
SELECT entity, rec, min(other) AS group_id FROM reach GROUP BY ALL
"""


def oracle_sql() -> dict[str, str]:
    return {"p4_found": P4_FOUND, "p7_found": P7_FOUND}
