"""Quality rules over standardised records: one result for each rule, failures kept by record, changes found by attribute."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns that rules name.
PATTERNS = {"email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$", "postcode": r"^[A-Z0-9]{3,10}$", "url": r"^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+$"}


@dataclass(frozen=True)
class Rule:
    """required, placeholder, pattern, range, code_list or checksum on one attribute; ``hold`` keeps a failing record from being published."""

    rule_id: str
    attribute: str
    kind: str
    dimension: str
    severity: str = "warn"
    pattern: str | None = None
    low: str | float | None = None
    high: str | float | None = None
    codes: tuple[str, ...] = ()
    scheme: str | None = None


def _code(rule: Rule, value: Column, placeholders: Column, invalid: Column, ids: Column, form: Column, today: str) -> Column:
    name = F.lit(rule.attribute)
    present = value.isNotNull() & (F.trim(value.cast("string")) != "")
    if rule.kind == "required":
        return F.when(F.array_contains(placeholders, name), "placeholder").when(present, "ok").otherwise("missing")
    if rule.kind == "placeholder":
        return F.when(F.array_contains(placeholders, name), "placeholder").otherwise("ok")
    if rule.kind == "pattern":
        text = F.coalesce(F.when(form != "", form), F.when(present, value.cast("string")))
        return F.when(F.array_contains(invalid, name), "bad_pattern").when(text.isNull() | text.rlike(PATTERNS[rule.pattern]), "ok").otherwise("bad_pattern")
    if rule.kind == "range":
        number = any(isinstance(x, (int, float)) for x in (rule.low, rule.high))
        subject = value.try_cast("double") if number else F.to_date(F.when(F.substring(value.cast("string"), 1, 10).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.substring(value.cast("string"), 1, 10)).try_cast("date"))
        bound = lambda x: F.lit(x) if number else F.lit(today if x == "today" else x).cast("date")
        out = F.lit(False)
        if rule.low is not None:
            out = out | (subject < bound(rule.low))
        if rule.high is not None:
            out = out | (subject > bound(rule.high))
        return F.when(present & F.coalesce(out, F.lit(False)), "out_of_range").otherwise("ok")
    if rule.kind == "code_list":
        text = F.trim(value.cast("string"))
        return F.when(~present | text.isin(*rule.codes) | F.upper(text).isin(*rule.codes), "ok").otherwise("not_in_code_list")
    if rule.kind == "checksum":
        return F.when(F.exists(ids, lambda i: (i["scheme"] == rule.scheme) & ~F.coalesce(i["valid"], F.lit(True))), "bad_checksum").otherwise("ok")
    raise ValueError(f"no such rule: {rule.kind}")


def check(records: DataFrame, rules: list[Rule], today: str, forms: dict[str, str] | None = None) -> DataFrame:
    """source_system, source_key, rule_id, attribute, dimension, severity and code of every rule and record; ``ok`` is a pass.

    records has the attributes as columns, and placeholders, invalid (arrays of
    names) and ids (array of scheme, value, valid) where it has such; ``forms``
    names the column of an attribute's standard form. An absent value passes all
    but ``required``; a null checksum verdict passes. All rules are one pass over
    the records.
    """
    none, no_ids = F.array().cast("array<string>"), F.array().cast("array<struct<scheme:string,value:string,valid:boolean>>")
    has = lambda c, other: F.coalesce(F.col(c), other) if c in records.columns else other
    value = lambda a: F.col(a) if a in records.columns else F.lit(None).cast("string")
    form = lambda a: F.col(forms[a]) if forms and a in forms else F.lit(None).cast("string")
    results = F.array(
        *(
            F.struct(
                F.lit(r.rule_id).alias("rule_id"), F.lit(r.attribute).alias("attribute"), F.lit(r.dimension).alias("dimension"), F.lit(r.severity).alias("severity"),
                _code(r, value(r.attribute), has("placeholders", none), has("invalid", none), has("ids", no_ids), form(r.attribute), today).alias("code"),
            )
            for r in rules
        )
    )
    return records.select("source_system", "source_key", F.explode(results).alias("r")).select("source_system", "source_key", "r.*")


def failures(results: DataFrame) -> DataFrame:
    return results.where("code <> 'ok'")


def replace_failures(stored: DataFrame, checked: DataFrame, found: DataFrame) -> DataFrame:
    """Stored failures after a batch: those of records that were checked again give way to what was found now."""
    keys = ["source_system", "source_key"]
    return stored.join(checked.select(*keys).distinct(), keys, "left_anti").unionByName(found)


def held(found: DataFrame) -> DataFrame:
    """Records with a failure whose severity holds them back, and the rules they failed."""
    return found.where("severity = 'hold'").groupBy("source_system", "source_key").agg(F.array_sort(F.collect_set("rule_id")).alias("rules"))


def changes(before: DataFrame, after: DataFrame, keys: list[str], attributes: list[str], critical: tuple[str, ...] = (), end_date: str | None = None) -> DataFrame:
    """keys, changed (names in order), critical and ended of every record of both tables whose attributes differ, null being equal to null."""
    old = before.select(*keys, *(F.col(a).alias(f"_old_{a}") for a in attributes))
    moved = F.array_compact(F.array(*(F.when(~F.col(a).eqNullSafe(F.col(f"_old_{a}")), F.lit(a)) for a in attributes)))
    out = after.select(*keys, *attributes).join(old, keys).withColumn("changed", moved).where(F.size("changed") > 0)
    is_critical = F.arrays_overlap("changed", F.array(*map(F.lit, critical))) if critical else F.lit(False)
    ended = F.array_contains("changed", F.lit(end_date)) & F.col(end_date).isNotNull() if end_date else F.lit(False)
    return out.select(*keys, "changed", is_critical.alias("critical"), ended.alias("ended"))


def worth_explaining(pairs: DataFrame, lower_edge: float) -> DataFrame:
    """Pairs whose weight reaches the lower edge or that a hard rule decides; the rest never gets an explanation."""
    return pairs.where((F.col("weight") >= lower_edge) | F.col("rule").isNotNull())
