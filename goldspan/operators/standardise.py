"""Records standardised by a declared model: one projection gives values, match forms, identifiers, keys, references and what was wrong.

A model is plain data: attributes with a type and a standardiser, sources with
their date order, passes of key expressions. It is compiled to column
expressions once; nothing is decided row by row in Python but phonetic codes and
the folding of letters beyond Latin.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldspan.functions import keys as K
from goldspan.functions import likeness as L
from goldspan.functions import standard as S


@dataclass(frozen=True)
class Attribute:
    """type: text, integer, number, boolean, date, timestamp, reference or group (of ``fields``)."""

    name: str
    type: str = "text"
    standardise: str = "none"
    scheme: str | None = None
    checksum: str | None = None
    #: Dates that stand for an unknown one: (exact date or ``*-01-01``, sources or none for all).
    placeholders: tuple[tuple[str, tuple[str, ...]], ...] = ()
    fields: tuple[str, ...] = ()


@dataclass(frozen=True)
class Model:
    entity: str
    attributes: tuple[Attribute, ...]
    day_first: tuple[str, ...] = ()
    calling_code: str = "999"
    passes: dict[str, list[str]] = field(default_factory=dict)
    display: str = ""


@dataclass(frozen=True)
class Key:
    function: str | None
    form: str
    arg: int | None = None


#: Key functions, and whether they take a number.
KEY_FUNCTIONS = {"metaphone": False, "soundex": False, "nysiis": False, "first": True, "last": True, "sorted_tokens": True, "id": False}
_FORM = r"[a-z][a-z0-9_]*(?:\.[a-z0-9_]+)*"


def parse_key(text: str) -> Key:
    """A form, or function(form), or function(form, n); anything else is an error."""
    m = re.fullmatch(rf"\s*(?:({_FORM})|([a-z_]+)\(\s*({_FORM})\s*(?:,\s*(\d+)\s*)?\))\s*", text)
    if not m:
        raise ValueError(f"no key expression: {text[:60]!r}")
    if m[1]:
        return Key(None, m[1])
    if m[2] not in KEY_FUNCTIONS:
        raise ValueError(f"no key function: {m[2]}")
    if KEY_FUNCTIONS[m[2]] != (m[4] is not None) or (m[4] and int(m[4]) < 1):
        raise ValueError(f"wrong argument: {text[:60]!r}")
    return Key(m[2], m[3], int(m[4]) if m[4] else None)


# --- coercion ------------------------------------------------------------------------


def as_int(c: Column) -> Column:
    """Whole numbers, also those written as text or as a number without a fraction."""
    c = F.trim(c.cast("string"))
    return F.when(c.rlike(r"^[+-]?\d+$"), c.try_cast("bigint")).when(c.rlike(r"^[+-]?\d+\.0+$"), F.regexp_replace(c, r"\.0+$", "").try_cast("bigint"))


def as_number(c: Column) -> Column:
    """Finite numbers; NaN and infinities are none."""
    c = F.trim(c.cast("string"))
    n = F.when(c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), c.try_cast("double"))
    return F.when(F.abs(n) < float("inf"), n)


def as_bool(c: Column) -> Column:
    c = F.lower(F.trim(c.cast("string")))
    return F.when(c.isin("true", "yes", "y", "1"), F.lit(True)).when(c.isin("false", "no", "n", "0"), F.lit(False))


def as_timestamp(c: Column) -> Column:
    return F.when(F.trim(c).rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.trim(c).try_cast("timestamp"))


def clean_entries(c: Column, fields: tuple[str, ...]) -> Column:
    """A group's entries with cleaned fields, without entries that have none; null for none left."""
    cleaned = F.transform(c, lambda e: F.struct(*(S.clean_text(e[f], python=False).alias(f) for f in fields)))
    kept = F.filter(cleaned, lambda e: F.coalesce(*(e[f] for f in fields)).isNotNull())
    return F.when(F.size(kept) > 0, kept)


# --- one record ------------------------------------------------------------------------


def _standard(a: Attribute, model: Model, raw: Column) -> tuple[Column, dict[str, Column]]:
    """Display value and match forms (by suffix) of a present value; a null value is invalid."""
    text = S.clean_text(raw.cast("string"))
    if a.type == "date" or a.standardise == "date":
        iso = S.iso_date(raw, F.col("source_system").isin(*model.day_first) if model.day_first else False)
        return iso, {"": iso, **({"year": F.substring(iso, 1, 4)} if a.standardise == "date" else {})}
    if a.standardise in ("none", "") and a.type in ("integer", "number", "boolean", "timestamp"):
        v = {"integer": as_int, "number": as_number, "boolean": as_bool, "timestamp": as_timestamp}[a.type](raw).cast("string")
        return v, {"": v}
    if a.standardise == "person_name":
        plain = S.fold(text)
        bare = F.replace(plain, F.lit(" "), F.lit(""))
        return F.when(plain.isNotNull(), text), {"": plain, "metaphone": S.empty_to_null(L.metaphone_of(bare)), "nysiis": S.empty_to_null(L.nysiis_of(bare))}
    if a.standardise == "org_name":
        core = S.org_core(text)
        first = F.get(F.split(core, " "), F.lit(0))
        return F.when(core.isNotNull(), text), {"": core, "first": first, "first.metaphone": S.empty_to_null(L.metaphone_of(first)), "tokens": F.array_join(F.array_sort(F.split(core, " ")), " "), "legal": S.org_legal(text)}
    if a.standardise == "email":
        v = S.email(raw)
        return v, {"": v, "local": F.split(v, "@")[0], "domain": F.split(v, "@")[1]}
    if a.standardise == "phone":
        v = S.phone_e164(raw, model.calling_code)
        return v, {"": v, "last7": F.right(v, F.lit(7))}
    if a.standardise == "postcode":
        v = S.postcode(raw)
        return F.when(v.isNotNull(), text), {"": v, "prefix": F.substring(v, 1, 3)}
    if a.standardise == "registered_id":
        v = K.registered_id(raw)
        return v, {"": v}
    if a.standardise == "url":
        v = S.url_domain(raw)
        return F.when(v.isNotNull(), text), {"": v}
    if a.standardise == "code":
        v = S.code(raw)
        return v, {"": v}
    if a.standardise == "text":
        return text, {"": S.fold(text)}
    return text, {"": text}


def _placeholder(a: Attribute, iso: Column) -> Column:
    out = F.lit(False)
    for what, sources in a.placeholders:
        hit = iso.endswith(what[1:]) if what.startswith("*") else iso == what
        out = out | (hit & F.col("source_system").isin(*sources) if sources else hit)
    return F.coalesce(out, F.lit(False))


def form_name(form: str) -> str:
    """The column of a match form: points become double underscores, behind ``m_``."""
    return "m_" + form.replace(".", "__")


def standardise(records: DataFrame, model: Model) -> DataFrame:
    """source_system, source_key, a column for each value, ``m_``-columns for its match forms, ids, references, placeholders, invalid, keys and sample_hash.

    Blank values are absent, not invalid. A placeholder date is taken out of
    values and forms and named in placeholders. A value that can't be
    standardised is named in invalid. keys is a map from pass to key; a pass with
    a missing part has none. Null keys of records stay null; columns that the
    model doesn't name are left out; attributes that the table lacks are absent.
    """
    told: dict[str, Column] = {}
    invalid, placeholders, ids, references = [], [], [], []
    for a in model.attributes:
        if a.name not in records.columns:
            told[a.name] = F.lit(None).cast("string")
            continue
        raw = F.col(a.name)
        if a.type == "group":
            told[a.name] = clean_entries(raw, a.fields)
            invalid.append(F.when(F.exists(raw, lambda e: e.isNull()), F.lit(a.name)))
            continue
        present = raw.isNotNull() & (F.trim(raw.cast("string")) != "")
        if a.type == "reference":
            references.append(F.struct(F.lit(a.name).alias("key"), F.when(present, S.clean_text(raw)).alias("value")))
            continue
        value, forms = _standard(a, model, raw)
        value = F.when(present, value)
        unknown = _placeholder(a, value) if a.placeholders else F.lit(False)
        invalid.append(F.when(present & value.isNull(), F.lit(a.name)))
        if a.placeholders:
            placeholders.append(F.when(unknown, F.lit(a.name)))
        told[a.name] = F.when(~unknown, value) if a.placeholders else value
        for suffix, form in forms.items():
            told[form_name(f"{a.name}.{suffix}" if suffix else a.name)] = F.when(present & ~unknown, form)
        if a.standardise == "registered_id":
            verdict = {"luhn": K.luhn_valid, "mod97": K.mod97_valid, "mod11": K.mod11_valid}[a.checksum](value) if a.checksum else F.lit(None).cast("boolean")
            if a.checksum == "luhn" or a.checksum == "mod11":  # what isn't all digits fails a checksum of digits
                verdict = F.when(value.isNotNull(), F.coalesce(verdict, F.lit(False)))
            ids.append(F.when(value.isNotNull(), F.struct(F.lit(a.scheme).alias("scheme"), value.alias("value"), verdict.alias("valid"))))
    none = F.array().cast("array<string>")
    out = records.select(
        "source_system", "source_key", *(c.alias(n) for n, c in told.items()),
        (F.array_compact(F.array(*ids)) if ids else F.array().cast("array<struct<scheme:string,value:string,valid:boolean>>")).alias("ids"),
        (F.map_from_entries(F.filter(F.array(*references), lambda r: r["value"].isNotNull())) if references else F.create_map().cast("map<string,string>")).alias("references"),
        (F.array_compact(F.array(*placeholders)) if placeholders else none).alias("placeholders"), (F.array_compact(F.array(*invalid)) if invalid else none).alias("invalid"),
        K.hash63(F.lit(model.entity), "source_system", "source_key").alias("sample_hash"),
    )
    return out.withColumn("keys", pass_keys(model.passes, out.columns))


def key_part(key: Key, columns: list[str]) -> Column:
    """A key's part over standardised records, or null."""
    name = form_name(key.form)
    ready = form_name(f"{key.form}.{key.function}")
    if key.function in ("metaphone", "nysiis", "soundex") and ready in columns:
        return F.col(ready)
    if name not in columns:
        return F.lit(None).cast("string")
    c = S.empty_to_null(F.trim(F.col(name).cast("string")))
    bare = S.empty_to_null(F.replace(c, F.lit(" "), F.lit("")))
    return {
        None: lambda: c, "first": lambda: F.substring(c, 1, key.arg), "last": lambda: F.right(c, F.lit(key.arg)), "soundex": lambda: F.soundex(bare),
        "metaphone": lambda: S.empty_to_null(L.metaphone_of(bare)), "nysiis": lambda: S.empty_to_null(L.nysiis_of(bare)),
        "sorted_tokens": lambda: S.empty_to_null(F.array_join(F.slice(F.array_sort(F.split(c, " +")), 1, key.arg), " ")),
        "id": lambda: F.get(F.transform(F.filter("ids", lambda i: (i["value"] == c) & i["valid"]), lambda i: F.concat_ws(":", i["scheme"], i["value"])), F.lit(0)),
    }[key.function]()


def pass_keys(passes: dict[str, list[str]], columns: list[str]) -> Column:
    """Map from pass to key: the parts joined by |, in lower case."""
    made = []
    for name, parts in passes.items():
        cols = [key_part(parse_key(p), columns) for p in parts]
        whole = F.lit(True)
        for c in cols:
            whole = whole & c.isNotNull()
        made.append(F.struct(F.lit(name).alias("key"), F.when(whole, F.lower(F.concat_ws("|", *cols))).alias("value")))
    if not made:
        return F.create_map().cast("map<string,string>")
    return F.map_from_entries(F.filter(F.array(*made), lambda e: e["value"].isNotNull()))


def key_rows(standardised: DataFrame) -> DataFrame:
    """source_system, source_key, pass and key of every key.

    An outer explode: a plain one would have the planner put the whole making of
    the keys into a filter below it as well.
    """
    return standardised.select("source_system", "source_key", F.explode_outer("keys").alias("pass", "key")).where("key is not null")


def display_name(template: str, masked: tuple[str, ...] = (), fallback: str = "source_key") -> Column:
    """A template like ``{given_name} {family_name}`` filled from columns; masked ones show their first letter only. Empty gives the fallback column."""
    parts = []
    for text, name in re.findall(r"([^{}]*)(?:\{([^{}]*)\})?", template):
        if text:
            parts.append(F.lit(text))
        if name:
            value = F.col(name).cast("string")
            parts.append(F.coalesce(K.mask(value) if name in masked else value, F.lit("")))
    filled = F.trim(F.regexp_replace(F.concat(*parts), r"\s+", " "))
    return F.when(filled != "", filled).otherwise(F.col(fallback).cast("string"))


def value_text(c: Column, kind: str) -> Column:
    """A value as shown: yes and no, plain numbers, ISO dates, a group's entries one after the other with their kind in front."""
    if kind == "boolean":
        return F.when(c, "yes").when(~c, "no")
    if kind == "number":
        return F.regexp_replace(F.regexp_replace(c.cast("decimal(38,10)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return S.empty_to_null(F.trim(c.cast("string")))


def entries_text(c: Column, fields: tuple[str, ...], key: str = "kind") -> Column:
    """A group as text: ``kind: field, field; ...``"""
    def one(e: Column) -> Column:
        body = F.array_join(F.filter(F.array(*(e[f] for f in fields if f != key)), lambda x: x.isNotNull() & (x != "")), ", ")
        return F.when(e[key].isNull() | (e[key] == ""), body).when(body != "", F.concat(e[key], F.lit(": "), body)).otherwise(e[key])

    return S.empty_to_null(F.array_join(F.filter(F.transform(c, one), lambda t: t != ""), "; "))


def canonical_map(c: Column) -> Column:
    """A map of texts as JSON with sorted keys and no blanks: equal maps give equal text, whatever their order."""
    entries = F.array_sort(F.map_entries(c))
    quote = lambda x: F.substring(F.to_json(F.array(x)), 2, 2_000_000_000)  # noqa: E731 - one element of an array, its bracket cut off below
    inner = F.transform(entries, lambda e: F.concat(F.regexp_replace(quote(e["key"]), r"\]$", ""), F.lit(":"), F.when(e["value"].isNull(), "null").otherwise(F.regexp_replace(quote(e["value"]), r"\]$", ""))))
    return F.when(c.isNotNull(), F.concat(F.lit("{"), F.array_join(inner, ","), F.lit("}")))


def fingerprint(text: Column) -> Column:
    return F.sha2(text, 256)


def to_vault(rows: DataFrame, attributes: list[str], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows with the values of personal attributes replaced by references {"$vault": id}, and the vault (value_id, attr_name, value).

    An id follows from record, attribute and value, so equal values of different records don't share one.
    """
    ident = lambda a: K.derived_id("V", F.lit(a), *keys, a)
    swapped = rows.withColumns({a: F.when(F.col(a).isNotNull(), F.to_json(F.struct(ident(a).alias("$vault")))) for a in attributes})
    cells = F.array(*(F.struct(ident(a).alias("value_id"), F.lit(a).alias("attr_name"), F.col(a).cast("string").alias("value")) for a in attributes))
    vault = rows.select(F.explode(cells).alias("v")).select("v.*").where("value is not null").distinct()
    return swapped, vault


def from_vault(rows: DataFrame, vault: DataFrame, attributes: list[str]) -> DataFrame:
    """rows with references replaced by the vault's values; a value that was erased gives null."""
    for a in attributes:
        own = vault.where(F.col("attr_name") == a).select(F.col("value_id").alias("_v"), F.col("value").alias("_value"))
        rows = rows.withColumn("_v", F.get_json_object(a, "$['$vault']")).join(own, "_v", "left").withColumn(a, F.when(F.col("_v").isNotNull(), F.col("_value")).otherwise(F.col(a))).drop("_v", "_value")
    return rows
