"""Checksums, hashes, masks and derived identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def registered_id(c: Column | str) -> Column:
    """Capitals and digits of an identifier, without spaces, full stops, semicolons and hyphens."""
    out = F.regexp_replace(F.upper(_col(c)), r"[\s.;\-]", "")
    return F.when(out != "", out)


def _digits(c: Column) -> Column:
    return F.transform(F.filter(F.split(c, ""), lambda d: d != ""), lambda d: d.cast("int"))


def luhn_valid(c: Column | str) -> Column:
    """Luhn verdict; null for null and for what isn't all digits."""
    c = _col(c)
    digits = F.reverse(_digits(c))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d * 2 > 9, d * 2 - 9).otherwise(d * 2))
    return F.when(c.rlike(r"^\d+$"), F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0)


def mod97_valid(c: Column | str) -> Column:
    """ISO 7064 mod 97-10 verdict with letters as 10 to 35, the remainder kept small digit by digit."""
    c = _col(c)
    number = lambda ch: F.when(ch.rlike(r"\d"), ch.cast("int")).otherwise(F.ascii(ch) - 55)
    step = lambda a, ch: F.when(ch.rlike(r"\d"), (a * 10 + number(ch)) % 97).otherwise((a * 100 + number(ch)) % 97)
    chars = F.filter(F.split(F.upper(c), ""), lambda d: d != "")
    return F.when(c.rlike(r"^[0-9A-Za-z]+$"), F.aggregate(chars, F.lit(0), step) == 1)


def mod11_valid(c: Column | str) -> Column:
    """Weights 2 to 7 from the right before the last digit, which is (11 - sum mod 11) mod 11; 10 is no digit."""
    c = _col(c)
    digits = F.reverse(_digits(c))
    total = F.aggregate(F.transform(F.slice(digits, 2, 60), lambda d, i: d * (i % 6 + 2)), F.lit(0), lambda a, x: a + x)
    check = (11 - total % 11) % 11
    return F.when(c.rlike(r"^\d{2,60}$"), (check != 10) & (check == digits[0]))


def hash63(*parts: Column | str) -> Column:
    """The first 8 bytes of the SHA-256 of the parts joined by |, shifted right by one bit."""
    text = F.concat_ws("|", *(_col(p).cast("string") for p in parts))
    return _top63(F.sha2(text, 256))


def _top63(digest: Column) -> Column:
    """15 hexadecimal digits and the upper three bits of the next, which fit a bigint."""
    low = F.shiftright(F.conv(F.substring(digest, 16, 1), 16, 10).cast("bigint"), 1)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") * 8 + low


def hmac63(key: bytes, message: Column) -> Column:
    """The first 63 bits of HMAC-SHA256, built from sha2: the key's pads are literals."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 256))
    digest = F.sha2(F.concat(F.lit(outer), first), 256)
    return _top63(digest)


def drawn(key: bytes, share: float, *parts: Column | str) -> Column:
    """Whether a keyed draw takes the row; a larger share takes all that a smaller one does."""
    return hmac63(key, F.concat_ws("|", *(_col(p).cast("string") for p in parts))) % 1_000_000 < round(share * 1_000_000)


def mask(c: Column | str) -> Column:
    c = _col(c)
    return F.when(c.isNotNull(), F.concat(F.substring(c, 1, 1), F.lit("***")))


def masked(c: Column, kind: DataType) -> Column:
    """A personal value as a reader may see it: the first letter of a text, nothing of any other type."""
    return mask(c) if isinstance(kind, StringType) else F.lit(None).cast(kind)


def pattern_of(c: Column | str) -> Column:
    """Letters as A and a, digits as 9, at most 40 characters and an ellipsis."""
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(_col(c), r"\p{Lu}", "A"), r"[\p{L}&&[^A]]", "a"), r"\p{Nd}", "9")
    return F.when(F.length(c) > 40, F.concat(F.substring(c, 1, 40), F.lit("…"))).otherwise(c)


def derived_id(prefix: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.concat_ws("|", *(_col(p).cast("string") for p in parts)), 256), 1, 16))


def group_key(*parts: Column | str) -> Column:
    """32 hexadecimal digits that stand for a group of equal parts."""
    return F.substring(F.sha2(F.concat_ws("|", *(_col(p).cast("string") for p in parts)), 256), 1, 32)


def safe_token(c: Column | str) -> Column:
    """A short plain token as it is, anything else as a hash."""
    c = _col(c)
    return F.when(c.rlike(r"^[A-Za-z0-9_.:-]{1,64}$"), c).otherwise(F.concat(F.lit("h-"), F.substring(F.sha2(c, 256), 1, 16)))
