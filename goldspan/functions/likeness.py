"""Likeness of two texts: Jaro-Winkler, token-set ratio, phonetic codes, and the levels of agreement built on them.

A level is -1 where a side is missing, 0 for equality, and grows with difference.
Text distances that Spark has run in the JVM; the others are Arrow functions
that see only the values given to them, best distinct ones.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    """Jaro similarity, raised for a common start of up to four characters where it exceeds 0.7."""
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    left = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                left.append(ch)
                break
    if not left:
        return 0.0
    right = [b[j] for j, t in enumerate(taken) if t]
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    start = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        start += 1
    return jaro + start * weight * (1 - jaro)


def _ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over the total length."""
    if not a or not b:
        return 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b))


def token_set(a: str, b: str) -> float:
    """The best ratio among the common tokens alone and with either side's rest; 1 where one side's tokens are a subset."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common = " ".join(sorted(x & y))
    p, q = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if common and (not p or not q):
        return 1.0
    one, two = f"{common} {p}".strip(), f"{common} {q}".strip()
    return max(_ratio(common, one), _ratio(common, two), _ratio(one, two))


def nysiis(word: str) -> str:
    """The New York State Identification and Intelligence System code, untruncated."""
    w = "".join(ch for ch in word.upper() if "A" <= ch <= "Z")
    if not w:
        return ""
    for old, new in (("MAC", "MCC"), ("KN", "NN"), ("K", "C"), ("PH", "FF"), ("PF", "FF"), ("SCH", "SSS")):
        if w.startswith(old):
            w = new + w[len(old) :]
            break
    for old, new in (("EE", "Y"), ("IE", "Y"), ("DT", "D"), ("RT", "D"), ("RD", "D"), ("NT", "D"), ("ND", "D")):
        if w.endswith(old):
            w = w[: -len(old)] + new
            break
    out, i = w[0], 1
    while i < len(w):
        rest, step = w[i:], 1
        if rest.startswith("EV"):
            new, step = "AF", 2
        elif rest[0] in "AEIOU":
            new = "A"
        elif rest[0] == "Q":
            new = "G"
        elif rest[0] == "Z":
            new = "S"
        elif rest[0] == "M":
            new = "N"
        elif rest.startswith("KN"):
            new, step = "N", 2
        elif rest[0] == "K":
            new = "C"
        elif rest.startswith("SCH"):
            new, step = "SSS", 3
        elif rest.startswith("PH"):
            new, step = "FF", 2
        elif rest[0] == "H" and (w[i - 1] not in "AEIOU" or i + 1 >= len(w) or w[i + 1] not in "AEIOU"):
            new = w[i - 1]
        elif rest[0] == "W" and w[i - 1] in "AEIOU":
            new = "A"
        else:
            new = rest[0]
        for ch in new:
            if ch != out[-1]:
                out += ch
        i += step
    if len(out) > 1 and out.endswith("S"):
        out = out[:-1]
    if out.endswith("AY"):
        out = out[:-2] + "Y"
    if len(out) > 1 and out.endswith("A"):
        out = out[:-1]
    return out


def metaphone(word: str) -> str:
    """The original Metaphone code by its published rules."""
    w = "".join(ch for ch in word.upper() if "A" <= ch <= "Z")
    if not w:
        return ""
    if w[:2] in ("AE", "GN", "KN", "PN", "WR"):
        w = w[1:]
    elif w[0] == "X":
        w = "S" + w[1:]
    elif w[:2] == "WH":
        w = "W" + w[2:]
    vowels, front, out, n = "AEIOU", "EIY", "", len(w)
    at = lambda k: w[k] if 0 <= k < n else ""
    for i, ch in enumerate(w):
        before, after = at(i - 1), at(i + 1)
        if ch == before and ch != "C":
            continue
        if ch in vowels:
            out += ch if i == 0 else ""
        elif ch == "B":
            out += "" if i == n - 1 and before == "M" else "B"
        elif ch == "C":
            if before == "S" and after in front and after:
                continue
            if w[i : i + 3] == "CIA" or after == "H":
                out += "K" if after == "H" and before == "S" else "X"
            else:
                out += "S" if after and after in front else "K"
        elif ch == "D":
            out += "J" if after == "G" and at(i + 2) and at(i + 2) in front else "T"
        elif ch == "G":
            if after == "H" and at(i + 2) not in vowels or after == "N" and (i + 2 >= n or w[i + 2 :] == "ED"):
                continue
            if before == "D" and after and after in front:
                continue
            out += "J" if after and after in front and before != "G" else "K"
        elif ch == "H":
            if before and before in "CSPTG" or before in vowels and before and after not in vowels:
                continue
            out += "H" if after in vowels and after else ""
        elif ch == "K":
            out += "" if before == "C" else "K"
        elif ch == "P":
            out += "F" if after == "H" else "P"
        elif ch == "Q":
            out += "K"
        elif ch == "S":
            out += "X" if after == "H" or w[i : i + 3] in ("SIO", "SIA") else "S"
        elif ch == "T":
            if w[i : i + 3] in ("TIA", "TIO"):
                out += "X"
            elif after == "H":
                out += "0"
            elif w[i : i + 3] != "TCH":
                out += "T"
        elif ch == "V":
            out += "F"
        elif ch in "WY":
            out += ch if after in vowels and after else ""
        elif ch == "X":
            out += "KS"
        elif ch == "Z":
            out += "S"
        elif ch in "FJLMNR":
            out += ch
    return out


def _pairwise(fn):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        kept: dict[tuple, float] = {}
        out = []
        for x, y in zip(a, b):
            if x is None or y is None:
                out.append(None)
                continue
            if (x, y) not in kept:
                kept[x, y] = fn(x, y)
            out.append(kept[x, y])
        return pd.Series(out, dtype="float64")

    return run


jaro_winkler_of = F.pandas_udf(_pairwise(jaro_winkler), DoubleType())
token_set_of = F.pandas_udf(_pairwise(token_set), DoubleType())


@F.pandas_udf(StringType())
def metaphone_of(words: pd.Series) -> pd.Series:
    return words.map(lambda w: metaphone(w.replace(" ", "")) or None, na_action="ignore")


@F.pandas_udf(StringType())
def nysiis_of(words: pd.Series) -> pd.Series:
    return words.map(lambda w: nysiis(w.replace(" ", "")) or None, na_action="ignore")


def _levels(a: Column, b: Column, *steps: Column) -> Column:
    """-1 where a side is missing or empty, 0 for equality, then the number of the first step that holds, one more for none."""
    missing = a.isNull() | b.isNull() | (a == "") | (b == "")
    out = F.when(missing, -1).when(a == b, 0)
    for k, step in enumerate(steps, 1):
        out = out.when(step, k)
    return out.otherwise(len(steps) + 1)


def exact_level(a: Column, b: Column) -> Column:
    return _levels(a, b)


def name_level(a: Column, b: Column) -> Column:
    unequal = F.when(a != b, a)  # equal pairs never reach Python
    score = jaro_winkler_of(unequal, b)
    return _levels(a, b, score >= 0.95, score >= 0.88)


def phonetic_level(a: Column, b: Column) -> Column:
    alike = (metaphone_of(a) == metaphone_of(b)) | (nysiis_of(a) == nysiis_of(b))
    return _levels(a, b, F.coalesce(alike, F.lit(False)), jaro_winkler_of(a, b) >= 0.88)


def levenshtein_level(a: Column, b: Column) -> Column:
    near = F.levenshtein(a, b, 2)
    return _levels(a, b, (near >= 0) & (near <= 1), near >= 0)


def token_set_level(a: Column, b: Column) -> Column:
    score = token_set_of(F.when(a != b, a), b)
    return _levels(a, b, score >= 0.90, score >= 0.75)


def date_level(a: Column, b: Column) -> Column:
    """1 for day and month swapped in one year or one edit of the ISO text, 2 for the same year."""
    same_year = F.substring(a, 1, 4) == F.substring(b, 1, 4)
    swapped = same_year & (F.substring(a, 6, 2) == F.substring(b, 9, 2)) & (F.substring(a, 9, 2) == F.substring(b, 6, 2))
    return _levels(a, b, swapped | (F.levenshtein(a, b) == 1), same_year)


def identifier_level(a: Column, b: Column, a_valid: Column, b_valid: Column) -> Column:
    missing = a.isNull() | b.isNull() | (a == "") | (b == "")
    return F.when(missing, -1).when((a == b) & a_valid & b_valid, 0).when(a == b, 1).otherwise(2)


def phone_level(a: Column, b: Column) -> Column:
    return _levels(a, b, F.right(a, F.lit(7)) == F.right(b, F.lit(7)))


def email_level(a: Column, b: Column) -> Column:
    local_a, local_b = F.substring_index(a, "@", 1), F.substring_index(b, "@", 1)
    same_domain = F.substring_index(a, "@", -1) == F.substring_index(b, "@", -1)
    near = jaro_winkler_of(F.when(same_domain & (local_a != local_b), local_a), local_b) >= 0.92
    return _levels(a, b, (local_a == local_b) | F.coalesce(same_domain & near, F.lit(False)))


def postcode_level(a: Column, b: Column) -> Column:
    return _levels(a, b, F.substring(a, 1, 3) == F.substring(b, 1, 3))
