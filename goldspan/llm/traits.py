"""What a record tells about the person or firm it describes, and how two records compare.

``person`` and ``firm`` read a record into traits; ``compare_persons`` and
``compare_firms`` give the level of agreement in each field: 0 where a side is
silent, 1 for agreement, higher levels for ever weaker likeness.
"""

from __future__ import annotations

import datetime
import re
from functools import lru_cache

from goldspan.functions.standard import LEGAL_FORMS, fold_text
from goldspan.llm.addresses import filler, read
from goldspan.llm.addresses import slips as _slips

# Fixed values.
TITLES = {"mx", "mr", "mrs", "ms", "miss", "dr", "prof", "sir"}
#: Spelt-out legal forms, by folded words at the end of a name.
LONG_FORMS = (
    "public limited company", "gesellschaft mbh", "gesellschaft mit beschraenkter haftung", "gesellschaft mit beschrankter haftung", "societe anonyme",
    "aktiengesellschaft", "besloten vennootschap", "naamloze vennootschap", "spolka z oo", "sp z oo", "sp zoo", "spolka z ograniczona odpowiedzialnoscia",
    "sarl", "kg", "ohg", "spa", "as", "aps", "se", "kk", "oyj", "sro", "spol s ro",
)
_DATES = (
    (re.compile(r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})"), (1, 2, 3)),
    (re.compile(r"^(\d{4})(\d{2})(\d{2})$"), (1, 2, 3)),
    (re.compile(r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})$"), (3, 2, 1)),
)


def date_of(raw: str | None, source: str | None) -> str:
    """yyyymmdd, or yyyy for a bare year, or nothing for what isn't told or stands for an unknown day."""
    raw = (raw or "").strip()
    if re.fullmatch(r"\d{4}", raw):
        return raw
    for rx, (y, m, d) in _DATES:
        if got := rx.match(raw):
            year, month, day = int(got[y]), int(got[m]), int(got[d])
            if rx is _DATES[2][0] and source not in ("student_records",) and "." not in raw and month > 12 >= day:
                month, day = day, month
            try:
                datetime.date(year, month, day)
            except ValueError:
                return ""
            if (year, month, day) == (1900, 1, 1):
                return ""
            if source == "student_records" and (month, day) == (1, 1):
                return str(year)
            return f"{year:04d}{month:02d}{day:02d}"
    return ""


def phone_of(raw: str | None) -> str:
    """National digits without country code and leading zero."""
    if filler(raw):
        return ""
    text = re.sub(r"\(0\)", "", raw)
    plus = text.strip().startswith("+")
    digits = re.sub(r"\D", "", text)
    if digits.startswith("00"):
        digits, plus = digits[2:], True
    if plus and digits.startswith("999"):
        digits = digits[3:]
    digits = digits.lstrip("0")
    return digits if len(digits) >= 6 and len(set(digits)) > 2 else ""


def email_of(raw: str | None) -> str:
    low = re.sub(r"\s*\(at\)\s*|\s+at\s+", "@", (raw or "").strip().lower())
    low = re.sub(r"\s", "", low)
    low = re.sub("@+", "@", low)
    return low if re.fullmatch(r"[^@]+@[^@]+\.[^@.]+", low) else ""


def domain_of(raw: str | None) -> str:
    if filler(raw) or "." not in raw:
        return ""
    low = re.sub(r"^[a-z]+://", "", raw.strip().lower())
    low = re.sub(r"[/?#:].*$", "", low).split("@")[-1]
    return re.sub(r"^www\.", "", low).strip(".")


def luhn(digits: str) -> bool:
    if not (digits.isascii() and digits.isdigit()):
        return False
    total = 0
    for k, ch in enumerate(reversed(digits)):
        n = int(ch) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _remainder(digits: str) -> int:
    """Of the division by 97, in steps: Python reads no number of more than 4,300 digits at once."""
    left = 0
    for k in range(0, len(digits), 1000):
        left = int(str(left) + digits[k : k + 1000]) % 97
    return left


def mod97(digits: str) -> bool:
    return digits.isascii() and digits.isdigit() and _remainder(digits) == 1


def id_of(raw: str | None) -> str:
    return "" if filler(raw) else re.sub(r"[^0-9A-Z]", "", raw.upper())


def _name(raw: str | None) -> str:
    if filler(raw):
        return ""
    words = [w for w in (fold_text(raw) or "").split() if w not in TITLES]
    return " ".join(words)


def _places(addresses: list | None, postcode: str | None, city: str | None) -> tuple[list[str], list[str], str]:
    """Houses (with street), postcodes and the town."""
    houses, codes = [], []
    for a in addresses or []:
        if not a:
            continue
        house, kind, street, place, code = read(a.get("line1"), a.get("city") or city, a.get("postcode") or postcode)
        if street and house != "/":
            houses.append(f"{house}|{kind}|{street}")
        if code:
            codes.append(code)
        if filler(city) and place:
            city = place
    own = "" if filler(postcode) else re.sub(r"[^A-Z0-9]", "", postcode.upper())
    if re.fullmatch(r"[A-Z]{2}\d{1,2}\d[A-Z]{2}|\d{5}", own):
        codes.append(own)
    town = "" if filler(city) else (fold_text(city) or "").replace(" ", "")
    return sorted(set(houses)), sorted(set(codes)), town


def person(r: dict) -> dict:
    houses, codes, town = _places(r["addresses"], r["postcode"], r["city"])
    return {
        "given": _name(r["given_name"]), "family": _name(r["family_name"]), "born": date_of(r["birth_date"], r["source_system"]), "email": email_of(r["email"]),
        "phone": phone_of(r["phone"]), "ident": id_of(r["person_ref"]), "houses": houses, "codes": codes, "town": town, "employer": r["employer"] or "",
    }


def core_name(raw: str | None) -> str:
    """The name of a firm without bracketed town, legal form and joining words."""
    if filler(raw):
        return ""
    text = re.sub(r"\([^)]*\)\s*$", "", raw)
    text = fold_text(re.sub(r"\.(?=\S|$)", lambda m: "", text.replace("&", " and ").replace(". ", " "))) or ""
    text = " " + text
    for _ in range(3):
        for form in (*LONG_FORMS, *LEGAL_FORMS):
            if text.endswith(" " + form) and len(text) > len(form) + 2:
                text = text[: -len(form) - 1]
    return " ".join(w for w in text.split() if w not in ("and", "the", "of"))


def firm(r: dict) -> dict:
    houses, codes, town = _places(r["addresses"], r["postcode"], r["city"])
    mail = email_of(r["email"])
    return {
        "given": "", "family": core_name(r["name"]), "born": "", "email": domain_of(r["website"]) or mail.split("@")[-1], "phone": phone_of(r["phone"]),
        "ident": id_of(r["registered_id"]), "houses": houses, "codes": codes, "town": town, "employer": r["parent"] or "",
    }


def slips(a: str, b: str, most: int = 2) -> int:
    """As of addresses; a slip removes one letter that the other side lacks at most, so most pairs end before the table of distances."""
    if a == b:
        return 0
    x, y = set(a), set(b)
    if len(x - y) > most or len(y - x) > most:
        return most + 1
    return _slips(a, b, most)


#: For words that come again and again, such as streets and towns.
word_slips = lru_cache(200_000)(slips)


@lru_cache(200_000)
def _word(a: str, b: str) -> int:
    """0 silent, 1 equal, 2 one shortens the other, 3 a slip apart, 4 likeness in most letters, 5 different."""
    if not a or not b:
        return 0
    if a == b:
        return 1
    x, y = a.split(), b.split()
    short, long = (x, y) if len("".join(x)) <= len("".join(y)) else (y, x)
    if all(any(w == v or (len(w) <= 2 and v.startswith(w)) for v in long) for w in short):
        return 2
    p, q = "".join(x), "".join(y)
    pet, full = (p, q) if len(p) <= len(q) else (q, p)
    if 3 < len(pet) <= 5 and pet[-1] in "iy" and pet[:3] == full[:3]:
        return 2
    if slips(p, q, 1) <= 1:
        return 3
    if slips(p, q, 2) <= 2 and min(len(p), len(q)) >= 5:
        return 4
    if len(x) > 1 and len(y) == 1 or len(y) > 1 and len(x) == 1:
        if any(slips(w, v, 1) <= 1 and len(w) > 3 for w in x for v in y):
            return 4
    return 5


def _born(a: str, b: str) -> int:
    """0 silent, 1 equal, 2 day and month swapped or a bare year that agrees, 3 one slip, 4 two digits off, 5 same year, 6 different."""
    if not a or not b:
        return 0
    if a == b:
        return 1 if len(a) == 8 else 2
    if len(a) != len(b):
        return 2 if a[:4] == b[:4] else 6
    if len(a) == 4:
        return 6
    if a[:4] == b[:4] and a[4:6] == b[6:] and a[6:] == b[4:6]:
        return 2
    off = sum(x != y for x, y in zip(a, b))
    if off == 1 or slips(a, b, 1) <= 1:
        return 3
    if off == 2:
        return 4
    return 5 if a[:4] == b[:4] else 6


def _ident(a: str, b: str, valid) -> int:
    """0 silent, 1 equal and valid, 2 equal or a slip apart where one fails its checksum, 3 different though one fails, 4 different and both valid."""
    if not a or not b:
        return 0
    both = valid(a) and valid(b)
    if a == b:
        return 1 if both else 2
    if slips(a, b, 1) <= 1:
        return 4 if both else 2
    return 4 if both else 3


def _place(a: dict, b: dict) -> int:
    """0 silent, 1 one house, 2 one fine postcode, 3 one town, 4 elsewhere."""
    same_area = (a["town"] and b["town"] and word_slips(a["town"], b["town"], 2) <= 2) or set(a["codes"]) & set(b["codes"])
    if same_area and a["houses"] and b["houses"]:
        if set(a["houses"]) & set(b["houses"]):
            return 1
        for x in a["houses"]:
            for y in b["houses"]:
                h1, k1, s1 = x.split("|")
                h2, k2, s2 = y.split("|")
                if h1 == h2 and k1 == k2 and word_slips(s1, s2, 2) <= 2:
                    return 1
    if any(not c.isdigit() for c in set(a["codes"]) & set(b["codes"])):
        return 2
    if same_area:
        return 3
    return 4 if (a["town"] or a["codes"]) and (b["town"] or b["codes"]) else 0


def _phone(a: str, b: str) -> int:
    if not a or not b:
        return 0
    return 1 if a == b else 2 if slips(a, b, 1) <= 1 else 3


def _tail(mail: str) -> str:
    """The last three letters or digits of an address's local part, which senders keep across domains."""
    return mail.split("@")[0][-3:]


def _email(a: str, b: str) -> int:
    """0 silent, 1 equal, 2 same local part or a slip apart, 3 same ending of the local part, 4 different.

    Numbers tell namesakes' addresses apart: another number is no slip.
    """
    if not a or not b:
        return 0
    if a == b:
        return 1
    x, y = a.split("@")[0], b.split("@")[0]
    if x == y or (slips(a, b, 1) <= 1 and sorted(filter(str.isdigit, x)) == sorted(filter(str.isdigit, y))):
        return 2
    return 3 if _tail(a) == _tail(b) else 4


def _site(a: str, b: str) -> int:
    """0 silent, 1 equal, 2 a slip apart, 3 same but for the ending behind the name, 4 different."""
    if not a or not b:
        return 0
    if a == b:
        return 1
    if slips(a, b, 1) <= 1:
        return 2
    return 4


PERSON_FIELDS = ("given", "family", "born", "email", "phone", "ident", "place", "work")


def compare_persons(a: dict, b: dict) -> tuple[int, ...]:
    given, family = _word(a["given"], b["given"]), _word(a["family"], b["family"])
    if (given in (0, 5) or family in (0, 5)) and a["given"] and b["family"]:
        crossed = _word(a["given"], b["family"]), _word(a["family"], b["given"])
        if crossed[0] in (1, 3) and crossed[1] in (0, 1, 2, 3):
            given, family = crossed[1], crossed[0]
    work = 0 if not a["employer"] or not b["employer"] else 1 if a["employer"] == b["employer"] else 2
    return given, family, _born(a["born"], b["born"]), _email(a["email"], b["email"]), _phone(a["phone"], b["phone"]), _ident(a["ident"], b["ident"], luhn), _place(a, b), work


@lru_cache(400_000)
def _fits(w: str, v: str) -> int:
    """0 equal, 1 a shortened word, 2 a slip or two, 3 another word."""
    if w == v:
        return 0
    if min(len(w), len(v)) >= 3 and (v.startswith(w) or w.startswith(v)):
        return 1
    most = 2 if min(len(w), len(v)) > 4 else 1
    return 2 if slips(w, v, most) <= most else 3


@lru_cache(200_000)
def _name_parts(name: str) -> tuple[tuple[str, ...], tuple[str, ...], str, frozenset[str]]:
    """Words, sorted words, all letters together, and which letters there are."""
    words = tuple(name.split())
    joined = "".join(words)
    return words, tuple(sorted(words)), joined, frozenset(joined)


@lru_cache(200_000)
def _firm_name(a: str, b: str) -> int:
    """0 silent, 1 equal words in any order, 2 shortened words, 3 slips, 4 words in common and others not, 5 different."""
    if not a or not b:
        return 0
    (x, xs, xj, xl), (y, ys, yj, yl) = _name_parts(a), _name_parts(b)
    if xs == ys:
        return 1
    if abs(len(xj) - len(yj)) <= 2 and len(xl - yl) <= 2 and len(yl - xl) <= 2 and _slips(xj, yj, 2) <= 2:
        return 3
    short, long = (x, y) if len(x) <= len(y) else (y, x)
    left, worst, other = list(long), 0, 0
    for w in short:
        fit, k = min((_fits(w, v), k) for k, v in enumerate(left))
        if fit == 3:
            other += 1
        else:
            left.pop(k)
            worst = max(worst, fit)
    if not other and not left:
        return 2 if worst < 2 else 3
    return 4 if other < len(short) else 5


def compare_firms(a: dict, b: dict) -> tuple[int, ...]:
    return 0, _firm_name(a["family"], b["family"]), 0, _site(a["email"], b["email"]), _phone(a["phone"], b["phone"]), _ident(a["ident"], b["ident"], mod97), _place(a, b), 0
