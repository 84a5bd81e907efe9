"""Levels of agreement of many pairs of records at once.

What ``traits`` compares pair by pair is decided here for whole arrays: equal and
silent fields by codes, fields too far apart for any likeness by the letters that
only one side has. Only what is left is compared by ``traits``, each pair of
values once. The levels are those of ``traits`` for every pair.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from goldspan.llm import traits

#: A bit for each letter and digit, one for all that is neither, none for a blank.
_BITS = np.zeros(256, np.uint64)
for _k, _ch in enumerate(b"abcdefghijklmnopqrstuvwxyz0123456789"):
    _BITS[_ch] = np.uint64(1 << _k)
_BITS[[c for c in range(256) if not _BITS[c] and c != 32]] = np.uint64(1 << 36)
#: A count of four bits for each digit.
_COUNTS = np.zeros(256, np.uint64)
for _k in range(10):
    _COUNTS[48 + _k] = np.uint64(1 << (4 * _k))


def _folded(column: pa.Array, table: np.ndarray, how: np.ufunc) -> np.ndarray:
    """The table's entries of each text's bytes, joined by ``how``; 0 for an empty text."""
    n = len(column)
    out = np.zeros(n, np.uint64)
    offsets = np.frombuffer(column.buffers()[1], np.int32, n + 1, column.offset * 4)
    if n and offsets[-1] > offsets[0]:
        data = table[np.frombuffer(column.buffers()[2], np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0]))]
        full = np.flatnonzero(offsets[1:] > offsets[:-1])
        out[full] = how.reduceat(data, offsets[:-1][full] - offsets[0])
    return out


class Column:
    """One text field of a run of records."""

    def __init__(self, column: pa.Array, digits: bool = False):
        column = column.cast(pa.string())
        coded = column.dictionary_encode()
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = coded.dictionary
        lengths = pc.utf8_length(self.words).to_numpy(zero_copy_only=False).astype(np.int64)
        self.length = lengths[self.code] if len(lengths) else np.zeros(len(column), np.int64)
        marks = _folded(self.words, _BITS, np.bitwise_or)
        self.mask = marks[self.code] if len(lengths) else np.zeros(len(column), np.uint64)
        if digits:
            counts = _folded(self.words, _COUNTS, np.add)
            self.count = counts[self.code] if len(lengths) else np.zeros(len(column), np.uint64)

    def silent(self, i, j):
        return (self.length[i] == 0) | (self.length[j] == 0)


def _only(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many letters x has that y lacks."""
    return np.bitwise_count(x & ~y).astype(np.int64)


def _decide(out: np.ndarray, at: np.ndarray, x: Column, i: np.ndarray, y: Column, j: np.ndarray, compare: Callable[[str, str], int]) -> None:
    """out at the pairs ``at`` by comparing x[i] with y[j], each pair of values once."""
    if not len(at):
        return
    keys = x.code[i[at]] * (len(y.words) + 1) + y.code[j[at]]
    unique, back = np.unique(keys, return_inverse=True)
    left, right = x.words.take(pa.array(unique // (len(y.words) + 1))).to_pylist(), y.words.take(pa.array(unique % (len(y.words) + 1))).to_pylist()
    out[at] = np.array([compare(a, b) for a, b in zip(left, right)], np.int64)[back]


def _words(x: Column, i, y: Column, j, compare: Callable[[str, str], int], spared: int = 2) -> np.ndarray:
    """Levels of names: any likeness leaves one side at most two letters that the other lacks."""
    out = np.full(len(i), 5, np.int64)
    same = x.code[i] == y.code[j] if x is y else np.zeros(len(i), bool)
    silent = (x.length[i] == 0) | (y.length[j] == 0)
    near = np.minimum(_only(x.mask[i], y.mask[j]), _only(y.mask[j], x.mask[i])) <= spared
    _decide(out, np.flatnonzero(near & ~silent & ~same), x, i, y, j, compare)
    out[same] = 1
    out[silent] = 0
    return out


def _far(x: Column, i, j, most: int) -> np.ndarray:
    """More than ``most`` slips apart, for certain."""
    return (np.abs(x.length[i] - x.length[j]) > most) | (_only(x.mask[i], x.mask[j]) > most) | (_only(x.mask[j], x.mask[i]) > most)


def _digits_far(x: Column, i, j) -> np.ndarray:
    """More than a slip apart, for certain: one changes the digits' counts by two together at most (long numbers' counts may overflow; they aren't far)."""
    off = np.zeros(len(i), np.int64)
    for k in range(10):
        shift = np.uint64(4 * k)
        off += np.abs(((x.count[i] >> shift) & np.uint64(15)).astype(np.int64) - ((x.count[j] >> shift) & np.uint64(15)).astype(np.int64))
    return (off > 2) & (x.length[i] <= 15) & (x.length[j] <= 15)


def _born(code: np.ndarray, i, j) -> np.ndarray:
    """Levels of days yyyymmdd, bare years and 0 for none, as traits has them."""
    a, b = code[i], code[j]
    out = np.full(len(i), 6, np.int64)
    year = lambda x: np.where(x > 9999, x // 10000, x)
    bare_a, bare_b = a <= 9999, b <= 9999
    same_year = year(a) == year(b)
    whole = ~bare_a & ~bare_b
    digits = lambda x: np.stack([(x // 10**k) % 10 for k in range(7, -1, -1)])
    p, q = digits(a), digits(b)
    differ = p != q
    off = differ.sum(axis=0)
    swapped = np.zeros(len(i), bool)
    for k in range(7):
        swapped |= (off == 2) & differ[k] & differ[k + 1] & (p[k] == q[k + 1]) & (p[k + 1] == q[k])
    # Of one length a slip is another digit, two neighbours swapped, or, counted by traits as well, nothing else.
    out[whole & same_year] = 5
    out[whole & (off == 2)] = 4
    out[whole & ((off == 1) | swapped)] = 3
    month, day = (a // 100) % 100, a % 100
    out[whole & same_year & (month == b % 100) & (day == (b // 100) % 100)] = 2
    out[bare_a != bare_b] = np.where(same_year, 2, 6)[bare_a != bare_b]
    out[bare_a & bare_b] = 6
    same = a == b
    out[same] = np.where(bare_a, 2, 1)[same]
    out[(a == 0) | (b == 0)] = 0
    return out


class Records:
    """The traits of a run of records, ready for comparison."""

    def __init__(self, batch: pa.RecordBatch | pa.Table):
        col = lambda name: batch.column(batch.schema.get_field_index(name))
        one = lambda name: (c.combine_chunks() if isinstance(c := col(name), pa.ChunkedArray) else c)
        self.given, self.family, self.email, self.town, self.employer = (Column(one(n)) for n in ("given", "family", "email", "town", "employer"))
        self.phone, self.ident = Column(one("phone"), True), Column(one("ident"), True)
        self.born = pc.cast(pc.if_else(pc.equal(one("born"), ""), "0", one("born")), pa.int64()).to_numpy(zero_copy_only=False)
        self.local = Column(pc.replace_substring_regex(one("email"), "@.*$", ""))
        self.tail = Column(pc.utf8_slice_codeunits(pc.replace_substring_regex(one("email"), "@.*$", ""), -3, None))
        self.houses, self.codes = one("houses"), one("codes")
        self.spots, self.areas = (one(n).to_numpy(zero_copy_only=False).astype(np.uint64) for n in ("spots", "areas"))
        self.some_codes = pc.list_value_length(self.codes).to_numpy(zero_copy_only=False) > 0
        self.home, self.zone = Column(pc.binary_join(self.houses, ";")), Column(pc.binary_join(self.codes, ";"))
        lettered = pc.match_substring_regex(self.zone.words, r"(^|;)\d*[^\d;]").to_numpy(zero_copy_only=False)
        self.fine = lettered[self.zone.code] if len(lettered) else np.zeros(len(self.some_codes), bool)  # some code is finer than a town

    def _numbers(self, x: Column, i, j, far: int) -> np.ndarray:
        """Levels of telephone numbers."""
        out = np.full(len(i), far, np.int64)
        silent, same = x.silent(i, j), x.code[i] == x.code[j]
        near = ~silent & ~same & ~_far(x, i, j, 1) & ~_digits_far(x, i, j)
        _decide(out, np.flatnonzero(near), x, i, x, j, traits._phone)
        out[same] = 1
        out[silent] = 0
        return out

    def _ident(self, i, j, valid: Callable[[str], bool]) -> np.ndarray:
        x = self.ident
        good = np.array([valid(w) for w in x.words.to_pylist()], bool)
        good = good[x.code] if len(good) else np.zeros(len(x.code), bool)
        out = np.where(good[i] & good[j], 4, 3)
        silent, same = x.silent(i, j), x.code[i] == x.code[j]
        near = ~silent & ~same & ~_far(x, i, j, 1) & ~_digits_far(x, i, j)
        _decide(out, np.flatnonzero(near), x, i, x, j, lambda a, b: traits._ident(a, b, valid))
        out[same] = np.where(good[i], 1, 2)[same]
        out[silent] = 0
        return out

    def _place(self, i, j) -> np.ndarray:
        x = self.town
        silent, same = x.silent(i, j), x.code[i] == x.code[j]
        told = lambda k: (x.length[k] > 0) | self.some_codes[k]
        out = np.where(told(i) & told(j), 4, 0).astype(np.int64)
        codes_meet, spots_meet = (self.areas[i] & self.areas[j]) != 0, (self.spots[i] & self.spots[j]) != 0
        same &= ~silent
        zone = (self.zone.code[i] == self.zone.code[j]) & (self.zone.length[i] > 0)
        home = (self.home.code[i] == self.home.code[j]) & (self.home.length[i] > 0)
        near = np.zeros(len(i), np.int64)
        _decide(near, np.flatnonzero(~silent & ~same & ~zone & ~_far(x, i, j, 2)), x, i, x, j, lambda a, b: traits.word_slips(a, b, 2) <= 2)
        area = same | zone | (near > 0)
        out[area] = 3
        out[zone & self.fine[i]] = 2
        out[area & home] = 1
        # Left are houses of one number and kind but not all the same, and some codes in common but not all.
        open_ = np.flatnonzero((area & ~home & spots_meet) | (codes_meet & ~zone & ~(area & home)))
        if len(open_):
            p, q = i[open_], j[open_]
            used = np.unique(np.concatenate([p, q]))
            at = pa.array(used)
            told = zip(x.words.take(pa.array(x.code[used])).to_pylist(), map(tuple, self.houses.take(at).to_pylist()), map(tuple, self.codes.take(at).to_pylist()))
            numbers: dict[tuple, int] = {}
            number = np.zeros(len(x.code), np.int64)
            number[used] = [numbers.setdefault(t, len(numbers)) for t in told]
            sides = [dict(zip(("town", "houses", "codes"), t)) for t in numbers]
            unique, back = np.unique(number[p] * len(sides) + number[q], return_inverse=True)
            out[open_] = np.array([traits._place(sides[k // len(sides)], sides[k % len(sides)]) for k in unique.tolist()], np.int64)[back]
        return out

    def persons(self, i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
        given, family = _words(self.given, i, self.given, j, traits._word), _words(self.family, i, self.family, j, traits._word)
        # Given and family name may have changed places.
        g, f = self.given, self.family
        asked = (np.isin(given, (0, 5)) | np.isin(family, (0, 5))) & (g.length[i] > 0) & (f.length[j] > 0)
        asked &= (_only(g.mask[i], f.mask[j]) <= 1) & (_only(f.mask[j], g.mask[i]) <= 1)
        at = np.flatnonzero(asked)
        if len(at):
            first, second = np.full(len(i), 5, np.int64), np.zeros(len(i), np.int64)
            _decide(first, at, g, i, f, j, traits._word)
            at = at[np.isin(first[at], (1, 3))]
            _decide(second, at, f, i, g, j, traits._word)
            at = at[second[at] <= 3]
            given[at], family[at] = second[at], first[at]
        e = self.email
        email = np.where(self.tail.code[i] == self.tail.code[j], 3, 4)
        silent, same = e.silent(i, j), e.code[i] == e.code[j]
        _decide(email, np.flatnonzero(~silent & ~same & ~_far(e, i, j, 1)), e, i, e, j, traits._email)
        email[self.local.code[i] == self.local.code[j]] = 2
        email[same] = 1
        email[silent] = 0
        w = self.employer
        work = np.where(w.silent(i, j), 0, np.where(w.code[i] == w.code[j], 1, 2))
        return [given, family, _born(self.born, i, j), email, self._numbers(self.phone, i, j, 3), self._ident(i, j, traits.luhn), self._place(i, j), work]

    def firms(self, i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
        none = np.zeros(len(i), np.int64)
        name = _words(self.family, i, self.family, j, traits._firm_name, 64)
        e = self.email
        site = np.full(len(i), 4, np.int64)
        silent, same = e.silent(i, j), e.code[i] == e.code[j]
        _decide(site, np.flatnonzero(~silent & ~same & ~_far(e, i, j, 1)), e, i, e, j, traits._site)
        site[same] = 1
        site[silent] = 0
        return [none, name, none, site, self._numbers(self.phone, i, j, 3), self._ident(i, j, traits.mod97), self._place(i, j), none]


def packed(levels: list[np.ndarray]) -> np.ndarray:
    """Levels as one number, three bits each, the first field highest."""
    out = np.zeros(len(levels[0]), np.int32)
    for level in levels:
        out = (out << 3) | level.astype(np.int32)
    return out


def unpacked(code: int, n: int = len(traits.PERSON_FIELDS)) -> tuple[int, ...]:
    return tuple((code >> (3 * (n - 1 - k))) & 7 for k in range(n))


def bloom(values: list[str]) -> int:
    """A bit for each value, by its checksum; sets without a bit in common have no value in common."""
    import zlib

    out = 0
    for v in values:
        out |= 1 << (zlib.crc32(v.encode()) % 63)
    return out
