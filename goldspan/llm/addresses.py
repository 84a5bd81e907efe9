"""Rows of addresses that denote one location, however they are written.

An address is read into the parts of its location: house number with letter,
flat, kind and name of the street, place and postcode; addressees and names of
houses are no part of it. An address becomes a vector of weighted grams: one gram
for its house number, kind of street and area together, which has half of the
vector's mass, and the character n-grams of its street for the other half.
Candidates come from an inverted index over the prefix of each vector, its
rarest grams up to where the rest is too light to reach the threshold, and the
cosine decides. Equal readings are one entry of the index; their rows are paired
only when the result is expanded.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldspan.functions.standard import FILLERS, fold_text
from goldspan.runtime import Workspace, spread

# Words of addresses and what they stand for.
STREET_KINDS = {
    "street": "street", "str": "street", "st": "street", "strasse": "street",
    "road": "road", "rd": "road", "lane": "lane", "ln": "lane",
    "avenue": "avenue", "ave": "avenue", "avn": "avenue", "av": "avenue",
    "close": "close", "cl": "close", "court": "court", "ct": "court", "crt": "court",
    "crescent": "crescent", "cres": "crescent", "cresc": "crescent", "cr": "crescent",
    "square": "square", "sq": "square", "terrace": "terrace", "ter": "terrace", "terr": "terrace",
    "place": "place", "pl": "place", "platz": "place", "weg": "way", "way": "way", "gasse": "alley",
    "allee": "drive", "drive": "drive", "rue": "rue", "r": "rue", "boulevard": "boulevard", "bd": "boulevard",
    "boul": "boulevard", "blvd": "boulevard", "chemin": "chemin", "ch": "chemin", "che": "chemin",
    "impasse": "impasse", "imp": "impasse",
}
#: Endings of compound street names, and the abbreviations that are such only before a full stop.
ENDINGS = {"strasse": "street", "str": "street", "gasse": "alley", "platz": "place", "pl": "place", "allee": "drive", "weg": "way"}
STOPPED_ENDINGS = {"w": "way", "g": "alley", "a": "drive", "al": "drive", "gas": "alley", "p": "place"}
SMALL_WORDS = {"de", "des", "du", "la", "le", "les", "l", "d", "the"}
UNIT = re.compile(r"\b(?:flat|apartment|apt|appartement|appt|app|unit|wohnung|whg|suite|fl)\b[.:]?\s*(?:no\b\.?|nr\b\.?|#)?\s*(\d+\s*[a-z]?|[a-z])\b")
NUMBER = re.compile(r"(?:#|\bno\b\.?|\bnr\b\.?|n°)?\s*\b(\d{1,5})(?:\s*-?\s*([a-f])(?![a-z0-9]))?\b")
POSTCODE = re.compile(r"\b([a-z]{2}\d{1,2})[\s-]?(\d[a-z]{2})\b|\b(\d{5})\b")
#: What two addresses must reach in cosine similarity. Without the gram of house and area it can't be reached, with it the streets' own cosine must be 0.6.
THRESHOLD = 0.8
#: What the names of two places must reach: towns share their endings.
PLACES = 0.75
#: Weights of n-grams by length: a slip of the pen spares most single letters, but changes several longer grams.
LENGTHS = {1: 1.2, 2: 1.0, 3: 0.7}
#: Power of a gram's rarity in its weight: low, as slips make rare grams.
RARITY = 0.15
#: Entries of one house and area that are compared with each other as they are; beyond, the grams of the street are indexed as well. The result is the same.
PLAIN = 100


#: Words and towns come again and again.
_fold = lru_cache(200_000)(fold_text)


def _plain(text: str | None) -> str:
    """Folded text with the commas, brackets, full stops, # and hyphens that addresses are structured by."""
    if text is None:
        return ""
    marked = re.sub(r"[,;()|/\n]", "\x01", text)
    parts = []
    for part in marked.split("\x01"):
        words = []
        for w in part.split():
            stop = "." if w.endswith(".") else ""
            mark = "#" if w.startswith("#") else ""
            words.append(mark + (_fold(w) or "") + stop)
        parts.append(" ".join(x for x in words if x not in ("", ".", "#")))
    return ",".join(p for p in parts if p)


def filler(text: str | None) -> bool:
    low = (text or "").strip().lower()
    return not any(ch.isalnum() for ch in low) or low in FILLERS or set(low) == {"x"}


def _near(a: str, b: str) -> bool:
    """One slip apart: a letter more, less, other, or two neighbours swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def _kind(words: list[str]) -> tuple[str, list[str]]:
    """Kind of a street and the words of its name."""
    bare = [w.rstrip(".") for w in words]
    for at in (len(bare) - 1, 0):  # last in one custom, first in the other
        if len(bare) > 1 and bare[at] in STREET_KINDS:
            return STREET_KINDS[bare[at]], bare[:at] + bare[at + 1 :]
    if bare:
        last, stopped = bare[-1], words[-1].endswith(".")
        for ending, kind in sorted(ENDINGS.items(), key=lambda e: -len(e[0])):
            if last.endswith(ending) and len(last) > len(ending) + 2:
                return kind, [*bare[:-1], last[: -len(ending)]]
        if stopped:
            for ending, kind in sorted(STOPPED_ENDINGS.items(), key=lambda e: -len(e[0])):
                if last.endswith(ending) and len(last) > len(ending) + 2:
                    return kind, [*bare[:-1], last[: -len(ending)]]
    for at in (len(bare) - 1, 0):
        if len(bare) > 1 and len(bare[at]) > 3:
            for word, kind in STREET_KINDS.items():
                if len(word) > 3 and _near(bare[at], word):
                    return kind, bare[:at] + bare[at + 1 :]
    if bare:
        last = bare[-1]
        for ending in ("strasse", "gasse", "platz", "allee"):
            for width in (len(ending) - 1, len(ending), len(ending) + 1):
                if len(last) > width + 2 and _near(last[-width:], ending):
                    return ENDINGS[ending], [*bare[:-1], last[:-width]]
    return "", bare


def read(line1: str | None, city: str | None, postcode: str | None) -> tuple[str, str, str, str, str]:
    """house (number, letter and flat), kind, street, place, postcode; empty text for what isn't told."""
    text = _plain(line1)
    code = "" if filler(postcode) else re.sub(r"[^A-Z0-9]", "", postcode.upper())
    if code and not re.fullmatch(r"[A-Z]{2}\d{1,2}\d[A-Z]{2}|\d{5}", code):
        code = ""
    written = None
    for written in POSTCODE.finditer(text):
        pass
    if written and written.start() > 0 and (written[1] or len(re.findall(r"\d+", text)) > 1):
        code = code or "".join(g for g in written.groups() if g).upper()
        text = text[: written.start()] + "," + text[written.end() :]
    unit = ""
    if m := UNIT.search(text):
        unit = m[1].replace(" ", "")
        text = text[: m.start()] + "," + text[m.end() :]
    parts = [p.strip(" -") for p in text.split(",")]
    parts = [p for p in parts if p and p != "."]
    number = letter = ""
    street: list[str] = []
    place = ""
    at = next((k for k, p in enumerate(parts) if re.search(r"\d", p)), None)
    if at is None:
        at = max(range(len(parts)), key=lambda k: (_kind(parts[k].split())[0] != "", -k), default=None)
    else:
        m = NUMBER.search(parts[at])
        if m:
            number, letter = m[1].lstrip("0") or "0", m[2] or ""
            rest = (parts[at][: m.start()] + " " + parts[at][m.end() :]).strip(" -")
            if not re.search(r"[a-z]{2}", rest) and at + 1 < len(parts):  # the number stands apart from its street
                if re.fullmatch(r"[a-f]", rest.strip()) and not letter:
                    letter, rest = rest.strip(), ""
                at += 1
                rest = parts[at]
            elif not re.search(r"[a-z]{2}", rest) and at:
                at -= 1
                rest = parts[at]
            parts[at] = rest
    if at is not None:
        words = [w for w in parts[at].split() if w.rstrip(".") not in ("no", "nr", "")]
        if words and words[-1] == "la":  # an article is never the last word
            words[-1] = "lane"
        street = [w for w in words if w.rstrip(".") not in SMALL_WORDS] or words
        if at + 1 < len(parts):
            place = re.sub(r"\.$", "", parts[at + 1])
    kind, name = _kind(street)
    town = "" if filler(city) else (_fold(city) or "")
    joined = "".join(name)
    return f"{number}{letter}/{unit}", kind, joined, (town or place).replace(" ", ""), code


READ = "address_id bigint, house string, kind string, street string, place string, postcode string, area string"


def readings(addresses: DataFrame) -> DataFrame:
    """The parts of every address; area is the postcode without its last, street-wise part."""
    rows = spread(addresses.select(F.col("address_id").cast("bigint").alias("address_id"), "line1", "city", "postcode"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, *parts = batch.columns
            told = [read(*x) for x in zip(*(p.to_pylist() for p in parts))]
            told = [(*t, t[4] if t[4].isdigit() else t[4][:-3]) for t in told]
            columns = [pa.array([t[k] for t in told], pa.string()) for k in range(6)]
            yield pa.RecordBatch.from_arrays([ids, *columns], ["address_id", "house", "kind", "street", "place", "postcode", "area"])

    return rows.mapInArrow(parse, READ)


def _letter(ch: str) -> str:
    """Letters and digits as they are, anything else as one of 64 classes, so that grams are bounded in number."""
    return ch if ch.isascii() else chr(0xE000 + ord(ch) % 64)


def grams(word: str) -> Counter[str]:
    """Marked n-grams of one to three characters with their numbers; at most 102 + 102 ** 2 + 102 ** 3 different ones exist."""
    plain = "".join(map(_letter, word))
    out: Counter[str] = Counter(plain)
    for n in (2, 3):
        text = "^" * (n - 1) + plain + "$" * (n - 1)
        out.update(text[i : i + n] for i in range(len(text) - n + 1))
    return out


def slips(a: str, b: str, most: int = 2) -> int:
    """Optimal string alignment distance, most + 1 where it is beyond ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[0] == b[0]:  # equal ends take part in no slip
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return len(a) + len(b)
    far = most + 1
    two: list[int] = []
    one = [k if k <= most else far for k in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [far] * (len(b) + 1)
        row[0] = i if i <= most else far
        for j in range(max(1, i - most), min(len(b), i + most) + 1):  # further from the diagonal lie more slips than count
            y = b[j - 1]
            best = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y), far)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row[j] = best
        if min(row) > most:
            return far
        two, one = one, row
    return one[-1]


class Weights:
    """Weights of grams by length and rarity, and the vectors of words."""

    def __init__(self, counts: dict[str, int], total: int):
        self.of = {g: LENGTHS[len(g)] * math.log(1 + total / n) ** RARITY for g, n in counts.items()}
        self.counts, self.unseen = counts, math.log(1 + total) ** RARITY
        self.known: dict[str, dict[str, float]] = {}

    def vector(self, word: str) -> dict[str, float]:
        """The word's n-grams with weights of length 1 together; words met lately are remembered."""
        got = self.known.get(word)
        if got is None:
            raw = {g: n * self.of.get(g, LENGTHS[len(g)] * self.unseen) for g, n in grams(word).items()}
            norm = math.sqrt(sum(w * w for w in raw.values())) or 1.0
            got = {g: w / norm for g, w in raw.items()}
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[word] = got
        return got

    def cosine(self, a: str, b: str) -> float:
        if a == b:
            return 1.0
        v = self.vector(b)
        return sum(w * v.get(g, 0.0) for g, w in self.vector(a).items())

    def prefix(self, word: str, threshold: float) -> list[str]:
        """The rarest grams, as many as leave less than the threshold to the rest: any two words over it share one of them."""
        order = sorted(self.vector(word).items(), key=lambda gw: (self.counts.get(gw[0], 0), gw[0]))
        rest, out = 1.0, []
        for g, w in order:
            out.append(g)
            rest -= w * w
            if rest < threshold * threshold - 1e-9:
                break
        return out


def _counted(words: DataFrame) -> DataFrame:
    """gram and n over the rows of one column of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                seen.update(set(grams(word)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["gram", "n"])

    return words.mapInArrow(count, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def _kept(met: DataFrame, weights: Broadcast, threshold: float, ids: str) -> DataFrame:
    """x and y of the rows of met (x, y, wx, wy) whose words reach the threshold."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Weights(*weights.value)
        for batch in batches:
            keep = pa.array([own.cosine(a, b) >= threshold for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())], pa.bool_())
            kept = batch.filter(keep)
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["x", "y"])

    return met.select("x", "y", "wx", "wy").mapInArrow(verify, f"x {ids}, y {ids}")


def _indexed(entries: DataFrame, weights: Broadcast, threshold: float) -> DataFrame:
    """entries (with a column word) once for each gram of the word's prefix."""
    at = entries.columns.index("word")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Weights(*weights.value)
        for batch in batches:
            lists = pa.array([own.prefix(w, threshold) for w in batch.column(at).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "prefix"])

    schema = ", ".join(f"`{n}` {t}" for n, t in entries.dtypes) + ", prefix array<string>"
    return entries.mapInArrow(index, schema).withColumn("gram", F.explode("prefix")).drop("prefix")


def _candidates(left: DataFrame, right: DataFrame | None, weights: Broadcast, threshold: float) -> DataFrame:
    """x, y, wx, wy of entries (anchor, id, word, bare) that share the anchor; of one side, each pair once, of two, each left with each right.

    An anchor is half of each vector, so it alone is the prefix: the rest, the
    street, can't reach the threshold. Where many entries share one, as many
    nameless houses may, the pair must share a gram of the prefix of its streets too.
    """
    both = left if right is None else left.unionByName(right)
    large = both.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PLAIN).select("anchor")

    def met(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
        x = a.select(*on, F.col("id").alias("x"), F.col("word").alias("wx"), F.col("bare").alias("bx"))
        y = b.select(*on, F.col("id").alias("y"), F.col("word").alias("wy"), F.col("bare").alias("by"))
        once = F.col("x") < F.col("y") if right is None else (F.col("x") < F.col("y")) | (~F.col("by") & (F.col("x") != F.col("y")))
        return x.join(y, on).where(once).select("x", "y", "wx", "wy")

    few = lambda df: df.join(large, "anchor", "left_anti")
    many = lambda df: _indexed(df.join(large, "anchor", "left_semi"), weights, threshold)
    other = left if right is None else right
    dense = met(many(left), many(other), ["anchor", "gram"]).dropDuplicates(["x", "y"])
    return met(few(left), few(other), ["anchor"]).unionAll(dense)


def expand(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of both entries of each pair of entries; large entries are cut on both sides into slices of about a thousand rows."""
    sizes = members.groupBy("form").agg(F.ceil(F.count(F.lit(1)) / 1000).cast("int").alias("slices"))

    def side(form: str, row: str, cut: str) -> tuple[DataFrame, DataFrame]:
        rows = members.join(sizes.where("slices > 1"), "form", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
        rows = rows.select(F.col("form").alias(form), F.col("address_id").alias(row), F.pmod(F.xxhash64("address_id"), F.col("slices")).cast("int").alias(cut))
        return sizes.select(F.col("form").alias(form), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias(cut)), rows

    (cuts_a, rows_a), (cuts_b, rows_b) = side("fa", "a", "ca"), side("fb", "b", "cb")
    sliced = pairs.join(cuts_a, "fa").join(cuts_b, "fb")
    out = sliced.join(rows_a, ["fa", "ca"]).join(rows_b, ["fb", "cb"])
    return out.where((F.col("fa") != F.col("fb")) | (F.col("a") < F.col("b"))).select("fa", "fb", "a", "b")


def same_location(addresses: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """address_a, address_b (address_a smaller) of every pair of rows that denote one location.

    House number, letter and flat must be equal, a flat that only one of them
    tells being a difference; the names of streets of one kind must be alike.
    Where both tell a postcode, it must be equal; where one doesn't, the places
    must be alike, a postcode standing for the place most rows with it name.
    Rows without a street, or with neither place nor postcode, denote no location
    and match nothing, as do rows without an address_id. Rows of equal text are
    pairs; of rows with one address_id the smallest reading counts.
    """
    spark = addresses.sparkSession
    space = Workspace(spark, "addresses")
    street_share = 2 * threshold - 1  # what the streets' own cosine must be where the anchor is shared
    told = space.save(readings(addresses).where("address_id is not null and street <> ''"), "read")
    named = told.where("area <> '' and place <> ''").groupBy("area", "place").count()
    majority = space.save(named.groupBy("area").agg(F.max_by("place", F.struct("count", "place")).alias("usual")), "usual")
    placed = told.where("area <> ''").join(majority, "area", "left").withColumn("place", F.coalesce("usual", "place")).drop("usual")
    placed = placed.unionByName(told.where("area = ''")).where("place <> '' or postcode <> ''")
    parts = ["house", "kind", "street", "place", "postcode"]
    one = placed.groupBy("address_id").agg(F.min(F.struct(*parts)).alias("r")).select("address_id", "r.*")
    # An entry's number is the digest of its parts: equal readings need no join to find theirs.
    members = space.save(one.withColumn("form", F.unhex(F.md5(F.to_json(F.struct(*parts))))), "members")
    forms = space.save(members.groupBy("form").agg(*(F.first(c).alias(c) for c in parts), F.count(F.lit(1)).alias("n")), "forms")
    members = members.select("form", "address_id")

    words = forms.select(F.col("street").alias("w")).unionAll(forms.select("place").where("place <> ''"))
    counts = {r.gram: r.n for r in _counted(words).collect()}  # bounded: see grams
    weights = spark.sparkContext.broadcast((counts, 2 * forms.count()))

    anchor = lambda area: F.concat_ws("|", "house", "kind", area)
    entry = lambda df, area: df.select(anchor(area).alias("anchor"), F.col("form").alias("id"), F.col("street").alias("word"), (F.col("postcode") == "").alias("bare"))
    coded = _candidates(entry(forms.where("postcode <> ''"), "postcode"), None, weights, street_share)

    # Rows without a postcode meet all rows of places spelt like theirs. Places are far fewer than rows.
    bare = forms.where("postcode = ''")
    spelt = space.save(forms.where("place <> ''").groupBy("place").agg(F.max(F.col("postcode") == "").alias("bare")).select(F.col("place").alias("word"), "bare"), "places")
    x = _indexed(spelt.where("bare").select("word"), weights, PLACES).select("gram", F.col("word").alias("x"))
    y = _indexed(spelt.select("word"), weights, PLACES).select("gram", F.col("word").alias("y"))
    near = x.join(y, "gram").where("abs(length(x) - length(y)) <= 3").select("x", "y", F.col("x").alias("wx"), F.col("y").alias("wy")).distinct()
    near = space.save(_kept(near, weights, PLACES, "string"), "near")
    asking = bare.join(near.select(F.col("x").alias("place"), F.col("y").alias("spelt")), "place")
    placewise = _candidates(entry(asking, "spelt"), entry(forms.where("place <> ''"), "place"), weights, street_share)

    alike = _kept(coded.unionAll(placewise), weights, street_share, "binary").select(F.col("x").alias("fa"), F.col("y").alias("fb"))
    own = forms.where("n > 1").select(F.col("form").alias("fa"), F.col("form").alias("fb"))
    alike = space.save(alike.unionAll(own), "alike")
    pairs = expand(members, alike)
    return pairs.select(F.least("a", "b").alias("address_a"), F.greatest("a", "b").alias("address_b"))
