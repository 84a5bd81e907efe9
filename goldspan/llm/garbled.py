"""Text whose characters were damaged by reading bytes in a wrong encoding.

A pair model gives every text a cost: how surprising its neighbouring characters
are, counted over the whole corpus. From a suspicious word a best-first search
goes over three kinds of operation, unescaping, encoding back in a code page,
and decoding in another, never visiting a text or a string of bytes twice, and
ends at the cheapest text it can reach. Its paths may be of any length. Bytes
that form UTF-8 vouch for themselves and are followed wherever they lead; any
two other pages give some text, so of those steps the ones that cheapen the text
are followed. A document is damaged where such a text is far cheaper than what
stands there, or where a replacement character shows that bytes were lost.
"""

from __future__ import annotations

import heapq
import html
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldspan.runtime import spread

#: The code pages that texts are commonly written or misread in.
MISREAD_AS = ("cp1252", "latin-1", "cp850", "cp437", "mac-roman", "cp1250", "iso8859-2", "cp852", "cp1251", "koi8-r", "cp866", "cp1253", "iso8859-7", "cp1254", "iso8859-15", "cp932")
WRITTEN_IN = ("utf-8", "cp1252", "cp1250", "iso8859-2", "cp852", "cp1251", "koi8-r", "cp866", "iso8859-5", "cp1253", "iso8859-7", "cp850", "cp437", "mac-roman", "cp932", "euc_jp")
LOST = "�"
#: A word with a character beyond ASCII, or with a character reference.
WORD = re.compile(r"[^ \t\r\n\f\v]*(?:[^\x00-\x7f]|&#?\w{1,31};)[^ \t\r\n\f\v]*")
ENTITY = re.compile(r"&#?\w{1,31};")
BLANKS = re.compile(r"[ \t\r\n\f\v]+")
C1 = re.compile("[\x80-\x84\x86-\x9f]")
#: Characters beyond this code share one class per script, so the model has fewer than 1,500 squared pairs whatever the corpus.
NAMED = 0x530
#: A run of characters longer than this has its operations proposed by all its windows of this length, and is then restored whole by them.
WINDOW = 120
#: Nats that a step of each kind must gain by itself to be believed: UTF-8 hardly forms by chance, other pages need more evidence.
CERTAIN, ALONE = 3.0, 12.0


def suspicious(text: str) -> list[str]:
    """What WORD finds in a text, by splitting it first, which is faster than searching."""
    return [w for w in BLANKS.split(text) if not w.isascii() or ("&" in w and ENTITY.search(w))]


def _class(ch: str) -> str:
    if ord(ch) < NAMED or ch == LOST or 0x2000 <= ord(ch) < 0x2600:
        return ch
    o = ord(ch)
    if 0x3040 <= o < 0x3100:
        return "あ"
    if 0x3000 <= o < 0x3040:
        return "、"
    if 0x4E00 <= o < 0xA000:
        return "一"
    if 0xFF61 <= o < 0xFFA0:
        return "ｱ"
    if 0xE000 <= o < 0xF900:
        return ""
    if o >= 0x1F000:
        return "\U0001f600"
    return {"L": "ა", "M": "ཱ", "N": "①", "P": "〈", "S": "☀", "Z": "　"}.get(unicodedata.category(ch)[0], "")


def _classes(text: str) -> str:
    return "".join(c if c < "\x80" else _class(c) for c in text)


def _pairs(word: str) -> list[str]:
    """Neighbouring characters of which one at least is beyond ASCII, and each character that shares its class.

    A blank stands for the word's ends; digits are alike. Single characters are
    at most as many as Unicode has.
    """
    text = " " + re.sub("[0-9]", "0", _classes(word)) + " "
    out = [text[i : i + 2] for i in range(len(text) - 1) if text[i] > "\x7f" or text[i + 1] > "\x7f"]
    return out + [ch for ch in word if ch > "\u052f" and _class(ch) != ch]


def pair_counts(documents: DataFrame) -> DataFrame:
    """pair and n over all texts of all documents, counted in part before the shuffle."""
    rows = spread(documents.select("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()
        seen: Counter[str] = Counter()

        def flush() -> None:
            for w, n in words.items():
                for p in _pairs(w):
                    seen[p] += n
            words.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text and not text.isascii():
                    words.update(suspicious(text))
            if len(words) > 100_000:
                flush()
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pair", "n"])

    return rows.mapInArrow(count, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


class Plausibility:
    """Cost of a word: the surprise of its pairs beyond ASCII, and of characters within their class, in nats."""

    def __init__(self, counts: dict[str, int]):
        self.total = sum(n for p, n in counts.items() if len(p) == 2) + 1
        self.cost = {p: math.log(self.total / (n + 0.5)) for p, n in counts.items() if len(p) == 2}
        self.unseen = math.log(self.total / 0.5) + 1
        per_class: Counter[str] = Counter()
        for ch, n in counts.items():
            if len(ch) == 1:
                per_class[_class(ch)] += n
        self.within = {ch: math.log((per_class[_class(ch)] + 1) / (n + 0.5)) for ch, n in counts.items() if len(ch) == 1}

        # The least that a pair can cost after a change of single-byte pages, by its unchanging ASCII side.
        small = lambda c: c < "\x80" or ord(c) < NAMED or 0x2000 <= ord(c) < 0x2600
        self.least: dict[str, float] = {}
        for pair, cost in self.cost.items():
            if small(pair[0]) and small(pair[1]):
                key = (pair[0] if pair[0] < "\x80" else "\x80") + (pair[1] if pair[1] < "\x80" else "\x80")
                self.least[key] = min(cost, self.least.get(key, cost))

    def floor(self, word: str) -> float:
        """No change of single-byte pages makes the word cheaper than this."""
        text = " " + re.sub("[0-9]", "0", re.sub("[^\x00-\x7f]", "\x80", word)) + " "
        keys = [text[i : i + 2] for i in range(len(text) - 1)]
        return sum(self.least_of(k) for k in keys if "\x80" in k)

    def least_of(self, key: str) -> float:
        known = self.least.get(key)
        if key != key.lower():  # capitals may be counted as small letters
            low = self.least.get(key.lower(), self.unseen) + 1
            known = low if known is None else min(known, low)
        return self.unseen if known is None else known

    def _pair(self, pair: str) -> float:
        cost = self.cost.get(pair, self.unseen)
        if pair == pair.upper():  # capitals are as plausible as the small letters, nearly
            cost = min(cost, self.cost.get(pair.lower(), self.unseen) + 1)
        return cost

    def __call__(self, word: str) -> float:
        cost = sum(self._pair(p) if len(p) == 2 else self.within.get(p, self.unseen) for p in _pairs(word))
        # Controls are never written; a replacement character is worse than any pair.
        return cost + 6.0 * len(C1.findall(word)) + 20.0 * word.count(LOST)


def _encode(text: str, page: str) -> bytes | None:
    try:
        return text.encode(page)
    except UnicodeEncodeError:
        if page not in ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254"):
            return None
    out = bytearray()
    for ch in text:  # a reader that meets a byte without a meaning in its page often keeps it as a control
        try:
            out += ch.encode(page)
        except UnicodeEncodeError:
            if not 0x80 <= ord(ch) < 0xA0:
                return None
            out.append(ord(ch))
    return bytes(out)


def _unescape(text: str) -> str:
    """Character references replaced; html.unescape alone would turn 128 to 159 into cp1252 letters."""
    return html.unescape(re.sub(r"&#(\d{1,7});", lambda m: chr(int(m[1])) if int(m[1]) < 0x110000 else m[0], text))


def _vouched(name: str) -> bool:
    return name == "unescape" or name.endswith(">utf-8")


def _price(name: str) -> float:
    """Nats that an operation costs: UTF-8 vouches for itself, any other pair of pages always gives some text."""
    return 1.0 if _vouched(name) else 4.0


def _decode(raw: bytes, page: str, loose: bool) -> str | None:
    """The text, or nothing where bytes have no meaning; loose forgives a sequence cut at either end."""
    try:
        return raw.decode(page)
    except UnicodeDecodeError:
        pass
    if loose:
        for i, j in ((i, j) for i in range(4) for j in range(4)):
            try:
                return raw[i : len(raw) - j].decode(page)
            except UnicodeDecodeError:
                pass
    return None


#: Pages in which several bytes are one character.
WIDE = ("utf-8", "cp932", "euc_jp")


def _steps(text: str, known: set[bytes], narrow: bool = True, loose: bool = False) -> Iterator[tuple[str, str]]:
    """The texts one operation away, with the operation's name; bytes met before lead nowhere new. Without ``narrow``, no changes of single-byte pages."""
    if ENTITY.search(text):
        yield _unescape(text), "unescape"
    if text.isascii():
        return
    for page in MISREAD_AS:
        raw = _encode(text, page)
        if raw is None or raw in known:
            continue
        known.add(raw)
        for written in WRITTEN_IN if narrow else WIDE:
            if written != page:
                further = _decode(raw, written, loose and written in WIDE)
                if further is not None:
                    yield further, f"{page}>{written}"


#: A text on the way and what it costs with all that was paid to reach it.
Stage = tuple[str, str, float]


def cheapest(word: str, cost: Plausibility, loose: bool = False) -> tuple[float, tuple[Stage, ...]]:
    """What the word costs, and the operations, texts and costs on the way to the cheapest text that can be reached from it."""
    start = max(cost(word), cost(_unescape(word)) if ENTITY.search(word) else 0.0)
    best: tuple[float, tuple[Stage, ...]] = (start, ())
    queue: list[tuple[float, int, str, tuple[Stage, ...], float]] = [(start, 0, word, (), 0.0)]
    seen, known = {word}, set()
    while queue:
        now, _, text, path, paid = heapq.heappop(queue)
        if now < best[0]:
            best = (now, path)
        for further, name in _steps(text, known, narrow=paid + 4.0 + cost.floor(text) < now, loose=loose):
            if further in seen:
                continue
            seen.add(further)
            spent = paid + _price(name)
            if spent >= best[0]:  # nothing behind it can be cheaper than what is known
                continue
            reached = cost(further) + spent
            if reached < now or _vouched(name):
                heapq.heappush(queue, (reached, len(seen), further, (*path, (name, further, reached)), spent))
    return start, best[1]


def follow(text: str, names: tuple[str, ...], cost: Plausibility) -> tuple[float, tuple[Stage, ...]] | None:
    """As ``cheapest``, by given operations; nothing where one can't be done."""
    start, paid, out = cost(text), 0.0, []
    for name in names:
        if name == "unescape":
            text = _unescape(text)
        else:
            page, _, written = name.partition(">")
            raw = _encode(text, page)
            text = None if raw is None else _decode(raw, written, False)
        if text is None:
            return None
        paid += _price(name)
        out.append((name, text, cost(text) + paid))
    return start, tuple(out)


class Restorer:
    """Judges and restores whole texts, remembering words."""

    def __init__(self, counts: dict[str, int], kept: int = 200_000):
        self.cost, self.kept, self.words = Plausibility(counts), kept, {}

    def _long(self, run: str) -> tuple[float, tuple[Stage, ...]]:
        """A long run: every window proposes its operations, which are then done on the whole run; the cheapest result counts."""
        offers = {tuple(name for name, _, _ in cheapest(run[i : i + WINDOW], self.cost, loose=True)[1]) for i in range(0, len(run), WINDOW)}
        done = [f for names in sorted(offers) if (f := follow(run, names, self.cost)) is not None]
        return min(done, key=lambda f: f[1][-1][2] if f[1] else f[0], default=(self.cost(run), ()))

    def parts(self, word: str) -> list[str]:
        """A long word falls into its runs of ASCII and of other characters: no sequence of UTF-8 reaches over their borders."""
        return [word] if len(word) <= 2 * WINDOW else re.findall("[\x00-\x7f]+|[^\x00-\x7f]+", word)

    def word(self, word: str) -> tuple[float, tuple[Stage, ...]]:
        known = self.words.get(word)
        if known is None:
            known = self._long(word) if len(word) > 2 * WINDOW else cheapest(word, self.cost)
            if len(self.words) >= self.kept:
                self.words.clear()
            self.words[word] = known
        return known

    def judge(self, text: str | None) -> tuple[bool, bool, str | None, str, float]:
        """Damaged, restorable throughout, the restored text, the commonest operation and the gain.

        Each step on a word's path counts with what it gains over the text before it.
        """
        if not text or (text.isascii() and "&" not in text):
            return False, True, text, "", 0.0
        gains: dict[str, float] = defaultdict(float)
        wide: dict[str, set[str]] = defaultdict(set)
        strong = False
        found: dict[str, list[tuple[str, str, float]]] = {}
        words = {part for w in set(suspicious(text)) for part in self.parts(w) if not part.isascii() or ENTITY.search(part)}
        for word in sorted(words):
            before, path = self.word(word)
            if not any(">" in name for name, _, _ in path):
                continue
            steps, hidden = [], 0.0
            for name, further, reached in path:
                gain = before - reached + hidden
                hidden = min(gain, 0.0) if _vouched(name) else 0.0  # a layer that seems to cost is paid by the next one
                steps.append((name, further, gain))
                before = reached
                if ">" not in name:
                    continue
                strong = strong or gain >= (CERTAIN if _vouched(name) else ALONE)
                gains[name] += gain
                wide[name].add(word)
            found[word] = steps
        lost = LOST in text or "ï¿½" in text
        # A text is mostly damaged by one change of pages: of those that its words suggest, the one that gains most over all its words holds for them all.
        for name in sorted({steps[0][0] for steps in found.values() if not _vouched(steps[0][0])}):
            done = {w: f for w in words if (f := follow(w, (name,), self.cost)) is not None and f[1][0][2] < f[0] + _price(name)}
            gains[name], wide[name] = sum(f[0] - f[1][0][2] for f in done.values()), set(done)
        best = max(sorted(gains), key=gains.get, default="")
        if best and not _vouched(best):
            for w in wide[best]:
                steps = found.get(w, [])
                if not steps or (not _vouched(steps[0][0]) and steps[0][0] != best):
                    alone = follow(w, (best,), self.cost)
                    if alone is None:  # the word's own path comes to this change behind another one, without which it can't be done
                        continue
                    start, ((name, further, reached),) = alone
                    if not steps or sum(gain for _, _, gain in steps) < start - reached + ALONE:
                        found[w] = [(name, further, start - reached)]
        many = bool(best) and gains[best] >= ALONE and len(wide[best]) >= 2
        damaged = lost or strong or many or bool(C1.search(text))
        if not damaged:
            return False, True, text, "", 0.0
        swap = {}
        for word, steps in found.items():
            kept, open_ = word, word
            for k, (name, further, gain) in enumerate(steps):
                if not (_vouched(name) or gain >= ALONE / 2 or (name == best and k == 0)):
                    break  # a guess behind a sure step doesn't ride along
                open_ = further
                if gain >= (CERTAIN if _vouched(name) else 0.0) or name == best:
                    kept = open_
            if kept != word:
                swap[word] = kept
        put = lambda m: "".join(swap.get(part, part) for part in self.parts(m[0]))
        restored = WORD.sub(put, text)
        whole = LOST not in restored and not C1.search(restored)
        return True, whole, restored, best, max(gains.values(), default=0.0)


JUDGED = "doc_id bigint, damaged boolean, restorable boolean, restored string, operation string, gain double"


def judged(documents: DataFrame) -> DataFrame:
    """doc_id, damaged, restorable, restored, operation and gain of every document.

    ``restored`` is the text as it was written where that can be told, else with
    what could be restored; an undamaged text comes back as it is. Null, empty
    and ASCII texts are undamaged. Texts are judged whole; repeated rows give
    repeated rows; further columns are ignored.
    """
    counts = {r.pair: r.n for r in pair_counts(documents).collect()}  # bounded: see NAMED
    rows = spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    shared = documents.sparkSession.sparkContext.broadcast(counts)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for batch in batches:
            out = [restorer.judge(t) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), *(pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.float64())))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "damaged", "restorable", "restored", "operation", "gain"])

    return rows.mapInArrow(judge, JUDGED)
