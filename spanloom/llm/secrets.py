"""Secret scans: fixed formats by pattern, and values in credential contexts by what it would cost to guess them.

The guess cost of a value is that of its cheapest segmentation into dictionary words, dates, repeats, keyboard walks and
brute-force spans, found by dynamic programming over its positions. A value next to a credential word counts as a secret
where that cost is high.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import slices

#: Fixed formats: kind, pattern, group whose length counts, least length. Letters are ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # maximal runs, so the same as the runs of any length that reach 32
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
#: Looser contexts, judged by guess cost alone. `base` are the words of ASSIGN, for values that it misses or covers in part.
CONTEXT = re.compile(
    r"""(?:(?P<base>password|passwd|secret(?:[_-]?(?:access[_-]?)?key)?|token|api[_-]?key)|"""
    r"""passphrase|passcode|pass|pwd|pin|credentials?|auth(?:orization)?|access_?key(?:_?id)?|private_?key|client_?key|signing_?key|encryption_?key|auth_?key|session_?id|bearer)"""
    r"""["']?(?:\x20*(?P<sign>[:=])\x20*|\x20+(?:is\x20+)?)["']?(?:(?:basic|bearer|digest|negotiate|token|apikey)\x20+)?(?P<value>[^\s"'<>,;]{6,})""",
    re.I | re.A,
)
_HINTS = ("pass", "pwd", "pin", "cred", "auth", "key", "session", "bearer", "secret", "token")
#: No context word with its sign and quotes is longer.
_LONGEST_CONTEXT = 32
#: Words, also joined or in brackets, as running text has them: whatever holds no digit.
_PROSE = re.compile(r"\D+")
#: What follows a value without being a part of it: the next parameter of a query string, a closing mark.
_NEXT = re.compile(r"&[a-z_][\w.-]*=|[`*]+$", re.I | re.A)
#: log2 of the guesses from which a value in a looser context is a secret; words after a blank are one from the second on, as
#: those of running text cost less.
LEAST_BITS, LEAST_PROSE_BITS = 36.0, 80.0
KINDS = ("assign", "access", "hex", "guess")

#: Frequent words of passwords, most frequent first.
WORDS = (
    "password pass love admin welcome monkey dragon master hello letmein login princess sunshine football baseball shadow "
    "michael superman batman trustno secret summer winter spring autumn flower hunter ranger killer soccer hockey george "
    "charlie andrew thomas jordan robert daniel joshua matthew jessica ashley michelle nicole the and for you with that this "
    "have from not are was her his they will what your all can user test guest root changeme default example sample token "
    "key value name none null true false public private data server service system access account email mail phone address "
    "home house world money happy lucky angel heart sweet cookie cheese pepper ginger orange purple yellow silver golden "
    "black white green blue red tiger eagle lion wolf bear horse snake cat dog computer internet windows samsung google "
    "apple coffee chicken banana freedom forever whatever nothing something iloveyou qwerty start stop open close"
).split()
#: Rows of a keyboard and the key pad.
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "789", "456", "123")
_LEET = str.maketrans("4@8301!57$", "aabeoiists")
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)\d\d")
#: A place after this many others without a cheap one is past all words and dates that began before them.
_PAST = 10


def _neighbours() -> dict[str, set[str]]:
    near: dict[str, set[str]] = {}
    for r, row in enumerate(ROWS):
        for i, c in enumerate(row):
            for a in (row[i - 1 : i] if i else "", row[i + 1 : i + 2]):
                if a:
                    near.setdefault(c, set()).add(a)
            if r < 3:  # keys of the row below stand half a key to the right
                for j in (i - 1, i):
                    if 0 <= j < len(ROWS[r + 1]):
                        near.setdefault(c, set()).add(ROWS[r + 1][j])
                        near.setdefault(ROWS[r + 1][j], set()).add(c)
    return near


_NEAR = _neighbours()


def _alphabet(c: str) -> float:
    """log2 of the size of the class that a guesser would try the character from."""
    if c.isdigit():
        return math.log2(10)
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return math.log2(26)
    return math.log2(33) if c.isascii() else math.log2(256)


def _length(n: int) -> float:
    """What it costs to say how long a segment of any length is in a value of n characters."""
    return 2.0 * math.log2(1.0 + math.log2(n)) if n else 0.0


class Guesser:
    """Guess costs with a ranked dictionary: WORDS, then `words`. The dictionary is fixed, so that what is a secret in one document
    does not depend on others, among which may be copies of it."""

    def __init__(self, words: Iterable[str] = ()):
        self.rank: dict[str, int] = {}
        for w in (*WORDS, *words):
            self.rank.setdefault(w, len(self.rank) + 1)
        self.past = max(_PAST, *map(len, self.rank))
        self.ends: tuple[dict[str, set[int]], dict[str, set[int]]] = {}, {}  # lengths of words, and of words read backwards, by their last three letters
        for w in self.rank:
            for ends, form in zip(self.ends, (w, w[::-1]), strict=True):
                ends.setdefault(form[-3:], set()).add(len(w))
        self.bits = lru_cache(maxsize=4096)(self._bits)

    def _words(self, value: str, low: str, plain: str, end: int) -> Iterator[tuple[int, float]]:
        """Length and cost of each reading as a word of what ends here."""
        for ends, text, extra, step in ((self.ends[0], low, 0.0, 1), (self.ends[0], plain, 2.0, 1), (self.ends[1], low, 1.0, -1)):
            for size in ends.get(text[end - 3 : end], ()) if end >= 3 else ():
                if size <= end and (rank := self.rank.get(text[end - size : end][::step])) is not None:
                    own = value[end - size : end]
                    case = 0.0 if own == own.lower() else 1.0 if own in (own.upper(), own.capitalize()) else float(size) / 2
                    yield size, math.log2(rank + 1) + extra + case

    def _bits(self, value: str, limit: float = math.inf) -> float:
        """log2 of the guesses for the cheapest segmentation of the value; 0 for an empty one. With a limit the answer may be any
        number on the same side of it.

        Segments: brute-force characters; a word; a date; a run of one character or a walk over neighbouring keys of any length;
        and a repeat, which goes on as the text did after the latest earlier place with the same three characters, for as long as
        it does or shorter. Each is tried from the cheapest of its possible starts, so the time is in proportion to the length
        (repeats: to n log n), whatever the value repeats."""
        n, low = len(value), value.lower()
        if len(low) != n:  # a letter whose lower case is longer
            low = "".join(c if len(x := c.lower()) != 1 else x for c in value)
        plain = low.translate(_LEET)
        length = _length(n)
        best, brute = [0.0] + [math.inf] * n, [0.0] + [math.inf] * n
        turns = [0] * (n + 1)  # changes of direction on the keyboard so far
        run = walk = 1
        from_run = from_walk = math.inf
        repeats: list[tuple[float, int]] = []  # cost at the start, and how far it goes, cheapest first
        seen: dict[str, int] = {}
        agree: dict[int, int] = {}  # for a distance, up to where the text agrees with itself
        dates: dict[int, list[tuple[int, float]]] = {}
        last_cheap = 0
        for end in range(1, n + 1):
            c, prev = low[end - 1], low[end - 2] if end > 1 else ""
            if c.isdigit() and (m := _DATE.match(value, end - 1, min(n, end + 9))):
                dates.setdefault(m.end(), []).append((end - 1, math.log2(365.25 * 80 * 4) if m.end() - end + 1 > 4 else math.log2(120)))
            # A new brute-force span pays for its place among the segments, a longer one only for its character.
            cheapest = brute[end] = min(brute[end - 1], best[end - 1] + 1.0) + _alphabet(value[end - 1])
            run = run + 1 if c == prev else 1
            from_run = min(from_run, best[end - 3]) if run >= 3 else math.inf
            cheapest = min(cheapest, from_run + 1.0 + _alphabet(c) + length)
            walk = walk + 1 if prev and c in _NEAR.get(prev, ()) else 1
            turns[end] = turns[end - 1] + (walk > 2 and ord(c) - ord(prev) != ord(prev) - ord(low[end - 3]))
            from_walk = min(from_walk, best[end - 4] - 2.0 * turns[end - 2]) if walk >= 4 else math.inf
            cheapest = min(cheapest, from_walk + 1.0 + math.log2(len(_NEAR)) + length + 2.0 * (turns[end] + 1))
            if end >= 3:
                start, three = end - 3, low[end - 3 : end]
                if (before := seen.get(three)) is not None:
                    away = start - before
                    if agree.get(away, 0) < end:
                        agree[away] = _agreement(low, end, away)
                    cost = best[start] + 1.0 + math.log2(away) + length
                    if agree[away] == n and cost < limit < math.inf:
                        return cost
                    if not repeats or cost < repeats[0][0] or agree[away] > repeats[0][1]:
                        heappush(repeats, (cost, agree[away]))
                seen[three] = start
                while repeats and repeats[0][1] < end:
                    heappop(repeats)
                if repeats:
                    cheapest = min(cheapest, repeats[0][0])
            for size, cost in self._words(value, low, plain, end):
                cheapest = min(cheapest, best[end - size] + 1.0 + cost)
            for start, cost in dates.get(end, ()):
                cheapest = min(cheapest, best[start] + 1.0 + cost)
            best[end] = cheapest
            if cheapest < limit:
                last_cheap = end
            elif end - last_cheap > self.past and min(from_run, from_walk + 2.0 * turns[end]) >= limit and not (repeats and repeats[0][0] < limit):
                return cheapest  # no segment that may still end began where it was cheap
        return best[n]


def _agreement(text: str, at: int, away: int) -> int:
    """Up to where the text from `at` on equals itself `away` before."""
    n, step = len(text), 16
    growing = True
    while step:
        size = min(step, n - at)
        if size and text[at : at + size] == text[at - away : at - away + size]:
            at += size
            step = 2 * step if growing else step // 2
        else:
            growing = False
            step //= 2
    return at


_PLAIN = Guesser()
guess_bits = _PLAIN.bits


def _least(m: re.Match[str], value: str) -> float:
    prose = not m["sign"] and (_PROSE.fullmatch(value) if m["base"] else value.isalpha())
    return LEAST_PROSE_BITS if prose and all(w in (w.lower(), w.upper(), w.capitalize()) for w in re.findall(r"[^\W\d_]+", value)) else LEAST_BITS


def find(text: str | None, guesser: Guesser = _PLAIN) -> list[tuple[int, int, str]]:
    """The spans as (start, end, kind) in code points, by start, then by kind as in KINDS."""
    if not text:
        return []
    low = text.lower()
    found: list[tuple[int, int, str]] = []
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if any(h in low for h in _HINTS):
        taken = [(a, b) for a, b, _ in found]
        m = CONTEXT.search(text)
        while m:
            a, whole = m.span("value")
            value = m["value"].rstrip(".)]}!?:")
            b = a + len(value)
            held = max([a, *(y for x, y in taken if x <= a < y)])  # a fixed format covers the value up to here
            if held >= b or held > a and _NEXT.match(text, held, b):
                at = max(held, a + 1)
            elif len(value) >= 6 and guesser.bits(value, least := _least(m, value)) >= least:
                found.append((a, b, "guess"))
                at = b
            else:  # no part of a cheap value is dear, but its end may be a context of what follows
                at = max(a, whole - _LONGEST_CONTEXT)
            m = CONTEXT.search(text, at)
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redact(text: str | None, spans: list[tuple[int, int, str]] | None = None, mark: str = "[secret]") -> str | None:
    """The text with each maximal union of overlapping spans replaced by the mark. spans: as find() gives them, where they are known."""
    if not text:
        return text
    spans = find(text) if spans is None else spans
    out, at, last = [], 0, -1
    for a, b, _ in spans:
        if a >= last:
            out += [text[at:a], mark]
        at = last = max(last, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None, words: list[str] | None = None, redacted: bool = True) -> DataFrame:
    """The columns `keep` with n_assign, n_access, n_hex, base_sha256, spans and, if asked for, redacted (the text without its secrets).

    words: a ranked dictionary beside WORDS, of bounded size; one that comes from the documents themselves would hide secrets that
    stand in several of them. A null text counts as empty for the
    counts and spans and stays null in `redacted`. Each row stands alone, so repeated rows, ties and empty tables need no rule;
    columns other than `keep` and the text are not read.
    """
    keep = docs.columns if keep is None else keep
    rows = docs.select(F.col(text).alias("_text"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"))
    shared = docs.sparkSession.sparkContext.broadcast(words or [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guesser = Guesser(shared.value)
        for whole in batches:
            for batch in slices(whole, 0):
                texts = batch.column(0).to_pylist()
                spans = [find(t, guesser) for t in texts]
                base = [[s for s in x if s[2] != "guess"] for x in spans]
                count = lambda kind: pa.array([sum(s[2] == kind for s in x) for x in base], pa.int64())  # noqa: B023, E731
                digest = [hashlib.sha256(joined(x).encode()).hexdigest() for x in base]
                clean = [redact(t, x) if x else t for t, x in zip(texts, spans, strict=True)] if redacted else [None] * len(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1), count("assign"), count("access"), count("hex"), pa.array(digest, pa.string()), pa.array(map(joined, spans), pa.string()), pa.array(clean, pa.string())],
                    names=["_row", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"],
                )

    schema = f"_row {rows.schema['_row'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string"
    found = rows.mapInArrow(run, schema)
    return found.select("_row.*", "n_assign", "n_access", "n_hex", "base_sha256", "spans", *["redacted"] * redacted)
