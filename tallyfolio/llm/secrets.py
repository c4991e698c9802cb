"""Secrets in text: fixed formats, and guess costs for what stands in a credential context.

Three formats are always reported (assignments to a credential name, access key ids, long hex
runs). Further values that follow a credential word are reported when they are hard to guess:
a dynamic programme finds the cheapest way to write the value as words, dates, repeats of a unit
of any length, keyboard walks, sequences, places (an address, path or dotted name of plain
names) and single characters, in bits; ``MIN_BITS`` decides. A value of plain words
("token: available"), or the address of a page, stays cheap, a random one does not. No piece has a
greatest length; the programme stops early once no way to go on can be cheap enough.

Defined results: a null text has no spans (and stays null when masked); offsets are code
points, ends exclusive; an added span that overlaps a fixed-format one is left out; repeated
rows are treated alike; very long texts and values are judged whole, in time that grows with
their length; an empty table gives an empty table; other columns pass through untouched.
"""
from __future__ import annotations

import functools
import json
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyfolio.llm.common import documents, merged_spans

# The formats and their least lengths.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex")

CONTEXT = re.compile(
    r"""((?ai:pass(?:word|wd|phrase|code)|pwd|secret|token|credentials?|authorization|bearer"""
    r"""|(?:api|access|private|secret|signing)[_\x20-]?key|client[_\x20-]?secret))["']?"""
    r"""(?:(\x20*(?:=>|:=|[:=])\x20*)|\x20+(?ai:is|was)\x20+|\x20+)(?:(?ai:bearer|basic)\x20+)?"""
    r"""(["'`]?)([^\s"'`<>,;]{6,})""")
_HINTS = ("passw", "passp", "passc", "pwd", "secret", "token", "credential", "authorization", "bearer", "key")
MIN_BITS = 36.0

# Keys in rows from the top left, and frequent passwords by rank.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
COMMON = ("password", "qwerty", "letmein", "welcome", "admin", "dragon", "monkey", "login", "princess",
          "sunshine", "master", "shadow", "football", "baseball", "superman", "batman", "trustno",
          "iloveyou", "changeme", "default", "secret", "guest", "root", "test", "user", "example",
          "placeholder", "redacted", "hidden", "none", "null", "undefined", "required", "optional")
LEET = {"4": "a", "@": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t"}
_PIECE = 2.0        # bits to say what kind of piece comes next
_REPEAT = 2.0       # bits to say that a unit comes again
# An address, a path or a dotted name whose parts are plain names or small numbers.
_NAME = r"(?:[a-z]+|[A-Z][a-z]+|[A-Z]+|[0-9]{1,4})(?![A-Za-z0-9])"
_PLACE = re.compile(rf"(?:(?:[A-Za-z][A-Za-z+.-]*://|\.{{0,2}}/|~/|[A-Za-z]:\\){_NAME}(?:[/.\\:?&=#_-]{_NAME})*/?"
                    rf"|[A-Za-z]+(?:\.[A-Za-z]+)+(?![A-Za-z0-9]))")
_SEPARATORS = re.compile(r"[^A-Za-z0-9]+")
_PLACE_BITS = 12.0
_DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"
                   r"|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    value: int      # where the secret itself begins
    base: bool
    bits: float | None = None


@functools.cache
def ranked_words(path: str) -> dict[str, int]:
    """Whole lower-case words of a public vocabulary by rank; common passwords come first."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    words = [w.removesuffix("</w>") for w, _ in sorted(vocab.items(), key=lambda x: x[1]) if w.endswith("</w>")]
    found: dict[str, int] = {}
    for w in (*COMMON, *words):
        if len(w) >= 3 and w.isascii() and w.isalpha():
            found.setdefault(w, len(found) + 1)
    return found


@functools.cache
def _neighbours() -> frozenset[tuple[str, str]]:
    at = {c: (x + y * 0.5, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
    return frozenset((a, b) for a, (x, y) in at.items() for b, (u, v) in at.items()
                     if a != b and abs(y - v) <= 1 and abs(x - u) <= (1 if y == v else 0.5))


def _char_bits(c: str) -> float:
    if c.isdigit():
        return math.log2(10)
    if "a" <= c.lower() <= "z":
        return math.log2(26) + (0.5 if c.isupper() else 0.0)
    return math.log2(33) if c.isascii() else math.log2(100)


def _word_bits(part: str, plain: str, rank: int) -> float:
    bits = math.log2(rank + 1)
    upper = sum(c.isupper() for c in part)
    if upper:
        first_or_all = part[0].isupper() and upper == 1 or upper == sum(c.isalpha() for c in part)
        bits += 1 if first_or_all else math.log2(math.comb(len(part), upper) + 1)
    return bits + sum(a != b for a, b in zip(part.lower(), plain))


def guess_bits(value: str, words: dict[str, int], enough: float = math.inf) -> float:
    """Bits of the cheapest segmentation of a whole value.

    Work ends, with some number from ``enough`` on, where every way to write the rest costs as much.
    """
    n, low = len(value), value.lower()
    if len(low) != n:
        low = value
    plain = "".join(LEET.get(c, c) for c in low)
    longest = longest_word(words)
    near = _neighbours()
    best = [0.0] + [math.inf] * n

    def reach(i: int, j: int, bits: float) -> None:
        if best[i] + bits < best[j]:
            best[j] = best[i] + bits

    place = _PLACE.match(value)
    if place:
        reach(0, place.end(), _PIECE + _PLACE_BITS + len(_SEPARATORS.findall(place[0])) / 2)
    # Ends of the runs that start at each place: same step between letters, adjacent keys.
    steps = [ord(b) - ord(a) for a, b in zip(low, low[1:])]
    walks = [(a, b) in near for a, b in zip(low, low[1:])]
    along = [ROWS_AT.get(c, 0) for c in low]
    seq_from = walk_from = turns = 0
    unit = run_from = 0                         # a run of period ``unit`` from ``run_from`` on
    ends: dict[str, list[int]] = {}             # where each three characters have ended
    cheap = place.end() if place else 0         # the last place a cheap way is known to reach
    for j in range(1, n + 1):
        c = value[j - 1]
        # Characters of one class in a row pay for the class once.
        open_ = j == 1 or c.isdigit() != value[j - 2].isdigit() or c.isalpha() != value[j - 2].isalpha()
        reach(j - 1, j, _char_bits(c) + (_PIECE / 2 if open_ else 0.0))
        for i in range(max(0, j - longest), j - 2):
            if best[i] >= enough:
                continue
            for part in {low[i:j], plain[i:j]}:
                rank = words.get(part)
                if rank:
                    reach(i, j, _PIECE + _word_bits(value[i:j], part, rank))
        if j >= 2 and not walks[j - 2]:
            walk_from, turns = j - 1, 0
        if j >= 3:
            if steps[j - 2] != steps[j - 3] or abs(steps[j - 2]) > 1:
                seq_from = j - 2
            if j - seq_from >= 3 and abs(steps[j - 2]) <= 1:
                reach(seq_from, j, _PIECE + math.log2(52) + math.log2(j - seq_from))
            if j - walk_from >= 3:
                turns += along[j - 1] - along[j - 2] != along[j - 2] - along[j - 3]
                reach(walk_from, j, _PIECE + math.log2(47) + math.log2(j - walk_from) + math.log2(4.6) * (1 + turns))
        for width in (4, 6, 8, 10):
            if j >= width and value[j - 1].isdigit() and value[j - width].isdigit() and _DATE.fullmatch(value, j - width, j):
                reach(j - width, j, _PIECE + (math.log2(120) if width == 4 else math.log2(365 * 120) + 1))
        # A unit that stands here again, and again: what it cost once, and how often.
        if unit and value[j - 1] != value[j - 1 - unit]:
            unit = 0
        for u in _units(value, j, ends, unit, run_from):
            times = (j - run_from) // u if u == unit else _times(value, j, u)
            if times > 1:
                for m in range(1, times) if times <= 16 else (1, times - 1):
                    reach(j - m * u, j, _REPEAT + math.log2(m))
                if not unit:
                    unit, run_from = u, j - times * u
        if j >= 3:
            ends.setdefault(value[j - 3:j], []).append(j)
        if best[j] < enough:
            cheap = max(cheap, j)
        # Words and dates that end later begin in the window, repeats of a cheap unit end before twice its end.
        elif (j - cheap > max(longest, 10, cheap) and min(best[seq_from], best[walk_from]) >= enough
              and (not unit or best[run_from + unit] >= enough)):
            return best[j]
    return best[n]


def _times(value: str, j: int, u: int) -> int:
    """How often the ``u`` characters before ``j`` stand there in a row."""
    unit, times = value[j - u:j], 1
    while j >= (times + 1) * u and value.startswith(unit, j - (times + 1) * u):
        times += 1
    return times


def _units(value: str, j: int, ends: dict[str, list[int]], unit: int, run_from: int) -> Iterator[int]:
    """Lengths of units that may stand twice before ``j``: where its last three characters have ended before.

    Inside a long run only its own unit is tried, so that long runs take no longer than others.
    """
    inside = unit and j - run_from >= max(32, 4 * unit)
    if unit:
        yield unit
    if not inside:
        yield from (u for u in (1, 2) if u != unit and j >= 2 * u)
    if j >= 6:
        places = ends.get(value[j - 3:j], [])
        for i in range(bisect_right(places, run_from + unit + 2) if inside else len(places), 0, -1):
            u = j - places[i - 1]
            if 2 * u > j:
                break
            if u >= 3 and u != unit:
                yield u


def longest_word(words: dict[str, int]) -> int:
    """Length of the longest word, worked out once per dictionary."""
    known = _LENGTHS.get(id(words))
    if known is None or known[0] is not words:
        known = _LENGTHS[id(words)] = words, max(map(len, words), default=0)
    return known[1]


_LENGTHS: dict[int, tuple[dict, int]] = {}


# Position of each key along its row, rows far apart: steps in a row are 1, changes of row are not.
ROWS_AT = {c: 100 * y + x for y, row in enumerate(ROWS) for x, c in enumerate(row)}


def find_spans(text: str | None, words: dict[str, int], min_bits: float = MIN_BITS) -> list[Span]:
    """All spans of one whole text, by start and then kind."""
    if not text:
        return []
    found: list[Span] = []
    low = text.lower()
    hinted = any(h in low for h in _HINTS)
    if hinted:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                found.append(Span("assign", m.start(), m.end(), m.start(2), True))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= ACCESS_LEAST:
                found.append(Span("access", m.start(), m.end(), m.start(), True))
    for m in HEX.finditer(text):
        found.append(Span("hex", m.start(), m.end(), m.start(), True))
    if hinted:
        starts, ends = merged_spans((s.start, s.end) for s in found)
        m = CONTEXT.search(text)
        while m:
            # What a keyword rejects may hold another keyword: the search goes on behind the first.
            at, bits = m.end(1), None
            start, end = m.span(4)
            while end > start and text[end - 1] in ".!?)]}":
                end -= 1
            value = text[start:end]
            first = bisect_right(ends, m.start())
            inner = None if m[2] else CONTEXT.match(text, start)
            if first < len(starts) and starts[first] < end:
                over = bisect_right(starts, at) - 1
                at = max(at, ends[over]) if over >= first else at
            elif inner and inner[2]:
                at = start
            # A bare word of letters is prose in some language, unless it is assigned.
            elif m[2] or not (value.isalpha() and (value.islower() or value[1:].islower())):
                bits = guess_bits(value, words, min_bits)
            if bits is not None and bits >= min_bits:
                found.append(Span("assign", m.start(), end, start, False, bits))
                at = end
            m = CONTEXT.search(text, at)
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def masked(text: str | None, spans: list[Span], mark: str = "[SECRET]") -> str | None:
    """The text with every secret value replaced; overlapping values become one mark."""
    if not spans:
        return text
    out, at = [], 0
    for start, end in sorted((s.value, s.end) for s in spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def words_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _written(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def secret_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None,
                 min_bits: float = MIN_BITS) -> DataFrame:
    """(id, spans): per document an array of (kind, start, end, value, base, bits)."""
    path = path or words_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ranked_words(path)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                   ("value", pa.int64()), ("base", pa.bool_()), ("bits", pa.float64())]))
        for batch in batches:
            rows = [[s._asdict() for s in find_spans(t.as_py(), words, min_bits)] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, kind)], ["id", "spans"])

    typed = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return typed.mapInArrow(run, f"id {typed.schema['id'].dataType.simpleString()}, spans array<struct<"
                            "kind:string,start:bigint,end:bigint,value:bigint,base:boolean,bits:double>>")


def mask_secrets(docs: DataFrame, text: str = "text", path: str | None = None,
                 min_bits: float = MIN_BITS) -> DataFrame:
    """``docs`` with the secret values of ``text`` masked; other columns pass through."""
    path, at = path or words_path(), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ranked_words(path)
        for batch in batches:
            texts = (t.as_py() for t in batch.column(at))
            clean = pa.array([masked(t, find_spans(t, words, min_bits)) for t in texts], batch.schema.field(at).type)
            columns = list(batch.columns)
            columns[at] = clean
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["base"])

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias("n_" + kind)

    return found.select(
        F.col("id").alias("doc_id"), *[count(k) for k in KINDS], F.sha2(told(base), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("bigint").alias("n_added"))


QUERIES = {"op4_secrets": op4_secrets}
