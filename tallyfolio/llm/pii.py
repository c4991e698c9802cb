"""Personal data: fixed formats, and candidates judged by boosted trees.

Four formats are always reported (email, ip, card, phone). Besides, generators propose every span
that might be one of them in another dress (obfuscated addresses, IPv6, other separators,
numbers without a country code), overlapping as they come. Gradient-boosted trees over format
and context features score each candidate; scores are calibrated on held-out candidates, and a
threshold per kind, chosen there for precision, selects what is added. Of overlapping candidates
the surest stays, and none displaces a fixed-format span.

The trees learn from the corpus itself. Values that pass a format's own test (checksum, octets,
number of digits) are positive examples, also rewritten in other dresses; proposed values that
fail, and values with altered digits, are negative. Proposed values that no test can tell are no
examples. Addresses of version 6 and their near misses (times, hardware addresses) are made up.
The trees' sample is drawn per kind: ``TRAIN_DOCS`` documents that hold something of the kind, with
the smallest hashes, and ``TRAIN_EXAMPLES`` of their examples. Thresholds are not sampled: the
examples of all other documents are scored and counted in a histogram per kind.

Defined results: a null text has no spans and stays null when redacted; offsets are code points,
ends exclusive; without examples of both classes nothing is added; repeated rows are alike; very long
texts are searched whole, in time that grows with their length; an empty table gives an empty table.
"""
from __future__ import annotations

import ipaddress
import random
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyfolio.llm.common import documents, merged_spans, written

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS = 1000
TRAIN_EXAMPLES = 4000
PRECISION = 0.99
# Steps of a probability in the histograms that thresholds are read from.
STEPS = 1000
SLIP = 0.02

# The four formats. Local parts of addresses are found leftwards from the @.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

# Generators of candidates: wide nets, each with the kind it may hold.
_AT, _DOT = r"(?:@|\s?[\[({<]\s?at\s?[\])}>]\s?|\s+at\s+)", r"(?:\.|\s?[\[({<]\s?dot\s?[\])}>]\s?|\s+dot\s+)"
GENERATORS = (
    ("email", re.compile(rf"(?i)(?<![\w.%+-])[\w.%+-]{{1,64}}{_AT}[\w-]{{1,63}}(?:{_DOT}[\w-]{{2,63}}){{1,4}}")),
    ("ip", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:])")),
    ("ip", re.compile(r"(?<![\w.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\s\.\s|,|-|_)[0-9]{1,3}){3}(?![\w])")),
    ("card", re.compile(r"(?<![\w+])(?<![0-9][\x20./_-])[1-9](?:[\x20./_-]{0,2}[0-9]){14,18}(?![\w])(?![\x20./_-][0-9])")),
    ("phone", re.compile(r"(?<![\w+])(?:00[0-9]{1,3}[\x20./-]?)?\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20./-]?[0-9]{3,4}(?![\w])")),
)
_CONTEXT = {
    "email": re.compile(r"(?i)e-?mail|contact|write|@|reach"),
    "ip": re.compile(r"(?i)\bip\b|ipv[46]|host|server|addr|from|login"),
    "card": re.compile(r"(?i)card|visa|master|credit|debit|\bcc\b|pay"),
    "phone": re.compile(r"(?i)phone|tel\b|tel[.:]|call|fax|mobile|cell|\bsms\b|dial"),
}
_NEAR = 32
# Endings of addresses that prose words rarely are.
ENDINGS = frozenset("com org net edu gov mil int info biz io dev app ai co us uk de fr es it nl be ch at pl se no dk fi pt ru ua cz gr "
                    "ie eu ca mx br ar cl au nz jp cn kr in za tr il".split())
# Documents that hold something of a kind, for the sample.
SIGNS = {"email": r"@|\b(?i:at)\b", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]|:[0-9A-Fa-f]{0,4}:", "card": r"(?:[0-9][ ./_-]{0,2}){15}",
         "phone": r"\+[0-9]|[0-9]{2,4}\)?[ ./-]{1,2}[0-9]{3}"}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    base: bool
    score: float | None = None


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[Span]:
    """Spans of the four formats, by kind and then start."""
    found = [Span("email", a, b, True) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(Span("ip", *m.span(), True))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(Span("card", *m.span(), True))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append(Span("phone", *m.span(), True))
    return found


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Proposed spans of all generators, overlapping as they come."""
    found = []
    low = "@" in text or " at " in text or "at]" in text or "at)" in text or "AT" in text or "at}" in text or "at>" in text
    digits = _DIGIT.search(text) is not None
    for kind, net in GENERATORS:
        if low if kind == "email" else digits:
            found += [(kind, *m.span()) for m in net.finditer(text)]
    return found


def _runs(value: str) -> list[int]:
    return [len(r) for r in re.findall(r"[0-9]+", value)]


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of one candidate as numbers."""
    value = text[start:end]
    digits = _NOT_DIGIT.sub("", value)
    runs = _runs(value) or [0]
    before, after = text[max(0, start - _NEAR):start], text[end:end + _NEAR]
    octets = re.findall(r"[0-9]+", value)
    groups = re.findall(r"[0-9A-Fa-f]+", value)
    words = re.findall(r"[^\W\d_]+", value)
    tail = words[-1].lower() if words else ""
    left, right = before[-1:], after[:1]
    return [
        *[float(kind == k) for k in KINDS],
        float(len(value)), float(len(digits)), float(len(runs)), float(max(runs)), float(min(runs)),
        float(sum(c.isalpha() for c in value)), float(len(set(digits))),
        # A format's own test says nothing of other kinds, where it passes by chance.
        float(kind in ("card", "phone") and bool(digits) and luhn(digits)),
        float(kind == "ip" and len(octets) == 4 and all(len(o) <= 3 and int(o) <= 255 for o in octets)),
        float(value.count(":")), float(kind == "ip" and (len(groups) == 8 or "::" in value)),
        float("@" in value), float(bool(re.search(r"(?i)[\[({<]\s?(?:at|dot)", value))),
        float(bool(re.search(r"(?i)\sat\s", value))), float(len(tail)), float(len(words)), float(tail in ENDINGS),
        float(bool(re.search(r"(?i)[\[({<]\s?at", value))), float(bool(re.search(r"(?i)\sdot\s", value))), float(value.isascii()),
        float(value.startswith("(") or ")" in value), float(value.startswith("00")),
        float(len(set(re.sub(r"[0-9A-Za-z]", "", value)))), float("/" in value), float("." in value),
        float(left.isalnum()), float(right.isalnum()), float(left in ("#", "$", "-", "/")), float(right in ("%", "-", "/")),
        *[float(bool(_CONTEXT[k].search(before))) for k in KINDS],
        float(len(_NOT_DIGIT.sub("", before + after))),
    ]


# ------------------------------------------------------------------ boosted trees

class Trees(NamedTuple):
    """Boosted trees of depth three as arrays; leaves hold log-odds."""
    first: float
    feature: np.ndarray     # [tree, 7] feature of each inner node
    cut: np.ndarray         # [tree, 7] larger values go right
    leaf: np.ndarray        # [tree, 8]

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.first)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(3):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - 7]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.2, ridge: float = 1.0) -> Trees:
    """Gradient boosting for the logistic loss, with second-order gains and few cut values."""
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    first = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 17)[:-1])) for c in x.T]
    sides = [[(f, c, x[:, f] > c) for c in values[: len(values)]] for f, values in enumerate(cuts)]
    tests = [t for side in sides for t in side if 0 < t[2].sum() < len(x)]
    margin = np.full(len(x), first)
    feature, cut, leaf = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feats, cutv = np.zeros(7, np.int64), np.full(7, np.inf)
        node = np.zeros(len(x), np.int64)
        for depth in range(3):
            width = 2 ** depth
            here = node - (width - 1)
            total_g, total_h = (np.bincount(here, v, width) for v in (g, h))
            best = np.zeros(width)
            for f, c, right in tests:
                rg, rh = (np.bincount(here[right], v[right], width) for v in (g, h))
                lg, lh = total_g - rg, total_h - rh
                gain = rg ** 2 / (rh + ridge) + lg ** 2 / (lh + ridge) - total_g ** 2 / (total_h + ridge)
                for k in np.flatnonzero(gain > best + 1e-9):
                    best[k], feats[width - 1 + k], cutv[width - 1 + k] = gain[k], f, c
            node = 2 * node + 1 + (x[np.arange(len(x)), feats[node]] > cutv[node])
        at = node - 7
        values = -rate * np.bincount(at, g, 8) / (np.bincount(at, h, 8) + ridge)
        margin += values[at]
        feature.append(feats)
        cut.append(cutv)
        leaf.append(values)
    return Trees(first, np.array(feature), np.array(cut), np.array(leaf))


class Model(NamedTuple):
    trees: Trees | None
    slope: float
    shift: float
    thresholds: dict[str, float]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.trees.margins(x) + self.shift)))


def calibrate(margin: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and shift of a logistic curve from margins to probabilities (smoothed targets)."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        d, w = p - target, p * (1 - p) + 1e-9
        grad = np.array([(d * margin).sum(), d.sum()])
        hess = np.array([[(w * margin * margin).sum(), (w * margin).sum()], [(w * margin).sum(), w.sum()]])
        step = np.linalg.solve(hess + 1e-3 * np.eye(2), grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def threshold(p: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> float:
    """``counted_threshold`` of single examples."""
    step = step_of(np.asarray(p, np.float64))
    return counted_threshold(*(np.bincount(step[np.asarray(y) == k], minlength=STEPS) for k in (1, 0)), precision)


def counted_threshold(right: np.ndarray, wrong: np.ndarray, precision: float = PRECISION) -> float:
    """Lowest probability from which on the precision holds; 2 (never) if there is none.

    ``right`` and ``wrong`` count examples per step of probability. It lies up to ``SLIP`` below the last
    good step, but never beyond half way to the next one with examples, nor below one half.
    """
    above, all_ = np.cumsum(right[::-1])[::-1], np.cumsum((right + wrong)[::-1])[::-1]
    used = np.flatnonzero(right + wrong)
    good = [i for i in used if above[i] >= precision * all_[i]]
    if not good:
        return 2.0
    below = used[used < good[0]]
    half_way = (good[0] + (below[-1] + 1 if len(below) else 0)) / 2
    return max(0.5, half_way / len(right), good[0] / len(right) - SLIP)


def step_of(p: np.ndarray) -> np.ndarray:
    return np.minimum((p * STEPS).astype(np.int64), STEPS - 1)


def _dressed(kind: str, value: str, chance: random.Random) -> str | None:
    """A valid value of a kind written in another way."""
    digits = _NOT_DIGIT.sub("", value)
    if kind == "email":
        a, d = chance.choice(((" [at] ", " [dot] "), ("[at]", "."), (" (at) ", " (dot) "), (" at ", " dot "), ("@", ".")))
        local, _, host = value.partition("@")
        if a == "@":
            # A letter the fixed format does not know, right before the sign.
            return f"{local[:-1]}{chance.choice('áéíóúäöüßñçø')}@{host}"
        return local.replace(".", d if chance.random() < 0.5 else ".") + a + host.replace(".", d)
    if kind == "ip":
        return value.replace(".", chance.choice(("[.]", "(.)")))
    if kind == "card":
        sep = chance.choice((".", "/", "_", "", "  "))
        return sep.join(digits[i:i + 4] for i in range(0, len(digits), 4))
    sep = chance.choice((".", "-", " ", "/"))
    local = digits[-10:]
    return (chance.choice(("", "00" + digits[:-10] + " ")) if len(digits) > 10 else "") + chance.choice(
        (f"({local[:3]}) {local[3:6]}{sep}{local[6:]}", sep.join((local[:3], local[3:6], local[6:]))))


def _altered(value: str, chance: random.Random) -> str:
    """The same shape with other digits; checksums and octets mostly fail."""
    return "".join(chance.choice("0123456789") if c in "0123456789" else c for c in value)


_BRACKET = re.compile(r"(?i)\s?[\[({<]\s?(at|dot)\s?[\])}>]\s?")
_ADDRESS = re.compile(r"[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")


def is_v6(value: str) -> bool:
    try:
        return ipaddress.IPv6Address(value) is not None
    except ValueError:
        return False


def own_label(kind: str, value: str, before: str) -> int | None:
    """Label of a proposed value of a real text by the kind's own test; None if the test cannot tell."""
    digits = _NOT_DIGIT.sub("", value)
    if kind == "card":
        return None if len(digits) < 16 and luhn(digits) else int(len(digits) >= 16 and luhn(digits))
    if kind == "ip" and ":" in value:
        # Two short groups around a double colon may also be a name in a program.
        return int(is_v6(value)) if value.count(":") > 2 or not is_v6(value) else None
    if kind == "ip":
        if any(int(o) > 255 for o in re.findall(r"[0-9]+", value)):
            return 0
        return 1 if "[.]" in value or "(.)" in value else None
    if kind == "email":
        plain = _BRACKET.sub(lambda m: "@" if m[1].lower() == "at" else ".", value)
        # Without brackets, words around "at" are an address or a sentence.
        return None if re.search(r"\s", plain) else int(bool(_ADDRESS.fullmatch(plain)))
    if digits.startswith("00"):
        return int(8 <= len(digits) - 2 <= 15)
    return None if _CONTEXT["phone"].search(before) else 0


def _sixes(chance: random.Random) -> list[str]:
    """An address of version 6, long or short, and values that look like one."""
    groups = [f"{chance.randrange(1, 1 << 16):x}" for _ in range(8)]
    cut = chance.randrange(2, 6)
    good = chance.choice((":".join(groups), ":".join(groups[:cut]) + "::" + ":".join(groups[cut + 1:])))
    time = f"{chance.randrange(24):02d}:{chance.randrange(60):02d}:{chance.randrange(60):02d}"
    return [good, time, ":".join(f"{chance.randrange(256):02x}" for _ in range(6)), ":".join(groups[:chance.randrange(4, 8)])]


def examples(text: str) -> list[tuple[str, list[float], int]]:
    """(kind, features, label) of weakly labelled candidates of one text."""
    out = []
    spans = base_spans(text)
    chance = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    plain = re.findall(r"[^\W\d_]{2,}", text)

    def propose(kind: str, head: str, value: str, tail: str, label: int) -> None:
        changed = head + value + tail
        for k, a, b in candidates(changed):
            if k == kind and a <= len(head) + 1 and b >= len(head) + len(value) - 1:
                out.append((kind, features(changed, k, a, b), label))
                return

    for s in spans:
        head, tail = text[max(0, s.start - 64):s.start], text[s.end:s.end + 64]
        value = text[s.start:s.end]
        for _ in range(2):
            dressed = _dressed(s.kind, value, chance)
            if dressed:
                # Plain phone digits say little by themselves: half of them get a word before.
                cue = chance.choice(("", {"phone": "phone: ", "card": "card ", "ip": "host ", "email": "mail "}[s.kind]))
                label = int(bool(cue) or s.kind != "phone")
                propose(s.kind, head + cue, dressed, tail, label)
                if s.kind == "card":
                    wrong = _altered(dressed, chance)
                    propose(s.kind, head + cue, wrong, tail, int(luhn(_NOT_DIGIT.sub("", wrong))))
                elif s.kind == "email" and " at " in dressed:
                    # Without brackets only the ending tells an address from a sentence.
                    wrong = re.sub(r"\w+$", chance.choice(plain or ["market"]), dressed)
                    propose(s.kind, head + cue, wrong, tail, int(wrong.split()[-1].lower() in ENDINGS))
                elif s.kind == "ip":
                    wrong = "[.]".join(str(chance.randrange(0, 999)) for _ in range(4))
                    propose(s.kind, head, wrong, tail, int(all(int(p) < 256 for p in wrong.split("[.]"))))
                    for six in _sixes(chance):
                        propose(s.kind, head + cue, six, tail, int(is_v6(six)))
    # Plain words around "at" and "dot" are no address, unless they end as one.
    if len(plain) > 6 and chance.random() < 0.5:
        a, b, c, d, e = chance.sample(plain, 5)
        propose("email", a + " ", f"{b} at {c} dot {d}", " " + e, int(d.lower() in ENDINGS))
    taken = merged_spans((s.start, s.end) for s in spans)
    for kind, a, b in candidates(text):
        label = own_label(kind, text[a:b], text[max(0, a - _NEAR):a])
        if label is not None and not overlaps(taken, a, b):
            out.append((kind, features(text, kind, a, b), label))
    return out


def overlaps(taken: tuple[list[int], list[int]], start: int, end: int) -> bool:
    """Whether a span meets one of the disjoint stretches."""
    starts, ends = taken
    i = bisect_right(ends, start)
    return i < len(starts) and starts[i] < end


_EXAMPLES = "id_hash bigint, kind string, x array<double>, y int"


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, k, x, y) for i, t in zip(batch.column("id_hash").to_pylist(), batch.column("text").to_pylist())
                for k, x, y in examples(t or "")]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()),
             pa.array([r[2] for r in rows], pa.list_(pa.float64())), pa.array([r[3] for r in rows], pa.int32())],
            ["id_hash", "kind", "x", "y"])


def _counted(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [e for t in batch.column("text").to_pylist() for e in examples(t or "")]
            if found:
                step = step_of(model.probabilities(np.array([x for _, x, _ in found])))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in found]), pa.array(step, pa.int64()),
                                                  pa.array([y for _, _, y in found], pa.int32())], ["kind", "step", "y"])
    return run


def learn(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", train_docs: int = TRAIN_DOCS,
          train_examples: int = TRAIN_EXAMPLES) -> Model:
    """Trees and calibration from a bounded sample per kind, thresholds from all other documents.

    Documents are told apart by the hash of their id: one with the hash of a sampled one is in
    neither. Where the sample is the whole table, its own held-out quarter sets the thresholds.
    """
    never = {k: 2.0 for k in KINDS}
    keyed = docs.select(F.xxhash64(doc_id).alias("id_hash"), F.col(doc_id).isNotNull().alias("named"), F.col(text).alias("text"))
    signs = written(keyed.filter("named").select("id_hash", *[F.col("text").rlike(p).alias(k) for k, p in SIGNS.items()])
                    .filter(" OR ".join(KINDS)), "pii-signs")
    parts = [signs.filter(k).select("id_hash").distinct().orderBy("id_hash").limit(train_docs) for k in KINDS]
    chosen = written(reduce(DataFrame.union, parts).distinct(), "pii-sample")
    found = written(keyed.filter("named").join(F.broadcast(chosen), "id_hash").select("id_hash", "text")
                    .mapInArrow(_labelled, _EXAMPLES), "pii-examples")
    kinds = [found.filter(F.col("kind") == k).orderBy(F.xxhash64("x", "y", "id_hash"), "id_hash", "x", "y").limit(train_examples).toArrow()
             for k in KINDS]
    sample = pa.concat_tables(kinds)
    y = np.array(sample["y"].to_pylist(), np.float64)
    # Folds by document; the hash is mixed, as the sample has the smallest ones.
    held = np.array([zlib.crc32(str(i).encode()) % 4 == 0 for i in sample["id_hash"].to_pylist()], bool)
    if not held.any() or held.all() or y[held].min() == y[held].max() or y[~held].min() == y[~held].max():
        return Model(None, 1.0, 0.0, never)
    x, kind = np.array(sample["x"].to_pylist()), np.array(sample["kind"].to_pylist())
    trees = boost(x[~held], y[~held])
    slope, shift = calibrate(trees.margins(x[held]), y[held])
    model = Model(trees, slope, shift, {})
    counts = {k: np.zeros((2, STEPS), np.int64) for k in KINDS}
    for k, step, label in zip(kind[held], step_of(model.probabilities(x[held])), y[held]):
        counts[k][int(label), step] += 1
    # Only documents with a sign of a kind can give examples of note. The signs are looked for again in place:
    # a join with those found would move every text.
    signed = reduce(Column.__or__, [F.col("text").rlike(p) for p in SIGNS.values()])
    rest = (keyed.filter(F.col("named") & signed).join(F.broadcast(chosen), "id_hash", "left_anti")
            .select("text").mapInArrow(_counted(model), "kind string, step bigint, y int"))
    for row in rest.groupBy("kind", "step", "y").agg(F.count("*").alias("n")).collect():
        counts[row["kind"]][row["y"], row["step"]] += row["n"]
    model.thresholds.update({k: counted_threshold(counts[k][1], counts[k][0]) for k in KINDS})
    return model


# ------------------------------------------------------------------ finding

def find_spans(texts: list[str], model: Model) -> list[list[Span]]:
    """All spans of each text, by kind and then start; a batch is scored at once."""
    base = [base_spans(t) for t in texts]
    if model.trees is None:
        return base
    open_: list[tuple[int, str, int, int]] = []
    for i, t in enumerate(texts):
        taken = merged_spans((s.start, s.end) for s in base[i])
        open_ += [(i, *c) for c in candidates(t) if not overlaps(taken, c[1], c[2])]
    if not open_:
        return base
    p = model.probabilities(np.array([features(texts[i], k, a, b) for i, k, a, b in open_]))
    # From the surest on: what is added is disjoint, so a span's neighbours by start decide.
    added: dict[int, list[Span]] = {}
    held: dict[int, tuple[list[int], list[int]]] = {}
    for j in np.argsort(-p, kind="stable").tolist():
        i, k, a, b = open_[j]
        if p[j] >= model.thresholds[k]:
            starts, ends = held.setdefault(i, ([], []))
            if not overlaps((starts, ends), a, b):
                at = bisect_right(starts, a)
                starts.insert(at, a)
                ends.insert(at, b)
                added.setdefault(i, []).append(Span(k, a, b, False, float(p[j])))
    return [sorted(spans + added.get(i, []), key=lambda s: (KINDS.index(s.kind), s.start)) for i, spans in enumerate(base)]


def redacted(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at:s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with all spans of ``text`` replaced by their kind; other columns pass through."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = find_spans([t or "" for t in texts], model)
            columns = list(batch.columns)
            columns[at] = pa.array([t and redacted(t, s) for t, s in zip(texts, found)], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def pii_spans(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, spans): per document an array of (kind, start, end, base, score)."""
    given = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                               ("base", pa.bool_()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find_spans([t or "" for t in batch.column(1).to_pylist()], model)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([[s._asdict() for s in spans] for spans in found], kind)], ["id", "spans"])

    return given.mapInArrow(run, f"id {given.schema['id'].dataType.simpleString()}, spans array<struct<"
                                 "kind:string,start:bigint,end:bigint,base:boolean,score:double>>")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = pii_spans(docs, learn(docs))
    base = F.filter("spans", lambda s: s["base"])

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias("n_" + kind)

    return found.select(
        F.col("id").alias("doc_id"), *[count(k) for k in KINDS], F.sha2(told(base), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("bigint").alias("n_added"))


QUERIES = {"op2_pii": op2_pii}
