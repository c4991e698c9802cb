"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

For byte-level BPE the encoding of a prefix is that of a shorter prefix and one last token. Going
through a piece from left to right, the last token of each prefix is the one vocabulary entry
that ends there and can stand after the last token of the prefix before it, so one pass gives
the count of every prefix. Two tokens can stand side by side if undoing their merges, latest
first, never shows a pair across the gap that would have merged earlier. Pieces that begin
alike share the work: they are taken in sorted order and keep the common part.

Counts at all prefixes answer how long a text is, where to cut it for a budget, and what a
window costs, without encoding it again.

Defined results: a null text is empty (count 0, not over the limit); strings of special tokens
in a text count as one token, as the library does by default, while a prefix that ends inside
one is ordinary text; repeated rows are counted alike.
"""
from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tallyfolio.llm.common import documents, fresh
from tallyfolio.llm.units import UnitValues

LIMIT = 512
_ASCII_PIECES = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
# Python counts these as white space; the pattern does not.
_SEPARATORS = frozenset("\x1c\x1d\x1e\x1f")
# Pieces whose prefixes of two characters are two pieces.
_CONTRACTIONS = ("'re", "'ve", "'ll")


def byte_characters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class PrefixCounter:
    """Counts for a byte-level vocabulary in the tokenizers format."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        merges = spec["model"]["merges"]
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.pair = {(self.vocab[a], self.vocab[b]): self.vocab[a + b] for a, b in merges}
        self.parts = {made: pair for pair, made in self.pair.items()}
        made = [self.vocab[a + b] for a, b in merges]
        lowest = made[0] if made else len(self.vocab)
        if made != sorted(set(made)) or any(i >= lowest for t, i in self.vocab.items() if len(t) == 1):
            raise ValueError("ids do not follow the order of the merges")
        self.bytes = byte_characters()
        self.table = {b: c for b, c in enumerate(self.bytes) if b < 128}
        # Lengths of entries by their last character: only those can end at a place.
        self.lengths: dict[str, list[int]] = {}
        for c, n in {(t[-1], len(t)) for t in self.vocab}:
            self.lengths.setdefault(c, []).append(n)
        for v in self.lengths.values():
            v.sort()
        self.texts = UnitValues(self.count_units, sum, self.specials)
        self._beside: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}

    # -------------------------------------------------------------- one piece

    def beside(self, a: int, b: int) -> bool:
        """Whether merging the bytes of tokens a and b together gives a and b."""
        name = a << 32 | b
        known = self._beside.get(name)
        if known is None:
            if len(self._beside) > 2_000_000:
                self._beside.clear()
            known = self._beside[name] = self._stay_apart(a, b)
        return known

    def _stay_apart(self, a: int, b: int) -> bool:
        limit = len(self.vocab) + 1
        while True:
            joint = self.pair.get((a, b))
            if joint is not None and joint < limit:
                return False
            # Undo the later merge; on the right one of the same rank would have come second.
            if a > b:
                if a not in self.parts:
                    return True
                limit, a = a, self.parts[a][1]
            else:
                if b not in self.parts:
                    return True
                limit, b = b + 1, self.parts[b][0]

    def whole(self, token: int) -> bool:
        """Whether the token's own bytes are encoded as that token."""
        known = self._whole.get(token)
        if known is None:
            known = token not in self.parts
            if not known:
                a, b = self.parts[token]
                # Its parts must come out whole, and meet no earlier than in this merge.
                known = self.whole(a) and self.whole(b) and self._meet(a, b, token)
            self._whole[token] = known
        return known

    def _meet(self, a: int, b: int, token: int) -> bool:
        limit = token
        while True:
            if a > b:
                if a not in self.parts:
                    return True
                limit, a = min(limit, a), self.parts[a][1]
            else:
                if b not in self.parts:
                    return True
                limit, b = min(limit, b + 1), self.parts[b][0]
            joint = self.pair.get((a, b))
            if joint is not None and joint < limit:
                return False

    def extend(self, piece: str, counts: list[int], last: list[int]) -> None:
        """Fill counts and last tokens of the prefixes of ``piece`` beyond those given."""
        vocab, beside, whole = self.vocab, self.beside, self.whole
        for end in range(len(counts), len(piece) + 1):
            for n in self.lengths.get(piece[end - 1], ()):
                start = end - n
                if start < 0:
                    break
                token = vocab.get(piece[start:end])
                if token is not None and (not start or beside(last[start], token)) and whole(token):
                    counts.append(counts[start] + 1)
                    last.append(token)
                    break
            if len(counts) <= end:
                raise ValueError(f"the vocabulary cannot encode {piece[:end]!r}")

    def piece_counts(self, piece: str) -> list[int]:
        counts, last = [0], [-1]
        self.extend(piece, counts, last)
        return counts

    def count_pieces(self, pieces: Iterable[str]) -> dict[str, int]:
        """Token count of each distinct piece; sorted neighbours share their common prefix."""
        found = {}
        before, counts, last = "", [0], [-1]
        for piece in sorted(pieces):
            same = 0
            for a, b in zip(before, piece):
                if a != b:
                    break
                same += 1
            del counts[same + 1:], last[same + 1:]
            self.extend(piece, counts, last)
            found[piece] = counts[-1]
            before = piece
        return found

    # -------------------------------------------------------------- units and texts

    def pieces(self, unit: str) -> list[str]:
        """Byte-level pieces of a unit without special strings."""
        if unit.isascii():
            return [p.translate(self.table) for p in _ASCII_PIECES.findall(unit)]
        return [p for p, _ in self.pre.pre_tokenize_str(unit)]

    def count_units(self, units: list[str]) -> list[int]:
        cut = [self.pieces(u) for u in units]
        counts = self.count_pieces({p for pieces in cut for p in pieces})
        return [sum([counts[p] for p in pieces]) for pieces in cut]

    def counts(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """Per text the counts of its segments; special strings, in the odd places, count one."""
        for segments in self.texts.of(texts):
            yield [1 if i % 2 else s for i, s in enumerate(segments)]

    def unit_prefixes(self, unit: str) -> list[int]:
        """Counts at every code point of a unit, as if the text ended there."""
        counts, before = [0], 0
        run, run_from = "", 0           # white space that a cut would make one piece
        for raw, piece in self._raw_pieces(unit):
            inner = self.piece_counts(piece)
            at = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in raw]).tolist()
            if raw.isspace() and _SEPARATORS.isdisjoint(raw):
                if not run:
                    run_from = before
                marks = self.piece_counts(run + piece)
                counts += [run_from + marks[len(run) + i] for i in at]
                run += piece
            else:
                ends = [before + inner[i] for i in at]
                if run and raw[0] == " ":
                    ends[0] = run_from + self.piece_counts(run + piece[0])[-1]
                if raw in _CONTRACTIONS:
                    ends[1] = before + sum(self.piece_counts(c)[-1] for c in piece[:2])
                counts += ends
                run = ""
            before += inner[-1]
        return counts

    def _raw_pieces(self, unit: str) -> list[tuple[str, str]]:
        found, at = [], 0
        for piece, (a, b) in self.pre.pre_tokenize_str(unit):
            found.append((unit[a:b], piece))
        return found

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token count of text[:i] for every i from 0 to len(text)."""
        out, before, tail, tail_from = [0], 0, "", 0
        for i, segment in enumerate(self.texts.segments(text)):
            if i % 2:
                # Inside the string of a special token the text is ordinary.
                out += [tail_from + self.count_text(tail + segment[:k]) for k in range(1, len(segment))]
                before += 1
                out.append(before)
                tail, tail_from = "", before
                continue
            for unit in self.texts.units(segment):
                inner = self.unit_prefixes(unit)
                out += [before + c for c in inner[1:]]
                tail, tail_from = unit, before
                before = out[-1]
        return np.array(out)

    def count_text(self, text: str) -> int:
        """Tokens of a short text whose special strings, if any, are ordinary."""
        return sum(self.count_units(self.texts.units(text)))

    def cut_for(self, text: str, budget: int, totals: list[int] | None = None) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens.

        Given the counts of the segments, only the units up to the budget are looked at.
        """
        totals = next(self.counts([text])) if totals is None else totals
        before = chars = 0
        for i, (total, raw) in enumerate(zip(totals, self.texts.segments(text))):
            if before + total <= budget:
                before, chars = before + total, chars + len(raw)
                continue
            if i % 2:
                counts = self.prefix_counts(text[:chars + len(raw)])
                return int(np.flatnonzero(counts <= budget)[-1])
            for unit, n in self.texts.each(raw):
                if before + n > budget:
                    inner = self.unit_prefixes(unit)
                    return chars + max(j for j, c in enumerate(inner) if before + c <= budget)
                before, chars = before + n, chars + len(unit)
        return chars


@functools.cache
def loaded(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def token_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", limit: int = LIMIT,
                 path: str | None = None) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, cut_chars): ``cut_chars`` is where to cut for the limit."""
    path = path or vocabulary_path()
    given = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n, cut = [], []
            for text, totals in zip(texts, counter.counts(texts)):
                n.append(sum(totals))
                cut.append(len(text) if n[-1] <= limit else counter.cut_for(text, limit, totals))
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()),
                 pa.array([x > limit for x in n], pa.bool_()), pa.array(cut, pa.int64())],
                ["id", "n_bytes", "n_tokens", "over_limit", "cut_chars"])

    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, cut_chars bigint")


def prefix_table(docs: DataFrame, text: str = "text", out: str = "prefix_tokens", path: str | None = None) -> DataFrame:
    """``docs`` with the array of counts of text[:0], text[:1], ..., the whole text."""
    path, at = path or vocabulary_path(), docs.columns.index(text)
    out = fresh(docs, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(path)
        for batch in batches:
            rows = [counter.prefix_counts(t.as_py() or "") for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.int64()))],
                                             [*batch.schema.names, out])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField(out, ArrayType(LongType()))]))


def truncations(counted: DataFrame, budgets: list[int], text: str = "text", prefix: str = "prefix_tokens") -> DataFrame:
    """The rows of ``prefix_table`` once per budget: the longest prefix within it, its tokens, whether all fits.

    Answered from the stored counts alone: no text is encoded again. Adds ``budget``, ``cut_chars``,
    ``cut_tokens`` and ``whole``; a column of one of these names is refused.
    """
    added = ("budget", "cut_chars", "cut_tokens", "whole")
    if clash := {c.lower() for c in counted.columns} & set(added):
        raise ValueError(f"the table has columns {sorted(clash)}")
    each = counted.withColumn("budget", F.explode(F.array(*[F.lit(b).cast("bigint") for b in budgets])))
    # A longer prefix may have fewer tokens than a shorter one: the last that fits is wanted.
    fits = F.transform(prefix, lambda n, i: F.when(n <= F.col("budget"), i))
    each = each.withColumn("cut_chars", F.array_max(fits).cast("bigint"))
    return each.withColumns({"cut_tokens": F.element_at(prefix, (F.col("cut_chars") + 1).cast("int")),
                             "whole": F.element_at(prefix, -1) <= F.col("budget")})


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


QUERIES = {"op7_token_counts": op7_token_counts}
