"""BPE encoding by an index of pair occurrences, and decoding.

The distinct words of many texts lie in one array of symbols, chained by next and previous
position. An index maps every rank (a pair that merges) to the positions where the pair
stands. Ranks in use are taken in ascending order; merging a pair at all its positions at once
changes only the pairs to the left and right, which are entered under their own ranks. As the
merges were learnt in order, a new pair always ranks behind the one that made it, so the result
is that of merging word by word.

Defined results: a null text is empty and has no ids; strings of the special tokens inside a
text become their ids, as the library does by default; white space only separates words;
repeated rows are encoded alike; ids outside the vocabulary cannot be decoded (KeyError).
"""
from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tallyfolio.llm.common import documents, fresh
from tallyfolio.llm.units import UnitValues

# For ASCII text the pre-tokenizer's pattern needs no Unicode classes.
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


class PairIndex:
    """A vocabulary in the tokenizers format whose words end in a suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, merges = model["vocab"], model["merges"]
        self.tokenizer = Tokenizer.from_file(path)
        self.suffix = model["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.specials.items()}
        self.size = max(self.token) + 1
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        first_use = np.full(self.size, len(merges))
        for side in (self.left, self.right):
            np.minimum.at(first_use, side, np.arange(len(merges)))
        if (first_use[self.made] <= np.arange(len(merges))).any():
            raise ValueError("merges are not in the order in which they were learnt")
        keys = self.left * self.size + self.right
        self.rank_of = np.argsort(keys)
        self.keys = keys[self.rank_of]
        codes = {ord(t): i for t, i in vocab.items() if len(t) == 1}
        ends = {ord(t[0]): i for t, i in vocab.items() if self.suffix and len(t) == 1 + len(self.suffix)
                and t.endswith(self.suffix)} if self.suffix else codes
        self.inner, self.last = (np.full(max(codes) + 1, -1, np.int64) for _ in range(2))
        for table, known in ((self.inner, codes), (self.last, ends)):
            table[list(known)] = list(known.values())
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.plain = [self.token.get(i, "") for i in range(self.size)]
        self.digits = [str(i) for i in range(self.size)]
        self.texts = UnitValues(self.encode_units, b"".join, self.specials, spaced=False)
        self.special_bytes = {t: np.array([i], self.kind).tobytes() for t, i in self.specials.items()}

    # -------------------------------------------------------------- words

    def words(self, unit: str) -> list[str]:
        """Byte-level words of a unit without special strings."""
        if unit.isascii():
            unit = unit.lower()
            if unit.isprintable():
                return _ASCII_WORDS.findall(unit)
        tok = self.tokenizer
        return [w for w, _ in tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(unit))]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it does not merge."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank_of[at], -1)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct byte-level words, merged together through one pair index."""
        if not words:
            return []
        code = np.frombuffer("".join(words).encode("utf-16-le"), "<u2")
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size) - 1
        starts = ends - size + 1
        symbol = self.inner[code]
        symbol[ends] = self.last[code[ends]]
        n = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends], before[starts] = -1, -1

        # The index: rank -> arrays of positions where its pair stands, or stood.
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray, rank: np.ndarray) -> None:
            ok = rank >= 0
            at, rank = at[ok], rank[ok]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, places in zip(rank[np.concatenate(([0], cut))].tolist(), np.split(at, cut)):
                if r in index:
                    index[r].append(places)
                else:
                    index[r] = [places]
                    heapq.heappush(active, r)

        pair = np.flatnonzero(after >= 0)
        enter(pair, self.ranks(symbol[pair], symbol[after[pair]]))
        left, right, made = self.left.tolist(), self.right.tolist(), self.made.tolist()
        while active:
            rank = heapq.heappop(active)
            a, b, new = left[rank], right[rank], made[rank]
            found = index.pop(rank)
            at = found[0] if len(found) == 1 else np.concatenate(found)
            at = at[symbol[at] == a]
            next_ = after[at]
            ok = (next_ >= 0) & (symbol[next_] == b)
            at, next_ = at[ok], next_[ok]
            if not len(at):
                continue
            if a == b:
                # Overlaps go to the leftmost pair.
                at = np.unique(at)
                kept, used = [], -1
                for p, q in zip(at.tolist(), after[at].tolist()):
                    if p != used:
                        kept.append(p)
                        used = q
                at = np.array(kept)
                next_ = after[at]
            symbol[at], symbol[next_] = new, -1
            beyond = after[next_]
            after[at] = beyond
            more = beyond >= 0
            before[beyond[more]] = at[more]
            ahead = before[at]
            ahead = ahead[ahead >= 0]
            right_at = at[more]
            enter(np.concatenate((ahead, right_at)), self.ranks(
                np.concatenate((symbol[ahead], symbol[right_at])),
                np.concatenate((symbol[after[ahead]], symbol[beyond[more]]))))
        alive = symbol >= 0
        stop = (np.cumsum(alive)[ends] * self.kind.itemsize).tolist()
        data = symbol[alive].astype(self.kind).tobytes()
        return [data[i:j] for i, j in zip([0, *stop], stop)]

    def encode_units(self, units: list[str]) -> list[bytes]:
        cut = [self.words(u) for u in units]
        distinct = list({w for words in cut for w in words})
        ids = dict(zip(distinct, self.encode_words(distinct)))
        return [b"".join([ids[w] for w in words]) for words in cut]

    # -------------------------------------------------------------- texts

    def encode_bytes(self, texts: Iterator[str]) -> Iterator[bytes]:
        """Ids of each whole text, little-endian."""
        for segments in self.texts.of(texts):
            yield b"".join([self.special_bytes[s] if i % 2 else s for i, s in enumerate(segments)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(next(self.encode_bytes([text])), self.kind).tolist()

    def decode(self, ids: list[int]) -> str:
        """The tokens' own strings with a space between, as this vocabulary has no decoder."""
        try:
            return " ".join([self.token[i] for i in ids])
        except KeyError as e:
            raise KeyError(f"no token has the id {e.args[0]}") from None


@functools.cache
def loaded(path: str) -> PairIndex:
    """One vocabulary per Python worker, with the units it has seen."""
    return PairIndex(path)


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, text: str = "text", path: str | None = None, columns: list[str] | None = None,
           ids: str = "ids", count: str = "n_tokens") -> DataFrame:
    """``columns`` of ``docs`` (all, if not given) with the ids and their number."""
    path = path or vocabulary_path()
    columns = docs.columns if columns is None else columns
    clash = {ids.lower(), count.lower()} & {c.lower() for c in columns}
    if clash:
        raise ValueError(f"documents already have the columns {sorted(clash)}")
    source = fresh(docs, "text_")
    given = docs.select(*columns, F.col(text).alias(source))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            found = [np.frombuffer(b, bpe.kind) for b in
                     bpe.encode_bytes(t.as_py() or "" for t in batch.column(batch.num_columns - 1))]
            stop = np.cumsum([0, *map(len, found)])
            flat = np.concatenate(found).astype(np.int32) if found else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(stop, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], lists, pa.array(np.diff(stop))], [*columns, ids, count])

    schema = StructType([*given.schema.fields[:-1], StructField(ids, ArrayType(IntegerType())), StructField(count, LongType())])
    return given.mapInArrow(run, schema)


def decode(encoded: DataFrame, ids: str = "ids", path: str | None = None, out: str = "decoded") -> DataFrame:
    """``encoded`` with the decoded text ``out`` (under a free name, if it has such a column); null ids give a null text."""
    out = fresh(encoded, out)
    path, at = path or vocabulary_path(), encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            texts = [None if x is None else bpe.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             [*batch.schema.names, out])

    return encoded.mapInArrow(run, StructType([*encoded.schema, StructField(out, StringType())]))


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None) -> DataFrame:
    """Per document the number of ids, and digests of the ids and of the text decoded from them."""
    path = path or vocabulary_path()
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        digits, plain = bpe.digits, bpe.plain
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for data in bpe.encode_bytes(t.as_py() or "" for t in batch.column(1)):
                ids = np.frombuffer(data, bpe.kind).tolist()
                n.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join([digits[i] for i in ids]).encode()).hexdigest())
                of_text.append(hashlib.sha256(" ".join([plain[i] for i in ids]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))


QUERIES = {"op1_bpe": op1_bpe}
