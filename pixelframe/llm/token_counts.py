"""Operator 5: exact token counts at every prefix of a text, by dynamic programming over byte-level BPE."""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import buffers, slices

#: White space as the tokenizer's pattern has it (Unicode White_Space).
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = frozenset(chr(i) for i in range(0x3001) if re.match(f"[{_WS}]", chr(i)))
#: Nothing that the pattern takes spans more than one of these.
CHUNK = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: The pattern of byte-level BPE vocabularies (fixed value).
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Entries that a worker keeps; beyond that it starts anew. Longer texts aren't kept: text without white space is one such entry.
CACHE, CACHED_LETTERS = 400_000, 64


def byte_letters() -> dict[str, int]:
    """The letters that stand for the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """counts(piece)[i]: the number of tokens of the first i bytes of a piece.

    The last token of a prefix's encoding is the one token that ends there and may follow the last token of
    what comes before it: two tokens are compatible if encoding their joined bytes gives back these two. So
    each prefix needs one look at the tokens that end at its last byte, and no prefix is encoded again.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.vocab = {bytes(letters[c] for c in k): v for k, v in spec["model"]["vocab"].items() if all(c in letters for c in k) and k not in self.special}
        to_bytes = lambda s: bytes(letters[c] for c in s)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merge = {(to_bytes(a), to_bytes(b)): i for i, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.vocab))
        self.split_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.split: dict[bytes, tuple[bytes, bytes, int]] = {}
        for i, (a, b) in enumerate(self.merge):
            self.split.setdefault(a + b, (a, b, i))
        self._fits: dict[tuple[bytes, bytes], bool] = {}
        self._sides: dict[tuple[bytes, int], list[tuple[bytes, int]]] = {}
        self._whole: dict[bytes, bool] = {}
        self._chunks: dict[str, int] = {}
        self._pieces: dict[str, int] = {}

    def encode(self, piece: bytes) -> list[bytes]:
        """By merging the best-ranked pair again and again."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.merge.get(p, 1 << 60), i) for i, p in enumerate(itertools.pairwise(parts)))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def side(self, token: bytes, which: int) -> list[tuple[bytes, int]]:
        """The tokens that stand at a token's left (0) or right (1) edge while it is built, each with the rank of the merge that takes it up."""
        known = self._sides.get((token, which))
        if known is None:
            known, until = [], 1 << 60
            while True:
                known.append((token, until))
                if token not in self.split:
                    break
                until = self.split[token][2]
                token = self.split[token][which]
            self._sides[known[0][0], which] = known
        return known

    def fits(self, a: bytes, b: bytes) -> bool:
        """Whether a and b stay two tokens: no merge across their border comes before those that build them (of equal merges the left one is first)."""
        known = self._fits.get((a, b))
        if known is None:
            if len(self._fits) >= CACHE:
                self._fits.clear()
            merge = self.merge.get
            known = True
            for x, x_until in self.side(a, 1):
                for y, y_until in self.side(b, 0):
                    rank = merge((x, y))
                    if rank is not None and rank < x_until and rank <= y_until:
                        known = False
                        break
                if not known:
                    break
            self._fits[a, b] = known
        return known

    def whole(self, token: bytes) -> bool:
        """Whether a token of the vocabulary is its own encoding."""
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = self.encode(token) == [token]
        return known

    def counts(self, piece: bytes) -> list[int]:
        count, last = [0], [b""]
        vocab, fits, longest = self.vocab, self._fits, self.longest
        for i in range(1, len(piece) + 1):
            for at in range(max(0, i - longest), i):
                token = piece[at:i]
                if token in vocab:
                    if at:
                        before = last[at]
                        known = fits.get((before, token))
                        if not (self.fits(before, token) if known is None else known):
                            continue
                    elif not self.whole(token):
                        continue
                    count.append(count[at] + 1)
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token ends at byte {i} of {piece[:40]!r}")
        return count

    def chunk(self, text: str) -> int:
        known = self._chunks.get(text)
        if known is None:
            known = sum([self._pieces.get(p) or self.piece(p) for p in PATTERN.findall(text)])
            if len(text) <= CACHED_LETTERS:
                if len(self._chunks) >= CACHE:
                    self._chunks.clear()
                self._chunks[text] = known
        return known

    def piece(self, text: str) -> int:
        known = self.counts(text.encode())[-1]
        if len(text) <= CACHED_LETTERS:
            if len(self._pieces) >= CACHE:
                self._pieces.clear()
            self._pieces[text] = known
        return known

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """Chunks of a text in order, and whether they are special tokens."""
        at = 0
        if self.split_special and "<|" in text:
            for m in self.split_special.finditer(text):
                yield from ((c, False) for c in CHUNK.findall(text[at : m.start()]))
                yield m[0], True
                at = m.end()
        yield from ((c, False) for c in CHUNK.findall(text[at:] if at else text))

    def total(self, text: str) -> int:
        if self.split_special and "<|" in text:
            return sum(1 if special else self.chunk(c) for c, special in self.parts(text))
        chunk, known = self.chunk, self._chunks.get
        return sum([known(c) or chunk(c) for c in CHUNK.findall(text)])

    def table(self, text: str) -> tuple[list[int], list[int]]:
        """All byte offsets of a text, and the number of tokens of the text cut at each.

        A cut changes the split of the last piece only: a run of white space before a word is whole until the word
        begins, a contraction without its last letter is two pieces, and a special token's beginning is common text.
        Within a letter's bytes the bytes count as they lie in the whole text's split.
        """
        counts, base, open_at, last = [0], 0, 0, ""
        for c, special in self.parts(text):
            if special:
                for j in range(1, len(c)):
                    cut = open_at + sum(map(self.piece, PATTERN.findall(last + c[:j])))
                    counts += [cut] * len(c[j - 1].encode())
                base += 1
                counts += [base] * len(c[-1].encode())
                open_at, last = base, ""
                continue
            for p in PATTERN.findall(c):
                own = self.counts(p.encode())
                at = len(counts)
                counts += [base + k for k in own[1:]]
                if last and last[0] in SPACES and p[0] in SPACES:
                    counts[at + len(p[0].encode()) - 1] = open_at + self.piece(last + p[0])
                elif p in ("'re", "'ve", "'ll"):
                    counts[at + 1] = base + self.piece("'") + self.piece(p[1])
                open_at, last = base, p
                base += own[-1]
        return list(range(len(counts))), counts


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _map(docs: DataFrame, text: str, name: str, kind: T.DataType, arrow: pa.DataType, of, extra_bytes: bool = False) -> DataFrame:
    rest = [c for c in docs.columns if c not in (text, name, "n_bytes")]
    schema = docs.select(*rest).schema
    if extra_bytes:
        schema = schema.add("n_bytes", "long")
    schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(buffers(batch.column(text))[1]):
                part = batch.slice(lo, hi - lo)
                texts = [t or "" for t in part.column(text).to_pylist()]
                sizes = [pa.array([len(t.encode()) for t in texts], pa.int64())] if extra_bytes else []
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *sizes, pa.array([of(t) for t in texts], arrow)], names=[*rest, *(["n_bytes"] if extra_bytes else []), name])

    return docs.select(*rest, text).mapInArrow(run, schema)


def token_counts(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """docs without the text, with n_bytes and n_tokens of each whole text.

    Null and empty texts have 0 of both; special strings in a text are one token each, as the library has it.
    Repeated rows, ties and null ids are counted row by row; columns named like a result are replaced.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    return _map(docs, text, "n_tokens", T.LongType(), pa.int64(), lambda t: counter(path).total(t), extra_bytes=True)


def prefix_counts(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """docs without the text, with `prefix_tokens` (array<int>): entry i is the number of tokens of the text cut at byte i.

    So it is at every byte between two letters; within a letter, where the cut text is none, its bytes are counted as they
    lie in the whole text's split. More bytes may have fewer tokens.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    return _map(docs, text, "prefix_tokens", T.ArrayType(T.IntegerType()), pa.list_(pa.int32()), lambda t: counter(path).table(t)[1])


def tokens_at(prefixes: DataFrame, n_bytes: int) -> DataFrame:
    """Adds `tokens`: those of the first n_bytes bytes, from the stored prefixes."""
    from pyspark.sql import functions as F

    return prefixes.withColumn("tokens", F.expr(f"prefix_tokens[least({int(n_bytes)}, size(prefix_tokens) - 1)]"))


def bytes_within(prefixes: DataFrame, budget: int) -> DataFrame:
    """Adds `fits_bytes`: the longest prefix in bytes that has no more tokens than the budget."""
    from pyspark.sql import functions as F

    return prefixes.withColumn("fits_bytes", F.expr(f"array_max(transform(sequence(0, size(prefix_tokens) - 1), i -> IF(prefix_tokens[i] <= {int(budget)}, i, 0)))"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs).selectExpr("doc_id", "n_bytes", "n_tokens", "n_tokens > 1024 AS over_limit")


__all__ = ["PrefixCounter", "bytes_within", "op5", "prefix_counts", "token_counts", "tokens_at"]
