"""Operator 6: SentencePiece merges with seeded dropout, and lossless decoding."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import buffers, mix, slices

#: The letter that stands for a space in the vocabulary.
SPACE = "▁"
#: Longer units are segmented one by one, from a heap.
SHORT = 64
#: Letters whose units merge at once (some 140 bytes each while they do); a longer unit merges alone.
MERGED_LETTERS = 1 << 18
_NEVER = (1 << 63) - 1
_U = np.uint64


class PieceEncoder:
    """Agenda merges over a vocabulary's pieces: the best score first, the leftmost of equal ones.

    With dropout each candidate merge of each occurrence of a unit is skipped for good if its keyed hash (head, place of
    the unit in the text, place and length in the unit) falls below the rate. All units of a slice of texts merge at once,
    each its best pair in every round.
    """

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.id = {p: i for i, p in enumerate(self.pieces) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        self.score = {p: model.get_score(i) for p, i in self.id.items()}
        self.longest = max(map(len, self.score))
        own = {i: bytes([b]) for b, i in self.bytes.items()}
        self.text_of = [own.get(i) or p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        # letters that only occur within pieces are numbered after the pieces
        number = dict(self.id)
        for c in sorted({c for p in self.id for c in p}):
            number.setdefault(c, len(self.pieces) + len(number))
        self.letter = np.full(0x110000, -1, np.int32)
        for c, i in number.items():
            if len(c) == 1:
                self.letter[ord(c)] = i
        pairs = [(number[p[:k]] << 32 | number[p[k:]], i, -self.score[p]) for p, i in self.id.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        pairs.sort()
        self.pair = np.array([k for k, _, _ in pairs] + [(1 << 63) - 1], np.int64)
        self.made = np.array([i for _, i, _ in pairs] + [-1], np.int64)
        self.rank = np.unique(np.array([r for _, _, r in pairs] + [np.inf]), return_inverse=True)[1].astype(np.int64)

    def skips(self, head: np.ndarray, place: np.ndarray, size: np.ndarray, rate: float) -> np.ndarray:
        """Whether the merges of these sizes at these places of units (by their heads) are skipped."""
        draw = mix(head + mix((place << 32 | size).astype(np.uint64)))
        return draw <= _U(min(int(rate * (1 << 64)), 1 << 64) - 1) if rate > 0 else np.zeros(len(draw), bool)

    def segment(self, unit: str, skipped: frozenset[int] = frozenset()) -> list[str]:
        """Pieces of one unit without the skipped merges (place << 32 | length)."""
        parts: list[str | None] = list(unit)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        score, agenda = self.score, []

        def offer(i: int, j: int) -> None:
            piece = parts[i] + parts[j]
            if piece in score and (i << 32 | len(piece)) not in skipped:
                heapq.heappush(agenda, (-score[piece], i, j, piece))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, piece = heapq.heappop(agenda)
            if parts[i] is None or parts[j] is None or after[i] != j or len(parts[i]) + len(parts[j]) != len(piece):
                continue
            parts[i], parts[j] = piece, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in parts if p is not None]

    def merged(self, code: np.ndarray, starts: np.ndarray, head: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
        """For units of letters (from starts on): the piece that begins at each letter (-1: none in the vocabulary), and whether one does."""
        out, begins = self.letter[code].astype(np.int64), np.ones(len(code), bool)
        sizes = np.diff(np.r_[starts, len(code)])
        for u in np.flatnonzero(sizes > SHORT).tolist():
            at = int(starts[u])
            unit = "".join(map(chr, code[at : at + sizes[u]].tolist()))
            n = len(unit)
            offers = np.array([(i, k) for i in range(n - 1) for k in range(2, min(self.longest, n - i) + 1) if unit[i : i + k] in self.score], np.int64).reshape(-1, 2)
            off = offers[self.skips(np.repeat(head[u], len(offers)), offers[:, 0], offers[:, 1], rate)]
            for p in self.segment(unit, frozenset((off[:, 0] << 32 | off[:, 1]).tolist())):
                if len(p) > 1:
                    out[at] = self.id[p]
                    begins[at + 1 : at + len(p)] = False
                at += len(p)
        some = np.flatnonzero((sizes > 1) & (sizes <= SHORT))
        count, head, origin = sizes[some], head[some], starts[some]
        first = np.cumsum(count) - count
        at = np.arange(int(count.sum())) + np.repeat(origin - first, count)
        piece, size = out[at], np.ones(len(at), np.int64)

        def offer(i: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Keys (rank, place) and results of the merges of the parts i and i + 1."""
            key, to = np.full(len(i), _NEVER), np.full(len(i), -1)
            both = np.flatnonzero((piece[i] >= 0) & (piece[i + 1] >= 0))
            want = piece[i[both]] << 32 | piece[i[both] + 1]
            found = np.searchsorted(self.pair, want)
            fits = self.pair[found] == want
            both, found = both[fits], found[fits]
            place = at[i[both]] - origin[unit[both]]
            if rate > 0:
                stay = ~self.skips(head[unit[both]], place, size[i[both]] + size[i[both] + 1], rate)
                both, found, place = both[stay], found[stay], place[stay]
            key[both], to[both] = self.rank[found] << 16 | place, self.made[found]
            return key, to

        key, to = np.full(len(at), _NEVER), np.full(len(at), -1)
        inner = np.ones(len(at), bool)
        inner[first + count - 1] = False
        inner = np.flatnonzero(inner)
        key[inner], to[inner] = offer(inner, np.repeat(np.arange(len(count)), count)[inner])
        while len(count):
            best = np.minimum.reduceat(key, first)
            live = best < _NEVER
            if not live.all():
                keep = np.repeat(live, count)
                at, piece, size, key, to = at[keep], piece[keep], size[keep], key[keep], to[keep]
                best, count, head, origin = best[live], count[live], head[live], origin[live]
                first = np.cumsum(count) - count
                if not len(count):
                    break
            i = np.flatnonzero(key == np.repeat(best, count))
            piece[i] = out[at[i]] = to[i]
            size[i] += size[i + 1]
            begins[at[i + 1]] = False
            keep = np.ones(len(at), bool)
            keep[i + 1] = False
            at, piece, size, key, to = at[keep], piece[keep], size[keep], key[keep], to[keep]
            unit = np.arange(len(count))
            i, count, first = i - unit, count - 1, first - unit
            key[i] = _NEVER
            right, left = np.flatnonzero(i < first + count - 1), np.flatnonzero(i > first)
            again = np.r_[i[right], i[left] - 1]
            key[again], to[again] = offer(again, np.r_[right, left])
        return out, begins

    def ids_of(self, texts: list[str], rate: float = 0.0, heads: list[int] | None = None) -> list[bytes]:
        """Ids of whole texts as little-endian bytes; pieces outside the vocabulary go byte by byte. heads: the keys of the texts' draws.

        With dropout a space mark that a text itself has goes byte by byte too; without, it stands for a space, as in the library.
        """
        given = [" " + t if t else "" for t in texts]
        code = np.frombuffer("".join(given).encode("utf-32-le"), "<u4")
        if not len(code):
            return [b""] * len(texts)
        mark = code == ord(SPACE) if rate > 0 else np.zeros(len(code), bool)
        # the noncharacter is in no vocabulary
        code = np.where(mark, 0xFFFF, np.where(code == 32, ord(SPACE), code)).astype("<u4")
        size = np.array([len(t) for t in given])
        first = (np.cumsum(size) - size)[size > 0]
        # no piece has a letter before a space mark, so that no merge spans two units: space marks and what follows them
        space = code == ord(SPACE)
        begins = np.r_[True, space[1:] & ~space[:-1]]
        begins[first] = True
        starts = np.flatnonzero(begins)
        doc = np.searchsorted(first, starts, "right") - 1
        place = np.arange(len(starts)) - np.searchsorted(starts, first)[doc]
        head = mix(np.array(heads or [0] * len(texts), np.uint64)[size > 0][doc] + place.astype(np.uint64))
        found = []
        bounds = np.r_[starts, len(code)]
        for lo, hi in slices(bounds, MERGED_LETTERS):
            piece, begins = self.merged(code[bounds[lo] : bounds[hi]], starts[lo:hi] - bounds[lo], head[lo:hi], rate)
            kept = np.flatnonzero(begins)
            found.append((kept + bounds[lo], piece[kept]))
        at, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        ends = np.searchsorted(at, np.cumsum(size))
        bare = np.flatnonzero((piece < 0) | (piece >= len(self.pieces)))
        if len(bare):
            raw = [[self.bytes[b] for b in (SPACE if m else chr(c)).encode()] for c, m in zip(code[at[bare]].tolist(), mark[at[bare]].tolist(), strict=True)]
            wide = np.ones(len(piece), np.int64)
            wide[bare] = [len(r) for r in raw]
            total = np.r_[0, np.cumsum(wide)]
            piece, ends = np.repeat(piece, wide), total[ends]
            piece[np.repeat(np.isin(np.arange(len(wide)), bare), wide)] = [b for r in raw for b in r]
        data = piece.astype("<u4").tobytes()
        return [data[4 * lo : 4 * hi] for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def ids(self, text: str, rate: float = 0.0, head: int = 0) -> bytes:
        return self.ids_of([text], rate, [head])[0]

    def decode(self, ids: bytes) -> str:
        """The text of ids; the inverse of ids() with dropout (without, a space mark in a text reads as a space)."""
        text = b"".join(map(self.text_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode(errors="replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def encode_pieces(docs: DataFrame, text: str = "text", rate: float = 0.1, seed: int = 1, variants: int = 1, vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """docs without the text, with n_bytes, n_pieces, ids_crc32, lossless and (with_ids) piece_ids of each whole text.

    Merges are skipped by a hash keyed by the seed, the text's variant (the hash of its bytes modulo `variants`), the
    row's doc_id (if there is one), the text itself and the place in it: a word is segmented anew wherever it occurs,
    and a row with the same doc_id and text alike for the same seed, whatever the partitioning. Null and empty texts have no
    pieces; long ones are encoded whole; `lossless` tells whether the pieces decode to the very text (at rate 0 a text with the letter U+2581 does not); rows are independent, whatever repeats or is null; columns named like a result are replaced.
    """
    path = vocabulary or public_tokenizers.path("piece_bpe_32k.model")
    made = ["n_bytes", "n_pieces", "ids_crc32", "lossless"]
    rest = [c for c in docs.columns if c not in (text, *made, "piece_ids")]
    schema = docs.select(*rest).schema
    for c, kind in zip(made, (T.LongType(), T.LongType(), T.LongType(), T.BooleanType()), strict=True):
        schema = schema.add(c, kind)
    if with_ids:
        schema = schema.add("piece_ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(buffers(batch.column(text))[1]):
                part = batch.slice(lo, hi - lo)
                texts = [t or "" for t in part.column(text).to_pylist()]
                raw = [t.encode() for t in texts]
                docs_of = part.column("doc_id").to_pylist() if "doc_id" in rest else [None] * len(raw)
                heads = [xxhash.xxh64_intdigest(r, xxhash.xxh64_intdigest(f"{seed}\0{zlib.crc32(r) % variants}\0{d}")) for d, r in zip(docs_of, raw, strict=True)]
                ids = encoder(path).ids_of(texts, rate, heads)
                sound = [encoder(path).decode(i) == t for i, t in zip(ids, texts, strict=True)]
                arrays = [*(part.column(c) for c in rest), pa.array(list(map(len, raw)), pa.int64()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(list(map(zlib.crc32, ids)), pa.int64()), pa.array(sound, pa.bool_())]
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(i, "<i4") for i in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select(*rest, text).mapInArrow(run, schema)


def decode_pieces(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """rows with `text` from piece_ids; a null array gives an empty text."""
    path = vocabulary or public_tokenizers.path("piece_bpe_32k.model")
    rest = [c for c in rows.columns if c not in ("piece_ids", "text")]
    schema = rows.select(*rest).schema.add("text", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [encoder(path).decode(np.asarray(i or [], "<u4").tobytes()) for i in batch.column("piece_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.string())], names=schema.names)

    return rows.select(*rest, "piece_ids").mapInArrow(run, schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), with_ids=False)
