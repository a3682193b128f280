"""SentencePiece encoding and decoding with a public byte-fallback BPE model.

Distinct marked words are sorted, which makes them a trie in depth-first order, and traversed with
one stack of forward states, so words share the work of their common prefix.  The model is BPE, for
which the path of the greatest sum of scores would be a wrong segmentation.  The forward state of a
prefix is therefore the last piece of its BPE segmentation: of the pieces that end there, exactly
one is left standing next to the last piece of the prefix before it.  Walking the states back
from a word's end gives the word's pieces.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textbytes as tb
from .shared import small_batches

MARK = "▁"
#: Distinct words whose ids a task keeps, and neighbours a worker knows; beyond it they are forgotten.
CACHE_WORDS = 250_000
#: Characters of a word beyond which its ids are not kept for later texts.
CACHE_WORD_CHARS = 100
#: Characters from which a word is merged with a heap of neighbours instead of scans.
HEAP_CHARS = 32
#: Texts that are split into words at a time.
SLICE_DOCS = 512
_MARKED = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Pieces:
    """A model's pieces by text, with their ids and merge order."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.vocab_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {self.text[i]: i for i in plain}
        self.score = {self.text[i]: model.get_score(i) for i in plain}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        order = {s: k for k, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        #: Merge order of pieces: 0 is merged first, equal scores are equal.
        self.rank = {p: order[s] for p, s in self.score.items()}
        #: Ends of pieces: the piece if one itself, else empty.
        self.kinds = {p[k:]: "" for p in self.ids for k in range(len(p))} | {p: p for p in self.ids}
        self.raw = [b""] * n
        for i in plain:
            self.raw[i] = self.text[i].replace(MARK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.raw[i] = bytes([b])
        self.packed_ids = {p: i.to_bytes(4, "little") for p, i in self.ids.items()}
        self.packed_bytes = [i.to_bytes(4, "little") for i in self.byte_ids]
        self._beside: dict[tuple[str, str], bool] = {}

    def merged(self, word: str) -> list[str]:
        """The word's pieces by merging: the best-scored neighbours first, of equal ones the leftmost."""
        if len(word) > HEAP_CHARS:
            return self.merged_by_heap(word)
        parts = list(word)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def merged_by_heap(self, word: str) -> list[str]:
        """merged() in n log n steps.

        The heap has the rank and place of every pair of neighbours, packed in one integer.  One that
        doesn't hold any more is passed over: the pair that now stands at its place has its own entry.
        """
        n, rank = len(word), self.rank
        parts: list[str | None] = list(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 40 | k for k in range(n - 1) if (r := rank.get(word[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, at = divmod(heapq.heappop(heap), 1 << 40)
            if parts[at] is None or (right := after[at]) == n:
                continue
            both = parts[at] + parts[right]
            if rank.get(both) != r:
                continue
            parts[at], parts[right] = both, None
            after[at] = following = after[right]
            if following < n:
                before[following] = at
                if (r := rank.get(both + parts[following])) is not None:
                    heapq.heappush(heap, r << 40 | at)
            if (left := before[at]) >= 0 and (r := rank.get(parts[left] + both)) is not None:
                heapq.heappush(heap, r << 40 | left)
        return [p for p in parts if p is not None]

    def beside(self, left: str, right: str) -> bool:
        """Whether the two pieces stay apart when they stand next to each other."""
        key = (left, right)
        known = self._beside.get(key)
        if known is None:
            if len(self._beside) > CACHE_WORDS:
                self._beside.clear()
            known = self._beside[key] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def packed(self, parts: Iterable[str]) -> bytes:
        """Ids of pieces as little-endian 32-bit integers; unknown characters as their bytes."""
        get, unknown = self.packed_ids.get, self.packed_bytes
        return b"".join([get(p) or b"".join(unknown[b] for b in p.encode()) for p in parts])

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Packed ids of distinct words, in one depth-first walk over their trie.

        The walk keeps the last piece of each prefix of the word at hand; words that share a prefix
        share them.  At a word's end its pieces are read off backwards.
        """
        found: dict[str, bytes] = {}
        last, before = [""], ""
        kinds, known = self.kinds, self._beside
        for word in sorted(words):
            if word.startswith(MARK + MARK):
                found[word] = self.packed(self.merged(word))  # runs of marks have pieces of equal score
                continue
            n, k = len(word), 0
            for x, y in zip(word, before):
                if x != y:
                    break
                k += 1
            del last[k + 1 :]
            for i in range(k + 1, n + 1):
                piece = word[i - 1]
                for j in range(i - 1, -1, -1):
                    p = word[j:i]
                    kind = kinds.get(p)
                    if kind is None:
                        break
                    if kind:
                        left = last[j]
                        stays = known.get((left, p))
                        if stays is None:
                            stays = self.beside(left, p)
                        if stays:
                            piece = kind
                            break
                last.append(piece)
            before = word
            parts = []
            while n:
                parts.append(last[n])
                n -= len(last[n])
            parts.reverse()
            found[word] = self.packed(parts)
        return found


def marked_words(text: str) -> list[str]:
    """The text's marked words, line ends apart; joined they are the marked text."""
    out: list[str] = []
    for k, line in enumerate(text.split("\n")):
        if k:
            out.append("\n")
        if "  " in line or MARK in line or (not k and line.startswith(" ")):
            marked = line.replace(" ", MARK)
            out.extend(_MARKED.findall(marked if k else MARK + marked))
        else:
            first, *rest = line.split(" ")
            if not k:
                out.append(MARK + first)
            elif first:
                out.append(first)
            out.extend([MARK + w for w in rest])
    return out


@lru_cache(maxsize=1)
def _pieces(model_file: str) -> Pieces:
    """The model, one for all tasks of a Python worker."""
    return Pieces(model_file)


def _encoder(model_file: str) -> Callable[[list], list[bytes]]:
    """An encoder of lists of texts; it keeps short words it has met, so a task makes one and lets it go."""
    pieces, cache = _pieces(model_file), {}

    def encode(texts: list) -> list[bytes]:
        split = [marked_words(t) if t else [] for t in texts]
        new = {w for words in split for w in words}
        if len(cache) + len(new) > CACHE_WORDS:
            cache.clear()
        cache.update(pieces.encode_words(w for w in new if w not in cache))
        get = cache.__getitem__
        ids = [b"".join(map(get, words)) for words in split]
        for w in new:
            if len(w) > CACHE_WORD_CHARS:
                del cache[w]
        return ids

    return encode


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """docs, all rows and columns, with ids: the text's piece ids as little-endian 32-bit integers.

    Null and empty texts have no ids.  The model file has to be readable at that path on executors.
    """
    docs = small_batches(docs).drop("ids")
    names, schema = docs.columns, StructType([*docs.schema.fields]).add("ids", "binary")

    @tb.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model_file)
        for batch in batches:
            column = batch.column("text")
            for lo in range(0, batch.num_rows, SLICE_DOCS):
                part = batch.slice(lo, SLICE_DOCS)
                ids = encoder(column.slice(lo, SLICE_DOCS).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in range(len(names))), pa.array(ids, pa.binary())], [*names, "ids"])

    return docs.mapInArrow(run, schema)


def _decoder(model_file: str) -> Callable[[bytes], str]:
    """A decoder of packed ids."""
    raw = _pieces(model_file).raw

    def decode_one(ids: bytes) -> str:
        return b"".join(map(raw.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace").removeprefix(" ")

    return decode_one


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """encoded, all rows and columns, with decoded: the text its ids stand for."""
    encoded = encoded.drop("decoded")
    names, schema = encoded.columns, StructType([*encoded.schema.fields]).add("decoded", "string")

    @tb.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(model_file)
        for batch in batches:
            texts = [decoder(ids or b"") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    return encoded.mapInArrow(run, schema)


def digest(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, round_trip) of each row: its ids and whether they decode to its text.

    The same encoder and decoder as encode() and decode(), one after the other in a task, so that
    neither ids nor decoded texts leave it.  A null text has no ids and decodes to the empty text.  A
    mark character in a text decodes to a space, as the model has it; such a text round-trips if it
    does apart from that.
    """

    @tb.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _encoder(model_file), _decoder(model_file)
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_DOCS):
                part = batch.slice(lo, SLICE_DOCS)
                texts = part.column(1).to_pylist()
                ids = encoder(texts)
                same = [decoder(i) == (t or "").replace(MARK, " ") for i, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array(same, pa.bool_())],
                    ["doc_id", "n_tokens", "ids_crc32", "round_trip"],
                )

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")
