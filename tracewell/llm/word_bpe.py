"""Ids of whole text columns by byte-level BPE with word ends, in numpy.

Texts are cut into parts (runs of letters, single digits, runs of other signs).  Short parts are
looked up, many at a time, in a hash table of those met before.  New ones of ASCII and Latin-1
characters are merged here: parts of one length are rows of a matrix, every round merges each
row's least-ranked pair and makes the row one symbol shorter.  Words with anything else go to the
library, and so do all words of a tokenizer of another kind.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

from .textbytes import U64

#: Fixed value: the word pattern of the tokenizers that this module can stand for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Bytes of a word part beyond which the library merges it.
LONGEST = 64
_NO_RANK = np.int32(np.iinfo(np.int32).max)
_SLOTS = 1 << 19
LETTER, DIGIT, OTHER, BREAK, ODD = 1, 2, 3, 4, 5
#: Bytes of parts that the hash table knows, its slots and most entries, and most longer parts or odd words kept.
SHORT, TABLE_BITS, MOST_ENTRIES, MOST_LONG = 16, 21, 1_000_000, 100_000
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)

_KIND = np.full(256, OTHER, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = LETTER
_KIND[48:58] = DIGIT
_KIND[0:33] = _KIND[127] = BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_characters() -> list[str]:
    """The character by which each byte stands in a byte-level vocabulary: itself if visible, else one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys.astype(U64) * U64(0x9E3779B97F4A7C15) >> U64(45)).astype(np.int64)


class WordBpe:
    """A tokenizer file's merges as a hash table, and the library's tokenizer for what it leaves out."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, splits = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.known = (
            model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("ignore_merges") and normal == ["NFC", "Replace", "Lowercase"]
            and [s["type"] for s in splits] == ["Split", "ByteLevel"] and splits[0]["pattern"].get("Regex") == PATTERN
        )
        if not self.known:
            return
        ids = model["vocab"]
        characters = byte_characters()
        self.inner = np.array([ids[c] for c in characters], np.int32)
        self.last = np.array([ids[c + "</w>"] for c in characters], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int32)
        keys = np.array([ids[a] << 20 | ids[b] for a, b in pairs], np.int64)
        self.key, self.rank = np.full(_SLOTS, -1, np.int64), np.full(_SLOTS, _NO_RANK, np.int32)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), _slot(keys).tolist(), strict=True)):
            while self.key[slot] >= 0 and self.key[slot] != key:
                slot = (slot + 1) % _SLOTS
            if self.key[slot] < 0:
                self.key[slot], self.rank[slot] = key, rank

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of symbols, _NO_RANK where they don't merge."""
        keys = left.astype(np.int64) << 20 | right
        slot = _slot(keys)
        found = self.key[slot]
        out = np.where(found == keys, self.rank[slot], _NO_RANK)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % _SLOTS
            found = self.key[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.rank[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def merge(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of the word parts of data that begin at start and have size bytes, one after the other."""
        counts, done = np.ones(len(start), np.int64), []
        order = np.argsort(size, kind="stable")
        cut = np.searchsorted(size[order], np.arange(LONGEST + 2))
        row, symbols, rank = np.zeros(0, np.int64), np.zeros((0, 0), np.int32), np.zeros((0, 0), np.int32)
        for width in range(int(size.max(initial=0)), 0, -1):
            new = order[cut[width] : cut[width + 1]]
            if len(new):
                raw = data[start[new][:, None] + np.arange(width)]
                fresh = self.inner[raw]
                fresh[:, -1] = self.last[raw[:, -1]]
                pairs = self.ranks(fresh[:, :-1].reshape(-1), fresh[:, 1:].reshape(-1)).reshape(len(new), width - 1)
                row, symbols, rank = (np.concatenate([a, b]) if len(a) else b for a, b in ((row, new), (symbols, fresh), (rank, pairs)))
            if not len(row):
                continue
            at = rank.argmin(axis=1) if width > 1 else np.zeros(len(row), np.int64)
            best = rank[np.arange(len(row)), at] if width > 1 else np.full(len(row), _NO_RANK)
            stop = best == _NO_RANK
            if stop.any():
                counts[row[stop]] = width
                done.append((row[stop], symbols[stop]))
                go = ~stop
                row, symbols, rank, at, best = row[go], symbols[go], rank[go], at[go], best[go]
            n = len(row)
            if not n:
                symbols, rank = np.zeros((0, width - 1), np.int32), np.zeros((0, max(width - 2, 0)), np.int32)
                continue
            here = np.arange(n)
            symbols[here, at] = self.merged[best]
            keep = np.ones(symbols.shape, bool)
            keep[here, at + 1] = False
            symbols = symbols[keep].reshape(n, width - 1)
            rank = rank[keep[:, 1:]].reshape(n, width - 2)
            before = np.flatnonzero(at > 0)
            rank[before, at[before] - 1] = self.ranks(symbols[before, at[before] - 1], symbols[before, at[before]])
            after = np.flatnonzero(at < width - 2)
            rank[after, at[after]] = self.ranks(symbols[after, at[after]], symbols[after, at[after] + 1])
        ends = np.cumsum(counts)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
        for rows, values in done:
            out[(ends - counts)[rows][:, None] + np.arange(values.shape[1])] = values
        return out, counts

    def classes(self, blob: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(kind, lowered bytes, odd) of UTF-8 bytes; odd marks bytes of words that only the library can take."""
        kind, data = _KIND[blob], _LOWER[blob]
        odd = ((kind == BREAK) & (blob != 10) & (blob != 32)) | (blob == 39)
        odd[:-1] |= (blob[:-1] == 60) & (blob[1:] == 124)
        # Two-byte characters from 00C0 to 00FF but for the signs of times and division are letters.
        high = np.flatnonzero(blob >= 128)
        if len(high):
            after = blob[np.minimum(high + 1, len(blob) - 1)]
            lead = high[(blob[high] == 0xC3) & (after >= 128) & (after != 0x97) & (after != 0xB7)]
            odd[high] = True
            odd[lead] = odd[lead + 1] = False
            kind[lead] = kind[lead + 1] = LETTER
            data[lead[data[lead + 1] < 0x9F] + 1] += 32
        return kind, data, odd

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, in UTF-8, as little-endian 32-bit integers.  Words hold no space or line end and aren't empty."""
        if not words:
            return []
        if not self.known:
            return self._by_library(words)
        blob = np.frombuffer(b"\n".join(words) + b"\n", np.uint8)
        kind, data, odd = self.classes(blob)
        ends = np.flatnonzero(blob == 10)
        new = np.ones(len(blob), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        start = np.flatnonzero(new & (blob != 10))
        size = np.diff(np.append(np.flatnonzero(new), len(blob)))[(blob != 10)[new]]
        word = np.searchsorted(ends, start)
        strange = np.zeros(len(words), bool)
        strange[np.searchsorted(ends, np.flatnonzero(odd))] = True
        strange[word[size > LONGEST]] = True
        mine = ~strange[word]
        ids, counts = self.merge(data, start[mine], size[mine])
        per_word = np.bincount(word[mine], counts, minlength=len(words)).astype(np.int64)
        packed, to = ids.astype("<u4").tobytes(), (np.cumsum(per_word) * 4).tolist()
        out, at = [], 0
        for end in to:
            out.append(packed[at:end])
            at = end
        rest = np.flatnonzero(strange).tolist()
        for k, ids_ in zip(rest, self._by_library([words[k] for k in rest]), strict=True):
            out[k] = ids_
        return out

    def _by_library(self, words: list[bytes]) -> list[bytes]:
        texts = [w.decode("utf-8") for w in words]
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]


class TextEncoder:
    """Encodes slices of texts, keeping what it has met, in about 100 MB at most."""

    def __init__(self, path: str):
        self.bpe = _tokenizer(path)
        self.long: dict[bytes, bytes] = {}
        self.clear()

    def clear(self) -> None:
        slots = 1 << TABLE_BITS
        self.entry = np.full(slots, -1, np.int32)
        self.keys = np.zeros((2, MOST_ENTRIES), U64)
        self.start, self.count, self.n = np.zeros(MOST_ENTRIES + 1, np.int64), np.zeros(MOST_ENTRIES, np.int64), 0
        self.pool, self.used = np.zeros(1 << 20, np.int32), 0

    def add(self, ids: np.ndarray) -> int:
        """Put ids at the end of the pool; where they begin."""
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.int32)])
        self.pool[at : self.used] = ids
        return at

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 where there is none."""
        slot = _table_slot(a, b)
        out = self.entry.take(slot)
        open_ = np.flatnonzero((out >= 0) & ((self.keys[0].take(out) != a) | (self.keys[1].take(out) != b)))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << TABLE_BITS) - 1)
            e = self.entry.take(slot[open_])
            out[open_] = e
            open_ = open_[(e >= 0) & ((self.keys[0].take(e) != a[open_]) | (self.keys[1].take(e) != b[open_]))]
        return out

    def insert(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Add distinct keys that aren't there, with their ids one after the other."""
        m, begin = len(a), self.add(ids)
        new = np.arange(self.n, self.n + m, dtype=np.int32)
        self.keys[0, new], self.keys[1, new] = a, b
        self.start[new], self.count[new] = begin + np.cumsum(counts) - counts, counts
        self.n += m
        slot = _table_slot(a, b)
        todo = np.arange(m)
        while len(todo):
            free = todo[self.entry[slot[todo]] < 0]
            self.entry[slot[free]] = new[free]
            todo = todo[self.entry[slot[todo]] != new[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << TABLE_BITS) - 1)

    def encode(self, blob: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of the texts that stand one after the other in blob, and where each text's end."""
        texts = len(offsets) - 1
        if not len(blob):
            return np.zeros(0, np.int32), np.zeros(texts, np.int64)
        kind, data, odd = self.bpe.classes(blob)
        if not self.bpe.known:
            odd = kind != BREAK
        fresh = np.zeros(len(blob) + 1, bool)
        fresh[offsets] = True
        gap = (blob == 32) | (blob == 10)
        if odd.any():
            # All of an odd word, from one gap or text's beginning to the next, is one part.
            edge = np.flatnonzero(gap | fresh[:-1])
            where = np.unique(np.searchsorted(edge, np.flatnonzero(odd), "right") - 1)
            first = np.where(where >= 0, edge[where], 0)
            stop = np.append(edge, len(blob))[where + 1]
            change = np.zeros(len(blob) + 1, np.int8)
            np.add.at(change, first, 1)
            np.add.at(change, stop, -1)
            kind[(np.cumsum(change[:-1], dtype=np.int8) > 0) & ~gap] = ODD
        new = fresh[:-1] | (kind == DIGIT)
        new[1:] |= kind[1:] != kind[:-1]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(blob)))
        word = ~gap[start]
        start, size = start[word], size[word]
        short = (size <= SHORT) & (kind[start] != ODD)
        if self.n + int(short.sum()) > MOST_ENTRIES or self.used > 16 * MOST_ENTRIES:
            self.clear()
        count, place = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        s, n = (start, size) if short.all() else (start[short], size[short])
        loads = np.lib.stride_tricks.as_strided(np.concatenate([data, np.zeros(SHORT, np.uint8)]).view(), (len(data) + SHORT - 7, 8), (1, 1))
        a = loads[s].view("<u8").reshape(-1) & _MASK.take(np.minimum(n, 8))
        b = loads[np.minimum(s + 8, len(data))].view("<u8").reshape(-1) & _MASK.take(np.maximum(n - 8, 0))
        entry = self.look_up(a, b)
        missing = np.flatnonzero(entry < 0)
        for lo in range(0, len(missing), MOST_ENTRIES // 2):
            part = missing[lo : lo + MOST_ENTRIES // 2]
            order = part[np.lexsort((b[part], a[part]))]
            distinct = order[np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]]
            if lo:
                distinct = distinct[self.look_up(a[distinct], b[distinct]) < 0]
            self.insert(a[distinct], b[distinct], *self.bpe.merge(data, s[distinct], n[distinct]))
            entry[part] = self.look_up(a[part], b[part])
        count[short], place[short] = self.count.take(entry), self.start.take(entry)
        slow = np.flatnonzero(~short)
        if len(slow):
            words = [blob[x:y].tobytes() for x, y in zip(start[slow].tolist(), (start + size)[slow].tolist(), strict=True)]
            unknown = list(dict.fromkeys(w for w in words if w not in self.long))
            if len(self.long) + len(unknown) > MOST_LONG:
                self.long.clear()
                unknown = list(dict.fromkeys(words))
            self.long.update(zip(unknown, self.bpe.encode(unknown), strict=True))
            got = [self.long[w] for w in words]
            used = self.used
            sizes = np.array([len(g) // 4 for g in got])
            place[slow] = self.add(np.frombuffer(b"".join(got), "<u4").astype(np.int32)) + np.cumsum(sizes) - sizes
            count[slow] = sizes
            self.used = used  # they are only kept for this slice
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool.take(np.repeat(place - (ends - count), count) + np.arange(total))
        parts = np.searchsorted(start, offsets[1:])
        return ids, np.where(parts > 0, np.append(ends, 0)[parts - 1], 0)


def _table_slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * U64(0x9E3779B97F4A7C15)
    h ^= h >> U64(32)
    h += b
    h *= U64(0xD1342543DE82EF95)
    return (h >> U64(64 - TABLE_BITS)).astype(np.int64)


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> WordBpe:
    """The tokenizer, one for all tasks of a Python worker."""
    return WordBpe(path)


@lru_cache(maxsize=1)
def text_encoder(path: str) -> TextEncoder:
    """An encoder for all tasks of a Python worker, which run one after the other."""
    return TextEncoder(path)
