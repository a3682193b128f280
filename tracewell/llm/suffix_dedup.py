"""Removal of repeated passages by prefix-free parsing, over all documents' bytes.

Rolling-hash triggers cut every document into phrases.  A trigger is the least hash of a short
gram within a window of LENGTH bytes, so equal windows have the same trigger at the same place,
and neighbouring phrases overlap by LENGTH - 1 bytes: every window of LENGTH bytes lies in
exactly one phrase.  Distinct phrases are the dictionary, their occurrences the parse.

A suffix of the corpus is followed by an equal suffix, up to LENGTH bytes, in two cases only: its
phrase occurs again in the parse, or the suffix of its phrase equals one of another phrase of the
dictionary.  The overlap makes the first LENGTH bytes of every suffix lie in its phrase, so the
suffix array of the dictionary, to a depth of LENGTH bytes, and the counts of the parse decide all of
the corpus order that is needed.

* The parse is ranked by phrase names, dealt by name; a batch folds its own repeats first.  Names are
  64-bit hashes, whatever the trigger, and aren't compared byte by byte.
* Phrases of one trigger meet in a task, which sorts their suffixes by prefix doubling, on bytes, a few
  triggers at a time, as equal windows have one trigger.
* A trigger with very many phrases, as round a passage that many documents share, is not gathered:
  its windows of LENGTH bytes are dealt by their own hashes and ranked like phrases.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .shared import discard, fresh, materialize, sized, small_batches

LENGTH = 200
#: Bytes of a trigger; a window holds LENGTH - GRAM + 1 of them.
GRAM = 40
#: Phrase occurrences of a task, on average.
TASK_PHRASES = 200_000
#: Distinct phrases of a trigger beyond which they aren't gathered in one task.
HOT_PHRASES = 4_096
#: Bytes of whole triggers' phrases whose suffixes a task sorts at a time; sorting takes some 90 bytes for each.
COMPARED_BYTES = 1 << 19
#: A text is parsed in pieces of so many window starts, which bounds memory and positions in a key.
PIECE = 1 << 22
_POSITION = tb.U64((1 << 24) - 1)


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of width values, from prefix and suffix minima of blocks."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, ~tb.U64(0), tb.U64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def phrases(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first, last, trigger, name) of the phrases of rows in data.

    first and last are the window starts a phrase covers, as places in its row; its bytes end
    LENGTH after last.  trigger and name are hashes of the trigger and of the whole phrase.
    """
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none.astype(tb.U64), none.astype(tb.U64)
    prefix = tb.prefix_hash(data, tb.BYTE_VALUES)
    grams = len(data) - GRAM + 1
    h = tb.mixed((prefix[GRAM:] - prefix[:-GRAM]) * tb.powers(grams)[1])
    key = (h & ~_POSITION) | np.arange(grams, dtype=tb.U64)
    at = (sliding_minimum(key, LENGTH - GRAM + 1) & _POSITION).astype(np.int64)
    # A window that crosses the end of its row is none.
    valid = np.ones(len(at), bool)
    for end in offsets[1:-1]:
        valid[max(int(end) - LENGTH + 1, 0) : int(end)] = False
    new = valid.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new)
    stop = np.flatnonzero(valid & np.r_[~valid[1:] | new[1:], True])
    name = tb.span_hashes(prefix, first, stop + LENGTH)
    row = np.searchsorted(offsets, first, "right") - 1
    return row, first - offsets[row], stop - offsets[row], h[at[first]], name


def parse_batch(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """phrases() of any number of rows, a slice or a piece of a long row at a time."""
    found = []
    for lo, hi in tb.slices(offsets):
        part = offsets[lo : hi + 1]
        base, end = int(part[0]), int(part[-1])
        if hi - lo == 1 and end - base > PIECE:
            for c in range(base, end - LENGTH + 1, PIECE):
                e = min(c + PIECE + LENGTH - 1, end)
                row, a, b, t, n = phrases(data[c:e], np.array([0, e - c]))
                found.append((row + lo, a + (c - base), b + (c - base), t, n))
        else:
            row, a, b, t, n = phrases(data[base:end], part - base)
            found.append((row + lo, a, b, t, n))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else phrases(np.zeros(0, np.uint8), np.zeros(1, np.int64))


def joined_ranges(key: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of a key that touch or overlap, as one; needs no order."""
    order = np.lexsort((first, key))
    key, first, last = key[order], first[order], last[order]
    if not len(key):
        return key, first, last
    new = np.r_[True, (key[1:] != key[:-1]) | (first[1:] > last[:-1] + 1)]
    at = np.flatnonzero(new)
    return key[at], first[at], np.maximum.reduceat(last, at)


_COLUMNS = (np.int64, np.int32, np.int32, np.uint64, np.uint64, np.bool_)


def suffix_ranks(blob: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The rank of the LENGTH bytes of blob from each start, in byte order; 0 for those that no other start has.

    Prefix doubling: ranks of 8 bytes give those of 16, and so on; a place whose bytes are alone drops out.
    """
    n = len(blob) - 7
    rank = np.zeros(max(n, 0) + LENGTH, np.int64)
    wide = np.zeros(n, tb.U64)
    for k in range(8):
        wide = wide << tb.U64(8) | blob[k : k + n]
    alive, key = np.arange(n), wide
    size = 8
    while True:
        _, at, times = np.unique(key, return_inverse=True, return_counts=True)
        many = times[at] > 1
        ranks = np.zeros(len(rank), np.int64)
        ranks[alive[many]] = at[many] + 1
        rank = ranks
        if size == LENGTH:
            return rank[starts]
        step = min(size, LENGTH - size)
        alive = alive[many]
        if size + step == LENGTH:
            alive = np.intersect1d(alive, starts, assume_unique=True)
        alive = alive[rank[alive + step] > 0]
        key = rank[alive] << 32 | rank[alive + step]
        size += step


def whole_triggers(trigger: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """The places of phrases by trigger, whole triggers at a time; a group but its last trigger has under COMPARED_BYTES."""
    order = np.argsort(trigger, kind="stable")
    before = np.cumsum(size[order]) - size[order]
    new = np.flatnonzero(np.r_[True, trigger[order][1:] != trigger[order][:-1]]) if len(order) else np.zeros(0, np.int64)
    part = before[new] // COMPARED_BYTES
    cuts = new[np.flatnonzero(np.r_[True, part[1:] != part[:-1]])] if len(new) else new
    for lo, hi in zip(cuts, np.r_[cuts[1:], len(order)], strict=False):
        yield order[lo:hi]


def window_marks(docs: DataFrame, key: str, text_bytes: int) -> tuple[DataFrame, list[DataFrame]]:
    """((key, first, last), tables): ranges of window starts whose windows also start somewhere else, and what they are read from."""
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism * 2, -(-text_bytes // (80 * TASK_PHRASES)))
    whole = "task int, key binary, first binary, last binary, trigger binary, name binary, twice binary"
    ranges = "key long, first int, last int, trigger long, kind int"

    def dealt(key, first, last, trigger, name, twice) -> pa.RecordBatch:
        """A batch's phrases for the tasks of their names: those that it has twice are marked, and one of each goes on."""
        order = np.argsort(name, kind="stable")
        sorted_name = name[order]
        new = np.r_[True, sorted_name[1:] != sorted_name[:-1]] if len(name) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        again, known = np.zeros(len(name), bool), np.zeros(len(name), bool)
        if len(name):
            again[order] = (np.bincount(group) > 1)[group]
            known[order] = np.bincount(group, twice[order]).astype(bool)[group]
        leader = np.zeros(len(name), bool)
        leader[order] = new
        todo = again & ~twice
        marked = joined_ranges(key[todo], first[todo], last[todo])
        twice = again | known
        key, first, last, trigger, name, twice = (x[leader] for x in (key, first, last, trigger, name, twice))
        task = (name % tb.U64(tasks)).astype(np.int32)
        order = np.argsort(task, kind="stable")
        task = task[order]
        cuts = np.flatnonzero(np.r_[True, task[1:] != task[:-1]]) if len(task) else np.zeros(0, np.int64)
        ends = np.r_[cuts[1:], len(task)]
        parts = [np.ascontiguousarray(x[order].astype(kind)) for x, kind in zip((key, first, last, trigger, name, twice), _COLUMNS, strict=True)]
        out = [task[cuts].tolist(), *([x[a:b].tobytes() for a, b in zip(cuts, ends, strict=False)] for x in parts)]
        if len(marked[0]):
            out[0].append(int(np.uint64(marked[0][0].view(np.uint64)) % np.uint64(tasks)))
            for k in range(6):
                out[k + 1].append(marked[k].astype(_COLUMNS[k]).tobytes() if k < 3 else b"")
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], ["task", "key", "first", "last", "trigger", "name", "twice"])

    @tb.released
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, first, last, trigger, name = parse_batch(*tb.buffers(batch.column(1)))
            yield dealt(batch.column(0).to_numpy()[row], first, last, trigger, name, np.zeros(len(name), bool))

    @tb.released
    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pieces in by_task(batches):
            held = []
            for parts in pieces:
                columns = [np.frombuffer(p, kind) for p, kind in zip(parts, _COLUMNS, strict=True)]
                if parts[0] and not parts[3]:
                    yield from rows(*columns[:3], None, 0)
                else:
                    held.append(columns)
            if not held:
                continue
            key, first, last, trigger, name, twice = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(name, kind="stable")
            key, first, last, trigger, name, twice = (x[order] for x in (key, first, last, trigger, name, twice))
            if not len(key):
                continue
            new = np.r_[True, name[1:] != name[:-1]]
            phrase = np.cumsum(new) - 1
            again = (np.bincount(phrase) > 1)[phrase] | np.bincount(phrase, twice).astype(bool)[phrase]
            todo = again & ~twice
            yield from rows(*joined_ranges(key[todo], first[todo], last[todo]), None, 0)
            yield from rows(key[new], first[new], last[new], trigger[new].view(np.int64), np.where(again[new], 2, 1))

    def rows(key, first, last, trigger, kind) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(key), 50_000):
            cut = slice(a, a + 50_000)
            n = len(key[cut])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key[cut]), pa.array(first[cut].astype(np.int32)), pa.array(last[cut].astype(np.int32)),
                    pa.array(np.zeros(n, np.int64) if trigger is None else trigger[cut]),
                    pa.array((np.full(n, kind) if np.isscalar(kind) else kind[cut]).astype(np.int32)),
                ],
                ["key", "first", "last", "trigger", "kind"],
            )

    def gathered(df: DataFrame) -> DataFrame:
        return df.repartition(tasks, "task").sortWithinPartitions("task")

    parsed = docs.select(key, "text").mapInArrow(parse, whole)
    ranked = materialize(gathered(parsed).mapInArrow(rank, ranges), "suffix-ranked")

    # The dictionary's suffixes: of triggers with several phrases, each phrase once, with its bytes.
    dictionary = ranked.where("kind > 0")
    several = materialize(dictionary.groupBy("trigger").agg(F.count("*").alias("phrases")).where("phrases > 1"), "suffix-triggers")
    hot = several.where(F.col("phrases") > HOT_PHRASES).select("trigger")
    some_hot = not hot.isEmpty()
    cold = several.where(F.col("phrases") <= HOT_PHRASES).select("trigger")
    alike = dictionary.join(sized(hot, 16), "trigger", "left_anti") if some_hot else dictionary
    alike = alike.join(sized(cold, 16), "trigger")

    def with_texts(phrases_: DataFrame) -> DataFrame:
        wanted = phrases_.groupBy(F.col("key").alias("span_key")).agg(F.collect_list(F.struct("first", "last", "trigger", "kind")).alias("spans"))
        return docs.select(F.col(key).alias("key"), "text").join(wanted, F.col("key") == F.col("span_key")).select("key", "text", "spans")

    @tb.released
    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.buffers(batch.column(1))
            keys = batch.column(0).to_numpy()
            row, a, b, trigger, kind = spans_of(batch.column(2))
            task = (trigger.view(np.uint64) % np.uint64(tasks)).astype(np.int32)
            order = np.argsort(task, kind="stable")
            task, a, b, trigger, kind, row = task[order], a[order], b[order], trigger[order], kind[order], row[order]
            cuts = np.flatnonzero(np.r_[True, task[1:] != task[:-1]]) if len(task) else np.zeros(0, np.int64)
            ends = np.r_[cuts[1:], len(task)]
            text = data.tobytes() if len(data) < (1 << 20) else memoryview(data)
            blobs = []
            for x, y in zip(cuts, ends, strict=False):
                blobs.append(b"".join(bytes(text[offsets[row[i]] + a[i] : offsets[row[i]] + b[i] + LENGTH]) for i in range(x, y)))
            column = lambda v, kind_: pa.array([np.ascontiguousarray(v[x:y].astype(kind_)).tobytes() for x, y in zip(cuts, ends, strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(task[cuts]), column(keys[row], np.int64), column(a, np.int32), column(b - a, np.int32), column(kind, np.int8), column(trigger, np.int64), pa.array(blobs, pa.binary())],
                ["task", "key", "first", "reach", "kind", "trigger", "bytes"],
            )

    @tb.released
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pieces in by_task(batches):
            k, a, reach, kind, trigger = (np.concatenate([np.frombuffer(p[c], t) for p in pieces]) for c, t in enumerate((np.int64, np.int32, np.int32, np.int8, np.int64)))
            text = memoryview(b"".join(p[5] for p in pieces))
            pieces.clear()
            end = np.cumsum(reach.astype(np.int64) + LENGTH)
            for mine in whole_triggers(trigger, reach.astype(np.int64) + LENGTH):
                blob = np.frombuffer(b"".join(text[end[i] - reach[i] - LENGTH : end[i]] for i in mine), np.uint8)
                n = reach[mine].astype(np.int64) + 1
                which = np.repeat(mine, n)
                inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                begin = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
                same = (suffix_ranks(blob, np.repeat(begin, n) + inside) > 0) & (kind[which] == 1)
                which, start = which[same], (a[which] + inside)[same]
                yield from rows(*joined_ranges(k[which], start, start), None, 0)

    pieces = with_texts(alike).mapInArrow(cut_out, "task int, key binary, first binary, reach binary, kind binary, trigger binary, bytes binary")
    marks = ranked.where("kind = 0").select("key", "first", "last")
    marks = marks.union(gathered(pieces).mapInArrow(compare, ranges).select("key", "first", "last"))
    if not some_hot:
        return marks, [ranked, several]

    @tb.released
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.buffers(batch.column(1))
            keys = batch.column(0).to_numpy()
            row, a, b, _, kind = spans_of(batch.column(2))
            n = b - a + 1
            start = np.repeat(a, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            row, kind = np.repeat(row, n), np.repeat(kind, n)
            name = np.zeros(len(start), tb.U64)
            for lo, hi in tb.slices(offsets):
                mine = (row >= lo) & (row < hi)
                prefix = tb.prefix_hash(data[offsets[lo] : offsets[hi]], tb.BYTE_VALUES)
                at = offsets[row[mine]] - offsets[lo] + start[mine]
                name[mine] = tb.span_hashes(prefix, at, at + LENGTH)
            yield dealt(keys[row], start, start, name, name, kind == 2)

    shared = with_texts(dictionary.join(sized(hot, 16), "trigger", "left_semi")).mapInArrow(windows, whole)
    return marks.union(gathered(shared).mapInArrow(rank, ranges).where("kind = 0").select("key", "first", "last")), [ranked, several]


def spans_of(column: pa.Array) -> tuple[np.ndarray, ...]:
    """(row, first, last, trigger, kind) of the spans of a batch's rows."""
    flat = column.flatten()
    first, last, trigger, kind = (flat.field(i).to_numpy() for i in range(4))
    row = np.repeat(np.arange(len(column)), pa.compute.list_value_length(column).to_numpy())
    return row, first.astype(np.int64), last.astype(np.int64), trigger, kind


def by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list]]]:
    """(task, rows without it) of rows sorted by task; one task's rows are held at a time."""
    held: list[list] = []
    at = None
    for batch in batches:
        for task, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if task != at and held:
                yield at, held
                held = []
            at = task
            held.append(parts)
    if held:
        yield at, held


def marked_documents(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column of the ranges of its windows that start elsewhere too (null: none), and its name.

    Rows of equal doc_id and text, and only those, go together.
    """
    key, marks_name = fresh(docs, "text_key"), fresh(docs, "text_marks")
    keyed = small_batches(docs).withColumn(key, F.xxhash64("doc_id", "text", F.lit(LENGTH)))
    text_bytes = keyed.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    found, between = window_marks(keyed, key, text_bytes)
    marks = materialize(found.groupBy(F.col("key").alias("mark_key")).agg(F.collect_list(F.struct("first", "last")).alias("found")), "suffix-marks")
    discard(*between)
    joined = keyed.join(marks, keyed[key] == marks["mark_key"], "left")
    return joined.select(*(keyed[c] for c in docs.columns), marks["found"].alias(marks_name)), marks_name


def removed_spans(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans [start, end) that windows starting in the ranges cover, maximal and in order."""
    order = np.argsort(first, kind="stable")
    start, end = first[order].astype(np.int64), last[order].astype(np.int64) + LENGTH
    reach = np.maximum.accumulate(end)
    new = np.r_[True, start[1:] > reach[:-1]]
    at = np.flatnonzero(new)
    return start[at], reach[np.r_[at[1:] - 1, len(reach) - 1]]


def _spans(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    flat, sizes = column.flatten(), pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy()
    first, last = flat.field(0).to_numpy(), flat.field(1).to_numpy()
    ends = np.cumsum(sizes)
    for n, e in zip(sizes, ends, strict=True):
        yield removed_spans(first[e - n : e], last[e - n : e]) if n else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), a row for each row of docs.

    Bytes that a LENGTH-byte string covers which also starts anywhere else are removed.  Null texts
    count as empty, texts under LENGTH bytes keep everything, rows that repeat a whole row are
    copies of each other.  Extra columns are ignored; no rows give no rows.
    """

    @tb.released
    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.buffers(batch.column(1))
            removed, count, sha = [], [], []
            view = memoryview(data)
            for i, (a, b) in enumerate(_spans(batch.column(2))):
                lo, hi = int(offsets[i]), int(offsets[i + 1])
                kept, at = hashlib.sha256(), lo
                for x, y in zip(a, b, strict=True):
                    kept.update(view[at : lo + int(x)])
                    at = lo + int(y)
                kept.update(view[at:hi])
                removed.append(int((b - a).sum())), count.append(len(a)), sha.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    marked, _ = marked_documents(docs.select(F.col("doc_id").cast("long"), "text"))
    return marked.mapInArrow(summarize, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs, all rows and columns, with repeated bytes cut out of text; n_chars, if any, follows.

    A character that loses a byte is dropped whole.  Null texts stay null.
    """
    marked, marks = marked_documents(docs)

    @tb.released
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.buffers(batch.column("text"))
            whole, texts = memoryview(data), []
            missing = batch.column("text").is_null().to_pylist()
            for i, (a, b) in enumerate(_spans(batch.column(marks))):
                lo, at, kept = int(offsets[i]), int(offsets[i]), []
                for x, y in zip(a, b, strict=True):
                    kept.append(whole[at : lo + int(x)])
                    at = lo + int(y)
                kept.append(whole[at : int(offsets[i + 1])])
                texts.append(None if missing[i] else b"".join(kept).decode("utf-8", "ignore"))
            names = [n for n in batch.schema.names if n != marks]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names], names)

    out = marked.mapInArrow(remove, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
