"""N-gram Jaccard self-join by vertical partitioning of the global shingle order.

Documents are sets of hashed five-word shingles.  The global order puts frequent shingles last
and is otherwise the order of hashes.  It is cut into fragments twice:

* for candidates, each fragment is a task that holds the shingles of its range which lie in some
  document's prefix (the least shingles of which two similar sets must share one) and links every
  document of a posting list with the list's least document - a star, not all pairs;
* for overlaps, each candidate pair's sets are cut into fragments whose overlaps are counted
  apart, and the partial counts are summed per pair and held against the threshold.

A second round takes the posting lists whose documents are not yet in one component and counts
every pair of fitting sizes between different components, so that no link between components is
lost; the greatest component of a list never meets itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .shared import BROADCAST_LIMIT_BYTES, connected_components, materialize, sized, small_batches

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80
#: Bytes of a stored shingle, which is a 64-bit hash.
WIDTH = 8
#: Vertical fragments in which a pair's overlap is counted.
OVERLAP_FRAGMENTS = 4
#: Prefix shingles of a candidate fragment, on average.
FRAGMENT_SHINGLES = 500_000
#: Most frequent shingles that are known as such; others keep their hash order, results don't depend on it.
FREQUENT_LIMIT = 200_000
#: Shingles that are counted together on the way to the frequent ones.
COUNTED_SHINGLES = 2_000_000
#: Percent of the shorter prefix that a pair of the first round shares; others are left to the second.
STAR_PERCENT = 40
#: Ratio of sizes in one band; it has to be above that of two similar sets, which is 1.25.
SIZE_BAND = 1.3
#: Partners of a document that are compared in one group; more are split over several.
GROUP_PARTNERS = 200


def unpack(data: bytes) -> np.ndarray:
    """A packed set, sorted."""
    return np.frombuffer(data, "<u8")


def shingle_table(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, n, key_a, key_b, shingles): set size, 128 bits that name the set, the packed set."""

    @tb.released
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.buffers(batch.column(1))
            for lo, hi in tb.slices(offsets):
                part = offsets[lo : hi + 1]
                found = tb.shingle_sets(data[part[0] : part[-1]], part - part[0], size)
                key_a = [int(x.sum(dtype=np.uint64).view(np.int64)) for x in found]
                key_b = [int(tb.mixed(x ^ tb.U64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) for x in found]
                packed = [x.astype("<u8").tobytes() for x in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([len(x) for x in found], pa.int64()), pa.array(key_a, pa.int64()), pa.array(key_b, pa.int64()), pa.array(packed, pa.binary())],
                    ["doc_id", "n", "key_a", "key_b", "shingles"],
                )

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(sets, "doc_id long, n long, key_a long, key_b long, shingles binary")


def frequent_shingles(sets: DataFrame) -> np.ndarray:
    """The shingles known to be frequent, from least to most; FREQUENT_LIMIT of them at most.

    A task reports shingles that COUNTED_SHINGLES of them hold three times; reports are summed.
    This only steers the global order, which may be any order without changing a result.
    """

    @tb.released
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def report() -> pa.RecordBatch:
            found, times = np.unique(unpack(b"".join(held)), return_counts=True)
            often = times >= 3
            return pa.RecordBatch.from_arrays([pa.array(found[often].astype(np.int64)), pa.array(times[often].astype(np.int64))], ["shingle", "times"])

        for batch in batches:
            for x in batch.column(0):
                held.append(x.as_py())
                total += len(held[-1])
                if total > COUNTED_SHINGLES * WIDTH:
                    yield report()
                    held, total = [], 0
        if held:
            yield report()

    seen = sets.select("shingles").mapInArrow(counts, "shingle long, times long").groupBy("shingle").agg(F.sum("times").alias("times"))
    top = seen.where("times >= 32").orderBy(F.desc("times"), "shingle").limit(FREQUENT_LIMIT).toArrow()
    return top.column("shingle").to_numpy().astype(np.uint64)[::-1].copy()


def prefix_length(n: int) -> int:
    """Least shingles of a set of n of which a similar set shares one."""
    return n - (SIMILAR_PERCENT * n + 99) // 100 + 1


def prefix_size(n: str) -> Column:
    """prefix_length() of a column."""
    return F.col(n) - F.floor((SIMILAR_PERCENT * F.col(n) + 99) / 100) + 1


def prefix_fragments(sets: DataFrame, fragments: int) -> DataFrame:
    """(fragment, docs, sizes, tokens): packed prefix shingles by range of the hash."""
    spark = sets.sparkSession
    frequent = frequent_shingles(sets)
    by_value = np.argsort(frequent, kind="stable")
    known = spark.sparkContext.broadcast((frequent[by_value], by_value))

    @tb.released
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, ranks = known.value
        for batch in batches:
            docs, sizes, tokens = [], [], []
            for doc, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not n or doc is None:
                    continue
                s = unpack(data)
                if len(values):
                    at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                    often = values[at] == s
                    if often.any():
                        late = s[often][np.argsort(ranks[at[often]], kind="stable")]
                        s = np.concatenate([s[~often], late])
                s = s[: prefix_length(n)]
                tokens.append(s)
                docs.append(np.full(len(s), doc, np.int64))
                sizes.append(np.full(len(s), n, np.int32))
            if not tokens:
                continue
            t, d, z = map(np.concatenate, (tokens, docs, sizes))
            # Stored shingles are evenly spread, so fragments are ranges of their mixed values.
            f = (tb.mixed(t) % tb.U64(fragments)).astype(np.int32)
            order = np.argsort(f, kind="stable")
            f, t, d, z = f[order], t[order], d[order], z[order]
            edges = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
            ends = np.r_[edges[1:], len(f)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(f[edges]),
                    *(pa.array([x[a:b].tobytes() for a, b in zip(edges, ends, strict=True)], pa.binary()) for x in (d, z, t)),
                ],
                ["fragment", "docs", "sizes", "tokens"],
            )

    return sets.select("doc_id", "n", "shingles").mapInArrow(cut, "fragment int, docs binary, sizes binary, tokens binary")


def posting_lists(sets: DataFrame, fragments: int) -> DataFrame:
    """(token, doc, n, least): prefix shingles of two documents or more, with the list's least document."""

    @tb.released
    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for f, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(f, []).append(parts)
        for f in list(held):
            parts = held.pop(f)
            d, z, t = (np.concatenate([np.frombuffer(p[k], kind) for p in parts]) for k, kind in enumerate((np.int64, np.int32, np.uint64)))
            order = np.lexsort((d, t))
            d, z, t = d[order], z[order], t[order]
            begin = np.r_[True, t[1:] != t[:-1]] if len(t) else np.zeros(0, bool)
            group = np.cumsum(begin) - 1
            many = np.bincount(group)[group] > 1 if len(t) else begin
            least = d[np.flatnonzero(begin)][group] if len(t) else d
            for a in range(0, int(many.sum()), 100_000):
                pick = np.flatnonzero(many)[a : a + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t[pick].astype(np.int64)), pa.array(d[pick]), pa.array(z[pick]), pa.array(least[pick])], ["token", "doc", "n", "least"]
                )

    cut = prefix_fragments(sets, fragments).repartition(fragments, "fragment")
    return cut.mapInArrow(lists, "token long, doc long, n int, least long")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, overlap) of distinct pairs a < b, as sums of the overlaps counted in each fragment."""
    per = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP_PARTNERS).cast("int").alias("groups"))
    placed = pairs.join(per, "a").select("a", "b", F.pmod(F.hash("b"), F.col("groups")).alias("part"))
    wanted = placed.select("a", "part", F.col("b").alias("doc")).union(placed.select("a", "part", F.col("a").alias("doc")).distinct())
    wanted = materialize(wanted, "ngram-wanted")
    if 24 * wanted.count() <= BROADCAST_LIMIT_BYTES:
        wanted = F.broadcast(wanted)
    cut = (1 << 64) // OVERLAP_FRAGMENTS

    @tb.released
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.arange(1, OVERLAP_FRAGMENTS, dtype=np.uint64) * np.uint64(cut)
        for batch in batches:
            a, part, doc = (batch.column(i) for i in range(3))
            data = batch.column(3).to_pylist()
            parts: list[list[bytes]] = [[] for _ in range(OVERLAP_FRAGMENTS)]
            for x in data:
                at = [0, *(int(i) * WIDTH for i in np.searchsorted(unpack(x), bounds)), len(x)]
                for k in range(OVERLAP_FRAGMENTS):
                    parts[k].append(x[at[k] : at[k + 1]])
            for k in range(OVERLAP_FRAGMENTS):
                yield pa.RecordBatch.from_arrays([a, part, pa.array([k] * len(doc), pa.int32()), doc, pa.array(parts[k], pa.binary())], ["a", "part", "fragment", "doc", "segment"])

    @tb.released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mine = None, np.zeros(0, np.uint64)
        for batch in batches:
            out_a, out_b, out_n = [], [], []
            for a, part, f, doc, seg in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, part, f) != held:
                    held, mine = (a, part, f), unpack(seg)
                    continue
                theirs = unpack(seg)
                if len(mine) and len(theirs):
                    at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
                    n = int((mine[at] == theirs).sum())
                    out_a.append(a), out_b.append(doc), out_n.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64()), pa.array(out_n, pa.int64())], ["a", "b", "shared"])

    held = sets.select(F.col("doc_id").alias("doc"), "shingles").join(wanted, "doc").select("a", "part", "doc", "shingles")
    cuts = held.mapInArrow(segments, "a long, part int, fragment int, doc long, segment binary")
    # a < b, so a group's least document comes first.
    cuts = cuts.repartition("a", "part", "fragment").sortWithinPartitions("a", "part", "fragment", "doc")
    return cuts.mapInArrow(count, "a long, b long, shared long").groupBy("a", "b").agg(F.sum("shared").alias("overlap"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) among candidates whose Jaccard similarity reaches the threshold."""
    pairs = pairs.where("a < b and 100 * least(na, nb) >= %d * greatest(na, nb)" % SIMILAR_PERCENT)
    pairs = materialize(pairs.distinct(), "ngram-pairs")
    found = overlaps(pairs.select("a", "b"), sets).join(pairs, ["a", "b"])
    return found.where(f"100 * overlap >= {SIMILAR_PERCENT} * (na + nb - overlap)").select("a", "b")


def crossing_pairs(open_lists: DataFrame) -> DataFrame:
    """(a, b, na, nb) with a < b, a row for each list (token, doc, n, part) that holds both, of pairs from different parts whose sizes fit.

    A list's greatest part never meets itself: only documents outside it are one side of the join, so a
    list makes as many pairs as it has documents times those outside its greatest part.  Both sides meet
    by bands of size, of which sets that can be similar lie in one or in two next to each other.
    """
    counted = open_lists.groupBy("token", "part").agg(F.count("*").alias("docs"))
    greatest = counted.groupBy("token").agg(F.max_by("part", F.struct("docs", "part")).alias("main"))
    told = open_lists.join(greatest, "token").withColumn("band", F.floor(F.log("n") / math.log(SIZE_BAND)).cast("int"))
    x = told.select("token", F.col("doc").alias("x"), F.col("n").alias("nx"), F.col("part").alias("px"), (F.col("part") == F.col("main")).alias("inside"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    y = told.where("part <> main").select("token", F.col("doc").alias("y"), F.col("n").alias("ny"), F.col("part").alias("py"), "band")
    size_fits = 100 * F.least("nx", "ny") >= SIMILAR_PERCENT * F.greatest("nx", "ny")
    met = x.join(y, ["token", "band"]).where((F.col("px") != F.col("py")) & size_fits & (F.col("inside") | (F.col("x") < F.col("y"))))
    first = F.col("x") < F.col("y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(first, F.col("nx")).otherwise(F.col("ny")).alias("na"), F.when(first, F.col("ny")).otherwise(F.col("nx")).alias("nb"))


def similar_documents(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """Return (doc_id, n_shingles, component_id), a row for each row of docs.

    Two documents link at a Jaccard similarity of 80 % or more; component_id is the least doc_id
    reachable.  Null and empty texts have no shingles and are alone.  Documents with the same set
    are one candidate, the least doc_id, and its component is theirs.  Rows that repeat a doc_id
    are copies of one document if their sets agree, and are compared once; where they differ, each
    set is compared apart and the doc_id has the links of all.  Null doc_ids stay alone, with a null
    component.  Extra columns are ignored; no rows give no rows.
    """
    sets = materialize(shingle_table(docs, size).withColumn("row", F.monotonically_increasing_id()), "ngram-sets")
    total, filled, different = sets.agg(F.sum("n"), F.count("doc_id"), F.countDistinct("doc_id")).first()
    edges = linked_sets(sets, total or 0) if filled == different else links_of_repeated(sets, total or 0)
    final = connected_components(edges)
    return sets.join(final, sets["doc_id"] == final["node"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def links_of_repeated(sets: DataFrame, total: int) -> DataFrame:
    """linked_sets() of sets with repeated doc_ids: each set of a doc_id once, named by its row meanwhile."""
    named = sets.where("n > 0 and doc_id is not null")
    same = ["doc_id", "n", "key_a", "key_b"]
    narrow = named.select("row", *same)
    firsts = narrow.groupBy(*same).agg(F.min("row").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    surplus = materialize(narrow.join(firsts, same).where("row <> first").select("row"), "ngram-surplus")
    once = named.join(sized(surplus, 16), "row", "left_anti").select(F.col("row").alias("doc_id"), "n", "key_a", "key_b", "shingles")
    links = linked_sets(once, total)
    x = sets.select(F.col("row").alias("a"), F.col("doc_id").alias("doc_a"))
    y = sets.select(F.col("row").alias("b"), F.col("doc_id").alias("doc_b"))
    return links.join(x, "a").join(y, "b").select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))


def linked_sets(sets: DataFrame, total: int) -> DataFrame:
    """(a, b): links that connect similar sets, by doc_id, which has to be unique.  total is the sum of n."""
    spark = sets.sparkSession
    alike = sets.where("n > 0").groupBy("n", "key_a", "key_b").agg(F.min("doc_id").alias("chosen"), F.count("*").alias("copies"))
    alike = materialize(alike, "ngram-alike")
    copies = materialize(
        sets.where("n > 0").select("doc_id", "n", "key_a", "key_b").join(alike.where("copies > 1"), ["n", "key_a", "key_b"]).select("doc_id", "chosen"), "ngram-copies"
    )
    extra = copies.where("doc_id <> chosen").select("doc_id").distinct()
    if 16 * extra.count() <= BROADCAST_LIMIT_BYTES:
        extra = F.broadcast(extra)
    chosen = sets.where("n > 0 and doc_id is not null").join(extra, "doc_id", "left_anti")
    fragments = max(spark.sparkContext.defaultParallelism * 2, -(-int(total) // (5 * FRAGMENT_SHINGLES)))
    lists = materialize(posting_lists(chosen, fragments), "ngram-lists")
    sizes = lists.where("doc = least").select(F.col("doc").alias("a"), F.col("n").alias("na")).distinct()
    star = lists.where("doc <> least").groupBy(F.col("least").alias("a"), F.col("doc").alias("b"), F.col("n").alias("nb")).agg(F.count("*").alias("shared"))
    # Stars only have to bring most groups together, so they are tried where a link is likely.
    likely = F.col("shared") * 100 >= STAR_PERCENT * F.least(prefix_size("na"), prefix_size("nb"))
    links = materialize(verified(star.join(sizes, "a").where(likely).select("a", "b", "na", "nb"), sets), "ngram-links")
    parts = materialize(connected_components(links), "ngram-parts")
    known = lists.join(parts, lists["doc"] == parts["node"], "left").select("token", "doc", "n", F.coalesce("component", "doc").alias("part"))
    mixed_lists = known.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("token")
    open_lists = materialize(known.join(mixed_lists, "token"), "ngram-open")
    across = crossing_pairs(open_lists)
    # Of the set whose prefix ends first, every shared prefix shingle is in the other's prefix too, so
    # what both prefixes share and the rest of that set bound the overlap.
    shared = across.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))
    most = F.greatest(F.col("na") - prefix_size("na"), F.col("nb") - prefix_size("nb")) + F.col("shared")
    across = shared.where((100 + SIMILAR_PERCENT) * most >= SIMILAR_PERCENT * (F.col("na") + F.col("nb"))).select("a", "b", "na", "nb")
    more = materialize(verified(across, sets), "ngram-more")
    return links.union(more).union(copies.where("doc_id <> chosen").select("chosen", "doc_id"))
