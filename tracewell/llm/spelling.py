"""Spelling variant grouping: words at one edit, found by a relational trie frontier.

The words and their reversals form two tries, kept as a distributed edge table: a row (back, level, node,
kids) for each prefix, with the letters that follow it ("" where a word ends).  A state (word, position, node,
edits) says that the word up to position has been led to node with so many edits.  Level by level all states meet the edge
table in one join: they follow their own letter, or spend their edit on another letter or an
inserted one.  A state with one edit whose word and node both end is a pair of neighbours.

Of two words at one edit, either the first half of the shorter one stands at the start of both, or its last half at the end of
both.  States therefore start at their own first half (in the trie of reversals at their last half), where
tries are thin, rather than all at the root.  Nodes are prefixes, so nothing is decided by hashes; a node has at
most as many kids as the alphabet has letters.  Levels go to LEVELS; pairs with a longer word
meet on hashes of their spellings without one letter, one row a letter, and are compared letter by letter.

Null texts and doc_ids count as empty ones.  Rows with one doc_id are documents of their own, whose runs change alike.
An empty table, or one without such words, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .shared import discard, materialize

#: Letters of the runs once A-Z are lower-cased.
LETTERS = r"a-zÀ-ÿ"
#: A run loses one letter where this divides its checksum.
DAMAGE = 199
LEAST_LETTERS, LEAST_TIMES = 6, 5
#: A form is at least so many times as frequent as its word.
FORM_TIMES = 5
#: Depth of the tries.
LEVELS = 32
_START = LEAST_LETTERS // 2


def dictionary(docs: DataFrame) -> DataFrame:
    """(word, n): the words of at least LEAST_LETTERS letters that stand at least LEAST_TIMES times in docs.

    A damaged run only gets shorter, so shorter runs than that are never made.
    """
    text = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{LEAST_LETTERS},}}"), F.lit(0))).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run")))
    at = F.expr("cast(h % char_length(run) AS int)")
    word = F.when(F.col("h") % DAMAGE == 0, F.concat(F.substring("run", F.lit(1), at), F.expr("substring(run, cast(h % char_length(run) AS int) + 2)"))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.char_length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_TIMES)


def both_ways(words: DataFrame) -> DataFrame:
    """(back, word): each word, and its reversal with back set."""
    return words.select(F.explode(F.array(F.struct(F.lit(False).alias("back"), "word"), F.struct(F.lit(True).alias("back"), F.reverse("word").alias("word")))).alias("x")).select("x.back", "x.word")


def edge_table(spelled: DataFrame) -> DataFrame:
    """(back, node, kids, level) of every prefix from level _START on, written by level."""
    places = spelled.select("back", "word", F.explode(F.sequence(F.lit(_START), F.char_length("word"))).alias("level"))
    edges = places.select("back", "level", F.expr("substring(word, 1, level)").alias("node"), F.expr("substring(word, level + 1, 1)").alias("kid"))
    return materialize(edges.groupBy("level", "back", "node").agg(F.collect_set("kid").alias("kids")), "spelling-edges", by="level")


def stepped(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The states that follow states over edges of their level; edits is 2 for pairs that are found, with node the other word.

    Words are only changed to later letters or made longer, as each pair is found from its other
    word else.  An inserted letter never equals the one it stands before, so each pair comes once.
    """
    met = states.join(edges, ["back", "node"])
    met = met.withColumn("own", F.expr("substring(word, position + 1, 1)"))
    moves = """
        concat(
          if(own <> '' AND array_contains(kids, own), array(struct(position + 1 AS position, concat(node, own) AS node, edits AS edits)), array()),
          if(edits = 0 AND own <> '', transform(filter(kids, c -> c > own), c -> struct(position + 1 AS position, concat(node, c) AS node, 1 AS edits)), array()),
          if(edits = 0, transform(filter(kids, c -> c <> own AND c <> ''), c -> struct(position AS position, concat(node, c) AS node, 1 AS edits)), array()),
          if(edits = 1 AND own = '' AND array_contains(kids, ''), array(struct(position AS position, node AS node, 2 AS edits)), array()))"""
    return met.select("back", "word", F.explode(F.expr(moves)).alias("x")).select("back", "word", "x.position", "x.node", "x.edits")


def trie_pairs(words: DataFrame) -> DataFrame:
    """(a, b) of words of at most LEVELS letters at one edit, a pair once or more."""
    words = words.where(F.char_length("word") <= LEVELS).select("word")
    spelled = both_ways(words)
    edges = edge_table(spelled)
    half = F.expr("if(back, char_length(word) + 1, char_length(word)) div 2").cast("int")
    starts = spelled.select("back", "word", half.alias("position"), F.substring("word", F.lit(1), half).alias("node"), F.lit(0).alias("edits"))
    deepest = words.agg(F.max(F.char_length("word"))).first()[0] or 0
    found, states, old = None, None, []
    for level in range(_START, deepest + 1):
        entering = starts.where(F.col("position") == level)
        states = entering if states is None else states.where("edits < 2").union(entering)
        states = materialize(stepped(states, edges.where(F.col("level") == level).drop("level")), "spelling-frontier")
        old.append(states)
        here = states.where("edits = 2")
        found = here if found is None else found.union(here)
    if found is None:
        return words.select(F.col("word").alias("a"), F.col("word").alias("b")).limit(0)
    way = lambda c: F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c))
    pairs = materialize(found.select(way("word").alias("a"), way("node").alias("b")), "spelling-pairs")
    discard(edges, *old)
    return pairs


def long_pairs(words: DataFrame) -> DataFrame:
    """(a, b) of words at one edit of which one has more than LEVELS letters; b isn't the shorter one.

    A word gives a row (length, place, hash) for its spelling without each letter, and one for itself.
    """
    rows = materialize(words.where(F.char_length("word") >= LEVELS).select("word", F.monotonically_increasing_id().alias("id")), "spelling-long")

    def spellings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                letters = np.frombuffer(word.encode("utf-32-le"), np.uint32)
                n = len(letters)
                power, inverse = tb.powers(n + 1)
                sums = np.r_[np.zeros(1, tb.U64), np.cumsum(tb.mixed(letters.astype(tb.U64) + tb.U64(1)) * power[:n])]
                cut = sums[:-1] + (sums[-1] - sums[1:]) * inverse[1]
                hashes = np.r_[cut, sums[-1:]].view(np.int64)
                size, place = np.r_[np.full(n, n - 1), n].astype(np.int32), np.r_[np.arange(n), -1].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n + 1, i, np.int64)), pa.array(size), pa.array(place), pa.array(hashes)], ["id", "size", "place", "hash"])

    cuts = materialize(rows.mapInArrow(spellings, "id long, size int, place int, hash long"), "spelling-cuts")
    x, y = cuts.where("place >= 0").alias("x"), cuts.alias("y")
    changed = x.join(y, F.expr("x.size = y.size AND x.place = y.place AND x.hash = y.hash AND x.id < y.id")).select(F.col("x.id").alias("i"), F.col("y.id").alias("j"), F.col("x.place").alias("place"), F.lit(True).alias("same"))
    longer = cuts.where("place = -1").alias("x").join(x.alias("y"), F.expr("x.size = y.size AND x.hash = y.hash")).select(F.col("x.id").alias("i"), F.col("y.id").alias("j"), F.col("y.place").alias("place"), F.lit(False).alias("same"))
    some = changed.union(longer)
    some = some.join(rows.select(F.col("id").alias("i"), F.col("word").alias("a")), "i").join(rows.select(F.col("id").alias("j"), F.col("word").alias("b")), "j")
    cut = lambda c: F.expr(f"concat(substring({c}, 1, place), substring({c}, place + 2))")
    good = (F.col("a") != F.col("b")) & (F.when(F.col("same"), cut("a")).otherwise(F.col("a")) == cut("b")) & (F.greatest(F.char_length("a"), F.char_length("b")) > LEVELS)
    return some.where(good).select("a", "b")


def near_words(words: DataFrame) -> DataFrame:
    """(word, near) for each ordered pair of words (word) that differ by one inserted, deleted or replaced letter."""
    pairs = trie_pairs(words).union(long_pairs(words))
    return pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().select(F.col("a").alias("word"), F.col("b").alias("near"))


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): the last word that following forms leads to.

    A form is FORM_TIMES as frequent as its word, so there are no circles; each round doubles the steps taken.
    """
    state = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        moved = state.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved"))
        before, state = state, materialize(moved, "spelling-roots")
        discard(before)
        if not state.where("moved").take(1):
            return state.select("word", "root")


def grouped(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of docs (doc_id, text).

    form is the near word of largest n, the first in code-point order of several, if it is
    FORM_TIMES as frequent; n_near counts near words.
    """
    words = materialize(dictionary(docs), "spelling-words")
    near = near_words(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    most = -F.col("best.less")
    known = words.join(best, "word", "left").withColumn("strong", F.coalesce(most >= FORM_TIMES * F.col("n"), F.lit(False)))
    known = materialize(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("strong"), F.col("best.near")).alias("form"), F.when(F.col("strong"), most).alias("form_n")), "spelling-forms")
    roots = rooted(known.where("form IS NOT NULL"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
