"""Quality rules in DataFrame operations: counting rules, then divergence from language references.

A document's histograms of character classes and of common words are compared with those of
its language by the Jensen-Shannon distance (base 2, square root of the divergence, 0 to 1).
References are the histograms summed over all documents of a language; a language with few
words is compared with the reference of all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE_CLASS, materialize, sized

#: The symbols counted, and frequent function words of the languages.
SYMBOLS = r"[#*$%&|<>]"
PUNCTUATION = r"[.,;:!?'\"()\[\]{}\-_/\\@=+~^`]"
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "was", "on", "are", "with", "as", "be", "at", "it", "by", "this", "an"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "plus", "pas", "sur"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "es"],
}
#: Words of a text under which the base rules fail, and percent of its words in repeated windows.
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
#: Distances from which a document is rejected; clean text of a reference's own language lies well below.
MOST_CLASS_DISTANCE = 0.35
#: A text without common words lies at 0.30 to 0.34 from references whose words are common ones by 17 to 20 %;
#: clean texts of LEAST_COMMON_WORDS or more reach 0.26.
MOST_WORD_DISTANCE = 0.28
#: Guards: words a document needs for each test, and words a language's reference needs.
LEAST_CLASS_WORDS = 50
LEAST_COMMON_WORDS = 100
LEAST_REFERENCE_WORDS = 20_000


def base_counts(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, lang, the base rules' counts and both histograms.

    Null texts count as empty; extra columns are ignored.  Windows are compared by 64-bit hashes
    of their words, which are sorted in the row, so the cost of a very long text is n log n.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    n_chars = F.length("t")
    every = sorted({w for words in COMMON_WORDS.values() for w in words})
    def without(runs: str) -> Column:
        # Runs of a class taken out; the length that goes missing is the class's count.
        return F.length(F.regexp_replace("t", runs, ""))

    rows = docs.select("doc_id", "lang", text.alias("t")).select(
        "doc_id", "lang",
        F.array_remove(F.split("t", SPACE_CLASS), "").alias("w"),
        F.filter(F.split(F.lower("t"), SPACE_CLASS), lambda w: w.isin(every)).alias("common"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        n_chars.cast("long").alias("chars"),
        without(SPACE_CLASS).cast("long").alias("word_chars"),
        (n_chars - without(SYMBOLS + "+")).cast("long").alias("n_symbols"),
        (n_chars - without("[0-9]+")).cast("long").alias("n_digits"),
        (n_chars - without("[A-Z]+")).cast("long").alias("n_upper"),
        (n_chars - without(PUNCTUATION + "+")).cast("long").alias("n_punct"),
    )
    stop = F.lit(None)
    for name, words in COMMON_WORDS.items():
        stop = F.when(F.col("lang") == name, F.array(*map(F.lit, words))).otherwise(stop)
    stop = F.coalesce(stop, F.array(*map(F.lit, COMMON_WORDS["en"])))
    rows = rows.select(
        "*",
        F.size("w").cast("long").alias("n_words"),
        F.when(F.size("w") >= 3, F.transform(F.slice("w", 1, F.size("w") - 2), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))).alias("h"),
        stop.alias("stop"),
    )
    rows = rows.withColumn("differ", F.size(F.array_distinct("h")))
    # Only where some window repeats are windows sorted with their places: equal neighbours give the places
    # of repeated windows, and each covers three words less what the next place covers again.
    rows = rows.withColumn("sorted", F.when(F.col("differ") < F.size("h"), F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    rows = rows.withColumn("same", F.arrays_zip(
        F.col("sorted").alias("e"),
        F.slice("sorted", 2, F.size("sorted")).alias("after"),
        F.concat(F.slice("sorted", 1, 0), F.array(F.lit(None).cast("struct<x:bigint,i:int>")), F.slice("sorted", 1, F.size("sorted") - 1)).alias("before"),
    ))
    rows = rows.withColumn("places", F.array_sort(F.transform(
        F.filter("same", lambda s: s["e"]["x"].eqNullSafe(s["after"]["x"]) | s["e"]["x"].eqNullSafe(s["before"]["x"])), lambda s: s["e"]["i"]
    )))
    gaps = F.zip_with("places", F.slice("places", 2, F.greatest(F.size("places"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    covered = F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x)
    n_space = F.col("chars") - F.col("word_chars")
    letters = F.col("word_chars") - F.col("n_symbols") - F.col("n_digits") - F.col("n_upper") - F.col("n_punct")
    return rows.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array(letters, F.col("n_upper"), F.col("n_digits"), F.col("n_punct"), F.col("n_symbols"), n_space).alias("classes"),
        # What goes missing where a word is removed is its count: no lambda runs for each word of a text.
        F.transform("stop", lambda s: (F.size("common") - F.size(F.array_remove("common", s))).cast("long")).alias("words_seen"),
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts; null if either is empty."""
    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)

    def term(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    tp, tq = F.nullif(total(p), F.lit(0.0)), F.nullif(total(q), F.lit(0.0))
    parts = F.zip_with(p, q, lambda x, y: F.struct((x / tp).alias("a"), (y / tq).alias("b")))
    terms = F.transform(parts, lambda s: term(s["a"], (s["a"] + s["b"]) / 2) + term(s["b"], (s["a"] + s["b"]) / 2))
    return F.when(tp.isNotNull() & tq.isNotNull(), F.sqrt(F.greatest(total(terms) / 2, F.lit(0.0))))


def with_rest(seen: Column, n_words: Column) -> Column:
    """The common words' counts and that of all other words."""
    return F.concat(seen, F.array(n_words - F.aggregate(seen, F.lit(0).cast("long"), lambda acc, x: acc + x)))


def references(counts: DataFrame) -> DataFrame:
    """(lang, classes, words) summed over all documents of a language; lang '*' is all documents."""
    n_classes, n_words = 6, len(COMMON_WORDS["en"])
    sums = counts.groupBy("lang").agg(
        F.sum("n_words").alias("total"),
        F.array(*(F.sum(F.get("classes", F.lit(i))) for i in range(n_classes))).alias("classes"),
        F.array(*(F.sum(F.get("words_seen", F.lit(i))) for i in range(n_words))).alias("seen"),
    )
    return sums.withColumn("words", with_rest(F.col("seen"), F.col("total"))).drop("seen")


def judge(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: the counts, base_failed, both distances and kept.

    kept is false where a base rule fails or where a distance, on a document long enough for its
    guard, passes its threshold.  Documents of no language, or of one with too few words for a
    reference, are held against all documents' character classes and pass the word test.
    Empty tables give no rows; repeated rows are judged each.
    """
    counts = materialize(base_counts(docs), "quality-counts")
    refs = references(counts)
    everything = Window.partitionBy(F.lit(0))
    refs = refs.select(
        F.col("lang").alias("r_lang"), (F.col("lang").isNotNull() & (F.col("total") >= LEAST_REFERENCE_WORDS)).alias("own"),
        F.col("classes").alias("r_classes"), F.col("words").alias("r_words"),
        F.array(*(F.sum(F.get("classes", F.lit(i))).over(everything) for i in range(6))).alias("all_classes"),
    )
    # A row for each language: all documents of one language would meet it in one task if it weren't broadcast.
    refs = sized(materialize(refs, "quality-references"), 400)
    rows = counts.join(refs, counts["lang"].eqNullSafe(refs["r_lang"]), "left").drop("r_lang")
    real = lambda c: F.transform(c, lambda x: x.cast("double"))
    rows = rows.withColumn("class_distance", js_distance(real(F.col("classes")), real(F.when(F.col("own"), F.col("r_classes")).otherwise(F.col("all_classes")))))
    known = F.col("own") & F.col("lang").isin(list(COMMON_WORDS))
    rows = rows.withColumn("word_distance", F.when(known, js_distance(real(with_rest(F.col("words_seen"), F.col("n_words"))), real(F.col("r_words")))))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    far = (F.col("n_words") >= LEAST_CLASS_WORDS) & (F.coalesce("class_distance", F.lit(0.0)) > MOST_CLASS_DISTANCE)
    odd = (F.col("n_words") >= LEAST_COMMON_WORDS) & (F.coalesce("word_distance", F.lit(0.0)) > MOST_WORD_DISTANCE)
    return rows.withColumn("base_failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~far & ~odd).alias("kept"), "class_distance", "word_distance",
    )
