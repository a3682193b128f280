"""Session files as lines with their byte places, and discovery of the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .ranges import BLANK, HEAD, MOST_LINE_BYTES, RANGE_BYTES, count_ranges, dealt, files_below, ranges_of, read_ranges


def line_kind(line: Column, n_bytes: Column) -> Column:
    """'line', 'blank' or 'oversized' of a line without its line end."""
    return F.when(n_bytes + 1 > MOST_LINE_BYTES, "oversized").when(F.btrim(line, F.lit(BLANK)) == "", "blank").otherwise("line")


def scan_lines(
    spark: SparkSession, root: str, pattern: str = "*.jsonl", cursors: DataFrame | None = None, wanted: DataFrame | None = None, most: int = MOST_LINE_BYTES, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """(path, offset, line_no, line, kind, n_bytes) of the files below root whose names fit, at any depth.

    Pattern 'rollout-*.jsonl' finds dialect B.  offset is the byte at which a line begins in its file, also
    where bytes aren't valid UTF-8.  kind is 'line', 'blank' or 'oversized'; the text of an oversized line
    is dropped.  A last line without line end is not read yet.  line_no counts lines of kind 'line' from 0,
    as turn indexes do.  cursors (path, cursor) give the byte, at a line's beginning, from which a file is
    read on; lines are then counted from there, and nothing before it is read.  Of wanted (path), if given, only those files are opened.

    A file is read by ranges of its bytes, a task holds one line and a batch of 2 MB at a time, and no line is shuffled.
    Only where a file has several ranges are these read once more, to count the lines before each.
    """
    ranges = ranges_of(files_below(spark, root, pattern), cursors, wanted, range_bytes)
    found = read_ranges(dealt(ranges), most)
    several = ranges.where(F.col("begin") > F.col("first")).select("path").distinct()
    before = Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    counted = count_ranges(dealt(ranges.join(several, "path", "left_semi")), most)
    earlier = counted.select("path", "begin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    if several.isEmpty():
        numbered = found.withColumn("line_no", F.col("number"))
    else:
        numbered = found.join(earlier, ["path", "begin"], "left").withColumn("line_no", F.col("number") + F.coalesce("earlier", F.lit(0)))
    return numbered.select("path", "offset", F.col("line_no").cast("int"), "line", "kind", "n_bytes")


def write_bundles(rows: DataFrame, root: str) -> None:
    """Write the lines (file, at, value) of many small files, by at, as a few text files, each small one whole after a line that names it.

    A store, a listing and a driver have then to do with as many files as there are tasks, however many small ones there are.
    """
    # Dealt by a hash of the name: a union whose sides are already dealt by it would be left as it is, with its sides coalesced apart.
    placed = rows.withColumn("dealt", F.xxhash64("file")).repartition("dealt")
    first = F.row_number().over(Window.partitionBy("dealt", "file").orderBy("at")) == 1
    value = F.coalesce("value", F.lit(""))
    value = F.when(value.startswith(HEAD), F.raise_error(F.lit("a line begins as those that name files"))).otherwise(value)
    placed.select(F.when(first, F.concat(F.lit(HEAD), F.coalesce("file", F.lit("")), F.lit("\n"), value)).otherwise(value).alias("value")).write.text(root)


def scan_bundles(spark: SparkSession, root: str, pattern: str = "*.txt", most: int = MOST_LINE_BYTES) -> DataFrame:
    """scan_lines() of the small files that write_bundles() put below root; path is a small file's name, and a bundle is read by one task, in batches."""
    ranges = ranges_of(files_below(spark, root, pattern), size=1 << 62)
    found = read_ranges(dealt(ranges), most, bundled=True)
    return found.select("path", "offset", F.col("number").cast("int").alias("line_no"), "line", "kind", "n_bytes")


def split_lines(files: DataFrame, cursor: Column | None = None) -> DataFrame:
    """scan_lines() of files that are rows already (path, content), valid UTF-8 each, from each file's cursor on.

    offset is the byte at which a line begins.  kind is 'line', 'blank' or 'oversized'; a last line
    without line end is not read yet.  line_no counts lines of kind 'line' from 0, as turn indexes
    do.  A cursor has to lie at a line's beginning.
    """
    begin = F.coalesce(cursor, F.lit(0)) if cursor is not None else F.lit(0)
    rest = F.when(begin == 0, F.col("content")).otherwise(F.decode(F.substring(F.encode("content", "UTF-8"), begin + 1, F.lit((1 << 31) - 1)), "UTF-8"))
    parts = F.split(rest, "\n", -1)
    rows = files.select("path", begin.cast("long").alias("begin"), F.posexplode(F.slice(parts, F.lit(1), F.size(parts) - 1)).alias("at", "line"))
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.col("begin") + F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0)))
    rows = rows.withColumn("n_bytes", F.octet_length("line").cast("long"))
    rows = rows.withColumn("kind", line_kind(F.col("line"), F.col("n_bytes")))
    number = F.coalesce(F.sum(F.when(F.col("kind") == "line", 1).otherwise(0)).over(before), F.lit(0))
    return rows.select("path", "offset", number.cast("int").alias("line_no"), F.when(F.col("kind") != "oversized", F.col("line")).alias("line"), "kind", "n_bytes")


def _counts() -> list[Column]:
    good, valid = F.col("kind") == "line", F.try_parse_json("line").isNotNull()
    return [
        F.count_if(good & valid).alias("emitted"), F.count_if(good & ~valid).alias("malformed"), F.count_if(F.col("kind") == "oversized").alias("oversized"), F.count_if(F.col("kind") == "blank").alias("blank"),
    ]


def scan_stats(lines: DataFrame) -> DataFrame:
    """Per file: the next cursor, after its last complete line, and numbers of lines read, malformed, oversized and blank."""
    return lines.groupBy("path").agg(F.max(F.col("offset") + F.col("n_bytes") + 1).alias("cursor"), *_counts())


def observed(lines: DataFrame, name: str = "scan") -> tuple[DataFrame, Observation]:
    """lines, and the scan's total counts, which come with whatever job or stream reads them and need no scan of their own."""
    seen = Observation(name)
    return lines.observe(seen, *_counts()), seen


def save_cursors(stats: DataFrame, folder: str, known: DataFrame | None = None) -> None:
    """Write the cursors of scan_stats(), and known ones of other files, as the folder's next version; a job that fails leaves the last one."""
    rows = stats.select("path", "cursor")
    if known is not None:
        rows = rows.union(known.join(rows, "path", "left_anti").select("path", "cursor"))
    rows.write.parquet(f"{folder.rstrip('/')}/version={max(_versions(stats.sparkSession, folder), default=-1) + 1}")


def load_cursors(spark: SparkSession, folder: str) -> DataFrame:
    """(path, cursor) of the last complete version; none where nothing was saved.  A negative cursor is refused."""
    versions = _versions(spark, folder)
    if not versions:
        return spark.createDataFrame([], "path string, cursor long")
    found = spark.read.schema("path string, cursor long").parquet(f"{folder.rstrip('/')}/version={max(versions)}")
    return found.select("path", F.when(F.col("cursor") < 0, F.raise_error(F.concat(F.lit("negative cursor of "), "path"))).otherwise(F.col("cursor")).cast("long").alias("cursor"))


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions whose jobs were committed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/version=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [int(str(s.getPath().getParent().getName()).removeprefix("version=")) for s in found or []]


def cursor_key(path: Column) -> Column:
    return F.sha2(path, 256)


def slug_path(slug: Column) -> Column:
    """The repository folder that a project slug stands for; dashes of names are lost."""
    return F.concat(F.lit("/"), F.translate(F.regexp_replace(slug, "^-", ""), "-", "/"))


def base_name(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.jsonl$", "")


def rollout_session(path: Column) -> Column:
    """The session id in a rollout file's name, or the name itself."""
    name = base_name(path)
    found = F.regexp_extract(name, r"^rollout-\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2}-(.+)$", 1)
    return F.when(found != "", found).otherwise(name)


def dialect_of(lines: DataFrame, most: int = 20) -> DataFrame:
    """(path, dialect): 'b' if the first parsed line with a telling key has payload, else 'a'."""
    keys = F.json_object_keys("line")
    says = F.when(F.array_contains(keys, "payload"), "b").when(F.array_contains(keys, "message"), "a")
    early = lines.where(F.col("kind") == "line").withColumn("says", F.when(F.col("line_no") < most, says))
    return early.groupBy("path").agg(F.coalesce(F.min_by("says", F.when(F.col("says").isNotNull(), F.col("line_no"))), F.lit("a")).alias("dialect"))


def working_folder(lines: DataFrame, most: int = 128) -> DataFrame:
    """(path, cwd): the first non-empty working folder among a file's first lines."""
    cwd = F.coalesce(F.nullif(F.get_json_object("line", "$.cwd"), F.lit("")), F.nullif(F.get_json_object("line", "$.payload.cwd"), F.lit("")))
    early = lines.where((F.col("kind") == "line") & (F.col("line_no") < most)).withColumn("cwd", cwd)
    return early.groupBy("path").agg(F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("line_no"))).alias("cwd"))


def session_index(spark: SparkSession, path: str) -> DataFrame:
    """(id, thread_name, updated_at) of an index file, malformed lines left out, by id."""
    rows = spark.read.schema("id string, thread_name string, updated_at string, _corrupt_record string").json(path)
    return rows.where("_corrupt_record is null and id is not null").drop("_corrupt_record").orderBy("id")
