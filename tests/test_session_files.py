"""The files that conversations are written to."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.plans.file_queries import conv_of, scanned_files
from tracewell.sources import lines as L


def test_a_session_is_one_file_though_its_lines_come_from_a_union(spark):
    name = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    spark.conf.set(name, "1k")
    try:
        rows = spark.range(40_000).select((F.col("id") % 200).alias("conv"), F.col("id").alias("k")).withColumn("n", F.row_number().over(Window.partitionBy("conv").orderBy("k")))
        body = rows.select("conv", F.col("n").alias("at"), F.concat(F.lit("body "), F.sha2(F.col("k").cast("string"), 512)).alias("value"))
        heads = rows.select("conv").distinct().select("conv", F.lit(0).alias("at"), F.lit("head").alias("value"))
        found = scanned_files(body.union(heads)).groupBy(conv_of(F.col("path")).alias("conv")).agg(F.countDistinct("path").alias("paths"), F.count("*").alias("n"), F.min_by("line", "offset").alias("first")).collect()
    finally:
        spark.conf.unset(name)
    assert len(found) == 200
    assert {(r.paths, r.n, r.first) for r in found} == {(1, 201, "head")}


def test_many_sessions_are_few_files_and_keep_their_places(spark, tmp_path):
    texts = {f"conv={k}": [f'{{"k":{k}}}', "  ", "é" * k, "x" * 40][: 1 + k % 4] for k in range(300)}
    L.write_bundles(spark.createDataFrame([(f, at, v) for f, lines in texts.items() for at, v in enumerate(lines)], "file string, at int, value string"), str(tmp_path / "b"))
    assert len(list((tmp_path / "b").glob("part-*"))) <= 4
    most = 500
    want = []
    for f, lines in texts.items():
        offset = number = 0
        for v in lines:
            n = len(v.encode())
            kind = "oversized" if n + 1 > most else "blank" if not v.strip() else "line"
            want.append((f, offset, number, None if kind == "oversized" else v, kind, n))
            offset, number = offset + n + 1, number + (kind == "line")
    assert {w[4] for w in want} == {"line", "blank", "oversized"}
    found = L.scan_bundles(spark, str(tmp_path / "b"), most=most).select("path", "offset", "line_no", "line", "kind", "n_bytes").collect()
    assert sorted(map(tuple, found), key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])


def test_a_scan_is_dealt_to_many_tasks(spark, tmp_path):
    for k in range(40):
        (tmp_path / f"{k}.jsonl").write_text("{}\n")
    tasks = L.scan_lines(spark, str(tmp_path)).select(F.spark_partition_id().alias("t")).distinct().count()
    assert tasks > 1
