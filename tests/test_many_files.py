"""Many files and groups: what the driver holds does not grow with them."""

import os

from pyspark.sql import functions as F

from compliance_scan.operators import ordering
from compliance_scan.plans import queries
from compliance_scan.sources import files, tree


def _broadcasts(plan):
    """The broadcast exchanges of an executed plan."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _broadcasts(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _broadcasts(plan.plan())
    below = [plan.children().apply(i) for i in range(plan.children().size())]
    return ([plan] if kind == "BroadcastExchangeExec" else []) + [x for b in below for x in _broadcasts(b)]


def test_numbering_broadcasts_no_row_per_group(spark):
    # 2,000 groups of two rows and one that spans partitions
    rows = spark.range(8000).select(F.when(F.col("id") < 4000, F.lit(-1)).otherwise(F.floor(F.col("id") / 2)).alias("g"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = ordering.numbered(rows, [F.col("id")], F.col("g"))
        got = placed.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert {(r.g, r.ordinal, r.id) for r in got} == {
        *((-1, i + 1, i) for i in range(4000)), *((i // 2, i % 2 + 1, i) for i in range(4000, 8000))}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen = [x.metrics().apply("numOutputRows").value() for x in _broadcasts(placed._jdf.queryExecution().executedPlan())]
    assert seen and max(seen) <= parts


def test_written_files_stay_where_their_tasks_put_them(spark, tmp_path):
    rows = spark.createDataFrame([(1, "k=1", "a"), (2, "k=2", "b\nc"), (3, "k=1", "d"), (4, "k=3", None)], "i int, folder string, value string")
    assert tree.write_files(rows.coalesce(1).sortWithinPartitions("i"), str(tmp_path)) == 3
    found = {os.path.relpath(os.path.join(d, n), tmp_path): open(os.path.join(d, n)).read() for d, _, names in os.walk(tmp_path) for n in names}
    assert found == {"k=1/part-00000.txt": "a\nd\n", "k=2/part-00000.txt": "b\nc\n", "k=3/part-00000.txt": "\n"}


def test_corpus_folder_holds_one_file_a_key_and_no_other(spark):
    keys = [k for (k,) in spark.read.parquet("/root/testdata/sf0.001/customer.parquet").select("c_custkey").collect()]
    folder = queries.corpus_folder(spark, "/root/testdata/sf0.001").removeprefix("file:")
    found = [(os.path.basename(d), n) for d, _, names in os.walk(folder) for n in names]
    assert sorted(d for d, _ in found) == sorted(f"k={k}" for k in keys)
    assert all(n.startswith("part-") for _, n in found)  # no checksum file beside each, no job's mark


def test_readers_of_a_local_folder_make_no_index_of_its_files(spark, tmp_path):
    for name, text in {"a.java": "x\ny\n", "d/b.java": "z", "_d/c.java": "h", "k_=1/_x=1.java": "w", ".e.java": "h", "empty.java": "",
                       "d/b.java._COPYING_": "h", "_y.java": "h", "_metadata.java": "h", "_metadata/m.java": "m"}.items():
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    os.makedirs(tmp_path / "real.d")
    (tmp_path / "real.d" / "l.java").write_bytes(b"\xff\n")
    os.symlink(tmp_path / "real.d", tmp_path / "linked")
    plain = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.java").load(str(tmp_path))
    want = sorted(map(tuple, plain.select(files.plain_path(F.col("_metadata.file_path")), F.hex("value")).collect()))
    whole = files.read_sources(spark, str(tmp_path))
    assert sorted(map(tuple, whole.select("file_path", F.hex("content")).collect())) == want
    lines = files.read_lines(spark, str(tmp_path))
    assert {r.file_path for r in lines.collect()} == {p for p, _ in want}
    for df in (whole, lines):
        assert not df.inputFiles()
