import numpy as np
import pytest

from annulus.operators import kmeans
from annulus.sources import fbin, index_store
from annulus.streaming.search import answer


def test_fbin(spark, tmp_path):
    rows = np.arange(6, dtype="<f4").reshape(2, 3)
    (tmp_path / "a.fbin").write_bytes(np.array(rows.shape, "<u4").tobytes() + rows.tobytes())
    got = fbin.read(spark, str(tmp_path / "a.fbin")).orderBy("vec_id").collect()
    assert [(r.vec_id, r.embedding) for r in got] == [(0, [0, 1, 2]), (1, [3, 4, 5])]
    (tmp_path / "t.bin").write_bytes(np.array([1, 2], "<u4").tobytes() + np.array([7, 8], "<i4").tobytes())
    assert fbin.read(spark, str(tmp_path / "t.bin"), "int", "qid", "gt").first().gt == [7, 8]
    (tmp_path / "many").mkdir()
    big = np.arange(300, dtype="<f4").reshape(100, 3)
    for name, part in (("a.fbin", big[:30]), ("b.fbin", big[30:95]), ("c.fbin", big[95:])):
        (tmp_path / "many" / name).write_bytes(np.array(part.shape, "<u4").tobytes() + part.tobytes())
    for most in (50, 400, 1 << 20):  # by ranges, some by ranges, whole
        got = fbin.read(spark, str(tmp_path / "many"), most=most).orderBy("vec_id").collect()
        assert [(r.vec_id, r.embedding) for r in got] == [(i, x.tolist()) for i, x in enumerate(big)]
    (tmp_path / "bad.fbin").write_bytes(np.array([2, 3], "<u4").tobytes() + b"\0" * 20)
    with pytest.raises(Exception, match="need"):
        fbin.read(spark, str(tmp_path / "bad.fbin")).collect()


def test_index_store(spark, tmp_path):
    lists = kmeans.inverted_lists(spark.createDataFrame([(i, i % 3) for i in range(10)], "vec_id long, list_id int"))
    path = index_store.index_path(str(tmp_path), "lists", "d1", nlist=4, name="a/b")
    assert "name-a-b" in path
    index_store.save(lists, path, "d1", "list_id")
    back = index_store.load(spark, path, "d1")
    assert sorted((r.list_id, r.pos, r.vec_id) for r in back.collect()) == sorted((r.list_id, r.pos, r.vec_id) for r in lists.collect())
    with pytest.raises(ValueError):
        index_store.load(spark, path, "d2")
    row = index_store.csr_invariants(back, kmeans.list_sizes(back, 4)).first()
    assert (row.lists, row.first_offset, row.last_offset, row.vectors, row.monotone, row.dense) == (4, 0, 10, 10, True, True)
    assert not index_store.csr_invariants(back.where("pos <> 1"), kmeans.list_sizes(back, 4)).first().dense


def test_streamed_queries(spark, tmp_path):
    spark.range(5).selectExpr("id AS qid", "array(1.0f) AS qv").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("qid long, qv array<float>").parquet(str(tmp_path / "in"))
    answer(stream, lambda q: q.select("qid"), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_matrices_by_ranges_inside_files(spark, tmp_path):
    rows = np.random.default_rng(5).normal(size=(5000, 6)).astype("<f4")
    for name, part in (("a.bin", rows[:2100]), ("b.bin", rows[2100:]), ("c.bin", rows[:0])):
        (tmp_path / name).write_bytes(np.array(part.shape, "<u4").tobytes() + part.tobytes())
    got = fbin.read(spark, str(tmp_path), most=24 * 700)
    assert got.rdd.getNumPartitions() == 3 + 5  # both files are dealt
    found = sorted(((r.vec_id, r.embedding) for r in got.collect()), key=lambda r: r[0])
    assert found == [(i, x.tolist()) for i, x in enumerate(rows)]
    ids = fbin.read(spark, str(tmp_path), most=24 * 700, columns=["vec_id"])
    assert ids.columns == ["vec_id"] and sorted(r.vec_id for r in ids.collect()) == list(range(5000))


def test_changed_sources_and_broken_indexes_are_refused(spark, tmp_path):
    from pyspark.sql import functions as F

    def vectors(shift):
        return spark.range(40).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float"), F.lit(float(shift)).cast("float")).alias("embedding"))

    source, path = str(tmp_path / "vectors"), str(tmp_path / "index")
    vectors(0).write.parquet(source)
    index_store.save(spark.read.parquet(source).withColumn("list_id", (F.col("vec_id") % 3).cast("int")), path, "d", "list_id", "vec_id")
    assert index_store.load(spark, path, "d", spark.read.parquet(source)).count() == 40
    assert [(r.list_id, r.list_size, r.list_offset) for r in index_store.list_sizes(spark, path).orderBy("list_id").collect()] == [(0, 14, 0), (1, 13, 14), (2, 13, 27)]
    vectors(1).write.mode("overwrite").parquet(source)  # other vectors under the same path
    with pytest.raises(ValueError, match="other vectors"):
        index_store.load(spark, path, "d", spark.read.parquet(source))
    vectors(0).limit(39).write.mode("overwrite").parquet(source)
    with pytest.raises(ValueError, match="other vectors"):
        index_store.load(spark, path, "d", spark.read.parquet(source))
    spark.range(1).select(F.lit(7).cast("long").alias("vec_id"), F.array(F.lit(1.0).cast("float")).alias("embedding")).write.mode("append").parquet(f"{path}/data/list_id=1")
    with pytest.raises(ValueError, match="lists"):
        index_store.load(spark, path, "d")


def test_records_in_splits_read_like_one(spark, tmp_path):
    from annulus.sources import run_records

    path = tmp_path / "runs.csv"
    path.write_text("results of all runs\n\nrun_id,np,recall\n" + "".join(f"r{i},{i % 7},0.{i % 10}\n" + "\n" * (i % 50 == 0) for i in range(3000)))
    (tmp_path / "none.csv").write_text("no header here\n")
    want = sorted(tuple(r) for r in run_records.read(spark, str(tmp_path)).collect())
    assert len(want) == 3000 and len({r[0] for r in want}) == 3000
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 4
        assert sorted(tuple(r) for r in run_records.read(spark, str(tmp_path)).collect()) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    lines = [(r.place, r.line) for r in run_records.described(run_records.read(spark, str(path)).where("run_id = 'r5'")).orderBy("place").collect()]
    assert [x for _, x in lines][1:] == ["run_id: r5", "np: 5", "recall: 0.5"]
