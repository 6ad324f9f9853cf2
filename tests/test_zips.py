"""Members of zip files: streaming, pruning, key filters, restarts of writers, odd archives."""

import gzip
import io
import os
import zipfile

import pytest

from evidloom.sources import zips as Z


def archive(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members.items():
            z.writestr(name, content)


def test_members_are_partitions_and_only_asked_columns_come(spark, tmp_path):
    archive(f"{tmp_path}/a.zip", {"x.csv": "id,name,rest\n1,a,zz\n2,,zz\n", "sub/y.csv": 'rest,name,id\nzz,"b, ""c""\nd",3\n', "note.txt": "id\n9\n", "empty.csv": ""})
    archive(f"{tmp_path}/b.zip", {"z.csv.gz": gzip.compress(b"id,name\n4,e\n"), "only_header.csv": "id,name\n"})
    archive(f"{tmp_path}/none.zip", {})
    df = Z.zip_table(spark, str(tmp_path), "name string, id long")
    assert df.rdd.getNumPartitions() == 5 and df.columns == ["name", "id"]
    assert sorted((r["id"], r["name"]) for r in df.collect()) == [(1, "a"), (2, None), (3, 'b, "c"\nd'), (4, "e")]
    assert Z.zip_table(spark, f"{tmp_path}/b.zip", "id int").collect() == [(4,)]
    assert Z.zip_table(spark, f"{tmp_path}/none.zip", "id int").count() == 0


def test_rows_without_a_wanted_key_leave_in_the_reader(spark, tmp_path):
    archive(f"{tmp_path}/a.zip", {"m.csv": "1|x|7\n2|y|8\n3|z|1\n|w|\n"})
    df = Z.zip_table(spark, str(tmp_path), "t string", delimiter="|", names=["a", "t", "b"], keys={"a": ["1"], "b": ["1", "8"]})
    assert sorted(r["t"] for r in df.collect()) == ["x", "y", "z"]
    with pytest.raises(ValueError, match="join"):
        Z.zip_table(spark, str(tmp_path), "t string", keys={"a": ["k"] * (Z.MOST_KEYS + 1)})


class Counting(io.RawIOBase):
    """An endless-looking member: rows are made as they are read, and the most that is asked for at a time is kept."""

    def __init__(self, rows):
        self.left, self.rest, self.most = rows, b"id,text\n", 0

    def readable(self):
        return True

    def readinto(self, b):
        self.most = max(self.most, len(b))
        while len(self.rest) < len(b) and self.left:
            self.rest += b"".join(b"%d,%s\n" % (i, b"t" * 200) for i in range(self.left, max(0, self.left - 1000), -1))
            self.left = max(0, self.left - 1000)
        n = min(len(b), len(self.rest))
        b[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def test_a_member_is_never_in_memory_whole(spark, tmp_path, monkeypatch):
    import pyarrow as pa
    from pyspark.sql.types import StructType

    archive(f"{tmp_path}/a.zip", {"m.csv": "id,text\n"})
    endless = Counting(400_000)  # 80 MB
    monkeypatch.setattr(zipfile.ZipFile, "open", lambda self, name, *a, **k: endless)
    reader = Z._Reader(StructType.fromDDL("id long"), {"path": str(tmp_path), "suffixes": '[".csv"]', "delimiter": ","})
    before, most, rows = pa.total_allocated_bytes(), 0, 0
    for batch in reader.read(Z.Member(f"{tmp_path}/a.zip", "m.csv")):
        rows, most = rows + batch.num_rows, max(most, pa.total_allocated_bytes() - before)
    assert rows == 400_000 and endless.most <= Z.BLOCK_BYTES and most < 64 * Z.BLOCK_BYTES


def test_written_archives_come_back_and_a_task_that_runs_again_replaces_its_own(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else f'a,"{i}\n') for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, t string").repartition(3, "id")
    for _ in range(2):
        assert Z.write_zips(df, f"{tmp_path}/z", rows_of_member=100) >= 10
    assert len(os.listdir(f"{tmp_path}/z")) == 3
    back = Z.zip_table(spark, f"{tmp_path}/z", "id long, t string")
    assert sorted(map(tuple, back.collect())) == rows


def test_a_stamped_table_is_read_again_only_when_its_files_change(spark, tmp_path):
    from evidloom.sources import readers as R

    built = []

    def totals(t):
        built.append(1)
        return t.agg({"id": "sum"}).toDF("s")

    spark.range(5).write.parquet(f"{tmp_path}/t")
    get = lambda: R.stamped(spark, f"{tmp_path}/t", f"{tmp_path}/cache", totals).first()["s"]
    assert [get(), get(), len(built)] == [10, 10, 1]
    spark.range(3).write.mode("append").parquet(f"{tmp_path}/t")
    assert [get(), get(), len(built), len([x for x in os.listdir(f"{tmp_path}/cache") if not x.startswith(".")])] == [13, 13, 2, 1]
