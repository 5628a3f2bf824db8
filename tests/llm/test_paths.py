"""Where tasks write files: the place that Spark reads the same path from."""

from tracelab.llm import common


def test_folders_follow_the_default_file_system(spark, tmp_path, monkeypatch):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    default = conf.get("fs.defaultFS")
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *other: "/shared/x")
    assert common.shared_dir(spark, "a").startswith("/shared/x/a-")
    try:
        conf.set("fs.viewfs.mounttable.table.link./shared", f"file://{tmp_path}")
        conf.set("fs.defaultFS", "viewfs://table/")
        assert common.shared_dir(spark, "a").startswith("viewfs://table/shared/x/a-")
    finally:
        conf.set("fs.defaultFS", default)


def test_object_stores_by_either_scheme(monkeypatch):
    monkeypatch.setattr(common.pafs, "FileSystem", type("Known", (), {"from_uri": staticmethod(lambda uri: uri)}))
    assert common.file_system("s3a://store/a/s3a://b") == common.file_system("s3://store/a/s3a://b")


def test_files_of_a_uri(tmp_path):
    for path in (f"file://{tmp_path}/a/b", f"{tmp_path}/c/d"):
        with common.new_file(path) as out:
            out.write(b"0123456789")
        assert common.read_range(path, 2, 3) == b"234" and common.read_range(path, 7) == b"789"
