import pytest

from decant import session


class Fake:
    """A session with a master and no checkpoint folder."""

    def __init__(self, master, root=None):
        self.sparkContext = self
        self.master, self.root, self.applicationId = master, root, f"app-{master}"
        self.conf = self

    def get(self, key, default=None):
        return self.root if key == "spark.checkpoint.dir" else default


def test_the_shared_folder_is_the_clusters(tmp_path):
    assert session.shared_root(Fake("spark://x:1", "hdfs://a/b/")) == "hdfs://a/b"
    for master in ("spark://x:1", "local-cluster[3,2,1024]", "yarn"):
        with pytest.raises(RuntimeError):
            session.shared_root(Fake(master))
    first = session.shared_root(Fake("local[8]"))
    assert first == session.shared_root(Fake("local[8]"))


def test_rows_of_files_by_format(spark, tmp_path):
    from decant.sources import readers

    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n  \t\n{"x": 2}\n')
    (tmp_path / "b.jsonl").write_text("\n")
    (tmp_path / "c.tsv").write_text("﻿x\ty\n1\t2\n3\t4\n\t\n", encoding="utf-8")
    (tmp_path / "d.tsv").write_text("x\ty\n", encoding="utf-8")
    spark.range(7).coalesce(1).write.parquet(str(tmp_path / "p"))
    rows = lambda names, kind: {r.file: r.rows for r in readers.file_rows(spark, [str(tmp_path / n) for n in names], kind).collect()}
    assert rows(["a.jsonl", "b.jsonl"], "jsonl") == {"a.jsonl": 2, "b.jsonl": 0}
    assert rows(["c.tsv", "d.tsv"], "tsv") == {"c.tsv": 2, "d.tsv": 0}
    assert list(rows(["p"], "parquet").values()) == [7]
    with pytest.raises(ValueError):
        rows(["p"], "csv")
