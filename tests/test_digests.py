"""sha256 of files that are longer than what one task reads."""

import gzip
import hashlib
import random

import pytest

from decant.sources import digests
from decant.sources import readers as R

LONGEST = "spark.sql.sources.binaryFile.maxLength"


def contents():
    r = random.Random(5)
    noise = r.randbytes(300_000)
    line = b"".join(b"%d,%s\r\n" % (i, b"x" * r.randrange(60)) for i in range(6000))
    return {
        "noise.bin": noise, "a [1] {b} %41.bin": noise[::-1], "crlf.tsv": line, "open.jsonl": line + b"{}", "blank.txt": b"\n" * 200_001,
        "mark.tsv": b"\xef\xbb\xbf" + line, "begins.txt": b"\n\n" + line, "ends.txt": line + b"\r", "one-line.bin": bytes(150_000),
        "edge.bin": (b"y" * 4095 + b"\n") * 32, "slice.bin": noise[:1 << 16], "over.bin": noise[:(1 << 16) + 1], "small.txt": b"a\n",
    }


@pytest.fixture
def short_slices(monkeypatch):
    monkeypatch.setattr(digests, "SLICE", 1 << 16)


def test_manifest_hashes_files_in_slices(spark, tmp_path, short_slices):
    for name, data in contents().items():
        (tmp_path / name).write_bytes(data)
    spark.conf.set(LONGEST, 1 << 16)  # no file longer than a slice may be read as a whole
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        got = {r.file: (r.bytes, r.sha256) for r in R.file_manifest(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset(LONGEST)
    assert got == {name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in contents().items()}
    assert before == (spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes"))


def test_packed_files_are_hashed_as_they_are(spark, tmp_path, short_slices):
    data = gzip.compress(contents()["noise.bin"])
    (tmp_path / "noise [2].gz").write_bytes(data)
    got = R.file_manifest(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("noise [2].gz", len(data), hashlib.sha256(data).hexdigest())]


def test_a_file_that_changes_is_no_digest(spark, tmp_path, short_slices):
    (tmp_path / "f").write_bytes(b"a\n" * 100_000)
    with pytest.raises(RuntimeError, match="not read as a whole"):
        digests.sha256_in_slices(spark, [(f"file:{tmp_path}/f", 200_100)])


def test_sha256_goes_on_from_its_state():
    data = random.Random(1).randbytes(1000)
    for cut in (0, 1, 63, 64, 65, 999, 1000):
        h = digests.Sha256()
        h.update(data[:cut])
        h = digests.Sha256(h.state())
        h.update(data[cut:])
        assert h.hexdigest() == hashlib.sha256(data).hexdigest()
