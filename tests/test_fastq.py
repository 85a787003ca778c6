"""The FASTQ source: splits at every byte, odd qualities, compressed files, and errors."""

import gzip
import random

import pytest

from kmerlake.sources import fastq as Q


@pytest.fixture(scope="module")
def reads():
    rng = random.Random(3)
    odd = "@+I#@+"
    out = []
    for i in range(120):
        n = rng.randrange(0, 12)
        out.append((f"r{i}", "".join(rng.choices("ACGTN", k=n)), "".join(rng.choices(odd, k=n))))
    return out


def text(reads, end="\n"):
    return "".join(f"@{n} more{end}{s}{end}+{n if i % 2 else ''}{end}{q}{end}" for i, (n, s, q) in enumerate(reads))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_every_way_to_split(tmp_path, reads, end):
    path = tmp_path / "a.fastq"
    path.write_bytes(text(reads, end).encode())
    size = path.stat().st_size
    want = [(n, s) for n, s, _ in reads]
    for step in (1, 7, 50, 333, size):
        got = [r[1:] for at in range(0, size, step) for r in Q.records(str(path), at, at + step)]
        assert got == want, step


def test_source(spark, tmp_path, reads):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fastq").write_text(text(reads[:60]) + "\n\n")
    with gzip.open(tmp_path / "in/b.fastq.gz", "wt") as f:
        f.write(text(reads[60:]).rstrip("\n"))
    (tmp_path / "in/c.fastq").write_text("")
    frame = Q.read_fastq(spark, str(tmp_path / "in"), split_bytes=100)
    assert frame.rdd.getNumPartitions() > 5
    assert sorted((r.name, r.seq) for r in frame.collect()) == sorted((n, s) for n, s, _ in reads)
    assert Q.read_fastq(spark, f"{tmp_path}/in/b*").count() == 60
    assert Q.read_fastq(spark, f"file://{tmp_path}/in/a.fastq").count() == 60
    assert Q.read_fastq(spark, str(tmp_path / "in/c.fastq")).collect() == []
    with pytest.raises(Exception, match="no FASTQ file"):
        Q.read_fastq(spark, str(tmp_path / "none")).collect()


@pytest.mark.parametrize(
    "bad, says",
    [("@x\nACGT\n+\nIII\n", "4 bases but 3 qualities"), ("x\nACGT\n+\nIIII\n", "must begin with @"), ("@x\nACGT\nIIII\n", "must begin with"), ("@x\nACGT\n", "ends within a record")],
)
def test_malformed_records_are_errors(spark, tmp_path, bad, says):
    good = "@ok\nACGT\n+\nIIII\n"
    path = tmp_path / "bad.fastq"
    path.write_text(good * 3 + bad + (good * 2 if "ends" not in says else ""))
    with pytest.raises(Exception, match=says) as told:
        Q.read_fastq(spark, str(path)).collect()
    assert "bad.fastq" in str(told.value) and f"byte {3 * len(good)}" in str(told.value)
    with pytest.raises(Exception, match="malformed record"):
        Q.read_fastq(spark, str(path), split_bytes=20).collect()
    kept = Q.read_fastq(spark, str(path), on_error="drop").collect()
    assert {r.name for r in kept} == {"ok"} and len(kept) >= 3


def test_options(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@a\nA\n+\nI\n")
    with pytest.raises(Exception, match="onError"):
        Q.read_fastq(spark, str(tmp_path / "a.fastq"), on_error="ignore").collect()
