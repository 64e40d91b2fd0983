"""Line numbers of files that are read in splits, and faults told by them."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from qaforge.operators import validation as VL
from qaforge.sources import readers as R


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("lines")
    r = random.Random(6)
    texts = {
        "long.txt": "".join("x" * r.randrange(0, 60) + r.choice(["\n", "\n", "\r\n"]) for _ in range(3000)),
        "open end.txt": "\n\na\nno break at the end", "one.txt": "one\n", "empty.txt": "", "blank.txt": "\n \n", "wide.txt": "y" * 9000 + "\nz\n",
    }
    for name, text in texts.items():
        (at / name).write_bytes(text.encode())
    (at / "packed.txt.gz").write_bytes(gzip.compress(b"p\nq\n" * 50))
    return at, texts | {"packed.txt.gz": "p\nq\n" * 50}


@pytest.fixture
def splits(spark):
    """Splits of half a kilobyte, several of them in a task."""
    conf = {"spark.sql.files.maxPartitionBytes": "512b", "spark.sql.files.openCostInBytes": "16b"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("sent", [500_000, 0])
def test_lines_are_those_of_a_plain_enumeration(spark, folder, splits, monkeypatch, sent):
    monkeypatch.setattr(R, "BLOCKS_SENT", sent)
    at, texts = folder
    got = R.read_lines(spark, str(at))
    assert spark.read.text(f"{at}/long.txt").select("_metadata.file_block_start").distinct().count() > 50
    want = [(name, i, line) for name, text in texts.items() for i, line in enumerate(text.replace("\r\n", "\n").removesuffix("\n").split("\n") if text else [], 1)]
    names = F.url_decode(F.element_at(F.split("file", "/"), -1))
    assert sorted(tuple(r) for r in got.withColumn("file", names).collect()) == sorted(want)
    assert {r.f for r in R.list_files(spark, str(at)).select(F.url_decode(F.element_at(F.split("file", "/"), -1)).alias("f")).collect()} == set(texts)


def test_faults_by_file_and_line(spark, tmp_path, splits):
    good = json.dumps({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]})
    bad = json.dumps({"messages": [{"role": "user", "content": "a"}, {"role": "tool", "content": "b"}]})
    lines = [good] * 40 + ["", "no json"] + [good] * 40 + [bad]
    (tmp_path / "mixed.jsonl").write_text("\n".join(lines))
    (tmp_path / "fine.jsonl").write_text(good + "\n\n" + good)
    (tmp_path / "none.jsonl").write_text("")
    (tmp_path / "blank.jsonl").write_text("\n\n")
    errors, verdicts = VL.validate_files(spark, str(tmp_path))
    name = F.element_at(F.split("file", "/"), -1)
    assert sorted(tuple(r) for r in errors.withColumn("file", name).collect()) == [
        ("blank.jsonl", 0, 0, "file is empty"), ("mixed.jsonl", 42, 0, "invalid JSON"), ("mixed.jsonl", 83, 2, "invalid or missing role"), ("none.jsonl", 0, 0, "file is empty")]
    assert sorted(tuple(r) for r in verdicts.withColumn("file", name).collect()) == [
        ("blank.jsonl", False, "file is empty"), ("fine.jsonl", True, None), ("mixed.jsonl", False, "invalid JSON"), ("none.jsonl", False, "file is empty")]
