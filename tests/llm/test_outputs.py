"""What writes or rewrites texts: sanitising and shard folders, on odd rows and clashing columns."""

import os
import tempfile

import numpy as np
import public_tokenizers
import pytest

from bidframe.llm import pii, sharding, tokens


@pytest.mark.parametrize("action,one,two", [("generalise", "write to [EMAIL] or [IP].", "[EMAIL]"), ("remove", "write to  or .", "")])
def test_sanitise(spark, action, one, two):
    rows = [(1, "write to a@b.co or 1.2.3.4.", "h"), (1, "nothing here", "h"), (2, None, "h"), (3, "", "h"), (None, "x@y.zz", "h"), (1, "write to a@b.co or 1.2.3.4.", "h")]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in rows], "doc_id long, text string, _h string, _d int, _p int, print int, spans int, row int, own int")
    found = pii.find_personal_data(docs, disclosure=10.0)
    got = pii.sanitise(docs, found, action)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "", r._h, r.print) for r in got.collect()) == sorted([(1, one, "h", 3), (1, one, "h", 3), (1, "nothing here", "h", 3), (2, "", "h", 3), (3, "", "h", 3), (0, two, "h", 3)])
    assert pii.sanitise(docs.limit(0), found).count() == 0


def test_overlapping_spans_are_one(spark):
    docs = spark.createDataFrame([(7, "abcdefghij")], "doc_id long, text string")
    found = docs.selectExpr("doc_id", "xxhash64(text) AS print", "array(named_struct('start', 1, 'end', 5, 'kind', 'ip'), named_struct('start', 3, 'end', 7, 'kind', 'phone'), named_struct('start', 8, 'end', 9, 'kind', 'term')) AS spans")
    assert pii.sanitise(docs, found).first().text == "a[IP]h[TERM]j"


def test_write_shards(spark):
    rows = [(k % 300, f"t{k}" if k % 5 else None, "s", k) for k in range(900)] + [(None, "", "s", -1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _shard string, part int")
    path = "file://" + tempfile.mkdtemp(prefix="spark-") + "/out"
    sharding.write_shards(docs, path, shards=4, files=2)
    got = spark.read.parquet(path).collect()
    assert sorted((r.doc_id or 0, r.text or "", r._shard, r.part) for r in got) == sorted((i or 0, t or "", s, p) for i, t, s, p in rows)
    assert all(r.shard == sharding.jump_hash(np.array([r.doc_id or 0], dtype=np.uint64), 4)[0] for r in got)
    with pytest.raises(ValueError):
        sharding.write_shards(docs, path + "2", folder="part")


@pytest.mark.parametrize("form", ["{}", "file:{}", "file://{}"])
def test_forms_of_the_shared_folder(spark, monkeypatch, form):
    """Token files and intermediate tables are written wherever spark.checkpoint.dir points, with or without a file system's name."""
    folder, real = tempfile.mkdtemp(prefix="spark-"), type(spark.conf).get
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *rest: form.format(folder) if key == "spark.checkpoint.dir" else real(self, key, *rest))
    docs = spark.createDataFrame([(2, "two words"), (1, None), (3, "three more words")], "doc_id long, text string")
    got = sorted(tuple(r) for r in tokens.tokenise_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).collect())
    assert [r[:3] for r in got] == [(1, 0, 1), (2, 1, 3), (3, 4, 4)]
    assert any(f.endswith(".bpz") for _, _, files in os.walk(folder) for f in files)


def test_shards_of_keys_that_are_no_numbers(spark):
    rows = [("a1", "x"), ("b", None), (None, "y"), ("7", "z"), ("a1", "x")]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id string, text string"), shards=4).collect()
    assert len(got) == 5 and len({r.shard for r in got if r.doc_id == "a1"}) == 1
    assert all(r.grown_shard in (r.shard, 4) for r in got)
    short = spark.createDataFrame([(5, "x"), (None, "y")], "doc_id smallint, text string")
    assert {r.doc_id: r.shard for r in sharding.assign_shards(short, shards=4).collect()} == {5: int(sharding.jump_hash(np.array([5], dtype=np.uint64), 4)[0]), None: int(sharding.jump_hash(np.array([0], dtype=np.uint64), 4)[0])}
