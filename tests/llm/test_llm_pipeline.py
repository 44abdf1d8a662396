"""The pipeline's stages take effect, one after another, on documents made for it."""

import os
import uuid

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from gondola.llm import secret_scan


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    items = pq.read_table("/root/testdata/sf0.001/benchmark.parquet")
    rows = base.to_pylist()
    text = next(r["text"] for r in rows if 800 < len(r["text"]) < 3000 and not secret_scan.spans_of(r["text"]))
    item = items["text"][0].as_py()
    rows += [
        {"doc_id": 9001, "text": "12345 ... 678", "lang": None, "source": "x", "n_chars": 13},
        {"doc_id": 9002, "text": None, "lang": "en", "source": None, "n_chars": None},
        {"doc_id": 9003, "text": text, "lang": "en", "source": "copy", "n_chars": len(text)},
        {"doc_id": 9004, "text": text[::-1][:400] + " " + item + " and more of it", "lang": "en", "source": "x", "n_chars": 1},
        {"doc_id": 9005, "text": "The the of and that in one api_key = abcdef0123456789 over the thing is", "lang": "en",
         "source": "x", "n_chars": 1}]
    out = tmp_path_factory.mktemp("docs")
    pq.write_table(pa.Table.from_pylist(rows, base.schema), out / "documents.parquet")
    pq.write_table(items, out / "benchmark.parquet")
    return str(out)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    keys = {"start": {r.doc_id for r in docs.collect()}}
    out = f"{os.path.dirname(folder)}/{uuid.uuid4()}"
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, folder)
        if name != "encode":
            assert got.columns == docs.columns and got.dtypes == docs.dtypes
        got.write.parquet(f"{out}/{name}")
        before, docs = docs, spark.read.parquet(f"{out}/{name}")
        keys[name] = {r.doc_id for r in docs.collect()}
        if name == "secrets":
            texts = {r.doc_id: r.text for r in docs.collect()}
            counts = {r.doc_id: r.n_chars for r in docs.collect()}
    assert {9001, 9002} & keys["language_id"] == set() and 9003 in keys["language_id"]
    assert 9003 not in keys["near_duplicates"] and 9004 in keys["near_duplicates"]
    assert 9004 not in keys["decontaminate"] and 9005 in keys["decontaminate"]
    assert "abcdef0123456789" not in texts[9005] and counts[9005] == len(texts[9005])
    assert keys["encode"] == keys["secrets"] == keys["decontaminate"]
    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for row in docs.limit(20).collect():
        assert row.ids == known.encode(texts[row.doc_id], add_special_tokens=False).ids == row.ids
        assert row.n_tokens == len(row.ids)
    # Clean documents stay: all that go are rejected, copies or contaminated.
    assert len(keys["decontaminate"]) > 0.8 * len(keys["start"])


def test_run_gives_the_last_stage(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    assert rows.columns == ["doc_id", "n_tokens", "ids"] and rows.count() > 100
