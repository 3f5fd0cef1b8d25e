"""The pipeline's stages one after the other, each against brute force on what it was given."""

import itertools
import zlib

import corpus_pipeline

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from test_near_copies import alike, roots, sets_of
from trajframe.llm import decontaminate, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        seen[name] = (docs, rows)
        if name != "token_files":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = spark.createDataFrame(rows, docs.schema)
    given, kept = seen["toxicity"]
    bad = {r.doc_id for r in toxicity.severity(given, toxicity.train(given, spark.read.parquet(f"{SF}/labels.parquet"))).collect() if r.rejected}
    assert {r.doc_id for r in kept} == {r.doc_id for r in given.collect()} - bad
    given, kept = seen["simhash_near_dedup"]
    sets = {r.doc_id: sets_of(r.text) for r in given.collect()}
    assert {r.doc_id for r in kept} == roots(sets, [p for p in itertools.combinations(sets, 2) if alike(sets[p[0]], sets[p[1]])])
    given, kept = seen["decontamination"]
    leaked = {r.doc_id for r in decontaminate.overlaps(given, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in kept} == {r.doc_id for r in given.collect()} - leaked
    given, kept = seen["mixing"]
    assert {r.doc_id for r in kept} == {r.doc_id for r in given.collect()} and len(kept) > given.count()
    given, out = seen["token_files"]
    t, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    rows = sorted(given.collect(), key=lambda r: r.doc_id)
    for doc, r in zip(rows, sorted(out, key=lambda r: r.start), strict=True):
        ids = np.array([*t.encode(doc.text, add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_stages_take_odd_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars int, kept_doc_id int, mix_at int, want int"
    odd = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c d"), (5, "x" * 50_000), (6, "word " * 20_000), (7, "a b"), (8, "é ß\n漢字")]
    for rows in ([(i, t, None, None if i == 6 else "s", None, 1, 2, 3) for i, t in odd], []):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "token_files":
                assert out.columns == docs.columns, name
                docs = spark.createDataFrame(out.collect(), docs.schema)
                assert all((r.kept_doc_id, r.mix_at, r.want) == (1, 2, 3) for r in docs.collect())
            else:
                assert out.count() == docs.count()
        assert {r.doc_id for r in docs.collect()} == ({None, 1, 3, 5, 6, 8} if rows else set())
