"""Every stage on what the one before kept, against plain versions."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import SF_SMALL
from test_jaccard import plain as plain_components
from test_lines import plain as plain_lines

SF = SF_SMALL.replace("sf0.001", "sf0.01")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, SF)
        if k < 4:
            assert made.columns == columns
        made.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = docs.collect()
    before = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    # quality: bad documents go, good ones stay as they are
    after = {r.doc_id: r for r in kept["quality"]}
    assert all(after[d] == before[d] for d in after)
    assert np.mean([(d in after) == (q == 1) for d, q in labels.items()]) > 0.97
    # lines: as a plain loop
    want = plain_lines({d: r.text or "" for d, r in after.items()})
    got = {r.doc_id: r for r in kept["lines"]}
    assert {d for d in after if d not in got} == {d for d, t in want.items() if not t.strip() and (after[d].text or "").strip()}
    assert all(r.text == want[d] and r.n_chars == len(r.text) for d, r in got.items())
    # jaccard: one document of each component, and no link is left
    parts = plain_components({d: r.text for d, r in got.items()}, 80, 100, 5)
    one = {r.doc_id for r in kept["jaccard"]}
    assert len(kept["jaccard"]) == len(one) == len({c for _, c in parts.values()})
    assert one == {c for _, c in parts.values()}
    # mixing: every document stays, some more than once, rarer languages more often
    times = {}
    for r in kept["mixing"]:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert set(times) == one and max(times.values()) <= 4
    share = lambda rows, lang: sum(len(r.text.split()) for r in rows if r.lang == lang) / sum(len(r.text.split()) for r in rows)
    assert share(kept["mixing"], "en") < share(kept["jaccard"], "en") and share(kept["mixing"], "es") > share(kept["jaccard"], "es")
    # bpe: as the library
    theirs = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {r.doc_id: r.text for r in kept["mixing"]}
    assert len(kept["bpe"]) == len(kept["mixing"])
    for r in kept["bpe"][::7]:
        ids = theirs.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and np.frombuffer(bytes(r.ids), dtype="<u4").tolist() == ids


def test_empty_and_null_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0)], docs.schema)
    for given in (docs.limit(0), docs.limit(60).unionByName(odd)):
        for name, stage in corpus_pipeline.STAGES:
            given = stage(spark, given, SF_SMALL)
        assert given.count() >= 0


def test_workers_get_few_rows_at_once(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    try:
        for given, want in (("10000", "2000"), ("0", "2000"), ("500", "500")):
            spark.conf.set(name, given)
            corpus_pipeline.bpe_stage(spark, docs, SF)
            assert spark.conf.get(name) == want
    finally:
        spark.conf.set(name, before)
