"""BPE against the vocabulary's own library, on hand-made and given texts."""

import hashlib

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from conftest import SF_SMALL
from lotline.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", "x", "Hello'S  WORLD's I'll 123 <|endoftext|>Foo<|startoftext|>", "ΑΣ ΟΔΟΣ İstanbul ﬁ é é",
         "a\x1cb a\x85b ​ 　 日本語 👍🏽 !!!?..", "a" * 5000 + " " + "ab" * 300 + "é" * 2000, "the " * 20_000]


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(PATH)


def test_ids_and_text_equal_the_library(theirs):
    own = bpe.WordBpe(open(PATH, encoding="utf-8").read())
    for t in TEXTS:
        want = theirs.encode(t, add_special_tokens=False).ids
        got = np.frombuffer(own.encode(t), dtype="<u4").tolist()
        assert got == want
        assert own.decode(got) == theirs.decode(want, skip_special_tokens=False)


def test_scan_and_heap_merge_alike():
    own = bpe.WordBpe(open(PATH, encoding="utf-8").read())
    for w in ["thinginging" * 5, "aaaaaaaaaaaaaaa", "mississippi" * 4, "éèêéèê" * 6]:
        raw = w.encode()
        parts = [own.inner[b] for b in raw[:-1]] + [own.last[raw[-1]]]
        assert own._scan(list(parts)) == own._heap(list(parts))


def test_query_over_the_given_table(spark, theirs):
    rows = queries.QUERIES["op6_bpe"](spark, SF_SMALL).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        ids = theirs.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_repeats_extra_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, "", "b"), (2, "x y", None), (2, "x y", None)], "doc_id long, text string, ids string")
    out = bpe.encode_documents(df, PATH)
    assert out.columns == ["doc_id", "text", "ids"]
    assert sorted(len(r.ids) for r in out.collect()) == [0, 0, 8, 8]
    assert bpe.encode_documents(df.limit(0), PATH).count() == 0
