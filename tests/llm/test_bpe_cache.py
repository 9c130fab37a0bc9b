"""What a worker keeps of encoded words is bounded, and has no part in the ids."""

import public_tokenizers

from lotline.llm import bpe


def test_a_worker_keeps_few_words():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        text = f.read()
    coder, fresh = bpe.WordBpe(text), bpe.WordBpe(text)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(31_000)]
    ids = [coder.encode(w) for w in words]
    assert len(set(words)) == 31_000 and len(coder.cache) <= 30_000 and len(coder.chunks) <= 30_000
    assert [fresh.encode(w) for w in words[:50] + words[-50:]] == ids[:50] + ids[-50:]


def test_frequent_words_are_merged_once():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        coder = bpe.WordBpe(f.read())
    merged, merge = [], coder.merge
    coder.merge = lambda parts: merged.append(1) or merge(parts)
    for i in range(31_000):
        coder.encode(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}")
        if i % 100 == 0:
            coder.encode("frequently")
    assert len(merged) == 31_001
    tables = [coder.cache, *coder.old_cache, coder.chunks, coder.old_chunks]
    assert max(map(len, tables)) <= 30_000 and len(tables) <= 6
