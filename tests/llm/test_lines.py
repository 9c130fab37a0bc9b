"""Chunk removal against a plain loop; boundaries that survive shifts."""

import random

from conftest import SF_SMALL
from lotline.llm import lines, queries
from lotline.llm.common import Stored

SF = SF_SMALL.replace("sf0.001", "sf0.01")


def plain(docs):
    """Keep the first of equal chunks, by (id, place), comparing their text."""
    seen, out = {}, {}
    for d, t in sorted(docs.items()):
        rows, gone = t.split("\n"), set()
        for a, b in zip(*(x.tolist() for x in lines.spans(t)[2:4])):
            if seen.setdefault("\n".join(rows[a:b]), (d, a)) != (d, a):
                gone |= set(range(a, b))
        out[d] = "\n".join(r for i, r in enumerate(rows) if i not in gone)
    return out


def test_query_equals_a_plain_loop(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want, rows = plain(docs), queries.QUERIES["op2_lines"](spark, SF).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: r.text for r in rows} == want
    for r in rows:
        assert r.n_removed_lines == (docs[r.doc_id].count("\n") - r.text.count("\n") + (not r.text and r.n_removed_lines > 0))
    assert sum(r.n_removed_chunks for r in rows) > 50


def test_passages_are_cut_alike_wherever_they_stand():
    rng = random.Random(2)
    line = lambda: " ".join(rng.choice("abcdefgh") * rng.randint(2, 7) for _ in range(9))
    passage = [line() for _ in range(30)]
    found = []
    for before in range(6):
        text = "\n".join([line() for _ in range(before)] + passage + [line() for _ in range(3)])
        found.append({c[0] for c in lines.chunks(text)[1]})
    shared = set.intersection(*found)
    assert len(shared) >= 6
    covered = sum(b - a for h, a, b, _, _ in lines.chunks("\n".join(passage))[1] if h in shared)
    assert covered >= len(passage) / 2


def test_chunks_tile_and_blank_lines_take_no_part():
    assert lines.chunks("")[1] == [] == lines.chunks("one line")[1] == lines.chunks("\n\n\n\n\n")[1]
    spans = [(a, b) for _, a, b, _, _ in lines.chunks("\n".join(f"line {i}" for i in range(50)))[1]]
    assert spans[0][0] == 0 and spans[-1][1] >= 48 and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
    whole = {x for k in range(lines.CHUNKINGS) for x in lines.chunks("\n".join(f"line {i}" for i in range(50)), k)[1]}
    every = set(zip(*(x.tolist() for x in lines.spans("\n".join(f"line {i}" for i in range(50)))[1:])))
    assert whole <= every and len({x[2] for x in every}) < 49  # rests of chunks end where chunks end


def test_nulls_repeats_extra_columns_and_no_rows(spark):
    t = "\n".join(f"a line of words {i}" for i in range(12))
    df = spark.createDataFrame([(1, t, 1), (1, t, 2), (2, "head\n" + t, 3), (3, None, 4), (4, "", 5), (None, t, 6)], "doc_id long, text string, id int")
    rows = lines.drop_repeated(df).collect()
    assert lines.drop_repeated(df).drop("__lines", "__gone_lines", "__gone_chunks").columns == ["doc_id", "id", "text"]
    by = {r.id: r for r in rows}
    assert len(rows) == 6 and by[6].text == t and by[4].text is None and by[5].text == ""
    assert by[1].text == by[2].text == ""
    assert "head" in by[3].text and len(by[3].text) < len(t)
    assert lines.drop_repeated(df.limit(0)).count() == 0


def repeated(docs):
    """By brute force: the lines (places) in runs of two or more lines that are
    not blank, with equal bytes, that also start earlier."""
    seen, gone = set(), {d: set() for d in docs}
    for d, t in sorted(docs.items()):
        rows = t.split("\n")
        for a in range(len(rows)):
            b = a + 1
            while rows[a] and b <= len(rows) and sum(map(bool, rows[a:b])) < 2:
                b += 1
            if not rows[a] or b > len(rows):
                continue
            if "\n".join(rows[a:b]) in seen:
                gone[d] |= set(range(a, b))
            seen.add("\n".join(rows[a:b]))
    return gone


def test_few_lines_of_repeated_runs_stay(spark):
    rng = random.Random(5)
    line = lambda: " ".join(str(rng.randint(0, 10**6)) for _ in range(6))
    docs = {}
    for i in range(40):  # passages of 2 to 9 lines, half of them with blank lines inside, in otherwise unique texts
        passage = [x for _ in range(2 + i % 8) for x in ([line(), ""] if i % 2 else [line()])]
        for d in (2 * i, 2 * i + 1):
            docs[d] = "\n".join([line() for _ in range(rng.randint(0, 4))] + passage + [line() for _ in range(rng.randint(1, 4))])
    for given in (docs, {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}):
        gone = repeated(given)
        made = {r.doc_id: r for r in lines.drop_repeated(spark.createDataFrame(list(given.items()), "doc_id long, text string")).collect()}
        assert sum(map(len, gone.values())) > 200
        stay = 0
        for d, t in given.items():
            assert made[d]["__gone_lines"] <= len(gone[d])  # nothing else goes
            stay += len(gone[d]) - made[d]["__gone_lines"]
        assert stay <= 0.1 * sum(map(len, gone.values()))


def test_columns_of_any_name_stay(spark):
    t = "\n".join(f"a line of words {i}" for i in range(12))
    names = ["__id", "__key", "__gone", "__lines", "__gone_lines", "__text", "id", "key", "first", "h"]
    df = spark.createDataFrame([(d, t if d < 3 else "x", *range(len(names))) for d in (1, 2, 3)], f"doc_id long, text string, {', '.join(f'{n} int' for n in names)}")
    rows = lines.drop_repeated(df).collect()
    assert all([r[n] for n in names] == list(range(len(names))) for r in rows) and sorted(r.text for r in rows) == ["", t, "x"]
    assert sorted(r[lines.number_names(df)[1]] for r in rows) == [0, 0, 12]


def test_texts_that_share_a_hash_are_told_apart(spark):
    seen = [(7, 1, 0, 0, 2, b"a\nb"), (7, 2, 0, 0, 2, b"c\nd"), (7, 3, 0, 1, 3, b"a\nb"), (7, 4, 0, 2, 4, b"c\nd"), (8, 4, 0, 0, 2, b"e\nf"), (8, 5, 0, 0, 2, b"e\nf"), (9, 5, 0, 3, 5, b"g\nh")]
    df = spark.createDataFrame(seen, "h long, id long, key long, first int, end int, chunk binary")
    gone = lines.later(df, Stored(spark, "lines"))
    assert sorted((r.id, r.first, r.end) for r in gone.collect()) == [(3, 1, 3), (4, 2, 4), (5, 0, 2)]


def test_lines_and_chunks_that_share_a_hash_are_compared_by_bytes(spark, monkeypatch):
    """With a clash reported for every chunk, the slow way gives the same texts."""
    rng = random.Random(8)
    passage = "\n".join(f"line {rng.random()}" for _ in range(8))
    docs = [(i, f"head {i}\n{passage}\n\ntail {i}\nend {rng.random()}") for i in range(12)] + [(20, passage), (21, "x\n" + passage)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    fast = sorted((r.doc_id, r.text) for r in lines.drop_repeated(df).collect())
    rows = lines._keyed(df)
    x = lines.Lines([t for _, t in docs])
    hashes = sorted(set(x.spans(*x.chunks())[0].tolist()))
    seen = lines._clashing(rows, hashes)
    gone = lines.later(seen, Stored(spark, "lines")).collect()
    lost = {}
    for r in gone:
        lost.setdefault(r.id, set()).update(range(r.first, r.end))
    slow = sorted((d, "\n".join(v for i, v in enumerate(t.split("\n")) if i not in lost.get(d, ()))) for d, t in docs)
    assert fast == slow and lost
