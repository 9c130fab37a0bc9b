"""Base spans against the plain patterns; votes, reliabilities and added spans on planted cases."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF_SMALL
from lotline.llm import pii, queries


def plain(text):
    """The contract's patterns, run as they stand."""
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a_%.@+-1250 ()é\n", max_size=60))
def test_base_spans_equal_the_plain_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_base_spans_on_chosen_texts():
    for t in ["", "a@b.c_d@e.f", "x@@y.z", "1.2.3.4.5.6.7.8", "999.1.2.3.4", "0001.02.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112",
              "+1 (017) 555-7713!", "+12", "é 10.0.0.1", "@" * 50, "1" * 300 + ".1.1.1", "a." * 500 + "@b.c", "+1" * 40]:
        assert pii.base_spans(t) == plain(t)
    long = "7" * 200_000 + " " + "a" * 200_000 + "@x.org"
    assert [s[0] for s in pii.base_spans(long)] == [0]


def test_reliable_labelers_are_found():
    rng = np.random.default_rng(5)
    truth = rng.random(4000) < 0.6
    right = [0.95, 0.8, 0.7, 0.55]
    votes = np.stack([np.where(rng.random(4000) < r, truth, ~truth) * 2 for r in right], axis=1)
    code = (votes @ 3 ** np.arange(3, -1, -1)) * pii.SHAPES
    kinds = rng.integers(0, 4, 4000)
    pairs, n = np.unique(np.stack([kinds, code]), axis=1, return_counts=True)
    post, table = pii.reliabilities(pairs[0], pairs[1], n.astype(float))
    assert table[1, 0, 2] > table[1, 1, 2] > table[1, 3, 2]
    at = {tuple(p): x for p, x in zip(pairs.T, post)}
    assert np.mean([(at[k, c] > 0.5) == t for k, c, t in zip(kinds, code, truth)]) > 0.93


def test_query_over_the_given_table(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = queries.QUERIES["op7_pii"](spark, SF_SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = plain(docs[r.doc_id])
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[0] == k for w in want) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_added_spans_nulls_and_no_rows(spark):
    rows = [(i, f"mail me{i}@site{i}.org or call +1 (212) 555-01{i:02d} from 10.1.2.{i}", "x") for i in range(40)]
    rows += [(100 + i, f"write to joe{i} [at] site [dot] com today", "x") for i in range(10)] + [(200, None, None), (201, "", None), (200, None, None)]
    rows += [(300 + i, f"version 1234567890123{i} of the order", "x") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = {r.doc_id: r for r in pii.find_pii(df).collect()}
    assert len(out[0].base) == 3 and [s.kind for s in out[0].base] == [0, 1, 3]
    assert len(out[105].base) == 0 and [s.kind for s in out[105].spans] == [0]
    assert out[200].spans == [] == out[201].spans == out[300].spans
    assert pii.find_pii(df).count() == len(rows)
    assert pii.find_pii(df.limit(0)).count() == 0


def test_spelled_addresses_in_any_case_are_tried():
    for t in ("ann [AT] mail [DOT] org", "ann (At) mail.org", "ann at mail.org"):
        assert (0, 0, len(t)) in pii.wider_spans(t, [])


def test_overlapping_readings_are_all_judged(spark):
    t = "call 00 44 20 7946 0958 now"
    assert {(2, 5, 23), (3, 5, 23)} <= set(pii.wider_spans(t, []))
    rows = [(1, [(2, 5, 23), (3, 5, 23), (3, 8, 23), (0, 23, 30)]), (2, [(3, 4, 9), (2, 0, 6), (0, 6, 8)]), (3, [])]
    df = spark.createDataFrame(rows, "id int, spans array<struct<kind:int,start:int,end:int>>")
    got = {r.id: [tuple(s) for s in r.s] for r in df.select("id", pii.settled(F.col("spans")).alias("s")).collect()}
    assert got == {1: [(2, 5, 23), (0, 23, 30)], 2: [(2, 0, 6), (0, 6, 8)], 3: []}
    # the card reading fails its check, the phone reading of the same span is taken
    phones = [(i, f"Please call phone 00 44 20 79{40 + i % 50} 0{958 + i % 40} now") for i in range(300)]
    phones += [(1000 + i, f"order id {i % 9}{i % 7}00 {1000 + i} 1234 {5000 + i} of page") for i in range(300)]
    found = pii.find_pii(spark.createDataFrame(phones, "doc_id long, text string")).where("doc_id < 1000").collect()
    kinds = [s.kind for r in found for s in r.spans]
    assert kinds.count(3) > 200
