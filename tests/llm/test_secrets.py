"""Secrets against plain Python on written and drawn texts."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from lotline.llm import queries, secrets

RULES = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
         ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24))


def base(text):
    return sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(RULES) for m in p.finditer(text) if ok(m))


def bits(window):
    return -sum(c / len(window) * math.log2(c / len(window)) for c in Counter(window).values())


def random_looking(v):
    for i in range(len(v) - 19):
        w = v[i: i + 20]
        digits, low, up = (sum(c in a for c in w) for a in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        if re.fullmatch("[0-9a-f]*|[0-9A-F]*", w):
            least = 3.0
        else:
            least = 3.5 if digits + low == 20 or digits + up == 20 else 3.75
        if digits >= 2 and low + up >= 2 and bits(w) >= least - 1e-9:
            return True
    return False


def spans(text, allowed=()):
    b = base(text)
    out = list(b)
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        v = m[0]
        harmless = any(re.search(p, v) for p in secrets.ALLOWED) or not re.search("[A-Za-z][0-9]|[0-9][A-Za-z]", v) or v in allowed
        if not harmless and random_looking(v) and not any(s < m.end() and e > m.start() for s, _, e in b):
            out.append((m.start(), 3, m.end()))
    return b, sorted(out)


def drawn(rng):
    hexa, b64 = "0123456789abcdef", secrets.ALPHABET
    kinds = [lambda: "".join(rng.choices(hexa, k=rng.randint(15, 60))), lambda: "".join(rng.choices(b64, k=rng.randint(10, 70))),
             lambda: "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=rng.randint(0, 30))),
             lambda: rng.choice(["password", "Api_Key", "TOKEN", "secret", "mytoken"]) + rng.choice(["=", " : ", "' = '", ":", " "]),
             lambda: rng.choice(["word", "étude", "🙂", "\n", " ", "token: token: abcdefgh", "example-key-12ab34cd56ef78gh90ij", "one-two-three-four-2024-five", "."])]
    return "".join(rng.choice(kinds)() + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randint(0, 60)))


def test_equals_plain_python(spark):
    rng = random.Random(5)
    texts = [None, "", "a", "\n", *(drawn(rng) for _ in range(300))]
    texts.append(" ".join(drawn(rng) for _ in range(60)))  # more spans than a block of the running sums
    assert len(spans(texts[-1])[1]) > 2 * secrets._BLOCK
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[5], rows[5]], "doc_id long, text string, spans string").withColumn("base", F.lit(1)).withColumn("__both", F.lit(1))
    got = secrets.find_secrets(df).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        b, every = spans(texts[r.doc_id] or "")
        assert [tuple(s) for s in r.base] == b and [tuple(s) for s in r.spans] == every, r.text
    assert any(len(r.spans) > len(r.base) for r in got)


def test_added_spans_catch_random_strings_and_leave_words_alone(spark):
    rng = random.Random(8)
    b64 = secrets.ALPHABET[:62]
    planted = ["".join(rng.choices(b64, k=40)) for _ in range(200)]
    clean = ["Donaudampfschifffahrtsgesellschaft", "getElementByIdentifierAndClassName", "a/path/to/some/file/of/2024/03/17", "123e4567-e89b-12d3-a456-426614174000",
             "0049-30-1234567-0000000000000", "YOUR_API_KEY_1a2b3c4d5e6f7g8h9i0j", "DE89370400440532013000", "-----------------------1a2b"]
    df = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(planted + clean)], "doc_id long, text string")
    found = {r.doc_id: [s for s in r.spans if s.kind == 3] for r in secrets.find_secrets(df).collect()}
    caught = [i for i in range(200) if found[i]]  # the rest have fewer than two digits in each window
    assert len(caught) >= 190 and all([(s.start, s.end) for s in found[i]] == [(4, 44)] for i in caught)
    assert not any(found[200 + i] for i in range(len(clean)))
    some = planted[caught[0]]
    assert not secrets.find_secrets(df.where(f"doc_id = {caught[0]}"), allowed=[some]).first().spans


def test_empty_table(spark):
    assert secrets.find_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_over_the_whole_table(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = queries.op13_secrets(spark, SF_SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        b, every = spans(docs[r.doc_id])
        text = lambda x: ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in x)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for _, k, _ in b) for n in range(3)]
        assert r.base_sha256 == hashlib.sha256(text(b).encode()).hexdigest() and r.spans == text(every)


def test_no_python_in_the_plan(spark):
    plan = queries.op13_secrets(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and not any(x in plan for x in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running_sums_in_blocks(spark, n):
    values = [(i * 37) % 11 for i in range(n)]
    df = spark.createDataFrame([(values,)], "v array<long>")
    got = df.select(secrets.running(F.col("v"), 0, secrets._add).alias("s"), secrets.running(F.col("v"), -1, secrets._most).alias("m")).first()
    assert got.s == [sum(values[: i + 1]) for i in range(n)] and got.m == [max(values[: i + 1]) for i in range(n)]
