"""Personal data by weak supervision.

Base spans (email, ip, card, phone) follow fixed patterns and always stay.
Wider candidates (addresses spelled out, numbers without a plus sign or with
other separators, long addresses) are judged by votes of four labelers:

* regex: the base pattern and its checks hold, or nearly,
* gazetteer: domain endings, calling codes, issuer digits, reserved networks,
* context: words before the span that name or rule out the kind,
* shape: what touches the span, and its length.

``find_candidates`` is one map over whole texts. The votes and a few features
of a candidate form one of a bounded number of patterns (``PATTERNS`` a
kind), so counts of patterns over ALL documents say everything about the
corpus that training needs: expectation-maximisation over them estimates each
labeler's reliability and each pattern's posterior, and a logistic span
classifier is fitted to those posteriors. No row is sampled and no text leaves
its row; the driver sees only the pattern counts.

Null and empty texts have no spans. Rows are independent: repeated rows give
repeated results; other columns are not looked at. With no candidate at all
the classifier adds nothing.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotline.llm.common import Stored, ship, slices, texts

KINDS = ["email", "ip", "card", "phone"]
VOTES = 4
SHAPES = 8  # three features of a candidate, besides the votes
PATTERNS = 3**VOTES * SHAPES
CONTEXT_CHARS = 48

# Fixed patterns of the base spans.
_NAME = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# (a run of digits never starts in the middle of one that has failed, so looking back is safe)
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Wider patterns.
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: ?[\[(]at[\])] ?| at )[A-Za-z0-9-]{1,63}(?:(?: ?[\[(]dot[\])] ?| dot |\.)[A-Za-z0-9-]{2,63}){1,4}", re.I)
_AT = re.compile(r"[\[(]at[\])]| at ", re.I)  # every match of _SPELLED holds one
_IP6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:.])")
_LOCAL = re.compile(r"(?<![0-9A-Za-z+.,-])(?:00 ?[1-9][0-9]{0,2}[ .-])?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z]|[.,-][0-9])")
_DOTTED_CARD = re.compile(r"(?<![0-9.])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9])")

# Fixed word lists of the gazetteer and context labelers.
ENDINGS = set("com org net edu gov mil int info biz io dev app eu de fr es it uk us ca au ch at nl be se no dk fi pl pt ru jp cn br in mx".split())
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 94 98".split()
NAMING = {
    "email": "email e-mail mail contact write correo courriel schreiben".split(),
    "ip": "ip address host server client login dirección adresse".split(),
    "card": "card visa mastercard amex credit debit payment tarjeta carte karte".split(),
    "phone": "phone tel telephone call mobile cell fax teléfono téléphone telefon".split(),
}
RULING_OUT = "version isbn issn doi order invoice sku ref id serial page pages section chapter release build".split()


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches, found from each sign: the run of name characters
    before it (not reaching into the match before) and a domain after it."""
    pos, at = 0, text.find("@")
    while at >= 0:
        head = text[pos:at]
        start = pos + len(head.rstrip(_NAME))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            pos = found.end()
        else:
            pos = at + 1
        at = text.find("@", pos)


_DIGIT = re.compile("[0-9]")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every base span, by kind and start (code points)."""
    out = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return out


def wider_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates beyond the base spans, none overlapping one of those. They may
    overlap each other: every reading is judged (see ``settled``)."""
    out = []
    if _AT.search(text):
        out += [(0, m.start(), m.end()) for m in _SPELLED.finditer(text)]
    if _DIGIT.search(text):
        if text.count(":") >= 7:
            out += [(1, m.start(), m.end()) for m in _IP6.finditer(text)]
        for m in _CARD.finditer(text):
            if 13 <= m.end() - m.start() <= 40 and 13 <= sum(c not in " -" for c in m.group()) <= 19:
                out.append((2, m.start(), m.end()))
        out += [(2, m.start(), m.end()) for m in _DOTTED_CARD.finditer(text)]
        out += [(3, m.start(), m.end()) for m in _LOCAL.finditer(text)]
    taken = sorted((s, e) for _, s, e in base)
    return sorted({(k, s, e) for k, s, e in out if all(e <= a or b <= s for a, b in taken)}, key=lambda x: (x[1], -x[2], x[0]))


def pattern(text: str, kind: int, start: int, end: int, base: bool) -> int:
    """The votes (0 against, 1 none, 2 for) and shape of a candidate as one number."""
    span, name = text[start:end], KINDS[kind]
    digits = re.sub("[^0-9]", "", span)
    if base:
        regex_vote = 2
    elif name == "card":
        regex_vote = 2 if len(digits) >= 13 and _luhn(digits) else 0
    elif name == "email":
        regex_vote = 2 if re.search(r"[\[(](?:at|dot)[\])]", span, re.I) else 1
    else:
        regex_vote = 1
    if name == "email":
        gazetteer = 2 if re.split(r"[^A-Za-z0-9]+", span.rstrip(")]"))[-1].lower() in ENDINGS else 0
    elif name == "ip":
        gazetteer = 0 if re.match(r"(0|127|255)\.", span) else 2 if "." in span else 1
    elif name == "card":
        gazetteer = 2 if digits[:1] in "3456" else 0
    else:
        gazetteer = (2 if any(digits.startswith(c) for c in CALLING) else 0) if span[0] == "+" else 1
    before = re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)?", text[max(0, start - CONTEXT_CHARS): start].lower())[-4:]
    context = 2 if any(w in NAMING[name] for w in before) else 0 if any(w in RULING_OUT for w in before) else 1
    touching = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    usual = {"email": 6 <= end - start <= 64, "ip": 7 <= end - start <= 39, "card": len(digits) in (15, 16), "phone": 9 <= len(digits) <= 13}[name]
    shape_vote = 0 if touching else 2 if usual else 1
    votes = ((regex_vote * 3 + gazetteer) * 3 + context) * 3 + shape_vote
    return votes * SHAPES + touching * 4 + (end - start > 20) * 2 + (text[end: end + 1].isspace() or end == len(text))


def find_candidates(docs: DataFrame) -> DataFrame:
    """doc_id and an array of (kind, start, end, base, pattern), base spans first."""
    ship(docs.sparkSession)
    entry = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("pattern", pa.int32())])

    def run(batches):
        for b in slices(batches):
            rows = []
            for t in b.column(1).to_pylist():
                base = base_spans(t)
                rows.append([{"kind": k, "start": s, "end": e, "base": own, "pattern": pattern(t, k, s, e, own)}
                             for own, found in ((True, base), (False, wider_spans(t, base))) for k, s, e in found])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(entry))], names=["doc_id", "spans"])

    return texts(docs).mapInArrow(run, "doc_id long, spans array<struct<kind:int,start:int,end:int,base:boolean,pattern:int>>")


def _features(kind: np.ndarray, code: np.ndarray) -> np.ndarray:
    votes, shape = code // SHAPES, code % SHAPES
    cols = [np.ones(len(code))] + [(kind == k).astype(float) for k in range(len(KINDS))]
    for i in range(VOTES):
        v = votes // 3 ** (VOTES - 1 - i) % 3
        cols += [(v == 2).astype(float), (v == 0).astype(float)]
    cols += [(shape >> i & 1).astype(float) for i in range(3)]
    return np.stack(cols, axis=1)


def reliabilities(kind: np.ndarray, code: np.ndarray, count: np.ndarray, rounds: int = 60):
    """Expectation-maximisation over pattern counts: for each class a vote
    distribution of each labeler, a prior for each kind. Returns the posterior
    of each pattern and the table of vote probabilities [class, labeler, vote]."""
    votes = np.stack([code // SHAPES // 3 ** (VOTES - 1 - i) % 3 for i in range(VOTES)], axis=1)
    table = np.tile(np.array([[0.5, 0.35, 0.15], [0.1, 0.3, 0.6]])[:, None, :], (1, VOTES, 1))
    prior = np.full(len(KINDS), 0.5)
    post = np.full(len(code), 0.5)
    for _ in range(rounds):
        like = np.stack([np.log(table[c, np.arange(VOTES), votes]).sum(axis=1) for c in (0, 1)], axis=1)
        odds = like[:, 1] - like[:, 0] + np.log(prior[kind] / (1 - prior[kind]))
        post = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        for c, w in ((0, count * (1 - post)), (1, count * post)):
            for i in range(VOTES):
                for v in range(3):
                    table[c, i, v] = w[votes[:, i] == v].sum() + 1.0  # a vote of each sort in advance
            table[c] /= table[c].sum(axis=1, keepdims=True)
        for k in range(len(KINDS)):
            n = count[kind == k].sum()
            prior[k] = ((count * post)[kind == k].sum() + 1.0) / (n + 2.0)
    return post, table


def fit_span_classifier(counts: list[tuple[int, int, int]], steps: int = 200):
    """Weights of a logistic classifier fitted to the posteriors of pattern
    counts (kind, pattern, count), by Newton steps with a small ridge."""
    if not counts:
        return None
    kind, code, count = (np.array(x) for x in zip(*sorted(counts), strict=True))
    post, _ = reliabilities(kind, code, count.astype(float))
    x, w = _features(kind, code), count / count.sum()
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (p - post)) + 1e-4 * beta
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def accepted(beta) -> list[int]:
    """kind * PATTERNS + pattern of every pattern that the classifier takes."""
    if beta is None:
        return []
    kind, code = np.divmod(np.arange(len(KINDS) * PATTERNS), PATTERNS)
    return np.flatnonzero(_features(kind, code) @ beta > 0).tolist()


SETTLED = 256  # spans settled into one list before it goes behind the others


def settled(spans) -> F.Column:
    """Of spans that overlap, the one that starts first stays; of those, the
    longest; then the first kind. Lists grow by blocks, so n spans cost some n * ``SETTLED`` steps."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    none = F.filter(order, lambda s: F.lit(False))

    def take(done, s):
        free = (-done["back"]) <= s["start"]
        return F.struct(F.when(free, s["back"]).otherwise(done["back"]).alias("back"), F.when(free, F.concat(done["kept"], F.array(s))).otherwise(done["kept"]).alias("kept"))

    def block(done, some):
        made = F.array(F.aggregate(some, F.struct(done["back"].alias("back"), none.alias("kept")), take))  # in an array, so that it is computed once
        return F.element_at(F.transform(made, lambda m: F.struct(m["back"].alias("back"), F.concat(done["kept"], m["kept"]).alias("kept"))), 1)

    last = F.greatest(F.ceil(F.size(order) / SETTLED).cast("int") - 1, F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(order, i * SETTLED + 1, SETTLED))
    kept = F.aggregate(blocks, F.struct(F.lit(0).alias("back"), none.alias("kept")), block, lambda done: done["kept"])
    return F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), (-s["back"]).alias("end")))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end), each by kind and
    start; spans holds the base ones and what the classifier adds."""
    kept = Stored(docs.sparkSession, "pii").put(find_candidates(docs), "candidates")
    one = kept.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.pattern").count()
    beta = fit_span_classifier([tuple(r) for r in one.collect()])  # at most len(KINDS) * PATTERNS rows
    taken = F.array(*[F.lit(c) for c in accepted(beta)]).cast("array<int>")
    thin = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    base = F.transform(F.filter("spans", lambda s: s["base"]), thin)
    added = F.filter("spans", lambda s: ~s["base"] & F.array_contains(taken, s["kind"] * PATTERNS + s["pattern"]))
    return kept.select("doc_id", F.array_sort(base).alias("base"), F.array_sort(F.concat(base, settled(added))).alias("spans"))


def spans_text(spans) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
