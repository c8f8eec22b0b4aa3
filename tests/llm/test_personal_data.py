"""op13: base spans against the contract's own patterns, further kinds, scores and odd input."""

from __future__ import annotations

import hashlib
import random
import re
import time

import pytest

from quarry.llm import personal_data as pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text: str) -> list[tuple[int, str, int]]:
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))) or (kind == "card" and 12 <= len(digits) <= 19 and _luhn(digits)) or (kind == "phone" and 9 <= len(digits) <= 15):
                out.append((m.start(), list(PATTERNS).index(kind), m.end(), kind))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(5)
    tokens = ["1", "0", "4", "25", ".", "@", "a", "_", "-", " ", "+", "(", ")", "255", "4111111111111111", "é", "a@b.c", "1.2.3.4", "+1 (2"]
    found = 0
    for _ in range(30000):
        text = "".join(rng.choice(tokens) for _ in range(rng.randint(0, 25)))
        got = [(f.start, f.rank, f.end, pii.KINDS[f.rank].name) for f in pii.spans_of(text) if f.rank < 4]
        assert got == brute(text), text
        found += len(got)
    assert found > 10000


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("IBAN DE89 3704 0044 0532 0130 00 please", ["iban"]),
        ("IBAN DE89 3704 0044 0532 0130 01 please", []),  # mod-97 fails
        ("GB29NWBK60161331926819X", []),  # longer than its country's
        ("ssn 123-45-6789", ["ssn"]),
        ("part 123-45-6789", []),  # no word says so
        ("ssn 000-45-6789", []),
        ("call (030) 1234 567", ["local_phone"]),
        ("(030) 1234 567", []),
        ("4111111111111111 5500005555555559", ["split_card", "split_card"]),
        ("4111111111111112 5500005555555558", []),
        ("host 2001:db8::8a2e:370:7334 up", ["ipv6"]),
        ("at 12:30:45 std::vector a::b", []),
        ("call +1 (017) 555-7713", ["phone"]),  # the base span stands, nothing is added within it
        ("version 1.2.3.4", ["ip"]),  # base spans stay whatever their score
    ],
)
def test_kinds_and_context(text, kinds):
    assert [pii.KINDS[f.rank].name for f in pii.spans_of(text)] == kinds


def test_context_moves_the_score():
    score = lambda text: pii.spans_of(text)[0].score
    assert score("order 4111111111111111") < score("4111111111111111") < score("card 4111111111111111")


@pytest.mark.parametrize("unit", ["a", "1", "1.", "a@", "+1(", "12-", "A", "DE12 ", ":", "(12) "])
def test_linear(unit):
    began = time.perf_counter()
    pii.spans_of(unit * (400_000 // len(unit)))
    assert time.perf_counter() - began < 20


def test_query_columns_and_odd_rows(spark):
    texts = ["x@y.zz and 1.2.3.4, é +44 20 7946 0958", None, "", "x@y.zz and 1.2.3.4, é +44 20 7946 0958", "call 4111-1111-1111-1111"]
    docs = spark.createDataFrame([(i if i != 4 else None, t, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, spans string, kind string")
    found = pii.personal_data(docs)
    rows = {(r["doc_id"], r["text"]): r for r in found.collect()}
    assert len(rows) == 5
    for (_, text), r in rows.items():
        assert [(s["start"], s["kind"], s["end"]) for s in r["spans"] if s["base"]] == [(s, k, e) for s, _, e, k in brute(text or "")]
    assert pii.masked(found).where("doc_id = 0").head()["text"] == "[email] and [ip], é [phone]"
    assert pii.masked(found).where("doc_id = 1").head()["text"] is None
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark, sf):
    got = {r["doc_id"]: r for r in pii.op13_pii(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        want = brute(d["text"] or "")
        r = got[d["doc_id"]]
        listed = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == kind for *_, k in want) for kind in PATTERNS]
        assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))
