"""Registered queries over whole tables and texts, against plain brute-force versions."""

from __future__ import annotations

from itertools import combinations

import pyarrow as pa
import pyarrow.parquet as pq


def test_blocking_reads_every_part(spark, tmp_path):
    from quarry.plans.resolution import tier2_blocking

    size, thing = ["large", "small", "cold", "hot", "old"], ["ring", "bolt", "plate"]
    parts = [(k, f"{size[k % 5]} {thing[k % 3]}", f"Brand#{k % 11}") for k in range(380, 460)] + [(k, f"odd{k} {size[k % 5]}", "Brand#1") for k in range(9_000, 9_030)]
    pq.write_table(pa.table({"p_partkey": [p[0] for p in parts], "p_name": [p[1] for p in parts], "p_brand": [p[2] for p in parts]}), tmp_path / "part.parquet")
    rows = [(f"part:{k}", f"{n} {b}".lower(), k % 45 if k % 9 == 0 else None) for k, n, b in parts]
    grams = lambda s: {f"  {s} "[i : i + 3] for i in range(len(s) + 1)}
    jaccard = lambda a, b: len(a & b) / len(a | b)
    want = {}
    for (r1, n1, d1), (r2, n2, d2) in combinations(sorted(rows), 2):
        score = max(jaccard(set(n1.split()), set(n2.split())), jaccard(grams(n1), grams(n2)), 0.9 if d1 is not None and d1 == d2 else 0)
        if score >= 0.45:
            want[r1, r2] = round(score, 4)
    got = tier2_blocking(spark, str(tmp_path)).collect()
    assert len(got) == len(want)
    assert {(r.left_ref, r.right_ref): round(r.score, 4) for r in got} == want
    assert any(int(a[5:]) > 400 < int(b[5:]) for a, b in want)


def test_classes_expand_to_all_pairs(spark):
    from quarry.operators.resolve import block_classes, block_pairs

    names = ["red bolt", "red bolts", "blue ring", "old red bolt", None, "plate"]
    rows = [(f"r{k:03d}", names[k * 7 % 6], f"d{k % 5}" if k % 3 == 0 else None) for k in range(60)]
    df = spark.createDataFrame(rows, "ref string, name string, domain string")
    name_of, domain_of = {r: n for r, n, _ in rows}, {r: d for r, _, d in rows}
    got = block_classes(df).collect()
    assert len(got) < 3 * len(rows)
    alike = {(name_of[r.left_ref], name_of[r.right_ref]) for r in got if r.kind == "name"}
    alike |= {(b, a) for a, b in alike} | {(n, n) for n in names if n}
    assert {r.right_ref for r in got if r.kind == "member"} | {r.left_ref for r in got if r.kind == "member"} == {r for r, n, _ in rows if n}
    expanded = {(a, b) for a, b in combinations(sorted(name_of), 2) if (name_of[a], name_of[b]) in alike or (domain_of[a] is not None and domain_of[a] == domain_of[b])}
    assert expanded == {(r.left_ref, r.right_ref) for r in block_pairs(df).collect()}


def test_facts_and_candidates_come_from_the_whole_turn(spark, tmp_path):
    from quarry.plans.operations import extract_l2_facts, knowledge_candidates

    text = "Nothing of note stands in front. Blue Harbour is closed on Mondays. Readers consistently ask for maps.\nBudget: 40 euros."
    rows = [(1, 2, "user", text), (1, 3, "user", "Green Hill is open."), (2, 1, "user", None)]
    pq.write_table(pa.table({"conv_id": [r[0] for r in rows], "turn": pa.array([r[1] for r in rows], pa.int32()), "role": [r[2] for r in rows], "text": [r[3] for r in rows]}), tmp_path / "conversations.parquet")
    facts = {(r.episode_id, r.subject, r.relation, r.object) for r in extract_l2_facts(spark, str(tmp_path)).collect()}
    assert {(1002, "Blue Harbour", "is", "closed on Mondays"), (1002, "crm:acct1", "Budget", "40 euros"), (1003, "Green Hill", "is", "open")} <= facts
    assert {(1002, "Acme Corp", "is", "Nothing of n"), (1002, "crm:acct1", "Owner", "team 1")} <= facts
    stated = {(r.episode_id, r.statement) for r in knowledge_candidates(spark, str(tmp_path)).collect()}
    assert stated == {(1002, "Customers in user always pay late!"), (1003, "Customers in user always pay late!"), (1002, "Readers consistently ask for maps.")}


def test_lexicon_holds_the_terms_of_every_document(spark, tmp_path):
    from quarry.operators import knowledge
    from quarry.plans.operations import deid_gate

    texts = ["see Quartz there", "no term here", "a Bluebird sang", "of one quartzite", "an ox bluebirds", None, "the", "x Óscar y"]
    rows = [(k + 1, t, "en", "web", len(t or "")) for k, t in enumerate(texts)]  # no doc_id is a multiple of 50
    pq.write_table(pa.table({c: [r[i] for r in rows] for i, c in enumerate(("doc_id", "text", "lang", "source", "n_chars"))}), tmp_path / "documents.parquet")
    terms = {w.lower() for t in texts if t for w in t.split(" ")}
    terms = {t for t in terms if len(t) >= 4}
    want = {k: min(t for t in terms if t in s.lower()) for k, s, *_ in rows if s and any(t in s.lower() for t in terms)}
    assert {r.id: r.term for r in deid_gate(spark, str(tmp_path)).collect()} == want
    assert len(want) == 6
    statements = spark.createDataFrame([r[:2] for r in rows], "id long, statement string")
    lexicon = spark.createDataFrame([(t,) for t in terms], "term string")
    for sent in (20_000, 0):
        assert {r.id: r.term for r in knowledge.identifying(statements, lexicon, sent).collect()} == want
