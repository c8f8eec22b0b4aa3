"""Each training-data operator against a plain brute-force version, and the odd cases."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quarry.llm import byte_cnn, chat_format, decontaminate, html_extract, line_dedup, packing, quality_rules, simhash, suffix_dedup, training_order
from quarry.llm.tokens import default_tokenizer, ids_of

WORDS = "the of and gamma delta Être über one two three four five six seven eight nine ten eleven".split()


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def corpus(spark, seed=1, n=60):
    """Texts with nulls, empties, a very long one, repeats, and columns whose names clash."""
    r = random.Random(seed)
    line = lambda k: " ".join(r.choice(WORDS) for _ in range(k))
    common = [line(8) for _ in range(3)]
    rows = [(0, None), (1, ""), (2, "   \n\t"), (3, line(3)), (4, "\n".join(line(9) for _ in range(400))), (5, "x"), (5, "x")]
    for i in range(6, n):
        own = [r.choice(common) if r.random() < 0.4 else line(r.randint(1, 20)) for _ in range(r.randint(1, 6))]
        rows.append((i, "\n".join(own)))
    rows += [(n, rows[7][1]), (n + 1, rows[7][1]), (n + 2, rows[4][1] + " end"), (None, "a null id"), (n + 3, "  " + common[0].upper() + " ")]
    wide = [(d, t, "en", f"s{k % 3}", len(t or ""), 0.5, "clash", 7) for k, (d, t) in enumerate(rows)]
    df = spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, score double, carried string, n long")
    return rows, df


def empty(df):
    return df.limit(0)


# ---------------------------------------------------------------- 1 html


def test_html_blocks_and_tree():
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a><li><a href=/b>B</a></ul></nav>
    <div class="cookie-notice">We use cookies on this page and want you to accept them all.</div>
    <article><h1>A &amp; B</h1><p>First   paragraph of\nthe text, <b>bold</b>er than most.<p>Short.</p><script>var a="</p>";</script>
    <div class="comments"><p>I do not agree with any of this at all, sir.</div><p>Last<br>one &eacute;&#33;</p></article>
    <aside>Other things that may be of interest to our readers</aside><form><label>Mail</label></form><footer>&copy; us</footer></body></html>"""
    assert html_extract.main_text(page)[0] == "A & B\nFirst paragraph of the text, bolder than most.\nShort.\nLast one é!"


def test_html_odd_pages(spark, sf):
    for page in (None, "", "<", "<a", "<!-- ", "<p" * 5000, "<div>" * 5000 + "x", "&#0;&bogus;", "<script>"):
        assert isinstance(html_extract.main_text(page)[0], str)
    df = spark.createDataFrame([(1, "u", None, "t"), (None, None, "<p>" + "word " * 50, "t"), (1, "u", None, "t")], "page_id long, url string, html string, text string")
    rows = html_extract.extracted(df).collect()
    assert sorted(r["n_chars"] for r in rows) == [0, 0, 249]
    assert html_extract.extracted(empty(df)).count() == 0


def _article(n):
    words = lambda k: " ".join(["word"] * k) + "."
    return f"<h1>Title</h1><p>{words(50)}</p><p>Short.</p><p>{words(n)}</p>", f"Title\n{words(50)}\nShort.\n{words(n)}"


@pytest.mark.parametrize(
    "page",
    [
        '<body class="no-sidebar"><nav><a href=/>Home</a></nav><article>{}</article></body>',
        '<body class="post-template tag-social"><article>{}</article></body>',
        '<body><div class="page-with-comments"><article>{}</article></div></body>',
        '<body><article class="post category-legal">{}</article></body>',
        '<body><div class="sidebar-left"><div class="menu"><a href=x>A</a></div>{}</div></body>',
        "<body style='visibility:hidden'><main>{}</main><footer>Imprint</footer></body>",
        '<body><article>{}<section class="user-opinions"><p>I do not agree with any of it at all.</p></section></article></body>',
        "<body><article>{}<ul><li><a href=1>One more of these</a><li><a href=2>And another of them</a></ul></article></body>",
        '<body><div class="sidebar"><article>A teaser of few words.</article></div><article>{}</article></body>',
        "<body><div>Home News</div>{}<div>All rights reserved</div></body>",
    ],
)
def test_html_page_shapes(page):
    inner, want = _article(40)
    assert html_extract.main_text(page.format(inner))[0] == want


def test_html_tree_uses_text_and_elements():
    """The tree splits on word counts and link densities, of blocks and of neighbours, not on elements alone."""
    used, todo = set(), [html_extract.trained()]
    while todo:
        node = todo.pop()
        if node.column >= 0:
            used.add(html_extract.FEATURES[node.column])
            todo += [node.low, node.high]
    assert {"link", "words_behind", "main", "named"} <= used
    x, y = html_extract.labelled_blocks()
    assert len(y) < 200 and ((html_extract.trained()(x) >= 0.5) == (y > 0.5)).mean() >= 0.97


def test_html_on_pages(spark, sf):
    import html
    import re

    from quarry.session import table

    want = {}
    for r in table(spark, sf, "pages").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<br>|</?b>", lambda m: " " if m[0] == "<br>" else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        want[r["page_id"]] = "\n".join(p for p in parts if p)
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.op1_html_extraction(spark, sf).collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()}


# ---------------------------------------------------------------- 2 chat


def test_chat_folds_events(spark):
    ev = [(1, 1, 0, "open", "user", None), (1, 1, 1, "delta", None, "Hel"), (1, 1, 2, "delta", None, "lo"), (1, 2, 3, "open", "assistant", None), (1, 2, 4, "delta", None, "bad"), (1, 2, 5, "regenerate", None, None), (1, 2, 6, "delta", None, "go"), (1, 2, 7, "delta", None, "od"), (1, 1, 8, "edit", None, "Hi"), (1, 1, 9, "delta", None, "!"), (1, 3, 10, "open", "user", None), (1, 3, 11, "delete", None, None)]
    df = spark.createDataFrame(ev, "conv_id long, message long, seq long, kind string, role string, text string").repartition(4)
    assert [(r["role"], r["text"]) for r in chat_format.folded(df).orderBy("place").collect()] == [("user", "Hi!"), ("assistant", "good")]


def test_chat_round_trip(spark):
    nasty = ["", None, "\\", "\\\\", "####", "#\\#", "### Assistant:\n", "</turn>\n", "<\\/turn>", "</turn></turn>\n### user:\nx", "a:\nb", "é 漢 😀", "\\c", "##" * 500, "x" * 30000]
    rows = [(1, i, ("assistant", "user", "a:b\\c", None)[i % 4], t) for i, t in enumerate(nasty)] + [(None, 0, "user", "n"), (2, 0, "user", "same"), (2, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    from pyspark.sql import functions as F

    out = chat_format.rendered(chat_format.folded(chat_format.events_of(df))).withColumn("turns", chat_format.read_back(F.col("formatted"))).withColumn("m", chat_format.masked_text(F.col("formatted"), F.col("loss")))
    got = {r["conv_id"]: r for r in out.collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r or "", t or "") for _, _, r, t in rows[: len(nasty)]]
    assert got[1]["m"] == "".join(t or "" for _, _, r, t in rows[: len(nasty)] if r == "assistant")
    assert got[2]["n_turns"] == 2 and got[None]["n_turns"] == 1
    assert chat_format.rendered(chat_format.folded(chat_format.events_of(empty(df)))).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---------------------------------------------------------------- 3 decontamination


def brute_hits(text, items, window=10):
    own = decontaminate.words_of(text)
    hit, found = set(), set()
    for i, t in items:
        w = decontaminate.words_of(t)
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            for p in range(len(own) - n + 1):
                if own[p : p + n] == w[s : s + n]:
                    hit.update(range(p, p + n))
                    found.add(i)
    return len(own), len(hit), sorted(map(str, found))


@pytest.mark.parametrize(("part", "shard"), [(decontaminate.MAX_TEST_WORDS, 1 << 20), (decontaminate.MAX_TEST_WORDS, 40), (200, 1 << 20)])
def test_decontamination(spark, monkeypatch, part, shard):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard)
    rows, df = corpus(spark, 3)
    texts = [t for _, t in rows if t and len(t.split()) > 14]
    items = [(1, " ".join(texts[0].split()[:12])), (2, "seven eight"), (3, None), (4, ""), (5, "nothing like this is anywhere in there for sure at all"), (10, texts[2].upper()), (6, texts[0]), (7, "x")]
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    got = sorted((r["doc_id"] is not None, r["doc_id"], r["n_words"], r["n_hit"], sorted(str(m["item_id"]) for m in r["matches"])) for r in decontaminate.matched(df, bench, max_test_words=part).collect())
    want = sorted((d is not None, d, *brute_hits(t, items)) for d, t in rows)
    assert got == want
    assert decontaminate.matched(empty(df), bench).count() == 0
    assert decontaminate.matched(df, empty(bench)).where("n_hit > 0").count() == 0


def test_longest_match(spark):
    w = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, "a b " + " ".join(w[5:30]) + " c " + " ".join(w[0:12]))], "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(w))], "item_id long, text string")
    (m,) = decontaminate.matched(docs, bench).head()["matches"]
    assert (m["item_id"], m["words"], m["at"]) == (9, 25, 2)


# ---------------------------------------------------------------- 4 order


def test_permutation_is_one():
    for n in (1, 2, 3, 7, 64, 65, 1000):
        for key in (0, 5):
            assert sorted(training_order.permuted(np.arange(n), n, key).tolist()) == list(range(n))
    assert training_order.permuted(np.arange(1000), 1000, 1).tolist() != training_order.permuted(np.arange(1000), 1000, 2).tolist()


def test_shards(spark, tmp_path):
    rows, df = corpus(spark, 4)
    folder = str(tmp_path / "s")
    placed = sorted(training_order.materialized(df.coalesce(2), folder, seq_len=64, slots_per_shard=7).collect(), key=lambda r: r["slot"])
    ids = training_order.read_slots(folder, 0, len(placed) + 5, 64, 2, 7)
    assert [r["slot"] for r in placed] == list(range(len(placed))) and len(ids) == len(placed)
    assert [zlib.crc32(x.tobytes()) for x in ids] == [r["ids_crc32"] for r in placed]
    assert (training_order.read_slots(folder, 5, 9, 64, 2, 7) == ids[5:14]).all()
    encode = ids_of(default_tokenizer())
    streams = Counter()
    for r, x in zip(placed, ids, strict=True):
        streams[r["part"]] += r["n_tokens"]
    assert sum(streams.values()) == sum(len(encode(t)) + 1 for _, t in rows)
    assert training_order.materialized(empty(df), str(tmp_path / "e"), seq_len=64).count() == 0


# ---------------------------------------------------------------- 5 simhash


def brute_components(fps, budget):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize(("budget", "crowd"), [(1, 2), (2, 64), (2, 2), (3, 2), (4, 64)])
def test_simhash_links_connect_all_within_budget(spark, budget, crowd):
    r = random.Random(budget)
    fps = []
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(6):
            fps.append(x)
            for _ in range(r.randint(1, budget + 1)):
                x ^= 1 << r.randrange(64)
    fps += [fps[0]] * 3
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    prints = spark.createDataFrame([(i, x) for i, x in enumerate(signed)], "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.grouped(prints, budget, crowd).collect()}
    roots = brute_components(fps, budget)
    least = {}
    for i, x in enumerate(roots):
        least[x] = min(least.get(x, i), i)
    assert got == {i: least[x] for i, x in enumerate(roots)}


def test_simhash_fingerprint(spark):
    import xxhash

    text = "One two  three\tFour\nfive ÉTÉ one two three"
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if x]
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(len(w) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("one two") == xxhash.xxh64_intdigest("one two", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    rows, df = corpus(spark, 5)
    prints = simhash.saved(simhash.fingerprints(df), "t")
    out = simhash.grouped(prints).collect()
    assert len(out) == len(rows)
    assert simhash.grouped(simhash.fingerprints(empty(df))).count() == 0


def test_near_copies_are_found_and_others_left(spark):
    r = random.Random(9)
    rows, of = [], {}
    for g in range(30):
        words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(200)]
        for k in range(3):
            own = list(words)
            for _ in range(2 * k):
                own[r.randrange(200)] = "changed"
            rows.append((len(rows), " ".join(own)))
            of[rows[-1][0]] = g
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_copies(df).collect()}
    assert all(of[d] == of[c] for d, c in got.items())
    assert sum(of[d] * 3 == c for d, c in got.items()) >= 0.9 * len(got)


# ---------------------------------------------------------------- 6 rules


def brute_measures(text):
    text = text or ""
    w = text.encode().split()
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(rep)


def test_rule_measures(spark):
    rows, df = corpus(spark, 6)
    for _, t in [*rows, (0, "a b c a b c a b"), (0, "x x x x x x"), (0, "#|é <b>\n#|é <b>")]:
        assert quality_rules.measures(t)[:5] == brute_measures(t)
    labels = spark.createDataFrame([(7, 1, 0, "x"), (8, 0, 0, "x"), (999, 1, 0, "x"), (None, 1, 0, "x"), (9, None, 0, "x")], "doc_id long, quality int, toxic int, text string")
    out = quality_rules.screened(df, labels).collect()
    assert len(out) == len(rows)
    for r in out:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and (not failed or not r["kept"])
    assert quality_rules.screened(empty(df), labels).count() == 0


def test_exact_bound_and_choice():
    for k, n in ((0, 10), (3, 50), (20, 400)):
        p = quality_rules.upper_bound(k, n, 0.95)
        from math import comb

        assert abs(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) - 0.05) < 1e-6


def test_chain_and_choice():
    r = random.Random(4)
    sizes = [len(c) for _, c in quality_rules.RULES.values()]
    draw = lambda n, high: Counter(tuple(r.randint(0, s) if r.random() < high else 0 for s in sizes) for _ in range(n))
    bad, others, good = draw(60, 0.4), draw(400, 0.05), draw(900, 0.002)
    states = quality_rules.chain(bad, others)
    assert len(states) == sum(sizes) and states[-1] == tuple(sizes)
    assert all(sum(b) == k + 1 for k, b in enumerate(states)) and all(x <= y for a, b in zip(states, states[1:], strict=False) for x, y in zip(a, b, strict=True))
    # by brute force: walk the chain, stop at the first set that is not certified
    n, best, want = sum(good.values()), 0, None
    for state in states:
        over = lambda v: any(v[k] > sizes[k] - state[k] for k in range(len(sizes)))  # noqa: E731, B023
        wrong, right = (sum(c for v, c in counts.items() if over(v)) for counts in (good, bad))
        if quality_rules.upper_bound(wrong, n, 0.99) > 0.02:
            break
        if right - quality_rules.COST * wrong > best:
            best, want = right - quality_rules.COST * wrong, state
    assert want is not None and quality_rules.choose(states, good, bad, 0.02, 0.99) == want
    assert quality_rules.choose(states, Counter({(0,) * 5: 50}), bad, 0.02, 0.99) is None
    assert quality_rules.choose(states, Counter(), bad, 0.02, 0.99) is None


def test_tested_strata():
    assert quality_rules.needed(0.02, 0.05, 4) == 217
    assert quality_rules.tested({"a": 500, "b": 160, None: 150}, 0.02, 0.05) == ["a"]
    assert quality_rules.tested({"a": 500, None: 190, "c": 10}, 0.02, 0.05) == ["a", None]
    assert quality_rules.tested({"a": 148}, 0.02, 0.05) == [] and quality_rules.tested({}, 0.02, 0.05) == []


def test_false_rejection_is_bounded():
    """Of many draws of labels, at most about delta choose cutoffs that reject over alpha of all good documents."""
    r = np.random.default_rng(6)
    sizes = [len(c) for _, c in quality_rules.RULES.values()]
    # true shares of good documents over 0, 1, .. cutoffs of the first two rules, so that some sets are over alpha
    good = [(0, 0, 0, 0, 0), (1, 0, 0, 0, 0), (3, 0, 0, 0, 0), (0, 1, 0, 0, 0), (0, 4, 0, 0, 0), (5, 5, 0, 0, 0)]
    share = np.array([0.955, 0.012, 0.008, 0.01, 0.01, 0.005])
    states = quality_rules.chain(Counter({(9, 0, 0, 0, 0): 40, (2, 0, 0, 0, 0): 30, (0, 3, 0, 0, 0): 20}), Counter({g: int(1000 * p) for g, p in zip(good, share, strict=True)}))
    over = {s: sum(p for g, p in zip(good, share, strict=True) if any(quality_rules.rejected(g, s))) for s in states}
    wrong = 0
    for _ in range(300):
        drawn = Counter({g: int(c) for g, c in zip(good, r.multinomial(600, share), strict=True)})
        at = quality_rules.choose(states, drawn, Counter({tuple(sizes): 100, (1, 1, 1, 1, 1): 500}), 0.02, 0.95)
        wrong += at is not None and over[at] > 0.02
    assert wrong <= 300 * 0.05 + 3 * (300 * 0.05 * 0.95) ** 0.5


def test_rules_certify_with_enough_labels(spark):
    rows = [(i, "en", " ".join(f"w{i}x{j}" for j in range(60)) + (" ###" * 60 if i % 10 == 0 else "")) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, int(i % 10 != 0)) for i in range(3000)], "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality_rules.screened(df, labels).where("kept").collect()}
    assert kept == {i for i in range(3000) if i % 10}
    # a null stratum is one of its own; one with few labels rejects nothing
    few = df.selectExpr("doc_id", "text", "CASE WHEN doc_id < 100 THEN 'few' END AS lang")
    out = quality_rules.screened(few, labels)
    assert {r["doc_id"] for r in out.where("kept").collect()} == {i for i in range(3000) if i % 10 or i < 100}


# ---------------------------------------------------------------- 7 lines


def brute_lines(rows, least, min_chars):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(lower)
    n = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if len(k) >= min_chars)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if n[key(x)] < least]
        out.append((str(d), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize(("least", "block", "min_chars"), [(10, 1 << 20, 1), (2, 40, 1), (3, 1 << 20, 0)])
def test_line_dedup(spark, monkeypatch, least, block, min_chars):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 3)
    rows, df = corpus(spark, 7)
    out = line_dedup.drop_lines(df, least, min_chars, block, carry=("lang", "n"))
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()) == brute_lines(rows, least, min_chars)
    assert {(r["carried"]["lang"], r["carried"]["n"]) for r in out.collect()} == {("en", 7)}
    assert line_dedup.drop_lines(empty(df)).count() == 0


def test_minimal_perfect_hash():
    r = np.random.default_rng(1)
    for n in (1, 2, 5, 1000, 20000):
        h = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        d = line_dedup.build_hash(h)
        assert sorted(line_dedup.places(h, d, len(h)).tolist()) == list(range(len(h)))


# ---------------------------------------------------------------- 8 packing


def test_packing(spark):
    rows, df = corpus(spark, 8)
    for cap, shard in ((2048, 60000), (64, 20)):
        out = packing.packed_documents(df, capacity=cap, shard_pieces=shard).collect()
        encode = ids_of(default_tokenizer())
        want = []
        for d, t in rows:
            ids = np.append(encode(t), np.uint32(0)).astype("<u4")
            first = len(ids) % cap or cap
            edges = [0, *range(first, len(ids) + 1, cap)]
            want += [(str(d), k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
        assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(want)
        bins = {}
        for r in out:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for own in bins.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= cap
        total = sum(r["length"] for r in out)
        assert len(bins) <= -(-total // cap) * 1.02 + 3
    assert packing.packed_documents(empty(df)).count() == 0


def test_ids_equal_the_tokenizers():
    encode = ids_of(default_tokenizer())
    for t in ("  a  b\n\n c", "x<|endoftext|>y", "½ é 漢字 😀 's 'll \x1c\x1d\t", "", "a\r\n b "):
        assert encode(t).tolist() == encode.tokenizer.encode(t, add_special_tokens=False).ids


# ---------------------------------------------------------------- 9 classifier


def test_chunks_cover_everything():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        text = bytes(i % 251 for i in range(n))
        codes = byte_cnn.chunks_of(text)
        step = byte_cnn.CHUNK - byte_cnn.OVERLAP
        seen = {k * step + j: int(c) - 1 for k, row in enumerate(codes) for j, c in enumerate(row) if c}
        assert [seen[i] for i in range(n)] == list(text) and len(seen) == n


def test_gradient_is_right():
    r = np.random.default_rng(2)
    net = byte_cnn.Network.fresh(3)
    docs = [byte_cnn.chunks_of(bytes(r.integers(97, 123, n).tolist())) for n in (30, 700, 1200)]
    y = np.array([1, 0, 1], np.float32)

    def loss():
        pooled = net.pooled(np.concatenate(docs))
        p = net.head(pooled, np.cumsum([0, *[len(d) for d in docs[:-1]]]))[0]
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    for p, g in zip(net.parameters(), byte_cnn._gradient(net, docs, y), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, e = float(p[at]), 2e-3
        p[at] = old + e
        up = loss()
        p[at] = old - e
        down = loss()
        p[at] = old
        assert abs((up - down) / (2 * e) - g[at]) < 0.1 * abs(g[at]) + 1e-3


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    from quarry.session import table

    out = {r["doc_id"]: r for r in byte_cnn.op9_quality_classifier(spark, sf).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in table(spark, sf, "labels").collect()]
    assert all(out[d]["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d in out)
    own = [(d, q) for d, q in labels if out[d]["held_out"]]
    assert sum(out[d]["predicted"] == q for d, q in own) >= 0.93 * len(own)


def test_classifier_odd_tables(spark):
    rows, df = corpus(spark, 9)
    labels = spark.createDataFrame([(7, 1), (None, 0), (99999, 0), (8, None)], "doc_id long, quality int")
    for own in (labels, empty(labels)):
        out = byte_cnn.scored(df, byte_cnn.train(df, own)).collect()
        assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert byte_cnn.scored(empty(df), byte_cnn.Network.fresh()).count() == 0


# ---------------------------------------------------------------- 10 suffix arrays


def test_suffix_order():
    r = np.random.default_rng(0)
    for _ in range(200):
        s = r.integers(0, int(r.integers(1, 5)), int(r.integers(1, 50)))
        assert suffix_dedup.suffix_order(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def brute_cut(rows, length):
    seen, out = {}, []
    for d, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        b = (t or "").encode()
        edge = np.zeros(len(b) + 1, int)
        for s in range(len(b) - length + 1):
            first = seen.setdefault(b[s : s + length], (d, s))
            if first != (d, s):
                edge[s] += 1
                edge[s + length] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((str(d), len(b), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), kept))
    return sorted(out)


@pytest.mark.parametrize(("length", "hot", "symbols"), [(100, 0, 1 << 20), (12, 2, 400), (30, 0, 1 << 20)])
def test_suffix_dedup(spark, monkeypatch, length, hot, symbols):
    monkeypatch.setattr(suffix_dedup, "PART", 3000)
    rows, df = corpus(spark, 10)
    out = suffix_dedup.cut_repeats(df.repartition(3), length, hot, symbols)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out.collect()) == brute_cut(rows, length)
    assert suffix_dedup.cut_repeats(empty(df)).count() == 0


@pytest.mark.parametrize(("loud", "hot", "symbols"), [(3, 4, 3000), (1000, 4, 3000), (3, 0, 1 << 19)])
def test_suffix_dedup_crowded_anchors(spark, monkeypatch, loud, hot, symbols):
    """One passage in many contexts and a large group of near copies: windows are named anew by longer anchors."""
    monkeypatch.setattr(suffix_dedup, "LOUD_UNITS", loud)
    r = np.random.default_rng(3)
    letters = lambda n: "".join(map(chr, r.integers(97, 123, n)))
    passage, base = letters(160), letters(700)
    rows = [(i, letters(int(r.integers(0, 90))) + passage + letters(int(r.integers(0, 90)))) for i in range(40)]
    for i in range(40, 80):
        copy = list(base)
        for at in r.integers(0, len(base), 6):
            copy[at] = "?"
        rows.append((i, "".join(copy)))
    rows += [(80, base), (81, base), (82, ""), (83, None), (84, base * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = suffix_dedup.cut_repeats(df, 100, hot, symbols, part_text=4000)
    assert sorted((str(x["doc_id"]), x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in out.collect()) == brute_cut(rows, 100)
