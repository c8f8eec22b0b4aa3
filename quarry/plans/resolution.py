"""Queries of entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import bindings as b
from quarry.functions import canon
from quarry.operators import directory as d
from quarry.operators import gazetteer
from quarry.operators import resolve as r
from quarry.session import table

RAW_EMAIL = "CASE c_custkey % 6 WHEN 0 THEN ' MAILTO:Jane' || c_custkey || '+x@Acme' || (c_custkey % 9) || '.Co.UK ' WHEN 1 THEN 'info@acme.com' WHEN 2 THEN 'bob@gmail.com' WHEN 3 THEN 'x' || c_custkey || '@@a.b' WHEN 4 THEN 'p' || c_custkey || '@localhost' ELSE 'p' || c_custkey || '@sub.firm' || (c_custkey % 5) || '.com.' END"
RAW_SITE = "CASE c_custkey % 5 WHEN 0 THEN 'https://www.Acme' || c_custkey || '.co.uk:8080/contact?x=1' WHEN 1 THEN 'user@shop.firm' || c_custkey || '.com' WHEN 2 THEN 'localhost' WHEN 3 THEN ' www.gmail.com/' ELSE 'a.b.c' || (c_custkey % 50) || '.org.' END"
RAW_PHONE = "CASE c_custkey % 4 WHEN 0 THEN '(555) 010-' || lpad(CAST(c_custkey % 10000 AS VARCHAR(9)), 4, '0') WHEN 1 THEN '+44 20 7946 ' || (c_custkey % 9000 + 1000) WHEN 2 THEN '0049-30-' || (c_custkey + 100000) ELSE '12-' || c_custkey END"
RAW_NAME = "CASE c_custkey % 3 WHEN 0 THEN c_name || ', Group Inc.' WHEN 1 THEN 'The ' || upper(c_mktsegment) || '-Works ' || (c_custkey % 20) || ' GmbH' ELSE 'Inc.' END"

_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _customers(spark, sf):
    return table(spark, sf, "customer")


def canon_email(spark, sf):
    return _customers(spark, sf).select("c_custkey", canon.email(F.expr(RAW_EMAIL)).alias("email")).withColumn("domain", canon.domain(F.col("email")))


def canon_domain(spark, sf):
    return _customers(spark, sf).select("c_custkey", canon.domain(F.expr(RAW_SITE)).alias("domain"))


def canon_phone(spark, sf):
    return _customers(spark, sf).select("c_custkey", canon.phone(F.expr(RAW_PHONE)).alias("phone"))


def canon_name(spark, sf):
    return _customers(spark, sf).select("c_custkey", canon.name(F.expr(RAW_NAME)).alias("name"), canon.namespace(F.when(F.col("c_custkey") % 7 == 0, "Linear").otherwise("crm"), F.when(F.col("c_custkey") % 5 == 0, "Actor.Email").otherwise("email")).alias("namespace"))


def _keys(spark, sf):
    one = _customers(spark, sf).selectExpr("'cust:' || c_custkey AS ref", "'email_exact' AS key_kind", "'customer_contact' AS namespace", "CASE WHEN c_custkey % 4 = 0 THEN 'k' || (c_custkey div 8) END AS key_value")
    two = table(spark, sf, "supplier").selectExpr("'supp:' || s_suppkey AS ref", "'external_id' AS key_kind", "'customer_contact' AS namespace", "'x' || (s_suppkey div 3) AS key_value")
    return one.unionByName(two)


_KEYS = """keys AS (SELECT 'cust:' || c_custkey AS ref, 'email_exact' AS key_kind, 'customer_contact' AS namespace, CASE WHEN c_custkey % 4 = 0 THEN 'k' || (c_custkey // 8) END AS key_value FROM customer
  UNION ALL SELECT 'supp:' || s_suppkey, 'external_id', 'customer_contact', 'x' || (s_suppkey // 3) FROM supplier)"""


def tier1_evidence(spark, sf):
    return r.tier1_evidence(_keys(spark, sf)).select("left_ref", "right_ref", "key_kind", "key_value")


def _evidence(spark, sf):
    """Stars of shared keys, direct links, human verdicts and an anti-link here and there."""
    stars = r.star_evidence(_keys(spark, sf).where("ref LIKE 'supp:%'")).withColumn("valid_from", F.lit(b.BASE).cast("long"))
    stars = stars.unionByName(r.star_evidence(_customers(spark, sf).selectExpr("'cust:' || c_custkey AS ref", "'domain' AS key_kind", "'customer_contact' AS namespace", "CASE WHEN c_custkey % 10 < 3 THEN 'd' || (c_custkey div 10) WHEN c_custkey % 10 IN (5, 6) THEN 'e' || (c_custkey div 10) END AS key_value")).withColumn("valid_from", F.lit(b.BASE).cast("long")))
    c = _customers(spark, sf)
    link = "concat('ev', c_custkey, '-', {k}) AS id; 'cust:' || c_custkey AS left_ref; 'cust:' || (c_custkey + {d}) AS right_ref; {t} AS tier; '{m}' AS method; '{m}' AS key_kind; {v} AS key_value; 'customer_contact' AS namespace; {p} AS polarity; CAST(%d + c_custkey * 600 AS BIGINT) AS valid_from" % b.BASE
    row = lambda where, **k: c.where(where).selectExpr(*link.format(**k).split("; "))
    return (
        stars.unionByName(row("c_custkey % 10 = 5", k=1, d=2, t=1, m="crm_fk", v="CAST(c_custkey AS STRING)", p=1))
        .unionByName(row("c_custkey % 30 = 7", k=2, d=1, t=2, m="name_match", v="CAST(NULL AS STRING)", p=1))
        .unionByName(row("c_custkey % 60 = 7", k=3, d=1, t=2, m="human_confirmed", v="CAST(NULL AS STRING)", p=1))
        .unionByName(row("c_custkey % 70 = 5", k=4, d=2, t=2, m="human_rejected", v="CAST(NULL AS STRING)", p=-1))
        .unionByName(row("c_custkey % 30 = 8", k=5, d=1, t=3, m="mention", v="CAST(NULL AS STRING)", p=1))
    )


CONFIG = r.Config(size_cap=6)


def fold_components(spark, sf):
    return r.fold(_evidence(spark, sf), CONFIG)[0]


def fold_reviews(spark, sf):
    return r.fold(_evidence(spark, sf), CONFIG)[1]


def fold_drift(spark, sf):
    aliases = r.fold(_evidence(spark, sf), CONFIG)[0]
    prior = aliases.select("ref", F.concat(F.lit("canon:"), "ref").alias("canonical")).where("ref LIKE '%1' OR ref LIKE '%2' OR ref LIKE '%5' OR ref LIKE '%7'")
    return r.drift(aliases, prior, 4)


def canonical_entities(spark, sf):
    return r.canonical_entities(r.fold(_evidence(spark, sf), CONFIG)[0], _customers(spark, sf).selectExpr("'cust:' || c_custkey AS ref"), 200)


NOW = b.BASE + 40 * b.DAY


def _aliases(spark, sf):
    return _customers(spark, sf).where("c_custkey % 10 IN (5, 7)").selectExpr("'cust:' || c_custkey AS ref", "'canon:' || (c_custkey div 20) AS canonical")


def review_queue(spark, sf):
    e = _evidence(spark, sf).withColumn("valid_to", F.lit(None).cast("long"))
    return r.review_queue(e, _aliases(spark, sf), NOW, 100)


def _names(spark, sf):
    """Parties with names alike in part."""
    return table(spark, sf, "part").selectExpr("'part:' || p_partkey AS ref", "lower(p_name) || ' ' || lower(p_brand) AS name", "CASE WHEN p_partkey % 9 = 0 THEN 'firm' || (p_partkey % 45) || '.com' END AS domain")


def tier2_blocking(spark, sf):
    return r.block_pairs(_names(spark, sf), 0.45)


def tier2_classes(spark, sf):
    return r.block_classes(_names(spark, sf), 0.45)


def mention_detect(spark, sf):
    texts = table(spark, sf, "conversations").selectExpr("conv_id * 1000 + turn AS id", "text AS content")
    forms = spark.createDataFrame([("the", "c:1"), ("of the", "c:2"), ("and", "c:3"), ("que", "c:4"), ("in the", "c:5")], "form string, canonical string")
    return r.mentions(texts, forms).groupBy("id", "form").agg(F.count("*").alias("n"), F.min("at").alias("first_at"))


def _spoken(spark, sf):
    """Turns of conversations, each about a customer and a part."""
    c, p = _customers(spark, sf).selectExpr("c_custkey AS k", "c_name"), table(spark, sf, "part").selectExpr("p_partkey AS q", "p_name")
    turns = table(spark, sf, "conversations").selectExpr("conv_id * 1000 + turn AS id", "text", "1 + conv_id % 150 AS k", "1 + (conv_id * 7 + turn) % 190 AS q")
    return turns.join(c, "k").join(p, "q").selectExpr("id", "concat(coalesce(text, ''), '. ', c_name, ' wants: ', upper(p_name), '!') AS content")


def gazetteer_mentions(spark, sf):
    """Names of all parts and customers in all conversations."""
    forms = table(spark, sf, "part").selectExpr("p_name AS form").unionByName(_customers(spark, sf).selectExpr("c_name AS form"))
    return gazetteer.found_forms(_spoken(spark, sf), forms).groupBy("id", "form").agg(F.count("*").alias("n"), F.min("at").alias("first_at"))


def gazetteer_near(spark, sf):
    """Brands as they are spelt by suppliers' numbers against the names of parts with their brands: nearly the same words."""
    forms = table(spark, sf, "part").selectExpr("concat(p_name, ' ', p_brand, ' made') AS form")
    spelt = table(spark, sf, "part").selectExpr("concat(p_brand, ' ', p_name, CASE WHEN p_partkey % 3 = 0 THEN ' new' ELSE '' END) AS mention")
    return gazetteer.near_forms(spelt, forms)


def tier3_decision(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_id div 3 AS mention", "'canon:' || (user_id % 11) AS canonical", "(event_id * 37 % 101) / 100.0D AS score", "event_id % 2 = 0 AS co_signal", "user_id % 3 <> 0 AS folded", "event_id % 19 = 0 AS human")
    return r.decide_mentions(e)


def echo_tagger(spark, sf):
    names = spark.createDataFrame([("lang:the",), ("topic:und",), ("topic:la",), ("topic:que",), ("lang:en",)], "entity string")
    return r.echo_tags(b.chunks(spark, sf), names).select("id", "entity", "confidence")


def tier2_evidence(spark, sf):
    return r.tier2_of_domains(_names(spark, sf), "customer_contact", b.BASE).select("left_ref", "right_ref", "method", "tier", "polarity", "key_value", "score")


def human_decisions(spark, sf):
    """A reviewer's verdicts are appended, and the fold says what they change: the canonical of each ref."""
    c = _customers(spark, sf)
    verdicts = c.where("c_custkey % 30 IN (7, 25)").selectExpr("'cust:' || c_custkey AS left_ref", "'cust:' || CASE WHEN c_custkey % 30 = 7 THEN c_custkey + 1 ELSE c_custkey + 2 END AS right_ref", "c_custkey % 30 = 7 AS confirm", f"CAST({b.BASE} + c_custkey AS BIGINT) AS at")
    links = r.star_evidence(_keys(spark, sf).where("ref LIKE 'supp:%'")).withColumn("valid_from", F.lit(b.BASE).cast("long"))
    crm = c.where("c_custkey % 10 = 5").selectExpr("'crm' || c_custkey AS id", "'cust:' || c_custkey AS left_ref", "'cust:' || (c_custkey + 2) AS right_ref", "1 AS tier", "'crm_fk' AS method", "'crm_fk' AS key_kind", "CAST(c_custkey AS STRING) AS key_value", "'customer_contact' AS namespace", "1 AS polarity", f"CAST({b.BASE} AS BIGINT) AS valid_from")
    evidence = links.unionByName(crm).unionByName(r.human_decisions(verdicts, "customer_contact"))
    return d.canonical_of(c.selectExpr("'cust:' || c_custkey AS ref"), r.fold(evidence, r.Config())[0])


def chunk_tags(spark, sf):
    e = table(spark, sf, "events").selectExpr("'chunk:' || (event_id % 900) AS c", "CASE WHEN event_id % 3 = 0 THEN 'canon:user:' || user_id ELSE 'user:' || user_id END AS o", "event_id")
    ev = e.selectExpr("CASE WHEN event_id % 2 = 0 THEN c ELSE o END AS left_ref", "CASE WHEN event_id % 2 = 0 THEN o ELSE c END AS right_ref", "CASE WHEN event_id % 5 = 0 THEN 2 ELSE 3 END AS tier", "CASE WHEN event_id % 11 = 0 THEN 'human_confirmed' ELSE 'llm_mention' END AS method", "CASE WHEN event_id % 13 = 0 THEN -1 ELSE 1 END AS polarity")
    known = table(spark, sf, "customer").where("c_custkey % 2 = 0").selectExpr("'canon:user:' || c_custkey AS canonical")
    return r.chunk_tags(ev, known).withColumn("tags", F.array_join("tags", ","))


def resolution_run(spark, sf):
    """One run from evidence to aliases, reviews, drift and tags: how many of each."""
    mentions = table(spark, sf, "events").selectExpr("'chunk:' || (event_id % 900) AS left_ref", "'cust:' || user_id AS right_ref", "CASE WHEN event_id % 5 = 0 THEN 2 ELSE 3 END AS tier", "'llm_mention' AS method", "1 AS polarity")
    prior = _customers(spark, sf).selectExpr("'cust:' || c_custkey AS ref", "'canon:cust:' || c_custkey AS canonical").where("ref LIKE '%1' OR ref LIKE '%2' OR ref LIKE '%5' OR ref LIKE '%7'")
    parts = r.resolve_all(_evidence(spark, sf), mentions, CONFIG, prior)
    out = None
    for name, df in parts.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def surface_scores(spark, sf):
    """Scores of mentions against surface forms, with and without a co-signal."""
    e = table(spark, sf, "events").selectExpr("event_id", "CASE event_id % 4 WHEN 0 THEN 'acme corp' WHEN 1 THEN 'acme' WHEN 2 THEN 'north acme corp' ELSE 'other' END AS mention", "'acme corp' AS form", "event_id % 3 = 0 AS co")
    return e.select("event_id", r.surface_score(F.col("mention"), F.col("form"), F.col("co")).alias("score"))


QUERIES = {q.__name__: q for q in (tier2_evidence, human_decisions, chunk_tags, resolution_run, surface_scores, canon_email, canon_domain, canon_phone, canon_name, tier1_evidence, fold_components, fold_reviews, fold_drift, canonical_entities, review_queue, tier2_blocking, tier2_classes, gazetteer_mentions, gazetteer_near, mention_detect, tier3_decision, echo_tagger)}

_IN = lambda xs: "(" + ", ".join(repr(x) for x in xs) + ")"
_EMAIL = f"""e1 AS (SELECT c_custkey, trim(regexp_replace({_LOW.format(f'trim({RAW_EMAIL})')}, '^mailto:', '')) AS s FROM customer),
e2 AS (SELECT c_custkey, split_part(regexp_extract(s, '^([^@]+)@([^@]+)$', 1), '+', 1) AS l, trim(regexp_extract(s, '^([^@]+)@([^@]+)$', 2), '.') AS d FROM e1),
em AS (SELECT c_custkey, CASE WHEN l <> '' AND contains(d, '.') AND NOT contains(d, ' ') AND l NOT IN {_IN(canon.ROLES)} AND d NOT IN {_IN(canon.DENIED)} THEN l || '@' || d END AS email FROM e2)"""


def _site(expr: str) -> str:
    """h1 to reg over rows (c_custkey, raw)."""
    return f"""h1 AS (SELECT c_custkey, {_LOW.format('trim(raw)')} AS s FROM ({expr})),
h2 AS (SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '^.*?://', ''), '^.*@', ''), '[/?#].*$', ''), '^(.+):[0-9]*$', '\\1') AS s FROM h1),
h3 AS (SELECT c_custkey, list_filter(string_split(regexp_replace(trim(s, '.'), '^www[.]', ''), '.'), lambda x: x <> '') AS p FROM h2),
reg AS (SELECT c_custkey, CASE WHEN len(p) >= 3 AND p[-2] || '.' || p[-1] IN {_IN(canon.SUFFIXES)} THEN p[-3] || '.' || p[-2] || '.' || p[-1] WHEN len(p) >= 2 THEN p[-2] || '.' || p[-1] END AS d FROM h3),
dom AS (SELECT c_custkey, CASE WHEN d NOT IN {_IN(canon.DENIED)} THEN d END AS domain FROM reg)"""


_LEGAL = "|".join(x for x in canon.LEGAL if "." not in x)
_EV = f"""{_KEYS}, star AS (SELECT 'key:' || key_kind || ':' || key_value AS key, ref AS leaf, key_kind, sha256(concat_ws('|', key_kind, namespace, key_value, ref)) AS id FROM keys WHERE key_value IS NOT NULL AND ref LIKE 'supp:%'
  UNION ALL SELECT 'key:domain:' || v, 'cust:' || c_custkey, 'domain', sha256('domain|customer_contact|' || v || '|cust:' || c_custkey) FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 < 3 THEN 'd' || (c_custkey // 10) WHEN c_custkey % 10 IN (5, 6) THEN 'e' || (c_custkey // 10) END AS v FROM customer) WHERE v IS NOT NULL),
direct AS (SELECT 'ev' || c_custkey || '-1' AS id, c_custkey AS l, c_custkey + 2 AS r, 1 AS tier, 'crm_fk' AS method FROM customer WHERE c_custkey % 10 = 5 UNION ALL SELECT 'ev' || c_custkey || '-2', c_custkey, c_custkey + 1, 2, 'name_match' FROM customer WHERE c_custkey % 30 = 7
  UNION ALL SELECT 'ev' || c_custkey || '-3', c_custkey, c_custkey + 1, 2, 'human_confirmed' FROM customer WHERE c_custkey % 60 = 7 UNION ALL SELECT 'ev' || c_custkey || '-4', c_custkey, c_custkey + 2, 2, 'human_rejected' FROM customer WHERE c_custkey % 70 = 5
  UNION ALL SELECT 'ev' || c_custkey || '-5', c_custkey, c_custkey + 1, 3, 'mention' FROM customer WHERE c_custkey % 30 = 8),
sized AS (SELECT key, count(DISTINCT leaf) AS members, min(leaf) AS hub, max(key_kind) AS kind FROM star GROUP BY key),
links AS (SELECT least('cust:' || l, 'cust:' || r) AS a, greatest('cust:' || l, 'cust:' || r) AS b, id, tier, method FROM direct WHERE method = 'crm_fk' OR method = 'human_confirmed' OR (method = 'name_match' AND l % 60 = 7)
  UNION ALL SELECT hub, leaf, id, 1, key_kind FROM star JOIN sized USING (key) WHERE leaf <> hub AND (members <= 2 OR kind = 'external_id')),
pairs2 AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS node, a AS other FROM pairs2 UNION SELECT reach.node, pairs2.b FROM reach JOIN pairs2 ON reach.other = pairs2.a),
roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node),
sizes AS (SELECT root, count(*) AS members FROM roots GROUP BY root),
refuted AS (SELECT DISTINCT x.root FROM direct JOIN roots x ON x.node = 'cust:' || l JOIN roots y ON y.node = 'cust:' || r WHERE method = 'human_rejected' AND x.root = y.root),
held AS (SELECT root, members, CASE WHEN root IN (SELECT root FROM refuted) THEN 'anti_link_split' WHEN members > 6 THEN 'size_cap_exceeded' END AS reason FROM sizes WHERE members >= 2),
badge AS (SELECT root, min(tier) AS best, bool_or(method = 'human_confirmed') AS human, min(CASE WHEN tier = 1 THEN '0' || method ELSE '1' || method END) AS m, CAST(count(DISTINCT id) AS INT) AS evidence_count FROM links JOIN roots ON node = a GROUP BY root),
aliases AS (SELECT node AS ref, 'canon:' || root AS canonical, CASE WHEN best = 1 THEN 'deterministic' WHEN human THEN 'human_confirmed' ELSE 'approximated' END AS confidence, substr(m, 2) AS method, evidence_count, members FROM roots JOIN held USING (root) JOIN badge USING (root) WHERE reason IS NULL)"""

ORACLE_SQL = {
    "canon_email": f"WITH {_EMAIL},\n{_site('SELECT c_custkey, email AS raw FROM em')} SELECT c_custkey, email, domain FROM em JOIN dom USING (c_custkey)",
    "canon_domain": f"WITH {_site(f'SELECT c_custkey, {RAW_SITE} AS raw FROM customer')} SELECT * FROM dom",
    "canon_phone": f"WITH p AS (SELECT c_custkey, trim({RAW_PHONE}) AS t FROM customer), q AS (SELECT *, regexp_replace(t, '[^0-9]', '', 'g') AS d, starts_with(t, '+') AS plus FROM p), s AS (SELECT *, NOT plus AND starts_with(d, '00') AS abroad FROM q), u AS (SELECT *, CASE WHEN abroad THEN substr(d, 3) ELSE d END AS e FROM s) SELECT c_custkey, CASE WHEN length(e) >= 8 THEN CASE WHEN NOT plus AND NOT abroad AND length(e) = 10 THEN '+1' ELSE '+' END || e END AS phone FROM u",
    "canon_name": f"WITH n AS (SELECT c_custkey, trim(regexp_replace(lower({RAW_NAME}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS w FROM customer) SELECT c_custkey, nullif(regexp_replace(w, '(^| )({_LEGAL})( ({_LEGAL}))*$', ''), '') AS name, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN 'internal_directory' ELSE 'customer_contact' END AS namespace FROM n",
    "tier1_evidence": f"WITH {_KEYS}, s AS (SELECT key_kind, key_value, count(*) AS n, min(ref) AS a, max(ref) AS b FROM keys WHERE key_value IS NOT NULL GROUP BY 1, 2) SELECT a AS left_ref, b AS right_ref, key_kind, key_value FROM s WHERE n = 2 UNION ALL SELECT ref, 'key:' || key_kind || ':' || key_value, key_kind, key_value FROM keys JOIN s USING (key_kind, key_value) WHERE n > 2",
    "fold_components": f"WITH RECURSIVE {_EV} SELECT * FROM aliases",
    "fold_reviews": f"WITH RECURSIVE {_EV} SELECT reason, root AS subject, members FROM held WHERE reason IS NOT NULL UNION ALL SELECT 'key_fan_out', key, members FROM sized WHERE members > 2 AND kind <> 'external_id'",
    "fold_drift": f"WITH RECURSIVE {_EV} SELECT canonical, count(DISTINCT ref) AS fused, max(members) AS members, bool_or(confidence <> 'deterministic') AS weak FROM aliases WHERE regexp_matches(ref, '[1257]$') GROUP BY canonical HAVING count(DISTINCT ref) >= 2 AND (max(members) >= 4 OR bool_or(confidence <> 'deterministic'))",
    "canonical_entities": f"WITH RECURSIVE {_EV} SELECT entity, members FROM (SELECT 0 AS part, canonical AS entity, count(*) AS members FROM aliases GROUP BY canonical UNION ALL SELECT 1, 'cust:' || c_custkey, 1 FROM customer WHERE 'cust:' || c_custkey NOT IN (SELECT ref FROM aliases)) ORDER BY part, entity LIMIT 200",
    "review_queue": f"""WITH RECURSIVE {_EV}, al AS (SELECT 'cust:' || c_custkey AS ref, 'canon:' || (c_custkey // 20) AS canonical FROM customer WHERE c_custkey % 10 IN (5, 7)), n AS (SELECT canonical, count(*) AS n FROM al GROUP BY 1),
ev AS (SELECT id, 'cust:' || l AS left_ref, 'cust:' || r AS right_ref, tier, method, {b.BASE} + l * 600 AS valid_from, CASE WHEN method = 'human_rejected' THEN -1 ELSE 1 END AS polarity FROM direct UNION ALL SELECT id, leaf, key, 1, key_kind, {b.BASE}, 1 FROM star),
f AS (SELECT least(left_ref, right_ref) AS a, greatest(left_ref, right_ref) AS b, count(*) AS frequency FROM ev WHERE polarity = 1 GROUP BY 1, 2),
o AS (SELECT e.*, f.frequency, x.canonical AS c1, y.canonical AS c2 FROM ev e JOIN f ON f.a = least(left_ref, right_ref) AND f.b = greatest(left_ref, right_ref) LEFT JOIN al x ON x.ref = left_ref LEFT JOIN al y ON y.ref = right_ref WHERE polarity = 1 AND method NOT IN ('human_confirmed', 'human_rejected')
  AND NOT EXISTS (SELECT 1 FROM ev z WHERE z.polarity = -1 AND least(z.left_ref, z.right_ref) = f.a AND greatest(z.left_ref, z.right_ref) = f.b) AND (x.canonical = y.canonical) IS NOT TRUE),
v AS (SELECT o.*, coalesce(n1.n, 0) + coalesce(n2.n, 0) AS entity_value, ({NOW} - valid_from) / 86400.0::DOUBLE AS days FROM o LEFT JOIN n n1 ON n1.canonical = c1 LEFT JOIN n n2 ON n2.canonical = c2)
SELECT id, left_ref, right_ref, frequency, entity_value, round(1.5::DOUBLE * ln(1 + frequency) + ln(1 + entity_value) + 2.0 * CASE tier WHEN 1 THEN 1.2::DOUBLE WHEN 2 THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END + exp(-days / 14.0::DOUBLE) + 0.2::DOUBLE * days, 6) AS priority, valid_from FROM v ORDER BY priority DESC, valid_from, id LIMIT 100""",
    "tier2_blocking": """WITH e AS (SELECT 'part:' || p_partkey AS ref, lower(p_name) || ' ' || lower(p_brand) AS name, CASE WHEN p_partkey % 9 = 0 THEN 'firm' || (p_partkey % 45) || '.com' END AS domain FROM part),
g AS MATERIALIZED (SELECT ref, domain, list_distinct(list_filter(string_split(name, ' '), lambda w: w <> '')) AS words, list_distinct(list_transform(range(1, length('  ' || name || ' ') - 1), lambda i: substr('  ' || name || ' ', i, 3))) AS grams FROM e),
p AS (SELECT l.ref AS left_ref, r.ref AS right_ref, l.domain = r.domain AS same, len(list_intersect(l.words, r.words)) AS wi, len(l.words) + len(r.words) AS wn, len(list_intersect(l.grams, r.grams)) AS gi, len(l.grams) + len(r.grams) AS gn FROM g l JOIN g r ON l.ref < r.ref),
s AS (SELECT left_ref, right_ref, greatest(wi / (wn - wi), gi / (gn - gi), CASE WHEN same THEN 0.9::DOUBLE ELSE 0 END) AS raw FROM p) SELECT left_ref, right_ref, round(raw, 4) AS score FROM s WHERE raw >= 0.45""",
    "gazetteer_mentions": r"""WITH t AS (SELECT conv_id * 1000 + turn AS id, coalesce(text, '') || '. ' || c_name || ' wants: ' || upper(p_name) || '!' AS content FROM conversations JOIN customer ON c_custkey = 1 + conv_id % 150 JOIN part ON p_partkey = 1 + (conv_id * 7 + turn) % 190),
f AS (SELECT DISTINCT trim(regexp_replace(lower(n), '[^\p{L}\p{N}]+', ' ', 'g')) AS form FROM (SELECT p_name AS n FROM part UNION SELECT c_name FROM customer)), l AS (SELECT DISTINCT len(string_split(form, ' ')) AS n FROM f),
w AS (SELECT id, list_filter(string_split(regexp_replace(lower(content), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM t),
s AS (SELECT id, w, unnest(range(0, len(w))) AS p FROM w), r AS (SELECT id, p, array_to_string(w[p + 1 : p + n], ' ') AS form FROM s, l WHERE p + n <= len(w))
SELECT id, form, count(*) AS n, CAST(min(p) AS INT) AS first_at FROM r WHERE form IN (FROM f) GROUP BY ALL""",
    "gazetteer_near": r"""WITH m AS (SELECT DISTINCT p_brand || ' ' || p_name || CASE WHEN p_partkey % 3 = 0 THEN ' new' ELSE '' END AS mention FROM part), f AS (SELECT DISTINCT p_name || ' ' || p_brand || ' made' AS form FROM part),
mw AS MATERIALIZED (SELECT mention, list_distinct(list_filter(string_split(regexp_replace(lower(mention), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')) AS a FROM m), fw AS MATERIALIZED (SELECT form, list_distinct(list_filter(string_split(regexp_replace(lower(form), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')) AS b FROM f),
p AS (SELECT mention, form, len(list_intersect(a, b)) AS i, len(a) + len(b) AS n FROM mw, fw) SELECT mention, form, round(i / (n - i), 4) AS score FROM p WHERE i / (n - i) >= 0.6""",
    "tier2_classes": """WITH e AS MATERIALIZED (SELECT 'part:' || p_partkey AS ref, lower(p_name) || ' ' || lower(p_brand) AS name, CASE WHEN p_partkey % 9 = 0 THEN 'firm' || (p_partkey % 45) || '.com' END AS domain FROM part),
g AS MATERIALIZED (SELECT name, min(ref) AS rep, list_distinct(list_filter(string_split(name, ' '), lambda w: w <> '')) AS words, list_distinct(list_transform(range(1, length('  ' || name || ' ') - 1), lambda i: substr('  ' || name || ' ', i, 3))) AS grams FROM e GROUP BY name),
p AS (SELECT l.rep AS a, r.rep AS b, len(list_intersect(l.words, r.words)) AS wi, len(l.words) + len(r.words) AS wn, len(list_intersect(l.grams, r.grams)) AS gi, len(l.grams) + len(r.grams) AS gn FROM g l JOIN g r ON l.name < r.name),
s AS (SELECT a, b, greatest(wi / (wn - wi), gi / (gn - gi)) AS raw FROM p), d AS (SELECT domain, min(ref) AS rep FROM e WHERE domain IS NOT NULL GROUP BY 1)
SELECT 'name' AS kind, least(a, b) AS left_ref, greatest(a, b) AS right_ref, round(raw, 4) AS score FROM s WHERE raw >= 0.45 UNION ALL SELECT 'member', rep, ref, 1.0::DOUBLE FROM e JOIN g USING (name) WHERE ref <> rep
UNION ALL SELECT 'domain', rep, ref, 0.9::DOUBLE FROM e JOIN d USING (domain) WHERE ref <> rep""",
    "tier2_evidence": """WITH e AS (SELECT p_partkey, 'part:' || p_partkey AS ref, lower(p_name) || ' ' || lower(p_brand) AS name, 'firm' || (p_partkey % 45) || '.com' AS domain FROM part WHERE p_partkey % 9 = 0),
g AS MATERIALIZED (SELECT ref, domain, list_distinct(list_filter(string_split(name, ' '), lambda w: w <> '')) AS words, list_distinct(list_transform(range(1, length('  ' || name || ' ') - 1), lambda i: substr('  ' || name || ' ', i, 3))) AS grams FROM e),
p AS (SELECT l.ref AS left_ref, r.ref AS right_ref, l.domain, len(list_intersect(l.words, r.words)) AS wi, len(l.words) + len(r.words) AS wn, len(list_intersect(l.grams, r.grams)) AS gi, len(l.grams) + len(r.grams) AS gn FROM g l JOIN g r ON l.ref < r.ref AND l.domain = r.domain)
SELECT left_ref, right_ref, 'name_match' AS method, 2 AS tier, 1 AS polarity, 'name+domain_fuzzy; judge: exact shared domain ' || domain AS key_value, round(greatest(wi / (wn - wi), gi / (gn - gi), 0.9::DOUBLE), 4) AS score FROM p WHERE wi > 0""",
    "human_decisions": """WITH RECURSIVE l AS (SELECT c_custkey AS a, c_custkey + 2 AS b, 1 AS p FROM customer WHERE c_custkey % 10 = 5 UNION ALL SELECT c_custkey, c_custkey + 1, 1 FROM customer WHERE c_custkey % 30 = 7 UNION ALL SELECT c_custkey, c_custkey + 2, -1 FROM customer WHERE c_custkey % 30 = 25),
e AS (SELECT 'cust:' || a AS a, 'cust:' || b AS b FROM l WHERE p = 1 UNION SELECT 'cust:' || b, 'cust:' || a FROM l WHERE p = 1), reach AS (SELECT a AS node, a AS other FROM e UNION SELECT reach.node, e.b FROM reach JOIN e ON reach.other = e.a),
root AS (SELECT node, min(other) AS root FROM reach GROUP BY node), split AS (SELECT x.root FROM l JOIN root x ON x.node = 'cust:' || a JOIN root y ON y.node = 'cust:' || b AND x.root = y.root WHERE p = -1)
SELECT 'cust:' || c_custkey AS ref, coalesce(CASE WHEN root NOT IN (FROM split) THEN 'canon:' || root END, 'cust:' || c_custkey) AS canonical FROM customer LEFT JOIN root ON node = 'cust:' || c_custkey""",
    "chunk_tags": """WITH e AS (SELECT 'chunk:' || (event_id % 900) AS chunk, user_id, event_id % 3 = 0 AS canon, event_id % 5 = 0 OR event_id % 11 = 0 AS anchors FROM events WHERE event_id % 13 <> 0),
a AS (SELECT chunk, bool_or(anchors) AS anchored FROM e GROUP BY 1)
SELECT chunk, array_to_string(list_sort(list(DISTINCT 'canon:user:' || user_id)), ',') AS tags, 'deterministic' AS confidence FROM e JOIN a USING (chunk) WHERE anchored AND user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY chunk""",
    "resolution_run": f"""WITH RECURSIVE {_EV}, known AS (SELECT canonical FROM aliases UNION SELECT 'canon:cust:' || c_custkey FROM customer WHERE c_custkey % 10 IN (1, 2, 5, 7)),
m AS (SELECT event_id % 900 AS chunk, user_id, event_id % 5 = 0 AS anchors FROM events), w AS (SELECT chunk, bool_or(anchors) AS anchored FROM m GROUP BY 1),
dr AS (SELECT canonical FROM aliases WHERE regexp_matches(ref, '[1257]$') GROUP BY canonical HAVING count(DISTINCT ref) >= 2 AND (max(members) >= 8 OR bool_or(confidence <> 'deterministic')))
SELECT 'aliases' AS part, count(*) AS n FROM aliases UNION ALL SELECT 'reviews', (SELECT count(*) FROM held WHERE reason IS NOT NULL) + (SELECT count(*) FROM sized WHERE members > 2 AND kind <> 'external_id')
UNION ALL SELECT 'drift', count(*) FROM dr UNION ALL SELECT 'tags', count(DISTINCT chunk) FROM m JOIN w USING (chunk) WHERE anchored AND 'canon:cust:' || user_id IN (FROM known)""",
    "surface_scores": "SELECT event_id, round(CASE WHEN event_id % 3 = 0 THEN least(1.0::DOUBLE, s + 0.4) ELSE s END, 4) AS score FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5 WHEN 2 THEN 2.0::DOUBLE / 3 ELSE 0 END AS s FROM events)",
    "mention_detect": """WITH w AS (SELECT conv_id * 1000 + turn AS id, list_filter(string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM conversations),
s AS (SELECT id, w, unnest(range(0, len(w))) AS at_w FROM w), f AS (SELECT id, at_w, array_to_string(w[at_w + 1 : at_w + n], ' ') AS form FROM s, (SELECT unnest([1, 2, 3, 4, 5]) AS n) WHERE at_w + n <= len(w))
SELECT id, form, count(*) AS n, CAST(min(at_w) AS INT) AS first_at FROM f WHERE form IN ('the', 'of the', 'and', 'que', 'in the') GROUP BY ALL""",
    "tier3_decision": """WITH c AS (SELECT event_id // 3 AS mention, 'canon:' || (user_id % 11) AS canonical, (event_id * 37 % 101) / 100.0::DOUBLE AS score, event_id % 2 = 0 AS co_signal, user_id % 3 <> 0 AS folded, event_id % 19 = 0 AS human FROM events),
t AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS second FROM c WINDOW w AS (PARTITION BY mention ORDER BY score DESC, canonical)) SELECT mention, canonical, score, CASE WHEN score < 0.7 THEN 'nil' WHEN round(score - second, 9) < 0.15 THEN 'abstain_margin' WHEN folded AND (co_signal OR human) THEN 'tag' ELSE 'reviewer_hint' END AS outcome FROM t WHERE r = 1""",
    "echo_tagger": b.sql("chunks", then=", n(entity) AS (VALUES ('lang:the'), ('topic:und'), ('topic:que'), ('topic:la'), ('lang:en')) SELECT id, entity, CAST(0.95 AS DOUBLE) AS confidence FROM chunks JOIN n ON contains(lower(content), split_part(entity, ':', -1)) AND NOT list_contains(tags, entity) WHERE length(split_part(entity, ':', -1)) >= 3"),
}
