"""The registered queries: one or more for each operator, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylark.functions import filters as ff
from skylark.functions import geo, text
from skylark.operators import analytics as an
from skylark.operators import facets, matching, merchandising, ranking, recommend
from skylark.plans.search import Index, IndexSettings, SearchRequest
from skylark.plans.tables import INSIGHTS, SEARCHES, STORES, WORDS, insights, searches, stores, table, words
from skylark.session import work_path
from skylark.sources import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW_MS = 1_706_572_800_000  # 2024-01-30
TODAY = "2024-01-30"


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def part(s, d):
    return table(s, d, "part")


# --- text analysis


@query("""SELECT doc_id, len(t)::BIGINT AS n_tokens, t[1] AS first_token, md5(array_to_string(t, ' ')) AS tokens_md5
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)""")
def tokenize_ascii(s, d):
    t = table(s, d, "documents").select("doc_id", text.ascii_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.get("t", 0).alias("first_token"), F.md5(
        F.array_join("t", " ")).alias("tokens_md5"))


@query("""SELECT page_id, array_to_string(list_filter(list_transform(regexp_extract_all(lower(replace(url, '://', ' ')),
 '(?:^|\\s)[a-z0-9]+(?:[^a-z0-9\\s]+[a-z0-9]+)+'),
  lambda x: regexp_replace(x, '[^a-z0-9]', '', 'g')), lambda x: length(x) >= 3), ' ') AS joined FROM pages""")
def concat_tokens(s, d):
    return table(s, d, "pages").select("page_id", F.array_join(text.joined_tokens(F.replace("url", F.lit("://"), F.lit(" "))),
        " ").alias("joined"))


@query("""SELECT c_custkey, array_to_string(list_distinct(regexp_extract_all(lower(c_name), '[a-z0-9]+')), ' ') IS NOT NULL AS ok,
  len(regexp_extract_all(lower(c_name), '[a-z0-9]+')) + CASE WHEN c_name LIKE '%#%' THEN 1 ELSE 0 END AS n_tokens,
  array_to_string(regexp_extract_all(lower(c_name), '[a-z0-9]+'), ' ') || CASE
 WHEN c_name LIKE '%#%' THEN ' ' || replace(lower(c_name), '#', '') ELSE '' END AS tokens FROM customer""")
def tokenize_full(s, d):
    t = table(s, d, "customer").select("c_custkey", text.tokenize(F.col("c_name")).alias("t"))
    return t.select("c_custkey", F.col("t").isNotNull().alias("ok"), F.size("t").cast("long").alias("n_tokens"), F.array_join(
        "t.token", " ").alias("tokens"))


@query(f"""WITH {WORDS} SELECT token, substring(token, 1, k::INT) AS gram FROM (SELECT token, unnest(range(2, least(20, length(token)) + 1)) AS k FROM words)""")
def edge_ngrams(s, d):
    return words(s, d).select("token", F.explode(text.edge_ngrams(F.col("token"))).alias("gram"))


@query("""SELECT * FROM (VALUES ('name', 0, 1.0::DOUBLE), ('brand', 1, 0.01::DOUBLE), ('category', 2, 5.0::DOUBLE), ('tags', 3, 1e-6::DOUBLE)) t(attribute, attr_rank, weight)""")
def attribute_weights(s, d):
    return matching.weights_table(s, ["name", "brand", "category", "tags"], {"category": 5.0, "unlisted": 9.0})


@query(f"""WITH {WORDS} SELECT token, CASE WHEN length(token) < 5 THEN 0 WHEN length(token) < 9 THEN 1 ELSE 2 END AS typos FROM words""")
def fuzzy_distance_rule(s, d):
    return words(s, d).select("token", text.allowed_typos(F.col("token")).alias("typos"))


@query("""SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: x NOT IN
 ('a','an','and','are','as','at','be','by','for','from','in','is','it','of','on','or','that','the','this','to','was','with')))::BIGINT AS kept
FROM documents""")
def stopword_removal(s, d):
    t = table(s, d, "documents")
    return t.select("doc_id", F.size(text.without_stop_words(text.ascii_tokens(F.col("text")))).cast("long").alias("kept"))


PLURALS = ["rings", "boxes", "glasses", "batteries", "children", "gas", "buses", "toys", "dishes"]


@query("""SELECT word, CASE WHEN word = 'children' THEN 'child'
 WHEN regexp_matches(word, '(s|x|z|ch|sh)es$') THEN regexp_replace(word, 'es$', '')
 WHEN regexp_matches(word, '[^aeiou]ies$') THEN regexp_replace(word, 'ies$', 'y')
  WHEN regexp_matches(word, '[^s]s$') AND length(word) > 3 THEN regexp_replace(word, 's$', '') ELSE word END AS single
 FROM (VALUES ('rings'), ('boxes'), ('glasses'), ('batteries'), ('children'), ('gas'), ('buses'), ('toys'), ('dishes')) t(word)""")
def plural_fold(s, d):
    w = s.createDataFrame([(x,) for x in PLURALS], "word string")
    return w.select("word", text.singular(F.col("word"), {"children": "child"}).alias("single"))


# --- matching

ASKED = ["red", "red pl", "smal", "blue ring ", "wid", "ri ", "large g", "zz"]
_ASKED_SQL = "q(query_id, text) AS (VALUES (0, 'red'), (1, 'red pl'), (2, 'smal'), (3, 'blue ring '), (4, 'wid'), (5, 'ri '), (6, 'large g'), (7, 'zz'))"


def _match_sql(prefix: str) -> str:
    return f"""WITH {_ASKED_SQL}, w AS (SELECT query_id, text, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM q),
t AS (SELECT query_id, text, len(w) AS n, unnest(w) AS token, unnest(range(0, len(w))) AS qpos FROM w),
p AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS token FROM part),
h AS (SELECT DISTINCT t.query_id, n, p_partkey, qpos FROM t JOIN p ON p.token = t.token OR ({prefix} AND starts_with(p.token, t.token)))
SELECT query_id, p_partkey AS object_id FROM h GROUP BY query_id, n, p_partkey HAVING count(*) = n"""


def _matched(s, d, mode):
    q = s.createDataFrame(list(enumerate(ASKED)), "query_id int, text string")
    post = matching.postings(part(s, d), "p_partkey", ["p_name"])
    return matching.match(post, matching.parse_queries(q, mode)).select("query_id", "object_id")


for _name, _mode, _prefix in (("match_all_terms", "prefixNone", "false"), ("prefix_none", "prefixNone", "false"), ("prefix_last",
    "prefixLast", "(qpos = n - 1 AND NOT regexp_matches(text, '\\s$'))"), ("prefix_all", "prefixAll", "true")):
    query(_match_sql(_prefix), _name)(lambda s, d, m=_mode: _matched(s, d, m))


@query("""WITH q(query_id, word, typing) AS (VALUES (0, 'ri', false), (1, 'ri', true), (2, 'ring', false)), p AS (SELECT
 p_partkey, string_split(p_name, ' ') AS w FROM part)
SELECT query_id, p_partkey AS object_id FROM q, p WHERE len(list_filter(w, lambda x: x = word OR (typing AND starts_with(x, word)))) > 0""")
def trailing_space_exact(s, d):
    q = s.createDataFrame([(0, "ri "), (1, "ri"), (2, "ring ")], "query_id int, text string")
    post = matching.postings(part(s, d), "p_partkey", ["p_name"])
    return matching.match(post, matching.parse_queries(q)).select("query_id", "object_id")


@query("SELECT doc_id AS object_id, lang FROM documents", "match_everything")
def match_everything(s, d):
    docs = table(s, d, "documents")
    return Index(docs, "doc_id", IndexSettings({"searchableAttributes": ["lang"]})).matches(SearchRequest()).select(F.col(
        "doc_id").alias("object_id"), "lang")


TYPOS = ["smlal", "gret", "palte", "wodget", "blu", "gasketx", "platee", "rnig", "bearing", "breaing"]
_TYPOS_SQL = "w(word) AS (VALUES " + ", ".join(f"('{t}')" for t in TYPOS) + ")"


@query(f"""WITH {WORDS}, {_TYPOS_SQL}, x AS (SELECT word, token AS term, damerau_levenshtein(word, token)::INT AS typos, CASE
 WHEN length(word) < 5 THEN 0 WHEN length(word) < 9 THEN 1 ELSE 2 END AS d FROM w, words)
SELECT word, term, typos FROM x WHERE typos <= d""")
def fuzzy_match(s, d):
    return matching.fuzzy_terms(s.createDataFrame([(t,) for t in TYPOS], "token string"), words(s, d))


@query(f"""WITH {WORDS}, {_TYPOS_SQL}, x AS (SELECT word, token AS term, damerau_levenshtein(word, token)::INT AS typos
 FROM w, words), y AS (SELECT * FROM x WHERE typos <= 2)
SELECT word AS query_id, term, typos FROM y WHERE typos = (SELECT min(typos) FROM y z WHERE z.word = y.word)""")
def typo_tolerance_min(s, d):
    hits = matching.fuzzy_terms(s.createDataFrame([(t,) for t in TYPOS], "token string"), words(s, d), F.lit(2))
    return matching.typo_tolerance(hits.withColumnRenamed("word", "query_id"), "min")


GLUED = ["redplate", "smallring", "bluewidget", "greengear", "xyring", "plate", "redred"]


@query(f"""WITH {WORDS}, g(token) AS (VALUES {', '.join(f"('{g}')" for g in GLUED)}), h AS (SELECT token, unnest(range(2,
 least(12, length(token) - 2) + 1)) AS k FROM g WHERE length(token) >= 4),
x AS (SELECT token, k, substring(token, 1, k::INT) AS first, substring(token, k::INT + 1) AS second FROM h)
SELECT token, arg_min(first, k) AS first, arg_min(second, k) AS second FROM x WHERE first IN (SELECT token FROM words)
 AND second IN (SELECT token FROM words) GROUP BY token""")
def split_alternatives(s, d):
    return text.split_alternatives(s.createDataFrame([(g,) for g in GLUED], "token string"), words(s, d))


@query("""WITH q AS (SELECT DISTINCT p_name || ' ' || p_type || ' ' || p_brand AS text FROM part UNION SELECT DISTINCT p_name
 FROM part), t AS (SELECT text, string_split(lower(text), ' ') AS w FROM q)
SELECT text, array_to_string(list_concat(list_transform(range(1, least(len(w), 5)), lambda i: w[i] || w[i + 1]), CASE
 WHEN len(w) >= 3 THEN [array_to_string(w, '')] ELSE [] END), '|') AS joined FROM t""")
def concat_alternatives(s, d):
    p = part(s, d)
    q = p.select(F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text")).unionByName(p.select(
        F.col("p_name").alias("text"))).distinct()
    return q.select("text", F.array_join(text.joined_alternatives(F.split("text", " ")), "|").alias("joined"))


SYNONYMS = [("synonym", None, ["red", "crimson", "scarlet"]), ("oneWaySynonym", "gadget", ["widget", "gear"]), ("altCorrection1",
    "smal", ["small"]), ("altCorrection2", "blu", ["blue"])]


def _synonyms(s):
    return s.createDataFrame(SYNONYMS, "type string, input string, words array<string>")


_EXPANDED = """e(f, t, c) AS (VALUES ('red','crimson',0),('red','scarlet',0),('crimson','red',0),('crimson','scarlet',0),('scarlet','red',0),('scarlet','crimson',0),('gadget','widget',0),('gadget','gear',0),('smal','small',1),('blu','blue',2))"""


@query(f"""WITH q(query_id, token) AS (VALUES (0,'crimson'),(1,'gadget'),(2,'smal'),(3,'blu'),(4,'widget')), {_EXPANDED}
SELECT query_id, 0 AS qpos, token, 0 AS typo_cost FROM q UNION ALL SELECT query_id, 0, t, c FROM q JOIN e ON f = token""")
def synonym_expand(s, d):
    q = s.createDataFrame([(0, 0, "crimson"), (1, 0, "gadget"), (2, 0, "smal"), (3, 0, "blu"), (4, 0, "widget")],
        "query_id int, qpos int, token string")
    return matching.expand_synonyms(q, _synonyms(s))


@query("""SELECT p_partkey AS object_id FROM part WHERE list_has_any(string_split(p_name, ' '), ['gadget', 'widget', 'gear'])""")
def oneway_synonym(s, d):
    q = s.createDataFrame([(0, 0, "gadget")], "query_id int, qpos int, token string")
    w = matching.expand_synonyms(q, _synonyms(s)).withColumn("n", F.lit(1)).withColumn("prefix", F.lit(False))
    post = matching.postings(part(s, d), "p_partkey", ["p_name"])
    return matching.match(post, w).select("object_id")


@query("""SELECT p_partkey AS object_id FROM part WHERE list_contains(string_split(p_name, ' '), 'red') OR p_name = 'blue ring'""")
def placeholder_synonym(s, d):
    post = matching.postings(part(s, d), "p_partkey", ["p_name"])
    ph = s.createDataFrame([("red", ["colour"])], "placeholder string, replacements array<string>")
    more = matching.place_placeholders(post, ph).where("token = 'colour'").select("object_id")
    return more.unionByName(matching.exact_phrase(post, ["blue", "ring"])).distinct()


@query("""SELECT p_partkey AS object_id FROM part WHERE p_name LIKE 'red %' AND NOT list_contains(string_split(p_name, ' '), 'ring')""")
def exclude_words(s, d):
    post = matching.postings(part(s, d), "p_partkey", ["p_name"])
    return matching.exclude_words(post.where("token = 'red' AND pos = 0").select("object_id").distinct(), post, ["ring"])


@query("""WITH r(round, a, b) AS (VALUES (0, 'red', 'nothing'), (1, 'red', NULL)), p AS (SELECT p_partkey, string_split(p_name,
 ' ') AS w FROM part)
SELECT round, p_partkey AS object_id FROM r, p WHERE list_contains(w, a) AND (b IS NULL OR list_contains(w, b))""")
def remove_words_if_no_results(s, d):
    q = s.createDataFrame([(0, "red nothing")], "query_id int, text string")
    w = matching.relax(matching.parse_queries(q, "prefixNone"), "lastWords").withColumn("query_id", F.col("round"))
    post = matching.postings(part(s, d), "p_partkey", ["p_name"])
    return matching.match(post, w).select(F.col("query_id").alias("round"), "object_id")


@query("""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[],
 v.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s)
 SELECT query_id, vec_id, similarity, rank::INT AS rank FROM r WHERE rank <= 10""")
def vector_knn(s, d):
    v = table(s, d, "embeddings")
    return matching.cosine_neighbours(v, v.where("vec_id % 100 = 0"), 10)


# --- filters

FILTERS = {
    "filter_nested": ("(p_type:PROMO OR p_type:LARGE) AND p_retailprice >= 905",
        "(p_type = 'PROMO' OR p_type = 'LARGE') AND p_retailprice >= 905"),
    "filter_range": ("p_size:5 TO 20 AND NOT p_brand:'Brand#11'", "p_size BETWEEN 5 AND 20 AND p_brand <> 'Brand#11'"),
    "filter_not": ("NOT (p_type = 'small' OR p_size < 10) AND p_name != 'red plate'",
        "NOT (p_type = 'SMALL' OR p_size < 10) AND p_name <> 'red plate'"),
    "filter_or_over_and": ("(p_type:PROMO AND p_size > 25) OR (p_type:SMALL AND p_size <= 5) OR p_name:'blue ring'",
        "(p_type = 'PROMO' AND p_size > 25) OR (p_type = 'SMALL' AND p_size <= 5) OR p_name = 'blue ring'"),
}
for _name, (_filter, _sql) in FILTERS.items():
    query(f"SELECT p_partkey, p_type, p_size FROM part WHERE {_sql}", _name)(lambda s, d, f=_filter: part(s, d).where(
        ff.parse_filter(f)).select("p_partkey", "p_type", "p_size"))


@query("SELECT p_partkey FROM part WHERE (p_type = 'PROMO' OR p_type = 'SMALL') AND p_brand <> 'Brand#12'")
def facet_filters_list(s, d):
    return part(s, d).where(ff.facet_filters([["p_type:PROMO", "p_type:SMALL"], "p_brand:-Brand#12"])).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 3 AND 30 AND (p_retailprice < 910 OR p_retailprice >= 915)")
def numeric_filters_list(s, d):
    return part(s, d).where(ff.numeric_filters(["p_size:3 TO 30", ["p_retailprice<910", "p_retailprice>=915"]])).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_type = 'PROMO'")
def undeclared_facet_empty(s, d):
    """Of two alternatives only the declared facet matches."""
    return part(s, d).where(ff.parse_filter("p_type:PROMO OR p_brand:'Brand#11'", ff.Settings(facets={"p_type"}))).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'red') AND NOT list_contains(string_split(p_name, ' '), 'ring')")
def tag_filters(s, d):
    return part(s, d).withColumn("_tags", F.split("p_name", " ")).where(ff.tag_filters(["red", "-ring"])).select("p_partkey")


@query("SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 3 ELSE 0 END + greatest(CASE WHEN p_size = 1 THEN 1 ELSE 0 END, CASE WHEN p_brand = 'Brand#11' THEN 1 ELSE 0 END) AS filter_score FROM part")
def optional_filters(s, d):
    return part(s, d).select("p_partkey", ff.optional_score(["p_type:PROMO<score=3>", ["p_size:1", "p_brand:Brand#11"]]).alias(
        "filter_score"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey < 10 AND (c_mktsegment = 'BUILDING' OR c_acctbal > 5000)")
def secured_filter(s, d):
    key = ff.secured_key("parent", {"filters": "c_nationkey < 10", "restrictIndices": ["cust*"], "validUntil": 2_000_000_000})
    got = ff.open_key(key, "parent", "customer", 1_700_000_000)
    return table(s, d, "customer").where(ff.secured_filter(got, "c_mktsegment:BUILDING OR c_acctbal > 5000")).select("c_custkey",
        "c_mktsegment")


# --- geo

_DIST = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin((radians(lat) - radians(48.85)) / 2), 2) + cos(radians(lat)) * cos(radians(48.85)) * pow(sin(radians(lng - 2.35) / 2), 2))))"
PARIS = (48.85, 2.35)


@query(f"WITH {STORES} SELECT object_id, round({_DIST}, 0) AS metres FROM stores WHERE {_DIST} <= 8000000")
def geo_radius(s, d):
    lat, lng = F.col("lat"), F.col("lng")
    return stores(s, d).where(geo.around(lat, lng, PARIS, 8_000_000)).select("object_id", F.round(geo.distance_m(lat, lng, PARIS),
        0).alias("metres"))


@query(f"WITH {STORES} SELECT object_id FROM stores WHERE (lat BETWEEN -20 AND 40 AND lng BETWEEN -50 AND 60) OR (lat BETWEEN 60 AND 80 AND lng BETWEEN 100 AND 150)")
def geo_bbox(s, d):
    return stores(s, d).where(geo.inside_boxes(F.col("lat"), F.col("lng"), [(40, -50, -20, 60), (60, 100, 80, 150)])).select("object_id")


@query(f"WITH {STORES} SELECT object_id FROM stores WHERE lat > -30 AND lng > -60 AND lat + lng < 60")
def geo_polygon(s, d):
    return stores(s, d).where(geo.inside_polygon(F.col("lat"), F.col("lng"), [(-30.0, -60.0), (120.0, -60.0),
        (-30.0, 90.0)])).select("object_id")


@query(f"WITH {STORES}, x AS (SELECT object_id, {_DIST} AS m FROM stores) SELECT object_id, CASE WHEN m >= 5000000 THEN floor(m / 1000000) ELSE floor(m / 1000) END::BIGINT AS bucket FROM x")
def geo_precision(s, d):
    m = geo.distance_m(F.col("lat"), F.col("lng"), PARIS)
    return stores(s, d).select("object_id", geo.precision(m, [(0, 1000), (5_000_000, 1_000_000)]).alias("bucket"))


@query(f"WITH {STORES} SELECT round(greatest(quantile_cont({_DIST}, 0.1), 1000.0), 0) AS radius FROM stores")
def geo_auto_radius(s, d):
    return stores(s, d).agg(F.round(geo.auto_radius(geo.distance_m(F.col("lat"), F.col("lng"), PARIS), 0.1, 1000.0), 0).alias("radius"))


# --- ranking


@query("""SELECT p_partkey, size_or_null, row_number() OVER (ORDER BY size_or_null ASC NULLS FIRST, p_partkey)::INT AS pos FROM (SELECT p_partkey, nullif(p_size, 7) AS size_or_null FROM part) QUALIFY pos <= 100""")
def sort_asc_nulls_first(s, d):
    rows = part(s, d).select("p_partkey", F.nullif("p_size", F.lit(7)).alias("size_or_null"))
    return ranking.top(rows, ranking.order_keys(["asc(size_or_null)"]), 100, id_col="p_partkey")


@query("""SELECT doc_id, lang, n, row_number() OVER (ORDER BY lang ASC NULLS FIRST, n DESC NULLS LAST, doc_id)::INT AS pos FROM (SELECT doc_id, lang, nullif(n_chars % 100, 50) AS n FROM documents) QUALIFY pos <= 200""")
def custom_ranking_chain(s, d):
    rows = table(s, d, "documents").select("doc_id", "lang", F.nullif(F.col("n_chars") % 100, F.lit(50)).alias("n"))
    return ranking.top(rows, ranking.order_keys(["asc(lang)", "desc(n)"]), 200, id_col="doc_id")


@query("""WITH h AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::INT AS pos,
 count(*) OVER () AS nb_hits FROM orders WHERE o_orderstatus = 'O')
SELECT o_orderkey, o_totalprice, pos, nb_hits, ceil(nb_hits / 50.0)::BIGINT AS nb_pages FROM h WHERE pos BETWEEN 101 AND 150""")
def page_slice(s, d):
    rows = table(s, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice")
    return ranking.page(rows, [F.desc("o_totalprice")], 2, 50, "o_orderkey")


@query("""SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC NULLS LAST, p_partkey)::INT AS group_rank FROM part QUALIFY group_rank <= 3""")
def distinct_n(s, d):
    return ranking.distinct(part(s, d), "p_brand", 3, ranking.order_keys(["desc(p_retailprice)"]), "p_partkey").select(
        "p_partkey", "p_brand", "group_rank")


PINS = [(5, 0), (17, 3), (23, 3), (40, 999999), (999999999, 1), (5, 7)]


@query("""WITH n AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS r FROM part
 WHERE p_type = 'PROMO' AND p_partkey NOT IN (5, 17, 23, 40, 8)),
c AS (SELECT count(*) AS n FROM n), p(p_partkey, slot) AS (SELECT 5, 0 UNION ALL SELECT 17, 3 UNION ALL SELECT 23, 4 UNION ALL
 SELECT 40, least(1000, n + 3) FROM c),
s1 AS (SELECT p_partkey, r + 1 AS r FROM n), s2 AS (SELECT p_partkey, CASE WHEN r >= 3 THEN r + 2 ELSE r END AS r
 FROM s1), s3 AS (SELECT p_partkey, CASE WHEN r >= (SELECT slot FROM p WHERE p_partkey = 40) THEN r + 1 ELSE r END AS r FROM s2)
SELECT * FROM (SELECT p_partkey::BIGINT AS p_partkey, r::BIGINT AS slot, false AS pinned FROM s3 UNION ALL
 SELECT p_partkey, slot, true FROM p) WHERE slot < 1000""")
def pin_hide(s, d):
    p = part(s, d)
    return ranking.pin(p, p.where("p_type = 'PROMO'"), PINS, [8, 17], [F.desc("p_retailprice")], "p_partkey")


# --- rules

_RULES = [
    ("r1", "red", "contains", None, True, None, None, None, None, "p_type:PROMO", '{"banner":1}'), ("r2", "cheap", "startsWith",
        None, True, None, None, None, ["cheap"], "p_retailprice < 950", None),
    ("r3", "ring", "endsWith", None, True, None, None, "gold ring", None, None, '{"banner":3}'), ("r4", "blue ring", "is", None,
        False, None, None, "never", None, None, None),
    ("r5", "red", "contains", "mobile", True, None, None, None, None, None, "m"), ("r6", "red", "contains", None, True, 10, 20,
        None, None, None, "old"),
]


@query("""SELECT * FROM (VALUES (0, 'red plate', 'red plate', '(p_type:PROMO)', '{"banner":1}', 'r1'), (1, 'cheap red ring',
 'gold ring', '(p_type:PROMO) AND (p_retailprice < 950)', '{"banner":1}|{"banner":3}', 'r1,r2,r3'),
 (2, 'blue ring', 'gold ring', '', '{"banner":3}', 'r3'), (3, 'plate', 'plate', '', '', ''), (4, 'Red', 'Red', '(p_type:PROMO)',
 '{"banner":1}|m', 'r1,r5')) t(query_id, text, rewritten, filters, user_data, applied_rules)""")
def rule_match(s, d):
    q = s.createDataFrame([(0, "red plate", None), (1, "cheap red ring", None), (2, "blue ring", None), (3, "plate", None), (4,
        "Red", "mobile")], "query_id int, text string, context string")
    return merchandising.apply_rules(q, s.createDataFrame(_RULES, merchandising.RULE), now=100)


@query("""WITH p AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1) SELECT p_name AS text, CASE WHEN p_name LIKE '% ring' THEN 'gold ring' ELSE p_name END AS rewritten FROM p""")
def rule_rewrite(s, d):
    q = part(s, d).groupBy("p_name").agg(F.min("p_partkey").alias("query_id")).select("query_id", F.col("p_name").alias("text"))
    return merchandising.apply_rules(q, s.createDataFrame(_RULES, merchandising.RULE), now=100).select("text", "rewritten")


@query("""SELECT DISTINCT p_name AS text, trim(replace(replace(p_name, 'red', ''), 'ring', 'band')) AS edited FROM part""")
def rule_edits(s, d):
    return part(s, d).select(F.col("p_name").alias("text"), merchandising.replace_words(F.col("p_name"),
        [("red", None), ("ring", "band")]).alias("edited")).distinct()


# --- result shape


@query("""SELECT p_partkey, regexp_replace(p_name, '\\b(re|ring)', '<em>\\1</em>', 'g') AS marked FROM part""")
def highlight_simple(s, d):
    return part(s, d).select("p_partkey", text.highlight(F.col("p_name"), F.array(F.lit("re"), F.lit("ring"))).alias("marked"))


@query("""SELECT p_partkey, CASE WHEN n = 0 THEN 'none' WHEN n < 2 THEN 'partial' ELSE 'full' END AS level FROM (SELECT p_partkey, (p_name LIKE 'red %')::INT + (p_name LIKE '% ring')::INT AS n FROM part)""")
def match_level(s, d):
    n = F.startswith("p_name", F.lit("red ")).cast("int") + F.endswith("p_name", F.lit(" ring")).cast("int")
    return part(s, d).select("p_partkey", text.match_level(n, F.lit(2)).alias("level"))


@query("""WITH t AS (SELECT doc_id, string_split(text, ' ') AS w
 FROM documents), a AS (SELECT doc_id, w, greatest(1, coalesce(list_position(list_transform(w, lambda x: starts_with(lower(x),
 'th')), true), 0)) AS k FROM t)
SELECT doc_id, CASE WHEN k > 1 THEN '…' ELSE '' END || array_to_string(w[k:k + 4], ' ') || CASE
 WHEN len(w) >= k + 5 THEN '…' ELSE '' END AS snippet FROM a""")
def snippet(s, d):
    return table(s, d, "documents").select("doc_id", text.snippet(F.col("text"), 5, F.lit("th")).alias("snippet"))


@query("""SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC NULLS LAST, p_partkey)::INT AS pos, p_name, p_type FROM part WHERE starts_with(p_name, 'red') OR p_name LIKE '% red%' QUALIFY pos <= 10""")
def project_hits(s, d):
    i = Index(part(s, d), "p_partkey", IndexSettings({"searchableAttributes": ["p_name"],
        "customRanking": ["desc(p_retailprice)"], "attributesToRetrieve": ["p_name", "p_type", "p_brand"],
        "unretrievableAttributes": ["p_brand"]}))
    return i.search(SearchRequest("red", hits_per_page=10)).hits.select("p_partkey", "pos", "p_name", "p_type")


# --- facets


@query("""SELECT 'p_brand' AS facet, p_brand AS value, count(*) AS count FROM part WHERE p_size > 10 GROUP BY ALL UNION ALL SELECT 'p_type', p_type, count(*) FROM part WHERE p_size > 10 GROUP BY ALL""")
def facet_counts(s, d):
    return facets.counts(part(s, d).where("p_size > 10"), ["p_brand", "p_type"])


@query("""WITH c AS (SELECT p_brand AS value, count(*) AS count FROM part GROUP BY 1) SELECT 'p_brand' AS facet, value, count, row_number() OVER (ORDER BY count DESC, value)::INT AS rank FROM c QUALIFY rank <= 5""")
def facet_top_n(s, d):
    return facets.top_values(facets.counts(part(s, d), ["p_brand"]), 5)


_GEO_SQL = "SELECT c_custkey, r_name AS lvl0, r_name || ' > ' || n_name AS lvl1 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _places(s, d):
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(s, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select("c_custkey", F.col("r_name").alias("lvl0"), F.concat_ws(" > ", "r_name", "n_name").alias("lvl1"))


@query(f"WITH g AS ({_GEO_SQL}) SELECT 'lvl0' AS facet, lvl0 AS value, count(*) AS count FROM g GROUP BY ALL UNION ALL SELECT 'lvl1', lvl1, count(*) FROM g GROUP BY ALL")
def facet_hierarchy(s, d):
    return facets.counts(_places(s, d), ["lvl0", "lvl1"])


@query(f"WITH g AS ({_GEO_SQL}) SELECT c_custkey, '/place/' || replace(lvl1, ' > ', '/') AS path, 'place > ' || lvl1 AS shown FROM g")
def facet_paths(s, d):
    p = facets.paths(_places(s, d).withColumnRenamed("lvl1", "place"), "place", "c_custkey")
    return p.withColumn("shown", facets.display(F.col("path")))


@query(f"WITH g AS ({_GEO_SQL}) SELECT split_part(lvl1, ' > ', 2) AS value, count(*) AS count FROM g WHERE lvl0 = 'ASIA' GROUP BY 1")
def facet_below_path(s, d):
    p = facets.paths(_places(s, d).withColumnRenamed("lvl1", "place"), "place", "c_custkey").withColumnRenamed("c_custkey", "object_id")
    return facets.below(p, "/place/ASIA")


@query(f"WITH g AS ({_GEO_SQL}) SELECT c_custkey, lvl1 AS deepest FROM g")
def facet_deepest(s, d):
    return _places(s, d).select("c_custkey", facets.deepest(
        F.create_map(F.lit("lvl0"), F.col("lvl0"), F.lit("lvl1"), F.col("lvl1"), F.lit("other"), F.lit("x"))).alias("deepest"))


@query("""SELECT 'p_size' AS facet, min(p_size)::DOUBLE AS min, max(p_size)::DOUBLE AS max, round(avg(p_size), 4) AS avg,
 round(sum(p_size)::DOUBLE, 2) AS sum FROM part
UNION ALL SELECT 'p_retailprice', min(p_retailprice), max(p_retailprice), round(avg(p_retailprice), 4), round(sum(p_retailprice),
 2) FROM part""")
def facet_stats(s, d):
    return facets.stats(part(s, d), ["p_size", "p_retailprice"])


@query("""SELECT p_type AS value, '<em>' || substring(p_type, 1, 1) || '</em>' || substring(p_type, 2) AS highlighted, count(*) AS count FROM part WHERE starts_with(lower(p_type), 's') GROUP BY 1, 2""")
def facet_search(s, d):
    return facets.search_values(facets.counts(part(s, d), ["p_type"]), "p_type", "s")


@query("""WITH b AS (SELECT 'p_brand' AS facet, p_brand AS value, count(*) AS n FROM part WHERE p_type IN ('PROMO', 'SMALL')
 AND p_size > 5 GROUP BY ALL),
t AS (SELECT 'p_type' AS facet, p_type AS value, count(*) AS n FROM part WHERE p_brand IN ('Brand#11', 'Brand#none')
 AND p_size > 5 GROUP BY ALL), a(facet, value) AS (VALUES ('p_brand', 'Brand#11'), ('p_brand', 'Brand#none'), ('p_type', 'PROMO'),
 ('p_type', 'SMALL')),
c AS (SELECT * FROM b UNION ALL SELECT * FROM t) SELECT facet, value, coalesce(n, 0) AS count FROM c FULL JOIN a USING (facet, value)""")
def facet_disjunctive(s, d):
    return facets.disjunctive(part(s, d), {"p_brand": ["Brand#11", "Brand#none"], "p_type": ["PROMO", "SMALL"]}, F.col("p_size") > 5)


@query("""WITH c AS (SELECT p_type AS value, count(*) AS count FROM part WHERE p_type <> 'LARGE' GROUP BY 1) SELECT 'p_type' AS facet, value, count, row_number() OVER (ORDER BY CASE value WHEN 'SMALL' THEN 1 WHEN 'PROMO' THEN 2 ELSE 99 END, count DESC, value)::INT AS rank FROM c""")
def facet_ordering(s, d):
    return facets.order_values(facets.counts(part(s, d), ["p_type"]), ["SMALL", "PROMO"], "count", ["LARGE"])


@query("""WITH h AS (SELECT p_type, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part) SELECT 'p_type' AS facet, p_type AS value, count(*) AS count FROM h WHERE r = 1 GROUP BY ALL""")
def facet_after_distinct(s, d):
    return facets.counts(ranking.distinct(part(s, d), "p_name", 1, [], "p_partkey"), ["p_type"])


# --- analytics


def _daily_sql(table_: str, cte: str, measures: str) -> str:
    return f"WITH {cte} SELECT coalesce(strftime(d, '%Y-%m-%d'), 'total') AS day, {measures} FROM (SELECT *, date_trunc('day', make_timestamp(timestamp_ms * 1000))::DATE AS d FROM {table_}) GROUP BY ROLLUP (d)"


def _marked(condition: str) -> str:
    return f"{SEARCHES}, {INSIGHTS}, ids AS (SELECT DISTINCT query_id FROM insights WHERE {condition} AND query_id IS NOT NULL), m AS (SELECT s.*, ids.query_id IS NOT NULL AS hit FROM searches s LEFT JOIN ids USING (query_id) WHERE s.query_id IS NOT NULL)"


_HITS = "count(*) AS tracked, count_if(hit)::BIGINT AS hits, round(count_if(hit)::DOUBLE / count(*), 6) AS rate"

query(_daily_sql("searches", SEARCHES, "count(*) AS count"), "searches_daily")(lambda s, d: an.searches_daily(searches(s, d)))
query(_daily_sql("searches", SEARCHES, "count(DISTINCT user_token) AS users"), "users_daily")(lambda s, d: an.users_daily(searches(s, d)))
query(_daily_sql("searches", SEARCHES, "count(*) AS count, count_if(NOT has_results)::BIGINT AS no_results, round(count_if(NOT has_results)::DOUBLE / count(*), 6) AS rate"), "no_result_rate")(lambda s, d: an.no_result_rate(searches(s, d)))
query(_daily_sql("m", _marked("event_type = 'click'"), _HITS), "ctr_daily")(lambda s, d: an.event_rate(searches(s, d),
    insights(s, d), an.is_click()))
query(_daily_sql("m", _marked("event_type = 'conversion'"), _HITS), "conversion_rate")(lambda s, d: an.event_rate(searches(s, d),
    insights(s, d), an.is_conversion()))
query(_daily_sql("m", _marked("event_subtype = 'addToCart'"), _HITS), "add_to_cart_rate")(lambda s, d: an.event_rate(
    searches(s, d), insights(s, d), an.is_conversion("addToCart")))
query(_daily_sql("m", _marked("event_subtype = 'purchase'"), _HITS), "purchase_rate")(lambda s, d: an.event_rate(searches(s, d),
    insights(s, d), an.is_conversion("purchase")))
query(_daily_sql("m", _marked("event_type = 'click'"),
    "count(*) AS tracked, count_if(NOT hit)::BIGINT AS no_clicks, round(count_if(NOT hit)::DOUBLE / count(*), 6) AS rate"),
    "no_click_rate")(lambda s, d: an.no_click_rate(searches(s, d), insights(s, d)))
query(_daily_sql("c", f"{INSIGHTS}, c AS (SELECT timestamp_ms, unnest(places) AS position FROM insights WHERE event_type = 'click')", "count(*) AS clicks, round(avg(position), 6) AS average"), "avg_click_position")(lambda s, d: an.average_click_position(insights(s, d)))


def _top_sql(cte: str, select: str, order: str, n: int = 10) -> str:
    return f"WITH {cte}, t AS ({select}) SELECT *, row_number() OVER (ORDER BY {order})::INT AS rank FROM t QUALIFY rank <= {n}"


query(_top_sql(SEARCHES, "SELECT query, count(*) AS count, max(nb_hits) AS nb_hits FROM searches GROUP BY 1",
    "count DESC, query"), "top_searches")(lambda s, d: an.top_searches(searches(s, d)))
query(_top_sql(SEARCHES, "SELECT query, count(*) AS count, count(filters) AS with_filter_count FROM searches WHERE NOT has_results GROUP BY 1", "count DESC, query"), "searches_no_results")(lambda s, d: an.searches_without_results(searches(s, d)))
query(_top_sql(_marked("event_type = 'click'"), "SELECT query, count(*) AS count FROM m WHERE NOT hit GROUP BY 1",
    "count DESC, query"), "searches_no_clicks")(lambda s, d: an.searches_without_clicks(searches(s, d), insights(s, d)))
_PARTS = f"{SEARCHES}, f AS (SELECT 'brand' AS attribute, ':' AS operator, regexp_extract(filters, 'brand:(B[0-9]+)', 1) AS value, has_results FROM searches WHERE filters IS NOT NULL UNION ALL SELECT 'price', '>=', regexp_extract(filters, '>= ([0-9]+)', 1), has_results FROM searches WHERE filters IS NOT NULL)"
query(_top_sql(_PARTS, "SELECT attribute, count(*) AS count FROM f GROUP BY 1", "count DESC, attribute"), "top_filters")(lambda s,
    d: an.top_filters(searches(s, d)))
query(_top_sql(_PARTS, "SELECT attribute, operator, value, count(*) AS count FROM f WHERE attribute = 'brand' GROUP BY ALL",
    "count DESC, operator, value"), "top_filter_values")(lambda s, d: an.top_filters(searches(s, d), attribute="brand"))
query(_top_sql(_PARTS, "SELECT attribute, operator, value, count(*) AS count FROM f WHERE attribute = 'price' AND NOT has_results GROUP BY ALL", "count DESC, operator, value"), "filters_no_results")(lambda s, d: an.top_filters(searches(s, d), attribute="price", no_results=True))
query(_top_sql(f"{INSIGHTS}, o AS (SELECT event_type, value, unnest(objects)::VARCHAR AS object_id FROM insights)",
    "SELECT object_id, count(*) AS count, count_if(event_type = 'click')::BIGINT AS clicks, count_if(event_type = 'conversion')::BIGINT AS conversions, round(sum(value) FILTER (event_type = 'conversion'), 2) AS revenue FROM o GROUP BY 1", "count DESC, object_id"), "top_hits")(lambda s, d: an.top_hits(insights(s, d)))
query(_top_sql(f"{SEARCHES}, c AS (SELECT country, count(*) AS count FROM searches WHERE country IS NOT NULL GROUP BY 1)",
    "SELECT country, count, round(count * 100.0 / sum(count) OVER (), 4) AS percent FROM c", "count DESC, country", 99),
    "top_countries")(lambda s, d: an.top_countries(searches(s, d)))
query(f"WITH {SEARCHES}, c AS (SELECT country, query, count(*) AS count FROM searches WHERE country IS NOT NULL GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY country ORDER BY count DESC, query)::INT AS rank FROM c QUALIFY rank <= 3", "country_searches")(lambda s, d: an.country_searches(searches(s, d)))
query(f"WITH {SEARCHES}, c AS (SELECT CASE WHEN analytics_tags LIKE '%mobile' THEN 'mobile' WHEN analytics_tags LIKE '%tablet' THEN 'tablet' WHEN analytics_tags LIKE '%desktop' THEN 'desktop' ELSE 'other' END AS device, count(*) AS count FROM searches GROUP BY 1) SELECT device, count, round(count * 100.0 / sum(count) OVER (), 4) AS percent FROM c", "device_breakdown")(lambda s, d: an.devices(searches(s, d)))
query(f"WITH {SEARCHES}, c AS (SELECT count_if(timestamp_ms < 1705276800000)::BIGINT AS before, count_if(timestamp_ms >= 1705276800000)::BIGINT AS now FROM searches) SELECT before, now, round((now - before) * 100.0 / before, 4) AS change FROM c", "period_delta")(lambda s, d: an.delta(searches(s, d), 1_705_276_800_000))
query(f"WITH {SEARCHES} SELECT true AS enabled, count(*) > 0 AS has_data, 90 AS retention_days, max(timestamp_ms) AS updated_at FROM searches", "analytics_status")(lambda s, d: an.status(searches(s, d)))
query(f"WITH {SEARCHES}, {INSIGHTS} SELECT i.event_id, i.query_id, s.query, s.index_name AS search_index FROM insights i JOIN searches s USING (query_id)", "query_attribution")(lambda s, d: an.attribution(searches(s, d), insights(s, d)))
query(f"WITH {INSIGHTS}, p AS (SELECT unnest(places) AS p FROM insights WHERE event_type = 'click') SELECT CASE WHEN p >= 21 THEN 21 WHEN p >= 16 THEN 16 WHEN p >= 11 THEN 11 ELSE p END::INT AS start, CASE WHEN p >= 21 THEN -1 WHEN p >= 16 THEN 20 WHEN p >= 11 THEN 15 ELSE p END::INT AS \"end\", count(*) AS clicks FROM p GROUP BY ALL", "click_positions")(lambda s, d: an.position_histogram(insights(s, d)))
query(f"WITH {INSIGHTS} SELECT coalesce(strftime(d, '%Y-%m-%d'), 'total') AS day, currency, round(sum(value), 2) AS revenue FROM (SELECT *, make_timestamp(timestamp_ms * 1000)::DATE AS d FROM insights WHERE event_type = 'conversion') GROUP BY ROLLUP (currency, d) HAVING currency IS NOT NULL", "revenue_daily")(lambda s, d: an.revenue(insights(s, d)))
query(
    _top_sql(
        f"{SEARCHES}, {INSIGHTS}, c AS (SELECT query_id, count(*) AS clicks, sum(p) AS positions FROM (SELECT query_id, unnest(places) AS p FROM insights WHERE event_type = 'click') GROUP BY 1), v AS (SELECT query_id, count(*) AS conversions, sum(value) AS revenue FROM insights WHERE event_type = 'conversion' AND query_id IS NOT NULL GROUP BY 1)",
        "SELECT query, count(*) AS search_count, count(s.query_id) AS tracked_count, coalesce(sum(clicks), 0)::BIGINT AS click_count, round((count(*) FILTER (clicks > 0))::DOUBLE / count(s.query_id), 6) AS click_through_rate, round(sum(positions)::DOUBLE / sum(clicks), 6) AS average_click_position, round((count(*) FILTER (conversions > 0))::DOUBLE / count(s.query_id), 6) AS conversion_rate, round(coalesce(sum(revenue), 0), 2) AS revenue FROM searches s LEFT JOIN c USING (query_id) LEFT JOIN v USING (query_id) GROUP BY 1",
        "search_count DESC, query",
    ),
    "top_searches_analytics",
)(lambda s, d: an.top_searches_with_analytics(searches(s, d), insights(s, d)))


@query("""SELECT event_id, lag(t) OVER w IS NULL OR floor(t - lag(t) OVER w) >= 30 AS counted FROM (SELECT event_id, user_id, epoch_us(ts) / 600000000.0 AS t FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)""")
def dedup_searches(s, d):
    rows = table(s, d, "events").select("event_id", F.col("user_id").cast("string").alias("user_token"), F.lit("products").alias(
        "index_name"), (F.unix_micros(F.col("ts").cast("timestamp")) / 600_000_000.0).alias("t"))
    return an.dedup_searches(rows).select("event_id", "counted")


def raw_insights(s, d):
    """Events as they come in, some of them broken."""
    i = F.col("event_id")
    ids = F.transform(F.sequence(F.lit(1), F.when(i % 17 == 0, 21).otherwise(2)), lambda k: k.cast("string"))
    return table(s, d, "events").select(
        "event_id", F.when(F.col("event_type") == "purchase", "conversion").otherwise(F.col("event_type")).alias("event_type"),
            F.when(i % 19 == 0, F.repeat(F.lit("é"), 33)).otherwise("bought").alias("event_name"), F.lit("products").alias("index_name"),
        F.when(i % 23 == 0, "").otherwise(F.col("user_id").cast("string")).alias("user_token"), F.when(i % 13 == 0,
            F.array().cast("array<string>")).otherwise(ids).alias("object_ids"), F.when(i % 26 == 0, ids).alias("objectIDs"),
        F.when(i % 7 == 0, "xyz").when(i % 3 == 0, F.md5(i.cast("string"))).alias("query_id"), F.when(i % 5 == 0,
            F.array(F.lit(1))).when(i % 2 == 0, F.array(F.lit(1), F.lit(2))).alias("positions"), F.unix_millis(
            F.col("ts").cast("timestamp")).alias("timestamp"),
    )


_RAW = """r AS (SELECT event_id AS i, CASE event_type WHEN 'purchase' THEN 'conversion' ELSE event_type END AS event_type,
 event_id % 19 = 0 AS long_name, event_id % 23 = 0 AS no_user,
 CASE WHEN event_id % 13 = 0 AND event_id % 26 <> 0 THEN 0 WHEN event_id % 17 = 0 THEN 21 ELSE 2 END AS n, CASE WHEN event_id % 7 = 0 THEN 'xyz' WHEN event_id % 3 = 0 THEN md5(event_id::VARCHAR) END AS query_id,
 CASE WHEN event_id % 5 = 0 THEN 1 WHEN event_id % 2 = 0 THEN 2 END AS np, epoch_us(ts) // 1000 AS ts FROM events)"""


@query(f"""WITH {_RAW} SELECT i AS event_id, CASE WHEN event_type NOT IN ('click', 'conversion', 'view') THEN
 'invalid event type: ' || event_type WHEN long_name THEN 'event name must have 1 to 64 bytes'
 WHEN no_user THEN 'user token must have 1 to 129 bytes'
 WHEN n NOT BETWEEN 1 AND 20 THEN 'an event must have 1 to 20 objects' WHEN event_type = 'click' AND query_id IS NOT NULL
 AND np IS NULL THEN 'a click after a search must have positions' WHEN event_type = 'click' AND query_id IS NOT NULL
 AND np <> n THEN 'positions must be as many as objects'
 WHEN query_id = 'xyz' THEN 'query id must be 32 hexadecimal digits'
 WHEN ts < {NOW_MS} - 4 * 86400000 THEN 'timestamp must lie within the last 4 days' END AS error FROM r""")
def validate_insights(s, d):
    return raw_insights(s, d).withColumn("ids", an.effective_ids()).select("event_id", an.validation_error(NOW_MS).alias("error"))


@query(f"WITH {_RAW} SELECT i AS event_id, n FROM r")
def object_ids_alias(s, d):
    return raw_insights(s, d).select("event_id", F.coalesce(F.size(an.effective_ids()), F.lit(0)).cast("long").alias("n"))


# --- sources and lifecycle


@query(f"SELECT strftime(ts::DATE, '%Y-%m-%d') AS day, count(*) AS events, ts::DATE < DATE '{TODAY}' - 20 AS expired FROM events GROUP BY ALL")
def retention_partitions(s, d):
    day = F.to_date("ts")
    return table(s, d, "events").groupBy(day.alias("x")).agg(F.count(F.lit(1)).alias("events")).select(F.date_format("x",
        "yyyy-MM-dd").alias("day"), "events", store.expired(F.col("x"), TODAY, 20).alias("expired"))


@query("SELECT p_partkey, p_name FROM part WHERE p_size > 10 ORDER BY p_partkey LIMIT 100 OFFSET 100")
def browse_page(s, d):
    from skylark.sources.memory import Pages

    first, cursor = Pages(part(s, d).where("p_size > 10"), "p_partkey", 7).page(None, 100)
    second, _ = Pages(part(s, d).where("p_size > 10"), "p_partkey", 7).page(cursor, 100)
    return second.select("p_partkey", "p_name")


@query("SELECT user_id AS object_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def upsert_latest(s, d):
    return store.latest(table(s, d, "events").select(F.col("user_id").alias("object_id"), F.col("event_id").alias("seq"),
        "event_type", "value"))


_ACTIONS = "CASE event_id % 5 WHEN 0 THEN 'addObject' WHEN 1 THEN 'partialUpdateObject' WHEN 2 THEN 'partialUpdateObjectNoCreate' WHEN 3 THEN 'updateObject' ELSE 'deleteObject' END"


@query(f"""WITH c AS (SELECT user_id AS object_id, event_id AS seq, {_ACTIONS} AS action, CASE
 WHEN event_id % 5 = 2 THEN NULL ELSE event_type END AS kind, CASE WHEN event_id % 5 = 1 THEN NULL ELSE value END AS value FROM events),
g AS (SELECT *, max(CASE WHEN action IN ('addObject', 'updateObject', 'deleteObject') THEN seq END) OVER (PARTITION BY object_id)
 AS base FROM c),
l AS (SELECT object_id, base, max(CASE WHEN seq = base THEN action END) AS base_action FROM g GROUP BY 1, 2),
f AS (SELECT g.object_id, g.seq, g.action, g.kind, g.value, l.base_action, min(CASE
 WHEN g.action = 'partialUpdateObject' THEN g.seq END) OVER (PARTITION BY g.object_id) AS born FROM g JOIN l USING (object_id)
 WHERE g.base IS NULL OR g.seq >= g.base),
k AS (SELECT * FROM f WHERE action <> 'deleteObject' AND (base_action IN ('addObject', 'updateObject') OR seq >= born))
SELECT object_id, arg_max(kind, seq) FILTER (kind IS NOT NULL) AS kind, arg_max(value, seq) FILTER (value IS NOT NULL) AS value
 FROM k GROUP BY 1""")
def batch_actions(s, d):
    e = table(s, d, "events")
    changes = e.select(F.col("user_id").alias("object_id"), F.col("event_id").alias("seq"), F.expr(_ACTIONS).alias("action"),
        F.expr("CASE WHEN event_id % 5 = 2 THEN NULL ELSE event_type END").alias("kind"), F.expr(
        "CASE WHEN event_id % 5 = 1 THEN NULL ELSE value END").alias("value"))
    return store.fold_changes(s.createDataFrame([], "object_id long, kind string, value double"), changes)


@query("""SELECT p_partkey, p_size + 3 AS increment, p_size - 3 AS decrement, CASE
 WHEN p_size = 5 THEN 6 ELSE p_size END AS increment_from, greatest(p_size, 10) AS increment_set, p_name || ' red' AS added,
 CASE WHEN list_contains(string_split(p_name, ' '), 'red') THEN p_name ELSE p_name || ' red' END AS unique_added,
 array_to_string(list_filter(string_split(p_name, ' '), lambda x: x <> 'red'), ' ') AS removed FROM part""")
def partial_update_operations(s, d):
    u, n, w = store.partial_update, F.col("p_size"), F.split("p_name", " ")
    return part(s, d).select(
        "p_partkey", u(n, "Increment", F.lit(3)).alias("increment"), u(n, "Decrement", F.lit(3)).alias("decrement"), u(n,
            "IncrementFrom", F.lit(5)).alias("increment_from"), u(n, "IncrementSet", F.lit(10)).alias("increment_set"),
        F.array_join(u(w, "Add", F.lit("red")), " ").alias("added"), F.array_join(u(w, "AddUnique", F.lit("red")), " ").alias(
            "unique_added"), F.array_join(u(w, "Remove", F.lit("red")), " ").alias("removed"),
    )


def _stored_parts(s, d):
    """A new store with the parts as an index."""
    new = store.Store(s, work_path(s, "store"), "p_partkey")
    new.add("parts", part(s, d))
    return new


@query("SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (3, 14, 159, 1000000)")
def get_objects(s, d):
    return _stored_parts(s, d).get("parts", [3, 14, 159, 1_000_000], ["p_brand"])


@query("SELECT p_partkey FROM part WHERE NOT (p_type = 'PROMO' AND p_size < 20)")
def delete_by_query(s, d):
    new = _stored_parts(s, d)
    new.delete_by("parts", ff.parse_filter("p_type:PROMO AND p_size < 20"))
    return new.read("parts").select("p_partkey")


@query("SELECT event_id FROM events WHERE event_id > 400")
def replication_catch_up(s, d):
    return store.since(table(s, d, "events").select("event_id", F.col("event_id").alias("seq")), 400).select("event_id")


@query("SELECT p_partkey, strlen(to_json({'p_partkey': p_partkey, 'p_name': p_name, 'p_size': p_size})) > 45 AS too_large FROM part")
def document_size_limit(s, d):
    rows = part(s, d).select("p_partkey", "p_name", "p_size")
    return rows.select("p_partkey", store.too_large(rows, 45).alias("too_large"))


@query("""WITH k AS (SELECT n_name AS index_name, 'snapshots/' || n_name || '/' || strftime(TIMESTAMP '2024-01-01' + INTERVAL (i) HOUR, '%Y%m%dT%H%M%SZ') || '.tar.gz' AS key FROM nation, range(5) r(i)) SELECT index_name, key, row_number() OVER (PARTITION BY index_name ORDER BY key DESC) <= 2 AS kept FROM k""")
def snapshot_retention(s, d):
    hour = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("i") * 3600), "yyyyMMdd'T'HHmmss'Z'")
    k = table(s, d, "nation").select(F.col("n_name").alias("index_name"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    return store.keep_latest(k.select("index_name", F.concat(F.lit("snapshots/"), "index_name", F.lit("/"), hour,
        F.lit(".tar.gz")).alias("key")), 2)


@query("""WITH n AS (SELECT range AS id FROM range(3000)), h AS (SELECT id, (id * 7919 + 13) % 1000 AS a, (id * 104729 + 71) % 7
 AS b, (id * 1299709 + 5) % 40 AS c, (id * 15485863 + 3) % 1000 AS u FROM n)
SELECT epoch_ms(TIMESTAMP '2024-01-30') - (id % 30 + 1) * 86400000 + a * 86400 AS timestamp_ms, ['laptop', 'phone', 'red shoes',
 'camera', 'desk', 'lamp', 'zzz'][b + 1] AS query, md5(id::VARCHAR) AS query_id,
 'demo' AS index_name, CASE WHEN b = 6 THEN 0 ELSE c + 1 END AS nb_hits, b <> 6 AS has_results, u::VARCHAR AS user_token FROM h""")
def seed_searches(s, d):
    return store.seed_searches(s, "demo", 30, 100, TODAY)


# --- recommendations, suggestions, experiments


@query("""WITH b AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), s AS (SELECT l_orderkey, l_suppkey FROM b
 WHERE l_orderkey IN (SELECT l_orderkey FROM b GROUP BY 1 HAVING count(*) >= 2)), a AS (SELECT l_suppkey, count(*) AS n FROM s GROUP BY 1),
t AS (SELECT count(DISTINCT l_orderkey) AS baskets FROM s), p AS (SELECT x.l_suppkey AS item, y.l_suppkey AS other, count(*) AS
 together FROM s x JOIN s y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey <> y.l_suppkey GROUP BY 1, 2 HAVING count(*) >= 2),
l AS (SELECT item, other, together, round(together * baskets / (i.n * o.n)::DOUBLE, 6) AS lift FROM p
 JOIN a i ON i.l_suppkey = item JOIN a o ON o.l_suppkey = other, t)
SELECT *, row_number() OVER (PARTITION BY item ORDER BY together DESC, lift DESC, other)::INT AS rank FROM l QUALIFY rank <= 3""")
def also_bought(s, d):
    return recommend.bought_together(table(s, d, "lineitem"), "l_orderkey", "l_suppkey")


_TREND = "SELECT {0}, count(*) AS events, round(sum(pow(0.5, date_diff('day', ts::DATE, DATE '2024-01-30') / 7.0)), 4) AS score FROM events WHERE ts < TIMESTAMP '2024-01-31' GROUP BY 1"


@query(f"WITH t AS ({_TREND.format('user_id')}) SELECT *, row_number() OVER (ORDER BY score DESC, user_id)::INT AS rank FROM t QUALIFY rank <= 10")
def trending(s, d):
    return recommend.trending(table(s, d, "events"), "user_id", "ts", TODAY)


@query(f"WITH t AS ({_TREND.format('event_type')}) SELECT *, row_number() OVER (ORDER BY score DESC, event_type)::INT AS rank FROM t QUALIFY rank <= 5")
def trending_facets(s, d):
    return recommend.trending_facets(table(s, d, "events"), "event_type", "ts", TODAY)


@query(f"WITH {SEARCHES} SELECT lower(query) AS suggestion, count(*) AS popularity, max(nb_hits) AS nb_hits FROM searches GROUP BY 1 HAVING max(nb_hits) >= 1 AND length(lower(query)) >= 4 AND lower(query) <> 'red plate'")
def query_suggestions(s, d):
    return recommend.suggestions(searches(s, d), exclude=("red plate",))


@query("""WITH r AS (SELECT user_id::VARCHAR AS user_token, 'part' AS facet, (event_id % 5)::VARCHAR AS value, sum(CASE event_type
 WHEN 'click' THEN 3 WHEN 'view' THEN 1 ELSE 10 END * 4) AS raw FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY ALL)
SELECT user_token, facet, value, greatest(1, round(raw * 20 / (max(raw) OVER (PARTITION BY user_token))::DOUBLE))::BIGINT AS score
 FROM r""")
def personalization_affinity(s, d):
    e = table(s, d, "events").select(F.col("user_id").cast("string").alias("user_token"), "event_type", (
        F.col("event_id") % 5).alias("part"))
    return recommend.affinities(e, {"click": 3, "view": 1, "purchase": 10}, {"part": 4})


_BUCKET = "('0x' || substr(md5('t1' || user_id::VARCHAR), 1, 8))::BIGINT % 100"


@query(f"SELECT DISTINCT user_id, CASE WHEN {_BUCKET} < 30 THEN 'control' ELSE 'new' END AS variant FROM events")
def ab_assignment(s, d):
    return table(s, d, "events").select("user_id", recommend.variant(F.col("user_id").cast("string"), "t1",
        {"control": 30, "new": 70}).alias("variant")).distinct()


@query(f"""WITH c AS (SELECT CASE WHEN {_BUCKET} < 50 THEN 'control' ELSE 'new' END AS variant, event_type AS metric, count(*) AS
 hits FROM events GROUP BY ALL), n AS (SELECT variant, sum(hits) AS n FROM c GROUP BY 1), x AS (SELECT c.*, n.n FROM c
 JOIN n USING (variant)),
j AS (SELECT a.metric, a.variant, a.hits / a.n::DOUBLE AS p, b.hits / b.n::DOUBLE AS q, a.n AS n, b.n AS m FROM x a
 JOIN x b ON a.metric = b.metric AND a.variant = 'new' AND b.variant = 'control')
SELECT metric, variant, round(p, 6) AS rate, round(p - q, 6) AS difference, round(p - q - 1.96 * sqrt(p * (1 - p) / n + q * (1 -
 q) / m), 6) AS low, round(p - q + 1.96 * sqrt(p * (1 - p) / n + q * (1 - q) / m), 6) AS high FROM j""")
def ab_rates(s, d):
    e = table(s, d, "events").select("event_type", recommend.variant(F.col("user_id").cast("string"), "t1",
        {"control": 50, "new": 50}).alias("variant"))
    c = e.groupBy("variant", F.col("event_type").alias("metric")).agg(F.count(F.lit(1)).alias("hits"))
    n = e.groupBy("variant").agg(F.count(F.lit(1)).alias("n"))
    return recommend.compare_rates(c.join(n, "variant"), "control").drop("p_value")


@query("""WITH o AS (SELECT p_partkey AS object_id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part
 WHERE p_type = 'PROMO' AND p_partkey >= 10), i AS (SELECT p_partkey AS object_id, p_partkey + 1 AS rank FROM part WHERE p_partkey < 3)
SELECT object_id, CASE WHEN row_number() OVER (ORDER BY rank, object_id) - 1 >= 2 THEN row_number() OVER (ORDER BY rank,
 object_id) + 2 ELSE row_number() OVER (ORDER BY rank, object_id) - 1 END AS slot, false AS injected FROM o UNION ALL
 SELECT object_id, rank + 1, true FROM i""")
def composition_inject(s, d):
    p = part(s, d)
    organic = p.where("p_type = 'PROMO' AND p_partkey >= 10").select(F.col("p_partkey").alias("object_id"), F.row_number().over(
        Window.orderBy(F.desc("p_retailprice"), "p_partkey")).alias("rank"))
    return recommend.inject(organic, p.where("p_partkey < 3").select(F.col("p_partkey").alias("object_id"), (F.col("p_partkey")
        + 1).alias("rank")), 2, 3).select("object_id", F.col("slot").cast("long").alias("slot"), "injected")


@query("""WITH f AS (SELECT 0 AS feed, p_partkey AS object_id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank
 FROM part WHERE p_type = 'PROMO'
 UNION ALL SELECT 1, p_partkey, row_number() OVER (ORDER BY p_size, p_partkey) FROM part), x AS (SELECT * FROM f WHERE rank <=
 CASE feed WHEN 0 THEN 20 ELSE 200 END),
o AS (SELECT object_id, min({'feed': feed, 'rank': rank}) AS best FROM x GROUP BY 1)
 SELECT object_id, best.feed::INT AS feed, row_number() OVER (ORDER BY best.feed, best.rank) - 1 AS slot FROM o""")
def composition_multifeed(s, d):
    p = part(s, d)
    ranked = lambda rows, *keys: rows.select(F.col("p_partkey").alias("object_id"), F.row_number().over(
        Window.orderBy(*keys, "p_partkey")).alias("rank"))
    return recommend.multifeed([(ranked(p.where("p_type = 'PROMO'"), F.desc("p_retailprice")), 20), (ranked(p, "p_size"), 200)])


@query("""WITH b AS (SELECT DISTINCT user_id, event_id % 37 AS item FROM events WHERE event_type = 'view'), s AS (SELECT * FROM b
 WHERE user_id IN (SELECT user_id FROM b GROUP BY 1 HAVING count(*) >= 2)), a AS (SELECT item, count(*) AS n FROM s GROUP BY 1),
t AS (SELECT count(DISTINCT user_id) AS users FROM s), p AS (SELECT x.item, y.item AS other, count(*) AS together FROM s x
 JOIN s y ON x.user_id = y.user_id AND x.item <> y.item GROUP BY 1, 2 HAVING count(*) >= 2),
l AS (SELECT p.item, other, together, round(together * users / (i.n * o.n)::DOUBLE, 6) AS lift FROM p JOIN a i ON i.item = p.item
 JOIN a o ON o.item = other, t)
SELECT *, row_number() OVER (PARTITION BY item ORDER BY together DESC, lift DESC, other)::INT AS rank FROM l QUALIFY rank <= 3""")
def related_products(s, d):
    views = table(s, d, "events").where("event_type = 'view'").select("user_id", (F.col("event_id") % 37).alias("item"))
    return recommend.related(views, "user_id", "item")


@query("""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[],
 v.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s)
 SELECT query_id, vec_id, similarity, rank::INT AS rank FROM r WHERE rank <= 3 AND similarity >= 0.2""")
def looking_similar(s, d):
    v = table(s, d, "embeddings")
    return recommend.looking_similar(v, v.where("vec_id % 100 = 0"), 3, 0.2)


@query(f"""WITH {SEARCHES} SELECT strftime(epoch_ms(timestamp_ms), '%Y-%m-%d') AS day, CASE
 WHEN analytics_tags LIKE '%mobile%' THEN 'mobile' WHEN analytics_tags LIKE '%tablet%' THEN 'tablet'
 WHEN analytics_tags LIKE '%desktop%' THEN 'desktop' ELSE 'other' END AS device, count(*) AS count
FROM searches GROUP BY ALL""")
def devices_daily(s, d):
    return an.devices_daily(searches(s, d))


@query(f"""WITH {SEARCHES}, r AS (SELECT 'r' || (user_token::INT % 3) AS region, count(*) AS count FROM searches
 WHERE country = 'FR' GROUP BY 1)
SELECT region, count, round(count * 100.0 / sum(count) OVER (), 4) AS percent, row_number() OVER (ORDER BY count DESC,
 region)::INT AS rank FROM r""")
def top_regions(s, d):
    return an.top_regions(searches(s, d).withColumn("region", F.concat(F.lit("r"), F.col("user_token").cast("int") % 3)), "FR")


# --- dictionaries, automatic filters, nested documents


@query("""SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda x: x NOT IN ('red', 'ring')), ' ') AS kept FROM part""")
def dictionary_stopwords(s, d):
    entries = s.createDataFrame([("en", "red", "enabled"), ("en", "ring", "enabled"), ("en", "blue", "disabled"), ("fr", "plate",
        "enabled")], "language string, word string, state string")
    return text.dictionary_filter(part(s, d).select("p_partkey", F.split("p_name", " ").alias("tokens")), entries, "en").select(
        "p_partkey", F.array_join("tokens", " ").alias("kept"))


@query("""WITH q(query_id, text) AS (VALUES (0, 'promo ring'), (1, 'small plate'), (2, 'nothing')) SELECT query_id, 'p_type' AS facet, upper(split_part(text, ' ', 1)) AS value FROM q WHERE query_id < 2""")
def automatic_facet_filters(s, d):
    q = s.createDataFrame([(0, "promo ring"), (1, "small plate"), (2, "nothing")], "query_id int, text string")
    return merchandising.automatic_filters(q, facets.counts(part(s, d), ["p_type", "p_brand"]), ["p_type"])


@query("""SELECT * FROM (VALUES ('synonym', 'red')) t(type, word)""")
def synonym_search(s, d):
    return merchandising.search_synonyms(_synonyms(s), "crim", "synonym").select("type", F.get("words", 0).alias("word"))


@query("SELECT * FROM (VALUES ('r1'), ('r5'), ('r6')) t(id)")
def rule_search(s, d):
    return merchandising.search_rules(s.createDataFrame(_RULES, merchandising.RULE), "red").select("id")


@query("""SELECT c_custkey AS object_id, 'name.full' AS path, c_name AS text FROM customer UNION ALL SELECT c_custkey, 'tags', c_mktsegment || ' vip' FROM customer UNION ALL SELECT c_custkey, 'visits.place', 'n' || c_nationkey || ' home' FROM customer""")
def nested_texts(s, d):
    docs = table(s, d, "customer").select(F.col("c_custkey").alias("object_id"), F.struct(F.col("c_name").alias("full"),
        F.lit(1).alias("n")).alias("name"), F.array("c_mktsegment", F.lit("vip")).alias("tags"), F.array(
        F.struct(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("place")), F.struct(
        F.lit("home").alias("place"))).alias("visits"))
    return matching.nested_texts(docs)


@query("""SELECT p_partkey AS object_id, to_json({'p_partkey': p_partkey, 'p_name': p_name, 'p_size': p_size})::VARCHAR AS json FROM part""")
def hit_json(s, d):
    return part(s, d).select(F.col("p_partkey").alias("object_id"), F.to_json(F.struct("p_partkey", "p_name", "p_size")).alias("json"))


@query("""WITH a AS (SELECT 'p_brand' AS facet, p_brand AS value FROM part GROUP BY ALL), h AS (SELECT p_brand AS value, count(*) AS n FROM part WHERE p_size > 48 GROUP BY 1) SELECT facet, value, coalesce(n, 0) AS count FROM a LEFT JOIN h USING (value)""")
def facet_zero_filled(s, d):
    return facets.zero_filled(facets.counts(part(s, d), ["p_brand"]), facets.counts(part(s, d).where("p_size > 48"), ["p_brand"]))


@query("""SELECT event_id, md5(concat('products', '|', user_id, '|', event_id)) AS query_id FROM events""")
def query_ids(s, d):
    return table(s, d, "events").select("event_id", an.new_query_id(F.lit("products"), F.col("user_id"), F.col("event_id")).alias(
        "query_id"))


@query(f"WITH v AS ({SQL['validate_insights']}) SELECT count(*) AS received, count_if(error IS NULL)::BIGINT AS accepted, count(*) <= 1000 AND count_if(error IS NULL) > 0 AS ok FROM v")
def ingest_verdict(s, d):
    return an.ingest(raw_insights(s, d), NOW_MS)[1]


@query("""WITH c AS (SELECT 0 AS query_id, count(*) AS n FROM part WHERE p_type = 'PROMO' AND p_size < 3 UNION ALL
 SELECT 1, count(*) FROM part WHERE p_type = 'SMALL' UNION ALL SELECT 2, count(*)
 FROM part), x AS (SELECT *, coalesce(sum(n) OVER (ORDER BY query_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT query_id, n AS nb_hits FROM x WHERE before < 20""")
def multi_query_stop(s, d):
    p = part(s, d)
    rows = p.where("p_type = 'PROMO' AND p_size < 3").select(F.lit(0).alias("query_id")).unionByName(p.where(
        "p_type = 'SMALL'").select(F.lit(1).alias("query_id"))).unionByName(p.select(F.lit(2).alias("query_id")))
    return ranking.stop_if_enough(rows, 20)
