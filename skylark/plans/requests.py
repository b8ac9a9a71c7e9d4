"""Registered queries of whole search requests, over postings that are written once for a folder of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylark.operators import matching, merchandising
from skylark.plans.catalog import SYNONYMS, part, query
from skylark.plans.search import Index, IndexSettings, SearchRequest
from skylark.plans.tables import table
from skylark.session import work_path
from skylark.sources.postings import StoredPostings

_WRITTEN: dict[tuple, str] = {}


def stored(s: SparkSession, d: str, name: str, id_col: str, attributes: list[str]) -> StoredPostings:
    """The stored postings of a table; the first call of an application writes them."""
    key = (s.sparkContext.applicationId, d, name, *attributes)
    if key not in _WRITTEN:
        path = work_path(s, f"postings-{name}")
        StoredPostings.build(table(s, d, name), id_col, attributes, path)
        _WRITTEN[key] = path
    return StoredPostings(s, _WRITTEN[key])


def parts(s: SparkSession, d: str, attributes: list[str] | None = None, synonyms: DataFrame | None = None, rules: DataFrame
    | None = None, **settings) -> Index:
    attributes = attributes or ["p_name"]
    given = IndexSettings({"searchableAttributes": attributes, "attributesForFaceting": ["p_brand", "p_type"], **settings})
    return Index(part(s, d), "p_partkey", given, stored(s, d, "part", "p_partkey", attributes), synonyms, rules)


def _asked(index: Index, texts: list[str], *columns: str, **options) -> DataFrame:
    """The criteria of all hits of some queries, each with its text."""
    out = None
    for t in texts:
        rows = index.criteria(SearchRequest(t, **options)).select(F.lit(t).alias("query"), F.col("_id").alias("p_partkey"), *columns)
        out = rows if out is None else out.unionByName(rows)
    return out


def _values(texts: list[str]) -> str:
    return "q(query) AS (VALUES " + ", ".join(f"('{t}')" for t in texts) + ")"


# --- a request with a filter, an order and facets

_FILTER, _FILTER_SQL = "(p_type:PROMO OR p_type:LARGE) AND p_retailprice >= 905", "(p_type = 'PROMO' OR p_type = 'LARGE') AND p_retailprice >= 905"
_RED_SQL = "(starts_with(p_name, 'red') OR p_name LIKE '% red%')"


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Prefix search with a nested filter, sorted by price: the ten best parts."""
    r = SearchRequest("red", _FILTER, facets=["p_brand"], sort=["desc(p_retailprice)"], hits_per_page=10)
    return parts(s, d).search(r).hits.select("pos", "p_partkey", "p_name", "p_type", "p_retailprice")


query(
    f"""SELECT row_number() OVER (ORDER BY p_retailprice DESC, p_partkey)::INT AS pos, p_partkey, p_name, p_type, p_retailprice FROM part
    WHERE {_FILTER_SQL} AND {_RED_SQL} QUALIFY pos <= 10""",
    "search_full",
)(flagship)


@query(f"SELECT 'p_brand' AS facet, p_brand AS value, count(*) AS count FROM part WHERE {_FILTER_SQL} AND {_RED_SQL} GROUP BY ALL")
def search_facets(s, d):
    return parts(s, d).search(SearchRequest("red", _FILTER, facets=["p_brand"], hits_per_page=0)).facets


# --- what words match

FUZZY = ["smlal plate ", "widgte ", "platee ring ", "cold rign ", "larg", "blue "]


@query(f"""WITH {_values(FUZZY)}, w AS (SELECT query, unnest(string_split(trim(query), ' ')) AS word, NOT ends_with(query, ' ') AS
 typing FROM q),
v AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS token FROM part),
near AS (
  SELECT query, word, token, CASE WHEN typing AND starts_with(token, word) THEN 0 ELSE damerau_levenshtein(word, token) END AS
 typos FROM w, v
  WHERE (typing AND starts_with(token, word)) OR damerau_levenshtein(word, token) <= CASE WHEN length(word) < 5 THEN 0
 WHEN length(word) < 9 THEN 1 ELSE 2 END),
p AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS token FROM part),
h AS (SELECT query, word, p_partkey, min(typos) AS typos FROM near JOIN p USING (token) GROUP BY ALL)
SELECT query, p_partkey, sum(typos)::INT AS typos FROM h GROUP BY query, p_partkey HAVING count(*) = (SELECT count(*) FROM w
 WHERE w.query = h.query)""")
def search_fuzzy(s, d):
    return _asked(parts(s, d), FUZZY, "typos")


@query(f"""WITH {_values(["smlal ", "small "])}, v AS (SELECT query, p_partkey, min(damerau_levenshtein(trim(query), token)) AS
 typos FROM q, (SELECT p_partkey, unnest(string_split(p_name, ' ') || [lower(p_type)]) AS token FROM part) GROUP BY ALL)
SELECT query, p_partkey FROM v WHERE typos <= 1 QUALIFY typos = min(typos) OVER (PARTITION BY query)""")
def search_typo_min(s, d):
    return _asked(parts(s, d, ["p_name", "p_type"], typoTolerance="min"), ["smlal ", "small "])


SPLIT = ["redplate ", "smallring ", "blue bolt ", "hotgizmo", "bolt"]


@query(f"""WITH {_values(SPLIT)}, v AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS token FROM part),
w AS (SELECT query, unnest(string_split(trim(query), ' ')) AS word FROM q),
halves AS (SELECT query, word, unnest(range(2, least(12, length(word) - 2) + 1)) AS k FROM w WHERE length(word) >= 4),
first AS (SELECT query, word, min(k) AS k FROM halves WHERE word[:k] IN (FROM v) AND word[k + 1:] IN (FROM v) GROUP BY ALL),
p AS (SELECT p_partkey, string_split(p_name, ' ') AS names FROM part),
h AS (SELECT w.query, w.word, p_partkey FROM w LEFT JOIN first f ON f.query = w.query AND f.word = w.word JOIN p
  ON len(list_filter(names, lambda x: x = w.word OR (NOT ends_with(w.query, ' ')
 AND starts_with(x, w.word)))) > 0 OR (list_contains(names, w.word[:f.k]) AND list_contains(names, w.word[f.k + 1:])))
SELECT query, p_partkey FROM h GROUP BY query, p_partkey HAVING count(*) = (SELECT count(*) FROM w WHERE w.query = h.query)""")
def search_split(s, d):
    return _asked(parts(s, d, typoTolerance=False), SPLIT)


MEANT = ["crimson plate ", "gadget ", "smal ", "scarlet ", "widget "]


@query(f"""WITH {_values(MEANT)}, e(f, t) AS (VALUES ('crimson', ['red', 'scarlet']), ('scarlet', ['red', 'crimson']), ('red',
 ['crimson', 'scarlet']), ('gadget', ['widget', 'gear']), ('smal', ['small']), ('blu', ['blue'])),
w AS (SELECT query, unnest(string_split(trim(query), ' ')) AS word
 FROM q), p AS (SELECT p_partkey, string_split(p_name, ' ') AS names FROM part),
h AS (SELECT query, word, p_partkey FROM w LEFT JOIN e ON f = word JOIN p ON list_contains(names, word) OR list_has_any(names, t))
SELECT query, p_partkey, (trim(query) = 'smal')::INT AS typos FROM h GROUP BY query, p_partkey HAVING count(*) = (SELECT count(*)
 FROM w WHERE w.query = h.query)""")
def search_synonyms(s, d):
    rows = s.createDataFrame(SYNONYMS, "type string, input string, words array<string>")
    return _asked(parts(s, d, synonyms=rows, typoTolerance=False), MEANT, "typos")


FOLDED = ["the red plates ", "a ring of the rod ", "boltes ", "anvils", "the "]


@query(f"""WITH {_values(FOLDED)}, m(query, words) AS (VALUES ('the red plates ', [['red'], ['plate']]), ('a ring of the rod ',
 [['ring'], ['rod']]), ('boltes ', [['bolte', 'boltes']]), ('anvils', [['anvil']]), ('the ', [['the']]))
SELECT query, p_partkey FROM q JOIN m USING (query), part WHERE len(list_filter(words, lambda ws:
 list_has_any(string_split(p_name, ' '), ws))) = len(words)""")
def search_stopwords_plurals(s, d):
    return _asked(parts(s, d, removeStopWords=True, ignorePlurals=True, typoTolerance=False), FOLDED)


@query("""WITH q(query, most) AS (VALUES ('red zzz ring ', 1), ('zzz plate ', 9), ('blue plate ', 2)), p AS (SELECT p_partkey,
 string_split(p_name, ' ') AS names FROM part)
SELECT query, p_partkey FROM q, p WHERE (query = 'red zzz ring ' AND list_contains(names, 'red')) OR (query = 'blue plate '
 AND list_contains(names, 'blue')
  AND (list_contains(names, 'plate') OR NOT EXISTS (SELECT 1 FROM part
 WHERE list_has_all(string_split(p_name, ' '), ['blue', 'plate']))))""")
def search_last_words(s, d):
    return _asked(parts(s, d, removeWordsIfNoResults="lastWords", typoTolerance=False), ["red zzz ring ", "zzz plate ", "blue plate "])


@query("""SELECT '"blue ring"' AS query, p_partkey FROM part WHERE p_name = 'blue ring' UNION ALL SELECT 'plate -red ', p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'plate') AND NOT list_contains(string_split(p_name, ' '), 'red')""")
def search_advanced_syntax(s, d):
    return _asked(parts(s, d, advancedSyntax=True, typoTolerance=False), ['"blue ring"', "plate -red "])


# --- order, rules and shape


@query("""WITH p AS (SELECT *, list_contains(string_split(p_name, ' '), 'small') AS a, p_type = 'SMALL' AS b, starts_with(p_name,
 'small') AS c FROM part)
SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN a THEN 0 ELSE 1 END, CASE
 WHEN a THEN 1 ELSE 0.01 END DESC, p_retailprice DESC NULLS LAST, p_partkey)::INT AS pos, CASE
 WHEN a THEN 0 ELSE 1 END AS attribute FROM p WHERE a OR b QUALIFY pos <= 400""")
def ranking_criteria(s, d):
    """Name before type, then the custom ranking: two attributes that both have the word."""
    index = parts(s, d, ["p_name", "p_type"], customRanking=["desc(p_retailprice)"])
    hits = index.search(SearchRequest("small ", hits_per_page=400, ranking_info=True)).hits
    return hits.select("p_partkey", "pos", F.col("_rankingInfo.attribute").alias("attribute"))


_PINNED = [
    ("a", "red", "contains", None, True, None, None, None, None, "p_type:PROMO", "m1", [("7", 0), ("11", 2)], ["12"], False),
    ("b", "cheap", "startsWith", None, True, None, None, "red", None, None, "m2", None, None, False),
    ("c", "blue", "is", None, False, None, None, None, None, "p_type:LARGE", None, [("1", 0)], None, False),
]


@query("""WITH n AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part
 WHERE p_type = 'PROMO' AND list_contains(string_split(p_name, ' '), 'red') AND p_partkey NOT IN (7, 11, 12)),
x AS (SELECT p_partkey, CASE WHEN r = 1 THEN 2 ELSE r + 2 END AS pos FROM n UNION ALL SELECT 7, 1 UNION ALL SELECT 11, 3)
SELECT p_partkey, pos::INT AS pos FROM x WHERE pos <= 30""")
def search_rules(s, d):
    """A rule that filters, pins and hides on `red`."""
    rules = s.createDataFrame(_PINNED, merchandising.RULE_WITH_PINS)
    index = parts(s, d, rules=rules, customRanking=["desc(p_retailprice)"])
    return index.search(SearchRequest("red ", hits_per_page=30)).hits.select("p_partkey", "pos")


@query("""WITH n AS (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey)::INT AS pos FROM part
 WHERE len(list_filter(string_split(p_name, ' '), lambda x: starts_with(x, 're'))) > 0)
SELECT p_partkey, pos, regexp_replace(p_name, '\\bre', '<em>re</em>') AS name, 'full' AS level, 're' AS words FROM n WHERE pos <= 25""")
def search_highlight(s, d):
    index = parts(s, d, customRanking=["desc(p_retailprice)"], attributesToHighlight=["p_name"])
    h = F.col("_highlightResult.p_name")
    hits = index.search(SearchRequest("re", hits_per_page=25)).hits
    return hits.select("p_partkey", "pos", h["value"].alias("name"), h["matchLevel"].alias("level"), F.array_join(
        h["matchedWords"], ",").alias("words"))


# --- batches of queries over the same postings


@query("""WITH w AS (SELECT DISTINCT p_name AS text FROM part), q AS (SELECT row_number() OVER (ORDER BY text) AS query_id, text
 FROM w), p AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)
SELECT query_id::INT AS query_id, count(*) AS nb_hits FROM q JOIN p ON list_contains(w, split_part(text, ' ', 1))
 AND len(list_filter(w, lambda x: starts_with(x, split_part(text, ' ', 2)))) > 0 GROUP BY 1""")
def multi_query(s, d):
    names = part(s, d).select(F.col("p_name").alias("text")).distinct()
    q = names.withColumn("query_id", F.expr("row_number() OVER (ORDER BY text)"))
    return batch(stored(s, d, "part", "p_partkey", ["p_name"]), q).groupBy("query_id").agg(F.count(F.lit(1)).alias("nb_hits"))


def batch(post: StoredPostings, queries: DataFrame, mode: str = "prefixLast") -> DataFrame:
    """query_id, object_id and score of a batch of queries (query_id, text) as one plan."""
    return matching.match(post.post, matching.parse_queries(queries, mode), vocab=post.terms)
