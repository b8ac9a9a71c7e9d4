"""A whole request: what each setting and table changes in the result, over derived and over stored postings."""

import pytest
from pyspark.sql import functions as F

from skylark.operators import merchandising
from skylark.plans.search import Index, IndexSettings, SearchRequest
from skylark.sources.postings import StoredPostings, neighbours

SYNONYM = "type string, input string, words array<string>"


BOTH = pytest.mark.parametrize("make", ["derived", "stored"], indirect=True)


@pytest.fixture
def make(request, spark, tmp_path_factory):
    """An index of names (and more columns) over stored or derived postings."""
    stored = getattr(request, "param", "stored") == "stored"

    def build(names, synonyms=None, rules=None, more=None, **settings):
        rows = [(i, n, *(more[i] if more else ())) for i, n in enumerate(names)]
        docs = spark.createDataFrame(rows, "id int, name string" + (
            ", other string, score double, pos int, lat double, lng double" if more else ""))
        settings = IndexSettings({"searchableAttributes": ["name", "other"] if more else ["name"], **settings})
        post = None
        if stored:
            post = StoredPostings.build(docs, "id", settings.get("searchableAttributes"), str(tmp_path_factory.mktemp("post")) + "/p")
        s = spark.createDataFrame(synonyms, SYNONYM) if synonyms else None
        r = spark.createDataFrame(rules, merchandising.RULE_WITH_PINS) if rules else None
        return Index(docs, "id", settings, post, s, r)

    return build


def ids(index, query="", **options):
    r = SearchRequest(query, hits_per_page=50, **options)
    return [h["id"] for h in index.search(r).response()["hits"]]


@BOTH
def test_typos(make):
    names = ["apple pie", "apples", "ample room", "nothing", "wonderful world", "wonderfull", "wnoderful", "12345"]
    i = make(names)
    assert ids(i, "appel ") == [0]  # a swap is one typo
    assert set(ids(i, "wonderful ")) == {4, 5, 6} and ids(i, "wonderful ")[0] == 4
    assert ids(make(names, typoTolerance="min"), "wonderful ") == [4]
    assert ids(make(names, typoTolerance=False), "appel ") == []
    assert ids(make(names, minWordSizefor1Typo=6), "appel ") == []
    assert ids(make(names, disableTypoToleranceOnWords=["appel"]), "appel ") == []
    assert ids(make(names, disableTypoToleranceOnAttributes=["name"]), "appel ") == []
    assert ids(i, "12346 ") == [7] and ids(make(names, allowTyposOnNumericTokens=False), "12346 ") == []


@BOTH
def test_splits_and_concats(make):
    names = ["hot dog stand", "hotdog", "blue tooth speaker", "bluetooth", "hot plate", "an o'kelly pub", "abdel-rahman", "mens-watches"]
    i = make(names)
    assert set(ids(i, "hotdog ")) == {0, 1} and set(ids(i, "hot dog ")) == {0, 1}
    assert set(ids(i, "bluetooth")) == {2, 3} and ids(i, "bluetooth speaker") == [2]
    assert ids(i, "hot ") == [0, 4]
    for text in ("o'kelly", "o kelly", "okelly"):
        assert ids(i, text) == [5]
    assert ids(i, "abdelr") == [6] and ids(i, "mens ") == [7] and ids(i, "watches ") == [7]
    assert len(ids(i)) == len(names)


def test_words_that_are_folded(make):
    names = ["the box", "boxes", "a party", "parties", "le chat"]
    assert ids(make(names), "the boxes ") == []
    i = make(names, removeStopWords=True)
    assert ids(i, "the boxes ") == [1]
    assert ids(make(names, removeStopWords=True, ignorePlurals=True), "the boxes ") == [1, 0] or set(ids(
        make(names, removeStopWords=True, ignorePlurals=True), "the boxes ")) == {0, 1}
    assert set(ids(make(names, ignorePlurals=["en"], typoTolerance=False), "party ")) == {2, 3}
    assert ids(make(names, removeStopWords=True, queryLanguages=["fr"]), "le chat ") == [4]
    assert ids(make(names, removeStopWords=["fr"]), "le chat ") == [4] and ids(make(names, removeStopWords=["fr"]), "the zzz ") == []


def test_synonyms(make):
    names = ["couch", "sofa bed", "phone", "smart phone", "tv", "tele vision set"]
    rows = [("synonym", None, ["couch", "sofa"]), ("oneWaySynonym", "handy", ["phone"]), ("altCorrection1", "telly", ["tv"]), (
        "synonym", None, ["tv", "tele vision"])]
    i = make(names, synonyms=rows)
    assert set(ids(i, "couch ")) == {0, 1} and set(ids(i, "sofa ")) == {0, 1}
    assert set(ids(i, "handy ")) == {2, 3} and set(ids(i, "phone ")) == {2, 3}
    assert ids(i, "telly ") == [4]
    assert set(ids(i, "tv ")) == {4, 5} and set(ids(i, "tele vision ")) == {4, 5}


def test_rules(make):
    names = ["laptop", "laptop case", "tablet", "phone"]
    rule = lambda i, pattern, how, **k: (i, pattern, how, None, True, None, None, k.get("query"), k.get("remove"), k.get(
        "filters"), k.get("user"), k.get("promote"), k.get("hide"), k.get("only"))
    i = make(names, rules=[rule("a", "laptop", "contains", promote=[("3", 0)], hide=["1"], user="one"), rule("b", "tab",
        "startsWith", query="laptop", user="two"), rule("c", "phone", "is", filters="id < 3")])
    got = i.search(SearchRequest("laptop")).response()
    assert [h["id"] for h in got["hits"]] == [3, 0] and got["appliedRules"] == ["a"] and got["userData"] == ["one"]
    assert ids(i, "tab") == [0, 1] and i.search(SearchRequest("tab")).response()["query"] == "laptop"
    assert ids(i, "phone") == [] and ids(i, "phone", enable_rules=False) == [3]
    j = make(names, rules=[rule("a", "laptop", "is", promote=[("3", 0), ("2", 1)], filters="id != 3", only=True)])
    assert ids(j, "laptop") == [0, 2, 1]


def test_order_and_ranking_info(make):
    names = ["red big shoe", "red shoe", "shoe red", "hat", "redd shoes for two", "red x x x x x x x x x shoe"]
    more = [("", 1.0, 9, 0.0, 0.0), ("", 2.0, 8, 10.0, 10.0), ("", 3.0, 7, 0.1, 0.1), ("red shoe", 4.0, 6, 50.0, 50.0), ("", 5.0,
        5, -10.0, 0.0), ("", 6.0, 4, 80.0, 0.0)]
    i = make(names, more=more, customRanking=["desc(score)"])
    r = SearchRequest("red shoe ", ranking_info=True)
    hits = i.search(r).response()["hits"]
    assert [h["id"] for h in hits] == [2, 1, 3, 0, 5]  # near before far, name before other, then the custom ranking
    assert hits[0]["_rankingInfo"]["nbTypos"] == 0 and hits[0]["_rankingInfo"]["proximityDistance"] == 1 and hits[0]["_rankingInfo"]["nbExactWords"] == 2
    assert hits[0]["score"] == 3.0 and hits[0]["pos"] == 7 and hits[0]["_pos"] == 1  # attributes keep their names
    assert [h["id"] for h in i.search(SearchRequest("", hits_per_page=2)).response()["hits"]] == [5, 4]
    assert ids(i, "", sort=["asc(pos)"]) == [5, 4, 3, 2, 1, 0]
    near = i.search(SearchRequest("", around=(0.0, 0.0), radius=50_000, ranking_info=True)).response()["hits"]
    assert [h["id"] for h in near] == [0, 2] and near[1]["_rankingInfo"]["matchedGeoLocation"]["distance"] == pytest.approx(15725, abs=5)
    assert ids(i, "", boxes=[(9, 9, 51, 51)]) == [3, 1]
    assert [h["id"] for h in i.search(SearchRequest("", offset=1, length=2)).response()["hits"]] == [4, 3]
    assert len(i.search(SearchRequest("red", click_analytics=True)).response()["queryID"]) == 32


def test_optional_words_and_syntax(make):
    names = ["red cotton shirt", "red shirt", "cotton", "blue shirt", "shirt red"]
    i = make(names, typoTolerance=False)
    assert ids(i, "red cotton ") == [0]
    assert set(ids(make(names, optionalWords=["cotton"]), "red cotton ")) == {0, 1, 4}
    assert ids(i, "red zzz ") == [] and set(ids(make(names, removeWordsIfNoResults="lastWords"), "red zzz ")) == {0, 1, 4}
    assert ids(make(names, removeWordsIfNoResults="firstWords"), "zzz cotton ") == [0, 2] or set(ids(
        make(names, removeWordsIfNoResults="firstWords"), "zzz cotton ")) == {0, 2}
    assert set(ids(make(names, removeWordsIfNoResults="allOptional"), "zzz red yyy ")) == {0, 1, 4}
    a = make(names, advancedSyntax=True)
    assert ids(a, '"red shirt"') == [1] and set(ids(a, "shirt -red")) == {3}


def test_highlights(make):
    i = make(["An Apple a day", "pineapple", "o'kelly's pub"], attributesToHighlight=["name"], attributesToSnippet=["name:2"])
    hit = lambda text: i.search(SearchRequest(text)).response()["hits"][0]
    got = hit("app")["_highlightResult"]["name"]
    assert got == {"value": "An <em>App</em>le a day", "matchLevel": "full", "matchedWords": ["app"], "fullyHighlighted": False}
    assert hit("appel ")["_highlightResult"]["name"]["value"] == "An <em>Apple</em> a day"
    assert hit("okelly")["_highlightResult"]["name"]["value"].startswith("<em>o'kelly</em>")
    assert hit("apple")["_snippetResult"]["name"]["value"] == "…Apple a…"
    assert hit("")["_highlightResult"]["name"] == {"value": "An Apple a day", "matchLevel": "none", "matchedWords": [],
        "fullyHighlighted": False} or hit("")["_highlightResult"]["name"]["matchLevel"] == "none"


def test_parameters():
    r = SearchRequest.from_params("query=a%20b&typoTolerance=false&aroundLatLng=1.5,2&aroundRadius=all&removeStopWords=%5B%22en%22%5D&offset=3&length=4")
    assert (r.query, r.around, r.radius, r.offset, r.length) == ("a b", (1.5, 2.0), "all", 3, 4)
    assert r.overrides == {"typoTolerance": False, "removeStopWords": ["en"]}
    with pytest.raises(ValueError):
        SearchRequest.from_params("query=a&colour=red")


def test_stored_postings_read_by_folder(spark, tmp_path):
    docs = spark.range(2000).select(F.col("id"), F.concat(F.lit("item"), F.col("id"), F.lit(" word" + "x" * 30),
        F.col("id") % 7).alias("name"))
    post = StoredPostings.build(docs, "id", ["name"], str(tmp_path / "p"))
    assert post.known(["item5", "item5000", "zz"]) == {"item5": 0}
    plan = post.read(["item77"], [])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(lead" in plan and "PushedFilters: [IsNotNull(token), EqualTo(token,item77)]" in plan
    assert {r.object_id for r in post.read(["item77"], []).collect()} == {77}
    long = "word" + "x" * 30
    assert post.similar({f"{long}33": 1, "item7": 1, "itme77": 1})["itme77"].keys() >= {"item77"}
    assert set(post.similar({f"{long}33": 1})[f"{long}33"]) == {f"{long}3"}
    assert neighbours("abc", 1) == {"abc", "ab", "ac", "bc"}
