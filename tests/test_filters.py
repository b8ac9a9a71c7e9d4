import duckdb
import pytest
from pyspark.sql import functions as F

from skylark.functions import filters as ff
from skylark.functions import geo
from skylark.plans import catalog

ROWS = [(1, "Apple", "x", 10.0, ["red", "big"]), (2, "Apple", "v", 20.0, ["red"]), (3, "Dell", "x", 30.0, []), (4, None, "q", None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "id int, brand string, a string, price double, _tags array<string>")


def ids(docs, condition):
    return [r.id for r in docs.where(condition).orderBy("id").collect()]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("brand:Apple", [1, 2]), ("brand = 'apple'", [1, 2]), ("brand != 'Apple'", [3, 4]), ("NOT brand:Apple", [3, 4]), (
            "price >= 20", [2, 3]), ("price:10 TO 20", [1, 2]), ("price > 10 AND price < 30", [2]),
        ("((brand:Apple OR a:q) AND a:x) OR a:q", [1, 4]), ("not (price > 15 or brand:Apple)", [4]), ("a:x OR a:v AND price > 15",
            [1, 2, 3]), ('"brand":"Apple"', [1, 2]), ("price > -1", [1, 2, 3]), ("", [1, 2, 3, 4]), (None, [1, 2, 3, 4]),
    ],
)
def test_filters(docs, text, expected):
    assert ids(docs, ff.parse_filter(text)) == expected


def test_keywords_need_boundaries(spark):
    df = spark.createDataFrame([(1, "v", "w", "u")], "id int, NOTcategory string, ANDroid string, `OR` string")
    assert ids(df, ff.parse_filter("NOTcategory = 'v' AND ANDroid = 'w' AND \"OR\" = 'u'")) == [1]
    assert ids(df, ff.parse_filter("NOT NOTcategory = 'v'")) == []


@pytest.mark.parametrize("text", ["brand", "brand:", "(brand:x", "brand:x)", "AND a:x", "a:x OR", "= 3"])
def test_bad_filters(text):
    with pytest.raises(ff.FilterError):
        ff.parse_filter(text)


def test_undeclared_facets_match_nothing(docs):
    s = ff.Settings(facets={"a"})
    assert ids(docs, ff.parse_filter("brand:Apple", s)) == []
    assert ids(docs, ff.parse_filter("a:x", s)) == [1, 3]
    assert ids(docs, ff.parse_filter("price >= 20", s)) == [2, 3]


def test_lists(docs):
    assert ids(docs, ff.facet_filters([["brand:Apple", "a:q"], "a:-v"])) == [1, 4]
    assert ids(docs, ff.numeric_filters(["price>=10", ["price<15", "price:25 TO 40"]])) == [1, 3]
    assert ids(docs, ff.tag_filters(["red", "-big"])) == [2]
    got = {r.id: r.s for r in docs.select("id", ff.optional_score(["brand:Apple<score=2>", "a:x"]).alias("s")).collect()}
    assert got == {1: 3, 2: 2, 3: 1, 4: 0}


def test_array_facets(docs):
    assert ids(docs, ff.parse_filter("_tags:RED", ff.Settings(arrays=["_tags"]))) == [1, 2]


def test_secured_keys(docs):
    key = ff.secured_key("k", {"filters": "brand:Apple OR a:q", "restrictIndices": ["prod_*"], "validUntil": 100})
    got = ff.open_key(key, "k", "prod_1", 50, ["prod*"])
    assert ids(docs, ff.secured_filter(got, "a:x OR a:q")) == [1, 4]
    for args in ((key, "other", "prod_1", 50), (key, "k", "prod_1", 101), (key, "k", "dev", 50), (key, "k", "prod_1", 50, ["other_*"])):
        with pytest.raises(ff.KeyRefused):
            ff.open_key(*args)


def test_geo(spark):
    df = spark.createDataFrame([(1, 48.85, 2.35), (2, 51.5, -0.12), (3, None, 1.0)], "id int, lat double, lng double")
    lat, lng = F.col("lat"), F.col("lng")
    assert ids(df, geo.around(lat, lng, (48.85, 2.35), 400_000)) == [1, 2]
    assert ids(df, geo.around(lat, lng, (48.85, 2.35), 300_000)) == [1]
    assert ids(df, geo.inside_polygon(lat, lng, [(50, -2), (53, -2), (53, 2), (50, 2)])) == [2]


def test_polygons_do_not_contain_their_edges(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 0.0, 1.0), (3, 1.0, 0.0), (4, 2.0, 2.0), (5, 0.0, 0.0), (6, 3.0, 1.0), (7, 4.0, 0.0), (
        8, 0.0, 4.0), (9, None, 1.0), (10, -1.0, 1.0), (11, 0.0, 5.0), (12, 0.5, 3.0)], "id int, lat double, lng double")
    corners = [(0, 0), (4, 0), (0, 4)]
    for points in (corners, corners[::-1], corners[1:] + corners[:1]):
        assert ids(df, geo.inside_polygon(F.col("lat"), F.col("lng"), points)) == [1, 12]
    dart = [(0, 0), (2, 4), (0, 2), (-2, 4)]  # not convex: (0, 2) is a corner that points inwards
    df = spark.createDataFrame([(1, 0.0, 1.0), (2, 0.0, 2.0), (3, 0.0, 3.0), (4, 1.0, 2.0), (5, 1.0, 2.5), (6, 1.0, 3.0), (7, 0.0, -1.0)],
        "id int, lat double, lng double")
    assert ids(df, geo.inside_polygon(F.col("lat"), F.col("lng"), dart)) == [1, 5]


def test_geo_polygon_on_every_coordinate(spark, tmp_path):
    spark.range(61200).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r.object_id for r in catalog.geo_polygon(spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    assert got == {r[0] for r in duck.sql(catalog.SQL["geo_polygon"]).fetchall()}
