import random

import duckdb
import pytest
from pyspark.sql import functions as F

from skylark.operators import analytics as an
from skylark.operators import facets, merchandising, ranking, recommend
from skylark.plans import catalog
from skylark.plans.search import Index, IndexSettings, SearchRequest


def pinned(natural, pins):
    """Pins put in one after the other."""
    out, seen, todo = [x for x in natural if x not in {i for i, _ in pins}], set(), []
    for k, (i, t) in enumerate(pins):
        if i not in seen:
            seen.add(i)
            todo.append((min(t, 1000), k, i))
    last = -1
    for t, _, i in sorted(todo):
        last = min(max(t, last + 1), len(out))
        out.insert(last, i)
    return out


def test_pin_slots_against_insertion():
    rng = random.Random(3)
    for _ in range(500):
        n = rng.randint(0, 8)
        natural = list(range(n))
        pins = [(rng.randint(0, 12), rng.randint(0, 12)) for _ in range(rng.randint(0, 5))]
        slots = dict(ranking.pin_slots(pins, len([x for x in natural if x not in {i for i, _ in pins}])))
        want = pinned(natural, pins)
        assert {i: want.index(i) for i in slots} == slots


def test_pin_and_hide(spark):
    docs = spark.createDataFrame([(i, 10 - i) for i in range(8)], "object_id int, p int")
    got = ranking.pin(docs, docs.where("object_id < 5"), [(7, 1), (0, 1), (99, 0)], [2, 7], [F.desc("p")])
    assert [r.object_id for r in got.orderBy("slot").collect()] == [1, 7, 0, 3, 4]


def test_order_of_missing_values(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 9)], "object_id int, x int")
    order = lambda rule: [r.object_id for r in ranking.top(df, ranking.order_keys([rule]), 9).orderBy("pos").collect()]
    assert order("asc(x)") == [1, 2, 3]
    assert order("desc(x)") == [3, 2, 1]


def test_facet_paths(spark):
    df = spark.createDataFrame([(1, ("a", None), ["x > y", "z"], "b > c")],
        "object_id int, s struct<lvl0:string,lvl1:string>, l array<string>, t string")
    paths = lambda f: [r.path for r in facets.paths(df, f).collect()]
    assert paths("s") == ["/s.lvl0/a"]
    assert paths("l") == ["/l/x/y", "/l/z"]
    assert paths("t") == ["/t/b/c"]
    with pytest.raises(TypeError):
        paths("object_id")


def test_disjunctive_counts(spark):
    df = spark.createDataFrame([("a", "r"), ("a", "g"), ("b", "r"), ("c", "r")], "brand string, color string")
    got = {(r.facet, r.value): r["count"] for r in facets.disjunctive(df, {"brand": ["a"], "color": ["r", "no"]}).collect()}
    assert got == {("brand", "a"): 1, ("brand", "b"): 1, ("brand", "c"): 1, ("color", "r"): 1, ("color", "g"): 1, ("color", "no"): 0}


def test_rules_apply_in_order(spark):
    rules = spark.createDataFrame([("b", "shoe", "contains", None, True, None, None, "boots", None, None, "2"), ("a", "red",
        "startsWith", None, True, None, None, None, ["red"], "x:1", "1")], merchandising.RULE)
    q = spark.createDataFrame([(0, "red shoes"), (1, "hat")], "query_id int, text string")
    a, b = merchandising.apply_rules(q, rules).orderBy("query_id").collect()
    assert (a.rewritten, a.filters, a.user_data, a.applied_rules) == ("boots", "(x:1)", "1|2", "a,b")
    assert (b.rewritten, b.applied_rules) == ("hat", "")


def test_dedup_boundary(spark):
    rows = spark.createDataFrame([(1, "u", "i", 0.0), (2, "u", "i", 29.9), (3, "u", "i", 59.9), (4, "u", "j", 60.0), (5, "u", "i",
        70.0), (6, "v", "i", 1.0)], "event_id int, user_token string, index_name string, t double")
    assert {r.event_id for r in an.dedup_searches(rows).where("counted").collect()} == {1, 3, 4, 6}


def test_event_validation(spark):
    good = {"event_type": "click", "event_name": "n", "user_token": "u", "object_ids": ["1"], "objectIDs": [],
        "query_id": "a" * 32, "positions": [1], "timestamp": 1000}
    cases = [
        ({}, None), ({"event_type": "buy"}, "invalid event type: buy"), ({"event_name": ""}, "event name"), (
            {"event_name": "é" * 33}, "event name"), ({"user_token": "x" * 130}, "user token"), ({"object_ids": []},
            "an event must"), ({"object_ids": [], "objectIDs": ["9"]}, None),
        ({"object_ids": ["1"] * 21}, "an event must"), ({"positions": None}, "a click after"), ({"positions": [1, 2]},
            "positions must"), ({"query_id": "xyz"}, "query id"), ({"timestamp": -an.DAY_MS * 5}, "timestamp"), (
            {"query_id": None, "positions": None}, None), ({"event_type": "view", "positions": None}, None),
    ]
    schema = "n int, event_type string, event_name string, user_token string, object_ids array<string>, objectIDs array<string>, query_id string, positions array<int>, timestamp long"
    rows = spark.createDataFrame([(n, *(good | c).values()) for n, (c, _) in enumerate(cases)], schema).withColumn("ids",
        an.effective_ids())
    for r in rows.select("n", an.validation_error(0).alias("e")).collect():
        want = cases[r.n][1]
        assert (r.e is None) if want is None else r.e.startswith(want), (r.n, r.e)
    accepted, verdict = an.ingest(rows.drop("ids"), 0)
    assert accepted.count() == 4
    assert verdict.first().ok


def test_search_request(spark):
    docs = spark.createDataFrame([(i, f"red thing {i}", "ab"[i % 2], float(i), "s") for i in range(6)]
        + [(9, "blue thing", "a", 1.0, "s")], "id int, name string, brand string, price double, secret string")
    index = Index(docs, "id", IndexSettings({"searchableAttributes": ["name"],
        "attributesForFaceting": ["brand", "filterOnly(secret)"], "customRanking": ["desc(price)"],
        "unretrievableAttributes": ["secret"]}))
    r = SearchRequest.from_params("query=red&filters=price%20%3E%3D%201&facets=%5B%22brand%22%2C%22secret%22%5D&hitsPerPage=2&page=1")
    got = index.search(r).response()
    assert [h["id"] for h in got["hits"]] == [3, 2]
    assert "secret" not in got["hits"][0]
    assert (got["nbHits"], got["nbPages"], got["facets"]) == (5, 3, {"brand": {"a": 2, "b": 3}})
    assert index.search(SearchRequest("red", hits_per_page=0, facets=["brand"])).response(["nbHits"]) == {"nbHits": 6}
    pins = index.search(SearchRequest("red", hits_per_page=3, pins=[(9, 0)], hidden=[5])).response()
    assert [h["id"] for h in pins["hits"]] == [9, 4, 3]
    assert IndexSettings().merge({"ranking": [], "customRanking": [], "zzz": 1}) == ["ranking", "zzz"]


def test_experiments(spark):
    counts = spark.createDataFrame([("c", "ctr", 100, 1000), ("v", "ctr", 150, 1000), ("c", "cvr", 10, 1000), ("v", "cvr", 11,
        1000)], "variant string, metric string, hits int, n int")
    got = {r.metric: r for r in recommend.compare_rates(counts, "c").collect()}
    assert got["ctr"].p_value == pytest.approx(0.000724, abs=2e-5)
    assert got["cvr"].p_value > 0.5
    for how in ("bonferroni", "benjamini-hochberg"):
        assert {r.metric: r.significant for r in recommend.corrected(recommend.compare_rates(counts, "c"), how).collect(
            )} == {"ctr": True, "cvr": False}
    assert recommend.sample_size(0.1, 0.1) == pytest.approx(14749, rel=0.01)


def test_pairs_of_large_baskets_count(spark):
    rng = random.Random(21)
    baskets = {0: range(150), 1: range(100, 260), **{k: rng.sample(range(260), 5) for k in range(2, 40)}, 99: [7]}
    rows = [(k, i) for k, items in baskets.items() for i in items]
    sets = [set(v) for v in baskets.values() if len(v) > 1]
    size = {i: sum(i in s for s in sets) for i in range(260)}
    want = {(i, j, t, round(t * len(sets) / (size[i] * size[j]), 6)) for i in range(260) for j in range(260) if i != j and (
        t := sum(i in s and j in s for s in sets)) >= 2}
    df = spark.createDataFrame([*rows, *rows[:5]], "basket long, item long")
    for more in ({}, {"block": 40}):
        got = recommend.bought_together(df, "basket", "item", n=1000, **more).collect()
        assert len(got) == len(want) and {(r.item, r.other, r.together, r.lift) for r in got} == want


def test_pairs_are_dealt_to_tasks_by_their_number(spark):
    rng = random.Random(5)
    rows = [(k, i) for k in range(3000) for i in rng.sample(range(400), 6)] + [(-1, i) for i in range(300)]
    df = spark.createDataFrame(rows, "basket long, item long")
    got = recommend.item_pairs(recommend.basket_blocks(df, "basket", "item", 100, 2000), 45)
    tasks = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 3000 * 15 + 300 * 299 // 2 and max(tasks) <= 2000 + 2 * 100 * 100
    blocks = recommend.basket_blocks(df, "basket", "item", 100, 2000).where("basket = -1").orderBy("x").collect()
    assert [(b.x, b.blocks, sorted(b["items"])) for b in blocks] == [(k, 3, list(range(100 * k, 100 * k + 100))) for k in range(3)]
    plan = recommend.bought_together(df, "basket", "item", each=2000)._jdf.queryExecution().toString()
    assert plan.count(f", {-(-(3000 * 15 + 300 * 299 // 2) // 2000)}), REPARTITION_BY_NUM") >= 2


def test_also_bought_with_missing_and_repeated_values(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(30)])) for _ in range(400)] + [(99, None), (99, 1), (98, None), (97, 2)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([], "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/none/lineitem.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = duck.sql(catalog.SQL["also_bought"])
    got = catalog.also_bought(spark, str(tmp_path))
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall())
    assert catalog.also_bought(spark, f"{tmp_path}/none").count() == 0
