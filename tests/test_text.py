import random

import pytest
from pyspark.sql import functions as F

from skylark.functions import text
from skylark.operators import matching


def words(t):
    return [w for w, *_ in text.tokens_of(t)]


@pytest.mark.parametrize(
    ("t", "expected"),
    [
        ("hello world", ["hello", "world"]), ("O'Kelly", ["O", "Kelly", "OKelly"]), ("mens-watches x",
            ["mens", "watches", "menswatches", "x"]), ("foo--bar", ["foo", "bar", "foobar"]),
        ("-foo-bar", ["foo", "bar"]), ("a.b", ["a", "b"]), ("é.b", ["é", "b", "éb"]), ("ab\0cd-ef", ["ab", "cd", "ef", "cdef"]), (
            "日本go", ["日", "本", "go"]), ("x-日", ["x", "日"]), ("a-b-日c", ["a", "b", "日", "c"]),
        ("a-bc日", ["a", "bc", "abc", "日"]), ("", []), ("、", ["、"]), ("foo bar-baz", ["foo", "bar", "baz", "barbaz"]),
    ],
)
def test_tokens(t, expected):
    assert words(t) == expected


def test_token_positions_and_offsets():
    got = text.tokens_of("O'Kelly x")
    assert [p for _, p, *_ in got] == [0, 1, 2, 3]
    assert got[2][2:] == (0, 7)
    assert got[3][2:] == (8, 9)


def test_tokenize_columns(spark):
    rng = random.Random(11)
    chars = ["a", "B", "é", "1", "²", "-", "'", ".", "_", " ", "\t", "\0", "\xa0", "\u2003", "\u3000", "、", "日", "か", "한", "𠀀",
        "ß", "٣", "\n", "&"]
    texts = ["Abdel-Rahman", None, "", "O'Kelly", "-foo-bar x", "foo--bar"] + ["".join(rng.choices(chars, k=rng.randint(0, 14)))
        for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", text.tokenize(F.col("t")).alias("k"),
        text.tokenize_offsets(F.col("t")).alias("o"))
    for r in df.collect():
        want = [(w.lower(), p) for w, p, *_ in text.tokens_of(texts[r.id] or "")]
        assert [(x.token, x.pos) for x in r.k] == want, texts[r.id]
        assert [(x.token, x.pos, x.start, x.end) for x in r.o] == [(w.lower(), p, a, b) for w, p, a, b in text.tokens_of(texts[r.id] or "")]


def test_edge_ngrams(spark):
    rows = spark.createDataFrame([("a",), ("ab",), ("abcd",)], "t string").select(text.edge_ngrams(F.col("t"), 2, 3).alias("g")).collect()
    assert [r.g for r in rows] == [[], ["ab"], ["ab", "abc"]]


def test_osa_against_brute_force():
    def slow(a, b):
        if not a or not b:
            return len(a) + len(b)
        d = min(slow(a[1:], b) + 1, slow(a, b[1:]) + 1, slow(a[1:], b[1:]) + (a[0] != b[0]))
        if len(a) > 1 and len(b) > 1 and a[0] == b[1] and a[1] == b[0]:
            d = min(d, slow(a[2:], b[2:]) + 1)
        return d

    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 5))) for _ in range(2))
        assert matching.osa_distance(a, b, 2) == min(slow(a, b), 3)


def test_fuzzy_terms_find_all_in_reach(spark):
    rng = random.Random(7)
    vocab = sorted({"".join(rng.choices("abcd", k=rng.randint(3, 9))) for _ in range(60)})
    asked = sorted({"".join(rng.choices("abcd", k=rng.randint(3, 9))) for _ in range(25)})
    got = {(r.word, r.term, r.typos) for r in matching.fuzzy_terms(spark.createDataFrame([(a,) for a in asked], "token string"),
        spark.createDataFrame([(v,) for v in vocab], "token string")).collect()}
    limit = lambda w: 0 if len(w) < 5 else 1 if len(w) < 9 else 2
    assert got == {(a, v, d) for a in asked for v in vocab if (d := matching.osa_distance(a, v, 2)) <= limit(a)}


def test_prefix_modes(spark):
    docs = spark.createDataFrame([(1, "Samsung Galaxy"), (2, "Samsung Washer"), (3, "Galaxy quest"), (4, None)],
        "object_id int, name string")
    post = matching.postings(docs, "object_id", ["name"])

    def ids(q, mode="prefixLast"):
        w = matching.parse_queries(spark.createDataFrame([(0, q)], "query_id int, text string"), mode)
        return sorted(r.object_id for r in matching.match(post, w).collect())

    assert ids("samsung gal") == [1]
    assert ids("sam galaxy") == []
    assert ids("sam gal", "prefixAll") == [1]
    assert ids("gal", "prefixNone") == []
    assert ids("wa") == [2]
    assert ids("wa ") == []


def test_phrase_and_joined_words(spark):
    docs = spark.createDataFrame([(1, "blue ring of gold"), (2, "ring blue"), (3, "O'Kelly")], "object_id int, name string")
    post = matching.postings(docs, "object_id", ["name"])
    assert [r.object_id for r in matching.exact_phrase(post, ["blue", "ring"]).collect()] == [1]
    w = matching.parse_queries(spark.createDataFrame([(0, "okelly"), (1, "o kelly"), (2, "okel")], "query_id int, text string"))
    assert sorted(r.query_id for r in matching.match(post, w).collect()) == [0, 1, 2]


def test_splits_and_joins(spark):
    vocab = spark.createDataFrame([("hot",), ("dog",), ("ho",), ("tdog",)], "token string")
    (r,) = text.split_alternatives(spark.createDataFrame([("hotdog",), ("cat",)], "token string"), vocab).collect()
    assert (r.first, r.second) == ("ho", "tdog")
    (j,) = spark.createDataFrame([("Hot dog stand",)], "t string").select(text.joined_alternatives(F.split("t", " ")).alias("j")).collect()
    assert j.j == ["hotdog", "dogstand", "hotdogstand"]


def test_typo_tolerance_and_relaxing(spark):
    hits = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (0, 2, "c"), (1, 1, "d")], "query_id int, typos int, term string")
    assert {r.term for r in matching.typo_tolerance(hits, "min").collect()} == {"a", "d"}
    assert {r.term for r in matching.typo_tolerance(hits, "strict").collect()} == {"a", "b", "d"}
    assert {r.term for r in matching.typo_tolerance(hits, "false").collect()} == {"a"}
    w = matching.parse_queries(spark.createDataFrame([(0, "x y z")], "query_id int, text string"))
    assert [(r["round"], r.token) for r in matching.relax(w, "firstWords").orderBy("round", "qpos").collect()][-1] == (2, "z")
