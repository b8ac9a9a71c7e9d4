import random
import zlib

import pytest

ODD = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, unit string, doc string, text_key string, kept string, length string, score string, n string, payload string"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, near copies, toxic texts."""
    rng = random.Random(1)
    base = prose(rng, 120)
    near = base.split()
    near[50] = "changed"
    texts = [None, "", "   \n\t", "one", base, base, " ".join(near), prose(rng, 30_000, 5_000), prose(rng, 60)
        + "\nshared line here\n" + prose(rng, 40), "Ünïcode … 中文 <|endoftext|> É", "a\x00b", "x" * 5000]
    texts += [prose(rng, rng.randint(25, 90)) + (" idiot" if k % 7 == 0 else "") for k in range(160)]
    rows = [(i, t, "en", f"s{i % 5}", len(t or ""), i, "s", "u", "d", "k", "y", "l", "s", "n", "p") for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (None, prose(rng, 40), None, None, *[None] * 11), (None, None, None, None, *[None] * 11), (500,
        prose(rng, 40), None, None, *[None] * 11)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD).repartition(3)


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(r[0], 1, int("idiot" in r[1])) for r in odd_rows()[12:172]]
    return spark.createDataFrame([*rows, (None, 1, 1), (3, None, None), (20, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def odd_dir(odd, odd_labels, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    odd.write.parquet(f"{d}/documents.parquet")
    odd_labels.write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="session")
def empty_dir(spark, odd, odd_labels, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    odd.limit(0).write.parquet(f"{d}/documents.parquet")
    odd_labels.limit(0).write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d


def crc(b):
    return zlib.crc32(b)
