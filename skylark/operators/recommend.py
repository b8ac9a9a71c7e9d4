"""Recommendations, suggestions, affinities and experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylark.operators import matching
from skylark.session import work_path


def _best(rows: DataFrame, group: str, n: int, *keys: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*keys))).where(F.col("rank") <= n)


def _tasks(spark: SparkSession, rows: int, each: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))


def basket_blocks(baskets: DataFrame, basket: str, item: str, block: int = 512, each: int = 1_000_000) -> DataFrame:
    """basket, x, blocks, items: the different items of every basket of two or more, in order, cut into `blocks` rows of up
    to `block` items, x from 0. It is stored, since its readers count it before they deal it out."""
    spark, w = baskets.sparkSession, Window.partitionBy("basket").orderBy("item")
    rows = baskets.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where("basket IS NOT NULL")
    at = rows.repartition(_tasks(spark, baskets.count(), each), "basket").withColumn("at", F.dense_rank().over(w))
    once = at.withColumn("before", F.lag("at", 1, 0).over(w)).where("before < at")
    sized = once.withColumn("size", F.max("at").over(Window.partitionBy("basket"))).where("size >= 2")
    blocks = sized.groupBy("basket", F.floor((F.col("at") - 1) / block).alias("x"), F.ceil(F.col("size") / block).alias(
        "blocks")).agg(F.collect_list("item").alias("items"))
    path = work_path(spark, "baskets")
    blocks.write.parquet(path)
    return spark.read.schema(blocks.schema).parquet(path)


def item_pairs(blocks: DataFrame, tasks: int) -> DataFrame:
    """item, other: each two items of a basket once, item < other. Every two blocks of a basket meet in one of so many tasks."""
    many = blocks.where("blocks > 1")
    left = many.select("basket", "x", F.explode(F.sequence("x", F.col("blocks") - 1)).alias("y"), F.col("items").alias("left"))
    right = many.select("basket", F.explode(F.sequence(F.lit(0).cast("long"), "x")).alias("x"), F.col("x").alias("y"), F.col(
        "items").alias("right"))
    whole = blocks.where("blocks = 1").select("basket", "x", F.col("x").alias("y"), F.col("items").alias("left"), F.col(
        "items").alias("right"))
    met = whole.unionByName(left.join(right, ["basket", "x", "y"])).repartition(tasks, "basket", "x", "y")
    return met.select(F.explode("left").alias("item"), "right").select("item", F.explode("right").alias("other")).where("item < other")


def bought_together(baskets: DataFrame, basket: str, item: str, n: int = 3, least: int = 2, block: int = 512,
    each: int = 1_000_000) -> DataFrame:
    """item, other, together, lift, rank of items in common baskets.

    No task pairs a whole basket of more than `block` items. Rows and pairs are counted first and dealt to tasks of
    about `each`, so a task's memory does not follow the input."""
    count, size = F.count(F.lit(1)), F.size("items").cast("long")
    blocks = basket_blocks(baskets, basket, item, block, each)
    total, n_pairs = blocks.agg(F.count_if(F.col("x") == 0), F.coalesce(F.sum(size * (size - 1) / 2 + size * block * (
        F.col("blocks") - 1 - F.col("x"))), F.lit(0)).cast("long")).first()
    tasks = _tasks(baskets.sparkSession, n_pairs, each)
    joint = item_pairs(blocks, tasks).groupBy("item", "other").agg(count.alias("together")).where(F.col("together") >= least)
    ways = [F.struct(F.col(a).alias("item"), F.col(o).alias("other"), "together") for a, o in (("item", "other"), ("other", "item"))]
    # lift decides only between pairs that `together` leaves equal; they may be many, so these are dealt out as well
    near = joint.select(F.explode(F.array(*ways)).alias("p")).select("p.*").repartition(tasks, "item").withColumn("place", F.rank(
        ).over(Window.partitionBy("item").orderBy(F.desc("together")))).where(F.col("place") <= n)
    alone = blocks.select(F.explode("items").alias("item")).groupBy("item").agg(count.alias("n"))
    scored = near.join(alone.select("item", F.col("n").alias("n_item")), "item").repartition(tasks, "other").join(alone.select(
        F.col("item").alias("other"), F.col("n").alias("n_other")), "other")
    lift = F.round(F.col("together") * F.lit(total).cast("long") / (F.col("n_item") * F.col("n_other")), 6)
    return _best(scored.select("item", "other", "together", lift.alias("lift")), "item", n, F.desc("together"), F.desc("lift"),
        F.col("other"))


def trending(events: DataFrame, item: str, ts: str, now: str, half_life_days: float = 7.0, n: int = 10) -> DataFrame:
    """Items by events that lose half their weight every half_life_days whole days."""
    age = F.datediff(F.lit(now).cast("date"), F.to_date(ts))
    got = events.where(age >= 0).groupBy(item, age.alias("age")).agg(F.count(F.lit(1)).alias("c")).groupBy(item).agg(F.sum(
        "c").alias("events"), F.round(F.sum(F.col("c") * F.pow(F.lit(0.5), F.col("age") / half_life_days)), 4).alias("score"))
    return got.orderBy(F.desc("score"), item).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), item)))


def trending_facets(events: DataFrame, facet: str, ts: str, now: str, n: int = 5) -> DataFrame:
    return trending(events, facet, ts, now, n=n)


def suggestions(searches: DataFrame, min_hits: int = 1, min_letters: int = 4, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Queries that are searched, have results and are long enough, by popularity."""
    q = F.lower(F.trim("query"))
    got = searches.groupBy(q.alias("suggestion")).agg(F.count(F.lit(1)).alias("popularity"), F.max("nb_hits").alias("nb_hits"))
    return got.where((F.col("nb_hits") >= min_hits) & (F.char_length("suggestion") >= min_letters) & ~F.col("suggestion").isin(
        list(exclude)))


def affinities(events: DataFrame, event_scores: dict[str, int], facet_scores: dict[str, int], user: str = "user_token",
    most: int = 20) -> DataFrame:
    """user, facet, value, score from 1 to `most`: points of events times points of facets, scaled to the user's best."""
    points = F.lit(0)
    for kind, p in event_scores.items():
        points = F.when(F.col("event_type") == kind, p).otherwise(points)
    one = [F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value"), F.lit(p).alias("p")) for f, p in facet_scores.items()]
    raw = events.withColumn("points", points).where("points > 0").select(user, "points", F.explode(F.array(*one)).alias(
        "f")).where("f.value IS NOT NULL").groupBy(user, "f.facet", "f.value").agg(F.sum(F.col("points") * F.col("f.p")).alias("raw"))
    best = F.max("raw").over(Window.partitionBy(user))
    return raw.withColumn("score", F.greatest(F.lit(1), F.round(F.col("raw") * most / best).cast("long"))).drop("raw")


def variant(user: Column, test: str, shares: dict[str, int]) -> Column:
    """The variant of a user: the same for every request, by percent shares."""
    h = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(test), user)), 1, 8), 16, 10).cast("long"), F.lit(100))
    out, top = F.lit(None).cast("string"), 0
    for name, share in reversed(shares.items()):
        top += share
    edge = top
    for name, share in reversed(shares.items()):
        out = F.when(h < edge, name).otherwise(out)
        edge -= share
    return out


def _phi(z: Column) -> Column:
    """The standard normal distribution function (Abramowitz and Stegun 26.2.17, error below 7.5e-8)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782
        + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def compare_rates(counts: DataFrame, control: str) -> DataFrame:
    """metric, variant, rate, difference to the control, its 95 % interval and p-value (two-sided z-test)."""
    c = counts.where(F.col("variant") == control).select("metric", F.col("hits").alias("c_hits"), F.col("n").alias("c_n"))
    rows = counts.where(F.col("variant") != control).join(c, "metric")
    p, q = F.col("hits") / F.col("n"), F.col("c_hits") / F.col("c_n")
    pool = (F.col("hits") + F.col("c_hits")) / (F.col("n") + F.col("c_n"))
    z = F.try_divide(p - q, F.sqrt(pool * (1 - pool) * (1 / F.col("n") + 1 / F.col("c_n"))))
    se = F.sqrt(p * (1 - p) / F.col("n") + q * (1 - q) / F.col("c_n"))
    r = lambda x: F.round(x, 6)
    return rows.select("metric", "variant", r(p).alias("rate"), r(p - q).alias("difference"), r(p - q - 1.96 * se).alias("low"),
        r(p - q + 1.96 * se).alias("high"), r(2 * (1 - _phi(F.abs(z)))).alias("p_value"))


def corrected(tests: DataFrame, how: str = "benjamini-hochberg", alpha: float = 0.05) -> DataFrame:
    """Tests with whether they stay significant under the correction."""
    m = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    if how == "bonferroni":
        return tests.withColumn("significant", F.col("p_value") * m <= alpha)
    w = Window.orderBy("p_value", "metric", "variant")
    ranked = tests.withColumn("m", m).withColumn("r", F.row_number().over(w))
    last = F.max(F.when(F.col("p_value") <= F.col("r") / F.col("m") * alpha, F.col("r"))).over(Window.partitionBy(F.lit(1)))
    return ranked.withColumn("significant", F.coalesce(F.col("r") <= last, F.lit(False))).drop("m", "r")


def sample_size(rate: float, effect: float, power_z: float = 0.8416, alpha_z: float = 1.96) -> int:
    """Users of each variant that a test needs to see a relative effect on a rate."""
    other = rate * (1 + effect)
    return int(-(-((alpha_z + power_z) ** 2 * (rate * (1 - rate) + other * (1 - other))) // (rate - other) ** 2))


def inject(organic: DataFrame, injected: DataFrame, position: int, length: int, id_col: str = "object_id",
    dedup: str = "highestInjected") -> DataFrame:
    """A feed (id, slot from 0) with up to `length` injected rows (id, rank) from a position on.

    organic has ranks from 1 without gaps, so a row's slot follows from its rank and the few rows that are
    injected; the feed is neither sorted nor moved."""
    first = injected.where(F.col("rank") <= length)
    if dedup != "highestInjected":
        first = first.join(organic.where(F.col("rank") <= position).select(id_col), id_col, "left_anti")
    taken = organic.join(first.select(id_col), id_col, "left_semi")
    organic = organic.join(first.select(id_col), id_col, "left_anti")
    w = Window.orderBy("rank", id_col)
    add = first.withColumn("slot", (F.row_number().over(w) - 1 + position).cast("long")).persist()  # at most `length` rows
    n = add.count()
    # ranks may have gaps where rows were left out; the few that were are counted below each row that they precede
    gone = [r[0] for r in taken.select("rank").collect()]
    before = sum((F.when(F.col("rank") > g, 1).otherwise(0) for g in gone), F.lit(0))
    at = F.col("rank").cast("long") - 1 - before
    rest = organic.select(id_col, F.when(at >= position, at + n).otherwise(at).alias("slot"), F.lit(False).alias("injected"))
    return rest.unionByName(add.select(id_col, "slot", F.lit(True).alias("injected")))


def multifeed(feeds: list[tuple[DataFrame, int]], id_col: str = "object_id") -> DataFrame:
    """id, feed and slot of several feeds (id, rank) one below the other, up to so many rows of each; an id stays in
    the first feed that has it."""
    rows = None
    for k, (feed, most) in enumerate(feeds):
        part = feed.where(F.col("rank") <= most).select(id_col, F.lit(k).alias("feed"), "rank")
        rows = part if rows is None else rows.unionByName(part)
    once = rows.groupBy(id_col).agg(F.min(F.struct("feed", "rank")).alias("at")).select(id_col, "at.*")
    # at most the sum of `most` rows
    return once.withColumn("slot", (F.row_number().over(Window.orderBy("feed", "rank")) - 1).cast("long")).select(id_col, "feed", "slot")


def related(views: DataFrame, user: str, item: str, n: int = 3, least: int = 2, block: int = 512) -> DataFrame:
    """item, other, together, lift, rank of items that the same users look at."""
    return bought_together(views, user, item, n, least, block)


def looking_similar(vectors: DataFrame, items: DataFrame, k: int = 3, threshold: float = 0.0, id_col: str = "vec_id",
    vec_col: str = "embedding") -> DataFrame:
    """query_id, id, similarity, rank of the items that look most like some, from their vectors."""
    return matching.cosine_neighbours(vectors, items, k, id_col, vec_col).where(F.col("similarity") >= threshold)
