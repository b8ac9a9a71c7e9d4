"""Order, paging, grouping, pins and hides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_keys(rules: Sequence[str]) -> list[Column]:
    """asc(f) and desc(f) as sort keys: missing values first when rising, last when falling."""
    keys = []
    for r in rules:
        way, _, name = r.rstrip(")").partition("(")
        keys.append(F.col(name).asc_nulls_first() if way == "asc" else F.col(name).desc_nulls_last())
    return keys


def top(hits: DataFrame, keys: Sequence[Column], limit: int, offset: int = 0, id_col: str = "object_id") -> DataFrame:
    """The rows from offset on with their place; Spark keeps only offset + limit rows a task."""
    cut = hits.orderBy(*keys, F.col(id_col)).limit(offset + limit)
    return cut.withColumn("pos", F.row_number().over(Window.orderBy(*keys, F.col(id_col)))).where(F.col("pos") > offset)


def page(hits: DataFrame, keys: Sequence[Column], page_no: int, per_page: int, id_col: str = "object_id") -> DataFrame:
    """One page with nb_hits and nb_pages."""
    total = hits.agg(F.count(F.lit(1)).alias("nb_hits"))
    return top(hits, keys, per_page, page_no * per_page, id_col).join(F.broadcast(total)).withColumn("nb_pages", F.ceil(
        F.col("nb_hits") / per_page).cast("long"))


def distinct(hits: DataFrame, attribute: str, n: int, keys: Sequence[Column], id_col: str = "object_id") -> DataFrame:
    """The first n of every group, with their place in it; Spark limits groups before the shuffle."""
    w = Window.partitionBy(attribute).orderBy(*keys, F.col(id_col))
    return hits.withColumn("group_rank", F.row_number().over(w)).where(F.col("group_rank") <= n)


def hide(hits: DataFrame, hidden: Sequence, id_col: str = "object_id") -> DataFrame:
    return hits.where(~F.col(id_col).isin(list(hidden))) if hidden else hits


def pin_slots(pins: Sequence[tuple[object, int]], natural: int) -> list[tuple[object, int]]:
    """(id, slot) of pins (id, position) among `natural` other rows; the first of a repeated id counts.

    Positions are bounded by 1000. A pin goes behind the one before it and never beyond the end."""
    seen, unique = set(), []
    for k, (i, t) in enumerate(pins):
        if i not in seen:
            seen.add(i)
            unique.append((t, k, i))
    out: list[tuple[object, int]] = []
    for n, (t, _, i) in enumerate(sorted(unique)):
        t = min(t, 1000)
        out.append((i, min(t if not out else max(t, out[-1][1] + 1), natural + n)))
    return out


def pin(docs: DataFrame, hits: DataFrame, pins: Sequence[tuple[object, int]], hidden: Sequence, keys: Sequence[Column],
    id_col: str = "object_id", limit: int = 1000) -> DataFrame:
    """The first `limit` hits in order, with pinned rows (also of docs outside hits) at their positions; slot
    counts from 0. Only `limit` rows are numbered, of which a task keeps no more. Pass docs that fit the
    filters for pins that must fit them.

    Pins override hides. Natural rows fill the other slots in order: their slot is their rank plus the
    pins at or before it, a sum over the few pins, not a loop over rows."""
    ids = list(dict.fromkeys(i for i, _ in pins))
    found = {r[0] for r in docs.where(F.col(id_col).isin(ids)).select(id_col).distinct().collect()} if ids else set()
    rest = hide(hits.where(~F.col(id_col).isin(ids)) if ids else hits, [h for h in hidden if h not in found], id_col)
    slots = pin_slots([(i, t) for i, t in pins if i in found], rest.count())
    slot = (F.row_number().over(Window.orderBy(*keys, F.col(id_col))) - 1).cast("long")
    natural = rest.orderBy(*keys, F.col(id_col)).limit(limit).select(id_col, slot.alias("slot"))
    for _, s in sorted(slots, key=lambda x: x[1]):
        natural = natural.withColumn("slot", F.when(F.col("slot") >= s, F.col("slot") + 1).otherwise(F.col("slot")))
    natural = natural.where(F.col("slot") < limit)
    slots = [(i, x) for i, x in slots if x < limit]
    if not slots:
        return natural.withColumn("pinned", F.lit(False))
    kind = hits.schema[id_col].dataType.simpleString()
    pinned = hits.sparkSession.createDataFrame(slots, f"{id_col} {kind}, slot long")
    return natural.withColumn("pinned", F.lit(False)).unionByName(pinned.withColumn("pinned", F.lit(True)))


def ranking_info(hits: DataFrame, custom: Sequence[str] = ()) -> list[Column]:
    """Sort keys of the ranking criteria that are columns of hits: typos, geo, words, filters, proximity, attribute, exact, custom."""
    have = set(hits.columns)
    order = [("typos", True), ("geo", True), ("words", False), ("filters", False), ("proximity", True), ("attribute", True), (
        "exact", False)]
    return [F.col(c).asc() if up else F.col(c).desc() for c, up in order if c in have] + order_keys(custom)


def stop_if_enough(rows: DataFrame, enough: int) -> DataFrame:
    """query_id and nb_hits of the queries of a batch, up to the one with which `enough` hits are reached."""
    n = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("nb_hits"))
    before = F.coalesce(F.sum("nb_hits").over(Window.orderBy("query_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return n.withColumn("before", before).where(F.col("before") < enough).drop("before")
