"""The queries and SQL of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import html_text, media, minhash, mixing, packing, quality, rules, sharding, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix": mixing.op1_mix,
        "op2_media": media.op2_media,
        "op3_html": html_text.op3_html,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_quality": quality.op5_quality,
        "op6_minhash": minhash.op6_minhash,
        "op7_warc": warc.op7_warc,
        "op8_packing": packing.op8_packing,
        "op9_shard": sharding.op9_shard,
        "op10_rules": rules.op10_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_minhash": minhash.OP6_SQL, "op7_warc": warc.OP7_SQL, "op10_rules": rules.OP10_SQL}
