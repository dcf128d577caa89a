"""Writers: partitioned Parquet for tables, CSV and JSON for exchange, report payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackforge.functions.scalar import script_safe


def write_table(df: DataFrame, path: str, partitions: list[str], order: list[str], mode: str = "overwrite") -> None:
    """Parquet by partitions, sorted within, so that filters on keys and time read little.

    Rows are spread by the partition columns and a few salts, so a large match isn't one task.
    """
    dealt = df.repartition(*[F.col(c) for c in partitions], F.pmod(F.xxhash64(*order), F.lit(8)))
    dealt.sortWithinPartitions(*partitions, *order).write.mode(mode).partitionBy(*partitions).parquet(path)


def write_csv(df: DataFrame, path: str, columns: list[str], mode: str = "overwrite") -> None:
    """CSV with a header; null cells are empty, missing columns too."""
    present = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]
    df.select(*present).write.mode(mode).option("header", True).option("emptyValue", "").csv(path)


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Columns rounded for export; nothing is rounded before."""
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def all_actions(passes: DataFrame, shots: DataFrame, corners: DataFrame, entries: DataFrame) -> DataFrame:
    """The four kinds as one table in this order; attributes that a kind lacks are null."""
    parts = [d.withColumn("type", F.lit(n)).withColumn("_o", F.lit(i)) for i, (n, d) in enumerate((("pass", passes), ("shot", shots), ("corner", corners), ("box_entry", entries)))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def nested(df: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """A tidy table as one JSON object for each key: name to value, in order of names."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, value))))
    return df.groupBy(*keys).agg(F.to_json(pairs).alias("json"))


def payload(df: DataFrame) -> Column:
    """All columns of df as JSON that can stand in a script element."""
    return script_safe(F.to_json(F.struct(*df.columns)))


#: Where the payload goes, and what a report must hold.
PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title></head><body><div id="report"></div><script type="application/json" id="match-data">{data}</script></body></html>"""


def report_page(title: str, data: str) -> str:
    return PAGE.format(title=title, data=data)
