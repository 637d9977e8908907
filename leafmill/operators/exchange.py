"""Request and response tables: cache probes, numbered matches, fallbacks, fan-in and precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cache_hits(work: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Work whose key is cached, with the cached columns."""
    return work.join(cache, key)


def cache_misses(work: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Work whose key isn't cached: probe before anything costly is computed for it."""
    return work.join(cache.select(key), key, "left_anti")


def last_write(df: DataFrame, keys: list[str], order: list[Column | str], value: list[str]) -> DataFrame:
    """The last row of each key: one partial aggregate, no window."""
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*value), rank).alias("__v")).select(*keys, "__v.*")


def upsert(cache: DataFrame, new: DataFrame, keys: list[str], value: list[str]) -> DataFrame:
    """cache with the rows of new put over it."""
    both = cache.select(*keys, *value, F.lit(0).alias("__prio")).unionByName(new.select(*keys, *value, F.lit(1).alias("__prio")))
    return last_write(both, keys, ["__prio"], value)


def most_recent(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The n rows an LRU cache of that capacity keeps: a distributed top-n."""
    return df.orderBy(*order).limit(n)


def numbered_match(requests: DataFrame, responses: DataFrame, keys: list[str]) -> DataFrame:
    """Responses for the numbers of requests; repeated numbers repeat rows, unknown ones are dropped."""
    return requests.join(responses, keys)


def unmatched(requests: DataFrame, responses: DataFrame, keys: list[str]) -> DataFrame:
    return requests.join(responses.select(*keys), keys, "left_anti")


def zipped(left: DataFrame, right: DataFrame, place: str) -> DataFrame:
    """Rows of equal places; the longer side is cut off."""
    return left.join(right, place)


def with_fallback(rows: DataFrame, found: DataFrame, keys: list[str], value: str, default: Column) -> DataFrame:
    """The found value of each row, else the default."""
    return rows.join(found, keys, "left").withColumn(value, F.coalesce(F.col(value), default))


def fan_in(pages: DataFrame, rows: DataFrame, key: str, order: list[str], item: Column, name: str = "items") -> DataFrame:
    """An ordered list of each page's items; pages without rows have an empty list, rows without a page go."""
    entry = F.struct(*[F.col(o) for o in order], item.alias("__item"))
    lists = rows.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("__l"))
    out = pages.join(lists, key, "left")
    return out.withColumn(name, F.coalesce(F.transform("__l", lambda x: x["__item"]), F.array().cast(f"array<{dict(rows.select(item.alias('i')).dtypes)['i']}>"))).drop("__l")


def joined_text(rows: DataFrame, keys: list[str], order: list[str], text: str, sep: str = "\n") -> DataFrame:
    """Texts of each key that aren't blank, in order, joined."""
    entry = F.struct(*order, F.col(text).alias("__t"))
    lists = rows.filter(F.regexp_replace(text, r"(?U)^\s+|\s+$", "") != "").groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("__l"))
    return lists.select(*keys, F.array_join(F.transform("__l", lambda x: x["__t"]), sep).alias("joined"))


def ring(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The last n samples."""
    return df.orderBy(*order).limit(n)


def top_of_each(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", rank).filter(F.col("__n") <= n).drop("__n")
