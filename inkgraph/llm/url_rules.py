"""URL filter rules by a sort-merge range join.

A host is turned into a canonical key: its labels in reverse, each ended by a dot
(``www.example.net`` -> ``net.example.www.``).  A rule's host is then a prefix, so the hosts
it fits are one interval of the key order, and the intervals of two rules are nested or
apart.  Rules and URLs are dealt out by key range and sorted together; a sweep keeps the
stack of rules whose interval is open, each with its path, and takes the longest that fits.

Range bounds come from the rows with the smallest row hashes: about ``BOUND_ROWS`` of them, an
even sample of the whole table whatever its size, used for balance alone.  A bound is a key and a row hash, so one host may fill many
ranges; a rule is copied to each range that its interval meets, no URL is copied.

Defined cases: a null URL, or one without ``://``, has an empty host and path and fits no
rule; of two rules of one length on the same host and path, block wins; of equally long rules
with different hosts, the longer host wins; repeated URLs are judged alike; an empty table
gives an empty result, an empty rule list the default verdict; ids are of any type and carried
along, null ids too; very long URLs are compared whole; other columns are not read, whatever
their names.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import IntegerType, StringType

from .text import ascii_lower, pick

BOUND_ROWS = 4096


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


@arrow_udf(StringType())
def _key(host: pa.Array) -> pa.Array:
    return pa.array([host_key(x) for x in host.to_pylist()], pa.string())


def _after(prefix: str) -> str:
    """The first key past all keys that start with ``prefix``, which ends in a dot."""
    return prefix[:-1] + chr(ord(".") + 1)


def _sweep(default: str):
    def run(batches):
        place, stack = None, []
        for batch in batches:
            rules_of, verdicts, is_url = [], [], batch.column("is_url")
            columns = (batch.column(c).to_pylist() for c in ("bucket", "key", "is_url", "path", "rule", "verdict"))
            for bucket, key, url, path, rule, verdict in zip(*columns, strict=True):
                if bucket != place:
                    place, stack = bucket, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if not url:
                    stack.append((key, path, rule, verdict))
                    continue
                best = None
                for prefix, start, name, says in stack:
                    if path.startswith(start):
                        rank = (len(name), len(prefix), says == "block")
                        if best is None or rank > best[0]:
                            best = rank, name, says
                rules_of.append(best[1] if best else None)
                verdicts.append(best[2] if best else default)
            yield pa.RecordBatch.from_arrays([batch.column("row").filter(is_url), pa.array(rules_of, pa.string()), pa.array(verdicts, pa.string())], ["row", "rule", "verdict"])

    return run


def filter_urls(df: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``rules``: (verdict, host, path).  One row for each input row: id, url, host, path, rule, verdict."""
    spark = df.sparkSession
    url = pick(df, url_col)
    rows = df.select(pick(df, id_col).alias("id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("key", _key("host")).withColumn("salt", F.xxhash64("id", "url"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = BOUND_ROWS / max(1, df.select(pick(df, id_col)).count())
    sample = rows.select("key", "salt").where(F.xxhash64("salt") / 2.0**64 + 0.5 < share).limit(2 * BOUND_ROWS)
    seen = sorted((r.key.encode(), r.salt) for r in sample.collect())
    n = min(len(seen), 4 * parts)
    bounds = [seen[i * len(seen) // n] for i in range(1, n)] if n else []

    @arrow_udf(IntegerType())
    def bucket_of(key: pa.Array, salt: pa.Array) -> pa.Array:
        return pa.array([bisect_right(bounds, (k.encode(), s)) for k, s in zip(key.to_pylist(), salt.to_pylist(), strict=True)], pa.int32())

    least = -(2**63)
    told = [
        (b, host_key(host), False, None, path, host + path, verdict)
        for verdict, host, path in rules
        for b in range(bisect_right(bounds, (host_key(host).encode(), least)), bisect_right(bounds, (_after(host_key(host)).encode(), least)) + 1)
    ]
    row = f"row struct<id:{rows.schema['id'].dataType.simpleString()},url:string,host:string,path:string>"
    schema = f"bucket int, key string, is_url boolean, {row}, path string, rule string, verdict string"
    urls = rows.select(bucket_of("key", "salt").alias("bucket"), "key", F.lit(True).alias("is_url"), F.struct("id", "url", "host", "path").alias("row"), "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    both = urls.unionByName(spark.createDataFrame(told, schema)) if told else urls
    swept = both.repartition(parts, "bucket").sortWithinPartitions("bucket", "key", "is_url", F.length("rule")).mapInArrow(_sweep(default), f"{row}, rule string, verdict string")
    return swept.select(F.col("row.id").alias(id_col), F.col("row.url").alias(url_col), F.col("row.host").alias("host"), F.col("row.path").alias("path"), "rule", "verdict")
