"""What the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import materialize

#: Rows that a worker turns into Python objects at a time.
SLICE = 256


def held_out(key: Column, folds: int, remainder: int) -> Column:
    """True where crc32 of the key's decimal text leaves ``remainder``; a null key is never held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == remainder, F.lit(False))


def map_rows(df: DataFrame, make: Callable[[], Callable[[list[list]], list[list]]], schema: str) -> DataFrame:
    """mapInArrow over small slices: ``make()`` runs once a task and returns columns -> columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                out = work([c.to_pylist() for c in part.columns])
                if out and len(out[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, kinds)], schema=kinds)

    return df.mapInArrow(run, schema)


class Memo(dict):
    """A bounded memo: two generations of at most ``most`` keys, so that frequent keys stay."""

    def __init__(self, compute: Callable, most: int = 250_000, longest: int = 64):
        super().__init__()
        self.compute, self.most, self.longest, self.old = compute, most, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def chunks(items, n: int) -> Iterator[list]:
    it = iter(items)
    while part := list(islice(it, n)):
        yield part


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table under names that no column of another table and no parser trips over, and old name -> new name."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def joined_spread(rows: DataFrame, unique: DataFrame, key: str | list[str], by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``unique``, which has one row a key, where a key may hold any share of ``rows``.

    A key's rows are dealt by ``by`` over as many tasks as a shuffle has; ``unique`` meets the distinct
    (key, deal) pairs first, so no task of either join gets more than its share of a key.
    """
    ways = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_way", F.pmod(F.xxhash64(by), F.lit(ways)).cast("int"))
    keys = [key] if isinstance(key, str) else key
    known = dealt.select(*keys, "_way").distinct().join(unique, keys)
    return dealt.join(known, [*keys, "_way"], how).drop("_way")


def keyed(docs: DataFrame, key: str, text: str, carry: list[str] | None = None) -> DataFrame:
    """(k, key, text, carried columns) with a unique long ``k`` in the documents' order: the key itself, if it can be.

    Otherwise rows are numbered by key, null keys first, then by their texts' hashes.
    """
    plain = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), *(carry or []))
    whole = dict(docs.dtypes)[key] in ("bigint", "int", "smallint", "tinyint")
    if whole and plain.groupBy("key").count().filter((F.col("count") > 1) | F.col("key").isNull()).limit(1).count() == 0:
        return plain.select(F.col("key").cast("long").alias("k"), *plain.columns)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text").asc(), F.rand(7).asc()]  # equal rows are spread
    return materialize(plain.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("k"), *plain.columns), "keyed")
