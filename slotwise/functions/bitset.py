"""Sets of document ids as relations of 64-bit words.

A set is a table (w, bits): document ``w * 64 + b`` is in it if bit ``b`` of the word ``w`` is
set. A word that is absent is zero. Every operation is a filter, a projection or one grouped
bit aggregate, which Spark combines before its shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Document ids are unsigned 32-bit numbers.
LIMIT = 1 << 32


def word(doc: Column) -> Column:
    return F.shiftright(doc.cast("long"), 6)


def bit(doc: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), doc.cast("long").bitwiseAND(63).cast("int"))


def valid_ids(df: DataFrame, doc: str) -> DataFrame:
    """``df``, which fails when evaluated if an id is no unsigned 32-bit number."""
    wrong = (F.col(doc) < 0) | (F.col(doc) >= LIMIT)
    return df.withColumn(doc, F.when(wrong, F.raise_error(F.lit("a document id is not in 0 .. 2^32 - 1"))).otherwise(F.col(doc).cast("long")))


def pack(df: DataFrame, doc: str, by: Iterable[str] = ()) -> DataFrame:
    """(by..., w, bits) of the ids in the column ``doc``; null ids are none."""
    rows = valid_ids(df.where(F.col(doc).isNotNull()), doc)
    return rows.groupBy(*by, word(F.col(doc)).alias("w")).agg(F.bit_or(bit(F.col(doc))).alias("bits"))


def unpack(words: DataFrame, by: Iterable[str] = (), doc: str = "doc") -> DataFrame:
    """(by..., doc): one row for each id."""
    held = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.bit_get("bits", i) == 1)
    spread = words.where("bits <> 0").select(*by, "w", F.explode(held).alias("b"))
    return spread.select(*by, (F.col("w") * 64 + F.col("b")).alias(doc))


class BitMap:
    """A set of document ids. Operators return new sets; nothing runs until an action."""

    def __init__(self, words: DataFrame):
        self.words = words.select("w", "bits")

    # making

    @classmethod
    def empty(cls, spark: SparkSession) -> BitMap:
        return cls(spark.createDataFrame([], "w long, bits long"))

    @classmethod
    def of(cls, df: DataFrame, doc: str = "doc") -> BitMap:
        return cls(pack(df, doc))

    @classmethod
    def of_values(cls, spark: SparkSession, values: Iterable[int]) -> BitMap:
        return cls.of(spark.createDataFrame([(int(v),) for v in values], "doc long"))

    @classmethod
    def of_range(cls, spark: SparkSession, begin: int, end: int) -> BitMap:
        """The ids from ``begin`` to below ``end``, by word: 64 times fewer rows than ids."""
        if begin >= end:
            return cls.empty(spark)
        if begin < 0 or end > LIMIT:
            raise ValueError("document ids are in 0 .. 2^32 - 1")
        first, last = begin >> 6, (end - 1) >> 6
        signed = lambda m: m - (1 << 64) if m >> 63 else m
        full = (1 << 64) - 1
        low, high = full << (begin & 63) & full, full >> (63 - (end - 1 & 63))
        mask = F.when(F.col("w") == first, F.lit(signed(low))).otherwise(F.lit(-1).cast("long"))
        mask = mask.bitwiseAND(F.when(F.col("w") == last, F.lit(signed(high))).otherwise(F.lit(-1).cast("long")))
        return cls(spark.range(first, last + 1).withColumnRenamed("id", "w").select("w", mask.alias("bits")))

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> BitMap:
        return cls(spark.read.schema("w long, bits long").parquet(path))

    # changing

    def add(self, *values: int) -> BitMap:
        return self | BitMap.of_values(self.words.sparkSession, values)

    def add_range(self, begin: int, end: int) -> BitMap:
        return self | BitMap.of_range(self.words.sparkSession, begin, end)

    def flip(self, begin: int, end: int) -> BitMap:
        """Ids from ``begin`` to below ``end`` are in the result if they aren't here."""
        return self ^ BitMap.of_range(self.words.sparkSession, begin, end)

    def clear(self) -> BitMap:
        return BitMap(self.words.where(F.lit(False)))

    def optimised(self) -> BitMap:
        """One row a word, and none for zero words, in order: what Parquet stores smallest."""
        return BitMap(self.words.groupBy("w").agg(F.bit_or("bits").alias("bits")).where("bits <> 0").orderBy("w"))

    # algebra

    def _with(self, other: BitMap, how) -> BitMap:
        tagged = self.words.select("w", F.col("bits").alias("a"), F.lit(0).cast("long").alias("b")).union(other.words.select("w", F.lit(0).cast("long"), "bits"))
        both = tagged.groupBy("w").agg(F.bit_or("a").alias("a"), F.bit_or("b").alias("b"))
        return BitMap(both.select("w", how(F.col("a"), F.col("b")).alias("bits")).where("bits <> 0"))

    def __and__(self, other: BitMap) -> BitMap:
        return self._with(other, lambda a, b: a.bitwiseAND(b))

    def __or__(self, other: BitMap) -> BitMap:
        return BitMap.union([self, other])

    def __sub__(self, other: BitMap) -> BitMap:
        return self._with(other, lambda a, b: a.bitwiseAND(F.bitwise_not(b)))

    def __xor__(self, other: BitMap) -> BitMap:
        return self._with(other, lambda a, b: a.bitwiseXOR(b))

    @staticmethod
    def union(sets: Iterable[BitMap]) -> BitMap:
        """Of many sets, in one aggregate."""
        first, *rest = (x.words for x in sets)
        for x in rest:
            first = first.union(x)
        return BitMap(first.groupBy("w").agg(F.bit_or("bits").alias("bits")))

    # reading

    def docs(self) -> DataFrame:
        """(doc): one row for each id, in no order."""
        return unpack(self.words)

    def in_order(self) -> DataFrame:
        return self.docs().orderBy("doc")

    def values(self) -> list[int]:
        """The ids in ascending order, on the driver."""
        return [r["doc"] for r in self.in_order().collect()]

    def as_array(self) -> DataFrame:
        """One row: the ids in ascending order, as an array."""
        return self.docs().agg(F.sort_array(F.collect_list("doc")).alias("docs"))

    def contains(self, doc: int) -> bool:
        return not self.words.where((F.col("w") == doc >> 6) & (F.bit_get("bits", F.lit(doc & 63)) == 1)).isEmpty()

    def holds(self, df: DataFrame, doc: str, name: str = "held") -> DataFrame:
        """``df`` with a column that says whether the id in the column ``doc`` is in the set."""
        words = self.words.groupBy("w").agg(F.bit_or("bits").alias("_bits")).withColumnRenamed("w", "_w")
        own = F.col(doc).cast("long")
        held = F.coalesce(F.bit_get("_bits", own.bitwiseAND(63).cast("int")) == 1, F.lit(False))
        return df.join(words, word(own) == F.col("_w"), "left").withColumn(name, held).drop("_w", "_bits")

    def __contains__(self, doc: int) -> bool:
        return self.contains(doc)

    def __iter__(self):
        return (r["doc"] for r in self.in_order().toLocalIterator())

    def statistics(self) -> DataFrame:
        """One row: cardinality, is_empty, least and greatest id (null if empty)."""
        bits = F.col("bits")
        low = F.col("w") * 64 + F.bit_count(bits.bitwiseAND(-bits) - 1)
        high = F.col("w") * 64 + F.length(F.bin(bits)) - 1
        held = self.words.where("bits <> 0").groupBy("w").agg(F.bit_or("bits").alias("bits"))
        lowest_bit = F.when(bits == F.lit(-(1 << 63)), F.col("w") * 64 + 63).otherwise(low)
        return held.agg(
            F.coalesce(F.sum(F.bit_count(bits).cast("long")), F.lit(0).cast("long")).alias("cardinality"),
            (F.count(F.lit(1)) == 0).alias("is_empty"),
            F.min(lowest_bit).alias("minimum"),
            F.max(high).alias("maximum"),
        )

    def cardinality(self) -> int:
        return self.statistics().first()["cardinality"]

    def is_empty(self) -> bool:
        return self.words.where("bits <> 0").isEmpty()

    def minimum(self) -> int | None:
        return self.statistics().first()["minimum"]

    def maximum(self) -> int | None:
        return self.statistics().first()["maximum"]

    # storing

    def write(self, path: str) -> None:
        self.optimised().words.write.mode("overwrite").parquet(path)

    def byte_size(self) -> int:
        """Of its words, uncompressed."""
        return 16 * self.optimised().words.count()

    def show(self, n: int = 20) -> None:
        self.in_order().show(n)
