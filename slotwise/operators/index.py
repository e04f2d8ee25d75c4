"""Bitmap indexes over columns: build, look up, find, and join back."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from enum import Enum
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions import bitset
from slotwise.functions.digits import Basis
from slotwise.functions.ranking import ranked_and_counted
from slotwise.operators import encoding as enc
from slotwise.operators.encoding import Coded, Encoding, IndexType
from slotwise.operators.predicates import Both, Compare, Not, Predicate, comparisons
from slotwise.sources.shared import cut

#: Base of the digits that a bitmap index falls back to above so many distinct values, since
#: range and interval slots of one large component hold a document many times.
WIDEST, DIGIT = 256, 16


class IndexAccuracy(Enum):
    NONE = 0
    COARSE = 1
    EXACT = 2


@dataclass
class IndexResult:
    """Documents (rg_id, doc) that satisfy a predicate: exactly, or with false positives."""

    accuracy: IndexAccuracy
    docs: DataFrame | None
    words: DataFrame | None = None

    def values(self, rg_id: int | None = None) -> list[int]:
        """The ids in ascending order, on the driver."""
        docs = self.docs if rg_id is None else self.docs.where(F.col("rg_id") == rg_id)
        return [r["doc"] for r in docs.orderBy("doc").select("doc").collect()]

    def per_row_group(self) -> DataFrame:
        """(rg_id, n)"""
        return self.words.where("bits <> 0").groupBy("rg_id").agg(F.sum(F.bit_count("bits").cast("long")).alias("n"))


@dataclass(frozen=True)
class ColumnReference:
    """A column of a document collection by its dotted path: a struct field, or a field of a
    column of JSON text (``kind`` then says what its values are)."""

    dotted_path: str
    kind: str | None = None

    def value(self, df: DataFrame) -> Column:
        first, *rest = self.dotted_path.split(".")
        if self.dotted_path in df.columns:
            found = F.col(f"`{self.dotted_path}`")
        elif rest and dict(df.dtypes).get(first) == "string":
            found = F.get_json_object(F.col(first), "$." + ".".join(rest))
        else:
            found = F.col(self.dotted_path)
        return found.cast(self.kind) if self.kind else found


@dataclass
class ColumnEntry:
    """What the catalogue holds of an indexed column."""

    column_path: str
    value_type: str
    encoding: Encoding
    index_type: IndexType
    basis: Basis
    cardinality: int
    accuracy: IndexAccuracy = IndexAccuracy.EXACT

    @property
    def coded(self) -> Coded:
        return Coded(self.column_path, self.encoding, self.basis)


def default_basis(index_type: IndexType, cardinality: int) -> Basis:
    if index_type is IndexType.BITSLICED:
        return Basis.binary(cardinality)
    if cardinality <= WIDEST:
        return Basis([max(1, cardinality)])
    digits = 1
    while DIGIT**digits < cardinality:
        digits += 1
    return Basis([DIGIT] * digits)


def dictionary(values: DataFrame) -> DataFrame:
    """(value, rank): the distinct non-null values, ranked densely from 0 in their order."""
    return _ranks(values)[0]


def _ranks(values: DataFrame) -> tuple[DataFrame, int]:
    return ranked_and_counted(values.select("value").where("value IS NOT NULL").distinct(), ["value"])


class BitmapIndex:
    """Indexes of one or more columns of the same documents.

    ``rows`` is (column_path, rg_id, component, slot, w, bits); ``dictionaries`` has the table
    (value, rank) of each column; ``entries`` the catalogue entry of each.
    """

    def __init__(self, rows: DataFrame, dictionaries: dict[str, DataFrame], entries: dict[str, ColumnEntry]):
        self.rows, self.dictionaries, self.entries = rows, dictionaries, entries

    # building

    @classmethod
    def build(
        cls,
        values: DataFrame,
        column_path: str = "value",
        encoding: Encoding = Encoding.EQUALITY,
        index_type: IndexType = IndexType.BITMAP,
        basis: Sequence[int] | None = None,
        accuracy: IndexAccuracy = IndexAccuracy.EXACT,
        several: bool = False,
    ) -> BitmapIndex:
        """An index of ``values`` (doc, value, and rg_id unless there is one row group).

        Ids become 64-bit words before anything is joined: a hot value is combined where it
        is read, and the dictionary joins words, not documents. Null values are in no bitmap.
        A document of several values is an error, unless ``several``: then the encoding must
        be equality in one component, whatever the number of values, where a document may be
        in several slots.
        """
        if "rg_id" not in values.columns:
            values = values.withColumn("rg_id", F.lit(0))
        kept = values.where("value IS NOT NULL").select(F.col("rg_id").cast("int").alias("rg_id"), "doc", "value")
        return cls.of_words(bitset.pack(kept, "doc", ["rg_id", "value"]), column_path, encoding, index_type, basis, accuracy, several)

    @classmethod
    def of_words(
        cls,
        words: DataFrame,
        column_path: str = "value",
        encoding: Encoding = Encoding.EQUALITY,
        index_type: IndexType = IndexType.BITMAP,
        basis: Sequence[int] | None = None,
        accuracy: IndexAccuracy = IndexAccuracy.EXACT,
        several: bool = False,
    ) -> BitmapIndex:
        """As ``build``, of ids already packed: (rg_id, value, w, bits), one row for each value
        and word."""
        words = cut(words.select("rg_id", "value", "w", "bits"))
        ranks, cardinality = _ranks(words)
        if several:
            if encoding is not Encoding.EQUALITY or index_type is not IndexType.BITMAP or (basis is not None and len(basis) > 1):
                raise ValueError("only the equality encoding of one component holds several values of a document")
            chosen = Basis(basis or [max(1, cardinality)])
        else:
            chosen = Basis(basis) if basis is not None else default_basis(index_type, cardinality)
            sizes = words.groupBy("rg_id", "w").agg(F.sum(F.bit_count("bits")).alias("n"), F.bit_or("bits").alias("bits"))
            if not sizes.where(F.col("n") > F.bit_count("bits")).isEmpty():
                raise ValueError("a document has several values; index it with several=True")
        if chosen.product < cardinality:
            raise ValueError(f"{cardinality} values don't fit the basis {chosen.bases}")
        entry = ColumnEntry(column_path, dict(words.dtypes)["value"], encoding, index_type, chosen, cardinality, accuracy)
        digits = F.array(*(F.struct(F.lit(i).alias("component"), enc.slots_of(encoding, chosen.base(i), d).alias("slots")) for i, d in enumerate(chosen.digit_columns(F.col("rank")))))
        placed = words.join(ranks, "value").select("rg_id", "w", "bits", F.explode(digits).alias("d"))
        placed = placed.select("rg_id", F.col("d.component").alias("component"), F.explode("d.slots").alias("slot"), "w", "bits")
        slots = placed.union(words.select("rg_id", F.lit(-1), F.lit(-1), "w", "bits"))
        rows = slots.groupBy("rg_id", "component", "slot", "w").agg(F.bit_or("bits").alias("bits"))
        rows = rows.select(F.lit(column_path).alias("column_path"), "rg_id", "component", F.col("slot").cast("long").alias("slot"), "w", "bits")
        return cls(rows, {column_path: ranks}, {column_path: entry})

    @classmethod
    def over(cls, df: DataFrame, doc: str, columns: Sequence[str | ColumnReference], rg_id: Column | None = None, **how) -> BitmapIndex:
        """Indexes of ``columns`` of ``df``, whose ids are in the column ``doc``."""
        group = F.lit(0) if rg_id is None else rg_id
        refs = [ColumnReference(c) if isinstance(c, str) else c for c in columns]
        return reduce(cls.plus, (cls.build(df.select(group.cast("int").alias("rg_id"), F.col(doc).alias("doc"), r.value(df).alias("value")), r.dotted_path, **how) for r in refs))

    def plus(self, other: BitmapIndex) -> BitmapIndex:
        return BitmapIndex(self.rows.union(other.rows), self.dictionaries | other.dictionaries, self.entries | other.entries)

    def persisted(self) -> BitmapIndex:
        self.rows.persist()
        return self

    # answering

    def _rank_bounds(self, column: str, literals: list[Any]) -> list[tuple[int, int]]:
        """For each literal, the greatest ranks below it and up to it (-1 for none)."""
        ask = []
        for i, v in enumerate(literals):
            for name, hit in (("lt", F.col("value") < F.lit(v)), ("le", F.col("value") <= F.lit(v))):
                ask.append(F.coalesce(F.max(F.when(hit, F.col("rank"))), F.lit(-1)).alias(f"{name}{i}"))
        found = self.dictionaries[column].agg(*ask).first()
        return [(found[f"lt{i}"], found[f"le{i}"]) for i in range(len(literals))]

    def _formula(self, predicate: Predicate):
        """The slots where ``predicate`` is true."""
        asked: dict[str, list[Any]] = {}
        for c in comparisons(predicate):
            if c.column not in self.entries:
                raise KeyError(f"{c.column} has no index")
            if c.value is not None and c.value not in asked.setdefault(c.column, []):
                asked[c.column].append(c.value)
        bounds = {(c, _key(v)): b for c, vs in asked.items() for v, b in zip(vs, self._rank_bounds(c, vs))}

        def sets(p: Predicate):
            """Where p is true, and where it is false."""
            if isinstance(p, Not):
                return sets(p.of)[::-1]
            if isinstance(p, Both):
                (t1, f1), (t2, f2) = sets(p.left), sets(p.right)
                if p.op == "and":
                    return enc.both(t1, t2), enc.either(f1, f2)
                if p.op == "or":
                    return enc.either(t1, t2), enc.both(f1, f2)
                return enc.either(enc.both(t1, f2), enc.both(f1, t2)), enc.either(enc.both(t1, t2), enc.both(f1, f2))
            if p.value is None:
                return enc.NONE, enc.NONE
            coded = self.entries[p.column].coded
            below, up_to = bounds[p.column, _key(p.value)]
            every = coded.existence
            equal = coded.equals(up_to) if up_to > below else enc.NONE
            less, at_most = coded.at_most(below), coded.at_most(up_to)
            true = {"=": equal, "<>": enc.less(every, equal), "<": less, "<=": at_most, ">": enc.less(every, at_most), ">=": enc.less(every, less)}[p.op]
            false = {"=": enc.less(every, equal), "<>": equal, "<": enc.less(every, less), "<=": enc.less(every, at_most), ">": at_most, ">=": less}[p.op]
            return true, false

        return sets(predicate)[0]

    def words(self, predicate: Predicate) -> DataFrame:
        """(rg_id, w, bits) of the documents that satisfy ``predicate``.

        Only the slots that the formula names are read. A formula of one slot is a projection;
        any other, over any number of columns, is one aggregate and one bitwise expression.
        """
        formula = self._formula(predicate)
        if formula == enc.NONE:
            return self.rows.where(F.lit(False)).select("rg_id", "w", "bits")
        named = _slots(formula)
        hit = reduce(lambda a, b: a | b, map(_holds, named))
        rows = self.rows.where(hit)
        if isinstance(formula, enc.Slots) and formula.lo == formula.hi:
            return rows.select("rg_id", "w", "bits")
        zero = F.lit(0).cast("long")
        parts = [F.coalesce(F.bit_or(F.when(_holds(s), F.col("bits"))), zero).alias(f"s{i}") for i, s in enumerate(named)]
        at = {s: F.col(f"s{i}") for i, s in enumerate(named)}
        return rows.groupBy("rg_id", "w").agg(*parts).select("rg_id", "w", _bits(formula, at).alias("bits")).where("bits <> 0")

    def find(self, predicate: Predicate) -> IndexResult:
        """Candidates of ``predicate``; accuracy NONE and no documents if a column isn't indexed."""
        used = {c.column for c in comparisons(predicate)}
        if not used <= set(self.entries):
            return IndexResult(IndexAccuracy.NONE, None)
        accuracy = min((self.entries[c].accuracy for c in used), key=lambda a: a.value)
        words = self.words(predicate)
        return IndexResult(accuracy, bitset.unpack(words, ["rg_id"]), words)

    def lookup(self, value: Any, column: str | None = None) -> DataFrame:
        """(rg_id, doc) whose value equals ``value``."""
        return self.find(Compare(column or next(iter(self.entries)), "=", value)).docs

    def bitmap(self, predicate: Predicate, rg_id: int = 0) -> bitset.BitMap:
        """Of one row group, as a set to go on with."""
        return bitset.BitMap(self.words(predicate).where(F.col("rg_id") == rg_id))

    def semi_join(self, df: DataFrame, doc: str, predicate: Predicate, rg_id: Column | None = None, residual: Column | None = None) -> DataFrame:
        """The rows of ``df`` that satisfy ``predicate``.

        By accuracy: EXACT, those whose ids are found; COARSE, of those, the rows that
        satisfy ``residual`` (the predicate itself by default); NONE, a plain filter. Rows
        meet words, one for up to 64 ids, and test a bit.
        """
        found = self.find(predicate)
        check = predicate.as_column() if residual is None else residual
        if found.accuracy is IndexAccuracy.NONE:
            return df.where(check)
        group = F.lit(0) if rg_id is None else rg_id
        words = found.words.select(F.col("rg_id").alias("_rg"), F.col("w").alias("_w"), F.col("bits").alias("_bits"))
        own = F.col(doc).cast("long")
        held = F.bit_get("_bits", own.bitwiseAND(63).cast("int")) == 1
        kept = df.join(words, (bitset.word(own) == F.col("_w")) & (group.cast("int") == F.col("_rg")) & held, "left_semi")
        return kept.where(check) if found.accuracy is IndexAccuracy.COARSE else kept

    # parts

    def row_group(self, rg_id: int) -> BitmapIndex:
        return BitmapIndex(self.rows.where(F.col("rg_id") == rg_id), self.dictionaries, self.entries)

    def slot(self, column: str, component: int, slot: int) -> DataFrame:
        """(rg_id, w, bits) of one stored bitmap."""
        return self.rows.where((F.col("column_path") == column) & (F.col("component") == component) & (F.col("slot") == slot)).select("rg_id", "w", "bits")

    def existence(self, column: str) -> DataFrame:
        """(rg_id, doc) of the documents that have a value."""
        return bitset.unpack(self.slot(column, -1, -1), ["rg_id"])

    def statistics(self) -> DataFrame:
        """(column_path, component, slots, words, documents, bytes): how large the index is."""
        return self.rows.groupBy("column_path", "component").agg(
            F.countDistinct("slot").alias("slots"),
            F.count(F.lit(1)).alias("words"),
            F.sum(F.bit_count("bits").cast("long")).alias("documents"),
            (F.count(F.lit(1)) * 16).alias("bytes"),
        )


def coarse_index(values: DataFrame, column_path: str, width: float, **how) -> BitmapIndex:
    """An index of ``values`` by bins of ``width``: few slots for a column of many values. A
    comparison is to be widened to whole bins (see ``coarse``), and its answer rechecked."""
    binned = values.withColumn("value", F.floor(F.col("value") / F.lit(width)).cast("long"))
    return BitmapIndex.build(binned, column_path, accuracy=IndexAccuracy.COARSE, **how)


def coarse(predicate: Predicate, width: float) -> Predicate:
    """``predicate`` over bins, true wherever it may be true of a value in the bin. Negations
    and differences can't be widened so."""
    if isinstance(predicate, Both) and predicate.op in ("and", "or"):
        return Both(predicate.op, coarse(predicate.left, width), coarse(predicate.right, width))
    if isinstance(predicate, Compare) and predicate.op != "<>":
        wider = {"<": "<=", ">": ">="}.get(predicate.op, predicate.op)
        return Compare(predicate.column, wider, None if predicate.value is None else int(predicate.value // width))
    raise ValueError(f"no coarse form: {predicate}")


def _key(value: Any) -> tuple:
    return type(value), value


def _slots(formula) -> list[enc.Slots]:
    if isinstance(formula, enc.Slots):
        return [formula]
    if isinstance(formula, enc.Nothing):
        return []
    return list(dict.fromkeys(_slots(formula.left) + _slots(formula.right)))


def _holds(s: enc.Slots) -> Column:
    at = F.col("slot") == s.lo if s.lo == s.hi else F.col("slot").between(s.lo, s.hi)
    return (F.col("column_path") == s.column) & (F.col("component") == s.component) & at


def _bits(formula, at: dict[enc.Slots, Column]) -> Column:
    if isinstance(formula, enc.Slots):
        return at[formula]
    a, b = _bits(formula.left, at), _bits(formula.right, at)
    if formula.name == "and":
        return a.bitwiseAND(b)
    if formula.name == "or":
        return a.bitwiseOR(b)
    return a.bitwiseXOR(b) if formula.name == "xor" else a.bitwiseAND(F.bitwise_not(b))
