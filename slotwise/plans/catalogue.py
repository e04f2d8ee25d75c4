"""The index engine's queries over the standard tables, and plain SQL for the same rows.

Every query builds its index from the whole table and answers from the index alone; the SQL
states the predicate on the table, independent of any encoding.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.functions import bitset
from slotwise.functions.bitset import BitMap
from slotwise.functions.digits import Basis
from slotwise.operators import zonemap
from slotwise.operators.encoding import Encoding, IndexType
from slotwise.operators.index import BitmapIndex, ColumnReference, coarse, coarse_index, dictionary
from slotwise.operators.predicates import Compare, IntervalFlags, Predicate, between
from slotwise.sources import store
from slotwise.sources.shared import cut, shared_dir

Query = Callable[[SparkSession, str], DataFrame]

_FOUND: dict[str, tuple[Query, str | None]] = {}
#: Documents of one row group of ``events``.
_GROUP = 1000


def _query(name: str, sql: str | None):
    def put(f: Query) -> Query:
        _FOUND[name] = f, sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _group_of(doc: str):
    return F.floor(F.col(doc) / _GROUP).cast("int")


def _docs(table: str, doc: str, columns: list, predicate: Predicate, **how) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        group = _group_of(doc) if table == "events" else None
        return BitmapIndex.over(_table(spark, sf_dir, table), doc, columns, group, **how).find(predicate).docs.select("doc")

    return run


def _set_of(spark: SparkSession, sf_dir: str, predicate: str) -> BitMap:
    return BitMap.of(_table(spark, sf_dir, "documents").where(predicate), "doc_id")


# equality and comparisons, in every encoding

_EVENTS = "SELECT event_id AS doc FROM events WHERE "
for _e in Encoding:
    for _t in IndexType:
        _how = {"encoding": _e, "index_type": _t}
        _name = f"{_e.name}_{_t.name}".lower()
        _query(f"eq_{_name}", _EVENTS + "user_id = 5")(_docs("events", "event_id", ["user_id"], Compare("user_id", "=", 5), **_how))
        _query(f"eq_string_{_name}", "SELECT c_custkey AS doc FROM customer WHERE c_mktsegment = 'BUILDING'")(_docs("customer", "c_custkey", ["c_mktsegment"], Compare("c_mktsegment", "=", "BUILDING"), **_how))
        _query(f"ge_{_name}", _EVENTS + "user_id >= 5")(_docs("events", "event_id", ["user_id"], Compare("user_id", ">=", 5), **_how))
    _how = {"encoding": _e}
    _name = _e.name.lower()
    _query(f"eq_bigint_{_name}", "SELECT o_orderkey AS doc FROM orders WHERE o_custkey = 5")(_docs("orders", "o_orderkey", ["o_custkey"], Compare("o_custkey", "=", 5), **_how))
    for _op, _sign in (("lt", "<"), ("le", "<="), ("gt", ">"), ("ne", "<>")):
        _query(f"{_op}_{_name}", _EVENTS + f"user_id {_sign} 5")(_docs("events", "event_id", ["user_id"], Compare("user_id", _sign, 5), **_how))

for _name, _flags, _low, _high in (("open", IntervalFlags.OPEN, ">", "<"), ("left", IntervalFlags.INCLUDE_LEFT, ">=", "<"), ("right", IntervalFlags.INCLUDE_RIGHT, ">", "<="), ("closed", IntervalFlags.CLOSED, ">=", "<=")):
    _query(f"between_{_name}", f"SELECT p_partkey AS doc FROM part WHERE p_size {_low} 10 AND p_size {_high} 20")(
        _docs("part", "p_partkey", ["p_size"], between("p_size", 10, 20, _flags), encoding=Encoding.INTERVAL)
    )
_query("eq_custom_basis", "SELECT p_partkey AS doc FROM part WHERE p_size = 17")(_docs("part", "p_partkey", ["p_size"], Compare("p_size", "=", 17), encoding=Encoding.INTERVAL, basis=(5, 3, 4)))
_query("eq_absent", _EVENTS + "user_id = -7")(_docs("events", "event_id", ["user_id"], Compare("user_id", "=", -7), encoding=Encoding.INTERVAL))
_query("ge_absent", _EVENTS + "user_id >= 3.5")(_docs("events", "event_id", ["user_id"], Compare("user_id", ">=", 3.5), encoding=Encoding.INTERVAL))

# several columns

_CLICK, _FIVE = Compare("event_type", "=", "click"), Compare("user_id", ">=", 5)
for _name, _predicate, _sql in (
    ("and", _CLICK & _FIVE, "event_type = 'click' AND user_id >= 5"),
    ("or", _CLICK | _FIVE, "event_type = 'click' OR user_id >= 5"),
    ("andnot", _CLICK - _FIVE, "event_type = 'click' AND NOT user_id >= 5"),
    ("xor", _CLICK ^ _FIVE, "(event_type = 'click') <> (user_id >= 5)"),
):
    _query(f"{_name}_two_columns", _EVENTS + _sql)(_docs("events", "event_id", ["event_type", "user_id"], _predicate, encoding=Encoding.INTERVAL))
_query("dotted_path_eq", _EVENTS + "CAST(json_extract_string(props, '$.k') AS BIGINT) = 5")(
    _docs("events", "event_id", [ColumnReference("props.k", "long")], Compare("props.k", "=", 5), encoding=Encoding.RANGE, index_type=IndexType.BITSLICED)
)


@_query("per_rowgroup_counts", "SELECT CAST(event_id // 1000 AS INTEGER) AS rg_id, count(*) AS n FROM events WHERE user_id = 5 GROUP BY 1")
def per_rowgroup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = BitmapIndex.over(_table(spark, sf_dir, "events"), "event_id", ["user_id"], _group_of("event_id"))
    return index.find(Compare("user_id", "=", 5)).per_row_group()


@_query("row_group_eq", _EVENTS + "user_id = 5 AND event_id // 1000 = 0")
def row_group_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = BitmapIndex.over(_table(spark, sf_dir, "events"), "event_id", ["user_id"], _group_of("event_id"), encoding=Encoding.RANGE)
    return index.row_group(0).lookup(5).select("doc")


@_query("coarse_recheck", _EVENTS + "value >= 50.5")
def coarse_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    asked, width = Compare("value", ">=", 50.5), 10.0
    index = coarse_index(events.select(F.col("event_id").alias("doc"), "value"), "value", width, encoding=Encoding.RANGE)
    return index.semi_join(events, "event_id", coarse(asked, width), residual=asked.as_column()).select(F.col("event_id").alias("doc"))


@_query("semi_join_rows", "SELECT event_id, user_id, event_type FROM events WHERE user_id < 5")
def semi_join_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    index = BitmapIndex.over(events, "event_id", ["user_id"], _group_of("event_id"), encoding=Encoding.RANGE)
    return index.semi_join(events, "event_id", Compare("user_id", "<", 5), _group_of("event_id")).select("event_id", "user_id", "event_type")


# dictionary and digits


@_query("dictionary_rank", "SELECT user_id, dense_rank() OVER (ORDER BY user_id) - 1 AS rank FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL)")
def dictionary_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary(_table(spark, sf_dir, "events").select(F.col("user_id").alias("value"))).select(F.col("value").alias("user_id"), "rank")


def _digits(basis: Basis) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        size = F.col("p_size").cast("long")
        digits = [d.cast("long").alias(f"d{i}") for i, d in enumerate(basis.digit_columns(size))]
        return _table(spark, sf_dir, "part").select("p_partkey", *digits, basis.fits(size).alias("fits"))

    return run


_query("decompose_mixed", "SELECT p_partkey, CAST(p_size // 12 % 3 AS BIGINT) AS d0, CAST(p_size // 4 % 3 AS BIGINT) AS d1, CAST(p_size % 4 AS BIGINT) AS d2, p_size < 36 AS fits FROM part")(_digits(Basis([3, 3, 4])))
_query(
    "decompose_base2",
    "SELECT p_partkey, " + ", ".join(f"CAST(p_size // {2 ** (4 - i)} % 2 AS BIGINT) AS d{i}" for i in range(5)) + ", p_size < 32 AS fits FROM part",
)(_digits(Basis([2] * 5)))

# sets

_GERMAN, _SHORT = "lang = 'de'", "n_chars < 2000"
for _name, _how, _sql in (
    ("and", lambda a, b: a & b, f"{_GERMAN} AND {_SHORT}"),
    ("or", lambda a, b: a | b, f"{_GERMAN} OR {_SHORT}"),
    ("andnot", lambda a, b: a - b, f"{_GERMAN} AND NOT {_SHORT}"),
    ("xor", lambda a, b: a ^ b, f"({_GERMAN}) <> ({_SHORT})"),
):
    _query(f"bitmap_{_name}", f"SELECT doc_id AS doc FROM documents WHERE {_sql}")(lambda spark, sf_dir, how=_how: how(_set_of(spark, sf_dir, _GERMAN), _set_of(spark, sf_dir, _SHORT)).docs())

_SET = f"SELECT doc_id AS doc FROM documents WHERE {_GERMAN}"
_query("bitmap_build", "SELECT doc_id // 64 AS w, count(*) AS n FROM documents WHERE lang = 'de' GROUP BY 1")(lambda spark, sf_dir: _set_of(spark, sf_dir, _GERMAN).words.select("w", F.bit_count("bits").cast("long").alias("n")))
_query("bitmap_decode", _SET)(lambda spark, sf_dir: _set_of(spark, sf_dir, _GERMAN).docs())
_query("bitmap_add_range", f"{_SET} UNION SELECT unnest(range(10, 150)) AS doc")(lambda spark, sf_dir: _set_of(spark, sf_dir, _GERMAN).add_range(10, 150).docs())
_query("bitmap_flip", f"(({_SET}) EXCEPT SELECT unnest(range(10, 150))) UNION (SELECT unnest(range(10, 150)) AS doc EXCEPT ({_SET}))")(lambda spark, sf_dir: _set_of(spark, sf_dir, _GERMAN).flip(10, 150).docs())
_query("bitmap_contains", "SELECT doc_id AS doc, coalesce(lang = 'de', false) AS held FROM documents")(
    lambda spark, sf_dir: _set_of(spark, sf_dir, _GERMAN).holds(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc")), "doc")
)
_query("bitmap_add", f"{_SET} UNION SELECT unnest([3, 5000000]) AS doc")(lambda spark, sf_dir: _set_of(spark, sf_dir, _GERMAN).add(3).add(5_000_000).docs())
_query("bitmap_clear", f"SELECT * FROM ({_SET}) WHERE false")(lambda spark, sf_dir: _set_of(spark, sf_dir, _GERMAN).clear().docs())
_query("bitmap_in_order", f"SELECT doc, row_number() OVER (ORDER BY doc) - 1 AS place FROM ({_SET})")(
    lambda spark, sf_dir: spark.createDataFrame(list(zip(_set_of(spark, sf_dir, _GERMAN), itertools.count())), "doc long, place long")
)


@_query("bitmap_round_trip", _SET)
def bitmap_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{shared_dir(spark)}/bitmap-{uuid.uuid4().hex}"
    _set_of(spark, sf_dir, _GERMAN).write(at)
    return BitMap.read(spark, at).docs()


_query("bitmap_to_array", f"SELECT list(doc ORDER BY doc) AS docs FROM ({_SET})")(lambda spark, sf_dir: _set_of(spark, sf_dir, _GERMAN).as_array())
_query("bitmap_cardinality", f"SELECT count(*) AS cardinality FROM ({_SET})")(lambda spark, sf_dir: _set_of(spark, sf_dir, _GERMAN).statistics().select("cardinality"))
_query("bitmap_is_empty", "SELECT count(*) = 0 AS is_empty FROM documents WHERE lang = 'xx'")(lambda spark, sf_dir: _set_of(spark, sf_dir, "lang = 'xx'").statistics().select("is_empty"))
_query("bitmap_min_max", f"SELECT min(doc) AS minimum, max(doc) AS maximum FROM ({_SET})")(lambda spark, sf_dir: _set_of(spark, sf_dir, _GERMAN).statistics().select("minimum", "maximum"))

# statistics of row groups


def _zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zonemap.zone_map(_table(spark, sf_dir, "events"), "user_id", _group_of("event_id"))


_ZONES = "SELECT CAST(event_id // 1000 AS INTEGER) AS rg_id, min(user_id) AS min_value, max(user_id) AS max_value, CAST(sum(user_id) AS BIGINT) AS sum_value, count(user_id) AS n FROM events GROUP BY 1"
_query("zonemap_stats", _ZONES)(_zones)
_query("zonemap_double", f"SELECT rg_id, CAST(min_value AS DOUBLE) AS min_value, CAST(max_value AS DOUBLE) AS max_value FROM ({_ZONES})")(lambda spark, sf_dir: zonemap.as_double(_zones(spark, sf_dir)))


@_query("zonemap_prune", "SELECT event_id, user_id FROM events WHERE event_id >= 500 AND event_id < 700")
def zonemap_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    zones = cut(zonemap.zone_map(events, "event_id", _group_of("event_id"), "event_id"))
    return zonemap.pruned(events, zones, _group_of("event_id"), between("event_id", 500, 700, IntervalFlags.INCLUDE_LEFT), "event_id").select("event_id", "user_id")


# stored indexes


def _stored(spark: SparkSession, sf_dir: str, *columns: str) -> str:
    root = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    builder, events = store.Builder(root), _table(spark, sf_dir, "events")
    for column in columns:
        builder.add_index(events.select(_group_of("event_id").alias("rg_id"), F.col("event_id").alias("doc"), F.col(column).alias("value")), column, Encoding.INTERVAL)
    builder.save_all()
    return root


@_query("index_round_trip", _EVENTS + "user_id = 5 AND event_type = 'click'")
def index_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.load(spark, _stored(spark, sf_dir, "user_id", "event_type")).find(Compare("user_id", "=", 5) & _CLICK).docs.select("doc")


@_query("stored_ge", _EVENTS + "user_id >= 5")
def stored_ge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.load(spark, _stored(spark, sf_dir, "user_id")).find(_FIVE).docs.select("doc")


@_query("get_index_ge", _EVENTS + "user_id >= 5 AND event_id // 1000 = 0")
def get_index_ge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.get_index(spark, _stored(spark, sf_dir, "user_id", "event_type"), 0, "user_id").find(_FIVE).docs.select("doc")


@_query("slot_round_trip", _EVENTS + "event_type = 'click'")
def slot_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    store.save(BitmapIndex.over(_table(spark, sf_dir, "events"), "event_id", ["event_type"], _group_of("event_id")), root)
    index = store.load(spark, root)
    rank = index.dictionaries["event_type"].where("value = 'click'").first()["rank"]
    return bitset.unpack(index.slot("event_type", 0, rank)).select("doc")


@_query("eq_multi_value", "SELECT DISTINCT l_orderkey AS doc FROM lineitem WHERE l_partkey = 17")
def eq_multi_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return BitmapIndex.over(_table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_partkey"], several=True).lookup(17).select("doc")


@_query("existence_set", _EVENTS + "user_id IS NOT NULL")
def existence_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return BitmapIndex.over(_table(spark, sf_dir, "events"), "event_id", ["user_id"], _group_of("event_id")).existence("user_id").select("doc")


_WORDS = "count(DISTINCT (event_id // 1000, event_id // 64{}))"
_STATS = "SELECT 'event_type' AS column_path, CAST({} AS INTEGER) AS component, {} AS slots, {} AS words, count(*) AS documents, {} * 16 AS bytes FROM events WHERE event_type IS NOT NULL"


@_query(
    "index_stats",
    _STATS.format(0, "count(DISTINCT event_type)", *[_WORDS.format(", event_type")] * 2) + " UNION ALL " + _STATS.format(-1, "CAST(1 AS BIGINT)", *[_WORDS.format("")] * 2),
)
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return BitmapIndex.over(_table(spark, sf_dir, "events"), "event_id", ["event_type"], _group_of("event_id")).statistics()


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items() if sql}
