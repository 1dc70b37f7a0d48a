"""Ragged columns: one array of values and long offsets a row, of one level (lists) or two (lists of steps of lists).

Rows stay rows: a batch's sequences are one struct, so that whole batches are concatenated, sliced and taken apart by array
functions, without an exchange.  Offsets are longs and checked: they start at 0, never fall and end at the number of values.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frame import ROW, with_row_id


def ragged(lists: Column) -> Column:
    """Struct of values and offsets of an array of arrays; a null inner array is empty."""
    filled = F.transform(lists, lambda x: F.coalesce(x, F.array()))
    sizes = F.transform(filled, lambda x: F.size(x).cast("long"))
    return F.struct(F.flatten(filled).alias("values"), _ends(sizes).alias("offsets"))


def _ends(sizes: Column) -> Column:
    """Running sums of sizes from 0, in one fold over pairs of the last sum and all of them."""
    return F.aggregate(sizes, F.array(F.lit(0).cast("long")), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))


def checked(x: Column) -> Column:
    """The ragged struct, or an error where its offsets are none."""
    o = x["offsets"]
    falls = F.exists(F.zip_with(F.slice(o, 2, F.greatest(F.size(o) - 1, F.lit(0))), F.slice(o, 1, F.greatest(F.size(o) - 1, F.lit(0))), lambda b, a: b - a), lambda d: d < 0)
    fine = (F.size(o) > 0) & (F.get(o, F.lit(0)) == 0) & (F.element_at(o, -1) == F.size(x["values"])) & ~falls
    return F.when(x.isNull() | fine, x).otherwise(F.raise_error(F.lit("offsets do not fit the values")))


def rows_of(x: Column) -> Column:
    """The arrays again."""
    pairs = F.zip_with(F.slice(x["offsets"], 1, F.size(x["offsets"]) - 1), F.slice(x["offsets"], 2, F.size(x["offsets"]) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.transform(pairs, lambda p: F.slice(x["values"], p["a"].cast("int") + 1, (p["b"] - p["a"]).cast("int")))


def sliced(x: Column, start: int, stop: int) -> Column:
    """Rows start to stop (exclusive) of a ragged struct, within what it has."""
    n = F.size(x["offsets"]) - 1
    lo, hi = F.least(F.lit(start), n), F.greatest(F.least(F.lit(stop), n), F.least(F.lit(start), n))
    first = F.get(x["offsets"], lo)
    values = F.slice(x["values"], first.cast("int") + 1, (F.get(x["offsets"], hi) - first).cast("int"))
    return F.struct(values.alias("values"), F.transform(F.slice(x["offsets"], lo + 1, hi - lo + 1), lambda o: o - first).alias("offsets"))


def concatenated(parts: Sequence[Column]) -> Column:
    """Ragged structs one behind the other, as one; a null one has no rows."""
    def behind(base: Column):
        return lambda o: o + base

    out = None
    for p in parts:
        none = F.struct(F.slice(p["values"], 1, 0).alias("values"), F.array(F.lit(0).cast("long")).alias("offsets"))
        p = F.coalesce(p, none)
        if out is None:
            out = p
            continue
        more = F.transform(F.slice(p["offsets"], 2, F.greatest(F.size(p["offsets"]) - 1, F.lit(0))), behind(F.element_at(out["offsets"], -1)))
        out = F.struct(F.concat(out["values"], F.coalesce(p["values"], F.slice(out["values"], 1, 0))).alias("values"), F.concat(out["offsets"], more).alias("offsets"))
    return out


def gathered(df: DataFrame, by: str, order: str, column: str) -> DataFrame:
    """The ragged structs of each group's rows as one, in ``order``: what one batch was cut into becomes one batch again."""
    g = df.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), F.col(column).alias("_x")))).alias("_l"))
    lists = F.flatten(F.transform("_l", lambda p: rows_of(p["_x"])))
    return g.select(by, ragged(lists).alias(column))


def flatten_trajectories(df: DataFrame, row: str, steps: str, out: str = ROW) -> DataFrame:
    """A row a step: arrays as long as ``steps`` give their step's element, other columns are repeated; numbered through.

    A trajectory without steps gives no row; columns are told by the first level of their arrays' sizes, row by row, so an
    array of another size raises.
    """
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    width = F.size(steps)
    fits = lambda c: F.when(F.size(c) == width, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} has not a value a step")))
    each = df.select("*", F.inline(F.arrays_zip(*[fits(c).alias(f"_{c}") for c in arrays], F.sequence(F.lit(1), width).alias("_step")))) if arrays else df
    kept = [(F.col(f"_{c}") if c in arrays else F.col(c)).alias(c) for c in df.columns]
    return with_row_id(each.filter(width > 0).select(*kept, F.col("_step").cast("int").alias("step")), [row, "step"], out)


# --- batches by schema ---
def is_tensor(kind: T.DataType) -> bool:
    """Numbers, booleans and arrays of them on any level."""
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
    return isinstance(kind, (T.NumericType, T.BooleanType))


def split_batch(df: DataFrame, row: str, scalars: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, dict]:
    """(tensors, others, meta): the columns by their types, each with ``row``, and the one value of each of ``scalars``.

    A scalar that has more than one value raises; nothing but these values comes to the driver.
    """
    rest = [f for f in df.schema.fields if f.name not in (row, *scalars)]
    meta = {}
    if scalars:
        found = df.agg(*[F.min_by(c, F.lit(0)).alias(c) for c in scalars], *[F.count_distinct(F.struct(c)).alias(f"n_{c}") for c in scalars]).first()
        if many := [c for c in scalars if found[f"n_{c}"] > 1]:
            raise ValueError(f"{many} differ between rows")
        meta = {c: found[c] for c in scalars}
    return df.select(row, *[f.name for f in rest if is_tensor(f.dataType)]), df.select(row, *[f.name for f in rest if not is_tensor(f.dataType)]), meta


def joined_batch(tensors: DataFrame, others: DataFrame, meta: dict, row: str) -> DataFrame:
    """The inverse of ``split_batch``; a name on more than one side raises."""
    names = [c for c in tensors.columns if c != row], [c for c in others.columns if c != row], list(meta)
    if twice := {c for i, a in enumerate(names) for b in names[i + 1 :] for c in a if c in b}:
        raise ValueError(f"{sorted(twice)} are on more than one side")
    both = tensors.join(others.withColumnRenamed(row, "_right"), F.col(row) == F.col("_right")).drop("_right")
    return both.withColumns({c: F.lit(v) for c, v in meta.items()})


# --- arrays to masked positions ---
def scattered_to_mask(values: Column, mask: Column, width: int, kind: str = "double", *, strict: bool = True) -> Column:
    """For each position of ``mask`` the next of ``values`` (arrays of ``width`` numbers) where it is one, else zeros.

    A running index of the mask takes the values, over whole Arrow batches.  Where a row has another number of values than
    positions, ``strict`` raises; else missing values are zeros and surplus ones are left out.  A null mask gives null, null
    values are none, a null value is zeros; one of another width raises.
    """
    inner = pa.list_({"double": pa.float64(), "float": pa.float32(), "long": pa.int64(), "int": pa.int32()}[kind])

    @F.arrow_udf(f"array<array<{kind}>>")
    def scatter(values: pa.Array, mask: pa.Array) -> pa.Array:
        flat, sizes = mask.flatten(), np.asarray(mask.value_lengths().fill_null(0), np.int64)
        on = np.asarray(flat.cast(pa.int8()).fill_null(0)) != 0
        row = np.repeat(np.arange(len(mask)), sizes)
        count = np.bincount(row[on], minlength=len(mask))
        have = np.asarray(values.value_lengths().fill_null(0), np.int64)
        if strict and (have != count)[np.asarray(mask.is_valid())].any():
            raise ValueError("a row has not as many values as its mask has positions")
        items = values.flatten().cast(inner)
        lengths = np.asarray(items.value_lengths().fill_null(width))
        if (lengths != width).any():
            raise ValueError(f"a value has not {width} numbers")
        rank = np.cumsum(on) - 1 - (np.cumsum(count) - count)[row]
        at = np.where(on & (rank < have[row]), (np.cumsum(have) - have)[row] + rank, -1)
        data = np.zeros((len(items) + 1, width), inner.value_type.to_pandas_dtype())  # the last are the zeros
        data[:-1][np.asarray(items.is_valid())] = np.asarray(items.flatten().fill_null(0)).reshape(-1, width)
        taken = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * width, pa.int32()), pa.array(data[at].ravel(), inner.value_type))
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), taken, mask=pa.array(~np.asarray(mask.is_valid())))

    return scatter(values, mask)


# --- queries ---
def _orders_lists(spark, sf_dir) -> DataFrame:
    """The parts of every order, as lists by its line numbers."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("l"))


def u23_ragged(spark, sf_dir):
    """Sixteen orders' lists as a batch, cut into slices of five and gathered again; values and offsets of the whole."""
    g = _orders_lists(spark, sf_dir).select(F.expr("l_orderkey div 64").alias("batch"), "l_orderkey", F.col("l.l_partkey").alias("parts"))
    b = g.groupBy("batch").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_orderkey", "parts"))), lambda x: x["parts"]).alias("parts"))
    r = b.select("batch", checked(ragged(F.col("parts"))).alias("r"))
    cut = r.select("batch", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), sliced(F.col("r"), 5 * i, 5 * i + 5 if i < 12 else 10**6).alias("r")) for i in range(13)])).alias("p")).select("batch", "p.i", "p.r")
    back = gathered(cut, "batch", "i", "r")
    twice = back.select("batch", concatenated([F.col("r"), F.col("r")]).alias("r"))
    return twice.select("batch", F.md5(F.array_join("r.values", ",")).alias("digest"), F.array_join("r.offsets", ",").alias("offsets"))


def u15_flattened_trajectories(spark, sf_dir):
    """Orders as trajectories of their lines: one row a step, what belongs to the order repeated."""
    g = _orders_lists(spark, sf_dir).select("l_orderkey", F.col("l.l_partkey").alias("action"), F.transform("l", lambda x: F.array(x["l_suppkey"], x["l_linenumber"].cast("long"))).alias("state"), F.size("l").alias("length"))
    f = flatten_trajectories(g, "l_orderkey", "action")
    return f.select(ROW, "l_orderkey", "action", F.array_join("state", "-").alias("state"), "length", "step")


def _batch(spark, sf_dir) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("row"), F.array("o_custkey", "o_orderkey").alias("ids"), F.col("o_totalprice").cast("double").alias("score"), F.struct("o_orderstatus").alias("extra"), F.col("o_orderpriority").alias("raw"), F.lit(0.5).alias("temperature"))


def p15_split(spark, sf_dir):
    """Which columns are tensors, and both sides' rows, by key."""
    tensors, others, meta = split_batch(_batch(spark, sf_dir), "row", ["temperature"])
    told = f"{','.join(tensors.columns)};{','.join(others.columns)};{meta['temperature']}"
    a = tensors.select("row", F.concat_ws("/", F.array_join("ids", ","), F.round("score", 2).cast("decimal(20,2)").cast("string")).alias("tensors"))
    return a.join(others.select("row", F.concat("extra.o_orderstatus", "raw").alias("others")), "row").withColumn("told", F.lit(told))


def p16_joined(spark, sf_dir):
    tensors, others, meta = split_batch(_batch(spark, sf_dir), "row", ["temperature"])
    back = joined_batch(tensors, others, meta, "row")
    return back.select("row", F.element_at("ids", 1).alias("customer"), F.round("score", 2).alias("score"), "extra.o_orderstatus", "raw", "temperature")


def j11_teacher_scattered(spark, sf_dir):
    """A teacher's two best ids and their scores for each line that is not returned, put where the mask is one; orders whose
    lines are all returned get zeros, and one in ten has a value too few or too many."""
    g = _orders_lists_flags(spark, sf_dir)
    k = F.col("l_orderkey")
    pairs = F.transform(F.filter("l", lambda x: x["l_returnflag"] != "R"), lambda x: F.array(x["l_partkey"], x["l_suppkey"]))
    ids = F.when(k % 10 == 1, F.slice(pairs, 1, F.greatest(F.size(pairs) - 1, F.lit(0)))).when(k % 10 == 2, F.concat(pairs, F.array(F.array(F.lit(7).cast("long"), F.lit(7).cast("long"))))).otherwise(pairs)
    t = g.select("l_orderkey", F.transform("l", lambda x: (x["l_returnflag"] != "R").cast("int")).alias("mask"), ids.alias("ids"))
    t = t.withColumn("logps", F.transform("ids", lambda p: F.transform(p, lambda v: -v.cast("double") / 8)))
    done = t.select("l_orderkey", scattered_to_mask(F.col("ids"), F.col("mask"), 2, "long", strict=False).alias("ids"), scattered_to_mask(F.col("logps"), F.col("mask"), 2, strict=False).alias("logps"))
    joined = lambda c: F.array_join(F.transform(c, lambda p: F.array_join(p.cast("array<string>"), "|")), ",")
    return done.select("l_orderkey", joined("ids").alias("ids"), F.round(F.aggregate(F.flatten("logps"), F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.size("logps").alias("n"))


def _orders_lists_flags(spark, sf_dir) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))).alias("l"))


QUERIES = {f.__name__: f for f in (j11_teacher_scattered, p15_split, p16_joined, u15_flattened_trajectories, u23_ragged)}
_L = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem"
ORACLES = {
    "u23_ragged": f"WITH l AS ({_L}), b AS (SELECT l_orderkey // 64 AS batch, list(l_partkey ORDER BY l_orderkey, i) AS v FROM l GROUP BY 1), s AS (SELECT l_orderkey // 64 AS batch, l_orderkey, sum(count(*)) OVER (PARTITION BY l_orderkey // 64 ORDER BY l_orderkey)::BIGINT AS e FROM l GROUP BY 1, 2), o AS (SELECT batch, list(e ORDER BY e) AS e FROM s GROUP BY 1) SELECT batch, md5(array_to_string(list_concat(v, v), ',')) AS digest, '0,' || array_to_string(list_concat(e, list_transform(e, lambda x: x + e[-1])), ',') AS offsets FROM b JOIN o USING (batch)",
    "u15_flattened_trajectories": f"SELECT row_number() OVER (ORDER BY l_orderkey, i) - 1 AS row_id, l_orderkey, l_partkey AS action, l_suppkey || '-' || l_linenumber AS state, n::INT AS length, i::INT AS step FROM ({_L})",
    "p15_split": "SELECT o_orderkey AS row, o_custkey || ',' || o_orderkey || '/' || o_totalprice::DECIMAL(20,2) AS tensors, o_orderstatus || o_orderpriority AS others, 'row,ids,score;row,extra,raw;0.5' AS told FROM orders",
    "p16_joined": "SELECT o_orderkey AS row, o_custkey AS customer, round(o_totalprice::DOUBLE, 2) AS score, o_orderstatus, o_orderpriority AS raw, 0.5::DOUBLE AS temperature FROM orders",
    "j11_teacher_scattered": f"WITH l AS ({_L}), m AS (SELECT *, l_returnflag <> 'R' AS keep, sum((l_returnflag <> 'R')::INT) OVER (PARTITION BY l_orderkey ORDER BY i) AS r, sum((l_returnflag <> 'R')::INT) OVER (PARTITION BY l_orderkey) AS c FROM l), k AS (SELECT *, keep AND NOT (l_orderkey % 10 = 1 AND r = c) AS has FROM m) SELECT l_orderkey, string_agg(CASE WHEN has THEN l_partkey || '|' || l_suppkey ELSE '0|0' END, ',' ORDER BY i) AS ids, round(sum(CASE WHEN has THEN -(l_partkey + l_suppkey) / 8.0 ELSE 0 END), 4)::DOUBLE AS total, count(*)::INT AS n FROM k GROUP BY 1",
}
