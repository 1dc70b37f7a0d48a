"""Batches of samples as DataFrames: row order is data, so a frame carries a dense ``row_id``; the rest is relational.

``with_row_id`` numbers rows without a single-partition sort: rows are dealt to ranges of all keys together by fixed
borders, so a first key that many rows have is no hot range, numbered within their range, and shifted by the counts of the
ranges before (one row a range comes to the driver).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROW = "row_id"


def _range_of(key: Column, borders: list[Column], lo: int = 0) -> Column:
    """Number of borders at or below the key, by a balanced tree of comparisons."""
    if not borders:
        return F.lit(lo)
    mid = len(borders) // 2
    return F.when(key < borders[mid], _range_of(key, borders[:mid], lo)).otherwise(_range_of(key, borders[mid + 1 :], lo + mid + 1))


def with_row_id(df: DataFrame, keys: Sequence[str], name: str = ROW, ranges: int | None = None) -> DataFrame:
    """Add the position of each row in the order of ``keys`` (nulls first); keys should order rows totally."""
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = F.col(keys[0]) if len(keys) == 1 else F.struct(*keys)  # structs compare field by field, nulls first
    picked = df.select(first.alias("k")).filter("k is not null").orderBy(F.xxhash64("k"), "k").limit(20 * ranges).orderBy("k")
    sample = [r["k"] for r in picked.collect()]
    found = [sample[i * len(sample) // ranges] for i in range(1, ranges)] if sample else []
    found = [x for i, x in enumerate(found) if not i or x != found[i - 1]]
    kinds = [df.schema[k].dataType for k in keys]
    borders = [F.lit(x).cast(kinds[0]) if len(keys) == 1 else F.struct(*[F.lit(v).cast(t).alias(k) for k, v, t in zip(keys, x, kinds, strict=True)]) for x in found]
    dealt = df.withColumn("_range", F.when(first.isNull(), 0).otherwise(_range_of(first, borders)))
    sizes = {r["_range"]: r["count"] for r in dealt.groupBy("_range").count().collect()}
    offsets, total = [], 0
    for i in range(len(borders) + 1):
        offsets.append(total)
        total += sizes.get(i, 0)
    order = Window.partitionBy("_range").orderBy(*[F.col(k).asc_nulls_first() for k in keys])
    base = F.element_at(F.array(*[F.lit(x).cast("long") for x in offsets]), F.col("_range") + 1)
    return dealt.withColumn(name, base + F.row_number().over(order) - 1).drop("_range")


#: Cells that one window of ``running`` sees.
LEVEL = 4096


def running(cells: DataFrame, cell: str, value: str, out: str, kind: str = "sum") -> DataFrame:
    """``cells`` with ``out``: the sum or the maximum of ``value`` over all smaller cells; null where there is none.

    Cells are numbered from 0 on.  Blocks of LEVEL cells are scanned side by side, and their totals in the same way, so no
    window ever sees more than LEVEL rows.
    """
    f = F.sum if kind == "sum" else F.max
    top = cells.agg(F.max(cell)).first()[0]
    up, own, total = f"{cell}_up", f"{out}_own", f"{value}_up"
    if top is None or top < LEVEL:
        line = Window.partitionBy(F.lit(0)).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
        return cells.withColumn(out, f(value).over(line))
    blocks = cells.withColumn(up, F.expr(f"{cell} div {LEVEL}"))
    line = Window.partitionBy(up).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    totals = running(blocks.groupBy(up).agg(f(value).alias(total)), up, total, f"{out}_up", kind).select(up, f"{out}_up")
    both = blocks.withColumn(own, f(value).over(line)).join(totals, up)
    a, b = F.col(own), F.col(f"{out}_up")
    merged = F.greatest(a, b) if kind == "max" else F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    return both.withColumn(out, merged).drop(own, f"{out}_up", up)


class SampleFrame:
    """A DataFrame with a dense row id, and batch-level constants in ``meta``."""

    def __init__(self, df: DataFrame, meta: dict | None = None):
        if ROW not in df.columns:
            raise ValueError(f"a SampleFrame needs the column {ROW}; see with_row_id")
        self.df, self.meta = df, dict(meta or {})

    def _with(self, df: DataFrame) -> SampleFrame:
        return SampleFrame(df, self.meta)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != ROW]

    def count(self) -> int:
        return self.df.count()

    def info(self) -> dict[str, str]:
        return dict(self.df.dtypes)

    @staticmethod
    def of(df: DataFrame, keys: Sequence[str], meta: dict | None = None) -> SampleFrame:
        """A frame of a table, in the order of ``keys``."""
        return SampleFrame(with_row_id(df, keys), meta)

    def sizes(self) -> DataFrame:
        """column, bytes: what the values of each column take, without their framing."""
        wide = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4, "bigint": 8, "double": 8, "timestamp": 8}

        def of(c: Column, kind: str) -> Column:
            if kind.startswith("array<"):
                inner = kind[6:-1]
                if inner in wide:
                    return F.size(c) * wide[inner]
                return F.aggregate(c, F.lit(0), lambda a, x: a + of(x, inner))
            return F.octet_length(c) if kind in ("string", "binary") else F.lit(wide.get(kind, 8))

        total = self.df.agg(*[F.sum(F.when(F.col(c).isNull(), 0).otherwise(of(F.col(c), t))).cast("long").alias(c) for c, t in self.df.dtypes if c != ROW])
        return total.unpivot([], self.columns, "column", "bytes")

    def problems(self, lengths: Sequence[str] = ()) -> DataFrame:
        """check, n: rows against the invariants - row ids dense from 0, and arrays of ``lengths`` equally long in a row."""
        ids = self.df.groupBy(ROW).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") - 1).alias("repeated"), F.count("*").alias("ids"), F.coalesce(F.max(ROW) + 1, F.lit(0)).alias("span"), F.count_if(F.col(ROW) < 0).alias("below"))
        ids = ids.select(F.coalesce("repeated", F.lit(0)).cast("long").alias("repeated_ids"), (F.greatest(F.col("span") - F.col("ids"), F.lit(0)) + F.col("below")).cast("long").alias("missing_ids"))
        sizes = [F.size(c) for c in lengths]
        odd = sum((F.count_if(F.coalesce(x != sizes[0], F.lit(True))) for x in sizes[1:]), F.lit(0).cast("long")) if sizes else F.lit(0).cast("long")
        return ids.crossJoin(self.df.agg(odd.cast("long").alias("unequal_lengths"))).unpivot([], ["repeated_ids", "missing_ids", "unequal_lengths"], "check", "n")

    def __getitem__(self, key) -> SampleFrame:
        """By position, slice, list of positions, boolean list, or a condition."""
        if isinstance(key, Column):
            return self.where(key)
        if isinstance(key, slice):
            return self.slice(key.start, key.stop, key.step or 1)
        if isinstance(key, int):
            return self.take([key])
        if key and all(isinstance(k, bool) for k in key):
            return self.take([i for i, k in enumerate(key) if k])
        return self.take(list(key))

    # --- columns ---
    def select(self, columns: Sequence[str] | None = None, meta: Sequence[str] | None = None) -> SampleFrame:
        kept = self.columns if columns is None else list(columns)
        return SampleFrame(self.df.select(ROW, *kept), {k: self.meta[k] for k in (self.meta if meta is None else meta)})

    def pop(self, columns: Sequence[str]) -> tuple[SampleFrame, SampleFrame]:
        """The columns as a frame of their own, and the rest."""
        if missing := set(columns) - set(self.columns):
            raise KeyError(f"no such columns: {sorted(missing)}")
        return self.select(columns), self._with(self.df.drop(*columns))

    def rename(self, old: Sequence[str], new: Sequence[str]) -> SampleFrame:
        if len(old) != len(new):
            raise ValueError("as many new names as old ones are needed")
        return self._with(self.df.withColumnsRenamed(dict(zip(old, new, strict=True))))

    def get(self, column: str, default=None) -> Column:
        return F.col(column) if column in self.df.columns else F.lit(default)

    def assign(self, **values) -> SampleFrame:
        return self._with(self.df.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()}))

    # --- rows ---
    def slice(self, start: int | None = None, stop: int | None = None, step: int = 1) -> SampleFrame:
        """Python's slice of the positions; the kept rows are numbered anew."""
        at = range(*slice(start, stop, step).indices(self.count()))
        if not len(at):
            return self._with(self.df.limit(0))
        lo, hi = min(at[0], at[-1]), max(at[0], at[-1])
        kept = self.df.filter(F.col(ROW).between(lo, hi) & ((F.col(ROW) - at[0]) % at.step == 0))
        return self._with(kept.withColumn(ROW, ((F.col(ROW) - at[0]) / at.step).cast("long")))

    def take(self, positions: Sequence[int]) -> SampleFrame:
        """Gather by position, in the given order and as often as given; negative positions count from the end."""
        n = self.count() if any(p < 0 for p in positions) else 0
        wanted = self.df.sparkSession.createDataFrame([(i, p + n if p < 0 else p) for i, p in enumerate(positions)], "_to long, _at long")
        return self._with(self.df.join(wanted, F.col(ROW) == F.col("_at")).withColumn(ROW, F.col("_to")).drop("_to", "_at"))

    def where(self, mask: Column) -> SampleFrame:
        """Rows under the mask; positions are closed up."""
        kept = self.df.filter(mask)
        return self._with(with_row_id(kept.withColumnRenamed(ROW, "_old"), ["_old"]).drop("_old"))

    def reorder(self, permutation: DataFrame, old: str = "old", new: str = "new") -> SampleFrame:
        """Apply a permutation given as a table of old and new positions."""
        p = permutation.select(F.col(old).alias("_old"), F.col(new).alias("_new"))
        return self._with(self.df.join(p, F.col(ROW) == F.col("_old")).withColumn(ROW, F.col("_new")).drop("_old", "_new"))

    # --- sets of rows ---
    @staticmethod
    def concat(frames: Sequence[SampleFrame]) -> SampleFrame:
        """All rows in order; meta lists under "metrics" are joined, other meta must agree."""
        meta: dict = {}
        for f in frames:
            for k, v in f.meta.items():
                if k == "metrics":
                    meta[k] = meta.get(k, []) + list(v if isinstance(v, list) else [v])
                elif k in meta and meta[k] != v:
                    raise ValueError(f"meta {k!r} differs: {meta[k]!r} and {v!r}")
                else:
                    meta[k] = v
        out, base = None, 0
        for i, f in enumerate(frames):
            part = f.df.withColumn(ROW, F.col(ROW) + F.lit(base).cast("long"))
            out = part if out is None else out.unionByName(part)
            base += f.count() if i + 1 < len(frames) else 0
        return SampleFrame(out, meta)

    def union_columns(self, other: SampleFrame) -> SampleFrame:
        """Positional one-to-one merge: as many rows, and columns of both must be equal (NaN equals NaN), else the action
        on the result raises."""
        for k in self.meta.keys() & other.meta.keys():
            if self.meta[k] != other.meta[k]:
                raise ValueError(f"meta {k!r} differs")
        both = [c for c in other.columns if c in self.columns]
        right = other.df.select(F.col(ROW).alias("_row"), *[F.col(c).alias(f"_r_{c}" if c in both else c) for c in other.columns])
        joined = self.df.join(right, F.col(ROW) == F.col("_row"), "full")
        odd = F.col(ROW).isNull() | F.col("_row").isNull()
        for c in both:
            odd = odd | ~F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        wrong = F.raise_error(F.lit(f"frames differ in rows or in a column of both ({both})")).cast("boolean")
        checked = joined.filter(F.when(odd, wrong).otherwise(F.lit(True)))  # raises where the plan runs
        return SampleFrame(checked.drop("_row", *[f"_r_{c}" for c in both]), {**self.meta, **other.meta})

    def equals(self, other: SampleFrame) -> bool:
        if sorted(self.columns) != sorted(other.columns) or self.meta != other.meta:
            return False
        names = [ROW, *sorted(self.columns)]
        a, b = self.df.select(*names), other.df.select(*names)
        return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()

    def repeat(self, times: int = 2, interleave: bool = True) -> SampleFrame:
        """Each row ``times`` times: a a b b, or a b a b."""
        n = 0 if interleave else self.count()
        each = self.df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))) if times > 0 else self.df.limit(0).withColumn("_k", F.lit(0))
        row = F.col(ROW) * times + F.col("_k") if interleave else F.col("_k") * F.lit(n).cast("long") + F.col(ROW)
        return self._with(each.withColumn(ROW, row.cast("long")).drop("_k"))

    def repeat_each(self, times: Column) -> SampleFrame:
        """Each row as often as its own count says; none for zero, null and below."""
        each = self.df.filter(times > 0).withColumn("_k", F.explode(F.sequence(F.lit(1), times.cast("int"))))
        return self._with(with_row_id(each.withColumnRenamed(ROW, "_old"), ["_old", "_k"]).drop("_old", "_k"))

    def unfold_columns(self, parts: int, columns: Sequence[str]) -> SampleFrame:
        """Cut the arrays of ``columns`` into ``parts`` equal pieces, one a row; other columns repeat."""
        k = F.col("_k")
        each = self.df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        for c in columns:
            size = (F.size(c) / parts).cast("int")
            each = each.withColumn(c, F.slice(c, k * size + 1, size))
        return self._with(each.withColumn(ROW, F.col(ROW) * parts + k).drop("_k"))

    def fold(self, rows: int) -> SampleFrame:
        """``rows`` groups of equally many consecutive rows as arrays."""
        n = self.count()
        if n % rows:
            raise ValueError(f"{n} rows don't make {rows} equal groups")
        item = F.struct(ROW, *self.columns)
        grouped = self.df.groupBy(F.expr(f"{ROW} div {n // rows}").alias("_g")).agg(F.sort_array(F.collect_list(item)).alias("_x"))
        return self._with(grouped.select(F.col("_g").cast("long").alias(ROW), *[F.col(f"_x.{c}").alias(c) for c in self.columns]))

    def unfold(self, size: int) -> SampleFrame:
        """The inverse of ``fold`` for groups of ``size``."""
        each = self.df.select(ROW, F.posexplode(F.arrays_zip(*self.columns)).alias("_p", "_x"))
        return self._with(each.select((F.col(ROW) * size + F.col("_p")).alias(ROW), *[F.col(f"_x.{c}").alias(c) for c in self.columns]))

    # --- layout ---
    def chunk_of(self, chunks: int) -> Column:
        """Number of the chunk of each row: chunks of ceil(n / chunks) rows, the last ones shorter."""
        return F.floor(F.col(ROW) / -(-self.count() // chunks)).cast("int")

    def chunk(self, chunks: int, padded: bool = False) -> list[SampleFrame]:
        n = self.count()
        if n % chunks and not padded:
            raise ValueError(f"{n} rows don't make {chunks} equal chunks")
        size = max(1, -(-n // chunks))
        return [self.slice(i * size, (i + 1) * size) for i in range(-(-n // size))]

    def split(self, size: int) -> list[SampleFrame]:
        """Frames of ``size`` rows each, for few pieces: each is a plan of its own (see ``pieces``)."""
        at = F.col(ROW)
        return [self._with(self.df.filter((at >= i) & (at < i + size)).withColumn(ROW, at - i)) for i in range(0, self.count(), size)]

    def pieces(self, size: int, name: str = "piece") -> DataFrame:
        """All pieces of ``size`` rows as one table: the piece's number, and rows numbered anew in each."""
        return self.df.withColumn(name, F.expr(f"{ROW} div {int(size)}")).withColumn(ROW, F.col(ROW) % int(size))

    def batches(self, size: int, epochs: int = 1, seed: int | None = None) -> Iterator[SampleFrame]:
        """Mini-batches of every epoch; with a seed each epoch is permuted by a hash of it."""
        n = self.count()
        if n % size:
            raise ValueError(f"{n} rows don't make batches of {size}")
        for epoch in range(epochs):
            f = self
            if seed is not None:
                f = SampleFrame(with_row_id(self.df.withColumn("_h", F.xxhash64(F.lit(seed), F.lit(epoch), ROW)).withColumnRenamed(ROW, "_old"), ["_h", "_old"]).drop("_h", "_old"), self.meta)
            yield from f.split(size)

    def pad_to_divisor(self, divisor: int) -> tuple[SampleFrame, int]:
        """Append rows from the start on, again and again, until the count divides; gives the number appended."""
        n = self.count()
        pad = -n % divisor
        if not pad or not n:
            return self, 0
        more = self.df.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(-(-pad // n))))).withColumn(ROW, F.col(ROW) + F.col("_k") * F.lit(n).cast("long")).drop("_k")
        return self._with(self.df.unionByName(more.filter(F.col(ROW) < n + pad))), pad

    def unpad(self, pad: int) -> SampleFrame:
        return self.slice(0, self.count() - pad) if pad else self

    def pad(self, size: int, first: bool = False) -> SampleFrame:
        """Append ``size`` copies of the last (or the first) row."""
        n = self.count()
        row = self.df.filter(F.col(ROW) == (0 if first else n - 1))
        more = row.withColumn(ROW, F.explode(F.sequence(F.lit(n).cast("long"), F.lit(n + size - 1).cast("long")))) if size else row.limit(0)
        return self._with(self.df.unionByName(more))


# --- queries ---
_LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _orders(spark: SparkSession, sf_dir: str) -> SampleFrame:
    return SampleFrame(with_row_id(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"]))


def s01_row_ids(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*_LINE_KEYS)
    return with_row_id(li, _LINE_KEYS)


def r02_slice(spark, sf_dir):
    return _orders(spark, sf_dir).slice(-100, None, -7).df.select(ROW, "o_orderkey")


def r01_gather(spark, sf_dir):
    return _orders(spark, sf_dir).take([5, 0, 5, -1, 17]).df.select(ROW, "o_orderkey")


def r01_mask(spark, sf_dir):
    return _orders(spark, sf_dir).where(F.col("o_custkey") % 10 == 3).df.select(ROW, "o_orderkey")


def u01_concat(spark, sf_dir):
    """The second half of the orders, then the first."""
    o = _orders(spark, sf_dir)
    half = o.count() // 2
    return SampleFrame.concat([o.slice(half, None), o.slice(0, half)]).df.select(ROW, "o_orderkey")


def u03_repeat_interleave(spark, sf_dir):
    return _orders(spark, sf_dir).repeat(2).df.select(ROW, "o_orderkey")


def u03_repeat_tile(spark, sf_dir):
    return _orders(spark, sf_dir).repeat(2, interleave=False).df.select(ROW, "o_orderkey")


def u04_repeat_each(spark, sf_dir):
    return _orders(spark, sf_dir).repeat_each(F.col("o_custkey") % 3).df.select(ROW, "o_orderkey")


def t01_chunks(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return o.df.groupBy(o.chunk_of(7).alias("chunk")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


def t05_pad_to_divisor(spark, sf_dir):
    padded, _ = _orders(spark, sf_dir).pad_to_divisor(64)
    return padded.df.select(ROW, "o_orderkey")


def _in_fours(spark, sf_dir) -> SampleFrame:
    """All orders, padded until they fold into groups of four."""
    padded, _ = _orders(spark, sf_dir).select(["o_orderkey", "o_custkey"]).pad_to_divisor(4)
    return padded.fold(padded.count() // 4)


def u06_fold_unfold(spark, sf_dir):
    return _in_fours(spark, sf_dir).unfold(4).df.select(ROW, "o_orderkey", "o_custkey")


def u06_fold(spark, sf_dir):
    f = _in_fours(spark, sf_dir)
    return f.df.select(ROW, F.array_join("o_orderkey", ",").alias("keys"))


def j01_union_columns(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return o.select(["o_orderkey", "o_custkey"]).union_columns(o.select(["o_custkey", "o_totalprice"])).df.select(ROW, "o_orderkey", "o_custkey", "o_totalprice")


def u05_unfold_columns(spark, sf_dir):
    e = SampleFrame(with_row_id(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), ["vec_id"]))
    return e.unfold_columns(4, ["embedding"]).df.select(ROW, "vec_id", F.size("embedding").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


_O = "(SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders)"
_FOURS = f"o AS (SELECT *, count(*) OVER () AS n FROM {_O}), p AS (SELECT row_id, o_orderkey, o_custkey FROM o UNION ALL SELECT row_id + n, o_orderkey, o_custkey FROM o WHERE row_id < (4 - n % 4) % 4)"
QUERIES = {f.__name__: f for f in (s01_row_ids, r02_slice, r01_gather, r01_mask, u01_concat, u03_repeat_interleave, u03_repeat_tile, u04_repeat_each, t01_chunks, t05_pad_to_divisor, u06_fold_unfold, u06_fold, j01_union_columns, u05_unfold_columns)}
ORACLES = {
    "s01_row_ids": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS row_id FROM lineitem",
    "r02_slice": f"SELECT (n - 100 - row_id) // 7 AS row_id, o_orderkey FROM (SELECT *, count(*) OVER () AS n FROM {_O}) WHERE row_id <= n - 100 AND (n - 100 - row_id) % 7 = 0",
    "r01_gather": f"SELECT w.i AS row_id, o_orderkey FROM (VALUES (0::BIGINT, 5), (1, 0), (2, 5), (3, -1), (4, 17)) w(i, p) JOIN (SELECT *, count(*) OVER () AS n FROM {_O}) o ON o.row_id = CASE WHEN w.p < 0 THEN n + w.p ELSE w.p END",
    "r01_mask": "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, o_orderkey FROM orders WHERE o_custkey % 10 = 3",
    "u01_concat": f"SELECT CASE WHEN row_id < n // 2 THEN row_id + n - n // 2 ELSE row_id - n // 2 END AS row_id, o_orderkey FROM (SELECT *, count(*) OVER () AS n FROM {_O})",
    "u03_repeat_interleave": f"SELECT row_id * 2 + k AS row_id, o_orderkey FROM {_O}, (VALUES (0), (1)) t(k)",
    "u03_repeat_tile": f"SELECT row_id + k * n AS row_id, o_orderkey FROM (SELECT *, count(*) OVER () AS n FROM {_O}), (VALUES (0), (1)) t(k)",
    "u04_repeat_each": "SELECT row_number() OVER (ORDER BY o_orderkey, k) - 1 AS row_id, o_orderkey FROM orders, (VALUES (1), (2)) t(k) WHERE k <= o_custkey % 3",
    "t01_chunks": f"SELECT CAST(row_id // CAST(ceil(n / 7.0) AS BIGINT) AS INT) AS chunk, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM (SELECT *, count(*) OVER () AS n FROM {_O}) GROUP BY 1",
    "t05_pad_to_divisor": f"WITH o AS (SELECT *, count(*) OVER () AS n FROM {_O}) SELECT row_id, o_orderkey FROM o UNION ALL SELECT row_id + n, o_orderkey FROM o WHERE row_id < (64 - n % 64) % 64",
    "u06_fold_unfold": f"WITH {_FOURS} SELECT row_id, o_orderkey, o_custkey FROM p",
    "u06_fold": f"WITH {_FOURS} SELECT row_id // 4 AS row_id, string_agg(o_orderkey, ',' ORDER BY row_id) AS keys FROM p GROUP BY 1",
    "j01_union_columns": f"SELECT row_id, o_orderkey, o_custkey, o_totalprice FROM {_O}",
    "u05_unfold_columns": "SELECT r * 4 + k AS row_id, vec_id, CAST(len(embedding) // 4 AS INT) AS n, round(list_sum(list_transform(embedding[k * 16 + 1 : k * 16 + 16], lambda x: x::DOUBLE)), 4) AS total FROM (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM embeddings), (VALUES (0), (1), (2), (3)) t(k)",
}
