"""Document fingerprints: SimHash in DataFrame operations alone.

A text's terms are its lower-cased runs of letters and digits; each occurrence votes with its length as weight on the 64
bits of its XXH64.  Votes are summed in 32 longs that hold two 32-bit lanes each, so the sums stay in generated code and
a document may hold up to 2^31 weighted characters.  A bit is set where over half of the weight votes for it; equal
texts have equal fingerprints, and texts without terms have fingerprint zero.

Neighbours are found by block tables: the bits are cut into six blocks, and any two fingerprints within a radius of three
agree in at least three blocks; each of the 20 choices of three blocks is one permuted table, with that choice's bits as
key.  Equal fingerprints are one class.  A link counts in the first table that shows it, so links are summed where they are
found and never exchanged.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ranges_for, written

LANES = 0x0000000100000001
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Buckets of neighbours by key, in multiples of the ranges that the table's size asks for; rows drawn for each border.
BUCKETS = 2
DRAWN = 16
_TERMS = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), _TERMS)


def votes(term: Column) -> list[Column]:
    """32 sums over the rows of a group, two lanes each, and the sum of weights (terms of no length weigh nothing)."""
    h, w = F.xxhash64(term), F.length(term).cast("long")
    lanes = [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(LANES)) * w).alias(f"_v{j}") for j in range(32)]
    return [*lanes, F.sum(w).alias("_w")]


def from_votes() -> Column:
    """The fingerprint as a long, from the columns that ``votes`` names."""
    bits = []
    for j in range(32):
        low, high = F.col(f"_v{j}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"_v{j}", 32)
        for lane, at in ((low, j), (high, j + 32)):
            bits.append(F.when(lane * 2 > F.col("_w"), F.lit((1 << at) - (1 << 64) if at == 63 else 1 << at)).otherwise(F.lit(0)).cast("long"))
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _bucketed(use: DataFrame) -> DataFrame:
    """Deal rows to buckets of neighbours by key and hash of the text; each also gets, as a ghost, the next one's first row.

    Borders are quantiles of rows drawn by hash, so buckets are even whatever the keys are, and a hot key has many.  The
    driver holds DRAWN rows a border, and buckets follow the size of the table.
    """
    spark, buckets = use.sparkSession, BUCKETS * ranges_for(use)
    place = F.struct(F.col("_k").isNotNull().alias("known"), F.coalesce("_k", F.lit(0)).alias("k"), F.xxhash64("_t").alias("h"))
    placed = use.withColumn("_at", place)
    drawn = sorted(tuple(r["_at"]) for r in placed.select("_at").orderBy(F.xxhash64("_at"), "_at").limit(DRAWN * buckets).collect())
    borders = sorted({drawn[i * len(drawn) // buckets] for i in range(1, buckets)}) if drawn else []
    wide = max(1, int(len(borders) ** 0.5))
    kind = "struct<known:boolean,k:bigint,h:bigint>"
    fine = [borders[i : i + wide] for i in range(0, len(borders), wide)]
    table = F.broadcast(spark.createDataFrame([([x[0] for x in fine], fine)], f"_coarse array<{kind}>, _fine array<array<{kind}>>"))
    below = lambda borders: F.size(F.filter(borders, lambda x: x <= F.col("_at")))
    dealt = placed.crossJoin(table).withColumn("_c", below(F.col("_coarse")))
    dealt = dealt.withColumn("_b", F.when(F.col("_c") == 0, 0).otherwise((F.col("_c") - 1) * wide + below(F.get("_fine", F.col("_c") - 1)))).drop("_coarse", "_fine", "_c")
    firsts = sorted((r["_b"], tuple(r["f"])) for r in dealt.groupBy("_b").agg(F.min("_at").alias("f")).collect())  # a row a bucket
    ghosts = F.broadcast(spark.createDataFrame([(f, firsts[i - 1][0]) for i, (_, f) in enumerate(firsts)], f"_f {kind}, _before int"))
    twice = F.when(F.col("_before").isNull(), F.array(F.struct(F.col("_b").alias("b"), F.lit(0).alias("g")))).otherwise(F.array(F.struct(F.col("_b").alias("b"), F.lit(0).alias("g")), F.struct(F.col("_before").alias("b"), F.lit(1).alias("g"))))
    met = dealt.join(ghosts, F.col("_at") == F.col("_f"), "left")
    return met.withColumn("_x", F.explode(twice)).select("_k", "_t", F.col("_x.b").alias("_b"), F.col("_x.g").alias("_g"))


def fingerprints_with_edit(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row a document: _k, n_chars, edited_sha256, fp, edited_fp, next_fp.

    The edited text is the text with its last quarter replaced by as much (or all) of the start of the next document by
    key, after the last the first.  The one exchange of texts is by bucket of keys; windows and sums reuse it.
    """
    use = docs.select(F.col(key).cast("long").alias("_k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    order = Window.partitionBy("_b").orderBy("_g", F.col("_k").asc_nulls_first(), F.xxhash64("_t"))
    lined = _bucketed(use).withColumn("_rn", F.row_number().over(order)).withColumn("_next", F.lead("_t").over(order))
    cut = F.expr("floor(char_length(_t) / 4)").cast("int")
    edited = F.concat(F.expr("substring(_t, 1, char_length(_t) - cast(floor(char_length(_t) / 4) as int))"), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), cut))
    both = F.when(F.col("_g") == 0, F.array(F.struct(F.lit(0).alias("e"), F.col("_t").alias("t")), F.struct(F.lit(1).alias("e"), edited.alias("t")))).otherwise(F.array(F.struct(F.lit(0).alias("e"), F.col("_t").alias("t"))))
    each = lined.select("_b", "_g", "_rn", "_k", F.explode(both).alias("_x"))
    each = each.select("_b", "_g", "_rn", "_k", "_x.e", F.char_length("_x.t").cast("long").alias("_n"), F.when(F.col("_x.e") == 1, F.sha2("_x.t", 256)).alias("_sha"), F.col("_x.t").alias("_text"))
    # in a step of its own: beside an explode, the digest would be computed for every term
    each = each.select("_b", "_g", "_rn", "_k", "e", "_n", "_sha", F.explode(terms(F.col("_text"))).alias("_term"))
    keys = ["_b", "_g", "_rn", "_k", "e", "_n", "_sha"]
    prints = each.groupBy(*keys).agg(*votes(F.col("_term"))).select(*keys, from_votes().alias("_fp"))
    rows = prints.groupBy("_b", "_g", "_rn", "_k").agg(F.max(F.expr("if(e = 0, _n, null)")).alias("n_chars"), F.max("_sha").alias("edited_sha256"), F.max(F.expr("if(e = 0, _fp, null)")).alias("fp"), F.max(F.expr("if(e = 1, _fp, null)")).alias("edited_fp"))
    line = Window.partitionBy("_b").orderBy("_rn")
    return rows.withColumn("next_fp", F.lead("fp").over(line)).filter("_g = 0").select("_k", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp")


def near_classes(prints: DataFrame, *, fp: str = "fp", radius: int = 3) -> DataFrame:
    """fp, n_near: for each distinct fingerprint the number of other rows within the radius (at most 3), via block tables."""
    if not 0 <= radius <= 3:
        raise ValueError("six blocks serve a radius of 0 to 3")
    classes = written(prints.groupBy(F.col(fp).alias("fp")).agg(F.count("*").alias("n")), "classes")
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m).cast("long")
    blocks, at = [], 0
    for size in BLOCKS:
        blocks.append(((1 << size) - 1) << at)
        at += size
    choices = list(combinations(range(6), 3))
    tables = F.posexplode(F.array(*[F.col("fp").bitwiseAND(signed(sum(blocks[i] for i in c))) for c in choices])).alias("_table", "_bits")
    indexed = classes.select("fp", "n", tables)
    a, b = indexed.alias("a"), indexed.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    # the first table of a pair is that of the first three blocks in which it agrees
    first = F.lit(False)
    for k, c in enumerate(choices):
        own = F.col("a._table") == k
        for i in range(c[2]):
            if i not in c:
                own = own & (differ.bitwiseAND(signed(blocks[i])) != 0)
        first = first | own
    near = (F.col("a._table") == F.col("b._table")) & (F.col("a._bits") == F.col("b._bits")) & (F.col("a.fp") != F.col("b.fp")) & (F.bit_count(differ) <= radius) & first
    # a sort-merge join: Spark would judge the side to be broadcast by the classes, of which it holds each twenty times
    counted = a.join(b.hint("merge"), near).groupBy(F.col("a.fp").alias("fp")).agg(F.sum("b.n").alias("m"))
    both = counted.union(classes.select("fp", (F.col("n") - 1).alias("m")))
    return both.groupBy("fp").agg(F.sum("m").alias("n_near"))


def document_fingerprints(docs: DataFrame, *, text: str = "text", key: str = "doc_id", radius: int = 3) -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near (rows within radius).

    Null texts are empty; a null key sorts first; rows with equal keys follow each other by hash of the text; one document
    is its own next; an empty table gives no rows; other columns are ignored.
    """
    rows = written(fingerprints_with_edit(docs, text=text, key=key), "fingerprints")
    near = written(near_classes(rows, radius=radius), "near")
    return rows.join(near, "fp").select(F.col("_k").alias(key), "n_chars", "edited_sha256", as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_near")
