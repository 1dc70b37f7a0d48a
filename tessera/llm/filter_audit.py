"""How filters interact: what each of them removes at each place of every order in which they can be applied.

A document's failures are one boolean column a filter.  SQL's CUBE over these and the part gives, for every subset of the
filters, a grouping row whose selected flags are all false: its count is what survives that subset, in whatever order it is
applied.  A step of an order goes from one subset to the next larger one, so joining the two subsets' rows gives what the
step keeps and removes; no order is ever run over the documents.

Documents are read once.  Their rows shrink to a digest, a key and flags before they are exchanged, and counts are made
before every exchange, so a hot text, key or part costs one row a task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import permutations
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

#: The white space that parts words.
BLANKS = " \t\n\x0b\x0c\r"
#: 8! orders are the most that come out.
MOST_FILTERS = 8
COUNTS = ("n", "n_good", "n_toxic")


def failures(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", part: str = "lang") -> DataFrame:
    """part, A, B, C, D, E (booleans: the document fails) and the counts n, n_good, n_toxic of such documents.

    A: under 100 words; B: 100 * distinct words < 80 * words; C: 100 * A-Z characters > 10 * code points; D: holds one of
    ``#$%&*|``; E: a smaller key has the identical text (SHA-256 of its bytes).  Words are maximal runs without blank and
    \\t-\\r.

    A null text is empty (A fails; C, D and, without a copy, E don't); a null part is the empty string; rows with equal key
    and text are all counted and none is a copy of the other; a null key is larger than any other, and null keys are no
    copies of each other; a key with several labels has each mark that any of them has; labels without a document are not
    counted.  Texts are judged whole at any length.  An empty table gives no rows.  Columns with other names are not read.
    """
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), whole.alias("text"))
    inner = F.btrim("text", F.lit(BLANKS))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[ \t-\r]+"))
    some = rows.select("key", "part", "text", words.alias("words"))
    flags = some.select(
        "key",
        "part",
        (F.size("words") < 100).alias("A"),
        (100 * F.size(F.array_distinct("words")) < 80 * F.size("words")).alias("B"),
        (100 * F.char_length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long") > 10 * F.char_length("text").cast("long")).alias("C"),
        F.col("text").rlike(r"[#$%&*|]").alias("D"),
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
    )
    marks = labels.groupBy(F.col("doc_id").alias("_of")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = flags.join(marks, F.col("key") == F.col("_of"), "left").drop("_of").na.fill(0, ["good", "toxic"])
    kind = ["digest", "part", "A", "B", "C", "D", "good", "toxic"]
    # copies of one text: rows by key, then by kind with the smallest key's rows, then the smallest key of all kinds
    by_key = marked.groupBy(*kind, "key").agg(F.count("*").alias("rows"))
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "rows"))
    by_kind = by_key.groupBy(*kind).agg(F.sum("rows").alias("n"), first.alias("first"))
    least = F.min(F.struct("first.none", "first.key")).over(Window.partitionBy("digest"))
    # null keys are all of them firsts where there is no other
    heads = F.when(F.struct("first.none", "first.key").eqNullSafe(F.col("least")), F.when(F.col("first.none"), F.col("n")).otherwise(F.col("first.rows"))).otherwise(0)
    split = by_kind.withColumn("least", least).withColumn("heads", heads)
    ways = F.array(F.struct(F.lit(False).alias("E"), F.col("heads").alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("heads")).alias("n")))
    each = split.select("part", "A", "B", "C", "D", "good", "toxic", F.inline(ways)).filter("n > 0")
    sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("n_good"), F.sum(F.col("n") * F.col("toxic")).alias("n_toxic")]
    return each.groupBy("part", "A", "B", "C", "D", "E").agg(*sums)


def survivors(counts: DataFrame, filters: Sequence[str]) -> DataFrame:
    """part, subset (bit i: filter i is applied) and the counts of documents that pass all of it, for every subset.

    ``counts`` has a row for each part and combination of failures; subsets that nothing survives are there with zeros.
    """
    selected = [(1 - F.grouping(f)) for f in filters]
    subset = reduce(lambda a, b: a + b, [s.cast("int") * (1 << i) for i, s in enumerate(selected)])
    fails = reduce(or_, [F.coalesce(F.col(f), F.lit(False)) for f in filters])
    cube = counts.cube("part", *filters).agg(*[F.sum(c).alias(c) for c in COUNTS], F.grouping("part").alias("_all_parts"), subset.alias("subset"))
    found = cube.filter((F.col("_all_parts") == 0) & ~fails).select("part", "subset", *COUNTS)
    every = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))).alias("subset"))
    return every.join(found, ["part", "subset"], "left").na.fill(0, list(COUNTS))


def audit(counts: DataFrame, filters: Sequence[str]) -> DataFrame:
    """A row for each part, filter_order and step (from 1): kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``filters`` are boolean columns of ``counts`` named by one letter each.  ``shapley`` sums what the step's filter
    removes over all orders; divided by their number it is the filter's Shapley value.
    """
    if len(filters) > MOST_FILTERS or any(len(f) != 1 for f in filters):
        raise ValueError(f"up to {MOST_FILTERS} filters, named by one letter")
    spark, bit, steps = counts.sparkSession, {f: 1 << i for i, f in enumerate(filters)}, []
    for order in permutations(filters):
        done = 0
        for k, f in enumerate(order, 1):
            steps.append(("".join(order), k, f, done, done | bit[f]))
            done |= bit[f]
    steps = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, _filter string, _before int, _after int"))
    left = written(survivors(counts, filters), "survivors")

    def at(name: str, *more: str) -> DataFrame:
        return left.select(F.col("part").alias("_part" + name), F.col("subset").alias("_subset" + name), *[F.col(c).alias(c + name) for c in ("n", *more)])

    full = (1 << len(filters)) - 1
    alone = F.broadcast(spark.createDataFrame([(f, b, full ^ b) for f, b in bit.items()], "_filter string, _one int, _rest int"))
    own = left.filter("subset = 0").select("part", F.col("n").alias("_docs"))
    own = own.join(left.filter(F.col("subset") == full).select("part", F.col("n").alias("_clean")), "part")
    one = at("1").join(alone, F.col("_subset1") == F.col("_one"))
    one = one.join(at("2"), (F.col("_part1") == F.col("_part2")) & (F.col("_rest") == F.col("_subset2")))
    one = one.join(own, F.col("_part1") == F.col("part")).select(F.col("part").alias("_p"), F.col("_filter").alias("_f"), (F.col("_docs") - F.col("n1")).alias("_fails"), (F.col("n2") - F.col("_clean")).alias("unique_fails"))
    before, after = at("b", "n_good", "n_toxic"), at("a", "n_good", "n_toxic")
    pairs = before.join(steps, F.col("_subsetb") == F.col("_before")).join(after, (F.col("_partb") == F.col("_parta")) & (F.col("_after") == F.col("_subseta")))
    done = pairs.join(one, (F.col("_partb") == F.col("_p")) & (F.col("_filter") == F.col("_f"))).withColumn("removed", F.col("nb") - F.col("na"))
    shapley = F.sum("removed").over(Window.partitionBy("_partb", "_filter"))
    return done.select(
        F.col("_partb").alias("part"), "filter_order", "step", F.col("na").alias("kept"), "removed", (F.col("_fails") - F.col("removed")).alias("redundant"), "unique_fails",
        (F.col("n_goodb") - F.col("n_gooda")).alias("good_lost"), (F.col("n_toxicb") - F.col("n_toxica")).alias("toxic_lost"), shapley.alias("shapley"),
    )


def document_audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """The audit of the five filters of ``failures`` over ``docs`` (see there for nulls, copies and empty tables)."""
    counts = written(failures(docs, labels, **columns), "failures")
    out = written(audit(counts, "ABCDE"), "audit")
    discard(counts)
    return out
