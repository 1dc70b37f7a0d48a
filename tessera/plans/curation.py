"""Dataset plans: canonical prompt rows, pair and chat shapes, splits, flattening, selection from stage to stage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import answers


def prompt_row(*, source: Column | str, question: Column, ability: str, truth: Column, split: str, index: Column, style: str = "rule", suffix: str = "", extra: dict[str, Column] | None = None) -> list[Column]:
    """The canonical columns: data_source, prompt (turns), ability, reward_model, extra_info."""
    turn = F.struct(F.lit("user").alias("role"), F.concat(question, F.lit(suffix)).alias("content"))
    info = F.struct(F.lit(split).alias("split"), index.alias("index"), *[v.alias(k) for k, v in (extra or {}).items()])
    return [(F.lit(source) if isinstance(source, str) else source).alias("data_source"), F.array(turn).alias("prompt"), F.lit(ability).alias("ability"), F.struct(F.lit(style).alias("style"), truth.alias("ground_truth")).alias("reward_model"), info.alias("extra_info")]


def folded_into_extra(df: DataFrame, keep: Sequence[str], truths: Sequence[str]) -> DataFrame:
    """All other columns move into extra_info; the truth is the first of ``truths`` that is not blank."""
    rest = [c for c in df.columns if c not in keep]
    truth = F.coalesce(*[F.nullif(F.trim(F.col(t).cast("string")), F.lit("")) for t in truths])
    return df.select(*keep, truth.alias("ground_truth"), F.struct(*rest).alias("extra_info"))


def wiki_cleaned(text: Column) -> Column:
    """Trim, "[title]" to a full stop, other brackets out, doubled blanks to one."""
    x = F.replace(F.trim(text), F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(x, r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def pair_rows(df: DataFrame, prompt: str, chosen: str, rejected: str) -> DataFrame:
    """Two rows a preference: the chosen and the rejected response."""
    return df.select(F.col(prompt).alias("prompt"), F.explode(F.array(chosen, rejected)).alias("response"))


def head_split(df: DataFrame, row: str, share: float, n: int) -> tuple[DataFrame, DataFrame]:
    """A split by position."""
    cut = int(n * share)
    return df.filter(F.col(row) < cut), df.filter(F.col(row) >= cut)


def hash_split(df: DataFrame, keys: Sequence[str], share: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """A random split that depends on the row's key and the seed alone, so that reruns and repartitioning agree."""
    part = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1_000_000)) < int(share * 1_000_000)
    return df.filter(part), df.filter(~part)


def chat_roles(messages: Column) -> Column:
    """gpt to assistant and human to user; any other role but system raises."""
    role = lambda r: F.when(r.isin("gpt", "assistant"), "assistant").when(r.isin("human", "user"), "user").when(r == "system", "system").otherwise(F.raise_error(F.concat(F.lit("unknown role "), r)).cast("string"))
    return F.transform(messages, lambda m: F.struct(role(m["role"]).alias("role"), m["content"].alias("content")))


def conversations(turns: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """One row a conversation: its messages in the order of turns."""
    item = F.struct(F.col(turn).alias("t"), F.col(role).alias("role"), F.col(text).alias("content"))
    g = turns.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("_l"))
    return g.select(key, F.transform("_l", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def media_segments(content: Column) -> Column:
    """Typed parts of a content with <image> and <video> marks."""
    parts = F.filter(F.split(content, r"(?<=<image>)|(?=<image>)|(?<=<video>)|(?=<video>)"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.when(p == "<image>", "image").when(p == "<video>", "video").otherwise("text").alias("type"), F.when(~p.isin("<image>", "<video>"), p).alias("text")))


def multiple_choice(question: Column, correct: Column, wrong: Column, seed: Column) -> tuple[Column, Column]:
    """Template with the correct choice at a seeded place among the others, and its letter."""
    at = F.pmod(F.xxhash64(seed), F.size(wrong) + 1).cast("int")
    choices = F.concat(F.slice(wrong, F.lit(1), at), F.array(correct), F.slice(wrong, at + 1, F.size(wrong)))
    lines = F.array_join(F.transform(choices, lambda c, i: F.concat(F.substr(F.lit("ABCDEFGHIJ"), i + 1, F.lit(1)), F.lit(") "), c)), "\n")
    return F.concat(question, F.lit("\n\n"), lines), F.substr(F.lit("ABCDEFGHIJ"), at + 1, F.lit(1))


def continuation_prompt(prompt: Column, start: Column) -> Column:
    """Chat markup of a prompt whose assistant turn has begun."""
    return F.concat(F.lit("<|im_start|>user\n"), prompt, F.lit("<|im_end|>\n<|im_start|>assistant\n"), start)


def with_instruction(text: Column, instruction: str) -> Column:
    return F.when(text.contains(instruction), text).otherwise(F.concat(text, F.lit(" " + instruction)))


def flattened_responses(df: DataFrame, responses: str, id_column: str = "sample_id") -> DataFrame:
    """One row a response, with its number."""
    rest = [c for c in df.columns if c != responses]
    return df.select(*rest, F.posexplode(responses).alias(id_column, "response"))


def first_by(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def oversampled(parts: Sequence[tuple[DataFrame, int]]) -> DataFrame:
    """Tables repeated so many times, one after the other."""
    out = None
    for df, times in parts:
        each = df.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("_k")
        out = each if out is None else out.unionByName(each, allowMissingColumns=True)
    return out


def length_filtered(df: DataFrame, text: str, low: int, high: int) -> DataFrame:
    return df.filter(F.char_length(text).between(low, high))


def renamed_legacy(df: DataFrame, wanted: Sequence[str], legacy: dict[str, str]) -> DataFrame:
    """Accept old column names; a wanted column that is still missing raises."""
    df = df.withColumnsRenamed({old: new for old, new in legacy.items() if old in df.columns and new not in df.columns})
    if missing := [c for c in wanted if c not in df.columns]:
        raise ValueError(f"columns are missing: {missing}")
    return df


def selected_thoughts(rollouts: DataFrame, *, question: str, item: str, correct: str, order: str) -> DataFrame:
    """Stage 4: accuracy of each item over its rollouts, then the best item of each question."""
    from ..operators.advantages import select_best

    acc = rollouts.groupBy(question, item).agg(F.avg(F.col(correct).cast("double")).alias("acc"), F.max_by(F.struct(order), order).alias("_last"))
    return select_best(acc, question, item, "acc")


# --- queries ---
def p19_prompt_rows(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = b.select(*prompt_row(source="bench", question=F.col("text"), ability="math", truth=F.col("item_id").cast("string"), split="test", index=F.col("item_id"), suffix=" Think."))
    return rows.select("data_source", F.col("prompt")[0]["role"].alias("role"), F.md5(F.col("prompt")[0]["content"]).alias("content"), "ability", "reward_model.style", "reward_model.ground_truth", "extra_info.index")


def p27_conversations(spark, sf_dir):
    c = conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", "role", "text")
    m = c.select("conv_id", chat_roles(F.col("messages")).alias("m"))
    return m.select("conv_id", F.size("m").alias("turns"), F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"), F.md5(answers.messages_text(F.col("m"))).alias("digest"))


def p24_pair_rows(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("p"), "o_orderstatus", "o_orderpriority")
    return pair_rows(o, "p", "o_orderstatus", "o_orderpriority")


def r10_length_filtered(spark, sf_dir):
    return length_filtered(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", 100, 1000).select("doc_id")


def u11_flattened(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_partkey")).alias("parts"))
    return flattened_responses(li, "parts").select("l_orderkey", F.col("sample_id").cast("long").alias("sample_id"), "response")


def u12_first_by(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return first_by(d, [F.md5("text")], ["doc_id"]).select("doc_id")


def u14_oversampled(spark, sf_dir):
    r, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation"))
    return oversampled([(r.select(F.col("r_regionkey").alias("key")), 3), (n.select(F.col("n_nationkey").alias("key")), 2)]).groupBy("key").count().withColumnRenamed("count", "n")


def t21_best_turn(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return first_by(li, ["l_orderkey"], [F.desc("l_linenumber"), F.desc("l_quantity"), "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey")


def t18_hash_order(spark, sf_dir):
    """A seeded split: no row in both parts or in none, shares as asked for, and the same from another partitioning."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    a, b = hash_split(o, ["o_orderkey"], 0.9)
    again, _ = hash_split(o.repartition(5, "o_orderkey"), ["o_orderkey"], 0.9)
    n = o.count()
    count = lambda d, name: d.agg(F.count("*").alias(name))
    out = count(a.intersect(b), "both").crossJoin(count(a.union(b).distinct(), "all")).crossJoin(count(a.exceptAll(again), "moved"))
    return out.crossJoin(a.agg((F.abs(F.count("*") / n - 0.9) < 0.01).alias("near")))


def j08_selection(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("ok", F.col("l_returnflag") == "R")
    best = selected_thoughts(li, question="l_suppkey", item="l_linenumber", correct="ok", order="l_orderkey")
    return best.select("l_suppkey", "best_item", *[F.round(c, 6).alias(c) for c in ("best_acc", "acc_mean", "acc_std")])


#: Scores that a task holds at once.
SCORES = 1 << 18


def top_similar(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int, *, block_bytes: int = 32 << 20, digits: int = 6) -> DataFrame:
    """q_id, key, score, rank: the ``k`` vectors of highest cosine for every query vector (a stated set of rows; itself out).

    Queries go in blocks of ``block_bytes``, each broadcast after its size is known; a task multiplies its vectors by the
    block and keeps the ``k`` best of each query, so what is exchanged is ``k`` rows a query and task.  Ties go to the
    smaller key; scores are rounded before they are ranked.
    """
    import numpy as np
    import pyarrow as pa

    unit = lambda x: x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
    width = int(vectors.agg(F.max(F.size(vector))).first()[0] or 1)
    blocks = max(1, -(-queries.count() * width * 8 // block_bytes))
    found = None
    for i in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == i).select(key, F.col(vector).cast("array<double>")).collect()  # about block_bytes
        if not rows:
            continue
        shared = vectors.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows]), unit(np.array([r[1] for r in rows]))))

        def run(batches, shared=shared):
            ids, q = shared.value
            best: list = []
            for b in batches:
                if not b.num_rows:
                    continue
                own = b.column(0).to_numpy()
                v = unit(np.array(b.column(1).to_pylist(), float)).T
                best = best or [np.zeros((len(ids), k), np.int64), np.full((len(ids), k), -np.inf)]
                step = max(1, SCORES // len(own))
                for at in range(0, len(ids), step):  # scores of some queries at a time, whose best stay
                    cut = slice(at, at + step)
                    score = np.round(q[cut] @ v, digits)
                    score[ids[cut, None] == own[None]] = -np.inf
                    part = (np.broadcast_to(own, score.shape), score)
                    every = [np.concatenate([x[cut], y], 1) for x, y in zip(best, part, strict=True)]
                    order = np.lexsort((every[0], -every[1]), axis=1)[:, :k]
                    for x, y in zip(best, every, strict=True):
                        x[cut] = np.take_along_axis(y, order, 1)
            if best:
                keep = np.isfinite(best[1])
                yield pa.RecordBatch.from_pydict({"q_id": np.repeat(ids, keep.sum(1)), key: best[0][keep], "score": best[1][keep]})

        part = vectors.select(key, F.col(vector).cast("array<double>")).mapInArrow(run, f"q_id long, {key} long, score double")
        found = part if found is None else found.union(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], f"q_id long, {key} long, score double, rank int")
    w = Window.partitionBy("q_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def x31_top_similar(spark, sf_dir):
    """Batched retrieval: the three nearest vectors by cosine for every twentieth vector (the stated query set)."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_similar(e, "vec_id", "embedding", e.filter("vec_id % 20 = 0"), 3)


QUERIES = {f.__name__: f for f in (p19_prompt_rows, p27_conversations, p24_pair_rows, r10_length_filtered, u11_flattened, u12_first_by, u14_oversampled, t21_best_turn, t18_hash_order, j08_selection, x31_top_similar)}
ORACLES = {
    "p19_prompt_rows": "SELECT 'bench' AS data_source, 'user' AS role, md5(text || ' Think.') AS content, 'math' AS ability, 'rule' AS style, item_id::VARCHAR AS ground_truth, item_id AS index FROM benchmark",
    "p27_conversations": "SELECT conv_id, count(*)::INT AS turns, string_agg(role, ',' ORDER BY turn) AS roles, md5(string_agg('**' || upper(role[1]) || lower(role[2:]) || '**: ' || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1",
    "p24_pair_rows": "SELECT o_orderkey AS prompt, o_orderstatus AS response FROM orders UNION ALL SELECT o_orderkey, o_orderpriority FROM orders",
    "r10_length_filtered": "SELECT doc_id FROM documents WHERE length(text) BETWEEN 100 AND 1000",
    "u11_flattened": "SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - 1 AS sample_id, l_partkey AS response FROM lineitem",
    "u12_first_by": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
    "u14_oversampled": "SELECT key, CAST(sum(n) AS BIGINT) AS n FROM (SELECT r_regionkey AS key, 3 AS n FROM region UNION ALL SELECT n_nationkey, 2 FROM nation) GROUP BY 1",
    "t21_best_turn": "SELECT l_orderkey, l_linenumber, l_quantity, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_quantity DESC, l_partkey, l_suppkey) = 1",
    "t18_hash_order": 'SELECT 0::BIGINT AS "both", count(*) AS "all", 0::BIGINT AS moved, true AS near FROM orders',
    "j08_selection": "WITH a AS (SELECT l_suppkey, l_linenumber, avg((l_returnflag = 'R')::INT) AS acc FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY acc DESC, l_linenumber) AS k FROM a) SELECT l_suppkey, max(l_linenumber) FILTER (k = 1) AS best_item, round(max(acc), 6) AS best_acc, round(avg(acc), 6) AS acc_mean, round(stddev_pop(acc), 6) AS acc_std FROM r GROUP BY 1",
    "x31_top_similar": "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings) SELECT q.vec_id AS q_id, e.vec_id, round(list_dot_product(e.v, q.v) / e.n / q.n, 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(e.v, q.v) / e.n / q.n, 6) DESC, e.vec_id)::INT AS rank FROM e JOIN e q ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id QUALIFY rank <= 3",
}
