"""DuckDB SQL of the registered queries, where SQL can express them."""

from __future__ import annotations


def _rounds(rounds: int = 10) -> str:
    """Rounds of exact k-means: each centroid is a list of integers, each round two queries."""
    to = "(SELECT vec_id, q, min({d: list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(q, c)]), j: j}) AS m FROM v, c%d GROUP BY vec_id, q)"
    parts = [
        """v AS MATERIALIZED (SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS j, q AS c FROM v ORDER BY sha256('3:' || vec_id) LIMIT 8)",
    ]
    for k in range(rounds):
        parts += [
            f"a{k} AS MATERIALIZED {to % k}",
            f"s{k} AS (SELECT m.j AS j, i, sum(q[i]) AS s, count(*) AS n FROM a{k}, range(1, 65) r(i) GROUP BY 1, 2)",
            f"n{k} AS (SELECT j, list(((s - ((s % n) + n) % n) / n)::BIGINT ORDER BY i) AS c FROM (SELECT j, i, s::BIGINT AS s, n FROM s{k}) GROUP BY 1)",
            f"c{k + 1} AS MATERIALIZED (SELECT j, coalesce(n{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN n{k} USING (j))",
        ]
    parts.append(f"z AS MATERIALIZED {to % rounds}")
    return f"""WITH {", ".join(parts)} SELECT vec_id, m.j::INT AS cluster, m.d::BIGINT AS distance, (sum(m.d) OVER (PARTITION BY m.j))::BIGINT AS cluster_inertia,
        (sum(m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM z JOIN c{rounds} ON z.m.j = c{rounds}.j"""


_ROUNDS = _rounds()

ORACLES: dict[str, str] = {
    "op8_chat_format": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
                   UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
        SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(20 + length(regexp_replace(role, '([<\[])(\\*)(/?(s>|INST\]))', '\1\2\\\3', 'g'))
                           + length(regexp_replace(text, '([<\[])(\\*)(/?(s>|INST\]))', '\1\2\\\3', 'g'))) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id""",
    # every 50-byte string of every text, its smallest doc_id, and what the later ones cover
    "op6_suffix_dedup": """
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), n AS (SELECT doc_id, b, octet_length(b) AS n FROM d),
        w AS (SELECT doc_id, i, array_slice(b, i + 1, i + 50) AS s FROM n, range(0, (SELECT max(n) FROM n)) r(i) WHERE i <= n - 50),
        f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY 1), h AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE doc_id > m),
        r AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS new FROM h),
        g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM r),
        k AS (SELECT doc_id, g, min(i) AS a, max(i) + 50 AS z FROM g GROUP BY 1, 2),
        p AS (SELECT k.doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY k.doc_id ORDER BY a), 0) AS y FROM k),
        c AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS last, list(y ORDER BY a) AS ys, list(a ORDER BY a) AS xs FROM p GROUP BY 1)
        SELECT n.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
         sha256(CASE WHEN c.doc_id IS NULL THEN b ELSE list_reduce(list_concat(list_transform(list_zip(ys, xs), lambda t: array_slice(b, t[1] + 1, t[2])), [array_slice(b, last + 1, n)]), lambda x, y: x || y) END) AS kept_sha256
        FROM n LEFT JOIN c USING (doc_id)""",
    # flags of every document, and each step of each order by the documents' sets of failures
    "op13_filter_audit": r"""
        WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
        l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
        w AS (SELECT t.*, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
        d AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
                + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
                + 16 * coalesce(doc_id > first, first IS NOT NULL)::INT AS fails FROM w LEFT JOIN l USING (doc_id)),
        c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY 1, 2),
        f AS (SELECT chr(65 + i::INT) AS f, (1 << i)::INT AS bit FROM range(5) r(i)),
        o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
        s AS (SELECT filter_order, step::INT AS step, substr(filter_order, step::INT, 1) AS f,
                list_sum([1 << (ascii(x) - 65) FOR x IN string_split(substr(filter_order, 1, step::INT - 1), '') IF x <> ''])::INT AS before FROM o, range(1, 6) r(step)),
        p AS (SELECT filter_order, step, f, bit, coalesce(before, 0) AS before FROM s JOIN f USING (f)),
        r AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER ((fails & (before | bit)) = 0), 0) AS kept, coalesce(sum(n) FILTER ((fails & before) = 0 AND (fails & bit) > 0), 0) AS removed,
                coalesce(sum(n) FILTER ((fails & before) > 0 AND (fails & bit) > 0), 0) AS redundant, coalesce(sum(n) FILTER (fails = bit), 0) AS unique_fails,
                coalesce(sum(good) FILTER ((fails & before) = 0 AND (fails & bit) > 0), 0) AS good_lost, coalesce(sum(toxic) FILTER ((fails & before) = 0 AND (fails & bit) > 0), 0) AS toxic_lost
              FROM c, p GROUP BY 1, 2, 3, 4)
        SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
               good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r""",
    # sets of shingles; likely pairs share one of a set's rarest shingles; components by their smallest numbers
    "op11_hyper_minhash": r"""
        WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END AS g FROM w),
        e AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS s FROM g), f AS (SELECT s, count(*) AS c FROM e GROUP BY 1),
        r AS (SELECT doc_id, n, s, row_number() OVER (PARTITION BY doc_id ORDER BY c, s) AS i FROM e JOIN f USING (s)),
        p AS MATERIALIZED (SELECT doc_id, n, s FROM r WHERE i <= n - (4 * n + 4) // 5 + 1),
        q AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m FROM p a JOIN p b ON a.s = b.s AND a.doc_id < b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
        l AS MATERIALIZED (SELECT a, b FROM q JOIN e x ON x.doc_id = a JOIN e y ON y.doc_id = b AND x.s = y.s GROUP BY a, b, q.n, q.m HAVING 5 * count(*) >= 4 * (q.n + q.m - count(*))),
        u AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        z(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, z.c FROM z JOIN u ON z.doc_id = u.a WHERE z.c < u.b),
        k AS (SELECT doc_id, min(c) AS c FROM z GROUP BY 1)
        SELECT g.doc_id, len(g)::BIGINT AS n_shingles, c AS component_id, g.doc_id = c AS kept FROM g JOIN k USING (doc_id)""",
    "op12_centroids": _ROUNDS,
}
