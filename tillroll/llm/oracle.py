"""DuckDB twins of the queries that SQL can express."""

SQL: dict[str, str] = {
    "op7_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
        )
        SELECT DISTINCT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY t) AS kept,
               sha256(t) AS text_sha256
        FROM n
    """,
    "op9_chat_formatting": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), s AS (
            SELECT *,
                   length(role) + length(text)
                   + length(role || text) - length(replace(replace(role || text, '\', ''), '<', ''))
                   + length(role) - length(replace(role, '|', '')) + length('<||><|end|>') AS chars,
                   lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
            FROM t
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(chars)::BIGINT AS formatted_chars,
               bool_and(CASE WHEN role = 'user' THEN coalesce(before, 'system') IN ('system', 'assistant')
                             WHEN role = 'assistant' THEN coalesce(before, '') = 'user'
                             ELSE role = 'system' AND before IS NULL END)
               AND arg_max(role, (turn, role, text)) <> 'system' AS valid
        FROM s GROUP BY conv_id
    """,
}


def _kmeans(rounds: int) -> str:
    """Rounds of K-means one after the other, components in rows."""
    steps = [
        """v AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e
            FROM embeddings
            WHERE len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))
        )""",
        "x AS MATERIALIZED (SELECT r, unnest(range(64)) AS p, unnest(e) AS x FROM v)",
        """c0 AS MATERIALIZED (
            SELECT n, unnest(range(64)) AS p, unnest(e) AS x
            FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, e) - 1 AS n, e FROM v) WHERE n < 8
        )""",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
            SELECT r, min((d, n)) AS m
            FROM (SELECT r, n, sum((x.x - c.x) * (x.x - c.x))::BIGINT AS d FROM x JOIN c{i} c USING (p) GROUP BY r, n) GROUP BY r
        )""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
                SELECT n, p, coalesce((s - ((s % k) + k) % k) // k, x)::BIGINT AS x
                FROM c{i} LEFT JOIN (
                    SELECT m[2] AS n, p, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS k FROM x JOIN a{i} USING (r) GROUP BY ALL
                ) USING (n, p)
            )""")
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, m[2]::INTEGER AS cluster, m[1]::BIGINT AS distance,
               sum(m[1]) OVER (PARTITION BY m[2])::BIGINT AS cluster_inertia, sum(m[1]) OVER ()::BIGINT AS inertia,
               h AS centroid_sha256
        FROM v JOIN a{rounds} USING (r)
        JOIN (SELECT n, sha256(string_agg(x::VARCHAR, ',' ORDER BY p)) AS h FROM c{rounds} GROUP BY n) ON n = m[2]
    """


SQL["op12_vp_kmeans"] = _kmeans(10)
