"""SQL that gives the rows of the training-data queries, where SQL can."""

from __future__ import annotations


def _mixing() -> str:
    """The fitting of ten rounds, unrolled: one common table expression per step."""
    count = "floor((len(t) - len(replace(t, '{m}', ''))) / {n})"
    marks = " + ".join(count.format(m=m, n=3) for m in ("***", "%%%", "###", "$$$", "&&&"))
    steps, last = [], "goals"
    for k in range(10):
        for d in ("source", "lang", "topic"):
            steps.append(
                f"r{k}_{d} AS (SELECT * REPLACE (w * goal_{d} / sum(w) OVER "
                f"(PARTITION BY {d}) AS w) FROM {last})"
            )
            last = f"r{k}_{d}"
        steps.append(f"r{k} AS (SELECT * REPLACE (least(w, tokens) AS w) FROM {last})")
        last = f"r{k}"
    share = "sum(tokens) OVER (PARTITION BY {d}) / sum(tokens) OVER ()"
    return f"""
        WITH described AS (
            SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
                   coalesce(text, '') AS t,
                   len(list_filter(regexp_split_to_array(coalesce(text, ''),
                       '[\\x09-\\x0D ]+'), lambda w: w <> '')) AS n
            FROM documents
        ), docs AS (
            SELECT doc_id, source, lang, n, CASE WHEN n = 0 THEN 'empty'
                WHEN {count.format(m="|", n=1)} * 20 >= n THEN 'tables'
                WHEN {count.format(m="!!", n=2)} * 20 >= n THEN 'shouting'
                WHEN ({marks}) * 20 >= n THEN 'symbols' ELSE 'prose' END AS topic
            FROM described
        ), cells AS (
            SELECT source, lang, topic, sum(n)::DOUBLE AS tokens FROM docs
            GROUP BY ALL HAVING sum(n) > 0
        ), raw AS (
            SELECT *, pow({share.format(d="source")}, 0.7) AS raw_source,
                   pow({share.format(d="lang")}, 0.8) AS raw_lang,
                   CASE topic WHEN 'prose' THEN 0.94 WHEN 'tables' THEN 0.02
                       WHEN 'shouting' THEN 0.02 WHEN 'symbols' THEN 0.02
                       ELSE {share.format(d="topic")} END AS raw_topic
            FROM cells
        ), goals AS (
            SELECT source, lang, topic, tokens, tokens * 0.8 AS w,
                   raw_source / (SELECT sum(x) FROM (SELECT DISTINCT source, raw_source AS x
                       FROM raw)) * sum(tokens) OVER () * 0.8 AS goal_source,
                   raw_lang / (SELECT sum(x) FROM (SELECT DISTINCT lang, raw_lang AS x
                       FROM raw)) * sum(tokens) OVER () * 0.8 AS goal_lang,
                   raw_topic / (SELECT sum(x) FROM (SELECT DISTINCT topic, raw_topic AS x
                       FROM raw)) * sum(tokens) OVER () * 0.8 AS goal_topic
            FROM raw
        ), {", ".join(steps)}
        SELECT doc_id, docs.source, docs.lang, docs.topic, n AS n_tokens,
               coalesce(round(w / tokens, 6), 1.0) AS probability,
               ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix'), 1, 12))::BIGINT
                   / 281474976710656.0::DOUBLE < coalesce(round(w / tokens, 6), 1.0) AS kept
        FROM docs LEFT JOIN {last} USING (source, lang, topic)
    """


ORACLE: dict[str, str] = {
    "op4_mixing": _mixing(),
    "op2_exact_dedup": """
        WITH hashed AS (
            SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents
        )
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, text_sha256
        FROM hashed WINDOW same AS (PARTITION BY text_sha256)
    """,
    "op5_decontamination": """
        WITH words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')),
                '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS ws FROM documents
        ), items AS (
            SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')),
                '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS ws FROM benchmark
        ), doc_words AS (
            SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM words
        ), item_words AS (
            SELECT item_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS ipos
            FROM items
        ), same AS (
            SELECT doc_id, item_id, n, pos - ipos AS shift, ipos,
                   count(*) OVER (PARTITION BY doc_id, item_id, pos - ipos) AS matched,
                   count(*) OVER (PARTITION BY doc_id, item_id, pos - ipos ORDER BY ipos
                       RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS run
            FROM doc_words JOIN item_words USING (w)
            QUALIFY matched >= least(n, 13) - least(n, 13) // 5
        )
        SELECT doc_id, item_id, max(n) AS item_tokens, max(matched) AS matched_tokens
        FROM same WHERE run >= least(n, 13) - least(n, 13) // 5
        GROUP BY doc_id, item_id
    """,
    "op8_chat": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations
            UNION ALL
            SELECT -1, t.turn, t.role, '</s>[INST] ok [/INST]'
            FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(turn, role)
        ), sized AS (
            SELECT *, length(text) + len(regexp_extract_all(text,
                       '</?s>|\[/?INST\]|<</?SYS>>|<</?ROLE>>'))
                   + CASE role WHEN 'user' THEN 16 WHEN 'assistant' THEN 10
                         WHEN 'system' THEN 18 ELSE 30 + length(role) END AS chars
            FROM turns
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
                   AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
                   FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(chars)::BIGINT AS formatted_chars
        FROM sized GROUP BY conv_id
    """,
    "op13_hard_negatives": """
        WITH usable AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.vec_id AS anchor_id, a.label = b.label AS alike, b.vec_id AS other_id,
                   list_inner_product(a.v, b.v)::BIGINT AS score
            FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        ), positives AS (
            SELECT anchor_id, other_id AS positive_id, score AS positive_score
            FROM scored WHERE alike
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
        )
        SELECT anchor_id, positive_id,
               row_number() OVER (PARTITION BY anchor_id, positive_id
                                  ORDER BY score DESC, other_id)::INTEGER AS rank,
               other_id AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN scored USING (anchor_id)
        WHERE NOT alike AND 30 * positive_score <= 100 * score
          AND 100 * score <= 90 * positive_score
        QUALIFY rank <= 10
    """,
}
