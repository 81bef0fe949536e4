"""DuckDB SQL for those corpus queries that SQL can express over whole tables."""

from __future__ import annotations

OP7_CHAT = r"""
    WITH t AS (
        SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS seq, role, text,
            CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
            CASE role WHEN 'user' THEN 'turn-' || CAST(turn AS BIGINT) WHEN 'assistant' THEN 'turn-' || (CAST(turn AS BIGINT) - 1) END AS id
        FROM conversations
    ),
    named AS (
        SELECT conv_id, id, count(*) FILTER (kind = 'call') AS calls, count(*) FILTER (kind = 'result') AS results,
            min(seq) FILTER (kind = 'call') AS first_call, min(seq) FILTER (kind = 'result') AS first_result
        FROM t WHERE id IS NOT NULL GROUP BY conv_id, id
    ),
    placed AS (
        -- Each turn depends on the last call before it: as many levels as calls before it.
        SELECT conv_id, seq, coalesce(sum(max(CASE WHEN kind = 'call' THEN 1 ELSE 0 END)) OVER (PARTITION BY conv_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS level
        FROM t WHERE seq IS NOT NULL GROUP BY conv_id, seq
    )
    SELECT t.conv_id, t.seq, t.kind, t.id, CAST(coalesce(p.level, 0) AS INTEGER) AS level,
        CASE WHEN t.kind = 'message' THEN 'message'
            WHEN t.kind = 'result' AND coalesce(n.calls, 0) = 0 THEN 'orphan'
            WHEN t.seq <> CASE t.kind WHEN 'call' THEN n.first_call ELSE n.first_result END THEN 'repeated'
            WHEN t.kind = 'result' THEN 'linked'
            WHEN coalesce(n.results, 0) > 0 THEN 'answered' ELSE 'unanswered' END AS status,
        CASE WHEN t.kind = 'call' AND t.seq IS NULL THEN 'turn: missing' END AS problem,
        '{' || concat_ws(',',
            CASE WHEN t.kind = 'call' THEN '"arguments":{"prompt":' || to_json(coalesce(t.text, '')) || coalesce(',"turn":' || t.seq, '') || '}' END,
            CASE WHEN t.kind <> 'call' THEN '"content":' || to_json(t.text) END,
            '"conversation":' || t.conv_id, '"id":' || to_json(t.id), CASE WHEN t.kind = 'call' THEN '"name":"reply"' END,
            '"role":' || to_json(t.role), '"turn":' || t.seq) || '}' AS json
    FROM t
    LEFT JOIN named n ON t.conv_id IS NOT DISTINCT FROM n.conv_id AND t.id = n.id
    LEFT JOIN placed p ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.seq = p.seq
"""

OP8_URL_GRAPH = r"""
    WITH RECURSIVE rules (host, path, verdict) AS (
        VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
    ),
    page AS (
        SELECT row_number() OVER () AS row_id, page_id, html,
            translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
        FROM pages
    ),
    ruled AS (
        SELECT p.row_id, p.page_id, p.host, p.path, p.html, r.host || r.path AS rule, r.verdict
        FROM page p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
        QUALIFY row_number() OVER (PARTITION BY p.row_id ORDER BY length(r.host || r.path) DESC NULLS LAST) = 1
    ),
    link AS (
        SELECT host AS src, translate(regexp_extract(target, '(?s)//(.*)$', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst
        FROM (SELECT host, unnest(regexp_extract_all(html, '(?is)<[a-z][^<>]*?[\s"''/]href\s*=\s*["'']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^/?#"''\s>]+)', 1)) AS target FROM page)
    ),
    edge AS (SELECT src, dst, count(*) AS n FROM link WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
    flow AS (
        SELECT 'trust' AS way, src AS a, dst AS b, n / sum(n) OVER (PARTITION BY src) AS w FROM edge
        UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM edge
    ),
    seed AS (
        SELECT host, avg(CASE WHEN verdict = 'allow' THEN 1.0 ELSE 0.0 END) AS trust, avg(CASE WHEN verdict = 'block' THEN 1.0 ELSE 0.0 END) AS distrust
        FROM ruled WHERE host <> '' GROUP BY host
    ),
    walk (k, way, host, score) AS (
        SELECT 0, 'trust', host, CAST(trust AS DOUBLE) FROM seed UNION ALL SELECT 0, 'distrust', host, CAST(distrust AS DOUBLE) FROM seed
        UNION ALL
        SELECT walk.k + 1, walk.way, flow.b, sum(flow.w * walk.score * 0.85)
        FROM walk JOIN flow ON flow.way = walk.way AND flow.a = walk.host
        WHERE walk.k < 150 GROUP BY walk.k + 1, walk.way, flow.b
    ),
    scored AS (SELECT host, sum(score) FILTER (way = 'trust') AS trust, sum(score) FILTER (way = 'distrust') AS distrust FROM walk GROUP BY host)
    SELECT r.page_id, r.host, r.path, r.rule,
        coalesce(r.verdict, CASE WHEN coalesce(s.distrust, 0) - coalesce(s.trust, 0) >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
        round(coalesce(s.trust, 0.0), 4) AS trust, round(coalesce(s.distrust, 0.0), 4) AS distrust
    FROM ruled r LEFT JOIN scored s ON r.host = s.host AND r.host <> ''
"""

OP9_EXACT_DEDUP = r"""
    WITH plain AS (
        SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS key
        FROM documents
    )
    SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY key) AS group_size,
        row_number() OVER best = 1 AS kept, sha256(key) AS text_sha256
    FROM plain
    WINDOW best AS (PARTITION BY key ORDER BY length(text) DESC, doc_id NULLS LAST)
"""

_RULES = ("short", "repeats", "symbols", "lines")


def _prior(rule: str) -> str:
    """A rule's mean, and the documents that its prior counts for, over all hosts."""
    mean = f"sum(f_{rule}) / sum(n_docs)"
    spread = f"({mean}) * (1 - {mean})"
    between = f"greatest(var_pop(f_{rule} / n_docs) - {spread} * avg(1 / n_docs), 0)"
    return f"{mean} AS m_{rule}, CASE WHEN {between} > 0 THEN least(greatest({spread} / ({between}) - 1, 1.0), 100.0) ELSE 100.0 END AS c_{rule}"


def _sure(rule: str) -> str:
    rate = f"((f_{rule} + m_{rule} * c_{rule}) / (n_docs + c_{rule}))"
    return f"{rate} - 3.09 * sqrt({rate} * (1 - {rate}) / (n_docs + c_{rule} + 1)) >= greatest(0.25, least(2.0 * m_{rule}, (1 + m_{rule}) / 2))"


OP10_QUALITY = rf"""
    WITH split AS (
        SELECT row_number() OVER () AS row_id, CAST(doc_id AS BIGINT) AS doc_id, source, coalesce(text, '') AS text,
            regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
        FROM documents
    ),
    spans AS (
        SELECT row_id, i, array_to_string(words[i : i + 4], ' ') AS span
        FROM (SELECT row_id, words, unnest(range(1, len(words) - 3)) AS i FROM split WHERE len(words) > 4)
    ),
    often AS (SELECT row_id, i FROM spans QUALIFY count(*) OVER (PARTITION BY row_id, span) > 1),
    covered AS (SELECT row_id, count(DISTINCT i + k) AS n FROM often, range(0, 5) AS r(k) GROUP BY row_id),
    measured AS (
        SELECT s.doc_id, s.source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
            CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
            CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
        FROM split s LEFT JOIN covered c USING (row_id)
    ),
    failed AS (
        SELECT *, n_words < 10 AS short, 100 * n_repeat_words > 20 * n_words AS repeats,
            n_symbols > 0 AND 100 * n_symbols >= 15 * word_chars AS symbols, n_dup_lines > 0 AND 100 * n_dup_lines >= 50 * n_lines AS lines
        FROM measured
    ),
    hosts AS (SELECT source, count(*) AS n_docs, {", ".join(f"CAST(count(*) FILTER ({r}) AS DOUBLE) AS f_{r}" for r in _RULES)} FROM failed GROUP BY source),
    prior AS (SELECT {", ".join(map(_prior, _RULES))} FROM hosts),
    verdicts AS (SELECT source, {" OR ".join(f"({_sure(r)})" for r in _RULES)} AS host_rejected FROM hosts, prior)
    SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed,
        NOT (short OR repeats) AND NOT v.host_rejected AS kept, v.host_rejected
    FROM failed f JOIN verdicts v ON f.source IS NOT DISTINCT FROM v.source
"""

OP12_HARD_NEGATIVES = r"""
    WITH v AS (
        SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
            list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS numbers
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    anchor AS (SELECT * FROM v WHERE vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, len(numbers), numbers) = 1),
    scored AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, CAST(list_inner_product(a.numbers, b.numbers) AS BIGINT) AS score
        FROM anchor a JOIN v b ON len(a.numbers) = len(b.numbers)
    ),
    positive AS (
        SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id NULLS LAST) AS place
        FROM scored WHERE alike AND anchor_id IS DISTINCT FROM other_id QUALIFY place <= 5
    )
    SELECT p.anchor_id, p.other_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.place ORDER BY n.score DESC, n.other_id NULLS LAST) AS INTEGER) AS rank,
        n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
    FROM positive p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.alike AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
    QUALIFY rank <= 3
"""

ORACLE_SQL: dict[str, str] = {"op7_chat": OP7_CHAT, "op8_url_graph": OP8_URL_GRAPH, "op9_exact_dedup": OP9_EXACT_DEDUP, "op10_quality": OP10_QUALITY, "op12_hard_negatives": OP12_HARD_NEGATIVES}
