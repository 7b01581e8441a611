"""DuckDB SQL oracles.

Each query is one ANSI-ish SQL statement over the pre-registered views
(documents, events, embeddings, pages, conversations, ...).  The fixture
derivations (FIXTURES.md) are shared CTEs; ``sql(body, *ctes)`` prepends the
CTEs a body needs, dependencies first.
"""

from __future__ import annotations

# Unicode whitespace as Python's str.split() sees it, spelled out for RE2
# (whose \s is ASCII only).
WS_CLASS = (r"[\t\n\x0b\f\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+")


def clean(expr: str) -> str:
    s = f"regexp_replace(coalesce({expr}, ''), '<[^>]+>', ' ', 'g')"
    for a, b in [("&amp;", "&"), ("&gt;", ">"), ("&lt;", "<"), ("&#x27;", "''"), ("&quot;", '"')]:
        s = f"replace({s}, '{a}', '{b}')"
    return f"trim(regexp_replace({s}, '{WS_CLASS}', ' ', 'g'))"


def l2n(v: str) -> str:
    """L2-normalised DOUBLE list; zero vector unchanged."""
    d = f"list_transform({v}, lambda x: CAST(x AS DOUBLE))"
    n = f"sqrt(list_sum(list_transform({v}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"
    return f"(CASE WHEN {n} > 0 THEN list_transform({d}, lambda x: x / {n}) ELSE {d} END)"


def sqdist(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))"


def dotp(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


def norm(a: str) -> str:
    return f"sqrt(list_sum(list_transform({a}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"


def terms(expr: str, min_len: int = 1) -> str:
    return (f"list_filter(regexp_split_to_array(lower({expr}), '[^\\p{{L}}]+'), "
            f"lambda t: length(t) >= {max(min_len, 1)})")


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "de": ((), """
        SELECT d.doc_id, d.text, d.source, d.lang, e.ts, e.value
        FROM documents d JOIN events e
          ON e.event_id = (d.doc_id * 7919) % (SELECT count(*) FROM events)"""),
    "hits": (("de",), """
        SELECT CASE WHEN doc_id % 2 = 0 THEN 'story' ELSE 'comment' END AS content_type,
               CAST((doc_id // 2) // 50 AS INTEGER) AS page,
               CAST((doc_id // 2) % 50 AS INTEGER) AS pos,
               CASE WHEN doc_id % 11 = 10 THEN CAST(doc_id - 1 AS VARCHAR) ELSE CAST(doc_id AS VARCHAR) END AS objectID,
               CASE WHEN doc_id % 2 = 0 AND doc_id % 9 <> 0
                    THEN CASE WHEN doc_id % 4 = 0 THEN substring(text, 1, 60) ELSE text END END AS title,
               CASE WHEN doc_id % 2 = 0 AND doc_id % 9 = 0 THEN '<p>' || replace(text, chr(10), '<br>')
                    WHEN doc_id % 2 = 0 AND doc_id % 4 = 0
                    THEN '<p>' || replace(substr(text, 61), chr(10), '<br>') END AS story_text,
               CASE WHEN doc_id % 2 = 1
                    THEN '<p>' || replace(text, chr(10), '<br>') || ' &amp;amp; &lt;i&gt;' END AS comment_text,
               CASE WHEN doc_id % 13 <> 0 THEN CAST(epoch_us(ts) // 1000000 AS BIGINT) END AS created_at_i,
               CASE WHEN doc_id % 7 <> 0 THEN CAST(floor(value) AS BIGINT) END AS points,
               CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 THEN NULL
                    ELSE 'https://example.org/' || CAST(doc_id AS VARCHAR) END AS url,
               (CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END) * 1000000000000
                 + ((doc_id // 2) // 50) * 1000000 + (doc_id // 2) % 50 AS ord
        FROM de"""),
    "hits_gap": (("hits",), "SELECT * FROM hits WHERE page <> 3"),
    "posts_all": (("hits",), f"""
        SELECT objectID AS id,
               {clean("CASE WHEN content_type = 'story' THEN coalesce(title, '') || ' ' || coalesce(story_text, '') ELSE coalesce(comment_text, '') END")} AS text,
               'Hacker News' AS source, 'hackernews' AS platform,
               make_timestamp(coalesce(created_at_i, 0) * 1000000) AS created_at,
               CAST(coalesce(points, 0) AS BIGINT) AS score,
               coalesce(nullif(url, ''), 'https://news.ycombinator.com/item?id=' || coalesce(objectID, 'None')) AS url,
               ord, content_type, page
        FROM hits"""),
    "posts": (("posts_all",), """
        SELECT id, text, source, platform, created_at, score, url, ord, content_type
        FROM posts_all WHERE length(text) >= 40"""),
    "vectors": ((), """
        SELECT CAST(vec_id AS VARCHAR) AS id, embedding, label, vec_id AS ord FROM embeddings"""),
    "clustered": (("de",), """
        SELECT CAST(de.doc_id AS VARCHAR) AS id, de.text, de.source, de.lang,
               de.ts AS created_at, CAST(floor(de.value) AS BIGINT) AS score,
               de.doc_id AS ord, e.label AS cluster, e.embedding
        FROM de JOIN embeddings e ON e.vec_id = de.doc_id % (SELECT count(*) FROM embeddings)"""),
    "labels": (("clustered",), """
        SELECT DISTINCT cluster, 'Theme ' || CAST(cluster AS VARCHAR) AS label FROM clustered"""),
    "centroids": ((), """
        SELECT cluster, list(m ORDER BY pos) AS center FROM (
          SELECT label AS cluster, pos, avg(CAST(x AS DOUBLE)) AS m FROM (
            SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos
            FROM embeddings) GROUP BY label, pos) GROUP BY cluster"""),
    "pairs": ((), """
        SELECT CAST(a.vec_id AS VARCHAR) AS id_a, CAST(b.vec_id AS VARCHAR) AS id_b
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""),
}


def _order(names) -> list[str]:
    seen: list[str] = []

    def visit(n):
        if n in seen:
            return
        for dep in CTES[n][0]:
            visit(dep)
        seen.append(n)
    for n in names:
        visit(n)
    return seen


def sql(body: str, *ctes: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` the named fixture CTEs (plus ``extra`` (name, sql) pairs) ``body``."""
    parts = [f"{n} AS ({CTES[n][1]})" for n in _order(ctes)]
    parts += [f"{n} AS ({q})" for n, q in (extra or [])]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
