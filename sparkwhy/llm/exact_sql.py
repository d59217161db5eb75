"""DuckDB SQL for near-duplicates, near vectors and archived pages, by comparing what has anything in common."""

SPACE = r"[\x20\x09-\x0D]"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Smallest id reachable over links (a, b), for every id of nodes (id).
_REACH = """
ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT id, id AS seen FROM nodes UNION SELECT reach.id, ends.b FROM reach JOIN ends ON ends.a = reach.seen),
lowest AS (SELECT id, min(seen) AS component_id FROM reach GROUP BY id)
"""


def near_duplicates(width: int, percent: int) -> str:
    """Documents whose sets of ``width``-word shingles have a Jaccard similarity of ``percent`` / 100."""
    pieces = ", ".join(f"ws[i + {k}]" for k in range(width))
    return f"""
WITH RECURSIVE nodes AS (SELECT doc_id AS id FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '{SPACE}+'), lambda x: x <> '') AS ws FROM documents),
s AS (
    SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {width} THEN [list_aggregate(ws, 'string_agg', ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - {width - 2}), lambda i: concat_ws(' ', {pieces}))) END AS found
    FROM w),
z AS (SELECT doc_id, len(found) AS n FROM s),
e AS (SELECT doc_id, unnest(found) AS shingle FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM e x JOIN e y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM p JOIN z v ON v.doc_id = a JOIN z u ON u.doc_id = b WHERE 100 * shared >= {percent} * (v.n + u.n - shared)),
{_REACH}
SELECT doc_id, n::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM z JOIN lowest ON id = doc_id
"""


NEAR_VECTORS = f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS id FROM embeddings),
v AS (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.9),
{_REACH},
n AS (SELECT a, count(*) AS n FROM ends GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept FROM lowest LEFT JOIN n ON a = id
"""

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
ARCHIVED = f"""
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT *, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS first FROM p),
c AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(hex, i * 5 + 1, 5))::BIGINT) AS five FROM d)
SELECT page_id, url, octet_length(payload)::BIGINT AS payload_bytes,
    list_aggregate(list_transform(five, lambda x: substr({_LETTERS}, (x >> 15) % 32 + 1, 1) || substr({_LETTERS}, (x >> 10) % 32 + 1, 1)
        || substr({_LETTERS}, (x >> 5) % 32 + 1, 1) || substr({_LETTERS}, x % 32 + 1, 1)), 'string_agg', '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM c
"""
