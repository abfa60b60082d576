"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .decontaminate import op3_decontaminate, proximity_query
from .exact_repeats import op6_suffix_dedup
from .html_text import op2_html_text
from .langid import op10_langid
from .neighbours import op7_neighbours
from .packing import op8_packing
from .sharding import op4_sharding
from .simhash import op1_simhash
from .token_counts import op5_token_counts
from .warc import op9_warc

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_html_text": op2_html_text,
    "op3_decontaminate": op3_decontaminate,
    "op4_sharding": op4_sharding,
    "op5_token_counts": op5_token_counts,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_neighbours": op7_neighbours,
    "op8_packing": op8_packing,
    "op9_warc": op9_warc,
    "op10_langid": op10_langid,
    "proximity_matches": proximity_query,
}

_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES: dict[str, str] = {
    "op3_decontaminate": f"""
        WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
        i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
        iw AS (SELECT DISTINCT item_id, len(x) AS n, array_to_string(x, ' ') AS g
               FROM (SELECT item_id, w[s : s + least(10, len(w)) - 1] AS x
                     FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0))),
        dw AS (SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS g
               FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
        m AS (SELECT doc_id, s, n, item_id FROM dw JOIN iw USING (n, g)),
        h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "proximity_matches": f"""
        WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
        it AS (SELECT DISTINCT item_id, unnest(w) AS term FROM i),
        d AS (SELECT doc_id, unnest({_WORDS}) AS term, generate_subscripts({_WORDS}, 1) AS pos FROM documents),
        n AS (SELECT term, count(*) AS n FROM d WHERE term IN (SELECT term FROM it) GROUP BY term),
        size AS (SELECT item_id, least(3, count(*)) AS need FROM it GROUP BY item_id),
        r AS (SELECT item_id, term FROM (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY n, term) AS r FROM it JOIN n USING (term)) WHERE r <= 3),
        k AS (SELECT item_id, count(*) AS have FROM r GROUP BY item_id),
        p AS (SELECT doc_id, item_id, need, term, pos FROM d JOIN r USING (term) JOIN size USING (item_id) JOIN k USING (item_id) WHERE have = need)
        SELECT DISTINCT doc_id, item_id FROM (SELECT a.doc_id, a.item_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.pos >= a.pos AND b.pos < a.pos + 30
            GROUP BY a.doc_id, a.item_id, a.pos, a.need HAVING count(DISTINCT b.term) >= a.need)""",
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
        FROM f""",
}
