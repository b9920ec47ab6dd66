"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL: dict[str, str] = {}

SQL["op2_exact_dedup"] = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS x FROM documents),
g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256
FROM t JOIN g USING (x)
"""

# Words, windows and hits are spelled out here again, independently of the operators.
SQL["op3_decontamination"] = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS x FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS x FROM benchmark),
items AS (SELECT item_id, x, least(10, len(x)) AS n FROM b WHERE len(x) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(x[i:i + n - 1], ' ') AS win
            FROM (SELECT item_id, n, x, unnest(range(1, (len(x) - n + 2)::BIGINT)) AS i FROM items)),
sizes AS (SELECT DISTINCT n FROM windows),
starts AS (SELECT doc_id, n, i, array_to_string(x[i:i + n - 1], ' ') AS win
           FROM (SELECT doc_id, n, x, unnest(range(1, (len(x) - n + 2)::BIGINT)) AS i FROM w CROSS JOIN sizes WHERE len(x) >= n)),
found AS (SELECT doc_id, s.n, i, item_id FROM starts s JOIN windows v ON s.win = v.win AND s.n = v.n),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS names
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS t FROM found) GROUP BY doc_id)
SELECT w.doc_id, len(x)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

SQL["op5_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x{20}\x{09}-\x{0D}]+') AS x FROM documents),
starts AS (SELECT doc_id, i, array_to_string(x[i:i + 12], ' ') AS win
           FROM (SELECT doc_id, x, unnest(range(1, (len(x) - 11)::BIGINT)) AS i FROM w WHERE len(x) >= 13)),
firsts AS (SELECT win, min(doc_id) AS first_id FROM starts GROUP BY win),
gone AS (SELECT DISTINCT doc_id, k FROM (
           SELECT s.doc_id, unnest(range(i, i + 13)) AS k FROM starts s JOIN firsts f ON s.win = f.win WHERE first_id < s.doc_id)),
words AS (SELECT doc_id, unnest(x) AS word, unnest(range(1, (len(x) + 1)::BIGINT)) AS k FROM w),
kept AS (SELECT words.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY words.k) AS txt
         FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.k = gone.k GROUP BY words.doc_id)
SELECT w.doc_id, len(x)::BIGINT AS n_words, (len(x) - coalesce(n_kept, 0))::BIGINT AS n_removed,
       sha256(coalesce(txt, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

SQL["op9_url_filter"] = f"""
WITH rules(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
                                             ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
split AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
                 regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
judged AS (SELECT page_id, host, path, rhost || rpath AS rule, verdict,
                  row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST, length(rhost) DESC) AS k
           FROM split LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM judged WHERE k = 1
"""
