"""DuckDB SQL of the operators whose whole result SQL can restate, each in its plainest form."""

# CRC-32 of short ASCII texts: ``crc(n)`` holds the table of all bytes, ``CRC.format(text)`` the checksum with that table at hand.
CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS n)"""
CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda b: ascii(b)::BIGINT)),
    lambda c, b: xor(c >> 8, n[1 + (xor(c, b) & 255)])), 4294967295)"""

EXACT_DEDUP = """
    WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
    SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256 FROM d
"""

WARC = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
    SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
           list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + ((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
           CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first_id THEN first_id END AS refers_to, true AS intact FROM f
"""

# Every prefix of every rebuilt conversation is named by a hash of its turns; nodes group the names.
PREFIX_TRIE = f"""
    WITH {CRC_TABLE},
    t AS (SELECT conv_id, octet_length(encode(coalesce(text, ''))) AS bytes, turn, coalesce(role, '') AS role,
                 md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS id
          FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT conv_id, id, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, id) - 1 AS pos FROM t),
    convs AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {CRC.format("conv_id::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM own), crc),
    turns AS (SELECT c.conv_id, 0 AS part, o.pos, o.id, o.bytes FROM convs c JOIN own o ON o.conv_id = c.base AND o.pos < c.h
              UNION ALL SELECT c.conv_id, 1, o.pos, o.id, o.bytes FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos >= c.h),
    seqs AS (SELECT c.conv_id, coalesce(list(id || bytes ORDER BY part, pos) FILTER (WHERE id IS NOT NULL), []) AS ids,
                    coalesce(list(bytes ORDER BY part, pos) FILTER (WHERE id IS NOT NULL), []) AS sizes
             FROM convs c LEFT JOIN turns USING (conv_id) GROUP BY c.conv_id),
    paths AS (SELECT conv_id, d, len(ids) AS size, md5(array_to_string(ids[1:d], ',')) AS name,
                     CASE WHEN d > 0 THEN md5(array_to_string(ids[1:d - 1], ',')) END AS above, coalesce(sizes[d], 0) AS bytes
              FROM (SELECT *, unnest(range(len(ids) + 1)) AS d FROM seqs)),
    nodes AS (SELECT name, d, min(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes,
                     sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = d), '')) AS ends_sha256
              FROM paths GROUP BY name, d),
    children AS (SELECT above AS name, count(*) AS n_children FROM nodes GROUP BY above),
    weighed AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * bytes AS saved FROM nodes n LEFT JOIN children USING (name)),
    below AS (SELECT p.name, p.d, sum((w.n_children = 0)::INT) AS n_leaves, sum(w.saved) AS saved_tokens
              FROM weighed w JOIN paths p ON p.conv_id = w.conv_id AND p.d <= w.d GROUP BY p.name, p.d)
    SELECT w.conv_id, w.d::BIGINT AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves::BIGINT AS n_leaves,
           saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
    FROM weighed w JOIN below b ON b.name = w.name AND b.d = w.d LEFT JOIN nodes u ON u.name = w.above AND u.d = w.d - 1
"""

# A run of period q has at least five successive words that equal those q before: all pairs of equal five-word windows of a text, by lag.
PERIODIC_RUNS = f"""
    WITH {CRC_TABLE},
    raw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    hashed AS (SELECT raw.*, len(w) AS n, {CRC.format("coalesce(doc_id, 0)::VARCHAR")} AS h FROM raw, crc),
    cut AS (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM hashed),
    docs AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 AND doc_id IS NOT NULL THEN list_transform(range(n), lambda i:
                 CASE WHEN i < a THEN w[i + 1] ELSE w[1 + a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8))] END) ELSE w END AS w FROM cut),
    words AS (SELECT r, n, unnest(w) AS word, unnest(range(n)) AS i FROM docs),
    grams AS (SELECT r, n, i, md5(word || ' ' || lag(word, 1) OVER x || ' ' || lag(word, 2) OVER x || ' ' || lag(word, 3) OVER x || ' ' || lag(word, 4) OVER x) AS g
              FROM words WINDOW x AS (PARTITION BY r ORDER BY i)),
    again AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS c FROM grams WHERE g IS NOT NULL) WHERE c > 1),
    pairs AS (SELECT a.r, a.i, a.i - b.i AS q FROM again a JOIN again b ON a.r = b.r AND a.g = b.g AND b.i < a.i AND 4 * (a.i - b.i) <= a.n),
    islands AS (SELECT r, q, min(i) AS i, count(*) AS m FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM pairs) GROUP BY r, q, k),
    runs AS (SELECT r, i - 4 - q AS s, m + 4 + q AS l, min(q) AS q FROM islands WHERE m + 4 + q >= greatest(6, 4 * q) GROUP BY r, s, l),
    dropped AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM runs),
    kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (r, i) GROUP BY r),
    lists AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS line FROM runs GROUP BY r),
    best AS (SELECT * FROM runs x WHERE NOT EXISTS (FROM runs y WHERE x.r = y.r AND
             (y.l * x.q > x.l * y.q OR (y.l * x.q = x.l * y.q AND (y.s < x.s OR (y.s = x.s AND y.q < x.q))))))
    SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, l::BIGINT AS length, q::BIGINT AS period,
           (1000 * l // q)::BIGINT AS exponent_milli, sha256(coalesce(line, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
    FROM docs LEFT JOIN lists USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""

# All token combinations of every labelled URL, counted; a URL is blocked when it holds one that is frequent and confident enough.
URL_FILTER = r"""
    WITH u AS (SELECT page_id, coalesce(url, '') AS url, instr(coalesce(url, ''), '://') AS mark FROM pages),
    v AS (SELECT page_id, CASE WHEN mark > 0 THEN substr(url, mark + 3) ELSE '' END AS rest FROM u),
    s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query FROM v),
    parts AS (SELECT page_id, unnest(list_transform(string_split(lower(host), '.'), lambda w: {'kind': 'host:', 'w': w})
                  || list_transform(regexp_split_to_array(lower(path), '[^\p{L}\p{N}]+'), lambda w: {'kind': 'path:', 'w': w})
                  || list_transform(string_split(lower(query), '&'), lambda w: {'kind': 'query:', 'w': w})) AS p FROM s),
    tokens AS (SELECT page_id, list_sort(list(DISTINCT p.kind || p.w)) AS items FROM parts WHERE p.w <> '' AND NOT regexp_full_match(p.w, '\p{N}+') GROUP BY page_id),
    bad AS (SELECT doc_id, max((coalesce(toxic = 1, false) OR coalesce(quality = 0, false))) AS block FROM labels
            WHERE toxic = 1 OR quality = 0 OR (toxic IS NOT NULL AND quality IS NOT NULL) GROUP BY doc_id),
    labelled AS (SELECT s.page_id, coalesce(items, []) AS items, block FROM s JOIN bad ON doc_id = try_cast(regexp_extract(path, '([0-9]{1,18})[^0-9]*$', 1) AS BIGINT)
                 LEFT JOIN tokens USING (page_id)),
    size AS (SELECT count(*) AS n, greatest(10, 0.001 * count(*)) AS least FROM labelled),
    usable AS (SELECT token FROM (SELECT unnest(items) AS token, block FROM labelled), size GROUP BY token, size.n, size.least
               HAVING sum(block::INT) >= size.least AND count(*) < size.n),
    baskets AS (SELECT page_id, block, list(token ORDER BY token) AS items FROM (SELECT page_id, block, unnest(items) AS token FROM labelled) SEMI JOIN usable USING (token)
                GROUP BY page_id, block),
    sets AS (SELECT list_filter(items, lambda t, i: (mask >> (i - 1)) & 1 = 1) AS items, block FROM (SELECT items, block, unnest(range(1, 1 << len(items))) AS mask FROM baskets)),
    mined AS (SELECT items FROM sets, size GROUP BY items, size.least HAVING sum(block::INT) >= size.least AND avg(block::INT) >= 0.8),
    blocked AS (SELECT DISTINCT page_id FROM tokens t, mined m WHERE list_has_all(t.items, m.items)),
    rules AS (FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) AS x(rule_host, rule_path, said)),
    fits AS (SELECT page_id, max_by(rule_host || rule_path, len(rule_host || rule_path)) AS rule, max_by(said, len(rule_host || rule_path)) AS said
             FROM s JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
    SELECT s.page_id, host, path, rule, coalesce(said, CASE WHEN blocked.page_id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
    FROM s LEFT JOIN fits USING (page_id) LEFT JOIN blocked USING (page_id)
"""
