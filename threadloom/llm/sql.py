"""DuckDB SQL that gives the same rows as the queries, over whole tables."""

from __future__ import annotations

from . import license_scan, mixing, sharding, url_filter

ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def rows_a_group(n: str) -> str:
    return f"least(100000, greatest(500, floor(4 * sqrt({n}))::BIGINT))"


def op1(shards: int = 24, table: str = "documents") -> str:
    """Checksums need every byte, so the polynomial's table is built by recursion and texts are folded byte by byte."""
    jump = lambda n: f"""
      SELECT key, max_by(b, i)::INTEGER AS shard FROM j{n} WHERE b >= 0 GROUP BY key"""  # noqa: E731
    steps = lambda n: f"""j{n}(key, i, k, b, j) AS (
      SELECT DISTINCT coalesce(doc_id, 0), 0, ((coalesce(doc_id, 0)::HUGEINT + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT)::HUGEINT, -1::BIGINT, 0::BIGINT FROM {table}
      UNION ALL
      SELECT key, i + 1, nk, j, floor((j + 1) * (2147483648.0::DOUBLE / ((nk // 8589934592::HUGEINT) + 1)::DOUBLE))::BIGINT
      FROM (SELECT key, i, b, j, (k * {sharding.MULTIPLIER}::HUGEINT + 1) % 18446744073709551616::HUGEINT AS nk FROM j{n} WHERE j < {n}))"""  # noqa: E731
    return f"""
    WITH RECURSIVE {steps(shards)}, {steps(shards + 1)},
    bits(i, n, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, n + 1, xor(c // 2, (c % 2) * 3988292384) FROM bits WHERE n < 8),
    tbl AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE n = 8),
    texts AS (SELECT DISTINCT text FROM {table} WHERE text IS NOT NULL),
    hexed AS MATERIALIZED (SELECT text, hex(encode(text)) AS h FROM texts),
    bytes AS (SELECT text, list_transform(range(length(h) // 2), lambda p: ('0x' || substr(h, 2 * p + 1, 2))::BIGINT) AS bs FROM hexed),
    crcs AS MATERIALIZED (SELECT text, xor(list_reduce(bs, lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1]), 4294967295::BIGINT), 4294967295) AS crc FROM bytes, tbl),
    placed AS (
      SELECT d.doc_id, coalesce(strlen(d.text), 0) + 8 AS size, c.crc AS text_crc32, a.shard, g.shard AS grown_shard,
             count(*) OVER (PARTITION BY a.shard) AS n, {rows_a_group("count(*) OVER ()")} AS rows
      FROM {table} d LEFT JOIN crcs c ON d.text = c.text
      JOIN ({jump(shards)}) a ON a.key = coalesce(d.doc_id, 0) JOIN ({jump(shards + 1)}) g ON g.key = coalesce(d.doc_id, 0)),
    dealt AS (SELECT *, (((coalesce(doc_id, 0) % 2147483648) + 2147483648) % 2147483648 + size + coalesce(text_crc32, 0)) % greatest(1, ceil(n / rows)::BIGINT) AS grp FROM placed)
    SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard,
           row_number() OVER (PARTITION BY shard ORDER BY grp, doc_id NULLS FIRST, size, text_crc32 NULLS FIRST) - 1 AS slot, grown_shard
    FROM dealt"""


def op2() -> str:
    rules = ", ".join(f"('{r.name}', '{r.host}', '{r.path}', '{r.verdict}')" for r in url_filter.RULES)
    return f"""
    WITH rules(name, rhost, rpath, rverdict) AS (VALUES {rules}),
    rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
    parts AS (SELECT row_number() OVER () AS rn, page_id, {ASCII_LOWER.format("regexp_extract(r, '^[^/?#]*')")} AS host,
                     regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
    fits AS (SELECT p.rn, max_by(struct_pack(name := name, verdict := rverdict), length(name)) AS best FROM parts p JOIN rules
             ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY p.rn)
    SELECT page_id, host, path, best.name AS rule, coalesce(best.verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (rn)"""


def op3() -> str:
    """Containment in every window of every class, without retrieval by signatures."""
    n = license_scan.SHINGLE
    templates = ", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in license_scan.TEMPLATES.items())
    words = WORDS.format(ASCII_LOWER.format("text"))
    return f"""
    WITH templates(license, text) AS (VALUES {templates}),
    tw AS (SELECT license, {words} AS w FROM templates),
    tg AS (SELECT DISTINCT license, w[i + 1 : i + {n}] AS gram FROM tw, unnest(range(greatest(len(w) - {n}, 0) + 1)) t(i)),
    sizes AS (SELECT license, count(*) AS size, pow(2, ceil(log2(count(*))))::BIGINT AS class FROM tg GROUP BY license),
    docs AS (SELECT row_number() OVER () AS rn, doc_id, coalesce({words}, []) AS w FROM documents),
    places AS (SELECT rn, p, w[p + 1 : p + {n}] AS gram FROM docs, unnest(range(greatest(len(w) - {n}, 0) + 1)) t(p) WHERE len(w) > 0),
    held AS (SELECT rn, license, class, size, gram, p // class AS number FROM places JOIN tg USING (gram) JOIN sizes USING (license)),
    within AS (SELECT rn, license, size, number, gram FROM held UNION SELECT rn, license, size, number - 1, gram FROM held WHERE number > 0),
    found AS (SELECT DISTINCT rn, license FROM (SELECT rn, license FROM within GROUP BY rn, license, size, number HAVING count(DISTINCT gram) >= {license_scan.CONTAINMENT} * size)),
    named AS (SELECT rn, count(*) AS n, string_agg(license, ',' ORDER BY license) AS names FROM found GROUP BY rn)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_licenses, coalesce(names, '') AS licenses, len(w)::BIGINT AS n_words FROM docs LEFT JOIN named USING (rn)"""


def op5(table: str = "documents") -> str:
    cls = "CASE WHEN size < 16 THEN size ELSE 8 * (floor(log2(size))::BIGINT - 2) + (size >> (floor(log2(size))::INTEGER - 3)) - 8 END"
    return f"""
    WITH sized AS (SELECT doc_id, source, coalesce(strlen(text), 0) AS octets, coalesce(length(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM {table}),
    total AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
    weighed AS (SELECT *, [{", ".join(map(str, mixing.WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS w FROM total),
    filling AS (SELECT *, (source_size * {mixing.MOST})::DOUBLE / w AS full_at FROM weighed),
    levels AS (SELECT *, ((sum(source_size) OVER () - coalesce(sum(source_size * {mixing.MOST}) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                          / sum(w) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE) AS lv FROM filling),
    level AS (SELECT min_by(lv, full_at) AS lv FROM levels WHERE lv <= full_at),
    aims AS (SELECT source, source_size, coalesce(CASE WHEN full_at <= level.lv THEN (source_size * {mixing.MOST})::DOUBLE ELSE level.lv * w END, 0) AS target FROM levels LEFT JOIN level ON true),
    dealt AS (SELECT *, count(*) OVER (PARTITION BY source, {cls}) AS n, {rows_a_group("count(*) OVER ()")} AS rows FROM sized),
    ranked AS (SELECT s.*, a.source_size, a.target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
                      row_number() OVER (PARTITION BY s.source ORDER BY {cls}, (((coalesce(doc_id, 0) % 2147483648) + 2147483648) % 2147483648 + octets) % greatest(1, ceil(n / rows)::BIGINT),
                                         size, doc_id NULLS FIRST, octets) AS rk,
                      ('0x' || substr(md5('{mixing.SEED} ' || coalesce(s.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS o
               FROM dealt s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source)
    SELECT doc_id, size, source_size, target, ((floor(rk * rate + o) - floor((rk - 1) * rate + o))::BIGINT * size)::BIGINT AS taken FROM ranked"""


def op6(k: int = 20) -> str:
    return f"""
    WITH valid AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                     AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM valid q JOIN valid c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {k}"""


def op9(least: int = 100) -> str:
    return f"""
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT *, CASE WHEN payload_bytes >= {least} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
    SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""


def op10(n: int = 10) -> str:
    return f"""
    WITH items AS (SELECT item_id::VARCHAR AS item, {WORDS.format(ASCII_LOWER.format("text"))} AS w FROM benchmark WHERE item_id IS NOT NULL),
    windows AS (SELECT DISTINCT item, w[i + 1 : i + {n}] AS win FROM items, unnest(range(greatest(len(w) - {n}, 0) + 1)) t(i) WHERE len(w) > 0),
    lens AS (SELECT DISTINCT len(win) AS l FROM windows),
    docs AS (SELECT row_number() OVER () AS rn, doc_id, coalesce({WORDS.format(ASCII_LOWER.format("text"))}, []) AS w FROM documents),
    places AS (SELECT rn, p, l, w[p + 1 : p + l] AS win FROM docs, lens, unnest(range(len(w) - l + 1)) t(p) WHERE len(w) >= l),
    hits AS (SELECT rn, p, l, item FROM places JOIN windows USING (win)),
    words AS (SELECT rn, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT rn, p, l FROM hits), unnest(range(p, p + l)) t(q) GROUP BY rn),
    held AS (SELECT rn, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY rn)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN words USING (rn) LEFT JOIN held USING (rn)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": op1(), "op2_url_filters": op2(), "op3_license_scan": op3(), "op5_mixing": op5(), "op6_ann": op6(), "op9_warc": op9(), "op10_decontamination": op10()}
