"""DuckDB SQL for the queries of this subpackage that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha256(html) AS digest FROM p),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f"""

COMPONENTS = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s FROM words),
classes AS (SELECT min(doc_id) AS rep, len(s) AS n, s FROM sets WHERE len(s) > 0 GROUP BY s),
grams AS (SELECT rep, n, unnest(s) AS g FROM classes),
links AS (
  SELECT a.rep AS a, b.rep AS b FROM grams a JOIN grams b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS node, a AS seen FROM both_ways UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON reach.seen = both_ways.a),
roots AS (SELECT node, min(seen) AS root FROM reach GROUP BY node)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(root, rep, sets.doc_id) AS component_id, sets.doc_id = coalesce(root, rep, sets.doc_id) AS kept
FROM sets LEFT JOIN classes ON classes.s = sets.s AND len(sets.s) > 0 LEFT JOIN roots ON roots.node = rep"""

SHARDS = """
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc,
  list_transform(range(256), lambda i: printf('%02X', i)) AS hex),
bytes AS (SELECT map_from_entries(list_zip(t.hex, range(256))) AS of_hex FROM t),
d AS (SELECT row_number() OVER () AS k, doc_id, strlen(coalesce(text, '')) + 8 AS size,
  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: of_hex[h]) AS b FROM documents CROSS JOIN bytes),
c AS (SELECT k, doc_id, size, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t.crc[1 + (xor(c, x) & 255)])), 4294967295) AS text_crc32 FROM d CROSS JOIN t),
jump AS (
  SELECT n, key, (CASE WHEN key < 0 THEN key + 18446744073709551616 ELSE key END)::HUGEINT AS state, -1::BIGINT AS b, 0::BIGINT AS j
  FROM (SELECT DISTINCT coalesce(doc_id, 0)::HUGEINT AS key FROM documents) CROSS JOIN (SELECT unnest([24, 25]) AS n)
  UNION ALL
  SELECT n, key, s, j, floor((j + 1) * (2147483648e0 / ((s // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, (state * 2862933555777941757 + 1) % 18446744073709551616 AS s FROM jump WHERE j < n)),
shards AS (SELECT key, max(CASE WHEN n = 24 THEN b END) AS shard, max(CASE WHEN n = 25 THEN b END) AS grown FROM jump WHERE j >= n GROUP BY key)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM c JOIN shards ON coalesce(doc_id, 0) = key"""

ORACLES = {"op3_warc_chunks": WARC, "op5_jump_shards": SHARDS, "op8_minhash_components": COMPONENTS}

#: Drawing by importance: unsigned CRC-32 as in SHARDS, over distinct words only.
IMPORTANCE = rf"""
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc,
  list_transform(range(256), lambda i: printf('%02X', i)) AS hex),
bytes AS (SELECT map_from_entries(list_zip(t.hex, range(256))) AS of_hex FROM t),
raw AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
wanted AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
features AS (SELECT k, unnest(w) AS word FROM raw),
counts AS (SELECT word, sum(a) AS s, sum(b) AS t FROM (SELECT word, 1 AS a, 0 AS b FROM features UNION ALL SELECT word, 0, 1 FROM wanted) GROUP BY word),
spelt AS (SELECT word, s, counts.t, list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda h: of_hex[h]) AS b FROM counts CROSS JOIN bytes),
hashed AS (SELECT word, s, spelt.t, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t.crc[1 + (xor(c, x) & 255)])), 4294967295) % 10000 AS bucket FROM spelt CROSS JOIN t),
sums AS (SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM hashed GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM sums),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::BIGINT AS gain FROM sums CROSS JOIN totals),
weights AS (SELECT k, floor(sum(gain) / count(*)::DOUBLE)::BIGINT AS weight FROM features JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY k),
scored AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM raw LEFT JOIN weights USING (k)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, weight, n_features) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= n * 10 // 100 THEN place END AS rank FROM placed"""


def _clusters(clusters: int = 40, rounds: int = 5) -> str:
    """Lloyd's rounds one after another, each with all distances."""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY d, v) - 1 AS c, v FROM (SELECT sha256('2:' || vec_id) AS d, v FROM v ORDER BY d, v LIMIT {clusters}))",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT r, arg_min({{'c': c, 'd': d}}, {{'d': d, 'c': c}}) AS best FROM (SELECT r, c, list_sum(list_transform(list_zip(v.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v CROSS JOIN c{i}) GROUP BY r)""")
        if i < rounds:
            parts.append(f"m{i} AS MATERIALIZED (SELECT c, list(x ORDER BY i) AS v FROM (SELECT best.c AS c, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS x FROM a{i} JOIN v USING (r) CROSS JOIN (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL) GROUP BY c)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c))")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(f.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN v USING (r) JOIN c{rounds} f ON f.c = best.c"""


CLUSTERS = _clusters()
ORACLES |= {"op12_importance_resampling": IMPORTANCE, "op13_annulus_clusters": CLUSTERS}
