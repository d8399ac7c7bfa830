"""SQL (DuckDB) for the rows of those queries that SQL can express."""

# Links within a label by cosine, and what they reach.
EMBEDDINGS = """
WITH RECURSIVE sound AS (
  SELECT vec_id, label, embedding::DOUBLE[] v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id a, b.vec_id b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) n_links,
  least(e.vec_id, coalesce((SELECT min(b) FROM reach WHERE a = e.vec_id), e.vec_id)) component_id,
  e.vec_id = least(e.vec_id, coalesce((SELECT min(b) FROM reach WHERE a = e.vec_id), e.vec_id)) kept
FROM embeddings e
"""

# Jump hashing by its loop, for 8 and for 9 shards; CRC-32 by its table, byte for byte.
SHARDING = """
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i::UBIGINT FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) t FROM bits WHERE k = 8),
docs AS (SELECT row_number() OVER () r, doc_id, strlen(coalesce(text, '')) + 1 size, hex(encode(coalesce(text, ''))) h FROM documents),
crc AS (SELECT r, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, 2 * size - 2, 2), lambda k: ('0x' || substr(h, k, 2))::UBIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT c FROM docs, tab),
jump(r, n, state, b, j) AS (
  SELECT r, n, (coalesce(doc_id, 0)::HUGEINT + CASE WHEN doc_id < 0 THEN 18446744073709551616 ELSE 0 END)::UHUGEINT, -1::BIGINT, 0::BIGINT FROM docs, (VALUES (8), (9)) x(n)
  UNION ALL
  SELECT r, n, s, j, floor((j + 1) * (2147483648.0::DOUBLE / ((s // 8589934592)::DOUBLE + 1)))::BIGINT
  FROM (SELECT r, n, (state * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616::UHUGEINT s, j FROM jump WHERE j < n)),
placed AS (SELECT r, max(b) FILTER (WHERE n = 8) shard, max(b) FILTER (WHERE n = 9) grown FROM jump GROUP BY r)
SELECT doc_id, size::BIGINT size, c text_crc32, 'key' law, shard::INT shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, c) - 1 slot, grown::INT grown_shard
FROM docs JOIN crc USING (r) JOIN placed USING (r)
"""

# All pairs that share a five-word n-gram, and what their links reach.
JACCARD = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w FROM documents),
grams AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda k: array_to_string(w[k:k + 4], ' '))) g FROM w WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) n FROM grams GROUP BY 1),
links AS (SELECT a, b FROM (SELECT x.doc_id a, y.doc_id b, count(*) common FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE common >= 0.8 * (p.n + q.n - common)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, CASE WHEN s.doc_id IS NULL THEN NULL ELSE least(d.doc_id, coalesce(m.b, d.doc_id)) END class_id, coalesce(c.n, 0) n_links
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) b FROM reach GROUP BY 1) m ON m.a = d.doc_id
LEFT JOIN (SELECT a, count(*) n FROM links GROUP BY 1) c ON c.a = d.doc_id
"""

# SHA-1 in base 32, twenty bits at a time.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') body, sha1(coalesce(html, '')) h FROM pages),
named AS (SELECT page_id, strlen(body) payload_bytes, array_to_string(list_transform(range(0, 32), lambda k:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * (k // 4) + 1, 5))::INT >> (15 - 5 * (k % 4))) & 31) + 1, 1)), '') payload_digest,
  max(page_id) OVER (PARTITION BY body) first FROM p)
SELECT page_id, payload_bytes::BIGINT payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END record_type,
  CASE WHEN page_id <> first THEN first END refers_to FROM named
"""

# Each item's best documents, by terms counted in whole numbers.
SEARCH = r"""
WITH t AS (SELECT row_number() OVER () r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w FROM documents),
q AS (SELECT item_id, term, count(*) k FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term FROM benchmark) GROUP BY 1, 2),
g AS (SELECT count(*) n_docs, sum(len(w))::BIGINT len_all FROM t WHERE len(w) > 0),
tf AS (SELECT r, term, count(*) tf FROM (SELECT r, unnest(w) term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
weight AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT w FROM tf, g GROUP BY term, n_docs),
part AS (SELECT r, term, weight.w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * len(t.w) * n_docs) // len_all))) s FROM tf JOIN t USING (r) JOIN weight USING (term), g),
score AS (SELECT item_id, r, sum(k * s)::BIGINT score FROM q JOIN part USING (term) GROUP BY 1, 2)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM score JOIN t USING (r) WHERE score > 0
QUALIFY rank <= 20
"""

# Windows of twenty words that start earlier elsewhere, and the words outside them.
WINDOWS = r"""
WITH d AS (SELECT row_number() OVER () r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
wins AS (SELECT r, doc_id, k, md5(array_to_string(w[k:k + 19], ' ')) h FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 18)) k FROM d)),
cover AS (SELECT DISTINCT r, unnest(range(k, k + 20)) i FROM (SELECT r, k, rank() OVER (PARTITION BY h ORDER BY doc_id NULLS FIRST, k) n FROM wins) WHERE n > 1),
word AS (SELECT r, unnest(w) x, generate_subscripts(w, 1) i FROM d),
rest AS (SELECT r, count(*) n, string_agg(x, ' ' ORDER BY i) kept FROM word ANTI JOIN cover USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT n_words, (len(w) - coalesce(n, 0))::BIGINT n_removed, sha256(coalesce(kept, '')) kept_sha256 FROM d LEFT JOIN rest USING (r)
"""

SQL = {"op3_embeddings": EMBEDDINGS, "op4_sharding": SHARDING, "op8_jaccard": JACCARD, "op10_warc": WARC, "op11_search": SEARCH, "op13_windows": WINDOWS}
