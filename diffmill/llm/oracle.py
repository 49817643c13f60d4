"""SQL counterparts of this package's driver queries, for DuckDB."""

ORACLES: dict[str, str] = {}

ORACLES["op11_sharding"] = r"""
WITH table_of AS MATERIALIZED (  -- CRC-32, reversed polynomial
  SELECT list(list_reduce(range(8)::UBIGINT[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, b)
              ORDER BY b) AS t
  FROM (SELECT unnest(range(256))::UBIGINT AS b)
), d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), sized AS MATERIALIZED (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, octet_length(encode(text)) + 1 AS size,
    xor(list_reduce(
      list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::UBIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT)::BIGINT AS text_crc32
  FROM d, table_of
), drawn AS (
  SELECT *, list_transform(range(17), lambda s: {'v': -ln((('0x' || md5(key || ':' || s)[1:13])::BIGINT + 0.5) / 4503599627370496), 's': s}) AS draws
  FROM sized
), won AS (
  SELECT *, list_sort(draws[1:16])[1].s::INTEGER AS shard, list_sort(draws)[1].s::INTEGER AS grown_shard FROM drawn
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(key || ':' || text_crc32), doc_id) - 1 AS slot, grown_shard
FROM won
"""

ORACLES["op12_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), total AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
), f AS MATERIALIZED (
  SELECT lang, m AS words, phrase, count(*) AS f FROM (
    SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
    FROM words, (SELECT unnest([1, 2, 3, 4]) AS m))
  GROUP BY ALL HAVING count(*) >= 30
), cuts AS (
  SELECT lang, phrase, words, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS lft,
    array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rgt
  FROM f, (SELECT unnest([1, 2, 3]) AS k) WHERE k < words
), scored AS (
  SELECT c.lang, c.phrase, c.words, c.a, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a // (x.f + y.f))::BIGINT AS score, k
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lft JOIN f y ON y.lang = c.lang AND y.phrase = c.rgt
), worst AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), held AS (
  SELECT lang, sub AS phrase, max(f) AS held FROM (
    SELECT lang, f, unnest(list_transform(range(1, words - m + 2), lambda i: array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' '))) AS sub
    FROM f, (SELECT unnest([2, 3]) AS m) WHERE m < words)
  GROUP BY ALL
), ranked AS (
  SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS rank
  FROM worst w LEFT JOIN held h ON h.lang = w.lang AND h.phrase = w.phrase
  WHERE h.held IS NULL OR 100 * h.held < 80 * a
)
SELECT r.lang, rank, phrase, a, l, r.r, n, score FROM ranked r JOIN total t ON t.lang = r.lang WHERE rank <= 2000
"""


def _lloyd(parts: int, entries: int, rounds: int) -> str:
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (
  SELECT p.rid, p.pos, p.part, min({{'d': list_sum(list_transform(range(1, len(p.part) + 1), lambda i: (p.part[i] - c.part[i]) * (p.part[i] - c.part[i]))), 'e': c.e}}) AS best
  FROM p JOIN c{k} c ON c.pos = p.pos GROUP BY ALL
)""")
        if k < rounds:
            steps.append(f"""
s{k} AS (
  SELECT pos, best.e AS e, i, sum(part[i]) AS s, count(*) AS n FROM a{k}, (SELECT unnest(range(1, 1025)) AS i)
  WHERE i <= len(part) GROUP BY ALL
), u{k} AS (
  SELECT pos, e, list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY i) AS part FROM s{k} GROUP BY pos, e
), c{k + 1} AS MATERIALIZED (
  SELECT c.pos, c.e, coalesce(u.part, c.part) AS part FROM c{k} c LEFT JOIN u{k} u ON u.pos = c.pos AND u.e = c.e
)""")
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), r AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, v) AS rid, * FROM kept
), p AS MATERIALIZED (
  SELECT rid, k AS pos, v[k * len(v) // {parts} + 1:(k + 1) * len(v) // {parts}] AS part FROM r, (SELECT unnest(range({parts})) AS k)
), c0 AS MATERIALIZED (
  SELECT pos, rid - 1 AS e, part FROM p WHERE rid <= {entries}
),{",".join(steps)}, coded AS (
  SELECT rid, string_agg(lower(lpad(to_hex(best.e), 2, '0')), '' ORDER BY pos) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY rid
), books AS (
  SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY pos, e)) AS codebooks_sha256 FROM c{rounds}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN r USING (rid), books
"""


ORACLES["op13_vector_codes"] = _lloyd(parts=16, entries=64, rounds=2)
