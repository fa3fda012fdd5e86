"""The registered queries in SQL for DuckDB, where SQL can express them.

Fitted models (2, 3), fingerprints checked against a benchmark by weights of the
corpus (7) and a tokenizer (10) have none.
"""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {}

# The checksum is worked out byte by byte, from the table of its polynomial.
ORACLES["op1_byte_shards"] = """
WITH polynomial AS MATERIALIZED (
    SELECT list_transform(range(256), lambda n: list_reduce(
        range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS entries
),
sized AS (
    SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
        regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bytes
    FROM documents
),
summed AS (
    SELECT doc_id, size, xor(4294967295, list_reduce(
        list_transform(bytes, lambda b: ('0x' || b)::BIGINT),
        lambda c, b: xor(entries[(xor(c, b) & 255) + 1], c >> 8), 4294967295)) AS text_crc32
    FROM sized, polynomial
),
placed AS (
    SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS before,
        sum(size) OVER () AS total
    FROM summed
),
sharded AS (
    SELECT *, (((2 * before + size) * 8) // (2 * total))::INTEGER AS shard FROM placed
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
    row_number() OVER (PARTITION BY shard ORDER BY before) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM sharded
"""

ORACLES["op4_mix_sources"] = f"""
WITH sized AS (
    SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents
),
named AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS number
    FROM sized GROUP BY source
),
weighed AS (
    SELECT *, [5.0, 2.0, 1.0][(number - 1) % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS most,
        sum(source_size) OVER () * 1.5::DOUBLE AS share
    FROM named
),
levels AS (
    SELECT *, (share - coalesce(sum(most) OVER (ORDER BY most / weight, number
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY most / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM weighed
),
targets AS (
    SELECT source, source_size, number, (source_size + 63) // 64 AS blocks,
        least(most, weight * coalesce(
            (SELECT level FROM levels WHERE level * weight <= most ORDER BY most / weight, number LIMIT 1), 0)) AS target
    FROM levels
),
quotients AS (
    SELECT number, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, number, k) AS place
    FROM (SELECT number, target, unnest(range(1, 2 * blocks + 1)) AS k FROM targets)
),
quotas AS (
    SELECT t.*, count(q.place) AS quota
    FROM targets t LEFT JOIN quotients q
        ON q.number = t.number AND q.place <= (SELECT floor(sum(target) / 64 + 0.5) FROM targets)
    GROUP BY ALL
),
blocks AS (
    SELECT number, blocks, quota % blocks AS extra, block, block // 256 AS shard
    FROM (SELECT *, unnest(range(blocks)) AS block FROM quotas WHERE blocks > 0)
),
chosen AS (
    SELECT number, block FROM (
        SELECT *, row_number() OVER (PARTITION BY number, shard ORDER BY md5('20/' || number || '/' || block)) AS place
        FROM blocks
    ) WHERE place <= ((extra * least((shard + 1) * 256, blocks)) // blocks) - ((extra * shard * 256) // blocks)
),
placed AS (
    SELECT s.*, q.source_size, q.target, q.number,
        CASE WHEN s.size > 0 THEN q.quota // q.blocks ELSE 0 END AS epochs,
        sum(s.size) OVER (PARTITION BY q.number ORDER BY s.doc_id ROWS UNBOUNDED PRECEDING) AS stop
    FROM sized s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source
)
SELECT p.doc_id, p.size, p.source_size, p.target,
    (p.epochs * p.size + coalesce(sum(least((c.block + 1) * 64, p.stop) - greatest(c.block * 64, p.stop - p.size))
        FILTER (c.block IS NOT NULL), 0))::BIGINT AS taken
FROM placed p LEFT JOIN chosen c
    ON c.number = p.number AND c.block * 64 < p.stop AND (c.block + 1) * 64 > p.stop - p.size AND p.size > 0
GROUP BY p.doc_id, p.size, p.source_size, p.target, p.epochs
"""

ORACLES["op5_zip_warc"] = """
WITH payloads AS (
    SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS response
    FROM pages
),
digests AS (
    SELECT *, list_transform(range(8), lambda g: ('0x' || substr(sha1(payload), (5 * g + 1)::INT, 5))::BIGINT) AS groups
    FROM payloads
)
SELECT page_id, strlen(payload) AS payload_bytes,
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        (((groups[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1)::INT, 1)), 'string_agg', '') AS payload_digest,
    CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> response THEN response END AS refers_to
FROM digests
"""

ORACLES["op6_substring_dedup"] = f"""
WITH split AS (
    SELECT doc_id, row_number() OVER () AS row, {WORDS} AS words FROM documents
),
windows AS (
    SELECT row, pos, md5(array_to_string(words[pos:pos + 34], ' ')) AS hash
    FROM (SELECT row, words, unnest(range(1, len(words) - 33)) AS pos FROM split)
),
repeated AS (
    SELECT row, pos FROM (SELECT row, pos, count(*) OVER (PARTITION BY hash) AS n FROM windows) WHERE n > 1
),
placed AS (
    SELECT row, word, pos FROM (SELECT row, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM split)
),
marked AS (
    SELECT p.row, p.word, p.pos, max(r.pos) OVER (PARTITION BY p.row ORDER BY p.pos) AS last
    FROM placed p LEFT JOIN repeated r ON p.row = r.row AND p.pos = r.pos
),
kept AS (
    SELECT row, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n
    FROM marked WHERE last IS NULL OR pos > last + 34 GROUP BY row
)
SELECT doc_id, len(words)::BIGINT AS n_words, len(words)::BIGINT - coalesce(n, 0) AS n_removed,
    sha256(coalesce(text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (row)
"""

ORACLES["op8_chat_trees"] = r"""
WITH turns AS (
    SELECT conv_id, turn, replace(coalesce(role, ''), chr(10), ' ') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL
    SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
escaped AS (
    SELECT *, replace(replace(replace(text, '\', '\\'), '<', '\l'), '[', '\b') AS written,
        replace(replace(replace(role, '\', '\\'), '<', '\l'), '[', '\b') AS head
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
        AS loss_sha256,
    sum(length('<s>' || head || chr(10) || written || '</s>' || chr(10)))::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""

ORACLES["op9_ngram_jaccard"] = rf"""
WITH RECURSIVE split AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS words
    FROM documents
),
sets AS (
    SELECT doc_id, list_sort(list_distinct(
        CASE WHEN len(words) = 0 THEN []
            WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
            ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END)) AS items
    FROM split
),
classes AS MATERIALIZED (
    SELECT items, min(doc_id) AS id, len(items) AS n FROM sets WHERE len(items) > 0 GROUP BY items
),
shingles AS MATERIALIZED (SELECT id, n, unnest(items) AS item FROM classes),
links AS MATERIALIZED (
    SELECT a.id AS a, b.id AS b
    FROM shingles a JOIN shingles b ON a.item = b.item AND a.id <> b.id AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)
    GROUP BY a.id, b.id, a.n, b.n
    HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
),
reached AS (
    SELECT id, id AS other FROM classes
    UNION
    SELECT r.id, l.b FROM reached r JOIN links l ON r.other = l.a
),
components AS (SELECT id, min(other) AS component FROM reached GROUP BY id)
SELECT s.doc_id, len(s.items)::BIGINT AS n_shingles, coalesce(k.component, s.doc_id) AS component_id
FROM sets s LEFT JOIN classes c ON s.items = c.items LEFT JOIN components k ON k.id = c.id
"""

ORACLES["op13_phrase_collocations"] = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS words
    FROM documents
),
totals AS (
    SELECT lang, sum(len(words))::BIGINT AS n FROM pieces GROUP BY lang
),
counted AS MATERIALIZED (
    SELECT lang, size, phrase, count(*)::BIGINT AS f
    FROM (
        SELECT lang, size, unnest(list_transform(range(1, (len(words) - size + 2)::BIGINT), lambda i: words[i:i + size - 1])) AS phrase
        FROM pieces, (VALUES (1), (2), (3)) AS sizes(size)
        WHERE len(words) >= size
    )
    GROUP BY ALL HAVING count(*) >= 10
),
parts AS (
    SELECT lang, phrase, f AS a, k, phrase[1:k] AS head, phrase[k + 1:size] AS rest
    FROM counted, (VALUES (1), (2)) AS cuts(k) WHERE k < size
),
cut AS (
    SELECT p.lang, p.phrase, a, k, l.f AS l, r.f AS r,
        ((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f))::BIGINT AS score
    FROM parts p
    JOIN counted l ON l.lang = p.lang AND l.phrase = p.head
    JOIN counted r ON r.lang = p.lang AND r.phrase = p.rest
),
scored AS (
    SELECT lang, phrase, a, l, r, score FROM cut
    QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
),
inside AS (
    SELECT lang, unnest([phrase[1:2], phrase[2:3]]) AS phrase, f FROM counted WHERE size = 3
),
kept AS (
    SELECT lang, phrase, a, l, r, score FROM scored
    LEFT JOIN (SELECT lang, phrase, max(f) AS most FROM inside GROUP BY ALL) i USING (lang, phrase)
    WHERE most IS NULL OR 100 * most < 50 * a
),
ranked AS (
    SELECT lang, array_to_string(phrase, ' ') AS phrase, a, l, r, score FROM kept
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM ranked JOIN totals USING (lang)
QUALIFY rank <= 2000
"""
