"""DuckDB SQL for the queries whose rows SQL can state."""

ORACLE = {}

ORACLE["op10_exact"] = r"""
WITH rows AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM rows WINDOW g AS (PARTITION BY norm)
"""

# Words of a source up to its quota in shuffled order, as many rounds as fit: what the schedule has to arrive at.
ORACLE["op4_mixing"] = r"""
WITH rows AS (
  SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM sums
), weighed AS (
  SELECT *, [5, 2, 1][((sid - 1) % 3 + 1)::INT] AS weight, 3 * source_size AS most FROM numbered
), shared AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, sid
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY most / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed
), opened AS (
  SELECT *, most > level * weight AS is_open FROM shared
), targets AS (
  SELECT source, source_size, CASE WHEN is_open THEN weight *
      (SELECT arg_min(level, (most / weight, sid)) FROM opened WHERE is_open) ELSE most::DOUBLE END AS target
  FROM opened
), placed AS (
  SELECT doc_id, size, source_size, target, floor(target + 0.5)::BIGINT AS quota,
    coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('0:' || coalesce(doc_id::VARCHAR, '')), doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM rows JOIN targets USING (source)
)
SELECT doc_id, size, source_size, target,
  CASE WHEN size = 0 THEN 0 ELSE quota // source_size * size
    + greatest(0, least(size, quota % source_size - start)) END::BIGINT AS taken
FROM placed
"""

ORACLE["op6_near"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b USING (s)
  WHERE a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)
), reach AS (
  SELECT doc_id, doc_id AS label FROM documents
  UNION
  SELECT b, label FROM reach JOIN links ON a = doc_id
)
SELECT doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(label) AS component_id, doc_id = min(label) AS kept
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""

ORACLE["op7_substrings"] = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, sha256(array_to_string(w[i : i + 19], ' ')) AS h
  FROM words, unnest(range(1, len(w) - 18)) AS t(i)
), numbered AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM windows
), removed AS (
  SELECT DISTINCT doc_id, i + j AS i FROM numbered, unnest(range(0, 20)) AS t(j) WHERE k > 1
), singles AS (
  SELECT doc_id, i, w[i] AS word, r.i IS NOT NULL AS gone
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words) s LEFT JOIN removed r USING (doc_id, i)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS k, count_if(gone) AS n
  FROM singles GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

# Turns as they are written and read; windows as the prefix sums cut them.
ORACLE["op9_chat"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), written AS (
  SELECT *, '### ' || replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '#', '\h'), chr(10), '\n')
    || chr(10) || replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h') || '</turn>' || chr(10) AS piece
  FROM rows
), counted AS (
  SELECT *, len(regexp_extract_all(piece, '[^\x20\x09-\x0D]+'))::BIGINT AS tokens FROM written
), placed AS (
  SELECT *, row_number() OVER c - 1 AS place,
    (sum(tokens) OVER (c ROWS UNBOUNDED PRECEDING) - tokens)::BIGINT AS start
  FROM counted WINDOW c AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)
), headed AS (
  SELECT *, coalesce(max(CASE WHEN place = 0 AND role = 'system' AND tokens < 1024 THEN tokens END)
    OVER (PARTITION BY conv_id), 0) AS system
  FROM placed
), strided AS (
  SELECT *, least(512, 1024 - system) AS stride FROM headed
), spanned AS (
  SELECT *, start // stride * 2 + CASE WHEN (start + tokens - 1) // stride > start // stride THEN 1 ELSE 0 END AS span
  FROM strided
), spans AS (
  SELECT conv_id, span, min(start) AS head, min(place) AS head_place,
    greatest(0, least(256, min(stride), 1024 - max(system) - sum(tokens))) AS history
  FROM spanned GROUP BY ALL
), parts AS (
  SELECT conv_id, length(piece) AS n FROM spanned
  UNION ALL
  SELECT r.conv_id, length(piece) FROM spanned r JOIN spans s ON s.conv_id = r.conv_id AND start < head
    AND start >= head - history
  UNION ALL
  SELECT r.conv_id, length(piece) FROM spanned r JOIN spans s ON s.conv_id = r.conv_id
    AND place = 0 AND role = 'system' AND tokens < 1024 AND head_place > 0 AND head > history
), sizes AS (
  SELECT conv_id, sum(n)::BIGINT AS formatted_chars FROM parts GROUP BY conv_id
), said AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY place) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY place), '') AS targets
  FROM placed GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(targets)::BIGINT AS loss_chars,
  sha256(targets) AS loss_sha256, formatted_chars
FROM said JOIN sizes USING (conv_id)
"""

# The checksum's table first; then words, words without one letter, and where forms lead.
ORACLE["op11_spelling"] = r"""
WITH RECURSIVE bytes AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc
), runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  GROUP BY ALL
), coded AS (
  SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS code FROM runs WHERE length(run) >= 5
), summed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(length(code) // 2),
    lambda i: ('0x' || code[2 * i + 1 : 2 * i + 2])::BIGINT)),
    lambda c, b: xor(c // 256, crc[xor(c % 256, b) + 1]))) AS h
  FROM coded, bytes
), cut AS (
  SELECT CASE WHEN h % 97 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM summed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), shorter AS (
  SELECT word, n, i, word[: i - 1] || word[i + 1 :] AS rest FROM words, unnest(range(1, length(word) + 1)) AS t(i)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM shorter a JOIN shorter b USING (rest, i) WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON b.word = a.rest
  UNION SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON b.word = a.rest
), best AS (
  SELECT word, count(*) AS n_near, max(n) AS most FROM near GROUP BY word
), firsts AS (
  SELECT best.word, n_near, most, min(other) AS least FROM best JOIN near ON near.word = best.word AND n = most GROUP BY ALL
), forms AS (
  SELECT words.word, words.n, coalesce(n_near, 0)::BIGINT AS n_near,
    CASE WHEN most >= 2 * words.n THEN least END AS form, CASE WHEN most >= 2 * words.n THEN most END::BIGINT AS form_n
  FROM words LEFT JOIN firsts USING (word)
), ways AS (
  SELECT word, word AS at FROM forms
  UNION ALL
  SELECT ways.word, form FROM ways JOIN forms ON forms.word = ways.at WHERE form IS NOT NULL
)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN ways w USING (word) JOIN forms e ON e.word = w.at AND e.form IS NULL
"""

ORACLE["op13_negatives"] = r"""
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other,
    list_inner_product(a.v, b.v)::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
), negatives AS (
  SELECT anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank
  FROM positives JOIN scored USING (anchor_id)
  WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3
"""
