"""DuckDB statements for the registered queries that SQL can express."""

from budgetstar.llm.sharding import SHARDS, SLOTS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLDED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_WORDS = rf"regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _number(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


ORACLES: dict[str, str] = {}

# Shards take turns; a turn claims the first free slot of the shard's own order.
_NAMES = ", ".join(f"({i}, '{s}')" for i, s in enumerate(SHARDS))
ORACLES["op1_sharding"] = f"""WITH RECURSIVE names(i, shard) AS (VALUES {_NAMES}),
prefs AS (SELECT list({_number("'offset:' || shard")} % {SLOTS} ORDER BY i) AS o,
    list({_number("'skip:' || shard")} % {SLOTS - 1} + 1 ORDER BY i) AS s FROM names),
fill(turn, cells, tried) AS (
  SELECT 0, list_transform(range({SLOTS}), lambda x: -1), list_transform(range({len(SHARDS)}), lambda x: 0)
  UNION ALL
  SELECT turn + 1, cells[:slot] || [turn % {len(SHARDS)}] || cells[slot + 2:],
    tried[:turn % {len(SHARDS)}] || [c + 1] || tried[turn % {len(SHARDS)} + 2:]
  FROM (SELECT *, (o[turn % {len(SHARDS)} + 1] + c * s[turn % {len(SHARDS)} + 1]) % {SLOTS} AS slot FROM (
    SELECT fill.*, prefs.*, list_filter(range(tried[turn % {len(SHARDS)} + 1], {SLOTS}),
      lambda c: cells[(o[turn % {len(SHARDS)} + 1] + c * s[turn % {len(SHARDS)} + 1]) % {SLOTS} + 1] = -1)[1] AS c
    FROM fill, prefs WHERE turn < {SLOTS}))),
slots AS (SELECT unnest(cells) AS i, unnest(range({SLOTS})) AS slot FROM fill WHERE turn = {SLOTS}),
placed AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
  {_number("coalesce('k' || CAST(doc_id AS VARCHAR), 't' || coalesce(text, ''))")} % {SLOTS} AS slot FROM documents)
SELECT doc_id, CAST(n_bytes AS INTEGER) AS n_bytes, slot, shard FROM placed JOIN slots USING (slot) JOIN names USING (i)"""

ORACLES["op3_exact_dedup"] = f"""SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {_FOLDED} AS t FROM documents) WINDOW same AS (PARTITION BY t)"""

ORACLES["op7_decontamination"] = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
grams AS (SELECT DISTINCT item, k, array_to_string(w[p:p + k - 1], ' ') AS gram
  FROM (SELECT item, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0) q, unnest(range(1, len(w) - k + 2)) t(p)),
lengths AS (SELECT DISTINCT k FROM grams),
places AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS gram
  FROM (SELECT * FROM d, lengths WHERE len(w) >= k) q, unnest(range(1, len(w) - k + 2)) t(p)),
hits AS (SELECT doc_id, p, k, item FROM places JOIN grams USING (k, gram)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM hits, unnest(range(p, p + k)) t(q) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""

ORACLES["op10_near_join"] = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + k - 1], ' ') AS gram
  FROM (SELECT doc_id, w, least(5, len(w)) AS k FROM d WHERE len(w) > 0) q, unnest(range(1, len(w) - k + 2)) t(p)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM met JOIN sizes a ON x = a.doc_id JOIN sizes b ON y = b.doc_id WHERE 5 * c >= 4 * (a.n + b.n - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN links ON r = x),
classes AS (SELECT doc_id, max(r) AS class_id FROM reach GROUP BY doc_id),
counts AS (SELECT x AS doc_id, count(*) AS n_links FROM links GROUP BY x)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links FROM classes LEFT JOIN counts USING (doc_id)"""

# A line of at least 40 code points in at least 5 documents stays in the last of them only.
ORACLES["op11_line_dedup"] = f"""WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, i, parts[i] AS line, translate(regexp_replace(regexp_replace(parts[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), '{_UPPER}', '{_LOWER}') AS key
  FROM split, unnest(range(1, len(parts) + 1)) t(i)),
repeated AS (SELECT key, max(doc_id) AS keep FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(keep) FILTER (keep <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keep IS NULL OR keep = doc_id), '')) AS kept_sha256
FROM lines LEFT JOIN repeated USING (key) GROUP BY doc_id"""

# Terms run to letters and digits of any alphabet; weights are doubles, all else whole numbers.
ORACLES["op13_lexical_search"] = f"""WITH tokens AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
sizes AS (SELECT doc_id, CAST(len(ts) AS BIGINT) AS n FROM tokens WHERE len(ts) > 0),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM tokens) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, corpus GROUP BY term),
m AS (SELECT doc_id, 100 - 50 + ((50 * n * docs) // terms) AS m FROM sizes, corpus),
scored AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 50"""

# Brute force: every anchor with every row.
ORACLES["op12_hard_negatives"] = """WITH usable AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, q FROM usable),
met AS (SELECT a.vec_id AS anchor_id, r.vec_id AS other, a.label = r.label AS same, CAST(list_dot_product(a.q::DOUBLE[], r.q::DOUBLE[]) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS n FROM met WHERE same) WHERE n <= 5),
ranked AS (SELECT p.anchor_id, p.other AS positive_id, p.score AS positive_score, m.other AS negative_id, m.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY m.score DESC, m.other) AS rank
  FROM positives p JOIN met m ON m.anchor_id = p.anchor_id AND NOT m.same AND 50 * p.score <= 100 * m.score AND 100 * m.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3"""
