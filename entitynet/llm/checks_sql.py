"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from entitynet.llm import codes, licences, linededup, sharding

CHECKS: dict[str, str] = {}

CHECKS["op2_phrase_index"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words, row_number() OVER () AS r
  FROM documents),
i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM benchmark),
starts AS (SELECT item, words, least(len(words), 10) AS n, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS k FROM i WHERE len(words) > 0),
windows AS (SELECT DISTINCT item, n, words[k:k + n - 1] AS w FROM starts),
places AS (SELECT r, words, unnest(range(1, len(words) + 1)) AS p FROM d),
grams AS (SELECT r, p, s.n, words[p:p + s.n - 1] AS w FROM places, (SELECT DISTINCT n FROM windows) s WHERE p + s.n - 1 <= len(words)),
found AS (SELECT g.r, g.p, g.n, windows.item FROM grams g JOIN windows ON g.w = windows.w AND g.n = windows.n),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS p FROM found) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS items_sha256 FROM found GROUP BY r),
terms AS (SELECT DISTINCT item, w, unnest(list_distinct(w)) AS t, len(list_distinct(w)) AS need FROM windows),
wid AS (SELECT *, dense_rank() OVER (ORDER BY item, w) AS window_id FROM terms),
rare AS (SELECT DISTINCT ON (window_id) window_id, t FROM wid JOIN (SELECT t, count(*) AS df FROM
  (SELECT words[p] AS t FROM places) GROUP BY t) USING (t) ORDER BY window_id, df, t),
near AS (
  SELECT DISTINCT d.r, wid.item
  FROM rare JOIN (SELECT r, p, words[p] AS t FROM places) a USING (t) JOIN d USING (r) JOIN wid USING (window_id),
    (SELECT unnest(range(0, 20)) AS back) s
  WHERE list_contains(d.words[greatest(a.p - back, 1):a.p - back + 19], wid.t) AND a.p - back >= 1 - 19
  GROUP BY d.r, wid.item, wid.window_id, a.p, s.back, wid.need HAVING count(DISTINCT wid.t) = wid.need),
n AS (SELECT r, count(DISTINCT item) AS n_near FROM near GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r) LEFT JOIN n USING (r)
"""

CHECKS["op3_site_line_frequency"] = rf"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, lower(regexp_extract(url, '{linededup.HOST}', 1)) AS host,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(html, '{linededup.HIDDEN}', chr(10), 'g'),
      '{linededup.BREAKING}', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(12))), lambda x: x <> '') AS lines
  FROM pages),
texts AS (SELECT DISTINCT host, lines FROM p WHERE lines IS NOT NULL),
totals AS (SELECT host, count(*) AS n FROM texts GROUP BY host),
counts AS (SELECT host, line, count(*) AS k FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM texts) GROUP BY host, line),
bad AS (SELECT c.host, list(line) AS bad FROM counts c JOIN totals t ON c.host IS NOT DISTINCT FROM t.host
  WHERE k >= {linededup.LEAST} AND k > n * {linededup.RATIO}::DOUBLE GROUP BY c.host),
kept AS (SELECT page_id, p.host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []), x)) AS kept
  FROM p LEFT JOIN bad b ON p.host IS NOT DISTINCT FROM b.host)
SELECT page_id, host, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped,
  sha256(array_to_string(kept, chr(10))) AS kept_sha256
FROM kept
"""


def licence_sql() -> str:
    """The same sentences and rules as CTEs, one for each rule."""
    known = ", ".join(f"('{s}', '{i}')" for s, i in licences.SENTENCES.items())
    names = ", ".join(f"'{name}': '{i}'" for name, i in licences.spdx_names().items())
    fixed = "plain"
    for _, pattern, to in licences.VARIABLE:
        fixed = f"regexp_replace({fixed}, '{pattern}', '{to.replace('$', chr(92))}')"
    steps = [f"""s0 AS (SELECT r, mode, string_agg(mark, '' ORDER BY pos) AS rest, list(mark) AS marks, CAST([] AS VARCHAR[]) AS found,
  count(*) FILTER (mark <> '' AND mark <> '{licences.UNKNOWN}') AS n FROM marks GROUP BY r, mode
  HAVING count(*) FILTER (mark <> '' AND mark <> '{licences.UNKNOWN}') > 0)"""]
    for k, (licence, ids) in enumerate(licences.RULES):
        pattern = "".join(f" {i} " for i in ids.split())
        steps.append(f"""s{k + 1} AS MATERIALIZED (SELECT r, mode, n, marks, replace(rest, '{pattern}', '{licences.USED}') AS rest,
  CASE WHEN contains(rest, '{pattern}') THEN list_append(found, '{licence}') ELSE found END AS found FROM s{k})""")
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, replace(lower(text), '{licences.SPDX_TAG}', '{licences.SPDX_TAG[:-1]}') AS t FROM documents),
cut AS (SELECT r, 1 AS mode, string_split_regex(t, '{licences.SENTENCE_END}') AS p FROM d
  UNION ALL SELECT r, 2, string_split_regex(t, '{licences.LINE_END}') FROM d),
parts AS (SELECT r, mode, unnest(p) AS part, generate_subscripts(p, 1) AS pos FROM cut),
plains AS (SELECT r, mode, pos, ltrim(trim(regexp_replace(part, '{licences.NOISE}', ' ', 'g'), ' .'), '+ ') AS plain FROM parts),
known(s, i) AS (VALUES {known}),
names AS (SELECT MAP {{{names}}} AS m),
marks AS (SELECT r, mode, pos, CASE WHEN starts_with(plain, '{licences.SPDX_START}') THEN array_to_string(list_transform(
    string_split_regex(replace(substr(plain, {len(licences.SPDX_START) + 1}), ' or later', '+'), ' or | and '),
    lambda x: ' ' || coalesce(map_extract(m, regexp_replace(x, ' with .*$', ''))[1], '?') || ' '), '')
    WHEN i IS NOT NULL THEN ' ' || i || ' '
    WHEN regexp_matches(plain, '{licences.MARKER}') THEN '' ELSE '{licences.UNKNOWN}' END AS mark
  FROM plains CROSS JOIN names LEFT JOIN known ON {fixed} = s),
{', '.join(steps)},
split AS (SELECT r, n, found, list_filter(string_split(rest, ' '), lambda x: x NOT IN ('', '{licences.UNKNOWN.strip()}', '{licences.USED.strip()}')) AS rest,
  list_filter(string_split(array_to_string(marks, ''), ' '), lambda x: x NOT IN ('', '{licences.UNKNOWN.strip()}')) AS ids FROM s{len(licences.RULES)}),
done AS (SELECT r, max(n) AS n, list_distinct(flatten(list(found))) AS found, flatten(list(rest)) AS rest,
  flatten(list(list_filter(ids, lambda x: NOT list_contains(rest, x)))) AS used FROM split GROUP BY r)
SELECT doc_id, coalesce(array_to_string(list_sort(list_filter(found, lambda x: x <> '{licences.RESERVED}' OR len(found) = 1)), ','), '') AS licences,
  coalesce(n, 0) AS n_sentences, coalesce(array_to_string(list_sort(list_filter(list_distinct(rest), lambda x: NOT list_contains(used, x))), ','), '') AS unruled
FROM d LEFT JOIN done USING (r)
"""


CHECKS["op4_licence_sentences"] = licence_sql()


def shard_sql(shards: int = 8, key: str = "shuffle-1") -> str:
    """Checksums folded over bytes with the table of the CRC polynomial; one step of the recursion is one Feistel round."""
    rounds = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(sharding.round_constants(key)))
    mix = lambda x: f"(((({x}) + a) % {sharding.PRIME}) * ((({x}) + a) % {sharding.PRIME}) + b) % {sharding.PRIME}"
    return f"""
WITH RECURSIVE t AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS crc FROM range(256) r(i)),
d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT count(*) AS n, greatest(2, length(bin(count(*) - 1))) // 2 AS low_bits,
  greatest(2, length(bin(count(*) - 1))) - greatest(2, length(bin(count(*) - 1))) // 2 AS high_bits FROM d),
rounds(k, a, b) AS (VALUES {rounds}),
walk AS (
  SELECT r, 0 AS step, r >> low_bits AS high, r & ((1 << low_bits) - 1) AS low FROM d, n
  UNION ALL
  SELECT r, step + 1,
    CASE WHEN k % 2 = 0 THEN xor(high, {mix(mix('low'))} & ((1 << high_bits) - 1)) ELSE high END,
    CASE WHEN k % 2 = 1 THEN xor(low, {mix(mix('high'))} & ((1 << low_bits) - 1)) ELSE low END
  FROM walk, n, rounds WHERE k = step % {sharding.ROUNDS}
    AND NOT (step > 0 AND step % {sharding.ROUNDS} = 0 AND (high << low_bits) + low < n)),
place AS (SELECT r, (high << low_bits) + low AS p FROM walk, n WHERE step > 0 AND step % {sharding.ROUNDS} = 0 AND (high << low_bits) + low < n)
SELECT doc_id, CAST(length(h) // 2 + 1 AS BIGINT) AS size,
  CAST(xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(h) + 1, 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))),
    lambda c, x: xor(t.crc[xor(c, x) % 256 + 1], c >> 8)), 4294967295) AS BIGINT) AS text_crc32,
  'rows' AS law, CAST(p % {shards} AS INTEGER) AS shard, CAST(p // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM d JOIN place USING (r), t
"""


CHECKS["op6_feistel_shards"] = shard_sql()


def _codes(parts: int = codes.PARTS, entries: int = codes.ENTRIES, rounds: int = codes.ROUNDS, scale: int = codes.SCALE) -> str:
    """Rounds of assignment by plain squared distances, each a pair of common tables."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT row, p.part, any_value(p.x) AS x, min({{'d': list_sum(list_transform(list_zip(p.x, c.x), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS HUGEINT))), 'entry': c.entry}}) AS best
  FROM p JOIN c{r} c ON p.part = c.part GROUP BY row, p.part)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT part, best.entry AS entry, unnest(range(1, len(x) + 1)) AS pos, unnest(x) AS v FROM a{r}),
m{r} AS (SELECT part, entry, pos, sum(v) AS t, count(*) AS n FROM s{r} GROUP BY ALL),
b{r} AS (SELECT part, entry, list(CAST((t - ((t % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS x FROM m{r} GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(b{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN b{r} USING (part, entry))""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT row, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] AS x FROM kept, (SELECT unnest(range({parts})) AS part)),
c0 AS MATERIALIZED (SELECT part, row - 1 AS entry, x FROM p WHERE row <= {entries}),
{",".join(steps)},
coded AS (SELECT row, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY row),
books AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(range(1, len(x) + 1)) AS pos, unnest(x) AS v FROM c{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (row), books
"""


CHECKS["op13_walsh_codes"] = _codes()


CHECKS["op12_word_runs"] = r"""
WITH RECURSIVE t AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS crc FROM range(256) r(i)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  CASE WHEN doc_id IS NOT NULL THEN xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c))),
    lambda c, x: xor(t.crc[xor(c, x) % 256 + 1], c >> 8)), 4294967295) END AS h FROM documents, t),
n AS (SELECT r, CAST(len(w) AS BIGINT) AS n, CAST(h % 10 = 0 AND len(w) > 0 AS INTEGER) AS echo, (h // 10) % nullif(len(w), 0) AS a, h // 10 AS g FROM d),
step AS (SELECT r, n, coalesce(echo, 0) AS echo, a, CASE WHEN echo = 1 THEN 1 + (n - a) // (3 + g % 8) END AS p FROM n),
given AS (SELECT r, unnest(range(len(w))) AS i, unnest(w) AS word FROM d),
words AS MATERIALIZED (
  SELECT place.r, place.i, place.n, given.word FROM (
    SELECT r, n, i, CASE WHEN echo = 1 AND i >= a THEN a + (i - a) % p ELSE i END AS source FROM (SELECT r, n, echo, a, p, unnest(range(n)) AS i FROM step)) place
  JOIN given ON given.r = place.r AND given.i = place.source),
pairs AS (SELECT x.r, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
marked AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS stretch FROM pairs),
stretches AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM marked GROUP BY r, q, stretch HAVING count(*) >= q AND count(*) + q >= 12),
runs AS MATERIALIZED (SELECT r, start, length, min(q) AS period FROM stretches GROUP BY r, start, length),
longest AS (SELECT DISTINCT ON (r) r, start, length, period FROM runs ORDER BY r, length DESC, start, period),
lines AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY r),
dropped AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
left_over AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS collapsed FROM words ANTI JOIN dropped USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM d LEFT JOIN longest USING (r) LEFT JOIN lines USING (r) LEFT JOIN left_over USING (r)
"""
