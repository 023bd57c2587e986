"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from fleetgauge.llm import divergence, license_scan, mixing, quality_rules, spelling, url_rules

SPACE = r"[\x20\x09-\x0D]+"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def exact_dedup_sql() -> str:
    return rf"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{SPACE}', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""


def mix_sql() -> str:
    weights = " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(mixing.WEIGHTS))
    n = len(mixing.WEIGHTS)
    most = mixing.MOST

    def unit(*parts: str) -> str:
        text = " || '|' || ".join([_text(mixing.SEED), *parts])
        return f"(('0x' || substr(md5({text}), 1, 13))::BIGINT / {float(16**13)!r}::DOUBLE)"

    draw = unit("coalesce(doc_id::VARCHAR, '')", "md5(coalesce(text, ''))")
    offset = unit("'offset'", "key", "part::VARCHAR")
    return rf"""
WITH sized AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '{SPACE}'), lambda x: x <> ''))::BIGINT AS size,
    {draw} AS draw
  FROM documents),
sums AS (SELECT source, count(*) AS n_docs, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {n} {weights} END AS weight FROM sums),
ordered AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS all_size,
    coalesce(sum(source_size) OVER before, 0)::BIGINT AS capped_size,
    (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::BIGINT AS open_weight
  FROM weighed
  WINDOW before AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
leveled AS (
  SELECT *, ({mixing.SHARE}::DOUBLE * all_size - {most} * capped_size) / open_weight AS level FROM ordered),
capped AS (SELECT *, {most} * source_size < level * weight AS is_capped FROM leveled),
targets AS (
  SELECT source, n_docs, source_size,
    CASE WHEN is_capped THEN {float(most)}::DOUBLE * source_size
         ELSE weight * (SELECT max(level) FROM capped WHERE NOT is_capped) END AS target
  FROM capped),
coins AS (SELECT DISTINCT doc_id, source, size, draw FROM sized),
rated AS (
  SELECT doc_id, c.source, size, draw, source_size, target,
    CASE WHEN c.source IS NULL THEN '{{}}' ELSE '{{"source":"' || c.source || '"}}' END || '|' || length(bin(size))::VARCHAR AS key,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM coins c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source),
parted AS (
  SELECT *, rate - floor(rate) AS fraction, floor(draw * ceil(count(*) OVER (PARTITION BY key) / {mixing.GROUP_ROWS}::DOUBLE))::BIGINT AS part
  FROM rated),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY key, part ORDER BY size DESC, draw, doc_id) AS pos, {offset} AS shift FROM parted),
drawn AS (
  SELECT *, (floor(rate) + floor(fraction * pos + shift) - floor(fraction * (pos - 1) + shift))::BIGINT AS copies FROM ranked)
SELECT s.doc_id, s.size, source_size, target, copies * s.size AS taken
FROM sized s JOIN drawn d ON s.doc_id IS NOT DISTINCT FROM d.doc_id AND s.source IS NOT DISTINCT FROM d.source AND s.draw = d.draw
"""


def url_rules_sql() -> str:
    rules = ", ".join(f"({_text(v)}, {_text(h)}, {_text(p)})" for v, h, p in url_rules.RULES)
    return rf"""
WITH rules(verdict, rule_host, rule_path) AS (VALUES {rules}),
cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0), '{url_rules.UPPER}', '{url_rules.LOWER}') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (
  SELECT page_id, rule_host || rule_path AS rule, verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, rule_host || rule_path DESC) AS rn
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT p.page_id, host, path, rule, coalesce(verdict, {_text(url_rules.DEFAULT)}) AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND rn = 1
"""


def quality_rules_sql() -> str:
    q = quality_rules
    names = [*q.CLASSES, "other"]
    counts = [f"length(regexp_replace(t, {_text(outside)}, '', 'g'))" for outside in q.CLASSES.values()]
    counts.append(f"length(t) - ({' + '.join(counts)})")
    classes = ", ".join(f"({c})::DOUBLE AS {n}" for c, n in zip(counts, names, strict=True))

    def term(a: str, b: str) -> str:
        return f"CASE WHEN {a} > 0 THEN {a} * log2(2.0 * {a} / ({a} + {b})) ELSE 0.0 END"

    sums = ", ".join(f"sum({n}) AS {n}" for n in names)
    total = " + ".join(f"r.{n}" for n in names)
    shares = [(f"(d.{n} / greatest(length(d.t), 1))", f"(r.{n} / greatest({total}, 1))") for n in names]
    char_js = " + ".join(f"({term(p, s)}) + ({term(s, p)})" for p, s in shares)
    limits = []
    for name, (limit, noise, least) in {"word_js": q.WORD_LIMIT, "char_js": q.CHAR_LIMIT}.items():
        limits.append(f"(n_words >= {least} AND coalesce({name} > {limit}::DOUBLE + {noise}::DOUBLE / sqrt(n_words), false))")
    return rf"""
WITH d AS (
  SELECT doc_id, lang, t, list_filter(string_split_regex(t, '{SPACE}'), lambda x: x <> '') AS w, {classes}
  FROM (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents)),
sized AS (SELECT *, len(w)::BIGINT AS n_words FROM d),
windows AS (SELECT doc_id, i, w[i + 1:i + {q.WINDOW}] AS g FROM (SELECT doc_id, w, unnest(range(len(w) - {q.WINDOW - 1})) AS i FROM sized)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
steps AS (SELECT doc_id, least({q.WINDOW}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {q.WINDOW})) AS s FROM twice),
repeats AS (SELECT doc_id, sum(s)::BIGINT AS n_repeat_words FROM steps GROUP BY doc_id),
lines AS (
  SELECT doc_id, len(x) - len(list_distinct(x)) AS n_dup_lines
  FROM (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS x FROM sized)),
tokens AS (SELECT doc_id, lang, lower(unnest(w)) AS word FROM sized),
lang_words AS (SELECT lang, count(*) AS total FROM tokens WHERE lang IS NOT NULL GROUP BY lang),
common AS (
  SELECT lang, word, n / total::DOUBLE AS share FROM (
    SELECT c.*, total, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rn
    FROM (SELECT lang, word, count(*) AS n FROM tokens WHERE lang IS NOT NULL AND regexp_matches(word, '^\p{{L}}+$') GROUP BY lang, word) c
    JOIN lang_words USING (lang) WHERE n >= {q.LEAST_SHARE}::DOUBLE * total) WHERE rn <= {q.TOP}),
word_counts AS (SELECT doc_id, word, count(*) AS n FROM tokens GROUP BY doc_id, word),
bins AS (
  SELECT s.doc_id, c.lang, coalesce(n, 0) / greatest(n_words, 1)::DOUBLE AS p, share AS q
  FROM sized s CROSS JOIN common c LEFT JOIN word_counts k ON k.doc_id = s.doc_id AND k.word = c.word),
all_bins AS (
  SELECT * FROM bins UNION ALL
  SELECT doc_id, lang, greatest(0.0, 1.0 - sum(p)), 1.0 - sum(q) FROM bins GROUP BY doc_id, lang),
word_js AS (
  SELECT doc_id, min(js) AS word_js FROM (
    SELECT doc_id, lang, sqrt(greatest(0.0, sum(({term('p', 'q')}) + ({term('q', 'p')})) / 2)) AS js FROM all_bins GROUP BY doc_id, lang)
  GROUP BY doc_id),
refs AS (SELECT lang, {sums} FROM d WHERE lang IS NOT NULL GROUP BY lang),
char_js AS (
  SELECT doc_id, min(sqrt(greatest(0.0, ({char_js}) / 2))) AS char_js FROM d CROSS JOIN refs r GROUP BY doc_id),
judged AS (
  SELECT s.doc_id, n_words, length(regexp_replace(t, '{SPACE}', '', 'g'))::BIGINT AS word_chars, symbol::BIGINT AS n_symbols,
    n_dup_lines::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, char_js, word_js
  FROM sized s JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN char_js USING (doc_id) LEFT JOIN word_js USING (doc_id)),
ruled AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {' OR '.join(limits)} AS bad FROM judged)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept,
  round(char_js, 6) AS char_distance, round(word_js, 6) AS word_distance
FROM ruled
"""


def license_sql() -> str:
    m = license_scan
    phrases = ", ".join(f"({_text(label)}, {k}, {_text(w)})" for p, label in m.BASE.items() for k, w in enumerate(p.split()))
    words = ", ".join(f"({_text(label)}, {k}, {_text(w)})" for label, (text, _) in m.TEMPLATES.items() for k, w in enumerate(text.split()))
    keys = []
    for label, (text, phrase) in m.TEMPLATES.items():
        whole, key = text.split(), phrase.split()
        at = next(i for i in range(len(whole)) if whole[i : i + len(key)] == key)
        keys += [f"({_text(label)}, {at + k})" for k in range(len(key))]
    return rf"""
WITH phrases(label, k, word) AS (VALUES {phrases}),
templates(label, k, word) AS (VALUES {words}),
keys(label, k) AS (VALUES {', '.join(keys)}),
d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '{m.SEPARATORS}'), lambda x: x <> '') AS w FROM documents),
tokens AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
df AS (SELECT word, count(DISTINCT doc_id) AS n FROM tokens GROUP BY word),
rare AS (
  SELECT label, word FROM (
    SELECT label, t.word, row_number() OVER (PARTITION BY label ORDER BY coalesce(n, 0), t.word) AS rn
    FROM (SELECT DISTINCT label, word FROM templates) t LEFT JOIN df USING (word)) WHERE rn <= {m.RARE}),
postings AS (SELECT label, k, word FROM templates JOIN rare USING (label, word)),
starts AS (SELECT DISTINCT doc_id, label, i - k AS pos FROM tokens JOIN postings USING (word) WHERE i >= k),
matched AS (
  SELECT s.doc_id, s.label, s.pos, t.k FROM starts s JOIN templates t USING (label)
  JOIN tokens x ON x.doc_id = s.doc_id AND x.i = s.pos + t.k AND x.word = t.word),
tpl AS (SELECT label, count(*) AS n FROM templates GROUP BY label),
tpl_rare AS (SELECT label, count(*) AS n FROM postings GROUP BY label),
tpl_key AS (SELECT label, count(*) AS n FROM keys GROUP BY label),
places AS (
  SELECT m.doc_id, m.label, m.pos, count(*) AS words,
    count(*) FILTER (WHERE EXISTS (SELECT 1 FROM postings p WHERE p.label = m.label AND p.k = m.k)) AS rares,
    count(*) FILTER (WHERE EXISTS (SELECT 1 FROM keys p WHERE p.label = m.label AND p.k = m.k)) AS keyed
  FROM matched m GROUP BY m.doc_id, m.label, m.pos),
held AS (
  SELECT p.doc_id, p.label, max(p.words / tpl.n::DOUBLE) AS share
  FROM places p JOIN tpl USING (label) JOIN tpl_rare USING (label) JOIN tpl_key USING (label)
  WHERE p.rares / tpl_rare.n::DOUBLE >= {m.RARE_SHARE} AND p.keyed = tpl_key.n GROUP BY p.doc_id, p.label),
own AS (SELECT * FROM held WHERE share >= {m.WORD_SHARE}),
lens AS (SELECT label, count(*) AS n FROM phrases GROUP BY label),
base AS (
  SELECT doc_id, label, pos FROM (
    SELECT doc_id, label, i - k AS pos, count(*) AS n FROM tokens JOIN phrases USING (word) GROUP BY doc_id, label, i - k)
  JOIN lens USING (label, n)),
base_sums AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM base GROUP BY doc_id),
labels AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM own) GROUP BY doc_id),
shares AS (SELECT doc_id, max(share) AS share FROM own GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  greatest(CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END::DOUBLE, coalesce(share, 0.0)::DOUBLE) AS score
FROM d LEFT JOIN base_sums USING (doc_id) LEFT JOIN labels USING (doc_id) LEFT JOIN shares USING (doc_id)
"""


def divergence_sql() -> str:
    word = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def p(n: str, of: str) -> str:
        return f"(1 + (1000000000::HUGEINT * ({n} + 1)) // ({of}))"

    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{word}') AS w
  FROM documents),
toks AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM toks GROUP BY lang, term HAVING count(DISTINCT r) >= {divergence.MIN_DOCS}),
cells AS (SELECT lang, source, term, count(*) AS n FROM toks SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (
  SELECT lang, coalesce(v, 0) AS v, coalesce(total, 0) + coalesce(v, 0) AS size
  FROM (SELECT DISTINCT lang FROM d) LEFT JOIN (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang) USING (lang)),
groups AS (
  SELECT lang, source, v, coalesce(total, 0) + v AS size
  FROM (SELECT DISTINCT lang, source FROM d) JOIN langs USING (lang)
    LEFT JOIN (SELECT lang, source, sum(n) AS total FROM cells GROUP BY ALL) USING (lang, source)),
probs AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {p("coalesce(c.n, 0)", "g.size")} AS p
  FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, (a.p - b.p) * (a.p - b.p) // b.p AS f
  FROM probs a JOIN probs b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source),
pair_sums AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT lang, source, item, sum(f) AS f FROM pairs GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value
  FROM (SELECT x.*, {p("k.n", "l.size")} AS q FROM probs x JOIN kept k USING (lang, term) JOIN langs l USING (lang)) WHERE n > 0 AND p > q),
found AS (SELECT lang, source, 'pair' AS part, item, value FROM pair_sums UNION ALL SELECT lang, source, 'term', item, value FROM terms),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM found)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP}
"""


def spelling_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END"
    key = "coalesce(doc_id::VARCHAR, '') || ':' || w"
    byte = "('0x' || substr(hex(encode(k)), 2 * i - 1, 2))::BIGINT"
    return rf"""
WITH RECURSIVE steps AS (
  SELECT i, 0 AS done, i::BIGINT AS c FROM range(256) t(i)
  UNION ALL SELECT i, done + 1, {step} FROM steps WHERE done < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM steps WHERE done = 8),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{00C0}}-\x{{00FF}}]{{{spelling.MIN_LENGTH},}}')), '{upper}', '{lower}') AS w
  FROM documents),
counted AS (SELECT {key} AS k, w, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (
  SELECT w, n, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode(k)) + 1), lambda i: {byte})),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS h
  FROM counted, crc),
damaged AS (
  SELECT CASE WHEN h % {spelling.NOISE} = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM hashed),
vocab AS (SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE length(word) >= {spelling.MIN_LENGTH} GROUP BY word HAVING sum(n) >= {spelling.MIN_COUNT}),
cut AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN vocab b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN vocab b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(m := -n, w := other)) AS b FROM near GROUP BY word),
forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -b.m >= {spelling.TIMES} * v.n THEN b.w END AS form,
    CASE WHEN -b.m >= {spelling.TIMES} * v.n THEN -b.m END AS form_n
  FROM vocab v LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS last, 0 AS hops FROM forms
  UNION ALL SELECT w.word, f.form, hops + 1 FROM walk w JOIN forms f ON f.word = w.last WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(last, hops) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n::BIGINT AS form_n FROM forms JOIN roots USING (word)
"""


ORACLE_SQL = {
    "op1_license_scan": license_sql(),
    "op3_mix_sources": mix_sql(),
    "op4_url_rules": url_rules_sql(),
    "op7_exact_dedup": exact_dedup_sql(),
    "op8_quality_rules": quality_rules_sql(),
    "op11_spelling_variants": spelling_sql(),
    "op12_source_divergence": divergence_sql(),
}
