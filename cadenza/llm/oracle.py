"""DuckDB SQL for the operators that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP4 = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
windows AS (
    SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)
),
firsts AS (SELECT s, min(doc_id) AS f FROM windows GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM windows JOIN firsts USING (s) WHERE f < doc_id),
lists AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
    sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE [w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(ps, i)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN lists USING (doc_id)
"""

_MIX = r"""
classed AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS class FROM sized),
classes AS (
    SELECT c.source, class, source_size, target, words, sqrt(sqrt(pow(2.0, greatest(class - 1, 0)))) AS growth, sqrt(sqrt(pow(2.0, greatest(class - 1, 0)))) * words AS mass
    FROM (SELECT source, class, CAST(sum(size) AS BIGINT) AS words FROM classed GROUP BY source, class) c JOIN goals g ON c.source IS NOT DISTINCT FROM g.source
),
level_of AS (
    SELECT *, (target - 2 * (sum(words) OVER (PARTITION BY source ORDER BY class DESC) - words)) / nullif(sum(mass) OVER (PARTITION BY source ORDER BY class), 0) AS level
    FROM classes
),
common AS (SELECT *, max(level) FILTER (WHERE level * growth <= 2) OVER (PARTITION BY source) AS common FROM level_of),
expects AS (SELECT *, CASE WHEN target >= 2 * source_size THEN 2.0 ELSE least(2.0, growth * coalesce(common, 2.0)) END AS e FROM common),
snapped AS (SELECT *, CASE WHEN abs(e - round(e)) < 1e-9 THEN round(e) ELSE e END AS expected FROM expects),
odds AS (SELECT *, floor(expected) AS whole, expected - floor(expected) AS p, target - sum(floor(expected) * words) OVER (PARTITION BY source) AS wanted FROM snapped),
drawn AS (
    SELECT d.*, o.source_size, o.target, o.whole, o.p, o.wanted,
        (CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
    FROM classed d JOIN odds o ON d.source IS NOT DISTINCT FROM o.source AND d.class = o.class
),
placed AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN u * (1 - p) / (u * (1 - p) + p * (1 - u)) END AS r FROM drawn),
together AS (
    SELECT source, wanted, r, doc_id, size, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY r, doc_id, size) AS upto
    FROM placed WHERE r IS NOT NULL GROUP BY source, wanted, r, doc_id, size
),
mixed AS (
    SELECT p.doc_id, p.size, source_size, target, CAST(CASE WHEN p.size = 0 THEN 0 ELSE whole + CASE WHEN t.upto - t.words / 2.0 <= t.wanted THEN 1 ELSE 0 END END AS BIGINT) AS copies
    FROM placed p LEFT JOIN together t ON p.source IS NOT DISTINCT FROM t.source AND p.doc_id IS NOT DISTINCT FROM t.doc_id AND p.size = t.size AND p.r = t.r
)
"""


def goals(weights: str = "[5, 2, 1]") -> str:
    return f"""
sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0 * sum(size) AS most,
        CAST(({weights})[(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
    FROM sized GROUP BY source
),
levels AS (
    SELECT *, most / weight AS ratio, (1.5 * sum(source_size) OVER () - (sum(most) OVER o - most)) / (sum(weight) OVER () - sum(weight) OVER o + weight) AS level
    FROM sources WINDOW o AS (ORDER BY most / weight, encode(source) NULLS LAST)
),
level AS (SELECT max(level) FILTER (WHERE level <= ratio) AS level FROM levels),
goals AS (
    SELECT source, source_size, CAST(least(most, coalesce(weight * level.level, most)) AS DOUBLE) AS target
    FROM levels, level
)
"""


OP5 = f"""
WITH sized AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size FROM documents), {goals()}, {_MIX}
SELECT doc_id, size, source_size, target, copies, CAST(copies * size AS BIGINT) AS taken FROM mixed
"""

OP7 = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


def op8() -> str:
    from .urls import DEFAULT, PATTERN_RULES, SITE_RULES

    quote = lambda x: "'" + x.replace("'", "''") + "'"
    site = ", ".join(f"({quote(h)}, {quote(p)}, {quote(v)})" for h, p, v in SITE_RULES)
    patterns = ", ".join(f"({quote(n)}, {quote(p)}, {quote(v)}, {k})" for n, p, _, v, k in PATTERN_RULES)
    return rf"""
WITH site(h, p, v) AS (VALUES {site}), patterns(n, p, v, k) AS (VALUES {patterns}),
u AS (
    SELECT page_id, coalesce(url, '') AS url,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
    FROM pages
),
s AS (SELECT page_id, url, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
    FROM u JOIN site ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL),
m AS (SELECT url, arg_max(n, (k, n)) AS n, arg_max(v, (k, n)) AS v
    FROM (SELECT DISTINCT url FROM u) JOIN patterns ON regexp_matches(lower(url), p) GROUP BY url)
SELECT u.page_id, host, path, s.rule, coalesce(s.v, m.v, '{DEFAULT}') AS verdict, m.n AS pattern_rule
FROM u LEFT JOIN s ON u.page_id = s.page_id AND u.url = s.url LEFT JOIN m ON u.url = m.url
"""


def op9() -> str:
    from .quality import LIMITS, LINE_LIMIT

    lengths = ", ".join(f"({n})" for n in (3, *LIMITS))
    limits = " AND ".join(f"coalesce(c{n}, 0) / CAST(greatest(word_chars, 1) AS DOUBLE) <= {most}" for n, most in LIMITS.items())
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
windows AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (VALUES {lengths}) AS x(n))),
often AS (SELECT doc_id, n, p FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, n, s) > 1),
inside AS (SELECT DISTINCT doc_id, n, unnest(range(p, p + n)) AS p FROM often),
covered AS (SELECT doc_id, count(*) FILTER (WHERE n = 3) AS n_repeat, {", ".join(f"sum(length(w[p])) FILTER (WHERE n = {n}) AS c{n}" for n in LIMITS)} FROM inside JOIN d USING (doc_id) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
again AS (SELECT doc_id, line FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1),
repeats AS (SELECT doc_id, count(*) AS n_dup_lines, sum(length(line)) AS dup_chars FROM again GROUP BY doc_id),
base AS (
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, coalesce(dup_chars, 0) / CAST(greatest(length(text), 1) AS DOUBLE) AS line_share, covered.* EXCLUDE (doc_id, n_repeat)
    FROM d LEFT JOIN repeats USING (doc_id) LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND line_share <= {LINE_LIMIT} AND {limits} AS kept FROM judged
"""


def op2() -> str:
    from .licences import LEAST_COSINE, LEAST_FILE_COSINE, LEAST_WINDOW, NAMELESS, RUN, TEMPLATES, TERM, WHOLE, full_texts

    quote = lambda x: "'" + x.replace("'", "''") + "'"
    wordings = ", ".join(f"({i}, {quote(licence)}, {quote(wording)}, {i < len(TEMPLATES)})" for i, (licence, wording) in enumerate([*TEMPLATES, *full_texts()]))
    terms = lambda x: f"regexp_extract_all(lower({x}), '{TERM}')"
    nameless = ", ".join(quote(t) for t in sorted(NAMELESS))
    unknown = "(ln((1.0::DOUBLE + (SELECT count(*) FROM d)) / 2.0::DOUBLE) + 1.0::DOUBLE)"
    return f"""
WITH d AS (SELECT doc_id, concat_ws('/', source, lang) AS directory, coalesce(text, '') AS text FROM documents),
wordings AS (SELECT i AS template, licence, {terms('wording')} AS terms, notice FROM (VALUES {wordings}) AS x(i, licence, wording, notice)),
templates AS (
    SELECT template, licence, unnest(CASE WHEN notice THEN [{WHOLE}, greatest({LEAST_WINDOW}, CAST(pow(2, ceil(log2(2.0 * len(terms)))) AS INTEGER))] ELSE [{WHOLE}] END) AS win, terms FROM wordings),
tf AS (SELECT template, licence, win, term, count(*) AS n FROM (SELECT template, licence, win, unnest(terms) AS term FROM templates) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({terms('text')}) AS term FROM d) WHERE term IN (SELECT term FROM tf) GROUP BY term),
idf AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM d)) / (1.0::DOUBLE + coalesce(df, 0))) + 1.0::DOUBLE AS idf FROM (SELECT DISTINCT term FROM tf) LEFT JOIN df USING (term)),
vectors AS (SELECT template, licence, win, term, (1 + ln(n)) * idf AS t FROM tf JOIN idf USING (term)),
lines AS (SELECT doc_id, {terms('text')} AS terms, list_filter(list_transform(string_split(text, chr(10)), lambda x: {terms('x')}), lambda x: len(x) > 0) AS lines FROM d),
wins AS (SELECT DISTINCT win FROM templates WHERE win <> {WHOLE}),
runs AS (SELECT DISTINCT doc_id, flatten(lines[i:i + k - 1]) AS terms FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM lines), (SELECT unnest(range(1, {RUN + 1})) AS k)),
units AS (
    SELECT doc_id, {WHOLE} AS win, terms FROM lines
    UNION ALL
    SELECT doc_id, win, terms FROM runs JOIN wins ON len(terms) <= win
    UNION ALL
    SELECT doc_id, win, terms[s:s + win - 1] FROM (SELECT doc_id, win, terms, unnest(range(1, greatest(len(terms) - win // 2, 1) + 1, win // 2)) AS s FROM lines, wins)),
different AS (SELECT row_number() OVER () AS unit, win, terms FROM (SELECT DISTINCT win, terms FROM units)),
own AS (SELECT unit, win, term, (1 + ln(n)) * coalesce(idf, {unknown}) AS w FROM (SELECT unit, win, term, count(*) AS n FROM (SELECT unit, win, unnest(terms) AS term FROM different) GROUP BY ALL) LEFT JOIN idf USING (term)),
scored AS (
    SELECT unit, win, licence, round(sum(w * t) / (any_value(a.size) * any_value(b.size)), 9) AS cosine
    FROM own JOIN vectors USING (win, term) JOIN (SELECT unit, sqrt(sum(w * w)) AS size FROM own GROUP BY unit) a USING (unit) JOIN (SELECT template, win, sqrt(sum(t * t)) AS size FROM vectors GROUP BY template, win) b USING (template, win)
    GROUP BY unit, win, template, licence HAVING bool_or(term NOT IN ({nameless}) AND NOT regexp_matches(term, '^[0-9]'))),
best AS (SELECT unit, win, min(struct_pack(c := -cosine, licence := licence)) AS b FROM scored WHERE cosine >= CASE WHEN win = {WHOLE} THEN {LEAST_FILE_COSINE} ELSE {LEAST_COSINE} END GROUP BY unit, win),
per_doc AS (
    SELECT doc_id, min(b) FILTER (WHERE u.win = {WHOLE}) AS file, min(b) FILTER (WHERE u.win <> {WHOLE}) AS header
    FROM units u JOIN different x ON u.win = x.win AND u.terms = x.terms JOIN best ON x.unit = best.unit GROUP BY doc_id),
judged AS (
    SELECT d.doc_id, directory, coalesce(file, header).licence AS own, -coalesce(file, header).c AS cosine, file IS NOT NULL AS is_file FROM d LEFT JOIN per_doc USING (doc_id)),
granted AS (SELECT directory AS g, min(struct_pack(c := -cosine, i := doc_id, own := own)).own AS given FROM judged WHERE is_file GROUP BY directory),
nearest AS (SELECT directory, arg_max(struct_pack(g := g, given := given), length(g)) AS n FROM (SELECT DISTINCT directory FROM d) JOIN granted ON directory = g OR starts_with(directory, g || '/') OR g = '' GROUP BY directory)
SELECT doc_id, directory, coalesce(own, n.given) AS licence, cosine, CASE WHEN own IS NOT NULL THEN CASE WHEN is_file THEN 'file' ELSE 'header' END WHEN n IS NOT NULL THEN 'inherited' ELSE 'none' END AS how, CASE WHEN own IS NULL THEN n.g END AS from_directory
FROM judged LEFT JOIN nearest USING (directory)
"""

TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP12 = rf"""
WITH d AS (SELECT doc_id, {TERMS} AS w FROM documents),
items AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {TERMS} AS w FROM benchmark) WHERE len(w) > 0),
held AS (SELECT DISTINCT n, array_to_string(w[p:p + n - 1], ' ') AS s, item_id FROM (SELECT *, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS p FROM items)),
windows AS (
    SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS s
    FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS p FROM d, (SELECT DISTINCT n FROM items) WHERE len(w) >= n)),
found AS (SELECT doc_id, p, n, item_id FROM windows JOIN held USING (n, s)),
hit AS (SELECT doc_id, count(DISTINCT q) AS k FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM found)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS k, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.k, 0) AS n_hit, coalesce(named.k, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.k, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP13 = rf"""
WITH d AS (SELECT doc_id, {TERMS} AS w FROM documents),
sizes AS (SELECT doc_id, len(w) AS n FROM d WHERE len(w) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sizes),
asked AS (SELECT DISTINCT item_id, unnest({TERMS}) AS term FROM benchmark),
postings AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, total GROUP BY term),
own AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))) AS s FROM postings JOIN weights USING (term) JOIN sizes USING (doc_id), total),
scored AS (SELECT item_id, doc_id, CAST(sum(s) AS BIGINT) AS score FROM asked JOIN own USING (term) GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 50
"""


SQL = {"op2_licences": op2(), "op9_quality": op9(), "op4_passages": OP4, "op5_mixing": OP5, "op7_exact": OP7, "op8_urls": op8(), "op12_decontamination": OP12, "op13_search": OP13}
