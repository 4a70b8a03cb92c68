"""Plain SQL for the results of operators that SQL can express, written for DuckDB."""

from __future__ import annotations

WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
LOWERED = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def mixing(weights: tuple[int, ...], repeats: int) -> str:
    """Targets by the closed form of the sharing, then all copies in one sorted running sum."""
    listed = "[" + ", ".join(f"{w}.0::DOUBLE" for w in weights) + "]"
    return f"""
WITH d AS (SELECT doc_id, source, len({WORDS.format(text="coalesce(text, '')")})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS hash FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM d GROUP BY source),
w AS (SELECT *, {listed}[(rank - 1) % {len(weights)} + 1] AS weight, source_size * {repeats} AS most FROM s),
o AS (
  SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
    sum(weight) OVER (ORDER BY most / weight DESC, rank DESC) AS open_weight, sum(source_size) OVER () AS total FROM w),
shares AS (SELECT (total - used)::DOUBLE / open_weight AS share, most / weight AS level, rank FROM o),
t AS (
  SELECT source, source_size, least(most::DOUBLE, coalesce((SELECT arg_min(share, (level, rank)) FROM shares WHERE share < level), 0) * weight) AS target FROM w),
q AS (
  SELECT d.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY hash, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT doc_id, size, (source_size * copy + ahead + size)::DOUBLE / target AS finish, coalesce('s' || source, 't') AS name, hash, copy
  FROM q, range({repeats}) AS r(copy) WHERE size > 0),
taken AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY finish, name, hash, doc_id, size, copy ROWS UNBOUNDED PRECEDING) AS upto FROM c),
n AS (SELECT doc_id, count(*) AS copies FROM taken WHERE upto <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT doc_id, size, source_size, target, (coalesce(copies, 0) * size)::BIGINT AS taken FROM q LEFT JOIN n USING (doc_id)"""


def quality(in_ngrams: dict[int, float], in_lines: float, symbols: float, least_words: int, repeated: int) -> str:
    """Every n-gram written out; a word is covered if a repeated n-gram begins at most n - 1 words before it."""
    grams = "\nUNION ALL ".join(
        f"SELECT doc_id, k, chars, {n} AS n, CASE WHEN k + {n - 1} <= n_words THEN array_to_string(words[k:k + {n - 1}], ' ') END AS gram FROM w"
        for n in (3, *in_ngrams))
    inside = ", ".join(f"max(chars_inside) FILTER (n = {n}) AS inside_{n}" for n in in_ngrams)
    share = "coalesce(inside_{n}::DOUBLE / nullif(word_chars, 0), 0)"
    too_many = " OR ".join(f"{share.format(n=n)} > {limit}" for n, limit in in_ngrams.items())
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS.format(text="coalesce(text, '')")} AS words FROM documents),
w AS (SELECT doc_id, words, len(words) AS n_words, unnest(range(1, len(words) + 1)) AS k, unnest(list_transform(words, lambda x: length(x))) AS chars FROM d),
g AS ({grams}),
r AS (
  SELECT *, CASE WHEN gram IS NULL THEN false WHEN n = 3 THEN count(*) OVER (PARTITION BY doc_id, n, gram) > 1
    ELSE k > min(k) OVER (PARTITION BY doc_id, n, gram) END AS again FROM g),
c AS (
  SELECT *, coalesce(max(CASE WHEN again THEN k END) OVER (PARTITION BY doc_id, n ORDER BY k) > k - n, false) AS inside FROM r),
m AS (SELECT doc_id, n, count(*) FILTER (inside) AS n_inside, coalesce(sum(chars) FILTER (inside), 0) AS chars_inside FROM c GROUP BY ALL),
b AS (
  SELECT doc_id, max(n_inside) FILTER (n = 3) AS n_repeat_words, {inside} FROM m GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d),
x AS (
  SELECT doc_id, k > min(k) OVER (PARTITION BY doc_id, line) AS again, list_sum(list_transform({WORDS.format(text='line')}, lambda x: length(x))) AS chars
  FROM l WHERE len({WORDS.format(text='line')}) > 0),
y AS (SELECT doc_id, count(*) FILTER (again) AS n_dup_lines, coalesce(sum(chars) FILTER (again), 0) AS chars_again FROM x GROUP BY doc_id),
f AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(chars_again, 0)::BIGINT AS chars_again, {', '.join(f'inside_{n}' for n in in_ngrams)}
  FROM d LEFT JOIN b USING (doc_id) LEFT JOIN y USING (doc_id)),
v AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, coalesce(chars_again::DOUBLE / nullif(word_chars, 0), 0) AS in_lines,
    greatest({', '.join(share.format(n=n) for n in in_ngrams)}) AS in_ngrams, n_words < {least_words} OR 100 * n_repeat_words > {repeated} * n_words AS base_failed,
    {too_many} OR coalesce(chars_again::DOUBLE / nullif(word_chars, 0), 0) > {in_lines} AS too_repetitive FROM f)
SELECT *, NOT (base_failed OR too_repetitive OR n_symbols > {symbols} * n_words) AS kept FROM v"""


def near_copies(width: int, top: int, bottom: int) -> str:
    words = WORDS.format(text=LOWERED.format(text="coalesce(text, '')"))
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {words} AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(words) - {width - 1}, 1) + 1), lambda k: array_to_string(words[k:k + {width - 1}], ' '))) AS shingle
  FROM d WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {bottom} * shared >= {top} * (x.n + y.n - shared)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS seen FROM d UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON ways.a = reach.seen)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(seen) AS component_id
FROM d JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id"""


def archives(least: int) -> str:
    """Base32 from the hexadecimal digest: five digits are four letters."""
    letters = " || ".join(
        f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, {1 + 5 * k}, 5))::BIGINT >> {shift}) & 31)::INTEGER, 1)"
        for k in range(8) for shift in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM p)
SELECT page_id, payload_bytes, {letters} AS payload_digest,
  CASE WHEN payload_bytes >= {least} AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {least} AND first <> page_id THEN first END AS refers_to FROM f"""


def url_rules(rules: tuple[tuple[str, str, str], ...], default: str) -> str:
    host = LOWERED.format(text=r"regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's')")
    return f"""
WITH u AS (
  SELECT row_number() OVER () AS k, page_id, {host} AS host, regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
r(h, p, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)}),
fits AS (
  SELECT k, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, '{default}') AS verdict FROM u LEFT JOIN fits USING (k)"""


def near_vectors(cosine: float) -> str:
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
g AS (
  SELECT vec_id, e FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
ways AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {cosine}),
reach AS (SELECT vec_id, vec_id AS seen FROM v UNION SELECT reach.vec_id, ways.b FROM reach JOIN ways ON ways.a = reach.seen),
c AS (SELECT vec_id, min(seen) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM ways GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""


def chats(control: str, marks: tuple[str, str, str], opening: tuple[str, ...], learnt: str) -> str:
    """The formatted length is that of the marks, the texts, and one character for each that opens a control string."""
    both = "role || text"
    opened = " + ".join(f"length({both}) - length(replace({both}, '{x}', ''))" for x in opening)
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{control}'), (-1, 1, 'assistant', '{control}')))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{learnt}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{learnt}'), '')) AS loss_sha256,
  sum({sum(map(len, marks))} + length({both}) + {opened})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""


def ranked_search(best: int) -> str:
    terms = r"regexp_extract_all({text}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".format(text=LOWERED.format(text="coalesce(text, '')"))
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {terms} AS terms FROM documents),
x AS (SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
p AS (SELECT k, doc_id, n, term, count(*) AS tf FROM (SELECT k, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight FROM f, x),
i AS (SELECT row_number() OVER () AS item, item_id, {terms} AS terms FROM benchmark),
q AS (SELECT DISTINCT item, item_id, unnest(terms) AS term FROM i),
s AS (
  SELECT item, item_id, k, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term), x GROUP BY ALL),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= {best}"""


def vector_codes(parts: int, entries: int, rounds: int, scale: int) -> str:
    """Every part compared to every entry, round by round."""
    steps = [f"""
v AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS k, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT k, part, e[part * len(e) // {parts} + 1:(part + 1) * len(e) // {parts}] AS own FROM v, range({parts}) AS r(part)),
b0 AS (SELECT part, k - 1 AS entry, own FROM p WHERE k <= {entries})"""]
    for n in range(rounds + 1):
        steps.append(f"""
a{n} AS (
  SELECT p.k, p.part, min((list_sum(list_transform(range(1, len(p.own) + 1), lambda i: (p.own[i] - b.own[i]) * (p.own[i] - b.own[i])))::BIGINT, entry)) AS best
  FROM p JOIN b{n} b ON p.part = b.part GROUP BY ALL)""".replace("min((", "min(struct_pack(d := ").replace("::BIGINT, entry))", "::BIGINT, entry := entry))"))
        if n < rounds:
            steps.append(f"""
m{n} AS (
  SELECT part, entry, list((s - ((s % c) + c) % c) // c ORDER BY i) AS own FROM (
    SELECT part, best.entry AS entry, i, sum(own[i])::BIGINT AS s, count(*) AS c FROM (
      SELECT part, best, own, unnest(range(1, len(own) + 1)) AS i FROM a{n} JOIN p USING (k, part)) GROUP BY ALL) GROUP BY ALL),
b{n + 1} AS (SELECT part, entry, coalesce(m{n}.own, b{n}.own) AS own FROM b{n} LEFT JOIN m{n} USING (part, entry))""")
    steps.append(f"""
c AS (SELECT k, string_agg(lower(printf('%02x', best.entry)), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY k),
h AS (SELECT sha256(string_agg(array_to_string(own, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})""")
    return "WITH" + ",".join(steps) + """
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM v JOIN c USING (k), h"""
