"""DuckDB SQL for the rows of those queries that SQL can express.

Left out: personal data (positions of matches and iterated scores), the
classifier (a fitted model) and packing (a tokenizer and a sequential plan);
tests hold those against plain forms.
"""

from __future__ import annotations

from . import license_scan as licenses
from . import mixing as mixes
from . import quality_rules as rules
from .line_dedup import LINES
from .near_dedup import PERCENT, SHINGLE

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"

URL_RULES = """
WITH p AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r AS (
  SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS t(rhost, rpath, rverdict)
), m AS (
  SELECT page_id, rhost || rpath AS rule, rverdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) DESC, length(rpath) DESC) AS n
  FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.rverdict, 'allow') AS verdict
FROM h LEFT JOIN m ON h.page_id = m.page_id AND m.n = 1
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def line_dedup(size: int = LINES) -> str:
    assert size == 3
    return f"""
WITH d AS (
  SELECT doc_id, text, CASE WHEN text IS NULL OR text = '' THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents
), l AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS ix FROM d
), c AS (
  SELECT doc_id, ix, line, lead(line, 1) OVER w AS line1, lead(ix, 2) OVER w AS at2, lead(line, 2) OVER w AS line2
  FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') WINDOW w AS (PARTITION BY doc_id ORDER BY ix)
), win AS (
  SELECT doc_id, ix AS start, at2 AS stop, line || chr(10) || line1 || chr(10) || line2 AS key FROM c WHERE at2 IS NOT NULL
), later AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, start) AS k FROM win) AS r WHERE k > 1
), gone AS (
  SELECT DISTINCT l.doc_id, l.ix FROM l JOIN later r ON l.doc_id = r.doc_id AND l.ix BETWEEN r.start AND r.stop
), rest AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.ix) AS text FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.ix = g.ix WHERE g.ix IS NULL GROUP BY l.doc_id
), n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.lines) AS BIGINT) AS n_lines, coalesce(n.n, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN coalesce(rest.text, '') END AS text
FROM d LEFT JOIN rest ON d.doc_id = rest.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""


def drawn(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15) AS BIGINT)"


def mixing() -> str:
    seed, weights, most = mixes.SEED, mixes.WEIGHTS, mixes.MAX_REPEATS
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len({WORDS.format("text")}), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, count(*) AS docs, CAST(sum(size) AS BIGINT) AS words, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS no FROM d GROUP BY source
), w AS (
  SELECT *, [{', '.join(map(str, weights))}][no % {len(weights)} + 1] AS weight, {most} * words AS cap FROM s
), c AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
         sum(weight) OVER (ORDER BY cap / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM w
), lev AS (
  SELECT coalesce(max(((SELECT sum(words) FROM s) - taken) / free), 0) AS level FROM c WHERE ((SELECT sum(words) FROM s) - taken) / free * weight <= cap
), t AS (
  SELECT source, docs, words, no, round(least(weight * level, CAST(cap AS DOUBLE)), 6) AS target FROM w, lev
), q AS (
  SELECT *, least({mixes.MAX_BLOCKS}, ceil(docs / {mixes.BLOCK_DOCS})) AS blocks, CASE WHEN words > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // words ELSE 0 END AS rounds,
         CAST(floor(target + 0.5) AS BIGINT) AS wanted FROM t
), p AS (
  SELECT doc_id, size, words, target, no, rounds, wanted - rounds * words AS rest, {drawn(f"'{seed}'", "doc_id", "size")} % CAST(blocks AS BIGINT) AS block, {drawn(f"'{seed + 1}'", "doc_id", "size")} AS ord
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
), b AS (
  SELECT no, block, rounds, rest, sum(size) AS bwords FROM p GROUP BY no, block, rounds, rest
), n AS (
  SELECT *, rest - coalesce(sum(bwords) OVER (PARTITION BY no ORDER BY {drawn(f"'{seed}'", "no", "block")}, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS need FROM b
), x AS (
  SELECT p.*, n.need, n.bwords, p.size AS own, n.need - coalesce(sum(p.size) OVER (PARTITION BY p.no, p.block ORDER BY p.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remain
  FROM p JOIN n ON p.no = n.no AND p.block = n.block
), y AS (
  SELECT *, CASE WHEN need <= 0 THEN 0 WHEN need >= bwords THEN size ELSE greatest(0, least(size, remain)) END AS last_words FROM x
), units AS (
  SELECT no, block, unnest(range(1, CAST(rounds + CASE WHEN need > 0 THEN 1 ELSE 0 END AS BIGINT) + 1)) AS round FROM n
), u0 AS (
  SELECT *, row_number() OVER (ORDER BY {drawn(f"'{seed}'", "no", "block", "round")}, no, block, round) - 1 AS number, count(*) OVER () AS total,
         greatest(1, CAST(ceil((SELECT coalesce(sum(words), 0) FROM s) / {mixes.SHARD_WORDS}) AS BIGINT)) AS shards FROM units
), u(no, block, round, number, low, high, first, total) AS (
  SELECT no, block, round, number, CAST(0 AS BIGINT), shards, CAST(0 AS BIGINT), total FROM u0
  UNION ALL
  SELECT no, block, round, number, CASE WHEN goes THEN low ELSE mid END, CASE WHEN goes THEN mid ELSE high END, CASE WHEN goes THEN first ELSE first + left_n END, CASE WHEN goes THEN left_n ELSE total - left_n END
  FROM (SELECT *, number - first < left_n AS goes FROM (SELECT *, CAST(round(total * (mid - low) / (high - low)) AS BIGINT) AS left_n FROM (SELECT *, (low + high) // 2 AS mid FROM u WHERE high - low > 1) AS a) AS b) AS c
)
SELECT doc_id, size, words AS source_size, target, CAST(rounds * size + last_words AS BIGINT) AS taken, CAST(rounds AS BIGINT) AS rounds, CAST(last_words AS BIGINT) AS last_words,
       CASE WHEN size = 0 THEN '' ELSE coalesce((SELECT string_agg(CAST(low AS VARCHAR), ',' ORDER BY round) FROM u WHERE u.high - u.low = 1 AND u.no = y.no AND u.block = y.block AND (u.round <= y.rounds OR y.last_words > 0)), '') END AS shards
FROM y
"""


def license_scan() -> str:
    forms = [(k, True, label, 0, len(p.split()), p.split()) for k, (p, label) in enumerate(licenses.BASE)]
    for template, key, label in licenses.TEMPLATES:
        words, needed = template.split(), key.split()
        ix = next(i for i in range(len(words)) if words[i : i + len(needed)] == needed)
        forms.append((len(forms), False, label, ix, len(needed), words))
    rows = ", ".join(f"({k}, {base}, '{label}', {ix}, {n}, {words})" for k, base, label, ix, n, words in forms)
    return f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
), f AS (
  SELECT * FROM (VALUES {rows}) AS t(id, base, label, key_at, key_n, form)
), fw AS (
  SELECT id, base, label, key_at, key_n, len(form) AS n, unnest(form) AS word, unnest(range(len(form))) AS pos FROM f
), tok AS (
  SELECT doc_id, word, ix FROM (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS ix FROM w) AS a WHERE word IN (SELECT word FROM fw)
), h AS (
  SELECT t.doc_id, fw.id, any_value(fw.base) AS base, any_value(fw.label) AS label, t.ix - fw.pos AS start, count(*) / any_value(fw.n) AS share,
         count(CASE WHEN fw.pos >= fw.key_at AND fw.pos < fw.key_at + fw.key_n THEN 1 END) = any_value(fw.key_n) AS keyed
  FROM tok t JOIN fw ON t.word = fw.word GROUP BY t.doc_id, fw.id, t.ix - fw.pos
), g AS (
  SELECT * FROM h WHERE keyed AND share >= CASE WHEN base THEN 1.0 ELSE {licenses.LEAST_SHARE} END
), r AS (
  SELECT doc_id, count(CASE WHEN base THEN 1 END) AS n_base, min(CASE WHEN base THEN start END) AS first_word, max(CASE WHEN base THEN start END) AS last_word,
         string_agg(DISTINCT CASE WHEN base THEN label END, ',' ORDER BY CASE WHEN base THEN label END) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM g GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM w LEFT JOIN r ON w.doc_id = r.doc_id
"""


def quality_rules() -> str:
    def grams(k: int) -> str:
        keys = " || ' ' || ".join(["word", *(f"lead(word, {i}) OVER w" for i in range(1, k))])
        return f"""g{k} AS (SELECT doc_id, ix, chars, {keys} AS gram FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY ix)),
c{k} AS (SELECT doc_id, ix, chars, CASE WHEN gram IS NOT NULL THEN row_number() OVER (PARTITION BY doc_id, gram ORDER BY ix) END AS nth, CASE WHEN gram IS NOT NULL THEN count(*) OVER (PARTITION BY doc_id, gram) END AS times FROM g{k})"""

    def later(k: int) -> str:
        return f"""s{k} AS (SELECT doc_id, sum(CASE WHEN hit THEN chars ELSE 0 END) AS later FROM (
  SELECT doc_id, chars, max(CASE WHEN nth > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ix ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) = 1 AS hit FROM c{k}) AS q GROUP BY doc_id)"""

    ks = sorted(rules.NGRAM_LIMITS)
    joins = " ".join(f"LEFT JOIN s{k} ON s{k}.doc_id = d.doc_id" for k in ks)
    share = lambda k: f"coalesce(CASE WHEN m.word_chars > 0 THEN s{k}.later / m.word_chars END, 0)"
    line_share = "coalesce(CASE WHEN m.word_chars > 0 THEN ln.dup_chars / m.word_chars END, 0)"
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, {WORDS.format("coalesce(text, '')")} AS words FROM documents
), t AS (
  SELECT doc_id, word, ix, length(word) AS chars FROM (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS ix FROM d) AS a
), {", ".join(grams(k) for k in (3, *ks))}, {", ".join(later(k) for k in ks)}, rep AS (
  SELECT doc_id, sum(CASE WHEN hit THEN 1 ELSE 0 END) AS n FROM (
    SELECT doc_id, max(CASE WHEN times > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ix ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 1 AS hit FROM c3) AS q GROUP BY doc_id
), m AS (SELECT doc_id, count(*) AS n_words, sum(chars) AS word_chars FROM t GROUP BY doc_id), ln AS (
  SELECT doc_id, count(*) AS dup_lines, sum(chars) AS dup_chars FROM (
    SELECT doc_id, line, length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g')) AS chars, row_number() OVER (PARTITION BY doc_id, line) AS nth
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) AS a) AS q WHERE chars > 0 AND nth > 1 GROUP BY doc_id
), o AS (
  SELECT d.doc_id, coalesce(m.n_words, 0) AS n_words, CAST(coalesce(m.word_chars, 0) AS BIGINT) AS word_chars, CAST(length(d.text) - length(translate(d.text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         coalesce(ln.dup_lines, 0) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         coalesce(m.n_words, 0) < {rules.MIN_WORDS} OR 100 * coalesce(rep.n, 0) > {rules.MAX_REPEAT_PERCENT} * coalesce(m.n_words, 0) AS base_failed,
         {line_share} AS dup_line_share, greatest({", ".join(share(k) for k in ks)}) AS dup_ngram_share,
         {line_share} <= {rules.LINE_LIMIT} AND {" AND ".join(f"{share(k)} <= {rules.NGRAM_LIMITS[k]}" for k in ks)} AS within
  FROM d LEFT JOIN m ON m.doc_id = d.doc_id LEFT JOIN ln ON ln.doc_id = d.doc_id LEFT JOIN rep ON rep.doc_id = d.doc_id {joins}
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND within AS kept, CAST(dup_line_share AS DOUBLE) AS dup_line_share, CAST(dup_ngram_share AS DOUBLE) AS dup_ngram_share FROM o
"""


def near_dedup() -> str:
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS words FROM documents
), t AS (
  SELECT doc_id, word, ix, n FROM (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS ix, len(words) AS n FROM w) AS a
), g AS (
  SELECT doc_id, n, {" || ' ' || ".join(["word", *(f"lead(word, {i}) OVER o" for i in range(1, SHINGLE))])} AS shingle FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY ix)
), s AS (
  SELECT DISTINCT doc_id, shingle FROM g WHERE shingle IS NOT NULL
  UNION SELECT doc_id, string_agg(word, ' ' ORDER BY ix) FROM t WHERE n < {SHINGLE} GROUP BY doc_id
), c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), i AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM i JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * k >= {PERCENT} * (x.n + y.n - k)
), pair AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), reach(a, b) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT r.a, x.b FROM reach r JOIN pair x ON r.b = x.a
), least_of AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(c.n, 0) AS n_shingles, m.low AS component_id, w.doc_id = m.low AS kept FROM w LEFT JOIN c ON c.doc_id = w.doc_id JOIN least_of m ON m.a = w.doc_id
"""
