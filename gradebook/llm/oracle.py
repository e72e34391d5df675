"""DuckDB statements for the queries of this package that SQL can express.

The others rest on fitted or iterated models (op2, op6, op8), keyed digests by character (op9), or typed JSON and chains
(op1, op3); tests compare them with plain Python or check their rules.
"""

from gradebook.llm.quality_rules import COMMON_WORDS, LEAST_WORDS, MOST_CLASS_DISTANCE, MOST_WORD_DISTANCE

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TOKENS = r"regexp_extract_all(" + _LOWER + r", '[^\x20\x09-\x0D]+')"

ORACLE: dict[str, str] = {
    "op4_decontaminate": f"""
        WITH d AS MATERIALIZED (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
        i AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
        item_windows AS (
         SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS win
         FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
        doc_windows AS (
         SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
         FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)),
        hits AS MATERIALIZED (SELECT doc_id, s, g.n, item_id FROM doc_windows g JOIN item_windows USING (win) WHERE g.n = item_windows.n),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
        items AS (
         SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
         FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
         sha256(coalesce(listed, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op5_suffixes": """
        WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        windows AS (
         SELECT doc_id, p, md5(h[2 * p + 1:2 * p + 200]) AS win
         FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS p FROM d WHERE len(h) >= 200)),
        later AS (
         SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS turn FROM windows) WHERE turn > 1),
        marked AS (SELECT doc_id, p, p > coalesce(lag(p) OVER w + 100, -1) AS opens FROM later WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
        runs AS (
         SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM (
          SELECT doc_id, p, sum(CAST(opens AS INT)) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked) GROUP BY doc_id, run),
        cuts AS (
         SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, list({'a': a, 'b': b} ORDER BY a) AS r FROM runs GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
         CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
         sha256(unhex(CASE WHEN r IS NULL THEN h ELSE concat(h[1:2 * r[1].a], array_to_string(list_transform(
          range(1, len(r) + 1), lambda i: h[2 * r[i].b + 1:CASE WHEN i < len(r) THEN 2 * r[i + 1].a ELSE len(h) END]), '')) END)) AS kept_sha256
        FROM d LEFT JOIN cuts USING (doc_id)""",
    "op7_quality": rf"""
        WITH c AS MATERIALIZED (
         SELECT doc_id, coalesce(lang, chr(0)) AS lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, regexp_replace(t, '[^!-`{{-~]+', '', 'g') AS m,
          list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
         FROM (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents)),
        f AS MATERIALIZED (
         SELECT doc_id, lang, len(w) AS n, length(array_to_string(w, '')) AS chars, length(regexp_replace(m, '[^#*$%&|<>]+', '', 'g')) AS sy,
          length(regexp_replace(m, '[^A-Z]+', '', 'g')) AS cap, length(regexp_replace(m, '[^0-9]+', '', 'g')) AS dig, length(m) AS mk,
          octet_length(encode(t)) - length(t) AS wide, length(t) AS size, len(l) - len(list_distinct(l)) AS dup,
          list_transform([{", ".join(f"'{w}'" for w in COMMON_WORDS)}], lambda k: len(list_filter(w, lambda x: x = k))) AS common FROM c),
        grams AS (
         SELECT doc_id, s, array_to_string(w[s:s + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS s FROM c WHERE len(w) >= 8)),
        repeats AS (
         SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + 8)) AS p FROM (
          SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, g) AS times FROM grams) WHERE times > 1) GROUP BY doc_id),
        counts AS (
         SELECT doc_id, lang, 'class' AS kind, unnest(v) AS v, generate_subscripts(v, 1) AS i FROM (
          SELECT doc_id, lang, [greatest(0, chars - mk - wide), size - chars, sy, cap, dig, mk - sy - cap - dig, wide] AS v FROM f)
         UNION ALL SELECT doc_id, lang, 'word', unnest(v), generate_subscripts(v, 1) FROM (
          SELECT doc_id, lang, list_append(common, n - list_sum(common)) AS v FROM f)),
        shares AS (
         SELECT doc_id, lang, kind, i, v / nullif(sum(v) OVER (PARTITION BY doc_id, kind), 0) AS p FROM counts),
        reference AS (
         SELECT lang, kind, i, sum(v) / nullif(sum(sum(v)) OVER (PARTITION BY lang, kind), 0) AS q FROM counts GROUP BY lang, kind, i),
        far AS (
         SELECT doc_id, kind, sqrt(greatest(0, coalesce(sum(
          CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END), 0) / 2)) AS js
         FROM shares JOIN reference USING (lang, kind, i) WHERE p IS NOT NULL AND q IS NOT NULL GROUP BY doc_id, kind),
        verdicts AS (
         SELECT doc_id, bool_or(js > CASE kind WHEN 'class' THEN {MOST_CLASS_DISTANCE} ELSE {MOST_WORD_DISTANCE} END) AS bad FROM far GROUP BY doc_id),
        base AS (
         SELECT f.*, coalesce(r.n, 0) AS repeats, f.n < 20 OR 100 * coalesce(r.n, 0) > 30 * f.n AS failed
         FROM f LEFT JOIN repeats r USING (doc_id))
        SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(chars AS BIGINT) AS word_chars, CAST(sy AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines,
         CAST(repeats AS BIGINT) AS n_repeat_words, failed AS base_failed, NOT failed AND NOT (n >= {LEAST_WORDS} AND coalesce(bad, FALSE)) AS kept
        FROM base LEFT JOIN verdicts USING (doc_id)""",
    "op10_minhash": f"""
        WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, coalesce({_TOKENS.format('text')}, []) AS w FROM documents),
        s AS MATERIALIZED (
         SELECT DISTINCT doc_id, concat(w[i], ' ', w[i + 1]) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w WHERE len(w) > 1)
         UNION ALL SELECT doc_id, w[1] FROM w WHERE len(w) = 1),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        links AS MATERIALIZED (
         SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id
         JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
         GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.v FROM reach r JOIN links l ON l.u = r.b),
        least_ids AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
        SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, c.component_id = w.doc_id AS kept
        FROM w LEFT JOIN n USING (doc_id) JOIN least_ids c ON c.a = w.doc_id""",
    "op11_hard_negatives": """
        WITH usable AS MATERIALIZED (
         SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
          list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
         FROM embeddings
         WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS MATERIALIZED (
         SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.q, c.q) AS BIGINT) AS score
         FROM usable a, usable c WHERE a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
        positives AS (
         SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
         QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id,
         CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN scored USING (anchor_id)
        WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY rank <= 10""",
    "op12_runs": r"""
        WITH RECURSIVE bits(b, k, c) AS (
         SELECT range, 0, range FROM range(256)
         UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
        crc AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
        sums AS MATERIALIZED (
         SELECT doc_id, text, xor(4294967295, list_reduce(
          list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
          lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS h
         FROM documents, crc),
        plain AS MATERIALIZED (
         SELECT doc_id, h // 10 AS g, h % 10 = 0 AND len(w) > 0 AS tail, w, CAST(len(w) AS BIGINT) AS n
         FROM (SELECT *, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM sums)),
        placed AS (SELECT *, CASE WHEN tail THEN g % n END AS a, CASE WHEN tail THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM plain),
        words AS MATERIALIZED (
         SELECT doc_id, n, i, w[1 + CASE WHEN tail AND i >= a THEN a + (i - a) % p ELSE i END] AS word
         FROM (SELECT *, unnest(range(0, n)) AS i FROM placed)),
        same AS (
         SELECT x.doc_id, x.i, x.i - y.i AS q FROM words x JOIN words y USING (doc_id, word) WHERE y.i < x.i AND 3 * (x.i - y.i) <= x.n),
        stretches AS MATERIALIZED (
         SELECT doc_id, q, min(i) - q AS start, count(*) + q AS length
         FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same)
         GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
        runs AS MATERIALIZED (
         SELECT * FROM stretches r WHERE NOT EXISTS (
          SELECT 1 FROM stretches o WHERE o.doc_id = r.doc_id AND o.q < r.q AND o.start <= r.start AND o.start + o.length >= r.start + r.length)),
        listed AS (
         SELECT doc_id, count(*) AS n_runs,
          string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines
         FROM runs GROUP BY doc_id),
        best AS (
         SELECT r.* FROM runs r WHERE NOT EXISTS (
          SELECT 1 FROM runs o WHERE o.doc_id = r.doc_id AND (
           o.length * r.q > r.length * o.q OR (o.length * r.q = r.length * o.q AND (o.start, o.q) < (r.start, r.q))))),
        dropped AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM runs),
        kept AS (
         SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(q AS BIGINT) AS period,
         CAST(1000 * length // q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
        FROM documents d LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op13_near_vectors": """
        WITH RECURSIVE usable AS MATERIALIZED (
         SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
         WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS MATERIALIZED (
         SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
         WHERE list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))) >= 0.98),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
        counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(b, e.vec_id)) AS component_id,
         e.vec_id <= coalesce(b, e.vec_id) AS kept
        FROM embeddings e LEFT JOIN least ON e.vec_id = least.a LEFT JOIN counts ON e.vec_id = counts.a""",
}
