"""What SQL says of the license scan, the vector codes and the spelling variants."""

from __future__ import annotations

from . import licenses
from .license_rules import over_words

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def license_scan() -> str:
    """Rules as a table, tried on the texts that hold their longest keyword; places by splitting, as blanks before a match."""
    phrases = [(-1, label, licenses.PHRASE_WEIGHT, max(p.split(), key=len), over_words(p)) for p, label in licenses.PHRASES.items()]
    rules = [(i, r.label, r.weight, max(r.keywords, key=len), r.pattern) for i, r in enumerate(licenses.RULES)]
    values = ", ".join(f"({i}, '{label}', {weight}, '{key}', '{pattern}')" for i, label, weight, key, pattern in phrases + rules)
    blanks = "(length({0}) - length(replace({0}, ' ', '')))"
    return rf"""
        WITH rule(i, label, weight, key, pattern) AS (VALUES {values}),
        d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array({LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
        n AS (SELECT r, doc_id, len(w) AS n_words, ' ' || array_to_string(w, '  ') || ' ' AS line FROM d),
        tried AS (SELECT r, i, label, weight, regexp_extract_all(line, pattern) AS m, regexp_split_to_array(line, pattern) AS b
                  FROM n JOIN rule ON contains(line, ' ' || key || ' ') AND regexp_matches(line, pattern)),
        placed AS (SELECT r, i, label, weight, unnest(list_transform(range(1, len(m) + 1), lambda k: {{
                'a': list_sum(list_transform(b[1:k], lambda x: {blanks.format("x")})) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: {blanks.format("x")})), 0),
                'n': {blanks.format("m[k]")} }})) AS s FROM tried),
        span AS (SELECT r, i, label, weight, s.a // 2 AS a, (s.a + s.n) // 2 AS z FROM placed),
        kept AS (SELECT * FROM span x WHERE i < 0 OR NOT EXISTS (SELECT 1 FROM span y WHERE y.r = x.r AND y.i >= 0 AND y.i < x.i AND y.a <= x.a AND y.z >= x.z))
        SELECT any_value(doc_id) AS doc_id, any_value(n_words) AS n_words, count(*) FILTER (WHERE i < 0) AS n_base,
               min(a) FILTER (WHERE i < 0)::BIGINT AS first_word, max(a) FILTER (WHERE i < 0)::BIGINT AS last_word,
               coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE i < 0), '') AS base_labels,
               coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
               coalesce(max(weight), 0)::DOUBLE AS score
        FROM n LEFT JOIN kept USING (r) GROUP BY r
    """


def vector_codes(width: int = 16) -> str:
    """Each round spelled out, over a row a component."""
    sql = f"""
        WITH k AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
                   FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        u AS (SELECT r, unnest(range(0, {4 * width})) AS j, unnest(v) AS x FROM k),
        p AS (SELECT r, j // {width} AS p, j % {width} AS d, x FROM u),
        c0 AS (SELECT p, r - 1 AS e, d, x FROM p WHERE r <= 256)"""
    for i in range(5):
        sql += f""",
        a{i} AS (SELECT r, p, min(m) % 256 AS e, min(m) // 256 AS far FROM (
                    SELECT r, p.p, sum((p.x - c.x) * (p.x - c.x))::BIGINT * 256 + e AS m FROM p JOIN c{i} c ON p.p = c.p AND p.d = c.d GROUP BY r, p.p, e) GROUP BY r, p)"""
        if i < 4:
            sql += f""",
        c{i + 1} AS (SELECT c.p, c.e, c.d, coalesce(s.x, c.x) AS x FROM c{i} c LEFT JOIN (
                    SELECT p.p, a.e, p.d, floor(sum(p.x)::DOUBLE / count(*))::BIGINT AS x FROM p JOIN a{i} a ON p.r = a.r AND p.p = a.p GROUP BY p.p, a.e, p.d) s ON c.p = s.p AND c.e = s.e AND c.d = s.d)"""
    return f"""{sql},
        coded AS (SELECT r, string_agg(lower(printf('%02x', e::INT)), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM a4 GROUP BY r)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
               (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, d)) FROM c4) AS codebooks_sha256
        FROM k JOIN coded USING (r)
    """


def spelling_variants() -> str:
    """crc32 by bytes; near words meet in what is left of both without one letter, or of one of them."""
    return rf"""
        WITH RECURSIVE crc(n, c, k) AS (SELECT x::BIGINT, x::BIGINT, 0 FROM range(256) t(x)
                    UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8),
        remainders AS (SELECT list(c ORDER BY n) AS t FROM crc WHERE k = 8),
        runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, unnest(regexp_extract_all({LOWER}, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
        counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
        hexed AS (SELECT run, n, hex(encode(doc_id || ':' || run)) AS h FROM counted),
        hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT)),
                    lambda acc, b: xor(acc >> 8, t[(xor(acc, b) & 255) + 1])), 4294967295) AS h FROM hexed, remainders),
        word AS (SELECT word, sum(n)::BIGINT AS n FROM (
                    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
                 WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
        cut AS (SELECT word, n, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM word)),
        near AS (SELECT x.word, x.n, y.word AS near, y.n AS near_n FROM cut x JOIN cut y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
                 UNION SELECT x.word, x.n, y.word, y.n FROM cut x JOIN word y ON x.a || x.b = y.word
                 UNION SELECT y.word, y.n, x.word, x.n FROM cut x JOIN word y ON x.a || x.b = y.word),
        best AS (SELECT word, any_value(n) AS n, count(*) AS n_near, list(near ORDER BY near_n DESC, near)[1] AS near, max(near_n) AS near_n FROM near GROUP BY word),
        form AS (SELECT word, near AS form, near_n AS form_n FROM best WHERE near_n >= 5 * n),
        step(word, last) AS (SELECT word, form FROM form UNION ALL SELECT step.word, form.form FROM step JOIN form ON step.last = form.word),
        root AS (SELECT step.word, step.last FROM step LEFT JOIN form ON form.word = step.last WHERE form.word IS NULL)
        SELECT word, form, coalesce(last, word) AS root, n, coalesce(n_near, 0) AS n_near, form_n
        FROM word LEFT JOIN form USING (word) LEFT JOIN (SELECT word, n_near FROM best) USING (word) LEFT JOIN root USING (word)
    """
