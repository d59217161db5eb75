"""DuckDB SQL that computes what ``quality_rules`` returns for ``documents``."""

SPACE = r"[\x20\x09-\x0D]"

RULES = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda x: x <> '') AS ws FROM d),
u AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
g AS (
    SELECT r, pos, word, count(*) OVER z AS width, string_agg(word, ' ') OVER z AS five FROM u
    WINDOW z AS (PARTITION BY r ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
t AS (SELECT r, pos, width = 5 AND count(*) OVER (PARTITION BY r, five, width) > 1 AS twice FROM g),
c AS (SELECT r, pos, bool_or(twice) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS inside FROM t),
rep AS (SELECT r, count(*) FILTER (WHERE inside) AS n_repeat_words FROM c GROUP BY r),
ln AS (SELECT r, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (
    SELECT *, trim(regexp_replace(
        translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACE}+', ' ', 'g'), ' ') AS norm
    FROM ln),
lk AS (SELECT *, len(string_split(norm, ' ')) AS line_words FROM lw WHERE norm <> ''),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lk GROUP BY r),
reps AS (SELECT min(r) AS r FROM d GROUP BY doc_id, source, text),
hosts AS (SELECT source, greatest(4, 0.05::DOUBLE * count(*)) AS most FROM d JOIN reps USING (r) GROUP BY source),
occ AS (SELECT lk.r, lk.source, norm, sum(line_words) AS words FROM lk JOIN reps ON lk.r = reps.r GROUP BY lk.r, lk.source, norm),
often AS (
    SELECT occ.source, norm, most FROM occ JOIN hosts ON occ.source IS NOT DISTINCT FROM hosts.source
    GROUP BY occ.source, norm, most HAVING count(*) > most),
inside AS (
    SELECT r, often.source, often.norm, most, words FROM occ JOIN often
    ON occ.norm = often.norm AND occ.source IS NOT DISTINCT FROM often.source),
own AS (
    SELECT x.r FROM (SELECT r, sum(words) AS n FROM inside GROUP BY r) x JOIN w ON w.r = x.r
    WHERE len(ws) - n >= 0.5::DOUBLE * len(ws)),
common AS (SELECT source, norm FROM inside JOIN own ON own.r = inside.r GROUP BY source, norm, most HAVING count(*) > most),
gone AS (
    SELECT r, sum(line_words) AS removed FROM lk JOIN common
    ON lk.norm = common.norm AND lk.source IS NOT DISTINCT FROM common.source GROUP BY r),
f AS (
    SELECT d.doc_id, d.source, d.text, d.r, len(ws)::BIGINT AS n_words,
        length(regexp_replace(d.text, '{SPACE}', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        (len(ws) - coalesce(removed, 0))::BIGINT AS n_words_left,
        len(ws) < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * len(ws) AS base_failed
    FROM d JOIN w ON w.r = d.r LEFT JOIN rep ON rep.r = d.r LEFT JOIN dup ON dup.r = d.r LEFT JOIN gone ON gone.r = d.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_words_left,
    NOT base_failed AND n_words_left >= 0.2::DOUBLE * n_words AS kept
FROM f
"""
