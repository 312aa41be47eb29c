"""DuckDB SQL with the rows that the queries of this package must return, where SQL can say it."""

# Rules of op2 in their order, as (votes good where, votes bad where).
_RULES = [
    ("n_words >= 40", "n_words < 12"),
    ("false", "word_chars > 14 * n_words OR 10 * word_chars < 20 * n_words"),
    ("false", "10 * n_symbols > n_words"),
    ("20 * n_marks <= word_chars", "100 * n_marks > 8 * word_chars"),
    ("false", "100 * n_symbols > 4 * n_words AND 100 * n_marks > 6 * word_chars"),
    ("false", "n_dup_lines >= 3 AND 2 * n_dup_lines > n_lines"),
    ("false", "4 * n_repeat_words > n_words"),
    ("false", "100 * n_capitals > 30 * n_letters"),
    ("false", "10 * n_exclaims > n_words"),
    ("n_words BETWEEN 20 AND 400 AND 10 * n_distinct >= 4 * n_words", "n_words BETWEEN 20 AND 1000 AND 5 * n_distinct < n_words"),
    ("n_ends >= 1 AND 80 * n_ends >= n_words AND 3 * n_ends <= n_words", "n_words >= 50 AND 400 * n_ends < n_words"),
]
_VOTES = "[" + ", ".join(f"CASE WHEN {bad} THEN 0 WHEN {good} THEN 1 ELSE -1 END" for good, bad in _RULES) + "]"
_JS = f"range(1, {len(_RULES) + 1})"


def _count(characters):
    return f"length(regexp_replace(t, '[^{characters}]+', '', 'g'))"


def _odds(votes):
    raised = lambda over, under: f"ln(least(40.0::double, greatest(1.0::double, {over}[j] / {under}[j])))"
    return (
        f"(ln(good / (1 - good)) + list_sum(list_transform({_JS}, lambda j: CASE {votes}[j] WHEN 1 THEN {raised('gg', 'gb')} "
        f"WHEN 0 THEN -{raised('bb', 'bg')} ELSE 0.0::double END)))"
    )


def _rate(vote, what, start):
    return (
        f"list_transform({_JS}, lambda j: (2.0::double * {start}::double + list_sum(list_transform(w, lambda e: CASE WHEN e.votes[j] = {vote} "
        f"THEN e.{what} ELSE 0.0::double END))) / (2.0::double + list_sum(list_transform(w, lambda e: e.{what}))))"
    )


_QUALITY = f"""
WITH RECURSIVE texts AS (
    SELECT doc_id, coalesce(text, '') AS t,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
    FROM documents),
windows AS (
    SELECT doc_id, unnest(range(1, len(words) - 6)) AS i,
        unnest(list_transform(range(1, len(words) - 6), lambda k: array_to_string(words[k:k + 7], ' '))) AS w
    FROM texts WHERE len(words) >= 8),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
covered AS (
    SELECT doc_id, sum(n)::bigint AS n_repeat_words
    FROM (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS n FROM again) GROUP BY doc_id),
measured AS (
    SELECT doc_id, len(words)::bigint AS n_words, length(array_to_string(words, ''))::bigint AS word_chars, len(lines) AS n_lines,
        {_count('#*$%&|<>')}::bigint AS n_symbols, (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines,
        coalesce(n_repeat_words, 0)::bigint AS n_repeat_words, {_count('\\p{L}')} AS n_letters, {_count('\\p{Lu}')} AS n_capitals,
        length(regexp_replace(t, '[\\p{{L}}\\p{{M}}\\p{{N}}\\x20\\x09-\\x0D]+', '', 'g')) AS n_marks,
        {_count('!')} AS n_exclaims, {_count('.?!…。')} AS n_ends, len(list_distinct(words)) AS n_distinct
    FROM texts LEFT JOIN covered USING (doc_id)),
voted AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {_VOTES} AS votes FROM measured),
patterns AS (SELECT list({{'votes': votes, 'n': n}} ORDER BY votes) AS held FROM (SELECT votes, count(*) AS n FROM voted GROUP BY votes)),
em AS (
    SELECT 0 AS i, 0.85::double AS good, list_transform({_JS}, lambda j: 0.3::double) AS gg, list_transform({_JS}, lambda j: 0.05::double) AS gb,
        list_transform({_JS}, lambda j: 0.3::double) AS bb, list_transform({_JS}, lambda j: 0.05::double) AS bg
    UNION ALL
    SELECT i + 1, least(0.99, greatest(0.01, (2.0::double * 0.85::double + list_sum(list_transform(w, lambda e: e.of_good)))
            / (2.0::double + list_sum(list_transform(w, lambda e: e.of_good)) + list_sum(list_transform(w, lambda e: e.of_bad))))),
        {_rate(1, 'of_good', 0.3)}, {_rate(1, 'of_bad', 0.05)}, {_rate(0, 'of_bad', 0.3)}, {_rate(0, 'of_good', 0.05)}
    FROM (SELECT em.i, list_transform(held, lambda e: {{'votes': e.votes, 'of_good': e.n * (1 / (1 + exp(-{_odds('e.votes')}))),
            'of_bad': e.n * (1 - 1 / (1 + exp(-{_odds('e.votes')})))}}) AS w FROM em, patterns WHERE em.i < 40))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND posterior >= 0.5 AS kept, posterior
FROM (SELECT voted.*, round(1 / (1 + exp(-{_odds('votes')})), 6) AS posterior FROM voted, (SELECT * FROM em WHERE i = 40))
"""

ORACLES = {
    "op2_quality_rules": _QUALITY,
    "op5_exact_dedup": r"""
WITH normal AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
grouped AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM normal GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM normal JOIN grouped USING (t)
""",
    "op8_url_filters": r"""
WITH rules(host_rule, path_rule, verdict) AS (VALUES
    ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
rest AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
    FROM rest)
SELECT page_id, host, path,
    (SELECT arg_max(host_rule || path_rule, length(host_rule || path_rule)) FROM rules
     WHERE (host = host_rule OR ends_with(host, '.' || host_rule)) AND starts_with(path, path_rule)) AS rule,
    coalesce((SELECT arg_max(verdict, length(host_rule || path_rule)) FROM rules
     WHERE (host = host_rule OR ends_with(host, '.' || host_rule)) AND starts_with(path, path_rule)), 'allow') AS verdict
FROM parts
""",
    "op13_line_dedup": r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM split),
keyed AS (
    SELECT *, translate(regexp_replace(line, '^[\t-\r ]+|[\t-\r ]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM lines),
shared AS (SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT doc_id, line, pos, holder IS NOT NULL AND doc_id <> holder AS dropped FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""",
}
