"""SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from . import filter_audit as A
from . import phrases as P
from . import quality_rules as Q

_QUALITY = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
 w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
 win AS (SELECT rid, i, array_to_string(w[i:i + {Q.WINDOW - 1}], ' ') AS s FROM (SELECT rid, w, unnest(generate_series(1, len(w) - {Q.WINDOW - 1})) AS i FROM w WHERE len(w) >= {Q.WINDOW})),
 rep AS (SELECT rid, i FROM win WHERE (rid, s) IN (SELECT (rid, s) FROM win GROUP BY rid, s HAVING count(*) > 1)),
 cov AS (SELECT rid, count(DISTINCT i + j) AS n FROM rep, (SELECT unnest(generate_series(0, {Q.WINDOW - 1})) AS j) GROUP BY rid),
 c AS (SELECT w.rid, doc_id, host, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words FROM w LEFT JOIN cov USING (rid)),
 b AS (SELECT *, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEAT_PCT} * n_words AS base_failed FROM c),
 r AS (SELECT *, base_failed OR 100 * n_symbols > {Q.MAX_SYMBOLS_PER_100_WORDS} * n_words OR 100 * n_dup_lines > {Q.MAX_DUP_LINE_PCT} * n_lines OR word_chars < {Q.MIN_MEAN_WORD} * n_words OR word_chars > {Q.MAX_MEAN_WORD} * n_words AS failed FROM b),
 h AS (SELECT coalesce(host, '') AS k, count(*) AS n, count(*) FILTER (WHERE failed) AS f FROM r GROUP BY 1), mv AS (SELECT greatest(0.001, least(0.999, avg(f / n))) AS m, var_pop(f / n) AS v FROM h),
 p AS (SELECT m, m * (1 - m) / greatest(1e-6, least(v, m * (1 - m) * 0.5)) - 1 AS s FROM mv), hv AS (SELECT k, (f + m * s) / (n + m * s + (1 - m) * s) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT failed AND rate <= {Q.MAX_HOST_FAIL_RATE} AS kept, host, round(rate, 6) AS host_fail_rate FROM r JOIN hv ON coalesce(host, '') = k"""

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PHRASES = rf"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_CAPITALS}', '{_CAPITALS.lower()}') AS t FROM documents),
 p AS (SELECT rid, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS s FROM d),
 w AS (SELECT lang, list_filter(regexp_split_to_array(s, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
 n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
 g AS (SELECT lang, k AS words, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest(generate_series(1, {P.LONGEST})) AS k) WHERE len(w) >= k),
 f AS (SELECT lang, words, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {P.MIN_COUNT}),
 sub AS (SELECT f.lang, a, i, k, array_to_string(string_split(phrase, ' ')[i:i + k - 1], ' ') AS phrase FROM f, (SELECT unnest(generate_series(1, {P.LONGEST})) AS i), (SELECT unnest(generate_series(2, {P.LONGEST})) AS k) WHERE k < words AND i + k - 1 <= words),
 kept AS (SELECT * FROM f WHERE words > 1 AND NOT EXISTS (SELECT 1 FROM sub WHERE sub.lang = f.lang AND sub.phrase = f.phrase AND 100 * sub.a >= 100 * f.a)),
 cut AS (SELECT lang, phrase, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS le, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS ri FROM kept, (SELECT unnest(generate_series(1, {P.LONGEST})) AS k) WHERE k < words),
 scored AS (SELECT cut.lang, cut.phrase, cut.a, k, x.a AS l, y.a AS r, n, (1000::HUGEINT * cut.a * n // (x.a::HUGEINT * y.a))::BIGINT AS score FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = le JOIN f y ON y.lang = cut.lang AND y.phrase = ri JOIN n ON n.lang = cut.lang),
 best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best QUALIFY rank <= {P.TOP}"""

_FAILS = " + ".join(f"CASE WHEN {x} THEN {1 << i} ELSE 0 END" for i, x in enumerate(("len(w) < " + str(A.MIN_WORDS), f"100 * len(list_distinct(w)) < {A.MIN_DISTINCT_PCT} * len(w)", f"100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {A.MAX_CAPITAL_PCT} * length(t)", f"regexp_matches(t, '{A.SYMBOLS}')", "doc_id > first")))
_AUDIT = rf"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 la AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
 m AS (SELECT part, {_FAILS} AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM d LEFT JOIN la USING (doc_id)),
 c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
 b AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
 o AS (SELECT [x1.f, x2.f, x3.f, x4.f, x5.f] AS o, [x1.bit, x2.bit, x3.bit, x4.bit, x5.bit] AS bits FROM b x1, b x2, b x3, b x4, b x5 WHERE x1.bit | x2.bit | x3.bit | x4.bit | x5.bit = 31),
 s AS (SELECT array_to_string(o, '') AS filter_order, k AS step, o[k] AS f, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS before FROM o, (SELECT unnest(generate_series(1, 5)) AS k)),
 r AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (WHERE mask & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0) AS removed, coalesce(sum(n) FILTER (WHERE mask & before <> 0 AND mask & bit <> 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
  coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r"""

ORACLE: dict[str, str] = {"op1_quality_rules": _QUALITY, "op12_phrase_mining": _PHRASES, "op13_filter_audit": _AUDIT}
