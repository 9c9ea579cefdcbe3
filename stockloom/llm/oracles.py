"""DuckDB SQL for the operators that SQL can express: mixing, quality, exact dedup and the prefix trie.

Sharding needs CRC-32, and the others need models, automata, trees or recursion that SQL lacks; tests
compare those with brute force.
"""

from __future__ import annotations

from stockloom.llm import quality

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# Pareto mix with three strata; weights 5, 2, 1, share 3/2, at most two copies, preference by size in 64ths, seed 20240601.
OP1 = rf"""
WITH sized AS (
  SELECT *, CASE WHEN size >= 1000 THEN 96 WHEN size >= 50 THEN 128 ELSE 64 END::BIGINT AS preference
  FROM (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents)
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM sized GROUP BY source
), weighed AS (
  SELECT *, ([5, 2, 1])[(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight, source_size * 2 AS cap FROM totals
), levels AS (
  SELECT *, (3 * sum(source_size) OVER () - 2 * coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (2 * sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed
), tau AS (
  SELECT min_by(level, cap / weight) AS tau FROM levels WHERE level * weight <= cap
), targets AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce(tau * weight, cap::DOUBLE)) AS target FROM weighed, tau
), classes AS (
  SELECT s.source, s.preference, any_value(t.target) AS target, sum(s.size)::BIGINT AS held
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source GROUP BY s.source, s.preference
), class_levels AS (
  SELECT *, (target - (2 * coalesce(sum(held) OVER (PARTITION BY source ORDER BY preference DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE)
    / nullif(sum(held * preference) OVER (PARTITION BY source ORDER BY preference DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)::DOUBLE AS level
  FROM classes
), source_levels AS (
  SELECT source, arg_max(level, preference) AS level FROM class_levels WHERE level * preference <= 2 GROUP BY source
), copies AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN greatest(least(2.0::DOUBLE, coalesce(l.level * s.preference, 2.0::DOUBLE)), 0.0::DOUBLE) ELSE 0.0::DOUBLE END AS c,
    (('0x' || substr(md5('20240601:' || s.doc_id), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN source_levels l ON s.source IS NOT DISTINCT FROM l.source
), ranked AS (
  SELECT *, floor(c)::BIGINT AS whole, c - floor(c) AS pi,
    CASE WHEN size * 16 > source_size THEN 1 WHEN size * 256 > source_size THEN 2 ELSE 3 END AS stratum,
    CASE WHEN c - floor(c) > 0 THEN (u / (1.0::DOUBLE - u)) * ((1.0::DOUBLE - (c - floor(c))) / (c - floor(c))) END AS q
  FROM copies
), goals AS (
  SELECT source, any_value(target) - sum(whole * size) AS rest,
    sum(CASE WHEN stratum = 1 AND pi > 0 THEN floor(pi * size * 4096.0) ELSE 0 END) / 4096.0 AS e1,
    sum(CASE WHEN stratum = 2 AND pi > 0 THEN floor(pi * size * 4096.0) ELSE 0 END) / 4096.0 AS e2
  FROM ranked GROUP BY source
), along AS (
  SELECT *, sum(size) OVER (PARTITION BY source, stratum ORDER BY q, doc_id) AS until FROM ranked WHERE pi > 0
), first_cut AS (
  SELECT g.source, coalesce(max(CASE WHEN a.until * 2 - a.size <= g.e1 * 2 THEN a.until END), 0) AS t1
  FROM goals g LEFT JOIN along a ON a.source IS NOT DISTINCT FROM g.source AND a.stratum = 1 GROUP BY g.source
), second_cut AS (
  SELECT g.source, any_value(f.t1) AS t1, coalesce(max(CASE WHEN a.until * 2 - a.size <= (g.e1 + g.e2 - f.t1) * 2 THEN a.until END), 0) AS t2
  FROM goals g JOIN first_cut f ON f.source IS NOT DISTINCT FROM g.source
  LEFT JOIN along a ON a.source IS NOT DISTINCT FROM g.source AND a.stratum = 2 GROUP BY g.source
), third_cut AS (
  SELECT g.source, any_value(s.t1) AS t1, any_value(s.t2) AS t2,
    coalesce(max(CASE WHEN a.until * 2 - a.size <= (g.rest - s.t1 - s.t2) * 2 THEN a.until END), 0) AS t3
  FROM goals g JOIN second_cut s ON s.source IS NOT DISTINCT FROM g.source
  LEFT JOIN along a ON a.source IS NOT DISTINCT FROM g.source AND a.stratum = 3 GROUP BY g.source
), taken AS (
  SELECT r.*, coalesce(a.until <= CASE r.stratum WHEN 1 THEN t.t1 WHEN 2 THEN t.t2 ELSE t.t3 END, false) AS extra
  FROM ranked r JOIN third_cut t ON t.source IS NOT DISTINCT FROM r.source
  LEFT JOIN along a ON a.doc_id = r.doc_id AND a.pi > 0
)
SELECT doc_id, size, source_size, target, (whole + extra::BIGINT) * size AS taken FROM taken
"""

# The row with the smallest id of each normalised text stays.
OP4 = r"""
WITH norm AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), grouped AS (
  SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM norm GROUP BY t
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM norm n JOIN grouped g ON n.t = g.t
"""


def _count(members: str) -> str:
    return f"length(regexp_replace(t, '[^{members.replace(chr(39), chr(39) * 2)}]+', '', 'g'))"


_CLASSES = ", ".join(_count(c.replace("\\'", "'")) for c in quality.CLASSES)
_LIST = "[" + ", ".join(f"'{w}'" for w in quality.COMMON_WORDS) + "]"
_N_CHARS, _N_WORDS = len(quality.CLASSES) + 2, len(quality.COMMON_WORDS) + 1


def _distance(a: str, b: str, n: int) -> str:
    half = lambda p, q: f"CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END"
    p, q = f"({a}[i] / list_sum({a})::DOUBLE)", f"({b}[i] / list_sum({b})::DOUBLE)"
    terms = f"list_sum([{half(p, q)} + {half(q, p)} for i in range(1, {n + 1})]) / 2"
    return f"CASE WHEN list_sum({a}) > 0 AND list_sum({b}) > 0 THEN sqrt(greatest({terms}, 0)) END"


# Base counts, both histograms and their distance to the sums of the language's documents that pass the base rules.
OP2 = rf"""
WITH texts AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, {_WORDS} AS words,
    [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(words) - 6)) AS pos, words FROM texts WHERE len(words) >= 8
), keyed AS (
  SELECT doc_id, pos, array_to_string(words[pos:pos + 7], ' ') AS w FROM windows
), repeated AS (
  SELECT doc_id, pos FROM keyed QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1
), covered AS (
  SELECT doc_id, sum(least(8, coalesce(next_pos - pos, 8)))::BIGINT AS n FROM (
    SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS next_pos FROM repeated) GROUP BY doc_id
), counted AS (
  SELECT x.doc_id, x.lang, len(words)::BIGINT AS n_words, length(t) AS chars, {_count(r"\x20\x09-\x0D")} AS white,
    {_count(quality.SYMBOLS)}::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, [{_CLASSES}] AS classes,
    [coalesce(list_position({_LIST}, lower(w)), 0) for w in words] AS marks
  FROM texts x LEFT JOIN covered c ON c.doc_id = x.doc_id
), measured AS (
  SELECT doc_id, lang, n_words, (chars - white)::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < {quality.MIN_WORDS} OR n_repeat_words * 100 > n_words * {quality.MAX_REPEAT_PERCENT} AS base_failed,
    list_concat(classes, [white, chars - white - list_sum(classes)::BIGINT]) AS char_hist,
    [len([m for m in marks if m = k]) for k in range(0, {_N_WORDS})] AS word_hist
  FROM counted
), refs AS (
  SELECT lang, [{", ".join(f"sum(char_hist[{i + 1}])" for i in range(_N_CHARS))}] AS ref_chars,
    [{", ".join(f"sum(word_hist[{i + 1}])" for i in range(_N_WORDS))}] AS ref_words
  FROM measured WHERE NOT base_failed GROUP BY lang
), judged AS (
  SELECT m.*, {_distance("char_hist", "ref_chars", _N_CHARS)} AS char_distance, {_distance("word_hist", "ref_words", _N_WORDS)} AS word_distance
  FROM measured m LEFT JOIN refs r ON r.lang IS NOT DISTINCT FROM m.lang
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (word_chars < {quality.MIN_CHARS_TO_COMPARE} OR coalesce(char_distance <= {quality.MAX_CHAR_DISTANCE}, true))
    AND (n_words < {quality.MIN_WORDS_TO_COMPARE} OR coalesce(word_distance <= {quality.MAX_WORD_DISTANCE}, true)) AS kept
FROM judged
"""


# CRC-32 of the decimal id, its low two bits; conversations are rebuilt as lists, and each prefix of a list is a node.
OP13 = r"""
WITH own AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), lent AS (
  SELECT conv_id, turns, conv_id - conv_id % 20 AS donor,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: unicode(s)::BIGINT)),
      lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT) % 4 AS h
  FROM own
), rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(list_slice(d.turns, 1, a.h), []), list_slice(a.turns, a.h + 1, len(a.turns))) AS seq
  FROM lent a LEFT JOIN own d ON d.conv_id = a.donor
), paths AS (
  SELECT conv_id, len(seq) AS n, d.depth, list_slice(seq, 1, d.depth) AS prefix
  FROM rebuilt, LATERAL (SELECT unnest(range(0, len(seq) + 1)) AS depth) d
), nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM paths GROUP BY prefix, depth
), placed AS (
  SELECT c.*, p.conv_id AS parent_conv_id, p.prefix AS above FROM nodes c LEFT JOIN nodes p ON p.depth = c.depth - 1 AND p.prefix = list_slice(c.prefix, 1, c.depth - 1)
), children AS (
  SELECT above AS prefix, depth - 1 AS depth, count(*) AS n FROM placed WHERE depth > 0 GROUP BY 1, 2
), valued AS (
  SELECT n.prefix, n.depth, (c.n IS NULL)::BIGINT AS leaf,
    CASE WHEN n.depth > 0 THEN (n.n_convs - 1) * len(regexp_extract_all(n.prefix[-1].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS saved
  FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.prefix = n.prefix
), sums AS (
  SELECT list_slice(v.prefix, 1, d.depth) AS prefix, d.depth, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens
  FROM valued v, LATERAL (SELECT unnest(range(0, v.depth + 1)) AS depth) d GROUP BY 1, 2
)
SELECT p.conv_id, p.depth::BIGINT AS depth, p.parent_conv_id, p.n_convs, coalesce(c.n, 0)::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves,
  s.saved_tokens::BIGINT AS saved_tokens, p.ends_sha256
FROM placed p JOIN sums s ON s.depth = p.depth AND s.prefix = p.prefix LEFT JOIN children c ON c.depth = p.depth AND c.prefix = p.prefix
"""

ORACLES = {"op1_pareto_mix": OP1, "op2_distribution_divergence": OP2, "op4_extendible_hash_dedup": OP4, "op13_prefix_trie": OP13}
