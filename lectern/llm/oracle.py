"""DuckDB SQL with the same rows as the queries, written plainly from the operators' definitions; the brute force of each."""

from __future__ import annotations

from lectern.llm import centroids, chat, decontam, line_dedup, rules

_SPACE = "[\\x20\\x09-\\x0D]"
_WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}+'), lambda w: w <> '')"


def _count(text: str, part: str) -> str:
    part = part.replace("'", "''")
    return f"((length({text}) - length(replace({text}, '{part}', ''))) // {len(part)})"


def _chat() -> str:
    controls = " + ".join(_count("text", c.decode()) for c in chat.CONTROLS)
    marks = len(chat.OPEN) + len(chat.MIDDLE) + len(chat.CLOSE)
    return f"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum({marks} + length(role) + length(text) + {_count("text", chr(92))} + {controls}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""


def _lines() -> str:
    """All runs of lines that hold MIN_WORDS words, of as many lines at most, as each line has a word; longer repeats are made up of these."""
    least = line_dedup.MIN_WORDS
    return f"""WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
each AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS n FROM split),
counted AS (SELECT *, len(list_filter(string_split_regex(line, '{_SPACE}+'), lambda w: w <> '')) AS words FROM each),
worded AS (SELECT *, row_number() OVER w AS i, sum(words) OVER w AS upto FROM counted WHERE words > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
lists AS (SELECT doc_id, list(line ORDER BY n) AS lines FROM worded GROUP BY 1),
runs AS (SELECT a.doc_id, a.i AS first, b.i AS last, l.lines[a.i : b.i] AS run FROM worded a JOIN worded b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + {least - 1}
    JOIN lists l ON a.doc_id = l.doc_id WHERE b.upto - a.upto + a.words >= {least}),
later AS (SELECT doc_id, first, last FROM runs QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, first) > 1),
gone AS (SELECT DISTINCT w.doc_id, w.n FROM later r JOIN worded w ON r.doc_id = w.doc_id AND w.i BETWEEN r.first AND r.last),
kept AS (SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.n) AS text FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.n = g.n WHERE g.n IS NULL GROUP BY 1),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT s.doc_id, coalesce(k.text, '') AS text, CAST(len(s.parts) AS BIGINT) AS n_lines, coalesce(r.n, 0) AS n_removed FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id LEFT JOIN removed r ON s.doc_id = r.doc_id"""


def _leaks() -> str:
    def grams(table: str, key: str) -> str:
        n = decontam.SHINGLE_WORDS
        worded = f"SELECT {key}, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM {table}"
        return f"SELECT DISTINCT {key}, array_to_string(w[i : i + {n - 1}], ' ') AS gram FROM (SELECT {key}, w, unnest(range(1, len(w) - {n - 2})) AS i FROM ({worded}))"

    def worded(table: str, key: str) -> str:
        return f"SELECT {key}, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM {table}"

    runs = " UNION ALL ".join(f"SELECT doc_id, {k} AS k, unnest(list_distinct(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i : i + {k - 1}], ' ')))) AS run FROM words WHERE len(w) >= {k}" for k in range(1, decontam.SHINGLE_WORDS))
    return f"""WITH d AS ({grams("documents", "doc_id")}), b AS ({grams("benchmark", "item_id")}), n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY 1),
p AS (SELECT d.doc_id, b.item_id, count(*) AS n_shared FROM d JOIN b ON d.gram = b.gram GROUP BY 1, 2),
short AS (SELECT DISTINCT item_id, len(w) AS k, array_to_string(w, ' ') AS run FROM ({worded("benchmark", "item_id")}) WHERE len(w) BETWEEN 1 AND {decontam.SHINGLE_WORDS - 1}),
words AS (SELECT * FROM ({worded("documents", "doc_id")}) WHERE EXISTS (SELECT 1 FROM short)), runs AS ({runs})
SELECT p.doc_id, p.item_id, n.n_item, p.n_shared, p.n_shared / n.n_item AS containment, false AS whole_item FROM p JOIN n ON p.item_id = n.item_id WHERE 100 * p.n_shared >= {decontam.PERCENT} * n.n_item
UNION ALL SELECT DISTINCT r.doc_id, s.item_id, 1, 1, 1.0::DOUBLE, true FROM runs r JOIN short s ON r.k = s.k AND r.run = s.run"""


def _rules() -> str:
    left, steps, classes = "t", [], []
    for name, pattern in rules.CLASSES.items():
        steps.append(f"regexp_replace({left}, '{pattern}', '', 'g') AS less_{name}")
        classes.append((name, f"length({left}) - length(less_{name})"))
        left = f"less_{name}"
    classes.append((rules.REST, f"length({left})"))
    long = " UNION ALL ".join(f"SELECT rid, lang, '{name}' AS class, {n} AS n FROM chars" for name, n in classes)
    term = "CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END"
    return f"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
chars AS (SELECT rid, lang, t, {", ".join(steps)} FROM docs),
long AS ({long}),
sizes AS (SELECT rid, sum(n) AS chars FROM long GROUP BY 1),
char_ref AS (SELECT lang, class, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM long WHERE lang IS NOT NULL GROUP BY 1, 2),
words AS (SELECT rid, lang, unnest(w) AS word FROM docs),
listed AS (SELECT lang, word, count(*) AS n FROM words WHERE lang IS NOT NULL AND regexp_matches(word, '{rules.LETTERS}') GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) <= {rules.N_COMMON}),
found AS (SELECT rid, word, count(*) AS n FROM words WHERE word IN (SELECT word FROM listed) GROUP BY 1, 2),
totals AS (SELECT lang, sum(len(w)) AS n FROM docs GROUP BY 1),
word_ref AS (SELECT l.lang, l.word, l.n / sum(l.n) OVER (PARTITION BY l.lang) AS q, sum(l.n) OVER (PARTITION BY l.lang) / t.n AS cover FROM listed l JOIN totals t ON l.lang = t.lang),
langs AS (SELECT DISTINCT lang FROM char_ref),
char_d AS (SELECT rid, min(d) AS d FROM (SELECT l.rid, r.lang, sqrt(greatest(sum({term}) / 2, 0)) AS d
    FROM (SELECT l.rid, l.class, CASE WHEN s.chars > 0 THEN l.n / s.chars ELSE 0 END AS p FROM long l JOIN sizes s ON l.rid = s.rid) l JOIN char_ref r ON l.class = r.class GROUP BY 1, 2) GROUP BY 1),
bins AS (SELECT d.rid, len(d.w) AS n_words, r.lang, r.q, r.cover, coalesce(f.n, 0) AS n FROM docs d, word_ref r LEFT JOIN found f ON f.rid = d.rid AND f.word = r.word WHERE len(d.w) > 0),
shares AS (SELECT *, sum(n) OVER (PARTITION BY rid, lang) AS every FROM bins),
word_d AS (SELECT rid, min(d) AS d FROM (SELECT rid, lang, CASE WHEN any_value(every) >= {rules.MIN_COVER}::DOUBLE * any_value(cover) * any_value(n_words) THEN sqrt(greatest(sum({term}) / 2, 0)) ELSE 1 END AS d
    FROM (SELECT *, CASE WHEN every > 0 THEN n / every ELSE 0 END AS p FROM shares) GROUP BY 1, 2) GROUP BY 1),
grams AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM docs)),
twice AS (SELECT rid, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(3) r(k) GROUP BY 1),
lines AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
base AS (SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(d.w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, length(d.t) AS chars,
    CASE WHEN length(d.t) > 0 THEN least(coalesce(cd.d, 0), 1) ELSE 0 END AS char_distance, CASE WHEN len(d.w) > 0 THEN least(coalesce(wd.d, 0), 1) ELSE 0 END AS word_distance
    FROM docs d LEFT JOIN lines l ON d.rid = l.rid LEFT JOIN covered c ON d.rid = c.rid LEFT JOIN char_d cd ON d.rid = cd.rid LEFT JOIN word_d wd ON d.rid = wd.rid),
failed AS (SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance,
    NOT base_failed AND (chars < {rules.MIN_CHARS} OR char_distance <= {rules.MAX_CHAR_DISTANCE}) AND (n_words < {rules.MIN_COUNTED_WORDS} OR word_distance <= {rules.MAX_WORD_DISTANCE}) AS kept FROM failed"""


def _clusters() -> str:
    """Whole distances and means in every round."""
    n = centroids.COMPONENTS
    parts = [
        f"""WITH kept AS (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor({centroids.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
FROM embeddings WHERE len(embedding) = {n} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {n}),
hashed AS (SELECT sha256('{centroids.SEED}:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT {centroids.CLUSTERS}),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM hashed)"""
    ]
    for r in range(centroids.ROUNDS + 1):
        parts.append(f"""a{r} AS (SELECT i, arg_min(k, (d, k)) AS k, min(d) AS d FROM
(SELECT i, k, CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept, c{r}) GROUP BY i)""")
        if r < centroids.ROUNDS:
            parts.append(f"""s{r} AS (SELECT k, j, sum(v[j]) AS s, count(*) AS n FROM a{r} JOIN kept USING (i), range(1, {n + 1}) t(j) GROUP BY k, j),
m{r} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM s{r} GROUP BY k),
c{r + 1} AS (SELECT c{r}.k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON c{r}.k = m{r}.k)""")
    a, c = f"a{centroids.ROUNDS}", f"c{centroids.ROUNDS}"
    parts.append(f"facts AS (SELECT k, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM {a} GROUP BY k)")
    return ",\n".join(parts) + f"""
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, cluster_inertia, CAST((SELECT sum(d) FROM {a}) AS BIGINT) AS inertia,
    sha256(array_to_string(c, ',')) AS centroid_sha256 FROM kept JOIN {a} USING (i) JOIN facts USING (k) JOIN {c} USING (k)"""


ORACLE_SQL = {
    "op4_chat_formatting": _chat(),
    "op6_line_dedup": _lines(),
    "op7_quality_rules": _rules(),
    "op10_benchmark_decontamination": _leaks(),
    "op12_centroid_clustering": _clusters(),
}
