"""The same results in DuckDB SQL, where SQL can express the operator."""

from __future__ import annotations

from tessella.llm import licenses, url_filter

OP1 = r"""
WITH RECURSIVE
texts AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-zA-Z\x{80}-\x{10FFFF}]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : least(i + 4, len(w))], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM texts)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 9 * c >= 4 * (s.n + t.n)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other),
class AS (SELECT doc_id, min(other) AS class_id FROM reach GROUP BY 1),
degree AS (SELECT x, count(*) AS n FROM links GROUP BY 1)
SELECT d.doc_id, class_id, CAST(coalesce(degree.n, 0) AS BIGINT) AS n_links
FROM documents d JOIN class USING (doc_id) LEFT JOIN degree ON degree.x = d.doc_id
"""

OP5 = r"""
WITH sized AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS k, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY 1),
weighted AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS weight, 3 * source_size AS cap FROM sources),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS DOUBLE)
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighted WINDOW before AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), max(level) OVER () * weight) AS target FROM levels),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM targets),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM sized)
SELECT p.doc_id, p.size, b.source_size, b.target,
       CAST(epochs * size + greatest(0, least(size, CAST(round(target) AS BIGINT) - epochs * source_size - ahead)) AS BIGINT) AS taken
FROM placed p JOIN budgets b ON p.source IS NOT DISTINCT FROM b.source
"""

#: All diagonals of equal words, without seeds; the best window of each ends at an equal word or begins where the texts do.
OP8 = r"""
WITH dw AS (
  SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS p
  FROM (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[0-9a-zA-Z\x{80}-\x{10FFFF}]+') AS w FROM documents)),
iw AS (
  SELECT item_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS p
  FROM (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[0-9a-zA-Z\x{80}-\x{10FFFF}]+') AS w FROM benchmark)),
pairs AS (
  SELECT doc_id, item_id, d.p - i.p AS diagonal, d.p, least(12, i.n) AS need, greatest(1, 1 + d.p - i.p) AS lo, least(d.n, i.n + d.p - i.p) AS hi
  FROM dw d JOIN iw i ON d.word = i.word),
counted AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY p RANGE BETWEEN need - 1 PRECEDING AND CURRENT ROW) AS ending,
         count(*) FILTER (p <= lo + need - 1) OVER (PARTITION BY doc_id, item_id, diagonal) AS beginning
  FROM pairs WHERE hi - lo + 1 >= need),
diagonals AS (
  SELECT doc_id, item_id, diagonal, max(greatest(ending, beginning)) AS matched FROM counted
  GROUP BY doc_id, item_id, diagonal, need HAVING max(greatest(ending, beginning)) >= need - least(2, need // 4))
SELECT doc_id, item_id, count(*) AS n_places, max(matched) AS matched FROM diagonals GROUP BY 1, 2
"""

OP10 = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM texts WHERE len(w) >= 50)),
least_of AS (SELECT h, min(doc_id) AS first_doc FROM windows GROUP BY 1),
gone AS (
  SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS pos
  FROM windows JOIN least_of USING (h) WHERE first_doc < doc_id GROUP BY 1),
kept AS (
  SELECT t.doc_id, len(w) AS n_words, coalesce(len(pos), 0) AS n_removed,
         CASE WHEN pos IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(pos, j)), lambda j: w[j]) END AS k
  FROM texts t LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
"""


def op3() -> str:
    """The fitted weights are part of the text."""
    weights = url_filter.train()
    s = url_filter.SLOTS
    listed = "[" + ", ".join(f"{w:.6f}" if w else "0" for w in weights[1:]) + "]::DOUBLE[]"
    fits = "\n       ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'"
        for h, p, _ in sorted(url_filter.RULES, key=lambda r: (-len(r[0]) - len(r[1]), r[2] != "block"))
    )
    actions = " ".join(f"WHEN '{h}{p}' THEN '{a}'" for h, p, a in url_filter.RULES)

    def logit(text: str, base: int) -> str:
        code = lambda i: f"unicode(m[i + {i}])"
        return (
            f"(SELECT coalesce(sum(weights[1 + {base} + ({code(0)} * 961 + {code(1)} * 31 + {code(2)}) % {s}]) / sqrt(count(*)), 0) "
            f"FROM (SELECT '^' || {text} || '$' AS m, unnest(range(1, len({text}) + 1)) AS i))"
        )

    return rf"""
WITH model AS (SELECT {listed} AS weights),
rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
hosts AS (SELECT page_id, r, regexp_extract(r, '^([^/?#]*)', 1) AS h FROM rest),
split AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substring(r, len(h) + 1), '^([^?#]*)', 1) AS path FROM hosts),
scored AS (
  SELECT page_id, host, path,
       CASE {fits} END AS rule,
       {weights[0]:.6f} + {logit("host", 0)} + {logit("path", s)} AS logit
  FROM split, model)
SELECT page_id, host, path, rule,
       coalesce(CASE rule {actions} END, CASE WHEN logit >= 0 AND host <> '' THEN 'block' ELSE 'allow' END) AS verdict
FROM scored
"""


def op9() -> str:
    """The bigrams of the templates are part of the text."""
    rows = ",\n  ".join(f"('{name}', {[g for g in grams]!r})" for name, grams in licenses.template_bigrams())
    t = licenses.THRESHOLD
    return rf"""
WITH templates(license, grams) AS (VALUES
  {rows}),
plain AS (SELECT doc_id, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS p FROM documents),
units AS (
  SELECT doc_id, unnest(list_concat(string_split(p, chr(10)), list_filter(string_split_regex(p, '\n *\n'), lambda x: contains(x, chr(10))))) AS u FROM plain),
words AS (SELECT doc_id, row_number() OVER () AS unit, list_filter(string_split_regex(u, '[ \n]+'), lambda x: x <> '') AS w FROM units),
grams AS (
  SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words WHERE len(w) > 1),
scored AS (
  SELECT doc_id, unit, license, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice
  FROM grams, templates
  WHERE len(g) >= len(grams) * {t / (2 - t)} AND len(g) <= len(grams) * {(2 - t) / t}),
best AS (SELECT doc_id, unit, arg_max(license, (dice, license)) AS license, max(dice) AS dice FROM scored WHERE dice >= {t} GROUP BY 1, 2)
SELECT doc_id, license, round(max(dice), 6) AS dice, count(*) AS n_units FROM best GROUP BY 1, 2
"""

OP12 = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
