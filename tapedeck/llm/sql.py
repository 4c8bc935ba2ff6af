"""DuckDB SQL for the queries of the training-data operators that SQL can express."""

#: Groups of documents by sets of two-word shingles: all pairs that share one, then reachability over links.
NEAR_DUP = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
placed AS (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM texts WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s FROM placed),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
sized AS (SELECT doc_id, s, n FROM shingles JOIN sizes USING (doc_id)),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM sized a JOIN sized b ON a.s = b.s AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 80 * (min(a.n) + min(b.n) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM texts UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT t.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id, t.doc_id = r.component_id AS kept
FROM texts t LEFT JOIN sizes s USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = t.doc_id
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Collocations: all phrases of one to five words counted, then cuts, scores and phrases inside longer ones.
COLLOCATIONS = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all({_LOWER}, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
lengths AS (SELECT unnest(range(1, 6)) AS k),
starts AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM split, lengths WHERE len(w) >= k),
counted AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM starts GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE k = 1 GROUP BY lang),
often AS (SELECT * FROM counted WHERE f >= 100),
cuts AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM often WHERE k > 1),
scored AS (
  SELECT c.lang, c.phrase, c.a, l.f AS l, r.f AS r, n, ((1000 * a::HUGEINT * n) // (l.f::HUGEINT * r.f))::BIGINT AS score,
    row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (1000 * a::HUGEINT * n) // (l.f::HUGEINT * r.f), cut) AS best
  FROM cuts c JOIN totals t ON t.lang = c.lang JOIN often l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:cut], ' ') JOIN often r ON r.lang = c.lang AND r.phrase = array_to_string(w[cut + 1:], ' ')),
longer AS (SELECT lang, f, k, string_split(phrase, ' ') AS w, unnest(range(2, k)) AS m FROM often WHERE k > 2),
inner_parts AS (SELECT lang, f, m, w, unnest(range(1, k - m + 2)) AS i FROM longer),
inside AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS f FROM inner_parts GROUP BY ALL),
whole AS (
  SELECT s.lang, s.phrase, a, l, r, n, score, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
  FROM scored s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase WHERE best = 1 AND (i.f IS NULL OR i.f < a))
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score FROM whole WHERE rank <= 2000
"""

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

#: Ranked search: all documents that share a term with an item are scored.
SEARCH = rf"""
WITH texts AS (SELECT doc_id, {_TERMS} AS w FROM documents),
sizes AS (SELECT doc_id, len(w)::BIGINT AS n FROM texts WHERE len(w) > 0),
totals AS (SELECT count(*)::BIGINT AS total, sum(n)::BIGINT AS length FROM sizes),
sought AS (SELECT item_id, term, count(*)::BIGINT AS q FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
tfs AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(w) AS term FROM texts) WHERE term IN (SELECT term FROM sought) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, totals GROUP BY term, total),
worth AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * total) // length))) AS x FROM tfs JOIN sizes USING (doc_id) JOIN weights USING (term), totals),
scored AS (SELECT item_id, doc_id, sum(q * x)::BIGINT AS score FROM sought JOIN worth USING (term) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

def licenses() -> str:
    """License scans: grams of all words met with those of the templates, hits summed by beginning, beginnings joined."""
    from tapedeck.llm import licenses as of

    gram_rows = ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'" for x in g) + ")" for g in of.grams(of.PHRASES, of.TEMPLATES))
    sizes = ", ".join(f"({i}, {len(t.split())}, '{label}', {i < len(of.PHRASES)})" for i, (t, label) in enumerate([*of.PHRASES, *of.TEMPLATES]))
    return rf"""
WITH grams(template, tpos, w1, w2, w3) AS (VALUES {gram_rows}), sizes(template, length, label, exact) AS (VALUES {sizes}),
texts AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
placed AS (SELECT doc_id, w, unnest(range(0, len(w))) AS pos FROM texts),
votes AS (SELECT doc_id, template, pos - tpos AS start, bit_or(1::BIGINT << tpos) AS hit, min(tpos) AS low, max(tpos) AS high FROM placed JOIN grams ON w[pos + 1] = w1 AND w[pos + 2] = w2 AND (w3 IS NULL OR w[pos + 3] = w3) GROUP BY ALL),
sized AS (SELECT *, CASE WHEN length <= 3 THEN 2 ELSE 3 END AS n FROM votes JOIN sizes USING (template)),
shares AS (SELECT *, bit_count(hit | (hit << 1) | (CASE WHEN n = 3 THEN hit << 2 ELSE 0 END)) / length AS alone, start + low AS first_word, start + high + n AS end_word,
  CASE WHEN exact OR start - lag(start) OVER (PARTITION BY doc_id, template ORDER BY start) > {of.SLACK} THEN 1 ELSE 0 END AS apart FROM sized),
numbered AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY start ROWS UNBOUNDED PRECEDING) AS place FROM shares),
places AS (SELECT doc_id, template, place, length, label, exact, n, bit_or(hit) AS hit, max(alone) AS alone, min(first_word) AS first_word, max(end_word) AS end_word FROM numbered GROUP BY ALL),
judged AS (SELECT *, bit_count(hit | (hit << 1) | (CASE WHEN n = 3 THEN hit << 2 ELSE 0 END)) / length AS share FROM places),
spans AS (SELECT *, CASE WHEN exact THEN share = 1 ELSE alone >= {of.LEAST_SHARE} OR (share >= {of.LEAST_SHARE} AND end_word - first_word <= 2 * length) END AS found FROM judged),
summed AS (SELECT doc_id, count(*) FILTER (WHERE found AND exact) AS n_base, min(first_word) FILTER (WHERE found AND exact) AS first_word, max(first_word) FILTER (WHERE found AND exact) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE found AND exact), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE found), '') AS labels, max(share) FILTER (WHERE NOT exact) AS partly FROM spans GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(partly, 0.0)::DOUBLE END AS score
FROM texts LEFT JOIN summed USING (doc_id)
"""
