"""Independent SQL for the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from tierlift.plans import ordered_queries, stream_queries

# The English stop words of Spark ML, stated here for the SQL side.
ENGLISH = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
she her hers herself it its itself they them their theirs themselves what which who whom
this that these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about against between
into through during before after above below to from up down in out on off over under again
further then once here there when where why how all any both each few more most other some
such no nor not only own same so than too very s t can will just don should now i'll you'll
he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're
they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't
doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's
how's let's ought that's there's what's when's where's who's why's would
""".split()

# The domain words.
DOMAIN = """
will can work experience years services client clients project projects provide quality time
best also good looking help need like great job high satisfaction guaranteed freelancer
freelance expert professional etc hello hi thanks welcome
""".split()


def _quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


LINKS = """
item_ids AS (SELECT p_name AS item_name, min(p_partkey) AS item_id FROM part GROUP BY p_name),
links AS (
  SELECT DISTINCT o.o_custkey AS entity_id, i.item_id, p.p_name AS item_name
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN item_ids i ON i.item_name = p.p_name)
"""

ENTITIES = LINKS + """,
spend AS (
  SELECT o_custkey, sum(CAST(o_totalprice AS decimal(18,2)))::double AS metric,
         max(o_totalprice) AS rate, count(*) AS event_count
  FROM orders GROUP BY o_custkey),
held AS (SELECT entity_id, count(*) AS item_count FROM links GROUP BY entity_id),
base AS (
  SELECT c.c_custkey AS entity_id, coalesce(n.n_name, 'Unknown') AS region,
         coalesce(c.c_mktsegment, 'Unknown') AS locality,
         coalesce(s.metric, 0.0) AS metric, coalesce(s.rate, 0.0) AS rate,
         coalesce(s.event_count, 0) AS event_count, coalesce(h.item_count, 0) AS item_count,
         n.n_nationkey::double AS latitude, n.n_regionkey::double AS longitude
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN spend s ON s.o_custkey = c.c_custkey
  LEFT JOIN held h ON h.entity_id = c.c_custkey),
entities AS (
  SELECT *, ln(1 + metric) AS log_metric,
         metric >= (SELECT quantile_cont(metric, 0.9) FROM base) AND metric > 0 AS is_top
  FROM base)
"""


def money_mean(c: str) -> str:
    return f"sum(CAST({c} AS decimal(18,4)))::double / count({c})"


TOP = "count(*) FILTER (WHERE is_top)"

STATS = ENTITIES + f""",
stats AS (
  SELECT item_id, item_name, count(*) AS entity_count,
         count(*)::double / (SELECT count(*) FROM entities) AS prevalence,
         median(metric)::double AS median_metric, {money_mean('metric')} AS mean_metric,
         median(log_metric) AS median_log_metric, {TOP}::double / count(*) AS top_rate,
         median(rate) AS median_rate, {money_mean('rate')} AS mean_rate,
         median(item_count)::double AS median_item_count
  FROM entities JOIN links USING (entity_id)
  GROUP BY item_id, item_name HAVING count(*) >= 15)
"""

OVERVIEW = ENTITIES + f""",
overview AS (
  SELECT count(*) AS total_entities, {TOP} AS total_top, {TOP}::double / count(*) AS top_rate,
         median(metric)::double AS median_metric, {money_mean('metric')} AS mean_metric,
         round(stddev_samp(metric), 4) AS std_metric, median(rate) AS median_rate,
         {money_mean('rate')} AS mean_rate, median(item_count)::double AS median_items_per_entity,
         sum(item_count)::double / count(*) AS mean_items_per_entity,
         median(event_count)::double AS median_event_count,
         sum(event_count)::double / count(*) AS mean_event_count,
         (SELECT count(DISTINCT item_name) FROM links) AS total_distinct_items
  FROM entities)
"""

# --- raw documents as records -----------------------------------------------------

RECORDS = """
records AS (
  SELECT doc_id, source || '-' || lang AS entity_id, n_chars::double AS metric,
         lang AS region, source AS locality, n_chars + 0.5::double AS rate, text,
         string_split(text, ' ') AS words, string_split(text, chr(10)) AS lines,
         CASE WHEN lang = 'de' THEN '' ELSE source END AS tagline,
         lang, doc_id * 0.5::double AS lat,
         CASE WHEN lang <> 'fr' THEN doc_id * 0.25::double END AS lon,
         lpad((doc_id // 100)::varchar, 12, '0') AS file, (doc_id % 100)::int AS pos
  FROM documents)
"""

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def strip(c: str) -> str:
    return f"trim({c}, {BLANKS})"


WORDS = RECORDS + f""",
spelled AS (
  SELECT doc_id, unnest(words) AS raw, generate_subscripts(words, 1) - 1 AS item_id
  FROM records),
mentions AS (
  SELECT doc_id, item_id, {strip('raw')} AS item_name, length(raw) >= 4 AS explicit
  FROM spelled WHERE {strip('raw')} <> ''),
doc_links AS (
  SELECT doc_id AS entity_id, item_id, item_name FROM mentions WHERE explicit
  QUALIFY row_number() OVER (PARTITION BY doc_id, lower(item_name) ORDER BY item_id) = 1),
line_rows AS (
  SELECT doc_id, unnest(lines) AS raw, generate_subscripts(lines, 1) AS child_id FROM records),
children AS (
  SELECT doc_id AS entity_id, child_id, {strip('raw')} AS title, '' AS description
  FROM line_rows WHERE {strip('raw')} <> ''),
texts AS (
  SELECT doc_id AS entity_id, {strip('text')} AS profile_text, tagline,
         coalesce(c.child_text, '') AS child_text,
         {strip("tagline || ' ' || " + strip('text') + " || ' ' || coalesce(c.child_text, '')")}
           AS combined_text
  FROM records r LEFT JOIN (
    SELECT entity_id, string_agg(title, ' ' ORDER BY child_id) AS child_text
    FROM children GROUP BY entity_id) c ON c.entity_id = r.doc_id),
doc_entities AS (
  SELECT doc_id AS entity_id, lang AS handle, lang AS display_name, region, locality, rate,
         metric, 0.0::double AS reputation, len(lines) AS event_count, 0.0::double AS stars,
         0.0::double AS score, lat AS latitude, lon AS longitude,
         coalesce(k.n, 0) AS item_count, round(ln(1 + metric), 6) AS log_metric,
         metric >= (SELECT quantile_cont(metric, 0.9) FROM records) AND metric > 0 AS is_top
  FROM records r LEFT JOIN (
    SELECT entity_id, count(*) AS n FROM doc_links GROUP BY entity_id) k
    ON k.entity_id = r.doc_id)
"""

# --- bundles ----------------------------------------------------------------------


def scaled_tail_sql(x: str) -> str:
    """exp(x^2) erfc(x) less its pole term: the trapezoid sum, step 1/2, of exp(-t^2)/(t^2+x^2)."""
    terms = " + ".join(f"exp(-{n * n / 4}::double) / ({n * n / 4}::double + {x} * {x})"
                       for n in range(1, 15))
    return f"({x} / (2 * pi()) * (1 / ({x} * {x}) + 2 * ({terms})))"


def erfc_sql(x: str) -> str:
    """Another way to the same function: the sum above and the residue of its pole."""
    pole = f"CASE WHEN {x} < 2 * pi() THEN 2 / (1 - exp(4 * pi() * {x})) ELSE 0 END"
    return (f"CASE WHEN {x} = 0 THEN 1.0::double "
            f"ELSE exp(-{x} * {x}) * {scaled_tail_sql(x)} + {pole} END")


MINING = ENTITIES + """,
totals AS (
  SELECT count(*) AS total, count(*) FILTER (WHERE is_top) AS top,
         greatest(20, floor(0.002::double * count(*)))::bigint AS needed FROM entities),
items AS (
  SELECT item_name, n, row_number() OVER (ORDER BY n DESC, item_name) AS r FROM (
    SELECT item_name, count(*) AS n FROM links GROUP BY item_name HAVING count(*) >= 15)),
coded AS (
  SELECT l.entity_id, i.r, e.is_top::int AS top FROM links l
  JOIN items i USING (item_name) JOIN entities e USING (entity_id)),
pairs AS (
  SELECT x.r AS i, y.r AS j, count(*) AS n, sum(x.top)::bigint AS a
  FROM coded x JOIN coded y ON x.entity_id = y.entity_id AND x.r < y.r
  GROUP BY x.r, y.r HAVING count(*) >= (SELECT needed FROM totals)),
seeds AS (SELECT i, j FROM pairs ORDER BY n DESC, i, j LIMIT 300),
triples AS (
  SELECT s.i, s.j, z.r AS k, count(*) AS n, sum(x.top)::bigint AS a
  FROM seeds s JOIN coded x ON x.r = s.i
  JOIN coded y ON y.r = s.j AND y.entity_id = x.entity_id
  JOIN coded z ON z.entity_id = x.entity_id AND z.r > s.j
  GROUP BY s.i, s.j, z.r HAVING count(*) >= (SELECT needed FROM totals))
"""

BUNDLES = MINING + f""",
named AS (
  SELECT list_sort([a1.item_name, a2.item_name]) AS members, 2 AS bundle_size, p.n, p.a,
         (a1.n::double / total) * (a2.n::double / total) AS expected_prevalence
  FROM pairs p JOIN items a1 ON a1.r = p.i JOIN items a2 ON a2.r = p.j, totals
  UNION ALL
  SELECT list_sort([a1.item_name, a2.item_name, a3.item_name]), 3, p.n, p.a,
         (a1.n::double / total) * (a2.n::double / total) * (a3.n::double / total)
  FROM triples p JOIN items a1 ON a1.r = p.i JOIN items a2 ON a2.r = p.j
  JOIN items a3 ON a3.r = p.k, totals),
cells AS (
  SELECT *, a::double AS ca, (n - a)::double AS cb, (top - a)::double AS cc,
         (total - top - (n - a))::double AS cd, total, top
  FROM named, totals),
fixed AS (
  SELECT *, CASE WHEN least(ca, cb, cc, cd) = 0 THEN 0.5::double ELSE 0 END AS h FROM cells),
odds AS (
  SELECT *, ((ca + h) * (cd + h)) / ((cb + h) * (cc + h)) AS odds_ratio,
         sqrt(1 / (ca + h) + 1 / (cb + h) + 1 / (cc + h) + 1 / (cd + h)) AS se,
         greatest(abs(ca * cd - cb * cc) - (ca + cb + cc + cd) / 2, 0) AS gap
  FROM fixed),
chis AS (
  SELECT *, ((ca + cb + cc + cd) * (gap * gap))
         / ((ca + cb) * (cc + cd) * (ca + cc) * (cb + cd) + 1e-9) AS chi2
  FROM odds),
tails AS (
  SELECT *, sqrt(chi2 / 2) AS z FROM chis),
bundles AS (
  SELECT list_aggregate(members, 'string_agg', ' + ') AS bundle_name, members,
         to_json(members)::varchar AS bundle_items, bundle_size, n AS entity_count,
         n::double / total AS support, expected_prevalence,
         (n::double / total) / expected_prevalence AS lift, a AS top_count,
         a::double / n AS top_rate,
         CASE WHEN top > 0 THEN (a::double / n) / (top::double / total) ELSE 1 END AS top_lift,
         odds_ratio, exp(ln(odds_ratio) - 1.96::double * se) AS ci_lower,
         exp(ln(odds_ratio) + 1.96::double * se) AS ci_upper, chi2,
         least(1.0::double, {erfc_sql('z')}) AS p_value
  FROM tails),
fdr AS (
  SELECT *, min(least(1.0::double, p_value * m / rank)) OVER (
           ORDER BY p_value DESC, rank DESC
           RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS adjusted_p_value
  FROM (SELECT *, count(*) OVER () AS m,
               count(*) OVER (ORDER BY p_value RANGE BETWEEN UNBOUNDED PRECEDING
                              AND CURRENT ROW) AS rank FROM bundles))
"""

# Triples of all frequent pairs.
ALL_BUNDLES = BUNDLES.replace(
    "seeds AS (SELECT i, j FROM pairs ORDER BY n DESC, i, j LIMIT 300)",
    "seeds AS (SELECT i, j FROM pairs)")

REGIONAL = MINING + f""",
regions AS (
  SELECT region, count(*) AS region_entities, count(*) FILTER (WHERE is_top) AS region_top
  FROM entities WHERE region <> 'Unknown' GROUP BY region HAVING count(*) >= 15),
placed AS (
  SELECT c.*, e.region FROM coded c JOIN entities e USING (entity_id)
  WHERE e.region <> 'Unknown'),
regional_held AS (
  SELECT x.region, [x.r, y.r] AS ranks, count(*) AS n, sum(x.top)::bigint AS a
  FROM placed x JOIN placed y ON x.entity_id = y.entity_id AND x.r < y.r
  SEMI JOIN pairs p ON p.i = x.r AND p.j = y.r
  GROUP BY x.region, x.r, y.r HAVING count(*) >= 5
  UNION ALL
  SELECT x.region, [x.r, y.r, z.r], count(*), sum(x.top)::bigint
  FROM triples t JOIN placed x ON x.r = t.i
  JOIN placed y ON y.r = t.j AND y.entity_id = x.entity_id
  JOIN placed z ON z.r = t.k AND z.entity_id = x.entity_id
  GROUP BY x.region, x.r, y.r, z.r HAVING count(*) >= 5),
regional AS (
  SELECT h.*, g.region_entities AS total, g.region_top AS top, a::double AS ca,
         (n - a)::double AS cb, (region_top - a)::double AS cc,
         (region_entities - region_top - (n - a))::double AS cd
  FROM regional_held h JOIN regions g USING (region)),
measured AS (
  SELECT *, ((ca + h) * (cd + h)) / ((cb + h) * (cc + h)) AS odds_ratio,
         greatest(abs(ca * cd - cb * cc) - (ca + cb + cc + cd) / 2, 0) AS gap
  FROM (SELECT *, CASE WHEN least(ca, cb, cc, cd) = 0 THEN 0.5::double ELSE 0 END AS h
        FROM regional)),
tested AS (
  SELECT *, sqrt(chi2 / 2) AS z FROM (
    SELECT *, ((ca + cb + cc + cd) * (gap * gap))
           / ((ca + cb) * (cc + cd) * (ca + cc) * (cb + cd) + 1e-9) AS chi2 FROM measured)),
named_regional AS (
  SELECT region, (SELECT string_agg(item_name, ' + ' ORDER BY item_name) FROM items
                  WHERE list_contains(ranks, r)) AS bundle_name, len(ranks)::int AS bundle_size,
         n AS entity_count, a AS top_count, a::double / n AS top_rate,
         CASE WHEN top > 0 THEN (a::double / n) / (top::double / total) ELSE 1 END AS top_lift,
         odds_ratio, chi2, least(1.0::double, {erfc_sql('z')}) AS p_value
  FROM tested),
regional_fdr AS (
  SELECT *, min(least(1.0::double, p_value * m / rank)) OVER (
           PARTITION BY region ORDER BY p_value DESC, rank DESC
           RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS adjusted_p_value
  FROM (SELECT *, count(*) OVER (PARTITION BY region) AS m,
               count(*) OVER (PARTITION BY region ORDER BY p_value
                              RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rank
        FROM named_regional))
"""

REGIONAL_COLUMNS = """region, bundle_name, bundle_size, entity_count, top_count,
       round(top_rate, 6) AS top_rate, round(top_lift, 6) AS top_lift,
       round(odds_ratio, 6) AS odds_ratio, round(chi2, 6) AS chi2,
       round(p_value, 6) AS p_value, round(adjusted_p_value, 6) AS adjusted_p_value,
       adjusted_p_value < 0.05 AS is_significant"""

BY_LIFT = "top_lift DESC, entity_count DESC, bundle_name"

# --- graph ------------------------------------------------------------------------

EDGES = """
held AS (
  SELECT DISTINCT l.l_orderkey AS entity_id, p.p_name AS item_name
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
top_items AS (
  SELECT item_name FROM held GROUP BY item_name ORDER BY count(*) DESC, item_name LIMIT 150),
kept AS (SELECT * FROM held SEMI JOIN top_items USING (item_name)),
every AS (
  SELECT a.item_name AS source, b.item_name AS target, count(*) AS weight
  FROM kept a JOIN kept b ON a.entity_id = b.entity_id AND a.item_name < b.item_name
  GROUP BY 1, 2),
edges AS (SELECT * FROM every WHERE weight >= 25),
arcs AS (
  SELECT source AS u, target AS v, weight AS w FROM edges
  UNION ALL SELECT target, source, weight FROM edges),
nodes AS (SELECT DISTINCT u AS node FROM arcs),
degrees AS (
  SELECT u AS node, count(*) AS degree, sum(w)::bigint AS weighted_degree,
         count(*)::double / ((SELECT count(*) FROM nodes) - 1) AS degree_centrality
  FROM arcs GROUP BY u)
"""

# All shortest paths by recursion: first distances (a key keeps only its best row), then
# paths along arcs that fit the distances.
PATHS = EDGES + """,
dist(s, v, d) USING KEY (s, v) AS (
  SELECT node, node, 0::bigint FROM nodes
  UNION ALL
  SELECT s, v, d FROM (
    SELECT x.s, a.v, min(x.d + a.w) AS d FROM dist x JOIN arcs a ON a.u = x.v GROUP BY 1, 2) c
  WHERE NOT EXISTS (
    SELECT 1 FROM recurring.dist r WHERE r.s = c.s AND r.v = c.v AND r.d <= c.d)),
tight AS (
  SELECT x.s, a.u, a.v FROM dist x JOIN arcs a ON a.u = x.v
  JOIN dist y ON y.s = x.s AND y.v = a.v AND x.d + a.w = y.d),
walks(s, v, hops, n) AS (
  SELECT node, node, 0, 1::double FROM nodes
  UNION ALL
  SELECT w.s, t.v, w.hops + 1, sum(w.n) FROM walks w JOIN tight t ON t.s = w.s AND t.u = w.v
  GROUP BY 1, 2, 3),
sigma AS (SELECT s, v, sum(n) AS n FROM walks GROUP BY 1, 2),
through AS (
  SELECT m.v AS node, sum(a.n * c.n / e.n) AS pairs
  FROM sigma e JOIN dist d ON d.s = e.s AND d.v = e.v
  JOIN dist m ON m.s = e.s
  JOIN dist q ON q.s = m.v AND q.v = e.v
  JOIN sigma a ON a.s = e.s AND a.v = m.v
  JOIN sigma c ON c.s = m.v AND c.v = e.v
  WHERE e.s <> e.v AND m.v <> e.s AND m.v <> e.v AND m.d + q.d = d.d
  GROUP BY m.v),
betweenness AS (
  SELECT n.node, coalesce(t.pairs, 0) / (
           ((SELECT count(*) FROM nodes) - 1) * ((SELECT count(*) FROM nodes) - 2))
         AS betweenness
  FROM nodes n LEFT JOIN through t USING (node))
"""

HOPS = EDGES + """,
hop(s, v, d) USING KEY (s, v) AS (
  SELECT node, node, 0::bigint FROM nodes
  UNION ALL
  SELECT s, v, d FROM (
    SELECT x.s, a.v, min(x.d + 1) AS d FROM hop x JOIN arcs a ON a.u = x.v GROUP BY 1, 2) c
  WHERE NOT EXISTS (
    SELECT 1 FROM recurring.hop r WHERE r.s = c.s AND r.v = c.v AND r.d <= c.d))
"""

# --- text -------------------------------------------------------------------------

SPACES = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def clean_sql(c: str) -> str:
    spaced = f"regexp_replace(lower(coalesce({c}, '')), '{SPACES}', ' ', 'g')"
    no_urls = f"regexp_replace({spaced}, 'https?://[^ ]+|www\\.[^ ]+', '', 'g')"
    kept = f"regexp_replace({no_urls}, '[^a-z0-9 #+.\\-]', ' ', 'g')"
    return f"trim(regexp_replace({kept}, ' +', ' ', 'g'))"


def term_ctes(docs: str) -> str:
    """Terms of ``docs(doc_id, label, clean)``."""
    return f"""
docs AS (SELECT doc_id, label, {clean_sql('text')} AS clean FROM ({docs})),
stop AS (SELECT unnest([{_quoted(ENGLISH + DOMAIN)}]) AS word),
words AS (
  SELECT doc_id, label, clean,
         list_filter(regexp_extract_all(clean, '[a-z0-9]{{2,}}'),
                     lambda w: NOT list_contains([{_quoted(ENGLISH + DOMAIN)}], w)) AS w
  FROM docs),
grams AS (
  SELECT doc_id, label, unnest(w) AS term FROM words
  UNION ALL
  SELECT doc_id, label, unnest(list_transform(
    range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words),
terms AS (SELECT doc_id, label, term, count(*) AS tf FROM grams GROUP BY ALL),
vocab AS (
  SELECT term, count(*) AS df, sum(tf)::bigint AS total FROM terms GROUP BY term
  HAVING count(*) >= 15 AND count(*) <= 0.6::double * (SELECT count(*) FROM docs)
  ORDER BY total DESC, term LIMIT 4000)
"""


ALL_DOCS = term_ctes("SELECT doc_id, text, false AS label FROM documents")
LABELLED = term_ctes(
    "SELECT d.doc_id, d.text, l.quality = 1 AS label FROM documents d "
    "LEFT JOIN labels l ON d.doc_id = l.doc_id") + """,
raw_weights AS (
  SELECT doc_id, label, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM docs))::double
         / (1 + df)) + 1) AS raw
  FROM terms JOIN vocab USING (term)),
weights AS (
  SELECT doc_id, label, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight
  FROM raw_weights),
means AS (
  SELECT term, count(*) AS doc_frequency,
         coalesce(sum(weight) FILTER (WHERE label), 0)
           / greatest((SELECT count(*) FROM docs WHERE label), 1) AS top_mean,
         coalesce(sum(weight) FILTER (WHERE NOT label), 0)
           / greatest((SELECT count(*) FROM docs WHERE NOT label), 1) AS other_mean
  FROM weights GROUP BY term),
diff AS (
  SELECT term, CASE WHEN contains(term, ' ') THEN 'bigram' ELSE 'unigram' END AS ngram_type,
         doc_frequency, top_mean, other_mean,
         (top_mean + 0.0001::double) / (other_mean + 0.0001::double) AS diff_ratio,
         ln((top_mean + 0.0001::double) / (other_mean + 0.0001::double)) AS log_diff_score,
         top_mean - other_mean AS abs_diff_score,
         ln((top_mean + 0.0001::double) / (other_mean + 0.0001::double)) > 0.2 AS is_marker
  FROM means)
"""

DIFF_COLUMNS = """term, ngram_type, doc_frequency, round(top_mean, 9) AS top_mean,
round(other_mean, 9) AS other_mean, round(diff_ratio, 9) AS diff_ratio,
round(log_diff_score, 9) AS log_diff_score, round(abs_diff_score, 9) AS abs_diff_score,
is_marker"""

# --- geography --------------------------------------------------------------------

REGIONS = ENTITIES + f""",
regions AS (
  SELECT region, count(*) AS entity_count, {TOP}::double / count(*) AS top_rate,
         {TOP} AS top_count, median(metric)::double AS median_metric,
         {money_mean('metric')} AS mean_metric, median(rate) AS median_rate,
         {money_mean('rate')} AS mean_rate, median(item_count)::double AS median_item_count,
         median(event_count)::double AS median_event_count, avg(latitude) AS avg_lat,
         avg(longitude) AS avg_lon
  FROM entities WHERE region <> 'Unknown' GROUP BY region HAVING count(*) >= 15),
localities AS (
  SELECT region, locality, count(*) AS entity_count, {TOP}::double / count(*) AS top_rate,
         median(metric)::double AS median_metric, {money_mean('metric')} AS mean_metric,
         median(rate) AS median_rate, avg(latitude) AS latitude, avg(longitude) AS longitude
  FROM entities WHERE region <> 'Unknown' AND locality <> 'Unknown'
  GROUP BY region, locality HAVING count(*) >= 5),
region_items AS (
  SELECT region, item_name, count(*) AS item_entities
  FROM entities JOIN links USING (entity_id) SEMI JOIN regions USING (region)
  GROUP BY region, item_name),
region_tops AS (
  SELECT region, string_agg(item_name || ' (' || item_entities || ')', ', ' ORDER BY k)
           AS top_items
  FROM (SELECT *, row_number() OVER (
          PARTITION BY region ORDER BY item_entities DESC, item_name) AS k FROM region_items)
  WHERE k <= 5 GROUP BY region)
"""

EVENTS = """
sized AS (
  SELECT event_id, user_id, event_type, value, (props::json ->> '$.k')::bigint AS k FROM events)
"""

NUMBER_TEXT = """CASE WHEN c_acctbal < 0 THEN 'inf' WHEN c_acctbal < 500 THEN 'bad'
WHEN c_acctbal < 1000 THEN 'nan' WHEN c_acctbal < 1500 THEN '1000'
WHEN c_acctbal < 2000 THEN 'bad' ELSE 'own' END"""

NUMBER = f"""CASE {NUMBER_TEXT} WHEN '1000' THEN 1000.0::double
WHEN 'own' THEN c_acctbal END"""

BAL_NAME = "CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name END"


def distribution(c: str, table: str, extra: str = "") -> str:
    return f"""
SELECT count({c}) AS count_present, count(*) - count({c}) AS count_missing,
       count(*) FILTER (WHERE {c} = 0) AS count_zero,
       100.0::double * count(*) FILTER (WHERE {c} IS NULL OR {c} = 0) / greatest(count(*), 1)
         AS pct_zero_or_missing,
       min({c}) AS min_value, max({c}) AS max_value, round(sum({c}) / count({c}), 4) AS mean_value,
       round(median({c}), 4) AS median_value, round(quantile_cont({c}, 0.25), 4) AS p25,
       round(quantile_cont({c}, 0.75), 4) AS p75, round(quantile_cont({c}, 0.9), 4) AS p90
       {extra}
FROM {table}"""


def histogram(column: str, source: str, bins: int, split: str = "") -> str:
    return f""",
bounds AS (SELECT min({column})::double AS lo,
                  (max({column})::double - min({column})::double) / {bins} AS width
           FROM {source})
SELECT CASE WHEN width > 0 THEN least(floor(({column} - lo) / width), {bins} - 1) ELSE 0 END::int
         AS bin, {split} count(*) AS row_count,
       round(lo + CASE WHEN width > 0 THEN least(floor(({column} - lo) / width), {bins} - 1)
         ELSE 0 END * width, 6) AS bin_start
FROM {source}, bounds GROUP BY ALL"""


ORACLE: dict[str, str] = ordered_queries.ORACLE | stream_queries.ORACLE | {
    "item_statistics": f"""WITH {STATS}
SELECT * REPLACE (round(median_log_metric, 6) AS median_log_metric) FROM stats""",
    "overview_metrics": f"WITH {OVERVIEW} SELECT * FROM overview",
    "headline_metrics": f"""WITH {OVERVIEW}
SELECT total_entities, total_top, top_rate, median_metric, mean_metric, median_rate,
       median_items_per_entity, total_distinct_items FROM overview""",
    "json_artifact": f"""WITH {OVERVIEW}
SELECT total_entities, total_top, median_metric, total_distinct_items FROM overview""",
    "metric_distribution": f"""WITH {ENTITIES}
SELECT metric, round(log_metric, 6) AS log_metric, rate, item_count, event_count, is_top, region
FROM entities""",
    "quantile_label": f"""WITH {ENTITIES}
SELECT entity_id, metric, round(log_metric, 6) AS log_metric, is_top FROM entities""",
    "item_counts": f"""WITH {LINKS}
SELECT item_name, count(*) AS n FROM links GROUP BY item_name HAVING count(*) >= 15""",
    "profile_counts": f"""WITH {WORDS}
SELECT count(*) AS total_records,
       count(*) FILTER (WHERE lat IS NOT NULL AND lon IS NOT NULL) AS with_coordinates,
       (SELECT count(*) FROM mentions WHERE explicit) AS explicit_mentions,
       count(DISTINCT entity_id) AS unique_entities,
       count(entity_id) - count(DISTINCT entity_id) AS duplicate_entities,
       count(DISTINCT locality) AS distinct_localities,
       (SELECT count(DISTINCT item_id) FROM spelled) AS distinct_item_ids
FROM records""",
    "profile_completeness": f"""WITH {RECORDS},
present AS (
  SELECT unnest([
    {{'field': 'user_id', 'n': count(*)}}, {{'field': 'username', 'n': count(*)}},
    {{'field': 'country', 'n': count(nullif(lang, ''))}},
    {{'field': 'city', 'n': count(nullif(source, ''))}},
    {{'field': 'hourlyrate', 'n': count(n_chars)}},
    {{'field': 'total_earnings', 'n': count(n_chars)}},
    {{'field': 'no_reviews', 'n': count(text)}}, {{'field': 'location', 'n': count(*)}},
    {{'field': 'skills', 'n': count(text)}}, {{'field': 'portfolios', 'n': count(text)}},
    {{'field': 'user_profile', 'n': count(nullif(text, ''))}},
    {{'field': 'tagline', 'n': count(*) FILTER (WHERE lang <> 'de')}}]) AS x, count(*) AS total
  FROM documents)
SELECT x.field AS field, x.n AS present, 100.0::double * x.n / total AS percentage
FROM present WHERE x.n > 0""",
    "profile_columns": """
WITH c AS (SELECT count(*) AS total, count(doc_id) AS a, count(nullif(text, '')) AS b,
                  count(nullif(lang, '')) AS c, count(nullif(source, '')) AS d,
                  count(n_chars) AS e FROM documents)
SELECT field, present, 100.0::double * present / total AS percentage FROM (
  SELECT 'doc_id' AS field, a AS present, total FROM c UNION ALL
  SELECT 'text', b, total FROM c UNION ALL SELECT 'lang', c, total FROM c UNION ALL
  SELECT 'source', d, total FROM c UNION ALL SELECT 'n_chars', e, total FROM c)""",
    "profile_numeric": distribution("value", "events", """,
       round(stddev_pop(value), 4) AS std_value, round(quantile_cont(value, 0.95), 4) AS p95,
       round(quantile_cont(value, 0.99), 4) AS p99,
       round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 4) AS iqr"""),
    "profile_rates": f"WITH {RECORDS} " + distribution("rate", "records"),
    "profile_text": f"""WITH {RECORDS},
lens AS (SELECT nullif(length({strip('text')}), 0) AS n, tagline, lines FROM records)
SELECT count(n) AS with_text, 100.0::double * count(n) / greatest(count(*), 1) AS pct_with_text,
       count(*) FILTER (WHERE tagline <> '') AS with_tagline,
       count(*) FILTER (WHERE len(lines) > 0) AS with_children,
       sum(len(lines))::bigint AS total_children, sum(n)::double / count(n) AS mean_length,
       max(n) AS max_length, median(n)::double AS median_length FROM lens""",
    "profile_items": f"""WITH {WORDS}
SELECT item_name, count(*) FILTER (WHERE explicit) AS explicit_count, count(*) AS mention_count,
       100.0::double * count(*) FILTER (WHERE explicit) / (SELECT count(*) FROM records)
         AS prevalence_pct
FROM mentions GROUP BY item_name HAVING count(*) FILTER (WHERE explicit) > 0""",
    "profile_groups": """
SELECT lang AS region, count(*) AS row_count,
       100.0::double * count(*) / (SELECT count(*) FROM documents) AS percentage
FROM documents WHERE trim(lang) <> '' GROUP BY lang""",
    "clean_scalars": f"""
SELECT c_custkey, {BAL_NAME} AS name, coalesce({BAL_NAME}, 'Unknown') AS name_or_default,
       {NUMBER} AS number, c_acctbal < 0 AS is_infinite, coalesce({NUMBER}, 0.0) AS number_or_zero,
       trunc(coalesce({NUMBER}, 0.0))::bigint AS whole, true AS truthy,
       CASE WHEN c_acctbal > 0 THEN 1.0::double / c_acctbal ELSE 0.0 END AS ratio,
       round(ln(1 + abs(c_acctbal)), 6) AS log_balance
FROM customer""",
    "nested_number": """
SELECT event_id, (props::json ->> '$.k')::bigint AS k, NULL::bigint AS missing,
       (props::json ->> '$.k')::bigint <> 0 AS k_is_true FROM events""",
    "dynamic_key_fold": """
SELECT event_id, (props::json ->> '$.k')::bigint AS job_id, value AS stars,
       user_id AS score, 'name' AS kept_keys FROM events""",
    "keep_best_dedup": f"""WITH {EVENTS}
SELECT * FROM sized QUALIFY row_number() OVER (
  PARTITION BY user_id ORDER BY value DESC, k DESC, event_id) = 1""",
    "dedup_conflicts": f"""WITH {EVENTS},
seen AS (
  SELECT user_id, event_id, k AS new_items,
         max({{'m': value, 's': k}}) OVER (PARTITION BY user_id ORDER BY event_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kept
  FROM sized)
SELECT user_id, event_id, kept.s AS existing_items, new_items FROM seen WHERE kept IS NOT NULL""",
    "record_dedup": f"""WITH {RECORDS}
SELECT entity_id, file, pos, len(words) AS n_items, metric FROM records
QUALIFY row_number() OVER (
  PARTITION BY entity_id ORDER BY metric DESC, len(words) DESC, doc_id) = 1""",
    "record_conflict_sample": f"""WITH {RECORDS},
seen AS (
  SELECT entity_id, file, pos, doc_id, len(words) AS new_items,
         max({{'m': metric, 's': len(words)}}) OVER (PARTITION BY entity_id ORDER BY doc_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kept
  FROM records)
SELECT entity_id, file, pos, kept.s AS existing_items, new_items FROM seen
WHERE kept IS NOT NULL ORDER BY doc_id LIMIT 100""",
    "first_wins_items": f"WITH {WORDS} SELECT * FROM doc_links",
    "nested_children": f"WITH {WORDS} SELECT * FROM children",
    "assembled_text": f"WITH {WORDS} SELECT * FROM texts",
    "entity_records": f"WITH {WORDS} SELECT * FROM doc_entities",
    "ingestion_report": f"""WITH {WORDS}
SELECT count(*) AS entities, {TOP} AS top_entities,
       100.0::double * {TOP} / count(*) AS top_pct,
       (SELECT quantile_cont(metric, 0.9) FROM records) AS top_threshold,
       (SELECT count(*) FROM doc_links) AS links,
       (SELECT count(DISTINCT item_name) FROM doc_links) AS distinct_items,
       (SELECT count(*) FROM children) AS child_rows,
       (SELECT count(*) FROM texts WHERE length(combined_text) > 0) AS entities_with_text
FROM doc_entities""",
    "pair_support": f"""WITH {MINING}
SELECT n, a, x.item_name AS item_i, y.item_name AS item_j
FROM (SELECT i, j, n AS n, a FROM pairs) p
JOIN (SELECT r, item_name FROM items) x ON x.r = p.i
JOIN (SELECT r, item_name FROM items) y ON y.r = p.j""",
    "triple_support": f"""WITH {MINING}
SELECT n, a, x.item_name AS item_i, y.item_name AS item_j, z.item_name AS item_k
FROM triples p JOIN (SELECT r, item_name FROM items) x ON x.r = p.i
JOIN (SELECT r, item_name FROM items) y ON y.r = p.j
JOIN (SELECT r, item_name FROM items) z ON z.r = p.k""",
    "bundle_table": f"""WITH {BUNDLES}
SELECT bundle_name, bundle_items, bundle_size, entity_count, support, expected_prevalence, lift,
       top_count, top_rate, top_lift, odds_ratio, round(ci_lower, 6) AS ci_lower,
       round(ci_upper, 6) AS ci_upper, chi2 FROM bundles""",
    "bundle_fdr": f"""WITH {ALL_BUNDLES}
SELECT bundle_name, round(p_value, 9) AS p_value, round(adjusted_p_value, 9) AS adjusted_p_value,
       adjusted_p_value < 0.05 AS is_significant FROM fdr""",
    "bundle_evidence": f"""WITH {BUNDLES}
SELECT bundle_name, round(chi2, 6) AS chi2, round(CASE WHEN z = 0 THEN 0
         WHEN z < 2 * pi() THEN -log10(least(1.0::double, {erfc_sql('z')}))
         ELSE (z * z - ln({scaled_tail_sql('z')})) / ln(10) END, 6) AS neg_log10_p
FROM (SELECT *, sqrt(chi2 / 2) AS z FROM bundles)""",
    "graph_checks": f"""WITH {EDGES}
SELECT count(*) AS placed, count(*) AS different, 0::bigint AS gaining_moves FROM nodes""",
    "region_cube": f"""WITH {ENTITIES}
SELECT CASE grouping(region, locality) WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END::int
         AS level, region, locality, count(*) AS entity_count,
       count(DISTINCT metric) AS n_distinct, round(quantile_cont(metric, 0.5), 6) AS median_metric,
       round(quantile_cont(metric, 0.9), 6) AS p90_metric
FROM entities GROUP BY CUBE (region, locality)""",
    "region_bundles": f"WITH {REGIONAL} SELECT {REGIONAL_COLUMNS} FROM regional_fdr",
    "region_leading_bundles": f"""WITH {REGIONAL}
SELECT {REGIONAL_COLUMNS}, rank FROM (
  SELECT * EXCLUDE (rank), row_number() OVER (
    PARTITION BY region ORDER BY adjusted_p_value < 0.05 DESC, top_lift DESC,
    entity_count DESC, bundle_name)::int AS rank
  FROM regional_fdr WHERE top_lift > 1) WHERE rank <= 5""",
    "bundle_ols_single": f"""WITH {BUNDLES},
chosen AS (SELECT bundle_name, members FROM bundles ORDER BY {BY_LIFT} LIMIT 30),
wanted AS (SELECT bundle_name, len(members) AS size, unnest(members) AS item_name FROM chosen),
holders AS (
  SELECT bundle_name, entity_id FROM links JOIN wanted USING (item_name)
  GROUP BY bundle_name, entity_id, size HAVING count(*) = size),
design AS (
  SELECT c.bundle_name, e.log_metric, (h.entity_id IS NOT NULL)::int AS x
  FROM chosen c CROSS JOIN entities e
  LEFT JOIN holders h ON h.bundle_name = c.bundle_name AND h.entity_id = e.entity_id)
SELECT bundle_name, sum(x)::bigint AS entity_count, round(regr_slope(log_metric, x), 6) AS slope,
       round(regr_intercept(log_metric, x), 6) AS intercept, round(regr_r2(log_metric, x), 6) AS r2
FROM design GROUP BY bundle_name""",
    "bundle_members": f"""WITH {BUNDLES}
SELECT DISTINCT unnest(members) AS item_name
FROM (SELECT members FROM bundles ORDER BY {BY_LIFT} LIMIT 1000)""",
    "bundle_explorer": f"""WITH {BUNDLES}
SELECT bundle_name, entity_count, top_rate, top_lift, odds_ratio FROM bundles
WHERE entity_count >= 25 AND bundle_size = 3 AND contains(lower(bundle_name), 'widget')
ORDER BY {BY_LIFT} LIMIT 250""",
    "cooccurrence_edges": f"WITH {EDGES} SELECT source, target, weight FROM edges",
    "entity_graph_edges": f"""WITH {STATS},
top_items AS (SELECT item_name FROM stats ORDER BY entity_count DESC, item_name LIMIT 150),
kept AS (SELECT entity_id, item_name FROM links SEMI JOIN top_items USING (item_name))
SELECT a.item_name AS source, b.item_name AS target, count(*) AS weight
FROM kept a JOIN kept b ON a.entity_id = b.entity_id AND a.item_name < b.item_name
GROUP BY 1, 2 HAVING count(*) >= 25""",
    "graph_nodes": f"WITH {EDGES} SELECT node FROM nodes",
    "graph_degree": f"WITH {EDGES} SELECT * FROM degrees",
    "graph_modularity": f"""WITH {EDGES},
sides AS (
  SELECT length(u) AS cu, sum(CASE WHEN length(u) = length(v) THEN w ELSE 0 END)::double AS inside,
         sum(w)::double AS total FROM arcs GROUP BY 1)
SELECT round(sum(inside / m - (total / m) * (total / m)), 9) AS modularity,
       count(*) AS communities
FROM sides, (SELECT sum(w)::double AS m FROM arcs)""",
    "graph_betweenness": PATHS.join(["WITH RECURSIVE ", """
SELECT node, round(betweenness, 9) AS betweenness FROM betweenness"""]),
    "graph_closeness": HOPS.join(["WITH RECURSIVE ", """,
best AS (SELECT s, v, min(d) AS d FROM hop GROUP BY 1, 2)
SELECT s AS node, CASE WHEN sum(d) > 0 THEN ((count(*) - 1)::double / sum(d))
         * ((count(*) - 1)::double / ((SELECT count(*) FROM nodes) - 1)) ELSE 0 END AS closeness
FROM best GROUP BY s"""]),
    "bridge_scores": PATHS.join(["WITH RECURSIVE ", """
SELECT node, round(betweenness / (degree_centrality + 0.00001::double), 7) AS bridge_score
FROM betweenness JOIN degrees USING (node)"""]),
    "name_length_summary": f"""WITH {STATS},
ranked AS (
  SELECT length(item_name) AS community, *, row_number() OVER (
    PARTITION BY length(item_name) ORDER BY entity_count DESC, item_name) AS k FROM stats)
SELECT community, count(*) AS num_items, sum(entity_count)::bigint AS total_entities,
       round(avg(top_rate), 9) AS avg_top_rate, median(median_metric) AS median_metric,
       string_agg(item_name, ', ' ORDER BY k) FILTER (WHERE k <= 5) AS top_items
FROM ranked GROUP BY community""",
    "subgraph": f"""WITH {EDGES}
SELECT source, target, weight FROM edges
WHERE weight >= (SELECT median(weight) FROM edges) AND length(source) <= 9
  AND length(target) <= 9""",
    "clean_text_tokens": f"""WITH {ALL_DOCS}
SELECT doc_id, clean, coalesce(array_to_string(w, ' '), '') AS tokens,
       (len(w) + greatest(len(w) - 1, 0))::int AS n_terms FROM words""",
    "vocabulary": f"WITH {ALL_DOCS} SELECT term, df, total FROM vocab",
    "tfidf_weights": f"""WITH {LABELLED}
SELECT doc_id, term, round(weight, 9) AS weight FROM weights""",
    "differential_terms": f"WITH {LABELLED} SELECT {DIFF_COLUMNS} FROM diff",
    "lda_checks": """
SELECT count(*) AS documents, count(*) AS in_topics,
       (SELECT count(*) FROM documents SEMI JOIN (
          SELECT doc_id FROM labels WHERE quality = 1) l USING (doc_id)) AS labelled_top
FROM documents""",
    "top_terms": f"""WITH {LABELLED} SELECT {DIFF_COLUMNS} FROM (
  SELECT * FROM diff WHERE is_marker ORDER BY log_diff_score DESC, term LIMIT 10)""",
    "term_extremes": f"""WITH {LABELLED}
SELECT side, term, round(log_diff_score, 7) AS log_diff_score FROM (
  (SELECT 'top' AS side, * FROM diff ORDER BY log_diff_score DESC, term LIMIT 15)
  UNION ALL
  (SELECT 'other' AS side, * FROM diff ORDER BY log_diff_score, term LIMIT 15))""",
    "country_statistics": f"WITH {REGIONS} SELECT * FROM regions",
    "city_statistics": f"WITH {REGIONS} SELECT * FROM localities",
    "country_item_counts": f"WITH {REGIONS} SELECT * FROM region_items",
    "country_top_items": f"WITH {REGIONS} SELECT * FROM region_tops",
    "country_report": f"""WITH {REGIONS}
SELECT r.*, coalesce(t.top_items, '') AS top_items
FROM regions r LEFT JOIN region_tops t USING (region)""",
    "top_countries": f"""WITH {REGIONS}
SELECT region, entity_count, top_rate, median_metric, median_rate,
       coalesce(t.top_items, '') AS top_items
FROM regions r LEFT JOIN region_tops t USING (region)
ORDER BY entity_count DESC, region LIMIT 8""",
    "city_leaders": f"""WITH {REGIONS}
SELECT * FROM localities ORDER BY entity_count DESC, region, locality LIMIT 25""",
    "top_bundles": f"""WITH {BUNDLES}
SELECT bundle_name, bundle_size, entity_count, support, lift, top_rate, top_lift, odds_ratio
FROM fdr WHERE adjusted_p_value < 0.05 AND entity_count >= 20
ORDER BY top_lift DESC, odds_ratio DESC, bundle_name LIMIT 10""",
    "top_items_popular": f"""WITH {STATS}
SELECT item_name, entity_count, prevalence, median_metric, top_rate FROM stats
ORDER BY entity_count DESC, item_name LIMIT 5""",
    "top_items_rate": f"""WITH {STATS}
SELECT item_name, entity_count, prevalence, median_metric, top_rate FROM stats
WHERE entity_count >= 50 ORDER BY top_rate DESC, item_name LIMIT 5""",
    "item_leaders": f"""WITH {STATS}
SELECT item_name, entity_count, top_rate FROM stats
ORDER BY entity_count DESC, item_name LIMIT 15""",
    "item_rate_leaders": f"""WITH {STATS}
SELECT item_name, entity_count, top_rate FROM stats
WHERE entity_count >= 30 ORDER BY top_rate DESC, item_name LIMIT 15""",
    "metric_histogram": f"WITH {ENTITIES}, positive AS (SELECT * FROM entities WHERE metric > 0)"
    + histogram("log_metric", "positive", 50, "is_top,"),
    "item_count_histogram": f"WITH {ENTITIES}" + histogram("item_count", "entities", 40),
    "raw_json_scan": f"""WITH {RECORDS}
SELECT file AS page, pos, entity_id, metric, len(words) AS n_items,
       nullif(length({strip('text')}), 0) AS profile_length, len(lines)::int AS n_children
FROM records""",
    "bad_files": """
SELECT 2 * count(*) AS total_files, count(*) AS malformed_files, count(*) AS quarantined
FROM documents""",
    "shown_names": """
WITH t AS (
  SELECT *, lower(p_name || '''s 3d ' || p_brand) AS a,
         string_split(p_name || ' ' || lower(replace(p_brand, '#', '-')), ' ') AS words FROM part)
SELECT p_partkey, array_to_string(list_transform(range(1, length(a) + 1), lambda i:
         CASE WHEN i = 1 OR NOT regexp_matches(substring(a, i - 1, 1), '[[:alpha:]]')
              THEN upper(substring(a, i, 1)) ELSE substring(a, i, 1) END), '') AS title,
       'Topic ' || p_size || ': ' || array_to_string(list_transform(words, lambda w:
         array_to_string(list_transform(range(1, length(w) + 1), lambda i:
           CASE WHEN i = 1 OR NOT regexp_matches(substring(w, i - 1, 1), '[[:alpha:]]')
                THEN upper(substring(w, i, 1)) ELSE substring(w, i, 1) END), '')), ' / ') AS label,
       p_name || ' (' || (floor(p_retailprice) / 4)::varchar || ')' AS weighted
FROM t""",
    "incremental_merge": f"""WITH {RECORDS}
SELECT entity_id, len(words) AS n_items, metric FROM records
QUALIFY row_number() OVER (
  PARTITION BY entity_id ORDER BY metric DESC, len(words) DESC, doc_id) = 1""",
    "artifact_status": f"""WITH {BUNDLES}, {EDGES.replace('held AS', 'basket AS').replace('FROM held', 'FROM basket')}
SELECT 'entities' AS table_name, count(*) AS row_count FROM entities UNION ALL
SELECT 'links', count(*) FROM links UNION ALL
SELECT 'bundles', count(*) FROM bundles UNION ALL
SELECT 'edges', count(*) FROM edges UNION ALL
SELECT 'regions', count(*) FROM (
  SELECT region FROM entities WHERE region <> 'Unknown' GROUP BY region HAVING count(*) >= 15)""",
}
