"""The SQL twins of the queries, in DuckDB's dialect, written from the rules and not from the Spark expressions."""

from __future__ import annotations

from kindred.sources import demo

# Fixed values, written out here once more so that a slip in the engine's own tables shows.
LONGER = "ß ss æ ae Æ AE œ oe Œ OE þ th Þ Th ĳ ij Ĳ IJ ŉ 'n"
PLAIN = "øoØOđdĐDðdÐDłlŁLħhĦHıiŧtŦTĸkŋnŊN’'‘'“\"”\"–-—-… \xa0 ªaºo"
FORMS = "corp corporation inc incorporated ltd limited pvt private llc llp sarl sas co"
STREET = "rd road st street ave avenue blvd boulevard dr drive ln lane ct court pkwy parkway sq square pl place hwy highway"
PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""

q = lambda s: "'" + s.replace("'", "''") + "'"


def fold(x: str) -> str:
    parts = LONGER.split()
    for a, b in zip(parts[::2], parts[1::2], strict=True):
        x = f"replace({x}, {q(a)}, {q(b)})"
    return f"strip_accents(translate({x}, {q(PLAIN[::2])}, {q(PLAIN[1::2])}))"


def clean(x: str, name: bool) -> str:
    x = f"replace(lower({fold(x)}), '&', ' and ')"
    if name:
        x = rf"regexp_replace({x}, '^[^\w]+', '')"
    return rf"trim(regexp_replace(translate({x}, {q(PUNCTUATION)}, {q(' ' * len(PUNCTUATION))}), '\s+', ' ', 'g'))"


LEGAL = ", ".join(map(q, FORMS.split()))
STREETS = " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in zip(STREET.split()[::2], STREET.split()[1::2], strict=True))
BLANK = r"NOT regexp_matches({0}, '[^\s]')"

NORMAL = rf"""
records AS ({demo.plain(demo.RECORDS)}),
truth AS ({demo.plain(demo.TRUTH)}),
n0 AS (SELECT entity_id, source, business_name, business_address, coalesce(business_name, '') AS raw_name, coalesce(business_address, '') AS raw_address, trim(coalesce(country, '')) AS country FROM records),
n1 AS (SELECT *, {clean("raw_name", True)} AS normalized_name, {clean("raw_address", False)} AS plain_address,
  CASE WHEN regexp_matches(raw_address, '\b\d{{5}}\b') THEN regexp_extract(raw_address, '\b(\d{{5}})(?:-\d{{4}})?\b', 1) ELSE regexp_extract(raw_address, '\b(\d{{6}})\b', 1) END AS postal_code_guess FROM n0),
n2 AS (SELECT *, list_filter(string_split(normalized_name, ' '), lambda t: t <> '') AS name_tokens,
  list_transform(list_filter(string_split(plain_address, ' '), lambda t: t <> ''), lambda t: CASE t {STREETS} ELSE t END) AS address_tokens,
  list_filter(list_transform(string_split(raw_address, ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM n1),
n3 AS (SELECT *, list_filter(name_tokens, lambda t: t NOT IN ({LEGAL})) AS name_tokens_no_suffix, array_to_string(address_tokens, ' ') AS normalized_address,
  coalesce(list_position(list_transform(parts[2:], lambda p: contains(p, postal_code_guess)), true), 0) AS hit FROM n2),
n4 AS (SELECT *, array_to_string(name_tokens_no_suffix, ' ') AS aggressive_normalized_name,
  CASE WHEN normalized_name = '' THEN []::VARCHAR[] ELSE list_transform(range(1, length(normalized_name) + 1), lambda i: substr(' ' || normalized_name || ' ', i, 3)) END AS name_char_ngrams,
  CASE WHEN len(parts) >= 2 THEN trim(translate(lower(CASE WHEN postal_code_guess <> '' AND hit > 0 THEN parts[hit] ELSE parts[len(parts) - 1] END), {q(PUNCTUATION)}, '')) ELSE '' END AS part,
  CASE WHEN postal_code_guess <> '' THEN coalesce(list_position(address_tokens, postal_code_guess), 0) ELSE 0 END AS place,
  regexp_extract(normalized_address, '^(\d+)', 1) AS street_number_guess, {BLANK.format("raw_name")} AS name_missing, {BLANK.format("raw_address")} AS address_missing FROM n3),
n AS (SELECT *, CASE WHEN part <> '' AND NOT regexp_matches(part, '\d') AND NOT regexp_matches(part, '^(unit|suite|apt|apartment|block) ') THEN part
  WHEN place > 1 THEN address_tokens[place - 1]
  ELSE coalesce(list_filter(address_tokens, lambda w: NOT regexp_full_match(w, '\d+') AND length(w) > 2)[-1], '') END AS city_guess FROM n4)
"""

GOLDEN = """
golden AS (SELECT a.entity_id AS s1_id, b.entity_id AS match_id FROM n a JOIN n b
  ON a.aggressive_normalized_name = b.aggressive_normalized_name AND a.country = b.country AND a.source = 'S1' AND b.source <> 'S1'
  AND a.aggressive_normalized_name <> '' AND a.country <> ''
  AND ((a.normalized_address = b.normalized_address AND a.normalized_address <> '') OR (a.postal_code_guess = b.postal_code_guess AND a.postal_code_guess <> '')))
"""


def place_pairs(field: str) -> str:
    return f"""SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS match_id FROM n a JOIN n b ON a.source = 'S1' AND b.source <> 'S1' AND a.country = b.country
  AND a.{field} = b.{field} AND a.{field} <> ''"""


NAME_WORDS = "list_sort(list_distinct(list_filter(name_tokens_no_suffix, lambda t: t <> 'and')))"
TOKEN = f"""bags AS (SELECT source, entity_id, array_to_string({NAME_WORDS}, ' ') AS whole, list_distinct(list_concat(list_transform({NAME_WORDS}, lambda t: 'n:' || t), list_transform(address_tokens, lambda t: 'a:' || t))) AS bag FROM n),
words AS (SELECT source, entity_id, unnest(bag) AS word FROM bags),
rare AS (SELECT word FROM words WHERE source <> 'S1' GROUP BY word HAVING count(*) <= 50),
second AS (SELECT entity_id FROM bags WHERE source <> 'S1' AND entity_id NOT IN (SELECT entity_id FROM words SEMI JOIN rare USING (word) WHERE source <> 'S1')),
couple AS (SELECT x.source, x.entity_id, x.word || ' ' || y.word AS word FROM words x JOIN words y ON x.entity_id = y.entity_id AND x.word < y.word WHERE x.source = 'S1' OR x.entity_id IN (SELECT entity_id FROM second)),
fine AS (SELECT word FROM couple WHERE source <> 'S1' GROUP BY word HAVING count(*) <= 50),
third AS (SELECT entity_id, whole FROM bags WHERE whole <> '' AND entity_id IN (SELECT entity_id FROM second) AND entity_id NOT IN (SELECT entity_id FROM couple SEMI JOIN fine USING (word) WHERE source <> 'S1')),
token AS (SELECT a.entity_id AS s1_id, b.entity_id AS match_id FROM words a JOIN words b USING (word) SEMI JOIN rare USING (word) WHERE a.source = 'S1' AND b.source <> 'S1'
  UNION SELECT a.entity_id, b.entity_id FROM couple a JOIN couple b USING (word) SEMI JOIN fine USING (word) WHERE a.source = 'S1' AND b.source <> 'S1'
  UNION SELECT a.entity_id, b.entity_id FROM bags a JOIN third b USING (whole) WHERE a.source = 'S1')"""
PLACE = f"place AS ({place_pairs('postal_code_guess')})"
CITY = f"""towns AS (SELECT source, entity_id, country || '|' || city_guess AS town, {NAME_WORDS} AS words FROM n WHERE city_guess <> ''),
large AS (SELECT town FROM towns WHERE source <> 'S1' GROUP BY 1 HAVING count(*) > 50),
city AS (SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS match_id FROM towns a JOIN towns b USING (town) WHERE a.source = 'S1' AND b.source <> 'S1' AND (town NOT IN (SELECT town FROM large) OR list_has_any(a.words, b.words) OR len(a.words) = 0 OR len(b.words) = 0))"""
WHOLE = "normalized_name || ' ' || normalized_address"
# the arithmetic of the rows' hashes, written out
LEAST = "list_min(list_transform(h, lambda x: (x * ((2 * {0} * {0} + 7919 * {0} + 104729) % 2147483647) + (15485863 * {0}) % 2147483647) % 2147483647))"
BANDS = " UNION ALL ".join(f"SELECT source, entity_id, '{b}' || {' || '.join(chr(39) + ':' + chr(39) + ' || ' + LEAST.format(b * 6 + r) for r in range(6))} AS band FROM hashes" for b in range(10))
MINHASH = f"""grams AS (SELECT source, entity_id, list_distinct(list_transform(range(1, length({WHOLE}) + 1), lambda i: substr(' ' || {WHOLE} || ' ', i, 3))) AS g FROM n),
hashes AS (SELECT source, entity_id, list_transform(g, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT) AS h FROM grams),
bands AS ({BANDS}), minhash AS (SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS match_id FROM bands a JOIN bands b USING (band) WHERE a.source = 'S1' AND b.source <> 'S1')"""
PAIRS = (TOKEN, PLACE, "pairs AS (SELECT * FROM token UNION SELECT * FROM place)")
SIDES = "FROM pairs p JOIN n a ON a.entity_id = p.s1_id JOIN n b ON b.entity_id = p.match_id"
JACCARD = "CASE WHEN len(list_distinct({0} || {1})) = 0 THEN 0 ELSE len(list_intersect(list_distinct({0}), list_distinct({1}))) / len(list_distinct({0} || {1})) END"
OVERLAP = "CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0 ELSE len(list_intersect(list_distinct({0}), list_distinct({1}))) / least(len(list_distinct({0})), len(list_distinct({1}))) END"
EDIT = "CASE WHEN greatest(length({0}), length({1})) = 0 THEN 1 ELSE 1 - levenshtein({0}, {1}) / greatest(length({0}), length({1})) END"
SCORED = f"""scored AS (SELECT s1_id, match_id, round(0.5 * ({JACCARD.format("a.name_char_ngrams", "b.name_char_ngrams")}) + 0.3 * ({EDIT.format("a.normalized_name", "b.normalized_name")}) + 0.2 * ({OVERLAP.format("a.address_tokens", "b.address_tokens")}), 6) AS score {SIDES})"""
TRUTH_LISTS = "lists AS (SELECT e.s1_id AS source1_entity_id, coalesce(string_agg(t.match_id, ',' ORDER BY t.match_id), '') AS matched_entity_ids FROM (SELECT DISTINCT entity_id AS s1_id FROM records WHERE source = 'S1') e LEFT JOIN truth t USING (s1_id) GROUP BY 1)"
SCORES = """sizes AS (SELECT coalesce(t.s1_id, p.s1_id) AS s1_id, count(t.match_id) AS truths, count(p.match_id) AS guesses, count(*) FILTER (t.match_id IS NOT NULL AND p.match_id IS NOT NULL) AS hits
  FROM truth t FULL JOIN golden p ON t.s1_id = p.s1_id AND t.match_id = p.match_id GROUP BY 1),
every AS (SELECT entity_id AS s1_id, coalesce(truths, 0) AS truths, coalesce(guesses, 0) AS guesses, coalesce(hits, 0) AS hits FROM (SELECT entity_id FROM records WHERE source = 'S1') e LEFT JOIN sizes ON s1_id = entity_id)"""
F_BETA = "CASE WHEN truths = 0 AND guesses = 0 THEN 1.0 WHEN hits = 0 THEN 0.0 ELSE 1.25 * hits / (0.25 * truths + guesses) END"

RESULTS = """
SELECT o_orderkey + 2 AS line, o_orderkey % 29 <> 3 AS tab, 'S1-C' || CAST(o_custkey AS STRING) AS s1_id,
  CASE WHEN o_orderkey % 29 = 3 THEN NULL WHEN o_orderkey % 17 = 4 THEN '' ELSE 'S' || CAST(2 + o_orderkey % 2 AS STRING) || '-' || CAST(o_orderkey AS STRING)
    || CASE o_orderkey % 13 WHEN 0 THEN ',' WHEN 1 THEN ',S2-1,S2-1' WHEN 2 THEN ',S1-C1' WHEN 3 THEN ',X9-1' WHEN 4 THEN ',S3-999999999' ELSE '' END END AS ids
FROM {orders}
"""
ROWS = f"rows AS ({demo.plain(RESULTS)})"
LISTED = r"listed AS (SELECT s1_id, unnest(string_split(ids, ',')) AS id FROM rows WHERE tab AND regexp_matches(ids, '[^\s]'))"
LAST = r"last AS (SELECT DISTINCT s1_id, unnest(string_split(ids, ',')) AS id FROM (SELECT s1_id, max_by(coalesce(ids, ''), line) AS ids FROM rows WHERE tab GROUP BY 1) WHERE regexp_matches(ids, '[^\s]'))"


def finding(rule: str, severity: str, offenders: str, *before: str) -> str:
    return f"""WITH {', '.join([*before, f'off AS (SELECT DISTINCT x::VARCHAR AS x FROM ({offenders}))'])}
SELECT '{rule}' AS rule, '{severity}' AS severity, count(*) AS n, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT x FROM off ORDER BY x LIMIT 5)) AS examples FROM off HAVING count(*) > 0"""


def over(select: str, *more: str) -> str:
    """A statement with the normalized records in reach."""
    return "WITH " + ",\n".join([NORMAL, *more]) + "\n" + select


def field(name: str, value: str | None = None, array: bool = False) -> str:
    value = value or name
    return over(f"SELECT entity_id, {f'array_to_string({value}, chr(124))' if array else value} AS {name} FROM n")
