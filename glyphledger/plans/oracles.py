"""DuckDB SQL that the queries of registry.py must agree with; written from the semantics, not from the Spark plans."""

from __future__ import annotations

from glyphledger.functions.text import ALPHABET
from glyphledger.plans.adapters import adapter_sql

SQL: dict[str, str] = {}

MONEY, IDS, DATES, NAMES, REGISTER, TRIPLES, EMPLOYER, OBS, READS, ANSWERS, RECORDS = (adapter_sql(n) for n in ("money_text", "id_text", "dates_text", "noisy_name", "register", "triples", "employer", "obs", "reads", "answers", "records"))


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def _decimal(x: str) -> str:
    s = f"replace(translate({x}, '，,：:', '....'), ' ', '')"
    d = _digits(s)
    return f"coalesce(list_extract(regexp_extract_all({s}, '[0-9]+\\.[0-9]{{2}}'), -1), CASE WHEN length({d}) >= 3 THEN substr({d}, 1, length({d}) - 2) || '.' || right({d}, 2) ELSE {d} END)"


def _id(x: str) -> str:
    k = f"regexp_replace({x}, '[^0-9/]', '', 'g')"
    return f"CASE WHEN instr({k}, '/') = 0 AND length({k}) = 10 THEN substr({k}, 1, 6) || '/' || substr({k}, 7) ELSE {k} END"


def _fold(x: str) -> str:
    return f"strip_accents(lower({x}))"


def _key(x: str) -> str:
    return f"regexp_replace({_fold(x)}, '[^a-z0-9]', '', 'g')"


ID_FORM = "'[0-9]{6}/[0-9]{4}'"
SQL["normalize_decimal"] = f"SELECT l_orderkey, l_linenumber, raw, {_decimal('raw')} AS value FROM {MONEY} AS t"
SQL["digits_only"] = f"SELECT l_orderkey, l_linenumber, {_digits('raw')} AS digits FROM {MONEY} AS t"
SQL["normalize_id"] = f"SELECT k, raw, {_id('raw')} AS value FROM {IDS} AS t"
SQL["reform_value"] = f"SELECT k, substr(ten, 1, 6) || '/' || substr(ten, 7) AS id_value, nine AS short_value, substr(nine, 1, 7) || '.' || substr(nine, 8) AS amount, nine AS other FROM {IDS} AS t"
SQL["birth_from_id"] = f"SELECT k, substr(ten, 5, 2) || lpad(CAST(CAST(substr(ten, 3, 2) AS INT) % 50 AS VARCHAR), 2, '0') || CASE WHEN CAST(substr(ten, 1, 2) AS INT) >= 30 THEN '19' ELSE '20' END || substr(ten, 1, 2) AS born FROM {IDS} AS t"
SQL["id_check_digit"] = f"SELECT k, nine, ((-(CAST(nine AS BIGINT) * 10) % 11) + 11) % 11 AS digit FROM {IDS} AS t"
SQL["corrupt_check_digit"] = f"SELECT k, substr(ten, 1, 9) || CAST((CAST(right(ten, 1) AS INT) + 1 + k % 9) % 10 AS VARCHAR) AS broken FROM {IDS} AS t"
SQL["fold_diacritics"] = f"SELECT p_partkey, strip_accents(lower(noisy)) AS folded FROM {NAMES} AS t"
SQL["norm_key"] = f"SELECT p_partkey, regexp_replace(strip_accents(lower(noisy)), '[^a-z0-9]', '', 'g') AS lower_key, regexp_replace(strip_accents(upper(noisy)), '[^A-Z0-9]', '', 'g') AS upper_key FROM {NAMES} AS t"
SQL["edit_distance"] = f"SELECT p_partkey, CAST(levenshtein({_key('noisy')}, {_key('p_name')}) AS INT) AS d FROM {NAMES} AS t"
SQL["edit_le1"] = f"SELECT p_partkey, levenshtein({_key('noisy')}, {_key('p_name')}) <= 1 AS near FROM {NAMES} AS t"
_NEAR = "contains(h, w) OR len(list_filter(range(1, length(h) + 1), lambda i: (i + length(w) - 1 <= length(h) AND levenshtein(w, substr(h, i, length(w))) <= 1) OR (i + length(w) - 2 <= length(h) AND levenshtein(w, substr(h, i, length(w) - 1)) <= 1) OR (i + length(w) <= length(h) AND levenshtein(w, substr(h, i, length(w) + 1)) <= 1))) > 0"
SQL["fuzzy_contains"] = f"SELECT p_partkey, {_NEAR} AS inside FROM (SELECT p_partkey, substr(p_name, 2, 5) AS w, {_key('noisy')} AS h FROM {NAMES} AS t) AS u"
SQL["fuzzy_text_match"] = f"""
WITH words AS (SELECT p_partkey, unnest(string_split({_fold('p_name')}, ' ')) AS w, {_fold('noisy')} AS r, replace({_fold('noisy')}, ' ', '') AS h FROM {NAMES} AS t),
judged AS (SELECT p_partkey, length(w) < 2 OR contains(r, w) OR contains(h, w) OR contains(h, substr(w, 2)) OR contains(h, substr(w, 1, length(w) - 1)) OR (length(w) >= 4 AND ({_NEAR})) AS ok FROM words)
SELECT p_partkey, bool_and(ok) AS agrees FROM judged GROUP BY p_partkey"""
SQL["rule_page_match"] = f"SELECT form_id, person_id_p2 <> '' AND person_id_p2 <> person_id AS differs FROM {RECORDS} AS t"
SQL["name_score"] = f"SELECT doc_id, w, least(score, 0.5) AS score, trim(text || ' ' || lang, ' ') AS joined FROM {READS} AS t"
SQL["alphabet_filter"] = f"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^{ALPHABET}]', ' ', 'g'), ' +', ' ', 'g'), ' ') AS kept FROM documents"
_CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"
SQL["truncate_money"] = f"SELECT l_orderkey, l_linenumber, CAST(CAST({_CENTS} * 134 // 1000 AS DECIMAL(18,0)) * CAST('0.01' AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS share FROM lineitem"
_MONEY_OUT = "CAST(CAST({0} AS DECIMAL(18,2)) / 100 AS DECIMAL(18,2))"
SQL["derived_rows"] = f"""
WITH a AS (SELECT l_orderkey, l_linenumber, {_CENTS} + CAST(round(l_quantity * 100) AS BIGINT) AS r1 FROM lineitem), b AS (SELECT *, r1 * 134 // 1000 AS r2 FROM a), d AS (SELECT *, r1 - r2 AS r3, (r1 - r2) * 19 // 100 AS r4 FROM b)
SELECT l_orderkey, l_linenumber, {", ".join(f"CAST({x} // 100 AS VARCHAR) || '.' || lpad(CAST({x} % 100 AS VARCHAR), 2, '0') AS {n}" for x, n in (("r1", "row_01"), ("r2", "row_02a"), ("r3", "row_03"), ("r4", "row_04")))} FROM d"""
SQL["round_half_even"] = "SELECT doc_id, round_even(n_chars / 16.0, 3) AS rounded FROM documents"
_PX = "list_transform(embedding, lambda x: CAST(floor(least(greatest(CAST(x AS DOUBLE) + 0.5, 0.0), 1.0) * 255) AS INT))"
_PIXELS = f"(SELECT vec_id, {_PX} AS px FROM embeddings)"
SQL["occupancy"] = f"SELECT vec_id, d AS dark_frac, d > 0.1 AS occupied, least(1.0, abs(d - 0.1) / 0.1) AS confidence FROM (SELECT vec_id, CAST(len(list_filter(px, lambda x: x < 128)) AS DOUBLE) / len(px) AS d FROM {_PIXELS} AS t) AS u"
SQL["ink_gate"] = f"SELECT vec_id, d AS ink, d > 0.02 AS inked FROM (SELECT vec_id, CAST(len(list_filter(px, lambda x: x < 200)) AS DOUBLE) / len(px) AS d FROM {_PIXELS} AS t) AS u"
SQL["ink_fraction_long"] = f"SELECT vec_id, CAST(sum(CASE WHEN p < 200 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS ink FROM (SELECT vec_id, unnest(px) AS p FROM {_PIXELS} AS t) AS u GROUP BY vec_id"
SQL["darken_blend"] = f"""
WITH p AS (SELECT vec_id, px, len(px) AS n FROM {_PIXELS} AS t), e AS (SELECT vec_id, i, least(px[i], px[n + 1 - i]) AS v FROM (SELECT vec_id, px, n, unnest(range(1, n + 1)) AS i FROM p) AS u)
SELECT vec_id, CAST(sum(v) AS BIGINT) AS total, string_agg(CASE WHEN i <= 8 THEN CAST(v AS VARCHAR) END, ',' ORDER BY i) AS head FROM e GROUP BY vec_id"""
SQL["crop_slice"] = f"SELECT vec_id, string_agg(CAST(px[i + 1] AS VARCHAR), ',' ORDER BY i) AS part FROM (SELECT vec_id, px, unnest(range(0, 64)) AS i FROM {_PIXELS} AS t) AS u WHERE i // 8 BETWEEN 1 AND 3 AND i % 8 BETWEEN 2 AND 4 GROUP BY vec_id"
_CELLS = f"""
(SELECT k, i, n, CASE WHEN (k + i) % 53 = 0 THEN '?' ELSE substr(ten, i + 1, 1) END AS ch, CASE WHEN s < 0.1 THEN s ELSE greatest(s, 0.9) END AS score, CASE WHEN (k + i) % 53 = 0 THEN '' ELSE substr(ten, i + 1, 1) END AS digit, CAST((k + i) % 21 AS DOUBLE) / 100 > 0.02 AS inked
 FROM (SELECT k, ten, i, 10 AS n, CAST((k * 31 + i * 17) % 40 AS DOUBLE) / 40 AS s FROM (SELECT k, ten, CAST(unnest(range(0, 10)) AS INT) AS i FROM {IDS} AS t) AS u) AS v)"""
SQL["field_confidence"] = f"SELECT k, min(score) AS confidence FROM {_CELLS} AS t GROUP BY k"
SQL["low_conf_cells"] = f"SELECT k, coalesce(string_agg(CASE WHEN score < 0.85 THEN CAST(i AS VARCHAR) END, ',' ORDER BY i), '') AS low FROM {_CELLS} AS t GROUP BY k"
_READ = "CASE WHEN digit = '' THEN '{0}' ELSE digit END"
SQL["assemble_amount"] = f"SELECT k, coalesce(string_agg(CASE WHEN i < 8 AND inked THEN {_READ.format('?')} END, '' ORDER BY i), '0') || '.' || string_agg(CASE WHEN i >= 8 THEN {_READ.format('0')} END, '' ORDER BY i) AS value FROM {_CELLS} AS t GROUP BY k"
SQL["assemble_comb"] = f"SELECT k, coalesce(string_agg(CASE WHEN inked THEN {_READ.format('?')} END, '' ORDER BY i), '') AS value FROM {_CELLS} AS t GROUP BY k"
SQL["assemble_id"] = f"SELECT k, CASE WHEN value = '' THEN '' ELSE substr(value, 1, 6) || '/' || substr(value, 7) END AS value FROM ({SQL['assemble_comb']}) AS t"
SQL["repair_id"] = f"""
WITH f AS (SELECT k, string_agg(ch, '' ORDER BY i) AS cur, count(*) FILTER (score < 0.85) AS low, sum(CASE WHEN score < 0.85 THEN 0 ELSE try_cast(ch AS BIGINT) * CAST(10 ** (9 - i) AS BIGINT) END) AS fixed, count(*) FILTER (score >= 0.85 AND ch = '?') AS bad, list(CAST(10 ** (9 - i) AS BIGINT) ORDER BY i) FILTER (score < 0.85) AS worth FROM {_CELLS} AS t GROUP BY k),
g AS (SELECT *, low BETWEEN 1 AND 3 AND bad = 0 AND NOT coalesce(try_cast(cur AS BIGINT) % 11 = 0, false) AS ready FROM f),
v AS (SELECT k, unnest(range(0, 1000)) AS v FROM g WHERE ready),
h AS (SELECT g.k, min(fixed + worth[1] * CASE low WHEN 1 THEN v WHEN 2 THEN v // 10 ELSE v // 100 END + CASE WHEN low = 2 THEN worth[2] * (v % 10) WHEN low = 3 THEN worth[2] * (v // 10 % 10) + worth[3] * (v % 10) ELSE 0 END) FILTER ((fixed + worth[1] * CASE low WHEN 1 THEN v WHEN 2 THEN v // 10 ELSE v // 100 END + CASE WHEN low = 2 THEN worth[2] * (v % 10) WHEN low = 3 THEN worth[2] * (v // 10 % 10) + worth[3] * (v % 10) ELSE 0 END) % 11 = 0) AS found
      FROM g JOIN v ON g.k = v.k AND v < CASE low WHEN 1 THEN 10 WHEN 2 THEN 100 ELSE 1000 END GROUP BY g.k)
SELECT g.k, CASE WHEN lpad(CAST(found AS VARCHAR), 10, '0') <> cur THEN lpad(CAST(found AS VARCHAR), 10, '0') END AS repaired FROM g LEFT JOIN h ON g.k = h.k"""
SQL["geometry_grid"] = """
SELECT n_nationkey, CAST(i AS INT) AS i, CAST(n_nationkey * 10 + i * 27 AS INT) AS x1, n_regionkey * 40 AS y1, CAST(n_nationkey * 10 + i * 27 + 24 AS INT) AS x2, n_regionkey * 40 + 36 AS y2, n_nationkey * 10 AS hx1, n_nationkey * 10 + (2 + n_nationkey % 5) * 27 + 24 AS hx2
FROM (SELECT n_nationkey, n_regionkey, unnest(range(0, 3 + n_nationkey % 5)) AS i FROM nation) AS t"""
SQL["aspect_warning"] = "SELECT p_partkey, abs(CAST(p_size + 60 AS DOUBLE) / CAST(100 + p_partkey % 9 AS DOUBLE) - CAST(1241 AS DOUBLE) / 1755) / (CAST(1241 AS DOUBLE) / 1755) > 0.03 AS off FROM part"
SQL["month_grid"] = "SELECT c_custkey, CAST(m AS INT) AS month, CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE m >= 1 + c_custkey % 12 AND m < 2 + c_custkey % 12 + c_custkey % 5 END AS marked FROM (SELECT c_custkey, unnest(range(1, 13)) AS m FROM customer) AS t"
SQL["filled_children"] = "SELECT c_custkey, CAST(i AS INT) AS child, CASE WHEN i <= c_custkey % 5 THEN 'child ' || CAST(i AS VARCHAR) ELSE '' END AS name FROM (SELECT c_custkey, unnest(range(1, 5)) AS i FROM customer) AS t"
_READINGS = f"""
(SELECT l_orderkey AS form_id, 'row_0' || CAST(l_linenumber AS VARCHAR) AS field, 'decimal' AS kind, raw AS value FROM {MONEY} AS a UNION ALL SELECT k, 'person_id', 'id', raw FROM {IDS} AS b
 UNION ALL SELECT k, 'birth_date', 'digits', birth_date FROM {DATES} AS d UNION ALL SELECT p_partkey, 'street', 'text', ' ' || noisy FROM {NAMES} AS e)"""
_VALUE = f"CASE kind WHEN 'decimal' THEN {_decimal('value')} WHEN 'id' THEN {_id('value')} WHEN 'digits' THEN {_digits('value')} ELSE trim(value, ' ') END"
SQL["extracted_values"] = f"SELECT form_id, field, {_VALUE} AS value FROM {_READINGS} AS t"
SQL["field_match"] = f"""
WITH marks AS (SELECT c_custkey AS form_id, CASE WHEN c_custkey % 3 = 0 THEN 'True' ELSE 'false' END AS value FROM customer),
street AS (SELECT form_id, field, value, CASE WHEN form_id % 4 = 0 THEN 'quite else' || value ELSE value END AS truth FROM {_READINGS} AS t WHERE kind = 'text'),
words AS (SELECT form_id, field, unnest(string_split_regex({_fold('truth')}, '\\s+')) AS w, {_fold('value')} AS r, replace({_fold('value')}, ' ', '') AS h FROM street),
judged AS (SELECT form_id, field, length(w) < 2 OR contains(r, w) OR contains(h, w) OR contains(h, substr(w, 2)) OR contains(h, substr(w, 1, length(w) - 1)) OR (length(w) >= 4 AND ({_NEAR})) AS ok FROM words)
SELECT form_id, field, CASE kind WHEN 'decimal' THEN {_decimal('truth')} = {_decimal('value')} WHEN 'id' THEN truth = {_id('value')} ELSE {_digits('truth')} = {_digits('value')} END AS match
FROM (SELECT *, CASE WHEN kind = 'id' THEN {_id('value')} WHEN form_id % 4 = 0 THEN value || '1' ELSE value END AS truth FROM {_READINGS} AS t WHERE kind <> 'text') AS u
UNION ALL SELECT form_id, field, bool_and(ok) FROM judged GROUP BY form_id, field
UNION ALL SELECT form_id, 'is_correction', (lower(value) = 'true') = (form_id % 2 = 0) FROM marks"""
SQL["field_catalog"] = """
SELECT * FROM (VALUES (1, 'decimal', 'numeric', 14::BIGINT, 0.8::DOUBLE), (2, 'decimal', 'numeric', 5, 0.8), (1, 'id', 'numeric', 1, 0.8), (2, 'id', 'numeric', 5, 0.8), (1, 'digits', 'numeric', 4, 0.8), (2, 'digits', 'numeric', 4, 0.8),
 (1, 'text', 'text', 5, 0.7), (2, 'text', 'text', 12, 0.7), (1, 'occupancy', 'occupancy', 2, 0.3), (2, 'occupancy', 'occupancy', 78, 0.3)) AS t(page, kind, class, n, threshold)"""
SQL["blank_labels"] = "SELECT 130::BIGINT AS n, 130::BIGINT AS fields, 130::BIGINT AS blank"
_R = {i: f"try_cast(row_0{i} AS DECIMAL(18,2))" for i in (1, 2, 3)}
_BROKEN = f"coalesce({_R[1]} - {_R[2]} <> {_R[3]}, false)"
SQL["rule_arithmetic"] = f"SELECT l_orderkey, l_linenumber, unnest(['row_01', 'row_02', 'row_03']) AS field FROM {TRIPLES} AS t WHERE {_BROKEN}"
SQL["rule_unparsable"] = f"SELECT l_orderkey, l_linenumber, row_01, row_02 FROM {TRIPLES} AS t WHERE {_R[1]} IS NULL OR {_R[2]} IS NULL OR {_R[3]} IS NULL"
SQL["count_broken"] = f"SELECT count(*) FILTER ({_BROKEN}) AS broken, count(*) FILTER (NOT {_BROKEN}) AS fine FROM {TRIPLES} AS t"
SQL["rule_id_format"] = f"SELECT k, NOT regexp_full_match({_id('raw')}, {ID_FORM}) AS required_bad, k % 4 > 1 AND {_id('raw')} <> '' AND NOT regexp_full_match({_id('raw')}, {ID_FORM}) AS optional_bad FROM {IDS} AS t"
SQL["rule_id_mod11"] = f"SELECT k, CASE WHEN regexp_full_match({_id('raw')}, {ID_FORM}) THEN CAST(replace({_id('raw')}, '/', '') AS BIGINT) % 11 <> 0 ELSE false END AS fails FROM {IDS} AS t"
SQL["rule_tax_id"] = f"SELECT c_custkey, employer_tax_id <> '' AND length({_digits('employer_tax_id')}) <> 10 AS wrong FROM {EMPLOYER} AS t"
SQL["rule_postal"] = f"SELECT c_custkey, length({_digits('postal_code')}) <> 5 AS wrong FROM {EMPLOYER} AS t"
SQL["rule_year"] = "SELECT c_custkey, NOT (CASE WHEN tax_year = '' THEN 0 WHEN length(tax_year) = 2 THEN 2000 + CAST(tax_year AS INT) ELSE CAST(tax_year AS INT) END BETWEEN 2000 AND 2099) AS wrong FROM " + EMPLOYER + " AS t"
_BIRTH = f"(SELECT k, @ AS person_id, d, regexp_full_match(@, {ID_FORM}) AND length(d) = 8 AS gate, try_strptime(d, '%d%m%Y') IS NOT NULL AND substr(d, 5, 4) <> '0000' AS valid FROM (SELECT k, person_id, {_digits('birth_date')} AS d FROM {DATES} AS t) AS u)"
_DIFFERS = "gate AND valid AND NOT (substr(d, 7, 2) = substr(person_id, 1, 2) AND substr(d, 3, 2) = lpad(CAST(try_cast(substr(person_id, 3, 2) AS INT) % 50 AS VARCHAR), 2, '0') AND substr(d, 1, 2) = substr(person_id, 5, 2))"
SQL["rule_birth_cross"] = f"SELECT k, {_DIFFERS} AS differs FROM {_BIRTH.replace('@', 'person_id')} AS v"
SQL["rule_calendar"] = f"SELECT k, gate AND NOT valid AS impossible FROM {_BIRTH.replace('@', 'person_id')} AS v"
_ISSUES = f"""
(WITH p AS {RECORDS}, b AS (SELECT form_id, person_id, d, regexp_full_match(person_id, {ID_FORM}) AND length(d) = 8 AS gate, try_strptime(d, '%d%m%Y') IS NOT NULL AND substr(d, 5, 4) <> '0000' AS valid FROM (SELECT form_id, person_id, {_digits('birth_date')} AS d FROM p) AS u),
 ids AS (SELECT form_id, 'person_id' AS f, 28 AS o, person_id AS v, true AS needed FROM p UNION ALL SELECT form_id, 'person_id_p2', 30, person_id_p2, false FROM p)
 SELECT form_id, 'arithmetic' AS rule, 10 AS rule_ord, ['row_01', 'row_02', 'row_03'] AS fields FROM p WHERE {_BROKEN}
 UNION ALL SELECT form_id, 'arithmetic_unparsable', 11, ['row_01', 'row_02', 'row_03'] FROM p WHERE {_R[1]} IS NULL OR {_R[2]} IS NULL OR {_R[3]} IS NULL
 UNION ALL SELECT form_id, 'id_format:' || f, o, [f] FROM ids WHERE NOT regexp_full_match(v, {ID_FORM}) AND (needed OR v <> '')
 UNION ALL SELECT form_id, 'id_mod11:' || f, o + 1, [f] FROM ids WHERE regexp_full_match(v, {ID_FORM}) AND try_cast(replace(v, '/', '') AS BIGINT) % 11 <> 0
 UNION ALL SELECT form_id, 'page_match', 40, ['person_id_p2', 'person_id'] FROM p WHERE person_id_p2 <> '' AND person_id_p2 <> person_id
 UNION ALL SELECT form_id, 'tax_id_length', 50, ['employer_tax_id'] FROM p WHERE length(employer_tax_id) NOT IN (0, 10)
 UNION ALL SELECT form_id, 'postal_length', 60, ['postal_code'] FROM p WHERE length({_digits('postal_code')}) <> 5
 UNION ALL SELECT form_id, 'year_range', 70, ['tax_year'] FROM p WHERE tax_year = '1999'
 UNION ALL SELECT form_id, 'birth_date_id', 80, ['birth_date', 'person_id'] FROM b WHERE {_DIFFERS}
 UNION ALL SELECT form_id, 'birth_date_calendar', 81, ['birth_date'] FROM b WHERE gate AND NOT valid)"""
SQL["all_issues"] = f"SELECT form_id, rule, rule_ord, array_to_string(fields, ',') AS fields FROM {_ISSUES} AS t"
SQL["issue_fields"] = f"SELECT field, rule, count(*) AS n FROM (SELECT unnest(fields) AS field, rule FROM {_ISSUES} AS t) AS u GROUP BY field, rule"
SQL["widen_records"] = f"SELECT i.k AS form_id, i.raw AS person_id, d.birth_date AS birth_date, i.k % 3 <> 0 AS no_year FROM {IDS} AS i JOIN {DATES} AS d ON i.k = d.k"


def _snap(key: str, names: str, entries: str) -> str:
    return f"""
(WITH q AS (SELECT {key}, noisy, {_key('noisy')} AS q FROM {names} AS a), r AS (SELECT entry, ord, {_key('entry')} AS e FROM {entries} AS b),
 best AS (SELECT q, arg_min(struct_pack(entry := entry, n := length(e), d := levenshtein(q, e)), row(levenshtein(q, e), ord)) AS m FROM (SELECT DISTINCT q FROM q) AS c CROSS JOIN r GROUP BY q),
 j AS (SELECT q.*, m.entry AS entry, m.d AS d, greatest(length(q.q), m.n) AS longest FROM q JOIN best ON q.q = best.q)
 SELECT {key}, noisy, entry, d <= greatest(1, CAST(floor(longest * CAST(0.34 AS DOUBLE)) AS INT)) AS hit, round_even(CAST(1 - CAST(d AS DOUBLE) / longest AS DOUBLE), 3) AS score FROM j)"""


_SNAP = _snap("p_partkey", NAMES, REGISTER)
_SNAPPED = "CASE WHEN hit THEN entry ELSE trim(noisy, ' ') END AS gaz_value, hit AS gaz_matched, CASE WHEN hit THEN score ELSE 0.0 END AS gaz_score"
SQL["register_index"] = f"SELECT c_custkey, {_SNAPPED} FROM {_snap('c_custkey', adapter_sql('noisy_customer'), adapter_sql('accounts'))} AS t"
SQL["register_snap"] = f"SELECT p_partkey, {_SNAPPED} FROM {_SNAP} AS t"
SQL["register_apply"] = f"SELECT p_partkey, CASE WHEN hit THEN entry ELSE noisy END AS value, CASE WHEN hit THEN greatest(CAST(p_partkey % 100 AS DOUBLE) / 100, 0.85) ELSE 0.0 END AS confidence FROM {_SNAP} AS t"
SQL["register_miss_pool"] = f"SELECT DISTINCT noisy FROM {_SNAP} AS t WHERE NOT hit"
_REASONS = f"""
(WITH r AS (SELECT form_id, field, kind, {_VALUE} AS v, CAST((form_id * 7 + length(field)) % 100 AS DOUBLE) / 100 AS c, CASE WHEN kind = 'text' THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END AS least FROM (SELECT form_id, field, kind, min(value) AS value FROM {_READINGS} AS x GROUP BY form_id, field, kind) AS t)
 SELECT form_id, field, 1 AS o, printf('low confidence %.2f < %.2f', c, least) AS reason FROM r WHERE trim(v, ' ') <> '' AND c < least
 UNION ALL SELECT form_id, field, 2, 'no valid decimal' FROM r WHERE kind = 'decimal' AND NOT regexp_matches(v, '[0-9]')
 UNION ALL SELECT form_id, unnest(fields), rule_ord + 100, 'constraint: ' || rule FROM {_ISSUES} AS i)"""
SQL["escalate_reasons"] = f"SELECT form_id, field, string_agg(reason, '; ' ORDER BY o) AS reasons FROM {_REASONS} AS t GROUP BY form_id, field"
SQL["escalate_flags"] = f"SELECT field, count(DISTINCT form_id) AS forms, count(*) AS reasons FROM {_REASONS} AS t GROUP BY field"
SQL["unreadable_numbers"] = f"SELECT l_orderkey, l_linenumber, {_decimal('raw')} AS value FROM {MONEY} AS t WHERE NOT regexp_matches({_decimal('raw')}, '[0-9]')"
SQL["merge_pages"] = """
WITH p1 AS (SELECT o_orderkey AS form_id, 'total' AS field, o_orderpriority AS value FROM orders), p2 AS (SELECT o_orderkey AS form_id, CASE WHEN o_orderkey % 2 = 0 THEN 'total' ELSE 'state' END AS field, o_orderstatus AS value FROM orders WHERE o_orderkey % 3 = 0)
SELECT coalesce(p2.form_id, p1.form_id) AS form_id, coalesce(p2.field, p1.field) AS field, coalesce(p2.value, p1.value) AS value FROM p1 FULL JOIN p2 ON p1.form_id = p2.form_id AND p1.field = p2.field"""
SQL["pair_files"] = """
SELECT o.o_orderkey, o.o_orderstatus, a.label, b.p2 FROM orders AS o JOIN (SELECT l_orderkey, min(l_returnflag) AS label FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 4 > 0 GROUP BY l_orderkey) AS a ON o.o_orderkey = a.l_orderkey
LEFT JOIN (SELECT l_orderkey, min(l_linestatus) AS p2 FROM lineitem WHERE l_linenumber = 2 GROUP BY l_orderkey) AS b ON o.o_orderkey = b.l_orderkey"""
_MATCHES = f"(SELECT form_id, field, value = CAST(quality AS VARCHAR) AS correct, confidence, confidence < 0.7 AS flagged FROM {OBS} AS o JOIN labels AS l ON o.form_id = l.doc_id)"
SQL["labels_join"] = f"SELECT * FROM {_MATCHES} AS t"
SQL["unknown_labels"] = f"SELECT field, count(*) AS n FROM {OBS} AS t WHERE field NOT IN (SELECT field FROM {OBS} AS u GROUP BY field HAVING min(form_id) % 2 = 0) GROUP BY field ORDER BY field LIMIT 8"
SQL["accuracy_by_field"] = f"""
SELECT f.field, coalesce(c, 0) AS correct, coalesce(n, 0) AS total, CASE WHEN n > 0 THEN 100.0 * c / n ELSE 0.0 END AS pct FROM (SELECT DISTINCT field FROM {OBS} AS t UNION ALL SELECT 'never seen') AS f
LEFT JOIN (SELECT field, count(*) AS n, count(*) FILTER (correct) AS c FROM {_MATCHES} AS t GROUP BY field) AS m ON f.field = m.field"""
SQL["accuracy_overall"] = f"SELECT field, count(*) AS total, count(*) FILTER (correct) AS correct FROM {_MATCHES} AS t GROUP BY ROLLUP (field)"
SQL["eval_report"] = f"SELECT field, total, correct, flagged, round(mean_conf, 9) AS mean_conf, round(acc, 9) AS acc, CASE WHEN acc < 0.95 THEN 'low' ELSE '' END AS mark FROM (SELECT field, count(*) AS total, count(*) FILTER (correct) AS correct, count(*) FILTER (flagged) AS flagged, avg(confidence) AS mean_conf, CAST(count(*) FILTER (correct) AS DOUBLE) / count(*) AS acc FROM {_MATCHES} AS t GROUP BY field) AS u"
SQL["caught_totals"] = f"SELECT CAST(sum(f) AS BIGINT) AS flagged, CAST(sum(CASE WHEN c < n THEN f ELSE 0 END) AS BIGINT) AS caught FROM (SELECT field, count(*) AS n, count(*) FILTER (correct) AS c, count(*) FILTER (flagged) AS f FROM {_MATCHES} AS t GROUP BY field) AS u"
SQL["best_width"] = f"SELECT doc_id, CASE WHEN bool_or(text = '') THEN '' ELSE arg_max(text, row(score, -w)) END AS text, CASE WHEN bool_or(text = '') THEN 1.0 ELSE max(score) END AS score FROM {READS} AS t GROUP BY doc_id"
_BITS = "(SELECT vec_id // 64 AS image, vec_id AS id, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(embedding[1:62], lambda x: CAST(CASE WHEN x > 0 THEN 1 ELSE 0 END AS BIGINT))), lambda a, x: a * 2 + x) AS bits FROM embeddings)"


def _good(ratio: str) -> str:
    return f"""(SELECT image, q_id, arg_min(s_id, rn) AS s_id, arg_min(d, rn) AS d1, arg_max(d, rn) AS d2 FROM (SELECT q.image, q.id AS q_id, s.id AS s_id, CAST(bit_count(xor(q.bits, s.bits)) AS INT) AS d, row_number() OVER (PARTITION BY q.image, q.id ORDER BY bit_count(xor(q.bits, s.bits)), s.id) AS rn
FROM {_BITS} AS q JOIN {_BITS} AS s ON q.image = s.image AND q.id <> s.id) AS t WHERE rn <= 2 GROUP BY image, q_id HAVING count(*) = 2 AND arg_min(d, rn) < CAST({ratio} AS DOUBLE) * arg_max(d, rn))"""


SQL["knn_ratio"] = f"SELECT * FROM {_good('0.9')} AS t"
SQL["match_guard"] = f"SELECT image, count(*) AS n FROM {_good('0.97')} AS t GROUP BY image HAVING count(*) >= 3"
SQL["round_robin"] = "SELECT o_orderkey, ['a', 'b', 'c'][(row_number() OVER (ORDER BY o_orderkey) - 1) % 3 + 1] AS style FROM orders WHERE o_orderkey % 5 <> 2"
SQL["distinct_pool"] = f"SELECT DISTINCT entry FROM (SELECT {_key('p_name')} AS entry FROM part) AS t WHERE length(entry) BETWEEN 1 AND 9"
SQL["positions"] = "SELECT p_partkey, CAST(i - 1 AS INT) AS i, substr(p_name, i, 1) AS ch FROM (SELECT p_partkey, p_name, CAST(unnest(range(1, length(p_name) + 1)) AS INT) AS i FROM part) AS t"
SQL["aligned_cells"] = "SELECT p_partkey, CAST(14 - length(p_name) AS INT) AS right_start, CAST((14 - length(p_name)) // 2 AS BIGINT) AS middle_start, lpad(p_name, 14, ' ') AS right_text FROM part"
_SOURCE = f"""CASE WHEN confidence >= 0.7 THEN NULL WHEN trim(reading, ' ') = '' THEN 'ocr' WHEN a IS NULL THEN 'ocr' WHEN is_name THEN CASE WHEN ratio >= 0.4 THEN 'suggestion' ELSE 'ocr' END
WHEN regexp_full_match(a, '[{ALPHABET} ]+') AND length(a) <= greatest(length(trim(reading, ' ')) + 4, floor(length(trim(reading, ' ')) * CAST(1.6 AS DOUBLE))) AND ratio >= 0.5 THEN 'clean' ELSE 'ocr' END"""
_DECIDED = f"(SELECT *, {_SOURCE} AS source FROM (SELECT *, nullif(trim(response, ' '), '') AS a FROM {ANSWERS} AS t) AS u)"
SQL["tier_decision"] = f"SELECT p_partkey, source, CASE WHEN source = 'clean' THEN a ELSE reading END AS value, CASE WHEN source = 'suggestion' THEN a END AS suggestion, CASE WHEN source = 'clean' THEN greatest(confidence, 0.85) ELSE confidence END AS confidence FROM {_DECIDED} AS v"
SQL["tier_unavailable"] = f"SELECT source, count(*) AS n FROM (SELECT CASE WHEN confidence >= 0.7 THEN NULL WHEN trim(reading, ' ') = '' THEN 'ocr' ELSE 'unavailable' END AS source FROM {ANSWERS} AS t) AS u GROUP BY source"
SQL["escalated_text"] = f"SELECT p_partkey, reading FROM {ANSWERS} AS t WHERE confidence < 0.7 AND trim(reading, ' ') <> ''"
SQL["prompt_text"] = f"SELECT p_partkey, 'Correct this misread ' || CASE WHEN is_name THEN 'person' WHEN p_partkey % 3 = 0 THEN 'company' ELSE 'street' END || ' in block letters: ' || reading AS prompt FROM {ANSWERS} AS t"
SQL["parse_completion"] = f"SELECT p_partkey, nullif(trim(response, ' '), '') AS answer FROM {ANSWERS} AS t"
SQL["label_envelope"] = "SELECT c_custkey, c_name AS name FROM customer"
SQL["json_sidecar"] = "SELECT event_id, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing, json_valid(props) AS parsed FROM events"
SQL["result_json"] = f"SELECT p.form_id, p.person_id, round_even(CAST(p.form_id % 1000 AS DOUBLE) / 1024, 3) AS confidence, coalesce(n, 0) AS n_issues FROM {RECORDS} AS p LEFT JOIN (SELECT form_id, count(*) AS n FROM {_ISSUES} AS i GROUP BY form_id) AS q ON p.form_id = q.form_id"
SQL["base64_image"] = "SELECT c_custkey, to_base64(encode(c_name)) AS b64 FROM customer"
SQL["generated_faults"] = """
WITH f(i, broken, rule) AS (VALUES (1, 'arithmetic', 'arithmetic'), (2, 'check digit', 'id_mod11:person_id'), (2, 'check digit', 'id_mod11:person_id_p2'), (3, 'birth date', 'birth_date_id'), (4, 'page match', 'page_match'), (5, 'postal length', 'postal_length'), (6, 'tax id length', 'tax_id_length'), (7, 'year range', 'year_range'))
SELECT broken, rule, count(*) AS n FROM f JOIN customer ON c_custkey % 8 = i GROUP BY broken, rule"""
SQL["cleaner_lookup"] = f"""
SELECT a.p_partkey, b.response FROM {ANSWERS} AS a LEFT JOIN (SELECT reading, is_name, min(response) AS response FROM {ANSWERS} AS t WHERE p_partkey % 3 > 0 AND response IS NOT NULL GROUP BY reading, is_name) AS b
ON a.reading = b.reading AND a.is_name = b.is_name AND a.confidence < 0.7 AND trim(a.reading, ' ') <> ''"""
SQL["page_observations"] = """
SELECT page_id, CAST(5 AS BIGINT) AS n, share > 0.1 AS marked, round(least(1.0, abs(share - CAST(0.1 AS DOUBLE)) / CAST(0.1 AS DOUBLE)), 9) AS sure, '16' AS box
FROM (SELECT vec_id AS page_id, CAST(len(list_filter(embedding, lambda x: floor(least(greatest(CAST(x AS DOUBLE) + 0.5, 0.0), 1.0) * 255) < 128)) AS DOUBLE) / 64 AS share FROM embeddings) AS t"""
SQL["live_merge"] = """
WITH p1 AS (SELECT o_orderkey AS form_id, unnest([struct_pack(field := 'total', value := o_orderpriority), struct_pack(field := 'state', value := o_orderstatus)]) AS f FROM orders WHERE o_orderkey % 7 > 0),
newest AS (SELECT l_orderkey AS form_id, arg_max(struct_pack(state := l_linestatus, returned := l_returnflag), row(l_linenumber, '{"state":"' || l_linestatus || '","returned":"' || l_returnflag || '"}')) AS n FROM lineitem WHERE l_orderkey % 3 > 0 GROUP BY l_orderkey),
p2 AS (SELECT form_id, unnest([struct_pack(field := 'state', value := n.state), struct_pack(field := 'returned', value := n.returned)]) AS f FROM newest),
a AS (SELECT coalesce(p1.form_id, p2.form_id) AS form_id, coalesce(p1.f.field, p2.f.field) AS field, coalesce(p2.f.value, p1.f.value) AS value FROM p1 FULL JOIN p2 ON p1.form_id = p2.form_id AND p1.f.field = p2.f.field)
SELECT form_id, CASE WHEN form_id NOT IN (SELECT form_id FROM p2) THEN 'first page only' WHEN form_id NOT IN (SELECT form_id FROM p1) THEN 'second page only' ELSE 'complete' END AS status, field, value FROM a"""
_LEVELS = (-0.1, -0.03, 0.03, 0.1)


def _bit_text(first: str) -> str:
    rest = " || ".join(f"array_to_string(list_transform(embedding, lambda x: CASE WHEN x > {t} THEN '1' ELSE '0' END), '')" for t in _LEVELS[1:])
    return f"CAST(array_to_string({first}, '') || {rest} AS BIT)"


_PLAIN_BITS = _bit_text("list_transform(embedding, lambda x: CASE WHEN x > -0.1 THEN '1' ELSE '0' END)")
_TURNED_BITS = _bit_text("list_transform(embedding, lambda x, i: CASE WHEN (x > -0.1) <> (i - 1 IN (vec_id % 64, (vec_id + 21) % 64, (vec_id + 42) % 64)) THEN '1' ELSE '0' END)")
SQL["descriptor_knn"] = f"""
WITH e AS (SELECT vec_id, {_PLAIN_BITS} AS bits FROM embeddings WHERE embedding IS NOT NULL),
d AS (SELECT a.vec_id AS q_id, b.vec_id AS s_id, CAST(bit_count(xor(a.bits, b.bits)) AS BIGINT) AS d FROM e AS a JOIN e AS b ON a.vec_id <> b.vec_id)
SELECT q_id, s_id, d, CAST(row_number() OVER (PARTITION BY q_id ORDER BY d, s_id) AS INT) AS rank FROM d QUALIFY rank <= 2"""
_FITS = f"""
(WITH e AS (SELECT *, vec_id // 64 AS image FROM embeddings WHERE embedding IS NOT NULL),
 t AS (SELECT image, vec_id, {_PLAIN_BITS} AS bits FROM e),
 p1 AS (SELECT image, vec_id, vec_id AS id, {_TURNED_BITS} AS bits FROM e WHERE image % 4 <> 3 OR vec_id % 64 < 8),
 p AS (SELECT * FROM p1 UNION ALL SELECT image, vec_id, vec_id + 1000000000, bits FROM p1 WHERE image % 4 = 1 AND vec_id % 3 > 0),
 d AS (SELECT t.image, t.vec_id AS q, p.vec_id AS s, bit_count(xor(t.bits, p.bits)) AS d, row_number() OVER (PARTITION BY t.image, t.vec_id ORDER BY bit_count(xor(t.bits, p.bits)), 'p' || p.id) AS r FROM t JOIN p ON t.image = p.image),
 good AS (SELECT image, q, min(s) FILTER (r = 1) AS s FROM d WHERE r <= 2 GROUP BY image, q HAVING count(*) = 2 AND min(d) FILTER (r = 1) < 0.75 * min(d) FILTER (r = 2)),
 n AS (SELECT i.image, (SELECT count(*) FROM t WHERE t.image = i.image) AS nt, (SELECT count(*) FROM p WHERE p.image = i.image) AS np, (SELECT count(*) FROM good WHERE good.image = i.image) AS matches,
              (SELECT count(*) FROM good WHERE good.image = i.image AND q = s AND q % 5 > 0) AS inliers FROM (SELECT DISTINCT image FROM e) AS i)
 SELECT image, CASE WHEN least(nt, np) < 10 THEN 'too few features' WHEN matches < 30 THEN 'too few matches' WHEN image % 4 = 2 OR inliers < 10 THEN 'too few inliers' ELSE 'aligned' END AS status, matches, inliers FROM n)"""
SQL["align_status"] = f"""
SELECT image, status, matches, CASE WHEN status = 'aligned' THEN inliers END AS inliers, CASE WHEN status = 'aligned' THEN round(1 / CAST(1.1 AS DOUBLE), 6) END AS scale_x, CASE WHEN status = 'aligned' THEN round(2 / CAST(0.9 AS DOUBLE), 4) END AS shift_y FROM {_FITS} AS f"""
SQL["aligned_pages"] = f"""
WITH p AS (SELECT DISTINCT vec_id % 16 AS page_id FROM embeddings)
SELECT page_id, 12 AS w, 10 AS h, CAST(120 AS BIGINT) AS n, CASE WHEN status = 'aligned' THEN 'aligned' ELSE 'resized' END AS status, CASE WHEN status IS NULL THEN 'no match' WHEN status <> 'aligned' THEN status END AS reason FROM p LEFT JOIN {_FITS} AS f ON p.page_id = f.image"""

#: Common blocks of each pair: the longest one (earliest in x, then in y), then what is left and right of it.
_RATIOS = """
(WITH RECURSIVE block(a, b, x, y, n) AS (
   SELECT DISTINCT a, b, a, b, 0 FROM {pairs} AS p
   UNION ALL
   SELECT a, b, s.x, s.y, s.n FROM (
     SELECT a, b, unnest([struct_pack(x := substr(x, 1, i - 1), y := substr(y, 1, j - 1), n := best.n), struct_pack(x := substr(x, i + best.n), y := substr(y, j + best.n), n := 0)]) AS s FROM (
       SELECT *, -best.at AS i, instr(y, substr(x, -best.at, best.n)) AS j FROM (
         SELECT a, b, x, y, list_max(list_filter(flatten(list_transform(range(1, length(x) + 1), lambda i: list_transform(range(1, length(x) - i + 2), lambda n: struct_pack(n := n, at := -i)))), lambda c: contains(y, substr(x, -c.at, c.n)))) AS best
         FROM block WHERE x <> '' AND y <> '') AS f
       WHERE best IS NOT NULL) AS g) AS h)
 SELECT a, b, CASE WHEN a = '' AND b = '' THEN 1.0 ELSE 2 * CAST(sum(n) AS DOUBLE) / (length(a) + length(b)) END AS ratio FROM block GROUP BY a, b)"""
_PAIRS = f"(SELECT p_partkey, noisy, p_name, upper({_key('noisy')}) AS a, upper({_key('p_name')}) AS b FROM {NAMES} AS t)"
_ALIKE = f"(SELECT p.*, r.ratio FROM {_PAIRS} AS p JOIN {_RATIOS.format(pairs=_PAIRS)} AS r ON p.a = r.a AND p.b = r.b)"
SQL["similarity_ratio"] = f"SELECT p_partkey, ratio FROM {_ALIKE} AS t"
SQL["revalidate_text"] = f"SELECT p_partkey, trim(noisy, ' ') <> '' AND regexp_full_match(trim(noisy, ' '), '[{ALPHABET} ]+') AND length(trim(noisy, ' ')) <= greatest(length(p_name) + 4, floor(length(p_name) * CAST(1.6 AS DOUBLE))) AND ratio >= 0.5 AS ok FROM {_ALIKE} AS t"
#: The parts of a word that an edit leaves, and the letters between them: a text has all of one way in a row.
SQL["fuzzy_in_documents"] = """
WITH p AS (SELECT doc_id, text, substr(text, 41, 9) AS piece FROM documents),
q AS (SELECT doc_id, text, piece, substr(piece, 1, 2) || '#' || substr(piece, 4, 6) AS once FROM p),
w AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN once WHEN 1 THEN substr(once, 1, 6) || '+' || substr(once, 7, 3) ELSE substr(piece, 1, 4) || substr(piece, 6, 4) END AS word FROM q),
e AS (SELECT doc_id, text, word, [regexp_escape(substr(word, 1, i)) || g || regexp_escape(substr(word, i + k)) FOR i IN range(0, length(word) + 1)] AS ways FROM w, (VALUES ('.', 1), ('.', 2), ('', 2)) AS v(g, k))
SELECT doc_id, length(any_value(word)) < 2 OR bool_or(regexp_matches(text, array_to_string(ways, '|'), 's')) AS inside FROM e WHERE text IS NOT NULL GROUP BY doc_id, text UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL"""
SQL["fold_documents"] = "SELECT doc_id, sha256(strip_accents(lower(text))) AS folded FROM documents"
_HEX = "list_transform(embedding, lambda x: printf('%02X', CAST(floor(least(greatest(CAST(x AS DOUBLE) + 0.5, CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)) * 255) AS INT)))"
SQL["samples_on_disk"] = f"""
SELECT vec_id, CAST(vec_id AS VARCHAR) AS row_01, vec_id % 5 = 0 AS broken, vec_id % 3 > 0 AS two, sha256(unhex(array_to_string({_HEX}, ''))) AS p1_sha,
       CASE WHEN vec_id % 3 > 0 THEN sha256(unhex(array_to_string(list_reverse({_HEX}), ''))) END AS p2_sha FROM embeddings"""
_SHIFTED = f"list_transform(range(0, 64), lambda i: CASE WHEN i % 8 >= 2 AND i >= 8 THEN ({_HEX})[i - 9] ELSE 'FF' END)"
SQL["warp_page"] = f"SELECT vec_id AS page_id, sha256(unhex(array_to_string({_SHIFTED}, ''))) AS sha FROM embeddings"
SQL["resize_canvas"] = "SELECT vec_id AS page_id, 16 AS w, 12 AS h, CAST(16 * 12 AS BIGINT) AS n FROM embeddings"
SQL["homography_fit"] = "SELECT vec_id // 64 AS image, count(*) FILTER (vec_id % 7 <> 0) AS inliers, CAST(1.1 AS DOUBLE) AS scale_x, CAST(3 AS DOUBLE) AS shift_x FROM embeddings GROUP BY vec_id // 64"
SQL["answer_document"] = f"""
WITH i AS (SELECT form_id, string_agg(rule, '|' ORDER BY rule_ord, rule) AS rules FROM {_ISSUES} AS t GROUP BY form_id),
r AS (SELECT form_id, person_id, tax_year, i.rules, CASE WHEN form_id % 9 = 0 THEN 'page 2 is not shaped like the form' END AS warned FROM {RECORDS} AS r LEFT JOIN i USING (form_id))
SELECT form_id, person_id, coalesce(tax_year, '') AS tax_year, round_even(CAST(form_id % 1000 AS DOUBLE) / 1024, 3) AS sure, CAST(0.7 AS DOUBLE) AS needed, CASE WHEN form_id % 5 > 0 AND form_id % 4 = 0 THEN 'old -> ' || person_id END AS repair,
       CASE WHEN form_id % 3 = 0 THEN 'STREET ' || form_id END AS suggestion, 'cleaner' AS source, concat_ws('|', warned, rules) AS issues, CASE WHEN form_id % 6 = 0 THEN 'street' ELSE '' END AS flagged, CASE WHEN form_id % 6 = 0 THEN 'unsure|unlisted' END AS reasons
FROM r"""
SQL["readings_in_catalog"] = f"""
WITH m AS (SELECT l_orderkey AS form_id, 'row_0' || l_linenumber AS field FROM {MONEY} AS a UNION ALL SELECT k, 'person_id' FROM {IDS} AS b UNION ALL SELECT k, 'birth_date' FROM {DATES} AS d UNION ALL SELECT p_partkey, 'street' FROM {NAMES} AS e),
t AS (SELECT *, CAST((form_id * 7 + length(field)) % 100 AS DOUBLE) / 100 AS confidence, CASE WHEN field = 'street' THEN 0.7 ELSE 0.8 END AS threshold FROM m)
SELECT field, 1 AS page, CASE WHEN field = 'street' THEN 'text' ELSE 'numeric' END AS class, CASE WHEN field = 'street' THEN 'semi-open' END AS tier, CAST(min(threshold) AS DOUBLE) AS threshold, count(*) AS n, count(*) FILTER (confidence < CAST(threshold AS DOUBLE)) AS below FROM t GROUP BY field"""
