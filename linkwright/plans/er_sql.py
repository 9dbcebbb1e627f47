"""DuckDB SQL of the linkage queries, written independently of the Spark plans."""

from __future__ import annotations

from linkwright.config import DEFAULT
from linkwright.functions.text import ADDRESS_FORMS, ADDRESS_SKIP, LEGAL_FORMS, NA_STRINGS, NAME_STOP


def _list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g')"


def _missing(x: str) -> str:
    return f"({x} IS NULL OR lower({_strip(x)}) IN ('', 'nan', 'none', 'null', 'na'))"


def _words(x: str, forms: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in forms.items())
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda t: CASE t {cases} ELSE t END), ' ')"


def _name(x: str) -> str:
    c = rf"replace(lower(coalesce({x}, '')), chr(160), ' ')"
    c = rf"regexp_replace({c}, '\s*&\s*', ' and ', 'g')"
    return _words(rf"trim(regexp_replace(regexp_replace({c}, '[^\p{{L}}\p{{N}}_\s]+', ' ', 'g'), '\s+', ' ', 'g'))", LEGAL_FORMS)


def _address(x: str) -> str:
    c = rf"replace(lower(coalesce({x}, '')), chr(160), ' ')"
    return _words(rf"trim(regexp_replace(regexp_replace({c}, '[^\p{{L}}\p{{N}}_\s]+', ' ', 'g'), '\s+', ' ', 'g'))", ADDRESS_FORMS)


def _country(x: str) -> str:
    return f"lower({_strip(f'coalesce({x}, {chr(39) * 2})')})"


def _toks(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def _name_toks(x: str) -> str:
    return f"list_distinct(list_filter({_toks(x)}, lambda t: length(t) >= 2 AND t NOT IN ({_list(NAME_STOP)})))"


def _addr_toks(x: str) -> str:
    return rf"list_distinct(list_filter({_toks(x)}, lambda t: regexp_full_match(t, '\p{{Nd}}+') OR (length(t) >= 3 AND t NOT IN ({_list(ADDRESS_SKIP)}))))"


def _numbers(a: str, b: str) -> str:
    return rf"list_distinct(list_concat(regexp_extract_all({a}, '\p{{Nd}}+'), regexp_extract_all({b}, '\p{{Nd}}+')))"


_SEED = DEFAULT.seed
#: First word kept of a name, in order (list_distinct would reorder).
_FIRST = f"list_filter({_toks('name_norm')}, lambda t: length(t) >= 2 AND t NOT IN ({_list(NAME_STOP)}))[1]"


def _latest(n: int) -> str:
    at = "NULL::TIMESTAMP" if n == 1 else "loaded_at"
    return f"""SELECT entity_id, n AS business_name, a AS business_address, c AS country FROM (
    SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY loaded DESC NULLS LAST, n DESC, a DESC, c DESC) AS rn FROM (
      SELECT entity_id, {at} AS loaded, coalesce(business_name, '') AS n, coalesce(business_address, '') AS a, coalesce(country, '') AS c
      FROM train_source{n} WHERE entity_id IS NOT NULL)) WHERE rn = 1"""


def _norm(n: int) -> str:
    return f"SELECT entity_id, {_name('business_name')} AS name_norm, {_address('business_address')} AS address_norm, {_country('country')} AS country_norm FROM ({_latest(n)})"


def _keys(n: str) -> str:
    return f"""
  SELECT entity_id, 'name' AS family, 1 AS priority, 'B1_name_exact' AS tag, name_norm AS key FROM {n} WHERE name_norm <> ''
  UNION ALL SELECT entity_id, 'name', 2, 'B2_name_token', unnest({_name_toks('name_norm')}) FROM {n}
  UNION ALL SELECT entity_id, 'name', 3, 'B3_name_trigram', substr(name_norm, 1, 3) FROM {n} WHERE name_norm <> ''
  UNION ALL SELECT entity_id, 'address', 1, 'B4_address_token', unnest({_addr_toks('address_norm')}) FROM {n}
  UNION ALL SELECT entity_id, 'address', 2, 'B5_numeric_token', unnest(list_filter({_numbers('name_norm', 'address_norm')}, lambda t: length(t) >= 3)) FROM {n}
  UNION ALL SELECT entity_id, 'address', 3, 'B6_country_name_combo', country_norm || '|' || {_FIRST} FROM {n} WHERE country_norm <> '' AND {_FIRST} IS NOT NULL"""


NORM = f"""WITH RECURSIVE n1 AS ({_norm(1)}), n2 AS ({_norm(2)}), n3 AS ({_norm(3)}),
others AS (SELECT * FROM n2 UNION ALL SELECT * FROM n3),
corpus AS (SELECT 'source1' AS source, * FROM n1 UNION ALL SELECT 'source2', * FROM n2 UNION ALL SELECT 'source3', * FROM n3),
sources AS (SELECT 'source1' AS source, 'S1-' AS prefix, entity_id, business_name, business_address, country FROM train_source1
  UNION ALL SELECT 'source2', 'S2-', entity_id, business_name, business_address, country FROM train_source2
  UNION ALL SELECT 'source3', 'S3-', entity_id, business_name, business_address, country FROM train_source3),
truth AS (SELECT DISTINCT source1_entity_id, regexp_replace(v, '["'']$', '') AS candidate_entity_id FROM (
  SELECT source1_entity_id, unnest(regexp_extract_all(matched_entity_ids, 'S[23]-[0-9]+(?:[,;|/ ][a-z0-9]["''])?')) AS v FROM train_matches)),
entities AS (SELECT DISTINCT source1_entity_id FROM train_matches WHERE source1_entity_id IS NOT NULL)"""

BLOCK = f"""{NORM},
k1 AS ({_keys('n1')}), k2 AS ({_keys('n2')}), k3 AS ({_keys('n3')}),
kc AS (SELECT 'source2' AS source, * FROM k2 UNION ALL SELECT 'source3', * FROM k3),
cool AS (SELECT source, tag, key FROM kc GROUP BY 1, 2, 3 HAVING count(*) <= {DEFAULT.max_posting}),
rawp AS (SELECT k1.entity_id AS source1_entity_id, kc.entity_id AS candidate_entity_id, k1.family, k1.priority, k1.tag
  FROM kc JOIN cool USING (source, tag, key) JOIN k1 USING (tag, key)),
fam AS (SELECT source1_entity_id, candidate_entity_id, family, arg_min(tag, priority) AS tag FROM rawp GROUP BY 1, 2, 3),
mrg AS (SELECT source1_entity_id, candidate_entity_id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS block_strategies FROM fam GROUP BY 1, 2),
ts AS (SELECT entity_id, list_distinct(list_concat({_name_toks('name_norm')}, {_addr_toks('address_norm')})) AS t FROM corpus),
rnk AS (SELECT m.*, CASE WHEN len(a.t) + len(b.t) = 0 THEN 0.0 ELSE len(list_intersect(a.t, b.t))::DOUBLE / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) END AS jaccard
  FROM mrg m JOIN ts a ON a.entity_id = m.source1_entity_id JOIN ts b ON b.entity_id = m.candidate_entity_id),
cands AS (SELECT source1_entity_id, candidate_entity_id, block_strategies FROM (
  SELECT *, row_number() OVER (PARTITION BY source1_entity_id ORDER BY jaccard DESC, candidate_entity_id) AS rn FROM rnk) WHERE rn <= {DEFAULT.max_candidates})"""


def _h(*parts: str) -> str:
    return f"('0x' || substr(md5({' || {0} || '.format(chr(39) + '|' + chr(39)).join(parts)}), 1, 8))::BIGINT"


LABELLED = f"""{BLOCK},
split AS (SELECT source1_entity_id, CASE WHEN row_number() OVER (ORDER BY {_h(f"'{_SEED}'", 'source1_entity_id')}, source1_entity_id) <= greatest(1, floor((SELECT count(*) FROM entities) * {DEFAULT.val_fraction})) THEN 'val' ELSE 'train' END AS split FROM entities),
hard AS (SELECT c.source1_entity_id, c.candidate_entity_id FROM cands c SEMI JOIN entities USING (source1_entity_id) ANTI JOIN truth USING (source1_entity_id, candidate_entity_id)),
neg AS (SELECT source1_entity_id, candidate_entity_id FROM (SELECT *, row_number() OVER (PARTITION BY source1_entity_id ORDER BY {_h(f"'{_SEED}'", 'source1_entity_id', 'candidate_entity_id')}, candidate_entity_id) AS rn FROM hard) WHERE rn <= {DEFAULT.negatives_per_entity}),
labelled AS (SELECT *, split FROM (
  SELECT t.*, 1 AS label FROM truth t SEMI JOIN cands USING (source1_entity_id, candidate_entity_id) UNION ALL SELECT *, 0 FROM neg) JOIN split USING (source1_entity_id))"""


def _attributes(pairs: str) -> str:
    cols = ", ".join(f"coalesce({t}.{c}, '') AS {o}{i}" for i, t in ((1, "a"), (2, "b")) for c, o in (("name_norm", "name"), ("address_norm", "addr"), ("country_norm", "country")))
    return f"SELECT p.source1_entity_id, p.candidate_entity_id, {cols} FROM {pairs} p LEFT JOIN n1 a ON a.entity_id = p.source1_entity_id LEFT JOIN others b ON b.entity_id = p.candidate_entity_id"


def _features(pairs: str) -> str:
    w = lambda c: f"list_distinct({_toks(c)})"
    num = lambda n, a: f"list_filter({_numbers(n, a)}, lambda t: length(t) >= 3)"
    jac = lambda a, b: f"CASE WHEN len({a}) + len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"
    ratio = lambda a, b: f"CASE WHEN {a} = '' AND {b} = '' THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE least(length({a}), length({b}))::DOUBLE / greatest(length({a}), length({b})) END"
    return f"""SELECT source1_entity_id, candidate_entity_id,
  (name1 = name2 AND name1 <> '')::INTEGER AS name_exact, (addr1 = addr2 AND addr1 <> '')::INTEGER AS addr_exact, (country1 = country2 AND country1 <> '')::INTEGER AS country_same,
  {jac('wn1', 'wn2')} AS name_token_jaccard, CASE WHEN len(wn1) = 0 OR len(wn2) = 0 THEN 0.0 ELSE len(list_intersect(wn1, wn2))::DOUBLE / least(len(wn1), len(wn2)) END AS name_token_overlap,
  {jac('wa1', 'wa2')} AS addr_token_jaccard, len(list_intersect(d1, d2)) AS num_shared_numeric,
  {ratio('name1', 'name2')} AS name_len_ratio, {ratio('addr1', 'addr2')} AS addr_len_ratio,
  abs(len(wn1) - len(wn2)) AS name_tok_count_diff, abs(len(wa1) - len(wa2)) AS addr_tok_count_diff
  FROM (SELECT *, {w('name1')} AS wn1, {w('name2')} AS wn2, {w('addr1')} AS wa1, {w('addr2')} AS wa2, {num('name1', 'addr1')} AS d1, {num('name2', 'addr2')} AS d2 FROM ({_attributes(pairs)}))"""


def _scores(pairs: str) -> str:
    return f"""SELECT source1_entity_id, candidate_entity_id, round(0.35 * name_token_jaccard + 0.15 * name_token_overlap + 0.25 * addr_token_jaccard + 0.15 * least(num_shared_numeric, 1) + 0.10 * country_same, 6) AS match_proba FROM ({_features(pairs)})"""


_MEASURE = """SELECT {by}source1_entity_id, n_pred, n_true, n_hit,
  CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0 WHEN n_true = 0 OR n_pred = 0 THEN 0.0 ELSE n_hit / n_pred END AS p,
  CASE WHEN n_true = 0 THEN 1.0 ELSE n_hit / n_true END AS r FROM {counts}"""
_F = "CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0 WHEN n_true = 0 THEN 0.0 WHEN 0.25 * p + r > 0 THEN 1.25 * p * r / (0.25 * p + r) ELSE 0.0 END"

VALIDATION = f"""{LABELLED},
val AS ({_scores("(SELECT * FROM labelled WHERE split = 'val')")}),
vent AS (SELECT DISTINCT source1_entity_id FROM val),
vtruth AS (SELECT * FROM truth SEMI JOIN vent USING (source1_entity_id)),
pred AS (SELECT DISTINCT source1_entity_id, candidate_entity_id FROM val WHERE match_proba >= {DEFAULT.default_threshold}),
counts AS (SELECT e.source1_entity_id,
  (SELECT count(*) FROM pred p WHERE p.source1_entity_id = e.source1_entity_id)::DOUBLE AS n_pred,
  (SELECT count(*) FROM vtruth t WHERE t.source1_entity_id = e.source1_entity_id)::DOUBLE AS n_true,
  (SELECT count(*) FROM pred p JOIN vtruth t USING (source1_entity_id, candidate_entity_id) WHERE p.source1_entity_id = e.source1_entity_id)::DOUBLE AS n_hit FROM vent e),
measured AS ({_MEASURE.format(by='', counts='counts')}),
cuts AS (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in DEFAULT.thresholds)}]) AS threshold),
grid AS (SELECT source1_entity_id, threshold FROM vent, cuts),
sp AS (SELECT g.source1_entity_id, g.threshold, count(v.candidate_entity_id)::DOUBLE AS n_pred, count(t.candidate_entity_id)::DOUBLE AS n_hit
  FROM grid g LEFT JOIN val v ON v.source1_entity_id = g.source1_entity_id AND v.match_proba >= g.threshold
  LEFT JOIN vtruth t ON t.source1_entity_id = v.source1_entity_id AND t.candidate_entity_id = v.candidate_entity_id GROUP BY 1, 2),
sc AS (SELECT sp.*, coalesce(t.n, 0)::DOUBLE AS n_true FROM sp LEFT JOIN (SELECT source1_entity_id, count(*) AS n FROM vtruth GROUP BY 1) t USING (source1_entity_id)),
sm AS ({_MEASURE.format(by='threshold, ', counts='sc')}),
swept AS (SELECT threshold, round(avg({_F}), 6) AS macro_f05, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall FROM sm GROUP BY 1)"""

RESULTS = f"""{BLOCK},
allscored AS ({_scores('cands')}),
res AS (SELECT s.entity_id AS source1_entity_id, coalesce((SELECT string_agg(DISTINCT candidate_entity_id, ',' ORDER BY candidate_entity_id) FROM allscored a WHERE a.source1_entity_id = s.entity_id AND match_proba >= {DEFAULT.default_threshold}), '') AS matched_entity_ids
  FROM (SELECT DISTINCT entity_id FROM train_source1) s)"""

_LISTS = """lists AS (SELECT source1_entity_id, coalesce(matched_entity_ids, '') AS l FROM train_matches),
ids AS (SELECT source1_entity_id AS s1, unnest(string_split(l, ',')) AS id FROM lists WHERE trim(l) <> ''),
cids AS (SELECT DISTINCT source1_entity_id AS s1, candidate_entity_id AS id FROM candidate_pairs)"""
_DUPS = """SELECT 'duplicate_row' AS rule, source1_entity_id AS offender FROM lists GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'repeated_id', source1_entity_id FROM lists WHERE len(string_split(l, ',')) <> len(list_distinct(string_split(l, ',')))"""
_PREFIXES = """SELECT DISTINCT CASE WHEN id LIKE 'S1-%' THEN 'self_match' ELSE 'wrong_prefix' END AS rule, id AS offender FROM ids WHERE NOT (id LIKE 'S2-%' OR id LIKE 'S3-%')"""
_MISSING = """SELECT 'missing' AS rule, entity_id AS offender FROM (SELECT DISTINCT trim(entity_id) AS entity_id FROM train_source1) WHERE entity_id NOT IN (SELECT source1_entity_id FROM lists WHERE source1_entity_id IS NOT NULL)
UNION ALL SELECT 'not_required', source1_entity_id FROM (SELECT DISTINCT source1_entity_id FROM lists) WHERE source1_entity_id NOT IN (SELECT trim(entity_id) FROM train_source1)"""
_UNKNOWN = """SELECT DISTINCT 'unknown_id' AS rule, id AS offender FROM ids WHERE (id LIKE 'S2-%' OR id LIKE 'S3-%') AND id NOT IN (SELECT trim(entity_id) FROM train_source2 UNION ALL SELECT trim(entity_id) FROM train_source3)"""

_PARSED = f"""p AS (SELECT source1_entity_id, CASE WHEN {_missing('matched_entity_ids')} THEN []::VARCHAR[] ELSE list_filter(list_transform(string_split(matched_entity_ids, ','), lambda x: {_strip('x')}), lambda x: x <> '') END AS ids FROM train_matches)"""


def _grams(x: str) -> str:
    out = []
    for n in range(DEFAULT.tfidf_ngrams[0], DEFAULT.tfidf_ngrams[1] + 1):
        out.append(f"flatten(list_transform(list_transform({_toks(x)}, lambda t: ' ' || t || ' '), lambda w: CASE WHEN length(w) >= {n} THEN list_transform(range(1, length(w) - {n} + 2), lambda i: substr(w, i, {n})) ELSE []::VARCHAR[] END))")
    return f"list_concat(list_concat({out[0]}, {out[1]}), {out[2]})"


def _vocabulary(column: str) -> str:
    return f"""grams AS (SELECT source || entity_id AS d, unnest({_grams(column)}) AS term FROM corpus),
vocab AS (SELECT term, df, tf, ln((1.0 + (SELECT count(*) FROM corpus)) / (1.0 + df)) + 1.0 AS idf FROM (
  SELECT term, count(DISTINCT d) AS df, count(*) AS tf FROM grams GROUP BY 1 HAVING count(DISTINCT d) >= {DEFAULT.tfidf_min_df} ORDER BY tf DESC, term LIMIT {DEFAULT.tfidf_max_terms}))"""


_VOCAB = _vocabulary("name_norm")


def _value_sql(column: str, expr: str) -> str:
    return f"SELECT md5(coalesce(v, '~')) AS value_md5, {expr} AS norm FROM (SELECT DISTINCT {column} AS v FROM (SELECT {column} FROM train_source1 UNION ALL SELECT {column} FROM train_source2 UNION ALL SELECT {column} FROM train_source3))"


def _block_sql(tag: str) -> str:
    return f"{BLOCK} SELECT DISTINCT source1_entity_id, candidate_entity_id FROM rawp WHERE tag = '{tag}'"


_SORTED = "array_to_string(list_sort({0}), ' ')"
_PAIR = "source1_entity_id, candidate_entity_id"


def _label_features(columns: str) -> str:
    return f"{NORM} SELECT {columns} FROM ({_features('truth')})"


def _r(columns: list[str]) -> str:
    return ", ".join(f"round({c}::DOUBLE, 6) AS {c}" for c in columns)


SQL = {
    "er_na_policy": f"{NORM} SELECT source, " + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL OR {c} IN ({_list(NA_STRINGS)})) AS n_{c}" for c in ("business_name", "business_address", "country")) + " FROM sources GROUP BY 1",
    "er_null_profile": f"{NORM} " + " UNION ALL ".join(f"SELECT source, '{c}' AS column_name, count(*) FILTER (WHERE {_missing(c)}) AS n_missing FROM sources GROUP BY 1" for c in ("entity_id", "business_name", "business_address", "country")),
    "er_prefix_check": f"{NORM} SELECT source, starts_with(entity_id, prefix) AS has_prefix, count(*) AS n_rows FROM sources GROUP BY 1, 2",
    "er_normalize_name": _value_sql("business_name", _name("v")),
    "er_normalize_address": _value_sql("business_address", _address("v")),
    "er_normalize_country": _value_sql("country", _country("v")),
    "er_normalized_table": f"{NORM} SELECT * FROM corpus",
    "er_sig_name_tokens": f"{NORM} SELECT source, entity_id, {_SORTED.format(_name_toks('name_norm'))} AS tokens FROM corpus",
    "er_sig_addr_tokens": f"{NORM} SELECT source, entity_id, {_SORTED.format(_addr_toks('address_norm'))} AS tokens FROM corpus",
    "er_numeric_tokens": f"{NORM} SELECT source, entity_id, {_SORTED.format(_numbers('name_norm', 'address_norm'))} AS tokens FROM corpus",
    "er_sample_rows": f"{NORM} SELECT source, entity_id, business_name, business_address, country FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY entity_id, business_name, business_address, country) AS rn FROM (SELECT source, " + ", ".join(f"CASE WHEN {_missing(c)} THEN '' ELSE {c} END AS {c}" for c in ("entity_id", "business_name", "business_address", "country")) + " FROM sources)) WHERE rn <= 3",
    "er_profile_source": f"{NORM} SELECT source, count(*) AS n_rows, count(DISTINCT coalesce(entity_id, '')) AS n_unique_ids, count(*) - count(DISTINCT coalesce(entity_id, '')) AS n_duplicate_ids, count(*) FILTER (WHERE NOT starts_with(coalesce(entity_id, ''), prefix)) AS n_prefix_mismatch, count(DISTINCT CASE WHEN NOT {_missing('country')} THEN {_strip('country')} END) AS n_countries, count(DISTINCT coalesce(business_name, '')) AS n_names, count(DISTINCT coalesce(business_address, '')) AS n_addresses FROM sources GROUP BY 1",
    "er_country_hist": f"{NORM} SELECT source, CASE WHEN {_missing('country')} THEN '__MISSING__' ELSE {_strip('country')} END AS country, count(*) AS n_rows FROM sources GROUP BY 1, 2",
    "er_gt_explode": f"WITH {_PARSED} SELECT source1_entity_id, unnest(ids) AS candidate_entity_id FROM p",
    "er_gt_sets": f"{NORM} SELECT source1_entity_id, candidate_entity_id FROM entities LEFT JOIN truth USING (source1_entity_id)",
    "er_gt_profile": f"WITH {_PARSED} SELECT count(*) AS n_rows, count(DISTINCT coalesce(source1_entity_id, '')) AS n_source1, count(*) - count(DISTINCT coalesce(source1_entity_id, '')) AS n_duplicate_rows, count(*) FILTER (WHERE len(ids) = 0) AS n_zero, count(*) FILTER (WHERE len(ids) > 0) AS n_some, sum(len(ids))::BIGINT AS n_matched, round(avg(len(ids)), 6) AS mean_matches, sum(len(list_filter(ids, lambda x: starts_with(x, 'S2-'))))::BIGINT AS n_s2, sum(len(list_filter(ids, lambda x: starts_with(x, 'S3-'))))::BIGINT AS n_s3, sum(len(list_filter(ids, lambda x: NOT starts_with(x, 'S2-') AND NOT starts_with(x, 'S3-'))))::BIGINT AS n_other, count(*) FILTER (WHERE len(ids) <> len(list_distinct(ids))) AS n_lists_with_repeats, (SELECT count(DISTINCT i) FROM (SELECT unnest(ids) AS i FROM p)) AS n_distinct_matched FROM p",
    "er_match_hist": f"WITH {_PARSED} SELECT len(ids)::INTEGER AS n_matches, count(*) AS n_rows FROM p GROUP BY 1",
    "er_id_coverage": f"{NORM}, a AS (SELECT DISTINCT entity_id AS id FROM train_source1 ANTI JOIN entities ON entity_id = source1_entity_id), b AS (SELECT DISTINCT source1_entity_id AS id FROM entities ANTI JOIN train_source1 ON entity_id = source1_entity_id) SELECT 'only_source1' AS side, count(*) AS n_ids, array_to_string(list_sort(list(id))[1:5], ',') AS sample_ids FROM a UNION ALL SELECT 'only_labels', count(*), coalesce(array_to_string(list_sort(list(id))[1:5], ','), '') FROM b",
    "er_cartesian_size": "SELECT (SELECT count(*) FROM train_source1) * ((SELECT count(*) FROM train_source2) + (SELECT count(*) FROM train_source3)) AS n_pairs",
    "er_union_sources": f"{NORM} SELECT substr(entity_id, 1, 3) AS prefix, count(*) AS n_records, count(DISTINCT name_norm) AS n_names FROM corpus GROUP BY 1",
    **{f"er_block_b{i}": _block_sql(t) for i, t in enumerate(("B1_name_exact", "B2_name_token", "B3_name_trigram", "B4_address_token", "B5_numeric_token", "B6_country_name_combo"), 1)},
    "er_posting_stats": f"{BLOCK} SELECT source, tag, count(*) AS n_keys, count(*) FILTER (WHERE n > {DEFAULT.max_posting}) AS n_hot_keys, sum(n)::BIGINT AS n_postings, coalesce(sum(n) FILTER (WHERE n <= {DEFAULT.max_posting}), 0)::BIGINT AS n_kept FROM (SELECT source, tag, key, count(*) AS n FROM kc GROUP BY 1, 2, 3) GROUP BY 1, 2",
    "er_name_pairs": f"{BLOCK} SELECT {_PAIR}, tag FROM fam WHERE family = 'name'",
    "er_addr_pairs": f"{BLOCK} SELECT {_PAIR}, tag FROM fam WHERE family = 'address'",
    "er_candidates_raw": f"{BLOCK} SELECT * FROM mrg",
    "er_prerank": f"{BLOCK} SELECT {_PAIR}, round(jaccard, 6) AS jaccard FROM rnk",
    "er_candidates_topk": f"{BLOCK} SELECT {_PAIR} FROM cands",
    "er_candidates": f"{BLOCK} SELECT * FROM cands",
    "er_candidate_lists": f"{BLOCK} SELECT source1_entity_id, string_agg(DISTINCT candidate_entity_id, ',' ORDER BY candidate_entity_id) AS candidate_entity_ids FROM cands GROUP BY 1",
    "er_recovered_pairs": f"{BLOCK} SELECT {_PAIR} FROM truth SEMI JOIN cands USING ({_PAIR})",
    "er_missed_pairs": f"{BLOCK} SELECT {_PAIR} FROM truth ANTI JOIN cands USING ({_PAIR})",
    "er_blocking_recall": f"{BLOCK} SELECT n AS n_positives, h AS n_recovered, n - h AS n_missed, CASE WHEN n > 0 THEN round(h / n, 6) ELSE 0.0 END AS recall, (SELECT count(*) FROM cands) AS n_pairs, (SELECT count(DISTINCT source1_entity_id) FROM cands) AS n_source1 FROM (SELECT (SELECT count(*) FROM truth) AS n, (SELECT count(*) FROM truth SEMI JOIN cands USING ({_PAIR})) AS h)",
    "er_strategy_counts": f"{BLOCK} SELECT tag, count(*) AS n_pairs FROM (SELECT unnest(string_split(block_strategies, ',')) AS tag FROM cands) GROUP BY 1",
    "er_split": f"{LABELLED} SELECT * FROM split",
    "er_hard_negatives": f"{LABELLED} SELECT * FROM hard",
    "er_neg_sample": f"{LABELLED} SELECT * FROM neg",
    "er_pair_stats": f"{LABELLED} SELECT split, count(*) AS n_pairs, sum(label)::BIGINT AS n_pos, sum(1 - label)::BIGINT AS n_neg, round(avg(label), 6) AS positive_rate FROM labelled GROUP BY 1",
    "er_pair_attrs": f"{NORM} {_attributes('truth')}",
    "er_features_exact": _label_features(f"{_PAIR}, name_exact, addr_exact, country_same"),
    "er_features_token": _label_features(f"{_PAIR}, " + _r(["name_token_jaccard", "name_token_overlap", "addr_token_jaccard", "num_shared_numeric"])),
    "er_features_structure": _label_features(f"{_PAIR}, " + _r(["name_len_ratio", "addr_len_ratio", "name_tok_count_diff", "addr_tok_count_diff"])),
    "er_feature_nulls": _label_features("coalesce(sum(" + " + ".join(f"({c} IS NULL)::BIGINT" for c in ("name_exact", "addr_exact", "country_same", "name_token_jaccard", "name_token_overlap", "addr_token_jaccard", "num_shared_numeric", "name_len_ratio", "addr_len_ratio", "name_tok_count_diff", "addr_tok_count_diff")) + "), 0)::BIGINT AS n_null"),
    "er_tfidf_vocab": f"{NORM}, {_VOCAB} SELECT term, df, tf, round(idf, 6) AS idf FROM vocab",
    "er_tfidf_addr_vocab": f"{NORM}, {_vocabulary('address_norm')} SELECT term, df, tf, round(idf, 6) AS idf FROM vocab",
    "er_tfidf_cosine": f"""{NORM}, {_VOCAB},
tfw AS (SELECT entity_id, term, (1.0 + ln(count(*))) * any_value(idf) AS x FROM (SELECT entity_id, unnest({_grams('name_norm')}) AS term FROM corpus) JOIN vocab USING (term) GROUP BY 1, 2),
w AS (SELECT entity_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY entity_id)) AS x FROM tfw)
SELECT {_PAIR}, round(coalesce(sum(a.x * b.x), 0.0), 6) AS cosine FROM truth t LEFT JOIN w a ON a.entity_id = t.source1_entity_id LEFT JOIN w b ON b.entity_id = t.candidate_entity_id AND b.term = a.term GROUP BY 1, 2""",
    "er_predictions": f"{VALIDATION} SELECT * FROM pred",
    "er_entity_f05": f"{VALIDATION} SELECT count(*) AS n_entities, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg({_F}), 6) AS macro_f05, count(*) FILTER (WHERE n_true = 0) AS n_singletons, count(*) FILTER (WHERE n_true = 0 AND n_pred = 0) AS n_singletons_kept, count(*) FILTER (WHERE n_true = 0 AND n_pred > 0) AS n_singleton_merges FROM measured",
    "er_threshold_sweep": f"{VALIDATION} SELECT * FROM swept",
    "er_best_threshold": f"{VALIDATION} SELECT threshold, macro_f05 FROM swept ORDER BY macro_f05 DESC, threshold LIMIT 1",
    "er_error_fp": f"{VALIDATION} SELECT {_PAIR}, match_proba FROM val ANTI JOIN vtruth USING ({_PAIR}) WHERE match_proba >= {DEFAULT.default_threshold} ORDER BY match_proba DESC, 1, 2 LIMIT 20",
    "er_error_fn": f"{VALIDATION} SELECT {_PAIR}, coalesce(match_proba, -1.0) AS match_proba, CASE WHEN match_proba IS NULL THEN 'blocking miss' ELSE 'below threshold' END AS reason FROM vtruth LEFT JOIN val USING ({_PAIR}) WHERE match_proba IS NULL OR match_proba < {DEFAULT.default_threshold} ORDER BY 3, 1, 2 LIMIT 20",
    "er_singleton_merges": f"{VALIDATION} SELECT source1_entity_id, array_to_string(list_sort(list(candidate_entity_id))[1:3], ',') AS examples FROM pred ANTI JOIN vtruth USING (source1_entity_id) GROUP BY 1 ORDER BY 1 LIMIT 20",
    "er_matching_results": f"{RESULTS} SELECT * FROM res",
    "er_result_summary": f"{RESULTS} SELECT count(*) AS n_source1, count(*) FILTER (WHERE matched_entity_ids <> '') AS n_with_match, count(*) FILTER (WHERE matched_entity_ids = '') AS n_without_match FROM res",
    "er_validate_dups": f"WITH {_LISTS} {_DUPS}",
    "er_validate_prefix": f"WITH {_LISTS} {_PREFIXES}",
    "er_validate_missing": f"WITH {_LISTS} {_MISSING}",
    "er_validate_unknown": f"WITH {_LISTS} {_UNKNOWN}",
    "er_validate_subset": f"WITH {_LISTS} SELECT DISTINCT 'not_candidate' AS rule, s1 AS offender FROM ids ANTI JOIN cids USING (s1, id)",
    "er_validate_summary": f"WITH {_LISTS}, f AS ({_DUPS} UNION ALL {_PREFIXES} UNION ALL {_MISSING} UNION ALL {_UNKNOWN}) SELECT rule, count(*) AS n_offenders, array_to_string(list_sort(list_distinct(list(offender)))[1:5], ',') AS sample FROM f GROUP BY 1",
}

# The pair queries again, over all candidates and label pairs.
_ALL = f"{BLOCK}, allp AS (SELECT {_PAIR} FROM cands UNION SELECT {_PAIR} FROM truth)"
SQL |= {f"er_all_{k}": SQL[f"er_{k}"].replace(NORM, _ALL).replace("FROM truth p ", "FROM allp p ").replace("FROM truth t ", "FROM allp t ") for k in ("pair_attrs", "features_exact", "features_token", "features_structure", "feature_nulls", "tfidf_cosine")}
