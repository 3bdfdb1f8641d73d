"""SQL twins of the registered queries, for DuckDB on the same tables."""

from __future__ import annotations

from weftline.functions.detect import NEGATION, SIDES, TERM_ENDING
from weftline.functions.metrics import CHRF_CHARS, CHRF_WORDS
from weftline.functions.text import SINGLE_PROMPT
from weftline.operators.stats import POISSON
from weftline.plans.corpora import REPORTS_SQL
from weftline.schema import LANGUAGE_ALIASES, LANGUAGE_NAMES

# Unicode white space as RE2 writes it.
_WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


def _language(x: str) -> str:
    cases = " ".join(f"WHEN lower({_strip(x)}) IN ({', '.join(map(_lit, names))}) THEN '{code}'" for code, names in LANGUAGE_ALIASES.items())
    return f"CASE {cases} END"


def _domain(x: str) -> str:
    return f"coalesce(nullif(lower({_strip(x)}), ''), 'unspecified')"


def _area(x: str) -> str:
    parts = f"list_filter(list_transform(string_split(lower({_collapse(x)}), ','), lambda y: trim(y)), lambda y: y <> '')"
    return f"coalesce(nullif(array_to_string({parts}, ', '), ''), 'unspecified')"


_R = f"WITH r AS ({REPORTS_SQL})"
_NEG = "truth_negation IS NOT NULL"
_CRIT = f"({_NEG} OR truth_side OR truth_number)"
_ALL_CODES = f"""
  SELECT truth_negation AS code, 'critical' AS severity, model FROM r WHERE {_NEG}
  UNION ALL SELECT 'laterality_missing_or_flipped', 'critical', model FROM r WHERE truth_side
  UNION ALL SELECT 'laterality_added_or_flipped', 'critical', model FROM r WHERE truth_side
  UNION ALL SELECT 'number_or_measurement_mismatch', 'critical', model FROM r WHERE truth_number
  UNION ALL SELECT 'terminology_not_preserved', 'major', model FROM r WHERE truth_term"""
_SEGMENTS = f"""segs AS (SELECT id, any_value(source) AS source, any_value({_language('src_lang')}) AS src_lang, any_value({_language('tgt_lang')}) AS tgt_lang,
  any_value(src_text) AS src_text, any_value(ref_text) AS ref_text FROM segments WHERE id IS NOT NULL GROUP BY id)"""
_EVALS = f"""evs AS (SELECT DISTINCT ON (eval_id) eval_id, id, model, {_domain('domain')} AS domain, {_language('src_lang')} AS src_lang, {_language('tgt_lang')} AS tgt_lang,
  hyp_text, metrics, findings, has_critical_error, scored_at FROM evaluations WHERE eval_id IS NOT NULL)"""
# any metric of a map, null where the map, the key or the value is missing
_METRIC = "metrics['{}']"


def _rate(prefix: str) -> str:
    return f"round(avg(CASE WHEN len(list_filter(findings, lambda f: starts_with(f.code, '{prefix}'))) > 0 THEN 1 ELSE 0 END), 6)"


def _codes(where: str) -> str:
    return f"{_R}, c AS ({_ALL_CODES}) SELECT model, code, severity, count(*)::BIGINT AS n FROM c WHERE {where} GROUP BY ALL"


_13A = (
    "regexp_replace(regexp_replace(regexp_replace(' ' || {} || ' ', '([\\{{-\\~\\[-\\` -\\&\\(-\\+\\:-\\@\\/])', ' \\1 ', 'g'),"
    " '([^0-9])([\\.,])', '\\1 \\2 ', 'g'), '([\\.,])([^0-9])', ' \\1 \\2', 'g')"
)


def _tokens(x: str) -> str:
    return f"list_filter(string_split({_13A.format(x)}, ' '), lambda t: t <> '')"


def _bleu_formula(p: str) -> str:
    """BLEU of columns h, r (lengths), c1..c4, t1..t4."""
    smooth, logs, order = "1.0", [], []
    for n in range(1, 5):
        smooth = f"({smooth} * CASE WHEN {p}t{n} > 0 AND {p}c{n} = 0 THEN 2.0 ELSE 1.0 END)"
        logs.append(f"CASE WHEN {p}t{n} > 0 THEN ln(CASE WHEN {p}c{n} > 0 THEN 100.0 * {p}c{n} / {p}t{n} ELSE 100.0 / ({smooth} * {p}t{n}) END) ELSE 0 END")
        order.append(f"CASE WHEN {p}t{n} > 0 THEN 1 ELSE 0 END")
    none = " + ".join(f"{p}c{n}" for n in range(1, 5))
    return f"CASE WHEN {none} = 0 THEN 0.0 ELSE (CASE WHEN {p}h < {p}r THEN exp(1 - {p}r::DOUBLE / {p}h) ELSE 1.0 END) * exp(({' + '.join(logs)}) / ({' + '.join(order)})) END"


def _clipped(pairs: str, n: int, a: str, b: str, gram: str) -> str:
    """p and clipped matches of n-grams of lists or strings a and b of ``pairs``."""

    def side(x: str) -> str:
        return f"SELECT p, g, count(*) AS k FROM (SELECT p, unnest(list_transform(range(1, len({x}) - {n - 1} + 1), lambda i: {gram.format(x=x, n=n)})) AS g FROM {pairs}) GROUP BY p, g"

    return f"SELECT x.p, sum(least(x.k, y.k))::BIGINT AS m FROM ({side(a)}) x JOIN ({side(b)}) y ON x.p = y.p AND x.g = y.g GROUP BY x.p"


_DISTINCT = f"{_R}, d AS (SELECT model, domain, hyp_text, ref_text, count(*) AS w, row_number() OVER () AS p FROM r GROUP BY model, domain, hyp_text, ref_text)"


# evaluations with text and the non-empty reference of their segment, each pair of texts once
_REFERENCED = f"""WITH {_SEGMENTS}, {_EVALS}, d AS (SELECT e.model, '' AS domain, hyp_text, ref_text, count(*) AS w, row_number() OVER () AS p
  FROM evs e JOIN segs s ON e.id = s.id WHERE hyp_text IS NOT NULL AND ref_text <> '' GROUP BY ALL)"""


def _tokens_whole(x: str) -> str:
    """All rules of the tokens, on texts of more than one line."""
    x = f"replace(replace(replace({x}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        x = f"replace({x}, '{entity}', '{char}')"
    return f"list_filter(regexp_split_to_array(regexp_replace({_13A.format(x)}, '([0-9])(-)', '\\1 \\2 ', 'g'), '{_WS}+'), lambda t: t <> '')"


def _bleu_stats(rows: str = _DISTINCT, tokens=_tokens) -> str:
    gram = "array_to_string({x}[i:i + {n} - 1], chr(1))"
    joins = " ".join(f"LEFT JOIN ({_clipped('tk', n, 'ht', 'rt', gram)}) g{n} ON tk.p = g{n}.p" for n in range(1, 5))
    counts = ", ".join([f"coalesce(g{n}.m, 0) AS c{n}, greatest(0, len(ht) - {n - 1}) AS t{n}" for n in range(1, 5)])
    return f"{rows}, tk AS (SELECT *, {tokens('hyp_text')} AS ht, {tokens('ref_text')} AS rt FROM d), st AS (SELECT tk.model, tk.domain, w, len(ht) AS h, len(rt) AS r, {counts} FROM tk {joins})"


def _chrf(rows: str = _DISTINCT, by: str = "model, domain", shown: str = "h0::BIGINT AS hyp_1, m5::BIGINT AS match_6, m7::BIGINT AS match_words_2") -> str:
    words = "list_filter(list_concat([], flatten(list_transform(regexp_split_to_array({x}, '" + _WS.replace("{", "{{").replace("}", "}}") + "+'), lambda w: CASE WHEN length(w) > 1 AND regexp_matches(w, '[[:punct:]]$') THEN [w[:-2], w[-1]] WHEN length(w) > 1 AND regexp_matches(w, '^[[:punct:]]') THEN [w[1], w[2:]] ELSE [w] END))), lambda w: w <> '')"
    tk = f"tk AS (SELECT *, regexp_replace(hyp_text, '{_WS}', '', 'g') AS hc, regexp_replace(ref_text, '{_WS}', '', 'g') AS rc, {words.format(x='hyp_text')} AS hw, {words.format(x='ref_text')} AS rw FROM d)"
    joins, columns, sums, form = [], [], [], []
    orders = [("hc", "rc", n, "substr({x}, i, {n})", "length") for n in range(1, CHRF_CHARS + 1)] + [("hw", "rw", n, "array_to_string({x}[i:i + {n} - 1], chr(1))", "len") for n in range(1, CHRF_WORDS + 1)]
    for k, (a, b, n, gram, size) in enumerate(orders):
        joins.append(f"LEFT JOIN ({_clipped('tk', n, a, b, gram)}) g{k} ON tk.p = g{k}.p")
        columns.append(f"CASE WHEN {size}({b}) >= {n} THEN greatest(0, {size}({a}) - {n - 1}) ELSE 0 END AS h{k}, greatest(0, {size}({b}) - {n - 1}) AS r{k}, coalesce(g{k}.m, 0) AS m{k}")
        sums.append(", ".join(f"sum(w * {x}{k})::DOUBLE AS {x}{k}" for x in "hrm"))
        form.append(k)
    p = "(" + " + ".join(f"CASE WHEN h{k} > 0 AND r{k} > 0 THEN m{k} / h{k} ELSE 0 END" for k in form) + ")"
    q = "(" + " + ".join(f"CASE WHEN h{k} > 0 AND r{k} > 0 THEN m{k} / r{k} ELSE 0 END" for k in form) + ")"
    o = "(" + " + ".join(f"CASE WHEN h{k} > 0 AND r{k} > 0 THEN 1 ELSE 0 END" for k in form) + ")"
    score = f"100 * 5 * ({p} / {o}) * ({q} / {o}) / (4 * ({p} / {o}) + ({q} / {o}))"
    return (
        f"{rows}, {tk}, st AS (SELECT tk.model, tk.domain, w, {', '.join(columns)} FROM tk {' '.join(joins)}),"
        f" s AS (SELECT {by}, sum(w)::BIGINT AS n, {', '.join(sums)} FROM st GROUP BY {by})"
        f" SELECT {by}, {shown}, round({score}, 4) AS chrf FROM s"
    )


def _tail(b: str, c: str) -> str:
    n = f"({b} + {c})"
    logs = f"lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2.0)"
    return f"CASE WHEN {n} = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least({b}, {c}) + 1), lambda i: exp({logs})))) END"


_TWO = f"""{_EVALS}, two AS (SELECT a.id, crit_a, crit_b, chrf_a, chrf_b FROM
  (SELECT id, bool_or(has_critical_error) AS crit_a, max({_METRIC.format('chrf')}) AS chrf_a FROM evs WHERE model = 'aster-600m' GROUP BY id) a JOIN
  (SELECT id, bool_or(has_critical_error) AS crit_b, max({_METRIC.format('chrf')}) AS chrf_b FROM evs WHERE model = 'kelp-api' GROUP BY id) b ON a.id = b.id)"""


def _draws(rows: str, columns: str) -> str:
    """Weighted sums of 2,000 resamples; a row's weight is a Poisson number read off a hash."""
    weight = " + ".join(f"CASE WHEN u >= {x} THEN 1 ELSE 0 END" for x in POISSON)
    return f"""hs AS (SELECT i.*, b.range AS block, md5('13|' || b.range || '|' || id) AS h FROM range(500) b, {rows} i),
  us AS (SELECT hs.*, block * 4 + j.range AS resample, ('0x' || substr(h, 1 + 8 * j.range, 8))::BIGINT AS u FROM hs, range(4) j),
  dr AS (SELECT *, ({weight})::DOUBLE AS weight FROM us), rs AS (SELECT resample, {columns} FROM dr WHERE weight > 0 GROUP BY resample)"""


def _has(x: str, pattern: str) -> str:
    pattern = pattern.replace(r"\s", _WS)
    return f"regexp_matches(coalesce({x}, ''), {_lit(rf'(?i)(^|[^\p{{L}}\p{{N}}_])(?:{pattern})($|[^\p{{L}}\p{{N}}_])')})"


def _by_language(lang: str, of) -> str:
    return "CASE " + " ".join(f"WHEN {lang} = '{code}' THEN {of(code)}" for code in NEGATION) + " END"


_PAIRS = f"""WITH {_SEGMENTS}, {_EVALS}, p AS (SELECT e.model, e.src_lang AS a, e.tgt_lang AS b, s.src_text AS x, e.hyp_text AS y FROM evs e JOIN segs s ON e.id = s.id WHERE hyp_text IS NOT NULL)"""


def _negation() -> str:
    cue = lambda x, lang: _by_language(lang, lambda c: _has(x, NEGATION[c]))
    return f"""{_PAIRS}, f AS (SELECT model, {cue('x', 'a')} AS s, {cue('y', 'b')} AS t FROM p) SELECT model, CASE WHEN s THEN 'negation_dropped' ELSE 'negation_introduced' END AS code,
  'critical' AS severity, count(*)::BIGINT AS n FROM f WHERE s <> t GROUP BY ALL"""


def _laterality() -> str:
    side = lambda x, lang, n: _by_language(lang, lambda c: f"({_has(x, SIDES[c][n])} OR {_has(x, SIDES[c]['bilateral'])})")
    flags = ", ".join(f"{side(x, lang, n)} AS {x}_{n}" for x, lang in (("x", "a"), ("y", "b")) for n in ("left", "right"))
    return f"""{_PAIRS}, f AS (SELECT model, {flags} FROM p), c AS (
  SELECT model, 'laterality_missing_or_flipped' AS code FROM f WHERE (x_left AND NOT y_left) OR (x_right AND NOT y_right)
  UNION ALL SELECT model, 'laterality_added_or_flipped' FROM f WHERE (y_left AND NOT x_left) OR (y_right AND NOT x_right)) SELECT model, code, 'critical' AS severity, count(*)::BIGINT AS n FROM c GROUP BY ALL"""


def _terminology() -> str:
    words = lambda c: f"array_to_string(list_transform(regexp_split_to_array(trim({c}), '{_WS}+'), lambda w: regexp_escape(w)), '{_WS}+')"
    form = lambda c: f"'(?i)(^|[^\\p{{L}}\\p{{N}}_])' || {words(c)} || '{TERM_ENDING}($|[^\\p{{L}}\\p{{N}}_])'"
    return f"""{_PAIRS}, bank AS (SELECT DISTINCT concept_id, en, de, {form('en')} AS en_form, {form('de')} AS de_form FROM term_bank WHERE en <> '' AND de <> ''),
  h AS (SELECT p.*, k.* FROM p JOIN bank k ON (a = 'en' AND b = 'de' AND contains(lower(x), split_part(lower(trim(en)), ' ', 1))) OR (a = 'de' AND b = 'en' AND contains(lower(x), split_part(lower(trim(de)), ' ', 1))))
  SELECT model, 'terminology_not_preserved' AS code, 'major' AS severity, count(*)::BIGINT AS n FROM h
  WHERE regexp_matches(x, CASE WHEN a = 'en' THEN en_form ELSE de_form END) AND NOT regexp_matches(y, CASE WHEN b = 'en' THEN en_form ELSE de_form END) GROUP BY model"""


_CLEAN = f"""length({_strip('src_text')}) >= 3 AND length({_strip('ref_text')}) >= 3 AND lower({_strip('src_text')}) <> lower({_strip('ref_text')})
  AND least(length(src_text), length(ref_text)) > 0 AND greatest(length(src_text), length(ref_text)) <= 3.0 * least(length(src_text), length(ref_text))"""
_SENTENCES = f"list_filter(list_transform(string_split(regexp_replace(text, '([^\\t-\\r \\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}A-ZÇĞİÖŞÜ0-9])([.!?]){_WS}+', '\\1\\2' || chr(1), 'g'), chr(1)), lambda s: {_strip('s')}), lambda s: s <> '')"
_STEPS = f"{_EVALS}, st AS (SELECT model, month(scored_at)::INT AS step, (month(scored_at) + 1) // 2 AS cycle, round(avg({_METRIC.format('bleu')}), 6) AS bleu, avg(length(hyp_text)) AS chars FROM evs WHERE scored_at IS NOT NULL AND hyp_text IS NOT NULL GROUP BY ALL)"


def _reports_of(lang: str, names: tuple[str, ...]) -> str:
    modality = f"coalesce(nullif({_strip('modality')}, ''), 'unspecified')"
    return f"""SELECT 'parrot-' || no AS id, 'parrot-' || lower({modality}) AS domain, '{lang}' AS src_lang, {_area('area')} AS area,
  length({_strip('report')})::INT AS src_chars, length({_strip('translation')})::INT AS ref_chars FROM parrot_raw
  WHERE lower({_strip('language')}) IN ({', '.join(map(_lit, names))}) AND {_strip('report')} <> '' AND {_strip('translation')} <> ''"""


def _prompt() -> str:
    name = lambda x: "CASE " + " ".join(f"WHEN {x} = '{c}' THEN '{n}'" for c, n in LANGUAGE_NAMES.items()) + " END"
    fixed = len(SINGLE_PROMPT.replace("%s", ""))
    return f"WITH {_SEGMENTS} SELECT id, ({fixed} + length({name('src_lang')}) + length({name('tgt_lang')}) + length(src_text))::INT AS prompt_chars FROM segs WHERE src_text IS NOT NULL AND src_lang IS NOT NULL AND tgt_lang IS NOT NULL"


def oracle_sql() -> dict[str, str]:
    """SQL by the name of its query."""
    rates = {"negation_flip_rate": "negation_", "laterality_error_rate": "laterality_", "number_error_rate": "number_or_measurement_mismatch", "terminology_error_rate": "terminology_not_preserved"}
    bleu_sums = ", ".join(f"sum(w * {x})::BIGINT AS {x}" for x in ("h", "r", *(f"{a}{n}" for a in "ct" for n in range(1, 5))))
    truth = lambda x: f"round(avg(CASE WHEN {x} THEN 1 ELSE 0 END), 6)"
    return {
        "critical_error_rate_by_system": f"{_R} SELECT model, count(*)::BIGINT AS n, {truth(_CRIT)} AS critical_error_rate FROM r GROUP BY model",
        "negation_findings": _codes("starts_with(code, 'negation')"),
        "laterality_findings": _codes("starts_with(code, 'laterality')"),
        "number_mismatch_findings": _codes("starts_with(code, 'number')"),
        "terminology_findings": _codes("starts_with(code, 'terminology')"),
        "finding_counts": f"{_R}, c AS ({_ALL_CODES}) SELECT code, count(*)::BIGINT AS n FROM c GROUP BY code",
        "error_segment_rates": f"{_R}, c AS ({_ALL_CODES}) SELECT code, round(count(*)::DOUBLE / (SELECT count(*) FROM r), 6) AS rate FROM c GROUP BY code",
        "severity_counts": f"{_R}, c AS ({_ALL_CODES}) SELECT severity AS code, count(*)::BIGINT AS n FROM c GROUP BY severity",
        "detector_coverage": f"""WITH {_SEGMENTS}, p AS (SELECT DISTINCT src_lang, tgt_lang, CASE WHEN src_lang IN ('en', 'de') AND tgt_lang IN ('en', 'de') THEN 1 ELSE 0 END AS b FROM segs)
  SELECT src_lang, tgt_lang, b AS negation, b AS laterality, 1 AS number_or_measurement, b AS terminology FROM p""",
        "leaderboard_rates": f"""{_R} SELECT model, src_lang || '→' || tgt_lang AS direction, domain, count(*)::BIGINT AS n_segments, {truth(_CRIT)} AS critical_error_rate,
  {truth(_NEG)} AS negation_flip_rate, {truth('truth_side')} AS laterality_error_rate, {truth('truth_number')} AS number_error_rate, {truth('truth_term')} AS terminology_error_rate FROM r GROUP BY ALL""",
        "leaderboard_evaluations": f"""WITH {_EVALS} SELECT coalesce(model, 'unknown') AS model, coalesce(src_lang, '?') || '→' || coalesce(tgt_lang, '?') AS direction, domain, count(*)::BIGINT AS n_segments,
  round(avg({_METRIC.format('comet')}), 3) AS comet, round(avg(CASE WHEN len(list_filter(findings, lambda f: f.severity = 'critical')) > 0 THEN 1 ELSE 0 END), 6) AS critical_error_rate,
  {', '.join(f'{_rate(p)} AS {n}' for n, p in rates.items())} FROM evs GROUP BY ALL""",
        "corpus_bleu_by_group": f"{_bleu_stats()}, s AS (SELECT model, domain, {bleu_sums} FROM st GROUP BY model, domain) SELECT model, domain, h AS sys_len, c1 AS correct_1, c4 AS correct_4, round({_bleu_formula('')}, 4) AS bleu FROM s",
        "sentence_bleu": f"{_bleu_stats()}, b AS (SELECT model, w, {_bleu_formula('')} AS b FROM st) SELECT model, round(sum(w * b) / sum(w), 4) AS mean_bleu, round(min(b), 4) AS least_bleu FROM b GROUP BY model",
        "corpus_chrf_by_group": _chrf(),
        "length_ratio_filter": f"WITH {_SEGMENTS} SELECT source, count(*)::BIGINT AS kept FROM segs WHERE {_CLEAN} GROUP BY source",
        "length_ratio": f"""WITH {_SEGMENTS}, {_EVALS} SELECT e.model, round(avg(length(hyp_text) / length(src_text)), 6) AS ratio FROM evs e JOIN segs s ON e.id = s.id
  WHERE hyp_text IS NOT NULL AND ref_text <> '' AND src_text <> '' GROUP BY e.model""",
        "dedup_first": f"WITH {_SEGMENTS} SELECT min(id) AS id FROM segs WHERE ref_text IS NOT NULL GROUP BY src_text, ref_text",
        "hash_sample": f"WITH {_SEGMENTS} SELECT id FROM segs ORDER BY md5('13|' || id), id LIMIT 400",
        "stratified_sample": f"""WITH {_SEGMENTS}, o AS (SELECT id, length(src_text)::INT AS n_chars, row_number() OVER (ORDER BY length(src_text), id) - 1 AS position, count(*) OVER () AS n FROM segs WHERE src_text IS NOT NULL)
  SELECT id, n_chars FROM o WHERE n <= 100 OR position IN (SELECT floor(range * (n / 100))::BIGINT FROM range(100))""",
        "sentence_split": f"WITH s AS (SELECT doc_id, {_SENTENCES} AS s FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(s)::INT AS n_sentences, length(coalesce(array_to_string(s, ''), ''))::INT AS n_chars FROM s",
        "chunk_reassemble": f"WITH s AS (SELECT doc_id, {_SENTENCES} AS s FROM documents WHERE text IS NOT NULL) SELECT doc_id, md5(coalesce(array_to_string(s, ' '), '')) AS digest FROM s",
        "align_unmatched": """WITH a AS (SELECT DISTINCT id FROM evaluations WHERE model = 'aster-600m'), b AS (SELECT DISTINCT id FROM evaluations WHERE model = 'kelp-api'), u AS (
  SELECT 'left' AS side FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.id = a.id) UNION ALL SELECT 'right' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.id = b.id)) SELECT side, count(*)::BIGINT AS n FROM u GROUP BY side""",
        "mcnemar_systems": f"""WITH {_TWO}, m AS (SELECT count(*) FILTER (crit_a AND NOT crit_b)::BIGINT AS b, count(*) FILTER (NOT crit_a AND crit_b)::BIGINT AS c FROM two)
  SELECT b AS baseline_only, c AS candidate_only, round({_tail('b', 'c')}, 9) AS p_value FROM m""",
        "bootstrap_critical_rate": f"""WITH {_TWO}, {_draws('two', 'sum(CASE WHEN crit_a THEN weight ELSE 0.0 END) / sum(weight) AS d')} SELECT (SELECT round(avg(CASE WHEN crit_a THEN 1.0 ELSE 0.0 END), 9) FROM two) AS observed,
  round(quantile_cont(d, 0.025), 9) AS ci_low, round(quantile_cont(d, 0.975), 9) AS ci_high FROM rs""",
        "paired_bootstrap_mean": f"""WITH {_TWO}, has AS (SELECT * FROM two WHERE chrf_a IS NOT NULL AND chrf_b IS NOT NULL), {_draws('has', 'sum(weight * chrf_b) / sum(weight) - sum(weight * chrf_a) / sum(weight) AS d')}
  SELECT (SELECT round(sum(chrf_b) / count(*) - sum(chrf_a) / count(*), 6) FROM has) AS observed_difference, round(quantile_cont(d, 0.025), 6) AS ci_low, round(quantile_cont(d, 0.975), 6) AS ci_high,
  round(least(1.0, 2 * least(avg(CASE WHEN d <= 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN d >= 0 THEN 1.0 ELSE 0.0 END))), 6) AS p_value FROM rs""",
        "run_summaries": f"""WITH {_SEGMENTS}, {_EVALS}, r AS (SELECT e.*, s.ref_text FROM evs e JOIN segs s ON e.id = s.id)
  SELECT model, count(*)::BIGINT AS n_segments, min(CASE WHEN ref_text <> '' THEN 1 ELSE 0 END)::INT AS has_references,
  sum(CASE WHEN len(list_filter(findings, lambda f: f.severity = 'critical')) > 0 THEN 1 ELSE 0 END)::BIGINT AS critical_error_segments,
  round(avg(CASE WHEN len(list_filter(findings, lambda f: f.severity = 'critical')) > 0 THEN 1 ELSE 0 END), 6) AS critical_error_rate, sum(coalesce(len(findings), 0))::BIGINT AS findings,
  sum(coalesce(len(list_filter(findings, lambda f: f.code = 'number_or_measurement_mismatch')), 0))::BIGINT AS number_findings,
  sum(coalesce(len(list_filter(findings, lambda f: f.severity = 'critical')), 0))::BIGINT AS critical_findings,
  round(avg(CASE WHEN len(list_filter(findings, lambda f: f.code = 'negation_dropped')) > 0 THEN 1 ELSE 0 END), 6) AS negation_dropped_rate,
  round(avg({_METRIC.format('comet')}), 6) AS comet FROM r GROUP BY model""",
        "corpus_bleu_evaluations": f"{_bleu_stats(_REFERENCED, _tokens_whole)}, s AS (SELECT model, sum(w)::BIGINT AS n, {bleu_sums} FROM st GROUP BY model) SELECT model, n, h AS s0, r AS s1, c1 AS s2, c4 AS s5, round({_bleu_formula('')}, 4) AS bleu FROM s",
        "corpus_chrf_evaluations": _chrf(_REFERENCED, "model", "n, h0::BIGINT AS s0, m5::BIGINT AS s17, m7::BIGINT AS s23"),
        "evaluation_negation": _negation(),
        "evaluation_laterality": _laterality(),
        "evaluation_terminology": _terminology(),
        "evaluation_steps": f"""WITH {_EVALS} SELECT weekofyear(scored_at)::INT AS step, count(*)::BIGINT AS n_segments, round(avg(CASE WHEN has_critical_error THEN 1 ELSE 0 END), 6) AS critical_error_rate,
  {', '.join(f"round(avg({_METRIC.format(m)}), 6) AS {m}" for m in ('bleu', 'chrf', 'ter'))}, round(avg(length(hyp_text)), 6) AS mean_output_chars FROM evs WHERE scored_at IS NOT NULL AND hyp_text IS NOT NULL GROUP BY 1""",
        "curve_delta": f"""WITH {_STEPS}, c AS (SELECT model, max(bleu) FILTER (cycle = 1) AS c1, max(bleu) FILTER (cycle = 2) AS c2, max(bleu) FILTER (cycle = 6) AS c_last FROM st WHERE step % 2 = 1 GROUP BY model)
  SELECT model, c1, c2, c_last, round(c_last - c1, 5) AS delta, CASE WHEN c1 <> c_last THEN round((c1 - c2) / (c1 - c_last), 4) END AS front_loaded FROM c""",
        "curve_pivot": f"WITH {_STEPS} SELECT model, {', '.join(f'max(bleu) FILTER (step = {i}) AS step_{i}' for i in range(1, 13))} FROM st GROUP BY model",
        "system_ranking": f"""WITH {_STEPS}, f AS (SELECT model, bleu, row_number() OVER (ORDER BY bleu DESC, model)::INT AS place FROM st WHERE step = 1),
  s AS (SELECT model, CASE WHEN arg_max(chars, step) < 0.95 * arg_min(chars, step) THEN 1 ELSE 0 END AS shrinks FROM st GROUP BY model) SELECT f.model, bleu, place, shrinks FROM f JOIN s ON f.model = s.model""",
        "lag_hop_input": f"""WITH {_SEGMENTS}, {_EVALS} SELECT eval_id, length(coalesce(lag(hyp_text) OVER (PARTITION BY e.id ORDER BY eval_id), src_text))::INT AS input_chars
  FROM evs e JOIN segs s ON e.id = s.id WHERE hyp_text IS NOT NULL AND src_text IS NOT NULL""",
        "alias_resolve": f"SELECT {_language('src_lang')} AS src_lang, {_language('tgt_lang')} AS tgt_lang, {_domain('domain')} AS domain, count(*)::BIGINT AS n FROM segments GROUP BY ALL",
        "parrot_filter": _reports_of("de", ("german", "deutsch", "de")) + " UNION ALL " + _reports_of("tr", ("turkish", "türkçe", "turkce", "tr")),
        "area_fold": f"SELECT {_area('area')} AS area, count(*)::BIGINT AS n FROM parrot_raw GROUP BY ALL",
        "sgml_segment_parse": f"SELECT suite, item_id, {_collapse('text')} AS text FROM eval_items",
        "strip_thinking": f"WITH {_EVALS} SELECT eval_id, length({_strip('hyp_text')})::INT AS n_chars FROM evs WHERE hyp_text IS NOT NULL",
        "same_model": "SELECT DISTINCT model, regexp_replace(lower(model), '-v?[0-9]+$', '') AS leaf, 1 AS snapshot, 0 AS other FROM evaluations",
        "batch_parse": f"""WITH {_EVALS}, t AS (SELECT id, list(coalesce(hyp_text, '') ORDER BY eval_id) AS l FROM evs GROUP BY id)
  SELECT id, len(l)::INT AS n, CASE WHEN len(list_filter(l, lambda x: {_strip('x')} = '')) = 0 THEN length(array_to_string(list_transform(l, lambda x: {_strip('x')}), '|'))::INT END AS parsed_chars FROM t""",
        "text_prompts": _prompt(),
        "resume_rest": f"WITH {_EVALS} SELECT DISTINCT model, domain FROM evs WHERE NOT model < 'g'",
        "white_space": f"SELECT doc_id, length({_strip('text')})::INT AS stripped, length({_collapse('text')})::INT AS collapsed FROM documents WHERE text IS NOT NULL",
    }
