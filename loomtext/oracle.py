"""DuckDB SQL of the library's queries, from the raw tables."""

from __future__ import annotations

from loomtext.functions.text import WS
from loomtext.operators.parse import HEADING, LIST_ITEM, QUOTE, STRUCTURE, TABLE
from loomtext.plans.profiles import CATEGORIES, LATIN, SEMANTIC_JUMP_MIN, SEMANTIC_RANGE, SEMANTIC_REPETITION_MAX


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(map(_q, xs)) + "]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, {_q(f'^[{WS}]+|[{WS}]+$')}, '', 'g')"


D = f"[{LATIN.delimiters}]"
LINES = f"""lines as (
  select doc_id, line, raw, case when regexp_matches(raw, {_q(STRUCTURE)}) then '' else raw end as masked from (
    select doc_id, unnest(generate_series(1, len(l)))::int as line, unnest(l) as raw
    from (select doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) as l from documents where text <> '')))"""
COMMENT = r"(?s)<!(?:-->|--->|--.*?(?:-->|\z))"
SENT = LINES + f""", sent as (
  select doc_id, line, text, row_number() over (partition by doc_id order by line, pos)::int as sent_no from (
    select doc_id, line, pos, {_strip('p')} as text from (
      select doc_id, line, unnest(generate_series(1, len(ps))) as pos, unnest(ps) as p from (select doc_id, line, string_split_regex(masked, {_q(D)}) as ps from lines)))
  where text <> '')"""
# the tables have no blank lines, so paragraph queries see each line feed doubled
PARA = LINES.replace("regexp_replace(text,", "regexp_replace(replace(text, chr(10), chr(10) || chr(10)),") + f""", marked as (
  select *, sum((not regexp_matches(masked, {_q(f'[^{WS}]')}))::int) over (partition by doc_id order by line) as g, not regexp_matches(masked, {_q(f'[^{WS}]')}) as blank from lines
), para as (
  select doc_id, g, min(line) as first_line, string_agg(masked, chr(10) order by line) as text, arg_min(masked, line) as lead, arg_min(raw, line) as raw
  from marked where not blank group by doc_id, g
)"""
PIECES = f"len(list_filter(string_split_regex(text, {_q(D[:-1] + chr(92) + 'n]')}), lambda p: regexp_matches(p, {_q(f'[^{WS}]')})))"
FORBIDDEN = f"""hits as (
  select doc_id, line, raw, p, list_position({_list(LATIN.forbidden)}, p) as seq, position(p in masked) as here, length(p) as k
  from lines, (select unnest({_list(LATIN.forbidden)}) as p) where position(p in masked) > 0
), found as (
  select doc_id, line, seq, {_strip('substr(raw, greatest(here - 11, 0)::int + 1, (greatest(0, least(here - 1 + k + 10, length(raw)) - greatest(here - 11, 0)))::int)')} as excerpt,
    case when p in ({', '.join(map(_q, LATIN.weak))}) then 'info' else 'warn' end as severity, p from hits
)"""


def _related(ls: str) -> str:
    return f"'対応箇所: ' || array_to_string(list_transform({ls}[1:20], lambda x: 'L' || x), ', ') || case when len({ls}) > 20 then ' ほか' || (len({ls}) - 20) || '箇所' else '' end"


def _count(patterns) -> str:
    return " + ".join(f"len(regexp_extract_all(masked, {_q(p)}))" for p in patterns)


def _per_line(category: str, patterns) -> str:
    return f"with {LINES} select doc_id, line, '{category}' as category, ({_count(patterns)})::bigint as n from lines where {_count(patterns)} > 0"


TOKEN, CONTENT, P = LATIN.token, LATIN.content, LATIN.params
WORD = "^[A-Za-zÀ-ɏ0-9]"
# tokens of each sentence from the first that is no symbol
FROM_WORD = f"""{SENT}, toks as (select doc_id, sent_no, line, regexp_extract_all(text, {_q(TOKEN)}) as t from sent),
words as (select doc_id, sent_no, line, t[k:len(t)] as t from (select *, list_position(list_transform(t, lambda x: regexp_matches(x, {_q(WORD)})), true) as k from toks) where k > 0)"""
STATS = f"select doc_id, count(*) as n, sum(x)::bigint as s1, sum(x * x)::bigint as s2 from xs group by doc_id"
CV = f"""{SENT}, xs as (select doc_id, length(text)::bigint as x from sent), st as ({STATS}),
cvs as (select doc_id, n, (sqrt((n * s2 - s1 * s1)::double) / n) / (s1::double / n) as cv, s1 from st where n >= 5)"""
RHYTHM = f"""{SENT}, xs as (select doc_id, sent_no, length(regexp_replace(text, '[ \\t\\n\\r]', '', 'g'))::bigint as x from sent), st as ({STATS}),
ab as (select doc_id, x as a, lead(x) over (partition by doc_id order by sent_no) as b from xs),
pr as (select doc_id, count(*) as k, sum(a * b)::bigint as c, sum(a)::bigint as a1, sum(b)::bigint as b1, sum(a * a)::bigint as a2, sum(b * b)::bigint as b2 from ab where b is not null group by doc_id),
v as (select *, s1::double / n as mean, sqrt((n * s2 - s1 * s1)::double) / n as stdev, sqrt((k * a2 - a1 * a1)::double) / k as sa, sqrt((k * b2 - b1 * b1)::double) / k as sb from st join pr using (doc_id) where n >= {P.burst_sentences}),
rhythm as (
select doc_id, n, mean, stdev, case when stdev + mean = 0 then 0.0 else (stdev - mean) / (stdev + mean) end as burstiness,
  case when k >= {P.autocorr_pairs} and sa > 0 and sb > 0 then ((k * c - a1 * b1)::double / (k * k)::double) / (sa * sb) end as autocorr from v
)"""
LEADS = f"""{PARA}, tested as (
  select *, {_strip('lead')} as t, count(*) over (partition by doc_id) as n from para
), led as (
  select *, count(*) over (partition by doc_id) as hits from tested where {' or '.join(f'starts_with(t, {_q(c)})' for c in LATIN.conjunctions)}
), leads as (select * from led where n >= {P.lead_paragraphs} and hits / n >= {P.lead_ratio})"""
SIDES = "sides as (select l.doc_id, case when quality = 1 then 'human' else 'ai' end as side, length(d.text) as chars from labels l join documents d using (doc_id))"
SWEEP = f"""with {CV}, {SIDES}, grid as (select round(0.05::double + i * 0.02::double, 6)::double as value from range(0, 28) t(i)),
curve as (select value, count(*) filter (side = 'human' and cv < value) as human_fp_count, count(*) filter (side = 'human' and cv < value) / count(*) filter (side = 'human') as human_fp_rate,
  count(*) filter (side = 'ai' and cv < value) as ai_detect_count, count(*) filter (side = 'ai' and cv < value) / count(*) filter (side = 'ai') as ai_detect_rate
  from sides left join cvs using (doc_id), grid group by value)"""

PAIRS = """v as (select label as doc_id, row_number() over (partition by label order by vec_id) as i, embedding::double[] as e from embeddings),
u as (select doc_id, i, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as u from v), n as (select doc_id, count(*) as n from u group by doc_id),
p as (select a.doc_id, a.i, b.i as j, list_dot_product(a.u, b.u) as s from u a join u b on a.doc_id = b.doc_id and b.i > a.i)"""
LINES_OF_SENT = f"with {SENT} select doc_id, line from sent"
DIVERSITY = f"""with {SENT}, w as (select doc_id, sum(length(text))::bigint as chars, flatten(list(list_transform(list_filter(regexp_extract_all(text, {_q(TOKEN)}), lambda x: regexp_matches(x, {_q(CONTENT)})), lambda x: lower(x)))) as t from sent group by doc_id),
e as (select doc_id, 0::bigint as chars, []::varchar[] as t from documents where text is not null and doc_id not in (select doc_id from sent)), a as (select * from w union all select * from e)
select doc_id, chars, len(t)::bigint as tokens, len(list_distinct(t))::bigint as types, case when chars >= {P.diversity_chars} and len(t) >= {P.diversity_tokens} then len(list_distinct(t)) / len(t) end as ttr from a"""
SPECIFICITY = f"""with {PARA}, w as (select doc_id, first_line as line, text, raw, list_filter(regexp_extract_all(text, {_q(TOKEN)}), lambda x: regexp_matches(x, {_q(CONTENT)})) as t from para),
c as (select doc_id, line, len(t)::int as words, len(list_filter(t, lambda x: regexp_matches(x, '^[A-Z][A-Za-z0-9]+$')))::int as proper, len(regexp_extract_all(text, {_q(LATIN.quantity)}))::int as "numeric",
  regexp_matches(text, {_q('|'.join(LATIN.examples))})::int as example, len(list_filter(t, lambda x: list_contains({_list(LATIN.abstract)}, x)))::int as abstract, length(text) as k, raw from w)
select doc_id, line, words, proper, "numeric", example, abstract, proper / words * 1.0::double + "numeric" / words * 1.0::double + example * 0.1::double - abstract / words * 1.5::double as score, raw from c where k >= {P.specificity_chars} and words >= {P.specificity_words}"""

# one direction of the diversity measure: a fold whose state is the run at hand
RUN = "struct_pack(f := {0}, n := {1}, seen := {2})"


def _factors(words: str) -> str:
    full = "(len(case when list_contains(a.seen, x) then a.seen else list_append(a.seen, x) end) / (a.n + 1) <= 0.72)"
    seen = "case when list_contains(a.seen, x) then a.seen else list_append(a.seen, x) end"
    step = RUN.format(f"a.f + {full}::int", f"case when {full} then 0 else a.n + 1 end", f"case when {full} then []::varchar[] else {seen} end")
    start = RUN.format("0::int", "0::int", "[]::varchar[]")
    return f"list_reduce(list_transform({words}, lambda x: struct_pack(f := 0::int, n := 0::int, seen := [x])), lambda a, y: {step.replace('x)', 'y.seen[1])')}, {start})"


def _one_way(a: str) -> str:
    rest = f"case when {a}.n > 0 then (1 - len({a}.seen) / {a}.n) / (1 - 0.72::double) else 0 end"
    return f"case when {a}.f + {rest} > 0 then len(t) / ({a}.f + {rest}) else len(t)::double end"


SQL = {
    "lines": f"with {LINES} select doc_id, line, masked, raw from lines",
    "sentences": f"with {SENT} select doc_id, sent_no, line, text from sent",
    "paragraphs": f"with {PARA} select doc_id, row_number() over (partition by doc_id order by first_line)::int as para_no, first_line, text, {PIECES}::int as sentences from para",
    "mask_comments": r"""
with m as (select page_id, regexp_extract_all(html, '(?s)<!(?:-->|--->|--.*?(?:-->|\z))') as ms, string_split_regex(html, '(?s)<!(?:-->|--->|--.*?(?:-->|\z))') as gs from pages)
select page_id, array_to_string(list_transform(generate_series(1, len(gs)), lambda i: gs[i] || case when i <= len(ms) then regexp_replace(ms[i], '[^\n]', ' ', 'g') else '' end), '') as masked from m""",
    "token_table": f"with {SENT} select doc_id, sent_no, unnest(generate_series(0, len(t) - 1))::int as pos_no, unnest(t) as token from (select doc_id, sent_no, regexp_extract_all(text, {_q(TOKEN)}) as t from sent)",
    "forbidden_phrase": f"with {LINES}, {FORBIDDEN} select doc_id, line, 'forbidden_phrase' as category, excerpt, severity from found",
    "findings_by_category": f"with {LINES}, {FORBIDDEN} select 'forbidden_phrase' as category, severity, count(*) as n from found group by severity",
    "translationese": _per_line("translationese", LATIN.translationese),
    "inanimate_subject": _per_line("english_syntax_inanimate_subject", LATIN.inanimate),
    "antithesis_repetition": f"""with {SENT}, h as (select doc_id, sum({_count(LATIN.antithesis)})::bigint as n from lines group by doc_id), s as (select doc_id, count(*) as k from sent group by doc_id)
select doc_id, case when n / k < {P.antithesis_info_below} then 'info' when n / k >= {P.antithesis_critical_from} then 'critical' else 'warn' end as severity, n from h join s using (doc_id) where n >= {P.antithesis_hits}""",
    "cleft_pairs": f"""with {SENT}, p as (select *, lead(text) over (partition by doc_id order by sent_no) as b from sent)
select doc_id, line, text || '。' || b as excerpt from p where regexp_matches(text, {_q(LATIN.cleft[0])}) and regexp_matches(b, {_q(LATIN.cleft[1])})""",
    "paragraph_lead": f"with {LEADS} select doc_id, first_line as line, substr(raw, 1, 40) as excerpt from leads",
    "related_lines": f"with {LEADS} select doc_id, array_to_string(list_sort(list(first_line))[1:20], ',') as related from leads group by doc_id",
    "sentence_variance_stats": f"with {CV} select doc_id, n as sentences, cv from cvs",
    "low_sentence_variance": f"""with {CV}, f as (select doc_id, min(line) as line from sent group by doc_id)
select doc_id, line, '文数=' || n || ', 平均文長=' || printf('%.1f', s1::double / n) || '字, 変動係数=' || printf('%.3f', cv) as excerpt from cvs join f using (doc_id) where cv < 0.4""",
    "uniform_paragraph": f"""with {PARA}, xs as (select doc_id, {PIECES}::bigint as x, first_line from para), st as (select doc_id, count(*) as n, sum(x)::bigint as s1, sum(x * x)::bigint as s2, list(x order by first_line) as l from xs group by doc_id)
select doc_id, 1 as line, '段落数=' || n || ', 各段落の文数=[' || array_to_string(l, ', ') || ']' as excerpt from st
where n >= {P.uniform_paragraphs} and case when s1 = 0 then 0 else (sqrt((n * s2 - s1 * s1)::double) / n) / (s1::double / n) end < 0.5""",
    "structure_stats": f"""with b as (select doc_id, text, greatest(length(text), 1) as k, list_filter(string_split(regexp_replace(text, '\\n$', ''), chr(10)), lambda x: regexp_matches(x, {_q(f'[^{WS}]')})) as l from documents)
select doc_id, length(text)::int as chars, len(regexp_extract_all(text, '\\*\\*[^*\\n]+\\*\\*'))::int as bold_spans, len(regexp_extract_all(text, '\\*\\*[^*\\n]+\\*\\*')) / k * 1000 as bold_per_1000,
  len(list_filter(l, lambda x: regexp_matches(x, {_q(LIST_ITEM)})))::int as bullet_lines, len(l)::int as nonblank_lines, 0 as boilerplate_headings,
  len(regexp_extract_all(text, {_q(LATIN.phase)}))::int as phases, len(regexp_extract_all(text, {_q(LATIN.emoji)}))::int as symbols, len(regexp_extract_all(text, {_q(LATIN.emoji)})) / k * 1000 as symbols_per_1000 from b""",
    "bold_density": r"""with b as (select doc_id, text, len(regexp_extract_all(text, '\*\*[^*\n]+\*\*')) as n, greatest(length(text), 1) as k, string_split_regex(text, '\*\*[^*\n]+\*\*')[1] as before from documents)
select doc_id, (length(before) - length(replace(before, chr(10), '')) + 1)::int as line, '太字スパン' || n || '箇所（1000字あたり' || printf('%.2f', n / k * 1000) || '）' as excerpt from b where n >= 3 and n / k * 1000 >= 3.0""",
    "burstiness": f"with {RHYTHM} select * from rhythm",
    "rhythm_findings": f"""with {RHYTHM}, f as (select r.*, (select min(line) from sent where sent.doc_id = r.doc_id) as line from rhythm r)
select doc_id, line, 'low_burstiness' as category, 'burstiness=' || printf('%.3f', burstiness) || ' (モーラ近似長 平均=' || printf('%.1f', mean) || ', 標準偏差=' || printf('%.1f', stdev) || ')' as excerpt, 'warn' as severity from f where burstiness < -0.4
union all select doc_id, line, 'high_length_autocorrelation', 'lag-1 自己相関=' || printf('%.3f', autocorr), 'info' from f where autocorr > 0.2""",
    "repeated_lead": f"""with {FROM_WORD}, l as (select doc_id, line, t[1] || t[2] as lead, regexp_matches(t[1], '^[A-Za-z][A-Za-z0-9_.-]*$') as tech from words where len(t) >= 2),
g as (select doc_id, lead, count(*) as n, list_sort(list_distinct(list(line))) as ls from l group by doc_id, lead having count(*) >= {P.repeated_lead})
select doc_id, '文頭2形態素「' || lead || '」が' || g.n || '回反復（閾値{P.repeated_lead}回以上）。' || case when tech then '固有名詞/技術用語由来の可能性が高い。' else '人間の意図的な反復技法との区別がつかないため参考情報として提示。' end || {_related('ls')} as detail,
  count(*) as n, min(line) as first_line from l join g using (doc_id, lead) group by doc_id, 2""",
    "syntax_template": f"""with {FROM_WORD}, p as (
  select doc_id, sent_no, line, array_to_string(list_transform(t[1:4], lambda x: case when regexp_matches(x, {_q(CONTENT)}) then '名詞' when regexp_matches(x, '^[0-9]') then '数詞' else '補助記号' end), '/') as g from words where len(t) >= 4),
c as (select doc_id, g, count(*) as n, min(sent_no) as first, list_sort(list_distinct(list(line))) as ls from p group by doc_id, g),
top as (select *, sum(n) over (partition by doc_id) as k, row_number() over (partition by doc_id order by n desc, first) as r from c)
select doc_id, line, '文頭品詞4-gram「' || g || '」が全文の' || printf('%.1f%%', n / k * 100) || 'で一致（閾値40%以上）。構文テンプレートの使い回しの疑い。' || {_related('ls')} as detail
from p join top using (doc_id, g) where r = 1 and k >= {P.template_grams} and n / k >= 0.4""",
    "lexical_diversity": DIVERSITY,
    "low_ttr": f"""select doc_id, (select min(line) from ({LINES_OF_SENT}) x where x.doc_id = d.doc_id) as line, 'TTR=' || printf('%.3f', ttr) || ' (内容語 ' || tokens || ' 語中 ' || types || ' 種類)' as excerpt from ({DIVERSITY}) d where ttr < {P.ttr}""",
    "nominal_ratio": f"""with {SENT}, w as (select doc_id, list_filter(regexp_extract_all(text, {_q(TOKEN)}), lambda x: regexp_matches(x, {_q(WORD)})) as t from sent)
select d.doc_id, count(w.doc_id) as sentences, count(*) filter (w.doc_id is not null and len(t) > 0 and regexp_matches(t[-1], {_q(CONTENT)})) as nominal from documents d left join w using (doc_id) where d.text is not null group by d.doc_id""",
    "specificity": f"select * exclude (raw) from ({SPECIFICITY})",
    "low_specificity": f"""select doc_id, line, substr({_strip('raw')}, 1, 40) as excerpt, '段落の具体性スコア=' || printf('%.3f', score) || '（閾値0.02未満）。固有名詞密度=' || printf('%.3f', proper / words) || ', 数値密度=' || printf('%.3f', "numeric" / words) || ', 抽象名詞率=' || printf('%.3f', abstract / words)
  || ', 例示マーカー=' || case when example = 1 then 'あり' else 'なし' end || '。固有名詞・数値・実例が乏しく一般論に留まっている疑い。素材不足のサインであり、文体の修正でなく情報収集を検討する' as detail from ({SPECIFICITY}) where score < 0.02""",
    "sentence_too_long": f"""with {SENT} select doc_id, line, 'sentence_too_long' as category, count(*) as n from sent where length({_strip(f"regexp_replace(text, {_q(f'[{WS}]{{2,}}')}, ' ', 'g')")}) > {P.long_sentence} group by doc_id, line""",
    "long_run": f"""with {SENT}, t as (select doc_id, line, unnest(regexp_extract_all(text, {_q(TOKEN)})) as w from sent)
select doc_id, line, 'long_run' as category, sum(len(regexp_extract_all(w, '[a-z]{{14,}}')))::bigint as n from t where not regexp_matches(w, '^[A-Z][A-Za-z0-9]+$') and regexp_matches(w, '[a-z]{{14,}}') group by doc_id, line""",
    "baseline_diff": f"""with {LINES}, {FORBIDDEN}, keyed as (select *, 'forbidden_phrase' || chr(1) || substr(regexp_replace(excerpt, {_q(f'[{WS}]')}, '', 'g'), 1, 20) as key from found),
a as (select doc_id, key, row_number() over (partition by doc_id, key order by line, seq) as n from keyed), b as (select doc_id, key, row_number() over (partition by doc_id, key order by line, seq) as n from keyed where seq <= 3)
select coalesce(a.doc_id, b.doc_id) as doc_id, case when a.n is null then 'resolved' when b.n is null then 'new' else 'persisting' end as status, count(*) as n
from a full join b on a.doc_id = b.doc_id and a.key = b.key and a.n = b.n group by 1, 2""",
    "heading_stats": f"""with {LINES}, h as (select doc_id, (line % 3 + 1)::int as level, length(masked)::bigint as k, masked from lines where masked <> ''),
g as (select doc_id, level, k, masked from h union all select doc_id, null, k, masked from h),
st as (select doc_id, level, count(*) as n, sum(k)::bigint as s1, sum(k * k)::bigint as s2, count(*) filter (regexp_matches(masked, {_q(f'^[{WS}]*(?:[0-9０-９]+[.).、]|[①-⑳])[{WS}]*[^{WS}]')}) or regexp_matches(masked, {_q(f'^[{WS}]*[【{chr(92)}[［(（].+[】{chr(92)}]］)）][{WS}]*$')}) or regexp_matches(masked, {_q(f'^.+とは[?？]?[{WS}]*$')})) as st from g group by doc_id, level)
select doc_id, level, n as count, printf('%.2f', s1::double / n)::double as length_mean, printf('%.3f', case when s1 > 0 and n > 1 then sqrt((n * s2 - s1 * s1)::double) / n / (s1::double / n) else 0 end)::double as length_cv, printf('%.3f', st::double / n)::double as structural_ratio from st""",
    "terms": f"""with {LINES}, t as (select doc_id, line, unnest(regexp_extract_all(masked, '[A-Za-z0-9]+')) as term from lines), f as (select doc_id, term, min(line) as first_line from t where regexp_matches(term, '^[A-Z][A-Za-z0-9]+$') group by doc_id, term)
select f.doc_id, term, first_line, ((length(text) - length(replace(text, term, ''))) // length(term))::bigint as count from f join documents using (doc_id)""",
    "semantic_metrics": f"""with {PAIRS}
select n.doc_id, n.n, printf('%.6f', max(s) filter (j = i + 1) - min(s) filter (j = i + 1))::double as adjacent_range, printf('%.6f', min(s) filter (j = i + 1))::double as adjacent_min, printf('%.6f', max(s) filter (j >= i + 2))::double as other_max
from n join p using (doc_id) where n.n >= 3 group by n.doc_id, n.n""",
    "semantic_findings": f"""with {PAIRS}, m as (select n.doc_id, n.n, max(s) filter (j = i + 1) - min(s) filter (j = i + 1) as spread, min(s) filter (j = i + 1) as low, max(s) filter (j >= i + 2) as far from n join p using (doc_id) where n.n >= 10 group by n.doc_id, n.n)
select doc_id, 'semantic_flatness' as category, 'warn' as severity from m where spread <= {SEMANTIC_RANGE[None]}
union all select doc_id, 'semantic_repetition_max', 'info' from m where far <= {SEMANTIC_REPETITION_MAX} union all select doc_id, 'semantic_jump_min', 'info' from m where low >= {SEMANTIC_JUMP_MIN}""",
    "genre_filter": f"""with b as (select doc_id, text, len(regexp_extract_all(text, {_q(LATIN.emoji)})) as n, greatest(length(text), 1) as k, string_split_regex(text, {_q(LATIN.emoji)})[1] as before from documents)
select doc_id, (length(before) - length(replace(before, chr(10), '')) + 1)::int as line, 'high_emoji_symbol_density' as category from b where n >= 3 and n / k * 1000 >= 2.0""",
    "fire_matrix": f"""with {LINES}, {SIDES}, f as (select doc_id, 'forbidden_phrase' as category, sum({' + '.join(f'(position({_q(p)} in masked) > 0)::int' for p in LATIN.forbidden)}) as hits from lines group by doc_id
  union all select doc_id, 'translationese', sum({_count(LATIN.translationese)}) from lines group by doc_id), c as (select unnest({_list(CATEGORIES)}) as category)
select c.category, side as grp, count(*) as docs, count(*) filter (hits > 0) as fired, count(*) filter (hits > 0) / count(*) as fire_rate, (coalesce(sum(hits), 0) * 1000)::double / sum(chars)::double as per_1000
from sides cross join c left join f on f.doc_id = sides.doc_id and f.category = c.category group by c.category, side""",
    "length_bins": f"""with {LINES}, {FORBIDDEN}, {SIDES} select case when chars >= 4000 then 3 when chars >= 2000 then 2 when chars >= 1000 then 1 else 0 end as bin, side, count(*) as total,
count(*) filter (doc_id in (select doc_id from found)) as fired from sides group by 1, 2""",
    "sweep_curve": SWEEP + " select * from curve",
    "sweep_recommend": SWEEP + " select * from curve where human_fp_rate < 0.5 order by ai_detect_rate desc, value limit 1",
    "naturalness_score": f"""with {LINES}, {FORBIDDEN}, l as (select doc_id, sum(case severity when 'critical' then 8.0::double when 'warn' then 4.0::double else 0.5::double end) as w from found group by doc_id),
s as (select d.doc_id, length(text) as chars, case when length(text) >= 100 then greatest(20.0::double, 100 - coalesce(w, 0) * 1000 / greatest(length(text), 1000)) end as score from documents d left join l using (doc_id))
select doc_id, chars, score, case when score >= 90 then 'A' when score >= 70 then 'B' when score >= 50 then 'C' when score is not null then 'D' end as band from s""",
    "mtld": f"""select doc_id, ({_one_way('a')} + {_one_way('b')}) / 2 as mtld from (
  select doc_id, t, {_factors('t')} as a, {_factors('list_reverse(t)')} as b from ({DIVERSITY.replace('select doc_id, chars,', 'select doc_id, t, chars,')}) where ttr is not null and tokens >= 20)""",
    "no_chain": f"""with {SENT}, w as (select doc_id, sent_no, line, regexp_extract_all(text, {_q(TOKEN)}) as t from sent),
h as (select doc_id, sent_no, line, t, unnest(list_filter(generate_series(1, len(t)), lambda i: t[i] = 'the')) as a from w),
c as (select *, lead(a) over s as b, lead(a, 2) over s as c from h window s as (partition by doc_id, sent_no order by a)),
f as (select *, row_number() over (partition by doc_id, sent_no order by a) as r from c
  where b - a <= 3 and c - b <= 3 and len(list_filter(t[a:c], lambda x: not regexp_matches(x, {_q(WORD)}))) = 0)
select doc_id, line, array_to_string(t[a:c], '') as excerpt from f where r = 1""",
    # these tables have no code fences and no front matter
    "mask_structure": f"""with m as (select page_id, regexp_extract_all(html, {_q(COMMENT)}) as ms, string_split_regex(html, {_q(COMMENT)}) as gs from pages where html <> ''),
k as (select page_id, array_to_string(list_transform(generate_series(1, len(gs)), lambda i: gs[i] || case when i <= len(ms) then regexp_replace(ms[i], '[^\\n]', ' ', 'g') else '' end), '') as x from m),
l as (select page_id, unnest(generate_series(1, len(l)))::int as line, unnest(l) as x from (select page_id, string_split(regexp_replace(x, '\\n$', ''), chr(10)) as l from k))
select page_id, line, case when regexp_matches(x, {_q(STRUCTURE)}) then '' else x end as masked from l""",
    "outline": f"""with r as (
  select doc_id, unnest(generate_series(1, len(l)))::int as line, unnest(l) as x from (select doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) as l from documents where text <> '')
), k as (
  select *, case when not regexp_matches(x, {_q(f'[^{WS}]')}) then 'blank' when regexp_matches(x, {_q(HEADING)}) then 'heading' when regexp_matches(x, {_q(LIST_ITEM)}) then 'bullets'
    when regexp_matches(x, {_q(QUOTE)}) then 'quote' when regexp_matches(x, {_q(TABLE)}) then 'table' when regexp_matches(x, {_q(f'^[{WS}]')}) then 'indented' else 'lead' end as own from r
), e as (
  select *, case when own <> 'indented' then own when last_value(nullif(own, 'indented') ignore nulls) over (partition by doc_id order by line) = 'bullets' then 'bullets' else 'lead' end as kind from k
), g as (
  select *, sum(turn::int) over (partition by doc_id order by line) as block from (select *, kind is distinct from lag(kind) over (partition by doc_id order by line) or kind = 'heading' as turn from e)
), b as (select doc_id, min(line) as line, kind, arg_min(x, line) as x, count(*) filter (own = 'bullets') as items from g group by doc_id, block, kind
), o as (
  select doc_id, line, kind, case kind when 'bullets' then '(箇条書き ' || items || ' 項目)' when 'lead' then {_strip(f"regexp_extract(x, {_q(f'^([^{LATIN.delimiters}]*[{LATIN.delimiters}]?)')})")}
    else {_strip(f"regexp_replace(regexp_replace(x, {_q(f'^[{WS}]*#{{1,6}}')}, ''), {_q(f'(^|[{WS}]+)#+[{WS}]*$')}, '')")} end as text from b where kind in ('bullets', 'lead', 'heading')
)
select doc_id, line, kind, text from o where text <> '' or kind = 'heading'""",
}
