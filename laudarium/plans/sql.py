"""SQL for DuckDB, written by itself, of the queries that SQL can express."""

from __future__ import annotations

from ..functions import patterns

_TOKENS = """
with tokens as (select distinct section_id, book_title, par_n, tok_n, form, lemma, interp, proper_name, unknown_form, latin, corrected from parsed_tokens),
books as (select distinct book_title, palatinate, convent_location from editions),
placed as (
  select t.*, unnest(['ALL', 'book_title__' || coalesce(t.book_title, 'None'), 'convent_location__' || coalesce(convent_location, 'None'), 'palatinate__' || coalesce(palatinate, 'None')]) as subset
  from tokens t left join books b on t.book_title = b.book_title),
body as (select * from placed where par_n > 1),
plain as (select * from body where not coalesce(list_contains(interp, 'brev'), false)),
corpus as (select * from tokens where par_n > 1 and not coalesce(list_contains(interp, 'brev'), false)),
whole as (select *, array_to_string(interp, ':') as tags from tokens where par_n > 1)
"""

_PARAGRAPHS = """
with stored as (
  select distinct section_id, par_n, book_title, inbook_section_id, inbook_document_id, scan_page, section_type, section_date, palatinate, convent_location, created_location, author, paragraph, pertinence from edition_rows),
parts as (select *, string_split(substr(section_date, 2, greatest(length(section_date) - 2, 0)), ',') as ymd from stored),
paragraphs as (
  select * exclude (ymd), case when len(ymd) = 3 then try_cast(printf('%04d-%02d-%02d', try_cast(trim(ymd[3]) as int), try_cast(trim(ymd[2]) as int), try_cast(trim(ymd[1]) as int)) as date) end as date from parts),
firsts as (select *, row_number() over (partition by section_id order by par_n) as k from paragraphs),
sections as (
  select f.section_id, f.book_title, f.section_type, f.date, f.palatinate, f.convent_location, f.author, f.pertinence, n_paragraphs, text_length
  from firsts f join (select section_id, count(*) as n_paragraphs, sum(length(coalesce(paragraph, ''))) + 2 * (count(*) - 1) as text_length from paragraphs group by section_id) s on f.section_id = s.section_id
  where k = 1),
documents_only as (select * from sections where section_type = 'document' and pertinence = 'True')
"""

_WORDS = (
    _PARAGRAPHS
    + r""",
words as (
  select section_id, date, lower(regexp_replace(word, '^[.,;:!?()]+|[.,;:!?()]+$', '', 'g')) as lemma
  from (select section_id, date, unnest(regexp_split_to_array(paragraph, '[\s\x{00a0}]')) as word from paragraphs where section_type = 'document' and pertinence = 'True' and par_n > 1 and date is not null)),
said as (select * from words where lemma <> '')
"""
)


def _counted(source: str, keys: str) -> str:
    return f"""{_TOKENS},
counts as (select subset, {keys}, count(*) as n, min({{'a': section_id, 'b': par_n, 'c': tok_n}}) as place from {source} group by all)
select subset, {keys}, n, round(n / sum(n) over (partition by subset), 9) as ratio, place.a as first_section, place.b as first_par, place.c as first_tok from counts"""


_GROUPS = """
listed as (
  select keyword_category, group_n, list(lemma order by lemma_n, lemma) as lemmas from keyword_lemmas where lemma is not null group by keyword_category, group_n),
groups as (
  select keyword_category, group_n, lemmas[1] as first_lemma, '__' || array_to_string(lemmas[1:3], '-') || case when len(lemmas) > 3 then '-...' else '' end as placeholder from listed)
"""


def _marked(source: str) -> str:
    return f""",
{_GROUPS},
first as (select lemma, min(group_n) as group_n from keyword_lemmas where keyword_category = 'money' and lemma is not null group by lemma),
marks as (select lemma, placeholder from first join groups on groups.group_n = first.group_n and keyword_category = 'money'),
marked as (
  select section_id, par_n, tok_n, coalesce(m.placeholder, s.form) as form, coalesce(m.placeholder, s.lemma) as lemma, array_to_string(interp, ':') as tags
  from {source} s left join marks m on m.lemma = s.lemma)
"""


def _grams(source: str, fields: list[str], size: int, keyed: bool = False, within: bool = False) -> str:
    """The collocations of a source by a window over all of it."""
    word = "struct_pack(" + ", ".join(f"{f} := coalesce({f}, '')" for f in fields) + ")"
    over = f"({'partition by section_id, par_n ' if within else ''}order by section_id, par_n, tok_n, {', '.join(fields)})"
    names = [f"w{k + 1}" for k in range(size)]
    leads = "".join(f", lead(w1, {k}) over (order by section_id, par_n, tok_n, w1) as w{k + 1}" if not within else f", lead(w1, {k}) over (partition by section_id, par_n order by tok_n, w1) as w{k + 1}" for k in range(1, size))
    head = f""",
seq as (select section_id, par_n, tok_n, {word} as w1 from {source}),
grams as (select w1{leads} from seq),
single as (select w1 as w, count(*)::double as n from seq group by w1),
every as (select count(*)::double as t from seq),
counted as (select {", ".join(names)}, count(*) as n from grams where {names[-1]} is not null group by {", ".join(names)}),
kept as (select * from counted where n >= 2 and {" and ".join(f"length({w}.{fields[0]}) >= 2" for w in names)}{" and (" + " or ".join(f"starts_with({w}.{'lemma'}, '__')" for w in names) + ")" if keyed else ""})
"""
    out = ", ".join(f"{w}.{f} as {w}_{f}" for w in names for f in fields)
    xlogx = lambda o, e: f"case when ({o}) > 0 then ({o}) * ln(({o}) / ({e})) else 0 end"
    if size == 2:
        return head + f""",
cells as (select k.*, k.n::double as a, s2.n - k.n as b, s1.n - k.n as c, t - s1.n - s2.n + k.n as d, s1.n as n1, s2.n as n2, t from kept k join single s1 on s1.w = w1 join single s2 on s2.w = w2, every)
select {out}, n, round(a / (a + b + c), 6) as jaccard,
  round(2 * ({xlogx("a", "n1 * n2 / t")} + {xlogx("b", "(t - n1) * n2 / t")} + {xlogx("c", "n1 * (t - n2) / t")} + {xlogx("d", "(t - n1) * (t - n2) / t")}), 4) as likelihood_ratio
from cells"""
    pair = f"select w1, {'lead(w1) over (partition by section_id, par_n order by tok_n, w1)' if within else 'lead(w1) over (order by section_id, par_n, tok_n, w1)'} as w2 from seq"
    margin = {1: "n{k}", 0: "(t - n{k})"}
    bits = [(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]
    llr = " + ".join(xlogx(f"c{i}{j}{k}", " * ".join(margin[b].format(k=n) for n, b in ((1, i), (2, j), (3, k))) + " / (t * t)") for i, j, k in bits)
    return head + f""",
pairs as (select w1, w2, count(*)::double as n from ({pair}) where w2 is not null group by w1, w2),
gaps as (select w1, w3, count(*)::double as n from grams where w3 is not null group by w1, w3),
joined as (
  select k.w1, k.w2, k.w3, k.n, k.n::double as c111, p23.n - k.n as c011, g.n - k.n as c101, p12.n - k.n as c110, s1.n as n1, s2.n as n2, s3.n as n3, t
  from kept k join single s1 on s1.w = k.w1 join single s2 on s2.w = k.w2 join single s3 on s3.w = k.w3
  join pairs p12 on p12.w1 = k.w1 and p12.w2 = k.w2 join pairs p23 on p23.w1 = k.w2 and p23.w2 = k.w3 join gaps g on g.w1 = k.w1 and g.w3 = k.w3, every),
more as (select *, n1 - c111 - c101 - c110 as c100, n2 - c111 - c011 - c110 as c010, n3 - c111 - c011 - c101 as c001 from joined),
cells as (select *, c111 + c011 + c101 + c110 + c100 + c010 + c001 as held, t - (c111 + c011 + c101 + c110 + c100 + c010 + c001) as c000 from more)
select {out}, n, round(c111 / held, 6) as jaccard, round(2 * ({llr}), 4) as likelihood_ratio from cells"""


def _marked_all(source: str) -> str:
    """The tokens of a source once for every category, with its placeholders."""
    return f""",
{_GROUPS},
categories as (select distinct keyword_category from keyword_lemmas where lemma is not null),
first as (select keyword_category, lemma, min(group_n) as group_n from keyword_lemmas where lemma is not null group by keyword_category, lemma),
marks as (select first.keyword_category, lemma, placeholder from first join groups on groups.group_n = first.group_n and groups.keyword_category = first.keyword_category),
marked as (
  select s.* exclude (form, lemma), c.keyword_category, coalesce(m.placeholder, s.form) as form, coalesce(m.placeholder, s.lemma) as lemma, array_to_string(interp, ':') as tags
  from {source} s cross join categories c left join marks m on m.keyword_category = c.keyword_category and m.lemma = s.lemma)
"""


def _grams_by(keys: list[str], source: str, fields: list[str], size: int, keyed: bool = False) -> str:
    """The collocations of a source by windows over all rows with the same keys, counts and totals too."""
    key, names = ", ".join(keys), [f"w{k + 1}" for k in range(size)]
    word = "struct_pack(" + ", ".join(f"{f} := coalesce({f}, '')" for f in fields) + ")"
    leads = "".join(f", lead(w1, {k}) over (partition by {key} order by section_id, par_n, tok_n, w1) as w{k + 1}" for k in range(1, size))
    head = f""",
seq as (select {key}, section_id, par_n, tok_n, {word} as w1 from {source}),
grams as (select {key}, w1{leads} from seq),
single as (select {key}, w1 as w, count(*)::double as n from seq group by all),
every as (select {key}, count(*)::double as t from seq group by all),
kept as (
  select {key}, {", ".join(names)}, count(*) as n from grams where {names[-1]} is not null group by all
  having n >= 2 and {" and ".join(f"length({w}.{fields[0]}) >= 2" for w in names)}{" and (" + " or ".join(f"starts_with({w}.lemma, '__')" for w in names) + ")" if keyed else ""}),
known as (select kept.*, t, {", ".join(f"s{k + 1}.n as n{k + 1}" for k in range(size))} from kept join every using ({key}) {" ".join(f"join single s{k + 1} on {' and '.join(f's{k + 1}.{x} = kept.{x}' for x in keys)} and s{k + 1}.w = w{k + 1}" for k in range(size))})
"""
    out = ", ".join([*keys, *[f"{w}.{f} as {w}_{f}" for w in names for f in fields], "n"])
    llr = lambda o, e: f"case when {o} > 0 then {o} * ln({o} / ({e})) else 0 end"
    if size == 2:
        return head + f""",
cells as (select *, n::double as c11, n2 - n as c01, n1 - n as c10, t - n1 - n2 + n as c00 from known)
select {out}, round(c11 / (c11 + c01 + c10), 6) as jaccard,
  round(2 * ({" + ".join(llr(f"c{i}{j}", f"{('(t - n1)', 'n1')[i]} * {('(t - n2)', 'n2')[j]} / t") for i in (0, 1) for j in (0, 1))}), 4) as likelihood_ratio from cells"""
    bits = [(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]
    same = lambda p: " and ".join(f"{p}.{x} = k.{x}" for x in keys)
    return head + f""",
pairs as (select {key}, w1, w2, count(*)::double as n from grams where w2 is not null group by all),
gaps as (select {key}, w1, w3, count(*)::double as n from grams where w3 is not null group by all),
joined as (
  select k.*, k.n::double as c111, q.n - k.n as c011, g.n - k.n as c101, p.n - k.n as c110
  from known k join pairs p on {same("p")} and p.w1 = k.w1 and p.w2 = k.w2 join pairs q on {same("q")} and q.w1 = k.w2 and q.w2 = k.w3 join gaps g on {same("g")} and g.w1 = k.w1 and g.w3 = k.w3),
more as (select *, n1 - c111 - c101 - c110 as c100, n2 - c111 - c011 - c110 as c010, n3 - c111 - c011 - c101 as c001 from joined),
cells as (select *, c111 + c011 + c101 + c110 + c100 + c010 + c001 as held, t - (c111 + c011 + c101 + c110 + c100 + c010 + c001) as c000 from more)
select {out}, round(c111 / held, 6) as jaccard,
  round(2 * ({" + ".join(llr(f"c{i}{j}{k}", f"{('(t - n1)', 'n1')[i]} * {('(t - n2)', 'n2')[j]} * {('(t - n3)', 'n3')[k]} / (t * t)") for i, j, k in bits)}), 4) as likelihood_ratio from cells"""


_DISTRIBUTION = f"""{_TOKENS}, {_GROUPS},
counts as (select subset, lemma, count(*) as n from plain group by subset, lemma),
grid as (select distinct subset from counts),
found as (
  select g.subset, k.keyword_category, k.group_n, first_lemma, k.lemma_n, k.lemma, coalesce(c.n, 0) as n
  from grid g cross join keyword_lemmas k join groups on groups.keyword_category = k.keyword_category and groups.group_n = k.group_n
  left join counts c on c.subset = g.subset and c.lemma = k.lemma where k.lemma is not null),
distribution as (select *, (sum(n) over (partition by subset, keyword_category, group_n))::bigint as group_sum from found)
"""

_GROUP_YEARS = f"""{_WORDS}, {_GROUPS},
group_years as (
  select keyword_category || '_' || first_lemma as keyword_group, year(date)::int as year, count(*) as n
  from said join keyword_lemmas k on k.lemma = said.lemma join groups g using (keyword_category, group_n)
  where year(date) between 1572 and 1696 group by all)
"""

_INDEX = """
indexed as (
  select unnest(['ALL', 'book_title__' || coalesce(book_title, 'None'), 'convent_location__' || coalesce(convent_location, 'None'), 'palatinate__' || coalesce(palatinate, 'None')]) as subset, section_id from documents_only
  union all
  select 'date_range__' || s || '_' || e as subset, section_id from documents_only join (
    select strptime(range_start, '%-d-%-m-%Y')::date as s, strptime(range_end, '%-d-%-m-%Y')::date as e from date_ranges) on date >= s and date < e)"""

_GROUP_YEARS_OF = f"""{_WORDS}, {_GROUPS}, {_INDEX},
group_years as (
  select subset, keyword_category || '_' || first_lemma as keyword_group, year(date)::int as year, count(*) as n
  from said join indexed using (section_id) join keyword_lemmas k on k.lemma = said.lemma join groups g using (keyword_category, group_n)
  where year(date) between 1572 and 1696 group by all)
"""


def _life(keys: str) -> str:
    """Years of each rule and the other years, of group_years by keys."""
    own = f"{keys}, " if keys else ""
    return f""",
every as (select {own}list(distinct year) as ys from group_years {"group by " + keys if keys else ""}),
held as (select {own}keyword_group as rule, list(distinct year) as ys from group_years group by all)
select {own}rule, array_to_string(list_sort(held.ys), ':') as years, array_to_string(list_sort(list_filter(every.ys, lambda y: not list_contains(held.ys, y))), ':') as years_not
from held {f"join every using ({keys})" if keys else "cross join every"}"""


_OCR = "paragraph"
for _from, _to in [("lnstru", "Instru"), ("rn ", "m "), ("ćm ", "em "), ("ćj ", "ej "), ("wv", "w"), ("^ ?@", "§"), ("^ ?%", "§"), ("^ ?&", "§"), ("^ ?ś ", "§ "), ("^ ?g ", "§ "), (" lmc", " Imc"), (" ct ", " et ")]:
    _OCR = f"regexp_replace({_OCR}, '{_from}', '{_to}', 'g')"



def _like(column: str, pattern: str) -> str:
    """A fixed pattern in RE2, whose classes are ASCII."""
    plain = pattern.removeprefix("(?iu)").replace(r"[,\.\s]", r"[,\.@]").replace(r"\s", r"[@]").replace("@", r"\s\x{00a0}").replace(r"[^\w]", r"[^\p{L}\p{N}_]")
    return f"regexp_matches({column}, '{plain.replace(chr(39), chr(39) * 2)}'{', ' + chr(39) + 'i' + chr(39) if pattern.startswith('(?iu)') else ''})"


def _hits(column: str, given: list[str]) -> str:
    return "(" + " + ".join(f"{_like(column, p)}::int" for p in given) + ")"


_SCORED = (
    _PARAGRAPHS
    + f""",
bare as (select p.*, replace(paragraph, '-', '') as b, coalesce(most, 300) as most from paragraphs p left join (select book_title, max(max_heading_len) as most from editions group by book_title) e on e.book_title = p.book_title),
signs as (
  select *, {_hits("b", patterns.HEADING_FIRST)} as first, {_hits("b", patterns.HEADING_SECOND)} as second, {_hits("b", patterns.HEADING_AGAINST)} as against, regexp_extract(b, '\\p{{L}}') as letter,
    {" + ".join(f"starts_with(lower(paragraph), '{w}')::int" for w in patterns.OPENING_WORDS)} as at_start, {_like("paragraph", patterns.OPENING)} as opens
  from bare),
scored as (
  select *, (first + (second - case when first = 0 then 1.5 else 0 end)) - (against * 0.6 + case when letter = '' or lower(letter) = letter then 1.0 else 0 end) - length(b) / 70.0 as raw,
    case when opens or left(paragraph, 1) <> lower(left(paragraph, 1)) then -0.2 + 0.3 * (11 - at_start) / 11 else -0.5 end as beginning
  from signs),
titled as (
  select section_id, first(paragraph order by (case when length(paragraph) < 15 or length(paragraph) > 300 then -1.5 else raw end) desc, par_n) as title from scored where par_n <= 3 and paragraph is not null group by section_id)
"""
)


_META_LIKE = [p.replace(r"[\WiIvVxX]", rf"(?:[^\p{{L}}\p{{M}}\p{{N}}_]|[iIvVxX])") for p in patterns.META_SIGNS]


def _reason(text: str) -> str:
    """Why a paragraph is an editor's note, or null: the rules in their order."""
    said = f"list_filter(regexp_split_to_array({text}, '[\\s\\x{{00a0}}]'), lambda w: w <> '')"
    count = lambda of, rule: f"len(list_filter({of}, lambda w: {rule}))"
    titled = _hits(text, patterns.RESOLUTION_TITLES + patterns.OTHER_TITLES + patterns.NEAR_TITLES)
    n = f"length({text})"
    return f"""case when {n} < 9 then 'short'
  when list_max(list_transform(string_split({text}, chr(10)), lambda w: length(w))) > 200 then 'long line'
  when {n} < 800 and {_hits(text, _META_LIKE)} > 0 then 'sign'
  when length(regexp_replace({text}, '[\\p{{L}}\\p{{M}}_]', '', 'g')) / {n} >= 0.65 then 'not letters'
  when len({said}) >= 4 and {count(said, "length(w) <= 2")} > 0.48 * len({said}) then 'short words'
  when len({said}) < 10 and {count(said, "length(w) > 3 and regexp_matches(w, '[IVXLCM]') and w = upper(w) and w <> lower(w)")} > 0 then 'capital word'
  when {titled} = 0 and len({said}) >= 3 and {count(said, "left(w, 1) <> lower(left(w, 1)) or regexp_matches(w, '[^\\p{L}\\p{M}_]')")} > 0.85 * len({said}) then 'capitals'
  when {n} < 380 and len(regexp_extract_all({text}, '(?:(?:^| ).|. )\\)')) >= 2 then 'footnotes'
  when {n} between 2 and 16 and len(list_distinct(string_split(lower({text}), ''))) <= greatest(2.0, {n} / 3) then 'few characters'
  when {count(f"regexp_extract_all({text}, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+\\.')", "regexp_full_match(w, '[A-Za-z]{1,5}\\.')")} > len(string_split({text}, ' ')) * 0.33 then 'abbreviations' end"""


def _repaired(text: str) -> str:
    return _OCR.replace("(paragraph,", f"({text},") if "(paragraph," in _OCR else text


_SEGMENTED = (
    _SCORED.replace("from paragraphs p left join", "from scans p left join").replace("coalesce(most, 300)", "300").replace(
        ",\nbare as", f""",
scans as (
  select distinct book_title, scan_page, section_id, par_n, trim({_repaired("paragraph")}) as paragraph from paragraphs
  where scan_page >= 0 and paragraph is not null and book_title is not null and trim({_repaired("paragraph")}) <> ''),
bare as""").rsplit(",\ntitled as", 1)[0]
    + f""",
judged as (
  select book_title, scan_page, section_id, par_n, paragraph as text, coalesce({_reason("paragraph")}, '') <> '' as meta,
    case when length(paragraph) < 15 or length(paragraph) > 300 then -1.5 else raw end as score, beginning from scored),
ahead as (select *, lead(case when not meta then beginning end ignore nulls) over w as next from judged window w as (partition by book_title order by scan_page, section_id, par_n)),
titled as (select *, not meta and next is not null and score + greatest(0, next) > 0 as title from ahead),
begun as (select *, title and count(*) filter (where not meta) over (partition by book_title order by scan_page, section_id, par_n rows unbounded preceding) > 1 as begins from titled),
opened as (
  select *, sum(begins::int) over w as document_n, not meta and coalesce(lag(case when not meta then begins end ignore nulls) over w, false) as commits, bool_or(not meta) over (partition by book_title) as has_text
  from begun window w as (partition by book_title order by scan_page, section_id, par_n)),
committed as (select *, coalesce(sum(commits::int) over (partition by book_title order by scan_page, section_id, par_n rows between unbounded preceding and 1 preceding), 0) as committed from opened where has_text),
placed as (select *, case when meta then committed else document_n end as seq from committed),
news as (
  select *, case when meta or lag(seq) over w is null or lag(seq) over w <> seq or lag(meta) over w then 1 else 0 end as new
  from placed window w as (partition by book_title order by seq, meta, scan_page, section_id, par_n)),
segmented as (
  select book_title as edition, (sum(new) over (partition by book_title order by seq, meta, scan_page, section_id, par_n rows unbounded preceding) - 1)::int as section_n,
    case when meta then 'meta' else 'document' end as section_type, scan_page as page_n, section_id, par_n, case when title then {_repaired("trim(" + _repaired("text") + ")")} else text end as text from news)
"""
)

_STATS = ["all_docs", "all_tokens", "corrected_tokens", "unknown_form_tokens", "proper_name_tokens", "latin_tokens"]

SQL: dict[str, str] = {
    "token_codec": _TOKENS
    + """
select section_id, par_n, tok_n,
  case when latin then 'LA_' else '' end || case when proper_name then 'PN_' else '' end || case when unknown_form then '??_' when corrected then '!!_' else '' end
    || coalesce(form, '') || ':' || coalesce(lemma, '') || case when len(interp) > 0 then ':' || array_to_string(interp, ':') else '' end as coded,
  coalesce(form, '') as form, coalesce(lemma, '') as lemma, coalesce(array_to_string(interp, ':'), '') as tags,
  coalesce(latin, false) as latin, coalesce(proper_name, false) as proper_name, coalesce(unknown_form, false) as unknown_form, coalesce(corrected, false) and not coalesce(unknown_form, false) as corrected
from tokens""",
    "paragraph_tokens": _TOKENS
    + r"""
select section_id, par_n, count(*)::int as n_tokens, string_agg(regexp_replace(coalesce(form, ''), '[\s\x{00a0}]+', '', 'g'), ' ' order by tok_n) as forms from tokens group by section_id, par_n""",
    "basic_stats": _TOKENS
    + f""",
wide as (
  select subset, count(distinct section_id) as all_docs, count(*) as all_tokens, count_if(corrected) as corrected_tokens, count_if(unknown_form) as unknown_form_tokens,
    count_if(proper_name) as proper_name_tokens, count_if(latin) as latin_tokens from placed group by subset),
long as (select subset, unnest({_STATS}) as stat, unnest([{", ".join(f"{s}::bigint" for s in _STATS)}]) as n from wide)
select * from long where n > 0""",
    "form_frequency": _counted("(select *, array_to_string(interp, ':') as tags from body)", "form, lemma, tags"),
    "lemma_frequency": _counted("plain", "lemma"),
    "head_sum": _TOKENS
    + """,
counts as (select lemma, count(*) as n, min({'a': section_id, 'b': par_n, 'c': tok_n}) as place from tokens where par_n > 1 group by lemma)
select coalesce(sum(n), 0)::bigint as head_sum, count(*) as lines from (select n from counts order by n desc, place limit 100)""",
    "form_bigrams": _TOKENS + _grams("whole", ["form", "lemma", "tags"], 2),
    "form_trigrams": _TOKENS + _grams("whole", ["form", "lemma", "tags"], 3),
    "lemma_bigrams": _TOKENS + _grams("corpus", ["lemma"], 2),
    "lemma_trigrams": _TOKENS + _grams("corpus", ["lemma"], 3),
    "lemma_bigrams_in_paragraphs": _TOKENS + _grams("corpus", ["lemma"], 2, within=True),
    "kw_lemma_bigrams": _TOKENS + _marked("corpus") + _grams("marked", ["lemma"], 2, keyed=True),
    "kw_lemma_trigrams": _TOKENS + _marked("corpus") + _grams("marked", ["lemma"], 3, keyed=True),
    "kw_form_bigrams": _TOKENS + _marked("(select * from tokens where par_n > 1)") + _grams("marked", ["form", "lemma", "tags"], 2, keyed=True),
    "kw_form_trigrams": _TOKENS + _marked("(select * from tokens where par_n > 1)") + _grams("marked", ["form", "lemma", "tags"], 3, keyed=True),
    "kw_lemma_bigrams_by_category": _TOKENS + _marked_all("corpus") + _grams_by(["keyword_category"], "marked", ["lemma"], 2, keyed=True),
    "kw_lemma_trigrams_by_category": _TOKENS + _marked_all("corpus") + _grams_by(["keyword_category"], "marked", ["lemma"], 3, keyed=True),
    "kw_form_bigrams_by_category": _TOKENS + _marked_all("(select * from tokens where par_n > 1)") + _grams_by(["keyword_category"], "marked", ["form", "lemma", "tags"], 2, keyed=True),
    "kw_form_trigrams_by_category": _TOKENS + _marked_all("(select * from tokens where par_n > 1)") + _grams_by(["keyword_category"], "marked", ["form", "lemma", "tags"], 3, keyed=True),
    "form_bigrams_by_subset": _TOKENS + _grams_by(["subset"], "(select *, array_to_string(interp, ':') as tags from body)", ["form", "lemma", "tags"], 2),
    "kw_form_bigrams_by_subset": _TOKENS + _marked_all("body") + _grams_by(["subset", "keyword_category"], "marked", ["form", "lemma", "tags"], 2, keyed=True),
    "form_trigrams_by_subset": _TOKENS + _grams_by(["subset"], "(select *, array_to_string(interp, ':') as tags from body)", ["form", "lemma", "tags"], 3),
    "kw_form_trigrams_by_subset": _TOKENS + _marked_all("body") + _grams_by(["subset", "keyword_category"], "marked", ["form", "lemma", "tags"], 3, keyed=True),
    "lemma_bigrams_by_subset": _TOKENS + _grams_by(["subset"], "plain", ["lemma"], 2),
    "kw_lemma_bigrams_by_subset": _TOKENS + _marked_all("plain") + _grams_by(["subset", "keyword_category"], "marked", ["lemma"], 2, keyed=True),
    "lemma_trigrams_by_subset": _TOKENS + _grams_by(["subset"], "plain", ["lemma"], 3),
    "kw_lemma_trigrams_by_subset": _TOKENS + _marked_all("plain") + _grams_by(["subset", "keyword_category"], "marked", ["lemma"], 3, keyed=True),
    "keyword_groups": "with " + _GROUPS + "select keyword_category, group_n, first_lemma, placeholder from groups",
    "keyword_distribution": _DISTRIBUTION + "select subset, keyword_category, group_n, first_lemma, lemma_n, lemma, n, group_sum from distribution",
    "keyword_report": _DISTRIBUTION
    + """
select distinct subset, keyword_category, group_n, '##' || first_lemma || ' etc. - ' || group_sum as line from distribution
union all select subset, keyword_category, group_n, lemma || ' - ' || n from distribution where n > 0""",
    "kw_group_years": _GROUP_YEARS + "select keyword_group, year, n from group_years",
    "year_tokens": _WORDS + "select year(date)::int as year, count(*) as n from said group by all",
    "year_tokens_by_subset": _WORDS + "," + _INDEX + "select subset, year(date)::int as year, count(*) as n from said join indexed using (section_id) group by all",
    "kw_group_years_by_subset": _GROUP_YEARS_OF + "select subset, keyword_group, year, n from group_years",
    "rule_lifetimes": _GROUP_YEARS + _life(""),
    "rule_lifetimes_by_subset": _GROUP_YEARS_OF + _life("subset"),
    "rules_dropped": _GROUP_YEARS
    + """,
years as (select year, lead(year) over (order by year) as next from (select distinct year from group_years))
select next as year, keyword_group as rule from group_years g join years y on y.year = g.year where next is not null
  and not exists (select 1 from group_years h where h.keyword_group = g.keyword_group and h.year = next)""",
    "dictionary": _TOKENS
    + """
select form, array_to_string(list_sort(list(distinct coalesce(array_to_string(interp, ':'), ''))), '|') as interps
from tokens where form is not null and not coalesce(unknown_form, false) group by form""",
    "subset_lengths": _PARAGRAPHS + "select palatinate as value, sum(text_length)::bigint as text_length, count(*) as n_sections from documents_only group by palatinate",
    "subset_index": _PARAGRAPHS
    + """
select unnest(['ALL', 'book_title__' || coalesce(book_title, 'None'), 'convent_location__' || coalesce(convent_location, 'None'), 'palatinate__' || coalesce(palatinate, 'None')]) as subset, section_id from documents_only
union all
select 'date_range__' || s || '_' || e as subset, section_id from documents_only join (
  select strptime(range_start, '%-d-%-m-%Y')::date as s, strptime(range_end, '%-d-%-m-%Y')::date as e from date_ranges) on date >= s and date < e""",
    "weighted_sample": _PARAGRAPHS
    + """,
weight as (select palatinate, max(weight) as weight from palatinate_weights where palatinate is not null group by palatinate),
own as (select d.palatinate as value, section_id, text_length, weight from documents_only d join weight w on w.palatinate = d.palatinate),
observed as (select value, sum(text_length) as observed, max(weight) as weight from own group by value),
totals as (select sum(observed) as total, sum(weight) as weights from observed),
least_of as (select least(100, min((observed / total) / (weight / weights))) as coverage from observed, totals),
quotas as (select value, weight / weights * (coverage * total) as quota from observed, totals, least_of),
running as (
  select value, section_id, text_length, coalesce(sum(text_length) over (partition by value order by md5('1-' || section_id), section_id rows between unbounded preceding and 1 preceding), 0) as before from own)
select r.value, section_id, text_length, round(quota, 6) as quota from running r join quotas q on q.value = r.value where before < quota""",
    "lexeme_search": _TOKENS
    + """,
marked as (
  select section_id, par_n, tok_n, form, regexp_matches(lemma, '^w') as f0, lead(lemma <> '') over w as f1, lead(form) over w as w1 from tokens window w as (partition by section_id, par_n order by tok_n))
select section_id, par_n, tok_n, concat_ws(' ', form, w1) as match from marked where coalesce(f0, false) and coalesce(f1, false)""",
    "concordance": _TOKENS
    + """,
hits as (select section_id, par_n, tok_n, form as match from tokens where lemma = 'poseł')
select h.section_id, h.par_n, h.tok_n, h.match,
  coalesce(string_agg(coalesce(t.form, ''), ' ' order by t.tok_n) filter (where t.tok_n < h.tok_n), '') as before,
  coalesce(string_agg(coalesce(t.form, ''), ' ' order by t.tok_n) filter (where t.tok_n > h.tok_n), '') as after
from hits h join tokens t on t.section_id = h.section_id and t.par_n = h.par_n and t.tok_n between h.tok_n - 5 and h.tok_n + 5 group by h.section_id, h.par_n, h.tok_n, h.match""",
    "sections": _PARAGRAPHS + "select section_id, book_title, section_type, date::varchar as date, n_paragraphs, text_length::bigint as text_length from sections",
    "section_pages": _PARAGRAPHS + "select section_id, min_by(scan_page, par_n) as start_page, max_by(scan_page, par_n) as end_page from paragraphs group by section_id",
    "first_paragraphs": _PARAGRAPHS + "select section_id, string_agg(coalesce(paragraph, ''), chr(10) || chr(10) order by par_n) as text from paragraphs where par_n <= 2 group by section_id",
    "section_islands": """
with marked as (select book_title, row_id, section_id, case when row_number() over w = 1 or section_id is distinct from lag(section_id) over w then 1 else 0 end as new from edition_rows window w as (partition by book_title order by row_id)),
numbered as (select *, sum(new) over (partition by book_title order by row_id rows unbounded preceding) - 1 as island_n from marked)
select book_title, island_n::int as island_n, max(section_id) as section_id, count(*) as n_rows from numbered group by book_title, island_n""",
    "indexed_round_trip": _PARAGRAPHS
    + """
select (dense_rank() over (order by section_id) - 1)::int as section_n, (row_number() over (partition by section_id order by par_n))::int as par_n, section_id as number, book_title, scan_page, coalesce(paragraph, '') as paragraph, date::varchar as date
from paragraphs where section_id is not null and par_n is not null""",
    "renumbered": _PARAGRAPHS
    + """
select book_title as edition, section_id as section_n, section_type, (row_number() over (partition by book_title order by section_id) - 1)::int as inbook_section_id,
  case when section_type = 'document' then (sum(case when section_type = 'document' then 1 else 0 end) over (partition by book_title order by section_id rows unbounded preceding) - 1)::int end as inbook_document_id
from sections where book_title is not null""",
    "heading_scores": _SCORED
    + "select distinct section_id, par_n, round(case when length(paragraph) < 15 or length(paragraph) > most then -1.5 else raw end, 6)::double as score, round(beginning, 6)::double as beginning from scored",
    "titles": _SCORED + "select section_id, title from titled",
    "document_ids": _SCORED + "select s.section_id, title, pertinence = 'True' as pertinence from sections s left join titled t on t.section_id = s.section_id where section_type = 'document'",
    "pertinence": _SCORED
    + f""",
held as (
  select section_id, count(*) as n, max(case when par_n = 2 then paragraph end) as second, max(case when par_n = 3 then paragraph end) as third from paragraphs group by section_id)
select held.section_id, case when n <= 1 then false when contains(second, 'sędziowie') then false when {_like("second", patterns.OPENING)} then true when {_like("third", patterns.OPENING)} then true
  else coalesce({" or ".join(_like("title", p) for p in patterns.RESOLUTION_TITLES)}, false) end as pertinent
from held left join titled t on t.section_id = held.section_id""",
    "ocr_correct": _PARAGRAPHS + f"select distinct section_id, par_n, {_OCR} as text from paragraphs",
    "joined_lines": _PARAGRAPHS
    + r"""
select distinct section_id, par_n, list_reduce(list_concat([''], string_split(paragraph, chr(10))), lambda a, l, i:
  case when a = '' then ' ' || l
    when right(a, 1) = '-' and lower(left(l, 1)) = left(l, 1) and upper(left(l, 1)) <> left(l, 1)
      then left(a, length(a) - 1) || case when regexp_matches(l, ' [^aeikouwyz]$') then left(l, length(l) - 2) else l end
    else a || ' ' || case when regexp_matches(l, ' [^aeikouwyz]$') then left(l, length(l) - 2) else l end end) as text
from paragraphs""",
    "match_keys": _PARAGRAPHS + r"select distinct section_id, par_n, regexp_replace(paragraph, '[\s\x{00a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]|\\n', '', 'g') as match_key from paragraphs",
    "token_sentences": _TOKENS
    + """,
marked as (select section_id, par_n, tok_n, coalesce(form = '.', false) as stop, coalesce(list_contains(interp, 'brev'), false) as brev from tokens),
ends as (select *, case when stop and not brev and not coalesce(lag(brev) over (partition by section_id, par_n order by tok_n), false) then 1 else 0 end as ended from marked),
numbered as (select *, coalesce(sum(ended) over (partition by section_id, par_n order by tok_n rows between unbounded preceding and 1 preceding), 0)::int as sent_n from ends)
select section_id, par_n, sent_n, count(*) as n_tokens from numbered group by all""",
    "lattice_arcs": _TOKENS
    + """,
arcs as (select section_id, par_n, tok_n from tokens where par_n is not null and tok_n is not null)
select section_id, par_n, count(*) as arcs, count(distinct tok_n)::double as prob, max(tok_n) as last from arcs group by section_id, par_n""",
    "split_short_lines": _PARAGRAPHS
    + f"""
, scans as (select distinct book_title || '#{{' || section_id || ', ' || par_n || '}}' as edition, scan_page as page_n, paragraph from paragraphs where scan_page >= 0 and paragraph is not null),
blocks as (select edition, page_n, unnest(string_split(paragraph, chr(10) || chr(10))) as block, generate_subscripts(string_split(paragraph, chr(10) || chr(10)), 1) as block_n from scans),
lines as (select edition, page_n, block_n, unnest(string_split(block, chr(10))) as line, generate_subscripts(string_split(block, chr(10)), 1) as line_n from blocks),
cut_lines as (select *, coalesce(sum((length(line) < 30)::int) over (partition by edition, page_n, block_n order by line_n rows between unbounded preceding and 1 preceding), 0) as part_n from lines),
joined as (select edition, page_n, block_n, part_n, string_agg(line, chr(10) order by line_n) as text from cut_lines group by all),
clean as (select edition, page_n, block_n, part_n, regexp_replace({_repaired("text")}, '^[\\s\\x{{00a0}}]+|[\\s\\x{{00a0}}]+$', '', 'g') as text from joined)
select edition, page_n, (row_number() over (partition by edition, page_n order by block_n, part_n))::int as par_n, text from clean where text <> ''""",
    "meta_fragments": _PARAGRAPHS + f"select * from (select distinct section_id, par_n, {_reason('paragraph')} as reason from paragraphs) where reason is not null",
    "segment_documents": _SEGMENTED + "select edition, section_n, section_type, page_n, section_id, par_n, text from segmented",
    "merge_short": _SEGMENTED
    + """,
sizes as (select edition, section_n, count(*) = 1 or sum(length(text)) + 2 * (count(*) - 1) < 250 as short from segmented where section_type = 'document' group by edition, section_n),
kept as (select edition, section_n, coalesce(lag(short) over (partition by edition order by section_n), false) as gone from sizes),
merged as (select edition, section_n, max(case when not gone then section_n end) over (partition by edition order by section_n) as target from kept)
select s.edition, coalesce(target, s.section_n)::int as section_n, section_type, page_n, section_id, par_n, text from segmented s left join merged m on m.edition = s.edition and m.section_n = s.section_n""",
    "html_report": _SCORED
    + f""",
notes as (select section_id, list(replace(replace(replace(coalesce(paragraph, ''), '&', '&amp;'), '<', '&lt;'), chr(10), '<br>') order by par_n, coalesce(paragraph, '')) as texts from paragraphs group by section_id),
reasons as (select section_id, {_reason('paragraph')} as reason from (select section_id, first(coalesce(paragraph, '') order by par_n, coalesce(paragraph, '')) as paragraph from paragraphs group by section_id))
select s.book_title as edition, s.section_id as section_n, case when section_type = 'meta' then
  '<p style="background-color: moccasin; font-family: monospace">' || texts[1] || '</p><p style="background-color: moccasin"><em>' || coalesce(reason, '') || '</em></p>' else '<h4>' || replace(replace(replace(coalesce(title, ''), '&', '&amp;'), '<', '&lt;'), chr(10), '<br>') || '</h4>' || array_to_string(list_transform(texts, lambda x: '<p>' || x || '</p>'), '') end as html
from sections s join notes n on n.section_id = s.section_id left join titled t on t.section_id = s.section_id left join reasons r on r.section_id = s.section_id""",
    "decided_sections": _SCORED
    + """,
pages as (select section_id, min_by(scan_page, par_n) as a, max_by(scan_page, par_n) as b from paragraphs group by section_id),
own as (
  select s.*, t.title, a, b, regexp_replace(coalesce(title, ''), '[\\s\\x{00a0}]|\\\\n', '', 'g') as k from sections s join titled t on t.section_id = s.section_id join pages p on p.section_id = s.section_id where book_title is not null),
receipts as (select distinct k, a from own where a >= 0 and starts_with(title, 'Pokwitowanie'))
select section_id as section_n, book_title as edition,
  case when exists (select 1 from receipts r where r.k = own.k and r.a between own.a and own.b) then false else pertinence = 'True' end as pertinence, date::varchar as date,
  (row_number() over (partition by book_title order by section_id) - 1)::int as inbook_section_id,
  case when section_type = 'document' then (sum(case when section_type = 'document' then 1 else 0 end) over (partition by book_title order by section_id rows unbounded preceding) - 1)::int end as inbook_document_id
from own""",
    "correct_tokens": _TOKENS
    + """,
known as (
  select form, list(distinct coalesce(array_to_string(interp, ':'), '')) as interps from tokens where form is not null and not coalesce(unknown_form, false) group by form),
asked as (select distinct form, coalesce(array_to_string(interp, ':'), '') as tag from tokens where form is not null and unknown_form),
near as (
  select a.form, a.tag, k.form as candidate, not list_contains(k.interps, a.tag) as other from asked a join known k
  on k.form <> a.form and abs(length(k.form) - length(a.form)) <= 1 and (length(a.form) = 1 or left(k.form, 1) = left(a.form, 1) or right(k.form, 1) = right(a.form, 1)) and case
    when length(k.form) = length(a.form) then list_sum(list_transform(range(1, length(a.form) + 1), lambda i: (a.form[i] <> k.form[i])::int)) = 1
    when length(k.form) > length(a.form) then list_contains(list_transform(range(0, length(k.form)), lambda i: left(k.form, i) || substr(k.form, i + 2)), a.form)
    else list_contains(list_transform(range(0, length(a.form)), lambda i: left(a.form, i) || substr(a.form, i + 2)), k.form) end),
best as (select form, tag, first(candidate order by other, candidate) as candidate from near group by form, tag)
select section_id, par_n, tok_n, case when b.candidate is not null then replace(b.candidate, ' ', '_') else t.form end as form, lemma,
  case when b.candidate is not null then false else unknown_form end as unknown_form, case when b.candidate is not null then true else corrected end as corrected
from tokens t left join best b on t.unknown_form and b.form = t.form and b.tag = coalesce(array_to_string(t.interp, ':'), '')
where b.candidate is not null or corrected""",
    "near_sections": _PARAGRAPHS + "select section_id as section_n, section_type, n_paragraphs from sections where abs(section_id - 100) <= 4",
}
