"""DuckDB SQL of the operators that SQL can express, written apart from their Spark form."""

from tremorlake.llm.licenses import LEAST, TEMPLATES

URLS = r"""
with named as (
  select page_id, url, cast(date '2024-01-01' + cast(page_id % 365 as int) as date) as fetched,
         regexp_replace(lower(regexp_extract(url, '^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.+$', '') as host,
         list_filter(string_split(trim(regexp_extract(url, '^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1)), '/'), lambda x: x <> '') as seg
  from pages
),
seen as (
  select pattern, min(page_id) as low, max(page_id) as high from (
    select page_id, host as pattern from named where host <> ''
    union all select page_id, host || '/' || seg[1] from named where host <> '' and len(seg) > 0
  ) group by pattern
),
entries as (
  select pattern, ['malware', 'adult', 'spam', 'allow'][low % 4 + 1] as category, day, action from (
    select *, low % 200 as day, 'add' as action from seen
    union all select *, low % 200 + 20 + high % 60, 'remove' from seen
    union all select *, low % 200 + 120, 'add' from seen
  )
),
spans as (
  select pattern, category, day as start, lead(day) over (partition by pattern order by day) as stop from (
    select pattern, day, min(category) filter (action = 'add') as category from entries group by pattern, day
  )
),
asked as (
  select page_id, unnest(
    list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))
    || list_transform(range(1, len(seg) + 1), lambda i: host || '/' || array_to_string(seg[1:i], '/'))) as pattern,
    cast(page_id % 365 as int) as day
  from named where host <> ''
),
met as (
  select a.page_id, s.pattern, s.category from asked a join spans s
  on a.pattern = s.pattern and s.category is not null and a.day >= s.start and (s.stop is null or a.day < s.stop)
),
best as (
  select page_id, count(*) as n_active, max(struct_pack(n := length(pattern), p := pattern, c := category)) as top from met group by page_id
)
select n.page_id, n.url, n.fetched, coalesce(b.n_active, 0) as n_active, b.top.p as pattern, b.top.c as category,
       coalesce(b.top.c <> 'allow', false) as blocked
from named n left join best b on n.page_id = b.page_id
"""

_TEMPLATES = ", ".join(f"('{name}', '{text}')" for name, text in TEMPLATES.items())

LICENSES = rf"""
with templates as (
  select name, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) as t from (
    select name, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') as w
    from (values {_TEMPLATES}) v(name, text))
),
units as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10)) || case when contains(text, chr(10)) then [text] else [] end) as unit from documents
),
worded as (
  select doc_id, w from (
    select doc_id, string_split(trim(regexp_replace(lower(unit), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') as w from units)
  where len(w) between 2 and (select max(floor(len(t) * {2 - LEAST} / ({LEAST}))) + 1 from templates)
),
pairs as (select doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) as p from worded),
scored as (
  select doc_id, name, len(p) + len(t) as total,
         list_sum(list_transform(list_distinct(p), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(t, lambda y: y = x))))) as common
  from pairs, templates
),
hits as (select doc_id, name, 2.0::double * common / total as dice from scored where {LEAST.denominator * 2} * common >= {LEAST.numerator} * total),
found as (
  select doc_id, count(*) as n_hits, array_to_string(list_sort(list_distinct(list(name))), ',') as licenses,
         max(dice) as best_dice, arg_min(name, struct_pack(d := -dice, n := name)) as best_license
  from hits group by doc_id
)
select d.doc_id, coalesce(f.n_hits, 0) as n_hits, coalesce(f.licenses, '') as licenses, f.best_license, f.best_dice
from documents d left join found f on d.doc_id = f.doc_id
"""


def _position(knots: tuple[float, float, float]) -> str:
    """Inverse of the integral of a piecewise linear schedule over two equal steps."""
    a, b, c = knots
    one, two = 0.5 * (a + b) / 2, 0.5 * (b + c) / 2

    def solved(rest: str, low: float, high: float, start: float) -> str:
        slope = (high - low) / 0.5
        return f"({start} + least(2 * {rest} / ({low} + sqrt(greatest({low * low} + 2 * ({slope}) * {rest}, 0.0))), 0.5))"

    want = f"(share * {one + two})"
    return (
        f"case when {want} <= {one} then {solved(f'greatest({want}, 0.0)', a, b, 0.0)}"
        f" when {want} <= {one + two} then {solved(f'greatest({want} - {one}, 0.0)', b, c, 0.5)} else 1.0 end"
    )


MIX = rf"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
),
sources as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as i from sized group by source
),
weighed as (select *, [5, 2, 1][i % 3 + 1] as weight from sources),
ranked as (
  select *, row_number() over (order by 2.0 * source_size / weight, source_size, i) as place,
         sum(2 * source_size) over o as full_below, sum(weight) over o as weight_below
  from weighed window o as (order by 2.0 * source_size / weight, source_size, i rows between unbounded preceding and 1 preceding)
),
levels as (
  select *, (1.5 * (select sum(source_size) from sources) - coalesce(full_below, 0)::double)
            / ((select sum(weight) from weighed) - coalesce(weight_below, 0))::double as level from ranked
),
chosen as (select arg_min(level, place) as level from levels where 2.0 * source_size > level * weight),
targets as (
  select source, source_size, i, least((2 * source_size)::double, coalesce((select level from chosen), 0.0) * weight) as target from weighed
),
placed as (
  select d.doc_id, d.size, t.source_size, t.target, t.i, floor(t.target)::bigint as wanted,
         (coalesce(sum(d.size) over (partition by d.source order by md5(d.doc_id::varchar), d.doc_id, d.size
                                     rows between unbounded preceding and 1 preceding), 0))::bigint as before
  from sized d join targets t on d.source is not distinct from t.source
),
taken as (
  select *, greatest(least(wanted - before, size), 0) as one, greatest(least(wanted - before - source_size, size), 0) as two from placed
),
shares as (
  select *, case when one > 0 then (before + one / 2.0) / greatest(wanted, 1) when two > 0 then (before + source_size + two / 2.0) / greatest(wanted, 1) end as share
  from taken
)
select doc_id, size, source_size, target, one + two as taken,
       case when share is null then null when i % 3 = 0 then {_position((1.0, 0.5, 0.25))}
            when i % 3 = 1 then {_position((0.5, 1.0, 1.0))} else {_position((0.25, 0.5, 1.0))} end as first_position
from shares
"""

LINKS = r"""
with recursive words as (
  select doc_id, string_split(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+', ' ', 'g'), ' '), ' ') as w from documents
),
sets as (
  select doc_id, case when len(w) = 1 and w[1] = '' then [] when len(w) < 3 then [array_to_string(w, ' ')]
         else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s
  from words
),
tokens as (select doc_id, len(s) as n, unnest(s) as t from sets),
common as (
  select a.doc_id as a, b.doc_id as b, a.n as an, b.n as bn, count(*) as shared
  from tokens a join tokens b on a.t = b.t and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n
),
links as (select a, b from common where 100 * shared >= 90 * (an + bn - shared)),
both_ways as (select a, b from links union select b, a from links),
reach as (
  select a as x, a as y from both_ways union select r.x, e.b from reach r join both_ways e on r.y = e.a
),
lowest as (select x, min(y) as low from reach group by x)
select s.doc_id, len(s.s) as n_shingles, coalesce(l.low, s.doc_id) as component_id from sets s left join lowest l on s.doc_id = l.x
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SEARCH = rf"""
with words as (select doc_id, {_TERMS} as w from documents),
lengths as (select doc_id, len(w)::bigint as n from words where len(w) > 0),
whole as (select count(*)::bigint as docs, sum(n)::bigint as terms from lengths),
asked as (select distinct item_id, unnest({_TERMS}) as term from benchmark),
held as (
  select doc_id, term, count(*)::bigint as tf from (select doc_id, unnest(w) as term from words)
  where term in (select term from asked) group by doc_id, term
),
weights as (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as weight
  from (select term, count(*)::bigint as df from held group by term), whole
),
impacts as (
  select h.doc_id, h.term, w.weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))) as impact
  from held h join weights w on h.term = w.term join lengths l on h.doc_id = l.doc_id, whole
),
scored as (select item_id, doc_id, sum(impact)::bigint as score from asked a join impacts i on a.term = i.term group by item_id, doc_id),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""
