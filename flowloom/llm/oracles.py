"""SQL twins of the operator queries, for DuckDB."""

# Windows are compared as texts here; documents of the tables have distinct ids.
OP4_LINE_DEDUP = r"""
with d as (select doc_id, text, string_split(coalesce(text, ''), chr(10)) as x from documents),
r as (select doc_id, x, unnest(range(1, len(x) + 1)) as i from d),
a as (select doc_id, i, x[i] as line, len(regexp_extract_all(x[i], '[^\x20\x09-\x0D]+')) as n from r),
l as (select *, row_number() over o - 1 as seq, sum(n) over o as upto from a where n > 0
      window o as (partition by doc_id order by i)),
w as (select a.doc_id, a.seq, min(b.seq) as till from l a join l b
      on a.doc_id = b.doc_id and b.seq >= a.seq and b.upto >= a.upto - a.n + 30 group by 1, 2
      union
      select a.doc_id, max(b.seq), a.seq from l a join l b
      on a.doc_id = b.doc_id and b.seq <= a.seq and b.upto - b.n <= a.upto - 30 group by 1, a.seq),
k as (select w.doc_id, w.seq, w.till, string_agg(l.line, chr(10) order by l.seq) as run
      from w join l on l.doc_id = w.doc_id and l.seq between w.seq and w.till group by 1, 2, 3),
f as (select *, row_number() over (partition by run order by doc_id, seq) as nth from k),
c as (select distinct l.doc_id, l.i, l.seq from f join l
      on l.doc_id = f.doc_id and l.seq between f.seq and f.till where nth > 1),
s as (select doc_id, count(*) as n_deleted, string_agg(seq::varchar, ',' order by seq) as deleted
      from c group by 1),
t as (select r.doc_id, string_agg(r.x[r.i], chr(10) order by r.i) as text
      from r anti join c on r.doc_id = c.doc_id and r.i = c.i group by 1),
n as (select doc_id, count(*) as n_lines from l group by 1)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_deleted, 0) as n_deleted,
       coalesce(deleted, '') as deleted,
       case when s.doc_id is null then d.text else coalesce(t.text, '') end as text
from d left join n using (doc_id) left join s using (doc_id) left join t using (doc_id)
"""

OP7_WARC = """
with p as (select page_id, coalesce(html, '') as payload from pages),
d as (select page_id, octet_length(encode(payload)) as payload_bytes,
             sha256(payload) as payload_digest from p),
f as (select payload_digest, min(page_id) as first_id from d where payload_bytes >= 100 group by 1)
select d.page_id, d.payload_bytes, d.payload_digest,
       case when f.first_id <> d.page_id then 'revisit' else 'response' end as record_type,
       case when f.first_id <> d.page_id then f.first_id end as refers_to
from d left join f using (payload_digest)
"""

_MIX = r"""
r as (select doc_id, source, {size} as size,
             (('0x' || substr(md5(doc_id::varchar), 1, 13))::bigint + 0.5) / 4503599627370496.0 as u
      from {docs}),
s as (select source, sum(size)::bigint as source_size from r group by 1),
w as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from s),
c as (select *, sum(3 * source_size) over o - 3 * source_size as cap_before,
             sum(weight) over o - weight as w_before
      from w window o as (order by 3.0 * source_size / weight, source nulls last)),
t as (select *, ((select sum(source_size) from w) - cap_before)::double
             / ((select sum(weight) from w) - w_before) as rate from c),
l as (select rate from t where weight * rate <= 3.0 * source_size
      order by 3.0 * source_size / weight, source nulls last limit 1),
g as (select w.source, source_size, least(weight * l.rate, (3 * source_size)::double) as target
      from w cross join l),
h as (select *, coalesce(floor(target / nullif(source_size, 0)), 0)::bigint as whole from g),
k as (select *, target - whole * source_size as rest from h),
q as (select r.doc_id, r.size, k.source, k.source_size, k.target, k.whole, k.rest, u / (1 - u) as q,
             sum(r.size) over (partition by r.source order by u / (1 - u), doc_id
                               rows unbounded preceding) as upto
      from r join k on r.source is not distinct from k.source),
m as (select *, (source_size = 0 or upto <= rest)::int as more from q),
n as (select *, rest - sum(more * size) over (partition by source) as miss from m),
x as (select *, case when more = 0 and abs(size - miss) < miss then row_number() over (
        partition by source, more = 0 and abs(size - miss) < miss
        order by abs(size - miss), q, doc_id) end as nth from n),
mix as (select doc_id, size::bigint as size, source_size, target,
               least(whole + more + (nth is not distinct from 1)::int, 3)::bigint as copies from x)
"""

_SIZE = r"""len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"""

OP9_MIXING = "with " + _MIX.format(docs="documents", size=_SIZE) + (
    "select doc_id, size, source_size, target, copies * size as taken, copies from mix")

OP10_QUALITY_RULES = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
      from d),
g as (select doc_id, i, array_to_string(w[i:i + 4], ' ') as g
      from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 5)),
p as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as n from g) where n > 1),
r as (select doc_id, sum(least(5, coalesce(nxt - i, 5)))::bigint as n_repeat_words
      from (select *, lead(i) over (partition by doc_id order by i) as nxt from p) group by 1),
m as (select w.doc_id, len(w) as n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
             length(t) - length(replace(t, '!', '')) as n_shouts,
             len(list_filter(w, lambda x: list_contains({stop}, lower(x)))) as n_stop_words,
             len(l) as n_lines, len(l) - len(list_distinct(l)) as n_dup_lines,
             len(list_filter(l, lambda x: regexp_matches(x, '^[ \t]*[-*•]'))) as n_bullet_lines,
             len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\r]*$'))) as n_ellipsis_lines,
             coalesce(n_repeat_words, 0) as n_repeat_words
      from w left join r using (doc_id)),
b as (select *, array_to_string(list_filter([
         case when n_words < 10 then 'few_words' end,
         case when word_chars / nullif(n_words, 0) < 2.0 then 'short_words' end,
         case when word_chars / nullif(n_words, 0) > 20.0 then 'long_words' end,
         case when n_symbols / nullif(n_words, 0) > 0.2 then 'symbols_per_word' end,
         case when n_shouts / nullif(n_words, 0) > 0.4 then 'shouts_per_word' end,
         case when n_stop_words / nullif(n_words, 0) < 0.02 then 'stop_words' end,
         case when n_dup_lines / nullif(n_lines, 0) > 0.3 then 'duplicate_lines' end,
         case when n_bullet_lines / nullif(n_lines, 0) > 0.9 then 'bullet_lines' end,
         case when n_ellipsis_lines / nullif(n_lines, 0) > 0.3 then 'ellipsis_lines' end],
         lambda x: x is not null), ',') as broken_rules,
         n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed
      from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and broken_rules = '' as kept, broken_rules
from b
"""


# crc32 bit by bit: a byte is mixed in, then eight times the sum is halved and mixed with the polynomial
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(
    string_split(doc_id::varchar, ''), lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: case when x >= 0 then xor(a, x) else xor(a // 2, 3988292384 * (a % 2)) end))"""

_FOLD = """
{n}(lv, g, n, r, h) as (
  select 0, g, n, r, h from {leaves}
  union all
  select lv + 1, g, (n + 2) // 3, r // 3, sha256(string_agg(h, '' order by r)) from {n} where n > 1
  group by lv, g, n, r // 3),
{n}_near as (select a.g, a.r, b.lv,
    coalesce(string_agg(b.h, '' order by b.r) filter (b.r < a.r // (3 ** b.lv)::bigint), '') as before,
    coalesce(string_agg(b.h, '' order by b.r) filter (b.r > a.r // (3 ** b.lv)::bigint), '') as after
  from {leaves} a join {n} b on a.g = b.g and b.n > 1 and b.r // 3 = a.r // (3 ** (b.lv + 1))::bigint
  group by a.g, a.r, b.lv),
"""

OP12_MERKLE_MANIFEST = r"""
with recursive d as (select *, row_number() over (partition by source order by doc_id) - 1 as r,
    count(*) over (partition by source) as n, dense_rank() over (order by source nulls first) - 1 as g from documents),
f as (select doc_id, source, g, n, r, {crc} % 2 = 0 as odd_one, text,
    {head} as head from d),
l as (select doc_id, g, n, r, sha256(head || {own}) as h,
    sha256(head || case when odd_one then {cut} else {own} end) as claim from f),
""" + _FOLD + r"""
s as (select 0 as g, count(*) over () as n, g as r, h from t where n = 1),
""" + _FOLD.replace("{n}", "{m}").replace("{leaves}", "s") + r"""
p as (select g as s, r, lv, before, after from t_near
      union all select l.g, l.r, 1000 + u.lv, before, after from l join u_near u on u.r = l.g),
c(k, s, r, h) as (
  select 0, g, r, claim from l
  union all
  select c.k + 1, c.s, c.r, sha256(q.before || h || q.after) from c
  join (select *, row_number() over (partition by s, r order by lv) - 1 as k from p) q
    on q.s = c.s and q.r = c.r and q.k = c.k),
top as (select s, r, max_by(h, k) as folded_root from c group by s, r),
proof as (select s, r, sha256(string_agg(before || after, '' order by lv)) as proof_sha256 from p group by s, r),
root as (select h as root from u where n = 1)
select doc_id, l.h as leaf, s.h as subroot, root, coalesce(proof_sha256, sha256('')) as proof_sha256, folded_root,
       folded_root = root as verified
from l join s on s.r = l.g cross join root join top on top.s = l.g and top.r = l.r
left join proof on proof.s = l.g and proof.r = l.r
"""


def _field(x: str) -> str:
    return f"coalesce(octet_length(encode({x}::varchar))::varchar || ':' || {x}::varchar, '-')"


OP12_MERKLE_MANIFEST = OP12_MERKLE_MANIFEST.format(
    crc=_CRC, head=" || ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars")), own=_field("text"),
    cut=_field("replace(text, chr(10), '')"), n="t", m="u", leaves="l")


def _stop() -> str:
    from flowloom.llm.rules import STOP_WORDS

    return "[" + ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS))) + "]"


OP10_QUALITY_RULES = OP10_QUALITY_RULES.replace("{stop}", _stop())
