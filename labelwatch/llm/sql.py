"""DuckDB SQL for the operators that SQL can express."""

WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

OP2 = f"""
with recursive lowered as (
  select doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w
  from documents),
sets as (
  select doc_id, case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) end as s from lowered),
tokens as (select doc_id, unnest(s) as t from sets),
shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as common from tokens a join tokens b on a.t = b.t and a.doc_id <> b.doc_id group by all),
links as (
  select a, b from shared join sets x on x.doc_id = a join sets y on y.doc_id = b
  where 100 * common >= 80 * (len(x.s) + len(y.s) - common)),
reach(id, root) as (
  select doc_id, doc_id from documents union
  select l.b, r.root from reach r join links l on l.a = r.id)
select doc_id, len(s)::bigint as n_shingles, root as component_id
from sets join (select id, min(root) as root from reach group by id) on id = doc_id"""

OP7 = f"""
with words as (select doc_id, {WORDS.format("coalesce(text, '')")} as w from documents),
starts as (select doc_id, w, unnest(range(1, len(w) - 18)) as s from words where len(w) >= 20),
windows as (select doc_id, s, row_number() over (partition by array_to_string(w[s:s + 19], ' ') order by doc_id, s) as nth from starts),
gone as (select distinct doc_id, s + unnest(range(0, 20)) as p from windows where nth > 1),
lists as (select doc_id, list(p) as g from gone group by doc_id),
kept as (
  select doc_id, len(w) as n, [x for x, i in w if g is null or not list_contains(g, i)] as k
  from words left join lists using (doc_id))
select doc_id, n::bigint as n_words, (n - len(k))::bigint as n_removed, sha256(array_to_string(k, ' ')) as kept_sha256 from kept"""

LOWERED = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = f"""
with lists as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
lines as (select doc_id, unnest(l) as line, unnest(range(1, len(l) + 1)) as i from lists),
keyed as (
  select *, {LOWERED.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as k from lines),
firsts as (select k, min(doc_id) as first from keyed where length(k) >= 10 group by k having count(distinct doc_id) > 1),
marked as (select keyed.*, first is not null and first <> doc_id as gone from keyed left join firsts using (k))
select doc_id, count(*)::bigint as n_lines, (count(*) filter (gone))::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from marked group by doc_id"""

# the first CTEs are a table-driven CRC-32 over the bytes of '<doc_id>:<run>'
OP13 = f"""
with recursive steps(b, i, v) as (
  select range::bigint, 0, range::bigint from range(256) union all
  select b, i + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from steps where i < 8),
entries as (select b, v from steps where i = 8),
runs as (select doc_id, unnest(regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '[a-zÀ-ÿ]+')) as run from documents),
own as (select doc_id, run, count(*) as c from runs where length(run) >= 6 group by all),
spelled as (select row_number() over () as id, run, c, hex(encode(doc_id || ':' || run)) as x from own),
crc(id, x, i, acc) as (
  select id, x, 1, 4294967295 from spelled union all
  select id, x, i + 2, xor(acc >> 8, v) from crc join entries
    on b = xor(acc, 16 * (instr('0123456789ABCDEF', x[i]) - 1) + instr('0123456789ABCDEF', x[i + 1]) - 1) & 255
  where i < length(x)),
hashed as (select run, c, xor(acc, 4294967295) as h from crc join spelled using (id) where i > length(crc.x)),
results as (
  select case when h % 199 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, c from hashed),
vocabulary as (select word, sum(c)::bigint as n from results where length(word) >= 6 group by word having sum(c) >= 5),
places as (select word, n, unnest(range(1, length(word) + 1)) as p from vocabulary),
shorter as (select word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) as rest from places),
pairs as (
  select a.word, b.word as near, b.n as near_n from shorter a join shorter b on a.rest = b.rest and a.p = b.p and a.word <> b.word
  union select a.word, b.word, b.n from shorter a join vocabulary b on a.rest = b.word
  union select b.word, a.word, a.n from shorter a join vocabulary b on a.rest = b.word),
best as (select word, count(*) as n_near, first(near order by near_n desc, near) as near, max(near_n) as near_n from pairs group by word),
formed as (
  select v.word, v.n, coalesce(n_near, 0)::bigint as n_near, case when near_n >= 5 * n then near end as form,
    case when near_n >= 5 * n then near_n end as form_n
  from vocabulary v left join best using (word)),
chain(word, top) as (select word, word from formed union all select c.word, form from chain c join formed f on f.word = c.top where form is not null)
select formed.word, formed.form, chain.top as root, formed.n, formed.n_near, formed.form_n
from formed join chain on chain.word = formed.word join formed last on last.word = chain.top and last.form is null"""

ORACLES = {"op2_ngram_jaccard": OP2, "op7_substring_dedup": OP7, "op11_line_dedup": OP11, "op13_spelling_variants": OP13}
