"""The feature views of the package as SQL text over the raw tables."""

from labelwatch.sources.views import CONCEPT_STRENGTHS, PROXY_STRENGTHS


def u(expr: str) -> str:
    """Uniform in [0, 1) of a SQL string expression."""
    return f"(cast('0x' || substr(md5({expr}), 1, 8) as bigint) / 4294967296.0)"


def day(ts: str) -> str:
    return f"datediff('day', date '1992-01-01', cast({ts} as date))"


LINE_RETURNED = f"""line_returned as (
  select md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,
             cast(round(l_extendedprice * 100) as bigint), {day('l_shipdate')},
             cast(round(l_quantity) as bigint))) as id,
         cast(l_returnflag = 'R' as int) as label,
         l_quantity as quantity, l_extendedprice as extendedprice, l_discount as discount, l_tax as tax,
         cast(l_linenumber as double) as linenumber, cast({day('l_shipdate')} as double) as ship_day
  from lineitem)"""

ORDER_STATUS = f"""order_status as (
  select o_orderkey as id, cast(o_orderstatus = 'F' as int) as label,
         o_totalprice as totalprice, cast({day('o_orderdate')} as double) as order_day,
         cast(substr(o_orderpriority, 1, 1) as double) as priority, coalesce(n_lines, 0.0) as n_lines,
         coalesce(sum_qty, 0.0) as sum_qty, coalesce(avg_discount_pct, 0.0) as avg_discount_pct
  from orders left join (
    select l_orderkey, cast(count(*) as double) as n_lines,
           cast(sum(cast(round(l_quantity) as bigint)) as double) as sum_qty,
           cast(sum(cast(round(l_discount * 100) as bigint)) as double) / cast(count(*) as double) as avg_discount_pct
    from lineitem group by l_orderkey) on o_orderkey = l_orderkey)"""

DOC_QUALITY = r"""doc_words as (
  select d.doc_id, quality, lang, text, n_chars,
         regexp_extract_all(text, '[0-9A-Za-z]+') as words
  from documents d join labels l on d.doc_id = l.doc_id),
doc_quality as (
  select doc_id as id, cast(quality as int) as label, lang, cast(n_chars as double) as n_chars,
         cast(len(words) as double) as n_words,
         cast(length(text) - length(replace(text, chr(10), '')) as double) + 1.0 as n_lines,
         cast(length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) as double) / cast(greatest(length(text), 1) as double) as digit_ratio,
         cast(length(text) - length(regexp_replace(text, '[.,;:!?]', '', 'g')) as double) / cast(greatest(length(text), 1) as double) as punct_ratio,
         cast(len(list_distinct(words)) as double) / greatest(cast(len(words) as double), 1.0) as uniq_word_ratio
  from doc_words)"""


def _hits(needle: str) -> str:
    return f"cast((length(html) - length(replace(html, '{needle}', ''))) / {len(needle)} as double)"


PAGE_URLS = f"""page_hosts as (
  select *, regexp_extract(url, '^[a-z]+://([^/]+)', 1) as host from pages),
page_urls as (
  select page_id as id, cast(not starts_with(url, 'https://') as int) as label,
         cast(length(url) as double) as url_length, cast(starts_with(url, 'https://') as double) as is_https,
         cast(greatest(length(host) - length(replace(host, '.', '')) - 1, 0) as double) as n_subdomain,
         cast(regexp_matches(host, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$') as double) as is_ip,
         {_hits('<iframe')} as n_iframe, {_hits('window.open')} as n_popup,
         {_hits('href="http')} as external_refs, {_hits('href="/')} as self_refs,
         {_hits('href="#')} as empty_refs, {_hits('<form')} as n_form, {_hits('<script')} as n_script,
         {_hits('<img')} as n_img
  from page_hosts)"""

_PROXIES = ", ".join(
    f"""case when {u(f"'{n}_reveal|' || id")} < {s} then cast(label as double)
        else floor({u(f"'{n}_coin|' || id")} * 2) end as {n}""" for n, s in PROXY_STRENGTHS.items())
PLANTED = f"""planted as (
  select id, label,
         case when label = 0 or {u("'edge|' || id")} < 0.0078 then 100.0
              else floor({u("'mass|' || id")} * 1000) / 10.0 end as leak_point_mass,
         floor({u("'disjoint|' || id")} * 50) + case when label = 0 then 50.0 else 0.0 end as leak_disjoint,
         floor({u("'overlap|' || id")} * 60) + case when label = 0 then 40.0 else 0.0 end as overlap_strong,
         {u("'noise|' || id")} as noise, {_PROXIES}
  from (select o_orderkey as id, cast(o_orderstatus = 'F' as int) as label from orders))"""


def concept(side: str) -> str:
    pos = {"a": 0, "b": 1}[side]
    cols = ", ".join(
        f"""floor({u(f"'{n}_{side}|' || id")} * 60) + case when label = {1 if s[pos] >= 0 else 0}
            and {u(f"'{n}_{side}_link|' || id")} < {abs(s[pos])} then 40.0 else 0.0 end as {n}"""
        for n, s in CONCEPT_STRENGTHS.items())
    return f"""concept_{side} as (select id, label, {cols} from (
      select o_orderkey as id, cast(o_orderstatus = 'F' as int) as label from orders where o_orderkey % 2 = {pos}))"""


CONCEPTS = concept("a") + ",\n" + concept("b")

DUP_EVENTS = """dup_events as (
  select event_id as id, cast(event_type = 'error' as int) as label,
         floor(value / 50.0) as value_band,
         cast(cast(json_extract_string(props, '$.k') as bigint) % 3 as double) as k_mod,
         cast(user_id % 4 as double) as user_mod
  from events)"""

EVENT_LOG = """event_log as (
  select 'run_' || (user_id % 8) || '.log' as file, event_id as line_no,
         strftime(ts, '%H:%M:%S') || ' | INFO | job.' || event_type || ' | iter=' || (event_id % 100)
           || ' fit_centis=' || cast(round(value * 100) as bigint) as text, ts
  from events)"""

FEATURES = {
    "line_returned": ["quantity", "extendedprice", "discount", "tax", "linenumber", "ship_day"],
    "order_status": ["totalprice", "order_day", "priority", "n_lines", "sum_qty", "avg_discount_pct"],
    "doc_quality": ["n_chars", "n_words", "n_lines", "digit_ratio", "punct_ratio", "uniq_word_ratio"],
    "page_urls": ["url_length", "n_subdomain", "is_ip", "n_iframe", "n_popup", "external_refs",
                  "self_refs", "empty_refs", "n_form", "n_script", "n_img"],
    "planted": ["leak_point_mass", "leak_disjoint", "overlap_strong", "noise", *PROXY_STRENGTHS],
    "concept_a": list(CONCEPT_STRENGTHS),
    "concept_b": list(CONCEPT_STRENGTHS),
    "dup_events": ["value_band", "k_mod", "user_mod"],
}
SQL = {"line_returned": LINE_RETURNED, "order_status": ORDER_STATUS, "doc_quality": DOC_QUALITY,
       "page_urls": PAGE_URLS, "planted": PLANTED, "concept_a": concept("a"), "concept_b": concept("b"),
       "dup_events": DUP_EVENTS, "event_log": EVENT_LOG}


def long(view: str, name: str = "long", carry: str = "", features=None) -> str:
    """CTE unpivoting a view into (id, label, feature, value)."""
    carry = f", {carry}" if carry else ""
    parts = " union all ".join(
        f"select id, label{carry}, '{f}' as feature, cast({f} as double) as value from {view}"
        for f in (features or FEATURES[view]))
    return f"{name} as ({parts})"


def query(views: list[str], *ctes: str, select: str) -> str:
    return "with " + ",\n".join([SQL[v] for v in views] + list(ctes)) + "\n" + select
