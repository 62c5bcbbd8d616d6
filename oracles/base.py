"""SQL for sources, label preparation, duplicates and splits."""

PRIVATE = {"phone": "[+][0-9]{1,3} [(][0-9]{3}[)] [0-9]{3}-[0-9]{4}", "mailbox": "[a-z0-9][a-z0-9._]*@mail[0-9]*[.][a-z.]+",
           "address": "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}", "access_key": "AKIA[A-Z0-9]{12,}",
           "tracker": "track[(][0-9]+[)]"}
from oracles.leakage import split_cte
from oracles.views import FEATURES, SQL, long, query


def _missing(table, name, cols):
    return " union all ".join(
        f"select '{name}' as dataset, 'missing' as kind, '{c}' as item, count(*) - count({c}) as n, "
        f"round(100.0 * (count(*) - count({c})) / count(*), 6) as percent from {table}" for c in cols)


ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]

_INVENTORY = """inv as (
  select 'orders' as dataset, coalesce(c.column_name, d.column_name) as column_name, d.column_name is not null as in_delivery,
    coalesce(role, '<unknown>') as role, coalesce(declared_type, '<unknown>') as declared_type, coalesce(n_missing, -1) as n_missing,
    case when d.column_name is null then 'not_delivered' when d.column_name = 'o_orderstatus' then 'label'
         when d.column_name in ('o_totalprice', 'o_orderdate') then 'retained' else 'dropped' end as status,
    case when d.column_name is null then 'declared with role ' || role || ' but absent from the delivery'
         when d.column_name = 'o_orderstatus' then 'target variable, 1 = positive'
         when d.column_name in ('o_totalprice', 'o_orderdate') then ''
         when d.column_name = 'o_orderkey' then 'row identifier' when d.column_name = 'o_custkey' then 'customer identifier'
         else 'dropped during preparation' end as reason
  from (values ('o_orderkey', 'ID', 'Integer'), ('o_custkey', 'ID', 'Integer'), ('o_orderstatus', 'Target', 'Categorical'),
    ('o_totalprice', 'Feature', 'Continuous'), ('o_orderdate', 'Feature', 'Date'), ('o_clerk', 'Other', 'Categorical'))
    as c(column_name, role, declared_type)
  full join (""" + " union all ".join(
      f"select '{c}' as column_name, count(*) - count({c}) as n_missing from orders" for c in ORDER_COLS) + """) d
  on c.column_name = d.column_name)"""


def _audit(view, name=None):
    f = ", ".join(FEATURES[view])
    return f"""select '{view}' as dataset, cast(sum(n) as bigint) as n_rows, cast(sum(exact) as bigint) as exact_duplicates,
      cast(sum(n - 1) as bigint) as feature_duplicates, cast(sum(n - 1) - sum(exact) as bigint) as conflicting_duplicates,
      count(*) filter (k > 1) as conflicting_vectors,
      round(cast(sum(exact) as double) / sum(n), 6) as duplicate_rate
    from (select {f}, sum(n) as n, count(*) as k, sum(n - 1) as exact
      from (select {f}, label, count(*) as n from {view} group by all) group by {f})"""


def _characteristics():
    views = ["line_returned", "order_status", "dup_events"]
    return query(views, select=" union all ".join(
        f"""select '{v}' as dataset, a.n_rows, {len(FEATURES[v])} as n_features, positive_rate, exact_duplicates, duplicate_rate
        from ({_audit(v)}) a, (select round(avg(cast(label as double)), 6) as positive_rate from {v})""" for v in views))


def ranked(view, key, out="r"):
    return f"""{out} as (select *, row_number() over (partition by label order by md5({key}), id) as rk,
      count(*) over (partition by label) as tot from {view})"""


def sample_cte(view, n, key, out="sample"):
    return f"""{ranked(view, key, out + '_r')},
{out} as (select * exclude (rk, tot) from (select * from {out}_r
     where rk <= greatest(1, floor(cast(least({n}, (select count(*) from {view})) as double) * cast(tot as double)
          / cast((select count(*) from {view}) as double) + 0.5))
     order by rk, label, id limit {n}))"""


def scaler_cte(source, out="scaler"):
    return f"""{out} as (select feature, avg(value) as mean, case when stddev_pop(value) > 0 then stddev_pop(value) else 1.0 end as std,
      count(*) as n_fit from {source} where split = 'train' group by feature)"""


def _scaled(rows, scaler):
    return f"""select {rows}.feature, split, count(*) as n, round(avg((value - mean) / std), 6) + 0.0 as mean_scaled,
    round(stddev_pop((value - mean) / std), 6) as std_scaled, round(max((value - mean) / std), 6) as max_scaled
    from {rows} join {scaler} on {rows}.feature = {scaler}.feature group by 1, 2"""


def distribution_cte(views, out="dist"):
    parts = " union all ".join(f"select '{v}' as dataset, feature as concept, value, label from long_{v}" for v in views)
    return ",\n".join([long(v, f"long_{v}") for v in views] + [f"""{out} as (select dataset, concept, value, count(*) as n,
      round(cast(count(*) as double) / sum(count(*)) over (partition by dataset, concept), 6) as share,
      round(avg(cast(label as double)), 6) as positive_rate from ({parts}) group by dataset, concept, value)"""])


def _forbidden():
    cells = [("documents", "doc_id", "text"), ("pages", "page_id", "url"), ("pages", "page_id", "html")]
    out = []
    for t, i, c in cells:
        for k, p in PRIVATE.items():
            out.append(f"select '{t}' as table_name, {i} as id, '{c}' as column_name, '{k}' as pattern, "
                       f"regexp_extract({c}, '{p}') as first_match from {t} where regexp_matches({c}, '{p}')")
    return " union all ".join(out)


_CONCEPT_COLS = """case when n_script <= 0 then 1 when n_script <= 2 then 0 else -1 end as script_weight,
  cast(sign(n_img - n_script) as int) as picture_mix, cast(sign(self_refs - external_refs) as int) as link_reach,
  case when empty_refs <= 0 then 1 when empty_refs <= 3 then 0 else -1 end as dead_links,
  case when is_ip = 1 then -1 when n_subdomain = 0 then 1 else 0 end as host_shape"""
_RATIO = """rated as (select *, case when external_refs + self_refs + empty_refs > 0
   then external_refs / (external_refs + self_refs + empty_refs) else 0.0 end as ratio from page_urls)"""

_ROWS = "select 'events' as dataset"

ORACLES = {
    "src_parquet": """select l_returnflag, l_linestatus, count(*) as n, round(avg(l_discount), 6) as avg_discount
        from lineitem where l_quantity >= 45 group by 1, 2""",
    "src_csv": "select o_orderstatus, o_orderpriority, count(*) as n, max(o_totalprice) as max_price from orders group by 1, 2",
    "src_json": "select c_mktsegment, count(*) as n, min(c_acctbal) as min_balance from customer group by 1",
    "sink_table": "select event_type, count(*) as n, max(event_id) as last_id from events group by 1",
    "dataset_profile": _missing("orders", "orders", ORDER_COLS) + """ union all
        select 'orders', 'class', coalesce(o_orderstatus, '<missing>'), count(*), round(100.0 * count(*) / sum(count(*)) over (), 6)
        from orders group by o_orderstatus""",
    "shape_check": """select 'lineitem' as dataset, count(*) as n_rows, cast(60000 as bigint) as expected_rows, 10 as n_features,
        10 as expected_features, count(*) = 60000 as matches from lineitem""",
    "feature_inventory": "with " + _INVENTORY + " select * from inv",
    "feature_inventory_counts": "with " + _INVENTORY + " select dataset, status, count(*) as n_columns from inv group by 1, 2",
    "dataset_characteristics": _characteristics(),
    "harmonise_labels": "select o_orderkey, case when o_orderstatus = 'F' then 1 else 0 end as label from orders",
    "label_report": """select 'orders' as dataset, count(*) as n_rows, count(*) filter (o_orderstatus not in ('F', 'O', 'P')) as n_unexpected,
        round(avg(cast(o_orderstatus = 'F' as double)), 6) as positive_rate, cast(0.33 as double) as published_rate,
        abs(avg(cast(o_orderstatus = 'F' as double)) - 0.33) <= 0.01 as accepted from orders""",
    "label_policy": """select o_orderkey, 'merge' as policy, cast(o_orderstatus in ('F', 'P') as int) as label from orders
        union all select o_orderkey, 'drop', cast(o_orderstatus = 'F' as int) from orders where o_orderstatus <> 'P'""",
    "label_policy_report": """select 'merge' as policy, count(*) as n_before, count(*) as n_after, count(*) filter (o_orderstatus = 'P') as n_intermediate,
        round(avg(cast(o_orderstatus in ('F', 'P') as double)), 6) as positive_rate from orders
        union all select 'drop', count(*), count(*) filter (o_orderstatus <> 'P'), count(*) filter (o_orderstatus = 'P'),
        round(avg(cast(o_orderstatus = 'F' as double)) filter (o_orderstatus <> 'P'), 6) from orders""",
    "label_value_match": "select event_id, cast(event_type = 'error' as int) as label from events",
    "drop_identifiers": "select c_nationkey, c_acctbal from customer",
    "drop_report": """select 'c_custkey' as column_name, false as kept, 'identifier' as reason, count(c_custkey) as n_filled from customer
        union all select 'c_name', false, 'identifier', count(c_name) from customer
        union all select 'c_nationkey', true, '', count(c_nationkey) from customer
        union all select 'c_acctbal', true, '', count(c_acctbal) from customer
        union all select 'c_mktsegment', false, 'not numeric', count(c_mktsegment) from customer""",
    "select_features": query(["order_status"], select="select id, label, totalprice, n_lines from order_status"),
    "shared_names": query(["concept_a", "concept_b"], select=" union all ".join(
        f"""select '{f}' as name, '{f}' as name_a, '{f.upper()}' as name_b, (select count(*) - count({f}) from concept_a) as n_missing_a,
        (select count(*) - count({f}) from concept_b) as n_missing_b""" for f in FEATURES["concept_a"])),
    "concept_project": query(["page_urls"], _RATIO, select=f"select id, label, {_CONCEPT_COLS} from rated"),
    "bin_thresholds": query(["page_urls"], select="""select id, url_length, case when url_length < 54 then 1 when url_length <= 75 then 0 else -1 end as length_bin,
        n_subdomain, case when n_subdomain <= 1 then 1 when n_subdomain <= 2 then 0 else -1 end as depth_bin from page_urls"""),
    "ratio_bin": query(["page_urls"], _RATIO, select="""select id, round(ratio, 6) as external_ratio,
        case when ratio < 0.31 then 1 when ratio <= 0.67 then 0 else -1 end as ratio_bin from rated"""),
    "forbidden_content_scan": _forbidden(),
    "duplicate_audit": query(["dup_events"], select=_audit("dup_events")),
    "dedup_keep_first": query(["dup_events"], select="""select id, label, value_band, k_mod, user_mod from (
        select *, row_number() over (partition by value_band, k_mod, user_mod, label order by id) as rn from dup_events) where rn = 1"""),
    "balance_shift": query(["dup_events"], select="""select 'dup_events' as dataset, rows_before, rows_after, round(b, 6) as rate_before,
        round(a, 6) as rate_after, round(abs(a - b), 6) as shift, abs(a - b) > 0.02 as shifted, abs(b - 0.2) <= 0.01 as matches_published
      from (select count(*) as rows_before, avg(cast(label as double)) as b from dup_events),
        (select count(*) as rows_after, avg(cast(label as double)) as a from (select distinct value_band, k_mod, user_mod, label from dup_events))"""),
    "train_twin_rate": query(["dup_events"], split_cte("dup_events"), select="""select 'dup_events' as dataset, count(*) as n_test,
        cast(sum(cast(twin as int)) as bigint) as n_with_twin, round(avg(cast(twin as double)), 6) as twin_rate from (
        select exists (select 1 from split_rows t where t.split = 'train' and t.value_band is not distinct from s.value_band
          and t.k_mod is not distinct from s.k_mod and t.user_mod is not distinct from s.user_mod) as twin
        from split_rows s where split = 'test')"""),
    "stratified_split": query(["line_returned"], split_cte("line_returned"), select="select id, label, split from split_rows"),
    "split_audit": query(["line_returned"], split_cte("line_returned"), select="""select split, count(*) as n_rows,
        round(avg(cast(label as double)), 6) as positive_rate,
        (select count(*) from (select id from split_rows group by id having count(distinct split) > 1)) as overlapping_ids,
        (select count(*) from (select id from split_rows group by id having count(*) > 1)) as repeated_ids
        from split_rows group by split"""),
    "stratified_halves": query(["order_status"], ranked("order_status", "concat_ws('|', 'half', 42, id)"),
                               select="select id, label, case when rk <= floor(tot * 0.5 + 0.5) then 'a' else 'b' end as half from r"),
    "stratified_sample": query(["line_returned"], sample_cte("line_returned", 2000, "concat_ws('|', 'sample', 42, id)"),
                               select="select id, label from sample"),
    "background_sample": query(["line_returned"], split_cte("line_returned"), "train as (select * from split_rows where split = 'train')",
                               sample_cte("train", 100, "concat_ws('|', 'sample', 42, id)"), select="select id, label from sample"),
    "stratified_folds": query(["order_status"], ranked("order_status", "concat_ws('|', 'fold', 42, id)"),
                              select="select id, label, cast(rk % 5 as int) as fold from r"),
    "standard_scale": query(["line_returned"], split_cte("line_returned"), long("split_rows", carry="split", features=FEATURES["line_returned"]),
                            scaler_cte("long"), select=_scaled("long", "scaler")),
    "standard_scale_zero_shot": query(
        ["concept_a", "concept_b"], split_cte("concept_a", "sa"), split_cte("concept_b", "sb"),
        long("sa", "la", "split", FEATURES["concept_a"]), long("sb", "lb", "split", FEATURES["concept_b"]),
        scaler_cte("la"), select=_scaled("lb", "scaler")),
    "scaler_table": query(["line_returned"], split_cte("line_returned"), long("split_rows", carry="split", features=FEATURES["line_returned"]),
                          scaler_cte("long"), select="select feature, round(mean, 4) as mean, round(std, 4) as std, n_fit from scaler"),
    "shared_distribution": query(["concept_a", "concept_b"], distribution_cte(["concept_a", "concept_b"]), select="select * from dist"),
    "shared_distribution_pivot": query(["concept_a", "concept_b"], distribution_cte(["concept_a", "concept_b"]), select="""
        select concept, value, max(positive_rate) filter (dataset = 'concept_a') as concept_a,
          max(positive_rate) filter (dataset = 'concept_b') as concept_b from dist group by 1, 2"""),
}
