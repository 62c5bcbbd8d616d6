"""SQL for transfer, faithfulness, timing logs and reports."""

from labelwatch.sources.views import CONCEPT_STRENGTHS
from oracles.agreement import boot_cte, interval_sql, rho_cte
from oracles.leakage import VIEW_NAMES, all_trees, counts_cte, split_cte, threshold_cte
from oracles.verdicts import METRICS, linear_cte, rates_sql
from oracles.views import FEATURES, long, query, u

SEEDS = (42, 43)
CV = ["concept_a", "concept_b"]

_POL = [long("concept_a", "la"), long("concept_b", "lb"),
        "prow as (select 'a' as dataset, *, label as attribution from la union all select 'b', *, label from lb)",
        rho_cte("prow", "dataset"),
        """pol0 as (select feature as concept, max(direction) filter (dataset = 'a') as ra, max(direction) filter (dataset = 'b') as rb from rho group by feature)""",
        """pol as (select concept, round(ra, 6) + 0.0 as rho_a, round(rb, 6) + 0.0 as rho_b, status = 'agrees' as direction_agrees, status from (select *,
           case when abs(ra) < 0.02 and abs(rb) < 0.02 then 'NO_SIGNAL_BOTH' when abs(rb) < 0.02 then 'NO_SIGNAL_B' when abs(ra) < 0.02 then 'NO_SIGNAL_A'
                when sign(ra) = sign(rb) then 'agrees' else 'INVERTED' end as status from pol0))"""]


def pol_query(select, *more):
    return query(CV, *_POL, *more, select=select)


def _matrix_ctes():
    ctes, parts = [], []
    for seed in SEEDS:
        for w in CV:
            ctes += [split_cte(w, f"s_{w}_{seed}", seed), linear_cte(w, f"s_{w}_{seed}", f"lin_{w}_{seed}")]
        for src in CV:
            for dst in CV:
                score = " + ".join(f"w_{f} * ({f} - m_{f}) / sd_{f}" for f in sorted(FEATURES[src]))
                parts.append(f"select '{src[-1]}->{dst[-1]}' as direction, {seed} as seed, label, round({score}, 6) + 0.0 as score "
                             f"from s_{dst}_{seed}, lin_{src}_{seed}_w where split = 'test'")
    ctes.append("pred as (select *, cast(score >= 0 as int) as prediction from (" + " union all ".join(parts) + "))")
    ctes.append(rates_sql(keys="direction, seed"))
    ctes.append("""maj as (select direction, seed, round(greatest(r, 1 - r), 6) as majority_accuracy, round(a - greatest(r, 1 - r), 6) + 0.0 as accuracy_above_majority
      from (select direction, seed, avg(cast(label as double)) as r, avg(cast(label = prediction as double)) as a from pred group by 1, 2))""")
    ctes.append("matrix as (select * from scored join maj using (direction, seed))")
    return ctes


def _sufficiency():
    f = sorted(FEATURES["planted"])
    ctes, parts = [], []
    for seed in SEEDS:
        s, lin = f"s_{seed}", f"lin_{seed}"
        ctes += [split_cte("planted", s, seed), linear_cte("planted", s, lin)]
        ctes.append(f"wt_{seed} as (select feature, row_number() over (order by abs(w) desc, feature) as pos from ("
                    + " union all ".join(f"select '{x}' as feature, w_{x} as w from {lin}_w" for x in f) + "))")
        ctes.append(f"wide_{seed} as (select " + ", ".join(f"max(pos) filter (feature = '{x}') as p_{x}" for x in f)
                    + f", string_agg(feature, '; ' order by pos) as o, list(feature order by pos) as names from wt_{seed})")
        for k in (3, 5, 10):
            inside = " + ".join(f"case when p_{x} <= {k} then w_{x} * ({x} - m_{x}) / sd_{x} else 0.0 end" for x in f)
            outside = " + ".join(f"case when p_{x} > {k} then w_{x} * ({x} - m_{x}) / sd_{x} else 0.0 end" for x in f)
            full = " + ".join(f"w_{x} * ({x} - m_{x}) / sd_{x}" for x in f)
            hit = "avg(cast(cast(round({e}, 6) >= 0 as int) = label as double))"
            parts.append(f"select 'planted' as dataset, {k} as k, {seed} as seed, array_to_string(any_value(names)[1:{k}], '; ') as top_k_features, "
                         f"{hit.format(e=full)} as f, {hit.format(e=inside)} as s, {hit.format(e=outside)} as c "
                         f"from {s}, {lin}_w, wide_{seed} where split = 'test'")
    ctes.append("suf as (select dataset, k, seed, top_k_features, round(f, 6) as full_accuracy, round(s, 6) as sufficiency_accuracy, round(c, 6) as comprehensiveness_accuracy, "
                "round(s / f, 6) as performance_retained, round(f - c, 6) + 0.0 as performance_lost from (" + " union all ".join(parts) + "))")
    return ctes


def _inject(out="inj"):
    prox = ", ".join(
        f"""case when {u(f"concat_ws('|', 'reveal', 42, '{s}', a.id)")} < {s} then cast(label as double)
            else floor({u(f"concat_ws('|', 'coin', 42, '{s}', a.id)")} * 2) end as proxy_{int(round(s * 100)):02d}""" for s in (0.05, 0.25, 0.5))
    return f"""{out} as (select a.id, a.label, permuted_copy,
      sqrt(-2.0 * ln(1.0 - {u("concat_ws('|', 'normal_1', 42, a.id)")})) * cos(6.283185307179586 * {u("concat_ws('|', 'normal_2', 42, a.id)")}) as pure_noise, {prox}
    from (select *, row_number() over (order by md5(concat_ws('|', 'slot', 42, id)), id) as k from order_status) a
    join (select totalprice as permuted_copy, row_number() over (order by md5(concat_ws('|', 'donor', 42, id)), id) as k from order_status) b using (k))"""


_INJ_COLS = ["permuted_copy", "pure_noise", "proxy_05", "proxy_25", "proxy_50"]
_RANKS = [_inject(), long("inj", "il", features=_INJ_COLS), counts_cte("il", "ivc"), threshold_cte("ivc", "ibest"),
          long("order_status", "gl"), counts_cte("gl", "gvc"), threshold_cte("gvc", "gbest"),
          """rnk as (select i.feature as strategy, i.balanced_accuracy as injected_accuracy, count(*) filter (g.balanced_accuracy > i.balanced_accuracy) + 1 as injected_rank,
             count(*) + 1 as n_features, count(*) filter (g.balanced_accuracy > i.balanced_accuracy) = 0 as reached_rank_1
             from ibest i, gbest g group by i.feature, i.balanced_accuracy)"""]

_SHAPE = "^([0-9]{2}:[0-9]{2}:[0-9]{2}) [|] [A-Z]+ [|] ([A-Za-z_.]+) [|] (.*)$"
_LOG = [f"""ex as (select file, line_no, ts, regexp_extract(text, '{_SHAPE}', 1) as clock, regexp_extract(text, '{_SHAPE}', 2) as logger,
    cast(regexp_extract(text, 'iter=([0-9]+)', 1) as int) as iteration, cast(regexp_extract(text, 'fit_centis=([0-9]+)', 1) as double) / 100.0 as fit_seconds
  from event_log where regexp_matches(text, '{_SHAPE}'))""",
  "sec as (select *, cast(substr(clock, 1, 2) as int) * 3600 + cast(substr(clock, 4, 2) as int) * 60 + cast(substr(clock, 7, 2) as int) as second from ex)",
  """dd as (select * exclude (fell), cast(sum(fell) over (partition by file order by line_no) as int) as day from (
     select *, case when second < lag(second) over (partition by file order by line_no) then 1 else 0 end as fell from sec))""",
  """win as (select file, day, line_no, iteration, fit_seconds, cast(coalesce(prev, greatest(second - (ceil(fit_seconds) + 30), 0)) as int) as start, second as "end", prev is null as window_reconstructed, cast(ts as date) as dt
     from (select *, lag(second) over (partition by file, day order by line_no) as prev from dd where logger = 'job.purchase'))""",
  """con as (select w.*, coalesce((select string_agg(distinct case logger when 'job.error' then 'errors' else 'signups' end, ';' order by case logger when 'job.error' then 'errors' else 'signups' end)
     from dd e where e.file = w.file and e.day = w.day and e.logger in ('job.error', 'job.signup') and e.second between w.start and w."end"), '') as jobs from win w)""",
  """cost as (select c.*, coalesce(clean_seconds, fit_seconds) as seconds, clean_seconds is not null as remeasured_clean, clean_seconds is null and fit_seconds < 1.0 as cache_replay,
     clean_seconds is null and jobs <> '' as contended, not (clean_seconds is null and fit_seconds < 1.0) and not (clean_seconds is null and jobs <> '') as eligible
     from con c left join (select file, iteration, min(fit_seconds) as clean_seconds from ex where logger = 'job.click' and fit_seconds >= 100 group by 1, 2) r
       on c.file = r.file and c.iteration = r.iteration)""",
  "pref as (select * from (select *, row_number() over (partition by file, iteration order by cache_replay, line_no) as rn from cost) where rn = 1)",
  """prof as (select file, iteration, seconds, eligible, 'log' as source from pref union all
     select file, iteration, max(fit_seconds), null, 'screening' from ex where logger = 'job.view' group by 1, 2)"""]


def log_query(select, *more):
    return query(["event_log"], *_LOG, *more, select=select)


def _summary():
    ml = "mlong as (" + " union all ".join(f"select direction, seed, '{m}' as metric, cast({m} as double) as v from matrix" for m in METRICS) + ")"
    return query(CV, *_matrix_ctes(), ml, boot_cte("mlong", "direction, metric", ["v"], "seed", 1000),
                 "st as (select direction, metric, rep, avg(v) as stat from boot group by 1, 2, 3)", interval_sql("st", "direction, metric", None),
                 select="""select direction, metric, n_seeds, std, mean, ci_lower, ci_upper from iv join (select direction, metric, count(*) as n_seeds,
                 round(coalesce(stddev_samp(v), 0.0), 6) + 0.0 as std, round(avg(v), 6) + 0.0 as mean from mlong group by 1, 2) using (direction, metric)""")


_MAPPED = ", ".join(f"('{c}', 'mapped', '{c}', '{c.upper()}', 'same quantity')" for c in CONCEPT_STRENGTHS if c != "form_target")
_SOURCES = """(values ('script_weight', 'n_script'), ('picture_mix', 'n_img'), ('picture_mix', 'n_script'), ('link_reach', 'self_refs'),
  ('link_reach', 'external_refs'), ('dead_links', 'empty_refs'), ('host_shape', 'n_subdomain'), ('host_shape', 'is_ip')) s(concept, feature)"""

ORACLES = {
    "polarity": pol_query("select * from pol"),
    "directional_inconsistency": pol_query("""select *, greatest(abs(rho_a), abs(rho_b)) as importance_weight,
        not direction_agrees and greatest(abs(rho_a), abs(rho_b)) >= 0.5 as headline from pol"""),
    "concept_mapping_table": pol_query(f"""select m.*, rho_a, rho_b, direction_agrees, status from (values {_MAPPED}, ('', 'unmapped_a', 'form_target', '', 'no counterpart'),
        ('', 'unmapped_b', '', 'FORM_TARGET', 'no counterpart')) m(concept, mapping, column_a, column_b, reason) left join pol on m.concept = pol.concept"""),
    "concept_loss": query(["page_urls"], long("page_urls"), "alive as (select feature from long group by feature having min(value) < max(value))", select=f"""
        select concept, n_sources, n_alive, case when n_alive = n_sources then 'kept' else 'lost' end as status,
          case when n_alive = n_sources then '' else 'removed as leaking: ' || gone end as reason from (
        select concept, count(*) as n_sources, count(a.feature) as n_alive, string_agg(s.feature, '; ' order by s.feature) filter (a.feature is null) as gone
        from {_SOURCES} left join alive a on s.feature = a.feature group by concept)"""),
    "transfer_matrix": query(CV, *_matrix_ctes(), select="select * from matrix"),
    "transfer_summary": _summary(),
    "transfer_verdict": query(CV, *_matrix_ctes(), select="""select *, case when accuracy_above_majority <= 0.02 and roc_auc < 0.65 then 'no transfer'
        when accuracy_above_majority <= 0.02 then 'mixed' else 'transfers' end as verdict, mcc < -0.02 as anti_correlated from (
        select direction, round(avg(accuracy_above_majority), 6) + 0.0 as accuracy_above_majority, round(avg(roc_auc), 6) as roc_auc, round(avg(mcc), 6) + 0.0 as mcc from matrix group by 1)"""),
    "rule_sufficiency": query(["planted"], *_sufficiency(), select="select * from suf"),
    "faithfulness_summary": query(["planted"], *_sufficiency(), select="""select *, k = 3 and performance_retained > 0.99 as few_features_suffice from (
        select dataset, k, count(*) as n_seeds, round(avg(performance_retained), 6) as performance_retained, round(avg(performance_lost), 6) + 0.0 as performance_lost,
          round(avg(full_accuracy), 6) as full_accuracy from suf group by 1, 2)"""),
    "inject_feature": query(["order_status"], _inject(), select="select * replace (round(pure_noise, 6) + 0.0 as pure_noise) from inj"),
    "injection_rank": query(["order_status"], *_RANKS, select="select * from rnk"),
    "lowest_winning_strength": query(["order_status"], *_RANKS, select="""select count(*) filter (reached_rank_1) as n_reached,
        min(cast(substr(strategy, 7) as int) / 100.0) filter (reached_rank_1) as lowest_strength from rnk where strategy like 'proxy%'"""),
    "resume_pending": "select o_orderkey as cell, 42 as seed from orders where o_orderkey not in (select l_orderkey from lineitem)",
    "log_extract": log_query("select file, line_no, clock, logger, iteration, fit_seconds from ex"),
    "day_index": log_query("select file, line_no, day, second from dd"),
    "iteration_windows": log_query('select file, day, line_no, iteration, fit_seconds, start, "end", window_reconstructed from win'),
    "contention_join": log_query("select file, day, line_no, jobs from con"),
    "load_in_window": log_query("""select w.file, w.day, w.line_no, floor(cast(2 * sum(cast(round(value * 100) as bigint)) + count(e.ts) as double) / cast(2 * nullif(count(e.ts), 0) as double)) / 100.0 as cpu_mean, max(value) as cpu_max, max(user_id % 8) as procs_max, count(e.ts) as n_samples,
        case when count(e.ts) = 0 then null when bool_or(user_id % 3 = 2) then 'search;train' when bool_or(user_id % 3 = 0) then 'train' else '' end as tags
        from win w left join events e on e.event_type = 'view' and cast(e.ts as date) = w.dt and hour(e.ts) * 3600 + minute(e.ts) * 60 + second(e.ts) between w.start and w."end"
        group by 1, 2, 3"""),
    "cost_eligibility": log_query("select file, line_no, iteration, seconds, remeasured_clean, cache_replay, contended, eligible from cost"),
    "eligibility_counts": log_query("""select file, count(*) as n_iterations, count(*) filter (cache_replay) as n_cache_replay, count(*) filter (contended) as n_contended,
        count(*) filter (eligible) as n_eligible from cost group by 1"""),
    "prefer_measured": log_query("select file, iteration, line_no, seconds, cache_replay from pref"),
    "cost_profile": log_query("select * from prof"),
    "cost_curve": log_query("""select f.file, coalesce(n_eligible, 0) as n_eligible, seconds_min, seconds_max, round(seconds_max / seconds_min, 6) as fold, lb as fold_full_range_lower_bound, n_decreasing_steps,
        n_decreasing_steps = 0 as monotonic, round(case when hi <> 0 then span / hi else 0.0 * hi end, 6) as tail_spread, case when hi <> 0 then span / hi else 0.0 * hi end < 0.10 as plateau,
        case when coalesce(n_eligible, 0) < 3 then 'fewer than 3 eligible iterations' end as note
        from (select file, round(case when min(seconds) <> 0 then max(seconds) / min(seconds) end, 6) as lb from prof where source = 'log' group by file) f
        left join (select file, count(*) as n_eligible, case when count(*) >= 3 then min(seconds) end as seconds_min, case when count(*) >= 3 then max(seconds) end as seconds_max,
            case when count(*) >= 3 then count(*) filter (seconds < prev) end as n_decreasing_steps,
            case when count(*) >= 3 then max(seconds) filter (re <= 3) - min(seconds) filter (re <= 3) end as span, case when count(*) >= 3 then max(seconds) filter (re <= 3) end as hi from (
            select *, lag(seconds) over (partition by file order by iteration) as prev, row_number() over (partition by file order by iteration desc) as re
            from prof where source = 'log' and eligible) group by file) c on c.file = f.file"""),
    "top_features": query(VIEW_NAMES, *all_trees(), select="""select dataset, rank, feature, accuracy from (
        select *, row_number() over (partition by dataset order by accuracy desc, feature) as rank from scores) where rank <= 15"""),
    "missing_tables": """select * from (values ('t_click', 'no event of type click was logged'), ('t_error', 'no event of type error was logged'),
        ('t_refund', 'no event of type refund was logged'), ('t_view', 'no event of type view was logged')) e(table_name, reason)
        where table_name not in (select 't_' || event_type from events)""",
    "display_names": """with n(key, display) as (values ('src0', 'Source Zero'), ('src1', 'Source One'), ('en', 'English'), ('fr', 'French'))
        select doc_id, case when doc_id % 3 = 0 then coalesce(a.display, source) when doc_id % 3 = 1 and a.display is not null and b.display is not null
          then a.display || ' -> ' || b.display when doc_id % 3 = 1 then source || '->' || lang else 'about ' || source end as cell
        from documents left join n a on source = a.key left join n b on lang = b.key""",
    "sig_figs": """select p_partkey, case when x = 0 then 0.0 else round(x * pow(10.0, 3.0 - floor(log10(abs(x))))) / pow(10.0, 3.0 - floor(log10(abs(x)))) end as x
        from (select p_partkey, p_retailprice * 12.3456789 as x from part)""",
}
