"""SQL for removal curves, verdicts and scoring."""

from labelwatch.sources import views as v
from oracles.leakage import VIEW_NAMES, all_trees, counts_cte, split_cte, threshold_cte
from oracles.views import FEATURES, SQL, long, query


SEEDS = (42, 43, 44, 45, 46)


def curve_ctes(views=VIEW_NAMES, features=None, names=None, out="curve"):
    ctes, parts = [], []
    for w in views:
        feats = (features or FEATURES)[w]
        ctes += [long(w, f"cl_{w}", features=feats), counts_cte(f"cl_{w}", f"cv_{w}"), threshold_cte(f"cv_{w}", f"cb_{w}")]
        parts.append(f"select '{(names or {}).get(w, w)}' as dataset, {len(feats)} as nf, * from cb_{w}")
    ctes.append(f"""{out}_all as (select dataset, nf, feature as top_feature, accuracy, balanced_accuracy, f1,
       cast(row_number() over (partition by dataset order by balanced_accuracy desc, feature) - 1 as int) as iteration
       from ({' union all '.join(parts)}))""")
    ctes.append(f"""{out} as (select dataset, iteration, nf - iteration as n_features, top_feature, accuracy, balanced_accuracy, f1,
       case when accuracy < 0.99 or iteration >= 15 then '' else top_feature end as removed_feature
       from {out}_all a where iteration <= 15 and nf - iteration >= 2
         and not exists (select 1 from {out}_all b where b.dataset = a.dataset and b.iteration < a.iteration and b.accuracy < 0.99))""")
    return ctes


def screen_cte(curve="curve", out="screened"):
    return f"""{out} as (select *, case when verdict0 = 'repairable' then names else '' end as minimal_leaking_set from (
      select dataset, max(accuracy) filter (iteration = 0) as full_accuracy, arg_max(accuracy, iteration) as final_accuracy,
        count(*) filter (removed_feature <> '') as n_removed,
        case when max(accuracy) filter (iteration = 0) < 0.99 then 'clean' when arg_max(accuracy, iteration) < 0.99 then 'repairable'
             when max(iteration) >= 15 then 'unrepairable' else 'exhausted_features' end as verdict0,
        string_agg(removed_feature, '; ' order by iteration) filter (removed_feature <> '') as names
      from {curve} group by dataset))"""


SCREEN = "select dataset, full_accuracy, final_accuracy, n_removed, verdict0 as verdict, minimal_leaking_set from screened"

VERDICTS = """verdicts as (select dataset, threshold, case
     when full_acc < threshold then 'clean'
     when below <= 15 then 'repairable' when below is not null then 'unrepairable'
     when last >= 15 then 'unrepairable' else 'undetermined' end as verdict
   from (select dataset, threshold, max(accuracy) filter (iteration = 0) as full_acc,
       min(iteration) filter (accuracy < threshold) as below, max(iteration) as last
     from curve, (values (cast(0.97 as double)), (cast(0.98 as double)), (cast(0.99 as double)), (cast(0.995 as double))) t(threshold)
     group by dataset, threshold))"""
SENSITIVITY = """sensitivity as (select dataset, max(verdict) filter (threshold = 0.97) as verdict_at_0_97, max(verdict) filter (threshold = 0.98) as verdict_at_0_98,
     max(verdict) filter (threshold = 0.99) as verdict_at_0_99, max(verdict) filter (threshold = 0.995) as verdict_at_0_995,
     count(distinct verdict) filter (verdict <> 'undetermined') > 1 as verdict_changes from verdicts group by dataset)"""

ALL_FEATURES = "feats as (select * from (values " + ", ".join(
    f"('{w}', '{f}')" for w in VIEW_NAMES for f in FEATURES[w]) + ") t(dataset, feature))"

CURVES = curve_ctes()


def curve_query(select, *more):
    return query(VIEW_NAMES, *CURVES, *more, select=select)


def _policy_views():
    merged = """pol as (select p.* exclude (label), o_orderstatus from planted p join orders on p.id = o_orderkey),
      pm as (select *, cast(o_orderstatus in ('F', 'P') as int) as label from pol),
      pd as (select *, cast(o_orderstatus = 'F' as int) as label from pol where o_orderstatus <> 'P')"""
    return [merged] + curve_ctes(["pm", "pd"], {"pm": FEATURES["planted"], "pd": FEATURES["planted"]},
                                 {"pm": "orders", "pd": "orders__intermediate_dropped"}, "pcurve") + [screen_cte("pcurve", "pscreened")]


def steady(x):
    return f"(case when abs({x}) >= 1000 then round({x}, 2) else round({x}, 6) end + 0.0)"


def linear_cte(view, split, out, features=None):
    """Weights (mean1 - mean0) / std of the training rows and the resulting scores of all rows."""
    feats = features or FEATURES[view]
    tr = "filter (split = 'train')"
    sd = {f: f"case when {steady(f'stddev_pop({f}) {tr}')} > 0 then {steady(f'stddev_pop({f}) {tr}')} else 1.0 end" for f in feats}
    mean1, mean0 = "avg({f}) filter (split = 'train' and label = 1)", "avg({f}) filter (split = 'train' and label = 0)"
    w = ", ".join(f"{steady('((' + mean1.format(f=f) + ' - ' + mean0.format(f=f) + ') / ' + sd[f] + ')')} as w_{f}, "
                  f"{steady(f'avg({f}) {tr}')} as m_{f}, {sd[f]} as sd_{f}" for f in feats)
    score = " + ".join(f"w_{f} * ({f} - m_{f}) / sd_{f}" for f in sorted(feats))
    return f"""{out}_w as (select {w} from {split}),
{out} as (select s.*, round({score}, 6) + 0.0 as score from {split} s, {out}_w)"""


def predictions_ctes(seeds=(42,), views=("order_status", "planted"), out="pred"):
    ctes, parts = [], []
    for w in views:
        for seed in seeds:
            ctes += [split_cte(w, f"s_{w}_{seed}", seed), linear_cte(w, f"s_{w}_{seed}", f"lin_{w}_{seed}")]
            parts.append(f"select '{w}' as config, 'linear' as model, {seed} as seed, id, label, score from lin_{w}_{seed} where split = 'test'")
    ctes.append(f"{out} as (select *, 1.0 / (1.0 + exp(-score)) as probability, cast(score >= 0 as int) as prediction from ("
                + " union all ".join(parts) + "))")
    return ctes


def rates_sql(pred="pred", keys="config, model, seed"):
    return f"""conf as (select {keys}, cast(count(*) filter (label = 1 and prediction = 1) as double) as tp, cast(count(*) filter (label = 0 and prediction = 1) as double) as fp,
      cast(count(*) filter (label = 1 and prediction = 0) as double) as fn, cast(count(*) filter (label = 0 and prediction = 0) as double) as tn
    from {pred} group by {keys}),
ranked as (select {keys}, label, rank() over (partition by {keys} order by score) + (count(*) over (partition by {keys}, score) - 1) / 2.0 as rk from {pred}),
auc as (select {keys}, round((sum(rk) filter (label = 1) - cast(count(*) filter (label = 1) as double) * (count(*) filter (label = 1) + 1) / 2.0)
      / (cast(count(*) filter (label = 1) as double) * count(*) filter (label = 0)), 6) as roc_auc from ranked group by {keys}),
scored as (select conf.* exclude (tp, fp, fn, tn), cast(tp + fp + fn + tn as bigint) as n, round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy,
      case when tp + fp > 0 then round(tp / (tp + fp), 6) else 0.0 end as precision, case when tp + fn > 0 then round(tp / (tp + fn), 6) else 0.0 end as recall,
      case when 2 * tp + fp + fn > 0 then round(2 * tp / (2 * tp + fp + fn), 6) else 0.0 end as f1,
      case when (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 then round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) + 0.0 else 0.0 end as mcc,
      roc_auc from conf join auc using ({keys}))"""


METRICS = ["accuracy", "precision", "recall", "f1", "mcc", "roc_auc"]
_SUMMARY = "select config, model, count(*) as n_seeds, " + ", ".join(
    f"round(avg({m}), 6) + 0.0 as {m}_mean, round(coalesce(stddev_samp({m}), 0.0), 6) + 0.0 as {m}_std" for m in METRICS)


def pred_query(select, *more, seeds=(42,)):
    return query(["order_status", "planted"], *predictions_ctes(seeds), *more, select=select)


def _vote():
    f = FEATURES["planted"]
    ctes = [split_cte("planted")]
    for i, names in ((1, f[2:]), (2, f[3:]), (3, f[4:])):
        ctes.append(linear_cte("planted", "split_rows", f"mem{i}", names))
    return query(["planted"], *ctes, "voted as (select a.id, a.label, (1.0 / (1.0 + exp(-a.score)) + 1.0 / (1.0 + exp(-b.score)) + 1.0 / (1.0 + exp(-c.score))) / 3.0 as pr "
                 "from mem1 a join mem2 b using (id) join mem3 c using (id) where a.split = 'test')",
                 select="select id, label, round(pr, 6) as probability, cast(pr >= 0.5 as int) as prediction from voted")


def _params():
    from oracles.base import _audit
    views = ["planted", "order_status", "dup_events"]
    audits = "audits as (" + " union all ".join(f"select * from ({_audit(w)})" for w in views) + ")"
    return query(["planted", "order_status", "dup_events"], audits,
                 "base as (select dataset, 'min_rows=' || greatest(1, cast(floor(n_rows / 1000.0) as bigint)) as params from audits)",
                 "own as (select dataset || '_full' as config, params from base where dataset in ('dup_events', 'planted'))",
                 """configs as (select dataset || '_dedup' as config, dataset, case when exact_duplicates = 0 then dataset || '_full' end as identical_to from audits
                    union all select dataset || '_full', dataset, null from audits)""", select="""
      select c.config, c.dataset, coalesce(o.params, t.params, b.params) as params,
        case when o.params is not null then 'config' when t.params is not null then 'identical config' when b.params is not null then 'dataset' else 'defaults' end as source
      from configs c left join own o on c.config = o.config left join own t on c.identical_to = t.config left join base b on c.dataset = b.dataset""")


ORACLES = {
    "progressive_removal_single": curve_query("select * from curve"),
    "curve_lead": curve_query("""select dataset, iteration, top_feature as top_feature_before,
        coalesce(lead(top_feature) over (partition by dataset order by iteration), '') as top_feature_after from curve"""),
    "feature_set_at_iteration": curve_query("""select dataset, iteration, feature, count(*) over (partition by dataset, iteration) = n_features as count_matches
        from (select f.dataset, f.feature, c.iteration, c.n_features from feats f join curve c on f.dataset = c.dataset
          where not exists (select 1 from curve g where g.dataset = f.dataset and g.removed_feature = f.feature and g.iteration < c.iteration))""", ALL_FEATURES),
    "removal_outcome": curve_query("""select dataset, n_removed, full_accuracy, final_accuracy, round(full_accuracy - final_accuracy, 6) + 0.0 as drop,
        case when final_accuracy >= 0.99 then 'not_deleaked' when final_accuracy < 0.80 then 'accuracy_collapse'
             when final_accuracy between 0.95 and 0.98 then 'usable_variant' else 'between' end as outcome
        from (select dataset, max(iteration) as n_removed, arg_min(accuracy, iteration) as full_accuracy, arg_max(accuracy, iteration) as final_accuracy
          from curve group by dataset)"""),
    "leakfree_features": curve_query("select dataset, feature from feats f where not exists (select 1 from curve c where c.dataset = f.dataset and c.removed_feature = f.feature)", ALL_FEATURES),
    "verdict_at": curve_query("select * from verdicts", VERDICTS),
    "verdict_sensitivity": curve_query("select * from sensitivity", VERDICTS, SENSITIVITY),
    "screen_rows": curve_query(SCREEN, screen_cte()),
    "label_policy_sensitivity": query(["planted"], *_policy_views(), select="""
        select split_part(a.dataset, '__', 1) as stem, a.dataset as variant, a.verdict0 as variant_verdict, a.full_accuracy as variant_accuracy,
          b.verdict0 as primary_verdict, b.full_accuracy as primary_accuracy, a.verdict0 = b.verdict0 as stable
        from pscreened a join pscreened b on split_part(a.dataset, '__', 1) = b.dataset where contains(a.dataset, '__')"""),
    "screen_gate": query(VIEW_NAMES, *CURVES, screen_cte(), *_policy_views(), select="""
        select dataset, verdict0 as verdict from (select * from screened union all select * from pscreened)
        where verdict0 in ('clean', 'repairable') and not contains(dataset, '__')"""),
    "verdict_validation": curve_query("""select e.dataset, expected, verdict0 as verdict, coalesce(verdict0 = expected, false) as passed
        from (values ('planted', 'repairable'), ('order_status', 'clean')) e(dataset, expected) left join screened s on e.dataset = s.dataset""", screen_cte()),
    "population_table": query(VIEW_NAMES, *CURVES, VERDICTS, SENSITIVITY, screen_cte(), *all_trees(), select="""
        select dataset, not contains(dataset, '__') as is_independent, n_features_above_95,
          case when n_features_above_95 > 0 then 'leaky' else 'clean' end as contrast, best_single_feature, best_single_feature_accuracy,
          verdict0 as verdict, full_accuracy, n_removed, final_accuracy, n_features, minimal_leaking_set,
          verdict_at_0_97, verdict_at_0_98, verdict_at_0_99, verdict_at_0_995, verdict_changes
        from (select dataset, count(*) as n_features, count(*) filter (accuracy > 0.95) as n_features_above_95,
            (array_agg(feature order by accuracy desc, feature))[1] as best_single_feature, max(accuracy) as best_single_feature_accuracy
          from scores group by dataset) join screened using (dataset) join sensitivity using (dataset)"""),
    "regime_reconciliation": query(VIEW_NAMES, *CURVES, *all_trees(), select="""
        select l.dataset as feature_set, l.accuracy as accuracy_static, t.accuracy as accuracy_retuned, round(t.accuracy - l.accuracy, 6) + 0.0 as difference,
          (l.accuracy < 0.99) <> (t.accuracy < 0.99) as crosses_target
        from (select dataset, arg_max(accuracy, iteration) as accuracy, arg_max(top_feature, iteration) as feature from curve group by dataset) l
        join scores t on l.dataset = t.dataset and l.feature = t.feature"""),
    "score_predictions": pred_query("select * from scored", rates_sql()),
    "roc_auc": pred_query("select config, model, seed, roc_auc from auc", rates_sql()),
    "confusion_matrix": pred_query("""select g.config, g.model, g.label, g.prediction, count(p.id) as n,
        round(cast(count(p.id) as double) / sum(count(p.id)) over (partition by g.config, g.model, g.label), 6) as row_share
        from (select * from (select distinct config, model from pred), (values (0), (1)) a(label), (values (0), (1)) b(prediction)) g
        left join pred p on p.config = g.config and p.model = g.model and p.label = g.label and p.prediction = g.prediction
        group by g.config, g.model, g.label, g.prediction""", seeds=SEEDS),
    "log_loss": pred_query("""select config, model, seed, round(avg(-ln(case when label = 1 then pp else 1.0 - pp end)), 6) as log_loss
        from (select *, greatest(1e-15, least(1 - 1e-15, probability)) as pp from pred) group by 1, 2, 3"""),
    "majority_baseline": pred_query("""select config, model, seed, round(greatest(r, 1 - r), 6) as majority_accuracy, round(a, 6) as accuracy,
        round(a - greatest(r, 1 - r), 6) + 0.0 as accuracy_above_majority from (select config, model, seed, avg(cast(label as double)) as r,
          avg(cast(label = prediction as double)) as a from pred group by 1, 2, 3)"""),
    "soft_vote": _vote(),
    "seed_summary": pred_query(_SUMMARY + ", 1 as model_rank from scored group by config, model", rates_sql(), seeds=SEEDS),
    "sanity_checks": pred_query("""select config, accuracy as accuracy_mean, accuracy >= 0.9 as above_floor,
        case config when 'order_status' then accuracy between 0.4 and 0.6 else accuracy between 0.95 and 1.0 end as in_band,
        config <> 'order_status' or accuracy < 1.0 as imperfect_enough from scored""", rates_sql()),
    "params_for_config": _params(),
}
