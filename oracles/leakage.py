"""SQL for the label-leakage operators."""

from oracles.views import FEATURES, SQL, long, query

SPLIT_KEY = "md5(concat_ws('|', 42, id))"


def split_cte(view: str, out: str = "split_rows", seed: int = 42, tag: str = "") -> str:
    """The seeded 70/15/15 split, by a plain global row_number."""
    key = f"md5(concat_ws('|', {tag}{seed}, id))"
    return f"""{out}_r as (select *, row_number() over (partition by label order by {key}, id) as rk,
        count(*) over (partition by label) as tot from {view}),
{out} as (select * exclude (rk, tot),
     case when rk <= floor(tot * 0.15 + 0.5) then 'test'
          when rk <= floor(tot * 0.15 + 0.5) + floor(tot * 0.15 + 0.5) then 'val' else 'train' end as split
   from {out}_r)"""


def counts_cte(source: str = "long", out: str = "vc") -> str:
    return f"""{out} as (select feature, value, count(*) filter (label = 0) as n0,
       count(*) filter (label = 1) as n1 from {source} group by feature, value)"""


def threshold_cte(vc: str = "vc", out: str = "best") -> str:
    """Scan all cuts in both directions; ties: <= first, then the smallest cut."""
    return f"""{out}_run as (select feature, value,
      cast(sum(n0) over w as double) as c0, cast(sum(n1) over w as double) as c1,
      cast(sum(n0) over (partition by feature) as double) as a0,
      cast(sum(n1) over (partition by feature) as double) as a1
   from {vc} window w as (partition by feature order by value)),
{out}_cand as (
   select feature, value, 0 as dir, 0.5 * (c1 / a1 + (a0 - c0) / a0) as bal, c1 as tp, c0 as fp, a1 - c1 as fn, a0 - c0 as tn
   from {out}_run where a0 > 0 and a1 > 0
   union all
   select feature, value, 1, 0.5 * ((a1 - c1) / a1 + c0 / a0), a1 - c1, a0 - c0, c1, c0
   from {out}_run where a0 > 0 and a1 > 0),
{out} as (select feature, value + 0.0 as threshold,
      case dir when 0 then 'positive if x <= t' else 'positive if x > t' end as direction,
      round(bal, 6) as balanced_accuracy, round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy,
      case when tp + fp > 0 then round(tp / (tp + fp), 6) else 0.0 end as precision,
      round(tp / (tp + fn), 6) as recall,
      case when 2 * tp + fp + fn > 0 then round(2 * tp / (2 * tp + fp + fn), 6) else 0.0 end as f1,
      cast(fp as bigint) as negatives_on_positive_side, cast(fn as bigint) as positives_on_negative_side
   from (select *, row_number() over (partition by feature order by bal desc, dir, value) as rn from {out}_cand)
   where rn = 1)"""


def tree_cte(source: str, out: str = "tree") -> str:
    """Depth-3 tree per feature over rows (feature, value, label, split)."""
    parts = [f"""{out}_vc as (select feature, value,
        count(*) filter (label = 0 and split <> 'test') as n0, count(*) filter (label = 1 and split <> 'test') as n1,
        count(*) filter (label = 0 and split = 'test') as s0, count(*) filter (label = 1 and split = 'test') as s1
      from {source} group by feature, value),
{out}_fit as (select feature, value, n0, n1, lead(value) over (partition by feature order by value) as nxt
      from {out}_vc where n0 + n1 > 0),
{out}_l0 as (select feature, 1 as node, cast('-inf' as double) as first, cast('inf' as double) as last,
        cast('-inf' as double) as above, cast('inf' as double) as upto,
        cast(sum(n0) as double) as n0, cast(sum(n1) as double) as n1 from {out}_fit group by feature)"""]
    for i in range(3):
        src, dst = f"{out}_l{i}", f"{out}_l{i + 1}"
        parts.append(f"""{dst}_c as (select f.feature, node, value, nxt, n.n0 as t0, n.n1 as t1,
        cast(sum(f.n0) over w as double) as l0, cast(sum(f.n1) over w as double) as l1
      from {out}_fit f join {src} n on f.feature = n.feature and f.value > n.first and f.value <= n.last
      where n.n0 > 0 and n.n1 > 0
      window w as (partition by f.feature, node order by value)),
{dst}_b as (select * from (select *, row_number() over (partition by feature, node order by
        (l0 * l0 + l1 * l1) / (l0 + l1) + ((t0 - l0) * (t0 - l0) + (t1 - l1) * (t1 - l1)) / ((t0 - l0) + (t1 - l1)) desc, value) as rn
      from {dst}_c where (t0 - l0) + (t1 - l1) > 0) where rn = 1),
{dst} as (select n.feature, n.node * 2 as node, n.first, b.value as last, n.above, (b.value + b.nxt) / 2.0 as upto, l0 as n0, l1 as n1
      from {src} n join {dst}_b b on n.feature = b.feature and n.node = b.node
      union all
      select n.feature, n.node * 2 + 1, b.value, n.last, (b.value + b.nxt) / 2.0, n.upto, n.n0 - l0, n.n1 - l1
      from {src} n join {dst}_b b on n.feature = b.feature and n.node = b.node)""")
    final = " union all ".join(
        [f"select n.* from {out}_l{i} n left join {out}_l{i + 1}_b b on n.feature = b.feature and n.node = b.node where b.node is null"
         for i in range(3)] + [f"select * from {out}_l3"])
    parts.append(f"""{out}_leaf as (select *, case when n1 > n0 then 1 else 0 end as prediction from ({final})),
{out}_conf as (select v.feature, sum(case when prediction = 1 then s1 else 0 end) as tp,
        sum(case when prediction = 1 then s0 else 0 end) as fp, sum(case when prediction = 0 then s1 else 0 end) as fn,
        sum(case when prediction = 0 then s0 else 0 end) as tn
      from {out}_vc v join {out}_leaf l on v.feature = l.feature and value > above and value <= upto
      where s0 + s1 > 0 group by v.feature),
{out} as (select feature, cast(tp + fp + fn + tn as bigint) as n_test,
        round(cast(tp + tn as double) / (tp + fp + fn + tn), 6) as accuracy,
        case when tp + fp > 0 then round(cast(tp as double) / (tp + fp), 6) else 0.0 end as precision,
        case when tp + fn > 0 then round(cast(tp as double) / (tp + fn), 6) else 0.0 end as recall,
        case when 2 * tp + fp + fn > 0 then round(cast(2 * tp as double) / (2 * tp + fp + fn), 6) else 0.0 end as f1
      from {out}_conf)""")
    return ",\n".join(parts)


def mi_cte(source: str, out: str = "mi") -> str:
    return f"""{out}_vc as (select feature, value, count(*) filter (label = 0) as n0, count(*) filter (label = 1) as n1
      from {source} group by feature, value),
{out}_run as (select *, row_number() over w as idx, count(*) over (partition by feature) as nd,
        sum(n0 + n1) over w - (n0 + n1) as below, sum(n0 + n1) over (partition by feature) as tot
      from {out}_vc window w as (partition by feature order by value)),
{out}_bin as (select feature, case when nd <= 32 then idx else cast(floor(cast(below as double) * 32 / cast(tot as double)) as bigint) end as bin,
        cast(sum(n0) as double) as n0, cast(sum(n1) as double) as n1 from {out}_run group by 1, 2),
{out}_tot as (select feature, sum(n0) as t0, sum(n1) as t1 from {out}_bin group by feature),
{out} as (select b.feature, count(*) as n_bins, round(greatest(sum(
        case when n0 > 0 then n0 / (t0 + t1) * ln(n0 * (t0 + t1) / ((n0 + n1) * t0)) else 0 end +
        case when n1 > 0 then n1 / (t0 + t1) * ln(n1 * (t0 + t1) / ((n0 + n1) * t1)) else 0 end), 0.0), 6) + 0.0 as mi_nats
      from {out}_bin b join {out}_tot t on b.feature = t.feature group by b.feature)"""


def _distribution(view):
    return query([view], long(view), select="""
  select feature, label, count(*) as n, min(value) as min_value, max(value) as max_value,
    round(avg(value), 4) as mean_value, round(quantile_cont(value, 0.5), 4) as median_value,
    round(coalesce(stddev_samp(value), 0.0), 4) as std_value, count(distinct value) as n_distinct,
    count(distinct value) = 1 as constant_in_class, max(mode_value) as mode_value, max(mode_count) as mode_count,
    round(cast(max(mode_count) as double) / count(*), 6) as mode_share
  from long join (select feature, label, value as mode_value, n as mode_count from (
      select feature, label, value, count(*) as n, row_number() over (partition by feature, label order by count(*) desc, value) as rn
      from long group by feature, label, value) where rn = 1) using (feature, label)
  group by feature, label""")


_TOP = """top as (select *, round(100.0 * n / n_class, 6) as percent_of_class from (
   select feature, label, value, count(*) as n,
          row_number() over (partition by feature, label order by count(*) desc, value) as rank,
          sum(count(*)) over (partition by feature, label) as n_class
   from long group by feature, label, value) where rank <= 10)"""

THRESHOLDS = "select * from best"

_SEPARATION = """
  select best.*, positive_min, positive_max, negative_min, negative_max, n_distinct_positive, n_distinct_negative,
    n_shared_values, n_rows_at_shared_values, coalesce(ex, '') as shared_value_examples,
    case when n_shared_values = 0 then 'disjoint'
         when n_shared_values = 1 and (n_distinct_positive = 1 or n_distinct_negative = 1)
              and (negatives_on_positive_side = 0 or positives_on_negative_side = 0) then 'degenerate_point_mass'
         when negatives_on_positive_side = 0 or positives_on_negative_side = 0 then 'one_sided_pure'
         else 'genuine_overlap' end as separation_type,
    n_shared_values = 0 as classes_disjoint
  from best join (select feature, min(value) filter (n1 > 0) as positive_min, max(value) filter (n1 > 0) as positive_max,
      min(value) filter (n0 > 0) as negative_min, max(value) filter (n0 > 0) as negative_max,
      count(*) filter (n1 > 0) as n_distinct_positive, count(*) filter (n0 > 0) as n_distinct_negative,
      count(*) filter (n1 > 0 and n0 > 0) as n_shared_values,
      cast(coalesce(sum(n0 + n1) filter (n1 > 0 and n0 > 0), 0) as bigint) as n_rows_at_shared_values
    from vc group by feature) using (feature)
  left join (select feature, string_agg(printf('%.4f', value), '; ' order by value) as ex from (
      select feature, value, row_number() over (partition by feature order by value) as rn from vc where n0 > 0 and n1 > 0)
    where rn <= 10 group by feature) using (feature)"""


def histogram_sql(view, bins=60, clip=None):
    span = ("quantile_cont(value, %s) as lo, quantile_cont(value, %s) as hi" % clip) if clip else "min(value) as lo, max(value) as hi"
    return query([view], long(view),
                 f"span0 as (select feature, {span} from long group by feature)",
                 "span as (select feature, case when hi = lo then lo - 0.5 else lo end as lo, case when hi = lo then hi + 0.5 else hi end as hi from span0)",
                 select=f"""select long.feature, cast(least(floor((value - lo) / ((hi - lo) / {bins}.0)), {bins - 1}) as int) as bin,
      count(*) filter (label = 0) as n_negative, count(*) filter (label = 1) as n_positive
      from long join span on long.feature = span.feature where value >= lo and value <= hi group by 1, 2""")


def tree_query(view, select="select '{v}' as dataset, tree.* from tree"):
    return query([view], split_cte(view), long("split_rows", carry="split", features=FEATURES[view]),
                 tree_cte("long"), select=select.replace("{v}", view))


VIEW_NAMES = ["line_returned", "order_status", "doc_quality", "planted"]


def all_trees() -> list[str]:
    """CTEs producing ``scores`` (dataset, feature, accuracy, ...) over the four audited views."""
    ctes = []
    for v in VIEW_NAMES:
        ctes += [split_cte(v, f"s_{v}"), long(f"s_{v}", f"long_{v}", carry="split", features=FEATURES[v]),
                 tree_cte(f"long_{v}", f"tree_{v}")]
    ctes.append("scores as (" + " union all ".join(f"select '{v}' as dataset, * from tree_{v}" for v in VIEW_NAMES) + ")")
    return ctes


NEAR_ORACLE = """select dataset, count(*) as n_features, count(*) filter (accuracy > 0.95) as n_above_bar,
   coalesce(string_agg(feature, '; ' order by feature) filter (accuracy > 0.95), '') as features_above_bar
 from scores group by dataset"""

_INVESTIGATE = """
  select 'planted' as dataset, tree.*, mi.n_bins, mi.mi_nats, r.n_leaves, r.rule
  from tree join mi using (feature) join (select feature, count(*) as n_leaves,
     string_agg('x <= ' || case when isinf(upto) then 'Infinity' else printf('%.4f', upto) end || ': ' || prediction, '; ' order by upto) as rule
     from tree_leaf group by feature) r using (feature)"""

ORACLES = {
    "class_distribution": _distribution("line_returned"),
    "class_distribution_planted": _distribution("planted"),
    "class_top_values": query(["line_returned"], long("line_returned"), _TOP,
                              select="select feature, label, rank, value, n, percent_of_class from top"),
    "class_top_values_text": query(["doc_quality"], long("doc_quality"), _TOP, select="""
      select feature, label, string_agg(printf('%.2f:%d(%.2f%%)', value, n, percent_of_class), '; ' order by rank) as top_values
      from top group by feature, label"""),
    "best_threshold": query(["line_returned"], long("line_returned"), counts_cte(), threshold_cte(), select=THRESHOLDS),
    "best_threshold_planted": query(["planted"], long("planted"), counts_cte(), threshold_cte(), select=THRESHOLDS),
    "separation_type": query(["planted"], long("planted"), counts_cte(), threshold_cte(), select=_SEPARATION),
    "class_histogram": histogram_sql("line_returned"),
    "class_histogram_clipped": histogram_sql("line_returned", 44, (0.005, 0.995)),
    "single_feature_tree": tree_query("planted"),
    "single_feature_tree_lines": tree_query("line_returned"),
    "mutual_information": query(["line_returned"], long("line_returned"), mi_cte("long"), select="select * from mi"),
    "mutual_information_planted": query(["planted"], long("planted"), mi_cte("long"), select="select * from mi"),
    "near_oracle_count": query(VIEW_NAMES, *all_trees(), select=NEAR_ORACLE),
    "targeted_investigation": query(
        ["planted"], split_cte("planted"), long("split_rows", carry="split", features=["leak_point_mass"]),
        tree_cte("long"), "fit_rows as (select * from long where split <> 'test')", mi_cte("fit_rows"), select=_INVESTIGATE),
    "constant_rule_score": query(["planted"], """vc as (select leak_point_mass as value, count(*) filter (label = 0) as n0,
       count(*) filter (label = 1) as n1 from planted group by 1)""",
      "e as (select *, case when value < 97.0 then n0 else n1 end as wrong from vc)", select="""
      select 'leak_point_mass' as feature, *, round(cast(tp + tn as double) / (tp + fp + fn + tn), 6) as accuracy,
        (select value from e order by wrong desc, value limit 1) as worst_value,
        (select wrong from e order by wrong desc, value limit 1) as errors_at_worst_value,
        round(cast((select wrong from e order by wrong desc, value limit 1) as double) / (fp + fn), 6) as share_of_errors
      from (select cast(sum(n1) filter (value < 97.0) as bigint) as tp, cast(coalesce(sum(n0) filter (value < 97.0), 0) as bigint) as fp,
        cast(coalesce(sum(n1) filter (value >= 97.0), 0) as bigint) as fn, cast(sum(n0) filter (value >= 97.0) as bigint) as tn from e)"""),
}
