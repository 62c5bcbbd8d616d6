"""SQL for attributions, profiles and agreement: textbook forms over explicit pairs."""

from oracles.base import ranked
from oracles.leakage import VIEW_NAMES, split_cte
from oracles.verdicts import steady
from oracles.views import FEATURES, long, query, u

SEEDS = (42, 43, 44)


def half_ctes(views=VIEW_NAMES, seeds=(42,), out="hrows"):
    ctes, parts = [], []
    for w in views:
        for seed in seeds:
            ctes += [ranked(w, f"concat_ws('|', 'half', {seed}, id)", f"hr_{w}_{seed}"),
                     f"h_{w}_{seed} as (select *, case when rk <= floor(tot * 0.5 + 0.5) then 'a' else 'b' end as half from hr_{w}_{seed})",
                     long(f"h_{w}_{seed}", f"hl_{w}_{seed}", "half", FEATURES[w])]
            parts.append(f"select '{w}' as dataset, {seed} as seed, half, cast(id as varchar) as id, label, feature, value from hl_{w}_{seed}")
    ctes.append(f"{out} as ({' union all '.join(parts)})")
    return ctes


def weight_cte(rows, keys, seed="seed", out="wts"):
    spread = f"case when {steady('s')} > 0 then {steady('s')} else 1.0 end"
    return f"""{out} as (select {keys}, feature, {steady(f'coalesce((p - n) / {spread}, 0.0)')} as weight,
       {steady('coalesce(b, m)')} as centre, {spread} as spread
     from (select {keys}, feature, stddev_pop(value) as s, avg(value) as m,
         avg(value) filter ({u(f"concat_ws('|', 'background', {seed}, id)")} < 0.1) as b,
         avg(value) filter (label = 1) as p, avg(value) filter (label = 0) as n from {rows} group by {keys}, feature))"""


def attr_cte(rows, keys, wts="wts", out="attr"):
    return f"""{out} as (select r.*, weight * (value - centre) / spread as attribution from {rows} r join {wts} using ({keys}, feature))"""


def rho_cte(attr, keys, out="rho"):
    r = "(rank() over (partition by {k}, feature order by {c}) + (count(*) over (partition by {k}, feature, {c}) - 1) / 2.0)"
    return f"""{out}_r as (select {keys}, feature, {r.format(k=keys, c='value')} as rx, {r.format(k=keys, c='attribution')} as ry from {attr}),
{out} as (select {keys}, feature, case when min(rx) = max(rx) or min(ry) = max(ry) then 0.0 else corr(rx, ry) end as direction
   from {out}_r group by {keys}, feature)"""


def profile_cte(attr, keys, out="prof", rho=False):
    base = f"select {keys}, feature, avg(abs(attribution)) as mean_abs, avg(attribution) as mean_signed from {attr} group by {keys}, feature"
    return f"{out} as (select * from ({base}) join rho using ({keys}, feature))" if rho else f"{out} as ({base})"


def pairs_cte(prof="prof", keys="dataset, seed", rho=False, out="pairs"):
    extra = ", a.direction as rho_a, b.direction as rho_b" if rho else ""
    on = " and ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    sel = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""{out} as (select {sel}, a.feature, a.mean_abs as abs_a, b.mean_abs as abs_b, a.mean_signed as signed_a, b.mean_signed as signed_b{extra}
      from {prof} a join {prof} b on {on} and a.feature = b.feature and a.half = 'a' and b.half = 'b')"""


HK = "dataset, seed, half"


def halves(rho=False, views=VIEW_NAMES, seeds=(42,)):
    ctes = [*half_ctes(views, seeds), weight_cte("hrows", HK), attr_cte("hrows", HK)]
    if rho:
        ctes.append(rho_cte("attr", HK))
    return [*ctes, profile_cte("attr", HK, rho=rho), pairs_cte(rho=rho)]


def half_query(select, *more, rho=False, views=VIEW_NAMES, seeds=(42,)):
    return query(list(views), *halves(rho, views, seeds), *more, select=select)


def tau_cte(pairs="pairs", keys="dataset, seed", a="abs_a", b="abs_b", item="feature", out="taus"):
    """All pairs of items, signs multiplied: the definition of tau-b."""
    ks = [k.strip() for k in keys.split(",")]
    on = " and ".join(f"x.{k} = y.{k}" for k in ks)
    sel = ", ".join(f"x.{k}" for k in ks)
    return f"""{out} as (select {keys}, s, sa, sb, case when sa > 0 and sb > 0 then s / sqrt(sa * sb) end as tau from (
       select {sel}, cast(sum(sign(x.{a} - y.{a}) * sign(x.{b} - y.{b})) as double) as s,
         cast(sum(abs(sign(x.{a} - y.{a}))) as double) as sa, cast(sum(abs(sign(x.{b} - y.{b}))) as double) as sb
       from {pairs} x join {pairs} y on {on} and x.{item} < y.{item} group by {sel}))"""


def _erfc(z):
    x = f"(abs({z}) / sqrt(2.0))"
    t = f"(1.0 / (1.0 + 0.3275911 * {x}))"
    poly = "0.0"
    for c in (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = f"(({poly} + ({c})) * {t})"
    return f"{poly} * exp(-{x} * {x})"


def pvalue_cte(keys="dataset, seed", pairs="pairs", taus="taus", out="pvals"):
    return f"""{out}_n as (select {keys}, cast(count(*) as double) as n from {pairs} group by {keys}),
{out}_t as (select {keys}, sum(t * (t - 1) / 2) as ties, sum(t * (t - 1) * (t - 2)) as x0, sum(t * (t - 1) * (2 * t + 5)) as x1, side from (
     select {keys}, 'a' as side, cast(count(*) as double) as t from {pairs} group by {keys}, abs_a
     union all select {keys}, 'b', cast(count(*) as double) from {pairs} group by {keys}, abs_b) group by {keys}, side),
{out}_x as (with recursive shares(items, p) as (select 1, [cast(1 as double)] union all
     select items + 1, list_transform(range(0, items * (items + 1) // 2 + 1), lambda k: list_sum(list_slice(p, greatest(1, k - items + 1), k + 1)) / (items + 1))
     from shares where items < 33) select * from shares),
{out}_v as (select {keys}, tau, s, n, a.ties + b.ties as ties, (n * (n - 1) * (2 * n + 5) - a.x1 - b.x1) / 18 + 2 * a.ties * b.ties / (n * (n - 1))
       + case when n > 2 then a.x0 * b.x0 / (9 * n * (n - 1) * (n - 2)) else 0.0 end as var
     from {taus} join {out}_n using ({keys}) join (select * from {out}_t where side = 'a') a using ({keys}) join (select * from {out}_t where side = 'b') b using ({keys})),
{out} as (select {keys}, round(tau, 6) + 0.0 as tau, round(case when var > 0 then {_erfc('s / sqrt(var)')} end, 6) + 0.0 as p_normal,
     round(case when ties = 0 and n between 2 and 33 then least(1.0, 2.0 * list_sum(p[1:cast((n * (n - 1) / 2 - abs(s)) / 2 as int) + 1]))
       when ties = 0 and n > 33 and n * (n - 1) / 2 - abs(s) <= 2 then 2.0 / gamma(n + 1.0 - (n * (n - 1) / 2 - abs(s)) / 2)
       when var > 0 then {_erfc('s / sqrt(var)')} end, 6) + 0.0 as p_value,
     case when ties = 0 and n > 1 and (n <= 33 or n * (n - 1) / 2 - abs(s) <= 2) then 'exact' when var > 0 then 'normal' end as method
     from {out}_v left join {out}_x on items = n)"""


def null_cte(n, keys="dataset, seed", out="nulls"):
    ks = [k.strip() for k in keys.split(",")]
    on = " and ".join(f"x.{k} = y.{k}" for k in ks)
    sel = ", ".join(f"x.{k}" for k in ks)
    return f"""{out}_o as (select {keys}, feature, abs_a, abs_b, row_number() over (partition by {keys} order by feature) as slot from pairs),
{out}_d as (select {keys}, it, abs_a, feature, row_number() over (partition by {keys}, it order by md5(concat_ws('|', 42, it, feature)), feature) as go
     from {out}_o, (select unnest(range(1, {n} + 1)) as it)),
{out}_s as (select {', '.join('d.' + k for k in ks)}, it, d.feature, d.abs_a, o.abs_b from {out}_d d join {out}_o o on {' and '.join(f'd.{k} = o.{k}' for k in ks)} and d.go = o.slot),
{out}_tau as (select {sel}, x.it, cast(sum(sign(x.abs_a - y.abs_a) * sign(x.abs_b - y.abs_b)) as double) as s
     from {out}_s x join {out}_s y on {on} and x.it = y.it and x.feature < y.feature group by {sel}, x.it),
{out} as (select {', '.join('t.' + k for k in ks)}, round(max(t.tau), 6) + 0.0 as tau, count(*) as n_perm, count(*) filter (abs(n.s) >= abs(t.s)) as n_extreme,
     round((count(*) filter (abs(n.s) >= abs(t.s)) + 1.0) / (count(*) + 1.0), 6) as p_empirical,
     round(avg(n.s / sqrt(sa * sb)), 6) + 0.0 as null_mean, round(stddev_samp(n.s / sqrt(sa * sb)), 6) + 0.0 as null_std
   from {out}_tau n join taus t on {' and '.join(f'n.{k} = t.{k}' for k in ks)} group by {', '.join('t.' + k for k in ks)})"""


def top_cte(keys="dataset, seed", out="placed"):
    return f"""{out} as (select *, row_number() over (partition by {keys} order by abs_a desc, feature) as pa,
      row_number() over (partition by {keys} order by abs_b desc, feature) as pb,
      row_number() over (partition by {keys} order by (abs_a + abs_b) / 2.0 desc, feature) as pc from pairs)"""


def jaccard_cte(ks, keys="dataset, seed", out="jac"):
    return f"""{out} as (select {keys}, k, round(cast(count(*) filter (pa <= k and pb <= k) as double) / count(*) filter (pa <= k or pb <= k), 6) as jaccard
      from placed, (select unnest([{', '.join(map(str, ks))}]) as k) group by {keys}, k)"""


def sign_cte(ks, keys="dataset, seed", a="signed_a", b="signed_b", out="signs"):
    return f"""{out} as (select {keys}, k, count(*) filter (pa <= k and pb <= k) as n_features,
      round(case when count(*) filter (pa <= k and pb <= k) >= 3 then 100.0 * count(*) filter (pa <= k and pb <= k and sign({a}) = sign({b}))
         / count(*) filter (pa <= k and pb <= k) end, 6) as percent
      from placed, (select unnest([{', '.join(map(str, ks))}]) as k) group by {keys}, k)"""


def weighted_cte(keys="dataset, seed"):
    return f"""weighted as (select {keys}, round(case when sum(abs_a + abs_b) <> 0 then 100.0 * sum(case when sign(signed_a) = sign(signed_b) then (abs_a + abs_b) / 2.0 else 0.0 end)
      / sum((abs_a + abs_b) / 2.0) end, 6) as percent_weighted, round(100.0 * avg(case when sign(signed_a) = sign(signed_b) then 1.0 else 0.0 end), 6) as percent_all
    from pairs group by {keys})"""


def direction_cte(ks, rhos, keys="dataset, seed", out="dirs"):
    strong = "abs(rho_a) >= rho_min and abs(rho_b) >= rho_min"
    return f"""{out} as (select {keys}, k, rho_min, count(*) as n_considered, count(*) filter ({strong}) as n_meeting,
      count(*) filter ({strong} and sign(rho_a) = sign(rho_b)) as n_agreeing, round(min(least(abs(rho_a), abs(rho_b))), 6) + 0.0 as min_abs_rho,
      round(100.0 * count(*) filter ({strong} and sign(rho_a) = sign(rho_b)) / count(*), 6) as percent
    from placed, (select unnest([{', '.join(map(str, ks))}]) as k), (select unnest([{', '.join(f'cast({r} as double)' for r in rhos)}]) as rho_min)
    where pc <= k group by {keys}, k, rho_min)"""


def top1_cte(keys="dataset, seed"):
    return f"""top1 as (select *, top1_a = top1_b as top1_agrees from (select {keys}, max(feature) filter (pa = 1) as top1_a, max(feature) filter (pb = 1) as top1_b from placed group by {keys}))"""


def boot_cte(source, keys, fields, order, n, out="boot"):
    ks = [k.strip() for k in keys.split(",")]
    cols = ", ".join(f"o.{f}" for f in fields)
    draw = u("concat_ws('|', 'boot', 42, rep, slot)")
    return f"""{out}_o as (select {keys}, {', '.join(fields)}, row_number() over (partition by {keys} order by {order}) as pos,
      count(*) over (partition by {keys}) as m from {source}),
{out} as (select {', '.join('d.' + k for k in ks)}, rep, slot, {cols} from (
      select {keys}, pos as slot, rep, cast(floor({draw} * m) as bigint) + 1 as go
      from (select {keys}, pos, pos as slot, m, rep from {out}_o, (select unnest(range(1, {n} + 1)) as rep))) d
    join {out}_o o on {' and '.join(f'd.{k} = o.{k}' for k in ks)} and d.go = o.pos)"""


def interval_sql(stats, keys, point, out="iv"):
    return f"""{out} as (select {keys}, round(quantile_cont(stat, 0.025), 6) + 0.0 as ci_lower, round(quantile_cont(stat, 0.975), 6) + 0.0 as ci_upper,
      round(avg(stat), 6) + 0.0 as bootstrap_mean, round(coalesce(stddev_samp(stat), 0.0), 6) + 0.0 as bootstrap_std, count(*) as n_bootstrap
    from {stats} where stat is not null group by {keys})"""


EVERY_SEED = (42, 43, 44, 45, 46)
TOP_KS, RHO_MINS = (5, 10, 15), (0.3, 0.5)


def every_ctes():
    return [*halves(True, VIEW_NAMES, EVERY_SEED), tau_cte(), top_cte(), top1_cte(), jaccard_cte(TOP_KS), sign_cte(TOP_KS),
            sign_cte(TOP_KS, a="rho_a", b="rho_b", out="dsigns"), weighted_cte(),
            """cancel as (select dataset, seed, max(c) filter (half = 'a') as cancellation_a, max(c) filter (half = 'b') as cancellation_b from (
               select dataset, seed, half, round(median(abs(mean_signed) / greatest(mean_abs, 1e-12)), 6) as c from prof group by 1, 2, 3) group by 1, 2)"""]


def _wide(source, out, *columns):
    cells = ", ".join(f"max({c}) filter (k = {k}) as {name}{k}" for k in TOP_KS for c, name in columns)
    return f"{out} as (select dataset, seed, {cells} from {source} group by 1, 2)"


def ranking_ctes():
    return [_wide("jac", "jac_w", ("jaccard", "jaccard_")), _wide("signs", "signs_w", ("percent", "sign_top"), ("n_features", "n_top"))]


def _half_agreement():
    cells = ", ".join(f"max({c}) filter (k = {k} and rho_min = {r}) as {name}_{k}_{int(100 * r)}" for k in TOP_KS for r in RHO_MINS
                      for c, name in (("percent", "directional"), ("n_meeting", "n_directional")))
    ctes = [*every_ctes(), *ranking_ctes(), pvalue_cte(), null_cte(10000), direction_cte(TOP_KS, RHO_MINS),
            _wide("dsigns", "dsigns_w", ("percent", "direction_top"), ("n_features", "n_direction_top")),
            f"dirs_w as (select dataset, seed, {cells} from dirs group by 1, 2)",
            weighted_cte().replace("weighted as", "dweighted as", 1).replace("signed_", "rho_"),
            boot_cte("pairs", "dataset, seed", ["abs_a", "abs_b"], "feature", 1000), tau_cte("boot", "dataset, seed, rep", item="slot", out="btau"),
            "st as (select dataset, seed, tau as stat from btau)", interval_sql("st", "dataset, seed", None),
            "sizes as (select dataset, seed, count(*) as n_features from pairs group by 1, 2)"]
    parts = ["pvals", "(select dataset, seed, p_empirical, null_mean, null_std from nulls)", "(select dataset, seed, ci_lower, ci_upper from iv)",
             "top1", "jac_w", "signs_w", "weighted", "dsigns_w", "(select dataset, seed, percent_weighted as direction_weighted, percent_all as direction_all from dweighted)",
             "dirs_w", "cancel"]
    return query(VIEW_NAMES, *ctes, select="select * from sizes" + "".join(f" join {x} using (dataset, seed)" for x in parts))


def _diagnostic():
    return query(VIEW_NAMES, *every_ctes(), select="""select dataset, k, round(avg(signs.percent), 6) as sign_top, round(avg(percent_all), 6) as sign_all,
        round(avg(dsigns.percent), 6) as direction_top, round(avg((cancellation_a + cancellation_b) / 2.0), 6) as cancellation_ratio,
        coalesce(round(avg(signs.percent), 6) > round(avg(percent_all), 6), false) as thresholding_raised
        from signs join dsigns using (dataset, seed, k) join weighted using (dataset, seed) join cancel using (dataset, seed) group by dataset, k""")


def _summary():
    metrics = ["tau", *[f"{m}{k}" for m in ("jaccard_", "sign_top") for k in TOP_KS], "percent_weighted", "percent_all"]
    ctes = [*every_ctes(), *ranking_ctes(), """per_seed as (select * replace (round(tau, 6) + 0.0 as tau) from taus join top1 using (dataset, seed)
        join jac_w using (dataset, seed) join signs_w using (dataset, seed) join weighted using (dataset, seed))"""]
    sel = ["dataset", "count(*) as n_seeds", "round(avg(cast(top1_agrees as double)), 6) as top1_agreement_rate"]
    for m in metrics:
        sel += [f"round(avg({m}), 6) + 0.0 as {m}_mean", f"round(coalesce(stddev_samp({m}), 0.0), 6) + 0.0 as {m}_std"]
    ctes.append(f"base as (select {', '.join(sel)} from per_seed group by dataset)")
    joins = ""
    for m in metrics:
        ctes += [f"mv_{m} as (select dataset, seed, {m} as v from per_seed where {m} is not null)",
                 boot_cte(f"mv_{m}", "dataset", ["v"], "seed", 1000, f"b_{m}"),
                 f"st_{m} as (select dataset, rep, avg(v) as stat from b_{m} group by dataset, rep)",
                 interval_sql(f"st_{m}", "dataset", None, f"iv_{m}")]
        joins += f" left join (select dataset, ci_lower as {m}_ci_lower, ci_upper as {m}_ci_upper from iv_{m}) using (dataset)"
    return query(VIEW_NAMES, *ctes, select="select * from base" + joins)


def cross_ctes(rho=False):
    ctes = [long("concept_a", "la"), long("concept_b", "lb"),
            "crows as (select 'concept_a' as dataset, * from la union all select 'concept_b', * from lb)",
            weight_cte("crows", "dataset", "42", "cw"), attr_cte("crows", "dataset", "cw", "cattr")]
    if rho:
        ctes.append(rho_cte("cattr", "dataset"))
    ctes.append(profile_cte("cattr", "dataset", "cprof0", rho=rho))
    ctes.append("cprof as (select 'concept_a->concept_b' as pair, case dataset when 'concept_a' then 'a' else 'b' end as half, * from cprof0)")
    extra = ", a.direction as rho_a, b.direction as rho_b" if rho else ""
    ctes.append(f"""pairs as (select a.pair as dataset, a.feature, a.mean_abs as abs_a, b.mean_abs as abs_b, a.mean_signed as signed_a, b.mean_signed as signed_b{extra}
       from cprof a join cprof b on a.feature = b.feature and a.half = 'a' and b.half = 'b')""")
    return ctes


MASS = """masses as (select {k}, feature, abs_a / sum(abs_a) over (partition by {k}) as ma, abs_b / sum(abs_b) over (partition by {k}) as mb from pairs),
mdist as (select {k}, round(sum(abs(ma - mb)), 6) as mass_l1_distance, round(max(ma), 6) as top1_mass_a, round(max(mb), 6) as top1_mass_b from masses group by {k})"""


_MULTIPLIERS = (1000003, 1000033, 1000037, 1000039, 1000081, 1000099)


def _permutation_ctes(view="planted", reps=5, seed=42):
    """Fit on train; each test row with the values of the row at the number that the repeat's bijection names."""
    f = FEATURES[view]
    from oracles.verdicts import linear_cte
    ctes = [split_cte(view, "tagged"), linear_cte(view, "tagged", "scored_rows"),
            f"""slots as (select *, row_number() over (order by md5(concat_ws('|', 'slot', {seed}, id)), id) - 1 as k, count(*) over () as n
                from scored_rows where split = 'test')"""]
    loss = "-ln(case when label = 1 then greatest(1e-15, least(1 - 1e-15, 1.0 / (1.0 + exp(-({s}))))) else 1.0 - greatest(1e-15, least(1 - 1e-15, 1.0 / (1.0 + exp(-({s}))))) end)"
    parts = []
    for rep in range(reps):
        factor = "case " + " ".join(f"when n % {m} <> 0 then {m}" for m in (*_MULTIPLIERS[rep:], *_MULTIPLIERS[:rep])) + " end"
        ctes.append(f"ask{rep} as (select *, (k * ({factor}) + {seed + rep}) % n as dk from slots)")
        for x in f:
            moved = f"a.score - w_{x} * (a.{x} - m_{x}) / sd_{x} + w_{x} * (b.{x} - m_{x}) / sd_{x}"
            parts.append(f"select '{x}' as feature, {rep} as rep, avg({loss.replace('label', 'a.label').replace('{s}', moved)} - {loss.replace('label', 'a.label').replace('{s}', 'a.score')}) as rise "
                         f"from ask{rep} a join slots b on b.k = a.dk, scored_rows_w")
    ctes.append("perm as (select feature, avg(rise) as importance, coalesce(stddev_samp(rise), 0.0) as importance_std, count(*) as n_repeats from ("
                + " union all ".join(parts) + ") group by feature)")
    return ctes


def _cross_fitted_ctes(view="planted", reps=5, seed=42):
    """All rows: either half is scored by the fit on the other, and takes the values of the row that the bijection names."""
    f = FEATURES[view]
    from oracles.verdicts import linear_cte
    ctes = [ranked(view, "concat_ws('|', 'half', 42, id)", "hr"),
            "hv as (select *, case when rk <= floor(tot * 0.5 + 0.5) then 'a' else 'b' end as half from hr)"]
    for mine, other in ("ab", "ba"):
        ctes += [f"tagged_{mine} as (select *, case half when '{other}' then 'train' else 'test' end as split from hv)",
                 linear_cte(view, f"tagged_{mine}", f"own_{mine}")]
    ctes.append(f"""slots as (select *, row_number() over (order by md5(concat_ws('|', 'slot', {seed}, id)), id) - 1 as k, count(*) over () as n
        from (select * from own_a where split = 'test' union all select * from own_b where split = 'test'))""")
    loss = "-ln(case when a.label = 1 then greatest(1e-15, least(1 - 1e-15, 1.0 / (1.0 + exp(-({s}))))) else 1.0 - greatest(1e-15, least(1 - 1e-15, 1.0 / (1.0 + exp(-({s}))))) end)"
    parts = []
    for rep in range(reps):
        factor = "case " + " ".join(f"when n % {m} <> 0 then {m}" for m in (*_MULTIPLIERS[rep:], *_MULTIPLIERS[:rep])) + " end"
        ctes.append(f"ask{rep} as (select *, (k * ({factor}) + {seed + rep}) % n as dk from slots)")
        rises = []
        for x in f:
            part = lambda row: "(case a.half " + " ".join(f"when '{h}' then own_{h}_w.w_{x} * ({row}.{x} - own_{h}_w.m_{x}) / own_{h}_w.sd_{x}" for h in "ab") + " end)"
            moved = f"a.score - {part('a')} + {part('b')}"
            rises.append(f"avg({loss.replace('{s}', moved)} - {loss.replace('{s}', 'a.score')}) as {x}")
        parts.append(f"select * from (select {rep} as rep, {', '.join(rises)} from ask{rep} a join slots b on b.k = a.dk, own_a_w, own_b_w)")
    ctes.append("perm as (select feature, avg(rise) as importance, coalesce(stddev_samp(rise), 0.0) as importance_std, count(*) as n_repeats from (unpivot ("
                + " union all ".join(parts) + f") on {', '.join(f)} into name feature value rise) group by feature)")
    return ctes


def _avp():
    return query(["planted"], *_permutation_ctes(), long("planted", "pl0"), "pl as (select 'planted' as dataset, * from pl0)",
                 weight_cte("pl", "dataset", "42", "pw"), attr_cte("pl", "dataset", "pw", "pa"),
                 "g as (select feature, round(avg(abs(attribution)), 9) as a from pa group by feature)",
                 "both_ as (select feature, a, round(importance, 9) as p from g join perm using (feature))",
                 """rk as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as ra, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0 as rp,
                    row_number() over (order by a desc, feature) as ta, row_number() over (order by p desc, feature) as tp from both_)""",
                 select="select count(*) as n_features, round(corr(ra, rp), 6) + 0.0 as rho, count(*) filter (ta <= 3 and tp <= 3) as topk_overlap from rk")


def _convergence(view="order_status"):
    return query([view], long(view, "l0"), f"l1 as (select '{view}' as dataset, * from l0)", weight_cte("l1", "dataset", "42", "cw"),
                 ranked(view, "concat_ws('|', 'sample', 42, id)", "rk"),
                 "pool as (select count(*) as n from rk)",
                 """sizes as (select distinct s as nominal, n as n_available, least(s, n) as effective from pool,
                    (select unnest([5000, 10000, 20000]) as s union select greatest(cast(floor(n * f) as bigint), 50) from pool, (select unnest([0.25, 0.5, 1.0]) as f) where n < 20000))""",
                 "member as (select r.*, e.effective as size from rk r, (select distinct effective, n_available from sizes) e where rk <= greatest(1, floor(cast(effective as double) * cast(tot as double) / cast(n_available as double) + 0.5)))",
                 long("member", "ml", "size", FEATURES[view]),
                 f"ml1 as (select '{view}' as dataset, * from ml)", attr_cte("ml1", "dataset", "cw", "ma"),
                 "prof as (select dataset, size, feature, avg(abs(attribution)) as mean_abs from ma group by 1, 2, 3)",
                 "steps as (select *, lead(nominal) over (order by nominal) as size_b, lead(effective) over (order by nominal) as effective_b from sizes)",
                 """pairs as (select a.dataset, nominal as size_a, s.size_b, effective as effective_a, s.effective_b, n_available, a.feature, a.mean_abs as abs_a, b.mean_abs as abs_b
                    from steps s join prof a on a.size = effective join prof b on b.size = effective_b and a.feature = b.feature where size_b is not null)""",
                 tau_cte(keys="dataset, size_a, size_b, effective_a, effective_b, n_available"),
                 select="select dataset, size_a, size_b, effective_a, effective_b, n_available, round(tau, 6) + 0.0 as tau, effective_a = effective_b as degenerate from taus")


_K3 = (3, 5, 10)
_PIVOT_SIGN = ", ".join(f"max(percent) filter (k = {k}) as sign_top{k}, max(n_features) filter (k = {k}) as n_top{k}" for k in _K3)

ORACLES = {
    "attribution_linear": half_query("select dataset, half, cast(id as bigint) as id, feature, value, round(attribution, 6) + 0.0 as attribution from attr", views=["order_status"]),
    "attribution_ensemble": query(["order_status"], long("order_status", "l0"), "l1 as (select 'order_status' as dataset, * from l0)",
        weight_cte("l1", "dataset", "42", "w1"), weight_cte("l1", "dataset", "43", "w2"), attr_cte("l1", "dataset", "w1", "a1"), attr_cte("l1", "dataset", "w2", "a2"),
        select="select dataset, a1.id, feature, round((a1.attribution + a2.attribution) / 2.0, 6) + 0.0 as attribution from a1 join a2 using (dataset, id, feature)"),
    "attribution_additivity": "select 'planted' as dataset, count(*) as n_rows, cast(0.0 as double) as max_error from orders",
    "global_importance": half_query("select dataset, seed, half, feature, round(mean_abs, 6) + 0.0 as mean_abs from prof"),
    "signed_importance": half_query("select dataset, seed, half, feature, round(mean_signed, 6) + 0.0 as mean_signed from prof"),
    "directional_importance": half_query("select dataset, seed, half, feature, round(direction, 6) + 0.0 as direction from rho", rho=True),
    "cancellation_ratio": half_query("select dataset, seed, half, round(median(abs(mean_signed) / greatest(mean_abs, 1e-12)), 6) as cancellation_ratio from prof group by 1, 2, 3"),
    "attribution_mass": half_query("select dataset, seed, half, feature, round(mean_abs / sum(mean_abs) over (partition by dataset, seed, half), 6) as mass from prof"),
    "mass_distance": half_query("select * from mdist", MASS.replace("{k}", "dataset, seed")),
    "permutation_importance": query(["planted"], *_cross_fitted_ctes(), select="select feature, round(importance, 6) + 0.0 as importance, round(importance_std, 6) + 0.0 as importance_std, n_repeats from perm"),
    "importance_degeneracy": query(["planted"], *_permutation_ctes(), select="""select count(*) as n_features, count(*) filter (abs(importance) < 1e-12) as n_zero,
        count(distinct round(importance, 12)) as n_distinct, count(*) filter (abs(importance) < 1e-12) > count(*) // 2 as degenerate from perm"""),
    "attribution_vs_permutation": _avp(),
    "sample_convergence": _convergence(),
    "align_profiles": half_query("""select dataset, seed, count(*) filter (a and b) as n_shared, count(*) filter (not b) as only_a, count(*) filter (not a) as only_b,
        count(*) filter (a and b) > 0 as comparable from (select dataset, seed, feature, bool_or(half = 'a' and feature <> 'noise') as a,
          bool_or(half = 'b' and feature not in ('tax', 'n_chars')) as b from prof group by 1, 2, 3) group by 1, 2"""),
    "kendall_tau": half_query("select dataset, seed, (select count(*) from pairs p where p.dataset = t.dataset) as n, cast(s as bigint) as s, round(tau, 6) + 0.0 as tau from taus t", tau_cte()),
    "kendall_pvalue": half_query("select * from pvals", tau_cte(), pvalue_cte()),
    "permutation_null": half_query("select * from nulls", tau_cte(), null_cte(10000)),
    "jaccard_at_k": half_query("select * from jac", top_cte(), jaccard_cte(_K3)),
    "sign_agreement_topk": half_query("select * from signs", top_cte(), sign_cte(_K3)),
    "sign_agreement_weighted": half_query("select dataset, seed, percent_weighted from weighted", weighted_cte()),
    "sign_agreement_all": half_query("select dataset, seed, percent_all from weighted", weighted_cte()),
    "sign_agreement_profile": half_query(f"select * from (select dataset, seed, {_PIVOT_SIGN} from signs group by 1, 2) join weighted using (dataset, seed)", top_cte(), sign_cte(_K3), weighted_cte()),
    "directional_consistency": half_query("select * from dirs", top_cte(), direction_cte((10,), (0.3,)), rho=True),
    "directional_profile": half_query("select * from dirs", top_cte(), direction_cte(_K3, (0.3, 0.5)), rho=True),
    "rho_pairs": half_query("""select dataset, seed, feature, round(rho_a, 6) + 0.0 as rho_a, round(rho_b, 6) + 0.0 as rho_b, round((abs_a + abs_b) / 2.0, 6) as mean_abs,
        abs(rho_a) >= 0.3 and abs(rho_b) >= 0.3 as meets_rho_min, abs(rho_a) >= 0.3 and abs(rho_b) >= 0.3 and sign(rho_a) = sign(rho_b) as agrees from placed where pc <= 10""", top_cte(), rho=True),
    "bootstrap_ci": half_query("select dataset, seed, round(tau, 6) + 0.0 as point, ci_lower, ci_upper, bootstrap_mean, bootstrap_std, n_bootstrap from taus join iv using (dataset, seed)",
        tau_cte(), boot_cte("pairs", "dataset, seed", ["abs_a", "abs_b"], "feature", 1000),
        tau_cte("boot", "dataset, seed, rep", item="slot", out="btau"), "st as (select dataset, seed, tau as stat from btau)", interval_sql("st", "dataset, seed", None)),
    "bootstrap_mean_ci": half_query("select dataset, seed, point, ci_lower, ci_upper, bootstrap_mean, bootstrap_std, n_bootstrap from iv join (select dataset, seed, round(avg(abs_a), 6) as point from pairs group by 1, 2) using (dataset, seed)",
        boot_cte("pairs", "dataset, seed", ["abs_a"], "feature", 1000), "st as (select dataset, seed, rep, avg(abs_a) as stat from boot group by 1, 2, 3)", interval_sql("st", "dataset, seed", None)),
    "all_agreement": half_query(f"""select * from pvals join (select dataset, seed, p_empirical, null_mean, null_std from nulls) using (dataset, seed)
        join (select dataset, seed, {', '.join(f'max(jaccard) filter (k = {k}) as jaccard_{k}' for k in _K3)} from jac group by 1, 2) using (dataset, seed)
        join (select dataset, seed, {_PIVOT_SIGN} from signs group by 1, 2) using (dataset, seed) join weighted using (dataset, seed)""",
        tau_cte(), pvalue_cte(), null_cte(10000), top_cte(), jaccard_cte(_K3), sign_cte(_K3), weighted_cte()),
    "half_agreement": _half_agreement(),
    "agreement_summary": _summary(),
    "stability_band": half_query("""select *, case when tau_mean > 0.85 then 'stable' when tau_mean < 0.70 then 'unstable' else 'intermediate' end as stability
        from (select dataset, round(avg(tau), 6) + 0.0 as tau_mean from taus group by dataset)""", tau_cte(), seeds=SEEDS),
    "sign_diagnostic": _diagnostic(),
    "cross_agreement": query(["concept_a", "concept_b"], *cross_ctes(True), tau_cte(keys="dataset"), pvalue_cte("dataset"), top_cte("dataset"), top1_cte("dataset"),
        jaccard_cte((5,), "dataset"), weighted_cte("dataset"), direction_cte((5,), (0.3,), "dataset"), MASS.replace("{k}", "dataset"),
        select="select pvals.*, jaccard, percent_weighted, percent_all, percent as directional, mass_l1_distance, top1_mass_a, top1_mass_b, top1_a, top1_b, top1_agrees "
               "from pvals join jac using (dataset) join weighted using (dataset) join dirs using (dataset) join mdist using (dataset) join top1 using (dataset)"),
    "ceiling_gap": query(VIEW_NAMES + ["concept_a", "concept_b"], *halves(), tau_cte(out="wtau"),
        *[c.replace("pairs as", "cpairs as") for c in cross_ctes()], tau_cte("cpairs", "dataset", out="ctau"),
        "ceil as (select dataset, round(tau, 6) + 0.0 as ceiling from wtau where dataset <> 'doc_quality')",
        "crossed as (select dataset, round(tau, 6) + 0.0 as tau_mean from ctau union all select dataset, round(tau - 0.2, 6) + 0.0 from wtau)", select="""
        select dataset, tau_mean, ceiling, round(ceiling - tau_mean, 6) + 0.0 as gap, case when ceiling is null then 'not interpretable'
          when ceiling - tau_mean <= 0.05 then 'close to ceiling' when tau_mean < 0.3 then 'far below ceiling' else 'materially below ceiling' end as reading
        from crossed left join ceil using (dataset)"""),
}
