"""SQL for what must hold of the fitted models: row counts of the explained sample and additivity."""

from oracles.leakage import split_cte
from oracles.views import query

EXPLAINED = 2000


def _additive(select):
    rows = f"(select least({EXPLAINED}, count(*)) from split_rows where split = 'test') as n_rows, true as additive"
    return query(["planted"], split_cte("planted"), select=select.format(rows=rows))


ORACLES = {
    "search_plan": "select 'planted' as dataset, l as learner, 50::bigint as n_trials, 50::bigint as n_cells, true as scored from "
                   "(values ('boosted_deep'), ('boosted_wide'), ('forest')) x(l)",
    # planted leaks can be removed, a random label cannot be learned
    "screen_verdicts": "select dataset, (select count(*) from orders) as n_rows, verdict, verdict = 'repairable' as any_removed "
                       "from (values ('planted', 'repairable'), ('order_status', 'clean')) x(dataset, verdict)",
    "attribution_tree_additivity": _additive("select 'planted' as dataset, {rows}"),
    "attribution_members_additivity": _additive(
        "select 'planted' as dataset, member, {rows} from (values ('forest'), ('boosted_deep'), ('boosted_wide'), ('ensemble')) m(member)"),
}
