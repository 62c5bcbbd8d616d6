"""Registered label-leakage queries."""

from labelwatch.operators import leakage as lk
from labelwatch.operators import stumps
from labelwatch.operators.splitting import stratified_split
from labelwatch.sources import views as v


def tree_scores(spark, folder):
    """Single-feature tree scores of every audited view."""
    return tree_scores_of([v.stored_view(view(spark, folder)) for view in v.VIEWS.values()])


def tree_scores_of(tables):
    return stumps.single_feature_tree([stratified_split(t) for t in tables])


QUERIES = {
    "class_distribution": lambda s, p: lk.class_distribution(v.line_returned(s, p)),
    "class_distribution_planted": lambda s, p: lk.class_distribution(v.planted(s, p)),
    "class_top_values": lambda s, p: lk.class_top_values(v.line_returned(s, p)),
    "class_top_values_text": lambda s, p: lk.class_top_values_text(v.doc_quality(s, p)),
    "best_threshold": lambda s, p: lk.best_threshold(v.line_returned(s, p)),
    "best_threshold_planted": lambda s, p: lk.best_threshold(v.planted(s, p)),
    "separation_type": lambda s, p: lk.separation_type(v.planted(s, p)),
    "class_histogram": lambda s, p: lk.class_histogram(v.line_returned(s, p)),
    "class_histogram_clipped": lambda s, p: lk.class_histogram(v.line_returned(s, p), 44, (0.005, 0.995)),
    "single_feature_tree": lambda s, p: stumps.single_feature_tree([stratified_split(v.planted(s, p))]),
    "single_feature_tree_lines": lambda s, p: stumps.single_feature_tree([stratified_split(v.line_returned(s, p))]),
    "mutual_information": lambda s, p: lk.mutual_information(v.line_returned(s, p)),
    "mutual_information_planted": lambda s, p: lk.mutual_information(v.planted(s, p)),
    "near_oracle_count": lambda s, p: lk.near_oracle_count(tree_scores(s, p)),
    "targeted_investigation": lambda s, p: stumps.targeted_investigation(
        stratified_split(v.planted(s, p)), "leak_point_mass"),
    "constant_rule_score": lambda s, p: lk.constant_rule_score(v.planted(s, p), "leak_point_mass", 97.0),
}
