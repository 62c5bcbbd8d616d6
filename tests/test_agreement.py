"""Properties of the agreement metrics on seeded random vectors, and brute force for tau."""

import itertools
import math
import random

import pytest

from labelwatch.operators import agreement as ag

SCHEMA = "p string, feature string, abs_a double, abs_b double, signed_a double, signed_b double, rho_a double, rho_b double"


def pair(spark, a, b, sa=None, sb=None, ra=None, rb=None, name="x"):
    n = len(a)
    fill = lambda v: v or [1.0] * n
    rows = [(name, f"f{i:02d}", *map(float, t)) for i, t in enumerate(zip(a, b, fill(sa), fill(sb), fill(ra), fill(rb)))]
    return spark.createDataFrame(rows, SCHEMA)


def brute_tau(a, b):
    sg = lambda v: (v > 0) - (v < 0)
    s = sa = sb = 0
    for i, j in itertools.combinations(range(len(a)), 2):
        x, y = sg(a[i] - a[j]), sg(b[i] - b[j])
        s, sa, sb = s + x * y, sa + abs(x), sb + abs(y)
    return s / math.sqrt(sa * sb) if sa and sb else None


def vector(n, seed, levels=None):
    rng = random.Random(seed)
    return [rng.randrange(levels) if levels else rng.random() + 0.01 for _ in range(n)]


@pytest.mark.parametrize("n,levels", [(2, None), (17, None), (33, 4), (40, 2), (64, 9)])
def test_tau_equals_brute_force_with_ties(spark, n, levels):
    a, b = vector(n, 1, levels), vector(n, 2, levels)
    got = ag.kendall_tau(pair(spark, a, b), ["p"]).first()["tau"]
    want = brute_tau(a, b)
    assert got is None if want is None else got == pytest.approx(want, abs=1e-12)


def test_identity_and_reversal(spark):
    up = list(range(1, 21))
    assert ag.kendall_tau(pair(spark, up, up), ["p"]).first()["tau"] == pytest.approx(1.0)
    assert ag.kendall_tau(pair(spark, up, up[::-1]), ["p"]).first()["tau"] == pytest.approx(-1.0)
    assert ag.jaccard_at_k(pair(spark, up, up[::-1]), ["p"], (5,)).first()["jaccard"] == 0.0
    assert ag.jaccard_at_k(pair(spark, up, up), ["p"], (500,)).first()["jaccard"] == 1.0  # k clamps


def test_constant_side_has_no_tau(spark):
    assert ag.kendall_tau(pair(spark, [1, 1, 1], [1, 2, 3]), ["p"]).first()["tau"] is None


def test_permutation_p_is_never_zero_and_repeatable(spark):
    up = vector(30, 3)
    run = lambda: ag.permutation_null(pair(spark, up, up), ["p"], n_perm=200).first()
    first = run()
    assert first["p_empirical"] == pytest.approx(1 / 201, abs=1e-6) and first == run()


def test_sign_agreement_zero_and_negation(spark):
    a, b = [0, .5, -.5], [.3, .5, -.5]
    got = ag.sign_agreement_all(pair(spark, [1, 2, 3], [1, 2, 3], a, b), ["p"]).first()["percent_all"]
    assert got == pytest.approx(66.666667)
    s = vector(10, 4)
    neg = [-x for x in s]
    assert ag.sign_agreement_topk(pair(spark, s, s, s, neg), ["p"], (10,)).first()["percent"] == 0.0


def test_tail_noise_does_not_reach_top_k(spark):
    rng = random.Random(5)
    a = [1 + rng.random() for _ in range(20)] + [1e-6 * rng.random() for _ in range(30)]
    sb = a[:20] + [x * rng.choice((-1, 1)) for x in a[20:]]
    p = pair(spark, a, a, a, sb)
    assert ag.sign_agreement_topk(p, ["p"], (10,)).first()["percent"] == 100.0
    assert ag.sign_agreement_all(p, ["p"]).first()["percent_all"] < 80
    assert ag.sign_agreement_weighted(p, ["p"]).first()["percent_weighted"] > 99


def test_too_few_shared_features_gives_null(spark):
    up = [float(i) for i in range(1, 11)]
    row = ag.sign_agreement_topk(pair(spark, up, up[::-1]), ["p"], (2,)).first()
    assert row["percent"] is None and row["n_features"] < 3


def test_directional_denominator_is_k(spark):
    row = ag.directional_consistency(pair(spark, [3, 2, 1], [3, 2, 1], ra=[.9, .1, .9], rb=[.9, .9, -.9]), ["p"], (3,)).first()
    assert (row["n_considered"], row["n_meeting"], row["n_agreeing"]) == (3, 2, 1)
    assert row["percent"] == pytest.approx(33.333333)


def test_bootstrap_brackets_the_point(spark):
    a = vector(25, 6)
    b = [x + 0.01 * y for x, y in zip(a, vector(25, 7))]
    row = ag.bootstrap_tau_ci(pair(spark, a, b), ["p"], n=100).first()
    assert row["ci_lower"] <= row["point"] <= row["ci_upper"] and row["ci_lower"] > 0.5


def test_k_must_be_positive(spark):
    with pytest.raises(ValueError):
        ag.jaccard_at_k(pair(spark, [1], [1]), ["p"], (0,))


@pytest.mark.parametrize("n", range(2, 9))
def test_exact_p_equals_all_permutations(spark, n):
    order = list(range(n))
    scores = [sum((x > y) - (x < y) for x, y in itertools.combinations(q, 2)) for q in itertools.permutations(order)]
    frames = []
    for seed in range(3):
        b = random.Random(seed).sample(order, n) if seed else order
        frames.append((b, pair(spark, order, b, name=str(seed))))
    rows = frames[0][1].unionByName(frames[1][1]).unionByName(frames[2][1])
    got = {r["p"]: r for r in ag.kendall_pvalue(rows, ["p"]).collect()}
    for seed, (b, _) in enumerate(frames):
        own = abs(sum((x > y) - (x < y) for x, y in itertools.combinations(b, 2)))
        want = sum(abs(s) >= own for s in scores) / len(scores)
        assert got[str(seed)]["method"] == "exact" and got[str(seed)]["p_value"] == pytest.approx(want, abs=1e-6)


def test_method_of_the_p_value(spark):
    line = [float(i) for i in range(40)]
    swapped = [1.0, 0.0, *line[2:]]
    cases = {"long": (line, vector(40, 3)), "tied": ([1.0, 1.0, 2.0, 3.0], [4.0, 3.0, 2.0, 1.0]), "same": (line, line), "swap": (line, swapped),
             "edge": (line[:33], vector(33, 3)), "over": (line[:34], vector(34, 3)), "flat": ([1.0] * 4, line[:4]), "one": ([1.0], [2.0])}
    rows = None
    for name, (a, b) in cases.items():
        own = pair(spark, a, b, name=name)
        rows = own if rows is None else rows.unionByName(own)
    got = {r["p"]: r for r in ag.kendall_pvalue(rows, ["p"]).collect()}
    assert {k: r["method"] for k, r in got.items()} == {"long": "normal", "tied": "normal", "same": "exact", "swap": "exact", "edge": "exact",
                                                        "over": "normal", "flat": None, "one": None}
    assert got["same"]["p_value"] == got["swap"]["p_value"] == 0.0 and got["flat"]["p_value"] is None
    assert got["edge"]["p_value"] == pytest.approx(got["edge"]["p_normal"], abs=0.02)
