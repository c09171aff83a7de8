"""Distribution functions: tabulated values and identities."""
import math

import numpy as np
import pytest

from lamella.functions import special as S


def test_lgamma():
    x = np.array([0.1, 0.5, 1, 2.5, 10, 300.0])
    np.testing.assert_allclose(S.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


def test_t_table():
    assert S.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert S.t_two_sided(12.70620474, 1) == pytest.approx(0.05, abs=1e-9)
    assert S.t_two_sided(-2.0, 30) == pytest.approx(float(S.t_two_sided(2.0, 30)))


def test_f_is_t_squared():
    for t, d in ((0.3, 4), (1.7, 25), (4.0, 90)):
        assert S.f_upper(t * t, 1, d) == pytest.approx(float(S.t_two_sided(t, d)), abs=1e-12)


def test_beta_symmetry():
    x = np.linspace(0.01, 0.99, 25)
    np.testing.assert_allclose(S.betainc(2.3, 5.1, x) + S.betainc(5.1, 2.3, 1 - x), 1, atol=1e-12)


def test_pvalue_does_not_depend_on_the_batch():
    t = np.linspace(-5, 5, 401)
    whole = S.t_two_sided(t, np.full_like(t, 98.0))
    assert all(whole[i] == S.t_two_sided(t[i:i + 1], np.array([98.0]))[0] for i in range(0, 401, 13))


def test_normal_quantile_inverts():
    p = np.array([1e-12, 1e-4, 0.025, 0.5, 0.9, 1 - 1e-6])
    np.testing.assert_allclose(S.norm_cdf(S.norm_ppf(p)), p, rtol=1e-8)


def test_hypergeometric():
    from math import comb
    want = sum(comb(20, x) * comb(80, 15 - x) for x in range(5, 16)) / comb(100, 15)
    assert S.hyper_upper([5], [20], [100], [15])[0] == pytest.approx(want, rel=1e-10)


def test_trigamma_inverse():
    # trigamma(1) = pi^2 / 6
    assert S.trigamma_inverse(math.pi ** 2 / 6) == pytest.approx(1.0, abs=1e-8)
    assert S.digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-10)
