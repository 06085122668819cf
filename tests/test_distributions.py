"""Distribution functions: equal rows are computed once, and inverses need few steps."""

import numpy as np
import pandas as pd
import pytest

from quillon.functions import distributions as ds


def test_equal_rows_are_computed_once(monkeypatch):
    seen = []
    made = {}
    monkeypatch.setattr(ds.F, "pandas_udf", lambda run, kind: made.setdefault("run", run) and (lambda *c: None))

    class Cell:
        def cast(self, _):
            return self

    ds._vector(lambda a, b: seen.append(len(a)) or a / b)(Cell(), Cell())
    a = pd.Series([1.0, 2.0, None, 1.0, None, 2.0] * 500)
    b = pd.Series([4.0, 4.0, 4.0, 5.0, 4.0, 4.0] * 500)
    assert np.array_equal(made["run"](a, b), a / b, equal_nan=True)
    assert np.array_equal(made["run"](a[::-1], b[::-1]), (a / b)[::-1], equal_nan=True)  # the same values in another order
    assert seen == [4]
    assert list(made["run"](a[:1], b[:1] * 2)) == [0.125] and seen == [4, 1]


@pytest.mark.parametrize("low, cdf, params", [(None, ds.norm_cdf_np, (1.0, 0.5)), (None, ds.t_cdf_np, (7.0,)), (0.0, ds.gamma_cdf_np, (2.0, 1.5)), (0.0, ds.f_cdf_np, (4.0, 9.0))])
def test_inverses_in_few_steps(low, cdf, params):
    p = np.concatenate([np.arange(1, 51) / 51, [1e-9, 1 - 1e-9, 0.0, 1.0, np.nan]])
    rows = []
    x = ds._inverse(lambda v, *a: rows.append(len(v)) or cdf(v, *a), low)(p, *(np.full(p.shape, v) for v in params))
    assert np.isnan(x[-3:]).all()
    assert cdf(x[:-3], *params) == pytest.approx(p[:-3], abs=1e-12)
    assert sum(rows) < 40 * len(p)
