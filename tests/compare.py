"""Row-by-row comparison of a query with its SQL."""

import numpy as np


def same_rows(got, want):
    got, want = got[sorted(got.columns)], want[sorted(want.columns)]
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    got, want = (x.sort_values(list(x.columns)).reset_index(drop=True) for x in (got, want))
    for c in got.columns:
        a, b = got[c], want[c]
        if a.dtype.kind == "f" or b.dtype.kind == "f":
            np.testing.assert_allclose(a.astype(float), b.astype(float), rtol=1e-9, atol=1e-9, err_msg=c)
        else:
            assert ((a == b) | (a.isna() & b.isna())).all(), c
