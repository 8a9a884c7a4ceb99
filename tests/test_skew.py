"""One account holding a third of all rows: results stay exact (moment table partial
aggregation, skew-safe median, broadcast-or-AQE joins)."""
import numpy as np
import pandas as pd
import pytest

from acctlens.operators import crossval as CV
from acctlens.operators import features as FE
from acctlens.operators import residuals as RS
from acctlens.settings import ModelSpec


def test_hot_account_chain_matches_pandas(spark):
    rng = np.random.RandomState(0)
    n = 3000
    acc = np.where(np.arange(n) < n // 3, "HOT", rng.choice([f"A{i}" for i in range(20)], n))
    pdf = pd.DataFrame({"Account": acc, "Period": rng.randint(1, 9, n), "Units": rng.randint(1, 50, n).astype(float)})
    pdf["Sales"] = np.exp(0.8 * np.log(pdf.Units) + rng.normal(0, 0.2, n) + (pdf.Account == "HOT") * 0.3)
    df = spark.createDataFrame(pdf)
    m, design = FE.prepare(df, ModelSpec("Sales", ("Units",), ("Account",)), "Account", "Period", "Units")
    cv = CV.run_cv(m, design, 4)
    res = cv.residuals.toPandas()
    st = RS.account_stats(cv.residuals, median_cap=300).toPandas().set_index("Account")
    for a, g in res.groupby("account"):
        r, w = g.residual.values, g.weight.values
        mu = np.average(r, weights=w)
        assert st.loc[a, "w_mean_residual"] == pytest.approx(mu, abs=1e-12)
        assert st.loc[a, "w_std_residual"] == pytest.approx(np.sqrt(np.average((r - mu) ** 2, weights=w)), abs=1e-12)
        assert st.loc[a, "mad_residual"] == pytest.approx(np.median(np.abs(r - np.median(r))), abs=1e-12)
        assert st.loc[a, "count"] == len(r)
    assert st.loc["HOT", "count"] == n // 3
