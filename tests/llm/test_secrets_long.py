from __future__ import annotations

import numpy as np

from logloom.llm import secrets


def test_features_of_the_whole_value():
    """What stands behind the first 512 characters counts as much as what stands before."""
    at = {name: i for i, name in enumerate(secrets.FEATURES)}
    value = "the" * 200 + "9F" * 300
    got = secrets.finding_features(secrets.Finding(0, len(value), "name", value, "token=", ""))
    assert got[at["digits"]] == got[at["upper"]] == 300 / 1200 and got[at["lower"]] == 600 / 1200
    share = np.array([200, 200, 200, 300, 300]) / 1200
    assert np.isclose(got[at["entropy"]], -(share * np.log2(share)).sum()) and got[at["distinct"]] == 5 / 1200
