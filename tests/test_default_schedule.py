"""The flattening queries run the operator's defaults, not a shorter schedule."""

import os

import pytest

from meshql.config import FlattenConfig
from meshql.plans import catalog

from . import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.SF), reason="no tables")


def test_flatten_kernel_has_all_phases(spark):
    rows = catalog.QUERIES["flatten_kernel"](spark, oracle.SF).collect()
    assert {p.name for p in FlattenConfig().phases} <= {r["phase"] for r in rows} and "smoothing" in {r["phase"] for r in rows}


def test_angular_kring_reaches_seven_rings(spark):
    width = 12
    far = {(r["src"], r["dst"]) for r in catalog.QUERIES["angular_kring"](spark, oracle.SF).select("src", "dst").collect()}
    assert max(abs(a // width - b // width) for a, b in far) == FlattenConfig().kring.k_ring
