import pytest
from conftest import SF_SMALL

from opsrisk.plans import catalog as C
from opsrisk.sources import tables


@pytest.mark.parametrize("name", ["recommendations_filtered", "alerts_filtered", "dummy_predictions", "dummy_strategies"])
def test_the_table_is_derived_once(spark, monkeypatch, name):
    calls = []
    derive = tables.workflows
    monkeypatch.setattr(tables, "workflows", lambda *a: calls.append(1) or derive(*a))
    got = C.QUERIES[name](spark, SF_SMALL)
    assert len(calls) == 1
    assert got.count() > 0
    # what is left to run reads saved files, not the source tables
    assert not [f for f in got.inputFiles() if "testdata" in f]


def test_the_fit_reads_written_features(spark, monkeypatch):
    read = []
    fit = C.P.WorkflowPreprocessor._fit
    monkeypatch.setattr(C.P.WorkflowPreprocessor, "_fit", lambda self, df: read.extend(df.inputFiles()) or fit(self, df))
    assert C.QUERIES["prep_onehot"](spark, SF_SMALL).count() > 0
    assert read and not [f for f in read if "testdata" in f]
