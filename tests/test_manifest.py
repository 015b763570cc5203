"""Queries that read the window manifest once don't write it."""

import pytest

import __spark_entry__ as entry
from pairedsense.plans import windows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["sp8_filter_uncorroborated", "jn5_propagate_flag"])
def test_manifest_is_not_written(spark, monkeypatch, name):
    written, real = [], windows.stage
    monkeypatch.setattr(windows, "stage", lambda df, label="stage": written.append(label) or real(df, label))
    entry.queries()[name](spark, SF)
    assert written == ["gaps"]
