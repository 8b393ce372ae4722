"""The driver's entry with and without the optional parts."""

import sys

import pytest

import __spark_entry__ as entry
from navspark.catalogue import all_queries


def test_what_is_missing_is_left_out(monkeypatch):
    monkeypatch.setitem(sys.modules, "navspark.llm.queries", None)
    assert set(entry.queries()) == set(all_queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_errors_of_what_is_there_are_not_swallowed(tmp_path, monkeypatch):
    (tmp_path / "half_there.py").write_text("import nothing_of_that_name\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert entry._optional("not_there_at_all.queries") is None
    with pytest.raises(ModuleNotFoundError):
        entry._optional("half_there")
