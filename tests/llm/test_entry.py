"""The driver's contract when optional parts can't be imported."""

import importlib

import pytest

import __spark_entry__ as entry
from vestry.plans import queries


@pytest.mark.parametrize("gone", ["vestry.llm.queries", "corpus_pipeline"])
@pytest.mark.parametrize("error", [ImportError("broken"), ModuleNotFoundError("gone", name="a library of theirs")])
def test_optional_parts_that_dont_import(monkeypatch, gone, error):
    real = importlib.import_module

    def broken(name, *rest):
        if name == gone:
            raise error
        return real(name, *rest)

    monkeypatch.setattr(entry.importlib, "import_module", broken)
    with pytest.warns(UserWarning, match=gone):
        left = entry.queries()
    assert set(queries.QUERIES) <= set(left) and "pipeline" not in left and (gone == "corpus_pipeline") == ("op3_decontamination" in left)
