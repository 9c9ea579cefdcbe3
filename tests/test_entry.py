"""The entry without its optional part, and with a fault in it."""

import builtins
import importlib
import sys

import pytest

import __spark_entry__


def imported_with(monkeypatch, failing, missing):
    """The entry imported anew while importing ``failing`` raises for the module ``missing``."""
    for name in [m for m in sys.modules if m.startswith("stockloom.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    real = builtins.__import__

    def guarded(name, *args, **kwargs):
        if name == failing or name.startswith(failing + "."):
            raise ModuleNotFoundError(f"No module named {missing!r}", name=missing)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", guarded)
    return importlib.import_module("__spark_entry__")


@pytest.mark.parametrize("failing", ["corpus_pipeline", "stockloom.llm", "some_library_of_the_pipeline"])
def test_model_queries_stay_without_the_optional_part(monkeypatch, failing):
    known = {n for n in __spark_entry__.queries() if not n.startswith("op") and n != "pipeline"}
    entry = imported_with(monkeypatch, "corpus_pipeline", failing)
    assert set(entry.queries()) == known and set(entry.oracle_sql()) == known


def test_faults_of_the_library_are_not_hidden(monkeypatch):
    with pytest.raises(ModuleNotFoundError):
        imported_with(monkeypatch, "corpus_pipeline", "stockloom.session")
