import importlib
import sys

import __spark_entry__


def test_every_query_has_a_name_and_most_have_sql():
    names, sql = set(__spark_entry__.queries()), __spark_entry__.oracle_sql()
    assert set(sql) <= names and {"findings_all_sorted", "reach_urls", "diff_counts"} <= set(sql)


def test_without_the_optional_subpackage(monkeypatch):
    for name in [n for n in sys.modules if n.startswith(("sitefold.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == "sitefold.llm":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    entry = importlib.reload(__spark_entry__)
    assert entry.queries() and not [n for n in entry.queries() if n.startswith("op")]
