import re
import sys

from repochron.llm.queries import QUERIES, SQL


def test_one_query_for_each_operator_and_sql_is_text():
    numbers = [int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES]
    assert numbers == list(range(1, 14)) and all(callable(f) for f in QUERIES.values())
    assert set(SQL) <= set(QUERIES) and all(isinstance(s, str) for s in SQL.values())


def test_entry_registers_them_with_the_pipeline():
    import __spark_entry__ as entry
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_of_the_library_does_not_import_this_package():
    import subprocess
    code = ("import sys; import repochron.plans.catalog, repochron.plans.stages, repochron.plans.oracle;"
            "print([m for m in sys.modules if m.startswith('repochron.llm')])")
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True).stdout.strip() == "[]"
