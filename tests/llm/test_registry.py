"""The entry module drops these queries if something cannot be imported; here they must all be there."""

from __future__ import annotations

import __spark_entry__ as entry


def test_all_queries_are_registered():
    names = entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 14))
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
