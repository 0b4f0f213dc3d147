"""Every query of the subpackage runs over its whole tables and gives distinct rows of a fixed shape."""

from __future__ import annotations

import pytest

from pricetide.llm import queries

SHAPES = {
    "p1_found": {"first_listing_id": "bigint", "listing_id": "bigint"}, "p2_found": {"result_id_a": "bigint", "result_id_b": "bigint"}, "p3_found": {"field_name": "string", "record_id": "bigint", "ref_id": "bigint"},
    "p4_found": {"id_a": "bigint", "id_b": "bigint"}, "p6_found": {"group_id": "bigint", "field_name": "string", "candidate_id": "bigint"}, "p7_ids": {"doc_id": "bigint", "ids": "array<int>"},
    "p8_found": {"doc_id": "bigint", "item_id": "bigint"}, "p9_found": {"doc_id": "bigint", "pii_type": "string", "pii_text": "string"},
}


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, data, name):
    df = queries.queries()[name](spark, data)
    rows = df.collect()
    assert rows
    if name in SHAPES:
        assert dict(df.dtypes) == SHAPES[name]
        assert len({repr(r) for r in rows}) == len(rows)


def test_nothing_else_imports_the_subpackage():
    import pathlib
    import re
    root = pathlib.Path(queries.__file__).parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"pricetide\.llm|from \.+llm", f.read_text(encoding="utf-8")), f
