"""Every query of the text operators runs and has stable columns."""

import pytest

from inkwell.llm.queries import R

DATA = "/root/testdata/sf0.001"
COLUMNS = {"p2_found": ["chapter_id", "para_no"], "p3_found": ["entry_id", "source_no", "zh_no"], "p4_found": ["chapter_id", "para_no"], "p5_found": ["chapter_id", "para_no"], "p6_found": ["chapter_id", "para_no"]}


@pytest.mark.parametrize("name", sorted(R.queries))
def test_query(spark, name):
    df = R.queries[name](spark, DATA)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert len(set(rows)) == len(rows)
