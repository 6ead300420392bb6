"""Line dedup where rows repeat an id, against its SQL's count of distinct ids."""

from __future__ import annotations

import pytest

from tessera.llm.linededup import dedup_lines

LINE = "A line of text that is long enough, forty characters or more."


@pytest.mark.parametrize("sent_rows", [1 << 20, -1])
@pytest.mark.parametrize("parts", [1, 7])
def test_rows_of_one_id_are_one_document(spark, sent_rows, parts):
    rows = [(1, LINE)] + [(2, LINE)] * 4 + [(10 + k, LINE.replace("line", "row")) for k in range(5)] + [(14, LINE.replace("line", "row"))] * 3
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), sent_rows=sent_rows).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.n_dropped for r in got} == {1: 0, 2: 0, 10: 1, 11: 1, 12: 1, 13: 1, 14: 0}
