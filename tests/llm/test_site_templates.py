"""Templates of hosts that they dominate, and copies of articles."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.llm.htmltext import extract_text

TERMS = "Long terms of use under every article. " * 40


@pytest.mark.parametrize("sent_rows", [10**6, -1])
def test_dominant_template_goes_and_copies_stay(spark, sent_rows):
    rng = np.random.default_rng(3)
    said = [" ".join(rng.choice([f"w{i}" for i in range(500)], 12)) for _ in range(10)]
    long = [f"<body><div class='wrap'><div class='story'><p>{x}</p></div><div class='tagline'>{TERMS}</div></div></body>" for x in said]
    mixed = [f"<body><div class='story'><p>{'copied text' if i < 9 else said[i - 9]}</p></div><div class='tagline'>{TERMS}</div></body>" for i in range(12)]
    same = ["<body><div class='story'><p>The same article again</p></div></body>"] * 10
    rows = [(i, f"http://{h}.example/{i}", x) for h, xs in (("long", long), ("mixed", mixed), ("same", same)) for i, x in enumerate(xs)]
    got = {(r.url.split("/")[2].split(".")[0], r.page_id): r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"), sent_rows=sent_rows).collect()}
    assert [got["long", i] for i in range(10)] == said
    assert [got["mixed", i] for i in range(12)] == ["copied text"] * 9 + said[:3]
    assert {got["same", i] for i in range(10)} == {"The same article again"}
