import random

import pytest

from chomeflow.llm import components
from chomeflow.llm.tables import Scratch


@pytest.mark.parametrize("one_task", [1_000_000, 0])
def test_components(spark, one_task, monkeypatch):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    r = random.Random(2)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(500 + i, 501 + i) for i in range(12)] + [(7, 7), (500, 501)]
    root = {x: x for pair in links for x in pair}
    for _ in range(300):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = components.connected_components(spark.createDataFrame(links, "_a long, _b long"), Scratch(spark, "test"))
    rows = got.collect()
    assert len(rows) == len(linked) and {x["node"]: x["comp"] for x in rows} == {x: root[x] for x in linked}
    none = components.connected_components(spark.createDataFrame([], "_a long, _b long"), Scratch(spark, "test"))
    assert none.count() == 0
