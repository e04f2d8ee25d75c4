import random

import pytest
from slotwise.functions import ranking


@pytest.mark.parametrize("literal", [4096, 0])
def test_ranks_are_gapless(spark, literal, monkeypatch):
    monkeypatch.setattr(ranking, "LITERAL", literal)
    rng = random.Random(1)
    rows = [(rng.randrange(50), i) for i in range(2000)]
    frame = spark.createDataFrame(rows, "v long, i long").repartition(7)
    out, total = ranking.ranked_and_counted(frame, ["v", "i"])
    assert total == 2000
    assert {(r["v"], r["i"]): r["rank"] for r in out.collect()} == {x: k for k, x in enumerate(sorted(rows))}
    assert ranking.ranked(frame.limit(0), ["v"]).count() == 0
