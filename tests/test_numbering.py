"""Numbers of rows that one task need not sort."""

import random

from inkstrata.operators import sequence


def test_numbers_of_a_hot_group(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + ["b", None]), i % 5, i) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, a int, b int").repartition(6)
    got = {(r["g"], r["b"]): (r["page_order_no"], r["collected_no"]) for r in sequence.two_numberings(df, ["b"], ["a", "b"], ["g"]).collect()}
    for g in ("hot", "b", None):
        mine = [r for r in rows if r[0] == g]
        for n, r in enumerate(sorted(mine, key=lambda r: r[2]), 1):
            assert got[g, r[2]][0] == n
        for n, r in enumerate(sorted(mine, key=lambda r: r[1:]), 1):
            assert got[g, r[2]][1] == n
    assert len(got) == 3000
