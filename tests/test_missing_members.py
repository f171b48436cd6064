"""Missing numbers of groups, from bits and from sets."""

import random

import pytest

from seqmine.operators import segment


@pytest.mark.parametrize("most", [7, 62, 63, 200])
def test_missing_members_as_bits_and_as_sets(spark, most):
    rng = random.Random(most)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, rng.randrange(-2, most + 3)]), rng.choice([None, 0, most, most // 2])) for _ in range(120)]
    rows += [(9, 0, 0), (10, 1, None), (11, most + 1, most), (12, None, most)] + [(13, k, most) for k in range(most)]
    df = spark.createDataFrame(rows, "g long, chunk int, expected int")
    want = []
    for g in {r[0] for r in rows}:
        n = max((e for k, _, e in rows if k == g and e is not None), default=0)
        have = {c for k, c, e in rows if k == g and c is not None and e is not None and 0 <= c < e}
        want += [(g or 0, c) for c in range(n) if c not in have]
    got = segment.missing_members(df, ["g"])
    assert sorted((r.g or 0, r.missing) for r in got.collect()) == sorted(want)
    assert dict(got.dtypes) == {"g": "bigint", "missing": "bigint"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("ObjectHashAggregate" in plan) == (most > 62)
