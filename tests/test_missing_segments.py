"""J7 meets expected and stored segments in one sort."""

import random

from mediatally.operators import fetch


def test_repeats_and_nulls_and_one_sort(spark):
    rng = random.Random(3)
    pick = lambda n: rng.choice([None, *range(n)])
    want = [(pick(4), pick(6)) for _ in range(60)]  # an expected segment may repeat
    have = [(pick(4), pick(6)) for _ in range(25)]  # and so may a stored one
    schema = "task_id bigint, segment_index bigint"
    got = fetch.missing_segments(spark.createDataFrame(want, schema), spark.createDataFrame(have, schema))
    rows = {r.task_id: (r.expected, r.present, r.missing, r.first_missing, r.decision) for r in got.collect()}
    stored, model = {s for s in have if None not in s}, {}
    for task in {t for t, _ in want}:
        own = [s for s in want if s[0] == task]
        gone = [s for s in own if s not in stored]
        firsts = [i for _, i in gone if i is not None]
        model[task] = (len(own), len(own) - len(gone), len(gone), min(firsts, default=None), "continue" if len(gone) <= 2 else "abort")
    assert rows == model
    # neither a join's two sorts nor a table of distinct segments beside them
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1
