"""What decides whether queries fit a larger table: plans and Python groups."""

import re

import pytest

import parasol.queries as core
from parasol.operators import instructions

PLACES = ["contrast_after_crossing", "display_lines", "shade_bands", "shade_contrast", "street_instructions", "sun_reasons", "walking_sides"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLACES)
def test_walks_are_joined_once(spark, sf, name):
    plan = plan_of(core.QUERIES[name](spark, sf))
    assert "customer.parquet" not in plan  # stages and points are read back, not made anew in each branch
    assert len(plan) < 100_000


def test_streets_need_no_group_of_pandas_each(spark, sf):
    *_, stages, traces = core._walk(spark, sf)
    got = instructions.streets(stages, traces)
    assert not re.search(r"InPandas", plan_of(got))
    by: dict[int, list] = {}
    for r in stages.orderBy("route_id", "seq").collect():
        by.setdefault(r["route_id"], []).append(r.asDict())
    ends = {r["route_id"]: r["longueur"] for r in traces.collect()}
    want = [(k, n, g["rue"], g["s0"], min(ends[k], g["s1"])) for k, rows in by.items() for n, g in enumerate(instructions.street_groups(rows))]
    rows = got.collect()
    assert sorted(want, key=str) == sorted(((r["route_id"], r["n"], r["rue"], r["s0"], r["s1"]) for r in rows), key=str)
    last = {k: max(w[1] for w in want if w[0] == k) for k in by}
    assert all((r["manoeuvre"] == "arrivee") == (r["n"] == last[r["route_id"]]) for r in rows)


def test_walks_share_their_sidewalks(spark, sf):
    from parasol.streaming import run

    fixes, context = core._guided(spark, sf)
    a, b = (run.walk_of(r["context"]) for r in context.orderBy("walk_id").limit(2).collect())
    assert a.near is b.near and len(a.sidewalks) == 288
    assert "InPandas" not in plan_of(run.navigated(fixes, context))


def broadcasts(node) -> list[str]:
    """What the joins of a plan send to all executors, by way of the driver."""
    own = []
    if node.nodeName().startswith("Broadcast") and node.nodeName().endswith("Join"):
        own = [(node.left() if "Left" in node.buildSide().toString() else node.right()).toString()]
    below = node.children()
    return own + [x for k in range(below.size()) for x in broadcasts(below.apply(k))]


@pytest.mark.parametrize("name", ["shade_bands", "shade_contrast", "sun_reasons"])
def test_no_walks_in_a_broadcast(spark, sf, name, monkeypatch):
    kept, cut = [], core.cut
    monkeypatch.setattr(core, "cut", lambda df: (kept.append(df), cut(df))[1])
    kept.append(core.QUERIES[name](spark, sf))
    assert len(kept) == 4
    sent = [x for df in kept for x in broadcasts(df._jdf.queryExecution().sparkPlan())]
    assert sent and not [x for x in sent if "c_custkey" in x or "ExistingRDD" in x]


def test_contrast_is_joined_by_sorting_whatever_the_limit(spark, sf):
    """Spark also sends a table round by its size as it turns out in the run, if that is below the session's limit."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        df = core.shade_contrast(spark, sf)
        assert df.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    plan = plan_of(df)
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan
    assert plan.partition("Initial Plan")[0].count("SortMergeJoin") == 1  # places are made, dealt and joined once


def test_contrast_of_places(spark):
    from parasol.operators import sides

    rows = [
        (1, 0, 0.0, 40.0, "trottoir", 7, 0.2, 0.9), (1, 1, 40.0, 44.0, "traversee", None, None, None), (1, 2, 44.0, 90.0, "trottoir", None, 0.5, None),
        (2, 0, 0.0, 10.0, "trottoir", 7, 0.0, 1.0), (2, 1, 10.0, 70.0, "trottoir", 7, None, 0.5),
    ]
    stages = spark.createDataFrame(rows, "route_id long, seq int, s0 double, s1 double, kind string, i_face int, o double, o_face double")
    asked = [(1, 90.0, 10.0), (1, 90.0, 10.0), (1, 90.0, 30.0), (1, 90.0, 44.0), (2, 70.0, 0.0), (3, 50.0, 0.0)]
    got = sides.contrast(spark.createDataFrame(asked, "route_id long, longueur double, s double"), stages)
    got = [tuple(None if x is None else round(x, 9) if isinstance(x, float) else x for x in r) for r in got.orderBy("route_id", "s").collect()]
    assert got == [
        (1, 90.0, 10.0, 30.0, 0.2, 0.9, True), (1, 90.0, 10.0, 30.0, 0.2, 0.9, True),  # a place asked twice has two rows
        (1, 90.0, 30.0, 10.0, None, None, False),  # too near to the crossing
        (1, 90.0, 44.0, 50.0, 0.5, None, False),  # nothing opposite
        (2, 70.0, 0.0, 50.0, 0.8, 0.6, False),  # unknown shade counts as shade
        (3, 50.0, 0.0, 50.0, None, None, False),  # a walk without stages
    ]


def sent_walks(monkeypatch, make) -> list[str]:
    """Tables of walks in broadcasts of make()'s plan and of what it writes on its way."""
    kept, cut = [], core.cut
    monkeypatch.setattr(core, "cut", lambda df: (kept.append(df), cut(df))[1])
    kept.append(make())
    sent = [x for df in kept for x in broadcasts(df._jdf.queryExecution().sparkPlan())]
    assert sent
    return [x for x in sent if "c_custkey" in x or "ExistingRDD" in x]


def test_sides_send_no_walks_round(spark, sf, monkeypatch):
    assert not sent_walks(monkeypatch, lambda: core.walking_sides(spark, sf))


def test_calls_send_no_walks_round(spark, sf, monkeypatch):
    assert not sent_walks(monkeypatch, lambda: core.recalculation_requests(spark, sf))


def test_sidewalks_of_all_walks_are_not_shuffled(spark, sf):
    plan = core.recalculation_requests(spark, sf)._jdf.queryExecution().sparkPlan().toString().splitlines()
    at = lambda what: [k for k, x in enumerate(plan) if what in x]
    (python,), (added,), (dealt,) = at("MapInArrow run"), at("substr(scalar-subquery"), at("REPARTITION_BY_COL")
    assert python < added < dealt


def test_calls_are_where_their_fixes_are(spark, sf):
    from parasol.streaming import run

    fixes, context = core._guided(spark, sf)
    got = run.navigated(fixes, context).cache()
    want = run.recalculations(got.drop("lon", "lat"), fixes, core.city.requests(spark, sf)).collect()
    assert want and sorted(want) == sorted(core.recalculation_requests(spark, sf).collect())


def test_fixes_meet_streets_without_sorting_pairs(spark, sf):
    """A fix meets hundreds of stretches: what sorts must get only those at the least distance."""
    lines = core.followed_streets(spark, sf)._jdf.queryExecution().sparkPlan().toString().splitlines()
    joins = [k for k, line in enumerate(lines) if "Join" in line]
    over = [next(x for x in reversed(lines[: k + 1]) if "d_least" in x or "Aggregate" in x) for k in joins]
    assert len(joins) == 2 and "Aggregate" not in over[0] and "HashAggregate" in over[1]


def test_walks_are_dealt_with_their_contexts(spark, sf):
    """Fixes and contexts are both dealt by walk where they are joined, and Spark drops a repartition that is the same;
    but it then joins small partitions on each side as their sizes say, and walks lose their contexts."""
    assert plan_of(core.recalculation_requests(spark, sf)).count("REPARTITION_BY_COL") == 1
