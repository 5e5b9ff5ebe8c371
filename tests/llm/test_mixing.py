import pytest
from pyspark.sql import functions as F
from tessella.llm import mixing

ROWS = [(k, "w " * (k % 37), f"s{k % 7}" if k % 11 else None) for k in range(400)] + [(1, "w", "s1"), (1, "w", "s1"), (None, "a b c", "s2"), (500, None, "s3"), (501, " \n", None), (502, "x", "empty"), (503, "", "nothing"), (504, "y " * 5000, "long")]
DOCS = "doc_id long, text string, source string"


def plain_targets(sizes):
    """Targets by giving the excess to the others, again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full and sizes[s]]
        rest = total - sum(2 * sizes[s] for s in full)
        rate = rest / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * rate >= 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in full else weight[s] * rate if sizes[s] else 0 for s in names}
        full |= over


def test_targets_and_taken_words(spark):
    docs = spark.createDataFrame(ROWS, DOCS).withColumns({"size": F.lit("clash"), "target": F.lit(1)})
    found = mixing.assign(spark, docs).collect()
    assert len(found) == len(ROWS)
    sizes, taken = {}, {}
    for r in found:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 2 * r["size"]
    expected = plain_targets(sizes)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(expected[r.source])
    for source, n in taken.items():
        assert abs(n - expected[source]) <= 1
    again = mixing.assign(spark, docs.repartition(9)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    assert mixing.assign(spark, docs.limit(0)).count() == 0


def test_positions_follow_the_schedules():
    for schedule in (*mixing.SCHEDULES, ((0.0, 1.0), (0.25, 3.0), (0.5, 0.0), (1.0, 0.5))):
        segments = mixing.integral(schedule)
        assert sum((b - a) * (w + s * (b - a) / 2) for a, b, w, s, _ in segments) == pytest.approx(1)


def test_inverse_of_the_integral(spark):
    schedule = ((0.0, 1.0), (0.25, 3.0), (0.5, 0.0), (1.0, 0.5))
    shares = [k / 50 for k in range(51)]
    times = [r[0] for r in spark.createDataFrame([(x,) for x in shares], "x double").select(mixing.position(F.col("x"), schedule)).collect()]

    def demand(t):
        return sum((min(t, b) - a) * (w + s * (min(t, b) - a) / 2) for a, b, w, s, _ in mixing.integral(schedule) if t > a)

    assert [demand(t) for t in times] == pytest.approx(shares, abs=1e-9)


def test_curriculum(spark):
    docs = spark.createDataFrame(ROWS, DOCS).withColumn("epoch", F.lit("kept"))
    rows = mixing.curriculum(spark, docs).collect()
    given = {r.doc_id: 0 for r in rows}
    for r in rows:
        given[r.doc_id] += r._words
    words = {}
    for r in mixing.assign(spark, docs).collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + r.taken
    assert {k: v for k, v in given.items() if v} == {k: v for k, v in words.items() if v}
    places = [r._position for r in rows]
    assert places == sorted(places) and 0 <= places[0] and places[-1] <= 1
    assert {r.epoch for r in rows} == {"kept"}
    rising = [r._position for r in rows if r.source == "s2"]  # the sixth source in order has the rising schedule
    assert sum(rising) / len(rising) > 0.6
