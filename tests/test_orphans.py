import datetime as dt

from spanloom.operators import orphans

T = lambda d, h=0: dt.datetime(2024, 1, d, h)
REFS = "ref_table string, ref_field string, ref_key string, target_key string, ref_time timestamp"
TARGETS = "k string, ingested_at timestamp, deleted_at timestamp, ref_time int, target_key int"


def _orphans(spark, refs, targets):
    r = spark.createDataFrame([("a", "f", *x) for x in refs], REFS)
    t = spark.createDataFrame([(*x, None, None) for x in targets], TARGETS)
    return sorted((x["ref_key"], x["target_key"]) for x in orphans.find_orphans(r, t, "k").collect())


def test_missing_late_deleted_and_live(spark):
    refs = [("1", "x", T(5)), ("2", "x", T(1)), ("3", "y", T(5)), ("4", "z", T(5)), ("5", "z", T(3)), ("6", "x", T(2))]
    targets = [("x", T(2), None), ("z", T(1), T(4)), (None, T(1), None)]
    assert _orphans(spark, refs, targets) == [("2", "x"), ("3", "y"), ("4", "z")]


def test_boundaries_gaps_and_overlaps(spark):
    # live [2, 4) and [6, for ever): 4 and 5 lie between; overlapping rows make one span
    targets = [("x", T(2), T(3)), ("x", T(2, 12), T(4)), ("x", T(6), None), ("x", T(7), T(8)), ("w", T(5), T(5)), ("w", T(6), T(2))]
    refs = [(str(d), "x", T(d)) for d in range(1, 10)] + [("w", "w", T(5))]
    assert [k for k, _ in _orphans(spark, refs, targets)] == ["1", "4", "5", "w"]


def test_null_references_are_no_cases(spark):
    df = spark.createDataFrame([(1, None, T(1)), (2, "a", None), (3, "a", T(1))], "id int, k string, t timestamp")
    assert [r["ref_key"] for r in orphans.references(df, "t", "f", "id", "k", "t").collect()] == ["3"]


def test_empty_tables(spark):
    assert _orphans(spark, [("1", "x", T(1))], []) == [("1", "x")]
    assert _orphans(spark, [], [("x", T(1), None)]) == []


def test_heavy_key_gives_the_same(spark, monkeypatch):
    refs = [(str(i), "hot", T(1 + i % 20)) for i in range(300)] + [("c", "cold", T(1)), ("d", "cold", T(9)), ("e", "gone", T(2))]
    targets = [("hot", T(3), T(10)), ("hot", T(15), None), ("cold", T(5), None)]
    plain = _orphans(spark, refs, targets)
    monkeypatch.setattr(orphans, "HEAVY_SHARE", 0.5)
    assert _orphans(spark, refs, targets) == plain
    monkeypatch.setattr(orphans, "HEAVY_SHARE", 2)  # no key is heavy
    assert _orphans(spark, refs, targets) == plain
    monkeypatch.setattr(orphans, "HEAVY_SHARE", 0.001)
    monkeypatch.setattr(orphans, "HEAVY_SPANS", 1)  # too many spans: back to the shuffle
    assert _orphans(spark, refs, targets) == plain
    want = sum(not (3 <= 1 + i % 20 < 10 or 1 + i % 20 >= 15) for i in range(300)) + 2
    assert len(plain) == want


def test_only_suspect_periods_come_back(spark):
    refs = spark.createDataFrame([("a", "f", str(i), k, t) for i, (k, t) in enumerate([("x", T(5)), ("x", T(6)), ("y", T(1)), ("y", T(9)), ("z", T(3))])], REFS).selectExpr("*", "date_format(ref_time, 'yyyy-MM') AS period")
    spans = orphans.live_spans(spark.createDataFrame([("x", T(1), None), ("y", T(5), None)], "k string, ingested_at timestamp, deleted_at timestamp"), "k")
    assert sorted(r["target_key"] for r in orphans.suspect_periods(orphans.reference_periods(refs), spans).collect()) == ["y", "z"]
