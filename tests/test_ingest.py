"""Labels and cascades on small rows."""

import datetime

from bidframe.operators import ingest


def test_labels_that_say_nothing_change_nothing(spark):
    deals = spark.createDataFrame([(k, k % 2, f"old{k}") for k in range(1, 7)], "id long, completion_label int, label_source string")
    lines = [(1, "1_x_2", "1", "https://s", ""), (2, "1", "?", "later", "n"), (3, "3", None, "s", "n"), (4, "4", " 0 ", "", " seen "), (5, "5_99", "1", "https://t", "note"), (6, None, "1", "s", "n"), (7, "6", "1", None, None)]
    labels = spark.createDataFrame(lines, "line long, id_cluster string, label_y string, label_source string, label_notes string")
    got, unknown = ingest.apply_labels(deals, labels, "2026-01-31")
    day = datetime.date(2026, 1, 31)
    assert {r.id: (r.completion_label, r.label_source, r.label_date) for r in got.collect()} == {
        1: (1, "https://s", day), 2: (1, "https://s", day), 3: (1, "old3", None), 4: (0, "seen", day), 5: (1, "https://t | note", day), 6: (1, None, day),
    }
    assert [r.id for r in unknown.collect()] == [99]


def test_cascade_counts_what_the_result_holds(spark):
    deals = spark.createDataFrame([(1, "A-1"), (2, "A-2"), (3, "B-1"), (4, None)], "id long, regulator_ref string")
    events = spark.createDataFrame([(1,), (1,), (3,), (None,)], "deal_id long")
    kept, after, counts = ingest.cascade_delete(deals, {"events": events}, "A-%")
    assert {r.id for r in kept.collect()} == {3, 4} and after["events"].count() == 2
    assert {tuple(r) for r in counts.collect()} == {("deals", 4, 2, 0), ("events", 4, 2, 0)}
