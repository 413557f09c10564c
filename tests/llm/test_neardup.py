"""Near duplicates where rows repeat doc_ids, and where one text fills much of the table."""

from bidframe.llm import neardup


def words(a, b):
    return " ".join(f"w{k}" for k in range(a, b))


def test_repeated_ids_with_other_texts(spark):
    """Document 5 has two texts; each row goes with the copies of its own, whichever comes first."""
    rows = [(5, words(0, 60)), (5, words(100, 170)), (6, words(0, 61)), (7, words(100, 171)), (8, words(200, 260)), (5, words(0, 60)), (9, words(200, 261)), (3, words(100, 170))]
    for some in (rows, rows[::-1]):
        got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(some, "doc_id long, text string").repartition(3)).collect()}
        assert got[5, 56] == (5, True) and got[6, 57] == (5, False)
        assert got[3, 66] == (3, True) and got[7, 67] == got[5, 66] == (3, False)
        assert got[8, 56] == (8, True) and got[9, 57] == (8, False)


def test_a_third_of_all_rows_is_one_text(spark):
    rows = [(k, words(0, 40)) for k in range(700)] + [(1000 + k, words(50 * k, 50 * k + 40)) for k in range(1, 1300)] + [(5000, words(0, 41)), (5001, None), (5002, ""), (None, words(0, 40))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    part = {r.doc_id: r.component_id for r in got}
    assert len(got) == len(rows) and all(part[k] == 0 for k in range(700)) and part[5000] == 0 and part[None] is None
    assert all(part[1000 + k] == 1000 + k for k in range(1, 1300)) and part[5001] == 5001 and part[5002] == 5002
    assert sum(r.kept for r in got) == 1 + 1299 + 3
