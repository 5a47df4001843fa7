import pytest

from triagework.operators import ranges
from triagework.session import settle

SCHEMA = "Priority_Level string, Issue_Category string, Resolution_Time_Hours double"


def history(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def table(spark):
    rows = [("High", "Fraud", float(n)) for n in range(30)] + [("High", "Fraud", None)] * 5
    rows += [("High", "Billing", float(n)) for n in range(29)]
    rows += [("Low", "Billing", 100.0), ("Medium", "Fraud", None), (None, "Fraud", 50.0), ("High", None, 3.0)]
    return settle(ranges.resolution_ranges(history(spark, rows)))


def lookup(spark, table, priority, category):
    ticket = spark.createDataFrame([(priority, category)], "Priority_Level string, Issue_Category string")
    row = ranges.with_range_text(ranges.resolution_lookup(ticket, table)).first()
    return row.range_level, row.expected_resolution_range


def test_thirty_known_hours_make_a_pair(spark, table):
    assert lookup(spark, table, "High", "Fraud") == ("pair", "7.2–21.8 hours")


def test_twenty_nine_fall_back_to_the_priority(spark, table):
    assert lookup(spark, table, "High", "Billing")[0] == "priority"
    assert lookup(spark, table, "High", None)[0] == "priority"
    assert lookup(spark, table, "High", "billing")[0] == "priority"


def test_one_row_is_enough_for_a_priority(spark, table):
    assert lookup(spark, table, "Low", "Fraud") == ("priority", "100–100 hours")


def test_unknown_priorities_take_the_overall_range(spark, table):
    overall = lookup(spark, table, None, "Fraud")
    assert overall[0] == "all"
    assert lookup(spark, table, "Medium", "Fraud") == overall
    assert lookup(spark, table, "Urgent", "Fraud") == overall


def test_no_hours_at_all(spark):
    empty = settle(ranges.resolution_ranges(history(spark, [("High", "Fraud", None)])))
    assert empty.count() == 0
    assert lookup(spark, empty, "High", "Fraud") == (None, "Unavailable")


def test_missing_columns_stop_the_job(spark):
    with pytest.raises(ValueError, match="Resolution_Time_Hours"):
        ranges.resolution_ranges(spark.createDataFrame([("a", "b")], "Priority_Level string, Issue_Category string"))


def test_statistics_of_a_group_without_hours(spark):
    rows = [("High", "Fraud", 1.0), ("High", "Fraud", 2.0), ("Low", "Fraud", None), ("Low2", "x", 4.0)]
    found = {r.Priority_Level: tuple(r)[1:] for r in ranges.hours_by(history(spark, rows), "Priority_Level").collect()}
    assert found == {"High": (2, 1.5, 1.5, 0.71), "Low": (0, None, None, None), "Low2": (1, 4.0, 4.0, None)}


def test_wide_lookup_without_broadcast(spark, table, monkeypatch):
    monkeypatch.setattr("triagework.session.MAX_BROADCAST_ROWS", 0)
    assert lookup(spark, table, "High", "Fraud") == ("pair", "7.2–21.8 hours")


def test_serving_without_a_usable_history(spark):
    assert ranges.available_ranges(None) is None
    assert ranges.available_ranges(spark.range(3)) is None
    assert lookup(spark, None, "High", "Fraud") == (None, "Unavailable")
    assert ranges.available_ranges(history(spark, [("High", "Fraud", 1.0)])).count() == 3
