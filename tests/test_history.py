import datetime

from bidloom.operators import history as H

SCHEMA = "`order` long, date date, summary string, campaign string, details array<struct<campaign:string,text:string>>"


def act(order, day, summary, campaign, *texts):
    return (order, datetime.date(2024, 1, day), summary, campaign, [(campaign, t) for t in texts])


def snapshots(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(H.campaign_snapshots(df).collect(), key=lambda r: (r.date, r.order, r.change_type))


def test_replay_and_removal_stays_in_its_snapshot(spark):
    a = "Course - Search - x"
    rows = snapshots(spark, [
        act(30, 1, "1 keyword added", a, "[one]", "two"),
        act(20, 2, "1 keyword removed", a, "[one]"),
        act(10, 3, "Budget amount changed", a, f"{a}: Budget amount changed from $5 to $7"),
    ])
    assert [r.unique_keywords for r in rows] == ["one; two", "one; two", "two"]
    assert [r.daily_budget for r in rows] == [None, None, "7"]
    assert [str(r.end_date) for r in rows] == ["2024-01-02", "2024-01-03", "None"]
    assert rows[1].change_type == "exact_keyword_remove"
    assert rows[0].change_summary == "1 broad keyword added/enabled; 1 exact keyword added/enabled"


def test_rename_carries_state_and_empty_sets_are_filled(spark):
    old, new = "Course - Search - old", "Course - Search - new"
    rows = snapshots(spark, [
        act(50, 1, "1 campaign paused", new, "Status changed from active to paused"),
        act(40, 2, "1 keyword added", new, '"w"'),
        act(30, 3, "Campaign name changed", new, f"Campaign name changed from {old} to {new}"),
        act(20, 4, "1 negative keyword added", new, "-bad"),
    ])
    assert [(r.campaign, r.status, r.unique_keywords) for r in rows] == [(old, "paused", "w"), (old, "paused", "w"), (new, "paused", "w")]
    assert rows[-1].negative_keywords == "bad"
    assert str(rows[1].end_date) == "2024-01-03"


def test_dedupe_and_set_ids(spark):
    df = spark.createDataFrame([(2, "d", "s", "c", [("c", "t")]), (1, "d", "s", "c", [("c", "t")]), (3, "d", "s2", "c", [])],
                               "`order` long, date_text string, summary string, campaign string, details array<struct<campaign:string,text:string>>")
    assert sorted(r.order for r in H.dedupe_actions(df).collect()) == [1, 3]
