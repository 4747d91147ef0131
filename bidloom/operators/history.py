"""Change-log replay: events, renames, campaign snapshots, coverage intervals, keyword-set ids.

A change row is (order, date, summary, campaign, details). ``order`` grows with age, so replay runs
from large to small. ``tick`` is the replay position: it grows with time, and within one order the
event kinds follow the sequence keyword, negative keyword, budget, status.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from bidloom.functions import text as T
from bidloom.functions.grouped import carry, first_per_key, following
from bidloom.operators.joins import asof_backward, interval_join, stab_join
from bidloom.session import cut_lineage

# Replay sequence of event kinds inside one order.
KIND_SEQUENCE = {"keyword": 0, "negative_keyword": 1, "budget": 2, "status": 3}
KINDS = 4

# Snapshots per cell of an owner's time line, cells at most, bits of the grid their bounds lie on, comparisons held at once.
CELL_ROWS, MOST_CELLS, GRID_BITS, BLOCK = 1024, 1 << 16, 20, 1 << 22
NEVER = -(2**62)  # a place no span holds
WORD_FIELDS = {
    f"{'negative_' if negative else ''}{c}": (negative, mt) for negative in (False, True) for mt, c in T.LIST_COLUMNS.items()
}

def tick_of(order: Column, kind: str) -> Column:
    return -order * KINDS + KIND_SEQUENCE[kind]


def dedupe_actions(actions: DataFrame, date_text: str = "date_text") -> DataFrame:
    """First row in order of every (date text, campaign, summary and details) content."""
    words = F.concat_ws(" ", "summary", F.array_join(F.transform("details", lambda d: d["text"]), " "))
    keyed = actions.withColumn("_text", T.squeeze(words))
    return first_per_key(keyed, [date_text, "campaign", "_text"], ["order"]).drop("_text")


# --- renames -------------------------------------------------------------------------------


def renames(actions: DataFrame) -> DataFrame:
    """(order, date, previous_name, current_name) of search-campaign renames."""
    text = actions.select("order", "date", F.explode("details.text").alias("text")).filter(F.col("text").rlike(T.RENAME))
    named = text.select(
        "order", "date",
        T.trim_campaign(F.regexp_extract("text", T.RENAME, 1)).alias("previous_name"),
        T.trim_campaign(F.regexp_extract("text", T.RENAME, 2)).alias("current_name"),
    )
    return named.filter(T.is_search_campaign("previous_name") & T.is_search_campaign("current_name"))


def rename_paths(hops: DataFrame) -> DataFrame:
    """(origin, at, name): every hop reached from the first hop of each name in (source, name, at).

    The one successor of a hop is the first later hop out of the name it leads to, so ``at`` grows
    along a path and reused or returned names end. Jumps double in length until none is left.
    """
    nodes = cut_lineage(hops.groupBy("source", "at").agg(F.min("name").alias("name")))
    later = nodes.select(F.col("source").alias("to_source"), F.col("at").alias("to_at"))
    jumps = (
        nodes.join(later, (F.col("name") == F.col("to_source")) & (F.col("to_at") > F.col("at")))
        .groupBy("source", "at").agg(F.min(F.struct("to_at", "to_source")).alias("to"))
        .select("source", "at", "to.to_source", "to.to_at")
    )
    reached = nodes.groupBy(F.col("source").alias("origin")).agg(F.min("at").alias("at")).select("origin", F.col("origin").alias("source"), "at")
    jumps = cut_lineage(jumps)
    while not jumps.isEmpty():
        more = reached.join(jumps, ["source", "at"]).select("origin", F.col("to_source").alias("source"), F.col("to_at").alias("at"))
        reached = cut_lineage(reached.unionByName(more))
        on = jumps.select(F.col("source").alias("to_source"), F.col("at").alias("to_at"), F.col("to_source").alias("far"), F.col("to_at").alias("far_at"))
        jumps = cut_lineage(jumps.join(on, ["to_source", "to_at"]).select("source", "at", F.col("far").alias("to_source"), F.col("far_at").alias("to_at")))
    return reached.join(nodes, ["source", "at"]).select("origin", "at", "name")


def name_intervals(moves: DataFrame) -> DataFrame:
    """(campaign, newer, older, name): rows with newer < order <= older carried ``name`` then.

    The log shows a campaign's current name. Walking from new to old, each rename into the name
    replaces it by the previous name for all older rows.
    """
    chain = rename_paths(moves.select(F.col("current_name").alias("source"), F.col("previous_name").alias("name"), F.col("order").alias("at")))
    ahead = Window.partitionBy("origin").orderBy("at")
    return chain.select(F.col("origin").alias("campaign"), F.col("at").alias("newer"), F.lead("at").over(ahead).alias("older"), "name")


def canonical_names(moves: DataFrame) -> DataFrame:
    """(campaign, canonical): the latest name each renamed campaign ends up with, walking from old to new."""
    chain = rename_paths(moves.select(F.col("previous_name").alias("source"), F.col("current_name").alias("name"), (-F.col("order")).alias("at")))
    return chain.groupBy(F.col("origin").alias("campaign")).agg(F.max_by("name", "at").alias("canonical"))


@dataclass(frozen=True)
class Names:
    """Rename tables of one log: the renames, names by age, and latest names."""

    moves: DataFrame
    spans: DataFrame
    latest: DataFrame


def read_names(actions: DataFrame) -> Names:
    """Resolve the renames once; the small tables are stored, as every event kind uses them."""
    moves = cut_lineage(renames(actions))
    return Names(moves, cut_lineage(name_intervals(moves)), cut_lineage(canonical_names(moves)))


def with_name_then(rows: DataFrame, names: Names, campaign: str = "campaign") -> DataFrame:
    """Replace the logged campaign by the name that applied at the row's ``order``.

    The rename table is a small dimension; Spark broadcasts it by its size.
    """
    spans = names.spans.select(F.col("campaign").alias("_logged"), "newer", "older", "name")
    hit = (
        (F.col(campaign) == F.col("_logged"))
        & (F.col("order") > F.col("newer"))
        & (F.col("older").isNull() | (F.col("order") <= F.col("older")))
    )
    return rows.join(spans, hit, "left").withColumn(campaign, F.coalesce("name", campaign)).drop(
        "_logged", "newer", "older", "name"
    )


def with_canonical(rows: DataFrame, names: Names, campaign: str = "campaign", name: str = "owner") -> DataFrame:
    latest = names.latest.select(F.col("campaign").alias("_c"), "canonical")
    return rows.join(latest, F.col(campaign) == F.col("_c"), "left").withColumn(
        name, F.coalesce("canonical", campaign)
    ).drop("_c", "canonical")


# --- events --------------------------------------------------------------------------------


def _detail_rows(actions: DataFrame) -> DataFrame:
    shown = F.when(F.coalesce(F.col("d.campaign"), F.lit("")) != "", F.col("d.campaign")).otherwise(F.col("campaign"))
    return actions.select("order", "date", "summary", "campaign", F.posexplode("details").alias("pos", "d")).select(
        "order", "date", "summary", shown.alias("campaign"), "pos", F.col("d.text").alias("text")
    )


def keyword_events(actions: DataFrame, names: Names, negative: bool = False) -> DataFrame:
    """(order, date, campaign, keyword, match_type, action, pos) of keyword changes."""
    rows = _detail_rows(actions).withColumn("action", T.keyword_status("summary", negative)).filter("action IS NOT NULL")
    rows = with_name_then(rows, names).filter(T.is_search_campaign("campaign"))
    parsed = rows.withColumn("k", T.keyword_detail("text")).filter(F.col("k.negative") == negative)
    return parsed.select(
        "order", "date", "campaign", F.col("k.keyword").alias("keyword"),
        F.coalesce(T.summary_match_type("summary"), F.col("k.match_type")).alias("match_type"), "action", "pos",
    )


def budget_events(actions: DataFrame, names: Names) -> DataFrame:
    """(order, date, campaign, daily_budget, previous_budget, summary) of budget changes.

    A campaign named in the text is taken as it stands unless it is a prospecting campaign; the
    action's own campaign is translated to the name of that time.
    """
    text = F.concat_ws(" ", "summary", F.array_join(F.transform("details", lambda d: d["text"]), " "))
    rows = actions.withColumn("text", text).filter(F.col("text").rlike(T.BUDGET_CHANGE))
    rows = rows.withColumn("_named", T.budget_campaign("text"))
    then = with_name_then(
        rows.withColumn("campaign", F.when(F.col("_named") != "", F.col("_named")).otherwise(F.col("campaign")))
        .withColumn("_shown", F.col("campaign")),
        names,
    )
    keep = (F.col("_named") != "") & ~F.col("_shown").contains("Prospecting")
    out = then.withColumn("campaign", F.when(keep, F.col("_shown")).otherwise(F.col("campaign")))
    return out.filter(T.is_search_campaign("campaign")).select(
        "order", "date", "campaign", T.last_amount("text").alias("daily_budget"),
        T.previous_amount("text").alias("previous_budget"), "summary",
    ).filter("daily_budget <> ''")


def status_events(actions: DataFrame, names: Names) -> DataFrame:
    """(order, date, campaign, status, summary) of campaigns enabled or paused."""
    low = F.lower("summary")
    rows = actions.filter(low.contains("campaign") & (low.contains("active") | low.contains("paused")))
    detail = F.lower("text")
    status = F.when(detail.contains("to active"), F.lit("active")).when(detail.contains("to paused"), F.lit("paused"))
    rows = _detail_rows(rows).filter(detail.contains("status changed")).withColumn("status", status).filter("status IS NOT NULL")
    return with_name_then(rows, names).filter(T.is_search_campaign("campaign")).select(
        "order", "date", "campaign", "status", "summary"
    )


def describe_keyword_changes(events: DataFrame, negative: bool = False) -> DataFrame:
    """Change-type and summary text of each (order, date, campaign) group of keyword events."""
    label, prefix = ("negative keyword", "negative_") if negative else ("keyword", "")
    counts = events.groupBy("order", "date", "campaign", "match_type", "action").agg(F.count(F.lit(1)).alias("n"))
    kind = F.concat(F.lit(prefix), F.lower("match_type"), F.lit("_keyword_"), "action")
    verb = F.when(F.col("action") == "add", "added/enabled").otherwise("removed/paused")
    phrase = F.concat_ws(" ", F.col("n").cast("string"), F.lower("match_type"), F.lit(label), verb)
    parts = F.array_sort(F.collect_list(F.struct("match_type", "action", phrase.alias("phrase"))))
    return counts.groupBy("order", "date", "campaign").agg(
        F.array_join(F.array_sort(F.collect_set(kind)), ";").alias("change_type"),
        F.array_join(F.transform(parts, lambda p: p["phrase"]), "; ").alias("change_summary"),
    )


def change_dates(actions: DataFrame, names: Names) -> DataFrame:
    """Distinct (campaign, date) with any change, under the names of the time."""
    named = F.array_distinct(F.concat(F.array("campaign"), F.col("details.campaign")))
    rows = actions.filter(F.col("date").isNotNull()).select("order", "date", F.explode(named).alias("campaign"))
    return with_name_then(rows, names).filter(T.is_search_campaign("campaign")).select("campaign", "date").distinct()


def next_change_day(rows: DataFrame, days: DataFrame, keys: Sequence[str], date: str, name: str) -> DataFrame:
    """The first change day strictly after each row's day.

    Rows and change days meet on the distinct days of a key, whose number the calendar bounds.
    """
    own = rows.select(*keys, date).distinct().withColumn("_mark", F.lit(None).cast("date"))
    both = own.unionByName(days.select(*keys, date, F.col(date).alias("_mark")))
    daily = both.groupBy(*keys, date).agg(F.max("_mark").alias("_mark"))
    ahead = Window.partitionBy(*keys).orderBy(F.col(date).desc()).rowsBetween(Window.unboundedPreceding, -1)
    nxt = daily.select(*keys, date, F.last("_mark", ignorenulls=True).over(ahead).alias(name))
    return rows.join(nxt, [*keys, date], "left")


# --- snapshots -----------------------------------------------------------------------------


def _stream(actions: DataFrame, names: Names) -> tuple[DataFrame, DataFrame]:
    """(snapshot heads, keyword events of both signs), each with campaign owner and tick.

    State follows a campaign through its renames, so it is kept per owner, the latest name.
    """
    heads, words = None, None
    signs = [keyword_events(actions, names, negative).withColumn("negative", F.lit(negative)) for negative in (False, True)]
    both = cut_lineage(signs[0].unionByName(signs[1]))  # the texts are parsed once for heads and words
    for negative, kind in ((False, "keyword"), (True, "negative_keyword")):
        events = both.filter(F.col("negative") == negative)
        ticked = events.withColumns({"negative": F.lit(negative), "tick": tick_of(F.col("order"), kind)})
        words = ticked if words is None else words.unionByName(ticked)
        head = describe_keyword_changes(events, negative).select(
            "order", "date", "campaign", tick_of(F.col("order"), kind).alias("tick"), "change_type", "change_summary",
            F.lit(None).cast("string").alias("set_budget"), F.lit(None).cast("string").alias("set_status"),
            F.lit(None).cast("string").alias("previous_budget"),
        )
        heads = head if heads is None else heads.unionByName(head)
    budgets = budget_events(actions, names).select(
        "order", "date", "campaign", tick_of(F.col("order"), "budget").alias("tick"), F.lit("daily_budget").alias("change_type"),
        F.col("summary").alias("change_summary"), F.col("daily_budget").alias("set_budget"),
        F.lit(None).cast("string").alias("set_status"), "previous_budget",
    )
    statuses = status_events(actions, names).select(
        "order", "date", "campaign", tick_of(F.col("order"), "status").alias("tick"),
        F.concat(F.lit("campaign_"), "status").alias("change_type"), F.col("summary").alias("change_summary"),
        F.lit(None).cast("string").alias("set_budget"), F.col("status").alias("set_status"),
        F.lit(None).cast("string").alias("previous_budget"),
    )
    heads = heads.unionByName(budgets).unionByName(statuses)
    return with_canonical(heads, names), with_canonical(words, names)


def keyword_spans(events: DataFrame) -> DataFrame:
    """Ticks [from_tick, to_tick) at which a keyword shows: an add until the next change of the
    same keyword, a removal only at its own tick (the removed word belonged to the setup it ends).
    """
    key = ["owner", "negative", "match_type", "keyword"]
    last = events.groupBy(*key, "tick").agg(F.max_by("action", "pos").alias("action"))
    ahead = Window.partitionBy(*key).orderBy("tick")
    nxt = F.lead("tick").over(ahead)
    end = F.when(F.col("action") == "remove", F.col("tick") + 1).otherwise(nxt)
    return last.select(*key, F.col("tick").alias("from_tick"), end.alias("to_tick"))


def snapshot_heads(actions: DataFrame, names: Names) -> tuple[DataFrame, DataFrame]:
    """(snapshots without keyword lists, keyword spans).

    Budget and status are the latest values of the owner at the snapshot; the end date is the next
    snapshot of the same name, else its rename date, else its next change day.
    """
    # stored once: the as-of, next-row and next-change steps below each read the stream again
    heads, words = (cut_lineage(df) for df in _stream(actions, names))
    state = carry(heads, ["owner"], "date", ["tick"], {"daily_budget": "set_budget", "status": "set_status"})
    # display order inside a day is newest first, that is by growing order
    shown = state.withColumn("_seq", F.pmod("tick", F.lit(KINDS)))
    shown = following(shown, ["campaign"], "date", ["order", "_seq"], "date", "_next")
    left = names.moves.groupBy(F.col("previous_name").alias("campaign")).agg(F.max_by("date", F.struct(-F.col("order"))).alias("_renamed"))
    shown = next_change_day(shown.join(left, "campaign", "left"), change_dates(actions, names), ["campaign"], "date", "_change")
    out = shown.withColumn("end_date", F.coalesce("_next", "_renamed", "_change"))
    return out.drop("_next", "_renamed", "_change", "_seq", "set_budget", "set_status"), keyword_spans(words)


def replay_cells(points: DataFrame, at: str = "tick", cell_rows: int = CELL_ROWS) -> Callable[[Column, Column], Column]:
    """The number of the cell of a place on an owner's time line, as a column function of (owner, place).

    A cell holds about ``cell_rows`` points of one owner, more when there would be over ``MOST_CELLS`` cells. The bounds come from counts on a
    grid over the points' range; only the bounds of owners with several cells reach the driver.
    """
    least, most, n = points.agg(F.min(at), F.max(at), F.count(at)).first()
    least, most = (0, 0) if least is None else (least, most)
    shift, size = max(0, int(most - least).bit_length() - GRID_BITS), max(cell_rows, n // MOST_CELLS)
    known = points.filter(F.col("owner").isNotNull() & F.col(at).isNotNull())
    grid = known.groupBy("owner", F.shiftright(F.col(at) - F.lit(least), shift).alias("_place")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("owner").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    cut = grid.withColumn("_cell", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / size))
    starts = cut.filter("_cell > 0").groupBy("owner", "_cell").agg(F.min("_place").alias("_place"))
    bounds: dict[str, list[int]] = {}
    for row in starts.collect():
        bounds.setdefault(row["owner"], []).append(least + (row["_place"] << shift))
    shared = points.sparkSession.sparkContext.broadcast({owner: np.sort(np.array(v, dtype=np.int64)) for owner, v in bounds.items()})

    @F.pandas_udf("int")
    def cell(owner: pd.Series, place: pd.Series) -> pd.Series:
        out, places = np.zeros(len(owner), dtype=np.int32), place.fillna(NEVER).to_numpy(dtype=np.int64)
        for name, rows in owner.groupby(owner, sort=False).indices.items():
            if name in shared.value:
                out[rows] = np.searchsorted(shared.value[name], places[rows], side="right")
        return pd.Series(out)

    return cell


def shown_words(points: DataFrame, spans: DataFrame, cell: Callable[[Column, Column], Column], fields: dict[str, tuple[bool, str]], at: str = "tick") -> DataFrame:
    """``points`` with sorted word arrays: for each ``name -> (negative, match type)`` the words of the owner's spans that hold ``at``.

    Points and spans meet per cell of the owner's time line, where the spans are compared with all ticks at once; a span is listed in the
    cells it covers. So what is shuffled grows with points and spans, and the words a point shows are made where its row leaves.
    """
    last = F.lit(2**62).cast("bigint")
    ends = F.greatest(F.col("from_tick"), F.coalesce(F.col("to_tick"), last) - 1)
    held = spans.filter("owner IS NOT NULL AND from_tick IS NOT NULL").withColumn(
        "_cell", F.explode(F.sequence(cell(F.col("owner"), F.col("from_tick")), cell(F.col("owner"), ends)))
    ).select("owner", "_cell", "negative", "match_type", "keyword", "from_tick", F.coalesce("to_tick", last).alias("to_tick"))
    placed = points.withColumn("_cell", cell(F.col("owner"), F.col(at)))
    names = points.columns
    schema = StructType([*points.schema.fields, *[StructField(name, ArrayType(StringType())) for name in fields]])

    def show(rows: pa.Table, words: pa.Table) -> pa.Table:
        rows = rows.select(names)
        places = rows[at].fill_null(NEVER).to_numpy()
        order = np.argsort(places, kind="stable")
        rows, places = rows.take(order), places[order]
        words = words.sort_by("keyword")
        low, high = words["from_tick"].to_numpy(), words["to_tick"].to_numpy()
        negative, types = words["negative"].to_numpy(), words["match_type"].to_numpy()
        keywords, out = words["keyword"].combine_chunks(), {}
        for name, (sign, kind) in fields.items():
            own = np.flatnonzero((negative == sign) & (types == kind))
            sizes, picked = [np.zeros(1, dtype=np.int64)], [own[:0]]
            step = max(1, min(CELL_ROWS, BLOCK // max(1, len(own))))
            for start in range(0, len(places), step):
                part = places[start : start + step]
                near = own[(low[own] <= part[-1]) & (high[own] > part[0])]
                hit = (low[near] <= part[:, None]) & (part[:, None] < high[near])
                sizes.append(hit.sum(axis=1))
                picked.append(near[np.nonzero(hit)[1]])
            offsets = pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32))
            out[name] = pa.ListArray.from_arrays(offsets, keywords.take(pa.array(np.concatenate(picked))))
        return pa.table({**{c: rows[c] for c in names}, **out})

    return placed.groupBy("owner", "_cell").cogroup(held.groupBy("owner", "_cell")).applyInArrow(show, schema)


def snapshot_members(heads: DataFrame, spans: DataFrame) -> DataFrame:
    """(campaign, tick, negative, n_keywords, keywords): the words each snapshot shows, sorted; those without words are left out.

    Snapshots of one campaign and tick are one row that lists its words once for each of them, as they would be grouped.
    """
    points = cut_lineage(heads.groupBy("owner", "campaign", "tick").agg(F.count(F.lit(1)).alias("_times")).filter("tick IS NOT NULL"))
    shown = shown_words(points, spans, replay_cells(points), WORD_FIELDS)

    def of(negative: bool) -> Column:
        words = F.concat(*[F.col(name) for name, (sign, _) in WORD_FIELDS.items() if sign == negative])
        return F.struct(F.lit(negative).alias("negative"), F.flatten(F.array_repeat(words, F.col("_times").cast("int"))).alias("words"))

    rows = shown.select("campaign", "tick", F.explode(F.array(of(False), of(True))).alias("s")).filter(F.size("s.words") > 0)
    return rows.select("campaign", "tick", "s.negative", F.size("s.words").cast("bigint").alias("n_keywords"), F.sort_array("s.words").alias("keywords"))


def fill_empty_sets(heads: DataFrame, filled: DataFrame) -> DataFrame:
    """Snapshots with ``donor``: the snapshot whose positive words this one shows.

    ``filled`` lists the (owner, campaign, tick) that have words of their own. A snapshot without
    words borrows from the next filled snapshot of its owner in display order, and otherwise from
    the previous one. Only snapshot keys are carried, never lists.
    """
    own = filled.withColumn("_own", F.struct("tick", "campaign"))
    rows = heads.join(own, ["owner", "campaign", "tick"], "left").withColumn("_seq", F.pmod("tick", F.lit(KINDS)))
    order = ["order", "campaign", "_seq"]
    rows = carry(rows, ["owner"], "date", order, {"_later": "_own"}, backward=True)
    rows = carry(rows, ["owner"], "date", order, {"_earlier": "_own"})
    return rows.withColumn("donor", F.coalesce("_own", "_later", "_earlier")).drop("_own", "_later", "_earlier", "_seq")


def _lists(shown: DataFrame) -> DataFrame:
    """Text lists of a snapshot from its word arrays."""
    cols = {name: F.col(name) for name in WORD_FIELDS}
    for name, sign in (("unique_keywords", False), ("negative_keywords", True)):
        cols[name] = F.sort_array(F.array_distinct(F.concat(*[F.col(c) for c, (negative, _) in WORD_FIELDS.items() if negative == sign])))
    return shown.withColumns({name: F.array_join(words, T.LIST_JOINER) for name, words in cols.items()})


LIST_FIELDS = [
    "broad_keywords", "phrase_keywords", "exact_keywords", "unique_keywords",
    "negative_broad_keywords", "negative_phrase_keywords", "negative_exact_keywords", "negative_keywords",
]


def with_list_counts(df: DataFrame) -> DataFrame:
    """Keyword counts and the match-type label of a row's list columns."""
    size = {c: F.size(T.split_list(c)) for c in LIST_FIELDS if c in df.columns}
    label = T.match_type_label({mt: size[c] > 0 for mt, c in T.LIST_COLUMNS.items()})
    return df.withColumns(
        {
            "match_types": label,
            "num_unique_keywords": size["unique_keywords"],
            "broad_keyword_count": size["broad_keywords"],
            "phrase_keyword_count": size["phrase_keywords"],
            "exact_keyword_count": size["exact_keywords"],
            "num_negative_keywords": size["negative_keywords"],
        }
    )


def campaign_snapshots(actions: DataFrame, names: Names | None = None) -> DataFrame:
    """Campaign state after every budget, status or keyword change, with keyword lists.

    Heads are stored with their state, since the fill and the list joins read them again.
    """
    names = names or read_names(actions)
    heads, spans = (cut_lineage(df) for df in snapshot_heads(actions, names))
    cell = replay_cells(heads)
    positive, negative = ({name: f for name, f in WORD_FIELDS.items() if f[0] == sign} for sign in (False, True))
    keys = ["owner", "campaign", "tick"]
    own = shown_words(heads.select(*keys).filter("tick IS NOT NULL").distinct(), spans.filter("NOT negative"), cell, positive)
    filled = own.filter(reduce(lambda a, b: a | b, [F.size(c) > 0 for c in positive])).select(*keys)
    donors = cut_lineage(fill_empty_sets(heads, filled))
    at = F.when(F.col("tick").isNotNull(), F.col("donor.tick"))
    rows = donors.withColumn("_donor", at).drop("donor")
    lent = F.col("_donor").isNotNull() & (F.col("_donor") != F.col("tick"))
    # a snapshot with words of its own shows both signs at its own tick; the others take their positive words from the donor's cell
    whole = shown_words(rows.filter(~lent), spans, cell, WORD_FIELDS)
    filler = shown_words(shown_words(rows.filter(lent), spans.filter("negative"), cell, negative), spans.filter("NOT negative"), cell, positive, "_donor")
    return _lists(whole.unionByName(filler)).drop("_donor").select(*[c for c in donors.columns if c != "donor"], *LIST_FIELDS)


# --- coverage intervals and set ids --------------------------------------------------------


def keyword_day_index(report: DataFrame) -> DataFrame:
    """Complete (campaign, date, keyword, match_type) rows of a clean keyword-day report."""
    whole = F.lit(True)
    for c in ("campaign", "keyword", "match_type"):
        whole = whole & (F.coalesce(F.col(c), F.lit("")) != "")
    return report.filter(whole & F.col("date").isNotNull()).select("campaign", "date", "keyword", "match_type")


def daily_words(index: DataFrame) -> DataFrame:
    """Rows per (campaign, date, match_type, keyword): the report reduced before any join."""
    return index.groupBy("campaign", "date", "match_type", "keyword").agg(F.count(F.lit(1)).alias("n_rows"))


def window_words(words: DataFrame, windows: DataFrame) -> DataFrame:
    """Row counts and keyword lists of the report inside each (campaign, start, end) window."""
    hits = interval_join(words, windows, ["campaign"])
    return hits.groupBy("campaign", "start_date").agg(
        F.sum("n_rows").alias("raw_report_row_count"),
        *[
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("match_type") == mt, F.col("keyword")))), T.LIST_JOINER).alias(c)
            for mt, c in T.LIST_COLUMNS.items()
        ],
        F.array_join(F.array_sort(F.collect_set("keyword")), T.LIST_JOINER).alias("unique_keywords"),
    )


def coverage_windows(index: DataFrame, snapshots: DataFrame, names: Names) -> DataFrame:
    """(campaign, owner, start_date, end_date, is_last): the observed span cut at change days."""
    span = index.groupBy("campaign").agg(F.min("date").alias("first"), F.date_add(F.max("date"), 1).alias("stop"))
    span = with_canonical(span.filter(T.is_report_campaign("campaign")), names)
    cuts = snapshots.select("owner", F.col("date").alias("start_date")).distinct()
    inner = span.join(cuts, "owner").filter((F.col("start_date") > F.col("first")) & (F.col("start_date") < F.col("stop")))
    starts = span.withColumn("start_date", F.col("first")).unionByName(inner)
    ahead = Window.partitionBy("campaign").orderBy("start_date")
    nxt = F.lead("start_date").over(ahead)
    return starts.select(
        "campaign", "owner", "start_date", F.coalesce(nxt, "stop").alias("end_date"), nxt.isNull().alias("is_last")
    )


def inferred_budget(windows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Pre-change budget of the first budget change from a window's start to its end, inclusive."""
    changes = (
        snapshots.filter("change_type = 'daily_budget' AND previous_budget <> ''")
        .groupBy("owner", F.col("date").alias("_day"))
        .agg(F.min_by("previous_budget", F.struct("order", "tick")).alias("_previous"))
    )
    days = cut_lineage(changes.withColumn("_at", F.unix_date("_day")))
    spans = windows.select("campaign", "owner", "start_date", F.unix_date("start_date").alias("_from"), (F.unix_date("end_date") + 1).alias("_to"))
    found = stab_join(days, spans, ["owner"], "_at", "_from", "_to")
    return found.groupBy("campaign", "start_date").agg(F.min_by("_previous", "_day").alias("inferred_budget"))


def coverage_summary(report_index: DataFrame, snapshots: DataFrame, names: Names) -> DataFrame:
    """Campaign versions from report coverage with the change-log state attached.

    Empty windows and windows without a known budget are left out.
    """
    snaps = snapshots
    words = daily_words(report_index)
    windows = coverage_windows(words, snaps, names)
    observed = window_words(words, windows.drop("owner", "is_last"))
    rows = windows.join(observed, ["campaign", "start_date"])
    state_cols = ["status", "change_summary", "daily_budget", "negative_broad_keywords", "negative_phrase_keywords",
                  "negative_exact_keywords", "negative_keywords", "log_keywords"]
    history = snaps.select(
        "owner", F.col("date").alias("start_date"), "order", F.col("tick").alias("_tick"),
        *[c for c in state_cols if c != "log_keywords"], F.col("unique_keywords").alias("log_keywords"),
    )
    # of a day's snapshots the last one is the state that day leaves; it is found by its narrow key
    last = history.groupBy("owner", "start_date").agg(F.max(F.struct("order", "_tick")).alias("_last"))
    last = last.select(*[F.col(c).alias(f"_l_{c}") for c in ("owner", "start_date")], "_last.*").withColumnsRenamed({"order": "_l_order", "_tick": "_l__tick"})
    same = [F.col(c).eqNullSafe(F.col(f"_l_{c}")) for c in ("owner", "start_date", "order", "_tick")]
    history = history.join(last, same, "left_semi")
    probes = rows.select("owner", "campaign", "start_date")
    attached = asof_backward(probes, history, ["owner"], "start_date", ["order", "_tick"], state_cols).drop("owner")
    kinds = snaps.groupBy("owner", F.col("date").alias("start_date")).agg(
        F.array_join(F.array_sort(F.collect_set("change_type")), ";").alias("_kinds")
    )
    out = (
        rows.join(attached, ["campaign", "start_date"], "left")
        .join(inferred_budget(windows, snaps), ["campaign", "start_date"], "left")
        .join(kinds, ["owner", "start_date"], "left")
    )
    texts = {c: F.coalesce(c, F.lit("")) for c in state_cols if c != "daily_budget"}
    budget = F.when(F.coalesce(F.col("daily_budget"), F.lit("")) != "", F.col("daily_budget")).otherwise(F.col("inferred_budget"))
    out = out.withColumns({**texts, "daily_budget": budget}).filter(F.coalesce("daily_budget", F.lit("")) != "")
    raw, log = T.split_list("unique_keywords"), T.split_list("log_keywords")
    return out.select(
        "campaign", "start_date", F.when(~F.col("is_last"), F.col("end_date")).alias("end_date"), "status",
        F.coalesce("_kinds", F.lit("raw_keyword_coverage")).alias("change_type"), "change_summary", "daily_budget",
        "raw_report_row_count", *LIST_FIELDS,
        F.col("unique_keywords").alias("raw_unique_keywords"),
        F.col("log_keywords").alias("change_history_unique_keywords"),
        F.array_join(F.array_except(raw, log), T.LIST_JOINER).alias("raw_keywords_not_in_change_history"),
        F.array_join(F.array_except(log, raw), T.LIST_JOINER).alias("change_history_keywords_not_in_raw"),
    )


def number_versions(summary: DataFrame) -> DataFrame:
    """Versions numbered from 1 by campaign and start date."""
    from bidloom.functions.grouped import number_rows

    return number_rows(summary, [], F.col("campaign"), [F.col("start_date")], "campaign_version")


def union_budget_runs(summary: DataFrame) -> DataFrame:
    """Budget-only versions share the union of keywords with the version they follow.

    A new run starts at the first version of a campaign and at every version whose change type is
    not exactly a daily budget. Versions per campaign are bounded by its change days.
    """
    upto = Window.partitionBy("campaign").orderBy("start_date")
    starts = (F.col("change_type") != "daily_budget").cast("int")
    rows = summary.withColumn("run", F.sum(starts).over(upto))
    lists = ["broad_keywords", "phrase_keywords", "exact_keywords"]
    merged = rows.groupBy("campaign", "run").agg(
        *[T.join_list(F.flatten(F.collect_list(T.split_list(c)))).alias(f"_{c}") for c in lists]
    )
    out = rows.join(merged, ["campaign", "run"]).drop("run", *lists, "unique_keywords")
    out = out.withColumnsRenamed({f"_{c}": c for c in lists})
    return out.withColumn("unique_keywords", T.join_list(F.concat(*[T.split_list(c) for c in lists])))


SET_KEY = ["broad_keywords", "phrase_keywords", "exact_keywords",
           "negative_broad_keywords", "negative_phrase_keywords", "negative_exact_keywords"]


def assign_set_ids(versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(versions with keyword_set_id, keyword-set table); equal six lists share an id.

    Ids count contents by their first version. Contents meet on a hash, not on the list text.
    """
    from bidloom.functions.grouped import number_rows

    keyed = versions.withColumn("_key", F.sha2(F.concat_ws("\u0001", *SET_KEY), 256))
    groups = keyed.groupBy("_key").agg(
        F.min("campaign_version").alias("_first"),
        F.array_join(F.transform(F.array_sort(F.collect_list("campaign_version")), lambda v: v.cast("string")), T.LIST_JOINER).alias("used_by_campaign_versions"),
        F.min_by(F.struct(*LIST_FIELDS), "campaign_version").alias("_lists"),
    )
    numbered = number_rows(groups, [], F.floor(F.col("_first") / 1000), [F.col("_first")], "_n")
    ids = numbered.withColumn("keyword_set_id", F.format_string("ks_%04d", "_n"))
    sets = ids.select("keyword_set_id", "_lists.*", "used_by_campaign_versions")
    return keyed.join(ids.select("_key", "keyword_set_id"), "_key").drop("_key"), sets


def audit_rows(versions: DataFrame) -> DataFrame:
    return versions.select(
        "keyword_set_id", "campaign_version", "campaign", "start_date", "end_date", "raw_unique_keywords",
        "change_history_unique_keywords", "raw_keywords_not_in_change_history", "change_history_keywords_not_in_raw",
    )


def enrich_with_report(summary: DataFrame, index: DataFrame) -> DataFrame:
    """Versions whose positive lists come from the report inside their interval."""
    words = daily_words(index)
    spans = summary.select("campaign", "start_date", "end_date", "campaign_version")
    hits = interval_join(words, spans, ["campaign"])
    observed = hits.groupBy("campaign_version").agg(
        F.sum("n_rows").alias("raw_report_row_count"),
        *[
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("match_type") == mt, F.col("keyword")))), T.LIST_JOINER).alias(f"_{c}")
            for mt, c in T.LIST_COLUMNS.items()
        ],
        F.array_join(F.array_sort(F.collect_set("keyword")), T.LIST_JOINER).alias("raw_unique_keywords"),
    )
    out = summary.withColumn("change_history_unique_keywords", F.col("unique_keywords")).join(observed, "campaign_version", "left")
    none = F.lit("")
    out = out.withColumns(
        {
            "raw_report_row_count": F.coalesce("raw_report_row_count", F.lit(0)),
            **{c: F.coalesce(f"_{c}", none) for c in T.LIST_COLUMNS.values()},
            "raw_unique_keywords": F.coalesce("raw_unique_keywords", none),
            "unique_keywords": F.coalesce("raw_unique_keywords", none),
        }
    ).drop(*[f"_{c}" for c in T.LIST_COLUMNS.values()])
    raw, log = T.split_list("raw_unique_keywords"), T.split_list("change_history_unique_keywords")
    out = out.withColumns(
        {
            "raw_keyword_count_delta": F.size(raw) - F.size(log),
            "raw_keywords_not_in_change_history": F.array_join(F.array_except(raw, log), T.LIST_JOINER),
            "change_history_keywords_not_in_raw": F.array_join(F.array_except(log, raw), T.LIST_JOINER),
        }
    )
    return with_list_counts(out)


def final_per_day(rows: DataFrame) -> DataFrame:
    """The final value per (date, campaign): the newest row of the day."""
    return first_per_key(rows, ["date", "campaign"], ["order"])


def state_events(actions: DataFrame, names: Names) -> DataFrame:
    """Budget, status and keyword changes as one narrow event stream per owner."""
    nothing = {c: F.lit(None).cast(t) for c, t in (
        ("set_budget", "string"), ("set_status", "string"), ("negative", "boolean"),
        ("match_type", "string"), ("keyword", "string"), ("action", "string"))}
    columns = ["tick", "date", "owner", *nothing]

    def shape(df: DataFrame, kind: str, **values: Column) -> DataFrame:
        rows = with_canonical(df, names).withColumn("tick", tick_of(F.col("order"), kind))
        return rows.withColumns({**nothing, **values}).select(*columns)

    out = None
    for negative, kind in ((False, "keyword"), (True, "negative_keyword")):
        words = keyword_events(actions, names, negative)
        part = shape(words, kind, negative=F.lit(negative), match_type=F.col("match_type"), keyword=F.col("keyword"), action=F.col("action"))
        out = part if out is None else out.unionByName(part)
    budgets = shape(budget_events(actions, names), "budget", set_budget=F.col("daily_budget"))
    return out.unionByName(budgets).unionByName(shape(status_events(actions, names), "status", set_status=F.col("status")))
