"""Consuming a change feed, and comparing revisions to catch up after its retention.

``events``: ``ts, seq, kind, title, target``; ``kind`` is ``edit``, ``delete`` or ``move``. The last event of a
title in order of arrival (``seq``) counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sillar.functions import text as T
from sillar.session import Kept

# Fixed values, in seconds: overlap after a feed, after a full check; how long a feed is kept; how often a
# subset is checked in full; and the rows of one page of a keyset scan.
FEED_OVERLAP, CHECK_OVERLAP = 120, 3600
RETENTION, FULL_CHECK_EVERY = 29 * 86400, 7 * 86400
CHECK_ROWS = 500


def map_log_events(raw: DataFrame) -> DataFrame:
    """Feed rows ``(ts, seq, type, log_type, log_action, ns, title, target, target_ns, bot)`` to events: edits and
    new pages and restored ones are edits; deletions and moves are kept, with the target if it is an article;
    other log entries and other namespaces go."""
    kind = (
        F.when(F.col("type").isin("edit", "new"), "edit")
        .when((F.col("type") == "log") & (F.col("log_type") == "delete") & (F.col("log_action") == "delete"), "delete")
        .when((F.col("type") == "log") & (F.col("log_type") == "delete") & (F.col("log_action") == "restore"), "edit")
        .when((F.col("type") == "log") & (F.col("log_type") == "move"), "move")
    )
    rows = raw.filter(F.col("ns") == 0).select("ts", "seq", kind.alias("kind"), "title", F.when((kind == "move") & (F.col("target_ns") == 0), F.col("target")).alias("target"))
    return rows.filter("kind is not null")


def latest_events(events: DataFrame) -> DataFrame:
    """The last event of each title. Partial aggregation folds a busy title before the shuffle."""
    last = events.filter("title is not null").groupBy("title").agg(F.max(F.struct("seq", "ts", "kind", "target")).alias("e"))
    return last.select("title", F.col("e.ts").alias("ts"), F.col("e.seq").alias("seq"), F.col("e.kind").alias("kind"), F.col("e.target").alias("target"))


def plan_changes(events: DataFrame, known: DataFrame, track_all: bool = False) -> DataFrame:
    """``(title, action)``: what a stretch of the feed asks for. ``delete``: the title goes; ``fetch``: its text
    is to be fetched again.

    Deleted and moved titles go. An edited title is fetched, and so is the target of a move, if the (old) title
    is known or everything is tracked. For a title with several such demands, as one that a move leads to and that
    has an event of its own, the latest counts.
    """
    last = latest_events(events)
    marks = known.select("title").distinct().withColumn("here", F.lit(True))
    last = last.join(marks, "title", "left").withColumn("relevant", F.coalesce("here", F.lit(False)) | F.lit(track_all))
    at = F.struct("ts", "seq").alias("at")
    gone = last.filter(F.col("kind").isin("delete", "move")).select("title", F.lit("delete").alias("action"), at)
    moved = last.filter((F.col("kind") == "move") & F.col("target").isNotNull() & F.col("relevant")).select(F.col("target").alias("title"), F.lit("fetch").alias("action"), at)
    edits = last.filter((F.col("kind") == "edit") & F.col("relevant")).select("title", F.lit("fetch").alias("action"), at)
    every = gone.unionByName(moved).unionByName(edits)
    return every.groupBy("title").agg(F.max_by("action", F.struct("at", "action")).alias("action"))


def apply_changes(pages: DataFrame, plan: DataFrame, fetched: DataFrame) -> DataFrame:
    """``pages`` after a plan: deleted titles go, and fetched ones are replaced by their row in
    ``fetched(title, ...)``; a title that cannot be fetched goes too."""
    wanted = plan.filter("action = 'fetch'").select("title")
    rest = pages.join(plan.select("title"), "title", "left_anti")
    return rest.unionByName(fetched.join(wanted, "title", "left_semi"), allowMissingColumns=True)


def changed(revid: Column, snapshot_ts: Column, latest_revid: Column, latest_ts: Column) -> Column:
    """With a revision number the numbers are compared, without one the times."""
    return F.when(revid.isNotNull(), ~revid.eqNullSafe(latest_revid)).otherwise(latest_ts > F.coalesce(snapshot_ts, F.timestamp_seconds(F.lit(0))))


def catch_up(pages: DataFrame, latest: DataFrame) -> DataFrame:
    """``(title, action)`` of a full comparison with ``latest(title, revid, ts, gone)``: ``delete`` where the article is
    gone, ``fetch`` where it changed; titles the other side does not know are left alone."""
    other = latest.select("title", F.col("revid").alias("r"), F.col("ts").alias("t"), "gone")
    action = F.when(F.col("gone"), "delete").when(changed(F.col("revid"), F.col("snapshot_ts"), F.col("r"), F.col("t")), "fetch")
    return pages.join(other, "title").select("title", action.alias("action")).filter("action is not null")


def keyset_page(pages: DataFrame, after: str, rows: int = CHECK_ROWS) -> DataFrame:
    """The next titles in order after a cursor."""
    return pages.filter(F.col("title") > after).orderBy("title").limit(rows)


def strategy(now: float, cursor: float | None, pending: bool, track_all: bool, last_full_check: float | None) -> str:
    """``catch_up`` or ``feed``: catch up if one is pending, there is no cursor, it is older than the feed is kept,
    or a subset has not been checked in full for a week."""
    if pending or cursor is None or now - cursor > RETENTION:
        return "catch_up"
    if not track_all and (last_full_check is None or now - last_full_check > FULL_CHECK_EVERY):
        return "catch_up"
    return "feed"


def cursor_after_feed(started: float) -> float:
    return started - FEED_OVERLAP


def cursor_after_check(check_started: float) -> float:
    return check_started - CHECK_OVERLAP


def try_run(step) -> bool:
    """Runs a step and tells whether it succeeded; a failure is logged, not raised."""
    import logging

    try:
        step()
        return True
    except Exception:
        logging.getLogger("sillar.feed").exception("update failed")
        return False


def catch_up_in_steps(pages: DataFrame, lookup: Callable[[list[str]], dict[str, tuple[int, str] | None]], apply: Callable[[DataFrame], None], place: str, started: float, rows: int = CHECK_ROWS, stop: Callable[[], bool] = lambda: False) -> float | None:
    """The full comparison as a walk over all titles in order, ``rows`` at a time, that goes on where it ended.

    ``lookup`` gives revision and time per title, None for articles that are gone; titles it does not name are left
    alone. ``apply`` gets each step's ``(title, action)``. After it the last title is kept in ``place`` (``after``); an
    interrupted step is done again, so ``apply`` must bear that. Gives the feed's new cursor when all titles have been
    compared, None if ``stop`` ended the walk before.
    """
    spark = pages.sparkSession
    state = Kept(spark, place)
    state.setdefault("started", str(started))
    while not stop():
        step = keyset_page(pages, state.get("after", ""), rows).collect()  # no more than ``rows``
        if not step:
            begun = float(state.get("started"))
            state.clear()
            return cursor_after_check(begun)
        found = lookup([r["title"] for r in step])
        latest = [(title, None if seen is None else int(seen[0]), None if seen is None else seen[1], seen is None) for title, seen in found.items()]
        theirs = spark.createDataFrame(latest, "title string, revid long, iso string, gone boolean").select("title", "revid", T.parse_iso(F.col("iso")).alias("ts"), "gone")
        apply(catch_up(spark.createDataFrame(step, pages.schema), theirs))
        state.set("after", step[-1]["title"])
    return None


def apply_in_batches(events: DataFrame, apply: Callable[[DataFrame], None], place: str, started: float, batch: int = 50) -> float:
    """Events in order of arrival, ``batch`` at a time, each followed by a note of the last one applied, so that an
    interrupted run repeats one batch at most. Gives the new cursor."""
    state = Kept(events.sparkSession, place)
    while True:
        done = int(state.get("seq", str(-(2**63))))
        some = events.filter(F.col("seq") > done).orderBy("seq").limit(batch)
        top = some.agg(F.max("seq").alias("s")).first()["s"]
        if top is None:
            return cursor_after_feed(started)
        apply(events.filter((F.col("seq") > done) & (F.col("seq") <= top)))
        state.set("seq", str(top))
