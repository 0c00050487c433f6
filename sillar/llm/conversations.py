"""Rebuilding conversations from message rows.

Messages arrive one per row, late, twice, under another number, with roles in
several spellings. They are sessionized by channel (``chat_id``): sorted by time,
optionally split at gaps of inactivity, their roles read, and sessions without
reciprocal replies dropped.

Plan
----
Copies are folded by a hash aggregate. The turns are then *range*-partitioned by
``(chat_id, created_at, message_id)``, so a chat with a third of all rows is
spread over a third of the partitions. One Arrow pass numbers the rows of each
stretch of a chat inside its partition (a *run*); everything after that is
arithmetic on one row per run, of which a chat has at most as many as there are
partitions: the alternation user, assistant, user ... holds exactly if each row's
speaker equals the parity of its position, that is of its run's offset plus its
index in the run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sillar.functions.roles import ASSISTANT, UNREADABLE, USER, speaker
from sillar.llm.plaintext import blank
from sillar.session import cut, shuffle_width

RUN_COLUMNS = "run long, idx int, part int, gap_us long"


def turns(messages: DataFrame, texts: bool) -> DataFrame:
    """One row per message: copies folded, notes set aside, speaker read.

    Rows alike in chat, role, content and time are one message, known by its
    smallest ``message_id``. Rows without ``chat_id`` belong to no chat. With
    ``texts`` the content and the sources are kept, else only whether it is blank.
    """
    slim = messages.filter(F.col("chat_id").isNotNull())
    if texts:
        slim = slim.groupBy("chat_id", "role", "created_at", "content").agg(F.min("message_id").alias("message_id"), F.min_by("sources", "message_id").alias("sources"))
        extra = ["content", "sources"]
    else:
        slim = slim.select("chat_id", "role", "created_at", "message_id", F.md5(F.col("content").cast("binary")).alias("digest"), blank(F.col("content")).alias("blank"))
        slim = slim.groupBy("chat_id", "role", "created_at", "digest").agg(F.min("message_id").alias("message_id"), F.max("blank").alias("blank"))
        extra = ["blank"]
    slim = slim.withColumn("who", speaker(F.col("role"))).filter(F.col("who").isNotNull())
    return slim.select("chat_id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("ts"), "message_id", "who", *extra)


def in_order(rows: DataFrame) -> DataFrame:
    """Range-partitioned and sorted by chat and time; a large chat spans partitions."""
    keys = ["chat_id", "ts", "message_id"]
    return rows.repartitionByRange(shuffle_width(rows.sparkSession), *keys).sortWithinPartitions(*keys)


def _number_runs(gap_us: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        chat, count, idx, part, last = None, -1, 0, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            n = b.num_rows
            names = b.column("chat_id")
            codes = names.dictionary_encode()
            codes = codes.indices.to_numpy(zero_copy_only=False)
            ts = b.column("ts").fill_null(-(2**62)).to_numpy(zero_copy_only=False)
            first = names[0].as_py()
            fresh = np.empty(n, dtype=bool)
            fresh[0] = first != chat
            fresh[1:] = codes[1:] != codes[:-1]
            before = np.concatenate([[last], ts[:-1]])
            gaps = np.where(fresh | (before <= -(2**62)), 0, ts - before)
            runs = count + np.cumsum(fresh)
            begins = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
            index = np.arange(n) - begins
            index[begins < 0] = idx + 1 + np.arange((begins < 0).sum())
            breaks = (gaps > gap_us) if gap_us is not None else np.zeros(n, dtype=bool)
            steps = np.cumsum(breaks)
            parts = steps - np.where(begins < 0, -part, steps[np.maximum(begins, 0)])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(base + runs), pa.array(index.astype(np.int32)), pa.array(parts.astype(np.int32)), pa.array(gaps)],
                names=[*b.schema.names, "run", "idx", "part", "gap_us"],
            )
            chat, count, idx, part, last = names[n - 1].as_py(), int(runs[-1]), int(index[-1]), int(parts[-1]), int(ts[-1])

    return run


def number_runs(ordered: DataFrame, gap_us: int | None = None) -> DataFrame:
    """Adds to ordered rows: the run, the index in it, the part of the run between gaps
    of more than ``gap_us``, and the time since the row before."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema)
    return ordered.mapInArrow(_number_runs(gap_us), f"{fields}, {RUN_COLUMNS}")


def sessions_of(numbered: DataFrame, gap_us: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(segments, sessions)``: each part of a run with its session and its offset in it,
    and per session whether it is sound and how long."""
    parity = F.col("who").bitwiseXOR(F.col("idx").bitwiseAND(F.lit(1)))
    segments = numbered.groupBy("chat_id", "run", "part").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("idx").alias("idx0"),
        F.min("ts").alias("ts0"),
        F.max("ts").alias("ts1"),
        F.min(parity).alias("p0"),
        F.max(parity).alias("p1"),
        F.max(F.coalesce(F.col("blank"), F.lit(True)) | F.col("ts").isNull() | (F.col("who") == UNREADABLE)).alias("bad"),
    )
    runs = segments.groupBy("chat_id", "run").agg((F.max("part") + 1).alias("parts"), F.min("ts0").alias("t0"), F.max("ts1").alias("t1"))
    by_chat = Window.partitionBy("chat_id").orderBy("run")
    joins = F.lag("t1").over(by_chat).isNotNull() & (F.lit(True) if gap_us is None else (F.col("t0") - F.lag("t1").over(by_chat) <= gap_us))
    joins = F.when(F.lag("run").over(by_chat).isNull(), F.lit(0)).when(F.lit(gap_us is None) | joins, F.lit(1)).otherwise(F.lit(0))
    so_far = by_chat.rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.withColumn("joins", joins)
    runs = runs.withColumn("base", F.sum(F.col("parts") - F.col("joins")).over(so_far) - F.col("parts"))
    segments = segments.join(runs.select("chat_id", "run", "base"), ["chat_id", "run"]).withColumn("session", F.col("base") + F.col("part"))
    by_session = Window.partitionBy("chat_id", "session").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    segments = segments.withColumn("offset", F.coalesce(F.sum("n").over(by_session), F.lit(0)))
    at = F.col("offset") - F.col("idx0")
    fits = (F.col("p0") == F.col("p1")) & (F.col("p0").bitwiseXOR(F.pmod(at, F.lit(2)).cast("int")) == USER)
    sessions = segments.groupBy("chat_id", "session").agg(
        F.sum("n").alias("turns"),
        F.min("ts0").alias("begins"),
        F.max("ts1").alias("ends"),
        (F.min(fits & ~F.col("bad")) & (F.sum("n") % 2 == 0)).alias("sound"),
    )
    return segments, sessions


def calibrated_gap(numbered: DataFrame, share: float = 0.995) -> int:
    """The inactivity in microseconds that all but ``1 - share`` of the steps inside chats
    stay under. One number comes to the driver."""
    row = numbered.filter(F.col("idx") > 0).agg(F.percentile_approx("gap_us", share, 10_000).alias("g")).first()
    return int(row["g"] or 0)


def dropped_chats(messages: DataFrame, chats: DataFrame) -> DataFrame:
    """``(chat_id)`` of every chat to be dropped, among all chats of either table.

    A chat is kept if, notes set aside, every message can be read as user or
    assistant, has a time and is not blank, and if by time, then number, they run
    user, assistant, user, assistant and so on up to an assistant. Chats without any
    message are dropped. Rows without ``chat_id`` belong to no chat. Empty tables
    give no rows; columns besides the named ones are not read.
    """
    # written once: runs are named by their partition, whose bounds a second reading could draw elsewhere
    _, sessions = sessions_of(cut(number_runs(in_order(turns(messages, texts=False)))))
    kept = sessions.filter("sound").select("chat_id")
    every = messages.select("chat_id").union(chats.select("chat_id")).filter(F.col("chat_id").isNotNull()).distinct()
    return every.join(kept, "chat_id", "left_anti")


def rebuild_conversations(messages: DataFrame, split_at_gaps: bool = False) -> DataFrame:
    """``(chat_id, session, turn, role, content, created_at, message_id)``: the turns of
    every sound conversation in order, one row per turn.

    Broken, empty and unanswered conversations are absent, by the rules of
    ``dropped_chats``. With ``split_at_gaps`` a chat is cut into sessions wherever it
    was idle for longer than ``calibrated_gap``, and each session is judged alone.
    """
    rows = turns(messages, texts=True).withColumn("blank", blank(F.col("content"))).drop("sources")
    numbered = cut(number_runs(in_order(rows)))
    gap = None
    if split_at_gaps:
        gap = calibrated_gap(numbered)
        numbered = cut(number_runs(numbered.drop("run", "idx", "part", "gap_us"), gap))
    segments, sessions = sessions_of(numbered, gap)
    sound = segments.join(sessions.filter("sound").select("chat_id", "session"), ["chat_id", "session"])
    sound = sound.select("chat_id", "run", "part", "session", (F.col("offset") - F.col("idx0")).alias("shift"))
    return numbered.join(sound, ["chat_id", "run", "part"]).select(
        "chat_id",
        F.col("session").cast("int").alias("session"),
        (F.col("idx") + F.col("shift")).cast("long").alias("turn"),
        F.when(F.col("who") == USER, "user").otherwise("assistant").alias("role"),
        "content",
        F.timestamp_micros("ts").alias("created_at"),
        "message_id",
    )
