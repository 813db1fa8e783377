"""Sessions, tokens, ordered lists, patches, curated crops, decisions and key pools."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .scan import running

#: Why a user changed a layout.
REASONS = ("accepted", "system_wrong", "user_preference", "suggested", "auto_applied", "defaulted", "needs_review")


def owned_pages(pages: DataFrame, projects: DataFrame, owner) -> DataFrame:
    """The pages of one owner's projects, newest first."""
    own = projects.where(F.col("owner_id") == owner).select("project_id")
    return pages.join(own, "project_id", "left_semi").orderBy(F.desc("updated_at"), "page_id")


def recent_sessions(sessions: DataFrame, users: DataFrame, now: str, k: int = 100) -> DataFrame:
    """The newest k sessions with their user's name and whether they are still open.

    The k rows are taken before users are joined, so the join never meets more.
    """
    new = sessions.orderBy(F.desc("created_at"), F.desc("session_id")).limit(k)
    status = F.when(F.col("expires_at") > F.to_timestamp_ntz(F.lit(now)), "online").otherwise("offline")
    return new.join(users, "user_id", "left").select("session_id", F.coalesce("name", F.lit("Unknown")).alias("name"), status.alias("status"))


def revoked_families(uses: DataFrame) -> DataFrame:
    """Adds revoked: whether any use in the family was of a spent token."""
    spent = uses.where("spent").select("family").distinct().withColumn("revoked", F.lit(True))
    return uses.join(spent, "family", "left").withColumn("revoked", F.coalesce("revoked", F.lit(False)))


def explicit_order(blocks: DataFrame, orders: DataFrame) -> DataFrame:
    """Positions from a list of ids per page; unknown ids take up a position and are left out.

    An id that is listed again keeps its last position.  Listed ids are dealt out before that is settled, and a struct has no
    hashed maximum: so one sort serves both the maximum and the join, and no task holds its ids in hash tables besides.
    """
    keys = ["page_id", "block_id"]
    listed = orders.select("page_id", F.posexplode("ids").alias("position", "block_id")).repartition(*keys)
    at = listed.groupBy(*keys).agg(F.max(F.struct("position")).alias("last"))
    return blocks.join(at, keys).select(*keys, "last.position")


def patched(blocks: DataFrame, patches: DataFrame, key: str = "block_id") -> DataFrame:
    """Blocks with the patches' non-null fields.  One patch without a block fails the whole batch."""
    missing = patches.join(blocks.select(key), key, "left_anti").agg(F.count("*")).scalar()
    fields = [c for c in patches.columns if c != key]
    p = patches.select(key, F.struct(*fields).alias("__p"))
    guard = F.when(missing > 0, F.raise_error(F.lit("a patch names an unknown block")))
    out = blocks.join(p, key, "left").withColumns({f: F.coalesce(F.col(f"__p.{f}"), F.col(f)) for f in fields})
    return out.where(guard.cast("string").isNull()).drop("__p")


def curated(boxes: DataFrame, crops: DataFrame) -> DataFrame:
    """Per page the boxes whose crop still exists; pages without any go."""
    return boxes.join(crops.select("block_id"), "block_id", "left_semi").groupBy("page_id").agg(F.count("*").alias("boxes"))


def steps(rows: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """Adds steps (the known ones asked for, in the asked order) and unknown, from the array ``asked``."""
    ours = F.array(*[F.lit(k) for k in known])
    return rows.withColumns({"steps": F.array_intersect("asked", ours), "unknown": F.array_except("asked", ours)})


def decisions(events: DataFrame) -> DataFrame:
    """Decision events with a known reason and final lines; works on streams too."""
    reason = F.when(F.col("change_reason").isin(*REASONS), F.col("change_reason")).otherwise("suggested")
    return events.withColumns({"change_reason": reason, "final_lines": F.coalesce("final_lines", "suggested_lines")})


def decision_lines(events: DataFrame) -> DataFrame:
    """One JSON line for each decision, to append with ``write.mode("append").text``."""
    return events.select(F.to_json(F.struct(*events.columns), {"ignoreNullFields": "false"}).alias("value"))


def read_decisions(lines: DataFrame, schema: str) -> DataFrame:
    """The decisions of JSON lines (``value``), as ``decisions`` gives them; lines that are none are left out.

    Works on ``readStream.text`` too.
    """
    parsed = F.from_json("value", f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad"})
    return decisions(lines.select(parsed.alias("r")).where("r is not null and r.__bad is null").select("r.*").drop("__bad"))


def decision_counts(events: DataFrame) -> DataFrame:
    """Decisions per hour, reason and pair of templates; a stream waits ten minutes for late ones."""
    e = decisions(events)
    e = e.withWatermark("ts", "10 minutes") if events.isStreaming else e
    n = e.groupBy(F.window("ts", "1 hour").alias("w"), "change_reason", "suggested", "selected").agg(F.count("*").alias("n"))
    return n.select(F.col("w.start").alias("start"), "change_reason", "suggested", "selected", "n")


def ordered_events(events: DataFrame) -> DataFrame:
    """Each event of a job once, numbered in order; ``streaming.stateful.ordered_events`` is the form for streams."""
    once = events.dropDuplicates(["job_id", "event_id"])
    return running(once, ["job_id"], F.date_trunc("day", "ts"), ["ts", "event_id"], {"seq": ("count", F.lit(1))}).withColumn("seq", F.col("seq") - 1)


def evidence_counts(found: DataFrame) -> DataFrame:
    """updated, review and pruned texts; rejects count as review, so pruned stays 0."""
    sure = F.col("status") == "confirmed"
    return found.agg(F.count_if(sure).alias("updated"), F.count_if(~sure).alias("review"), F.lit(0).cast("long").alias("pruned"))


def _call(state: tuple, number: int, at: float, outcome: str, duration: float, failures: int) -> tuple:
    """What a call does to (over, n, kept, until): failures in a row and the end of a cooldown, 0 for none.

    With ``over``, n counts on from failures before this piece, which were at the limit or above.  With ``kept`` the cooldown is
    the one from before, which lapses at the piece's call of that number.
    """
    over, n, kept, until = state
    if outcome == "ok":
        return False, 0, 0, 0.0
    if 0 < kept <= number or not kept and 0 < until <= at:
        over, n, kept, until = False, 0, 0, 0.0
    if outcome == "limited" or over or n + 1 >= failures:
        kept, until = 0, at + duration
    return over, n + 1, kept, until


def key_states(calls: DataFrame, failures: int = 3, cooldown: float = 60.0, limited: float = 120.0) -> DataFrame:
    """Per key after its last call: failures in a row, cooldown_until and last_seen, in seconds.

    ``calls`` has provider, key, at (seconds), seq and outcome (ok, failed or limited); with a column ``custom``, a call's own
    cooldown where that is neither null nor 0.  A rate limit or the third failure in a row starts a cooldown, a success ends it,
    and a cooldown that has passed clears the failures.

    Calls are sorted in ranges, so that a hot key spreads over tasks.  What a task has of a key is a function from the state
    before to the state behind it.  It has few cases: the failures before count up to the limit, and the cooldown before
    only matters at the first calls, for then a new one takes its place.  A key's functions, one a task at most, are then applied in turn.
    """
    cases = [(n, k) for n in range(failures + 1) for k in range(failures + 2)]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, now, out = TaskContext.get().partitionId(), None, []

        def done() -> tuple:
            ends = [states[j] for j in case]
            return (*now, part, last, times, *([e[k] for e in ends] for k in range(4)))

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)

        for b in batches:
            for provider, key, at, outcome, custom in zip(*(c.to_pylist() for c in b.columns)):
                if (provider, key) != now:
                    if now is not None:
                        out.append(done())
                    # only a task's first key may have calls before
                    first = [(n == failures, n % failures if failures else 0, k, 0.0) for n, k in cases] if now is None else [(False, 0, 0, 0.0)]
                    now, times, number = (provider, key), [], 0
                    states, case = first, list(range(len(first)))
                number, last = number + 1, at
                if number <= failures:
                    times.append(at)
                duration = custom or (limited if outcome == "limited" else cooldown)
                after = [_call(s, number, at, outcome, duration, failures) for s in states]
                states = list(dict.fromkeys(after))
                if len(states) < len(after):
                    place = {s: j for j, s in enumerate(states)}
                    case = [place[after[j]] for j in case]
            if len(out) > 10_000:
                yield batch()
                out = []
        if now is not None:
            out.append(done())
        if out:
            yield batch()

    custom = F.col("custom").cast("double") if "custom" in calls.columns else F.lit(None).cast("double")
    order = ["provider", "key", "at", "seq"]
    sorted_ = calls.select("provider", "key", F.col("at").cast("double").alias("at"), "seq", "outcome", custom.alias("custom")).repartitionByRange(*order).sortWithinPartitions(*order).drop("seq")
    schema = ", ".join(f"{c} {calls.schema[c].dataType.simpleString()}" for c in ("provider", "key")) + ", part int, last double, times array<double>, over array<boolean>, n array<bigint>, kept array<int>, until array<double>"
    kinds = to_arrow_schema(_parse_datatype_string(schema))
    found = sorted_.mapInArrow(pieces, schema)
    one = F.struct("part", "last", "times", "over", "n", "kept", "until")
    per = found.groupBy("provider", "key").agg(F.array_sort(F.collect_list(one)).alias("p"))

    def apply(state: Column, piece: Column) -> Column:
        # the case: failures up to the limit, and before which of the first calls the cooldown ends
        ahead = F.when(state["until"] == 0, 0).otherwise(F.size(F.filter(piece["times"], lambda t: t < state["until"])) + 1)
        k = F.when(F.size(piece["n"]) == 1, 0).otherwise(F.least(state["n"], F.lit(failures)) * (failures + 2) + ahead).cast("int")
        n = F.get(piece["n"], k) + F.when(F.get(piece["over"], k), state["n"]).otherwise(0)
        return F.struct(n.alias("n"), F.when(F.get(piece["kept"], k) > 0, state["until"]).otherwise(F.get(piece["until"], k)).alias("until"))

    end = F.aggregate("p", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("until")), apply)
    return per.select("provider", "key", end.alias("e"), F.element_at("p", -1)["last"].alias("last_seen")).select("provider", "key", F.col("e.n").alias("failures"), F.col("e.until").alias("cooldown_until"), "last_seen")


def pool_health(states: DataFrame, now: float) -> DataFrame:
    """Per provider: keys, how many are usable and how many cool down."""
    cooling = F.col("cooldown_until") > now
    h = states.groupBy("provider").agg(F.count("*").alias("total"), F.count_if(~cooling).alias("active"), F.count_if(cooling).alias("cooling"))
    return h.withColumn("all_healthy", F.col("active") == F.col("total"))


def orphan_folders(files: DataFrame, projects: DataFrame) -> DataFrame:
    """How many folders (the second part of each path) are no project's, their bytes, and megabytes to one place."""
    folder = F.get(F.split("path", "/"), F.lit(1))
    per = files.groupBy(folder.alias("project_id")).agg(F.sum("byte_size").alias("bytes"))
    left = per.where("project_id IS NOT NULL").join(projects.select(F.col("project_id").cast("string").alias("project_id")).distinct(), "project_id", "left_anti")
    return left.agg(F.count("*").alias("folders"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).withColumn("mb", F.floor(F.col("bytes") / (1024 * 1024) * 10 + 0.5) / 10)
