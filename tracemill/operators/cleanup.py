"""Which sessions may be cleaned away with all that hangs from them, and why others may not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import settled
from . import chains

#: Reasons of a plan in the order they are looked for, then those of carrying it out.
REASONS = ("unknown_session", "archived", "subagent", "unsupported", "working", "live_process", "source_missing", "outside_root", "symlink", "hardlink", "shared_target")
FAILURES = ("source_changed", "archive_failed", "trash_failed", "trash_partial")
#: An archive is taken to need one byte of so many.
RATIO = 10


def _prefixes(path: str) -> str:
    """SQL for a path and all folders above it."""
    return f"transform(sequence(1, size(split({path}, '/'))), n -> array_join(slice(split({path}, '/'), 1, n), '/'))"


def members(sessions: DataFrame) -> DataFrame:
    """(root, session, depth) of every session and all that hang from it; what hangs from an archived one, and such ones, do not."""
    links = sessions.where("not archived").select(F.col("session").alias("node"), "parent")
    return chains.closure(links).select(F.col("ancestor").alias("root"), F.col("node").alias("session"), "depth").unionByName(sessions.select(F.col("session").alias("root"), "session", F.lit(0).cast("bigint").alias("depth")))


def plan(requested: DataFrame, sessions: DataFrame, targets: DataFrame, sources: DataFrame) -> DataFrame:
    """A row a requested session: (session, place, harness, title, children, eligible, reason, detail, bytes, archive_bytes).

    ``requested`` (session, place) may name one several times, the first place counts. ``sessions``: session, parent,
    harness, title, status, pid, archived, supported, source_exists; ``targets``: what a session would move, (session,
    path, bytes, exists, inside_root, symlink, hardlink); ``sources``: (session, path) of every session's own file.

    A sub-session whose parent is there and not archived goes with that parent only. A tree is eligible if all of it is;
    else the first reason counts: of sessions by depth, then by name, each looked at for support, work, a live process and
    its file in this order; then of targets, whether any is outside, then by path links, then files of sessions elsewhere
    that would go too. A target inside another one of the tree counts once. A tree that does not exist has no bytes.
    """
    asked = requested.where("session is not null").groupBy("session").agg(F.min("place").alias("place"))
    up = sessions.where("not archived").select(F.col("session").alias("parent"), F.lit(True).alias("held"))
    known = asked.join(sessions.select("session", "parent", "harness", "title", "archived").join(up, "parent", "left"), "session", "left")
    before = F.expr("case when archived is null then 'unknown_session' when archived then 'archived' when held then 'subagent' end")
    roots = settled(known.select("session", "place", "harness", "title", before.alias("early"), F.when(F.col("held") & ~F.col("archived"), F.col("parent")).alias("early_detail")))
    trees = settled(members(sessions).join(roots.where("early is null").select(F.col("session").alias("root")), "root"))
    each = trees.join(sessions.select("session", "status", "pid", "supported", "source_exists"), "session")
    own = F.expr("case when not supported then 'unsupported' when status = 'work' then 'working' when pid is not null then 'live_process' when not source_exists then 'source_missing' end")
    whole = each.groupBy("root").agg((F.count("*") - 1).alias("children"), F.min(F.when(own.isNotNull(), F.struct("depth", "session", own.alias("reason")))).alias("s"))
    moved = trees.join(targets.where("exists"), "session").groupBy("root", "path").agg(F.max("bytes").alias("bytes"), F.bool_and("inside_root").alias("inside"), F.bool_or("symlink").alias("symlink"), F.bool_or("hardlink").alias("hardlink"))
    above = moved.select("root", F.col("path").alias("inner"), F.explode(F.expr(_prefixes("path"))).alias("path")).where("inner <> path")
    nested = above.join(moved.select("root", "path"), ["root", "path"]).select("root", F.col("inner").alias("path")).distinct()
    moved = settled(moved.join(nested, ["root", "path"], "left_anti"))
    linked = F.expr("case when symlink then 'symlink' when hardlink then 'hardlink' end")
    paths = moved.groupBy("root").agg(F.sum("bytes").alias("bytes"), F.min(F.when(~F.col("inside"), F.col("path"))).alias("outside"), F.min(F.when(linked.isNotNull(), F.struct("path", linked.alias("reason")))).alias("l"))
    # A target in many trees is looked up once for each of them; a source's folders are few.
    under = sources.select(F.col("session").alias("other"), F.explode(F.expr(_prefixes("path"))).alias("path")).join(moved.select("root", "path"), "path").select("root", F.col("other").alias("session")).distinct()
    shared = under.join(trees.select("root", "session"), ["root", "session"], "left_anti").groupBy("root").agg(F.min("session").alias("shared"))
    rows = roots.join(whole.withColumnRenamed("root", "session"), "session", "left").join(paths.withColumnRenamed("root", "session"), "session", "left").join(shared.withColumnRenamed("root", "session"), "session", "left")
    reason = F.coalesce("early", "s.reason", F.when(F.col("outside").isNotNull(), "outside_root"), "l.reason", F.when(F.col("shared").isNotNull(), "shared_target"))
    detail = F.when(F.col("early").isNotNull(), F.col("early_detail")).when(F.col("s").isNotNull(), F.col("s.session")).otherwise(F.coalesce("outside", "l.path", "shared"))
    fine = reason.isNull()
    bytes_ = F.when(fine, F.coalesce("bytes", F.lit(0))).otherwise(F.lit(0)).cast("bigint")
    return rows.select("session", "place", "harness", "title", F.coalesce("children", F.lit(0)).alias("children"), fine.alias("eligible"), reason.alias("reason"), detail.alias("detail"), bytes_.alias("bytes"), F.ceil(bytes_ / RATIO).cast("bigint").alias("archive_bytes"))


def totals(planned: DataFrame) -> DataFrame:
    """One row: sessions asked for, eligible ones, bytes freed, bytes of archives, sessions that go along."""
    fine = F.col("eligible")
    return planned.agg(F.count("*").alias("sessions"), F.count_if(fine).alias("eligible"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("freed_bytes"), F.coalesce(F.sum("archive_bytes"), F.lit(0)).alias("archive_bytes"), F.coalesce(F.sum(F.when(fine, F.col("children"))), F.lit(0)).alias("children"))


def outcome(planned: DataFrame, done: DataFrame) -> DataFrame:
    """(session, status, reason, freed_bytes, archive_bytes) of carrying a plan out.

    ``done`` tells for eligible sessions (session, changed, archive_bytes, files, moved): whether a file changed since the
    plan, the archive's size (null: it could not be written) and how many of the files were moved. Sessions that were not
    eligible, or that ``done`` does not have, are skipped; a session that fails keeps its files but for those moved.
    """
    rows = planned.join(done.withColumnRenamed("archive_bytes", "written"), "session", "left")
    failed = F.expr("case when changed then 'source_changed' when written is null then 'archive_failed' when files > 0 and coalesce(moved, 0) = 0 then 'trash_failed' when coalesce(moved, 0) < files then 'trash_partial' end")
    skipped = ~F.col("eligible") | F.col("changed").isNull()
    status = F.when(skipped, "skipped").when(failed.isNull(), "cleaned").when(failed == "trash_partial", "partial").otherwise("failed")
    cleaned = status == "cleaned"
    return rows.select("session", status.alias("status"), F.when(skipped, F.col("reason")).otherwise(failed).alias("reason"), F.when(cleaned, F.col("bytes")).otherwise(F.lit(0)).alias("freed_bytes"), F.when(cleaned, F.col("written")).otherwise(F.lit(0)).alias("archive_bytes"))

