"""Projects, sessions and sub-agent files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.scalars import base_name, dir_name, stem
from logweave.operators.derive import first_observed, first_user_message, user_text
from logweave.plans.lineage import cut
from logweave.sources.files import default_dir, frame, listing
from logweave.sources.jsonl import first_lines, read_head

HEAD_LINES = 200
SESSION_FILES = "session_key string, project string, name string, size long"


def session_files(spark: SparkSession, project_dir: str, project: str | None = None) -> DataFrame:
    """(session_key, project, name, size) of the logs directly in a project's folder."""
    return frame(spark, _session_rows(spark, project_dir, project), SESSION_FILES)


def _session_rows(spark: SparkSession, project_dir: str, project: str | None) -> list[tuple]:
    name = project if project is not None else project_dir.rstrip("/").rsplit("/", 1)[-1]
    return [(path, name, n, size) for n, path, is_dir, size in listing(spark, project_dir) if n.endswith(".jsonl") and not is_dir]


def count_sessions(projects: DataFrame, files: DataFrame) -> DataFrame:
    """(project, session_count) of (project) and (project, session_key); projects without files count 0."""
    counts = files.groupBy("project").agg(F.count("*").alias("session_count"))
    return projects.select("project").join(counts, "project", "left").select("project", F.coalesce("session_count", F.lit(0)).cast("long").alias("session_count"))


def by_name(column: str) -> Column:
    """The order of names that people expect (Unicode collation, not code points)."""
    return F.collate(F.col(column), "UNICODE")


def list_projects(spark: SparkSession, root: str | None = None) -> DataFrame:
    """(project, path, session_count) of the folders in ``root``, by name; a missing root has none."""
    folders = [(name, path) for name, path, is_dir, _ in listing(spark, root or default_dir("projects")) if is_dir]
    rows = [(name, path, sum(n.endswith(".jsonl") for n, *_ in listing(spark, path))) for name, path in folders]
    return frame(spark, rows, "project string, path string, session_count long").orderBy(by_name("project"), "project")


def summaries(entries: DataFrame, files: DataFrame) -> DataFrame:
    """One row per file: first-observed fields, first user message, first and last timestamp, size.

    ``entries`` are the head of each file, not deduplicated. Files without entries keep a row of nulls.
    """
    stamp = F.col("timestamp")
    times = entries.groupBy("session_key").agg(
        F.coalesce(F.min_by(stamp, F.when(stamp != "", F.col("line_no"))), F.max(stamp)).alias("first_timestamp"),
        F.max_by(stamp, F.when(stamp.isNotNull(), F.col("line_no"))).alias("last_timestamp"),
    )
    texts = first_user_message(entries.withColumn("text", user_text(entries)) if "text" not in entries.columns else entries).select("session_key", F.col("text").alias("first_message"))
    return files.join(first_observed(entries), "session_key", "left").join(times, "session_key", "left").join(texts, "session_key", "left")


def newest() -> list[Column]:
    """By first timestamp (text), the latest first; those without, by path, last."""
    return [F.desc_nulls_last(F.nullif("first_timestamp", F.lit(""))), F.col("session_key")]


def newest_first(rows: DataFrame, *before: Column) -> DataFrame:
    return rows.orderBy(*before, *newest())


def list_sessions(spark: SparkSession, project_dir: str, head_lines: int = HEAD_LINES) -> DataFrame:
    """Summaries of a project's sessions from the first ``head_lines`` non-blank lines of each, the newest first."""
    rows = _session_rows(spark, project_dir, None)
    return newest_first(_summarised(spark, rows, f"{project_dir.rstrip('/')}/*.jsonl", head_lines))


def _summarised(spark: SparkSession, rows: list[tuple], glob: str, head_lines: int) -> DataFrame:
    """Summaries of the listed files, which the glob names."""
    files = frame(spark, rows, SESSION_FILES)
    return summaries(read_head(spark, glob, head_lines) if rows else _no_entries(spark), files)


def _no_entries(spark: SparkSession) -> DataFrame:
    names = "session_id version git_branch cwd permission_mode type timestamp text".split()
    return spark.createDataFrame([], "session_key string, line_no long, " + ", ".join(f"{n} string" for n in names))


def find_all_sessions(spark: SparkSession, root: str | None = None, head_lines: int = HEAD_LINES) -> DataFrame:
    """Summaries of all projects' sessions: projects by name, within each the newest first. One scan for all."""
    root = (root or default_dir("projects")).rstrip("/")
    rows = [row for name, path, is_dir, _ in listing(spark, root) if is_dir for row in _session_rows(spark, path, name)]
    return newest_first(_summarised(spark, rows, f"{root}/*/*.jsonl", head_lines), by_name("project"), F.col("project"))


def subagent_files(parents: DataFrame, files: DataFrame, firsts: DataFrame) -> DataFrame:
    """(parent_key, child_key, layout) of the sub-agent logs of each parent.

    parents: session_key. files: session_key, size of all logs that may be sub-agents. firsts: session_key,
    first_session_id. The new layout is ``<folder>/<stem>/subagents/agent-*.jsonl`` of some size; the old one
    ``<folder>/agent-*.jsonl`` whose first line has the parent's session id. Both are listed; a log of the old
    layout that is its own parent lists itself.
    """
    key = F.col("session_key")
    agents = files.where(base_name(key).rlike(r"^agent-.*\.jsonl$")).select(key.alias("child_key"), "size", dir_name(key).alias("folder"))
    own = parents.select(key.alias("parent_key"), dir_name(key).alias("folder"), stem(key).alias("stem"))
    new = own.select("parent_key", F.concat_ws("/", "folder", "stem", F.lit("subagents")).alias("folder")).join(agents.where("size > 0"), "folder").select("parent_key", "child_key", F.lit("new").alias("layout"))
    child_ids = agents.join(firsts.select(key.alias("child_key"), "first_session_id"), "child_key").select("folder", "child_key", "first_session_id")
    parent_ids = own.join(firsts.select(key.alias("parent_key"), "first_session_id"), "parent_key").select("folder", "parent_key", "first_session_id")
    old = parent_ids.join(child_ids, ["folder", "first_session_id"]).select("parent_key", "child_key", F.lit("old").alias("layout"))
    return new.unionByName(old)


def find_subagent_files(spark: SparkSession, parent: str) -> DataFrame:
    """(parent_key, child_key, layout) of one session's log, the new layout first."""
    folder, name = parent.rstrip("/").rsplit("/", 1)
    base = name[: -len(".jsonl")] if name.endswith(".jsonl") else name
    listed = [(p, s) for f in (folder, f"{folder}/{base}/subagents") for n, p, d, s in listing(spark, f) if n.endswith(".jsonl") and (n == name or n.startswith("agent-"))]
    files = frame(spark, [(p, s) for p, s in listed], "session_key string, size long")
    if not listed:
        return frame(spark, [], "parent_key string, child_key string, layout string")
    firsts = first_lines(spark, [p for p, _ in listed])
    parents = files.where(base_name(F.col("session_key")) == name).where(~F.col("session_key").contains(f"/{base}/subagents/"))
    return subagent_files(parents, files, firsts).orderBy("layout", by_name("child_key"))


def descendants(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(root_key, node): each of ``nodes`` (session_key) with itself and all that descend from it, to any depth.

    Links are doubled: with the pairs at most 2**t - 1 links apart and those that 2**t links join, one join
    gives all pairs at most 2**(t + 1) - 1 apart, so a tree of depth d takes about log2(d) rounds. In a tree
    every pair is made once. Cycles end where nothing new is reached.
    """
    step = cut(edges.where(F.col("parent_key") != F.col("child_key")).select(F.col("parent_key").alias("u"), F.col("child_key").alias("v")).distinct())
    reached = cut(nodes.select(F.col("session_key").alias("root_key"), F.col("session_key").alias("node")).distinct())
    size = reached.count()
    while True:
        farther = reached.join(step, reached["node"] == step["u"]).select("root_key", F.col("v").alias("node"))
        reached = cut(reached.union(farther).distinct())
        before, size = size, reached.count()
        if size == before:
            return reached
        onward = step.select(F.col("u").alias("v"), F.col("v").alias("w"))
        step = cut(step.join(onward, "v").select("u", F.col("w").alias("v")).distinct())


def tree_totals(edges: DataFrame, totals: DataFrame) -> DataFrame:
    """(root_key, n_sessions, tokens): sums over each session and all that descend from it, to any depth.

    edges: parent_key, child_key (from any layout). totals: session_key, tokens. A session counts once per
    root; links to itself and cycles end where they meet a session that has been seen.
    """
    # links through sessions without a total of their own still join what lies beyond them
    reached = descendants(edges, totals)
    return reached.join(totals.withColumnRenamed("session_key", "node"), "node").groupBy("root_key").agg(F.count("*").alias("n_sessions"), F.sum("tokens").alias("tokens"))
