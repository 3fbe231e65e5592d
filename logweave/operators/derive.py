"""Relations derived from the entries of each session. ``entries`` is deduplicated unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.scalars import at, kind_of, strict_string, trim_all

# Prefixes of user texts that no person has typed.
NOISE = ["<local-command-stdout>", "<local-command-caveat>", "<system-reminder>", "[Request interrupted"]
MAX_TEXT = 500
COMMAND = r"<command-name>/([^<]+)</command-name>"
TOKENS = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens"]


def _first(value: Column, order: Column | str, where: Column) -> Column:
    """The value at the least order among the rows that hold the condition (a partial aggregate)."""
    return F.min_by(value, F.when(where, F.col(order) if isinstance(order, str) else order))


def metrics(entries: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Token sums of all assistant entries, milliseconds from first to last, and the number of entries.

    With ``sessions`` (session_key), those without entries come out with zeros. One grouped aggregate.
    """
    assistant = F.col("type") == "assistant"
    sums = [F.coalesce(F.sum(F.when(assistant, F.col(c))), F.lit(0)).alias(c) for c in TOKENS]
    out = entries.groupBy("session_key").agg(*sums, F.coalesce(F.max("ts_ms") - F.min("ts_ms"), F.lit(0)).alias("duration_ms"), F.count("*").alias("message_count"))
    if sessions is not None:
        out = sessions.select("session_key").join(out, "session_key", "left").na.fill(0)
    total = sum((F.col(c) for c in TOKENS), F.lit(0))
    return out.select("session_key", *TOKENS, total.cast("long").alias("total_tokens"), "duration_ms", "message_count")


def compaction_phases(entries: DataFrame) -> DataFrame:
    """(session_key, compaction_count, phase_number, contribution, peak_tokens, post_compaction).

    The context is cut at compaction markers. Needs type, is_sidechain, model, tokens, is_compact. Windows run
    over a narrow projection of the session, then over one row per segment.
    """
    counts = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("cache_read_tokens", F.lit(0)) + F.coalesce("cache_creation_tokens", F.lit(0))
    main = (F.col("type") == "assistant") & ~F.coalesce("is_sidechain", F.lit(False)) & ~F.coalesce(F.col("model") == "<synthetic>", F.lit(False))
    marker = ((F.col("type") == "user") & F.coalesce("is_compact", F.lit(False))).cast("long")
    narrow = entries.select("session_key", "line_no", F.when(main & (counts > 0), counts).alias("tok"), marker.alias("m")).where(F.col("tok").isNotNull() | (F.col("m") > 0))
    so_far = Window.partitionBy("session_key").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = narrow.withColumn("c", F.sum("m").over(so_far))
    segments = cut.groupBy("session_key", "c").agg(_first(F.col("tok"), "line_no", F.col("tok").isNotNull()).alias("ft"), F.max_by("tok", F.when(F.col("tok").isNotNull(), F.col("line_no"))).alias("lt"))
    # a segment is missing only before a marker that comes first
    spine = segments.groupBy("session_key").agg(F.max("c").alias("n")).select("session_key", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))).alias("c"))
    by_session = Window.partitionBy("session_key")
    order = by_session.orderBy("c")
    rows = spine.join(segments, ["session_key", "c"], "left").select(
        "session_key",
        "n",
        "c",
        F.coalesce(F.last("lt", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)).alias("peak"),
        F.coalesce("ft", F.lit(0)).alias("post"),
        F.coalesce(F.lead("ft").over(order), F.lit(0)).alias("next_post"),
        F.max("lt").over(by_session).alias("any"),
    )
    c, n = F.col("c"), F.col("n")
    return rows.where(F.col("any").isNotNull() & ((c < n) | (n == 0) | (F.col("post") > 0))).select(
        "session_key",
        n.alias("compaction_count"),
        (c + 1).alias("phase_number"),
        (F.col("peak") - F.when(c == 0, 0).otherwise(F.col("post"))).cast("long").alias("contribution"),
        F.col("peak").cast("long").alias("peak_tokens"),
        F.when(c < n, F.col("next_post")).cast("long").alias("post_compaction"),
    )


def compaction(entries: DataFrame) -> DataFrame:
    """Per session: compaction_count, n_phases and context_consumption (null without phases)."""
    counts = entries.groupBy("session_key").agg(F.sum(((F.col("type") == "user") & F.coalesce("is_compact", F.lit(False))).cast("long")).alias("compaction_count"))
    sums = compaction_phases(entries).groupBy("session_key").agg(F.count("*").alias("n_phases"), F.sum("contribution").alias("context_consumption"))
    return counts.join(sums, "session_key", "left").select("session_key", "compaction_count", F.coalesce("n_phases", F.lit(0)).cast("long").alias("n_phases"), "context_consumption")


def activity_events(entries: DataFrame) -> DataFrame:
    """(session_key, line_no, block_no, kind, tool_id); kind is open, ending, shutdown (ending, and its id) or result."""
    b = F.col("block")
    rejected = F.coalesce(strict_string(F.col("tool_use_result")) == "User rejected tool use", F.lit(False))
    rows = entries.where(F.col("type").isin("assistant", "user")).select("session_key", "line_no", "type", rejected.alias("rejected"), F.posexplode("content_blocks").alias("block_no", "block"))
    kind, text, name = strict_string(b, "$.type"), strict_string(b, "$.text"), strict_string(b, "$.name")
    shutdown = (name == "SendMessage") & (strict_string(b, "$.input.type") == "shutdown_response") & F.coalesce((kind_of(at(b, "$.input.approve")) == "boolean") & F.try_variant_get(b, "$.input.approve", "boolean"), F.lit(False))
    assistant = (
        F.when((kind == "thinking") & (strict_string(b, "$.thinking") != ""), "open")
        .when((kind == "tool_use") & (name == "ExitPlanMode"), "ending")
        .when((kind == "tool_use") & shutdown, "shutdown")
        .when(kind == "tool_use", "open")
        .when((kind == "text") & (trim_all(text) != ""), "ending")
    )
    user = F.when((kind == "tool_result") & F.col("rejected"), "ending").when(kind == "tool_result", "result").when((kind == "text") & text.startswith("[Request interrupted"), "ending")
    out = rows.select("session_key", "line_no", "block_no", F.when(F.col("type") == "assistant", assistant).otherwise(user).alias("kind"), F.coalesce(strict_string(b, "$.id"), strict_string(b, "$.tool_use_id")).alias("tool_id"))
    return out.where(F.col("kind").isNotNull())


def ongoing(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_key, is_ongoing): whether the last event of the session leaves something open.

    A result ends if its id has been registered by an earlier shutdown. ``events`` as from
    :func:`activity_events`; ``sessions`` (session_key) without events are not ongoing.
    """
    place = F.struct("line_no", "block_no")
    by_id = Window.partitionBy("session_key", "tool_id")
    known = events.withColumn("__shut", F.min(F.when(F.col("kind") == "shutdown", place)).over(by_id))
    still = (F.col("kind") == "open") | ((F.col("kind") == "result") & ~F.coalesce(F.col("__shut") < place, F.lit(False)))
    last = known.groupBy("session_key").agg(F.max_by(still, place).alias("is_ongoing"))
    return sessions.select("session_key").distinct().join(last, "session_key", "left").select("session_key", F.coalesce("is_ongoing", F.lit(False)).alias("is_ongoing"))


def first_observed(entries: DataFrame) -> DataFrame:
    """Per session the first non-empty session_id, version, git_branch, cwd and permission_mode.

    An empty string holds only where nothing else comes. The mode is that of permission-mode entries.
    """

    def first(value: Column) -> Column:
        return F.coalesce(_first(value, "line_no", value != ""), F.max(value))

    fields = [first(F.col(c)).alias(c) for c in ("session_id", "version", "git_branch", "cwd")]
    mode = F.when(F.col("type") == "permission-mode", F.col("permission_mode"))
    return entries.groupBy("session_key").agg(*fields, first(mode).alias("permission_mode"))


def user_text(entries: DataFrame) -> Column:
    """The text of a user entry: the string, or the text blocks with a space between them."""
    texts = F.filter("content_blocks", lambda b: strict_string(b, "$.type") == "text")
    joined = F.array_join(F.transform(texts, lambda b: F.coalesce(strict_string(b, "$.text"), F.lit(""))), " ")
    return F.coalesce(F.col("content_text"), joined)


def first_user_message(rows: DataFrame) -> DataFrame:
    """Per session the first user text that is no noise: (session_key, text, timestamp).

    ``rows`` has session_key, line_no, type, text, timestamp. A text that holds a command counts only where no
    plain text follows, and gives the command; a plain one gives its first 500 characters. Sessions without
    any are left out.
    """
    text = trim_all(F.col("text"))
    users = rows.where(F.col("type") == "user").select("session_key", "line_no", text.alias("text"), "timestamp")
    noise = F.lit(False)
    for prefix in NOISE:
        noise = noise | F.col("text").startswith(prefix)
    typed = users.where((F.col("text") != "") & ~noise)
    command = F.col("text").rlike(COMMAND)
    value = F.struct(F.when(command, F.concat(F.lit("/"), F.regexp_extract("text", COMMAND, 1))).otherwise(F.left(F.col("text"), F.lit(MAX_TEXT))).alias("text"), "timestamp")
    best = typed.groupBy("session_key").agg(F.min_by(value, F.struct(command.alias("command"), "line_no")).alias("m"))
    return best.select("session_key", "m.text", "m.timestamp")


def skills(listings: DataFrame) -> DataFrame:
    """(session_key, names) of the first skill listing of each session; (session_key, line_no, content) come in.

    A name is what stands before the first ``": "`` of a line that starts with ``"- "``; order and repeats stay.
    """
    first = listings.groupBy("session_key").agg(F.min_by("content", "line_no").alias("content"))
    lines = F.filter(F.split("content", "\n"), lambda x: x.startswith("- "))
    rest = F.transform(lines, lambda x: F.substring(x, F.lit(3), F.length(x)))
    named = F.filter(rest, lambda x: F.instr(x, ": ") > 1)
    return first.select("session_key", F.transform(named, lambda x: trim_all(F.substring(x, F.lit(1), F.instr(x, ": ") - 1))).alias("names"))


def unused_skills(listed: DataFrame, calls: DataFrame) -> DataFrame:
    """(session_key, name) of listed skills (names, an array) that no tool call of the session names."""
    names = listed.select("session_key", F.explode("names").alias("name"))
    return names.join(calls.select("session_key", "name"), ["session_key", "name"], "left_anti")


def skill_listings(entries: DataFrame) -> DataFrame:
    return entries.where((F.col("type") == "attachment") & (F.col("attachment_type") == "skill_listing")).select("session_key", "line_no", F.coalesce(strict_string(F.col("attachment"), "$.content"), F.lit("")).alias("content"))


def deferred_deltas(entries: DataFrame) -> DataFrame:
    """(session_key, line_no, added, removed) of the attachments that change the deferred tools."""
    delta = entries.where((F.col("type") == "attachment") & (F.col("attachment_type") == "deferred_tools_delta"))
    return delta.select("session_key", "line_no", *(F.coalesce(F.try_variant_get(F.col("attachment"), f"$.{path}", "array<string>"), F.array().cast("array<string>")).alias(name) for name, path in (("added", "addedNames"), ("removed", "removedNames"))))


def deferred_tools(deltas: DataFrame) -> DataFrame:
    """(session_key, names): names added and not removed since, in the order of their (last) addition.

    Each delta adds first and removes then. Removals are found by a window per name, so a session with many
    names is no single group before the names are listed.
    """
    name = F.posexplode("names").alias("i", "name")
    added = deltas.select("session_key", "line_no", F.lit(0).alias("o"), F.col("added").alias("names")).select("session_key", "line_no", "o", name)
    removed = deltas.select("session_key", "line_no", F.lit(1).alias("o"), F.col("removed").alias("names")).select("session_key", "line_no", "o", name)
    ops = added.union(removed).select("session_key", "name", "o", F.struct("line_no", "o", "i").alias("p"))
    gone = ops.withColumn("gone", F.max(F.when(F.col("o") == 1, F.col("p"))).over(Window.partitionBy("session_key", "name")))
    alive = gone.where((F.col("o") == 0) & (F.col("gone").isNull() | (F.col("p") > F.col("gone")))).groupBy("session_key", "name").agg(F.min("p").alias("p"))
    listed = alive.groupBy("session_key").agg(F.array_sort(F.collect_list(F.struct("p", "name"))).alias("l"))
    return listed.select("session_key", F.transform("l", lambda x: x["name"]).alias("names"))
