"""Registered queries that start from the text of logs: the events as JSON lines, parsed as logs are, and as files."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.functions.scalars import base_name, trim_all
from logweave.operators import audit, derive
from logweave.operators import entries as ops
from logweave.plans import adapters as A
from logweave.plans.lineage import shared_dir
from logweave.plans.registry import query
from logweave.plans.session import open_logs
from logweave.sources import discovery, file_history, jsonl, tasks

# The events that are good lines, in SQL; others are blank (every 19th) or no JSON (every 17th).
GOOD = "ev as (select *, json_extract_string(props, '$.k')::bigint as k, user_id::varchar as session_key, event_id as line_no from events where event_id % 17 > 0 and event_id % 19 > 0)"


def event_text(rows: DataFrame) -> Column:
    """Each event as a line of a log: clicks are assistant entries, views and signups user entries, errors
    attachments, purchases snapshots; what they hold depends on k."""
    k, kind, i = F.col("k"), F.col("event_type"), F.col("event_id")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    use = A.json_text('{"type":"tool_use","id":"t', k % 20, '","name":')
    block = (
        F.when(k % 6 == 0, '{"type":"thinking","thinking":"hm"}')
        .when(k % 6 == 1, '{"type":"text","text":"done"}')
        .when(k % 6 == 2, F.concat(use, F.when(k % 4 == 0, '"Agent","input":{"deep":{"er":1}}}').otherwise('"Bash","input":{"k":"v"}}')))
        .when(k % 6 == 3, F.concat(use, F.lit('"ExitPlanMode","input":{}}')))
        .when(k % 6 == 4, F.concat(use, F.lit('"SendMessage","input":{"type":"shutdown_response","approve":true}}')))
        .otherwise("")
    )
    model = F.when(k % 13 == 0, "<synthetic>").otherwise("m")
    usage = A.json_text('{"input_tokens":', F.floor("value").cast("bigint"), ',"output_tokens":', k % 7, ',"cache_read_input_tokens":', k, "}")
    click = A.json_text('"assistant","requestId":"r', k % 10, '","isSidechain":', F.when(k % 11 == 0, "true").otherwise("false"), ',"message":{"role":"assistant","model":"', model, '","usage":', usage, ',"content":[', block, "]}")
    said = F.when(k % 2 == 0, "[Request interrupted by user]").otherwise(A.json_text("a ", k))
    result = A.json_text('{"type":"tool_result","tool_use_id":"t', k % 20, '","content":"out","is_error":', F.when(k % 5 == 0, "true").otherwise("false"), "}")
    content = F.when(k % 3 == 0, A.json_text('"\\n say ', k, '  "')).when(k % 3 == 1, A.json_text('[{"type":"text","text":"', said, '"},{"type":"image"},{"type":"text","text":"b"}]')).otherwise(A.json_text("[", result, "]"))
    view = A.json_text('"user","message":{"role":"user","content":', content, "}", F.when(k % 9 == 2, ',"toolUseResult":"User rejected tool use"').otherwise(""))
    signup = F.lit('"user","isCompactSummary":true,"message":{"role":"user","content":"<system-reminder>"}')
    names = A.json_text('["n', k % 10, '"]')
    delta = A.json_text('{"type":"deferred_tools_delta","addedNames":', F.when(k % 4 == 3, "[]").otherwise(names), ',"removedNames":', F.when(k % 4 == 3, names).otherwise("[]"), "}")
    error = A.json_text('"attachment","attachment":', F.when(k % 2 == 0, A.json_text('{"type":"skill_listing","content":"intro\\n- a', k % 5, ': d\\n- b: c"}')).otherwise(delta))
    backup = A.json_text('{"f', k % 7, '":{"backupFileName":', F.when(k % 4 == 0, "null").otherwise(A.json_text('"h', k, '@v"')), ',"version":', k % 3, ',"backupTime":"', stamp, '"}}')
    purchase = A.json_text('"file-history-snapshot","snapshot":{"trackedFileBackups":', backup, "}")
    body = F.when(kind == "click", click).when(kind == "view", view).when(kind == "signup", signup).when(kind == "error", error).otherwise(purchase)
    text = A.json_text('{"type":', body, ',"uuid":"u', i, '","sessionId":"s', F.col("user_id"), '","timestamp":"', stamp, '"}')
    return F.when(i % 19 == 0, " ").when(i % 17 == 0, F.concat(text, F.lit(" x"))).otherwise(text)


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_key, file_size, line_no, nonblank_no, line), as readers give them; trimmed."""
    rows = A.events(jsonl.configure(spark), sf_dir)
    i = F.col("event_id")
    return rows.select(F.col("user_id").cast("string").alias("session_key"), F.lit(0).cast("bigint").alias("file_size"), i.alias("line_no"), i.alias("nonblank_no"), trim_all(event_text(rows)).alias("line"))


def parsed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonl.canonical(jsonl.parsed(event_lines(spark, sf_dir)))


@query(f"""with {GOOD} select session_key, line_no, 'u' || event_id as uuid, 's' || user_id as session_id,
  case event_type when 'click' then 'assistant' when 'error' then 'attachment' when 'purchase' then 'file-history-snapshot' else 'user' end as type,
  case when event_type = 'click' then 'string:r' || (k % 10) end as request_key, event_type = 'click' and k % 11 = 0 as is_sidechain, event_type = 'signup' as is_compact,
  case when event_type = 'click' then case when k % 13 = 0 then '<synthetic>' else 'm' end end as model, case when event_type = 'click' then floor(value)::bigint end as input_tokens,
  case when event_type = 'click' then k % 7 end as output_tokens, case when event_type = 'click' then k end as cache_read_tokens, epoch_us(ts) // 1000 as ts_ms,
  case when event_type = 'error' then case when k % 2 = 0 then 'skill_listing' else 'deferred_tools_delta' end end as attachment_type from ev""")
def q46_parse_lines(spark, sf_dir):
    columns = "session_key line_no uuid session_id type request_key is_sidechain is_compact model input_tokens output_tokens cache_read_tokens ts_ms attachment_type".split()
    return parsed_entries(spark, sf_dir).select(*columns)


@query(f"""with {GOOD}, c as (select * from ev where event_type = 'click' qualify line_no = max(line_no) over (partition by session_key, k % 10))
 select session_key, line_no, 'u' || event_id as uuid from c where k % 11 > 0 and k % 13 > 0""")
def q47_main_chain(spark, sf_dir):
    return ops.main_chain(ops.deduplicate(parsed_entries(spark, sf_dir))).select("session_key", "line_no", "uuid")


@query(f"""with {GOOD} select case when event_type = 'error' then 'attachment' else 'file-history-snapshot' end as guard, count(*) as n from ev where event_type in ('error', 'purchase') group by 1
 union all select 'text', sum(case when event_type = 'click' then 1 else 2 end) from ev where (event_type = 'click' and k % 6 = 1) or (event_type = 'view' and k % 3 = 1)""")
def q48_guards(spark, sf_dir):
    rows = parsed_entries(spark, sf_dir)
    texts = ops.blocks_of_type(ops.blocks(rows), "text")
    guarded = [ops.of_type(rows, name).select(F.lit(name).alias("guard")) for name in ("attachment", "file-history-snapshot")]
    return guarded[0].union(guarded[1]).union(texts.select(F.lit("text").alias("guard"))).groupBy("guard").agg(F.count("*").alias("n"))


@query(f"""with {GOOD}, a as (select session_key, line_no, k % 20 as id, case when event_type = 'click' then case k % 6 when 0 then 'open' when 1 then 'ending' when 2 then 'open' when 3 then 'ending' when 4 then 'shutdown' end
   when event_type = 'view' and k % 3 = 2 then case when k % 9 = 2 then 'ending' else 'result' end when event_type = 'view' and k % 3 = 1 and k % 2 = 0 then 'ending' end as kind from ev),
 l as (select * from a where kind is not null qualify row_number() over (partition by session_key order by line_no desc) = 1)
 select s.session_key, coalesce(case when kind = 'open' then true when kind = 'result' then not exists (select 1 from a x where x.session_key = l.session_key and x.kind = 'shutdown' and x.id = l.id and x.line_no < l.line_no) else false end, false) as is_ongoing
 from (select distinct session_key from ev) s left join l using (session_key)""")
def q49_ongoing_from_blocks(spark, sf_dir):
    rows = parsed_entries(spark, sf_dir)
    return derive.ongoing(derive.activity_events(rows), rows.select("session_key").distinct())


@query(f"""with {GOOD}, f as (select session_key, 'f' || (k % 7) as file_path, k % 3 as version, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') as backup_time, case when k % 4 > 0 then 'h' || k || '@v' end as backup_file_name
   from ev where event_type = 'purchase' qualify row_number() over (partition by session_key, k % 7, k % 3 order by line_no desc) = 1)
 select *, (row_number() over (partition by session_key order by file_path, version))::int as place from f""")
def q50_snapshots(spark, sf_dir):
    versions = file_history.latest_versions(file_history.snapshot_rows(parsed_entries(spark, sf_dir)))
    return versions.withColumn("place", F.row_number().over(Window.partitionBy("session_key").orderBy(*file_history.history_order())))


@query(f"""with {GOOD}, l as (select session_key, k from ev where event_type = 'error' and k % 2 = 0 qualify row_number() over (partition by session_key order by line_no) = 1)
 select session_key, 'a' || (k % 5) || ',b' as names from l""")
def q51_skill_listings(spark, sf_dir):
    return derive.skills(derive.skill_listings(parsed_entries(spark, sf_dir))).select("session_key", F.array_join("names", ",").alias("names"))


@query(f"""with {GOOD}, d as (select session_key, line_no, k % 10 as name, k % 4 = 3 as gone from ev where event_type = 'error' and k % 2 = 1),
 r as (select session_key, name, max(line_no) as til from d where gone group by all),
 a as (select d.session_key, d.name, min(line_no) as p from d left join r using (session_key, name) where not d.gone and line_no > coalesce(til, -1) group by all)
 select session_key, string_agg('n' || name, ',' order by p) as names from a group by session_key""")
def q52_deferred_deltas(spark, sf_dir):
    return derive.deferred_tools(derive.deferred_deltas(parsed_entries(spark, sf_dir))).select("session_key", F.array_join("names", ",").alias("names"))


@query(f"""with {GOOD}, t as (select session_key, line_no, ts, case when k % 3 = 0 then 'say ' || k when k % 3 = 1 and k % 2 = 1 then 'a ' || k || ' b' end as text from ev where event_type = 'view')
 select session_key, text, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') as timestamp from t where text is not null qualify row_number() over (partition by session_key order by line_no) = 1""")
def q53_first_message_from_blocks(spark, sf_dir):
    rows = parsed_entries(spark, sf_dir)
    return derive.first_user_message(rows.withColumn("text", derive.user_text(rows)))


_PATHS = f"""{GOOD}, r as (select *, case event_type when 'click' then 'assistant' when 'error' then 'attachment' when 'purchase' then 'file-history-snapshot' else 'user' end as t from ev),
 b as (select 'entry[assistant].message.content' as p, case k % 6 when 0 then 'thinking' when 1 then 'text' else 'tool_use' end as t, case k % 6 when 0 then 'type thinking' when 1 then 'type text' else 'type id name input' end as f from ev where event_type = 'click' and k % 6 < 5
  union all select 'entry[user].message.content', 'text', 'type text' from ev, range(2) where event_type = 'view' and k % 3 = 1 union all select 'entry[user].message.content', 'image', 'type' from ev where event_type = 'view' and k % 3 = 1
  union all select 'entry[user].message.content', 'tool_result', 'type tool_use_id content is_error' from ev where event_type = 'view' and k % 3 = 2),
 seen as (select 'entry[' || t || ']' as path, 'object' as kind from r
  union all select 'entry[' || t || '].' || unnest(['type', 'uuid', 'sessionId', 'timestamp']), 'string' from r
  union all select 'entry[assistant]' || unnest(['.requestId', '.message.role', '.message.model']), 'string' from r where t = 'assistant' union all select 'entry[assistant].isSidechain', 'boolean' from r where t = 'assistant'
  union all select 'entry[assistant]' || unnest(['.message', '.message.usage']), 'object' from r where t = 'assistant' union all select 'entry[assistant].message.content', 'array' from r where t = 'assistant'
  union all select 'entry[assistant].message.usage.' || unnest(['input_tokens', 'output_tokens', 'cache_read_input_tokens']), 'number' from r where t = 'assistant'
  union all select 'entry[user].message', 'object' from r where t = 'user' union all select 'entry[user].message.role', 'string' from r where t = 'user'
  union all select 'entry[user].message.content', case when event_type = 'signup' or k % 3 = 0 then 'string' else 'array' end from r where t = 'user'
  union all select 'entry[user].isCompactSummary', 'boolean' from r where event_type = 'signup' union all select 'entry[user].toolUseResult', 'string' from r where event_type = 'view' and k % 9 = 2
  union all select p || '[' || t || ']', 'object' from b
  union all select p || '[' || t || '].' || f, case f when 'input' then 'object' when 'is_error' then 'boolean' else 'string' end from (select p, t, unnest(string_split(f, ' ')) as f from b)
  union all select 'entry[attachment].attachment', 'object' from r where t = 'attachment' union all select 'entry[attachment].attachment.type', 'string' from r where t = 'attachment'
  union all select 'entry[attachment].attachment.content', 'string' from r where t = 'attachment' and k % 2 = 0
  union all select 'entry[attachment].attachment.' || unnest(['addedNames', 'removedNames']), 'array' from r where t = 'attachment' and k % 2 = 1
  union all select case when k % 4 = 3 then 'entry[attachment].attachment.removedNames[]' else 'entry[attachment].attachment.addedNames[]' end, 'string' from r where t = 'attachment' and k % 2 = 1
  union all select 'entry[file-history-snapshot].snapshot' || unnest(['', '.trackedFileBackups', '.trackedFileBackups{{*}}']), 'object' from r where event_type = 'purchase'
  union all select 'entry[file-history-snapshot].snapshot.trackedFileBackups{{*}}.backupFileName', case when k % 4 = 0 then 'null' else 'string' end from r where event_type = 'purchase'
  union all select 'entry[file-history-snapshot].snapshot.trackedFileBackups{{*}}.version', 'number' from r where event_type = 'purchase' union all select 'entry[file-history-snapshot].snapshot.trackedFileBackups{{*}}.backupTime', 'string' from r where event_type = 'purchase')"""


@query(f"with {_PATHS} select path, array_to_string(list_sort(list_distinct(list(kind))), ',') as kinds from seen group by path")
def q54_inventory_of_logs(spark, sf_dir):
    return audit.inventory(audit.entry_seeds(jsonl.parsed(event_lines(spark, sf_dir)))).select("path", F.array_join("kinds", ",").alias("kinds"))


@query(f"with {_PATHS} select path, kind, count(*) as n from seen group by path, kind")
def q55_walk_of_logs(spark, sf_dir):
    return audit.walk(audit.entry_seeds(jsonl.parsed(event_lines(spark, sf_dir)))).groupBy("path", "kind").agg(F.count("*").alias("n"))


def write_logs(spark: SparkSession, sf_dir: str) -> str:
    """The lines of each session as ``<root>/p<user % 5>/<user>.jsonl`` in the shared folder; deleted when the application ends."""
    root = f"{shared_dir(spark).rstrip('/')}/logs-{uuid4().hex}"
    rows = A.events(jsonl.configure(spark), sf_dir)
    files = rows.select("user_id", "event_id", event_text(rows).alias("value")).repartition("user_id").sortWithinPartitions("user_id", "event_id")
    files.drop("event_id").write.partitionBy("user_id").text(f"{root}/raw")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    top = hadoop.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(top)
    for folder in fs.listStatus(hadoop.Path(f"{root}/raw")):
        if folder.isDirectory():
            user = folder.getPath().getName().removeprefix("user_id=")
            project = hadoop.Path(f"{root}/p{int(user) % 5}")
            fs.mkdirs(project)
            part = next(f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-"))
            fs.rename(part, hadoop.Path(project, f"{user}.jsonl"))
    fs.delete(hadoop.Path(f"{root}/raw"), True)
    return root


def write_store(spark: SparkSession, rows: DataFrame, suffix: str) -> str:
    """(session_id, name, value) as files ``<root>/<session_id>/<name><suffix>`` in the shared folder, deleted as the logs are."""
    root = f"{shared_dir(spark).rstrip('/')}/store-{uuid4().hex}"
    rows.repartition("session_id", "name").write.partitionBy("session_id", "name").text(f"{root}/raw")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    top = hadoop.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(top)
    for part in fs.globStatus(hadoop.Path(f"{root}/raw/*/*/part-*")):
        name, session = (p.getName().split("=", 1)[1] for p in (part.getPath().getParent(), part.getPath().getParent().getParent()))
        fs.mkdirs(hadoop.Path(f"{root}/{session}"))
        fs.rename(part.getPath(), hadoop.Path(f"{root}/{session}", name + suffix))
    fs.delete(hadoop.Path(f"{root}/raw"), True)
    return root


def _user(key: str = "session_key") -> Column:
    return F.regexp_extract(base_name(F.col(key)), r"^(\d+)", 1).cast("long")


# Lines are numbered in their file: the place of an event among those of its user.
_FILES = "n as (select *, json_extract_string(props, '$.k')::bigint as k, row_number() over (partition by user_id order by event_id) - 1 as line_no from events), ev as (select * from n where event_id % 17 > 0 and event_id % 19 > 0)"
_KEPT = "d as (select * from ev where event_type <> 'click' union all (select * from ev where event_type = 'click' qualify line_no = max(line_no) over (partition by user_id, k % 10)))"


@query(f"""with {_FILES}, {_KEPT} select user_id, 's' || user_id as session_id, count(*) as message_count, (coalesce(sum(floor(value)::bigint + k % 7 + k) filter (event_type = 'click'), 0))::bigint as total_tokens, max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000) as duration_ms
  from d group by user_id""")
def q56_metrics_of_files(spark, sf_dir):
    logs = open_logs(spark, f"{write_logs(spark, sf_dir)}/*/*.jsonl", persist=False)
    rows = logs.metrics().join(logs.metadata().select("session_key", "session_id"), "session_key")
    return rows.select(_user().alias("user_id"), "session_id", "message_count", "total_tokens", "duration_ms")


@query(f"with {_FILES} select user_id, line_no, 'u' || event_id as uuid from ev")
def q57_line_numbers(spark, sf_dir):
    rows = jsonl.read_entries(spark, f"{write_logs(spark, sf_dir)}/*/*.jsonl")
    return rows.select(_user().alias("user_id"), "line_no", "uuid")


@query(f"""with {_FILES}, h as (select user_id, event_id, ts from n where event_id % 19 > 0 qualify row_number() over (partition by user_id order by event_id) <= 200),
 t as (select user_id, arg_min(strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ'), event_id) as first_timestamp from h where event_id % 17 > 0 group by user_id)
 select 'p' || (u.user_id % 5) as project, u.user_id, 's' || u.user_id as session_id, t.first_timestamp from (select distinct user_id from n) u left join t using (user_id)""")
def q58_find_all_sessions(spark, sf_dir):
    found = discovery.find_all_sessions(spark, write_logs(spark, sf_dir))
    return found.select("project", _user().alias("user_id"), "session_id", "first_timestamp")


@query("select 'p' || (user_id % 5) as project, count(distinct user_id) as session_count from events group by 1")
def q59_list_projects(spark, sf_dir):
    return discovery.list_projects(spark, write_logs(spark, sf_dir)).select("project", "session_count")


@query(f"""with {_FILES}, f as (select *, event_id % 19 > 0 and event_id % 17 > 0 as good from n where line_no = 0)
 select user_id, 'string:s' || user_id as first_session_id from f where good""")
def q60_first_lines(spark, sf_dir):
    return jsonl.first_lines(spark, f"{write_logs(spark, sf_dir)}/*/*.jsonl").select(_user().alias("user_id"), "first_session_id")


@query(f"""with {_PATHS}
 select (select count(distinct user_id) from events) as sessions, 0::bigint as subagents, (select count(*) from ev) as entries, (select count(distinct path) from seen) as paths, 0::bigint as drift, 0::bigint as errors, 0::bigint as exit_code""")
def q61_audit_report(spark, sf_dir):
    from logweave.plans import audit as command

    root = write_logs(spark, sf_dir)
    _, found = command.run(spark, root)
    report, _ = command.run(spark, root, found)
    numbers = (report.sessions, report.subagents, report.entries, report.paths, report.drift, sum(report.errors_by_method.values()), report.exit_code)
    return spark.createDataFrame([numbers], ", ".join(f"{n} bigint" for n in "sessions subagents entries paths drift errors exit_code".split()))


_BAD = """x as (select event_id, user_id::varchar as session_key, event_type as t, json_extract_string(props, '$.k')::bigint as k from events), m as (
 select *, unnest(['metrics', 'compaction']) as method from x where t = 'click' and (k % 6 = 0 or k % 9 = 0) union all select *, unnest(['toolCalls', 'isOngoing']) from x where t = 'click' and (k % 5 = 0 or k % 9 = 0)
 union all select *, 'toolResults' from x where t = 'view' and k % 9 = 0 union all select *, 'firstUserMessage' from x where t = 'view' and (k % 5 = 0 or k % 9 = 0)
 union all select *, unnest(['skills', 'deferredTools']) from x where t = 'error' and k % 4 > 0 union all select *, 'fileHistory' from x where t = 'purchase' and k % 4 = 0)"""


@query(f"with {_BAD} select session_key, event_id as line_no, method from m order by session_key, line_no, method limit 50")
def q62_first_errors(spark, sf_dir):
    lines = A.event_log_lines(A.events(jsonl.configure(spark), sf_dir))
    return audit.first_errors(ops.malformed(jsonl.canonical(lines)), 50)


def _task_files(spark: SparkSession, sf_dir: str) -> str:
    """A task per supplier, in its nation's folder; every fifth is malformed."""
    k = F.col("s_suppkey")
    text = A.json_text('{"id":"', k, '","subject":"', F.col("s_name"), '","description":"","status":"', F.when(k % 2 == 0, "pending").otherwise("completed"), '","blocks":[],"blockedBy":["1"]', F.when(k % 5 == 0, "").otherwise("}"))
    rows = A.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("session_id"), k.cast("string").alias("name"), text.alias("value"))
    return write_store(spark, rows, ".json")


@query("select s_nationkey::varchar as session_id, s_suppkey::varchar as id, s_name as subject, case when s_suppkey % 2 = 0 then 'pending' else 'completed' end as status from supplier where s_suppkey % 5 > 0")
def q63_task_store(spark, sf_dir):
    return tasks.read_tasks(spark, _task_files(spark, sf_dir)).select("session_id", "id", "subject", "status")


@query("select distinct s_nationkey::varchar as session_id from supplier")
def q64_task_sessions(spark, sf_dir):
    return tasks.list_task_sessions(spark, _task_files(spark, sf_dir))


@query("select s_nationkey::varchar as session_id, s_suppkey::varchar as id, s_name as subject from supplier where s_suppkey = 1")
def q65_task_point_read(spark, sf_dir):
    nation = A.table(spark, sf_dir, "supplier").where("s_suppkey = 1").first()["s_nationkey"]
    return tasks.read_task(spark, str(nation), "1", _task_files(spark, sf_dir)).select("session_id", "id", "subject")


def _blob_files(spark: SparkSession, sf_dir: str) -> str:
    """A blob per supplier, in its nation's folder."""
    name = F.concat(F.lit("h"), F.col("s_suppkey").cast("string"), F.lit("@v1"))
    rows = A.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("session_id"), name.alias("name"), F.col("s_name").alias("value"))
    return write_store(spark, rows, "")


@query("select s_nationkey::varchar as session_id, 'h' || s_suppkey || '@v1' as backup_file_name, (length(s_name) + 1)::bigint as size from supplier")
def q66_blob_listing(spark, sf_dir):
    return file_history.list_blobs(spark, _blob_files(spark, sf_dir)).select("session_id", "backup_file_name", "size")


@query("""select n_nationkey::varchar as session_id, v.k as version, s_name || chr(10) as content from nation cross join (select unnest([1, 2, 3]) as k) v
 left join supplier on s_nationkey = n_nationkey and s_suppkey = v.k""")
def q67_blob_read(spark, sf_dir):
    base = _blob_files(spark, sf_dir)
    key = F.col("n_nationkey").cast("string")
    wanted = A.table(spark, sf_dir, "nation").select(key.alias("session_key"), key.alias("session_id"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("version"))
    versions = wanted.withColumn("backup_file_name", F.concat(F.lit("h"), F.col("version").cast("string"), F.lit("@v1"))).drop("session_id")
    joined = file_history.file_history(versions, wanted.select("session_key", "session_id").distinct(), file_history.list_blobs(spark, base))
    return file_history.read_blobs(spark, joined, base).select("session_id", "version", "content")


@query("select n_name as project, (row_number() over (order by n_name))::int as place from nation")
def q68_projects_by_name(spark, sf_dir):
    names = A.table(spark, sf_dir, "nation").select(F.col("n_name").alias("project"))
    return names.select("project", F.row_number().over(Window.orderBy(discovery.by_name("project"), "project")).alias("place"))


@query(f"with {_PATHS}, i as (select path, array_to_string(list_sort(list_distinct(list(kind))), ',') as kinds from seen group by path) select path, kinds, (row_number() over (order by path))::int as place from i")
def q69_sorted_inventory(spark, sf_dir):
    listed = audit.sorted_inventory(audit.inventory(audit.entry_seeds(jsonl.parsed(event_lines(spark, sf_dir)))))
    return listed.select("path", F.array_join("kinds", ",").alias("kinds"), F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).alias("place"))
