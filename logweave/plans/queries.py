"""The registered queries: every operator on the driver's tables, beside an independent SQL form of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.functions.scalars import epoch_ms, strict_json, trim_all
from logweave.operators import audit, derive
from logweave.operators import entries as ops
from logweave.plans import adapters as A
from logweave.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from logweave.sources import discovery, file_history, jsonl, persisted, tasks

# What the adapters do, in SQL.
E = """
ev as (select *, json_extract_string(props, '$.k')::bigint as k from events),
e as (select user_id::varchar as session_key, event_id as line_no, user_id, event_id, event_type, k, ts,
  case when event_type = 'click' then 'assistant' when event_type in ('view', 'signup') then 'user' when event_type = 'error' then 'attachment' else 'system' end as type,
  case when event_type = 'click' then (k % 10)::varchar end as request_key, k % 11 = 0 as is_sidechain, case when k % 13 = 0 then '<synthetic>' else 'm' end as model,
  event_type = 'signup' as is_compact, case when event_type = 'click' then floor(value)::bigint end as input_tokens, case when event_type = 'click' then k % 7 end as output_tokens,
  case when event_type = 'click' then k end as cache_read_tokens, epoch_us(ts) // 1000 as ts_ms, strftime(ts, '%Y-%m-%dT%H:%M:%S') as timestamp,
  case when k % 3 = 0 then '' when k % 3 = 1 then 's' || user_id end as session_id, case when k % 4 = 0 then 'v' || (k % 9) end as version,
  case when k % 5 = 0 then 'b' || (k % 8) end as git_branch, case when k % 6 = 0 then '' end as cwd, case when k % 2 = 0 then 'p' || (k % 5) end as permission_mode from ev),
d as (select * from e qualify request_key is null or line_no = max(line_no) over (partition by session_key, request_key))
"""
TRIMMED = r"regexp_replace({x}, '^[\s\p{{Z}}\x{{FEFF}}\x0B]+|[\s\p{{Z}}\x{{FEFF}}\x0B]+$', '', 'g')"


def entries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.event_entries(jsonl.configure(spark), sf_dir)


def deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.deduplicate(entries_of(spark, sf_dir))


def sessions_of(rows: DataFrame) -> DataFrame:
    return rows.select("session_key").distinct()


@query(f"with {E} select session_key, line_no, type, request_key, ts_ms, timestamp from e")
def q01_scan_entries(spark, sf_dir):
    return entries_of(spark, sf_dir).select("session_key", "line_no", "type", "request_key", "ts_ms", "timestamp")


@query(f"with {E} select type, count(*) as n from e where type in ('user', 'assistant', 'attachment', 'system') group by type")
def q02_type_guard_counts(spark, sf_dir):
    return entries_of(spark, sf_dir).where(F.col("type").isin(ops.ENTRY_TYPES)).groupBy("type").agg(F.count("*").alias("n"))


@query(f"with {E} select session_key, line_no, type, request_key from d")
def q03_dedupe_keep_last(spark, sf_dir):
    return deduped(spark, sf_dir).select("session_key", "line_no", "type", "request_key")


@query(f"""with {E} select session_key, coalesce(sum(input_tokens), 0)::bigint as input_tokens, coalesce(sum(output_tokens), 0)::bigint as output_tokens,
  coalesce(sum(cache_read_tokens), 0)::bigint as cache_read_tokens, 0::bigint as cache_creation_tokens,
  (coalesce(sum(input_tokens), 0) + coalesce(sum(output_tokens), 0) + coalesce(sum(cache_read_tokens), 0))::bigint as total_tokens,
  max(ts_ms) - min(ts_ms) as duration_ms, count(*) as message_count from d group by session_key""")
def q04_metrics(spark, sf_dir):
    return derive.metrics(deduped(spark, sf_dir))


_OBSERVED = ", ".join(f"coalesce(arg_min({x}, line_no) filter ({x} <> ''), max({x})) as {n}" for n, x in (("session_id", "session_id"), ("version", "version"), ("git_branch", "git_branch"), ("cwd", "cwd"), ("permission_mode", "case when type = 'permission-mode' then permission_mode end")))


@query(f"with {E}, m as (select * replace (case when event_type = 'purchase' then 'permission-mode' else type end as type) from d) select session_key, {_OBSERVED} from m group by session_key")
def q05_first_observed(spark, sf_dir):
    rows = deduped(spark, sf_dir).withColumn("type", F.when(F.col("event_type") == "purchase", "permission-mode").otherwise(F.col("type")))
    return derive.first_observed(rows)


_C = "c as (select conv_id::varchar as session_key, turn as line_no, role as type, text, conv_id || '-' || turn as timestamp, conv_id, turn from conversations)"
_FIRST = f"""t as (select session_key, line_no, {TRIMMED.format(x="text")} as text, timestamp from {{source}} where type = 'user'),
 u as (select * from t where text <> '' and not (starts_with(text, '<local-command-stdout>') or starts_with(text, '<local-command-caveat>') or starts_with(text, '<system-reminder>') or starts_with(text, '[Request interrupted'))),
 v as (select *, regexp_matches(text, '<command-name>/([^<]+)</command-name>') as cmd from u)
 select session_key, case when cmd then '/' || regexp_extract(text, '<command-name>/([^<]+)</command-name>', 1) else left(text, 500) end as text, timestamp
 from v qualify row_number() over (partition by session_key order by cmd, line_no) = 1"""


@query(f"with {_C}, {_FIRST.replace('{source}', 'c')}")
def q06_first_user_message(spark, sf_dir):
    return derive.first_user_message(A.conversation_entries(spark, sf_dir))


@query(f"""with {_C}, w as (select * replace (case when turn % 4 = 0 or conv_id % 7 = 0 then ' <command-name>/c' || (turn % 3) || '</command-name> ' || text when turn % 4 = 1 then '<system-reminder>' || text
  when turn % 4 = 2 then chr(160) || ' ' || text else '[Request interrupted by user]' end as text) from c), {_FIRST.replace('{source}', 'w')}""")
def q07_first_message_command_fallback(spark, sf_dir):
    turn = F.col("turn") % 4
    text = (
        F.when((turn == 0) | (F.col("conv_id") % 7 == 0), F.concat(F.lit(" <command-name>/c"), (F.col("turn") % 3).cast("string"), F.lit("</command-name> "), F.col("text")))
        .when(turn == 1, F.concat(F.lit("<system-reminder>"), F.col("text")))
        .when(turn == 2, F.concat(F.lit("  "), F.col("text")))
        .otherwise("[Request interrupted by user]")
    )
    return derive.first_user_message(A.conversation_entries(spark, sf_dir).withColumn("text", text))


@query(f"""with {E}, a as (select session_key, line_no, case when event_type = 'click' and k % 5 < 2 then false else true end as still from e where event_type in ('click', 'view'))
 select s.session_key, coalesce(x.still, false) as is_ongoing from (select distinct session_key from e) s
 left join (select session_key, arg_max(still, line_no) as still from a group by session_key) x using (session_key)""")
def q08_ongoing(spark, sf_dir):
    rows = entries_of(spark, sf_dir)
    activity = A.event_activity(rows).withColumn("kind", F.when(F.col("kind") == "shutdown", "ending").otherwise(F.col("kind")))
    return derive.ongoing(activity, sessions_of(rows))


@query(f"""with {E}, a as (select session_key, line_no, event_type, k % 5 as r, k % 20 as id from e where event_type in ('click', 'view')),
 b as (select *, exists (select 1 from a s where s.event_type = 'click' and s.r = 1 and s.session_key = a.session_key and s.id = a.id and s.line_no < a.line_no) as shut from a),
 l as (select *, row_number() over (partition by session_key order by line_no desc) as rn from b)
 select s.session_key, coalesce(case when event_type = 'click' then r > 1 else not shut end, false) as is_ongoing
 from (select distinct session_key from e) s left join l on l.session_key = s.session_key and rn = 1""")
def q09_ongoing_shutdown_ids(spark, sf_dir):
    rows = entries_of(spark, sf_dir)
    return derive.ongoing(A.event_activity(rows), sessions_of(rows))


_PHASES = f"""{E}, x as (select session_key, line_no, case when type = 'assistant' and not is_sidechain and model <> '<synthetic>' and input_tokens + cache_read_tokens > 0 then input_tokens + cache_read_tokens end as tok, is_compact from d),
 mark as (select session_key, line_no as m, row_number() over (partition by session_key order by line_no) as i, lead(line_no) over (partition by session_key order by line_no) as nxt from x where is_compact),
 cnt as (select session_key, count(*) filter (is_compact) as n, max(tok) as anytok, arg_max(tok, line_no) filter (tok is not null) as latest from x group by session_key),
 pre as (select m.session_key, i, coalesce((select arg_max(tok, line_no) from x where x.session_key = m.session_key and tok is not null and line_no < m.m), 0) as pre,
   coalesce((select arg_min(tok, line_no) from x where x.session_key = m.session_key and tok is not null and line_no > m.m and (m.nxt is null or line_no < m.nxt)), 0) as post from mark m),
 lagged as (select *, lag(post) over (partition by session_key order by i) as before from pre),
 phases as (
  select l.session_key, n as compaction_count, i as phase_number, pre - coalesce(before, 0) as contribution, pre as peak_tokens, post as post_compaction from lagged l join cnt using (session_key) where anytok is not null
  union all select c.session_key, n, n + 1, latest - coalesce(p.post, 0), latest, null from cnt c left join pre p on p.session_key = c.session_key and p.i = n where anytok is not null and (n = 0 or p.post > 0))"""


@query(f"with {_PHASES} select session_key, compaction_count::bigint as compaction_count, phase_number::bigint as phase_number, contribution::bigint as contribution, peak_tokens::bigint as peak_tokens, post_compaction::bigint as post_compaction from phases")
def q10_compaction_phases(spark, sf_dir):
    return derive.compaction_phases(deduped(spark, sf_dir))


@query(f"""with {_PHASES} select c.session_key, c.n::bigint as compaction_count, coalesce(p.k, 0)::bigint as n_phases, p.s::bigint as context_consumption from cnt c
 left join (select session_key, count(*) as k, sum(contribution) as s from phases group by session_key) p using (session_key)""")
def q11_compaction_summary(spark, sf_dir):
    return derive.compaction(deduped(spark, sf_dir))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.blocks(A.event_blocks(entries_of(spark, sf_dir)))


def _calls_results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _blocks(spark, sf_dir)
    return ops.tool_calls(rows), ops.tool_results(rows)


_TOOLS = f"""{E}, calls as (select session_key, line_no, 't' || k as tool_id, case k % 4 when 0 then 'Agent' when 1 then 'Task' else 'Bash' end as name, k % 4 < 2 as is_task from e where event_type = 'click'),
 results as (select session_key, line_no, 't' || k as tool_use_id, k % 3 = 0 as is_error from e where event_type = 'view')"""


@query(f"with {_TOOLS} select session_key, line_no, tool_id, name, is_task from calls")
def q12_tool_calls(spark, sf_dir):
    return _calls_results(spark, sf_dir)[0].select("session_key", "line_no", "tool_id", "name", "is_task")


@query(f"with {_TOOLS} select session_key, line_no, tool_use_id, is_error from results")
def q13_tool_results(spark, sf_dir):
    return _calls_results(spark, sf_dir)[1].select("session_key", "line_no", "tool_use_id", "is_error")


@query(f"with {_TOOLS} select c.session_key, c.line_no, c.tool_id, r.line_no as result_line_no, r.is_error from calls c left join results r on r.session_key = c.session_key and r.tool_use_id = c.tool_id")
def q14_call_result_join(spark, sf_dir):
    return ops.calls_with_results(*_calls_results(spark, sf_dir)).select("session_key", "line_no", "tool_id", "result_line_no", "is_error")


@query(f"with {_TOOLS} select session_key, line_no, tool_id from calls c where not exists (select 1 from results r where r.session_key = c.session_key and r.tool_use_id = c.tool_id)")
def q15_pending_calls(spark, sf_dir):
    return ops.calls_with_results(*_calls_results(spark, sf_dir), how="left_anti").select("session_key", "line_no", "tool_id")


@query(f"with {_TOOLS} select session_key, line_no, tool_use_id from results r where not exists (select 1 from calls c where r.session_key = c.session_key and r.tool_use_id = c.tool_id)")
def q16_orphan_results(spark, sf_dir):
    calls, results = _calls_results(spark, sf_dir)
    return ops.orphan_results(results, calls).select("session_key", "line_no", "tool_use_id")


@query(f"with {_TOOLS} select session_key, line_no, tool_id from calls c where exists (select 1 from results r where r.session_key = c.session_key and r.tool_use_id = c.tool_id)")
def q17_answered_calls(spark, sf_dir):
    return ops.calls_with_results(*_calls_results(spark, sf_dir), how="left_semi").select("session_key", "line_no", "tool_id")


@query(f"with {_TOOLS} select session_key, line_no, name from calls where tool_id = 't42' order by session_key, line_no limit 1")
def q18_find_tool_call(spark, sf_dir):
    return ops.find_first(_calls_results(spark, sf_dir)[0], "tool_id", "t42").select("session_key", "line_no", "name")


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(F.lit("intro\n- "), F.col("source"), F.lit(":"), F.col("lang"), F.lit(": d "), F.col("text"), F.lit("\n-x\n- none\n- "), F.col("lang"), F.lit(" : y\n- : z"))
    return A.table(spark, sf_dir, "documents").select(F.col("source").alias("session_key"), F.col("doc_id").alias("line_no"), content.alias("content"))


def _skill_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.skills(_listings(spark, sf_dir)).select("session_key", F.posexplode("names").alias("pos", "name"))


_SKILLS = rf"""l as (select source as session_key, doc_id, 'intro' || chr(10) || '- ' || source || ':' || lang || ': d ' || text || chr(10) || '-x' || chr(10) || '- none' || chr(10) || '- ' || lang || ' : y' || chr(10) || '- : z' as content
  from documents qualify row_number() over (partition by source order by doc_id) = 1),
 n as (select session_key, list_transform(list_filter(list_transform(list_filter(string_split(content, chr(10)), lambda x: starts_with(x, '- ')), lambda x: substr(x, 3)), lambda x: instr(x, ': ') > 1), lambda x: {TRIMMED.format(x="substr(x, 1, instr(x, ': ') - 1)")}) as names from l),
 s as (select session_key, unnest(names) as name, generate_subscripts(names, 1) - 1 as pos from n)"""


@query(f"with {_SKILLS} select session_key, pos::int as pos, name from s")
def q19_skills(spark, sf_dir):
    return _skill_rows(spark, sf_dir)


@query(f"""with {E}, r as (select session_key, k % 10 as name, max(line_no) as gone from e where event_type = 'error' group by all),
 a as (select e.session_key, e.k % 10 as name, min(line_no) as p from e left join r on r.session_key = e.session_key and r.name = e.k % 10 where event_type = 'click' and line_no > coalesce(gone, -1) group by all)
 select session_key, (row_number() over (partition by session_key order by p) - 1)::int as pos, 'n' || name as name from a""")
def q20_deferred_tools(spark, sf_dir):
    name = F.array(F.concat(F.lit("n"), (F.col("k") % 10).cast("string")))
    none = F.array().cast("array<string>")
    rows = entries_of(spark, sf_dir).where(F.col("event_type").isin("click", "error"))
    deltas = rows.select("session_key", "line_no", F.when(F.col("event_type") == "click", name).otherwise(none).alias("added"), F.when(F.col("event_type") == "error", name).otherwise(none).alias("removed"))
    return derive.deferred_tools(deltas).select("session_key", F.posexplode("names").alias("pos", "name"))


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    rows = entries_of(spark, sf_dir).select("session_key", "line_no", F.concat(F.lit("f"), (k % 7).cast("string")).alias("file_path"), (k % 3).alias("version"), F.col("timestamp").alias("backup_time"), F.when(k % 4 > 0, F.concat(F.lit("h"), k.cast("string"), F.lit("@v"), (k % 3).cast("string"))).alias("backup_file_name"))
    return file_history.latest_versions(rows)


_VERSIONS = f"""{E}, f as (select session_key, 'f' || (k % 7) as file_path, k % 3 as version, timestamp as backup_time, case when k % 4 > 0 then 'h' || k || '@v' || (k % 3) end as backup_file_name from e
  qualify row_number() over (partition by session_key, k % 7, k % 3 order by line_no desc) = 1)"""


@query(f"with {_VERSIONS} select session_key, file_path, version, backup_time, backup_file_name from f")
def q21_file_history_latest(spark, sf_dir):
    return _versions(spark, sf_dir)


def _blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    name = F.concat(F.lit("h"), (p % 100).cast("string"), F.lit("@v"), ((p % 100) % 3).cast("string"))
    rows = A.table(spark, sf_dir, "part").select((p % 97).cast("string").alias("session_id"), name.alias("backup_file_name"), p.alias("size"))
    return rows.groupBy("session_id", "backup_file_name").agg(F.max("size").alias("size")).withColumn("blob_path", F.concat_ws("/", "session_id", "backup_file_name"))


_BLOBS = "b as (select (p_partkey % 97)::varchar as session_id, 'h' || (p_partkey % 100) || '@v' || ((p_partkey % 100) % 3) as backup_file_name, max(p_partkey) as size from part group by all)"


@query(f"with {_VERSIONS}, {_BLOBS} select f.session_key, file_path, version, f.backup_file_name, case when b.size is not null then b.session_id || '/' || b.backup_file_name end as blob_path, b.size from f left join b on b.session_id = f.session_key and b.backup_file_name = f.backup_file_name")
def q22_file_history_blob_join(spark, sf_dir):
    versions = _versions(spark, sf_dir)
    sessions = versions.select("session_key").distinct().withColumn("session_id", F.col("session_key"))
    return file_history.file_history(versions, sessions, _blobs(spark, sf_dir)).select("session_key", "file_path", "version", "backup_file_name", "blob_path", "size")


@query(f"with {_VERSIONS}, {_BLOBS} select session_id, backup_file_name, size from b where not exists (select 1 from f where f.session_key = b.session_id and f.backup_file_name = b.backup_file_name)")
def q23_orphan_blobs(spark, sf_dir):
    return file_history.orphan_blobs(_blobs(spark, sf_dir), _versions(spark, sf_dir).withColumnRenamed("session_key", "session_id")).select("session_id", "backup_file_name", "size")


@query(f"with {_VERSIONS} select session_key, file_path, version, lag(version) over w as previous_version, lag(backup_file_name) over w as previous_backup from f window w as (partition by session_key, file_path order by version)")
def q24_version_pairs(spark, sf_dir):
    return file_history.version_pairs(_versions(spark, sf_dir)).select("session_key", "file_path", "version", "previous_version", "previous_backup")


def _wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    tail = F.when(i % 3 == 0, "\n</persisted-output> \n").otherwise(" \t")
    text = F.concat(F.lit("<persisted-output>\nOutput too large ("), F.col("n_chars").cast("string"), F.lit("B). Full output saved to: /tmp/"), i.cast("string"), F.when(i % 2 == 0, ".json").otherwise(".txt"), F.lit("\n\nPreview (first 2KB):\n"), F.col("text"), tail)
    return A.table(spark, sf_dir, "documents").select("doc_id", F.when(i % 5 == 0, F.concat(F.lit(" "), text)).otherwise(text).alias("content"))


_REFS = rf"""r as (select doc_id, n_chars || 'B' as size_label, '/tmp/' || doc_id || case when doc_id % 2 = 0 then '.json' else '.txt' end as file_path,
  regexp_replace(case when doc_id % 3 = 0 then text else text || ' ' || chr(9) end, '[\s\p{{Z}}\x{{FEFF}}\x0B]+$', '') as preview from documents where doc_id % 5 > 0)"""


@query(f"with {_REFS} select doc_id, size_label, file_path, preview from r")
def q25_persisted_output_parse(spark, sf_dir):
    return persisted.parse_persisted(_wrapped(spark, sf_dir))


@query(f"with {_REFS} select r.doc_id, r.file_path, d.doc_id is not null as found, length(d.text) as n from r left join labels b on b.doc_id = r.doc_id left join documents d on d.doc_id = b.doc_id")
def q26_persisted_output_load(spark, sf_dir):
    # only labelled documents have been spilled
    docs = A.table(spark, sf_dir, "documents").join(A.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    files = docs.select(F.concat(F.lit("/tmp/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".json").otherwise(".txt")).alias("file_path"), "text")
    loaded = persisted.load_persisted(persisted.parse_persisted(_wrapped(spark, sf_dir)), files)
    return loaded.select("doc_id", "file_path", "found", F.length("text").cast("bigint").alias("n"))


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "completed").otherwise("archived")
    text = A.json_text(
        '{"id":', F.when(o % 7 == 0, o.cast("string")).when(o % 4 == 0, F.concat(F.lit('"x'), o.cast("string"), F.lit('"'))).otherwise(F.concat(F.lit('"'), o.cast("string"), F.lit('"'))),
        ',"subject":"s', o % 10, '","description":"","status":"', status, '","blocks":[', F.when(o % 11 == 0, F.lit("1")).when(o % 2 == 0, F.lit('"a","b"')).otherwise(F.lit("")),
        '],"blockedBy":', F.when(o % 13 == 0, F.lit("{}")).otherwise(F.lit("[]")), F.when(o % 3 == 0, F.lit(',"owner":5')).otherwise(F.lit(',"owner":"me"')),
        ',"metadata":', F.when(o % 5 == 0, F.lit("[1]")).otherwise(F.lit('{"m":1}')), "}",
    )
    return tasks.valid_tasks(A.table(jsonl.configure(spark), sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("session_id"), o.cast("string").alias("file_stem"), strict_json(text).alias("raw")))


_TASKS = """t as (select o_custkey::varchar as session_id, case when o_orderkey % 4 = 0 then 'x' else '' end || o_orderkey as id, 's' || (o_orderkey % 10) as subject,
  case o_orderstatus when 'O' then 'pending' else 'completed' end as status, case when o_orderkey % 2 = 0 then 2 else 0 end as n_blocks, case when o_orderkey % 3 > 0 then 'me' end as owner, o_orderkey % 5 > 0 as has_metadata
  from orders where o_orderstatus in ('O', 'F') and o_orderkey % 7 > 0 and o_orderkey % 11 > 0 and o_orderkey % 13 > 0)"""


@query(f"with {_TASKS} select session_id, id, subject, status, n_blocks, owner, has_metadata from t")
def q27_task_validate(spark, sf_dir):
    return _tasks(spark, sf_dir).select("session_id", "id", "subject", "status", F.size("blocks").alias("n_blocks"), "owner", F.col("metadata").isNotNull().alias("has_metadata"))


@query(f"with {_TASKS} select session_id, id, (row_number() over (partition by session_id order by try_cast(id as double) nulls last, id))::int as place from t")
def q28_task_sort(spark, sf_dir):
    return _tasks(spark, sf_dir).select("session_id", "id", F.row_number().over(Window.partitionBy("session_id").orderBy(*tasks.task_order())).alias("place"))


@query(f"with {_TASKS} select c.c_custkey::varchar as session_id, t.id, t.status from customer c left join t on t.session_id = c.c_custkey::varchar")
def q29_session_tasks(spark, sf_dir):
    sessions = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("session_id"))
    return tasks.session_tasks(sessions, _tasks(spark, sf_dir)).select("session_id", "id", "status")


@query("with p as (select n_name as project from nation union all select r_name from region) select project, count(c_custkey) as session_count from p left join nation on n_name = project left join customer on c_nationkey = n_nationkey group by project")
def q30_list_projects(spark, sf_dir):
    nation, region = A.table(spark, sf_dir, "nation"), A.table(spark, sf_dir, "region")
    files = A.table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("project"), F.col("c_custkey").alias("session_key"))
    projects = nation.select(F.col("n_name").alias("project")).union(region.select("r_name"))  # no session is in a region
    return discovery.count_sessions(projects, files)


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("session_key").orderBy("line_no")
    rows = entries_of(spark, sf_dir).withColumn("nonblank_no", F.row_number().over(order)).withColumn("text", F.concat(F.lit(" text "), F.col("k").cast("string")))
    files = sessions_of(rows).select("session_key", F.concat(F.lit("p"), (F.col("session_key").cast("bigint") % 5).cast("string")).alias("project"))
    stamped = rows.withColumn("timestamp", F.when(F.col("k") % 3 == 0, "").when(F.col("k") % 3 == 1, F.col("timestamp")))
    return discovery.summaries(jsonl.head(stamped, discovery.HEAD_LINES), files)


_HEAD = f"""{E}, h as (select *, case when k % 3 = 0 then '' when k % 3 = 1 then timestamp end as stamp, 'text ' || k as text from e qualify row_number() over (partition by session_key order by line_no) <= 200),
 sums as (select session_key, 'p' || (session_key::bigint % 5) as project, {", ".join(f"coalesce(arg_min({x}, line_no) filter ({x} <> ''), max({x})) as {x}" for x in ("session_id", "version", "git_branch", "cwd"))},
  coalesce(arg_min(stamp, line_no) filter (stamp <> ''), max(stamp)) as first_timestamp, arg_max(stamp, line_no) filter (stamp is not null) as last_timestamp,
  arg_min(text, line_no) filter (type = 'user') as first_message from h group by session_key)"""


@query(f"with {_HEAD} select session_key, project, session_id, version, git_branch, cwd, first_timestamp, last_timestamp, first_message from sums")
def q31_list_sessions_head(spark, sf_dir):
    return _summaries(spark, sf_dir).select("session_key", "project", "session_id", "version", "git_branch", "cwd", "first_timestamp", "last_timestamp", "first_message")


@query(f"with {_HEAD} select project, session_key, first_timestamp, (row_number() over (partition by project order by nullif(first_timestamp, '') desc nulls last, session_key))::int as place from sums")
def q32_find_all_sessions(spark, sf_dir):
    order = Window.partitionBy("project").orderBy(*discovery.newest())
    return _summaries(spark, sf_dir).select("project", "session_key", "first_timestamp", F.row_number().over(order).alias("place"))


@query("""with p as (select '/p' || (c_custkey % 10) as folder, c_custkey from customer),
 n as (select p.folder || '/s' || c_custkey || '.jsonl' as parent_key, p.folder || '/s' || c_custkey || '/subagents/agent-' || o_orderkey || '.jsonl' as child_key, 'new' as layout from p join orders on o_custkey = c_custkey where o_orderkey % 3 = 0 and o_orderkey % 4 > 0),
 o as (select p.folder || '/s' || c_custkey || '.jsonl' as parent_key, p.folder || '/agent-' || o_orderkey || '.jsonl' as child_key, 'old' as layout from p join orders on o_custkey = c_custkey where o_orderkey % 3 > 0)
 select * from n union all select * from o""")
def q33_subagents_new_legacy(spark, sf_dir):
    folder = lambda c: F.concat(F.lit("/p"), (F.col(c) % 10).cast("string"))
    parent = F.concat(folder("c_custkey"), F.lit("/s"), F.col("c_custkey").cast("string"), F.lit(".jsonl"))
    parents = A.table(spark, sf_dir, "customer").select(parent.alias("session_key"), F.concat(F.lit("string:"), F.col("c_custkey").cast("string")).alias("first_session_id"))
    new = F.concat(folder("o_custkey"), F.lit("/s"), F.col("o_custkey").cast("string"), F.lit("/subagents"))
    key = F.concat(F.when(F.col("o_orderkey") % 3 == 0, new).otherwise(folder("o_custkey")), F.lit("/agent-"), F.col("o_orderkey").cast("string"), F.lit(".jsonl"))
    agents = A.table(spark, sf_dir, "orders").select(key.alias("session_key"), (F.col("o_orderkey") % 4).alias("size"), F.concat(F.lit("string:"), F.col("o_custkey").cast("string")).alias("first_session_id"))
    firsts = parents.union(agents.select("session_key", "first_session_id"))
    return discovery.subagent_files(parents, agents.select("session_key", "size"), firsts)


@query("""with c as (select 'c' || c_custkey as k, 'n' || c_nationkey as p, c_custkey % 100 as t from customer), n as (select 'n' || n_nationkey as k, 'r' || n_regionkey as p, n_nationkey as t from nation),
 ns as (select n.k, n.p, n.t + coalesce(sum(c.t), 0) as t, 1 + count(c.k) as s from n left join c on c.p = n.k group by n.k, n.p, n.t)
 select k as root_key, 1::bigint as n_sessions, t::bigint as tokens from c union all select k, s::bigint, t::bigint from ns
 union all select 'r' || r_regionkey, (1 + coalesce(sum(s), 0))::bigint, (1000 + coalesce(sum(t), 0))::bigint from region left join ns on ns.p = 'r' || r_regionkey group by r_regionkey""")
def q34_tree_totals(spark, sf_dir):
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    c, n, r = (A.table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    edges = c.select(key("n", "c_nationkey").alias("parent_key"), key("c", "c_custkey").alias("child_key")).union(n.select(key("r", "n_regionkey"), key("n", "n_nationkey")))
    totals = c.select(key("c", "c_custkey").alias("session_key"), (F.col("c_custkey") % 100).cast("bigint").alias("tokens")).union(n.select(key("n", "n_nationkey"), F.col("n_nationkey").cast("bigint"))).union(r.select(key("r", "r_regionkey"), F.lit(1000).cast("bigint")))
    return discovery.tree_totals(edges, totals)


_SEEN = """ev as (select *, json_extract_string(props, '$.k')::bigint as k, 'entry[' || event_type || ']' as p, event_id % 2 = 1 as odd from events),
 seen as (select p as path, 'object' as kind, odd from ev union all select p || '.type', 'string', odd from ev union all select p || '.user', 'object', odd from ev union all select p || '.user.id', 'number', odd from ev
  union all select p || '.tags', 'array', odd from ev union all select p || '.tags[]', unnest(['number', 'string', 'null']), odd from ev
  union all select p || '.opt', case when k % 3 = 0 then 'boolean' else 'string' end, odd from ev where k % 3 < 2
  union all select p || x[1], x[2], odd from (select *, unnest([['.extra', 'object'], ['.extra.deep', 'array'], ['.extra.deep[]', 'object'], ['.extra.deep[]', 'null'], ['.extra.deep[].n', 'number']]) as x from ev where odd and k % 10 = 0)
  union all select p || '.old', 'null', odd from ev where not odd and k % 10 = 0 union all select p || '.size', case when odd and k % 7 = 0 then 'string' else 'number' end, odd from ev)"""


def _inventory(spark: SparkSession, sf_dir: str, odd: bool | None = None) -> DataFrame:
    rows = A.events(jsonl.configure(spark), sf_dir)
    if odd is not None:
        rows = rows.where(F.col("event_id") % 2 == int(odd))
    return audit.inventory(audit.entry_seeds(A.event_json(rows)))


def _differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.compare(_inventory(spark, sf_dir, False), _inventory(spark, sf_dir, True))


@query(f"with {_SEEN} select path, array_to_string(list_sort(list_distinct(list(kind))), ',') as kinds from seen group by path")
def q35_inventory(spark, sf_dir):
    return _inventory(spark, sf_dir).select("path", F.array_join("kinds", ",").alias("kinds"))


@query(f"with {_SEEN} select distinct path from seen where odd and path not in (select path from seen where not odd)")
def q36_new_paths(spark, sf_dir):
    return _differences(spark, sf_dir).where("status = 'new'").select("path")


@query(f"with {_SEEN} select distinct path from seen where not odd and path not in (select path from seen where odd)")
def q37_removed_paths(spark, sf_dir):
    return _differences(spark, sf_dir).where("status = 'removed'").select("path")


_NEW_TYPES = "select distinct path, kind from seen where odd and path in (select path from seen where not odd) and (path, kind) not in (select (path, kind) from seen where not odd)"


@query(f"with {_SEEN}, x as ({_NEW_TYPES}) select path, string_agg(kind, ',' order by kind) as kinds from x group by path")
def q38_new_types(spark, sf_dir):
    return _differences(spark, sf_dir).where("status = 'new_types'").select("path", F.array_join("kinds", ",").alias("kinds"))


@query(f"with {_SEEN}, x as ({_NEW_TYPES}) select ((select count(distinct path) from x) + (select count(distinct path) from seen where odd and path not in (select path from seen where not odd)))::bigint as drift")
def q39_drift_count(spark, sf_dir):
    return audit.drift_count(_differences(spark, sf_dir))


@query(f"with {_SKILLS} select session_key, name from s where not exists (select 1 from documents d join labels b on b.doc_id = d.doc_id where b.toxic = 1 and d.source = s.session_key and d.lang = s.name)")
def q40_skills_unused(spark, sf_dir):
    toxic = A.table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    used = A.table(spark, sf_dir, "documents").join(toxic, "doc_id").select(F.col("source").alias("session_key"), F.col("lang").alias("name"))
    return derive.unused_skills(derive.skills(_listings(spark, sf_dir)), used)


@query(f"with x as (select doc_id, chr(65279) || chr(9) || ' ' || text || chr(160) || chr(8232) || chr(11) as s from documents) select doc_id, md5({TRIMMED.format(x='s')}) as digest from x")
def q41_js_trim(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", F.md5(trim_all(F.concat(F.lit("﻿\t "), F.col("text"), F.lit("  \u000b"))).cast("binary")).alias("digest"))


_JSON_CASES = ['{"a":1}', '{"a":1} x', '{"a":1},{"b":2}', "[1,2]", "{'a':1}", '{"a":01}', '"s"', "nul", '{"a":1}] {x}', "12", '{"a":[1,2,{"b":null}]}', "{}"]


@query("with x as (select event_id, case (event_id % 12) " + " ".join("when {} then '{}'".format(k, t.replace("'", "''")) for k, t in enumerate(_JSON_CASES)) + " end as s from events) select event_id, json_valid(s) as valid from x")
def q42_strict_json(spark, sf_dir):
    text = F.element_at(F.array(*(F.lit(t) for t in _JSON_CASES)), (F.col("event_id") % 12 + 1).cast("int"))
    return A.table(jsonl.configure(spark), sf_dir, "events").select("event_id", strict_json(text).isNotNull().alias("valid"))


@query("select event_id, case when event_id % 5 < 4 then epoch_ms(ts - case when event_id % 5 = 1 then interval 2 hour else interval 0 hour end) end as ms from (select event_id, date_trunc('second', ts) as ts from events)")
def q43_date_parse(spark, sf_dir):
    i = F.col("event_id") % 5
    plain = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(i == 0, F.concat(plain, F.lit("Z"))).when(i == 1, F.concat(plain, F.lit("+02:00"))).when(i < 4, F.concat(plain, F.lit(".000Z"))).otherwise("t")
    return A.table(jsonl.configure(spark), sf_dir, "events").select("event_id", epoch_ms(text).alias("ms"))


@query("select count(distinct user_id) filter (user_id % 3 > 0) as sessions, count(distinct user_id) filter (user_id % 3 = 0) as subagents, count(*) as entries, (select sum(user_id * 10) from (select distinct user_id from events))::bigint as size from events")
def q44_audit_counters(spark, sf_dir):
    rows = A.events(spark, sf_dir).select(F.col("user_id").cast("string").alias("session_key"), (F.col("user_id") * 10).cast("bigint").alias("file_size"))
    return audit.counters(rows, F.col("session_key").cast("bigint") % 3 == 0)


@query("""with x as (select event_type as t, json_extract_string(props, '$.k')::bigint as k from events), m as (
 select 'metrics' as method from x where t = 'click' and (k % 6 = 0 or k % 9 = 0) union all select 'compaction' from x where t = 'click' and (k % 6 = 0 or k % 9 = 0)
 union all select unnest(['toolCalls', 'isOngoing']) from x where t = 'click' and (k % 5 = 0 or k % 9 = 0) union all select 'toolResults' from x where t = 'view' and k % 9 = 0
 union all select 'firstUserMessage' from x where t = 'view' and (k % 5 = 0 or k % 9 = 0) union all select unnest(['skills', 'deferredTools']) from x where t = 'error' and k % 4 > 0
 union all select 'fileHistory' from x where t = 'purchase' and k % 4 = 0) select method, count(*) as n from m group by method""")
def q45_errors_by_method(spark, sf_dir):
    lines = A.event_log_lines(A.events(jsonl.configure(spark), sf_dir))
    return audit.errors_by_method(ops.malformed(jsonl.canonical(lines)))
