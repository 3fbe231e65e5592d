"""Operator 7: mixing sources to target weights by temperature. DataFrame functions only.

1. Tokens are summed by (source, block), a block being one of 65,536 parts of a source by a hash of the ids:
   a source with a third of all rows is many groups, and each task sends on sums only.
2. From the sources' token shares p come weights w ~ p**a. The exponent a is bisected: the largest one whose
   weights have the target share of the highest entropy, raised as far as the limit of repetitions asks.
3. A source's budget is w times the whole budget: some whole passes, and a part of one more. That part takes
   the source's blocks in a permuted order until the budget is used up; in the block where that happens it
   takes documents in the order of their hashes. So the outcome is two thresholds per source, and every
   document is decided where it is read: one row per source is all that is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.common import columns_of, free_names, quoted, written

TARGET_ENTROPY = 0.97
MAX_REPETITION = 2.0
BISECTIONS = 50
BROADCAST_SOURCES = 100_000
SALTS = 32
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _keys(id_col: str, text_col: str, source_col: str) -> dict[str, Column]:
    """The source, token count, document key, block and block key that the decisions use, from a row's columns."""
    key = F.md5(F.concat_ws(":", F.lit(SEED), F.col(quoted(id_col)).cast("string")).cast("binary"))
    source = F.coalesce(F.concat(F.lit("="), F.col(quoted(source_col))), F.lit("null"))
    return {"source": source, "tokens": n_words(F.col(quoted(text_col))), "key": key}


def block_key(source: str, key: str) -> Column:
    return F.md5(F.concat_ws(":", F.col(source), F.substring(key, 1, 4)).cast("binary"))


def _bisect(holds) -> Column:
    """The largest x in [0, 1) for which ``holds(x)``, a condition that holds at 0 and up to some point."""
    steps = F.array(*(F.lit(2.0**-k) for k in range(1, BISECTIONS + 1)))
    return F.aggregate(steps, F.lit(0.0), lambda x, step: F.when(holds(x + step), x + step).otherwise(x))


def _entropy(sizes: Column, exponent: Column) -> Column:
    """Entropy of the weights p**a / S in one pass: ln S - a / S * sum of p**a ln p. Each size p stands for n sources."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("l"))

    def add(state: Column, x: Column) -> Column:
        return F.struct((state["s"] + x["n"] * F.pow(x["p"], exponent)).alias("s"), (state["l"] + x["n"] * F.pow(x["p"], exponent) * F.ln(x["p"])).alias("l"))

    return F.aggregate(sizes, start, add, lambda state: F.ln(state["s"]) - exponent * state["l"] / state["s"])


def _repetition(sizes: Column, exponent: Column) -> Column:
    """The most passes over a source when each source is passed over once at least: p**a / p, over its least."""
    rates = F.transform(sizes, lambda x: F.pow(x["p"], exponent - 1.0))
    return F.array_max(rates) / F.array_min(rates)


def source_plan(totals: DataFrame, target_entropy: float, max_repetition: float, budget_tokens: int | None) -> DataFrame:
    """(source, tokens, exponent, weight, budget) from (source, tokens).

    The exponent depends on how many sources there are of each size only. These sizes are gathered into one
    array: d of them need d (d + 1) / 2 tokens at least, so they are few however many sources there are.
    """
    sized = totals.where(F.col("tokens") > 0)
    by_size = sized.groupBy("tokens").agg(F.count("*").alias("n"))
    listed = by_size.agg(F.array_sort(F.collect_list(F.struct("tokens", "n"))).alias("c"), F.sum(F.col("tokens") * F.col("n")).cast("long").alias("whole"), F.sum("n").alias("sources"))
    shared = listed.select("whole", "sources", F.transform("c", lambda x: F.struct((x["tokens"] / F.col("whole")).alias("p"), x["n"].alias("n"))).alias("c"))
    goal = F.lit(target_entropy) * F.ln(F.col("sources"))
    by_entropy = _bisect(lambda x: _entropy(F.col("c"), x) >= goal)
    by_repetition = F.lit(1.0) - _bisect(lambda y: _repetition(F.col("c"), F.lit(1.0) - y) <= max_repetition)
    chosen = shared.select("whole", "c", F.greatest(by_entropy, by_repetition).alias("a"))
    summed = chosen.select("whole", "c", "a", F.aggregate("c", F.lit(0.0), lambda s, x: s + x["n"] * F.pow(x["p"], F.col("a"))).alias("sum"))
    # p / w = p ** (1 - a) * S: the budget that takes the source of the least passes once
    all_once = F.array_max(F.transform("c", lambda x: F.pow(x["p"], 1.0 - F.col("a")))) * F.col("sum") * F.col("whole")
    budget = all_once if budget_tokens is None else F.lit(float(budget_tokens))
    one = summed.select("whole", "a", "sum", budget.alias("b")).first().asDict()  # four numbers
    whole, a, total, b = (F.lit(one[k]).cast("double") for k in ("whole", "a", "sum", "b"))
    weighed = sized.select("source", "tokens", a.alias("exponent"), (F.pow(F.col("tokens") / whole, a) / total).alias("weight"))
    return weighed.withColumn("budget", F.round(F.col("weight") * b).cast("long"))


def mixing_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    target_entropy: float = TARGET_ENTROPY,
    max_repetition: float = MAX_REPETITION,
    budget_tokens: int | None = None,
) -> DataFrame:
    """One row per source: weight, budget, whole passes, and the two thresholds of the part of a pass.

    The part is found in three steps, each among some hundred groups of a source: the group of blocks (the
    first two digits of their keys) in which the budget ends, the block of it, the document of that.
    """
    keyed = docs.select(*(c.alias(n) for n, c in _keys(id_col, text_col, source_col).items())).withColumn("block_key", block_key("source", "key"))
    blocks = written(keyed.groupBy("source", "block_key").agg(F.sum("tokens").alias("tokens")))
    blocks = blocks.withColumn("group_key", F.substring("block_key", 1, 2))
    groups = blocks.groupBy("source", "group_key").agg(F.sum("tokens").alias("tokens"))
    plan = source_plan(groups.groupBy("source").agg(F.sum("tokens").alias("tokens")), target_entropy, max_repetition, budget_tokens)
    plan = plan.withColumn("passes", F.floor(F.col("budget") / F.col("tokens"))).withColumn("room", F.col("budget") - F.col("passes") * F.col("tokens"))
    rooms = plan.select("source", "room")
    in_group = _where_it_ends(groups, rooms, "group_key")
    inner = blocks.join(in_group.select("source", "group_key"), ["source", "group_key"]).select("source", "block_key", "tokens")
    in_block = _where_it_ends(inner, in_group.select("source", "room"), "block_key")
    # the documents of that one block per source; equal keys (repeated or null ids) are summed before they meet
    by_key = keyed.groupBy("source", "block_key", "key").agg(F.sum("tokens").alias("tokens"))
    inside = by_key.join(in_block, ["source", "block_key"])
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("key"))
    taken = inside.withColumn("upto", upto).where(F.col("upto") <= F.col("room")).groupBy("source").agg(F.max("key").alias("last_key"))
    cut = in_block.select("source", F.col("block_key").alias("cut_block"))
    return plan.drop("room").join(cut, "source", "left").join(taken, "source", "left")


def _where_it_ends(parts: DataFrame, rooms: DataFrame, key: str) -> DataFrame:
    """(source, key, room): the first part, in order of its key, that the source's room cannot take whole, and the room left for it.

    Where the parts fit exactly there is no row.
    """
    order = Window.partitionBy("source").orderBy(key)
    running = parts.withColumn("upto", F.sum("tokens").over(order)).join(rooms, "source").where(F.col("upto") > F.col("room"))
    first = running.groupBy("source").agg(F.min(F.struct(F.col(key), (F.col("room") - F.col("upto") + F.col("tokens")).alias("room"))).alias("x"))
    return first.select("source", "x.*")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    target_entropy: float = TARGET_ENTROPY,
    max_repetition: float = MAX_REPETITION,
    budget_tokens: int | None = None,
) -> DataFrame:
    """The rows of ``docs`` with all their columns, n_tokens, weight, copies and block_key (its block's place in a pass).

    copies tells how often the row goes into the mixture. Without a budget, the budget is the least that takes
    every document once, so nothing is lost and smaller sources repeat, ``max_repetition`` times at most; with
    one, larger sources lose documents. Tokens are words. Columns of these four names in ``docs`` are replaced.
    A null source is a source of its own, distinct from an empty name. Null and empty texts have no tokens: they
    go in once per pass. Sources without any tokens keep each row once and have weight 0. Rows that repeat an id
    are decided alike. An empty table stays empty.
    """
    kept = columns_of(docs, "n_tokens", "weight", "copies", "block_key")
    plan = written(mixing_plan(docs, id_col, text_col, source_col, target_entropy, max_repetition, budget_tokens))
    source, tokens, key, block = free_names(docs, "source_key", "tokens", "key", "block")
    of, weight, passes, cut_block, last_key, salt, of_salt = free_names(docs, "of", "source_weight", "passes", "cut_block", "last_key", "salt", "of_salt")
    decided = plan.select(F.col("source").alias(of), F.col("weight").alias(weight), F.col("passes").alias(passes), F.col("cut_block").alias(cut_block), F.col("last_key").alias(last_key))
    made = _keys(id_col, text_col, source_col)
    keyed = docs.select("*", *(c.alias(n) for n, c in zip((source, tokens, key), made.values()))).withColumn(block, block_key(source, key))
    if plan.count() <= BROADCAST_SOURCES:
        joined = keyed.join(F.broadcast(decided), F.col(source) == F.col(of), "left")
    else:  # so many sources meet the documents by a shuffle, in which a hot one is dealt to SALTS parts
        salted = keyed.withColumn(salt, F.pmod(F.xxhash64(key), F.lit(SALTS)))
        spread = decided.withColumn(of_salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).cast("long"))
        joined = salted.join(spread, (F.col(source) == F.col(of)) & (F.col(salt) == F.col(of_salt)), "left")
    part = (F.col(block) < F.col(cut_block)) | ((F.col(block) == F.col(cut_block)) & (F.col(key) <= F.coalesce(last_key, F.lit(""))))
    copies = F.when(F.col(passes).isNull(), 1).otherwise(F.col(passes) + F.when(part, 1).otherwise(0)).cast("long")
    return joined.select(*kept, F.col(tokens).alias("n_tokens"), F.coalesce(weight, F.lit(0.0)).alias("weight"), copies.alias("copies"), F.col(block).alias("block_key"))


def realised(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mixture itself: each row ``copies`` times."""
    (turn,) = free_names(mixed, "turn")
    return mixed.where(F.col("copies") > 0).withColumn(turn, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*map(quoted, columns))


def digest(mixed: DataFrame) -> DataFrame:
    return mixed.select("doc_id", "source", "n_tokens", F.round("weight", 6).alias("weight"), "copies", "block_key")


def oracle_sql() -> str:
    """The digest in DuckDB's SQL."""
    steps = "[0.0::double, " + ", ".join(repr(2.0**-k) for k in range(1, BISECTIONS + 1)) + "]"
    weights = "list_transform(p, lambda q: pow(q, {x}) / list_sum(list_transform(p, lambda u: pow(u, {x}))))"
    entropy = f"-list_sum(list_transform({weights}, lambda w: w * ln(w)))"
    rates = "list_transform(p, lambda q: pow(q, -({y})))"
    return f"""
with keyed as (select doc_id, source, coalesce('=' || source, 'null') as s, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+'))::bigint as n_tokens,
    md5(concat_ws(':', '{SEED}', doc_id::varchar)) as k from documents),
d as (select *, md5(s || ':' || k[1:4]) as block_key from keyed),
blocks as (select s, block_key, sum(n_tokens)::bigint as t from d group by all),
totals as (select s, sum(t)::bigint as t from blocks group by s having sum(t) > 0),
listed as (select list(t / whole order by s) as p, any_value(whole) as whole from totals, (select sum(t)::double as whole from totals)),
bisected as (select p, whole,
  list_reduce({steps}, lambda x, h: case when {entropy.format(x="(x + h)")} >= {TARGET_ENTROPY} * ln(len(p)) then x + h else x end) as e,
  1.0 - list_reduce({steps}, lambda y, h: case when list_max({rates.format(y="(y + h)")}) / list_min({rates.format(y="(y + h)")}) <= {MAX_REPETITION} then y + h else y end) as r from listed),
chosen as (select p, whole, greatest(e, r) as a from bisected),
weighed as (select s, t, pow(t / c.whole, c.a) / sum(pow(t / c.whole, c.a)) over () as w, c.whole from totals, chosen c),
planned as (select s, t, w, round(w * (max(t / whole / w) over () * whole))::bigint as b from weighed),
plan as (select s, t, w, b // t as passes, b % t as rest from planned),
running as (select b.s, b.block_key, b.t, p.rest, sum(b.t) over (partition by b.s order by b.block_key) as upto from blocks b join plan p using (s)),
cut as (select s, min(block_key) as cut_block, arg_min(rest - upto + t, block_key) as room from running where upto > rest group by s),
inside as (select d.s, d.k, cut.room, sum(n_tokens) over (partition by d.s order by d.k range between unbounded preceding and current row) as upto
           from d join cut on d.s = cut.s and d.block_key = cut.cut_block),
taken as (select s, max(k) as last_key from inside where upto <= room group by s)
select d.doc_id, d.source, d.n_tokens, round(coalesce(p.w, 0.0), 6) as weight,
  (case when p.passes is null then 1 else p.passes + case when d.block_key < cut_block or (d.block_key = cut_block and d.k <= coalesce(last_key, '')) then 1 else 0 end end)::bigint as copies,
  d.block_key
from d left join plan p using (s) left join cut using (s) left join taken using (s)
"""
