"""Operator 3: secret scans. DataFrame functions only; each row is worked on alone.

The base patterns are searched as given. Beside them, each character class (hex digits, base64 characters) has
candidates of its own: its maximal runs of ``WINDOW`` characters or more, so a run of hex digits inside of a
base64 run is judged as hex digits too. A window of ``WINDOW`` characters slides over a candidate, and the Shannon
entropy of the window is kept by counts, one per character of the class: with f(c) = c log2 c and S the sum of f
over the counts, a character that enters with count c raises S by f(c + 1) - f(c), and one that leaves lowers it
likewise; the entropy is log2(WINDOW) - S / WINDOW. A candidate whose highest window exceeds the limit of its class
is a span, unless the allow-list has it. A step changes two counts, so the time is linear in the candidate's length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.scalars import bound
from logweave.llm.common import quoted

# Kind, pattern, group that is measured, least length of it.
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
# The same matches of sufficient length, found without the short ones: a run of one class either has the
# length or no part of it has.
LONG_ONLY = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"(?<![0-9a-f])[0-9a-f]{24,}"}
WINDOW = 20
PER_LONG = 12  # counts in a long
BLOCK = 256  # matches of a text whose places are summed together
CHARACTERS = {"hex": "0123456789abcdefABCDEF", "base64": "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"}
# Kind, class of the run, what it must hold and lack, limit in bits for its highest window. Windows of random
# characters: hex digits 3.4, base64 3.9 and more; words joined without spaces seldom pass 3.8, or 3.9 where they
# have no digit.
KINDS = [
    ("entropy_hex", "hex", ["[0-9]"], "[^0-9a-fA-F]", 3.0),
    ("entropy_base64", "base64", ["[0-9]"], "[^0-9a-zA-Z+/_=-]", 3.8),
    ("entropy_letters", "base64", ["[a-z]", "[A-Z]"], "[0-9]", 3.9),
]
# Candidates that hold one of these (in any case) are known to be harmless.
ALLOWED = ["example", "sample", "placeholder", "changeme", "dummy", "xxxxxxxx", "00000000", "0123456789", "1234567890", "abcdefgh"]


def _run_pattern(characters: str) -> str:
    """Maximal runs of the characters ('-' comes last in them)."""
    return f"(?<![{characters}])[{characters}]{{{WINDOW},}}+"


def running_sums(numbers: Column) -> Column:
    """The sums up to each of the numbers, itself included: within blocks, then with the sums of the blocks before.

    So a text of n matches costs about n ** 1.5 steps; a list that grows by one at a time would be copied n times.
    """
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, b: a + b)

    def over(blocks: Column) -> Column:
        before = bound(F.transform(blocks, total), lambda sums: F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b))))
        inner = F.transform(blocks, lambda xs: F.transform(xs, lambda _, k: total(F.slice(xs, F.lit(1), k + 1))))
        return F.flatten(F.zip_with(inner, before, lambda xs, b: F.transform(xs, lambda x: x + b)))

    def blocks(xs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda b: F.slice(xs, b * BLOCK + 1, F.lit(BLOCK)))

    return bound(bound(numbers, blocks), over)


def _spans(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, measured, match>> of the leftmost matches that do not overlap."""
    gaps = F.split(text, pattern, -1)

    def placed(found: Column) -> Column:
        # the text behind the last match is a gap without one
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.length(g) + F.length(m["m"]))
        return F.zip_with(running_sums(steps), found, lambda e, m: F.struct((e - F.length(m["m"])).alias("start"), e.alias("end"), m["x"].alias("measured"), m["m"].alias("match")))

    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if group:
        found = F.zip_with(whole, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda m, x: F.struct(m.alias("m"), x.alias("x")))
    else:
        found = F.transform(whole, lambda m: F.struct(m.alias("m"), m.alias("x")))
    empty = F.array().cast("array<struct<start:int,end:int,measured:string,match:string>>")
    return F.when(text.rlike(pattern), bound(found, placed)).otherwise(empty)


def _long_enough(spans: Column, least: int) -> Column:
    return F.filter(spans, lambda x: F.length(x["measured"]) >= least)


def _f(count: Column) -> Column:
    """count * log2(count) for 0 to WINDOW, looked up."""
    return F.element_at(F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2))), count + 1)


def highest_entropy(run: Column, characters: str) -> Column:
    """The entropy in bits of the window of ``run`` that has the most; run has ``WINDOW`` of the characters at least.

    A count takes five bits, so a few longs hold all of them; a character has its long, and the place in it.
    """
    longs = -(-len(characters) // PER_LONG)
    at = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(characters), c) - 1)
    places = F.transform(F.filter(at, lambda k: k >= 0), lambda k: F.struct(F.floor(k / PER_LONG).cast("int").alias("long"), (k % PER_LONG * 5).alias("bit"), F.call_function("shiftleft", F.lit(1).cast("long"), k % PER_LONG * 5).alias("one")))
    none = F.array_repeat(F.struct(F.lit(-1).alias("long"), F.lit(0).alias("bit"), F.lit(0).cast("long").alias("one")), WINDOW)
    moves = bound(places, lambda p: F.zip_with(p, F.slice(F.concat(none, p), F.lit(1), F.size(p)), lambda e, l: F.struct(e.alias("enters"), l.alias("leaves"))))

    def count(counts: Column, place: Column) -> Column:
        return F.call_function("shiftright", F.get(counts, place["long"]), place["bit"]).bitwiseAND(F.lit(31)).cast("int")

    def step(state: Column, move: Column) -> Column:
        enters, leaves = move["enters"], move["leaves"]
        full = leaves["long"] >= 0
        out = count(state["counts"], leaves)
        lowered = F.when(full, state["s"] - (_f(out) - _f(out - 1))).otherwise(state["s"])
        own = count(state["counts"], enters) - F.when(leaves == enters, 1).otherwise(0)
        changed = F.transform(state["counts"], lambda c, k: c + F.when(k == enters["long"], enters["one"]).otherwise(0) - F.when(k == leaves["long"], leaves["one"]).otherwise(0))
        return F.struct(
            changed.alias("counts"),
            (lowered + (_f(own + 1) - _f(own))).alias("s"),
            # of the window before; the last one is seen to at the end
            F.when(full & (state["s"] < state["least"]), state["s"]).otherwise(state["least"]).alias("least"),
        )

    start = F.struct(F.array_repeat(F.lit(0).cast("long"), longs).alias("counts"), F.lit(0.0).alias("s"), F.lit(1e9).alias("least"))
    return F.aggregate(moves, start, step, lambda state: F.lit(math.log2(WINDOW)) - F.least(state["least"], state["s"]) / WINDOW)


def _named(spans: Column, kind: str, order: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["match"].alias("match")))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, base and found, arrays of (start, order, end, kind, match) by start.

    base has the kinds assign, access and hex; found has these and those of ``KINDS``. Offsets are
    code points, the end exclusive. A null or empty text has none. Null ids and repeated rows are kept as they
    are; other columns are not read; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text")).select("doc_id", text.alias("text"))
    base = [_spans(F.col("text"), LONG_ONLY.get(kind, pattern), group).alias(kind) for kind, pattern, group, _ in BASE]
    runs = [_spans(F.col("text"), _run_pattern(characters)).alias(f"{name}_runs") for name, characters in CHARACTERS.items()]
    spans = plain.select("doc_id", *base, *runs)
    kept = [_named(_long_enough(F.col(kind), least), kind, k) for k, (kind, _, _, least) in enumerate(BASE)]

    def random(name: str, holds: list[str], lacks: str, limit: float) -> Column:
        def chosen(x: Column) -> Column:
            fits = ~x["match"].rlike(lacks)
            for pattern in holds:
                fits = fits & x["match"].rlike(pattern)
            return fits & ~F.lower(x["match"]).rlike("|".join(ALLOWED)) & (highest_entropy(x["match"], CHARACTERS[name]) > limit)

        return F.filter(F.col(f"{name}_runs"), chosen)

    more = [_named(random(*how), kind, k) for k, (kind, *how) in enumerate(KINDS, len(BASE))]
    found = spans.select("doc_id", F.concat(*kept).alias("base"), F.concat(*more).alias("more"))
    return found.select("doc_id", F.sort_array("base").alias("base"), F.sort_array(F.concat("base", "more")).alias("found"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of the base spans, and all spans as text."""

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(F.col(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select("doc_id", *(count(kind) for kind, _, _, _ in BASE), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("found").alias("spans"))


def oracle_sql() -> str:
    """The digest in DuckDB's SQL: entropies are computed afresh for every window."""

    def spans(name: str, pattern: str, group: int, least: int, kind: str, order: int) -> str:
        pattern = pattern.replace("'", "''").replace("\\x20", " ")
        options = ", 'i'" if pattern.startswith("(?i)") else ""
        del options
        return f"""
{name}_parts as (select rid, string_split_regex(text, '{pattern}') as gaps, regexp_extract_all(text, '{pattern}', 0) as found, regexp_extract_all(text, '{pattern}', {group}) as measured from texts),
{name}_rows as (select rid, unnest(found) as m, unnest(measured) as x, unnest(gaps[1:len(found)]) as gap, generate_subscripts(found, 1) as k from {name}_parts where len(found) > 0),
{name}_at as (select rid, m, x, sum(length(gap) + length(m)) over (partition by rid order by k) as stop from {name}_rows),
{name} as (select rid, stop - length(m) as start, stop, m, '{kind}' as kind, {order} as ord from {name}_at where length(x) >= {least})"""

    plain = {"assign": BASE[0][1], "access": BASE[1][1], "hex": BASE[2][1]}
    ctes = [spans(kind, plain[kind], group, least, kind, k) for k, (kind, _, group, least) in enumerate(BASE)]
    ctes += [spans(f"run_{name}", f"[{characters}]{{{WINDOW},}}", 0, WINDOW, name, 0) for name, characters in CHARACTERS.items()]
    entropies = []
    for k, (kind, name, holds, lacks, limit) in enumerate(KINDS, len(BASE)):
        fits = "".join(f" and regexp_matches(m, '{pattern}')" for pattern in holds)
        entropies.append(f"select * replace ('{kind}' as kind, {k} as ord), {limit} as least from run_{name} where not regexp_matches(m, '{lacks}'){fits} and not regexp_matches(lower(m), '{'|'.join(ALLOWED)}')")
    return f"""
with texts as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
{",".join(ctes)},
runs as ({" union all ".join(entropies)}),
windows as (select *, substr(m, w, {WINDOW}) as win from (select *, unnest(generate_series(1, length(m) - {WINDOW} + 1)) as w from runs)),
bits as (select * exclude (w, win), log2({WINDOW}) - list_sum(list_transform(list_distinct(string_split(win, '')), lambda c:
         (length(win) - length(replace(win, c, ''))) * log2(length(win) - length(replace(win, c, ''))))) / {WINDOW} as b from windows),
base as (select * from assign union all select * from access union all select * from hex),
entropy as (select rid, start, stop, m, kind, ord from bits group by rid, start, stop, m, kind, ord, least having max(b) > least),
found as (select * from base union all select * from entropy),
b as (select rid, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
      string_agg(kind || ':' || start || ':' || stop, ',' order by start, ord) as spans from base group by rid),
f as (select rid, string_agg(kind || ':' || start || ':' || stop, ',' order by start, ord) as spans from found group by rid)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(b.spans, '')) as base_sha256, coalesce(f.spans, '') as spans
from texts left join b using (rid) left join f using (rid)
"""
