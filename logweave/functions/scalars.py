"""Column expressions with the semantics of the logs' JSON values. All of them are built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the white space that a trim takes off: ASCII white space, the Unicode separators and the byte order mark.
TRIMMED = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim_all(text: Column) -> Column:
    """Without white space at both ends (Unicode separators and line ends included)."""
    return F.trim(text, F.lit(TRIMMED))


def trim_right(text: Column) -> Column:
    return F.rtrim(text, F.lit(TRIMMED))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strict_json(text: Column) -> Column:
    """The VARIANT of a JSON text, or null if anything stands beside the value.

    The parser alone accepts what follows a value. So the text is parsed once, as the first of two items of an array
    of which the second is the text's hash: what closes the array early, or adds items, loses its place.
    """
    mark = F.xxhash64(text)
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), mark.cast("string"), F.lit("]")))
    alone = lambda items: (F.size(items) == 2) & (F.try_variant_get(F.get(items, F.lit(1)), "$", "bigint") == mark)
    return bound(F.try_variant_get(wrapped, "$", "array<variant>"), lambda items: F.when(alone(items), F.get(items, F.lit(0))))


def kind_of(value: Column) -> Column:
    """string, number, boolean, null, object or array; SQL null where there is no value.

    Objects and arrays are told by one level of them; only scalars are asked for their schema, as that of a large
    object is costly.
    """
    schema = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(F.try_variant_get(value, "$", "map<string,variant>").isNotNull(), "object")
        .when(F.try_variant_get(value, "$", "array<variant>").isNotNull(), "array")
        .when(schema == "VOID", "null")
        .when(schema == "STRING", "string")
        .when(schema == "BOOLEAN", "boolean")
        .otherwise("number")
    )


def at(value: Column, path: str) -> Column:
    """The VARIANT at a path, null where there is none."""
    return F.try_variant_get(value, path, "variant")


def strict_string(value: Column, path: str = "$") -> Column:
    """The string at a path; null if what is there is not a string."""
    return F.when(kind_of(at(value, path)) == "string", F.try_variant_get(value, path, "string"))


def strict_number(value: Column, path: str = "$") -> Column:
    """The number at a path as BIGINT; null if what is there is not a number."""
    return F.when(kind_of(at(value, path)) == "number", F.try_variant_get(value, path, "bigint"))


def truthy(value: Column) -> Column:
    """False for null, false, 0, the empty string and what is absent; true for all else."""
    kind = kind_of(value)
    return F.coalesce(
        F.when(kind == "string", F.try_variant_get(value, "$", "string") != "")
        .when(kind == "boolean", F.try_variant_get(value, "$", "boolean"))
        .when(kind == "number", F.try_variant_get(value, "$", "double") != 0)
        .when(kind.isin("object", "array"), True),
        F.lit(False),
    )


def epoch_ms(text: Column) -> Column:
    """Milliseconds since 1970 of an ISO-8601 text; null if it is none. The session's time zone should be UTC."""
    return F.unix_millis(F.try_to_timestamp(text))


def file_key(path: Column) -> Column:
    """A path of Spark's file metadata (percent-encoded) as Hadoop spells it; the form of every session_key."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, "^file:/+", "file:/")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dir_name(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def stem(path: Column, suffix: str = ".jsonl") -> Column:
    name = base_name(path)
    return F.when(name.endswith(suffix), F.substring(name, F.lit(1), F.length(name) - len(suffix))).otherwise(name)


def format_bytes(n: int) -> str:
    """A size for people: B, KB or MB with one decimal."""
    if n < 1024:
        return f"{n}B"
    return f"{n / 1024:.1f}KB" if n < 1024 * 1024 else f"{n / 1024 / 1024:.1f}MB"
