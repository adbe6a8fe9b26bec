"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.vectors import let

#: White space by an explicit class, the same in every engine.
SPACE = "[ \\t\\n\\r\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0]"
TOKEN = "[A-Za-z_][A-Za-z_0-9]+|[0-9]+"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")


def collapse(x: Column) -> Column:
    return strip(F.regexp_replace(x, f"{SPACE}+", " "))


def tokenize(x: Column) -> Column:
    """Identifiers of two characters or more and digit runs, lower case."""
    return F.transform(F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0)), F.lower)


def token_set(x: Column) -> Column:
    return F.array_distinct(tokenize(x))


def jaccard(a: Column, b: Column) -> Column:
    """Shared entries over all entries of two sets; an empty union counts as one."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def first_text(*columns: str) -> tuple[Column, Column]:
    """The first column that is not blank, stripped; and that column's name."""
    some = [(c, strip(F.col(c).cast("string"))) for c in columns]
    return F.coalesce(*[F.when(x != "", x) for _, x in some]), F.coalesce(*[F.when(x != "", F.lit(c)) for c, x in some])


def stable_id(given: Column, path: Column, line: Column, text: Column) -> Column:
    """The given id, else path or ``generated-line`` with the start of the text's SHA-1."""
    digest = F.substring(F.sha1(text), 1, 16)
    with_path = F.when(strip(path) != "", F.concat(strip(path), F.lit("-"), digest))
    return F.coalesce(F.when(strip(given) != "", strip(given)), with_path, F.concat(F.lit("generated-"), line.cast("string"), F.lit("-"), digest))


def slug(x: Column) -> Column:
    return F.regexp_replace(x, "[^A-Za-z0-9._-]+", "_")


def chunks(x: Column, chunk: int, stride: int, least: int) -> Column:
    """Overlapping windows of the collapsed text; the last keeps a tail of ``least`` characters."""

    def parts(t):
        n = F.length(t)
        last = F.when(n <= chunk, F.lit(0)).otherwise(F.ceil((n - chunk) / F.lit(stride)).cast("int"))
        cut = F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(t, k * stride + 1, F.lit(chunk)))
        return F.when(n >= least, F.filter(cut, lambda p: F.length(p) >= least)).otherwise(F.array().cast("array<string>"))

    return let(collapse(x), parts)


#: Kinds and the words that name them, in the order in which they are asked.
TEST, ERRORS, FILES = ("test", "assert"), ("raise ", "except "), ("open(", "read(", "write(")


def query_type(x: Column) -> Column:
    """The kind of a code query: the first rule that holds."""
    own = strip(x)
    lines = F.length(own) - F.length(F.replace(own, F.lit("\n"), F.lit(""))) + 1
    low = F.lower(own)

    def any_of(words):
        return F.greatest(*[low.contains(w) for w in words])

    return (
        F.when(any_of(TEST), "test_assert")
        .when(own.startswith("class "), "class_def")
        .when(own.contains("__"), "dunder")
        .when(any_of(ERRORS), "error_handling")
        .when(any_of(FILES), "io")
        .when(lines <= 4, "short")
        .when(lines >= 25, "long")
        .otherwise("medium")
    )
