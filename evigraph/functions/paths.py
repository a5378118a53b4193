"""Scalar functions over paths, routes and names, JVM side only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import DYNAMIC, camel_words, route_segments

# Fixed names: directories of migrations; prefixes of frameworks and words of an origin that is the repository's own interface.
MIGRATION_DIRS = ("migrations", "migration", "migrate")
ORIGIN_PREFIXES = (("next", "public"), ("nuxt", "public"), ("expo", "public"), ("react", "app"), ("vue", "app"), ("vite",), ("gatsby",), ("public",))
OWN_ORIGIN_WORDS = (
    "api", "apis", "backend", "server", "service", "base", "app", "site", "web", "rest", "http", "https", "internal", "local", "gateway", "proxy", "graphql", "origin", "url", "uri", "host", "endpoint", "domain",
    "address", "addr", "root", "path", "prefix", "v1", "v2", "v3", "v4",
)


def is_migration_path(path: Column) -> Column:
    """A file below a directory of migrations, or below ``versions`` where another directory tells of migrations."""
    low = F.lower(path)
    named = low.rlike(f"(^|/)({'|'.join(MIGRATION_DIRS)})/")
    return named | (low.rlike("(^|/)versions/") & low.rlike("(alembic|migration)[^/]*/"))


def own_origin(name: Column, listed: tuple[str, ...] = ()) -> Column:
    """Whether an origin with this name is the repository's own: listed, or made of words for such alone, after the prefix of a framework."""
    prefixes = "|".join(" ".join(p) for p in ORIGIN_PREFIXES)
    own = F.array_join(camel_words(name), " ").rlike(f"^(({prefixes}) (?=.))?(({'|'.join(OWN_ORIGIN_WORDS)})( |$))*$")
    return own | F.lower(name).isin(*[x.lower() for x in listed]) if listed else own


def declares(detail: Column) -> Column:
    """Whether the detail of a store edge says that it declares the store."""
    return F.contains(F.coalesce(detail, F.lit("")), F.lit("declares"))


def with_api_prefix(route: Column, prefix: str) -> Column:
    """The route below a configured prefix, unless it is already."""
    steps = [x for x in prefix.split("/") if x]
    if not steps:
        return route
    begins = F.slice(route_segments(route), 1, len(steps)) == F.array(*map(F.lit, steps))
    below = F.concat_ws("/", F.lit(""), *map(F.lit, steps), F.when(route != "", F.ltrim(route, F.lit("/"))))
    return F.when(begins, route).otherwise(below)


def snake(name: Column) -> Column:
    """``fooBarID`` as ``foo_bar_id``: an underscore where a capital follows a small letter or digit."""
    return F.lower(F.regexp_replace(name, r"(?<=[\p{Lower}\p{Digit}])(?=\p{Upper})", "_"))


def pluralize(name: Column) -> Column:
    """The table name that object mappers make of a model's name."""
    low = F.lower(name)
    last, before = F.right(low, F.lit(1)), F.substring(low, F.length(low) - 1, F.lit(1))
    consonant = (F.length(low) > 1) & ~before.isin("a", "e", "i", "o", "u")
    hissing = last.isin("s", "x", "z") | F.right(low, F.lit(2)).isin("ch", "sh")
    return F.when((last == "y") & consonant, F.concat(F.left(low, F.length(low) - 1), F.lit("ies"))).when(hissing, F.concat(low, F.lit("es"))).otherwise(F.concat(low, F.lit("s")))


def is_store_list(value: Column) -> Column:
    """Whether a field is a non-empty list of store names, each perhaps with a remark in brackets, and not prose."""
    bare = F.regexp_replace(value, r"\s*\([^()]*\)", "")  # separators in remarks separate nothing
    parts = F.filter(F.transform(F.split(bare, "[,;]"), lambda p: F.trim(p)), lambda p: p != "")
    return (F.size(parts) > 0) & F.forall(parts, lambda p: p.rlike(r"^(?:\*|[A-Za-z_][A-Za-z0-9_.*/-]*)$"))


def evidence_path(evidence: Column) -> Column:
    """The path of evidence ``path:line`` or ``path:line:column``."""
    return F.regexp_replace(F.coalesce(evidence, F.lit("")), r"(?::[0-9]+){1,2}$", "")


#: What a reader of routes does at a token, by what it is in: in, token, next, what it writes. ``name`` is any name, ``*`` any token; the first row that fits counts.
_READER = (
    ("text", "[", "bracket", "{"), ("text", ":", "colon", ""), ("text", "{", "brace", "{"), ("text", "*", "text", "token"),
    ("bracket", "[", "bracket", ""), ("bracket", ".", "bracket", ""), ("bracket", "]", "closed", "}"), ("bracket", "*", "bracket", "token"),
    ("closed", "]", "closed", ""), ("closed", ":", "colon", ""), ("closed", "{", "brace", "{"), ("closed", "[", "bracket", "{"), ("closed", "*", "text", "token"),
    ("colon", "name", "named", "{token}"), ("colon", "*", "text", ":token"),
    ("named", "?", "named", ""), ("named", "+", "named", ""), ("named", "(", "rule", ""), ("named", ":", "colon", ""), ("named", "{", "brace", "{"), ("named", "*", "text", "token"),
    ("rule", ")", "named", ""), ("rule", "*", "rule", ""),
    ("brace", ":", "kind", ""), ("brace", "}", "text", "}"), ("brace", "*", "brace", "token"),
    ("kind", "}", "text", "}"), ("kind", "*", "kind", ""),
)


def documented_route(route: Column) -> tuple[Column, Column]:
    """Path template with the source's parameter names, and these names in order: ``/orders/[id]``, ``/orders/:id`` and ``/orders/{id:int}`` alike, and
    ``/trips/:from-:to`` with both. A segment is read token by token, names being one."""

    def step(state: Column, token: Column) -> Column:
        after, written = F.lit("text"), token
        for at, seen, then, out in reversed(_READER):
            fits = F.lit(True) if seen == "*" else token.rlike("^[A-Za-z_$]") if seen == "name" else token == seen
            said = {"token": token, "{token}": F.concat(F.lit("{"), token, F.lit("}")), ":token": F.concat(F.lit(":"), token)}.get(out, F.lit(out))
            here = (state["at"] == at) & fits
            after, written = F.when(here, F.lit(then)).otherwise(after), F.when(here, said).otherwise(written)
        return F.struct(after.alias("at"), F.concat(state["out"], written).alias("out"))

    def shown(segment: Column) -> Column:
        tokens = F.regexp_extract_all(segment, F.lit("[A-Za-z0-9_$]+|[^A-Za-z0-9_$]"), F.lit(0))
        start = F.struct(F.lit("text").alias("at"), F.lit("").alias("out"))
        return F.aggregate(tokens, start, step, lambda s: F.when(s["at"] == "colon", F.concat(s["out"], F.lit(":"))).otherwise(s["out"]))

    path = F.concat(F.lit("/"), F.array_join(F.transform(route_segments(F.trim(route)), shown), "/"))
    return path, F.regexp_extract_all(path, F.lit(r"\{([^{}]+)\}"), F.lit(1))


def openapi_path(route: Column) -> Column:
    """A route's shape as a path template with unique parameter names: ``/a/{dynamic}/{dynamic}`` as ``/a/{param1}/{param2}``."""
    pieces = F.split(route, r"\{dynamic\}", -1)
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("{param"), i.cast("string"), F.lit("}"), p))), "")


def column_hint(columns: Column, written: Column) -> Column:
    """struct(kind, column): of the declared columns the one that a reference to an unknown one most likely means: the only one that differs by
    case, or the only one with the same words; NULL without one."""

    def only(kind: str, key) -> Column:
        alike = F.filter(columns, lambda c: (key(c) == key(written)) & (c != written))
        return F.when(F.size(alike) == 1, F.struct(F.lit(kind).alias("kind"), F.get(alike, F.lit(0)).alias("column")))

    return F.coalesce(only("case", F.lower), only("similar", snake))


__all__ = ["DYNAMIC", "column_hint", "declares", "documented_route", "evidence_path", "is_migration_path", "is_store_list", "openapi_path", "own_origin", "pluralize", "snake", "with_api_prefix"]
