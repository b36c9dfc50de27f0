"""Contracts that a change touches: names which two files agree on by spelling them alike. One pass over the added lines tells them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.operators.consumers import CONFIG_LANGUAGES
from revlens.operators.search import traceable
from revlens.operators.symbols import blocks, indentation

# Calls by which a name becomes a route, an event or a setting of the environment.
VERBS = ("get", "post", "put", "patch", "delete")
SERVERS = ("app", "router", "api")
EVENTS = ("emit", "publish", "dispatch", "subscribe", "listen")
ENVIRONMENT = ("os.getenv", "os.environ", "os.environ.get")
# Declarations that an export may begin, bases that make a class a schema.
DECLARATIONS = ("const", "let", "var", "function", "class", "interface", "type", "enum")
SCHEMA_BASES = ("BaseModel", "Schema", "TypedDict", "Model", "Base", "Document")
#: Kinds in the order in which a bounded list takes them.
KINDS = ("symbol", "export", "route", "event", "schema_field", "env_var", "config_key")
#: A name called, or indexed, with a quoted text as its first argument.
_CALL = r"""(?U)(@\s*)?([\w.:]*)([(\[])\s*["']([^"']+)["']"""


def _calls(line: Column) -> Column:
    """(decorated, callee, bracket, argument) of each call of a line whose first argument is a quoted text."""
    whole = F.regexp_extract_all(line, F.lit(_CALL), F.lit(0))
    part = lambda m, g: F.regexp_extract(m, _CALL, g)
    return F.transform(whole, lambda m: F.struct((part(m, 1) != "").alias("decorated"), part(m, 2).alias("callee"), part(m, 3).alias("bracket"), part(m, 4).alias("name")))


def _kind(call: Column) -> Column:
    """What kind of contract a call makes of its argument; null for none."""
    callee, name, called = call["callee"], call["name"], call["bracket"] == "("
    parts = F.split(callee, r"\.")
    last, owner = F.element_at(parts, -1), F.when(F.size(parts) > 1, F.element_at(parts, -2))
    ends = lambda words: F.coalesce(F.array_contains(F.array(*[F.lit(w) for w in words]), last), F.lit(False))
    plain = name.rlike(r"\A[A-Za-z_][A-Za-z0-9_]*\z")
    reads = F.lit(False)
    for e in ENVIRONMENT:
        reads = reads | (callee.endswith(e) & (called | F.lit(e != "os.getenv")))
    reads = reads | (called & callee.rlike(r"(?U)(?:\A|[^\w.])getenv\z"))
    decorator = call["decorated"] & (F.size(parts) == 2) & owner.rlike(r"(?U)\A\w+\z") & ends((*VERBS, "route"))
    served = F.coalesce(F.regexp_extract(owner, r"(?U)(\w*)\z", 1).isin(*SERVERS), F.lit(False)) & ends((*VERBS, "use"))
    routed = called & (F.coalesce(decorator, F.lit(False)) | served | callee.rlike(r"(?U)Route::\w+\z"))
    event = called & (F.size(parts) > 1) & ends(EVENTS) & name.rlike(r"(?U)\A[\w.:/-]+\z")
    return F.when(reads & plain, "env_var").when(routed, "route").when(event, "event")


def contracts(added: DataFrame) -> DataFrame:
    """(columns of `added`, kind, name): the contracts of each added line (path, line, text, language), each kind and name once a line.

    Environment variables, routes and events are calls, or indexing, with a quoted name, whatever the language. process.env
    names its variable as a member. A key of a settings file, a column that a statement adds, drops or alters, and an
    exported or upper-case name count in their languages only. A name too short or too common is none.
    """
    text, language = F.coalesce("text", F.lit("")), F.coalesce("language", F.lit(""))
    found = lambda kind, names, exact: F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name"), F.lit(exact).alias("exact")))
    where = lambda these, name: F.when(language.isin(*these) & (name != ""), F.array(name)).otherwise(F.array().cast("array<string>"))
    by_call = F.transform(F.filter(F.transform(_calls(text), lambda c: F.struct(_kind(c).alias("kind"), c["name"].alias("name"))), lambda k: k["kind"].isNotNull()), lambda k: F.struct(k["kind"].alias("kind"), k["name"].alias("name"), F.lit(False).alias("exact")))
    member = F.regexp_extract_all(text, F.lit(r"(?U)process\.env\.([A-Za-z_$][\w$]*)"), F.lit(1))
    key = F.regexp_extract(text, r"""(?U)\A\s*["']?([A-Za-z_][\w.-]*)["']?\s*[:=]\s*\S""", 1)
    column = F.regexp_extract(text, r"""(?iU)\A\s*(?:add|drop|alter)\s+column\s+["'`]?(\w+)""", 1)
    constant = F.regexp_extract(text, r"\A([A-Z][A-Z0-9_]{2,})\s*(?::[^=]+)?=\s*\S", 1)
    words = F.split(F.regexp_replace(F.ltrim(text, F.lit(" \t")), r"\Aexport\s+default\s+", "export "), r"\s+", 4)
    declared = F.when((F.get(words, F.lit(0)) == "export") & F.get(words, F.lit(1)).isin(*DECLARATIONS), F.regexp_extract(F.coalesce(F.get(words, F.lit(2)), F.lit("")), r"(?U)\A([A-Za-z_$][\w$]*)", 1)).otherwise("")
    every = F.concat(
        by_call, found("env_var", member, False), found("config_key", where(CONFIG_LANGUAGES, key), False), found("schema_field", where(("sql",), column), False),
        found("export", where(("python",), constant), True), found("export", where(("javascript", "typescript", "vue"), declared), True),
    )
    rows = added.withColumn("_c", F.explode(F.array_distinct(every)))
    return rows.where(traceable(F.col("_c.name"), F.col("_c.exact"), F.lit(True))).select(*added.columns, F.col("_c.kind").alias("kind"), F.col("_c.name").alias("name"))


def python_classes(lines: DataFrame, key: str) -> DataFrame:
    """(key, name, bases, start_line, end_line, indent, body): the classes among `lines` (key, line, text) of Python texts; body is the indentation of what stands directly in them. See symbols.blocks()."""
    head = r"(?U)\A\s*class\s+(\w+)\s*(?:\(([^)]*)\))?\s*:"
    bases = F.transform(F.split(F.regexp_extract("text", head, 2), ","), lambda b: F.substring_index(F.substring_index(F.trim(b), "[", 1), ".", -1))
    return blocks(lines, key, head).where("next_indent > indent").select(key, F.regexp_extract("text", head, 1).alias("name"), bases.alias("bases"), F.col("line").alias("start_line"), "end_line", "indent", F.col("next_indent").alias("body"))


def schema_fields(lines: DataFrame, changed: DataFrame, key: str, bin_: int = 64) -> DataFrame:
    """(key, class, name, line): fields that a change adds to a class that derives from a schema, from `lines` (key, line, text) and `changed` (key, line).

    Only added lines that stand directly in the body count. Classes and lines meet by bins of lines; a class without an
    end runs to the last line of its file.
    """
    name = F.regexp_extract(F.ltrim("text", F.lit(" \t")), r"(?U)\A([A-Za-z_]\w*)\s*(?::|=(?!=))", 1)
    added = lines.join(changed.select(key, "line").distinct(), [key, "line"], "left_semi").select(key, "line", name.alias("name"), indentation(F.col("text")).alias("at"))
    added = added.where(traceable(F.col("name"), F.lit(True), F.lit(True))).withColumn("bin", F.floor(F.col("line") / bin_))
    last = lines.groupBy(key).agg(F.max("line").alias("last_line"))
    schema = python_classes(lines, key).where(F.arrays_overlap("bases", F.array(*[F.lit(b) for b in SCHEMA_BASES]))).join(last, key).withColumn("end_line", F.coalesce("end_line", "last_line"))
    spans = schema.select(key, F.col("name").alias("class"), "start_line", "end_line", "body", F.explode(F.sequence(F.floor(F.col("start_line") / bin_), F.floor(F.col("end_line") / bin_))).alias("bin"))
    met = added.join(spans, [key, "bin"]).where((F.col("line") > F.col("start_line")) & (F.col("line") <= F.col("end_line")) & (F.col("at") == F.col("body")))
    return met.select(key, "class", "name", "line")


def first_contracts(found: DataFrame, key: str, most: int) -> DataFrame:
    """(key, kind, name, path, line, truncated): of each change the first place of each kind and name, in the order of KINDS, path and line, `most` at most."""
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    one = found.groupBy(key, "kind", "name").agg(F.min(F.struct("path", "line")).alias("at"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(rank, "at.path", "at.line", "name"))
    every = one.groupBy(key).agg((F.count(F.lit(1)) > most).alias("truncated"))
    return one.withColumn("nth", nth).where(F.col("nth") <= most).join(every, key).select(key, "kind", "name", "at.path", "at.line", "truncated")
