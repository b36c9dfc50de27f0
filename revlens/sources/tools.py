"""Output of analysers as findings, by JSON schemas on the JVM. What can't be read gives no rows; numbers and names may be missing.

Each reader takes a table with stdout and returns (file, start_line, end_line, severity, category, kind, effort, title, body, rule_id, confidence, tool).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.operators.findings import only_changed
from revlens.operators.graph import longest_prefix
from revlens.sources.diffs import split_lines

#: Categories and severities by prefix of a code.
RUFF = {
    "S": ("security", "major"), "PERF": ("performance", "minor"), "ASYNC": ("bug", "major"), "B": ("bug", "major"), "F82": ("bug", "critical"), "F": ("bug", "minor"),
    "E9": ("bug", "critical"), "RUF": ("maintainability", "minor"), "SIM": ("maintainability", "minor"), "C4": ("performance", "info"), "N": ("style", "info"),
    "D": ("docs", "info"), "ANN": ("maintainability", "info"), "PT": ("testing", "minor"), "E": ("style", "info"), "W": ("style", "info"), "I": ("style", "info"),
    "UP": ("maintainability", "info"),
}
DOCKER_SECURITY = ("DL3002", "DL3004", "DL3006", "DL3007", "DL4006", "SC2086")
WORKFLOW_SECURITY = ("expression", "shellcheck", "credentials", "permissions")

_text = lambda c: F.coalesce(F.trim(c.cast("string")), F.lit(""))


def kind_for(severity: Column) -> Column:
    return F.when(severity.isin("major", "critical"), "potential_issue").otherwise("nitpick")


def effort_for(severity: Column) -> Column:
    return F.when(severity == "critical", "moderate").otherwise("quick_win")


def classify_ruff(rows: DataFrame, code: str) -> DataFrame:
    return longest_prefix(rows, code, RUFF, ("maintainability", "minor"))


def classify_semgrep(severity: Column, rule: Column) -> Column:
    """(category, severity) by words of the rule; security is major at least."""
    low = F.lower(F.coalesce(rule, F.lit("")))
    own = F.when(F.upper(severity) == "ERROR", "major").when(F.upper(severity) == "INFO", "info").otherwise("minor")
    category = F.when(low.rlike("security|injection|xss|csrf|crypto|audit"), "security").when(low.contains("performance"), "performance").when(low.rlike("correctness|bug"), "bug").otherwise("maintainability")
    return F.struct(category.alias("category"), F.when(category == "security", "major").otherwise(own).alias("severity"))


def classify_eslint(severity: Column, rule: Column) -> Column:
    low = F.lower(F.coalesce(rule, F.lit("")))
    secure = low.contains("security") | low.startswith("no-eval") | low.startswith("no-implied-eval")
    style = low.startswith("no-unused") | low.startswith("prefer-") | low.startswith("sort-") | low.contains("style")
    category = F.when(secure, "security").when(style, "style").otherwise("bug")
    return F.struct(category.alias("category"), F.when(secure, "major").when(style, "info").when(severity >= 2, "major").otherwise("minor").alias("severity"))


def _out(rows: DataFrame, tool: str, file: Column, line: Column, end: Column, title: Column, body: Column, code: Column, confidence: float, kind: Column | None = None, effort: Column | None = None) -> DataFrame:
    severity = F.col("severity")
    start = line.cast("long")
    return rows.select(
        _text(file).alias("file"), start.alias("start_line"), F.coalesce(end.cast("long"), start).alias("end_line"), "severity", "category",
        (kind if kind is not None else kind_for(severity)).alias("kind"), (effort if effort is not None else effort_for(severity)).alias("effort"),
        title.alias("title"), _text(body).alias("body"), F.when(_text(code) != "", F.concat(F.lit(f"{tool.split('-')[0]}/"), _text(code))).alias("rule_id"), F.lit(confidence).alias("confidence"), F.lit(tool).alias("tool"),
    )


def ruff(runs: DataFrame) -> DataFrame:
    rows = runs.select(F.explode(F.from_json("stdout", "array<struct<code:string,name:string,message:string,url:string,filename:string,location:struct<row:long>,end_location:struct<row:long>>>")).alias("e")).where("e.location.row > 0")
    rows = classify_ruff(rows.withColumn("code", _text(F.col("e.code"))), "code")
    body = F.concat(_text(F.col("e.message")), F.when(_text(F.col("e.url")) != "", F.concat(F.lit("\n\n"), F.col("e.url"))).otherwise(""))
    return _out(rows, "ruff", F.col("e.filename"), F.col("e.location.row"), F.col("e.end_location.row"), F.trim(F.concat("code", F.lit(" "), _text(F.col("e.name")))), body, F.col("code"), 1.0)


def mypy(runs: DataFrame) -> DataFrame:
    lines = runs.select(F.explode(split_lines(F.col("stdout"))).alias("line")).where(F.trim("line").startswith("{"))
    rows = lines.select(F.from_json("line", "struct<file:string,line:long,end_line:long,message:string,hint:string,code:string,severity:string>").alias("e")).where("e.line > 0 AND NOT e.severity <=> 'note'")
    rows = rows.withColumns({"severity": F.when(F.col("e.severity") == "error", "major").otherwise("minor"), "category": F.lit("bug")})
    title = F.when(_text(F.col("e.code")) != "", F.concat(F.lit("Type error: "), F.col("e.code"))).otherwise("Type error")
    body = F.concat(_text(F.col("e.message")), F.when(_text(F.col("e.hint")) != "", F.concat(F.lit("\n\n"), F.col("e.hint"))).otherwise(""))
    return _out(rows, "mypy", F.col("e.file"), F.col("e.line"), F.col("e.end_line"), title, body, F.col("e.code"), 1.0)


def semgrep(runs: DataFrame) -> DataFrame:
    got = F.from_json("stdout", "struct<results:array<struct<check_id:string,path:string,start:struct<line:long>,`end`:struct<line:long>,extra:struct<severity:string,message:string>>>>")
    rows = runs.select(F.explode(got["results"]).alias("e")).where("e.start.line > 0").withColumn("c", classify_semgrep(F.col("e.extra.severity"), F.col("e.check_id"))).select("e", "c.*")
    title = F.coalesce(F.nullif(F.replace(F.substring_index(_text(F.col("e.check_id")), ".", -1), F.lit("-"), F.lit(" ")), F.lit("")), F.lit("Semgrep finding"))
    return _out(rows, "semgrep", F.col("e.path"), F.col("e.start.line"), F.col("e.end.line"), title, F.col("e.extra.message"), F.col("e.check_id"), 0.95)


def eslint(runs: DataFrame) -> DataFrame:
    got = F.from_json("stdout", "array<struct<filePath:string,messages:array<struct<ruleId:string,severity:int,message:string,line:long,endLine:long>>>>")
    rows = runs.select(F.explode(got).alias("f")).select("f.filePath", F.explode("f.messages").alias("e")).where("e.line > 0")
    rows = rows.withColumn("c", classify_eslint(F.coalesce("e.severity", F.lit(1)), F.col("e.ruleId"))).select("filePath", "e", "c.*")
    return _out(rows, "eslint", F.col("filePath"), F.col("e.line"), F.col("e.endLine"), F.coalesce(F.nullif(_text(F.col("e.ruleId")), F.lit("")), F.lit("ESLint finding")), F.col("e.message"), F.col("e.ruleId"), 1.0)


def phpstan(runs: DataFrame) -> DataFrame:
    """What stands before the first brace is noise."""
    json = F.regexp_extract("stdout", r"(?s)(\{.*)\z", 1)
    got = F.from_json(json, "struct<files:map<string,struct<messages:array<struct<message:string,line:long,ignorable:boolean,identifier:string>>>>>")
    rows = runs.select(F.explode(got["files"]).alias("path", "f")).select("path", F.explode("f.messages").alias("e")).where("e.line > 0")
    rows = rows.withColumns({"severity": F.when(~F.coalesce("e.ignorable", F.lit(True)), "major").otherwise("minor"), "category": F.lit("bug")})
    title = F.when(_text(F.col("e.identifier")) != "", F.concat(F.lit("PHPStan: "), F.col("e.identifier"))).otherwise("PHPStan finding")
    return _out(rows, "phpstan", F.col("path"), F.col("e.line"), F.col("e.line"), title, F.col("e.message"), F.col("e.identifier"), 0.9)


def hadolint(runs: DataFrame) -> DataFrame:
    rows = runs.select(F.explode(F.from_json("stdout", "array<struct<code:string,file:string,level:string,line:long,message:string>>")).alias("e"))
    secure = F.coalesce(F.col("e.code").isin(*DOCKER_SECURITY), F.lit(False))
    level = F.lower(_text(F.col("e.level")))
    rows = rows.withColumns({"secure": secure, "severity": F.when(secure | (level == "error"), "major").when(level.isin("info", "style"), "info").otherwise("minor"), "category": F.when(secure, "security").otherwise("maintainability")})
    line = F.coalesce(F.nullif("e.line", F.lit(0)), F.lit(1))
    kind = F.when(F.col("secure"), "potential_issue").otherwise("nitpick")
    return _out(rows, "hadolint", F.col("e.file"), line, line, F.coalesce(F.nullif(_text(F.col("e.code")), F.lit("")), F.lit("Dockerfile issue")), F.col("e.message"), F.col("e.code"), 0.9, kind, F.lit("quick_win"))


def actionlint(runs: DataFrame) -> DataFrame:
    rows = runs.select(F.explode(F.from_json("stdout", "array<struct<message:string,filepath:string,line:long,kind:string>>")).alias("e"))
    secure = F.coalesce(F.col("e.kind").isin(*WORKFLOW_SECURITY), F.lit(False))
    rows = rows.withColumns({"secure": secure, "severity": F.when(secure, "major").otherwise("minor"), "category": F.when(secure, "security").otherwise("maintainability")})
    line = F.coalesce(F.nullif("e.line", F.lit(0)), F.lit(1))
    title = F.replace(F.coalesce(F.nullif(_text(F.col("e.kind")), F.lit("")), F.lit("workflow issue")), F.lit("-"), F.lit(" "))
    return _out(rows, "actionlint", F.col("e.filepath"), line, line, title, F.col("e.message"), F.col("e.kind"), 0.9, F.when(F.col("secure"), "potential_issue").otherwise("nitpick"), F.lit("quick_win"))


def checkov(runs: DataFrame) -> DataFrame:
    """One report or a list of them, after any noise."""
    report = "struct<results:struct<failed_checks:array<struct<check_id:string,check_name:string,severity:string,file_path:string,file_line_range:array<long>>>>>"
    json = F.regexp_extract("stdout", r"(?s)([\[{].*)\z", 1)
    got = F.when(json.startswith("["), F.from_json(json, f"array<{report}>")).otherwise(F.array(F.from_json(json, report)))
    rows = runs.select(F.explode(got).alias("r")).select(F.explode("r.results.failed_checks").alias("e"))
    rows = rows.withColumns({"severity": F.when(F.upper("e.severity").isin("HIGH", "CRITICAL"), "major").otherwise("minor"), "category": F.lit("security"), "file": F.regexp_replace(_text(F.col("e.file_path")), r"\A/+", "")})
    rows = rows.where("file <> ''")
    start = F.greatest(F.coalesce(F.get("e.file_line_range", 0), F.lit(1)), F.lit(1))
    title = F.substring(F.coalesce(F.nullif(_text(F.col("e.check_name")), F.lit("")), _text(F.col("e.check_id"))), 1, 60)
    return _out(rows, "checkov", F.col("file"), start, F.greatest(F.coalesce(F.get("e.file_line_range", 1), start), start), title, F.col("e.check_name"), F.col("e.check_id"), 0.9, F.lit("potential_issue"), F.lit("moderate"))


def osv(runs: DataFrame) -> DataFrame:
    """A lock has no line for a package: all stand at line 1."""
    got = F.from_json("stdout", "struct<results:array<struct<source:struct<path:string>,packages:array<struct<package:struct<name:string,version:string>,vulnerabilities:array<struct<id:string,summary:string>>>>>>>")
    rows = runs.select(F.explode(got["results"]).alias("r")).select("r.source.path", F.explode("r.packages").alias("p")).select("path", "p.package", F.explode("p.vulnerabilities").alias("e"))
    rows = rows.withColumns({"severity": F.lit("major"), "category": F.lit("security")})
    name, version, found = _text(F.col("package.name")), _text(F.col("package.version")), _text(F.col("e.id"))
    body = F.concat(name, F.lit(" "), version, F.lit(": "), F.coalesce(F.nullif(_text(F.col("e.summary")), F.lit("")), found))
    return _out(rows, "osv-scanner", F.col("path"), F.lit(1), F.lit(1), F.substring(F.concat(found, F.lit(" in "), name), 1, 60), body, F.col("e.id"), 0.95, F.lit("potential_issue"), F.lit("moderate"))


READERS: dict[str, Callable[[DataFrame], DataFrame]] = {"ruff": ruff, "mypy": mypy, "semgrep": semgrep, "eslint": eslint, "phpstan": phpstan, "hadolint": hadolint, "actionlint": actionlint, "checkov": checkov, "osv-scanner": osv}
#: Tools whose findings are reported whole instead of at changed lines.
REPORT_ONLY = ("osv-scanner",)


def findings(runs: DataFrame, readers: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Findings of all runs (tool, stdout); tools without a reader give none."""
    out = None
    for tool, read in (readers or READERS).items():
        rows = read(runs.where(F.col("tool") == tool))
        out = rows if out is None else out.unionByName(rows)
    return out


def routed(runs: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(inline, reported, unavailable) of a review's runs (tool, stdout, reason): findings whose span holds a changed line (file, line), all findings of the REPORT_ONLY tools, and (tool, reason) of the runs that gave no output."""
    gave = runs.where(F.col("stdout").isNotNull())
    out = findings(gave, {t: r for t, r in READERS.items() if t not in REPORT_ONLY})
    reported = findings(gave, {t: READERS[t] for t in REPORT_ONLY})
    # Equal findings share their fate, so what they say names them.
    named = out.withColumn("pos", F.sha2(F.to_json(F.struct(*out.columns)), 256))
    return only_changed(named, changed).drop("pos"), reported, runs.where(F.col("stdout").isNull()).select("tool", "reason").distinct()


def applicable(tools: DataFrame, files: DataFrame) -> DataFrame:
    """(tool, path): a tool's files by its globs (regexes) if it has some, else by its languages, else all. `tools` (tool, globs, languages, network, named): one that needs the network runs only where it is named."""
    by_glob = F.exists("globs", lambda g: F.regexp_like(F.col("path"), g))
    on = F.when(F.size("globs") > 0, by_glob).when(F.size("languages") > 0, F.array_contains("languages", F.col("language"))).otherwise(True)
    return tools.where("NOT network OR named").join(files, on).select("tool", "path")
