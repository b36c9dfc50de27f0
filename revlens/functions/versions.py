"""Version numbers: moves between two, and constraints. Built-in expressions; an unknown form gives null, never a guess."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOP = 999_999_999


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once and not at each mention."""
    return F.get(F.transform(F.array(value), use), 0)


def numeric_parts(version: Column) -> Column:
    """The leading numbers of a version's components: of 1.20.3-rc1 the array 1, 20, 3."""
    lead = F.regexp_extract(F.regexp_replace(version, r"\A[v=^~> ]+", ""), r"\A(\d+(?:\.\d+)*)", 1)
    return F.transform(F.filter(F.split(lead, r"\."), lambda x: x != ""), lambda x: x.cast("long"))


def version_move(old: Column, new: Column) -> Column:
    """upgraded or downgraded, by the first component of both that differs; upgraded where none does."""

    def told(parts: Column) -> Column:
        n = F.least(F.size(parts["old"]), F.size(parts["new"]))
        pairs = F.zip_with(F.slice(parts["old"], F.lit(1), n), F.slice(parts["new"], F.lit(1), n), lambda a, b: F.signum((b - a).cast("double")))
        return F.get(F.filter(pairs, lambda d: d != 0), 0)

    first = _let(F.struct(numeric_parts(old).alias("old"), numeric_parts(new).alias("new")), told)
    return F.when(first < 0, "downgraded").otherwise("upgraded")


_SEMVER = r"\Av?(\d{1,9})(?:\.(\d{1,9}|[xX*]))?(?:\.(\d{1,9}|[xX*]))?(-[0-9A-Za-z.-]+)?(?:\+[0-9A-Za-z.-]+)?\z"


def _parsed(text: Column) -> Column:
    """(low, high, parts, wild): the least and the greatest version that a partial one means; null for other forms and prereleases."""
    got = [F.regexp_extract(text, _SEMVER, i) for i in (1, 2, 3)]
    wild = [g.isin("x", "X", "*") for g in got]
    number = [F.when(g.rlike(r"\A\d+\z"), g.try_cast("long")).otherwise(0) for g in got]
    parts = F.when((got[1] == "") | wild[1], 1).when((got[2] == "") | wild[2], 2).otherwise(3)
    ok = text.rlike(_SEMVER) & (F.regexp_extract(text, _SEMVER, 4) == "") & ~(wild[1] & (got[2] != "") & ~wild[2])
    high = [number[0], F.when(parts == 1, _TOP).otherwise(number[1]), F.when(parts < 3, _TOP).otherwise(number[2])]
    return F.when(ok, F.struct(F.array(*number).alias("low"), F.array(*[h.cast("long") for h in high]).alias("high"), parts.alias("parts"), (wild[1] | wild[2]).alias("wild")))


def _up(major: Column, minor: Column, patch: Column) -> Column:
    return F.array(major.cast("long"), minor.cast("long"), patch.cast("long"))


def _token(token: Column, value: Column) -> Column:
    """Whether a version (an array of three numbers) meets one comparison; null if that can't be told."""
    told = _let(_parsed(F.regexp_replace(token, r"\A(?:\^|~|>=|<=|>|<|=)", "")), lambda p: _compared(F.regexp_extract(token, r"\A(\^|~|>=|<=|>|<|=)?", 1), p, value))
    return F.when(token.isin("*", "x", "X"), True).otherwise(told)


def _compared(op: Column, p: Column, value: Column) -> Column:
    low, zero = p["low"], F.lit(0)
    a, b, c = (F.get(low, i) for i in range(3))
    caret = (
        F.when(a > 0, _up(a + 1, zero, zero))
        .when(p["parts"] == 1, _up(F.lit(1), zero, zero))
        .when(b > 0, _up(zero, b + 1, zero))
        .when(p["parts"] == 2, _up(zero, F.lit(1), zero))
        .otherwise(_up(zero, zero, c + 1))
    )
    tilde = F.when(p["parts"] == 1, _up(a + 1, zero, zero)).otherwise(_up(a, b + 1, zero))
    inside = (value >= low) & (value <= p["high"])
    known = (
        F.when(op.isin("", "="), inside)
        .when(p["wild"], F.lit(None).cast("boolean"))
        .when(op == ">", value > low)
        .when(op == ">=", value >= low)
        .when(op == "<", value < low)
        .when(op == "<=", value <= low)
        .when(op == "^", (value >= low) & (value < caret))
        .when(op == "~", (value >= low) & (value < tilde))
    )
    return F.when(p.isNotNull(), known)


def _group(group: Column, value: Column) -> Column:
    """All comparisons of a group, or a range a - b."""
    span = r"\A\s*(\S+)\s+-\s+(\S+)\s*\z"
    ends = F.struct(_parsed(F.regexp_extract(group, span, 1)).alias("a"), _parsed(F.regexp_extract(group, span, 2)).alias("b"))
    ranged = _let(ends, lambda e: F.when(e["a"].isNotNull() & e["b"].isNotNull() & ~e["a"]["wild"], (value >= e["a"]["low"]) & (value <= e["b"]["high"])))
    tokens = F.filter(F.split(group, r"[\s,]+"), lambda t: t != "")
    all_of = _let(F.transform(tokens, lambda t: _token(t, value)), lambda met: F.when(F.size(met) == 0, F.lit(None).cast("boolean")).when(F.exists(met, lambda m: m.eqNullSafe(F.lit(False))), False).when(F.exists(met, lambda m: m.isNull()), F.lit(None).cast("boolean")).otherwise(True))
    return F.when(group.rlike(span), ranged).otherwise(all_of)


def semver_satisfies(constraint: Column, version: Column) -> Column:
    """Whether a full version lies in a range: ^ ~ > >= < <= =, partial and wildcard versions, a - b, sets, and || between alternatives.

    Null where the version isn't a plain full one, or a form isn't known and no alternative holds without it.
    """
    groups = F.transform(F.split(F.trim(constraint), r"\|\|"), lambda g: F.trim(g))

    def told(v: Column) -> Column:
        met = F.transform(groups, lambda g: _group(g, v["low"]))
        any_of = _let(met, lambda m: F.when(F.exists(m, lambda x: x.eqNullSafe(F.lit(True))), True).when(F.exists(m, lambda x: x.isNull()), F.lit(None).cast("boolean")).otherwise(False))
        return F.when(v.isNotNull() & (v["parts"] == 3) & ~v["wild"] & ~F.exists(groups, lambda g: g == ""), any_of)

    return _let(_parsed(F.trim(version)), told)


# The grammar of Python's versions: epoch, release, pre-release, post-release, development release, local part.
_PEP = r"\Av?(?:(\d{1,9})!)?(\d{1,9}(?:\.\d{1,9})*)(?:[-_.]?(a|alpha|b|beta|c|rc|pre|preview)[-_.]?(\d{0,9}))?(-\d{1,9}|[-_.]?(?:post|rev|r)[-_.]?\d{0,9})?([-_.]?dev[-_.]?\d{0,9})?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\z"
_NEVER, _EVER = -1, 2_000_000_000


def _pep(text: Column) -> Column:
    """A Python version as (epoch, release without zeros at its end, pre, pre_n, post, dev), which compare as the versions do, and (parts, local, written); null for other texts."""
    low = F.lower(F.trim(text))
    got = lambda i: F.regexp_extract(low, _PEP, i)
    number = lambda t: F.coalesce(F.regexp_extract(t, r"(\d+)\z", 1).try_cast("long"), F.lit(0).cast("long"))
    written = F.transform(F.split(got(2), r"\."), lambda x: x.cast("long"))
    release = F.transform(F.split(F.regexp_replace(got(2), r"(?:\.0+)+\z", ""), r"\."), lambda x: x.cast("long"))
    stage = F.when(got(3).isin("a", "alpha"), 0).when(got(3).isin("b", "beta"), 1).when(got(3) != "", 2)
    # A bare development release comes before any pre-release, and a final one after all of them.
    pre = F.coalesce(stage, F.when((got(5) == "") & (got(6) != ""), F.lit(_NEVER)).otherwise(F.lit(9)))
    key = F.struct(
        number(got(1)).alias("epoch"), release.alias("release"), pre.cast("long").alias("pre"), F.when(stage.isNotNull(), number(got(4))).otherwise(0).cast("long").alias("pre_n"),
        F.when(got(5) == "", _NEVER).otherwise(number(got(5))).cast("long").alias("post"), F.when(got(6) == "", _EVER).otherwise(number(got(6))).cast("long").alias("dev"),
    )
    return F.when(low.rlike(_PEP), F.struct(key.alias("key"), written.alias("written"), F.regexp_replace(got(7), "[-_]", ".").alias("local")))


def _pep_meets(spec: Column, v: Column, version: Column) -> Column:
    """Whether a version meets one specifier of Python's; null if it is none."""
    op = F.regexp_extract(spec, r"\A(===|~=|==|!=|<=|>=|<|>)", 1)
    body = F.trim(F.substr(spec, F.char_length(op) + 1))
    wild = body.endswith(".*")
    n = lambda a: F.size(a)

    def padded(release: Column, to: Column) -> Column:
        return F.slice(F.concat(release, F.array_repeat(F.lit(0).cast("long"), F.greatest(to - F.size(release), F.lit(0)))), F.lit(1), to)

    def told(s: Column) -> Column:
        key = v["key"]
        is_pre = lambda x: (x["key"]["pre"] < 9) | (x["key"]["dev"] < _EVER)
        begins = (key["epoch"] == s["key"]["epoch"]) & (padded(v["written"], n(s["written"])) == s["written"])
        equal = (key == s["key"]) & ((s["local"] == "") | (s["local"] == v["local"]))
        short = F.slice(s["written"], F.lit(1), F.greatest(n(s["written"]) - 1, F.lit(1)))
        compatible = (key >= s["key"]) & (key["epoch"] == s["key"]["epoch"]) & (padded(v["written"], n(short)) == short)
        bare = s["local"] == ""
        # Below a version doesn't mean its own pre-releases, above it not its own post-releases.
        zero, post = F.lit(0).cast("long"), s["key"]["post"]
        first = F.struct(s["key"]["epoch"].alias("epoch"), s["key"]["release"].alias("release"), F.when(post == _NEVER, F.lit(_NEVER).cast("long")).otherwise(s["key"]["pre"]).alias("pre"), F.when(post == _NEVER, zero).otherwise(s["key"]["pre_n"]).alias("pre_n"), post.alias("post"), zero.alias("dev"))
        below = (key < s["key"]) & ~(is_pre(v) & ~is_pre(s) & (key >= first))
        unposted = F.struct(key["epoch"].alias("epoch"), key["release"].alias("release"), key["pre"].alias("pre"), key["pre_n"].alias("pre_n"), F.lit(_NEVER).cast("long").alias("post"), F.lit(_EVER).cast("long").alias("dev"))
        above = (key > s["key"]) & ~((key["post"] > _NEVER) & (unposted == s["key"]))
        final = (s["key"]["pre"] == 9) & (s["key"]["post"] == _NEVER) & (s["key"]["dev"] == _EVER) & bare
        return (
            F.when(wild & op.isin("==", "!=") & final, F.when(op == "==", begins).otherwise(~begins))
            .when(wild, F.lit(None).cast("boolean"))
            .when(op == "==", equal).when(op == "!=", ~equal)
            .when(bare & (op == "<="), key <= s["key"]).when(bare & (op == ">="), key >= s["key"]).when(bare & (op == "<"), below).when(bare & (op == ">"), above)
            .when(bare & (op == "~=") & (n(s["written"]) > 1), compatible)
        )

    parsed = _let(_pep(F.when(wild, F.substr(body, F.lit(1), F.char_length(body) - 2)).otherwise(body)), lambda s: F.when(s.isNotNull(), told(s)))
    return F.when(op == "===", F.lower(body) == F.lower(F.trim(version))).when(op != "", parsed)


def pep440_satisfies(constraint: Column, version: Column) -> Column:
    """Whether a version lies in a set of Python's specifiers (== != <= >= < > ~= ===, wildcards after == and !=), all of which must hold.

    Pre-releases count like any other: a locked version is a fact. Null where the version, or any specifier, isn't of that form.
    """
    specs = F.filter(F.transform(F.split(constraint, ","), lambda x: F.trim(x)), lambda x: x != "")

    def told(v: Column) -> Column:
        met = F.transform(specs, lambda x: _pep_meets(x, v, version))
        return _let(met, lambda m: F.when(v.isNotNull() & ~F.exists(m, lambda x: x.isNull()), F.forall(m, lambda x: x)))

    return _let(_pep(version), told)


def satisfies(ecosystem: Column, constraint: Column, version: Column) -> Column:
    """By ecosystem: an exact version (go), a bare version as ^ (cargo) or as = (composer), Python's specifiers first (python), semantic ranges otherwise; null where either is empty or a form isn't known."""
    bare = F.trim(constraint)
    full = bare.rlike(r"\Av?\d+\.\d+\.\d+\z")
    form = (
        F.when((ecosystem == "cargo") & bare.rlike(r"\Av?\d+(?:\.\d+){0,2}\z"), F.concat(F.lit("^"), bare))
        .when((ecosystem == "composer") & full, F.concat(F.lit("="), bare))
        .when((ecosystem == "composer") & bare.rlike(r"\A~?v?\d+(?:\.\d+)?\z"), "unknown")
        .when((ecosystem == "python") & full, F.concat(F.lit("="), bare))
        .when((ecosystem == "python") & ~bare.rlike(r"\A[\^~]"), "unknown")
        .otherwise(bare)
    )
    python = F.when(ecosystem == "python", pep440_satisfies(bare, version))
    told = F.when(ecosystem == "go", bare == F.trim(version)).otherwise(F.coalesce(python, semver_satisfies(form, version)))
    return F.when((F.coalesce(constraint, F.lit("")) != "") & (F.coalesce(version, F.lit("")) != ""), told)
