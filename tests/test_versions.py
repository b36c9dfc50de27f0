"""Python's specifiers against the packaging library's rules, spelled out."""

import pytest
from pyspark.sql import functions as F

from revlens.functions import versions

CASES = [
    ("~=1.4", "1.9.0", True), ("~=1.4", "2.0", False), ("~=1.4.2", "1.4.9", True), ("~=1.4.2", "1.5.0", False), ("~=1", "1.0", None), ("==1.0", "1.0.0", True), ("==1.0", "1.0.1", False), ("==1.*", "1.9.3", True), ("==1.1.*", "1.10", False),
    ("!=1.5", "1.5", False), ("!=1.5", "1.5.1", True), ("!=1.*", "1.3", False), (">=1,<2", "1.99", True), (">=1,<2", "2.0", False), ("<2", "2.0rc1", False), ("<2", "1.9rc1", True), ("<2rc2", "2rc1", True), (">1.0", "1.0.post1", False), (">1.0", "1.0.1", True),
    (">1.0", "1.1.post1", True), (">=1.0a1", "1.0.dev3", False), (">=1.0", "1.0rc1", False), ("==1.0+abc", "1.0+abc", True), ("==1.0", "1.0+abc", True), ("==1.0+x", "1.0", False), ("===1.0", "1.0", True), ("===1.0", "1.0.0", False), ("==1!2.0", "2.0", False),
    ("^1.2", "1.9.0", True), ("~1.2", "1.2.9", True), ("~1.2", "1.3.0", False), ("1.2.3", "1.2.3", True), ("1.2.3", "1.2.4", False), ("latest", "1.0.0", None), ("1.2", "1.2.0", None), ("", "1.0", None), (">=1", "not.a.version", None), (" >= 1.0 , != 1.3 ", "1.2", True), ("==1.0.0.0", "1", True),
    ("<=1.0", "1.0+local", True), ("==2.0rc1", "2.0c1", True), ("==1.0", "v1.0", True),
]


@pytest.mark.parametrize("pair", [CASES])
def test_python_constraints(spark, pair):
    frame = spark.createDataFrame([(k, c, v) for k, (c, v, _) in enumerate(pair)], "k int, c string, v string")
    got = {r.k: r.x for r in frame.select("k", versions.satisfies(F.lit("python"), F.col("c"), F.col("v")).alias("x")).collect()}
    assert {pair[k][:2]: x for k, x in got.items()} == {(c, v): w for c, v, w in pair}


def test_the_same_as_the_library(spark):
    """Where the packaging library is at hand, any pair of versions and specifiers."""
    specifiers = pytest.importorskip("packaging.specifiers")
    version = pytest.importorskip("packaging.version")
    names = ["1", "1.0", "1.0.0", "1.0a1", "1.0b2.dev3", "1.0rc1", "1.0.post1", "1.0.dev1", "1.1", "1.10", "1.9.3", "2.0", "2.0.post2.dev1", "1!1.0", "0.9", "1.0.0.1"]
    pairs = [(f"{op}{s}", v) for op in ("==", "!=", "<=", ">=", "<", ">", "~=") for s in names for v in names if not (op == "~=" and s == "1")]
    pairs += [(f"{op}{s}.*", v) for op in ("==", "!=") for s in ("1", "1.0", "1.1", "1!1") for v in names]
    frame = spark.createDataFrame([(k, c, v) for k, (c, v) in enumerate(pairs)], "k int, c string, v string")
    got = {r.k: r.x for r in frame.select("k", versions.pep440_satisfies(F.col("c"), F.col("v")).alias("x")).collect()}
    want = {k: specifiers.SpecifierSet(c).contains(version.Version(v), prereleases=True) for k, (c, v) in enumerate(pairs)}
    assert {pairs[k]: x for k, x in got.items()} == {pairs[k]: x for k, x in want.items()}
