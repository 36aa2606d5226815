"""Patterns: the same for Spark, in memory, and by hand."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from docframe.errors import QueryError
from docframe.plans import patterns as P

#: pattern, a text where it is found, a text where it is not
CASES = [
    ("a$", "ba", "a\n"), ("^a", "ab", "\na"), ("a.c", "a\rc", "a\nc"), ("(?s)a.c", "a\nc", "ac"), ("(?m)^b$", "a\nb", "a\rb"), ("(?m)a$", "a\n", "ab"), ("(?m)^$", "a\n", "a"), ("^$", "", "\n"),
    ("(?i)straße", "STRASSE STRAßE", "strase"), ("a(?i)b|c", "aB", "Ab"), ("a(?i)b|c", "C", "A"), ("(a(?i)b)c", "aBc", "aBC"), ("(?i:a)b", "Ab", "AB"), ("(?i)a(?-i)b", "Ab", "AB"),
    ("\\d{2}", "٣٤", "3x"), ("\\w+$", "héé", "h "), ("\\bfix\\b", "a fix.", "fixes"), ("\\p{L}\\P{L}", "é1", "é"), ("\\p{Greek}", "λ", "l"), ("\\x{1F600}|\\u00e9", "😀", "e"), ("\\x41", "A", "a"),
    ("[[:alpha:]_]+$", "ab_", "é"), ("[^\\d\\]]", "x", "5]"), ("[]a]", "]", "b"), ("[a\\-z]", "-", "m"), ("[&|#]", "&", "-"), ("(?x) a b # no\n c", "abc", "a b c"), ("(?P<n>a)(?<m>b)", "ab", "a"),
    ("x{2,3}?y", "xxy", "xy"), ("a\\.b", "a.b", "axb"), ("\\Aab\\z", "ab", "ab\n"), ("\\v", "\x0b", "\n"), ("\\s", "\u00a0", "x"), ("a|^$|b$", "xb", "bx"), ("\\/\\#\\&", "/#&", "/#"), ("(?:)", "", None), (" ~", " ~", "~ "),
]


def test_found_and_not_found(spark):
    rows = [(i, t, w) for i, (_, yes, no) in enumerate(CASES) for t, w in ((yes, True), (no, False)) if t is not None]
    df = spark.createDataFrame(rows, "i int, t string, w boolean")
    hit = F.lit(None)
    for i, (p, _, _) in enumerate(CASES):
        hit = F.when(F.col("i") == i, F.col("t").rlike(P.java_pattern(p))).otherwise(hit)
    for r in df.withColumn("hit", hit).collect():
        assert r["hit"] == r["w"], (CASES[r["i"]], r["t"])
    for i, t, w in rows:
        assert P.found(CASES[i][0])(t) == w, (CASES[i][0], t)


def test_both_translations_agree(spark):
    rng = random.Random(1)
    atoms = ["a", "B", ".", "$", "^", "\\d", "[ab\\n]", "(a|b)", "(?i:b)", "(?m)", "(?s)", "(?i)", "\\b", "\\s", "|", "(?:a$)", "(?m:^a)", "a*", "b?", "\\n"]
    made = {"".join(rng.choice(atoms) for _ in range(rng.randint(1, 5))) for _ in range(150)}
    texts = ["".join(x) for n in range(4) for x in itertools.product("aB\n\r", repeat=n)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for some in (sorted(made)[i::5] for i in range(5)):
        got = df.select("t", *[F.col("t").rlike(P.java_pattern(p)).alias(f"p{i}") for i, p in enumerate(some)]).collect()
        for i, p in enumerate(some):
            test = P.found(p)
            for r in got:
                assert r[f"p{i}"] == test(r["t"]), (p, r["t"])


@pytest.mark.parametrize("pattern", ["(", ")", "a++", "(?=a)", "(?<!a)", "(?>a)", "\\1", "\\k<a>", "\\G", "\\Z", "[a&&b]", "[a[b]]", "[a", "*", "a{", "a**", "(?U)a", "(?R)a", "(?-u)a", "(?)", "\\", "\\h", "a\\b{start}", "x" * 4097, "é" * 2049])
def test_refused(pattern):
    with pytest.raises(QueryError):
        P.python_pattern(pattern)


def test_prefix():
    assert [P.literal_prefix(p) for p in ("^Fix(es)?", "^ab*", "^a|b", "a", "^a\\.b", "^é$")] == ["Fix", "a", "", "", "a.b", "é"]
