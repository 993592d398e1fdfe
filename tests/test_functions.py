import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.functions import coerce, signals, stats, text


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


@pytest.mark.parametrize("raw, want", [("12.5", 12.5), (" 3 ", 3), ("", 0), (None, 0), ("12.5d", 0), ("1_000", 0), ("-1e3", -1000), (".5", 0.5), ("x", 0)])
def test_number(spark, raw, want):
    assert one(spark, v=coerce.number(F.lit(raw).cast("string"))).v == want


def test_flags_differ_on_y(spark):
    got = one(spark, a=coerce.truthy(F.lit("y")), b=coerce.yes(F.lit(" Y ")), c=coerce.truthy(F.lit(None)), d=coerce.arm(F.lit("")), e=coerce.arm(F.lit("PROTO")), f=coerce.whole(F.lit("-2.9")))
    assert (got.a, got.b, got.c, got.d, got.e, got.f) == (False, True, False, "apple", "proto", -2)


@pytest.mark.parametrize("k, n, t, low, high, verdict, spans", [(8, 10, 0.7, 0.4902, 0.9433, "PASS", True), (7, 8, 0.7, 0.5291, 0.9776, "PASS", True), (4, 10, 0.4, 0.1682, 0.6873, "PASS", True), (10, 10, 0.5, 0.7225, 1.0, "PASS", False), (0, 0, 0.5, 0, 0, "FAIL", False)])
def test_proportion(spark, k, n, t, low, high, verdict, spans):
    got = one(spark, **stats.proportion(F.lit(k), F.lit(n), t))
    assert (round(got.low, 4), round(got.high, 4), got.verdict, got.inconclusive) == (low, high, verdict, spans)
    assert got.resolved == ("NO DATA" if not n else "INCONCLUSIVE" if spans else verdict)


@settings(max_examples=15, deadline=None)
@given(st.integers(1, 500), st.floats(0, 1))
def test_interval_holds_the_share(spark, n, share):
    k = round(n * share)
    got = one(spark, **stats.proportion(F.lit(k), F.lit(n), 0.5))
    assert 0 <= got.low <= got.p + 1e-12 and got.p - 1e-12 <= got.high <= 1


def test_kappa(spark):
    rows = [("S", "S")] * 6 + [("C", "C")] + [("S", "C")] + [("", "S"), (None, "C")]
    got = stats.kappa(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    assert got.n == 8 and got.observed == 0.875 and got.expected == pytest.approx(0.6875) and got.kappa == pytest.approx(0.6)
    same = stats.kappa(spark.createDataFrame([("S", "S")] * 3, "a string, b string"), "a", "b").first()
    assert same.kappa == 1
    none = stats.kappa(spark.createDataFrame([("", "S")], "a string, b string"), "a", "b").first()
    assert none.n == 0 and none.kappa is None
    bands = one(spark, a=stats.kappa_band(F.lit(0.6)), b=stats.kappa_band(F.lit(0.59)), c=stats.kappa_band(F.lit(None).cast("double")))
    assert (bands.a, bands.b, bands.c) == ("substantial", "moderate", "NO DATA")


def gate(spark, shot, w, h, score):
    g = one(spark, g=signals.gate(F.lit(shot), F.lit(w), F.lit(h), F.lit(score))).g
    return g.run, g.reason


def test_gate(spark):
    assert gate(spark, False, 4032, 3024, 0.1) == (False, "gated-out")
    assert gate(spark, True, 0, 0, 0.0) == (True, "screenshot-subtype")
    assert gate(spark, False, 1170, 2532, 0.0) == (True, "screen-aspect")
    assert gate(spark, False, 100, 100, 0.9) == (True, "text-likelihood")
    assert gate(spark, False, 0, 0, 0.0)[1] == "gated-out"
    assert gate(spark, False, 10, 16, 0.55)[1] == "gated-out" and gate(spark, False, 10, 24, 0.55)[1] == "gated-out"


def test_difference_hash(spark):
    ramp = [v for _ in range(8) for v in range(9)]
    got = one(spark, up=signals.difference_hash(F.array(*map(F.lit, ramp))), down=signals.difference_hash(F.array(*(F.lit(9 - v) for v in ramp))), flat=signals.difference_hash(F.array(*[F.lit(1)] * 72)), none=signals.difference_hash(F.array(F.lit(1))))
    assert (got.up, got.down, got.flat, got.none) == (0, -1, 0, None)
    assert one(spark, h=signals.hamming(F.lit(5).cast("long"), F.lit(-1).cast("long"))).h == 62


def test_likelihood(spark):
    flat = one(spark, v=text.array_likelihood(F.array(*[F.lit(7)] * 50))).v
    stripes = one(spark, v=text.array_likelihood(F.array(*[F.lit(v) for v in [0, 255] * 25]))).v
    assert flat == 0.5 and stripes == 1.0 and one(spark, v=text.likelihood(F.lit(""))).v == 0


def test_likelihood_reads_the_whole_text(spark):
    def brute(t):
        codes = [min(ord(x), 255) for x in t]
        edges = sum(abs(a - b) > 40 for a, b in zip(codes, codes[1:]))
        peak = max(sum(c // 16 == b for c in codes) for b in range(16))
        return min(1.0, 1.5 * edges / (len(codes) - 1) + 0.5 * peak / len(codes))

    opening = "word " * 820
    texts = [opening, opening + "a" * 9000, opening + "a zé\n" * 2000]
    got = [one(spark, v=text.likelihood(F.lit(t))).v for t in texts]
    assert got == pytest.approx([brute(t) for t in texts]) and len(set(got)) == 3


def test_text(spark):
    md = "see [a](docs/x.md:12#top) [b](https://e.org) [c](mailto:a@b) [d](#here) and `run.py` `*.md` `notes.txt`"
    got = one(spark, l=text.links(F.lit(md)), f=text.file_references(F.lit(md)), s=text.slug(F.lit("Places > New York & Co·")), e=text.escape_html(F.lit("<a & 'b'>")), t=text.strip_tags(F.lit("<p>a &amp;lt; b</p><p></p><p></p>c<br/>d")), x=text.section(F.lit("# A\none\n## B\ntwo\n# C\n"), "B"))
    assert got.l == ["docs/x.md"] and got.f == ["run.py", "notes.txt"] and got.s == "places_new-york-and-co"
    assert got.e == "&lt;a &amp; &#x27;b&#x27;&gt;" and got.x.strip() == "two"
    assert got.t == "a &lt; b\n\nc\nd"


def test_small_signals(spark):
    got = one(spark, c=signals.chip(F.lit(" "), F.lit("iPhone14,5"), {"iPhone14": "A15"}), d=signals.chip(F.lit("a12"), F.lit("x"), {"iPhone14": "A15"}), q=signals.chip(F.lit(None), F.lit("iPad"), {"iPhone14": "A15"}), r=signals.rank(["a", "b"], F.lit("b")), u=signals.rank(["a"], F.lit("z")), g=signals.degrees_minutes(F.lit(-12.5)), v=coerce.ratio(F.lit(1.0), F.lit(0.0)), dist=signals.distance(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0))))
    assert (got.c, got.d, got.q, got.r, got.u, got.g.degrees, got.g.minutes, got.v, got.dist) == ("A15", "A12", "?", 1, -1, 12, 30, 0, 5)
    assert math.isfinite(got.dist)


def test_report_writes_all_rows(spark):
    from ledgerline.sources import files

    assert files.report(spark.range(1500), "t").count("\n") == 4 + 1500
