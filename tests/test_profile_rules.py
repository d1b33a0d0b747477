"""Row-local profile rules: the cheaper forms equal the plain ones, and each test of a line stands once."""

from pyspark.sql import functions as F

from talentgrid import fixed_values as V
from talentgrid.functions import text as T
from talentgrid.functions.lists import strip
from talentgrid.functions.tokens import first_occurrence, occurrences
from talentgrid.operators import profile as P


def test_a_line_is_squeezed_and_tried_once(spark):
    plan = spark.createDataFrame([("a\nb",)], "text string").select(P.line_sections(F.col("text")))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    # every expression is printed twice; 20 before
    assert text.count("regexp_replace(") <= 4


def test_white_space_is_cut_as_by_the_pattern(spark):
    ends = ["", " ", "\t\n", "\x85", "\xa0 ", " ", " ", "  ", ". ", "​", "\x1c", "　."]
    df = spark.createDataFrame([(a + "a  b\xa0c" + b,) for a in ends for b in ends] + [(None,)], "t string")
    t = F.col("t")
    cut = lambda cls: F.regexp_replace(t, f"^[{cls}]+|[{cls}]+$", "")
    pairs = [(strip(t), F.regexp_replace(t, r"(?U)^\s+|\s+$", "")), (T.strip_any(t, r"\s"), cut(r"\s")),
             (T.strip_any(t, " ,.\\-"), cut(" ,.\\-")),
             (T.squeeze(t), F.regexp_replace(F.regexp_replace(t, "[\\s\xa0]+", " "), r"(?U)^\s+|\s+$", ""))]
    assert df.select(*[F.sum((~a.eqNullSafe(b)).cast("int")).alias(str(i)) for i, (a, b) in enumerate(pairs)]).first() == (0,) * 4


def test_led_patterns_find_what_the_plain_ones_find(spark):
    texts = ["May 2011 - now", "in 1999", "ſep", "0812 34567", "+62 (812) 345-6789", "Tahun 5", "5+ years", "MARKS 3", "x2012", "mayor"]
    df = spark.createDataFrame([(s,) for s in texts], "t string")
    pairs = [(T.PHONE, V.PHONE), (T.DATE_WORD, V.DATE_WORD), (T.DURATION, V.DURATION), (T.MONTH_RANGE, V.MONTH_RANGE),
             (T.YEAR_RANGE, V.YEAR_RANGE), (T.YEAR_ANY, V.YEAR_ANY), (T.GRADE_WORD, V.GRADE_WORD)]
    for led, plain in pairs:
        rows = df.select(T.first_match(F.col("t"), led).alias("a"), T.first_match(F.col("t"), plain).alias("b")).collect()
        assert [r.a for r in rows] == [r.b for r in rows]


def test_first_occurrence_and_sections_agree_with_all_occurrences(spark):
    rows = [("aa", "baaaa", s, e) for s in range(5) for e in range(6)] + [
        ("", "abc", 0, 3), ("X", "axbX", 2, 4), ("x.", "ax", 0, 2), ("b", "abcb", 0, 1), ("b", "abcb", 3, 4)]
    df = spark.createDataFrame(rows, "e string, t string, s int, z int")
    e, t = F.col("e"), F.col("t")
    every = occurrences(e, t)
    sec = F.struct(F.col("s").alias("start"), F.col("z").alias("end"))
    got = df.select(
        first_occurrence(e, t).alias("f"), F.coalesce(F.get(every, F.lit(0)), F.lit(-1)).alias("o"),
        P.in_section(e, t, sec).alias("i"), F.exists(every, lambda p: (p >= F.col("s")) & (p < F.col("z"))).alias("x")).collect()
    assert all(r.f == r.o and r.i == r.x for r in got)
