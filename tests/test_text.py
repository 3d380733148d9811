"""White space found quickly is the listed white space; batches that go to Python are bounded in bytes."""

import pandas as pd
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import cleaning as C
from lectern.session import BATCH_BYTES, tune


def test_quick_white_space_is_the_listed_one(spark):
    points = [chr(c) for c in range(0x11000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c,) for c in points], "c string")
    assert df.filter(F.col("c").rlike(f"^{T.WS}$") != F.col("c").rlike(f"^{T.WS_LIST}$")).count() == 0
    assert df.filter(F.contains(F.lit(T.WS_CHARS), F.col("c")) != F.col("c").rlike(f"^{T.WS_LIST}$")).count() == 0


def test_squeezing_trimming_and_joining_as_the_plain_patterns(spark):
    blank = ["", " ", "  ", "\n", " ", "  ", " \u0085", "﻿\t", "\u0085"]
    texts = [a + "x" + b + "y-\nz-\nw" + c for a in blank for b in blank for c in blank] + blank
    texts += ["a\nb\nc", "a\n(b", "a-\nb-\nc", "a,\nb;\nC", "1\na", "é\na", "a\n\nb"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    t, ws = F.col("t"), T.WS_LIST
    strip = F.regexp_replace(t, f"^{ws}+|{ws}+$", "")
    layout = F.regexp_replace(F.regexp_replace(t, C.HYPHEN_BREAK, "$1$2"), r"([a-z0-9,;:])\n(?=[a-z(])", "$1 ")
    layout = F.regexp_replace(F.regexp_replace(layout, "[ ]{2,}", " "), f"{ws}+([.,;:!?])", "$1")
    layout = F.regexp_replace(F.regexp_replace(layout, r"\n{3,}", "\n\n"), f"^{ws}+|{ws}+$", "")
    no_tab = ~F.contains(t, F.lit("\t"))
    pairs = [(T.strip(t), strip), (T.squeeze(t), F.regexp_replace(t, ws + "+", " "))]
    for new, plain in pairs:
        assert df.filter(~new.eqNullSafe(plain)).collect() == []
    assert df.filter(no_tab & ~C.normalise_layout(t, True).eqNullSafe(layout)).collect() == []
    assert df.filter(t.isNotNull() & (C.count_hyphens(t) != F.regexp_count(t, F.lit(C.HYPHEN_BREAK)))).collect() == []


def test_batches_for_python_are_bounded(spark):
    @F.pandas_udf("long")
    def size(texts: pd.Series) -> pd.Series:
        return pd.Series([int(texts.str.len().sum())] * len(texts))

    wide = tune(spark).range(0, 1000, 1, 1).select(F.repeat(F.lit("x"), 50_000).alias("t"))
    assert wide.select(size("t").alias("n")).agg(F.max("n")).first()[0] <= BATCH_BYTES + 50_000
