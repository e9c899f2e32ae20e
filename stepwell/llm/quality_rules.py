"""Quality rules with adaptive thresholds.

Every document gets a handful of measures. Instead of fixed cutoffs, a measure is judged
against what is usual for documents of the same language and source: per (lang, source)
a KLL quantile sketch is built of each measure. Sketches merge, so those of a language
are merged from those of its sources, and those of the corpus from those of the
languages, without reading a document again. A group with too few documents takes the
sketch of its language, then that of the corpus. The limits are joined to the documents and applied.

Only Column expressions, aggregates and joins; texts never leave the scan. A hot source costs
one partial sketch per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwell.llm.common import Stored, column

#: White space of the word pattern: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0d]+"
SYMBOLS = "[#*$%&|<>]+"
#: Low bits of a packed window: its position; a string has fewer than 2**30 words.
PLACE_BITS = 30

#: Ratio -> prior distance between the median and the limit, for a group whose quantiles below the median tell none: a ratio
#: that is zero in a tenth of the group is cut off at zero. The prior is scaled by what the sketch says of the positive part:
#: ``REACH`` times its upper quartile over the prior, from 1/SWING to SWING, to the power of the share of documents that are positive.
#: So a group where few have any keeps near the prior, and one where most have some gets a limit of its own.
RATIOS = {"symbol_ratio": 0.15, "dup_line_ratio": 0.4, "repeat_ratio": 0.25, "capital_ratio": 0.3, "bang_ratio": 0.15}
SWING = 2.0
#: Elsewhere a limit lies so many times as far above the median as the 10 % quantile lies below it. Junk has
#: high ratios: it takes up quantiles above the median first and, up to half of a group, none below it.
REACH = 4.0
LOWER = 0.1
UPPER = 0.75
#: Share of the distance in RATIOS that is the least one; a smaller difference has no meaning.
LEAST = 0.1
MIN_GROUP = 100
SKETCH_K = 400

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def _candidates(words: Column, n_words: Column) -> Column:
    """Starts of the windows whose hash bits occur twice, a superset of the repeated windows."""
    mask = (1 << PLACE_BITS) - 1
    packed = F.transform(
        F.slice(words, 1, F.greatest(n_words - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(~mask).bitwiseOR(i.cast("bigint")),
    )
    return F.sort_array(packed)


def _repeated(ordered: Column) -> Column:
    """Of packed windows in order, those whose hash bits equal a neighbour's."""

    def same(a: Column, b: Column) -> Column:
        return F.coalesce(F.shiftright(a, PLACE_BITS) == F.shiftright(b, PLACE_BITS), F.lit(False))

    return F.filter(ordered, lambda v, i: same(v, F.get(ordered, i - 1)) | same(v, F.get(ordered, i + 1)))


def _exact(windows: Column) -> Column:
    """Starts of windows (struct of three words and a place, in order) that equal a neighbour."""

    def same(a: Column, b: Column) -> Column:
        return F.coalesce((a["a"] == b["a"]) & (a["b"] == b["b"]) & (a["c"] == b["c"]), F.lit(False))

    kept = F.filter(windows, lambda v, i: same(v, F.get(windows, i - 1)) | same(v, F.get(windows, i + 1)))
    return F.transform(kept, lambda v: v["p"])


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add struct ``_m`` with the measures of every whole text (null counts as empty).

    ``n_repeat_words`` counts words that lie in a window of three words that occurs twice
    or more in the text. Windows are compared by hash first; those that meet are compared
    word by word, so the count is exact.
    """
    body = F.coalesce(column(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    bare = F.octet_length(body)
    df = docs.select(
        F.struct("*").alias("_row"),
        _words(body).alias("_words"),
        lines.alias("_lines"),
        (bare - F.octet_length(F.regexp_replace(body, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (bare - F.octet_length(F.regexp_replace(body, "[A-Z]+", ""))).alias("_capitals"),
        (bare - F.octet_length(F.replace(body, F.lit("!"), F.lit("")))).alias("_bangs"),
        bare.alias("_bytes"),
    )
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("bigint"),
            "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
            "_n_lines": F.size("_lines"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "_packed": _candidates(F.col("_words"), F.size("_words")),
        }
    )
    df = df.withColumn("_near", _repeated(F.col("_packed"))).drop("_packed")
    words, mask = F.col("_words"), (1 << PLACE_BITS) - 1

    def window(v: Column) -> Column:
        p = v.bitwiseAND(mask).cast("int")
        return F.struct(
            F.get(words, p).alias("a"), F.get(words, p + 1).alias("b"), F.get(words, p + 2).alias("c"), p.alias("p")
        )

    df = df.withColumn("_windows", F.sort_array(F.transform("_near", window)))
    starts = _exact(F.col("_windows"))
    covered = F.array_distinct(F.flatten(F.transform(starts, lambda p: F.array(p, p + 1, p + 2))))
    df = df.withColumn("n_repeat_words", F.size(covered).cast("bigint"))
    letters = F.greatest(F.col("word_chars"), F.lit(1))
    some = F.greatest(F.col("n_words"), F.lit(1))
    return df.select(
        "_row",
        F.struct(
            *MEASURES,
            (F.col("n_symbols") / some).alias("symbol_ratio"),
            (F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1))).alias("dup_line_ratio"),
            (F.col("n_repeat_words") / some).alias("repeat_ratio"),
            (F.col("_capitals") / letters).alias("capital_ratio"),
            (F.col("_bangs") / some).alias("bang_ratio"),
        ).alias("_m"),
    )


def _base_failed() -> Column:
    n, repeated = F.col("_m.n_words"), F.col("_m.n_repeat_words")
    return (n < 50) | (100 * repeated > 50 * n)


def limits(measured: DataFrame) -> DataFrame:
    """Limit of each ratio per (_lang, _source), from sketches; one row per pair that occurs.

    Documents that fail the base rules are left out of the sketches. Where all of the corpus fails, limits are null.
    """
    sound = ~_base_failed()

    def sketch_of(ratio: str, condition: Column) -> Column:
        return F.kll_sketch_agg_double(F.when(condition, F.col(f"_m.{ratio}")), F.lit(SKETCH_K))

    sketches = measured.groupBy("_lang", "_source").agg(
        F.count_if(sound).alias("n"),
        *[sketch_of(r, sound).alias(r) for r in RATIOS],
        *[sketch_of(r, sound & (F.col(f"_m.{r}") > 0)).alias(f"some_{r}") for r in RATIOS],
    )
    parts = [*RATIOS, *(f"some_{r}" for r in RATIOS)]

    def merged(by: list[str]) -> DataFrame:
        return sketches.groupBy(*by).agg(
            F.sum("n").alias("n"), *[F.kll_merge_agg_double(r, F.lit(SKETCH_K)).alias(r) for r in parts]
        )

    by_lang, whole = merged(["_lang"]).alias("l"), merged([]).alias("w")
    joined = (
        sketches.alias("s")
        .join(by_lang, F.col("s._lang").eqNullSafe(F.col("l._lang")), "left")
        .join(F.broadcast(whole), F.lit(True), "left")  # one row
    )

    def limit(ratio: str, spread: float) -> Column:
        def chosen(name: str) -> Column:
            return (
                F.when(F.col("s.n") >= MIN_GROUP, F.col(f"s.{name}"))
                .when(F.col("l.n") >= MIN_GROUP, F.col(f"l.{name}"))
                .when(F.col("w.n") > 0, F.col(f"w.{name}"))
            )

        sketch = chosen(ratio)
        middle = F.kll_sketch_get_quantile_double(sketch, F.lit(0.5))
        lower = F.kll_sketch_get_quantile_double(sketch, F.lit(LOWER))
        zeros = F.kll_sketch_get_rank_double(sketch, F.lit(0.0))
        positive = F.when(zeros < 1, F.kll_sketch_get_quantile_double(chosen(f"some_{ratio}"), F.lit(UPPER)))
        scale = F.least(F.greatest(F.lit(REACH / spread) * F.coalesce(positive, F.lit(0.0)), F.lit(1 / SWING)), F.lit(SWING))
        least = F.when(lower > 0, F.lit(LEAST * spread)).otherwise(F.lit(spread) * F.pow(scale, 1 - zeros))
        return (middle + F.greatest(F.lit(REACH) * (middle - lower), least)).alias(f"max_{ratio}")

    return joined.select(
        F.col("s._lang").alias("_lang"), F.col("s._source").alias("_source"), *[limit(r, d) for r, d in RATIOS.items()]
    )


def judge(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", carry: list[str] | None = None
) -> DataFrame:
    """Measures and verdict of every row: struct ``_row`` (columns in ``carry``; all if None), the
    measures, the ratios, ``base_failed`` and ``kept``.

    Null or empty text: zero words, so ``base_failed``. Null language or source is a group of
    its own. Repeated rows are judged alike, each on its own. No rows give no rows.
    """
    store = Stored(docs.sparkSession)
    rows = measures(docs, text)
    own = F.col("_row") if carry is None else F.struct(*[F.col("_row")[c].alias(c) for c in carry])
    measured = store.keep(
        rows.select(own.alias("_row"), "_m", F.col("_row")[lang].alias("_lang"), F.col("_row")[source].alias("_source"))
    )
    cut = limits(measured).select(F.col("_lang").alias("_l"), F.col("_source").alias("_s"), *[f"max_{r}" for r in RATIOS])
    joined = measured.join(cut, F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s")), "left")
    failed = _base_failed()
    usual = F.lit(True)
    for ratio in RATIOS:
        usual = usual & (F.col(f"_m.{ratio}") <= F.col(f"max_{ratio}"))
    return joined.select("_row", "_m.*", failed.alias("base_failed"), (~failed & usual).alias("kept"))


def filter_documents(docs: DataFrame, **names: str) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns they came with."""
    return judge(docs, **names).filter("kept").select("_row.*")
