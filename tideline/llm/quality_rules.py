"""Quality rules whose thresholds follow the corpus: quantile sketches by language and source.

DataFrame functions only. Each text is measured once; quantile summaries, which Spark merges across
tasks, give every (language, source) its own limit for each ratio, and a join applies them. No limit is a
number given here: it is where the group's own upper tail thins out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

#: A packed window is the upper 40 bits of its hash and its place in the lower 24.
_PLACE = 24
_LONG = 1 << _PLACE
_SPACES = "[\\x20\\x09-\\x0D]+"

#: What is judged beyond the base rules: (numerator, denominator) among the measures.
RATIOS = {"symbol_ratio": ("n_symbols", "word_chars"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "repeat_ratio": ("n_repeat_words", "n_words"), "long_words": ("word_chars", "n_words")}
#: The quantiles whose distance tells how wide a group's body is.
BODY = (0.5, 0.75)
#: The share of a group's texts that a ratio leaves alone where most texts have none of what it counts.
SPARED = {"symbol_ratio": 0.9, "dup_line_ratio": 0.99, "repeat_ratio": 0.99, "long_words": 0.99}


#: SQL: places j in the sorted packed windows ``s`` whose hash is that of place j - 1.
_SAME = f"filter(sequence(1, size(s) - 1), j -> shiftright(s[j], {_PLACE}) = shiftright(s[j - 1], {_PLACE}))"


def _repeats() -> str:
    """SQL for the number of words in 3-word windows found twice or more, from the words ``w``, ``s`` and its same places ``e``."""

    def covered(same: str, *starts: str) -> str:
        places = ", ".join(f"{p} + {k}" for p in starts for k in range(3))
        return f"size(array_distinct(flatten(transform({same}, j -> array({places})))))"

    at = lambda j: f"cast(s[{j}] & {_LONG - 1} AS int)"
    differ = " OR ".join(f"w[{at('j')} + {k}] <> w[{at('j - 1')} + {k}]" for k in range(3))
    whole = "array_sort(transform(sequence(0, size(w) - 3), i -> struct(w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, i AS i)))"
    equal = "filter(sequence(1, size(z) - 1), j -> z[j].a = z[j - 1].a AND z[j].b = z[j - 1].b AND z[j].c = z[j - 1].c)"
    exact = f"transform(array({whole}), z -> {covered(equal, 'z[j - 1].i', 'z[j].i')})[0]"
    fast = covered("e", at("j - 1"), at("j"))
    return f"CASE WHEN size(w) < 4 THEN 0 WHEN s IS NULL OR exists(e, j -> {differ}) THEN {exact} ELSE {fast} END"


def measure(docs: DataFrame, into: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all if None) and a struct column ``into``: n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed.

    Windows are compared by a 40-bit hash first; where two of one hash differ, and in texts of 2^24
    words or more, whole windows are compared instead. A null text has no words.
    """
    keep = docs.columns if keep is None else keep
    held = F.struct(*[F.col(c) for c in keep]).alias("held")
    t = docs.select(held, F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    t = t.select("held", "t", F.array_remove(F.split("t", _SPACES), "").alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"))
    packed = f"sort_array(transform(sequence(0, size(w) - 3), i -> (xxhash64(w[i], w[i + 1], w[i + 2]) & {-_LONG}) | cast(i AS bigint)))"
    t = t.select("*", F.expr(f"CASE WHEN size(w) >= 4 AND size(w) < {_LONG} THEN {packed} END").alias("s"))
    t = t.select("*", F.expr(f"CASE WHEN s IS NOT NULL THEN {_SAME} END").alias("e"))
    long = lambda c: c.cast("bigint")
    found = t.select(
        "held",
        long(F.size("w")).alias("n_words"),
        long(F.length(F.array_join("w", ""))).alias("word_chars"),
        long(F.regexp_count("t", F.lit("[#*$%&|<>]"))).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        long(F.expr(_repeats())).alias("n_repeat_words"),
        long(F.size("lines")).alias("n_lines"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.select(*[F.col("held")[c].alias(c) for c in keep], F.struct(*found.columns[1:], failed.alias("base_failed")).alias(into))


def _ratios(m: str) -> dict[str, Column]:
    return {n: F.coalesce(F.try_divide(F.col(f"{m}.{a}"), F.col(f"{m}.{b}")), F.lit(0.0)) for n, (a, b) in RATIOS.items()}


def limits(wide: DataFrame, m: str, lang_col: str, source_col: str, spread: float, accuracy: int, enough: int) -> tuple[DataFrame, DataFrame]:
    """(_lang, _source, _n, _own) for each group, and (_all) of the corpus in one row: structs of a limit for each ratio.

    A limit is the upper quartile plus ``spread`` times its distance from the median; where those two
    are equal, as for what most texts have none of, it is the quantile of SPARED. A group of n texts
    that pass the base rules weighs n to ``enough`` against the corpus.
    """
    sound = wide.filter(~F.col(f"{m}.base_failed"))
    sketches = [F.percentile_approx(x, [*BODY, SPARED[n]], accuracy).alias(n) for n, x in _ratios(m).items()]
    groups = sound.groupBy(F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source")).agg(F.count(F.lit(1)).alias("_n"), *sketches)
    tail = lambda q: F.when(q[1] > q[0], q[1] + spread * (q[1] - q[0])).otherwise(q[2])
    corpus = sound.agg(*sketches).select(F.struct(*[tail(F.col(n)).alias(n) for n in RATIOS]).alias("_all"))  # one row
    mixed = lambda n: (F.col("_n") * tail(F.col(n)) + enough * F.col(f"_all.{n}")) / (F.col("_n") + enough)
    both = groups.join(F.broadcast(corpus), F.lit(True))
    return both.select("_lang", "_source", "_n", F.struct(*[mixed(n).alias(n) for n in RATIOS]).alias("_own")), corpus


def verdict(wide: DataFrame, m: str, lang_col: str, source_col: str, spread: float, accuracy: int, enough: int) -> DataFrame:
    """Adds ``kept`` to the struct ``m`` of a written table of measures."""
    own, corpus = limits(wide, m, lang_col, source_col, spread, accuracy, enough)
    own = materialize(own.drop("_n"), "limits")  # written, its size is known before the join is planned
    cols = wide.columns
    both = wide.join(own, F.col(lang_col).eqNullSafe(F.col("_lang")) & F.col(source_col).eqNullSafe(F.col("_source")), "left").join(F.broadcast(corpus), F.lit(True), "left")
    good = ~F.col(f"{m}.base_failed")
    for n, x in _ratios(m).items():
        good = good & (x <= F.coalesce(F.col(f"_own.{n}"), F.col(f"_all.{n}")))
    return both.select(*cols, "_own", "_all").select(*[F.col(c) if c != m else F.col(m).withField("kept", F.coalesce(good, F.lit(False))).alias(m) for c in cols])


def keep_good(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", spread: float = 5.0,
    accuracy: int = 10_000, enough: int = 50,
) -> DataFrame:
    """The rows of docs that the rules keep, with all of their columns, whatever those are called.

    A row goes if the base rules fail (under 50 words, or more than half of the words in repeated
    windows), or if one of RATIOS lies beyond its group's limit, which limits() takes from the texts of the
    same language and source that pass the base rules, and for small groups also from the whole corpus. Null languages and sources are
    groups like others, a null text has no words and goes,
    repeated rows count each, and an empty table gives an empty one. Texts and measures are written
    once, so that thresholds and decisions come from the same values.
    """
    held = docs.select(F.struct(*docs.columns).alias("row"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    wide = materialize(measure(held, "m", keep=["row", "lang", "source"]), "quality")
    return verdict(wide, "m", "lang", "source", spread, accuracy, enough).filter("m.kept").select("row.*")


def verdicts(
    docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
    spread: float = 5.0, accuracy: int = 10_000, enough: int = 50,
) -> DataFrame:
    """One row for each row of docs: id, the measures, base_failed and kept, by the rules of keep_good(); only measures are written."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    wide = materialize(measure(slim, "m", keep=["id", "lang", "source"]), "quality")
    judged = verdict(wide, "m", "lang", "source", spread, accuracy, enough)
    return judged.select(F.col("id").alias(id_col), *[f"m.{n}" for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])
