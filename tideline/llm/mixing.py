"""Mixing to target weights by iterative proportional fitting. DataFrame functions only.

Documents are added up to cells of (source, language, topic). A weight for each value of each dimension
is then raked until the weighted tokens meet the target share of every value, and documents are
sampled with their cell's calibrated probability.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import bytes_read, materialize

DIMENSIONS = ("source", "lang", "topic")
#: Target shares are the token shares to this power, made to add up to one: below 1 lifts what is rare.
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 0.9}
#: What a tokenizer of sub-words never joins: a run of letters, a few figures, a run of other marks. Long words count once for each six letters.
PIECES = "\\p{L}{1,6}|\\p{N}{1,3}|[^\\s\\p{L}\\p{N}]{1,3}"
#: Rounds of raking between two looks at what is left.
ROUNDS = 6
#: Bytes of cells that are raked in one task.
SMALL = 4 << 20
MARK = "[^\\s\\p{L}]"
#: The quantiles of each measure of form() that part the corpus into genres.
PARTED = (1 / 3, 2 / 3)


def pieces_in(text: Column) -> Column:
    """About the tokens of a sub-word tokenizer, for tables without a column of token counts."""
    return F.coalesce(F.regexp_count(text, F.lit(PIECES)), F.lit(0)).cast("bigint")


def form(text: Column) -> dict[str, Column]:
    """What genres go by: characters to a space, and the share of characters that are marks or figures. Null for empty texts."""
    t = F.coalesce(text, F.lit(""))
    spaces = F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))
    return {"long": F.when(F.length(t) > 0, F.length(t) / (spaces + 1)), "marked": F.try_divide(F.regexp_count(t, F.lit(MARK)), F.length(t))}


def genres(rows: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """One row of quantiles of each measure over all documents, from mergeable sketches."""
    return rows.agg(*[F.percentile_approx(f"_{n}", list(PARTED), accuracy).alias(f"_at_{n}") for n in ("long", "marked")])


def genre() -> Column:
    """The class of a row among the corpus's quantiles: words from short to long, then marks from few to many; null for an empty text."""
    place = lambda n: F.concat(*[(F.col(f"_{n}") > F.col(f"_at_{n}")[i]).cast("int").cast("string") for i in range(len(PARTED))])
    return F.concat(F.lit("long"), place("long"), F.lit(" marked"), place("marked"))


def chance(id_: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by the id, or by the text where the id is null."""
    key = F.coalesce(id_.cast("string"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float, most_rounds: int) -> DataFrame:
    """cells with a weight ``w_<dimension>`` for each dimension. cells: the dimensions as text, and ``tokens``; targets: (v, share) by dimension.

    A round rakes one dimension after the other. After each ROUNDS of them the cells are written, with ``off``: how far the tokens of a
    cell's values were from
    their targets before the last round, relative to those. Raking ends once none is further off than ``tolerance``. Targets
    that no weights meet, as where two dimensions say the same and their targets don't, end with a warning after ``most_rounds``.
    """
    # a few cells are one partition, where windows need no shuffle; of more, sums are added up in parts and joined to the cells
    small = bytes_read(cells) < SMALL
    held = lambda df: df.coalesce(1) if small else df

    def with_mass(now: DataFrame, d: str) -> DataFrame:
        a, b = (F.col(f"w_{x}") for x in DIMENSIONS if x != d)
        mass = F.sum(F.col("tokens") * a * b)
        if small:
            return now.withColumn("_mass", mass.over(Window.partitionBy(d)))
        return now.join(now.groupBy(F.col(d).alias("_v")).agg(mass.alias("_mass")), F.col(d).eqNullSafe(F.col("_v"))).drop("_v")

    now = cells.crossJoin(F.broadcast(cells.agg(F.sum("tokens").cast("double").alias("total"))))  # one row
    for d in DIMENSIONS:
        goal = targets[d].select(F.col("v").cast("string").alias("v"), F.col("share").cast("double").alias(f"share_{d}"))
        now = now.join(goal, F.col(d).eqNullSafe(F.col("v"))).drop("v").withColumn(f"w_{d}", F.lit(1.0))
    now, worst = held(materialize(held(now), "raked")), None
    for done in range(1, most_rounds + 1):
        for d in DIMENSIONS:
            new = F.when(F.col("_mass") > 0, F.col(f"share_{d}") * F.col("total") / F.col("_mass")).otherwise(F.lit(1.0))
            off = F.abs(F.coalesce(F.try_divide(new, F.col(f"w_{d}")), F.lit(1.0)) - 1)
            now = with_mass(now, d).withColumns({f"w_{d}": new, f"_off_{d}": off}).drop("_mass")
        now = now.withColumn("off", F.greatest(*[f"_off_{d}" for d in DIMENSIONS])).drop(*[f"_off_{d}" for d in DIMENSIONS])
        if not small or done % ROUNDS == 0 or done == most_rounds:
            now = held(materialize(now, "raked"))
        if done % ROUNDS == 0:
            worst = now.agg(F.max("off")).first()[0]  # one number
            if worst is None or worst <= tolerance:
                return now
    worst = now.agg(F.max("off")).first()[0]
    warnings.warn(f"a value's tokens were {worst:.1e} off their target, relative to it, before the last of {most_rounds} rounds", stacklevel=2)
    return now


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """(v, share) from the token shares to ``power``."""
    by = cells.groupBy(F.col(dimension).alias("v")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("p"))
    every = by.agg(F.sum("p").alias("all"))  # one row
    return by.join(F.broadcast(every), F.lit(True)).select("v", F.when(F.col("all") > 0, F.col("p") / F.col("all")).otherwise(F.lit(0.0)).alias("share"))


def rates(cells: DataFrame, budget: float, tolerance: float, most_rounds: int, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """(source, lang, topic, rate): the expected number of copies of each document of the cell.

    The weighted tokens of the rates are ``budget`` times the tokens there are, in the target shares as far as rake() meets them.
    """
    goals = {d: tempered(cells, d, TEMPER[d]) if (targets or {}).get(d) is None else targets[d] for d in DIMENSIONS}
    raked, product = rake(cells, goals, tolerance, most_rounds), F.lit(budget)
    for d in DIMENSIONS:
        product = product * F.col(f"w_{d}")
    # no target says anything of a cell without tokens
    return materialize(raked.select(*DIMENSIONS, F.when(F.col("tokens") > 0, F.round(product, 6)).otherwise(F.lit(float(budget))).alias("rate")), "rates")


def _with_rates(rows: DataFrame, table: DataFrame) -> DataFrame:
    t = table.select(*[F.col(d).alias(f"_r_{d}") for d in DIMENSIONS], F.col("rate").alias("_rate"))
    on = F.lit(True)
    for d in DIMENSIONS:
        on = on & F.col(f"_d_{d}").eqNullSafe(F.col(f"_r_{d}"))
    return rows.join(t, on, "left")


def _copies() -> Column:
    return (F.floor("_rate") + F.when(F.col("_chance") < F.col("_rate") - F.floor("_rate"), 1).otherwise(0)).cast("int")


def _marked(
    docs: DataFrame, held: Column, id_col: str, text_col: str, source_col: str, lang_col: str, topic: Column | None, tokens: Column | None,
    seed: int,
) -> DataFrame:
    """A written row for each row of docs: (_held, _d_source, _d_lang, _d_topic, _tokens, _chance)."""
    text = F.col(text_col)
    marks = {"_d_source": F.col(source_col).cast("string"), "_d_lang": F.col(lang_col).cast("string"), "_tokens": pieces_in(text) if tokens is None else F.coalesce(tokens, F.lit(0)).cast("bigint"), "_chance": chance(F.col(id_col), text, seed)}
    marks |= {f"_{n}": x for n, x in form(text).items()} if topic is None else {"_d_topic": topic.cast("string")}
    rows = materialize(docs.select(held.alias("_held"), *[c.alias(n) for n, c in marks.items()]), "marked")
    if topic is None:
        rows = rows.join(F.broadcast(genres(rows)), F.lit(True)).withColumn("_d_topic", genre())  # one row
    return rows.select("_held", *[f"_d_{d}" for d in DIMENSIONS], "_tokens", "_chance")


def _rated(rows: DataFrame, budget: float, tolerance: float, most_rounds: int, targets: dict[str, DataFrame] | None) -> DataFrame:
    cells = materialize(rows.groupBy(*[F.col(f"_d_{d}").alias(d) for d in DIMENSIONS]).agg(F.sum("_tokens").alias("tokens")), "cells")
    return _with_rates(rows, rates(cells, budget, tolerance, most_rounds, targets))


def sample_table(
    docs: DataFrame, budget: float = 1.0, tolerance: float = 1e-6, most_rounds: int = 60, seed: int = 17, id_col: str = "doc_id",
    text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, tokens: Column | None = None,
    targets: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """One row for each row of docs: (id, source, lang, topic, tokens, rate, copies).

    ``copies`` is the rate's whole part, and one more with the chance of the rest; the chance is fixed by
    the id, so a task that runs again decides alike, and repeated rows of one id are taken or left together. At a ``budget`` of 1 the sample has
    about the tokens of docs. ``topic`` and ``tokens`` are columns of docs; without them genre() and pieces_in() stand in.
    Null sources, languages and topics are values like others; a null text has no tokens and still has its cell's
    rate, which is ``budget`` where the whole cell has none; null tokens are 0; rows with a null id are decided by their text; an empty
    table gives no rows; other columns are not read.
    """
    both = _rated(_marked(docs, F.col(id_col), id_col, text_col, source_col, lang_col, topic, tokens, seed), budget, tolerance, most_rounds, targets)
    return both.select(F.col("_held").alias(id_col), *[F.col(f"_d_{d}").alias(d) for d in DIMENSIONS], F.col("_tokens").alias("tokens"), F.col("_rate").alias("rate"), _copies().alias("copies"))


def sample(
    docs: DataFrame, budget: float = 1.0, tolerance: float = 1e-6, most_rounds: int = 60, seed: int = 17, id_col: str = "doc_id",
    text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, tokens: Column | None = None,
    targets: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """The rows of docs with all of their columns, whatever those are called, each as often as sample_table() says.

    Nulls, repeated rows and empty tables are as there; a row of 0 copies goes.
    """
    rows = _marked(docs, F.struct(*docs.columns), id_col, text_col, source_col, lang_col, topic, tokens, seed)
    taken = _rated(rows, budget, tolerance, most_rounds, targets).select("_held", _copies().alias("_copies")).filter("_copies > 0")
    return taken.select("_held", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_held.*")


def sample_sql(budget: float = 1.0, tolerance: float = 1e-6, most_rounds: int = 60, seed: int = 17, table: str = "documents") -> str:
    """sample_table() in DuckDB's SQL; rounds are steps of a recursion."""
    count = lambda p: f"len(regexp_extract_all(t, '{p}'))"
    place = lambda n: " || ".join(f"({n} > q_{n}[{i + 1}])::INTEGER::VARCHAR" for i in range(len(PARTED)))
    steps = [
        f"e AS MATERIALIZED (SELECT doc_id, source, lang, coalesce(text, '') AS t, ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 13))::BIGINT / {1 << 52}.0::DOUBLE AS chance FROM {table})",
        f"f AS MATERIALIZED (SELECT doc_id, source, lang, chance, {count(PIECES)} AS tokens, CASE WHEN t <> '' THEN length(t)::DOUBLE / (length(t) - length(replace(t, ' ', '')) + 1) END AS long, {count(MARK)}::DOUBLE / nullif(length(t), 0) AS marked FROM e)",
        f"q AS (SELECT quantile_disc(long, {list(PARTED)}) AS q_long, quantile_disc(marked, {list(PARTED)}) AS q_marked FROM f)",
        f"d AS MATERIALIZED (SELECT doc_id, source, lang, 'long' || {place('long')} || ' marked' || {place('marked')} AS topic, tokens, chance FROM f, q)",
        "cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM d GROUP BY ALL)",
        "total AS MATERIALIZED (SELECT sum(tokens) AS total FROM cells)",
    ]
    for d in DIMENSIONS:
        steps.append(f"p_{d} AS MATERIALIZED (SELECT {d} AS v, power(sum(tokens), {TEMPER[d]}) AS p FROM cells GROUP BY 1)")
        steps.append(f"t_{d} AS MATERIALIZED (SELECT v, p / (SELECT sum(p) FROM p_{d}) AS share FROM p_{d})")
    start = " UNION ALL ".join(f"SELECT 0 AS n, '{d}' AS dimension, v, 1.0::DOUBLE AS w, 1.0::DOUBLE AS off FROM t_{d}" for d in DIMENSIONS)
    inner = [f"live AS (SELECT * FROM it WHERE n < {most_rounds} AND (n = 0 OR n % {ROUNDS} <> 0 OR (SELECT max(off) FROM it) > {tolerance}))"]
    for k, d in enumerate(DIMENSIONS):
        w = lambda x, k=k: f"new_{x}" if DIMENSIONS.index(x) < k else f"(SELECT v, w FROM live WHERE dimension = '{x}')"
        a, b = (x for x in DIMENSIONS if x != d)
        inner.append(f"new_{d} AS (SELECT t.v, CASE WHEN m.mass > 0 THEN t.share * total / m.mass ELSE 1.0 END AS w FROM t_{d} t JOIN (SELECT c.{d} AS s, sum(c.tokens * x.w * y.w) AS mass FROM cells c JOIN {w(a)} x ON c.{a} IS NOT DISTINCT FROM x.v JOIN {w(b)} y ON c.{b} IS NOT DISTINCT FROM y.v GROUP BY 1) m ON t.v IS NOT DISTINCT FROM m.s, total)")
    step = " UNION ALL ".join(f"SELECT o.n + 1, o.dimension, o.v, x.w, abs(x.w / o.w - 1) FROM live o JOIN new_{d} x ON o.v IS NOT DISTINCT FROM x.v WHERE o.dimension = '{d}'" for d in DIMENSIONS)
    steps.append(f"it AS ({start} UNION ALL (WITH {', '.join(inner)} {step}))")
    steps.append("z AS MATERIALIZED (SELECT dimension, v, w FROM it WHERE n = (SELECT max(n) FROM it))")
    w = " JOIN ".join(["d", "cells c ON d.source IS NOT DISTINCT FROM c.source AND d.lang IS NOT DISTINCT FROM c.lang AND d.topic IS NOT DISTINCT FROM c.topic", *[f"z w_{x} ON w_{x}.dimension = '{x}' AND d.{x} IS NOT DISTINCT FROM w_{x}.v" for x in DIMENSIONS]])
    steps.append(f"r AS (SELECT d.*, CASE WHEN c.tokens > 0 THEN round({budget}::DOUBLE * w_source.w * w_lang.w * w_topic.w, 6) ELSE {budget}::DOUBLE END AS rate FROM {w})")
    return f"WITH RECURSIVE {', '.join(steps)} SELECT doc_id, source, lang, topic, tokens, rate, (floor(rate) + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END)::INTEGER AS copies FROM r"
