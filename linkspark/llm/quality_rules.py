"""Quality rules: robust multivariate outliers by the minimum covariance determinant.

Each document's statistics become a vector of five transformed numbers. For every language and source, a fast MCD finds
the mean and covariance of the most concentrated three quarters of its documents. It has several deterministic starts: the
quartiles of each number alone, winsorised numbers, spatial signs, and all documents as they are. From each, concentration
steps take the moments of the nearest documents and measure all again until the determinant falls no more; the start that
ends with the least determinant counts. Documents far from it by Mahalanobis distance are rejected.

All of it is DataFrame expressions. The vectors are whole thousandths, their moments exact integers and the quantiles come
from histograms of whole bins, so results depend neither on the order of rows nor on the engine: ``oracle`` writes the
same formulas as SQL. Per-document work never leaves its row; groups meet in partial aggregates alone, and what a group has
besides is a few rows of parameters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspark.llm.common import WORD, forget, written

WINDOW = 8
DIMENSIONS = range(1, 6)
#: The vector as SQL over the statistics: length, word length, symbols, repeated lines, repeated passages.
VECTOR = {
    1: "ln(1.0D + n_words)",
    2: "least(word_chars / CAST(n_words AS DOUBLE), 100.0D)",
    3: "sqrt(least(n_symbols / CAST(n_words AS DOUBLE), 100.0D))",
    4: "sqrt(n_dup_lines / CAST(greatest(n_lines, 1) AS DOUBLE))",
    5: "sqrt(n_repeat_words / CAST(n_words AS DOUBLE))",
}
#: Least standard deviation of each, in thousandths: clean groups hardly vary in the last three, and where a group's own
#: deviation is less, a document that differs at all would be infinitely far.
FLOOR = {1: 200.0, 2: 150.0, 3: 100.0, 4: 100.0, 5: 100.0}
#: Share of a group that the estimate rests on, and the factor that makes its covariance consistent for normal data.
SHARE, CONSISTENT = 0.75, 1.41
#: Squared distance that one normal document in a million exceeds, with five degrees of freedom.
CUTOFF = 35.9
#: Starts: quartiles, winsorised numbers, spatial signs, all rows.
STARTS = range(4)
#: Groups of fewer documents are pooled by language, then altogether; fewer still pass no verdict.
LEAST = 50
#: Bins of a distance of 1, and the last bin.
BINS, LAST = 64, 64_000
#: Groups of which a broadcast is made; beyond, the join is salted.
MAX_BROADCAST = 20_000
SALTS = 128


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for a row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """How many words lie in windows that occur twice or more in the text."""

    def covered(hashes: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            twice = F.filter(s, lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"]))
            starts = F.array_sort(F.transform(twice, lambda e: e["i"]))
            zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
            return F.aggregate(starts, zero, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")))["n"]

        order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_bind(order, of_sorted))

    def windows(w: Column) -> Column:
        hashed = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        return F.when(F.size(w) > WINDOW, _bind(hashed, covered)).otherwise(F.lit(0).cast("long"))

    return _bind(words, windows)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source (null as empty), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    counted = docs.select(
        "doc_id",
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.length(F.translate(text, " \t\n\u000b\f\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        _bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
        _bind(F.regexp_extract_all(text, F.lit(f"({WORD})"), 1), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("repeat"))).alias("w"),
    )
    out = counted.select("doc_id", "lang", "source", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.dup").alias("n_dup_lines"), F.col("w.repeat").alias("n_repeat_words"), F.col("l.n").alias("n_lines"))
    return out.withColumn("base_failed", F.expr(BASE))


BASE = "(n_words < 20 OR 100 * n_repeat_words > 30 * n_words)"
VECTORS = [f"CAST(floor(1000.0D * ({VECTOR[i]}) + 0.5D) AS BIGINT) AS x{i}" for i in DIMENSIONS]
#: Moments of a group: counts and sums, as whole numbers.
PAIRS = [(i, j) for i in DIMENSIONS for j in range(1, i + 1)]
MOMENTS = [
    "count(*) AS n",
    *(f"CAST(sum(CAST(x{i} AS DECIMAL(18,0))) AS DOUBLE) AS s{i}" for i in DIMENSIONS),
    *(f"CAST(sum(CAST(x{i} * x{j} AS DECIMAL(18,0))) AS DOUBLE) AS s{i}{j}" for i, j in PAIRS),
]


MEAN = [f"s{i} / n AS m{i}" for i in DIMENSIONS]


def _covariance(scaled: bool = False) -> list[str]:
    """Covariances, with variances of FLOOR squared at least; ``scaled``: of numbers in units of a thousandth of r."""
    out = []
    for i, j in PAIRS:
        c = f"(s{i}{j} / n - (s{i} / n) * (s{j} / n))" + (f" * (r{i} / 1000.0D) * (r{j} / 1000.0D)" if scaled else "")
        out.append(f"greatest({c}, {FLOOR[i] ** 2}D) AS c{i}{j}" if i == j else f"{c} AS c{i}{j}")
    return out


def _triangle() -> list[list[str]]:
    """Steps, each of new columns over the former: the lower triangle of the covariance, and its determinant's root."""
    out = []
    for j in DIMENSIONS:
        done = "".join(f" - l{j}{k} * l{j}{k}" for k in range(1, j))
        out.append([f"sqrt(greatest(c{j}{j}{done}, 1.0D)) AS l{j}{j}"])
        below = [f"(c{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(1, j)) + f") / l{j}{j} AS l{i}{j}" for i in DIMENSIONS if i > j]
        if below:
            out.append(below)
    out.append([" * ".join(f"l{i}{i}" for i in DIMENSIONS) + " AS det"])
    return out


def _distance() -> list[list[str]]:
    out = []
    for i in DIMENSIONS:
        out.append([f"(x{i} - m{i}" + "".join(f" - l{i}{j} * y{j}" for j in range(1, i)) + f") / l{i}{i} AS y{i}"])
    out.append([" + ".join(f"y{i} * y{i}" for i in DIMENSIONS) + " AS d2"])
    out.append([f"CAST(least(floor({BINS} * sqrt(d2)), {LAST}) AS BIGINT) AS bin"])
    return out


#: The shape of an estimate: group, start, mean, triangle, root of the determinant.
GROUP = ["g_lang", "g_source"]
PARAMETERS = [*GROUP, "k", *(f"m{i}" for i in DIMENSIONS), *(f"l{i}{j}" for i, j in PAIRS), "det"]
#: Of a group's quartiles: middle and scale of each number.
SCALES = [f"CAST(q50_{i} AS DOUBLE) AS m{i}" for i in DIMENSIONS] + [f"greatest((q75_{i} - q25_{i}) / 1.349D, {FLOOR[i]}D) AS r{i}" for i in DIMENSIONS]
#: A row's numbers as a start takes them, as whole numbers: clipped at one and a half scales, divided by the length, as they are.
SCORES = [f"(x{i} - m{i}) / r{i} AS z{i}" for i in DIMENSIONS]
LENGTH = "greatest(sqrt(" + " + ".join(f"z{i} * z{i}" for i in DIMENSIONS) + "), 0.001D) AS z"
TAKEN = {
    1: [f"CAST(floor(1000.0D * least(greatest(z{i}, -1.5D), 1.5D) + 0.5D) AS BIGINT)" for i in DIMENSIONS],
    2: [f"CAST(floor(1000.0D * (z{i} / z) + 0.5D) AS BIGINT)" for i in DIMENSIONS],
    3: [f"x{i}" for i in DIMENSIONS],
}
NO_DETERMINANT = "CAST('Infinity' AS DOUBLE) AS det"
VERDICT = f"d2 IS NULL OR d2 <= {CUTOFF * CONSISTENT}D"


def _steps(df: DataFrame, steps: list[list[str]]) -> DataFrame:
    for own in steps:
        df = df.selectExpr("*", *own)
    return df


def _with_groups(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join what each group has: a broadcast while the groups are few, else by salted keys, as a group may be hot."""
    if small.count() <= MAX_BROADCAST:
        return rows.join(F.broadcast(small), keys, how)
    salted = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"], how).drop("salt")


def _pools(rows: DataFrame) -> DataFrame:
    """lang, source, g_lang, g_source: the group that estimates for them; none where even the pool is too small."""
    sizes = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    kept = "g_lang", "g_source"
    first = sizes.selectExpr("lang", "source", "n", "lang AS g_lang", f"CASE WHEN n >= {LEAST} THEN source ELSE '*' END AS g_source")
    by_lang = first.groupBy("g_lang", "g_source").agg(F.sum("n").alias("pool"))
    second = first.join(by_lang, [*kept]).selectExpr("lang", "source", "n", f"CASE WHEN pool >= {LEAST} THEN g_lang ELSE '*' END AS g_lang", "g_source")
    by_all = second.groupBy(*kept).agg(F.sum("n").alias("pool"))
    return second.join(by_all, [*kept]).where(F.col("pool") >= LEAST).select("lang", "source", *kept)


def _quantiles(rows: DataFrame) -> DataFrame:
    """Of each group and dimension the least value with a quarter, half and three quarters of the rows at or below it."""
    long = rows.select("g_lang", "g_source", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"x{i}").alias("x")) for i in DIMENSIONS])).alias("v"))
    counts = long.groupBy("g_lang", "g_source", F.col("v.i").alias("i"), F.col("v.x").alias("x")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("g_lang", "g_source", "i")
    up = counts.withColumn("upto", F.sum("n").over(w.orderBy("x"))).withColumn("all", F.sum("n").over(w))
    picks = [F.min(F.when((F.col("i") == i) & (F.col("upto") * 4 >= F.col("all") * q), F.col("x"))).alias(f"q{25 * q}_{i}") for i in DIMENSIONS for q in (1, 2, 3)]
    return up.groupBy("g_lang", "g_source").agg(*picks)


def _thresholds(measured: DataFrame) -> DataFrame:
    """The least bin with SHARE of its group at or below it, for each start."""
    counts = measured.groupBy(*GROUP, "k", "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*GROUP, "k")
    up = counts.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    return up.where(F.col("upto") >= F.lit(SHARE) * F.col("all")).groupBy(*GROUP, "k").agg(F.min("bin").alias("threshold"))


def _starts(vectors: DataFrame) -> DataFrame:
    """The estimates that concentration starts from, a row per group and start."""
    scales = written(_quantiles(vectors).selectExpr(*GROUP, *SCALES), "scales")
    diagonal = [f"r{i} AS l{i}{i}" if i == j else f"0.0D AS l{i}{j}" for i, j in PAIRS]
    first = scales.selectExpr(*GROUP, "0 AS k", *[f"m{i}" for i in DIMENSIONS], *diagonal, NO_DETERMINANT)
    scored = _with_groups(vectors, scales, GROUP).selectExpr("*", *SCORES).selectExpr("*", LENGTH)
    kinds = [f"struct({k} AS k, {', '.join(f'{e} AS x{i}' for i, e in zip(DIMENSIONS, own, strict=True))})" for k, own in TAKEN.items()]
    taken = scored.selectExpr(*GROUP, f"explode(array({', '.join(kinds)})) AS t").select(*GROUP, "t.*")
    moments = written(taken.groupBy(*GROUP, "k").agg(*[F.expr(m) for m in MOMENTS]), "moments").join(scales, GROUP)
    scaled = _steps(moments.where("k < 3").selectExpr(*GROUP, "k", *[f"m{i}" for i in DIMENSIONS], *_covariance(True)), _triangle())
    plain = _steps(moments.where("k = 3").selectExpr(*GROUP, "k", *MEAN, *_covariance()), _triangle())
    others = scaled.drop("det").unionByName(plain.drop("det"), allowMissingColumns=True).selectExpr("*", NO_DETERMINANT)
    return first.select(*PARAMETERS).unionByName(others.select(*PARAMETERS))


def concentrated(vectors: DataFrame) -> DataFrame:
    """The estimate of each group: of all starts, concentrated until the determinant falls no more, the least.

    A start leaves the rounds when a step does not lessen its determinant, which each step does until nothing changes.
    """
    going = written(_starts(vectors), "estimate")
    ended = []
    while True:
        measured = _steps(_with_groups(vectors, going, GROUP), _distance())
        threshold = written(_thresholds(measured), "threshold")
        near = _steps(_with_groups(vectors, going.join(threshold, [*GROUP, "k"]), GROUP), _distance()).where("bin <= threshold")
        # the sums, what is made of them, and the filter on that in plans of their own, each small enough to be compiled
        moments = written(near.groupBy(*GROUP, "k").agg(*[F.expr(m) for m in MOMENTS]), "moments")
        after = written(_steps(moments.selectExpr(*GROUP, "k", *MEAN, *_covariance()), _triangle()).select(*PARAMETERS), "after")
        better = after.join(going.select(*GROUP, "k", F.col("det").alias("before")), [*GROUP, "k"]).where("det < before")
        now = written(better.select(*PARAMETERS), "estimate")
        ended.append(going.join(now, [*GROUP, "k"], "left_anti"))
        for done in (threshold, moments, after):
            forget(done)
        if now.isEmpty():
            break
        going = now
    every = reduce(DataFrame.unionByName, ended)
    least = F.row_number().over(Window.partitionBy(*GROUP).orderBy("det", "k"))
    return written(every.withColumn("nth", least).where("nth = 1").drop("nth"), "estimate")


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, d2 of each row of ``docs``.

    Null text has no words and fails the base rules; only rows that pass them are estimated from and judged. Null
    languages and sources count as empty ones. Too small groups are pooled, see LEAST; without a verdict the row is kept
    and d2 is null. Repeated rows each give a row and count as often; ties share a bin, and go in or stay out together.
    Long texts are read whole; their windows are told apart by 64-bit hashes. Other columns are ignored; an empty table: no
    rows.
    """
    rows = written(statistics(docs.select("doc_id", "text", "lang", "source")), "statistics")
    passed = rows.where("NOT base_failed").selectExpr("lang", "source", *VECTORS)
    pools = written(_pools(passed), "pools")
    vectors = written(_with_groups(passed, pools, ["lang", "source"]).select(*GROUP, *[f"x{i}" for i in DIMENSIONS]), "vectors")
    final = written(pools.join(concentrated(vectors), GROUP), "final")
    forget(vectors)
    judged = _steps(_with_groups(rows.selectExpr("*", *VECTORS_SAFE), final, ["lang", "source"], "left"), _distance())
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.selectExpr(*columns, f"(NOT base_failed AND ({VERDICT})) AS kept", "CASE WHEN base_failed THEN NULL ELSE d2 END AS d2")


#: The vector where n_words may be 0: such rows fail the base rules, whatever it is.
VECTORS_SAFE = [v.replace("CAST(n_words AS DOUBLE)", "CAST(greatest(n_words, 1) AS DOUBLE)") for v in VECTORS]


def _duck(sql: str) -> str:
    """Spark's double literals as DuckDB has them."""
    import re

    return re.sub(r"(\d+\.\d+)D\b", r"CAST(\1 AS DOUBLE)", sql)


def oracle() -> str:
    """The same as DuckDB SQL over ``documents``."""
    keys = "g_lang, g_source"

    def chain(source: str, steps: list[list[str]]) -> str:
        for own in steps:
            source = f"(SELECT *, {', '.join(own)} FROM {source})"
        return source

    ctes = [
        f"""base AS (SELECT row_number() OVER () AS r, doc_id, coalesce(CAST(lang AS VARCHAR), '') AS lang, coalesce(CAST(source AS VARCHAR), '') AS source, coalesce(text, '') AS t,
          regexp_extract_all(coalesce(text, ''), '{WORD}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM documents)""",
        f"windows AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM base WHERE len(w) > {WINDOW}))",
        "twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, s) > 1)",
        f"covered AS (SELECT r, CAST(sum(c) AS BIGINT) AS n FROM (SELECT r, least({WINDOW}, i - lag(i, 1, -{WINDOW}) OVER (PARTITION BY r ORDER BY i)) AS c FROM twice) GROUP BY r)",
        f"""rows_ AS (SELECT *, {BASE} AS base_failed FROM (SELECT base.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
          CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines
          FROM base LEFT JOIN covered ON covered.r = base.r))""",
        f"passed AS (SELECT lang, source, {', '.join(VECTORS)} FROM rows_ WHERE NOT base_failed)",
        f"first_ AS (SELECT lang, source, count(*) AS n, lang AS g_lang, CASE WHEN count(*) >= {LEAST} THEN source ELSE '*' END AS g_source FROM passed GROUP BY lang, source)",
        f"second_ AS (SELECT lang, source, n, CASE WHEN sum(n) OVER (PARTITION BY {keys}) >= {LEAST} THEN g_lang ELSE '*' END AS h_lang, g_source FROM first_)",
        f"pools AS (SELECT lang, source, h_lang AS g_lang, g_source FROM second_ QUALIFY sum(n) OVER (PARTITION BY h_lang, g_source) >= {LEAST})",
        f"vectors AS MATERIALIZED (SELECT {keys}, {', '.join(f'x{i}' for i in DIMENSIONS)} FROM passed JOIN pools USING (lang, source))",
        f"""ups AS (SELECT *, sum(n) OVER (PARTITION BY {keys}, i ORDER BY x) AS upto, sum(n) OVER (PARTITION BY {keys}, i) AS every FROM (SELECT {keys}, i, x, count(*) AS n FROM (
          {" UNION ALL ".join(f"SELECT {keys}, {i} AS i, x{i} AS x FROM vectors" for i in DIMENSIONS)}) GROUP BY ALL))""",
        f"quantiles AS (SELECT {keys}, {', '.join(f'min(x) FILTER (i = {i} AND upto * 4 >= every * {q}) AS q{25 * q}_{i}' for i in DIMENSIONS for q in (1, 2, 3))} FROM ups GROUP BY {keys})",
        f"scales AS MATERIALIZED (SELECT {keys}, {', '.join(SCALES)} FROM quantiles)",
        f"scored AS (SELECT *, {LENGTH} FROM (SELECT *, {', '.join(SCORES)} FROM vectors JOIN scales USING (g_lang, g_source)))",
        "taken AS (" + " UNION ALL ".join(f"SELECT {keys}, {k} AS k, {', '.join(f'{e} AS x{i}' for i, e in zip(DIMENSIONS, own, strict=True))} FROM scored" for k, own in TAKEN.items()) + ")",
        f"moments AS MATERIALIZED (SELECT {keys}, k, {', '.join(MOMENTS)} FROM taken GROUP BY ALL)",
        f"scaled AS (SELECT * FROM {chain(f'(SELECT *, {", ".join(_covariance(True))} FROM moments JOIN scales USING (g_lang, g_source) WHERE k < 3)', _triangle())})",
        f"plain AS (SELECT * FROM {chain(f'(SELECT *, {", ".join(MEAN + _covariance())} FROM moments WHERE k = 3)', _triangle())})",
    ]
    shape = [p for p in PARAMETERS if p != "det"]
    diagonal = [f"r{i} AS l{i}{i}" if i == j else f"0.0D AS l{i}{j}" for i, j in PAIRS]
    starts = f"SELECT {keys}, 0 AS k, {', '.join(f'm{i}' for i in DIMENSIONS)}, {', '.join(diagonal)} FROM scales UNION ALL SELECT {', '.join(shape)} FROM scaled UNION ALL SELECT {', '.join(shape)} FROM plain"
    measured = chain("(SELECT * FROM vectors JOIN estimates USING (g_lang, g_source))", _distance())
    near = f"SELECT * FROM (SELECT *, rank() OVER (PARTITION BY {keys}, k ORDER BY bin) - 1 AS nearer, count(*) OVER (PARTITION BY {keys}, k) AS every FROM {measured}) WHERE nearer < CAST({SHARE} AS DOUBLE) * every"
    step = f"SELECT {keys}, k, any_value(step) AS step, any_value(det) AS before, {', '.join(MOMENTS)} FROM ({near}) GROUP BY {keys}, k"
    better = chain(f"(SELECT *, {', '.join(MEAN + _covariance())} FROM ({step}))", _triangle())
    ctes += [
        f"estimates AS (SELECT *, {NO_DETERMINANT}, 0 AS step FROM ({starts}) UNION ALL SELECT {', '.join(PARAMETERS)}, step + 1 FROM {better} WHERE det < before)",
        f"last_ AS (SELECT * FROM estimates QUALIFY row_number() OVER (PARTITION BY {keys}, k ORDER BY step DESC) = 1)",
        f"least_ AS MATERIALIZED (SELECT * FROM last_ QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY det, k) = 1)",
    ]
    final = chain(f"(SELECT * FROM (SELECT *, {', '.join(VECTORS_SAFE)} FROM rows_) LEFT JOIN (SELECT * FROM pools JOIN least_ USING (g_lang, g_source)) USING (lang, source))", _distance())
    return _duck(f"WITH RECURSIVE {', '.join(ctes)} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND ({VERDICT})) AS kept FROM {final}")
