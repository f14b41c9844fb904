"""Quality rules with robust multivariate outliers.

Plain rules look at each document alone. Then, per language and source, a minimum-covariance-
determinant estimate describes the bulk of the documents: from three starts, C-steps keep the
rows nearest by Mahalanobis distance and estimate again from those; the start of least
determinant goes on until its determinant stops falling. A document is rejected when its vector
of transformed statistics lies beyond the cutoff from its group's bulk. A least spread (FLOOR)
is added to each variance, so a statistic that nearly all documents share keeps a width.

Everything is DataFrame expressions. Vectors are integers (a step is 1/256), so equal ones fold
into one row with a count, sums are exact whatever the order of rows, and a distance rank is read
from a histogram instead of a sort; what an iteration moves is a few hundred rows per group. The
groups' parameters are broadcast where they are few, else joined on group and salt.

Defined results: a null text has no words and fails the plain rules; a null language or source
is a group of its own; a group with fewer than `least` rows that pass the rules has no bulk, and
rejects none; rows that repeat a doc_id are judged each; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm.common import SPACE, join_small, stored

GRAM = 8
SYMBOLS = "[^#*$%&|<>]+"
STEP = 256
#: Least spread of each dimension, so that a statistic nearly all documents share still has a width:
#: log word length, log symbols, log capitals, log repeats.
FLOOR = (0.08, 0.3, 0.3, 0.5)
DIMS = range(1, len(FLOOR) + 1)
PAIRS = [(i, j) for i in DIMS for j in DIMS if i <= j]
BIN = 64  # bins to a unit of ln(1 + squared distance)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, gram: int = GRAM) -> Column:
    """How many words stand in a gram-word window that the array holds twice or more."""
    n = F.size(words)

    def covered(starts: Column) -> Column:
        runs = F.transform(starts, lambda x, i: F.least(F.lit(gram), F.coalesce(F.get(starts, i + 1), x + gram) - x))
        return F.aggregate(runs, F.lit(0), lambda a, x: a + x)

    def repeated(rank: Column) -> Column:
        same = lambda e, o: F.coalesce(e["h"] == F.get(rank, o)["h"], F.lit(False))
        marked = F.transform(rank, lambda e, i: F.when(same(e, i - 1) | same(e, i + 1), e["i"]))
        return let(F.array_sort(F.filter(marked, lambda x: x.isNotNull())), covered)

    def of(grams: Column) -> Column:
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(
            let(F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), repeated)
        )

    def hashed(h: Column) -> Column:
        return let(F.transform(F.sequence(F.lit(1), n - (gram - 1)), lambda i: F.xxhash64(F.slice(h, i, gram))), of)

    return F.when(n < gram, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), hashed)).cast("long")


def statistics(docs: DataFrame, carry: list[Column]) -> DataFrame:
    """The carried columns, lang, source and the counts that the rules and the vectors use."""
    src = docs.select(F.struct(*carry).alias("carried"), docs["lang"].cast("string").alias("lang"), docs["source"].cast("string").alias("source"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = src.select(
        "carried", "lang", "source",
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long").alias("n_capitals"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    return counted.select("carried.*", "lang", "source", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", "n_capitals")


FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"

#: Each dimension as SQL that Spark and other engines read alike; rows that pass the rules have words.
VECTOR = (
    "CAST(floor(256 * ln(word_chars * 1e0 / n_words)) AS BIGINT)",
    "CAST(floor(256 * ln(1 + 1000e0 * n_symbols / word_chars)) AS BIGINT)",
    "CAST(floor(256 * ln(1 + 1000e0 * n_capitals / word_chars)) AS BIGINT)",
    "CAST(floor(256 * ln(1 + 100e0 * n_repeat_words / n_words)) AS BIGINT)",
)


def chi2_tail(p: int, tail: float) -> float:
    """x with P(chi-square, p even degrees of freedom > x) = tail, by bisection."""
    over = lambda x: math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2))
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if over(mid) > tail else (lo, mid)
    return (lo + hi) / 2


def consistency(share: float, p: int = len(FLOOR)) -> float:
    """What the covariance of the nearest `share` of a normal cloud must be multiplied by."""
    x = chi2_tail(p, 1 - share)
    return share / (1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2 + 1)))


def sums_sql() -> dict[str, str]:
    """Weighted sums over vectors that k rows share."""
    return {"n": "CAST(sum(k) AS BIGINT)"} | {f"s{i}": f"CAST(sum(k * x{i}) AS BIGINT)" for i in DIMS} | {f"s{i}{j}": f"CAST(sum(k * x{i} * x{j}) AS BIGINT)" for i, j in PAIRS}


SUMS = list(sums_sql())


def factor_sql(scale: float) -> list[tuple[str, str]]:
    """(name, expression) in order: means m, covariance c with floors, its LDL factors l and d, and the determinant."""
    out = [(f"m{i}", f"s{i} * 1e0 / n") for i in DIMS]
    for i, j in PAIRS:
        floor = f" + {(FLOOR[i - 1] * STEP) ** 2!r}" if i == j else ""
        out.append((f"c{i}{j}", f"(s{i}{j} * 1e0 - s{i} * 1e0 * s{j} / n) / n * {scale!r}{floor}"))
    for i in DIMS:
        for j in range(1, i):
            used = "".join(f" - l{i}{k} * l{j}{k} * d{k}" for k in range(1, j))
            out.append((f"l{i}{j}", f"(c{j}{i}{used}) / d{j}"))
        out.append((f"d{i}", f"c{i}{i}" + "".join(f" - l{i}{k} * l{i}{k} * d{k}" for k in range(1, i))))
    return [*out, ("det", DET)]


DET = " * ".join(f"d{i}" for i in DIMS)


def distance_sql() -> list[tuple[str, str]]:
    out = [(f"y{i}", f"x{i} - m{i}" + "".join(f" - l{i}{k} * y{k}" for k in range(1, i))) for i in DIMS]
    return [*out, ("dist", " + ".join(f"y{i} * y{i} / d{i}" for i in DIMS))]


BIN_OF = f"CAST(floor({BIN} * ln(1 + dist)) AS BIGINT)"
IN_BOX = " AND ".join(f"abs(x{i} - b{i}) <= 1.5e0 * (c{i} - a{i}) + {FLOOR[i - 1] * STEP!r}" for i in DIMS)
FELL = "det < old * (1 - 1e-9)"


def levels(named: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """The named expressions in runs, none of which uses a name of its own run, so that none is written out twice."""
    out: list[list[tuple[str, str]]] = [[]]
    for name, said in named:
        if any(re.search(rf"\b{other}\b", said) for other, _ in out[-1]):
            out.append([])
        out[-1].append((name, said))
    return out


def with_all(df: DataFrame, named: list[tuple[str, str]]) -> DataFrame:
    for level in levels(named):
        df = df.select("*", *[F.expr(said).alias(name) for name, said in level])
    return df


PARAMS = [f"m{i}" for i in DIMS] + [f"l{i}{j}" for i in DIMS for j in range(1, i)] + [f"d{i}" for i in DIMS] + ["det"]


def quartiles(vectors: DataFrame) -> DataFrame:
    """g with quartiles a (first), b and c of each dimension, read from exact histograms."""
    cells = vectors.select("g", "k", F.posexplode(F.array(*[f"x{i}" for i in DIMS])).alias("dim", "x")).groupBy("g", "dim", "x").agg(F.sum("k").alias("n"))
    order = W.partitionBy("g", "dim").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    ranked = cells.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(W.partitionBy("g", "dim")))
    at = lambda i, q: F.min(F.when((F.col("dim") == i - 1) & (F.col("upto") * 4 >= F.col("all") * q), F.col("x")))
    return ranked.groupBy("g").agg(*[at(i, q).alias(f"{name}{i}") for i in DIMS for q, name in ((1, "a"), (2, "b"), (3, "c"))])


def estimate(rows: DataFrame, scale: float, by: list[str]) -> DataFrame:
    sums = rows.groupBy(*by).agg(*[F.expr(said).alias(name) for name, said in sums_sql().items()])
    return with_all(sums, factor_sql(scale)).select(*by, "n", *PARAMS)


def start_parameters(vectors: DataFrame) -> DataFrame:
    """Three starts for each group: medians and quartile widths; all rows' moments; those of rows in the quartiles' box."""
    q = stored(quartiles(vectors), "quality-quartiles")
    wide = [F.col(f"b{i}").cast("double").alias(f"m{i}") for i in DIMS] + [F.lit(0.0).alias(f"l{i}{j}") for i in DIMS for j in range(1, i)]
    wide += [(F.pow((F.col(f"c{i}") - F.col(f"a{i}")) / F.lit(1.349), 2) + F.lit((FLOOR[i - 1] * STEP) ** 2)).alias(f"d{i}") for i in DIMS]
    one = q.select("g", *wide).withColumn("det", F.expr(DET))
    boxed = join_small(vectors, q, "g").filter(IN_BOX)
    parts = [one, estimate(vectors, 1.0, ["g"]), estimate(boxed, 1.0, ["g"])]
    return parts[0].select("g", F.lit(1).alias("s"), *PARAMS).union(parts[1].select("g", F.lit(2).alias("s"), *PARAMS)).union(parts[2].select("g", F.lit(3).alias("s"), *PARAMS))


def distances(vectors: DataFrame, params: DataFrame, how: str = "inner") -> DataFrame:
    return with_all(join_small(vectors, params, "g", how), distance_sql())


def c_step(vectors: DataFrame, params: DataFrame, share: float) -> DataFrame:
    """Estimates of (g, s) from the nearest `share` of the group's rows, whole histogram bins of the distance.

    One pass: sums are kept for each bin, and the bins below the cut are added up.
    """
    binned = distances(vectors, params.select("g", "s", *PARAMS)).withColumn("bin", F.expr(BIN_OF))
    bins = binned.groupBy("g", "s", "bin").agg(*[F.expr(said).alias(name) for name, said in sums_sql().items()])
    before = W.partitionBy("g", "s").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    ranked = bins.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("all", F.sum("n").over(W.partitionBy("g", "s")))
    near = ranked.filter(F.col("before") < F.ceil(F.col("all") * share)).groupBy("g", "s").agg(*[F.sum(c).cast("long").alias(c) for c in SUMS])
    return with_all(near, factor_sql(consistency(share))).select("g", "s", *PARAMS)


def robust_parameters(vectors: DataFrame, share: float, steps: int, most: int, inlier_tail: float) -> DataFrame:
    """Minimum-covariance-determinant estimates per group, reweighted once.

    `steps` C-steps from each start; of the starts the one of least determinant goes on, step by
    step, while its determinant falls (`most` steps at most; a step that does not lower it is undone).
    """
    params = stored(start_parameters(vectors), "quality-start")
    for _ in range(steps):
        params = stored(c_step(vectors, params, share), "quality-step")
    params = stored(params.groupBy("g").agg(F.min(F.struct("det", "s", *PARAMS[:-1])).alias("x")).select("g", "x.s", *[f"x.{c}" for c in PARAMS]), "quality-best")
    for _ in range(most):
        new = c_step(vectors, params, share).select("g", *[F.col(c).alias(f"new_{c}") for c in PARAMS])
        both = params.withColumnRenamed("det", "old").join(new, "g").withColumn("det", F.col("new_det")).withColumn("fell", F.expr(FELL))
        pick = [F.when(F.col("fell"), F.col(f"new_{c}")).otherwise(F.col("old" if c == "det" else c)).alias(c) for c in PARAMS]
        after = stored(both.select("g", "s", "fell", *pick), "quality-step")
        params = after.drop("fell")
        if after.filter("fell").isEmpty():
            break
    inliers = distances(vectors, params).filter(F.col("dist") <= chi2_tail(len(FLOOR), inlier_tail))
    return stored(estimate(inliers, consistency(1 - inlier_tail), ["g"]), "quality-params")


def judged(docs: DataFrame, carry: list[Column], share: float, steps: int, most: int, inlier_tail: float, outlier_tail: float, least: int) -> DataFrame:
    """The carried columns with the counts, base_failed, distance and kept."""
    group = F.concat_ws("\0", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    stats = stored(statistics(docs, carry).withColumn("g", group).withColumn("base_failed", F.expr(FAILED)), "quality-stats")
    vector = [F.expr(v).alias(f"x{i}") for i, v in zip(DIMS, VECTOR)]
    axes = [f"x{i}" for i in DIMS]
    vectors = stored(stats.filter("NOT base_failed").select("g", *vector).groupBy("g", *axes).agg(F.count("*").alias("k")), "quality-vectors")
    params = robust_parameters(vectors, share, steps, most, inlier_tail).filter(F.col("n") >= least).select("g", *PARAMS)
    stats = stats.select("*", *[F.when(~F.col("base_failed"), F.expr(v)).alias(f"x{i}") for i, v in zip(DIMS, VECTOR)])
    far = F.coalesce(F.col("dist") > chi2_tail(len(FLOOR), outlier_tail), F.lit(False))
    return distances(stats, params, "left").withColumn("kept", ~F.col("base_failed") & ~far)


DEFAULTS = {"share": 0.75, "steps": 2, "most": 8, "inlier_tail": 0.025, "outlier_tail": 1e-9, "least": 20}


def judge_quality(docs: DataFrame, **how) -> DataFrame:
    """Per row: doc_id, the counts, base_failed, distance (null without a bulk) and kept. how: see DEFAULTS."""
    return judged(docs, [docs["doc_id"].cast("long").alias("doc_id")], **DEFAULTS | how).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.round("dist", 6).alias("distance"), "kept"
    )


def keep_good(docs: DataFrame, **how) -> DataFrame:
    """docs, all columns, without the rejected rows; each row of a repeated doc_id is judged by itself.

    Rows are written once beside their counts and read again with the groups' few parameters, so
    texts are never shuffled.
    """
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    return judged(docs, [row], **DEFAULTS | how).filter("kept").select("row.*")


def oracle_sql(**how) -> str:
    """The query's rows in another engine's SQL."""
    at = DEFAULTS | how
    share, steps, most, inlier_tail, outlier_tail, least = (at[x] for x in DEFAULTS)
    group = "coalesce('=' || lang, '') || '|' || coalesce('=' || source, '')"

    def layered(source: str, named: list[tuple[str, str]]) -> str:
        for level in levels(named):
            source = f"(SELECT *, {', '.join(f'{said} AS {name}' for name, said in level)} FROM {source})"
        return source

    cols = ", ".join(PARAMS)
    sums = ", ".join(f"{said} AS {name}" for name, said in sums_sql().items())
    axes = ", ".join(f"x{i}" for i in DIMS)
    no_slant = ", ".join(f"0e0 AS l{i}{j}" for i in DIMS for j in range(1, i))
    parts = [
        r"""t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text,
            list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents)""",
        """r AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_repeat_words FROM (
            SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS at FROM (
              SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS k FROM (
                SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t)))
            WHERE k > 1) GROUP BY doc_id)""",
        r"""s AS (SELECT t.doc_id, """ + group + r""" AS g, CAST(len(w) AS BIGINT) AS n_words,
            CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
            CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
            CAST(length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS BIGINT) AS n_capitals,
            CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
               - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
            coalesce(r.n_repeat_words, 0) AS n_repeat_words FROM t LEFT JOIN r ON t.doc_id = r.doc_id)""",
        f"v AS MATERIALIZED (SELECT *, {FAILED} AS base_failed, " + ", ".join(f"CASE WHEN NOT ({FAILED}) THEN {v} END AS x{i}" for i, v in zip(DIMS, VECTOR)) + " FROM s)",
        f"p AS MATERIALIZED (SELECT g, {axes}, count(*) AS k FROM v WHERE NOT base_failed GROUP BY ALL)",
        "cells AS (" + " UNION ALL ".join(f"SELECT g, {i} AS dim, x{i} AS x, sum(k) AS n FROM p GROUP BY g, x{i}" for i in DIMS) + ")",
        "ranked AS (SELECT *, sum(n) OVER (PARTITION BY g, dim ORDER BY x) AS upto, sum(n) OVER (PARTITION BY g, dim) AS total FROM cells)",
        "q AS MATERIALIZED (SELECT g, " + ", ".join(f"min(CASE WHEN dim = {i} AND upto * 4 >= total * {k} THEN x END) AS {c}{i}" for i in DIMS for k, c in ((1, "a"), (2, "b"), (3, "c"))) + " FROM ranked GROUP BY g)",
        "one AS (SELECT g, " + ", ".join(f"CAST(b{i} AS DOUBLE) AS m{i}, pow((c{i} - a{i}) / 1.349e0, 2) + {(FLOOR[i - 1] * STEP) ** 2!r} AS d{i}" for i in DIMS) + f", {no_slant} FROM q)",
        f"two AS (SELECT g, {sums} FROM p GROUP BY g)",
        f"three AS (SELECT g, {sums} FROM p JOIN q USING (g) WHERE {IN_BOX} GROUP BY g)",
        f"e0 AS MATERIALIZED (SELECT g, 1 AS s, {cols} FROM (SELECT *, {DET} AS det FROM one)"
        + "".join(f" UNION ALL SELECT g, {k}, {cols} FROM {layered(name, factor_sql(1.0))}" for k, name in ((2, "two"), (3, "three"))) + ")",
    ]

    def step(source: str, k: int) -> None:
        """c{k}: the estimates that a C-step gives from those of source."""
        parts.append(f"t{k} AS MATERIALIZED (SELECT *, {BIN_OF} AS bin FROM {layered(f'(SELECT * FROM p JOIN {source} USING (g))', distance_sql())})")
        parts.append(f"b{k} AS MATERIALIZED (SELECT g, s, bin, {sums} FROM t{k} GROUP BY g, s, bin)")
        parts.append(f"u{k} AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY g, s ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_, sum(n) OVER (PARTITION BY g, s) AS total FROM b{k})")
        parts.append(f"h{k} AS (SELECT g, s, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in SUMS) + f" FROM u{k} WHERE before_ < ceil(total * {share}e0) GROUP BY g, s)")
        parts.append(f"c{k} AS MATERIALIZED (SELECT g, s, {cols} FROM {layered(f'h{k}', factor_sql(consistency(share)))})")

    for k in range(steps):
        step("e0" if k == 0 else f"c{k - 1}", k)
    last = f"f{steps}"
    parts.append(f"{last} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY det, s) AS nth FROM {f'c{steps - 1}' if steps else 'e0'}) WHERE nth = 1)")
    for k in range(steps, steps + most):
        step(last, k)
        took = ", ".join(f"CASE WHEN {FELL.replace('det', 'c.det').replace('old', 'f.det')} THEN c.{x} ELSE f.{x} END AS {x}" for x in PARAMS)
        parts.append(f"f{k + 1} AS MATERIALIZED (SELECT g, f.s, {took} FROM f{k} f JOIN c{k} c USING (g))")
        last = f"f{k + 1}"
    parts.append(f"near AS (SELECT g, {sums} FROM {layered(f'(SELECT * FROM p JOIN {last} USING (g))', distance_sql())} WHERE dist <= {chi2_tail(len(FLOOR), inlier_tail)!r} GROUP BY g)")
    parts.append(f"best AS MATERIALIZED (SELECT g, {cols} FROM {layered('near', factor_sql(consistency(1 - inlier_tail)))} WHERE n >= {least})")
    parts.append(f"z AS (SELECT * FROM {layered('(SELECT * FROM v LEFT JOIN best USING (g))', distance_sql())})")
    return f"""WITH {", ".join(parts)}
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND NOT coalesce(dist > {chi2_tail(len(FLOOR), outlier_tail)!r}, false) AS kept FROM z"""
