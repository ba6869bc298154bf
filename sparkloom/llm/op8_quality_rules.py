"""Quality rules with robust multivariate outliers, in DataFrame operations only.

Counts of a text come from array functions over its words, without exploding them. Documents that pass
the fixed limits give a vector of transformed statistics: log words, log mean word length, log symbol rate,
and the square roots of the shares of repeated lines and repeated words. For each language and source a
minimum-covariance-determinant estimate is sought. Three starts are tried: the medians and quartile ranges
alone, the covariance of the hyperbolic tangents and that of the signs of the so scaled vectors. A step takes
the mean and covariance of the share ``H`` of the rows with the least distance; after ``TRIED`` steps the start
with the least determinant goes on until the determinant no longer falls. ``FLOORS`` are the least standard deviations,
put in where a statistic varies less, and correlations are shrunk by ``RIDGE``, so that every determinant is
positive.

The statistics are not normal, so the squared distances are calibrated in each group: by median and quartile range
their cube roots are brought to those of chi-squared (never made narrower). A document beyond the chi-squared
quantile for ``tail`` is rejected.

A step needs counts, sums and products per bin of the distance only; they cover all rows, merge exactly on the map
side, and a group, whatever its size, has a bounded number of them. The bins are narrow (a 16th of an e-fold), so
the share kept is ``H`` up to a bin. Groups under ``min_rows`` are pooled by language; pools still under it are judged
by the estimate over all documents, however few there are.

Cases: null and empty text has no words and fails the base rules; null language and source are groups of
their own; repeated rows are judged each; any length is read whole; columns not named are ignored, whatever their
names; equal documents have distance 0; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

#: Names of the statistics and the least standard deviation each is given.
FLOORS = {"x_words": 0.4, "x_length": 0.08, "x_symbols": 0.5, "x_lines": 0.1, "x_repeats": 0.1}
P = len(FLOORS)
#: Share of the rows that the estimate is made of; steps at most; steps in which all starts are tried; change of the
#: determinant's logarithm that ends them; what correlations are shrunk by.
H, STEPS, TRIED, SETTLED, RIDGE = 0.75, 30, 2, 1e-3, 0.02
#: Share of a normal sample beyond the cutoff.
TAIL = 1e-3
#: Median and standard deviation of the cube root of chi-squared with P degrees of freedom (Wilson-Hilferty). The least median distance
#: that is calibrated, as a share of chi-squared's: below it, most documents are copies and the floors give the unit.
MEDIAN, SPREAD, LEAST = P ** (1 / 3) * (1 - 2 / (9 * P)), P ** (1 / 3) * (2 / (9 * P)) ** 0.5, 0.1
#: Bins an e-fold of a squared distance.
FINE = 16
#: Estimates that may be broadcast: at about 400 bytes each, 40 MB.
BROADCAST_ROWS = 100_000
#: Groups whose tallies (some hundred rows each) a task takes.
GROUPS = 2_000
_WS = r"[\x20\x09-\x0D]+"
_BLANK = " \t\n\x0b\x0c\r"


def chi_square(share: float, p: int) -> float:
    """The quantile of chi-squared, by the Wilson-Hilferty approximation."""
    return p * (1 - 2 / (9 * p) + NormalDist().inv_cdf(share) * (2 / (9 * p)) ** 0.5) ** 3


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def base_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words, drops the text."""
    d = docs.withColumn("_t", F.coalesce(F.col(text_col).cast("string"), F.lit(""))).drop(text_col)
    d = d.withColumn("_w", F.array_remove(F.split("_t", _WS, -1), ""))
    d = d.withColumn("_l", F.filter(F.split("_t", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(_BLANK))) > 0))
    d = d.withColumn("_n", F.size("_w")).withColumn("n_symbols", F.length("_t") - F.length(F.regexp_replace("_t", "[#*$%&|<>]", "")))
    d = d.withColumn("word_chars", F.length(F.array_join("_w", ""))).withColumn("n_lines", F.size("_l")).withColumn("n_dup_lines", F.size("_l") - F.size(F.array_distinct("_l")))
    # Three-word windows as hashes; only a text in which one stands twice goes on to sort them.
    hashes = F.transform(F.sequence(F.lit(0), F.col("_n") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))
    d = d.withColumn("_h", F.when(F.col("_n") >= 3, hashes)).drop("_t", "_l")
    d = d.withColumn("_h", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.col("_h"))).drop("_w")
    d = d.withColumn("_s", F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).drop("_h")
    last, at = F.size("_s") - 1, lambda j: F.get("_s", j)["h"]
    twice = F.filter(F.sequence(F.lit(0), last), lambda j: ((j > 0) & (at(j) == at(F.greatest(j - 1, F.lit(0))))) | ((j < last) & (at(j) == at(F.least(j + 1, last)))))
    d = d.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(F.transform(twice, lambda j: F.get("_s", j)["i"])))).drop("_s")
    gaps = F.zip_with(F.slice("_p", 2, F.size("_p")), F.slice("_p", 1, F.size("_p") - 1), lambda b, a: F.least(b - a, F.lit(3)))
    covered = F.aggregate(gaps, F.lit(3), lambda s, g: s + g)  # a window covers three words, or up to the next one
    d = d.withColumn("n_repeat_words", F.when(F.col("_p").isNotNull(), covered).otherwise(0)).drop("_p").withColumnRenamed("_n", "n_words")
    return d.select(*[F.col(c).cast("long") if c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words") else F.col(c) for c in d.columns])


def statistic_vector(df: DataFrame) -> DataFrame:
    n, chars = F.col("n_words").cast("double"), F.col("word_chars").cast("double")
    return df.withColumns({
        "x_words": F.log1p(n), "x_length": F.log((chars + 1) / (n + 1)), "x_symbols": F.log1p(F.lit(1000.0) * F.col("n_symbols") / (chars + 1)),
        "x_lines": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))), "x_repeats": F.sqrt(F.col("n_repeat_words") / F.greatest(n, F.lit(1.0))),
    })


def _quantiles(binned: DataFrame, keys: list[str], share: list[float]) -> DataFrame:
    """Per key the bins in which the cumulative count ``n`` reaches each share; columns q0, q1, ..."""
    w = Window.partitionBy(*keys)
    cum = binned.withColumn("c", F.sum("n").over(w.orderBy("bin"))).withColumn("n", F.sum("n").over(w))
    return cum.groupBy(*keys).agg(*[F.min(F.when(F.col("c") >= F.lit(s) * F.col("n"), F.col("bin"))).alias(f"q{k}") for k, s in enumerate(share)])


def _inverse(matrix: Column) -> Column:
    """Inverse (m) and logarithm of the determinant (ld) of a positive definite matrix in row order, by Gauss-Jordan steps in place."""

    def step(acc: Column, k: Column) -> Column:
        m = acc["m"]
        pivot = F.get(m, k * (P + 1))

        def cell(v: Column, at: Column) -> Column:
            j = at % P
            i = F.floor((at - j) / P).cast("int")
            rest = v - F.get(m, i * P + k) * F.get(m, k * P + j) / pivot
            return F.when((i == k) & (j == k), 1 / pivot).when(i == k, v / pivot).when(j == k, -v / pivot).otherwise(rest)

        return F.struct(F.transform(m, cell).alias("m"), (acc["ld"] + F.log(pivot)).alias("ld"))

    return F.aggregate(F.array(*[F.lit(k) for k in range(P)]), F.struct(matrix.alias("m"), F.lit(0.0).alias("ld")), step)


def _positive(products: dict[tuple[int, int], Column], least: list[Column]) -> Column:
    """The matrix in row order, off the diagonal shrunk by RIDGE and on it raised to ``least``: always positive definite."""
    at = lambda i, j: F.greatest(products[i, i], least[i]) if i == j else products[max(i, j), min(i, j)] * F.lit(1 - RIDGE)
    return F.array(*[at(i, j) for i in range(P) for j in range(P)])


def _distance(inverse: str = "p", centre: str = "c", z: Callable[[int], Column] | None = None) -> Column:
    """Squared Mahalanobis distance of z0, z1, ... by the inverse matrix."""
    u = [(z(i) if z else F.col(f"z{i}")) - F.get(centre, i) for i in range(P)]
    rows = [u[i] * sum((F.get(inverse, i * P + j) * u[j] * F.lit(1.0 if i == j else 2.0) for j in range(i, P)), F.lit(0.0)) for i in range(P)]
    return F.greatest(sum(rows, F.lit(0.0)), F.lit(0.0))


def _bin(d2: Column) -> Column:
    return F.floor(F.log(F.greatest(d2, F.lit(1e-6))) * FINE).cast("int")


_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _scales(vectors: DataFrame) -> DataFrame:
    """Per group medians m, scales s from the quartiles (FLOORS at least) and the floors' variances f in these scales."""
    grain = F.array(*[F.lit(f / 8) for f in FLOORS.values()])
    long = vectors.select("gid", F.posexplode(F.array(*FLOORS)).alias("i", "x")).select("gid", "i", F.floor(F.col("x") / F.get(grain, F.col("i"))).alias("bin"))
    q = _quantiles(long.groupBy("gid", "i", "bin").agg(F.count("*").alias("n")), ["gid", "i"], [0.25, 0.5, 0.75]).withColumn("grain", F.get(grain, F.col("i")))
    s = F.greatest((F.col("q2") - F.col("q0")) * F.col("grain") / 1.349, F.col("grain") * 8)
    rows = F.sort_array(F.collect_list(F.struct("i", ((F.col("q1") + 0.5) * F.col("grain")).alias("m"), s.alias("s"), F.pow(F.col("grain") * 8 / s, 2).alias("f"))))  # P rows a group
    return q.groupBy("gid").agg(rows.alias("r")).select("gid", "r.m", "r.s", "r.f")


def _starts(rows: DataFrame, scales: DataFrame) -> DataFrame:
    """Three first estimates of each group (gid, start, c, p, ld): the scales alone, the covariance of tanh(z) and that of the signs z / |z|."""
    norm = F.greatest(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)), F.lit(0.0)), F.lit(1e-12))
    t = [F.tanh(f"z{i}") for i in range(P)]
    sums = rows.groupBy("gid").agg(
        *[F.avg(t[i]).alias(f"t{i}") for i in range(P)], *[F.avg(t[i] * t[j]).alias(f"t{i}_{j}") for i, j in _PAIRS], *[F.avg(F.col(f"z{i}") * F.col(f"z{j}") / norm).alias(f"s{i}_{j}") for i, j in _PAIRS],
    )
    least = [F.lit(0.05)] * P
    tanh = _positive({(i, j): F.col(f"t{i}_{j}") - F.col(f"t{i}") * F.col(f"t{j}") for i, j in _PAIRS}, least)
    sign = _positive({(i, j): F.col(f"s{i}_{j}") for i, j in _PAIRS}, least)
    unit = F.array(*[F.lit(1.0 if i == j else 0.0) for i in range(P) for j in range(P)])
    starts = sums.select("gid", F.posexplode(F.array(unit, tanh, sign)).alias("start", "a")).select("gid", "start", _inverse(F.col("a")).alias("v"))
    return starts.join(scales.select("gid", "f"), "gid").select("gid", "start", F.array(*[F.lit(0.0)] * P).alias("c"), F.col("v.m").alias("p"), F.col("v.ld").alias("ld"), "f")


def _tally(rows: DataFrame, params: DataFrame, n: int) -> DataFrame:
    """Per group, start and bin of the distance: count, sums and products of the vectors. This is all that a step needs, and
    has a bounded number of rows a group."""
    z = [F.col(f"z{i}") for i in range(P)]
    binned = rows.join(small(params, n), "gid").select("gid", "start", _bin(_distance()).alias("bin"), *[x.alias(f"z{i}") for i, x in enumerate(z)])
    return binned.groupBy("gid", "start", "bin").agg(F.count("*").alias("n"), *[F.sum(x).alias(f"a{i}") for i, x in enumerate(z)], *[F.sum(z[i] * z[j]).alias(f"a{i}_{j}") for i, j in _PAIRS])


def _concentrated(tally: DataFrame, params: DataFrame) -> DataFrame:
    """The estimates from the share H of the rows with the least distances, and the quartiles of the distance under the old ones."""
    w = Window.partitionBy("gid", "start")
    cum = tally.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "all": F.sum("n").over(w)})
    near, total = F.col("upto") - F.col("n") < F.lit(H) * F.col("all"), F.sum(F.when(F.col("upto") - F.col("n") < F.lit(H) * F.col("all"), F.col("n")))
    mean = lambda c: F.sum(F.when(near, F.col(c))) / total
    bins = [F.min(F.when(F.col("upto") >= share * F.col("all"), F.col("bin"))).alias(f"b{k}") for k, share in enumerate((0.25, 0.5, 0.75))]
    sums = cum.groupBy("gid", "start").agg(F.array(*bins).alias("bins"), *[mean(f"a{i}").alias(f"a{i}") for i in range(P)], *[mean(f"a{i}_{j}").alias(f"a{i}_{j}") for i, j in _PAIRS])
    cov = _positive({(i, j): F.col(f"a{i}_{j}") - F.col(f"a{i}") * F.col(f"a{j}") for i, j in _PAIRS}, [F.get("f", i) for i in range(P)])
    old = params.select("gid", "start", "f", F.col("c").alias("c0"), F.col("p").alias("p0"), F.col("ld").alias("ld0"))
    new = sums.join(old, ["gid", "start"]).withColumn("v", _inverse(cov))
    return new.select("gid", "start", F.array(*[F.col(f"a{i}") for i in range(P)]).alias("c"), F.col("v.m").alias("p"), F.col("v.ld").alias("ld"), "f", "bins", "c0", "p0", "ld0")


def _few(df: DataFrame, rows: int) -> DataFrame:
    """Estimates of so many groups in few files; a task merges the tallies of GROUPS groups."""
    return df.coalesce(max(1, -(-rows // GROUPS)))


def robust_estimates(vectors: DataFrame) -> DataFrame:
    """Per gid: m and s (medians and scales), and in these scales the centre c, the inverse covariance p, and median and spread of
    the distances' cube roots: see ``_calibrated``."""
    scales = scratch.table(_scales(vectors), "mcd-scales")
    n = scales.count()
    z = [((F.col(x) - F.get("m", i)) / F.get("s", i)).alias(f"z{i}") for i, x in enumerate(FLOORS)]
    rows = scratch.table(vectors.join(small(scales, n), "gid").select("gid", *z), "mcd-rows")
    params, starts, ends = scratch.table(_few(_starts(rows, scales), 3 * n), "mcd-start"), 3, []
    for step in range(STEPS):
        new = _concentrated(_tally(rows, params, n * starts), params)
        if step + 1 == TRIED:  # the start that leads to the least determinant goes on
            new = new.withColumn("k", F.row_number().over(Window.partitionBy("gid").orderBy("ld", "start"))).filter("k = 1").drop("k")
            starts = 1
        params = scratch.table(_few(new, n * starts), f"mcd-{step}")
        if step + 1 > TRIED:
            going = F.col("ld") < F.col("ld0") - F.lit(SETTLED)
            ends.append(params if step + 1 == STEPS else params.filter(~going))
            params = params.filter(going)
            if not params.head(1):
                break
    # A group ends with the estimates whose distances the last step tallied: its determinant has settled under them.
    params = reduce(DataFrame.union, ends)
    root = [F.exp((F.get("bins", k) + 0.5) / (3 * FINE)) for k in range(3)]
    least = MEDIAN * LEAST ** (1 / 3)
    spread = F.greatest((root[2] - root[0]) / 1.349, F.greatest(root[1], F.lit(least)) * (SPREAD / MEDIAN))
    ends = params.select("gid", F.col("c0").alias("c"), F.col("p0").alias("p"), F.greatest(root[1], F.lit(least)).alias("middle"), spread.alias("spread"))
    return scratch.table(_few(ends.join(scales.select("gid", "m", "s"), "gid"), n), "mcd-last")


def _calibrated(d2: Column) -> Column:
    """The squared distance as that of a normal sample: cube roots of chi-squared values are nearly normal, so the roots' median and
    spread in the group are brought to those of P degrees of freedom. The spread is never narrowed."""
    return F.pow(F.greatest((F.cbrt(d2) - F.col("middle")) / F.col("spread") * SPREAD + MEDIAN, F.lit(0.0)), 3.0)


def _judged(docs: DataFrame, min_words: int, max_repeat_percent: int, tail: float, min_rows: int, id_col: str, text_col: str, lang_col: str, source_col: str, carry: list[Column]) -> DataFrame:
    """The statistics with base_failed, distance2 and kept; carried columns as _carry."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"), *([F.struct(*carry).alias("_carry")] if carry else []))
    stats = base_statistics(own, "_text")
    stats = stats.withColumn("base_failed", (F.col("n_words") < min_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(max_repeat_percent) * F.col("n_words")))
    # Null and text keys apart, so that a null never equals a value.
    stats = stats.withColumns({"_lang": F.to_json(F.struct("_lang")), "_source": F.to_json(F.struct("_source"))})
    stats = scratch.table(statistic_vector(stats), "quality-statistics")
    sizes = stats.filter(~F.col("base_failed")).groupBy("_lang", "_source").agg(F.count("*").alias("n"))
    rest = F.sum(F.when(F.col("n") < min_rows, F.col("n")).otherwise(0)).over(Window.partitionBy("_lang"))
    level = F.when(F.col("n") >= min_rows, 2).when(rest >= min_rows, 1).otherwise(0)
    groups = sizes.withColumn("level", level)
    key = F.struct(F.when(F.col("level") >= 1, F.col("_lang")).alias("l"), F.when(F.col("level") == 2, F.col("_source")).alias("s"))
    groups = scratch.table(groups.select("_lang", "_source", "level", F.when(F.col("level") > 0, F.to_json(key)).otherwise("all").alias("gid")), "quality-groups")
    n, lone = groups.agg(F.count("*"), F.count(F.when(F.col("level") == 0, 1))).head()
    passed = stats.filter(~F.col("base_failed"))
    vectors = passed.join(small(groups.filter("level > 0"), n), ["_lang", "_source"]).select("gid", *FLOORS)
    if lone:  # too few anywhere: judged by all documents
        vectors = vectors.unionByName(passed.select(F.lit("all").alias("gid"), *FLOORS))
    placed = groups.select("_lang", "_source", "gid").join(robust_estimates(vectors), "gid")
    judged = stats.join(small(placed, n), ["_lang", "_source"], "left")
    z = [(F.col(x) - F.get("m", i)) / F.get("s", i) for i, x in enumerate(FLOORS)]
    judged = judged.withColumn("distance2", F.when(~F.col("base_failed"), _calibrated(_distance(z=z.__getitem__))))
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance2") <= chi_square(1 - tail, P), F.lit(True)))


def quality_rules(
    docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, tail: float = TAIL, min_rows: int = 30,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """Per row: doc_id, the statistics, base_failed, kept and distance2 (null where the base rules fail)."""
    judged = _judged(docs, min_words, max_repeat_percent, tail, min_rows, id_col, text_col, lang_col, source_col, [])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


def good_documents(
    docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, tail: float = TAIL, min_rows: int = 30,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """The rows that are kept, with all their columns."""
    judged = _judged(docs, min_words, max_repeat_percent, tail, min_rows, id_col, text_col, lang_col, source_col, scratch.columns(docs))
    return judged.filter("kept").select("_carry.*")


def base_rules(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts and the fixed limits alone, without the estimates: what SQL can express of the rules."""
    stats = base_statistics(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text")), "_text")
    failed = (F.col("n_words") < min_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(max_repeat_percent) * F.col("n_words"))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


#: ``base_rules`` in DuckDB's SQL, over ``documents``.
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS s FROM documents),
w AS (SELECT doc_id, s, regexp_extract_all(s, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(s, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT *, list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) AS g FROM w),
m AS (SELECT *, list_histogram(g) AS h FROM g),
r AS (SELECT *, list_transform(g, lambda x: h[x] > 1) AS twice FROM m),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(s) - length(regexp_replace(s, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(len(list_filter(range(1, len(w) + 1), lambda i: coalesce(twice[i], false) OR (i > 1 AND coalesce(twice[i - 1], false)) OR (i > 2 AND coalesce(twice[i - 2], false)))) AS BIGINT) AS n_repeat_words FROM r)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
"""
