"""Quality rules with robust multivariate outlier detection, in DataFrame and SQL functions alone.

Per text: words, their characters, symbols, repeated lines, and words inside repeated windows of eight words. The
base rule fails short and repetitive texts. All others are judged by a vector of four transformed statistics against the
minimum-covariance-determinant estimate of their language and source: Mahalanobis distances above ``CUTOFF`` are rejected.

MCD: from coordinate medians and MADs, concentration steps repeatedly take the share ``H`` of a group's rows that lie
nearest and re-estimate centre and covariance from them. Statistics are fixed-point integers, so
all sums are exact and the result does not depend on how rows are dealt; order statistics are exact percentiles over a bounded
number of distinct integer values, aggregated before the shuffle, so a source with a third of all rows is no hot key. A floor
is added to each variance: many statistics are zero in nearly every text, and a zero spread would reject the rest.

Every row counts in three estimates: of its source and language, of its language, and of the whole table. A source's own estimate is drawn
towards its language's, and that towards the whole table's: own and wider count n^2 to ``PRIOR``^2 for centre and covariance alike, n
being the group's rows. A source of three rows, which one outlier could make its own, is thus judged nearly as its language, one of a
million by itself, and no size switches the rule.

Each estimate takes two starts, the coordinate medians with their MADs and the centre and covariance of all the group's rows, and the one of
smaller determinant after the last step stays. Steps are a fixed number; floors, and distances in steps of 1 / 200 in the logarithm, make
the determinant's descent approximate.

Defined results: null, empty and word-less texts have all counts zero and fail the base rule; null language or source is a group of
its own; repeated rows each get a row and count as often as they occur; null ids are judged like others; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

H = 0.75
STEPS = 4
PRIOR = 50
SCALE = 1000
#: Smallest spread of each statistic, in its own unit.
FLOORS = (0.3, 0.35, 0.35, 0.35)
#: chi-squared with four degrees of freedom: upper tail one in a million.
CUTOFF = 33.377
#: Makes the covariance of the nearest 75 % of normal rows consistent: H / P(chi2_6 <= chi2_4(H)).
CONSISTENCY = 1.5
P = len(FLOORS)
#: Largest value of a statistic (a mean word length of two million); squares are summed in two halves, so that sums stay exact.
MOST = (1 << 31) - 1
_HALF = 1 << 20
#: The whole table is one group and a source may hold a third of it: rows of a group are dealt over so many parts to meet its estimate.
SALTS = 64
WS = r"\x20\x09-\x0D"
_BINS = 200  # of log(1 + distance) in a unit


def text_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the column ``text``."""
    rows = docs.withColumn("_words", F.array_remove(F.split("text", f"[{WS}]+"), ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{WS}]"))
    hashes = F.transform("_words", lambda w: F.xxhash64(w))
    rows = rows.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        hashes.alias("_h"),
    )
    rows = rows.select(*keep, "n_words", "word_chars", "n_symbols", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), "_h",
        F.when(F.size("_h") < 9, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_h") - 7)), lambda i: F.xxhash64(F.slice("_h", i, 8)))).alias("_win"))
    # most texts repeat no window: only the others are sorted
    sorted_pairs = F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_pairs", F.when(F.size(F.array_distinct("_win")) < F.size("_win"), sorted_pairs)).drop("_win", "_h")
    beside = lambda k: F.coalesce(F.get("_pairs", k)["h"], F.lit(None).cast("long"))
    repeated = F.filter("_pairs", lambda x, k: x["h"].eqNullSafe(beside(k - 1)) | x["h"].eqNullSafe(beside(k + 1)))
    rows = rows.withColumn("_at", F.sort_array(F.transform(repeated, lambda x: x["i"]))).drop("_pairs")
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("_at", start, lambda acc, i: F.struct((i + 8).alias("end"), (acc["n"] + (i + 8) - F.greatest(i, acc["end"])).cast("long").alias("n")))
    return rows.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered["n"], F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics as integers of 1 / SCALE: mean word length, and the logarithms of symbols per hundred
    characters, repeated lines per hundred words and repeated words per hundred words."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    raw = [F.col("word_chars") / words, F.log1p(100 * F.col("n_symbols") / chars), F.log1p(100 * F.col("n_dup_lines") / words), F.log1p(100 * F.col("n_repeat_words") / words)]
    return [F.least(F.round(x * SCALE), F.lit(float(MOST))).cast("long").alias(f"x{i}") for i, x in enumerate(raw)]


def _lower(cov: list[list[Column]], rows: DataFrame) -> DataFrame:
    """Columns l{i}{j}: the Cholesky factor of a covariance given as columns, one row of the factor at a time."""
    for i in range(P):
        for j in range(i + 1):
            s = cov[i][j]
            for k in range(j):
                s = s - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            # floors on the diagonal make every pivot positive; the bound only guards rounding
            rows = rows.withColumn(f"l{i}{j}", F.sqrt(F.greatest(s, F.lit(1.0))) if i == j else s / F.col(f"l{j}{j}"))
    return rows


_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _covariances(rows: DataFrame, widen: float) -> DataFrame:
    """Per group ``g``: rows n, centre m{i} and covariance c{i}{j} with floors, from exact integer sums."""
    high = lambda i, j: F.sum(F.floor(F.col(f"x{i}") * F.col(f"x{j}") / _HALF).cast("long"))
    low = lambda i, j: F.sum(F.col(f"x{i}") * F.col(f"x{j}") - F.floor(F.col(f"x{i}") * F.col(f"x{j}") / _HALF).cast("long") * _HALF)
    sums = [F.count("*").alias("n")] + [F.sum(f"x{i}").alias(f"s{i}") for i in range(P)] + [x.alias(f"{k}{i}_{j}") for i, j in _PAIRS for k, x in (("h", high(i, j)), ("s", low(i, j)))]
    mean = [F.col(f"s{i}") / F.col("n") for i in range(P)]
    second = {(i, j): (F.col(f"h{i}_{j}") * float(_HALF) + F.col(f"s{i}_{j}")) / F.col("n") for i, j in _PAIRS}
    floor = lambda i, j: F.lit((FLOORS[i] * SCALE) ** 2 if i == j else 0.0)
    out = rows.groupBy("g").agg(*sums)
    return out.select("g", "n", *(mean[i].alias(f"m{i}") for i in range(P)), *(((second[i, j] - mean[i] * mean[j]) * widen + floor(i, j)).alias(f"c{i}{j}") for i, j in _PAIRS))


def _factored(rows: DataFrame, *keep: str | Column) -> DataFrame:
    """m{i} and l{i}{j} from m{i} and c{i}{j}."""
    cov = [[F.col(f"c{i}{j}") for j in range(i + 1)] for i in range(P)]
    return _lower(cov, rows).select(*keep, *(f"m{i}" for i in range(P)), *(f"l{i}{j}" for i, j in _PAIRS))


def _estimates(rows: DataFrame, widen: float) -> DataFrame:
    """Per group ``g``: centre m{i} and Cholesky factor of the covariance."""
    return _factored(_covariances(rows, widen), "g")


def _meet(rows: DataFrame, small: DataFrame) -> DataFrame:
    """``rows(g, salt, ..)`` with the columns of their group in ``small(g, ..)``, which is repeated for each salt."""
    return rows.join(small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["g", "salt"])


def _start(rows: DataFrame) -> DataFrame:
    """Per group the medians and, from them, a diagonal factor by the median absolute deviations."""
    medians = rows.groupBy("g").agg(*(F.percentile(f"x{i}", F.lit(0.5)).alias(f"m{i}") for i in range(P)))
    off = _meet(rows, medians).select("g", *(F.abs(F.col(f"x{i}") - F.col(f"m{i}")).alias(f"a{i}") for i in range(P)))
    spread = off.groupBy("g").agg(*(F.percentile(f"a{i}", F.lit(0.5)).alias(f"a{i}") for i in range(P)))
    scale = lambda i: F.sqrt(F.pow(F.col(f"a{i}") * 1.4826, 2) + (FLOORS[i] * SCALE) ** 2)
    return medians.join(spread, "g").select("g", *(f"m{i}" for i in range(P)), *((scale(i) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in range(P) for j in range(i + 1)))


def _distance() -> Column:
    """Squared Mahalanobis distance of x0.. from m0.. under the factor, by forward substitution."""
    y: list[Column] = []
    for i in range(P):
        s = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            s = s - F.col(f"l{i}{k}") * y[k]
        y.append(s / F.col(f"l{i}{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def mcd(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(g, n, m{i}, c{i}{j}) of every group of ``rows(g, salt, x0..)``, which should be a written table; n counts all the group's rows. Groups are
    as many as sources, so the estimates are small; Spark broadcasts them only below its own size bound."""
    xs = [f"x{i}" for i in range(P)]
    sizes = rows.groupBy("g").agg(F.count("*").alias("size"))
    starts = _start(rows).withColumn("start", F.lit(0)).unionByName(_estimates(rows, 1.0).withColumn("start", F.lit(1)))
    est = scratch.put(starts, "starts")
    for step in range(STEPS):
        near = _meet(rows, est).select(F.struct("g", "start").alias("g"), "salt", *xs, F.floor(F.log1p(_distance()) * _BINS).cast("long").alias("q"))
        bound = scratch.put(near.groupBy("g").agg(F.percentile("q", F.lit(H)).alias("bound")), "bounds")
        new = _covariances(_meet(near, bound).filter("q <= bound"), CONSISTENCY)
        if step + 1 < STEPS:
            made = scratch.put(_factored(new, F.col("g.g").alias("g"), F.col("g.start").alias("start")), "estimates")
        else:
            cov = [f"c{i}{j}" for i, j in _PAIRS]
            size = sum((F.log(F.col(f"l{i}{i}")) for i in range(1, P)), F.log(F.col("l00")))
            last = _lower([[F.col(f"c{i}{j}") for j in range(i + 1)] for i in range(P)], new).select("g", F.struct(size.alias("det"), F.col("g.start").alias("start"), *(f"m{i}" for i in range(P)), *cov).alias("e"))
            best = last.groupBy(F.col("g.g").alias("g")).agg(F.min("e").alias("e"))
            made = scratch.put(best.join(sizes, "g").select("g", F.col("size").alias("n"), *(f"e.m{i}" for i in range(P)), *(f"e.{c}" for c in cov)), "estimates")
        scratch.free(est, bound)
        est = made
    return est


def _drawn(own: DataFrame, wider: DataFrame, key: str) -> DataFrame:
    """``own(key, g, n, m, c)`` drawn towards ``wider(key, m, c)``, which counts as PRIOR rows."""
    values = [f"m{i}" for i in range(P)] + [f"c{i}{j}" for i, j in _PAIRS]
    both = own.join(wider.select(key, *(F.col(v).alias(f"w_{v}") for v in values)), key)
    rest = [c for c in own.columns if c not in values]
    share = 1.0 / (1.0 + F.pow(PRIOR / F.col("n"), 2))
    return both.select(*rest, *((F.col(v) * share + F.col(f"w_{v}") * (1 - share)).alias(v) for v in values))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, the five counts, base_failed, distance (null where the base rule fails) and kept, one row for each row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "quality")
    own = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        F.to_json(F.struct(F.col(f"`{lang_col}`").alias("l"))).alias("lang"), F.to_json(F.struct(F.col(f"`{lang_col}`").alias("l"), F.col(f"`{source_col}`").alias("s"))).alias("source"),
    )
    stats = text_statistics(own, "doc_id", "lang", "source").withColumn("base_failed", base_failed())
    stats = scratch.put(stats.select("*", *vector()), "statistics")
    xs = [f"x{i}" for i in range(P)]
    passed = stats.filter("not base_failed")
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt")
    judged = passed.select(F.explode(F.array(F.concat(F.lit("s"), "source"), F.concat(F.lit("l"), "lang"), F.lit("a"))).alias("g"), salt, *xs)
    est = mcd(judged, scratch)
    names = scratch.put(passed.select("lang", "source").distinct(), "names")
    whole = est.filter("g = 'a'").withColumn("all", F.lit(1))
    tongues = names.select("lang").distinct().join(est, F.concat(F.lit("l"), "lang") == F.col("g")).withColumn("all", F.lit(1))
    sources = names.join(est, F.concat(F.lit("s"), "source") == F.col("g"))
    finals = scratch.put(_factored(_drawn(sources, _drawn(tongues, whole, "all"), "lang"), "source"), "finals")
    out = stats.join(finals, "source", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & (F.col("distance") <= CUTOFF)
    scratch.free(est, names)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")


def op3_quality_mcd(spark: SparkSession, documents: DataFrame) -> DataFrame:
    return judge(documents)
