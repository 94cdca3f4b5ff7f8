"""Quality rules with risk-controlled thresholds, on DataFrame functions only.

Each rule is a number per document, higher when worse. Its cutoff in each stratum is chosen on labelled documents. The
cutoffs of a rule's grid are tested from lax to strict, until one fails: a test passes where the exact binomial tail shows
that at most ``alpha`` of the stratum's good documents lie above the cutoff. In a fixed sequence all tests may be made at
the same level, so the correction for multiple tests (Bonferroni's) is for the rules and the strata, not for the cutoffs:
with a chance of ``delta`` at most, any cutoff that passes rejects more than alpha of the good documents. The claim holds
for all cutoffs that passed at once, so among them the best one is taken, by the share of bad labelled documents above
it less ``cost`` times the share of good ones; a rule that gains nothing is off. The same labels choose and certify, which
the fixed sequence allows.

A stratum whose labels can't pass even a rule's laxest cutoff takes that rule's cutoff from all labels together, which are
one more stratum in the correction; the claim is then about all good documents. A test that no good document contradicts
needs ln(level) / ln(1 - alpha) of them, about 300 for the four rules and four strata.

Defined cases: a null or blank text has no words and fails the base rule; a null stratum is a stratum of its own;
repeated rows are rated alike, row by row; an empty table gives an empty table; extra columns, whatever their names,
are carried by ``filter_documents`` and ignored by ``rate``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import SPACE_CLASS, fresh_name, materialize, space_words

#: Cutoffs of each rule, from lax to strict.
GRIDS: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.5, 0.3, 0.2, 0.1, 0.05, 0.02),
    "dup_line_share": (0.9, 0.7, 0.5, 0.4, 0.3),
    "upper_share": (0.8, 0.6, 0.4, 0.2),
    "mean_word_chars": (20.0, 15.0, 12.0, 10.0, 9.0, 8.0, 7.0),
}


@dataclass(frozen=True)
class Risk:
    """alpha: largest share of good documents that a rule may reject in a stratum; delta: chance that any cutoff breaks it;
    cost: bad documents that one good one is worth when a cutoff is chosen."""

    alpha: float = 0.02
    delta: float = 0.05
    cost: float = 10.0


#: What ``measure`` adds.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed")


def _repeated(windows: Column, width: int) -> Column:
    """Words covered by windows whose hash occurs twice or more."""

    def covered(tagged: Column) -> Column:
        same = lambda x, i: (F.get(tagged, i - 1)["h"] == x["h"]) | (F.get(tagged, i + 1)["h"] == x["h"])
        return F.sort_array(F.transform(F.filter(tagged, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"]))

    def total(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(starts, i + 1) - p, F.lit(width))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)

    # transforms of one-element arrays bind the sorted arrays to variables, so that each is made once
    tagged = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    once = F.transform(F.transform(F.array(tagged), covered), total)
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(F.get(once, F.lit(0)))


def measure(narrow: DataFrame, width: int = 5) -> DataFrame:
    """Add the COUNTS and the GRIDS' rules to rows with a ``text``, and drop the text. One scan, no shuffle.

    Each step is a projection of its own and is read more than once by the next, so that Spark evaluates it once.
    """
    kept = [c for c in narrow.columns if c != "text"]
    text = F.coalesce("text", F.lit(""))
    out = narrow.select(
        *kept,
        space_words(text).alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]")).alias("lines"),
        F.length(F.regexp_replace(text, f"[{SPACE_CLASS}]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long").alias("n_upper"),
    )
    words, lines = F.col("words"), F.col("lines")
    counted = [*kept, "word_chars", "n_symbols", "n_upper"]
    hashes = F.transform(F.slice(words, F.lit(1), F.size(words) - (width - 1)), lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, width)]))
    out = out.select(
        *counted,
        F.size(words).cast("long").alias("n_words"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(F.size(words) >= width, hashes).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    out = out.select(*counted, "n_words", "n_lines", "n_dup_lines", _repeated(F.col("windows"), width).alias("n_repeat_words"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b)).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select(
        *kept,
        *COUNTS[:-1],
        failed.alias("base_failed"),
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_upper", "word_chars").alias("upper_share"),
        share("word_chars", "n_words").alias("mean_word_chars"),
    )


def certified(n: Column, k: Column, alpha: float, level: Column) -> Column:
    """Whether k rejections among n good documents show, at ``level``, a rejection rate of at most alpha.

    That is the exact binomial tail P(X <= k | n, alpha) <= level, the same as an upper Clopper-Pearson bound of at
    most alpha. The sum runs in logarithms from the largest term down, so no n underflows.
    """
    odds = math.log(alpha) - math.log1p(-alpha)
    start = F.struct((n * math.log1p(-alpha)).alias("term"), (n * math.log1p(-alpha)).alias("total"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double")) + F.lit(odds)
        high, low = F.greatest(term, s["total"]), F.least(term, s["total"])
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    tail = F.aggregate(F.sequence(F.lit(1).cast("long"), k), start, step)["total"]
    tail = F.when(k <= 0, n * math.log1p(-alpha)).otherwise(tail)
    return F.when((n <= 0) | (k > n * alpha), F.lit(False)).otherwise(tail <= F.log(level))


def calibrate(rated: DataFrame, labels: DataFrame, key: str, stratum: str, risk: Risk = Risk()) -> DataFrame:
    """One row per stratum and rule: stratum, rule, cutoff (null: rejects nothing), n_good, good_above, bad_above and pooled.

    ``rated`` has key, stratum and what ``measure`` adds, as a written table (it is read three times); ``labels`` has key and quality (1: good). A key labelled twice
    counts once, as good only if every label says so. Counts are summed map-side, so a hot stratum costs one row a task.
    """
    known = labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(key).alias("_k")).agg((F.min("quality") == 1).alias("_good"))
    sample = rated.where(~F.col("base_failed")).join(known, F.col(key) == F.col("_k"))
    above = lambda good: [F.sum((F.col("_good").eqNullSafe(F.lit(good)) & (F.col(r) > c)).cast("long")).alias(f"{r}_{j}_{good}") for r, grid in GRIDS.items() for j, c in enumerate(grid)]
    counted = sample.groupBy(F.col(stratum).alias("stratum")).agg(F.sum(F.col("_good").cast("long")).alias("n_good"), F.sum((~F.col("_good")).cast("long")).alias("n_bad"), *above(True), *above(False))
    counts = [c for c in counted.columns if c != "stratum"]
    strata = rated.select(F.col(stratum).alias("stratum")).distinct()
    own = strata.join(counted.withColumnRenamed("stratum", "s"), F.col("stratum").eqNullSafe(F.col("s")), "left").select("stratum", F.lit(False).alias("pooled"), *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
    every = own.unionByName(own.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts]).select(F.lit(None).cast(own.schema["stratum"].dataType).alias("stratum"), F.lit(True).alias("pooled"), *counts))
    m = strata.agg(F.count(F.lit(1)) + 1).scalar()
    level = F.lit(risk.delta) / (F.lit(float(len(GRIDS))) * m)
    rules = [F.struct(F.lit(r).alias("rule"), F.array(*[F.struct(F.lit(float(c)).alias("cutoff"), F.col(f"{r}_{j}_True").alias("good"), F.col(f"{r}_{j}_False").alias("bad")) for j, c in enumerate(grid)]).alias("steps")) for r, grid in GRIDS.items()]
    long = every.select("stratum", "pooled", "n_good", "n_bad", level.alias("level"), F.explode(F.array(*rules)).alias("x")).select("stratum", "pooled", "n_good", "n_bad", "level", "x.*")
    share = lambda k, n: k / F.greatest(n, F.lit(1))

    def step(s: Column, x: Column) -> Column:
        ok = s["ok"] & certified(F.col("n_good"), x["good"], risk.alpha, F.col("level"))
        gain = share(x["bad"], F.col("n_bad")) - risk.cost * share(x["good"], F.col("n_good"))
        better = ok & (gain > s["gain"])
        take = lambda name, new: F.when(better, new).otherwise(s[name]).alias(name)
        return F.struct(ok.alias("ok"), (s["some"] | ok).alias("some"), take("gain", gain), take("cutoff", x["cutoff"]), take("good", x["good"]), take("bad", x["bad"]))

    none = lambda kind: F.lit(None).cast(kind)
    start = F.struct(F.lit(True).alias("ok"), F.lit(False).alias("some"), F.lit(0.0).alias("gain"), none("double").alias("cutoff"), none("long").alias("good"), none("long").alias("bad"))
    chosen = long.select("stratum", "pooled", "rule", "n_good", F.aggregate("steps", start, step).alias("c"))
    pool = chosen.where("pooled").select(F.col("rule").alias("r"), F.col("c").alias("p"), F.col("n_good").alias("pool_good"))
    joined = chosen.where("not pooled").join(pool, F.col("rule") == F.col("r"))
    pick = lambda own, pooled: F.when(F.col("c.some"), own).otherwise(pooled)
    return joined.select("stratum", "rule", *[pick(F.col(f"c.{a}"), F.col(f"p.{a}")).alias(b) for a, b in (("cutoff", "cutoff"), ("good", "good_above"), ("bad", "bad_above"))], pick(F.col("n_good"), F.col("pool_good")).alias("n_good"), (~F.col("c.some")).alias("pooled"))


def judge(rated: DataFrame, cutoffs: DataFrame, stratum: str) -> DataFrame:
    """Add ``failed_rules``: null-free array of the rules whose cutoff in the row's stratum is exceeded.

    The cutoffs become one row per stratum; Spark broadcasts them while they are under the broadcast threshold, and
    otherwise joins by shuffle, where adaptive execution splits a hot stratum.
    """
    own = fresh_name(rated, "cutoffs")
    c = cutoffs.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(r) for r in GRIDS]).select(F.struct("*").alias(own))
    out = rated.join(c, F.col(stratum).eqNullSafe(F.col(f"{own}.stratum")), "left")
    hits = [F.when(F.col(r) > F.col(f"{own}.{r}"), F.lit(r)) for r in GRIDS]
    return out.withColumn("failed_rules", F.array_compact(F.array(*hits))).drop(own)


def rate(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", risk: Risk = Risk()) -> DataFrame:
    """One row per document: key, the counts, base_failed, failed_rules and kept.

    The counts are written once as a narrow table; calibration and verdict both read that, never the texts again. The
    cutoffs are written too, so that the planner knows their size before it joins them to the rows.
    """
    narrow = docs.select(F.col(key).alias("key"), F.col(stratum).alias("stratum"), F.col(text).alias("text"))
    rated = materialize(measure(narrow), "quality-counts")
    lab = labels.select(F.col("doc_id").alias("key"), "quality")
    cutoffs = materialize(calibrate(rated, lab, "key", "stratum", risk), "quality-cutoffs")
    judged = judge(rated, cutoffs, "stratum")
    kept = ~F.col("base_failed") & (F.size("failed_rules") == 0)
    return judged.select(
        F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.concat_ws(",", "failed_rules").alias("failed_rules")
    )


def filter_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", risk: Risk = Risk()) -> DataFrame:
    """The rows of docs, with all their columns, that the rules keep.

    Rows and counts are written once, so that texts are measured once and never shuffled; calibration reads the counts
    alone. The cutoffs are written too, so that the planner knows their size before it joins them to the rows.
    """
    boxed = docs.select(F.struct("*").alias("row"), F.col(key).alias("key"), F.col(stratum).alias("stratum"), F.col(text).alias("text"))
    rated = materialize(measure(boxed), "quality-rated")
    lab = labels.select(F.col("doc_id").alias("key"), "quality")
    cutoffs = materialize(calibrate(rated, lab, "key", "stratum", risk), "quality-cutoffs")
    judged = judge(rated, cutoffs, "stratum")
    return judged.where(~F.col("base_failed") & (F.size("failed_rules") == 0)).select("row.*")


def oracle_sql(risk: Risk = Risk()) -> str:
    """The result of ``rate`` on documents and labels in DuckDB's SQL."""
    steps = ", ".join(f"('{r}', {j}, {float(c)!r})" for r, grid in GRIDS.items() for j, c in enumerate(grid))
    return f"""
        WITH step(rule, j, cutoff) AS (VALUES {steps}),
        d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
        c AS (SELECT rid, doc_id, lang, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
                     CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper FROM d),
        win AS (SELECT rid, i, list_slice(words, i::INT, i::INT + 4) AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM c WHERE len(words) >= 5)),
        dup AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
        rep AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM dup, range(5) t(k) GROUP BY rid),
        m AS (SELECT rid, doc_id, lang, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, n_symbols, n_upper, len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM c LEFT JOIN rep USING (rid)),
        r AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_share, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_share,
                     CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0 END AS upper_share, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars FROM m),
        v AS (SELECT rid, lang, doc_id, base_failed, unnest(['symbol_share', 'dup_line_share', 'upper_share', 'mean_word_chars']) AS rule, unnest([symbol_share, dup_line_share, upper_share, mean_word_chars]) AS value FROM r),
        known AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
        strata AS (SELECT DISTINCT lang, false AS pooled FROM d UNION ALL SELECT NULL, true),
        n AS (SELECT s.lang, s.pooled, rule, j, cutoff, coalesce(sum(good::INT), 0) AS n, coalesce(sum((NOT good)::INT), 0) AS n_bad, coalesce(sum((good AND value > cutoff)::INT), 0) AS k, coalesce(sum((NOT good AND value > cutoff)::INT), 0) AS k_bad
              FROM strata s CROSS JOIN step LEFT JOIN (SELECT v.*, good FROM v JOIN known USING (doc_id) WHERE NOT base_failed) x USING (rule)
              WHERE x.rid IS NULL OR s.pooled OR x.lang IS NOT DISTINCT FROM s.lang GROUP BY ALL),
        every AS (SELECT s.lang, s.pooled, step.rule, step.j, step.cutoff, coalesce(n, 0) AS n, coalesce(n_bad, 0) AS n_bad, coalesce(k, 0) AS k, coalesce(k_bad, 0) AS k_bad FROM strata s CROSS JOIN step
                  LEFT JOIN n ON n.lang IS NOT DISTINCT FROM s.lang AND n.pooled = s.pooled AND n.rule = step.rule AND n.j = step.j),
        tail AS (SELECT *, list_sum(list_transform(range(0, k::BIGINT + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk.alpha!r}) + (n - i) * ln(1 - {risk.alpha!r})))) AS p FROM every),
        passed AS (SELECT *, bool_and(n > 0 AND k <= n * {risk.alpha!r} AND p <= {risk.delta!r} / ({len(GRIDS)} * (SELECT count(*) FROM strata))) OVER (PARTITION BY lang, pooled, rule ORDER BY j) AS ok,
                          k_bad / greatest(n_bad, 1) - {risk.cost!r} * k / greatest(n, 1) AS gain FROM tail),
        best AS (SELECT lang, pooled, rule, bool_or(ok) AS some, arg_max(cutoff, gain * 1e9 - j) FILTER (ok AND gain > 0) AS cutoff FROM passed GROUP BY ALL),
        cut AS (SELECT b.lang, b.rule, CASE WHEN b.some THEN b.cutoff ELSE p.cutoff END AS cutoff FROM best b JOIN best p ON p.rule = b.rule AND p.pooled WHERE NOT b.pooled),
        hit AS (SELECT rid, list(v.rule) AS rules FROM v JOIN cut ON cut.rule = v.rule AND cut.lang IS NOT DISTINCT FROM v.lang AND value > cutoff GROUP BY rid)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rules IS NULL AS kept,
               array_to_string(list_filter(['symbol_share', 'dup_line_share', 'upper_share', 'mean_word_chars'], lambda x: list_contains(coalesce(rules, []), x)), ',') AS failed_rules
        FROM r LEFT JOIN hit USING (rid)"""
