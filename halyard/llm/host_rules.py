"""Quality rules with host-level verdicts (DataFrame operations only).

Every text gets its rule figures. Four rules may fail: too few words, mostly repeated words, many symbols, many repeated
lines; a document that fails one of the first two is rejected by itself. Failures of each rule are counted by host (the
source column), a beta prior is fitted to the hosts' rates of the rule by the method of moments, and each host's rate is
shrunk towards it. A host is rejected, with all its documents, if for any rule the lower credible bound of its rate is
above the rule's limit: ``TIMES`` the corpus mean, but ``LEAST_RATE`` at least and ``MOST_RATE`` at most. A host with few
documents stays near the prior and has wide bounds, so a few failures do not condemn it.

Nulls: a null text is empty, null sources are one host. Empty texts have no words and fail. Repeated rows count each.
Texts of any length are measured whole. An empty table gives an empty result. Other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import SPACE, WORD, checkpointed, kept_table, sized, whole_text

#: Rules and limits of the production run: percentages of words, of symbols by word, and of lines.
MIN_WORDS, REPEAT_PERCENT, SYMBOL_PERCENT, LINE_PERCENT = 50, 50, 10, 30
TIMES, LEAST_RATE, MOST_RATE, DEVIATIONS = 3.0, 0.25, 0.9, 2.0
RULES = ("short", "repeats", "symbols", "lines")


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in ``words``.

    Windows are 64-bit hashes; only texts with a repeated one sort them with their places.
    """
    at = F.sequence(F.lit(0), F.size(words) - 3)
    hashes = F.transform(at, lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))

    def covered(hashed: Column) -> Column:
        placed = F.sort_array(F.transform(hashed, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        last = F.size(hashed) - 1

        def places(p: Column) -> Column:
            twin = lambda x, k: (F.when(k > 0, p[k - 1]["h"] == x["h"]).otherwise(False)) | (F.when(k < last, p[k + 1]["h"] == x["h"]).otherwise(False))
            return F.sort_array(F.transform(F.filter(p, twin), lambda x: x["i"]))

        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).cast("long").alias("n"), i.alias("last"))
        return F.aggregate(_let(placed, places), zero, step, lambda acc: acc["n"])

    counted = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(counted)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def figures(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """The rule figures of every row, and ``base_failed``."""
    text = whole_text()
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    of_words = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("rep")))
    out = docs.select(
        *keep,
        of_words.alias("w"),
        (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
    )
    n, rep, dup = F.col("w.n"), F.col("w.rep"), F.col("l.dup")
    fails = {
        "short": n < MIN_WORDS, "repeats": 100 * rep > REPEAT_PERCENT * n, "symbols": 100 * F.col("n_symbols") > SYMBOL_PERCENT * n,
        "lines": 100 * dup > LINE_PERCENT * F.col("l.n"),
    }
    figures_ = [n.alias("n_words"), "word_chars", "n_symbols", dup.alias("n_dup_lines"), rep.alias("n_repeat_words")]
    return out.select(*keep, *figures_, (fails["short"] | fails["repeats"]).alias("base_failed"), F.struct(*(c.alias(r) for r, c in fails.items())).alias("fails"))


def host_rates(scored: DataFrame, host: str = "source", times: float = TIMES) -> DataFrame:
    """Per host: its documents, each rule's failures, the rates shrunk towards the fitted beta priors, and whether it is rejected."""
    failed = [F.sum(F.col(f"fails.{r}").cast("long")).alias(f"failed_{r}") for r in RULES]
    hosts = checkpointed(scored.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), *failed))
    seen = [f(r).alias(f"{name}_{r}") for r in RULES for name, f in (("sum", lambda r: F.sum(f"failed_{r}")), ("var", lambda r: F.var_samp(F.col(f"failed_{r}") / F.col("n"))))]
    row = hosts.agg(F.sum("n").alias("n"), F.avg(1 / F.col("n")).alias("inv"), *seen).first()
    rejected, out = F.lit(False), hosts
    for r in RULES:
        alpha, beta = beta_prior(row[f"sum_{r}"] or 0, row["n"] or 0, row[f"var_{r}"], row["inv"])
        mean = alpha / (alpha + beta)
        rate, weight = F.col(f"rate_{r}"), F.col("n") + F.lit(alpha + beta)
        out = out.withColumn(f"rate_{r}", (F.col(f"failed_{r}") + F.lit(alpha)) / weight)
        bound = rate - F.lit(DEVIATIONS) * F.sqrt(rate * (1 - rate) / (weight + 1))
        rejected = rejected | (bound > F.lit(min(max(times * mean, LEAST_RATE), MOST_RATE)))
    return out.withColumn("host_rejected", rejected)


def beta_prior(failed: int, n: int, variance: float | None, inverse: float | None) -> tuple[float, float]:
    """Moments: the hosts' variance less what sampling alone explains; a strong prior at the mean where hosts do not differ,
    and never one of fewer than ten documents."""
    mean = (failed + 0.5) / (n + 1)
    between = (variance or 0.0) - mean * (1 - mean) * (inverse or 0.0)
    strength = mean * (1 - mean) / between - 1 if between > 1e-9 else 1e4
    strength = min(max(strength, 10.0), 1e4)
    return mean * strength, (1 - mean) * strength


def judged(docs: DataFrame, times: float = TIMES) -> DataFrame:
    """Every row's figures, its host's shrunk rates and verdict, and whether it is kept: no failed base rule, and no rejected host."""
    scored = checkpointed(figures(docs))
    hosts = host_rates(scored, times=times).select("host", "host_rejected", *(F.round(f"rate_{r}", 9).alias(f"rate_{r}") for r in RULES))
    met = scored.join(hosts, F.col("source").eqNullSafe(F.col("host")))
    kept = ~F.col("base_failed") & ~F.col("host_rejected")
    return met.withColumn("kept", kept).drop("host", "source", "fails")


def kept_documents(docs: DataFrame, times: float = TIMES) -> DataFrame:
    """The rows of ``docs`` that no base rule and no host verdict rejects; columns as they were.

    One pass over the texts writes the rows that no base rule rejects, and of others the host and what failed; then the
    hosts' rates are read from that table, and rejected hosts' rows are left out of it. No text is shuffled.
    """
    judged_rows = figures(docs.select("text", F.struct(*docs.columns).alias("__row")), keep=("__row",))
    good = F.when(~F.col("base_failed"), F.col("__row")).alias("row")
    table = kept_table(judged_rows.select(F.col("__row.source").alias("source"), "base_failed", "fails", good))
    hosts = host_rates(table, times=times).where("host_rejected").select(F.col("host").alias("rejected"))
    left = table.where(~F.col("base_failed")).join(sized(checkpointed(hosts)), F.col("source").eqNullSafe(F.col("rejected")), "left_anti")
    return left.select("row.*")
