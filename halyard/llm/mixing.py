"""Mixing sources to target weights by pivotal dependent rounding (DataFrame operations only).

Each source gets a target number of words. A document's ideal number of copies is target / source size: its whole
part is certain, its fraction is a probability. Fractions are rounded in pairs: mass in words moves from one document
of a pair to the other, at random in the proportion that keeps every expectation, until one of them is integral; the
other goes on as the residual. So a source's taken words stay the same at every step. Documents are paired in buckets
of bounded size; the residuals of the buckets meet in buckets of the next level, until each source has one, which is
rounded alone: the taken words miss the target by less than one document's size.

Nulls: a null text has no words, a null source is a source of its own, a null doc_id is a value like others. Rows with
the same doc_id, source and size are told apart by a running number only, as nothing else differs. Rows without
words take nothing. Texts of any length are counted whole; one longer than a source's target can be all that is taken of
it, or nothing. Other columns pass through ``mixed_documents`` as they are, whatever their names. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.common import WORD, checkpointed, same, uniform, union_all, whole_text
from halyard.operators.sorting import number_records

UNIT = "struct<ord:bigint,doc_id:bigint,idx:bigint,size:bigint,base:bigint,p:double,u:double>"


def word_count(text: str = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def shares(sources: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """``sources`` (source, source_size) with each one's target: all words shared by weight, none above ``most`` times.

    Weights follow the order of the names, repeating. Each round caps the sources that would be above and shares what
    is left among the others by weight; a round is one small aggregate.
    """
    sources = number_records(sources, F.col("source").asc_nulls_last(), name="source_no")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    sources = checkpointed(sources.withColumn("weight", weight).withColumn("most", F.lit(float(most)) * F.col("source_size")))
    per_weight = F.col("most") / F.col("weight")
    level, capped = None, -1
    while True:
        above = F.lit(False) if level is None else (per_weight <= F.lit(level))
        row = sources.agg(
            F.sum(F.col("source_size").cast("double")).alias("total"),
            F.sum(F.when(above, F.col("most")).otherwise(0.0)).alias("held"),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.sum(above.cast("long")).alias("n"),
        ).first()
        if not row["total"] or not row["open"] or row["n"] == capped:
            break
        capped = row["n"]
        level = (row["total"] - row["held"]) / row["open"]
    shared = F.col("most") if level is None else F.least(F.col("most"), F.lit(level) * F.col("weight"))
    return sources.withColumn("target", shared)


def _rounded(bucket: Column) -> Column:
    """Of a bucket's documents: ``done`` with p 0 or 1, and ``cur``, the residual."""

    def step(acc: Column, x: Column) -> Column:
        cur = acc["cur"]
        a, p, b, q = cur["size"].cast("double"), cur["p"], x["size"].cast("double"), x["p"]
        up, down = F.least(a * (1 - p), b * q), F.least(a * p, b * (1 - q))
        raised = F.when(up + down > 0, x["u"] * (up + down) < down).otherwise(p >= 0.5)
        ends = F.when(raised, a * (1 - p) <= b * q).otherwise(a * p <= b * (1 - q))  # whether cur becomes integral
        at = lambda s, v: s.withField("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))
        moved = F.when(raised, F.when(ends, q - a * (1 - p) / b).otherwise(p + b * q / a)).otherwise(
            F.when(ends, q + a * p / b).otherwise(p - b * (1 - q) / a)
        )
        out = F.when(ends, at(cur, raised.cast("double"))).otherwise(at(x, (~raised).cast("double")))
        rest = F.when(ends, at(x, moved)).otherwise(at(cur, moved))
        first = cur.isNull()
        return F.struct(
            F.when(first, x).otherwise(rest).cast(UNIT).alias("cur"),
            F.when(first, acc["done"]).otherwise(F.array_append(acc["done"], out.cast(UNIT))).alias("done"),
        )

    zero = F.struct(F.lit(None).cast(UNIT).alias("cur"), F.array().cast(f"array<{UNIT}>").alias("done"))
    return F.aggregate(bucket, zero, step)


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0, seed: int = 20_240_601, bucket: int = 64
) -> DataFrame:
    """Per row of ``docs`` (doc_id, source, size): source_size, target, copies and taken = copies * size.

    Repeatable: it follows from the rows and ``seed``, not from how rows are partitioned. Buckets hold about ``bucket``
    documents, so no task gathers a source; a source with a third of all rows just has more buckets.
    """
    units = checkpointed(docs.select("doc_id", "source", "size").groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")))
    totals = units.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("rows")
    )
    sources = checkpointed(shares(totals, weights, most))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    ratio = F.when(F.col("target") >= F.col("most"), F.lit(float(most))).otherwise(ratio)
    known = sources.select(F.col("source").alias("s"), "source_no", "source_size", "target", "rows", ratio.alias("ratio"))
    idx = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("idx")
    rows = units.join(known, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "source_no", "ratio", "rows", idx)
    base = F.floor("ratio").cast("long")
    unit = F.struct(
        F.xxhash64(F.lit(seed), "doc_id", "idx").alias("ord"), F.col("doc_id").cast("long").alias("doc_id"), "idx", "size",
        base.alias("base"), (F.col("ratio") - F.floor("ratio")).cast("double").alias("p"),
        uniform(seed + 1, F.col("doc_id"), F.col("idx"), F.col("source")).alias("u"),
    )
    rows = rows.select("source_no", "rows", unit.cast(UNIT).alias("x"))
    certain = (F.col("x.size") <= 0) | (F.col("x.p") <= 0)
    decided = [rows.where(certain).select("source_no", F.col("x").withField("p", F.lit(0.0)).alias("x"))]
    buckets = F.ceil(F.col("rows") / F.lit(bucket)).cast("long")
    level = rows.where(~certain).withColumn("bucket", F.pmod(F.col("x.ord"), F.greatest(buckets, F.lit(1).cast("long"))))
    left = -(-(sources.agg(F.max("rows")).first()[0] or 0) // bucket)
    while left:
        folded = level.groupBy("source_no", "bucket").agg(_rounded(F.sort_array(F.collect_list("x"))).alias("f"))
        folded = checkpointed(folded)
        decided.append(folded.select("source_no", F.explode("f.done").alias("x")))
        level = folded.select("source_no", F.col("f.cur").alias("x"), F.floor(F.col("bucket") / bucket).cast("long").alias("bucket"))
        left = 0 if left == 1 else -(-left // bucket)
    if len(decided) > 1:
        last = (uniform(seed + 2, F.col("x.doc_id"), F.col("x.idx")) < F.col("x.p")).cast("double")
        decided.append(level.select("source_no", F.col("x").withField("p", last).alias("x")))
    out = union_all(decided).join(known.select("source_no", F.col("s").alias("source"), "source_size", "target"), "source_no")
    copies = F.col("x.base") + F.col("x.p").cast("long")
    return out.select(
        "x.doc_id", "source", "x.idx", "x.size", "source_size", "target", copies.alias("copies"), (copies * F.col("x.size")).alias("taken")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; columns as they were.

    Rows that share doc_id, source and size are numbered by their text's hash; others need no window.
    """
    keys = ["doc_id", "source", "size"]
    rows = docs.select("doc_id", "source", word_count().alias("size"), F.struct(*docs.columns).alias("row"))
    plan = checkpointed(mix(rows.select(*keys), **options).select(*keys, "idx", "copies"))
    multiple = checkpointed(plan.where("idx > 0").select(*keys).distinct())
    once = plan.join(multiple, same(plan, multiple, keys), "left_anti").drop("idx")
    out = _repeated(rows, once, keys)
    if multiple.limit(1).count():
        order = Window.partitionBy(*keys).orderBy(F.xxhash64(whole_text("row.text")))
        twins = rows.join(multiple, same(rows, multiple, keys), "left_semi").withColumn("idx", (F.row_number().over(order) - 1).cast("long"))
        out = out.unionByName(_repeated(twins, plan, [*keys, "idx"]))
    return out


def _repeated(rows: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    plan = plan.where("copies > 0").select(*(F.col(k).alias(f"{k}_") for k in keys), "copies")
    met = rows.join(plan, [rows[k].eqNullSafe(plan[f"{k}_"]) for k in keys])
    return met.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("time")).select("row.*")
