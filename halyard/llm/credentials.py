"""Secret scans with multipart credential linking (DataFrame operations only).

Base kinds are reported wherever they match. Weak parts - short access identifiers, short or bare secrets, endpoints -
are common in clean text and are reported only when the parts that complete a credential lie within ``scope`` code
points of them: an access identifier needs a secret, a secret needs an access identifier, an endpoint needs both.

Parts of a text meet in an interval join on (text, bucket of ``scope`` code points). The side that is looked up is
reduced to one row for each bucket and role first, so no bucket yields pairs. Only texts with weak parts take part.

Nulls: a null text is empty, doc_id may be null. Rows with the same doc_id and text get the same spans. Texts of any length
are scanned whole. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import checkpointed, whole_text

#: Kinds in the order that breaks ties of start; pattern, group whose length counts, least length.
KEYWORDS = r"password|passwd|secret|token|api_?key"
ASSIGN = rf"(?i:({KEYWORDS}))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
BASE = (("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]{24,}", 0, 24))
#: Weak kinds: what they match and the roles a reported one needs nearby.
WEAK = (
    ("weak_access", r"(?:AKIA|ASIA)[A-Z0-9]{6,15}(?![A-Z0-9])|ASIA[A-Z0-9]{16,}", "access"),
    ("weak_secret", r"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]{0,39}[0-9])(?=[A-Za-z0-9+/]{0,39}[A-Z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])|(?<![0-9A-Za-z])(?=[0-9a-f]{0,22}[0-9])(?=[0-9a-f]{0,22}[a-f])[0-9a-f]{16,23}(?![0-9A-Za-z])", "secret"),
    ("endpoint", r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._/-]*)?", "endpoint"),
)
ROLE = {"assign": "secret", "access": "access", "hex": "secret"} | {k: r for k, _, r in WEAK}
KINDS = [k for k, *_ in BASE] + [k for k, *_ in WEAK]
SPAN = "struct<start:int,kind:int,end:int>"


def matches(text: Column, kind: str, pattern: str, group: int = 0, least: int = 1) -> Column:
    """Spans of the leftmost non-overlapping matches whose group has ``least`` code points.

    A text is its pieces between matches and the matches in turn; their lengths add up to the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = lambda x: F.transform(x, F.length)
    gaps, counted = lengths(F.split(text, pattern, -1)), lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    both = F.zip_with(lengths(found), counted, lambda m, n: F.struct(m.alias("m"), n.alias("n")))
    steps = F.zip_with(gaps, both, lambda gap, x: F.struct(gap.alias("gap"), x["m"].alias("m"), x["n"].alias("n")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (start + x["m"]).alias("end"))
        kept = F.when(x["n"] >= least, F.array_append(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct(F.coalesce(start + x["m"], start).alias("at"), kept.alias("spans"))

    return F.aggregate(steps, zero, step, lambda acc: acc["spans"])


def _guarded(text: Column, could: Column, kind: str, pattern: str, group: int = 0, least: int = 1) -> Column:
    return F.when(could, matches(text, kind, pattern, group, least)).otherwise(F.array().cast(f"array<{SPAN}>"))


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, a hash of the text, its base spans and its weak spans that overlap no base span."""
    text = whole_text()
    has = lambda x: F.contains(text, F.lit(x))
    could = {
        "assign": (has(":") | has("=")) & text.rlike(f"(?i){KEYWORDS}"),
        "access": has("AKIA"),
        "hex": text.rlike(r"[0-9a-f]{24}"),
        "weak_access": has("AKIA") | has("ASIA"),
        "weak_secret": text.rlike(r"[0-9a-f]{16}|[A-Za-z0-9+/]{40}"),
        "endpoint": has("://"),
    }
    base = [_guarded(text, could[k], k, p, g, n) for k, p, g, n in BASE]
    weak = [_guarded(text, could[k], k, p) for k, p, _ in WEAK]
    found = docs.select("doc_id", F.xxhash64(text, F.length(text)).alias("text_hash"), F.concat(*base).alias("base"), F.concat(*weak).alias("weak"))
    apart = lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))
    return found.withColumn("base", F.array_sort("base")).withColumn("weak", F.when(F.size("weak") > 0, F.filter("weak", apart)).otherwise(F.col("weak")))


def linked(found: DataFrame, scope: int = 300) -> DataFrame:
    """Weak spans of ``scan``'s rows that complete a credential: doc_id, text_hash, extra (sorted spans)."""
    key = ["doc_id", "text_hash"]
    some = found.where(F.size("weak") > 0).dropDuplicates(key)
    names = F.array(*(F.lit(k) for k in KINDS))
    roles = F.create_map(*(F.lit(x) for k in KINDS for x in (k, ROLE[k])))
    part = some.select(*key, F.explode(F.concat("base", "weak")).alias("s")).select(*key, "s.*")
    part = part.withColumn("role", roles[names[F.col("kind")]])
    first, last = F.floor(F.col("start") / scope), F.floor((F.col("end") - 1) / scope)
    covered = part.where("role <> 'endpoint'").withColumn("bucket", F.explode(F.sequence(first, last)))
    edge = F.col("bucket") * scope
    near = covered.groupBy(*key, "bucket", "role").agg(F.min(F.greatest("start", edge)).alias("lo"), F.max(F.least("end", edge + scope)).alias("hi"))
    near = near.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "bucket", F.col("role").alias("near"), "lo", "hi")
    weak = some.select(*key, F.explode("weak").alias("s")).select(*key, "s.*").withColumn("role", roles[names[F.col("kind")]])
    reach = F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))
    asked = weak.withColumn("bucket", F.explode(reach))
    met = asked.join(
        near,
        asked["doc_id"].eqNullSafe(near["d"]) & (asked["text_hash"] == near["h"]) & (asked["bucket"] == near["bucket"])
        & (asked["role"] != near["near"]) & (near["hi"] + scope >= asked["start"]) & (near["lo"] <= asked["end"] + scope),
    )
    sides = met.groupBy(*key, "start", "kind", "end", "role").agg(F.max(F.col("near") == "access").alias("a"), F.max(F.col("near") == "secret").alias("s"))
    whole = sides.where((F.col("role") != "endpoint") | (F.col("a") & F.col("s")))
    return whole.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end").cast(SPAN))).alias("extra"))


def listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def scanned(docs: DataFrame, scope: int = 300) -> DataFrame:
    """Per row: counts of the base kinds, a digest of the base spans, and all spans, base and linked."""
    found = checkpointed(scan(docs))
    extra = linked(found, scope).withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
    met = found.join(extra, found["doc_id"].eqNullSafe(extra["d"]) & (found["text_hash"] == extra["h"]), "left")
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(KINDS.index(name)).alias(f"n_{name}") for name, *_ in BASE]
    spans = F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "extra")))
    return met.select(
        "doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(spans).alias("spans"),
        F.when(F.col("extra").isNull(), 0).otherwise(F.size("extra")).cast("long").alias("n_linked"),
    )
