"""MinHash near-duplicate detection with sequential Bayesian verification.

Documents with equal shingle sets are one class, found by a 128-bit print of the set; only one document of a class goes
on. Its signature is cut into bands; classes that share a band are candidates. Candidates are compared in cells of
bounded size and weight. First by signatures alone: a few hashes at a time, giving a pair up as soon as the posterior
probability that its similarity reaches the threshold is below ``miss``. Members left with a partner are survivors; only
their full sets are moved, and verify the pairs exactly.

A cell gives a spanning forest of its links, so a group of g copies yields at most g - 1 links for each cell it is in.
Groups too large for a cell come after all smaller ones, which join most of their members too. Where more than a cell of
members stays outside a group's largest component, the group is compared with a few of its members. What is not joined
then is compared with all of the group, block by block, if it fills few cells: that costs rows in proportion
to the group. Otherwise it is looked for by a second band: members of the group that share another band too are a smaller
group, compared in the same way, down to ``LEVELS`` bands; a linked pair shares no other band with probability 5e-6. Groups
that are large even then are compared block by block. Thus every candidate pair is either compared or known to be
connected, and no group's pairs are listed. There are as many bands as it takes to miss a pair at the threshold with
probability 3e-6.

Nulls: null and empty texts, and texts without words, have no shingles and no links. Rows with the same doc_id count as
one document. Rows without doc_id take part only through a class that also has a doc_id; otherwise their component is
null and they are kept. Texts of any length are shingled whole; long ones weigh as several in a cell. An empty table gives
an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.llm.chunks import slices, tidy
from halyard.llm.common import WORD, checkpointed, kept_table, rows_at_once, sized
from halyard.llm.components import components
from halyard.llm.shingles import Signer, set_print, shingle_set

BANDS, ROWS, HASHES, STEP = 40, 8, 128, 16  # 40 bands are those of a threshold of 0.85
ESCAPE = 3e-6
#: Rows of a cell, of ``ROW_BYTES`` of shingles each; members that a large group is compared with first; bands that divide it.
#: Groups with OUTSIDE cells of members outside their largest component or fewer are compared block by block at once.
CELL, ROW_BYTES, CENTERS, LEVELS, OUTSIDE = 256, 1 << 18, 4, 3, 4


def bands_for(percent: int) -> int:
    """The fewest bands that a pair at the threshold escapes with probability ``ESCAPE`` at most."""
    shared = (percent / 100) ** ROWS
    return math.ceil(math.log(ESCAPE) / math.log1p(-shared)) if shared < 1 else 1


def least_matches(percent: int, miss: float, hashes: int = HASHES, step: int = STEP) -> list[int]:
    """After each batch, the fewest equal hashes with which a pair stays: with a uniform prior on the similarity,
    P(similarity >= t | m of n equal) is the chance of at most m successes in n + 1 trials of probability t."""
    t, out = percent / 100, []
    for n in range(step, hashes + 1, step):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def signed(docs: DataFrame, k: int = 5, bands: int = BANDS) -> DataFrame:
    """Per row: doc_id, n (shingles), f1, f2 (the set's print), bands. One pass over the texts."""

    def sign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        signer = Signer(bands, ROWS, HASHES)
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                own = [shingle_set(text.encode(), k) for text in texts]
                f1, f2 = zip(*(set_print(x) if len(x) else (0, 0) for x in own), strict=True)
                keys = [signer.sign(x)[0] if len(x) else None for x in own]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array([len(x) for x in own], pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n", "f1", "f2", "bands"])
        tidy()

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n long, f1 long, f2 long, bands array<long>")


def sets_of(docs: DataFrame, k: int = 5) -> DataFrame:
    """Per row: rep, n (shingles), sig, shingles (both as bytes)."""

    def sets(batches: Iterator) -> Iterator:
        import pyarrow as pa

        signer = Signer(BANDS, ROWS, HASHES)
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                own = [shingle_set(text.encode(), k) for text in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array([len(x) for x in own], pa.int64()), pa.array([signer.sign(x)[1] for x in own], pa.binary()), pa.array([x.tobytes() for x in own], pa.binary())], ["rep", "n", "sig", "shingles"])
        tidy()

    return docs.select("doc_id", "text").mapInArrow(sets, "rep long, n long, sig binary, shingles binary")


def likely_pairs(rep: list[int], side: list[int], whole: bool, sigs: list[bytes], size: np.ndarray, percent: int, least: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a cell's rows that may reach the threshold, and how many hashes they share. A cell that is ``whole``
    compares all its rows, another one only rows of different sides."""
    reps, sides, hashes = np.array(rep), np.array(side), np.frombuffer(b"".join(sigs), "<u2").reshape(len(sigs), -1)
    i, j = np.triu_indices(len(sigs), 1)
    # A center is also a row of its group.
    fit = (np.minimum(size[i], size[j]) * 100 >= np.maximum(size[i], size[j]) * percent) & (reps[i] != reps[j])
    if not whole:
        fit &= sides[i] != sides[j]
    i, j = i[fit], j[fit]
    equal = np.zeros(len(i), np.int64)
    for at, fewest in zip(range(0, HASHES, STEP), least, strict=True):
        equal += (hashes[i, at : at + STEP] == hashes[j, at : at + STEP]).sum(axis=1)
        likely = equal >= fewest
        i, j, equal = i[likely], j[likely], equal[likely]
    return i, j, equal


def _by_cell(cells: DataFrame, columns: list[str], schema: str, result) -> DataFrame:
    """``result(rows)`` of the rows of each cell, in order of rep, as rows of ``schema``."""
    names = [c.split()[0] for c in schema.split(", ")]

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
        kinds = [types[c.split()[1]] for c in schema.split(", ")]
        cell, rows = None, []

        def out(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)], names)

        for batch in batches:
            found = []
            for key, *row in zip(*(batch.column(c) for c in ("cell", *columns)), strict=True):
                if (key := key.as_py()) != cell:
                    found += result(cell, rows) if len(rows) > 1 else []
                    cell, rows = key, []
                rows.append(tuple(x.as_py() for x in row))
            yield out(found)
        if len(rows) > 1:
            yield out(list(result(cell, rows)))
        tidy()

    parts = max(1, int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cells.select("cell", *columns).repartition(parts, "cell").sortWithinPartitions("cell", "rep")
    return dealt.mapInArrow(compare, schema)


def survivors(cells: DataFrame, percent: int, miss: float) -> DataFrame:
    """Of cells (cell, side, whole, rep, n, sig) the rows that have a likely partner: cell, side, whole, rep."""
    least = least_matches(percent, miss)

    def left(cell: int, rows: list[tuple]) -> Iterator[tuple]:
        i, j, _ = likely_pairs([r[2] for r in rows], [r[0] for r in rows], rows[0][1], [r[4] for r in rows], np.array([r[3] for r in rows]), percent, least)
        for k in np.union1d(i, j).tolist():
            yield cell, *rows[k][:3]

    return _by_cell(cells, ["side", "whole", "rep", "n", "sig"], "cell long, side int, whole boolean, rep long", left)


def cell_links(cells: DataFrame, percent: int, miss: float) -> DataFrame:
    """Links (a, b) of cells: rows cell, side, whole, rep, sig, shingles, at most a few hundred to a cell."""
    least = least_matches(percent, miss)

    def joined(cell: int, rows: list[tuple]) -> Iterator[tuple[int, int]]:
        sets = [np.frombuffer(r[4], np.uint64) for r in rows]
        i, j, equal = likely_pairs([r[2] for r in rows], [r[0] for r in rows], rows[0][1], [r[3] for r in rows], np.array([len(x) for x in sets]), percent, least)
        root = list(range(len(rows)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        order = np.argsort(-equal, kind="stable")
        for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
            if (p := find(x)) != (q := find(y)):
                common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
                    root[p] = q
                    yield rows[x][2], rows[y][2]

    return _by_cell(cells, ["side", "whole", "rep", "sig", "shingles"], "a long, b long", joined)


def memberships(reps: DataFrame) -> DataFrame:
    """``reps`` (rep, w, bands) to (key, at, rep, w, g): the groups of two and more at each place of the bands."""
    dealt = reps.select("rep", "w", F.posexplode("bands").alias("at", "key"))
    multiple = checkpointed(dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("k")))
    return grouped(checkpointed(dealt.join(sized(multiple), F.col("key") == F.col("k"), "left_semi").distinct()))


def grouped(members: DataFrame) -> DataFrame:
    """``members`` (key, at, rep, w) of groups of two and more, with their weight g; each set of members once, at its first place."""
    groups = members.groupBy("key", "at").agg(F.count("*").alias("n"), F.ceil(F.sum("w")).alias("g"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("h"), F.min("rep").alias("r"))
    once = groups.where("n > 1").groupBy("n", "h", "r").agg(F.min(F.struct("at", "key")).alias("first"), F.max("g").alias("g"))
    once = checkpointed(once.select(F.col("first.key").alias("k"), "g"))
    return checkpointed(members.join(sized(once), F.col("key") == F.col("k")).select("key", "at", "rep", "w", "g"))


def _number(*parts) -> Column:
    return F.xxhash64(*parts)


def small_cells(members: DataFrame) -> DataFrame:
    """A cell for each group that fits into one."""
    own = members.where(F.col("g") <= CELL)
    return own.select(F.col("key").alias("cell"), F.lit(0).alias("side"), F.lit(True).alias("whole"), "rep")


def star_cells(members: DataFrame) -> DataFrame:
    """Large groups against a few of their members: blocks of the group, with these members added to each."""
    large = members.where(F.col("g") > CELL)
    blocks = F.ceil(F.col("g") / CELL).cast("long")
    block = large.select("key", "rep", F.lit(1).alias("side"), F.pmod(F.xxhash64("rep", "key"), blocks).alias("b"))
    drawn = [large.groupBy("key", "g").agg(F.min_by("rep", F.xxhash64("rep", F.lit(k))).alias("rep")) for k in range(CENTERS)]
    center = drawn[0]
    for other in drawn[1:]:
        center = center.unionByName(other)
    spread = center.distinct().select("key", "rep", F.lit(0).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("b"))
    return block.unionByName(spread).select(_number("key", "b", F.lit("star")).alias("cell"), "side", F.lit(False).alias("whole"), "rep")


def unjoined(large: DataFrame, parts: DataFrame) -> DataFrame:
    """Of large groups (key, at, rep, w, g) that ``parts`` (node, component) leaves apart: key, at, rep, w, g, main (whether the row
    is in the group's heaviest component), comp, bv and bu, the cells that those inside and outside of it fill."""
    met = large.join(parts, F.col("rep") == F.col("node"), "left")
    met = checkpointed(met.select("key", "at", "rep", "w", "g", F.coalesce("component", "rep").alias("comp")))
    sizes = met.groupBy("key", "comp").agg(F.sum("w").alias("n"))
    main = sizes.groupBy(F.col("key").alias("k")).agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("nv"), F.sum("n").alias("all"), F.count("*").alias("comps"))
    cells = lambda n: F.greatest(F.ceil(n / CELL), F.lit(1)).cast("long")
    main = main.where("comps > 1").select("k", "main", cells(F.col("nv")).alias("bv"), cells(F.col("all") - F.col("nv")).alias("bu"))
    return checkpointed(met.join(sized(checkpointed(main)), F.col("key") == F.col("k")).select("key", "at", "rep", "w", "g", "comp", (F.col("comp") == F.col("main")).alias("main"), "bv", "bu"))


def divided(apart: DataFrame, reps: DataFrame) -> DataFrame:
    """Groups of ``unjoined`` divided by a band at a later place: (key, at, rep, w, g) of those that join members from outside
    the main component with any others. Rows grow with the groups' members and the places of the bands."""
    bands = reps.select(F.col("rep").alias("r"), "bands")
    met = apart.join(bands, F.col("rep") == F.col("r")).select("key", "at", "rep", "w", "comp", "main", F.posexplode("bands").alias("then", "band"))
    dealt = met.where("then > at").select(_number("key", "band").alias("key"), F.col("then").alias("at"), "rep", "w", "comp", "main")
    outside = checkpointed(dealt.where("not main"))
    wanted = checkpointed(outside.select(F.col("key").alias("k")).distinct())
    inside = dealt.where("main").join(sized(wanted), F.col("key") == F.col("k"), "left_semi")
    members = checkpointed(outside.unionByName(inside))
    mixed = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select(F.col("key").alias("k"))
    return grouped(members.join(sized(checkpointed(mixed)), F.col("key") == F.col("k"), "left_semi").select("key", "at", "rep", "w"))


def merged(apart: DataFrame) -> DataFrame:
    """``apart``, groups of ``unjoined``, with those of the same main component as one group where its cells have fewer rows
    than theirs: it is then moved once, not for each band."""
    core = apart.groupBy("key").agg(F.max(F.when(F.col("main"), F.col("comp"))).alias("core")).select(F.col("key").alias("k"), "core")
    core = checkpointed(core)
    met = apart.join(sized(core), F.col("key") == F.col("k"))
    cost = F.when(F.col("main"), F.col("bu")).otherwise(F.col("bv") + F.col("bu"))
    rows = checkpointed(met.groupBy("core", "rep", "main").agg(F.max("w").alias("w"), F.sum(cost).alias("cost")))
    weight = lambda side: F.greatest(F.ceil(F.sum(F.when(side, F.col("w"))) / CELL), F.lit(1)).cast("long")
    sizes = rows.groupBy(F.col("core").alias("c")).agg(weight(F.col("main")).alias("bv"), weight(~F.col("main")).alias("bu"), F.count_if("main").alias("nv"), F.count_if(~F.col("main")).alias("nu"), F.sum("cost").alias("cost"))
    fewer = F.col("nv") * F.col("bu") + F.col("nu") * (F.col("bv") + F.col("bu")) < F.col("cost")
    fits = checkpointed(sizes.where(fewer).select("c", "bv", "bu"))
    whole = rows.join(sized(fits), F.col("core") == F.col("c")).select(F.col("core").alias("key"), "rep", "main", "bv", "bu")
    done = checkpointed(core.join(sized(fits), F.col("core") == F.col("c"), "left_semi").select("k"))
    rest = apart.join(sized(done), F.col("key") == F.col("k"), "left_anti").select("key", "rep", "main", "bv", "bu")
    return checkpointed(whole.unionByName(rest))


def block_cells(apart: DataFrame) -> DataFrame:
    """Groups of ``unjoined``: members outside the main component against all of the group, by blocks."""
    zero = F.lit(0).cast("long")
    own = apart.where("not main").withColumn("b", F.pmod(F.xxhash64("rep", "key"), F.col("bu")))
    theirs = apart.where("main").withColumn("b", F.pmod(F.xxhash64("rep", "key"), F.col("bv")))
    shape = lambda df, name, i, j, side, whole: df.select(_number("key", F.lit(name), i, j).alias("cell"), side.alias("side"), whole.alias("whole"), "rep")
    each = lambda n: F.explode(F.sequence(zero, F.col(n) - 1)).alias("o")
    columns = ["key", "rep", "b", "bu", "bv"]
    a = own.select(*columns, each("bv"))
    b = theirs.select(*columns, each("bu"))
    c = own.select(*columns, each("bu"))
    one, none = F.lit(1), F.lit(0)
    low, high = F.least("b", "o"), F.greatest("b", "o")
    return (
        shape(a, "across", F.col("b"), F.col("o"), one, F.lit(False))
        .unionByName(shape(b, "across", F.col("o"), F.col("b"), none, F.lit(False)))
        .unionByName(shape(c, "outside", low, high, F.when(F.col("b") == low, none).otherwise(one), low == high))
    )


def group_links(members: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, miss: float) -> DataFrame:
    """Links (a, b) among the members (key, at, rep, w, g) of groups. ``reps`` has (rep, bands), ``sets`` (rep, n, sig, shingles)."""

    def found(cells: DataFrame) -> DataFrame:
        def beside(what: DataFrame, rows: DataFrame) -> DataFrame:
            return what.withColumnRenamed("rep", "s").join(sized(rows), F.col("rep") == F.col("s")).drop("s")

        left = checkpointed(survivors(beside(sets.select("rep", "n", "sig"), checkpointed(cells)), percent, miss))
        return checkpointed(cell_links(beside(sets.select("rep", "sig", "shingles"), left), percent, miss))

    links = found(small_cells(members))
    for level in range(LEVELS):
        large = members.where(F.col("g") > CELL)
        if not large.limit(1).count():
            break
        apart = unjoined(large, components(links))
        many = checkpointed(apart.where("bu > 1").select("key", "at", "rep", "w", "g"))
        if many.limit(1).count():
            links = links.unionByName(found(star_cells(many)))
            apart = apart.where("bu = 1").unionByName(unjoined(many, components(links)))
        few = apart if level == LEVELS - 1 else apart.where(F.col("bu") <= OUTSIDE)
        if few.limit(1).count():
            links = links.unionByName(found(block_cells(merged(few))))
        apart = apart.where(F.col("bu") > OUTSIDE)
        if level == LEVELS - 1 or not apart.limit(1).count():
            break
        members = divided(apart, reps)
        links = links.unionByName(found(small_cells(members)))
    return links


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = 5, miss: float = 1e-9) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept."""
    with rows_at_once(docs.sparkSession):
        signs = kept_table(signed(docs, k, bands_for(percent)))
    some = signs.where("n > 0")
    classes = checkpointed(some.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep")))
    firsts = classes.where("rep is not null").select(F.col("rep").alias("r"))
    weight = F.greatest(F.lit(1.0), F.col("n") * F.lit(8.0 / ROW_BYTES)).alias("w")
    reps = some.join(sized(firsts), F.col("doc_id") == F.col("r"), "left_semi").select(F.col("doc_id").alias("rep"), weight, "bands")
    members = memberships(reps)
    active = checkpointed(members.select(F.col("rep").alias("r")).distinct())
    named = docs.select("doc_id", "text").where("doc_id is not null").join(sized(active), F.col("doc_id") == F.col("r"), "left_semi")
    with rows_at_once(docs.sparkSession):
        sets = kept_table(sets_of(named, k))
    links = group_links(members, reps, sets, percent, miss)
    found = checkpointed(components(links))
    placed = classes.join(found, F.col("rep") == F.col("node"), "left").select(F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.coalesce("component", "rep").alias("component_id"))
    linked = some.select("doc_id", "n", "f1", "f2").join(placed, (F.col("f1") == F.col("p1")) & (F.col("f2") == F.col("p2")))
    out = linked.select("doc_id", "n", "component_id").unionByName(signs.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    kept = F.col("component_id").isNull() | F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` with a key __key that follows from doc_id and text alone, so that it is the same whenever it is computed
    again, and (key, id) of its rows. Of rows with words that agree in doc_id and text one is left, so that their keys
    are unique; keys that two such pairs share are drawn again."""
    words = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    for salt in range(20):
        key, other = (F.xxhash64(F.lit(salt), F.lit(k), F.col("doc_id").isNull(), "doc_id", "text") for k in (0, 1))
        rows = docs.where(words).select(key.alias("key"), F.col("doc_id").alias("id"), other.alias("other"))
        met = checkpointed(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("other").alias("low"), F.max("other").alias("high"), F.min("id").alias("id")))
        if not met.where("low <> high").limit(1).count():
            break
    else:
        raise ValueError("no keys without collisions")
    keyed = docs.withColumn("__key", F.when(words, key))
    again = checkpointed(met.where("n > 1").select(F.col("key").alias("__again")))
    if again.limit(1).count():
        is_again = F.col("__key") == F.col("__again")
        repeats = keyed.join(sized(again), is_again, "left_semi").dropDuplicates(["__key"])
        keyed = keyed.join(sized(again), is_again, "left_anti").unionByName(repeats)
    return keyed, met.select("key", "id")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each component of rows, told apart by doc_id and text, the one with the smallest
    doc_id, and all rows without words. Repeated and missing doc_ids link nothing and keep no copy. Columns as they were;
    no text is shuffled unless rows repeat or more rows go than a broadcast may hold."""
    keyed, ids = _keyed(docs)
    found = near_duplicates(keyed.where("__key is not null").select(F.col("__key").alias("doc_id"), "text"), **options)
    others = checkpointed(found.where("not kept").select(F.col("doc_id").alias("member"), "component_id"))
    members = checkpointed(others.unionByName(others.select(F.col("component_id").alias("member"), "component_id").distinct()))
    named = ids.join(sized(members), F.col("key") == F.col("member"))
    first = named.groupBy("component_id").agg(F.min_by("key", F.struct(F.col("id").isNull(), "id", "key")).alias("first"))
    gone = checkpointed(members.join(sized(checkpointed(first)), F.col("member") == F.col("first"), "left_anti").select(F.col("member").alias("__gone")))
    return keyed.join(sized(gone), F.col("__key") == F.col("__gone"), "left_anti").drop("__key")
