"""N-gram Jaccard join: groups of documents whose shingle sets are near in Jaccard distance.

Jaccard distance is a metric, but documents that share no shingle are all at distance 1,
so regions around pivots alone would leave one region that holds nearly everything. The
space is therefore first cut into cells: a set's shingles are ordered, rare ones first,
and the set enters the cell of each shingle of its prefix, the part that any set near
enough must share. Cells that hold one set are dropped. Within the cells:

  pivots     each cell takes the members with the smallest seeded hashes as pivots, one in
             eight but eight at most; a member belongs to the Voronoi region of the
             nearest pivot, and members within the threshold of a pivot are linked
  windows    a pivot of the next round is replicated to every region of its cell, but
             meets there only the members whose distance to the region's pivot differs
             from its own by no more than the threshold (triangle inequality)
  recursion  regions whose cell is not one component yet take eight times as many pivots
             in each round, to the end where every member has been one

Every pair that the bounds on prefix, size, window and sketch (a bit vector whose distance
is never more than the number of elements in one set alone) do not exclude is either compared
exactly or already in one component, so the components are exact. Distances are computed
once for a pair. A set's copies are one class.

The frequency order only affects speed. It comes from counts of shingles repeated within
parts of the input; at most ``max_frequent`` of them are sent to the tasks.

Defined cases
  null or empty text, no words  the empty set: linked with nothing
  null id         counted, linked with nothing, component null
  repeated rows   one output row each, in one class; texts of one id share a component
  ties            smallest hash, then smallest id
  empty table     an empty result
  other columns   ignored
  long texts      whole
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.llm.graph import components
from pagelens.llm.scratch import Scratch
from pagelens.llm.textops import mix64, shingle_hashes, slices, word_hashes

#: Text held while repeated shingles are counted within a part of the input.
PART_BYTES = 32 << 20
#: A list of ids up to this long is sent to the tasks; a longer one is joined by shuffle.
SEND_IDS = 2_000_000
#: Pivots of a cell in the first round at most, and the members for each; rounds multiply pivots by the first number.
PIVOTS, MEMBERS = 8, 8
#: Pairs of one set that are joined under one key.
PAIRS_PER_KEY = 256
#: Shingles found in 2 to this power of sets are dealt by set as well as by shingle, to this many tasks.
HOT_LEVEL, HOT_PARTS = 14, 4096
#: Words of 64 bits in a set's sketch.
SKETCH = 16
SKETCH_COLUMNS = [f"s{i}" for i in range(SKETCH)]
#: Words of the wide sketch of sets with more elements than LONG, for which the narrow one says little.
WIDE, LONG = 256, 600
#: Wide sketches, of 2 KB each, that are sent to the tasks; more are joined by shuffle.
SEND_WIDE = 2000


def _sets(part: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row's text, ascending, and first indexes."""
    words, first = word_hashes(part.column(1))
    hashes, at = shingle_hashes(words, first, k)
    own = [np.unique(hashes[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return (np.concatenate(own) if own else hashes), np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)


def _repeated(rows: DataFrame, k: int, max_frequent: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the most frequent shingles, and a class of frequency from 1 up for each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def found() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["h", "n"])

        for batch in batches:
            for part in slices(batch, "t"):
                hashes, _ = _sets(part, k)
                held.append(hashes)
                size += 8 * len(hashes)
                if size >= PART_BYTES:
                    yield found()
                    held, size = [], 0
        if held:
            yield found()

    counts = rows.select("id", "t").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n >= 4")
    level = F.floor(F.log2("n")).cast("int")
    scratch = Scratch(rows.sparkSession, "frequent")
    counts = scratch.table(counts.select("h", level.alias("level")), "counts")
    total, least = 0, 64
    for row in sorted(counts.groupBy("level").count().collect(), key=lambda r: -r["level"]):  # one row for each power of two
        total += row["count"]
        if total > max_frequent:
            break
        least = row["level"]
    table = counts.where(F.col("level") >= least).toArrow()
    scratch.drop(counts)
    h = table.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], table.column("level").to_numpy()[order].astype(np.int8)


def _prefixes(rows: DataFrame, k: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(id, n, k1, k2, keys, sketch, wide): size, two fingerprints, the ordered prefix and the parity sketches of each row's set."""
    known, level = frequent

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                hashes, at = _sets(part, k)
                rank = np.zeros(len(hashes), dtype=np.int8)
                if len(known) and len(hashes):
                    where = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    same = known[where] == hashes
                    rank[same] = level[where[same]]
                n = np.diff(at)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]) for x in (mix64(hashes), mix64(hashes ^ np.uint64(0x5BD1E995)))]
                k1, k2 = (mix64(s[at[1:]] - s[at[:-1]] + n.astype(np.uint64)).view(np.int64) for s in sums)
                need = (percent * n + 99) // 100
                size = np.where(n > 0, n - need + 1, 0)
                keys = []
                for a, b, m in zip(at[:-1].tolist(), at[1:].tolist(), size.tolist(), strict=True):
                    own, r = hashes[a:b], rank[a:b]
                    plain = own[r == 0]  # ascending already
                    keys.append(plain[:m] if len(plain) >= m else own[np.argsort(r, kind="stable")][:m])
                flat = np.concatenate(keys) if keys else hashes
                # bit b of a sketch: whether an odd number of the set's shingles fall in class b
                place = np.repeat(np.arange(len(n)), n) * (64 * SKETCH) + (mix64(hashes) % np.uint64(64 * SKETCH)).astype(np.int64)
                bits = (np.bincount(place, minlength=len(n) * 64 * SKETCH) & 1).astype(np.uint8).reshape(len(n), -1)
                sketch = np.ascontiguousarray(np.packbits(bits, axis=1)).view(np.int64)
                wide = [np.packbits((np.bincount((mix64(hashes[a:b]) % np.uint64(64 * WIDE)).astype(np.int64), minlength=64 * WIDE) & 1).astype(np.uint8)).view(np.int64) if b - a > LONG else None for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat.view(np.int64)))
                words = [pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(SKETCH)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(k1), pa.array(k2), lists, *words, pa.array(wide, pa.list_(pa.int64()))], names=["id", "n", "k1", "k2", "keys", *SKETCH_COLUMNS, "wide"])

    return rows.select("id", "t").mapInArrow(work, "id long, n long, k1 long, k2 long, keys array<long>" + "".join(f", {c} long" for c in SKETCH_COLUMNS) + ", wide array<long>")


def _hash_sets(rows: DataFrame, k: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                hashes, at = _sets(part, k)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64)))], names=["id", "hashes"])

    return rows.select("id", "t").mapInArrow(work, "id long, hashes array<long>")


def _sent(ids: DataFrame) -> DataFrame:
    """A written list of ids, sent to the tasks if it is short."""
    return F.broadcast(ids) if ids.count() <= SEND_IDS else ids


def _not_alone(entries: DataFrame, hot: np.ndarray) -> DataFrame:
    """The rows whose key stands in another row too: after one shuffle, those with an equal neighbour in key order.

    All rows of hot keys, which many sets are known to hold, are kept without their neighbours being looked at.
    """
    session = entries.sparkSession
    known = session.createDataFrame(pa.table({"key": pa.array(hot.view(np.int64)), "hot": pa.array(np.ones(len(hot), bool))}))  # at most max_frequent
    dealt = entries.join(F.broadcast(known), "key", "left").select(*entries.columns, F.when(F.col("hot"), F.pmod(F.xxhash64(F.lit(17), "rep"), F.lit(HOT_PARTS)) + 1).otherwise(F.lit(0)).alias("part"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, False  # the row that waits for its successor; whether its predecessor was equal
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if last is None else [last, batch])
            keys = table.column(0).to_numpy()
            same = keys[1:] == keys[:-1]
            keep = np.r_[before, same]
            keep[:-1] |= same
            keep |= table.column("part").to_numpy() > 0
            yield from table.slice(0, len(keys) - 1).filter(pa.array(keep[:-1])).to_batches()
            last, before = table.slice(len(keys) - 1).combine_chunks().to_batches()[0], bool(keep[-1])
        if before:
            yield last

    return dealt.repartition("key", "part").sortWithinPartitions("key").mapInArrow(work, dealt.schema).drop("part")


def _may_link(n1: Column, p1: Column, n2: Column, p2: Column, percent: int) -> Column:
    """Bounds on two sets whose first common shingle has the places p1 and p2 in their orders.

    Sizes must be near, and the shingles before those places stand in one set alone. A pair
    need only pass in the cell of its first common shingle, which both prefixes hold.
    """
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & ((100 + percent) * (p1 + p2) <= (100 - percent) * (n1 + n2))


def _near_enough(x: str, y: str, percent: int) -> Column:
    """Whether two sketches allow their sets to link. Each differing bit stands for an element of one set alone.

    Ids with several texts have no sketch and pass.
    """
    differ = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in SKETCH_COLUMNS])
    return F.coalesce((100 + percent) * differ <= (100 - percent) * (F.col(f"{x}.n") + F.col(f"{y}.n")), F.lit(True))


def jaccard_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, max_frequent: int = 400_000, hot_level: int = HOT_LEVEL) -> DataFrame:
    """One row per document: its id, n_shingles and component_id.

    Two documents link when 100 * intersection >= percent * union of their sets of k-word shingles.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    frequent = _repeated(rows, k, max_frequent)
    prefixes = scratch.table(_prefixes(rows, k, percent, frequent), "prefixes")
    known = prefixes.where("id is not null and n > 0")
    classes = scratch.table(known.groupBy("k1", "k2").agg(F.min("id").alias("rep")), "classes")
    # an id that stands on rows of different texts is left out as a copy only where its text is one
    copies = scratch.table(known.select("k1", "k2", "id").join(classes, ["k1", "k2"]).where("id != rep").select("id", "k1", "k2").distinct(), "copies")
    reps = known.join(_sent(copies), ["id", "k1", "k2"], "left_anti")

    entries = reps.select(F.col("id").alias("rep"), "n", F.posexplode("keys").alias("pos", "key"))
    share = F.pmod(F.xxhash64(F.lit(11), "rep"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    cells = _not_alone(entries.select("key", "rep", F.shiftleft(F.col("n"), 32).bitwiseOR(F.col("pos").cast("long")).alias("place")), frequent[0][frequent[1] >= hot_level])
    cells = cells.groupBy("key", "rep").agg(F.min("place").alias("place"))
    cells = scratch.table(cells.select("key", "rep", F.shiftright("place", 32).alias("n"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).alias("pos"), share.alias("share")), "members")
    # the pivots of the first round
    sizes = cells.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("share", "rep")).alias("least")).where("m > 1")
    pivot = (F.struct("share", "rep") == F.col("least")) | (F.col("share") * F.col("m") < F.least(F.lit(PIVOTS), F.col("m") / MEMBERS))
    entries, cells = cells, scratch.table(cells.join(sizes, "key").withColumn("pivot", pivot).drop("least"), "cells")
    scratch.drop(entries)

    one = F.min("k1") == F.max("k1")
    by_id = scratch.table(known.groupBy("id").agg(F.first("n").alias("n"), *[F.when(one, F.first(c)).alias(c) for c in SKETCH_COLUMNS], F.when(one, F.first("wide")).alias("wide"), (~one).alias("several")), "ids")
    sketches, wides = by_id.drop("wide", "several"), by_id.select("id", "n", "wide").where("wide is not null")
    if wides.count() <= SEND_WIDE:
        wides = F.broadcast(wides)

    def possible(pairs: DataFrame) -> DataFrame:
        """The pairs without those of two long sets whose wide sketches forbid a link."""
        a, b = (wides.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("wide").alias(f"w{c}")) for c in "ab")
        differ = F.aggregate(F.zip_with("wa", "wb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        both = pairs.join(a, "a", "left").join(b, "b", "left")
        return both.where(F.coalesce((100 + percent) * differ <= (100 - percent) * (F.col("na") + F.col("nb")), F.lit(True))).select("a", "b")

    def compared(pairs: DataFrame) -> DataFrame:
        """(a, b, d, linked) of distinct pairs that may link. Only the texts in them are cut into shingles again."""
        pairs = written = scratch.table(possible(pairs), "pairs")
        if not written.limit(1).count():
            return written.select("a", "b", F.lit(None).cast("double").alias("d"), F.lit(False).alias("linked"))
        # a set with many pairs, such as a pivot, is joined under several keys
        ids = scratch.table(pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.ceil(F.count("*") / PAIRS_PER_KEY).cast("int").alias("keys")), "ids")
        sets = scratch.table(_hash_sets(rows.join(_sent(ids.select("id")), "id", "left_semi"), k), "sets")
        hot_sent = _sent(ids.where("keys > 1"))
        keys = F.coalesce(F.col("keys"), F.lit(1))
        spread = sets.join(hot_sent, "id", "left").select("id", "hashes", F.explode(F.sequence(F.lit(0), keys - 1)).alias("part"))
        a = spread.select(F.col("id").alias("a"), F.col("part").alias("pa"), F.col("hashes").alias("ha"))
        b = spread.select(F.col("id").alias("b"), F.col("part").alias("pb"), F.col("hashes").alias("hb"))
        for own, other, part in (("a", "b", "pa"), ("b", "a", "pb")):
            pairs = pairs.join(hot_sent.withColumnRenamed("id", own), own, "left").withColumn(part, F.pmod(F.xxhash64(F.lit(13), other), keys).cast("int")).drop("keys")
        both = pairs.join(a, ["a", "pa"]).join(b, ["b", "pb"]).select("a", "b", F.size(F.array_intersect("ha", "hb")).alias("i"), (F.size("ha") + F.size("hb")).alias("s"))
        distance, linked = 1 - F.col("i") / (F.col("s") - F.col("i")), 100 * F.col("i") >= percent * (F.col("s") - F.col("i"))
        # an id that several rows share gives several comparisons, and no distance that windows may use
        out = scratch.table(both.select("a", "b", distance.alias("d"), linked.alias("linked")).groupBy("a", "b").agg(F.when(F.count("*") == 1, F.min("d")).alias("d"), F.bool_or("linked").alias("linked")), "compared")
        scratch.drop(sets, ids, written)
        return out

    # the first round: a pivot leads the members with larger shares
    x, y = cells.where("pivot").alias("x"), cells.alias("y")
    star = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.struct("x.share", "x.rep") < F.struct("y.share", "y.rep")) & _may_link(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), percent))
    star = star.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct().alias("p")
    star = star.join(sketches.alias("x"), F.col("p.a") == F.col("x.id")).join(sketches.alias("y"), F.col("p.b") == F.col("y.id"))
    known_pairs = compared(star.where(_near_enough("x", "y", percent)).select("p.a", "p.b"))
    edges = known_pairs.where("linked").select("a", "b")
    several = by_id.where("several").select("id")
    if several.limit(1).count():
        edges = edges.unionByName(known.join(_sent(several), "id", "left_semi").join(classes, ["k1", "k2"]).select(F.col("id").alias("a"), F.col("rep").alias("b")))
    linked = components(edges, scratch)

    radius = 1 - percent / 100
    factor = PIVOTS
    members = cells.where("m > 2")
    while True:
        # cells that are not one component yet, each member in the region of its nearest pivot so far
        of = linked.select(F.col("node").alias("rep"), "component")
        labelled = scratch.table(members.join(of, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "labelled")
        mixed = labelled.groupBy("key").agg((F.min("component") != F.max("component")).alias("mixed"), F.bool_and("pivot").alias("all")).where("mixed and not all").select("key")
        ways = known_pairs.select("a", "b", "d").unionByName(known_pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
        left = scratch.table(labelled.join(mixed, "key").join(sketches.drop("n").withColumnRenamed("id", "rep"), "rep"), "open")
        scratch.drop(labelled)
        if not left.limit(1).count():
            break
        met = left.where("pivot").select("key", F.col("rep").alias("a")).join(ways, "a").select("key", "a", F.col("b").alias("rep"), "d")
        nearest = met.groupBy("key", "rep").agg(F.min(F.struct("d", "a")).alias("near"))
        regions = left.join(nearest, ["key", "rep"], "left").withColumn("region", F.when(F.col("pivot"), F.col("rep")).otherwise(F.col("near.a"))).withColumn("d", F.when(F.col("pivot"), F.lit(0.0)).otherwise(F.col("near.d"))).drop("near")
        regions = scratch.table(regions, "regions")
        factor *= PIVOTS
        chosen = ~F.col("pivot") & (F.col("share") * F.col("m") < factor)
        lead = regions.where(chosen)
        # replicas of the new pivots in all regions of their cells, with the distance to the region's pivot where it is known
        met = met.withColumnRenamed("rep", "to").withColumnsRenamed({"a": "region", "d": "window"})
        x, y = lead.alias("x"), regions.alias("y")
        other = (F.col("x.component") != F.col("y.component")) & (~(F.col("y.pivot") | (F.col("y.share") * F.col("y.m") < factor)) | (F.struct("x.share", "x.rep") < F.struct("y.share", "y.rep")))
        found = x.join(y, (F.col("x.key") == F.col("y.key")) & other & _may_link(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), percent) & _near_enough("x", "y", percent))
        found = found.select("x.key", F.col("x.rep").alias("to"), F.col("y.rep").alias("rep"), F.col("y.region").alias("region"), F.col("y.d").alias("d"))
        found = found.join(met, ["key", "region", "to"], "left").where(F.coalesce(F.abs(F.col("window") - F.col("d")) <= radius + 1e-9, F.lit(True)))
        pairs = found.select(F.least("to", "rep").alias("a"), F.greatest("to", "rep").alias("b")).distinct()
        new = compared(pairs.join(known_pairs, ["a", "b"], "left_anti"))
        known_pairs = known_pairs.unionByName(new)
        # each component so far as a star, and what this round has linked
        if new.where("linked").limit(1).count():
            linked = components(linked.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(new.where("linked").select("a", "b")), scratch)
        members = scratch.table(regions.drop("component", "region", "d", *SKETCH_COLUMNS).withColumn("pivot", F.col("pivot") | chosen), "members")
        scratch.drop(left, regions)

    of_class = classes.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    out = prefixes.select("id", "n", "k1", "k2").join(of_class, ["k1", "k2"], "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_per_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One document of each group, that with the smallest id. Rows without id stay; of rows with equal id and text, one stays."""
    scratch = Scratch(docs.sparkSession, "groups")
    groups = scratch.table(jaccard_groups(docs, id_col=id_col, text_col=text_col, **how).select(id_col, "component_id"), "groups")
    others = scratch.table(groups.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), "others")
    left = docs.join(_sent(others), id_col, "left_anti").select(*docs.columns)
    again = scratch.table(groups.groupBy(id_col).count().where("count > 1").where(F.col(id_col).isNotNull()).select(id_col), "again")
    if not again.limit(1).count():
        return left
    once = left.join(_sent(again), id_col, "left_anti").select(*docs.columns)
    return once.unionByName(left.join(_sent(again), id_col, "left_semi").select(*docs.columns).dropDuplicates([id_col, text_col]))
