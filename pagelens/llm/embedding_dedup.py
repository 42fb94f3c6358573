"""Near-duplicate vectors by lattice hashing.

Method: in each of several tables, a random projection takes the unit vector to eight
dimensions, where it is decoded to the nearest point of the E8 lattice: its home cell.
A vector also probes the nearest of the 240 neighbouring cells. A pair meets in a table
if one's home is among the other's cells, and cosine is then computed in double
precision. Of all the cells where a pair meets, the first in a fixed order counts it, so
links are counted where they are found and pairs never leave their task.

A vector's copies are one class with a multiplicity. Cells where no two classes meet are
dropped before any vector is moved. A cell of many classes is split into square blocks
that are compared in different tasks.

Recall depends on ``tables`` and ``probes``; the tests measure it against brute force.

Defined cases
  null vector or label, zero vector, null or non-finite components  no links, own component
  null id         no links; component null, kept false
  other lengths   vectors are only compared with those of their length
  repeated rows   count as vectors of their own, linked to their copies
  ties            the smaller id
  empty table     an empty result
  other columns   ignored
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.graph import components
from pagelens.llm.scratch import Scratch

#: Classes on either side of a block.
BLOCK = 1024


@lru_cache(1)
def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: (+-1, +-1, 0^6) in any places, (+-1/2)^8 with an even number of minus signs."""
    whole = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            whole.append(v)
    half = [np.array(s) / 2 for s in product((1.0, -1.0), repeat=8) if np.prod(s) > 0]
    return np.array(whole + half)


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest point with whole coordinates of even sum."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=1) % 2)
    if len(odd):
        gap = x[odd] - r[odd]
        at = np.abs(gap).argmax(axis=1)
        r[odd, at] += np.where(gap[np.arange(len(odd)), at] >= 0, 1.0, -1.0)
    return r


def decode_e8(x: np.ndarray) -> np.ndarray:
    """The nearest lattice point: of the even whole points and of those shifted by a half."""
    a, b = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


@lru_cache(8)
def _projection(table: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64([table, size, 8]))
    q, _ = np.linalg.qr(rng.normal(size=(max(size, 8), 8)))
    return q[:size], rng.random(8)


def cells(unit: np.ndarray, tables: int, probes: int, scale: float) -> np.ndarray:
    """Keys of the cells of each unit vector: n x tables x (1 + probes), the home first."""
    n, size = unit.shape
    codes = (2 * np.arange(8, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    out = np.empty((n, tables, 1 + probes), dtype=np.int64)
    for t in range(tables):
        basis, shift = _projection(t, size)
        x = unit @ basis * (scale * np.sqrt(size / 8)) + shift
        home = decode_e8(x)
        order = np.argsort(-((x - home) @ _roots().T), axis=1, kind="stable")[:, :probes]
        points = np.concatenate([home[:, None, :], home[:, None, :] + _roots()[order]], axis=1)
        key = np.rint(2 * points).astype(np.int64).astype(np.uint64)
        h = np.full(key.shape[:2], t + 1, dtype=np.uint64)
        for i in range(8):
            h = (h ^ (key[:, :, i] * codes[i])) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        out[:, t, :] = h.view(np.int64)
    return out


def _first_meeting(a: np.ndarray, b: np.ndarray, t: int) -> np.ndarray:
    """For pairs that meet in table t: whether it is in none before. a, b: their cells."""
    ok = np.ones(len(a), dtype=bool)
    for s in range(t):
        ok &= ~((a[:, s, :] == b[:, s, :1]).any(axis=1) | (b[:, s, :] == a[:, s, :1]).any(axis=1))
    return ok


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, tables: int = 10, probes: int = 6, scale: float = 1.2) -> DataFrame:
    """One row per vector: its id, n_links, component_id and kept."""
    scratch = Scratch(vectors.sparkSession, "embedding")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v"), F.col(label_col).cast("string").alias("label"))
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    # class: equal label and vector, known by two hashes
    key = [F.xxhash64("label", "v").alias("k1"), F.xxhash64(F.lit(9), "v", "label").alias("k2")]
    keyed = scratch.table(rows.select("id", "fine", *key, F.when(F.col("fine"), F.col("v")).alias("v"), F.xxhash64("label", F.size("v")).alias("part")), "rows")
    classes = keyed.where("fine").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    reps = scratch.table(
        keyed.where("fine").select("k1", "k2", "id", "v", "part")
        .join(classes, ["k1", "k2"]).where("id = rep")
        .groupBy("rep").agg(F.first("copies").alias("copies"), F.first("v").alias("v"), F.first("part").alias("part")), "classes",
    )

    def unit(v: pd.Series) -> np.ndarray:
        x = np.stack(v.to_numpy()).astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))

    def keys(batches):
        for pdf in batches:
            for _, same in pdf.groupby(pdf["v"].map(len)):
                c = cells(unit(same["v"]), tables, probes, scale)
                n = c[0].size
                yield pd.DataFrame({"rep": np.repeat(same["rep"].to_numpy(), n), "part": np.repeat(same["part"].to_numpy(), n), "cell": c.ravel(), "tab": np.tile(np.repeat(np.arange(tables, dtype=np.int32), 1 + probes), len(same)), "home": np.tile(np.arange(1 + probes) == 0, len(same) * tables)})

    cell_rows = scratch.table(reps.select("rep", "part", "v").mapInPandas(keys, "rep long, part long, cell long, tab int, home boolean"), "cells")
    used = cell_rows.groupBy("part", "tab", "cell").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("long")).alias("homes")).where("n > 1 and homes > 0")
    used = used.select("part", "tab", "cell", F.ceil(F.col("homes") / BLOCK).cast("int").alias("home_blocks"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    met = cell_rows.join(used, ["part", "tab", "cell"])
    # a class stands in its cell once as a prober and, at home, once more as a target
    here = F.xxhash64(F.lit(4), "rep")
    as_prober = met.select("*", F.lit(False).alias("target"), F.pmod(here, "blocks").cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("home_blocks") - 1)).alias("hb"))
    as_target = met.where("home").select("*", F.lit(True).alias("target"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("qb"), F.pmod(here, "home_blocks").cast("int").alias("hb"))
    placed = as_prober.unionByName(as_target).select("rep", "part", "tab", "cell", "target", "qb", "hb").join(reps.select("rep", "v", "copies"), "rep")

    def compare(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(group[1])
        q, h = pdf[~pdf["target"]], pdf[pdf["target"]]
        none = pd.DataFrame({"rep": [], "links": [], "to": []}).astype("int64")
        if not len(q) or not len(h):
            return none
        uq, uh = unit(q["v"]), unit(h["v"])
        iq, ih = np.nonzero(uq @ uh.T >= threshold)
        rq, rh = q["rep"].to_numpy(), h["rep"].to_numpy()
        other = rq[iq] != rh[ih]
        iq, ih = iq[other], ih[other]
        if not len(iq):
            return none
        aq, ah = np.unique(iq), np.unique(ih)
        cq, ch = cells(uq[aq], tables, probes, scale), cells(uh[ah], tables, probes, scale)
        counted = []
        for at in range(0, len(iq), 1 << 16):
            a, b = iq[at : at + (1 << 16)], ih[at : at + (1 << 16)]
            x, y = cq[np.searchsorted(aq, a)], ch[np.searchsorted(ah, b)]
            ok = _first_meeting(x, y, t)
            same_home = x[:, t, 0] == y[:, t, 0]
            both_ways = (y[:, t, :] == x[:, t, :1]).any(axis=1)
            counted.append(ok & np.where(same_home, rq[a] < rh[b], ~both_ways | (x[:, t, 0] > y[:, t, 0])))
        keep = np.concatenate(counted)
        iq, ih = iq[keep], ih[keep]
        if not len(iq):
            return none
        ids, at = np.unique(np.concatenate([rq[iq], rh[ih]]), return_inverse=True)
        weights = np.concatenate([h["copies"].to_numpy()[ih], q["copies"].to_numpy()[iq]])
        links = np.bincount(at, weights, minlength=len(ids)).astype(np.int64)
        # the smallest class that each reaches within the block
        a, b, low = at[: len(iq)], at[len(iq) :], np.arange(len(ids))
        while True:
            new = low.copy()
            np.minimum.at(new, a, low[b])
            np.minimum.at(new, b, low[a])
            new = new[new]
            if (new == low).all():
                break
            low = new
        return pd.DataFrame({"rep": ids, "links": links, "to": ids[low]})

    found = scratch.table(placed.groupBy("part", "tab", "cell", "qb", "hb").applyInPandas(compare, "rep long, links long, to long"), "links")
    linked = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")), scratch)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    by_class = (
        classes.join(links, "rep", "left").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
        .select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    out = keyed.select("id", "fine", "k1", "k2").join(by_class, ["k1", "k2"], "left")
    n_links = F.when(F.col("fine"), F.col("n_links")).otherwise(F.lit(0)).cast("long")
    component = F.when(F.col("fine"), F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), n_links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
