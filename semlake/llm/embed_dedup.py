"""Near-duplicate embeddings: spherical k-means cells, and blocked cosine products within cells.

Equal vectors are first made one row with a count. For each dimension that occurs, centres are fitted on a bounded sample;
every vector has its nearest centre as home and is also shown to the cells whose border is near, so that a link across a
border is met there. How near is measured on the sample for each dimension (see ``needed_slack``): in few dimensions, or
where vectors differ in few directions, the belt is wide, up to the width beyond which no pair can be missed at all. Within
a cell, vectors are dealt into blocks, and every pair of blocks is a task's unit: matrix products give the cosines in double
precision, a unit hands on each vector's number of links and a star for each of its groups. A pair of vectors that meets
in both homes counts in the one with the smaller number. Components are found by distributed rounds.

Links reported always hold. A pair is missed only if neither vector is shown to the other's home; the measured share
of missed pairs is in the README.

Defined results: vectors that are null, zero, or with null or non-finite components link with nothing; vectors are compared
with those of their own dimension; rows that share a vec_id are one vector each; a null vec_id never names a component
unless no other id is in it; an empty table has an empty result; other columns (labels too) play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semlake.llm.common import components, join_hot, release, table
from semlake.llm.textblock import components_of

COSINE = 0.9
#: Bytes of the sample that centres are fitted on, as 32-bit components, and vectors of it for each cell.
SAMPLE_BYTES, A_CELL = 64 << 20, 8
#: Share of pairs at the threshold itself that cells may miss, by the measurement on the sample; pairs above it are closer.
MISSED = 0.01
#: Bytes of a block's unit vectors.
BLOCK_BYTES = 8 << 20
#: Cosines computed at a time.
STEP = 1 << 22


def fit_centres(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Spherical k-means: unit centres that maximise the cosines of unit vectors with their nearest centre."""
    rng = np.random.default_rng(seed)
    k = min(k, len(sample))
    centres = sample[rng.choice(len(sample), k, replace=False)].copy()
    for _ in range(rounds):
        home = np.concatenate([(sample[i : i + 8192] @ centres.T).argmax(axis=1) for i in range(0, len(sample), 8192)])
        order = np.argsort(home, kind="stable")
        cells, first = np.unique(home[order], return_index=True)
        sums = np.add.reduceat(sample[order], first, axis=0)
        norm = np.linalg.norm(sums, axis=1)
        good = norm > 0
        centres[cells[good]] = sums[good] / norm[good, None]
    return centres


def usable(v: Column) -> Column:
    """Whether a vector can link: some component isn't zero, and all are finite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0.0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def shown_to(x: np.ndarray, centres: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The home of each unit vector, and (row, cell) for every cell that it is shown to, its home included."""
    sim = x @ centres.T
    home = sim.argmax(axis=1)
    lead = sim[np.arange(len(x)), home][:, None] - sim
    row, cell = np.nonzero(lead <= 2 * slack)  # centres are at most 2 apart
    apart = np.linalg.norm(centres[home[row]] - centres[cell], axis=1)
    near = (lead[row, cell] <= slack * apart) | (cell == home[row])
    return home, row[near], cell[near]


def needed_slack(sample: np.ndarray, centres: np.ndarray, cosine: float, probes: int = 4000, seed: int = 9) -> float:
    """The slack at which all but MISSED of the pairs at the cosine meet.

    Partners of sample vectors are made at exactly that cosine, half in random directions and half in those of other sample
    vectors; pairs that the sample itself holds are looked at as well, and the wider need holds. No need exceeds the sine
    of the angle, at which a vector is shown to every cell that a partner can live in.
    """
    most = float(np.sqrt(max(0.0, 1 - cosine * cosine)))
    if len(centres) < 2:
        return 0.0
    rng = np.random.default_rng(seed)
    x = sample[rng.choice(len(sample), probes, replace=len(sample) < probes)]
    needs = []

    def need(x: np.ndarray, y: np.ndarray) -> None:
        if not len(x):
            return
        each = []
        for at in range(0, len(x), max(1, STEP // len(centres))):
            part = slice(at, at + max(1, STEP // len(centres)))
            sx, sy = x[part] @ centres.T, y[part] @ centres.T
            row, hx, hy = np.arange(len(sx)), sx.argmax(axis=1), sy.argmax(axis=1)
            apart = np.linalg.norm(centres[hx] - centres[hy], axis=1)
            lead = np.minimum(sx[row, hx] - sx[row, hy], sy[row, hy] - sy[row, hx])
            each.append(np.where(hx == hy, 0.0, lead / np.maximum(apart, 1e-12)))
        needs.append(np.quantile(np.concatenate(each), 1 - MISSED))

    toward = np.concatenate([rng.normal(size=x.shape), sample[rng.choice(len(sample), len(x))]])
    both = np.concatenate([x, x])
    u = toward - (toward * both).sum(axis=1, keepdims=True) * both
    norm = np.linalg.norm(u, axis=1)
    some = norm > 1e-9
    need(both[some], cosine * both[some] + most * u[some] / norm[some, None])
    for at in range(0, min(len(x), 1000), 100):
        i, j = np.nonzero(x[at : at + 100] @ sample.T >= cosine)
        need(x[at + i][:100_000], sample[j][:100_000])
    return min(most, max(needs, default=most))


def unit_links(
    members: np.ndarray, weight: np.ndarray, home: np.ndarray, shown: list[np.ndarray], block: np.ndarray,
    cell: int, bi: int, bj: int, cosine: float,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of a unit, found by blocks: members with links, their numbers of linked vectors, their group's first member."""
    n = len(members)
    count, label = np.zeros(n, np.int64), np.arange(n)
    visits = np.sort(np.repeat(np.arange(n), [len(s) for s in shown]).astype(np.int64) << 32 | np.concatenate(shown))
    left, right = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
    for a in range(0, len(left), 1024):
        rows = left[a : a + 1024]
        for b in range(0, len(right), 4096):
            cols = right[b : b + 4096]
            if bi == bj and cols[-1] <= rows[0]:
                continue  # the same pairs the other way round
            i, j = np.nonzero(members[rows] @ members[cols].T >= cosine)
            i, j = rows[i], cols[j]
            once = (home[i] == cell) | (home[j] == cell)
            if bi == bj:
                once &= i < j
            i, j = i[once], j[once]
            # One of the two lives here. Where the other lives elsewhere and this one is shown there, the smaller cell counts.
            far = np.where(home[i] == cell, j, i)
            near = np.where(home[i] == cell, i, j)
            there = near << 32 | home[far]
            at = np.minimum(np.searchsorted(visits, there), len(visits) - 1)
            once = (home[far] >= cell) | (visits[at] != there)
            i, j = i[once], j[once]
            count += np.bincount(i, weight[j], minlength=n).astype(np.int64)
            count += np.bincount(j, weight[i], minlength=n).astype(np.int64)
            label = components_of(n, i, j, label)
    linked = np.flatnonzero(count)
    return linked, count[linked], label[linked]


def fitted(some: pa.Table, step: int, cosine: float, slack: float | None) -> dict[int, tuple[np.ndarray, float]]:
    """(centres, slack) for each dimension in the sample, of which every vector stands for ``step``."""
    column = some.column("v").combine_chunks()
    sizes, flat = pc.list_value_length(column).to_numpy(), column.flatten().to_numpy()
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    known = {}
    for size in np.unique(sizes).tolist():
        x = flat[first[sizes == size][:, None] + np.arange(size)]
        x = unit(x[np.lexsort(x.T)].astype(np.float64))  # rows arrive in any order
        centres = fit_centres(x, max(1, min(round((len(x) * step) ** 0.5), len(x) // A_CELL)))
        known[size] = centres, needed_slack(x, centres, cosine) if slack is None else slack
    return known


def near_duplicates(
    vectors: DataFrame, cosine: float = COSINE, slack: float | None = None, sample_bytes: int = SAMPLE_BYTES, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row. slack: as measured on the sample, unless one is given."""
    small = dict(vectors.dtypes)["embedding"] == "array<float>"  # then four bytes hold a component exactly
    # Adding 0.0 makes -0.0 the same; equal vectors once: a hash of 128 bits names them.
    v = F.transform("embedding", lambda x: x + F.lit(0.0).cast("float")) if small else F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    named = vectors.where(usable(F.col("embedding"))).select("vec_id", v.alias("v")).withColumn("name", F.concat_ws("-", F.xxhash64("v"), F.xxhash64(F.lit(1), "v")))
    rows = table(named.select("vec_id", "name"), "vectors")
    equal = named.groupBy("name").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.any_value("v").alias("v"))
    # Numbers of the written rows: no two vectors share one.
    equal = table(equal.withColumn("node", F.monotonically_increasing_id()), "equal")
    total, components_held = equal.agg(F.count(F.lit(1)), F.sum(F.size("v"))).first()
    step = max(1, -(-4 * (components_held or 0) // sample_bytes))
    some = equal.where(F.pmod(F.xxhash64(F.lit(7), "name"), F.lit(step)) == 0)
    some = some.select(F.transform("v", lambda x: x.cast("float")).alias("v")).where(usable(F.col("v"))).limit(2 * total // step + 100).toArrow()
    if not total:
        return _finish(vectors, rows, equal, None)
    known = fitted(some, step, cosine, slack)
    del some
    release()
    kind = np.float32 if small else np.float64

    def assign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            sizes, flat = pc.list_value_length(b.column(2)).to_numpy(), b.column(2).flatten().to_numpy()
            first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                centres, belt = known.get(size, (np.zeros((1, size)), 0.0))  # too few for the sample: one cell
                for k in range(0, len(own), max(1, STEP // len(centres))):
                    mine = own[k : k + max(1, STEP // len(centres))]
                    x = flat[first[mine][:, None] + np.arange(size)]
                    home, row, cell = shown_to(unit(x.astype(np.float64)), centres, belt)
                    at = np.searchsorted(row, np.arange(len(x) + 1))
                    visits = pa.array([cell[s:e].astype(np.int32).tobytes() for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary())
                    raw = pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())
                    for j in range(0, len(row), 4096):
                        seen = row[j : j + 4096]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(seen), size, np.int32)), pa.array(cell[j : j + 4096].astype(np.int32)), pa.array(home[seen].astype(np.int32)),
                             *[c.take(pa.array(mine[seen])) for c in b.columns[:2]], visits.take(pa.array(seen)), raw.take(pa.array(seen))],
                            names=["dim", "cell", "home", "node", "n", "shown", "vector"],
                        )

    shown = table(equal.select("node", "n", "v").mapInArrow(assign, "dim int, cell int, home int, node long, n long, shown binary, vector binary"), "cells")
    # A large cell is cut into blocks; each row meets every block of its cell.
    held = F.count(F.lit(1)) * F.col("dim") * 8
    blocks = table(shown.groupBy("dim", "cell").agg(F.ceil(held / F.lit(block_bytes)).cast("int").alias("blocks")), "blocks")
    own = F.pmod(F.xxhash64(F.lit(11), "node"), F.col("blocks")).cast("int")
    dealt = shown.join(blocks, ["dim", "cell"]).withColumn("block", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")}).drop("blocks", "other")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        first, node = pdf.iloc[0], pdf["node"].to_numpy()
        vector = np.frombuffer(b"".join(pdf["vector"]), kind).reshape(len(pdf), -1)
        linked, count, root = unit_links(
            unit(vector.astype(np.float64)), pdf["n"].to_numpy(np.float64), pdf["home"].to_numpy(np.int64),
            [np.frombuffer(x, np.int32).astype(np.int64) for x in pdf["shown"]], pdf["block"].to_numpy(),
            int(first["cell"]), int(first["bi"]), int(first["bj"]), cosine,
        )
        return pd.DataFrame({"node": node[linked], "links": count, "centre": node[root]})

    found = dealt.groupBy("dim", "cell", "bi", "bj").applyInPandas(compare, "node long, links long, centre long")
    return _finish(vectors, rows, equal, table(found, "found"))


def _finish(vectors: DataFrame, rows: DataFrame, equal: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        groups = equal.select("name", "n", F.lit(0).cast("long").alias("links"), F.col("least").alias("component_id"))
    else:
        links = found.groupBy("node").agg(F.sum("links").alias("links"))
        member = table(components(found.select(F.col("node").alias("u"), F.col("centre").alias("v"))), "components")
        rooted = equal.drop("v").join(member, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
        rooted = table(rooted, "rooted")
        least = table(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size")), "roots")
        groups = join_hot(rooted, least, "root", "size", rooted.count())
        groups = table(groups.select("name", "n", F.coalesce("links", F.lit(0)).alias("links"), "component_id"), "groups")
    linked = join_hot(rows, groups, "name", "n", rows.count()).select(
        "vec_id", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id"
    )
    alone = vectors.where(~usable(F.col("embedding"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
