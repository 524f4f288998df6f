"""Exact k nearest neighbours by pivot cells and triangle-inequality bounds.

References are dealt to the nearest of at most ``pivots`` pivots.  A query first meets its
nearest cells, which hold k references at least; the k-th distance found there, t, bounds the rest: a cell of radius R about a pivot
at distance d can hold a nearer reference only if ``d - R <= t``, and a run of references at
distances r to s from the pivot only if ``r - t <= d <= s + t``.  What remains is compared by
matrix products of the differences from the pivot, whose rounding is bounded, so only
references that may lie within t get a distance from the differences themselves: the result
equals a scan of all pairs at every setting.  On vectors without clusters most cells remain.

Queries and references meet as groups of cells through a cogroup.  A group has about
``block`` times REF_BLOCKS references or QUERY_BLOCKS queries; a cell that has more is cut, so
no group grows with the data or with a hot cell, and a vector is sent once a group that it
meets, not once a pair.  The driver sees the pivots and a row for each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import hash_hex
from tessera.session import materialize

#: bounds are widened by this share, far above the error of double sums
SLACK = 1e-9

#: visits that a worker holds at a time, each with its query's vector
VISITS = 1 << 14

#: blocks of references and of queries that one task has
REF_BLOCKS, QUERY_BLOCKS = 8, 4

#: references, and queries, whose products are worked out at once
CHUNK = 1024


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances from the differences themselves: equal vectors are at 0 exactly."""
    out = np.empty((len(x), len(y)))
    step = max(1, (1 << 18) // max(1, y.size))
    for a in range(0, len(x), step):
        out[a:a + step] = np.sqrt(((x[a:a + step, None, :] - y[None]) ** 2).sum(axis=2))
    return out


def _matrix(col) -> np.ndarray:
    """The vectors of a list column, all of one length; a missing number is nan."""
    if not len(col):
        return np.zeros((0, 0))
    col = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col
    sizes = np.unique(pc.list_value_length(col).to_numpy(zero_copy_only=False))
    if len(sizes) > 1:
        raise ValueError(f"vectors of several lengths: {sizes.tolist()}")
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(col), int(sizes[0]))


def _clean(df: DataFrame, key: str, vec_col: str, *more) -> DataFrame:
    kind = dict(df.dtypes)[vec_col]  # floats are sent as they are
    return df.where(F.col(vec_col).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"),
        F.col(vec_col).cast(kind if kind == "array<float>" else "array<double>").alias("vec"), *more)


def _with_columns(batch: pa.RecordBatch, **more) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, more.values())], names=[*batch.schema.names, *more])


def _groups(cells: dict[int, int], most: int) -> dict[int, tuple[int, int]]:
    """First group and number of groups of each cell (cell: its rows): neighbouring small cells share one."""
    out, at, room = {}, -1, 0
    for c, n in sorted(cells.items()):
        parts = -(-n // most)
        if parts > 1:
            out[c], at, room = (at + 1, parts), at + parts, 0
            continue
        if n > room:
            at, room = at + 1, most
        out[c], room = (at, 1), room - n
    return out


def _of_cell(groups: dict[int, tuple[int, int]], i: int):
    return F.element_at(F.create_map(*[F.lit(v) for c, g in groups.items() for v in (c, g[i])]), F.col("cell"))


def _group(groups: dict[int, tuple[int, int]], by: str):
    """The group of a row by its cell; rows of a cut cell are dealt by a hash of ``by``."""
    return (_of_cell(groups, 0) + F.pmod(F.xxhash64(by), _of_cell(groups, 1))).cast("int")


def _visits(queries: DataFrame, centers: np.ndarray, cells: dict, first: bool, k: int, block: int) -> DataFrame:
    """A row for each query, cell and part of ``block`` references that it meets: (id, vec, t, cell, part, q_part, d).

    ``first``: the nearest cells that hold k references together, with the bound that their
    radii give; else (``t`` is set) all within the bound, of cells that share a group the first."""
    ids = np.array(sorted(cells))
    n, radius = np.array([cells[c][0] for c in ids]), np.array([cells[c][1] for c in ids])
    parts, groups = -(-n // block), _groups({c: cells[c][0] for c in cells}, block)
    member = np.zeros((len(ids), max(sum(g) for g in groups.values())), dtype=bool)  # the groups of each cell
    for i, c in enumerate(ids):
        member[i, groups[c][0]:sum(groups[c])] = True
    lead = member.argmax(axis=0)

    # queries whose visits are held at a time: a query meets every part at most
    step = max(1, VISITS // int(parts.sum()))

    def run(batches):
        for q in (b.iloc[a:a + step] for b in batches for a in range(0, len(b), step)):
            x = np.stack(q["vec"].to_numpy()).astype(np.float64)
            d = _distances(x, centers[ids])
            if first:
                order = np.argsort(d, axis=1, kind="stable")
                # how many references stand in the cells before each, by distance of the pivot
                before = np.cumsum(n[order], axis=1) - n[order]
                home = np.zeros_like(d, dtype=bool)
                np.put_along_axis(home, order, before < k, axis=1)
                reach = np.sort(np.where(home, d + radius, -np.inf), axis=1)[:, -1]
                t = np.where(n.sum() >= k, reach * (1 + SLACK), np.inf)
                row, col = np.nonzero(home)
                rep = parts[col]
                row, col = np.repeat(row, rep), np.repeat(col, rep)
                part = np.arange(len(col)) - np.repeat(np.cumsum(rep) - rep, rep)
            else:
                t = q["t"].to_numpy()
                far = d - radius > (t * (1 + SLACK))[:, None] + SLACK * d  # nan is not ruled out
                row, group = np.nonzero(~far @ member)
                col = lead[group]
                part = group - np.array([groups[c][0] for c in ids])[col]
            yield pd.DataFrame({"id": q["id"].to_numpy()[row], "vec": list(x[row]), "t": t[row], "cell": ids[col],
                                "part": part, "q_part": q["q_part"].to_numpy()[row], "d": d[row, col]})

    return queries.mapInPandas(run, "id long, vec array<double>, t double, cell long, part long, q_part long, d double")


class _Nearest:
    """The k nearest references so far of queries ``x`` with bounds ``t`` on the k-th distance."""

    def __init__(self, x: np.ndarray, t: np.ndarray, y: np.ndarray, rid: np.ndarray, k: int):
        self.x, self.y, self.rid, self.k = x, y, rid, k
        self.bound = t * (1 + SLACK)
        self.dist, self.ref = np.full((len(x), k), np.inf), np.full((len(x), k), -1)
        self.scored = np.zeros(len(x), dtype=np.int64)
        self.held, self.n_held = [], 0

    def _exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.x[i] - self.y[j]) ** 2).sum(axis=-1))

    def meet(self, center: np.ndarray, refs: np.ndarray, far: np.ndarray, rows: np.ndarray | None = None) -> None:
        """References (places ``refs``) of one cell by their distance ``far`` from its pivot, nan last."""
        rows = np.arange(len(self.x)) if rows is None else rows
        x = self.x[rows] - center
        near = np.sqrt((x ** 2).sum(axis=1))
        for a in range(0, len(refs), CHUNK):
            part, f = refs[a:a + CHUNK], far[a:a + CHUNK]
            y = self.y[part] - center
            bound, slack = self.bound[rows], SLACK * (near + f[-1])
            use = np.flatnonzero(~((near - bound > f[-1] + slack) | (near + bound < f[0] - slack)))  # nan is not ruled out
            for b in range(0, len(use), CHUNK):
                u = use[b:b + CHUNK]
                self._compare(rows[u], x[u], near[u], part, y, f[-1])
        if self.n_held:
            self._merge()

    def _compare(self, at: np.ndarray, x: np.ndarray, near: np.ndarray, refs: np.ndarray, y: np.ndarray, far: float) -> None:
        self.scored[at] += len(refs)
        top = max(near.max(), far)
        kind = np.float32 if top < 1e15 else np.float64
        # x.y - y.y / 2 is the larger, the nearer
        s = (np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(kind)
             @ np.concatenate([y, -0.5 * (y ** 2).sum(axis=1, keepdims=True)], axis=1).astype(kind).T)
        bound = self.bound[at]
        new = np.flatnonzero(~(bound < np.inf))
        if len(new) and len(refs) >= self.k:  # any k distances bound the k-th
            some = np.argpartition(-s[new], self.k - 1, axis=1)[:, :self.k]
            bound[new] = self._exact(at[new][:, None], refs[some]).max(axis=1) * (1 + SLACK)
            self.bound[at] = np.fmin(self.bound[at], bound)
        error = (x.shape[1] + 8) * float(np.finfo(kind).eps) * (near * far + far ** 2 + near ** 2 + bound ** 2) + 1e-30
        least = ((near ** 2 - bound ** 2) / 2 - error).astype(kind)
        i, j = np.divmod(np.flatnonzero(~(s < least[:, None])), len(refs))
        i, j = at[i], refs[j]
        self.held.append((i, j, self._exact(i, j)))
        self.n_held += len(i)
        if self.n_held > max(4 * CHUNK, len(self.x)):
            self._merge()

    def _merge(self) -> None:
        i, j, d = (np.concatenate(z) for z in zip(*self.held))
        self.held, self.n_held = [], 0
        rows = np.unique(i)
        i = np.concatenate([i, np.repeat(rows, self.k)])
        j, d = np.concatenate([j, self.ref[rows].ravel()]), np.concatenate([d, self.dist[rows].ravel()])
        i, j, d = i[j >= 0], j[j >= 0], d[j >= 0]
        order = np.lexsort((self.rid[j], d, i))
        i, j, d = i[order], j[order], d[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        i, j, d, nth = (z[nth < self.k] for z in (i, j, d, nth))
        self.dist[i, nth], self.ref[i, nth] = d, j
        self.bound[rows] = np.fmin(self.bound[rows], self.dist[rows, -1] * (1 + SLACK))


def _by_cell(r: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Each cell of the references, their places and distances from its pivot by that distance."""
    cell, far = r.column("cell").to_numpy(), r.column("d").to_numpy()
    order = np.lexsort((far, cell))
    return [(int(cell[p[0]]), p, far[p]) for p in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1)]


def knn(queries: DataFrame, refs: DataFrame, key: str, vec_col: str, label_col: str, k: int = 3, pivots: int = 64,
        block: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(id, rid, rlabel, dist, nth): the k nearest references of every query, nearest first,
    ties by reference id; and (id, scored): distances computed for it.

    Rows without a key or a vector are left out; all vectors have one length."""
    r = _clean(refs, key, vec_col, F.col(label_col).cast("long").alias("rlabel")).withColumnRenamed("id", "rid")
    q = _clean(queries, key, vec_col)
    chosen = r.orderBy(hash_hex("pivot", "rid"), "rid").limit(pivots).select("vec").collect()  # at most ``pivots``
    empty = queries.sparkSession.createDataFrame([], "id long, rid long, rlabel long, dist double, nth int")
    none = empty, empty.select("id", F.lit(0).cast("long").alias("scored"))
    if not chosen:
        return none
    centers = np.array([x["vec"] for x in chosen], dtype=np.float64)

    def deal(df, ids, name):
        """``df`` with its nearest pivot of ``ids`` and the distance, written; and of each cell its rows and radius."""
        def run(batches):
            for b in batches:
                if b.num_rows:
                    d = _distances(_matrix(b.column("vec")), centers[ids])
                    cell = d.argmin(axis=1)
                    yield _with_columns(b, cell=ids[cell], d=d[np.arange(len(d)), cell])

        dealt = materialize(df.mapInArrow(run, ", ".join([*(f"{n} {t}" for n, t in df.dtypes), "cell long, d double"])), name)
        rows = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("radius")).collect()  # a row a pivot
        return dealt, {x["cell"]: (x["n"], x["radius"]) for x in rows}

    dealt, cells = deal(r, np.arange(len(centers)), "knn-refs")
    ids = np.array(sorted(cells))
    q, q_cells = deal(q, ids, "knn-queries")
    if not q_cells:
        return none
    groups = _groups({c: n for c, (n, _) in cells.items()}, block * REF_BLOCKS)
    dealt = dealt.withColumn("grp", _group(groups, "rid"))
    q = q.withColumn("q_part", _group(_groups({c: n for c, (n, _) in q_cells.items()}, block * QUERY_BLOCKS), "id"))

    def meet(q, is_first, fn, schema):
        """``fn`` of each query group and the references of each group that it meets."""
        visits = _visits(q, centers, cells, is_first, k, block * REF_BLOCKS).withColumn(
            "grp", (_of_cell(groups, 0) + F.col("part")).cast("int"))
        right = dealt.join(materialize(visits.select("grp", "q_part").distinct(), "knn-pairs"), "grp")
        found = visits.groupBy("grp", "q_part").cogroup(right.groupBy("grp", "q_part")).applyInArrow(fn, schema)
        return materialize(found, "knn-found")

    def first(q, r):
        """The bound of each query by the references of a cell that it meets, or of the group if these are less than k."""
        x, home, t = _matrix(q.column("vec")), q.column("cell").to_numpy(), q.column("t").to_numpy()
        # any k distances are a closer bound than the radii
        near = _Nearest(x, np.full(len(x), np.inf), _matrix(r.column("vec")), r.column("rid").to_numpy(), k)
        found = _by_cell(r) if q.num_rows and r.num_rows else []
        for c in np.unique(home):
            rows, own = np.flatnonzero(home == c), [z for z in found if z[0] == c and len(z[1]) >= k]
            for cell, places, far in own or found:
                near.meet(centers[cell], places, far, rows)
        return pa.table({"id": q.column("id"), "t": np.fmin(near.dist[:, -1], t), "scored": near.scored})

    found = meet(q.select("id", "vec", "q_part"), True, first, "id long, t double, scored long")
    # rows that repeat an id have their neighbours in common: the least bound holds for all
    bound = found.groupBy("id").agg(F.min("t").alias("t"), F.sum("scored").alias("scored"))
    bound = materialize(bound, "knn-bounds")
    q = q.select("id", "vec", "q_part").join(bound.select("id", "t"), "id", "left")

    def rest(q, r):
        x, rid, label = _matrix(q.column("vec")), r.column("rid"), r.column("rlabel")
        near = _Nearest(x, q.column("t").to_numpy(), _matrix(r.column("vec")), rid.to_numpy(), k)
        for cell, places, far in _by_cell(r) if q.num_rows and r.num_rows else []:
            near.meet(centers[cell], places, far)
        i, nth = np.nonzero(near.ref >= 0)
        j = near.ref[i, nth]
        no = np.flatnonzero((near.ref[:, 0] < 0) & (near.scored > 0))  # counted, though nothing is near
        gap = np.zeros(len(no), dtype=np.int64)
        to = pa.array(np.concatenate([j, gap]), mask=np.concatenate([j < 0, gap == 0]))
        at = np.concatenate([i, no])
        return pa.table({"id": q.column("id").take(pa.array(at)), "rid": rid.take(to), "rlabel": label.take(to),
                         "dist": np.concatenate([near.dist[i, nth], np.full(len(no), np.inf)]),
                         "scored": np.where(np.concatenate([nth, gap]) == 0, near.scored[at], 0)})

    found = meet(q, False, rest, "id long, rid long, rlabel long, dist double, scored long")
    scored = found.select("id", "scored").unionByName(bound.select("id", "scored")).groupBy("id").agg(F.sum("scored").alias("scored"))
    each = Window.partitionBy("id").orderBy("dist", "rid")
    best = found.where("rid IS NOT NULL").withColumn("nth", F.row_number().over(each)).where(F.col("nth") <= k)
    return best.select("id", "rid", "rlabel", "dist", "nth"), scored


def vote(near: DataFrame) -> DataFrame:
    """(id, pred): the label of most neighbours; ties go to the smallest label."""
    votes = near.groupBy("id", "rlabel").agg(F.count(F.lit(1)).alias("_v"))
    return votes.groupBy("id").agg(F.min_by("rlabel", F.struct(-F.col("_v"), F.col("rlabel"))).alias("pred"))
