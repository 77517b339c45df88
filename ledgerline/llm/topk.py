"""Exact top-k by inner product: dual-tree search over cover trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import staged
from .common import bounded_sample

_LOW = np.iinfo(np.int64).min
_FOUND = "query_row long, query_id long, vec_id long, score long"


def lifted(vectors: np.ndarray, top: float) -> np.ndarray:
    """Vectors with one more coordinate that gives each the norm ``top``; for queries, which get 0 there instead, the nearest lifted vector is the one with the largest inner product."""
    v = vectors.astype("f8")
    return np.column_stack([v, np.sqrt(np.maximum(0, top * top - (v * v).sum(axis=1)))])


def highest(product, query_norm, query_radius, norm, radius, top):
    """A bound above the inner products of any query within ``query_radius`` of a center and any vector within ``radius`` of another, given the centers' product and norms. The smaller of two: by the balls themselves, and by the distance of the lifted centers."""
    by_balls = product + query_radius * norm + radius * query_norm + query_radius * radius
    gap = np.maximum(0, np.sqrt(np.maximum(0, query_norm**2 + top**2 - 2 * product)) - query_radius - radius)
    by_distance = ((query_norm + query_radius) ** 2 + top**2 - gap**2) / 2
    return np.minimum(by_balls, by_distance) + 1e-9 * (top**2 + (query_norm + query_radius) ** 2 + 1)


class CoverTree:
    """A cover tree over the rows of ``data``, in flat arrays, the root first.

    A node holds ``order[start:stop]``, all within ``radius`` of its center, one of them. Its children have centers more than ``radius / base``
    apart and hold the points within that distance of theirs; the first has the node's own center. The radius, that of the points held, falls by
    ``base`` at least from node to child. A node stays a leaf if it has ``leaf`` points or fewer, if they are all equal, or if the first ``tries`` children
    held fewer than ``least`` points on average: points as far from each other as from the center can't be told apart by balls."""

    def __init__(self, data: np.ndarray, leaf: int = 32, base: float = 1.3, least: int = 12, tries: int = 16):
        self.data, self.order = data, np.arange(len(data))
        self.base, self.least, self.tries = base, least, tries
        nodes, radii, first = [(0, 0, len(data))], [], []
        while len(radii) < len(nodes):
            center, start, stop = nodes[len(radii)]
            points = self.order[start:stop]
            radii.append(float(self._away(points, center).max(initial=0)))
            first.append(len(nodes))
            parts = self._split(points, center, radii[-1] / base) if len(points) > leaf and radii[-1] > 0 else []
            for at, own in parts:
                self.order[start : start + len(own)] = own
                nodes.append((at, start, start + len(own)))
                start += len(own)
        self.centers, self.start, self.stop = np.array(nodes).T
        self.radius, self.first = np.array(radii), np.array(first)
        self.children = np.diff(np.append(self.first, len(nodes)))

    def _away(self, points: np.ndarray, center: int) -> np.ndarray:
        return np.sqrt(((self.data[points] - self.data[center]) ** 2).sum(axis=1))

    def _split(self, rest: np.ndarray, at: int, bound: float) -> list[tuple[int, np.ndarray]]:
        parts, held = [], 0
        while len(rest):
            own = self._away(rest, at) <= bound
            parts.append((at, rest[own]))
            held += int(own.sum())
            if len(parts) >= self.tries and held < self.least * len(parts):
                return []
            rest = rest[~own]
            at = rest[0] if len(rest) else at
        return parts


class References:
    """A block of vectors and its cover tree, to be searched for many blocks of queries."""

    def __init__(self, vectors: np.ndarray, rows: np.ndarray, ids: np.ndarray, top: float):
        by_id = np.lexsort((rows, ids))  # places stand in the order of ids, so that ties go to the smaller place
        self.vectors, self.rows, self.ids, self.top = vectors[by_id], rows[by_id], ids[by_id], top
        self.tree = CoverTree(lifted(self.vectors, top))
        self.centers = self.vectors[self.tree.centers].astype("f8") if len(rows) else np.empty((0, vectors.shape[1]))
        self.norms = np.sqrt((self.centers**2).sum(axis=1))
        self.largest = int(np.abs(vectors).max(initial=0))


class DualSearch:
    """The k best of a block of references for each of a block of queries, whose scores must reach ``floors``, where given: ``best`` are places in the references (-1: none), ``scores`` their products."""

    def __init__(self, queries: np.ndarray, query_rows: np.ndarray, refs: References, k: int, floors: np.ndarray | None = None):
        exact = int(np.abs(queries).max(initial=0)) * refs.largest * queries.shape[1] < 1 << 52
        self.q, self.r = (x.astype("f8" if exact else "i8") for x in (queries, refs.vectors))
        self.query_rows, self.refs, self.k = query_rows, refs, k
        self.floors = np.full(len(queries), _LOW) if floors is None else floors
        self.scores = np.full((len(queries), k), _LOW, np.int64)
        self.best = np.full((len(queries), k), -1, np.int64)
        self.tested = 0
        if len(queries) and len(refs.rows):
            self.tree = CoverTree(queries.astype("f8"), leaf=4, least=2)
            self._descend(0, np.zeros(1, np.int64))

    def _points(self, a: int) -> np.ndarray:
        return self.tree.order[self.tree.start[a] : self.tree.stop[a]]

    def _worst(self, qs: np.ndarray) -> np.ndarray:
        return np.maximum(self.scores[qs, -1], self.floors[qs])

    def _bounds(self, a: int, nodes: np.ndarray) -> np.ndarray:
        center = self.tree.data[self.tree.centers[a]]
        return highest(self.refs.centers[nodes] @ center, np.sqrt(center @ center), self.tree.radius[a], self.refs.norms[nodes], self.refs.tree.radius[nodes], self.refs.top)

    def _descend(self, a: int, nodes: np.ndarray) -> None:
        """Query node ``a`` against reference nodes: those bounded below the worst kth score of its queries go, larger ones than itself are opened, then it is opened itself. Equal scores can still win by id."""
        tree, refs, qs = self.tree, self.refs.tree, self._points(a)
        while True:
            bounds = self._bounds(a, nodes)
            live = bounds >= self._worst(qs).min()
            nodes, bounds = nodes[live], bounds[live]
            wide = (refs.children[nodes] > 0) & ((refs.radius[nodes] > tree.radius[a]) | (tree.children[a] == 0))
            if not wide.any():
                break
            opened = [np.arange(refs.first[n], refs.first[n] + refs.children[n]) for n in nodes[wide]]
            nodes = np.concatenate([nodes[~wide], *opened])
        if tree.children[a]:
            for child in range(tree.first[a], tree.first[a] + tree.children[a]):
                self._descend(child, nodes)
            return
        for k in np.argsort(-bounds, kind="stable"):
            if bounds[k] < self._worst(qs).min():
                break
            self._test(qs, np.sort(refs.order[refs.start[nodes[k]] : refs.stop[nodes[k]]]))

    def _test(self, all_qs: np.ndarray, rs: np.ndarray, most: int = 2_000_000) -> None:
        step = max(1, most // len(rs))
        for qs in (all_qs[i : i + step] for i in range(0, len(all_qs), step)):
            scores = (self.q[qs] @ self.r[rs].T).astype(np.int64)
            self.tested += scores.size
            scores[self.query_rows[qs][:, None] == self.refs.rows[rs][None, :]] = _LOW
            worst = self._worst(qs)
            if len(rs) > self.k:
                worst = np.maximum(worst, np.partition(scores, -self.k, axis=1)[:, -self.k])
            live = (scores >= worst[:, None]) & (scores > _LOW)
            some = live.any(axis=1)
            if not some.any():
                continue
            # of a row's equal scores the first k places are enough
            live &= np.cumsum(live & (scores == worst[:, None]), axis=1) <= self.k
            columns = live.any(axis=0)
            qs = qs[some]
            s = np.concatenate([self.scores[qs], scores[np.ix_(some, columns)]], axis=1)
            p = np.concatenate([self.best[qs], np.broadcast_to(rs[columns], (len(qs), int(columns.sum())))], axis=1)
            falling = np.where(s == _LOW, np.iinfo(np.int64).max, -np.maximum(s, _LOW + 1))
            order = np.lexsort((np.where(p < 0, len(self.r), p), falling), axis=1)[:, : self.k]
            self.scores[qs] = np.take_along_axis(s, order, 1)
            self.best[qs] = np.take_along_axis(p, order, 1)


def whole_numbers(vector: str | Column) -> Column:
    """floor(256 * x) of each component, x as double; null for vectors that are null or hold null or non-finite components."""
    v = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound, F.transform(v, lambda x: F.floor(x * 256).cast("long")))


def _matrix(column, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for k, v in enumerate(column):
        out[k, : len(v)] = v
    return out


def _searched(k: int, width: int, top: float, query_block: int):
    """Over rows sorted by block, references first: keeps one block's tree, and searches it for ``query_block`` queries at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, asked = None, [], []
        refs = None

        def answers() -> Iterator[pd.DataFrame]:
            nonlocal refs, asked
            if asked and held:
                if refs is None:
                    vectors, rows, ids = (np.concatenate(x) for x in zip(*held, strict=True))
                    refs = References(vectors, rows, ids, top)
                queries, rows, ids, floors = (np.concatenate(x) for x in zip(*asked, strict=True))
                found = DualSearch(queries, rows, refs, k, floors)
                q, at = np.nonzero(found.best >= 0)
                yield pd.DataFrame({"query_row": rows[q], "query_id": ids[q], "vec_id": refs.ids[found.best[q, at]], "score": found.scores[q, at]})
            asked = []

        for pdf in batches:
            codes = pdf[["chunk", "cell", "sub"]].to_numpy()
            cuts = np.flatnonzero((np.diff(codes, axis=0) != 0).any(axis=1)) + 1
            for part in np.split(np.arange(len(pdf)), cuts):
                if not len(part):
                    continue
                if tuple(codes[part[0]]) != key:
                    yield from answers()
                    key, held, refs = tuple(codes[part[0]]), [], None
                rows = pdf.iloc[part]
                of_refs = rows.asks.to_numpy() < 0
                for kind, into in ((of_refs, held), (~of_refs, asked)):
                    if kind.any():
                        x = rows[kind]
                        into.append((_matrix(x.v, width), x.row.to_numpy(), x.id.to_numpy(), *([x.floor.to_numpy()] if into is asked else [])))
                if sum(len(a[1]) for a in asked) >= query_block:
                    yield from answers()
        yield from answers()

    return run


def top_k(df: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", block: int = 4_096, most_cells: int = 256, query_block: int = 4_096, chunk: int = 1 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` the k rows with the highest integer inner products, ties to the smaller id; its own row is no candidate, another of the same id is.

    With one more coordinate, the largest inner product is the nearest vector (``lifted``). The vectors' top level is a sample's: each row belongs to the nearest of up to
    ``most_cells`` pivots, and a cell's rows are dealt by hash into blocks of about ``block``, so neither equal vectors nor a dense region makes
    one task large. Queries first search the blocks of their own cell. What they find there, their kth scores so far, drops other cells by the pivots' covering radii before
    any row of theirs is shuffled; the rest are searched with those scores as floors. Within a block: a cover tree over it, kept for all queries that come to it,
    one over each ``query_block`` queries, and a joint descent. Every query's k best over all blocks are kept, so the result doesn't depend on the pivots; they only set how much is pruned.

    Each block's rows are shuffled twice (once more for each further ``chunk`` queries), a query's once for each block it reaches. Where all distances are about the same (uniform vectors of many dimensions), no
    bound prunes, and every query meets every block. Shorter vectors count as filled up with zeros; scores must fit 64 bits. Rows without a sound vector or with a null id take no part; an empty table gives no rows."""
    rows = df.select(F.col(key).cast("long").alias("id"), whole_numbers(vector).alias("v"), is_query.alias("is_query"), F.monotonically_increasing_id().alias("row"))
    rows = staged(rows.filter(F.col("v").isNotNull() & F.col("id").isNotNull()), "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    n, queries, width, top = rows.agg(F.count("*"), F.count_if("is_query"), F.max(F.size("v")), F.max(norm)).first()
    width, top = max(1, width or 0), (top or 0.0) * (1 + 1e-12)
    wanted = max(1, min(most_cells, -(-4 * n // block)))
    sample = bounded_sample(rows.select("row", "v"), "row", 4 * wanted, n=n).collect()  # 1,024 vectors at most, about
    pivots = np.unique(_matrix([r["v"] for r in sample], width), axis=0)
    if not len(pivots):
        pivots = np.zeros((1, width), np.int64)
    pivots = np.random.default_rng(0).permutation(pivots)[:wanted]
    near, norms = lifted(pivots, top), np.sqrt((pivots.astype("f8") ** 2).sum(axis=1))

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 2_000):
                part = pdf.iloc[at : at + 2_000]
                v = lifted(_matrix(part.v, width), top)
                products = v @ near.T
                cell = products.argmax(axis=1)
                away = np.sqrt(((v - near[cell]) ** 2).sum(axis=1))
                asks = np.where(part.is_query.fillna(False).astype(bool), (v[:, :-1] @ near[:, :-1].T).argmax(axis=1), -1)
                yield pd.DataFrame({"id": part.id, "v": part.v, "row": part.row, "cell": cell, "away": away, "asks": asks})

    dealt = staged(rows.mapInPandas(assigned, "id long, v array<long>, row long, cell int, away double, asks int"), "dealt")
    held = {r["cell"]: r for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}  # a row a cell
    subs = F.array(*(F.lit(-(-held[c]["n"] // block) if c in held else 0) for c in range(len(pivots))))
    radius = np.array([held[c]["radius"] if c in held else 0.0 for c in range(len(pivots))])
    chunks = max(1, -(-queries // chunk))
    blocks = sum(-(-h["n"] // block) for h in held.values()) * chunks
    names = ["chunk", "cell", "sub", "asks", "id", "row", "v", "floor"]
    refs = dealt.select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "cell", F.pmod(F.xxhash64("row"), subs[F.col("cell")]).cast("int").alias("sub"), F.lit(-1).alias("asks"), "id", "row", "v", F.lit(_LOW).alias("floor"))
    asked = dealt.filter("asks >= 0").select(F.pmod(F.xxhash64("row", F.lit(1)), F.lit(chunks)).cast("int").alias("chunk"), "asks", "id", "row", "v")

    def searched(to: DataFrame) -> DataFrame:
        to = to.filter(subs[F.col("cell")] > 0).withColumn("sub", F.explode(F.sequence(F.lit(0), subs[F.col("cell")] - 1))).select(names)
        both = refs.select(names).unionByName(to).repartition(max(1, min(blocks, 20_000)), "chunk", "cell", "sub").sortWithinPartitions("chunk", "cell", "sub", "asks")
        return both.mapInPandas(_searched(k, width, top, query_block), _FOUND)

    def ranked(found: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", place).filter(F.col("rank") <= k)

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = _matrix(pdf.v, width).astype("f8")
            most = highest(v @ pivots.T.astype("f8"), np.sqrt((v * v).sum(axis=1))[:, None], 0.0, norms[None, :], radius[None, :], top)
            live = most >= pdf.floor.to_numpy()[:, None]
            live[np.arange(len(pdf)), pdf.asks.to_numpy()] = False
            yield pdf.assign(cells=[list(np.flatnonzero(x)) for x in live])

    found = searched(asked.withColumns({"cell": F.col("asks"), "floor": F.lit(_LOW)}))
    if len(pivots) > 1:
        found = staged(ranked(found), "near")
        floors = found.filter(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").alias("floor"))
        rest = asked.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(_LOW))).select("chunk", "asks", "id", "row", "v", "floor")
        rest = rest.mapInPandas(others, "chunk int, asks int, id long, row long, v array<long>, floor long, cells array<int>").withColumn("cell", F.explode("cells"))
        found = found.drop("rank").unionByName(searched(rest))
    return ranked(found).select("query_id", "rank", "vec_id", "score")
