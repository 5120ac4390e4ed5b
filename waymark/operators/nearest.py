"""The k nearest points of each query within one tile of space, over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LEAF = 64  # points, or queries, that are compared at once
BLOCK = 16  # leaves that are looked at between two looks at the bound


def tile_search(keys: Sequence[str], k: int, drop_self: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` over rows sorted by ``keys`` and ``kind``: points (0) come before queries (1).

    Queries get ``found``: of the tile's points with d2 <= r2, the k first by (d2, match_id). Queries that have ``found``
    already pass. Both sides are split into leaves; a leaf of queries only meets leaves of points whose boxes are nearer than
    its farthest k-th match, so that a dense tile costs far less than all of its pairs. All is nested, and so travels by value.
    """

    def leaves(x: np.ndarray) -> list[np.ndarray]:
        stack, out = [np.arange(len(x))], []
        while stack:
            i = stack.pop()
            if len(i) <= LEAF:
                out.append(i)
                continue
            span = np.ptp(x[i], axis=0)
            axis = int(span.argmax())
            if span[axis] == 0:
                out.extend(np.array_split(i, -(-len(i) // LEAF)))
                continue
            order = np.argpartition(x[i, axis], len(i) // 2)
            stack += [i[order[: len(i) // 2]], i[order[len(i) // 2 :]]]
        return out

    def distinct(p: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of equal points, only the k + 1 first ids can be among anyone's k nearest."""
        order = np.lexsort((code, p[:, 2], p[:, 1], p[:, 0]))
        p, code, place = p[order], code[order], np.arange(len(p))
        first = np.maximum.accumulate(np.where(np.r_[True, (p[1:] != p[:-1]).any(axis=1)], place, 0))
        return p[place - first <= k], code[place - first <= k]

    def nearest(p: np.ndarray, code: np.ndarray, q: np.ndarray, own: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(d2, code)``, each of shape (queries, k), in order; inf where there is none."""
        p, code = distinct(p, code)
        parts = leaves(p)
        order, ends = np.concatenate(parts), np.cumsum([len(i) for i in parts])
        p, code, starts = p[order], code[order], np.r_[0, ends[:-1]]
        low, high = np.minimum.reduceat(p, starts), np.maximum.reduceat(p, starts)
        all_d, all_c = np.full((len(q), k), np.inf), np.full((len(q), k), -1)

        for g in leaves(q):
            x, most, best_d, best_c = q[g], limit[g], all_d[g], all_c[g]
            gap = np.maximum(0, np.maximum(low - x.max(axis=0), x.min(axis=0) - high))
            far = (gap * gap).sum(axis=1) * (1 - 1e-12)  # never above a computed d2
            ahead = np.argsort(far, kind="stable") if len(far) <= BLOCK else np.argpartition(far, BLOCK)[:BLOCK]
            rest = None
            while len(ahead):
                ahead = ahead[far[ahead] <= np.minimum(best_d[:, -1], most).max()]
                if not len(ahead):
                    break
                at = np.concatenate([np.arange(starts[i], ends[i]) for i in ahead[:BLOCK]])
                d = [x[:, a, None] - p[None, at, a] for a in range(3)]
                d = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
                d[(d > most[:, None]) | (code[at][None] == own[g, None])] = np.inf
                d = np.hstack([best_d, d])
                c = np.hstack([best_c, np.broadcast_to(code[at], (len(x), len(at)))])
                row, column = np.nonzero((d <= np.partition(d, k - 1, axis=1)[:, k - 1, None]) & (d < np.inf))
                d, c = d[row, column], c[row, column]
                by = np.lexsort((c, d, row))
                row, d, c = row[by], d[by], c[by]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                row, d, c, rank = (v[rank < k] for v in (row, d, c, rank))
                best_d[row, rank], best_c[row, rank] = d, c
                done, ahead = ahead[:BLOCK], ahead[BLOCK:]
                if rest is None and len(far) > BLOCK:
                    rest = np.nonzero(far <= np.minimum(best_d[:, -1], most).max())[0]
                    rest = rest[~np.isin(rest, done)]
                    ahead = rest[np.argsort(far[rest], kind="stable")]
            all_d[g], all_c[g] = best_d, best_c
        return all_d, all_c

    def matrix(t: pa.Table) -> np.ndarray:
        return np.column_stack([t[c].to_numpy() for c in "xyz"])

    def searched(t: pa.Table, columns: Sequence[str]) -> Iterator[pa.RecordBatch]:
        n = int((t["kind"].to_numpy() == 0).sum())
        points, queries = t.slice(0, n), t.slice(n)
        if not queries.num_rows:
            return
        known = pc.is_valid(queries["found"])
        yield from queries.filter(known).select(columns).to_batches()
        queries = queries.filter(pc.invert(known))
        if not queries.num_rows:
            return
        ids = points["match_id"].combine_chunks()
        counts, values = np.zeros(queries.num_rows, int), pa.array([], t.schema.field("found").type.value_type)
        if n:
            names = pc.unique(ids)
            names = names.take(pc.sort_indices(names))
            own = pc.fill_null(pc.index_in(queries["query_id"].cast(ids.type), value_set=names), -1).to_numpy() if drop_self else np.full(queries.num_rows, -1)
            d, c = nearest(matrix(points), pc.index_in(ids, value_set=names).to_numpy().astype(int), matrix(queries), np.where(own < 0, -2, own), queries["r2"].to_numpy())
            there = d < np.inf
            counts = there.sum(axis=1)
            values = pa.StructArray.from_arrays([pa.array(d[there]), names.take(pa.array(c[there]))], fields=list(values.type))
        found = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), values)
        found = found.cast(t.schema.field("found").type)
        out = queries.set_column(queries.schema.get_field_index("found"), t.schema.field("found"), pa.chunked_array([found]))
        yield from out.select(columns).combine_chunks().to_batches()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, columns = [], None, []
        for b in batches:
            if not b.num_rows:
                continue
            columns = [c for c in b.schema.names if c not in ("kind", "match_id", "r2")]
            at = np.column_stack([b.column(c).to_numpy() for c in keys])
            cuts = np.nonzero((at[1:] != at[:-1]).any(axis=1))[0] + 1
            if last is not None and (at[0] != last).any():
                cuts = np.r_[0, cuts]
            start, last = 0, at[-1]
            for cut in cuts.tolist():
                held.append(b.slice(start, cut - start))
                yield from searched(pa.Table.from_batches(held), columns)
                held, start = [], cut
            held.append(b.slice(start))
        if held:
            yield from searched(pa.Table.from_batches(held), columns)

    return search
