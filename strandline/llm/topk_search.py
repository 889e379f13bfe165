"""Exact top-k inner-product search by pivot-table elimination.

Every vector's distances to a set of pivots are computed once and kept beside it (the pivot table). By the triangle
inequality the largest difference between a query's and a candidate's distances to one pivot bounds their own distance
from below, and so their inner product from above: 2 q.c = |q|^2 + |c|^2 - d(q, c)^2. A task first skips whole cells
whose bound cannot reach a query's k-th best score, then evaluates the remaining candidates in the order of their
bounds until the next bound is below the k-th best score. That stop is exact; ties go to the smaller id.

Components are integers of any size. Scores are made in double precision where they are exact there, which is below 2^53,
and from parts of 22 bits otherwise. Bounds are made in floating point with a slack above what they can be off.

Tasks measure queries as they do candidates, and score them against a small sample for a first floor of their k-th best score.
Queries are then broadcast, at most ``pass_bytes`` of them at once, and searched together: a task takes its candidates in
steps of up to ``step_bytes``, sorted into cells once for all blocks of queries, and keeps each query's k best over all its steps.
Every step starts from the floor that those before have reached. So a task hands on k rows of a query at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm.common import materialize, python_workers, scratch_path


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as array<long>; null if the vector or a component is null, or one is not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def choose_pivots(sample, count: int):
    """Farthest-first: each pivot is the sampled vector farthest from those before it."""
    import numpy as np

    if not len(sample):
        return sample
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)):
        nxt = int(far.argmax())
        if far[nxt] == 0:
            break
        chosen.append(nxt)
        far = np.minimum(far, ((sample - sample[nxt]) ** 2).sum(1))
    return sample[chosen]


def exact_scores(left, right):
    """Inner products of the rows of two int64 matrices: int64 where these are exact, else Python integers."""
    import numpy as np

    def most(x) -> int:
        return max(int(x.max(initial=0)), -int(x.min(initial=0)))

    if most(left) * most(right) * max(left.shape[1], 1) < 1 << 53:
        return (left.astype("f8") @ right.astype("f8").T).astype("i8")

    def parts(x):
        mask = (1 << 22) - 1
        return [(p.astype("f8"), shift) for p, shift in ((x & mask, 0), ((x >> 22) & mask, 22), (x >> 44, 44))]

    total = np.zeros((left.shape[0], right.shape[0]), object)
    for start in range(0, left.shape[1], 256):  # 256 products of 44 bits each stay exact
        here = slice(start, start + 256)
        for a, i in parts(left[:, here]):
            for b, j in parts(right[:, here]):
                total += (a @ b.T).astype("i8").astype(object) * (1 << (i + j))
    return total


def search_block(queries, query_ids, query_far, floors, cells, k: int):
    """(query position, candidate position, score) of each query's k best candidates of another id, by bound order.

    queries: int64 rows; query_far: their distances to the pivots; floors: scores that each query's k-th best is known to
    reach, or None; cells: what make_cells() returns.
    """
    import numpy as np

    out_q, out_c, out_s = [], [], []
    if cells is None or not len(queries):
        return out_q, out_c, out_s
    vectors, ids, order, norms, starts, low, high, top, by_pivot, farthest, cell = cells
    q_by_pivot = query_far.astype("f4")
    q_norms = (queries.astype("f8") ** 2).sum(1)
    farthest = max(farthest, query_far.max(initial=0.0))
    small = max(int(np.abs(vectors.astype("f8")).max(initial=0)), 1) * max(int(np.abs(queries.astype("f8")).max(initial=0)), 1) * max(vectors.shape[1], 1) < 1 << 52
    plain = vectors.astype("f8") if small else None
    for i, q in enumerate(queries):
        slack = 1e-6 * (q_norms[i] + top.max()) + 2e-6 * farthest**2 + 1.0
        gap = np.maximum(np.maximum(low - query_far[i], query_far[i] - high), 0).max(1, initial=0.0)
        cell_bound = (q_norms[i] + top - gap**2) / 2 + slack
        reach = floors[i]
        far_reach = -np.inf if reach is None else float(reach)
        live = np.flatnonzero(cell_bound >= far_reach)
        if not len(live):
            continue
        rows = slice(None) if len(live) == len(starts) else np.concatenate([np.arange(s, min(s + cell, len(order))) for s in starts[live]])
        lower = np.abs(by_pivot[:, rows] - q_by_pivot[i][:, None]).max(0, initial=0.0).astype("f8")
        bound = (q_norms[i] + norms[rows] - lower**2) / 2 + slack
        worth = np.flatnonzero(bound >= far_reach)
        by_bound = worth[np.argsort(-bound[worth], kind="stable")]
        place = by_bound if isinstance(rows, slice) else rows[by_bound]
        best: dict[int, tuple[int, int]] = {}
        step, at = 256, 0
        q_plain = q.astype("f8")
        while at < len(place) and bound[by_bound[at]] >= far_reach:
            part = place[at : at + step]
            scores = (plain[part] @ q_plain) if small else exact_scores(vectors[part], q[None, :])[:, 0]
            good = np.arange(len(part)) if reach is None else np.flatnonzero(scores >= reach)
            for p, s in zip(part[good], scores[good], strict=True):
                name = int(ids[p])
                if name != query_ids[i] and (name not in best or best[name][0] < s):
                    best[name] = (int(s), int(p))
            if len(best) > k:
                best = dict(sorted(best.items(), key=lambda x: (-x[1][0], x[0]))[:k])
            if len(best) >= k:
                least = min(v[0] for v in best.values())
                reach = least if reach is None else max(reach, least)
                far_reach = float(reach)
            at, step = at + step, step * 4  # what is left by now is seldom stopped early
        for s, p in best.values():
            out_q.append(i)
            out_c.append(int(order[p]))
            out_s.append(s)
    return out_q, out_c, out_s


def make_cells(vectors, ids, far, cell: int = 512):
    """Candidates sorted by their distance to the first pivot, in slices with bounds of their distances to all; None without any."""
    import numpy as np

    if not len(vectors):
        return None
    order = np.lexsort((ids, far[:, 0] if far.shape[1] else ids))
    vectors, far, ids = vectors[order], far[order], ids[order]
    norms = (vectors.astype("f8") ** 2).sum(1)
    starts = np.arange(0, len(order), cell)
    low, high = np.minimum.reduceat(far, starts), np.maximum.reduceat(far, starts)
    top = np.maximum.reduceat(norms, starts)
    # bounds of single candidates are made in single precision; the slack is far above what that can be off
    return vectors, ids, order, norms, starts, low, high, top, np.ascontiguousarray(far.T, "f4"), far.max(initial=0.0), cell


def exact_topk(candidates: DataFrame, queries: DataFrame, k: int = 5, pivots: int = 32, sample: int = 2048, block: int = 2048, pass_bytes: int = 64 << 20, step_bytes: int = 8 << 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for candidates and queries of (vec_id long, v array<long>).

    The k largest inner products among candidates of another id than the query's; all of them if there are fewer.
    Ties go to the smaller vec_id. Rows with a null id or vector, or a null component, take no part; missing components
    count as zero. Rows that share an id are one candidate (or query) with the best score of any of them. Components
    may be any longs; a score beyond the range of a long is ranked by up to 38 digits and returned as the limit of that range.
    Empty inputs give an empty result; other columns play no part.
    """
    import numpy as np
    import pyarrow as pa

    spark = candidates.sparkSession
    python_workers(spark)

    def clean(df: DataFrame) -> DataFrame:
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<long>").alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL)")

    cands, asked = clean(candidates), clean(queries)
    size, large, n_asked = 0, 0, 0
    for part in (cands, asked):
        r = part.agg(F.max(F.size("v")), F.max(F.array_max("v")), F.min(F.array_min("v")), F.count(F.lit(1))).first()
        size, large, n_asked = max(size, r[0] or 0), max(large, r[1] or 0, -(r[2] or 0)), r[3]
    wide = large**2 * max(size, 1) >= 1 << 63  # scores may leave the range of a long: they are carried as decimals
    schema = f"query_id long, vec_id long, score {'decimal(38,0)' if wide else 'long'}"
    exact_type, most = (pa.decimal128(38, 0), 10**38 - 1) if wide else (pa.int64(), (1 << 63) - 1)
    if not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    size = max(size, 1)
    kept_as = "<i4" if large < 1 << 31 else "<i8"

    def dense(rows) -> np.ndarray:
        out = np.zeros((len(rows), size), "i8")
        for i, v in enumerate(rows):
            out[i, : len(v)] = v
        return out

    drawn = cands.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()  # at most ``sample`` rows
    drawn_ids, drawn_v = np.array([r["vec_id"] for r in drawn], "i8"), dense([r["v"] for r in drawn])
    pivot = choose_pivots(drawn_v.astype("f8"), pivots)

    def distances(v: np.ndarray) -> np.ndarray:
        return np.stack([np.sqrt(((v - p) ** 2).sum(1)) for p in pivot], axis=1) if len(pivot) else np.zeros((len(v), 0))

    def measure(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                v = np.zeros((batch.num_rows, size), "i8")
                lists = batch.column(1)
                lengths = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(batch.num_rows), lengths)
                v[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
                far = distances(v.astype("f8"))
                near = far.argmin(1) if far.shape[1] else np.zeros(len(v), "i8")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([x.tobytes() for x in v.astype(kept_as)], pa.binary()), pa.array([x.tobytes() for x in far.astype("<f8")], pa.binary()), pa.array(near.astype("i4"), pa.int32())],
                    names=["vec_id", "v", "far", "near"],
                )

    measured = cands.mapInArrow(measure, "vec_id long, v binary, far binary, near int")
    pivot_table = materialize(measured.repartitionByRange("near", "vec_id"), "topk-pivots")
    width = len(pivot)

    def matrix(column, kind: str) -> np.ndarray:
        rows = column.to_pylist()
        return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)

    def with_floors(batches):
        """Adds the k-th best score of other ids in the sample, or null if it has fewer."""
        for batch in batches:
            ids, v = batch.column(0).to_numpy(), matrix(batch.column(1), kept_as).astype("i8")
            floors: list = [None] * len(ids)
            for start in range(0, len(ids), 256):
                scores = exact_scores(v[start : start + 256], drawn_v)
                for i, own in enumerate(scores, start):
                    best: dict[int, int] = {}
                    for at in np.argsort(-own, kind="stable"):
                        if drawn_ids[at] != ids[i]:
                            best.setdefault(int(drawn_ids[at]), int(own[at]))
                        if len(best) == k:
                            floors[i] = str(min(best.values()))  # of any size
                            break
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(floors, pa.string())], names=["vec_id", "v", "far", "floor"])

    # a pass searches as many blocks of queries as pass_bytes hold
    per_pass = max(1, pass_bytes // (block * (size + width + 2) * 8))
    spread = asked.repartition(max(1, -(-n_asked // block))).mapInArrow(measure, "vec_id long, v binary, far binary, near int").mapInArrow(with_floors, "vec_id long, v binary, far binary, floor string")
    asked = materialize(spread.withColumn("at", F.monotonically_increasing_id()), "topk-queries")
    number = F.floor((F.col("at") % (1 << 33)) / block) + F.shiftright("at", 33) * (1 << 20)
    blocks = sorted(r[0] for r in asked.select(number.alias("b")).distinct().collect())  # one number for each block of queries
    found = scratch_path(spark, "topk-found")
    for first in range(0, len(blocks), per_pass):
        some = blocks[first : first + per_pass]
        taken: dict[int, list] = {}
        for r in asked.filter(number.isin(some)).select("vec_id", "v", "far", "floor", number.alias("b")).collect():  # at most pass_bytes of queries
            taken.setdefault(r["b"], []).append(r)
        together = [
            (
                np.stack([np.frombuffer(r["v"], kept_as) for r in rows]).astype("i8"),
                np.array([r["vec_id"] for r in rows], "i8"),
                np.stack([np.frombuffer(r["far"], "<f8") for r in rows]),
                [None if r["floor"] is None else int(r["floor"]) for r in rows],
            )
            for rows in taken.values()
        ]
        shared = spark.sparkContext.broadcast(together)

        def search(batches, shared=shared):
            kept = [(q, q_ids, q_far, list(floors), [{} for _ in q_ids]) for q, q_ids, q_far, floors in shared.value]

            def step(rows: list) -> None:
                ids = np.concatenate([b.column(0).to_numpy() for b in rows])
                v = np.concatenate([matrix(b.column(1), kept_as) for b in rows]).astype("i8")
                far = np.concatenate([matrix(b.column(2), "<f8").reshape(b.num_rows, width) for b in rows])
                cells = make_cells(v, ids, far)
                for q, q_ids, q_far, floors, best in kept:
                    touched = set()
                    for i, c, s in zip(*search_block(q, q_ids, q_far, floors, cells, k), strict=True):
                        name = int(ids[c])
                        best[i][name] = max(s, best[i].get(name, s))
                        touched.add(i)
                    for i in touched:
                        if len(best[i]) > k:
                            best[i] = dict(sorted(best[i].items(), key=lambda x: (-x[1], x[0]))[:k])
                        if len(best[i]) == k:
                            least = min(best[i].values())
                            floors[i] = least if floors[i] is None else max(floors[i], least)

            waiting, bytes_held = [], 0
            for batch in batches:
                if batch.num_rows:
                    waiting.append(batch)
                    bytes_held += batch.num_rows * (size + width) * 8
                if bytes_held >= step_bytes:
                    step(waiting)
                    waiting, bytes_held = [], 0
            if waiting:
                step(waiting)
            for _, q_ids, _, _, best in kept:
                rows = [(int(q_ids[i]), name, max(-most, min(most, s))) for i, own in enumerate(best) for name, s in own.items()]
                for start in range(0, len(rows), 65_536):
                    a, c, s = zip(*rows[start : start + 65_536], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(s, exact_type)], names=["query_id", "vec_id", "score"])

        pivot_table.select("vec_id", "v", "far").mapInArrow(search, schema).write.mode("append").parquet(found)
    best = spark.read.schema(schema).parquet(found).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = best.withColumn("rank", rank).filter(F.col("rank") <= k)
    if wide:
        score = F.greatest(F.least(F.col("score"), F.lit((1 << 63) - 1).cast("decimal(38,0)")), F.lit(-(1 << 63)).cast("decimal(38,0)")).cast("long")
        best = best.withColumn("score", score)
    return best.select("query_id", "rank", "vec_id", "score")
