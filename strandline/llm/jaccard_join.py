"""N-gram Jaccard self-join: a MinHash LSH forest finds candidates, exact Jaccard on word shingles verifies them.

1. Sign: words, shingles and minhashes of each text; texts with the same words in the same order become one node.
2. Forest: each tree labels a node with ``depth`` minhashes. The nodes of a tree that share its shortest useful prefix meet
   and are sorted by their labels there, which makes each subtree a sorted prefix trie. From the whole label down, the
   prefix that has to match is shortened, node by node, until the trees together meet a partner with the target recall:
   a partner of a node with few shingles is more similar than the threshold asks, since sets of that size can't be
   just at it, so such a node stops at a longer prefix. A subtree that has become one component is done.
   Nodes meet by their whole minhashes; the rest of a label and the agreement below are told by the last byte of each,
   which can only let more nodes meet.
3. Nodes that so meet are joined if enough of all their minhashes agree, at a margin that a pair at the threshold passes
   nearly always; a joined node is not compared again, so a dense group takes few comparisons. Only edges of a spanning
   star leave a subtree, never its pairs. Their connected components are the candidates.
4. Verify: every pair of a component is compared by the exact Jaccard similarity of its shingle sets, whether or not
   the forest had found that very pair. Links are summed per node; again only spanning stars leave a task.

Groups and components of any size are cut into blocks of bounded rows and bytes, by hash and by size class (two sets
whose sizes differ by more than the threshold allows cannot be similar); each pair of blocks is a task of its own.
The work within one group still grows with the square of the different texts in it, as do its links.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import fresh, materialize, python_workers
from strandline.llm.components import components

#: Nodes of a block (half as many in verification), and bytes of text of a block in verification.
BLOCK_ROWS, BLOCK_BYTES = 512, 2_000_000


def prefix_length(trees: int, depth: int, threshold: float, recall: float) -> int:
    """The longest prefix, from depth down, with which a pair at the threshold meets in some tree with the given recall."""
    for k in range(depth, 0, -1):
        if 1 - (1 - threshold**k) ** trees >= recall:
            return k
    return 1


def least_similarity(n: int, threshold: float) -> float:
    """The least Jaccard similarity at or above the threshold that a set of n elements can have with any other."""
    best = 1.0
    for lost in range(n):
        gained = math.floor((n - lost) / threshold + 1e-9) - n
        if gained < 0:
            break
        best = min(best, (n - lost) / (n + gained))
    return best


def stop_lengths(trees: int, depth: int, threshold: float, recall: float, most: int = 200) -> list[int]:
    """The prefix length at which a node of n shingles stops, for n up to most; the last one also stands for larger ones."""
    lengths = [prefix_length(trees, depth, least_similarity(max(n, 1), threshold), recall) for n in range(most)]
    return [*lengths, prefix_length(trees, depth, threshold, recall)]


def least_agreement(hashes: int, threshold: float, miss: float = 1e-9) -> int:
    """So many of the hashes at least agree for a pair at the threshold, but for a part ``miss`` of such pairs."""
    total, k = 0.0, 0
    while k <= hashes:
        total += math.comb(hashes, k) * threshold**k * (1 - threshold) ** (hashes - k)
        if total > miss:
            return k
        k += 1
    return hashes


def _sign(rows: DataFrame, trees: int, depth: int, k: int, prefix: int) -> DataFrame:
    import pyarrow as pa

    schema = "id long, th long, node binary, n int, size long, sig binary, keys array<long>"

    def run(batches):
        import numpy as np

        from strandline.llm.bpe import rows_of
        from strandline.llm.textvec import mixed, shingle_hashes, slices

        np.seterr(over="ignore")
        draw = np.random.default_rng(20240607)
        mul = draw.integers(0, 2**63, trees * depth, dtype="u8") * np.uint64(2) + np.uint64(1)
        add = draw.integers(0, 2**63, trees * depth, dtype="u8")
        for batch in batches:
            th_all = batch.column(2)
            done = 0
            for ids, texts in rows_of(batch):
                th = th_all.slice(done, len(ids))
                done += len(ids)
                texts = [t or "" for t in texts]
                nodes, counts, sizes, sigs, keys = [], [], [], [], []
                for a, b in slices(texts):
                    h, at = shingle_hashes(texts[a:b], k)
                    n = np.diff(at)
                    some = n > 0
                    first = at[:-1][some]
                    sig = np.zeros((b - a, trees * depth), "<u4")
                    for p in range(trees * depth if len(first) else 0):
                        sig[some, p] = np.minimum.reduceat(((h * mul[p] + add[p]) >> np.uint64(32)).astype("<u4"), first)
                    # the sequence of shingles, 128 bits: sums of hashes that depend on the place within the text
                    place = (np.arange(len(h)) - np.repeat(at[:-1], n)).astype("u8")
                    marks = [np.concatenate([np.zeros(1, "u8"), np.cumsum(mixed(h + place * np.uint64(c)), dtype="u8")]) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
                    prints = np.stack([m[at[1:]] - m[at[:-1]] for m in marks], axis=1).astype("<u8")
                    key = np.full((b - a, trees), np.uint64(0))
                    for t in range(trees):
                        made = np.full(b - a, np.uint64(t + 1))
                        for p in range(prefix):
                            made = mixed(made * np.uint64(0x9FB21C651E98DF25) + sig[:, t * depth + p])
                        key[:, t] = made
                    nodes += [prints[i].tobytes() if some[i] else None for i in range(b - a)]
                    counts += [len(np.unique(h[x:y])) for x, y in zip(at[:-1], at[1:], strict=True)]  # distinct, as in the similarity
                    sizes += [len(t) for t in texts[a:b]]
                    short = sig.astype("u1")  # the last byte: equal minhashes stay equal, and few others become so
                    sigs += [short[i].tobytes() if some[i] else None for i in range(b - a)]
                    keys += [row if ok else None for row, ok in zip(key.view("i8"), some, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), th, pa.array(nodes, pa.binary()), pa.array(counts, pa.int32()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["id", "th", "node", "n", "size", "sig", "keys"],
                )

    return rows.mapInArrow(run, schema)


def _tasks(rows: DataFrame, key: str, threshold: float, block_rows: int, block_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """rows (key, node, n, size, ...) of keys with two nodes or more, as (task, near, place, ...): each pair of nodes of a key meets in exactly one task.

    near is 0 for rows compared with each other and with those of near 1, which are not compared with each other; 2 where a
    task is one block compared within itself. A key within the bounds is one task, in the first table. Others are cut into
    cells by size class, cells into blocks by hash; a block meets itself, the blocks of its cell after it, and those of the
    next cell. These are the second table, if any; the tasks of a cell are numbered, and place deals them out evenly.
    """
    per_key = rows.groupBy(key).agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("bytes")).filter("m > 1")
    per_key = materialize(per_key.select(key, ((F.col("m") <= block_rows) & (F.col("bytes") <= block_bytes)).alias("whole")), "join-keys")
    small = rows.join(per_key.filter("whole").select(key), key)
    small = small.select(*rows.columns, F.xxhash64(F.lit(0), F.col(key)).alias("task"), F.lit(2).alias("near"), F.pmod(F.xxhash64(F.lit(1), F.col(key)), F.lit(1 << 40)).alias("place"))
    large_keys = per_key.filter("NOT whole").select(key)
    if large_keys.isEmpty():
        return small, None
    step = math.log(1 / threshold) * (1 + 1e-9)  # so sizes at the very threshold are at most one cell apart
    large = rows.join(large_keys, key).withColumn("cell", F.floor(F.log(F.col("n")) / F.lit(step)).cast("int"))
    per_cell = large.groupBy(key, "cell").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("bytes"))
    blocks = per_cell.select(key, "cell", F.greatest(F.ceil(F.col("m") / block_rows), F.ceil(F.col("bytes") / block_bytes)).cast("long").alias("blocks"))
    blocks = materialize(blocks, "join-blocks")
    next_cell = blocks.select(key, (F.col("cell") - 1).alias("cell"), F.col("blocks").alias("next_blocks"))
    before = blocks.select(key, (F.col("cell") + 1).alias("cell"), F.col("blocks").alias("last_blocks"))
    plan = materialize(blocks.join(next_cell, [key, "cell"], "left").join(before, [key, "cell"], "left"), "join-plan")
    big = large.join(plan, [key, "cell"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))

    def own_pairs(n: Column) -> Column:
        return F.floor(n * (n + 1) / 2)

    def meet(cell: Column, number: Column, near: int) -> Column:
        """A task by its cell and its number there."""
        return F.struct(F.xxhash64(F.lit("block"), F.col(key), cell, number).alias("task"), F.lit(near).alias("near"), (F.pmod(F.xxhash64(F.col(key), cell), F.lit(1 << 40)) + number).alias("place"))

    def within(a: Column, b: Column) -> Column:
        return a * F.col("blocks") - F.floor(a * (a - 1) / 2) + b - a

    def span(n: Column) -> Column:
        return F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1).cast("long")) - 1), lambda j: j < n)

    c, own, none = F.col("cell"), F.col("block"), F.lit(0).cast("long")
    inside = F.transform(span(F.col("blocks")), lambda j: F.when(j == own, meet(c, within(own, own), 2)).when(own < j, meet(c, within(own, j), 0)).otherwise(meet(c, within(j, own), 1)))
    above = F.transform(span(F.coalesce("next_blocks", none)), lambda j: meet(c, own_pairs(F.col("blocks")) + own * F.col("next_blocks") + j, 0))
    below = F.transform(span(F.coalesce("last_blocks", none)), lambda j: meet(c - 1, own_pairs(F.col("last_blocks")) + j * F.col("blocks") + own, 1))
    big = big.withColumn("meet", F.explode(F.concat(inside, above, below)))
    return small, big.select(*rows.columns, F.col("meet.task").alias("task"), F.col("meet.near").alias("near"), F.col("meet.place").alias("place"))


def _dealt(tasks: tuple[DataFrame, DataFrame | None], finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of all tasks after finish(), each task whole in one partition and sorted by task; blocks of large keys in turn over all partitions."""
    small, big = tasks
    if big is None:
        return finish(small).repartition("task").sortWithinPartitions("task")
    out = finish(small.unionByName(big))  # together, so that what they are joined with is dealt once
    partitions = int(out.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionById(partitions, F.pmod(F.col("place"), F.lit(partitions)).cast("int")).sortWithinPartitions("task")


def _groups(batches: Iterator, most_rows: int = 4096) -> Iterator:
    """Arrow tables of whole runs of equal ``task``; the input is sorted by it. Small runs come several at a time."""
    import numpy as np
    import pyarrow as pa

    held: list = []
    for batch in batches:
        for i in range(0, batch.num_rows, most_rows):
            held.append(batch.slice(i, most_rows))
            part = pa.Table.from_batches(held)
            task = part.column("task").to_numpy()
            last = int(np.searchsorted(task, task[-1]))
            if last:
                yield part.slice(0, last).combine_chunks()
                rest = part.slice(last).combine_chunks()
                held = rest.to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _star(i, j, n: int):
    """Least label of each of n nodes' components over edges (i, j)."""
    import numpy as np

    label = np.arange(n)
    while len(i):
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _runs(task):
    import numpy as np

    at = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
    return at, np.diff(np.concatenate([at, [len(task)]]))


def _joined(labels, sigs, stop, near, agree: int, least: int):
    """A component number for each node of a subtree. labels: of its tree; sigs: of all trees; stop: each node's shortest prefix."""
    import numpy as np

    size, depth = labels.shape
    across = near[0] != 2
    if size <= 32:
        shared = np.cumprod(labels[:, None, :] == labels[None, :, :], axis=2, dtype="u1").sum(2)
        fits = np.triu((sigs[:, None, :] == sigs[None, :, :]).sum(-1) >= agree, 1) & (shared >= np.maximum(stop[:, None], stop[None, :]))
        if across:
            fits &= near[:, None] != near[None, :]
        return _star(*np.nonzero(fits), size)
    order = np.lexsort(labels.T[::-1])  # the sorted prefix trie: a subtree is a run of rows
    shared = np.concatenate([[0], np.cumprod(labels[order[1:]] == labels[order[:-1]], axis=1, dtype="u1").sum(1)])
    component = np.arange(size)
    for length in range(depth, least - 1, -1):
        starts = np.flatnonzero(shared < length)
        ends = np.append(starts[1:], size)
        for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
            left = order[a:b]
            left = left[stop[left] <= length]
            while len(left) > 1:
                own = component[left[0]]
                here = component[left] == own
                front, left = left[here].tolist(), left[~here]
                while front and len(left):  # what is joined is compared with the rest, but not again
                    x = front.pop()
                    hit = (sigs[left] == sigs[x]).sum(1) >= agree
                    if across:
                        hit &= near[left] != near[x]
                    if hit.any():
                        found = np.unique(component[left[hit]])
                        here = np.isin(component[left], found)
                        front += left[here].tolist()
                        left = left[~here]
                        component[np.isin(component, found)] = own
    return component


def _candidate_edges(tasks: tuple[DataFrame, DataFrame | None], signatures: DataFrame, depth: int, agree: int, stops: list[int]) -> DataFrame:
    """Edges (a, b) of spanning stars over pairs that meet in a trie and agree in so many minhashes."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        stop_of = np.array(stops)
        for part in _groups(batches):
            node, task, near = part.column("node").to_pylist(), part.column("task").to_numpy(), part.column("near").to_numpy()
            tree = part.column("tree").to_numpy()
            stop = stop_of[np.minimum(part.column("n").to_numpy(), len(stops) - 1)]
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), "u1").reshape(len(node), -1)
            labels = sig.reshape(len(node), -1, depth)[np.arange(len(node)), tree]
            left, right = [], []
            for start, size in zip(*_runs(task), strict=True):
                own = slice(start, start + size)
                if size == 2:
                    x, y = start, start + 1
                    length = max(stop[x], stop[y])
                    if (near[x] != near[y] or near[x] == 2) and (labels[x, :length] == labels[y, :length]).all() and (sig[x] == sig[y]).sum() >= agree:
                        left.append(node[x])
                        right.append(node[y])
                    continue
                component = _joined(labels[own], sig[own], stop[own], near[own], agree, stops[-1])
                first: dict[int, int] = {}
                for x, c in enumerate(component.tolist()):
                    if first.setdefault(c, x) != x:
                        left.append(node[start + first[c]])
                        right.append(node[start + x])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])

    def with_signatures(df: DataFrame) -> DataFrame:
        return df.drop("size").join(signatures, "node").select("task", "near", "place", "node", "n", "tree", "sig")

    return _dealt(tasks, with_signatures).mapInArrow(run, "a binary, b binary").distinct()


def _verified(dealt: DataFrame, threshold: float, k: int) -> DataFrame:
    """(node, links, other): links from each task, and edges of spanning stars (node, other) over pairs at the threshold or above."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        from strandline.llm.textvec import shingle_hashes

        np.seterr(over="ignore")
        most = 4096

        def shared(sets: list, rows: list[int], cols: list[int]):
            """How many shingles each of rows shares with each of cols."""
            count = np.zeros((len(rows), len(cols)), "f4")
            if len(rows) * len(cols) <= 16:
                for a, i in enumerate(rows):
                    for b, j in enumerate(cols):
                        if i != j:
                            both = np.concatenate([sets[i], sets[j]])
                            both.sort()
                            count[a, b] = (both[1:] == both[:-1]).sum()
                return count
            used = sorted({*rows, *cols})
            which = np.concatenate([np.full(len(sets[i]), i) for i in used])
            _, inverse, df = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
            common = df[inverse] > 1
            which, inverse = which[common], inverse[common]
            _, inverse = np.unique(inverse, return_inverse=True)
            order = np.argsort(inverse, kind="stable")
            which, inverse = which[order], inverse[order]
            row_at, col_at = np.full(len(sets), -1), np.full(len(sets), -1)
            row_at[rows], col_at[cols] = np.arange(len(rows)), np.arange(len(cols))
            top = int(inverse[-1]) + 1 if len(inverse) else 0
            for first in range(0, top, most):
                a, b = np.searchsorted(inverse, [first, first + most])
                w, s = which[a:b], inverse[a:b] - first
                x, y = np.zeros((len(rows), most), "f4"), np.zeros((len(cols), most), "f4")
                own = row_at[w] >= 0
                x[row_at[w[own]], s[own]] = 1
                own = col_at[w] >= 0
                y[col_at[w[own]], s[own]] = 1
                count += x @ y.T
            return count

        for part in _groups(batches, 256):
            node, task, near = part.column("node").to_pylist(), part.column("task").to_numpy(), part.column("near").to_numpy()
            copies = part.column("copies").to_numpy()
            out: tuple[list, list, list] = ([], [], [])
            for start, size in zip(*_runs(task), strict=True):
                own, seen = [], set()
                for x in range(start, start + size):  # a repeated row of a representative comes more than once
                    if node[x] not in seen:
                        seen.add(node[x])
                        own.append(x)
                h, at = shingle_hashes([t or "" for t in part.column("text").slice(start, size).to_pylist()], k)
                sets = [np.unique(h[at[x - start] : at[x - start + 1]]) for x in own]
                n, w, m = np.array([len(s) for s in sets]), copies[own], near[own]
                if m[0] == 2:
                    rows = cols = list(range(len(own)))
                else:
                    rows, cols = np.flatnonzero(m == 0).tolist(), np.flatnonzero(m == 1).tolist()
                if not rows or not cols:
                    continue
                both = shared(sets, rows, cols).astype("f8")
                fits = both >= threshold * (n[rows][:, None] + n[cols][None, :] - both) - 1e-9
                if m[0] == 2:
                    np.fill_diagonal(fits, False)
                links = np.zeros(len(own), "i8")
                links[rows] += fits @ w[cols]
                if m[0] != 2:
                    links[cols] += fits.T @ w[rows]
                i, j = np.nonzero(fits)
                label = _star(np.array(rows)[i], np.array(cols)[j], len(own))
                for x in np.flatnonzero(links):
                    out[0].append(node[own[x]])
                    out[1].append(int(links[x]))
                    out[2].append(node[own[label[x]]])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["node", "links", "other"])

    return dealt.mapInArrow(run, "node binary, links long, other binary")


def _judged(docs: DataFrame, id_col: str, text_col: str, threshold: float, words: int, trees: int, depth: int, recall: float, block_rows: int, block_bytes: int) -> DataFrame:
    """id, th (hash of the text), class_id, class_th (of the row that stands for the class), n_links, class_size for each row of docs."""
    python_workers(docs.sparkSession)
    prefix = prefix_length(trees, depth, threshold, recall)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    signed = materialize(_sign(rows, trees, depth, words, prefix), "join-signed")

    first = F.struct(F.col("id").isNull().alias("unnamed"), "id", "th")
    nodes = signed.filter("node IS NOT NULL").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min(first).alias("rep"))
    nodes = materialize(nodes.select("node", "copies", F.col("rep.id").alias("rep"), F.col("rep.th").alias("rep_th")), "join-nodes")
    of_rep = F.col("id").eqNullSafe(F.col("rep")) & (F.col("th") == F.col("rep_th"))
    own = signed.join(nodes.select("node", "rep", "rep_th"), "node").filter(of_rep).dropDuplicates(["node"]).select("node", "n", "size", "sig", "keys")
    own = materialize(own, "join-own")

    groups = own.select("node", "n", F.lit(0).cast("long").alias("size"), F.posexplode("keys").alias("tree", "key"))
    stops = stop_lengths(trees, depth, threshold, recall)
    tasks = _tasks(groups, "key", threshold, block_rows, block_bytes)
    candidates = components(_candidate_edges(tasks, own.select("node", "sig"), depth, least_agreement(trees * depth, threshold), stops))

    members = candidates.join(own.select("node", "n", "size"), "node").join(nodes, "node")
    # here all pairs are compared: smaller blocks are dealt more evenly
    tasks = _tasks(members.withColumnRenamed("root", "key"), "key", threshold, -(-block_rows // 2), block_bytes)
    same_row = F.col("rep").eqNullSafe(F.col("id")) & (F.col("rep_th") == F.col("th"))
    dealt = _dealt(tasks, lambda df: df.join(rows, same_row).select("task", "near", "place", "node", "copies", "text"))
    found = materialize(_verified(dealt, threshold, words), "join-links")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    per_node = nodes.join(links, "node", "left").join(classes, "node", "left")
    per_node = per_node.select("node", "copies", "rep", "rep_th", F.coalesce("links", F.lit(0).cast("long")).alias("links"), F.coalesce("root", "node").alias("root"))
    per_node = materialize(per_node, "join-classes")
    least = F.struct(F.col("rep").isNull().alias("unnamed"), F.col("rep").alias("id"), F.col("rep_th").alias("th"))
    per_class = per_node.groupBy("root").agg(F.min(least).alias("least"), F.sum("copies").alias("class_size"))
    per_class = per_class.select("root", F.col("least.id").alias("class_id"), F.col("least.th").alias("class_th"), "class_size")
    judged = materialize(per_node.join(per_class, "root"), "join-judged")
    linked = signed.filter("node IS NOT NULL").select("id", "th", "node").join(judged, "node")
    linked = linked.select("id", "th", "class_id", "class_th", (F.col("links") + F.col("copies") - 1).alias("n_links"), "class_size")
    alone = signed.filter("node IS NULL").select("id", "th", F.col("id").alias("class_id"), F.col("th").alias("class_th"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("class_size"))
    return linked.unionByName(alone)


def jaccard_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.8,
    words: int = 5,
    trees: int = 16,
    depth: int = 6,
    recall: float = 0.999,
    block_rows: int = BLOCK_ROWS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row for each row of docs: id, class_id, n_links, class_size.

    Two rows are linked if the Jaccard similarity of their sets of shingles of five words is at least the threshold. A
    text of 1 to 4 words has one shingle, all its words. Words are as in textvec. n_links counts the other rows linked
    with a row, copies included; class_id is the least id among the rows that links connect; class_size their number.
    Rows without words (null and empty texts among them) are linked with nothing and are classes of their own; the
    class_id of a class is null only if all its ids are. Repeated rows are copies of each other. An empty table gives
    an empty result; other columns play no part. The forest may miss a link with a chance of 1 - recall at the
    threshold and far less above it; what it reports is exact.
    """
    judged = _judged(docs, id_col, text_col, threshold, words, trees, depth, recall, block_rows, block_bytes)
    return judged.select(F.col("id").alias(id_col), "class_id", "n_links", "class_size")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """docs with one row of each class, the one of the least id, with all columns; of rows that repeat id and text one stays."""
    judged = materialize(_judged(docs, id_col, text_col, threshold, 5, 16, 6, 0.999, BLOCK_ROWS, BLOCK_BYTES), "join-rows")
    th, kept_id, kept_th = fresh(docs, "th", "kept_id", "kept_th")
    stays = judged.filter(F.col("id").eqNullSafe(F.col("class_id")) & (F.col("th") == F.col("class_th"))).select(F.col("id").alias(kept_id), F.col("th").alias(kept_th))
    out = docs.withColumn(th, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    out = out.join(stays, F.col(id_col).cast("long").eqNullSafe(F.col(kept_id)) & (F.col(th) == F.col(kept_th)), "left_semi")
    if not stays.groupBy(kept_id, kept_th).count().filter("count > 1").isEmpty():
        out = out.dropDuplicates([id_col, th])
    return out.drop(th)
