"""MinHash near-duplicates by an LSH forest.

A document is the set of its word shingles; equal sets form one class (told by a
64-bit hash of the set). The MinHash signature of a class is read from TREES
starting places, which gives as many sorted orders. Each order is sorted by
ranges; neighbours are the classes whose longest common prefix has DEPTH values
or more. A region of up to BLOCK neighbours is compared at that depth by
sketches; a larger one is read deeper, as deep as it takes to have BLOCK classes
or fewer. Candidates that are similar enough by their sketches are connected,
and connected classes form a region of the exact comparison; all classes of a
crowded prefix are in one region together, so that what its depth left apart is
not lost.

Regions of up to CHUNK classes are compared whole, on the full sets. In larger
ones, runs of neighbours in a few orders are linked first. What is left is a
join with a prefix filter: of each class the rarest shingles of its region are
taken, as many as two sets above the threshold can't both miss; classes of
different components that share one of these, and are similar enough by their
sketches, meet in a tile of at most two chunks and are compared there on the
full sets. So no task holds more than two chunks, no link is lost to a cap, and
texts that have only common shingles in common are not compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import fresh, map_texts, materialise, slices, small, small_batches, text_batches
from .components import connected_components

VALUES, TREES = 128, 16
#: Values that neighbours of an order have in common at least, and at which reading deeper ends.
DEPTH, DEEPEST = 4, 32
#: Values by which a region that is not crowded is sorted.
SHALLOW = 8
#: Most classes of a region of an order that are compared at its depth.
BLOCK = 1024
#: Of exact comparison at once: classes, and shingles in all.
CHUNK, CHUNK_SHINGLES = 512, 2_000_000
#: Columns of the exact comparison at a time.
COLUMNS = 1024
#: Orders in which runs of a large region are compared before the tiles.
RUNS = 2
#: Standard deviations of the sketch that a candidate may be below the threshold.
SLACK = 4.5

#: Columns of a sketch.
MINIS = [f"m{i}" for i in range(VALUES // 32)]

_U = np.uint64
_A = np.random.default_rng(20240229).integers(0, 1 << 63, VALUES, dtype=np.uint64) * _U(2) + _U(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; with fewer words, the whole sequence as one; without words, empty."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(k, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def class_of(raw: bytes) -> int:
    """A signed 64-bit hash of a set."""
    h = xxhash.xxh3_64_intdigest(raw)
    return h - (1 << 64) if h >> 63 else h


def signature(shingles: np.ndarray) -> np.ndarray:
    """VALUES 16-bit hashes of minima."""
    low = np.full(VALUES, (1 << 32) - 1, np.uint64)
    x = _mix(shingles)
    for i in range(0, len(x), 2048):
        low = np.minimum(low, ((x[i : i + 2048, None] * _A) >> _U(32)).min(0))
    return ((_mix(low + _U(1)) >> _U(20)) & _U(0xFFFF)).astype("<u2")


def sketch(values: np.ndarray) -> np.ndarray:
    """Two bits of each value, in VALUES / 32 words."""
    two = (values & 3).astype(np.uint64).reshape(-1, 32)
    return np.bitwise_or.reduce(two << (np.arange(32, dtype=np.uint64) * _U(2)), 1)


def _signed(texts: list[bytes], k: int) -> dict:
    out: dict[str, list] = {c: [] for c in ("n_shingles", "node", "sig", *MINIS)}
    for text in texts:
        s = shingle_set(text, k)
        v = signature(s)
        row = [len(s), class_of(s.tobytes()), np.concatenate((v, v[:DEEPEST])).tobytes(), *sketch(v).astype(np.int64).tolist()]
        for c, x in zip(out.values(), row, strict=True):
            c.append(x)
    return out


def _uncertain(percent: int) -> float:
    """Least share of equal sketch values of a candidate."""
    p = (1 + 3 * percent / 100) / 4
    return p - SLACK * (p * (1 - p) / VALUES) ** 0.5


def _stars(node: np.ndarray, near: np.ndarray):
    """Edges from each row of a symmetric boolean matrix to the first row of its component."""
    root = np.full(len(near), -1)
    for i in range(len(near)):
        if root[i] < 0:
            root[i], todo = i, [i]
            while todo:
                new = np.flatnonzero(near[todo.pop()] & (root < 0))
                root[new] = i
                todo += new.tolist()
    far = root != np.arange(len(root))
    return node[far], node[root[far]]


def _alike(mini: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Boolean matrix of the pairs whose sketches and sizes allow a link."""
    least, near = int(np.ceil(_uncertain(percent) * VALUES)), np.zeros((len(n), len(n)), bool)
    for i in range(0, len(n), 256):
        x = mini[i : i + 256, None] ^ mini[None]
        differ = np.bitwise_count((x | (x >> _U(1))) & _U(0x5555555555555555)).sum(2)
        near[i : i + 256] = VALUES - differ >= least
    return near & (100 * np.minimum(n[:, None], n) >= percent * np.maximum(n[:, None], n))


def _minis(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(m).to_numpy() for m in MINIS], 1).view(np.uint64)


def _runs(batches, cut, most: int | None = None):
    """Tables of rows and the starts of their runs, by ``cut`` (table -> places where a run starts, but for 0); the last run waits for more rows, unless it has over ``most``."""
    held: pa.Table | None = None
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            held = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
            start = np.concatenate(([0], cut(held)))
            if held.num_rows - start[-1] > (most or held.num_rows):
                yield held, start
                held = None
            elif len(start) > 1:
                yield held.slice(0, start[-1]), start[:-1]
                held = held.slice(start[-1])
    if held is not None and held.num_rows:
        yield held, np.concatenate(([0], cut(held)))


def _common(table: pa.Table) -> np.ndarray:
    """Of each row but the first, the length of the prefix that its order and that of the row before have in common, in values; 0 between two orders."""
    raw, tree = table.column("order").to_pylist(), table.column("tree").to_numpy()
    values = np.frombuffer(b"".join(raw), np.uint16).reshape(len(raw), -1)
    same = (values[1:] == values[:-1]) & (tree[1:] == tree[:-1])[:, None]
    return np.where(same.all(1), values.shape[1], same.argmin(1)) if len(raw) > 1 else np.zeros(0, np.int64)


def _neighbours(batches, percent: int, block: int):
    """Edges that connect the candidates of rows sorted by order: regions of a common prefix, as deep as it takes to have ``block`` rows."""
    for table, _ in _runs(batches, lambda t: np.flatnonzero(_common(t) < DEPTH) + 1, 16 * block):
        common, node, n, mini = _common(table), table.column("node").to_numpy(), table.column("n").to_numpy(), _minis(table)
        a, b = [], []

        def regions(start: int, end: int, depth: int):
            cut = start + 1 + np.flatnonzero(common[start : end - 1] < depth)
            for s, e in zip([start, *cut], [*cut, end], strict=True):
                if 1 < e - s <= block:
                    x, y = _stars(node[s:e], _alike(mini[s:e], n[s:e], percent))
                    a.append(x)
                    b.append(y)
                elif e - s > block and depth < DEEPEST:
                    regions(s, e, depth + 1)  # noqa: B023
                elif e - s > block:  # as many equal values in a row: candidates by all means
                    a.append(node[s + 1 : e])
                    b.append(np.full(e - s - 1, node[s]))

        regions(0, table.num_rows, DEPTH)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64)) for x in (a, b)], names=["a", "b"])


def candidate_edges(classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): edges that connect classes which the forest makes candidates, and all classes of a crowded prefix.

    Orders are cut into ranges of whole prefixes of DEPTH values, so that no
    region lies in two tasks; crowded prefixes, which could fill a task, are cut
    anywhere.
    """
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = lambda n: F.expr(f"substring(sig, tree * {2 * VALUES // TREES} + 1, {2 * n})")
    rows = classes.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))).withColumn("head", order(DEPTH))
    hot = materialise(rows.groupBy("tree", "head").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("hub")).where(F.col("size") > BLOCK).select("tree", "head", "hub"), "crowded")
    step, out = partial(_neighbours, percent=percent, block=BLOCK), "a long, b long"

    def sorted_by(df: DataFrame, values: int, *by: str) -> DataFrame:
        slim = df.select("tree", "head", order(values).alias("order"), "node", "n", *MINIS)
        return slim.repartitionByRange(parts, "tree", *by).sortWithinPartitions("tree", "order").drop("head")

    if hot.isEmpty():
        return sorted_by(rows, SHALLOW, "head").mapInArrow(step, out).distinct()
    side = F.broadcast(hot) if small(hot) else hot
    calm = sorted_by(rows.join(side, ["tree", "head"], "left_anti"), SHALLOW, "head").mapInArrow(step, out)
    deep = sorted_by(rows.join(side, ["tree", "head"], "left_semi"), DEEPEST, "order", "node").mapInArrow(step, out)
    hubs = rows.join(side, ["tree", "head"]).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    return calm.unionByName(deep).unionByName(hubs).distinct()


def exact_links(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Boolean matrix of the pairs with 100 * intersection >= percent * union.

    Shingles that occur in the same sets count as one column with a weight, so
    that copies of one text need few columns.
    """
    m = len(sets)
    size = np.array(list(map(len, sets)), np.int64)
    row = np.repeat(np.arange(m), size)
    all_ = np.concatenate(sets) if m else np.zeros(0, np.uint64)
    order = np.argsort(all_, kind="stable")
    value, row = all_[order], row[order]
    first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))) if len(value) else np.zeros(0, np.int64)
    df = np.diff(np.append(first, len(value)))
    mark = _mix(np.arange(1, m + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
    pattern = np.add.reduceat(mark[row], first) if len(first) else np.zeros(0, np.uint64)
    keep = df > 1
    _, one, weight = np.unique(pattern[keep], return_index=True, return_counts=True)
    first, df = first[keep][one], df[keep][one]
    both = np.zeros((m, m), np.float64)
    for i in range(0, len(first), COLUMNS):
        n = df[i : i + COLUMNS]
        col = np.repeat(np.arange(len(n)), n)
        at = np.repeat(first[i : i + COLUMNS] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        x = np.zeros((m, len(n)), np.float64)
        x[row[at], col] = 1
        both += (x * weight[i : i + COLUMNS]) @ x.T
    return (100 * both >= percent * (size[:, None] + size - both)) & (size[:, None] > 0) & (size > 0)


def _groups(batches, by: str, chunk: int | None):
    """Rows of runs of equal ``by``; with ``chunk``, runs end at that many rows or CHUNK_SHINGLES as well."""
    now, key, total = [], None, 0
    for batch in slices(batches):
        cols = batch.to_pydict()
        for i, k in enumerate(cols[by]):
            if now and (k != key or chunk and (len(now) >= chunk or total >= CHUNK_SHINGLES)):
                yield now
                now, total = [], 0
            key = k
            now.append({c: v[i] for c, v in cols.items()})
            total += len(now[-1]["set"]) // 8
    if now:
        yield now


def _compared(batches, by: str, percent: int, chunk: int | None = None):
    for rows in _groups(batches, by, chunk):
        rows = list({r["node"]: r for r in rows}.values())
        if len(rows) > 1:
            node = np.array([r["node"] for r in rows], np.int64)
            a, b = _stars(node, exact_links([np.frombuffer(r["set"], np.uint64) for r in rows], percent))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _sets(batches, k: int):
    for batch, texts in text_batches(batches):
        raw = [shingle_set(t, k).tobytes() for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(map(class_of, raw), pa.int64()), pa.array(raw, pa.binary())], names=["node", "set"])


def _in_runs(large: DataFrame, percent: int) -> DataFrame:
    """Links of large regions that neighbours in RUNS orders have."""
    parts = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = None
    for tree in range(RUNS):
        at = 2 * VALUES // TREES * tree * (TREES // RUNS) + 1
        order = ["region", F.expr(f"substring(sig, {at}, {2 * DEEPEST})")]
        run = large.repartitionByRange(parts, *order, "node").sortWithinPartitions(*order, "node").select("region", "node", "set")
        links = run.mapInArrow(partial(_compared, by="region", percent=percent, chunk=CHUNK), "a long, b long")
        out = links if out is None else out.unionByName(links)
    return out


def _tiled(rows: DataFrame, parts: DataFrame, size: int) -> DataFrame:
    """(tile, node, component, short) in tiles of about twice ``size`` rows, for each key of ``rows`` (key, node, short).

    In some tile each node meets all others of its key that may be linked with
    it and are not yet by ``parts``: one of the two is ``short``, and not both
    are in the key's largest component. Keys without such a pair have no tile.
    """
    known = materialise(rows.join(parts, "node", "left").select("key", "node", "short", F.coalesce("component", "node").alias("component")), "known")
    top = known.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size")).groupBy("key").agg(F.max(F.struct("size", "component")).alias("top"))
    kind = F.when(F.col("component") == F.col("top.component"), F.when(F.col("short"), 1).otherwise(3)).otherwise(F.when(F.col("short"), 0).otherwise(2))
    each = known.join(top, "key").select("key", "node", "component", "short", kind.alias("kind"))
    chunks = lambda k: F.ceil(F.count_if(F.col("kind") == k) / size)
    sizes = each.groupBy("key").agg(*(chunks(k).alias(f"c{k}") for k in range(4))).where("c0 > 0 or (c1 > 0 and c2 > 0)")
    # cells of a key: short rest, short core, other rest, other core, each cut into chunks
    ends = [F.lit(0).cast("long"), F.col("c0"), F.col("c0") + F.col("c1"), F.col("c0") + F.col("c1") + F.col("c2"), F.col("c0") + F.col("c1") + F.col("c2") + F.col("c3")]
    of = lambda x: F.when(F.col("kind") == 0, x[0]).when(F.col("kind") == 1, x[1]).when(F.col("kind") == 2, x[2]).otherwise(x[3])
    cells = lambda i, j: F.when(ends[j] > ends[i], F.sequence(ends[i], ends[j] - 1)).otherwise(F.array().cast("array<long>"))
    own = of(ends) + F.pmod(F.xxhash64("node"), of([F.col(f"c{k}") for k in range(4)]))
    meets = of([cells(0, 4), F.concat(cells(0, 1), cells(2, 3)), cells(0, 2), cells(0, 1)])
    at = each.join(sizes, "key").select("key", "node", "component", "short", own.alias("own"), F.explode(meets).alias("other"))
    return at.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("tile"), "node", "component", "short")


def _shingles(batches):
    """One row per shingle of a set."""
    for batch in slices(batches):
        raw = batch.column("set").to_pylist()
        n = np.array([len(x) // 8 for x in raw], np.int64)
        at = pa.array(np.repeat(np.arange(len(raw)), n))
        yield pa.RecordBatch.from_arrays([batch.column("region").take(at), batch.column("node").take(at), pa.array(np.repeat(n, n), pa.int64()), pa.array(np.frombuffer(b"".join(raw), np.int64))], names=["region", "node", "size", "x"])


def _meetings(batches, percent: int):
    """Of rows sorted by tile: (meet, node) where pairs of different components that may be linked shall be compared exactly."""
    for table, start in _runs(batches, lambda t: np.flatnonzero(np.diff(t.column("tile").to_numpy())) + 1):
        cols = {c: table.column(c).to_numpy() for c in ("node", "n", "component", "region", "place", "short")}
        mini, found = _minis(table), [np.zeros((0, 4), np.int64)]
        for s, e in zip(start, [*start[1:], table.num_rows], strict=True):
            node, part, place, n, short = (cols[c][s:e] for c in ("node", "component", "place", "n", "short"))
            first = short[:, None] & (n[:, None] <= n)
            near = (first | first.T) & (part[:, None] != part)
            if not near.any():
                continue
            near &= _alike(mini[s:e], n, percent)
            order = np.argsort(place, kind="stable")
            first = np.flatnonzero(np.diff(place[order], prepend=-1))
            x, y = np.nonzero(np.logical_or.reduceat(near[:, order], first, axis=1))  # rows and places that a partner has
            if len(x):
                mine, other = place[x], place[order[first]][y]
                found.append(np.stack((cols["region"][s:e][x], np.minimum(mine, other), np.maximum(mine, other), node[x]), 1))
        out = np.unique(np.concatenate(found), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(out[:, i]) for i in range(4)], names=["region", "i", "j", "node"])


def _by_prefix(large: DataFrame, runs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links of large regions between the components that ``runs`` leave.

    With the shingles of a region in order of how many of its classes have them,
    two sets above the threshold have one in common that is among the first
    n - ceil(2 n percent / (100 + percent)) + 1 of the smaller set (``short``)
    and among the first n - ceil(n percent / 100) + 1 of the larger. Shingles of
    one class alone take places in that order but no part in the join, so texts
    of one frame are not compared unless the frame alone makes them similar.
    """
    spark = large.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = materialise(connected_components(runs), "linked")
    at = large.select("region", "node").join(known, "node", "left").select("region", "node", F.coalesce("component", "node").alias("component"))
    open_ = at.groupBy("region").agg(F.count(F.lit(1)).alias("classes"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    open_ = materialise(open_.select("region", F.ceil(F.col("classes") / CHUNK).alias("places")), "open")
    if open_.isEmpty():
        return runs.limit(0)
    side = F.broadcast(open_) if small(open_) else open_
    each = materialise(large.join(side, "region", "left_semi").select("region", "node", "set").mapInArrow(_shingles, "region long, node long, size long, x long"), "shingles")
    shared = each.groupBy("region", "x").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = W.partitionBy("node")
    ranked = each.join(shared, ["region", "x"]).withColumn("rank", F.row_number().over(own.orderBy("df", "x"))).withColumn("shared", F.count(F.lit(1)).over(own))
    place = F.col("size") - F.col("shared") + F.col("rank")  # those of one class alone come first
    long_, short = (F.col("size") - F.ceil(F.col("size") * a / b) + 1 for a, b in ((percent, 100), (2 * percent, 100 + percent)))
    keys = materialise(ranked.where(place <= long_).select(F.xxhash64("region", "x").alias("key"), "node", (place <= short).alias("short")), "prefixes")
    tiles = _tiled(keys, known, BLOCK)
    place = F.pmod(F.xxhash64("node"), F.col("places")).alias("place")
    about = classes.select("node", "n", *MINIS).join(large.select("region", "node"), "node").join(side, "region").select("region", "node", "n", place, *MINIS)
    rows = tiles.join(about, "node").repartition(parts, "tile").sortWithinPartitions("tile")
    meet = rows.mapInArrow(partial(_meetings, percent=percent), "region long, i long, j long, node long").distinct()
    met = materialise(meet.select(F.xxhash64("region", "i", "j").alias("meet"), "node"), "meetings").join(large.select("node", "set"), "node")
    return met.repartition(parts, "meet").sortWithinPartitions("meet", "node").select("meet", "node", "set").mapInArrow(partial(_compared, by="meet", percent=percent), "a long, b long")


def near_classes(docs: DataFrame, *, id_col: str, text_col: str, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, n_shingles, node) and the components (node, component) of linked classes."""
    slim = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    signed = materialise(map_texts(slim, partial(_signed, k=k), f"doc_id {kind}, n_shingles long, node long, sig binary, {', '.join(f'{m} long' for m in MINIS)}", keep=["doc_id"]), "signatures")
    known = signed.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), *(F.first(c).alias(c) for c in ("sig", *MINIS)))
    classes = materialise(known, "classes")
    regions = materialise(connected_components(candidate_edges(classes, percent)).select("node", F.col("component").alias("region")), "regions")
    wanted = classes.join(regions, "node").select("node", "region", "sig", F.col("doc_id").alias("rep"))
    ids = materialise(wanted.select("rep").distinct(), "wanted")
    side = F.broadcast(ids) if small(ids, text="rep" if kind == "string" else None) else ids
    sets = slim.join(side, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select("text").mapInArrow(partial(_sets, k=k), "node long, set binary")
    sets = materialise(sets.join(wanted.drop("rep"), "node"), "sets")
    sizes = sets.groupBy("region").agg((F.count(F.lit(1)) > CHUNK).alias("big"), (F.sum(F.octet_length("set")) > 8 * CHUNK_SHINGLES).alias("long"))
    crowded = materialise(sizes.where("big or long").select("region"), "crowded")
    side = F.broadcast(crowded) if small(crowded) else crowded
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = sets.join(side, "region", "left_anti").select("region", "node", "set")
    links = few.repartition(parts, "region").sortWithinPartitions("region", "node").mapInArrow(partial(_compared, by="region", percent=percent), "a long, b long")
    if not crowded.isEmpty():
        large = materialise(sets.join(side, "region", "left_semi"), "large")
        runs = materialise(_in_runs(large, percent), "runs")
        links = links.unionByName(runs).unionByName(_by_prefix(large, runs, classes, percent))
    return signed, connected_components(links)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of each row of ``docs``.

    Documents are linked if their sets of ``k``-word shingles have a Jaccard
    similarity of ``percent`` / 100 or more; ``component_id`` is the smallest
    ``doc_id`` that links reach, and ``kept`` says whether it is the document's own.
    Null and texts without words have an empty set and no links. Rows with a null
    id take part; a component of such rows alone has a null id, and its rows
    count as kept. Repeated rows share a component and a verdict.
    """
    signed, parts = near_classes(docs, id_col=id_col, text_col=text_col, k=k, percent=percent)
    own = signed.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    labelled = own.join(parts, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    tops = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = labelled.join(tops, "component").select(F.col("node").alias("own_node"), "component_id")
    rows = signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node"))
    found = rows.where("node is not null").join(by_node, F.col("node") == F.col("own_node")).select("doc_id", "n_shingles", "component_id")
    lone = rows.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(lone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, all columns, with one row of each group of near-duplicates.

    It is a row with the smallest id of its group; where several rows have that
    id and are in the group (repeated rows), one of them. Texts without words all
    stay. Rows are told by id and a hash of the text; only the hashes are
    shuffled while the list of rows to drop is small by check.
    """
    full = F.coalesce(F.col(text_col), F.lit(""))
    tag = F.struct(F.col(id_col).alias("id"), F.xxhash64(full).alias("t1"), F.xxhash64(F.lit(1), full).alias("t2"))
    names = fresh(docs, "drop_id", "drop_t1", "drop_t2", "drop_times")
    same = F.xxhash64(full)
    tagged = docs.select(tag.alias("tag"), F.col(text_col).alias("text"))
    marked = near_duplicates(tagged, id_col="tag", k=k, percent=percent).where("n_shingles > 0")
    times = marked.groupBy(F.col("doc_id").alias("tag"), "kept").agg(F.count(F.lit(1)).alias("times"))
    gone = times.where("not kept or times > 1").select(F.col("tag.id").alias(names[0]), F.col("tag.t1").alias(names[1]), F.col("tag.t2").alias(names[2]), F.when(F.col("kept"), F.col("times")).otherwise(0).alias(names[3]))
    gone = materialise(gone, "gone")
    side = F.broadcast(gone) if small(gone) else gone
    hit = F.col(id_col).eqNullSafe(F.col(names[0])) & (same == F.col(names[1])) & (F.xxhash64(F.lit(1), full) == F.col(names[2]))
    stay = docs.join(side, hit, "left_anti")
    again = gone.where(F.col(names[3]) > 1)
    if again.isEmpty():
        return stay
    once = docs.join(F.broadcast(again) if small(again) else again, hit).dropDuplicates(names[:3]).select(*docs.columns)
    return stay.unionByName(once)
