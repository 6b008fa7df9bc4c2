"""Hard-negative mining over Hilbert-ordered vector blocks with zone maps.

Candidate vectors are ordered along a Hilbert curve within their label and
written to the shared folder as blocks of up to ``BLOCK_ROWS`` rows, one
Parquet row per block with the least and largest value of every dimension (its
zone map).  Interval arithmetic on a zone map bounds the inner products that an
anchor can have with the block's rows.  For each anchor's window of scores the
zone maps of whole groups of blocks choose the groups it is sent to, and inside a group
only blocks whose bounds still reach the window, narrowed by the scores found
so far, are unpacked and multiplied.

Two searches run: the best rows of the anchor's own label (its positives),
then, for the windows these give, the best rows of all other labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from rollcall.llm.common import schema_of, stored

SCALE = 256
K = 5                       # positives of an anchor, negatives of a window
BLOCK_ROWS = 512
GROUP_ROWS = 1 << 18        # rows of a group of blocks, about
ANCHORS = 1 << 18           # anchors sent to a group in one tile, about
CHUNK = 1 << 12             # anchors of a tile that are worked on together
ZONES = 4096                # groups whose zone maps meet a tile of anchors together, about
CURVE_DIMS, CURVE_BITS = 16, 4
PENDING = 1 << 18           # found rows that are thinned out together
_EXACT = 2.0 ** 52          # doubles hold whole numbers up to here
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max

_BLOCKS = ("grp long, block int, dim int, label long, n int, ids binary, vectors binary, lo binary, hi binary")
_FOUND = "anchor long, win int, id long, score long"
_ANCHORS = "anchor long, anchor_id long, label long, dim int, vec binary"


def pack(x: np.ndarray) -> bytes:
    """Whole numbers in two bytes each if they fit, else in eight."""
    return x.astype("<i2" if not x.size or (x.min() >= -32768 and x.max() < 32768) else "<i8").tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<i2" if len(data) == 2 * n else "<i8").astype(np.int64)


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of each row of cell numbers (0 to 2**bits - 1 per dimension) on the Hilbert curve.

    Every level of the curve reflects and exchanges the axes of the level below it; undone from the
    top level down, the bits of all axes, taken level by level in Gray code, are the position.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = np.int64(1 << level), np.int64((1 << level) - 1)
        for axis in range(dims):
            on = (x[axis] & bit) != 0
            x[0] = np.where(on, x[0] ^ low, x[0])
            swap = np.where(on, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= swap
            x[axis] ^= swap
    for axis in range(1, dims):
        x[axis] ^= x[axis - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        flip = np.where((x[-1] & (1 << level)) != 0, flip ^ ((1 << level) - 1), flip)
    x ^= flip
    key = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for axis in range(dims):
            key = (key << np.uint64(1)) | ((x[axis] >> level) & 1).astype(np.uint64)
    return key


def prepared(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label, vec (whole numbers) of the rows that take part, labels shifted where the id is divisible by 7."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    label = F.col(label_col).cast("long")
    label = F.when(F.col(id_col) % 7 == 0, F.pmod(label + 1, F.lit(10))).otherwise(label)
    return (rows.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & fine)
            .select(F.col(id_col).cast("long").alias("id"), label.alias("label"),
                    F.transform(x, lambda v: F.floor(v * SCALE)).alias("vec")))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a batch with (id, label, vec) by the length of their vectors."""
    dims = pc.list_value_length(batch.column("vec")).to_numpy(zero_copy_only=False)
    for dim in np.unique(dims):
        yield int(dim), batch.take(pa.array(np.flatnonzero(dims == dim)))


def spreads(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Mean and standard deviation per dimension, for each length of vectors (tasks return sums)."""
    schema = schema_of("dim int, axis int, n long, s double, q double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for dim, part in _by_dim(batch):
                x = _matrix(part.column("vec"), dim).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(
                    (np.full(dim, dim), np.arange(dim), np.full(dim, len(x)), x.sum(axis=0), (x * x).sum(axis=0)), arrow)], schema=arrow)

    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    sums = rows.mapInArrow(run, schema).groupBy("dim", "axis").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    curves = (sums.withColumn("mean", F.col("s") / F.col("n"))
              .withColumn("dev", F.sqrt(F.greatest(F.col("q") / F.col("n") - F.col("mean") * F.col("mean"), F.lit(0.0))))
              .withColumn("at", F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("dev"), "axis")))
              .filter(F.col("at") <= CURVE_DIMS).orderBy("dim", "axis"))   # the widest dimensions
    for r in curves.collect():
        out.setdefault(r["dim"], []).append((r["axis"], r["mean"], r["dev"] or 1.0))
    return {d: tuple(np.array(c) for c in zip(*v)) for d, v in out.items()}


def on_curve(rows: DataFrame, curves: dict[int, tuple]) -> DataFrame:
    """The rows with the length of their vectors and their position on the Hilbert curve."""
    schema = schema_of("id long, label long, vec array<long>, dim int, key long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for dim, part in _by_dim(batch):
                key = np.zeros(part.num_rows, np.int64)
                if dim in curves:
                    axes, mean, dev = curves[dim]
                    z = (_matrix(part.column("vec"), dim)[:, axes.astype(int)] - mean) / dev
                    half = 1 << (CURVE_BITS - 1)
                    cells = np.clip(np.floor(z * half / 2) + half, 0, 2 * half - 1)      # two deviations to both sides
                    key = (hilbert_key(cells, CURVE_BITS) >> np.uint64(1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2).cast(arrow.field(2).type),
                                                  pa.array(np.full(part.num_rows, dim), pa.int32()), pa.array(key)], schema=arrow)

    return rows.mapInArrow(run, schema)


def write_blocks(rows: DataFrame, groups: int) -> DataFrame:
    """The candidate blocks as a table in the shared folder.  Equal rows (id, label, vector) are kept once.

    Rows are dealt by ranges of (length, label, curve, id), so a label or a value that holds a large part of
    all rows is spread over many groups.
    """
    order = ["dim", "label", "key", "id"]
    schema = schema_of(_BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        arrow, base, block, group = to_arrow_schema(schema), TaskContext.get().partitionId() << 32, 0, -1
        held: list[tuple] = []
        kind = before = None

        def closed() -> pa.RecordBatch:
            dim, label = kind
            x = np.array([v for _, v in held], np.int64).reshape(len(held), dim)
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(
                (base + group, block, dim, label, len(held), np.array([i for i, _ in held], "<i8").tobytes(), pack(x),
                 x.min(axis=0).astype("<i8").tobytes(), x.max(axis=0).astype("<i8").tobytes()), arrow)], schema=arrow)

        for batch in batches:
            for vec_id, label, vec, dim, _ in zip(*(c.to_pylist() for c in batch.columns)):
                row, before = before, (vec_id, label, vec)
                if row == before:
                    continue
                if kind != (dim, label) or len(held) >= BLOCK_ROWS:
                    if held:
                        yield closed()
                        block += 1
                    group += kind != (dim, label)     # a group holds one label
                    held, kind = [], (dim, label)
                held.append((vec_id, vec))
        if held:
            yield closed()

    dealt = rows.repartitionByRange(groups, *order).sortWithinPartitions(*order, "vec")
    return stored(dealt.mapInArrow(run, schema))


def group_zones(blocks: DataFrame) -> DataFrame:
    """(grp, dim, label, lo, hi): the zone map of every group, from its blocks' zone maps alone."""
    schema = schema_of("grp long, dim int, label long, lo binary, hi binary")

    def run(table: pa.Table) -> pa.Table:
        lo, hi = (np.array([np.frombuffer(v, "<i8") for v in table.column(c).to_pylist()]) for c in ("lo", "hi"))
        first = {c: table.column(c)[0].as_py() for c in ("grp", "dim", "label")}
        return pa.table({k: pa.array([v], type=f.type) for (k, v), f in zip(
            (first | {"lo": lo.min(axis=0).tobytes(), "hi": hi.max(axis=0).tobytes()}).items(), to_arrow_schema(schema))})

    return stored(blocks.select("grp", "dim", "label", "lo", "hi").groupBy("grp").applyInArrow(run, schema))


def bounds(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each row of ``q`` with any vector between ``lo`` and ``hi`` (a row each).

    Outer bounds: where doubles are not exact they are widened by more than their error.
    """
    q, lo, hi = (np.asarray(a, float) for a in (q, lo, hi))
    pos, neg = np.maximum(q, 0), np.minimum(q, 0)
    least, largest = pos @ lo.T + neg @ hi.T, pos @ hi.T + neg @ lo.T
    slack = np.abs(q) @ np.maximum(np.abs(lo), np.abs(hi)).T
    slack = np.where(slack < _EXACT, 0.0, slack * 1e-9)
    return least - slack, largest + slack


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``q`` with the rows of ``x``; beyond 64 bits they are held at the last number."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    if float(np.abs(q.astype(float)).max()) * float(np.abs(x.astype(float)).max()) * q.shape[1] < _EXACT:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    return np.clip(q.astype(object) @ x.astype(object).T, _LEAST, _MOST).astype(np.int64)


class Best:
    """The first K rows (highest score, then least id) of every (anchor, window)."""

    def __init__(self, low: np.ndarray):
        self.low = low         # per (anchor, window): scores below it cannot be among the first K
        self.parts: list[tuple] = []
        self.waiting = 0

    def add(self, anchor: np.ndarray, win: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((anchor, win, ids, score))
        self.waiting += len(anchor)
        if self.waiting > PENDING:
            self.thin()

    def thin(self) -> tuple[np.ndarray, ...]:
        a, w, i, s = (np.concatenate(c) for c in zip(*self.parts)) if self.parts else (np.empty(0, np.int64),) * 4
        order = np.lexsort((i, -s, w, a))
        a, w, i, s = a[order], w[order], i[order], s[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1])
        place = np.arange(len(a)) - np.maximum.accumulate(np.where(new, np.arange(len(a)), 0)) if len(a) else a
        keep = place < K
        last = place == K - 1
        self.low[a[last], w[last]] = np.maximum(self.low[a[last], w[last]], s[last])
        self.parts, self.waiting = [(a[keep], w[keep], i[keep], s[keep])], 0
        return self.parts[0]


class Asked:
    """Some anchors of a tile: their vectors and the score windows they look for."""

    def __init__(self, table: pa.Table, shares: tuple[int, int] | None):
        rows = table.to_pylist()
        self.dim = rows[0]["dim"]
        self.q = np.array([unpack(r["vec"], self.dim) for r in rows], np.int64).reshape(len(rows), self.dim)
        self.anchor, self.ids, self.label = (np.array([r[c] for r in rows], np.int64) for c in ("anchor", "anchor_id", "label"))
        if shares is None:      # one window without limits
            self.low, self.high = np.full((len(rows), 1), _LEAST), np.full((len(rows), 1), _MOST)
            return
        wide = max(len(r["reached"]) for r in rows)
        self.low, self.high = np.full((len(rows), wide), _MOST), np.full((len(rows), wide), _LEAST)
        for k, r in enumerate(rows):
            for w, score in enumerate(r["reached"]):
                self.low[k, w] = max(_LEAST, -(-score * shares[0] // 100))
                self.high[k, w] = min(_MOST, score * shares[1] // 100)


def _chunks(table: pa.Table, shares: tuple[int, int] | None) -> Iterator[Asked]:
    for at in range(0, table.num_rows, CHUNK):
        yield Asked(table.slice(at, CHUNK), shares)


def _zone_maps(rows: list[dict], dim: int) -> list[np.ndarray]:
    return [np.array([np.frombuffer(r[c], "<i8") for r in rows]).reshape(len(rows), dim) for c in ("lo", "hi")]


def _search(asked: Asked, blocks: list[dict], zone_maps: list[np.ndarray], same: bool) -> list[np.ndarray]:
    """[anchor, window, id, score]: the first K rows of a group of blocks for every window."""
    best = Best(asked.low)
    least, largest = bounds(asked.q, *zone_maps)
    top = asked.high.max(axis=1)
    for at in np.argsort(-largest.max(axis=0), kind="stable"):      # promising blocks first: they raise the lower ends
        need = np.flatnonzero((largest[:, at] >= best.low.min(axis=1)) & (least[:, at] <= top))
        if not len(need):
            continue
        b = blocks[at]
        ids = np.frombuffer(b["ids"], "<i8")
        s = products(asked.q[need], unpack(b["vectors"], len(ids) * asked.dim).reshape(len(ids), asked.dim))
        for w in range(asked.low.shape[1]):
            k, j = np.nonzero((s >= best.low[need, w][:, None]) & (s <= asked.high[need, w][:, None]))
            if same:     # an anchor is no partner of its own
                other = ids[j] != asked.ids[need[k]]
                k, j = k[other], j[other]
            if len(k):
                best.add(need[k], np.full(len(k), w), ids[j], s[k, j])
        if best.waiting > 8 * K * len(asked.q):
            best.thin()
    a, w, i, s = best.thin()
    return [asked.anchor[a], w, i, s]


def _choose(asked: Asked, zones: list[dict], zone_maps: list[np.ndarray], same: bool) -> list[np.ndarray]:
    """[anchor, grp]: the groups whose zone maps reach a window."""
    least, largest = bounds(asked.q, *zone_maps)
    own = asked.label[:, None] == np.array([z["label"] for z in zones])[None, :]
    k, j = np.nonzero((own if same else ~own) & (largest >= asked.low.min(axis=1)[:, None])
                      & (least <= asked.high.max(axis=1)[:, None]))
    return [asked.anchor[k], np.array([z["grp"] for z in zones], np.int64)[j]]


def _tiled(work, ddl: str, same: bool, shares: tuple[int, int] | None):
    """``work`` as a function of two co-grouped tables: blocks or groups with zone maps, and anchors."""
    schema = schema_of(ddl)

    def run(zoned: pa.Table, anchors: pa.Table) -> pa.Table:
        arrow = to_arrow_schema(schema)
        if not zoned.num_rows or not anchors.num_rows:
            return arrow.empty_table()
        rows = zoned.to_pylist()
        maps = _zone_maps(rows, rows[0]["dim"])
        parts = [work(asked, rows, maps, same) for asked in _chunks(anchors, shares)]
        return pa.table([pa.array(np.concatenate(c), type=f.type) for c, f in zip(zip(*parts), arrow)], schema=arrow)
    return run


def pack_anchors(rows: DataFrame) -> DataFrame:
    """(anchor, anchor_id, label, dim, vec): the anchors with packed vectors, ``anchor`` a number of their own."""
    schema = schema_of("anchor_id long, label long, dim int, vec binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for dim, part in _by_dim(batch):
                packed = [pack(v) for v in _matrix(part.column("vec"), dim)] if dim else [b""] * part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.full(part.num_rows, dim), pa.int32()),
                                                  pa.array(packed, pa.binary())], schema=arrow)

    packed = rows.mapInArrow(run, schema).distinct()
    return stored(packed.select(F.monotonically_increasing_id().alias("anchor"), "*"))


def first_rows(anchors: DataFrame, blocks: DataFrame, zones: DataFrame, shares: tuple[int, int] | None,
               zone_parts: int, anchor_parts: int) -> DataFrame:
    """(anchor, win, id, score, place): the first K rows for each window of each anchor.

    Without ``shares``: rows of the anchor's own label; else rows of other labels, a window for each positive.
    Zone maps meet anchors, then groups of blocks meet the anchors they were
    chosen for; both in tiles of bounded numbers of rows on either side.
    """
    same = shares is None
    tile = F.pmod(F.xxhash64("anchor"), F.lit(anchor_parts)).cast("int")
    a = anchors.withColumn("tile", tile).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(zone_parts - 1))))
    z = (zones.withColumn("part", F.pmod(F.xxhash64("grp"), F.lit(zone_parts)).cast("int"))
         .withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(anchor_parts - 1)))))
    keys = ["dim", "part", "tile"]
    pairs = "anchor long, grp long"
    chosen = stored(z.groupBy(keys).cogroup(a.groupBy(keys)).applyInArrow(_tiled(_choose, pairs, same, shares), schema_of(pairs))
                    .withColumn("tile", tile))
    sent = blocks.join(chosen.select("grp", F.col("tile").alias("for_tile")).distinct(), "grp")
    asked = anchors.join(chosen, "anchor")
    found = (sent.groupBy("grp", "for_tile").cogroup(asked.groupBy("grp", "tile"))
             .applyInArrow(_tiled(_search, _FOUND, same, shares), schema_of(_FOUND)))
    place = F.row_number().over(Window.partitionBy("anchor", "win").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).filter(F.col("place") <= K)


def hard_negatives(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   anchors_every: int = 100, shares: tuple[int, int] = (80, 100)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each anchor (id divisible by ``anchors_every``) its first 5 rows of the same label, and for each of these the
    first 5 rows of other labels whose score is between the given percentages of the positive's.  Windows of
    negative positive scores hold nothing.  Rows with a null id, label or vector, or a null or non-finite component, take no part;
    rows equal in id, label and vector count once, rows of the anchor's own id are no partners, and vectors
    meet only vectors of their length.  Several rows of one anchor id (not equal) are anchors of their own.  Scores
    beyond 64 bits are held at its last number.  Ties: the smaller id.  Empty tables give no rows.  Only the
    named columns are read.
    """
    used = prepared(rows, id_col, vector_col, label_col)
    n, n_anchors = used.agg(F.count(F.lit(1)), F.count_if(F.col("id") % anchors_every == 0)).first()
    spark = rows.sparkSession
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    groups = max(least, -(-n // GROUP_ROWS))
    blocks = write_blocks(on_curve(used, spreads(used)), groups)
    zones = group_zones(blocks)
    anchors = pack_anchors(used.filter(F.col("id") % anchors_every == 0))
    parts = max(1, -(-groups // ZONES)), max(1, -(-n_anchors // ANCHORS))
    positives = stored(first_rows(anchors, blocks, zones, None, *parts).select(
        "anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("place") - 1).alias("win")))
    reached = positives.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("win", "positive_score"))).alias("p"))   # at most K
    windows = anchors.join(reached.select("anchor", F.col("p.positive_score").alias("reached")), "anchor")
    negatives = first_rows(windows, blocks, zones, shares, *parts)
    return (negatives.join(positives, ["anchor", "win"]).join(anchors.select("anchor", "anchor_id"), "anchor")
            .select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))
