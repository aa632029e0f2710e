"""Dense vectors: usable latest rows and classes of equal vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.session import cut_lineage

DIMENSIONS = 96
#: Ids kept per class of equal vectors, unless a longer result list needs more.
CLASS_IDS = 6
#: Steps of a unit vector's coordinates within which two vectors have the same direction.
DIRECTION_STEPS = 100_000


def latest_usable(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """``(symbol_id, embedding)``: per symbol the row with the latest created_at, if usable.

    Usable means not null, of the given length, without null, NaN or infinite
    elements and not all zero; a symbol whose latest row is unusable is absent.
    Rows without a symbol_id are ignored; a null created_at is oldest; rows equal
    in both are resolved by a hash of the vector, so the choice is stable.
    """
    latest = (
        vectors.where(F.col("symbol_id").isNotNull())
        .groupBy("symbol_id")
        .agg(F.max_by("embedding", F.struct("created_at", F.xxhash64("embedding"))).alias("embedding"))
    )
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return latest.where((F.size("embedding") == dimensions) & ~bad & F.exists("embedding", lambda x: x != 0))


def latest_packed(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """Like ``latest_usable``, with the vectors packed (see ``pack``) before anything is moved."""
    kind = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["symbol_id"], batch["created_at"], batch["h"], pack(batch["embedding"], dimensions)], names=["symbol_id", "created_at", "h", "embedding"])

    rows = vectors.where(F.col("symbol_id").isNotNull()).select("symbol_id", "created_at", F.xxhash64("embedding").alias("h"), "embedding")
    packed = rows.mapInArrow(run, f"symbol_id {kind['symbol_id']}, created_at {kind['created_at']}, h long, embedding binary")
    return packed.groupBy("symbol_id").agg(F.max_by("embedding", F.struct("created_at", "h")).alias("embedding")).where("embedding is not null")


#: Types of packed coordinates, narrowest first; the whole ones count steps of a power of two.
_FORMS = (np.dtype("i1"), np.dtype("<i2"), np.dtype("<f4"))


def pack(column: pa.Array, dimensions: int) -> pa.Array:
    """Vectors as bytes without loss, null where unusable (see ``latest_usable``).

    Two bytes hold an exponent, then follow the coordinates: as whole steps of one
    or two bytes where the vector is exactly that, else in single precision.  Equal
    vectors have equal bytes.
    """
    right = np.nonzero(pc.equal(pc.list_value_length(column), dimensions).fill_null(False).to_numpy(zero_copy_only=False))[0]
    x = column.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dimensions)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    right, x = right[good], x[good] + np.float32(0)  # no negative zeros
    wide = x.astype(np.float64)
    peak = np.frexp(np.abs(wide).max(1, initial=0))[1]
    form, header = np.full(len(x), 2), np.zeros(len(x), "<i2")
    for n in (1, 0):
        scale = 8 * (n + 1) - 1 - peak
        steps = np.ldexp(wide, scale[:, None])
        whole = (steps == np.rint(steps)).all(1)
        form[whole], header[whole] = n, scale[whole]
    sizes = np.zeros(len(column), np.int64)
    sizes[right] = 2 + dimensions * np.array([f.itemsize for f in _FORMS])[form]
    at = np.concatenate([[0], np.cumsum(sizes)])
    data = np.zeros(at[-1], np.uint8)
    for n, kind in enumerate(_FORMS):
        own = np.nonzero(form == n)[0]
        body = (np.ldexp(wide[own], header[own, None]) if n < 2 else x[own]).astype(kind)
        rows = np.concatenate([header[own, None].view(np.uint8), np.ascontiguousarray(body).view(np.uint8).reshape(len(own), dimensions * kind.itemsize)], 1)
        data[at[right[own], None] + np.arange(rows.shape[1])] = rows
    usable = np.zeros(len(column), bool)
    usable[right] = True
    bits = pa.array(usable).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(column), [bits, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


def unpack(column: pa.Array, dimensions: int) -> np.ndarray:
    """The vectors that ``pack`` packed."""
    offsets, held = column.buffers()[1:]
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(held, np.uint8) if held else np.zeros(0, np.uint8)
    out = np.empty((len(column), dimensions), np.float32)
    for kind in _FORMS:
        size = 2 + dimensions * kind.itemsize
        own = np.nonzero(np.diff(at) == size)[0]
        rows = data[at[own, None] + np.arange(size)]
        scale = np.ascontiguousarray(rows[:, :2]).view("<i2")
        out[own] = np.ldexp(np.ascontiguousarray(rows[:, 2:]).view(kind).astype(np.float32), -scale.astype(np.int32))
    return out


def _directions(dimensions: int):
    """Adds two hashes of the direction: coordinates of the unit vector in whole steps, the same at any length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = np.rint(unit(matrix(batch["embedding"], dimensions)) * DIRECTION_STEPS).astype(np.int32)
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(row) for row in steps), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch["symbol_id"], batch["embedding"], pa.array(digests[:, 0]), pa.array(digests[:, 1])], names=["symbol_id", "embedding", "c1", "c2"])

    return run


def vector_classes(usable: DataFrame, ids: int = CLASS_IDS, by_direction: int = 0) -> tuple[DataFrame, DataFrame]:
    """Classes of equal vectors: ``(rep, size, ids, embedding)`` and ``(symbol_id, rep)``.

    ``rep`` is the smallest symbol_id of the class and ``ids`` its first ``ids``
    ids.  With ``by_direction``, the number of dimensions, vectors that differ in
    length only are one class.
    A class of any size costs a fixed number of values per input partition (partial
    aggregates and partial group limits), so that a third of all rows being one
    vector needs no special task.
    """
    if by_direction:
        key = usable.schema["symbol_id"].dataType.simpleString()
        told = usable.select("symbol_id", "embedding").mapInArrow(_directions(by_direction), f"symbol_id {key}, embedding array<float>, c1 long, c2 long")
    else:
        told = usable.withColumn("c1", F.xxhash64("embedding")).withColumn("c2", F.xxhash64(F.lit(1), "embedding"))
    keyed = cut_lineage(told)
    order = Window.partitionBy("c1", "c2").orderBy("symbol_id")
    first = (
        keyed.select("c1", "c2", "symbol_id")
        .withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= ids)
        .groupBy("c1", "c2")
        .agg(F.sort_array(F.collect_list("symbol_id")).alias("ids"))
        .withColumn("rep", F.element_at("ids", 1))
    )
    sizes = keyed.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("size"))
    members = keyed.select("c1", "c2", "symbol_id").join(first.select("c1", "c2", "rep"), ["c1", "c2"]).select("symbol_id", "rep")
    classes = (
        first.join(sizes, ["c1", "c2"])
        .select("rep", "size", "ids")
        .join(keyed.select(F.col("symbol_id").alias("rep"), "embedding"), "rep")
    )
    return cut_lineage(classes), cut_lineage(members)


def matrix(column: pa.Array | pa.ChunkedArray, dimensions: int) -> np.ndarray:
    """A list<float> column, or one of packed vectors, as a float32 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if pa.types.is_binary(column.type):
        return unpack(column, dimensions)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dimensions)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one."""
    wide = x.astype(np.float64)
    return wide / np.sqrt(np.einsum("ij,ij->i", wide, wide))[:, None]
