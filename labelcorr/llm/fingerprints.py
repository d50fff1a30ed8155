"""Document fingerprints: every shingle hash below a fixed fraction of the hash range."""

from __future__ import annotations

import binascii
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelcorr.llm.common import arrow_rows, utf8
from labelcorr.session import BATCH_BYTES

SHINGLE = 12
FRACTION = 2  # one hash in so many is retained; a power of two, small enough for short texts
ROWS_PER_RUN = 4_000
MAX_RUNS = 50_000
PART_CHARS = 1_000_000  # of texts whose results are returned together
PACKED = 65_536  # hashes whose bits are held as bytes while they are packed; a multiple of 8


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sketch(codes: np.ndarray, shingle: int = SHINGLE, fraction: int = FRACTION) -> np.ndarray:
    """Sorted hashes below the threshold, of all runs of ``shingle`` code points.

    Of a 64-bit hash the 32 bits below the threshold's are retained.

    A text shorter than that is one shingle, an empty one has none. The threshold
    is the same for every text, so sketches of parts merge into that of the whole
    (``merged``) and small and large texts can be compared.
    """
    n = len(codes)
    if not n:
        return np.empty(0, np.uint32)
    width = min(shingle, n)
    h = np.full(n - width + 1, width, np.uint64)
    wide = codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for i in range(width):
        h *= np.uint64(0xD1342543DE82EF95)
        h += wide[i : n - width + 1 + i]
    h = _finish(h)
    zeros = fraction.bit_length() - 1
    return np.unique((h[h < np.uint64((1 << 64) // fraction)] >> np.uint64(32 - zeros)).astype(np.uint32))


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.union1d(a, b)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the shingles of ``a`` that are in ``b``; 0 if none is retained."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 0.0


def likeness(a: np.ndarray, b: np.ndarray, same: bool) -> float:
    """Estimated Jaccard similarity of two shingle sets, 0 to 1.

    Two sketches that retained nothing say nothing about their texts, which are
    then alike (1) only if they are equal.
    """
    common = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - common
    return common / union if union else float(same)


def _low_bits(n: int) -> int:
    """Bits of each of ``n`` hashes that are stored as they are: of about the mean gap."""
    return max(0, ((1 << 32) // n).bit_length() - 1)


def packed(found: np.ndarray) -> bytes:
    """Different sorted 32-bit hashes in close to the fewest bits that tell such sets apart.

    The low bits of each are stored as they are. Of the rest, which rises slowly,
    hash number ``i`` sets bit ``i + rest`` of a bitmap. Nothing is lost (``unpacked``).
    """
    n = len(found)
    if not n:
        return b""
    low = _low_bits(n)
    parts = []
    for at in range(0, n, PACKED):
        whole = found[at : at + PACKED].astype(">u4").view(np.uint8).reshape(-1, 4)
        parts.append(np.packbits(np.unpackbits(whole, axis=1)[:, 32 - low :]).tobytes())
    rest = np.zeros(n + (1 << (32 - low)), np.bool_)
    rest[(found.astype(np.int64) >> low) + np.arange(n)] = True
    return b"".join([*parts, np.packbits(rest).tobytes()])


def unpacked(data: bytes, n: int) -> np.ndarray:
    """The ``n`` hashes that ``packed`` stored."""
    if not n:
        return np.empty(0, np.uint32)
    low = _low_bits(n)
    size = (n * low + 7) // 8
    raw = np.frombuffer(data, np.uint8)
    whole = np.zeros((n, 32), np.uint8)
    whole[:, 32 - low :] = np.unpackbits(raw[:size], count=n * low).reshape(n, low)
    rest = np.flatnonzero(np.unpackbits(raw[size:])) - np.arange(n)
    own = np.packbits(whole, axis=1).view(">u4").ravel()
    return (own.astype(np.int64) + (rest << low)).astype(np.uint32)


def as_text(codes: np.ndarray, found: np.ndarray) -> str:
    """Digest of the text in hexadecimal, the number of retained hashes, these in base64."""
    own = f"{xxhash.xxh3_64_hexdigest(codes.tobytes())}:"
    if not len(found):
        return own
    return f"{own}{len(found)}:{binascii.b2a_base64(packed(found), newline=False).decode()}"


def retained(fingerprint: str) -> np.ndarray:
    """The hashes of a fingerprint, as ``sketch`` gave them."""
    _, n, data = [*fingerprint.split(":"), ""][:3]
    return unpacked(binascii.a2b_base64(data), int(n or 0))


def edited(codes: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The last quarter replaced by as many code points from the start of the next text."""
    quarter = len(codes) // 4
    return np.concatenate([codes[: len(codes) - quarter], after[:quarter]])


def in_runs(docs: DataFrame, id_col: str, text_col: str, rows_per_run: int) -> DataFrame:
    """``(run, last, id, text)``: ids in order, cut into runs that end with the next run's first row.

    Runs are ranges of the id with about ``rows_per_run`` rows, by quantiles of
    the ids, ``MAX_RUNS`` at most. The first row of a run is repeated at the end
    of the run before it (``last`` is 1 there), the very first row at the end of
    the last run, so that each row finds its successor in its own run. Only a
    bound and a first id per run go through the driver. Null ids come first.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text"))
    place = F.coalesce(F.col("id").cast("double"), F.lit(float("-inf")))
    ids = rows.select("id", place.alias("_place"))
    wanted = min(MAX_RUNS, ids.count() // rows_per_run)
    cuts: list[float] = []
    if wanted > 1:
        shares = [i / wanted for i in range(1, wanted)]
        known = ids.filter(F.col("id").isNotNull())
        cuts = sorted(set(known.approxQuantile("_place", shares, 0.1 / wanted)))
    cutter = Bucketizer(
        splits=[-float("inf"), *(cuts or [0.0]), float("inf")], inputCol="_place", outputCol="run"
    )
    firsts = (
        cutter.transform(ids)
        .groupBy("run")
        .agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id")).alias("first"))
        .orderBy("run")
        .collect()
    )
    ends = [
        (f["first"]["id"], before["run"]) for before, f in zip(firsts[-1:] + firsts[:-1], firsts)
    ]
    ends = docs.sparkSession.createDataFrame(ends, "_first long, _before double")
    rows = cutter.transform(rows.withColumn("_place", place))
    rows = rows.join(F.broadcast(ends), F.col("id").eqNullSafe(F.col("_first")), "left")
    here = F.struct(F.col("run"), F.lit(0).alias("last"))
    before = F.when(
        F.col("_before").isNotNull(), F.struct(F.col("_before").alias("run"), F.lit(1).alias("last"))
    )
    return rows.select(F.explode(F.array_compact(F.array(here, before))).alias("at"), "id", "text").select(
        "at.run", "at.last", "id", "text"
    )


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text compressed, with its number of bytes."""
    codec = pa.Codec("zstd")
    for batch in batches:
        *keys, texts = batch.columns
        texts = [t.as_buffer() for t in texts]
        sizes = pa.array([t.size for t in texts], pa.int64())
        texts = pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([*keys, sizes, texts], ["run", "last", "id", "size", "text"])


def _unzipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What ``_zipped`` was given, in batches of bounded size, whatever a text shrank to."""
    codec = pa.Codec("zstd")
    names = ["run", "last", "id", "text"]
    for batch in batches:
        *keys, sizes, texts = batch.columns
        found: list[bytes] = []
        start = held = 0
        for at, (size, text) in enumerate(zip(sizes.to_pylist(), texts), 1):
            found.append(codec.decompress(text.as_buffer(), size, asbytes=True))
            held += size
            if held >= BATCH_BYTES or at == len(batch):
                part = [k.slice(start, at - start) for k in keys]
                yield pa.RecordBatch.from_arrays([*part, pa.array(found, pa.binary())], names)
                found, start, held = [], at, 0


def fingerprints(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    fraction: int = FRACTION,
    rows_per_run: int = ROWS_PER_RUN,
) -> DataFrame:
    """The fingerprint of each row, of its edited text, and how alike they are.

    Columns ``id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``. The edited text has its last quarter replaced by
    the start of the next row's text in the order of the id (after the last row
    the first). Rows with the same id are ordered by text, a null id comes
    first, a null text is empty; a single row is its own successor. The
    fingerprint of an empty text has no hashes; an empty table gives an empty
    result. Other columns are not looked at.

    The texts are shuffled once, compressed, by run; within a task rows stream by
    in order and only two are held at a time.
    """
    rows = in_runs(docs, id_col, text_col, rows_per_run)
    rows = arrow_rows(rows, _zipped, "run double, last int, id long, size long, text binary")
    rows = arrow_rows(rows.repartition("run"), _unzipped, "run double, last int, id long, text binary")
    rows = rows.sortWithinPartitions("run", "last", "id", "text")
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
             "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]

        def part(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        pending = None
        for batch in batches:
            found: list[tuple] = []
            chars = 0
            for at, last, row_id, text in zip(*(c for c in batch.columns)):
                codes = np.frombuffer(text.as_py().decode().encode("utf-32-le"), "<u4")
                own = sketch(codes, shingle, fraction)
                if pending is not None and pending[0] == at.as_py():
                    found.append(_compared(*pending[1:], codes, own, shingle, fraction))
                pending = (at.as_py(), row_id.as_py(), codes, own)
                if last.as_py():
                    pending = None
                chars += len(codes)
                if chars >= PART_CHARS:
                    yield part(found)
                    found, chars = [], 0
            yield part(found)

    schema = """id long, n_chars long, edited_sha256 string, fingerprint string,
                edited_fingerprint string, near_edited double, near_next double"""
    return arrow_rows(rows, run, schema)


def _compared(row_id, codes, own, after, of_after, shingle, fraction) -> tuple:
    changed = edited(codes, after)
    of_changed = sketch(changed, shingle, fraction)
    return (
        row_id,
        len(codes),
        hashlib.sha256(changed.tobytes().decode("utf-32-le").encode()).hexdigest(),
        as_text(codes, own),
        as_text(changed, of_changed),
        likeness(own, of_changed, np.array_equal(codes, changed)),
        likeness(own, of_after, np.array_equal(codes, after)),
    )
