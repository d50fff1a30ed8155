"""MinHash near-duplicates: bottom-k sketches of one hash function, exact check at the end.

The job, all on Spark tables:

1. One pass over the texts gives each document the number of its shingles, a
   digest of its set and its sketch: the ``SKETCH`` smallest shingle hashes, of
   which the first ``RUNS`` give the lists.
   Documents with equal sets are one class from here on, known by their
   smallest id, so copies cost one row.
2. Inverted lists of retained values, keyed by runs of values that are next to
   each other in a sketch. If two sets have similarity ``t``, a share ``t`` of the
   smallest values of their union lies in both sets, and a run of values in both
   stays a run in both sketches. For sets that fit in the sketch the length of a
   run is guaranteed (``run_bands``); for larger ones the chance that a pair at
   0.8 has no run of four among 96 values is about 1e-9.  Runs instead of single
   values keep the lists short where common word pairs fill the sketches.
3. In each list members are first compared with a few hubs. Pairs pass a size
   filter, the union-sketch estimate, and then the exact similarity of the full
   sets. The links are joined to components, which leaves few lists with several
   components. Short ones are compared whole. The members of a very common one
   are listed anew by the rarest values of their sketches, as many as a likely
   partner must share one of, so that what they all have in common makes no
   pairs. Common values of a list's members are counted at once, only pairs that
   may pass the estimate leave the task, each from one of the lists that hold it.
   So every pair of a list is compared, cannot be likely or is already connected.
4. The exact check streams pairs sorted by hub, so a task holds one set of a hub
   and one batch of members, however many copies a group has.

A shingle is known by a 64-bit hash of its words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelcorr.llm.common import (
    arrow_rows,
    bit_maps,
    collected_bits,
    slot,
    utf8,
    written,
)
from labelcorr.llm.components import components

SKETCH = 256  # values kept of each set, from which similarity is estimated
RUNS = 96  # the smallest of them, which give the lists
SIGMAS = 6
LONGEST_RUN = 4
HUBS = (4,)  # per list and turn
BLOCK = 256
COUNTERS = 1 << 18  # of values in very common lists; 2 MB
CHUNK = 512
WANTED_MAPS = 512  # 2 MB


class WordHashes:
    """64-bit hashes of the words of a text, all at once.

    Each byte value has a random number; a word's hash is the sum of these times
    the powers of an odd factor, modulo 2 to the 64, mixed with its length. Sums
    over the whole text give the words by difference.
    """

    FACTOR = 0x5851F42D4C957F2D

    def __init__(self) -> None:
        self.of_byte = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64)
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.powers = self.inverses = np.empty(0, np.uint64)

    def _grow(self, n: int) -> None:
        def powers(factor: int) -> np.ndarray:
            found = np.full(n, factor, np.uint64)
            found[0] = 1
            return np.cumprod(found, dtype=np.uint64)

        self.powers = powers(self.FACTOR)
        self.inverses = powers(pow(self.FACTOR, -1, 1 << 64))

    def __call__(self, text: bytes) -> np.ndarray:
        """One hash per word, after lower-casing A-Z."""
        codes = np.frombuffer(text.lower(), np.uint8)
        n = len(codes)
        if n > len(self.powers):
            self._grow(2 * n)
        edge = np.ones(n + 2, bool)
        edge[1:-1] = self.space[codes]
        edges = np.flatnonzero(edge[1:] != edge[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.of_byte[codes] * self.powers[:n], out=sums[1:])
        found = (sums[ends] - sums[starts]) * self.inverses[starts]
        return _mix(found, (ends - starts).astype(np.uint64))


def _mix(state: np.ndarray, value: np.ndarray) -> np.ndarray:
    state = (state ^ value) * np.uint64(0x9E3779B97F4A7C15)
    state ^= state >> np.uint64(32)
    state *= np.uint64(0xD6E8FEB86659FD93)
    return state ^ (state >> np.uint64(29))


def shingle_set(text: bytes, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer words count as one shingle.

    Words are what stands between ASCII white space, after lower-casing A-Z.
    """
    h = hashes(text)
    n = len(h)
    if not n:
        return h
    width = min(size, n)
    found = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        found = _mix(found, h[i : n - width + 1 + i])
    found.sort()
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


def run_bands(threshold: float, longest: int = LONGEST_RUN) -> list[tuple[int, int, float]]:
    """``(run, from, to)``: sizes of the larger set for which a run of that length is certain.

    Of ``u`` values in the union at most ``m = floor((1 - t) u)`` are in one set
    only; they cut the others into ``m + 1`` runs, so one has at least
    ``ceil((u - m) / (m + 1))``. Sizes with ``m = 0`` need no list: such sets are equal.
    """
    def certain(u: int) -> int:
        m = math.floor((1 - threshold) * u + 1e-9)
        return longest if m == 0 else min(longest, math.ceil((u - m) / (m + 1)))

    sizes = range(1, 400)
    first = next((u for u in sizes if math.floor((1 - threshold) * u + 1e-9)), None)
    if first is None:
        return []
    starts = {}
    for run in range(1, longest + 1):
        low = next((u for u in sizes if all(certain(v) >= run for v in sizes if v >= u)), None)
        if low is not None:
            starts[run] = max(low, first)
    bands, runs = [], sorted(starts)
    for run, after in zip(runs, [*runs[1:], None]):
        end = starts[after] - 1 if after else math.inf
        if starts[run] <= end:
            bands.append((run, starts[run], end))
    return bands


def sketches(
    docs: DataFrame, id_col: str, text_col: str, shingle: int
) -> DataFrame:
    """``(id, n, digest, sketch)`` of every row, in one pass over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, digest, sketch = [], [], []
            for text in batch.column(1):
                found = shingle_set(text.as_py(), shingle, hashes)
                n.append(len(found))
                digest.append(xxhash.xxh3_128_digest(found.tobytes()))
                sketch.append((found[:SKETCH] >> np.uint64(32)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(digest, pa.binary()),
                    pa.array(sketch, pa.binary()),
                ],
                ["id", "n", "digest", "sketch"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text"))
    return arrow_rows(rows, run, "id long, n long, digest binary, sketch binary")


def _keys(n: int, sketch: bytes, threshold: float, bands: list) -> np.ndarray:
    """The sorted keys of the lists a set of ``n`` shingles is on."""
    values = np.frombuffer(sketch, "<u4")[:RUNS].astype(np.uint64)
    found = []
    for run, low, high in bands:
        if n >= low * threshold - 1e-9 and n * threshold <= high + 1e-9 and len(values) >= run:
            key = np.full(len(values) - run + 1, run, np.uint64)
            for i in range(run):
                key = _mix(key, values[i : len(values) - run + 1 + i])
            found.append(key)
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


def list_entries(sets: DataFrame, threshold: float) -> DataFrame:
    """``(key, id)``: the lists each set is on, one per run of its sketch."""
    bands = run_bands(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            found = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            keys = [_keys(n, sketch, threshold, bands) for n, sketch in found]
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(keys).view(np.int64)),
                        pa.array(np.repeat(ids, [len(k) for k in keys])),
                    ],
                    ["key", "id"],
                )

    return arrow_rows(sets.select("id", "n", "sketch"), run, "key long, id long")


def _likely(a: bytes, b: bytes, na: int, nb: int, threshold: float) -> bool:
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    cut = len(x) < na or len(y) < nb
    if cut:
        top = min(v[-1] for v, n in ((x, na), (y, nb)) if len(v) < n)
        x, y = x[: np.searchsorted(x, top, "right")], y[: np.searchsorted(y, top, "right")]
    at = np.searchsorted(y, x)
    common = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x)) if len(y) else 0
    union = len(x) + len(y) - common
    return common >= (threshold - (_slack(threshold, union) if cut else 1e-9)) * union


def _slack(threshold: float, n: int) -> float:
    return SIGMAS * math.sqrt(threshold * (1 - threshold) / n)


def estimated(pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose union sketch agrees with the threshold.

    Where both sets fit in their sketch the estimate is exact. Otherwise it is
    the share of common values among the smallest of the union, and the bar is
    ``SIGMAS`` standard deviations lower.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, x, y = (c.to_pylist() for c in batch.columns)
            keep = [i for i in range(len(a)) if _likely(x[i], y[i], na[i], nb[i], threshold)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())),
                 batch.column(1).take(pa.array(keep, pa.int64()))],
                ["a", "b"],
            )

    return arrow_rows(
        pairs.select("a", "b", "na", "nb", "sa", "sb"), run, "a long, b long"
    )


def verified(
    pairs: DataFrame,
    docs: DataFrame,
    reps: DataFrame,
    id_col: str,
    text_col: str,
    shingle: int,
    percent: int,
) -> DataFrame:
    """The pairs ``(a, b)`` whose full shingle sets have at least ``percent`` % in common.

    Only documents of a pair are cut into shingles again: a bitmap of fixed size
    says which. Rows are sorted by hub ``a`` and chunk; the hub's set comes first
    in each chunk and is compared with the members that follow it.
    """
    spark = docs.sparkSession
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    bits = spark.sparkContext.broadcast(
        collected_bits(bit_maps(wanted, "id", maps=WANTED_MAPS), WANTED_MAPS)
    )

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            at = batch.column(2).to_numpy(zero_copy_only=False)
            hit = np.nonzero((bits.value[at >> 3] >> (at & 7)) & 1)[0]
            texts = batch.column(1)
            found = [shingle_set(texts[int(i)].as_py(), shingle, hashes).tobytes() for i in hit]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(hit)),
                    pa.array([xxhash.xxh3_128_digest(x) for x in found], pa.binary()),
                    pa.array(found, pa.binary()),
                ],
                ["id", "digest", "set"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text"))
    rows = rows.filter(F.col("id").isNotNull()).withColumn("_slot", slot("id", maps=WANTED_MAPS))
    known = arrow_rows(rows, sets, "id long, digest binary, set binary")
    # Of rows with the same id only the text that stands for it.
    texts = reps.select(F.col("rep").alias("id"), "digest")
    known = known.join(texts, ["id", "digest"], "left_semi").select("id", "set")
    chunks = (1 << 20) // CHUNK
    members = pairs.withColumn("chunk", F.pmod(F.xxhash64("b"), F.lit(chunks)))
    sizes = pairs.groupBy("a").agg(F.count("*").alias("members"))
    members = members.join(sizes, "a").withColumn(
        "chunk", F.pmod("chunk", F.greatest(F.lit(1), F.expr(f"members div {CHUNK}")))
    )
    ends = members.select("a", "chunk", F.col("b").alias("id")).unionByName(
        members.select("a", "chunk", F.col("a").alias("id")).distinct()
    )
    stream = (
        ends.join(known, "id")
        .repartition("a", "chunk")
        .sortWithinPartitions("a", "chunk", F.col("id") != F.col("a"))
        .select("a", "chunk", "id", "set")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in batches:
            a, chunk, ids, found = (c.to_pylist() for c in batch.columns)
            links = []
            for i in range(len(a)):
                values = np.frombuffer(found[i], np.uint64)
                if ids[i] == a[i]:
                    hub, own = (a[i], chunk[i]), values
                    continue
                if hub != (a[i], chunk[i]):
                    raise RuntimeError("a member came before its hub")
                common = len(np.intersect1d(own, values, assume_unique=True))
                if 100 * common >= percent * (len(own) + len(values) - common):
                    links.append(i)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(links, pa.int64())),
                 batch.column(2).take(pa.array(links, pa.int64()))],
                ["a", "b"],
            )

    return arrow_rows(stream, compare, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
) -> DataFrame:
    """``(id, n_shingles, component)`` per document id: the smallest id it is linked to.

    Two documents are linked if their sets of word shingles have a Jaccard
    similarity of ``percent`` / 100 or more; links chain. Null and empty texts
    have an empty set and are alone, with their own id. A row whose id is null
    is left alone with a null component. Rows with the same id are one document
    with the text that has the most shingles (ties: the largest digest). Other
    columns are not looked at, an empty table gives an empty result.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent is 80 to 100: the runs are chosen for such similarities")
    threshold = percent / 100
    every = written(sketches(docs, id_col, text_col, shingle), "sketches")
    one = every.filter(F.col("id").isNotNull()).groupBy("id").agg(
        F.max(F.struct("n", "digest")).alias("s")
    )
    one = one.select("id", "s.n", "s.digest")
    classes = one.filter(F.col("n") > 0).groupBy("n", "digest").agg(F.min("id").alias("rep"))
    same = (F.col("rep") == F.col("id")) & (F.col("digest") == F.col("_digest"))
    reps = written(
        classes.join(every.select("id", F.col("digest").alias("_digest"), "sketch"), same)
        .select("rep", "n", "digest", "sketch")
        .dropDuplicates(["rep"]),
        "classes",
    )
    labels = _labelled(reps, docs, id_col, text_col, shingle, percent)
    of_rep = labels.withColumnRenamed("id", "rep")
    at = one.join(reps.select("n", "digest", "rep"), ["n", "digest"], "left")
    found = at.join(of_rep, "rep", "left").select(
        "id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "rep", "id").alias("component"),
    )
    alone = every.filter(F.col("id").isNull()).select(
        "id", F.col("n").alias("n_shingles"), F.col("id").alias("component")
    )
    return found.unionByName(alone)


def without_near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with all their columns."""
    found = near_duplicates(docs, id_col, text_col, shingle, percent)
    dropped = found.filter(F.col("id") != F.col("component")).select(F.col("id").alias("_dropped"))
    whole = docs.select(
        F.col(id_col).alias("_id"),
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_doc"),
    )
    left = whole.join(dropped, F.col("_id") == F.col("_dropped"), "left_anti")
    return left.select("_doc.*")


def _labelled(reps, docs, id_col, text_col, shingle, percent) -> DataFrame:
    """``(id, component)`` of the classes that are linked to another one.

    First the members of a list are compared with its hubs, the smallest id in
    each slot of a hash of the id. Lists with several components are then
    compared in blocks. Links between classes are enough of them to give the
    same components as all; those of a later turn join components, not ids.
    """
    threshold = percent / 100
    sets = reps.select(F.col("rep").alias("id"), "n", "sketch")
    entries = list_entries(sets, threshold)
    several = entries.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").select("key")
    lists = written(entries.join(several, "key"), "lists")
    labels = docs.sparkSession.createDataFrame([], "id long, component long")
    first = True
    for slots in HUBS:
        lists, hubs = _opened(lists, None if first else labels, slots)
        likely = estimated(_sized(_hub_pairs(lists, hubs), sets, threshold), threshold)
        labels = _joined(labels, likely, docs, reps, id_col, text_col, shingle, percent, first)
        used = hubs.select("key", F.explode("hubs.id").alias("id")).filter(F.col("id").isNotNull())
        lists, first = lists.join(used, ["key", "id"], "left_anti"), False
    lists, _ = _opened(lists, None if first else labels, 1)
    likely = in_blocks(lists, sets, threshold)
    return _joined(labels, likely, docs, reps, id_col, text_col, shingle, percent, first)


def _joined(labels, likely, docs, reps, id_col, text_col, shingle, percent, first) -> DataFrame:
    """The labels after the likely pairs that are verified have joined their components."""
    likely = written(likely, "likely")
    if likely.isEmpty():
        return labels
    new = verified(likely, docs, reps, id_col, text_col, shingle, percent)
    if first:
        return written(components(new), "labels")
    for end in ("a", "b"):
        own = labels.select(F.col("id").alias(end), "component")
        new = new.join(own, end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    joined = components(written(new, "new-links")).select(
        F.col("id").alias("component"), F.col("component").alias("_whole")
    )
    # Ids that had no component yet are components of their own.
    alone = joined.select(F.col("component").alias("id"), "component")
    known = labels.unionByName(alone.join(labels.select("id"), "id", "left_anti"))
    whole = known.join(joined, "component", "left")
    return written(whole.select("id", F.coalesce("_whole", "component").alias("component")), "labels")


def _least_common(n: int, threshold: float) -> int:
    """How many values of a sketch of a set of ``n`` a likely partner's sketch has at least."""
    whole = math.ceil(threshold * n - 1e-6)
    if n < threshold * (SKETCH + 1) - 1e-6:
        return whole  # neither set is cut
    return min(whole, math.ceil((threshold - _slack(threshold, SKETCH)) * SKETCH - 1e-6))


def rare_lists(crowd: DataFrame, threshold: float) -> DataFrame:
    """``(key, id, component, rare)``: lists of single values for members of very common lists.

    ``crowd`` is ``(id, component, n, sketch)``. Values are put in one order for
    all, rare ones first. Two sketches that have at least ``c`` values in common
    share one of the first ``len - c + 1`` values of each, so a member is listed
    under these only: what is common to the crowd comes last and makes no lists.
    ``rare`` are all the values that a member is listed under. How common a value
    is, is counted over the crowd in ``COUNTERS`` cells; values that share a cell
    count together, which changes the order for all sketches alike and loses no
    pair. A cell that was met once holds a value of one member, with no partner.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for sketch in batch.column(0):
                seen += np.bincount(_cells(sketch.as_py()), minlength=COUNTERS)
        cells = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(seen[cells])], ["cell", "n"])

    counted = arrow_rows(crowd.select("sketch"), count, "cell long, n long")
    cells = counted.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # COUNTERS rows at most
    counts = np.zeros(COUNTERS, np.int64)
    counts[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    common = crowd.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for n, sketch in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                values = np.unique(np.frombuffer(sketch, "<u4"))
                met = common.value[_cells(values.tobytes())]
                # One more than needed, should two shingles have the same value.
                places = len(sketch) // 4 - _least_common(n, threshold) + 2
                first = np.lexsort((values, met))[:places]
                lists.append(np.sort(values[first[met[first] > 1]]))
            times = np.array([len(x) for x in lists], np.int64)
            at = pa.array(np.repeat(np.arange(len(lists)), times))
            rare = pa.array([x.tobytes() for x in lists], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([*lists, np.empty(0, "<u4")]).astype(np.int64)),
                    batch.column(0).take(at),
                    batch.column(1).take(at),
                    rare.take(at),
                ],
                ["key", "id", "component", "rare"],
            )

    rows = crowd.select("id", "component", "n", "sketch")
    return arrow_rows(rows, run, "key long, id long, component long, rare binary")


def _cells(sketch: bytes) -> np.ndarray:
    return np.frombuffer(sketch, "<u4").astype(np.int64) % COUNTERS


def in_blocks(lists: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Likely pairs ``(a, b)`` of different components in the same list ``(key, id, component)``.

    Members of lists longer than ``BLOCK`` are listed anew by their rare values.
    A list that is long even then is dealt to blocks; a task holds a list, or two
    blocks of one, at a time and counts the values that their sketches share.
    """
    sizes = lists.groupBy("key").agg(F.count("*").alias("_n"))
    long = sizes.filter(F.col("_n") > BLOCK).select("key")
    members = lists.join(long, "key", "left_semi").select("id", "component").distinct()
    crowd = written(members.join(sets, "id"), "crowd")
    rows = lists.join(long, "key", "left_anti") if (several := not crowd.isEmpty()) else lists
    rows = rows.select("key", "id", "component", F.lit(None).cast("binary").alias("rare"), F.lit(1).alias("_blocks"))
    if several:
        anew = written(rare_lists(crowd, threshold), "rare")
        sizes = anew.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1")
        anew = anew.join(sizes, "key").withColumn("_blocks", F.expr(f"int((_n + {BLOCK - 1}) div {BLOCK})"))
        rows = rows.unionByName(anew.drop("_n"))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    rows = rows.join(sets, "id").withColumn("_other", F.explode(F.expr("sequence(0, _blocks - 1)")))
    cells = rows.select(
        F.col("rare").isNull().alias("by_run"),
        "key",
        F.least("_block", "_other").alias("x"),
        F.greatest("_block", "_other").alias("y"),
        (F.col("_block") > F.col("_other")).alias("right"),
        "id", "component", "n", "sketch", "rare",
    )
    # Little data but much work: as many tasks as there are shuffle partitions.
    tasks = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = ["by_run", "key", "x", "y"]
    cells = cells.repartition(tasks, *place).sortWithinPartitions(*place)

    bands = run_bands(threshold)

    def shared(values: list[np.ndarray]) -> np.ndarray:
        """How many values each two rows have in common."""
        _, at, seen = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        column = np.cumsum(seen > 1) - 1
        owner = np.repeat(np.arange(len(values)), [len(v) for v in values])
        several = seen[at] > 1
        grid = np.zeros((len(values), int((seen > 1).sum()) // 64 * 64 + 64), bool)
        grid[owner[several], column[at[several]]] = True
        bits = np.packbits(grid, axis=1).view(np.uint64)
        return np.stack([np.bitwise_count(row & bits).sum(1, dtype=np.int64) for row in bits])

    def compare(key: int, rows: list[tuple]) -> list[tuple[int, int]]:
        right, whole, n = (np.array([r[i] for r in rows]) for i in (0, 2, 3))
        good = whole[:, None] != whole[None, :]
        good &= np.minimum(n[:, None], n[None, :]) >= threshold * np.maximum(n[:, None], n[None, :]) - 1e-6
        if right.any():
            good &= right[:, None] != right[None, :]
        if not good.any():
            return []
        # A pair that shares a smaller key is compared in that list.
        mine = np.uint64(key % (1 << 64))
        keys = [
            _keys(r[3], r[4], threshold, bands) if r[5] is None else np.frombuffer(r[5], "<u4").astype(np.uint64)
            for r in rows
        ]
        good &= shared([k[: np.searchsorted(k, mine)] for k in keys]) == 0
        if not good.any():
            return []
        values = [np.frombuffer(r[4], "<u4") for r in rows]
        lengths = np.array([len(v) for v in values])
        least = np.minimum(lengths[:, None], lengths[None, :])
        good &= shared(values) >= (threshold - _slack(threshold, SKETCH)) * least - 1e-6
        found = []
        for i, j in zip(*np.nonzero(np.triu(good, 1))):
            a, b = sorted((rows[i], rows[j]), key=lambda r: r[1])
            if _likely(a[4], b[4], a[3], b[3], threshold):
                found.append((a[1], b[1]))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            found = []
            for by_run, key, x, y, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (by_run, key, x, y):
                    if len(held) > 1:
                        found += compare(at[1], held)
                    at, held = (by_run, key, x, y), []
                held.append(row)  # right, id, component, n, sketch, rare
            yield _pairs(found)
        yield _pairs(compare(at[1], held) if len(held) > 1 else [])

    # A pair may be on lists of both kinds.
    return arrow_rows(cells, run, "a long, b long").distinct()


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _opened(lists: DataFrame, labels: DataFrame | None, slots: int) -> tuple[DataFrame, DataFrame]:
    """The members ``(key, id, component)`` of lists with several components, and their hubs."""
    lists = lists.select("key", "id")
    if labels is None:
        lists = lists.withColumn("component", F.col("id"))
    else:
        lists = lists.join(labels, "id", "left").select(
            "key", "id", F.coalesce("component", "id").alias("component")
        )
    slot_of = F.pmod(F.xxhash64("id"), F.lit(slots))
    firsts = [F.min(F.when(slot_of == i, F.struct("id", "component"))) for i in range(slots)]
    hubs = (
        lists.groupBy("key")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.array(*firsts).alias("hubs"))
        .filter("low < high")
        .select("key", "hubs")
    )
    hubs = written(hubs, "hubs")
    return written(lists.join(hubs.select("key"), "key", "left_semi"), "lists"), hubs


def _hub_pairs(lists: DataFrame, hubs: DataFrame) -> DataFrame:
    return (
        lists.join(hubs, "key")
        .select("id", "component", F.explode("hubs").alias("hub"))
        .filter(F.col("hub.component") != F.col("component"))
        .select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b"))
        .distinct()
    )


def _sized(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs with sizes and sketches of both sides, of those whose sizes allow the threshold."""
    sides = [
        sets.select(
            F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}")
        )
        for side in "ab"
    ]
    sized = pairs.join(sides[0], "a").join(sides[1], "b")
    return sized.filter(
        (F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-6)
    )
