"""Near-duplicate groups with a forest of sorted MinHash signatures.

Documents with equal shingle sets are one class. TREES orders sort the classes'
signatures, each by its own DEPTH hash values. In every order the neighbours with
the longest common prefix, and the head of the region that shares the first
FIRST_DEPTH values, are candidates; those links join most of each group. Then
only regions that still hold several components are looked at, each at the least
depth at which it has at most REGION members, or in runs of REGION where even the
full depth leaves more. Candidates there are pairs of different components whose
signatures agree as links nearly always do: all pairs of a few members, else every
member with its neighbours in the order and with the most central members, those
whose signatures are nearest to the region's commonest values. A variant is most
like the text that the others vary too, so the work stays in proportion to the
members. All links are confirmed on the full shingle sets.

What is then still apart in regions with more members than are all compared,
however large, is compared by an exact prefix filter: two similar sets share one of
the rarest shingles of each, as many as may be missing from a link and one more.
Members are put into blocks; blocks meet that hold members of different components
sharing such a shingle, early enough in both orders to leave room for a link, and
all their members are compared on the full sets by counting common shingles.

At similarity 0.8 the chance that no order brings a pair together at the first
depth is (1 - 0.8**3)**24 < 4e-8.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtledger.llm.components import connected_components
from courtledger.llm.hash_filter import contains, hash_filter
from courtledger.llm.texts import LOWER, SPACES, distinct, mix, seeded, shingles, slices, text_bytes, word_hashes, words
from courtledger.session import checkpointed, fresh_folder

TREES, DEPTH, FIRST_DEPTH = 24, 6, 3
VALUES = TREES * DEPTH
REGION = 512  # classes looked at together; larger regions go deeper, then into runs, before the exact join
CENTRAL = 8  # members that all others of a region are compared with
COUNTERS = 20  # bits of a shingle that choose its counter; rarity only orders the shingles
BLOCK_SETS, BLOCK_SHINGLES = 1_024, 1 << 20  # about as many make a block of sets compared with another
FEW = 16  # sets of a block; shingles that more of them hold are counted by matrix product
COLUMNS = 4_096  # shingles in one product

_FACTORS = seeded(7, VALUES) | np.uint64(1)


def shingle_sets(part: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes and the row each belongs to."""
    raw, at = text_bytes(part.column("text"))
    raw = LOWER[raw]
    starts, ends, row = words(raw, at, SPACES)
    return distinct(*shingles(word_hashes(raw, starts, ends), row, size))


def set_keys(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128 bits that stand for each set, whatever the order: two sums of mixed values."""
    if not len(first):
        return np.zeros((0, 2), np.uint64)
    return np.stack([np.add.reduceat(mix(values ^ s), first) for s in seeded(8, 2)], axis=1)


def binaries(data: np.ndarray, present: np.ndarray, rows: int) -> pa.Array:
    """One fixed-size binary for each present row, null for the others."""
    width = data.dtype.itemsize * data.shape[1]
    full = np.zeros((rows, width), np.uint8)
    full[present] = np.ascontiguousarray(data).view(np.uint8).reshape(-1, width)
    mask = np.ones(rows, bool)
    mask[present] = False
    flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), rows, [None, pa.py_buffer(full.tobytes())])
    return pc.if_else(pa.array(mask), None, flat.cast(pa.binary()))


def _first(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each row begins, and which rows there are."""
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    return first, rows[first]


SKETCH = "doc_id long, text_key long, n_shingles long, cls binary, sig binary"


def _sketches(size: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                values, rows = shingle_sets(part, size)
                first, present = _first(rows)
                sig = np.empty((len(first), VALUES), ">u4")
                for k in range(VALUES):
                    if len(first):
                        sig[:, k] = np.minimum.reduceat(values * _FACTORS[k], first) >> np.uint64(32)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("text_key"), pa.array(np.bincount(rows, minlength=part.num_rows), pa.int64()),
                    binaries(set_keys(values, first), present, part.num_rows), binaries(sig, present, part.num_rows),
                ], ["doc_id", "text_key", "n_shingles", "cls", "sig"])
    return sketch


def _matrix(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    flat = column.cast(pa.binary(width * np.dtype(dtype).itemsize))
    return np.frombuffer(flat.buffers()[1], dtype)[flat.offset * width:(flat.offset + len(flat)) * width].reshape(-1, width)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each class once per order: the region at the first depth, and the rest of its label."""
    for batch in batches:
        for k in range(0, batch.num_rows, 1024):
            part = batch.slice(k, 1024)
            n = part.num_rows
            sig = _matrix(part.column("sig"), ">u4", VALUES).reshape(n, TREES, DEPTH)
            region = np.broadcast_to(seeded(9, TREES), (n, TREES)).copy()
            for d in range(FIRST_DEPTH):
                region = mix(region + sig[:, :, d].astype(np.uint64))
            label = np.ascontiguousarray(sig[:, :, FIRST_DEPTH:]).reshape(n * TREES, DEPTH - FIRST_DEPTH)
            yield pa.RecordBatch.from_arrays([
                pa.array(region.view(np.int64).ravel()), binaries(label, np.arange(n * TREES), n * TREES),
                part.column("cls").take(pa.array(np.repeat(np.arange(n), TREES))),
            ], ["region", "label", "cls"])


def least_agreement(percent: int) -> int:
    """Signature values that links share in all but about one of 10**9 cases."""
    s = percent / 100
    return max(1, math.floor(VALUES * s - 6 * math.sqrt(VALUES * s * (1 - s))))


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree enough."""
    need = least_agreement(percent)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = (_matrix(batch.column("sa"), ">u4", VALUES) == _matrix(batch.column("sb"), ">u4", VALUES)).sum(axis=1)
                yield batch.select(["a", "b"]).filter(pa.array(same >= need))

    both = pairs.join(classes.select(F.col("cls").alias("a"), F.col("sig").alias("sa")), "a")
    both = both.join(classes.select(F.col("cls").alias("b"), F.col("sig").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(keep, "a binary, b binary")


def _sets(size: int, wanted: Broadcast):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                values, rows = shingle_sets(part, size)
                first, _ = _first(rows)
                keys = set_keys(values, first)
                ends = np.append(first, len(values))[1:]
                take = np.flatnonzero(contains(wanted.value, keys[:, 0]))
                yield pa.RecordBatch.from_arrays([
                    binaries(keys[take], np.arange(len(take)), len(take)),
                    pa.array([values[first[k]:ends[k]].tobytes() for k in take], pa.binary()),
                ], ["cls", "members"])
    return sets


def _members(needed: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """cls and members (the sorted shingle hashes) of the classes in needed, a column cls."""

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_matrix(batch.column("cls"), "<u8", 2)[:, 0].view(np.int64))], ["half"])

    wanted = hash_filter(needed.mapInArrow(halves, "half long"), "half")
    sets = rows.select("text").mapInArrow(_sets(size, wanted), "cls binary, members binary").join(needed, "cls", "left_semi")
    return sets.groupBy("cls").agg(F.first("members").alias("members"))


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column("ma"), batch.column("mb"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[k] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("members").alias("ma")), "a")
    both = both.join(sets.select(F.col("cls").alias("b"), F.col("members").alias("mb")), "b")
    return both.select("a", "b", "ma", "mb").mapInArrow(confirm, "a binary, b binary")


def _confirmed(pairs: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets, made from the rows, are similar enough."""
    needed = checkpointed(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct())
    return _similar(pairs, _members(needed, rows, size), percent)


def _rarities(sets: DataFrame) -> Broadcast:
    """About how many sets hold a shingle, by its first COUNTERS bits."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << COUNTERS, np.int64)
        for batch in batches:
            for part in slices(batch, "members"):
                values = np.frombuffer(b"".join(part.column("members").to_pylist()), np.uint64)
                n += np.bincount((values >> np.uint64(64 - COUNTERS)).astype(np.int64), minlength=len(n))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used])], ["at", "n"])

    found = sets.select("members").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(1 << COUNTERS, np.int64)
    n[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return sets.sparkSession.sparkContext.broadcast(n)


PREFIX = "shingle long, block long, root binary, rest long, n long"


def _blocks(sets: DataFrame) -> DataFrame:
    """The sets with their block: members of one family, or of one large component, of about one size."""
    n = F.octet_length("members") / 8
    sized = sets.withColumn("bits", F.ceil(F.log2(n)).cast("int"))
    large = sized.groupBy("root").agg(F.count("*").alias("k")).where(F.col("k") >= BLOCK_SETS).select("root", F.xxhash64("root").alias("own"))
    sized = sized.join(large, "root", "left").withColumn("family", F.coalesce("own", "family")).drop("own")
    share = F.greatest(F.pow(F.lit(2.0), F.col("bits")) / BLOCK_SHINGLES, F.lit(1 / BLOCK_SETS))
    cuts = sized.groupBy("family", "bits").agg(F.count("*").alias("k")).select("family", "bits", F.ceil(F.col("k") * share).alias("cuts"))
    block = F.xxhash64("family", "bits", F.pmod(F.xxhash64("cls"), F.col("cuts")))
    return sized.join(cuts, ["family", "bits"]).select("cls", "root", block.alias("block"), "members")


def _prefixes(percent: int, rarities: Broadcast):
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rarest shingles of each set, one of which every similar set has among its own rarest."""
        for batch in batches:
            for part in slices(batch, "members"):
                n = pc.binary_length(part.column("members")).to_numpy().astype(np.int64) // 8
                values = np.frombuffer(b"".join(part.column("members").to_pylist()), np.uint64)
                row = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((values, rarities.value[(values >> np.uint64(64 - COUNTERS)).astype(np.int64)], row))
                place = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
                take = place <= (n - -(-n * percent // 100))[row]
                at = pa.array(row[take])
                yield pa.RecordBatch.from_arrays([
                    pa.array(values[order][take].view(np.int64)), part.column("block").take(at), part.column("root").take(at),
                    pa.array((n[row] - place)[take]), pa.array(n[row][take]),
                ], ["shingle", "block", "root", "rest", "n"])
    return prefixes


def _meeting(prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs of blocks (x, y) with members of different components that share a shingle early enough."""
    x = prefixes.select(*(F.col(c).alias(f"{c}_x") for c in prefixes.columns))
    y = prefixes.select(*(F.col(c).alias(f"{c}_y") for c in prefixes.columns))
    room = (100 + percent) * F.least("rest_x", "rest_y") >= percent * (F.col("n_x") + F.col("n_y"))
    apart = F.least("low_x", "low_y") < F.greatest("high_x", "high_y")
    met = x.join(y, (F.col("shingle_x") == F.col("shingle_y")) & (F.col("block_x") <= F.col("block_y")) & room & apart)
    return met.select(F.col("block_x").alias("x"), F.col("block_y").alias("y")).distinct()


def _common(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], shape: tuple[int, int], kinds: int) -> np.ndarray:
    """How many columns each row of x shares with each of y, both given as (row, column) of their entries."""
    held = np.bincount(y[1], minlength=kinds)
    out = np.zeros(shape[0] * shape[1], np.int64)
    order = np.argsort(y[1], kind="stable")
    first = np.cumsum(held) - held
    few = held[x[1]] <= FEW
    row, column = x[0][few], x[1][few]
    times = held[column]
    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    other = y[0][order[np.repeat(first[column], times) + step]]
    out += np.bincount(np.repeat(row, times) * shape[1] + other, minlength=len(out))
    out = out.reshape(shape)
    many = np.flatnonzero((held > FEW) & (np.bincount(x[1], minlength=kinds) > 0))
    number = np.full(kinds, -1)
    number[many] = np.arange(len(many))
    for start in range(0, len(many), COLUMNS):
        sides = []
        for (row, column), rows in zip((x, y), shape, strict=True):
            at = number[column] - start
            here = (at >= 0) & (at < COLUMNS)
            side = np.zeros((rows, COLUMNS), np.float32)
            side[row[here], at[here]] = 1
            sides.append(side)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def _links_between(percent: int):
    def links(group: pa.Table) -> pa.Table:
        """All similar pairs of different components between two blocks, or inside one."""
        group = group.combine_chunks()
        block = group.column("block").to_numpy()
        rows = [np.flatnonzero(block == group.column(c)[0].as_py()) for c in ("x", "y")]
        members = group.column("members").to_pylist()
        sets = [np.frombuffer(m, np.uint64) for m in members]
        n = np.array([len(v) for v in sets])
        kinds, column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(n)), n)
        place, entries = np.full(len(n), -1), []
        for own in rows:
            place[:] = -1
            place[own] = np.arange(len(own))
            inside = place[row] >= 0
            entries.append((place[row[inside]], column[inside]))
        both = _common(entries[0], entries[1], (len(rows[0]), len(rows[1])), len(kinds))
        root = group.column("root").combine_chunks().dictionary_encode().indices.to_numpy()
        good = 100 * both >= percent * (n[rows[0]][:, None] + n[rows[1]][None, :] - both)
        good &= root[rows[0]][:, None] != root[rows[1]][None, :]
        a, b = np.nonzero(good)
        cls = group.column("cls").combine_chunks()
        return pa.table({"a": cls.take(pa.array(rows[0][a])), "b": cls.take(pa.array(rows[1][b]))})

    return links


def _similar_between(meeting: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) between the members of blocks that meet."""
    sides = meeting.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    return sides.join(sets, "block").select("x", "y", "block", "cls", "root", "members").groupBy("x", "y").applyInArrow(_links_between(percent), "a binary, b binary")


def _crossing(percent: int):
    need = least_agreement(percent)

    def crossing(group: pa.Table) -> pa.Table:
        """Candidate pairs of one region in different components whose signatures agree enough."""
        group = group.combine_chunks().sort_by([("label", "ascending"), ("cls", "ascending")])
        n = len(group)
        sig = _matrix(group.column("sig").combine_chunks(), ">u4", VALUES)
        roots = group.column("root").combine_chunks().dictionary_encode().indices.to_numpy()
        if n <= 2 * CENTRAL:
            a, b = np.triu_indices(n, 1)
        else:
            commonest = np.empty(VALUES, sig.dtype)
            for k in range(VALUES):
                values, counts = np.unique(sig[:, k], return_counts=True)
                commonest[k] = values[counts.argmax()]
            central = np.argsort(-(sig == commonest).sum(axis=1), kind="stable")[:CENTRAL]
            ahead = [np.stack([np.arange(n - d), np.arange(d, n)]) for d in (1, 2, 3)]
            a, b = np.concatenate([np.stack([np.tile(np.arange(n), CENTRAL), np.repeat(central, n)]), *ahead], axis=1)
        apart = roots[a] != roots[b]
        a, b = a[apart], b[apart]
        alike = (sig[a] == sig[b]).sum(axis=1) >= need
        pairs = np.unique(np.sort(np.stack([a[alike], b[alike]]), axis=0), axis=1)
        cls = group.column("cls").combine_chunks()
        return pa.table({"a": cls.take(pa.array(pairs[0])), "b": cls.take(pa.array(pairs[1]))})

    return crossing


def _regions(members: DataFrame) -> DataFrame:
    """The region of each member: the least depth at which it has at most REGION members, else a run of as many."""
    prefixes = [F.substring("label", 1, 4 * d) for d in range(DEPTH - FIRST_DEPTH + 1)]
    sized = members
    for d, prefix in enumerate(prefixes):
        sized = sized.withColumn(f"n{d}", F.count("*").over(Window.partitionBy("region", prefix)))
    depth = F.lit(len(prefixes) - 1)
    for d in reversed(range(len(prefixes) - 1)):
        depth = F.when(F.col(f"n{d}") <= REGION, d).otherwise(depth)
    place = F.row_number().over(Window.partitionBy("region", "label").orderBy("cls")) - 1
    sized = sized.withColumn("depth", depth)
    run = F.when(F.col("depth") == len(prefixes) - 1, F.floor(place / REGION)).otherwise(0).cast("int")
    return sized.select("region", F.substring("label", F.lit(1), 4 * F.col("depth")).alias("part"), run.alias("run"), "label", "cls", "root")


def _placed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members with the roots of their components."""
    placed = members.select("region", "label", "cls").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    return placed.withColumn("root", F.coalesce("root", "cls"))


def _mixed(placed: DataFrame) -> DataFrame:
    """Regions of several components, and their members' number n."""
    return placed.groupBy("region").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The roots when links between components join these."""
    ends = links
    for end in ("a", "b"):
        ends = ends.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    between = ends.select(*(F.coalesce(f"root_{e}", e).alias(e) for e in ("a", "b")))
    upper = connected_components(between).select(F.col("node").alias("root"), F.col("root").alias("top"))
    lower = roots.join(upper, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = upper.join(roots.select("root"), "root", "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))
    return checkpointed(lower.union(alone))


def duplicate_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_key, n_shingles, root (the group; null without shingles), component_id of every document."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    folder = fresh_folder(spark, "forest")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    sketches = stored(rows.mapInArrow(_sketches(size), SKETCH), "sketches")
    classes = stored(sketches.where("cls is not null").groupBy("cls").agg(F.first("sig").alias("sig"), F.min("doc_id").alias("least_id")), "classes")

    order = Window.partitionBy("region").orderBy("label", "cls")
    forest = classes.select("cls", "sig").mapInArrow(_forest, "region long, label binary, cls binary")
    near = forest.select("*", F.lag("cls").over(order).alias("prev"), F.lead("cls").over(order).alias("next"), F.first("cls").over(order).alias("head"))
    members = stored(near.where("prev is not null or next is not null").drop("next"), "members")

    meets = members.where("prev is not null").select(F.explode(F.array("prev", "head")).alias("x"), "cls").where("x <> cls")
    pairs = meets.select(F.least("x", "cls").alias("a"), F.greatest("x", "cls").alias("b")).distinct()
    likely = stored(_likely(pairs, classes, percent), "likely")
    links = stored(_confirmed(likely, rows, size, percent), "links")
    roots = connected_components(links)

    placed = _placed(members, roots)
    mixed = _mixed(placed).where("n > 2").select("region")
    regions = _regions(placed.join(mixed, "region", "left_semi")).join(classes.select("cls", "sig"), "cls")
    crossing = regions.select("region", "part", "run", "label", "cls", "root", "sig").groupBy("region", "part", "run").applyInArrow(_crossing(percent), "a binary, b binary")
    more = crossing.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(likely, ["a", "b"], "left_anti")
    more = stored(more, "more")
    if more.limit(1).count():
        more = stored(_confirmed(more, rows, size, percent), "more_links")
        roots = _merged(roots, more)

    # What is still apart where not all members were compared.
    placed = _placed(members, roots)
    apart = _mixed(placed).where(f"n > {2 * CENTRAL}").select("region", "n")
    left = placed.join(apart, "region").groupBy("cls").agg(F.first("root").alias("root"), F.max(F.struct("n", "region")).alias("most"))
    left = stored(left.select("cls", "root", F.col("most.region").alias("family")), "left")
    if left.limit(1).count():
        sets = stored(_blocks(_members(left.select("cls"), rows, size).join(left, "cls")), "sets")
        prefixes = sets.mapInArrow(_prefixes(percent, _rarities(sets)), PREFIX).groupBy("shingle", "block").agg(
            F.max("rest").alias("rest"), F.min("n").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
        meeting = stored(_meeting(stored(prefixes, "prefixes"), percent), "meeting")
        rest = stored(_similar_between(meeting, sets, percent), "rest_links")
        if rest.limit(1).count():
            roots = _merged(roots, rest)

    ids = classes.select("cls", "least_id").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = ids.groupBy("root").agg(F.min("least_id").alias("component_id"))
    found = ids.join(least, "root").select("cls", "root", "component_id")
    return sketches.select("doc_id", "text_key", "n_shingles", "cls").join(found, "cls", "left").select(
        "doc_id", "text_key", "n_shingles", "root", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The near-duplicate group of every document.

    docs: doc_id and text, other columns are ignored. Documents are linked when
    their sets of ``size``-word shingles (ASCII lower case) have a Jaccard
    similarity of ``percent`` or more; a text of fewer words is one shingle; null,
    empty and blank texts have none and are linked with nothing. One row per input
    row: doc_id, n_shingles, component_id (least doc_id reachable; a null doc_id
    counts only where there is no other), kept (doc_id is the component_id).
    Repeated rows are exact copies of each other.
    """
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return duplicate_groups(docs, size, percent).select("doc_id", "n_shingles", "component_id", kept)


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all their columns, one of each near-duplicate group: that of the least doc_id.

    Documents without words are all kept.
    """
    groups = duplicate_groups(docs, size, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
    chosen = groups.where("root is not null").groupBy("root").agg(first).select("first.doc_id", "first.text_key")
    chosen = checkpointed(chosen.union(groups.where("root is null").select("doc_id", "text_key").distinct()))
    extra = ["match_id", "match_key"]
    while set(extra) & set(docs.columns):
        extra = [f"_{c}" for c in extra]
    at = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))
    keyed = docs.withColumns({extra[0]: at, extra[1]: F.xxhash64("text")})
    kept = keyed.join(chosen.select(at.alias(extra[0]), F.col("text_key").alias(extra[1])), extra, "left_semi")
    # Equal rows share their keys; only of those is one to be chosen again.
    doubles = groups.where("root is not null").groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1")
    doubles = doubles.select(at.alias(extra[0]), F.col("text_key").alias(extra[1]))
    if doubles.limit(1).count():
        again = kept.join(doubles, extra, "left_semi").dropDuplicates(extra)
        kept = kept.join(doubles, extra, "left_anti").unionByName(again)
    return kept.select(*docs.columns)
