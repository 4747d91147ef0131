"""Near-duplicate groups: MinHash bands, sequential Bayesian verification, exact check of the survivors.

A document's set holds its distinct shingles. Equal sets are one class from the start and are represented by the least id, so copies make
no pairs. Signatures of 48 bands of six rows give candidates: sets of similarity 0.8 share no band with a chance of 5e-7. The signature
bytes of a candidate pair are compared in batches; after each the pair is dropped when the posterior chance of reaching the threshold,
from a uniform prior, is below ``MISS``. Survivors are compared on their full sets.

Members of a band's bucket are first compared with its least and greatest member and one drawn by a hash, best shared pair first. Buckets whose
members then all belong to one component have nothing left to find. The members of the others form crowds, joined by shared buckets.
Within a crowd shingles are ordered from rare to frequent, and a set's prefix holds those that a link's first shared shingle can be: two
sets link only if they share a shingle so early in both that enough shingles follow it. A member of each bucket with the least share of rare
shingles is compared with the others; then members outside the crowd's largest component look for partners by prefix. What a large group
has in common stands at the end of the order, so it makes no pairs, and no link that could join two components is left out. Frequencies come
from a table of fixed size; where it mixes shingles up, the order is less good and the links are the same.

Defined results: a NULL, empty or blank text has an empty set and is linked with nothing. Texts with fewer words than a shingle have their
whole sequence as one shingle. Rows with the same doc_id and set share a component; a document without an id is linked by equal
sets only. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.llm.common import most_tasks, stored
from bidloom.llm.components import connected, extended
from bidloom.llm.words import mix64, shingles, span_hashes, split_words

BANDS, ROWS, BATCH, MISS, PERCENT = 48, 6, 32, 1e-9, 80
FILTER_BITS = 1 << 24
SLOT_BITS = 20  # of the table of shingle frequencies
SIZE_STEP = 1.05  # ratio of neighbouring classes of set sizes
_SEEDS = mix64(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64))
_A = (_SEEDS[: BANDS * ROWS] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (_SEEDS[BANDS * ROWS :] >> np.uint64(32)).astype(np.uint32)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    for w in split_words(column):
        hashes = span_hashes(w.data, w.starts, w.ends)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
            yield np.unique(shingles(hashes[a:b], k))


def signature(members: np.ndarray) -> np.ndarray:
    """The least value of the set under each of the BANDS x ROWS hash functions."""
    values = (members >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(values), 2048):
        block = _A[:, None] * values[None, at : at + 2048]
        block += _B[:, None]
        np.minimum(least, block.min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    folded = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        folded = mix64(folded * np.uint64(0x9E3779B97F4A7C15) + row)
    return folded.view(np.int64)


def class_id(members: np.ndarray) -> int:
    """The number that stands for all equal sets."""
    return int(mix64(mix64(members).sum(keepdims=True) + np.uint64(len(members))).view(np.int64)[0])


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, set_id, bands, sig) of every document; those of an empty set are NULL."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, ids, bands, sigs = [], [], [], []
                for members in shingle_sets(part.column(1), k):
                    sizes.append(len(members))
                    if not len(members):
                        ids.append(None), bands.append(None), sigs.append(None)
                        continue
                    least = signature(members)
                    ids.append(class_id(members))
                    bands.append(band_keys(least))
                    sigs.append((least & np.uint32(255)).astype(np.uint8).tobytes())
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
                arrays = [part.column(0), *[pa.array(v, t) for v, t in zip((sizes, ids, bands, sigs), kinds)]]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "set_id", "bands", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n bigint, set_id bigint, bands array<bigint>, sig binary")


def least_matches(threshold: float, miss: float = MISS, batch: int = BATCH, total: int = BANDS * ROWS) -> np.ndarray:
    """For each number of compared bytes the least number of equal ones at which the posterior chance of ``threshold`` is not below ``miss``."""
    similarity = (np.arange(20_000) + 0.5) / 20_000
    equal = similarity + (1 - similarity) / 256
    out = []
    for n in range(batch, total + 1, batch):
        for m in range(n + 1):
            log = m * np.log(equal) + (n - m) * np.log1p(-equal)
            weight = np.exp(log - log.max())
            if weight[similarity >= threshold].sum() >= miss * weight.sum():
                out.append(m)
                break
    return np.array(out)


def likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that no batch of signature bytes rules out, with the ids of both representatives."""
    side = lambda s: reps.select(F.col("set_id").alias(s), F.col("doc_id").alias(f"doc_{s}"), F.col("n").alias(f"n_{s}"), F.col("sig").alias(f"sig_{s}"))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    fits = joined.filter((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & F.col("doc_a").isNotNull() & F.col("doc_b").isNotNull())
    kind = reps.schema["doc_id"].dataType.simpleString()
    floor = least_matches(percent / 100)  # once, not in every task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = BANDS * ROWS
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, size) for i in (4, 5))
            alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for step, least in enumerate(floor):
                cut = slice(step * BATCH, (step + 1) * BATCH)
                matches[alive] += (x[alive, cut] == y[alive, cut]).sum(axis=1)
                alive = alive[matches[alive] >= least]
            yield batch.select(["a", "b", "doc_a", "doc_b"]).take(pa.array(alive))

    return fits.select("a", "b", "doc_a", "doc_b", "sig_a", "sig_b").mapInArrow(run, f"a bigint, b bigint, doc_a {kind}, doc_b {kind}")


def _id_filter(ids: DataFrame):
    """A bitmap of fixed size over hashes of ids, to keep texts that no pair needs out of the shuffle."""
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    words = ids.groupBy(F.shiftright(bit, 5).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(31).cast("int"))).alias("bits"))
    rows = words.toArrow()  # at most FILTER_BITS / 32
    bitmap = np.zeros(FILTER_BITS // 32, np.uint32)
    bitmap[rows["w"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint32)
    return ids.sparkSession.sparkContext.broadcast(bitmap)


def _needed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    bitmap = _id_filter(ids)

    @F.pandas_udf("boolean")
    def wanted(bit):
        at = bit.to_numpy()
        import pandas as pd

        return pd.Series((bitmap.value[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool))

    return docs.filter(wanted(F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))))


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    ids = pairs.select(F.col("doc_a").alias("id")).unionAll(pairs.select(F.col("doc_b").alias("id")))
    texts = _needed(docs.select("doc_id", "text"), ids)
    side = lambda s: texts.select(F.col("doc_id").alias(f"doc_{s}"), F.col("text").alias(f"text_{s}"))
    joined = pairs.join(side("a"), "doc_a").join(side("b"), "doc_b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for i, (x, y) in enumerate(zip(shingle_sets(part.column(2), k), shingle_sets(part.column(3), k))):
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * shared >= percent * (len(x) + len(y) - shared) > 0:
                        keep.append(at + i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return joined.mapInArrow(run, "a bigint, b bigint").distinct()


def crowd_sets(crowd: DataFrame, reps: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(set_id, grp, members) of every (set_id, grp): the set's shingles in order of their hashes."""
    named = crowd.join(reps.select("set_id", "doc_id"), "set_id").filter("doc_id is not null")
    texts = _needed(docs.select("doc_id", "text"), named.select(F.col("doc_id").alias("id")))
    joined = named.join(texts, "doc_id").select("set_id", "grp", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                wanted, rows, sets = part.column(0).to_pylist(), [], []
                for i, members in enumerate(shingle_sets(part.column(2), k)):
                    if len(members) and class_id(members) == wanted[i]:  # another row may bear the same doc_id
                        rows.append(i), sets.append(members.view(np.int64))
                kept = part.select(["set_id", "grp"]).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sets, pa.list_(pa.int64()))], ["set_id", "grp", "members"])

    return joined.mapInArrow(run, "set_id bigint, grp bigint, members array<bigint>").dropDuplicates(["set_id"])


def _slots(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every row (set_id, grp, members) the shingles and their places in the table of frequencies."""
    for grp, members in zip(batch.column(1).to_numpy(), batch.column(2)):
        values = members.values.to_numpy().view(np.uint64)
        own = mix64(np.array([grp], np.int64).view(np.uint64))
        yield values, (mix64(values ^ own) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(grp, shingle, set_id, n, pos, room, size_class, rarity) of the shingles that can be the first shared one of a link.

    ``room`` is the greatest size of a partner whose first shared shingle is this one, ``size_class`` the least size of the set's own class.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                slot, n = np.unique(np.concatenate([slots for _, slots in _slots(batch)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(n.astype(np.int64))], ["slot", "n"])

    counted = sets.mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).filter("n > 1").toArrow()
    table = np.ones(1 << SLOT_BITS, np.int64)
    table[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
    held = sets.sparkSession.sparkContext.broadcast(table)
    schema = "grp bigint, shingle bigint, set_id bigint, n bigint, pos bigint, room bigint, size_class bigint, rarity double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = size_classes()
        for batch in batches:
            set_ids, grps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, (values, slots) in enumerate(_slots(batch)):
                n, often = len(values), held.value[slots]
                pos = np.arange((100 - percent) * n // 100 + 1)
                first = values[np.lexsort((values, often))[: len(pos)]].view(np.int64)
                room = ((100 + percent) * (n - pos) - percent * n) // percent
                least = classes[np.searchsorted(classes, n, side="right") - 1]
                same = [np.full(len(pos), x) for x in (set_ids[row], n, least, (1 / often).mean())]
                columns = [np.full(len(pos), grps[row]), first, same[0], same[1], pos, room, same[2], same[3]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [f.split()[0] for f in schema.split(", ")])

    return sets.mapInArrow(run, schema)


def size_classes() -> np.ndarray:
    """Least sizes of the classes of set sizes, each within ``SIZE_STEP`` of the last."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * SIZE_STEP)))
    return np.array(out, np.int64)


def prefix_pairs(early: DataFrame, owned: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components of a crowd that share a shingle early enough in both.

    ``owned`` has (set_id, grp, root). Only members outside the crowd's largest component look for partners, each in the classes of sizes
    that its shingle leaves room for.
    """
    largest = owned.groupBy("grp", "root").count().groupBy("grp").agg(F.max_by("root", F.struct("count", "root")).alias("most"))
    classes = early.filter("pos = 0").groupBy("grp").agg(F.collect_set("size_class").alias("classes"))
    rooted = early.join(owned.select("set_id", "root"), "set_id")
    seekers = rooted.join(largest, "grp").filter("root <> most").join(classes, "grp")
    fits = F.filter("classes", lambda c: (c <= F.col("room")) & (100 * (c * SIZE_STEP + 1) >= percent * F.col("n")))
    end = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("set_id", "root", "n", "pos", "room")]
    left = seekers.select("grp", "shingle", F.explode(fits).alias("size_class"), *end("u"))
    right = rooted.select("grp", "shingle", "size_class", *end("v"))
    met = left.join(right, ["grp", "shingle", "size_class"]).filter("root_u <> root_v and n_v <= room_u and n_u <= room_v")
    return met.select(F.least("set_id_u", "set_id_v").alias("a"), F.greatest("set_id_u", "set_id_v").alias("b")).distinct()


def confirmed_sets(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets, both at hand in ``sets``, reach the threshold."""
    side = lambda s: sets.select(F.col("set_id").alias(s), F.col("members").alias(f"set_{s}"))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return joined.mapInArrow(run, "a bigint, b bigint")


def near_groups(docs: DataFrame, shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least id of its component), kept."""
    sigs = stored(signatures(docs, shingle), "signatures")
    tasks = most_tasks(docs.sparkSession, len(sigs.inputFiles()))
    put, join_up, widen = (partial(f, tasks=tasks) for f in (stored, connected, extended))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "n", "sig", "bands")).alias("r")
    reps = put(sigs.filter("n > 0").groupBy("set_id").agg(least).select("set_id", "r.doc_id", "r.n", "r.sig", "r.bands"), "classes")
    banded = reps.select("set_id", F.explode("bands").alias("key"))
    drawn = F.min_by("set_id", F.xxhash64("key", "set_id")).alias("drawn")
    ends = banded.groupBy("key").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high"), drawn).filter("low <> high")
    members = put(banded.join(ends, "key"), "buckets")

    starred = reduce(DataFrame.unionAll, [members.filter(f"set_id <> {c}").select("set_id", F.col(c).alias("center")) for c in ("low", "high", "drawn")])
    stars = put(starred.select(F.col("set_id").alias("a"), F.col("center").alias("b")).groupBy("a", "b").count(), "stars")
    best = stars.groupBy("a").agg(F.max(F.struct("count", "b"))["b"].alias("b"))

    def checked(pairs: DataFrame, name: str) -> DataFrame:
        survivors = put(likely(pairs, reps, percent), f"{name}-likely")
        return put(confirmed(survivors, docs, shingle, percent), f"{name}-links")

    def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs whose ends are not yet known to belong together."""
        end = lambda s: roots.select(F.col("node").alias(s), F.col("root").alias(f"root_{s}"))
        rooted = pairs.join(end("a"), "a", "left").join(end("b"), "b", "left")
        return rooted.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    roots = join_up(checked(best, "best"))
    roots = widen(roots, checked(apart(stars, roots), "star"))

    rooted = members.join(roots, members["set_id"] == roots["node"], "left").select("key", "set_id", "low", F.coalesce("root", "set_id").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("key")
    left = put(rooted.join(mixed, "key").select("key", "set_id", "low"), "left-over")
    crowds = join_up(left.select(F.col("set_id").alias("a"), F.col("low").alias("b"))).select(F.col("node").alias("set_id"), F.col("root").alias("grp"))
    crowd = left.select("set_id").distinct().join(crowds, "set_id", "left").select("set_id", F.coalesce("grp", "set_id").alias("grp"))
    sets = put(crowd_sets(put(crowd, "crowds"), reps, docs, shingle), "crowd-sets")
    early = put(prefixes(sets, percent), "prefixes")

    def checked_sets(pairs: DataFrame, name: str) -> DataFrame:
        survivors = put(likely(pairs, reps, percent), f"{name}-likely")
        return put(confirmed_sets(survivors, sets, percent), f"{name}-links")

    rare = left.select("key", "set_id").join(early.filter("pos = 0").select("set_id", "rarity"), "set_id")
    plain = rare.groupBy("key").agg(F.min(F.struct("rarity", "set_id"))["set_id"].alias("b"))
    roots = widen(roots, checked_sets(apart(rare.select("key", F.col("set_id").alias("a")).join(plain, "key").select("a", "b"), roots), "plain"))
    placed = sets.select("set_id", "grp").join(roots, sets["set_id"] == roots["node"], "left").select("set_id", "grp", F.coalesce("root", "set_id").alias("root"))
    rest = prefix_pairs(early, put(placed, "placed"), percent)
    roots = widen(roots, checked_sets(rest, "rest"))

    owned = reps.select("set_id", "doc_id").join(roots, reps["set_id"] == roots["node"], "left").select("set_id", "doc_id", F.coalesce("root", "set_id").alias("root"))
    named = owned.join(owned.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("set_id", "component_id")
    result = sigs.select("doc_id", "n", "set_id").join(named, "set_id", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return result.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without those whose component has a lesser id."""
    dropped = near_groups(docs, shingle, percent).filter("not kept").select(F.col("doc_id").alias("dropped_id")).distinct()
    return docs.join(dropped, docs["doc_id"] == F.col("dropped_id"), "left_anti")
