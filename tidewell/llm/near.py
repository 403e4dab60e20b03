"""MinHash near-dedup with fast similarity sketching.

In each round of a sketch every shingle is thrown into one bin with a random value, and an empty bin takes the
least; from round T on, round T + i throws every shingle into bin i, so after 2 T rounds each of the T
coordinates is filled whatever the size of the set. Bands of coordinates give the keys under which texts meet.

Texts with the same set are one class. In the bucket of a key every class meets the least one, so a bucket
costs a pair for each member. Classes that met, linked or not, are a group; a group of which several components are left may
hide links between two that only met a third. Classes outside its largest component look for those links among all of the
group by rare shingles: two sets that are similar enough share one of the rarest shingles of either, as many as the
smallest overlap leaves over. Common shingles are last in that order, so what a whole group has in common makes no pairs.
Every link is confirmed on the full sets of both texts; pairs of one group by tiles of two blocks of it, so that a text goes to a tile once and not to each of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.arrow import bounded_batches, free_name, lowered, mixed, quoted, span_hashes, text_slices, word_spans
from tidewell.llm.graph import components
from tidewell.session import written

#: A pair of similarity 0.8 meets under no key with probability (1 - 0.8 ** ROWS) ** BANDS, below 1e-6.
BANDS, ROWS = 80, 8
COORDINATES = BANDS * ROWS

#: A group's classes are compared in tiles of two blocks, each of about so many texts or bytes.
BLOCK_TEXTS, BLOCK_BYTES = 256, 4 << 20

_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_FULL = np.uint64(2**64 - 1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles, one text after the other, and the edges of texts."""
    low = lowered(data)
    starts, ends, word_at = word_spans(_IS_WORD[low], offsets)
    words = span_hashes(low, starts, ends)
    n = np.diff(word_at)
    odd = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
    h = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for j in range(size):
        h += words[j : len(words) - size + 1 + j] * odd[j]
    # A text of n words has n - size + 1 shingles; one of fewer words is a single one.
    counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    at = np.append(0, np.cumsum(counts))
    out = np.empty(at[-1], np.uint64)
    long = n >= size
    inner = np.repeat(word_at[:-1][long] - (np.cumsum(counts[long]) - counts[long]), counts[long]) + np.arange(counts[long].sum())
    out[np.repeat(long, counts)] = mixed(h[inner])
    for row in np.flatnonzero((n > 0) & ~long):
        total = int(n[row])
        for j, w in enumerate(words[word_at[row] : word_at[row + 1]]):
            total = (total + int(w) * int(odd[j]) * 3) % 2**64
        out[at[row]] = mixed(np.array([total], np.uint64))[0]
    for a, b in zip(at[:-1], at[1:], strict=True):
        out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[at[:-1][counts > 0]] = True
    return out[keep], np.append(0, np.cumsum(keep))[at]


def sketches(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """COORDINATES values for each set; sets without a value keep the largest number."""
    rows, t = len(at) - 1, COORDINATES
    out = np.full(rows * t, _FULL)
    empty = np.ones(rows * t, bool)
    owner = np.repeat(np.arange(rows), np.diff(at))
    for k in range(2 * t):
        if not len(values):
            break
        x = mixed(values + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) % 2**64))
        if k < t:
            slot = owner * t + ((x >> np.uint64(40)) * np.uint64(t) >> np.uint64(24)).astype(np.int64)
        else:
            slot = owner * t + (k - t)
        new = empty[slot]
        slot = slot[new]
        np.minimum.at(out, slot, (np.uint64(k) << np.uint64(52)) | (mixed(x[new]) >> np.uint64(12)))
        empty[slot] = False
        if k < 12 or k % 8 == 0:  # texts of which all bins are filled are done
            going = empty.reshape(rows, t).any(1)[owner]
            if not going.all():
                values, owner = values[going], owner[going]
    return out.reshape(rows, t)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    parts = mixed(sketch).reshape(len(sketch), BANDS, ROWS)
    salt = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
    weights = (2 * np.arange(1, ROWS + 1, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return mixed((parts * weights).sum(2, dtype=np.uint64) + salt).view(np.int64)


def profiles(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, set (two hashes that name the set) and keys (null for an empty set) of every row."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches):
            values, at = shingle_sets(data, offsets, size)
            n = np.diff(at)
            cum = [np.append(np.uint64(0), np.cumsum(mixed(values ^ np.uint64(s)), dtype=np.uint64)) for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
            names = [(c[at[1:]] - c[at[:-1]]).view(np.int64) for c in cum]
            keys = band_keys(sketches(values, at)).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(keys))
            some = pa.array(n > 0)
            lists = pc.if_else(some, lists, pa.scalar(None, lists.type))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_hash"), pa.array(n), *map(pa.array, names), lists], ["doc_id", "text_hash", "n_shingles", "k1", "k2", "keys"])

    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(sketch, f"doc_id {kind}, text_hash long, n_shingles long, k1 long, k2 long, keys array<long>")
    return found.select("doc_id", "text_hash", "n_shingles", F.struct("k1", "k2").alias("set"), "keys")


def similar(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    low = min(len(one), len(other))
    if not low or 100 * low < percent * max(len(one), len(other)):
        return False
    place = np.minimum(np.searchsorted(other, one), len(other) - 1)
    shared = int((other[place] == one).sum())
    return shared > 0 and 100 * shared >= percent * (len(one) + len(other) - shared)


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The ``pairs`` a, b of classes of whose sets 100 * intersection >= percent * union. texts: set, a name of the class of any type, and text of each."""
    one, two = (texts.select(F.col("set").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    rows = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub: tuple[object, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            for rows, data, offsets in text_slices(iter([batch]), "text_a"):
                values, at = shingle_sets(data, offsets, size)
                linked = []
                for k, b in enumerate(rows.column("b").to_pylist()):  # hubs come in order
                    if hub[0] != b:
                        raw = (rows.column("text_b")[k].as_py() or "").encode()
                        hub = b, shingle_sets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), size)[0]
                    linked.append(similar(values[at[k] : at[k + 1]], hub[1], percent))
                yield rows.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    kind = texts.schema["set"].dataType.simpleString()
    return rows.mapInArrow(compare, f"a {kind}, b {kind}")


def confirmed_in_tiles(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """As ``confirmed``, of pairs a, b with their group and blocks (``pairs_left``). A tile gets each text of its blocks that has a pair there once."""
    tile = ["group", "block", "block_b"]
    lists = written(pairs.groupBy(*tile, "a").agg(F.collect_list("b").alias("others")), "tiles")
    one, two = (texts.select(F.col("set").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    asking = lists.join(one, "a").select(*tile, "a", "text_a", "others")
    # The other side has names of its own, as both come from one table.
    its = [F.col(c).alias(f"its_{c}") for c in tile]
    asked = lists.select(*its, F.explode("others").alias("b")).distinct().join(two, "b").select(*[f"its_{c}" for c in tile], "b", "text_b")

    def sets(rows: pa.Table, text: str) -> Iterator[tuple[dict, np.ndarray]]:
        for part, data, offsets in text_slices(iter(rows.to_batches()), text):
            values, at = shingle_sets(data, offsets, size)
            for k, row in enumerate(part.drop_columns([text]).to_pylist()):
                yield row, values[at[k] : at[k + 1]]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        held = {row["b"]: values for row, values in sets(right, "text_b")}
        found = [(row["a"], b) for row, values in sets(left, "text_a") for b in row["others"] if similar(values, held[b], percent)]
        kinds = left.schema.field("a").type, right.schema.field("b").type
        return pa.table({c: pa.array([x[k] for x in found], kinds[k]) for k, c in enumerate("ab")})

    kind = texts.schema["set"].dataType.simpleString()
    return asking.groupBy(*tile).cogroup(asked.groupBy(*[f"its_{c}" for c in tile])).applyInArrow(compare, f"a {kind}, b {kind}")


def pairs_left(groups: DataFrame, labels: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b: pairs of one group of classes that met (``groups``) and of different components (``labels``) that may be similar, with the group and their blocks in it.

    a is outside its group's largest component. No pair that is similar enough is left out: with n shingles, n - ceil(percent * n / 100) + 1
    of them, the rarest in the group first, hold one of every such pair's shingles; and of the first that two sets share, what
    follows in both bounds how many they share.
    """
    of = groups.withColumnRenamed("label", "group").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    of = of.join(texts.select(F.col("set").alias("id"), F.octet_length("text").cast("long").alias("bytes")), "id", "left")
    sizes = of.groupBy("group", "label").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    blocks = F.ceil(F.greatest(F.sum("n") / BLOCK_TEXTS, F.sum("bytes") / BLOCK_BYTES, F.lit(1.0)))
    main = sizes.groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels"), blocks.alias("blocks")).filter("labels > 1").drop("labels")
    of = of.join(main, "group").select("id", "group", "label", (F.col("label") != F.col("main")).alias("asks"), F.pmod(F.xxhash64("id"), "blocks").alias("block"))
    of = written(of, "groups-left")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches):
            values, at = shingle_sets(data, offsets, size)
            ids = rows.column("id").take(pa.array(np.repeat(np.arange(len(at) - 1), np.diff(at))))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.repeat(np.diff(at), np.diff(at))), pa.array(values.view(np.int64))], ["id", "n", "shingle"])

    kind = of.schema["id"].dataType.simpleString()
    own = texts.withColumnRenamed("set", "id").join(of.select("id"), "id").select("id", "text")
    every = own.mapInArrow(shingles, f"id {kind}, n long, shingle long")
    every = written(every.join(of, "id"), "shingles-left")
    common = every.groupBy("group", "shingle").agg(F.count("*").alias("often")).filter("often > 1")
    # Shingles of one set alone come first in its order and make no pair: they are counted, not ranked.
    shared = every.join(common, ["group", "shingle"])
    at = F.row_number().over(Window.partitionBy("id").orderBy("often", "shingle")) + F.col("n") - F.count("*").over(Window.partitionBy("id"))
    ranked = shared.withColumn("at", at).filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    ranked = written(ranked.select("group", "shingle", "id", "label", "n", "at", "asks", "block"), "rare-shingles")
    asking, asked = ranked.filter("asks"), ranked.select("group", "shingle", *[F.col(c).alias(f"{c}_b") for c in ("id", "label", "n", "at", "asks", "block")])
    may = (F.col("label") != F.col("label_b")) & (~F.col("asks_b") | (F.col("id") < F.col("id_b")))
    may &= (F.least(F.col("n") - F.col("at"), F.col("n_b") - F.col("at_b")) + 1) * (100 + percent) >= (F.col("n") + F.col("n_b")) * percent
    return asking.join(asked, ["group", "shingle"]).filter(may).select(F.col("id").alias("a"), F.col("id_b").alias("b"), "group", "block", "block_b").distinct()


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    A text's set is its distinct runs of ``size`` lower-cased words, or all its words if they are fewer; texts without
    words, null ones too, are linked with nothing. Texts are linked when 100 * intersection >= percent * union;
    component_id is the smallest doc_id reachable, kept marks the row that has it. Rows that repeat a doc_id and text
    are one class and share its mark; different texts under one doc_id are linked by it. A row without a doc_id
    is linked with nothing and kept, with a null component_id. An empty table gives an empty one; other columns are left out.
    """
    every = written(profiles(docs, size), "profiles")
    nameless = every.filter("doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    every = every.filter("doc_id IS NOT NULL")
    some = every.filter("n_shingles > 0")
    classes = some.groupBy("set").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_hash")).alias("first"), F.first("n_shingles").alias("n"))
    # From here on a class goes by a number, given once and written: Spark aggregates numbers by hashing, and sets by sorting.
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    # A class is sketched alike in all its rows; its first row stands for it.
    keyed = some.join(classes, "set").filter(F.struct("doc_id", "text_hash") == F.col("first")).dropDuplicates(["id"])
    keyed = keyed.select("id", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("size")).filter("size > 1").drop("size")

    met = keyed.join(hubs, "key").filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    met = written(met, "pairs")
    ids = met.select(F.col("a").alias("id")).union(met.select("b")).distinct().join(classes, "id").select("id", "first.*")
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").join(ids, ["doc_id", "text_hash"])
    texts = written(texts.dropDuplicates(["id"]).select(F.col("id").alias("set"), "text"), "texts")
    n, m = (classes.select(F.col("id").alias(c), F.col("n").alias(name)) for c, name in (("a", "n"), ("b", "m")))
    could = met.join(n, "a").join(m, "b").filter(F.least("n", "m") * 100 >= F.greatest("n", "m") * percent)
    # Texts under one doc_id are linked, whatever they are.
    several = some.groupBy("doc_id").agg(F.min("set").alias("one"), F.max("set").alias("other")).filter("one <> other").drop("other")
    named = some.join(several, "doc_id").select("set", "one").filter("set <> one")
    named = named.join(classes.select("set", F.col("id").alias("a")), "set").join(classes.select(F.col("set").alias("one"), F.col("id").alias("b")), "one")
    links = written(confirmed(could, texts, size, percent).unionByName(named.select("a", "b")), "links")
    left = pairs_left(components(met), components(links), texts, size, percent)
    labels = components(links.unionByName(written(confirmed_in_tiles(left, texts, size, percent), "links")))
    placed = classes.join(labels, "id", "left").select("set", "least", F.coalesce("label", "id").alias("label"))
    ends = placed.groupBy("label").agg(F.min("least").alias("component_id"))
    placed = written(placed.join(ends, "label").select("set", "component_id"), "placed")
    out = every.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set")).alias("set")).join(placed, "set", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept")).unionByName(nameless)


def without_near_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group, all its columns as they are; rows without a doc_id stay.

    Of rows that repeat the doc_id that stays, the one with the least text stays. Null and empty texts stay; an empty table gives an empty one.
    """
    kept = near_groups(docs, size, percent).filter("kept").groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("rows"))
    kept = written(kept, "near-kept")
    same = docs["doc_id"].eqNullSafe(kept["_id"])
    if kept.filter("rows > 1 AND _id IS NOT NULL").isEmpty():
        return docs.join(kept, same, "left_semi")
    once = docs.join(kept.filter("rows = 1 OR _id IS NULL"), same, "left_semi")
    nth = free_name(docs.columns, "_nth")
    linked = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    order = Window.partitionBy("doc_id", linked).orderBy("text", *[F.xxhash64(F.col(quoted(c)).cast("string")) for c in docs.columns])
    first = docs.join(kept.filter("rows > 1 AND _id IS NOT NULL"), same, "left_semi").withColumn(nth, F.row_number().over(order))
    return once.unionByName(first.filter(F.col(quoted(nth)) == 1).drop(F.col(quoted(nth))))
