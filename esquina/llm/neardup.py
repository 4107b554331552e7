"""Near-duplicate documents: fast similarity sketches, banding, verification on full sets, components.

Documents with equal shingle sets form a class, which takes part once. Classes that share a band key meet in a
bucket. Instead of all pairs of a bucket, a few members at a time, the pivots, are compared with the members of other
components; links found so far join components, and a bucket with one component left is done. The first pivot of a
bucket is its most central member, the one with most company over all its buckets: of copies of one text that are less
alike to each other than to it, that is the text itself, and one step joins them. Pivots leave their bucket, so in the
end every pair of a bucket has been compared or is connected.

Members that are almost as alike to that text as its copies would be compared with all of them. From the second step on,
every member of a bucket has two more numbers: how many shingles it shares with the first pivot, and how many of its
other shingles any other member has at all. Two members share no more than the lesser of each, which rules out most of
these pairs exactly. A pair that meets in several buckets is left to the first band that it shares.

Most pairs that share a bucket are far from similar. One bit of each sketch coordinate goes with the members, and only
pairs whose bits agree often enough are compared on their full sets; that loses a pair at the threshold with a
probability of 3e-7, beside the 5e-7 with which such a pair meets in no bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from esquina.llm.batches import id_and_text, small
from esquina.llm.graph import components
from esquina.llm.sketch import Shingles, band_keys, coordinate_bits, set_digest, sketch
from esquina.operators.skew import spread_lookup
from esquina.operators.stage import settle

BANDS, ROWS = 48, 6  # a pair at 0.8 shares no band with probability 5e-7
PERCENT = 80
# Members of a bucket that are compared with its others in the first steps; later twice as many as in the step before.
# Up to the bound Spark cuts a ranking to its first rows before it shuffles them.
FIRST_PIVOTS, MOST_PIVOTS = (1, 4, 64), 512
CENTRED_STEP = 2  # from here on members are bounded by what they share with the first pivot
# Bits of a sketch that are compared first. At a similarity s a bit agrees with probability (1 + s) / 2; the bound lies
# 5.5 deviations below the mean. Of 256 bits at 0.8 that is 204, which a pair misses with probability 3e-7.
BITS, DEVIATIONS = 256, 5.5
BIT_COLUMNS = [f"bits{i}" for i in range(BITS // 64)]
SKETCHES = "doc_id long, n_shingles long, set1 long, set2 long, bands array<long>, " + ", ".join(f"{c} long" for c in BIT_COLUMNS)
NO_BITS = [0] * len(BIT_COLUMNS)


def sketches(docs: DataFrame, words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per document: size of its shingle set, 128 bits that stand for the set, its band keys (none if empty) and bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingles(words)
        for b in small(batches):
            sizes, digests, keys, bits = [], [], [], []
            for t in b.column("text"):
                items = of.of(t.as_py())
                sizes.append(len(items))
                digests.append(set_digest(items))
                made = sketch(items, bands * rows) if len(items) else None
                keys.append([] if made is None else band_keys(made, rows).view("i8"))
                bits.append(NO_BITS if made is None else coordinate_bits(made, BITS))
            one, two = zip(*digests) if digests else ((), ())
            words_of_bits = zip(*bits) if bits else [()] * len(BIT_COLUMNS)
            columns = [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in (sizes, one, two)), pa.array(keys, pa.list_(pa.int64()))]
            columns += [pa.array(c, pa.int64()) for c in words_of_bits]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set1", "set2", "bands", *BIT_COLUMNS])

    return id_and_text(docs).mapInArrow(run, SKETCHES)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, set1, set2, items``: the fingerprints of all distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingles(words)
        for b in small(batches):
            sets = [of.of(t.as_py()) for t in b.column("text")]
            digests = [set_digest(s) for s in sets]
            columns = [pa.array([d[i] for d in digests], pa.int64()) for i in (0, 1)]
            items = pa.array([s.view("i8") for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns, items], ["doc_id", "set1", "set2", "items"])

    return docs.mapInArrow(run, "doc_id long, set1 long, set2 long, items array<long>")


def with_node(rows: DataFrame, several: DataFrame | None) -> DataFrame:
    """``rows`` (doc_id, set1, set2, …) with ``node``: the id, or for the ids ``several``, which have more than one set, a number of id and set."""
    if several is None:
        return rows.withColumn("node", F.col("doc_id"))
    marked = rows.join(several.withColumn("_several", F.lit(True)), "doc_id", "left")
    own = F.xxhash64(F.lit("node"), "doc_id", "set1", "set2")
    return marked.withColumn("node", F.when(F.col("_several"), own).otherwise(F.col("doc_id"))).drop("_several")


def ids_of_several_sets(some: DataFrame) -> DataFrame | None:
    ranges = [f(c) for c in ("n_shingles", "set1", "set2") for f in (F.min, F.max)]
    spread = some.groupBy("doc_id").agg(*[r.alias(f"r{i}") for i, r in enumerate(ranges)])
    found = settle(spread.filter("r0 <> r1 OR r2 <> r3 OR r4 <> r5").select("doc_id"), "several-sets")
    return None if found.isEmpty() else found


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` with ``100 * intersection >= percent * union``, on the full sets; ``pairs`` is settled."""
    needed = pairs.select(F.col("a").alias("class_id")).unionByName(pairs.select(F.col("b").alias("class_id"))).distinct()
    few = sets.join(needed, "class_id", "left_semi")
    first = few.select(F.col("class_id").alias("a"), F.col("items").alias("left"))
    second = few.select(F.col("class_id").alias("b"), F.col("items").alias("right"))
    shared = F.size(F.array_intersect("left", "right"))
    joined = pairs.join(first, "a").join(second, "b")
    return joined.filter(100 * shared >= percent * (F.size("left") + F.size("right") - shared)).select("a", "b")


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``class_id, comp`` after ``links`` between classes are added."""
    of_a = labels.select(F.col("class_id").alias("a"), F.col("comp").alias("ca"))
    of_b = labels.select(F.col("class_id").alias("b"), F.col("comp").alias("cb"))
    between = links.join(of_a, "a").join(of_b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    merged = settle(components(between).select(F.col("node").alias("comp"), F.col("comp").alias("to")), "merged")
    return labels.join(merged, "comp", "left").select("class_id", F.coalesce("to", "comp").alias("comp"))


def least_agreeing(percent: int) -> int:
    p = (1 + percent / 100) / 2
    return math.floor(BITS * p - DEVIATIONS * math.sqrt(BITS * p * (1 - p)))


def agreeing() -> Column:
    """How many bits of a member and of a pivot agree."""
    differing = [F.bit_count(F.col(c).bitwiseXOR(F.col(f"p_{c}"))) for c in BIT_COLUMNS]
    return F.lit(BITS) - reduce(Column.__add__, differing)


def alike_at_most(percent: int) -> Column:
    """Whether a member and a pivot can be similar enough, by what each shares with the bucket's centre and, beside it, with anyone."""
    shared = F.least("inner", "p_inner") + F.least("outer", "p_outer")
    shared = F.least(shared, "n", "p_n")
    return 100 * shared >= percent * (F.col("n") + F.col("p_n") - shared)


def around_centres(mixed: DataFrame, centres: DataFrame, sets: DataFrame) -> DataFrame:
    """``mixed`` with ``inner`` and ``outer``: shingles in the set of the bucket's centre, and other ones that one more member has.

    A bucket's centre is its first pivot; members of all buckets with one centre are seen together, once.
    """
    at = settle(mixed.drop("inner", "outer").join(centres, "key"), "centred")
    visits = settle(at.select("centre", "class_id").distinct(), "visits")
    counts = settle(visits.groupBy("centre").agg(F.count("*").alias("n")), "visit-counts")
    middle = sets.select(F.col("class_id").alias("centre"), F.col("items").alias("middle"))
    both = spread_lookup(visits.join(sets, "class_id"), middle, counts, ["centre"], F.col("class_id"), "inner")
    split = both.select(
        "centre",
        "class_id",
        F.size(F.array_intersect("items", "middle")).cast("long").alias("inner"),
        F.array_except("items", "middle").alias("rest"),
    )
    split = settle(split, "around")
    rest = split.select("centre", "class_id", F.explode("rest").alias("item"))
    # An item that no other member has is seen once.
    alone = rest.groupBy("centre", "item").agg(F.min("class_id").alias("class_id"), F.max("class_id").alias("last"))
    alone = alone.filter("class_id = last").groupBy("centre", "class_id").agg(F.count("*").alias("alone"))
    outer = F.size("rest") - F.coalesce("alone", F.lit(0))
    known = split.join(alone, ["centre", "class_id"], "left").select("centre", "class_id", "inner", outer.cast("long").alias("outer"))
    return at.join(known, ["centre", "class_id"]).drop("centre")


def class_components(docs: DataFrame, reps: DataFrame, several: DataFrame | None, words: int, percent: int) -> DataFrame:
    """``class_id, comp`` for the classes that share a bucket with another; ``reps`` has their sizes, bands and bits."""
    rows = reps.select("class_id", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    met_once = settle(rows.join(shared, "key"), "met")
    central = settle(met_once.groupBy("class_id").agg(F.sum("members").alias("company")), "company")
    members = central.select("class_id")
    # Until a centre is known a member can share all that it has with anyone.
    unknown = (F.col("n").alias("inner"), F.lit(0).cast("long").alias("outer"))
    own = reps.select("class_id", "n", *unknown, *BIT_COLUMNS).join(central, "class_id")
    buckets = settle(met_once.drop("members").join(own, "class_id"), "buckets")
    if several is None:
        texts = docs.join(members, F.col("doc_id") == F.col("class_id"), "left_semi").dropDuplicates(["doc_id"])
        found = shingle_sets(texts, words).withColumnRenamed("doc_id", "class_id")
    else:
        found = with_node(shingle_sets(docs.filter("doc_id IS NOT NULL"), words), several).withColumnRenamed("node", "class_id")
        found = found.join(members, "class_id", "left_semi").dropDuplicates(["class_id"])
    sets = settle(found.select("class_id", "items"), "shingle-sets")
    labels = settle(members.withColumn("comp", F.col("class_id")), "labels")
    step, pivots_now = 0, 0
    compared: DataFrame | None = None
    centres: DataFrame | None = None
    while True:
        step += 1
        sizes = settle(labels.groupBy("comp").agg(F.count("*").alias("size")), "component-sizes")
        placed = buckets.join(labels.join(sizes, "comp"), "class_id")
        open_keys = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
        mixed = settle(placed.join(open_keys, "key"), "mixed-buckets")
        if mixed.isEmpty():
            return labels
        if step == CENTRED_STEP:
            mixed = around_centres(mixed, centres, sets)
            mixed = settle(mixed.join(reps.select("class_id", "bands"), "class_id"), "bounded-buckets")
        carried = ["n", "inner", "outer"] + (["bands"] if step >= CENTRED_STEP else [])
        pivots_now = FIRST_PIVOTS[step - 1] if step <= len(FIRST_PIVOTS) else min(2 * pivots_now, MOST_PIVOTS)
        # Members of small components first: they have the fewest links, and the others need not be pivots then.
        first = Window.partitionBy("key").orderBy("size", F.desc("company"), F.xxhash64("class_id", F.lit(step)), "class_id")
        ranked = mixed.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= pivots_now)
        of_pivot = ("class_id", "comp", *carried, *BIT_COLUMNS)
        pivots = settle(ranked.select("key", *[F.col(c).alias(f"p_{c}") for c in of_pivot]), "pivots")
        near = (F.col("comp") != F.col("p_comp")) & alike_at_most(percent) & (agreeing() >= least_agreeing(percent))
        if step == 1:
            centres = pivots.select("key", F.col("p_class_id").alias("centre"))
        if step >= CENTRED_STEP:
            near = near & (F.array_min(F.array_intersect("bands", "p_bands")) == F.col("key"))
        met = mixed.join(pivots, "key").filter(near)
        pairs = met.select(F.least("class_id", "p_class_id").alias("a"), F.greatest("class_id", "p_class_id").alias("b"))
        # A pair that meets in several buckets is compared once.
        fresh = pairs.distinct() if compared is None else pairs.distinct().join(compared, ["a", "b"], "left_anti")
        fresh = settle(fresh, "pairs")
        compared = fresh if compared is None else compared.unionByName(fresh)
        links = settle(verified(fresh, sets, percent), "links")
        done = pivots.select("key", F.col("p_class_id").alias("class_id"))
        buckets = mixed.join(done, ["key", "class_id"], "left_anti").select("class_id", "company", *carried, *BIT_COLUMNS, "key")
        if not links.isEmpty():
            labels = settle(relabelled(labels, links), "labels")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id, kept`` for every row of ``docs``.

    ``class_id`` is the least id with the same shingle set, ``component_id`` the least id reachable over links of
    ``percent`` similarity or more. A text with fewer than ``words`` words is one shingle; one without words, or
    null, has an empty set, is linked with nothing and stands for itself. Rows that repeat an id are one document:
    what is linked to any of its texts is linked to it, and they share its verdict. A row without an id is its own,
    unlinked document and kept.
    """
    plain = id_and_text(docs, f"`{id_col}`", f"`{text_col}`")
    made = settle(sketches(plain, words), "sketches")
    some = made.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    alike = ["n_shingles", "set1", "set2"]
    several = ids_of_several_sets(some)
    firsts = [F.first(c).alias(c) for c in ("bands", *BIT_COLUMNS)]
    nodes = with_node(some, several)
    least = F.min("doc_id").alias("least_id")
    classes = settle(nodes.groupBy(*alike).agg(F.min("node").alias("class_id"), least, *firsts), "classes")
    reps = classes.select("class_id", F.col("n_shingles").alias("n"), "bands", *BIT_COLUMNS)
    labels = class_components(plain, reps, several, words, percent)
    of_class = classes.select(*alike, "class_id", "least_id").join(labels, "class_id", "left")
    if several is not None:
        of_class = joined_by_id(some, settle(of_class.withColumn("comp", F.coalesce("comp", "class_id")), "class-labels"), alike)
    # From here on components bear the least id of their documents.
    known = made.select("doc_id", *alike).join(of_class.drop("class_id"), alike, "left")
    has_id = F.col("doc_id").isNotNull()
    return known.select(
        "doc_id",
        "n_shingles",
        F.coalesce(F.when(has_id, F.col("least_id")), "doc_id").alias("class_id"),
        F.coalesce(F.when(has_id, F.coalesce("comp", "least_id")), "doc_id").alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def joined_by_id(some: DataFrame, of_class: DataFrame, alike: list[str]) -> DataFrame:
    """``of_class`` with the components of texts that share an id joined, and named by their least id."""
    per_row = some.select("doc_id", *alike).join(of_class.select(*alike, "comp"), alike)
    ties = per_row.groupBy("doc_id").agg(F.min("comp").alias("a"), F.collect_set("comp").alias("all"))
    links = ties.filter(F.size("all") > 1).select("a", F.explode("all").alias("b")).filter("a <> b")
    tied = settle(components(links).select(F.col("node").alias("comp"), F.col("comp").alias("to")), "tied")
    renamed = of_class.join(tied, "comp", "left").withColumn("comp", F.coalesce("to", "comp")).drop("to")
    names = renamed.groupBy("comp").agg(F.min("least_id").alias("name"))
    return renamed.join(names, "comp").drop("comp").withColumnRenamed("name", "comp")


def keep_one(docs: DataFrame, words: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their component, all columns as they are."""
    found = near_duplicates(docs, words, percent, id_col, text_col)
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(settle(gone, "near-copies"), F.col(f"`{id_col}`") == F.col("_gone"), "left_anti")
