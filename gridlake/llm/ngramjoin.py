"""Similarity join of texts on word n-grams by rare-first prefixes, and its components.

Texts are sets of hashed word n-grams; two link when their Jaccard similarity reaches a
threshold.  The steps, each a Spark job over all rows:

1. Sets: size and 128-bit fingerprint of each text; equal sets become one class, so a group
   of copies of any size is one member of the join.  On the way every task counts n-grams
   into a sketch of fixed size, and the sketches are added up.
2. Prefixes: n-grams are ordered by their count in the sketch (rare first, then by hash; any
   order that is the same everywhere gives right results).  Sets as similar as asked share ``k``
   of their first |x| - ceil(t |x|) + k n-grams in that order, whatever ``k`` up to ceil(t |x|).
3. Postings: n-grams of prefixes for a long ``k`` that more than one set has.  Sets that share
   fewer of theirs with all others together than a similar one would share alone link with
   nothing and leave: chance phrases, of which more corpora have more, do not make pairs.  What
   stays is listed by the prefixes for ``k`` = 1.
4. Links: in each posting list the set with the fewest rarer n-grams is compared with the
   others.  Of lists whose sets are not all connected yet, those sets go on whose n-grams, all
   of them, are in sets of other components to the share asked for: one that has more of its own
   is like none of them.  Their n-grams are ordered anew, by exact counts among them, those of one
   component alone first; the first n-gram that a pair shares is then seldom early enough in both.
   Where more pairs are left than there were postings, each set is compared with the first one of
   another component, in rounds, until a round connects nothing.  What is then left are pairs
   between different components, and those are all tested.  A pair must pass the length,
   positional and signature filters first; it is verified once at most, behind a wide signature
   and a suffix filter, on full sets that are computed again for the documents of such pairs alone.

Only connections are asked for, so pairs that are connected already need no test: work in a
group of near copies grows with its size, not with its square.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.session import bounded_batches, give_back, stage

# Counters of the n-gram sketch, and the slices in which it is added up.
SKETCH, SLICES = 1 << 20, 64
# Longs of the signature that joins carry, and cells of the one that pairs are tested by.
SIGNATURE, WIDE = 8, 4096
# Longs that the signature is folded to where it moves with every posting.
FOLDED = 4
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MULTIPLY = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
# Times at most that sets with too few shared n-grams leave; each time the others share less.
SIEVES = 3
# Rounds at most of one partner for each set; what they leave is compared in all pairs.
ROUNDS = 6
# Cells of the bitmap that picks the documents whose sets are computed again: a prime.
CELLS = 8_388_593


def grams(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of words of a text.

    Words are runs of characters other than ASCII white space, ASCII letters in lower case.
    Fewer than ``n`` words are one n-gram; no words or null give none.
    """
    if not text:
        return np.zeros(0, dtype=np.uint64)
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(n, len(h))
    count = len(h) - width + 1
    out = np.full(count, width, dtype=np.uint64)
    for i in range(width):
        out = out * _MULTIPLY[0] + h[i:i + count]
    out = (out ^ (out >> np.uint64(30))) * _MULTIPLY[1]
    out = (out ^ (out >> np.uint64(27))) * _MULTIPLY[2]
    out ^= out >> np.uint64(31)
    return np.unique(out)


def one_by_one(column):
    """Values of an Arrow column, without a list of all of them."""
    for i in range(len(column)):
        yield column[i].as_py()


def _slot(g: np.ndarray) -> np.ndarray:
    return (g >> np.uint64(44)).astype(np.int64)


def ceil_share(size: np.ndarray, share: Fraction) -> np.ndarray:
    return -(-size * share.numerator // share.denominator)


def asked(size: np.ndarray, share: Fraction) -> np.ndarray:
    """How many n-grams of their longer prefixes a set and one at most as small must share; grows with the size."""
    least = ceil_share(size, share)
    return np.minimum(size - least + 1, least)


def signature(g: np.ndarray) -> list[int]:
    """Parity of the members in each of 64 * SIGNATURE cells: sets that differ in d members
    differ in at most d cells."""
    bits = 64 * SIGNATURE
    cells = np.bincount((g % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(cells.astype(np.uint8)).view("<i8").tolist()


def _hamming_at_least(x: np.ndarray, y: np.ndarray, limit: int, depth: int = 3) -> int:
    """Lower bound of the symmetric difference of two sorted sets: cut both at a pivot, add up."""
    bound = abs(len(x) - len(y))
    if bound > limit or depth == 0 or not len(x) or not len(y):
        return bound
    pivot = y[len(y) // 2]
    i, j = np.searchsorted(x, pivot), len(y) // 2
    left = _hamming_at_least(x[:i], y[:j], limit, depth - 1)
    return left + _hamming_at_least(x[i:], y[j:], limit - left, depth - 1)


def similar(x: np.ndarray, y: np.ndarray, share: Fraction) -> bool:
    """Whether |x and y| / |x or y| >= share, exactly; suffix filter first."""
    a, b = share.numerator, share.denominator
    both = len(x) + len(y)
    # overlap >= share / (1 + share) * both
    need = -(-a * both // (a + b))
    if min(len(x), len(y)) < need:
        return False
    if _hamming_at_least(x, y, both - 2 * need) > both - 2 * need:
        return False
    common = np.intersect1d(x, y, assume_unique=True).size
    return common * b >= a * (both - common)


def similar_bytes(x: bytes, y: bytes, share: Fraction) -> bool:
    return similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), share)


def wide_signature(g: np.ndarray) -> bytes:
    """Size, and parity of the members in each of ``WIDE`` cells."""
    cells = np.bincount((g % np.uint64(WIDE)).astype(np.int64), minlength=WIDE) & 1
    return np.int64(len(g)).tobytes() + np.packbits(cells.astype(np.uint8)).tobytes()


def wide_allows(x: bytes, y: bytes, share: Fraction) -> bool:
    """Whether the cells that differ are no more than the members that may differ."""
    a, b = share.numerator, share.denominator
    both = int(np.frombuffer(x[:8], np.int64)[0]) + int(np.frombuffer(y[:8], np.int64)[0])
    apart = np.bitwise_count(np.frombuffer(x[8:], np.uint64) ^ np.frombuffer(y[8:], np.uint64)).sum()
    return int(apart) * (a + b) <= both * (b - a)


class NgramJoin:
    """Links between texts with the given word n-grams and least similarity.

    ``docs`` needs an id and a text column; other columns are not read.  Null, empty and blank
    texts have empty sets and link with nothing.  Repeated rows and copies are linked.  Rows of
    one id with different texts count as one member that links by any of them.  Rows with a null
    id link with exact copies only; among themselves their component is null.
    """

    def __init__(
        self, docs: DataFrame, n: int, share: Fraction | str, id_column: str = "doc_id", text_column: str = "text",
    ):
        self.n, self.share = n, Fraction(share)
        if not 0 < self.share <= 1:
            raise ValueError("the similarity must be above 0 and at most 1")
        self.spark = docs.sparkSession
        bounded_batches(self.spark)
        self.docs = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("text"))
        self.sets = self.counts = None

    # -- step 1 ---------------------------------------------------------------------
    def scan(self) -> None:
        """``sets`` (doc, size, mark) of all rows, and the n-gram counts."""
        n, width = self.n, SKETCH // SLICES

        def measure(batches):
            sketch, slots, waiting = np.zeros(SKETCH, dtype=np.int64), [], 0
            for batch in batches:
                sizes, marks = [], []
                for text in one_by_one(batch["text"]):
                    g = grams(text, n)
                    slots.append(_slot(g))
                    waiting += len(g)
                    if waiting > SKETCH:
                        sketch += np.bincount(np.concatenate(slots), minlength=SKETCH)
                        slots, waiting = [], 0
                    sizes.append(len(g))
                    marks.append(hashlib.md5(g.tobytes()).digest() if len(g) else None)
                k = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc"], pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()),
                     pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())],
                    names=["doc", "size", "mark", "slice", "counts"],
                )
            if slots:
                sketch += np.bincount(np.concatenate(slots), minlength=SKETCH)
            slots = []
            give_back()
            for i in range(SLICES):
                part = sketch[i * width:(i + 1) * width]
                if part.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
                         pa.array([i], pa.int32()), pa.array([part.astype("<u4").tobytes()], pa.binary())],
                        names=["doc", "size", "mark", "slice", "counts"],
                    )

        both = stage(
            self.docs.mapInArrow(measure, "doc long, size long, mark binary, slice int, counts binary"), "ngram-sets"
        )
        self.sets = both.filter("slice IS NULL").select("doc", "size", "mark")

        def add_up(batches):
            totals: dict[int, np.ndarray] = {}
            for batch in batches:
                for i, data in zip(batch["slice"].to_pylist(), batch["counts"].to_pylist()):
                    part = np.frombuffer(data, "<u4").astype("<u8")
                    totals[i] = totals[i] + part if i in totals else part
            if totals:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(totals), pa.int32()),
                     pa.array([np.minimum(t, 0xFFFFFFFF).astype("<u4").tobytes() for t in totals.values()], pa.binary())],
                    names=["slice", "counts"],
                )

        # each task adds up whole slices; what comes back is one sketch, whatever the input
        slices = both.filter("slice IS NOT NULL").select("slice", "counts").repartition(SLICES, "slice")
        counts = np.zeros(SKETCH, dtype="<u4")
        for row in slices.mapInArrow(add_up, "slice int, counts binary").collect():
            counts[row["slice"] * width:(row["slice"] + 1) * width] = np.frombuffer(row["counts"], "<u4")
        self.counts = self.spark.sparkContext.broadcast(counts)

    # -- step 2 ---------------------------------------------------------------------
    def heads(self, classes: DataFrame) -> DataFrame:
        """(doc, size, grams) of one set of each class: its longer prefix."""
        n, share, counts = self.n, self.share, self.counts

        def prefix(batches):
            for batch in batches:
                docs, sizes, parts = [], [], []
                for doc, text in zip(batch["doc"].to_pylist(), one_by_one(batch["text"])):
                    g = grams(text, n)
                    if not len(g):
                        continue
                    keep = len(g) - int(ceil_share(np.int64(len(g)), share)) + int(asked(np.int64(len(g)), share))
                    # counts, then hashes: the sort is stable and g is sorted
                    key = (counts.value[_slot(g)].astype(np.uint64) << np.uint64(32)) | (g >> np.uint64(32))
                    docs.append(doc)
                    sizes.append(len(g))
                    parts.append(g[np.argsort(key, kind="stable")[:keep]].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(parts, pa.list_(pa.int64()))],
                    names=["doc", "size", "grams"],
                )
            give_back()

        rows = self.docs.mapInArrow(prefix, "doc long, size long, grams array<long>")
        return rows.join(classes.select("doc").hint("merge"), "doc", "left_semi")

    # -- step 3 ---------------------------------------------------------------------
    def postings(self, heads: DataFrame) -> DataFrame:
        """(gram, doc, size, place, centre): prefix n-grams that are in the prefix of another set too.

        The centre of a posting list is the member with the fewest rarer n-grams: of a group of
        near copies, the one with the fewest changes of its own.
        """
        rows = heads.select("doc", "size", F.posexplode("grams").alias("place", "gram"))
        rows = rows.select("gram", "doc", F.col("size").cast("int"), F.col("place").cast("int"))
        rows = stage(self._lists(rows).select("gram", "doc", "size", "place"), "ngram-shared")
        left = rows.count()
        for _ in range(SIEVES):
            rows = stage(self._lists(self._sieve(rows)).select("gram", "doc", "size", "place"), "ngram-shared")
            before, left = left, rows.count()
            if 2 * left > before:
                break
        a, b = self.share.numerator, self.share.denominator
        # the prefix for one n-gram: size - ceil(share * size) + 1 places
        return stage(self._lists(rows.filter((F.col("size") - F.col("place")) * b >= F.col("size") * a)), "ngram-postings")

    def _lists(self, rows: DataFrame) -> DataFrame:
        """The rows whose n-gram another one has too, each with the first of them."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.repartition(parts, "gram").sortWithinPartitions("gram", "place", "doc")
        schema = "gram long, doc long, size int, place int, c_doc long, c_size int, c_place int"
        return dealt.mapInArrow(_shared, schema)

    def _sieve(self, rows: DataFrame) -> DataFrame:
        """The rows of sets that have as many as they would share with the smallest set like them."""
        a, b = self.share.numerator, self.share.denominator
        smallest = F.expr(f"(size * {a}L + {b - 1}) DIV {b}")
        least = F.expr(f"(smallest * {a}L + {b - 1}) DIV {b}")
        counted = rows.withColumn("found", F.count(F.lit(1)).over(Window.partitionBy("doc"))).withColumn("smallest", smallest)
        return counted.filter(F.col("found") >= F.least(F.col("smallest") - least + 1, least)).select(*rows.columns)

    def described(self, docs: DataFrame, describe, kind: str = "binary") -> DataFrame:
        """(doc, told): ``describe(set)``, of that type, of the documents (doc).

        A bitmap of fixed size picks the documents while they are read, so texts are not
        shuffled; a few more may pass, which are to be joined away.
        """
        n, told = self.n, {"binary": pa.binary(), "array<long>": pa.list_(pa.int64())}[kind]
        cells = docs.select(F.pmod("doc", F.lit(CELLS)).alias("cell"))
        span = 32768  # bits of one of Spark's bitmaps
        maps = cells.groupBy(F.floor(F.col("cell") / span).alias("at")).agg(
            F.bitmap_construct_agg(F.pmod("cell", F.lit(span))).alias("bits")
        )
        wanted = np.zeros(-(-CELLS // span) * span, dtype=bool)
        for row in maps.collect():
            wanted[row["at"] * span:(row["at"] + 1) * span] = np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little")
        wanted = self.spark.sparkContext.broadcast(np.packbits(wanted))

        def full(batches):
            for batch in batches:
                cell = batch["doc"].to_numpy(zero_copy_only=False) % CELLS
                hit = (wanted.value[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1
                batch = batch.filter(pa.array(hit.astype(bool)))
                parts = [describe(grams(text, n)) for text in one_by_one(batch["text"])]
                yield pa.RecordBatch.from_arrays([batch["doc"], pa.array(parts, told)], names=["doc", "told"])
            give_back()

        return self.docs.filter("doc IS NOT NULL").mapInArrow(full, f"doc long, told {kind}")

    # -- step 4 ---------------------------------------------------------------------
    def _may_link(self, size_a: Column, size_b: Column, place_a: Column, place_b: Column) -> Column:
        """Length and positional filters; what may still follow any shared n-gram bounds the overlap."""
        a, b = self.share.numerator, self.share.denominator
        lengths = (size_a * b >= size_b * a) & (size_b * b >= size_a * a)
        # an earlier shared n-gram may add to the overlap, so places count from the front of both
        most = 1 + F.least(size_a - place_a - 1, size_b - place_b - 1) + F.least(place_a, place_b)
        return lengths & (most * (a + b) >= (size_a + size_b) * a)

    def _reach(self, size: Column, place: Column) -> Column:
        """``a`` times the size of the largest set that may link by a first shared n-gram at this place."""
        a, b = self.share.numerator, self.share.denominator
        # overlap <= size - place, and >= a / (a + b) * the sizes
        return size * b - place * (a + b)

    def _bits_allow(self, size_a: Column, size_b: Column, bits_a: list[Column], bits_b: list[Column]) -> Column:
        a, b = self.share.numerator, self.share.denominator
        apart = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(bits_a, bits_b)), F.lit(0))
        # differing members <= sizes - 2 * overlap, with the overlap at least share / (1 + share) of the sizes
        return apart * (a + b) <= (size_a + size_b) * (b - a)

    def _verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are as similar as asked; each arrives once, in a staged table.

        Wide signatures go first: long sets are heavy to move and seldom pass them by chance.
        """
        near = self._test(pairs, wide_signature, wide_allows)
        return self._test(stage(near, "ngram-pairs"), np.ndarray.tobytes, similar_bytes)

    def _test(self, pairs: DataFrame, describe, allows) -> DataFrame:
        share = self.share
        told = stage(self.described(pairs.select(F.explode(F.array("a", "b")).alias("doc")), describe), "ngram-described")
        left = told.select(F.col("doc").alias("a"), F.col("told").alias("x"))
        right = told.select(F.col("doc").alias("b"), F.col("told").alias("y"))

        def check(batches):
            for batch in batches:
                keep = [allows(x, y, share) for x, y in zip(one_by_one(batch["x"]), one_by_one(batch["y"]))]
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            give_back()

        met = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "x", "y")
        return met.mapInArrow(check, "a long, b long")

    def _star(self, lists: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Verified links between the members of posting lists and a centre of one, and the pairs tested."""
        met = lists.filter("doc <> c_doc")
        met = met.filter(self._may_link(F.col("size"), F.col("c_size"), F.col("place"), F.col("c_place")))
        return self._best_pairs(met.select("doc", "c_doc"), parts, None)

    def _best_pairs(self, met: DataFrame, parts: DataFrame, tested: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """For each set of ``met`` (doc, c_doc) the partner it meets most and was not tested with:
        the links among them, and the pairs themselves."""
        ends = [F.least("doc", "c_doc").alias("a"), F.greatest("doc", "c_doc").alias("b")]
        pairs = met.groupBy("doc", "c_doc").agg(F.count(F.lit(1)).alias("met")).select("doc", "met", *ends)
        if tested is not None:
            pairs = pairs.join(tested.hint("merge"), ["a", "b"], "left_anti")
        pairs = self._by_signature(pairs, parts)
        best = pairs.groupBy("doc").agg(F.min(F.struct((-F.col("met")).alias("met"), "a", "b")).alias("m"))
        chosen = stage(best.select("m.a", "m.b").distinct(), "ngram-pairs")
        return self._verify(chosen), chosen

    def _mixed(self, rows: DataFrame, parts: DataFrame) -> DataFrame:
        """(gram, doc, size, place, part) of the posting lists that hold more than one component."""
        rows = rows.select("gram", "doc", "size", "place").join(parts.select("doc", "part").distinct().hint("merge"), "doc")
        spans = rows.groupBy("gram").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high")
        return stage(rows.join(spans.select("gram").hint("merge"), "gram"), "ngram-mixed")

    def _sharing(self, mixed: DataFrame) -> DataFrame:
        """(doc, part) of the sets whose n-grams are in sets of other components to the share asked for.

        Similar sets of different components are both in ``mixed``, and have so many in common.
        """
        a, b = self.share.numerator, self.share.denominator
        # texts of one id count together: more may stay
        members = stage(mixed.groupBy("doc").agg(F.first("part").alias("part"), F.min("size").cast("long").alias("size")), "ngram-members")
        whole = self.described(members, lambda g: g.view(np.int64), "array<long>")
        rows = whole.join(members.select("doc", "part").hint("merge"), "doc").select(F.explode("told").alias("gram"), "doc", "part")
        alike = Window.partitionBy("gram")
        found = rows.select("doc", (F.min("part").over(alike) < F.max("part").over(alike)).alias("met")).filter("met")
        found = found.groupBy("doc").agg(F.count(F.lit(1)).alias("found"))
        stays = members.join(found.hint("merge"), "doc").filter(F.col("found") * b >= F.col("size") * a)
        return stays.select("doc", "part")

    def _reordered(self, mixed: DataFrame) -> DataFrame:
        """``mixed`` of the same sets in another order: by the exact counts of all their n-grams.

        The sketch counts all texts, and tells fewer n-grams apart the more there are.  Here those
        come first that no other component has, then the rare ones.  Rows stay whose place is early
        enough for a pair that shares nothing before it.
        """
        a, b = self.share.numerator, self.share.denominator
        members = stage(mixed.groupBy("doc").agg(F.first("part").alias("part")), "ngram-members")
        whole = self.described(members, lambda g: g.view(np.int64), "array<long>").join(members.hint("merge"), "doc")
        # texts of one id have places of their own; repeated rows are one
        sets = whole.withColumn("text", F.xxhash64("told")).dropDuplicates(["doc", "text"])
        rows = sets.select(F.explode("told").alias("gram"), "doc", "text", "part", F.size("told").alias("size"))
        alike = Window.partitionBy("gram")
        several = F.min("part").over(alike) < F.max("part").over(alike)
        rows = rows.select("*", F.count(F.lit(1)).over(alike).alias("many"), several.alias("several")).filter("several")
        after = F.row_number().over(Window.partitionBy("doc", "text").orderBy(F.desc("many"), F.desc("gram")))
        rows = rows.withColumn("place", F.col("size") - after).filter((F.col("size") - F.col("place")) * b >= F.col("size") * a)
        smallest = F.min("size").over(alike)
        rows = rows.withColumn("least", smallest).filter(self._reach(F.col("size"), F.col("place")) >= F.col("least") * a)
        rows = rows.withColumn("several", several).filter("several")
        return stage(rows.select("gram", "doc", "size", "place", "part"), "ngram-mixed")

    def _pairs(self, mixed: DataFrame) -> int:
        """How many pairs of rows the posting lists have, at most."""
        lists = mixed.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        return lists.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0

    def _other_star(self, mixed: DataFrame, parts: DataFrame, tested: DataFrame) -> tuple[DataFrame, DataFrame]:
        """As ``_star``, each set with the first one of another component in each of its lists."""
        first = F.struct("place", "size", "doc")
        heads = mixed.groupBy("gram", "part").agg(F.min(first).alias("head")).select("gram", F.struct("head", "part").alias("head"))
        lead = heads.groupBy("gram").agg(F.min("head").alias("lead"))
        # the best of the other components: the list's second one
        next_ = heads.join(lead.hint("merge"), "gram").filter("head.part <> lead.part")
        next_ = next_.groupBy("gram").agg(F.first("lead").alias("lead"), F.min("head").alias("next"))
        rows = mixed.join(next_.hint("merge"), "gram")
        other = F.when(F.col("lead.part") != F.col("part"), F.col("lead.head")).otherwise(F.col("next.head"))
        met = rows.withColumn("other", other)
        met = met.filter(self._may_link(F.col("size"), F.col("other.size"), F.col("place"), F.col("other.place")))
        return self._best_pairs(met.select("doc", F.col("other.doc").alias("c_doc")), parts, tested)

    def _rest(self, mixed: DataFrame, parts: DataFrame, tested: DataFrame) -> DataFrame:
        """All verified links between members of a posting list in different components."""
        short = parts.select("doc", *[_folded("bits", i).alias(f"fold{i}") for i in range(FOLDED)])
        rows = mixed.join(short.hint("merge"), "doc")
        moved = ("doc", "size", "place", "part", *[f"fold{i}" for i in range(FOLDED)])
        left = rows.select("gram", *[F.col(c).alias(f"{c}_a") for c in moved])
        right = rows.select("gram", *[F.col(c).alias(f"{c}_b") for c in moved])
        c = F.col
        folds = [[c(f"fold{i}_{end}") for i in range(FOLDED)] for end in "ab"]
        met = left.join(
            right,
            (left["gram"] == right["gram"]) & (c("doc_a") < c("doc_b")) & (c("part_a") != c("part_b"))
            # of all n-grams that a pair shares, the first one is enough
            & (self._reach(c("size_a"), c("place_a")) >= c("size_b") * self.share.numerator)
            & (self._reach(c("size_b"), c("place_b")) >= c("size_a") * self.share.numerator)
            & self._bits_allow(c("size_a"), c("size_b"), *folds),
        )
        # whole signatures move for the few pairs that this leaves, not for every posting
        pairs = met.select(c("doc_a").alias("a"), c("doc_b").alias("b")).distinct()
        pairs = pairs.join(tested.hint("merge"), ["a", "b"], "left_anti")
        return self._verify(stage(self._by_signature(pairs, parts), "ngram-pairs"))

    def _by_signature(self, pairs: DataFrame, parts: DataFrame) -> DataFrame:
        """The pairs (a, b) whose signatures differ in no more cells than their sets may."""
        marks = parts.select("doc", "size", "bits")
        for end in ("a", "b"):
            pairs = pairs.join(marks.toDF(end, f"size_{end}", f"bits_{end}").hint("merge"), end)
        longs = [[F.col(f"bits_{end}")[i] for i in range(SIGNATURE)] for end in "ab"]
        allowed = self._bits_allow(F.col("size_a"), F.col("size_b"), *longs)
        return pairs.filter(allowed).drop("size_a", "size_b", "bits_a", "bits_b")

    def components(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) of every row."""
        if self.sets is None:
            self.scan()
        filled = self.sets.filter("size > 0")
        classes = stage(filled.groupBy("mark").agg(F.min("doc").alias("doc"), F.max("size").alias("size")), "ngram-classes")
        lists = self.postings(self.heads(classes))
        inside = lists.select("doc").distinct()
        told = self.described(inside, lambda g: [len(g), *signature(g)], "array<long>")
        # tables that grow with the input are merged, not broadcast, at every size
        parts = told.join(inside.hint("merge"), "doc", "left_semi").filter("told[0] > 0").select(
            "doc", F.col("doc").alias("part"), F.col("told")[0].alias("size"), F.slice("told", 2, SIGNATURE).alias("bits")
        )
        parts = stage(parts.distinct(), "ngram-parts")
        links, tested = self._star(lists, parts)
        parts = merge_parts(parts, links)
        mixed = self._mixed(lists, parts)
        if not mixed.isEmpty():
            mixed = self._mixed(mixed, self._sharing(mixed))
        if not mixed.isEmpty():
            mixed = self._reordered(mixed)
        most = lists.count()
        for _ in range(ROUNDS):
            if self._pairs(mixed) <= most:
                break
            links, more = self._other_star(mixed, parts, tested)
            links = stage(links, "ngram-links")
            tested = stage(tested.unionByName(more), "ngram-tested")
            if links.isEmpty():
                break
            parts = merge_parts(parts, links)
            mixed = self._mixed(mixed, parts)
        if not mixed.isEmpty():
            parts = merge_parts(parts, self._rest(mixed, parts, tested))
        parts = parts.select("doc", "part").distinct()
        named = classes.select("mark", "doc").join(parts.select("doc", "part"), "doc", "left")
        named = named.select("mark", F.coalesce("part", "doc").alias("part"))
        out = self.sets.join(named, "mark", "left")
        return out.select(
            F.col("doc").alias("doc_id"), F.col("size").alias("n_shingles"), F.coalesce("part", "doc").alias("component_id")
        )


def keep_one(docs: DataFrame, n: int, share: Fraction | str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` but one of each component of near copies: the one with the smallest id.

    Rows are told apart by themselves, not by their ids: copies with equal ids or without one leave
    one row, with an id if any has one.  Rows without words are no copies and all stay.
    """
    row = "_row"
    while row in docs.columns:
        row = f"_{row}"
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "ngram-rows")
    found = NgramJoin(rows, n, share, row, text_column).components().select(F.col("doc_id").alias("r"), F.col("component_id").alias("c"))
    found = stage(found, "ngram-members")
    several = found.filter("r <> c").select("c").distinct()
    members = found.join(several.hint("merge"), "c", "left_semi")
    named = members.join(rows.select(F.col(row).alias("r"), F.col(id_column).alias("i")).hint("merge"), "r")
    best = named.groupBy("c").agg(F.min(F.struct(F.col("i").isNull().alias("none"), "i", "r")).alias("m"))
    gone = members.join(best.select(F.col("m.r").alias("r")).hint("merge"), "r", "left_anti").select("r")
    return rows.join(gone, rows[row] == gone["r"], "left_anti").select(*docs.columns)


def _folded(bits: str, at: int) -> Column:
    """One long of a signature of fewer cells: parities of cells that fall together add up."""
    longs = [F.col(bits)[i] for i in range(at, SIGNATURE, FOLDED)]
    out = longs[0]
    for more in longs[1:]:
        out = out.bitwiseXOR(more)
    return out


def _shared(batches):
    """Rows of sorted batches whose ``gram`` another row has too, each with the first of them."""
    names = ["doc", "size", "place"]
    held, told = None, False  # a row that waits, or the first of a run whose rows have left
    for batch in batches:
        batch = pa.RecordBatch.from_arrays(batch.columns, names=batch.schema.names)
        if held is not None:
            batch = pa.concat_batches([held, batch])
        n = batch.num_rows
        if n < 2:
            held = batch if n else None
            continue
        gram = batch["gram"].to_numpy()
        same = gram[1:] == gram[:-1]
        first = np.maximum.accumulate(np.where(np.append(True, ~same), np.arange(n), 0))
        keep = np.append(same, False) | np.append(False, same)
        keep[0] &= not told
        told = bool(same[-1])
        held = batch.slice(first[-1] if told else n - 1, 1)
        centre = batch.take(pa.array(first))
        out = pa.RecordBatch.from_arrays(
            [batch["gram"], *[batch[c] for c in names], *[centre[c] for c in names]],
            names=["gram", *names, *[f"c_{c}" for c in names]],
        )
        yield out.filter(pa.array(keep))


def merge_parts(parts: DataFrame, links: DataFrame) -> DataFrame:
    """Components after new links between rows of ``parts`` (doc, part, ...).

    Parts connected by links get the smallest number among them.  Labels spread along links
    and jump to the label of their label, so long chains close in few rounds.
    """
    numbers = parts.select("doc", "part").distinct()
    ends = stage(links, "ngram-links").join(numbers.toDF("a", "u"), "a").join(numbers.toDF("b", "v"), "b").filter("u <> v")
    edges = stage(ends.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "part-edges")
    if edges.isEmpty():
        return parts
    both = edges.union(edges.select("v", "u"))
    labels = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label"))
    labels = stage(labels, "part-labels")
    while True:
        around = both.join(labels.toDF("v", "near"), "v").groupBy("u").agg(F.min("near").alias("near"))
        spread = labels.join(around, labels["node"] == around["u"]).select(
            "node", "label", F.least("label", "near").alias("next")
        )
        jumps = spread.select(F.col("node").alias("next"), F.col("next").alias("far"))
        closer = spread.join(jumps, "next").select("node", "label", F.least("next", "far").alias("next"))
        closer = stage(closer, "part-labels")
        labels = closer.select("node", F.col("next").alias("label"))
        if closer.filter("next <> label").isEmpty():
            break
    moved = parts.join(labels, parts["part"] == labels["node"], "left")
    named = [c for c in parts.columns if c != "part"]
    return stage(moved.select(*named, F.coalesce("label", "part").alias("part")), "ngram-parts")


def with_link_counts(components: DataFrame) -> DataFrame:
    """Adds the size of each component."""
    size = F.count(F.lit(1)).over(Window.partitionBy("component_id"))
    return components.withColumn("component_size", size)
