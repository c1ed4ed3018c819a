"""Phrases whose words keep together, mined by counting word n-grams in HAT-tries.

1. Words are counted per language.  Frequent ones get ids: the ``KNOWN`` most frequent a number of
   21 bits, which tasks look up in a dictionary of bounded size, the others a 62-bit hash, behind a
   bitmap of fixed size.  A phrase that occurs ``least`` times has no rarer word, so texts are cut
   at those.
2. Each task inserts, for every place of a text, the ids of up to ``longest`` words from there on
   into a HAT-trie: a shallow trie over word ids whose leaves are hash containers, which burst into
   a trie node when they grow.  When it is full, its largest subtrees leave as sorted runs.
3. The runs are dealt to partitions by their prefixes.  A word too frequent for one partition is split
   by the words behind it, up to the first that is not as frequent, so what is split are phrases of
   such words alone, and a hot word or pair spreads over many tasks.  Each partition is merged in one
   pass that counts the phrases of all lengths, which are prefixes of the rows; those phrases of hot
   words may go on in other partitions, and are added up afterwards.
4. Phrases are cut, looked up and scored by joins over the frequent phrases.

Counts and scores are exact whole numbers; scores are computed in decimals of 38 digits, which
holds for counts up to 10^15 of 10^17 words.  Words rarer than the first ``KNOWN`` are compared by
hash.  Null languages are ``und``, null texts are empty.  Repeated rows count again, ties rank by
phrase, other columns are not read, an empty table gives no phrases.  Texts of any length are whole:
memory holds one text, one batch of ids and one trie.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.llm.bitmaps import bitmap, has
from gridlake.operators.rowindex import ROW, sort_index
from gridlake.session import bounded_batches, give_back, stage

UNDETERMINED = "und"
#: words in the dictionary of the tasks, of so many bytes each at most
KNOWN, WORD_BYTES = 1 << 18, 64
#: bits of the numbers of known words at most: three of them make a long
FIELD = 21
#: places of texts that a prefix partition is made for
PART_PLACES = 1 << 20
#: phrases of up to so many words, all of them split words, may lie in several parts
SHARED = 3
#: bits of the map of frequent words outside the dictionary
CELLS = 1 << 23
#: entries a task counts before it spills, words or phrases; and ids that are sorted at once
ENTRIES, BATCH = 1 << 19, 1 << 19
#: entries of a container that burst it, and how deep word ids are trie nodes
BURST, SHALLOW = 2048, 3
#: parts in which the best phrases of a language are found first
PARTS = 64
_HASHED = 1 << 62

_BREAKS = b".,;:!?\n\v\f\r"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TO_BLANKS = bytes.maketrans(_UPPER + _BREAKS + b"\t", _UPPER.lower() + b" " * (len(_BREAKS) + 1))
_TO_LINES = bytes.maketrans(_UPPER + _BREAKS + b"\t", _UPPER.lower() + b"\n" * len(_BREAKS) + b" ")


def _texts(batches):
    """(language, text as bytes) of each row."""
    for batch in batches:
        langs, texts = batch["lang"], batch["text"]
        for i in range(batch.num_rows):
            text = texts[i].as_py()
            if text:
                yield langs[i].as_py(), text.encode("utf-8", "surrogatepass")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang"), F.lit(UNDETERMINED)).alias("lang"), F.col("text"))


# -- words ------------------------------------------------------------------------------------
def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of all words, and of all together with a null word; tasks add up what they
    read before anything is shuffled."""

    def count(batches):
        counts: dict[str, Counter] = {}
        totals: Counter = Counter()

        def leave():
            for lang, words in counts.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(words), pa.string()),
                     pa.array([w.decode("utf-8", "replace") for w in words], pa.string()),
                     pa.array(list(words.values()), pa.int64())],
                    names=["lang", "word", "n"],
                )

        for lang, raw in _texts(batches):
            words = raw.translate(_TO_BLANKS).split()
            totals[lang] += len(words)
            counts.setdefault(lang, Counter()).update(words)
            if sum(map(len, counts.values())) > ENTRIES:
                yield from leave()
                counts.clear()
        yield from leave()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.string()), pa.nulls(len(totals), pa.string()), pa.array(list(totals.values()), pa.int64())],
            names=["lang", "word", "n"],
        )

    parts = _rows(docs).mapInArrow(count, "lang string, word string, n long")
    return parts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _hash_id(lang: Column, word: Column) -> Column:
    return F.xxhash64(lang, word).bitwiseAND(_HASHED - 1).bitwiseOR(F.lit(_HASHED))


class _Ids(dict):
    """Ids of the known words of a language; others are hashed and looked up in the bitmap."""

    def __init__(self, known, lang: str, cells: np.ndarray):
        super().__init__(known)
        self[b""], self[b"\n"] = -1, 0
        # the seed that Spark's hash of (language, word) goes on with
        self.seed = xxhash.xxh64_intdigest(lang.encode(), 42)
        self.cells = cells if cells.any() else None

    def __missing__(self, word: bytes) -> int:
        if self.cells is None:
            return 0
        number = xxhash.xxh64_intdigest(word, self.seed) & (_HASHED - 1)
        return number | _HASHED if has(self.cells, number % CELLS) else 0


def word_ids(words: DataFrame, known: int = KNOWN) -> DataFrame:
    """(lang, word, n, id): the first ids, by count, for the words that tasks look up."""
    placed = sort_index(words, [F.col("n").desc(), F.col("lang").asc(), F.col("word").asc()])
    small = (F.col(ROW) < known) & (F.octet_length("word") + F.octet_length("lang") <= WORD_BYTES)
    return placed.select(
        "lang", "word", "n", F.when(small, F.col(ROW) + 1).otherwise(_hash_id(F.col("lang"), F.col("word"))).alias("id")
    )


# -- the trie -----------------------------------------------------------------------------------
class HatTrie:
    """Counts rows of ``width`` ids.  A node is a container, {rest of the row: count}, or a
    ``Branch`` by the next id; rows and rests are ids of ``item`` bytes, high byte first."""

    class Branch(dict):
        """{bytes of an id: node}"""

    def __init__(self, width: int, item: int = 8, burst: int = BURST, shallow: int = SHALLOW):
        self.width, self.item, self.burst, self.shallow = width, item, burst, shallow
        self.root = self.Branch()
        self.sizes: Counter = Counter()
        self.entries = 0

    def add_rows(self, rows: np.ndarray, counts: np.ndarray) -> None:
        """Distinct rows in order, with their counts."""
        if not len(rows):
            return
        new = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0])).tolist()
        raw, wide, many = rows.astype(f">i{self.item}").tobytes(), self.item * self.width, counts.tolist()
        rests = [raw[i + self.item:i + wide] for i in range(0, len(raw), wide)]
        for low, high in zip(new, [*new[1:], len(rows)]):
            self.add(raw[low * wide:low * wide + self.item], rests[low:high], many[low:high])

    def add(self, first: bytes, rests: list[bytes], counts: list[int]) -> None:
        """Rows that start with one id; ``rests`` ascend."""
        node = self.root.get(first)
        if node is None:
            node = self.root[first] = {}
        grown = self._insert(self.root, first, node, rests, counts, 1)
        self.sizes[first] += grown
        self.entries += grown

    def _insert(self, parent, key, node, rests, counts, depth) -> int:
        item = self.item
        if isinstance(node, self.Branch):
            grown, low = 0, 0
            while low < len(rests):
                step, high = rests[low][:item], low + 1
                while high < len(rests) and rests[high].startswith(step):
                    high += 1
                child = node.get(step)
                if child is None:
                    child = node[step] = {}
                grown += self._insert(node, step, child, [r[item:] for r in rests[low:high]], counts[low:high], depth + 1)
                low = high
            return grown
        before, known = len(node), node.get
        for rest, n in zip(rests, counts):
            node[rest] = known(rest, 0) + n
        if len(node) > self.burst and depth < self.shallow:
            branch = parent[key] = self.Branch()
            for rest, n in node.items():
                branch.setdefault(rest[:item], {})[rest[item:]] = n
        return len(node) - before

    def _walk(self, node, prefix: bytes):
        for key in sorted(node):
            below = node[key]
            if isinstance(node, self.Branch):
                yield from self._walk(below, prefix + key)
            else:
                yield prefix + key, below

    def spill(self, keep: int = 0):
        """Sorted runs (rows as an array, counts) of whole subtrees, the largest first, until
        ``keep`` entries are left."""
        leaving = []
        for first, size in self.sizes.most_common():
            if self.entries <= keep:
                break
            leaving.append(first)
            self.entries -= size
        rows, counts = [], []
        for first in sorted(leaving):
            del self.sizes[first]
            for row, n in self._walk(self.root.pop(first), first):
                rows.append(row)
                counts.append(n)
        if rows:
            ids = np.frombuffer(b"".join(rows), f">i{self.item}").astype(np.int64)
            yield ids.reshape(-1, self.width), np.array(counts, np.int64)


def places(ids: np.ndarray, longest: int) -> np.ndarray:
    """For each place followed by another word, the ids of up to ``longest`` words; 0 is a break."""
    columns = np.zeros((len(ids), longest), np.int64)
    open_ = np.ones(len(ids), bool)
    for k in range(min(longest, len(ids))):
        ahead = np.zeros(len(ids), np.int64)
        ahead[:len(ids) - k] = ids[k:]
        open_ &= ahead != 0
        columns[:, k] = np.where(open_, ahead, 0)
    return columns[columns[:, 1] != 0]


def run_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows, and the places in it where a distinct row begins."""
    bits = max(1, int(rows.max(initial=0)).bit_length())
    codes = rows
    if bits > FIELD:  # hashed words: numbers that keep the order and are small
        values, codes = np.unique(rows, return_inverse=True)
        codes = codes.reshape(rows.shape)
        bits = max(1, int(len(values) - 1).bit_length())
    keys, each = [], max(1, 63 // bits)
    for low in range(0, rows.shape[1], each):
        key = np.zeros(len(rows), np.int64)
        for k in range(low, min(low + each, rows.shape[1])):
            key = (key << bits) | codes[:, k]
        keys.append(key)
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    return order, np.flatnonzero(new)


def sorted_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, and how often each occurs."""
    order, first = run_order(rows)
    return rows[order[first]], np.diff(np.append(first, len(rows)))


class Partitions:
    """Prefix partitions of rows by their first word: numbers 0 to ``split`` - 1 are parts of words that
    are too frequent for one, the next ones hold many words, negative ones rows with hashed words."""

    def __init__(self, counts: list[int], places: int = PART_PLACES):
        """``counts`` are the occurrences of the known words, by id from 1."""
        n = np.array([0, *counts], np.int64)
        self.times = -(-n // places)
        hot = self.times > 1
        self.split = int(self.times[hot].sum())
        self.first = self.split + np.cumsum(np.where(hot, 0, n)) // places
        self.first[hot] = np.cumsum(self.times[hot]) - self.times[hot]
        self.many = int(self.first.max(initial=0)) + 1

    @staticmethod
    def _hash(columns) -> np.ndarray:
        mixed = np.uint64(0)
        for c in columns:
            mixed = (mixed ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        return (mixed >> np.uint64(11)).astype(np.int64)

    def of(self, rows: np.ndarray, hashed: bool) -> np.ndarray:
        if hashed:  # phrases that hold a hashed word have two words or more
            return -1 - self._hash(rows[:, :2].T) % self.many
        first = rows[:, 0]
        part = self.first[first]
        hot = self.times[first] > 1
        if hot.any():
            some = rows[hot, :SHARED + 1]
            # a phrase occurs at most as often as its rarest word: behind that one no more is cut
            after = np.logical_or.accumulate(self.times[some] <= 1, axis=1)
            cut = some.copy()
            cut[:, 1:][after[:, :-1]] = 0
            part[hot] += self._hash(cut.T) % self.times[some[:, 0]]
        return part

    def hot(self) -> np.ndarray:
        """The words that are split, in order."""
        return np.flatnonzero(self.times > 1)


def pack_run(rows: np.ndarray, counts: np.ndarray) -> bytes:
    """A sorted run in few bytes: columns, the first as differences, byte by byte, compressed."""
    kind = "<u4" if int(rows.max(initial=0)) < 1 << 32 and int(counts.max(initial=0)) < 1 << 32 else "<u8"
    columns = np.concatenate([rows, counts[:, None]], axis=1).T.astype(kind)
    columns[0, 1:] = columns[0, 1:] - columns[0, :-1]
    planes = np.ascontiguousarray(columns).view(np.uint8).reshape(-1, columns.dtype.itemsize).T
    return kind[-1].encode() + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_run(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    size = int(data[:1])
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(size, -1)
    columns = np.ascontiguousarray(planes.T).view(f"<u{size}").reshape(width + 1, -1).astype(np.int64)
    columns[0] = np.cumsum(columns[0])
    return columns[:width].T, columns[width]


def count_places(docs: DataFrame, ids: DataFrame, longest: int, entries: int = ENTRIES, part_places: int = PART_PLACES):
    """Sorted runs (part, run): ids of the words from each place on, counted within a task; and the
    partitions they are cut by."""
    session = docs.sparkSession
    listed: dict[str, dict[bytes, int]] = {}
    counts = Counter()
    for r in ids.filter(F.col("id") < _HASHED).select("lang", "word", "id", "n").collect():  # KNOWN rows at most
        listed.setdefault(r["lang"], {})[r["word"].encode("utf-8", "surrogatepass")] = r["id"]
        counts[r["id"]] = r["n"]
    partitions = Partitions([counts[i + 1] for i in range(max(counts, default=0))], part_places)
    cells = bitmap(ids.filter(F.col("id") >= _HASHED), F.col("id").bitwiseAND(_HASHED - 1), CELLS)
    shared = session.sparkContext.broadcast((listed, cells, partitions))

    def count(batches):
        known, cells, partitions = shared.value
        lookups: dict[str, _Ids] = {}
        trie, rare, waiting, size = HatTrie(longest, 4), HatTrie(longest), [], 0

        def insert():
            rows = places(np.concatenate(waiting), longest)
            far = rows >= _HASHED
            some = far.any(axis=1)
            if some.any():
                rare.add_rows(*sorted_rows(rows[some]))
                # what comes before the first hashed word is a phrase of known ones
                rows[np.logical_or.accumulate(far, axis=1)] = 0
                rows = rows[rows[:, 1] != 0]
            trie.add_rows(*sorted_rows(rows))

        def leave(keep):
            for hashed, runs in ((False, trie.spill(keep)), (True, rare.spill(keep))):
                for rows, n in runs:
                    part = partitions.of(rows, hashed)
                    order = np.argsort(part, kind="stable")
                    cuts = np.flatnonzero(np.append(True, part[order][1:] != part[order][:-1]))
                    runs = [pack_run(rows[o], n[o]) for o in np.split(order, cuts[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(part[order][cuts]), pa.array(runs, pa.binary())], names=["part", "run"])

        for lang, raw in _texts(batches):
            lookup = lookups.get(lang)
            if lookup is None:
                lookup = lookups[lang] = _Ids(known.get(lang, {}), lang, cells)
            words = raw.translate(_TO_LINES).replace(b"\n", b" \n ").split(b" ")
            found = np.fromiter(map(lookup.__getitem__, words), np.int64, len(words))
            waiting += [found[found >= 0], np.zeros(1, np.int64)]
            size += len(words)
            if size > BATCH:
                insert()
                waiting, size = [], 0
                if trie.entries + rare.entries > entries:
                    yield from leave(entries // 4)
        if waiting:
            insert()
        yield from leave(0)

    return _rows(docs).mapInArrow(count, "part long, run binary"), partitions


# -- merging -------------------------------------------------------------------------------------
def prefixes(rows: np.ndarray, counts: np.ndarray, least: int, shared: int, hashed: bool, hot: np.ndarray | None = None):
    """(ids, n) of the prefixes of a sorted run, of two ids and more, that reach ``least``; those of up
    to ``shared`` ids, all ``hot`` if these are given, whatever their count; of rows with hashed words,
    those that hold one."""
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for k in range(1, rows.shape[1] + 1):
        new[1:] |= rows[1:, k - 1] != rows[:-1, k - 1]
        if k == 1 or not len(rows):
            continue
        at = np.flatnonzero(new)
        sums = np.add.reduceat(counts, at)
        keep = rows[at, k - 1] != 0
        if k > shared:
            keep &= sums >= least
        elif hot is not None:
            keep &= (sums >= least) | np.isin(rows[at, :k], hot).all(axis=1)
        if hashed:
            keep &= (rows[at, :k] >= _HASHED).any(axis=1)
        yield rows[at[keep], :k], sums[keep]


def _merge(longest: int, least: int, split: int, hot: np.ndarray | None = None):
    """Reads runs in the order of their partitions, gives the phrases (ids, n) of each; the first ``split``
    are parts of words, which share phrases of ``hot`` words (not given: any words)."""
    kind = pa.list_(pa.int64())

    def run(batches):
        waiting, size, at = [], 0, None

        def one():
            rows = np.concatenate([r for r, _ in waiting])
            order, first = run_order(rows)
            return rows[order[first]], np.add.reduceat(np.concatenate([n for _, n in waiting])[order], first)

        def leave():
            rows, counts = one()
            for ids, n in prefixes(rows, counts, least, SHARED if 0 <= at < split else 0, at < 0, hot):
                offsets = pa.array(np.arange(0, ids.size + 1, ids.shape[1]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(ids).reshape(-1)))
                yield from pa.table({"ids": lists.cast(kind), "n": pa.array(n)}).to_batches(100_000)

        for batch in batches:
            for part, data in zip(batch["part"].to_pylist(), batch["run"]):
                if part != at and waiting:
                    yield from leave()
                    waiting, size = [], 0
                at = part
                waiting.append(unpack_run(data.as_py(), longest))
                size += len(waiting[-1][1])
                if size > 2 * PART_PLACES:
                    waiting = [one()]  # a prefix that repeats: its rows become one
                    size = min(len(waiting[0][1]), PART_PLACES)
        if waiting:
            yield from leave()
        give_back()

    return run


def phrase_counts(
    docs: DataFrame, ids: DataFrame, least: int, longest: int, entries: int = ENTRIES, part_places: int = PART_PLACES,
) -> DataFrame:
    """(ids, n) of the phrases of 2 to ``longest`` words that occur ``least`` times or more."""
    runs, partitions = count_places(docs, ids, longest, entries, part_places)
    dealt = runs.repartition(2 * partitions.many, "part").sortWithinPartitions("part")
    parts = dealt.mapInArrow(_merge(longest, least, partitions.split, partitions.hot()), "ids array<long>, n long")
    return parts.groupBy("ids").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


# -- scores ---------------------------------------------------------------------------------------
def _score() -> Column:
    return F.expr(
        "(CAST(a AS DECIMAL(15, 0)) * 1000 * CAST(n AS DECIMAL(17, 0)))"
        " DIV (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))"
    )


def collocations(
    docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, cover: int = 100, known: int = KNOWN, entries: int = ENTRIES,
    part_places: int = PART_PLACES,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    ``docs`` has lang and text.  A phrase of 2 to ``longest`` words with a >= ``least`` occurrences
    is scored by floor(1000 a n / (l r)) at its weakest cut.  It is dropped if it lies in a longer
    one with at least ``cover`` per cent of its occurrences.
    """
    bounded_batches(docs.sparkSession)
    words = stage(word_counts(docs).filter(F.col("word").isNull() | (F.col("n") >= least)), "words")
    ids = stage(word_ids(words.filter("word IS NOT NULL"), known), "word-ids")
    totals = words.filter("word IS NULL").select("lang", "n")
    phrases = stage(phrase_counts(docs, ids, least, longest, entries, part_places), "phrases")
    single = ids.select(F.array("id").alias("ids"), "n")
    counts = phrases.unionByName(single)
    # a part of a phrase occurs at least as often, so the phrases one word longer speak for all
    longer = phrases.filter(F.size("ids") > 2).select(F.col("n").alias("f"), F.explode(F.array(
        F.expr("slice(ids, 1, size(ids) - 1)"), F.expr("slice(ids, 2, size(ids) - 1)")
    )).alias("within"))
    longer = longer.groupBy("within").agg(F.max("f").alias("f"))
    alone = phrases.join(longer, phrases["ids"] == longer["within"], "left")
    alone = alone.filter(F.col("f").isNull() | (100 * F.col("f") < cover * F.col("n"))).select("ids", F.col("n").alias("a"))
    cuts = alone.select("ids", "a", F.explode(F.expr("sequence(1, size(ids) - 1)")).alias("k")).select(
        "ids", "a", "k", F.expr("slice(ids, 1, k)").alias("head"), F.expr("slice(ids, k + 1, size(ids) - k)").alias("rest")
    )
    cuts = cuts.join(counts.select(F.col("ids").alias("head"), F.col("n").alias("l")), "head")
    cuts = cuts.join(counts.select(F.col("ids").alias("rest"), F.col("n").alias("r")), "rest")
    spoken = ids.select(F.col("id").alias("first"), "lang")
    cuts = cuts.withColumn("first", F.col("ids")[0]).join(spoken, "first").join(totals, "lang")
    weakest = cuts.withColumn("score", _score()).groupBy("ids", "lang", "a", "n").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")
    )
    texts = alone.select("ids", F.posexplode("ids").alias("at", "id")).join(ids.select("id", "word"), "id")
    texts = texts.groupBy("ids").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"))
    texts = texts.select("ids", F.array_join("words.word", " ").alias("phrase"))
    rows = weakest.join(texts, "ids").select(
        "lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score", F.pmod(F.xxhash64("ids"), F.lit(PARTS)).alias("part")
    )
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # the best of each part first, so that no task has to sort a whole language
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).filter(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= top)
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_LETTERS = _UPPER.decode()
#: SQL of ``collocations`` with its defaults
COLLOCATIONS_SQL = f"""WITH pieces AS MATERIALIZED (
  SELECT coalesce(lang, '{UNDETERMINED}') AS lang,
    regexp_extract_all(piece, '[^ \\t]+') AS w
  FROM (SELECT lang, unnest(string_split(translate(coalesce(text, ''), '{_LETTERS}.,;:!?' || chr(11) || chr(12) || chr(13),
    '{_LETTERS.lower()}' || repeat(chr(10), 9)), chr(10))) AS piece FROM documents)),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 6) t(k) WHERE len(w) >= k)),
freq AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::HUGEINT AS n FROM freq WHERE k = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM freq WHERE k >= 2 AND f >= 100),
inside AS (
  SELECT lang, part, max(a) AS f FROM (
    SELECT lang, a, k, array_to_string(w[i:i + j - 1], ' ') AS part
    FROM (SELECT *, unnest(range(1, k - j + 2)) AS i FROM cand, range(2, 5) t(j) WHERE j < k))
  GROUP BY lang, part),
parts AS MATERIALIZED (
  SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:k], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS j FROM cand)),
heads AS MATERIALIZED (SELECT p.*, f AS l FROM parts p JOIN freq ON freq.lang = p.lang AND freq.phrase = p.head),
cuts AS MATERIALIZED (SELECT h.*, f AS r FROM heads h JOIN freq ON freq.lang = h.lang AND freq.phrase = h.rest),
scored AS (SELECT c.*, n, (1000::HUGEINT * a * n) // (l::HUGEINT * r) AS score FROM cuts c JOIN totals ON totals.lang = c.lang),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT w.lang, row_number() OVER best AS rank, w.phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM weakest w LEFT JOIN inside i ON i.lang = w.lang AND i.part = w.phrase
WHERE i.f IS NULL OR 100 * i.f < 100 * a
WINDOW best AS (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase)
QUALIFY row_number() OVER best <= 2000"""
