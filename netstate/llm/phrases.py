"""Phrase collocations from truncated suffix subtrees, partitioned by word prefixes so that each fits in memory.

The suffix of a word is the phrase that begins there, at most three words long. Three steps:

1. Word counts. They are the frequencies of the prefixes of one word, and a phrase with a rare word is no candidate.
2. Vertical partition. A prefix whose suffixes fit the budget is one unit; a heavy one is extended by the next word, and again
   if that is heavy as well (a phrase is never more frequent than its rarest word, so word counts decide). Units are dealt to
   as many groups as the budget asks for. Heavy and frequent words are known to all tasks by bit tables of fixed size
   (:class:`Bits`). Their false positives keep a rare word or cut a light prefix deeper, alike in all tasks, so they cost
   work but never change a count.
3. Subtrees. Each group sorts its suffixes, by itself; the number of a phrase is the sum of the leaves below it.

Tasks add up equal suffixes before they send them, so a pair of words that is everywhere is one row a task.
"""
from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netstate.session import materialize

LEAST, COVERED, TOP, SALTS = 10, 50, 2000, 32
#: Suffixes of a group; words with more than a quarter of that are heavy.
BUDGET = 1 << 20
FLUSH_WORDS, FLUSH_TOKENS, SEGMENT = 500_000, 2_000_000, 1 << 20
BREAK = b"."

#: A-Z lower-cased, tabs to blanks, and every mark or line end that parts pieces to one of them.
CLEAN = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 46 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))


def _tokens(text: bytes) -> Iterator[list[bytes]]:
    """Words of the text with ``BREAK`` between pieces, in parts of about ``SEGMENT`` bytes."""
    text, begin = text.translate(CLEAN), 0
    while len(text) - begin > SEGMENT and (at := text.find(b" ", begin + SEGMENT)) >= 0:
        yield text[begin:at].replace(BREAK, b" . ").split()
        begin = at
    yield text[begin:].replace(BREAK, b" . ").split()


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of every word, all partial sums of a task added up."""
    def rows(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            counts.pop(BREAK, None)
            yield pa.record_batch([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()).cast(pa.string()),
                                   pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])

    def run(batches):
        held, size = defaultdict(Counter), 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary())):
                counts = held[lang]
                size -= len(counts)
                for part in _tokens(text.as_py()):
                    counts.update(part)
                size += len(counts)
                if size > FLUSH_WORDS:
                    yield from rows(held)
                    held.clear()
                    size = 0
        yield from rows(held)

    return _rows(docs).mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Bits:
    """A set of (lang, word) as one bit for each hash: never misses a member. At most 2^26 bits (8 MB) at any size."""

    MOST = 1 << 26

    def __init__(self, words: DataFrame, count: int):
        self.size = min(self.MOST, max(1 << 12, 1 << (16 * count).bit_length()))
        slot = F.xxhash64(F.concat_ws(" ", "lang", "word")).bitwiseAND(F.lit(self.size - 1))
        bit = F.expr("shiftleft(1L, cast(_slot & 63 as int))")
        cells = words.select(slot.alias("_slot")).groupBy(F.shiftright("_slot", 6).alias("cell")).agg(F.bit_or(bit).alias("bits"))
        table = np.zeros(self.size // 64, dtype=np.int64)
        for r in cells.toLocalIterator():                           # at most 2^20 of them
            table[r["cell"]] = r["bits"]
        self.table = table.view(np.uint64)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes & np.uint64(self.size - 1)
        return (self.table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def word_hash(lang: bytes, word: bytes) -> int:
    """As Spark's xxhash64 of both, joined by a blank."""
    return xxhash.xxh64_intdigest(lang + b" " + word, seed=42)


def _mixed(*hashes: np.ndarray) -> np.ndarray:
    out = np.zeros_like(hashes[0])
    for h in hashes:
        out = (out ^ h) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


#: A suffix row; ``leaf`` ones are cut so deep that their first two words are counted by a row of their own.
NAMES = ("first", "second", "third", "n", "leaf")


class Suffixes:
    """The suffixes of the texts of a language in one task: words as numbers, 0 for a break."""

    def __init__(self, lang: str):
        self.lang, self.ids, self.parts, self.size = lang, {BREAK: 0}, [], 0

    def add(self, text: bytes) -> None:
        ids = self.ids
        for part in _tokens(text):
            self.parts.append(np.array([ids.setdefault(w, len(ids)) for w in part], dtype=np.int32))
            self.size += len(part)
        self.parts.append(np.zeros(1, dtype=np.int32))

    def blobs(self, frequent: Bits, heavy: Bits, groups: int) -> Iterator[tuple[int, bytes]]:
        """(group, packed suffixes) of the distinct suffixes of two and three words, with their numbers."""
        lang, words = self.lang.encode(), list(self.ids)
        hashes = np.array([word_hash(lang, w) for w in words], dtype=np.uint64)
        often, hot = frequent.holds(hashes), heavy.holds(hashes)
        often[0] = False
        ids = np.concatenate([*self.parts, np.zeros(2, dtype=np.int32)])
        good = often[ids]
        at = np.flatnonzero(good[:-2] & good[1:-1])
        if not len(at):
            return
        pair, where = np.unique(ids[at].astype(np.int64) << 32 | ids[at + 1], return_inverse=True)
        third = np.where(good[at + 2], ids[at + 2], 0)
        key, n = np.unique(where.astype(np.int64) << 32 | third, return_counts=True)
        first, second = pair[key >> 32] >> 32, pair[key >> 32] & 0xFFFFFFFF
        third = key & 0xFFFFFFFF
        deep = hot[first] & hot[second]
        group = np.where(deep, _mixed(hashes[first], hashes[second], hashes[third]),
                         np.where(hot[first], _mixed(hashes[first], hashes[second]), _mixed(hashes[first])))
        leaf = deep & (third > 0)
        # pairs of two heavy words: one row for the pair, and a leaf for every third word
        nodes, inverse = np.unique(key[deep] >> 32, return_inverse=True)
        ends = np.bincount(inverse, weights=n[deep], minlength=len(nodes)).astype(np.int64)
        keep = ~deep | leaf
        a, b = pair[nodes] >> 32, pair[nodes] & 0xFFFFFFFF
        group = np.concatenate([group[keep], _mixed(hashes[a], hashes[b])]) % np.uint64(groups)
        columns = [np.concatenate(x) for x in ((first[keep], a), (second[keep], b), (third[keep], np.zeros_like(a)), (n[keep], ends),
                                               (leaf[keep], np.zeros(len(a), dtype=bool)))]
        by = np.argsort(group, kind="stable")
        edges = np.flatnonzero(np.append(True, group[by][1:] != group[by][:-1]))
        for start, end in zip(edges.tolist(), [*edges[1:].tolist(), len(by)]):
            rows = by[start:end]
            yield int(group[rows[0]]), self._packed(words, [c[rows] for c in columns])

    @staticmethod
    def _packed(words: list[bytes], columns: list[np.ndarray]) -> bytes:
        """Its own words and the columns, as one compressed message."""
        used, inverse = np.unique(np.concatenate(columns[:3]), return_inverse=True)
        k = len(columns[0])
        kind = np.uint16 if len(used) < 1 << 16 else np.int32
        held = pa.array([words[i] if i else b"" for i in used.tolist()], pa.binary())
        sink = pa.BufferOutputStream()
        for arrays, names in (([held], ["word"]),
                              ([pa.array(inverse[i * k:i * k + k].astype(kind)) for i in range(3)]
                               + [pa.array(columns[3].astype(np.int64)), pa.array(columns[4])], list(NAMES))):
            batch = pa.record_batch(arrays, names=names)
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
        return sink.getvalue().to_pybytes()


def suffixes(docs: DataFrame, frequent: Bits, heavy: Bits, groups: int) -> DataFrame:
    """(lang, part, blob): the suffixes of all texts, by language and group."""
    sc = docs.sparkSession.sparkContext
    held_bits = sc.broadcast((frequent, heavy))

    def run(batches):
        held: dict[str, Suffixes] = {}

        def rows(langs):
            for lang in langs:
                out = list(held.pop(lang).blobs(*held_bits.value, groups))
                if out:
                    yield pa.record_batch([pa.array([lang] * len(out), pa.string()), pa.array([g for g, _ in out], pa.int32()),
                                           pa.array([b for _, b in out], pa.binary())], names=["lang", "part", "blob"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary())):
                mine = held.get(lang) or held.setdefault(lang, Suffixes(lang))
                mine.add(text.as_py())
                if sum(s.size for s in held.values()) > FLUSH_TOKENS:
                    yield from rows(list(held))
        yield from rows(list(held))

    return _rows(docs).mapInArrow(run, "lang string, part int, blob binary")


def subtree_counts(packed: DataFrame, least: int) -> DataFrame:
    """(lang, first, second, third, a) of the phrases of two (third null) and three words with at least ``least`` occurrences."""
    def unpacked(table: pa.Table):
        ids: dict[bytes, int] = {b"": 0}
        columns: list[list[np.ndarray]] = [[] for _ in NAMES]
        for blob in table.column("blob"):
            source = pa.BufferReader(blob.as_buffer())
            words = pa.ipc.open_stream(source).read_all().column("word").to_pylist()
            rows = pa.ipc.open_stream(source).read_all()
            numbers = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
            for i, name in enumerate(NAMES):
                x = rows.column(name).to_numpy()
                columns[i].append(numbers[x] if i < 3 else x)
        return list(ids), [np.concatenate(c) for c in columns]

    def run(key, table):
        words, (first, second, third, n, leaf) = unpacked(table)
        n = n.astype(np.int64)
        by = np.lexsort((third, second, first))                      # the sorted suffixes of the group
        first, second, third, n, leaf = (x[by] for x in (first, second, third, n, leaf))
        node = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))
        start = np.flatnonzero(node | np.append(True, third[1:] != third[:-1]))
        total = np.add.reduceat(n, start)
        three = (third[start] > 0) & (total >= least)
        node = np.flatnonzero(node)
        below = np.add.reduceat(np.where(leaf, 0, n), node)
        two = below >= least
        rows = np.concatenate([node[two], start[three]])
        named = [pa.array([words[i] for i in x[rows].tolist()], pa.binary()).cast(pa.string()) for x in (first, second)]
        last = [None] * int(two.sum()) + [words[i] for i in third[start[three]].tolist()]
        return pa.table([pa.array([key[0].as_py()] * len(rows), pa.string()), *named, pa.array(last, pa.binary()).cast(pa.string()),
                         pa.array(np.concatenate([below[two], total[three]]))], names=["lang", "first", "second", "third", "a"])

    return packed.groupBy("lang", "part").applyInArrow(run, "lang string, first string, second string, third string, a bigint")


def phrase_counts(docs: DataFrame, least: int = LEAST, budget: int = BUDGET) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words of at least ``least`` occurrences, phrases of two and three words with as many, all words by language)."""
    counted = materialize(word_counts(docs), "words")
    words = counted.where(F.col("n") >= least)
    heavy = words.where(F.col("n") > budget // 4)
    sizes = words.agg(F.count("*").alias("words"), F.count_if(F.col("n") > budget // 4).alias("heavy"), F.sum("n").alias("n")).first()
    groups = max(1, math.ceil((sizes["n"] or 0) / budget))
    bits = Bits(words, sizes["words"]), Bits(heavy, sizes["heavy"])
    phrases = materialize(subtree_counts(suffixes(docs, *bits, groups), least), "phrases")
    return words, phrases, counted.groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, least: int = LEAST, covered: int = COVERED, top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of two and three words of each language.

    The score is floor(10^6 a^2 / (l r)) of the lowest cut. A pair inside a phrase of three words with at least ``covered`` percent of
    its occurrences goes. Null languages are ``und``, null texts empty; repeated rows count each; ties go to the more frequent and then the
    smaller phrase. Texts without phrases and empty tables have no rows. Ids and other columns are not read.
    """
    words, phrases, totals = phrase_counts(docs, least, budget)
    pairs = phrases.where("third is null").select("lang", "first", "second", "a")
    triples = phrases.where("third is not null")
    one = words.select("lang", F.col("word"), F.col("n"))

    def score(left: str, right: str):
        return F.expr(f"cast(1000000 as decimal(7, 0)) * cast(a as decimal(15, 0)) * cast(a as decimal(15, 0)) "
                      f"div (cast({left} as decimal(15, 0)) * cast({right} as decimal(15, 0)))")

    def known(rows: DataFrame, column: str, name: str) -> DataFrame:
        return rows.join(one.select("lang", F.col("word").alias(column), F.col("n").alias(name)), ["lang", column])

    # pairs: one cut; gone if a longer phrase explains enough of them
    sides = triples.select("lang", F.explode(F.array(F.struct("first", "second"), F.struct(
        F.col("second").alias("first"), F.col("third").alias("second")))).alias("pair"), "a").select("lang", "pair.*", "a")
    longer = sides.groupBy("lang", "first", "second").agg(F.max("a").alias("longest"))
    left_pairs = pairs.join(longer, ["lang", "first", "second"], "left").where(
        (F.coalesce("longest", F.lit(0)) * 100 < F.col("a") * covered)).drop("longest")
    two = known(known(left_pairs, "first", "l"), "second", "r").select(
        "lang", F.concat_ws(" ", "first", "second").alias("phrase"), "a", "l", "r", score("l", "r").alias("score"))

    # three words: the lower of two cuts, the first one where they tie
    head = pairs.select("lang", "first", "second", F.col("a").alias("head"))
    tail = pairs.select("lang", F.col("first").alias("second"), F.col("second").alias("third"), F.col("a").alias("tail"))
    three = known(known(triples.join(head, ["lang", "first", "second"]).join(tail, ["lang", "second", "third"]),
                        "first", "one"), "third", "last")
    cut = three.select("lang", F.concat_ws(" ", "first", "second", "third").alias("phrase"), "a", "one", "tail", "head", "last",
                       score("one", "tail").alias("early"), score("head", "last").alias("late"))
    early = F.col("early") <= F.col("late")
    three = cut.select("lang", "phrase", "a", F.when(early, F.col("one")).otherwise(F.col("head")).alias("l"),
                       F.when(early, F.col("tail")).otherwise(F.col("last")).alias("r"), F.least("early", "late").alias("score"))

    def ranked(rows: DataFrame, *keys: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase")
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))               # a language may hold most phrases
    best = ranked(ranked(two.union(three).withColumn("salt", salt), "lang", "salt").drop("rank"), "lang")
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, doc, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split WHERE len(w) > 0),
grams AS (
  SELECT lang, w[i] AS a1, CASE WHEN i + 1 <= len(w) THEN w[i + 1] END AS a2, CASE WHEN i + 2 <= len(w) THEN w[i + 2] END AS a3 FROM places),
f1 AS (SELECT lang, a1, count(*) AS f FROM grams GROUP BY ALL),
f2 AS (SELECT lang, a1, a2, count(*) AS f FROM grams WHERE a2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, a1, a2, a3, count(*) AS f FROM grams WHERE a3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
totals AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang),
covers AS (SELECT lang, a1, a2, max(f) AS f FROM (SELECT lang, a1, a2, f FROM f3 UNION ALL SELECT lang, a2, a3, f FROM f3) GROUP BY ALL),
two AS (
  SELECT p.lang, p.a1 || ' ' || p.a2 AS phrase, p.f AS a, x.f AS l, y.f AS r
  FROM f2 p JOIN f1 x ON x.lang = p.lang AND x.a1 = p.a1 JOIN f1 y ON y.lang = p.lang AND y.a1 = p.a2
  LEFT JOIN covers c ON c.lang = p.lang AND c.a1 = p.a1 AND c.a2 = p.a2
  WHERE c.f IS NULL OR 100 * c.f < 50 * p.f),
cuts AS (
  SELECT lang, phrase, a, l, r, 1 AS k FROM two
  UNION ALL
  SELECT t.lang, t.a1 || ' ' || t.a2 || ' ' || t.a3, t.f, x.f, y.f, 1
  FROM f3 t JOIN f1 x ON x.lang = t.lang AND x.a1 = t.a1 JOIN f2 y ON y.lang = t.lang AND y.a1 = t.a2 AND y.a2 = t.a3
  UNION ALL
  SELECT t.lang, t.a1 || ' ' || t.a2 || ' ' || t.a3, t.f, x.f, y.f, 2
  FROM f3 t JOIN f2 x ON x.lang = t.lang AND x.a1 = t.a1 AND x.a2 = t.a2 JOIN f1 y ON y.lang = t.lang AND y.a1 = t.a3),
scored AS (SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
