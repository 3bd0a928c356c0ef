"""Phrase collocations by level-wise passes (Apriori).

Level 1 counts words, level k (to `LONGEST`) counts k-grams, but only those whose two overlapping
(k-1)-grams are frequent, as no other can be. Each pass reads the texts once; a task finds and hashes the words of
some megabytes at a time as arrays, counts equal grams among them and gives each phrase once with its
count, which is summed again before the shuffle, so that a phrase crosses it about once a task, however
common it is. What is broadcast between passes is a bitmap of the frequent grams' hashes, of `BITS` bits whatever the
corpus: two grams that meet in a bit let a rare gram be counted, never a frequent one be missed, and the counts
that are kept are of the phrases themselves. Level tables hold exact counts; scores of cuts, containment and
ranks are joins of these tables.

Texts are lower-cased (A to Z only), split into pieces at `[.,;:!?]`, line feed to carriage return, and
pieces into words at spaces and tabs. Null and empty texts have no words; a null language is `und`;
rows that repeat are counted each; a language without candidates gives no rows, as empty tables do. Extra
columns are ignored. Ties of score and count go by the phrase's bytes, ties of cuts to the shortest first part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import delete, drop_stored, map_groups, scratch, ship, stored
from .jaccard_join import mixed

LONGEST = 4
LEAST = 30
#: A phrase goes if a longer candidate around it has this many of 100 of its occurrences.
COVERED = 80
TOP = 2_000
#: Bits of the bitmap of frequent grams (8 MB), and of a part of it that one row brings.
BITS = 1 << 26
PART = 1 << 15
#: Bytes of text that are counted together (and the rest of the text that passes them); a task's arrays take
#: some 120 times as much.
BYTES = 400_000
#: Parts that a language's candidates are first ranked in.
SALTS = 64

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
#: What a byte is (0 of a word, 1 between words, 2 between pieces) and becomes.
KIND, LOWER = np.zeros(256, dtype=np.uint8), np.arange(256, dtype=np.uint8)
KIND[list(b" \t")] = 1
KIND[list(b".,;:!?\n\v\f\r")] = 2
LOWER[ord("A") : ord("Z") + 1] += 32


class Powers:
    """Powers of an odd base modulo 2^64, and of its inverse, as many as were asked for."""

    def __init__(self, base: int):
        self.bases = [base, pow(base, -1, 1 << 64)]
        self.of = [np.ones(1, dtype=np.uint64)] * 2

    def upto(self, n: int) -> list[np.ndarray]:
        if len(self.of[0]) < n:
            n = 1 << (n - 1).bit_length()
            self.of = [np.multiply.accumulate(np.concatenate((np.ones(1, dtype=np.uint64), np.full(n - 1, b, dtype=np.uint64)))) for b in self.bases]
        return self.of


@dataclass
class Words:
    """The words of a text: its bytes, where words begin and end, the pieces they stand in, two hashes of each."""

    text: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    piece: np.ndarray
    hashes: np.ndarray
    checks: np.ndarray


def words_of(text: bytes, lang: str, powers: tuple[Powers, Powers]) -> Words:
    raw = np.frombuffer(text, dtype=np.uint8)
    kind, low = KIND[raw], LOWER[raw]
    inside = np.concatenate(([False], kind == 0, [False]))
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[::2], turns[1::2]
    piece = np.cumsum(kind == 2, dtype=np.int64)[starts] if len(starts) else np.zeros(0, dtype=np.int64)
    seed, both = np.uint64(xxhash.xxh64_intdigest(lang.encode())), []
    wide = low.astype(np.uint64) + np.uint64(1)
    for p in powers:
        up, down = p.upto(len(low) + 1)
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(wide * up[: len(low)], dtype=np.uint64)))
        both.append(mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _C[1] + seed))
    return Words(low, starts, ends, piece, *both)


def gram_hashes(hashes: list[np.ndarray]) -> np.ndarray:
    """Hashes of grams, from arrays of the hashes of their first, second, ... words."""
    total = np.full(len(hashes[0]), len(hashes), dtype=np.uint64)
    for h, c in zip(hashes, _C, strict=False):
        total += h * c
    return mixed(total)


def gram_places(hashes: list[np.ndarray]) -> np.ndarray:
    """Their bits."""
    return gram_hashes(hashes) >> np.uint64(64 - BITS.bit_length() + 1)


def two_powers() -> tuple[Powers, Powers]:
    return Powers(0x9E3779B97F4A7C15), Powers(0xD6E8FEB86659FD93)


def bit_of(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bitmap[(places >> np.uint64(3)).astype(np.int64)] >> (places & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bitmap_of(level: DataFrame, k: int) -> bytes:
    """`BITS` bits, those of the level's phrases (of `k` words) set: made in parts by tasks, 8 MB for the
    driver to send on."""
    ship(level.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = two_powers()
        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(phrase)
            for lang, phrases in by.items():
                h = words_of(b"\n".join(phrases), lang, powers).hashes.reshape(-1, k)
                places = np.unique(gram_places([h[:, j] for j in range(k)]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array((places // PART).astype(np.int32)), pa.array((places % PART).astype(np.int32))], names=["part", "place"])

    def part(numbers, places):
        bits = np.zeros(PART, dtype=np.uint8)
        bits[places] = 1
        yield numbers[0], np.packbits(bits, bitorder="little").tobytes()

    places = level.select("lang", F.col("phrase").cast("binary")).mapInArrow(run, "part int, place int").distinct()
    out = bytearray(BITS // 8)
    for number, bits in map_groups(places, ["part"], part, "part int, bits binary").collect():
        out[number * PART // 8 : (number + 1) * PART // 8] = bits
    return bytes(out)


def grams(w: Words, k: int, frequent: np.ndarray | None, below: np.ndarray | None) -> np.ndarray:
    """Places of the words at which k-grams start that lie in one piece and whose two (k-1)-grams have
    their bits; level 1 has none to ask for."""
    n = len(w.starts) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    ok = w.piece[:n] == w.piece[k - 1 :]
    if k > 1:
        has = bit_of(frequent, gram_places([w.hashes]))
        for j in range(k):
            ok &= has[j : n + j]
    at = np.flatnonzero(ok)
    if k > 2:
        for first in (0, 1):
            at = at[bit_of(below, gram_places([w.hashes[at + first + j] for j in range(k - 1)]))]
    return at


def tallied(w: Words, at: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray]:
    """The distinct k-grams that start at the words `at`, and how often they do."""
    code = gram_hashes([w.hashes[at + j] for j in range(k)])
    order = np.argsort(code)
    ranked = code[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    first, counts = order[new], np.diff(np.append(np.flatnonzero(new), len(ranked)))
    # grams whose hashes meet are told by the other hash, and given one by one
    check = gram_hashes([w.checks[at + j] for j in range(k)])[order]
    group = np.cumsum(new) - 1
    odd = np.flatnonzero(check != check[np.flatnonzero(new)][group])
    np.subtract.at(counts, group[odd], 1)
    chosen, counts = at[np.concatenate((first, order[odd]))], np.concatenate((counts, np.ones(len(odd), dtype=np.int64)))
    starts, ends = w.starts[chosen], w.ends[chosen + k - 1]
    lengths = sum(w.ends[chosen + j] - w.starts[chosen + j] for j in range(k)) + k - 1
    # the words of most stand one white space apart and are cut out as they are
    tight = np.flatnonzero(ends - starts == lengths)
    loose = np.flatnonzero(ends - starts != lengths)
    size = lengths[tight]
    offsets = np.concatenate(([0], np.cumsum(size)))
    data = w.text[np.repeat(starts[tight] - offsets[:-1], size) + np.arange(offsets[-1])]
    data[data == ord("\t")] = ord(" ")
    cut = pa.Array.from_buffers(pa.binary(), len(tight), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
    apart = [b" ".join(w.text[w.starts[i + j] : w.ends[i + j]].tobytes() for j in range(k)) for i in chosen[loose].tolist()]
    return pa.concat_arrays([cut, pa.array(apart, pa.binary())]), counts[np.concatenate((tight, loose))]


def counted(docs: DataFrame, k: int, words=None, below=None, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, f) of all k-grams whose parts are frequent by the broadcast bitmaps `words` and
    `below` (the level under k). Level 1 counts every word."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = lambda b: None if b is None else np.frombuffer(b.value, dtype=np.uint8)
        powers, frequent, lower = two_powers(), bits(words), bits(below)

        def count(held: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                w = words_of(b"\n".join(texts), lang, powers)
                at = grams(w, k, frequent, lower)
                if len(at):
                    phrases, n = tallied(w, at, k)
                    for first in range(0, len(n), 50_000):
                        some = phrases.slice(first, 50_000)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), some, pa.array(n[first : first + 50_000])], names=["lang", "phrase", "n"])

        held: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.setdefault(lang, []).append(found := text.as_py() or b"")
                size += len(found)
                if size > BYTES:
                    yield from count(held)
                    held, size = {}, 0
        yield from count(held)

    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "lang string, phrase binary, n long")
    return rows.groupBy("lang", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("n").alias("f"))


def levels(docs: DataFrame, work: str, *, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all frequent phrases, and (lang, n), all words of each language."""
    spark, cols = docs.sparkSession, {"text_col": text_col, "lang_col": lang_col}
    words = stored(counted(docs, 1, **cols), "phrase-words", work)
    totals = stored(words.groupBy("lang").agg(F.sum("f").alias("n")), "phrase-totals", work)
    out = [stored(words.filter(F.col("f") >= least), "phrase-level", work)]
    drop_stored(spark, words)
    held = [spark.sparkContext.broadcast(bitmap_of(out[0], 1))]
    for k in range(2, longest + 1):
        # counted for its own level only; nothing but the frequent is written
        out.append(stored(counted(docs, k, held[0], held[-1], **cols).filter(F.col("f") >= least), "phrase-level", work))
        if k < longest:
            held.append(spark.sparkContext.broadcast(bitmap_of(out[-1], k)))
    for b in held:
        b.destroy()
    table = out[0].withColumn("k", F.lit(1))
    for k, more in enumerate(out[1:], 2):
        table = table.unionByName(more.withColumn("k", F.lit(k)))
    return table, totals


def words_between(phrase: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, n), " ")


def collocations(docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's `top` phrases of 2 to `longest` words."""
    spark, work = docs.sparkSession, scratch(docs.sparkSession, "phrases")
    found, totals = levels(docs, work, least=least, longest=longest, text_col=text_col, lang_col=lang_col)
    candidates = found.filter("k > 1").withColumnRenamed("f", "a")
    # every cut's two parts, each joined to its own count: a frequent phrase's parts are frequent
    cuts = candidates.select("lang", "phrase", "a", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    parts = cuts.select("lang", "phrase", "a", "cut", F.inline(F.array(F.struct(F.lit(True).alias("left"), words_between(F.col("phrase"), F.lit(1), F.col("cut")).alias("part")), F.struct(F.lit(False).alias("left"), words_between(F.col("phrase"), F.col("cut") + 1, F.col("k")).alias("part")))))
    counts = found.select(F.col("lang").alias("of_lang"), F.col("phrase").alias("of"), "f")
    parts = parts.join(counts, (F.col("lang") == F.col("of_lang")) & (F.col("part") == F.col("of")))
    cut = parts.groupBy("lang", "phrase", "a", "cut").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    # decimals of 38 digits: 2,000,000 times a count may pass 64 bits
    cut = cut.withColumn("score", F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"))
    best = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    longer = candidates.filter("k > 2").select("lang", "a", "k", "phrase", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
    longer = longer.select("lang", "a", "phrase", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("first"))
    around = longer.groupBy(F.col("lang").alias("in_lang"), words_between(F.col("phrase"), F.col("first"), F.col("size")).alias("inner")).agg(F.max("a").alias("around"))
    covered = F.coalesce(F.expr(f"cast(100 as decimal(3,0)) * cast(around as decimal(19,0)) >= cast({COVERED} as decimal(3,0)) * cast(a as decimal(19,0))"), F.lit(False))
    kept = best.join(around, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("inner")), "left").filter(~covered)
    kept = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    # ranked in parts first, so that no language's candidates meet whole in one task
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    out = stored(ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrase-ranks")
    delete(spark, work)
    return out
