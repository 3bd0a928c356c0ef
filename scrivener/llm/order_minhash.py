"""Order MinHash fingerprints: locality-sensitive signatures for edit distance.

A text's k-mers of code points are numbered by occurrence, so that (k-mer, occurrence) pairs are
distinct. Each of the `SIGNATURES` selections hashes all pairs by a function of its own and takes
the two of least hash, which are put back in text order and hashed together, so the signature
agrees only if two texts select the same pairs in the same order. A text of one pair selects that
one; a text shorter than `K` is its own only k-mer; the empty text has a fingerprint of zeros,
like only another empty text's.

Null text counts as empty. Documents are followed in descending id; ties of ids are ordered by a
hash of the text. Extra columns are ignored, repeated rows stay repeated, empty tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

K = 8
SIGNATURES = 64
#: Pairs hashed at a time: 64 rows of them stay in a core's cache.
BLOCK = 4_096
#: Documents of a range, which one task follows in order, and most ranges.
RANGE_ROWS = 4_000
MOST_RANGES = 20_000
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_POS = np.uint64(20)
_POS_MASK = np.uint64((1 << 20) - 1)
_S32, _S29 = np.uint64(32), np.uint64(29)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiply and fold, twice."""
    x = (x ^ (x >> _S32)) * _A
    x = (x ^ (x >> _S29)) * _B
    return x ^ (x >> _S32)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def kmers(codes: np.ndarray) -> np.ndarray:
    """Hashes of the k-mers, by doubling: 2, 4, 8 code points."""
    if len(codes) < K:
        h = np.uint64(len(codes))
        for c in codes:
            h = mixed(np.array([h ^ c]))[0]
        return np.array([h], dtype=np.uint64)
    two = codes[:-1] * _A + codes[1:]
    two ^= two >> _S29
    four = two[:-2] * _B + two[2:]
    four ^= four >> _S32
    return mixed(four[:-4] * _C + four[4:])


def selectors() -> tuple[np.ndarray, np.ndarray]:
    """An odd factor and a term for each of the `SIGNATURES` selections."""
    rng = np.random.default_rng(8)
    return (rng.integers(0, 1 << 31, SIGNATURES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None], rng.integers(0, 1 << 32, SIGNATURES, dtype=np.uint32)[:, None]


_FACTORS, _TERMS = selectors()
_ROWS = np.arange(SIGNATURES)
_NONE = np.uint32(0xFFFFFFFF)


def numbered_pairs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of every (k-mer, occurrence) pair, in order of the k-mers' hashes."""
    n = len(h)
    at = np.arange(n, dtype=np.uint64)
    if n <= 1 << 20:
        # the place stands in the key's low bits, so sorting keys alone keeps text order
        key = (h & ~_POS_MASK) | at
        key.sort()
        place, run = key & _POS_MASK, key >> _POS
    else:
        order = np.argsort(h, kind="stable")
        place, run = at[order], (h >> _POS)[order]
    begins = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    lengths = np.diff(np.append(begins, n))
    occurrence = np.arange(n, dtype=np.uint64) - np.repeat(begins.astype(np.uint64), lengths)
    return mixed(run * _C + occurrence), place


def least_two(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every selection, where its pairs of least and second least hash stand (-1: there is none)."""
    low = (pairs >> _S32).astype(np.uint32)
    best = np.full((2, SIGNATURES), _NONE)
    where = np.full((2, SIGNATURES), -1, dtype=np.int64)
    room = np.empty((SIGNATURES, min(BLOCK, len(low))), dtype=np.uint32)
    for at in range(0, len(low), BLOCK):
        some = low[at : at + BLOCK]
        hashes = np.multiply(_FACTORS, some, out=room[:, : len(some)])
        hashes += _TERMS
        for _ in range(2):
            i = hashes.argmin(axis=1)
            value = hashes[_ROWS, i]
            hashes[_ROWS, i] = _NONE
            if len(some) == 1 and _ == 1:
                break
            # the new value goes before what it is less than; what it pushes out moves down
            first = (value < best[0]) | (where[0] < 0)
            second = ~first & ((value < best[1]) | (where[1] < 0))
            best[1] = np.where(first, best[0], np.where(second, value, best[1]))
            where[1] = np.where(first, where[0], np.where(second, at + i, where[1]))
            best[0] = np.where(first, value, best[0])
            where[0] = np.where(first, at + i, where[0])
    return where[0], where[1]


def signature(codes: np.ndarray) -> np.ndarray:
    """`SIGNATURES` values of 16 bits, none 0 but of the empty text."""
    if not len(codes):
        return np.zeros(SIGNATURES, dtype=np.uint16)
    pairs, place = numbered_pairs(kmers(codes))
    i, j = least_two(pairs)
    j = np.where(j < 0, i, j)
    swap = place[i] > place[j]
    a, b = np.where(swap, pairs[j], pairs[i]), np.where(swap, pairs[i], pairs[j])
    out = (mixed(a * _A + mixed(b + _C)) >> np.uint64(48)).astype(np.uint16)
    out[out == 0] = 1
    return out


def fingerprint(text: str | None) -> str:
    return signature(points(text or "")).astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal signatures."""
    return float(np.count_nonzero(a == b)) / SIGNATURES


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint) of every row."""
    from .common import map_rows

    def make():
        def rows(keys, texts):
            for key, text in zip(keys, texts, strict=True):
                yield key, len(text or ""), fingerprint(text)

        return rows

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(F.col(id_col), F.col(text_col)), make, f"`{id_col}` {kind}, n_chars long, fingerprint string")


def range_of(value, cuts: list[int]):
    """Number of the sorted `cuts` below `value`: first among every step-th cut, then within that step."""
    if not cuts:
        return F.lit(0)

    def array(xs):
        return F.split(F.lit(",".join(map(str, xs))), ",").cast("array<long>")

    step = int(len(cuts) ** 0.5) + 1
    coarse = F.size(F.filter(array(cuts[step - 1 :: step]), lambda c: c < value)) if len(cuts) >= step else F.lit(0)
    return coarse * step + F.size(F.filter(F.slice(array(cuts), coarse * step + 1, F.lit(step)), lambda c: c < value))


def in_ranges(docs: DataFrame, id_col: str, text_col: str, rows_each: int = RANGE_ROWS) -> DataFrame:
    """(range_, heir_, id_, text_): documents dealt into ranges of descending id, each followed by
    the first document of the next range (heir_ 1); the last range gets the first document of all.
    A range holds about `rows_each` ids, more beyond `MOST_RANGES` ranges; one id a range reaches
    the driver."""
    spark = docs.sparkSession
    ids = docs.select(F.col(id_col).cast("long").alias("id_")).filter("id_ is not null")
    n_ranges = min(MOST_RANGES, max(1, -(-ids.count() // rows_each)))
    share = [k / n_ranges for k in range(1, n_ranges)]
    cuts = sorted(set(ids.agg(F.percentile_approx("id_", share, 20 * n_ranges)).first()[0] or [])) if share else []
    rows = docs.select(F.col(id_col).cast("long").alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    # range 0 holds the highest ids, null ids come last
    number = F.when(F.col("id_").isNull(), len(cuts) + 1).otherwise(F.lit(len(cuts)) - range_of(F.col("id_"), cuts))
    rows = rows.select(number.cast("int").alias("range_"), F.lit(0).alias("heir_"), "id_", "text_")
    order = [(r[0], r[1]) for r in rows.groupBy("range_").agg(F.max("id_")).orderBy("range_").collect()]
    if not order:
        return rows
    follows = [(order[(k + 1) % len(order)][1], order[k][0]) for k in range(len(order))]
    given = F.broadcast(spark.createDataFrame(follows, "head_ long, to_ int"))
    heirs = rows.join(given, F.col("id_").eqNullSafe(F.col("head_"))).select(F.col("to_").alias("range_"), F.lit(1).alias("heir_"), "id_", "text_")
    return rows.unionByName(heirs)


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document against itself edited (its last half replaced by as many first code points of
    the next document in descending id) and against that next document: id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    ship(spark)
    ranged = in_ranges(docs, id_col, text_col)
    dealt = ranged.repartition(F.col("range_")).sortWithinPartitions("range_", "heir_", F.desc_nulls_last("id_"), F.xxhash64("text_"), "text_")
    schema = f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    arrow = pa.schema([(id_col, pa.int64()), ("n_chars", pa.int64()), *[(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches):
        last = None  # (range, id, codes, signature) of the row that waits for the next

        def closed(codes, sig, key, after, after_sig):
            n = len(codes)
            cut = n - n // 2
            edited = np.concatenate((codes[:cut], after[: n // 2]))
            raw = edited.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
            esig = signature(edited)
            hexes = [s.astype(">u2").tobytes().hex() for s in (sig, esig)]
            return key, n, hashlib.sha256(raw).hexdigest(), *hexes, likeness(sig, esig), likeness(sig, after_sig)

        for batch in batches:
            out = []
            for r, k, key, text in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if k and (last is None or last[0] != r):
                    continue  # a further row with the head's id
                codes = points(text)
                sig = signature(codes)
                if last is not None and last[0] == r:
                    out.append(closed(last[2], last[3], last[1], codes, sig))
                last = None if k else (r, key, codes, sig)
                if len(out) >= 512:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

    return dealt.mapInArrow(run, schema)
