"""Media columns from ISO base media containers: boxes are walked and sample tables decoded, the
media payload is never decoded.

`describe` reads a container (any box order, 32- and 64-bit box sizes, boxes to the end of the file,
nested boxes, plain and compact sample sizes, movie fragments) and gives of every track its codec,
timescale, duration, the media time at which its first edit begins, the sample count and the byte range
of every keyframe. `mux`
writes bytes losslessly as one track of 8-bit samples: `UNIT`-byte frames of codec `raw `, a
keyframe every `GROUP` frames, `CHUNK` frames a chunk.

Null text counts as empty (a payload of one frame of zeros); malformed, truncated or null containers
give a null description rather than an error: whatever a table claims is held against the box, the
file and the other tables before anything is made for it. Repeated rows stay repeated; extra
columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import pairwise

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

UNIT = 64
GROUP = 16
CHUNK = 64
RATE = 8_000
#: Boxes that hold boxes.
NESTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"mvex", b"moof", b"traf"}
#: Deepest nesting of boxes that is read; sample tables stand five deep.
DEEPEST = 16


class Malformed(ValueError):
    """The bytes are not a readable ISO media container."""


def boxes(data: memoryview, at: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, first byte of the content, end) of the boxes from `at` to `end`."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise Malformed("box header cut short")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise Malformed(f"box {kind!r} of {size} bytes passes its parent's end")
        yield kind, at + head, at + size
        at += size
    if at != end:
        raise Malformed("bytes after the last box")


def tree(data: memoryview) -> list:
    """Nested [(kind, begin, end, children)], walked with a stack; nests deeper than `DEEPEST` are malformed."""
    top: list = []
    todo = [(0, len(data), top, 0)]
    while todo:
        begin, end, into, depth = todo.pop()
        for kind, a, b in boxes(data, begin, end):
            children: list = []
            into.append((kind, a, b, children))
            if kind in NESTS:
                if depth == DEEPEST:
                    raise Malformed("boxes nest too deep")
                todo.append((a, b, children, depth + 1))
    return top


def _all(nodes: list, kind: bytes) -> list:
    return [n for n in nodes if n[0] == kind]


def _first(nodes: list, *path: bytes):
    for kind in path:
        node = next((n for n in nodes if n[0] == kind), None)
        if node is None:
            raise Malformed(f"no {kind!r} box")
        nodes = node[3]
    return node


def _table(data: memoryview, node, entry: str, at: int = 8) -> list[tuple]:
    """Entries of a full box whose count stands before them."""
    begin, end = node[1], node[2]
    n, width = struct.unpack_from(">I", data, begin + at - 4)[0], struct.calcsize(entry)
    if begin + at + n * width > end:
        raise Malformed(f"{node[0]!r} table passes its box")
    return list(struct.iter_unpack(entry, data[begin + at : begin + at + n * width]))


def _sizes(view: memoryview, table: list) -> list[int]:
    """Sample sizes: one for all, 32 bits each, or compact (4, 8 or 16 bits each)."""
    compact = _all(table, b"stz2")
    if compact and not _all(table, b"stsz"):
        _, begin, end, _ = compact[0]
        width, n = struct.unpack_from(">BI", view, begin + 7)
        if width == 4:
            if begin + 12 + (n + 1) // 2 > end:
                raise Malformed("stz2 table passes its box")
            return [x for byte in view[begin + 12 : begin + 12 + (n + 1) // 2] for x in (byte >> 4, byte & 15)][:n]
        if width not in (8, 16):
            raise Malformed(f"sample sizes of {width} bits")
        return [x[0] for x in _table(view, compact[0], ">B" if width == 8 else ">H", 12)]
    stsz = _first(table, b"stsz")
    fixed, n = struct.unpack_from(">II", view, stsz[1] + 4)
    if not fixed:
        return [x[0] for x in _table(view, stsz, ">I", 12)]
    # the file must hold that many before anything is made for them
    if fixed * n > len(view):
        raise Malformed("samples pass the file's end")
    return [fixed] * n


def _samples(view: memoryview, table: list, sizes: list[int]) -> list[tuple[int, int]]:
    """(offset, size) of the samples, chunk by chunk."""
    long = bool(_all(table, b"co64"))
    chunks = [x[0] for x in _table(view, _first(table, b"co64" if long else b"stco"), ">Q" if long else ">I")]
    runs = _table(view, _first(table, b"stsc"), ">III")
    samples: list[tuple[int, int]] = []
    for r, (start, per, _) in enumerate(runs):
        stop = runs[r + 1][0] if r + 1 < len(runs) else len(chunks) + 1
        if not 1 <= start < stop <= len(chunks) + 1 or not per:
            raise Malformed("chunk runs out of order")
        for at in chunks[start - 1 : stop - 1]:
            for size in sizes[len(samples) : len(samples) + per]:
                if at + size > len(view):
                    raise Malformed("a sample passes the file's end")
                samples.append((at, size))
                at += size
    if len(samples) != len(sizes) or runs and runs[0][0] != 1:
        raise Malformed("sample tables disagree")
    return samples


def _times(view: memoryview, table: list, n: int) -> list[int]:
    times: list[int] = []
    t = 0
    for count, delta in _table(view, _first(table, b"stts"), ">II"):
        if len(times) + count > n:
            raise Malformed("more times than samples")
        times += range(t, t + count * delta, delta) if delta else [t] * count
        t += count * delta
    if len(times) != n:
        raise Malformed("fewer times than samples")
    return times


def _keyframes(view: memoryview, table: list, n: int) -> list[int]:
    """0-based numbers of the samples that can be decoded alone: all, unless a sync table names some."""
    sync = _all(table, b"stss")
    if not sync:
        return list(range(n))
    keys = [x[0] for x in _table(view, sync[0], ">I")]
    if any(not 1 <= k <= n for k in keys) or any(a >= b for a, b in pairwise(keys)):
        raise Malformed("the sync table names samples that are not there, or out of order")
    return [k - 1 for k in keys]


def _fragments(view: memoryview, top: list, found: dict[int, dict]) -> None:
    """Append the samples of movie fragments (moof) to their tracks."""
    defaults = {}
    for trex in _all(_all(_first(top, b"moov")[3], b"mvex")[0][3], b"trex") if _all(_first(top, b"moov")[3], b"mvex") else []:
        number, _, duration, size, flags = struct.unpack_from(">5I", view, trex[1] + 4)
        defaults[number] = (duration, size, flags)
    for moof in _all(top, b"moof"):
        here = end = moof[1] - (8 if view[moof[1] - 4 : moof[1]] == b"moof" else 16)
        for traf in _all(moof[3], b"traf"):
            tfhd = _first(traf[3], b"tfhd")
            which, number = struct.unpack_from(">II", view, tfhd[1])
            if number not in found:
                raise Malformed(f"a fragment of track {number}, which is not there")
            track, at = found[number], tfhd[1] + 8
            duration, size, flags = defaults.get(number, (0, 0, 0))
            base = here if which & 0x20000 or traf is _all(moof[3], b"traf")[0] else end
            if which & 0x1:
                base, at = struct.unpack_from(">Q", view, at)[0], at + 8
            at += 4 * bool(which & 0x2)
            if which & 0x8:
                duration, at = struct.unpack_from(">I", view, at)[0], at + 4
            if which & 0x10:
                size, at = struct.unpack_from(">I", view, at)[0], at + 4
            if which & 0x20:
                flags = struct.unpack_from(">I", view, at)[0]
            for tfdt in _all(traf[3], b"tfdt"):
                track["next"] = struct.unpack_from(">Q" if view[tfdt[1]] else ">I", view, tfdt[1] + 4)[0]
            place = base
            for trun in _all(traf[3], b"trun"):
                has, n = struct.unpack_from(">II", view, trun[1])
                at = trun[1] + 8
                if has & 0x1:
                    place, at = base + struct.unpack_from(">i", view, at)[0], at + 4
                first = None
                if has & 0x4:
                    first, at = struct.unpack_from(">I", view, at)[0], at + 4
                width = 4 * ((has >> 8) & 15).bit_count()
                if at + n * width > trun[2] or not width and n * max(size, 1) > len(view):
                    raise Malformed("a run passes its box or the file")
                for k in range(n):
                    d, z, f = duration, size, first if first is not None and not k else flags
                    if has & 0x100:
                        d, at = struct.unpack_from(">I", view, at)[0], at + 4
                    if has & 0x200:
                        z, at = struct.unpack_from(">I", view, at)[0], at + 4
                    if has & 0x400:
                        f, at = struct.unpack_from(">I", view, at)[0], at + 4
                    at += 4 * bool(has & 0x800)
                    if place < 0 or place + z > len(view):
                        raise Malformed("a sample passes the file's end")
                    if not f & 0x10000:
                        track["keyframes"].append(len(track["samples"]))
                    track["samples"].append((place, z))
                    track["times"].append(track["next"])
                    track["next"] += d
                    place += z
            end = place
            track["duration"] = max(track["duration"], track["next"])


def _edit(view: memoryview, trak) -> int:
    """Media time at which the track's presentation begins: the first edit that is not empty."""
    for edts in _all(trak[3], b"edts"):
        for elst in _all(edts[3], b"elst"):
            wide = view[elst[1]] == 1
            for _, start, _ in _table(view, elst, ">Qqi" if wide else ">Iii"):
                if start >= 0:
                    return start
    return 0


def tracks(data: bytes) -> list[dict]:
    """The tracks of a container: handler, codec, timescale, duration, start (media time of the first
    edit), samples (offset, size), decoding times and 0-based keyframes."""
    view = memoryview(data)
    try:
        found: dict[int, dict] = {}
        top = tree(view)
        for trak in _all(_first(top, b"moov")[3], b"trak"):
            mdhd, hdlr = _first(trak[3], b"mdia", b"mdhd"), _first(trak[3], b"mdia", b"hdlr")
            table = _first(trak[3], b"mdia", b"minf", b"stbl")[3]
            wide = view[mdhd[1]] == 1
            timescale, duration = struct.unpack_from(">IQ" if wide else ">II", view, mdhd[1] + (20 if wide else 12))
            if duration >= 1 << 63:
                raise Malformed("a duration beyond 63 bits")
            stsd = _first(table, b"stsd")
            codec = bytes(view[stsd[1] + 12 : stsd[1] + 16]).decode("latin-1")
            sizes = _sizes(view, table)
            samples, times = _samples(view, table, sizes), _times(view, table, len(sizes))
            head = _all(trak[3], b"tkhd")
            number = struct.unpack_from(">I", view, head[0][1] + (20 if view[head[0][1]] == 1 else 12))[0] if head else -1 - len(found)
            if number in found:
                number = -1 - len(found)
            handler = bytes(view[hdlr[1] + 8 : hdlr[1] + 12]).decode("latin-1")
            found[number] = {"handler": handler, "codec": codec, "timescale": timescale, "duration": duration, "start": _edit(view, trak), "samples": samples, "times": times, "keyframes": _keyframes(view, table, len(sizes)), "next": 0}
        _fragments(view, top, found)
        if not found:
            raise Malformed("no track")
        return list(found.values())
    except (struct.error, IndexError, ValueError, OverflowError, MemoryError) as e:
        raise e if isinstance(e, Malformed) else Malformed(str(e)) from e


def described(track: dict) -> dict:
    """Columns of a track: handler, codec, timescale, duration, start, n_samples and keyframes (sample,
    time, offset, length), the range of each the keyframe's own sample."""
    t = track
    return {k: t[k] for k in ("handler", "codec", "timescale", "duration", "start")} | {"n_samples": len(t["samples"]), "keyframes": [(k, t["times"][k], *t["samples"][k]) for k in t["keyframes"]]}


def describe_tracks(data: bytes) -> list[dict]:
    """Columns of every track, in file order."""
    return [described(t) for t in tracks(data)]


def describe(data: bytes) -> dict:
    """Columns of the first track."""
    return describe_tracks(data)[0]


def samples_of(data: bytes) -> bytes:
    """The stored payload: the first track's samples in decoding order, as they stand."""
    return _payload(memoryview(data), tracks(data)[0])


def _payload(view: memoryview, track: dict) -> bytes:
    runs: list[list[int]] = []
    for at, size in track["samples"]:
        if runs and runs[-1][1] == at:
            runs[-1][1] = at + size
        else:
            runs.append([at, at + size])
    return b"".join(view[a:b] for a, b in runs)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def mux(payload: bytes) -> bytes:
    """A container of `payload` (a positive multiple of `UNIT` bytes) as `UNIT`-byte frames."""
    n = len(payload) // UNIT
    if not n or len(payload) % UNIT:
        raise ValueError(f"payload must be a positive multiple of {UNIT} bytes")
    n_chunks, length = -(-n // CHUNK), n * UNIT
    ftyp = _box(b"ftyp", b"qt  ", struct.pack(">I", 0), b"qt  ", b"isom")
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    keys = range(1, n + 1, GROUP)
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))

    def moov(first: int) -> bytes:
        offsets = [first + c * CHUNK * UNIT for c in range(n_chunks)]
        # all chunks are full but perhaps the last
        last = n - (n_chunks - 1) * CHUNK
        runs = [(1, CHUNK if n_chunks > 1 else last, 1)] + ([(n_chunks, last, 1)] if n_chunks > 1 and last != CHUNK else [])
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, UNIT)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
            _full(b"stsz", struct.pack(">II", UNIT, n)),
            _full(b"co64", struct.pack(f">I{n_chunks}Q", n_chunks, *offsets)),
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        minf = _box(b"minf", _full(b"smhd", bytes(4)), dinf, stbl)
        mdhd = _box(b"mdhd", struct.pack(">B3xQQIQ", 1, 0, 0, RATE, length), struct.pack(">HH", 0x55C4, 0))
        hdlr = _full(b"hdlr", bytes(4), b"soun", bytes(12), b"bytes\0")
        tkhd = _box(b"tkhd", struct.pack(">I", 0x01000007), struct.pack(">QQII", 0, 0, 1, 0), struct.pack(">Q", length), bytes(8), struct.pack(">hhhH", 0, 0, 0x100, 0), matrix, bytes(8))
        mvhd = _box(b"mvhd", struct.pack(">I", 0x01000000), struct.pack(">QQIQ", 0, 0, RATE, length), struct.pack(">IH", 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, minf)))

    head = len(ftyp) + len(moov(0)) + 16
    return b"".join((ftyp, moov(head), struct.pack(">I4sQ", 1, b"mdat", length + 16), payload))


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes((-len(raw)) % UNIT or (0 if raw else UNIT))


KEYFRAMES = "array<struct<sample:long,time:long,offset:long,length:long>>"
TRACKS = f"array<struct<handler:string,codec:string,timescale:long,duration:long,start:long,n_samples:long,keyframes:{KEYFRAMES}>>"


def media_columns(files: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """(id, codec, timescale, duration, n_samples, keyframes, tracks) of the containers in `data_col`:
    the columns of the first track, and a struct of them with its handler for every track."""

    def make():
        def rows(keys, blobs):
            for key, blob in zip(keys, blobs, strict=True):
                try:
                    every = describe_tracks(blob or b"")
                    for d in every:
                        d["keyframes"] = [dict(zip(("sample", "time", "offset", "length"), k, strict=True)) for k in d["keyframes"]]
                    d = every[0]
                    yield key, d["codec"], d["timescale"], d["duration"], d["n_samples"], d["keyframes"], every
                except Malformed:
                    yield key, None, None, None, None, None, None

        return rows

    kind = files.schema[id_col].dataType.simpleString()
    return map_rows(files.select(id_col, data_col), make, f"`{id_col}` {kind}, codec string, timescale long, duration long, n_samples long, keyframes {KEYFRAMES}, tracks {TRACKS}")


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text in a container and read it back: (id, n_bytes, media, payload as read back,
    feature). `feature` is codec, timescale, duration, samples, keyframes and a CRC of their ranges."""

    def make():
        def rows(keys, texts):
            for key, text in zip(keys, texts, strict=True):
                n, payload = padded(text)
                media = mux(payload)
                track = tracks(media)[0]
                d = described(track)
                ranges = zlib.crc32(b"".join(struct.pack(">4Q", *k) for k in d["keyframes"]))
                yield key, n, media, _payload(memoryview(media), track), f"codec={d['codec'].strip()};timescale={d['timescale']};duration={d['duration']};samples={d['n_samples']};keyframes={len(d['keyframes'])};ranges={ranges:08x}"

        return rows

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(F.col(id_col), F.col(text_col)), make, f"`{id_col}` {kind}, n_bytes long, media binary, payload binary, feature string")
