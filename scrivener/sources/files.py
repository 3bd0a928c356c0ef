"""Readers and writers of the engine's files: JSON arrays, JSON lines, text, WAV.

Readers take an explicit schema; records that do not parse are dropped one by one, and a missing
or empty folder reads as an empty table (or as defaults, where given).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.operators.ordering import numbered

HISTORY = "text string, timestamp string, wordCount bigint, durationMs bigint, speechDurationMs bigint, wasCleanedUp boolean"
DICTIONARY = "ord int, `from` string, `to` string"
SNIPPETS = "ord int, trigger string, expansion string"
ANNOUNCEMENTS = "id string, title string, body string, minVersion string, maxVersion string"
RESULTS = "model string, timestamp string, results array<struct<id:int,name:string,mode:string,input:string,raw_input:string,output:string,expected:string,time_ms:double>>"
#: Snippets of an installation that has none yet.
DEFAULT_SNIPPETS = [(0, "my email address", "user@example.com"), (1, "my signature", "Best regards,\n[Your Name]")]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_json(spark: SparkSession, path: str, schema: str, default: DataFrame | None = None, whole: bool = True) -> DataFrame:
    """JSON arrays (`whole`) or JSON lines; `default`, or no rows, where the path is missing."""
    if not exists(spark, path):
        return default if default is not None else spark.createDataFrame([], schema)
    rows = spark.read.schema(schema + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("multiLine", whole).json(path)
    # the second half is always true; it keeps a field in every scan, without which none is parsed
    first = F.col(f"`{rows.columns[0]}`")
    return rows.filter(F.col("_bad").isNull() & (first.isNull() | first.isNotNull())).drop("_bad")


#: Entries of one array of a file; longer lists are several arrays, a line each.
ARRAY_ROWS = 1000


def in_arrays(df: DataFrame, *keys: str) -> DataFrame:
    """`df` with `block_`, by which rows of equal keys are put into arrays of at most `ARRAY_ROWS`, as they lie
    in their partitions: no row moves for it, however many a key has."""
    return df.sortWithinPartitions(*keys).withColumn("block_", F.floor(F.monotonically_increasing_id() / ARRAY_ROWS))


#: Folders that the values of a part are hashed to: a fixed number of open files, however many values there are.
FOLDERS = 16


def write_json_arrays(df: DataFrame, path: str, part: str) -> None:
    """JSON arrays, a line each, of rows that have one value of `part`; a value's lines lie in the folder
    `folder=` its hash modulo `FOLDERS`."""
    entry = F.struct(*[c for c in df.columns if c != part])
    rows = in_arrays(df, part).groupBy(part, "block_").agg(F.to_json(F.collect_list(entry)).alias("value"))
    rows.select("value", F.pmod(F.xxhash64(part), F.lit(FOLDERS)).alias("folder")).write.partitionBy("folder").mode("overwrite").text(path)


def read_history(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """History entries; fields of later versions that are missing get their defaults. `whole`: a file is one
    array, else each line is."""
    return read_json(spark, path, HISTORY, whole=whole).fillna({"speechDurationMs": 0, "wasCleanedUp": False})


def read_snippets(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, SNIPPETS, spark.createDataFrame(DEFAULT_SNIPPETS, SNIPPETS))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return read_json(spark, path, schema, whole=False)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def resumed_append(spark: SparkSession, df: DataFrame, path: str, schema: str, wanted: int, key: str) -> int:
    """Append the rows of `df` (in order of `key`) that `path` still lacks to have `wanted`; the
    number of rows that were there."""
    there = read_jsonl(spark, path, schema).count()
    if there < wanted:
        # by ranges, so that a large rest does not pass through one task
        at = numbered(df, key, name="resume_at_").filter((F.col("resume_at_") >= there) & (F.col("resume_at_") < wanted))
        at.drop("resume_at_").write.mode("append").json(path)
    return there


def read_results(spark: SparkSession, folder: str, whole: bool = True) -> DataFrame:
    """One row a result of all result files in a folder, with its file's name; a file is one record, or (not
    `whole`) has one a line."""
    rows = spark.read.schema(RESULTS).option("multiLine", whole).json(folder).withColumn("file", F.col("_metadata.file_name"))
    return rows.select("file", "model", "timestamp", F.inline("results"))


def write_results(results: DataFrame, folder: str) -> None:
    """A folder of results by model (names made safe), as nested rows of at most `ARRAY_ROWS`, a line each."""
    entry = F.struct(*[c for c in results.columns if c not in ("model", "timestamp")])
    nested = in_arrays(results, "model", "timestamp").groupBy("model", "timestamp", "block_").agg(F.sort_array(F.collect_list(entry)).alias("results")).drop("block_")
    nested.withColumn("file", F.regexp_replace("model", "[^a-zA-Z0-9._-]", "_")).write.partitionBy("file").mode("overwrite").json(folder)


def write_text(lines: DataFrame, column: str, order: str, path: str) -> None:
    """Text files whose lines follow `order`, across files too."""
    lines.repartitionByRange(order).sortWithinPartitions(order).select(column).write.mode("overwrite").option("lineSep", "\n---\n\n").text(path)


def fetched(spark: SparkSession, source: str, cache: str, schema: str, whole: bool = True) -> DataFrame:
    """`source` where it can be read (kept in `cache` then), else what `cache` holds."""
    if exists(spark, source):
        read_json(spark, source, schema, whole=whole).write.mode("overwrite").json(cache)
    return read_json(spark, cache, schema, whole=False)


def wav_encoded(clips: DataFrame, id_col: str = "clip_id", samples: str = "samples", rate: int = 16_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, wav, *keep): every clip as a mono 16-bit WAV file; samples are scaled, clamped and cut."""
    kinds = [f"`{c}` {clips.schema[c].dataType.simpleString()}" for c in (id_col, *keep)]
    name, kept = samples, [id_col, *keep]

    def encode(batches):
        import struct

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for s in batch.column(name):
                values = np.asarray(s.values.to_numpy(zero_copy_only=False) if s.is_valid else [], dtype=np.float64)
                pcm = np.trunc(np.clip(values * 32767, -32768, 32767)).astype("<i2").tobytes()
                head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(pcm), b"WAVE", b"fmt ", 16, 1, 1, rate, rate * 2, 2, 16, b"data", len(pcm))
                out.append(head + pcm)
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(out, pa.binary())], names=[*kept, "wav"])

    return clips.select(*kept, samples).mapInArrow(encode, f"{', '.join(kinds)}, wav binary")


WAV = "samples array<double>, rate int, channels int, problem string"


def wav_samples(data: bytes | None) -> tuple:
    """(samples, rate, channels, problem) of a WAV file of whole-number PCM (8 to 32 bits) or 32-bit
    floats: channels interleaved as they are, whole numbers by their largest value. Without a readable
    header there are no samples; of data cut short those of whole frames are given, and the problem says so."""
    import struct

    import numpy as np

    if data is None or len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None, None, None, "no wave file"
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            if len(body) < 16:
                return None, None, None, "header cut short"
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            if kind == 0xFFFE and len(body) >= 26:  # the extensible form names its kind further on
                kind = struct.unpack_from("<H", body, 24)[0]
            form = kind, channels, rate, bits
        elif name == b"data":
            if form is None:
                return None, None, None, "no format"
            kind, channels, rate, bits = form
            if not channels or (kind, bits) not in {(1, 8), (1, 16), (1, 24), (1, 32), (3, 32)}:
                return None, rate, channels, "unknown format"
            width = bits // 8
            whole = len(body) // (width * channels) * width * channels
            body = body[:whole]
            if kind == 3:
                values = np.frombuffer(body, dtype="<f4").astype(np.float64)
            elif bits == 8:
                values = (np.frombuffer(body, dtype=np.uint8).astype(np.float64) - 128) / 127
            elif bits == 24:
                wide = np.zeros((whole // 3, 4), dtype=np.uint8)
                wide[:, 1:] = np.frombuffer(body, dtype=np.uint8).reshape(-1, 3)
                values = (wide.view("<i4").ravel() >> 8) / float((1 << 23) - 1)
            else:
                values = np.frombuffer(body, dtype=f"<i{width}") / float((1 << (bits - 1)) - 1)
            return values, rate, channels, "data cut short" if whole < size else None
        at += 8 + size + (size & 1)
    return None, None if form is None else form[2], None if form is None else form[1], "no data"


def wav_decoded(files: DataFrame, content: str = "content") -> DataFrame:
    """`files` with `WAV`'s columns in place of `content`; a file that is none has null samples and a
    problem. Works on tables and streams, a file at a time."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = files.drop(content)
    blank = files.sparkSession.createDataFrame([], WAV).schema
    schema = type(blank)([*kept.schema.fields, *blank.fields])
    arrow, names = to_arrow_schema(schema), kept.columns

    def decode(batches):
        for batch in batches:
            for at in range(batch.num_rows):  # samples take four times the file
                one = batch.slice(at, 1)
                found = wav_samples(one.column(content)[0].as_py())
                columns = [one.column(n).cast(t) for n, t in zip(names, arrow.types, strict=False)]
                columns += [pa.array([x], t) for x, t in zip(found, arrow.types[len(names) :], strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return files.mapInArrow(decode, schema)


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, samples, rate, channels, problem) of the files in a folder, wherever
    Spark reads: one row a file (none of an empty one), files dealt out by size."""
    return wav_decoded(spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path))


def wav_stream(spark: SparkSession, path: str, files_each: int = 100) -> DataFrame:
    """As `read_wav`, of the files that come into a folder; what was read is kept by the stream's checkpoint."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.wav").option("maxFilesPerTrigger", files_each)
    return wav_decoded(reader.load(path))
