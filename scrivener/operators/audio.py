"""Audio over arrays of samples, mono 16 kHz unless said otherwise. Sums are doubles; null arrays
give null, empty ones what each function says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.functions.text import let

RATE = 16_000
BARS, BAR_WINDOW, BAR_SCALE = 48, 8_000, 12.0
LEVEL_WINDOW, LEVEL_SCALE = 1_600, 5.0
SILENT_RMS, AUDIBLE = 0.0001, 0.001
SHOWN_BARS, QUIET_BAR = 16, 0.06
#: Samples that leave a task together.
CLIP_SAMPLES = 1_000_000


def from_int16(samples: Column) -> Column:
    return F.transform(samples, lambda s: s / F.lit(32767.0))


def from_uint16(samples: Column) -> Column:
    return F.transform(samples, lambda s: s / F.lit(65535.0) * 2 - 1)


def to_int16(samples: Column) -> Column:
    """Scaled, clamped, cut to whole numbers."""
    return F.transform(samples, lambda s: F.least(F.greatest(s * 32767, F.lit(-32768.0)), F.lit(32767.0)).cast("int"))


def total(samples: Column, of=lambda s: s) -> Column:
    return F.aggregate(samples, F.lit(0.0), lambda a, s: a + of(s.cast("double")))


def downmixed(interleaved: Column, channels: int) -> Column:
    """Mean of every frame; a short last frame still divides by all channels."""
    starts = F.when(F.size(interleaved) > 0, F.sequence(F.lit(1), F.size(interleaved), F.lit(channels))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: total(F.slice(interleaved, i, F.lit(channels))) / channels)


def rms(samples: Column) -> Column:
    """Root mean square; 0 of nothing."""
    return F.when(F.size(samples) > 0, F.sqrt(total(samples, lambda s: s * s) / F.size(samples))).otherwise(F.when(samples.isNotNull(), 0.0))


def peak(samples: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(samples, lambda s: F.abs(s.cast("double")))), F.when(samples.isNotNull(), 0.0))


def audible(samples: Column) -> Column:
    """Number of samples that are not next to zero."""
    return F.size(F.filter(samples, lambda s: F.abs(s.cast("double")) > AUDIBLE))


def last(samples: Column, n: int) -> Column:
    return F.slice(samples, F.greatest(F.size(samples) - n + 1, F.lit(1)), F.lit(n))


def levels(df: DataFrame, samples: str = "samples") -> DataFrame:
    """`df` with rms, peak, nonzero and nonzero_pct."""
    c = F.col(samples)
    return df.withColumns({"rms": rms(c), "peak": peak(c), "nonzero": audible(c), "nonzero_pct": F.when(F.size(c) > 0, audible(c) / F.size(c) * 100)})


def input_level(samples: Column) -> Column:
    """Loudness of the last tenth of a second, 0 to 1."""
    return F.least(rms(last(samples, LEVEL_WINDOW)) * LEVEL_SCALE, F.lit(1.0))


def amplitude_bars(samples: Column, bars: int = BARS) -> Column:
    """Loudness of `bars` equal slices of the last half second, 0 to 1; zeros past its end."""

    def of(tail: Column) -> Column:
        each = F.greatest(F.floor(F.size(tail) / bars).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), F.lit(bars - 1)), lambda i: F.when(i * each < F.size(tail), F.least(rms(F.slice(tail, i * each + 1, each)) * BAR_SCALE, F.lit(1.0))).otherwise(0.0))

    return let(last(samples, BAR_WINDOW), of)


def mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, total(values) / F.size(values)).otherwise(0.0)


def shown_bars(bars: Column, shown: int = SHOWN_BARS) -> Column:
    """`bars` thinned to `shown` by nearest place; what is missing is quiet."""
    n = F.when(F.size(bars) > 0, F.size(bars)).otherwise(BARS)
    return F.transform(F.sequence(F.lit(0), F.lit(shown - 1)), lambda i: F.coalesce(F.get(bars, F.floor(i / shown * n + 0.5).cast("int")).cast("double"), F.lit(QUIET_BAR)))


def bar_heights(shown: Column) -> Column:
    return F.transform(shown, lambda a: F.greatest(F.lit(3.0), F.sqrt(a) * 24))


def chunk_starts(n: Column, chunk: int, overlap: int) -> Column:
    """0-based starts of chunks of `chunk` samples that overlap by `overlap` and cover all of `n`."""
    step = chunk - overlap
    over = F.ceil(F.greatest(n - chunk, F.lit(0)) / step).cast("int")
    return F.transform(F.sequence(F.lit(0), over), lambda k: k * step)


def chunked(df: DataFrame, samples: str = "samples", seconds: float = 30, overlap: float = 1, rate: int = RATE) -> DataFrame:
    """A row a chunk: `chunk_no`, `start` and its `samples`; the last may be short."""
    chunk, lap = int(seconds * rate), int(overlap * rate)
    out = df.select("*", F.posexplode(chunk_starts(F.size(samples), chunk, lap)).alias("chunk_no", "start"))
    return out.withColumn(samples, F.slice(samples, F.col("start") + 1, F.lit(chunk)))


def resampling(n: Column, rate: Column, to: int = RATE) -> Column:
    """What a block resampler does with `n` samples at `rate`: whole blocks of 10 ms, the samples
    carried over, and those it flushes of them at the end, in proportion, as struct."""
    block = F.floor(rate / 100).cast("int")
    carry = n % block
    flushed = F.when(carry > 0, F.floor(carry / block * (to // 100) + 0.5).cast("int")).otherwise(0)
    blocks = F.floor(n / block).cast("int")
    return F.struct(blocks.alias("blocks"), carry.cast("int").alias("carry"), (blocks * (to // 100) + flushed).cast("int").alias("samples"))


def low_pass(block: int, to: int):
    """Spectrum, over twice a block, of the filter that leaves what a block of `to` samples can hold: a
    windowed sinc as long as a block."""
    import numpy as np

    edge = 0.9 * min(1.0, to / block)
    at = np.arange(block) - (block - 1) / 2
    taps = np.sinc(at * edge) * np.blackman(block)
    return np.fft.rfft(taps / taps.sum(), 2 * block)


def resampled(clips: DataFrame, rate: int, id_col: str = "clip_id", samples: str = "samples", to: int = RATE) -> DataFrame:
    """(id, samples): clips at `rate` brought to `to` samples a second, block by block of 10 ms: each block's
    spectrum is filtered and cut (or filled) to the new length, and neighbours overlap and add. Output runs half a
    block late, as the filter does; the last, short block gives its share of samples, as `resampling`
    counts them. A clip that has the rate stays as it is; null stays null, empty empty."""
    kind = clips.schema[id_col].dataType.simpleString()
    block, part = rate // 100, to // 100

    def run(batches):
        import numpy as np
        import pyarrow as pa

        spectrum = low_pass(block, part)
        kept = min(block, part) + 1

        def one(x):
            if rate == to or not len(x):
                return x
            n, carry = divmod(len(x), block)
            frames = np.zeros((n + (carry > 0), block))
            frames.reshape(-1)[: len(x)] = x
            cut = np.zeros((len(frames), part + 1), dtype=complex)
            cut[:, :kept] = (np.fft.rfft(frames, 2 * block) * spectrum)[:, :kept]
            parts = np.fft.irfft(cut, 2 * part) * (part / block)
            out = parts[:, :part].copy()
            out[1:] += parts[:-1, part:]
            flushed = int(np.floor(carry / block * part + 0.5)) if carry else 0
            return out.reshape(-1)[: n * part + flushed]

        def packed(batch, start, values):
            return pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(values)), pa.array(values, pa.list_(pa.float64()))], names=[id_col, samples])

        for batch in batches:
            # clips leave whole, some `CLIP_SAMPLES` together; none is ever a list of Python numbers
            start, values, held = 0, [], 0
            for x in batch.column(1):
                values.append(one(x.values.to_numpy(zero_copy_only=False).astype(float)) if x.is_valid else None)
                held += len(values[-1]) if x.is_valid else 0
                if held >= CLIP_SAMPLES:
                    yield packed(batch, start, values)
                    start, values, held = start + len(values), [], 0
            if values:
                yield packed(batch, start, values)

    return clips.select(id_col, F.col(samples).cast("array<double>")).mapInArrow(run, f"`{id_col}` {kind}, `{samples}` array<double>")


def durations(n: Column) -> dict[str, Column]:
    """seconds, whole milliseconds and whether a clip is too short."""
    return {"seconds": n / RATE, "speech_ms": F.floor(n / RATE * 1000).cast("long"), "too_short": n < RATE}


def clock_mismatch(n: Column, wall_seconds: Column) -> Column:
    """Whether a clip is much longer or shorter than the recording took; null without a clock."""
    ratio = n / RATE / wall_seconds
    return (ratio > 1.5) | (ratio < 0.5)


def disconnected(loudness: Column, had_error: Column) -> Column:
    return (loudness < SILENT_RMS) & had_error
