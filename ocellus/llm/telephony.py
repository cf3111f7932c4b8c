"""Operator 3: media columns of telephony audio.

A payload column holds G.711 mu-law or A-law bytes, or IMA ADPCM blocks; the result holds 16-bit little-endian mono
PCM at one target rate. Companded bytes are expanded by 256-entry lookup tables. ADPCM is decoded across blocks: all
blocks of a batch advance one nibble at a time as one numpy vector, so the loop is as long as a block, not as the audio.
Resampling is a polyphase windowed-sinc filter over the clips of a batch laid end to end with silence between them.

Memory is bounded whatever the rates and lengths are: payloads are decoded SLICE_BYTES at a time, filters run over SPAN
samples at a time, and rates whose ratio to the target has no small terms make their taps as they go.
"""

from __future__ import annotations

from math import gcd

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import columns, fresh, prepare

TARGET_RATE = 16_000
BLOCK = 256
ZEROS = 16
MAX_RATE = 384_000
SLICE_BYTES = 2 << 20
SPAN = 1 << 20
#: Up to this term of the ratio of rates, taps are a table and clips share a line.
_TERM = 2048

_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int64)
#: The step sizes of IMA ADPCM: each is about 1.1 times the one before.
_STEP = np.array(
    "7 8 9 10 11 12 13 14 16 17 19 21 23 25 28 31 34 37 41 45 50 55 60 66 73 80 88 97 107 118 130 143 157 173 190 209 230 253 279 307 337 371 408 449 494 544 598 658 724 796 876 963 1060 1166 1282 1411 "
    "1552 1707 1878 2066 2272 2499 2749 3024 3327 3660 4026 4428 4871 5358 5894 6484 7132 7845 8630 9493 10442 11487 12635 13899 15289 16818 18500 20350 22385 24623 27086 29794 32767".split(),
    np.int64,
)


def _mulaw_table() -> np.ndarray:
    u = ~np.arange(256) & 0xFF
    size = ((((u & 15) << 3) + 132) << ((u >> 4) & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    power, part = (a >> 4) & 7, (a & 15) << 4
    size = np.where(power == 0, part + 8, (part + 264) << np.maximum(power - 1, 0))
    return np.where(a & 128, size, -size).astype(np.int16)


TABLES = {"mulaw": _mulaw_table(), "alaw": _alaw_table()}


def adpcm_decode(payloads: list[bytes], block: int) -> list[np.ndarray]:
    """Samples of IMA ADPCM payloads; the last block of one may be short, and bytes too few for a header are dropped."""
    blocks, owner = [], []
    for k, p in enumerate(payloads):
        for a in range(0, len(p), block):
            if len(p) - a >= 4:
                blocks.append(p[a : a + block])
                owner.append(k)
    if not blocks:
        return [np.zeros(0, np.int16) for _ in payloads]
    length = np.array([len(b) for b in blocks])
    data = np.zeros((len(blocks), length.max()), np.uint8)
    for k, b in enumerate(blocks):
        data[k, : len(b)] = np.frombuffer(b, np.uint8)
    value = data[:, :2].copy().view("<i2")[:, 0].astype(np.int64)
    index = np.minimum(data[:, 2].astype(np.int64), 88)
    steps = (data.shape[1] - 4) * 2
    out = np.empty((len(blocks), steps + 1), np.int16)
    out[:, 0] = value
    for k in range(steps):
        nibble = (data[:, 4 + k // 2] >> (4 * (k % 2))) & 15
        step = _STEP[index]
        change = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
        value = np.clip(value + np.where(nibble & 8, -change, change), -32768, 32767)
        index = np.clip(index + _INDEX[nibble], 0, 88)
        out[:, k + 1] = value
    samples = (length - 4) * 2 + 1
    parts: list[list[np.ndarray]] = [[] for _ in payloads]
    for k, o in enumerate(owner):
        parts[o].append(out[k, : samples[k]])
    return [np.concatenate(p) if p else np.zeros(0, np.int16) for p in parts]


def _ratio(rate: int, target: int) -> tuple[int, int]:
    return target // gcd(rate, target), rate // gcd(rate, target)


def _taps(ticks: np.ndarray, up: int, down: int) -> np.ndarray:
    """The filter at places in units of 1 / (rate * up), 0 beyond ZEROS crossings."""
    wide = max(up, down)
    t = ticks / wide
    window = np.i0(8.0 * np.sqrt(np.maximum(0.0, 1 - (t / ZEROS) ** 2))) / np.i0(8.0)
    return np.where(np.abs(t) <= ZEROS, np.sinc(t) * window * (up / wide), 0.0)


def _filtered(x: np.ndarray, count: int, up: int, down: int, reach: int, table: np.ndarray | None) -> np.ndarray:
    """The first `count` outputs of a line x that has `reach` samples of silence in front and behind."""
    half = ZEROS * max(up, down)
    y = np.zeros(count)
    if table is None:
        step = max(1, (1 << 18) // (2 * reach + 1))
        k = np.arange(-reach, reach + 1)
        for a in range(0, count, step):
            at = np.arange(a, min(count, a + step)) * down
            near, phase = at // up, at % up
            y[a : a + step] = (_taps(k[None, :] * up - phase[:, None], up, down) * x[near[:, None] + k[None, :] + reach]).sum(axis=1)
        return y
    for one in range(min(up, count)):  # outputs one, one + up, ... share one phase; their inputs are `down` apart
        near, phase = one * down // up, one * down % up
        many = -(-(count - one) // up)
        own = np.zeros(many)
        for k in range(-reach, reach + 1):  # sample near + k stands (k * up - phase) ticks away
            tick = half + phase - k * up
            if 0 <= tick <= 2 * half:
                begin = near + k + reach
                own += table[tick] * x[begin : begin + (many - 1) * down + 1 : down]
        y[one::up] = own
    return y


def resample(clips: list[np.ndarray], rate: int, target: int) -> list[np.ndarray]:
    """The clips at the target rate: ceil(n * target / rate) samples each, filtered against aliases."""
    if rate == target:
        return clips
    up, down = _ratio(rate, target)
    half = ZEROS * max(up, down)
    reach = half // up + 1
    table = _taps(np.arange(-half, half + 1), up, down) if max(up, down) <= _TERM else None
    span = max(1, SPAN // max(up, down)) * up  # outputs at a time: whole rounds of phases
    out = []
    for clip in clips:
        n = -(-len(clip) * up // down)
        got = np.empty(n, np.int16)
        for a in range(0, n, span):
            count = min(span, n - a)
            low = a * down // up - reach  # the samples that these outputs see
            high = (a + count - 1) * down // up + reach + 1
            x = np.zeros(high - low)
            x[max(0, -low) : max(0, min(len(clip), high) - low)] = clip[max(0, low) : min(len(clip), high)]
            y = _filtered(x, count, up, down, reach, table)
            got[a : a + count] = np.clip(np.rint(y), -32768, 32767)
        out.append(got)
    return out


def _resample_all(clips: list[np.ndarray], rate: int, target: int) -> list[np.ndarray]:
    """resample() over many clips at once: laid end to end on a grid where each begins on an output sample, a line of about SPAN at a time."""
    if rate == target or not clips:
        return clips
    up, down = _ratio(rate, target)
    if max(up, down) > _TERM:
        return resample(clips, rate, target)
    gap = 2 * (ZEROS * max(up, down) // up + 2)
    out: list[np.ndarray] = []
    a = 0
    while a < len(clips):
        begin, z = [0], a
        while z < len(clips) and (z == a or begin[-1] < SPAN):
            begin.append(begin[-1] + -(-(len(clips[z]) + gap) // down) * down)
            z += 1
        line = np.zeros(begin[-1], np.int16)
        for c, b in zip(clips[a:z], begin):
            line[b : b + len(c)] = c
        long = resample([line], rate, target)[0]
        out += [long[b * up // down : b * up // down + -(-len(c) * up // down)] for c, b in zip(clips[a:z], begin)]
        a = z
    return out


def decode(payloads: list[bytes | None], codecs: list[str | None], rates: list[int | None], blocks: list[int | None], target: int = TARGET_RATE) -> tuple[list[np.ndarray | None], list[str | None]]:
    """(samples, error) of each clip; one of the two is None."""
    clips: list[np.ndarray | None] = [None] * len(payloads)
    errors: list[str | None] = [None] * len(payloads)
    adpcm: dict[int, list[int]] = {}
    for k, (p, codec, rate, block) in enumerate(zip(payloads, codecs, rates, blocks)):
        if p is None:
            errors[k] = "no payload"
        elif codec not in ("mulaw", "alaw", "adpcm"):
            errors[k] = "unknown codec"
        elif rate is None or not 0 < rate <= MAX_RATE:
            errors[k] = "bad rate"
        elif codec == "adpcm":
            if block is None or block < 5:
                errors[k] = "bad block size"
            else:
                adpcm.setdefault(block, []).append(k)
        else:
            clips[k] = TABLES[codec][np.frombuffer(p, np.uint8)]
    for block, rows in adpcm.items():
        for k, clip in zip(rows, adpcm_decode([payloads[k] for k in rows], block)):
            clips[k] = clip
    for rate in {r for r, c in zip(rates, clips) if c is not None}:
        rows = [k for k, c in enumerate(clips) if c is not None and rates[k] == rate]
        for k, clip in zip(rows, _resample_all([clips[k] for k in rows], rate, target)):
            clips[k] = clip
    return clips, errors


def decode_media(df: DataFrame, payload: str, codec: str, rate: str, block: str, target: int = TARGET_RATE) -> DataFrame:
    """df with its columns and four more: sample_rate, n_samples, pcm (binary, 16-bit little-endian) and error.

    payload, codec ("mulaw", "alaw" or "adpcm"), rate (of the payload, in Hz) and block (bytes of an ADPCM block) name
    columns. Defined cases: a null payload, an unknown or null codec, a rate that is null or out of range and an ADPCM
    block size that is null or under 5 bytes give a null pcm and a reason in error; an empty payload gives no samples; an
    ADPCM step index over 88 counts as 88, and bytes too few for a block header are dropped; repeated rows are decoded
    each; an empty table gives no rows. A column of df that has one of the four names is replaced.
    """
    prepare(df.sparkSession)
    kind = pa.struct([("n_samples", pa.int64()), ("pcm", pa.binary()), ("error", pa.string())])

    @F.arrow_udf("struct<n_samples:bigint,pcm:binary,error:string>")
    def run(p: pa.Array, c: pa.Array, r: pa.Array, b: pa.Array) -> pa.Array:
        size = pa.compute.fill_null(pa.compute.binary_length(p), 0).to_numpy(zero_copy_only=False)
        upto = np.concatenate([[0], np.cumsum(size)])
        parts = []
        for i, j in K.slices(upto, SLICE_BYTES):
            clips, errors = decode(*(x.slice(i, j - i).to_pylist() for x in (p, c, r, b)), target)
            parts.append(
                pa.StructArray.from_arrays(
                    [
                        pa.array([None if x is None else len(x) for x in clips], pa.int64()),
                        pa.array([None if x is None else x.astype("<i2").tobytes() for x in clips], pa.binary()),
                        pa.array(errors, pa.string()),
                    ],
                    ["n_samples", "pcm", "error"],
                )
            )
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    (got,) = fresh(df, "decoded")
    out = df.withColumn(got, run(F.col(payload).cast("binary"), F.col(codec).cast("string"), F.col(rate).cast("int"), F.col(block).cast("int")))
    new = {"sample_rate": F.when(F.col(f"{got}.error").isNull(), F.lit(target)), "n_samples": F.col(f"{got}.n_samples"), "pcm": F.col(f"{got}.pcm"), "error": F.col(f"{got}.error")}
    return out.select(*(own for c, own in zip(df.columns, columns(df)) if c.lower() not in new), *(v.alias(k) for k, v in new.items()))


def call_audio(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, codec, rate, block, payload): each turn of a conversation as a telephone clip at 8 kHz.

    The tables hold no audio. A turn's UTF-8 bytes are taken as the line's bytes: as they are for mu-law and A-law, and
    as the nibbles of ADPCM blocks, behind headers made for them. The turn's number says which of the three.
    """

    @F.arrow_udf("binary")
    def blocks(text: pa.Array) -> pa.Array:
        head = b"\x00\x00\x10\x00"
        return pa.array([None if t is None else b"".join(head + t[a : a + BLOCK - 4] for a in range(0, len(t), BLOCK - 4)) for t in text.to_pylist()], pa.binary())

    raw: Column = F.col("text").cast("binary")
    kind = F.pmod(F.coalesce("turn", F.lit(0)), F.lit(3))
    codec = F.when(kind == 0, "mulaw").when(kind == 1, "alaw").otherwise("adpcm")
    out = conversations.select("conv_id", "turn", "role", codec.alias("codec"), F.lit(8000).alias("rate"), F.lit(BLOCK).alias("block"), raw.alias("raw"))
    return out.select("conv_id", "turn", "role", "codec", "rate", "block", F.when(F.col("codec") == "adpcm", blocks("raw")).otherwise(F.col("raw")).alias("payload"))


def telephony(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, codec, sample_rate, n_samples, pcm, error) of every turn, at TARGET_RATE."""
    return decode_media(call_audio(conversations), "payload", "codec", "rate", "block").drop("payload", "rate", "block")
