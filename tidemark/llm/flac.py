"""FLAC columns: lossless 8-bit mono streams, written and read back in tasks.

``encode`` stores a binary column as FLAC (fixed predictors of order 0 to 4,
Rice-coded residuals, CRC-8 and CRC-16 in every frame, a seek table).  ``decode``
checks the frame checksums and the MD5 of the samples, decodes Rice residuals
and linear predictors (constant, verbatim, fixed and LPC subframes, partitioned
Rice codes with escapes), and gives PCM with seekable sample offsets.
``pcm_blocks`` turns these into one row per block.

A Rice code can only be read in sequence, but frames are independent of each
other, so the decoder advances through all frames of a batch in step: each numpy
operation reads the next code of every frame.

Defined cases: a null or empty payload is stored as the stream of no samples by
``encode`` and read back as empty; a damaged or foreign stream gives ``ok`` =
false with a null payload and never fails the job; equal bytes give equal
streams; other columns are kept as they are (a clash with the output columns
raises a ValueError on the driver, before anything runs).
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Samples in a block; the last block of a stream may be shorter.
BLOCK = 2304
RATE = 8000
#: Bytes of streams that are coded together.
BATCH_BYTES = 3_000_000
#: Every so many blocks the seek table has a point.
SEEK_EVERY = 8
_MAX_RICE = 14


def _crc_table(poly: int, width: int) -> np.ndarray:
    top, mask, out = 1 << (width - 1), (1 << width) - 1, []
    for b in range(256):
        c = b << (width - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.uint16)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_SHIFTED16 = [_CRC16]


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(_CRC8[c ^ b])
    return c


def _shifted16(n: int) -> np.ndarray:
    """Row j: the CRC-16 of each byte with j zero bytes behind it."""
    global _SHIFTED16
    if len(_SHIFTED16) < n:
        rows = [*_SHIFTED16]
        while len(rows) < n:
            last = rows[-1]
            rows.append((last << 8).astype(np.uint16) ^ _CRC16[last >> 8])
        _SHIFTED16 = np.array(rows)
    return np.asarray(_SHIFTED16)


def crc16_many(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of many byte runs at once: the code is linear, so each byte adds its own share."""
    if not len(starts):
        return np.empty(0, np.uint16)
    table = _shifted16(int(lengths.max()))
    first = np.cumsum(lengths) - lengths
    within = np.arange(lengths.sum()) - np.repeat(first, lengths)
    at = within + np.repeat(starts, lengths)
    share = table[np.repeat(lengths, lengths) - 1 - within, data[at]]
    return np.bitwise_xor.reduceat(share, first)


def _number(n: int) -> bytes:
    """A frame number in FLAC's UTF-8 like form."""
    if n < 0x80:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    tail = [0x80 | n >> 6 * i & 0x3F for i in range(size - 2, -1, -1)]
    return bytes([(0xFF << (8 - size)) & 0xFF | n >> 6 * (size - 1), *tail])


def _read_number(data: bytes, at: int) -> tuple[int, int]:
    b = data[at]
    if b < 0x80:
        return b, at + 1
    size = 8 - (b ^ 0xFF).bit_length()
    if not 2 <= size <= 7 or at + size > len(data):
        raise ValueError("frame number")
    n = b & ((1 << (7 - size)) - 1)
    for c in data[at + 1 : at + size]:
        if c >> 6 != 2:
            raise ValueError("frame number")
        n = n << 6 | c & 0x3F
    return n, at + size


def _frame_body(x: np.ndarray) -> np.ndarray:
    """The subframe of one block as bits, by the cheapest of the fixed predictors."""
    if (x == x[0]).all():
        return np.unpackbits(np.array([0, x[0] & 0xFF], np.uint8))
    best = None
    for order in range(min(5, len(x))):
        z = np.diff(x, n=order)
        z = np.where(z < 0, -2 * z - 1, 2 * z)
        total = int(z.sum())
        k = min(_MAX_RICE, max(0, int(total * 0.6931 / max(1, len(z))).bit_length() - 1)) if len(z) else 0
        for k in {k, min(k + 1, _MAX_RICE)}:
            bits = int((z >> k).sum()) + len(z) * (k + 1) + 8 * order
            if best is None or bits < best[0]:
                best = bits, order, k, z
    bits, order, k, z = best
    if bits + 18 >= 8 * len(x):
        return np.unpackbits(np.concatenate([np.array([2], np.uint8), (x & 0xFF).astype(np.uint8)]))
    head = np.concatenate([np.array([(8 + order) << 1], np.uint8), (x[:order] & 0xFF).astype(np.uint8)])
    q = z >> k
    ends = np.cumsum(q + 1 + k)
    head_bits = np.unpackbits(head)
    out = np.zeros(len(head_bits) + 10 + int(ends[-1]) if len(z) else len(head_bits) + 10, np.uint8)
    out[: len(head_bits)] = head_bits
    body = out[len(head_bits) :]
    body[6:10] = [k >> 3 & 1, k >> 2 & 1, k >> 1 & 1, k & 1]
    if len(z):
        stop = ends + 9 - k
        body[stop] = 1
        for j in range(k):
            body[stop + 1 + j] = z >> (k - 1 - j) & 1
    return out


def encode_streams(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload (unsigned 8-bit samples, mono)."""
    headers, bodies, owner, sizes = [], [], [], []
    for d, payload in enumerate(payloads):
        x = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
        for i, start in enumerate(range(0, len(x), BLOCK)):
            block = x[start : start + BLOCK]
            head = b"\xff\xf8\x70\x02" + _number(i) + struct.pack(">H", len(block) - 1)
            headers.append(head + bytes([crc8(head)]))
            bodies.append(np.packbits(_frame_body(block)).tobytes())
            owner.append(d)
            sizes.append(len(block))
    frames = [h + b for h, b in zip(headers, bodies, strict=True)]
    lengths = np.array([len(f) for f in frames], np.int64)
    joined = np.frombuffer(b"".join(frames), np.uint8)
    crcs = crc16_many(joined, np.cumsum(lengths) - lengths, lengths)
    per: list[list[bytes]] = [[] for _ in payloads]
    for d, frame, crc in zip(owner, frames, crcs.tolist(), strict=True):
        per[d].append(frame + struct.pack(">H", crc))
    return [_stream(p, f) for p, f in zip(payloads, per, strict=True)]


def _stream(payload: bytes, frames: list[bytes]) -> bytes:
    sizes = [len(f) for f in frames] or [0]
    signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
    info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (RATE << 44 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(signed, usedforsecurity=False).digest()
    points, at = b"", 0
    for i, size in enumerate(sizes if frames else []):
        if i % SEEK_EVERY == 0:
            points += struct.pack(">QQH", i * BLOCK, at, min(BLOCK, len(payload) - i * BLOCK))
        at += size
    head = b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info
    return head + b"\x83" + len(points).to_bytes(3, "big") + points + b"".join(frames)


_SIZE_CODES = {1: 192, **{k: 576 << (k - 2) for k in range(2, 6)}, **{k: 256 << (k - 8) for k in range(8, 16)}}


def _frames(data: bytes, at: int, total: int) -> list[tuple[int, int, int]]:
    """(start, start of the subframe, samples) of each frame: a sync code, the
    expected number and a right CRC-8 mark a frame, its CRC-16 is checked later."""
    found, need, want = [], 0, total
    while want > 0:
        at = data.find(b"\xff\xf8", at)
        if at < 0:
            raise ValueError("frames are missing")
        try:
            code, rate = data[at + 2] >> 4, data[at + 2] & 15
            n, p = _read_number(data, at + 4)
            size = _SIZE_CODES.get(code, 0)
            if code in (6, 7):
                size = int.from_bytes(data[p : p + code - 5], "big") + 1
                p += code - 5
            p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
            good = n == need and size and data[at + 3] in (0x00, 0x02) and crc8(data[at:p]) == data[p]
        except (IndexError, ValueError):
            good = False
        if good:
            found.append((at, p + 1, min(size, want)))
            need, want, at = need + 1, want - size, p + 1
        else:
            at += 1
    return found


def _open(data: bytes) -> tuple[int, int, bytes]:
    """Where the frames start, the number of samples, and their MD5."""
    if data[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, total, md5 = 4, False, None, b""
    while not last:
        last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        if kind == 0:
            packed = int.from_bytes(data[at + 14 : at + 22], "big")
            if packed >> 41 & 7 or (packed >> 36 & 31) != 7:
                raise ValueError("only 8-bit mono is read")
            total, md5 = packed & (1 << 36) - 1, data[at + 22 : at + 38]
        at += 4 + size
    if total is None:
        raise ValueError("STREAMINFO is missing")
    return at, total, md5


class _Bits:
    """64-bit windows at every byte of a buffer, so that each frame reads at its own place."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint64)
        n = len(padded) - 8
        self.window = np.zeros(n, np.uint64)
        for i in range(8):
            self.window |= padded[i : i + n] << np.uint64(56 - 8 * i)
        self.last = n - 1

    def peek(self, at: np.ndarray) -> np.ndarray:
        """At least 57 bits from ``at``, at the top of each word."""
        return self.window[np.minimum(at >> 3, self.last)] << (at & 7).astype(np.uint64)

    def read(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        n = np.broadcast_to(np.asarray(n, np.int64), at.shape)
        word = self.peek(at) >> (64 - np.maximum(n, 1)).astype(np.uint64)
        return np.where(n > 0, word, 0).astype(np.int64)

    def signed(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        v, n = self.read(at, n), np.asarray(n, np.int64)
        return np.where(n > 0, v - ((v >> np.maximum(n - 1, 0) & 1) << n), 0)


def _long_runs(bits: _Bits, p: np.ndarray, q: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of zero runs of any length, and where the bits after their ends start."""
    q, far = np.where(top == 0, 0, q), np.flatnonzero(top == 0)
    while far.size:
        q[far] += 32
        if ((p[far] + q[far]) >> 3 > bits.last).any():
            raise ValueError("a code runs out of the stream")
        top = (bits.peek(p[far] + q[far]) >> np.uint64(32)).astype(np.float64)
        q[far] += np.where(top == 0, 0, 32 - np.frexp(top)[1].astype(np.int64))
        far = far[top == 0]
    return q, p + q + 1


def _rice(bits: _Bits, at: np.ndarray, counts: np.ndarray, k: np.ndarray, raw: np.ndarray, out: np.ndarray, rows: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Read ``counts`` codes of each frame in step; ``raw`` >= 0 marks escaped partitions."""
    order = np.argsort(-counts, kind="stable")
    at, counts, k, raw, rows, to = at[order], counts[order], k[order], raw[order], rows[order], to[order]
    escaped = bool((raw >= 0).any())
    k64, flat, base = k.astype(np.uint64), out.reshape(-1), rows * out.shape[1] + to
    active = np.searchsorted(-counts, -np.arange(int(counts.max(initial=0))), side="left")
    for i, n in enumerate(active.tolist()):
        p, kk = at[:n].copy(), k[:n]
        word = bits.peek(p)
        top = (word >> np.uint64(32)).astype(np.float64)
        q = 32 - np.frexp(top)[1].astype(np.int64)
        if (top == 0).any():
            q, rest = _long_runs(bits, p, q, top)
            low = bits.read(rest, kk)
        else:
            rest = p + q + 1
            low = ((word << (q + 1).astype(np.uint64)) >> (np.uint64(63) - k64[:n]) >> np.uint64(1)).astype(np.int64)
        v = q << kk | low
        v = (v >> 1) ^ -(v & 1)
        at[:n] = rest + kk
        if escaped and (e := np.flatnonzero(raw[:n] >= 0)).size:
            v[e] = bits.signed(p[e], raw[e])
            at[e] = p[e] + raw[e]
        flat[base[:n] + i] = v
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return at[back]


def _decode_group(bits: _Bits, at: np.ndarray, sizes: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples (a row for each frame) and the bit where each subframe ends."""
    out = np.zeros((len(at), int(sizes.max())), np.int64)
    end = at.copy()
    for kind in np.unique(kinds).tolist():
        rows = np.flatnonzero(kinds == kind)
        p, n = at[rows] + 8, sizes[rows]
        if kind == 0:
            out[rows] = bits.signed(p, 8)[:, None]
            end[rows] = p + 8
            continue
        if kind == 1:
            for i in range(int(n.max())):
                live = n > i
                out[rows[live], i] = bits.signed(p[live] + 8 * i, 8)
            end[rows] = p + 8 * n
            continue
        if not (8 <= kind <= 12 or kind >= 32):
            raise ValueError("reserved subframe")
        order = kind - 8 if kind < 32 else kind - 31
        for i in range(order):
            out[rows, i] = bits.signed(p + 8 * i, 8)
        p = p + 8 * order
        coefs = shift = None
        if kind >= 32:
            precision = bits.read(p, 4) + 1
            shift = bits.signed(p + 4, 5)
            p = p + 9
            coefs = np.stack([bits.signed(p + precision * j, precision) for j in range(order)])
            p = p + precision * order
        method, parts = bits.read(p, 2), bits.read(p + 2, 4)
        if (method > 1).any():
            raise ValueError("reserved residual coding")
        width = 4 + method
        p = p + 6
        done = np.full(len(rows), order, np.int64)
        for part in range(int((1 << parts).max())):
            live = np.flatnonzero(part < 1 << parts)
            w = width[live]
            k = bits.read(p[live], w)
            escape = k == (1 << w) - 1
            raw = np.where(escape, bits.read(p[live] + w, 5), -1)
            start = p[live] + w + np.where(escape, 5, 0)
            count = (n[live] >> parts[live]) - (order if part == 0 else 0)
            p[live] = _rice(bits, start, count, np.where(escape, 0, k), raw, out, rows[live], done[live])
            done[live] += count
        end[rows] = p
        block = out[rows]
        if kind < 32:
            warm = block[:, :order].copy()
            for j in range(order - 1, -1, -1):  # undo one difference after the other
                block[:, j] = np.diff(warm[:, : j + 1], n=j, axis=1)[:, -1]
                block[:, j:] = np.cumsum(block[:, j:], axis=1)
        else:
            for i in range(order, block.shape[1]):
                guess = sum(coefs[j] * block[:, i - 1 - j] for j in range(order)) >> np.maximum(shift, 0)
                block[:, i] += np.where(i < n, guess, 0)
        out[rows] = block
    return out, end




class Decoded:
    """The samples of one stream, or why it can't be read."""

    def __init__(self, payload: bytes | None, frames: list[tuple[int, int, int]], error: str | None):
        self.payload, self.frames, self.error = payload, frames, error


def decode_streams(streams: list[bytes]) -> list[Decoded]:
    """Decode streams together; if one of them is broken, each by itself."""
    if not streams:
        return []
    try:
        return _decode_all(streams)
    except (ValueError, IndexError) as e:
        if len(streams) == 1:
            return [Decoded(None, [], str(e) or "broken stream")]
        return [decode_streams([s])[0] for s in streams]


def _decode_all(streams: list[bytes]) -> list[Decoded]:
    starts, subframes, sizes, owner, ends = [], [], [], [], []
    per, md5s, at = [], [], 0
    for d, data in enumerate(streams):
        first, total, md5 = _open(data)
        frames = _frames(data, first, total)
        per.append(frames)
        md5s.append(md5)
        for i, (a, b, n) in enumerate(frames):
            starts.append(at + a)
            subframes.append(at + b)
            sizes.append(n)
            owner.append(d)
            ends.append(at + (frames[i + 1][0] if i + 1 < len(frames) else len(data)))
        at += len(data)
    buffer = np.frombuffer(b"".join(streams), np.uint8)
    if starts:
        start, sub, size = (np.array(x, np.int64) for x in (starts, subframes, sizes))
        if (buffer[sub] & 0x81).any():
            raise ValueError("padding bit or wasted bits in a subframe")
        samples, bit = _decode_group(_Bits(buffer), sub * 8, size, (buffer[sub] >> 1).astype(np.int64))
        stop = (bit + 7) // 8
        if (stop + 2 > np.array(ends)).any():
            raise ValueError("a frame is cut off")
        crc = crc16_many(buffer, start, stop - start)
        if (crc != (buffer[stop].astype(np.uint16) << 8 | buffer[stop + 1])).any():
            raise ValueError("a frame's CRC-16 is wrong")
        flat = samples[np.arange(samples.shape[1]) < size[:, None]]
        flat = (flat + 128).astype(np.uint8)
        cuts = np.bincount(np.array(owner), size, len(streams)).astype(np.int64)
    else:
        flat, cuts = np.empty(0, np.uint8), np.zeros(len(streams), np.int64)
    out, at = [], 0
    for n, frames, md5 in zip(cuts.tolist(), per, md5s, strict=True):
        part = flat[at : at + n]
        at += n
        good = md5 == bytes(16) or hashlib.md5((part ^ 0x80).tobytes(), usedforsecurity=False).digest() == md5
        if not good:
            raise ValueError("the samples' MD5 is wrong")
        out.append(Decoded(part.tobytes(), frames, None))
    return out


def _chunks(values: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of values of about BATCH_BYTES together."""
    run, size = [], 0
    for v in values:
        run.append(v)
        size += len(v)
        if size >= BATCH_BYTES:
            yield run
            run, size = [], 0
    if run:
        yield run


def _check_free(df: DataFrame, names: list[str]) -> None:
    if clash := sorted({c.lower() for c in df.columns} & set(names)):
        raise ValueError(f"the input already has the columns {clash}")


def encode(df: DataFrame, payload: str = "payload", media: str = "media") -> DataFrame:
    """Replace the binary column ``payload`` by its FLAC stream ``media``."""
    if payload != media:
        _check_free(df, [media])
    keep = [c for c in df.columns if c != payload]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(media, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [v or b"" for v in batch[payload].to_pylist()]
            streams = [s for run in _chunks(values) for s in encode_streams(run)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(streams, pa.binary())], names=schema.names)

    return df.mapInArrow(run, schema)


_BLOCKS = T.ArrayType(T.StructType([T.StructField("sample_offset", T.LongType()), T.StructField("n_samples", T.IntegerType()), T.StructField("byte_offset", T.LongType())]))


def decode(df: DataFrame, media: str = "media") -> DataFrame:
    """Add ``pcm`` (the samples), ``blocks`` (their seek points), ``ok`` and ``error``."""
    _check_free(df, ["pcm", "blocks", "ok", "error"])
    new = [T.StructField("pcm", T.BinaryType()), T.StructField("blocks", _BLOCKS), T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType())]
    schema = T.StructType([*df.schema.fields, *new])
    arrow = pa.list_(pa.struct([("sample_offset", pa.int64()), ("n_samples", pa.int32()), ("byte_offset", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [v or b"" for v in batch[media].to_pylist()]
            found = [d for run in _chunks(values) for d in decode_streams(run)]
            blocks = []
            for d in found:
                offsets = np.cumsum([0, *(n for _, _, n in d.frames)])
                blocks.append([{"sample_offset": int(o), "n_samples": n, "byte_offset": a} for o, (a, _, n) in zip(offsets, d.frames, strict=False)])
            columns = [
                pa.array([d.payload for d in found], pa.binary()),
                pa.array(blocks, arrow),
                pa.array([d.error is None for d in found]),
                pa.array([d.error for d in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return df.mapInArrow(run, schema)


def pcm_blocks(decoded: DataFrame, keys: list[str]) -> DataFrame:
    """One row per block: its number, first sample and PCM bytes."""
    blocks = decoded.select(*keys, "pcm", F.posexplode("blocks").alias("block", "at"))
    pcm = F.expr("substring(pcm, at.sample_offset + 1, at.n_samples)")
    return blocks.select(*keys, "block", "at.sample_offset", "at.n_samples", pcm.alias("pcm"))


#: Samples of a frame of the spectrum, and edges of its bands (bins of 1/192 of the sample rate).
FRAME = 192
BANDS = [1, 3, 6, 12, 24, 48, 72, 97]


def features_of(payloads: list[bytes]) -> list[str]:
    """Of each run of samples: energy, changes of sign, and the power of seven bands of its spectrum.

    ``energy`` is the mean square, ``crossings`` counts neighbours of different
    sign, ``bands`` are decibels of the mean power over frames of ``FRAME``
    samples (the last one filled with zeros); no samples give zeros.
    """
    sizes = np.array([len(p) for p in payloads], np.int64)
    frames = -(-sizes // FRAME)
    wave = np.zeros(int(frames.sum()) * FRAME, np.float32)
    first = (np.cumsum(frames) - frames) * FRAME
    flat = np.frombuffer(b"".join(payloads), np.uint8).astype(np.float32) - 128
    at = np.arange(len(flat)) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
    wave[at] = flat
    power = np.abs(np.fft.rfft(wave.reshape(-1, FRAME), axis=1)) ** 2
    bands = np.add.reduceat(power[:, : BANDS[-1]], BANDS[:-1], axis=1) / FRAME if len(power) else np.zeros((0, len(BANDS) - 1))
    owner = np.repeat(np.arange(len(payloads)), frames)
    mean = np.stack([np.bincount(owner, bands[:, j], len(payloads)) for j in range(bands.shape[1])], axis=1) / np.maximum(frames, 1)[:, None]
    text = np.repeat(np.arange(len(payloads)), sizes)
    energy = np.bincount(text, flat.astype(np.float64) ** 2, len(payloads)) / np.maximum(sizes, 1)
    turns = (flat[1:] < 0) != (flat[:-1] < 0)
    crossings = np.bincount(text[1:], turns & (text[1:] == text[:-1]), len(payloads)).astype(np.int64)
    decibels = np.rint(10 * np.log10(mean + 1)).astype(np.int64)
    return [f"energy={e:.3f};crossings={c};bands={','.join(map(str, b))}" for e, c, b in zip(energy.tolist(), crossings.tolist(), decibels.tolist(), strict=True)]


def with_features(decoded: DataFrame) -> DataFrame:
    """Add ``feature``, computed from the samples that were read back; null where a stream is broken."""
    _check_free(decoded, ["feature"])
    schema = T.StructType([*decoded.schema.fields, T.StructField("feature", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch["pcm"].to_pylist()
            found = [f for run in _chunks([v or b"" for v in values]) for f in features_of(run)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if v is None else f for v, f in zip(values, found, strict=True)], pa.string())], names=schema.names)

    return decoded.mapInArrow(run, schema)
