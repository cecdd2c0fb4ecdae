"""Media columns: lossless audio (FLAC) with Rice residuals, linear predictors and checked frames.

Every frame holds `BLOCK` samples of 8 bits, mono. The encoder tries fixed predictors of order 0 to 2 and a
quantised linear predictor of order 2 and keeps the cheapest; a seek point per frame gives its first sample and
its byte offset. Encoder and decoder work on all frames of a step at once, one sample of every frame at a time.

Edge cases: null or empty bytes are padded by the caller or give a stream without frames; a damaged header,
frame checksum or digest raises ValueError; equal bytes give equal streams.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebody.llm.common import ship, steps, utf8

#: Samples in a frame; the format has a code of its own for this size.
BLOCK = 192
#: Fixed values of the format: coefficients of the fixed predictors, polynomials of the two checksums, the sample rate.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]
CRC8_POLY, CRC16_POLY, RATE, RATE_CODE, SIZES = 0x07, 0x8005, 8000, 4, {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096, 13: 8192, 14: 16384, 15: 32768}


def _table(poly: int, width: int) -> np.ndarray:
    out = []
    for byte in range(256):
        c = byte << (width - 8)
        for _ in range(8):
            c = (c << 1) ^ (poly if c >> (width - 1) & 1 else 0)
        out.append(c & ((1 << width) - 1))
    return np.array(out, np.uint16)


_CRC8, _CRC16 = _table(CRC8_POLY, 8), _table(CRC16_POLY, 16)


def _crc(data: np.ndarray, start: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """Checksums of data[start:start+length] for all lanes; lanes are handled longest first."""
    order = np.argsort(-length, kind="stable")
    at, n = start[order].copy(), length[order]
    crc = np.zeros(len(at), np.uint16)
    live = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), side="left")
    for m in live:
        b = data[at[:m]]
        c = crc[:m]
        crc[:m] = _CRC8[c ^ b] if width == 8 else (c << np.uint16(8)) ^ _CRC16[(c >> np.uint16(8)) ^ b]
        at[:m] += 1
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the extended UTF-8 form: up to seven bytes a row, and how many are used."""
    size = 1 + sum((n >= x).astype(np.int64) for x in (1 << 7, 1 << 11, 1 << 16, 1 << 21, 1 << 26, 1 << 31))
    out = np.zeros((len(n), 7), np.uint8)
    for k in range(1, 8):
        rows = np.flatnonzero(size == k)
        v = n[rows]
        for j in range(k - 1, 0, -1):
            out[rows, j] = 0x80 | (v & 0x3F)
            v = v >> 6
        out[rows, 0] = v if k == 1 else ((0xFF << (8 - k)) & 0xFF) | v
    return out, size


def _residuals(x: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each predictor: order, residuals (first `order` columns zero), coefficients a frame, shift a frame."""
    n, out = len(x), []
    for order in (0, 1, 2):
        r = x.copy()
        for _ in range(order):
            r[:, 1:] = r[:, 1:] - r[:, :-1]
            r[:, 0] = 0
        r[:, :order] = 0
        out.append((order, r, np.tile(np.array(FIXED[order] + [0] * (2 - order), np.int32), (n, 1)), np.zeros(n, np.int32)))
    f = x.astype(np.float32)
    a0, a1, a2 = (np.einsum("ij,ij->i", f[:, : BLOCK - lag], f[:, lag:]).astype(np.float64) for lag in range(3))
    det = a0 * a0 - a1 * a1
    safe = np.where(det <= 0, 1, det)
    c = np.stack([np.where(det <= 0, 0, a1 * (a0 - a2) / safe), np.where(det <= 0, 0, (a0 * a2 - a1 * a1) / safe)], axis=1)
    q = np.clip(np.round(c * 16), -64, 63).astype(np.int32)  # 7 bits each, scaled by 2**4
    r = x.copy()
    r[:, 2:] -= (x[:, 1:-1] * q[:, :1] + x[:, :-2] * q[:, 1:]) >> 4
    r[:, :2] = 0
    out.append((-2, r, q, np.full(n, 4, np.int32)))
    return out


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload; its length must be a multiple of BLOCK."""
    counts = np.array([len(p) // BLOCK for p in payloads], np.int64)
    if any(len(p) % BLOCK for p in payloads):
        raise ValueError(f"payloads must be multiples of {BLOCK} bytes")
    data = np.frombuffer(b"".join(payloads), np.uint8)
    x = (data.astype(np.int32) - 128).reshape(-1, BLOCK)
    n = len(x)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    number = np.arange(n) - np.repeat(firsts[:-1], counts)
    best = np.full(n, 1 << 60, np.int64)
    kind, rice, coef, shift, folded = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, 2), np.int32), np.zeros(n, np.int32), np.zeros((n, BLOCK), np.uint32)
    for order, r, c, s in _residuals(x):
        u = ((r << 1) ^ (r >> 31)).astype(np.uint32)
        rows = BLOCK - abs(order)
        mean = u.sum(axis=1, dtype=np.int64) / rows
        k = np.clip(np.floor(np.log2(np.maximum(mean * 0.72, 1))), 0, 14).astype(np.int64)
        cost = (u >> k[:, None].astype(np.uint32)).sum(axis=1, dtype=np.int64) + rows * (k + 1) + 8 * abs(order) + (9 + 14 if order < 0 else 0)
        take = cost < best
        best[take], kind[take], rice[take], coef[take], shift[take], folded[take] = cost[take], order, k[take], c[take], s[take], u[take]
    order = np.abs(kind)
    # Bits of each frame after its header: subframe header, warm-up, predictor, residual header, residuals.
    lead = 8 + 8 * order + np.where(kind < 0, 4 + 5 + 14, 0) + 2 + 4 + 4
    body = (best - 8 * order - np.where(kind < 0, 23, 0)) + lead
    name, name_size = _number(number)
    head = 4 + name_size + 1
    body_bytes = (body + 7) // 8
    frame_bytes = head + body_bytes + 2
    start = np.concatenate([[0], np.cumsum(frame_bytes)])
    total = int(start[-1])
    bits = np.zeros(total * 8, np.uint8)
    at = (start[:-1] + head) * 8

    def put(pos: np.ndarray, value: np.ndarray, width: int) -> None:
        for j in range(width):
            bits[pos + j] = (value >> (width - 1 - j)) & 1

    put(at, np.where(kind < 0, (32 + order - 1) << 1, (8 + order) << 1), 8)
    at = at + 8
    for j in range(2):
        rows = np.flatnonzero(order > j)
        put(at[rows], x[rows, j] & 0xFF, 8)
        at[rows] += 8
    rows = np.flatnonzero(kind < 0)
    put(at[rows], np.full(len(rows), 6), 4)
    put(at[rows] + 4, shift[rows], 5)
    put(at[rows] + 9, coef[rows, 0] & 0x7F, 7)
    put(at[rows] + 16, coef[rows, 1] & 0x7F, 7)
    at[rows] += 23
    put(at + 6, rice, 4)  # method 0 and partition order 0 are zero bits
    at += 10
    k = rice[:, None].astype(np.uint32)
    q = (folded >> k).astype(np.int64)
    skip = np.arange(BLOCK)[None, :] < order[:, None]
    length = np.where(skip, 0, q + 1 + rice[:, None])
    ends = np.cumsum(length, axis=1) + at[:, None]
    keep = ~skip
    one = (ends - rice[:, None] - 1)[keep]
    bits[one] = 1
    u, kk = folded[keep], np.broadcast_to(rice[:, None], q.shape)[keep]
    for j in range(int(rice.max(initial=0))):  # bit j from the low end
        rows = np.flatnonzero((kk > j) & (u >> np.uint32(j) & np.uint32(1) != 0))
        bits[one[rows] + kk[rows] - j] = 1
    out = np.packbits(bits)
    del bits
    s = start[:-1]
    out[s], out[s + 1], out[s + 2], out[s + 3] = 0xFF, 0xF8, 0x10 | RATE_CODE, 0x02
    for j in range(int(name_size.max(initial=0))):
        rows = np.flatnonzero(name_size > j)
        out[s[rows] + 4 + j] = name[rows, j]
    out[s + head - 1] = _crc(out, s, head - 1, 8)
    crc = _crc(out, s, frame_bytes - 2, 16)
    out[s + frame_bytes - 2], out[s + frame_bytes - 1] = crc >> 8, crc & 0xFF
    blob, streams = out.tobytes(), []
    points = np.zeros(n, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")]))
    points["sample"], points["size"] = number * BLOCK, BLOCK
    points["offset"] = s - np.repeat(start[firsts[:-1]], counts)
    seek = points.tobytes()
    signed = (data ^ 0x80).tobytes()
    smallest, largest = (np.minimum.reduceat, np.maximum.reduceat)
    full = np.flatnonzero(counts)
    low, high = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    if len(full):
        low[full], high[full] = smallest(frame_bytes, firsts[full]), largest(frame_bytes, firsts[full])
    for i, count in enumerate(counts):
        a, b = int(firsts[i]), int(firsts[i + 1])
        samples = int(count) * BLOCK
        info = struct.pack(">HH", BLOCK, BLOCK) + int(low[i]).to_bytes(3, "big") + int(high[i]).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | samples).to_bytes(8, "big") + hashlib.md5(signed[a * BLOCK : b * BLOCK]).digest()
        # A seek table's length has 24 bits: very long texts get one point for every so many frames.
        every = -(-int(count) * 18 // ((1 << 24) - 18)) or 1
        index = seek[18 * a : 18 * b] if every == 1 else points[a:b:every].tobytes()
        streams.append(b"fLaC" + b"\x00\x00\x00\x22" + info + b"\x83" + len(index).to_bytes(3, "big") + index + blob[start[a] : start[b]])
    return streams


def _open(stream: bytes) -> tuple[int, bytes, np.ndarray, int]:
    """Samples, digest, frame offsets and the place of the first frame, from the metadata blocks."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, samples, digest, seek = 4, False, 0, b"", None
    while not last:
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            fields = int.from_bytes(body[10:18], "big")
            samples, digest = fields & ((1 << 36) - 1), body[18:34]
            if (fields >> 36 & 31) != 7 or (fields >> 41 & 7):
                raise ValueError("only 8-bit mono is supported")
        elif kind == 3:
            seek = np.frombuffer(body, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")]))
            seek = seek[seek["sample"] != 0xFFFFFFFFFFFFFFFF]
        at += 4 + size
    offsets = np.zeros(0, np.int64) if seek is None else seek["offset"].astype(np.int64)
    return samples, digest, offsets, at


def _find(stream: bytes, at: int) -> np.ndarray:
    """Frame offsets by their sync codes, for streams without a seek point per frame: a header counts if its
    checksum holds and the frame before it ends there with a right checksum."""
    data = np.frombuffer(stream, np.uint8)
    hits = np.flatnonzero((data[at:-1] == 0xFF) & (data[at + 1 :] == 0xF8)) + at
    good = []
    for h in hits:
        first = stream[h + 4]
        size = 4 + (1 if first < 0x80 else 8 - (first ^ 0xFF).bit_length()) + {6: 1, 7: 2}.get(stream[h + 2] >> 4, 0)
        if h + size < len(stream) and int(_crc(data, np.array([h]), np.array([size]), 8)[0]) == stream[h + size]:
            if good and int(_crc(data, np.array([good[-1]]), np.array([h - 2 - good[-1]]), 16)[0]) != int.from_bytes(stream[h - 2 : h], "big"):
                continue
            good.append(int(h))
    return np.array(good, np.int64) - at


def decode(streams: list[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """The payload of each stream, and the first sample of each of its frames. Raises ValueError on damage."""
    opened = [_open(s) for s in streams]
    base, starts, ends, owner = 0, [], [], []
    for i, (stream, (samples, _, offsets, at)) in enumerate(zip(streams, opened, strict=True)):
        if samples and len(offsets) * BLOCK < samples:
            offsets = _find(stream, at)
        if len(offsets):
            starts.append(base + at + offsets)
            ends.append(np.append(starts[-1][1:], base + len(stream)))
            owner.append(np.full(len(offsets), i))
        base += len(stream)
    if not starts:
        return [b"" for _ in streams], [np.zeros(0, np.int64) for _ in streams]
    data = np.frombuffer(b"".join(streams) + bytes(16), np.uint8)
    s, e, owner = np.concatenate(starts), np.concatenate(ends), np.concatenate(owner)
    if not np.all((data[s] == 0xFF) & (data[s + 1] == 0xF8)):
        raise ValueError("a frame does not begin with its sync code")
    lead = data[s + 4].astype(np.int64)
    name_size = np.where(lead < 0x80, 1, 8 - np.ceil(np.log2((lead ^ 0xFF) + 1)).astype(np.int64))
    code = (data[s + 2] >> 4).astype(np.int64)
    extra = np.where(code == 6, 1, np.where(code == 7, 2, 0))
    at = s + 4 + name_size
    sizes = np.zeros(16, np.int64)
    sizes[list(SIZES)] = list(SIZES.values())
    block = np.where(code == 6, data[at].astype(np.int64) + 1, np.where(code == 7, (data[at].astype(np.int64) << 8 | data[at + 1]) + 1, sizes[code]))
    head = 4 + name_size + extra + 1
    if not np.array_equal(_crc(data, s, head - 1, 8), data[s + head - 1]):
        raise ValueError("a frame header's checksum is wrong")
    if not np.array_equal(_crc(data, s, e - s - 2, 16), data[e - 2].astype(np.uint16) << np.uint16(8) | data[e - 1]):
        raise ValueError("a frame's checksum is wrong")
    window = np.zeros(len(data) - 8, np.uint64)
    for j in range(8):
        window |= data[j : len(data) - 8 + j].astype(np.uint64) << np.uint64(56 - 8 * j)

    pos = (s + head) * 8

    def read(rows: np.ndarray | slice, width: np.ndarray | int, signed: bool = False) -> np.ndarray:
        """The next width (1 to 32) bits of the lanes in rows."""
        p = pos[rows]
        w = np.asarray(width, np.int64)
        v = (window[p >> 3] << (p & 7).astype(np.uint64)) >> (64 - w).astype(np.uint64)
        pos[rows] = p + w
        v = v.astype(np.int64)
        return np.where(v >> (w - 1) & 1, v - (np.int64(1) << w), v) if signed else v

    every = np.arange(len(s))
    kind = read(every, 8)
    if np.any(kind & 0x81):
        raise ValueError("wasted bits are not supported")
    kind >>= 1
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    if not np.all(fixed | linear | (kind <= 1)):
        raise ValueError("a reserved kind of subframe")
    order = np.where(fixed, kind - 8, np.where(linear, kind - 31, 0))
    top, longest = int(order.max()), int(block.max())
    out = np.zeros((longest, len(s)), np.int64)  # one row a sample: each step writes a row
    for j in range(top):
        rows = np.flatnonzero(order > j)
        out[j, rows] = read(rows, 8, True)
    coef, shift = np.zeros((max(top, 1), len(s)), np.int64), np.zeros(len(s), np.int64)
    for o in range(1, 5):
        rows = np.flatnonzero(fixed & (order == o))
        if len(rows):
            coef[:o, rows] = np.array(FIXED[o])[:, None]
    rows = np.flatnonzero(linear)
    if len(rows):
        precision = read(rows, 4) + 1
        shift[rows] = read(rows, 5)
        for j in range(top):
            some = order[rows] > j
            coef[j, rows[some]] = read(rows[some], precision[some], True)
    for rows, same in ((np.flatnonzero(kind == 0), True), (np.flatnonzero(kind == 1), False)):
        for i in range(int(block[rows].max(initial=0))):
            live = rows[block[rows] > i]
            out[i, live] = out[0, live] if same and i else read(live, 8, True)
    rice = np.flatnonzero(kind > 1)
    if len(rice):
        lane = rice[np.argsort(-block[rice], kind="stable")]
        method = read(lane, 2)
        parts = read(lane, 4)
        wide = np.where(method == 0, 4, 5)
        n, o, c, sh = block[lane], order[lane], coef[:, lane], shift[lane]
        left = (n >> parts) - o
        p, k, raw = pos[lane], np.zeros(len(lane), np.int64), np.full(len(lane), -1)
        due = np.ones(len(lane), bool)
        lowest = int(o.min())
        whole = np.all(n == n[0])
        for i in range(lowest, longest):
            m = len(lane) if whole else int(np.searchsorted(-n, -i, side="left"))
            active = np.flatnonzero((o[:m] <= i) & (due[:m] | (left[:m] == 0))) if i <= top or np.any(left[:m] == 0) else ()
            if len(active):  # a partition begins: its parameter comes first
                again = ~due[active]
                left[active[again]] = n[active[again]] >> parts[active[again]]
                due[active] = False
                pos[lane[active]] = p[active]
                k[active] = read(lane[active], wide[active])
                escape = k[active] == np.where(wide[active] == 4, 15, 31)
                raw[active] = -1
                if np.any(escape):
                    rows = active[escape]
                    raw[rows] = read(lane[rows], 5)
                p[active] = pos[lane[active]]
            go = slice(0, m) if i >= top else np.flatnonzero(o[:m] <= i)
            pp, kk = p[go], k[go]
            v = window[pp >> 3] << (pp & 7).astype(np.uint64)
            t = (v >> np.uint64(32)).astype(np.float64)
            q = 32 - np.frexp(t)[1].astype(np.int64)
            if np.any(t == 0):
                for x in np.flatnonzero(t == 0):
                    if raw[go][x] < 0:  # a long run of zeros: bit by bit, from the window's end on
                        a = int(pp[x])
                        while not window[a >> 3] << np.uint64(a & 7) & np.uint64(1 << 63):
                            a += 1
                        q[x] = a - int(pp[x])
            after = pp + q + 1
            v = window[after >> 3] << (after & 7).astype(np.uint64)
            u = (q << kk) | ((v >> np.uint64(1)) >> (63 - kk).astype(np.uint64)).astype(np.int64)
            r = (u >> 1) ^ -(u & 1)
            p[go] = after + kk
            if np.any(raw[go] >= 0):
                rows = np.arange(m)[go][raw[go] >= 0]
                p[rows] = pp[raw[go] >= 0]
                pos[lane[rows]] = p[rows]
                some = rows[raw[rows] > 0]
                r[raw[go] >= 0] = 0
                values = np.zeros(m, np.int64)
                values[some] = read(lane[some], raw[some], True)
                r[raw[go] >= 0] = values[rows]
                p[rows] = pos[lane[rows]]
            guess = np.zeros(len(pp), np.int64)
            for j in range(min(top, i)):
                guess += c[j][go] * out[i - 1 - j, lane[go]]
            out[i, lane[go]] = r + (guess >> sh[go])
            left[go] -= 1
    lanes = np.bincount(owner, minlength=len(streams))
    firsts = np.concatenate([[0], np.cumsum(lanes)])
    if np.all(block == longest):
        flat = (out.T + 128).astype(np.uint8).reshape(-1)
    else:
        flat = (out.T + 128).astype(np.uint8)[np.arange(longest)[None, :] < block[:, None]]
    at = np.concatenate([[0], np.cumsum(block)])
    payloads, offsets = [], []
    for i, (samples, digest, _, _) in enumerate(opened):
        a, b = int(at[firsts[i]]), int(at[firsts[i + 1]])
        if b - a != samples or (digest != bytes(16) and hashlib.md5((flat[a:b] ^ 0x80).tobytes()).digest() != digest):
            raise ValueError("a stream's samples do not match its digest")
        payloads.append(flat[a:b].tobytes())
        offsets.append(at[firsts[i] : firsts[i + 1]] - a)
    return payloads, offsets


def pad(text: bytes) -> bytes:
    """Append bytes 32 up to a positive multiple of BLOCK."""
    return text + b" " * (max(BLOCK, -(-len(text) // BLOCK) * BLOCK) - len(text))


def feature(payload: bytes, starts: np.ndarray) -> str:
    """Frames, mean, root mean square and zero crossings of the samples that were read back."""
    x = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"frames={len(starts)};mean={x.sum() / max(1, len(x)):.4f};rms={np.sqrt((x * x).sum() / max(1, len(x))):.4f};crossings={crossings}"


def to_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' doc_id with column media: the text's padded UTF-8 bytes as a FLAC stream (null text: empty)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            texts = [pad((x or "").encode()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encode(texts), pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, media binary")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """One row a frame: doc_id, block, sample_offset, n_samples, pcm (unsigned 8-bit samples); null media has none."""
    ship(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                ids, blobs = batch.column(0).slice(a, 256).to_pylist(), batch.column(1).slice(a, 256).to_pylist()
                kept = [(i, b) for i, b in zip(ids, blobs, strict=True) if b is not None]
                rows = []
                for (i, _), payload, starts in zip(kept, *decode([b for _, b in kept]), strict=True) if kept else ():
                    ends = [*starts[1:].tolist(), len(payload)]
                    rows += [(i, j, x, y - x, payload[x:y]) for j, (x, y) in enumerate(zip(starts.tolist(), ends, strict=True))]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "block", "sample_offset", "n_samples", "pcm"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, block long, sample_offset long, n_samples long, pcm binary")


def media_digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """Store each text as a FLAC stream, read the stream back and describe both: the columns of op2's contract.

    Null texts count as empty; rows with equal or null ids are kept as they are; other columns are ignored.
    """
    ship(docs.sparkSession)
    fields = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, limit=1 << 20):
            data, offsets = utf8(batch.column(1))
            blob = data.tobytes()
            texts = [blob[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            media = encode([pad(x) for x in texts])
            rows = []
            for t, m, p, starts in zip(texts, media, *decode(media), strict=True):
                rows.append((len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(p, starts)))
            cols = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types[1:], strict=True))], [x.split()[0] for x in fields.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("text")).mapInArrow(run, fields)
