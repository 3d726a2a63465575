"""FLAC media columns: texts or any bytes as 8-bit mono samples, encoded losslessly and decoded to seekable PCM blocks.

The decoder reads the metadata and the seek table, finds frames, verifies both checksums of every frame, reads Rice-coded
residuals (any partition order, escaped partitions too) and undoes constant, verbatim, fixed and linear predictors. Rice
codes have no fixed width, so one stream can only be read code after code; the decoder takes a code of every frame of a
batch at a time instead, in numpy. Frames are independent, so memory is bounded by `frames_at_once`, however long a
medium. Block rows carry the sample offset at which they start: a reader seeks by filtering on it.

The encoder picks per frame the cheapest of constant, verbatim, fixed predictors of order 0 to 2 and one of linear
predictors whose coefficients are fitted to the frame.

Defined cases: null bytes are no bytes, and such a medium still holds one padded block; a null doc_id passes through;
equal texts give equal media; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, saved, shipped, small_batches, text_key, text_or_empty

BLOCK, RATE, SEEK_POINT = 4096, 8000, 18


def _crc_table(bits: int, polynomial: int) -> np.ndarray:
    table, top = np.arange(256, dtype=np.uint32) << (bits - 8), 1 << (bits - 1)
    for _ in range(8):
        table = np.where(table & top, (table << 1) ^ polynomial, table << 1)
    return table & ((1 << bits) - 1)


CRC8, CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = int(CRC8[crc ^ b])
    return crc


def crc16s(chunks: list[bytes]) -> np.ndarray:
    """CRC-16 of many chunks, a byte of all at a time. It starts from 0, so zeros put before a chunk change nothing."""
    longest = max(map(len, chunks), default=0)
    aligned = np.zeros((len(chunks), longest), np.uint8)
    for i, c in enumerate(chunks):
        aligned[i, longest - len(c) :] = np.frombuffer(c, np.uint8)
    crc = np.zeros(len(chunks), np.uint32)
    for row in np.ascontiguousarray(aligned.T):
        crc = ((crc << 8) & 0xFFFF) ^ CRC16[(crc >> 8) ^ row]
    return crc


def coded_number(n: int) -> bytes:
    """A frame number in the format's variable-length code (UTF-8 carried on to 36 bits)."""
    if n < 0x80:
        return bytes([n])
    tail = []
    while True:
        tail.append(0x80 | (n & 0x3F))
        n >>= 6
        if n < 1 << (6 - len(tail)):
            return bytes([(0xFF00 >> (len(tail) + 1)) & 0xFF | n, *tail[::-1]])


def number_at(data: bytes, at: int) -> tuple[int, int]:
    """The number coded at `at` and where it ends."""
    first, more = data[at], 0
    while first & (0x80 >> more):
        more += 1
    n = first & (0x7F >> more)
    for b in data[at + 1 : at + max(more, 1)]:
        n = n << 6 | (b & 0x3F)
    return n, at + max(more, 1)


def bit_array(values: np.ndarray, width: int) -> np.ndarray:
    """The low `width` bits of each value, high bit first, as one row of bits."""
    return ((values[:, None] >> np.arange(width - 1, -1, -1)) & 1).astype(np.uint8).ravel()


def rice_bits(residual: np.ndarray, k: int) -> np.ndarray:
    folded = np.where(residual < 0, -2 * residual - 1, 2 * residual)
    high = folded >> k
    ends = np.cumsum(high + 1 + k)
    bits = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    bits[ends - k - 1] = 1
    for j in range(k):
        bits[ends - k + j] = (folded >> (k - 1 - j)) & 1
    return bits


def rice_cost(residual: np.ndarray) -> tuple[int, int]:
    """(bits, parameter) of the cheapest Rice parameter for one partition, among those next to what the mean suggests."""
    folded = np.where(residual < 0, -2 * residual - 1, 2 * residual)
    near = max(1, int(np.log2(max(2.0, 0.7 * float(folded.mean())))))
    return min((int((folded >> k).sum()) + len(folded) * (k + 1), k) for k in range(near - 1, near + 2))


def predicted(samples: np.ndarray, coefficients: np.ndarray, shift: int) -> np.ndarray:
    """What a linear predictor says of samples[order:]."""
    order = len(coefficients)
    total = np.zeros(len(samples) - order, np.int32)
    for j, c in enumerate(coefficients.tolist()):
        total += c * samples[order - 1 - j : len(samples) - 1 - j]
    return total >> shift


def fitted(samples: np.ndarray, order: int, precision: int = 10) -> tuple[np.ndarray, int] | None:
    """Coefficients by the autocorrelation method (Levinson and Durbin), quantised; None if the frame has no variance."""
    x = samples.astype(float)
    r = np.array([(x[: len(x) - i] * x[i:]).sum() for i in range(order + 1)])
    if r[0] <= 0:
        return None
    a, error = np.zeros(order), r[0]
    for i in range(order):
        reflection = (r[i + 1] - (a[:i] * r[i:0:-1]).sum()) / error
        a[:i] = a[:i] - reflection * a[:i][::-1]
        a[i] = reflection
        error *= 1 - reflection * reflection
        if error <= 0:
            return None
    largest = float(np.abs(a).max())
    if not largest:
        return None
    shift = int(np.clip(precision - 2 - np.floor(np.log2(largest)), 0, 15))
    limit = (1 << (precision - 1)) - 1
    return np.clip(np.round(a * (1 << shift)), -limit - 1, limit).astype(np.int64), shift


def encoded_frame(samples: np.ndarray, number: int, order: int) -> bytes:
    """A frame of signed 8-bit samples, without its closing CRC-16."""
    n = len(samples)
    head = b"\xff\xf8" + bytes([0xC0 if n == BLOCK else 0x70, 0x02]) + coded_number(number)
    if n != BLOCK:
        head += (n - 1).to_bytes(2, "big")
    head += bytes([crc8(head)])
    if (samples == samples[0]).all():
        body = np.concatenate([bit_array(np.array([0]), 8), bit_array(samples[:1], 8)])
        return head + np.packbits(body).tobytes()
    # (bits, kind code, warm-up, residual, Rice parameter, coefficients, shift)
    best = (8 * n, 1, samples, None, 0, None, 0)
    differences = [samples, np.diff(samples), np.diff(samples, 2)]
    fixed = min(range(3), key=lambda f: int(np.abs(differences[f]).sum()))
    bits, k = rice_cost(differences[fixed])
    if bits + 8 * fixed + 10 < best[0]:
        best = (bits + 8 * fixed + 10, 8 + fixed, samples[:fixed], differences[fixed], k, None, 0)
    if n > 4 * order and (fit := fitted(samples, order)):
        linear = samples[order:] - predicted(samples, *fit)
        bits, k = rice_cost(linear)
        if bits + 18 * order + 19 < best[0]:
            best = (bits + 18 * order + 19, 31 + order, samples[:order], linear, k, *fit)
    _, kind, warm, residual, k, coefficients, shift = best
    parts = [bit_array(np.array([kind << 1]), 8), bit_array(warm, 8)]
    if coefficients is not None:
        parts += [bit_array(np.array([9]), 4), bit_array(np.array([shift]), 5), bit_array(coefficients, 10)]
    if residual is not None:
        parts += [bit_array(np.array([0]), 6), bit_array(np.array([k]), 4), rice_bits(residual, k)]
    return head + np.packbits(np.concatenate(parts)).tobytes()


def encoded(payloads: list[bytes], order: int = 4) -> list[bytes]:
    """A FLAC stream per payload: bytes 0 to 255 become samples -128 to 127. The seek table has a point a frame."""
    frames: list[bytes] = []
    counts = []
    for p in payloads:
        samples = np.frombuffer(p, np.uint8).astype(np.int32) - 128
        starts = range(0, len(samples), BLOCK)
        frames += [encoded_frame(samples[s : s + BLOCK], i, order) for i, s in enumerate(starts)]
        counts.append(len(starts))
    ends = crc16s(frames)
    frames = [f + int(c).to_bytes(2, "big") for f, c in zip(frames, ends)]
    media, at = [], 0
    for p, count in zip(payloads, counts):
        own, at = frames[at : at + count], at + count
        sizes = [len(f) for f in own]
        offsets = np.r_[0, np.cumsum(sizes)[:-1]].tolist()
        md5 = hashlib.md5((np.frombuffer(p, np.uint8) ^ 128).tobytes()).digest()
        info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += ((RATE << 44) | (7 << 36) | len(p)).to_bytes(8, "big") + md5
        seek = b"".join((i * BLOCK).to_bytes(8, "big") + o.to_bytes(8, "big") + min(BLOCK, len(p) - i * BLOCK).to_bytes(2, "big") for i, o in enumerate(offsets))
        media.append(b"".join([b"fLaC\x00", len(info).to_bytes(3, "big"), info, b"\x83", len(seek).to_bytes(3, "big"), seek, *own]))
    return media


def stream_frames(media: bytes) -> tuple[int, bytes, list[tuple[int, int, int, int]]]:
    """Samples, MD5 and, per frame, (number, offset of its first sub-frame byte, end, block size). Frames are found by
    their sync code, a header checksum that holds and the number that is due; the seek table's points must agree."""
    if media[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, points, total, md5 = 4, False, {}, 0, b""
    while not last:
        last, kind, size = bool(media[at] & 0x80), media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            if (packed >> 41) & 7 or (packed >> 36) & 31 != 7:
                raise ValueError("only 8-bit mono is supported")
            total, md5, block = packed & ((1 << 36) - 1), body[18:34], int.from_bytes(body[:2], "big")
        elif kind == 3:
            for i in range(0, size, SEEK_POINT):
                sample = int.from_bytes(body[i : i + 8], "big")
                if sample != (1 << 64) - 1:  # a placeholder
                    points[sample] = int.from_bytes(body[i + 8 : i + 16], "big")
    start, heads, due = at, [], 0
    while due * block < total:
        at = media.find(b"\xff\xf8", at)
        if at < 0:
            raise ValueError(f"frame {due} is missing")
        number, end = number_at(media, at + 4)
        code = media[at + 2] >> 4
        n = int.from_bytes(media[end : end + 2], "big") + 1 if code == 7 else media[end] + 1 if code == 6 else 256 << (code - 8) if code >= 8 else 0
        end += {7: 2, 6: 1}.get(code, 0)
        if number == due and n and crc8(media[at:end]) == media[end]:
            if points.get(due * block, at - start) != at - start:
                raise ValueError("a seek point does not lead to its frame")
            heads.append((number, at, end + 1, n))
            due += 1
            at = end + 1
        else:
            at += 1
    ends = [h[1] for h in heads[1:]] + [len(media)]
    return total, md5, [(number, at, body, end, n) for (number, at, body, n), end in zip(heads, ends)]


class _Bits:
    """Readers at a bit position each, over one buffer."""

    def __init__(self, buffer: np.ndarray, positions: np.ndarray) -> None:
        padded = np.concatenate([buffer, np.zeros(16, np.uint8)]).astype(np.uint64)
        # eight bytes from every byte on
        self.words = np.zeros(len(padded) - 8, np.uint64)
        for i in range(8):
            self.words |= padded[i : i + len(self.words)] << np.uint64(56 - 8 * i)
        self.at = positions

    def window(self, who: np.ndarray | slice) -> np.ndarray:
        """The next 57 bits at least, from the top of a 64-bit word."""
        at = self.at[who]
        return self.words[at >> 3] << (at & 7).astype(np.uint64)

    def take(self, who: np.ndarray | slice, width: np.ndarray | int) -> np.ndarray:
        """The next `width` (at most 32) bits as numbers."""
        w = np.asarray(width, np.uint64)
        got = np.where(w > 0, self.window(who) >> ((np.uint64(64) - w) & np.uint64(63)), np.uint64(0)).astype(np.int64)
        self.at[who] += np.asarray(width, np.int64)
        return got

    def rice_codes(self, who: np.ndarray, parameter: np.ndarray, steps: int) -> np.ndarray:
        """The next `steps` Rice codes of each reader, folded values: a row per step."""
        one, at, got = np.uint64(1), self.at[who], np.zeros((steps, len(who)), np.int32)
        down = np.uint64(63) - parameter.astype(np.uint64)
        for t in range(steps):
            x = self.words[at >> 3] << (at & 7).astype(np.uint64)
            top = x >> np.uint64(16)  # 48 bits: exact as a float, whose exponent is the first one's place
            zeros = 1023 + 47 - (top.astype(np.float64).view(np.int64) >> 52)
            if not top.all():
                for i in np.flatnonzero(top == 0).tolist():  # more zeros than the window shows
                    n = int(at[i])
                    while not (int(self.words[n >> 3]) >> (63 - (n & 7))) & 1:
                        n += 1
                    zeros[i] = n - at[i]
            at += zeros + 1
            long = zeros + parameter > 54
            low = ((x << zeros.astype(np.uint64)) << one) >> down >> one
            if long.any():
                low[long] = (self.words[at[long] >> 3] << (at[long] & 7).astype(np.uint64)) >> down[long] >> one
            got[t] = (zeros << parameter) | low.astype(np.int64)
            at += parameter
        self.at[who] = at
        return got


def signed(values: np.ndarray, width: int) -> np.ndarray:
    return values - ((values >> (width - 1)) << width)


def decoded_frames(frames: list[tuple[bytes, int]]) -> list[np.ndarray]:
    """Samples of frames (sub-frame bytes, block size), a residual of every frame at a time; sorted by size inside, so
    that the frames still to be read are the first ones."""
    order = np.argsort([-n for _, n in frames], kind="stable")
    sizes = np.array([frames[i][1] for i in order])
    lengths = np.array([len(frames[i][0]) for i in order])
    bits = _Bits(np.frombuffer(b"".join(frames[i][0] for i in order), np.uint8), 8 * np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64))
    everyone = np.arange(len(frames))
    kind = bits.take(everyone, 8) >> 1
    if ((kind > 12) & (kind < 32) | (kind > 1) & (kind < 8)).any():
        raise ValueError("reserved kind of sub-frame")
    # a row per sample, a column per frame: what a step touches lies together
    out = np.zeros((int(sizes[0]), len(frames)), np.int32)
    constant = np.flatnonzero(kind == 0)
    out[:, constant] = signed(bits.take(constant, 8), 8)
    for i in np.flatnonzero(kind == 1).tolist():
        at = int(bits.at[i]) >> 3
        out[: sizes[i], i] = signed((bits.words[at : at + int(sizes[i])] >> np.uint64(56)).astype(np.int64), 8)
    coded = np.flatnonzero(kind >= 8)
    warm = np.where(kind >= 32, kind - 31, np.where(kind >= 8, kind - 8, 0))
    for j in range(int(warm.max(initial=0))):
        who = coded[warm[coded] > j]
        out[j, who] = signed(bits.take(who, 8), 8)
    linear = coded[kind[coded] >= 32]
    precision, shift = np.zeros(len(frames), np.int64), np.zeros(len(frames), np.int32)
    weights = np.zeros((32, len(frames)), np.int32)
    precision[linear] = bits.take(linear, 4) + 1
    shift[linear] = signed(bits.take(linear, 5), 5)
    for j in range(int(warm[linear].max(initial=0))):
        who = linear[warm[linear] > j]
        weights[j, who] = signed(bits.take(who, precision[who]), precision[who])
    residuals(bits, coded, warm, sizes, out)
    for f in range(1, 5):
        for i in np.flatnonzero(kind == 8 + f).tolist():
            x, warm_up = out[f : sizes[i], i], out[:f, i].copy()
            for level in range(f, 0, -1):  # a sum per order, each from the difference of the samples before it
                x = np.cumsum(x) + np.diff(warm_up, level - 1)[-1]
            out[f : sizes[i], i] = x
    for o in np.unique(warm[linear]).tolist():
        who = linear[warm[linear] == o]
        x, w, s = out[:, who], weights[:o, who], shift[who]
        active = np.searchsorted(-sizes[who], -np.arange(len(x)), side="left")  # columns longer than t
        for t in range(o, len(x)):
            n = int(active[t])
            total = w[0, :n] * x[t - 1, :n]
            for j in range(1, o):
                total += w[j, :n] * x[t - 1 - j, :n]
            x[t, :n] += total >> s[:n]
        out[:, who] = x
    result: list[np.ndarray] = [np.zeros(0, np.int32)] * len(frames)
    columns = np.ascontiguousarray(out.T)
    for i, original in enumerate(order.tolist()):
        result[original] = columns[i, : sizes[i]]
    return result


def residuals(bits: _Bits, coded: np.ndarray, warm: np.ndarray, sizes: np.ndarray, out: np.ndarray) -> None:
    """Read the residuals of the frames `coded` into out below their warm-up samples, partition after partition."""
    frames = len(sizes)
    wide, parts = np.zeros(frames, np.int64), np.zeros(frames, np.int64)
    wide[coded] = 4 + bits.take(coded, 2)  # bits of a Rice parameter
    parts[coded] = bits.take(coded, 4)
    left, rice, raw = np.zeros(frames, np.int64), np.zeros(frames, np.int64), np.full(frames, -1)
    place, begun = warm.copy(), np.zeros(frames, bool)
    who = coded[place[coded] < sizes[coded]]
    while len(who):
        fresh = who[left[who] == 0]
        if len(fresh):
            k = bits.take(fresh, wide[fresh])
            escape = k == (1 << wide[fresh]) - 1
            rice[fresh], raw[fresh] = k, -1
            raw[fresh[escape]] = bits.take(fresh[escape], 5)
            left[fresh] = (sizes[fresh] >> parts[fresh]) - np.where(begun[fresh], 0, warm[fresh])
            begun[fresh] = True
        steps = int(left[who].min())
        if steps:
            plain, odd = who[raw[who] < 0], who[raw[who] >= 0]
            span = bits.rice_codes(plain, rice[plain], steps)
            out[place[plain] + np.arange(steps)[:, None], plain] = (span >> 1) ^ -(span & 1)
            for t in range(steps if len(odd) else 0):
                value = bits.take(odd, raw[odd])
                out[place[odd] + t, odd] = np.where(raw[odd] > 0, signed(value, np.maximum(raw[odd], 1)), 0)
            place[who] += steps
            left[who] -= steps
        who = who[place[who] < sizes[who]]


def decoded(media: list[bytes], frames_at_once: int = 2048) -> Iterator[tuple[int, int, int, bytes]]:
    """(medium, block, first sample's offset, PCM bytes) of every frame, in order; each medium's MD5 is verified."""
    todo, sums = [], {}
    for m, data in enumerate(media):
        total, md5, frames = stream_frames(data)
        sums[m] = (total, md5)
        todo += [(m, *f) for f in frames]
    hashes = {m: hashlib.md5() for m in sums}
    seen = dict.fromkeys(sums, 0)
    for low in range(0, len(todo), frames_at_once):
        now = todo[low : low + frames_at_once]
        checks = crc16s([media[m][at : end - 2] for m, _, at, _, end, _ in now])
        if any(int(c) != int.from_bytes(media[m][end - 2 : end], "big") for c, (m, _, _, _, end, _) in zip(checks, now)):
            raise ValueError("a frame's checksum does not hold")
        for (m, number, *_), samples in zip(now, decoded_frames([(media[m][body : end - 2], n) for m, _, _, body, end, n in now])):
            pcm = samples.astype(np.int8).tobytes()
            hashes[m].update(pcm)
            yield m, number, seen[m], pcm
            seen[m] += len(pcm)
    for m, (total, md5) in sums.items():
        if seen[m] != total or (any(md5) and hashes[m].digest() != md5):
            raise ValueError("the stream's MD5 does not hold")


def encode_column(rows: DataFrame, unit: int = 64, key: str = "doc_id") -> DataFrame:
    """key, n_bytes and media (a FLAC stream) of rows (key, bytes): zeros fill up to a positive multiple of unit."""
    shipped(rows.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "bytes"):
            data = batch["bytes"].to_pylist()
            media = encoded([d + bytes(-len(d) % unit or (0 if d else unit)) for d in data])
            yield pa.RecordBatch.from_arrays([batch[key], pa.array(map(len, data), pa.int64()), pa.array(media, pa.binary())], names=[key, "n_bytes", "media"])

    rows = rows.select(key, "bytes")
    return rows.mapInArrow(encode, f"{key} {rows.dtypes[0][1]}, n_bytes long, media binary")


def decode_column(media: DataFrame) -> DataFrame:
    """PCM blocks of rows (doc_id, media): doc_id, block, sample_offset, pcm (signed 8-bit samples)."""
    shipped(media.sparkSession)
    kinds = {"doc_id": pa.int64(), "block": pa.int64(), "sample_offset": pa.int64(), "pcm": pa.binary()}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "media"):
            ids = batch["doc_id"].to_pylist()
            rows = [(ids[m], *rest) for m, *rest in decoded(batch["media"].to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], names=list(kinds))

    return media.select("doc_id", "media").mapInArrow(decode, "doc_id long, block long, sample_offset long, pcm binary")


def media_summary(docs: DataFrame, text: str = "text", most_broadcast: int = 200_000) -> DataFrame:
    """Encode and store each text, read the stored streams back, decode and sum up: doc_id, n_bytes, payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, feature (peak, sum and zero crossings of the samples). All but
    n_bytes comes from the stored stream. Equal texts (by a 128-bit hash) share one stored stream, whose sums all of them get."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).cast("binary").alias("bytes"), F.unhex(text_key(text)).alias("key"))
    keys = saved(rows.select("doc_id", "key"), "keys")
    several = keys.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("first")).where("n > 1")
    # the rows whose text another row has stored, named one by one: no text is a hot key
    others = keys.join(several, "key").where(~F.col("doc_id").eqNullSafe(F.col("first.doc_id"))).select(F.col("doc_id").alias("id"), F.col("key").alias("of")).distinct()
    others = few(saved(others, "others"), most_broadcast)
    rows = rows.join(others, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("of")), "left_anti")
    media = saved(encode_column(rows, key="key"), "media")
    kinds = {"key": pa.binary(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.binary(), "tail_crc32": pa.int64(),
             "media_bytes": pa.int64(), "media_sha256": pa.binary(), "feature": pa.string()}

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "media"):
            media, out = batch["media"].to_pylist(), []
            blocks: list[list[bytes]] = [[] for _ in media]
            for m, _, _, pcm in decoded(media):
                blocks[m].append(pcm)
            for key, n_bytes, data, own in zip(batch["key"].to_pylist(), batch["n_bytes"].to_pylist(), media, blocks):
                samples = np.frombuffer(b"".join(own), np.int8)
                payload = (samples.view(np.uint8) ^ 128).tobytes()
                crossings = int(((samples[1:] < 0) != (samples[:-1] < 0)).sum())
                feature = f"peak={int(np.abs(samples.astype(int)).max())};sum={int(samples.sum(dtype=np.int64))};crossings={crossings}"
                out.append((key, n_bytes, len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-64:]),
                            len(data), hashlib.sha256(data).digest(), feature))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds.values())], names=list(kinds))

    found = media.mapInArrow(sum_up, "key binary, n_bytes long, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string")
    # rows that are repeated whole have each stored a stream
    found = found.dropDuplicates(["key"])
    text_of = lambda c: F.lower(F.hex(c)).alias(c)
    return keys.join(found, "key").select("doc_id", *[text_of(c) if c.endswith("sha256") else c for c in list(kinds)[1:]])
