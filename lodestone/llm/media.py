"""Operator 3: AVI motion-JPEG media columns: RIFF indexes, intra frames, shots by adaptive histogram differences.

``store`` writes a text's bytes as 8-bit samples of lossless JPEG frames in an AVI file, one file for each row, in a binary
column; ``read`` parses the RIFF chunks and the idx1 index, decodes the frames that the index names and yields samples;
``clip_rows`` yields a timed row for each shot of each file.

A shot ends before a frame whose 16-bin grey histogram differs from the one before by more than the mean and twice the
deviation of the differences around it, and by a tenth at least.

Defined cases: a null or empty text is one frame of one row of 64 zero bytes; equal texts give equal files; a very long text
has many frames and is encoded by itself; media that are null or cannot be read (no MJPG video with an index, neither baseline
nor lossless frames, damaged bytes, headers that promise more than the bytes hold) have no clips, and in ``digest_rows`` nulls and the reason
in ``error``; repeated rows have files of their own; files that do not
say how many bytes they hold have a null n_bytes and all samples as payload; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table
from .jpegcodec import WIDTH, Frame, decode_scans, encode_scans, frame_header
from .textarrays import frugal, text_chunks

FRAME_ROWS, FRAME_MS = 64, 40
BINS, AROUND, DEVIATIONS, LEAST = 16, 8, 2.0, 0.1
#: What parsing damaged bytes can raise; sizes are held against the bytes there are before anything is set aside for them.
BROKEN = (ValueError, ArithmeticError, LookupError, TypeError, struct.error)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _header(frames: int, height: int, largest: int, n_bytes: int) -> bytes:
    avih = struct.pack("<14I", FRAME_MS * 1000, largest * 1000 // FRAME_MS, 0, 0x10, frames, 0, 1, largest, WIDTH, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, FRAME_MS, 1000, 0, frames, largest, 0xFFFFFFFF, 0, 0, 0, WIDTH, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, height, 1, 8, b"MJPG", WIDTH * height, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"bytes=%d" % n_bytes))
    return _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl) + info


def store_texts(buf: np.ndarray, off: np.ndarray) -> list[bytes]:
    """An AVI file for each text."""
    n = np.diff(off)
    rows = np.maximum(1, -(-n // WIDTH))
    frames = -(-rows // FRAME_ROWS)
    height = -(-rows // frames)
    base = np.cumsum(frames * height) - frames * height
    samples = np.zeros((int((frames * height).sum()), WIDTH), np.uint8)
    flat = samples.ravel()
    for a, b, at in zip(off[:-1].tolist(), off[1:].tolist(), (base * WIDTH).tolist()):
        flat[at : at + b - a] = buf[a:b]
    first = np.repeat(base, frames) + (np.arange(frames.sum()) - np.repeat(np.cumsum(frames) - frames, frames)) * np.repeat(height, frames)
    scans, cut = encode_scans(samples, first)
    cut, out, k = cut.tolist(), [], 0
    for size, f, h in zip(n.tolist(), frames.tolist(), height.tolist()):
        head, parts, index, at = frame_header(h), [], [], 4
        for j in range(k, k + f):
            body = _chunk(b"00dc", head + scans[cut[j] : cut[j + 1]] + b"\xff\xd9")
            length = len(head) + cut[j + 1] - cut[j] + 2
            parts.append(body)
            index.append(struct.pack("<4sIII", b"00dc", 0x10, at, length))
            at += len(body)
        k += f
        movi = _chunk(b"LIST", b"movi" + b"".join(parts))
        body = b"AVI " + _header(f, h, max(map(len, parts)), size) + movi + _chunk(b"idx1", b"".join(index))
        out.append(_chunk(b"RIFF", body))
    return out


def parse_avi(data: bytes) -> tuple[list[memoryview], dict]:
    """The frames that the index names, in order, and what the headers say."""
    view = memoryview(data)
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    meta: dict = {"ms": FRAME_MS, "bytes": None}
    movi, index, codec = None, None, None
    todo = [(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body = at + 8
            if name == b"LIST":
                if data[body : body + 4] == b"movi":
                    movi = body
                else:
                    todo.append((body + 4, body + size))
            elif name == b"avih":
                meta["ms"] = struct.unpack_from("<I", data, body)[0] / 1000
            elif name == b"strh" and data[body : body + 4] == b"vids":
                codec = data[body + 4 : body + 8]
            elif name == b"ICMT" and data[body : body + 6] == b"bytes=":
                meta["bytes"] = int(data[body + 6 : body + size].rstrip(b"\0"))
                if not 0 <= meta["bytes"] <= len(data):
                    raise ValueError("more bytes than the file has")
            elif name == b"idx1":
                index = (body, size)
            at = body + size + (size & 1)
    if codec != b"MJPG" or movi is None or index is None:
        raise ValueError("no indexed MJPG stream")
    frames = []
    entries = [struct.unpack_from("<4sIII", data, index[0] + i) for i in range(0, index[1], 16)]
    # Offsets count from the word "movi" or, in some writers' files, from the start of the file.
    origin = 0 if entries and entries[0][2] >= movi else movi
    for name, _, at, size in entries:
        if name[2:] in (b"dc", b"db"):
            start = origin + at + 8
            if data[start - 8 : start - 4] != name:
                raise ValueError("the index does not fit the chunks")
            frames.append(view[start : start + size])
    return frames, meta


def _read(data: bytes | None) -> tuple[list[Frame], dict]:
    if data is None:
        return [], {"error": "no media"}
    try:
        frames, meta = parse_avi(data)
        jpegs = [Frame(f) for f in frames]
    except BROKEN as e:
        return [], {"error": str(e) or type(e).__name__}
    return (jpegs, meta) if jpegs else ([], {"error": "no frames"})


def _decoded(frames: list[Frame], meta: dict) -> tuple[list[np.ndarray], dict]:
    try:
        return [f.grey() for f in frames], meta
    except BROKEN as e:
        return [], {"error": str(e) or type(e).__name__}


def samples_of(media: list[bytes | None]) -> Iterator[tuple[list[np.ndarray], dict]]:
    """Decoded frames and headers of each file; no frames and an "error" where it can't be read. Frames of nine-bit scans are decoded together."""
    files = [_read(m) for m in media]
    fast = [f for frames, _ in files for f in frames if f.nine_bits]
    try:
        rows = decode_scans([f.scan for f in fast], [f.height for f in fast]) if fast else np.zeros((0, WIDTH), np.uint8)
    except BROKEN:
        # One of these files is damaged; each is read by itself.
        yield from (_decoded(frames, meta) for frames, meta in files)
        return
    at = 0
    for frames, meta in files:
        if all(f.nine_bits for f in frames):
            cut = np.cumsum([at, *[f.height for f in frames]])
            at = int(cut[-1])
            yield [rows[i:j] for i, j in zip(cut[:-1], cut[1:])], meta
        else:
            at += sum(f.height for f in frames if f.nine_bits)
            yield _decoded(frames, meta)


def shots(frames: list[np.ndarray]) -> tuple[list[int], np.ndarray]:
    """First frame of each shot, and each frame's histogram difference from the one before (0 for the first)."""
    if len(frames) < 2:
        return [0] if frames else [], np.zeros(len(frames))
    h = np.stack([np.bincount(f.ravel() >> 4, minlength=BINS) / f.size for f in frames])
    d = np.concatenate([[0.0], np.abs(h[1:] - h[:-1]).sum(axis=1) / 2])
    n = len(d)
    lo, hi = np.maximum(1, np.arange(n) - AROUND), np.minimum(n, np.arange(n) + AROUND + 1)
    one, two = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
    k = np.maximum(1, hi - lo)
    mean = (one[hi] - one[lo]) / k
    dev = np.sqrt(np.maximum(0, (two[hi] - two[lo]) / k - mean * mean))
    cut = (d > mean + DEVIATIONS * dev + 1e-12) & (d > LEAST)
    cut[0] = True
    return np.flatnonzero(cut).tolist(), d


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, media binary)."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, off in text_chunks(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(store_texts(buf, off), pa.binary())], ["doc_id", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, media binary")


def _files(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Runs of whole files of bounded size."""
    lo, size = 0, 0
    media = batch.column(1)
    for k in range(batch.num_rows + 1):
        n = len(media[k].as_buffer()) if k < batch.num_rows and media[k].is_valid else 0
        if k > lo and (k == batch.num_rows or size + n > most):
            yield batch.column(0).slice(lo, k - lo), media.slice(lo, k - lo).to_pylist()
            lo, size = k, 0
        size += n


def _clips(frames: list[np.ndarray], ms: float) -> tuple[list[dict], float]:
    """A clip for each shot: start_ms, end_ms, frames, and the difference that begins it; and the largest difference."""
    cut, d = shots(frames)
    return [{"start_ms": s * ms, "end_ms": e * ms, "frames": e - s, "difference": float(d[s])} for s, e in zip(cut, [*cut[1:], len(frames)])], float(d.max(initial=0))


def clip_rows(media: DataFrame) -> DataFrame:
    """(doc_id, clip, start_ms, end_ms, frames, difference): a row for each shot of (doc_id, media)."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, files in _files(b):
                there = [(i, m) for i, m in zip(ids.to_pylist(), files) if m is not None]
                rows = []
                for (i, _), (frames, meta) in zip(there, samples_of([m for _, m in there])):
                    rows += [(i, k, *c.values()) for k, c in enumerate(_clips(frames, meta.get("ms", 0))[0])]
                cols = list(zip(*rows)) if rows else [[]] * 6
                types = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], ["doc_id", "clip", "start_ms", "end_ms", "frames", "difference"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, clip int, start_ms double, end_ms double, frames int, difference double")


_CLIPS = pa.list_(pa.struct([("start_ms", pa.float64()), ("end_ms", pa.float64()), ("frames", pa.int32()), ("difference", pa.float64())]))


def digest_rows(media: DataFrame) -> DataFrame:
    """What the stored bytes say of each row."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, files in _files(b):
                rows = []
                for m, (frames, meta) in zip(files, samples_of(files)):
                    if not frames:
                        whole = (None, None) if m is None else (len(m), hashlib.sha256(m).hexdigest())
                        rows.append((None, None, None, None, *whole, None, meta["error"], None))
                        continue
                    payload = b"".join(f.astype(np.uint8).tobytes() for f in frames)
                    size = len(payload) if meta["bytes"] is None else max(1, -(-meta["bytes"] // WIDTH)) * WIDTH
                    payload = payload[:size]
                    clips, change = _clips(frames, meta["ms"])
                    spans = "|".join(f"{c['start_ms']:g}-{c['end_ms']:g}" for c in clips)
                    feature = f"{frames[0].shape[1]}x{frames[0].shape[0]};frames={len(frames)};clips={spans};change={change:.4f}"
                    rows.append((meta["bytes"], size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature, None, clips))
                cols = list(zip(*rows)) if rows else [[]] * 9
                types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), _CLIPS]
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error", "clips"]
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(list(c), t) for c, t in zip(cols, types)]], names)

    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    kinds += ", clips array<struct<start_ms:double,end_ms:double,frames:int,difference:double>>"
    return media.select("doc_id", "media").mapInArrow(run, kinds)


def op3(spark, sf_dir: str) -> DataFrame:
    return digest_rows(store(table(spark, sf_dir, "documents")))
