"""Static range asymmetric numeral system over token ids: independent interleaved blocks, checkpoints, checksums.

A block holds up to LANES * STEPS tokens of one stream; token i belongs to lane i mod LANES. Lanes share one stream of
32-bit words. Every CHECKPOINT steps the block's header keeps the lanes' states and the place in the stream, so that a
decoder starts at any of them; here all stretches of all blocks of a call are decoded side by side. Two CRC-32 close the
header: of the ids as little-endian 32-bit integers, and of all bytes after the header.

Layout, little-endian: magic "LRA1", lanes u16, steps between checkpoints u16, tokens u32, words u32, checkpoints u32,
ids' crc u32, body's crc u32; then for each checkpoint the place u32 and the lanes' states u64; then the words u32.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"LRA1"
LANES, STEPS, CHECKPOINT = 32, 1024, 256
HEAD = struct.Struct("<4sHHIIIII")
#: States lie in [LOW, LOW << 32).
LOW_BITS = 31


class FrequencyTable:
    """Frequencies of sum 2**bits, one at least for each id that occurs, shared by all blocks."""

    def __init__(self, counts: np.ndarray, bits: int = 20):
        counts = np.asarray(counts, np.int64)
        self.bits, size = bits, 1 << bits
        used = counts > 0
        if used.sum() > size:
            raise ValueError("more ids than the table has slots")
        f = np.zeros(len(counts), np.int64)
        if used.any():
            f[used] = np.maximum(1, counts[used] * size // counts.sum())
            order = np.argsort(-counts, kind="stable")
            off = size - int(f.sum())
            if off >= 0:
                f[order[0]] += off
            else:  # take from the most frequent, never below one
                for i in order:
                    take = min(int(f[i]) - 1, -off)
                    f[i] -= take
                    off += take
                    if off == 0:
                        break
        self.freq = f.astype(np.uint64)
        self.start = (np.cumsum(f) - f).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(f), dtype=np.uint32), f)


def encode(streams: list[np.ndarray], table: FrequencyTable) -> list[list[bytes]]:
    """The blocks of each stream of ids. All blocks of the call are encoded side by side."""
    per = LANES * STEPS
    parts = [(k, ids[i : i + per]) for k, ids in enumerate(streams) for i in range(0, len(ids), per)]
    out: list[list[bytes]] = [[] for _ in streams]
    if not parts:
        return out
    n = len(parts)
    count = np.array([len(p) for _, p in parts])
    steps = -(-count // LANES)
    top = int(steps.max())
    ids = np.zeros((top, n, LANES), np.uint32)
    there = np.zeros((top, n, LANES), bool)
    for j, (_, p) in enumerate(parts):
        full = np.zeros(steps[j] * LANES, np.uint32)
        full[: len(p)] = p
        ids[: steps[j], j] = full.reshape(-1, LANES)
        there[: steps[j], j] = (np.arange(steps[j] * LANES) < len(p)).reshape(-1, LANES)
    x = np.full((n, LANES), 1 << LOW_BITS, np.uint64)
    bits, shift = np.uint64(table.bits), np.uint64(32)
    room = np.uint64(1 << (LOW_BITS + 32 - table.bits))
    written, masks, marks = [], [], {}
    for t in range(top - 1, -1, -1):
        live = there[t]
        f = np.where(live, table.freq[ids[t]], np.uint64(1))
        c = table.start[ids[t]]
        put = live & (x >= f * room)
        written.append(x[put].astype(np.uint32))  # by block, then lane; the decoder takes them in this order
        masks.append(put.sum(axis=1))
        x = np.where(put, x >> shift, x)
        q = x // f
        x = np.where(live, (q << bits) + c + (x - q * f), x)
        if t % CHECKPOINT == 0:
            marks[t] = x.copy()
    # Words of step t stand before those of step t+1.
    sizes = np.array(masks[::-1])
    first = np.cumsum(sizes, axis=0) - sizes
    total = sizes.sum(axis=0)
    base = np.cumsum(total) - total
    words = np.zeros(int(total.sum()), np.uint32)
    for t in range(top):
        w, s = written[top - 1 - t], sizes[t]
        if len(w):
            words[np.repeat(base + first[t], s) + np.arange(len(w)) - np.repeat(np.cumsum(s) - s, s)] = w
    for j, (k, p) in enumerate(parts):
        at = range(0, int(steps[j]), CHECKPOINT)
        points = b"".join(struct.pack("<I", int(first[t, j])) + marks[t][j].astype("<u8").tobytes() for t in at)
        body = points + words[base[j] : base[j] + total[j]].astype("<u4").tobytes()
        sums = zlib.crc32(np.ascontiguousarray(p, "<u4").tobytes()), zlib.crc32(body)
        out[k].append(HEAD.pack(MAGIC, LANES, CHECKPOINT, len(p), int(total[j]), len(at), *sums) + body)
    return out


def _stretches(x: np.ndarray, at: np.ndarray, count: np.ndarray | None, words: np.ndarray, table: FrequencyTable) -> np.ndarray:
    """Ids of stretches, given the lanes' states and places in the words. count: tokens of each, None if all are whole."""
    out = np.zeros((len(x), CHECKPOINT, LANES), np.uint32)
    bits, mask, low = np.uint64(table.bits), np.uint64((1 << table.bits) - 1), np.uint64(1 << LOW_BITS)
    lane = np.arange(LANES)
    for t in range(CHECKPOINT if len(x) else 0):
        live = None if count is None else t * LANES + lane[None, :] < count[:, None]
        if live is not None and not live.any():
            break
        slot = x & mask
        s = table.symbol[slot]
        out[:, t] = s
        new = table.freq[s] * (x >> bits) + slot - table.start[s]
        get = new < low if live is None else live & (new < low)
        rank = np.cumsum(get, axis=1)
        put = np.flatnonzero(get)
        where = (at[:, None] + rank).ravel()[put] - 1
        flat = new.ravel()
        flat[put] = (flat[put] << np.uint64(32)) | words[where]
        x = new if live is None else np.where(live, new, x)
        at = at + rank[:, -1]
    return out


def decode(blocks: list[bytes], table: FrequencyTable) -> list[np.ndarray]:
    """The ids of each block; every stretch between checkpoints is decoded at the same time."""
    if not blocks:
        return []
    heads, states, places, counts, words, base = [], [], [], [], [], 0
    for b in blocks:
        magic, lanes, every, n, n_words, points, crc, body = HEAD.unpack_from(b)
        if magic != MAGIC:
            raise ValueError("not a token block")
        if (lanes, every) != (LANES, CHECKPOINT):
            raise ValueError("blocks of another geometry")
        if zlib.crc32(memoryview(b)[HEAD.size :]) != body:
            raise ValueError("a token block is damaged")
        size = 4 + 8 * lanes
        raw = np.frombuffer(b, np.uint8, points * size, HEAD.size).reshape(points, size)
        places.append(np.ascontiguousarray(raw[:, :4]).view("<u4").ravel().astype(np.int64) + base)
        states.append(np.ascontiguousarray(raw[:, 4:]).view("<u8"))
        counts.append(np.minimum(n - np.arange(points) * lanes * every, lanes * every))
        words.append(np.frombuffer(b, "<u4", n_words, HEAD.size + points * size))
        heads.append((n, points, crc))
        base += n_words
    words = np.concatenate(words).astype(np.uint64)
    x, at, count = np.concatenate(states).astype(np.uint64), np.concatenate(places), np.concatenate(counts)
    out = np.zeros((len(x), CHECKPOINT, LANES), np.uint32)
    full = count == CHECKPOINT * LANES
    out[full] = _stretches(x[full], at[full], None, words, table)
    out[~full] = _stretches(x[~full], at[~full], count[~full], words, table)
    flat, found, k = out.reshape(len(x), -1), [], 0
    for n, points, crc in heads:
        ids = flat[k : k + points].ravel()[:n]
        k += points
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("checksum of a token block does not match")
        found.append(ids)
    return found
