"""Operator 6: token ids as range-ordered, entropy-coded shards.

Texts are tokenised where they lie; ids are counted over all documents; the counts, at most one row for each entry of the
vocabulary, make one shared frequency table; documents are then range-partitioned by id, and each partition writes a shard
of rANS blocks (see ``rans``). The frequency table and the tokenizer's name and checksum lie beside the shards, so a reader
needs the folder alone. Readers decode blocks independently; a shard's first token follows from the shards' totals.

Defined cases: a null or empty text is the end id alone; a null doc_id comes before all others; rows of equal id are
ordered by their ids' bytes; an empty table writes no shard and reads back no row; other columns are not read. A very long
text is tokenised whole, its ids are one row.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, join_small, saved, shared_dir, table
from .rans import FrequencyTable, decode, encode
from .textarrays import LOWER, SPACE, frugal, text_chunks

END_ID = 2
#: Ids that are encoded side by side, and pieces that a worker remembers.
GROUP_TOKENS, REMEMBERED = 1 << 20, 800_000
#: New pieces that are encoded in one call.
PIECES = 2048

#: How a tokenizer of words is described in its file; only these drop white space and cut at it.
WORD_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_loaded: dict[str, object] = {}

#: ASCII marks, before which a word of Latin letters always ends.
_MARK = np.zeros(256, bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True


def is_word(piece: str) -> bool:
    """Whether a piece is Latin letters alone, which the tokenizer takes as one word."""
    return piece.isalpha() and max(piece) < "\u0130"


class _Pieces(dict):
    """Number of each piece; a piece that isn't there yet gets the next one and is noted as new."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


def _cuts_at_blanks(spec: dict) -> bool:
    """Whether a tokenizer's file says that it lower-cases, drops white space and looks for words by WORD_PATTERN."""
    steps = (spec.get("normalizer") or {}).get("normalizers") or []
    split, level = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}])[:2]
    return (
        [x.get("type") for x in steps] == WORD_NORMALIZERS
        and (split.get("type"), split.get("pattern"), split.get("behavior"), split.get("invert")) == ("Split", {"Regex": WORD_PATTERN}, "Removed", True)
        and (level.get("type"), level.get("add_prefix_space"), level.get("use_regex")) == ("ByteLevel", False, False)
        and spec.get("model", {}).get("end_of_word_suffix") == "</w>"
        and not any(spec.get(k) for k in ("truncation", "padding", "post_processor"))
    )


class PieceTokenizer:
    """Encodes each distinct piece between blanks once, where the tokenizer's file shows that this is the same; else whole texts.

    Pieces that are one word of Latin letters need no search for words; they go through the same model by blanks alone.
    Texts that hold "<|" may spell a special token and are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            self.by_piece = _cuts_at_blanks(json.load(f))
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        if self.by_piece:
            self.words = Tokenizer.from_file(path)
            self.words.normalizer = normalizers.Lowercase()
            self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends_word = np.zeros(self.vocabulary, bool)
            self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.at = _Pieces()
        self.ids, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def learn(self, new: list[bytes]) -> None:
        """Encode new pieces, many in one call.

        The ids that end words tell words apart; other pieces are told apart by the places of their tokens: a token belongs
        to the piece in which it starts.
        """
        texts = [x.decode() for x in new]
        word = np.fromiter(map(is_word, texts), bool, len(texts))
        sizes, order, found = np.zeros(len(new), np.int64), [], []
        for plain in (True, False):
            index = np.flatnonzero(word == plain)
            for k in range(0, len(index), PIECES):
                at = index[k : k + PIECES]
                part = [texts[i] for i in at.tolist()]
                text = " ".join(part)
                if plain:
                    ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
                    last = np.flatnonzero(self.ends_word[ids])
                    if len(last) != len(at):
                        raise ArithmeticError("a word has no end")
                    sizes[at] = np.diff(last + 1, prepend=0)
                else:
                    e = self.tokenizer.encode(text, add_special_tokens=False)
                    ids = np.array(e.ids, np.uint32)
                    length = np.fromiter(map(len, part), np.int64, len(part)) + 1
                    begin = np.fromiter((o[0] for o in e.offsets), np.int64, len(e))
                    sizes[at] = np.bincount(np.searchsorted(np.cumsum(length), begin, "right"), minlength=len(part))
                order.append(at)
                found.append(ids)
        # Back in the order of the pieces' numbers.
        first, order = np.cumsum(sizes) - sizes, np.concatenate(order)
        n = sizes[order]
        flat = np.empty(int(sizes.sum()), np.uint32)
        flat[np.repeat(first[order] - (np.cumsum(n) - n), n) + np.arange(len(flat))] = np.concatenate(found)
        self.ids = np.concatenate([self.ids, flat])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])

    def _whole(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = buf.tobytes()
        texts = [raw[i:j].decode() for i, j in zip(off[:-1].tolist(), off[1:].tolist())]
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(x) for x in found], np.int64)

    def _by_piece(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.at) > REMEMBERED:
            self.forget()
        low = np.where(SPACE[buf], 32, LOWER[buf]).astype(np.uint8)
        # A blank before each mark that follows a Latin letter (two bytes: U+00C0 to U+00FF but the signs for times and divided).
        letter = (low >= 97) & (low <= 122)
        letter[1:] |= (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0xBF) & (low[1:] != 0x97) & (low[1:] != 0xB7)
        ends = np.zeros(len(low) + 1, bool)
        ends[off] = True
        mark = np.flatnonzero(_MARK[low[1:]] & letter[:-1] & ~ends[1:-1]) + 1
        cut = np.sort(np.concatenate([mark, off[1:-1]]))
        text = np.insert(low, cut, 32)
        blanks = np.flatnonzero(text == 32)
        stop = off[1:] + np.searchsorted(mark, off[1:]) + np.arange(len(off) - 1)  # where each text ends in ``text``
        n_pieces = np.diff(np.searchsorted(blanks, stop), prepend=-1)
        pieces = text.tobytes().split(b" ")
        index = np.fromiter(map(self.at.__getitem__, pieces), np.int64, len(pieces))
        if self.at.new:
            self.learn(self.at.new)
            self.at.new = []
        n = self.first[index + 1] - self.first[index]
        running = np.concatenate([[0], np.cumsum(n)])
        flat = self.ids[np.repeat(self.first[index] - running[:-1], n) + np.arange(running[-1])]
        return flat, np.diff(running[np.cumsum(n_pieces)], prepend=0)

    def encode(self, buf: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has, its end id included."""
        special = bool(((buf[:-1] == 60) & (buf[1:] == 124)).any())
        flat, per = self._whole(buf, off) if special or not self.by_piece else self._by_piece(buf, off)
        out = np.full(len(flat) + len(per), end_id, np.uint32)
        body = np.ones(len(out), bool)
        body[np.cumsum(per + 1) - 1] = False
        out[body] = flat
        return out, per + 1


def tokenizer(path: str) -> PieceTokenizer:
    if path not in _loaded:
        _loaded[path] = PieceTokenizer(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _groups(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for k, n in enumerate(lengths):
        if k > lo and size + n > most:
            yield lo, k
            lo, size = k, 0
        size += n
    if lengths:
        yield lo, len(lengths)


def token_rows(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids binary): the ids of each document as little-endian integers of ``id_type`` width."""
    wide = id_type(path)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            for lo, hi, buf, off in text_chunks(b.column(1), 2 << 20):
                ids, n = t.encode(buf, off, end_id)
                raw = ids.astype(wide).tobytes()
                off = np.concatenate([[0], np.cumsum(n)]) * np.dtype(wide).itemsize
                data = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).cast(pa.int64()), data.cast(pa.binary())], ["doc_id", "ids"])
        t.forget()  # the worker stays, for stages that need its memory

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def id_type(path: str) -> str:
    return "<u2" if tokenizer(path).vocabulary <= 1 << 16 else "<u4"


def counts(tokens: DataFrame, path: str) -> np.ndarray:
    """How often each id occurs in all documents; as many rows as the vocabulary come to the driver at most."""
    wide, size = id_type(path), tokenizer(path).vocabulary

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros(size, np.int64)
        for b in batches:
            col = b.column(0)
            _, off, data = col.buffers()
            if data is not None and len(col):
                o = np.frombuffer(off, np.int32)[col.offset : col.offset + len(col) + 1]
                c += np.bincount(np.frombuffer(data, np.uint8)[o[0] : o[-1]].view(wide), minlength=size)
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(c[at])], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size, np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


SHARDS = "shard int, seq int, first long, doc_ids array<long>, n_tokens array<long>, blocks array<binary>"


TABLE = "tokenizer string, tokenizer_sha256 string, end_id int, bits int, ids array<int>, frequencies array<int>"


def write_shards(tokens: DataFrame, freq: FrequencyTable, path: str, end_id: int, folder: str) -> None:
    """Write (doc_id, ids) in ascending doc_id order to ``folder``: ``shards`` has a row for each group of documents, ``table``
    what a reader needs beside them: the frequencies, at most one for each id, and which tokenizer made the ids."""
    wide = id_type(path)
    shared = tokens.sparkSession.sparkContext.broadcast(freq)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seq, first = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            doc_ids, raw = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in _groups([len(x) for x in raw], GROUP_TOKENS * np.dtype(wide).itemsize):
                n = [len(x) // np.dtype(wide).itemsize for x in raw[lo:hi]]
                blocks = encode([np.frombuffer(b"".join(raw[lo:hi]), wide).astype(np.uint32)], shared.value)[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int32()), pa.array([seq], pa.int32()), pa.array([first], pa.int64()), pa.array([doc_ids[lo:hi]], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64())), pa.array([blocks], pa.list_(pa.binary()))],
                    ["shard", "seq", "first", "doc_ids", "n_tokens", "blocks"],
                )
                seq, first = seq + 1, first + sum(n)

    ordered = tokens.repartitionByRange("doc_id", "ids").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(run, SHARDS).write.parquet(f"{folder}/shards")
    used = np.flatnonzero(freq.freq)
    with open(path, "rb") as f:
        sha = hashlib.sha256(f.read()).hexdigest()
    about = (path.rsplit("/", 1)[-1], sha, end_id, freq.bits, used.tolist(), freq.freq[used].astype(np.int64).tolist())
    tokens.sparkSession.createDataFrame([about], TABLE).coalesce(1).write.parquet(f"{folder}/table")


def read_table(spark, folder: str) -> FrequencyTable:
    """The frequency table that lies beside the shards."""
    r = spark.read.schema(TABLE).parquet(f"{folder}/table").first()
    f = np.zeros(max(r["ids"], default=0) + 1, np.int64)
    f[r["ids"]] = r["frequencies"]
    return FrequencyTable(f, r["bits"])  # frequencies that fill the table stay as they are


def read_shards(spark, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) decoded from what ``write_shards`` left in a folder."""
    shards = spark.read.schema(SHARDS).parquet(f"{folder}/shards")
    shared = spark.sparkContext.broadcast(read_table(spark, folder))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                shard, first, doc_ids, n, blocks = (b.column(c)[r].as_py() for c in range(5))
                ids = np.concatenate([np.zeros(0, np.uint32), *decode(blocks, shared.value)]).astype("<u4")
                end = np.cumsum(np.array(n, np.int64))
                begin = end - n
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(begin.tolist(), end.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(n), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(begin + first), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                    ["shard", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    rows = shards.select("shard", "first", "doc_ids", "n_tokens", "blocks").mapInArrow(run, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    size = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    totals = shards.groupBy("shard").agg(F.sum(size).alias("total"))  # a row for each shard
    before = F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = join_small(rows, totals.select("shard", before.alias("before")), ["shard"])
    return out.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    path, folder = path or default_path(), f"{shared_dir(docs.sparkSession)}/token-shards-{uuid.uuid4().hex}"
    tokens = saved(token_rows(docs, path, end_id), "token-ids")
    write_shards(tokens, FrequencyTable(counts(tokens, path)), path, end_id, folder)
    return read_shards(docs.sparkSession, folder)


def op6(spark, sf_dir: str) -> DataFrame:
    return write_and_read(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return write_and_read(docs)
