"""Token ids in bit-plane files.

A file holds the ids of a contiguous range of documents, in ascending doc_id order. The ids are cut into blocks of
fixed size; each block is transposed into 4 byte planes or 32 bit planes, and each plane is compressed with zstandard
on its own, so that planes of high bits, which are nearly constant, take almost no room. Layout:

    b"BPZ1" | planes of block 0 | planes of block 1 | ... | index | index length (8 bytes, little endian) | b"BPZ1"

The index is zstandard-compressed JSON: the kind of plane, the block size, for each block its offset, number of ids
and plane lengths, and for each document its id and number of ids.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bidframe.llm.common import materialise, qualified, shared_dir
from bidframe.llm.words import portions

MAGIC = b"BPZ1"
BLOCK_IDS = 1 << 16
#: Bytes of text in one file, roughly; a file is written and read by one task.
FILE_BYTES = 16 << 20
#: Pieces of text whose ids a Python worker remembers, about 200 bytes each.
CACHE_PIECES = 1_000_000
#: Tasks that read files back, at most; beyond that, a task reads neighbouring files.
READ_TASKS = 10_000
#: New pieces that are encoded as one text.
JOINED_PIECES = 1000
#: How byte-level vocabularies write a space and a line feed; marks that a word is parted from.
BYTE_LEVEL_SPACE = "\u0120\u010a"
MARKS = ".,;:!?$%&*#@()[]{}<>/+=-_"
#: Up to here Python and any tokenizer agree on what is a letter.
LAST_LATIN = "\u024f"
#: Characters of neighbouring texts whose new pieces are encoded in one call.
CHUNK_CHARS = 2_000_000


class PieceEncoder:
    """Encodes texts with a tokenizer, once for each distinct piece.

    The pattern of byte-level pre-tokenizers never joins a single space or line feed to the visible character before
    it, so a text may be cut in front of these; each piece, with the space or line feed it begins with, is encoded by
    the tokenizer as it stands, and its ids are remembered as bytes. The pattern also parts a word of letters from the
    marks that end the piece, so such a piece has the word's ids and then the marks'. A text with other or adjacent white
    space, or with it at either end, is encoded whole; so is every text if the tokenizer isn't of this kind.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        said = json.loads(self.tokenizer.to_str())
        cuts = said.get("pre_tokenizer") or {}
        plain = all(not said.get(part) for part in ("normalizer", "post_processor", "truncation", "padding"))
        tokens = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["content"].split() != [t["content"]]) for t in said.get("added_tokens") or [])
        self.by_piece = plain and tokens and cuts.get("type") == "ByteLevel" and cuts.get("use_regex", True) and not cuts.get("add_prefix_space")
        self.marks: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.opens[[k for token, k in vocabulary.items() if token[0] in BYTE_LEVEL_SPACE]] = True
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def mark(self, tail: str) -> bytes:
        ids = self.marks.get(tail)
        if ids is None:
            ids = self.whole(tail)
            if len(self.marks) < CACHE_PIECES:
                self.marks[tail] = ids
        return ids

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """The ids of pieces, given without their leading space: they are encoded as one text, in which the tokens that begin with a space or line feed say where each starts."""
        groups = [new[k : k + JOINED_PIECES] for k in range(0, len(new), JOINED_PIECES)]
        got = self.tokenizer.encode_batch_fast(["".join([p if p[0] == "\n" else " " + p for p in group]) for group in groups], add_special_tokens=False)
        out = {}
        for group, found in zip(groups, got):
            ids = np.array(found.ids, dtype="<u4")
            start = (4 * np.flatnonzero(self.opens[ids])).tolist()
            if len(start) == len(group):
                body = ids.tobytes()
                out.update({p: body[k:m] for p, k, m in zip(group, start, [*start[1:], len(body)])})
            else:
                out.update({p: self.whole(p if p[0] == "\n" else " " + p) for p in group})
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        known, cut, out = self.known, [], []
        for text in texts:
            flat = text.replace("\n", " ") if "\n" in text else text
            words = flat.split()
            if not self.by_piece or not words or " ".join(words) != flat:
                cut.append(None)
            else:
                cut.append(words if flat is text else text.replace("\n", " \n").split(" "))
        new = set().union(*[pieces[1:] for pieces in cut if pieces]).difference(known)
        ends = {p: stem for p in new if (stem := p.rstrip(MARKS)) != p and stem.isalpha() and max(stem) <= LAST_LATIN}
        learnt = self.learn(list(new.difference(ends).union(ends.values()).difference(known)))
        learnt.update({p: (known.get(stem) or learnt[stem]) + self.mark(p[len(stem) :]) for p, stem in ends.items()})
        if len(known) + len(learnt) <= CACHE_PIECES:  # the pieces met first are the common ones; once full, they stay
            known.update(learnt)
            ids_of = known.__getitem__
        else:
            ids_of = lambda p: known.get(p) or learnt[p]
        for text, pieces in zip(texts, cut):
            if not text:
                out.append(b"")
            elif pieces is None:
                out.append(self.whole(text))
            else:
                out.append(self.whole(pieces[0]) + b"".join(map(ids_of, pieces[1:])))
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder per Python worker, which keeps what it has learnt from task to task."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """The byte or bit planes of a block of ids, least significant first."""
    grid = ids.astype("<u4").view(np.uint8).reshape(len(ids), 4)
    if planes == "bit":
        bits = np.unpackbits(grid, axis=1, bitorder="little")
        return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]
    return [grid[:, k].tobytes() for k in range(4)]


def from_planes(parts: list[bytes], n: int, planes: str) -> np.ndarray:
    if planes == "bit":
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in parts], axis=1)
        grid = np.packbits(bits, axis=1, bitorder="little")
    else:
        grid = np.stack([np.frombuffer(p, np.uint8) for p in parts], axis=1)
    return np.ascontiguousarray(grid).view("<u4").ravel()


class PlaneWriter:
    """Writes documents' ids one after the other; at most a block of ids is held."""

    def __init__(self, out, planes: str = "byte", block: int = BLOCK_IDS, level: int = 3):
        self.out, self.planes, self.block = out, planes, block
        self.press = zstandard.ZstdCompressor(level=level)
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self.blocks: list[list] = []
        self.docs: list[tuple] = []
        self.at = out.write(MAGIC) or len(MAGIC)
        self.total = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.total += len(ids)
        while len(ids):
            part = ids[: self.block - self.n_held]
            self.held.append(part)
            self.n_held += len(part)
            ids = ids[len(part) :]
            if self.n_held == self.block:
                self.flush()

    def flush(self) -> None:
        if self.n_held:
            parts = [self.press.compress(p) for p in to_planes(np.concatenate(self.held), self.planes)]
            self.blocks.append([self.at, self.n_held, [len(p) for p in parts]])
            for p in parts:
                self.out.write(p)
            self.at += sum(map(len, parts))
            self.held, self.n_held = [], 0

    def close(self) -> None:
        self.flush()
        index = {"planes": self.planes, "block": self.block, "blocks": self.blocks, "doc_ids": [d for d, _ in self.docs], "counts": [n for _, n in self.docs]}
        packed = self.press.compress(json.dumps(index).encode())
        self.out.write(packed)
        self.out.write(len(packed).to_bytes(8, "little") + MAGIC)
        self.out.close()


class PlaneReader:
    """Reads a file's index, then only the blocks it is asked for."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = source.read_at(12, size - 12)
        if tail[8:] != MAGIC or source.read_at(4, 0) != MAGIC:
            raise ValueError("not a bit-plane file")
        length = int.from_bytes(tail[:8], "little")
        self.press = zstandard.ZstdDecompressor()
        index = json.loads(self.press.decompress(source.read_at(length, size - 12 - length)))
        self.planes, self.blocks, self.doc_ids, self.counts = index["planes"], index["blocks"], index["doc_ids"], index["counts"]

    def read_block(self, k: int) -> np.ndarray:
        at, n, lengths = self.blocks[k]
        raw = self.source.read_at(sum(lengths), at)
        parts, done = [], 0
        for length in lengths:
            parts.append(self.press.decompress(raw[done : done + length]))
            done += length
        return from_planes(parts, n, self.planes)

    def documents(self) -> Iterator[tuple[int | None, int, list[np.ndarray]]]:
        """(doc_id, ids before it in this file, its ids in parts)."""
        k, block, used, before = 0, np.zeros(0, np.uint32), 0, 0
        for doc_id, n in zip(self.doc_ids, self.counts):
            parts, need = [], n
            while need:
                if used == len(block):
                    block, k, used = self.read_block(k), k + 1, 0
                part = block[used : used + need]
                parts.append(part)
                used += len(part)
                need -= len(part)
            yield doc_id, before, parts
            before += n


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, planes: str = "byte", text: str = "text", partitions: int | None = None) -> DataFrame:
    """Encode every text and write bit-plane files in ascending doc_id order below ``path``; returns the manifest.

    Documents are dealt to files by doc_id range; a null text is empty, and a null doc_id comes first. Each file is
    written under a name of its own and then renamed, so a task that runs twice leaves one whole file. ``end_id`` is
    appended to each document. The manifest has part, file, n_docs, n_ids and start, the ids in files before.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    end = end_id.to_bytes(4, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, fs, name, part = None, None, None, TaskContext.get().partitionId()
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, last in portions(texts, CHUNK_CHARS):
                if writer is None:
                    fs, base = pafs.FileSystem.from_uri(path)
                    fs.create_dir(base, recursive=True)
                    name = f"{base}/part-{part:06d}.bpz"
                    draft = f"{base}/.{uuid.uuid4().hex}.tmp"
                    writer = PlaneWriter(fs.open_output_stream(draft), planes)
                for doc_id, ids in zip(names[first:last], encoder(tokenizer).encode_all(texts[first:last])):
                    writer.add(doc_id, np.frombuffer(ids + end, dtype="<u4"))
        if writer is not None:
            writer.close()
            fs.move(draft, name)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "n_docs": [len(writer.docs)], "n_ids": [writer.total]})

    # the range partitioner needs a number; repartitioning by size keeps files near FILE_BYTES at any input size
    if partitions is None:
        total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        partitions = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // FILE_BYTES + 1)
    dealt = rows.repartitionByRange(partitions, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    manifest = materialise(dealt.mapInArrow(write, "part int, file string, n_docs long, n_ids long"), "token-manifest")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                with fs.open_input_file(name) as source:
                    for doc_id, before, parts in PlaneReader(source).documents():
                        crc = 0
                        for p in parts:
                            crc = zlib.crc32(p.astype("<u4").tobytes(), crc)
                        for k, v in zip(out, (doc_id, start + before, sum(map(len, parts)), crc)):
                            out[k].append(v)
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})

    files = manifest.repartitionByRange(max(1, min(manifest.count(), READ_TASKS)), "part").select("file", "start")
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenise_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, planes: str = "byte", path: str | None = None) -> DataFrame:
    """Write the token files of all documents and read them back; repeated doc_ids follow each other. An empty table writes no file and gives no rows. ``path`` is a folder that driver and executors share; without a file system's name it is on Hadoop's default one."""
    path = qualified(docs.sparkSession, path) if path else f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read_token_files(write_token_files(docs, tokenizer, path, end_id, planes), path)
