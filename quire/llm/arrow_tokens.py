"""Token-ID output: Arrow IPC files with fixed-size-list batches.

A file holds one column of equal-length sequences and one of masks, in uncompressed record batches, so that any sequence is a
slice of a memory-mapped buffer. The ids of all documents run on through the sequences of a file; only its last sequence is
padded (mask false). Beside each file lies an index of its documents: doc_id, start within the file, n_tokens. Files follow
one another in ascending doc_id order and hold whole documents.

Spark deals the texts out by ranges of doc_id, as many as their bytes ask for; each task sorts, encodes and writes one file under a
name of its own attempt and then moves it into place, so a lost executor or a second attempt leaves one whole file. Rows alike
in id and text are told apart by where they come from, so many of them fill several files. Folders are reached by URI.

Edge cases: null and empty texts have only the end id; a null doc_id comes first; equal doc_ids lie side by side, by text;
an empty table gives no documents; one document may be longer than a sequence, a batch or a block; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fresh_path, held
from quire.llm.words import WordTable, in_blocks, oddly_spaced

SEQUENCE = 2048
SEQUENCES = 256  # of a record batch
FILE_BYTES = 4 << 20, 128 << 20  # text of a file: at least where there is that much, at most but for one longer document
FILES_A_CORE = 8  # between those bounds
CACHE = 1_000_000  # words that a worker remembers, some 40 bytes each
BLOCK_BYTES = 4_000_000  # of the texts that are encoded together


#: Letters after which marks surely begin a piece of the pre-tokenizer, and marks that are one piece up to white space.
LETTERS = frozenset(chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0x250)] if c not in (0xD7, 0xF7))
MARKS = ".,;:!?|*#%&$"


class Encoder:
    """Encodes with the tokenizers library, each different word of a block of texts once.

    A text that has only single spaces and line feeds between its words splits there without changing its ids: white space
    ends a piece of the pre-tokenizer, one space belongs to the word after it, one line feed is a piece of its own. All other
    texts, and those with an added token's string, are encoded as a whole. A block's texts are cut and their words numbered by
    Arrow; the ids come by number from one table of all words met. New words are encoded many to a call, a space before each; a
    token that begins with a space then begins a word.

    In the table a word after a space stands as it is, the first word of a text after a carriage return, and the first word of
    another line after a line feed, whose id is then the first.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        space = self.tokenizer.encode(" ", add_special_tokens=False).tokens[0]
        self.begins = np.zeros(1 << 16 if self.kind is np.uint16 else size, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.begins[i] = token.startswith(space)
        self.line = self._encode(["\n"])[0]
        self.table = WordTable(1, CACHE)

    def _encode(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=self.kind).tobytes() for x in got]

    def _spaced(self, words: list[str]) -> list[bytes]:
        """Ids of each word (without white space) after a space."""
        out, width = [], self.kind().itemsize
        for at in range(0, len(words), 2000):
            raw = np.frombuffer(self._encode([" " + " ".join(words[at : at + 2000])])[0], self.kind)
            cuts = (np.flatnonzero(self.begins[raw]) * width).tolist()
            flat = raw.tobytes()
            out += [flat[lo:hi] for lo, hi in zip(cuts, [*cuts[1:], len(flat)], strict=True)]
        return out

    def _whole(self, words: list[str]) -> list[bytes]:
        """Ids of words as they stand in the table, by the library."""
        inner = [k for k, w in enumerate(words) if w[0] not in "\r\n"]
        heads = [k for k, w in enumerate(words) if w[0] in "\r\n"]
        out: list = [b""] * len(words)
        for k, ids in zip(inner, self._spaced([words[k] for k in inner]), strict=True):
            out[k] = ids
        for k, ids in zip(heads, self._encode([words[k][1:] for k in heads]), strict=True):
            out[k] = self.line + ids if words[k][0] == "\n" else ids
        return out

    def _learn(self, words: list[str]) -> list[list[bytes]]:
        parts = []  # core, marks
        for w in words:
            core = w.rstrip(MARKS)
            parts.append((core, w[len(core) :]) if len(core) != len(w) and core and core[-1] in LETTERS else (w, ""))
        cores, marks = ([*{p[k] for p in parts}] for k in (0, 1))
        head, tail = (dict(zip(some, ids, strict=True)) for some, ids in ((cores, self._whole(cores)), (marks, self._encode(marks))))
        return [[head[c] + tail[m] for c, m in parts]]

    def blocks(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, as bytes of self.kind."""
        for block in in_blocks(texts.fill_null(""), BLOCK_BYTES):
            odd = oddly_spaced(block)
            for a in self.added:
                odd |= pc.match_substring(block, a).to_numpy(zero_copy_only=False)
            out = [b""] * len(block)
            for k in np.flatnonzero(odd).tolist():
                out[k] = self._encode([block[k].as_py()])[0]
            even = np.flatnonzero(~odd & (pc.binary_length(block).to_numpy() > 0))
            if len(even):
                marked = pc.binary_join_element_wise("", pc.replace_substring(block.take(pa.array(even)), "\n", " \n"), "\r")
                for k, ids in zip(even.tolist(), self.table.joined(marked, self._learn)[0], strict=True):
                    out[k] = ids
            yield from out


def encoder(path: str) -> Encoder:
    """This worker's encoder of the file."""
    return held(("tokens", path), lambda: Encoder(path))


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pyarrow.fs.LocalFileSystem(), uri)


class SequenceWriter:
    """Cuts a run of ids into sequences and writes them batch by batch."""

    def __init__(self, sink, kind, sequence: int, sequences: int):
        self.kind, self.sequence, self.size = np.dtype(kind), sequence, sequence * sequences
        ids = pa.list_(pa.from_numpy_dtype(self.kind), sequence)
        self.schema = pa.schema([("input_ids", ids), ("mask", pa.list_(pa.bool_(), sequence))])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.held, self.n, self.total = [], 0, 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.n += len(ids) // self.kind.itemsize
        self.total += len(ids) // self.kind.itemsize
        if self.n >= self.size:
            flat = np.frombuffer(b"".join(self.held), self.kind)
            whole = self.n // self.size * self.size
            for k in range(0, whole, self.size):
                self._batch(flat[k : k + self.size], self.size)
            self.held, self.n = [flat[whole:].tobytes()], self.n - whole

    def _batch(self, flat: np.ndarray, real: int) -> None:
        mask = pa.array(np.arange(len(flat)) < real)
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(flat), self.sequence), pa.FixedSizeListArray.from_arrays(mask, self.sequence)]
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.n:
            flat = np.zeros(-(-self.n // self.sequence) * self.sequence, self.kind)
            flat[: self.n] = np.frombuffer(b"".join(self.held), self.kind)
            self._batch(flat, self.n)
        self.out.close()


def file_count(docs: DataFrame) -> int:
    """By the bytes of the texts: a task's work has the same bound at every size."""
    n = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least, most = FILE_BYTES
    return max(1, -(-n // max(least, min(most, n // (FILES_A_CORE * docs.sparkSession.sparkContext.defaultParallelism)))))


def write(docs: DataFrame, uri: str, path: str, end_id: int, sequence: int = SEQUENCE, sequences: int = SEQUENCES, files: int | None = None) -> list[tuple[int, int, int]]:
    """Writes the files; returns (file, documents, ids) of each that isn't empty, in order: one small row a file."""
    files = files or file_count(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, where, (fs, root) = encoder(path), TaskContext.get(), file_system(uri)
        part, attempt = where.partitionId(), where.taskAttemptId()
        names = [f"{root}/part-{part:06d}.{x}" for x in ("arrow", "docs")]
        sink, out, docs_out, at = None, None, None, 0
        end = np.array([end_id], own.kind).tobytes()
        kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(root, recursive=True)
                sink = [fs.open_output_stream(f"{n}.{attempt}") for n in names]
                out, docs_out = SequenceWriter(sink[0], own.kind, sequence, sequences), pa.ipc.new_file(sink[1], kind)
            starts, sizes = [], []
            for ids in own.blocks(batch.column(1)):
                out.add(ids + end)
                starts.append(at)
                sizes.append(len(ids) // len(end) + 1)
                at += sizes[-1]
            docs_out.write_batch(pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=kind))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([len(sizes)], pa.int64()), pa.array([sum(sizes)], pa.int64())], names=["file", "n_docs", "n_ids"])
        if out is not None:
            out.close()
            docs_out.close()
            for s, n in zip(sink, names, strict=True):
                s.close()
                fs.move(f"{n}.{attempt}", n)

    text = F.col("text")
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("place"))
    sorted_ = placed.repartitionByRange(files, "doc_id", "h", "place").sortWithinPartitions("doc_id", "h", "place")
    told = sorted_.select("doc_id", "text").mapInArrow(run, "file long, n_docs long, n_ids long").groupBy("file").agg(F.sum("n_docs"), F.sum("n_ids"))
    return sorted((r[0], r[1], r[2]) for r in told.collect())


def read(spark, uri: str, files: list[tuple[int, int, int]]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), from the files."""
    before, rows = 0, []
    for file, _, n in files:
        rows.append((file, before))
        before += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(uri)
        local = isinstance(fs, pyarrow.fs.LocalFileSystem)
        for given in batches:
            for file, base in zip(*(c.to_pylist() for c in given.columns), strict=True):
                name = f"{root}/part-{file:06d}"
                with fs.open_input_file(f"{name}.docs") as f:
                    index = pa.ipc.open_file(f).read_all()
                source = pa.memory_map(f"{name}.arrow") if local else fs.open_input_file(f"{name}.arrow")
                with source:
                    sums = checksums(pa.ipc.open_file(source), index.column("n_tokens").to_numpy())
                start = pa.array(index.column("start").to_numpy() + base)
                table = pa.table([index.column("doc_id"), start, index.column("n_tokens"), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                yield from table.combine_chunks().to_batches(max_chunksize=50_000)

    given = spark.createDataFrame(rows or [(0, 0)], "file long, base long").filter(F.lit(bool(rows)))
    dealt = given.repartition(max(1, len(rows)))
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def checksums(file: pa.ipc.RecordBatchFileReader, sizes: np.ndarray) -> list[int]:
    """CRC-32 of each document's ids; the documents follow one another through the file's sequences."""
    out, k, left, crc = [], 0, int(sizes[0]) if len(sizes) else 0, 0
    for b in range(file.num_record_batches):
        column = file.get_batch(b).column(0)
        flat = column.flatten().to_numpy(zero_copy_only=True)
        at = 0
        while k < len(sizes) and at < len(flat):
            take = min(left, len(flat) - at)
            crc = zlib.crc32(flat[at : at + take].astype("<u4").data, crc)
            at, left = at + take, left - take
            if not left:
                out.append(crc)
                k, crc = k + 1, 0
                left = int(sizes[k]) if k < len(sizes) else 0
    return out


def sequence_at(file: pa.ipc.RecordBatchFileReader, nth: int, sequences: int = SEQUENCES) -> tuple[np.ndarray, np.ndarray]:
    """The nth sequence of an open file (a view of its buffer) and its mask."""
    batch = file.get_batch(nth // sequences)
    ids, mask = (batch.column(c)[nth % sequences].values for c in (0, 1))
    return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)


def round_trip(docs: DataFrame, path: str, end_id: int, **how) -> DataFrame:
    """Writes the files into the shared folder and reads them back."""
    uri = fresh_path(docs.sparkSession, "tokens")
    return read(docs.sparkSession, uri, write(docs, uri, path, end_id, **how))
