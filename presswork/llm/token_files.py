"""Token-id files of independent zstandard frames with a trailing seek table.

File layout, little-endian: one zstandard frame for each document (its ids as
unsigned 32-bit integers); one skippable frame with the index (for each frame the
document's id); and the seek table of the public seekable zstandard format: a
skippable frame with compressed size, decompressed size and checksum (the low 32
bits of XXH64 of the decompressed bytes) for each frame, and a footer with the
number of frames. A reader fetches the tail, finds a document's frame in it, and
reads and decompresses that frame only. Any zstandard tool reads the whole file,
as skippable frames hold no data.
"""

from __future__ import annotations

import io
import itertools
import struct
import zlib
from collections.abc import Iterable, Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presswork.llm.common import checkpoint_dir, id_back, id_key, settled, text_of
from presswork.llm.tokens import encoder

#: Fixed values of the public seekable zstandard format, and the skippable magic number used for the index.
SEEK_MAGIC, SEEK_FOOTER, INDEX_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
CHECKSUMS = 0x80
ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])


def write_frames(out: io.RawIOBase, documents: Iterable[tuple[int, np.ndarray]], level: int = 3) -> tuple[list[int], list[int]]:
    """Writes one file of (id, ids); returns the ids of the documents and their numbers of tokens."""
    names, counts, table = [], [], []
    pack = zstandard.ZstdCompressor(level=level, write_checksum=True).compress
    for name, ids in documents:
        raw = ids.astype("<u4").tobytes()
        frame = pack(raw)
        out.write(frame)
        names.append(name)
        counts.append(len(ids))
        table.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
    index = np.array(names, "<i8").tobytes()
    out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
    entries = np.array(table, ENTRY).tobytes()
    out.write(struct.pack("<II", SEEK_MAGIC, len(entries) + 9) + entries + struct.pack("<IBI", len(table), CHECKSUMS, SEEK_FOOTER))
    return names, counts


class FrameReader:
    """Reads single documents of a file: ``tail`` once, then only the frames asked for."""

    def __init__(self, source, size: int) -> None:
        self.source = source
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_FOOTER or not flags & CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        tail = 8 + n * ENTRY.itemsize + 9
        source.seek(size - tail - 8 * n - 8)
        found = source.read(8 * n + 8 + tail - 9)
        magics = struct.unpack_from("<I", found)[0], struct.unpack_from("<I", found, 8 + 8 * n)[0]
        if magics != (INDEX_MAGIC, SEEK_MAGIC):
            raise ValueError("the index or the seek table is damaged")
        self.names = np.frombuffer(found, "<i8", n, 8)
        self.entries = np.frombuffer(found, ENTRY, n, 16 + 8 * n)
        self.at = np.concatenate(([0], np.cumsum(self.entries["packed"].astype(np.int64))))
        self._plain = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> np.ndarray:
        """The ids of the k-th document; ValueError if its checksum doesn't hold."""
        self.source.seek(int(self.at[k]))
        raw = self._plain.decompress(self.source.read(int(self.entries["packed"][k])), max_output_size=int(self.entries["plain"][k]) or 1)
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.entries["check"][k]:
            raise ValueError(f"frame {k} does not match its checksum")
        return np.frombuffer(raw, "<u4")

    def documents(self, name: int) -> list[np.ndarray]:
        """The ids of every document of that id."""
        return [self.frame(int(k)) for k in np.flatnonzero(self.names == name)]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, files: int | None = None, level: int = 3, file_bytes: int = 128 << 20) -> DataFrame:
    """Writes the ids of all documents in ascending doc_id order and returns the manifest: (part, path, n_docs, n_tokens).

    ``folder`` is a URI that every executor reaches. A task writes its file under a name of its own
    attempt and renames it when it is whole, so a lost or repeated task leaves one whole file. The number of files
    follows the bytes of the texts (``file_bytes`` each; the session's shuffle partitions at least), unless ``files`` says it,
    so that neither a task nor a file's index grows with the corpus. Null texts are empty and have the end id alone; null ids
    come first; rows of one id stand in the order of a hash of their text, and may lie in several files. An empty table
    writes no file and has an empty manifest.
    """
    spark = docs.sparkSession
    rows = docs.select(id_key().alias("doc_id"), text_of().alias("text"))
    n = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // file_bytes))
    ordered = rows.repartitionByRange(n, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batches = (b for b in batches if len(b))
        first = next(batches, None)
        if first is None:
            return
        task = TaskContext.get()
        part = task.partitionId()
        store, base = fs.FileSystem.from_uri(folder)
        path = f"{base}/part-{part:06d}.zst"
        store.create_dir(base)
        ids_of, end = encoder(tokenizer).ids_of, np.array([end_id], "<u4")

        def documents() -> Iterator[tuple[int, np.ndarray]]:
            for b in itertools.chain([first], batches):
                for doc_id, ids in zip(b["doc_id"].tolist(), ids_of(b["text"].tolist())):
                    yield doc_id, np.concatenate((ids, end))

        own = f"{base}/.part-{part:06d}-{task.taskAttemptId()}"
        with store.open_output_stream(own) as out:
            _, counts = write_frames(out, documents(), level)
        # A repeated task finds the whole file of the one before it, with the same bytes: not every store renames over a file.
        if store.get_file_info(path).type == fs.FileType.NotFound:
            store.move(own, path)
        else:
            store.delete_file(own)
        yield pd.DataFrame({"part": [part], "path": [path], "n_docs": [len(counts)], "n_tokens": [sum(counts)]})

    return settled(ordered.mapInPandas(run, "part long, path string, n_docs long, n_tokens long"))


def read_token_files(manifest: DataFrame, folder: str, wanted: list[int] | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of the files' documents, or of the ``wanted`` ids only.

    ``start`` counts the ids of all documents before; sums run over the manifest's rows, one a file. A null id is read back as
    null; an empty manifest gives an empty result. A task has some thousand documents of a file at a time.
    """
    before = F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")
    listed = manifest.select("part", "path", before.alias("base"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path, base in zip(b["path"].tolist(), b["base"].tolist()):
                with store.open_input_file(path) as source:
                    reader = FrameReader(source, source.size())
                    counts = reader.entries["plain"].astype(np.int64) // 4
                    starts = base + np.cumsum(counts) - counts
                    names = reader.names.tolist()
                    keep = range(len(names)) if wanted is None else np.flatnonzero(np.isin(reader.names, wanted)).tolist()
                    for at in range(0, len(keep), 1000):
                        found = [(names[k], int(starts[k]), int(counts[k]), zlib.crc32(ids.tobytes()), *([ids.astype(np.int64)] if with_ids else [])) for k in keep[at : at + 1000] for ids in (reader.frame(k),)]
                        yield pd.DataFrame(found, columns=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    spread = listed.repartition(max(1, min(20_000, manifest.count())), "part")
    return spread.mapInPandas(run, schema).withColumn("doc_id", id_back())


def round_trip(docs: DataFrame, folder: str | None = None, **parameters) -> DataFrame:
    """Writes ``docs`` (null text: empty) to files and reads them back whole.

    Null ids come first; rows of one id stand in the order of a hash of their text. Without rows there are no files.
    """
    folder = folder or f"{checkpoint_dir(docs.sparkSession).rstrip('/')}/token_files/{uuid4().hex}"
    if "://" not in folder:
        folder = "file://" + folder
    return read_token_files(write_token_files(docs, folder, **parameters), folder)
