"""Token ids as binary output: byte-level BPE through the tokenizers library, Parquet list columns, selective reads."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.llm.common import map_texts, scratch_path, table

BYTE_BPE = "byte_bpe_50k.json"
END_ID = 2
#: Letters below this character are letters in every version of Unicode.
LATIN_END = "\u0250"
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on.
BYTE_CHARS = {b: b for b in _PLAIN} | {b: 256 + k for k, b in enumerate(sorted({*range(256)} - {*_PLAIN}))}
_ENCODERS: dict[str, "ChunkEncoder"] = {}


def vocabulary(name: str = BYTE_BPE) -> str:
    """Where a public tokenizer's file lies; it is read in place, on each executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _pairs(*pairs: tuple[int, int]) -> np.ndarray:
    out = np.zeros((256, 256), bool)
    for first, second in pairs:
        out[first, second] = True
    return out


_WHITE, _LETTERS = np.zeros(256, bool), np.zeros(256, bool)
_WHITE[[*range(9, 14), *range(28, 33)]] = True
_LETTERS[[*range(65, 91), *range(97, 123)]] = True
#: Two bytes that begin a character that is, or may be, white space; the second table takes the two bytes before a place.
_ODD = _pairs((0xC2, 0x85), (0xC2, 0xA0), (0xE1, 0x9A), (0xE1, 0xA0), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80))
_AFTER = _ODD | _WHITE[:, None]
_BEFORE = _ODD | _WHITE[None]
#: Two bytes that end with a letter: an ASCII one, or one of U+00C0 to U+00FF.
_ENDS_LETTER = _pairs(*[(0xC3, b) for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]) | _LETTERS[None]


class ChunkEncoder:
    """Encodes whole texts, remembering the ids of chunks that the byte-level pattern never joins.

    Texts are cut, in their bytes and all at once, where a piece of the pattern surely begins: at a space or around a line
    feed that stands between two characters other than white space, and at a mark or digit after a letter. So the ids of
    a text are those of its chunks in order. A batch's distinct chunks are looked up once each; those not seen yet are
    encoded together, and the chunks' own ids are found by the leading space, or by the line feed between them, that no
    other tokens have. A chunk of letters is one piece of the pattern, so these skip the pattern and go to the byte pairs
    alone. At most `limit` chunks and those of one batch are remembered, in two generations: when the younger one is full
    the older one is forgotten.
    """

    def __init__(self, path: str, limit: int = 400_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pairs = Tokenizer(self.tokenizer.model)  # the same model in memory, without the pattern
        vocab = self.tokenizer.get_vocab()
        self.starts = np.zeros(max(vocab.values()) + 1, bool)
        self.starts[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self.feeds = np.zeros(len(self.starts), bool)
        self.feeds[vocab[chr(BYTE_CHARS[10])]] = True
        added = {b for t in self.tokenizer.get_added_tokens_decoder().values() for b in t.content.encode()}
        self.stops = np.zeros(256, bool)
        self.stops[[b for b in range(33, 127) if not _LETTERS[b] and b not in added]] = True
        self.looked = self.stops.copy()
        self.looked[[10, 32]] = True
        self.limit, self.seen, self.older = limit, {}, {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _byte_pairs(self, lines: list[str]) -> list:
        return self.pairs.encode_batch_fast([t.encode().decode("latin-1").translate(BYTE_CHARS) for t in lines], add_special_tokens=False)

    def _learn(self, new: list[str]) -> None:
        spaced, bare, others, alone = [], [], [], []
        for c in new:
            core = c[1:] if c[:1] == " " else c
            if core.isalpha() and (core.isascii() or max(core) < LATIN_END):
                (bare if core is c else spaced).append(c)
            else:
                (others if core is not c and c.split() == [core] else alone).append(c)
        self._learn_lines(spaced, 100, "", self.starts, self._byte_pairs)
        self._learn_lines(bare, 100, "\n", self.feeds, self._byte_pairs)
        self._learn_lines(others, 20, "", self.starts, lambda x: self.tokenizer.encode_batch_fast(x, add_special_tokens=False))
        self.seen.update(zip(alone, self._ids(alone), strict=True))

    def _learn_lines(self, new: list[str], together: int, between: str, marks: np.ndarray, code: Callable) -> None:
        """Encodes lines of a few chunks each, joined by `between`; a token of `marks` begins a chunk, or stands between two. A line where others have one, too, is taken apart."""
        lines = [new[at : at + together] for at in range(0, len(new), together)]
        skip = len(between)
        for line, e in zip(lines, code([between.join(x) for x in lines]), strict=True):
            ids = np.array(e.ids, "<u4")
            cuts = np.flatnonzero(marks[ids])
            if len(cuts) == len(line) - skip and (skip or not cuts[0]):
                raw, begin = ids.tobytes(), 0
                for chunk, end in zip(line, [*(4 * cuts[1 - skip :]).tolist(), len(raw)], strict=True):
                    self.seen[chunk] = raw[begin:end]
                    begin = end + 4 * skip
            else:
                self.seen.update(zip(line, self._ids(line), strict=True))

    def _cuts(self, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Where chunks begin in the bytes of texts, their own beginnings (edges, with the end of the last) left out."""
        edge = np.zeros(len(data) + 2, bool)
        edge[edges] = True
        near = np.concatenate([np.full(3, 32, np.uint8), data, np.full(2, 32, np.uint8)])
        at = np.flatnonzero(self.looked[data])
        byte, one, two = near[at + 3], near[at + 2], near[at + 1]  # the byte, the one before it and the one before that
        blank = ~self.stops[byte]
        stop = at[~blank & _ENDS_LETTER[two, one] & ~edge[at]]
        at, one, two, byte = at[blank], one[blank], two[blank], byte[blank]
        apart = ~(edge[at] | edge[at + 1] | _BEFORE[two, one] | _ODD[near[at], two] | _AFTER[near[at + 4], near[np.minimum(at + 5, len(near) - 1)]])
        begins = np.zeros(len(data) + 1, bool)
        begins[stop] = begins[at[apart]] = begins[at[apart & (byte == 10)] + 1] = True
        return np.flatnonzero(begins)

    def encode_array(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, each text's followed by end_id if there is one, and where each text's begin, with the end of the last; a null text is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        edges = offsets - offsets[0]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        cuts = self._cuts(data, edges)
        before = np.searchsorted(cuts, edges)
        begin = np.append(np.insert(cuts, before[:-1], edges[:-1]), edges[-1])
        chunks = pa.LargeStringArray.from_buffers(len(begin) - 1, pa.py_buffer(begin), pa.py_buffer(data)).dictionary_encode()
        keys, codes = chunks.dictionary.to_pylist(), chunks.indices.to_numpy()
        if 2 * len(self.seen) > self.limit:
            self.older, self.seen = self.seen, {}
        fresh = [c for c in keys if c not in self.seen]
        known = [c for c in fresh if c in self.older]
        self.seen.update(zip(known, map(self.older.__getitem__, known), strict=True))
        self._learn([c for c in fresh if c not in self.older])
        own = list(map(self.seen.__getitem__, keys))
        first = before + np.arange(len(edges))
        if end_id is not None:
            codes = np.insert(codes, first[1:], len(own))
            own.append(np.array([end_id], "<u4").tobytes())
            first = first + np.arange(len(edges))
        taken = pa.array(own, pa.large_binary()).take(pa.array(codes))
        ends = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
        return np.frombuffer(taken.buffers()[2] or b"", "<u4"), ends[first] // 4

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        ids, at = self.encode_array(pa.array(texts, pa.string()))
        return [ids[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]


def encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def write_tokens(docs: DataFrame, path: str, tokenizer: str = BYTE_BPE, end_id: int = END_ID, row_group_bytes: int = 16 << 20, page_bytes: int = 128 << 10) -> None:
    """Writes doc_id, part, part_start, n_tokens and the list column tokens to `path`/tokens, in ascending doc_id order, and how many ids come before each file to `path`/starts.

    Files follow each other in doc_id order (range partitioned), each sorted. Token lists are dictionary coded, the
    ascending columns delta coded; row groups and pages are small enough, and carry column and page indexes, that a
    reader fetches some documents' tokens, or the lengths alone, without the rest. part_start counts the ids before a
    document in its own file, so the whole order's starts need only one number per file. Null texts are empty; null
    ids come first; rows that share an id are all kept, ordered by a hash of the text, and may fill several files.
    Texts of any length are encoded whole, other columns don't matter, and an empty table gives files without rows.
    """
    vocab = vocabulary(tokenizer)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            ids, at = encoder(vocab).encode_array(b.column(1), end_id)
            n = np.diff(at)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.view("<i4")))
            coded = pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(before + at[:-1]), pa.array(n), lists],
                ["doc_id", "part", "part_start", "n_tokens", "tokens"],
            )
            yield from slices(coded, 500)
            before += int(at[-1])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = texts.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})  # rows may share an id, and a text too
    ordered = ordered.repartitionByRange("doc_id", "h", "row").sortWithinPartitions("doc_id", "h")
    coded = map_texts(ordered.select("doc_id", "text"), encode, "doc_id long, part int, part_start long, n_tokens long, tokens array<int>")
    options = {"parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "parquet.enable.dictionary#tokens.list.element": "true", "parquet.dictionary.page.size": 1 << 20, "compression": "zstd"}
    coded.write.options(**{k: str(v) for k, v in options.items()}).parquet(f"{path}/tokens")
    per = docs.sparkSession.read.parquet(f"{path}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ahead = (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead")  # a row per file
    per.select("part", ahead).coalesce(1).write.parquet(f"{path}/starts")


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "tokens")) -> DataFrame:
    """Reads files of write_tokens; start is the number of ids of all documents before. Unused columns, and files and pages that a filter on doc_id rules out, aren't read."""
    files, starts = spark.read.parquet(f"{path}/tokens"), spark.read.parquet(f"{path}/starts")
    if "start" in columns:
        few = starts.count() < 1_000_000  # two numbers per file
        files = files.join(F.broadcast(starts) if few else starts, "part").withColumn("start", F.col("ahead") + F.col("part_start"))
    return files.select(*columns)


def id_checksums(tokens: DataFrame) -> DataFrame:
    """Per document: doc_id, start, n_tokens and the crc32 of its ids, from the read list column."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("tokens")
            ids, at = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False).view(np.uint8)), (4 * lists.offsets.to_numpy().astype(np.int64)).tolist()
            sums = [zlib.crc32(ids[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_texts(tokens, crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return id_checksums(read_tokens(spark, path))
