"""Best-fit packing: documents into sequences of at most ``LENGTH`` tokens.

A document is its ids in a public byte-level vocabulary, then ``END``. A longer one is cut into full
sequences, of which the first piece may be shorter; a full piece is a sequence of its own. The others
are packed by bounded-space online best-fit: a piece goes to the open bin with the least free space
that holds it. Open bins are keyed by their free space, and a bitset of these keys gives the best bin
by a shift and a lowest bit. At most ``OPEN_BINS`` are open; when a bin has to be opened beyond that,
the fullest one closes first.

The stream is dealt into buckets of about ``BUCKET`` pieces by a hash of the piece's own number, and
each bucket is packed by itself, so the work spreads and a bucket leaves at most one poor sequence or
two behind. Within a bucket the pieces come in rounds of about ``ROUND``, the longest of a round
first, so that small pieces fill what large ones leave; the open bins go from round to round. What is
shuffled is one slim row for each piece, never ids or texts.

Ids are those of ``tokenizers``, which needs some 0.7 microseconds for a character. So texts are cut at
places where a piece of the vocabulary cannot reach across (between a letter and white space or a
common mark), and the ids of up to ``CACHE`` such cuts are kept in a table of each worker. A new cut is
encoded by ``tiktoken`` with ranks read from the same file, a third of the library's time for so short a
string; a file whose ids do not follow its merges goes without. Texts with white space other than
blanks, tabs and line ends, or with a special token's text, go to ``tokenizers`` whole. Tests hold all
of these against ``tokenizers`` on whole texts.

Defined results: a null text is empty and has the one id ``END``; rows that repeat and rows with a
null id are packed each by itself; extra columns are ignored, whatever their names; a text of any
length is encoded whole; an empty table gives an empty result. A rerun gives the same sequences.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from florilege.llm.scratch import Scratch

VOCABULARY = "byte_bpe_50k.json"
LENGTH = 2048
END = 0
OPEN_BINS = 8192
BUCKET = 65_536
ROUND = 8192
#: Cuts of text whose ids a worker keeps.
CACHE = 1_000_000
#: Bytes of ids in one batch of pieces.
FLUSH = 4_000_000

_ODD_SPACE = re.compile(r"[^\S \n\t]")
#: Letters up to white space, a common mark or the end; or all up to white space; or white space.
_CUT = re.compile(r"[ \n\t]*[A-Za-zÀ-ÖØ-öø-ɏ]+(?![^.,;:!?\s])|[ \n\t]*[^ \n\t]+|[ \n\t]+")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _ranks(vocabulary: str) -> dict[bytes, int] | None:
    """The ranks of a byte-level vocabulary's merges by the bytes of what they give; None where ids do not
    follow merges."""
    with open(vocabulary, encoding="utf-8") as file:
        model = json.load(file)["model"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if [model["vocab"].get("".join(m)) for m in pairs] != list(range(256, 256 + len(pairs))):
        return None
    # bytes that do not print stand in such files as the characters from 256 on, in order
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in prints)}
    return {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if i < 256 + len(pairs)}


class _Known(dict):
    """Ids of cuts; a new one is encoded when it is first asked for."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, cut: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = self[cut] = array("I", self.encode(cut)).tobytes()
        return ids


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = _ranks(vocabulary)
        short = self._library if ranks is None else tiktoken.Encoding("cuts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known = _Known(short)

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        end = array("I", [END]).tobytes()
        for text in texts:
            if _ODD_SPACE.search(text) or any(s in text for s in self.special):
                yield array("I", self._library(text)).tobytes() + end
            else:
                yield b"".join(map(self.known.__getitem__, _CUT.findall(text))) + end


def _cut(vocabulary: str | None, length: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary or vocabulary_path())
        for batch in batches:
            rows, held = ([], [], [], [], []), 0
            source: list[int] = []
            for i, ids in enumerate(encoder.encode([t or "" for t in batch.column(2).to_pylist()])):
                n = len(ids) // 4
                begin, piece, size = 0, 0, (n - 1) % length + 1
                while begin < n:
                    source.append(i)
                    for column, value in zip(rows, (piece, begin, size, ids[4 * begin : 4 * (begin + size)]), strict=False):
                        column.append(value)
                    begin, piece, size = begin + size, piece + 1, length
                    held += 4 * size
                    if held >= FLUSH:
                        yield _pieces(batch, source, rows, schema)
                        rows, held, source = ([], [], [], [], []), 0, []
            yield _pieces(batch, source, rows, schema)

    return run


def _pieces(batch: pa.RecordBatch, source: list[int], rows: tuple[list, ...], schema: pa.Schema) -> pa.RecordBatch:
    keys = [batch.column(k).take(pa.array(source, pa.int64())) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([*keys, *[pa.array(v, schema.field(k + 2).type) for k, v in enumerate(rows[:4])]], schema.names)


def pieces(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH) -> DataFrame:
    """``_row, doc_id, piece, start, length, ids`` of each piece; ``_row`` numbers the rows of ``docs``,
    ``ids`` are little-endian unsigned 32-bit numbers.

    ``vocabulary``: a file of the ``tokenizers`` library that every executor has; by default the public
    one. Row numbers hold for one run, so write the result before it is used twice.
    """
    schema = StructType([StructField("_row", LongType()), StructField("doc_id", docs.schema["doc_id"].dataType), StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()), StructField("ids", BinaryType())])
    arrow = pa.schema([("_row", pa.int64()), ("doc_id", pa.null()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
    return docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text").mapInArrow(_cut(vocabulary, length, arrow), schema)


class Bins:
    """Open bins of one bucket."""

    def __init__(self, length: int, most: int):
        self.length, self.most, self.open, self.made, self.keys = length, most, 0, 0, 0
        self.by_space: list[list[int]] = [[] for _ in range(length)]

    def _take(self, space: int) -> int:
        bins = self.by_space[space]
        number = bins.pop()
        if not bins:
            self.keys &= ~(1 << space)
        self.open -= 1
        return number

    def place(self, size: int) -> tuple[int, int]:
        """The number of the bin that takes ``size``, and the place in it."""
        fits = self.keys >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            if self.open == self.most:
                self._take((self.keys & -self.keys).bit_length() - 1)  # the fullest closes
            space, number = self.length, self.made
            self.made += 1
        left = space - size
        if left:
            self.by_space[left].append(number)
            self.keys |= 1 << left
            self.open += 1
        return number, self.length - space


def _pack(length: int, most: int, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, bins = None, None
        for batch in batches:
            sequence, offset = [], []
            for b, size in zip(batch.column("_bucket").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if b != bucket:
                    bucket, bins = b, Bins(length, most)
                number, place = bins.place(size)
                sequence.append(bucket << 40 | number)
                offset.append(place)
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*columns, "sequence_id", "offset"])

    return run


def place(cut: DataFrame, length: int = LENGTH, most: int = OPEN_BINS) -> DataFrame:
    """``cut``, a written table with ``_row, piece, length`` and whatever goes along, plus ``sequence_id``
    and ``offset``. Sequences of one full piece have negative numbers."""
    short = cut.where(F.col("length") < length)
    buckets = max(1, -(-short.count() // BUCKET))
    schema = StructType([*cut.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    drawn = F.xxhash64("_row", "piece")
    dealt = short.withColumns({"_bucket": F.pmod(drawn, F.lit(buckets)), "_round": F.pmod(F.shiftright(drawn, 24), F.lit(BUCKET // ROUND))})
    sorted_ = dealt.repartition(buckets, "_bucket").sortWithinPartitions("_bucket", "_round", F.desc("length"), "_row", "piece")
    packed = sorted_.mapInArrow(_pack(length, most, cut.columns), schema)
    full = cut.where(F.col("length") >= length).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(full)


def pack(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH) -> DataFrame:
    """``sequence_id, ids``: the packed sequences themselves, as little-endian unsigned 32-bit numbers.

    A group is one sequence, so it has at most ``length`` pieces.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    placed = place(scratch.write_texts(pieces(docs, vocabulary, length), "pieces"), length)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(F.col("parts"), F.lit(b""), lambda have, part: F.concat(have, part["ids"]))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", joined.alias("ids"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each piece of all ``documents`` with its place."""
    scratch = Scratch(spark, "packing")
    cut = pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    placed = place(scratch.write_texts(cut, "pieces"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
