"""Packing token sequences by best-two-fit.

Documents longer than a sequence are cut into full pieces, with one shorter piece first; full pieces are sequences of
their own and are not packed any further. All other pieces (one a document at most) are dealt at random over blocks that
are large enough to pack as well as one (a block loses less than one sequence). In a block, a sequence is filled greedily with the largest piece that fits; what gap is left
is then tightened by putting two pieces that are not yet packed in the place of the sequence's smallest one.

Ids are those that ``tokenizers`` gives with byte_bpe_50k.json at its defaults: texts are split at its added tokens
(SPECIAL) first. With a rank file of one's own, no text is an added token unless ``special`` says so.

A null text is empty and still ends in the end token. Repeated rows are documents of their own. Other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
import threading
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlens.llm.common import give_back, table, utf8

#: Pieces that one task packs.
BLOCK = 20_000
#: Distinct words whose tokens a Python worker remembers.
REMEMBERED = 300_000
#: The added tokens of byte_bpe_50k.json and their ids; the rank file has none.
SPECIAL = {"<|endoftext|>": 50256}
#: Bytes of token ids that a batch holds.
HELD = 4 << 20
_local = threading.local()


class Tokens(dict):
    """Tokens of words as little-endian 32-bit ids, remembered. Ids equal those of the vocabulary's ``tokenizers`` file: at its defaults,
    if special holds its added tokens, else with encode_special_tokens set."""

    def __init__(self, ranks_file: str, special: dict[str, int] | None = None):
        import public_tokenizers
        import regex
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.words = regex.compile(public_tokenizers.PATTERN).findall
        self.special = {token: np.array([k], "<u4").tobytes() for token, k in (special or {}).items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if special else None
        self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, word: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        ids = np.array(self.encode(word), "<u4").tobytes()
        if len(word) < 64:
            self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        if self.split is None:
            return b"".join(map(self.__getitem__, self.words(text)))
        return b"".join(self.special[x] if k % 2 else b"".join(map(self.__getitem__, self.words(x))) for k, x in enumerate(self.split(text)))


def tokens(ranks_file: str | None = None, special: dict[str, int] | None = None) -> Tokens:
    if ranks_file is None:
        import public_tokenizers

        ranks_file, special = public_tokenizers.path("byte_bpe_50k.tiktoken"), SPECIAL if special is None else special
    found = getattr(_local, "tokens", None)
    if found is None or found[0] != (ranks_file, special):
        _local.tokens = found = ((ranks_file, special), Tokens(ranks_file, special))
    return found[1]


def pieces(docs: DataFrame, most: int = 2048, end_id: int = 0, ranks_file: str | None = None, keep_ids: bool = False, special: dict[str, int] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, as little-endian 32-bit values) of the pieces of every document."""

    def each(batches):
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            known = tokens(ranks_file, special)
            raw, offsets = utf8(batch.column(1))
            raw, rows, held = raw.tobytes(), [], 0
            for doc, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                ids = known.of(raw[a:b].decode()) + end
                n = len(ids) // 4
                cuts = [0, *range(n % most or most, n + 1, most)] if n > most else [0, n]
                view = memoryview(ids)
                rows += [(doc, k, x, y - x, zlib.crc32(view[4 * x : 4 * y]), ids[4 * x : 4 * y] if keep_ids else None) for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False))]
                held += len(ids) if keep_ids else 0
                if len(rows) > 20_000 or held > HELD:
                    yield _batch(rows)
                    rows, held = [], 0
            yield _batch(rows)
        give_back()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(each, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])


class _Stock:
    """How many pieces there are of each length; bits of one large integer tell which lengths are left."""

    def __init__(self, lengths: np.ndarray, most: int):
        self.count = np.bincount(lengths, minlength=most + 1).tolist()
        self.most, self.left = most, 0
        for n, k in enumerate(self.count):
            if k:
                self.left |= 1 << n

    def largest(self, n: int) -> int:
        """The largest length left of at most n, or 0."""
        return (self.left & ((2 << n) - 1)).bit_length() - 1 if n > 0 and self.left & ((2 << n) - 1) else 0

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            self.left ^= 1 << n

    def put(self, n: int) -> None:
        self.count[n] += 1
        self.left |= 1 << n

    def two(self, room: int, more_than: int) -> tuple[int, int] | None:
        """Two lengths left that fill room best and sum to more than more_than."""
        best, pair, a = more_than, None, self.largest(room - 1)
        while a and 2 * a > best:
            self.take(a)
            b = self.largest(min(a, room - a))
            self.put(a)
            if b and a + b > best:
                best, pair = a + b, (a, b)
                if best == room:
                    break
            a = self.largest(a - 1)
        return pair


def best_two_fit(lengths: np.ndarray, most: int) -> Iterator[list[int]]:
    """Lengths of the pieces of each sequence, largest first; every length of at most ``most`` is used as often as it occurs."""
    stock = _Stock(lengths, most)
    while stock.left:
        bin_, gap = [], most
        while n := stock.largest(gap):
            stock.take(n)
            bin_.append(n)
            gap -= n
        if gap and stock.left:
            smallest = bin_.pop()
            if pair := stock.two(gap + smallest, smallest):
                for n in pair:
                    stock.take(n)
                bin_ += pair
                stock.put(smallest)
            else:
                bin_.append(smallest)
        yield bin_


def pack_block(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of every piece."""
    order = np.argsort(lengths, kind="stable")
    next_of = np.searchsorted(lengths[order], np.arange(most + 2)).tolist()
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, bin_ in enumerate(best_two_fit(lengths, most)):
        at = 0
        for n in bin_:
            row = order[next_of[n]]
            next_of[n] += 1
            sequence[row], offset[row] = k, at
            at += n
    return sequence, offset


def pack_documents(docs: DataFrame, most: int = 2048, end_id: int = 0, ranks_file: str | None = None, keep_ids: bool = False, special: dict[str, int] | None = None, block: int | None = None) -> DataFrame:
    """pieces() with their sequence_id and offset. block: pieces that one task packs; with keep_ids it holds their ids, too."""
    block = block or BLOCK
    cut = pieces(docs, most, end_id, ranks_file, keep_ids, special)
    n_docs, size = docs.agg(F.count("*"), F.sum(F.octet_length(F.col("text").cast("string")))).first()
    # a document has one piece below the full length at most, and no more tokens than bytes and the end token
    n_blocks, n_full = -(-max(1, n_docs) // block), -(-max(1, (size or 0) + n_docs) // (most * block))
    # blocks are chosen by a hash of the whole row, so that no id can crowd one
    row = F.xxhash64("doc_id", "piece", "length", "ids_crc32")
    cut = cut.withColumn("block", F.when(F.col("length") == most, n_blocks + F.pmod(row, F.lit(n_full))).otherwise(F.pmod(row, F.lit(n_blocks))))

    def each(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        k = key[0].as_py()
        sequence, offset = pack_block(rows["length"].to_numpy(), most) if k < n_blocks else (np.arange(rows.num_rows), np.zeros(rows.num_rows, np.int64))
        give_back()
        return rows.drop_columns(["block"]).append_column("sequence_id", pa.array(sequence * (n_blocks + n_full) + k)).append_column("offset", pa.array(offset))

    return cut.groupBy("block").applyInArrow(each, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary, sequence_id bigint, offset bigint")


def op4_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).drop("ids")
