"""Packing documents into sequences by vector best-fit.

A sequence has three capacities: tokens, documents, and attention cost (the sum of squared lengths). Pieces
are taken by falling length; each goes into the open sequence that can hold it under every capacity and is
best by the weighted norm of what would be left of the capacities (or by the weighted dot product of what
the piece needs and what is left). Tasks pack blocks of pieces apart; the pieces of sequences that stay part-filled
are packed again together, in rounds, until they fit one block or no longer halve, so the number of sequences
doesn't depend on the blocks. The document and cost limits are the caller's: at their defaults, capacity documents
and capacity squared, only tokens bind, as a packing into the fewest sequences wants it.

Defined cases: a null or empty text is the end token alone; repeated rows are packed one by one; null ids
are kept; an empty table gives an empty table; other columns of the input are not looked at. A text of any
length is cut into full pieces and a rest.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ductus.llm.common import by_bytes, stored, text_or_empty

#: Pieces that a task packs together.
BLOCK = 16_384
#: A sequence with more than this share of its tokens free is packed again with those of other blocks.
REST = 1 / 64
#: Words, and pre-tokens, whose ids a worker process remembers from task to task. An executor comes to have more workers
#: than cores, each with its own.
REMEMBERED = 100_000
#: Marks for what was met once, by hash; a power of 2.
MARKS = 1 << 21


#: Of words in Latin-1, after lower-casing: what the vocabulary's pre-tokenizer makes of them. Such words are
#: in normal form already; their letters are a-z and those below, their numbers 0-9 and the five others.
PIECE = re.compile("[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\x09-\x0d\x20\x85\xa0a-z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\xff]+")
#: Words left to the tokenizer: characters beyond Latin-1, and what may be one of its special tokens.
OTHER = re.compile("[^\x00-\xff]|<\\|")


#: The model's characters for bytes, by the bytes' numbers: themselves if they show, else those from 256 on in order.
SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
SYMBOLS = {x: 256 + k for k, x in enumerate(sorted(set(range(256)) - SHOWN))}


class WordIds:
    """Ids of texts as little-endian 32-bit numbers, from the ids of their ASCII-space-separated words.

    No token spans white space in this vocabulary, so a text's ids are those of its words one after another; and
    a word's are those of its pre-tokens, which go to the tokenizer's model as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        ids = np.arange(max(self.tokenizer.get_vocab().values()) + 1, dtype="<u4").tobytes()
        self.bytes = [ids[i : i + 4] for i in range(0, len(ids), 4)]
        self.known: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.met = bytearray(MARKS)

    def again(self, x: bytes | str) -> bool:
        """Whether x was met before; now and then also of what shares its mark."""
        k = hash(x) & MARKS - 1
        before, self.met[k] = self.met[k], 1
        return before == 1

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of new words; what is met again is remembered while there is room. Most words are met once."""
        out, rest, get, piece = {}, [], self.pieces.get, self.encode_piece
        for w in words:
            t = w.decode()
            if "<|" in t if t.isascii() else OTHER.search(t):
                rest.append((w, t))
                continue
            t = t.lower()
            out[w] = (get(t) or piece(t)) if t.isalpha() else b"".join([get(p) or piece(p) for p in PIECE.findall(t)])
        for (w, _), e in zip(rest, self.tokenizer.encode_batch_fast([t for _, t in rest], add_special_tokens=False)):
            out[w] = np.array(e.ids, "<u4").tobytes()
        if len(self.known) < REMEMBERED:
            self.known.update(islice(((w, i) for w, i in out.items() if self.again(w)), REMEMBERED - len(self.known)))
        return out

    def encode_piece(self, piece: str) -> bytes:
        symbols = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(SYMBOLS)
        out = b"".join([self.bytes[x.id] for x in self.tokenize(symbols)])
        if len(self.pieces) < REMEMBERED and self.again(piece):
            self.pieces[piece] = out
        return out

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """The ids of some texts; what is new in them is learned at once."""
        words = [t.split() for t in texts]
        different = list(set().union(*words))
        ids = dict(zip(different, map(self.known.get, different)))
        new = [w for w, i in ids.items() if i is None]
        if new:
            ids.update(self.learn(new))
        return [b"".join(map(ids.__getitem__, ws)) for ws in words]

    def encode(self, text: bytes) -> bytes:
        return self.encode_all([text])[0]


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(path)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for low, size in by_bytes(texts, 1_000_000, 64):
                part = ids.encode_all(texts.slice(low, size).to_pylist())
                row, piece, start, length, crc, data = [], [], [], [], [], []
                for i, found in enumerate(part):
                    found += end
                    for k, at in enumerate(range(0, len(found), 4 * capacity)):
                        cut = found[at : at + 4 * capacity]
                        row.append(low + i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                        data.append(cut if with_ids else None)
                columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(data, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, 4 bytes each): documents cut only where they exceed the capacity."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return rows.mapInArrow(_pieces(path or tokenizer_path(), capacity, end_id, with_ids), schema)


def best_fit(lengths: np.ndarray, capacity: int, max_docs: int, max_attention: int, weights=(1.0, 0.02, 0.02), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of pieces given by falling length.

    rule: "norm" takes the least weighted norm of the residual after placing, "dot" the largest weighted dot
    product of need and residual; both in shares of the capacities.
    """
    n = len(lengths)
    of, at = np.zeros(n, np.int64), np.zeros(n, np.int64)
    tokens, docs, cost = np.zeros(n), np.zeros(n), np.zeros(n)
    name = np.zeros(n, np.int64)
    wt, wd, wa = weights[0] / capacity**2, weights[1] / max_docs**2, weights[2] / max_attention**2
    least, still, made = int(lengths[-1]) if n else 0, 0, 0
    for k, length in enumerate(lengths.tolist()):
        square = length * length
        i = -1
        if still:
            t, d, a = tokens[:still], docs[:still], cost[:still]
            fits = (t >= length) & (d >= 1) & (a >= square)
            if rule == "norm":
                score = wt * (t - length) ** 2 + wd * (d - 1) ** 2 + wa * (a - square) ** 2
            else:
                score = -(wt * length * t + wd * d + wa * square * a)
            score = np.where(fits, score, np.inf)
            i = int(score.argmin())
            if not fits[i]:
                i = -1
        if i < 0:
            i, still = still, still + 1
            tokens[i], docs[i], cost[i], name[i] = capacity, max_docs, max_attention, made
            made += 1
        of[k], at[k] = name[i], capacity - int(tokens[i])
        tokens[i] -= length
        docs[i] -= 1
        cost[i] -= square
        if tokens[i] < least or docs[i] < 1 or cost[i] < least * least:  # nothing fits any more
            still -= 1
            for x in (tokens, docs, cost, name):
                x[i] = x[still]
    return of, at


def _pack(round_: int, block: int, capacity: int, max_docs: int, max_attention: int, weights, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made, held, n = round_ << 56 | TaskContext.get().partitionId() << 32, [], 0

        def packed() -> pa.RecordBatch:
            nonlocal made
            table = pa.Table.from_batches(held).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]).combine_chunks()
            lengths = table["length"].to_numpy()
            of, at = best_fit(lengths, capacity, max_docs, max_attention, weights, rule)
            part_filled = np.bincount(of, lengths) < capacity * (1 - REST)
            names = pa.array(of + made)
            made += int(of.max()) + 1
            return table.append_column("sequence_id", names).append_column("offset", pa.array(at)).append_column("open", pa.array(part_filled[of])).to_batches()[0]

        for batch in batches:
            low = 0
            while low < len(batch):
                held.append(batch.slice(low, block - n))
                low += len(held[-1])
                n += len(held[-1])
                if n == block:
                    yield packed()
                    held, n = [], 0
        if n:
            yield packed()

    return run


def pack(cut: DataFrame, capacity: int = 4096, max_docs: int | None = None, max_attention: int | None = None, weights=(1.0, 0.02, 0.02), rule: str = "norm", block: int = BLOCK) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces that is stored; pieces are dealt evenly, whatever their keys."""
    columns = ", ".join(f"{c.name} {c.dataType.simpleString()}" for c in cut.schema)
    limits = (capacity, max_docs or capacity, max_attention or capacity * capacity, weights, rule)
    n, rest, done = cut.count(), cut, []
    for round_ in range(64):
        blocks = max(1, -(-n // block))
        packed = stored(rest.repartition(blocks).mapInArrow(_pack(round_, block, *limits), f"{columns}, sequence_id long, offset long, open boolean"))
        left = packed.filter("open").count() if blocks > 1 else 0
        again = 0 < left <= n // 2
        done.append((packed.filter("NOT open") if again else packed).drop("open"))
        if not again:
            break
        n, rest = left, packed.filter("open").select(*cut.columns)
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out


def packed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, **options) -> DataFrame:
    return pack(stored(pieces(df, id_col, text_col, capacity), texts=True), capacity, **options)


def op7_vector_best_fit(spark, sf_dir: str) -> DataFrame:
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
