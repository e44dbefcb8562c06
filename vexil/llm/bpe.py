"""BPE encoding and decoding through a table of distinct words.

Documents are dealt into blocks of about ``block_mb`` MB of text by a hash of
their content.  Each block gives its distinct words; these meet by a hash of the
word, where each distinct word of the corpus is encoded once, and the ids go
back to the blocks that asked.  In its block a document is its words' ids by
position.  What is shuffled (texts, words, ids) travels as compressed fragments
of a task's output for one receiver.
Decoding joins each of a document's ids with the table of the vocabulary's pieces,
which every task holds (its size is the tokenizer's, whatever the corpus), by the
id's position there.

The documents are shuffled once: both the words and the final step read the same
exchange.  No table of words is broadcast or collected.

Defined results: a null text counts as empty and has no tokens; a null or
repeated id keeps its row; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexil.llm._tokens import remembering


def _packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unpacked(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, doc_id, text) to (block, blob): the rows of a batch for one block, as compressed Arrow."""
    for batch in batches:
        blocks = batch.column(0).to_numpy()
        order = np.argsort(blocks, kind="stable")
        rows = batch.select([1, 2]).take(pa.array(order))
        which, starts = np.unique(blocks[order], return_index=True)
        blobs = []
        for start, end in zip(starts, [*starts[1:], len(blocks)]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                # take, not slice: a slice would carry its neighbours' bytes
                out.write_batch(rows.take(pa.array(np.arange(start, end))))
            blobs.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(blobs, pa.binary())], ["block", "blob"])


def _documents(blobs: pa.ChunkedArray) -> Iterator[tuple[int | None, bytes]]:
    for blob in blobs:
        with pa.ipc.open_stream(blob.as_buffer()) as rows:
            for batch in rows:
                for name, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                    yield name, text.as_buffer().to_pybytes()


def _by_part(words: Iterable[bytes], parts: int) -> list[list[bytes]]:
    """Distinct words, sorted, by the hash that tells where they are encoded."""
    out: list[list[bytes]] = [[] for _ in range(parts)]
    for word in sorted(words):
        out[zlib.crc32(word) % parts].append(word)
    return out


def _distinct_words(path: str, parts: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table) -> pa.Table:
        split, seen = remembering(path).encoder.split_words, set()
        for _, text in _documents(docs.column("blob")):
            seen.update(split(text))
        found = _by_part(seen, parts)
        some = [p for p in range(parts) if found[p]]
        return pa.table(
            {
                "block": pa.array(np.full(len(some), key[0].as_py(), np.int32)),
                "part": pa.array(some, pa.int32()),
                "words": pa.array([_packed(b"\n".join(found[p])) for p in some], pa.binary()),
            }
        )

    return run


def _encode_part(path: str):
    """All words of one part: each distinct one is encoded once, and every block gets the ids of those it asked for."""

    def run(key: tuple[pa.Scalar, ...], asked: pa.Table) -> pa.Table:
        lists = [_unpacked(w.as_buffer().to_pybytes()).split(b"\n") for w in asked.column("words")]
        distinct = sorted(set().union(*lists))
        table = dict(zip(distinct, remembering(path).encoder.encode(distinct)))
        answers = []
        for words in lists:
            ids = list(map(table.__getitem__, words))
            sizes = np.fromiter(map(len, ids), np.uint32, len(ids))
            flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            # bytes of like weight together compress best
            planes = lambda x: x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
            answers.append(_packed(len(sizes).to_bytes(8, "little") + planes(sizes) + planes(flat)))
        return pa.table({"block": asked.column("block"), "part": asked.column("part"), "answer": pa.array(answers, pa.binary())})

    return run


def _answer(blob: bytes) -> list[np.ndarray]:
    data = _unpacked(blob)
    n = int.from_bytes(data[:8], "little")
    joined = lambda b: np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").ravel()
    sizes, flat = joined(data[8 : 8 + 4 * n]), joined(data[8 + 4 * n :])
    return np.split(flat, np.cumsum(sizes.astype(np.int64))[:-1])


def pieces(path: str) -> list[bytes]:
    """The string of every id, in the order of the ids."""
    tokenizer = remembering(path).encoder.tokenizer
    return [(tokenizer.id_to_token(i) or "").encode() for i in range(tokenizer.get_vocab_size(True))]


def _assemble(path: str, digest: bool, parts: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, table: pa.Table) -> pa.Table:
        encoder = remembering(path).encoder
        if encoder.tokenizer.decoder is not None:
            raise ValueError("decoding needs a tokenizer that joins pieces by a blank")
        piece = pieces(path)
        number = [b"%d" % i for i in range(len(piece))]
        # a text is split once: what is kept of it are its words' numbers in the block
        at: defaultdict[bytes, int] = defaultdict()
        at.default_factory = at.__len__
        texts = []
        for name, text in _documents(docs.column("blob")):
            words = encoder.split_words(text)
            texts.append((name, np.fromiter(map(at.__getitem__, words), np.int32, len(words))))
        asked = _by_part(at, parts)
        of: list[list[int]] = [[]] * len(at)
        for part, blob in zip(table.column("part").to_pylist(), table.column("answer")):
            for word, ids in zip(asked[part], _answer(blob.as_buffer().to_pybytes()), strict=True):
                of[at[word]] = ids.tolist()
        names_, out_n, out_ids, out_text = [], [], [], []
        for name, words in texts:
            ids = list(itertools.chain.from_iterable(map(of.__getitem__, words.tolist())))
            # decoding sees the ids only, not the words they come from
            decoded = b" ".join(map(piece.__getitem__, ids))
            names_.append(name)
            out_n.append(len(ids))
            out_ids.append(hashlib.sha256(b" ".join(map(number.__getitem__, ids))).hexdigest() if digest else np.array(ids, np.int32))
            out_text.append(hashlib.sha256(decoded).hexdigest() if digest else decoded.decode())
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["doc_id", "n_tokens", "ids", "decoded"]
        kinds = [pa.int64(), pa.int64(), pa.string() if digest else pa.list_(pa.int32()), pa.string()]
        columns = [names_, out_n, out_ids, out_text]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


def encode_documents(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, block_mb: int = 24
) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded), or with ``digest`` SHA-256 sums of the ids and of the decoded text."""
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = whole.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, math.ceil(size / (block_mb << 20)))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    packed = whole.select(block.alias("block"), "doc_id", "text").mapInArrow(_fragments, "block int, blob binary")
    dealt = packed.repartition(blocks, "block")
    asked = dealt.groupBy("block").applyInArrow(_distinct_words(tokenizer_path, blocks), "block int, part int, words binary")
    answered = asked.groupBy("part").applyInArrow(_encode_part(tokenizer_path), "block int, part int, answer binary")
    kinds = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"
    return dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(
        _assemble(tokenizer_path, digest, blocks), f"doc_id long, n_tokens long, {kinds}"
    )


def decode_ids(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of arrays of ids, as a join of each id with its piece; null ids: null text; unknown ids: left out.

    The pieces are one constant array of the vocabulary's size, so the join is a lookup by position in the JVM.
    """
    vocabulary = F.lit([p.decode() for p in pieces(tokenizer_path)])
    known = F.filter(F.col(ids_col), lambda i: (i >= 0) & (i < F.size(vocabulary)))
    return encoded.select(F.col(id_col), F.array_join(F.transform(known, lambda i: F.get(vocabulary, i)), " ").alias("text"))


def op4_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    """Encode and decode every document with the public word BPE."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), digest=True)
