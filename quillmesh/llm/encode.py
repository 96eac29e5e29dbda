"""Problem 6: token ids of a whole corpus by a public byte-level BPE vocabulary.

Method: forced-boundary splitting. A pair of neighbouring bytes that occurs
inside no vocabulary token can never be bridged by a merge, so a cut between
the two is certain. All such cuts of an Arrow batch are found at once with a
65,536-entry lookup over the raw UTF-8 buffer; the fragments are encoded
independently (each different fragment once per worker) and their ids are
concatenated. Fragments repeat as words do, so the cost per byte falls to a
slice and a dictionary lookup.

A cut is used only where the vocabulary's pre-splitting pattern would also
restart identically:

* never inside a UTF-8 character;
* never after white space (the pattern looks ahead from there: ``\\s+(?!\\S)``);
* never before an apostrophe (``'s`` and its kin start a piece of their own).

Defined results: a null and an empty text both give an empty list; strings that
look like special tokens are ordinary text; repeated rows are encoded each;
extra columns of the input are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillmesh.llm.common import TOKENIZERS, received, sent_file, vocabulary_file

#: The published pre-splitting pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Different fragments kept per worker before the memo starts afresh; bounds memory only.
MEMO = 400_000
#: Fragments encoded at a time.
BLOCK = 200_000


class FragmentEncoder:
    """Encodes Arrow batches of text through independent fragments."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.forced = forced_pairs(ranks)
        self._memo: dict[bytes, list[int]] = {}

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Offsets in ``data`` (UTF-8 bytes) before which a cut is certain."""
        if len(data) < 2:
            return np.empty(0, np.int64)
        left, right = data[:-1], data[1:]
        sure = self.forced[(left.astype(np.uint16) << 8) | right]
        at = np.flatnonzero(sure)
        # Left byte may end a multi-byte white-space character; leaving out too many cuts is harmless.
        before = data[np.maximum(at - 1, 0)]
        last = data[at]
        blank = ((before == 0xC2) & ((last == 0x85) | (last == 0xA0))) | (
            ((before == 0x80) | (before == 0x81) | (before == 0x9A)) & (last >= 0x80) & (last < 0xC0)
        )
        return at[~blank] + 1

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets of each text in them)."""
        raw = texts.cast(pa.large_binary()).fill_null(b"")
        n = len(raw)
        bounds = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + n + 1]
        if n == 0 or bounds[-1] == bounds[0]:
            return np.empty(0, np.int32), np.zeros(n + 1, np.int64)
        data = np.frombuffer(raw.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        starts = bounds - bounds[0]
        edges = np.union1d(self.cuts(data), starts)
        whole = data.tobytes()
        memo, encode = self._memo, self._encoding.encode_ordinary
        if len(memo) > MEMO:
            memo.clear()
        found, counts = [np.empty(0, np.int32)], [np.zeros(1, np.int64)]
        # Block by block, so that a batch of long texts needs no list of all its fragments.
        for k in range(0, len(edges) - 1, BLOCK):
            points = edges[k : k + BLOCK + 1].tolist()
            pieces = []
            for a, b in zip(points, points[1:]):
                fragment = whole[a:b]
                ids = memo.get(fragment)
                if ids is None:
                    ids = encode(fragment.decode("utf-8", "replace"))
                    if b - a <= 64:
                        memo[fragment] = ids
                pieces.append(ids)
            sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
            found.append(np.fromiter(chain.from_iterable(pieces), np.int32, int(sizes.sum())))
            counts.append(sizes)
        total = np.cumsum(np.concatenate(counts))
        return np.concatenate(found), total[np.searchsorted(edges, starts)]


def forced_pairs(ranks: dict[bytes, int]) -> np.ndarray:
    """For each (left << 8 | right): whether a cut between the two bytes is certain and safe."""
    inside = np.zeros(65536, bool)
    for token in ranks:
        if len(token) > 1:
            b = np.frombuffer(token, np.uint8).astype(np.uint16)
            inside[(b[:-1] << 8) | b[1:]] = True
    sure = ~inside.reshape(256, 256)
    sure[:, 0x80:0xC0] = False  # inside a UTF-8 character
    sure[:, ord("'")] = False
    sure[[*range(9, 14), *range(28, 33)], :] = False  # after white space
    return sure.reshape(65536)


@lru_cache(maxsize=4)
def encoder(path: str) -> FragmentEncoder:
    return FragmentEncoder(path)


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(``id_col``, ids ARRAY<INT>) of every row of ``docs``; one pass, no shuffle."""
    name = sent_file(docs.sparkSession, vocabulary_file(f"{vocabulary}.tiktoken", folder))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(received(name))
        for batch in batches:
            ids, offsets = tool.encode(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(``id_col``, n_tokens INT) of every row; ids never leave the worker."""
    name = sent_file(docs.sparkSession, vocabulary_file(f"{vocabulary}.tiktoken", folder))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(received(name))
        for batch in batches:
            _, offsets = tool.encode(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets).astype(np.int32))], names=[id_col, "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens int")


