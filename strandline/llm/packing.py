"""Packing by power-of-two decomposition: a document's ids are split into pieces of binary lengths; a piece is a sequence.

No sequence crosses documents and none is padded. Pieces of equal length form a bucket (column ``bucket``, the binary
logarithm), from which a trainer draws batches of equal shape. It is one pass over the documents, without a shuffle.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.bpe import rows_of
from strandline.llm.common import python_workers

#: Fixed value: the pattern that the byte-level pretokeniser of the tokenizers library applies.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A sequence holds so many tokens at most. A power of two.
SEQUENCE = 1024


def piece_lengths(n: int, most: int = SEQUENCE) -> list[int]:
    """n as pieces of length most, then its remaining binary digits, the largest first."""
    if most < 1 or most & (most - 1):
        raise ValueError("the sequence length must be a power of two")
    out = [most] * (n // most)
    rest, bit = n % most, most >> 1
    while bit:
        if rest & bit:
            out.append(bit)
        bit >>= 1
    return out


def _byte_of_sign() -> dict[str, int]:
    """How tokenizer files write bytes: printable Latin-1 as itself, the others as signs from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class _Tokenizer:
    """Ids of whole texts as a tokenizer file of byte-level BPE gives them.

    Where the ids of merged tokens follow the order of the merges, and nothing but the byte-level pattern is set, ids
    are ranks and tiktoken gives the same ids several times faster. Any other file, and any text that holds one of
    the file's special strings, is left to the tokenizers library.
    """

    def __init__(self, spec: str):
        import numpy as np
        from tokenizers import Tokenizer

        self.np, self.tokenizer = np, Tokenizer.from_str(spec)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = self._as_ranks(json.loads(spec))

    def _as_ranks(self, spec: dict):
        import tiktoken

        cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding")
        if not plain or model.get("type") != "BPE" or any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
            return None
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        merged = [model["vocab"].get(a + b) for a, b in pairs]
        singles = [i for t, i in model["vocab"].items() if len(t) == 1]
        if merged != sorted(merged, key=lambda x: -1 if x is None else x) or None in merged or (merged and max(singles) > merged[0]):
            return None
        signs = _byte_of_sign()
        ranks = {bytes(signs[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
        return tiktoken.Encoding("file", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special):
            return self.np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.np.array(self.fast.encode_ordinary(text), "<u4").tobytes()


@lru_cache(maxsize=2)
def _tokenizer(spec: str) -> Callable[[str], bytes]:
    return _Tokenizer(spec)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket, ids.

    A document is the ids of its text, then end_id, so a null or empty text is one piece of length 1. sequence_id is
    the number of the partition in the upper bits and a count in the lower 33, so no two pieces share one; offset is 0,
    as each piece fills its sequence. Repeated rows are packed each for itself, null ids stay null, an empty table
    gives an empty result, other columns play no part. The tokenizer file is read by the driver and shipped with the tasks.
    """
    return _pack(docs, tokenizer_path, end_id, sequence, id_col, text_col, True)


def pack_digests(docs: DataFrame, tokenizer_path: str, end_id: int = 0, sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """pack() without the ids themselves."""
    return _pack(docs, tokenizer_path, end_id, sequence, id_col, text_col, False)


def _pack(docs: DataFrame, tokenizer_path: str, end_id: int, sequence: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    import pyarrow as pa
    from pathlib import Path

    piece_lengths(0, sequence)
    python_workers(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))  # of the vocabulary's fixed size
    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int" + ", ids array<int>" * with_ids

    def cut(batches):
        import numpy as np
        from pyspark import TaskContext

        encode, end = _tokenizer(spec.value), int(end_id).to_bytes(4, "little")
        number = TaskContext.get().partitionId() << 33
        kinds = [pa.int64()] * 7 + [pa.int32()] + [pa.list_(pa.int32())] * with_ids
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"] + ["ids"] * with_ids
        for batch in batches:
            for ids_in, texts in rows_of(batch):
                out: list[list] = [[] for _ in kinds]
                for doc, text in zip(ids_in, texts, strict=True):
                    ids = memoryview(encode(text or "") + end)
                    tokens, start = len(ids) // 4, 0
                    for length in piece_lengths(tokens, sequence):
                        piece = ids[4 * start : 4 * (start + length)]
                        for column, value in zip(out, (doc, start, length, zlib.crc32(piece), tokens, number, 0, length.bit_length() - 1), strict=False):
                            column.append(value)
                        if with_ids:
                            out[8].append(np.frombuffer(piece, "<u4").astype("i4"))
                        start += length
                        number += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, schema).withColumnRenamed("id", id_col)
