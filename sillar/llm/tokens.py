"""Sizes of texts in tokens of a public tokenizer.

The vocabulary is read once on the driver, from a folder that is a parameter, and sent
to the tasks with the plan (under 1 MB), so executors need no such folder.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from sillar.session import spread

FOLDER = "/opt/tokenizers"
#: Byte-level BPE trained on many languages; 50,256 ranks.
NAME = "byte_bpe_multi_50k.tiktoken"
#: How text is divided before the merges; fixed value of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(documents: DataFrame, id_column: str, text_column: str, extra: list[str] | None = None, folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """``(<id>, <extra columns>, tokens)`` of every row whose text is not blank.

    Null texts and texts of white space only are left out, whole texts are counted, and
    special tokens are ordinary text.
    """
    vocabulary = (Path(folder) / name).read_bytes()
    kept = [id_column, *(extra or [])]
    slim = documents.select(*kept, documents[text_column].alias("__text")).filter("__text is not null")
    fields = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(vocabulary)
        for b in batches:
            texts = b.column(len(kept)).to_pylist()
            sizes = [len(coder.encode_ordinary(t)) if not t.isspace() and t else None for t in texts]
            full = pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(sizes, pa.int64())], names=[*kept, "tokens"])
            yield full.filter(full.column(len(kept)).is_valid())

    return spread(slim).mapInArrow(run, f"{fields}, tokens long")
