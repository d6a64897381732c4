"""Public tokenizers for Spark jobs: loaded once in each Python worker.

The vocabulary files stay where they are; their folder is a parameter (the
environment variable ``LOOMWRIGHT_TOKENIZERS`` or the argument ``folder``) and
must be readable on every executor.
"""

from __future__ import annotations

import os
from functools import lru_cache

from loomwright.llm.bpe import BytePairEncoder, load_ranks

DEFAULT_FOLDER = os.environ.get("LOOMWRIGHT_TOKENIZERS", "/opt/tokenizers")
DEFAULT_NAME = "byte_bpe_50k"

# Fixed value: the pre-token pattern that the byte-level vocabularies were made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(name: str = DEFAULT_NAME, folder: str = DEFAULT_FOLDER) -> BytePairEncoder:
    """The encoder of ``<folder>/<name>.tiktoken``; one per worker process."""
    return BytePairEncoder(load_ranks(os.path.join(folder, f"{name}.tiktoken")), PATTERN)


@lru_cache(maxsize=2)
def vocabulary(name: str = DEFAULT_NAME, folder: str = DEFAULT_FOLDER) -> dict[int, bytes]:
    """The bytes of each token id; one per worker process."""
    return {rank: token for token, rank in load_ranks(os.path.join(folder, f"{name}.tiktoken")).items()}
