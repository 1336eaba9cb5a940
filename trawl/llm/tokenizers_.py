"""Loading of public tokenizer files, once a process. The place of the files is a parameter; none is copied."""

from __future__ import annotations

import os
from functools import lru_cache


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load(path: str):
    """A tokenizers.Tokenizer for .json, a SentencePieceProcessor for .model."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out
