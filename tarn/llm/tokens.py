"""Ids of a byte-level BPE vocabulary file.

The ids are those of the ``tokenizers`` library for the file. Its merges run here in the
``tiktoken`` library, which gives the same ids three times as fast when the file's merges are in
the order of their ids; that is checked when the file is loaded, and where it doesn't hold,
``tokenizers`` itself runs.
"""

from __future__ import annotations

import functools
import json

import numpy as np


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """The file's alphabet: visible Latin-1 bytes stand for themselves, the others follow from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _as_ranks(path: str):
    """A tiktoken encoding for the file, or None if its merges aren't in the order of ids."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    special = {x["content"]: x["id"] for x in parts["added_tokens"]}
    vocab, merges = parts["model"]["vocab"], parts["model"]["merges"]
    pre = parts.get("pre_tokenizer") or {}
    plain = all(not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]) for x in parts["added_tokens"])
    if parts.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or not plain:
        return None
    pairs = (x.split(" ") if isinstance(x, str) else x for x in merges)
    merged = [vocab[a + b] for a, b in pairs]
    if any(b <= a for a, b in zip(merged, merged[1:])):
        return None
    byte = _byte_of_char()
    ranks = {bytes(byte[c] for c in word): i for word, i in vocab.items() if word not in special}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@functools.lru_cache(maxsize=4)
def encoder(path: str, backend: str = "auto"):
    """A function from a text to its ids as a uint32 array. backend: auto or tokenizers."""
    ranks = _as_ranks(path) if backend == "auto" else None
    if ranks is not None:
        return lambda text: np.asarray(ranks.encode_to_numpy(text, allowed_special="all", disallowed_special=()), dtype=np.uint32)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def document_ids(text: str | None, encode, end_id: int) -> np.ndarray:
    """The ids of a document (null: an empty one), and the end id."""
    ids = encode(text) if text else np.empty(0, np.uint32)
    return np.append(ids, np.uint32(end_id))
