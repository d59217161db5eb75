"""Exact byte-level BPE: the ids that the tokenizers library gives for a tokenizer file.

Two libraries are used. ``tiktoken`` is several times faster and gives the same ids
for characters that both classify alike; texts with any other character go to
``tokenizers`` itself. The tests compare both over every character taken as safe.
"""

from __future__ import annotations

import json
import re
from functools import cached_property, lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

# Fixed value: the pre-token pattern of byte-level BPE files that use their built-in regex.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Anything else makes a text go the slow way.
_UNSAFE = re.compile("[^\x00-ɏ‐-‧€]")


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of_char() -> dict[str, int]:
    """Byte-level files write bytes as characters: printable Latin-1 as itself, others from 256 on."""
    same = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    other = [b for b in range(256) if b not in set(same)]
    return {chr(b): b for b in same} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteBpe:
    """Encoder and decoder of one tokenizer file. Take it from ``load``, once per process.

    Files that are not byte-level with the built-in pattern, or that change a text before it is split, are refused: their ids
    are no bytes, and where their texts may be cut is not known.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.path = path
        pre = spec.get("pre_tokenizer") or {}
        built_in = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        alone = not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        if not (built_in and alone) or spec.get("normalizer") or spec["model"].get("type", "BPE") != "BPE":
            raise ValueError(f"{path} is no byte-level BPE that splits plain text by its built-in pattern")
        byte = _byte_of_char()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items()}
        ordered = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        plain = all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(ordered))
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special) if plain else None
        self.pieces = [b""] * (max([*ranks.values(), *special.values()]) + 1)
        for piece, i in ranks.items():
            self.pieces[i] = piece
        for text, i in special.items():
            self.pieces[i] = text.encode()

    @cached_property
    def exact(self) -> Tokenizer:
        """The library's own tokenizer, read only if a text needs it."""
        made = Tokenizer.from_file(self.path)
        made.no_padding()
        made.no_truncation()
        return made

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text as unsigned 32-bit integers; a special token's text is that token."""
        if not text:
            return np.empty(0, np.uint32)
        if self.fast is not None and (text.isascii() or not _UNSAFE.search(text)):
            return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), np.uint32)
        return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids, special tokens kept; bytes that are not UTF-8 become U+FFFD."""
        return b"".join([self.pieces[i] for i in ids.tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)
