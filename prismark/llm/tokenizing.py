"""Public tokenizers as the tasks use them; the files stay where they are, their path is a parameter."""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Callable

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def public_path(name: str) -> str:
    """Where a tokenizer file of the installed collection lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


# Fixed value: the pre-token pattern that byte-level tokenizers of this family use.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=4)
def library(path: str):
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=4)
def described(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


@functools.lru_cache(maxsize=4)
def byte_level(path: str) -> bool:
    """Whether the file is a byte-level BPE that splits texts by PRE_TOKEN and changes nothing before."""
    if not path.endswith(".json"):
        return False
    d = described(path)
    pre, model = d.get("pre_tokenizer") or {}, d["model"]
    plain = d.get("normalizer") is None and not d.get("truncation") and not d.get("padding")
    split = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    return plain and split and model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges")


@functools.lru_cache(maxsize=4)
def special_strings(path: str) -> tuple[str, ...]:
    """Strings inside a text that the library's default does not treat as ordinary text."""
    return tuple(t["content"] for t in described(path).get("added_tokens", []))


@functools.lru_cache(maxsize=1)
def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = (b for b in range(256) if b not in set(own))
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(token: str) -> bytes:
    at = _byte_of()
    return bytes(at[c] for c in token)


@functools.lru_cache(maxsize=4)
def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings proved to encode alone as one token: each is given to the library once and kept only if that returns its own id."""
    strings: dict[str, int] = {}
    skip = set(special_strings(path))
    for token, k in described(path)["model"]["vocab"].items():
        if token not in skip:
            try:
                strings[token_bytes(token).decode("utf-8")] = k
            except (KeyError, UnicodeDecodeError):
                continue
    names = list(strings)
    coded = library(path).encode_batch(names, add_special_tokens=False)
    return frozenset(s for s, e in zip(names, coded, strict=True) if e.ids == [strings[s]])


def _ranked(path: str):
    """The same vocabulary with ids as merge ranks, where the file's merges are listed in the order of their products' ids; else None."""
    import tiktoken

    model = described(path)["model"]
    vocab, last = model["vocab"], -1
    for m in model["merges"]:
        a, b = m.split(" ") if isinstance(m, str) else m
        if (k := vocab.get(a + b, -1)) <= last:
            return None
        last = k
    specials = set(special_strings(path))
    ranks = {token_bytes(t): k for t, k in vocab.items() if t not in specials}
    return tiktoken.Encoding("ranked", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def id_coder(path: str) -> Callable[[str], np.ndarray]:
    """A function from a text to the ids that the file's library gives for it, without added special tokens."""
    if path.endswith(".model"):
        return lambda text: np.asarray(library(path).encode(text, num_threads=1), dtype="<u4")
    slow = lambda text: np.asarray(library(path).encode(text, add_special_tokens=False).ids, dtype="<u4")
    ranked = _ranked(path) if byte_level(path) else None
    if ranked is None:
        return slow
    specials = special_strings(path)

    def code(text: str) -> np.ndarray:
        if any(s in text for s in specials):
            return slow(text)
        return ranked.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

    return code
