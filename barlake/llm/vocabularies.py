"""Public tokenizers as tasks use them: read where the task runs, kept per worker."""

from __future__ import annotations

import json

import numpy as np
import sentencepiece
import tiktoken
import tiktoken.registry

_PIECES: dict[str, tuple[sentencepiece.SentencePieceProcessor, list[bytes], np.ndarray]] = {}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, then 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def json_encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """A byte-level BPE file of the tokenizers library as ranks.

    Both engines merge the pair of the lowest number first: the file's merges must make its ids in order, which is
    checked, as is that nothing but the byte-level splitting comes before. Special tokens keep their ids.
    """
    name, known = f"{path}\0{pattern}\0json", tiktoken.registry.ENCODINGS
    if name not in known:
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        split, model = data["pre_tokenizer"], data["model"]
        plain = data["normalizer"] is None and split["type"] == "ByteLevel" and split["use_regex"]
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        ids = {k: v for k, v in model["vocab"].items() if k not in special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [ids["".join(p)] for p in pairs]
        if not plain or split["add_prefix_space"] or made != sorted(made) or len(made) + 256 != len(ids):
            raise ValueError(f"{path} is no byte-level BPE whose ids follow its merges")
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): rank for token, rank in ids.items()}
        known[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return known[name]


def token_sizes(encoding: tiktoken.Encoding) -> np.ndarray:
    """Bytes of each id."""
    return np.array([len(encoding.decode_single_token_bytes(i)) for i in range(encoding.max_token_value + 1)], np.int64)


def pieces_of(path: str) -> tuple[sentencepiece.SentencePieceProcessor, list[bytes], np.ndarray]:
    """A piece model, the bytes of each piece (U+2581 is a space, <0xHH> a byte) and their lengths."""
    if path not in _PIECES:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        raw = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        # Texts are cut at single spaces, which needs pieces that have blanks at their start only.
        if any(b" " in r.lstrip(b" ") for r in raw):
            raise ValueError(f"{path} has pieces across words")
        _PIECES[path] = model, raw, np.array([len(r) for r in raw], np.int64)
    return _PIECES[path]
