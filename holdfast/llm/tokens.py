"""Exact tokenizer calls with a memo: word_bpe_49k ids by the tokenizers library, a text's white-space chunks encoded once each.

The tokenizer drops white space before it merges, and neither its normaliser nor its
added tokens look across white space, so the ids of a text are the ids of its chunks in
order. That is read from the tokenizer's own file when it is loaded: a tokenizer with
another normaliser, other pieces or other kinds of added tokens encodes whole texts.
Chunks are kept in a memo of bounded size; what is not in it goes to the library.
"""

from __future__ import annotations

import json
import os
import re
import struct


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The parts of a tokenizer's file with which chunks give a text's ids.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def chunks_give_ids(file: dict) -> bool:
    """Whether a tokenizer's file has the parts that `ChunkEncoder` relies on: white space is dropped, nothing looks across it, and the model merges each piece by itself without chance."""
    model, added = file["model"], file["added_tokens"]
    plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or any(c.isspace() for c in t["content"]) or not t["content"].startswith("<") for t in added)
    return (
        plain and file["normalizer"] == NORMALIZER and file["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]}
        and file["truncation"] is None and file["padding"] is None and model["type"] == "BPE" and not model["dropout"]
    )


class ChunkEncoder:
    """Ids as little-endian unsigned 32-bit integers. memo: chunks kept at most, twice that for a moment.

    A chunk of ASCII letters, digits and marks and Latin-1 letters alone falls, in lower
    case, into pieces that the tokenizer's own pattern makes of it (letters; one digit;
    marks), and these go to the library's model, as the characters that byte-level
    tokenizers write for their bytes; all other chunks go to the whole tokenizer.
    """

    LONGEST = 64
    PIECES = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
    PLAIN = re.compile("[!-&(-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")  # printable, without ' (contractions) and < (added tokens)

    def __init__(self, path: str, memo: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.memo = Tokenizer.from_file(path), memo
        self.by_chunks = chunks_give_ids(json.loads(self.tokenizer.to_str()))
        self.model = self.tokenizer.model
        self.raw = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.young: dict[bytes, bytes] = Memo(self)
        self.old: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        shown = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
        self.written = {b: 256 + k for k, b in enumerate(shown)}

    def plain(self, chunk: str) -> bytes:
        """Ids of a chunk that PLAIN matches."""
        out, known = [], self.pieces
        for piece in self.PIECES.findall(chunk.lower()):
            if (ids := known.get(piece)) is None:
                raw = self.raw
                said = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1").translate(self.written)
                ids = b"".join([raw[t.id] for t in self.model.tokenize(said)])
                if len(piece) <= self.LONGEST:
                    if len(known) >= self.memo:
                        known.clear()
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def found(self, chunk: bytes) -> bytes:
        """Ids of a chunk that the young memo lacks."""
        if (known := dict.get(self.old, chunk)) is not None:
            return known
        if self.PLAIN.fullmatch(word := chunk.decode("utf-8")):
            return self.plain(word)
        return b"".join([self.raw[i] for i in self.tokenizer.encode(word, add_special_tokens=False).ids])

    def encode(self, text: str | None) -> bytes:
        if not self.by_chunks:
            return b"".join([self.raw[i] for i in self.tokenizer.encode(text or "", add_special_tokens=False).ids])
        ids = b"".join(map(self.young.__getitem__, (text or "").encode("utf-8").split()))
        if len(self.young) > self.memo:
            self.young, self.old = Memo(self), self.young
        return ids


class Memo(dict):
    """Chunk to ids; what is missing comes from the encoder, so that a known chunk costs one look. Long chunks are not kept."""

    def __init__(self, owner: ChunkEncoder):
        super().__init__()
        self.owner = owner

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.owner.found(chunk)
        if len(chunk) <= self.owner.LONGEST:
            self[chunk] = ids
        return ids


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One for each worker process, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
