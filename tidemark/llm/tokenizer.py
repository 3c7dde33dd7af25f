"""Byte-level BPE encoding of whole texts at corpus speed.

A byte-level BPE splits a text into pieces before it merges bytes, and no piece reaches over a
single space that stands before a visible character: such a space always begins a new piece. A text
may therefore be encoded chunk by chunk, a chunk being that space with all that follows up to the
next one, and each distinct chunk of a batch once. Tests hold the result against the
tokenizer's own encoding of whole texts.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Ids are kept as little-endian unsigned 32-bit integers.
ID = np.dtype("<u4")

_encoders: dict[str, ChunkEncoder] = {}


def printable_bytes() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: visible Latin-1 stands for itself, the rest moves up from 256."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ChunkEncoder:
    """Encodes texts with a `tokenizers` byte-level BPE file; strings of special tokens count as ordinary text.

    Unknown chunks go to tiktoken with the ranks and the pattern of that file, which gives the same
    ids in a tenth of the time.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {x["id"] for x in model.get("added_tokens", ())}
        shown = printable_bytes()
        self.pieces = {bytes(shown[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if i not in special}
        self._whole = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=self.pieces, special_tokens={}).encode_ordinary
        self._spaced = np.zeros(max(self.pieces.values()) + 2, bool)
        for piece, i in self.pieces.items():
            self._spaced[i] = piece[:1] == b" "

    def encode(self, text: str) -> np.ndarray:
        """The ids of one text."""
        return np.array(self._whole(text), ID)

    def encode_many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an array of texts (null: empty), and the number of ids before each text and at the end.

        Words are split and numbered by Arrow, each distinct one is encoded once, all in one call,
        where the ids that begin with a space tell the words apart.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, r" (?:[\s\x0B\x1C-\x1F]|\pZ|\x{85}|$)").to_numpy(zero_copy_only=False)
        parts = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        at = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        words = parts.flatten()
        numbered = words.dictionary_encode()
        known = numbered.dictionary.to_pylist()
        which = numbered.indices.to_numpy(zero_copy_only=False)
        single = np.array([i for i, w in enumerate(known) if not w or w.isspace() or w[0].isspace()], int)  # only as a text's first
        plain = np.ones(len(known), bool)
        plain[single] = False
        ids = np.array(self._whole(" " + " ".join(w for w, p in zip(known, plain.tolist(), strict=True) if p)) if plain.any() else [], ID)
        starts = np.flatnonzero(self._spaced[ids])
        begin, size = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        begin[plain], size[plain] = starts, np.diff(np.append(starts, len(ids)))
        # the first word of a text has no space before it, and odd texts go whole
        firsts = [self._whole(t if o else known[which[i]]) for t, o, i in zip((t.as_py() if o else None for t, o in zip(texts, odd, strict=True)), odd, at[:-1].tolist(), strict=True)]
        lens = size[which]
        lens[at[:-1]] = [len(x) for x in firsts]
        source = begin[which]
        source[at[:-1]] = len(ids) + np.cumsum([0, *map(len, firsts)])[:-1]
        ids = np.concatenate([ids, np.fromiter((i for x in firsts for i in x), ID)])
        ends = np.append(0, np.cumsum(lens))
        return ids[np.repeat(source - ends[:-1], lens) + np.arange(ends[-1])], ends[at]

    def cut_marks(self) -> tuple[np.ndarray, np.ndarray]:
        """For each id: does it end a sentence or line; does it begin with white space."""
        n = max(self.pieces.values()) + 2
        ends, begins = np.zeros(n, bool), np.zeros(n, bool)
        for piece, i in self.pieces.items():
            ends[i], begins[i] = piece[-1:] in b".!?\n", piece[:1] in b" \t\r\n"
        return ends, begins


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each Python worker."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]
