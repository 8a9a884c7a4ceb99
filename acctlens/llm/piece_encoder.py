"""Subword encoding with the tokenizers library, each distinct piece encoded once.

A tokenizer that pre-splits its text encodes every pre-token by itself, so a text may be cut at
any place where the pre-splitter always cuts.  Two kinds are recognised from the tokenizer's own
description; every other tokenizer encodes whole texts.

* ``drop``: white space separates and is dropped: cut at every space.
* ``lead``: a space opens the pre-token after it: cut before each space that a non-space
  follows.  A text with a space before other white space or at its end is encoded whole.

Strings of the tokenizer's added tokens (``<|endoftext|>``) in a text become those tokens, as is the
library's default; a text with one of them is encoded whole, since they are taken out before the pre-splitting.

Of each batch only the distinct pieces are looked at.  Pieces of ASCII and Latin-1 letters, whose
pre-splitting needs no Unicode tables, are split here by the same pattern, and their pre-tokens
are encoded by the library's model; all others go through the library whole.  A memo of encoded
pre-tokens lives as long as the Python worker; once it has reached its bound, further pre-tokens
are encoded for their batch only.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from acctlens.llm.text import gather_runs

# The pre-splitting patterns for which the two cuts hold.
DROP_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LEAD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# a space at the end, or before white space in the widest sense (Unicode White_Space, FS..US)
_UNSAFE_SPACE = (" ([\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}"
                 "\\x{202f}\\x{205f}\\x{3000}\\x{feff}]|\\z)")
_MAX_MEMO = 350_000
SLICE_BYTES = 8 << 20                                     # text that is encoded at a time

# The same patterns over ASCII, the Latin-1 letters, LF as the only other white space, and SOH,
# which closes each piece of a joined run.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_PUNCT = r"!-/:-@\[-`{-~"
_PLAIN = f"^[\n{_LATIN}0-9{_PUNCT}]*\\z"
_SPLIT = {
    "lead": re.compile(f"\x01|'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[{_PUNCT}]+|[ \n]+(?![^ \n\x01])|[ \n]+"),
    "drop": re.compile(f"\x01|'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[{_PUNCT}]+"),
}


def byte_characters() -> list[str]:
    """Byte-level BPE's character for each byte: printable Latin-1 bytes stand for themselves, the
    others take the characters from U+0100 on, in byte order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(rest)) for b in range(256)]


_CHARS = byte_characters()
_TO_CHARS = {i: "".join(_CHARS[b] for b in chr(i).encode()) for i in [10, 32, *range(0xC0, 0x100)]}


def cut_kind(description: str) -> str:
    """``drop``, ``lead`` or ``whole`` for a tokenizer's JSON description."""
    d = json.loads(description)
    if d.get("normalizer") and any(t["normalized"] for t in d["added_tokens"]):
        return "whole"                          # found in normalised text only
    normal, pre = d.get("normalizer"), d.get("pre_tokenizer") or {}
    if normal is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "lead"
    inner = [n["type"] for n in (normal or {}).get("normalizers", [])]
    split = (pre.get("pretokenizers") or [{}])[0]
    if (inner == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split" and split.get("behavior") == "Removed"
            and split.get("invert") and split["pattern"].get("Regex") == DROP_PATTERN):
        return "drop"
    return "whole"


class PieceEncoder:
    """Encodes string columns to ids; one object per Python worker and tokenizer."""

    def __init__(self, tokenizer, kind: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = tokenizer
        description = tokenizer.to_str()
        self.kind = kind or cut_kind(description)
        added = [re.escape(t["content"]) for t in json.loads(description)["added_tokens"]]
        # texts that are not cut
        self.odd = "|".join([_UNSAFE_SPACE] * (self.kind == "lead") + added)
        self.memo: dict[str, int] = {"\x01": 0}
        self.flat, self.starts, self.lengths = np.empty(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_plain(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number by piece) of plain pieces, each closed by SOH."""
        split = _SPLIT[self.kind].findall(joined.lower() if self.kind == "drop" else joined)
        new = set(split).difference(self.memo)
        tokenize = self.tokenizer.model.tokenize
        ids, offsets = _joined([[t.id for t in tokenize(
            p.replace(" ", "\u0120").replace("\n", "\u010a") if p.isascii() else p.translate(_TO_CHARS))] for p in new])
        here = dict(zip(new, range(len(self.memo), len(self.memo) + len(new))))
        starts = np.concatenate([self.starts, len(self.flat) + offsets[:-1]])
        lengths = np.concatenate([self.lengths, np.diff(offsets)])
        flat = np.concatenate([self.flat, ids])
        known = self.memo.get
        place = np.fromiter([known(p, -1) for p in split], np.int64, len(split))
        missing = np.flatnonzero(place < 0)
        place[missing] = [here[split[i]] for i in missing.tolist()]
        if len(starts) <= _MAX_MEMO:
            self.memo.update(here)
            self.starts, self.lengths, self.flat = starts, lengths, flat
        lens = lengths[place]
        ends = np.cumsum(lens)[np.flatnonzero(place == 0)]
        return flat[gather_runs(starts[place], lens)], np.diff(ends, prepend=0)

    def _encode_pieces(self, distinct: pa.Array, lead: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, lengths) of the distinct pieces, ``lead`` before each."""
        n = len(distinct)
        plain = pc.match_substring_regex(distinct, _PLAIN).to_numpy(zero_copy_only=False)
        lens, parts = np.empty(n, np.int64), []
        if plain.any():
            pieces = (distinct if plain.all() else distinct.filter(pa.array(plain))).to_pylist()
            ids, lens[plain] = self._encode_plain(lead + ("\x01" + lead).join(pieces) + "\x01")
            parts.append(ids)
        if not plain.all():
            ids, offsets = _joined(self._whole([lead + p for p in distinct.filter(pa.array(~plain)).to_pylist()]))
            lens[~plain] = np.diff(offsets)
            parts.append(ids)
        starts = np.empty(n, np.int64)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        starts[order] = np.cumsum(lens[order]) - lens[order]
        return np.concatenate(parts) if parts else np.empty(0, np.uint32), starts, lens

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets of the texts in them); null is empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        n = len(texts)
        if self.kind == "whole":
            return _joined(self._whole(texts.to_pylist()))
        if not self.odd:
            return self._cut(texts)
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._cut(texts)
        # rows with an unsafe space or an added token are encoded whole and put back in their places
        some_ids, some = self._cut(texts.filter(pa.array(~odd)))
        odd_ids, off = _joined(self._whole(texts.filter(pa.array(odd)).to_pylist()))
        lens, starts = np.empty(n, np.int64), np.empty(n, np.int64)
        lens[~odd], lens[odd] = np.diff(some), np.diff(off)
        starts[~odd], starts[odd] = some[:-1], off[:-1] + len(some_ids)
        return np.concatenate([some_ids, odd_ids])[gather_runs(starts, lens)], np.concatenate([[0], np.cumsum(lens)])

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(texts) == 0:
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        cut = pc.split_pattern(texts, " ")
        rows = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        piece, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        del cut, coded, texts
        if self.kind == "drop":
            ids, starts, lens = self._encode_pieces(distinct, "")
        else:                                   # all but the first piece of a text begin with its space
            first = rows[:-1]
            opening, at = np.unique(piece[first], return_inverse=True)
            ids, starts, lens = self._encode_pieces(distinct, " ")
            more = self._encode_pieces(distinct.take(pa.array(opening)), "")
            starts, lens = np.concatenate([starts, len(ids) + more[1]]), np.concatenate([lens, more[2]])
            ids = np.concatenate([ids, more[0]])
            piece[first] = len(distinct) + at
        n = lens[piece]
        ends = np.concatenate([[0], np.cumsum(n)])
        return ids[gather_runs(starts[piece], n)], ends[rows]


_ENCODERS: dict = {}


def encoder_for(path: str) -> PieceEncoder:
    """The worker's encoder for a tokenizer file (kept across tasks)."""
    if path not in _ENCODERS:
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path] = PieceEncoder(Tokenizer.from_file(path))
    return _ENCODERS[path]


def _joined(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lens = np.fromiter(map(len, rows), np.int64, len(rows))
    ids = np.fromiter((i for r in rows for i in r), np.uint32, int(lens.sum()))
    return ids, np.concatenate([[0], np.cumsum(lens)])
