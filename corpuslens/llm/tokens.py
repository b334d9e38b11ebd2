"""Encoding whole texts with a public tokenizer, word by word, in Arrow arrays.

The byte-level pre-tokenizer always starts a new piece at a single blank or
newline between two characters that aren't white space, and where ASCII
symbols that end a word follow a letter or digit. So a text in which all
blanks and newlines stand like that is the concatenation of its parts'
encodings. A part is a word (with the blank or newline before it) or closing
symbols (marked by MARK). The parts of a slice of texts become a dictionary;
a table that lives as long as the worker process holds the ids of parts seen
before, so that each new part goes through the tokenizer once. All other texts
go through the tokenizer whole.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DEFAULT = "byte_bpe_50k.json"
MARK = "\x01"
#: Letters of scripts that every Unicode version knows alike, and digits, then ASCII symbols up to a part's end.
CLOSING = "([0-9A-Za-zÀ-ÖØ-öø-ɏ])([!-/:-@\\[-`{-~]+)( |$)"


def tokenizer_path(name: str = DEFAULT) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def plain_part(part: str) -> bool:
    """part: a word, or a newline and a word, with nothing blank at its ends; or closing symbols."""
    word = part[1:] if part[:1] in ("\n", MARK) else part
    return bool(word) and not word[0].isspace() and not word[-1].isspace()


def byte_letters() -> dict[int, str]:
    """The letter that byte-level models use for each byte: printable ones stand for themselves, the others follow from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(others)) for b in range(256)}


def slices(texts: pa.Array, most_bytes: int = 4_000_000) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive slices of about most_bytes, with the row of the first; a longer text comes in the slice that it ends."""
    if not len(texts):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff(ends // most_bytes, prepend=0)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)], strict=True):
        if a < b:
            yield a, texts.slice(a, b - a)


class Encoder:
    """most: parts that the table holds; when there are more, it keeps only those of the slice at hand."""

    def __init__(self, path: str | None = None, most: int = 500_000):
        from tokenizers import Tokenizer

        path = path or tokenizer_path()
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        spec["model"] = spec["model"]["type"]
        level = spec["pre_tokenizer"] or {}
        #: Whether the tokenizer splits as this module assumes; otherwise all texts are encoded whole.
        self.splits = spec["normalizer"] is None and level.get("type") == "ByteLevel" and level.get("use_regex") and not level.get("add_prefix_space") and spec["model"] == "BPE" and all("<|" in t["content"] for t in spec["added_tokens"])
        self.model, self.letters, self.most = self.tokenizer.model, byte_letters(), most
        self.parts, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.newline = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _part(self, part: str) -> bytes | None:
        """The ids of a part; None if it isn't plain."""
        if not plain_part(part):
            return None
        after_newline = part[0] == "\n"
        word = part[1:] if after_newline else part
        if word.isalpha() and (word.isascii() or max(word) < "Ԁ"):  # a piece that the pre-tokenizer leaves whole
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.model.tokenize(word if after_newline else self.letters[32] + word)]
            found = struct.pack(f"<{len(ids)}I", *ids)
        elif part[0] == MARK:
            return self._whole(part[1:])
        else:
            found = self._whole(word if after_newline else " " + word)
        return self.newline + found if after_newline else found

    def _look_up(self, parts: pa.Array) -> pa.Array:
        """The ids of distinct parts; null for those that aren't plain."""
        at = pc.index_in(parts, value_set=self.parts)
        unseen = at.is_null().to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy().astype(np.int64)
        at[unseen] = len(self.parts) + np.arange(np.count_nonzero(unseen))
        if unseen.any():
            new = parts.filter(pa.array(unseen))
            learnt = pa.array([self._part(p) for p in new.to_pylist()], pa.large_binary())
            self.parts, self.ids = pa.concat_arrays([self.parts, new]), pa.concat_arrays([self.ids, learnt])
        found = self.ids.take(pa.array(at))
        if len(self.parts) > self.most:
            self.parts, self.ids = parts, found
        return found

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (unsigned 32-bit) of the texts, one text after the other, and where each begins (and the end); null is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        whole = set(range(len(texts)))
        if self.splits:
            # A newline before the text makes its first word a part like others; its id goes again below.
            lines = pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), pc.replace_substring(texts, "\n", " \n"), pa.scalar("", pa.large_string()))
            cut = pc.split_pattern(pc.replace_substring_regex(lines, CLOSING, f"\\1 {MARK}\\2\\3"), " ")
            coded = cut.values.dictionary_encode()
            found = self._look_up(coded.dictionary).take(coded.indices)
            at = cut.offsets.to_numpy()
            bounds = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1, 8 * found.offset)[at] >> 2
            odd = pc.match_substring_regex(texts, f"<\\||{MARK}").to_numpy(zero_copy_only=False)
            if found.null_count:
                odd[np.searchsorted(at, np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False)), "right") - 1] = True
            odd |= pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            raw = found.buffers()[2]
            values = np.frombuffer(raw, "<u4") if raw is not None else np.zeros(0, "<u4")
            whole = set(np.flatnonzero(odd).tolist())
        n = len(texts)
        if not whole:
            # each text's first id is that of the newline put before it
            keep = np.ones(int(bounds[-1]), bool)
            keep[bounds[:-1]] = False
            return values[: len(keep)][keep], bounds - np.arange(n + 1)
        parts = [np.frombuffer(self._whole(texts[i].as_py()), "<u4") if i in whole else values[bounds[i] + 1 : bounds[i + 1]] for i in range(n)]
        begins = np.zeros(n + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=begins[1:])
        return np.concatenate(parts) if n else np.zeros(0, "<u4"), begins

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null is empty."""
        values, begins = self.encode_array(pa.array(texts, pa.large_string()))
        return [values[a:b].tobytes() for a, b in zip(begins, begins[1:], strict=False)]


_encoders: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """This process's encoder: tasks that share a Python worker share its table."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(texts: pa.Array, end_id: int, path: str | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By slice of the texts: the row of its first text, the ids of its texts with the end id after each, and where each begins (and the end)."""
    for first, part in slices(texts):
        values, begins = encoder(path).encode_array(part)
        n = len(part)
        begins = begins + np.arange(n + 1)
        out = np.full(len(values) + n, end_id, "<u4")
        mask = np.ones(len(out), bool)
        mask[begins[1:] - 1] = False
        out[mask] = values
        del values, mask
        pa.default_memory_pool().release_unused()
        yield first, out, begins
