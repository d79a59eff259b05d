"""Tokenizer access on executors: exact ids and counts, with a bounded cache of encoded chunks.

A text is cut only where the tokenizer itself always cuts, so joining the chunks' ids gives the
library's ids for the whole text. Chunks repeat (they are words), hence most are encoded once.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache
from itertools import islice

#: Bytes that the cache of one Python worker may hold, roughly.
CACHE_BYTES = 160_000_000
#: Words learnt first that stay when the cache is emptied.
FIRST_KEPT = 100_000
#: Bytes of text to encode at a time: few enough that their words stay in the processor's cache.
SLICE = 30_000
#: White space other than single blanks and newlines, or what may start a special token.
_WHOLE = re.compile(r"[^\S \n]|\s\s|<\|")
#: Letters and the marks after them: two pieces to either pre-tokenizer, none changed by normalisation but for case.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]*)\Z").match
#: Byte-level tokenizers write a byte as itself where that is a visible character, the others from U+0100 on, in order.
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_AS_CHARACTER = {b: 0x100 + i for i, b in enumerate(sorted({*range(256)} - {*_VISIBLE}))}


def tokenizer_path(name: str, folder: str | None = None) -> str:
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids (as little-endian uint32 bytes) or counts of texts under a `tokenizers` file.

    Chunking by kind of pre-tokenizer: "dropped" (white space never reaches a token: cut at blanks
    and newlines), "led" (byte-level, a blank leads the word after it: cut before each blank or
    newline that follows a non-blank), otherwise whole texts are encoded.
    """

    def __init__(self, path: str, ids: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.make = (lambda e: array("I", e.ids).tobytes()) if ids else len
        self.join = b"".join if ids else sum
        self.kind, self.ids, self.model = self._kind(spec), ids, self.tokenizer.model
        self.lower = "Lowercase" in str(spec.get("normalizer"))
        self.marks: dict[str, bytes | int] = {}
        self.known: dict[str, bytes | int] = {}
        self.first: dict[str, bytes | int] = {}
        self.size = 0

    @staticmethod
    def _kind(spec: dict) -> str:
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
            return "whole"
        if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and norm is None:
            return "led"
        parts = pre.get("pretokenizers", [])
        if parts and parts[0].get("type") == "Split" and parts[0]["behavior"] == "Removed" and parts[0]["invert"] and "\\s" in str(parts[0]["pattern"]) and " " not in str(parts[0]["pattern"]["Regex"]):
            steps = {n["type"] for n in (norm or {}).get("normalizers", [norm] if norm else [])}
            return "dropped" if steps <= {"NFC", "Replace", "Lowercase"} else "whole"
        return "whole"

    def _encode(self, chunks: list[str]) -> list:
        return [self.make(e) for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _piece(self, piece: str):
        ids = [t.id for t in self.model.tokenize(piece)]
        return array("I", ids).tobytes() if self.ids else len(ids)

    def _learn(self, cache: dict, wanted: set[str], lead: str) -> None:
        new = wanted.difference(cache)
        if not new:
            return
        rest, piece, marks = [], self._piece, self.marks
        mapped = "\u0120" if lead else ""  # what byte-level tokenizers write for a blank
        for x in new:
            if m := _PLAIN(x):
                word, mark = m.groups()
                if self.kind == "dropped":
                    word = word.lower()
                if not word.isascii():
                    word = word.encode().decode("latin-1").translate(_AS_CHARACTER)
                ids = piece(mapped + word)
                if mark:
                    if mark not in marks:
                        marks[mark] = piece(mark)
                    ids += marks[mark]
                cache[x] = ids
            else:
                rest.append(x)
        cache.update(zip(rest, self._encode([lead + x for x in rest] if lead else rest)))
        self.size += sum(map(len, new)) + 200 * len(new)

    def _make_room(self, wanted: set[str]) -> None:
        """Beyond its bound the cache keeps the words that it met first, hence many frequent ones, and what the
        texts at hand need."""
        if self.size > CACHE_BYTES:
            self.first.clear()
            self.marks.clear()
            self.known = dict(islice(self.known.items(), FIRST_KEPT)) | {x: self.known[x] for x in wanted.intersection(self.known)}
            self.size = sum(map(len, self.known)) + 200 * len(self.known)

    def __call__(self, texts: list[str]) -> list:
        if self.kind == "whole":
            return self._encode(texts)
        if self.kind == "dropped":
            # ASCII has one way to be lower-cased; a special token's string is only one as it is spelt
            plain = [t.lower() if self.lower and t.isascii() and "<|" not in t else t for t in texts]
            parts = [t.replace("\n", " ").split(" ") for t in plain]
            wanted = set().union(*parts)
            self._make_room(wanted)
            self._learn(self.known, wanted, "")
            get = self.known.__getitem__
            return [self.join(map(get, p)) for p in parts]
        odd = [i for i, t in enumerate(texts) if _WHOLE.search(t)]
        parts = [t.replace("\n", " \n").split(" ") for t in texts]
        for i in odd:
            parts[i] = [""]
        wanted = set().union(*(p[1:] for p in parts))
        self._make_room(wanted)
        lines = {x for x in wanted if x[:1] == "\n"}
        self._learn(self.known, lines, "")
        self._learn(self.known, wanted - lines, " ")
        self._learn(self.first, {p[0] for p in parts}, "")
        get = self.known.__getitem__
        out = [self.join([self.first[p[0]], *map(get, p[1:])]) for p in parts]
        for i, x in zip(odd, self._encode([texts[i] for i in odd])):
            out[i] = x
        return out


@lru_cache(maxsize=4)
def encoder(path: str, ids: bool) -> Encoder:
    """One per Python worker, which lives through many tasks."""
    return Encoder(path, ids)


def release() -> None:
    """Drop what an earlier stage has left in this Python worker; workers outlive stages."""
    encoder.cache_clear()


def slices(sizes: list[int], most: int):
    """Ranges of rows with about `most` units in each, one row at least."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
