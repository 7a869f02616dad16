"""Token ids of whole texts with a public tokenizer file, as 32-bit little-endian bytes.

The tokenizer never joins characters across white space, and it drops white space, so a text's ids are the ids of
its chunks between white space put together. Each worker remembers the ids of the chunks it met last, which a
corpus repeats often; a chunk it has not met is split into letter runs, digits and marks, as the tokenizer file
says, and each run goes through the tokenizer's own merges. Chunks with anything but printable ASCII and Latin-1
letters go through the whole tokenizer.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache


#: Chunks that a worker remembers, and two thirds as many runs; it starts anew beyond.
REMEMBERED = 450_000

PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
RUNS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: str.split() also splits at these, which the tokenizer takes as marks.
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
ASCII_WS = re.compile(r"[^\x20\x09-\x0D]+")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: itself if printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Runs(dict):
    def __init__(self, tokenizer, most: int):
        self.model, self.letters, self.most = tokenizer.model, _byte_letters(), most

    def once(self, run: str) -> bytes:
        word = run if run.isascii() else run.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, run: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        out = self[run] = self.once(run)
        return out


class Chunks(dict):
    def __init__(self, tokenizer, plain: bool, most: int):
        self.tokenizer, self.runs, self.plain, self.most = tokenizer, Runs(tokenizer, 2 * most // 3), plain, most

    def __missing__(self, chunk: str) -> bytes:
        if self.plain and PLAIN.fullmatch(chunk) and "<|" not in chunk:
            runs = RUNS.findall(chunk.lower())
            # A chunk of one run is remembered as a chunk.
            out = b"".join([self.runs[r] for r in runs]) if len(runs) > 1 else self.runs.get(runs[0]) or self.runs.once(runs[0])
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(chunk) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = out
        return out


class Encoder:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_chunk = self._white_space_is_dropped()
        self.chunks = Chunks(self.tokenizer, self.by_chunk, remembered)

    def _white_space_is_dropped(self) -> bool:
        probe = "it's a  b2é,\n x<|y --"
        whole = self.tokenizer.encode(probe, add_special_tokens=False).ids
        return whole == [i for c in probe.split() for i in self.tokenizer.encode(c, add_special_tokens=False).ids] and self.tokenizer.to_str().count('"</w>"') > 0

    def __call__(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers; null is empty."""
        if not text:
            return b""
        if not self.by_chunk:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        parts = ASCII_WS.findall(text) if any(s in text for s in SEPARATORS) else text.split()
        return b"".join(map(self.chunks.__getitem__, parts))


@lru_cache(maxsize=2)
def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    """One per worker process, file and number of chunks."""
    return Encoder(path, remembered)


