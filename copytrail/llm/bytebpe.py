"""Byte-level BPE ids as the tokenizers library gives them, with the ids of words remembered."""

from __future__ import annotations

import base64
import os
from functools import cache

import numpy as np

from copytrail.llm.common import WordMemory

REMEMBERED = 800_000


class ByteBpe:
    """One tokenizer file. ``encode`` gives what the tokenizers library's encode gives with add_special_tokens=False.

    A space between two characters that are no white space always begins a new token of this tokenizer's pattern, so the
    parts between such spaces can be encoded apart, and repeated ones looked up. Parts not met before are encoded from the
    same vocabulary's ranks, many times as fast. Texts with any other spacing, and texts that hold a special token, go to
    the tokenizers library whole.
    """

    def __init__(self, path: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        self.sizes = np.zeros(max(merges.values()) + 1, dtype=np.int64)
        self.sizes[list(merges.values())] = list(map(len, merges))
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.memory = WordMemory(self._learn, REMEMBERED)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """One array of ids for each text; null and empty texts have none."""
        parts = [t.split(" ") if t else [] for t in texts]
        known = self.memory.prepare([ps[1:] for ps in parts])[0]
        return [np.frombuffer(self._text(t, ps, known), dtype="<u4") for t, ps in zip(texts, parts, strict=True)]

    def _text(self, text: str | None, parts: list[str], known: dict) -> bytes:
        if not text:
            return b""
        if _plain(parts[0]) and not any(s in text for s in self.special):
            try:
                return np.array(self.fast.encode_ordinary(parts[0]), dtype="<u4").tobytes() + b"".join(map(known.__getitem__, parts[1:]))
            except TypeError:  # a part is known as one that cannot be encoded apart
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, words: list[str]) -> tuple[list[bytes | None]]:
        """The ids of each word with a space before it, from one text of all of them cut at the words' ends."""
        plain = list(filter(_plain, words))
        ids = np.array(self.fast.encode_ordinary("".join([" " + w for w in plain])), dtype="<u4")
        ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(w.encode()) + 1 for w in plain])) + 1
        data, at = ids.tobytes(), [0, *(4 * ends).tolist()]
        found = {w: data[a:b] for w, a, b in zip(plain, at[:-1], at[1:], strict=True)}
        return ([found.get(w) for w in words],)


def _plain(part: str) -> bool:
    return part != "" and part.strip() == part


@cache
def tokenizer(path: str, ranks: str, pattern: str) -> ByteBpe:
    """The tokenizer of this Python worker: its file, the same vocabulary as ranks, and the ranks' splitting pattern."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use every core
    return ByteBpe(path, ranks, pattern)
