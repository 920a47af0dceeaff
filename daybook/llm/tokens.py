"""Token ids of whole texts with a byte-level BPE of the tokenizers library, each distinct word encoded once per worker
while a bounded table has room for it.

Byte-level BPE cuts a text before a single space between two visible characters, and around a single line break between
them, whatever stands on either side. A text is split there into pieces that keep their space, pieces met before are
looked up, new ones go to the library in one batch, many to a text. Texts with other white space are cut only at spaces
between visible characters. Texts that hold one of the tokenizer's added tokens go to the library whole.

Arrow cuts the texts of a batch and numbers its different pieces, so Python meets each different piece of a batch once.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

INNER_SPACE = re.compile(r"(?<=\S)(?= \S)")
#: A text with none of these, and visible characters at both ends, is words with one space or line break between them.
NOT_PLAIN = ["\0", "  ", " \n", "\n ", "\n\n"] + [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
#: Bytes of the pieces that a Python worker remembers, with the overhead of their objects; others are encoded again in each batch.
REMEMBERED = 64 << 20
OVERHEAD = 190
#: Words that go to the library as one text.
JOINED = 128

_encoders: dict[str, Encoder] = {}


class Encoder:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [a.content for a in self.tokenizer.get_added_tokens_decoder().values()]
        self.table: dict[str, bytes] = {}
        self.room = remembered
        # Byte-level vocabularies write the space as U+0120; only a word's first token can begin with it.
        self.begins = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.begins[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("Ġ")]] = True

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        for i in range(0, len(texts), 5000):
            out += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts[i : i + 5000], add_special_tokens=False)]
        return out

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of words that begin with their space and hold no other: encoded many to a text and cut where a space begins."""
        out = []
        for i in range(0, len(words), JOINED):
            group = words[i : i + JOINED]
            raw = self.whole(["".join(group)])[0]
            at = (np.flatnonzero(self.begins[np.frombuffer(raw, "<u4")]) * 4).tolist()
            out += [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)], strict=True)] if len(at) == len(group) else self.whole(group)
        return out

    def added_to(self, new: dict[str, bool]) -> dict[str, bytes]:
        """Ids of new pieces (true: a plain word with its space), remembered while there is room."""
        plain, other = [w for w, p in new.items() if p], [w for w, p in new.items() if not p]
        ids = dict(zip(plain, self.words(plain), strict=True)) | dict(zip(other, self.whole(other), strict=True))
        for piece, raw in ids.items():
            if self.room <= OVERHEAD:
                break
            cost = OVERHEAD + len(piece.encode()) + len(raw)
            if cost <= 512 and cost <= self.room:
                self.table[piece] = raw
                self.room -= cost
        return ids

    def joined(self, texts: pa.ListArray, plain: bool) -> list[bytes]:
        """Ids of texts that are cut into pieces; ``plain``: into words with one space or line break between them."""
        coded = texts.flatten().dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.table.get, pieces))
        missing = [i for i, raw in enumerate(ids) if raw is None]
        fresh = self.added_to({pieces[i]: plain and pieces[i][0] == " " for i in missing})
        for i in missing:
            ids[i] = fresh[pieces[i]]
        placed, ends = np.array(ids, object)[coded.indices.to_numpy()], texts.offsets.to_numpy().tolist()
        return [b"".join(placed[a:b].tolist()) for a, b in zip(ends, ends[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        out = [b""] * len(texts)
        plain, other = [], []
        for n, t in enumerate(texts):
            if any(a in t for a in self.added):
                out[n] = self.whole([t])[0]
            elif t != "" and not t[0].isspace() and not t[-1].isspace() and not any(c in t for c in NOT_PLAIN):
                plain.append(n)
            elif t != "":
                other.append(n)
        if plain:
            marked = pa.array([texts[n].replace("\n", "\0\n\0").replace(" ", "\0 ") for n in plain], pa.large_string())
            for n, ids in zip(plain, self.joined(pc.split_pattern(marked, "\0"), True), strict=True):
                out[n] = ids
        if other:
            pieces = pa.array([INNER_SPACE.split(texts[n]) for n in other], pa.list_(pa.large_string()))
            for n, ids in zip(other, self.joined(pieces, False), strict=True):
                out[n] = ids
        return out


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(texts, path: str, end_id: int = 0, step: int = 1000) -> list[bytes]:
    """Ids of each text (null: empty) followed by the end id, as little-endian unsigned 32-bit integers."""
    e, end, out = encoder(path), np.array([end_id], dtype="<u4").tobytes(), []
    texts = list(texts)
    for i in range(0, len(texts), step):
        out += [ids + end for ids in e.encode([t or "" for t in texts[i : i + step]])]
    return out
