"""Token ids of whole texts by a public tokenizer, with a bounded memory of what units encode to.

``word_bpe_49k.json`` drops white space, splits a text into runs of letters, single digits and runs of other characters, and encodes each
by itself; every such unit's last token ends in ``</w>``. So the ids of a text of plain Latin characters are its units' ids in order. Such texts are taken together, some
MB at a time: their units are found by arrays, each distinct unit is looked up once, and those not in memory go to the library in one call. Texts with any other character, or an apostrophe
(which opens contractions), are split at ASCII white space and only their plain words use the memory; the other
words go to the library whole. A text holding a special token's string, or combining marks next to white space, is encoded whole.
"""

from __future__ import annotations

import array
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

END_ID = 2
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_OTHER = r"!-&(-/:-@\[-`{-~"
_PLAIN = re.compile(rf"[{_LETTERS}0-9{_OTHER} \t\n\r\f\v]*\Z")
#: Units of a plain text's lower-case bytes: all of its bytes from 0x80 on are of letters.
_UNIT = re.compile(rf"[a-z\x80-\xff]+|[0-9]|[{_OTHER}]+".encode("latin-1"))
#: Words of these characters never combine with a neighbour across white space.
_WORD = re.compile(r"[^ \t\n\r\f\v]+")
_SPACE = re.compile(r"[ \t\n\r\f\v]")
#: Closes a text among others; no plain text holds it.
_STOP = b"\0"
#: What a byte of plain texts is: 0 white space, 1 letter, 2 other; from 3 on it is a unit by itself.
_KIND = np.full(256, 2, np.uint8)
_KIND[[*b" \t\n\r\f\v"]] = 0
_KIND[[*b"abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)]] = 1
_KIND[[*b"0123456789"]] = 3
_KIND[0] = 4
#: Lower case, byte by byte: from 0x80 on, a plain text holds 0xC3 and, after it, 0x80 to 0x9E for capitals.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", *range(0x80, 0x9F)]] += 32
#: Characters of texts taken together, and bytes of the longest unit remembered.
TOGETHER, LONGEST = 1 << 21, 64


class Encoder:
    """encode(text) -> little-endian uint32 ids as bytes, END_ID last."""

    def __init__(self, path: str, most: int = 100_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        #: The same model for units, which need no normalizing and are parted by spaces.
        self.units = Tokenizer(self.tokenizer.model)
        self.units.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.end = array.array("I", [END_ID]).tobytes()
        #: What units encode to; when it is full, it becomes the old one, from which units in use come back.
        self.memory: dict[bytes, bytes] = {_STOP: self.end}
        self.old: dict[bytes, bytes] = {}
        self.most = most

    def _whole(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _new(self, units: list[bytes]) -> list[bytes]:
        """What units encode to, by one call of the library."""
        ids = np.array(self.units.encode_batch_fast([b" ".join(units).decode()], add_special_tokens=False)[0].ids, "<u4")
        stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(stops) != len(units) or stops[-1] != 4 * len(ids):
            raise RuntimeError("the tokenizer's units aren't those this module expects")
        raw, stops = ids.tobytes(), stops.tolist()
        return [raw[lo:hi] for lo, hi in zip([0, *stops], stops, strict=False)]

    def _ids(self, units: list[bytes]) -> list[bytes]:
        """What units encode to; _STOP, always in memory, gives the end id."""
        out: list[bytes | None] = list(map(self.memory.get, units))
        missing = [i for i, x in enumerate(out) if x is None]
        if not missing:
            return out
        asked = [units[i] for i in missing]
        found = list(map(self.old.get, asked))
        new = [u for u, x in zip(asked, found, strict=True) if x is None]
        fresh = iter(self._new(new) if new else [])
        found = [next(fresh) if x is None else x for x in found]
        for i, x in zip(missing, found, strict=True):
            out[i] = x
        at = 0
        while at < len(asked):
            if len(self.memory) >= self.most:
                self.memory, self.old = {_STOP: self.end}, self.memory
            stop = at + self.most - len(self.memory)
            self.memory |= {u: x for u, x in zip(asked[at:stop], found[at:stop], strict=True) if len(u) <= LONGEST}
            at = stop
        return out

    def _together(self, texts: list[str]) -> list[bytes]:
        """encode() of plain texts: every distinct unit is looked up once, its ids are put wherever it stands."""
        raw = _LOWER[np.frombuffer("\0".join([*texts, ""]).encode(), np.uint8)]
        kind = _KIND[raw]
        first = kind >= 3
        first[:1] = True
        first[1:] |= kind[1:] != kind[:-1]
        ink = kind > 0
        body, starts = raw[ink], np.flatnonzero(first[ink])
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(body))), pa.py_buffer(body)]).dictionary_encode()
        ids = self._ids(found.dictionary.to_numpy(zero_copy_only=False).tolist())  # several times as fast as to_pylist
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        at = found.indices.to_numpy()
        n = size[at]
        stops = np.cumsum(n)
        from_ = np.repeat((np.cumsum(size) - size)[at] - stops + n, n)
        from_ += np.arange(len(from_))
        out = np.frombuffer(b"".join(ids), "<u4")[from_].tobytes()
        ends = (4 * stops[body[starts] == 0]).tolist()
        return [out[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False)]

    def _long(self, text: str) -> bytes:
        """encode() of a plain text, cut at white space so that the arrays stay small."""
        parts, at = [], 0
        while at < len(text):
            m = _SPACE.search(text, at + TOGETHER)
            stop = m.start() if m else len(text)
            parts.append(self._together([text[at:stop]])[0][:-4])
            at = stop
        return b"".join([*parts, self.end])

    def _plain(self, text: str) -> bool:
        return not any(s in text for s in self.special) and _PLAIN.match(text) is not None

    def encode_each(self, texts: Iterable[str | None], at_once: int | None = None) -> Iterator[bytes]:
        """encode() of each text; texts are taken until they are at_once or have TOGETHER characters."""

        def flush():
            plain = [len(t) <= TOGETHER and self._plain(t) for t in some]
            done = iter(self._together([t for t, p in zip(some, plain, strict=True) if p]) if any(plain) else [])
            for t, p in zip(some, plain, strict=True):
                yield next(done) if p else self.encode(t)

        some, held = [], 0
        for t in texts:
            some.append(t or "")
            held += len(some[-1])
            if held >= TOGETHER or len(some) == at_once:
                yield from flush()
                some, held = [], 0
        yield from flush()

    def encode_many(self, texts: Iterable[str | None], at_once: int | None = None) -> list[bytes]:
        return list(self.encode_each(texts, at_once))

    def _units(self, text: str) -> bytes:
        return b"".join(self._ids(_UNIT.findall(text.lower().encode())))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return self.end
        if any(s in text for s in self.special):
            return self._whole(text) + self.end
        if _PLAIN.match(text):
            return self._long(text)
        if not text.isascii() and any("ʰ" <= c <= "ͯ" or c > "῿" or c in "\x85\xa0 " for c in set(text)):
            return self._whole(text) + self.end
        out, plain = [], []
        for w in _WORD.findall(text):
            if _PLAIN.match(w):
                plain.append(w)
            else:
                if plain:
                    out.append(self._units(" ".join(plain)))
                    plain = []
                out.append(self._whole(w))
        if plain:
            out.append(self._units(" ".join(plain)))
        return b"".join(out) + self.end


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, most: int = 100_000) -> Encoder:
    """One encoder for each Python worker, file and size of memory."""
    if (path, most) not in _encoders:
        _encoders[path, most] = Encoder(path, most)
    return _encoders[path, most]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
