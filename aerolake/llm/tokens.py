"""Token ids of whole texts by a public tokenizer file.

The tokenizer's own rule never joins anything across a space that a visible character
follows, nor across a line break between visible characters. A text is cut there, every
piece is encoded once by the tokenizers library, and its ids are kept for the pieces to
come. Where signs follow a letter or digit, the rule of byte-level vocabularies starts anew, so a
word and the signs after it are two pieces. The result equals the library's ids of the whole text (tested). A text with the string of an added
token, such as a special one, is encoded whole by the library, whose defaults hold; only an encoder made
with ``plain_specials`` reads such strings as ordinary text.
"""

from __future__ import annotations

import os
import re
from itertools import compress, repeat
from operator import attrgetter

import numpy as np

from aerolake.llm.common import MASKS, mixed

VOCABULARY = "byte_bpe_50k.json"
#: Pieces kept by one Python worker; beyond it those that did not come again are let go.
STORE = 600_000

#: Characters of one call; more are encoded in turn.
CALL = 2_000_000

_CUT = re.compile(r" (?=[^\s\x00-\x20])")
_LATIN = [*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x250)]
#: Signs of ASCII: after letters, the tokenizer's rule takes a run of them together.
_SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
#: Place of a piece that starts with white space: its text is cut with more care.
_CAREFUL = -2
#: Stands before a piece that follows a letter or digit without a space; no text can hold it.
_GLUED = "\udc00"
#: Words of one call of the model.
_WORDS = 256
#: Bytes by what they are: signs of ASCII, its letters and digits, parts of Latin letters of one or two bytes.
_IS_SIGN, _IS_WORD, _IS_LATIN = (np.zeros(256, bool) for _ in range(3))
_IS_SIGN[list(_SIGNS.encode())] = True
_IS_WORD[[b for b in range(128) if chr(b).isalnum()]] = True
_IS_LATIN[[b for b in range(128) if chr(b).isalpha()] + [*range(0x80, 0xC0), *range(0xC3, 0xCA)]] = True
_ID = attrgetter("id")


def _times(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether two bytes are the sign of multiplication or division, which stand among the Latin letters."""
    return (first == 0xC3) & ((second == 0x97) | (second == 0xB7))


def byte_signs() -> dict[int, str]:
    """The sign by which byte-level vocabularies write each byte: visible ones of Latin-1 as they are, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids by piece; one for each worker process and vocabulary."""

    _known: dict[str, Encoder] = {}

    def __init__(self, path: str, plain_specials: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder().values()
        if plain_specials:
            self.library.encode_special_tokens = True
            added = [t for t in added if not t.special]
        self.added = re.compile("|".join(re.escape(t.content) for t in added)) if added else None
        self.newline = self.library.encode("\n", add_special_tokens=False).ids
        signs = byte_signs()
        self.spelling = {chr(c): "".join(signs[b] for b in chr(c).encode()) for c in _LATIN}
        rule = self.library.pre_tokenizer
        self.by_bytes = type(rule).__name__ == "ByteLevel" and rule.use_regex and not rule.add_prefix_space and self.library.normalizer is None
        self.kind = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        self.space = signs[32]
        self.written = np.array([ord(signs[b]) for b in range(256)], "<u2")
        self._join(signs)
        self.forget()

    def _join(self, signs: dict[int, str]) -> None:
        """Whether the model may read many words at once: no token of it reaches from a Latin letter into a space or line break, or from a line break into a letter."""
        model, vocabulary = self.library.model, self.library.get_vocab(with_added_tokens=False)
        newline, whole = signs[10], type(self.library.model).__name__ == "BPE"
        rest, two = "".join(signs[b] for b in range(0x80, 0xC0)), "".join(signs[b] for b in range(0xC3, 0xCA))
        crossing = re.compile(f"(?m:(?:[A-Za-z]|[{two}][{rest}]|^[{rest}])[{self.space}{newline}]|{newline}[A-Za-z{two}])")
        whole = whole and not (model.dropout or model.continuing_subword_prefix or model.end_of_word_suffix or model.ignore_merges)
        self.joins = self.by_bytes and whole and not crossing.search("\n".join(vocabulary))
        # Words begin where one of these tokens stands.
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.begins[[i for t, i in vocabulary.items() if t[:1] in (self.space, newline)]] = True

    #: Pieces to keep where memory is shared with other work; None: ``STORE``.
    store: int | None = None

    @classmethod
    def of(cls, path: str, store: int | None = None) -> Encoder:
        if path not in cls._known:
            cls._known[path] = cls(path, plain_specials=False)
        cls._known[path].store = store
        return cls._known[path]

    @classmethod
    def drop(cls, path: str) -> None:
        """Lets go of this worker's encoder and all it keeps; the next :meth:`of` reads the file again."""
        cls._known.pop(path, None)

    def forget(self) -> None:
        # Keys: a piece after a space is kept without it; one after a line break with it; the first of a text after a zero character;
        # one that follows a letter or digit after the sign for that.
        self.place: dict[str, int] = {}
        self.signs_ids: dict[str, list[int]] = {}
        # Place 0 is a piece without ids, for those that are read with more care.
        self.starts, self.sizes, self.ids = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, self.kind)
        self.came_again = np.zeros(1, bool)
        # Of short pieces: their first and last eight bytes and their length, 0 for others, and a table of their places.
        self.first, self.last, self.bytes = np.zeros(1, np.uint64), np.zeros(1, np.uint64), np.zeros(1, np.uint8)
        self._deal()

    def thin_out(self) -> None:
        """Lets go of the pieces that were met once only, of all if too few were."""
        self.came_again[0] = True
        stays = np.flatnonzero(self.came_again)
        if len(stays) > (self.store or STORE) // 2:
            return self.forget()
        new = np.full(len(self.sizes), -1, np.int64)
        new[stays] = np.arange(len(stays))
        # The keys that stay are shared with the old store, not copied.
        at = np.fromiter(self.place.values(), np.int64, len(self.place))
        at = np.where(at < 0, -1, new[at])
        self.place = dict(zip(compress(self.place, (at >= 0).tolist()), at[at >= 0].tolist(), strict=True))
        self._describe(np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * 3)
        self.ids, ends = self._gather(stays)
        self.sizes = self.sizes[stays]
        self.starts = ends - self.sizes
        self.came_again = np.zeros(len(stays), bool)
        self.first, self.last, self.bytes = self.first[stays], self.last[stays], self.bytes[stays]
        self._deal()

    def _has_added(self, text: str) -> bool:
        if self.added is None:
            return False
        normal = self.library.normalizer
        return bool(self.added.search(text) or normal is not None and self.added.search(normal.normalize_str(text)))

    def _whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _signs(self, signs: str) -> list[int]:
        if signs not in self.signs_ids:
            self.signs_ids[signs] = self._whole(signs)
        return self.signs_ids[signs]

    def _ids(self, key: str) -> list[int]:
        """Ids of a piece by the library, words of Latin letters by its model alone."""
        if key[0] == _GLUED:
            return self._whole(key[1:])
        lead = key[0] if key[0] in "\n\x00" else ""
        rest = key[1:] if lead else key
        letters = rest.rstrip(_SIGNS) if self.by_bytes else ""
        spelled = self._spelled(letters)
        if not spelled:
            return self._whole(rest if lead == "\x00" else lead + rest if lead else f" {rest}")
        ids = [t.id for t in self.library.model.tokenize(spelled if lead else self.space + spelled)]
        if len(letters) < len(rest):
            ids = ids + self._signs(rest[len(letters) :])
        return self.newline + ids if lead == "\n" else ids

    def _spelled(self, letters: str) -> str:
        """Latin letters as the vocabulary writes their bytes; empty if any is not one."""
        try:
            return "".join(map(self.spelling.__getitem__, letters))
        except KeyError:
            return ""

    def _learn(self, keys: list[str]) -> None:
        known, place, signs, space, tokenize = len(self.sizes), self.place, self._signs, self.space, self.library.model.tokenize
        flat: list[int] = []
        ends = [0]
        for key in keys:
            # Most pieces are words after a space, with signs after them or without.
            letters = key.rstrip(_SIGNS) if self.by_bytes else ""
            spelled = letters if letters.isascii() and letters.isalpha() else self._spelled(letters)
            if not spelled:
                rest = key[1:] if key[:1] in ("\n", "\x00", _GLUED) else key
                if not rest or rest[0] <= " " or rest[0].isspace():
                    place[key] = _CAREFUL
                    continue
                flat.extend(self._ids(key))
            elif len(letters) == len(key):
                if key in place:  # learned with signs after it
                    continue
                flat.extend(map(_ID, tokenize(space + spelled)))
            else:
                at = place.get(letters)
                if at is None:  # the word may come again with other signs
                    flat.extend(map(_ID, tokenize(space + spelled)))
                    place[letters] = at = known + len(ends) - 1
                    ends.append(len(flat))
                if at < known:
                    flat.extend(self.ids[self.starts[at] : self.starts[at] + self.sizes[at]].tolist())
                else:
                    flat.extend(flat[ends[at - known] : ends[at - known + 1]])
                flat.extend(signs(key[len(letters) :]))
            place[key] = known + len(ends) - 1
            ends.append(len(flat))
        self._keep(np.array(flat, self.kind), np.array(ends, np.int64))

    def _keep(self, ids: np.ndarray, ends: np.ndarray) -> None:
        """Gives places to new pieces: their ids one after the other, and 0 and the end of each."""
        self.starts = np.concatenate([self.starts, len(self.ids) + ends[:-1]])
        self.sizes = np.concatenate([self.sizes, np.diff(ends)])
        self.ids = np.concatenate([self.ids, ids])
        self.came_again = np.concatenate([self.came_again, np.zeros(len(ends) - 1, bool)])

    def _learn_words(self, raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place of each new piece that is Latin letters after a space or a line break, -1 for others; the model reads many of them at once."""
        at = np.full(len(start), -1, np.int64)
        if not self.joins:
            return at
        # Each with the byte before it, which is a space in front of words and line breaks.
        size = end - start + 1
        heads = np.cumsum(size) - size
        text = np.frombuffer(raw, np.uint8)[np.repeat(start - 1 - heads, size) + np.arange(size.sum())]
        odd = ~_IS_LATIN[text]
        odd[1:] |= _times(text[:-1], text[1:])
        odd[heads] = text[heads] != 32
        lines = heads[(text[heads + 1] == 10) & (size > 2)] + 1
        odd[lines] = False
        fine = ~np.logical_or.reduceat(odd, heads)
        n = int(fine.sum())
        if not n:
            return at
        text = text[np.repeat(fine, size)]
        keys = text.tobytes().decode().split(" ")[1:]
        # A line break stands for itself, without the space before it.
        text = text[np.append((text[:-1] != 32) | (text[1:] != 10), True)]
        heads = np.append(np.flatnonzero((text == 32) | (text == 10)), len(text)).tolist()
        spelled, tokenize = self.written[text].tobytes().decode("utf-16-le"), self.library.model.tokenize
        flat: list[int] = []
        for i in range(0, n, _WORDS):
            flat.extend(map(_ID, tokenize(spelled[heads[i] : heads[min(i + _WORDS, n)]])))
        ids = np.array(flat, self.kind)
        begins = np.flatnonzero(self.begins[ids])
        if len(begins) != n or begins[0]:  # a vocabulary without some byte
            return at
        at[fine] = len(self.sizes) + np.arange(n)
        self.place.update(zip(keys, at[fine].tolist(), strict=True))
        self._keep(ids, np.append(begins, len(ids)))
        return at

    def _places(self, pieces: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.place.get, pieces, repeat(-1)), np.int64, len(pieces))
        self.came_again[at[at >= 0]] = True
        missing = np.flatnonzero(at == -1).tolist()
        if missing:
            self._learn(list(dict.fromkeys(pieces[i] for i in missing)))
            at[missing] = [self.place[pieces[i]] for i in missing]
        return at

    def _find(self, first: np.ndarray, last: np.ndarray, size: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Place of each short piece; -1 if the table has none. Pieces are compared in full, not by their code."""
        at = np.full(len(code), -1, np.int64)
        rows, slot = np.arange(len(code)), (code >> np.uint64(64 - self.table_bits)).astype(np.int64)
        while len(rows):
            held = self.table[slot]
            known = held >= 0
            rows, slot, held = rows[known], slot[known], held[known]
            same = (self.first[held] == first[rows]) & (self.last[held] == last[rows]) & (self.bytes[held] == size[rows])
            at[rows[same]] = held[same]
            rows, slot = rows[~same], (slot[~same] + 1) & (len(self.table) - 1)
        return at

    def _enter(self, places: np.ndarray) -> None:
        """Puts places whose piece is described into the table; of several that want one slot, one gets it."""
        code = mixed(self.first[places], self.last[places], self.bytes[places].astype(np.uint64))
        slot = (code >> np.uint64(64 - self.table_bits)).astype(np.int64)
        while len(places):
            free = self.table[slot] < 0
            self.table[slot[free]] = places[free]
            out = self.table[slot] != places
            places, slot = places[out], (slot[out] + 1) & (len(self.table) - 1)

    def _describe(self, places: np.ndarray, first: np.ndarray, last: np.ndarray, size: np.ndarray) -> None:
        """Enters short pieces at their places; the table is dealt anew when half full."""
        more = len(self.sizes) - len(self.bytes)
        self.first, self.last = (np.append(x, np.zeros(more, np.uint64)) for x in (self.first, self.last))
        self.bytes = np.append(self.bytes, np.zeros(more, np.uint8))
        self.first[places], self.last[places], self.bytes[places] = first, last, size
        if 2 * len(self.sizes) > len(self.table):
            self._deal()
        else:
            self._enter(places)

    def _deal(self) -> None:
        self.table_bits = max(16, int(4 * len(self.sizes)).bit_length())
        self.table = np.full(1 << self.table_bits, -1, np.int32)
        self._enter(np.flatnonzero(self.bytes))

    def _bounds(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Spaces, and signs that follow a letter or digit; which of them are signs."""
        text = np.frombuffer(raw, np.uint8)
        bounds = text == 32
        if self.by_bytes:
            signs = np.flatnonzero(_IS_SIGN[text])
            before, second = text[signs - 1], text[signs - 2]
            latin = (before & 0xC0 == 0x80) & (second >= 0xC3) & (second <= 0xC9) & ~_times(second, before)
            bounds[signs[_IS_WORD[before] | latin]] = True
        bounds = np.flatnonzero(bounds)
        return bounds, text[bounds] != 32

    def _places_in(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Place of each piece, and where pieces end.

        A piece of at most 16 bytes is known by its first and last eight and its length, and found for all at once; other pieces, and those met for the first time, as text.
        """
        padded = b" " * 8 + raw + b" " * 8
        bounds, glued = self._bounds(raw)
        start, end, glued = np.append(0, bounds + ~glued), np.append(bounds, len(raw)), np.append(False, glued)
        size = end - start
        eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        short = np.minimum(size, 8)
        first = eight[start + 8] & MASKS[short]
        last = np.where(size, eight[end] >> ((8 - np.maximum(short, 1)) * 8).astype(np.uint64), np.uint64(0))
        tag = size + 32 * glued
        code = mixed(first, last, tag.astype(np.uint64))
        at = np.full(len(size), _CAREFUL, np.int64)

        def as_text(rows: np.ndarray) -> list[str]:
            return [_GLUED * g + raw[a:b].decode() for a, b, g in zip(start[rows].tolist(), end[rows].tolist(), glued[rows].tolist(), strict=True)]

        rows = np.flatnonzero((size > 0) & (size <= 16))
        at[rows] = self._find(first[rows], last[rows], tag[rows], code[rows])
        self.came_again[at[at >= 0]] = True
        rows = rows[at[rows] < 0]
        while len(rows):
            _, one = np.unique(code[rows], return_index=True)
            new = rows[np.sort(one)]
            found = self._learn_words(raw, start[new], end[new])
            others = np.flatnonzero(found < 0)
            if len(others):
                found[others] = self._places(as_text(new[others]))
            plain = found >= 0
            self._describe(found[plain], first[new[plain]], last[new[plain]], tag[new[plain]])
            at[rows] = self._find(first[rows], last[rows], tag[rows], code[rows])
            rows = rows[at[rows] < 0]
            if not plain.all():  # pieces that are read with more care are in no table
                odd = np.isin(code[rows], code[new[~plain]])
                at[rows[odd]] = self._places(as_text(rows[odd]))
                rows = rows[~odd]
        rows = np.flatnonzero(size > 16)
        if len(rows):
            at[rows] = self._places(as_text(rows))
        return at, bounds

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after the other, and the end of each."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], ends

    def _carefully(self, text: str) -> np.ndarray:
        """Cuts only where a visible character follows a space, whatever white space stands elsewhere."""
        first, *rest = _CUT.split(text)
        return np.concatenate([np.array(self._whole(first), self.kind), self._gather(self._places(rest))[0]])

    def _call(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.place) > (self.store or STORE):
            self.thin_out()
        raws = [("\x00" + t.replace("\n", " \n")).encode() for t in texts]
        at, bounds = self._places_in(b" ".join(raws))
        stops = np.searchsorted(bounds, np.cumsum([len(r) + 1 for r in raws]) - 1) + 1
        care = at == _CAREFUL
        careful = np.logical_or.reduceat(care, np.append(0, stops[:-1])) | np.array(["\x00" in t for t in texts])
        ids, ends = self._gather(np.where(care, 0, at))
        edges = np.append(0, ends[stops - 1])
        return [self._carefully(t) if c else ids[edges[i] : edges[i + 1]] for i, (t, c) in enumerate(zip(texts, careful, strict=True))]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each whole text as unsigned integers; none for null and empty texts."""
        out: list[np.ndarray] = [np.zeros(0, self.kind)] * len(texts)
        waiting, size = [], 0
        for i, text in enumerate([*texts, None]):
            if text and self._has_added(text):
                out[i] = np.array(self._whole(text), self.kind)
            elif text:
                waiting.append(i)
                size += len(text)
            if waiting and (size > CALL or i == len(texts)):
                for k, ids in zip(waiting, self._call([texts[k] for k in waiting]), strict=True):
                    out[k] = ids
                waiting, size = [], 0
        return out


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
