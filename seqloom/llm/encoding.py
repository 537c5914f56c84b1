"""Token ids of whole texts with a public tokenizer, a few characters at a time."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of remembered pieces in a worker process, and the characters of the longest kept.
MEMO_BYTES, MEMO_CHARS = 8 << 20, 64
#: Characters of texts that are looked up together, and ids that are put in place together.
GROUP_CHARS, TAKE_IDS = 1 << 22, 1 << 19
#: Words in a line to the model: its cache takes short lines only, and these are new.
LINE_WORDS = 128

_WIDE_SPACE = re.compile(r"\s ")
_PIECES = re.compile(r"\s*\S+|\s+")
#: White space for Python that the tokenizers' patterns take as symbols.
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Letters, and signs that are in no contraction and no control string. Both files cut pieces of these where their kinds meet.
_LETTERS, _SIGNS, _ENDS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f", r"!-&(-/:;=-@\[-`{-~", "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
_BEYOND = "\u0130"
#: A key of a word or of signs alone: what both files give to their models as it stands.
_PLAIN = f"^\0?(?:[{_LETTERS}]+|[{_SIGNS}]+)$"
#: A word and the signs that follow it, the usual piece.
_WORD = rf"^(?P<stem>[{_LETTERS}]+)(?P<tail>[!-/:-@\[-`{{-~]*)$"
#: The model's letter for each byte. No text has the last byte; a line break keeps words apart.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = np.arange(256, dtype="<u2")
_BYTE_LETTERS[sorted({*range(256)} - {*_SHOWN})] = np.arange(256, 256 + 256 - len(_SHOWN))
_BYTE_LETTERS[10], _NO_BYTE = 10, "\xff"
_RUN = f"(?:[{_LETTERS}]++|[{_SIGNS}]++|[0-9]++)"
_MIXED = re.compile(f" ?+{_RUN}(?:\n?+{_RUN})*+\n?+|\n(?:{_RUN}\n?+)*+")
_PARTS = re.compile(f" ?{_RUN}|\n")


def _key(piece: str) -> str:
    return piece[1:] if piece[0] == " " else "\0" + piece


def _piece(key: str) -> str:
    return key[1:] if key[:1] == "\0" else " " + key


class _Ids(NamedTuple):
    """Ids of many pieces: those of piece k are ``flat[starts[k] : starts[k] + sizes[k]]``."""

    flat: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, flat: np.ndarray, sizes: np.ndarray) -> _Ids:
        """Of pieces that lie end to end."""
        return cls(flat, np.cumsum(sizes) - sizes, sizes)

    def take(self, at: np.ndarray) -> _Ids:
        """The pieces of these numbers, end to end."""
        new = _Ids.of(self.flat, self.sizes[at])
        return new._replace(flat=self.flat[np.repeat(self.starts[at] - new.starts, new.sizes) + np.arange(new.sizes.sum())])

    def join(self, other: _Ids) -> _Ids:
        """These and then the others."""
        return _Ids(*map(np.concatenate, ((self.flat, other.flat), (self.starts, other.starts + len(self.flat)), (self.sizes, other.sizes))))


def _bytes_of(pieces: list[bytes]) -> _Ids:
    sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) // 4
    return _Ids.of(np.frombuffer(b"".join(pieces), dtype="<u4"), sizes)


def _text(array: Iterable[str]) -> pa.Array:
    return pa.array(array, pa.large_string())


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit integers.

    Both tokenizer files cut a text before every space that follows something
    else than white space, so pieces between such places are encoded once and
    remembered. A new piece of letters, digits and signs is put together from
    its parts. Texts whose white space may be read in two ways are encoded as
    a whole. Control strings in a text become what the tokenizer makes of them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core already
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._memo, self._memo_ids = _text([]), _bytes_of([])
        # A control token between pieces keeps them apart as if each were a text.
        self._mark, self._mark_id = "<|endoftext|>", self._tokenizer.token_to_id("<|endoftext|>")
        # One file drops spaces and capitals.
        self._drops = self._tokenizer.encode(" a", add_special_tokens=False).tokens == ["a</w>"]
        # Words that a letter of no text and of no other token keeps apart are merged as if each were by itself.
        model, vocabulary = self._tokenizer.model, self._tokenizer.get_vocab(with_added_tokens=False)
        ends = model.end_of_word_suffix or model.continuing_subword_prefix or sum(_NO_BYTE in token for token in vocabulary) != 1
        self._apart = None if ends else vocabulary[_NO_BYTE]
        self._merger = Tokenizer(model)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _by_model(self, keys: list[str]) -> _Ids:
        """Ids of plain pieces, which are words to the model as they stand, in its letters for bytes."""
        text = "\n".join(keys).replace("\0", "").lower() if self._drops else (" " + "\n ".join(keys)).replace(" \0", "")
        words = _BYTE_LETTERS[np.frombuffer(text.encode(), dtype=np.uint8)].tobytes().decode("utf-16-le").split("\n")
        if self._apart is None:
            ids, sizes = array("I"), array("q")
            for tokens in map(self._tokenizer.model.tokenize, words):
                ids.extend([token.id for token in tokens])
                sizes.append(len(tokens))
            return _Ids.of(np.array(ids, dtype="<u4"), np.array(sizes, dtype=np.int64))
        lines = [_NO_BYTE.join([*words[at : at + LINE_WORDS], ""]) for at in range(0, len(words), LINE_WORDS)]
        flat = np.concatenate([np.array(self._merger.encode_batch_fast([line])[0].ids, dtype="<u4") for line in lines])
        cuts = flat == self._apart
        return _Ids.of(flat[~cuts], np.diff(np.flatnonzero(cuts), prepend=-1) - 1)

    def _by_mark(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces without control strings, encoded in one run with marks between."""
        raw = self._ids(self._mark.join(pieces))
        cuts = np.flatnonzero(raw == self._mark_id)
        if len(cuts) != len(pieces) - 1:
            return {}
        data, ends = raw.tobytes(), [*(4 * cuts).tolist(), 4 * len(raw)]
        return {p: data[a:b] for p, a, b in zip(pieces, [0, *(4 * cuts + 4).tolist()], ends, strict=True)}

    def _encode(self, keys: list[str]) -> _Ids:
        plain = pc.match_substring_regex(_text(keys), _PLAIN).to_numpy(zero_copy_only=False)
        found = self._by_model([keys[i] for i in np.flatnonzero(plain)]) if plain.any() else _bytes_of([])
        pieces = [_piece(keys[i]) for i in np.flatnonzero(~plain)]
        marked: dict[str, bytes] = {}
        if self._mark_id is not None and (some := [p for p in pieces if p and "<" not in p]):
            marked = self._by_mark(some)
        found = found.join(_bytes_of([marked[p] if p in marked else self._ids(p).tobytes() for p in pieces]))
        at = np.argsort(~plain, kind="stable").argsort()
        return found._replace(starts=found.starts[at], sizes=found.sizes[at])

    def _cut(self, text: str) -> list[str]:
        """Keys of the pieces of a text that spaces alone do not cut."""
        if "\0" not in text and _SEPARATORS.search(text) is None:
            return [_key(p) for p in _PIECES.findall(text)]
        return ["\0" + text]

    def _words(self, texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Keys of all pieces, and where each text's begin and end among them.
        Most pieces begin with a space, which their key leaves out; the keys of
        the others begin with a zero."""
        counts = np.zeros(len(texts), dtype=np.int64)
        simple = [i for i, t in enumerate(texts) if t and "\0" not in t and _WIDE_SPACE.search(t) is None]
        split = pc.split_pattern(pa.array(["\0" + texts[i] for i in simple], pa.large_string()), " ")
        counts[simple] = split.value_lengths().to_numpy()
        alone = set(simple)
        rest = [i for i, t in enumerate(texts) if t and i not in alone]
        cut = [self._cut(texts[i]) for i in rest]
        counts[rest] = list(map(len, cut))
        words = pa.concat_arrays([split.flatten(), pa.array([k for keys in cut for k in keys], pa.large_string())])
        order = np.array(simple + rest, dtype=np.int64)
        ends = np.zeros(len(texts), dtype=np.int64)
        ends[order] = np.cumsum(counts[order])
        return words, ends - counts, ends

    def _parts(self, key: str) -> list[str]:
        """Keys of a piece's parts: letters, digits and signs, which both files encode by themselves."""
        piece = _piece(key)
        if _MIXED.fullmatch(piece) is None:
            return [key]
        if self._drops:
            return [p.lstrip(" ").lower() if p != "\n" else "\0\n" for p in _PARTS.findall(piece)]
        return list(map(_key, _PARTS.findall(piece)))

    def _all_parts(self, keys: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Keys of the parts of all pieces, piece by piece, and how many each has."""
        word = pc.extract_regex(keys, _WORD)
        usual = word.is_valid()
        stem, tail = (pc.struct_field(word.filter(usual), k) for k in ("stem", "tail"))
        ends = pc.not_equal(tail, "")
        tail = tail.filter(ends)
        if self._drops:
            stem = pc.utf8_lower(stem)
        else:
            tail = pc.binary_join_element_wise(_text(["\0"])[0], tail, _text([""])[0])
        rest = [self._parts(k) for k in keys.filter(pc.invert(usual)).to_pylist()]
        usual, ends = usual.to_numpy(zero_copy_only=False), ends.to_numpy(zero_copy_only=False)
        counts = np.empty(len(keys), dtype=np.int64)
        counts[usual] = 1 + ends
        counts[~usual] = list(map(len, rest))
        own, others = np.flatnonzero(usual), np.flatnonzero(~usual)
        owner = np.concatenate([own, own[ends], np.repeat(others, counts[others])])
        parts = pa.concat_arrays([stem, tail, _text([k for keys in rest for k in keys])])
        return parts.take(pa.array(np.argsort(owner, kind="stable"))), counts

    def _told(self, keys: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Each key's number, remembered pieces first, and the different keys that follow those."""
        told = pa.concat_arrays([self._memo, keys]).dictionary_encode()
        n = len(self._memo)
        return told.indices.to_numpy(zero_copy_only=False)[n:], told.dictionary[n:]

    def _remember(self, keys: pa.Array, ids: _Ids) -> None:
        held = lambda k, i: k.nbytes + i.flat.nbytes + i.starts.nbytes + i.sizes.nbytes
        if held(self._memo, self._memo_ids) + held(keys, ids) > MEMO_BYTES:  # what came first is the most frequent
            n = len(self._memo) // 2
            self._memo, self._memo_ids = pa.concat_arrays([self._memo[:n]]), self._memo_ids.take(np.arange(n))
        if held(self._memo, self._memo_ids) + held(keys, ids) <= MEMO_BYTES:
            self._memo, self._memo_ids = pa.concat_arrays([self._memo, keys]), self._memo_ids.join(ids)

    def _group(self, texts: list[str | None]) -> Iterator[bytes]:
        words, begins, ends = self._words(texts)
        codes, gaps = self._told(words)
        parts, counts = self._all_parts(gaps)
        part_codes, fresh = self._told(parts)
        new = self._encode(fresh.to_pylist())
        of_parts = self._memo_ids.join(new).take(part_codes)
        # A gap's ids are those of its parts, which lie end to end.
        at = np.concatenate([[0], np.cumsum(of_parts.sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        gap_ids = _Ids(of_parts.flat, at[:-1], np.diff(at))
        ids = self._memo_ids.join(gap_ids)
        # Remembered before the first text is given out: another group may begin in between.
        short = pc.less_equal(pc.utf8_length(fresh), MEMO_CHARS)
        times = np.bincount(codes, minlength=len(self._memo) + len(gaps))[len(self._memo) :]
        again = pc.and_not(pc.and_(pa.array(times > 1), pc.less_equal(pc.utf8_length(gaps), MEMO_CHARS)), pc.is_in(gaps, value_set=fresh))
        kept = [new.take(np.flatnonzero(short.to_numpy(zero_copy_only=False))), gap_ids.take(np.flatnonzero(again.to_numpy(zero_copy_only=False)))]
        self._remember(pa.concat_arrays([fresh.filter(short), gaps.filter(again)]), kept[0].join(kept[1]))
        n = ids.sizes[codes]
        at = np.concatenate([[0], np.cumsum(n)])
        first = 0  # each run of texts is put together by itself
        while first < len(texts):
            last = first + 1
            tokens = at[ends[first]] - at[begins[first]]
            while last < len(texts) and begins[last] == ends[last - 1] and (tokens := tokens + at[ends[last]] - at[begins[last]]) <= TAKE_IDS:
                last += 1
            run = ids.take(codes[begins[first] : ends[last - 1]]).flat
            for a, b in zip((at[begins[first:last]] - at[begins[first]]).tolist(), (at[ends[first:last]] - at[begins[first]]).tolist(), strict=True):
                yield run[a:b].tobytes()
            first = last

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, in order; a null text has none."""
        group, chars = [], 0
        for text in texts:
            group.append(text)
            chars += len(text or "")
            if chars >= GROUP_CHARS:
                yield from self._group(group)
                group, chars = [], 0
        yield from self._group(group)

    def encode(self, text: str | None) -> bytes:
        return next(self._group([text]))


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path)


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
