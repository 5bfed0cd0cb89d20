"""Exact, memoised encoding with the tokenizers library.

Neither tokenizer lets a token cross the points at which :class:`Encoder` cuts a
text, so encoding the pieces one by one and joining the ids gives exactly the
ids of the whole text.  A text that holds the string of a special token is encoded
by the plain call as a whole.  Real text repeats its words: each piece is encoded once
and remembered as the bytes of its ids; Arrow finds the distinct pieces of a batch and
joins the ids.  Of a word with marks behind it the word alone is remembered.  Words of
plain letters go to the tokenizer's model as its pre-tokenizer would give them.
"""

from __future__ import annotations

import codecs
import os
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

from . import common

#: Pieces that one encoder remembers (bounds its memory); those not met for half as many new ones go.
MEMO_PIECES = 900_000
#: Longer pieces are encoded but not remembered.
MEMO_CHARS = 64
#: Different marks behind words that one encoder remembers before it starts anew.
MEMO_TAILS = 20_000

#: A lone space between two characters that are not white space.
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: What keeps a text from being cut at every space: runs of white space but newlines, white space at an end, other white space.
_RUNS = r"^[ \n]| $|  | \n|\n |[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: A word of letters that no Unicode version or normalisation takes apart, a newline before it or none, and a few marks behind it.
_WORD = re.compile(r"(\n?[A-Za-zÀ-ÖØ-öø-įı-ſЀ-џ]{1,%d})([!-&(-/:-@\[-`{-~]{0,4})" % (MEMO_CHARS - 1))


def _byte_letters() -> str:
    """The letter by which byte-level models write each byte; a space stays one, byte 1 is written as a space is."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    letters = [chr(b if b in plain else next(other)) for b in range(256)]
    letters[1], letters[0x20] = letters[0x20], " "
    return "".join(letters)


_LETTERS = _byte_letters()


class Encoder:
    """Encodes texts to the little-endian bytes of their ids, without special tokens.

    ``leading_space``: the tokenizer is byte-level and keeps a space with the word
    behind it (``byte_bpe_50k.json``); otherwise it drops white space
    (``word_bpe_49k.json``).  Strings of special tokens in a text become these tokens, as
    in the library's plain call; with ``ordinary`` they are text like any other.
    """

    def __init__(self, name: str, dtype: str = "<u4", end: int | None = None, ordinary: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.tokenizer.encode_special_tokens = ordinary
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Normalisation may change the case of what it finds.
        self.special = re.compile("|".join(map(re.escape, added)), re.I) if added and not ordinary else None
        # What all of them begin with, as far as it has no case: looked for first, as that is cheap.
        self.hint = re.match(r"[\W_]*", os.path.commonprefix(added)).group()
        self.leading_space = name.startswith("byte_")
        self.mark, self.join = ("\x0b", "\x0b") if self.leading_space else ("\x7f", " \x7f ")
        self.mark_id = self.tokenizer.encode(self.mark, add_special_tokens=False).ids[0]
        self.dtype = np.dtype(dtype)
        if self.tokenizer.get_vocab_size(with_added_tokens=True) > np.iinfo(self.dtype).max + 1:
            raise ValueError(f"the ids of {name} don't fit {dtype}")
        self.end = b"" if end is None else np.array([end], self.dtype).tobytes()
        # The same model without normaliser and pre-tokenizer: given words apart, in letters for bytes.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = CharDelimiterSplit(" ")
        # The ids with which a word begins (byte-level) or ends.
        self.edge = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.edge[i] = token[0] == _LETTERS[1] or token == _LETTERS[10] if self.leading_space else token.endswith("</w>")
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}

    def _merge(self, words: list[str]) -> list[bytes]:
        """Ids of each word (the letters of ``_WORD``), with the space before it where it has one."""
        out: list[bytes] = []
        width = self.dtype.itemsize
        runs = [words[i : i + 256] for i in range(0, len(words), 256)]
        if self.leading_space:
            joined = [" ".join(["\x01" + x for x in run]).replace("\x01\n", "\n ") for run in runs]
        else:
            joined = [" ".join(run).lower() for run in runs]
        joined = [codecs.charmap_decode(x.encode(), "strict", _LETTERS)[0] for x in joined]
        for e in self.bare.encode_batch_fast(joined, add_special_tokens=False):
            ids = np.array(e.ids, self.dtype)
            raw, at = ids.tobytes(), (np.flatnonzero(self.edge[ids]) * width).tolist()
            starts, ends = (at, [*at[1:], len(raw)]) if self.leading_space else ([0, *(x + width for x in at[:-1])], [x + width for x in at])
            out += [raw[a:b] for a, b in zip(starts, ends)]
        if len(out) != len(words):
            raise AssertionError("a word has no edge of its own")
        return out

    def _encode(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece.  The pieces go through the tokenizer as a few texts, kept
        apart by a mark that is always a token of its own, which costs less than a call
        for each; pieces that hold the mark themselves go one by one."""
        out: list[bytes] = [b""] * len(pieces)
        plain = []
        for i, x in enumerate(pieces):
            if self.mark in x:
                out[i] = np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, self.dtype).tobytes()
            else:
                plain.append(i)
        width = self.dtype.itemsize
        runs = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        joined = [self.join.join([pieces[i] for i in run]) for run in runs]
        for run, e in zip(runs, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(e.ids, self.dtype)
            at = np.flatnonzero(ids == self.mark_id) * width
            raw = ids.tobytes()
            ends = [*at.tolist(), len(raw)]
            start = 0
            for i, end in zip(run, ends):
                out[i] = raw[start:end]
                start = end + width
        return out

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """The ids of each text as bytes, each with the end id behind."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string())
        if not len(texts):
            return []
        apart: dict[int, bytes] = {}
        if self.special is not None:
            for i in np.flatnonzero(pc.match_substring(texts, self.hint)).tolist():
                if self.special.search(text := texts[i].as_py()):
                    apart[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes() + self.end
        if self.leading_space:
            spaced = [i for i in np.flatnonzero(pc.match_substring_regex(texts, _RUNS)).tolist() if i not in apart]
            apart.update(zip(spaced, self._encode_spaced([texts[i].as_py() for i in spaced])))
        if apart:
            mask = np.zeros(len(texts), bool)
            mask[list(apart)] = True
            texts = pc.if_else(pa.array(mask), pa.scalar("", texts.type), texts)
        out = self._encode_cut(texts)
        for i, ids in apart.items():
            out[i] = ids
        return out

    def _encode_cut(self, texts: pa.Array) -> list[bytes]:
        """The same for texts that can be cut at every space, and at newlines that are alone."""
        if self.leading_space:
            # A piece has a space before it, left out here, or a newline, which is kept.  What a
            # text begins with has neither: it gets a newline, whose id is dropped again.
            lines = pc.if_else(pc.match_substring(texts, "\n\n"), texts, pc.replace_substring(texts, "\n", " \n"))
            texts, drop = pc.binary_join_element_wise(pa.scalar("\n", texts.type), lines, pa.scalar("", texts.type)), self.dtype.itemsize
        else:
            texts, drop = pc.replace_substring(texts, "\n", " "), 0
        cuts = pc.split_pattern(texts, " ")
        pieces = cuts.values.dictionary_encode()
        ids = pa.array(self._look_up(pieces.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(pieces.indices)
        _, offsets, raw = ids.buffers()
        at = np.frombuffer(offsets, np.int64)[cuts.offsets.to_numpy()].tolist()
        raw = memoryview(raw)
        return [b"".join((raw[a + drop : b], self.end)) for a, b in zip(at, at[1:])]

    def _encode_spaced(self, texts: list[str]) -> list[bytes]:
        """The same for texts with runs of white space, which are cut at lone spaces."""
        cuts = [_LONE_SPACE.split(t) for t in texts]
        heads = self._encode([c[0] for c in cuts])
        pieces = list({x for c in cuts for x in c[1:]})
        get = dict(zip(pieces, self._look_up(pieces))).__getitem__
        return [h + b"".join(map(get, c[1:])) + self.end for h, c in zip(heads, cuts)]

    def _look_up(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, from memory or by the tokenizer."""
        if len(self.memo) > MEMO_PIECES // 2:
            self.old, self.memo = self.memo, {}
        if len(self.tails) > MEMO_TAILS:
            self.tails = {"": b""}
        memo, old, tails = self.memo, self.old, self.tails
        out = list(map(memo.get, pieces))
        new, odd = set(), []
        at, words, ends = [], [], []  # not tuples, which the garbage collector would look through
        for i in [i for i, ids in enumerate(out) if ids is None]:
            x = pieces[i]
            if x in old:
                out[i] = memo[x] = old[x]
            elif m := _WORD.fullmatch(x):
                word, tail = m.groups()
                at.append(i)
                words.append(word)
                ends.append(tail)
                if word not in memo:
                    if word in old:
                        memo[word] = old[word]
                    else:
                        new.add(word)
            else:
                odd.append(i)
        new = list(new)
        memo.update(zip(new, self._merge(new)))
        unknown = [tail for tail in set(ends) if tail not in tails]
        tails.update(zip(unknown, self._encode(unknown)))
        for i, word, tail in zip(at, words, ends):
            out[i] = memo[word] + tails[tail]
        coded = self._encode([" " + pieces[i] if self.leading_space and pieces[i][:1] != "\n" else pieces[i] for i in odd])
        for i, ids in zip(odd, coded):
            out[i] = ids
            if len(pieces[i]) <= MEMO_CHARS:
                memo[pieces[i]] = ids
        return out

    def batches(self, texts: pa.Array, size: int = 1 << 22):
        """(index of the first text, its bytes and the next ones'), some ``size`` bytes at a time."""
        start, held = 0, 0
        for i, n in enumerate(pc.binary_length(texts).to_pylist()):
            held += n
            if held >= size or i == len(texts) - 1:
                yield start, self.encode(texts.slice(start, i + 1 - start))
                start, held = i + 1, 0


_ENCODERS: dict[tuple, Encoder] = {}
common.CACHES.append(_ENCODERS)


def encoder(name: str, dtype: str, end: int | None, ordinary: bool = False) -> Encoder:
    """One encoder for each worker process and setting."""
    key = (name, dtype, end, ordinary)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(name, dtype, end, ordinary)
    return _ENCODERS[key]
