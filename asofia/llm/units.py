"""Cutting texts where a byte-level tokenizer can never join the two sides.

The split pattern of the byte-level vocabularies attaches one space to the word
after it. A cut before a space that follows a non-space, or before the last
space of a run in front of a word, is therefore a cut of the pattern too, and
each unit can be encoded once and looked up afterwards.

A unit's key is its text without the leading space, or a one-tuple of its text
if it has none.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
from collections import defaultdict
from itertools import count, islice

import numpy as np

# A space between two spaces, or after one at the end: simple splitting would cut a run.
INSIDE_RUN = re.compile(r"\s (?:\s|\Z)")
BEFORE_SPACE = re.compile(r" (?:\s|\Z)")   # the same without its first character: rare, and found faster
AFTER_WORD = re.compile(r"(?<=\S)(?= )")
BESIDE_FEED = re.compile(r"\n(?:\s|(?<=\s\n))")   # a line feed with another space beside it
# letters in every version of Unicode that a library may follow
WORD = re.compile("[A-Za-zªµºÀ-ÖØ-öø-ɏ]+")
SYMBOLS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"   # after a letter a match of their own; an apostrophe may belong to what follows
FEED = ("\n",)   # key of a line feed
# Distinct units that a worker keeps; beyond that, those that were met only once go.
MOST_UNITS = 1_200_000
JOINED = 1_024   # units that go through the library in one text


def keys_of(text: str) -> list:
    """Keys of the units of a text, in order; their texts joined give the text again."""
    if BEFORE_SPACE.search(text) and INSIDE_RUN.search(text):
        return [u[1:] if u[:1] == " " else (u,) for u in AFTER_WORD.split(text)]
    keys = text.split(" ")
    keys[0] = (keys[0],)
    return keys


def text_of(key) -> str:
    return key[0] if type(key) is tuple else " " + key


def line_keys(text: str) -> list:
    """As keys_of, but a line feed between two words begins a unit as well; the key of that unit begins with it."""
    if "\n" not in text:
        return keys_of(text)
    if (BEFORE_SPACE.search(text) and INSIDE_RUN.search(text)) or BESIDE_FEED.search(text):
        return [u[1:] if u[:1] == " " and u[1:2] != "\n" else (u,) for u in AFTER_WORD.split(text)]
    keys = text.replace("\n", " \n").split(" ")
    keys[0] = (keys[0],)
    return keys


class Numbering(dict):
    """Number of each key; new keys are remembered in `fresh` until they are handled."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list = []

    def __missing__(self, key) -> int:
        n = self[key] = len(self)
        self.fresh.append(key)
        return n


class TokenIds:
    """Token ids of texts by the tokenizers library, each distinct unit encoded once.

    With `whole_added` a text that holds an added token of the vocabulary
    (<|endoftext|>) gets its one id, as the library does by default; without,
    it is spelled out like any other text.
    """

    def __init__(self, path: str, whole_added: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # Spark has a task for every core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit, Sequence
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not whole_added
        self.whole = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if whole_added else []
        for t in self.tokenizer.get_added_tokens_decoder().values() if whole_added else ():
            if re.search(r"[\s,.]", t.content) or WORD.search(t.content) and t.content.isalpha() or t.single_word or t.lstrip or t.rstrip:   # it could reach into another unit
                raise ValueError(f"added token {t.content!r} does not lie inside one unit")
        self.line_feed = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        # the same merges for words, each of which is one match, without a search for matches
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = Sequence([CharDelimiterSplit("\n"), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int32)   # a token has a character for each byte
        self.n_bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.reset()

    def reset(self) -> None:
        self._numbered(())
        self.lens, self.starts, self.hits = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0

    def _numbered(self, keys) -> None:
        """Numbers of the keys in order; a key that is looked up and not known gets the next one."""
        self.number = defaultdict(None, zip(keys, range(len(keys))))
        self.number.default_factory = count(len(keys)).__next__

    def shrink(self) -> None:
        """Keep the units that were met more than once."""
        keep = np.flatnonzero(self.hits > 1)
        keys, lens, starts = list(self.number), self.lens, self.starts
        if 2 * len(keep) > MOST_UNITS:
            return self.reset()
        ids = self.ids[:self.used]
        self.reset()
        self._numbered([keys[i] for i in keep.tolist()])
        self.lens, self.hits = lens[keep], np.ones(len(keep), np.int32)
        ends = np.cumsum(self.lens, dtype=np.int64)
        self.starts, self.used = ends - self.lens, int(ends[-1]) if len(keep) else 0
        self.ids = ids[np.arange(self.used) + np.repeat(starts[keep] - self.starts, self.lens)] if len(keep) else np.zeros(1 << 16, np.int32)

    def _add(self) -> None:
        """Settle new units: words and odd ones by the library, the others as two units in a row."""
        first = len(self.lens)
        fresh: list = []
        words, odd, ended, fed = [], [], ([], [], []), ([], [], [])
        while (more := len(self.number) - first - len(fresh)):   # once more for the parts of the units before
            seen = len(fresh)
            fresh += list(islice(reversed(self.number), more))[::-1]
            for i, k in enumerate(islice(fresh, seen, None), seen):
                t = k if type(k) is str else k[0]
                if t.isalpha() and (t.isascii() or WORD.fullmatch(t)):
                    words.append(i)
                    continue
                if type(k) is str and t[:1] == "\n" and len(t) > 1:
                    row, left, right = fed, FEED, (t[1:],)
                else:
                    head = t.rstrip(SYMBOLS)
                    if len(head) == len(t) or not head[-1:].isalpha() or any(c in t for c in self.whole):
                        odd.append(i)
                        continue
                    row, left, right = ended, head if type(k) is str else (head,), (t[len(head):],)
                row[0].append(first + i)
                row[1].append(self.number[left])
                row[2].append(self.number[right])
        n = len(fresh)
        self.starts = np.concatenate([self.starts, np.zeros(n, np.int64)])
        self.lens = np.concatenate([self.lens, np.zeros(n, np.int32)])
        self.hits = np.concatenate([self.hits, np.zeros(n, np.int32)])
        for some, encoded in ((words, self._words), (odd, self._odd)):
            if some:
                at = first + np.array(some)
                self._keep(at, *encoded([k if k == "\n" else text_of(k) for k in map(fresh.__getitem__, some)]))
        for pairs in (ended, fed):   # what follows a line feed may be ended itself
            if pairs[0]:
                at, *parts = map(np.array, pairs)
                parts = np.stack(parts, 1).ravel()
                lens = self.lens[parts]
                ends = np.cumsum(lens, dtype=np.int64)
                ids = self.ids[np.arange(ends[-1]) + np.repeat(self.starts[parts] - (ends - lens), lens)]
                self._keep(at, ids, lens[::2] + lens[1::2])

    def _keep(self, at: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> None:
        if self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, max(2 * len(self.ids), self.used + len(ids)))
        self.ids[self.used:self.used + len(ids)] = ids
        self.lens[at], self.starts[at] = lens, self.used + np.cumsum(lens, dtype=np.int64) - lens
        self.used += len(ids)

    def _words(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of words; the bytes of the tokens tell where each ends."""
        joined = ["\n".join(texts[i:i + JOINED]) for i in range(0, len(texts), JOINED)]
        ids = np.concatenate([np.array(e.ids, np.int32) for e in self.words.encode_batch_fast(joined, add_special_tokens=False)])
        raw = np.frombuffer("\n".join(joined).encode(), np.uint8)
        ends = np.r_[np.flatnonzero(raw == 10), len(raw)] - np.arange(len(texts))
        told = np.cumsum(self.n_bytes[ids], dtype=np.int64)
        stops = np.searchsorted(told, ends)
        if not (len(told) and told[-1] == ends[-1] and (told[stops] == ends).all()):
            raise ValueError("the tokens of this vocabulary do not spell the bytes of a word")
        return ids, np.diff(np.r_[-1, stops])

    def _odd(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of any units, in order."""
        # many go through the library in one text, each closed by a line feed, which no other match can reach over
        # or, before more than one space, could
        alone = np.array([("\n" in t or "<|" in t or t[-1:].isspace() or not t or t[t[0] == " ":][:1].isspace()) for t in texts], bool)
        closed = [t for t, x in zip(texts, alone.tolist()) if not x]
        joined = ["\n".join(closed[i:i + JOINED]) + "\n" for i in range(0, len(closed), JOINED)]
        flat = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        stops = np.flatnonzero(ids == self.line_feed)
        if len(stops) != len(closed):
            raise ValueError("this vocabulary joins line feeds with other characters")
        pieces = iter(np.split(ids, stops + 1))
        made = iter(self.tokenizer.encode_batch_fast([t for t, x in zip(texts, alone.tolist()) if x], add_special_tokens=False))
        own = [np.array(next(made).ids, np.int32) if x else next(pieces)[:-1] for x in alone.tolist()]
        return np.concatenate(own), np.array(list(map(len, own)))

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each text; a null text has none."""
        if not texts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if len(self.number) > MOST_UNITS:
            self.shrink()
        keys, counts = [], []
        for t in texts:
            own = line_keys(t or "")
            counts.append(len(own))
            keys += own
        at = np.fromiter(map(self.number.__getitem__, keys), np.int32, len(keys))
        if len(self.number) > len(self.lens):
            self._add()
        self.hits += np.bincount(at, minlength=len(self.hits)).astype(np.int32)
        lens = self.lens[at]
        ends = np.cumsum(lens, dtype=np.int64)
        total = int(ends[-1])
        where = np.arange(total) + np.repeat(self.starts[at] - (ends - lens), lens)
        first = np.cumsum(counts) - counts
        return self.ids[where], np.add.reduceat(lens, first, dtype=np.int64)


_MADE: dict = {}


def forget() -> None:
    """Free what the worker keeps, and hand the memory back where the C library can."""
    if _MADE:
        _MADE.clear()
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def once(kind, *args):
    """One object for each worker, kept from task to task; another kind takes its place."""
    if (kind, args) not in _MADE:
        forget()
        _MADE[kind, args] = kind(*args)
    return _MADE[kind, args]
