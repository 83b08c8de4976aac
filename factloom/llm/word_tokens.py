"""Token ids of whole texts by the word tokenizer, each distinct piece encoded once.

The tokenizer never looks across white space, nor between a run of letters and a run of signs. So a text is cut at
ASCII white space, and a chunk that holds only Latin letters and plain signs is cut further into its runs; any other
chunk (digits, apostrophes, ``<``, other scripts, combining marks) is one unit. Each distinct unit is encoded once and
remembered; the ids of a text are gathered from there. Units are told apart by 64-bit hashes: among the quarter million
that a worker remembers, two share one with a chance of 2e-9. All are forgotten when they grow too many.
"""

from __future__ import annotations

import os

import numpy as np

from .kernels import SOLID, Block, SpanHash, find_words, ranges

REMEMBERED = 1 << 18
_JOINED = 1000  # units encoded as one string
_BATCH = 8  # such strings encoded at once; the tokenizer's own objects are large

# 1: ASCII letter, 2: sign that never joins a contraction or a special token, 0: anything else
_CLASS = np.array([1 if chr(b).isalpha() else 2 if 0x21 <= b <= 0x7E and not chr(b).isalnum() and chr(b) not in "'<|>" else 0 for b in range(128)] + [0] * 128, np.uint8)


def _units(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, whether a unit is one run (letters or signs), and the first unit of every row."""
    data, words = block.data, find_words(block, SOLID)
    kind = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)
    trail = data[lead + 1]
    lead = lead[(trail >= 0x80) & (trail <= 0xBF) & (trail != 0x97) & (trail != 0xB7)]  # Latin letters but for the two signs
    kind[lead] = kind[lead + 1] = 1
    odd = np.concatenate([[0], np.cumsum(kind == 0, dtype=np.int32)])
    plain = odd[words.ends] == odd[words.starts]
    change = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
    at = np.searchsorted(words.starts, change, side="right") - 1
    inside = (at >= 0) & (words.starts[at] < change) & plain[at] if len(words.starts) else np.zeros(len(change), bool)
    change, at = change[inside], at[inside]
    starts = np.concatenate([words.starts, change])
    order = np.argsort(starts, kind="stable")
    starts = starts[order]
    plain = np.concatenate([plain, plain[at]])[order]
    ends = np.concatenate([words.ends, words.ends[at]])[order]
    cut = np.flatnonzero(starts[1:] < ends[:-1])
    ends[cut] = starts[cut + 1]
    return starts, ends, plain, np.searchsorted(starts, block.bounds)


class WordTokens:
    """``encode`` gives the ids of a block's rows end to end and how many each row has.

    ``specials_as_text``: strings of special tokens inside a text are ordinary text.
    """

    def __init__(self, path: str, specials_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one Spark task is one thread
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = specials_as_text
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a run
        self.last[[i for text, i in vocabulary.items() if text.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encoded(self, texts: list[str], at_once: int) -> tuple[np.ndarray, list[int]]:
        """Ids end to end and how many each text has."""
        parts, counts = [np.zeros(0, np.uint32)], []
        for i in range(0, len(texts), at_once):
            for x in self.tokenizer.encode_batch_fast(texts[i:i + at_once], add_special_tokens=False):
                parts.append(np.array(x.ids, np.uint32))
                counts.append(len(parts[-1]))
        return np.concatenate(parts), counts

    def _learn(self, hashes: np.ndarray, plain: np.ndarray, texts: list[bytes]) -> None:
        runs, others = np.flatnonzero(plain), np.flatnonzero(~plain)
        words = [texts[i].decode("ascii" if texts[i].isascii() else "utf-8", "replace") for i in runs.tolist()]
        flat, _ = self._encoded([" ".join(words[i:i + _JOINED]) for i in range(0, len(words), _JOINED)], _BATCH)
        stops = np.flatnonzero(self.last[flat]) + 1
        if len(stops) != len(runs):
            raise ValueError("the tokenizer does not end every run of letters or signs")
        counts = np.zeros(len(hashes), np.int64)
        counts[runs] = np.diff(stops, prepend=0)
        rest, counts[others] = self._encoded([texts[i].decode("utf-8", "replace") for i in others.tolist()], _JOINED)
        starts = np.zeros(len(hashes), np.int64)
        starts[runs] = stops - counts[runs] + len(self.ids)
        starts[others] = np.cumsum(counts[others]) - counts[others] + len(self.ids) + len(flat)
        self.ids = np.concatenate([self.ids, flat, rest])
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.start = np.concatenate([self.start, starts])[order]
        self.count = np.concatenate([self.count, counts])[order]

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.known, hashes)
        found = at < len(self.known)
        found[found] = self.known[at[found]] == hashes[found]
        return at, found

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, plain, first = _units(block)
        if len(self.known) > REMEMBERED:
            self._forget()
        hashes = SpanHash(block.data, fold=True).of(starts, ends)
        # only runs may differ in case alone
        distinct, example, which = np.unique(np.where(plain, hashes, SpanHash(block.data).of(starts, ends) ^ np.uint64(1)), return_index=True, return_inverse=True)
        at, found = self._places(distinct)
        if not found.all():
            new = np.flatnonzero(~found)
            raw, one = block.data.tobytes(), example[new]
            self._learn(distinct[new], plain[one], [raw[s:e] for s, e in zip(starts[one].tolist(), ends[one].tolist())])
            at, _ = self._places(distinct)
        place = at[which.reshape(-1)]
        counts = self.count[place]
        ids = self.ids[ranges(self.start[place], counts)]
        before = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(before[first])
