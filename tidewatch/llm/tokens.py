"""Token ids of whole texts, by words.

The tokenizer's pre-tokenizer never joins text across ASCII white space, its normalizer works within it and drops it,
so a text's ids are those of its white-space-separated words, one after the other. Words repeat: each distinct word of
a batch is looked up once, and only words that the worker hasn't met lately are given to the tokenizer.
`check_splits_at_spaces` tests this for a given tokenizer file; without it texts are encoded whole.

If the tokenizer also parts a letter from a mark and takes capitals for small letters (`check_parts_marks`), words are
put in small letters and lose their marks beforehand, so fewer of them differ; those of Latin letters alone then need
neither its normalizer nor its patterns, only its model.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa

from tidewatch.llm.common import row_groups, spans, text_bytes

END_ID = 2
PIECE_BYTES = 1 << 21
CACHE_WORDS = 300_000
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True
MARK = np.zeros(256, bool)
MARK[list(b".,;:!?")] = True
LETTER = np.zeros(256, bool)
LETTER[97:123] = True
SMALL = np.arange(256, dtype=np.uint8)
SMALL[65:91] += 32
PLAIN = re.compile(r"[a-zß-öø-ÿ]+|[.,;:!?]+")  # small Latin letters, each one code point, or marks


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def kind_of(word: str) -> int:
    """0 for a plain word, 2 for one with the digit that parts words in learn(), else 1."""
    return 0 if PLAIN.fullmatch(word) else 1 + ("0" in word)


class WordEncoder:
    """Encodes batches of texts; holds at most CACHE_WORDS words' ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = check_splits_at_spaces(self.tokenizer)
        self.model = self.by_words and model_alone(self.tokenizer)
        self.known: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0
        self.start, self.count = np.zeros(CACHE_WORDS, np.int64), np.zeros(CACHE_WORDS, np.int64)
        mark = self.tokenizer.encode("0", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of the words, and how many each has.

        Words are joined by a lone digit, whose id then parts them again: far cheaper than a call for each. Words that
        hold this digit themselves, or whose ids include its id, go through the tokenizer's own list of words.
        """
        counts, parts = [], []
        plain = sum(kind_of(w) == 0 for w in words) if self.model else 0  # they come first
        cuts = [*range(0, plain, 500), *range(plain, len(words), 500), len(words)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            some = words[i:j]
            if self.mark is not None and "0" not in (joined := " ".join(some)):
                coder = self.model if j <= plain else self.tokenizer
                ids = np.array(coder.encode_batch_fast([joined.replace(" ", " 0 ")], add_special_tokens=False)[0].ids, np.uint32)
                at = np.flatnonzero(ids == self.mark)
                if len(at) == len(some) - 1:
                    counts.append(np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1)
                    parts.append(np.delete(ids, at))
                    continue
            encoded = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            which = np.array([-1 if x is None else x for x in encoded.word_ids], np.int64)
            counts.append(np.bincount(which, minlength=len(some)))
            parts.append(np.array(encoded.ids, np.uint32))
        return np.concatenate(parts), np.concatenate(counts)

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of a column of words without white space, and how many each has."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        known, room = self.known, CACHE_WORDS - len(self.known)
        where = np.fromiter(map(known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(where < 0)
        ids, start, count = self.ids, self.start[where], self.count[where]
        if len(new):
            fresh = sorted((distinct[i] for i in new), key=kind_of)
            back = {w: i for i, w in enumerate(fresh)} if fresh != [distinct[i] for i in new] else None
            got, n = self.learn(fresh)
            first = np.cumsum(n) - n
            order = np.array([back[distinct[i]] for i in new]) if back else np.arange(len(new))
            ids = np.concatenate([self.ids[: self.used], got])
            start[new], count[new] = self.used + first[order], n[order]
            take = fresh[:room]
            if take:  # the first words met are kept, the frequent ones among them
                k, used = len(known), int(n[: len(take)].sum())
                self.start[k : k + len(take)], self.count[k : k + len(take)] = self.used + first[: len(take)], n[: len(take)]
                known.update(zip(take, range(k, k + len(take)), strict=True))
                self.ids, self.used = ids[: self.used + used], self.used + used
        code = coded.indices.to_numpy()
        size = count[code]
        return ids[spans(start[code], size)], size

    def piece(self, body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of texts that lie back to back in body, and how many each has."""
        word = ~ASCII_SPACE[body]
        edge = np.zeros(len(body) + 1, bool)
        edge[at] = True
        if self.model and b"<|" not in body.tobytes():  # special tokens are told apart by their capitals
            body = SMALL[body]
            letter, mark = LETTER[body], MARK[body]
            edge[1:-1] |= letter[:-1] & mark[1:] | mark[:-1] & letter[1:]
        begins = word & (edge[:-1] | np.concatenate([[True], ~word[:-1]]))
        ends = word & (edge[1:] | np.concatenate([~word[1:], [True]]))
        first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        if not len(first):
            return np.zeros(0, np.uint32), np.zeros(len(at) - 1, np.int64)
        lengths = last - first
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body[word]))])
        ids, size = self.words(words)
        before = np.concatenate([[0], np.cumsum(size)])
        cut = before[np.searchsorted(first, at)]
        return ids, np.diff(cut)

    def batch(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, counts) for runs of rows of a text column, together all rows; null is empty. A long text is cut at white
        space and its pieces' ids joined, so what is held at once is PIECE_BYTES of text or one text's ids."""
        if not self.by_words:
            for x in column.to_pylist():
                ids = np.array(self.tokenizer.encode(x, add_special_tokens=False).ids if x else [], np.uint32)
                yield ids, np.array([len(ids)])
            return
        body, at = text_bytes(column)
        for i, j in row_groups(at, PIECE_BYTES):
            if j - i > 1 or at[j] - at[i] <= PIECE_BYTES:
                yield self.piece(body[at[i] : at[j]], at[i : j + 1] - at[i])
                continue
            parts, here, end = [], int(at[i]), int(at[j])
            while here < end:
                stop = min(end, here + PIECE_BYTES)
                if stop < end:
                    space = np.flatnonzero(ASCII_SPACE[body[here:stop]])
                    if len(space):
                        stop = here + int(space[-1]) + 1
                    else:  # one word of megabytes
                        space = np.flatnonzero(ASCII_SPACE[body[stop:end]])
                        stop = stop + int(space[0]) + 1 if len(space) else end
                parts.append(self.piece(body[here:stop], np.array([0, stop - here]))[0])
                here = stop
            ids = np.concatenate(parts)
            yield ids, np.array([len(ids)])


def check_splits_at_spaces(tokenizer) -> bool:
    """Whether encoding a text of hard cases equals encoding its words."""
    hard = "It's  don't \t We'll' 's a' b 1234 ́x é 가 İI ΣΣ xΣ Σy ,. ;'s <|endoftext|> <|endo ftext|>  z  q‍r \n\r\f\v !end \U0001f600\U0001f601 กำ あい"
    whole = tokenizer.encode(hard, add_special_tokens=False).ids
    words = [w for w in re.split(r"[\t-\r ]+", hard) if w]
    return whole == tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False).ids


def model_alone(tokenizer):
    """A tokenizer for plain words: the same model without normalizer and patterns; None if it gives other ids."""
    from tokenizers import Tokenizer, pre_tokenizers

    alone = Tokenizer(tokenizer.model)
    alone.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return alone if check_parts_marks(tokenizer, alone) else None


def check_parts_marks(tokenizer, alone) -> bool:
    """Whether hard texts have the ids of their small-letter words without marks, and plain words those of the model alone."""
    hard = "It's, don't. We'll?s 'A.B' x.y!z é.É É.e ß.ss ..a ...B!? a'.s a.'s No.1 1.No a...b Á.b é,f ẞ.a ….a a….b ·.a ;s ,re Straße. Über, façade: naïve; zq qzxÿ øre. 0 a0 0.a"
    small = re.sub(r"[A-Z]", lambda m: m[0].lower(), hard)
    parted = re.sub(r"(?<=[a-z])(?=[.,;:!?])|(?<=[.,;:!?])(?=[a-z])", " ", small)
    ids = lambda t, x: t.encode(x, add_special_tokens=False).ids
    latin = "".join(map(chr, [*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)]))
    plain = [w for w in parted.split() if PLAIN.fullmatch(w)] + list(latin) + [a + b for a in latin for b in "aeés"] + ["0"]
    return ids(tokenizer, hard) == ids(tokenizer, parted) and all(ids(tokenizer, w) == ids(alone, w) for w in plain) and ids(tokenizer, " ".join(plain)) == ids(alone, " ".join(plain))


def documents_ids(encoder: WordEncoder, column: pa.Array, end_id: int = END_ID) -> Iterator[np.ndarray]:
    """Each row's ids with the end id."""
    for ids, counts in encoder.batch(column):
        at = 0
        for n in counts:
            yield np.append(ids[at : at + n], np.uint32(end_id))
            at += n


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder a worker process, kept from task to task."""
    return WordEncoder(path)
