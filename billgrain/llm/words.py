"""Words and their token ids inside Python workers, remembered from task to task."""

from __future__ import annotations

import os
import re
import sys
import types

import numpy as np

#: Words that a worker remembers; beyond it, it begins anew.
REMEMBERED = 1_000_000
#: Words that one tokeniser call takes.
CHUNK = 4000
#: A word with one mark behind it: the tokeniser never joins the two.
MARKED = re.compile(rb"(.*[a-z0-9])([.,!?;:])", re.S)


def remembered(name: str, make):
    """An object that lives as long as the worker process, made on first use."""
    place = sys.modules.setdefault("_billgrain_worker", types.ModuleType("_billgrain_worker"))
    if name not in place.__dict__:
        place.__dict__[name] = make()
    return place.__dict__[name]


def bpe_tokeniser(path: str):
    """A tokeniser of the ``tokenizers`` library, without threads of its own."""

    def load():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    return remembered(f"bpe {path}", load)


def piece_tokeniser(path: str):
    """A tokeniser of the ``sentencepiece`` library."""

    def load():
        from sentencepiece import SentencePieceProcessor

        return SentencePieceProcessor(model_file=path)

    return remembered(f"pieces {path}", load)


def bpe_ids(words: list[bytes], path: str) -> list[bytes]:
    """The ids of each word as little-endian unsigned 32-bit integers.

    Words are joined by blanks and told apart again by the places of their tokens, which
    is the same as asking for each alone as long as no token reaches over a blank.
    """
    tokeniser, found = bpe_tokeniser(path), []
    for i in range(0, len(words), CHUNK):
        part = [w.decode() for w in words[i : i + CHUNK]]
        encoded = tokeniser.encode(" ".join(part), add_special_tokens=False)
        ids = np.array(encoded.ids, "<u4").tobytes()
        at = np.fromiter((a for a, _ in encoded.offsets), np.int64, len(encoded.ids))
        cut = np.searchsorted(at, np.cumsum([0, *(len(w) + 1 for w in part)])).tolist()
        found += [ids[4 * a : 4 * b] for a, b in zip(cut, cut[1:])]
    return found


def text_ids(texts: list[bytes], path: str) -> list[bytes]:
    """The ids of whole texts, by a tokeniser that ignores case, drops white space and joins nothing over it."""
    known = remembered(f"ids {path}", dict)
    # names of special tokens are the one thing that case matters for
    split = [(t if b"<|" in t else t.lower()).split() for t in texts]
    if len(known) > REMEMBERED:
        known.clear()
    new = set().union(*split).difference(known)
    marked = [(w, *m.groups()) for w in new if (m := MARKED.fullmatch(w))]
    alone = [*(new.difference(w for w, _, _ in marked) | {p for m in marked for p in m[1:]}).difference(known)]
    known.update(zip(alone, bpe_ids(alone, path)))
    known.update((word, known[stem] + known[mark]) for word, stem, mark in marked)
    return [b"".join(map(known.__getitem__, words)) for words in split]
