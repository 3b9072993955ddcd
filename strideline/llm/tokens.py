"""Token ids of whole texts with a tokenizer file, inside Python workers.

The tokenizers used here cut a text at white space before anything else, so that a text's ids are its words'
ids in a row. Words repeat, and looking one up is ten times as fast as encoding it again.
"""

from __future__ import annotations

import os
import re
import sys
import types
from collections.abc import Iterator, Sequence

import numpy as np

# Latin letters, then marks other than the apostrophe: two stretches that the tokenizer cuts apart, too
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
LINE = 500
PIECE = 1 << 20


class WordEncoder:
    """Ids by word, with at most `limit` words remembered. A word of Latin letters and marks is put together from
    its lower-case letters and its marks; every other word goes to the tokenizer as it is.

    Letters and marks are encoded many to a line. Where the vocabulary marks the last token of a word (`</w>`), that
    cuts the line's ids by word; a line that does not come out with one such token per word is encoded word by word.
    """

    def __init__(self, path: str, limit: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(self.vocabulary, bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.ends[k] = token.endswith("</w>")
        self.dtype = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self.limit, self.known = limit, {}

    def _encode(self, words: list[bytes]) -> None:
        for lo in range(0, len(words), 20_000):
            part = words[lo : lo + 20_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
                self.known[w] = np.array(e.ids, self.dtype).tobytes()

    def _encode_lines(self, words: list[bytes]) -> None:
        size = self.dtype.itemsize
        for lo in range(0, len(words), LINE):
            part = words[lo : lo + LINE]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, np.int64)
            cut = (np.flatnonzero(self.ends[ids]) + 1) * size
            if len(cut) != len(part):
                self._encode(part)
                continue
            raw = ids.astype(self.dtype).tobytes()
            self.known.update(zip(part, [raw[a:z] for a, z in zip([0, *cut.tolist()], cut.tolist())]))

    def _learn(self, missing: set[bytes]) -> None:
        made, odd, plain, known = set(), [], [], self.known
        for w in missing:
            m = PLAIN.fullmatch(w.decode())
            if m:
                letters, marks = m[1].lower().encode(), m[2].encode()
                plain.append((w, letters, marks))
                if letters not in known:
                    made.add(letters)
                if marks and marks not in known:
                    made.add(marks)
            else:
                odd.append(w)
        self._encode(odd)
        self._encode_lines(list(made))
        for w, letters, marks in plain:
            known[w] = known[letters] + known[marks] if marks else known[letters]

    def _pieces(self, data: bytes) -> Iterator[bytes]:
        """A long text in pieces that end at white space."""
        at = 0
        while len(data) - at > PIECE:
            end = re.compile(rb"[\x20\x09-\x0D]").search(data, at + PIECE)
            if not end:
                break
            yield data[at : end.start()]
            at = end.start()
        yield data[at:]

    def __call__(self, text: str | None) -> bytes:
        """The ids of one whole text in the encoder's width; NULL is the empty text."""
        out = []
        for piece in self._pieces((text or "").encode()):
            words = piece.split()
            known = self.known
            missing = {w for w in words if w not in known}
            if missing:
                if len(known) > self.limit:
                    known.clear()
                    missing = set(words)
                self._learn(missing)
            out.append(b"".join([known[w] for w in words]))
        return b"".join(out)

    def ids(self, texts: Sequence[str | None], end_id: int) -> list[np.ndarray]:
        """One array of ids per text, closed by `end_id`. Words are learnt together for all texts of ordinary length."""
        split = [None if t and len(t) > PIECE else (t or "").encode().split() for t in texts]
        seen: set[bytes] = set().union(*[x for x in split if x])
        missing = seen.difference(self.known)
        if missing:
            if len(self.known) > self.limit:
                self.known.clear()
                missing = seen
            self._learn(missing)
        known, end = self.known, np.array([end_id], self.dtype).tobytes()
        done = [x if x is None else b"".join([known[w] for w in x]) for x in split]
        return [np.frombuffer((self(t) if x is None else x) + end, self.dtype) for t, x in zip(texts, done)]


def word_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker, kept from task to task."""
    held = sys.modules.setdefault("strideline_worker_cache", types.ModuleType("strideline_worker_cache")).__dict__
    if path not in held:
        held[path] = WordEncoder(path)
    return held[path]


def batches_of(batch, rows: int = 256) -> Iterator:
    """An Arrow batch in slices of a few rows, so that long texts don't pile up as ids."""
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)
