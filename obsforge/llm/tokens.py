"""Token ids of whole texts by a public tokenizer, with a bounded store of the words seen before."""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Words, and parts of words, that an encoder keeps the ids of; beyond it begins anew. About 0.2 KB each.
ROOM = 200_000
#: Words of more bytes are encoded anew each time, so the store is bounded in bytes too.
LONG = 256

#: A word of Latin letters, and marks that the tokenizer cuts off it as a piece of their own.
_LETTERS = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,;:!?*#$%&|()]*)").fullmatch


class WordEncoder:
    """Ids of a tokenizer that never joins across white space, as little-endian 32-bit bytes.

    A word between ASCII white space always has the same ids, so each is encoded once and looked
    up from then on. That holds for tokenizers which drop white space and cut words there
    (``word_bpe_49k``), not for those that keep it (byte-level ones). Strings of special tokens in
    a text are ordinary text.

    Words of letters are encoded many at a time, see ``_pieces``; all others by the tokenizer.
    """

    def __init__(self, path: str, room: int = ROOM) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.room, self.known, self.parts, self.long = room, {}, {}, []
        self.pieces, self.ends = _pieces(path)

    def _plain(self, words: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def _letters(self, words: list[bytes]) -> list[bytes]:
        """The ids of words of letters; each ends with a token that only ends words."""
        if self.pieces is None:
            return self._plain(words)
        ids = np.array(self.pieces.encode_ordinary((b"\0".join(words) + b"\0").decode().lower()), "<u4")
        cut = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def _learn(self, words: set[bytes]) -> None:
        if len(self.known) > self.room:
            self.known.clear()
        if len(self.parts) > self.room:
            self.parts.clear()
        new = [w for w in words if w not in self.known]
        cut = [m.groups() if (m := _LETTERS(w)) else (b"", w) for w in new]
        letters, rest = ([x for x in {c[i] for c in cut} if x and x not in self.parts] for i in (0, 1))
        if letters:
            self.parts.update(zip(letters, self._letters(letters), strict=True))
        if rest:
            self.parts.update(zip(rest, self._plain(rest), strict=True))
        of = self.parts
        for w, (a, b) in zip(new, cut, strict=True):
            self.known[w] = of[a] + of[b] if a and b else of[a or b]
            for x in (a, b):
                if len(x) > LONG:
                    self.long.append((of, x))
            if len(w) > LONG:
                self.long.append((self.known, w))

    def encode(self, text: bytes) -> bytes:
        """The ids of a text, one after the other."""
        words = text.split()
        try:
            return b"".join([self.known[w] for w in words])
        except KeyError:
            self._learn(set(words))
            out = b"".join([self.known[w] for w in words])
            for store, w in self.long:
                store.pop(w, None)
            self.long.clear()
            return out


def _pieces(path: str):
    """The vocabulary for tiktoken, which encodes many words a call, and which ids end a word.

    The end of a word is written as a zero byte there. Both libraries merge the pair of lowest
    rank first; tiktoken ranks a pair by what it makes, the tokenizer by its list of merges. They
    agree if each token, encoded on its own, comes out as itself: two neighbours that make it are
    then the pair on the list. That is tried for every token here; without it, or with a model of
    another kind, there are no pieces and the tokenizer does all.
    """
    import tiktoken
    from tokenizers import models

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")):
        return None, None
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(c): b for b, c in [(b, b) for b in visible] + [(b, 256 + i) for i, b in enumerate(b for b in range(256) if b not in visible)]}
    vocab, merges = model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    made = [vocab[a + b] for a, b in merges]
    ended = [t for t in vocab if t.endswith("</w>")]
    inner = [a + b for a, b in merges if not (a + b).endswith("</w>")]
    words, parts = models.BPE(vocab, merges, end_of_word_suffix="</w>"), models.BPE(vocab, merges)
    if made != sorted(made) or any([x.id for x in words.tokenize(t[:-4])] != [vocab[t]] for t in ended) or any([x.id for x in parts.tokenize(t)] != [vocab[t]] for t in inner):
        return None, None
    ranks = {bytes(byte_of[c] for c in t.removesuffix("</w>")) + b"\0" * t.endswith("</w>"): i for t, i in vocab.items() if set(t.removesuffix("</w>")) <= byte_of.keys()}
    ends = np.zeros(max(vocab.values()) + 1, bool)
    ends[[vocab[t] for t in ended]] = True
    return tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={}), ends


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This process's encoder for a vocabulary file; workers keep it from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
