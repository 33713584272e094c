"""Token ids of whole texts by a public tokenizer, for use inside Arrow tasks."""

from __future__ import annotations

import os

import numpy as np

#: Runs of these at the end of a word are tokenised apart from what stands before them.
TAIL = b".,;:!?$%&*#"
#: The tokens of a word are kept for later words; beyond this many the store starts anew.
KEPT = 1_000_000
LONGEST_KEPT = 48


class WordTokenizer:
    """Ids of a text by a ``tokenizers`` file whose pre-tokenizer drops white space.

    No token of such a tokenizer spans ASCII white space, so a text's ids are those of its
    words one after another; a word is tokenised once and remembered.  Ids are uint32, little-endian."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kept: dict[bytes, bytes] = {}
        # Where the tokenizer lowers all letters, ASCII ones may as well be lowered first.
        self.lower = "Lowercase" in str(self.tokenizer.normalizer)
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.closes[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def _fresh(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word.  Words of letters alone are one pre-token each, so many go
        through the tokenizer as one text, whose ids are cut after each end-of-word token."""
        text = [w.decode() for w in words]
        out: list[bytes] = [b""] * len(words)
        plain = [k for k, t in enumerate(text) if t.isalpha()]
        odd = [k for k, t in enumerate(text) if not t.isalpha()]
        groups = [plain[k:k + 400] for k in range(0, len(plain), 400)]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast([" ".join([text[k] for k in g]) for g in groups], add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            ends = (np.flatnonzero(self.closes[ids]) + 1) * 4
            if len(ends) != len(group) or (len(ends) and ends[-1] != ids.nbytes):
                odd += group
                continue
            raw, at = ids.tobytes(), 0
            for k, end in zip(group, ends.tolist()):
                out[k] = raw[at:end]
                at = end
        for k, found in zip(odd, self.tokenizer.encode_batch_fast([text[k] for k in odd], add_special_tokens=False)):
            out[k] = np.array(found.ids, "<u4").tobytes()
        return out

    def _parts(self, word: bytes) -> tuple[bytes, bytes]:
        """The word's head and its tail, where the tokens of the two don't depend on each other."""
        head = word.rstrip(TAIL)
        if head and head != word and (head[-1:].isalnum()):
            return head, word[len(head):]
        return word, b""

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        kept = self.kept
        split = [(t.lower() if self.lower else t).split() for t in texts]
        new = {w for words in split for w in words}.difference(kept)
        if len(kept) + len(new) > KEPT:
            kept.clear()
            new = {w for words in split for w in words}
        parts = {w: self._parts(w) for w in new}
        ask = list({p for two in parts.values() for p in two if p}.difference(kept))
        for k in range(0, len(ask), 20_000):
            kept.update(zip(ask[k:k + 20_000], self._fresh(ask[k:k + 20_000])))
        for w, (head, tail) in parts.items():
            if tail:
                kept[w] = kept[head] + kept[tail]
        out = [b"".join(map(kept.__getitem__, words)) for words in split]
        for w in new:
            if len(w) > LONGEST_KEPT:
                kept.pop(w, None)
        return out


_OPEN: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each file and worker process."""
    if path not in _OPEN:
        _OPEN[path] = WordTokenizer(path)
    return _OPEN[path]


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
