"""Token ids of distinct pieces of text, and of whole texts by way of their distinct pieces."""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from varloom.llm.blocks import Texts, Tokens, ragged, units, words

#: Pieces that are encoded in one call, joined by spaces.
JOINED = 2000


@dataclass
class Vocabulary:
    """A tokenizers file. ``edge`` marks the ids that begin (or, with ``ends``, end) a word, so that
    many words can be encoded in one call and told apart afterwards."""

    tokenizer: object
    edge: np.ndarray
    ends: bool

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """The vocabulary at ``path``, loaded once in each worker process."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        loaded = tokenizers.__dict__.setdefault("_loaded_by_path", {})
        if path not in loaded:
            t = tokenizers.Tokenizer.from_file(path)
            vocab = t.get_vocab()
            ends = any(k.endswith("</w>") for k in vocab)
            edge = np.zeros(max(vocab.values()) + 1, bool)
            edge[[v for k, v in vocab.items() if (k.endswith("</w>") if ends else k.startswith("Ġ"))]] = True
            loaded[path] = (t, edge, ends)
        return cls(*loaded[path])

    def pieces(self, texts: Texts) -> Tokens:
        """The texts cut where the tokenizer cuts in any case."""
        if not self.ends:
            return units(texts)
        # The tokenizer drops white space and case; special strings are case-sensitive.
        special = b"<|" in texts.data.tobytes() if (texts.data == ord("<")).any() else False
        return words(texts, lower=not special, marks=True)

    def encode(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all distinct pieces, one after another, and where each piece's ids begin."""
        strings = [x.decode("utf-8", "replace") for x in distinct.to_pylist()]
        plain = [i for i, x in enumerate(strings) if (x.isalpha() if self.ends else x[:1] == " " and x[1:].isalpha())]
        other = sorted(set(range(len(strings))) - set(plain))
        count, found = np.zeros(len(strings), np.int64), []
        for at in range(0, len(plain), JOINED * 16):
            groups = [plain[i : i + JOINED] for i in range(at, min(at + JOINED * 16, len(plain)), JOINED)]
            joined = [(" " if self.ends else "").join(strings[i] for i in g) for g in groups]
            for group, e in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.int32)
                edges = np.flatnonzero(self.edge[ids])
                if len(edges) != len(group):  # a word that the tokenizer cuts: each one by itself
                    other += group
                    continue
                bounds = np.concatenate([[0], edges + 1]) if self.ends else np.concatenate([edges, [len(ids)]])
                count[group] = np.diff(bounds)
                found.append((group, ids))
        for at in range(0, len(other), JOINED):
            group = other[at : at + JOINED]
            each = [e.ids for e in self.tokenizer.encode_batch_fast([strings[i] for i in group], add_special_tokens=False)]
            count[group] = [len(x) for x in each]
            found.append((group, np.array([y for x in each for y in x], np.int32)))
        start = np.concatenate([[0], np.cumsum(count)])
        ids = np.empty(start[-1], np.int32)
        for group, values in found:
            ids[ragged(start[group], count[group])] = values
        return ids, start

    def texts(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, one after another, and where each text's ids begin."""
        tokens = self.pieces(texts)
        ids, at = self.encode(tokens.distinct)
        count = np.diff(at)
        total = np.concatenate([[0], np.cumsum(count[tokens.code])])
        return ids[ragged(at[tokens.code], count[tokens.code])], total[tokens.start]

    def prefixes(self, texts: Texts, length: np.ndarray) -> np.ndarray:
        """Number of ids of the first ``length`` bytes of each text, which end at white space or the text's end."""
        head = Texts(texts.data[ragged(texts.start[:-1], length)], np.concatenate([[0], np.cumsum(length)]))
        return self.counts(head)

    def counts(self, texts: Texts) -> np.ndarray:
        """Number of ids of each text: those of its distinct pieces times how often it has them."""
        tokens = self.pieces(texts)
        _, at = self.encode(tokens.distinct)
        total = np.concatenate([[0], np.cumsum(np.diff(at)[tokens.code])])
        return np.diff(total[tokens.start])
