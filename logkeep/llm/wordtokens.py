"""Token ids of whole texts, put together from those of their distinct words.

Holds for tokenizers whose tokens never cross ASCII white space, such as those that split
words off before merging; A-Z may be lower-cased first where the tokenizer does so itself.
"""

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct words whose tokens a task keeps; beyond it the most frequent half stays.
KEPT_WORDS = 300_000
#: Words encoded at once, whose lists of ids are objects for so long.
LEARNED = 8_000


class WordTokens:
    """Encodes batches of texts with ``encode_words``: list of words to list of id lists."""

    def __init__(self, encode_words, kept=KEPT_WORDS):
        self.encode_words, self.kept = encode_words, kept
        self.numbers = {}
        self.seen = np.zeros(0, np.int64)
        self.sizes = self.ids = np.zeros(0, np.int32)

    def _trim(self):
        stay = np.sort(np.argsort(-self.seen, kind="stable")[: self.kept // 2])
        held = np.zeros(len(self.seen), bool)
        held[stay] = True
        self.ids = self.ids[np.repeat(held, self.sizes)]
        self.sizes, self.seen = self.sizes[stay], self.seen[stay]
        words = list(self.numbers)
        self.numbers = {words[i]: k for k, i in enumerate(stay.tolist())}

    def _learn(self, fresh):
        sizes, ids = [self.sizes], [self.ids]
        for at in range(0, len(fresh), LEARNED):
            found = self.encode_words(fresh[at : at + LEARNED])
            sizes.append(np.fromiter(map(len, found), np.int32, len(found)))
            ids.append(np.fromiter(itertools.chain.from_iterable(found), np.int32, int(sizes[-1].sum())))
        self.numbers.update(zip(fresh, itertools.count(len(self.numbers))))
        self.sizes, self.ids = np.concatenate(sizes), np.concatenate(ids)
        self.seen = np.concatenate([self.seen, np.zeros(len(fresh), np.int64)])

    def batch(self, texts, special=b"<|"):
        """(ids of all texts, number of ids of each); texts are bytes.

        A text that may hold a special token's name keeps its case.
        """
        if len(self.numbers) > self.kept:
            self._trim()
        texts = [t if special in t else t.lower() for t in texts]
        # a word is a Python object once a batch, however often it stands there
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
        number = map(self.numbers.get, distinct.tolist(), itertools.repeat(-1))
        number = np.fromiter(number, np.int64, len(distinct))
        fresh = np.flatnonzero(number < 0)
        if len(fresh):
            number[fresh] = len(self.numbers) + np.arange(len(fresh))
            self._learn(distinct[fresh].tolist())
        places = words.indices.to_numpy()
        self.seen[number] += np.bincount(places, minlength=len(number))
        number = number[places]
        firsts = np.cumsum(self.sizes) - self.sizes
        each = self.sizes[number]
        ends = np.cumsum(each)
        flat = self.ids[np.arange(each.sum()) + np.repeat(firsts[number] - ends + each, each)]
        bounds = lists.offsets.to_numpy()
        return flat, np.diff(np.concatenate([[0], ends])[bounds - bounds[0]])
