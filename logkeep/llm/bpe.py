"""BPE encoding by backtracking over longest matches, and decoding from an offset table.

An Aho-Corasick automaton over the vocabulary yields the tokens that match at every place
of a word. The encoder takes the longest; it must be compatible with the token before it,
that is, byte-pair merging of the two texts side by side must not merge across their
border. Else a shorter match is tried, then an earlier token is taken back; every place of
the word is ruled out at most once, so work is linear in the word's matches. Compatibility
of a pair is found by undoing merges at the border and kept in a table. The result is that
of applying all merges in order of rank.

Covers vocabularies with word ends, byte-level symbols, lower-casing and the split pattern
named in the file; others are refused. Special tokens in a text become their ids. Texts
are handled whole. Null texts are empty: no ids, and the empty text. Repeated rows and null
ids need no care; other columns are not read.
"""

import json
import re

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logkeep.llm.texts import as_bytes, per_process, small_batches, struct_array
from logkeep.llm.wordtokens import WordTokens

END = " "
MARKS = frozenset("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
#: Latin texts that normalisation leaves as they are and whose case and classes are settled.
STABLE = re.compile("[!-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u017e]*").fullmatch
#: Pieces and pairs whose results a task keeps; beyond it starts anew.
KEPT_PIECES, KEPT_PAIRS = 150_000, 400_000


def byte_symbols():
    """Printable stand-in of every byte, as byte-level vocabularies use them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = (b for b in range(256) if b not in plain)
    found = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(moved)}
    return [found[b] for b in range(256)]


class WordEncoder:
    """Splits words as one vocabulary file says; subclasses merge the pieces.

    ``definition`` is the file's JSON text.
    """

    def __init__(self, definition):
        spec = json.loads(definition)
        self.model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if (self.model["end_of_word_suffix"] != "</w>" or kinds != ["NFC", "Replace", "Lowercase"]
                or [s["type"] for s in steps] != ["Split", "ByteLevel"] or spec["decoder"]):
            raise ValueError("not a vocabulary of lower-cased words with word ends")
        self.library = Tokenizer.from_str(definition)
        # Unicode tables differ between libraries: other texts are normalised by this one
        self.normal = self.library.normalizer.normalize_str
        self.pretoken = self.library.pre_tokenizer.pre_tokenize_str
        self.split = regex.compile(steps[0]["pattern"]["Regex"]).findall
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.symbols, self.known = byte_symbols(), {}

    def encode_piece(self, piece):
        """Ids of one piece, in byte symbols."""
        raise NotImplementedError

    def encode_word(self, word):
        """Ids of one stretch of text without ASCII white space (bytes)."""
        text = word.decode()
        if "<|" in text:
            out = []
            for piece in self.at_special.split(text):
                out += [self.special[piece]] if piece in self.special else self._plain(piece)
            return out
        return self._plain(text)

    def _plain(self, text):
        known = self.known
        if STABLE(text):
            text = text.lower()
            if text in known:
                return known[text]
            # letters alone are one piece, as are those before a last mark
            if text.isalpha():
                pieces = [text]
            elif text[:-1].isalpha() and text[-1] in MARKS:
                pieces = [text[:-1], text[-1]]
            else:
                pieces = self.split(text)
        else:
            pieces = [p for p, _ in self.pretoken(self.normal(text))]
            return [i for p in pieces for i in self.encode_piece(p)]
        out = []
        for piece in pieces:
            ids = known.get(piece)
            if ids is None:
                mapped = piece if piece.isascii() else "".join(map(self.symbols.__getitem__, piece.encode()))
                ids = known[piece] = self.encode_piece(mapped)
            out += ids
        return out

    def encode_words(self, words):
        if len(self.known) > KEPT_PIECES:
            self.known.clear()
        return list(map(self.encode_word, words))


class Bpe(WordEncoder):
    """Backtracking encoder."""

    def __init__(self, definition):
        super().__init__(definition)
        model = self.model

        def inner(token):
            return token[:-4] + END if token.endswith("</w>") else token

        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        ids = model["vocab"]
        self.pairs = {}
        for rank, (a, b) in enumerate(model["merges"]):
            token = ids[a + b]
            self.pairs[ids[a], ids[b]] = rank
            if self.rank[token] < 0:
                self.rank[token], self.left[token], self.right[token] = rank, ids[a], ids[b]
        self.table = {}
        usable = {}
        for text, token in sorted(ids.items(), key=lambda x: self.rank[x[1]]):
            a, b = self.left[token], self.right[token]
            usable[token] = a < 0 or (usable[a] and usable[b] and self._apart(a, b, self.rank[token]))
        self.whole = {inner(t): i for t, i in ids.items() if usable[i]}
        self.automaton = ahocorasick.Automaton()
        self.sizes, self.shorter = [0] * size, [-1] * size
        for text, token in self.whole.items():
            self.automaton.add_word(text, (token, len(text) - 1))
            self.sizes[token] = len(text)
            self.shorter[token] = next(
                (self.whole[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.whole), -1)
        self.automaton.make_automaton()

    def _apart(self, a, b, limit):
        """Whether no merge of rank below ``limit`` joins what stands at the border of a and b."""
        rank, pairs = self.rank, self.pairs
        while True:
            merge = pairs.get((a, b))
            if merge is not None and merge < limit:
                return False
            if rank[a] > rank[b]:
                limit, a = rank[a], self.right[a]
            elif rank[b] < 0:
                return True
            else:
                # of two equal pairs the left one merges first
                limit, b = rank[b] + 1, self.left[b]

    def compatible(self, a, b):
        key = a << 20 | b
        if (found := self.table.get(key)) is None:
            found = self.table[key] = self._apart(a, b, 1 << 60)
        return found

    def encode_piece(self, piece):
        text = piece + END
        if text in self.whole:
            return [self.whole[text]]
        longest = [-1] * len(text)
        for last, (token, reach) in self.automaton.iter(text):
            longest[last - reach] = token  # later ends come later: the longest stays
        sizes, shorter, table = self.sizes, self.shorter, self.table
        dead, at, end, tokens, previous = set(), 0, len(text), [], -1
        token = longest[0]
        while True:
            if token < 0:
                # nothing fits here: take back the token before and try its shorter prefix
                dead.add(at)
                token = tokens.pop()
                at -= sizes[token]
                previous = tokens[-1] if tokens else -1
                token = shorter[token]
                continue
            following = at + sizes[token]
            if following not in dead:
                fits = previous < 0 or table.get(previous << 20 | token)
                if fits is None:
                    fits = self.compatible(previous, token)
                if fits:
                    tokens.append(token)
                    if following == end:
                        return tokens
                    at, previous, token = following, token, longest[following]
                    continue
            token = shorter[token]

    def encode_words(self, words):
        if len(self.table) > KEPT_PAIRS:
            self.table.clear()
        return super().encode_words(words)


class Decoder:
    """Texts of all ids in one pool, with the offset of each."""

    def __init__(self, definition):
        spec = json.loads(definition)
        names = {i: t for t, i in spec["model"]["vocab"].items()}
        names |= {a["id"]: a["content"] for a in spec["added_tokens"]}
        pieces = [names.get(i, "").encode() for i in range(max(names) + 1)]
        self.pool = np.frombuffer(b" ".join(pieces) + b" ", np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) + 1 for p in pieces])])

    def decode(self, ids):
        """Bytes of the ids' texts joined by spaces, gathered through the offset table."""
        if not len(ids):
            return b""
        firsts, sizes = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1]) + np.repeat(firsts - ends + sizes, sizes)
        return self.pool[places[:-1]].tobytes()


def read_definition(path=None):
    with open(path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


def _encoded(text, definition):
    coder = per_process(("words", hash(definition)), lambda: WordTokens(Bpe(definition).encode_words))
    parts, offsets = [], [np.zeros(1, np.int64)]
    for at in range(0, len(text), 500):
        flat, counts = coder.batch(as_bytes(text[at : at + 500]))
        parts.append(flat.astype(np.int32))
        offsets.append(np.cumsum(counts) + offsets[-1][-1])
    flat = np.concatenate([np.zeros(0, np.int32), *parts])
    return pa.ListArray.from_arrays(np.concatenate(offsets).astype(np.int32), pa.array(flat))


def _decoded(ids, definition):
    decoder = per_process(("decoder", hash(definition)), lambda: Decoder(definition))
    flat, cuts = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
    out = [decoder.decode(flat[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.array(out, pa.binary()).cast(pa.string())


def encode(text, definition):
    """Column of the ids of a text column, ``array<int>``."""
    @F.arrow_udf("array<int>")
    def ids(text: pa.Array) -> pa.Array:
        return _encoded(text, definition)

    # else a decoder of this column would be fused with it, and encode everything again
    return ids.asNondeterministic()(text)


def round_trip(text, definition):
    """Column of the ids of a text column and of what these decode to: one task holds both.

    ``struct<ids: array<int>, decoded: string>``
    """
    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def both(text: pa.Array) -> pa.Array:
        found = _encoded(text, definition)
        return struct_array({"ids": found, "decoded": _decoded(found, definition)})

    return both.asNondeterministic()(text)


def decode(ids, definition):
    """Column of the text that a column of ids stands for."""
    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        return _decoded(ids, definition)

    return text(ids)


def encoded(docs, definition, text="text", into="ids"):
    """``docs`` with a new column of token ids."""
    return docs.withColumn(into, encode(docs[text], definition))


def op9_bpe(spark, sf_dir):
    definition = read_definition()
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = docs.select("doc_id", round_trip(F.col("text"), definition).alias("both"))
    listed = F.array_join(F.col("both.ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("both.ids").cast("long").alias("n_tokens"),
                        F.sha2(listed, 256).alias("ids_sha256"),
                        F.sha2("both.decoded", 256).alias("decoded_sha256"))
