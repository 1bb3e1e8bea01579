"""Language-model scores from a probabilistic suffix tree over words.

Contexts of one to ``DEPTH`` words are states of the tree if they occur ``LEAST`` times (and
reach the share ``P_MIN`` of all training tokens, if one is set) and their next-word
distribution diverges from that of their longest retained suffix: the Kullback-Leibler
divergence over their next words that occur as often and the rest must reach ``DIVERGENCE``
nats and be significant for their count. A state gives these next words their discounted share
and leaves the remainder to its parent, in proportion, so every distribution sums to one; the
root is the add-one distribution of all words. A word is scored by the state of the longest
suffix of what stands before it in the text.

Counts cover all training documents. A document's end is a token of its own; contexts do not
reach across documents. A first exchange counts words in hash buckets that the blocks ask. Every
suffix of a context ends in its last word, so a second exchange puts all places behind the same
last word in one task: with what stands before and after them it has the counts of all contexts
that end there, decides on these states from the short to the long, scores the places, training
or not, and gives each block the sums of its documents. Words seen too seldom to count end a
context and are sent as one. Places behind a word of more than ``HEAVY`` occurrences are dealt
by the word before it as well; the next-word counts of such a word are summed beforehand, in
buckets of the next word, and each of its tasks gets them.

Words are runs of non-white-space, A-Z lower-cased, words and sequences told apart by 64-bit
hashes. Null, empty and blank texts are their end token alone. A null id is held in. Repeated
rows count and are scored each. Without training documents every text has score zero times its
tokens. Other columns are not read.
"""

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import functions as F

from logkeep.llm.exchange import NO_ID, Block, make_blocks
from logkeep.llm.texts import crc32_mod, hash64, mix
from logkeep.session import sized_partitions, stored, stored_by

FOLDS, HELD_OUT = 7, 2
DEPTH = 3
#: Occurrences of a sequence that count, whatever the size of the corpus.
LEAST = 2
#: Share of all training tokens that is asked for besides (none), and what a caller may set
#: with it: counts are exact and need no slack.
P_MIN = 0.0
SLACK = P_MIN / 4
DIVERGENCE = 0.02
DISCOUNT = 0.5
#: Tokens of a block and for each bucket of the exchanges.
RUN_TOKENS = 1 << 20
BUCKET_TOKENS = 3 << 19
#: Occurrences of a word beyond which the places behind it are dealt to several tasks.
HEAVY = 3 << 18
#: What sums of log10 travel in: far below the rounding of what they are added to.
UNIT = 2.0 ** -36
END = np.uint64(0x656E64)


class Tokens:
    """Tokens of a block: words and ends, in order, and the sequences that end at each."""

    def __init__(self, row):
        block = Block(row["ids"], row["counts"], row["words"])
        self.ids, self.sizes = block.ids, block.counts + 1
        ends = np.cumsum(self.sizes) - 1
        self.distinct = np.concatenate([hash64(block.distinct), [END]])
        inside = np.ones(int(self.sizes.sum()), bool)
        inside[ends] = False
        self.number = np.full(len(inside), len(block.distinct))
        self.number[inside] = block.number
        self.owner = np.repeat(np.arange(len(self.ids)), self.sizes)
        self.place = np.arange(len(inside)) - np.repeat(ends - self.sizes + 1, self.sizes)
        fold = [None if i == NO_ID else i for i in self.ids.tolist()]
        self.held_out = np.array([f == HELD_OUT for f in crc32_mod(fold, FOLDS)], bool)
        self.train = ~self.held_out[self.owner]


def _planes(values):
    """Byte planes of an array, which compress better than its values."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)


def _sorted_planes(keys):
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _pack(*arrays):
    return zstandard.compress(b"".join(a.tobytes() for a in arrays), 1)


class _Unpacked:
    """Arrays of a packed value, in their order."""

    def __init__(self, data):
        self.data, self.at = zstandard.decompress(data), 0

    def plain(self, size, kind):
        out = np.frombuffer(self.data, kind, size, self.at)
        self.at += out.nbytes
        return out

    def planes(self, size, kind):
        width = np.dtype(kind).itemsize
        return np.ascontiguousarray(self.plain(size * width, np.uint8).reshape(width, size).T).view(kind)[:, 0]

    def sorted_planes(self, size):
        return np.cumsum(self.planes(size, np.uint64), dtype=np.uint64)

    def vocabulary(self, size):
        """Hashes, counts and numbers of words."""
        return self.sorted_planes(size), self.planes(size, np.int64), self.planes(size, np.int64)


def _bucket_of(keys, buckets):
    """Bucket of each key, by key range."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _dealt(words, turn, buckets):
    """Bucket of the places behind a word (its number), ``turn`` one of those of a frequent one."""
    keys = words.astype(np.uint64) + turn.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return _bucket_of(mix(keys, 23), buckets)


def _turns(counts):
    """Over how many tasks the places behind words of these counts are dealt, a power of two."""
    return np.int64(1) << np.ceil(np.log2(np.maximum(1, counts / HEAVY))).astype(np.int64)


def _cut(place, buckets):
    """(bucket, first, end) of the runs of equal places that are not empty."""
    cuts = np.searchsorted(place, np.arange(buckets + 1))
    return [(k, cuts[k], cuts[k + 1]) for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()]


_ASKED = "bucket long, block long, size long, entries long, data binary"
_WORDS = "bucket long, block long, size long, data binary"
#: In the place of a block: the words of a bucket that count, with their counts.
_VOCABULARY = -1


def _frame(rows, schema):
    return pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])


def _count_words(blocks, buckets, least):
    """Numbers and counts of each block's words in hash order, by bucket, and its vocabulary.

    Numbers start from 1; words too rare to count are all 0.
    """
    def send(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                t = Tokens(row)
                order = np.argsort(t.distinct)
                keys = t.distinct[order]
                counts = np.bincount(t.number[t.train], minlength=len(keys))[order]
                yield _frame([(k, row["block"], b - a, _pack(_sorted_planes(keys[a:b]), _planes(counts[a:b])))
                              for k, a, b in _cut(_bucket_of(keys, buckets), buckets)], _WORDS)

    def meet(group):
        keys, counts = [], []
        for size, data in zip(group["size"], group["data"]):
            found = _Unpacked(data)
            keys.append(found.sorted_planes(size))
            counts.append(found.planes(size, np.int64))
        distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(which, np.concatenate(counts), len(distinct)).astype(np.int64)
        cuts, often = np.cumsum(group["size"].to_numpy())[:-1], total >= least
        bucket, kinds = int(group["bucket"].iloc[0]), int(np.count_nonzero(total))
        # frequent words have small numbers, which take less room
        number = np.empty(len(total), np.int64)
        number[np.argsort(-total, kind="stable")] = np.arange(len(total)) * buckets + bucket + 1
        number[~often] = 0
        out = [(bucket, block, len(n), _pack(_planes(n), _planes(c)), 0, 0)
               for block, n, c in zip(group["block"], np.split(number[which], cuts), np.split(total[which], cuts))]
        out.append((bucket, _VOCABULARY, int(often.sum()), _pack(
            _sorted_planes(distinct[often]), _planes(total[often]), _planes(number[often])),
            kinds, int(total.max())))
        return _frame(out, _WORDS + ", kinds long, most long")

    return blocks.mapInPandas(send, _WORDS).groupBy("bucket").applyInPandas(
        meet, _WORDS + ", kinds long, most long")


def _heavy_words(vocabulary):
    """Hashes, counts and numbers of the words of more than ``HEAVY`` occurrences, by hash.

    At most one for so many tokens, so the driver may hold them.
    """
    def pick(batches):
        for batch in batches:
            for size, data in zip(batch["size"], batch["data"]):
                found = _Unpacked(data)
                keys, counts, numbers = found.vocabulary(size)
                often = (counts > HEAVY) & (keys != END)
                yield pd.DataFrame({"key": keys[often].view(np.int64), "n": counts[often], "word": numbers[often]})

    rows = vocabulary.where(F.col("most") > HEAVY).mapInPandas(pick, "key long, n long, word long").collect()
    keys = np.array([r.key for r in rows], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], *(np.array([r[k] for r in rows], np.int64)[order] for k in ("n", "word"))


_FOLLOWED = "bucket long, word long, size long, whole long, left double, data binary"


def _heavy_states(blocks, vocabulary, heavy, base, least, buckets):
    """Counts of the words after each heavy one and its state's rest, for each task that asks."""
    words, wholes, numbers = heavy

    def send(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                t = Tokens(row)
                order = np.argsort(t.distinct)
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                which = np.minimum(np.searchsorted(words, t.distinct), len(words) - 1)
                which[words[which] != t.distinct] = -1
                at = np.flatnonzero(t.train & (t.place > 0))
                at = at[which[t.number[at - 1]] >= 0]
                pair = rank[t.number[at]] * len(words) + which[t.number[at - 1]]
                pair, counts = np.unique(pair, return_counts=True)
                after, before = t.distinct[order][pair // len(words)], (pair % len(words)).astype(np.uint32)
                yield _frame([(k, row["block"], b - a, _pack(
                    _sorted_planes(after[a:b]), _planes(before[a:b]), _planes(counts[a:b])))
                    for k, a, b in _cut(_bucket_of(after, buckets), buckets)], _WORDS)

    parts = "bucket long, word long, size long, own_log double, own double, given double, data binary"

    def meet(group, known):
        out = []
        if len(group) and len(known):
            keys, totals, number = _Unpacked(known["data"].iloc[0]).vocabulary(known["size"].iloc[0])
            after, before, counts = [], [], []
            for size, data in zip(group["size"], group["data"]):
                found = _Unpacked(data)
                after.append(found.sorted_planes(size))
                before.append(found.planes(size, np.uint32).astype(np.int64))
                counts.append(found.planes(size, np.int64))
            after, before, counts = map(np.concatenate, (after, before, counts))
            if len(keys):
                at = np.minimum(np.searchsorted(keys, after), len(keys) - 1)
                some = keys[at] == after
                pair, which = np.unique((before * len(keys) + at)[some], return_inverse=True)
                count = np.bincount(which, counts[some], len(pair)).astype(np.int64)
                pair, count = pair[count >= least], count[count >= least]
                at, before = pair % len(keys), pair // len(keys)
                own, given = count / wholes[before], (totals[at] + 1) / base
                for k, a, b in _cut(before, len(words)):
                    out.append((int(group["bucket"].iloc[0]), k, b - a,
                                (own[a:b] * np.log(own[a:b] / given[a:b])).sum(), own[a:b].sum(),
                                given[a:b].sum(), _pack(_planes(number[at[a:b]]), _planes(count[a:b]))))
        return _frame(out, parts)

    sent = blocks.mapInPandas(send, _WORDS).groupBy("bucket")
    found = stored(sent.cogroup(vocabulary.groupBy("bucket")).applyInPandas(meet, parts), "followers")
    sums = {r.word: r for r in found.groupBy("word").agg(
        F.sum("size").alias("size"), F.sum("own_log").alias("own_log"), F.sum("own").alias("own"),
        F.sum("given").alias("given")).collect()}
    lefts = np.full(len(words), np.nan)
    for k, r in sums.items():
        lefts[k] = _rests(r.size, r.own_log, r.own, r.given, wholes[k])

    def deal(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                turn, word, whole = np.arange(_turns(wholes)[r.word]), numbers[r.word], wholes[r.word]
                for bucket in np.unique(_dealt(np.repeat(word, len(turn)), turn, buckets)).tolist():
                    rows.append((bucket, word, r.size, whole, lefts[r.word], r.data))
            yield _frame(rows, _FOLLOWED)

    return found.mapInPandas(deal, _FOLLOWED)


def _rests(nexts, own_log, own, given, whole):
    """What the states of these sums leave to their parents; nan for what is no state."""
    rest, other = np.maximum(0.0, 1 - own), np.maximum(1e-12, 1 - given)
    gain = own_log + rest * np.log(np.where(rest > 0, rest, 1) / other)
    state = (nexts > 0) & (gain >= DIVERGENCE) & (gain * whole >= 2 * nexts + 5)
    return np.where(state, (1 - (own - nexts * DISCOUNT / np.maximum(1, whole))) / other, np.nan)


def _places(row, found, base, buckets):
    """A block's places by bucket, and a row of what is known of its documents."""
    t = Tokens(row)
    found = found.sort_values("bucket")
    order = np.argsort(t.distinct)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    number, numbers, known = rank[t.number], [], []
    for n, data in zip(found["size"], found["data"]):
        reply = _Unpacked(data)
        numbers.append(reply.planes(n, np.int64))
        known.append(reply.planes(n, np.int64))
    numbers, known = np.concatenate(numbers), np.concatenate(known)
    size = len(t.ids)
    held = np.packbits(t.held_out)
    n_known = np.bincount(t.owner[known[number] > 0], minlength=size)
    scores = np.bincount(t.owner, np.log10((known + 1) / base)[number], size)
    rows = [(-1 - row["block"], row["block"], size, 0, _pack(t.ids, t.sizes, n_known, scores, held))]
    # words from 1, 0 where there is none or one that is too rare to count
    word, count = numbers[number], known[number]
    at = np.flatnonzero(t.place > 0)
    at = at[word[at - 1] > 0]
    before = [word[at - 1]]
    for n in range(2, DEPTH + 1):
        more = np.where((t.place[at] >= n) & (before[-1] > 0), word[np.maximum(at - n, 0)], 0)
        before.append(more)
    spread = np.where(before[1] > 0, mix(before[1].astype(np.uint64), 24).astype(np.int64), at) if DEPTH > 1 else at
    place = _dealt(before[0], spread & (_turns(count[at - 1]) - 1), buckets)
    order = np.argsort(place, kind="stable")
    at = at[order]
    columns, counts = [word[at], *(b[order] for b in before)], count[at]
    owner, train = t.owner[at], t.train[at]
    for k, a, b in _cut(place[order], buckets):
        follow, first = np.unique(columns[0][a:b], return_index=True)
        rows.append((k, row["block"], len(follow), b - a, _pack(
            *(_planes(c[a:b]) for c in columns), _planes(counts[a:b][first]),
            _planes(np.diff(owner[a:b], prepend=0).astype(np.uint32)), np.packbits(train[a:b]))))
    return _frame(rows, _ASKED)


def _narrow(numbers):
    return numbers.astype(np.int32) if numbers.max(initial=0) < 1 << 31 else numbers


class Bucket:
    """All places behind the words of one bucket, with the words around them.

    ``next`` and ``before[d]`` are numbers of words, 0 where there is none that counts;
    ``known`` is the count of the next word (0 for number 0).
    """

    def __init__(self, group):
        known, columns, train, self.owners = [], [], [], []
        for size, entries, data in zip(group["size"], group["entries"], group["data"]):
            found = _Unpacked(data)
            columns.append([_narrow(found.planes(entries, np.int64)) for _ in range(DEPTH + 1)])
            _, which = np.unique(columns[-1][0], return_inverse=True)
            known.append(found.planes(size, np.int64)[which])
            self.owners.append(np.cumsum(found.planes(entries, np.uint32), dtype=np.uint32))
            train.append(np.unpackbits(found.plain(-(-entries // 8), np.uint8))[:entries] > 0)
        self.next, *self.before = map(np.concatenate, zip(*columns))
        self.known, self.train = np.concatenate(known), np.concatenate(train)
        self.size = 1 + int(max(c.max() for c in [self.next, *self.before]))

    def scores(self, heavy, base, least):
        """log10 of each place's probability over that of its word at the root."""
        root, size = np.where(self.next > 0, (self.known + 1) / base, 1.0), self.size
        p, at, context = root.copy(), np.arange(len(root)), np.zeros(len(root), np.int64)
        for n in range(DEPTH):
            some = self.before[n][at] > 0
            at, context = at[some], context[some] * size + self.before[n][at[some]]
            if not len(at):
                break
            keys, context = np.unique(context, return_inverse=True)
            whole = np.bincount(context[self.train[at]], minlength=len(keys))
            dealt = self._heavy_contexts(keys, whole, heavy) if n == 0 else {}
            # a context that is too rare is no state, nor is a longer one
            live = whole[context] >= least
            at, context = at[live], context[live]
            follows = np.flatnonzero(self.next[at] > 0)
            grams, which = np.unique(context[follows] * size + self.next[at[follows]], return_inverse=True)
            count = np.bincount(which[self.train[at[follows]]], minlength=len(grams))
            given = np.empty(len(grams))
            given[which] = p[at[follows]]
            for k, rows in dealt.items():
                self._sum_up(k, rows, grams, count)
            kept = np.flatnonzero(count >= least)
            owner = grams[kept] // size
            own = count[kept] / whole[owner]

            def total(values, owner=owner, keys=keys):
                return np.bincount(owner, values, len(keys))

            rests = _rests(np.bincount(owner, minlength=len(keys)), total(own * np.log(own / given[kept])),
                           total(own), total(given[kept]), whole)
            for k, rows in dealt.items():
                rests[k] = rows[0].left
            rest, share = rests[context], np.zeros(len(at))
            share[follows] = np.where(
                count >= least, (count - DISCOUNT) / np.maximum(1, whole)[grams // size], 0.0)[which]
            p[at] = np.where(np.isnan(rest), p[at], np.where(share > 0, share, rest * p[at]))
        return np.log10(p) - np.log10(root)

    def _heavy_contexts(self, keys, whole, heavy):
        """{context: its rows} of heavy words; their counts take the place of those here."""
        dealt = {}
        for r in heavy.itertuples():
            k = int(np.searchsorted(keys, r.word))
            if k < len(keys) and keys[k] == r.word:
                whole[k] = r.whole
                dealt.setdefault(k, []).append(r)
        return dealt

    def _sum_up(self, k, rows, grams, count):
        """Put the next-word counts of all tasks in the place of those here."""
        a, b = np.searchsorted(grams, [k * self.size, (k + 1) * self.size])
        count[a:b] = 0
        if a == b:
            return
        for r in rows:
            found = _Unpacked(r.data)
            after, counts = found.planes(r.size, np.int64), found.planes(r.size, np.int64)
            after, counts = after[after < self.size], counts[after < self.size]
            place = np.minimum(a + np.searchsorted(grams[a:b], k * self.size + after), b - 1)
            here = grams[place] == k * self.size + after
            count[place[here]] = counts[here]


def _train_sizes(batches):
    for batch in batches:
        sums = []
        for ids, counts in zip(batch["ids"], batch["counts"]):
            fold = [None if i == NO_ID else i for i in np.frombuffer(ids, "<i8").tolist()]
            stays = np.array([f != HELD_OUT for f in crc32_mod(fold, FOLDS)], bool)
            sums.append(int((np.frombuffer(counts, "<i8") + 1)[stays].sum()))
        yield pd.DataFrame({"n": sums})


_SCORED = "block long, size long, entries long, data binary"


def score_texts(docs, doc_id="doc_id", text="text"):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    def keep(rows, name):
        return stored_by(rows, "block", sized_partitions(docs), name)

    blocks = make_blocks(docs, doc_id, text, lower=True, block_words=RUN_TOKENS, keep=keep)
    buckets = max(1, -(-(blocks.agg(F.sum("n_words")).first()[0] or 0) // BUCKET_TOKENS))
    sizes = blocks.select("ids", "counts").mapInPandas(_train_sizes, "n long")
    train_tokens = sizes.agg(F.sum("n")).first()[0] or 0
    least = max(LEAST, P_MIN * train_tokens)
    words = stored(_count_words(blocks, buckets, least), "words")
    vocabulary = words.where(F.col("block") == _VOCABULARY)
    base = train_tokens + (vocabulary.agg(F.sum("kinds")).first()[0] or 0) + 1
    heavy = _heavy_words(vocabulary)

    def ask(row, found):
        return _places(row.iloc[0], found, base, buckets) if len(row) else _frame([], _ASKED)

    def meet(group, states):
        if not len(group):
            return _frame([], _SCORED)
        if group["bucket"].iloc[0] < 0:
            return group[["block", "size", "entries", "data"]]
        bucket = Bucket(group)
        scores, at, rows = bucket.scores(states, base, least), 0, []
        for block, owner in zip(group["block"], bucket.owners):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sums = np.rint(np.add.reduceat(scores[at : at + len(owner)], first) / UNIT).astype(np.int64)
            at, first, sums = at + len(owner), first[sums != 0], sums[sums != 0]
            rows.append((block, len(first), 1, _pack(
                _planes(np.diff(owner[first], prepend=np.uint32(0))), _planes(sums))))
        return _frame(rows, _SCORED)

    def score(group):
        sums, docs, size = [], None, 0
        for n, entries, data in zip(group["size"], group["entries"], group["data"]):
            found = _Unpacked(data)
            if entries:
                sums.append((np.cumsum(found.planes(n, np.uint32), dtype=np.int64), found.planes(n, np.int64) * UNIT))
            else:
                docs, size = found, n
        ids, tokens, known = (docs.plain(size, np.int64) for _ in range(3))
        base_score = docs.plain(size, np.float64)
        held_out = np.unpackbits(docs.plain(-(-size // 8), np.uint8))[:size] > 0
        total = base_score.copy()
        for owner, values in sums:
            total[owner] += values
        names = pd.array(ids, "Int64")
        names[ids == NO_ID] = pd.NA
        return pd.DataFrame({
            "doc_id": names, "held_out": held_out, "n_tokens": tokens, "n_known": known,
            "train_tokens": train_tokens, "base_score": base_score, "score": total})

    counts = words.where(F.col("block") != _VOCABULARY).select("block", "bucket", "size", "data")
    asked = blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInPandas(ask, _ASKED)
    spark = docs.sparkSession
    states = (_heavy_states(blocks, vocabulary, heavy, base, least, buckets) if len(heavy[0])
              else spark.createDataFrame([], _FOLLOWED))
    scored = asked.groupBy("bucket").cogroup(states.groupBy("bucket")).applyInPandas(meet, _SCORED)
    return scored.groupBy("block").applyInPandas(score, (
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double"))


def op1_suffix_tree(spark, sf_dir):
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
