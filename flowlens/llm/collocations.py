"""Phrase collocation mining over a HAT-trie of word ids.

Each task counts phrases in a HAT-trie (class ``HatTrie``): a shallow trie over word ids whose leaves are
hash containers of the remaining ids; a container that grows too large bursts into a trie node by its
next word id. When the trie holds too many phrases, whole subtrees are spilled as sorted runs (phrase,
count). The runs are written, dealt by range of the phrase (a partition of prefixes; a frequent first
word spreads over as many partitions as it needs) and merged there.

A phrase is frequent only if its words and pairs of neighbours are, so a first pass finds out which words and pairs can
be: it counts their hashes (31 bits). A second pass counts the hashes of three to five words that hold only such pairs. Tasks send sorted runs of (hash, count) by range of the hash, and each range is
added up in a table of counters of fixed size. Hashes that reach the least count travel with the tasks of the next pass as a bit map
of at most ``MOST_BITS`` bits, sized by their number. The third pass counts, in the trie, the phrases whose hashes did. Equal
hashes only add up, so rare phrases may pass (more of them when a map is full), which the exact counts drop, but no
frequent phrase is ever stopped.

Scores, cuts and containment are DataFrame joins on the frequent phrases; sums and products are decimals of
38 digits.

Defined cases: a null text is empty; a null lang is ``und`` (and shares its counts with that value);
words are lower-cased in A-Z only; repeated rows and ids count as often as they stand in the table; an
empty table gives no rows; other columns are not read; ranks are unique, as a phrase stands once for each language.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .bpe import squeeze, unsqueeze
from .common import written

LONGEST = 5
BURST = 4_096          # phrases in a container before it bursts
MOST_PHRASES = 400_000  # phrases in a task's trie before subtrees are spilled
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27
BITS_PER_KEY = 16
HASH_BITS = 31
RANGES = 1_024          # ranges of hashes; a range has 2^21 counters (8 MB)
MOST_HASHES = 4_000_000  # distinct hashes that a task holds before it sends a run
UNKNOWN_LANG = "und"


class HatTrie:
    """Counts of tuples of word ids. Nodes are dicts by word id; containers are dicts of packed ids -> count."""

    def __init__(self, burst: int = BURST):
        self.burst = burst
        self.root: dict[int, Node | Container] = {}
        self.size: dict[int, int] = {}  # phrases below each first word

    def add(self, phrases: np.ndarray, counts: np.ndarray) -> None:
        """Adds rows of word ids (all of one length) with their counts."""
        width = phrases.shape[1]
        packed = np.ascontiguousarray(phrases, dtype=">u4").tobytes()
        step = 4 * width
        for at, first, n in zip(range(0, len(packed), step), phrases[:, 0].tolist(), counts.tolist()):
            place, tail = self.root.get(first), packed[at + 4:at + step]
            if place is None:
                place = self.root[first] = Container()
                self.size[first] = 0
            parent, key = self.root, first
            while isinstance(place, Node):
                if not tail:
                    break
                parent, key = place, int.from_bytes(tail[:4], "big")
                tail = tail[4:]
                place = parent.get(key)
                if place is None:
                    place = parent[key] = Container()
            if isinstance(place, Node):
                self.size[first] += not place.count
                place.count += n
                continue
            old = place.get(tail)
            place[tail] = n if old is None else old + n
            if old is None:
                self.size[first] += 1
                if len(place) > self.burst and any(place):
                    parent[key] = place.burst_open()

    def __len__(self) -> int:
        return sum(self.size.values())

    def subtree(self, first: int):
        """(ids, count) of all phrases that begin with a word, parents first, each container in order of ids."""
        stack: list[tuple[tuple[int, ...], Node | Container]] = [((first,), self.root[first])]
        while stack:
            path, place = stack.pop()
            if isinstance(place, Node):
                if place.count:
                    yield path, place.count
                stack += [((*path, k), place[k]) for k in sorted(place, reverse=True)]
            else:
                for tail in sorted(place):
                    yield path + tuple(np.frombuffer(tail, ">u4").tolist()), place[tail]

    def spill(self, keep: int):
        """Takes whole subtrees out, the largest first, until at most ``keep`` phrases are left."""
        left = len(self)
        for first in sorted(self.size, key=self.size.get, reverse=True):
            if left <= keep:
                break
            yield from self.subtree(first)
            left -= self.size.pop(first)
            del self.root[first]


class Container(dict):
    """Packed remaining ids -> count."""

    def burst_open(self) -> Node:
        node = Node()
        for tail, n in self.items():
            if not tail:
                node.count = n
                continue
            node.setdefault(int.from_bytes(tail[:4], "big"), Container())[tail[4:]] = n
        return node


class Node(dict):
    """Next word id -> node or container, and the count of the phrase that ends here."""

    count = 0


def piece_words(data: np.ndarray, offsets: np.ndarray):
    """Of lower-cased texts: the bytes of all words without gaps, the start of each word in them, the document of
    each word, and whether the word before it stands in the same piece."""
    table = np.zeros(256, np.uint8)
    table[[32, 9]] = 1
    table[[46, 44, 59, 58, 33, 63, 10, 11, 12, 13]] = 2  # ends of pieces
    kind = table[data]
    ink = kind == 0
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    start = ink.copy()
    start[1:] &= ~ink[:-1] | border[1:-1]
    starts = np.flatnonzero(start)
    ends = np.cumsum((kind == 2) | border[:-1])  # pieces begun or ended up to each byte
    piece = ends[starts]
    joined = np.append(False, piece[1:] == piece[:-1])[:len(starts)]
    place = np.cumsum(ink) - 1
    return data[ink], place[starts], np.searchsorted(offsets, starts, side="right") - 1, joined


def lang_hashes(langs: pa.Array) -> np.ndarray:
    data, offsets = K.text_buffers(langs)
    return K.span_hashes(data, offsets[:-1], offsets[1:])


def word_keys(words: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """64-bit keys of words of a language, from the hashes of both."""
    with np.errstate(over="ignore"):
        return K.mix64(words + langs * np.uint64(0x9E3779B97F4A7C15))


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return K.mix64(first * np.uint64(0x9FB21C651E98DF25) + second)


def short(keys: np.ndarray) -> np.ndarray:
    """The HASH_BITS-bit hash by which words and pairs are counted in the first pass."""
    return (keys >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def in_bits(keys: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Whether each 64-bit key may be in a bit map (bytes)."""
    at = short(keys) & (8 * len(filled) - 1)
    return (filled[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _added(keys: list[np.ndarray], counts: list[np.ndarray]):
    """Sorted distinct keys and their summed counts."""
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k = k[order]
    first = np.flatnonzero(np.diff(k, prepend=-1))
    return k[first], np.add.reduceat(n[order], first)


HASH_SCHEMA = "part int, run binary, lang string, n long"


def read_words(batch):
    """Of each slice of a batch (lang, text): names of languages, the language and 64-bit key of each word, words in piece order
    (bytes, starts), and whether the word before stands in the same piece."""
    lang_of = batch.column(0).dictionary_encode()
    names, of_lang = lang_of.dictionary.to_pylist(), lang_hashes(lang_of.dictionary)
    codes = np.asarray(lang_of.indices).astype(np.int64)
    data, offsets = K.text_buffers(batch.column(1))
    for a, b in K.slices(offsets):
        text, starts, doc, joined = piece_words(K.ascii_lower(data[offsets[a]:offsets[b]]), offsets[a:b + 1] - offsets[a])
        if len(starts):
            lang = codes[a:b][doc]
            key = word_keys(K.span_hashes(text, starts, np.append(starts[1:], len(text))), of_lang[lang])
            yield names, lang, key, text, starts, joined


def chains(key: np.ndarray, joined: np.ndarray, filled: np.ndarray, longer: np.ndarray | None = None):
    """For 1 to LONGEST words: the hash of the phrase that ends at each word, and whether it may be frequent."""
    reach = in_bits(key, filled)
    yield key, reach
    linked = joined & reach & np.append(False, reach[:-1])
    h = key
    for width in range(2, LONGEST + 1):
        h = np.append(np.uint64(0), pair_keys(h[:-1], key[1:]))
        # both phrases of one word less may be frequent
        reach = linked & reach & np.append(False, reach[:-1])
        at = np.flatnonzero(reach)
        if width == 2 or longer is not None:
            reach[at] = in_bits(h[at], filled if width == 2 else longer)
        if width == 2:
            linked = reach.copy()
        yield h, reach


def _hashes(filled=None):
    """Texts -> runs (range of hashes, sorted hashes and counts), and words of each language.

    Without a bit map words and pairs are counted, with it phrases of three words and more."""
    return lambda batches: _hash_runs(batches, filled)


def _hash_runs(batches, filled):
    keys, counts, size, totals = [], [], 0, {}
    per = 1 << (HASH_BITS - RANGES.bit_length() + 1)

    def run():
        k, n = _added(keys, counts)
        keys.clear(), counts.clear()
        part = k // per
        cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(k))
        blobs = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            inner = np.diff(k[a:b] - part[a] * per, prepend=0).astype("<u4")
            blobs.append(squeeze(np.concatenate([inner, n[a:b].astype("<u4")])))
        none = len(blobs)
        return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]].astype(np.int32)), pa.array(blobs, pa.binary()), pa.nulls(none, pa.string()), pa.nulls(none, pa.int64())],
                                          names=["part", "run", "lang", "n"])

    for batch in batches:
        for names, lang, word, _, _, joined in read_words(batch):
            if filled is None:
                for k, n in enumerate(np.bincount(lang, minlength=len(names)).tolist()):
                    totals[names[k]] = totals.get(names[k], 0) + n
                pairs = np.flatnonzero(joined)
                hashed = [word, pair_keys(word[pairs - 1], word[pairs])]
            else:
                hashed = [h[reach] for h, reach in list(chains(word, joined, filled))[2:]]
            found, n = np.unique(short(np.concatenate(hashed)), return_counts=True)
            if not len(found):
                continue
            keys.append(found)
            counts.append(n)
            size += len(found)
            if size > MOST_HASHES:
                k, n = _added(keys, counts)
                keys[:], counts[:], size = [k], [n], len(k)
                if size > MOST_HASHES // 2:
                    yield run()
                    size = 0
    if keys:
        yield run()
    if totals:
        none = len(totals)
        yield pa.RecordBatch.from_arrays([pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary()), pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())],
                                         names=["part", "run", "lang", "n"])


def _frequent_hashes(least: int):
    """Runs dealt by range, in order of it -> hashes that reach the least count. One table of counters at a time."""
    per = 1 << (HASH_BITS - RANGES.bit_length() + 1)

    def run(batches):
        part, counters = None, None

        def reached():
            return pa.RecordBatch.from_arrays([pa.array(part * per + np.flatnonzero(counters >= least))], names=["hash"])

        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if p != part:
                    if part is not None:
                        yield reached()
                    part, counters = p, np.zeros(per, np.int64)
                values = unsqueeze(blob.as_py()).astype(np.int64)
                half = len(values) // 2
                counters[np.cumsum(values[:half])] += values[half:]
        if part is not None:
            yield reached()
    return run


RUN_SCHEMA = "lang string, phrase string, words int, f long"


def _count(filled, longer):
    """Texts -> sorted runs of the phrases that may be frequent."""
    def run(batches):
        trie, ids, names = HatTrie(), {}, []

        def rows(found):
            out = []
            for path, n in found:
                out.append((names[path[0]][0], b" ".join([names[i][1] for i in path]), len(path), n))
                if len(out) >= 100_000:
                    yield table(out)
                    out = []
            if out:
                yield table(out)

        def table(out):
            out.sort()
            lang, phrase, width, n = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(width, pa.int32()),
                                               pa.array(n, pa.int64())], names=["lang", "phrase", "words", "f"])

        for batch in batches:
            for langs, lang, key, text, starts, joined in read_words(batch):
                coded = K.piece_array(text, starts).dictionary_encode()
                words, known = coded.dictionary, len(coded.dictionary)
                distinct, word = np.unique(lang * known + np.asarray(coded.indices), return_inverse=True)
                place = np.full(len(distinct), -1)
                node, paths = word.astype(np.int64), np.arange(len(distinct))[:, None]  # the phrase that ends at a word
                for width, (_, reach) in enumerate(chains(key, joined, filled, longer), 1):
                    at = np.flatnonzero(reach)
                    if not len(at):
                        break
                    if width == 1:
                        found, n = np.unique(word[at], return_counts=True)
                        for k in found.tolist():
                            w = (langs[distinct[k] // known], words[int(distinct[k] % known)].as_py())
                            if w not in ids:
                                ids[w] = len(names)
                                names.append(w)
                            place[k] = ids[w]
                        trie.add(place[found][:, None], n)
                        continue
                    found, inverse, n = np.unique(node[at - 1] * len(distinct) + word[at], return_inverse=True, return_counts=True)
                    paths = np.column_stack([paths[found // len(distinct)], found % len(distinct)])
                    node = np.zeros(len(word), np.int64)
                    node[at] = inverse
                    trie.add(place[paths], n)
                if len(trie) > MOST_PHRASES:
                    yield from rows(trie.spill(MOST_PHRASES // 2))
                if len(names) > 4 * MOST_PHRASES:  # ids of words that no subtree holds are given up with the trie
                    yield from rows(trie.spill(0))
                    ids, names = {}, []
        yield from rows(trie.spill(0))
    return run


def bit_map(hashes: DataFrame) -> np.ndarray:
    """A bit map of the hashes, sized by their number; at most MOST_BITS / 64 rows reach the driver."""
    n = hashes.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (max(1, n) * BITS_PER_KEY - 1).bit_length()))
    at = F.col("hash") % bits
    got = hashes.groupBy(F.floor(at / 64).alias("place")).agg(F.bit_or(F.expr("shiftleft(1L, cast(hash % 64 AS INT))")).alias("filled")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[np.asarray(got.column("place")).astype(np.int64)] = np.asarray(got.column("filled"))
    return out.view(np.uint8)


def _likely(runs: DataFrame, least: int) -> DataFrame:
    """Hashes that reach the least count."""
    dealt = runs.where("part is not null").select("part", "run").repartition("part").sortWithinPartitions("part")
    return written(dealt.mapInArrow(_frequent_hashes(least), "hash long"), "phrase-likely")


def phrase_counts(docs: DataFrame, least: int, text_col: str = "text", lang_col: str = "lang"):
    """(frequent, totals): lang, phrase, words, f of all phrases of one to five words with f >= least; lang, n."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"), F.col(text_col).alias("text"))
    first = written(rows.mapInArrow(_hashes(), HASH_SCHEMA), "phrase-hashes")
    totals = written(first.where("lang is not null").groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    filled = bit_map(_likely(first, least))
    longer = bit_map(_likely(written(rows.mapInArrow(_hashes(filled), HASH_SCHEMA), "phrase-hashes"), least))
    runs = written(rows.mapInArrow(_count(filled, longer), RUN_SCHEMA), "phrase-runs")
    merged = runs.repartitionByRange("lang", "phrase", "words").groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
    return written(merged.where(F.col("f") >= least), "phrases"), totals


def _part(phrase: str, start: Column | int, size: Column | int) -> Column:
    words = F.split(phrase, " ")
    return F.array_join(F.slice(words, start, size), " ")


def collocations(docs: DataFrame, least: int = 100, cover_percent: int = 100, top: int = 2000,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best ``top`` phrases of each language.

    A phrase of two to five words with a = f >= ``least`` scores floor(1000 a n / (l r)) at its lowest cut; it is dropped
    if a longer candidate that contains it occurs in ``cover_percent`` of its places or more."""
    frequent, totals = phrase_counts(docs, least, text_col, lang_col)
    candidates = frequent.where("words > 1")
    f_of = lambda name, f: frequent.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))

    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part("phrase", F.lit(1), F.col("k")).alias("head"),
                       _part("phrase", F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    cuts = cuts.join(f_of("head", "l"), ["lang", "head"]).join(f_of("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    # 1000 a n < 10^38 and l r < 10^36 for counts below 10^17; the quotient is at most 1000 n / least
    product = (wide("a") * wide("n")).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)")
    scored = cuts.withColumn("top", product.cast("decimal(38,0)")).withColumn("bottom", (wide("l") * wide("r")).cast("decimal(38,0)"))
    scored = scored.withColumn("score", F.expr("top div bottom")).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("best"))

    inner = candidates.where("words > 2").select("lang", F.col("f").alias("outer_f"), "phrase", "words", F.explode(F.expr("sequence(2, words - 1)")).alias("size"))
    inner = inner.select("lang", "outer_f", "phrase", "size", F.explode(F.expr("sequence(1, words - size + 1)")).alias("start"))
    covers = (inner.select("lang", "outer_f", _part("phrase", F.col("start"), F.col("size")).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("outer_f").alias("outer_f")))
    kept = (scored.join(covers, ["lang", "phrase"], "left")
            .where(F.col("outer_f").isNull() | (100 * F.col("outer_f") < cover_percent * F.col("best.a"))))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return (kept.select("lang", "phrase", "best.a", "best.l", "best.r", "best.n", "best.score")
            .withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
