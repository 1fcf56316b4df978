"""Token counts by finite-state tokenizer compilation.

The tokenizer file is compiled into two deterministic transducers:

* ``SPLITTER`` reads classes of code points and marks on its transitions where a word (a piece that merges never cross)
  begins. Texts are cut into chunks that are read at once, each from all states: a chunk is then a map from state to
  state. The maps are composed by a parallel prefix scan, which gives the state in which each chunk is really entered,
  and a second reading from that state yields the marks.
* ``Counter`` reads the bytes of a word. A state knows the last token of every prefix at which a longer token may still
  begin; a transition carries by how many the number of tokens changes, and a state carries the change at the end
  of the word. States and transitions are compiled when first reached. All distinct words of a slice
  step through the transducer together, one byte at a time, and each distinct (state, byte) is looked up once.

Classes of code points, lower case and composition are read off the library's own normaliser, so they
are those of its Unicode version. Added tokens that stand in a text count as one token each, as the
library's default has it.

Texts never leave their task: no shuffle. A text longer than a slice is cut in front of blanks, at which the
splitter is in the same state whatever was read before, so counts add up.

Defined cases: null and empty texts have no bytes and no tokens; repeated rows and ids give one row each;
other columns are not read; a byte of a word that has no token of its own gives none (no unknown token is
defined), as in the library.
"""
from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K

BLANK, LETTER, NUMBER, SIGN, QUOTE = range(5)
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")  # fixed values of the tokenizer's pattern, after a quote sign
LANES = 512            # code points of a chunk
MOST_STATES = 120_000  # compiled states that a task keeps; beyond them it starts anew
SLICE_CHARS = 2 << 20
BLOCK = 1 << 14        # code points that are asked of the library at a time

WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splitter():
    """(next state, mark) by state and class. Marks: 1 a word begins here, 2 one began at the character before.

    Classes beyond QUOTE are the letters of contractions, one each. States: 0 between words, 1 in letters,
    2 in signs, 3 after a quote that began a word, then one for each first letter of a longer contraction."""
    letters = sorted({c for x in CONTRACTIONS for c in x})
    classes = {c: QUOTE + 1 + i for i, c in enumerate(letters)}
    longer = sorted({x[0] for x in CONTRACTIONS if len(x) == 2})
    between, inside, signs, quote = range(4)
    waiting = {c: 4 + i for i, c in enumerate(longer)}
    n_states, n_classes = 4 + len(longer), QUOTE + 1 + len(letters)
    step, mark = np.zeros((n_states, n_classes), np.uint8), np.zeros((n_states, n_classes), np.uint8)
    all_letters = [LETTER, *classes.values()]

    def put(state, kinds, to, begins):
        for k in kinds:
            step[state, k], mark[state, k] = to, begins

    for state in (between, inside, signs, quote):
        put(state, [BLANK], between, 0)
        put(state, all_letters, inside, int(state != inside))
        put(state, [NUMBER], between, 1)  # each number is a word of its own
        put(state, [SIGN], signs, int(state in (between, inside)))
        put(state, [QUOTE], signs if state in (signs, quote) else quote, int(state in (between, inside)))
    for x in CONTRACTIONS:
        put(quote, [classes[x[0]]], waiting[x[0]] if len(x) == 2 else between, 0)
    for c, state in waiting.items():
        # the quote was a word of its own and its letter began another one, unless the contraction ends here
        for k in range(n_classes):
            put(state, [k], step[inside, k], mark[inside, k] | 2)
        for x in CONTRACTIONS:
            if len(x) == 2 and x[0] == c:
                put(state, [classes[x[1]]], between, 0)
    return step, mark, classes


def split_marks(kinds: np.ndarray, step: np.ndarray, mark: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """The positions at which words begin, from the classes of all characters (entered between words, ended by a blank)."""
    n, states = len(kinds), len(step)
    lanes = min(lanes, max(1, n))
    chunks = -(-n // lanes)
    grid = np.zeros((chunks, lanes), np.uint8)
    grid.reshape(-1)[:n] = kinds
    grid = np.ascontiguousarray(grid.T)
    # every chunk from every state: a chunk is a map of states
    maps = np.repeat(np.arange(states, dtype=np.uint8)[None, :], chunks, axis=0)
    flat, width = step.reshape(-1), step.shape[1]
    for row in grid:
        maps = flat[maps.astype(np.intp) * width + row[:, None]]
    # parallel prefix scan: maps[i] becomes the composition of all maps up to i
    shift = 1
    while shift < chunks:
        before = np.concatenate([np.repeat(np.arange(states, dtype=np.uint8)[None, :], shift, axis=0), maps[:-shift]])
        maps = np.take_along_axis(maps, before.astype(np.intp), axis=1)
        shift *= 2
    state = np.append(np.uint8(0), maps[:-1, 0]).astype(np.intp)
    marks = np.empty((lanes, chunks), np.uint8)
    flat_mark = mark.reshape(-1)
    for i, row in enumerate(grid):
        at = state * width + row
        marks[i] = flat_mark[at]
        state = flat[at].astype(np.intp)
    marks = marks.T.reshape(-1)[:n]
    begins = (marks & 1).astype(bool)
    begins[:-1] |= (marks[1:] & 2).astype(bool)
    return np.flatnonzero(begins)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable ones for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Vocabulary:
    """Tokens by symbols: bytes 0 to 255, and 256 to 511 for a byte that ends its word."""

    def __init__(self, model: dict):
        suffix = model["end_of_word_suffix"]
        letters = byte_letters()
        symbol = {c: b for b, c in enumerate(letters)} | {c + suffix: 256 + b for b, c in enumerate(letters)}
        known = model["vocab"]
        self.base = {s: known[t] for t, s in symbol.items() if t in known}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}  # pair -> (rank, token)
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> (rank, left, right)
        strings = {i: (s,) for s, i in self.base.items()}
        for rank, pair in enumerate(model["merges"]):
            a, b = (known[x] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            whole = pair[0] + pair[1] if isinstance(pair, list) else pair.replace(" ", "")
            token = known[whole]
            self.merge[a, b] = rank, token
            self.parts.setdefault(token, (rank, a, b))
            strings[token] = strings[a] + strings[b]
        self.tokens = {}
        for token, s in strings.items():
            self.tokens[s] = token
        self.prefixes = {s[:k] for s in self.tokens for k in range(1, len(s))}
        self._fits: dict[tuple[int, int], bool] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether the merges, run on the characters of token a and then b, leave just these two tokens.

        The merges inside both happen in order of rank; a merge across the border would have to come before one of
        them undoes its pair. The latest merge on either side is taken back until none is left."""
        got = self._fits.get((a, b))
        if got is None:
            got = self._fits[a, b] = self._check(a, b)
        return got

    def _check(self, a: int, b: int) -> bool:
        limit = None  # (rank, side) of the merge taken back last; a crossing merge before it would have come first
        while True:
            crossing = self.merge.get((a, b))
            if crossing is not None and (limit is None or crossing[0] < limit[0] or (crossing[0] == limit[0] and limit[1])):
                return False
            left, right = self.parts.get(a), self.parts.get(b)
            if left is None and right is None:
                return True
            # equal merges run from left to right, so on the right side the crossing one comes first
            if right is None or (left is not None and left[0] > right[0]):
                limit, a = (left[0], False), left[2]
            else:
                limit, b = (right[0], True), right[1]


class Counter:
    """The transducer over the bytes of words, compiled as far as it was reached."""

    def __init__(self, model: dict):
        self.vocabulary = Vocabulary(model)
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.moves: dict[int, tuple[int, int]] = {}  # state * 512 + symbol -> next state, change of the number of tokens
        self._state(((), ((0, None, 0),)))

    def _state(self, key: tuple) -> int:
        """A state: the bytes read since the first place at which a token may still begin, and for each such place the
        bytes read since, the last token before it and how many tokens end there, less those that end at the last byte."""
        at = self.number.get(key)
        if at is None:
            at = self.number[key] = len(self.states)
            self.states.append(key)
        return at

    def move(self, state: int, symbol: int) -> tuple[int, int]:
        known = self.moves.get(state << 9 | symbol)
        if known is None:
            known = self.moves[state << 9 | symbol] = self._compile(state, symbol)
        return known

    def _compile(self, state: int, symbol: int) -> tuple[int, int]:
        voc = self.vocabulary
        read, places = self.states[state]
        if symbol & 255 not in voc.base:
            return state, 0  # a byte without a token leaves no trace
        read = (*read, symbol)
        token = change = None
        for back, last, tokens in places:  # the one token that ends here and fits what stands before it
            found = voc.tokens.get(read[len(read) - 1 - back:])
            if found is not None and (last is None or voc.fits(last, found)):
                token, change = found, tokens + 1
                break
        if symbol >= 256:
            return 0, change
        # a place stays as long as what follows it begins some token
        kept = [(back + 1, last, tokens - change) for back, last, tokens in places if read[len(read) - 1 - back:] in voc.prefixes]
        kept.append((0, token, 0))
        return self._state((read[len(read) - kept[0][0]:], tuple(kept))), change

    def count(self, words: pa.Array) -> np.ndarray:
        """Tokens of each of the (distinct, not empty) words, an Arrow array of bytes."""
        if len(self.states) > MOST_STATES:
            self.clear()
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2], np.uint8).astype(np.int64)
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = offsets[:-1][order], lengths[order]
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        longest = int(lengths[0]) if len(lengths) else 0
        alive = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right") if longest else []
        for k, live in enumerate(alive):
            symbol = data[starts[:live] + k] + 256 * (lengths[:live] == k + 1)
            keys, inverse = np.unique(state[:live] << 9 | symbol, return_inverse=True)
            moved = np.array([self.move(key >> 9, key & 511) for key in keys.tolist()], np.int64).reshape(-1, 2)
            state[:live] = moved[inverse, 0]
            total[:live] += moved[inverse, 1]
        out = np.empty(len(order), np.int64)
        out[order] = total
        return out


def compile_tables(spec: str) -> dict:
    """What tasks need of a tokenizer file (JSON text): classes and lower case of code points as runs, added tokens, merges.

    Raises ValueError for a file whose steps are other than those this transducer is compiled from."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    read = json.loads(spec)
    kinds = [n["type"] for n in read["normalizer"]["normalizers"]]
    split = read["pre_tokenizer"]["pretokenizers"][0]
    if kinds != ["NFC", "Replace", "Lowercase"] or split.get("pattern", {}).get("Regex") != WORD_PATTERN or not read["model"].get("end_of_word_suffix"):
        raise ValueError("the tokenizer file has other steps than composition, blanks, lower case, word pattern, byte pairs with word ends")
    step, mark, classes = splitter()
    kind = np.full(0x110000, SIGN, np.uint8)
    single, longer = np.arange(0x110000, dtype=np.uint32), {}
    patterns = [(code, pre_tokenizers.Split(Regex(p), "removed", invert=True)) for code, p in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+"))]
    lower = normalizers.Lowercase()
    for low in range(0, 0x110000, BLOCK):
        points = [c for c in range(low, low + BLOCK) if not 0xD800 <= c < 0xE000]
        every = "".join(map(chr, points))
        for code, split in patterns:
            for _, (a, b) in split.pre_tokenize_str(every) if every else ():
                kind[points[a:b]] = code
        # lower case of each code point, as the library has it: one line each
        by_line = [c for c in points if c != 10]
        for c, line in zip(by_line, lower.normalize_str("\n".join(map(chr, by_line))).split("\n")):
            if len(line) == 1:
                single[c] = ord(line)
            else:
                longer[c] = line
    kind[ord("'")] = QUOTE
    for c, code in classes.items():
        kind[ord(c)] = code
    shift = single.astype(np.int64) - np.arange(0x110000)
    runs = lambda x: (np.flatnonzero(np.diff(x, prepend=x[0] - 1)), x[np.flatnonzero(np.diff(x, prepend=x[0] - 1))])
    return {"kind": runs(kind.astype(np.int64)), "shift": runs(shift), "longer": longer,
            "added": [t["content"] for t in read["added_tokens"]], "model": json.dumps({k: read["model"][k] for k in ("vocab", "merges", "end_of_word_suffix")})}


def _expand(runs) -> np.ndarray:
    at, value = runs
    return np.repeat(value, np.diff(np.append(at, 0x110000)))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class TextCounter:
    """Counts the tokens of texts with the compiled tables."""

    def __init__(self, tables: dict):
        from tokenizers import normalizers

        self.kind = _expand(tables["kind"]).astype(np.uint8)
        self.lower = (_expand(tables["shift"]) + np.arange(0x110000)).astype(np.uint32)
        self.longer = tables["longer"]
        self.has_longer = re.compile("[" + "".join(map(chr, self.longer)) + "]") if self.longer else None
        self.added = re.compile("|".join(map(re.escape, sorted(tables["added"], key=len, reverse=True)))) if tables["added"] else None
        self.compose = normalizers.NFC()
        self.step, self.mark, _ = splitter()
        self.counter = Counter(json.loads(tables["model"]))

    def count(self, texts: list[str]) -> np.ndarray:
        """Numbers of tokens of texts (a slice)."""
        n = np.zeros(len(texts), np.int64)
        parts = []
        for i, text in enumerate(texts):
            if self.added and "<" in text:
                text, specials = self.added.subn("\n", text)  # a blank ends words as an added token does
                n[i] += specials
            parts.append(text)
        points = code_points("\n".join(parts) + "\n")
        if points.max() >= 0x300:  # below it, nothing composes
            parts = [self.compose.normalize_str(p) for p in parts]
            parts = [p.translate(self.longer) if self.has_longer and self.has_longer.search(p) else p for p in parts]
            points = code_points("\n".join(parts) + "\n")
        elif self.has_longer and self.has_longer.search("".join(parts)):
            parts = [p.translate(self.longer) for p in parts]
            points = code_points("\n".join(parts) + "\n")
        borders = np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)))
        points = self.lower[points]
        kinds = self.kind[points]
        begins = split_marks(kinds, self.step, self.mark)
        if not len(begins):
            return n
        ink = kinds != BLANK
        owner = np.searchsorted(borders, begins, side="right")
        place = np.cumsum(ink) - 1
        data = points[ink]
        size = (1 + (data >= 0x80) + (data >= 0x800) + (data >= 0x10000)).astype(np.int64)
        byte_at = np.append(0, np.cumsum(size))
        joined = np.frombuffer(data.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        words = K.piece_array(joined, byte_at[place[begins]]).dictionary_encode()
        tokens = self.counter.count(words.dictionary)[np.asarray(words.indices)]
        n += np.bincount(owner, weights=tokens, minlength=len(texts)).astype(np.int64)
        return n


def cut_long(text: str, most: int = SLICE_CHARS):
    """Pieces of a long text, each but the first beginning with a blank."""
    a = 0
    blank = re.compile(r"[ \t\n\r]")
    while len(text) - a > most:
        cut = blank.search(text, a + most)
        if not cut:
            break
        yield text[a:cut.start()]
        a = cut.start()
    yield text[a:]


def _count(tables):
    def run(batches):
        counter = TextCounter(tables)
        for batch in batches:
            column = pc.fill_null(batch.column(1), "")
            sizes = pc.binary_length(column)
            texts, n = column.to_pylist(), np.zeros(batch.num_rows, np.int64)
            a = 0
            while a < len(texts):
                b, chars = a, 0
                while b < len(texts) and (b == a or chars + len(texts[b]) <= SLICE_CHARS):
                    chars += len(texts[b])
                    b += 1
                if chars > SLICE_CHARS:
                    n[a] = sum(int(counter.count([piece])[0]) for piece in cut_long(texts[a]))
                else:
                    n[a:b] = counter.count(texts[a:b])
                a = b
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.cast(sizes, pa.int64()), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])
    return run


def count_tokens(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every row; ``spec`` is the tokenizer file's JSON text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_count(compile_tables(spec)), "doc_id long, n_bytes long, n_tokens long")
