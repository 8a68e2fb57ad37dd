"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

A text is cut into marked words: runs of the space mark followed by other code points. No piece of the
vocabulary has the mark after another code point (checked on loading), so no piece crosses a cut and the
words are encoded one by one; for BPE they are cut further where letters end or begin and no piece joins the two code points.
Per batch of texts the distinct words are sorted and walked as a trie, depth first: a step down extends the lattice
by one code point, a step back drops it, so words with a common prefix share that prefix's forward states and each trie node
is computed once. The pieces that end at a code point come from an automaton (Aho-Corasick), whose state is part of the node.

The forward state depends on the model:

* unigram: the best score of the prefix and the length of its last piece (Viterbi);
* BPE: the last piece of the prefix's encoding. A merge sequence that never crosses a border is the same
  with and without what stands beyond it, so the encoding of a prefix ends in piece p exactly if p encodes to
  itself, the prefix before p ends in some piece q, and merging q + p gives (q, p) back. One arc per
  prefix passes; scores only decide merges. The ids equal those of the sentencepiece library.

Unknown code points become their UTF-8 byte pieces, or the unknown id where the model has none.

Decoding maps ids to pieces, joins bytes, turns marks into spaces and drops the first one, the dummy prefix.
It inverts the encoding of every text without U+2581 (the mark itself, which comes back as a space, as in the
library) when the model has byte pieces.

Defined cases: a null or empty text has no ids and decodes to an empty text; a null id list decodes to an
empty text, ids that the model lacks are skipped, null and control ids too; repeated rows are encoded alike; an empty table gives an
empty result; other columns are carried along and a column already named like the output is replaced.

Scale: no shuffle. A batch's texts are taken in slices of at most ``SLICE`` code points (a longer text is a slice of
its own), id lists in slices of ``IDS`` ids, the trie holds one word's path at a time, and the tables of compatible pairs and of lately encoded words are bounded.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, StringType, StructField, StructType
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from ledgerlens.llm.common import small_batches

MARK = "▁"
SLICE = 1 << 22
MOST_PAIRS = 1 << 19
# encoded words that a worker keeps from earlier slices, in two generations of half as many each
MOST_WORDS = 200_000
# ids decoded at once (a longer list is decoded alone)
IDS = 1 << 18
_LETTER = re.compile(r"[^\W\d_]")
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


@dataclass
class Vocabulary:
    """Pieces of one model; built on the driver, sent to the tasks (its size is that of the model file)."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes_of: dict[int, int]
    skipped: frozenset[int]
    unknown: int
    bpe: bool
    pairs: dict[int, bool] = field(default_factory=dict)
    known: dict[str, bytes] = field(default_factory=dict)
    older: dict[str, bytes] = field(default_factory=dict)

    def __post_init__(self):
        self.longest = max(map(len, self.ids), default=1)
        self.pieces = {i: p for p, i in self.ids.items()}
        self.byte_ids = {b: i for i, b in self.bytes_of.items()}
        self.unknown_score = min(self.scores.values(), default=0.0) - 10.0
        self.words = self.cut()
        # usable pieces as an automaton over code points (Aho-Corasick): a state is [next state by code point, state of its longest
        # suffix that begins a piece, (length, id) of the pieces that end here, the longest first]
        self.start: list = [{}, None, ()]
        for p, i in self.ids.items():
            if not self.bpe or self.merge(p) == [p]:
                state = self.start
                for c in p:
                    state = state[0].setdefault(c, [{}, self.start, ()])
                state[2] = ((len(p), i),)
        level = list(self.start[0].values())
        while level:
            below = []
            for state in level:
                for c, longer in state[0].items():
                    suffix = state[1]
                    while suffix is not None and c not in suffix[0]:
                        suffix = suffix[1]
                    if suffix is not None:
                        longer[1] = suffix[0][c]
                        longer[2] += longer[1][2]
                    below.append(longer)
            level = below
        # what each id stands for, in UTF-8 with marks turned into spaces: one run of bytes, cut by ``starts``; the
        # last entry stands for ids that the model lacks
        spoken = {i: p.replace(MARK, " ").encode() for i, p in self.pieces.items()} | {i: bytes([b]) for i, b in self.bytes_of.items()}
        spoken |= dict.fromkeys(self.skipped, b"") | {self.unknown: " \u2047 ".encode()}
        parts = [spoken.get(i, b"") for i in range(max(spoken, default=-1) + 1)] + [b""]
        self.blob = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.lengths = np.array(list(map(len, parts)))
        self.starts = np.cumsum(self.lengths) - self.lengths

    @classmethod
    def from_model(cls, model: bytes) -> Vocabulary:
        proto = model_pb2.ModelProto.FromString(model)
        norm, kinds = proto.normalizer_spec, model_pb2.ModelProto.SentencePiece
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
            raise ValueError("only models with the identity normalizer, a dummy prefix and whitespace kept are supported")
        if proto.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        ids, scores, bytes_of, skipped, unknown = {}, {}, {}, set(), 0
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.NORMAL:
                ids[p.piece], scores[p.piece] = i, p.score
            elif p.type == kinds.BYTE:
                bytes_of[i] = int(p.piece[1:-1], 16)
            elif p.type in (kinds.CONTROL, kinds.UNKNOWN):
                skipped.add(i)
                unknown = i if p.type == kinds.UNKNOWN else unknown
            else:
                raise ValueError("user-defined and unused pieces are not supported")
        if any(MARK in p.lstrip(MARK) for p in ids):
            raise ValueError("a piece has the space mark after another code point")
        return cls(ids, scores, bytes_of, frozenset(skipped), unknown, proto.trainer_spec.model_type == 2)

    def spell(self, char: str) -> list[int]:
        """Ids of a code point that is no piece."""
        return [self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.unknown]

    def cut(self) -> re.Pattern:
        """Matches the words to encode one by one. For BPE, letters and other code points are cut where no piece has the two beside the
        border side by side: nothing merges across it. Where some piece has them, all up to the next mark stays whole; so do
        words of unigram models, whose sums of scores round."""
        if not self.bpe:
            return _WORD
        pairs = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        joined: dict[bool, dict[str, set[str]]] = {True: {}, False: {}}
        for a, b in pairs:
            ends = bool(_LETTER.match(a))
            if a != MARK and ends != bool(_LETTER.match(b)):
                joined[ends].setdefault(b if ends else a, set()).add(a if ends else b)
        # a run of letters and what some piece joins to its last one; a run of others, and the letter that some piece joins to its last one
        kinds = {k: {c: "[" + "".join(map(re.escape, sorted(own))) + "]" for c, own in sorted(found.items())} for k, found in joined.items()}
        after = "|".join(f"(?<={own}){re.escape(c)}" for c, own in kinds[True].items()) or "(?!)"
        before = "|".join(f"(?<={re.escape(c)}){own}" for c, own in kinds[False].items()) or "(?!)"
        letter, other = _LETTER.pattern, rf"(?!{MARK})[\W\d_]"
        tail = f"(?:(?:{after})[^{MARK}]*)?"
        return re.compile(rf"{MARK}+(?:{letter}+{tail}|{other}[^{MARK}]*)?|{letter}+{tail}|(?:{other})+(?:(?:{before})[^{MARK}]*)?")

    def merge(self, symbols: str) -> list[str]:
        """BPE of a short string: the best-scored adjacent pair first, the leftmost of equals."""
        s, scores = list(symbols), self.scores
        while len(s) > 1:
            best, at = None, -1
            for i in range(len(s) - 1):
                score = scores.get(s[i] + s[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            s[at:at + 2] = [s[at] + s[at + 1]]
        return s

    def keeps(self, q: str, p: str) -> bool:
        """Whether BPE of q + p has the border between the two."""
        return self.merge(q + p) == [q, p]


class Trie:
    """The lattice along the trie path of the current word."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.word = vocabulary, ""
        # per code point: the last piece of the prefix that ends here (its length and id; unknown
        # code points have the id -1 - code point) and the forward score
        self.last: list[int] = []
        self.piece: list[int] = []
        self.best: list[float] = []
        # per code point, for BPE: the automaton's state
        self.states: list[list] = []

    def walk(self, word: str) -> list[int]:
        """Go from the last word's node to this one's and read the encoding off the path."""
        common, most = 0, min(len(self.word), len(word))
        while common < most and self.word[common] == word[common]:
            common += 1
        del self.last[common:], self.piece[common:], self.best[common:], self.states[common:]
        self.word = word
        if self.v.bpe:
            self._extend_bpe(word, common)
        else:
            for end in range(common + 1, len(word) + 1):
                self._step_unigram(word, end)
        return self._read()

    def _extend_bpe(self, word: str, common: int) -> None:
        last, piece, states, pairs, start = self.last, self.piece, self.states, self.v.pairs, self.v.start
        state = states[-1] if common else start
        for end in range(common + 1, len(word) + 1):
            char = word[end - 1]
            found = state[0].get(char)
            while found is None and state is not start:
                state = state[1]
                found = state[0].get(char)
            state = found or start
            states.append(state)
            # pieces that end here; the longest is tried first
            for length, p in state[2]:
                if length == end:
                    break
                # ids lie in a range of less than 2^22
                pair = (piece[end - length - 1] << 22) + p
                ok = pairs.get(pair)
                if ok is None:
                    if len(pairs) >= MOST_PAIRS:
                        pairs.clear()
                    begin = end - length
                    ok = pairs[pair] = self.v.keeps(word[begin - last[begin - 1]:begin], word[begin:end])
                if ok:
                    break
            else:
                # no piece: a code point that never merges with what stands before it
                length, p = 1, -1 - ord(char)
            last.append(length)
            piece.append(p)

    def _step_unigram(self, word: str, end: int) -> None:
        scores, ids, best = self.v.scores, self.v.ids, self.best
        top, length = -np.inf, 1
        # of equal scores the longest last piece wins, as in the library
        for n in range(min(end, self.v.longest), 0, -1):
            score = scores.get(word[end - n:end], self.v.unknown_score if n == 1 else None)
            if score is not None:
                score += best[end - n - 1] if end > n else 0.0
                if score > top:
                    top, length = score, n
        best.append(top)
        self.last.append(length)
        self.piece.append(ids.get(word[end - length:end], -1 - ord(word[end - 1])))

    def _read(self) -> list[int]:
        last, piece, end = self.last, self.piece, len(self.word)
        out = []
        while end:
            p = piece[end - 1]
            if p >= 0:
                out.append(p)
            else:
                out += reversed(self.v.spell(chr(-1 - p)))
            end -= last[end - 1]
        out.reverse()
        return out


def encode_texts(v: Vocabulary, texts: Sequence[str | None]) -> list[bytes]:
    """Ids of each text as int32 in memory order; the distinct words of all texts are encoded once, in trie order.

    Words that were encoded lately are looked up.
    """
    cut = [v.words.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
    trie, ids = Trie(v), {}
    for word in sorted(set().union(*cut)):
        found = v.known.get(word)
        if found is None:
            found = v.older.get(word)
            if found is None:
                found = array("i", trie.walk(word)).tobytes()
            if len(v.known) >= MOST_WORDS // 2:
                v.older, v.known = v.known, {}
            # a long word is its own rarity
            if len(word) <= 64:
                v.known[word] = found
        ids[word] = found
    return [b"".join(map(ids.__getitem__, words)) for words in cut]


def decode_lists(v: Vocabulary, lists: pa.ListArray) -> list[str]:
    """The text of each list of ids: the bytes of all pieces are gathered at once."""
    ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    none = len(v.lengths) - 1
    ids = np.where((ids >= 0) & (ids < none), ids, none)
    sizes = v.lengths[ids]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    # byte k of the output is byte k - (begin of its piece there) of the piece
    data = v.blob[np.arange(ends[-1]) + np.repeat(v.starts[ids] - ends[:-1], sizes)].tobytes()
    cuts = ends[np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])].tolist()
    texts = (data[a:b].decode(errors="replace") for a, b in zip(cuts, cuts[1:]))
    return [t[1:] if t.startswith(" ") else t for t in texts]


def decode_ids(v: Vocabulary, ids: Sequence[int | None]) -> str:
    return decode_lists(v, pa.array([ids], pa.list_(pa.int32())))[0]


@lru_cache(maxsize=2)
def _loaded(model: bytes) -> Vocabulary:
    return Vocabulary.from_model(model)


def read_model(path: str) -> bytes:
    """The model file's bytes, read on the driver and sent with the tasks (a vocabulary file: hundreds of KB)."""
    return sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto()


def _slices(sizes: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of sizes that sum to at most ``most``, one at least in each."""
    begin = total = 0
    for i, n in enumerate(pc.fill_null(sizes, 0).to_pylist()):
        if total and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def _mapped(df: DataFrame, column: str, outputs: dict[str, DataType], make) -> DataFrame:
    """Add ``outputs`` computed by ``make(array)`` from slices of ``column``: (begin, array of each output); other columns pass through."""
    taken = {name.lower() for name in outputs}
    kept = [f for f in df.schema.fields if f.name.lower() not in taken]
    schema = StructType([*kept, *(StructField(name, kind) for name, kind in outputs.items())])
    # inside, columns go by position: their own names may hold dots or clash with any other
    places = [f"c{i}" for i in range(len(schema))]
    inner = StructType([StructField(p, f.dataType) for p, f in zip(places, schema.fields)])
    source = df.select(*[df[f"`{f.name}`"].alias(p) for p, f in zip(places, kept)], df[f"`{column}`"].alias(places[len(kept)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, *values in make(batch.column(len(kept))):
                own = batch.slice(begin, len(values[0]))
                yield pa.RecordBatch.from_arrays([*own.columns[:len(kept)], *values], names=places)

    out = small_batches(source).mapInArrow(run, inner)
    return out.select(*[out[p].alias(f.name) for p, f in zip(places, schema.fields)])


def _encoded(v: Vocabulary, texts: pa.Array) -> Iterator[tuple[int, pa.ListArray]]:
    for a, b in _slices(pc.utf8_length(texts), SLICE):
        found = encode_texts(v, texts[a:b].to_pylist())
        offsets = np.cumsum([0, *map(len, found)]) // 4
        yield a, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(found), dtype=np.int32)))


def _decoded(v: Vocabulary, lists: pa.ListArray) -> Iterator[tuple[int, list[str]]]:
    for a, b in _slices(pc.list_value_length(lists), IDS):
        yield a, decode_lists(v, lists[a:b])


def encode(df: DataFrame, model: bytes, text: str = "text", output: str = "token_ids") -> DataFrame:
    """Add the array of ids of ``text``."""
    return _mapped(df, text, {output: ArrayType(IntegerType())}, lambda texts: _encoded(_loaded(model), texts))


def decode(df: DataFrame, model: bytes, ids: str = "token_ids", output: str = "decoded") -> DataFrame:
    """Add the text of the array ``ids``."""
    return _mapped(df, ids, {output: StringType()}, lambda lists: ((a, pa.array(found, pa.string())) for a, found in _decoded(_loaded(model), lists)))


def round_trip(df: DataFrame, model: bytes, text: str = "text", output: str = "token_ids", same: str = "round_trip") -> DataFrame:
    """Add the array of ids of ``text``, and whether they decode to the text again (null: as empty), in one pass: the decoded texts are not handed on."""
    def make(texts: pa.Array):
        v = _loaded(model)
        for begin, lists in _encoded(v, texts):
            given = pc.fill_null(texts[begin:begin + len(lists)], "")
            equal = [pc.equal(pa.array(found, pa.string()), given[a:a + len(found)]) for a, found in _decoded(v, lists)]
            yield begin, lists, pa.chunked_array(equal, pa.bool_()).combine_chunks()
    return _mapped(df, text, {output: ArrayType(IntegerType()), same: BooleanType()}, make)
