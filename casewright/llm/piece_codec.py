"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Compiled from a model: its normaliser (rules of the longest stretch first, white space, dummy prefix, space to its
mark), an automaton over letters that emits pieces, and byte fallback for letters that are no piece. A state of the
composition with an input is a place in it and the piece that ended there; the path of least weight in the tropical
semiring is kept place by place. An arc of a unigram model weighs the piece's minus log probability. An arc of a BPE
model weighs one, or infinity where merging would never leave the two pieces side by side: a sequence of pieces is
merging's own result exactly if each neighbouring pair is, so that result alone has finite weight.

Which pairs may stand together is worked out by undoing the pieces' last merges at the seam. Words of a batch are
composed in step, place by place, as arrays; a word of more than ``LONG`` letters in windows that are joined where
merging leaves a seam (BPE), or place by place (unigram). Decoding reads pieces' bytes back.

Defined results: a null text counts as empty and has no pieces; ids are passed through, nulls and
repeated rows included; an empty table gives no rows; other columns stay out of the result. What is read back is
the normalised text; the mark itself in a text is read back as a space, as the library does.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.bpe import LONG, MARK, PieceModel, WordCache, piece_model
from casewright.llm.common import bounded_batches, portions, ragged_take, starts_of, sum_by_row


class Transducer:
    """The automaton of pieces, their splits, and decoding tables."""

    def __init__(self, model: PieceModel):
        self.model = model
        self._automaton(np.ones(model.width, bool) if model.unigram else model.made)
        # weights of arcs: a unigram model's minus log probabilities; each piece of a BPE model weighs one
        self.weight = -model.score if model.unigram else np.ones(model.width, np.float32)
        text = [MARK if i >= model.n else p for i, p in enumerate(model.pieces)]
        raw = [p.replace(MARK, " ").encode() for p in text]
        for value, i in model.bytes_of.items():
            raw[i] = bytes([value])
        self.raw, self.raw_sizes = np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw])
        self.raw_starts = starts_of(self.raw_sizes)
        self.bytes_of = np.array([model.bytes_of[b] for b in range(256)])

    def _automaton(self, out: np.ndarray) -> None:
        """States of the piece automaton; ``step`` is a look-up of (state, letter), ``emits`` a piece or -1."""
        model, states, emits = self.model, {(): 0}, [-1]
        steps: dict[int, int] = {}
        for p, i in model.id_of.items():
            if not out[i]:
                continue
            at = ()
            for c in p:
                to = (*at, c)
                if to not in states:
                    states[to] = len(states)
                    emits.append(-1)
                    steps[states[at] * model.width + model.id_of[c]] = states[to]
                at = to
            emits[states[at]] = i
        self.emits = np.array(emits)
        self.step = object.__new__(PieceModel)
        self.step.width = model.width
        self.step._table(steps)
        self.longest = max(map(len, states))

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The pieces of each pre-token, as bytes of 32-bit numbers: small ones to keep, and quick to join."""
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        out: list = [None] * len(words)
        paths, fallback = self._paths([words[i] for i in short])
        for i, path in zip(short, paths, strict=True):
            out[i] = path
        for k, path in zip(fallback, self._spelled([words[short[k]] for k in fallback], [out[short[k]] for k in fallback]), strict=True):
            out[short[k]] = path
        for i, w in enumerate(words) if len(short) < len(words) else ():
            if out[i] is None:
                out[i] = self._spelled([w], [self._long(w).astype(np.int32).tobytes()])[0]
        return out

    def _long(self, word: str) -> np.ndarray:
        if self.model.unigram:
            return self._one_by_one(word)
        return self.model.in_windows(word, lambda parts: [np.frombuffer(p, np.int32).astype(np.int64) for p in self._paths([word[s] for s in parts])[0]])

    def _spelled(self, words: list[str], paths: list[bytes]) -> list[bytes]:
        """Letters that are no piece as their bytes."""
        pieces, lengths = np.frombuffer(b"".join(paths), np.int32), np.fromiter(map(len, paths), np.int64, len(paths)) // 4
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        lone = pieces >= self.model.n
        letters = codes[np.cumsum(self.model.piece_len[pieces])[lone] - 1]  # words follow one another, and so do their pieces
        size = np.ones(len(pieces), np.int64)
        size[lone] += (letters > 0x7F).astype(np.int64) + (letters > 0x7FF) + (letters > 0xFFFF)
        out, spelled = np.empty(int(size.sum()), np.int32), np.repeat(lone, size)
        out[~spelled] = pieces[~lone]
        out[spelled] = self.bytes_of[np.frombuffer(letters.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)]
        at, data = (4 * starts_of(sum_by_row(size, lengths))).tolist(), out.tobytes()
        return [data[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _paths(self, words: list[str]) -> tuple[list[bytes], list[int]]:
        """The shortest path of each word, as bytes, and the words on whose path a letter is no piece."""
        flat, _, lengths = self.model.symbols(words)
        starts, out, fallback = starts_of(lengths), [None] * len(words), []
        order = np.argsort(lengths, kind="stable")
        bounds = [0]
        while bounds[-1] < len(order):  # words of similar length together
            low = bounds[-1]
            most = max(8, int(lengths[order[low]] * 1.5))
            high = int(np.searchsorted(lengths[order], most, side="right"))
            bounds.append(min(high, low + max(1, 600_000 // most)))
        for low, high in zip(bounds, bounds[1:], strict=False):
            self._together(order[low:high], flat, starts, words, out, fallback)
        return out, fallback

    def _one_by_one(self, word: str) -> np.ndarray:
        """The shortest path through one long pre-token of a unigram model, place by place."""
        letters, _, _ = self.model.symbols([word])
        n, ids, weight = len(letters), self.model.id_of, self.weight.tolist()
        word = word.replace(" ", MARK)
        cost, piece, size = [0.0] + [np.inf] * n, [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            for k in range(1, min(self.longest, n - i) + 1):
                arc = ids.get(word[i : i + k], -1)
                if arc < 0 or arc >= self.model.n:
                    arc = int(letters[i]) if k == 1 else -1
                if arc >= 0 and cost[i] + weight[arc] < cost[i + k]:
                    cost[i + k], piece[i + k], size[i + k] = cost[i] + weight[arc], arc, k
        out = []
        while n:
            out.append(piece[n])
            n -= size[n]
        return np.array(out[::-1])

    def _together(self, rows: np.ndarray, flat: np.ndarray, starts: np.ndarray, words: list[str], out: list, fallback: list[int]) -> None:
        n = (starts[1:] - starts[:-1])[rows]
        wide = int(n.max())
        grid = np.full((len(rows), wide), -1, np.int64)
        inside = np.arange(wide) < n[:, None]
        grid[inside] = ragged_take(flat, starts, rows)[0]
        reach = min(self.longest, wide)
        # compose: the piece that the automaton emits from each place over each number of letters
        arcs = np.full((reach, len(rows), wide), -1, np.int32)
        row, col = np.nonzero(inside)
        state = np.zeros(len(row), np.int64)
        for k in range(reach):
            letter = grid[row, np.minimum(col + k, wide - 1)]
            ok = (col + k < wide) & (letter >= 0)
            row, col, state, letter = row[ok], col[ok], state[ok], letter[ok]
            state = self.step.pair(state, letter)
            if k == 0:
                lone = state < 0  # a letter in no piece: the arc of byte fallback
                arcs[0, row[lone], col[lone]] = letter[lone]
            ok = state >= 0
            row, col, state = row[ok], col[ok], state[ok]
            arcs[k, row, col] = self.emits[state]
        # relax: each place keeps the arc of least weight in all (a place of a BPE model has one of finite weight)
        last = np.full((len(rows), wide + 1), -1, np.int64)
        size = np.zeros((len(rows), wide + 1), np.int64)
        cost = np.full((len(rows), wide + 1), np.inf)
        cost[:, 0] = 0
        for j in range(1, wide + 1):
            todo = np.flatnonzero(n >= j)
            for k in range(min(reach, j), 0, -1):
                piece = arcs[k - 1, todo, j - k].astype(np.int64)
                can = np.flatnonzero(piece >= 0)
                if not len(can):
                    continue
                at, piece = todo[can], piece[can]
                total = cost[at, j - k] + self.weight[piece]
                less = total < cost[at, j]
                if j > k and not self.model.unigram:  # pieces that merging does not leave side by side: infinite
                    less[less] = self.model.apart(last[at[less], j - k], piece[less])
                at = at[less]
                last[at, j], size[at, j], cost[at, j] = piece[less], k, total[less]
                if not self.model.unigram and len(at):  # no other arc of theirs is finite
                    todo = np.delete(todo, can[less])
                    if not len(todo):
                        break
        # back along the path
        at, place = np.arange(len(rows)), n.copy()
        steps = []
        while len(at):
            piece, k = last[at, place], size[at, place]
            if (k == 0).any():
                raise ValueError(f"no path through {words[rows[at[k == 0][0]]]!r}")
            place = place - k
            steps.append((at, piece, place))
            more = place > 0
            at, place = at[more], place[more]
        who = np.concatenate([s[0] for s in steps])
        what = np.concatenate([s[1] for s in steps])
        where = np.concatenate([s[2] for s in steps])
        turn = np.lexsort((where, who))
        who, what = who[turn], what[turn].astype(np.int32)
        fallback += rows[np.unique(who[what >= self.model.n])].tolist()
        cut, data = (4 * np.searchsorted(who, np.arange(len(rows) + 1))).tolist(), what.tobytes()
        for r, a, b in zip(rows.tolist(), cut, cut[1:], strict=False):
            out[r] = data[a:b]

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """The texts' bytes: the pieces' own, without the dummy prefix."""
        whole, first = ragged_take(self.raw, self.raw_starts, ids)[0].tobytes(), self.model.prefix.encode()
        at = starts_of(sum_by_row(self.raw_sizes[ids], lengths))
        return [whole[a + (first != b"" and whole[a : a + 1] == first) : b] for a, b in zip(at.tolist(), at.tolist()[1:], strict=False)]


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One for each Python worker."""
    return Transducer(piece_model(path))


_caches: dict[str, WordCache] = {}


def coded_pre_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The pre-tokens of normalised texts as numbers of distinct ones, how many each text has, and the distinct ones.

    They are those of ``pre_tokens``: cut before each word's first space.
    """
    flat = np.frombuffer(b"".join(texts), np.uint8)
    at = starts_of(np.fromiter(map(len, texts), np.int64, len(texts)))
    space = flat == 32
    begin = space.copy()
    begin[1:] &= ~space[:-1]
    begin[at[:-1][at[:-1] < at[1:]]] = True
    begin = np.flatnonzero(begin)
    words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(flat))), pa.py_buffer(flat)]).dictionary_encode()
    return words.indices.to_numpy(), np.diff(np.searchsorted(begin, at)), [w.decode("utf-8", "surrogatepass") for w in words.dictionary.to_pylist()]


def encode_texts(texts: list[str], model_path: str) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts, one after another, and how many each has."""
    machine, cache = transducer(model_path), _caches.setdefault(model_path, WordCache(300_000))
    ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for part in portions(texts, 3 << 20):
        codes, lengths, words = coded_pre_tokens([machine.model.normalised(t).encode("utf-8", "surrogatepass") for t in texts[part]])
        pieces = cache.look_up(words, machine.encode_words)
        table = np.frombuffer(b"".join(pieces), np.int32)
        flat, n = ragged_take(table, starts_of(np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4), codes)
        ids.append(flat)
        counts.append(sum_by_row(n, lengths))
    return np.concatenate(ids), np.concatenate(counts)


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, pieces array<int>, n_pieces, round_trip``; the last says that decoding gives the text again."""
    bounded_batches(df.sparkSession)

    @F.pandas_udf("pieces array<int>, n_pieces long, round_trip boolean")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            texts = [t or "" for t in column]
            for part in portions(texts, 3 << 20):
                some = texts[part]
                flat, n = encode_texts(some, model_path)
                back = transducer(model_path).decode(flat, n)
                model = piece_model(model_path)
                plain = [model.normalised(t)[len(model.prefix) :] for t in some]
                same = [b == t.encode("utf-8", "surrogatepass") for b, t in zip(back, plain, strict=True)]
                at = starts_of(n)
                yield pd.DataFrame({"pieces": [flat[a:b] for a, b in zip(at, at[1:], strict=False)], "n_pieces": n, "round_trip": same})

    return df.select(df[id_col].alias("doc_id"), coded(df[text_col].cast("string")).alias("c")).select("doc_id", "c.*")


def decode(df: DataFrame, model_path: str, id_col: str = "doc_id", pieces_col: str = "pieces") -> DataFrame:
    """``doc_id, text`` from piece ids; null pieces give an empty text, broken UTF-8 the replacement character."""

    @F.pandas_udf("string")
    def read(pieces: pd.Series) -> pd.Series:
        lists = [np.zeros(0, np.int32) if p is None else np.asarray(p, np.int32) for p in pieces]
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        texts = transducer(model_path).decode(np.concatenate(lists) if lists else np.zeros(0, np.int32), n)
        return pd.Series([t.decode("utf-8", "replace") for t in texts])

    return df.select(df[id_col].alias("doc_id"), read(df[pieces_col]).alias("text"))
