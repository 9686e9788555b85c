"""A SentencePiece model compiled to arrays: its normaliser, its pieces, and rank-synchronous merging over ragged
arrays of symbols.

Merging is the token counter's method; the transducer uses the normaliser, the pieces and, for a BPE model, which
pieces merging leaves side by side. A very long pre-token is worked on in windows that overlap: two windows are
joined where both have a boundary and merging leaves the pieces on either side of it apart, so that the whole row is
merging's own result (a row of pieces is exactly if all its neighbours are).
"""

from __future__ import annotations

import functools
import re

import numpy as np

from casewright.llm.common import ragged_take, starts_of, sum_by_row

#: What the model writes for a space.
MARK = "▁"
#: No such pair.
NEVER = np.int64(2**40)
#: Bits of the number of pairs of pieces remembered.
SEAM_BITS = 21
#: Letters from which on a pre-token is worked on in windows, and a window's.
LONG, WINDOW = 2048, 512
_SPACES = re.compile(" +")


class PieceModel:
    """Pieces, their ranks or scores, and the pairs of symbols that concatenate to a piece.

    ``unigram`` models have scores instead of ranks and cannot be merged. Symbols are piece ids; characters that occur in pieces without being one get ids from ``n`` on, and
    all other characters share the id ``unknown``. ``rank`` orders merges: the highest score first.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = _settings(sp.serialized_model_proto())
        if spec["kind"] not in (1, 2) or not spec["escape"]:
            raise ValueError("only unigram and BPE models that write spaces as marks are compiled")
        self.unigram, self.prefix, self.squeeze = spec["kind"] == 1, " " if spec["prefix"] else "", spec["remove_extra"]
        self.charsmap = _charsmap(spec["charsmap"])
        self.longest_rule = max(map(len, self.charsmap), default=0)
        self.n = n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bytes_of = {int(p[3:-1], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        if len(self.bytes_of) != 256:
            raise ValueError("the model has no byte fallback")
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if any(MARK in self.pieces[i].lstrip(MARK) for i in plain):
            raise ValueError("a piece goes over the end of a word")
        self.id_of = {self.pieces[i]: i for i in plain}
        for k, c in enumerate(sorted({c for p in self.id_of for c in p} - self.id_of.keys())):
            self.id_of[c] = n + k
        self.unknown = max(n, *self.id_of.values()) + 1
        self.width = self.unknown + 1
        self.letters = {c: i for c, i in self.id_of.items() if len(c) == 1}
        self.letters[" "] = self.letters[MARK]
        self.piece_len = np.ones(self.width, np.int64)
        self.piece_len[plain] = [len(self.pieces[i]) for i in plain]
        scores = np.array([sp.get_score(i) for i in plain], np.float32)
        self.score = np.full(self.width, scores.min() - 10, np.float32)  # the library's penalty for a letter that is no piece
        self.score[plain] = scores
        self.rank = np.full(self.width, NEVER)
        if self.unigram:
            return
        order = sorted((i for i in plain if len(self.pieces[i]) > 1), key=lambda i: (-sp.get_score(i), i))
        self.rank[order] = np.arange(len(order))
        pairs = {}
        for i in order:
            p = self.pieces[i]
            for cut in range(1, len(p)):
                left, right = self.id_of.get(p[:cut]), self.id_of.get(p[cut:])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = i
        self._table(pairs)
        self._undone()

    def normalised(self, text: str) -> str:
        """The text as the model's normaliser leaves it: rules for the longest stretch first, white space, dummy prefix."""
        if self.charsmap:
            out, i, rules = [], 0, self.charsmap
            while i < len(text):
                for size in range(min(self.longest_rule, len(text) - i), 0, -1):
                    to = rules.get(text[i : i + size])
                    if to is not None:
                        out.append(to)
                        i += size
                        break
                else:
                    out.append(text[i])
                    i += 1
            text = "".join(out)
        if self.squeeze:
            text = _SPACES.sub(" ", text).strip(" ")
        if MARK in text:
            text = text.replace(MARK, " ")  # the library takes it for a space too
        return self.prefix + text if text else ""

    def _undone(self) -> None:
        """The two halves that each piece was last merged from, and whether any text is merged to it."""
        width, ids = self.width, self.id_of
        self.order = np.where(self.rank < NEVER, self.rank + width, np.arange(width))
        self.left, self.right, self.made = np.arange(width), np.arange(width), np.zeros(width, bool)
        self.made[list(self.letters.values())] = True
        self.made[self.unknown] = True
        order, by_rank = self.rank.tolist(), np.argsort(self.rank, kind="stable")
        for i in by_rank[: int((self.rank < NEVER).sum())].tolist():
            parts = list(self.pieces[i])
            while len(parts) > 2:
                ranks = [order[ids[a + b]] if a + b in ids else NEVER for a, b in zip(parts, parts[1:], strict=False)]
                k = min(range(len(ranks)), key=ranks.__getitem__)
                if ranks[k] == NEVER:
                    break
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            if len(parts) == 2:  # else no text is ever merged to this piece
                self.left[i], self.right[i] = ids[parts[0]], ids[parts[1]]
                self.made[i] = True
        self.seams, self.seam_good = np.full(1 << SEAM_BITS, -1, np.int64), np.zeros(1 << SEAM_BITS, bool)

    def apart(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether merging ever leaves the two pieces side by side; answers are kept in a direct-mapped table."""
        key = first * self.width + second
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SEAM_BITS)).astype(np.int64)
        good = self.seam_good[slot]
        new = np.flatnonzero(self.seams[slot] != key)
        if len(new):
            distinct, inverse = np.unique(key[new], return_inverse=True)
            answer = self._apart(distinct // self.width, distinct % self.width)
            good[new] = answer = answer[inverse]
            slot, place = np.unique(slot[new], return_index=True)
            self.seams[slot], self.seam_good[slot] = key[new][place], answer[place]
        return good

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        good, open_ = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), 2 * NEVER)
        while len(open_):
            made = self.pair(a, b)
            bad = (made >= 0) & (self.order[made] < limit)
            good[open_[bad]] = False
            a_last = self.order[a] > self.order[b]
            a_in, b_in = self.right[a], self.left[b]
            a_whole, b_whole = a_in == a, b_in == b
            undo_a = (a_last & ~a_whole) | (~a_last & b_whole & ~a_whole)
            undo_b = ~undo_a & ~b_whole
            limit = np.where(undo_a, self.order[a], self.order[b] + 1)
            a, b = np.where(undo_a, a_in, a), np.where(undo_b, b_in, b)
            stay = ~bad & (undo_a | undo_b)
            a, b, limit, open_ = a[stay], b[stay], limit[stay], open_[stay]
        return good

    def joined(self, windows: list[tuple[int, np.ndarray]]) -> np.ndarray | None:
        """The symbols of a long pre-token from those of its windows (start, symbols); None where two cannot be joined."""
        out, until = [], 0
        held, ends = windows[0][1], np.cumsum(self.piece_len[windows[0][1]])
        for start, symbols in windows[1:]:
            begin = start + np.cumsum(self.piece_len[symbols]) - self.piece_len[symbols]
            _, a, b = np.intersect1d(ends, begin, assume_unique=True, return_indices=True)
            ok = (ends[a] > until) & (ends[a] > start)
            a, b = a[ok], b[ok]
            fits = np.flatnonzero(self.apart(held[a], symbols[b])) if len(a) else a
            if not len(fits):
                return None
            k = fits[len(fits) // 2]
            low = np.searchsorted(ends, until, side="right")
            out.append(held[low : a[k] + 1])
            until, held, ends = int(ends[a[k]]), symbols, begin + self.piece_len[symbols]
        out.append(held[np.searchsorted(ends, until, side="right") :])
        return np.concatenate(out)

    def _table(self, pairs: dict[int, int]) -> None:
        """An open-addressed table: a look-up is a few gathers for a whole array of pairs."""
        bits = max(4, int(np.ceil(np.log2(4 * max(1, len(pairs))))))
        keys, values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        todo = np.fromiter(pairs.keys(), np.int64, len(pairs))
        merged = np.fromiter(pairs.values(), np.int64, len(pairs))
        self.shift = 64 - bits
        at, self.probes = self._slot(todo), 0
        while len(todo):
            self.probes += 1
            free = keys[at] == -1
            slots, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            keys[slots], values[slots] = todo[won], merged[won]
            rest = np.ones(len(todo), bool)
            rest[won] = False
            todo, merged, at = todo[rest], merged[rest], (at[rest] + 1) & ((1 << bits) - 1)
        self.keys, self.values = keys, values

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1."""
        key = left * self.width + right
        out = np.full(len(key), -1, np.int64)
        at, open_ = self._slot(key), np.arange(len(key))
        for _ in range(self.probes):
            found = self.keys[at]
            hit = found == key[open_]
            out[open_[hit]] = self.values[at[hit]]
            more = ~hit & (found != -1)
            if not more.any():
                break
            open_, at = open_[more], (at[more] + 1) & (len(self.keys) - 1)
        return out

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The letters of all words as ids, their UTF-8 lengths, and the words' lengths."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        distinct, inverse = np.unique(codes, return_inverse=True)
        ids = np.array([self.letters.get(chr(c), self.unknown) for c in distinct.tolist()], np.int64)
        size = 1 + (distinct > 0x7F) + (distinct > 0x7FF) + (distinct > 0xFFFF)
        return ids[inverse], size[inverse], np.fromiter(map(len, words), np.int64, len(words))

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each word: surviving pieces, and for a surviving letter that is no piece its bytes."""
        flat, size, lengths = self.symbols(words)
        lost = sum_by_row(np.where(flat == self.unknown, size - 1, 0), lengths)
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        if not long:
            rest, n = self.merge(flat, lengths)
            return n + lost + sum_by_row(self._extra()[rest], n)
        at, out = starts_of(lengths), np.zeros(len(words), np.int64)
        short = np.flatnonzero(lengths <= LONG)
        rest, n = self.merge(ragged_take(flat, at, short)[0], lengths[short])
        out[short] = n + sum_by_row(self._extra()[rest], n)
        for i in long:
            whole = flat[at[i] : at[i + 1]]
            rest = self.in_windows(words[i], lambda parts, own=whole: self._merged(own, parts))
            out[i] = len(rest) + self._extra()[rest].sum()
        return out + lost

    def _extra(self) -> np.ndarray:
        """Tokens beyond the first of a letter that is no piece but occurs in pieces."""
        out = np.zeros(self.width, np.int64)
        for c, i in self.letters.items():
            out[i] = len(c.encode()) - 1 if i >= self.n else 0
        return out

    def _merged(self, flat: np.ndarray, parts: list[slice]) -> list[np.ndarray]:
        lengths = np.array([p.stop - p.start for p in parts])
        rest, n = self.merge(np.concatenate([flat[p] for p in parts]), lengths)
        return np.split(rest, np.cumsum(n)[:-1])

    def in_windows(self, word: str, work) -> np.ndarray:
        """The symbols of a long word: ``work`` gives those of slices of it; larger windows where two cannot be joined."""
        size = WINDOW
        while True:
            starts = range(0, max(1, len(word) - size // 4), size - size // 4)
            parts = [slice(s, min(len(word), s + size)) for s in starts]
            out = self.joined(list(zip(starts, work(parts), strict=True)))
            if out is not None:
                return out
            size *= 8

    def merge(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge each row of symbols to the end: the surviving symbols and the rows' new lengths.

        In each step every row takes its pair of lowest rank, at all its places at once. That equals merging
        one place at a time, the leftmost first, unless a merge makes a pair of lower rank than its own; rows
        where that happens start again with one place a step.
        """
        out_rows, out_flat, again = [], [], []
        for single in (False, True):
            rows = np.arange(len(lengths)) if not single else np.array(sorted(again), np.int64)
            if not len(rows):
                continue
            cur, n = (flat, lengths) if not single else ragged_take(flat, starts_of(lengths), rows)
            done_flat, done_rows = self._run(cur, n, rows, single, again)
            out_flat += done_flat
            out_rows += done_rows
        rows = np.concatenate([r for r, _ in out_rows]) if out_rows else np.zeros(0, np.int64)
        n = np.concatenate([k for _, k in out_rows]) if out_rows else np.zeros(0, np.int64)
        values = np.concatenate(out_flat) if out_flat else np.zeros(0, np.int64)
        order = np.argsort(rows, kind="stable")
        return ragged_take(values, starts_of(n), order)

    def _run(self, cur: np.ndarray, n: np.ndarray, rows: np.ndarray, single: bool, again: list[int]):
        done_flat, done_rows = [], []
        while len(rows):
            row_of = np.repeat(np.arange(len(rows)), n)
            inner = np.zeros(len(cur), bool)  # has a right neighbour in its row
            inner[:-1] = row_of[1:] == row_of[:-1]
            merged = np.full(len(cur), -1, np.int64)
            left = np.flatnonzero(inner)
            merged[left] = self.pair(cur[left], cur[left + 1])
            rank = np.where(merged >= 0, self.rank[merged], NEVER)
            at = starts_of(n)
            best = np.full(len(rows), NEVER)
            full = n > 0
            if full.any():
                best[full] = np.minimum.reduceat(rank, at[:-1][full])
            open_ = best < NEVER
            if not open_.all():  # finished rows leave
                keep = open_[row_of]
                done_flat.append(cur[~keep])
                done_rows.append((rows[~open_], n[~open_]))
                cur, merged, rank, row_of = cur[keep], merged[keep], rank[keep], (np.cumsum(open_) - 1)[row_of[keep]]
                rows, n, best = rows[open_], n[open_], best[open_]
                if not len(rows):
                    break
            chosen = np.flatnonzero(rank == best[row_of])
            if single:
                first = np.ones(len(chosen), bool)
                first[1:] = row_of[chosen[1:]] != row_of[chosen[:-1]]
                chosen = chosen[first]
            else:  # of places that overlap, every other one from the left
                run_start = np.ones(len(chosen), bool)
                run_start[1:] = (chosen[1:] != chosen[:-1] + 1) | (row_of[chosen[1:]] != row_of[chosen[:-1]])
                place = np.arange(len(chosen)) - np.maximum.accumulate(np.where(run_start, np.arange(len(chosen)), 0))
                chosen = chosen[place % 2 == 0]
            cur = cur.copy()
            cur[chosen] = merged[chosen]
            gone = np.zeros(len(cur), bool)
            gone[chosen + 1] = True
            new_at = np.cumsum(~gone) - 1
            cur, row_of = cur[~gone], row_of[~gone]
            n = np.bincount(row_of, minlength=len(rows))
            if not single:
                spot = new_at[chosen]
                bad = np.zeros(len(rows), bool)
                for a, b in ((spot - 1, spot), (spot, spot + 1)):
                    ok = (a >= 0) & (b < len(cur))
                    a, b = a[ok], b[ok]
                    same = row_of[a] == row_of[b]
                    a, b = a[same], b[same]
                    made = self.pair(cur[a], cur[b])
                    lower = (made >= 0) & (self.rank[made] < best[row_of[a]])
                    bad[row_of[a[lower]]] = True
                if bad.any():
                    again.extend(rows[bad].tolist())
                    keep = ~bad[row_of]
                    cur, row_of = cur[keep], (np.cumsum(~bad) - 1)[row_of[keep]]
                    rows, n = rows[~bad], n[~bad]
        return done_flat, done_rows


def _settings(proto: bytes) -> dict:
    """The model's kind and its normaliser's settings, read from the model file's protocol buffer (its fields 2 and 3)."""

    def fields(b: bytes):
        i = 0
        while i < len(b):
            key, i = varint(b, i)
            kind = key & 7
            if kind == 2:
                size, i = varint(b, i)
                yield key >> 3, b[i : i + size]
                i += size
            elif kind == 0:
                value, i = varint(b, i)
                yield key >> 3, value
            else:
                size = 4 if kind == 5 else 8
                yield key >> 3, b[i : i + size]
                i += size

    def varint(b: bytes, i: int):
        value = shift = 0
        while True:
            c = b[i]
            i += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value, i

    spec, kind = {1: b"", 2: b"", 3: 1, 4: 1, 5: 1}, 1
    for number, value in fields(proto):
        if number == 3:
            spec |= dict(fields(value))
        elif number == 2:
            kind = dict(fields(value)).get(3, 1)
    return {"kind": kind, "charsmap": spec[2], "prefix": bool(spec[3]), "remove_extra": bool(spec[4]), "escape": bool(spec[5])}


def _charsmap(blob: bytes) -> dict[str, str]:
    """The normaliser's rules: a double-array trie of UTF-8 keys whose values are places in a table of texts ended by zero."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, texts = np.frombuffer(blob[4 : 4 + size], np.uint32).tolist(), blob[4 + size :]
    base = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
    out, open_ = {}, [(base(units[0]), b"")]
    while open_:
        at, key = open_.pop()
        for c in range(1, 256):
            unit = units[at ^ c] if at ^ c < len(units) else 0
            if unit & 0x800000FF != c:
                continue
            to, longer = (at ^ c) ^ base(unit), key + bytes([c])
            if unit >> 8 & 1:
                place = units[to] & 0x7FFFFFFF
                out[longer.decode()] = texts[place : texts.index(b"\0", place)].decode()
            open_.append((to, longer))
    return out


@functools.lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    """One for each Python worker."""
    return PieceModel(path)


_RUNS = re.compile(" +[^ ]*|[^ ]+")


def pre_tokens(text: str) -> list[str]:
    """Stretches of a normalised text that no piece goes over: cut before each word's first space.

    The leading space of a stretch stays on it; an empty text has none.
    """
    if "  " not in text and text[:1] == " " and text[-1] != " ":
        return [" " + w for w in text[1:].split(" ")]
    return _RUNS.findall(text)


class WordCache:
    """What was worked out for a word, for as long as a Python worker lives; emptied when full, long words are not kept."""

    def __init__(self, most: int = 400_000, longest: int = 48):
        self.known: dict = {}
        self.most, self.longest = most, longest

    def look_up(self, words: list[str], work_out) -> list:
        known = self.known
        missing = [w for w in words if w not in known]
        fresh = dict(zip(missing, work_out(missing), strict=True)) if missing else {}
        out = [known[w] if w in known else fresh[w] for w in words]
        if len(known) + len(fresh) > self.most:
            known.clear()
        known.update((w, v) for w, v in fresh.items() if len(w) <= self.longest)
        return out
