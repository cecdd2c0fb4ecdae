"""Token counts by a compiled tokenizer: a deterministic transducer whose transitions carry token counts.

The vocabulary (byte-pair merges by score, white space marked by U+2581, unknown characters as bytes) is compiled
into a transducer over characters. A state is what the next characters can still depend on: the longest suffix of
the word that begins some piece and, for each of its places where a piece could begin, the last token before that
place and how many tokens more or fewer the text has up to there. A transition's count is the change in the number
of tokens, so that the sum over a text is its number of tokens at every place. Two tokens may follow each other only
if merging their joined text gives these two again; of the pieces that end at a place, just one may follow what
stands before it. States and transitions are made when first met and kept.

A text is cut into chunks, and a chunk has a map from entry state to (exit state, count). White space after another
character always leads to one state, so behind the first such place the map is constant. For chunks without one, the
map is made for the states in which the chunk before may leave it: the one that a run over that chunk's last characters
predicts, and from there on every exit that any entry of the chunk before has, all chunks at once, until no new
entry is found. The maps then compose by a prefix scan (pointer doubling) over a text's chunks. All chunks of a step
advance together, a character at a time; texts of more than BLOCK characters pass in blocks, from each of which only
the exit state is kept, so that states and transitions of any text are bounded.

Edge cases: null and empty texts have no tokens; any Unicode text is counted, NUL and control tokens' strings as
ordinary characters; equal texts have equal counts, repeated rows and null ids stay rows; equal scores of neighbours
tie for the left one; texts have no limit of length; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebody.llm.common import ship, steps

#: Characters of a chunk, of a block, and those that predict an entry; transitions that a worker keeps before it begins anew.
CHUNK, BLOCK, AHEAD, KEPT = 256, 1 << 18, 32, 700_000
MARK = "▁"
#: Classes of characters: unknown ones by the bytes that stand for them, then the vocabulary's own.
CLASSES = 13
SEGMENT = None  # what stands before the first token of a segment


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbered fields of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + size]
            at += size


def read_model(path: str) -> dict[str, float]:
    """The pieces and scores of a model file; ValueError if it isn't of the kind that is compiled here."""
    with open(path, "rb") as f:
        data = f.read()
    pieces: dict[str, float] = {}
    kind, normal = 1, {}
    for field, value in _fields(data):
        if field == 1:
            x = dict(_fields(value))
            if x.get(3, 1) == 1:
                pieces[x[1].decode()] = struct.unpack("<f", x[2])[0] if 2 in x else 0.0
            elif x.get(3, 1) in (4, 5):
                raise ValueError("user-defined and unused pieces are not supported")
        elif field == 2:
            kind = dict(_fields(value)).get(3, 1)
        elif field == 3:
            normal = dict(_fields(value))
    if kind != 2 or normal.get(2) or not normal.get(3, 1) or normal.get(4, 1) or not normal.get(5, 1):
        raise ValueError("only byte-pair models with a leading space and otherwise unchanged text are supported")
    if any(MARK in x.lstrip(MARK) or (x.strip(MARK) and x.startswith(2 * MARK)) for x in pieces):
        raise ValueError("pieces across words are not supported")
    return pieces


class Transducer:
    def __init__(self, path: str):
        self.score = read_model(path)
        self.begins = {x[:i] for x in self.score for i in range(1, len(x))}
        chars = sorted({ord(c) for x in self.score for c in x})
        self.classes = np.full(0x110000, 4, np.int32)
        self.classes[:0x80], self.classes[0x80:0x800], self.classes[0x800:0x10000] = 1, 2, 3
        self.classes[chars] = 5 + np.arange(len(chars))
        self.classes[32] = self.classes[ord(MARK)]
        self.space = int(self.classes[32])
        self.char = {5 + i: chr(c) for i, c in enumerate(chars)}
        if 5 + len(chars) > 1 << CLASSES:
            raise ValueError(f"more than {(1 << CLASSES) - 5} characters in the vocabulary")
        #: When a piece is merged, among all; single characters are there from the start.
        self.time = {x: i + 1 for i, x in enumerate(sorted(self.score, key=lambda x: -self.score[x]))}
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.follows: dict[tuple[str | None, str], bool] = {}
        self.runs = self._runs()
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.count, self.table = 0, 1 << 16
        self.same: dict = {}  # one object for equal parts of states
        self.keys, self.next, self.emit = np.full(self.table, -1, np.int64), np.zeros(self.table, np.int32), np.zeros(self.table, np.int32)
        self.start = self._state(self._run(1))

    def _merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The tokens of text, and the last two that were merged: the best-scored neighbours merge first, the leftmost of
        equals."""
        parts, last = list(text), None
        while len(parts) > 1:
            best, where = -np.inf, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1], -np.inf)
                if s > best:
                    best, where = s, i
            if where < 0:
                break
            last = (parts[where], parts[where + 1])
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts, last

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two tokens that a piece of several characters is merged from; None if its text has other tokens."""
        if piece not in self.halves:
            parts, last = self._merged(piece)
            self.halves[piece] = last if len(parts) == 1 else None
        return self.halves[piece]

    def _runs(self) -> list[int]:
        """Tokens of runs of the mark, by length; beyond the list they grow by one every `period` marks."""
        longest = max((len(x) for x in self.score if not x.strip(MARK)), default=1)
        runs = [len(self._merged(MARK * n)[0]) if n else 0 for n in range(8 * longest)]
        self.period = longest
        if any(runs[n] != runs[n - longest] + 1 for n in range(4 * longest, 8 * longest)):
            raise ValueError("runs of spaces don't settle")
        return runs[: 6 * longest]

    def _fits(self, before: str | None, piece: str) -> bool:
        """Whether the token `piece` may follow `before` (SEGMENT: may begin a segment).

        The merges that made the two are undone, the latest first, of equal ones the right one: where the tokens that
        then stand at the seam would have merged before the merge undone last, these two can't stand there.
        """
        if len(piece) > 1 and self._halves(piece) is None:
            return False
        if before is SEGMENT:
            return True
        key = (before, piece)
        if key not in self.follows:
            if len(self.follows) > KEPT // 2:
                self.follows.clear()
            a, b, limit = before, piece, len(self.time) + 2
            while True:
                if self.time.get(a + b, limit) < limit:
                    self.follows[key] = False
                    break
                x, y = (self.time[z] if len(z) > 1 else 0 for z in (a, b))
                if x > y:
                    limit, a = x, self._halves(a)[1]
                elif y:
                    limit, b = y + 1, self._halves(b)[0]
                else:
                    self.follows[key] = True
                    break
        return self.follows[key]

    def _run(self, length: int) -> tuple:
        """The state after `length` marks in a row."""
        shorter = self.runs[length - 1] - self.runs[length]
        return (MARK, ((SEGMENT, shorter), (MARK, 0)), length)

    def _state(self, state: tuple) -> int:
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
        return self.number[state]

    def _step(self, state: tuple, kind: int) -> tuple[tuple, int]:
        """The next state and the change in the number of tokens."""
        text, places, run = state
        if kind < 5:  # bytes stand for the character, and nothing merges with them
            return ("", ((SEGMENT, 0),), 0), kind
        if kind == self.space:
            longer = run + 1
            if longer >= len(self.runs):
                longer -= self.period
            return self._run(longer if run else 1), (self.runs[longer] - self.runs[run] + (1 if longer <= run else 0)) if run else 1
        text += self.char[kind]
        for k, place in enumerate(places):
            piece = text[k:]
            if place is not None and piece in self.score and self._fits(place[0], piece):
                last, change = piece, place[1] + 1
                break
        else:
            raise ValueError(f"no token ends after {text!r}")
        one = lambda x: self.same.setdefault(x, x)
        places = [*(None if x is None else (x[0], x[1] - change) for x in places), (one(last), 0)]
        cut = 0
        while cut < len(text) and text[cut:] not in self.begins:
            cut += 1
        return (one(text[cut:]), tuple(one(x) if i == len(text) or text[i:] in self.begins else None for i, x in enumerate(places) if i >= cut), 0), change

    def _learn(self, keys: np.ndarray) -> None:
        for key in keys.tolist():
            after, change = self._step(self.states[key >> CLASSES], key & ((1 << CLASSES) - 1))
            if 4 * (self.count + 1) > self.table:
                self._grow()
            self._put(key, self._state(after), change)
            self.count += 1

    def _put(self, key: int, after: int, change: int) -> None:
        slot = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 40 & self.table - 1
        while self.keys[slot] >= 0:
            slot = slot + 1 & self.table - 1
        self.keys[slot], self.next[slot], self.emit[slot] = key, after, change

    def _grow(self) -> None:
        old = np.flatnonzero(self.keys >= 0)
        rows = self.keys[old].tolist(), self.next[old].tolist(), self.emit[old].tolist()
        self.table *= 4
        self.keys, self.next, self.emit = np.full(self.table, -1, np.int64), np.zeros(self.table, np.int32), np.zeros(self.table, np.int32)
        for row in zip(*rows, strict=True):
            self._put(*row)

    def _slots(self, key: np.ndarray) -> np.ndarray:
        """Where the keys stand; unknown ones are learned."""
        while True:
            mask = self.table - 1
            slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & mask
            found = self.keys[slot]
            wrong = np.flatnonzero(found != key)
            while len(wrong):
                open_ = wrong[found[wrong] >= 0]
                if not len(open_):
                    break
                slot[open_] = (slot[open_] + 1) & mask
                found[open_] = self.keys[slot[open_]]
                wrong = np.flatnonzero(found != key)
            if not len(wrong):
                return slot
            self._learn(np.unique(key[wrong]))

    def _advance(self, codes: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Run each lane's characters from its state: exit states and counts."""
        order = np.argsort(-length, kind="stable")
        at, n = start[order].copy(), length[order]
        here, total = state[order].astype(np.int64), np.zeros(len(order), np.int64)
        for m in np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), side="left").tolist():
            slot = self._slots(here[:m] << CLASSES | codes[at[:m]])
            here[:m] = self.next[slot]
            total[:m] += self.emit[slot]
            at[:m] += 1
        out, counts = np.empty_like(here), np.empty_like(total)
        out[order], counts[order] = here, total
        return out, counts

    def __call__(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        short = [i for i, t in enumerate(texts) if len(t) <= BLOCK]
        if self.count > KEPT:
            self._reset()
        out[short], _ = self._count([texts[i] for i in short], np.full(len(short), self.start))
        for i in np.flatnonzero([len(t) > BLOCK for t in texts]).tolist():
            state = self.states[self.start]
            for a in range(0, len(texts[i]), BLOCK):
                if self.count > KEPT:
                    self._reset()
                n, left = self._count([texts[i][a : a + BLOCK]], np.array([self._state(state)]))
                out[i], state = out[i] + n[0], self.states[left[0]]
        return out + np.array([bool(t) for t in texts], np.int64)  # the mark before a text

    def _count(self, texts: list[str], entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The change in the number of tokens over each text from its entry state, and its exit state."""
        size = np.array([len(t) for t in texts], np.int64)
        codes = self.classes[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        if not len(codes):
            return np.zeros(len(texts), np.int64), entry
        first = np.concatenate([[0], np.cumsum(size)])
        per = -(-size // CHUNK)
        text = np.repeat(np.arange(len(texts)), per)
        chunk0 = np.cumsum(per) - per
        start = (np.arange(len(text)) - chunk0[text]) * CHUNK + first[text]
        end = np.minimum(start + CHUNK, first[text + 1])
        # Where the state is known whatever came before: at white space after another character.
        known = np.flatnonzero((codes[1:] == self.space) & (codes[:-1] != self.space)) + 1
        sync = np.searchsorted(known, start + 1)
        sync = np.where(sync < len(known), known[np.minimum(sync, len(known) - 1)] if len(known) else len(codes), len(codes))
        opens = start == first[text]  # a text's first chunk
        constant = (sync < end) & ~opens
        head = np.where(opens, 0, np.where(constant, sync - start, end - start))
        begin = np.where(opens, start, np.where(constant, sync + 1, end))
        leaving, count = self._advance(codes, begin, end - begin, np.where(opens, entry[text], self.start))
        count += constant  # the mark itself
        total = np.bincount(text, count, minlength=len(texts)).astype(np.int64)
        ready = opens | constant
        # Maps of the chunks' heads: (chunk, entry) -> (exit, count). Behind a ready chunk the entry is its exit.
        chunk = np.flatnonzero(head > 0)
        sure = ready[chunk - 1]
        guess = np.flatnonzero(~sure)
        state = leaving[chunk - 1]
        if len(guess):
            ahead = np.minimum(AHEAD, CHUNK)
            state[guess], _ = self._advance(codes, start[chunk[guess]] - ahead, np.full(len(guess), ahead), np.full(len(guess), self.start))
        maps = np.zeros((0, 4), np.int64)  # chunk, entry, exit, count
        while len(chunk):
            left, more = self._advance(codes, start[chunk], head[chunk], state)
            maps = np.concatenate([maps, np.stack([chunk, state, left, more], axis=1)])
            # Exits that the next chunk hasn't as entries yet.
            goes = maps[~ready[maps[:, 0]]]
            goes = goes[np.append(head, 0)[goes[:, 0] + 1] > 0]
            asked = np.unique(goes[:, 0] + 1 << 32 | goes[:, 2])
            asked = np.setdiff1d(asked, maps[:, 0] << 32 | maps[:, 1], assume_unique=False)
            chunk, state = asked >> 32, asked & (1 << 32) - 1
        if len(maps):
            names = maps[:, 0] << 32 | maps[:, 1]
            maps = maps[np.argsort(names)]
            names = np.sort(names)
            open_ = ~ready[maps[:, 0]]
            after = np.append(head, 0)[maps[:, 0] + 1] > 0
            to = np.full(len(maps) + 1, len(maps))
            some = np.flatnonzero(open_ & after)
            to[some] = np.searchsorted(names, maps[some, 0] + 1 << 32 | maps[some, 2])
            exits, sums = np.append(maps[:, 2], 0), np.append(maps[:, 3], 0)
            last = np.append(maps[:, 0], -1)
            while (to[:-1] < len(maps)).any():  # each map composed with the one that it goes on to
                sums = sums + sums[to]
                on = to < len(maps)
                exits[on], last[on] = exits[to[on]], last[to[on]]
                to = to[to]
            of = np.flatnonzero(ready[maps[:, 0] - 1] & (maps[:, 1] == leaving[maps[:, 0] - 1]))
            total += np.bincount(text[maps[of, 0]], sums[of], minlength=len(texts)).astype(np.int64)
            ends = of[~ready[last[of]]]  # chains that reach their text's end without a place of known state
            leaving[last[ends]] = exits[ends]
        out = entry.copy()
        full = np.flatnonzero(size)
        out[full] = leaving[chunk0[full] + per[full] - 1]
        return total, out


_OPEN: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The worker's transducer for the model at path."""
    if path not in _OPEN:
        _OPEN.clear()
        _OPEN[path] = Transducer(path)
    return _OPEN[path]


def token_counts(docs: DataFrame, model: str, limit: int = 4096, text: str = "text") -> DataFrame:
    """The columns of op10's contract."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = transducer(model)
        for batch in steps(batches, limit=1 << 20):
            n = count([x or "" for x in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    body = F.col(text).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length(body), F.lit(0)).cast("long").alias("n_bytes"), body.alias("text"))
    out = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
