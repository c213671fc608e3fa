"""The arithmetic coder of ``mq`` over many words at once: a lane each, a symbol of every lane in one step of array operations.

The symbols' contexts repeat for all words alike, after a whole number of bytes (a round). So lanes that begin and end between
rounds are always in the same context, and a lane whose word is through takes the next one. Words are begun longest first;
what is left of the last few, and what a word has beyond whole rounds, goes on in ``mq.Encoder`` and ``mq.Decoder``.
The words and what they become are in memory together, with some 300 bytes a lane.
"""

from __future__ import annotations

import numpy as np

from . import mq

#: Lanes at most. Seconds of a symbol in the loops of ``mq``, and of a step of lanes: fixed and for each lane. They only choose the number of lanes.
MOST, _ALONE, _STEP, _LANE = 4096, 135e-9, 10e-6, 10e-9
#: Bytes for the code of a byte. A word that needs more leaves its lane.
_ROOM = 1.25


def _unless_still(to: np.ndarray) -> np.ndarray:
    """By 256 times the shift of the registers, and the state with the bit: the state stays where nothing is shifted."""
    table = np.zeros((16, 256), np.int64)
    table[:, : len(to)] = to
    table[0] = np.arange(256) & ~1
    return table.ravel()


# In the lanes a state of mq is doubled, so that a bit can be added: the bit to be coded, or whether it was the likelier one.
_Q = np.repeat([q for q, _, _ in mq._STEP], 2)
_LIKE = np.array([s & 1 == bit for s in range(len(mq._STEP)) for bit in (0, 1)])
_NEXT = _unless_still(2 * np.array([up if s & 1 == bit else down for s, (_, up, down) in enumerate(mq._STEP) for bit in (0, 1)]))
# A decoder's registers have this many bits more, so that bytes are read ahead.
_MORE = 31
_Q_HIGH = _Q << 16 + _MORE
_NEXT_READ = _unless_still(2 * np.array([to for _, up, down in mq._STEP for to in (down, up)]))
_READ = np.array([s & 1 ^ unlike for s in range(len(mq._STEP)) for unlike in (1, 0)], np.uint8)
_SHIFTS = np.arange(7, -1, -1)[:, None]


def width(rounds: np.ndarray) -> int:
    """The number of lanes that takes least time for words of so many rounds, longest first."""
    most, total, best = len(rounds), int(rounds.sum()), (float("inf"), 1)
    for n in sorted({min(most, max(1, MOST >> k)) for k in range(8)}):
        until = total // n
        rest = rounds[rounds > until]  # about those that go on when none is left to begin
        alive = np.arange(1, len(rest) + 1)
        tail = (-np.diff(rest, append=until) * np.minimum(alive * _ALONE, _STEP + alive * _LANE)).sum()
        best = min(best, (until * (_STEP + n * _LANE) + tail, n))
    return best[1]


class _Lanes:
    """Registers in rows, a lane in each column: the contexts' states and what NAMES has; beside them what a round's steps hold."""

    NAMES: tuple[str, ...] = ()

    def __init__(self, sizes: np.ndarray, contexts: list[int]):
        self.contexts, self.period, self.sizes = contexts, len(contexts) // 8, sizes
        rounds = sizes // self.period
        self.order = np.argsort(-rounds, kind="stable")
        self.rounds = rounds[self.order]
        self.some = int((rounds > 0).sum())

    def run(self) -> None:
        rounds, some, now = self.rounds[: self.some], self.some, 0
        n = begun = width(rounds) if some else 0
        self.word, stop = self.order[:n].copy(), rounds[:n].copy()
        self.hold(np.zeros((mq.CONTEXTS + len(self.NAMES), n), np.int64))
        self.begin(np.arange(n))
        while len(stop) * _ALONE > _STEP + len(stop) * _LANE:
            until = int(stop.min())
            while now < until:
                self.round()
                now += 1
            through = np.flatnonzero(stop == until)
            for lane in through.tolist():
                self.end(lane)
            n = min(len(through), some - begun)
            new, free = through[:n], through[n:]
            self.word[new], stop[new] = self.order[begun : begun + n], now + rounds[begun : begun + n]
            begun += n
            self.begin(new)
            if len(free):
                stay = np.ones(len(stop), bool)
                stay[free] = False
                self.word, stop = self.word[stay], stop[stay]
                self.hold(self.all.compress(stay, 1))
        for lane in range(len(stop)):
            self.end(lane)
        for word in self.order[begun:].tolist():
            self.alone(word)

    def hold(self, registers: np.ndarray) -> None:
        self.all, n = registers, registers.shape[1]
        for name, row in zip(self.NAMES, registers[mq.CONTEXTS :], strict=True):
            setattr(self, name, row)
        self.spare = np.empty((2, n), np.int64), np.empty((2, n), bool), np.empty(n)
        self.log = np.empty((2, 8 * self.period, n), np.int64)

    def state(self, lane: int) -> list[int]:
        return (self.all[: mq.CONTEXTS, lane] >> 1).tolist()

    def begin(self, lanes: np.ndarray) -> None:
        self.all[: mq.CONTEXTS, lanes] = 2 * np.array(mq.contexts())[:, None]


class _Encoders(_Lanes):
    NAMES = ("a", "c", "left", "last", "at", "put", "limit")  # left is room in mq; last the byte that a carry may still change

    def __init__(self, words: list[bytes], contexts: list[int]):
        sizes = np.array([len(w) for w in words], np.int64)
        super().__init__(sizes, contexts)
        self.words, self.out = words, [b""] * len(words)
        self.data, self.begins = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes
        self.margin = 18 * self.period  # more than a round can add: 15 bits a symbol, 7 in a byte
        rooms = (sizes * _ROOM).astype(np.int64) + 64 + self.margin
        self.ends = np.cumsum(rooms)
        self.spots, self.waste = self.ends - rooms, int(rooms.sum())
        self.spaces = np.empty(self.waste + 2 * self.margin, np.uint8)

    def begin(self, lanes: np.ndarray) -> None:
        super().begin(lanes)
        word = self.word[lanes]
        self.a[lanes], self.c[lanes], self.left[lanes], self.last[lanes] = 0x8000, 0, 12, 0
        self.at[lanes], self.put[lanes], self.limit[lanes] = self.begins[word], self.spots[word], self.ends[word] - self.margin

    def round(self) -> None:
        a, c, left, data, at = self.a, self.c, self.left, self.data, self.at
        (i, to), (low, like), real = self.spare
        power = real.view(np.int64)
        self.added, self.shifted = self.log
        self.keep(0)
        bits = (np.stack([data[at + k] for k in range(self.period)])[:, None] >> _SHIFTS & 1).reshape(8 * self.period, -1).astype(np.int64)
        at += self.period
        for k, context in enumerate(self.contexts):
            state, q, shift = self.all[context], self.added[k], self.shifted[k]
            np.add(state, bits[k], i)
            _Q.take(i, None, q, "clip")
            np.subtract(a, q, a)
            np.less(a, q, low)
            _LIKE.take(i, None, like, "clip")
            np.equal(low, like, low)  # where the code stays and the interval becomes q
            np.putmask(a, low, q)
            np.putmask(q, low, 0)
            np.add(c, q, c)
            np.copyto(real, a)
            np.right_shift(power, 52, shift)
            np.subtract(1023 + 15, shift, shift)
            np.left_shift(a, shift, a)
            np.left_shift(c, shift, c)
            np.subtract(left, shift, left)
            np.left_shift(shift, 8, to)
            np.add(to, i, to)
            _NEXT.take(to, None, state, "clip")
            if left.min() < -19:  # 15 more bits have room below bit 63
                self.flush(k + 1)
        self.flush(8 * self.period)
        full = self.put > self.limit
        if full.any():  # these words are coded by themselves when they are through
            self.put[full], self.limit[full] = self.waste, self.waste - 1

    def keep(self, k: int) -> None:
        self.since, self.c_then, self.left_then = k, self.c.copy(), self.left.copy()

    def flush(self, k: int) -> None:
        """mq.Encoder._byte for all lanes that have a byte complete, after symbol k, which may be later than there."""
        lanes = first = np.flatnonzero(self.left <= 0)
        put_then, last_then, odd, later = self.put[lanes], self.last[lanes], [], 0
        while len(lanes):
            c, over, byte, put = self.c[lanes], -self.left[lanes], self.last[lanes], self.put[lanes]
            carry = (c >> 27 + over) * (byte != 255)
            byte += carry
            c -= carry << 27 + over
            stuffed = (byte == 255).astype(np.int64)
            below = 19 + stuffed + over
            now = c >> below
            self.spaces[put] = byte
            self.put[lanes], self.last[lanes], self.c[lanes] = put + 1, now, c & (1 << below) - 1
            if (zero := now < (later or carry)).any():
                odd += lanes[zero].tolist()
            later = 1  # carries into these bytes were added with the first
            left = 8 - stuffed - over
            self.left[lanes] = left
            lanes = lanes[left <= 0]
        for lane in set(odd):  # a carry of later symbols may have gone through a byte of ones, which would have stopped it
            at = int(np.searchsorted(first, lane))
            self.again(lane, k, int(put_then[at]), int(last_then[at]))
        self.keep(k)

    def again(self, lane: int, k: int, put: int, last: int) -> None:
        """The symbols since the last flush, one by one."""
        e = mq.Encoder([])
        e.c, e.room, e.out = int(self.c_then[lane]), int(self.left_then[lane]), bytearray([last])
        for q, n in zip(self.added[self.since : k, lane].tolist(), self.shifted[self.since : k, lane].tolist(), strict=True):
            e.c += q
            while n >= e.room:
                e.c, n = e.c << e.room, n - e.room
                e._byte()
            e.c, e.room = e.c << n, e.room - n
        done = len(e.out) - 1
        self.spaces[put : put + done] = np.frombuffer(e.out, np.uint8, done)
        self.put[lane], self.last[lane], self.c[lane], self.left[lane] = put + done, e.out[-1], e.c, e.room

    def end(self, lane: int) -> None:
        word = int(self.word[lane])
        if self.limit[lane] < self.waste - 1:
            e = mq.Encoder(self.state(lane))
            e.a, e.c, e.room = int(self.a[lane]), int(self.c[lane]), int(self.left[lane])
            e.out = bytearray(self.spaces[self.spots[word] : self.put[lane]].tobytes())
            e.out.append(int(self.last[lane]))
            self.alone(word, e, int(self.at[lane] - self.begins[word]))
        else:
            self.alone(word)

    def alone(self, word: int, e: mq.Encoder | None = None, done: int = 0) -> None:
        e, part = e or mq.Encoder(), 512 * self.period
        for lo in range(done, len(self.words[word]), part):
            bits = b"".join([mq.BITS[b] for b in self.words[word][lo : lo + part]])
            e.write(bits, (self.contexts * 512)[: len(bits)])
        self.out[word] = e.finish()


class _Decoders(_Lanes):
    NAMES = ("a", "c", "left", "ones", "at", "past", "put")  # left is room in mq; ones: the last byte was 0xFF; past: bytes read past the end

    def __init__(self, coded: list[bytes], sizes: np.ndarray, contexts: list[int]):
        super().__init__(sizes, contexts)
        self.coded, lengths = coded, np.array([len(w) + 2 for w in coded], np.int64)
        self.data, self.begins = np.frombuffer(b"".join([w + b"\xff\xff" for w in coded]), np.uint8), np.cumsum(lengths) - lengths
        self.spots = np.cumsum(sizes) - sizes
        self.spaces = np.empty(int(sizes.sum()), np.uint8)

    def begin(self, lanes: np.ndarray) -> None:
        super().begin(lanes)
        word = self.word[lanes]
        at = self.begins[word]
        first = self.data[at].astype(np.int64)
        self.a[lanes], self.c[lanes], self.left[lanes], self.ones[lanes] = 0x8000 << 16 + _MORE, first << 16 + 7 + _MORE, -7, first == 255
        self.at[lanes], self.past[lanes], self.put[lanes] = at + 1, 0, self.spots[word]

    def round(self) -> None:
        a, c, left = self.a, self.c, self.left
        (q, shift), (low, like), real = self.spare
        power, seen = real.view(np.int64), self.log[0]
        for k, context in enumerate(self.contexts):
            if not k & 1 and left.min() < 30:
                self.fill()
            state, i = self.all[context], seen[k]
            _Q_HIGH.take(state, None, q, "clip")
            np.subtract(a, q, a)
            np.less(c, q, low)
            np.less(a, q, like)
            np.equal(low, like, like)
            np.putmask(a, low, q)
            np.putmask(q, low, 0)
            np.subtract(c, q, c)
            np.copyto(real, a)
            np.right_shift(power, 52, shift)
            np.subtract(1023 + 31 + _MORE, shift, shift)
            np.left_shift(a, shift, a)
            np.left_shift(c, shift, c)
            np.subtract(left, shift, left)
            np.add(state, like, i)
            np.left_shift(shift, 8, shift)
            np.add(shift, i, shift)
            _NEXT_READ.take(shift, None, state, "clip")
        got = np.packbits(_READ.take(seen).reshape(self.period, 8, -1), axis=1)
        for k in range(self.period):
            self.spaces[self.put + k] = got[k, 0]
        self.put += self.period

    def fill(self) -> None:
        """mq.Decoder._byte for all lanes that have room, ahead of the time: what an encoder wrote is read alike."""
        lanes = np.flatnonzero(self.left <= 8 + _MORE)
        while len(lanes):
            at, left, ones = self.at[lanes], self.left[lanes], self.ones[lanes]
            byte = self.data[at].astype(np.int64)
            past = ones & (byte > 0x8F)
            byte |= -past & 255
            seven = ones & ~past
            self.c[lanes] += byte << 8 + _MORE - left + seven
            left += 8 - seven
            self.left[lanes], self.ones[lanes], self.at[lanes] = left, byte == 255, at + 1 - past
            self.past[lanes] += past
            lanes = lanes[left <= 8 + _MORE]

    def end(self, lane: int) -> None:
        word, done = int(self.word[lane]), int(self.put[lane])
        done -= int(self.spots[word])
        if done == self.sizes[word]:
            return
        if not done:
            self.alone(word)
            return
        c, left, past, at, coded = int(self.c[lane]), int(self.left[lane]), int(self.past[lane]), int(self.at[lane] - self.begins[word]), self.coded[word] + b"\xff\xff"
        while left > 8:  # give back what was read ahead
            at -= not past
            byte, seven = (255, 0) if past else (coded[at], coded[at - 1] == 255)
            past -= past > 0
            left -= 8 - seven
            c -= byte << 8 + _MORE - left + seven
        d = mq.Decoder(self.coded[word], self.state(lane))
        d.a, d.c, d.room, d.at = int(self.a[lane]) >> 16 + _MORE, c >> _MORE, left, at - 1
        self.alone(word, d, done)

    def alone(self, word: int, d: mq.Decoder | None = None, done: int = 0) -> None:
        d, part, spot = d or mq.Decoder(self.coded[word]), 512 * self.period, int(self.spots[word])
        for lo in range(done, int(self.sizes[word]), part):
            n = min(part, int(self.sizes[word]) - lo)
            bits = np.frombuffer(d.read((self.contexts * 512)[: 8 * n]), np.uint8)
            self.spaces[spot + lo : spot + lo + n] = np.packbits(bits)


def encode(words: list[bytes], contexts: list[int]) -> list[bytes]:
    """A codeword for the bits of each word, highest first, as by mq.Encoder; contexts repeat."""
    lanes = _Encoders(words, contexts)
    lanes.run()
    return lanes.out


def decode(coded: list[bytes], sizes: list[int], contexts: list[int]) -> list[bytes]:
    """The words of so many bytes back from what encode made of them, as by mq.Decoder."""
    lanes = _Decoders(coded, np.array(sizes, np.int64), contexts)
    lanes.run()
    return [lanes.spaces[lo : lo + n].tobytes() for lo, n in zip(lanes.spots.tolist(), sizes, strict=True)]
