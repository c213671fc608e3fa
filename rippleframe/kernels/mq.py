"""The adaptive binary arithmetic coder of ITU-T T.800 Annex C, and its raw (bypass) companion.

Encoder and decoder share one call, ``code(bit, context)``: the encoder writes the bit and returns it,
the decoder ignores it and returns what it reads. So the passes of a block are written once.
"""

from __future__ import annotations

import numpy as np

#: Fixed values, T.800 Table C.2: probability, next state after the likelier and the other symbol, switch.
STATES = (
    (0x5601, 1, 1, 1), (0x3401, 2, 6, 0), (0x1801, 3, 9, 0), (0x0AC1, 4, 12, 0), (0x0521, 5, 29, 0), (0x0221, 38, 33, 0), (0x5601, 7, 6, 1), (0x5401, 8, 14, 0),
    (0x4801, 9, 14, 0), (0x3801, 10, 14, 0), (0x3001, 11, 17, 0), (0x2401, 12, 18, 0), (0x1C01, 13, 20, 0), (0x1601, 29, 21, 0), (0x5601, 15, 14, 1), (0x5401, 16, 14, 0),
    (0x5101, 17, 15, 0), (0x4801, 18, 16, 0), (0x3801, 19, 17, 0), (0x3401, 20, 18, 0), (0x3001, 21, 19, 0), (0x2801, 22, 19, 0), (0x2401, 23, 20, 0), (0x2201, 24, 21, 0),
    (0x1C01, 25, 22, 0), (0x1801, 26, 23, 0), (0x1601, 27, 24, 0), (0x1401, 28, 25, 0), (0x1201, 29, 26, 0), (0x1101, 30, 27, 0), (0x0AC1, 31, 28, 0), (0x09C1, 32, 29, 0),
    (0x08A1, 33, 30, 0), (0x0521, 34, 31, 0), (0x0441, 35, 32, 0), (0x02A1, 36, 33, 0), (0x0221, 37, 34, 0), (0x0141, 38, 35, 0), (0x0111, 39, 36, 0), (0x0085, 40, 37, 0),
    (0x0049, 41, 38, 0), (0x0025, 42, 39, 0), (0x0015, 43, 40, 0), (0x0009, 44, 41, 0), (0x0005, 45, 42, 0), (0x0001, 45, 43, 0), (0x5601, 46, 46, 0),
)
CONTEXTS, RUN, UNIFORM = 19, 17, 18
#: States that contexts begin in, other than 0.
BEGIN = {0: 4, RUN: 3, UNIFORM: 46}

# A state with its likelier symbol is one number, 2 * state + symbol: (probability, after likelier, after other).
_STEP = [(q, 2 * up + s, 2 * down + (s ^ switch)) for q, up, down, switch in STATES for s in (0, 1)]


def contexts() -> list[int]:
    return [2 * BEGIN.get(c, 0) for c in range(CONTEXTS)]


class Encoder:
    def __init__(self, state: list[int] | None = None):
        self.state = contexts() if state is None else state
        self.begin()

    def begin(self) -> None:
        """A new codeword; the contexts stay."""
        self.a, self.c, self.room, self.out = 0x8000, 0, 12, bytearray(1)  # the first byte stands before the codeword

    def code(self, bit: int, context: int) -> int:
        now = self.state[context]
        q, likely, other = _STEP[now]
        a = self.a - q
        if bit == now & 1:
            if a & 0x8000:
                self.a, self.c = a, self.c + q
                return bit
            if a < q:
                a = q
            else:
                self.c += q
            self.state[context] = likely
        else:
            if a < q:
                self.c += q
            else:
                a = q
            self.state[context] = other
        while True:
            a, self.c, self.room = a << 1, self.c << 1, self.room - 1
            if not self.room:
                self._byte()
            if a & 0x8000:
                self.a = a
                return bit

    def write(self, bits: bytes, contexts: list[int]) -> None:
        """code() for many bits with their contexts."""
        state, steps, low, c, room = self.state, _STEP, self.a, self.c, self.room
        for bit, context in zip(bits, contexts, strict=True):
            now = state[context]
            q, likely, other = steps[now]
            a = low - q
            if bit == now & 1:
                if a & 0x8000:
                    low, c = a, c + q
                    continue
                if a < q:
                    a = q
                else:
                    c += q
                state[context] = likely
            else:
                if a < q:
                    c += q
                else:
                    a = q
                state[context] = other
            n = 16 - a.bit_length()
            low = a << n
            while n >= room:
                self.c, n = c << room, n - room
                self._byte()
                c, room = self.c, self.room
            c, room = c << n, room - n
        self.a, self.c, self.room = low, c, room

    def _byte(self) -> None:
        out = self.out
        if out[-1] != 0xFF and self.c >= 0x8000000:
            out[-1] += 1  # the carry
            self.c &= 0x7FFFFFF
        if out[-1] == 0xFF:
            out.append(self.c >> 20)
            self.c, self.room = self.c & 0xFFFFF, 7
        else:
            out.append(self.c >> 19)
            self.c, self.room = self.c & 0x7FFFF, 8

    def enough(self) -> int:
        """Bytes that surely decode all symbols so far."""
        return len(self.out) - 1 + 4

    def finish(self) -> bytes:
        most = self.c + self.a
        self.c |= 0xFFFF
        if self.c >= most:
            self.c -= 0x8000
        for _ in range(2):
            self.c <<= self.room
            self._byte()
        out = bytes(self.out[1:])
        return out[:-1] if out.endswith(b"\xff") else out


class Decoder:
    def __init__(self, data: bytes, state: list[int] | None = None):
        self.state = contexts() if state is None else state
        self.data, self.at = data + b"\xff\xff", 0  # past the end come ones
        self.c, self.room = self.data[0] << 16, 0
        self._byte()
        self.c, self.room, self.a = self.c << 7, self.room - 7, 0x8000

    def _byte(self) -> None:
        data, at = self.data, self.at
        if data[at] == 0xFF:
            if data[at + 1] > 0x8F:
                self.c, self.room = self.c + 0xFF00, 8
            else:
                self.at, self.c, self.room = at + 1, self.c + (data[at + 1] << 9), 7
        else:
            self.at, self.c, self.room = at + 1, self.c + (data[at + 1] << 8), 8

    def code(self, _: int, context: int) -> int:
        if not 0 <= context < CONTEXTS:
            return 0
        now = self.state[context]
        q, likely, other = _STEP[now]
        a = self.a - q
        if self.c >> 16 < q:
            bit = now & 1 if a < q else now & 1 ^ 1
            self.state[context] = likely if a < q else other
            a = q
        else:
            self.c -= q << 16
            if a & 0x8000:
                self.a = a
                return now & 1
            bit = now & 1 ^ 1 if a < q else now & 1
            self.state[context] = other if a < q else likely
        while True:
            if not self.room:
                self._byte()
            a, self.c, self.room = a << 1, self.c << 1, self.room - 1
            if a & 0x8000:
                self.a = a
                return bit


    def read(self, contexts: list[int]) -> bytes:
        """code() for many contexts, each of which exists."""
        state, steps, low, c, room, out = self.state, _STEP, self.a, self.c, self.room, bytearray()
        put = out.append
        for context in contexts:
            now = state[context]
            q, likely, other = steps[now]
            a = low - q
            if c >> 16 < q:
                if a < q:
                    put(now & 1)
                    state[context] = likely
                else:
                    put(now & 1 ^ 1)
                    state[context] = other
                a = q
            else:
                c -= q << 16
                if a & 0x8000:
                    low = a
                    put(now & 1)
                    continue
                if a < q:
                    put(now & 1 ^ 1)
                    state[context] = other
                else:
                    put(now & 1)
                    state[context] = likely
            n = 16 - a.bit_length()
            low = a << n
            while n > room:
                self.c, n = c << room, n - room
                self._byte()
                c, room = self.c, self.room
            c, room = c << n, room - n
        self.a, self.c, self.room = low, c, room
        return bytes(out)


#: The bits of a byte.
BITS = [bytes(b >> i & 1 for i in range(7, -1, -1)) for b in range(256)]
# Bytes that are made of bits together.
_TOGETHER = 512


class RawEncoder:
    """Bits as they are; the byte after 0xFF carries seven."""

    def __init__(self):
        self.out, self.hold, self.room = bytearray(), 0, 8

    def code(self, bit: int, _: int) -> int:
        self.room -= 1
        self.hold |= bit << self.room
        if not self.room:
            self._push()
        return bit

    def write(self, bits: bytes) -> None:
        """code() for many bits: whole bytes up to one of ones together, else as many as the byte has room for."""
        at, n = 0, len(bits)
        while at < n:
            if self.room == 8 and (whole := min((n - at) // 8, _TOGETHER)):
                part = np.packbits(np.frombuffer(bits, np.uint8, 8 * whole, at)).tobytes()
                part = part[: part.find(0xFF) + 1] or part
                self.out += part
                at += 8 * len(part)
                if part[-1] == 0xFF:
                    self.room = 7
                continue
            for bit in bits[at : at + self.room]:
                at += 1
                self.code(bit, 0)

    def _push(self) -> None:
        self.out.append(self.hold)
        self.room, self.hold = 7 if self.hold == 0xFF else 8, 0

    def finish(self) -> bytes:
        if self.room < 8 and not (self.room == 7 and self.out[-1:] == b"\xff"):
            self._push()
        return bytes(self.out[:-1] if self.out[-1:] == b"\xff" else self.out)


class RawDecoder:
    def __init__(self, data: bytes):
        self.data, self.at, self.left, self.byte = data, 0, 0, 0

    def code(self, _: int, __: int) -> int:
        if not self.left:
            self.left = 7 if self.byte == 0xFF else 8
            self.byte = self.data[self.at] if self.at < len(self.data) else 0xFF
            self.at += 1
        self.left -= 1
        return self.byte >> self.left & 1

    def read(self, n: int) -> bytes:
        """code() n times: whole bytes up to one of ones together, else what is left of a byte."""
        out = []
        while n:
            if not self.left and self.byte != 0xFF and (whole := min(n // 8, len(self.data) - self.at)) > 0:
                end = self.data.find(0xFF, self.at, self.at + whole) + 1 or self.at + whole
                out.append(np.unpackbits(np.frombuffer(self.data, np.uint8, end - self.at, self.at)).tobytes())
                n, self.at, self.byte = n - 8 * (end - self.at), end, self.data[end - 1]
                continue
            if not self.left:
                self.left = 7 if self.byte == 0xFF else 8
                self.byte = self.data[self.at] if self.at < len(self.data) else 0xFF
                self.at += 1
            take, begin = min(self.left, n), 8 - self.left
            out.append(BITS[self.byte][begin : begin + take])
            self.left, n = self.left - take, n - take
        return b"".join(out)
