"""Bits of packet headers, most significant first; the byte after 0xFF carries seven bits."""

from __future__ import annotations


class OutOfBits(ValueError):
    """No more bits, or a marker begins."""


class BitReader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at
        self.left = 0  # bits of the byte in hand that are still to come
        self.byte = 0
        self.marker = False

    def _load(self) -> None:
        if self.marker or self.at >= len(self.data):
            raise OutOfBits("no more bits")
        stuffed = self.byte == 0xFF and self.at > 0
        new = self.data[self.at]
        if stuffed and new & 0x80:
            self.at, self.marker, self.byte = self.at - 1, True, 0
            raise OutOfBits("a marker begins")
        self.byte, self.left, self.at = new, 7 if stuffed else 8, self.at + 1

    def bit(self) -> int:
        if not self.left:
            self._load()
        self.left -= 1
        return self.byte >> self.left & 1

    def bits(self, n: int) -> int:
        if not 0 <= n <= 32:
            raise ValueError("0 to 32 bits at a time")
        value = 0
        for _ in range(n):
            value = value << 1 | self.bit()
        return value

    def align(self) -> int:
        """Drops the rest of the byte, and the stuffed byte after a last 0xFF; the place that follows."""
        self.left = 0
        if self.byte == 0xFF and not self.marker and self.at < len(self.data):
            self.at += 1
        self.byte = 0
        return self.at


class BitWriter:
    def __init__(self):
        self.out = bytearray()
        self.hold, self.room = 0, 8

    def bit(self, b: int) -> int:
        self.room -= 1
        self.hold |= (b & 1) << self.room
        if not self.room:
            self.out.append(self.hold)
            self.room = 7 if self.hold == 0xFF else 8
            self.hold = 0
        return b

    def bits(self, value: int, n: int) -> None:
        for i in range(n - 1, -1, -1):
            self.bit(value >> i & 1)

    def flush(self) -> bytes:
        """Fills the last byte with zeros; a last 0xFF is followed by a byte of its own."""
        if self.room < 8 and (self.room != 7 or not self.out or self.out[-1] != 0xFF) or self.out[-1:] == b"\xff":
            self.out.append(self.hold)
            self.hold, self.room = 0, 8
        return bytes(self.out)


def stuffed_bits(data: bytes) -> int:
    """How many stuffing bits a writer adds to these bits."""
    w = BitWriter()
    for b in data:
        w.bits(b, 8)
    return sum(b == 0xFF for b in w.flush())
