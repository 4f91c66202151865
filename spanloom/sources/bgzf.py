"""Blocked gzip: blocks read from any place, and written with the virtual offsets that an index names.

A virtual offset is the offset of a block in the file, shifted by 16 bits, and the place in the block's content.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

#: Content of a block as written; compressed it must fit in 65,536 bytes with head and tail.
BLOCK = 0xFF00
#: Most bytes of a block in a file.
MOST = 1 << 16
_MAGIC = b"\x1f\x8b\x08\x04"


def block_size(head: bytes) -> int:
    """Size of the block that begins here; 0 if none does."""
    if len(head) < 18 or head[:4] != _MAGIC:
        return 0
    end = min(12 + int.from_bytes(head[10:12], "little"), len(head))
    at = 12
    while at + 6 <= end:
        if head[at : at + 4] == b"BC\x02\x00":
            return int.from_bytes(head[at + 4 : at + 6], "little") + 1
        at += 4 + int.from_bytes(head[at + 2 : at + 4], "little")
    return 0


def blocks(stream, start: int) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the blocks from a block's start on. ValueError where neither a block nor the file's end follows."""
    stream.seek(start)
    held, at = b"", start
    while True:
        if len(held) < MOST:
            held += stream.read(16 * MOST)
        if not held:
            return
        size = block_size(held[:MOST])
        if not size or size > len(held):
            raise ValueError(f"no whole block at byte {at}")
        yield at, zlib.decompress(held[:size], 31)
        held, at = held[size:], at + size


def find_block(stream, start: int, size: int) -> int:
    """Offset of the first block at or after a byte, the file's size if there is none. A place counts if what begins there
    inflates to content with the right checksum, so letters that look like a head do not."""
    stream.seek(start)
    data, base = stream.read(2 * MOST), start
    while data:
        at = data.find(_MAGIC)
        while 0 <= at < MOST:
            n = block_size(data[at : at + MOST])
            if n and at + n <= len(data):
                try:
                    zlib.decompress(data[at : at + n], 31)
                    return base + at
                except zlib.error:
                    pass
            at = data.find(_MAGIC, at + 1)
        more = stream.read(MOST)
        base, data = base + min(MOST, len(data)), data[MOST:] + more
    return size


class Writer:
    """Blocks onto a stream; tell() is the virtual offset of what is written next."""

    def __init__(self, out, level: int = 6):
        self.out, self.level, self.at, self.held = out, level, 0, bytearray()

    def tell(self) -> int:
        return self.at << 16 | len(self.held)

    def write(self, data: bytes) -> None:
        self.held += data
        while len(self.held) >= BLOCK:
            self._block(bytes(self.held[:BLOCK]))
            del self.held[:BLOCK]

    def _block(self, content: bytes) -> None:
        packer = zlib.compressobj(self.level, zlib.DEFLATED, -15)
        packed = packer.compress(content) + packer.flush()
        size = len(packed) + 26
        if size > MOST:  # content that does not compress
            half = len(content) // 2
            self._block(content[:half])
            self._block(content[half:])
            return
        head = _MAGIC + b"\0\0\0\0\0\xff\x06\0BC\x02\0" + (size - 1).to_bytes(2, "little")
        self.out.write(head + packed + zlib.crc32(content).to_bytes(4, "little") + len(content).to_bytes(4, "little"))
        self.at += size

    def close(self) -> None:
        """What is held, and the empty block that ends a file."""
        if self.held:
            self._block(bytes(self.held))
        self.held = bytearray()
        self._block(b"")
