"""Bit-serial kernels: each works on one independent unit (a block, a tile, a file) inside an Arrow batch."""
