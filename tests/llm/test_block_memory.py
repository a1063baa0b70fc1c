"""Memory of the comparison of near copies, which an executor's workers take besides the JVM's."""

import tracemalloc

import numpy as np

from vectaria.llm import setsketch


def test_a_full_block_of_near_copies_takes_little():
    rng, n, registers = np.random.default_rng(1), 2 * setsketch.BLOCK, setsketch.REGISTERS
    sketch = np.tile(rng.integers(20000, 30000, registers).astype(np.uint16), (n, 1))
    other = rng.random(sketch.shape) < 0.04
    sketch[other] = rng.integers(20000, 30000, int(other.sum()))
    h = rng.integers(0, 2**63, (n, 300)).astype(np.uint64)
    h = np.where(rng.random(h.shape) < 0.08, h, h[0])
    t = {
        "id": np.arange(n), "component": np.arange(n), "n": np.full(n, 300), "main": np.full(n, -1), "band": np.zeros(n, np.int32),
        "sketch": sketch, "bits": setsketch._bits(sketch), "cells": [setsketch.cells_of(np.unique(x)) for x in h],
    }
    tracemalloc.start()
    a, b = setsketch._block_pairs(slice(0, n // 2), slice(n // 2, n), t, 80, setsketch._least_equal(registers, 80), registers)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(a) == len(b) > 1000 and most < 45e6
