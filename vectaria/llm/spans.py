"""Spans as text: shared by the PII and secret operators."""

from __future__ import annotations

import hashlib

import pyarrow as pa

Span = tuple[str, int, int]
SPANS_DDL = "array<struct<kind: string, start: bigint, stop: bigint>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))


def ordered(spans: list[Span], kinds: dict[str, int]) -> list[Span]:
    """By start, then by kind as listed; code points, end exclusive."""
    return sorted(spans, key=lambda s: (s[1], kinds[s[0]], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def as_array(rows: list[list[Span]]) -> pa.Array:
    return pa.array([[{"kind": k, "start": a, "stop": z} for k, a, z in r] for r in rows], _SPANS)
