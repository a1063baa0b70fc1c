"""Index configuration."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark import StorageLevel


@dataclass
class IndexConfig:
    """Parameters of an index; thresholds and soft_k may be changed at any time, within what ``check`` allows.

    ``calibrate`` acts from 1,000 rows on. ``storage`` names the level at which postings are kept
    besides their tables ("DISK_ONLY", "MEMORY_AND_DISK", ...); "" reads the tables each time.
    """

    dim: int
    n_clusters: int = 64
    nprobe: int = 8
    soft_k: int = 1
    split_threshold: float = 3.0
    max_split_iters: int = 10
    quant: str = "none"
    tq_bits: int = 4
    lut_bits: int = 8
    calibrate: bool = True
    rerank_k: int = 100
    train_rounds: int = 25
    seed: int | None = 42
    empty_policy: str = "keep"
    storage: str = ""

    def __post_init__(self) -> None:
        self.check()
        object.__setattr__(self, "_made", True)

    def __setattr__(self, name: str, value: object) -> None:
        before = getattr(self, name, None)
        object.__setattr__(self, name, value)
        if getattr(self, "_made", False):
            try:
                self.check()
            except ValueError:
                object.__setattr__(self, name, before)
                raise

    def check(self) -> None:
        if self.dim < 1 or self.n_clusters < 1 or self.nprobe < 1 or self.soft_k < 1:
            raise ValueError("dim, n_clusters, nprobe and soft_k must be positive")
        if self.storage and not hasattr(StorageLevel, self.storage):
            raise ValueError("storage must be a name of a storage level")
        if self.quant not in ("none", "tq"):
            raise ValueError("quant must be none or tq")
        if not 1 <= self.tq_bits <= 8:
            raise ValueError("tq_bits must be from 1 to 8")
        if self.lut_bits not in (0, 8):
            raise ValueError("lut_bits must be 0 or 8")
        if self.split_threshold <= 0 or self.max_split_iters < 1 or self.rerank_k < 1:
            raise ValueError("split_threshold, max_split_iters and rerank_k must be positive")

    def as_dict(self) -> dict:
        return asdict(self)
